"""Reports on clusters of words or documents (any ``item/document, cluster`` table)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from wordloom.functions.text import percent_label
from wordloom.operators.pairs import pairwise_count
from wordloom.operators.sentiment import comparison_scores
from wordloom.operators.stats import boxplot_stats
from wordloom.operators.tfidf import bind_tf_idf, exact_sum
from wordloom.operators.verbs import count_by, renamed_join, share, spread, tally, top_n


def entity_profiles(tokens: DataFrame, items: Sequence[str], more_than: int = 10) -> DataFrame:
    """Words that share chapters with each item → ``item1, item2, n`` (long)."""
    return pairwise_count(tokens, "word", "chapter", items=items).where(F.col("n") > more_than)


def _member_words(profiles: DataFrame, labels: DataFrame, items: Sequence[str], more_than: int) -> DataFrame:
    joined = renamed_join(profiles, labels, {"item1": "item"}).withColumnRenamed("item2", "word")
    return joined.where(~F.col("word").isin(*items) & (F.col("n") > more_than))


def cluster_words(
    profiles: DataFrame, labels: DataFrame, items: Sequence[str], more_than: int = 30, n: int = 6
) -> DataFrame:
    """Words most shared by the members of a cluster (mean over members)."""
    rows = _member_words(profiles, labels, items, more_than)
    means = rows.groupBy("cluster", "word").agg((F.sum("n") / F.count(F.lit(1))).alias("tot"))
    return top_n(means, n, "tot", ["cluster"])


def cluster_tfidf(
    profiles: DataFrame, labels: DataFrame, items: Sequence[str], more_than: int = 30, n: int = 6
) -> DataFrame:
    """Words with the largest mean tf-idf over the members of a cluster."""
    rows = bind_tf_idf(_member_words(profiles, labels, items, more_than), "word", "item1", "n")
    means = rows.groupBy("cluster", "word").agg(
        (exact_sum("tf_idf") / F.count(F.lit(1))).cast("double").alias("m_tf_idf"),
        (F.sum("n") / F.count(F.lit(1))).alias("tot"),
    )
    return top_n(means, n, "m_tf_idf", ["cluster"])


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return count_by(labels, ["cluster"]).orderBy(F.desc("n"), "cluster")


def cluster_topics(gamma: DataFrame, labels: DataFrame, above: float = 0.2) -> DataFrame:
    """Topic mix of a cluster's documents."""
    counts = count_by(gamma.join(labels, "document").where(F.col("gamma") > above), ["topic", "cluster"])
    return share(counts, "n", ["cluster"], "perc")


def cluster_topic_box(gamma: DataFrame, labels: DataFrame) -> DataFrame:
    return boxplot_stats(gamma.join(labels, "document"), "gamma", ["topic", "cluster"])


def cluster_volume_pivot(labels: DataFrame, sections: DataFrame, clusters: Sequence[int]) -> DataFrame:
    """Percent of a volume's documents in each cluster, one column per cluster."""
    placed = renamed_join(labels, sections.select("chapter", "volume"), {"document": "chapter"})
    shares = share(count_by(placed, ["volume", "cluster"]), "n", ["volume"], "p")
    cells = shares.select("volume", "cluster", percent_label(F.col("p") * 100, 0).alias("n"))
    return spread(cells, "cluster", "n", fill="0", values=clusters)


def _cluster_counts(tokens: DataFrame, labels: DataFrame) -> DataFrame:
    words = tally(tokens, ["chapter", "word"])
    joined = renamed_join(words, labels, {"chapter": "document"})
    return joined.groupBy("cluster", "word").agg(F.sum("n").alias("n"))


def cluster_top_words(tokens: DataFrame, labels: DataFrame, n: int = 10) -> DataFrame:
    return top_n(_cluster_counts(tokens, labels), n, "n", ["cluster"])


def cluster_top_tfidf(tokens: DataFrame, labels: DataFrame, n: int = 7) -> DataFrame:
    """Most discriminating words of each cluster."""
    weighted = bind_tf_idf(_cluster_counts(tokens, labels), "word", "cluster", "n")
    return top_n(weighted, n, "tf_idf", ["cluster"])


def cluster_contrast(centers: DataFrame, clusters: Sequence[int], n: int = 600) -> DataFrame:
    """Terms that stand out in the centre of each cluster."""
    return comparison_scores(centers, "term", "cluster", "mean", n, clusters)
