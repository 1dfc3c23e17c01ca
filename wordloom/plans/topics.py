"""Reports on topic tables (``topic, term, beta`` and ``document, topic, gamma``).

They accept any tables of that shape, fitted or given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from wordloom.functions.text import percent_label
from wordloom.operators.stats import boxplot_stats
from wordloom.operators.tfidf import bind_tf_idf
from wordloom.operators.tokens import attach_lexicon
from wordloom.operators.verbs import count_by, group_total, join_argmax, renamed_join, share, tally, top_n


def doc_top_topic(gamma: DataFrame) -> DataFrame:
    """Main topic(s) of each document."""
    return top_n(gamma, 1, "gamma", ["document"])


def topic_terms(beta: DataFrame, n: int = 15) -> DataFrame:
    return top_n(beta, n, "beta", ["topic"])


def topic_by_group(gamma: DataFrame, sections: DataFrame, group: str, more_than: int) -> DataFrame:
    """Main topics of a book or volume with their share; rare ones are left out
    before the shares are taken."""
    placed = renamed_join(doc_top_topic(gamma), sections.select("chapter", group), {"document": "chapter"})
    counts = count_by(placed, [group, "topic"]).where(F.col("n") > more_than)
    return share(counts, "n", [group], "topic_perc").orderBy(group, F.desc("topic_perc"), "topic")


def gamma_box(gamma: DataFrame, sections: DataFrame) -> DataFrame:
    placed = renamed_join(gamma, sections.select("chapter", "volume"), {"document": "chapter"})
    return boxplot_stats(placed, "gamma", ["topic", "volume"])


def topic_tfidf(gamma: DataFrame, tokens: DataFrame, n: int = 7) -> DataFrame:
    """Typical words of the documents of a topic.

    The main topic is picked before the tokens are joined; rows stay per
    document, so the idf counts (topic, word, document) rows.
    """
    words = tally(tokens, ["chapter", "word"])
    placed = renamed_join(doc_top_topic(gamma).drop("gamma"), words, {"document": "chapter"})
    weighted = bind_tf_idf(placed.select("topic", "word", "document", "n"), "word", "topic", "n")
    return top_n(weighted, n, "tf_idf", ["topic"])


def _term_sentiments(beta: DataFrame, lex: DataFrame, terms: int) -> DataFrame:
    top = top_n(beta, terms, "beta", ["topic"])
    return count_by(attach_lexicon(top.withColumnRenamed("term", "word"), lex), ["topic", "sentiment"])


def topic_sentiment(beta: DataFrame, lex: DataFrame, terms: int = 300, n: int = 4) -> DataFrame:
    """Most frequent sentiments among the top terms of a topic."""
    return top_n(_term_sentiments(beta, lex, terms), n, "n", ["topic"])


def topic_sentiment_share(beta: DataFrame, lex: DataFrame, terms: int = 300, n: int = 4) -> DataFrame:
    """As above, by a topic's share in each sentiment."""
    shares = share(_term_sentiments(beta, lex, terms), "n", ["sentiment"], "sent_perc")
    return top_n(shares, n, "sent_perc", ["topic"])


def sentiment_topics(beta: DataFrame, lex: DataFrame, terms: int = 500, n: int = 4) -> DataFrame:
    """Topics that carry a sentiment most."""
    top = top_n(_term_sentiments(beta, lex, terms), n, "n", ["sentiment"])
    return top.withColumn("sent1", F.substring("sentiment", 1, 3))


def topic_book_sentiment(
    tokens: DataFrame,
    beta: DataFrame,
    lex: DataFrame,
    topics: Sequence[int],
    sentiments: Sequence[str],
    excluded_volume: str,
    min_beta: float = 0.0025,
    min_n: float = 1.25,
) -> DataFrame:
    """Sentiments of a topic's stronger words, by book."""
    counts = tally(tokens.where(F.col("volume") != excluded_volume), ["volume", "book", "chapter", "word"])
    strong = beta.where(F.col("topic").isin(*topics) & (F.col("beta") > min_beta))
    words = renamed_join(counts.where(F.col("n") > min_n), strong, {"word": "term"})
    felt = attach_lexicon(words, lex.where(F.col("sentiment").isin(*sentiments)))
    found = count_by(felt, ["topic", "book", "sentiment"])
    totals = group_total(found, "n", ["topic", "book"], "tot_sents")
    return totals.withColumn("sent_perc", F.col("n") / F.col("tot_sents"))


def topic_summary(gamma: DataFrame, sections: DataFrame, above: float = 0.15) -> DataFrame:
    """Documents with a topic: number, percent of all documents, largest volume
    count and its volume(s)."""
    documents = gamma.agg(F.count_distinct("document")).scalar()
    placed = renamed_join(
        gamma.where(F.col("gamma") > above), sections.select("chapter", "volume"), {"document": "chapter"}
    )
    counts = count_by(placed, ["volume", "topic"])
    totals = counts.groupBy("topic").agg(F.sum("n").alias("tot"), F.max("n").alias("max"))
    totals = totals.withColumn("perc_tot", percent_label(F.col("tot") / documents * 100, 1))
    return join_argmax(totals, counts, ["topic"], "n").drop("n").orderBy(F.desc("tot"), "topic", "volume")
