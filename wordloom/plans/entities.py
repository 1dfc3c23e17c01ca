"""Named words (people, places) in a corpus: counts, company, moods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from wordloom.operators.pairs import pairwise_cor
from wordloom.operators.sentiment import pair_sentiment, sentiment_counts
from wordloom.operators.tokens import split_ngram
from wordloom.operators.verbs import count_by, share, top_n, zero_fill_totals
from wordloom.session import checkpoint


def entity_counts(tokens: DataFrame, entities: Sequence[str]) -> DataFrame:
    return count_by(tokens.where(F.col("word").isin(*entities)), ["word"], sort=True)


def entity_series(tokens: DataFrame, entities: Sequence[str]) -> DataFrame:
    return count_by(tokens.where(F.col("word").isin(*entities)), ["word", "chapter"])


def entity_volume_share(tokens: DataFrame, entities: Sequence[str]) -> DataFrame:
    """How an entity's mentions fall on the volumes."""
    counts = count_by(tokens.where(F.col("word").isin(*entities)), ["word", "volume"], name="count")
    return share(counts, "count", ["word"], "perc")


def entity_next_words(bigrams: DataFrame, entities: Sequence[str], n: int = 5) -> DataFrame:
    """Most frequent words right after an entity, with a short tag."""
    pairs = split_ngram(bigrams.select("bigram"), "bigram", ["w1", "w2"]).where(F.col("w1").isin(*entities))
    top = top_n(count_by(pairs, ["w1", "w2"]), n, "n", ["w1"])
    tag = F.concat(F.upper(F.substring("w1", 1, 1)), F.lit("."))
    return top.withColumn("w3", tag).orderBy(F.desc("n"), "w1", "w2")


def bigram_series(bigrams: DataFrame, chosen: Sequence[str]) -> DataFrame:
    return count_by(bigrams.where(F.col("bigram").isin(*chosen)), ["bigram", "chapter"])


def bigram_graph(bigrams: DataFrame, more_than: int = 50) -> DataFrame:
    """Edges between words that follow each other often."""
    pairs = split_ngram(bigrams.select("bigram"), "bigram", ["w1", "w2"])
    return count_by(pairs, ["w1", "w2"]).where(F.col("n") > more_than)


def _frequent(tokens: DataFrame, min_n: int, excluded_volume: str | None) -> DataFrame:
    """Chapters of frequent words, a row each; frequency is counted before a volume is left out.

    The texts are tokenised once: words are counted by chapter, and the totals are those counts' sums.
    """
    counts = checkpoint(count_by(tokens, ["volume", "chapter", "word"]))
    frequent = counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_n).select("word")
    kept = counts.join(frequent, "word", "left_semi")
    return kept if excluded_volume is None else kept.where(F.col("volume") != excluded_volume)


def cor_graph(tokens: DataFrame, above: float = 0.48, min_n: int = 50) -> DataFrame:
    """Edges between frequent words with correlated presence."""
    return pairwise_cor(_frequent(tokens, min_n, None), "word", "chapter", above=above)


def ego_graph(tokens: DataFrame, entities: Sequence[str], above: float = 0.27, min_n: int = 50) -> DataFrame:
    """The correlation edges of chosen words."""
    pairs = pairwise_cor(_frequent(tokens, min_n, None), "word", "chapter", items=entities)
    return pairs.where(F.col("correlation") > above)


def entity_top_cor(
    tokens: DataFrame, entities: Sequence[str], n: int = 20, min_n: int = 50, excluded_volume: str | None = None
) -> DataFrame:
    """Most correlated words of each entity."""
    pairs = pairwise_cor(_frequent(tokens, min_n, excluded_volume), "word", "chapter", items=entities)
    return top_n(pairs, n, "correlation", ["item1"])


def entity_bottom_cor(
    tokens: DataFrame, entities: Sequence[str], n: int = 7, min_n: int = 50, excluded_volume: str | None = None
) -> DataFrame:
    """Least correlated words of each entity, never-met ones included."""
    pairs = pairwise_cor(_frequent(tokens, min_n, excluded_volume), "word", "chapter", dense=True, items=entities)
    return top_n(pairs, -n, "correlation", ["item1"])


def entity_sentiment(
    tokens: DataFrame, lex: DataFrame, entities: Sequence[str], sentiments: Sequence[str], n: int = 5
) -> DataFrame:
    """Sentiments of the words that share chapters with an entity, relative to
    the sentiments of the whole corpus."""
    pairs = pair_sentiment(tokens, lex, "word", "chapter", items=entities)
    totals = zero_fill_totals(pairs, ["item1"], "sentiment", "n", sentiments).withColumnRenamed("n", "value")
    joined = totals.join(sentiment_counts(tokens, lex), "sentiment", "left")
    return top_n(joined.withColumn("perc", F.try_divide(F.col("value"), F.col("n"))), n, "perc", ["item1"])


def entity_section_sentiment(
    tokens: DataFrame, lex: DataFrame, entities: Sequence[str], sentiments: Sequence[str]
) -> DataFrame:
    """Sentiment words met by an entity in each chapter → ``ch, item1, sentiment, value``."""
    kept = lex.where(F.col("sentiment").isin(*sentiments))
    rows = tokens.select(F.col("chapter").alias("ch"), "chapter", "word")
    pairs = pair_sentiment(rows, kept, "word", "chapter", by=["ch"], items=entities)
    filled = zero_fill_totals(pairs, ["ch", "item1"], "sentiment", "n", sentiments)
    return filled.withColumnRenamed("n", "value")


def entity_section_sentiment_share(
    tokens: DataFrame, lex: DataFrame, entities: Sequence[str], sentiments: Sequence[str]
) -> DataFrame:
    """Share among all entities and sentiments of a chapter."""
    return share(entity_section_sentiment(tokens, lex, entities, sentiments), "value", ["ch"], "perc")


def entity_section_sentiment_weighted(
    tokens: DataFrame, lex: DataFrame, entities: Sequence[str], sentiments: Sequence[str], before: int | None = None
) -> DataFrame:
    """Share within chapter and entity, after dividing by sentiment totals."""
    counts = entity_section_sentiment(tokens, lex, entities, sentiments)
    if before is not None:
        counts = counts.where(F.col("ch") < before)
    return share(share(counts, "value", ["sentiment"], "val_perc"), "val_perc", ["ch", "item1"], "perc")
