"""Lexicon sentiment of a corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from wordloom.functions.text import percent_label
from wordloom.operators.loess import loess
from wordloom.operators.prefix import cumulative_pct
from wordloom.operators.sentiment import comparison_scores, sentiment_counts
from wordloom.operators.verbs import count_by, share, slice_max, top_n, zero_fill_totals

# The sentiments shown as series.
SERIES = ("positive", "fear", "trust", "negative")


def sentiment_totals(tokens: DataFrame, lex: DataFrame, n: int = 7) -> DataFrame:
    """Largest sentiments of the whole corpus."""
    return top_n(sentiment_counts(tokens, lex).withColumnRenamed("n", "value"), n, "value")


def modal_sentiment(tokens: DataFrame, lex: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Most frequent sentiment(s) of every chapter → ``book, chapter, sentiment, n``."""
    if exclude:
        lex = lex.where(~F.col("sentiment").isin(*exclude))
    return slice_max(sentiment_counts(tokens, lex, ["book", "chapter"]), "n", ["chapter"])


def sentiment_by_book(tokens: DataFrame, lex: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Share of each modal sentiment among the chapters of a book."""
    modal = count_by(modal_sentiment(tokens, lex, exclude), ["book", "sentiment"])
    return share(modal, "n", ["book"], "sent_perc").orderBy("book", F.desc("sent_perc"), "sentiment")


def lexicon_composition(lex: DataFrame) -> DataFrame:
    """Words per sentiment with percent and running percent, as labels."""
    counts = share(count_by(lex, ["sentiment"]), "n", [], "__p")
    run = cumulative_pct(counts, "n", [F.desc("n"), F.asc("sentiment")], "__c")
    return run.select(
        "sentiment",
        "n",
        percent_label(F.col("__p") * 100, 0).alias("perc"),
        percent_label("__c", 1).alias("cumulative"),
    ).orderBy(F.desc("n"), "sentiment")


def _series(tokens: DataFrame, lex: DataFrame, excluded_volume: str, sentiments: Sequence[str]) -> DataFrame:
    kept = tokens.where(F.col("volume") != excluded_volume)
    return sentiment_counts(kept, lex.where(F.col("sentiment").isin(*sentiments)), ["chapter"])


def sentiment_share(
    tokens: DataFrame, lex: DataFrame, excluded_volume: str, sentiments: Sequence[str] = SERIES
) -> DataFrame:
    """Share of a sentiment among the chosen ones, by chapter."""
    return share(_series(tokens, lex, excluded_volume, sentiments), "n", ["chapter"], "n2")


def sentiment_share_smooth(
    tokens: DataFrame, lex: DataFrame, excluded_volume: str, sentiments: Sequence[str] = SERIES, span: float = 0.75, se: bool = False
) -> DataFrame:
    """``sentiment_share`` smoothed over the chapters, a curve per sentiment."""
    return loess(sentiment_share(tokens, lex, excluded_volume, sentiments), "chapter", "n2", ["sentiment"], span, se=se)


def sentiment_weighted(
    tokens: DataFrame, lex: DataFrame, excluded_volume: str, sentiments: Sequence[str] = SERIES
) -> DataFrame:
    """As ``sentiment_share``, after dividing by each sentiment's total."""
    once = share(_series(tokens, lex, excluded_volume, sentiments), "n", ["sentiment"], "aa")
    return share(once, "aa", ["chapter"], "n2")


def posneg_series(tokens: DataFrame, lex: DataFrame, excluded_volume: str) -> DataFrame:
    return _series(tokens, lex, excluded_volume, ("positive", "negative"))


def sentiment_comparison(
    tokens: DataFrame, lex: DataFrame, categories: Sequence[str], n: int = 500, by: Sequence[str] = ()
) -> DataFrame:
    """Words that stand out in each sentiment, within each group of ``by``."""
    counts = sentiment_counts(tokens.withColumn("term", F.col("word")), lex, [*by, "term"])
    return comparison_scores(counts, "term", "sentiment", "n", n, categories, by)


def zero_filled(df: DataFrame, keys: Sequence[str], sentiments: Sequence[str]) -> DataFrame:
    return zero_fill_totals(df, keys, "sentiment", "n", sentiments).withColumnRenamed("n", "value")
