"""Word statistics of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wordloom.operators.loess import loess
from wordloom.operators.stats import boxplot_stats, histogram
from wordloom.operators.tfidf import bind_tf_idf
from wordloom.operators.tokens import split_ngram
from wordloom.operators.verbs import count_by, group_total, share, top_n, unite


def volume_summary(tokens: DataFrame) -> DataFrame:
    """Chapters and words per volume."""
    chapters = count_by(tokens, ["volume", "chapter"])
    return chapters.groupBy("volume").agg(F.count(F.lit(1)).alias("chapters"), F.sum("n").alias("total_words"))


def words_per_chapter_box(tokens: DataFrame) -> DataFrame:
    """Box-plot of chapter lengths by book.

    A chapter's length appears once for each of its distinct words, which
    weights the quartiles; the repeats are passed on as a weight.
    """
    words = count_by(tokens, ["volume", "book", "chapter", "word"])
    chapters = words.groupBy("volume", "book", "chapter").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("w"))
    lengths = group_total(chapters, "n", ["chapter"], "n_chapter")
    return boxplot_stats(lengths, "n_chapter", ["volume", "book"], weight="w")


def term_freq_hist(tokens: DataFrame, bins: int = 30) -> DataFrame:
    """Distribution of relative term frequencies by volume."""
    shares = share(count_by(tokens, ["volume", "word"]), "n", ["volume"], "freq")
    return histogram(shares, "freq", bins, ["volume"])


def top_words(tokens: DataFrame, n: int = 10) -> DataFrame:
    return top_n(count_by(tokens, ["word"]), n, "n")


def top_words_by_volume(tokens: DataFrame, n: int = 5) -> DataFrame:
    return top_n(count_by(tokens, ["volume", "word"]), n, "n", ["volume"])


def top_bigrams(bigrams: DataFrame, n: int = 10) -> DataFrame:
    return top_n(count_by(bigrams, ["bigram"]), n, "n")


def keyword_stats(tokens: DataFrame, keyword: str) -> DataFrame:
    """Total, mean and sample deviation over books of a word's count, by volume."""
    counts = count_by(tokens.where(F.col("word") == keyword), ["volume", "book"])
    return counts.groupBy("volume").agg(
        F.sum("n").alias("tot"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("sd")
    )


def keyword_series(tokens: DataFrame, keywords: list[str], excluded_volume: str | None = None) -> DataFrame:
    """Counts of words by chapter."""
    kept = tokens.where(F.col("word").isin(*keywords))
    if excluded_volume is not None:
        kept = kept.where(F.col("volume") != excluded_volume)
    return count_by(kept, ["volume", "chapter", "word"])


def keyword_smooth(
    tokens: DataFrame, keywords: list[str], excluded_volume: str | None = None, span: float = 0.75, se: bool = True
) -> DataFrame:
    """``keyword_series`` smoothed over the chapters, a curve per word."""
    return loess(keyword_series(tokens, keywords, excluded_volume), "chapter", "n", ["word"], span, se=se)


def keyword_bigrams(bigrams: DataFrame, keyword: str, n: int = 8) -> DataFrame:
    """Most frequent bigrams with a word on either side."""
    pairs = split_ngram(bigrams.select("bigram"), "bigram", ["w1", "w2"])
    counts = count_by(pairs.where((F.col("w1") == keyword) | (F.col("w2") == keyword)), ["w1", "w2"])
    return unite(top_n(counts, n, "n"), ["w1", "w2"], "bigram")


def tfidf_by_volume(tokens: DataFrame, n: int = 5) -> DataFrame:
    weighted = bind_tf_idf(count_by(tokens, ["volume", "word"]), "word", "volume", "n")
    return top_n(weighted, n, "tf_idf", ["volume"])


def tfidf_unique_count(tokens: DataFrame, n: int = 500) -> DataFrame:
    """How many of the top tf-idf words each volume has."""
    weighted = bind_tf_idf(count_by(tokens, ["volume", "word"]), "word", "volume", "n")
    return count_by(top_n(weighted, n, "tf_idf"), ["volume"])
