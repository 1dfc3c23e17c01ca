"""Word and n-gram tokens and their clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from wordloom.functions.text import ngrams_of, without_possessive, words_of
from wordloom.operators.verbs import aslist, unite


TEXT_PARTS = 8  # partitions by key for one input split


def _kept(df: DataFrame, text: str, keep) -> list[str]:
    return [c for c in df.columns if c != text] if keep is None else aslist(keep)


def tokenize_words(
    df: DataFrame, text: str, out: str = "word", keep: Sequence[str] | None = None, normalize_apostrophes: bool = False
) -> DataFrame:
    """One row per word; no shuffle."""
    return df.select(*_kept(df, text, keep), F.explode(words_of(text, normalize_apostrophes)).alias(out))


def tokenize_ngrams(
    df: DataFrame,
    text: str,
    n: int = 2,
    out: str = "bigram",
    keep: Sequence[str] | None = None,
    normalize_apostrophes: bool = False,
) -> DataFrame:
    """One row per run of ``n`` words of a text; shorter texts give no row."""
    words = df.select(*_kept(df, text, keep), words_of(text, normalize_apostrophes).alias("__words"))
    return words.select(*_kept(df, text, keep), F.explode(ngrams_of(F.col("__words"), n)).alias(out))


def split_ngram(df: DataFrame, col: str, into: Sequence[str], sep: str = " ") -> DataFrame:
    """Split a column into several, in place of it."""
    parts = F.split(F.col(col), sep)
    cols = []
    for c in df.columns:
        cols += [F.get(parts, F.lit(i)).alias(name) for i, name in enumerate(into)] if c == col else [F.col(c)]
    return df.select(*cols)


def remove_words(tokens: DataFrame, lex: DataFrame | Sequence[str], on: str = "word") -> DataFrame:
    """Drop tokens found in a lexicon (NULL tokens stay).

    A Python list becomes a filter; a table becomes an anti-join whose strategy
    Spark picks by the table's size.
    """
    if isinstance(lex, DataFrame):
        col = "word" if "word" in lex.columns else lex.columns[0]
        return tokens.join(lex.select(F.col(col).alias(on)), on, "left_anti")
    return tokens.where(~F.coalesce(F.col(on).isin(*lex), F.lit(False)))


def attach_lexicon(tokens: DataFrame, lex: DataFrame, on: str = "word") -> DataFrame:
    """Inner join with a many-to-many lexicon keyed by ``word``."""
    return tokens.join(lex.withColumnRenamed("word", on), on)


def strip_possessive(df: DataFrame, cols: Sequence[str] | str, normalize_apostrophes: bool = False) -> DataFrame:
    return df.withColumns({c: without_possessive(c, normalize_apostrophes) for c in aslist(cols)})


def gather_texts(df: DataFrame, key: str) -> DataFrame:
    """The rows of one key in one partition: counts by that key and word then move texts, not words.

    A text is far smaller than its rows of words with their keys.  The number of partitions follows the number of input
    splits and stays as it is, so that a task holds the words of some MB of text.  The rows of one key meet in one task,
    so keys should be those of documents, not of large groups.
    """
    splits = df.rdd.getNumPartitions()
    return df.repartition(max(TEXT_PARTS * splits, df.sparkSession.sparkContext.defaultParallelism), key)


def clean_tokens(
    df: DataFrame,
    text: str,
    stop_words: DataFrame | Sequence[str],
    keys: Sequence[str],
    normalize_apostrophes: bool = False,
) -> DataFrame:
    """Words without stop words, possessives stripped afterwards → ``keys, word``.

    The order is part of the result: ``it’s`` is no stop word, and becomes
    ``it`` after the stop words are gone.  Lines need not be collapsed first,
    since no word crosses a line.  With ``normalize_apostrophes`` the text's
    ``’`` is read as ``'`` first.
    """
    words = tokenize_words(df, text, keep=keys, normalize_apostrophes=normalize_apostrophes)
    kept = remove_words(words, stop_words)
    return strip_possessive(kept, "word", normalize_apostrophes).select(*aslist(keys), "word")


def clean_bigrams(
    df: DataFrame,
    text: str,
    stop_words: DataFrame | Sequence[str],
    keys: Sequence[str],
    normalize_apostrophes: bool = False,
) -> DataFrame:
    """Bigrams without stop words on either side → ``keys, bigram``; apostrophes as in ``clean_tokens``."""
    ngrams = tokenize_ngrams(df, text, 2, keep=keys, normalize_apostrophes=normalize_apostrophes)
    pairs = split_ngram(ngrams, "bigram", ["w1", "w2"])
    for side in ("w1", "w2"):
        pairs = remove_words(pairs, stop_words, on=side)
    stripped = strip_possessive(pairs, "w2", normalize_apostrophes)
    return unite(stripped, ["w1", "w2"], "bigram").select(*aslist(keys), "bigram")
