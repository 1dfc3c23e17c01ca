"""Lexicon sentiment and term contrasts between categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from wordloom.operators.pairs import pairwise_count
from wordloom.operators.tfidf import exact_sum
from wordloom.operators.tokens import attach_lexicon
from wordloom.operators.verbs import aslist, attach_totals, tally, top_n


def sentiment_counts(tokens: DataFrame, lex: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Token-sentiment matches per key → ``keys, sentiment, n``.

    Tokens are counted per word before the many-to-many join, so the join sees
    one row per key and word.  ``tokens`` may be counted already: a column ``n``
    says how many tokens a row stands for.  Such rows go to the join as they are
    when there are keys, since counting them again would move them all once more.
    """
    keys = aslist(keys)
    counted = tokens.select(*keys, "word", "n") if keys and "n" in tokens.columns else tally(tokens, [*keys, "word"])
    matched = attach_lexicon(counted, lex)
    return matched.groupBy(*keys, "sentiment").agg(F.sum("n").alias("n"))


def pair_sentiment(
    tokens: DataFrame, lex: DataFrame, item: str, feature: str, by: Sequence[str] = (), items: Sequence | None = None
) -> DataFrame:
    """Pair counts with the sentiments of the second item.

    With ``items``, only rows of these and of the lexicon's words can give a row, so no others are paired.
    """
    if items is not None:
        felt = lex.select(F.col("word").alias(item)).distinct().withColumn("__felt", F.lit(True))
        # the join leaves the rows in place by item, so telling presence rows apart moves nothing
        marked = tokens.select(*dict.fromkeys([*by, feature, item])).join(felt, item, "left")
        tokens = marked.where(F.col("__felt").isNotNull() | F.col(item).isin(*items)).drop("__felt")
    return attach_lexicon(pairwise_count(tokens, item, feature, by=by, items=items), lex, on="item2")


def comparison_scores(
    df: DataFrame, term: str, category: str, n: str, max_words: int, categories: Sequence, by: Sequence[str] = ()
) -> DataFrame:
    """Terms that stand out in a category → ``[by,] term, category, weight``.

    Each category's counts become proportions; a term's weight is its largest
    excess over its mean proportion across the listed categories (absent ones
    count 0).  The ``max_words`` largest weights are returned, ties kept; all
    of this within each group of ``by``.  Of categories with the same proportion
    the one listed first counts.
    """
    by = list(by)
    summed = df.groupBy(*by, term, category).agg(F.sum(n).alias("__n"))
    shares = attach_totals(summed, [*by, category], __t=exact_sum("__n").cast("double")).withColumn(
        "__p", F.col("__n") / F.col("__t")
    )
    cols = [f"__p{i}" for i in range(len(categories))]
    wide = shares.groupBy(*by, term).agg(
        *[
            F.coalesce(F.max(F.when(F.col(category) == c, F.col("__p"))), F.lit(0.0)).alias(x)
            for c, x in zip(categories, cols)
        ]
    )
    mean = sum((F.col(c) for c in cols), F.lit(0.0)) / F.lit(float(len(cols)))
    best = F.greatest(*cols) if len(cols) > 1 else F.col(cols[0])
    which = None
    for c, x in zip(categories, cols):
        hit = F.col(x) == best
        which = F.when(hit, F.lit(c)) if which is None else which.when(hit, F.lit(c))
    scored = wide.select(*by, term, which.alias(category), F.round(best - mean, 12).alias("weight"))
    return top_n(scored, max_words, "weight", by=by)
