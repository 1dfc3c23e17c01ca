"""Distribution summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wordloom.operators.prefix import running_total
from wordloom.operators.verbs import aslist, attach_totals, join_on_keys
from wordloom.session import checkpoint


def histogram(df: DataFrame, x: str, bins: int = 30, facet: Sequence[str] = ()) -> DataFrame:
    """Equal-width, right-closed bins shared by all facets; the first is centred
    on the minimum → ``facet, bin, center, n`` (empty bins give no row)."""
    facet = aslist(facet)
    lo, hi = df.agg(F.min(x)).scalar(), df.agg(F.max(x)).scalar()
    rows = df.where(F.col(x).isNotNull()).withColumn("__lo", lo.cast("double"))
    width = (hi.cast("double") - F.col("__lo")) / (bins - 1)
    rows = rows.withColumn("__w", F.when(width > 0, width).otherwise(F.lit(0.1)))
    at = F.ceil((F.col(x) - (F.col("__lo") - F.col("__w") / 2)) / F.col("__w"))
    return (
        rows.withColumn("bin", at)
        .groupBy(*facet, "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.first("__lo").alias("__lo"), F.first("__w").alias("__w"))
        .select(*facet, "bin", (F.col("__lo") + (F.col("bin") - 1) * F.col("__w")).alias("center"), "n")
    )


def _at_rank(value: str, rank: Column) -> Column:
    """The value at a 0-based rank, given ``__c`` (rows so far) and ``__n``."""
    hit = (F.col("__c") > rank) & (F.col("__c") - F.col("__n") <= rank)
    return F.max(F.when(hit, F.col(value)))


def _value_counts(df: DataFrame, y: str, keys: list[str], weight: str | None) -> DataFrame:
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.where(F.col(y).isNotNull()).groupBy(*keys, y).agg(rows.alias("__n"))


def quantiles(
    df: DataFrame,
    y: str,
    keys: Sequence[str] = (),
    probs: Sequence[float] = (0.25, 0.5, 0.75),
    weight: str | None = None,
) -> DataFrame:
    """Exact interpolated quantiles ``q0, q1, …`` per key, at any group size.

    Values are collapsed to counts, put in order by range, and every quantile
    is read off the running count; no group is held in memory.  ``weight`` says
    how many rows a row stands for.
    """
    keys = aslist(keys)
    counted = _value_counts(df, y, keys, weight)
    ranked = running_total(counted, F.col("__n"), [F.col(y).asc()], by=keys, out="__c")
    ranked = attach_totals(ranked, keys, __t=F.sum("__n"))
    aggs = []
    for i, p in enumerate(probs):
        place = (F.col("__t") - 1) * F.lit(float(p))
        aggs += [
            _at_rank(y, F.floor(place)).alias(f"__lo{i}"),
            _at_rank(y, F.ceil(place)).alias(f"__hi{i}"),
            F.max(place - F.floor(place)).alias(f"__f{i}"),
        ]
    return ranked.groupBy(*keys).agg(*aggs).select(
        *keys,
        *[
            (F.col(f"__lo{i}") + F.col(f"__f{i}") * (F.col(f"__hi{i}") - F.col(f"__lo{i}"))).alias(f"q{i}")
            for i in range(len(probs))
        ],
    )


def boxplot_stats(
    df: DataFrame, y: str, keys: Sequence[str] = (), approx: bool = False, weight: str | None = None
) -> DataFrame:
    """Quartiles, whisker ends, outlier and row counts per key.

    Whiskers reach to the last values within 1.5 interquartile ranges.
    ``approx`` takes the quartiles from a sketch, in one pass.  ``weight`` says
    how many rows a row stands for (exact quartiles only).
    """
    keys = aslist(keys)
    if approx and weight is not None:
        raise ValueError("weights need exact quartiles")
    counted = checkpoint(_value_counts(df, y, keys, weight))
    if approx:
        sketch = F.percentile_approx(y, [0.25, 0.5, 0.75], 10000)
        quart = df.groupBy(*keys).agg(sketch.alias("__q")).select(
            *keys, *[F.col("__q")[i].cast("double").alias(f"q{i}") for i in range(3)]
        )
    else:
        quart = quantiles(counted, y, keys, weight="__n")
    if keys:
        joined = join_on_keys(counted, quart, keys, null_safe=True)
    else:
        joined = counted.withColumns({f"q{i}": quart.select(f"q{i}").scalar() for i in range(3)})
    reach = 1.5 * (F.col("q2") - F.col("q0"))
    low, high = F.col("q0") - reach, F.col("q2") + reach
    value = F.col(y)
    return joined.groupBy(*keys).agg(
        F.max("q0").alias("q1"),
        F.max("q1").alias("median"),
        F.max("q2").alias("q3"),
        F.min(F.when(value >= low, value)).alias("whisker_low"),
        F.max(F.when(value <= high, value)).alias("whisker_high"),
        F.sum(F.when((value < low) | (value > high), F.col("__n")).otherwise(0)).alias("outliers"),
        F.sum("__n").alias("n"),
    )
