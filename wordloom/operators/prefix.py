"""Running totals that no single task has to see as a whole.

``chunked``: the order column is a dense number, so rows fall into fixed chunks
and only one summary row per chunk is carried.  ``running_total``: any sortable
order; a sampled range layout is written once (checkpoint) and carried the same
way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wordloom.operators.verbs import aslist, join_on_keys
from wordloom.session import checkpoint

CHUNK_ROWS = 1 << 16


def _with_chunk(df: DataFrame, order: str, chunk: int) -> DataFrame:
    return df.withColumn("__chunk", F.floor(F.col(order) / F.lit(chunk)))


def running_section(
    df: DataFrame,
    marker: Column,
    order: str,
    by: Sequence[str] = (),
    offset: int = 0,
    out: str = "section",
    chunk: int = CHUNK_ROWS,
) -> DataFrame:
    """Number of marker rows up to and including each row, plus ``offset``."""
    by = aslist(by)
    rows = _with_chunk(df, order, chunk).withColumn(
        "__m", F.when(marker, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    )
    sums = rows.groupBy(*by, "__chunk").agg(F.sum("__m").alias("__s"))
    earlier = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*by, "__chunk", F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__base"))
    local = Window.partitionBy(*by, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("__l", F.sum("__m").over(local))
    joined = join_on_keys(numbered, base, [*by, "__chunk"], null_safe=True)
    return joined.withColumn(out, F.col("__base") + F.col("__l") + F.lit(offset)).drop(
        "__chunk", "__m", "__l", "__base"
    )


def fill_down(
    df: DataFrame, cols: Sequence[str], order: str, by: Sequence[str] = (), chunk: int = CHUNK_ROWS
) -> DataFrame:
    """Replace NULLs by the last value before them."""
    cols, by = aslist(cols), aslist(by)
    rows = _with_chunk(df, order, chunk)
    ends = rows.groupBy(*by, "__chunk").agg(
        *[
            F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__e_{c}")
            for c in cols
        ]
    )
    earlier = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *by, "__chunk", *[F.last(f"__e_{c}", ignorenulls=True).over(earlier).alias(f"__c_{c}") for c in cols]
    )
    local = Window.partitionBy(*by, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumns({f"__l_{c}": F.last(c, ignorenulls=True).over(local) for c in cols})
    joined = join_on_keys(filled, carried, [*by, "__chunk"], null_safe=True)
    return joined.withColumns({c: F.coalesce(F.col(f"__l_{c}"), F.col(f"__c_{c}")) for c in cols}).select(
        *df.columns
    )


def running_total(
    df: DataFrame,
    value: Column,
    order: Sequence[Column],
    by: Sequence[str] = (),
    out: str = "running",
) -> DataFrame:
    """Inclusive running sum of ``value`` in the given order, within ``by``.

    ``order`` should settle every tie.  A hot group spans many range
    partitions; each of them adds its own rows to the sum carried into it.
    """
    by, order = aslist(by), list(order)
    keyed = df.withColumn("__v", value)
    ranged = keyed.repartitionByRange(*[F.col(c).asc_nulls_first() for c in by], *order)
    laid = checkpoint(ranged.withColumn("__part", F.spark_partition_id()))
    sums = laid.groupBy(*by, "__part").agg(F.sum("__v").alias("__s"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*by, "__part", F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__base"))
    local = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = laid.withColumn("__l", F.sum("__v").over(local))
    joined = join_on_keys(numbered, base, [*by, "__part"], null_safe=True)
    return joined.withColumn(out, F.col("__base") + F.col("__l")).drop("__v", "__part", "__l", "__base")


def dense_index(df: DataFrame, order: Sequence[Column], out: str = "idx") -> DataFrame:
    """0, 1, 2 … in the given order."""
    return running_total(df, F.lit(1).cast("bigint"), order, out=out).withColumn(out, F.col(out) - 1)


def cumulative_pct(df: DataFrame, value: str, order: Sequence[Column], out: str = "cumulative") -> DataFrame:
    """Running percentage of the grand total."""
    total = df.agg(F.sum(value)).scalar()
    return running_total(df, F.col(value), order, out="__run").withColumn(
        out, F.col("__run") / total * 100
    ).drop("__run")
