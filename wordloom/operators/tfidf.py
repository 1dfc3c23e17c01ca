"""Term weighting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wordloom.operators.verbs import join_on_keys
from wordloom.session import checkpoint


def bind_tf_idf(df: DataFrame, term: str, document: str, n: str) -> DataFrame:
    """Add ``tf``, ``idf`` and ``tf_idf`` to a table of counts.

    ``idf = ln(documents / rows of the term)``: the denominator counts rows, so
    a term with several rows per document can get a negative idf.

    The counts and both tables of totals are stored: whatever made the counts runs
    once, and a join knows the size of its totals before it moves the counts.
    """
    df = checkpoint(df)
    documents = df.agg(F.count_distinct(document)).scalar()
    totals = checkpoint(df.groupBy(document).agg(F.sum(n).alias("__total")))
    rows = checkpoint(df.groupBy(term).agg(F.count(F.lit(1)).alias("__rows")))
    weighted = join_on_keys(df, totals, [document], "left", null_safe=True)
    weighted = join_on_keys(weighted, rows, [term], "left", null_safe=True)
    return (
        weighted.withColumn("tf", F.try_divide(F.col(n), F.col("__total")))
        .withColumn("idf", F.ln(documents / F.col("__rows")))
        .withColumn("tf_idf", F.col("tf") * F.col("idf"))
        .drop("__total", "__rows")
    )


def exact_sum(col: Column | str) -> Column:
    """Sum of doubles that does not depend on the order of the rows."""
    col = F.col(col) if isinstance(col, str) else col
    return F.sum(col.cast("decimal(38,15)"))
