"""Graph tables out of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def graph_tables(edges: DataFrame, src: str, dst: str) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)``: nodes are the distinct end points with their degrees."""
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.col(src).alias("name"), F.lit(1).cast("bigint").alias("o"), F.lit(0).cast("bigint").alias("i")),
                F.struct(F.col(dst).alias("name"), F.lit(0).cast("bigint").alias("o"), F.lit(1).cast("bigint").alias("i")),
            )
        )
    )
    nodes = ends.groupBy("name").agg(
        F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count(F.lit(1)).alias("degree")
    )
    return nodes, edges
