"""Document-term matrices: long tables, pruning, and sparse vectors."""

from __future__ import annotations

import uuid

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DataType, StructField, StructType

from wordloom.operators.prefix import dense_index
from wordloom.operators.verbs import count_by
from wordloom.session import ensure_checkpoint_dir


def dtm(tokens: DataFrame, document: str, term: str) -> DataFrame:
    """Term counts per document → ``document, term, n``."""
    counts = count_by(tokens, [document, term])
    return counts.select(F.col(document).alias("document"), F.col(term).alias("term"), "n")


def tidy_dtm(matrix: DataFrame) -> DataFrame:
    """The non-zero cells as ``document, term, count``."""
    return matrix.where(F.col("n") != 0).select("document", "term", F.col("n").alias("count"))


def prune_sparse(matrix: DataFrame, sparse: float) -> DataFrame:
    """Keep terms found in more than ``documents · (1 - sparse)`` documents.

    ``matrix`` holds one row per document and term.
    """
    # the same filter on every branch lets them share one shuffle of the counts
    cells = matrix.where(F.col("n") > 0)
    documents = cells.agg(F.count_distinct("document")).scalar()
    held = cells.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    kept = held.where(F.col("df") > documents * F.lit(1.0 - sparse)).select("term")
    return cells.join(kept, "term", "left_semi").select("document", "term", "n")


def vocabulary(matrix: DataFrame, col: str = "term") -> DataFrame:
    """Distinct terms with a dense index in their sort order → ``term, idx``."""
    return dense_index(matrix.select(col).distinct(), [F.asc(col)]).select(
        col, F.col("idx").cast("int").alias("idx")
    )


def row_arrays(
    matrix: DataFrame, row: str, col: str, value: str, vocab: DataFrame, rows: DataFrame | None = None
) -> DataFrame:
    """One row per matrix row → ``row, idx, val`` (parallel arrays in index order).

    A row's arrays are at most as long as the vocabulary, however many tokens
    stand behind them.  ``rows`` lists row keys to keep even without cells.
    """
    cells = matrix.join(vocab, col).groupBy(row, "idx").agg(F.sum(F.col(value).cast("double")).alias("val"))
    packed = cells.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("idx", "val"))).alias("cells"))
    if rows is not None:
        packed = rows.select(row).distinct().join(packed, row, "left")
    return packed.select(
        row,
        F.coalesce("cells.idx", F.array().cast("array<int>")).alias("idx"),
        F.coalesce("cells.val", F.array().cast("array<double>")).alias("val"),
    )


def vector_column(size, udt: DataType | None = None):
    """Sparse ML vector out of ``idx`` and ``val`` arrays, inside the JVM.

    The vector type's stored form is a plain struct, so the JSON reader can
    build it without a Python function per row.
    """
    stored = F.struct(F.lit(0).alias("type"), size.alias("size"), F.col("idx").alias("indices"), F.col("val").alias("values"))
    schema = StructType([StructField("v", udt or VectorUDT())])
    return F.from_json(F.to_json(F.struct(stored.alias("v"))), schema)["v"]


def to_vectors(
    matrix: DataFrame,
    row: str = "document",
    col: str = "term",
    value: str = "n",
    vocab: DataFrame | None = None,
    rows: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(vectors, vocabulary)``: sparse vectors named ``features`` by row."""
    vocab = vocabulary(matrix, col) if vocab is None else vocab
    size = vocab.agg(F.count(F.lit(1)).cast("int")).scalar()
    arrays = row_arrays(matrix, row, col, value, vocab, rows)
    return arrays.select(row, vector_column(size).alias("features")), vocab


def stored_vectors(
    matrix: DataFrame,
    row: str = "document",
    col: str = "term",
    value: str = "n",
    vocab: DataFrame | None = None,
    rows: DataFrame | None = None,
) -> DataFrame:
    """Sparse vectors named ``features`` by row, as a table in the checkpoint folder in a layout that does not change.

    The vector type's stored form is a plain struct: it is written as such and read with the vector type, so no number is
    printed and parsed.
    """
    spark = matrix.sparkSession
    vocab = vocabulary(matrix, col) if vocab is None else vocab
    size = vocab.agg(F.count(F.lit(1)).cast("int")).scalar()
    arrays = row_arrays(matrix, row, col, value, vocab, rows).repartition(row).sortWithinPartitions(row)
    stored = F.struct(F.lit(0).cast("tinyint").alias("type"), size.alias("size"), F.col("idx").alias("indices"), F.col("val").alias("values"))
    plain = arrays.select(row, stored.alias("features"))
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    plain.write.parquet(path)
    return spark.read.schema(StructType([plain.schema[row], StructField("features", VectorUDT())])).parquet(path)
