"""Text sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed value: the two numbers in a document's file name.
FILE_KEY_PATTERN = r"book_(\d+)_chapter_(\d+)"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table, spread over the cores when the files are few.

    A small table in one row group would be read, and then tokenised, by one
    task.  A large table has many splits and is left as it is: no shuffle.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < min(cores, 32):
        return df.repartition(cores)
    return df


def keys_from_name(name: Column | str, pattern: str = FILE_KEY_PATTERN) -> list[Column]:
    """``book`` and ``chapter`` numbers out of a path; NULL when absent."""
    return [
        F.regexp_extract(name, pattern, i).try_cast("int").alias(out)
        for i, out in ((1, "book"), (2, "chapter"))
    ]


def read_documents(spark: SparkSession, glob: str, key_pattern: str | None = FILE_KEY_PATTERN) -> DataFrame:
    """Each text file is one document: ``path [, book, chapter], text``."""
    raw = spark.read.text(glob, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )
    if key_pattern is None:
        return raw
    return raw.select("path", *keys_from_name("path", key_pattern), "text")


def read_lexicon(spark: SparkSession, path: str, word: str = "word", *more: str) -> DataFrame:
    """A stop-word or sentiment table from a CSV file or folder with a header, or from Parquet: distinct rows of the
    named columns, words in lower case; rows without a word go."""
    rows = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).csv(path)
    return rows.where(F.col(word).isNotNull()).select(F.lower(word).alias(word), *more).distinct()


def to_lines(df: DataFrame, id: Sequence[str] | str, text: str = "text") -> DataFrame:
    """One row per line with an explicit ``line_no`` from 0."""
    ids = [id] if isinstance(id, str) else list(id)
    return df.select(*ids, F.posexplode(F.split(text, "\n")).alias("line_no", text)).withColumn(
        "line_no", F.col("line_no").cast("bigint")
    )


def write_text_by_key(df: DataFrame, keys: Sequence[str], text: str, path: str) -> None:
    """Texts under one folder per key (``path/key=value/…``)."""
    keys = list(keys)
    df.select(*keys, text).write.partitionBy(*keys).text(path)


def meta_lookup(df: DataFrame, title_col: str, title: str, id_col: str) -> DataFrame:
    """The id of a titled work in a catalogue table."""
    return df.where(F.col(title_col) == title).select(id_col)


def save_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Write named tables as one snapshot folder."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")


def load_tables(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """Read the named tables of a snapshot."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
