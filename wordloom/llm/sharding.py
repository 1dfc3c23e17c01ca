"""Shards by extendible hashing, with DataFrame functions only.

A document's hash is the first 60 bits of its id's md5.  The directory starts with one bucket; only a bucket over the byte
limit is split, on the next bit of the hash.  Buckets are found from the sums of a few levels at once: the documents'
bytes are added up in fine cells, the cells give the sums of all their ancestors, and each cell takes its first ancestor
that fits.  Documents of cells that are still too large go on with the next bits alone.  So the documents are read once,
what is shuffled is (id, hash, bytes), and the directory has about as many rows as there are shards.

A bucket whose documents all have one hash can't be split and stays over the limit: one document larger than the limit,
or rows that repeat an id.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from wordloom.llm.common import pinned

HASH_BITS = 60
STEP = 4


def _fits(limit: int):
    return (F.col("shard_bytes") <= limit) | (F.col("low") == F.col("high"))


def assign_shards(docs: DataFrame, limit: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, bytes, shard_depth, shard_prefix, shard_bytes, shard_docs`` of every row.

    ``shard_prefix`` are the first ``shard_depth`` bits of the hash.  Null texts have 0 bytes; rows with a null id share
    the hash of the empty string; repeated rows are all kept, in one shard.  ``limit`` is in bytes, at least 1 (ValueError).
    """
    if limit < 1:
        raise ValueError("the limit of a shard must be at least one byte")
    name = F.coalesce(F.col(id).cast("string"), F.lit(""))
    rows = pinned(
        docs.select(
            F.col(id).alias("doc_id"),
            F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"),
            F.conv(F.substring(F.md5(name), 1, HASH_BITS // 4), 16, 10).cast("long").alias("hash"),
        )
    )
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    base, depth = 0, min(HASH_BITS, STEP + math.ceil(math.log2(max(1, total / limit))))
    done = None
    while True:
        # Levels base to depth: a cell is the first ``depth`` bits.
        cell = F.expr(f"hash div {1 << (HASH_BITS - depth)}")
        cells = rows.groupBy(cell.alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.count("*").alias("docs"), F.min("hash").alias("low"), F.max("hash").alias("high")
        )
        cells = cells.withColumn("level", F.explode(F.sequence(F.lit(base), F.lit(depth))))
        cells = pinned(cells.withColumn("prefix", F.expr(f"cell div cast(pow(2, {depth} - level) AS long)")))
        nodes = cells.groupBy("level", "prefix").agg(
            F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"), F.min("low").alias("low"), F.max("high").alias("high")
        )
        fit = cells.select("cell", "level", "prefix").join(nodes.where(_fits(limit)), ["level", "prefix"])
        pick = fit.groupBy("cell").agg(F.min_by(F.struct("level", "prefix", "shard_bytes", "shard_docs"), "level").alias("shard"))
        placed = pinned(rows.withColumn("cell", cell).join(pick, "cell", "left"))
        out = placed.where("shard IS NOT NULL").select(
            "doc_id", "bytes", F.col("shard.level").alias("shard_depth"), F.col("shard.prefix").alias("shard_prefix"),
            "shard.shard_bytes", "shard.shard_docs",
        )
        done = out if done is None else done.unionByName(out)
        rows = placed.where("shard IS NULL").select("doc_id", "bytes", "hash")
        if rows.isEmpty():
            return done
        base, depth = depth + 1, min(HASH_BITS, depth + STEP)


def write_shards(docs: DataFrame, limit: int, path: str, id: str = "doc_id", text: str = "text", folder: str = "shard") -> None:
    """Write every shard as a folder ``<folder>=<depth>-<prefix>`` of parquet files with all columns of the rows.

    Rows with a null id share the hash of the empty string; rows that repeat an id are all written, to one shard.  A table
    with a column named like the folder is refused (ValueError): choose another name.
    """
    if folder in docs.columns:
        raise ValueError(f"the table has a column {folder!r}: name the folders otherwise")
    key = next(f"__id{k}" for k in range(len(docs.columns) + 1) if f"__id{k}" not in docs.columns)
    shard = F.concat_ws("-", "shard_depth", "shard_prefix").alias(folder)
    placed = assign_shards(docs, limit, id, text).select(F.col("doc_id").alias(key), shard).distinct()
    joined = docs.join(placed, F.col(id).eqNullSafe(F.col(key))).drop(key)
    joined.repartition(folder).write.partitionBy(folder).parquet(path)
