"""Token ids as patched frame-of-reference files.

Texts are dealt into ranges of ascending ids and encoded; a range is written as shards, one row of a table each (Spark
writes and commits them, so a lost executor leaves no half-written shard and any store will do).  A shard's payload:

    header        magic, block size, numbers of documents, ids, blocks and exceptions (six unsigned 32-bit)
    documents     id (int64) and number of ids (uint32) of each
    blocks        minimum (uint32), where its packed words start (uint32), width (uint8), number of exceptions (uint8)
    exceptions    position in its block (uint8) and difference to the minimum (uint32) of each, in block order
    packed        128 differences of each block at its width, in 64-bit words

The width of a block is the number of bits that 90 % of its differences fit into; the others are exceptions.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from wordloom.llm.common import crc_of, map_batches, partitions, pinned
from wordloom.llm.encode import encoded

BLOCK = 128
MAGIC = 0x524F4650
HEADER = struct.Struct("<6I")
SHARD_IDS = 500_000


# --- the format --------------------------------------------------------------


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 128 values as rows of 2 * width 64-bit words: each half of a row is a run of ``width``-bit fields."""
    v = np.ascontiguousarray(values.reshape(-1, 64).T).astype(np.uint64)
    out = np.zeros((width, v.shape[1]), np.uint64)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        out[word] |= v[k] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= v[k] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).reshape(len(values), 2 * width)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    w = np.ascontiguousarray(words.reshape(-1, width).T)
    out, mask = np.zeros((64, w.shape[1]), np.uint64), np.uint64((1 << width) - 1)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        v = w[word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | (w[word + 1] << np.uint64(64 - shift))
        out[k] = v & mask
    return np.ascontiguousarray(out.T).reshape(len(words), BLOCK)


def pack_shard(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, percentile: int = 90) -> bytes:
    blocks = -(-len(ids) // BLOCK)
    x = np.zeros(blocks * BLOCK, np.uint32)
    x[: len(ids)] = ids
    x[len(ids) :] = ids[-1] if len(ids) else 0
    x = x.reshape(blocks, BLOCK)
    low = x.min(1) if blocks else np.zeros(0, np.uint32)
    diff = x - low[:, None]
    rank = BLOCK * percentile // 100
    fits = np.partition(diff, rank, axis=1)[:, rank] if blocks else low
    width = np.frexp(fits.astype(np.float64))[1].astype(np.int64)
    row, col = np.nonzero(diff >> np.minimum(width, 31).astype(np.uint32)[:, None] if blocks else diff)
    keep = width[row] < 32
    row, col = row[keep], col[keep]
    outliers = diff[row, col]
    diff[row, col] = 0
    start = np.cumsum(2 * width) - 2 * width
    words = np.zeros(int(2 * width.sum()), np.uint64)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            words[start[rows][:, None] + np.arange(2 * w)] = _pack(diff[rows], int(w))
    parts = [
        (doc_ids, "<i8"), (lengths, "<u4"), (low, "<u4"), (start, "<u4"), (width, "u1"),
        (np.bincount(row, minlength=blocks), "u1"), (col, "u1"), (outliers, "<u4"), (words, "<u8"),
    ]
    head = HEADER.pack(MAGIC, BLOCK, len(doc_ids), len(ids), blocks, len(row))
    return b"".join([head, *(np.asarray(v).astype(kind).tobytes() for v, kind in parts)])


def read_shard(payload: bytes, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, their numbers of ids, and the ids of the blocks from ``first`` up to ``last``."""
    magic, block, docs, count, blocks, patched = HEADER.unpack(payload[: HEADER.size])
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a token shard")
    at, parts = HEADER.size, []
    for n, kind in ((docs, "<i8"), (docs, "<u4"), *((blocks, k) for k in ("<u4", "<u4", "u1", "u1")), (patched, "u1"), (patched, "<u4")):
        parts.append(np.frombuffer(payload, kind, n, at))
        at += parts[-1].nbytes
    doc_ids, lengths, low, start, width, exceptions, col, outliers = parts
    words = np.frombuffer(payload, "<u8", (len(payload) - at) // 8, at)
    last = blocks if last is None else min(last, blocks)
    from_outlier, to_outlier = (int(exceptions[:k].sum(dtype=np.int64)) for k in (first, last))
    own = slice(first, last)
    low, start, width = low[own], start[own].astype(np.int64), width[own]
    diff = np.zeros((len(start), BLOCK), np.uint64)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            diff[rows] = _unpack(words[start[rows][:, None] + np.arange(2 * int(w))], int(w))
    row = np.repeat(np.arange(len(start)), exceptions[own])
    diff[row, col[from_outlier:to_outlier]] = outliers[from_outlier:to_outlier]
    ids = (diff + low[:, None].astype(np.uint64)).astype(np.uint32).ravel()
    return doc_ids, lengths, ids[: max(0, min(count, last * BLOCK) - first * BLOCK)]


# --- writing and reading -------------------------------------------------------


def write_token_files(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Write all texts in ascending id order; returns the stored shards ``part, seq, payload``.

    A null or empty text is its end id alone.  A null id comes first and is stored as the smallest long; equal ids are
    ordered by their text, repeated rows are all kept.
    """

    def fn(batches):
        part, seq, ids, lengths, arrays, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def shard():
            nonlocal seq
            payload = pack_shard(np.array(ids, np.int64), np.array(lengths, np.int64), np.concatenate(arrays))
            seq += 1
            return {"part": [part], "seq": [seq - 1], "payload": [payload]}

        for batch in batches:
            doc = batch.column(0).to_pylist()
            for k, own in enumerate(encoded(batch.column(1), tokenizer, True)):
                ids.append(doc[k] if doc[k] is not None else -(2**63))
                lengths.append(len(own) + 1)
                arrays += [own, np.array([end_id], np.uint32)]
                size += len(own) + 1
                if size >= SHARD_IDS:
                    yield shard()
                    ids, lengths, arrays, size = [], [], [], 0
        if ids:
            yield shard()

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    spark = docs.sparkSession
    ranges = rows.repartitionByRange(partitions(spark), "doc_id", F.xxhash64("t")).sortWithinPartitions("doc_id", "t")
    return pinned(map_partitions(ranges, fn, "part int, seq int, payload binary"), "uncompressed")


def map_partitions(df: DataFrame, fn, schema: str) -> DataFrame:
    """Like ``map_batches`` with all batches of a task at once."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    from wordloom.llm.common import _arrow_schema

    arrow = _arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for out in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def token_index(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the stored shards."""

    def fn(batch):
        for k in range(batch.num_rows):
            doc, length, ids = read_shard(batch.column(2)[k].as_py())
            end = np.cumsum(length.astype(np.int64))
            n = len(doc)
            yield {
                "part": [batch.column(0)[k].as_py()] * n, "seq": [batch.column(1)[k].as_py()] * n,
                "doc_id": doc, "at": end - length, "n_tokens": length.astype(np.int64),
                "ids_crc32": [crc_of(ids[e - m : e]) for e, m in zip(end, length, strict=True)],
            }

    rows = pinned(map_batches(shards, fn, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long"))
    sizes = rows.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    whole = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    whole = whole.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))  # a row per range
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", "seq", F.coalesce(inside, F.lit(0)).alias("seq_start")).join(whole, "part")
    return rows.join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("part_start") + F.col("seq_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )
