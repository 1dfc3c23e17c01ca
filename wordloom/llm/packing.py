"""Packing documents into fixed sequences along a space-filling curve.

1. Each document is encoded once; its ids are stored with a row number, and a vector of hashed id counts, projected to three
   dimensions, gives its Hilbert key.
2. Only (row, key, length) is sorted by range: running sums within a range and the ranges' totals give every document its
   place in the one long run of ids along the curve.
3. The run is cut every ``length`` ids.  Neighbours on the curve share sequences, a document that meets a cut goes on in
   the next sequence, and only the last sequence has padding.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from wordloom.llm.common import crc_of, map_batches, mix, partitions, pinned
from wordloom.llm.encode import encoded
from wordloom.llm.token_files import map_partitions

LENGTH = 2048
FEATURES = 256
BITS = 10
_FEATURE = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(FEATURES)).astype(np.int64)
_PROJECTION = np.random.default_rng(20240502).normal(size=(FEATURES, 3)) / np.sqrt(3)


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of rows of coordinates below ``2 ** bits``.

    The coordinates are turned into the transposed index: from the highest bit down, each coordinate either flips the
    lower bits of the first or swaps them with it; then Gray code is undone and the bits are interleaved.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            flip = (x[i] >> b) & 1 == 1
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def document_keys(documents: list[np.ndarray]) -> np.ndarray:
    counts = np.zeros((len(documents), FEATURES))
    for row, ids in zip(counts, documents, strict=True):
        row += np.bincount(_FEATURE[ids & 0xFFFF], minlength=FEATURES)
    root = np.sqrt(counts)
    root /= np.maximum(np.sqrt((root * root).sum(1, keepdims=True)), 1e-12)
    point = 1 / (1 + np.exp(-3 * (root @ _PROJECTION)))
    return hilbert_key(np.minimum((point * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def pack_documents(
    docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", end_id: int = 1, length: int = LENGTH,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``: 32-bit, little-endian).

    A null or empty text is its end id alone.  Rows with a null id and repeated rows are packed like others, each once.
    """

    def encode(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            doc, part = batch.column(0), []
            at = 0
            for own in encoded(batch.column(1), tokenizer, False):
                part.append(np.append(own, np.uint32(end_id)))
                if len(part) == 1000 or at + len(part) == batch.num_rows:
                    yield {
                        "row": np.arange(row, row + len(part)), "doc_id": doc.slice(at, len(part)), "key": document_keys(part),
                        "n": [len(p) for p in part], "ids": [p.astype("<u2" if p.max() < 65536 else "<u4").tobytes() for p in part],
                    }
                    row, at, part = row + len(part), at + len(part), []

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    coded = pinned(map_partitions(rows, encode, "row long, doc_id long, key long, n long, ids binary"))
    small = coded.select("row", "doc_id", "key", "n")
    spread = small.repartitionByRange(partitions(docs.sparkSession), "key", "doc_id", "row")
    placed = pinned(spread.withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("part").orderBy("key", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    whole = placed.groupBy("part").agg(F.sum("n").alias("n"))
    first = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    whole = whole.select("part", F.coalesce(first, F.lit(0)).alias("part_start"))  # a row per range
    placed = placed.withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0))).join(whole, "part")
    placed = placed.select("row", (F.col("part_start") + F.col("inside")).alias("at"))

    def cut(batch):
        doc, at, n = (batch.column(k).to_pylist() for k in range(3))
        out = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
        out |= {"ids": []} if with_ids else {}
        for k in range(batch.num_rows):
            raw = batch.column(3)[k].as_py()
            ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n[k] else "<u4").astype("<u4")
            a = 0
            while a < n[k]:
                sequence, offset = divmod(at[k] + a, length)
                b = min(n[k], a + length - offset)
                values = (doc[k], a, b - a, crc_of(ids[a:b]), n[k], sequence, offset) + ((ids[a:b].tobytes(),) if with_ids else ())
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
                a = b
        yield out

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    joined = coded.select("row", "doc_id", "n", "ids").join(placed.hint("shuffle_hash"), "row").select("doc_id", "at", "n", "ids")
    return map_batches(joined, cut, schema + (", ids binary" if with_ids else ""))


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """``sequence_id, ids`` of pieces with ids: their parts in order, the last one padded to ``length``."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    joined = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p))
    pad = F.lit(int(pad_id).to_bytes(4, "little") * length)
    full = F.expr(f"concat(ids, substring(pad, 1, {4 * length} - octet_length(ids)))")
    return pieces.groupBy("sequence_id").agg(joined.alias("ids")).withColumn("pad", pad).select("sequence_id", full.alias("ids"))
