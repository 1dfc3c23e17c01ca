"""Codes of vectors by parts (product quantisation) in exact integers.

A component x becomes floor(256 x); a vector is cut into ``parts`` equal parts, each with a codebook of ``entries`` entries.

1. The parts of every position are sorted along a Hilbert curve and stored once as flat blocks of ``BLOCK`` neighbours, with
   the smallest and largest component (a box) and the sum of each block.
2. Each round compares boxes with the codebook: an entry whose smallest distance to the box exceeds the least of the largest
   distances can't be nearest to anything in it.  A block with one entry left is counted by its stored sum; the others
   compute exact distances to their short list only.  Sums per entry, a number of values fixed by ``parts``, ``entries`` and the
   length of the vectors, go to the driver and give the next codebook.
3. The last assignment is dealt back to the vectors in buckets.

The order along the curve only decides how short the lists are, never a result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wordloom.llm.common import mix, pinned
from wordloom.llm.packing import hilbert_key

PARTS, ENTRIES, ROUNDS = 16, 64, 2
BLOCK = 256
BUCKET_ROWS = 1 << 16  # codes of about this many vectors are dealt back in one group


def kept_vectors(vectors: DataFrame, id: str, vector: str, label: str | None) -> DataFrame:
    """``row, vec_id, label, x``: rows whose vector holds only finite numbers; ``x`` are floor(256 component)."""
    value = F.col(vector).cast("array<double>")
    good = F.col(vector).isNotNull() & ~F.exists(value, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    named = F.col(label) if label else F.lit(None).cast("int")
    kept = vectors.where(F.coalesce(good, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id).alias("vec_id"),
        named.alias("label"),
        F.transform(value, lambda v: F.floor(v * 256).cast("long")).alias("x"),
    )
    return pinned(kept)


def _first_entries(kept: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """Per part position the parts of the ``entries`` smallest ids (repeated ids by their components)."""
    rows = kept.where("vec_id IS NOT NULL").orderBy("vec_id", "x").limit(entries).select("x").collect()
    x = np.array([r.x for r in rows], np.int64)
    return [np.ascontiguousarray(p) for p in np.split(x, parts, axis=1)]


def _curve_keys(p: np.ndarray, low: int, high: int) -> np.ndarray:
    """Hilbert keys of at most 62 bits; of very wide parts the first 62 components."""
    p = p[:, :62]
    bits = max(1, min(10, 62 // max(1, p.shape[1])))
    scaled = (p - low).astype(np.float64) / max(1, high - low + 1) * (1 << bits)
    return hilbert_key(np.clip(scaled.astype(np.int64), 0, (1 << bits) - 1), bits)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), width)


def part_blocks(kept: DataFrame, parts: int, width: int, low: int, high: int) -> DataFrame:
    """``part, n, rows, x, low, high, total``: blocks of neighbouring parts, numbers packed as little-endian longs."""
    size = width // parts

    def deal(batches):
        for batch in batches:
            x, rows = _matrix(batch.column(1), width), batch.column(0)
            for k in range(parts):
                own = np.ascontiguousarray(x[:, k * size : (k + 1) * size])
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * size), len(own), [None, pa.py_buffer(own.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), k), pa.int32()), pa.array(_curve_keys(own, low, high)), rows, raw.cast(pa.binary())],
                    names=["part", "key", "row", "x"],
                )

    def pack(batches):
        part, rows, x, n = -1, [], [], 0

        def block(row, values):
            return {
                "part": [part], "n": [len(row)], "rows": [row.tobytes()], "x": [values.tobytes()],
                "low": [values.min(0).tobytes()], "high": [values.max(0).tobytes()], "total": [values.sum(0).tobytes()],
            }

        def full(flush):
            nonlocal rows, x, n
            row, values = np.concatenate(rows), np.concatenate(x)
            at = 0
            while len(row) - at >= BLOCK or (flush and at < len(row)):
                yield pa.RecordBatch.from_pydict(block(row[at : at + BLOCK], values[at : at + BLOCK]), schema=schema)
                at += BLOCK
            rows, x, n = [row[at:]], [values[at:]], len(row) - at if at < len(row) else 0

        for batch in batches:
            own = np.asarray(batch.column(0))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]]) if len(own) else []
            values = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64).reshape(len(own), size)
            row = np.asarray(batch.column(1))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if own[a] != part and n:
                    yield from full(True)
                    rows, x, n = [], [], 0
                part = int(own[a])
                rows.append(row[a:b])
                x.append(values[a:b])
                n += b - a
                if n >= 16 * BLOCK:
                    yield from full(False)
        if n:
            yield from full(True)

    ddl = "part int, n int, rows binary, x binary, low binary, high binary, total binary"
    schema = pa.schema([("part", pa.int32()), ("n", pa.int32())] + [(c, pa.binary()) for c in ("rows", "x", "low", "high", "total")])
    dealt = kept.select("row", "x").mapInArrow(deal, "part int, key long, row long, x binary")
    dealt = dealt.repartitionByRange("part", "key", "row").sortWithinPartitions("part", "key", "row")
    return pinned(dealt.select("part", "row", "x").mapInArrow(pack, ddl))


def short_lists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """For each box, whether an entry may be nearest to a point in it (ties included)."""
    c = book[None]
    near = np.maximum(np.maximum(low[:, None] - c, c - high[:, None]), 0)
    far = np.maximum(np.abs(c - low[:, None]), np.abs(high[:, None] - c))
    return (near * near).sum(2) <= (far * far).sum(2).min(1)[:, None]


def nearest(x: np.ndarray, book: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest of the listed entries (ascending) for each row, the lower index on ties, and its squared distance."""
    d = ((x[:, None] - book[entries][None]) ** 2).sum(2)
    best = d.argmin(1)
    return entries[best], d[np.arange(len(x)), best]


def _boxes(batch: pa.RecordBatch, size: int):
    def numbers(k, row):
        return np.frombuffer(batch.column(k)[row].as_py(), np.int64).reshape(-1, size)

    parts = np.asarray(batch.column(0))
    low, high = (np.concatenate([numbers(k, r) for r in range(batch.num_rows)]) for k in (4, 5))
    return parts, low, high, numbers


def _sums(blocks: DataFrame, books: list[np.ndarray]) -> np.ndarray:
    """Per part, entry: the sums of the components assigned to it, and their number."""
    parts, (entries, size) = len(books), books[0].shape

    def count(batches):
        out = np.zeros((parts, entries, size + 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            which, low, high, numbers = _boxes(batch, size)
            for r, part in enumerate(which):
                list_ = np.flatnonzero(short_lists(low[r : r + 1], high[r : r + 1], books[part])[0])
                if len(list_) == 1:
                    out[part, list_[0], :size] += numbers(6, r)[0]
                    out[part, list_[0], size] += batch.column(1)[r].as_py()
                else:
                    x = numbers(3, r)
                    code, _ = nearest(x, books[part], list_)
                    np.add.at(out[part, :, :size], code, x)
                    out[part, :, size] += np.bincount(code, minlength=entries)
        hit = np.flatnonzero(out[:, :, size].reshape(-1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(hit, pa.int32()), pa.array(list(out.reshape(parts * entries, -1)[hit]), pa.list_(pa.int64()))], names=["entry", "sums"]
        )

    rows = blocks.mapInArrow(count, "entry int, sums array<long>")
    rows = rows.groupBy("entry").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(size + 1)]).collect()
    out = np.zeros((parts * entries, size + 1), np.int64)
    for r in rows:
        out[r[0]] = r[1:]
    return out.reshape(parts, entries, size + 1)


def _codes(blocks: DataFrame, books: list[np.ndarray], buckets: int) -> DataFrame:
    """``row, code, error`` of the last assignment: parts are dealt back to their rows in packed buckets."""
    parts, size = len(books), books[0].shape[1]

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            which, low, high, numbers = _boxes(batch, size)
            rows, codes, errors = [], [], []
            for r, part in enumerate(which):
                list_ = np.flatnonzero(short_lists(low[r : r + 1], high[r : r + 1], books[part])[0])
                code, error = nearest(numbers(3, r), books[part], list_)
                rows.append(np.frombuffer(batch.column(2)[r].as_py(), np.int64))
                codes.append(int(part) << 32 | code)  # 64 bits: the part itself has 32
                errors.append(error)
            row, code, error = np.concatenate(rows), np.concatenate(codes), np.concatenate(errors)
            bucket = (mix(row.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            hit, start = np.unique(bucket[order], return_index=True)
            packed = [np.stack([row[o], code[o], error[o]]).tobytes() for o in np.split(order, start[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "packed"])

    def collect(table: pa.Table) -> pa.Table:
        row, code, error = np.concatenate([np.frombuffer(b.as_py(), np.int64).reshape(3, -1) for b in table.column("packed")], axis=1)
        order = np.lexsort((code >> 32, row))
        row, code, error = (v[order].reshape(-1, parts) for v in (row, code & 0xFFFFFFFF, error))
        digits = code.astype(np.uint8).tobytes().hex()
        texts = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
        return pa.table({"row": row[:, 0], "code": texts, "error": error.sum(1)})

    dealt = blocks.mapInArrow(assign, "bucket int, packed binary")
    return dealt.groupBy("bucket").applyInArrow(collect, "row long, code string, error long")


def vector_codes(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str | None = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """``vec_id, label, code, error, codebooks_sha256``, a row per vector of finite numbers; others are left out.

    ``code`` holds two hex digits per part.  Codebooks start with the ``entries`` smallest ids; with fewer vectors they have
    fewer entries.  Rows with a null id are coded but never start an entry; rows that repeat an id are each coded.  All
    vectors need the same length, a multiple of ``parts``, and |256 x| below 2^28 (ValueError).  An empty table, or one
    without usable vectors, gives no rows.  ``entries`` may be up to 256.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("entries: 1 to 256, parts: 1 or more")
    kept = kept_vectors(vectors, id, vector, label)
    sizes = kept.agg(
        F.count("*"), F.min(F.size("x")), F.max(F.size("x")), F.min(F.array_min("x")), F.max(F.array_max("x")), F.count("vec_id")
    ).first()
    n, shortest, width, low, high, named = sizes
    if not n or not width:
        return kept.limit(0).selectExpr("vec_id", "label", "'' AS code", "0L AS error", "'' AS codebooks_sha256")
    if shortest != width or width % parts or max(-low, high) >= 1 << 28:
        raise ValueError("vectors need one length, a multiple of the number of parts, and components below 2^20")
    if not named:
        raise ValueError("no vector has an id")
    blocks = part_blocks(kept, parts, width, low, high)
    books = _first_entries(kept, parts, entries)
    for _ in range(rounds):
        sums = _sums(blocks, books)
        for book, own in zip(books, sums, strict=True):
            used = own[:, -1] > 0
            book[used] = own[used, :-1] // own[used, -1:]
    text = ",".join(str(v) for book in books for v in book.reshape(-1).tolist())
    digest = hashlib.sha256(text.encode()).hexdigest()
    codes = pinned(_codes(blocks, books, 1 + n // BUCKET_ROWS))
    return kept.select("row", "vec_id", "label").join(codes, "row").select("vec_id", "label", "code", "error", F.lit(digest).alias("codebooks_sha256"))


def with_label_error(codes: DataFrame, salts: int = 16) -> DataFrame:
    """``label_error``: the errors summed over equal labels (nulls together); a label's rows are spread over ``salts`` keys."""
    salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts))
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.select(F.col("label").alias("other_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s"))
    sums = sums.select("other_label", "label_error", F.col("s").cast("long").alias("other_salt"))
    rows = codes.withColumn("salt", salt)
    return rows.join(sums, F.col("label").eqNullSafe(F.col("other_label")) & (F.col("salt") == F.col("other_salt"))).drop("salt", "other_label", "other_salt")
