"""What several operators share: word and shingle hashes of Arrow batches, stored tables, components.

Words are maximal runs without ASCII white space, A-Z in lower case.  All hashes have 64 bits; two different shingles
of one comparison share a hash with a probability of about 2^-64.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wordloom.session import ensure_checkpoint_dir

SLICE_BYTES = 500_000
MULTIPLIER = np.uint64(6364136223846793005)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 2**64))
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def pinned(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """``df`` written once to the shared folder and read back: fixed for all later passes, safe from lost executors."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """``df`` written once in buckets of ``key``: joins on the key read it where it is, without a shuffle.

    ``df`` should be dealt by ``repartition(partitions(spark), key)``, which makes one bucket a task.  The table is external:
    its files are in the shared folder, the session's catalog only knows its name.
    """
    spark = df.sparkSession
    name = f"wordloom_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark)}/table-{name}"
    writer = df.write.format("parquet").option("compression", "zstd").option("path", path)
    writer.bucketBy(partitions(spark), key).sortBy(key).saveAsTable(name)
    return spark.table(name)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        _powers[:] = [
            np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (_ODD, _INVERSE)
        ]
    return _powers


class Words:
    """Words of consecutive texts: ``hashes`` of all, byte ``starts`` and ``ends`` in ``data``, ``offsets`` per text."""

    def __init__(self, data: np.ndarray, text_offsets: np.ndarray):
        self.data, self.text_offsets = data, text_offsets
        inside = ~_SPACE[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = text_offsets[1:] > text_offsets[:-1]
        a, b = text_offsets[:-1][full], text_offsets[1:][full] - 1
        first[a], last[b] = inside[a], inside[b]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.offsets = np.searchsorted(self.starts, text_offsets)
        power, inverse = _power_tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts])

    def shingles(self, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words in order, and their offsets per text; a shorter text is one shingle."""
        count = np.diff(self.offsets)
        size = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
        off = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.offsets[:-1] - off[:-1], size) + np.arange(off[-1])
        length = np.repeat(np.minimum(count, n), size)
        h = length.astype(np.uint64)
        padded = np.concatenate([self.hashes, np.zeros(n, np.uint64)])
        for j in range(n):
            h = h * MULTIPLIER + np.where(j < length, padded[at + j], np.uint64(j + 1))
        return mix(h), off


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Views of at most about half a million bytes of a string column (null counts as empty): rows from, to, bytes, offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1)
        yield row, to, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def set_slices(column: pa.Array, n: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ascending distinct shingle hashes) of every text of a column."""
    for row, to, data, offsets in text_slices(column):
        values, off = Words(data, offsets).shingles(n)
        for k in range(to - row):
            yield row + k, np.unique(values[off[k] : off[k + 1]])


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """``fn`` turns an Arrow batch into dicts of columns, one dict per output batch."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema) if hasattr(StructType, "fromDDL") else None
    arrow = _arrow_schema(fields)

    def run(batches):
        for batch in batches:
            for out in fn(batch):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def _arrow_schema(fields) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(fields)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: each node of an edge with the smallest node it reaches.

    Alternates the large-star and the small-star step, each a grouped minimum (combined before the shuffle) joined back
    on the node, until nothing changes; every round is a stored table, so lineage stays short.
    """
    edges = pinned(edges.where("a <> b").distinct())

    def star(e: DataFrame, small: bool) -> DataFrame:
        both = e if small else e.unionByName(e.selectExpr("b AS a", "a AS b"))
        if small:
            both = both.selectExpr("greatest(a, b) AS a", "least(a, b) AS b")
        low = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) AS m")
        joined = both.join(low, "a")
        if small:
            out = joined.selectExpr("b AS a", "m AS b").unionByName(low.selectExpr("a", "m AS b"))
        else:
            out = joined.where("b > a").selectExpr("b AS a", "m AS b")
        return out.where("a <> b").distinct()

    def digest(e: DataFrame):
        return tuple(e.selectExpr("count(*) AS n", "sum(cast(xxhash64(a, b) AS decimal(38, 0))) AS h").first())

    before = digest(edges)
    while True:
        edges = pinned(star(star(edges, False), True))
        after = digest(edges)
        if after == before:
            break
        before = after
    nodes = edges.selectExpr("a AS node", "b AS component")
    return nodes.unionByName(nodes.selectExpr("component AS node", "component").distinct())
