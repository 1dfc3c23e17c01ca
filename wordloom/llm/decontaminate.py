"""Benchmark decontamination with SimHash windows and a multi-index Hamming search.

A benchmark item is a bag of 5-word shingles, each weighted by how often it occurs.  A document is searched with windows
of the item's size, slid over every position at which a window holds at least one shingle of the item (any other
window has similarity 0).

1. A window's fingerprint has 64 bits, the signs of the weighted sums of its shingles' hash bits.
2. Fingerprints are cut into 8 blocks of 8 bits.  If two differ in at most 23 bits, some block differs in at most 2
   (8 * 3 - 1 = 23), so a table per block from each value to the items within 2 bits finds all items within the radius.
3. Candidates are verified exactly: sum of minima over sum of maxima of the two bags' weights, at least ``percent`` / 100.

Items with that similarity have fingerprints that differ in 11 bits on average; a difference over 23 is four standard
deviations away.  The benchmark goes to the documents in slices of bounded size, one pass per slice; documents are not
shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wordloom.llm.common import Words, text_slices
from wordloom.llm.token_files import map_partitions

SLICE = 4 << 20  # bytes of benchmark text per pass
BLOCKS, BLOCK_RADIUS = 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
_BYTE_DISTANCE = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8))


def _signs(shingles: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def fingerprints(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash (8 bytes) of the windows of ``size`` shingles at ``starts``."""
    sums = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(_signs(shingles), axis=0, out=sums[1:])
    end = np.minimum(starts + size, len(shingles))
    return np.packbits(sums[end] > sums[starts], axis=1)


class Benchmark:
    """Index over items: shingles to items, and block tables of their fingerprints."""

    def __init__(self, ids: list, texts: pa.Array, percent: int = 75, n: int = 5):
        self.percent, self.n = percent, n
        self.ids, self.bags, marks = [], [], []
        for row, to, data, offsets in text_slices(texts):
            values, off = Words(data, offsets).shingles(n)
            for k in range(to - row):
                own = values[off[k] : off[k + 1]]
                if len(own):
                    self.ids.append(ids[row + k])
                    self.bags.append((*np.unique(own, return_counts=True), len(own)))
                    marks.append(fingerprints(own, np.zeros(1, np.int64), len(own))[0])
        self.size = np.array([b[2] for b in self.bags], np.int64)
        self.marks = np.array(marks, np.uint8).reshape(-1, 8)
        token = np.concatenate([np.zeros(0, np.uint64), *(b[0] for b in self.bags)])
        item = np.repeat(np.arange(len(self.bags)), [len(b[0]) for b in self.bags])
        order = np.argsort(token, kind="stable")
        self.token, first = np.unique(token[order], return_index=True)
        self.item, self.first = item[order], np.append(first, len(token))
        # table[block][value]: items whose block is near that value
        self.tables = [_BYTE_DISTANCE[:, self.marks[:, b]] <= BLOCK_RADIUS for b in range(BLOCKS)]

    def near(self, marks: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius."""
        found = np.zeros((len(marks), len(items)), bool)
        for b in range(BLOCKS):
            found |= self.tables[b][marks[:, b]][:, items]
        w, i = np.nonzero(found)
        distance = np.bitwise_count(marks[w] ^ self.marks[items[i]]).sum(1)
        keep = distance <= RADIUS
        return w[keep], items[i[keep]]

    def matches(self, shingles: np.ndarray) -> list[tuple[int, int, int, float]]:
        """Best window of each item in one text: (item, start, size, similarity)."""
        at = np.searchsorted(self.token, shingles)
        hit = np.flatnonzero(self.token[np.minimum(at, len(self.token) - 1)] == shingles) if len(self.token) else at[:0]
        if not len(hit):
            return []
        touched: dict[int, set[int]] = {}
        for p in hit:
            for item in self.item[self.first[at[p]] : self.first[at[p] + 1]]:
                touched.setdefault(int(self.size[item]), set()).add(int(item))
        best: dict[int, tuple[float, int, int]] = {}
        for size, items in touched.items():
            last = max(0, len(shingles) - size)
            cover = np.zeros(last + 2, np.int32)  # windows that hold some benchmark shingle
            np.add.at(cover, np.clip(hit - size + 1, 0, last), 1)
            np.add.at(cover, np.minimum(hit, last) + 1, -1)
            starts = np.flatnonzero(np.cumsum(cover)[: last + 1])
            for k in range(0, len(starts), 4096):
                part = starts[k : k + 4096]
                lo, hi = int(part[0]), min(len(shingles), int(part[-1]) + size)
                marks = fingerprints(shingles[lo:hi], part - lo, size)
                for w, item in zip(*self.near(marks, np.array(sorted(items))), strict=True):
                    start = int(part[w])
                    similarity = self._similarity(shingles[start : start + size], int(item))
                    if similarity[0] * 100 >= self.percent * similarity[1]:
                        value = (similarity[0] / similarity[1], -start, size)
                        best[int(item)] = max(best.get(int(item), value), value)
        return [(item, -start, size, s) for item, (s, start, size) in sorted(best.items())]

    def _similarity(self, window: np.ndarray, item: int) -> tuple[int, int]:
        token, weight, total = self.bags[item]
        own, count = np.unique(window, return_counts=True)
        at = np.minimum(np.searchsorted(token, own), len(token) - 1)
        same = token[at] == own
        low = int(np.minimum(count[same], weight[at[same]]).sum())
        return low, total + len(window) - low


def benchmark_slices(benchmark: DataFrame, id: str, text: str, percent: int):
    """The benchmark as indexes of about ``SLICE`` bytes of text each, one at a time."""
    total = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    slices = max(1, math.ceil(total / SLICE))
    rows = benchmark.select(F.col(id), F.col(text).cast("string"))
    for k in range(slices):
        part = rows.where(F.pmod(F.xxhash64(text), F.lit(slices)) == k).toArrow()
        order = pa.compute.sort_indices(part, sort_keys=[(id, "ascending")])
        part = part.take(order)
        yield Benchmark(part.column(0).to_pylist(), part.column(1).combine_chunks(), percent)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", percent: int = 75
) -> DataFrame:
    """``doc_id, item_id, start_word, n_words, similarity``: each document's best window for each item it holds.

    Null and empty texts and items match nothing; repeated rows each give their rows.
    """
    spark, found = docs.sparkSession, None
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    for index in benchmark_slices(benchmark.select(F.col(item).cast("long").alias("item_id"), F.col(text)), "item_id", text, percent):
        shared = spark.sparkContext.broadcast(index)  # of one bounded slice

        def fn(batches, shared=shared):
            for batch in batches:
                out = []
                for row, start, match in _found(batch.column(1), shared.value):
                    i, at, size, similarity = match
                    out.append((batch.column(0)[row + start].as_py(), shared.value.ids[i], at, size + shared.value.n - 1, similarity))
                if out:
                    yield dict(zip(("doc_id", "item_id", "start_word", "n_words", "similarity"), zip(*out, strict=True), strict=True))

        part = map_partitions(rows, fn, "doc_id long, item_id long, start_word long, n_words long, similarity double")
        found = part if found is None else found.unionByName(part)
    return found


def _found(column, index: Benchmark):
    for row, to, data, offsets in text_slices(column):
        values, off = Words(data, offsets).shingles(index.n)
        for k in range(to - row):
            for match in index.matches(values[off[k] : off[k + 1]]):
                yield row, k, match


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", percent: int = 75) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns; decided row by row, without a shuffle."""
    spark = docs.sparkSession
    for index in benchmark_slices(benchmark, "item_id", "text", percent):
        shared = spark.sparkContext.broadcast(index)
        place = docs.columns.index(text)

        def fn(batches, shared=shared, place=place):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, k, _ in _found(batch.column(place), shared.value):
                    keep[row + k] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(fn, docs.schema)
    return docs
