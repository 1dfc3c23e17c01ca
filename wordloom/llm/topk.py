"""Exact top-k inner products with multi-resolution segment statistics.

A vector x is summed up by the mean m and the deviation s of each of its segments of length l.  For two vectors

    |q - x|^2  >=  sum over segments of  l * ((m_q - m_x)^2 + (s_q - s_x)^2)

and, since 2 q.x = |q|^2 + |x|^2 - |q - x|^2, the inner product is at most the sum of l * (m_q m_x + s_q s_x).  Bounds are
taken with few segments first; pairs that can't reach a query's k-th best score so far are dropped, the rest goes on to
more segments and what survives is computed exactly on integers.

Queries are a stated set.  They go to the vectors in blocks of bounded size, one pass over the vectors per block; a task
returns its k best per query, and these are ranked per query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from wordloom.llm.common import pinned
from wordloom.llm.token_files import map_partitions

BLOCK_VALUES = 1_000_000  # of a block of queries: 8 MB of doubles
PAIRS = 1 << 15
SEGMENTS = (4, 16)


class Level:
    """Segment means and deviations, each times the root of the segment's length."""

    def __init__(self, x: np.ndarray, segments: int):
        cut = np.unique(np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int))
        parts = [x[:, a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        root = np.sqrt(np.diff(cut))
        self.stats = np.concatenate(
            [np.stack([p.mean(1) for p in parts], 1) * root, np.stack([p.std(1) for p in parts], 1) * root], axis=1
        )


def _slack(bound: np.ndarray, scale) -> np.ndarray:
    return bound + 1e-9 * scale + 1e-6  # what rounding of the bounds may hide


class Searcher:
    """The k best of all vectors seen so far, for one block of queries of one length."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.levels = [Level(x, s).stats for s in SEGMENTS]
        self.norm = np.sqrt((x * x).sum(1))
        self.best = np.full((len(ids), k), -np.inf)  # scores; floats for the threshold only
        self.kept: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id), ascending

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        levels = [Level(x, s).stats for s in SEGMENTS]
        norm = np.sqrt((x * x).sum(1))
        whole = float(np.abs(x).max(initial=0)) * float(np.abs(self.x).max(initial=0)) * x.shape[1] < 2.0**62
        kind = np.int64 if whole else object
        xi, qi = (x.astype(kind), self.x.astype(kind)) if whole else (_objects(x), _objects(self.x))
        step = max(1, (PAIRS * 8) // max(1, len(ids)))
        for a in range(0, len(self.ids), step):
            q = np.arange(a, min(a + step, len(self.ids)))
            bound = _slack(self.levels[0][q] @ levels[0].T, self.norm[q, None] * norm)
            own = self.ids[q, None] == ids
            bound[own] = -np.inf
            # The most promising vectors first, so that there is a threshold for the others.
            first = np.argpartition(-bound, min(2 * self.k, len(ids) - 1), axis=1)[:, : 2 * self.k]
            rows, cols = np.repeat(q, first.shape[1]), first.ravel()
            real = np.isfinite(bound[rows - a, cols])
            self._exact(rows[real], cols[real], qi, xi, ids)
            bound[np.arange(len(q))[:, None], first] = -np.inf
            row, col = np.nonzero((bound >= self.best[q, -1][:, None]) & np.isfinite(bound))
            for p in range(0, len(row), PAIRS):
                r, c = q[row[p : p + PAIRS]], col[p : p + PAIRS]
                for mine, theirs in zip(self.levels[1:], levels[1:], strict=True):
                    fine = _slack(np.einsum("ij,ij->i", mine[r], theirs[c]), self.norm[r] * norm[c])
                    keep = fine >= self.best[r, -1]
                    r, c = r[keep], c[keep]
                self._exact(r, c, qi, xi, ids)

    def _exact(self, r, c, qi, xi, ids) -> None:
        if not len(r):
            return
        score = (qi[r] * xi[c]).sum(1)
        keep = score >= self.best[r, -1]
        for row, s, i in zip(r[keep].tolist(), score[keep].tolist(), ids[c[keep]].tolist(), strict=True):
            kept = self.kept[row]
            if len(kept) == self.k and (-s, i) >= kept[-1]:
                continue
            same = next((n for n, (_, j) in enumerate(kept) if j == i), None)
            if same is not None:  # a repeated id counts once, by its best score
                if kept[same][0] <= -s:
                    continue
                kept.pop(same)
            kept.append((-s, i))
            kept.sort()
            del kept[self.k :]
            if len(kept) == self.k:
                self.best[row, -1] = -kept[-1][0]


def _objects(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)


def scaled_vectors(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Usable vectors of a batch as floor(256 * x), by length: ids and a matrix of doubles."""
    out: dict[int, tuple[list, list]] = {}
    for i, v in zip(ids.to_pylist(), vectors, strict=True):
        if i is None or not v.is_valid or v.values.null_count:
            continue
        x = np.floor(256 * v.values.to_numpy(zero_copy_only=False).astype(np.float64))
        if np.isfinite(x).all() and len(x):
            a, b = out.setdefault(len(x), ([], []))
            a.append(i)
            b.append(x)
    return {n: (np.array(a, np.int64), np.stack(b)) for n, (a, b) in out.items()}


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k largest integer inner products, ties to the smaller id.

    A query is not compared with rows of its own id, nor with vectors of another length.  Vectors that are null, empty or
    hold a null or a non-finite component, and rows without an id, take no part.  An id that is repeated counts once, by
    its best score.  Scores beyond 64 bits are cut to the range of a long.
    """
    spark = vectors.sparkSession
    pick = lambda df: df.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("x"))
    rows, asked = pick(vectors), pinned(pick(queries))
    values = asked.agg(F.sum(F.size("x")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(values / BLOCK_VALUES))
    found = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()  # about BLOCK_VALUES numbers
        mine = spark.sparkContext.broadcast(scaled_vectors(block.column(0), block.column(1).combine_chunks()))

        def fn(batches, mine=mine):
            search = {n: Searcher(i, x, k) for n, (i, x) in mine.value.items()}
            for batch in batches:
                for n, (i, x) in scaled_vectors(batch.column(0), batch.column(1)).items():
                    if n in search:
                        for a in range(0, len(i), 4096):
                            search[n].add(i[a : a + 4096], x[a : a + 4096])
            out = [(q, i, max(-(2**63), min(2**63 - 1, -s))) for e in search.values() for q, kept in zip(e.ids.tolist(), e.kept, strict=True) for s, i in kept]
            if out:
                yield dict(zip(("query_id", "vec_id", "score"), zip(*out, strict=True), strict=True))

        part = pinned(map_partitions(rows, fn, "query_id long, vec_id long, score long"))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


