"""Long matrices: distances, principal components, projections.

All-pairs work is cut into cells of two row blocks.  A block holds about
``BLOCK`` rows by hash, each with its own vector, so a cell's size does not
depend on the data, and what leaves a cell is decided by the caller: the
distances themselves, or only their sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wordloom.operators.dtm import row_arrays, vocabulary
from wordloom.operators.prefix import dense_index
from wordloom.session import checkpoint

BLOCK = 512
WIDEST, MANY = 4096, 32  # rows of a block whose cells give sums only; number of blocks that keep all cores busy
DRIVER_BYTES = 1 << 30  # of a basis and its images while components are sought, at most
KEPT_BYTES = 1 << 26  # of them before a restart, if three blocks take no more
CELLS = 1 << 20  # numbers that a task expands at once


def row_vectors(matrix: DataFrame, row: str, col: str, value: str, rows: DataFrame | None = None) -> DataFrame:
    """Matrix rows as index and value arrays → ``item, idx, val``."""
    vocab = vocabulary(matrix, col)
    return row_arrays(matrix, row, col, value, vocab, rows).withColumnRenamed(row, "item")


def block_cells(vectors: DataFrame, block: int = BLOCK, widest: int | None = None) -> DataFrame:
    """Copy each row to the cells of its block: ``+ __block, __lo, __hi``.

    Blocks grow up to ``widest`` rows, by default ``block``, as long as ``MANY`` of them remain, so that a row is copied less often.
    """
    rows = vectors.agg(F.count(F.lit(1))).scalar()
    blocks = F.greatest(F.ceil(rows / block), F.lit(1)).cast("int")
    if widest is not None and widest > block:
        most = F.lit(widest // block)
        times = F.greatest(F.least(F.floor(blocks / MANY), most), F.lit(1))
        blocks = F.greatest(F.ceil(rows / (times * block)), F.lit(1)).cast("int")
    return (
        vectors.withColumn("__block", F.pmod(F.xxhash64("item"), blocks).cast("int"))
        .withColumn("__other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("__lo", F.least("__block", "__other"))
        .withColumn("__hi", F.greatest("__block", "__other"))
        .drop("__other")
    )


def tiled(fn, block: int):
    """A cell's function, called on tiles of ``block`` rows a side, or up to twice as many; what the tiles give is put together."""

    def whole(pdf):
        lo, hi, of = pdf["__lo"].iat[0], pdf["__hi"].iat[0], pdf["__block"].to_numpy()
        sides = [np.flatnonzero(of == b) for b in (lo, hi)]
        # blocks by hash vary in size: one of up to twice the rows is still a single tile
        left, right = (np.array_split(s, -(-len(s) // block)) if len(s) > 2 * block else [s] for s in sides)
        if len(left) == len(right) == 1:
            return fn(pdf)
        out = []
        for i, a in enumerate(left):
            for b in [a, *left[i + 1 :]] if lo == hi else right:
                if a is b:
                    out.append(fn(pdf.iloc[a].assign(__block=0, __lo=0, __hi=0)))
                elif len(a) and len(b):
                    mark = np.repeat([0, 1], [len(a), len(b)])
                    out.append(fn(pdf.iloc[np.append(a, b)].assign(__block=mark, __lo=0, __hi=1)))
        return pd.concat(out) if out else fn(pdf)

    return whole


def cell_distances():
    """A function (for use inside tasks) from a cell's rows to its distances.

    Returns ``left, right, dist``: row positions of the two sides and the
    distance matrix between them; within one block both sides are the same.
    """

    def measure(pdf):
        sizes = np.fromiter((len(i) for i in pdf["idx"]), dtype=np.int64, count=len(pdf))
        flat = np.concatenate([np.asarray(i, dtype=np.int64) for i in pdf["idx"]])
        used, at = np.unique(flat, return_inverse=True)
        dense = np.zeros((len(pdf), len(used)))
        dense[np.repeat(np.arange(len(pdf)), sizes), at] = np.concatenate([np.asarray(v) for v in pdf["val"]])
        block = pdf["__block"].to_numpy()
        left = np.nonzero(block == pdf["__lo"].iat[0])[0]
        right = np.nonzero(block == pdf["__hi"].iat[0])[0]
        a, b = dense[left], dense[right]
        square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
        dist = np.sqrt(np.maximum(square, 0.0))
        if left.size == right.size and (left == right).all():
            np.fill_diagonal(dist, 0.0)
        return left, right, dist

    return measure


def pairwise_distance(
    matrix: DataFrame, row: str, col: str, value: str, block: int = BLOCK, rows: DataFrame | None = None
) -> DataFrame:
    """Euclidean distances of all rows → ``a, b, dist`` with ``a < b``."""
    vectors = row_vectors(checkpoint(matrix.select(row, col, value)), row, col, value, rows)
    kind = dict(vectors.dtypes)["item"]
    measure = cell_distances()

    def pairs(pdf):
        left, right, dist = measure(pdf)
        items = pdf["item"].to_numpy()
        if pdf["__lo"].iat[0] == pdf["__hi"].iat[0]:
            i, j = np.triu_indices(len(left), 1)
        else:
            i, j = (x.ravel() for x in np.indices(dist.shape))
        return pd.DataFrame({"x": items[left[i]], "y": items[right[j]], "dist": dist[i, j]})

    cells = block_cells(vectors, block).groupBy("__lo", "__hi")
    found = cells.applyInPandas(pairs, f"x {kind}, y {kind}, dist double")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "dist")


# --- components ------------------------------------------------------------


def _column_moments(arrays: DataFrame, columns: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, and mean and population variance of each column (absent cells are zeros)."""
    n = arrays.count()
    cells = arrays.select(F.inline(F.arrays_zip("idx", "val")))
    square = F.col("val") * F.col("val")
    sums = cells.groupBy("idx").agg(F.sum("val").alias("s"), F.sum(square).alias("ss")).toPandas()
    mean, power = np.zeros(columns), np.zeros(columns)
    mean[sums["idx"]] = sums["s"] / n
    power[sums["idx"]] = sums["ss"] / n
    variance = power - mean * mean
    return n, mean, np.where(variance > 1e-12 * power, variance, 0.0)


def _cell_runs(sizes: np.ndarray, most: int):
    """Neighbouring rows with at most ``most`` cells in all (a longer row stands alone), as slices."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield slice(start, stop)
        start = stop


def _stacked(frames, most: int):
    """Non-empty sparse rows, a limited number of cells at a time: their table, ``at``, ``val`` of all cells, and sizes."""
    for pdf in frames:
        sizes = np.fromiter((len(i) for i in pdf["idx"]), np.int64, len(pdf))
        seen, sizes = pdf[sizes > 0], sizes[sizes > 0]
        for run in _cell_runs(sizes, most):
            rows = seen.iloc[run]
            yield rows, np.concatenate(list(rows["idx"])), np.concatenate(list(rows["val"])), sizes[run]


def _rows_times(shared, at, val, sizes) -> np.ndarray:
    """Sparse rows, none of them empty, times the shared matrix → rows × k."""
    return np.add.reduceat(shared[at] * val[:, None], np.cumsum(sizes) - sizes, axis=0)


def _gram_times(arrays: DataFrame, basis: np.ndarray) -> np.ndarray:
    """``XᵀX·basis`` for sparse rows ``X``: each task sums its own part, columns × k numbers reach the driver."""
    spark = arrays.sparkSession
    columns, k = basis.shape
    shared = spark.sparkContext.broadcast(basis)  # within the limit that principal_axes checks
    names = [f"v{j}" for j in range(k)]

    def part(frames):
        total = np.zeros((columns, k))
        for _, at, val, sizes in _stacked(frames, max(CELLS // k, columns)):
            weights = np.repeat(_rows_times(shared.value, at, val, sizes), sizes, axis=0)
            weights *= val[:, None]
            for j in range(k):
                total[:, j] += np.bincount(at, weights[:, j], columns)
        used = np.flatnonzero(total.any(1))
        yield pd.DataFrame(total[used], columns=names).assign(idx=used.astype("int32"))[["idx", *names]]

    parts = arrays.select("idx", "val").mapInPandas(part, "idx int, " + ", ".join(f"{c} double" for c in names))
    sums = parts.groupBy("idx").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
    out = np.zeros(basis.shape)
    out[sums["idx"]] = sums[names].to_numpy()
    shared.unpersist()
    return out


def _orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the block adds to the basis (two passes; directions lost in rounding are dropped)."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    q, r = np.linalg.qr(block)
    q = q[:, np.abs(np.diag(r)) > 1e-10]
    q = q - basis @ (basis.T @ q)
    return q / np.maximum(np.linalg.norm(q, axis=0), 1e-300)


def block_lanczos(times, columns: int, k: int, max_iter: int, tol: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest ``k`` eigenvalues and vectors of a symmetric operator, ``times(block)`` being one pass over the data.

    Block Lanczos: the residuals of the Ritz vectors are the next block, the whole basis and its images are kept and
    reorthogonalised, and at ``most`` vectors it restarts from the best ones (thick restart).  It stops when the residual of
    each wanted pair is at most ``tol`` times the first value, which bounds the distance of each value from an eigenvalue; more
    vectors than wanted are carried, so that a close next value (a small gap) shows and does not hold up the wanted ones.
    RuntimeError if ``max_iter`` passes don't reach that.
    """
    block = min(columns, k + 8)
    basis = np.linalg.qr(np.random.default_rng(1).normal(size=(columns, block)))[0]
    image, passes = times(basis), 1
    while True:
        values, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, images = basis @ turn[:, :block], image @ turn[:, :block]
        rest = images - vectors * values[:block]
        residual = np.linalg.norm(rest[:, :k], axis=0).max(initial=0.0)
        more = _orthonormal(rest, basis)
        if residual <= tol * max(values[0], 1e-300) or not more.shape[1] or basis.shape[1] >= columns:
            return values[:k], vectors[:, :k]
        if passes >= max_iter:
            raise RuntimeError(f"components not found in {max_iter} passes: residual {residual:.3g}, largest value {values[0]:.3g}, next values {values[:block]}")
        if basis.shape[1] + more.shape[1] > max(most, 3 * block):
            keep = min(2 * block, basis.shape[1])
            basis, image = basis @ turn[:, :keep], image @ turn[:, :keep]
            more = _orthonormal(rest, basis)
        basis, image, passes = np.hstack([basis, more]), np.hstack([image, times(more)]), passes + 1


def _basis_size(length: int, k: int, driver_bytes: int) -> int:
    """Number of vectors of a length to keep on the driver, with their images; ValueError if three blocks don't fit."""
    if driver_bytes // (16 * max(length, 1)) < min(length, 3 * (k + 8)):
        raise ValueError(f"vectors of {length} numbers: {k} components need more than {driver_bytes} bytes on the driver")
    return max(3 * (k + 8), min(KEPT_BYTES, driver_bytes) // (16 * max(length, 1)))


def principal_axes(
    arrays: DataFrame,
    n: int,
    mean: np.ndarray,
    inverse: np.ndarray,
    k: int,
    max_iter: int = 100,
    tol: float = 1e-7,
    driver_bytes: int = DRIVER_BYTES,
) -> tuple[np.ndarray, np.ndarray]:
    """Largest ``k`` eigenvalues and vectors of the scatter of ``(x - mean) * inverse``, proven by their residuals.

    The mean is subtracted implicitly, so rows stay sparse, and no columns × columns matrix is formed.  The basis on the
    driver is kept within ``driver_bytes``; if not even three blocks fit, it is refused (ValueError): prune columns first.
    RuntimeError if ``max_iter`` passes don't bring the residuals below ``tol`` times the first value.
    """
    columns = len(mean)
    most = _basis_size(columns, k, driver_bytes)

    def times(block: np.ndarray) -> np.ndarray:
        scaled = block * inverse[:, None]
        return (_gram_times(arrays, scaled) - n * np.outer(mean, mean @ scaled)) * inverse[:, None]

    values, vectors = block_lanczos(times, columns, k, max_iter, tol, most)
    return np.maximum(values, 0.0), vectors


def pca(
    matrix: DataFrame,
    row: str,
    col: str,
    value: str,
    k: int = 2,
    scale: bool = True,
    rows: DataFrame | None = None,
    max_iter: int = 100,
    tol: float = 1e-7,
) -> tuple[DataFrame, DataFrame]:
    """``(scores, loadings)`` of the principal components of a long matrix.

    Absent cells are zeros.  ``scale`` divides by the population deviation (constant columns take no part).
    Each component points to its largest loading.  With fewer rows than columns, the basis on the driver is as long as the
    rows are many, else as the columns are.  ``max_iter`` and ``tol`` as in ``principal_axes``, which raises when they are not met.  Scores: ``row, comp, score``; loadings: ``col, comp, loading, explained``.
    """
    spark = matrix.sparkSession
    matrix = checkpoint(matrix.select(row, col, value))
    vocab = checkpoint(vocabulary(matrix, col))
    columns = vocab.count()
    arrays = checkpoint(row_arrays(matrix, row, col, value, vocab, rows))
    if k < arrays.count() < columns and (found := _pca_by_rows(arrays, row, k, scale, max_iter, tol)):
        scores, table, explained = found
        return scores, _loadings(table, vocab, col, explained)
    n, mean, variance = _column_moments(arrays, columns)
    deviation = np.sqrt(variance) if scale else np.ones(columns)
    inverse = np.divide(1.0, deviation, out=np.zeros(columns), where=deviation > 0)
    values, axes = principal_axes(arrays, n, mean, inverse, min(k, columns), max_iter, tol)
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    explained = values / max(float((n * variance * inverse * inverse).sum()), 1e-300)
    wide = axes.shape[1]
    names = [f"__a{j}" for j in range(wide)]
    scaled = axes * inverse[:, None]
    weights = pd.DataFrame(np.hstack([scaled, axes]), columns=[*names, *[f"__l{j}" for j in range(wide)]])
    weights.insert(0, "idx", np.arange(columns, dtype="int32"))
    table = checkpoint(spark.createDataFrame(weights).withColumn("idx", F.col("idx").cast("int")))

    centre = mean @ scaled
    cells = arrays.select(row, F.expr("inline_outer(arrays_zip(idx, val))"))
    sums = cells.join(table.select("idx", *names), "idx", "left").groupBy(row)
    sums = sums.agg(*[(F.coalesce(F.sum(F.col("val") * F.col(a)), F.lit(0.0)) - float(c)).alias(a) for a, c in zip(names, centre, strict=True)])
    parts = [F.struct(F.lit(j + 1).alias("comp"), F.col(a).alias("score")) for j, a in enumerate(names)]
    scores = sums.select(row, F.inline(F.array(*parts)))
    return scores, _loadings(table, vocab, col, explained)


def _loadings(table: DataFrame, vocab: DataFrame, col: str, explained: np.ndarray) -> DataFrame:
    parts = [
        F.struct(F.lit(j + 1).alias("comp"), F.col(f"__l{j}").alias("loading"), F.lit(float(e)).alias("explained"))
        for j, e in enumerate(explained)
    ]
    return table.join(vocab, "idx").select(col, F.inline(F.array(*parts)))


def _moments_of(rows: int, scale: bool, val: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, inverse deviation (1 without ``scale``, 0 if constant) and scaled variance of columns, from all their cells."""
    start = np.cumsum(sizes) - sizes
    mean, power = np.add.reduceat(val, start) / rows, np.add.reduceat(val * val, start) / rows
    variance = power - mean * mean
    variance = np.where(variance > 1e-12 * power, variance, 0.0)
    inverse = np.ones(len(mean))
    if scale:
        inverse = np.divide(1.0, np.sqrt(variance), out=np.zeros(len(mean)), where=variance > 0)
    return mean, inverse, variance * inverse * inverse


def _outer_times(by_column: DataFrame, basis: np.ndarray, scale: bool) -> np.ndarray:
    """``ZZᵀ·basis`` for the centred, scaled matrix Z, from its sparse columns: rows × k numbers reach the driver."""
    rows, k = basis.shape
    shared = by_column.sparkSession.sparkContext.broadcast(basis)  # within the limit of _basis_size
    total_of = basis.sum(0)
    names = [f"v{j}" for j in range(k)]

    def part(frames):
        total, offset = np.zeros((rows, k)), np.zeros(k)
        for _, at, val, sizes in _stacked(frames, max(CELLS // k, rows)):
            mean, inverse, _ = _moments_of(rows, scale, val, sizes)
            z = (_rows_times(shared.value, at, val, sizes) - np.outer(mean, total_of)) * (inverse * inverse)[:, None]
            offset += mean @ z
            for j in range(k):
                total[:, j] += np.bincount(at, np.repeat(z[:, j], sizes) * val, rows)
        used = np.flatnonzero(total.any(1))
        out = pd.DataFrame(np.vstack([total[used], -offset]), columns=names)
        yield out.assign(idx=np.append(used, -1).astype("int32"))[["idx", *names]]

    parts = by_column.select("idx", "val").mapInPandas(part, "idx int, " + ", ".join(f"{c} double" for c in names))
    sums = parts.groupBy("idx").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
    shared.unpersist()
    place, sums = sums["idx"].to_numpy(), sums[names].to_numpy()
    out = np.zeros(basis.shape)
    out[place[place >= 0]] = sums[place >= 0]
    return out + sums[place < 0].sum(0)


def _pca_by_rows(arrays: DataFrame, row: str, k: int, scale: bool, max_iter: int, tol: float):
    """``(scores, idx and loadings, explained)`` of a matrix with fewer rows than columns; nothing as long as a row is on the driver.

    The eigenvectors of ``ZZᵀ`` are the scaled scores, and loadings follow from them column by column in the tasks.  None if
    a wanted component has next to no variance (its scores would be lost in rounding) or ``max_iter`` passes were too few.
    """
    arrays = checkpoint(dense_index(arrays, [F.asc(row)], "__place"))
    n = arrays.count()
    cells = arrays.select(F.col("__place").cast("int").alias("place"), F.inline(F.arrays_zip("idx", "val")))
    packed = cells.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("place", "val"))).alias("c"))
    by_column = checkpoint(packed.select(F.col("idx").alias("column"), F.col("c.place").alias("idx"), F.col("c.val").alias("val")))
    most = _basis_size(n, k, DRIVER_BYTES)
    try:  # scores are the axes themselves here, not images of them under Z, so they are taken further
        values, axes = block_lanczos(lambda b: _outer_times(by_column, b, scale), n, k, max_iter, max(tol * 1e-3, 1e-12), most)
    except RuntimeError:
        return None
    if axes.shape[1] < k or not values[-1] > 1e-6 * values[0]:
        return None
    axes, root = axes - axes.mean(0), np.sqrt(values)
    shared = arrays.sparkSession.sparkContext.broadcast(axes / root)
    total_of = (axes / root).sum(0)
    names = [f"__l{j}" for j in range(k)]

    def loadings(frames):
        for columns, at, val, sizes in _stacked(frames, max(CELLS // k, n)):
            mean, inverse, variance = _moments_of(n, scale, val, sizes)
            own = (_rows_times(shared.value, at, val, sizes) - np.outer(mean, total_of)) * inverse[:, None]
            yield pd.DataFrame(own, columns=names).assign(idx=columns["column"].to_numpy(), variance=variance)[["idx", "variance", *names]]

    found = by_column.mapInPandas(loadings, "idx int, variance double, " + ", ".join(f"{c} double" for c in names))
    found = checkpoint(found)
    largest = found.agg(F.sum("variance").alias("v"), *[F.max(F.struct(F.abs(c), -F.col("idx"), F.col(c).alias("x")))["x"].alias(c) for c in names]).first()
    sign = np.array([-1.0 if largest[c] < 0 else 1.0 for c in names])
    table = found.select("idx", *[(F.col(c) * float(s)).alias(c) for c, s in zip(names, sign, strict=True)])
    wide = pd.DataFrame(axes * root * sign, columns=[f"s{j}" for j in range(k)])
    wide.insert(0, "__place", np.arange(n))
    parts = [F.struct(F.lit(j + 1).alias("comp"), F.col(f"s{j}").alias("score")) for j in range(k)]
    placed = checkpoint(arrays.sparkSession.createDataFrame(wide))
    scores = arrays.select(row, "__place").join(placed, "__place").select(row, F.inline(F.array(*parts)))
    return scores, table, values / max(n * largest["v"], 1e-300)


def mds(
    matrix: DataFrame,
    row: str,
    col: str,
    value: str,
    k: int = 2,
    rows: DataFrame | None = None,
    max_iter: int = 100,
    tol: float = 1e-7,
) -> DataFrame:
    """Classical scaling of Euclidean distances → ``row, dim, coord``.

    The coordinates are the scores of centred, unscaled components, so the
    distances themselves are never formed.
    """
    scores, _ = pca(matrix, row, col, value, k, False, rows, max_iter, tol)
    return scores.select(row, F.col("comp").alias("dim"), F.col("score").alias("coord"))


def discriminant(coords: DataFrame, labels: DataFrame, item: str, x: str, y: str, cluster: str) -> DataFrame:
    """Project two coordinates on the axes that best part the clusters.

    Sums per cluster give the 2×2 scatter within and between clusters; the axes
    solve ``B v = λ W v`` with unit within-cluster variance.
    """
    joined = coords.join(labels, item)
    per = joined.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(x).alias("sx"),
        F.sum(y).alias("sy"),
        F.sum(F.col(x) * F.col(x)).alias("sxx"),
        F.sum(F.col(x) * F.col(y)).alias("sxy"),
        F.sum(F.col(y) * F.col(y)).alias("syy"),
    )
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    tot = per.agg(
        F.sum(n).alias("n"),
        F.count(F.lit(1)).alias("k"),
        F.sum(sx).alias("sx"),
        F.sum(sy).alias("sy"),
        *[F.sum(c).alias(c) for c in ("sxx", "sxy", "syy")],
        F.sum(sx * sx / n).alias("mxx"),
        F.sum(sx * sy / n).alias("mxy"),
        F.sum(sy * sy / n).alias("myy"),
    ).first()
    mean = np.array([tot["sx"], tot["sy"]]) / tot["n"]
    between = np.array([[tot["mxx"], tot["mxy"]], [tot["mxy"], tot["myy"]]])
    within = np.array([[tot["sxx"], tot["sxy"]], [tot["sxy"], tot["syy"]]]) - between
    between = between - tot["n"] * np.outer(mean, mean)
    within = within / max(tot["n"] - tot["k"], 1)
    root = np.linalg.inv(np.linalg.cholesky(within))
    values, axes = np.linalg.eigh(root @ between @ root.T)
    axes = (root.T @ axes)[:, np.argsort(values)[::-1]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), [0, 1]])
    return joined.select(
        item,
        cluster,
        *[(F.col(x) * float(axes[0, j]) + F.col(y) * float(axes[1, j])).alias(f"dc{j + 1}") for j in range(2)],
    )
