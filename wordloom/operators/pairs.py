"""Co-occurrence counts and correlations of items over features.

Counts for all pairs are a block matrix product.  Items get numbers, and presence
rows are cut into cells of two blocks of ``BLOCK`` items (in the order of a hash,
so a hot feature's items spread over all blocks).  A task counts one cell: with at
most ``CHUNK`` features, a pair's count is known there and is not shuffled again.
Counts for a short list of items need no product: each row meets the listed
items of its feature.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wordloom.operators.prefix import dense_index
from wordloom.operators.verbs import aslist
from wordloom.session import checkpoint

BLOCK = 2048
CHUNK = 1 << 18
CELL_FEATURES, CELL_ROWS = 1 << 20, 4_000_000  # of a cell of correlated pairs; one that need not be split decides its pairs
SLICE = 512  # features that are counted at once
DENSE = 600  # a product of dense matrices takes so many cells in the time of one counted pair


def _presence(df: DataFrame, item: str, feature: str, by: Sequence[str]) -> DataFrame:
    """Distinct presence rows, written once: several passes read them, and they
    are far smaller than the text they come from."""
    return checkpoint(
        df.where(F.col(item).isNotNull() & F.col(feature).isNotNull())
        .select(*by, F.col(feature).alias("__feature"), F.col(item).alias("__item"))
        .distinct()
    )


def _listed_counts(presence: DataFrame, by: Sequence[str], items: Sequence) -> DataFrame:
    """Counts with ``item1`` in a given list."""
    at = [*by, "__feature"]
    listed = (
        presence.where(F.col("__item").isin(*items)).groupBy(*at).agg(F.collect_set("__item").alias("__listed"))
    )
    met = presence.join(listed, at).select(*by, F.explode("__listed").alias("item1"), F.col("__item").alias("item2"))
    return met.where(F.col("item1") != F.col("item2")).groupBy(*by, "item1", "item2").agg(F.count(F.lit(1)).alias("n"))


def _cell_counts(feature, place, left, right, block: int):
    """Common features of the ``left`` and the ``right`` items of a cell, by their places in their blocks.

    Slices of features are multiplied as dense matrices, or, where few items meet, counted pair by pair.
    """
    import numpy as np

    order = np.argsort(feature, kind="stable")
    feature, place, left, right = feature[order], place[order], left[order], right[order]
    code = np.cumsum(np.append(True, feature[1:] != feature[:-1])) - 1
    counts, one = np.zeros((block, block), np.int32), np.ones(1, np.int32)
    for start in range(0, int(code[-1]) + 1, SLICE):
        a, b = np.searchsorted(code, [start, start + SLICE])
        sides = [(code[a:b][own[a:b]] - start, place[a:b][own[a:b]]) for own in (left, right)]
        (f, x), (g, y) = sides
        held = np.bincount(g, minlength=SLICE)
        meets = held[f]
        if int(meets.sum()) * DENSE > SLICE * block * block:
            hits = np.zeros((2, SLICE, block), np.float32)
            for own, (k, at) in zip(hits, sides, strict=True):
                own[k, at] = 1.0
            counts += (hits[0].T @ hits[1]).astype(np.int32)
        else:
            first = (np.cumsum(held) - held)[f] - (np.cumsum(meets) - meets)
            partner = y[np.arange(meets.sum()) + np.repeat(first, meets)]
            np.add.at(counts.reshape(-1), np.repeat(x * block, meets) + partner, one)
    return counts


def _cell_counter(block: int):
    def count_cell(cell):
        import numpy as np
        import pyarrow as pa

        start, lo, hi = (cell.column(c)[0].as_py() for c in ("__first", "__lo", "__hi"))
        own, place = np.divmod(cell.column("__id").to_numpy() - start, block)
        counts = _cell_counts(cell.column("__f").to_numpy(), place, own == lo, own == hi, block)
        if lo == hi:
            counts = np.triu(counts, 1)
        a, b = np.nonzero(counts)
        return pa.table({"a": start + lo * block + a, "b": start + hi * block + b, "n": counts[a, b].astype(np.int64)})

    return count_cell


def _block_counts(presence: DataFrame, by: Sequence[str], block: int, chunk: int) -> DataFrame:
    """Counts of unordered pairs ``__a, __b, n``."""
    items = presence.select(*by, "__item").distinct()
    ids = checkpoint(dense_index(items, [*(F.asc(c) for c in by), F.xxhash64("__item").asc(), F.asc("__item")], "__id"))
    if by:
        groups = ids.groupBy(*[F.col(c).alias(f"__by{k}") for k, c in enumerate(by)])
        groups = groups.agg(F.min("__id").alias("__first"), F.max("__id").alias("__end"))
        grouped = ids.join(groups, [F.col(c).eqNullSafe(F.col(f"__by{k}")) for k, c in enumerate(by)])
    else:
        grouped = ids.withColumns({"__first": F.lit(0).cast("long"), "__end": ids.agg(F.max("__id")).scalar()})
    grouped = grouped.select(
        *[F.col(c).alias(f"__by{k}") for k, c in enumerate(by)], F.col("__item").alias("__name"), "__id", "__first",
        F.floor((F.col("__id") - F.col("__first")) / block).cast("int").alias("__block"),
        F.floor((F.col("__end") - F.col("__first")) / block).cast("int").alias("__last"),
    )
    features = presence.select("__feature").distinct().count()
    chunks = max(1, -(-features // chunk))
    same = [F.col("__item") == F.col("__name"), *(F.col(c).eqNullSafe(F.col(f"__by{k}")) for k, c in enumerate(by))]
    cells = (
        presence.join(grouped, same)
        .select("__first", "__id", "__block", F.xxhash64("__feature").alias("__f"), F.explode(F.sequence(F.lit(0), "__last")).alias("__other"))
        .withColumn("__lo", F.least("__block", "__other"))
        .withColumn("__hi", F.greatest("__block", "__other"))
        .select("__first", "__lo", "__hi", F.pmod("__f", F.lit(chunks)).cast("int").alias("__chunk"), "__id", "__f")
    )
    counted = cells.groupBy("__first", "__lo", "__hi", "__chunk").applyInArrow(_cell_counter(block), "a long, b long, n long")
    if chunks > 1:
        counted = counted.groupBy("a", "b").agg(F.sum("n").alias("n"))
    named = counted.join(ids.select(*by, F.col("__item").alias("__a"), F.col("__id").alias("a")), "a")
    return named.join(ids.select(F.col("__item").alias("__b"), F.col("__id").alias("b")), "b").select(*by, "__a", "__b", "n")


def pairwise_count(
    df: DataFrame,
    item: str,
    feature: str,
    by: Sequence[str] = (),
    items: Sequence | None = None,
    block: int = BLOCK,
    chunk: int = CHUNK,
) -> DataFrame:
    """Number of features that hold both items → ``[by,] item1, item2, n``.

    Both orders of a pair appear; no item meets itself.  ``items`` limits
    ``item1`` to a short list.
    """
    by = aslist(by)
    return _counts(_presence(df, item, feature, by), by, items, block, chunk)


def _counts(presence: DataFrame, by: Sequence[str], items: Sequence | None, block: int, chunk: int) -> DataFrame:
    if items is not None:
        return _listed_counts(presence, by, list(items))
    half = _block_counts(presence, by, block, chunk)
    both = F.array(
        F.struct(F.col("__a").alias("item1"), F.col("__b").alias("item2")),
        F.struct(F.col("__b").alias("item1"), F.col("__a").alias("item2")),
    )
    return half.select(*by, F.inline(both), "n").select(*by, "item1", "item2", "n")


def pairwise_cor(
    df: DataFrame,
    item: str,
    feature: str,
    dense: bool = False,
    items: Sequence | None = None,
    block: int = BLOCK,
    chunk: int = CHUNK,
    above: float | None = None,
) -> DataFrame:
    """Phi coefficient of presence → ``item1, item2, correlation``.

    An item present in every feature has no correlation and gives no row.
    ``above`` keeps correlations over a positive limit only, without counting
    the pairs whose numbers of features are too different to reach it.
    ``dense`` also returns pairs that never meet; it needs ``items``, because
    all pairs of a whole vocabulary are not a useful table.
    """
    presence = _presence(df, item, feature, [])
    if above is not None and above > 0 and items is None and not dense:
        return _correlated(presence, above, block)
    holding = checkpoint(presence.groupBy("__item").agg(F.count(F.lit(1)).alias("d")))  # its size is known to the joins below
    features = presence.select("__feature").distinct().agg(F.count(F.lit(1))).scalar().cast("double")
    counts = _counts(presence, [], items, block, chunk)
    first = holding.select(F.col("__item").alias("item1"), F.col("d").cast("double").alias("d1"))
    second = holding.select(F.col("__item").alias("item2"), F.col("d").cast("double").alias("d2"))
    if dense:
        if items is None:
            raise ValueError("dense correlations need a list of items")
        grid = second.withColumn("item1", F.explode(F.array(*[F.lit(i) for i in items])))
        grid = grid.where(F.col("item1") != F.col("item2"))
        pairs = grid.join(counts, ["item1", "item2"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    else:
        pairs = counts.join(second, "item2")
    pairs = pairs.join(first, "item1").withColumn("__N", features)
    out = pairs.select("item1", "item2", _phi().alias("correlation")).where(F.col("correlation").isNotNull())
    return out if above is None else out.where(F.col("correlation") > above)


def _phi() -> Column:
    spread = F.sqrt(F.col("d1") * (F.col("__N") - F.col("d1"))) * F.sqrt(F.col("d2") * (F.col("__N") - F.col("d2")))
    return F.try_divide(F.col("__N") * F.col("n") - F.col("d1") * F.col("d2"), spread)


# --- correlations over a limit -------------------------------------------------


def reachable_blocks(fewest: list[int], most: list[int], features: int, above: float) -> list[int]:
    """For blocks of items in descending order of their numbers of features, the last one that each can reach.

    A pair shares at most the features of its rarer item (d of them, the other D), so phi is at most
    sqrt(d (N - D) / (D (N - d))); for a given D it takes d > limit**2 D N / (N - D + limit**2 D), which grows with D.
    """
    out, last = [], len(fewest) - 1
    for b in range(len(fewest) - 1, -1, -1):
        least = above**2 * fewest[b] * features / max(features - fewest[b] + above**2 * fewest[b], 1e-300)
        while last > b and most[last] <= least * (1 - 1e-9):
            last -= 1
        out.append(max(last, b))
    return out[::-1]


def _correlated_cells(features: int, above: float, block: int):
    def count_cell(cell):
        import numpy as np
        import pyarrow as pa

        lo, hi, chunks = (cell.column(c)[0].as_py() for c in ("__lo", "__hi", "__chunks"))
        item = cell.column("__id").to_numpy()
        own, place = np.divmod(item, block)
        held = np.zeros((2, block))
        for d, b in zip(held, (lo, hi), strict=True):
            d[place[own == b]] = cell.column("d").to_numpy()[own == b]
        counts = _cell_counts(cell.column("__f").to_numpy(), place, own == lo, own == hi, block)
        found = []
        for start in range(0, block, 256):
            n = counts[start : start + 256]
            d1, d2 = held[0][start : start + 256, None], held[1][None, :]
            low, high = np.minimum(d1, d2), np.maximum(d1, d2)
            keep = (n > 0) & (low * (features - high) >= above**2 * high * (features - low) * (1 - 1e-9))
            if chunks == 1:  # the cell holds all features: the pair is decided here, up to rounding
                limit = above * np.sqrt(d1 * (features - d1)) * np.sqrt(d2 * (features - d2))
                keep &= features * n.astype(np.float64) - d1 * d2 >= limit * (1 - 1e-9)
            if lo == hi:
                keep = np.triu(keep, 1 + start)
            a, b = np.nonzero(keep)
            found.append((a + start + lo * block, b + hi * block, n[a, b].astype(np.int64)))
        return pa.table(dict(zip(("a", "b", "n"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return count_cell


def _correlated(presence: DataFrame, above: float, block: int) -> DataFrame:
    """Pairs with phi over a positive limit.

    Items get ids by descending number of features, so a block of ids has similar numbers, and cells of two blocks
    without a pair that could reach the limit are never made.  The driver sees three numbers per block.
    """
    spark = presence.sparkSession
    holding = checkpoint(presence.groupBy("__item").agg(F.count(F.lit(1)).alias("d")))
    ids = checkpoint(dense_index(holding, [F.desc("d"), F.asc("__item")], "__id"))
    features = presence.select("__feature").distinct().count()
    blocks = ids.groupBy(F.floor(F.col("__id") / block).cast("int").alias("__block"))
    blocks = sorted(tuple(r) for r in blocks.agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.sum("d").alias("rows")).collect())
    last = reachable_blocks([b[1] for b in blocks], [b[2] for b in blocks], features, above)
    least = max(1, -(-features // CELL_FEATURES))
    cells = [(a, b, max(least, -(-(blocks[a][3] + (b > a) * blocks[b][3]) // CELL_ROWS))) for a in range(len(last)) for b in range(a, last[a] + 1)]
    reach = [(own, a, b, n) for a, b, n in cells for own in {a, b}]
    reach = spark.createDataFrame(reach, "__block int, __lo int, __hi int, __chunks int")
    rows = presence.join(ids, "__item").select(
        "__id", "d", F.xxhash64("__feature").alias("__f"), F.floor(F.col("__id") / block).cast("int").alias("__block")
    )
    rows = rows.join(reach, "__block").withColumn("__chunk", F.expr("pmod(__f, __chunks)").cast("int")).drop("__block")
    counted = rows.groupBy("__lo", "__hi", "__chunk").applyInArrow(_correlated_cells(features, above, block), "a long, b long, n long")
    if any(n > 1 for *_, n in cells):
        counted = counted.groupBy("a", "b").agg(F.sum("n").alias("n"))
    named = [ids.select(F.col("__id").alias(k), F.col("__item").alias(f"item{i}"), F.col("d").cast("double").alias(f"d{i}")) for k, i in (("a", 1), ("b", 2))]
    pairs = counted.join(named[0], "a").join(named[1], "b").withColumn("__N", F.lit(float(features)))
    pairs = pairs.select("item1", "item2", _phi().alias("correlation")).where(F.col("correlation") > above)
    both = F.array(F.struct("item1", "item2"), F.struct(F.col("item2").alias("item1"), F.col("item1").alias("item2")))
    return pairs.select(F.inline(both), "correlation")
