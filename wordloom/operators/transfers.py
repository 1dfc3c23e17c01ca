"""k-means by exact transfers: rows move while a single move lowers the within-cluster sum of squares.

Moving a row at squared distance d from the centre of its cluster (n rows) to a cluster of m rows at distance e changes the
sum by m / (m + 1) e - n / (n - 1) d, the centres' own moves included; so a row can gain by a transfer though its own
centre is the nearest.  A round rates the best move of every row in one pass.  Moves disturb each other, so the sums after
the best 1, 3, 7, 15 ... moves are computed as well, from what the moved rows add to the clusters' sums, and the best of
these batches is carried out; the single best move always lowers the sum, so rounds end, at labels that no transfer improves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wordloom.operators.prefix import dense_index
from wordloom.operators.verbs import join_on_keys
from wordloom.session import checkpoint

LEAST_GAIN = 1e-9  # relative to the row's share of the sum; less is rounding


def _cluster_sums(cells: DataFrame, labels: DataFrame) -> DataFrame:
    return cells.join(labels, "__row").groupBy("__cluster", "__col").agg(F.sum("__x").alias("__s"))


def _rated(cells: DataFrame, labels: DataFrame, sums: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """``__row, __cluster, to, gain``: the best other cluster of every row and how much the sum falls by moving there."""
    names = sorted(sizes)
    mean = [F.coalesce(F.max(F.when(F.col("__cluster") == c, F.col("__s"))), F.lit(0.0)) / sizes[c] for c in names]
    wide = sums.groupBy("__col").agg(*[m.alias(f"m{i}") for i, m in enumerate(mean)])
    norms = wide.agg(*[F.sum(F.col(f"m{i}") * F.col(f"m{i}")) for i in range(len(names))]).first()
    dots = cells.join(wide, "__col").groupBy("__row")
    dots = dots.agg(F.sum(F.col("__x") * F.col("__x")).alias("xx"), *[F.sum(F.col("__x") * F.col(f"m{i}")).alias(f"d{i}") for i in range(len(names))])
    rows = labels.join(dots, "__row", "left").fillna(0.0, subset=["xx", *[f"d{i}" for i in range(len(names))]])
    far = [F.greatest(F.col("xx") - 2 * F.col(f"d{i}") + F.lit(float(norms[i] or 0.0)), F.lit(0.0)) for i in range(len(names))]
    own, others = F.lit(None).cast("double"), []
    for i, c in enumerate(names):
        mine = F.col("__cluster") == c
        own = F.when(mine, far[i] * (sizes[c] / (sizes[c] - 1)) if sizes[c] > 1 else F.lit(None).cast("double")).otherwise(own)
        others.append(F.when(~mine, F.struct((far[i] * (sizes[c] / (sizes[c] + 1))).alias("cost"), F.lit(c).alias("to"))))
    best = F.array_min(F.array_compact(F.array(*others)))
    rated = rows.select("__row", "__cluster", own.alias("__own"), best.alias("__best"))
    return rated.select("__row", "__cluster", F.col("__best.to").alias("to"), (F.col("__own") - F.col("__best.cost")).alias("gain"), "__own")


def _prepared(matrix: DataFrame, labels: DataFrame, row: str, col: str, value: str, cluster: str) -> tuple[DataFrame, DataFrame]:
    cells = matrix.select(F.col(row).alias("__row"), F.col(col).alias("__col"), F.col(value).cast("double").alias("__x"))
    cells = cells.where("__x IS NOT NULL AND __x <> 0").groupBy("__row", "__col").agg(F.sum("__x").alias("__x"))
    return checkpoint(cells), checkpoint(labels.select(F.col(row).alias("__row"), F.col(cluster).cast("int").alias("__cluster")))


def _sizes(labels: DataFrame) -> dict[int, int]:
    return {r[0]: r[1] for r in labels.groupBy("__cluster").count().collect()}


def transfer_gains(
    matrix: DataFrame, labels: DataFrame, row: str = "document", col: str = "term", value: str = "n", cluster: str = "cluster"
) -> DataFrame:
    """``row, cluster, to, gain``: the best transfer of each labelled row (absent cells are zeros).

    The gain is the fall of the within-cluster sum of squares, negative if the move would raise it; NULL for the only row
    of a cluster.  Equal costs go to the smaller cluster number.
    """
    cells, held = _prepared(matrix, labels, row, col, value, cluster)
    rated = _rated(cells, held, _cluster_sums(cells, held), _sizes(held))
    return rated.select(F.col("__row").alias(row), F.col("__cluster").alias(cluster), "to", "gain")


def kmeans_transfers(
    matrix: DataFrame,
    labels: DataFrame,
    row: str = "document",
    col: str = "term",
    value: str = "n",
    cluster: str = "cluster",
    max_rounds: int = 200,
) -> DataFrame:
    """``row, cluster``: the labels after transfers until none lowers the within-cluster sum; clusters never empty.

    ``labels`` (a row per item, one label each) is the start, as from ``kmeans``.  RuntimeError after ``max_rounds`` rounds.
    """
    cells, held = _prepared(matrix, labels, row, col, value, cluster)
    for _ in range(max_rounds):
        sizes = _sizes(held)
        if len(sizes) < 2:
            break
        sums = checkpoint(_cluster_sums(cells, held))
        rated = _rated(cells, held, sums, sizes).where(F.col("gain") > LEAST_GAIN * F.col("__own"))
        moves = checkpoint(dense_index(checkpoint(rated), [F.desc("gain"), F.asc("__row")], "__rank"))
        count = moves.count()
        if not count:
            break
        # Batch j holds the best 2^(j+1) - 1 moves.
        level = F.floor(F.log2(F.col("__rank") + 1)).cast("int")
        last = (count).bit_length() - 1
        parted = moves.withColumn("__level", level)
        ends = F.array(
            F.struct(F.col("__cluster").alias("c"), F.lit(-1.0).alias("sign")), F.struct(F.col("to").alias("c"), F.lit(1.0).alias("sign"))
        )
        touched = parted.select("__row", "__level", F.inline(ends))
        batches = F.explode(F.sequence(F.col("__level"), F.lit(last))).alias("batch")
        shifts = touched.groupBy("__level", "c").agg(F.sum("sign").alias("n")).select(batches, "c", "n").groupBy("batch", "c").agg(F.sum("n").alias("n"))
        change = cells.join(touched, "__row").groupBy("__level", F.col("c").alias("__cluster"), "__col").agg(F.sum(F.col("sign") * F.col("__x")).alias("__d"))
        change = change.select(batches, "__cluster", "__col", "__d").groupBy("batch", "__cluster", "__col").agg(F.sum("__d").alias("__d"))
        change = join_on_keys(change, sums, ["__cluster", "__col"], "left", null_safe=True)
        grown = F.col("__d") * (2 * F.coalesce("__s", F.lit(0.0)) + F.col("__d"))
        squares = {(r[0], r[1]): r[2] for r in change.groupBy("batch", "__cluster").agg(F.sum(grown)).collect()}
        moved = {(r[0], r[1]): int(r[2]) for r in shifts.collect()}
        whole = {r[0]: r[1] for r in sums.groupBy("__cluster").agg(F.sum(F.col("__s") * F.col("__s"))).collect()}
        explained = {}  # the within sum falls by what this sum rises
        for batch in range(last + 1):
            after = {c: n + moved.get((batch, c), 0) for c, n in sizes.items()}
            if min(after.values()) > 0:
                explained[batch] = sum((whole.get(c, 0.0) + squares.get((batch, c), 0.0)) / after[c] for c in sizes)
        best = max(explained, key=lambda b: (explained[b], -b))
        if explained[best] <= sum(whole.get(c, 0.0) / sizes[c] for c in sizes):
            break  # what is left is rounding
        taken = parted.where(F.col("__level") <= best).select("__row", "to")
        held = checkpoint(held.join(taken, "__row", "left").select("__row", F.coalesce("to", "__cluster").alias("__cluster")))
    else:
        raise RuntimeError(f"transfers go on after {max_rounds} rounds")
    return held.select(F.col("__row").alias(row), F.col("__cluster").alias(cluster))
