"""Local regression at any number of rows: rows are only counted and summed where they are.

The rows are neither sorted, copied to the grid points nor put into windows:

1. Bandwidths.  The distance to the q-th nearest row is bounded from a histogram of x: a bin's smallest and largest distance
   to a grid point give a lower and an upper bound of it.  Only bins between both bounds are counted again, more finely,
   until the bounds meet.  A pass divides what is open by some hundreds.
2. Moments.  Between two neighbouring ones of all x0 and x0 +- h, the tricube weight of each grid point is a polynomial.  One
   aggregate sums the powers of x (about the middle of such a segment, scaled to -1..1) and their products with y.  A grid
   point's weighted moments follow from its segments' sums by the binomial theorem with coefficients of at most 1.
3. The band's residuals and degrees of freedom are linear between grid points, so they too follow from the segments.

A group has at most 3 x ``points`` segments and some thousand bins, whatever its number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

from pyspark.sql import Column, DataFrame, functions as F

from wordloom.operators.verbs import aslist, join_on_keys
from wordloom.session import checkpoint

GRID_POINTS = 80
BINS, FINE = 4096, 256
# Degrees: squared weight (18) times u^4, weight (9) times u^4, weight times u^2.
POWERS, FIT_POWERS, CROSS = 22, 13, 11


def _attach(rows: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """The table's columns at the rows of its group; without groups it has one row."""
    if by:
        return join_on_keys(rows, table, by, null_safe=True)
    return rows.withColumns({c: table.select(c).scalar() for c in table.columns})


def _at_most(edges: Column, x: Column) -> Column:
    """How many of the ascending edges are at most x, by bisection."""
    steps = F.array(*[F.lit(1 << k) for k in range(11, -1, -1)])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when((at + step <= F.size(edges)) & (F.get(edges, at + step - 1) <= x), at + step).otherwise(at),
    )


# --- bandwidths --------------------------------------------------------------


def _counted(rows: DataFrame, keys: list) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("__x").alias("a"), F.max("__x").alias("b"), F.count(F.lit(1)).alias("n"))


def _bin(left: Column, right: Column, bins: int) -> Column:
    return F.when(right > left, F.least(F.floor((F.col("__x") - left) / (right - left) * bins), F.lit(bins - 1))).otherwise(0)


def _narrowed(state: DataFrame, by: list[str]) -> DataFrame:
    """Bounds ``hl <= h <= hu`` of each grid point's bandwidth; ``open`` are the cells between them with several x."""
    nearest = "CASE WHEN c.a > x0 THEN c.a - x0 WHEN c.b < x0 THEN x0 - c.b ELSE 0D END"
    farthest = "greatest(abs(c.a - x0), abs(c.b - x0))"

    def kth(distance: str, known: str) -> Column:
        pairs = f"array_sort(transform(cells, c -> struct({distance} AS d, c.n AS n)))"
        start = "named_struct('c', base, 'd', CAST(NULL AS DOUBLE))"
        step = "named_struct('c', s.c + p.n, 'd', CASE WHEN s.d IS NULL AND s.c + p.n >= q THEN p.d ELSE s.d END)"
        return F.expr(f"coalesce(aggregate({pairs}, {start}, (s, p) -> {step}, s -> s.d), {known})")

    # What is decided has no cells left and keeps its bounds.
    out = state.withColumns({"hl": kth(nearest, "hl"), "hu": kth(farthest, "hu")})
    out = out.withColumn("base", F.expr(f"base + aggregate(filter(cells, c -> {farthest} < hl), 0L, (s, c) -> s + c.n)"))
    between = f"filter(cells, c -> hl < hu AND {nearest} <= hu AND {farthest} >= hl AND {nearest} {{0}} {farthest})"
    return out.select(
        *by, "__i", "x0", "q", "base", "hl", "hu", F.expr(between.format(">=")).alias("cells"), F.expr(between.format("<")).alias("open")
    )


def _bandwidths(rows: DataFrame, totals: DataFrame, by: list[str], span: float, points: int) -> DataFrame:
    """``by, __i, x0, hl``: the grid and the exact distance to the ``floor(n * span)``-th nearest row."""
    placed = _attach(rows, totals.select(*by, "__lo", "__hi"), by)
    bins = _counted(placed, [*by, _bin(F.col("__lo"), F.col("__hi"), BINS).alias("__bin")])
    cells = bins.groupBy(*by).agg(F.collect_list(F.struct("a", "b", "n")).alias("cells"))
    q = F.least(F.greatest(F.floor(F.col("__n") * span + 1e-5), F.lit(1)), F.col("__n"))
    state = _attach(totals, cells, by).select(
        *by, "__lo", "__hi", "cells", q.alias("q"), F.lit(0).cast("bigint").alias("base"), F.lit(None).cast("double").alias("hl"),
        F.lit(None).cast("double").alias("hu"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("__i")
    )
    state = state.withColumn("x0", F.col("__lo") + F.col("__i") * ((F.col("__hi") - F.col("__lo")) / (points - 1)))
    while True:
        state = checkpoint(_narrowed(state, by))
        todo = state.select(*by, "__i", F.explode("open").alias("c")).select(*by, "__i", F.col("c.a").alias("__left"), F.col("c.b").alias("__right"))
        if todo.isEmpty():
            return state.select(*by, "__i", "x0", "hl")
        spans = todo.groupBy(*by).agg(F.array_sort(F.collect_set(F.struct("__left", "__right"))).alias("__spans"))
        spans = spans.select(*by, F.col("__spans.__left").alias("__starts"), F.col("__spans.__right").alias("__ends"))
        inside = _attach(rows, spans, by).withColumn("__at", _at_most(F.col("__starts"), F.col("__x")))
        inside = inside.withColumn("__left", F.get("__starts", F.col("__at") - 1)).withColumn("__right", F.get("__ends", F.col("__at") - 1))
        inside = inside.where(F.col("__x") <= F.col("__right"))
        fine = _counted(inside, [*by, "__left", _bin(F.col("__left"), F.col("__right"), FINE).alias("__bin")])
        fine = fine.groupBy(*by, "__left").agg(F.collect_list(F.struct("a", "b", "n")).alias("__fine"))
        more = join_on_keys(todo.drop("__right"), fine, [*by, "__left"], null_safe=True)
        more = more.groupBy(*by, "__i").agg(F.flatten(F.collect_list("__fine")).alias("__more"))
        state = join_on_keys(state, more, [*by, "__i"], "left", null_safe=True)
        state = state.withColumn("cells", F.when(F.col("__more").isNull(), F.col("cells")).otherwise(F.concat("cells", "__more"))).drop("__more", "open")


# --- moments -----------------------------------------------------------------


def _with_powers(df: DataFrame, n: int) -> DataFrame:
    """``p0 .. pn``, the powers of ``p1``, each from two lower ones."""
    df, top = df.withColumn("p0", F.lit(1.0)), 1
    while top < n:
        more = range(top + 1, min(2 * top, n) + 1)
        df = df.withColumns({f"p{k}": F.expr(f"p{top} * p{k - top}") for k in more})
        top = more[-1]
    return df


def _segments(rows: DataFrame, totals: DataFrame, widths: DataFrame, by: list[str], powers: int) -> DataFrame:
    """Sums of powers between neighbouring edges: ``by, c`` (middle)``, s`` (half width)``, v, w`` (with y)``, yy, a, b``."""
    marks = widths.select(*by, F.explode(F.array(F.col("x0"), F.col("x0") - F.col("hl"), F.col("x0") + F.col("hl"))).alias("e"))
    marks = _attach(marks, totals.select(*by, "__lo", "__hi"), by).where((F.col("e") >= F.col("__lo")) & (F.col("e") <= F.col("__hi")))
    edges = marks.groupBy(*by).agg(
        F.array_sort(F.array_distinct(F.concat(F.collect_set("e"), F.array(F.max("__lo"), F.max("__hi"))))).alias("__edges")
    )
    placed = _attach(rows, checkpoint(edges), by)
    placed = _attach(placed, totals.select(*by, "__mean"), by)
    at = F.least(_at_most(F.col("__edges"), F.col("__x")), F.greatest(F.size("__edges") - 1, F.lit(1)))
    placed = placed.withColumn("__at", at)
    left = F.get("__edges", F.col("__at") - 1)
    right = F.coalesce(F.get("__edges", F.col("__at")), left)
    placed = placed.withColumn("c", (left + right) / 2).withColumn("s", (right - left) / 2)
    v = F.when(F.col("s") > 0, (F.col("__x") - F.col("c")) / F.col("s")).otherwise(0.0)
    placed = placed.select(*by, "__at", "c", "s", "__x", (F.col("__y") - F.col("__mean")).alias("__y"), v.alias("p1"))
    sums = _with_powers(placed, powers).groupBy(*by, "__at", "c", "s").agg(
        F.expr(f"array({', '.join(f'sum(p{k})' for k in range(powers + 1))})").alias("v"),
        F.expr(f"array({', '.join(f'sum(p{k} * __y)' for k in range(CROSS + 1))})").alias("w"),
        F.expr("sum(__y * __y)").alias("yy"),
        F.min("__x").alias("a"),
        F.max("__x").alias("b"),
    )
    return sums.drop("__at")


def _shifted(sums: str, n: int) -> Column:
    """Sums of (shift + scale * v)^p for p = 0..n from the sums of v^p; columns ``shift`` and ``scale`` add up to 1 at most."""
    moved = "zip_with(slice(s.t, 1, size(s.t) - 1), slice(s.t, 2, size(s.t) - 1), (x, y) -> __shift * x + __scale * y)"
    first = "concat(s.u, array(__shift * s.t[0] + __scale * s.t[1]))"
    start = f"named_struct('t', {sums}, 'u', slice({sums}, 1, 1))"
    return F.expr(f"aggregate(sequence(1, {n}), {start}, (s, i) -> named_struct('t', {moved}, 'u', {first}), s -> s.u)")


def _tricube(u: str, j: int, power: int) -> Column:
    """Sum of (1 - |u|^3)^power * u^j from the sums of the powers of u, all of one sign ``__side``."""
    terms = [f"{comb(power, k) * (-1) ** k} * {u}[{3 * k + j}]" + (" * __side" if k % 2 else "") for k in range(power + 1)]
    return F.expr(" + ".join(terms))


def _solve_intercept(s: list[Column], t: list[Column]) -> tuple[Column, list[Column]]:
    """First coefficient of a weighted quadratic, and the first row of the
    inverse moment matrix, from moments ``s[0..4]`` and ``t[0..2]``."""
    c0 = s[2] * s[4] - s[3] * s[3]
    c1 = s[2] * s[3] - s[1] * s[4]
    c2 = s[1] * s[3] - s[2] * s[2]
    det = s[0] * c0 + s[1] * c1 + s[2] * c2
    row = [F.try_divide(c, det) for c in (c0, c1, c2)]
    return row[0] * t[0] + row[1] * t[1] + row[2] * t[2], row


def _fits(segments: DataFrame, widths: DataFrame, by: list[str], powers: int) -> DataFrame:
    """``by, __i, x, y`` (less the mean)``, __lev, __norm``: the fit, the weight a point at the grid value gives itself, and
    the sum of the squared weights of all points."""
    listed = segments.groupBy(*by).agg(F.collect_list(F.struct("c", "s", "v", "w", "a", "b")).alias("__segments"))
    near = F.filter("__segments", lambda g: F.abs(g["c"] - F.col("x0")) < F.col("hl"))
    # The pairs of a group are dealt by grid point before they are made.
    pairs = _attach(widths.where("hl > 0"), listed, by).repartition(*by, "__i").select(*by, "__i", "x0", "hl", F.inline(near))
    offset = F.col("c") - F.col("x0")
    pairs = pairs.withColumn("__shift", offset / F.col("hl")).withColumn("__scale", F.col("s") / F.col("hl"))
    pairs = pairs.withColumn("__side", F.when(offset >= 0, 1.0).otherwise(-1.0))
    pairs = pairs.withColumns({"u": _shifted("v", powers), "z": _shifted("w", CROSS)})
    # Other x than the segment's ends: then its points do not all lie on its ends.
    low, high = ((F.col(e) - F.col("c")) / F.col("s") for e in ("a", "b"))
    v = [F.get("v", F.lit(k)) for k in range(3)]
    inner = F.coalesce((low + high) * v[1] - low * high * v[0] - v[2] > 1e-12 * v[0], F.lit(False))
    ends = F.array_compact(F.array(*[F.when(F.abs(F.col(e) - F.col("x0")) < F.col("hl"), F.col(e)) for e in ("a", "b")]))
    fits = pairs.groupBy(*by, "__i", "x0").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(ends)))).alias("__k"),
        F.max(inner).alias("__inner"),
        *[F.sum(_tricube("u", j, 3)).alias(f"s{j}") for j in range(5)],
        *[F.sum(_tricube("z", j, 3)).alias(f"t{j}") for j in range(3)],
        *[(F.sum(_tricube("u", j, 6)) if powers == POWERS else F.lit(None).cast("double")).alias(f"n{j}") for j in range(5)],
    )
    s, t, n = ([F.col(f"{name}{j}") for j in range(k)] for name, k in (("s", 5), ("t", 3), ("n", 5)))
    fit, (a, b, c) = _solve_intercept(s, t)
    norm = a * a * n[0] + 2 * a * b * n[1] + (b * b + 2 * a * c) * n[2] + 2 * b * c * n[3] + c * c * n[4]
    enough = (F.col("__k") + F.col("__inner").cast("int")) >= 3
    return fits.select(
        *by, "__i", F.col("x0").alias("x"), F.when(enough, fit).alias("y"), F.when(enough, a).alias("__lev"), F.when(enough, norm).alias("__norm")
    )


def _t_quantile_975(df: Column) -> Column:
    """97.5 % point of Student's t: tabled up to 6 degrees of freedom (interpolated in 1/df), above by its expansion in
    1/df, which is then within 0.001; NULL without degrees of freedom, the value for 1 below 1."""
    z = 1.959963984540054
    g = (
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    series = F.lit(z) + sum((c / F.pow(df, n) for n, c in enumerate(g, 1)), F.lit(0.0))
    # 97.5 % points for few degrees of freedom, between which 1/df is interpolated.
    points = {1: 12.706204736432095, 2: 4.302652729911275, 3: 3.182446305284263, 4: 2.7764451051977987}
    points |= {5: 2.5705818366147395, 6: 2.4469118511449692}
    out = F.when(df <= 0, F.lit(None)).when(df <= 1, F.lit(points[1]))
    for n in range(1, 6):
        part = (1 / df - 1 / (n + 1)) / (1 / n - 1 / (n + 1))
        out = out.when(df <= n + 1, points[n + 1] + part * (points[n] - points[n + 1]))
    return out.otherwise(series)


def _noise(segments: DataFrame, fits: DataFrame, totals: DataFrame, by: list[str], points: int) -> DataFrame:
    """``by, __rss, __free``: squared residuals and degrees of freedom, the fits interpolated between grid points."""
    placed = _attach(segments, totals.select(*by, "__lo", "__hi"), by)
    step = (F.col("__hi") - F.col("__lo")) / (points - 1)
    cell = F.least(F.greatest(F.floor((F.col("c") - F.col("__lo")) / step), F.lit(0)), F.lit(points - 2))
    placed = placed.where(F.col("__hi") > F.col("__lo")).withColumn("__i", cell.cast("int"))
    placed = placed.withColumn("__f", (F.col("c") - F.col("__lo")) / step - F.col("__i")).withColumn("__g", F.col("s") / step)
    names = ("y", "__lev", "__norm")
    left = fits.select(*by, "__i", *[F.col(c).alias(f"{c}_l") for c in names])
    right = fits.select(*by, (F.col("__i") - 1).alias("__i"), *[F.col(c).alias(f"{c}_r") for c in names])
    ends = join_on_keys(left, right, [*by, "__i"], null_safe=True)
    placed = join_on_keys(placed, ends, [*by, "__i"], null_safe=True)

    def line(name: str) -> tuple[Column, Column]:
        rise = F.col(f"{name}_r") - F.col(f"{name}_l")
        return F.col(f"{name}_l") + rise * F.col("__f"), rise * F.col("__g")

    v, w = ([F.get(name, F.lit(k)) for k in range(3)] for name in ("v", "w"))
    (p, q), (l0, l1), (m0, m1) = (line(name) for name in names)
    rss = F.col("yy") - 2 * (p * w[0] + q * w[1]) + p * p * v[0] + 2 * p * q * v[1] + q * q * v[2]
    free = (1 - 2 * l0 + m0) * v[0] + (m1 - 2 * l1) * v[1]
    return placed.groupBy(*by).agg(F.sum(rss).alias("__rss"), F.sum(free).alias("__free"))


def loess(
    df: DataFrame,
    x: str,
    y: str,
    by: Sequence[str] = (),
    span: float = 0.75,
    points: int = GRID_POINTS,
    se: bool = False,
) -> DataFrame:
    """Locally weighted quadratic fit on an even grid → ``by, x, y``.

    Tricube weights over the nearest ``floor(n·span)`` rows.  A place with
    fewer than three distinct x in reach gives NULL or no row; rows without x
    or y take no part.  With ``se`` a 95 % band is added: the residual variance
    and the degrees of freedom are taken from the grid fits, interpolated to
    the rows.  ``points`` may be up to 1,300.
    """
    by = aslist(by)
    value, at = F.col(y).cast("double"), F.col(x).cast("double")
    rows = df.where(value.isNotNull() & at.isNotNull() & ~F.isnan(at)).select(*by, at.alias("__x"), value.alias("__y"))
    rows = checkpoint(rows)
    totals = rows.groupBy(*by).agg(
        F.min("__x").alias("__lo"), F.max("__x").alias("__hi"), F.count(F.lit(1)).alias("__n"), F.avg("__y").alias("__mean")
    )
    totals = checkpoint(totals.where("__n > 0"))
    widths = _bandwidths(rows, totals, by, span, points)
    powers = POWERS if se else FIT_POWERS
    segments = _segments(rows, totals, widths, by, powers)
    if se:
        segments = checkpoint(segments)
    fits = _fits(segments, widths, by, powers)
    if se:
        fits = checkpoint(fits)
    out = _attach(fits, totals.select(*by, "__mean"), by).withColumn("y", F.col("y") + F.col("__mean"))
    if not se:
        return out.select(*by, "x", "y")
    banded = _attach(out, _noise(segments, fits, totals, by, points), by)
    error = F.sqrt(F.try_divide(F.greatest("__rss", F.lit(0.0)), F.col("__free")) * F.col("__norm"))
    reach = error * _t_quantile_975(F.col("__free"))
    return banded.select(*by, "x", "y", error.alias("se"), (F.col("y") - reach).alias("ymin"), (F.col("y") + reach).alias("ymax"))
