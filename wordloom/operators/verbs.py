"""Table verbs: counting, shares, ranking with ties, joins, reshaping.

Totals are computed with ``groupBy`` (which combines map-side) and joined back
on their keys, never with a window over the group: a group that holds a third
of all rows then costs one partial row per task instead of one huge task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


def aslist(x) -> list:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


def join_on_keys(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", null_safe: bool = False
) -> DataFrame:
    """Equi-join on same-named keys; the right copies of the keys are dropped.

    ``null_safe`` lets NULL keys meet, as grouping does.
    """
    keys = aslist(keys)
    if not null_safe:
        return left.join(right, keys, how)
    marks = {k: f"__r_{k}" for k in keys}
    renamed = right.select(
        *[F.col(k).alias(marks[k]) for k in keys],
        *[F.col(c) for c in right.columns if c not in marks],
    )
    cond = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(marks[k])) for k in keys]
    )
    return left.join(renamed, cond, how).drop(*marks.values())


def attach_totals(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Add group aggregates to every row.  No keys: one scalar sub-query each."""
    keys = aslist(keys)
    if not keys:
        for name, agg in aggs.items():
            df = df.withColumn(name, df.agg(agg).scalar())
        return df
    totals = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return join_on_keys(df, totals, keys, "left", null_safe=True)


# --- counting --------------------------------------------------------------


def count_by(df: DataFrame, keys: Sequence[str], sort: bool = False, name: str = "n") -> DataFrame:
    """Rows per key combination; ``sort`` orders by count, then keys."""
    keys = aslist(keys)
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return out.orderBy(F.desc(name), *keys) if sort else out


def tally(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Tokens per key combination, where a column ``n`` (if there is one) says how many tokens a row stands for."""
    tokens = F.sum("n") if "n" in df.columns else F.count(F.lit(1))
    return df.groupBy(*aslist(keys)).agg(tokens.alias(name))


def having_count(df: DataFrame, keys: Sequence[str], condition: Column, name: str = "n") -> DataFrame:
    """Count by keys, then keep the groups that meet a condition on the count."""
    return count_by(df, keys, name=name).where(condition)


def words_in_all(df: DataFrame, item: str, group: str) -> DataFrame:
    """Items that occur in every group."""
    per_item = df.select(group, item).distinct().groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    groups = df.select(group).distinct().agg(F.count(F.lit(1))).scalar()
    return per_item.where(F.col("n") == groups)


def keep_frequent(df: DataFrame, item: str, min_n: int) -> DataFrame:
    """Keep the rows whose item has at least ``min_n`` rows in ``df``.

    Pre-aggregated counts and a semi-join: the rows of a hot item are never
    gathered in one place.
    """
    frequent = count_by(df, [item]).where(F.col("n") >= min_n).select(item)
    return df.join(frequent, item, "left_semi")


def sum_numeric(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of each numeric column that is not a key; NULL counts as nothing."""
    keys = aslist(keys)
    numeric = [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in keys
    ]
    return df.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numeric])


# --- shares ----------------------------------------------------------------


def share(df: DataFrame, value: str, keys: Sequence[str] = (), out: str = "share") -> DataFrame:
    """``value / sum(value)`` within the keys."""
    totals = attach_totals(df, keys, __total=F.sum(value))
    return totals.withColumn(out, F.try_divide(F.col(value), F.col("__total"))).drop("__total")


def group_total(df: DataFrame, value: str, keys: Sequence[str], out: str = "total") -> DataFrame:
    """Attach the group's sum to its rows."""
    return attach_totals(df, keys, **{out: F.sum(value)})


# --- ranking ---------------------------------------------------------------


def top_n(df: DataFrame, n: int, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The ``n`` largest rows (smallest if ``n < 0``) per group, ties kept.

    ``weight`` defaults to the last column; rows without a weight are dropped.
    The value of the n-th row is found first (top-k pruned in every task, so at
    most ``n`` rows of a group leave a task), then all rows that reach it are
    kept where they are.  Equal weights in any number are never collected.

    The weight is read twice, so it has to be reproducible: an integer, or a
    per-row function of integers.  Pin other weights with ``checkpoint`` first.
    """
    if n == 0:
        raise ValueError("n must not be 0")
    weight = weight or df.columns[-1]
    by = aslist(by)
    largest = n > 0
    order = (lambda c: F.desc(c)) if largest else (lambda c: F.asc(c))
    edge = F.min if largest else F.max
    weighted = df.select(*by, F.col(weight).alias("__w")).where(F.col("__w").isNotNull())
    if not by:
        bound = weighted.orderBy(order("__w")).limit(abs(n)).agg(edge("__w")).scalar()
        return df.where(F.col(weight) >= bound if largest else F.col(weight) <= bound)
    ranked = weighted.withColumn(
        "__r", F.row_number().over(Window.partitionBy(*by).orderBy(order("__w")))
    ).where(F.col("__r") <= abs(n))
    bounds = ranked.groupBy(*by).agg(edge("__w").alias("__edge"))
    kept = join_on_keys(df, bounds, by, "inner", null_safe=True)
    reach = F.col(weight) >= F.col("__edge") if largest else F.col(weight) <= F.col("__edge")
    return kept.where(reach).drop("__edge")


def slice_max(df: DataFrame, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows at the maximum of ``weight`` in their group, ties kept."""
    top = attach_totals(df, by, __top=F.max(weight))
    return top.where(F.col(weight) == F.col("__top")).drop("__top")


def modal_category(df: DataFrame, key: Sequence[str], category: str) -> DataFrame:
    """Most frequent category of each key, ties kept → ``key, category, n``."""
    key = aslist(key)
    return slice_max(count_by(df, [*key, category]), "n", key)


def argmax_index(df: DataFrame, index: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """The first (smallest) index at which the score is largest."""
    best = F.max_by(F.col(index), F.struct(F.col(score), -F.col(index)))
    return df.where(F.col(score).isNotNull()).groupBy(*aslist(by)).agg(best.alias(index))


# --- joins -----------------------------------------------------------------


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns]


def natural_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all shared columns; an error if there are none."""
    keys = common_columns(a, b)
    if not keys:
        raise ValueError("the tables share no column")
    return a.join(b, keys, how)


def renamed_join(a: DataFrame, b: DataFrame, on: dict[str, str], how: str = "inner") -> DataFrame:
    """Join where ``{left name: right name}``; the left names are kept."""
    for left, right in on.items():
        if left != right:
            b = b.withColumnRenamed(right, left)
    return a.join(b, list(on), how)


def join_argmax(totals: DataFrame, rows: DataFrame, by: Sequence[str], weight: str) -> DataFrame:
    """Join each group's row(s) at the largest weight onto a per-group table."""
    return totals.join(slice_max(rows, weight, by), aslist(by))


# --- reshaping -------------------------------------------------------------


def spread(
    df: DataFrame, key: str, value: str, fill=None, values: Sequence | None = None
) -> DataFrame:
    """Long → wide; fails on a cell with more than one row.  Pass ``values`` to save the job that lists them."""
    ids = [c for c in df.columns if c not in (key, value)]
    grouped = df.groupBy(*ids).pivot(key, list(values)) if values is not None else df.groupBy(*ids).pivot(key)
    repeated = F.raise_error(F.lit(f"several rows for one {value}")).cast(df.schema[value].dataType)
    wide = grouped.agg(F.when(F.count(F.lit(1)) > 1, repeated).otherwise(F.first(value)))
    if fill is None:
        return wide
    return wide.select(
        *ids, *[F.coalesce(F.col(f"`{c}`"), F.lit(fill)).alias(c) for c in wide.columns if c not in ids]
    )


def gather(df: DataFrame, key: str, value: str, first: str, last: str) -> DataFrame:
    """Wide → long for the columns from ``first`` to ``last``."""
    cols = df.columns[df.columns.index(first) : df.columns.index(last) + 1]
    if not cols:
        raise ValueError("empty column range")
    ids = [c for c in df.columns if c not in cols]
    return df.unpivot(ids, cols, key, value)


def zero_fill_totals(
    df: DataFrame, keys: Sequence[str], category: str, value: str, categories: Sequence
) -> DataFrame:
    """Sum of ``value`` for every key and listed category, 0 where none.

    The sums of one key are spread over the listed categories and unfolded
    again, so no product of tables is formed.
    """
    keys = aslist(keys)
    names = [f"__c{i}" for i in range(len(categories))]
    wide = df.groupBy(*keys).agg(
        *[
            F.coalesce(F.sum(F.when(F.col(category) == c, F.col(value))), F.lit(0)).alias(n)
            for c, n in zip(categories, names)
        ]
    )
    cells = F.array(*[F.struct(F.lit(c).alias(category), F.col(n).alias(value)) for c, n in zip(categories, names)])
    return wide.select(*keys, F.inline(cells))


def unite(df: DataFrame, cols: Sequence[str], out: str, sep: str = " ") -> DataFrame:
    """Paste columns into one, in place of them."""
    cols = aslist(cols)
    joined = F.concat_ws(sep, *cols).alias(out)
    rest = [c for c in df.columns if c not in cols]
    at = min(df.columns.index(c) for c in cols)
    before = [c for c in df.columns[:at] if c not in cols]
    return df.select(*before, joined, *[c for c in rest if c not in before])


def label_codes(df: DataFrame, col: str, mapping: dict, out: str | None = None) -> DataFrame:
    """Replace codes by labels; a code without label becomes NULL."""
    items = [F.lit(x) for pair in mapping.items() for x in pair]
    return df.withColumn(out or col, F.element_at(F.create_map(*items), F.col(col)))


def relocate(df: DataFrame, col: str, before: str | None = None, after: str | None = None) -> DataFrame:
    """Move a column next to another one."""
    rest = [c for c in df.columns if c != col]
    at = rest.index(before) if before else rest.index(after) + 1
    return df.select(*rest[:at], col, *rest[at:])


def transpose(df: DataFrame, row: str, col: str) -> DataFrame:
    """Swap rows and columns of a long matrix."""
    return df.withColumnsRenamed({row: "__t"}).withColumnsRenamed({col: row}).withColumnsRenamed({"__t": col})


def split_sample(df: DataFrame, id: str, fraction: float = 0.8, seed: str | int = 0) -> DataFrame:
    """Add ``in_sample``: a reproducible split by id, whatever the layout.

    The id is hashed, so the same id falls on the same side in every run, on
    any cluster, and after any lost task.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id).cast("string")))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return df.withColumn("in_sample", bucket < int(fraction * 2**32))


def sample_exact(df: DataFrame, id: str, fraction: float = 0.8, seed: str | int = 0) -> DataFrame:
    """Add ``in_sample``: true for exactly ``floor(rows * fraction)`` rows, those with the smallest hashes of their ids.

    The hash that the sample ends at is found by counting: a histogram of its leading bits, then of the next ones within
    the one open bin, so no row is sorted or moved.  Ids should be unique: rows that repeat an id share its hash, and a
    sample that would end between them raises ValueError.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id).cast("string")))
    rows = df.withColumn("__h", F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"))  # 60 bits
    wanted = int(df.count() * fraction + 1e-9)
    low, bits, before = 0, 60, 0  # the sample ends in [low, low + 2^bits), with ``before`` rows below
    while bits and before < wanted:
        step = max(bits - 12, 0)
        inside = rows.where((F.col("__h") >= low) & (F.col("__h") < low + (1 << bits)))
        bins = inside.groupBy(F.expr(f"(__h - {low}L) div {1 << step}L").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        for row in sorted(bins.collect()):
            low, upto = low - low % (1 << bits) + row["bin"] * (1 << step), before + row["n"]
            if upto >= wanted:
                break
            before = upto
        bits = step
        if upto == wanted:
            low, bits, before = low + (1 << step), 0, wanted
    if before < wanted:
        raise ValueError(f"the sample would end between rows of one {id}")
    return rows.withColumn("in_sample", F.col("__h") < low).drop("__h")
