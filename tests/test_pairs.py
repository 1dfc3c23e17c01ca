import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from wordloom.operators.graph import graph_tables
from wordloom.operators import pairs
from wordloom.operators.pairs import pairwise_cor, pairwise_count


def rows_of(seed=1, hot=True):
    rng = random.Random(seed)
    rows = [(f, f"w{rng.randrange(14):02d}") for f in range(40) for _ in range(rng.randrange(1, 9))]
    if hot:  # one feature holds every item
        rows += [(99, f"w{i:02d}") for i in range(14)] * 3
    return rows


def brute(rows):
    held = {}
    for f, w in rows:
        held.setdefault(f, set()).add(w)
    return held, Counter(p for ws in held.values() for p in permutations(sorted(ws), 2))


@pytest.mark.parametrize("block,chunk", [(4, 7), (1024, 8192), (1, 3)])
def test_counts_for_any_blocking(spark, block, chunk):
    rows = rows_of()
    df = spark.createDataFrame(rows, "f int, w string").repartition(5)
    got = {(r["item1"], r["item2"]): r["n"] for r in pairwise_count(df, "w", "f", block=block, chunk=chunk).collect()}
    assert got == dict(brute(rows)[1])


def test_listed_and_grouped_counts(spark):
    rows = rows_of(2)
    df = spark.createDataFrame([(f % 2, f, w) for f, w in rows], "g int, f int, w string")
    want = brute(rows)[1]
    listed = pairwise_count(df, "w", "f", items=["w01", "w02"]).collect()
    assert {(r["item1"], r["item2"]): r["n"] for r in listed} == {
        p: n for p, n in want.items() if p[0] in ("w01", "w02")
    }
    grouped = pairwise_count(df, "w", "f", by=["g"], block=4, chunk=7).collect()
    for g in (0, 1):
        mine = brute([r for r in rows if r[0] % 2 == g])[1]
        assert {(r["item1"], r["item2"]): r["n"] for r in grouped if r["g"] == g} == dict(mine)


def test_phi_is_the_correlation_of_presence(spark):
    rows = rows_of(3, hot=False)
    df = spark.createDataFrame(rows, "f int, w string")
    held, _ = brute(rows)
    items = sorted({w for _, w in rows})
    grid = np.array([[w in held[f] for w in items] for f in sorted(held)], dtype=float)
    want = np.corrcoef(grid.T)
    for r in pairwise_cor(df, "w", "f", block=5, chunk=9).collect():
        assert r["correlation"] == pytest.approx(want[items.index(r["item1"]), items.index(r["item2"])], abs=1e-12)
    dense = pairwise_cor(df, "w", "f", dense=True, items=["w03"]).collect()
    assert len(dense) == len(items) - 1


def test_never_met_pair_only_when_dense(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "f int, w string")
    assert pairwise_cor(df, "w", "f").count() == 0
    got = pairwise_cor(df, "w", "f", dense=True, items=["a"]).collect()
    assert [(r["item2"], r["correlation"]) for r in got] == [("b", -1.0)]
    with pytest.raises(ValueError):
        pairwise_cor(df, "w", "f", dense=True)


def test_item_everywhere_has_no_row(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (1, "b"), (2, "c")], "f int, w string")
    got = {(r["item1"], r["item2"]) for r in pairwise_cor(df, "w", "f").collect()}
    assert not any("a" in p for p in got)


def test_graph_tables(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c")], "s string, t string")
    nodes, _ = graph_tables(edges, "s", "t")
    assert {r["name"]: (r["out_degree"], r["in_degree"], r["degree"]) for r in nodes.collect()} == {
        "a": (2, 0, 2),
        "b": (0, 1, 1),
        "c": (0, 1, 1),
    }


@pytest.mark.parametrize("above,cell", [(0.3, 16384), (0.6, 16384), (0.45, 16)])
def test_correlations_over_a_limit(spark, monkeypatch, above, cell):
    """The same pairs as of all correlations, over several blocks and chunks; cells out of reach are not made."""
    monkeypatch.setattr(pairs, "CELL_FEATURES", cell)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        size = int(rng.integers(1, 5)) if i < 30 else int(rng.integers(20, 80))
        start = int(rng.integers(0, 100 - size))
        rows += [(f"w{i}", f) for f in range(start, start + size) if rng.random() < 0.9]
    frame = spark.createDataFrame(rows + [("all", f) for f in range(100)], "item string, feature int")
    every = pairs.pairwise_cor(frame, "item", "feature", block=8)
    want = {(r[0], r[1]): r[2] for r in every.collect() if r[2] > above}
    got = pairs.pairwise_cor(frame, "item", "feature", block=8, above=above).collect()
    assert len(got) == len(want) > 0 and {(r[0], r[1]): r[2] for r in got} == pytest.approx(want, abs=1e-12)


def test_blocks_out_of_reach():
    assert pairs.reachable_blocks([900, 40, 30, 2], [1000, 60, 39, 8], 2000, 0.5) == [0, 2, 3, 3]
    assert pairs.reachable_blocks([10], [10], 10, 0.5) == [0]


def test_counts_are_known_in_their_cells(spark, capsys):
    """Up to ``CHUNK`` features nothing is added up after the cells; null groups are counted as well."""
    rows = [(None if f % 3 else f % 2, f, w) for f, w in rows_of(5)]
    df = spark.createDataFrame(rows, "g int, f int, w string")
    out = pairwise_count(df, "w", "f", by=["g"], block=4)
    got = {(r["g"], r["item1"], r["item2"]): r["n"] for r in out.collect()}
    want = {(g, *p): n for g in (None, 0, 1) for p, n in brute([r[1:] for r in rows if r[0] == g])[1].items()}
    assert got == want
    capsys.readouterr()
    out.explain()
    above = capsys.readouterr().out.split("FlatMapGroupsInArrow")[0]
    assert "Aggregate" not in above


@pytest.mark.parametrize("dense", [0, 10**9])
def test_cells_counted_as_matrices_and_pair_by_pair(monkeypatch, dense):
    monkeypatch.setattr(pairs, "DENSE", dense)
    rng = np.random.default_rng(6)
    held = rng.random((1300, 20)) < 0.2
    held[7] = True
    feature, item = np.nonzero(held)
    order = rng.permutation(len(item))
    feature, item = feature[order] * 2**40 - 5, item[order]
    first = item < 10
    exact = held.astype(int)
    across = pairs._cell_counts(feature, item % 10, first, ~first, 10)
    assert np.array_equal(across, exact[:, :10].T @ exact[:, 10:])
    inside = pairs._cell_counts(feature[first], item[first], *[np.ones(first.sum(), bool)] * 2, 10)
    assert np.array_equal(inside, exact[:, :10].T @ exact[:, :10])


def test_pairs_of_rare_words(spark, tmp_path):
    """words with fewer than 50 tokens are paired like all others."""
    import catalog

    catalog.load_all()
    rows = [(1, "rare words meet", "en", "a"), (2, "words meet", "en", "a"), (3, "alone", "en", "a"), (4, None, "en", "a")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["item1"], r["item2"]): r["n"] for r in catalog.QUERIES["pairwise_count"](spark, str(tmp_path)).collect()}
    half = {("rare", "words"): 1, ("meet", "rare"): 1, ("meet", "words"): 2}
    assert got == half | {(b, a): n for (a, b), n in half.items()}
    assert "HAVING" not in catalog.ORACLES["pairwise_count"]
