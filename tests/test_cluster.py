import math

import numpy as np
import pytest

from wordloom.operators import cluster, dtm as dt, indices, matrix as mx, transfers
from wordloom.operators.verbs import count_by


def long(spark, x, names=None):
    names = names or [f"r{i:03d}" for i in range(len(x))]
    cells = [(names[i], j, float(v)) for i, row in enumerate(x) for j, v in enumerate(row) if v != 0]
    return spark.createDataFrame(cells, "item string, col int, x double"), names


def blobs(n=60, p=4, k=3, seed=0):
    rng = np.random.default_rng(seed)
    which = np.arange(n) % k
    return rng.normal(size=(k, p))[which] * 4 + rng.normal(size=(n, p)), which + 1


def distances(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


def ward_heights(x):
    groups, heights = [[i] for i in range(len(x))], []
    while len(groups) > 1:
        best = min(
            (math.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(x[a].mean(0) - x[b].mean(0)), i, j)
            for i, a in enumerate(groups)
            for j, b in enumerate(groups)
            if i < j
        )
        heights.append(best[0])
        groups[best[1]] += groups.pop(best[2])
    return heights


def test_distances_for_any_block(spark):
    x, _ = blobs(20)
    df, names = long(spark, x)
    want = distances(x)
    for block in (3, 512):
        got = mx.pairwise_distance(df, "item", "col", "x", block=block).collect()
        assert len(got) == 190
        for r in got:
            assert r["dist"] == pytest.approx(want[names.index(r["a"]), names.index(r["b"])], abs=1e-9)


def test_row_without_cells_is_kept(spark):
    df, _ = long(spark, np.array([[3.0, 4.0], [0.0, 0.0], [0.0, 4.0]]))
    rows = spark.createDataFrame([("r000",), ("r001",), ("r002",)], "item string")
    got = {(r["a"], r["b"]): r["dist"] for r in mx.pairwise_distance(df, "item", "col", "x", rows=rows).collect()}
    assert got == {("r000", "r001"): 5.0, ("r000", "r002"): 3.0, ("r001", "r002"): 4.0}
    labels, _ = cluster.kmeans(df, 2, row="item", col="col", value="x", rows=rows)
    assert labels.count() == 3


@pytest.mark.parametrize("block", [16, 512])
def test_ward_equals_one_by_one_merging(spark, block):
    x, _ = blobs(50)
    df, _ = long(spark, x)
    merges, leaves = cluster.hclust_ward(df, "item", "col", "x", block=block)
    rows = merges.orderBy("step").collect()
    np.testing.assert_allclose([r["height"] for r in rows], sorted(ward_heights(x)), rtol=1e-9)
    assert rows[-1]["size"] == 50 and leaves.count() == 50
    used = [n for r in rows for n in (r["a"], r["b"])]
    assert sorted(used) == list(range(98))  # every node but the root is merged once
    assert all(r["a"] < 50 + r["step"] and r["b"] < 50 + r["step"] for r in rows)


def test_two_tight_pairs(spark):
    df, _ = long(spark, np.array([[1.0, 0.1], [9.0, 9.1], [1.0, 0.2], [9.0, 9.2]]))
    merges, leaves = cluster.hclust_ward(df, "item", "col", "x")
    heights = [r["height"] for r in merges.orderBy("step").collect()]
    assert heights[0] == pytest.approx(0.1) and heights[1] == pytest.approx(0.1) and heights[2] > 5
    got = {r["item"]: r["cluster"] for r in cluster.cutree(merges, leaves, 2).collect()}
    assert got == {"r000": 1, "r002": 1, "r001": 2, "r003": 2}
    assert count_by(cluster.cutree(merges, leaves, 4), ["cluster"]).count() == 4
    assert count_by(cluster.cutree(merges, leaves, 1), ["cluster"]).count() == 1


def test_cut_finds_blobs(spark):
    x, which = blobs(45)
    df, names = long(spark, x)
    got = {r["item"]: r["cluster"] for r in cluster.cutree(*cluster.hclust_ward(df, "item", "col", "x"), 3).collect()}
    assert [got[n] for n in names] == list(which)
    labels, centers = cluster.kmeans(df, 3, row="item", col="col", value="x")
    assert {len({r["cluster"] for r in labels.collect() if which[names.index(r["item"])] == w}) for w in (1, 2, 3)} == {1}
    assert centers.count() == 12


def test_components_and_scaling(spark):
    x, which = blobs(40)
    x = x * np.array([1, 5, 0.5, 2])
    df, names = long(spark, x)
    scores, loadings = mx.pca(df, "item", "col", "x", k=2)
    z = (x - x.mean(0)) / x.std(0)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    got = np.zeros((40, 2))
    for r in scores.collect():
        got[names.index(r["item"]), r["comp"] - 1] = r["score"]
    np.testing.assert_allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-8)
    top = loadings.where("comp = 1").collect()
    assert max(top, key=lambda r: abs(r["loading"]))["loading"] > 0
    plane = mx.mds(df, "item", "col", "x", k=4)
    at = np.zeros((40, 4))
    for r in plane.collect():
        at[names.index(r["item"]), r["dim"] - 1] = r["coord"]
    np.testing.assert_allclose(distances(at), distances(x), atol=1e-7)


def test_discriminant_whitens_clusters(spark):
    x, which = blobs(60, p=2)
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "item int, x double, y double")
    labels = spark.createDataFrame([(i, int(w)) for i, w in enumerate(which)], "item int, cluster int")
    got = mx.discriminant(rows, labels, "item", "x", "y", "cluster").orderBy("item").collect()
    d = np.array([[r["dc1"], r["dc2"]] for r in got])
    within = sum((d[which == c] - d[which == c].mean(0)).T @ (d[which == c] - d[which == c].mean(0)) for c in (1, 2, 3))
    np.testing.assert_allclose(within / 57, np.eye(2), atol=1e-9)
    means = np.array([d[which == c].mean(0) for c in (1, 2, 3)])
    assert means[:, 0].var() > means[:, 1].var()


def test_indices_match_direct_computation(spark):
    x, which = blobs(42, seed=3)
    x[:, 0] = np.round(x[:, 0])  # some ties
    df, names = long(spark, x)
    labels = spark.createDataFrame(list(zip(names, [int(w) for w in which])), "item string, cluster int")
    families = ["scatter", "pairdist", "centers", "determinant", "split"]
    got = {r["index"]: r["value"] for r in indices.cluster_index(df, labels, families, block=10).collect()}
    n, p, q = 42, 4, 3
    d, iu = distances(x), np.triu_indices(42, 1)
    same = which[:, None] == which[None]
    inner, outer = d[iu][same[iu]], d[iu][~same[iu]]
    c = np.array([x[which == k].mean(0) for k in (1, 2, 3)])
    w = sum(((x[which == k] - c[k - 1]).T @ (x[which == k] - c[k - 1])) for k in (1, 2, 3))
    t = (x - x.mean(0)).T @ (x - x.mean(0))
    b = t - w
    ordered = np.sort(d[iu])
    m = len(inner)
    sil = []
    for i in range(n):
        a = d[i][same[i] & (np.arange(n) != i)].mean()
        o = min(d[i][which == k].mean() for k in (1, 2, 3) if k != which[i])
        sil.append((o - a) / max(a, o))
    want = {
        "trace_w": np.trace(w),
        "ch": (np.trace(b) / 2) / (np.trace(w) / (n - q)),
        "ball": np.trace(w) / q,
        "ratkowsky": np.mean(np.sqrt(np.diag(b) / np.diag(t))) / math.sqrt(q),
        "silhouette": np.mean(sil),
        "dunn": outer.min() / inner.max(),
        "mcclain": inner.mean() / outer.mean(),
        "ptbiserial": (outer.mean() - inner.mean()) * math.sqrt(m * len(outer) / len(d[iu]) ** 2) / d[iu].std(ddof=1),
        "hubert": np.mean(d[iu] * distances(c)[which - 1][:, which - 1][iu]),
        "cindex": (inner.sum() - ordered[:m].sum()) / (ordered[-m:].sum() - ordered[:m].sum()),
        "scott": n * math.log(np.linalg.det(t) / np.linalg.det(w)),
        "marriot": math.log(q * q * np.linalg.det(w)),
        "rubin": math.log(np.linalg.det(t) / np.linalg.det(w)),
        "friedman": np.trace(np.linalg.inv(w) @ b),
        "trcovw": np.trace(np.cov(w)),
    }
    for name, value in want.items():
        assert got[name] == pytest.approx(value, rel=1e-7), name
    assert all(got[name] is not None for family in families for name in indices.FAMILIES[family])


def test_one_point_cluster_scores_zero(spark):
    x, _ = blobs(9)
    df, names = long(spark, x)
    labels = spark.createDataFrame([(v, 2 if i == 4 else 1) for i, v in enumerate(names)], "item string, cluster int")
    vectors = mx.row_vectors(df, "item", "col", "x")
    scores = indices.silhouette_scores(indices.item_cluster_distances(vectors, labels), labels).collect()
    by = {r["item"]: r["silhouette"] for r in scores}
    assert by["r004"] == 0 and len(by) == 9 and all(-1 <= v <= 1 for v in by.values())


def test_smallest_sums_with_ties(spark):
    x = np.repeat(np.array([[0.5, 1.0], [2.0, 1.0], [7.0, 3.0]]), 6, axis=0)
    df, _ = long(spark, x)
    vectors = mx.row_vectors(df, "item", "col", "x")
    d = np.sort(distances(x)[np.triu_indices(18, 1)])
    sums, total, number = indices.smallest_distance_sums(vectors, [10, 60, 100, 153], float(d[-1]), block=5, bins=16)
    assert number == 153 and total == pytest.approx(d.sum())
    for m, s in sums.items():
        assert s == pytest.approx(d[:m].sum(), rel=1e-4)


def test_choice_of_k(spark):
    noise = np.random.default_rng(7).normal(size=(48, 4))
    df, _ = long(spark, noise + 12 * np.eye(3, 4)[np.arange(48) % 3])
    got = indices.select_k(df, (2, 3, 4), "ward", ["silhouette", "dunn", "ch"])
    chosen = {r["index"]: r["k"] for r in got.where("chosen").collect()}
    assert chosen["silhouette"] == chosen["ch"] == chosen["vote"] == 3


def test_f_distribution():
    assert indices.f_cdf(1.0, 5, 5) == pytest.approx(0.5)
    assert indices.f_cdf(161.4476, 1, 1) == pytest.approx(0.95, abs=1e-5)
    assert indices.f_cdf(2.9782, 4, 14) == pytest.approx(0.9436, abs=5e-3)
    assert len(indices.RULES) == 26


def test_matrix_tables(spark):
    tokens = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, "c")], "d int, w string")
    matrix = dt.dtm(tokens, "d", "w")
    assert {tuple(r) for r in matrix.collect()} == {(1, "a", 2), (1, "b", 1), (2, "a", 1), (3, "c", 1)}
    # strictly more than 3 · (1 - 0.5) documents
    assert {r["term"] for r in dt.prune_sparse(matrix, 0.5).collect()} == {"a"}
    vectors, vocab = dt.to_vectors(matrix)
    assert {r["document"]: r["features"].toArray().tolist() for r in vectors.collect()} == {
        1: [2, 1, 0],
        2: [1, 0, 0],
        3: [0, 0, 1],
    }
    assert {r["term"]: r["idx"] for r in vocab.collect()} == {"a": 0, "b": 1, "c": 2}


def test_choice_of_k_from_two_with_kmeans(spark):
    from wordloom.operators.indices import select_k

    rows = [(i, c, float(10 * (i % 3) + (i // 3) * 0.1 + c)) for i in range(12) for c in (1, 2)]
    matrix = spark.createDataFrame(rows, "document long, term long, n double")
    got = select_k(matrix, (2, 3, 4), "kmeans", ["kl", "ch"], row="document", col="term", value="n").collect()
    assert {(r["index"], r["k"]) for r in got if r["chosen"]} >= {("ch", 3)}


def test_components_of_more_columns_than_a_square_matrix_allows(spark):
    rng = np.random.default_rng(5)
    x = (rng.random((30, 400)) < 0.05) * rng.integers(1, 9, (30, 400)).astype(float)
    x[:, :3] += rng.normal(size=(30, 3)) * np.array([30, 20, 10])
    df, names = long(spark, x)
    plane = mx.mds(df, "item", "col", "x", k=2)
    at = np.zeros((30, 2))
    for r in plane.collect():
        at[names.index(r["item"]), r["dim"] - 1] = r["coord"]
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    np.testing.assert_allclose(np.abs(at), np.abs(u[:, :2] * s[:2]), atol=1e-4)


@pytest.mark.parametrize("scale", [False, True])
def test_a_basis_is_as_long_as_the_shorter_side(spark, monkeypatch, scale):
    rng = np.random.default_rng(6)
    x = (rng.random((24, 500)) < 0.1) * rng.integers(1, 9, (24, 500)).astype(float)
    x[:, 0] = np.linspace(1, 90, 24)
    x[:, 1:40] += np.linspace(-2, 3, 24)[:, None] ** 2
    x[3] = 0
    df, names = long(spark, x)
    lengths, search = [], mx.block_lanczos
    monkeypatch.setattr(mx, "block_lanczos", lambda times, length, *rest: lengths.append(length) or search(times, length, *rest))
    rows = spark.createDataFrame([(n,) for n in names], "item string")
    scores, loadings = mx.pca(df, "item", "col", "x", k=2, scale=scale, rows=rows)
    assert lengths == [24]
    z = x - x.mean(0)
    if scale:
        z = np.divide(z, x.std(0), out=np.zeros(x.shape), where=x.std(0) > 0)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    at = np.zeros((24, 2))
    for r in scores.collect():
        at[names.index(r["item"]), r["comp"] - 1] = r["score"]
    found = {(r["col"], r["comp"]): r for r in loadings.collect()}
    assert all(max((r for r in found.values() if r["comp"] == c), key=lambda r: abs(r["loading"]))["loading"] > 0 for c in (1, 2))
    held = [j for j in range(500) if any((j, 1) == k or (str(j), 1) == k for k in found)]
    back = np.array([[(found.get((j, c)) or found[str(j), c])["loading"] for j in held] for c in (1, 2)])
    np.testing.assert_allclose(at, z[:, held] @ back.T, atol=1e-4)
    np.testing.assert_allclose(np.abs(at), np.abs(u[:, :2] * s[:2]), atol=1e-4)
    shares = {r["comp"]: r["explained"] for r in found.values()}
    np.testing.assert_allclose([shares[1], shares[2]], s[:2] ** 2 / (s**2).sum(), rtol=1e-6)


def test_rows_are_expanded_a_limited_number_of_cells_at_a_time():
    import pandas as pd

    sizes = [3, 0, 50, 4, 4, 4, 2, 0, 1]
    frame = pd.DataFrame({"idx": [np.arange(n) for n in sizes], "val": [np.full(n, 1.0 + i) for i, n in enumerate(sizes)]})
    parts = list(mx._stacked([frame, frame[:0]], 10))
    assert [p[3].tolist() for p in parts] == [[3], [50], [4, 4], [4, 2, 1]]
    assert np.concatenate([p[2] for p in parts]).sum() == sum(n * (1 + i) for i, n in enumerate(sizes))


def test_rows_of_many_blocks_are_copied_less_often(spark):
    rows = spark.range(3000).selectExpr("id AS item", "array(0, 1) AS idx", "array(id % 37 * 1.0D, id % 11 * 1.0D) AS val")
    narrow, wide = mx.block_cells(rows, 4), mx.block_cells(rows, 4, 64)
    assert narrow.count() == 3000 * 750 and wide.count() == 3000 * 47
    assert mx.block_cells(rows, 4096, 4096).count() == 3000


def test_tiles_of_a_cell_give_what_the_cell_gives(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 3)).round(1)  # with ties
    df, names = long(spark, x)
    vectors = mx.row_vectors(df, "item", "col", "x")
    labels = spark.createDataFrame([(n, 1 + i % 3) for i, n in enumerate(names)], "item string, cluster int")
    found = []
    for block in (512, 3):  # one cell; 33 blocks of three tiles or so
        sums = indices.item_cluster_distances(vectors, labels, block)
        found.append({(r["item"], r["l"]): (r["n"], r["s"], r["s2"], r["low"], r["high"]) for r in sums.collect()})
    assert found[0].keys() == found[1].keys() and len(found[0]) == 900
    for key, row in found[0].items():
        assert found[1][key] == pytest.approx(row, abs=1e-6)


def test_ward_tree_of_a_tied_grid_and_of_one_row(spark):
    x = np.array([[float(i), float(j)] for i in range(1, 5) for j in range(1, 5)])
    df, _ = long(spark, x)
    rows = cluster.hclust_ward(df, "item", "col", "x")[0].orderBy("step").collect()
    assert [r["height"] for r in rows][:8] == pytest.approx([1.0] * 8)
    total = ((x - x.mean(0)) ** 2).sum()
    assert len(rows) == 15 and sum(r["height"] ** 2 for r in rows) / 2 == pytest.approx(total)
    one, _ = long(spark, x[:1])
    merges, leaves = cluster.hclust_ward(one, "item", "col", "x")
    assert merges.count() == 0 and leaves.count() == 1


def test_lanczos_on_a_flat_spectrum():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 300))
    a = x.T @ x
    for most, k in ((10_000, 2), (60, 2), (10_000, 5)):
        passes = []

        def times(block):
            passes.append(block.shape[1])
            return a @ block

        values, vectors = mx.block_lanczos(times, 300, k, 100 if most == 60 else 40, 1e-7, most)
        np.testing.assert_allclose(values, np.linalg.eigvalsh(a)[::-1][:k], rtol=1e-9)
        assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() <= 1.01e-7 * values[0]
        assert len(passes) < (100 if most == 60 else 40)


def test_lanczos_raises_instead_of_returning_what_is_not_proven():
    a = np.diag(np.linspace(1, 1.01, 400))
    with pytest.raises(RuntimeError, match="residual"):
        mx.block_lanczos(lambda b: a @ b, 400, 2, 5, 1e-12, 10_000)
    values, _ = mx.block_lanczos(lambda b: np.zeros_like(b), 30, 2, 5, 1e-12, 100)
    assert not values.any()


def test_components_refuse_what_the_driver_cannot_hold(spark):
    rows = spark.createDataFrame([(1, [0], [1.0])], "item long, idx array<int>, val array<double>")
    with pytest.raises(ValueError, match="driver"):
        mx.principal_axes(rows, 1, np.zeros(10_000), np.ones(10_000), 2, driver_bytes=1 << 20)


def test_scores_of_rows_without_cells(spark):
    cells = spark.createDataFrame([(1, "a", 2.0), (2, "a", 1.0), (2, "b", 5.0)], "item long, col string, x double")
    rows = spark.createDataFrame([(1,), (2,), (3,)], "item long")
    scores, loadings = mx.pca(cells, "item", "col", "x", k=2, scale=False, rows=rows)
    got = np.zeros((3, 2))
    for r in scores.collect():
        got[r["item"] - 1, r["comp"] - 1] = r["score"]
    x = np.array([[2.0, 0], [1, 5], [0, 0]])
    x -= x.mean(0)
    np.testing.assert_allclose(got @ got.T, x @ x.T, atol=1e-9)
    assert loadings.count() == 4


# --- transfers -----------------------------------------------------------------


def _within(x, labels):
    return sum(((x[labels == c] - x[labels == c].mean(0)) ** 2).sum() for c in np.unique(labels))


def test_transfers_end_where_no_single_move_helps(spark):
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(m, 1.0, (40, 5)) for m in (0, 1.5, 3)] + [np.zeros((2, 5))]).round(3)
    df, names = long(spark, x)
    start = spark.createDataFrame([(n, 1 + i % 4) for i, n in enumerate(names)], "item string, cluster int")
    done = transfers.kmeans_transfers(df, start, "item", "col", "x")
    labels = {r["item"]: r["cluster"] for r in done.collect()}
    assert set(labels) == set(names)
    got = np.array([labels[n] for n in names])
    assert len(set(got)) == 4 and _within(x, got) < _within(x, np.arange(len(x)) % 4 + 1)
    con = duckdb.connect()
    con.execute("CREATE TABLE cell (item VARCHAR, col INTEGER, x DOUBLE)")
    con.executemany("INSERT INTO cell VALUES (?, ?, ?)", [(n, j, float(v)) for n, r in zip(names, x) for j, v in enumerate(r)])
    con.execute("CREATE TABLE label (item VARCHAR, cluster INTEGER)")
    con.executemany("INSERT INTO label VALUES (?, ?)", list(labels.items()))
    worst = con.execute("""
        WITH size AS (SELECT cluster, count(*) AS n FROM label GROUP BY cluster),
        centre AS (SELECT cluster, col, avg(x) AS m FROM cell JOIN label USING (item) GROUP BY cluster, col),
        dist AS (SELECT item, cluster, sum((x - m) * (x - m)) AS d FROM cell JOIN centre USING (col) GROUP BY item, cluster)
        SELECT max(a.d * s.n / (s.n - 1) - b.d * t.n / (t.n + 1)) FROM label l
        JOIN dist a ON a.item = l.item AND a.cluster = l.cluster JOIN size s ON s.cluster = l.cluster
        JOIN dist b ON b.item = l.item AND b.cluster <> l.cluster JOIN size t ON t.cluster = b.cluster WHERE s.n > 1""").fetchone()[0]
    assert worst <= 1e-9


def test_gain_of_a_transfer(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(14, 3)).round(2)
    df, names = long(spark, x)
    labels = np.array([1] * 7 + [2] * 6 + [3])
    given = spark.createDataFrame([(n, int(c)) for n, c in zip(names, labels)], "item string, cluster int")
    for r in transfers.transfer_gains(df, given, "item", "col", "x").collect():
        i = names.index(r["item"])
        if labels[i] == 3:
            assert r["gain"] is None
            continue
        falls = {}
        for c in {1, 2, 3} - {labels[i]}:
            moved = labels.copy()
            moved[i] = c
            falls[c] = _within(x, labels) - _within(x, moved)
        best = max(falls, key=falls.get)
        assert (r["to"], r["gain"]) == (best, pytest.approx(falls[best]))
