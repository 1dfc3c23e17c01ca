import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.operators import prefix, stats, structure, tfidf, verbs
from wordloom.operators.loess import loess


def test_top_n_keeps_ties(spark):
    rows = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5), ("d", 1), ("e", None)], "w string, n int")
    assert verbs.top_n(rows, 2).count() == 3
    assert verbs.top_n(rows, 4).count() == 4
    assert [r["w"] for r in verbs.top_n(rows, -1).collect()] == ["d"]
    grouped = rows.withColumn("g", F.lit(None).cast("string"))
    assert verbs.top_n(grouped, 2, "n", ["g"]).count() == 3


def test_top_n_against_brute_force(spark):
    rng = random.Random(1)
    data = [(rng.choice("aaaab"), rng.randrange(6), i) for i in range(400)]
    rows = spark.createDataFrame(data, "g string, n int, id int")
    for k in (1, 7, -3):
        got = {r["id"] for r in verbs.top_n(rows, k, "n", ["g"]).collect()}
        want = set()
        for g in "ab":
            mine = [x for x in data if x[0] == g]
            for x in mine:
                ahead = sum((y[1] > x[1]) if k > 0 else (y[1] < x[1]) for y in mine)
                if ahead < abs(k):
                    want.add(x[2])
        assert got == want


def test_share_with_null_group(spark):
    rows = spark.createDataFrame([(None, 1), (None, 3), ("a", 2)], "g string, n int")
    got = sorted((r["n"], r["share"]) for r in verbs.share(rows, "n", ["g"]).collect())
    assert got == [(1, 0.25), (2, 1.0), (3, 0.75)]
    assert sum(r["share"] for r in verbs.share(rows, "n").collect()) == pytest.approx(1.0)


def test_one_row_deviation_is_null(spark):
    row = spark.createDataFrame([(1,)], "n int").agg(F.stddev_samp("n")).first()
    assert row[0] is None


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, 10), (1, 11)], "k int, w int")
    assert verbs.natural_join(a, b).count() == 2
    with pytest.raises(ValueError):
        verbs.natural_join(a, b.withColumnRenamed("k", "z"))
    assert verbs.renamed_join(a, b.withColumnRenamed("k", "z"), {"k": "z"}).columns == ["k", "v", "w"]


def test_spread_gather_round_trip(spark):
    rows = spark.createDataFrame([("d1", "a", 2), ("d1", "b", 1), ("d2", "b", 4)], "d string, t string, n bigint")
    wide = verbs.spread(rows, "t", "n", fill=0, values=["a", "b"])
    long = verbs.gather(wide, "t", "n", "a", "b")
    assert {tuple(r) for r in long.collect()} == {("d1", "a", 2), ("d1", "b", 1), ("d2", "a", 0), ("d2", "b", 4)}
    filled = verbs.zero_fill_totals(rows, ["d"], "t", "n", ["a", "b"])
    assert {tuple(r) for r in filled.collect()} == {tuple(r) for r in long.collect()}


def test_frequent_and_common(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("a", 1)], "w string, g int")
    assert verbs.keep_frequent(rows, "w", 2).count() == 3
    assert [r["w"] for r in verbs.words_in_all(rows, "w", "g").collect()] == ["a"]


def test_sum_numeric_and_unite(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, 2.5), ("b", None, None)], "g string, n int, x double")
    got = {r["g"]: (r["n"], r["x"]) for r in verbs.sum_numeric(rows, ["g"]).collect()}
    assert got == {"a": (3, 2.5), "b": (0, 0.0)}
    pair = spark.createDataFrame([("x", "y", 1)], "w1 string, w2 string, n int")
    assert verbs.unite(pair, ["w1", "w2"], "bigram").first()["bigram"] == "x y"


def test_split_is_stable(spark):
    rows = spark.range(2000)
    one = {r["id"] for r in verbs.split_sample(rows, "id", 0.8, 1).where("in_sample").collect()}
    two = {r["id"] for r in verbs.split_sample(rows.repartition(7), "id", 0.8, 1).where("in_sample").collect()}
    assert one == two and 1500 < len(one) < 1700


@pytest.mark.parametrize("chunk", [2, 7, 1000])
def test_sections_and_fill_across_chunks(spark, chunk):
    rng = random.Random(2)
    data = [(b, i, rng.random() < 0.2, rng.choice([None, None, i])) for b in (1, 2) for i in range(60 if b == 1 else 5)]
    rows = spark.createDataFrame(data, "b int, i int, m boolean, v int")
    sections = prefix.running_section(rows, F.col("m"), "i", by=["b"], offset=-3, chunk=chunk)
    filled = prefix.fill_down(rows, ["v"], "i", by=["b"], chunk=chunk)
    got = {(r["b"], r["i"]): r["section"] for r in sections.collect()}
    fill = {(r["b"], r["i"]): r["v"] for r in filled.collect()}
    for b in (1, 2):
        count, last = -3, None
        for _, i, m, v in [x for x in data if x[0] == b]:
            count += m
            last = v if v is not None else last
            assert got[b, i] == count and fill[b, i] == last


def test_collapse_in_order(spark):
    data = [("k", i, f"w{i}") for i in range(50)]
    random.Random(3).shuffle(data)
    rows = spark.createDataFrame(data, "k string, i int, t string").repartition(5)
    text = structure.collapse_text(rows, ["k"], "t", "i", chunk=8).first()["t"]
    assert text == " ".join(f"w{i}" for i in range(50))


def test_running_total_hot_group(spark):
    data = [("hot", i, 1 + i % 3) for i in range(3000)] + [(f"g{i}", 0, 5) for i in range(20)] + [(None, 1, 2)]
    rows = spark.createDataFrame(data, "g string, o int, v bigint").repartition(6)
    got = prefix.running_total(rows, F.col("v"), [F.desc("o")], by=["g"])
    hot = {r["o"]: r["running"] for r in got.where("g = 'hot'").collect()}
    total = 0
    for _, o, v in sorted(data[:3000], key=lambda x: -x[1]):
        total += v
        assert hot[o] == total
    assert got.where("g is null").first()["running"] == 2


def test_dense_index(spark):
    rows = spark.createDataFrame([(w,) for w in "dcbae"], "w string")
    assert {r["w"]: r["idx"] for r in prefix.dense_index(rows, [F.asc("w")]).collect()} == dict(zip("abcde", range(5)))


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=501), "b": rng.integers(0, 5, 44).astype(float), "c": np.array([3.0])}
    rows = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, y double")
    for r in stats.boxplot_stats(rows, "y", ["g"]).collect():
        v = groups[r["g"]]
        q1, q2, q3 = np.percentile(v, [25, 50, 75])
        np.testing.assert_allclose([r["q1"], r["median"], r["q3"]], [q1, q2, q3], atol=1e-12)
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = v[(v >= low) & (v <= high)]
        assert (r["whisker_low"], r["whisker_high"]) == (v[v >= low].min(), v[v <= high].max())
        assert (r["outliers"], r["n"]) == (len(v) - len(inside), len(v))
    whole = stats.boxplot_stats(rows, "y").first()
    assert whole["median"] == pytest.approx(np.median(np.concatenate(list(groups.values()))))


def test_weighted_quantiles_by_two_keys(spark):
    rng = np.random.default_rng(6)
    data = [(int(t), "ab"[v], int(y), int(w)) for t, v, y, w in zip(*(rng.integers(1 if m == 4 else 0, m, 300) for m in (3, 2, 20, 4)))]
    rows = spark.createDataFrame(data, "t int, v string, y int, w int")
    for r in stats.boxplot_stats(rows, "y", ["t", "v"], weight="w").collect():
        values = [y for t, v, y, w in data for _ in range(w) if (t, v) == (r["t"], r["v"])]
        np.testing.assert_allclose([r["q1"], r["median"], r["q3"]], np.percentile(values, [25, 50, 75]))
        assert r["n"] == len(values)


def test_negative_idf_with_repeated_rows(spark):
    rows = spark.createDataFrame([("d", "t", 1), ("d", "t", 2), ("e", "t", 3)], "d string, t string, n int")
    got = tfidf.bind_tf_idf(rows, "t", "d", "n").collect()
    assert all(r["idf"] == pytest.approx(np.log(2 / 3)) for r in got)


def _loess(x, y, x0, span):
    q = int(np.floor(len(x) * span + 1e-5))
    d = np.abs(x - x0)
    h = np.sort(d)[q - 1]
    w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0)
    X = np.vander(x - x0, 3, increasing=True)
    hat = np.linalg.pinv((X * w[:, None]).T @ X) @ (X * w[:, None]).T
    return hat[0]


def test_loess_matches_weighted_least_squares(spark):
    rng = np.random.default_rng(5)
    x = np.round(np.sort(rng.uniform(0, 10, 70)), 1)
    y = np.sin(x) + rng.normal(scale=0.2, size=70)
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    fit = loess(rows, "x", "y", span=0.6, se=True).orderBy("x").collect()
    assert len(fit) == 80
    rows_at = np.array([_loess(x, y, r["x"], 0.6) for r in fit])
    np.testing.assert_allclose([r["y"] for r in fit], rows_at @ y, atol=1e-8)
    hat = np.array([_loess(x, y, v, 0.6) for v in x])
    left = y - hat @ y
    free = np.trace((np.eye(len(x)) - hat) @ (np.eye(len(x)) - hat).T)
    want = np.sqrt(left @ left / free * (rows_at**2).sum(1))
    np.testing.assert_allclose([r["se"] for r in fit], want, rtol=0.03)
    assert all(r["ymin"] < r["y"] < r["ymax"] for r in fit)


def test_loess_of_clustered_and_repeated_places(spark):
    rng = np.random.default_rng(6)
    groups = {
        "dense": np.concatenate([rng.uniform(0, 1e-6, 4000), rng.uniform(0, 1, 40), [1e3]]),
        "few": np.repeat(rng.uniform(-5, 5, 6), 30),
        "even": np.arange(500.0),
        "far": 1e9 + rng.uniform(0, 3, 300).round(2),
    }
    data = [(g, float(a), float(b)) for g, x in groups.items() for a, b in zip(x, 50 + np.cos(x) + rng.normal(size=len(x)))]
    rows = spark.createDataFrame(data, "g string, x double, y double").repartition(5)
    fit = loess(rows, "x", "y", ["g"], span=0.4)
    got = {(r["g"], round(r["x"], 9)): r["y"] for r in fit.collect()}
    compared = set()
    for g, x in groups.items():
        y = np.array([b for h, _, b in data if h == g])
        for x0 in np.linspace(x.min(), x.max(), 80):
            d = np.abs(x - x0)
            h = np.sort(d)[int(np.floor(len(x) * 0.4 + 1e-5)) - 1]
            if h > 1e-9 and len(np.unique(x[d < h])) > 5:  # well determined
                u, w = (x - x0) / h, np.where(d < h, 1 - (d / max(h, 1e-300)) ** 3, 0) ** 1.5
                left = np.vander(u, 3, increasing=True) * w[:, None]
                if np.linalg.cond(left) > 1e4:
                    continue
                want = np.linalg.lstsq(left, y * w, rcond=None)[0][0]
                compared.add(g)
                near = min((v for k, v in got if k == g), key=lambda v: abs(v - x0))
                assert got[g, near] == pytest.approx(want, abs=1e-5, rel=1e-5), (g, x0)
    assert compared == {"dense", "even", "far"}


def test_loess_moves_no_rows(spark):
    rows = spark.range(5000).selectExpr("CAST(id AS DOUBLE) AS x", "CAST(id % 7 AS DOUBLE) AS y")
    plan = loess(rows, "x", "y", se=True)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Python" not in plan


def test_loess_needs_three_places(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0)], "x double, y double")
    assert all(r["y"] is None for r in loess(rows, "x", "y").collect())


def test_spread_refuses_repeated_cells(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 2)], "id string, key string, n int")
    with pytest.raises(Exception, match="several rows"):
        verbs.spread(df, "key", "n", values=["x"]).collect()


def test_t_quantile(spark):
    from wordloom.operators.loess import _t_quantile_975

    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,), (5.0,), (10.0,), (100.0,)], "df double")
    got = [r[0] for r in df.select(_t_quantile_975(F.col("df"))).collect()]
    assert got[0] is None
    assert got[1:] == pytest.approx([12.7062, 4.30265, 3.18245, 2.57058, 2.22814, 1.98397], abs=1e-3)


def test_exact_sample(spark):
    rows = spark.range(5000).repartition(7)
    for fraction in (0.0, 0.3333, 0.8, 1.0):
        got = verbs.sample_exact(rows, "id", fraction, seed=3).where("in_sample").collect()
        assert len(got) == int(5000 * fraction + 1e-9)
    assert {r["id"] for r in got} == set(range(5000))
    again = verbs.sample_exact(rows.coalesce(1), "id", 0.3333, seed=3).where("in_sample")
    assert {r["id"] for r in again.collect()} == {r["id"] for r in verbs.sample_exact(rows, "id", 0.3333, seed=3).where("in_sample").collect()}
    same = spark.createDataFrame([(1,)] * 10, "id int")
    with pytest.raises(ValueError, match="between rows"):
        verbs.sample_exact(same, "id", 0.5)
    assert verbs.sample_exact(same.limit(0), "id", 0.5).count() == 0
