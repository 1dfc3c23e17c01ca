import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.operators import gibbs, topics
from wordloom.plans import topics as plans


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(0)
    rows = []
    for doc in range(40):
        words = [f"{'ab'[doc % 2]}{i}" for i in range(6)]
        counts = rng.multinomial(60, np.ones(6) / 6)
        rows += [(doc, w, int(c)) for w, c in zip(words, counts) if c]
    return spark.createDataFrame(rows, "document int, term string, n bigint")


def test_fit_sums_to_one_and_separates(spark, matrix):
    fit = topics.fit_topics(matrix, k=2, seed=1, max_iter=30)
    for table, key, value in ((fit.beta, "topic", "beta"), (fit.gamma, "document", "gamma")):
        sums = table.groupBy(key).sum(value).collect()
        assert all(r[1] == pytest.approx(1.0) for r in sums)
    top = {r["document"]: r["topic"] for r in plans.doc_top_topic(fit.gamma).collect()}
    assert len({top[d] for d in range(0, 40, 2)}) == 1 and top[0] != top[1]
    terms = plans.topic_terms(fit.beta, 6).where(f"topic = {top[0]}").collect()
    assert {r["term"][0] for r in terms} == {"a"}


def test_search_metrics(spark, matrix):
    got = topics.tune_topics(matrix, ks=(2, 3), max_iter=5).collect()
    assert {(r["k"], r["metric"]) for r in got} == {(k, m) for k in (2, 3) for m in topics.METRICS}
    with pytest.raises(ValueError):
        topics.tune_topics(matrix, metrics=["nothing"])


def test_metric_formulas():
    beta = np.array([[0.5, 0.5, 0.0], [0.0, 0.5, 0.5], [0.2, 0.3, 0.5]])
    gram = beta @ beta.T
    unit = beta / np.linalg.norm(beta, axis=1)[:, None]
    cosines = (unit @ unit.T)[np.triu_indices(3, 1)]
    assert topics.mean_topic_cosine(gram) == pytest.approx(cosines.mean())
    weights = np.array([3.0, 2.0, 1.0])
    s = np.linalg.svd(beta, compute_uv=False)
    want = np.sum(s * np.log(s / weights)) + np.sum(weights * np.log(weights / s))
    assert topics.spectrum_divergence(gram, weights) == pytest.approx(want)


# --- Gibbs sampling ------------------------------------------------------------


def _planted(spark, partitions):
    rng = np.random.default_rng(4)
    rows = []
    for doc in range(60):
        words = [f"{'abc'[doc % 3]}{i}" for i in range(8)]
        rows += [(f"d{doc}", w, int(c)) for w, c in zip(words, rng.multinomial(50, np.ones(8) / 8)) if c]
    rows += [("long", f"a{i % 8}", 40) for i in range(8)] + [(None, "a1", 3), ("d1", None, 3), ("d2", "a1", 0)]
    return spark.createDataFrame(rows, "document string, term string, n bigint").repartition(partitions)


def test_gibbs_finds_planted_topics_under_any_partitioning(spark):
    fits = []
    for partitions, block in ((1, 10**9), (5, 500)):
        seen = []
        fit = gibbs.fit_gibbs(_planted(spark, partitions), 3, sweeps=25, keep=10, alpha=0.5, block_tokens=block)
        counts = {(r["term"], r["topic"]): r["n"] for r in fit.counts.collect()}
        fits.append((counts, fit.likelihoods))
        totals = {}
        for (term, _), n in counts.items():
            totals[term] = totals.get(term, 0) + n
            seen.append(n)
        assert sum(seen) == 60 * 50 + 320 == fit.documents.agg({"n": "sum"}).first()[0]
    assert fits[0][0] == fits[1][0] and [v for _, v in fits[0][1]] == pytest.approx([v for _, v in fits[1][1]])
    best = {t: max(range(1, 4), key=lambda k: counts[t, k]) for t in totals}
    assert len({best[f"{x}0"] for x in "abc"}) == 3
    assert all(best[t] == best[f"{t[0]}0"] and counts[t, best[t]] >= 0.95 * totals[t] for t in totals)
    assert [s for s, _ in fit.likelihoods] == [10, 20, 25] and fit.likelihoods[-1][1] > -3320 * np.log(24)


def test_gibbs_likelihood_against_direct_sums(spark):
    fit = gibbs.fit_gibbs(_planted(spark, 2), 2, sweeps=1, delta=0.3)
    table = {}
    for r in fit.counts.collect():
        table.setdefault(r["topic"], []).append(r["n"])
    words = len(table[1])
    want = 0.0
    for column in table.values():
        want += math.lgamma(words * 0.3) - math.lgamma(sum(column) + words * 0.3)
        want += sum(math.lgamma(n + 0.3) - math.lgamma(0.3) for n in column)
    assert fit.likelihoods[0][1] == pytest.approx(want, rel=1e-12)
    assert gibbs.harmonic_mean([-1000.0, -1010.0]) == pytest.approx(-1010 + math.log(2), abs=1e-4)
    with pytest.raises(ValueError):
        gibbs.fit_gibbs(_planted(spark, 1).limit(0), 2)


def test_log_gamma(spark):
    x = [0.01, 0.1, 0.5, 1.0, 2.0, 7.3, 1e3, 1e9]
    rows = spark.createDataFrame([(v,) for v in x], "x double").select(gibbs.log_gamma(F.col("x")))
    assert [r[0] for r in rows.collect()] == pytest.approx([math.lgamma(v) for v in x], rel=1e-11, abs=1e-10)


def test_search_by_sampling(spark, matrix):
    """Two disjoint vocabularies: two topics explain the words better than one."""
    got = {r["k"]: r["value"] for r in topics.tune_topics(matrix, (1, 2), [topics.SAMPLED], sweeps=15, keep=5).collect()}
    assert got[2] > got[1]
