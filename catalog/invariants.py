"""What must hold of fitted models whatever their numbers are, and fitted forms on given inputs, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import query
from catalog.base import SENTIMENTS, lexicon_of, rounded, sections, table, tokens, with_lexicon, with_tokens
from catalog.matrix import _CELL_SQL, _DIST_SQL, _DTM_SQL, embedding_cells, embedding_labels
from catalog.models import _dtm, _fit, _kmeans, _pruned, lda_tune
from wordloom.operators import cluster, gibbs, indices, matrix as mx, transfers
from wordloom.operators.prefix import dense_index
from wordloom.plans import sentiment as splans, topics as tplans
from wordloom.session import checkpoint, ensure_checkpoint_dir
from wordloom.sources import text as src

# --- trees -----------------------------------------------------------------


@query(
    "ward_sums",
    f"""WITH {_DIST_SQL}, total AS (SELECT sum(s) AS t, max(n) AS n FROM (
  SELECT sum(x * x) - sum(x) * sum(x) / count(*) AS s, count(*) AS n FROM cell GROUP BY col))
SELECT n - 1 AS merges, n AS largest, round(t, 4) AS sum_squares,
  (SELECT round(min(dist), 5) FROM dist) AS lowest FROM total""",
)
def ward_sums(spark, d):
    """Half the squared heights add up to the total sum of squares; the lowest height is the smallest distance."""
    merges, _ = cluster.hclust_ward(embedding_cells(spark, d), "item", "col", "x")
    return merges.agg(
        F.count(F.lit(1)).alias("merges"),
        F.max("size").alias("largest"),
        F.round(F.sum(F.col("height") * F.col("height")) / 2, 4).alias("sum_squares"),
        F.round(F.min("height"), 5).alias("lowest"),
    )


@query(
    "cutree_given",
    """WITH RECURSIVE leaf AS (SELECT vec_id AS item, row_number() OVER (ORDER BY vec_id) - 1 AS node FROM embeddings),
size AS (SELECT count(*) AS n FROM leaf),
up AS (SELECT item, node, node AS root FROM leaf
  UNION ALL SELECT item, node, n + root // 2 FROM up, size WHERE root // 2 < n - 7),
top AS (SELECT item, node, max(root) AS root FROM up GROUP BY item, node)
SELECT item, CAST(dense_rank() OVER (ORDER BY first) AS INTEGER) AS cluster
FROM (SELECT item, min(node) OVER (PARTITION BY root) AS first FROM top)""",
)
def cutree_given(spark, d):
    """A tree in which step s joins nodes 2s and 2s + 1, cut into seven clusters."""
    leaves = dense_index(table(spark, d, "embeddings"), [F.asc("vec_id")], "node").select(F.col("vec_id").alias("item"), "node")
    n = leaves.count()
    steps = spark.range(n - 1).select(
        F.col("id").cast("int").alias("step"), (2 * F.col("id")).alias("a"), (2 * F.col("id") + 1).alias("b")
    )
    return cluster.cutree(steps, leaves, 7)


# --- sampled topics ----------------------------------------------------------


@query(
    "gibbs_totals",
    with_tokens(_DTM_SQL + """
SELECT 'term' AS kind, term AS name, CAST(sum(n) AS BIGINT) AS n FROM dtm GROUP BY term
UNION ALL SELECT 'document', CAST(document AS VARCHAR), CAST(sum(n) AS BIGINT) FROM dtm GROUP BY document"""),
)
def gibbs_totals(spark, d):
    """Whatever topics three sweeps draw, the counts by term and by document add up to the tokens."""
    fit = gibbs.fit_gibbs(_dtm(spark, d), 8, sweeps=3)
    terms = fit.counts.groupBy(F.col("term").alias("name")).agg(F.sum("n").alias("n"))
    documents = fit.documents.groupBy(F.col("document").cast("string").alias("name")).agg(F.sum("n").alias("n"))
    return terms.select(F.lit("term").alias("kind"), "name", "n").unionByName(documents.select(F.lit("document").alias("kind"), "name", "n"))


@query(
    "gibbs_one_topic",
    with_tokens(_DTM_SQL + """, t AS (SELECT term, sum(n) AS n FROM dtm GROUP BY term), s AS (SELECT sum(n) AS n, count(*) AS v FROM t)
SELECT CAST(1 AS INTEGER) AS sweep, round((SELECT sum(lgamma(n + 0.1) - lgamma(0.1)) FROM t) + lgamma(v * 0.1) - lgamma(n + v * 0.1), 3)
  AS log_likelihood FROM s"""),
)
def gibbs_one_topic(spark, d):
    """With one topic the likelihood of the words is known."""
    fit = gibbs.fit_gibbs(_dtm(spark, d), 1, sweeps=1)
    return spark.createDataFrame([(s, round(v, 3)) for s, v in fit.likelihoods], "sweep int, log_likelihood double")


# --- components ------------------------------------------------------------

_NORM_SQL = f"""WITH {_CELL_SQL}, mid AS (SELECT col, avg(x) AS m, stddev_pop(x) AS s FROM cell GROUP BY col)
SELECT item, round(sum({{term}} * {{term}}), 5) AS square FROM cell JOIN mid USING (col) GROUP BY item"""


@query("pca_norms", _NORM_SQL.format(term="((x - m) / s)"))
def pca_norms(spark, d):
    """With all components, a row's scores have the squared length of its scaled distance to the mean."""
    scores, _ = mx.pca(embedding_cells(spark, d), "item", "col", "x", k=64)
    return scores.groupBy("item").agg(F.round(F.sum(F.col("score") * F.col("score")), 5).alias("square"))


@query("mds_norms", _NORM_SQL.format(term="(x - m)"))
def mds_norms(spark, d):
    coords = mx.mds(embedding_cells(spark, d), "item", "col", "x", k=64)
    return coords.groupBy("item").agg(F.round(F.sum(F.col("coord") * F.col("coord")), 5).alias("square"))


def _axes_sql(scaled: bool, steps: int = 13) -> str:
    """The first two axes by squaring the scatter ``steps`` times (a power step of 2^steps), the second after deflation."""
    power = ""
    for which in (1, 2):
        start = "SELECT i, j, v / (SELECT sum(v) FROM scatter1 WHERE i = j) AS v FROM scatter1"
        if which == 2:
            power += f""",
scatter2 AS MATERIALIZED (SELECT s.i, s.j, s.v - l.v * a.v * b.v AS v FROM scatter1 s JOIN axis1 a ON a.i = s.i JOIN axis1 b ON b.i = s.j, value1 l)"""
            start = start.replace("scatter1", "scatter2")
        power += f",\np{which}_0 AS MATERIALIZED ({start})"
        for k in range(steps):
            power += f""",
q{which}_{k} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM p{which}_{k} a JOIN p{which}_{k} b ON a.j = b.i GROUP BY a.i, b.j),
p{which}_{k + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM q{which}_{k} WHERE i = j) AS v FROM q{which}_{k})"""
        power += f""",
column{which} AS (SELECT arg_max(i, v) AS j FROM p{which}_{steps} WHERE i = j),
raw{which} AS (SELECT p.i, p.v FROM p{which}_{steps} p JOIN column{which} USING (j)),
axis{which} AS MATERIALIZED (
  SELECT i, v / (SELECT sqrt(sum(v * v)) FROM raw{which}) * (SELECT sign(arg_max(v, abs(v))) FROM raw{which}) AS v FROM raw{which}),
value{which} AS (SELECT sum(a.v * s.v * b.v) AS v FROM scatter1 s JOIN axis{which} a ON a.i = s.i JOIN axis{which} b ON b.i = s.j)"""
    unit = "stddev_pop(x)" if scaled else "1.0"
    return f"""WITH {_CELL_SQL}, mid AS (SELECT col, avg(x) AS m, {unit} AS s FROM cell GROUP BY col),
z AS MATERIALIZED (SELECT item, col, (x - m) / s AS z FROM cell JOIN mid USING (col)),
scatter1 AS MATERIALIZED (SELECT a.col AS i, b.col AS j, sum(a.z * b.z) AS v FROM z a JOIN z b USING (item) GROUP BY a.col, b.col){power},
axis AS (SELECT 1 AS comp, i, v FROM axis1 UNION ALL SELECT 2, i, v FROM axis2)"""


_SCORES_SQL = """
SELECT item, comp AS {0}, round(sum(z * v), 4) AS {1} FROM z JOIN axis ON i = col GROUP BY item, comp"""


@query("pca_given", _axes_sql(True) + _SCORES_SQL.format("comp", "score"))
def pca_given(spark, d):
    """Two of 64 components, so that the iterative way is taken."""
    scores, _ = mx.pca(embedding_cells(spark, d), "item", "col", "x", k=2, tol=1e-11)
    return rounded(scores, "score", digits=4)


@query("mds_given", _axes_sql(False) + _SCORES_SQL.format("dim", "coord"))
def mds_given(spark, d):
    return rounded(mx.mds(embedding_cells(spark, d), "item", "col", "x", k=2, tol=1e-11), "coord", digits=4)


@query(
    "cluster_discriminant_given",
    """WITH p AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
c AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM p GROUP BY label),
w AS (SELECT sum(xx - n * mx * mx) / (sum(n) - count(*)) AS wx, sum(xy - n * mx * my) / (sum(n) - count(*)) AS wz,
  sum(yy - n * my * my) / (sum(n) - count(*)) AS wy, sum(n * mx * mx) - sum(n * mx) ** 2 / sum(n) AS bx,
  sum(n * mx * my) - sum(n * mx) * sum(n * my) / sum(n) AS bz, sum(n * my * my) - sum(n * my) ** 2 / sum(n) AS b2 FROM c)
SELECT 1.0::DOUBLE AS within1, 1.0::DOUBLE AS within2, 0.0::DOUBLE AS within12,
  round((wy * bx - 2 * wz * bz + wx * b2) / (wx * wy - wz * wz), 5) AS between_sum, 0.0::DOUBLE AS between12 FROM w""",
)
def cluster_discriminant_given(spark, d):
    """Unit within-cluster scatter, uncorrelated axes, and the trace of the between scatter by the within one."""
    points = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("item"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xy")]
    )
    got = mx.discriminant(points, embedding_labels(spark, d), "item", "x", "y", "cluster")
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    per = got.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.avg("dc1").alias("a"), F.avg("dc2").alias("b"),
        *[F.sum(F.col(x) * F.col(y)).alias(o) for x, y, o in (("dc1", "dc1", "aa"), ("dc1", "dc2", "ab"), ("dc2", "dc2", "bb"))],
    )
    free = F.sum(n) - F.count(F.lit(1))

    def between(x, y):
        return F.sum(n * x * y) - F.sum(n * x) * F.sum(n * y) / F.sum(n)

    zero = F.lit(0.0)  # turns -0.0 into 0.0
    return per.agg(
        F.round(F.sum(F.col("aa") - n * a * a) / free, 5).alias("within1"),
        F.round(F.sum(F.col("bb") - n * b * b) / free, 5).alias("within2"),
        (F.round(F.sum(F.col("ab") - n * a * b) / free, 5) + zero).alias("within12"),
        F.round(between(a, a) + between(b, b), 5).alias("between_sum"),
        (F.round(between(a, b), 5) + zero).alias("between12"),
    )


# --- indices on given labels -----------------------------------------------


@query(
    "index_determinant_given",
    """WITH p AS (SELECT c_mktsegment AS g, c_acctbal / 10000 AS x, c_nationkey / 25 AS y FROM customer),
c AS (SELECT count(*) AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM p GROUP BY g),
m AS (SELECT sum(n) AS n, count(*) AS q, sum(xx - x * x / n) AS wx, sum(xy - x * y / n) AS wz, sum(yy - y * y / n) AS wy,
  sum(xx) - sum(x) * sum(x) / sum(n) AS tx, sum(xy) - sum(x) * sum(y) / sum(n) AS tz, sum(yy) - sum(y) * sum(y) / sum(n) AS ty FROM c),
t AS (SELECT *, wx * wy - wz * wz AS dw, tx * ty - tz * tz AS dt FROM m)
SELECT unnest(['scott', 'marriot', 'friedman', 'rubin', 'trcovw']) AS index, round(unnest([
  n * (ln(dt) - ln(dw)), 2 * ln(q) + ln(dw), (wy * (tx - wx) - 2 * wz * (tz - wz) + wx * (ty - wy)) / dw, ln(dt) - ln(dw),
  (wx - wz) ** 2 / 2 + (wy - wz) ** 2 / 2]), 5) AS value FROM t""",
)
def index_determinant_given(spark, d):
    rows = table(spark, d, "customer")
    pair = F.array(F.col("c_acctbal") / 10000, F.col("c_nationkey") / 25)
    cells = rows.select(F.col("c_custkey").alias("item"), F.posexplode(pair).alias("col", "x"))
    names = rows.select("c_mktsegment").distinct()
    numbers = dense_index(names, [F.asc("c_mktsegment")], "node").select("c_mktsegment", (F.col("node") + 1).alias("cluster"))
    labels = rows.join(numbers, "c_mktsegment").select(F.col("c_custkey").alias("item"), "cluster")
    wanted = ["scott", "marriot", "friedman", "rubin", "trcovw"]
    return rounded(indices.cluster_index(cells, labels, wanted), "value", digits=5)


@query(
    "index_split_given",
    f"""WITH {_CELL_SQL}, sums AS (SELECT cluster, col, count(*) AS n, sum(x) AS s, sum(x * x) AS ss FROM cell GROUP BY ALL),
wide AS (SELECT cluster, n, sum(ss - s * s / n) AS w FROM sums GROUP BY cluster, n ORDER BY w DESC, cluster LIMIT 1),
half AS (SELECT item % 2 AS h, col, count(*) AS n, sum(x) AS s, sum(x * x) AS ss FROM cell
  WHERE cluster = (SELECT cluster FROM wide) GROUP BY ALL),
t AS (SELECT n, w, (SELECT sum(ss - s * s / n) FROM half) AS w2, (SELECT count(DISTINCT col) FROM cell) AS p FROM wide),
u AS (SELECT *, 1 - 2 / (pi() * p) - 3.2 * sqrt(greatest(2 * (1 - 8 / (pi() * pi() * p)) / (n * p), 0)) AS crit FROM t)
SELECT unnest(['duda', 'pseudot2', 'beale', 'duda_critical', 'pseudot2_critical']) AS index, round(unnest([
  w2 / w, (w - w2) / (w2 / (n - 2)), ((w - w2) / w2) / (((n - 1) / (n - 2)) * 2 ** (2.0 / p) - 1), crit,
  CASE WHEN crit > 0 THEN (1 - crit) / crit * (n - 2) END]), 5) AS value FROM u""",
)
def index_split_given(spark, d):
    """The widest cluster, split by the parity of the key."""
    cells, labels = embedding_cells(spark, d), embedding_labels(spark, d)
    profile = indices.cluster_profile(cells, labels)
    p = indices.scatter_sums(profile, labels)["p"]
    halves = labels.select("item", (F.col("item") % 2).alias("cluster"))
    found = indices.split_indices(cells, labels, profile, p, halves=halves)
    found.pop("beale_p")
    return rounded(indices._long(spark, found), "value", digits=5)


# --- fitted clusters and topics --------------------------------------------


@query(
    "transfer_gains_given",
    f"""WITH {_CELL_SQL}, label AS (SELECT vec_id AS item, CAST(vec_id % 5 + 1 AS INTEGER) AS cluster FROM embeddings),
size AS (SELECT cluster, count(*) AS n FROM label GROUP BY cluster),
centre AS (SELECT l.cluster, col, sum(x) / max(n) AS m FROM cell JOIN label l USING (item) JOIN size s ON s.cluster = l.cluster GROUP BY l.cluster, col),
dist AS (SELECT item, centre.cluster, sum((x - m) * (x - m)) AS d FROM cell JOIN centre USING (col) GROUP BY item, centre.cluster),
cost AS (SELECT l.item, l.cluster, a.d * s.n / (s.n - 1) AS own, b.cluster AS to, b.d * t.n / (t.n + 1) AS cost FROM label l
  JOIN dist a ON a.item = l.item AND a.cluster = l.cluster JOIN size s ON s.cluster = l.cluster
  JOIN dist b ON b.item = l.item AND b.cluster <> l.cluster JOIN size t ON t.cluster = b.cluster)
SELECT item, cluster, arg_min("to", cost) AS "to", round(max(own) - min(cost), 6) AS gain FROM cost GROUP BY item, cluster""".replace("AS to,", 'AS "to",'),
)
def transfer_gains_given(spark, d):
    """The best transfer of each vector out of five given clusters."""
    labels = table(spark, d, "embeddings").selectExpr("vec_id AS item", "CAST(vec_id % 5 + 1 AS INT) AS cluster")
    return rounded(transfers.transfer_gains(embedding_cells(spark, d), labels, "item", "col", "x"), "gain")


@query(
    "kmeans_sizes_total",
    with_tokens(" SELECT count(DISTINCT chapter) AS documents, CAST(7 AS BIGINT) AS clusters FROM token"),
)
def kmeans_sizes_total(spark, d):
    labels, _ = _kmeans(spark, d)
    return labels.agg(F.count("document").alias("documents"), F.count_distinct("cluster").alias("clusters"))


@query(
    "kmeans_center_totals",
    with_tokens(_DTM_SQL + """ SELECT term, round(CAST(sum(n) AS DOUBLE), 5) AS total FROM dtm GROUP BY term
HAVING count(*) > (SELECT count(DISTINCT document) FROM dtm) * CAST(0.175 AS DOUBLE)"""),
)
def kmeans_center_totals(spark, d):
    """The centres, weighted by the sizes of their clusters, add up to the column totals."""
    pruned, documents = _pruned(spark, d)
    labels, centers = cluster.kmeans(pruned, k=7, rows=documents)
    sizes = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    weighted = centers.join(sizes, "cluster").groupBy("term").agg(F.sum(F.col("mean") * F.col("size")).alias("total"))
    return rounded(weighted, "total", digits=5)


@query(
    "lda_gamma_mass",
    with_tokens(" SELECT DISTINCT chapter AS document, CAST(8 AS BIGINT) AS topics, 1.0::DOUBLE AS mass FROM token"),
)
def lda_gamma_mass(spark, d):
    gamma = _fit(spark, d).gamma
    return gamma.groupBy("document").agg(F.count(F.lit(1)).alias("topics"), F.round(F.sum("gamma"), 6).alias("mass"))


@query(
    "lda_beta_mass",
    with_tokens(""" SELECT CAST(unnest(range(1, 9)) AS INTEGER) AS topic, terms, mass
FROM (SELECT count(DISTINCT word) AS terms, 1.0::DOUBLE AS mass FROM token)"""),
)
def lda_beta_mass(spark, d):
    beta = _fit(spark, d).beta
    return beta.groupBy("topic").agg(F.count_distinct("term").alias("terms"), F.round(F.sum("beta"), 6).alias("mass"))


@query("lda_top_topic_cover", with_tokens(" SELECT count(DISTINCT chapter) AS documents FROM token"))
def lda_top_topic_cover(spark, d):
    """Each document has a top topic."""
    return tplans.doc_top_topic(_fit(spark, d).gamma).agg(F.count_distinct("document").alias("documents"))


@query(
    "lda_tune_ranges",
    """SELECT CAST(k AS INTEGER) AS k, metric, true AS in_range FROM range(5, 11) AS r(k),
(SELECT unnest(['mean_cosine', 'spectrum_divergence', 'log_likelihood', 'log_perplexity']) AS metric)""",
)
def lda_tune_ranges(spark, d):
    """Cosines in 0..1, a divergence of at least 0, a negative log-likelihood, a positive log-perplexity."""
    v = F.col("value")
    inside = (
        F.when(F.col("metric") == "mean_cosine", v.between(0, 1))
        .when(F.col("metric") == "log_likelihood", v < 0)
        .otherwise(v >= 0)
    )
    return lda_tune(spark, d).select("k", "metric", inside.alias("in_range"))


# --- sources and contrast --------------------------------------------------


@query("src_lexicon", with_lexicon(" SELECT word, sentiment FROM lexicon"))
def src_lexicon(spark, d):
    """A sentiment table a user brings as CSV, read back."""
    path = f"{ensure_checkpoint_dir(spark)}/lexicon-{uuid.uuid4().hex}"
    lexicon_of(tokens(spark, d)).write.option("header", True).csv(path)
    return src.read_lexicon(spark, path, "word", "sentiment")


@query(
    "src_document_files",
    "SELECT CAST(doc_id AS INTEGER) AS chapter, md5(text) AS digest FROM documents WHERE text <> ''",
)
def src_document_files(spark, d):
    """One file per document, there and back."""
    path = f"{ensure_checkpoint_dir(spark)}/documents-{uuid.uuid4().hex}"
    docs = sections(spark, d).where("text <> ''").select("chapter", "text")
    src.write_text_by_key(docs, ["chapter"], "text", path)
    back = src.read_documents(spark, f"{path}/*/*.txt", r"()chapter=(\d+)/")
    return back.select("chapter", F.md5(F.regexp_replace("text", r"\n\z", "")).alias("digest"))


@query(
    "q_comparison_scores_by_volume",
    with_lexicon(f""", c AS (SELECT volume, word AS term, sentiment, count(*) AS n FROM token JOIN lexicon USING (word) GROUP BY ALL),
p AS (SELECT volume, term, sentiment, n / sum(n) OVER (PARTITION BY volume, sentiment) AS p FROM c),
g AS (SELECT volume, term, max(p) AS best, sum(p) / {len(SENTIMENTS)} AS mean FROM p GROUP BY volume, term),
s AS (SELECT volume, term, (SELECT min(sentiment) FROM p WHERE p.volume = g.volume AND p.term = g.term AND p.p = best) AS sentiment, round(best - mean, 12) AS weight FROM g)
SELECT volume, term, sentiment, weight FROM s QUALIFY rank() OVER (PARTITION BY volume ORDER BY weight DESC) <= 100"""),
)
def q_comparison_scores_by_volume(spark, d):
    toks = tokens(spark, d)
    return splans.sentiment_comparison(toks, lexicon_of(toks), SENTIMENTS, 100, by=["volume"])
