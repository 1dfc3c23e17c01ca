"""Document-term matrices, distances, topic and cluster reports.

The reports run on topic and cluster tables that are computed from the
documents by hashing, so SQL can follow them; ``catalog.models`` runs the same
reports on fitted models.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.base import (
    CHARACTERS,
    EXCLUDED_VOLUME,
    SENTIMENTS,
    chapter_tokens,
    counted_tokens,
    in_list,
    lexicon_of,
    rounded,
    sections,
    table,
    tokens,
    with_lexicon,
    with_tokens,
)
from catalog.counting import box_sql
from wordloom.operators import dtm as dt, indices, matrix as mx, verbs
from wordloom.plans import clusters as cplans, topics as tplans
from wordloom.session import checkpoint

TOPICS, CLUSTERS = 8, 7
MAIN_TOPICS = [4, 5, 7]

# --- assignments by hashing ------------------------------------------------


def _digits(*parts) -> F.Column:
    """A number in 0..65535 from the md5 of some values."""
    key = F.concat_ws(":", *[F.col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("bigint")


def _digits_sql(*parts) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 4) AS BIGINT)"


def gamma_table(spark, d):
    docs = sections(spark, d).select(F.col("chapter").alias("document"))
    cells = docs.withColumn("topic", F.explode(F.sequence(F.lit(1), F.lit(TOPICS))))
    cells = cells.withColumn("w", 1 + _digits("document", "topic") % 97)
    return verbs.share(cells, "w", ["document"], "gamma").select("document", "topic", "gamma")


def beta_table(toks):
    counts = verbs.tally(toks, ["word"]).withColumnRenamed("word", "term")
    cells = counts.withColumn("topic", F.explode(F.sequence(F.lit(1), F.lit(TOPICS))))
    cells = cells.withColumn("w", F.col("n") * (1 + _digits("term", "topic") % 11))
    return verbs.share(cells, "w", ["topic"], "beta").select("topic", "term", "beta")


def document_labels(spark, d):
    docs = sections(spark, d).select(F.col("chapter").alias("document"))
    return docs.withColumn("cluster", (1 + _digits("document") % CLUSTERS).cast("int"))


GAMMA_SQL = f""", gw AS (SELECT chapter AS document, CAST(t AS INTEGER) AS topic,
  1 + {_digits_sql('chapter', 't')} % 97 AS w FROM section CROSS JOIN range(1, {TOPICS + 1}) AS r(t)),
gamma AS (SELECT document, topic, w / sum(w) OVER (PARTITION BY document) AS gamma FROM gw),
top_topic AS (SELECT document, topic, gamma FROM gamma QUALIFY rank() OVER (PARTITION BY document ORDER BY gamma DESC) = 1)"""
BETA_SQL = f""", bw AS (SELECT word AS term, CAST(t AS INTEGER) AS topic, n * (1 + {_digits_sql('word', 't')} % 11) AS w
  FROM (SELECT word, count(*) AS n FROM token GROUP BY word) CROSS JOIN range(1, {TOPICS + 1}) AS r(t)),
beta AS (SELECT topic, term, w / sum(w) OVER (PARTITION BY topic) AS beta FROM bw)"""
LABEL_SQL = f""", doc_label AS (SELECT chapter AS document,
  CAST(1 + {_digits_sql('chapter')} % {CLUSTERS} AS INTEGER) AS cluster FROM section)"""


# --- matrices --------------------------------------------------------------

_DTM_SQL = ", dtm AS (SELECT chapter AS document, word AS term, count(*) AS n FROM token GROUP BY ALL)"


def _dtm(spark, d):
    return dt.dtm(chapter_tokens(spark, d), "chapter", "word")


@query("dtm_long", with_tokens(_DTM_SQL + " SELECT document, term, n FROM dtm"))
def dtm_long(spark, d):
    return _dtm(spark, d)


@query("dtm_tidy", with_tokens(_DTM_SQL + " SELECT document, term, n AS count FROM dtm"))
def dtm_tidy(spark, d):
    return dt.tidy_dtm(_dtm(spark, d))


@query(
    "dtm_prune_sparse",
    with_tokens(_DTM_SQL + """ SELECT document, term, n FROM dtm WHERE term IN (SELECT term FROM dtm GROUP BY term
  HAVING count(*) > (SELECT count(DISTINCT document) FROM dtm) * CAST(0.175 AS DOUBLE))"""),
)
def dtm_prune_sparse(spark, d):
    return dt.prune_sparse(checkpoint(_dtm(spark, d)), 0.825)


def embedding_cells(spark, d):
    rows = table(spark, d, "embeddings")
    return rows.select(
        F.col("vec_id").alias("item"), F.posexplode("embedding").alias("col", "x")
    ).withColumn("x", F.col("x").cast("double"))


def embedding_labels(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), (F.col("label") + 1).alias("cluster"))


_CELL_SQL = """cell AS (SELECT vec_id AS item, label + 1 AS cluster, generate_subscripts(embedding, 1) - 1 AS col,
  CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"""
_DIST_SQL = f"""{_CELL_SQL}, dist AS (SELECT a.item AS a, b.item AS b, a.cluster AS ka, b.cluster AS kb,
  sqrt(sum((a.x - b.x) * (a.x - b.x))) AS dist FROM cell a JOIN cell b ON a.col = b.col AND a.item < b.item GROUP BY ALL)"""
_LABEL_SQL = "lab AS (SELECT vec_id AS item, label + 1 AS cluster FROM embeddings)"


@query("pairwise_distance", f"WITH {_DIST_SQL} SELECT a, b, round(dist, 6) AS dist FROM dist")
def pairwise_distance(spark, d):
    return rounded(mx.pairwise_distance(embedding_cells(spark, d), "item", "col", "x"), "dist")


_SIL_SQL = f"""both_ways AS (SELECT a AS item, ka AS k, kb AS l, dist FROM dist UNION ALL SELECT b, kb, ka, dist FROM dist),
means AS (SELECT item, k, l, avg(dist) AS m FROM both_ways GROUP BY ALL),
ab AS (SELECT item, max(m) FILTER (k = l) AS a, min(m) FILTER (k <> l) AS b FROM means GROUP BY item),
sil AS (SELECT item, CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END AS s FROM ab)"""


@query(
    "index_silhouette",
    f"WITH {_DIST_SQL}, {_LABEL_SQL}, {_SIL_SQL} SELECT item, cluster, round(s, 6) AS silhouette FROM sil JOIN lab USING (item)",
)
def index_silhouette(spark, d):
    vectors = mx.row_vectors(embedding_cells(spark, d), "item", "col", "x")
    labels = embedding_labels(spark, d)
    scores = indices.silhouette_scores(indices.item_cluster_distances(vectors, labels), labels)
    return rounded(scores, "silhouette")


@query(
    "index_dunn",
    f"""WITH {_DIST_SQL} SELECT 'dunn' AS index,
  round(min(dist) FILTER (ka <> kb) / max(dist) FILTER (ka = kb), 6) AS value FROM dist""",
)
def index_dunn(spark, d):
    return rounded(indices.cluster_index(embedding_cells(spark, d), embedding_labels(spark, d), "dunn"), "value")


_SCATTER_SQL = f"""{_CELL_SQL}, per AS (SELECT cluster, col, count(*) AS n, sum(x) AS s, sum(x * x) AS ss FROM cell GROUP BY ALL),
cols AS (SELECT col, sum(ss - s * s / n) AS w, sum(ss) - sum(s) * sum(s) / sum(n) AS t FROM per GROUP BY col),
tot AS (SELECT sum(w) AS w, sum(t) AS t, avg(sqrt((t - w) / t)) AS r FROM cols),
size AS (SELECT count(*) AS n, count(DISTINCT label) AS q FROM embeddings)"""


@query(
    "index_scatter",
    f"""WITH {_SCATTER_SQL} SELECT unnest(['trace_w', 'ch', 'ball', 'ratkowsky']) AS index,
  round(unnest([w, ((t - w) / (q - 1)) / (w / (n - q)), w / q, r / sqrt(q)]), 6) AS value FROM tot, size""",
)
def index_scatter(spark, d):
    return rounded(indices.cluster_index(embedding_cells(spark, d), embedding_labels(spark, d), "scatter"), "value")


@query(
    "index_pairdist",
    f"""WITH {_DIST_SQL}, {_LABEL_SQL}, {_SIL_SQL},
cen AS (SELECT cluster, col, avg(x) AS m FROM cell GROUP BY ALL),
gap AS (SELECT a.cluster AS ka, b.cluster AS kb, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS g
  FROM cen a JOIN cen b USING (col) GROUP BY ALL),
tot AS (SELECT count(*) FILTER (ka = kb) AS nw, sum(dist) FILTER (ka = kb) AS sw, count(*) FILTER (ka <> kb) AS nb,
  sum(dist) FILTER (ka <> kb) AS sb, count(*) AS nt, stddev_samp(dist) AS sd,
  min(dist) FILTER (ka <> kb) AS lo, max(dist) FILTER (ka = kb) AS hi FROM dist),
hub AS (SELECT sum(dist * g) / count(*) AS h FROM dist JOIN gap USING (ka, kb)),
ends AS (SELECT sum(dist) FILTER (up <= nw) AS low, sum(dist) FILTER (down <= nw) AS high FROM (
  SELECT dist, row_number() OVER (ORDER BY dist) AS up, row_number() OVER (ORDER BY dist DESC) AS down FROM dist), tot)
SELECT unnest(['silhouette', 'dunn', 'mcclain', 'ptbiserial', 'hubert', 'cindex']) AS index,
  round(unnest([(SELECT avg(s) FROM sil), lo / hi, (sw / nw) / (sb / nb),
    (sb / nb - sw / nw) * sqrt(CAST(nw AS DOUBLE) * nb / (CAST(nt AS DOUBLE) * nt)) / sd, h, (sw - low) / (high - low)]), 6) AS value
FROM tot, hub, ends""",
)
def index_pairdist(spark, d):
    found = indices.cluster_index(
        embedding_cells(spark, d), embedding_labels(spark, d), ["pairdist"], block=256
    )
    return rounded(found, "value")


@query(
    "index_centers",
    f"""WITH {_CELL_SQL}, cen AS (SELECT cluster, col, avg(x) AS m, avg(x * x) - avg(x) * avg(x) AS v, count(*) AS n FROM cell GROUP BY ALL),
gap AS (SELECT a.cluster AS i, b.cluster AS j, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS g
  FROM cen a JOIN cen b ON a.col = b.col AND a.cluster <> b.cluster GROUP BY ALL),
spr AS (SELECT cluster, sqrt(sum(v)) AS s, sqrt(sum(v * v)) AS nv FROM cen GROUP BY cluster),
q AS (SELECT count(*) AS q, avg(nv) AS mean_nv, sqrt(sum(nv)) / count(*) AS stdev FROM spr),
allv AS (SELECT sqrt(sum(v * v)) AS nv FROM (SELECT col, avg(x * x) - avg(x) * avg(x) AS v FROM cell GROUP BY col)),
db AS (SELECT avg(m) AS db FROM (SELECT i, max((a.s + b.s) / g) AS m FROM gap JOIN spr a ON i = a.cluster JOIN spr b ON j = b.cluster GROUP BY i)),
dis AS (SELECT (SELECT max(g) / min(g) FROM gap) * sum(1 / s) AS dis FROM (SELECT i, sum(g) AS s FROM gap GROUP BY i)),
mid AS (SELECT a.cluster AS i, b.cluster AS j, a.col AS col, (a.m + b.m) / 2 AS u, a.m AS ma, b.m AS mb
  FROM cen a JOIN cen b ON a.col = b.col AND a.cluster < b.cluster),
away AS (SELECT i, j, item, sqrt(sum((x - u) * (x - u))) AS du, sqrt(sum((x - ma) * (x - ma))) AS da, sqrt(sum((x - mb) * (x - mb))) AS db
  FROM mid JOIN cell ON mid.col = cell.col AND cell.cluster IN (i, j) GROUP BY ALL),
dens AS (SELECT i, j, count(*) FILTER (du <= stdev) AS nu, count(*) FILTER (da <= stdev) AS na, count(*) FILTER (db <= stdev) AS nb
  FROM away, q GROUP BY i, j),
bw AS (SELECT 2 * sum(CASE WHEN greatest(na, nb) = 0 THEN 0.0 ELSE nu / greatest(na, nb) END) AS t FROM dens),
own AS (SELECT item, cell.cluster AS cluster, sqrt(sum((x - m) * (x - m))) AS d FROM cell JOIN cen ON cell.col = cen.col AND cell.cluster = cen.cluster GROUP BY ALL),
din AS (SELECT avg(d) AS dindex FROM (SELECT cluster, avg(d) AS d FROM own GROUP BY cluster))
SELECT unnest(['db', 'scat', 'dis', 'dens_bw', 'sdbw', 'dindex']) AS index,
  round(unnest([db, mean_nv / allv.nv, dis, t / (q * (q - 1)), mean_nv / allv.nv + t / (q * (q - 1)), dindex]), 6) AS value
FROM db, q, allv, dis, bw, din""",
)
def index_centers(spark, d):
    return rounded(indices.cluster_index(embedding_cells(spark, d), embedding_labels(spark, d), "centers"), "value")


# --- topic reports ---------------------------------------------------------


@query("q_doc_top_topic", with_tokens(GAMMA_SQL + " SELECT document, topic, round(gamma, 6) AS gamma FROM top_topic"))
def q_doc_top_topic(spark, d):
    return rounded(tplans.doc_top_topic(gamma_table(spark, d)), "gamma")


@query(
    "q_topic_terms",
    with_tokens(BETA_SQL + """ SELECT topic, term, round(beta, 9) AS beta FROM beta
QUALIFY rank() OVER (PARTITION BY topic ORDER BY beta DESC) <= 15"""),
)
def q_topic_terms(spark, d):
    return rounded(tplans.topic_terms(beta_table(tokens(spark, d))), "beta", digits=9)


def _group_sql(group: str, more: int) -> str:
    return with_tokens(GAMMA_SQL + f""", c AS (SELECT {group}, topic, count(*) AS n FROM top_topic
  JOIN section ON document = chapter GROUP BY ALL HAVING count(*) > {more})
SELECT {group}, topic, n, round(n / sum(n) OVER (PARTITION BY {group}), 6) AS topic_perc FROM c""")


@query("q_topic_by_group", _group_sql("book", 3))
def q_topic_by_group(spark, d):
    out = tplans.topic_by_group(gamma_table(spark, d), sections(spark, d), "book", 3)
    return rounded(out, "topic_perc")


@query("q_topic_by_volume", _group_sql("volume", 6))
def q_topic_by_volume(spark, d):
    out = tplans.topic_by_group(gamma_table(spark, d), sections(spark, d), "volume", 6)
    return rounded(out, "topic_perc")


_BOX_ROUND = ("q1", "median", "q3", "whisker_low", "whisker_high")


def _rounded_box_sql(keys: str, source: str) -> str:
    inner = box_sql("v", keys, "gamma").replace("q AS (", "q AS MATERIALIZED (", 1)
    head, body = inner.split("\nSELECT ", 1)
    return f"""{source}, {head}, box AS (SELECT {body})
SELECT {keys}, q1, median, q3, round(whisker_low, 6) AS whisker_low, round(whisker_high, 6) AS whisker_high, outliers, n FROM box"""


@query(
    "q_gamma_box",
    with_tokens(_rounded_box_sql("topic, volume", GAMMA_SQL + ", v AS (SELECT topic, volume, gamma FROM gamma JOIN section ON document = chapter)")),
)
def q_gamma_box(spark, d):
    return rounded(tplans.gamma_box(gamma_table(spark, d), sections(spark, d)), *_BOX_ROUND)


@query(
    "q_topic_tfidf",
    with_tokens(GAMMA_SQL + """, c AS (SELECT topic, word, document, count(*) AS n FROM top_topic JOIN token ON document = chapter GROUP BY ALL),
t AS (SELECT *, n / total AS tf, ln(docs / df) AS idf, n / total * ln(docs / df) AS tf_idf FROM (
  SELECT *, sum(n) OVER (PARTITION BY topic) AS total, count(*) OVER (PARTITION BY word) AS df,
    (SELECT count(DISTINCT topic) FROM c) AS docs FROM c))
SELECT topic, word, document, n, round(tf, 9) AS tf, round(idf, 9) AS idf, round(tf_idf, 9) AS tf_idf FROM t
QUALIFY rank() OVER (PARTITION BY topic ORDER BY t.tf_idf DESC) <= 7"""),
)
def q_topic_tfidf(spark, d):
    return rounded(tplans.topic_tfidf(gamma_table(spark, d), chapter_tokens(spark, d)), "tf", "idf", "tf_idf", digits=9)


def _topic_sent_sql(terms: int, rest: str) -> str:
    return with_lexicon(BETA_SQL + f""", top AS (SELECT topic, term FROM beta QUALIFY rank() OVER (PARTITION BY topic ORDER BY beta DESC) <= {terms}),
c AS (SELECT topic, sentiment, count(*) AS n FROM top JOIN lexicon ON term = word GROUP BY ALL) {rest}""")


@query(
    "q_topic_sentiment",
    _topic_sent_sql(300, "SELECT topic, sentiment, n FROM c QUALIFY rank() OVER (PARTITION BY topic ORDER BY n DESC) <= 4"),
)
def q_topic_sentiment(spark, d):
    toks = tokens(spark, d)
    return tplans.topic_sentiment(beta_table(toks), lexicon_of(toks))


@query(
    "q_topic_sentiment_share",
    _topic_sent_sql(300, """, s AS (SELECT *, n / sum(n) OVER (PARTITION BY sentiment) AS p FROM c)
SELECT topic, sentiment, n, round(p, 6) AS sent_perc FROM s QUALIFY rank() OVER (PARTITION BY topic ORDER BY p DESC) <= 4"""),
)
def q_topic_sentiment_share(spark, d):
    toks = tokens(spark, d)
    return rounded(tplans.topic_sentiment_share(beta_table(toks), lexicon_of(toks)), "sent_perc")


@query(
    "q_sentiment_topics",
    _topic_sent_sql(500, """SELECT topic, sentiment, n, substr(sentiment, 1, 3) AS sent1 FROM c
QUALIFY rank() OVER (PARTITION BY sentiment ORDER BY n DESC) <= 4"""),
)
def q_sentiment_topics(spark, d):
    toks = tokens(spark, d)
    return tplans.sentiment_topics(beta_table(toks), lexicon_of(toks))


_FEELINGS = ["fear", "joy", "trust", "surprise"]


@query(
    "q_topic_book_sentiment",
    with_lexicon(BETA_SQL + f""", c AS (SELECT volume, book, chapter, word, count(*) AS n FROM token
  WHERE volume <> '{EXCLUDED_VOLUME}' GROUP BY ALL HAVING count(*) > 1.25),
k AS (SELECT topic, book, sentiment, count(*) AS n FROM c JOIN beta ON word = term JOIN lexicon USING (word)
  WHERE topic IN (4, 5, 7) AND beta > CAST(0.0005 AS DOUBLE) AND sentiment IN {in_list(_FEELINGS)} GROUP BY ALL)
SELECT topic, book, sentiment, n, CAST(sum(n) OVER (PARTITION BY topic, book) AS BIGINT) AS tot_sents,
  round(n / sum(n) OVER (PARTITION BY topic, book), 6) AS sent_perc FROM k"""),
)
def q_topic_book_sentiment(spark, d):
    toks = counted_tokens(spark, d)
    out = tplans.topic_book_sentiment(
        toks, beta_table(toks), lexicon_of(toks), MAIN_TOPICS, _FEELINGS, EXCLUDED_VOLUME, min_beta=0.0005
    )
    return rounded(out, "sent_perc")


_TRIM_SQL = r"""regexp_replace(regexp_replace(CAST(CAST(round_even({x}, 1) AS DECIMAL(18,1)) AS VARCHAR), '0+$', ''), '\.$', '') || ' %'"""


@query(
    "q_topic_summary",
    with_tokens(GAMMA_SQL + """, c AS (SELECT volume, topic, count(*) AS n FROM gamma JOIN section ON document = chapter
  WHERE gamma > 0.15 GROUP BY ALL),
t AS (SELECT topic, CAST(sum(n) AS BIGINT) AS tot, max(n) AS max,
  """ + _TRIM_SQL.format(x="CAST(sum(n) AS DOUBLE) / (SELECT count(DISTINCT document) FROM gamma) * 100") + """ AS perc_tot FROM c GROUP BY topic)
SELECT t.topic, tot, max, perc_tot, volume FROM t JOIN c ON t.topic = c.topic AND n = max"""),
)
def q_topic_summary(spark, d):
    return tplans.topic_summary(gamma_table(spark, d), sections(spark, d))


# --- cluster reports -------------------------------------------------------

_PROFILE_SQL = f""", presence AS (SELECT DISTINCT chapter, word FROM token),
profile AS (SELECT a.word AS item1, b.word AS item2, count(*) AS n FROM presence a JOIN presence b USING (chapter)
  WHERE a.word <> b.word AND a.word IN {in_list(CHARACTERS)} GROUP BY ALL HAVING count(*) > 10)"""
_ITEM_LABEL_SQL = f""", item_label AS (SELECT item, CAST(1 + {_digits_sql('item')} % 4 AS INTEGER) AS cluster
  FROM (SELECT DISTINCT item1 AS item FROM profile)),
member AS (SELECT cluster, item1, item2 AS word, n FROM profile JOIN item_label ON item1 = item
  WHERE item2 NOT IN {in_list(CHARACTERS)} AND n > 30)"""


def profiles(spark, d):
    return checkpoint(cplans.entity_profiles(chapter_tokens(spark, d), CHARACTERS))


def _item_labels(prof):
    items = prof.select(F.col("item1").alias("item")).distinct()
    return items.withColumn("cluster", (1 + _digits("item") % 4).cast("int"))


@query("entity_profiles", with_tokens(_PROFILE_SQL + " SELECT item1, item2, n FROM profile"))
def entity_profiles(spark, d):
    return profiles(spark, d)


@query(
    "q_cluster_words",
    with_tokens(_PROFILE_SQL + _ITEM_LABEL_SQL + """, c AS (SELECT cluster, word, sum(n) / count(*) AS tot FROM member GROUP BY ALL)
SELECT cluster, word, round(tot, 6) AS tot FROM c QUALIFY rank() OVER (PARTITION BY cluster ORDER BY c.tot DESC) <= 6"""),
)
def q_cluster_words(spark, d):
    prof = profiles(spark, d)
    return rounded(cplans.cluster_words(prof, _item_labels(prof), CHARACTERS), "tot")


@query(
    "q_cluster_tfidf",
    with_tokens(_PROFILE_SQL + _ITEM_LABEL_SQL + """, t AS (SELECT *, n / total * ln(docs / df) AS tf_idf FROM (
  SELECT *, sum(n) OVER (PARTITION BY item1) AS total, count(*) OVER (PARTITION BY word) AS df,
    (SELECT count(DISTINCT item1) FROM member) AS docs FROM member)),
c AS (SELECT cluster, word, sum(CAST(tf_idf AS DECIMAL(38,15))) / count(*) AS m, sum(n) / count(*) AS tot FROM t GROUP BY ALL)
SELECT cluster, word, round(CAST(m AS DOUBLE), 9) AS m_tf_idf, round(tot, 6) AS tot FROM c
QUALIFY rank() OVER (PARTITION BY cluster ORDER BY m DESC) <= 6"""),
)
def q_cluster_tfidf(spark, d):
    prof = profiles(spark, d)
    out = cplans.cluster_tfidf(prof, _item_labels(prof), CHARACTERS)
    return rounded(rounded(out, "m_tf_idf", digits=9), "tot")


@query("q_cluster_sizes", with_tokens(LABEL_SQL + " SELECT cluster, count(*) AS n FROM doc_label GROUP BY cluster"))
def q_cluster_sizes(spark, d):
    return cplans.cluster_sizes(document_labels(spark, d))


@query(
    "q_cluster_topics",
    with_tokens(GAMMA_SQL + LABEL_SQL + """, c AS (SELECT topic, cluster, count(*) AS n FROM gamma JOIN doc_label USING (document)
  WHERE gamma > 0.2 GROUP BY ALL)
SELECT topic, cluster, n, round(n / sum(n) OVER (PARTITION BY cluster), 6) AS perc FROM c"""),
)
def q_cluster_topics(spark, d):
    return rounded(cplans.cluster_topics(gamma_table(spark, d), document_labels(spark, d)), "perc")


@query(
    "q_cluster_topic_box",
    with_tokens(_rounded_box_sql("topic, cluster", GAMMA_SQL + LABEL_SQL + ", v AS (SELECT topic, cluster, gamma FROM gamma JOIN doc_label USING (document))")),
)
def q_cluster_topic_box(spark, d):
    return rounded(cplans.cluster_topic_box(gamma_table(spark, d), document_labels(spark, d)), *_BOX_ROUND)


@query(
    "q_cluster_volume_pivot",
    with_tokens(LABEL_SQL + """, c AS (SELECT volume, cluster, count(*) AS n FROM doc_label JOIN section ON document = chapter GROUP BY ALL),
p AS (SELECT volume, cluster, CAST(CAST(round_even(n / sum(n) OVER (PARTITION BY volume) * 100, 0) AS INTEGER) AS VARCHAR) || ' %' AS label FROM c)
SELECT volume, """ + ", ".join(f"coalesce(max(label) FILTER (cluster = {i}), '0') AS \"{i}\"" for i in range(1, CLUSTERS + 1))
                + " FROM p GROUP BY volume"),
)
def q_cluster_volume_pivot(spark, d):
    return cplans.cluster_volume_pivot(document_labels(spark, d), sections(spark, d), range(1, CLUSTERS + 1))


_CLUSTER_WORD_SQL = LABEL_SQL + ", c AS (SELECT cluster, word, count(*) AS n FROM token JOIN doc_label ON chapter = document GROUP BY ALL)"


@query(
    "q_cluster_top_words",
    with_tokens(_CLUSTER_WORD_SQL + " SELECT cluster, word, n FROM c QUALIFY rank() OVER (PARTITION BY cluster ORDER BY n DESC) <= 10"),
)
def q_cluster_top_words(spark, d):
    return cplans.cluster_top_words(chapter_tokens(spark, d), document_labels(spark, d))


@query(
    "q_cluster_top_tfidf",
    with_tokens(_CLUSTER_WORD_SQL + """, t AS (SELECT *, n / total AS tf, ln(docs / df) AS idf, n / total * ln(docs / df) AS tf_idf FROM (
  SELECT *, sum(n) OVER (PARTITION BY cluster) AS total, count(*) OVER (PARTITION BY word) AS df,
    (SELECT count(DISTINCT cluster) FROM c) AS docs FROM c))
SELECT cluster, word, n, round(tf, 9) AS tf, round(idf, 9) AS idf, round(tf_idf, 9) AS tf_idf FROM t
QUALIFY rank() OVER (PARTITION BY cluster ORDER BY t.tf_idf DESC) <= 7"""),
)
def q_cluster_top_tfidf(spark, d):
    out = cplans.cluster_top_tfidf(chapter_tokens(spark, d), document_labels(spark, d))
    return rounded(out, "tf", "idf", "tf_idf", digits=9)


@query(
    "q_cluster_contrast",
    with_tokens(LABEL_SQL + f""", c AS (SELECT cluster, word AS term, count(*) AS n FROM token JOIN doc_label ON chapter = document GROUP BY ALL),
p AS (SELECT term, cluster, n / sum(n) OVER (PARTITION BY cluster) AS p FROM c),
g AS (SELECT term, max(p) AS best, max_by(cluster, p) AS cluster, sum(p) / {CLUSTERS} AS mean FROM p GROUP BY term),
s AS (SELECT term, cluster, round(best - mean, 12) AS weight FROM g)
SELECT term, cluster, weight FROM s QUALIFY rank() OVER (ORDER BY weight DESC) <= 600"""),
)
def q_cluster_contrast(spark, d):
    from wordloom.operators.cluster import cluster_centers

    labels = document_labels(spark, d)
    centers = cluster_centers(_dtm(spark, d), labels, "document", "term", "n")
    return cplans.cluster_contrast(centers, range(1, CLUSTERS + 1))
