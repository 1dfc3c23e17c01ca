"""Aggregations, shares, ranking, reshaping, and the word reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.base import (
    CHARACTERS,
    ENTITIES,
    EXCLUDED_VOLUME,
    KEYS,
    TOKEN_SQL,
    VOLUMES,
    bigrams,
    in_list,
    lexicon_of,
    rounded,
    sections,
    table,
    tokens,
    with_bigrams,
    with_lexicon,
    with_tokens,
)
from wordloom.operators import stats, tfidf, verbs
from wordloom.operators.prefix import cumulative_pct
from wordloom.plans import words

KEYWORD = "ther"


# --- counting and aggregates -----------------------------------------------


@query("agg_count", with_tokens(" SELECT volume, word, count(*) AS n FROM token GROUP BY ALL"))
def agg_count(spark, d):
    return verbs.count_by(tokens(spark, d), ["volume", "word"])


@query(
    "agg_words_in_all_groups",
    with_tokens(""" SELECT word, count(DISTINCT book) AS n FROM token GROUP BY word
HAVING count(DISTINCT book) = (SELECT count(DISTINCT book) FROM token)"""),
)
def agg_words_in_all_groups(spark, d):
    return verbs.words_in_all(tokens(spark, d), "word", "book")


@query(
    "agg_two_level",
    with_tokens(""", c AS (SELECT volume, book, chapter, count(*) AS n FROM token GROUP BY ALL)
SELECT volume, book, count(*) AS chapters, CAST(sum(n) AS BIGINT) AS words FROM c GROUP BY ALL"""),
)
def agg_two_level(spark, d):
    chapters = verbs.count_by(tokens(spark, d), KEYS)
    return chapters.groupBy("volume", "book").agg(F.count(F.lit(1)).alias("chapters"), F.sum("n").alias("words"))


@query(
    "agg_stats",
    """SELECT l_returnflag, l_suppkey, count(*) AS n, sum(l_quantity) AS tot, round(avg(l_quantity), 6) AS mean,
  round(stddev_samp(l_quantity), 6) AS sd, max(l_extendedprice) AS top FROM lineitem GROUP BY ALL""",
)
def agg_stats(spark, d):
    out = table(spark, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("l_quantity").alias("tot"),
        F.avg("l_quantity").alias("mean"),
        F.stddev_samp("l_quantity").alias("sd"),
        F.max("l_extendedprice").alias("top"),
    )
    return rounded(out, "mean", "sd")


@query("agg_grand_total", "SELECT count(*) AS n, sum(l_quantity) AS tot FROM lineitem")
def agg_grand_total(spark, d):
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("tot"))


@query(
    "agg_all_numeric",
    """SELECT l_returnflag, l_linestatus, CAST(sum(l_orderkey) AS BIGINT) AS l_orderkey,
  CAST(sum(l_partkey) AS BIGINT) AS l_partkey, CAST(sum(l_suppkey) AS BIGINT) AS l_suppkey,
  CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber, round(sum(l_quantity), 2) AS l_quantity,
  round(sum(l_extendedprice), 2) AS l_extendedprice, round(sum(l_discount), 2) AS l_discount,
  round(sum(l_tax), 2) AS l_tax FROM lineitem GROUP BY ALL""",
)
def agg_all_numeric(spark, d):
    sums = verbs.sum_numeric(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])
    doubles = [c for c, kind in sums.dtypes if kind == "double"]
    return rounded(sums, *doubles, digits=2)


@query("agg_doc_freq", with_tokens(" SELECT word AS term, count(DISTINCT chapter) AS n FROM token GROUP BY word"))
def agg_doc_freq(spark, d):
    dtm = verbs.count_by(tokens(spark, d), ["chapter", "word"]).select(F.col("word").alias("term"))
    return verbs.count_by(dtm, ["term"])


_TFIDF_SQL = """ SELECT {cols}, n, round(n / total, 9) AS tf, round(ln(docs / df), 9) AS idf,
  round(n / total * ln(docs / df), 9) AS tf_idf FROM (
  SELECT *, sum(n) OVER (PARTITION BY {doc}) AS total, count(*) OVER (PARTITION BY word) AS df,
    (SELECT count(DISTINCT {doc}) FROM c) AS docs FROM c)"""


@query(
    "tf_idf",
    with_tokens(", c AS (SELECT volume, word, count(*) AS n FROM token GROUP BY ALL)"
                + _TFIDF_SQL.format(cols="volume, word", doc="volume")),
)
def tf_idf(spark, d):
    counts = verbs.count_by(tokens(spark, d), ["volume", "word"])
    return rounded(tfidf.bind_tf_idf(counts, "word", "volume", "n"), "tf", "idf", "tf_idf", digits=9)


@query(
    "tf_idf_dup_rows",
    with_tokens(", c AS (SELECT volume, word, book, count(*) AS n FROM token GROUP BY ALL)"
                + _TFIDF_SQL.format(cols="volume, word, book", doc="volume")),
)
def tf_idf_dup_rows(spark, d):
    counts = verbs.count_by(tokens(spark, d), ["volume", "word", "book"])
    return rounded(tfidf.bind_tf_idf(counts, "word", "volume", "n"), "tf", "idf", "tf_idf", digits=9)


@query(
    "agg_ratio_mean",
    with_tokens(""", c AS (SELECT volume, chapter, word, count(*) AS n FROM token GROUP BY ALL)
SELECT volume, word, round(sum(n) / count(*), 6) AS tot FROM c GROUP BY ALL"""),
)
def agg_ratio_mean(spark, d):
    counts = verbs.count_by(tokens(spark, d), ["volume", "chapter", "word"])
    out = counts.groupBy("volume", "word").agg((F.sum("n") / F.count(F.lit(1))).alias("tot"))
    return rounded(out, "tot")


@query("agg_contingency", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def agg_contingency(spark, d):
    return verbs.count_by(table(spark, d, "embeddings"), ["label"], sort=True)


@query(
    "agg_col_totals",
    with_tokens(" SELECT word, count(*) AS tot FROM token GROUP BY word HAVING count(*) > 500"),
)
def agg_col_totals(spark, d):
    dtm = verbs.count_by(tokens(spark, d), ["chapter", "word"])
    totals = dtm.groupBy("word").agg(F.sum("n").alias("tot")).where(F.col("tot") > 500)
    return totals.orderBy(F.desc("tot"), "word")


_HIST_SQL = """, r AS (SELECT min(x) AS lo, (max(x) - min(x)) / 29 AS w FROM v),
b AS (SELECT facet, CAST(ceil((x - (lo - w / 2)) / w) AS BIGINT) AS bin, lo, w FROM v, r)
SELECT facet AS {facet}, bin, round(lo + (bin - 1) * w, 6) AS center, count(*) AS n FROM b GROUP BY ALL"""


@query(
    "agg_histogram",
    "WITH v AS (SELECT o_orderstatus AS facet, o_totalprice AS x FROM orders)" + _HIST_SQL.format(facet="o_orderstatus"),
)
def agg_histogram(spark, d):
    orders = table(spark, d, "orders").select("o_orderstatus", "o_totalprice")
    return rounded(stats.histogram(orders, "o_totalprice", 30, ["o_orderstatus"]), "center")


def box_sql(source: str, keys: str, y: str) -> str:
    """Box-plot summary of ``y`` by ``keys`` over a relation, in SQL."""
    return f"""q AS (SELECT {keys}, quantile_cont({y}, 0.25) AS q1, quantile_cont({y}, 0.5) AS median,
  quantile_cont({y}, 0.75) AS q3 FROM {source} GROUP BY ALL)
SELECT {keys}, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  min({y}) FILTER ({y} >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
  max({y}) FILTER ({y} <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER ({y} < q1 - 1.5 * (q3 - q1) OR {y} > q3 + 1.5 * (q3 - q1)) AS outliers,
  count(*) AS n FROM {source} JOIN q USING ({keys}) GROUP BY {keys}, q1, median, q3"""


@query("agg_boxplot", "WITH " + box_sql("customer", "c_mktsegment", "c_acctbal"))
def agg_boxplot(spark, d):
    return rounded(stats.boxplot_stats(table(spark, d, "customer"), "c_acctbal", ["c_mktsegment"]), "q1", "median", "q3")


# --- shares and ranks ------------------------------------------------------


@query(
    "win_share",
    with_tokens(""", c AS (SELECT volume, book, count(*) AS n FROM token GROUP BY ALL)
SELECT volume, book, n, round(n / sum(n) OVER (PARTITION BY volume), 6) AS share FROM c"""),
)
def win_share(spark, d):
    return rounded(verbs.share(verbs.count_by(tokens(spark, d), ["volume", "book"]), "n", ["volume"]), "share")


@query(
    "win_double_share",
    with_tokens(""", c AS (SELECT volume, book, count(*) AS n FROM token GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY volume) AS aa FROM c)
SELECT volume, book, n, round(aa, 6) AS aa, round(aa / sum(aa) OVER (PARTITION BY book), 6) AS n2 FROM s"""),
)
def win_double_share(spark, d):
    counts = verbs.count_by(tokens(spark, d), ["volume", "book"])
    once = verbs.share(counts, "n", ["volume"], "aa")
    return rounded(verbs.share(once, "aa", ["book"], "n2"), "aa", "n2")


@query(
    "win_group_total",
    with_tokens(""", c AS (SELECT chapter, word, count(*) AS n FROM token GROUP BY ALL)
SELECT chapter, word, n, CAST(sum(n) OVER (PARTITION BY chapter) AS BIGINT) AS n_chapter FROM c"""),
)
def win_group_total(spark, d):
    counts = verbs.count_by(tokens(spark, d), ["chapter", "word"])
    return verbs.group_total(counts, "n", ["chapter"], "n_chapter")


@query(
    "win_cum_pct",
    with_tokens(""", c AS (SELECT word, count(*) AS n FROM token GROUP BY word)
SELECT word, n, round(sum(n) OVER (ORDER BY n DESC, word ROWS UNBOUNDED PRECEDING) / (SELECT sum(n) FROM c) * 100, 6)
  AS cumulative FROM c"""),
)
def win_cum_pct(spark, d):
    counts = verbs.count_by(tokens(spark, d), ["word"])
    return rounded(cumulative_pct(counts, "n", [F.desc("n"), F.asc("word")]), "cumulative")


@query(
    "topn_global",
    with_tokens(""", c AS (SELECT word, count(*) AS n FROM token GROUP BY word)
SELECT word, n FROM c QUALIFY rank() OVER (ORDER BY n DESC) <= 25"""),
)
def topn_global(spark, d):
    return verbs.top_n(verbs.count_by(tokens(spark, d), ["word"]), 25)


@query(
    "topn_group",
    with_tokens(""", c AS (SELECT book, word, count(*) AS n FROM token GROUP BY ALL)
SELECT book, word, n FROM c QUALIFY rank() OVER (PARTITION BY book ORDER BY n DESC) <= 10"""),
)
def topn_group(spark, d):
    return verbs.top_n(verbs.count_by(tokens(spark, d), ["book", "word"]), 10, "n", ["book"])


@query(
    "bottomn_group",
    with_tokens(""", c AS (SELECT volume, book, chapter, count(*) AS n FROM token GROUP BY ALL)
SELECT volume, book, chapter, n FROM c QUALIFY rank() OVER (PARTITION BY volume ORDER BY n) <= 7"""),
)
def bottomn_group(spark, d):
    return verbs.top_n(verbs.count_by(tokens(spark, d), KEYS), -7, "n", ["volume"])


@query(
    "slice_max",
    with_tokens(""", c AS (SELECT volume, book, count(*) AS n FROM token GROUP BY ALL)
SELECT volume, book, n FROM c QUALIFY rank() OVER (PARTITION BY volume ORDER BY n DESC) = 1"""),
)
def slice_max(spark, d):
    return verbs.slice_max(verbs.count_by(tokens(spark, d), ["volume", "book"]), "n", ["volume"])


@query(
    "modal_category_share",
    with_lexicon(""", c AS (SELECT book, chapter, sentiment, count(*) AS n FROM token JOIN lexicon USING (word) GROUP BY ALL),
m AS (SELECT book, sentiment FROM c QUALIFY rank() OVER (PARTITION BY chapter ORDER BY n DESC) = 1),
k AS (SELECT book, sentiment, count(*) AS n FROM m GROUP BY ALL)
SELECT book, sentiment, n, round(n / sum(n) OVER (PARTITION BY book), 6) AS share FROM k"""),
)
def modal_category_share(spark, d):
    from wordloom.operators.sentiment import sentiment_counts

    toks = tokens(spark, d)
    counts = sentiment_counts(toks, lexicon_of(toks), ["book", "chapter"])
    modal = verbs.slice_max(counts, "n", ["chapter"])
    return rounded(verbs.share(verbs.count_by(modal, ["book", "sentiment"]), "n", ["book"]), "share")


@query(
    "argmax_index",
    """WITH c AS (SELECT l_returnflag, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, min(l_suppkey) AS l_suppkey FROM (
  SELECT * FROM c QUALIFY rank() OVER (PARTITION BY l_returnflag ORDER BY n DESC) = 1) GROUP BY ALL""",
)
def argmax_index(spark, d):
    counts = verbs.count_by(table(spark, d, "lineitem"), ["l_returnflag", "l_suppkey"])
    return verbs.argmax_index(counts, "l_suppkey", "n", ["l_returnflag"])


# --- sorting and reshaping -------------------------------------------------


@query("sort_multi", "SELECT o_orderstatus, o_totalprice, o_orderkey FROM orders")
def sort_multi(spark, d):
    orders = table(spark, d, "orders").select("o_orderstatus", "o_totalprice", "o_orderkey")
    return orders.orderBy("o_orderstatus", F.desc("o_totalprice"), "o_orderkey")


@query(
    "pivot_fill",
    with_tokens(" SELECT word, " + ", ".join(f"count(*) FILTER (volume = '{v}') AS {v}" for v in VOLUMES)
                + " FROM token GROUP BY word"),
)
def pivot_fill(spark, d):
    counts = verbs.count_by(tokens(spark, d), ["word", "volume"])
    return verbs.spread(counts, "volume", "n", fill=0, values=VOLUMES)


@query(
    "unpivot_range",
    """SELECT l_orderkey, l_linenumber, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS measure,
  unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS amount FROM lineitem""",
)
def unpivot_range(spark, d):
    items = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )
    return verbs.gather(items, "measure", "amount", "l_quantity", "l_tax")


@query(
    "zero_fill_totals",
    with_tokens(f""", k AS (SELECT DISTINCT chapter FROM token), v AS (SELECT unnest({CHARACTERS}) AS word),
c AS (SELECT chapter, word, count(*) AS n FROM token GROUP BY ALL)
SELECT chapter, word, coalesce(n, 0) AS n FROM k CROSS JOIN v LEFT JOIN c USING (chapter, word)"""),
)
def zero_fill_totals(spark, d):
    counts = verbs.count_by(tokens(spark, d), ["chapter", "word"])
    return verbs.zero_fill_totals(counts, ["chapter"], "word", "n", CHARACTERS)


@query(
    "matrix_subset",
    with_tokens(f""", c AS (SELECT word, chapter, count(*) AS n FROM token WHERE word IN {in_list(CHARACTERS)} GROUP BY ALL),
keep AS (SELECT chapter FROM token GROUP BY chapter HAVING count(*) > 500)
SELECT chapter, """ + ", ".join(f"coalesce(sum(n) FILTER (word = '{w}'), 0)::BIGINT AS {w}" for w in CHARACTERS)
                + " FROM c SEMI JOIN keep USING (chapter) GROUP BY chapter"),
)
def matrix_subset(spark, d):
    counts = verbs.count_by(tokens(spark, d), ["chapter", "word"])
    keep = counts.groupBy("chapter").agg(F.sum("n").alias("tot")).where(F.col("tot") > 500)
    rows = counts.where(F.col("word").isin(*CHARACTERS)).join(keep, "chapter", "left_semi")
    return verbs.spread(rows, "word", "n", fill=0, values=CHARACTERS)


@query(
    "matrix_transpose",
    with_tokens(" SELECT word AS chapter, chapter AS word, count(*) AS n FROM token GROUP BY token.word, token.chapter"),
)
def matrix_transpose(spark, d):
    return verbs.transpose(verbs.count_by(tokens(spark, d), ["chapter", "word"]), "chapter", "word")


@query(
    "split_sample",
    """SELECT doc_id, CAST('0x' || substr(md5('234:' || doc_id), 1, 8) AS BIGINT) < 3435973836 AS in_sample FROM documents""",
)
def split_sample(spark, d):
    return verbs.split_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 0.8, seed=234)


@query(
    "sample_exact",
    """WITH h AS (SELECT doc_id, CAST('0x' || substr(md5('1030:' || doc_id), 1, 15) AS BIGINT) AS h, count(*) OVER () AS n FROM documents)
SELECT doc_id, row_number() OVER (ORDER BY h) <= floor(n * 0.8 + 1e-9) AS in_sample FROM h""",
)
def sample_exact(spark, d):
    return verbs.sample_exact(table(spark, d, "documents").select("doc_id"), "doc_id", 0.8, seed=1030)


# --- word reports ----------------------------------------------------------


@query(
    "q_volume_summary",
    with_tokens(" SELECT volume, count(DISTINCT chapter) AS chapters, count(*) AS total_words FROM token GROUP BY volume"),
)
def q_volume_summary(spark, d):
    return words.volume_summary(tokens(spark, d))


@query(
    "q_words_per_chapter_box",
    with_tokens(""", c AS (SELECT volume, book, chapter, word, count(*) AS n FROM token GROUP BY ALL),
v AS (SELECT volume, book, CAST(sum(n) OVER (PARTITION BY chapter) AS BIGINT) AS n_chapter FROM c), """
                + box_sql("v", "volume, book", "n_chapter")),
)
def q_words_per_chapter_box(spark, d):
    return rounded(words.words_per_chapter_box(tokens(spark, d)), "q1", "median", "q3")


@query(
    "q_term_freq_hist",
    with_tokens(""", c AS (SELECT volume, word, count(*) AS n FROM token GROUP BY ALL),
v AS (SELECT volume AS facet, n / sum(n) OVER (PARTITION BY volume) AS x FROM c)""" + _HIST_SQL.format(facet="volume")),
)
def q_term_freq_hist(spark, d):
    return rounded(words.term_freq_hist(tokens(spark, d)), "center")


@query(
    "q_top_words",
    with_tokens(""", c AS (SELECT word, count(*) AS n FROM token GROUP BY word)
SELECT word, n FROM c QUALIFY rank() OVER (ORDER BY n DESC) <= 10"""),
)
def q_top_words(spark, d):
    return words.top_words(tokens(spark, d))


@query(
    "q_top_words_by_volume",
    with_tokens(""", c AS (SELECT volume, word, count(*) AS n FROM token GROUP BY ALL)
SELECT volume, word, n FROM c QUALIFY rank() OVER (PARTITION BY volume ORDER BY n DESC) <= 5"""),
)
def q_top_words_by_volume(spark, d):
    return words.top_words_by_volume(tokens(spark, d))


@query(
    "q_top_bigrams",
    with_bigrams(""", c AS (SELECT bigram, count(*) AS n FROM bigram GROUP BY ALL)
SELECT bigram, n FROM c QUALIFY rank() OVER (ORDER BY n DESC) <= 10"""),
)
def q_top_bigrams(spark, d):
    return words.top_bigrams(bigrams(spark, d))


@query(
    "q_keyword_stats",
    with_tokens(f""", c AS (SELECT volume, book, count(*) AS n FROM token WHERE word = '{KEYWORD}' GROUP BY ALL)
SELECT volume, CAST(sum(n) AS BIGINT) AS tot, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS sd
FROM c GROUP BY volume"""),
)
def q_keyword_stats(spark, d):
    return rounded(words.keyword_stats(tokens(spark, d), KEYWORD), "mean", "sd")


@query(
    "q_keyword_series",
    with_tokens(f""" SELECT volume, chapter, word, count(*) AS n FROM token
WHERE word = '{KEYWORD}' AND volume <> '{EXCLUDED_VOLUME}' GROUP BY ALL"""),
)
def q_keyword_series(spark, d):
    return words.keyword_series(tokens(spark, d), [KEYWORD], EXCLUDED_VOLUME)


@query(
    "q_keyword_bigrams",
    with_bigrams(f""", c AS (SELECT w1, w2, count(*) AS n FROM split_bigram
  WHERE w1 = '{KEYWORD}' OR w2 = '{KEYWORD}' GROUP BY ALL)
SELECT w1 || ' ' || w2 AS bigram, n FROM c QUALIFY rank() OVER (ORDER BY n DESC) <= 8"""),
)
def q_keyword_bigrams(spark, d):
    return words.keyword_bigrams(bigrams(spark, d), KEYWORD)


@query(
    "q_tfidf_by_volume",
    with_tokens(", c AS (SELECT volume, word, count(*) AS n FROM token GROUP BY ALL), t AS ("
                + _TFIDF_SQL.format(cols="volume, word", doc="volume")
                + ") SELECT * FROM t QUALIFY rank() OVER (PARTITION BY volume ORDER BY tf_idf DESC) <= 5"),
)
def q_tfidf_by_volume(spark, d):
    return rounded(words.tfidf_by_volume(tokens(spark, d)), "tf", "idf", "tf_idf", digits=9)


@query(
    "q_tfidf_unique_count",
    with_tokens(""", c AS (SELECT volume, word, count(*) AS n FROM token GROUP BY ALL), t AS (
  SELECT volume, n / total * ln(docs / df) AS tf_idf FROM (
    SELECT *, sum(n) OVER (PARTITION BY volume) AS total, count(*) OVER (PARTITION BY word) AS df,
    (SELECT count(DISTINCT volume) FROM c) AS docs FROM c)), k AS (
  SELECT volume FROM t QUALIFY rank() OVER (ORDER BY tf_idf DESC) <= 500)
SELECT volume, count(*) AS n FROM k GROUP BY volume"""),
)
def q_tfidf_unique_count(spark, d):
    return words.tfidf_unique_count(tokens(spark, d))
