"""Sentiment reports and smoothed series."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.base import (
    EXCLUDED_VOLUME,
    SENTIMENTS,
    counted_tokens,
    in_list,
    lexicon_of,
    rounded,
    sql_array,
    table,
    tokens,
    with_lexicon,
    with_tokens,
)
from wordloom.operators.loess import loess
from wordloom.plans import sentiment as plans, words

_MATCH = " FROM token JOIN lexicon USING (word)"


def _inputs(spark, d):
    toks = counted_tokens(spark, d)
    return toks, lexicon_of(toks)


@query(
    "q_sentiment_totals",
    with_lexicon(f""", c AS (SELECT sentiment, count(*) AS value{_MATCH} GROUP BY sentiment)
SELECT sentiment, value FROM c QUALIFY rank() OVER (ORDER BY value DESC) <= 7"""),
)
def q_sentiment_totals(spark, d):
    return plans.sentiment_totals(*_inputs(spark, d))


def _modal_sql(where: str, rest: str) -> str:
    return with_lexicon(f""", c AS (SELECT book, chapter, sentiment, count(*) AS n{_MATCH} {where} GROUP BY ALL),
m AS (SELECT book, chapter, sentiment, n FROM c QUALIFY rank() OVER (PARTITION BY chapter ORDER BY n DESC) = 1) {rest}""")


_BY_BOOK = """, k AS (SELECT book, sentiment, count(*) AS n FROM m GROUP BY ALL)
SELECT book, sentiment, n, round(n / sum(n) OVER (PARTITION BY book), 6) AS sent_perc FROM k"""


@query("q_modal_sentiment", _modal_sql("", "SELECT * FROM m"))
def q_modal_sentiment(spark, d):
    return plans.modal_sentiment(*_inputs(spark, d))


@query(
    "q_modal_sentiment_filtered", _modal_sql("WHERE sentiment NOT IN ('positive', 'negative')", "SELECT * FROM m")
)
def q_modal_sentiment_filtered(spark, d):
    return plans.modal_sentiment(*_inputs(spark, d), exclude=["positive", "negative"])


@query("q_sentiment_by_book", _modal_sql("", _BY_BOOK))
def q_sentiment_by_book(spark, d):
    return rounded(plans.sentiment_by_book(*_inputs(spark, d)), "sent_perc")


@query("q_sentiment_by_book_filtered", _modal_sql("WHERE sentiment <> 'positive'", _BY_BOOK))
def q_sentiment_by_book_filtered(spark, d):
    return rounded(plans.sentiment_by_book(*_inputs(spark, d), exclude=["positive"]), "sent_perc")


@query(
    "q_lexicon_composition",
    with_lexicon(r""", c AS (SELECT sentiment, count(*) AS n FROM lexicon GROUP BY sentiment),
p AS (SELECT sentiment, n, n / sum(n) OVER () * 100 AS p,
  sum(n) OVER (ORDER BY n DESC, sentiment ROWS UNBOUNDED PRECEDING) / sum(n) OVER () * 100 AS c FROM c)
SELECT sentiment, n, CAST(CAST(round_even(p, 0) AS INTEGER) AS VARCHAR) || ' %' AS perc,
  regexp_replace(regexp_replace(CAST(CAST(round_even(c, 1) AS DECIMAL(18,1)) AS VARCHAR), '0+$', ''), '\.$', '') || ' %'
  AS cumulative FROM p"""),
)
def q_lexicon_composition(spark, d):
    return plans.lexicon_composition(_inputs(spark, d)[1])


_SERIES_SQL = f""", c AS (SELECT chapter, sentiment, count(*) AS n{_MATCH}
  WHERE volume <> '{EXCLUDED_VOLUME}' AND sentiment IN {in_list(plans.SERIES)} GROUP BY ALL)"""


@query(
    "q_sentiment_share",
    with_lexicon(_SERIES_SQL + """
SELECT chapter, sentiment, n, round(n / sum(n) OVER (PARTITION BY chapter), 6) AS n2 FROM c"""),
)
def q_sentiment_share(spark, d):
    return rounded(plans.sentiment_share(*_inputs(spark, d), EXCLUDED_VOLUME), "n2")


@query(
    "q_sentiment_weighted",
    with_lexicon(_SERIES_SQL + """, w AS (SELECT *, n / sum(n) OVER (PARTITION BY sentiment) AS aa FROM c)
SELECT chapter, sentiment, n, round(aa, 9) AS aa, round(aa / sum(aa) OVER (PARTITION BY chapter), 6) AS n2 FROM w"""),
)
def q_sentiment_weighted(spark, d):
    out = plans.sentiment_weighted(*_inputs(spark, d), EXCLUDED_VOLUME)
    return rounded(rounded(out, "aa", digits=9), "n2")


@query(
    "q_keywordset_series",
    with_tokens(" SELECT word, volume, chapter, count(*) AS n FROM token WHERE word IN ('thing', 'thth') GROUP BY ALL"),
)
def q_keywordset_series(spark, d):
    return words.keyword_series(tokens(spark, d), ["thing", "thth"])


@query(
    "q_posneg_series",
    with_lexicon(f""" SELECT chapter, sentiment, count(*) AS n{_MATCH}
WHERE volume <> '{EXCLUDED_VOLUME}' AND sentiment IN ('positive', 'negative') GROUP BY ALL"""),
)
def q_posneg_series(spark, d):
    return plans.posneg_series(*_inputs(spark, d), EXCLUDED_VOLUME)


@query(
    "q_comparison_scores",
    with_lexicon(f""", c AS (SELECT word AS term, sentiment, count(*) AS n{_MATCH} GROUP BY ALL),
p AS (SELECT term, sentiment, n / sum(n) OVER (PARTITION BY sentiment) AS p FROM c),
g AS (SELECT term, max(p) AS best, max_by(sentiment, p) AS sentiment, sum(p) / {len(SENTIMENTS)} AS mean FROM p GROUP BY term),
s AS (SELECT term, sentiment, round(best - mean, 12) AS weight FROM g)
SELECT term, sentiment, weight FROM s QUALIFY rank() OVER (ORDER BY weight DESC) <= 500"""),
)
def q_comparison_scores(spark, d):
    return plans.sentiment_comparison(*_inputs(spark, d), SENTIMENTS)


# --- smoothing -------------------------------------------------------------


def _daily(spark, d):
    events = table(spark, d, "events").select("event_type", F.unix_date(F.to_date("ts")).alias("day"))
    return events.groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("n"))


_DAILY_SQL = """WITH p AS (SELECT event_type, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS DOUBLE) AS x,
  CAST(count(*) AS DOUBLE) AS y FROM events GROUP BY ALL)"""


def _fit_sql(by: str, span: float) -> str:
    """Direct sums over all pairs of a grid point and a point of ``p``; ``f`` has the fit and what the band needs."""
    return f""", g AS (SELECT {by}, min(x) AS lo, max(x) AS hi, count(*) AS n FROM p GROUP BY {by}),
e AS (SELECT {by}, i, n, lo + i * ((hi - lo) / 79) AS x0, x, y, abs(x - (lo + i * ((hi - lo) / 79))) AS d
  FROM p JOIN g USING ({by}) CROSS JOIN range(80) AS t(i)),
b AS (SELECT {by}, i, list_sort(list(d))[CAST(least(greatest(floor(n * {span} + 1e-5), 1), n) AS INTEGER)] AS h FROM e GROUP BY {by}, i, n),
w AS (SELECT {by}, i, x0, x, y, (x - x0) / h AS u, pow(1 - pow(d / h, 3), 3) AS w FROM e JOIN b USING ({by}, i) WHERE d < h),
s AS (SELECT {by}, i, x0, count(DISTINCT x) AS k, sum(w) AS s0, sum(w*u) AS s1, sum(w*u*u) AS s2, sum(w*u*u*u) AS s3,
  sum(w*u*u*u*u) AS s4, sum(w*y) AS t0, sum(w*y*u) AS t1, sum(w*y*u*u) AS t2,
  sum(w*w) AS n0, sum(w*w*u) AS n1, sum(w*w*u*u) AS n2, sum(w*w*u*u*u) AS n3, sum(w*w*u*u*u*u) AS n4 FROM w GROUP BY ALL),
r AS (SELECT *, s0*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2) AS det FROM s WHERE k >= 3),
f AS (SELECT {by}, i, x0, (t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2)) / det AS fit, (s2*s4-s3*s3) / det AS a,
  (s2*s3-s1*s4) / det AS b, (s1*s3-s2*s2) / det AS c, (a*a*n0 + 2*a*b*n1 + (b*b+2*a*c)*n2 + 2*b*c*n3 + c*c*n4) AS norm FROM r)"""


# 97.5 % points of Student's t for 1 to 6 degrees of freedom, its expansion in 1/df above.
_T_SQL = """CASE WHEN df <= 0 THEN NULL WHEN df <= 1 THEN 12.706204736432095
  WHEN df <= 2 THEN 4.302652729911275 + (1/df - 1/2) / (1 - 1/2) * (12.706204736432095 - 4.302652729911275)
  WHEN df <= 3 THEN 3.182446305284263 + (1/df - 1/3) / (1/2 - 1/3) * (4.302652729911275 - 3.182446305284263)
  WHEN df <= 4 THEN 2.7764451051977987 + (1/df - 1/4) / (1/3 - 1/4) * (3.182446305284263 - 2.7764451051977987)
  WHEN df <= 5 THEN 2.5705818366147395 + (1/df - 1/5) / (1/4 - 1/5) * (2.7764451051977987 - 2.5705818366147395)
  WHEN df <= 6 THEN 2.4469118511449692 + (1/df - 1/6) / (1/5 - 1/6) * (2.5705818366147395 - 2.4469118511449692)
  ELSE z + (pow(z,3)+z)/4/df + (5*pow(z,5)+16*pow(z,3)+3*z)/96/pow(df,2) + (3*pow(z,7)+19*pow(z,5)+17*pow(z,3)-15*z)/384/pow(df,3)
    + (79*pow(z,9)+776*pow(z,7)+1482*pow(z,5)-1920*pow(z,3)-945*z)/92160/pow(df,4) END"""


def _band_sql(by: str, span: float) -> str:
    return _fit_sql(by, span) + f""", spot AS (SELECT {by}, x, y, (x - lo) / ((hi - lo) / 79) AS place FROM p JOIN g USING ({by})),
cell AS (SELECT *, CAST(least(floor(place), 78) AS BIGINT) AS i FROM spot),
line AS (SELECT c.{by}, c.y, l.fit + (r.fit - l.fit) * (place - c.i) AS fit, l.a + (r.a - l.a) * (place - c.i) AS lev,
  l.norm + (r.norm - l.norm) * (place - c.i) AS lev2
  FROM cell c JOIN f l ON l.{by} = c.{by} AND l.i = c.i JOIN f r ON r.{by} = c.{by} AND r.i = c.i + 1),
noise AS (SELECT {by}, sum((y - fit) * (y - fit)) AS rss, sum(1 - 2 * lev + lev2) AS df, CAST(1.959963984540054 AS DOUBLE) AS z FROM line GROUP BY {by}),
band AS (SELECT {by}, x0, fit, sqrt(rss / df * norm) AS se, {_T_SQL} AS t FROM f JOIN noise USING ({by}))
SELECT {by}, round(x0, 6) AS x, round(fit, 5) AS y, round(se, 5) AS se, round(fit - t * se, 4) AS ymin, round(fit + t * se, 4) AS ymax
FROM band"""


_SMOOTH_SQL = " SELECT {by}, round(x0, 6) AS x, round(fit, 5) AS y FROM f"


@query("smooth_loess", _DAILY_SQL + _fit_sql("event_type", 0.75) + _SMOOTH_SQL.format(by="event_type"))
def smooth_loess(spark, d):
    fit = loess(_daily(spark, d), "day", "n", ["event_type"], span=0.75)
    return rounded(rounded(fit, "x"), "y", digits=5)


@query("smooth_loess_se", _DAILY_SQL + _band_sql("event_type", 0.7))
def smooth_loess_se(spark, d):
    fit = loess(_daily(spark, d), "day", "n", ["event_type"], span=0.7, se=True)
    return rounded(rounded(rounded(fit, "x"), "y", "se", digits=5), "ymin", "ymax", digits=4)


@query(
    "q_sentiment_share_smooth",
    with_lexicon(
        _SERIES_SQL
        + """, p AS (SELECT sentiment, CAST(chapter AS DOUBLE) AS x, n / sum(n) OVER (PARTITION BY chapter) AS y FROM c)"""
        + _fit_sql("sentiment", 0.75)
        + _SMOOTH_SQL.format(by="sentiment")
    ),
)
def q_sentiment_share_smooth(spark, d):
    """The share of each sentiment over the chapters, smoothed."""
    fit = plans.sentiment_share_smooth(*_inputs(spark, d), EXCLUDED_VOLUME)
    return rounded(rounded(fit, "x"), "y", digits=5)


@query(
    "q_keyword_smooth",
    with_tokens(
        """, p AS (SELECT word, CAST(chapter AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS y FROM token
  WHERE word IN ('thing', 'thth') GROUP BY word, volume, chapter)"""
        + _band_sql("word", 0.6)
    ),
)
def q_keyword_smooth(spark, d):
    """Counts of words over the chapters, smoothed, with a band."""
    fit = words.keyword_smooth(tokens(spark, d), ["thing", "thth"], span=0.6)
    return rounded(rounded(rounded(fit, "x"), "y", "se", digits=5), "ymin", "ymax", digits=4)
