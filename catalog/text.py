"""Sources, structuring, tokens, filters, joins and scalars."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import query
from catalog.base import (
    BIGRAM_SQL,
    EXCLUDED_VOLUME,
    KEYS,
    LEXICON_SQL,
    SECTION_SQL,
    SENTIMENTS,
    STOP_WORDS,
    TOKEN_SQL,
    WORD_RX,
    bigrams,
    in_list,
    lexicon_of,
    rounded,
    sections,
    stop_table,
    table,
    tokens,
    with_bigrams,
    with_lexicon,
    with_tokens,
)
from wordloom.functions.text import percent_label, round_even
from wordloom.operators import structure, tokens as tk, verbs
from wordloom.operators.prefix import fill_down, running_section
from wordloom.session import ensure_checkpoint_dir
from wordloom.sources import text as src

LINES_SQL = """lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents)"""


def _scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _lines(spark, d):
    return src.to_lines(src.read_table(spark, f"{d}/documents.parquet"), "doc_id")


# --- sources and sinks -----------------------------------------------------


@query(
    "src_wholetext",
    "SELECT lang AS volume, source AS book, CAST(sum(length(text) + 1) AS BIGINT) AS chars "
    "FROM documents GROUP BY ALL",
)
def src_wholetext(spark, d):
    path = _scratch(spark, "texts")
    src.write_text_by_key(sections(spark, d), ["volume", "book"], "text", path)
    docs = src.read_documents(spark, f"{path}/*/*/*.txt", key_pattern=None)
    return (
        docs.select(
            F.regexp_extract("path", "volume=([^/]*)/", 1).alias("volume"),
            F.regexp_extract("path", "book=([^/]*)/", 1).alias("book"),
            F.length("text").cast("bigint").alias("chars"),
        )
        .groupBy("volume", "book")
        .agg(F.sum("chars").alias("chars"))
    )


@query(
    "src_filename_keys",
    r"""SELECT page_id, TRY_CAST(regexp_extract(url, '/(\d+)\?page=(\d+)', 1) AS INTEGER) AS book,
       TRY_CAST(regexp_extract(url, '/(\d+)\?page=(\d+)', 2) AS INTEGER) AS chapter FROM pages""",
)
def src_filename_keys(spark, d):
    return table(spark, d, "pages").select("page_id", *src.keys_from_name("url", r"/(\d+)\?page=(\d+)"))


@query("src_lines", f"WITH {LINES_SQL} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, text FROM lines")
def src_lines(spark, d):
    return _lines(spark, d)


@query("meta_lookup", "SELECT c_custkey FROM customer WHERE c_name = 'Customer#000000042'")
def meta_lookup(spark, d):
    return src.meta_lookup(table(spark, d, "customer"), "c_name", "Customer#000000042", "c_custkey")


@query(
    "sink_text",
    "SELECT lang AS volume, source AS book, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_lines "
    "FROM documents GROUP BY ALL",
)
def sink_text(spark, d):
    path = _scratch(spark, "sink")
    src.write_text_by_key(sections(spark, d), ["volume", "book"], "text", path)
    return spark.read.text(path).groupBy("volume", "book").agg(F.count(F.lit(1)).alias("n_lines"))


@query(
    "snapshot_roundtrip",
    "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
)
def snapshot_roundtrip(spark, d):
    path = _scratch(spark, "snapshot")
    src.save_tables({n: table(spark, d, n) for n in ("nation", "region")}, path)
    back = src.load_tables(spark, path, ["nation", "region"])
    joined = verbs.renamed_join(back["nation"], back["region"], {"n_regionkey": "r_regionkey"})
    return verbs.count_by(joined, ["r_name"])


# --- structuring -----------------------------------------------------------


@query(
    "heading_extract",
    f"""WITH {LINES_SQL} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no,
  CASE WHEN regexp_matches(text, '[Tt]he ([a-z]*)') THEN regexp_extract(text, '[Tt]he ([a-z]*)', 1) END AS heading
FROM lines""",
)
def heading_extract(spark, d):
    return structure.extract_heading(_lines(spark, d), "text", "[Tt]he ([a-z]*)", "heading").drop("text")


@query(
    "heading_remap",
    f"""WITH {LINES_SQL} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no,
  CASE WHEN NOT regexp_matches(text, '([a-z]*) the ') THEN NULL
       WHEN regexp_extract(text, '([a-z]*) the ', 1) = 'of' THEN 'SIXTEEN' ELSE 'SEVENTEEN' END AS epilogue
FROM lines""",
)
def heading_remap(spark, d):
    return structure.extract_epilogue(_lines(spark, d), "text", pattern="([a-z]*) the ", first="of").drop("text")


@query(
    "key_coalesce",
    f"""WITH {LINES_SQL}, k AS (SELECT doc_id, line_no,
  CASE WHEN regexp_matches(text, '[Tt]he ([a-z]*)') THEN regexp_extract(text, '[Tt]he ([a-z]*)', 1) END AS heading,
  CASE WHEN NOT regexp_matches(text, '([a-z]*) of ') THEN NULL
       WHEN regexp_extract(text, '([a-z]*) of ', 1) = 'the' THEN 'SIXTEEN' ELSE 'SEVENTEEN' END AS epilogue FROM lines)
SELECT coalesce(epilogue, heading) AS book, count(*) AS n FROM k GROUP BY ALL""",
)
def key_coalesce(spark, d):
    heads = structure.extract_heading(_lines(spark, d), "text", "[Tt]he ([a-z]*)", "heading")
    heads = structure.extract_epilogue(heads, "text", pattern="([a-z]*) of ", first="the")
    return verbs.count_by(heads.select(F.coalesce("epilogue", "heading").alias("book")), ["book"])


@query(
    "running_section",
    """SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS section FROM conversations""",
)
def running_section_q(spark, d):
    conv = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return running_section(conv, F.col("role") == "user", "turn", by=["conv_id"], offset=-1).drop("role")


@query(
    "fill_down",
    """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked FROM conversations""",
)
def fill_down_q(spark, d):
    conv = table(spark, d, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "user", F.length("text").cast("bigint")).alias("asked")
    )
    return fill_down(conv, ["asked"], "turn", by=["conv_id"])


@query(
    "number_words",
    "SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS INTEGER) AS book FROM lineitem",
)
def number_words(spark, d):
    names = F.array(*[F.lit(w) for w in "ONE TWO THREE FOUR FIVE SIX SEVEN".split()])
    spelled = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.get(names, F.col("l_linenumber") - 1).alias("book")
    )
    return structure.number_words(spelled, "book")


@query(
    "case_bucket",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 4 THEN 1 WHEN l_quantity < 9 THEN 2
  WHEN l_quantity < 12 THEN 3 WHEN l_quantity < 16 THEN 4 ELSE 5 END AS volume FROM lineitem""",
)
def case_bucket(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return structure.bucket(items, "l_quantity", (4, 9, 12, 16), (1, 2, 3, 4, 5), "volume").drop("l_quantity")


@query("project_cols", "SELECT o_orderkey AS order_id, o_orderstatus, o_totalprice FROM orders")
def project_cols(spark, d):
    orders = table(spark, d, "orders").drop("o_orderpriority", "o_orderdate", "o_custkey")
    return verbs.relocate(orders.withColumnRenamed("o_orderkey", "order_id"), "o_totalprice", after="o_orderstatus")


@query(
    "line_filters",
    rf"""WITH {LINES_SQL} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, text FROM lines
WHERE doc_id IS NOT NULL AND regexp_matches(text, '\S')
  AND NOT regexp_matches(text, '[A-Z]{{4,}}\s([IVXLCM]+\s)?') AND NOT regexp_matches(text, '[0-9]')""",
)
def line_filters(spark, d):
    return structure.keep_prose(_lines(spark, d), "text", ["doc_id"])


@query(
    "collapse_text",
    f"WITH {LINES_SQL} SELECT doc_id, string_agg(text, ' ' ORDER BY line_no) AS text FROM lines GROUP BY doc_id",
)
def collapse_text(spark, d):
    return structure.collapse_text(_lines(spark, d), ["doc_id"], "text", "line_no")


# --- tokens ----------------------------------------------------------------


@query("tokenize_words", with_tokens(" SELECT chapter, word, count(*) AS n FROM raw_token GROUP BY ALL"))
def tokenize_words(spark, d):
    return verbs.count_by(tk.tokenize_words(sections(spark, d), "text"), ["chapter", "word"])


@query(
    "tokenize_ngrams",
    with_bigrams(" SELECT chapter, w1 || ' ' || w2 AS bigram, count(*) AS n FROM raw_bigram GROUP BY ALL"),
)
def tokenize_ngrams(spark, d):
    return verbs.count_by(tk.tokenize_ngrams(sections(spark, d), "text", 2), ["chapter", "bigram"])


@query("ngram_split", with_bigrams(" SELECT w1, w2, count(*) AS n FROM raw_bigram GROUP BY ALL"))
def ngram_split(spark, d):
    grams = tk.tokenize_ngrams(sections(spark, d), "text", 2, keep=[])
    counts = verbs.count_by(grams, ["bigram"])  # no word holds a space, so a bigram stands for its two words
    return tk.split_ngram(counts, "bigram", ["w1", "w2"])


@query("ngram_unite", with_bigrams(" SELECT w2 || '+' || w1 AS swapped, count(*) AS n FROM split_bigram GROUP BY ALL"))
def ngram_unite(spark, d):
    split = tk.split_ngram(bigrams(spark, d), "bigram", ["w1", "w2"]).select("w2", "w1")
    return verbs.count_by(verbs.unite(split, ["w2", "w1"], "swapped", sep="+"), ["swapped"])


@query(
    "strip_possessive",
    with_tokens(" SELECT regexp_replace(word, '’s', '', 'g') AS word, count(*) AS n FROM raw_token GROUP BY ALL"),
)
def strip_possessive(spark, d):
    words = tk.tokenize_words(sections(spark, d), "text", keep=[])
    return verbs.count_by(tk.strip_possessive(words, "word"), ["word"])


@query("clean_tokens", with_tokens(" SELECT volume, book, chapter, word, count(*) AS n FROM token GROUP BY ALL"))
def clean_tokens(spark, d):
    return verbs.count_by(tokens(spark, d), [*KEYS, "word"])


_OWNED_SQL = r"""WITH section AS (SELECT lang AS volume, source AS book, doc_id AS chapter,
  replace(lower(regexp_replace(text, '(er|on) ', '\1’s ', 'g')), '’', chr(39)) AS text FROM documents)"""


def _owned(spark, d):
    """Texts with possessives: words that end in er or on get one."""
    return sections(spark, d).withColumn("text", F.regexp_replace("text", "(er|on) ", "$1’s "))


@query(
    "clean_tokens_normalized",
    _OWNED_SQL + f""", raw AS (SELECT volume, book, chapter, unnest(regexp_extract_all(text, '{WORD_RX}', 1)) AS word FROM section)
SELECT volume, book, chapter, replace(word, chr(39) || 's', '') AS word, count(*) AS n
FROM raw WHERE word NOT IN {in_list(STOP_WORDS)} GROUP BY volume, book, chapter, replace(word, chr(39) || 's', '')""",
)
def clean_tokens_normalized(spark, d):
    """Typographic apostrophes are read as plain ones; possessives still go."""
    words = tk.clean_tokens(_owned(spark, d), "text", STOP_WORDS, KEYS, normalize_apostrophes=True)
    return verbs.count_by(words, [*KEYS, "word"])


@query(
    "clean_bigrams_normalized",
    _OWNED_SQL + f""", list AS (SELECT volume, book, chapter, regexp_extract_all(text, '{WORD_RX}', 1) AS ws FROM section),
raw AS (SELECT volume, book, chapter, ws[i] AS w1, ws[i + 1] AS w2 FROM (SELECT *, unnest(range(1, len(ws))) AS i FROM list WHERE len(ws) >= 2)),
clean AS (SELECT volume, book, chapter, w1 || ' ' || replace(w2, chr(39) || 's', '') AS bigram
  FROM raw WHERE w1 NOT IN {in_list(STOP_WORDS)} AND w2 NOT IN {in_list(STOP_WORDS)})
SELECT volume, book, chapter, bigram, count(*) AS n FROM clean GROUP BY ALL""",
)
def clean_bigrams_normalized(spark, d):
    pairs = tk.clean_bigrams(_owned(spark, d), "text", STOP_WORDS, KEYS, normalize_apostrophes=True)
    return verbs.count_by(pairs, [*KEYS, "bigram"])


@query(
    "clean_bigrams", with_bigrams(" SELECT volume, book, chapter, bigram, count(*) AS n FROM bigram GROUP BY ALL")
)
def clean_bigrams(spark, d):
    return verbs.count_by(bigrams(spark, d), [*KEYS, "bigram"])


@query(
    "label_codes",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' WHEN 'P' THEN 'partial' END
  AS o_orderstatus FROM orders""",
)
def label_codes(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return verbs.label_codes(orders, "o_orderstatus", {"F": "filled", "O": "open", "P": "partial"})


@query("copy_col", "SELECT n_nationkey, n_regionkey, n_nationkey AS ch, 'fixed' AS kind FROM nation")
def copy_col(spark, d):
    return (
        table(spark, d, "nation")
        .select("n_nationkey", "n_regionkey")
        .withColumn("ch", F.col("n_nationkey"))
        .withColumn("kind", F.lit("fixed"))
    )


# --- filters ---------------------------------------------------------------


@query("filter_cmp", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 30 AND l_discount <= 0.05")
def filter_cmp(spark, d):
    items = table(spark, d, "lineitem").where((F.col("l_quantity") > 30) & (F.col("l_discount") <= 0.05))
    return items.select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "filter_not_in",
    with_bigrams(f" SELECT w1, w2, count(*) AS n FROM raw_bigram WHERE w1 NOT IN {in_list(STOP_WORDS)} "
                 f"AND w2 NOT IN {in_list(STOP_WORDS)} GROUP BY ALL"),
)
def filter_not_in(spark, d):
    grams = tk.split_ngram(tk.tokenize_ngrams(sections(spark, d), "text", 2, keep=[]), "bigram", ["w1", "w2"])
    kept = tk.remove_words(tk.remove_words(grams, STOP_WORDS, on="w1"), stop_table(spark), on="w2")
    return verbs.count_by(kept, ["w1", "w2"])


@query(
    "filter_in",
    "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'R')",
)
def filter_in(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return items.where(F.col("l_returnflag").isin("A", "R"))


@query("filter_or", with_bigrams(" SELECT w1, w2, count(*) AS n FROM split_bigram WHERE w1 = 'ther' OR w2 = 'ther' GROUP BY ALL"))
def filter_or(spark, d):
    pairs = tk.split_ngram(bigrams(spark, d), "bigram", ["w1", "w2"])
    return verbs.count_by(pairs.where((F.col("w1") == "ther") | (F.col("w2") == "ther")), ["w1", "w2"])


@query("filter_neq", f"WITH {SECTION_SQL} SELECT volume, book, chapter FROM section WHERE volume <> '{EXCLUDED_VOLUME}'")
def filter_neq(spark, d):
    docs = table(spark, d, "documents").where(F.col("lang") != EXCLUDED_VOLUME)
    return docs.select(F.col("lang").alias("volume"), F.col("source").alias("book"), F.col("doc_id").alias("chapter"))


@query(
    "filter_group_size",
    with_tokens(""" SELECT word, chapter, count(*) AS n FROM token
WHERE word IN (SELECT word FROM token GROUP BY word HAVING count(*) >= 50) GROUP BY ALL"""),
)
def filter_group_size(spark, d):
    kept = verbs.keep_frequent(tokens(spark, d).select("word", "chapter"), "word", 50)
    return verbs.count_by(kept, ["word", "chapter"])


@query("having_count", with_tokens(" SELECT word, count(*) AS n FROM token GROUP BY word HAVING count(*) > 10"))
def having_count(spark, d):
    return verbs.having_count(tokens(spark, d), ["word"], F.col("n") > 10)


@query(
    "filter_regex",
    r"""SELECT doc_id, regexp_matches(text, '[0-9]') AS has_digit, regexp_matches(lower(text), 'th(e|at)\s') AS has_word
FROM documents WHERE regexp_matches(text, '[A-Z][a-z]+')""",
)
def filter_regex(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").rlike("[A-Z][a-z]+"))
    return docs.select(
        "doc_id",
        F.col("text").rlike("[0-9]").alias("has_digit"),
        F.lower("text").rlike(r"th(e|at)\s").alias("has_word"),
    )


# --- joins -----------------------------------------------------------------


@query(
    "join_anti",
    with_tokens(f" SELECT word, count(*) AS n FROM raw_token WHERE word NOT IN {in_list(STOP_WORDS)} GROUP BY ALL"),
)
def join_anti(spark, d):
    words = tk.tokenize_words(sections(spark, d), "text", keep=[])
    return verbs.count_by(tk.remove_words(words, stop_table(spark)), ["word"])


@query(
    "join_lexicon",
    with_lexicon(" SELECT chapter, word, sentiment, count(*) AS n FROM token JOIN lexicon USING (word) GROUP BY ALL"),
)
def join_lexicon(spark, d):
    counts = verbs.count_by(tokens(spark, d), ["chapter", "word"])
    return tk.attach_lexicon(counts, lexicon_of(counts)).select("chapter", "word", "sentiment", "n")


@query(
    "join_renamed",
    with_tokens(" SELECT chapter, word, quality, count(*) AS n FROM token JOIN labels ON chapter = doc_id GROUP BY ALL"),
)
def join_renamed(spark, d):
    counts = verbs.count_by(tokens(spark, d), ["chapter", "word"])
    joined = verbs.renamed_join(counts, table(spark, d, "labels"), {"chapter": "doc_id"})
    return joined.select("chapter", "word", "quality", "n")


@query(
    "join_left_totals",
    with_tokens(""", c AS (SELECT volume, word, count(*) AS n FROM token GROUP BY ALL),
t AS (SELECT volume, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY volume)
SELECT volume, word, n, total FROM c LEFT JOIN t USING (volume)"""),
)
def join_left_totals(spark, d):
    counts = verbs.count_by(tokens(spark, d), ["volume", "word"])
    totals = counts.groupBy("volume").agg(F.sum("n").alias("total"))
    return verbs.natural_join(counts, totals, "left")


@query(
    "join_natural",
    "SELECT a.doc_id, quality, toxic, lang, source FROM labels a JOIN documents b ON a.doc_id = b.doc_id",
)
def join_natural(spark, d):
    return verbs.natural_join(table(spark, d, "labels"), table(spark, d, "documents").drop("text", "n_chars"))


@query(
    "join_semi",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)
def join_semi(spark, d):
    segment = table(spark, d, "customer").where(F.col("c_mktsegment") == "BUILDING")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return verbs.renamed_join(orders, segment.select("c_custkey"), {"o_custkey": "c_custkey"}, "left_semi").select(
        "o_orderkey", "o_custkey"
    )


@query(
    "join_argmax",
    with_tokens(""", c AS (SELECT volume, book, count(*) AS n FROM token GROUP BY ALL),
t AS (SELECT volume, CAST(sum(n) AS BIGINT) AS tot FROM c GROUP BY volume),
m AS (SELECT volume, book, n FROM c QUALIFY rank() OVER (PARTITION BY volume ORDER BY n DESC) = 1)
SELECT volume, tot, book, n FROM t JOIN m USING (volume)"""),
)
def join_argmax(spark, d):
    counts = verbs.count_by(tokens(spark, d), ["volume", "book"])
    totals = counts.groupBy("volume").agg(F.sum("n").alias("tot"))
    return verbs.join_argmax(totals, counts, ["volume"], "n")


# --- scalars ---------------------------------------------------------------


@query(
    "scalar_text",
    """SELECT doc_id, upper(lang) AS up, lower(source) AS low, lang || '/' || source AS path,
  regexp_replace(source, 'src', 'book ') AS named FROM documents""",
)
def scalar_text(spark, d):
    return table(spark, d, "documents").select(
        "doc_id",
        F.upper("lang").alias("up"),
        F.lower("source").alias("low"),
        F.concat_ws("/", "lang", "source").alias("path"),
        F.regexp_replace("source", "src", "book ").alias("named"),
    )


@query(
    "scalar_pct_label",
    """WITH p AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders)
SELECT o_orderkey, regexp_replace(regexp_replace(CAST(CAST(round_even(CAST(v AS DOUBLE) / 4, 1) AS DECIMAL(18,1)) AS VARCHAR),
  '0+$', ''), '\\.$', '') || ' %' AS label FROM p""",
)
def scalar_pct_label(spark, d):
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("double")
    return table(spark, d, "orders").select("o_orderkey", percent_label(price / 4, 1).alias("label"))


@query("scalar_round_even", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) AS half FROM lineitem")
def scalar_round_even(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", round_even(F.col("l_quantity") / 2).alias("half")
    )


@query(
    "scalar_substr",
    "SELECT c_custkey, substr(c_name, 10) AS tail, substr(c_mktsegment, 1, 3) AS head FROM customer",
)
def scalar_substr(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", F.substring("c_name", 10, 1_000_000).alias("tail"), F.substring("c_mktsegment", 1, 3).alias("head")
    )
