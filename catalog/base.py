"""The test tables seen as volumes, books and chapters, and the stand-in lexicons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wordloom.operators.tokens import clean_bigrams, clean_tokens, gather_texts
from wordloom.operators.verbs import count_by
from wordloom.session import checkpoint
from wordloom.sources.text import read_table

KEYS = ["volume", "book", "chapter"]

# Stand-ins for the inputs a user brings.
STOP_WORDS = (
    "a an and are as at au auf be by das de del den der des die du el en er es et for from für "
    "in is ist it la las le les los mit nd of on ou par por pour que qui re se sich st sur that "
    "the this to un und une von was with zu"
).split()
SENTIMENTS = "anger anticipation disgust fear joy negative positive sadness surprise trust".split()
ENTITIES = "ther thth thon".split()
CHARACTERS = (
    "erin than thble thea thed ther thes thha thhe thin thly thnt thon thor thre thth thti"
).split()
VOLUMES = ["de", "en", "es", "fr"]
EXCLUDED_VOLUME = "es"

WORD_RX = r"([\p{L}\p{M}\p{N}_]+(?:[’''.][\p{L}\p{M}\p{N}_]+)*)"


def in_list(items) -> str:
    return "(" + ", ".join(f"'{i}'" for i in items) + ")"


def sql_array(items) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


# --- Spark side ------------------------------------------------------------


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _sections(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("lang").alias("volume"), F.col("source").alias("book"), F.col("doc_id").alias("chapter"), "text"
    )


def sections(spark: SparkSession, d: str) -> DataFrame:
    return _sections(read_table(spark, f"{d}/documents.parquet"))


def stop_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{w}')" for w in STOP_WORDS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(word)")


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return clean_tokens(sections(spark, d), "text", STOP_WORDS, KEYS)


def chapter_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens whose chapters lie in one partition each: counting by chapter moves the texts only."""
    docs = table(spark, d, "documents")
    placed = gather_texts(docs.select("lang", "source", "doc_id", "text"), "doc_id")
    return clean_tokens(_sections(placed), "text", STOP_WORDS, KEYS)


def counted_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens counted by chapter and word, stored: the lexicon and the counts read the texts once."""
    return checkpoint(count_by(chapter_tokens(spark, d), [*KEYS, "word"]))


def bigrams(spark: SparkSession, d: str) -> DataFrame:
    return clean_bigrams(sections(spark, d), "text", STOP_WORDS, KEYS)


def lexicon_of(words: DataFrame) -> DataFrame:
    """A many-to-many lexicon over the distinct words of a table.

    The first hex digit of a word's md5 picks one of ten labels or none; words
    whose second digit is 0 or 1 get another label from the third digit.
    """
    labels = F.array(*[F.lit(s) for s in SENTIMENTS])
    digest = F.md5("word")

    def label(i: int):
        return F.get(labels, F.instr(F.lit("0123456789"), F.substring(digest, i, 1)) - 1)

    second = F.when(F.substring(digest, 2, 1).isin("0", "1"), label(3))
    both = F.array_distinct(F.array_compact(F.array(label(1), second)))
    return words.select("word").distinct().select("word", F.explode(both).alias("sentiment"))


# --- SQL side --------------------------------------------------------------

SECTION_SQL = """section AS (
  SELECT lang AS volume, source AS book, doc_id AS chapter, text FROM documents)"""

TOKEN_SQL = (
    SECTION_SQL
    + f""", raw_token AS (
  SELECT volume, book, chapter, unnest(regexp_extract_all(lower(text), '{WORD_RX}', 1)) AS word FROM section),
token AS (
  SELECT volume, book, chapter, regexp_replace(word, '’s', '', 'g') AS word
  FROM raw_token WHERE word NOT IN {in_list(STOP_WORDS)})"""
)

LEXICON_SQL = (
    TOKEN_SQL
    + f""", word_digest AS (SELECT word, md5(word) AS h FROM (SELECT DISTINCT word FROM token)),
lexicon AS (
  SELECT DISTINCT word, sentiment FROM (
    SELECT word, {sql_array(SENTIMENTS)}[strpos('0123456789', substr(h, 1, 1))] AS sentiment FROM word_digest
    UNION ALL
    SELECT word, {sql_array(SENTIMENTS)}[strpos('0123456789', substr(h, 3, 1))] FROM word_digest
    WHERE substr(h, 2, 1) IN ('0', '1'))
  WHERE sentiment IS NOT NULL)"""
)

BIGRAM_SQL = (
    SECTION_SQL
    + f""", word_list AS (
  SELECT volume, book, chapter, regexp_extract_all(lower(text), '{WORD_RX}', 1) AS ws FROM section),
raw_bigram AS (
  SELECT volume, book, chapter, ws[i] AS w1, ws[i + 1] AS w2
  FROM (SELECT *, unnest(range(1, len(ws))) AS i FROM word_list WHERE len(ws) >= 2)),
split_bigram AS (
  SELECT volume, book, chapter, w1, regexp_replace(w2, '’s', '', 'g') AS w2
  FROM raw_bigram WHERE w1 NOT IN {in_list(STOP_WORDS)} AND w2 NOT IN {in_list(STOP_WORDS)}),
bigram AS (SELECT volume, book, chapter, w1 || ' ' || w2 AS bigram FROM split_bigram)"""
)


def with_tokens(sql: str) -> str:
    return f"WITH {TOKEN_SQL}{sql}"


def with_lexicon(sql: str) -> str:
    return f"WITH {LEXICON_SQL}{sql}"


def with_bigrams(sql: str) -> str:
    return f"WITH {BIGRAM_SQL}{sql}"


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})
