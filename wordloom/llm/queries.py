"""One query per operator, each over its whole table, and the SQL that checks it where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.llm.ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


@query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.llm.encode import tokenizer_path
    from wordloom.llm.token_files import token_index, write_token_files

    return token_index(write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.llm.encode import tokenizer_path
    from wordloom.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


SHARD_BYTES = 1 << 20


@query
def op5_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.llm.sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


ORACLES["op5_extendible_shards"] = f"""
WITH doc AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS bytes,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h FROM documents),
level AS (SELECT unnest(range(0, 61)) AS depth),
node AS (
  SELECT depth, h >> (60 - depth) AS prefix, sum(bytes) AS shard_bytes, count(*) AS shard_docs, min(h) = max(h) AS alone
  FROM doc, level GROUP BY ALL),
pick AS (
  SELECT doc_id, bytes, h, min(depth) AS depth FROM doc JOIN node ON prefix = h >> (60 - depth)
  WHERE shard_bytes <= {SHARD_BYTES} OR alone GROUP BY ALL)
SELECT doc_id, bytes, CAST(depth AS INTEGER) AS shard_depth, prefix AS shard_prefix,
       CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_docs
FROM pick JOIN node USING (depth) WHERE prefix = h >> (60 - depth)
"""


@query
def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.llm.topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


ORACLES["op7_top_k"] = """
WITH vec AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
  SELECT q.vec_id AS query_id, x.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM vec q JOIN vec x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM pair QUALIFY rank <= 5
"""


@query
def op8_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.llm.encode import tokenizer_path
    from wordloom.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.llm.html_text import main_texts

    return main_texts(table(spark, sf_dir, "pages"))


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.llm.quality import fit_quality, quality_scores

    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


@query
def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.llm.passages import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


@query
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.llm.pii import personal_data, span_digests

    return span_digests(personal_data(table(spark, sf_dir, "documents")))


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.llm.vector_codes import vector_codes, with_label_error

    coded = with_label_error(vector_codes(table(spark, sf_dir, "embeddings")))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _vector_code_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Two rounds of assigning and replacing, written out; vectors with repeated ids are told apart by a row number."""

    def best(k: int) -> str:
        return f"""dist{k} AS (
  SELECT p.r, p.part, b.entry, CAST(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
  FROM piece p JOIN book{k} b USING (part)),
near{k} AS (
  SELECT r, part, CAST(min(d * 1000 + entry) % 1000 AS INTEGER) AS entry, min(d) AS d FROM dist{k} GROUP BY r, part)"""

    def replaced(k: int) -> str:
        return f"""mean{k} AS (
  SELECT part, entry, list(m ORDER BY i) AS x FROM (
    SELECT part, entry, i, CAST(floor(sum(v) / count(*)) AS BIGINT) AS m FROM (
      SELECT n.part, n.entry, unnest(p.x) AS v, unnest(range(len(p.x))) AS i FROM near{k} n JOIN piece p USING (r, part))
    GROUP BY part, entry, i) GROUP BY part, entry),
book{k + 1} AS (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN mean{k} m USING (part, entry))"""

    steps = ",\n".join(f"{best(k)},\n{replaced(k)}" for k in range(rounds))
    return f"""
WITH vec AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id, x) - 1 AS r FROM vec),
piece AS (
  SELECT r, CAST(part AS INTEGER) AS part, x[part * len(x) // {parts} + 1 : (part + 1) * len(x) // {parts}] AS x
  FROM numbered, (SELECT unnest(range({parts})) AS part)),
book0 AS (SELECT part, CAST(r AS INTEGER) AS entry, x FROM piece WHERE r < {entries}),
{steps},
{best(rounds)},
code AS (
  SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY r),
digest AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds})
SELECT n.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY n.label) AS BIGINT) AS label_error, codebooks_sha256
FROM numbered n JOIN code c USING (r), digest
"""


ORACLES["op12_vector_codes"] = _vector_code_sql()


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.llm.prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


ORACLES["op13_prefix_trie"] = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS i FROM said),
conv AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         (4294967295 - list_reduce(
           list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1))))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM said)),
turns AS (
  SELECT c.conv_id, o.i, o.role, o.text FROM conv c JOIN own o ON o.conv_id = c.base AND o.i <= c.h
  UNION ALL
  SELECT c.conv_id, o.i, o.role, o.text FROM conv c JOIN own o ON o.conv_id = c.conv_id AND o.i > c.h),
seq AS (
  SELECT c.conv_id, coalesce(list({'r': t.role, 't': t.text} ORDER BY t.i) FILTER (t.i IS NOT NULL), []) AS s
  FROM conv c LEFT JOIN turns t USING (conv_id) GROUP BY c.conv_id),
step AS (SELECT conv_id, s, unnest(range(len(s) + 1)) AS depth FROM seq),
member AS (SELECT conv_id, depth, depth = len(s) AS ends, s[1:depth] AS path FROM step),
node AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
         CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(path[depth].t, '[^\x20\x09-\x0D]+')) END AS saved
  FROM member GROUP BY path, depth),
child AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
full_node AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM node n LEFT JOIN child c USING (path)),
up AS (SELECT path, n_children, saved, unnest(range(depth + 1)) AS k FROM full_node),
below AS (
  SELECT path[1:k] AS path, CAST(count(*) FILTER (n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM up GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM full_node n JOIN below b USING (path) LEFT JOIN node p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]
"""
