"""Personal data: base patterns, and identifiers that the contexts of the base finds reveal (bootstrapping).

All work is in DataFrame functions.  Positions are code points, ends exclusive.

1. Base finds: leftmost, non-overlapping per kind.  A pattern's matches and the pieces between them give the positions by
   a running sum over their lengths; nothing is exploded or shuffled.  The patterns are written without backtracking
   (possessive, each start tried once), which finds the same spans and stays linear on texts of any length.
2. Occurrences: every token with a digit or ``@``, without its surrounding punctuation, of at least ``MIN_LENGTH`` code
   points.  Its context is the two words before it in lower case, among the ``REACH`` code points since the token of that
   kind before it; occurrences where a base find starts are seeds of its kind and carry the find's text.
3. A bipartite graph of contexts (lexical patterns) and values (instances) is scored in rounds.  A context's confidence for
   a kind is the share of all its occurrences in the corpus, whatever word follows, that hold a known value of the kind;
   it counts from ``SUPPORT`` known values and ``CONFIDENCE`` per mille on.  A value's score is the mean confidence over
   its occurrences; from ``CONFIDENCE`` on it is known and a seed of the next round.  Rounds end when nothing is added.
4. All occurrences of found values that touch no base find are added spans.

Null texts count as empty, documents with null or repeated ids each give their row, repeated texts have the same spans.
Other columns of the table are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wordloom.llm.common import pinned

MIN_LENGTH, REACH = 5, 80
SUPPORT, CONFIDENCE = 3, 500
KINDS = ("email", "ip", "card", "phone")

_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_WORTH = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_SPACE = r"\x20\x09-\x0D"
TOKEN = rf"(?<![^{_SPACE}])[^{_SPACE}]*[0-9@][^{_SPACE}]*"
BEFORE, AFTER = "\"'(<[{", ".,;:!?)\"'>]}"


def running(steps: Column) -> Column:
    """Running sums of an array of longs, in square-root sized chunks: an array that grows is copied at each step."""
    none = F.array().cast("array<bigint>")

    def sums(values: Column) -> Column:
        return F.aggregate(values, none, lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + x)))

    wide = F.ceil(F.sqrt(F.size(steps))).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / wide).cast("int")), lambda j: F.slice(steps, j * wide + 1, wide))
    totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x))
    before = F.concat(F.array(F.lit(0).cast("bigint")), sums(totals))
    parts = F.zip_with(F.transform(chunks, sums), F.slice(before, 1, F.size(chunks)), lambda c, b: F.transform(c, lambda x: x + b))
    return F.when(F.size(steps) == 0, none).otherwise(F.flatten(parts))


def _starts(pieces: Column, found: Column) -> Column:
    """Where each match starts, from the pieces between matches (one more) and the matches."""
    gap = F.transform(pieces, lambda p: F.length(p).cast("bigint"))
    size = F.transform(found, lambda m: F.length(m).cast("bigint"))
    steps = F.zip_with(gap, F.concat(F.array(F.lit(0).cast("bigint")), size), lambda g, s: g + s)
    return F.slice(running(steps), 1, F.size(found))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        x = F.substr(d, i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return total + F.when((F.length(d) - i) % 2 == 0, x).otherwise(twice)

    return F.when(F.length(d).between(13, 19), F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return _luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _checked(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda x: _valid(kind, x["value"]))


SPAN = "array<struct<start:bigint,end:bigint,value:string>>"


def base_spans(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with ``pii_text`` and, per kind, an array of ``start, end, value`` in order of their starts."""
    out = docs.withColumn("pii_text", F.coalesce(text.cast("string"), F.lit("")))
    for kind in KINDS:
        worth = F.col("pii_text").rlike(_WORTH[kind])
        found = F.regexp_extract_all("pii_text", F.lit(PATTERNS[kind]), F.lit(0))
        out = out.withColumn(f"{kind}_found", F.when(worth, found).otherwise(F.array().cast("array<string>")))
        some = F.size(f"{kind}_found") > 0
        starts = _starts(F.split("pii_text", PATTERNS[kind], -1), F.col(f"{kind}_found"))
        out = out.withColumn(f"{kind}_start", F.when(some, starts).otherwise(F.array().cast("array<bigint>")))
        spans = F.zip_with(
            f"{kind}_start",
            f"{kind}_found",
            lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("value")),
        )
        out = out.withColumn(kind, _checked(kind, spans).cast(SPAN))
    return out.drop(*(f"{k}_{c}" for k in KINDS for c in ("found", "start")))


def occurrences(base: DataFrame) -> DataFrame:
    """``text_id, start, end, value, context, kind`` of every token that may be an identifier; ``kind`` only for seeds."""
    some = base.where(F.col("pii_text").rlike("[0-9@]")).withColumn("text_id", F.md5("pii_text"))
    some = some.withColumn("tokens", F.regexp_extract_all("pii_text", F.lit(TOKEN), F.lit(0)))
    some = some.withColumn("pieces", F.split("pii_text", TOKEN, -1)).withColumn("at", _starts(F.col("pieces"), F.col("tokens")))
    zipped = F.arrays_zip("at", "tokens", F.slice("pieces", 1, F.size("tokens")).alias("gap"))
    rows = some.select("text_id", *KINDS, F.explode(zipped).alias("o")).select(
        "text_id", *KINDS, F.col("o.at").alias("at"), F.col("o.tokens").alias("token"), F.right(F.col("o.gap"), F.lit(REACH)).alias("gap")
    )
    rows = rows.withColumn("core", F.ltrim("token", F.lit(BEFORE)))
    rows = rows.withColumn("start", F.col("at") + F.length("token") - F.length("core")).withColumn("core", F.rtrim("core", F.lit(AFTER)))
    rows = rows.where(F.length("core") > 0)
    seed = [F.get(F.col(k), F.array_position(F.col(f"{k}.start"), F.col("start")).cast("int") - 1) for k in KINDS]
    kind = F.coalesce(*[F.when(s.isNotNull(), F.lit(i)) for i, s in enumerate(seed)])
    found = F.coalesce(*seed)
    word = rf"[^{_SPACE}]+"
    pair = rf"(?<![^{_SPACE}])({word})[{_SPACE}]+({word})[{_SPACE}]+$"
    low = F.lower("gap")
    context = F.concat_ws(" ", F.regexp_extract(low, pair, 1), F.regexp_extract(low, pair, 2))
    return rows.select(
        "text_id",
        "start",
        F.coalesce(found["end"], F.col("start") + F.length("core")).alias("end"),
        F.lower(F.coalesce(found["value"], F.col("core"))).alias("value"),
        F.when(low.rlike(pair), context).alias("context"),
        kind.alias("kind"),
    ).where(F.col("kind").isNotNull() | (F.length("value") >= MIN_LENGTH))


def context_totals(texts: DataFrame, contexts: DataFrame) -> DataFrame:
    """``context, total``: how often two words in the corpus are those of a context and any token follows.

    All pairs of words are counted by their 64-bit hash, in every task first, before they meet the contexts.
    """
    words = texts.select(F.regexp_extract_all(F.lower("pii_text"), F.lit(rf"[^{_SPACE}]+"), F.lit(0)).alias("w")).where(F.size("w") > 2)
    heads, tails = F.slice("w", 1, F.size("w") - 2), F.slice("w", 2, F.size("w") - 2)
    pairs = words.select(F.explode(F.zip_with(heads, tails, lambda a, b: F.xxhash64(a, b))).alias("pair"))
    counts = pairs.groupBy("pair").agg(F.count("*").alias("total"))
    both = F.split("context", " ")
    keyed = contexts.select("context", F.xxhash64(F.get(both, F.lit(0)), F.get(both, F.lit(1))).alias("pair"))
    return keyed.join(counts, "pair").select("context", "total")


def discovered(edges: DataFrame, totals: DataFrame, support: int = SUPPORT, confidence: int = CONFIDENCE) -> DataFrame:
    """``value, kind`` of seeds and found values: the fixed point of scoring ``edges(context, value, n, kind)``."""
    everywhere = edges.groupBy("value").agg(F.sum("n").alias("all_n"))
    known = pinned(edges.where("kind IS NOT NULL").groupBy("value").agg(F.min("kind").alias("kind")))
    size = known.count()
    while True:
        seen = edges.select("context", "value", "n").join(known, "value")
        score = F.floor(1000 * F.col("hit") / F.greatest("total", "hit")).cast("long")
        trusted = (
            seen.groupBy("context", "kind")
            .agg(F.count("*").alias("values"), F.sum("n").alias("hit"))
            .where(F.col("values") >= support)
            .join(totals, "context")
            .withColumn("score", score)
            .where(F.col("score") >= confidence)
            .groupBy("context")
            .agg(F.max(F.struct("score", (-F.col("kind")).alias("order"))).alias("best"))
            .select("context", "best.score", (-F.col("best.order")).alias("kind"))
        )
        rated = edges.select("context", "value", "n").join(trusted, "context").groupBy("value", "kind").agg(F.sum(F.col("score") * F.col("n")).alias("weight"))
        rated = rated.join(everywhere, "value").where(F.col("weight") >= confidence * F.col("all_n"))
        fresh = rated.join(known, "value", "left_anti").groupBy("value").agg(F.max(F.struct("weight", (-F.col("kind")).alias("order"))).alias("best"))
        known = pinned(known.unionByName(fresh.select("value", (-F.col("best.order")).alias("kind"))))
        grown = known.count()
        if grown == size:
            return known
        size = grown


def personal_data(docs: DataFrame, id: str = "doc_id", text: str = "text", support: int = SUPPORT, confidence: int = CONFIDENCE) -> DataFrame:
    """``doc_id``, per kind the array of base spans, and ``added``: an array of ``kind, start, end`` in that order."""
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("t"))
    base = base_spans(rows, F.col("t"))
    found = pinned(occurrences(base))
    edges = pinned(
        found.where("context IS NOT NULL").groupBy("context", "value").agg(F.count("*").alias("n"), F.min("kind").alias("kind"))
    )
    contexts = pinned(edges.groupBy("context").agg(F.count("*").alias("values")).where(F.col("values") >= support))
    texts = rows.select(F.coalesce(F.col("t").cast("string"), F.lit("")).alias("pii_text"))
    totals = pinned(context_totals(texts, contexts))
    known = discovered(edges.join(contexts, "context", "left_semi"), totals, support, confidence)
    fresh = known.join(edges.where("kind IS NOT NULL").select("value").distinct(), "value", "left_anti")
    spans = found.where("kind IS NULL").select("text_id", "start", "end", "value").distinct().join(fresh, "value")
    spans = spans.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("spans"))
    out = base.withColumn("text_id", F.md5("pii_text")).drop("pii_text", "t").join(pinned(spans), "text_id", "left")
    taken = F.concat(*[F.col(k) for k in KINDS])
    free = F.filter("spans", lambda s: ~F.exists(taken, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return out.select("doc_id", *KINDS, F.coalesce(free, F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")).alias("added"))


def span_digests(found: DataFrame) -> DataFrame:
    """Counts of base spans, the digest of their places, and all spans as ``kind:start:end``."""

    def shown(spans: Column, kind: str) -> Column:
        return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    def whole(i: int, kind: str) -> Column:
        own = F.transform(F.filter("added", lambda s: s["kind"] == i), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        mine = F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        return shown(F.array_sort(F.concat(mine, own)), kind)

    base = F.array_join(F.concat(*[shown(F.col(k), k) for k in KINDS]), ",")
    spans = F.array_join(F.concat(*[whole(i, k) for i, k in enumerate(KINDS)]), ",")
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"), F.size("added").cast("long").alias("n_added"))
