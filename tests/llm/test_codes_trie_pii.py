"""Personal data, vector codes and the prefix trie against direct computation."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm.pii import KINDS, PATTERNS, personal_data, span_digests
from wordloom.llm.prefix_trie import prefix_trie
from wordloom.llm.vector_codes import nearest, short_lists, vector_codes, with_label_error

R = random.Random(11)
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


# --- personal data -------------------------------------------------------------


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_of(text):
    return [(k, m.start(), m.end()) for k in KINDS for m in re.finditer(PLAIN[k], text) if valid(k, m.group())]


def bootstrapped(texts):
    """All spans of each text, by plain loops over the definition."""
    found = []
    for n, text in enumerate(texts):
        base, last = base_of(text), 0
        for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
            if not re.search("[0-9@]", m.group()):
                continue
            gap, last = text[last : m.start()][-80:].lower(), m.end()
            core = m.group().lstrip("\"'(<[{")
            start = m.end() - len(core)
            core = core.rstrip(".,;:!?)\"'>]}")
            if not core:
                continue
            own = [b for b in base if b[1] == start]
            kind = KINDS.index(own[0][0]) if own else None
            value, end = (text[own[0][1] : own[0][2]], own[0][2]) if own else (core, start + len(core))
            before = re.search(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+$", gap)
            if own or len(value) >= 5:
                found.append((n, start, end, value.lower(), " ".join(before.groups()) if before else None, kind))
    totals = {}
    for text in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
        for a, b, _ in zip(w, w[1:], w[2:]):
            totals[f"{a} {b}"] = totals.get(f"{a} {b}", 0) + 1
    edges, seed = {}, {}
    for *_, value, context, kind in found:
        if context:
            edges[context, value] = edges.get((context, value), 0) + 1
            if kind is not None:
                seed[value] = min(kind, seed.get(value, 9))
    known = dict(seed)
    while True:
        trusted = {}
        for c in {c for c, _ in edges}:
            for k in range(4):
                own = [(v, n) for (d, v), n in edges.items() if d == c and known.get(v) == k]
                hit = sum(n for _, n in own)
                if len(own) >= 3 and (score := 1000 * hit // max(hit, totals.get(c, 0))) >= 500 and score > trusted.get(c, (0, 0))[0]:
                    trusted[c] = (score, k)
        fresh = {}
        for value in {v for _, v in edges} - set(known):
            n = sum(m for (_, v), m in edges.items() if v == value)
            weight = {}
            for (c, v), m in edges.items():
                if v == value and c in trusted:
                    weight[trusted[c][1]] = weight.get(trusted[c][1], 0) + trusted[c][0] * m
            good = [(w, -k) for k, w in weight.items() if w >= 500 * n]
            if good:
                fresh[value] = -max(good)[1]
        if not fresh:
            break
        known |= fresh
    out = []
    for n, text in enumerate(texts):
        base = base_of(text)
        more = {(KINDS[known[v]], s, e) for m, s, e, v, _, kind in found if m == n and kind is None and v in known and v not in seed}
        more = [x for x in more if not any(b[1] < x[2] and x[1] < b[2] for b in base)]
        out.append((base, sorted(base + more, key=lambda x: (KINDS.index(x[0]), *x[1:]))))
    return out


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


WORDS = [f"w{''.join(R.choice('abcdef') for _ in range(4))}" for _ in range(60)]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


CARD = "4111 1111 1111 1111"
TEXTS = [
    None,
    "",
    " \n ",
    "é😀 mail a.b@c.de, x@y and p@q.r_s@t.u end",
    f"{CARD} 4111-1111-1111-1112 1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.0004 +1 (555) 010-0000 +12 34",
    "1 2 3 4 5 " * 4000,
    "a." * 20000 + "@x.y",
    "x@y.z " * 3000,
    "+1 ( ( ( ( 5 +12345678) 9 a1a1a1",
    "4111111111111111" * 3,
]
for i in range(30):
    TEXTS.append(f"{prose(9)} write to: user{i}@mail.example {prose(12)}")
TEXTS += [f"{prose(4)} write to: jane{i}[at]mail {prose(3)} write to: jane{i}[at]mail. {prose(3)} reach me jane{i}[at]mail {prose(2)}" for i in range(4)]
TEXTS += [f"{prose(4)} reach me kim{i}/at/post2 {prose(3)}" for i in range(3)]  # known only after the round before
TEXTS += [f"{prose(4)} card number 411111111111111{i} {prose(4)}" for i in range(10)]
TEXTS += [f"order number 77777{i} of {prose(3)}" for i in range(8)]
TEXTS += [TEXTS[12]] * 3


def test_personal_data(spark):
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], "x", 1, "y"), (3, TEXTS[3], "x", 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii_text string, email long, text_id string").repartition(3)
    got = span_digests(personal_data(docs)).collect()
    texts = [t or "" for _, t, *_ in rows]
    want = sorted(
        (
            (-1 if i is None else i, *[sum(b[0] == k for b in base) for k in KINDS], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base))
            for (i, *_), (base, spans) in zip(rows, bootstrapped(texts), strict=True)
        ),
    )
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert by[40].n_added == 3 and by[44].n_added == 1 and all(by[i].n_added == 0 for i in (*range(10, 40), *range(47, 68)))
    none = spark.createDataFrame([], "doc_id long, text string")
    assert span_digests(personal_data(none)).collect() == []


def test_patterns_without_backtracking(spark):
    pieces = ["a", "b.", "@", "@c.d", "1", "2.", "255", ".", " ", "-", "+", "+1", "(", ")", "_", "%", "é", "\n", "4111111111111111"]
    texts = ["".join(R.choice(pieces) for _ in range(R.randint(1, 60))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    for kind in KINDS:
        got = df.selectExpr("i", f"regexp_extract_all(t, r'{PATTERNS[kind]}', 0) AS m").collect()
        for r in got:
            assert r.m == [m.group() for m in re.finditer(PLAIN[kind], texts[r.i])], texts[r.i]


def test_no_python_in_personal_data(spark):
    docs = spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string")
    plan = span_digests(personal_data(docs))._jdf.queryExecution().toString()
    assert not re.search("Python|InPandas|InArrow", plan)


# --- vector codes --------------------------------------------------------------


def coded(rows, parts, entries, rounds):
    kept = [(i, l, np.array([int(np.floor(256 * c)) for c in v])) for i, v, l in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    first = sorted(((i, tuple(x)) for i, _, x in kept if i is not None))[:entries]
    books = [[np.array(x)[p] for _, x in first] for p in np.split(np.arange(len(kept[0][2])), parts)]
    cut = np.split(np.arange(len(kept[0][2])), parts)

    def assign(x, book):
        d = [int(((x - e) ** 2).sum()) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p, book in zip(cut, books):
            mine = [assign(x[p], book)[0] for *_, x in kept]
            books[[b is book for b in books].index(True)] = [
                np.array([int(sum(int(x[p][j]) for m, (*_, x) in zip(mine, kept) if m == e)) // mine.count(e) for j in range(len(p))]) if e in mine else c
                for e, c in enumerate(book)
            ]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    out = []
    for i, label, x in kept:
        hits = [assign(x[p], b) for p, b in zip(cut, books)]
        out.append((i, label, "".join(f"{c:02x}" for c, _ in hits), sum(d for _, d in hits)))
    total = {}
    for _, label, _, e in out:
        total[label] = total.get(label, 0) + e
    return sorted((str(i), c, e, total[l], digest) for i, l, c, e in out)


def test_vector_codes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 8).round(3).tolist(), int(rng.integers(0, 3))) for i in range(120)]
    rows += [(i, rows[5][1], None) for i in range(200, 400)]  # a third of all rows are one vector
    rows += [(7, rows[9][1], 1), (None, rows[2][1], None), (500, None, 1), (501, [None] * 8, 1), (502, [float("nan")] + [0.0] * 7, 2), (503, [float("inf")] * 8, 2)]
    rows += [(600 + i, [0.0] * 8, 2) for i in range(5)]
    R.shuffle(rows)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    table = table.selectExpr("*", "1 AS row", "'c' AS code", "2 AS part")
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], l) for i, v, l in rows]
    for entries in (4, 200):
        got = with_label_error(vector_codes(table, parts=4, entries=entries)).collect()
        assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == coded(rows, 4, entries, 2)
    assert with_label_error(vector_codes(table.limit(0), parts=4)).collect() == []
    with pytest.raises(ValueError):
        vector_codes(table, parts=3)


def test_codes_stand_in_part_order(spark):
    from wordloom.llm.vector_codes import _codes, _first_entries, kept_vectors, part_blocks

    table = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0, -1.0 * i], 0) for i in range(600)], "vec_id long, embedding array<double>, label int")
    kept = kept_vectors(table, "vec_id", "embedding", "label")
    blocks = part_blocks(kept, 4, 4, -256 * 599, 512 * 599)
    books = _first_entries(kept, 4, 8)
    found = {}
    for turn in ("part", "-part", "(part + 2) % 4"):  # the order in which blocks arrive
        rows = kept.join(_codes(blocks.repartition(1).sortWithinPartitions(F.expr(turn)), books, 1), "row").collect()
        found[turn] = {r["vec_id"]: r["code"] for r in rows}
    assert found["part"] == found["-part"] == found["(part + 2) % 4"]
    assert found["-part"][5] == "05050005" and found["-part"][599] == "07070007"


def test_short_lists_keep_every_nearest_entry():
    rng = np.random.default_rng(4)
    for _ in range(50):
        x, book = rng.integers(-9, 9, (40, 3)), rng.integers(-9, 9, (12, 3))
        short = np.flatnonzero(short_lists(x.min(0)[None], x.max(0)[None], book)[0])
        assert all((a == b).all() for a, b in zip(nearest(x, book, short), nearest(x, book, np.arange(12)), strict=True))


# --- prefix trie -----------------------------------------------------------------


def trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, tie, role, text))
    turns = {c: [t[3:] for t in sorted(x)] for c, x in convs.items()}
    made = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(turns.get(c - c % 20, [])[:h] + turns[c][h:])
    members = {}
    for c, s in made.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    out = []
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)]
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c in sorted(own) if made[c] == path)
        children = sum(len(q) == len(path) + 1 and q[: len(path)] == path for q in members)
        parent = min(members[path[:-1]]) if path else None
        out.append((min(own), len(path), parent, len(own), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("many", [10_000, 2])
def test_prefix_trie(spark, monkeypatch, many):
    from wordloom.llm import prefix_trie as module

    monkeypatch.setattr(module, "MANY_CHILDREN", many)
    monkeypatch.setattr(module, "IDS", 7)
    rows = []
    for c in range(160):
        n = 1 if c >= 120 else R.randint(1, 5)  # short ones may lose every turn to an absent family head
        if c % 20 == 0 and c % 40:
            continue
        for t in range(n):
            rows.append((c, t, R.choice(["user", "bot"]), R.choice(["hi there", "a b c", "x"]) if t < 2 else R.choice(["yes", "no no", ""])))
    rows += [(c, t, "user", "all the same") for c in range(1000, 1100) for t in range(3)]
    rows += [(5, None, None, None), (6, 1, "user", "tie"), (6, 1, "user", "also"), (None, 1, "user", "lost"), (7, 0, "bot", "w " * 5000)]
    rows += [(9000, t, "bot", f"turn {t}") for t in range(300)]
    R.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    table = table.selectExpr("*", "1 AS node", "'d' AS digest", "conv_id AS conv")
    assert sorted((tuple(r) for r in prefix_trie(table).collect()), key=str) == trie(rows)
    if many > 2:
        assert prefix_trie(table.limit(0)).collect() == []
