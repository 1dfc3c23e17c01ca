"""The training-data operators against brute force on small tables with nulls, empty and long texts, ties and repeats."""

import collections
import itertools
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, t string, cluster string, cut_id0 long"
R = random.Random(5)
VOCABULARY = ["".join(R.choice("abcdefgh") for _ in range(R.randint(1, 8))) for _ in range(400)]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def shingles(words):
    return [tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))] if words else []


def sentence(n):
    return " ".join(R.choice(VOCABULARY) for _ in range(n))


def edited(text, n):
    words = text.split(" ")
    for _ in range(n):
        words[R.randrange(len(words))] = "édit" + R.choice(VOCABULARY)
    return " ".join(words)


PASSAGE = sentence(70)
ITEMS = [(0, sentence(30)), (1, sentence(14)), (2, None), (3, ""), (4, sentence(3))]


def corpus():
    texts = [None, "", "  \n\t ", "one two", "One TWO", "one two three four five", "É é “x”…  end ", " lead", "<|endoftext|> a"]
    base = [sentence(R.randint(40, 200)) for _ in range(6)]
    texts += base + [b.upper() for b in base[:2]] + [edited(b, k) for b in base for k in (1, 2, 4, 9)]
    texts += [f"{sentence(60)} {PASSAGE} {sentence(k)}" for k in (5, 40, 90)]
    texts += [f"{sentence(50)} {ITEMS[0][1]} {sentence(20)}", f"{sentence(50)} {edited(ITEMS[0][1], 1)}", f"{sentence(9)} {ITEMS[1][1]}"]
    texts += ["word " * 3000, sentence(6000)]
    ids = list(range(len(texts)))
    R.shuffle(ids)
    rows = [(i, x, "en", "s", len(x or ""), "t", "c", 1) for i, x in zip(ids, texts)]
    return rows + [rows[12], (None, "no id " + base[0], None, None, None, None, None, None)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def linked(rows):
    sets = {i: frozenset(shingles(words_of(x))) for i, x, *_ in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}, sets


def test_jaccard_join(docs, none):
    from wordloom.llm.ngram_join import jaccard_links, ngram_jaccard_join, one_per_group

    expected, sets = linked(ROWS)
    got = [tuple(r) for r in ngram_jaccard_join(docs).collect()]
    assert sorted(got) == sorted((i, n, c) for i, (n, c) in expected.items())
    assert ngram_jaccard_join(none).count() == 0
    kept = one_per_group(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {None} | {i for i, (_, c) in expected.items() if i == c}
    heads = {min(j for j in sets if sets[j] == s) for s in sets.values() if s}
    pairs = {(a, b) for a, b in itertools.combinations(sorted(heads), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert {tuple(r) for r in jaccard_links(docs, all_pairs=True).collect()} == pairs
    small = ngram_jaccard_join.__globals__["jaccard_links"](docs, chunk=3)  # many chunks: minor components meet all others
    from wordloom.llm.common import components

    component = {r.node: r.component for r in components(small).collect()}
    assert all(component.get(i, i) == expected[i][1] for i in heads)


def test_signature_tree_keeps_all_similar_pairs():
    from wordloom.llm.ngram_join import SignatureTree, candidate_pairs, similar

    rng = np.random.default_rng(1)
    sets = []
    for _ in range(60):
        base = np.unique(rng.integers(0, 2**63, rng.integers(1, 300), dtype=np.uint64))
        sets += [base, base[: max(1, int(len(base) * 0.8))], np.unique(np.append(base[1:], rng.integers(0, 2**63, 9, dtype=np.uint64)))]
    tree = SignatureTree(sets)
    a, b = candidate_pairs(tree, tree, 75, True)
    found = set(zip(a.tolist(), b.tolist()))
    wanted = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if similar(tree.sets[i], tree.sets[j], 75)}
    assert wanted <= found and len(found) < 2000


def test_encoder_and_shards():
    from wordloom.llm.encode import Encoder, tokenizer_path
    from wordloom.llm.token_files import pack_shard, read_shard

    bits = ["a", "the", " ", "  ", "\n", "\t", "É", "’", "'s", "12", "…", "<|endoftext|>", "Σ", "日本", "😀", "\r\n", " ", "'"]
    texts = ["", " ", "a ", " a"] + ["".join(R.choice(bits) for _ in range(R.randint(0, 25))) for _ in range(3000)]
    for name, lead in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        coder = Encoder(tokenizer_path(name), lead, limit=300)
        for k in range(0, len(texts), 200):
            part = texts[k : k + 200]
            for one, other in zip(coder.encode(part), coder.whole(part)):
                assert np.array_equal(one, other)
    rng = np.random.default_rng(0)
    for n, high in itertools.product((0, 1, 128, 129, 5000), (1, 300, 50_000, 2**32 - 1)):
        ids = np.where(rng.random(n) < 0.95, rng.integers(0, high // 16 + 1, n), rng.integers(0, high, n)).astype(np.uint32)
        payload = pack_shard(np.array([5, 9]), np.array([n, 0]), ids)
        own, lengths, back = read_shard(payload)
        assert own.tolist() == [5, 9] and lengths.tolist() == [n, 0] and np.array_equal(back, ids)
        assert np.array_equal(read_shard(payload, 1, 3)[2], ids[128:384])


def test_encoder_looks_each_word_up_once():
    from wordloom.llm.encode import Encoder, tokenizer_path

    class Known(dict):
        asked = 0

        def get(self, *key):
            Known.asked += 1
            return super().get(*key)

        def __getitem__(self, key):
            Known.asked += 1
            return super().__getitem__(key)

        def setdefault(self, *key):
            Known.asked += 1
            return super().setdefault(*key)

    texts = ["one two… two", "three one ", "four four five six… four"]
    for name, lead in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        coder = Encoder(tokenizer_path(name), lead)
        coder.at, Known.asked = Known(), 0
        for part in (texts, texts[::-1]):
            assert all(np.array_equal(*x) for x in zip(coder.encode(part), coder.whole(part), strict=True))
        assert Known.asked <= 2 * sum(len(t.split(" ")) for t in texts)
        assert list(coder.at.values()) == list(range(len(coder.size)))
        # A call that fails leaves no word without ids.
        learn, coder._learn = coder._learn, lambda words: 1 / 0
        with pytest.raises(ZeroDivisionError):
            coder.encode(["seven one"])
        coder._learn = learn
        assert all(np.array_equal(*x) for x in zip(coder.encode(["seven one"]), coder.whole(["seven one"]), strict=True))


def test_encoder_sends_new_words_in_short_strings():
    from wordloom.llm.encode import Encoder, tokenizer_path

    texts = [" ".join(f"w{k}x{j}" for j in range(700)) for k in range(3)]
    for name, lead in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        coder, sent = Encoder(tokenizer_path(name), lead), []
        whole = coder.whole
        coder.whole = lambda parts, sent=sent, whole=whole: sent.extend(parts) or whole(parts)
        got = coder.encode(texts)
        assert len(sent) > 3 and max(len(p.split()) for p in sent) <= 202  # words and marks
        assert all(np.array_equal(*x) for x in zip(got, whole(texts), strict=True))


def encoded(name, end):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(P.path(name))
    return {i: np.array(coder.encode(x or "", add_special_tokens=False).ids + [end], "<u4") for i, x, *_ in ROWS}


def test_token_files(docs, none):
    from wordloom.llm.token_files import token_index, write_token_files

    path = P.path("byte_bpe_50k.json")
    got = sorted((tuple(r) for r in token_index(write_token_files(docs, path)).collect()), key=lambda r: r[1])
    ids, at = encoded("byte_bpe_50k.json", 0), 0
    assert len(got) == len(ROWS)
    for (doc, start, n, crc), wanted in zip(got, sorted(i if i is not None else -(2**63) for i, *_ in ROWS)):
        own = ids[None if wanted == -(2**63) else wanted]
        assert (doc, start, n, crc) == (wanted, at, len(own), zlib.crc32(own.tobytes()))
        at += n
    assert token_index(write_token_files(none, path)).count() == 0


def test_packing(docs, none):
    from wordloom.llm.packing import hilbert_key, pack_documents, sequences

    grid = np.array(list(itertools.product(range(8), repeat=3)))
    key = hilbert_key(grid, 3)
    assert sorted(key) == list(range(512)) and (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()
    path, ids = P.path("word_bpe_49k.json"), encoded("word_bpe_49k.json", 1)
    frame = pack_documents(docs, path, with_ids=True)
    pieces = frame.collect()
    runs = collections.defaultdict(list)
    for p in pieces:
        own = ids[p.doc_id]
        assert p.doc_tokens == len(own) and p.ids_crc32 == zlib.crc32(own[p.start : p.start + p.length].tobytes())
        runs[p.sequence_id].append((p.offset, p.length))
    assert sum(p.length for p in pieces) == sum(len(ids[i]) for i, *_ in ROWS)
    for number, run in runs.items():
        ends = list(itertools.accumulate((n for _, n in sorted(run)), initial=0))
        assert [o for o, _ in sorted(run)] == ends[:-1] and (ends[-1] == 2048 or number == max(runs))
    assert {len(r.ids) for r in sequences(frame).collect()} == {4 * 2048}
    assert pack_documents(none, path).count() == 0


def test_token_counts(docs, none):
    from tokenizers import Tokenizer, models, pre_tokenizers

    from wordloom.llm.token_counts import PieceCounter, token_counts, unigram_vocabulary

    path = P.path("piece_bpe_32k.model")
    vocabulary = unigram_vocabulary(path)
    exact = Tokenizer(models.Unigram(vocabulary, 0, True))
    exact.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    count = lambda x: len(exact.encode(x, add_special_tokens=False).ids)
    got = collections.Counter(tuple(r) for r in token_counts(docs, path).collect())
    assert got == collections.Counter((i, count(x or "")) for i, x, *_ in ROWS)
    assert token_counts(none, path).count() == 0
    tied = [("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("ba", -2.0), ("aba", -3.0)]
    small = Tokenizer(models.Unigram([("<unk>", 0.0), *tied], 0, False))
    small.pre_tokenizer = exact.pre_tokenizer
    counter = PieceCounter([("<unk>", 0.0), *tied])
    for n in range(1, 8):
        for letters in itertools.product("ab", repeat=n):
            word = "".join(letters)
            assert counter.word("▁" + word) == len(small.encode(word, add_special_tokens=False).ids)


def test_shards(docs, none):
    import hashlib

    from wordloom.llm.sharding import assign_shards

    limit = 3000
    got = assign_shards(docs, limit).collect()
    code = {i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16) for i, *_ in ROWS}
    size = [(code[i], len((x or "").encode())) for i, x, *_ in ROWS]
    assert len(got) == len(ROWS)
    for r in got:
        h = code[r.doc_id]
        for depth in range(61):
            own = [(g, b) for g, b in size if g >> (60 - depth) == h >> (60 - depth)]
            if sum(b for _, b in own) <= limit or len({g for g, _ in own}) == 1:
                break
        assert (r.shard_depth, r.shard_prefix, r.shard_docs) == (depth, h >> (60 - depth), len(own))
        assert r.shard_bytes == sum(b for _, b in own)
    assert assign_shards(none, limit).count() == 0


def test_top_k(spark):
    from wordloom.llm.topk import top_k

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=12).astype(float).tolist()) for i in range(300)]
    rows += [(300, rows[0][1]), (301, None), (302, [1.0, None] + [0.0] * 10), (303, [float("nan")] * 12), (304, [1.0] * 5), (305, [2.0] * 5), (306, []), (None, [1.0] * 12)]
    rows += [(307, [1e12] * 12), (308, [0.0] * 12), rows[7]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int".replace(", label int", "")).repartition(4)
    got = collections.defaultdict(list)
    for r in top_k(table, table.where("vec_id % 10 = 0 OR vec_id >= 304"), 5).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    use = {i: [int(np.floor(256 * v)) for v in x] for i, x in rows if i is not None and x and None not in x and np.isfinite(x).all()}
    for q in [i for i in use if i % 10 == 0 or i >= 304]:
        cut = lambda s: max(-(2**63), min(2**63 - 1, s))
        best = sorted((-sum(a * b for a, b in zip(use[q], use[i])), i) for i in use if i != q and len(use[i]) == len(use[q]))[:5]
        assert sorted(got[q]) == [(k + 1, i, cut(-s)) for k, (s, i) in enumerate(best)], q
    assert top_k(table.where("vec_id < 0"), table.where("vec_id < 0")).count() == 0


def test_decontamination(spark, docs, none):
    from wordloom.llm.decontaminate import contaminated, decontaminate

    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    expected = set()
    for (i, x, *_), (item, y) in itertools.product(ROWS, ITEMS):
        own, other = shingles(words_of(x)), shingles(words_of(y))
        bag, m = collections.Counter(other), len(other)
        for a in range(max(1, len(own) - m + 1)) if own and m else ():
            window = collections.Counter(own[a : a + m])
            low = sum((window & bag).values())
            if 100 * low >= 75 * (window.total() + m - low):
                expected.add((i, item))
                break
    assert len(expected) >= 2
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, benchmark).collect()} == expected
    clean = decontaminate(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == sum(i not in {e[0] for e in expected} for i, *_ in ROWS)
    assert contaminated(none, benchmark).count() == 0 and contaminated(docs, benchmark.where("item_id < 0")).count() == 0


def test_compact_windows():
    from wordloom.llm.passages import compact_windows

    rng = np.random.default_rng(2)
    for n in (0, 3, 30, 60):
        v = rng.integers(0, 40, n, dtype=np.uint64)
        windows = compact_windows(v, 6)[:, 1:].tolist()
        for i in range(n):
            for j in range(i + 5, n):
                c = i + int(v[i : j + 1].argmin())
                assert (v[c], 1) == (v[c], sum(a <= i <= m <= j <= b and v[m] == v[c] for a, m, b in windows))


def test_compact_windows_of_many_texts():
    from wordloom.llm.passages import compact_windows

    def nodes(v, width):
        out, todo = [], [(0, len(v))]
        while todo:
            a, b = todo.pop()
            if b - a >= width:
                c = a + int(v[a:b].argmin())
                out.append((a, c, b - 1))
                todo += [(a, c), (c + 1, b)]
        return out

    rng = np.random.default_rng(12)
    for values in (3, 50, 10**9):
        sizes = rng.integers(0, 90, 60)
        off = np.concatenate([[0], np.cumsum(sizes)])
        v = rng.integers(0, values, off[-1], dtype=np.uint64)
        want = sorted((k, *node) for k in range(60) for node in nodes(v[off[k] : off[k + 1]], 7))
        assert sorted(map(tuple, compact_windows(v, 7, off).tolist())) == want


def test_passages(docs, none):
    from wordloom.llm.passages import repeated_passages, without_repeats

    spans = repeated_passages(docs)
    found = collections.defaultdict(list)
    for r in spans.collect():
        assert r.doc_id > r.source_doc_id and r.end_word - r.start_word >= 50 and r.similarity >= 0.75
        found[r.doc_id].append((r.start_word, r.end_word))
    first, exact = {}, collections.defaultdict(list)
    for i, x, *_ in sorted((r for r in ROWS if r[0] is not None), key=lambda r: r[0]):
        w = words_of(x)
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) != i:
                exact[i].append(k)
    for i, starts in exact.items():
        for k in starts:
            assert any(a <= k and k + 50 <= b for a, b in found[i]), (i, k)
    cut = without_repeats(docs, spans)
    assert cut.columns == docs.columns and cut.count() == len(ROWS)
    texts = {r.doc_id: r.text for r in cut.collect()}
    for i, x, *_ in ROWS:
        if i not in found:
            assert texts[i] == x
    left = [t for t in texts.values() if t and PASSAGE in t]
    assert len(left) == 1
    assert repeated_passages(none).count() == 0


def test_passages_of_a_text_that_repeats_itself(spark):
    """A phrase said over and over is one stretch, not one for each time that it comes round."""
    from wordloom.llm.passages import repeated_passages, without_repeats

    r = random.Random(12)
    text = lambda n: [f"{r.choice(VOCABULARY)}{r.randrange(10**6)}" for _ in range(n)]
    for phrase in (["is", "onhe."], ["a", "b", "c", "d", "e", "f", "g"]):
        rows = [(k, [*text(30), *(phrase * 300)[k : k + n], *text(30)]) for k, n in ((0, 400), (1, 400), (2, 300), (3, 500))]
        frame = spark.createDataFrame([(k, " ".join(t)) for k, t in rows], "doc_id long, text string")
        spans = repeated_passages(frame)
        found = spans.collect()
        assert sorted((s.doc_id, s.start_word, s.end_word) for s in found) == [(1, 30, 430), (2, 30, 330), (3, 30, 530)]
        words = dict(rows)
        for s in found:
            own, other = (" ".join(words[i][a:b]) for i, a, b in ((s.doc_id, s.start_word, s.end_word), (s.source_doc_id, s.source_start, s.source_end)))
            assert s.similarity == 1.0 and set(shingles(own)) == set(shingles(other))
        left = {d.doc_id: d.text for d in without_repeats(frame, spans).collect()}
        assert all(left[k].split() == t[:30] + t[-30:] for k, t in rows[1:]) and left[0].split() == words[0]


def test_passages_after_a_partial_copy(spark):
    """A run of 50 words is found though an even earlier document holds only its first 45 words."""
    from wordloom.llm.passages import repeated_passages

    rows, r = [], random.Random(11)
    text = lambda n: [f"{r.choice(VOCABULARY)}{r.randrange(10**6)}" for _ in range(n)]
    for k in range(60):
        run = text(50)
        for n, head in enumerate((run[:45], run, run)):
            rows.append((3 * k + n, " ".join(text(30) + head + text(30))))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {(s.doc_id, s.start_word, s.end_word, s.source_doc_id, s.source_start, s.source_end) for s in repeated_passages(frame).collect()}
    assert {(3 * k + 2, 30, 80, 3 * k + 1, 30, 80) for k in range(60)} <= found


def jaccard_of(a, b):
    x, y = set(shingles(a)), set(shingles(b))
    return len(x & y) / len(x | y)


def test_passages_in_large_groups(spark):
    """an edited passage is found among more documents with the same windows than meet at once."""
    from wordloom.llm.passages import GROUP, repeated_passages

    rng = random.Random(5)

    def own(n):
        return [f"w{rng.randrange(10**9)}" for _ in range(n)]

    rows, planted = [], {}
    for case in range(12):
        passage, base = own(60), 1000 * case
        for k in range(2 * GROUP):  # halves that are too short for a passage
            half = passage[:40] if k % 2 else passage[20:]
            rows.append((base + k, " ".join(own(30) + half + own(30))))
        rows.append((base + 500, " ".join(own(30) + passage + own(30))))
        rows.append((base + 501, " ".join(own(30) + [*passage[:30], "edited", *passage[31:]] + own(30))))
        planted[base + 501] = base + 500
    found = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {s.doc_id: s.source_doc_id for s in found} == planted
    assert all(s.end_word - s.start_word >= 50 and s.similarity >= 0.75 for s in found)


def test_shared_stretches_hold_all_chains():
    from wordloom.llm.passages import GAP, shared_stretches

    hit = np.zeros(400, bool)
    hit[20:40], hit[40 + GAP : 60 + GAP] = True, True  # one chain of 40 in the first text
    hit[200:233] = True  # too few
    hit[250:284] = True  # 34, widened to both sides
    assert shared_stretches(hit, np.array([0, 150, 400]), 34, 12, 46).tolist() == [[0, 8, 72 + GAP], [1, 88, 146]]
    assert not len(shared_stretches(hit[200:233], np.array([0, 33]), 34, 12, 46))


@pytest.mark.parametrize(
    "words,edits,partial,part",
    [(60, 1, 0, 0), (80, 2, 0, 0), (120, 3, 0, 0), (80, 2, 1, 40), (80, 2, 2, 40), (80, 2, 8, 30), (80, 2, 4, 40), (50, "ends", 0, 0), (50, "ends", 4, 25)],
)
def test_edited_passages(spark, words, edits, partial, part):
    """Passages of similarity 0.76 and more are found whatever parts of them earlier documents hold."""
    from wordloom.llm.passages import repeated_passages

    r, rows, want = random.Random(f"{words} {edits} {partial}"), [], []
    fresh = lambda n: [f"v{r.randrange(20000)}" for _ in range(n)]
    while len(want) < 60:
        run = fresh(words)
        copy = list(run)
        for at in (0, words - 1) if edits == "ends" else r.sample(range(words), edits):
            copy[at] = "changed"
        if jaccard_of(run, copy) < 0.76:
            continue
        for _ in range(partial):
            at = r.randrange(words - part + 1)
            rows.append((len(rows), " ".join(fresh(40) + run[at : at + part] + fresh(40))))
        for body in (run, copy):
            rows.append((len(rows), " ".join(fresh(40) + body + fresh(40))))
        want.append(len(rows) - 1)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spans = collections.defaultdict(list)
    for s in repeated_passages(frame).collect():
        spans[s.doc_id].append(s)
    hit = 0
    for doc in want:
        covered = {k for s in spans[doc] for k in range(s.start_word, s.end_word)}
        hit += len(covered & set(range(40, 40 + words))) >= 0.9 * words
    print(f"{words} words, {edits} edits, {partial} parts of {part}: {hit} of {len(want)}")
    assert hit >= 0.9 * len(want)


PAGE = (
    '<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>'
    '<div class="ad">Buy {n}</div><{tag}><h1>Title&nbsp;{n}</h1><p><b>First &amp; best{n}<br>next<p>Second   par\nagraph'
    '<form>your name</form><aside>side</aside></p><ul><li>one<li>two</ul><div class="comments"><p>Bad!</p></div></{tag}>'
    "<footer>&copy; us</footer>"
)


@pytest.mark.parametrize("tag", ["article", 'div id="story"'])
def test_html(spark, tag):
    from wordloom.llm.html_text import main_texts

    rows = [(n, f"https://www.a.org/{n}", PAGE.replace("{tag}", tag, 1).replace("{tag}", tag.split()[0]).replace("{n}", str(n))) for n in range(5)]
    rows += [(5, None, None), (6, "x", ""), (7, "https://b.org/", "plain &lt;text"), rows[0], (None, "https://a.org/q", "<p>a<!-- x <p>b")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = collections.Counter((r.page_id, r.text, r.n_chars) for r in main_texts(frame).collect())
    body = "\n\n".join(["Title {n}", "First & best{n} next", "Second par agraph", "one", "two"])
    texts = [body.replace("{n}", str(n)) for n in range(5)] + ["", "", "plain <text", body.replace("{n}", "0"), "a"]
    assert got == collections.Counter((r[0], t, len(t)) for r, t in zip(rows, texts))
    assert main_texts(frame.where("page_id < 0")).count() == 0


def test_quality(spark, none):
    from wordloom.llm.quality import CHUNK, chunk_starts, fit_quality, keep_good, quality_scores, score_bytes

    for n in (0, 1, CHUNK, CHUNK + 1, 5000):
        starts = chunk_starts(n)
        assert set(range(n)) <= {b for s in starts for b in range(s, s + CHUNK)} and starts[-1] in (0, n - CHUNK)
    good = [(i, sentence(R.randint(3, 120)), 1) for i in range(240)]
    bad = [(i, "!! ".join(sentence(R.randint(3, 120)).upper().split(" ")), 0) for i in range(240, 480)]
    docs = spark.createDataFrame([(i, x) for i, x, _ in good + bad] + [(900, None), (901, ""), (None, "x"), (902, "a" * 300_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in good + bad] + [(950, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = fit_quality(docs, labels)
    got = {r.doc_id: r for r in quality_scores(docs, model).collect()}
    assert len(got) == 484 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(got[i], q) for i, _, q in good + bad if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out for r, _ in held) and np.mean([r.predicted == q for r, q in held]) > 0.95
    assert sum(r.held_out for i, r in got.items() if i is not None and i < 480) == len(held)
    for i, x, _ in (good + bad)[::50]:
        assert abs(score_bytes(model, [np.frombuffer(x.encode(), np.uint8)])[0] - got[i].score) < 1e-5
    assert {r.doc_id for r in keep_good(docs, model).collect()} == {i for i, r in got.items() if r.score >= 0.3}
    assert quality_scores(none, model).count() == 0
    untrained = fit_quality(docs, labels.where("quality = 1"))
    assert {r.predicted for r in quality_scores(docs, untrained).collect()} == {1}


def test_quality_sample(spark):
    """Conflicting labels and repeated rows: one text per id, whatever the number of its copies."""
    from wordloom.llm import quality

    docs = [(i, sentence(20) if i % 2 else sentence(20).upper()) for i in range(200)]
    labels = [(i, i % 2, 0) for i in range(200)] + [(i, 1 - i % 2, 0) for i in range(0, 200, 10)]
    seen = []

    def train(texts, target):
        seen.append((len(texts), int(target.sum())))
        return quality.initial()

    original, quality.train = quality.train, train
    try:
        frame = spark.createDataFrame(docs * 5, "doc_id long, text string")
        quality.fit_quality(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), per_class=30)
    finally:
        quality.train = original
    assert seen == [(60, 30)]


def test_features_against_a_plain_convolution():
    from wordloom.llm import quality

    model = quality.initial()
    rng = np.random.default_rng(2)
    model["bias"] = rng.normal(size=quality.FILTERS).astype(np.float32)
    chunks = rng.integers(0, 256, (3, quality.CHUNK))
    got = quality.pooled(model, chunks.astype(np.uint8))
    for chunk, features in zip(chunks, got):
        for f in range(quality.FILTERS):
            best = max(
                sum(float(model["embed"][chunk[at + j], e] * model["conv"][j * quality.EMBED + e, f]) for j in range(quality.WIDTH) for e in range(quality.EMBED))
                for at in range(0, quality.CHUNK - quality.WIDTH + 1, quality.HOP)
            )
            assert features[f] == pytest.approx(max(best + model["bias"][f], 0), abs=1e-4)


def test_write_shards(spark, tmp_path):
    from wordloom.llm.sharding import assign_shards, write_shards

    rows = [(i, "x" * (i % 50), i) for i in range(300)] + [(5, "again", 1), (None, "no id", 2), (7, None, 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, shard_depth int")
    write_shards(frame, 1000, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(repr, (tuple(r) for r in back.select(frame.columns).collect()))) == sorted(map(repr, rows))
    sizes = back.groupBy("shard").agg({"text": "count"}).count()
    assert sizes > 3
    with pytest.raises(ValueError, match="shard"):
        write_shards(frame.withColumnRenamed("shard_depth", "shard"), 1000, str(tmp_path / "other"))
    with pytest.raises(ValueError):
        assign_shards(frame, 0)


def test_stages_on_empty_and_odd_tables(spark, tmp_path):
    import corpus_pipeline

    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], schema)
    twice = sentence(80)
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "", "", 0), (3, twice, "en", "a", 1), (4, twice, "en", "a", 1), (None, "x", None, None, 1)], schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == empty.columns), name
        kept = {r.doc_id for r in stage(spark, odd, str(tmp_path)).collect()}
        assert kept >= {1, 2, 3, None} and (4 in kept) == (name not in ("near_duplicates", "passages")), name
    assert corpus_pipeline.passages_stage(spark, odd.drop("n_chars"), str(tmp_path)).columns == ["doc_id", "text", "lang", "source"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables not found")
def test_queries_and_pipeline(spark):
    import __spark_entry__ as entry
    from check import compare, connect

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    known, oracles = entry.queries(), entry.oracle_sql()
    assert {re.match(r"op\d+", n)[0] for n in known if n.startswith("op")} == {f"op{n}" for n in range(1, 11)}
    con = connect(sf)
    for name in ("op5_extendible_shards", "op7_top_k"):
        assert compare(known[name](spark, sf), con, oracles[name]).startswith("ok")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    expected, _ = linked([(r.doc_id, r.text) for r in docs.collect()])
    kept = stage["near_duplicates"](spark, docs, sf)
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in expected.items() if i == c}
    for name in ("passages", "decontamination"):
        assert stage[name](spark, docs, sf).schema == docs.schema
    assert known["pipeline"](spark, sf).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@pytest.mark.parametrize(
    "page,want",
    [
        ('<body><article style="overflow:hidden"><p>Text {n}</p></article>', "Text {n}"),
        ('<body class="no-sidebar"><article><p>Text {n}</p></article></body>', "Text {n}"),
        ('<body><div class="layout with-sidebar"><article><p>Text {n}</p></article><div class="sidebar">side {n}</div></div>', "Text {n}"),
        ('<body><article class="post tag-search category-social"><p>Text {n}</p><p id="share-of-wallet">Share {n}</p></article>', "Text {n}\n\nShare {n}"),
        ('<body><article><svg class="x"/><p>Text {n}</p><svg><title>no</title></svg>end {n}</article>', "Text {n}\n\nend {n}"),
        ('<body><article><template-card>Text {n}</template-card><title-x>T{n}</title-x></article>', "Text {n}T{n}"),
        ('<body><div class="search">All of the long text of page {n} stands here</div><p>x{n}</p></body>', "All of the long text of page {n} stands here\n\nx{n}"),
        ('<body><article><p hidden>no {n}</p><p data-x="hidden">yes {n}</p><div class="cookie-note">no</div></article>', "yes {n}"),
        ('<body><div class=c><h1>Title {n}</h1><div class=t><p>Long text {n} and more</p></div></div></body>', "Title {n}\n\nLong text {n} and more"),
        ('<body><div class=a><p>{n} first sixty per cent of it all</p></div><div class=b><p>{n} and the rest</p></div></body>', "{n} first sixty per cent of it all\n\n{n} and the rest"),
        ('<body><article><p>Text of page number {n} which is long enough to matter here</p><p>Read more on our site</p></article>', "Text of page number {n} which is long enough to matter here"),
        ('<body><div class=top><ul><li><a href=x>Home</a><li><a href=y>News {n}</a></ul></div><div class=t><p>Text {n} is here and long</p></div>', "Text {n} is here and long"),
    ],
)
def test_html_layouts(spark, page, want):
    """Ten pages of a host, a menu and a footer around each layout."""
    from wordloom.llm.html_text import main_texts

    made = page.replace("</body>", "") + "<footer>us {n}</footer></body>"
    rows = [(n, f"https://a.org/{n}", made.replace("{n}", str(n)), "x") for n in range(10)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, template string").repartition(2)
    assert {r.page_id: r.text for r in main_texts(frame).collect()} == {n: want.replace("{n}", str(n)) for n in range(10)}


def test_html_of_random_templates(spark):
    """Hosts with and without article, one to three containers, menus and repeated text, against the planted article."""
    from wordloom.llm.html_text import main_texts

    r, rows, want = random.Random(21), [], {}
    for host in range(12):
        name = r.choice(["article", "main", "div"])
        boxes = [f'<{name if name == "div" else "section"} class="{r.choice("pqrstu")}{b}">' for b in range(r.randint(1, 3))]
        menu = "".join(f'<li><a href="/{k}">{sentence(1)}</a>' for k in range(5))
        repeated = sentence(6)
        for n in range(r.randint(8, 15)):
            parts = [[f"{sentence(r.randint(20, 40))} {n}" for _ in range(r.randint(1, 4))] for _ in boxes]
            inner = "".join(box + "".join(f"<p>{x}</p>" for x in part) + "</" + box[1:].split(" ")[0] + ">" for box, part in zip(boxes, parts))
            end = f"<p>{repeated}</p>"
            core = f"<{name}>{inner}{end}</{name}>"
            html = f"<html><body><div class=m><ul>{menu}</ul></div><header>{sentence(3)}</header>{core}<div class=site-footer>{sentence(5)}</div></body></html>"
            want[len(rows)] = "\n\n".join(x for part in parts for x in part)
            rows.append((len(rows), f"http://h{host}.org/{n}", html))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {x.page_id: x.text for x in main_texts(frame).collect()}
    assert got == want


def test_html_without_article_uses_the_template():
    from wordloom.llm.html_text import Page, deduce

    import pandas as pd

    tokens = Page(PAGE.replace("{tag}", "div", 1).replace("{tag}", "div")).tokens
    rows = [(t, 4, 4, "1", 50 if t.endswith("/div") else 1, 0, k) for k, t in enumerate(dict.fromkeys(tokens))]
    found = deduce(pd.DataFrame(rows, columns=["token", "pages", "times", "vector", "chars", "link_chars", "place"]))
    assert found["slot"] == "/html/body/div"


def test_arrow_slices():
    from wordloom.llm.common import text_slices

    column = pa.array(["abc", None, "", "é" * 700_000, "z"])
    back = [bytes(data[o[k] : o[k + 1]]).decode() for a, b, data, o in text_slices(column.slice(1)) for k in range(b - a)]
    assert back == ["", "", "é" * 700_000, "z"]
