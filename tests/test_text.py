"""Hand-made cases for structuring and tokens."""

from pyspark.sql import functions as F

from wordloom.functions.text import ngrams_of, number_from_word, percent_label, spell_number, words_of
from wordloom.operators import structure, tokens as tk
from wordloom.sources import text as src


def words(spark, text, **kw):
    return spark.createDataFrame([(text,)], "t string").select(words_of("t", **kw)).first()[0]


def test_tokens(spark):
    text = "“It’s the _well-known_ prince’s house—1812.”"
    assert words(spark, text) == ["it’s", "the", "_well", "known_", "prince’s", "house", "1812"]


def test_possessive_after_stop_words(spark):
    rows = spark.createDataFrame([(1, "it’s prince’s don’t it")], "k int, t string")
    out = tk.clean_tokens(rows, "t", ["it's", "it", "don't"], ["k"])
    assert sorted(r["word"] for r in out.collect()) == ["don’t", "it", "prince"]
    out = tk.clean_tokens(rows, "t", ["it's", "it", "don't"], ["k"], normalize_apostrophes=True)
    assert [r["word"] for r in out.collect()] == ["prince's"]


def test_short_text_has_no_bigram(spark):
    rows = spark.createDataFrame([(1, "alone"), (2, "two words here"), (3, "")], "k int, t string")
    got = {(r["k"], r["bigram"]) for r in tk.tokenize_ngrams(rows, "t").collect()}
    assert got == {(2, "two words"), (2, "words here")}
    assert [r["g"] for r in tk.tokenize_ngrams(rows, "t", 3, out="g").collect()] == ["two words here"]


def test_line_filters(spark):
    lines = ["", "in the year 1805 it began", "NAPOLEON said", "plain prose"]
    rows = spark.createDataFrame([(1, x) for x in lines] + [(None, "no key")], "k int, t string")
    assert [r["t"] for r in structure.keep_prose(rows, "t", ["k"]).collect()] == ["plain prose"]


def test_sections(spark):
    lines = [
        "Chapter contents",
        "BOOK ONE: 1805",
        "CHAPTER I",
        "first line",
        "second line",
        "the next chapter of his life",
        "after it",
        "BOOK FOUR: 1806",
        "CHAPTER II",
        "fourth book",
        "FIRST EPILOGUE: 1813 - 20",
        "CHAPTER I",
        "the end",
    ]
    rows = spark.createDataFrame(list(enumerate(lines)), "line_no int, text string")
    got = structure.structure_sections(rows, "text", "line_no", offset=-1)
    found = {(r["volume"], r["book"], r["chapter"]): r["text"] for r in got.collect()}
    assert found == {
        (1, 1, 1): "first line second line",
        (1, 1, 2): "the next chapter of his life after it",
        (2, 4, 3): "fourth book",
        (5, 16, 4): "the end",
    }


def test_number_words(spark):
    assert spell_number(17) == "seventeen" and spell_number(42) == "forty-two"
    rows = spark.createDataFrame([("ONE",), ("seventeen",), ("EIGHTEEN",), (None,)], "w string")
    assert [r[0] for r in rows.select(number_from_word("w")).collect()] == [1, 17, None, None]


def test_bigrams_are_made_without_slices_and_split_once_counted(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(1, "a b a b"), (2, "a b"), (3, "b"), (4, None), (5, ""), (6, "A  b, a"), (1, "a b a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["ngram_split"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == [("a", "b", 6), ("b", "a", 3)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and plan.startswith("Aggregate [bigram")


def test_ngrams_of_any_length(spark):
    lists = [["a", "b", "c"], ["a", "b"], ["a"], [], None, ["a", None, "c"]]
    df = spark.createDataFrame([(x,) for x in lists], "w array<string>")
    for n in (1, 2, 3, 4):
        want = [[" ".join(w for w in x[k : k + n] if w is not None) for k in range(len(x) - n + 1)] for x in (x or [] for x in lists)]
        assert [r[0] for r in df.select(ngrams_of(F.col("w"), n)).collect()] == want


def test_percent_labels(spark):
    rows = spark.createDataFrame([(2.5, 12.25), (3.5, 7.0), (100.0, 99.95)], "a double, b double")
    got = rows.select(percent_label("a", 0), percent_label("b", 1)).collect()
    assert [tuple(r) for r in got] == [("2 %", "12.2 %"), ("4 %", "7 %"), ("100 %", "100 %")]


def test_bucket_null_falls_through(spark):
    rows = spark.createDataFrame([(1,), (4,), (16,), (None,)], "b int")
    got = structure.bucket(rows, "b", (4, 9, 12, 16), (1, 2, 3, 4, 5), "v").collect()
    assert [r["v"] for r in got] == [1, 2, 5, 5]


def test_document_files(spark, tmp_path):
    (tmp_path / "book_2_chapter_11.txt").write_text("one\ntwo", encoding="utf-8")
    (tmp_path / "book_10_chapter_3.txt").write_text("océane’s", encoding="utf-8")
    (tmp_path / "empty.txt").write_text("\n", encoding="utf-8")
    got = src.read_documents(spark, f"{tmp_path}/*.txt").select("book", "chapter", "text").collect()
    assert {tuple(r) for r in got} == {(2, 11, "one\ntwo"), (10, 3, "océane’s"), (None, None, "\n")}
    lines = src.to_lines(spark.createDataFrame([(1, "a\nb\n")], "k int, text string"), "k").collect()
    assert [(r["line_no"], r["text"]) for r in lines] == [(0, "a"), (1, "b"), (2, "")]


def test_text_sink_and_snapshot(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "x y"), (1, 2, "z")], "book int, chapter int, text string")
    src.write_text_by_key(rows, ["book", "chapter"], "text", f"{tmp_path}/out")
    back = spark.read.text(f"{tmp_path}/out").select("book", "chapter", "value").collect()
    assert {tuple(r) for r in back} == {(1, 1, "x y"), (1, 2, "z")}
    src.save_tables({"rows": rows}, f"{tmp_path}/snap")
    assert src.load_tables(spark, f"{tmp_path}/snap", ["rows"])["rows"].count() == 2
