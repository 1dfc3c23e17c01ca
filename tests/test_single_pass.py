"""Counts that move texts instead of words, and steps that read their input once."""

import numpy as np
from pyspark.sql import functions as F

from wordloom.operators import sentiment as sn, tokens as tk, topics
from wordloom.operators.tfidf import bind_tf_idf
from wordloom.operators.verbs import count_by, tally


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_gathered_texts_are_counted_without_another_shuffle(spark):
    docs = spark.createDataFrame([(1, "a b a"), (1, "b"), (None, "c ’s c’s"), (None, "c"), (2, None)], "k int, t string")
    counts = count_by(tk.clean_tokens(tk.gather_texts(docs, "k"), "t", ["x"], ["k"]), ["k", "word"])
    assert exchanges(counts) == 1
    got = sorted((str(r["k"]), r["word"], r["n"]) for r in counts.collect())
    assert got == [("1", "a", 2), ("1", "b", 2), ("None", "c", 3), ("None", "s", 1)]


def test_counted_tokens_go_to_the_lexicon_as_they_are(spark):
    toks = spark.createDataFrame([(1, "a")] * 3 + [(1, "b"), (2, "a"), (None, "a"), (2, None)], "k int, word string")
    lex = spark.createDataFrame([("a", "joy"), ("a", "fear"), ("b", "joy")], "word string, sentiment string")
    counted = count_by(toks, ["k", "word"])
    want = sorted(map(str, sn.sentiment_counts(toks, lex, ["k"]).collect()))
    got = sn.sentiment_counts(tally(counted, ["k", "word"]), lex, ["k"])
    assert sorted(map(str, got.collect())) == want and "Row(k=1, sentiment='joy', n=4)" in want
    stored = spark.createDataFrame(counted.collect(), counted.schema)
    assert exchanges(sn.sentiment_counts(stored, lex, ["k"])) < exchanges(sn.sentiment_counts(toks, lex, ["k"]))


def test_only_listed_and_lexicon_words_are_paired(spark, monkeypatch):
    rows = [(1, "x"), (1, "a"), (1, "a"), (1, "dull"), (2, "x"), (2, "a"), (2, "y"), (None, "a"), (2, None)]
    toks = spark.createDataFrame(rows, "ch int, word string")
    lex = spark.createDataFrame([("a", "joy"), ("a", "fear"), ("x", "joy")], "word string, sentiment string")
    paired, original = [], sn.pairwise_count

    def watched(df, *args, **kwargs):
        paired.extend(r["word"] for r in df.collect())
        return original(df, *args, **kwargs)

    monkeypatch.setattr(sn, "pairwise_count", watched)
    got = {tuple(r) for r in sn.pair_sentiment(toks, lex, "word", "ch", items=["x", "y"]).select("item1", "item2", "n", "sentiment").collect()}
    assert got == {("x", "a", 2, "joy"), ("x", "a", 2, "fear"), ("y", "a", 1, "joy"), ("y", "a", 1, "fear"), ("y", "x", 1, "joy")}
    assert set(paired) == {"a", "x", "y"}


def test_tf_idf_reads_its_counts_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(n):
        read.add(1)
        return n

    counts = spark.createDataFrame([("d", "a", 1), ("d", "b", 3), ("e", "a", 2), (None, "a", 1)], "doc string, word string, n long")
    counted = counts.withColumn("n", F.udf(seen, "long")("n"))
    rows = {(r["doc"], r["word"]): r["tf_idf"] for r in bind_tf_idf(counted, "word", "doc", "n").collect()}
    assert read.value == 4
    assert np.isclose(rows["d", "b"], 0.75 * np.log(2)) and np.isclose(rows[None, "a"], np.log(2 / 3))


def test_inner_products_of_topics_come_from_the_model():
    weights = np.array([[1.0, 3.0], [1.0, 1.0], [2.0, 0.0]])

    class Model:
        def topicsMatrix(self):
            return self

        def toArray(self):
            return weights

    shares = weights / weights.sum(0)
    want = [[sum(shares[:, i] * shares[:, j]) for j in range(2)] for i in range(2)]
    assert np.allclose(topics._gram(Model()), want)
