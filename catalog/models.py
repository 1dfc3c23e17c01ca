"""Fitted models: topics, k-means, Ward trees, components.  No SQL gives their numbers; ``tests`` check them against
direct computation on small inputs, and ``catalog.invariants`` checks what must hold of them with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.base import chapter_tokens, rounded, sections, table
from catalog.matrix import embedding_cells, embedding_labels, profiles
from wordloom.operators import cluster, dtm as dt, indices, matrix as mx, topics
from wordloom.plans import clusters as cplans, topics as tplans
from wordloom.session import checkpoint


def _dtm(spark, d):
    return dt.dtm(chapter_tokens(spark, d), "chapter", "word")


def _pruned(spark, d):
    """The pruned matrix, and the documents (some lose all their terms)."""
    matrix = checkpoint(_dtm(spark, d))
    return dt.prune_sparse(matrix, 0.825), matrix.select("document").distinct()


def _kmeans(spark, d):
    pruned, documents = _pruned(spark, d)
    return cluster.kmeans(pruned, k=7, rows=documents)


def _fit(spark, d):
    return topics.fit_topics(_dtm(spark, d), k=8, seed=234)


@query("lda_gamma")
def lda_gamma(spark, d):
    return _fit(spark, d).gamma


@query("lda_beta")
def lda_beta(spark, d):
    return _fit(spark, d).beta


@query("lda_tune")
def lda_tune(spark, d):
    return topics.tune_topics(_dtm(spark, d), ks=(5, 6, 7, 8, 9, 10))


@query("q_doc_top_topic_fitted")
def q_doc_top_topic_fitted(spark, d):
    return tplans.doc_top_topic(_fit(spark, d).gamma)


@query("q_topic_summary_fitted")
def q_topic_summary_fitted(spark, d):
    return tplans.topic_summary(_fit(spark, d).gamma, sections(spark, d))


@query("kmeans_assign")
def kmeans_assign(spark, d):
    return _kmeans(spark, d)[0]


@query("kmeans_centers")
def kmeans_centers(spark, d):
    return _kmeans(spark, d)[1]


@query("q_cluster_sizes_fitted")
def q_cluster_sizes_fitted(spark, d):
    return cplans.cluster_sizes(_kmeans(spark, d)[0])


@query("q_cluster_top_tfidf_fitted")
def q_cluster_top_tfidf_fitted(spark, d):
    labels, _ = _kmeans(spark, d)
    return cplans.cluster_top_tfidf(chapter_tokens(spark, d), labels)


@query("hclust_ward")
def hclust_ward(spark, d):
    return cluster.hclust_ward(embedding_cells(spark, d), "item", "col", "x")[0]


@query("hclust_ward_entities")
def hclust_ward_entities(spark, d):
    return cluster.hclust_ward(profiles(spark, d), "item1", "item2", "n")[0]


@query("cutree")
def cutree(spark, d):
    return cluster.cutree(*cluster.hclust_ward(embedding_cells(spark, d), "item", "col", "x"), 4)


@query("q_cluster_words_fitted")
def q_cluster_words_fitted(spark, d):
    from catalog.base import CHARACTERS

    prof = profiles(spark, d)
    labels = cluster.cutree(*cluster.hclust_ward(prof, "item1", "item2", "n"), 4)
    return rounded(cplans.cluster_words(prof, labels, CHARACTERS), "tot")


@query("pca_scores")
def pca_scores(spark, d):
    prof = profiles(spark, d)
    total = prof.groupBy("item2").agg(F.sum("n").alias("tot")).where(F.col("tot") > 500)
    return mx.pca(prof.join(total, "item2", "left_semi"), "item2", "item1", "n", k=2)[0]


@query("mds_coords")
def mds_coords(spark, d):
    return mx.mds(_dtm(spark, d), "document", "term", "n", k=2)


@query("cluster_discriminant")
def cluster_discriminant(spark, d):
    coords = mx.mds(embedding_cells(spark, d), "item", "col", "x", k=2)
    wide = coords.groupBy("item").pivot("dim", [1, 2]).agg(F.first("coord")).toDF("item", "x", "y")
    return mx.discriminant(wide, embedding_labels(spark, d), "item", "x", "y", "cluster")


@query("index_determinant")
def index_determinant(spark, d):
    return indices.cluster_index(embedding_cells(spark, d), embedding_labels(spark, d), "determinant")


@query("index_split")
def index_split(spark, d):
    return indices.cluster_index(embedding_cells(spark, d), embedding_labels(spark, d), "split")


@query("kmeans_select_k")
def kmeans_select_k(spark, d):
    pruned, documents = _pruned(spark, d)
    return indices.select_k(
        pruned, (3, 4, 5, 6, 7, 8), "kmeans", "all", row="document", col="term", value="n", rows=documents
    )


@query("ward_select_k")
def ward_select_k(spark, d):
    return indices.select_k(
        profiles(spark, d), range(2, 9), "ward", ["silhouette", "dunn"], row="item1", col="item2", value="n"
    )
