"""Queries: documents, chunks, TF-IDF, retrieval, attribution, serving text."""

from __future__ import annotations

from pyspark.sql import functions as F

from slipway.operators import explain as ex
from slipway.operators import rollup as ru
from slipway.operators import text as tx
from slipway.operators.order_features import trailing_window
from slipway.plans.q_core import formula_score
from slipway.plans.queries import dom, register, report
from slipway.plans.stored import CORE, stored_features
from slipway.session import cut_lineage

# Fixed linear "model" for the SQL-checkable attribution path (the fitted
# path takes its coefficients from a trained logistic regression instead).
LINEAR_COEFS = {"promised_days": -0.05, "handover_share": 0.8, "zip_gap": 0.00001, "n_items": 0.1,
                "freight_ratio": 2.0, "purchase_hour": 0.01}


def _docs(d):
    return d.t("documents").select("doc_id", "text")


@register("t01_chunk_documents")
def t01(spark, sf):
    return report(tx.chunks(_docs(dom(spark, sf)), "doc_id"))


@register("t01_chunk_conversations")
def t01c(spark, sf):
    c = dom(spark, sf).t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), "text")
    return report(tx.chunks(c, "msg_id", size=300, overlap=50))


@register("t03_review_documents")
def t03(spark, sf):
    d = dom(spark, sf)
    return report(tx.review_documents(d.reviews, d.order_items, d.sellers, 2000))


@register("t05_tfidf_documents")
def t05(spark, sf):
    return report(tx.tfidf_long(_docs(dom(spark, sf)), "doc_id"))


@register("t05_tfidf_vocabulary")
def t05v(spark, sf):
    d = _docs(dom(spark, sf))
    tc = tx.term_counts(d, "doc_id")
    return report(tx.fit_vocabulary(tc, "doc_id", d.count()))


def _hits(d):
    emb = d.t("embeddings")
    q = tx.label_centroids(emb)
    return tx.top_k_nearest(emb, q, "vec_id", "embedding", 4)


@register("t06_top_k_nearest")
def t06(spark, sf):
    return report(_hits(dom(spark, sf)))


@register("t06_top_k_filtered")
def t06f(spark, sf):
    d = dom(spark, sf)
    emb = d.t("embeddings")
    q = tx.label_centroids(emb)
    return report(tx.top_k_nearest(emb, q, "vec_id", "embedding", 4, filter_eq={"label": 1}))


def _attr(d):
    f = stored_features(d)
    recent = trailing_window(f, 90)
    return recent, ex.linear_attribution(recent, LINEAR_COEFS, recent)


@register("x03_linear_attribution")
def x03(spark, sf):
    _, a = _attr(dom(spark, sf))
    return report(a)


@register("a08_seller_mean_attribution")
def a08(spark, sf):
    _, a = _attr(dom(spark, sf))
    return report(ex.seller_mean_attribution(a))


@register("k03_top_drivers")
def k03(spark, sf):
    _, a = _attr(dom(spark, sf))
    t = ex.top_drivers(ex.seller_mean_attribution(a))
    return report(t.select("seller_id", F.posexplode("top_features").alias("rank", "f"))
                  .select("seller_id", (F.col("rank") + 1).alias("rank"), "f.feature", "f.contribution"))


@register("x06_global_importance")
def x06(spark, sf):
    _, a = _attr(dom(spark, sf))
    return report(ex.global_importance(a))


def _preds_and_drivers(d):
    preds = ru.score_and_rollup(stored_features(d, CORE), formula_score()).withColumn("model_name", F.lit("promise-formula"))
    _, a = _attr(d)
    drivers = ex.top_drivers(ex.seller_mean_attribution(a))
    drivers = drivers.join(preds.select("seller_id"), "seller_id", "left_semi")
    return preds, drivers


@register("t02_prediction_documents")
def t02(spark, sf):
    d = dom(spark, sf)
    preds, drivers = _preds_and_drivers(d)
    return report(tx.prediction_documents(preds, d.sellers, drivers.select("seller_id", "top_features")))


@register("x07_explanation_lookup")
def x07(spark, sf):
    d = dom(spark, sf)
    preds, drivers = _preds_and_drivers(d)
    top = preds.agg(F.min("seller_id")).first()[0]
    out = ex.explanation_lookup(preds, drivers, top)
    return report(out.select("seller_id", "risk_score", "risk_band", F.size("top_features").cast("long").alias("n_drivers"),
                             F.col("top_features")[0]["feature"].alias("top_feature")))


@register("k05_biggest_driver")
def k05b(spark, sf):
    d = dom(spark, sf)
    _, drivers = _preds_and_drivers(d)
    return report(ex.biggest_driver(drivers))


@register("t08_grounded_answers")
def t08(spark, sf):
    d = dom(spark, sf)
    emb = d.t("embeddings")
    q = tx.label_centroids(emb)
    hits = tx.top_k_nearest(emb, q, "vec_id", "embedding", 4)
    texts = d.t("documents").select(F.col("doc_id").alias("vec_id"), "text")
    return report(tx.assemble_answers(hits, texts, "vec_id", q.select("query_id")))


def _index_docs(d):
    preds, drivers = _preds_and_drivers(d)
    pdocs = tx.prediction_documents(preds, d.sellers, drivers.select("seller_id", "top_features"))
    rdocs = tx.review_documents(d.reviews, d.order_items, d.sellers, 2000)
    return pdocs.unionByName(rdocs)


@register("t04_index_build")
def t04(spark, sf):
    idx = tx.build_index(_index_docs(dom(spark, sf)))
    return report(idx.select("chunk_id", "text", F.col("metadata")["seller_id"].alias("seller_id"),
                             F.col("metadata")["source"].alias("source")))


@register("t06_text_retrieval")
def t06t(spark, sf):
    """Benchmark passages as questions against TF-IDF vectors of all
    document chunks (512/50), top-4 by distance over an inverted index."""
    d = dom(spark, sf)
    ch = cut_lineage(tx.chunks(_docs(d), "doc_id").select("chunk_id", "text"))
    tc = cut_lineage(tx.term_counts(ch, "chunk_id"))
    vocab = cut_lineage(tx.fit_vocabulary(tc, "chunk_id", ch.count()))
    index = tx.tfidf_from_counts(tc, "chunk_id", vocab)
    qs = d.t("benchmark").select(F.col("item_id").alias("query_id"), "text")
    qv = tx.query_vectors(qs, vocab)
    return report(tx.top_k_sparse(index, qv, "chunk_id", 4))
