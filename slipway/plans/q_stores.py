"""Queries that write and read back (load, publish, run log, index, feature table), and full serving results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from slipway.operators import explain as ex
from slipway.operators import metrics as me
from slipway.operators import payloads as pay
from slipway.operators import refusals as rf
from slipway.operators import rollup as ru
from slipway.operators import text as tx
from slipway.operators.gram import correlation_matrix
from slipway.operators.isotonic import isotonic_blocks
from slipway.operators.order_features import TARGET, trailing_window
from slipway.operators.runlog import RunLog
from slipway.operators.vectorindex import VectorIndex
from slipway.plans.q_core import formula_score
from slipway.plans.q_eval import _models, _scores
from slipway.plans.q_text import LINEAR_COEFS
from slipway.plans.queries import dom, register, report
from slipway.plans.stored import CORE, stored_features
from slipway.session import cut_lineage, ensure_checkpoint_dir
from slipway.sources import io
from slipway.sources.features import FeatureStore
from slipway.sources.tables import Tables, load_all, publish_predictions


def _root(spark, name: str) -> str:
    """A folder of this call's own beside the checkpoints (shared by all executors)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stores/{name}-{uuid.uuid4().hex}"


def _sources(d) -> dict:
    return {"sellers": d.sellers, "customers": d.customers, "products": d.products, "orders": d.orders,
            "order_items": d.order_items, "reviews": d.reviews, "external_signals": d.signals}


# ------------------------------------------------------------------ sources and sinks
@register("s12_load_tables")
def s12l(spark, sf):
    """Every table loaded twice with reset, counted from what is stored; one optional source is absent."""
    tables = Tables(spark, _root(spark, "load"))
    sources = {**_sources(dom(spark, sf)), "landed_news": None}
    load_all(tables, sources, optional=("landed_news",))
    counts = load_all(tables, sources, optional=("landed_news",))
    n = {t: len(tables.versions(t)) for t in sources}
    versions = F.create_map(*[x for t, v in n.items() for x in (F.lit(t), F.lit(v))])
    return report(counts.withColumn("n_versions", versions[F.col("table_name")]))


@register("s01_seller_csv_scan")
def s01c(spark, sf):
    """Sellers landed as CSV with a byte order mark, read back with the declared schema, four columns kept."""
    d, path = dom(spark, sf), _root(spark, "sellers-csv")
    s = d.sellers
    marked = s.select(F.col("seller_id").alias("﻿seller_id"), "seller_zip", "seller_state")
    marked.write.option("header", True).csv(path)
    back = io.read_csv(spark, path, s.select("seller_id", "seller_zip", "seller_state").schema)
    return report(back.select("seller_id", "seller_zip", "seller_state"))


@register("s09_table_store_steps")
def s09(spark, sf):
    """The steps of the plain table store with the rows each leaves."""
    d = dom(spark, sf)
    root = _root(spark, "plain")
    store = io.TableStore(spark, f"{root}/tables")
    steps = [("S16 create all", len(store.create_all()))]
    orders = d.orders.select("order_id", "customer_id", "order_status")
    store.write_df(orders, "staged_orders", "replace")
    store.write_df(orders, "staged_orders", "append")
    steps.append(("S09 replace then append", store.read_table("staged_orders").count()))
    steps.append(("S07 limit", store.read_table("staged_orders", 10).count()))
    steps.append(("S08 select", store.read_query("select distinct order_id from staged_orders", ["staged_orders"]).count()))
    store.export_snapshots(f"{root}/csv", ["staged_orders"], "csv")
    steps.append(("S13 snapshot", spark.read.option("header", True).csv(f"{root}/csv/staged_orders").count()))
    steps.append(("S06 files present", len(io.verify_files_present(root, ["tables/staged_orders"], ["csv", "absent"]))))
    schema = io.CATALOG["external_signals"]
    signals = d.signals.select(*[F.col(f.name).cast(f.dataType) if f.name in d.signals.columns else F.lit(None).cast(f.dataType).alias(f.name)
                                 for f in schema])
    signals.write.option("header", True).csv(f"{root}/signals.csv")
    steps.append(("S11 csv to table", store.csv_to_table(f"{root}/signals.csv", "external_signals")))
    io.write_small(me.cost_curve(_scores(d)), f"{root}/cost_curve")
    steps.append(("S19 cost curve", spark.read.option("header", True).csv(f"{root}/cost_curve").count()))
    store.truncate("staged_orders")
    steps.append(("S10 truncate", store.read_table("staged_orders").count()))
    return report(spark.createDataFrame([(s, int(n)) for s, n in steps], "step string, n_rows long"))


@register("s14_feature_store")
def s14f(spark, sf):
    """Features by month; a second build that differs in the newest month rewrites that month alone."""
    f = stored_features(dom(spark, sf), CORE).select("order_id", "seller_id", "promised_days", TARGET, "as_of_date")
    store = FeatureStore(spark, _root(spark, "features"))
    newest = f.agg(F.date_format(F.max("as_of_date"), "yyyy-MM")).first()[0]
    fresh = F.date_format("as_of_date", "yyyy-MM") == newest
    store.write(f.withColumn("promised_days", F.when(fresh, F.col("promised_days") + 1).otherwise(F.col("promised_days"))))
    changed = store.changed_months(f)
    store.write(f.filter(F.date_format("as_of_date", "yyyy-MM").isin(changed)))
    out = store.read().groupBy("month").agg(F.count("*").alias("n_rows"), F.sum("promised_days").alias("promised_days"))
    return report(out.withColumn("rewritten", F.col("month").isin(changed).cast("int")))


@register("p02_category_translation")
def p02(spark, sf):
    """Each product's category in its translation, the original where there is none."""
    d = dom(spark, sf)
    names = d.products.filter(F.col("category").isNotNull()).select("category").distinct()
    translation = names.filter(F.substring("category", -1, 1) != "3").select(
        "category", F.concat(F.lit("group_"), F.lower(F.regexp_replace("category", "#", "_"))).alias("translated"))
    j = d.products.join(translation, "category", "left")
    return report(j.select("product_id", F.coalesce("translated", "category").alias("category")))


@register("p17_fix_types")
def p17(spark, sf):
    """Texts to dates (bad ones null) and categories."""
    from slipway.operators.prep import fix_types
    o = dom(spark, sf).t("orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.lit("no date")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("day"),
        F.col("o_custkey").alias("customer"))
    return report(fix_types(o, ["day"], ["customer"]))


# ------------------------------------------------------------------ landed payloads
def _news(d):
    """Lists of 20 documents as landed news; every 17th list is cut off in the middle."""
    a = F.struct(F.concat_ws(" ", "source", "lang").alias("title"), F.col("text").alias("description"),
                 F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")), "yyyy-MM-dd").alias("publishedAt"),
                 F.struct(F.col("source").alias("name")).alias("source"))
    g = d.t("documents").groupBy(F.floor(F.col("doc_id") / 20).cast("long").alias("payload_id")).agg(
        F.sort_array(F.collect_list(F.struct("doc_id", a.alias("a")))).alias("l"))
    body = F.to_json(F.struct(F.lit("ok").alias("status"), F.transform("l", lambda x: x["a"]).alias("articles")), {"ignoreNullFields": "false"})
    return g.select("payload_id", F.when(F.col("payload_id") % 17 == 3, F.substr(body, F.lit(1), F.length(body) - 7)).otherwise(body).alias("payload"))


@register("s18_news_payloads")
def s18n(spark, sf):
    out = pay.parse_news(_news(dom(spark, sf)))
    return report(out.select("payload_id", "place", "title", F.sha2("description", 256).alias("description_sha"), "published_at", "source",
                             F.col("bad").isNotNull().cast("int").alias("bad")))


@register("s18_weather_payloads")
def s18w(spark, sf):
    """Events as landed weather: some without conditions, some without wind, some that are no JSON."""
    e = dom(spark, sf).t("events")
    entry = F.array(F.struct(F.col("event_type").alias("main")))
    k = F.col("event_id")
    body = F.to_json(F.struct(F.when(k % 11 == 0, F.array().cast("array<struct<main:string>>")).otherwise(entry).alias("weather"),
                              F.when(k % 13 != 0, F.struct(F.col("value").alias("speed"))).alias("wind")))
    raw = e.select(k.alias("payload_id"), F.when(k % 19 == 4, F.lit("<html>503</html>")).otherwise(body).alias("payload"),
                   F.col("ts").alias("fetched_at"))
    return report(pay.parse_weather(raw).withColumn("bad", F.col("bad").isNotNull().cast("int")))


@register("s18_raw_observations")
def s18r(spark, sf):
    """Daily prices as landed observations, kept as text."""
    raw = io.landed_series_payloads(dom(spark, sf).prices, "d", "value").select(F.date_format("month", "yyyy-MM-dd").alias("payload_id"), "payload")
    return report(pay.parse_observations(raw).select("date", F.col("value").try_cast("double").alias("value")))


# ------------------------------------------------------------------ refusals, matrices, calibration
@register("j11_realign_strict")
def j11s(spark, sf):
    """Scores re-attached to the scored feature rows; a row without one would fail the query."""
    d = dom(spark, sf)
    rows = stored_features(d, CORE).select("order_id", "seller_id", "promised_days")
    return report(rf.realign(rows, d.scores, ["order_id", "seller_id"]))


@register("e11_comparison_strict")
def e11s(spark, sf):
    """E11 with the check that all models were scored on the same rows, and the lift of PR-AUC."""
    out = rf.compare_models(cut_lineage(_models(dom(spark, sf))))
    return report(out.select("model", "pr_auc", "pr_auc_lift", "roc_auc", "ks_statistic", "capture_at_10pct", "lift_at_10pct",
                             "capture_at_20pct", "brier", "ece", "f1", "precision", "recall"))


@register("x10_metrics_full")
def x10f(spark, sf):
    """All metrics of all models, best first, and which is best."""
    m = cut_lineage(rf.compare_models(cut_lineage(_models(dom(spark, sf)))))  # a row per model
    best = m.agg(F.max_by("model", F.struct("pr_auc", "model"))).first()[0]
    return report(m.select("model", "pr_auc", "pr_auc_lift", "roc_auc", "ks_statistic", "capture_at_10pct", "lift_at_10pct",
                           "capture_at_20pct", "brier", "ece", "f1", "precision", "recall", F.lit(best).alias("best_model")))


@register("a17_correlation_matrix")
def a17m(spark, sf):
    """The whole Pearson matrix of the numeric order features and the label."""
    from slipway.operators.eda import numeric_columns
    f = stored_features(dom(spark, sf)).drop("_rid")
    return report(correlation_matrix(f, [*numeric_columns(f, exclude=[TARGET]), TARGET]))


@register("e14_isotonic_blocks")
def e14b(spark, sf):
    """Calibrated value of every score (rounded to four digits) with its rows."""
    s = _scores(dom(spark, sf)).select("y", F.round("score", 4).alias("score"))
    points = s.groupBy("score").agg(F.count("*").alias("n"))
    blocks = isotonic_blocks(s).select("lo", "hi", "value")
    # scores lie in blocks that do not overlap: look each up from the block that begins at or before it
    from slipway.operators.joins import asof_backward
    t = lambda c: F.timestamp_micros((F.col(c) * 1e6).cast("long"))
    j = asof_backward(points.select("score", "n", F.lit(1).alias("k"), t("score").alias("t")),
                      blocks.select("value", F.lit(1).alias("k"), t("lo").alias("t")), "k", "t", "t", ["value"], bucket_seconds=1)
    return report(j.select("score", "n", F.col("value").alias("calibrated")))


@register("e16_reliability_curves")
def e16c(spark, sf):
    """The reliability curves before and after a fixed monotone recalibration."""
    s = _scores(dom(spark, sf)).withColumn("cal", F.col("score") * F.col("score"))
    one = me.reliability_table(s).select(F.lit("raw").alias("curve"), "bin", "mean_predicted", "observed_rate", "n")
    two = me.reliability_table(s, score="cal").select(F.lit("calibrated").alias("curve"), "bin", "mean_predicted", "observed_rate", "n")
    return report(one.unionByName(two))


# ------------------------------------------------------------------ publish, run log, index
def _published(d):
    f = stored_features(d)
    preds = ru.score_and_rollup(f, formula_score())
    recent = trailing_window(f, 90)
    drivers = ex.top_drivers(ex.seller_mean_attribution(ex.linear_attribution(recent, LINEAR_COEFS, recent)))
    now = f.agg(F.max("as_of_date")).first()[0]
    return preds, drivers.select("seller_id", "top_features"), now


@register("x01_published_predictions")
def x01p(spark, sf):
    """Predictions published twice and read back, a row per driver."""
    d = dom(spark, sf)
    tables = Tables(spark, _root(spark, "predictions"))
    preds, drivers, now = _published(d)
    preds, drivers = cut_lineage(preds), cut_lineage(drivers)
    publish_predictions(tables, preds.limit(1), drivers, "older", now)
    publish_predictions(tables, preds, drivers, "promise-formula", now)
    out = tables.read("predictions")
    return report(out.select("seller_id", "raw", "risk_score", "n_orders", "risk_band", "model_name", "predicted_at",
                             F.posexplode("top_features").alias("rank", "f"))
                  .select("seller_id", "raw", "risk_score", "n_orders", "risk_band", "model_name", "predicted_at",
                          (F.col("rank") + 1).alias("rank"), "f.feature", "f.contribution"))


@register("x07_explanation_drivers")
def x07d(spark, sf):
    """One seller's score, band and whole driver array, a row per driver; an unknown seller has none."""
    preds, drivers, _ = _published(dom(spark, sf))
    preds = cut_lineage(preds)
    who = preds.agg(F.min("seller_id"), F.max("seller_id")).first()
    asked = preds.filter(F.col("seller_id").isin(who[0], who[1], -1))
    out = asked.join(drivers, "seller_id", "left")
    return report(out.select("seller_id", "risk_score", "risk_band", F.posexplode("top_features").alias("rank", "f"))
                  .select("seller_id", "risk_score", "risk_band", (F.col("rank") + 1).alias("rank"), "f.feature", "f.contribution"))


@register("x09_summary_full")
def x09f(spark, sf):
    """The whole summary in long form: bands, mean risk, the 20 histogram bins, every state."""
    d = dom(spark, sf)
    r = cut_lineage(ru.score_and_rollup(stored_features(d, CORE), formula_score()))

    def part(df, section, key, value, extra=None):
        return df.select(F.lit(section).alias("section"), F.col(key).cast("string").alias("key"),
                         F.col(value).cast("double").alias("value"), (F.col(extra).cast("double") if extra else F.lit(None).cast("double")).alias("extra"))

    bands = r.groupBy("risk_band").agg(F.count("*").alias("n"))
    total = r.agg(F.lit("all").alias("k"), F.count("*").alias("n"), F.avg("risk_score").alias("avg_risk"))
    states = ru.state_summary(r, d.sellers)
    out = (part(total, "total", "k", "n", "avg_risk").unionByName(part(bands, "band", "risk_band", "n"))
           .unionByName(part(ru.risk_histogram(r), "histogram", "bin", "count"))
           .unionByName(part(states, "state", "state", "count", "avg_risk"))
           .unionByName(part(states, "state_critical", "state", "critical_count")))
    return report(out)


@register("s21_run_log_versions")
def s21v(spark, sf):
    """Two runs (orders of even number, then all) logged and their best models registered; the first is archived."""
    d = dom(spark, sf)
    log = RunLog(spark, _root(spark, "runs"))
    m = cut_lineage(_models(d).withColumn("order_id", F.floor(F.col("id") / 1000000)))
    for run, rows in (("run-1", m.filter(F.col("order_id") % 2 == 0)), ("run-2", m)):
        for r in me.ranking_metrics(rows, part=["model"]).orderBy("model").collect():  # a row per model
            log.log_run(run, r["model"], {"rows": run}, {c: r[c] for c in ("pr_auc", "roc_auc", "ks_statistic")})
        log.register_best(run)
    out = log.runs()
    return report(out.select("run_id", "model", F.col("metrics")["pr_auc"].alias("pr_auc"), F.col("metrics")["roc_auc"].alias("roc_auc"),
                             "version", "stage"))


def _prediction_docs(d):
    preds, drivers, _ = _published(d)
    preds = cut_lineage(preds.withColumn("model_name", F.lit("promise-formula")))
    docs = tx.prediction_documents(preds, d.sellers, drivers)
    bands = preds.select(F.col("seller_id").cast("string").alias("seller_id"), "risk_band")
    return docs.join(bands, "seller_id", "left").select("id", "text", "seller_id", "source", "risk_band")


def _index(spark, d):
    index = VectorIndex(Tables(spark, _root(spark, "index")))
    index.build(_prediction_docs(d), reset=True)
    reviews = tx.review_documents(d.reviews, d.order_items, d.sellers, 2000)
    index.build(reviews.select("id", "text", "seller_id", "source", F.lit(None).cast("string").alias("risk_band")), reset=False)
    return index


@register("t04_vector_index")
def t04v(spark, sf):
    """Predictions indexed anew, reviews appended in the same space; each chunk with its vector's size and sum."""
    c = _index(spark, dom(spark, sf)).chunks()
    meta = [F.col("metadata")[k].alias(k) for k in ("seller_id", "source", "risk_band")]
    return report(c.select("chunk_id", "text", *meta, F.size("vector").alias("n_terms"),
                           F.aggregate("vector", F.lit(0.0), lambda a, v: a + v["weight"]).alias("weight_sum")))


@register("t06_index_retrieval")
def t06i(spark, sf):
    """The four nearest review chunks of every benchmark passage, from the stored index."""
    d = dom(spark, sf)
    q = d.t("benchmark").select(F.col("item_id").alias("query_id"), "text")
    return report(_index(spark, d).query(q, 4, {"source": "customer_review"}).select("query_id", "rank", "distance"))


@register("t08_grounded_prompts")
def t08p(spark, sf):
    """The prompt of each question: context bullets and the question; without a hit the "nothing found" answer."""
    d = dom(spark, sf)
    emb = d.t("embeddings")
    q = tx.label_centroids(emb)
    hits = tx.top_k_nearest(emb, q, "vec_id", "embedding", 4).filter("query_id != 3")
    texts = d.t("documents").select(F.col("doc_id").alias("vec_id"), "text")
    asked = q.select("query_id", F.format_string("What is known about group %d?", F.col("query_id")).alias("question"))
    return report(tx.grounded_prompts(hits, texts, "vec_id", asked))


@register("l06_screening_aucs")
def l06a(spark, sf):
    """Three forests per candidate label on the same purged split."""
    from slipway.operators import labels as lb
    from slipway.operators import panel as pn
    from slipway.plans.q_panel import WS, _panel
    f = cut_lineage(lb.attach_forward(pn.delivery_history(_panel(dom(spark, sf)), WS)))
    p0 = lb.base_rate(f)
    cands = {"any_late": lb.any_late(f), "rate_15": lb.rate_label(f, 0.15, 5), "shrunk_15": lb.shrunk_label(f, 0.15, 20.0, 5, p0),
             "zscore_1": lb.zscore_label(f, 1.0, 5, p0), "stratified_20": lb.stratified_label(f, 0.2, 5)}
    return report(lb.screening_aucs(f, cands))
