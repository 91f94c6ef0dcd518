"""Queries: sources, order features, joins, aggregates, rollup, serving."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from slipway.functions.exprs import day_no
from slipway.operators import order_features as of
from slipway.operators import rollup as ru
from slipway.operators.joins import asof_backward, dedupe_first
from slipway.operators.metrics import quantile_bands
from slipway.plans.queries import dom, register, report
from slipway.plans.ranking import row_numbers
from slipway.plans.stored import CORE, stored_features

def formula_score():
    """Fixed formula scorer 1 / (1 + promised_days) (built lazily: needs a session)."""
    return F.lit(1e0) / (F.lit(1e0) + F.col("promised_days"))


def _osa(d):
    return of.order_seller_aggregate(d.order_items, d.orders, d.products, d.customers, d.sellers)


def _features(d, columns=None):
    """The order features, built once a session."""
    return stored_features(d, columns).drop("_rid")


def _rollup(d):
    return ru.score_and_rollup(_features(d, CORE), formula_score())


# ------------------------------------------------------------------ sources
@register("s01_dimension_scan")
def s01(spark, sf):
    return report(dom(spark, sf).customers)


@register("s02_orders_scan")
def s02(spark, sf):
    return report(dom(spark, sf).orders)


@register("s03_items_scan")
def s03(spark, sf):
    return report(dom(spark, sf).order_items)


@register("s04_reviews_dedupe")
def s04(spark, sf):
    r = dom(spark, sf).reviews
    return report(dedupe_first(r, ["review_id", "order_id"], ["created", "review_score", "comment"]))


@register("s15_serving_sellers")
def s15(spark, sf):
    d = dom(spark, sf)
    return report(d.sellers.join(_rollup(d).select("seller_id"), "seller_id", "left_semi"))


# ------------------------------------------------------------------ labels and features
@register("p01_label")
def p01(spark, sf):
    o = of.label_columns(dom(spark, sf).orders)
    return report(o.select("order_id", "delay_days", "is_late"))


@register("j01_star_join_aggregate")
def j01(spark, sf):
    return report(_osa(dom(spark, sf)))


@register("p04_promise_features")
def p04(spark, sf):
    df = of.promise_features(_osa(dom(spark, sf)))
    return report(df.select("order_id", "seller_id", "promised_days", "shipping_limit_days", "handover_share"))


@register("p05_calendar_features")
def p05(spark, sf):
    df = of.calendar_features(_osa(dom(spark, sf)))
    return report(df.select("order_id", "seller_id", "purchase_hour", "purchase_dow", "purchase_month",
                            "purchase_is_weekend"))


@register("p06_shipment_features")
def p06(spark, sf):
    df = of.shipment_features(_osa(dom(spark, sf)))
    return report(df.select("order_id", "seller_id", "freight_ratio", "price_per_item", "density",
                            "log_weight", "log_volume"))


@register("p07_route_features")
def p07(spark, sf):
    df = of.route_features(_osa(dom(spark, sf)))
    return report(df.select("order_id", "seller_id", "same_state", "zip_gap", "seller_zip_region",
                            "customer_zip_region"))


@register("j07_lagged_history")
def j07(spark, sf):
    df = _osa(dom(spark, sf))
    df = of.lagged_history(df, "seller_id", "seller", 30)
    df = of.lagged_history(df, "customer_state", "state", 30)
    return report(df.select("order_id", "seller_id", "seller_prior_orders", "seller_prior_late_rate",
                            "state_prior_orders", "state_prior_late_rate"))


@register("a06_daily_running_counts")
def a06(spark, sf):
    df = of.daily_running_counts(_osa(dom(spark, sf)), "seller_id")
    return report(df.select("seller_id", "day_no", "n", "late", "cum_n", "cum_late"))


@register("a09_collapse_categories")
def a09(spark, sf):
    df = of.collapse_categories(_osa(dom(spark, sf)), 20)
    return report(df.select("order_id", "seller_id", "category"))


@register("s14_order_feature_table")
def s14(spark, sf):
    return report(of.order_feature_table(dom(spark, sf)))


@register("p11_trailing_window")
def p11(spark, sf):
    f = _features(dom(spark, sf))
    return report(of.trailing_window(f, 90).select("order_id", "seller_id", "as_of_date"))


@register("p12_min_activity")
def p12(spark, sf):
    d = dom(spark, sf)
    # sellers with >= 50 labelled order-seller rows over the whole history
    f = of.min_activity(_features(d), "seller_id", 50)
    return report(f.groupBy("seller_id").agg(F.count(F.lit(1)).alias("n_rows")))


@register("j08_asof_events")
def j08(spark, sf):
    """Latest 'view' value at or before each 'click', per user (two tables)."""
    e = dom(spark, sf).t("events")
    clicks = e.filter(F.col("event_type") == "click").select("event_id", "user_id", "ts")
    views = e.filter(F.col("event_type") == "view").select("user_id", F.col("ts").alias("view_ts"),
                                                           F.col("value").alias("view_value"))
    j = asof_backward(clicks, views, "user_id", "ts", "view_ts", ["view_ts", "view_value"])
    return report(j.select("event_id", "user_id", "view_ts", "view_value"))


@register("j09_semi_join_active")
def j09(spark, sf):
    d = dom(spark, sf)
    keep = of.min_activity(d.order_items, "seller_id", 600).select("seller_id").distinct()
    return report(d.sellers.join(keep, "seller_id", "left_semi"))


@register("j04_left_join_sellers")
def j04(spark, sf):
    d = dom(spark, sf)
    return report(_rollup(d).join(d.sellers, "seller_id", "left")
                  .select("seller_id", "seller_state", "seller_zip", "risk_score", "risk_band"))


@register("j11_realign_scores")
def j11(spark, sf):
    """Scores re-attached to feature rows by key; the anti-join count must be 0."""
    d = dom(spark, sf)
    f = _features(d).select("order_id", "seller_id", "promised_days")
    s = d.scores
    j = f.join(s, ["order_id", "seller_id"], "left")
    return report(j.agg(F.count(F.lit(1)).alias("n_rows"),
                        F.count_if(F.col("score").isNull()).alias("n_missing")))


# ------------------------------------------------------------------ aggregates
@register("a02_seller_day_orders")
def a02(spark, sf):
    from slipway.operators.panel import seller_day_orders
    d = dom(spark, sf)
    return report(seller_day_orders(d.orders, d.order_items))


@register("a03_seller_day_reviews")
def a03(spark, sf):
    from slipway.operators.panel import seller_day_reviews
    d = dom(spark, sf)
    return report(seller_day_reviews(d.reviews, d.order_items))


@register("a04_signals_pivot")
def a04(spark, sf):
    from slipway.operators.panel import signals_wide
    return report(signals_wide(dom(spark, sf).signals))


@register("a04_events_pivot")
def a04e(spark, sf):
    e = dom(spark, sf).t("events")
    types = ["click", "view", "purchase", "error", "signup"]
    return report(e.groupBy(F.to_date("ts").alias("d")).pivot("event_type", types).agg(F.avg("value")))


@register("a05_seller_span")
def a05(spark, sf):
    from slipway.operators.panel import seller_day_orders
    d = dom(spark, sf)
    o = seller_day_orders(d.orders, d.order_items)
    return report(o.groupBy("seller_id").agg(F.min("order_date").alias("first_day"),
                                             F.max("order_date").alias("last_day"),
                                             F.sum("orders_n").alias("lifetime_orders")))


@register("a07_seller_rollup")
def a07(spark, sf):
    return report(_rollup(dom(spark, sf)).select("seller_id", "raw", "risk_score", "n_orders"))


@register("x01_score_and_publish")
def x01(spark, sf):
    return report(_rollup(dom(spark, sf)))


@register("e13_quantile_bands")
def e13(spark, sf):
    s = dom(spark, sf).scores
    return report(quantile_bands(s, "score").select("order_id", "seller_id", "risk_band"))


@register("k01_ranked_sellers")
def k01(spark, sf):
    d = dom(spark, sf)
    return report(ru.ranked_sellers(_rollup(d), d.sellers, None, 500))


@register("k01_ranked_sellers_band")
def k01b(spark, sf):
    d = dom(spark, sf)
    return report(ru.ranked_sellers(_rollup(d), d.sellers, "high", 500))


@register("k06_predictions_order")
def k06(spark, sf):
    r = _rollup(dom(spark, sf))
    return report(row_numbers(r, "raw", "seller_id", desc=True, name="position")
                  .select("seller_id", "position", "risk_band"))


@register("a10_band_counts")
def a10(spark, sf):
    return report(ru.band_summary(_rollup(dom(spark, sf))))


@register("a11_state_summary")
def a11(spark, sf):
    d = dom(spark, sf)
    return report(ru.state_summary(_rollup(d), d.sellers))


@register("a12_risk_histogram")
def a12(spark, sf):
    return report(ru.risk_histogram(_rollup(dom(spark, sf))))


@register("k05_top_states")
def k05(spark, sf):
    d = dom(spark, sf)
    return report(ru.top_states(_rollup(d), d.sellers, 12))


@register("a13_states_and_span")
def a13(spark, sf):
    d = dom(spark, sf)
    st = d.sellers.select("seller_state").distinct()
    sp = d.orders.agg(F.min(F.to_date("purchase")).alias("first_day"), F.max(F.to_date("purchase")).alias("last_day"))
    return report(st.crossJoin(F.broadcast(sp)))


@register("a14_signal_provenance")
def a14(spark, sf):
    s = dom(spark, sf).signals
    return report(s.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("is_synthetic") == 0).alias("real"),
                        F.count_if(F.col("is_synthetic") == 1).alias("generated")))


@register("a15_base_rate")
def a15(spark, sf):
    from slipway.operators.panel import seller_day_orders
    d = dom(spark, sf)
    o = seller_day_orders(d.orders, d.order_items)
    return report(o.agg((F.sum("late_n") / F.sum("orders_n")).alias("p0")))


@register("a16_class_distribution")
def a16(spark, sf):
    f = _features(dom(spark, sf), CORE)
    g = f.groupBy(of.TARGET).agg(F.count(F.lit(1)).alias("n"))
    tot = f.agg(F.count(F.lit(1)).alias("_t"))
    return report(g.crossJoin(F.broadcast(tot)).select(of.TARGET, (F.col("n") * 100.0 / F.col("_t")).alias("pct")))


@register("a18_monthly_late_rate")
def a18(spark, sf):
    f = _features(dom(spark, sf))
    return report(f.groupBy(F.last_day(F.to_date("as_of_date")).alias("month_end"))
                  .agg(F.avg(F.col(of.TARGET).cast("double")).alias("late_rate")))


@register("u01_union_signals")
def u01(spark, sf):
    s = dom(spark, sf).signals
    gen = s.filter(F.col("is_synthetic") == 1)
    real = s.filter(F.col("is_synthetic") == 0)
    u = gen.unionByName(real)
    return report(u.groupBy("source", "is_synthetic").agg(F.count(F.lit(1)).alias("n"),
                                                         F.sum("value").alias("total")))


@register("w17_running_counts_state")
def w17(spark, sf):
    df = of.daily_running_counts(_osa(dom(spark, sf)), "customer_state")
    return report(df.select("customer_state", "day_no", "cum_n", "cum_late"))


@register("p08_promise_filter")
def p08(spark, sf):
    f = _features(dom(spark, sf))
    return report(f.agg(F.count(F.lit(1)).alias("n_rows"), F.min("promised_days").alias("min_promised")))


__all__ = ["day_no"]


# ------------------------------------------------------------------ cleaning, catalog, run log
@register("p13_nonempty_text")
def p13(spark, sf):
    r = dom(spark, sf).reviews
    return report(r.filter(F.col("comment").isNotNull() & (F.col("comment") != "")).select("review_id", "order_id"))


@register("p15_handle_missing")
def p15(spark, sf):
    from slipway.operators.prep import handle_missing
    f = _features(dom(spark, sf)).select("order_id", "seller_id", "density", "log_weight", "seller_prior_late_rate")
    return report(handle_missing(f, "median"))


@register("p16_winsorise")
def p16(spark, sf):
    from slipway.operators.prep import remove_outliers
    f = _features(dom(spark, sf), ("order_id", "seller_id", "total_price", "zip_gap", "density"))
    return report(remove_outliers(f, ["total_price", "zip_gap", "density", "not_a_column"], 1.5))


@register("p18_drop_duplicates")
def p18(spark, sf):
    from slipway.operators.prep import drop_duplicates
    li = dom(spark, sf).t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return report(drop_duplicates(li, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"]))


@register("p18_exact_distinct")
def p18d(spark, sf):
    from slipway.operators.prep import drop_duplicates
    li = dom(spark, sf).t("lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    return report(drop_duplicates(li))


@register("s12_reload_counts")
def s12(spark, sf):
    d = dom(spark, sf)
    views = {"sellers": d.sellers, "customers": d.customers, "products": d.products, "orders": d.orders,
             "order_items": d.order_items, "reviews": d.reviews, "external_signals": d.signals}
    out = None
    for name, v in views.items():
        c = v.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = c if out is None else out.unionByName(c)
    return report(out)


def _runs(spark, sf):
    """The compared models with their rank, evaluated once a session (what an append-only log keeps: ``operators.runlog``)."""
    from slipway.operators import metrics as me
    from slipway.plans.q_eval import _models
    d = dom(spark, sf)
    rank = F.row_number().over(Window.orderBy(F.desc("pr_auc"), F.desc("model")))  # <= #models rows
    return d.stored("runs", lambda: me.ranking_metrics(_models(d), part=["model"]).withColumn("version", rank).withColumn(
        "stage", F.when(F.col("version") == 1, "Production").otherwise("Archived")))


@register("s21_run_log")
def s21(spark, sf):
    return report(_runs(spark, sf).select("model", "pr_auc", "roc_auc", "stage"))


@register("x11_live_model")
def x11(spark, sf):
    runs = _runs(spark, sf)
    prod = runs.filter(F.col("stage") == "Production").agg(F.max("model").alias("p"))
    best = runs.agg(F.max_by("model", F.struct("pr_auc", "model")).alias("b"))
    j = prod.crossJoin(best)
    return report(j.select(F.when(F.col("p").isNotNull() | F.col("b").isNotNull(), "ok").otherwise("none registered")
                           .alias("status"), F.coalesce("p", "b").alias("model_name"),
                           F.when(F.col("p").isNotNull(), "Production").otherwise("evaluated").alias("model_stage")))


@register("x09_summary_kpis")
def x09(spark, sf):
    """One-row dashboard summary: totals, band counts, mean risk, histogram
    coverage, states, and the best evaluated model with its PR-AUC."""
    d = dom(spark, sf)
    r = _rollup(d)
    bands = r.agg(F.count(F.lit(1)).alias("total"), F.avg("risk_score").alias("avg_risk"),
                  *[F.count_if(F.col("risk_band") == b).alias(f"n_{b}") for b in ru.BANDS])
    hist = ru.risk_histogram(r).agg(F.count_if(F.col("count") > 0).alias("hist_nonempty_bins"),
                                    F.sum("count").alias("hist_total"))
    states = ru.state_summary(r, d.sellers).agg(F.count(F.lit(1)).alias("n_states"))
    best = _runs(spark, sf).filter(F.col("version") == 1).select(F.col("model").alias("best_model"),
                                                                 F.col("pr_auc").alias("best_pr_auc"))
    return report(bands.crossJoin(hist).crossJoin(states).crossJoin(best))


@register("x10_metrics_listing")
def x10(spark, sf):
    runs = _runs(spark, sf)
    return report(runs.select("model", "pr_auc", "roc_auc", "ks_statistic",
                              (F.col("version") == 1).cast("int").alias("is_best")))


# Models whose scores cannot be explained per row, and the proxy used instead.
UNEXPLAINABLE = ("ensemble", "lstm")
EXPLAINER_PROXY = "boosted_trees"


@register("x02_winner_resolution")
def x02(spark, sf):
    best = _runs(spark, sf).filter(F.col("version") == 1).select(F.col("model").alias("winner"))
    bad = F.col("winner").isin(*UNEXPLAINABLE)
    return report(best.select("winner", F.when(F.col("winner") == "lstm", F.lit(EXPLAINER_PROXY))
                              .otherwise(F.col("winner")).alias("scorer"),
                              F.when(bad, F.lit(EXPLAINER_PROXY)).otherwise(F.col("winner")).alias("explainer")))
