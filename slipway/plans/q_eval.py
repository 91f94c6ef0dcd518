"""Queries: metrics, calibration tables, splits, preparation, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from slipway.operators import drift as dr
from slipway.operators import metrics as me
from slipway.operators import prep as pp
from slipway.operators import split as sp
from slipway.operators.order_features import TARGET
from slipway.plans.queries import dom, register, report
from slipway.plans.stored import CORE, stored_features

NUM_COLS = ["n_items", "total_price", "promised_days", "handover_share", "freight_ratio", "density", "zip_gap",
            "seller_prior_late_rate"]


def _scores(d):
    s = d.scores
    return s.withColumn("id", F.col("order_id") * 1000000 + F.col("seller_id"))


def _ft(d, columns=None):
    """The stored feature table (S14): written once to the checkpoint folder,
    so split points, fits and the main plan all read the same files."""
    return stored_features(d, columns)


def _models(d):
    """Long (model, id, y, score) table: three formula scorers on identical rows."""
    s = _scores(d)
    hashed = ((F.col("order_id") * 7919 + F.col("seller_id") * 31) % 1000) / F.lit(1e3)
    return (s.select(F.lit("promise").alias("model"), "id", "y", "score")
            .unionByName(s.select(F.lit("hashed").alias("model"), "id", "y", hashed.alias("score")))
            .unionByName(s.select(F.lit("inverse").alias("model"), "id", "y", (F.lit(1.0) - F.col("score")).alias("score"))))


@register("e01_e03_ranking_metrics")
def e01(spark, sf):
    return report(me.ranking_metrics(_scores(dom(spark, sf))))


@register("e04_capture_at_k")
def e04(spark, sf):
    return report(me.top_k_capture(_scores(dom(spark, sf))))


@register("k02_top_k_rows")
def k02(spark, sf):
    from slipway.plans.ranking import row_numbers
    s = _scores(dom(spark, sf))
    n = s.count()
    nk = max(int(round(n * 0.1)), 1)
    return report(row_numbers(s, "score", "id", desc=True).filter(F.col("rn") <= nk).select("order_id", "seller_id", "rn"))


@register("w13_equal_count_bins")
def w13(spark, sf):
    return report(me.equal_count_bins(_scores(dom(spark, sf))).select("order_id", "seller_id", "bin"))


@register("e05_reliability_table")
def e05(spark, sf):
    return report(me.reliability_table(_scores(dom(spark, sf))))


@register("e06_expected_calibration_error")
def e06(spark, sf):
    return report(me.expected_calibration_error(_scores(dom(spark, sf))))


@register("e07_e08_threshold_metrics")
def e08(spark, sf):
    return report(me.threshold_metrics(_scores(dom(spark, sf)), 0.05))


@register("e09_f1_optimal_threshold")
def e09(spark, sf):
    return report(me.f1_optimal_threshold(_scores(dom(spark, sf))))


@register("e10_cost_curve")
def e10(spark, sf):
    return report(me.cost_curve(_scores(dom(spark, sf))))


@register("e10_cost_optimal_threshold")
def e10b(spark, sf):
    return report(me.cost_optimal_threshold(_scores(dom(spark, sf))))


@register("e11_model_comparison")
def e11(spark, sf):
    m = _models(dom(spark, sf))
    r = me.ranking_metrics(m, part=["model"])
    t = me.threshold_metrics(m, 0.5, part=["model"])
    c = me.top_k_capture(m, (0.10, 0.20), part=["model"])
    cw = c.groupBy("model").agg(F.max(F.when(F.col("k") == 0.1, F.col("capture"))).alias("capture_at_10pct"),
                                F.max(F.when(F.col("k") == 0.1, F.col("lift"))).alias("lift_at_10pct"),
                                F.max(F.when(F.col("k") == 0.2, F.col("capture"))).alias("capture_at_20pct"))
    e = me.expected_calibration_error(m, part=["model"])
    out = r.join(t, "model").join(cw, "model").join(e, "model")
    return report(out.select("model", "pr_auc", "roc_auc", "ks_statistic", "capture_at_10pct", "lift_at_10pct",
                             "capture_at_20pct", "brier", "ece", "f1", "precision", "recall"))


@register("e19_quality_gate")
def e19(spark, sf):
    m = _models(dom(spark, sf))
    r = me.ranking_metrics(m, part=["model"])
    best = r.agg(F.max_by(F.struct("model", "pr_auc"), F.struct("pr_auc", F.col("model"))).alias("b"))
    return report(best.select(F.col("b.model").alias("best_model"), F.col("b.pr_auc").alias("pr_auc"),
                              (F.col("b.pr_auc") >= 0.13).cast("int").alias("passed")))


@register("e12_fixed_band")
def e12(spark, sf):
    s = _scores(dom(spark, sf))
    return report(s.select("order_id", "seller_id",
                           me.fixed_band("score", {"low": 0.03, "medium": 0.05, "high": 0.08}).alias("band")))


@register("e20_single_column_ablation")
def e20(spark, sf):
    f = _ft(dom(spark, sf))
    cols = ["promised_days", "zip_gap", "purchase_hour", "n_items", "total_price"]
    long = f.select("_rid", F.col(TARGET).alias("y"), *[F.col(c).cast("double").alias(c) for c in cols]) \
        .unpivot(["_rid", "y"], cols, "feature", "x")
    first = me.ranking_metrics(long.withColumnRenamed("x", "score"), part=["feature"])
    sign = first.select("feature", F.when(F.col("roc_auc") < 0.5, F.lit(-1.0)).otherwise(F.lit(1.0)).alias("sign"))
    l2 = long.join(F.broadcast(sign), "feature").withColumn("score", F.col("x") * F.col("sign"))
    second = me.ranking_metrics(l2, part=["feature"])
    return report(second.join(sign, "feature").select("feature", "pr_auc", "roc_auc", "ks_statistic",
                                                      (F.col("sign") < 0).cast("int").alias("flipped")))


@register("a23_score_quantiles")
def a23(spark, sf):
    from slipway.plans.ranking import quantiles_linear
    return report(quantiles_linear(_scores(dom(spark, sf)), "score", [i / 100 for i in range(1, 100)]))


@register("a22_nearest_date_quantiles")
def a22(spark, sf):
    f = _ft(dom(spark, sf), CORE)
    p = sp.purged_split_points(f, 0.2, 0.1, 30)
    return report(spark.createDataFrame([(p["test_start"], p["calib_start"])],
                                        "test_start timestamp_ntz, calib_start timestamp_ntz"))


@register("m01_purged_split")
def m01(spark, sf):
    return report(sp.purged_temporal_split(_ft(dom(spark, sf), CORE), 0.2, 0.1, 30).select("order_id", "seller_id", "block"))


@register("m02_chronological_split")
def m02(spark, sf):
    return report(sp.chronological_split(_ft(dom(spark, sf), CORE), 0.2, 0).select("order_id", "seller_id", "block"))


@register("m03_forward_folds")
def m03(spark, sf):
    return report(sp.forward_folds(_ft(dom(spark, sf), CORE), 3).select("order_id", "seller_id", "row_idx", "test_fold"))


@register("u03_blocks_disjoint")
def u03(spark, sf):
    b = sp.purged_temporal_split(_ft(dom(spark, sf), CORE), 0.2, 0.1, 30)
    return report(sp.blocks_disjoint(b, ["order_id", "seller_id"]))


@register("k08_recent_rows")
def k08(spark, sf):
    f = _ft(dom(spark, sf), CORE)
    return report(f.orderBy(F.desc("as_of_date"), F.desc("_rid")).limit(80000).select("order_id", "seller_id"))


def _split(d):
    return sp.purged_temporal_split(_ft(d), 0.2, 0.1, 30)


@register("m04_numeric_prep")
def m04(spark, sf):
    b = _split(dom(spark, sf))
    fit = pp.fit_numeric(b.filter(F.col("block") == "train"), NUM_COLS)
    return report(pp.apply_numeric(b, fit).select("order_id", "seller_id", *NUM_COLS))


@register("m05_one_hot_long")
def m05(spark, sf):
    b = _split(dom(spark, sf))
    fit = pp.fit_categorical(b.filter(F.col("block") == "train"), ["category", "customer_state", "seller_state"])
    return report(pp.one_hot_long(b, fit))


@register("m07_class_weights")
def m07(spark, sf):
    b = _split(dom(spark, sf))
    return report(pp.class_weights(b.filter(F.col("block") == "train"), TARGET))


def _drift(d):
    f = sp.reference_current_split(_ft(d))
    return dr.drift_distances(f, NUM_COLS)


@register("d01_reference_current_split")
def d01(spark, sf):
    f = sp.reference_current_split(_ft(dom(spark, sf), CORE))
    return report(f.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.min("as_of_date").alias("first"),
                                          F.max("as_of_date").alias("last")))


@register("d02_drift_distances")
def d02(spark, sf):
    return report(_drift(dom(spark, sf)))


@register("d03_d04_drift_summary")
def d03(spark, sf):
    return report(dr.summarize_drift(_drift(dom(spark, sf))))


@register("e16_calibration_report")
def e16(spark, sf):
    """Brier, ECE and means before/after a fixed monotone recalibration."""
    s = _scores(dom(spark, sf)).withColumn("cal", F.col("score") * F.col("score"))
    raw = me.threshold_metrics(s, 0.5).select(F.col("brier").alias("brier_raw"), "base_rate")
    cal = me.threshold_metrics(s, 0.5, score="cal").select(F.col("brier").alias("brier_cal"))
    er = me.expected_calibration_error(s).select(F.col("ece").alias("ece_raw"))
    ec = me.expected_calibration_error(s, score="cal").select(F.col("ece").alias("ece_cal"))
    mn = s.agg(F.avg("score").alias("mean_raw"), F.avg("cal").alias("mean_cal"))
    return report(raw.crossJoin(cal).crossJoin(er).crossJoin(ec).crossJoin(mn))


@register("d02_population_stability")
def d02p(spark, sf):
    f = sp.reference_current_split(_ft(dom(spark, sf)))
    return report(dr.population_stability(f, NUM_COLS))
