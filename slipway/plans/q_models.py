"""Queries on fitted models (rows-checked: fits are not bit-comparable
across engines; tests assert their properties)."""

from __future__ import annotations

from pyspark.sql import functions as F

from slipway.operators import metrics as me
from slipway.operators import models as md
from slipway.operators import rollup as ru
from slipway.operators import split as sp
from slipway.operators.order_features import TARGET
from slipway.plans.queries import dom, register, report
from slipway.plans.stored import stored_features
from slipway.session import cut_lineage


def _blocks(d):
    f = stored_features(d)
    b = sp.purged_temporal_split(f, 0.2, 0.1, 30)
    prep = md.fit_prep(b.filter(F.col("block") == "train"), TARGET)
    x = cut_lineage(prep.transform(b.filter(F.col("block").isNotNull()), keep=("order_id", "seller_id", "as_of_date", "block", "_rid")))
    return x, prep


def _bases():
    """Models inside the stack; its forest is the light one."""
    return {"logistic_regression": md.fit_logistic, "random_forest": lambda d, t: md.fit_forest(d, t, 60, 8),
            "boosting": md.fit_boosting}


def _eval(scored):
    s = scored.withColumnRenamed(TARGET, "y").withColumnRenamed("_rid", "id")
    return me.ranking_metrics(s).crossJoin(me.threshold_metrics(s, 0.5))


@register("m09_logistic_regression")
def m09(spark, sf):
    x, _ = _blocks(dom(spark, sf))
    m = md.fit_logistic(x.filter(F.col("block") == "train"), TARGET)
    return report(_eval(md.score(m, x.filter(F.col("block") == "test"))))


@register("m10_random_forest")
def m10(spark, sf):
    x, _ = _blocks(dom(spark, sf))
    m = md.fit_forest(x.filter(F.col("block") == "train"), TARGET)
    return report(_eval(md.score(m, x.filter(F.col("block") == "test"))))


@register("m11_gradient_boosting")
def m11(spark, sf):
    x, _ = _blocks(dom(spark, sf))
    m = md.fit_boosting(x.filter(F.col("block") == "train"), TARGET)
    return report(_eval(md.score(m, x.filter(F.col("block") == "test"))))


@register("m11_boosting_oversampled")
def m11s(spark, sf):
    """M11, second variant: plain boosted trees (no class weight) on the train block with SMOTE rows."""
    from slipway.operators import boosting as gb
    from slipway.plans.training import oversampled
    x, _ = _blocks(dom(spark, sf))
    m = gb.fit(oversampled(x, TARGET), TARGET, pos_weight=1.0)
    return report(_eval(md.score(m, x.filter(F.col("block") == "test"))))


@register("m08_smote_counts")
def m08(spark, sf):
    """Rows and new rows per class of the oversampled train block."""
    from slipway.plans.training import oversampled
    x, _ = _blocks(dom(spark, sf))
    return report(oversampled(x, TARGET).groupBy(F.col(TARGET).cast("int").alias("label")).agg(
        F.count("*").alias("n_rows"), F.sum(F.col("synthetic").cast("long")).alias("n_synthetic")))


@register("s20_artifact_roundtrip")
def s20(spark, sf):
    """Preparation, model and calibrator saved, loaded and applied: rows scored and rows that differ."""
    import uuid
    from slipway.operators.isotonic import IsotonicFit
    from slipway.session import ensure_checkpoint_dir
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/artifacts/{uuid.uuid4().hex}"
    b = sp.purged_temporal_split(stored_features(dom(spark, sf)), 0.2, 0.1, 30)
    prep = md.fit_prep(b.filter(F.col("block") == "train"), TARGET)
    x = cut_lineage(prep.transform(b.filter(F.col("block").isNotNull()), keep=("order_id", "seller_id", "block", "_rid")))
    model = md.fit_logistic(x.filter(F.col("block") == "train"), TARGET)
    cal = md.fit_isotonic(md.score(model, x.filter(F.col("block") == "calib")), TARGET)
    prep.save(f"{root}/prep"), md.save_model(model, f"{root}/model"), cal.save(f"{root}/calibrator")

    def scored(p, m, c):
        t = p.transform(b.filter(F.col("block") == "test"), keep=("_rid",))
        return c.transform(md.score(m, t)).select("_rid", "score", "calibrated")

    one = scored(prep, model, cal)
    two = scored(md.Prepared.load(f"{root}/prep"), md.load_model("logistic_regression", f"{root}/model"),
                 IsotonicFit.load(f"{root}/calibrator")).select("_rid", F.col("score").alias("s2"), F.col("calibrated").alias("c2"))
    same = F.col("score").eqNullSafe(F.col("s2")) & F.col("calibrated").eqNullSafe(F.col("c2"))
    return report(one.join(two, "_rid", "left").agg(F.count("*").alias("n_rows"), F.count_if(~same).alias("n_different")))


@register("e14_isotonic_calibration")
def e14(spark, sf):
    x, _ = _blocks(dom(spark, sf))
    m = md.fit_logistic(x.filter(F.col("block") == "train"), TARGET)
    s = cut_lineage(md.score(m, x.filter(F.col("block").isin("calib", "test"))).drop("features"))  # read by every figure
    iso = md.fit_isotonic(s.filter(F.col("block") == "calib"), TARGET)
    t = iso.transform(s.filter(F.col("block") == "test")).withColumnRenamed(TARGET, "y").withColumnRenamed("_rid", "id")
    raw = me.threshold_metrics(t, 0.5).select(F.col("brier").alias("brier_raw"))
    cal = me.threshold_metrics(t, 0.5, score="calibrated").select(F.col("brier").alias("brier_cal"))
    e1 = me.expected_calibration_error(t).select(F.col("ece").alias("ece_raw"))
    e2 = me.expected_calibration_error(t, score="calibrated").select(F.col("ece").alias("ece_cal"))
    mn = t.agg(F.avg("score").alias("mean_raw"), F.avg("calibrated").alias("mean_cal"),
               F.avg(F.col("y").cast("double")).alias("observed"))
    return report(raw.crossJoin(cal).crossJoin(e1).crossJoin(e2).crossJoin(mn))


@register("e17_block_scoring_comparison")
def e17(spark, sf):
    """Every model scored on the same test rows -> per-model metrics."""
    x, _ = _blocks(dom(spark, sf))
    tr, te = x.filter(F.col("block") == "train"), x.filter(F.col("block") == "test")
    models = {"logistic_regression": md.fit_logistic(tr, TARGET), "random_forest": md.fit_forest(tr, TARGET),
              "boosting": md.fit_boosting(tr, TARGET), "ensemble": md.fit_stacking(tr, TARGET, _bases(), 3)}
    long = None
    for name, m in models.items():
        s = md.score(m, te).select(F.lit(name).alias("model"), F.col("_rid").alias("id"), F.col(TARGET).alias("y"), "score")
        long = s if long is None else long.unionByName(s)
    from slipway.operators.refusals import same_rows
    long = same_rows(cut_lineage(long))
    r = me.ranking_metrics(long, part=["model"])
    c = me.top_k_capture(long, (0.10,), part=["model"]).select("model", F.col("capture").alias("capture_at_10pct"))
    n = long.groupBy("model").agg((F.count("score") / F.lit(te.count())).alias("coverage"))  # of the block's rows
    return report(r.join(c, "model").join(n, "model").orderBy(F.desc("pr_auc")))


@register("x01_fitted_publish")
def x01f(spark, sf):
    """X01 with a fitted scorer: trailing 90 days -> LR score -> isotonic
    calibration per order -> seller means -> bands on raw means."""
    x, _ = _blocks(dom(spark, sf))
    m = md.fit_logistic(x.filter(F.col("block") == "train"), TARGET)
    iso = md.fit_isotonic(md.score(m, x.filter(F.col("block") == "calib")), TARGET)
    from slipway.operators.order_features import trailing_window
    recent = trailing_window(x, 90)
    scored = iso.transform(md.score(m, recent)).select("seller_id", F.col("score").alias("raw"), "calibrated")
    out = ru.seller_rollup(scored, min_orders=5)
    return report(out.withColumn("model_name", F.lit("logistic_regression")))


@register("m13_temporal_stacking")
def m13(spark, sf):
    """Stacked LR + forest (60 trees x depth 8 inside the stack) + boosted
    trees on the train block, scored on the test block."""
    x, _ = _blocks(dom(spark, sf))
    tr, te = x.filter(F.col("block") == "train"), x.filter(F.col("block") == "test")
    st = md.fit_stacking(tr, TARGET, _bases(), 3)
    return report(_eval(st.transform_scores(te)))


@register("e15_platt_calibration")
def e15(spark, sf):
    x, _ = _blocks(dom(spark, sf))
    m = md.fit_logistic(x.filter(F.col("block") == "train"), TARGET)
    s = cut_lineage(md.score(m, x.filter(F.col("block").isin("calib", "test"))).drop("features"))  # read by every figure
    pl = md.fit_platt(s.filter(F.col("block") == "calib"), TARGET)
    t = md.apply_platt(pl, s.filter(F.col("block") == "test")).withColumnRenamed(TARGET, "y").withColumnRenamed("_rid", "id")
    raw = me.threshold_metrics(t, 0.5).select(F.col("brier").alias("brier_raw"))
    cal = me.threshold_metrics(t, 0.5, score="calibrated").select(F.col("brier").alias("brier_cal"))
    r1 = me.ranking_metrics(t).select(F.col("roc_auc").alias("auc_raw"))
    r2 = me.ranking_metrics(t, score="calibrated").select(F.col("roc_auc").alias("auc_cal"))
    return report(raw.crossJoin(cal).crossJoin(r1).crossJoin(r2))


# Feature groups of the ablation (name prefixes).
PROMISE_FEATURES = ("promised_days", "shipping_limit_days", "handover_share")


@register("u04_e20_feature_group_ablation")
def u04(spark, sf):
    """E20 model variants: promise group only vs all-but-promise vs all
    features (U04: column-set difference on the schema), same boosted trees, same rows."""
    d = dom(spark, sf)
    f = stored_features(d)
    b = sp.purged_temporal_split(f, 0.2, 0.1, 30).filter(F.col("block").isin("train", "test"))
    from slipway.operators.prep import feature_columns
    num, cat = feature_columns(b, TARGET, extra_exclude=["_rid"])
    allc = num + cat
    groups = {"promise_only": [c for c in allc if c.startswith(PROMISE_FEATURES)],
              "without_promise": [c for c in allc if not c.startswith(PROMISE_FEATURES)],
              "all_features": allc}
    fitted = md.fit_prep(b.filter(F.col("block") == "train"), TARGET)  # a column's fit is the same in every variant
    out = []
    for name, cols in groups.items():
        xx = fitted.only(cols).transform(b, keep=("block", "_rid"))
        m = md.fit_boosting(xx.filter(F.col("block") == "train"), TARGET)
        s = md.score(m, xx.filter(F.col("block") == "test"))
        s = cut_lineage(s.withColumnRenamed(TARGET, "y").withColumnRenamed("_rid", "id"))
        r = me.ranking_metrics(s).first()
        c = me.top_k_capture(s, (0.10,)).first()
        out.append((name, len(cols), float(r["pr_auc"]), float(r["roc_auc"]), float(r["ks_statistic"]), float(c["capture"])))
    return report(spark.createDataFrame(out, "variant string, n_columns int, pr_auc double, roc_auc double, "
                                             "ks_statistic double, capture_at_10pct double"))


def _tree_attrib(d):
    from slipway.operators import treeshap as tsh
    from slipway.operators.order_features import trailing_window
    x, prep = _blocks(d)
    # the forest configuration used inside the stack (60 trees x depth 8)
    m = md.fit_forest(x.filter(F.col("block") == "train"), TARGET, 60, 8)
    recent = cut_lineage(trailing_window(x, 90))
    att = tsh.explain(recent, m, "forest", prep.names)
    return recent, m, att


@register("x04_tree_attribution")
def x04(spark, sf):
    """Per-order TreeSHAP on the recent window -> per-seller mean (A08) ->
    top-5 drivers by |contribution| (K03)."""
    from slipway.operators import explain as ex
    _, _, att = _tree_attrib(dom(spark, sf))
    seller = ex.seller_mean_attribution(att.filter(F.col("feature") != "__expected__"))
    top = ex.top_drivers(seller)
    return report(top.select("seller_id", F.posexplode("top_features").alias("rank", "f"))
                  .select("seller_id", (F.col("rank") + 1).alias("rank"), "f.feature", "f.contribution"))


@register("x04_additivity_check")
def x04a(spark, sf):
    """Sum of contributions + base value vs the forest probability, per row."""
    from slipway.operators import treeshap as tsh
    recent, m, att = _tree_attrib(dom(spark, sf))
    tot = att.groupBy("order_id", "seller_id").agg(F.sum("contribution").alias("s"))
    out = tsh.margin(recent, m, "forest").select("order_id", "seller_id", "output")
    j = tot.join(out, ["order_id", "seller_id"])
    return report(j.agg(F.count(F.lit(1)).alias("n_rows"),
                        F.count_if(F.abs(F.col("s") - F.col("output")) > 1e-9).alias("n_violations"),
                        F.max(F.abs(F.col("s") - F.col("output"))).alias("max_abs_gap")))


@register("m12_random_search")
def m12(spark, sf):
    """Random search (boosted trees, 25 trials) scored by mean AP over 3
    forward folds of the most recent 80 000 train rows."""
    from slipway.operators.tuning import random_search
    x, _ = _blocks(dom(spark, sf))
    return report(random_search(x.filter(F.col("block") == "train"), TARGET, "boosting", n_trials=25, n_folds=3))


@register("m14_stage_runner")
def m14(spark, sf):
    """M15 bundle -> M14 stages (LR, forest, tuned boosted trees, stack), each
    saved and reloaded (S20) and checked against the feature space (X08)."""
    from slipway.plans import training as tg
    f = stored_features(dom(spark, sf))
    x, prep = tg.prepare_data(f, TARGET)
    stages = tg.all_stages()
    out = tg.train_stages(x, prep, TARGET, list(stages), fitters=stages)
    return report(out.select("stage", "pr_auc", "roc_auc"))


@register("x05_kernel_attribution")
def x05(spark, sf):
    """Model-agnostic attribution (Kernel SHAP, 100 background train rows)
    of the logistic model on the recent window -> per-seller mean (A08) ->
    top-5 drivers by |contribution| (K03)."""
    from slipway.operators import explain as ex
    from slipway.operators import kernelshap as ks
    from slipway.operators.order_features import trailing_window
    x, prep = _blocks(dom(spark, sf))
    train = x.filter(F.col("block") == "train")
    m = md.fit_logistic(train, TARGET)
    recent = trailing_window(x, 90)
    att = ks.explain(recent, m, prep.names, ks.background_sample(train, "_rid"),
                     scorer=ks.logistic_scorer(m))
    seller = ex.seller_mean_attribution(att.filter(F.col("feature") != "__expected__"))
    top = ex.top_drivers(seller)
    return report(top.select("seller_id", F.posexplode("top_features").alias("rank", "f"))
                  .select("seller_id", (F.col("rank") + 1).alias("rank"), "f.feature", "f.contribution"))
