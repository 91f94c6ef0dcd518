"""Model smoke/property tests (reference test_models, isotonic ECE test)."""
import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from slipway.operators import metrics as me
from slipway.operators import models as md


def _data(spark, n=1500, seed=3):
    rng = np.random.default_rng(seed)
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    p = 1 / (1 + np.exp(-(1.5 * x1 - x2 - 1.5)))
    y = (rng.random(n) < p).astype(int)
    pdf = pd.DataFrame({"id": np.arange(n), "x1": x1, "x2": x2, "y": y})
    df = spark.createDataFrame(pdf)
    return VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(df)


def test_logistic_probabilities_and_lift(spark):
    df = _data(spark)
    m = md.fit_logistic(df, "y")
    s = md.score(m, df)
    mn, mx = s.agg(F.min("score"), F.max("score")).first()
    assert 0 <= mn <= mx <= 1
    auc = me.ranking_metrics(s).first()["roc_auc"]
    assert auc > 0.7


def test_forest_smoke(spark):
    df = _data(spark)
    s = md.score(md.fit_forest(df, "y", trees=10, depth=4), df)
    assert s.filter((F.col("score") < 0) | (F.col("score") > 1)).count() == 0


def test_isotonic_lowers_ece(spark):
    rng = np.random.default_rng(3)
    p_true = rng.beta(2, 8, 8000)
    y = (rng.random(8000) < p_true).astype(int)
    raw = np.clip(p_true * 2.5, 0, 1)              # inflated probabilities
    pdf = pd.DataFrame({"id": np.arange(8000), "y": y, "score": raw})
    df = spark.createDataFrame(pdf)
    iso = md.fit_isotonic(df, "y")
    cal = iso.transform(df.withColumn("y", F.col("y").cast("double")))
    before = me.expected_calibration_error(df).first()["ece"]
    after = me.expected_calibration_error(cal, score="calibrated").first()["ece"]
    assert after < before


def test_model_queries_run_the_surveyed_space_bases_and_stages(spark, monkeypatch, tmp_path):
    from types import SimpleNamespace
    from slipway.operators import tuning as tu
    from slipway.plans import q_models as qm
    from slipway.plans import training as tg
    df = (_data(spark, 400).withColumnRenamed("y", qm.TARGET).withColumnRenamed("id", "_rid")
          .withColumn("as_of_date", F.expr("date_add(date'2020-01-01', cast(_rid as int))"))
          .withColumn("block", F.when(F.col("_rid") < 300, "train").otherwise("test")))
    x, prep = df.cache(), SimpleNamespace(names=["x1", "x2"])
    calls = []
    search, boost, forest = tu.random_search, md.fit_boosting, md.fit_forest
    monkeypatch.setattr(qm, "_blocks", lambda d: (x, prep))
    monkeypatch.setattr(qm, "dom", lambda *a: None)
    monkeypatch.setattr(qm, "stored_features", lambda d: None)
    monkeypatch.setattr(tg, "prepare_data", lambda *a: (x, prep))
    monkeypatch.setattr(tu, "GBT_SPACE", {**tu.GBT_SPACE, "maxIter": ("int", 1, 2), "maxDepth": ("int", 2, 2)})
    monkeypatch.setattr(md, "fit_boosting", lambda d, t: calls.append("boosting") or boost(d, t, 2, 2))
    monkeypatch.setattr(md, "fit_forest", lambda d, t, *size: calls.append(("forest", *size)) or forest(d, t, 3, 2))

    def searched(train, target, kind="boosting", n_trials=25, n_folds=3):
        calls.append((kind, n_trials, n_folds))
        return search(train, target, kind, 1, 2)

    monkeypatch.setattr(tu, "random_search", searched)
    qm.m12(spark, "").collect()
    assert calls == [("boosting", 25, 3)]
    calls.clear()
    assert [r["stage"] for r in qm.m14(spark, "").collect()] == ["logistic_regression", "random_forest", "boosting", "ensemble"]
    assert ("boosting", 25, 3) in calls and ("forest",) in calls and ("forest", 60, 8) in calls
    calls.clear()
    qm.m13(spark, "").collect()
    assert calls.count("boosting") == 4
    got = qm.e17(spark, "").collect()
    assert {r["model"] for r in got} == {"logistic_regression", "random_forest", "boosting", "ensemble"}
