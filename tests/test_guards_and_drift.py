"""Leakage guard, feature-space check, PSI and Wasserstein vs brute force."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slipway.operators import drift as dr
from slipway.operators.order_features import leakage_guard


def test_leakage_guard_raises(spark):
    df = spark.createDataFrame([(1, 2.0, 1)], "order_id long, delay_days double, is_late_delivery int")
    with pytest.raises(ValueError):
        leakage_guard(df)
    ok = spark.createDataFrame([(1, 1)], "order_id long, is_late_delivery int")
    assert leakage_guard(ok) is ok
    fwd = spark.createDataFrame([(1, 0.3, 1)], "seller_id long, late_rate_next_30d double, high_late_rate_next_30d int")
    with pytest.raises(ValueError):
        leakage_guard(fwd, target="high_late_rate_next_30d", forward_marker="next")


def _frame(spark):
    rng = np.random.default_rng(4)
    a = np.round(rng.normal(size=600), 2)
    b = np.round(rng.normal(0.5, 1.2, size=400), 2)
    pdf = pd.DataFrame({"window": ["reference"] * 600 + ["current"] * 400, "x": np.concatenate([a, b])})
    return pdf, spark.createDataFrame(pdf)


def test_wasserstein_and_ks_brute(spark):
    pdf, df = _frame(spark)
    got = dr.drift_distances(df, ["x"]).first()
    a, b = pdf[pdf.window == "reference"].x.values, pdf[pdf.window == "current"].x.values
    grid = np.unique(np.concatenate([a, b]))
    fa = np.searchsorted(np.sort(a), grid, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), grid, side="right") / len(b)
    w1 = np.sum(np.abs(fa - fb)[:-1] * np.diff(grid))
    assert abs(got["wasserstein"] - w1 / a.std()) < 1e-9
    assert abs(got["ks"] - np.max(np.abs(fa - fb))) < 1e-12


def test_psi_brute(spark):
    pdf, df = _frame(spark)
    got = dr.population_stability(df, ["x"]).first()["psi"]
    a, b = pdf[pdf.window == "reference"].x.values, pdf[pdf.window == "current"].x.values
    edges = np.quantile(a, [i / 10 for i in range(1, 10)])
    ba = np.array([np.sum(edges < v) for v in a])
    bb = np.array([np.sum(edges < v) for v in b])
    pr = np.maximum(np.bincount(ba, minlength=10) / len(a), 1e-4)
    pc = np.maximum(np.bincount(bb, minlength=10) / len(b), 1e-4)
    assert abs(got - np.sum((pc - pr) * np.log(pc / pr))) < 1e-9
    assert F is not None
