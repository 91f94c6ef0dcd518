"""Forest and logistic regression fitted over all rows, folds of the stack, starts of SMOTE."""
import datetime as dt

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from slipway.operators import boosting as gb
from slipway.operators import forest as fr
from slipway.operators import logistic as lg
from slipway.operators import models as md
from slipway.operators import oversample as ov
from slipway.operators import prep as pp
from slipway.operators import split as sp
from slipway.operators import treeshap as ts


def rows(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=(n, 3)), rng.integers(0, 2, n), np.full(n, 2.0)])
    y = (rng.random(n) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] ** 2 + x[:, 3])))).astype(int)
    day = dt.datetime(2020, 1, 1)
    df = spark.createDataFrame([(i, [float(v) for v in r], int(t), day + dt.timedelta(hours=i // 3)) for i, (r, t) in enumerate(zip(x, y))],
                               "_rid long, x array<double>, y int, as_of_date timestamp")
    return x, y, df.withColumn("features", array_to_vector("x")).drop("x").repartition(5)


def test_forest_over_all_rows(spark, tmp_path):
    """A node's weight is that of its two children, the root's that of all rows; nodes of a level lie in two groups."""
    x, y, df = rows(spark)
    m = fr.fit(df, "y", (1.0, 2.5), 3, 9, 7)
    assert m.feature.shape == (3, 2 ** 9 - 1) and 2 ** 8 > fr.NODES and m.numFeatures == 5
    w = np.where(y == 1, 2.5, 1.0)
    assert len(m.cuts[4]) == 1 and len(m.cuts[0]) > 25 and not (m.feature == 4).any()  # a constant column is never cut
    assert m.cover[:, 0] == pytest.approx(np.full(3, w.sum()), rel=0.1)  # as many drawn as there are
    for tree in m.as_nodes():
        inner = tree["left"] >= 0
        assert inner.sum() > 100
        assert np.allclose(tree["cover"][inner], tree["cover"][tree["left"][inner]] + tree["cover"][tree["right"][inner]])
    got = np.array([r["score"] for r in md.score(m, df).orderBy("_rid").collect()])
    assert np.allclose(got, m.margin(gb.to_bins(x, m.cuts))) and gb.roc_auc(y, got) > 0.85
    m.save(str(tmp_path / "m"))
    assert np.array_equal(md.load_model("random_forest", str(tmp_path / "m")).leaf, m.leaf)


def test_best_cut_of_a_level(spark):
    rng = np.random.default_rng(0)
    hist = rng.integers(0, 5, (2, 1, fr.BINS, 2)).astype(np.int32)  # places, nodes, bins, classes
    halves = [hist // 2, hist - hist // 2]  # from two tasks
    df = spark.createDataFrame([(0, 0, bytearray(h.tobytes())) for h in halves], "tree int, part int, counts binary")
    r = fr._cuts_of_level(df, (1.0, 3.0), 1, 2)[0]
    w = hist[:, 0] * np.array([1.0, 3.0])

    def impurity(c):
        return 2 * c[0] * c[1] / c.sum() if c.sum() else 0.0

    want = min(((impurity(w[i, :b + 1].sum(0)) + impurity(w[i, b + 1:].sum(0)), i, b) for i in range(2) for b in range(fr.BINS - 1)))
    assert (np.frombuffer(r["place"], np.int32)[0], np.frombuffer(r["bin"], np.uint8)[0]) == want[1:]


def test_forest_attributions_add_up(spark):
    _, _, df = rows(spark, 600)
    m = md.fit_forest(df, "y", 6, 4)
    att = ts.explain(df, m, "forest", list("abcde"), keys=("_rid",)).groupBy("_rid").agg(F.sum("contribution").alias("s"))
    gap = att.join(ts.margin(df, m, "forest"), "_rid").agg(F.max(F.abs(F.col("s") - F.col("output"))), F.count("*")).first()
    assert gap[0] < 1e-9 and gap[1] == 600


def test_forest_sends_no_more_for_more_rows(spark):
    """The counts of a task are of one size, however many rows it has."""
    for n in (400, 4000):
        _, _, df = rows(spark, n)
        blocks = fr._blocks(df.coalesce(1), "y", [np.arange(3.0)] * 5)
        got = fr._counts(blocks, 5, 1, 0, np.full((2, 1), -1, np.int32), np.zeros((2, 1), np.uint8), np.zeros((2, 1, 2), np.int32)).collect()
        assert [len(r["counts"]) for r in got] == [2 * fr.BINS * 2 * 4] * 2


@pytest.mark.parametrize("start", [100, 10 ** 6])
def test_logistic_is_the_optimum_of_all_rows(spark, monkeypatch, tmp_path, start):
    _, _, df = rows(spark)
    monkeypatch.setattr(lg, "START_ROWS", start)
    passes, one = [], lg._pass
    monkeypatch.setattr(lg, "_pass", lambda r, *a: passes.append(r) or one(r, *a))
    m = md.fit_logistic(df, "y")
    t = pp.with_weights(df, "y", "weight")
    sw = t.agg(F.sum("weight")).first()[0]
    want = LogisticRegression(labelCol="y", weightCol="weight", maxIter=1000, tol=1e-12, regParam=1.0 / sw, elasticNetParam=0.0,
                              standardization=False).fit(t)
    assert np.allclose(m.coefficients.toArray(), want.coefficients.toArray(), atol=1e-4) and abs(m.intercept - want.intercept) < 1e-4
    assert len(passes) < 20  # Spark's own fit reads the rows once an iteration
    md.save_model(m, str(tmp_path / "m"))
    back = md.load_model("logistic_regression", str(tmp_path / "m"))
    assert np.array_equal(back.coefficients.toArray(), m.coefficients.toArray()) and back.intercept == m.intercept


def test_fold_starts_are_the_folds(spark):
    _, _, df = rows(spark, 101)
    want = {(r["_rid"], r["test_fold"]) for r in sp.forward_folds(df, 3).collect()}
    before = sp.fold_starts(df, 3)
    got = set()
    for r in df.select("_rid", *[before[i].alias(f"b{i}") for i in (1, 2, 3)]).collect():
        got.add((r["_rid"], None if r["b1"] else 1 if r["b2"] else 2 if r["b3"] else 3))
    assert got == want


def test_some_columns_of_a_preparation(spark):
    df = spark.createDataFrame([(float(i % 7), None if i % 5 == 0 else i * 0.5, "ab"[i % 2], 0) for i in range(40)], "a double, b double, c string, y int")
    one, all_ = md.fit_prep(df.select("b", "c", "y"), "y"), md.fit_prep(df, "y").only(["b", "c"])
    assert (one.num_fit, one.cat_fit, one.names) == (all_.num_fit, all_.cat_fit, all_.names)


def test_smote_and_undated_rows_are_chosen_without_a_limit_per_task(spark, monkeypatch):
    used = []
    for mod in (ov, gb):
        first = mod.first_rows
        monkeypatch.setattr(mod, "first_rows", lambda df, key, n, rest, desc=False, f=first: used.append(n) or f(df, key, n, rest, desc))
    _, _, df = rows(spark, 900)
    out = ov.smote(df, "y", minority_rows=30)
    hashed = df.filter("y = 1") if df.filter("y = 1").count() < df.filter("y = 0").count() else df.filter("y = 0")
    want = {r[0] for r in hashed.orderBy(F.xxhash64("_rid"), "_rid").limit(30).collect()}
    assert {r["_rid"] for r in out.filter("synthetic = 1").select("_rid").distinct().collect()} <= want
    plain = df.drop("as_of_date")
    want = {r[0] for r in plain.orderBy(F.xxhash64("_rid", "y")).limit(50).collect()}
    assert {r["_rid"] for r in gb.recent_rows(plain, 50).collect()} == want
    assert used == [30, 50]
