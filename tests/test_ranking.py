"""Distributed exact ranks / quantiles vs brute force (hot ties included)."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from slipway.plans.ranking import quantile_nearest_value, quantile_values, row_numbers


def _frame(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    score = rng.integers(0, 200, n).astype(float) / 7.0
    score[: n // 3] = 5.0  # a third of all rows on one score
    ids = rng.permutation(n) * 3 + 11
    return pd.DataFrame({"id": ids, "score": score}), spark.createDataFrame(pd.DataFrame({"id": ids, "score": score}))


def test_row_numbers_exact(spark):
    pdf, df = _frame(spark)
    got = row_numbers(df, "score", "id", desc=True, block=64).toPandas().sort_values("rn")
    exp = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
    assert list(got["id"]) == list(exp["id"])
    assert list(got["rn"]) == list(range(1, len(pdf) + 1))


def test_row_numbers_grouped(spark):
    pdf, df = _frame(spark)
    pdf["g"] = pdf["id"] % 3
    df = spark.createDataFrame(pdf)
    got = row_numbers(df, "score", "id", desc=False, part=["g"], block=64).toPandas()
    for g, sub in pdf.groupby("g"):
        exp = sub.sort_values(["score", "id"]).reset_index(drop=True)
        mine = got[got.g == g].sort_values("rn")
        assert list(mine["id"]) == list(exp["id"])


def test_quantiles_match_numpy(spark):
    pdf, df = _frame(spark)
    qs = [0.01, 0.25, 0.5, 0.8, 0.95, 0.99]
    got = quantile_values(df, "score", qs)
    assert np.allclose(got, np.quantile(pdf["score"], qs), atol=1e-12)


def test_nearest_quantile_rule(spark):
    # nearest quantile 0.8 of 6, 11, 13, 16 dates -> 5th, 9th, 11th, 13th
    for n, k in [(6, 5), (11, 9), (13, 11), (16, 13)]:
        df = spark.range(1, n + 1).select(F.col("id").cast("double").alias("v"))
        assert quantile_nearest_value(df, "v", 0.8) == k


def test_one_score_is_spread_over_tasks_whatever_the_ids(spark):
    """A constant score, string ids: as many tasks as blocks, none with many more rows than another."""
    ids = [f"k{(i * 7919) % 4001:05d}-{i % 3}" for i in range(4000)]
    df = spark.createDataFrame([(i, 1.0, i[-1]) for i in ids], "id string, score double, g string")
    ranked = row_numbers(df, "score", "id", block=500)
    got = ranked.toPandas().sort_values("rn")
    assert list(got["id"]) == sorted(ids) and list(got["rn"]) == list(range(1, 4001))
    per_task = [r["n"] for r in ranked.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(per_task) == 8 and max(per_task) < 1000
    grouped = row_numbers(df, "score", "id", desc=False, part=["g"], block=500).toPandas()
    for g, sub in grouped.groupby("g"):
        assert list(sub.sort_values("rn")["id"]) == sorted(i for i in ids if i[-1] == g)


def test_structs_and_null_scores(spark):
    df = spark.createDataFrame([((2, "b"), None), ((1, "z"), 0.5), ((1, "a"), 0.5), ((3, "c"), 0.9)], "id struct<a:int,b:string>, score double")
    for desc, want in ((True, ["c", "a", "z", "b"]), (False, ["a", "z", "c", "b"])):
        got = row_numbers(df, "score", "id", desc=desc).orderBy("rn").collect()
        assert [r["id"]["b"] for r in got] == want and [r["rn"] for r in got] == [1, 2, 3, 4]
    assert row_numbers(df.limit(0), "score", "id").count() == 0
    assert row_numbers(df.withColumn("g", F.lit(1)).limit(0), "score", "id", part=["g"]).count() == 0
