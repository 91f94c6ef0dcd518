"""Correlation matrix, payloads, refusals, screening forests, prompts."""
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slipway.operators import gram, labels, payloads, refusals
from slipway.operators import text as tx


def test_correlation_matrix_against_pandas(spark, monkeypatch):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.normal(size=(500, 3)), columns=["a", "b", "c"])
    pdf["d"] = pdf["a"] * 2 + 1e6  # a large offset
    pdf["same"] = 4.0
    pdf.loc[pdf.index % 3 == 0, "b"] = None
    pdf.loc[pdf.index > 0, "c"] = None  # a single value
    pdf["none"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double, d double, same double, none double")
    want = pdf.corr(min_periods=2)
    for parts in (1, 70):  # more tasks than buckets as well
        got = {(r["a"], r["b"]): r for r in gram.correlation_matrix(df.repartition(parts), list(pdf.columns)).collect()}
        assert len(got) == 36
        for (a, b), r in got.items():
            assert r["n"] == (pdf[a].notna() & pdf[b].notna()).sum()
            w = want.loc[a, b]
            assert (r["r"] is None) if np.isnan(w) else abs(r["r"] - w) < 1e-9
    assert gram.correlation_matrix(df.limit(0), ["a", "b"]).count() == 0


def test_news_payloads(spark):
    good = json.dumps({"status": "ok", "articles": [{"title": "t", "description": None, "publishedAt": "2024-01-01", "source": {"name": "n", "id": 4}},
                                                    {"title": "u"}]})
    raw = spark.createDataFrame([(1, good), (2, good[:-9]), (3, '{"articles": []}'), (4, "{}"), (5, None), (6, "[1]"), (7, "oops")],
                                "payload_id int, payload string")
    rows = payloads.parse_news(raw).orderBy("payload_id", "place").collect()
    ok = [(r["payload_id"], r["place"], r["title"], r["description"], r["published_at"], r["source"]) for r in rows if r["bad"] is None]
    assert ok == [(1, 0, "t", None, "2024-01-01", "n"), (1, 1, "u", None, None, None)]
    assert [(r["payload_id"], r["bad"]) for r in rows if r["bad"] is not None and r["payload_id"] in (2, 7)] == [(2, good[:-9]), (7, "oops")]
    assert {r["payload_id"] for r in rows} <= {1, 2, 6, 7}


def test_weather_and_observations(spark):
    raw = spark.createDataFrame([(1, '{"weather": [{"main": "Rain"}, {"main": "Fog"}], "wind": {"speed": 3.5}}'), (2, '{"weather": []}'),
                                 (3, '{"wind": {"speed": 1}}'), (4, "<html>"), (5, None)], "payload_id int, payload string")
    raw = raw.withColumn("fetched_at", F.lit("2024-05-06 07:08:09").cast("timestamp"))
    got = {r["payload_id"]: r for r in payloads.parse_weather(raw).collect()}
    assert len(got) == 5 and (got[1]["condition"], got[1]["wind_speed"], str(got[1]["fetched_at"])) == ("Rain", 3.5, "2024-05-06")
    assert got[2]["condition"] is None and got[3]["wind_speed"] == 1.0 and got[4]["bad"] == "<html>" and got[5]["bad"] is None
    obs = spark.createDataFrame([(1, '{"observations": [{"date": "2024-01-01", "value": "."}]}'), (2, "{")], "payload_id int, payload string")
    assert sorted(map(tuple, payloads.parse_observations(obs).collect())) == [(1, "2024-01-01", ".", None), (2, None, None, "{")]


def test_realign_refuses(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    scores = spark.createDataFrame([(1, 0.5), (2, 0.25), (3, 0.1)], "id int, score double")
    assert sorted(map(tuple, refusals.realign(rows, scores, ["id"]).collect())) == [(1, "x", 0.5), (2, "y", 0.25)]
    for bad in (scores.filter("id != 2"), scores.unionByName(scores.filter("id = 2")), scores.withColumn("score", F.when(F.col("id") != 2, F.col("score")))):
        with pytest.raises(Exception, match="no single score"):
            refusals.realign(rows, bad, ["id"]).collect()


def test_comparison_refuses(spark):
    rows = [(m, i, int(i % 4 == 0), ((i * k) % 17) / 17) for m, k in (("a", 3), ("b", 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "model string, id long, y int, score double")
    got = {r["model"]: r for r in refusals.compare_models(df).collect()}
    assert set(got) == {"a", "b"} and abs(got["a"]["pr_auc_lift"] - got["a"]["pr_auc"] / 0.25) < 1e-9
    fewer = df.filter("not (model = 'b' and id = 7)")
    other = df.withColumn("id", F.when((F.col("model") == "b") & (F.col("id") == 7), F.lit(999)).otherwise(F.col("id")))
    twice = fewer.unionByName(df.filter("model = 'b' and id = 8"))  # as many rows, one of them twice
    for bad in (fewer, other, twice):
        with pytest.raises(Exception, match="different rows"):
            refusals.compare_models(bad).collect()


def test_screening_forests_find_the_feature(spark):
    n = 900
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"seller_id": np.arange(n) % 30, "as_of_date": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) // 3, "D"),
                        "order_count_7d": rng.integers(0, 9, n), "late_rate_7d": rng.random(n), "forward_rate": rng.random(n)})
    pdf["y"] = (pdf["late_rate_7d"] + rng.normal(scale=0.1, size=n) > 0.6).astype(int)
    df = spark.createDataFrame(pdf).withColumn("late_rate_7d", F.when(F.col("seller_id") != 3, F.col("late_rate_7d")))
    busy = df.withColumn("y", (F.col("order_count_7d") > 4).cast("int"))
    got = {r["candidate"]: r for r in labels.screening_aucs(df, {"late": df, "busy": busy, "few": df.limit(20), "one": df.withColumn("y", F.lit(1))},
                                                           min_rows=100, min_test=50, trees=20, depth=4, embargo_days=5).collect()}
    assert set(got) == {"late", "busy"}
    assert got["late"]["volume_roc"] < 0.65 < 0.9 < got["late"]["novol_roc"] and got["late"]["full_pr_lift"] > 1.5
    assert got["busy"]["volume_roc"] > 0.95 and got["busy"]["novol_roc"] < 0.65


def test_prompts(spark):
    hits = spark.createDataFrame([(1, 10, 2), (1, 11, 1)], "query_id int, vec_id int, rank int")
    texts = spark.createDataFrame([(10, "ten"), (11, "eleven")], "vec_id int, text string")
    asked = spark.createDataFrame([(1, "Why?"), (2, "Who?")], "query_id int, question string")
    got = {r["query_id"]: r for r in tx.grounded_prompts(hits, texts, "vec_id", asked).collect()}
    assert got[1]["prompt"].endswith("Context:\n- eleven\n\n- ten\n\nQuestion: Why?") and got[1]["n_sources"] == 2
    assert got[2]["prompt"] == tx.NOTHING and (got[2]["n_sources"], got[2]["grounded"]) == (0, 0)
