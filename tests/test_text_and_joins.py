"""Chunking rule, as-of join vs brute force, dedupe on hot keys."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from slipway.operators import text
from slipway.operators.joins import asof_backward, dedupe_first
from slipway.operators.text import chunk_text
from slipway.plans.ranking import column_quantiles


def _chunks(spark, text, size, overlap):
    return spark.createDataFrame([(text,)], "text string").select(chunk_text("text", size, overlap)).first()[0]


def test_chunk_rules(spark):
    assert _chunks(spark, "short", 512, 50) == ["short"]
    c = _chunks(spark, "x" * 1010, 300, 50)
    assert len(c) == 5 and len(c[-1]) == 10          # starts 0, 250, 500, 750, 1000
    assert len(_chunks(spark, "A" * 1000, 300, 50)) == 4
    w = _chunks(spark, "word " * 200, 200, 20)
    assert "".join(x[:180] for x in w[:-1]) + w[-1] == "word " * 200


def test_asof_backward_brute_force(spark):
    rng = np.random.default_rng(2)
    L = pd.DataFrame({"lid": np.arange(400), "k": rng.integers(0, 3, 400),
                      "t": pd.to_datetime(rng.integers(0, 10 * 86400, 400), unit="s")})
    R = pd.DataFrame({"k": rng.integers(0, 3, 150), "rt": pd.to_datetime(rng.integers(0, 10 * 86400, 150), unit="s"),
                      "v": rng.random(150)})
    got = asof_backward(spark.createDataFrame(L), spark.createDataFrame(R), "k", "t", "rt", ["rt", "v"]).toPandas()
    got = got.set_index("lid").sort_index()
    for _, row in L.iterrows():
        cand = R[(R.k == row.k) & (R.rt <= row.t)]
        exp = None if cand.empty else cand.sort_values("rt").iloc[-1].v
        g = got.loc[row.lid, "v"]
        assert (exp is None and pd.isna(g)) or abs(exp - g) < 1e-12


def test_dedupe_first_hot_key(spark):
    rows = [(1, i, f"x{i}") for i in range(1000)] + [(2, 5, "b")]
    df = spark.createDataFrame(rows, "k long, o long, s string")
    out = {r["k"]: r["s"] for r in dedupe_first(df, ["k"], ["o"]).collect()}
    assert out == {1: "x0", 2: "b"}


def test_sequence_windows_blocks_and_halo(spark):
    import datetime as dt
    from slipway.operators.sequences import sequence_windows
    rows = []
    for i in range(300):  # one hot seller, plus a small one
        rows.append((i, 1, dt.datetime(2020, 1, 1) + dt.timedelta(hours=i // 2), float(i), None if i % 7 == 0 else 1.0))
    for i in range(5):
        rows.append((1000 + i, 2, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), float(-i), 2.0))
    df = spark.createDataFrame(rows, "order_id long, seller_id long, as_of_date timestamp, a double, b double")
    got = {r["order_id"]: r for r in sequence_windows(df, ["a", "b"], seq_len=4, block=8).collect()}
    pdf = pd.DataFrame(rows, columns=["order_id", "seller_id", "as_of_date", "a", "b"]).fillna(0.0)
    for sid, sub in pdf.groupby("seller_id"):
        sub = sub.sort_values(["as_of_date", "order_id"]).reset_index(drop=True)
        for i, r in sub.iterrows():
            prev = [[x.a, x.b] for x in sub.iloc[max(0, i - 4):i].itertuples()]
            exp = [[0.0, 0.0]] * (4 - len(prev)) + prev
            assert [list(v) for v in got[r.order_id]["sequence"]] == exp


def test_asof_ties_take_the_largest_values(spark):
    left = spark.sql("select 1 as k, timestamp'2024-01-02 00:00:00' as t union all select 1, timestamp'2024-01-05 00:00:00'")
    right = spark.sql("select 1 as k, timestamp'2024-01-02 00:00:00' as rt, explode(array(3, 9, 5)) as v")
    for parts in (1, 3):
        got = asof_backward(left, right.repartition(parts), "k", "t", "rt", ["rt", "v"]).collect()
        assert [r["v"] for r in got] == [9, 9]


def test_more_queries_than_one_broadcast_holds(spark, monkeypatch):
    index = spark.range(50).select("id", F.array(F.col("id").cast("double"), F.lit(0.0)).alias("vec"))
    queries = spark.range(37).select(F.col("id").alias("query_id"), F.array(F.col("id") + 0.1, F.lit(0.0)).alias("query_vec"))
    words = lambda d, c: d.select(c, F.explode(F.array(F.lit("all"), F.concat(F.lit("t"), F.col(c)))).alias("term"),
                                  F.lit(0.5).alias("weight"))
    docs, asked = words(index, "id"), words(queries, "query_id")
    cols = ["query_id", "id", "rank"]

    def run():
        near = text.top_k_nearest(index, queries, "id", "vec", 3).select(cols).collect()
        return sorted(near), sorted(text.top_k_sparse(docs, asked, "id", 3).select(cols).collect())

    whole = run()
    monkeypatch.setattr(text, "BROADCAST_MAX_QUERIES", 10)
    assert run() == whole and len(whole[0]) == 37 * 3


def test_documents_without_tokens_count(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red hen"), (3, "- !"), (4, None)], "id long, text string")
    got = {(r["id"], r["term"]): r["weight"] for r in text.tfidf_long(docs, "id").collect()}
    assert set(got) == {(1, "red"), (2, "red")}  # two of four documents: below the largest share


def test_column_quantiles(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.normal(size=501), "b": rng.integers(0, 3, 501).astype(float), "c": np.full(501, 7.0)})
    df = spark.createDataFrame([(*map(float, r), None) for r in pdf.to_numpy()], "a double, b double, c double, d double")
    got = column_quantiles(df, ["a", "b", "c", "d"], [0.25, 0.5, 0.75])
    for c in pdf:
        assert np.allclose(got[c], np.quantile(pdf[c], [0.25, 0.5, 0.75]), atol=1e-12)
    assert got["d"] == [None] * 3


def test_asof_one_key_busy_in_one_day(spark):
    """All rows in one key and hour: still spread, and right across the borders of partitions."""
    n = 4000
    base = F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") % 3000))
    left = spark.range(n).select(F.col("id").alias("lid"), F.lit(1).alias("k"), base.alias("t"))
    right = spark.range(0, 3000, 700).select(F.lit(1).alias("k"), base.alias("rt"), F.col("id").alias("v"))
    right = right.unionByName(spark.range(1).select(F.lit(None).cast("int").alias("k"), F.timestamp_seconds(F.lit(0)).alias("rt"), F.lit(-1).cast("long").alias("v")))
    out = asof_backward(left.unionByName(left.limit(1).select(F.lit(-1).cast("long").alias("lid"), F.lit(None).cast("int").alias("k"), "t")),
                        right, "k", "t", "rt", ["v"])
    got = {r["lid"]: r["v"] for r in out.collect()}
    assert got.pop(-1) is None and len(got) == n
    assert all(v == (i % 3000) // 700 * 700 for i, v in got.items())
    plan = out._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_nearest_ties_ids_and_odd_vectors(spark):
    rows = [(f"c{i:03d}", [float(i % 4), 0.0]) for i in range(40)] + [(None, [0.0, 0.0]), ("short", [0.0]), ("none", None)]
    index = spark.createDataFrame(rows, "id string, vec array<float>").repartition(5)
    q = spark.createDataFrame([(7, [0.1, 0.0]), (8, [3.0, 0.0])], "query_id int, query_vec array<double>")
    got = text.top_k_nearest(index, q, "id", "vec", 12).orderBy("query_id", "rank").collect()
    want = [f"c{i:03d}" for i in range(0, 40, 4)] + ["c001", "c005"]
    assert [r["id"] for r in got if r["query_id"] == 7] == want
    assert [r["id"] for r in got if r["query_id"] == 8][:10] == [f"c{i:03d}" for i in range(3, 40, 4)]
    assert text.top_k_nearest(index, q, "id", "vec", 100).count() == 80  # all there are
    assert text.top_k_nearest(index.limit(0), q, "id", "vec", 3).count() == 0
    assert text.top_k_nearest(index, q.limit(0), "id", "vec", 3).count() == 0


def test_sparse_in_many_batches(spark, monkeypatch):
    docs = spark.createDataFrame([(f"d{i}", f"t{j}", 0.1 * (i % 3 + 1)) for i in range(20) for j in range(i % 5)], "id string, term string, weight double")
    asked = spark.createDataFrame([(q, f"t{j}", 0.5) for q in range(9) for j in range(q % 4)], "query_id int, term string, weight double")
    whole = sorted(map(tuple, text.top_k_sparse(docs, asked, "id", 5).collect()))
    monkeypatch.setattr(text, "QUERY_POSTINGS", 4)
    assert sorted(map(tuple, text.top_k_sparse(docs, asked, "id", 5).collect())) == whole
    assert {w[0] for w in whole} == {q for q in range(9) if q % 4}
    for q in (1, 2, 3):
        dots = {}
        for i in range(20):
            d = sum(0.5 * 0.1 * (i % 3 + 1) for j in range(min(i % 5, q)))
            if d:
                dots[f"d{i}"] = round(2 - 2 * d, 9)
        assert [w[1] for w in whole if w[0] == q] and sorted(w[2] for w in whole if w[0] == q) == sorted(dots.values())[:5]
