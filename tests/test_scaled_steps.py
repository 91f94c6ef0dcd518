"""Steps written to scale: quantiles between bounds, first rows, deciles without a join of whole rows."""
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slipway.operators import boosting as gb
from slipway.operators import labels as lb
from slipway.plans import ranking


def test_column_quantiles_store_only_values_near_the_place(spark, monkeypatch):
    n, rng = 20_000, random.Random(3)
    rows = [(rng.gauss(0, 1), float(rng.randrange(3)), None if i % 3 else rng.random(), None) for i in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(4)
    written, cut = [], ranking.cut_lineage
    monkeypatch.setattr(ranking, "cut_lineage", lambda d: written.append(cut(d)) or written[-1])
    got = ranking.column_quantiles(df, ["a", "b", "c", "d"], [0.25, 0.5, 1.0])
    for j, c in enumerate("abc"):
        want = np.quantile([r[j] for r in rows if r[j] is not None], [0.25, 0.5, 1.0])
        assert got[c] == pytest.approx(list(want), abs=1e-12)
    assert got["d"] == [None] * 3
    assert sum(w.count() for w in written) < n / 20


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50])
def test_column_quantiles_of_few_rows(spark, n):
    rows = [(float(i * i % 11), None if i == 0 else float("nan") if i % 5 == 4 else 1.0) for i in range(n)]
    got = ranking.column_quantiles(spark.createDataFrame(rows, "a double, b double"), ["a", "b"], [0.0, 0.3, 0.5])
    assert got["a"] == pytest.approx(list(np.quantile([r[0] for r in rows], [0.0, 0.3, 0.5])))
    assert got["b"][0] == (None if n == 1 else 1.0)


def test_first_rows_sorts_few_rows(spark):
    df = spark.range(50_000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("k")).repartition(8)
    kept = ranking.first_rows(df, F.col("k"), 70, [F.desc("id")], desc=True)
    want = [r[0] for r in df.orderBy(F.desc("k"), F.desc("id")).limit(70).select("id").collect()]
    assert [r[0] for r in kept.select("id").collect()] == want
    assert ">=" in kept._jdf.queryExecution().logical().toString()  # a filter comes before the sort
    few = spark.createDataFrame([(1, None), (2, 5), (3, 4)], "id long, k long")
    assert [r[0] for r in ranking.first_rows(few, F.col("k"), 3, [F.asc("id")], desc=True).collect()] == [2, 3, 1]


def test_recent_rows_are_the_newest(spark):
    day = dt.datetime(2020, 1, 1)
    df = spark.createDataFrame([(i, day + dt.timedelta(hours=i % 977)) for i in range(4000)], "_rid long, as_of_date timestamp")
    want = [r[0] for r in df.orderBy(F.desc("as_of_date"), F.desc("_rid")).limit(25).collect()]
    assert [r[0] for r in gb.recent_rows(df, 25).collect()] == want


def test_deciles_do_not_deal_whole_rows(spark):
    """L05 by brute force; the panel's own rows meet only broadcast tables."""
    rng = random.Random(5)
    rows = []
    for s in [None, *range(1, 12)]:
        for i in range(60 if s else 3):
            n = rng.choice([0, 3, 5, 5, 6, 7, 9]) if s else (5, 7, 9)[i]  # no two rows without a seller are tied
            late = rng.randint(0, n)
            rows.append((s, dt.date(2021, 1, 1) + dt.timedelta(days=i), n, late / n if n else None, "x"))
    p = spark.createDataFrame(rows, "seller_id long, as_of_date date, forward_orders long, forward_rate double, more string")
    out = lb.stratified_label(p, 0.2, 5)
    assert out.columns == [*p.columns, "vol_bin", "pct", "y"]
    months: dict = {}
    for r in rows:
        if r[2] >= 5:
            months.setdefault(r[1].month, []).append(r)
    want, cells = {}, {}
    for m, some in months.items():
        some.sort(key=lambda r: (r[2], r[0] is not None, r[0] or 0, r[1]))
        for i, r in enumerate(some):
            k = max(-(-i * 10 // max(len(some) - 1, 1)), 1) - 1
            cells.setdefault((m, k), []).append(r)
    for (m, k), some in cells.items():
        for r in some:
            if r[0] is not None:
                below, same = sum(q[3] < r[3] for q in some), sum(q[3] == r[3] for q in some)
                pct = (below + (same + 1) / 2) / len(some)
                want[r[0], r[1]] = (k, round(pct, 9), int(pct >= 0.8))
    got = {(r["seller_id"], r["as_of_date"]): (r["vol_bin"], r["pct"] if r["pct"] is None else round(r["pct"], 9), r["y"])
           for r in out.collect() if r["seller_id"] is not None}
    assert len(got) == 11 * 60 and {k: v for k, v in got.items() if v[0] is not None} == want
    assert all(r["y"] is None and r["vol_bin"] is None for r in out.filter("seller_id is null").collect())
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
