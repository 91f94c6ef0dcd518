"""Tables written once: columns on disk, only the columns a query needs, and rank lookups that deal few rows."""
import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from slipway.operators import split as sp
from slipway.operators.order_features import TARGET, order_feature_table
from slipway.plans import ranking as rk
from slipway.plans import stored
from slipway.session import cut_lineage, ensure_checkpoint_dir
from slipway.sources.views import Domain
from tests.conftest import SF001


def _size(root):
    return sum(os.path.getsize(f) for f in glob.glob(f"{root}/**", recursive=True) if os.path.isfile(f))


def test_a_cut_frame_is_small_and_read_by_column(spark):
    df = spark.range(50_000).select("id", *[(F.col("id") % 7 + i).cast("double").alias(f"c{i}") for i in range(20)],
                                    F.lit(None).cast("timestamp_ntz").alias("t"), F.array(F.lit(1.5)).alias("a"))
    root = ensure_checkpoint_dir(spark).replace("file:", "")
    before = _size(root)
    cut = cut_lineage(df)
    assert _size(root) - before < 50_000 * 23 * 8 / 4  # rows as they lie in memory take more than 8 bytes a column
    assert cut.schema.simpleString() == df.schema.simpleString() and cut.count() == 50_000
    assert cut.exceptAll(df).isEmpty() and df.exceptAll(cut).isEmpty()
    plan = cut.select("c3")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c3:double>" in plan  # no other column
    assert cut_lineage(df.filter("id < 0")).count() == 0


@pytest.mark.parametrize("columns", [stored.CORE, ("order_id", "seller_id", "total_price", "zip_gap", "density"),
                                     ("order_id", "seller_prior_late_rate", "category")])
def test_few_columns_hold_the_rows_of_the_whole_table(spark, columns):
    few = stored.stored_features(Domain(spark, SF001), columns)
    assert few.columns == [*columns, "_rid"]
    d = Domain(spark, SF001)
    whole = stored.stored_features(d).select(*columns, "_rid")
    assert whole.count() == few.count() > 0
    assert whole.exceptAll(few).isEmpty() and few.exceptAll(whole).isEmpty()
    same = stored.stored_features(d, columns)  # served from the whole table
    assert same.columns == few.columns and set(d.__dict__["_stored"]) == {"features"}


def test_columns_without_lookups_are_built_without_them(spark):
    d = Domain(spark, SF001)
    plan = order_feature_table(d, {"columns": stored.CORE})._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "p_brand" not in plan and "l_extendedprice" not in plan
    assert TARGET in plan


def test_the_order_aggregate_keeps_the_multiplicities_of_repeated_keys(spark):
    from slipway.operators.order_features import order_seller_aggregate
    t = dt.datetime(2020, 1, 1)
    orders = spark.createDataFrame([(1, 7, t, t, 0), (1, 7, t, t, 0), (2, None, t, t, 1)],
                                   "order_id long, customer_id long, purchase timestamp_ntz, estimated timestamp_ntz, is_late int")
    items = spark.createDataFrame([(1, 5, 9, t, 2.0, 1.0), (1, 6, 9, t, 3.0, 1.0), (2, 5, 9, t, 1.0, 1.0), (None, 5, 9, t, 1.0, 1.0)],
                                  "order_id long, product_id long, seller_id long, shipping_limit timestamp_ntz, price double, freight_value double")
    products = spark.createDataFrame([(5, "a", 1.0, 2, 2, 2), (5, "b", 3.0, 1, 1, 1)],
                                     "product_id long, category string, weight_g double, length_cm int, height_cm int, width_cm int")
    customers = spark.createDataFrame([(7, "X", 10), (7, "Y", 11), (None, "Z", 1)], "customer_id long, customer_state string, customer_zip long")
    sellers = spark.createDataFrame([(9, "S", 3), (9, "S", 4)], "seller_id long, seller_state string, seller_zip long")
    got = order_seller_aggregate(items, orders, products, customers, sellers).collect()
    assert [(r["order_id"], r["seller_id"], r["n_items"], r["total_price"], r["avg_weight_g"], r["category"], r["customer_state"], r["seller_zip"])
            for r in got] == [(1, 9, 16, 32.0, 2.0, "a", "X", 3)]  # 1 item x 2 products x 2 orders x 2 customers x 2 sellers


def test_rank_lookups_equal_sorted_values(spark, monkeypatch):
    import random
    rnd = random.Random(4)
    rows = [(rnd.choice([None, *range(40)]), rnd.gauss(0, 1) if rnd.random() < .9 else None, None) for _ in range(700)]
    df = spark.createDataFrame(rows, "a int, b double, c double").repartition(5)
    monkeypatch.setattr(rk, "N_BUCKETS", 8)
    got = rk.column_quantiles(df, ["a", "b", "c"], [0.0, 0.25, 0.5, 1.0])
    import numpy as np
    for i, c in enumerate("ab"):
        v = [float(r[i]) for r in rows if r[i] is not None]
        assert np.allclose(got[c], np.quantile(v, [0.0, 0.25, 0.5, 1.0]), atol=1e-12)
    assert got["c"] == [None] * 4
    v = sorted(r[0] for r in rows if r[0] is not None)
    assert rk.quantile_nearest_values(df, "a", [0.1, 0.9]) == [v[round((len(v) - 1) * q)] for q in (0.1, 0.9)]
    # a lookup names only the buckets that hold a rank
    assert rk._buckets_of_ranks({0: 5, 2: 5, 3: 1}, [0, 10]) == {0: 0, 3: 10}


def test_block_keys_are_grouped_once(spark):
    rows = [(1, "train"), (1, "test"), (2, "train"), (2, "train"), (3, "calib"), (3, "test"), (None, "train"), (None, "calib"), (4, None)]
    df = spark.createDataFrame(rows, "k int, block string")
    out = sp.blocks_disjoint(df, ["k"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert {(r["block_a"], r["block_b"]): r["n_common"] for r in out.collect()} == {
        ("train", "calib"): 1, ("train", "test"): 1, ("calib", "test"): 1}
    assert [r["n_common"] for r in sp.blocks_disjoint(df.filter("k > 9"), ["k"]).collect()] == [0, 0, 0]
