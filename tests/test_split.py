"""Purged temporal split properties (reference test_split_integrity)."""
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slipway.operators import split as sp


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(0)
    rows = []
    for s in range(5):
        for d in range(730):
            rows.append((f"s{s}", dt.datetime(2017, 1, 1) + dt.timedelta(days=d), float(rng.random()), int(rng.random() < 0.1)))
    pdf = pd.DataFrame(rows, columns=["seller_id", "as_of_date", "x", "is_late_delivery"])
    return spark.createDataFrame(pdf).withColumn("_rid", F.monotonically_increasing_id())


def _blocks(df):
    return {r["block"]: (r["a"], r["b"], r["n"]) for r in
            df.groupBy("block").agg(F.min("as_of_date").alias("a"), F.max("as_of_date").alias("b"),
                                    F.count(F.lit(1)).alias("n")).collect()}


def test_block_order_and_embargo(spark, panel):
    b = _blocks(sp.purged_temporal_split(panel, 0.2, 0.1, 30))
    assert b["train"][1] < b["calib"][0] < b["test"][0]
    assert (b["calib"][0] - b["train"][1]).days >= 30 and (b["test"][0] - b["calib"][1]).days >= 30


def test_rows_discarded_into_gaps(spark, panel):
    b = _blocks(sp.purged_temporal_split(panel, 0.2, 0.1, 30))
    assert None in b and b[None][2] > 0


def test_embargo_zero_is_partition(spark, panel):
    b = _blocks(sp.chronological_split(panel, 0.2, 0))
    assert None not in b and b["train"][2] + b["test"][2] == panel.count()


def test_impossible_embargo_rejected(spark, panel):
    with pytest.raises(ValueError):
        sp.purged_temporal_split(panel, 0.2, 0.1, 5000)


def test_blocks_disjoint(spark, panel):
    b = sp.purged_temporal_split(panel, 0.2, 0.1, 30)
    assert all(r["n_common"] == 0 for r in sp.blocks_disjoint(b, ["seller_id", "as_of_date"]).collect())


def test_forward_folds_sizes(spark, panel):
    f = sp.forward_folds(panel, 3)
    n = panel.count()
    sizes = {r["test_fold"]: r["count"] for r in f.groupBy("test_fold").count().collect()}
    assert sizes[1] == sizes[2] == sizes[3] == n // 4
