"""Feature drift between a reference and a current window.

All columns at once in long form: (feature, value) pairs from ``unpivot``,
value counts per (feature, side), merged empirical CDFs by the bucketed
prefix sum (partitioned by feature), then per feature:

* ``wasserstein``: 1-D Wasserstein distance  sum |F_ref - F_cur| * gap to
  the next distinct value, divided by the reference (population) std;
* ``ks``: max |F_ref - F_cur| (two-sample KS statistic).

The "next distinct value" is found inside each (feature, bucket) and, for
the last value of a bucket, from the next bucket's minimum (<= n_buckets
rows per feature), so no feature's value set is ever one window task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slipway.plans.ranking import prefix_sums
from slipway.session import cut_lineage

DRIFT_THRESHOLD = 0.1


def long_values(df: DataFrame, cols: list[str], side_col: str = "window") -> DataFrame:
    d = df.select(side_col, *[F.col(c).cast("double").alias(c) for c in cols])
    return d.unpivot([side_col], cols, "feature", "value").filter(F.col("value").isNotNull())


def drift_distances(df: DataFrame, cols: list[str], side_col: str = "window") -> DataFrame:
    """(feature, wasserstein, ks, n_reference, n_current)."""
    lv = long_values(df, cols, side_col)
    # one (feature, value) count table feeds the CDFs, totals and the
    # reference std: write it once
    g = cut_lineage(lv.groupBy("feature", "value").agg(F.count_if(F.col(side_col) == "reference").alias("nr"),
                                                       F.count_if(F.col(side_col) == "current").alias("nc")))
    tot = g.groupBy("feature").agg(F.sum("nr").alias("tot_r"), F.sum("nc").alias("tot_c"))
    c = prefix_sums(g, [("value", False)], ["nr", "nc"], part=["feature"])
    wb = Window.partitionBy("feature", "_bucket").orderBy("value")
    c = c.withColumn("_next_in", F.lead("value").over(wb))
    bmin = c.groupBy("feature", "_bucket").agg(F.min("value").alias("_bmin"))
    bmin = bmin.withColumn("_next_b", F.lead("_bmin").over(Window.partitionBy("feature").orderBy("_bucket")))
    c = c.join(bmin.select("feature", "_bucket", "_next_b"), ["feature", "_bucket"])
    c = c.join(tot, "feature")
    fr = F.col("cum_nr") / F.col("tot_r")
    fc = F.col("cum_nc") / F.col("tot_c")
    gap = F.coalesce(F.col("_next_in"), F.col("_next_b")) - F.col("value")
    # population std of the reference window from the counts (two passes:
    # mean first, then the centred second moment)
    mean = g.groupBy("feature").agg((F.sum(F.col("nr") * F.col("value")) / F.sum("nr")).alias("_m"))
    ref_stats = (g.join(F.broadcast(mean), "feature")
                  .groupBy("feature").agg(F.sqrt(F.sum(F.col("nr") * (F.col("value") - F.col("_m")) ** 2)
                                                 / F.sum("nr")).alias("ref_std")))
    a = c.groupBy("feature").agg(F.sum(F.coalesce(F.abs(fr - fc) * gap, F.lit(0.0))).alias("w1"),
                                 F.max(F.abs(fr - fc)).alias("ks"),
                                 F.first("tot_r").alias("n_reference"), F.first("tot_c").alias("n_current"))
    a = a.join(ref_stats, "feature", "left")
    return a.select("feature", F.try_divide(F.col("w1"), F.nullif("ref_std", F.lit(0.0))).alias("wasserstein"),
                    "ks", "n_reference", "n_current")


def summarize_drift(dist: DataFrame, stat: str = "wasserstein", threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """Drifted flag (value > threshold), drifted count and share."""
    t = dist.agg(F.count(F.lit(1)).alias("n_features"), F.count_if(F.col(stat) > threshold).alias("n_drifted"))
    return (dist.select("feature", F.col(stat).alias("value"), (F.col(stat) > threshold).cast("int").alias("drifted"))
                .crossJoin(F.broadcast(t.withColumn("share_drifted", F.col("n_drifted") / F.col("n_features")))))


PSI_EPS = 1e-4


def population_stability(df: DataFrame, cols: list[str], side_col: str = "window", n_bins: int = 10) -> DataFrame:
    """D02 option: PSI over the reference window's equal-frequency bins
    (exact linear deciles per feature; a value falls in bin = number of
    edges strictly below it); proportions floored at 1e-4;
    PSI = sum (cur - ref) * ln(cur / ref)."""
    from slipway.plans.ranking import quantiles_linear
    lv = long_values(df, cols, side_col)
    qs = [i / n_bins for i in range(1, n_bins)]
    edges = quantiles_linear(lv.filter(F.col(side_col) == "reference"), "value", qs, part=["feature"])
    e = edges.groupBy("feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "value"))),
                                                 lambda s: s["value"]).alias("_edges"))  # <= n_bins - 1 per feature
    j = lv.join(e, "feature")
    j = j.withColumn("bin", F.size(F.filter("_edges", lambda x: x < F.col("value"))))
    cnt = j.groupBy("feature", "bin").agg(F.count_if(F.col(side_col) == "reference").alias("nr"),
                                          F.count_if(F.col(side_col) == "current").alias("nc"))
    grid = e.select("feature", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    c = grid.join(cnt, ["feature", "bin"], "left").fillna(0, ["nr", "nc"])
    w = Window.partitionBy("feature")
    c = c.withColumn("pr", F.greatest(F.col("nr") / F.sum("nr").over(w), F.lit(PSI_EPS))) \
         .withColumn("pc", F.greatest(F.col("nc") / F.sum("nc").over(w), F.lit(PSI_EPS)))
    return c.groupBy("feature").agg(F.sum((F.col("pc") - F.col("pr")) * F.log(F.col("pc") / F.col("pr"))).alias("psi"))
