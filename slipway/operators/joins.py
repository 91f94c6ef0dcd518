"""Join operators Spark lacks natively, written as DataFrame compositions.

``asof_backward`` (J08): for each left row, the latest right row with the
same key and right_ts <= left_ts. Both sides are unioned and dealt to range
partitions of (key, time), so a hot key, or one that is busy within a single
day, is spread over as many tasks as its rows need; inside a partition the
as-of is a window ``last(.., ignorenulls)``; rows before the partition's first
match take the carry-in value from the (partition, key) summaries (one
row per cell, a small window). No inequality join, no per-row search, no
cross product.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slipway.session import cut_lineage


def asof_backward(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str,
                  values: Sequence[str], bucket_seconds: int | None = None) -> DataFrame:
    """``bucket_seconds`` has no use any more: partitions follow the rows, not the clock. A null key matches nothing."""
    values = list(values)
    lcols = left.columns
    sec = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    row = F.struct(*[F.col(c) for c in lcols])
    L = left.select(row.alias("_l"), F.col(key).alias("_k"), sec(left_ts).alias("_t"), F.lit(1).alias("_side"),
                    F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_r"),
                    F.xxhash64(*[F.col(c) for c in lcols]).alias("_h"))
    R = right.select(F.lit(None).cast(left.select(F.struct(*lcols)).schema[0].dataType).alias("_l"),
                     F.col(key).alias("_k"), sec(right_ts).alias("_t"), F.lit(0).alias("_side"),
                     F.struct(*values).alias("_r"), F.lit(0).cast("long").alias("_h"))
    # right sorts before left at equal timestamps: right_ts <= left_ts matches; of right rows with one timestamp the
    # largest values win; the hash spreads left rows of one key and time
    order = ["_k", "_t", "_side", "_r", "_h"]
    sorted_ = L.unionByName(R).repartitionByRange(*order).sortWithinPartitions(*order)
    marked = cut_lineage(sorted_.withColumn("_at", F.monotonically_increasing_id()))  # partition << 33 | place
    u = marked.withColumn("_p", F.shiftright("_at", 33))
    w = Window.partitionBy("_p", "_k").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    local = u.withColumn("_loc", F.last("_r", ignorenulls=True).over(w)).filter(F.col("_side") == 1)
    # the last right row of every (partition, key) cell, carried on to the key's later cells: a row per cell
    cells = u.groupBy("_p", "_k").agg(F.max_by("_r", F.when(F.col("_side") == 0, F.col("_at"))).alias("_last"))
    wc = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carry = cells.select("_p", "_k", F.last("_last", ignorenulls=True).over(wc).alias("_carry"))
    lrows = local.join(carry, ["_p", "_k"], "left")
    res = F.when(F.col("_k").isNotNull(), F.coalesce(F.col("_loc"), F.col("_carry")))
    return lrows.select(*[F.col(f"_l.{c}").alias(c) for c in lcols],
                        *[res[v].alias(v) for v in values])


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Keep one row per key: the first by ``order`` (a total order).

    An aggregate (``min_by``), not a window: the partial aggregation runs
    map-side, so a key holding a third of all copies never lands whole in
    one task.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    ocol = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ocol).alias("_first"))
    return g.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])
