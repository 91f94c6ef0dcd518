"""For each row, the previous <= ``seq_len`` rows of the same seller
(row itself excluded), oldest first, left-padded with zero vectors; NULL
features -> 0.

Skew-safe: rows get an exact per-seller row number (bucketed prefix sums,
``plans.ranking``), are cut into blocks of ``block`` rows, and the last
``seq_len`` rows of each block are copied as a halo into the next block.
The frame window then runs per (seller, block): a seller holding a third
of all rows is spread over many tasks, each at most ``block + seq_len`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slipway.plans.ranking import row_numbers

SEQ_LEN = 30


def sequence_windows(df: DataFrame, feature_cols: Sequence[str], key: str = "seller_id", ts: str = "as_of_date",
                     tiebreak: str = "order_id", seq_len: int = SEQ_LEN, block: int = 4096,
                     keep: Sequence[str] = ("order_id", "seller_id")) -> DataFrame:
    if block < seq_len:
        raise ValueError("block must hold at least seq_len rows")
    vec = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in feature_cols])
    d = df.select(*keep, *([key] if key not in keep else []), ts, *([tiebreak] if tiebreak not in keep else []),
                  vec.alias("_x"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"))
    d = row_numbers(d, "_t", tiebreak, desc=False, part=[key], name="_rn")
    d = d.withColumn("_blk", F.floor((F.col("_rn") - 1) / block).cast("long")).withColumn("_halo", F.lit(False))
    halo = (d.filter((F.col("_rn") - 1) % block >= block - seq_len)
             .withColumn("_blk", F.col("_blk") + 1).withColumn("_halo", F.lit(True)))
    u = d.unionByName(halo)
    w = Window.partitionBy(key, "_blk").orderBy("_rn").rowsBetween(-seq_len, -1)
    u = u.withColumn("_seq", F.collect_list("_x").over(w)).filter(~F.col("_halo"))
    zeros = F.array_repeat(F.array(*[F.lit(0.0) for _ in feature_cols]), seq_len - F.size("_seq"))
    return u.select(*keep, F.size("_seq").alias("n_real"), F.concat(zeros, F.col("_seq")).alias("sequence"))


def sequence_checksum(seq_col: str = "sequence"):
    """sum over steps s (1-based) of s * sum_j (j+1) * x[s][j]: an order-
    sensitive fingerprint of a padded sequence (for SQL comparison)."""
    inner = lambda v: F.aggregate(F.transform(v, lambda x, j: x * (j + 1)), F.lit(0.0), lambda a, b: a + b)
    return F.aggregate(F.transform(F.col(seq_col), lambda v, s: inner(v) * (s + 1)), F.lit(0.0), lambda a, b: a + b)
