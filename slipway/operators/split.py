"""Time splits and fold assignment.

Split points are order statistics of the date column computed by the
distributed nearest-rank lookup (``plans.ranking``): two scalars, then a
``block`` column by plain comparisons (partition pruning applies when the
table is stored ``partitionBy`` month). Nothing is sorted globally.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipway.plans.ranking import quantile_nearest_values, row_numbers

DEFAULTS = {"test_size": 0.20, "calibration_size": 0.10, "embargo_days": 30}


def _micros(col: str):
    return F.unix_micros(F.col(col).cast("timestamp"))


def nearest_date(df: DataFrame, col: str, q: float, rounding: str = "half_even") -> dt.datetime | None:
    """Element at index round_half_even((n-1)q) of the sorted dates
    (or floor(n q) with rounding='floor_n', the drift rule), as a scalar."""
    return nearest_dates(df, col, [q], rounding)[0]


def nearest_dates(df: DataFrame, col: str, qs: list[float], rounding: str = "half_even") -> list[dt.datetime | None]:
    """``nearest_date`` at several places, from one count of the dates."""
    found = quantile_nearest_values(df.select(_micros(col).alias("_t")), "_t", qs, rounding)
    return [None if v is None else dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=int(v)) for v in found]


def purged_split_points(df: DataFrame, test_size: float, calib_size: float, embargo_days: int,
                        col: str = "as_of_date") -> dict:
    test_start, calib_start = nearest_dates(df, col, [1 - test_size, 1 - test_size - calib_size])
    emb = dt.timedelta(days=int(embargo_days))
    return {"test_start": test_start, "calib_start": calib_start,
            "train_end": calib_start - emb, "calib_end": test_start - emb}


def purged_temporal_split(df: DataFrame, test_size: float = 0.2, calib_size: float = 0.1,
                          embargo_days: int = 30, col: str = "as_of_date") -> DataFrame:
    """``block`` in {train, calib, test}; NULL = dropped in an embargo.

    train < calib_start - E; calib in [calib_start, test_start - E);
    test >= test_start. Raises when train or test would be empty."""
    p = purged_split_points(df, test_size, calib_size, embargo_days, col)
    t = F.col(col)
    block = (F.when(t >= F.lit(p["test_start"]), "test")
              .when((t >= F.lit(p["calib_start"])) & (t < F.lit(p["calib_end"])), "calib")
              .when(t < F.lit(p["train_end"]), "train"))
    out = df.withColumn("block", block)
    c = out.agg(F.count_if(F.col("block") == "train").alias("tr"), F.count_if(F.col("block") == "test").alias("te")).first()
    if c["tr"] == 0 or c["te"] == 0:
        raise ValueError("no rows left to train or to test on: shorten the embargo or the test share")
    return out


def chronological_split(df: DataFrame, test_size: float = 0.2, embargo_days: int = 0,
                        col: str = "as_of_date") -> DataFrame:
    """Two-way version (no calibration block)."""
    return purged_temporal_split(df, test_size, 0.0, embargo_days, col)


def forward_folds(df: DataFrame, n_splits: int = 3, col: str = "as_of_date", id_col: str = "_rid") -> DataFrame:
    """Forward-chaining folds over rows ordered by (date, id):
    ts = n // (s+1); fold i (1..s) tests rows [n-(s-i+1)ts, n-(s-i)ts) and
    trains on everything before. Adds ``row_idx`` (0-based) and ``test_fold``
    (NULL for the first block, never tested)."""
    d = df.withColumn("_t", _micros(col))
    rn = row_numbers(d, "_t", id_col, desc=False, name="_rn").drop("_t")
    n = df.count()
    ts = n // (n_splits + 1)
    idx = F.col("_rn") - 1
    fold = None
    for i in range(1, n_splits + 1):
        lo, hi = n - (n_splits - i + 1) * ts, n - (n_splits - i) * ts
        cond = (idx >= lo) & (idx < hi)
        fold = F.when(cond, F.lit(i)) if fold is None else fold.when(cond, F.lit(i))
    return rn.withColumn("row_idx", idx).withColumn("test_fold", fold).drop("_rn")


def fold_starts(df: DataFrame, n_splits: int = 3, col: str = "as_of_date", id_col: str = "_rid") -> dict[int, Column]:
    """Per fold of ``forward_folds`` the condition that a row lies before it. Only dates and ids are numbered and
    written; the rows themselves stay where they are."""
    folds = forward_folds(df.select(col, id_col), n_splits, col, id_col).filter(F.col("test_fold").isNotNull())
    first = folds.groupBy("test_fold").agg(F.min_by(F.struct(_micros(col).alias("t"), F.col(id_col).alias("id")), "row_idx").alias("f"))
    t, i = _micros(col), F.col(id_col)
    return {r["test_fold"]: F.coalesce((t < F.lit(r["f"]["t"])) | ((t == F.lit(r["f"]["t"])) & (i < F.lit(r["f"]["id"]))), F.lit(False))
            for r in first.collect()}  # n_splits rows


def reference_current_split(df: DataFrame, col: str = "as_of_date", fraction: float = 0.5) -> DataFrame:
    """cutoff = date at sorted index int(n * fraction); ``<`` is the
    reference window, ``>=`` the current one."""
    cut = nearest_date(df, col, fraction, rounding="floor_n")
    return df.withColumn("window", F.when(F.col(col) < F.lit(cut), "reference").otherwise("current"))


def blocks_disjoint(df: DataFrame, key_cols: list[str], block_col: str = "block") -> DataFrame:
    """Pairwise intersection sizes of the blocks' key sets (all must be 0)."""
    names = ["train", "calib", "test"]
    # one grouping of the keys tells in which blocks each lies
    inside = df.filter(F.col(block_col).isin(names)).groupBy(*key_cols).agg(
        *[F.bool_or(F.col(block_col) == b).alias(f"_in_{b}") for b in names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    cells = F.array(*[F.struct(F.lit(a).alias("block_a"), F.lit(b).alias("block_b"),
                               F.count_if(F.col(f"_in_{a}") & F.col(f"_in_{b}")).alias("n_common")) for a, b in pairs])
    return inside.agg(cells.alias("p")).select(F.inline("p"))
