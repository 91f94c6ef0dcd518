"""The whole correlation matrix from partial Gram matrices.

Each task adds up, over its rows, the products of all column pairs (and of the marks of
present values, so that every pair counts the rows where both are present). The partial
matrices are columns x columns numbers whatever the rows; they are summed ``FAN`` at a time, then
once more. Columns are shifted by their means first, which keeps the sums well conditioned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 64
PARTS = "bucket int, m binary"


def _add(frames) -> np.ndarray | None:
    total = None
    for m in frames:
        x = np.frombuffer(m, np.float64)
        total = x.copy() if total is None else total + x
    return total


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, n, r) for every ordered pair of columns: Pearson over rows where both are present; r is null where
    fewer than two such rows are, or where a column does not vary."""
    k = len(cols)
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    shifted = df.select(F.pmod(F.spark_partition_id(), F.lit(FAN)).alias("bucket"),
                        *[(F.col(c).cast("double") - F.lit(means[i] if means[i] is not None else 0.0)).alias(f"c{i}")
                          for i, c in enumerate(cols)])

    def gram(frames):
        total, bucket = np.zeros((4, k, k)), None
        for f in frames:
            if not len(f):
                continue
            bucket = int(f["bucket"].iloc[0])
            x = f[[f"c{i}" for i in range(k)]].to_numpy(float)
            here = ~np.isnan(x)
            x = np.where(here, x, 0.0)
            here = here.astype(float)
            total += np.stack([here.T @ here, x.T @ here, (x * x).T @ here, x.T @ x])
        if bucket is not None:
            yield pd.DataFrame({"bucket": [bucket], "m": [total.tobytes()]})

    def add(key, f):
        return pd.DataFrame({"bucket": [0], "m": [_add(f["m"]).tobytes()]})

    def finish(f):
        n, s, q, p = _add(f["m"]).reshape(4, k, k)
        with np.errstate(divide="ignore", invalid="ignore"):
            vary = (n * q - s ** 2), (n * q - s ** 2).T  # of a and of b over the pair's rows
            r = (n * p - s * s.T) / np.sqrt(vary[0] * vary[1])
            tiny = (vary[0] <= 1e-12 * np.maximum(n * q, 1e-300)) | (vary[1] <= 1e-12 * np.maximum((n * q).T, 1e-300))
        a, b = np.meshgrid(np.arange(k), np.arange(k), indexing="ij")
        r = np.where((n < 2) | tiny | ~np.isfinite(r), np.nan, np.clip(r, -1, 1))
        return pd.DataFrame({"a": np.array(cols, object)[a.ravel()], "b": np.array(cols, object)[b.ravel()],
                             "n": n.ravel().astype(np.int64), "r": r.ravel()})

    some = shifted.mapInPandas(gram, PARTS).groupBy("bucket").applyInPandas(add, PARTS)  # at most FAN rows
    out = some.groupBy("bucket").applyInPandas(finish, "a string, b string, n long, r double")
    return out.withColumn("r", F.when(~F.isnan("r"), F.col("r")))
