"""Exploratory aggregates (A16-A20): each is one aggregation pass producing
one wide row, unpivoted into a long (feature, value) table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slipway.plans.ranking import quantiles_linear

ID_LIKE = ("order_id", "seller_id")


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """P14 helper: numeric columns of the schema, minus ids/label/excluded."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude) | set(ID_LIKE)]


def _unpivot(row_df: DataFrame, cols: list[str], name: str) -> DataFrame:
    return row_df.unpivot([], cols, "feature", name)


def label_correlations(df: DataFrame, label: str, top: int = 10) -> DataFrame:
    """Pearson r of every numeric feature with the label in ONE pass;
    top ``top`` by |r| (feature name breaks ties)."""
    cols = numeric_columns(df, exclude=[label])
    wide = df.agg(*[F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(c) for c in cols])
    long = _unpivot(wide, cols, "corr").filter(F.col("corr").isNotNull())
    return (long.withColumn("abs_corr", F.abs("corr"))
                .orderBy(F.desc("abs_corr"), F.asc("feature")).limit(top))


def grouped_describe(df: DataFrame, by: str, col: str) -> DataFrame:
    """Per group count, mean, sample std, min, linear quartiles, max."""
    base = df.groupBy(by).agg(F.count(col).alias("count"), F.avg(col).alias("mean"),
                              F.stddev_samp(col).alias("std"), F.min(col).cast("double").alias("min"),
                              F.max(col).cast("double").alias("max"))
    q = quantiles_linear(df.select(by, col), col, [0.25, 0.5, 0.75], part=[by])
    qw = q.groupBy(by).agg(*[F.max(F.when(F.col("q") == v, F.col("value"))).alias(n)
                             for n, v in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))])
    return base.join(qw, by, "left")


def missing_share(df: DataFrame) -> DataFrame:
    """Percentage of NULLs per column, only columns with any, one pass."""
    cols = df.columns
    wide = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in cols])
    return _unpivot(wide, cols, "missing_pct").filter(F.col("missing_pct") > 0)
