"""Feature preparation fitted on the training block only.

Fitting is a handful of 1-row aggregates (medians, means, population
stds, modes, level lists), applied back as column expressions: no Python
per row, no fitted object larger than the column list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slipway.operators.joins import dedupe_first
from slipway.plans.ranking import column_quantiles

ID_COLS = ("order_id", "seller_id")
DATE_COL = "as_of_date"


def feature_columns(df: DataFrame, target: str, extra_exclude=()) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns, excluding ids, date and target."""
    skip = set(ID_COLS) | {DATE_COL, target, "block"} | set(extra_exclude)
    num, cat = [], []
    for f in df.schema.fields:
        if f.name in skip:
            continue
        if isinstance(f.dataType, T.NumericType):
            num.append(f.name)
        elif isinstance(f.dataType, T.StringType):
            cat.append(f.name)
    return num, cat


def fit_numeric(train: DataFrame, cols: list[str]) -> dict:
    """M04 fit: exact median, then mean and population std of the imputed
    column (sklearn imputer -> scaler); zero variance -> scale 1."""
    med = {c: v[0] for c, v in column_quantiles(train, cols, [0.5]).items()} if cols else {}
    imp = train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(med[c])).alias(c) for c in cols])
    st = imp.agg(*[x for c in cols for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    return {c: {"median": med[c], "mean": st[f"m_{c}"],
                "scale": st[f"s_{c}"] if st[f"s_{c}"] not in (None, 0.0) else 1.0} for c in cols}


def _scaled(c: str, p: dict):
    return (F.coalesce(F.col(c).cast("double"), F.lit(p["median"])) - F.lit(p["mean"])) / F.lit(p["scale"])


def apply_numeric(df: DataFrame, fit: dict, suffix: str = "") -> DataFrame:
    """M04 apply: impute with the train median, z-score with train stats."""
    if suffix:
        return df.select("*", *[_scaled(c, p).alias(c + suffix) for c, p in fit.items()])
    return df.select(*[_scaled(c, fit[c]).alias(c) if c in fit else F.col(c) for c in df.columns])


def fit_categorical(train: DataFrame, cols: list[str]) -> dict:
    """M05 fit: mode (ties -> smallest value) and the sorted level list of
    the imputed column. Levels are a bounded list per column."""
    out = {}
    for c in cols:
        cnt = train.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        mx = cnt.agg(F.max("n")).first()[0]
        top = cnt.filter(F.col("n") == mx).agg(F.min(c)).first()[0]
        levels = sorted(r[0] for r in train.select(F.coalesce(F.col(c), F.lit(top))).distinct().collect())
        out[c] = {"mode": top, "levels": levels}
    return out


def one_hot_long(df: DataFrame, fit: dict, keys=ID_COLS) -> DataFrame:
    """M05 apply, long form: one row per (key, column, level) whose
    indicator is 1; an unseen level yields no row (all-zero encoding)."""
    parts = []
    for c, p in fit.items():
        v = F.coalesce(F.col(c), F.lit(p["mode"]))
        parts.append(df.select(*keys, F.lit(c).alias("column"), v.alias("level"))
                       .filter(F.col("level").isin(p["levels"])))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def one_hot_vector_names(fit: dict) -> list[str]:
    """Ordered output names ``col_level`` (matrix order)."""
    return [f"{c}_{lv}" for c, p in fit.items() for lv in p["levels"]]


def class_weights(train: DataFrame, target: str) -> DataFrame:
    """Balanced weights n / (2 n_c) and scale_pos_weight = neg / pos."""
    a = train.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(target) == 1).alias("pos"),
                  F.count_if(F.col(target) == 0).alias("neg"))
    return a.select("n", "pos", "neg", (F.col("n") / (2.0 * F.col("neg"))).alias("w_neg"),
                    (F.col("n") / (2.0 * F.col("pos"))).alias("w_pos"),
                    (F.col("neg") / F.col("pos")).alias("scale_pos_weight"))


def with_weights(train: DataFrame, target: str, col: str = "weight") -> DataFrame:
    w = class_weights(train, target).first()
    return train.withColumn(col, F.when(F.col(target) == 1, F.lit(w["w_pos"])).otherwise(F.lit(w["w_neg"])))


# ------------------------------------------------------------------ cleaning
def handle_missing(df: DataFrame, strategy: str = "median", key_cols: list[str] | None = None) -> DataFrame:
    """Drop rows NULL in any key-like column (name contains 'id' or
    'date' unless given), fill numerics with the exact median (or mean)."""
    keys = key_cols if key_cols is not None else [c for c in df.columns if "id" in c or "date" in c]
    d = df.dropna(subset=keys) if keys else df
    num = [f.name for f in d.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in keys]
    if not num:
        return d
    if strategy == "median":
        fill = {c: v[0] for c, v in column_quantiles(d, num, [0.5]).items()}
    else:
        fill = d.agg(*[F.avg(c).alias(c) for c in num]).first().asDict()
    return d.select(*[F.coalesce(F.col(c), F.lit(fill[c]).cast(d.schema[c].dataType)).alias(c)
                      if c in num and fill[c] is not None else F.col(c) for c in d.columns])


def remove_outliers(df: DataFrame, columns: list[str], k: float = 1.5) -> DataFrame:
    """Winsorise to [q1 - k iqr, q3 + k iqr] (linear quartiles);
    unknown columns skipped; NULL stays NULL."""
    cols = [c for c in columns if c in df.columns]
    if not cols:
        return df
    qs = column_quantiles(df, cols, [0.25, 0.75])
    out = df
    for c in cols:
        if qs[c][0] is None:
            continue
        q1, q3 = qs[c]
        lo, hi = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
        out = out.withColumn(c, F.when(F.col(c).isNull(), F.col(c))
                             .otherwise(F.least(F.greatest(F.col(c).cast("double"), F.lit(lo)), F.lit(hi))))
    return out


def fix_types(df: DataFrame, date_cols=(), category_cols=()) -> DataFrame:
    """Parse dates (bad -> NULL), categories as strings."""
    out = df
    for c in date_cols:
        out = out.withColumn(c, F.try_to_timestamp(F.col(c).cast("string")))
    for c in category_cols:
        out = out.withColumn(c, F.col(c).cast("string"))
    return out


def drop_duplicates(df: DataFrame, subset: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Exact duplicates (hash aggregate) or first row per key by
    ``order`` (an aggregate, safe for hot keys)."""
    if subset is None:
        return df.distinct()
    return dedupe_first(df, subset, order or [c for c in df.columns if c not in subset])
