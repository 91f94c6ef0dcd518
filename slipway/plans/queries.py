"""Registered queries: one per operator, each (spark, sf_dir) -> DataFrame.

Harness rules applied by :func:`report`: doubles rounded to 6 digits,
timestamps rendered as 'yyyy-MM-dd HH:mm:ss' text, dates as 'yyyy-MM-dd', everything aliased.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slipway.sources.views import Domain

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def report(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return df.select(*cols)


_DOMAINS: dict[tuple[str, str], Domain] = {}


def dom(spark: SparkSession, sf_dir: str) -> Domain:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _DOMAINS:
        _DOMAINS[key] = Domain(spark, sf_dir)
    return _DOMAINS[key]


# import the query modules so they register themselves
def load_all() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from slipway.plans import q_core, q_eval, q_models, q_panel, q_stores, q_text  # noqa: F401
    return dict(REGISTRY)
