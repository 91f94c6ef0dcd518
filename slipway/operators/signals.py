"""External-signal operators: daily volatility of a price series (W15/W16),
landed JSON payload parsing (S17/S18), state x date replication (J10).

The volatility series is one row per calendar day, so its windows run over
the calendar (a bounded number of rows: days in the span), not over data
rows; the heavy part (the price series itself) is an aggregate of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VOL_WINDOW = 14


def fill_forward_back(grid: DataFrame, order: str, col: str, part: list[str] | None = None) -> DataFrame:
    """Forward fill, then back fill what is still missing at the start."""
    w = Window.partitionBy(*(part or [])).orderBy(order)
    ff = F.last(col, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    bf = F.first(col, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return grid.withColumn(col, F.coalesce(ff, bf))


def daily_volatility(prices: DataFrame, days: DataFrame, window: int = VOL_WINDOW) -> DataFrame:
    """Reindex to every day, ffill/bfill, pct change, rolling sample std
    (``window`` rows, at least 2 values), min-max scaled, NULL -> median of
    the scaled series, clipped to [0, 1], rounded to 4 digits."""
    g = days.select(F.col("d").alias("signal_date")).join(
        prices.select(F.col("d").alias("signal_date"), "value"), "signal_date", "left")
    g = fill_forward_back(g, "signal_date", "value")
    w = Window.orderBy("signal_date")
    g = g.withColumn("ret", F.try_divide(F.col("value"), F.lag("value", 1).over(w)) - 1)
    fr = w.rowsBetween(-(window - 1), 0)
    g = g.withColumn("vol", F.when(F.count("ret").over(fr) >= 2, F.stddev_samp("ret").over(fr)))
    st = g.agg(F.min("vol").alias("lo"), F.max("vol").alias("hi")).first()
    lo, hi = st["lo"], st["hi"]
    if lo is not None and hi is not None and hi > lo:
        scaled = (F.col("vol") - F.lit(lo)) / F.lit(hi - lo)
    else:
        scaled = F.col("vol") * 0
    g = g.withColumn("scaled", scaled)
    med = g.agg(F.median("scaled")).first()[0]
    filled = F.coalesce(F.col("scaled"), F.lit(med)) if med is not None else F.col("scaled")
    out = F.bround(F.least(F.greatest(filled, F.lit(0.0)), F.lit(1.0)), 4)
    return g.select("signal_date", out.alias("value"))


def replicate_to_states(series: DataFrame, states: DataFrame, source: str = "commodity") -> DataFrame:
    """A national daily series copied to every state (states are a
    dimension of bounded size: broadcast), tagged as a real series."""
    return (series.join(F.broadcast(states.select("seller_state").distinct()), how="inner")
            .select("seller_state", "signal_date", F.lit(source).alias("source"), "value",
                    F.lit(0).alias("is_synthetic")))


OBS_SCHEMA = "observations array<struct<date:string, value:string>>"


def parse_series_payload(raw: DataFrame, col: str = "payload") -> DataFrame:
    """``{"observations": [{"date", "value"}]}`` -> (date, value);
    the missing marker '.' (or any non-number) becomes NULL and is dropped."""
    p = raw.select(F.explode(F.from_json(col, OBS_SCHEMA)["observations"]).alias("o"))
    out = p.select(F.to_date("o.date").alias("date"), F.col("o.value").try_cast("double").alias("value"))
    return out.dropna()


def parse_props(events: DataFrame) -> DataFrame:
    """Nested JSON field access on the events ``props`` payload."""
    return events.select("event_id", "event_type",
                         F.get_json_object("props", "$.k").try_cast("long").alias("k"))
