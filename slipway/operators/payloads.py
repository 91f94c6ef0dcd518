"""Landed API payloads, parsed by a declared schema, with bad records kept apart.

Each parser takes (payload_id, payload) rows and returns typed columns and ``bad``: the
payload text where it is no valid JSON of that form (its other columns are null), else null. No
payload is dropped and none fails the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields of the payloads.
NEWS = "articles array<struct<title:string,description:string,publishedAt:string,source:struct<name:string>>>"
WEATHER = "weather array<struct<main:string>>, wind struct<speed:double>"
RAW = "observations array<struct<date:string,value:string>>"


def _parsed(raw: DataFrame, schema: str) -> DataFrame:
    p = F.from_json("payload", f"{schema}, bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    return raw.select("*", p.alias("p")).withColumn("bad", F.when(F.col("payload").isNotNull(), F.col("p.bad")))


def _good(c: str) -> Column:
    return F.when(F.col("bad").isNull(), F.col(f"p.{c}"))


def parse_news(raw: DataFrame) -> DataFrame:
    """A row per article: payload_id, place (in the list), title, description, published_at, source, bad.
    A list without articles gives no row, a bad payload one."""
    p = _parsed(raw, NEWS).withColumn("list", _good("articles"))
    rows = p.filter("bad is null").select("payload_id", F.posexplode("list").alias("place", "a"), "bad")
    good = rows.select("payload_id", "place", "a.title", "a.description", F.col("a.publishedAt").alias("published_at"),
                       F.col("a.source.name").alias("source"), "bad")
    none = [F.lit(None).cast("string").alias(c) for c in ("title", "description", "published_at", "source")]
    return good.unionByName(p.filter("bad is not null").select("payload_id", F.lit(None).cast("int").alias("place"), *none, "bad"))


def parse_weather(raw: DataFrame, fetched_at: str = "fetched_at") -> DataFrame:
    """A row per payload: condition of the first entry, wind speed, day of the fetch; missing parts are null."""
    p = _parsed(raw, WEATHER)
    return p.select("payload_id", F.get(_good("weather"), F.lit(0))["main"].alias("condition"),
                    _good("wind")["speed"].alias("wind_speed"), F.to_date(fetched_at).alias("fetched_at"), "bad")


def parse_observations(raw: DataFrame) -> DataFrame:
    """Raw observations as they came: payload_id, date and value as text, bad."""
    p = _parsed(raw, RAW)
    good = p.filter("bad is null").select("payload_id", F.explode(_good("observations")).alias("o"), "bad")
    bad = p.filter("bad is not null").select("payload_id", *[F.lit(None).cast("string").alias(c) for c in ("date", "value")], "bad")
    return good.select("payload_id", "o.date", "o.value", "bad").unionByName(bad)
