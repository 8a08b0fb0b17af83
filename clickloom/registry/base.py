"""Named queries and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.calendar import epoch_between
from clickloom.operators.keys import encode_all
from clickloom.plans.joins import KeySample
from clickloom.plans.splits import shuffle_partitions
from clickloom.schema import DICTIONARY_KEYS, VALID_HOURS_SHORT
from clickloom.session import tune
from clickloom.sources.scans import EVENTS_ORIGIN, load_clicks, raw_clicks, read_table, with_times
from clickloom.sources.store import cache_path, is_written, load_bucketed, load_table, release, save_bucketed, save_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# First second of the scoring period: 20 days after the origin.
SUPPLEMENT_FROM = 20 * 86400
HOUR = 3600
#: Part of the name of the stored base table; raise it when its columns change.
BASE_VERSION = 2


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


CLICKS = """
raw AS (
  SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events
),
timed AS (
  SELECT event_id AS row_id, user_id AS ip, k % 10 AS app, k % 3 AS device,
         CAST(floor(value) AS INTEGER) % 7 AS os, k AS channel, ts AS click_time,
         CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS is_attributed,
         CAST(isodow(ts) - 1 AS INTEGER) AS dayofweek, CAST(hour(ts) AS INTEGER) AS hourofday,
         CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS epoch_time
  FROM raw
),
clicks AS (
  SELECT *, CAST(epoch_time % 60 AS INTEGER) AS seconds, epoch_time // 60 AS epoch_minute,
         CAST((epoch_time // 60) % 60 AS INTEGER) AS minutes, epoch_time // 3600 AS epoch_hour,
         CASE WHEN (dayofweek = 3 AND hourofday < 4) OR dayofweek < 3 THEN 'tr'
              WHEN dayofweek = 3 AND hourofday IN (4, 5, 9, 10, 13, 14) THEN 'val' END AS split
  FROM timed
),
coded AS (
  SELECT *, dense_rank() OVER (ORDER BY ip, device, os) - 1 AS ip_device_os,
         dense_rank() OVER (ORDER BY ip, device, os, app) - 1 AS ip_device_os_app,
         dense_rank() OVER (ORDER BY ip, device, os, app, channel) - 1 AS ip_device_os_app_channel
  FROM clicks
),
tr AS (SELECT * FROM clicks WHERE split = 'tr'),
val AS (SELECT * FROM clicks WHERE split = 'val'),
both_splits AS (SELECT * FROM clicks WHERE split IS NOT NULL),
train AS (SELECT * FROM clicks WHERE epoch_time < 1728000),
supp AS (SELECT * FROM clicks WHERE epoch_time >= 1728000),
test AS (SELECT * FROM supp WHERE hourofday IN (4, 9, 14))
"""


def sql(body: str, *ctes: str) -> str:
    """A query over the click views, with further views before it."""
    return "WITH " + ",".join([CLICKS, *ctes]) + "\n" + body


def r6(c: Column) -> Column:
    return F.round(c, 6)


def stack(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in parts.items():
        tagged = df.withColumn("part", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def with_hour(log: DataFrame) -> DataFrame:
    return log.withColumn("epoch_hour", F.floor(F.col("epoch_time") / HOUR))


def clicks(spark: SparkSession, sf: str) -> DataFrame:
    return with_hour(load_clicks(tune(spark), sf))


def develop(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(tr, val)"""
    log = clicks(spark, sf)
    return log.where(F.col("split") == "tr"), log.where(F.col("split") == "val")


def contest(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, supplement, test): the scoring period is the supplement, some of its hours the test."""
    log, at = clicks(spark, sf), F.col("click_time")
    supp = log.where(epoch_between(at, SUPPLEMENT_FROM, None, EVENTS_ORIGIN))
    return log.where(epoch_between(at, None, SUPPLEMENT_FROM - 1, EVENTS_ORIGIN)), supp, supp.where(F.col("hourofday").isin(VALID_HOURS_SHORT))


#: Codes of tuples that begin with ip, by which the base table is stored in buckets.
BUCKETED_BY, DETERMINE_IT = "ip", ["_".join(keys) for keys in DICTIONARY_KEYS]


def coded(spark: SparkSession, sf: str) -> DataFrame:
    """The base table with composite codes, computed once per state of the events and loaded from then on.

    It is stored in buckets by ip, unless one ip has so many rows that its bucket would be a task too long.
    """
    buckets = shuffle_partitions(tune(spark))
    params = {"keys": DICTIONARY_KEYS, "by": BUCKETED_BY, "buckets": buckets, "version": BASE_VERSION}
    path = cache_path(spark, "base", params, [f"{sf}/events.parquet"])
    plain = f"{path}-plain"
    if is_written(spark, plain):
        return load_table(spark, plain)
    if not is_written(spark, path):
        # What follows from the time is added after the shuffles, which move the raw columns only.
        log, columns = raw_clicks(read_table(spark, sf, "events")), [*clicks(spark, sf).columns, *DETERMINE_IT]
        base, details = encode_all(log, [log], DICTIONARY_KEYS), lambda df: with_hour(with_times(df)).select(*columns)
        release(spark)
        if KeySample(log, [BUCKETED_BY]).hot([BUCKETED_BY]):
            save_table(details(base), plain)
            release(spark)
            return load_table(spark, plain)
        save_bucketed(base, path, BUCKETED_BY, buckets, details)
        release(spark)
    return load_bucketed(spark, path, BUCKETED_BY, buckets)
