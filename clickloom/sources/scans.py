"""Reading click logs and deriving one from an event stream table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.functions.calendar import time_details, with_calendar
from clickloom.operators.splits import tag_split
from clickloom.plans.splits import CHUNK, split_points
from clickloom.schema import CLICK_SCHEMA, LABEL, ROW_ID

EVENTS_ORIGIN = dt.datetime(2024, 1, 1)


def read_clicks_csv(
    spark: SparkSession, path: str, schema: T.StructType = CLICK_SCHEMA, columns: Sequence[str] | None = None
) -> DataFrame:
    """Typed scan of a headed CSV, optionally of some columns only. A malformed row fails the job."""
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    return df.select(*columns) if columns else df


def read_pruned(
    spark: SparkSession, paths: Mapping[str, str], columns: Sequence[str]
) -> dict[str, DataFrame]:
    """The same few columns of several Parquet tables (train, test, supplement)."""
    return {name: spark.read.parquet(path).select(*columns) for name, path in paths.items()}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def skip_limit(
    df: DataFrame, skip: int, limit: int | None = None, order: Sequence[str] = (ROW_ID,), chunk_rows: int | None = None
) -> DataFrame:
    """Rows after the first `skip`, at most `limit` of them, in `order`.

    Rows are counted per piece of the order; only pieces that overlap the slice are then read, by a range of the
    first order column, and sorted. No task sees more than one piece.
    """
    order = list(order)
    splits = split_points(df, [], order, chunk_rows)
    pieces = splits.assign(df) if splits.columns else df.withColumn(CHUNK, F.lit(0))
    end, kept, before = None if limit is None else skip + limit, {}, 0
    for r in sorted(pieces.groupBy(CHUNK).count().collect(), key=lambda r: r[CHUNK]):  # one row per piece
        if before + r["count"] > skip and (end is None or before < end):
            kept[r[CHUNK]] = before
        before += r["count"]
    if not kept:
        return df.where(F.lit(False))
    if splits.columns:
        cuts, low, high = splits.table.first()["__cuts"], min(kept), max(kept)
        first = F.col(order[0])
        near = df
        if low > 0 and cuts[low - 1][0] is not None:
            near = near.where(first >= cuts[low - 1][0])
        if high < len(cuts) and cuts[high][0] is not None:
            near = near.where(first.isNull() | (first <= cuts[high][0]) if low == 0 else first <= cuts[high][0])
        pieces = splits.assign(near).where(F.col(CHUNK).isin(*kept))
    starts = F.create_map(*[F.lit(x) for pair in kept.items() for x in pair])
    place = F.row_number().over(Window.partitionBy(CHUNK).orderBy(*order)) - 1 + F.element_at(starts, F.col(CHUNK))
    wanted = F.col("_position") >= skip
    if end is not None:
        wanted = wanted & (F.col("_position") < end)
    return pieces.withColumn("_position", place).where(wanted).select(*df.columns)


def raw_clicks(events: DataFrame) -> DataFrame:
    """Click log view of an event table: ids from the payload and the value, label from the event type."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_id").alias(ROW_ID),
        F.col("user_id").alias("ip"),
        (k % 10).alias("app"),
        (k % 3).alias("device"),
        (F.floor("value").cast("int") % 7).alias("os"),
        k.alias("channel"),
        F.col("ts").alias("click_time"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias(LABEL),
    )


def with_times(clicks: DataFrame, origin: dt.datetime = EVENTS_ORIGIN) -> DataFrame:
    """All that follows from the click time: calendar and epoch parts, and the split."""
    return tag_split(time_details(with_calendar(clicks), origin=origin))


def clicks_from_events(events: DataFrame, origin: dt.datetime = EVENTS_ORIGIN) -> DataFrame:
    return with_times(raw_clicks(events), origin)


def load_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clicks_from_events(read_table(spark, sf_dir, "events"))
