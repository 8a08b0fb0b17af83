"""Table profiling, ordering and plain set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions.numeric import bucket
from clickloom.plans.joins import attach
from clickloom.plans.ordered import Position, ordered_features
from clickloom.plans.quantiles import grouped_quantiles
from clickloom.plans.splits import split_points
from clickloom.schema import LABEL, ROW_ID, SPLIT

QUARTILES = (0.25, 0.5, 0.75)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value, most frequent first."""
    counted = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), F.asc(col))


def describe(df: DataFrame, col: str, chunk_rows: int | None = None) -> DataFrame:
    """count, mean, std, min, exact quartiles, max of the non-null values, as one row."""
    x = F.col(col).cast("double")
    stats = df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                   F.min(x).alias("min"), F.max(x).alias("max"))
    quartiles = grouped_quantiles(df.select(x.alias("_x")), [], "_x", QUARTILES, chunk_rows).scalar()
    out = stats.withColumn("_q", quartiles)
    q = [F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(("q25", "q50", "q75"))]
    return out.select("count", "mean", "std", "min", *q, "max")


def duplicate_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows that repeat an earlier one."""
    per_row = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return per_row.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def bincount(df: DataFrame, code: str) -> DataFrame:
    """Count per integer code from 0 to the largest, zeros included. Negative codes are an error."""
    least, top = df.agg(F.min(code), F.max(code)).first()
    if least is not None and least < 0:
        raise ValueError(f"{code} holds the negative code {least}")
    codes = df.sparkSession.range(0, 0 if top is None else top + 1).withColumnRenamed("id", code)
    counted = df.where(F.col(code).isNotNull()).groupBy(F.col(code).cast("bigint").alias(code)).agg(F.count(F.lit(1)).alias("n"))
    return codes.join(counted, code, "left").select(code, F.coalesce("n", F.lit(0)).alias("n"))


def unique_rows(df: DataFrame, cols: Sequence[str], row_id: str = ROW_ID, chunk_rows: int | None = None) -> DataFrame:
    """Sorted distinct tuples: code, first row id, count."""
    splits = split_points(df, [], cols, chunk_rows, distinct=True)
    found = df.groupBy(*cols).agg(F.min(row_id).alias("first_row"), F.count(F.lit(1)).alias("n"))
    return ordered_features(found, [], cols, [Position("code")], splits=splits)


def unique_inverse(df: DataFrame, cols: Sequence[str], row_id: str = ROW_ID, chunk_rows: int | None = None) -> DataFrame:
    """Each row with the code of its tuple and the count of that tuple."""
    table = unique_rows(df, cols, row_id, chunk_rows).select(*cols, "code", "n")
    return attach(df.select(row_id, *cols), table, cols, chunk_rows=chunk_rows)


def class_histogram(df: DataFrame, col: str, bins: int, label: str = LABEL) -> DataFrame:
    """Rows per class and bin, over equal bins between the smallest and largest value."""
    x = F.col(col).cast("double")
    kept = df.where(F.col(col).isNotNull()).select(label, x.alias("_x"))
    edges = kept.agg(F.struct(F.min("_x").alias("low"), F.max("_x").alias("high"))).scalar()
    binned = kept.withColumn("_e", edges).withColumn("bin", bucket(F.col("_x"), F.col("_e.low"), F.col("_e.high"), bins))
    return binned.groupBy(label, "bin").agg(F.count(F.lit(1)).alias("n"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def sort_rows(df: DataFrame, *order: str) -> DataFrame:
    """Global sort; Spark range-partitions it."""
    return df.orderBy(*order)


def number_rows(df: DataFrame, order: Sequence[str], name: str = "position", chunk_rows: int | None = None) -> DataFrame:
    """0-based position of each row in `order`, which must be unique."""
    return ordered_features(df, [], order, [Position(name)], chunk_rows)


def head(df: DataFrame, n: int, order: Sequence[str] = (ROW_ID,)) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, n: int, order: Sequence[str] = (ROW_ID,)) -> DataFrame:
    return df.orderBy(*[F.desc(o) for o in order]).limit(n)


def union_splits(parts: dict[str, DataFrame]) -> DataFrame:
    """Row concatenation tagged with the name of the part; missing columns become null."""
    tagged = [df.withColumn(SPLIT, F.lit(name)) for name, df in parts.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def split_back(df: DataFrame, names: Sequence[str]) -> dict[str, DataFrame]:
    return {name: df.where(F.col(SPLIT) == name) for name in names}


def join_columns(df: DataFrame, other: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """Put the columns of `other` next to those of `df`, one to one by row id."""
    return df.join(other, row_id, "left").select(*df.columns, *[c for c in other.columns if c != row_id])


def merge_distinct(df: DataFrame, other: DataFrame, on: Sequence[str], marker: str = "dummy", chunk_rows: int | None = None) -> DataFrame:
    """Left merge with the distinct tuples of `other`, marking the rows that have a match."""
    return attach(df, other.select(*on).dropDuplicates().withColumn(marker, F.lit(1)), on, chunk_rows=chunk_rows)
