"""Column-level building blocks: projection, casts, fills, ratios, indicators."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.schema import LABEL, ROW_ID

# Widths of the unsigned types of the source files.
UNSIGNED_RANGE = {"uint8": 2**8, "uint16": 2**16, "uint32": 2**32}


def project(df: DataFrame, feats: Sequence[str]) -> DataFrame:
    """The feature list, in order; an unknown name fails when the plan is built."""
    return df.select(*feats)


def drop(df: DataFrame, *cols: str) -> DataFrame:
    return df.drop(*cols)


def constant_label(df: DataFrame, value: int | None = 0, label: str = LABEL) -> DataFrame:
    """Label for rows that have none: a constant, or null."""
    return df.withColumn(label, F.lit(value).cast("int"))


def narrow(col: Column, width: str, wrap: bool = False) -> Column:
    """Smaller unsigned type, held in a signed one that fits it.

    Values out of range fail under ANSI mode, or wrap around when `wrap` is set.
    """
    holder = {"uint8": "smallint", "uint16": "int", "uint32": "bigint"}[width]
    limit = UNSIGNED_RANGE[width]
    if wrap:
        return F.pmod(col.cast("bigint"), F.lit(limit)).cast(holder)
    inside = (col >= 0) & (col < limit)
    return F.when(inside | col.isNull(), col).otherwise(F.raise_error(F.lit(f"value outside {width}"))).cast(holder)


def fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Sentinels for missing values."""
    return df.fillna(dict(values))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, null where the denominator is zero."""
    return F.try_divide(numerator, denominator)


def missing_indicator(col: Column) -> Column:
    return col.isNull().cast("int")


def mask(df: DataFrame, condition: Column) -> DataFrame:
    """Rows where the mask is true."""
    return df.where(condition)


def set_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add or replace a column. It is computed from the row itself, so lengths always agree."""
    return df.withColumn(name, value)


def get_column(df: DataFrame, name: str, row_id: str = ROW_ID) -> DataFrame:
    return df.select(row_id, name)


def get_row(df: DataFrame, value: int, row_id: str = ROW_ID) -> DataFrame:
    """One row by its id; the equality reaches the scan."""
    return df.where(F.col(row_id) == value)


def iter_columns(df: DataFrame, row_id: str = ROW_ID) -> Iterator[tuple[str, DataFrame]]:
    """(name, column) pairs, each column still carrying the row id."""
    for name in df.columns:
        if name != row_id:
            yield name, df.select(row_id, name)
