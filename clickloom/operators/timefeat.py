"""Counts and gaps per (key, time), and their transfer from the supplement to the test rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.operators.counts import time_pair_counts, union_logs
from clickloom.plans.joins import attach, attach_all
from clickloom.plans.ordered import Shift, ordered_features
from clickloom.plans.splits import is_null_key, split_points
from clickloom.schema import ROW_ID, TIME, as_list, feature_name

# Fixed value: gap given to the first time of a key.
FIRST_GAP = 10**6


def time_table(
    dfs: Sequence[DataFrame], cols, time: str = TIME, na_val: int = FIRST_GAP, chunk_rows: int | None = None
) -> DataFrame:
    """Per distinct (key, time): rows there, and the gap to the previous distinct time of the key."""
    cols = as_list(cols)
    rows = union_logs(dfs, [*cols, time]).where(~is_null_key([*cols, time]))
    splits = split_points(rows, cols, [time], chunk_rows, distinct=True)
    table = ordered_features(time_pair_counts(dfs, cols, time), cols, [time], [Shift("_before", F.col(time))], splits=splits)
    gap = F.coalesce(F.col(time) - F.col("_before"), F.lit(na_val))
    return table.withColumn(feature_name(cols, "timediff"), gap).drop("_before")


def time_tables(
    fit_on: Sequence[DataFrame],
    key_sets: Sequence[str | Sequence[str]],
    time: str = TIME,
    na_val: int = FIRST_GAP,
    wrap: bool = False,
    chunk_rows: int | None = None,
) -> list[tuple[list[str], DataFrame]]:
    """(join keys, time table) per key set; with `wrap` counts wrap at 256."""
    tables = []
    for cols in key_sets:
        table = time_table(fit_on, cols, time, na_val, chunk_rows)
        if wrap:
            count = feature_name(cols, "timecount")
            table = table.withColumn(count, F.pmod(F.col(count), F.lit(256)))
        tables.append(([*as_list(cols), time], table))
    return tables


def add_time_features(
    df: DataFrame,
    fit_on: Sequence[DataFrame],
    key_sets: Sequence[str | Sequence[str]],
    time: str = TIME,
    na_val: int = FIRST_GAP,
    wrap: bool = False,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Attach `<key>_timecount` and `<key>_timediff` for each key set."""
    return attach_all(df, time_tables(fit_on, key_sets, time, na_val, wrap, chunk_rows), chunk_rows)


def from_supplement(
    test: DataFrame,
    supp: DataFrame,
    match: Sequence[str],
    take: Sequence[str],
    first_by: Sequence[str] = (ROW_ID,),
    chunk_rows: int | None = None,
) -> DataFrame:
    """Values of the first supplement row with equal `match` columns; every test row is kept once."""
    values = F.struct(*take)
    first = supp.where(~is_null_key(match)).groupBy(*match).agg(F.min_by(values, F.struct(*first_by)).alias("_v"))
    return attach(test, first.select(*match, *[F.col("_v")[c].alias(c) for c in take]), match, chunk_rows=chunk_rows)
