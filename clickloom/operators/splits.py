"""Temporal and hashed splits, folds, batches and entity sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.plans.ordered import Position, ordered_features
from clickloom.schema import ROW_ID, SPLIT, VALID_HOURS

THURSDAY = 3


def is_train_time() -> Column:
    """Monday to Thursday 04:00 (Thursday is day 3)."""
    return ((F.col("dayofweek") == THURSDAY) & (F.col("hourofday") < 4)) | (F.col("dayofweek") < THURSDAY)


def is_valid_time(hours: Sequence[int] = VALID_HOURS) -> Column:
    """The hold-out hours of Thursday."""
    return (F.col("dayofweek") == THURSDAY) & F.col("hourofday").isin(list(hours))


def tag_split(df: DataFrame, hours: Sequence[int] = VALID_HOURS) -> DataFrame:
    """`split` = 'tr', 'val', or null for rows in neither."""
    return df.withColumn(SPLIT, F.when(is_train_time(), "tr").when(is_valid_time(hours), "val"))


def split_complement(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that meet the condition, all other rows); a null condition counts as not met."""
    met = F.coalesce(condition, F.lit(False))
    return df.where(met), df.where(~met)


def hash_fraction(seed: int, *cols: str) -> Column:
    """Repeatable number in [0, 1) from the values of the row."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1_000_000)) / 1_000_000


def random_split(
    df: DataFrame, fraction: float, seed: int = 786, by: str = ROW_ID, draw: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Seeded split by row id; the same rows whatever the partitioning. `draw` replaces the hash with a number in [0, 1)."""
    return split_complement(df, (hash_fraction(seed, by) if draw is None else draw) < fraction)


def kfold(k: int, seed: int | None = 786, by: str = ROW_ID) -> Column:
    """Fold number 0..k-1; with no seed the row id itself is dealt out in turn."""
    source = F.col(by) if seed is None else F.xxhash64(by, F.lit(seed))
    return F.pmod(source, F.lit(k)).cast("int")


def shuffled_batches(
    df: DataFrame,
    batch_size: int,
    epoch: int = 0,
    seed: int = 786,
    keep_short: bool = False,
    shuffle: bool = True,
    by: str = ROW_ID,
    draw: Column | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Add `batch_id`: rows in an order drawn anew for each epoch, cut into batches of equal size.

    The last batch is dropped when it is short, unless `keep_short` is set. `draw`
    replaces the hash that orders the rows.
    """
    if draw is None:
        draw = F.xxhash64(by, F.lit(epoch), F.lit(seed)) if shuffle else F.lit(0).cast("bigint")
    drawn = df.withColumn("_draw", draw)
    placed = ordered_features(drawn, [], ["_draw", by], [Position("_position")], chunk_rows)
    batch = F.floor(F.col("_position") / batch_size)
    placed = placed.withColumn("batch_id", batch)
    if not keep_short:
        full = df.agg(F.floor(F.count(F.lit(1)) / batch_size)).scalar()
        placed = placed.where(F.col("batch_id") < full)
    return placed.drop("_draw", "_position")


def sample_entity(df: DataFrame, key: str, seed: int = 786, draw: Column | None = None) -> DataFrame:
    """All rows of one entity: the one with the smallest draw (by default a seeded hash of the key)."""
    draw = F.xxhash64(key, F.lit(seed)) if draw is None else draw
    drawn = df.where(F.col(key).isNotNull()).agg(F.min_by(key, draw)).scalar()
    return df.where(F.col(key) == drawn)
