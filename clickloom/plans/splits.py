"""Split points that cut long ordered groups into pieces of bounded size.

A window partitioned by a key puts all rows of that key into one task. When one
key holds a large share of the log that task never ends. Here a narrow sample of
``(keys, order)`` finds the keys with too many rows and points that cut them into
runs of about `chunk_rows` rows. The points are plain values in the plan, so every
branch and every retry of a task sees the same cuts; results never depend on
where the cuts fall.

Bounds: pieces <= rows / chunk_rows <= PIECES_PER_PARTITION * shuffle partitions,
so the tables of split points and of per-piece totals may be broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = "__chunk"
UNSPLIT = -1
MIN_CHUNK_ROWS = 1_000_000
MIN_GLOBAL_CHUNK_ROWS = 1  # no floor: one plan for tables of every size
PIECES_PER_PARTITION = 2
SAMPLES_PER_PIECE = 60


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def piece_rows(spark: SparkSession, rows: int, floor: int, wanted: int | None = None) -> int:
    """Rows per piece: what the caller wants, or enough that pieces stay in proportion to the partitions."""
    if wanted:
        return wanted
    return max(floor, math.ceil(rows / (PIECES_PER_PARTITION * shuffle_partitions(spark))))


def is_null_key(keys: Sequence[str]) -> Column:
    """True where any key column is null; such rows belong to no group."""
    cond = F.lit(False)
    for k in keys:
        cond = cond | F.col(k).isNull()
    return cond


@dataclass(frozen=True)
class SplitPoints:
    """Cuts for `keys` groups ordered by `order`. `table` is None when nothing is long enough to cut."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    table: DataFrame | None = None
    depth: int = 0
    spread_nulls: int = 0

    @property
    def columns(self) -> list[str]:
        return [CHUNK] if self.table is not None or self.spread_nulls else []

    def assign(self, df: DataFrame, only_cut: bool = False) -> DataFrame:
        """Add the piece number: 0.. for cut groups in order, -1 for whole groups, below that for null keys.

        With `only_cut`, just the rows of cut groups are kept. Callers use it rather than
        a filter on the number, which the optimizer would copy into every search step.
        """
        if not self.columns:
            return df
        names = df.columns
        chunk = F.lit(UNSPLIT)
        if self.table is not None:
            if self.keys:
                df = df.join(F.broadcast(self.table), list(self.keys), "inner" if only_cut else "left")
            else:
                df = df.withColumn("__cuts", self.table.scalar())
            df = df.select(*names, "__cuts", F.struct(*self.order).alias("__at"), F.lit(0).alias("__pos"))
            # Binary search, one step per projection, so that it compiles with the rest of the stage.
            for step in (2**i for i in reversed(range(self.depth))):
                hit = F.get("__cuts", F.col("__pos") + (step - 1)) <= F.col("__at")
                df = df.select(
                    *names, "__cuts", "__at", (F.col("__pos") + F.when(hit, step).otherwise(0)).alias("__pos")
                )
            chunk = F.when(F.col("__cuts").isNotNull(), F.col("__pos")).otherwise(chunk)
        if self.spread_nulls and not only_cut:
            spread = (F.lit(UNSPLIT - 1) - F.pmod(F.xxhash64(*self.order), F.lit(self.spread_nulls))).cast("int")
            chunk = F.when(is_null_key(self.keys), spread).otherwise(chunk)
        return df.select(*names, chunk.alias(CHUNK))


def split_points(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk_rows: int | None = None,
    distinct: bool = False,
) -> SplitPoints:
    """Find split points from a sample of `df`.

    With `distinct` the caller will number the distinct `(keys, order)` tuples of `df`
    (it groups by them first), so distinct tuples are what gets counted and sampled.
    With no keys the whole table is one ordered group.
    """
    keys, order = tuple(keys), tuple(order)
    spark = df.sparkSession
    narrow = df.select(*dict.fromkeys([*keys, *order]))
    floor = MIN_CHUNK_ROWS if keys else MIN_GLOBAL_CHUNK_ROWS
    rows = df.count()
    if distinct and rows > (chunk_rows or floor):
        rows = narrow.agg(F.approx_count_distinct(F.xxhash64(*narrow.columns))).first()[0]
    size = piece_rows(spark, rows, floor, chunk_rows)
    if rows <= size:
        return SplitPoints(keys, order)

    fraction = min(1.0, SAMPLES_PER_PIECE * math.ceil(rows / size) / rows)
    if distinct:
        # Sampling by hash of the tuple thins the log before the distinct, not after it.
        slots = 2**31
        hashed = F.pmod(F.xxhash64(*narrow.columns), F.lit(slots))
        sample = narrow.where(hashed < int(fraction * slots)).distinct()
    else:
        sample = narrow.sample(fraction, seed=17)
    found = sample.orderBy(*narrow.columns).collect()

    cuts: list[tuple] = []
    spread_nulls = 0
    for key, group in groupby(found, key=lambda r: tuple(r[k] for k in keys)):
        points = [tuple(r[o] for o in order) for r in group]
        pieces = round(len(points) / fraction / size)
        if pieces < 2:
            continue
        if any(k is None for k in key):
            spread_nulls += pieces
            continue
        picked = dict.fromkeys(points[i * len(points) // pieces] for i in range(1, pieces))
        cuts.append((*key, list(picked)))
    if not cuts:
        return SplitPoints(keys, order, spread_nulls=spread_nulls)

    point = T.StructType([T.StructField(o, df.schema[o].dataType) for o in order])
    schema = T.StructType(
        [T.StructField(k, df.schema[k].dataType) for k in keys] + [T.StructField("__cuts", T.ArrayType(point))]
    )
    depth = max(len(c[-1]) for c in cuts).bit_length()
    return SplitPoints(keys, order, spark.createDataFrame(cuts, schema), depth, spread_nulls)
