"""Exact quantiles of many columns at once, without gathering any column in one place.

Values are counted per ``(column, value)`` first, then running counts over the sorted
distinct values give every value the range of ranks it covers. Only the values that
cover a wanted rank are kept, so the result is as long as the list of probabilities.

Where a stated rank error will do, `sketch_quantiles` reads all columns in one scan with no sort.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.plans.joins import KeySample, attach
from clickloom.plans.ordered import Running, ordered_features
from clickloom.plans.splits import shuffle_partitions, split_points


def melt(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows ``(name, value)`` for the non-null values of `cols`, as doubles."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in cols])
    return df.select(F.explode(pairs).alias("p")).select("p.name", "p.value").where(F.col("value").isNotNull())


def running_counts(df: DataFrame, keys: Sequence[str], value: str, chunk_rows: int | None = None) -> DataFrame:
    """Per distinct `value` within `keys`: its count `n` and the count `before` it."""
    splits = split_points(df, keys, [value], chunk_rows, distinct=True)
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    out = ordered_features(counted, keys, [value], [Running("before", F.col("n"), "sum")], splits=splits)
    return out.withColumn("before", F.coalesce("before", F.lit(0)))


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float] | int, chunk_rows: int | None = None
) -> DataFrame:
    """Linear-interpolated quantiles per group: `keys`, `quantiles` (array in the order of `probs`).

    A number in place of `probs` means that many, evenly spaced from 0 to 1. Null values
    are left out; keys must not be null. At most two ranks per probability and group are gathered.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias(value))
    ranked = running_counts(rows, keys, value, chunk_rows)
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    if keys:
        ranked = attach(ranked, totals, keys, KeySample(rows, keys, chunk_rows))
    else:
        ranked = ranked.withColumn("_total", totals.scalar())
    last = F.col("_total") - 1
    if isinstance(probs, int):
        # The value covers ranks before .. before + n - 1, so only nearby steps of the grid can fall on it.
        steps = max(probs - 1, 1)
        first_step = F.greatest(F.floor((F.col("before") - 1) * steps / F.greatest(last, F.lit(1))), F.lit(0))
        last_step = F.least(F.ceil((F.col("before") + F.col("n")) * steps / F.greatest(last, F.lit(1))), F.lit(probs - 1))
        near = F.when(first_step <= last_step, F.sequence(first_step, last_step))
        picked = ranked.select(*keys, value, "before", "n", last.alias("_last"), F.explode(near).alias("i"))
        picked = picked.withColumn("_rank", F.col("_last") * F.col("i") / steps)
    else:
        wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
        picked = ranked.select(*keys, value, "before", "n", last.alias("_last"), F.explode(wanted).alias("w"))
        picked = picked.select(*keys, value, "before", "n", F.col("w.i").alias("i"), (F.col("_last") * F.col("w.p")).alias("_rank"))
    covers = lambda rank: (rank >= F.col("before")) & (rank < F.col("before") + F.col("n"))
    rank = F.col("_rank")
    picked = picked.where(covers(F.floor(rank)) | covers(F.ceil(rank)))
    low = F.max(F.when(covers(F.floor(rank)), F.col(value)))
    high = F.max(F.when(covers(F.ceil(rank)), F.col(value)))
    frac = F.max(rank - F.floor(rank))
    per_prob = picked.groupBy(*keys, "i").agg((low + (high - low) * frac).alias("q"))
    item = F.sort_array(F.collect_list(F.struct("i", "q")))
    return per_prob.groupBy(*keys).agg(F.transform(item, lambda s: s["q"]).alias("quantiles"))


def sketch_size(rank_error: float) -> int:
    """Size parameter of a KLL sketch whose rank error stays below `rank_error` with 99% confidence (2.296 / k^0.9021)."""
    k = math.ceil((2.296 / rank_error) ** (1 / 0.9021))
    if not 0 < rank_error < 1 or k > 65535:
        raise ValueError(f"rank error {rank_error} is not between 0.0001 and 1")
    return max(k, 8)


def sketch_quantiles(df: DataFrame, cols: Sequence[str], probs: int, rank_error: float = 0.0005) -> DataFrame:
    """One row `(name, n, quantiles)` per column: quantiles at `probs` even steps from 0 to 1, as values of the column.

    Each quantile's rank is off by at most `rank_error` of the rows (99% confidence); the first and the last are exact. Nulls
    and NaN are left out; a column without values has `quantiles` null.

    Every partition builds one sketch per column, so one row leaves it. Rows merge by slices first and then, melted, one
    column in a task: at most `shuffle partitions` sketches meet there, whatever the number of input partitions.
    """
    size, slices = sketch_size(rank_error), shuffle_partitions(df.sparkSession)
    values = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"__c{i}") for i, c in enumerate(cols)]
    placed = df.select(F.pmod(F.spark_partition_id(), F.lit(slices)).alias("__slice"), *values)
    built = placed.groupBy("__slice").agg(*[F.kll_sketch_agg_double(f"__c{i}", size).alias(f"__c{i}") for i in range(len(cols))])
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"__c{i}").alias("s")) for i, c in enumerate(cols)])
    melted = built.select(F.explode(pairs).alias("p")).select("p.name", "p.s")
    merged = melted.groupBy("name").agg(F.kll_merge_agg_double("s", size).alias("s"))
    merged = merged.select("name", "s", F.kll_sketch_get_n_double("s").alias("n"))
    grid = F.array(*[F.lit(i / max(probs - 1, 1)) for i in range(probs)])
    return merged.select("name", "n", F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("s", grid)).alias("quantiles"))
