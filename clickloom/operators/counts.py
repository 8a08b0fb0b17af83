"""Count maps over several logs and their joins back to rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.columns import ratio
from clickloom.plans.joins import attach, attach_all
from clickloom.plans.splits import is_null_key
from clickloom.schema import COUNT_KEYS, TIME, as_list, feature_name
from clickloom.sources.store import roundtrip


def union_logs(dfs: Sequence[DataFrame], cols: Sequence[str]) -> DataFrame:
    out = dfs[0].select(*cols)
    for df in dfs[1:]:
        out = out.unionByName(df.select(*cols))
    return out


def count_map(dfs: Sequence[DataFrame], cols, name: str | None = None) -> DataFrame:
    """Rows per key tuple over all given logs."""
    cols = as_list(cols)
    rows = union_logs(dfs, cols).where(~is_null_key(cols))
    return rows.groupBy(*cols).agg(F.count(F.lit(1)).alias(name or feature_name(cols, "cnt")))


def grouped(dfs: Sequence[DataFrame], key_sets: Sequence[Sequence[str]], aggs: Sequence[Column], more: Sequence[str] = ()) -> DataFrame:
    """`aggs` per tuple of every key set, told apart by `_set`: one scan, one expansion, one aggregate and one exchange.

    `more` names the columns that the aggregates read.
    """
    cols = list(dict.fromkeys(c for keys in key_sets for c in keys))
    sets = list(dict.fromkeys(tuple(c for c in cols if c in keys) for keys in key_sets))
    rows = union_logs(dfs, list(dict.fromkeys([*cols, *more])))
    return rows.groupingSets(sets, *cols).agg(F.grouping_id().alias("_set"), *aggs)


def set_id(cols: Sequence[str], keys: Sequence[str]) -> int:
    """What `grouping_id` says of a key set among `cols`: a bit per column, set where the column is not a key."""
    return sum((c not in keys) << i for i, c in enumerate(reversed(cols)))


class GroupedMaps:
    """`grouped` written by key set, so that each map is read alone and a join sees its size."""

    def __init__(self, dfs: Sequence[DataFrame], key_sets: Sequence[Sequence[str]], aggs: Sequence[Column], more: Sequence[str] = ()):
        self.cols = list(dict.fromkeys(c for keys in key_sets for c in keys))
        self.stored = roundtrip(grouped(dfs, key_sets, aggs, more), "grouped-maps", partition_by="_set")

    def of(self, keys: Sequence[str]) -> DataFrame:
        """The rows of one key set, without null keys."""
        return self.stored.where((F.col("_set") == set_id(self.cols, keys)) & ~is_null_key(keys))


def count_maps(dfs: Sequence[DataFrame], key_sets: Sequence[Sequence[str]] = COUNT_KEYS) -> list[tuple[list[str], DataFrame]]:
    """(keys, count map) per key set, from one pass over the logs."""
    key_sets = [as_list(cols) for cols in key_sets]
    maps = GroupedMaps(dfs, key_sets, [F.count(F.lit(1)).alias("_rows")])
    return [(keys, maps.of(keys).select(*keys, F.col("_rows").alias(feature_name(keys, "cnt")))) for keys in key_sets]


def add_count_maps(
    df: DataFrame, fit_on: Sequence[DataFrame], key_sets: Sequence[Sequence[str]] = COUNT_KEYS, chunk_rows: int | None = None
) -> DataFrame:
    """Attach the row count of each key set."""
    return attach_all(df, count_maps(fit_on, key_sets), chunk_rows)


def add_counts_in_place(
    log: DataFrame, by: str, determines: Sequence[str], key_sets: Sequence[Sequence[str]] = COUNT_KEYS, chunk_rows: int | None = None
) -> DataFrame:
    """`add_count_maps` of a log over itself, for a log stored in buckets by `by`.

    A key set that holds `by`, or a column whose value determines that of `by` (such as a code of a tuple with
    it), is grouped and joined with `by` in front: equal keys are in one bucket, so neither the log nor the map
    moves. The other key sets are counted in one pass, as `add_count_maps` does.
    """
    local = [as_list(keys) for keys in key_sets if {by, *determines} & set(as_list(keys))]
    rest = [as_list(keys) for keys in key_sets if as_list(keys) not in local]
    made = [feature_name(keys, "cnt") for keys in key_sets]
    log = log.drop(*made)
    out = log
    # Longer key sets last: the sort of one join is the beginning of the next one's.
    for keys in sorted(local):
        ahead, name = [by, *[k for k in keys if k != by]], feature_name(keys, "cnt")
        out = out.join(count_map([log], ahead, name), ahead, "left").select(*out.columns, name)
    if rest:
        out = attach_all(out, count_maps([log], rest), chunk_rows)
    return out.select(*log.columns, *made)


def add_named_counts(
    df: DataFrame, fit_on: Sequence[DataFrame], key_sets: Mapping[str, Sequence[str]], chunk_rows: int | None = None
) -> DataFrame:
    """Attach row counts under given names."""
    maps = count_maps(fit_on, list(key_sets.values()))
    named = [(keys, m.withColumnRenamed(feature_name(keys, "cnt"), name)) for name, (keys, m) in zip(key_sets, maps)]
    return attach_all(df, named, chunk_rows)


def time_pair_counts(dfs: Sequence[DataFrame], cols, time: str = TIME) -> DataFrame:
    """Rows per (key, time) over all given logs, as `<key>_timecount`."""
    return count_map(dfs, [*as_list(cols), time], feature_name(cols, "timecount"))


def click_ratios(df: DataFrame, count: str, distinct: Mapping[str, str]) -> DataFrame:
    """Distinct counts as a share of the clicks of the same key."""
    return df.withColumns({name: ratio(F.col(c), F.col(count)) for name, c in distinct.items()})


def group_size(df: DataFrame, cols, name: str = "group_size", chunk_rows: int | None = None) -> DataFrame:
    """The size of each row's own group."""
    return attach(df, count_map([df], cols, name), as_list(cols), chunk_rows=chunk_rows)
