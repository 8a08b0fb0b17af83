"""Composite keys as dense integer codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.functions.calendar import with_calendar
from clickloom.plans.joins import attach, attach_all
from clickloom.plans.ordered import Position, ordered_features
from clickloom.plans.splits import CHUNK, is_null_key, split_points
from clickloom.schema import DICTIONARY_KEYS
from clickloom.sources.store import roundtrip


def distinct_keys(dfs: Sequence[DataFrame], cols: Sequence[str]) -> DataFrame:
    """Distinct key tuples over several tables."""
    union = dfs[0].select(*cols)
    for df in dfs[1:]:
        union = union.unionByName(df.select(*cols))
    return union.distinct()


def key_dictionary(
    dfs: Sequence[DataFrame], cols: Sequence[str], code: str | None = None, chunk_rows: int | None = None
) -> DataFrame:
    """Key tuple -> code 0..n-1 in key order, over the tuples found in any of `dfs`."""
    tuples = roundtrip(distinct_keys(dfs, cols), "key-tuples")
    return ordered_features(tuples, [], cols, [Position(code or "_".join(cols))], chunk_rows)


def encode_keys(
    df: DataFrame, dictionary: DataFrame, cols: Sequence[str], chunk_rows: int | None = None
) -> DataFrame:
    """Add the code of each row's key; null when the dictionary lacks it."""
    return attach(df, dictionary, cols, chunk_rows=chunk_rows)


def nested(key_sets: Sequence[Sequence[str]]) -> bool:
    """True when every key set is the beginning of the next longer one."""
    ordered = sorted(key_sets, key=len)
    return len(ordered) > 1 and all(list(b[: len(a)]) == list(a) for a, b in zip(ordered, ordered[1:]))


def nested_dictionary(dfs: Sequence[DataFrame], key_sets: Sequence[Sequence[str]], chunk_rows: int | None = None) -> DataFrame:
    """Longest key tuple -> the codes of all its beginnings that are in `key_sets`, from one distinct and one sort.

    A code counts the changes of its columns along the sorted tuples. Cuts fall between tuples of the shortest
    key set, so that the first tuple of a piece is a change for every key set.
    """
    ordered = sorted(key_sets, key=len)
    longest, names = list(ordered[-1]), ["_".join(k) for k in ordered]
    tuples = roundtrip(distinct_keys(dfs, longest), "key-tuples")
    splits = split_points(tuples, [], list(ordered[0]), chunk_rows)
    whole = splits.table is None
    pieces = splits.assign(tuples) if not whole else tuples.withColumn(CHUNK, F.lit(0))
    w = Window.partitionBy(CHUNK).orderBy(*longest)
    same, changes, columns = F.lag(F.lit(True), 1, False).over(w), [], []
    for col in longest:
        same = same & F.lag(col).over(w).eqNullSafe(F.col(col))
        columns.append(col)
        changes += [(~same).cast("bigint").alias(f"__new_{name}") for k, name in zip(ordered, names) if list(k) == columns]
    flagged = pieces.select("*", *changes)
    running = [F.sum(f"__new_{n}").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n in names]
    placed = roundtrip(flagged.select(CHUNK, *longest, *running), "key-places")
    # One row per piece: at most as many as pieces, which the shuffle partitions bound.
    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = placed.groupBy(CHUNK).agg(*[F.max(n).alias(f"__t_{n}") for n in names]).select(
        CHUNK, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in names])
    out = placed.join(F.broadcast(carried), CHUNK)
    return out.select(*longest, *[(F.col(n) + F.col(f"__b_{n}") - 1).alias(n) for n in names])


def _null_safe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns __k0, __k1, ... that are equal just where `cols` are equal, nulls included: stand-ins, then flags of nulls."""
    def known(c: str) -> Column:
        if isinstance(df.schema[c].dataType, T.NumericType):
            return F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType))
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    flags = sum((F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(cols)), F.lit(0))
    return df.withColumns({**{f"__k{i}": known(c) for i, c in enumerate(cols)}, f"__k{len(cols)}": flags})


def encode_all(
    df: DataFrame,
    fit_on: Sequence[DataFrame],
    key_sets: Sequence[Sequence[str]] = DICTIONARY_KEYS,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Add a code column per key set, with dictionaries built over `fit_on`."""
    if not nested(key_sets):
        return attach_all(df, [(cols, key_dictionary(fit_on, cols, chunk_rows=chunk_rows)) for cols in key_sets], chunk_rows)
    all_codes = nested_dictionary(fit_on, key_sets, chunk_rows)
    if any(df is f for f in fit_on):  # every row's longest key is known: one join brings all codes
        made = {"_".join(cols): cols for cols in key_sets}
        df = df.drop(*made)
        keys, longest = [f"__k{i}" for i in range(len(max(key_sets, key=len)) + 1)], max(key_sets, key=len)
        # A number travels as its stand-in only, and is put back from it.
        flag = lambda i: F.col(keys[-1]).bitwiseAND(F.lit(1 << i))
        back = {c: F.when(flag(i) == 0, F.col(f"__k{i}")) for i, c in enumerate(longest) if isinstance(df.schema[c].dataType, T.NumericType)}
        both = attach(_null_safe(df, longest).drop(*back), _null_safe(all_codes, longest).select(*keys, *made), keys, chunk_rows=chunk_rows)
        both = both.withColumns(back)
        return both.select(*df.columns, *[F.when(~is_null_key(cols), F.col(code)).alias(code) for code, cols in made.items()])
    return attach_all(df, [(cols, all_codes.select(*cols, "_".join(cols)).distinct()) for cols in key_sets], chunk_rows)


def base_table(clicks: DataFrame, fit_on: Sequence[DataFrame], chunk_rows: int | None = None) -> DataFrame:
    """Clicks with calendar parts and the three composite codes; ids and labels are kept."""
    return encode_all(with_calendar(clicks), fit_on, chunk_rows=chunk_rows)
