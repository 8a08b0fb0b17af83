"""Ordered per-group features (running totals, shifts, last-n lists) that survive hot keys.

Without hot keys this is one window per call: one exchange, one sort, all features
together. With hot keys the window runs inside ``(keys, piece)`` and every piece of
a hot key gets what it needs from its neighbours through a small broadcast table:
totals of the earlier pieces and the few rows next to its edges.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.plans.splits import CHUNK, SplitPoints, is_null_key, split_points

_RN, _ROWS, _TAIL, _HEAD, _LISTS = "__rn", "__rows", "__tail", "__head", "__lists"


@dataclass(frozen=True)
class Running:
    """Running `sum`, `count`, `min` or `max` of the earlier rows (and the row itself with `current`)."""

    name: str
    value: Column
    how: str = "sum"
    current: bool = False


@dataclass(frozen=True)
class Shift:
    """Value `n` rows earlier; later when `n` is negative."""

    name: str
    value: Column
    n: int = 1


@dataclass(frozen=True)
class LastN:
    """Array of the values of the last `n` earlier rows, oldest first, nulls kept."""

    name: str
    value: Column
    n: int


@dataclass(frozen=True)
class RollingMean:
    """Mean over the row itself and the `n - 1` rows before it."""

    name: str
    value: Column
    n: int


@dataclass(frozen=True)
class Position:
    """0-based position of the row in its group."""

    name: str
    value: Column | None = None


Feature = Running | Shift | LastN | RollingMean | Position

_AGG = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
_MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def _combine(how: str, a: Column, b: Column) -> Column:
    if how == "min":
        return F.least(a, b)
    if how == "max":
        return F.greatest(a, b)
    # A null side means no value on that side.
    return F.coalesce(a + b, a, b)


def last_of(array: Column, n) -> Column:
    """Last `n` items of an array (all items when it is shorter)."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(array, F.greatest(F.size(array) - n, F.lit(0)) + 1, n)


def ordered_features(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    features: Sequence[Feature],
    chunk_rows: int | None = None,
    splits: SplitPoints | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add `features`, computed per `keys` group in `order` (which must be unique within a group).

    Rows with a null key get null features. With no keys the table is one ordered group.
    `source` has the same rows as `df` but a shorter plan (say, before other features
    were added); split points and carried values are read from it.
    """
    keys, order = list(keys), list(order)
    source = df if source is None else source
    splits = splits or split_points(source, keys, order, chunk_rows)
    values = [(F.lit(None) if f.value is None else f.value).alias(f"__v{i}") for i, f in enumerate(features)]
    base = splits.assign(df.select("*", *values))
    w = Window.partitionBy(*keys, *splits.columns).orderBy(*order)
    width = max((f.n for f in features if isinstance(f, LastN)), default=0)
    local = base.select(
        "*",
        F.row_number().over(w).alias(_RN),
        *[_local(f, i, w).alias(f"__l{i}") for i, f in enumerate(features) if not isinstance(f, LastN)],
        *([_lists(features).over(w.rowsBetween(-width, -1)).alias(_LISTS)] if width else []),
    )
    cut = splits.table is not None
    if cut:
        narrow = source.select(*dict.fromkeys([*keys, *order]), *values)
        carry = _carry(splits.assign(narrow, only_cut=True), keys, order, features)
        local = local.join(F.broadcast(carry), [*keys, CHUNK], "left")
    out = [(_final(f, i, width) if cut else _plain(f, i, width)) for i, f in enumerate(features)]
    if keys:
        out = [F.when(~is_null_key(keys), c) for c in out]
    return local.select(*df.columns, *[c.alias(f.name) for c, f in zip(out, features)])


def _local(f: Feature, i: int, w) -> Column:
    v = F.col(f"__v{i}")
    if isinstance(f, Running):
        return _AGG[f.how](v).over(w.rowsBetween(Window.unboundedPreceding, 0 if f.current else -1))
    if isinstance(f, Shift):
        return F.lag(v, f.n).over(w) if f.n > 0 else F.lead(v, -f.n).over(w)
    if isinstance(f, RollingMean):
        frame = w.rowsBetween(-(f.n - 1), 0)
        return F.struct(F.sum(v).over(frame).alias("s"), F.count(v).over(frame).alias("n"))
    return F.row_number().over(w)


def _lists(features: Sequence[Feature]) -> Column:
    """One list of structs for all last-n features: a sliding list costs the same for one value as for many."""
    return F.collect_list(F.struct(*[f"__v{i}" for i, f in enumerate(features) if isinstance(f, LastN)]))


def _plain(f: Feature, i: int, width: int) -> Column:
    if isinstance(f, LastN):
        own = F.col(_LISTS)[f"__v{i}"]
        return own if f.n == width else last_of(own, f.n)
    loc = F.col(f"__l{i}")
    if isinstance(f, RollingMean):
        return F.try_divide(loc["s"], loc["n"])
    if isinstance(f, Position):
        return (loc - 1).cast("bigint")
    return loc


def _final(f: Feature, i: int, width: int) -> Column:
    """Local value put together with what the neighbouring pieces carry in."""
    loc, rn, rows, tail, head = (F.col(c) for c in (f"__l{i}", _RN, _ROWS, _TAIL, _HEAD))
    item = f"__v{i}"
    if isinstance(f, LastN):
        own = F.col(_LISTS)[item]
        whole = F.when((rn > f.n) | tail.isNull(), own).otherwise(F.concat(tail[item], own))
        return last_of(whole, f.n)
    if isinstance(f, Running):
        return _combine(f.how, loc, F.col(f"__c{i}"))
    if isinstance(f, Shift) and f.n > 0:
        return F.when(rn > f.n, loc).otherwise(F.try_element_at(tail, rn - (f.n + 1))[item])
    if isinstance(f, Shift):
        m = -f.n
        return F.when(rows.isNull() | (rn + m <= rows), loc).otherwise(
            F.try_element_at(head, (m - (rows - rn)).cast("int"))[item]
        )
    if isinstance(f, RollingMean):
        missing = F.greatest(F.lit(f.n) - rn, F.lit(0))
        before = F.filter(last_of(tail, missing)[item], lambda v: v.isNotNull())
        s = _combine("sum", loc["s"], F.aggregate(before, F.lit(0.0), lambda a, v: a + v))
        n = loc["n"] + F.size(before)
        return F.when((rn >= f.n) | tail.isNull(), F.try_divide(loc["s"], loc["n"])).otherwise(F.try_divide(s, n))
    return (loc - 1 + F.coalesce(F.col(f"__c{i}"), F.lit(0))).cast("bigint")


def _carry(hot: DataFrame, keys: list[str], order: list[str], features: Sequence[Feature]) -> DataFrame:
    """One row per piece of a cut group: totals before it and the rows next to its edges.

    The rows kept per piece are limited by the largest shift, and that limit is applied
    on the map side, before the exchange.
    """
    group = [*keys, CHUNK]
    aggs = [F.count(F.lit(1)).alias(_ROWS)]
    for i, f in enumerate(features):
        if isinstance(f, Running):
            aggs.append(_AGG[f.how](f"__v{i}").alias(f"__t{i}"))
        elif isinstance(f, Position):
            aggs.append(F.count(F.lit(1)).alias(f"__t{i}"))
    by_piece = Window.partitionBy(*keys).orderBy(CHUNK)
    earlier = by_piece.rowsBetween(Window.unboundedPreceding, -1)
    columns = [*group, _ROWS]
    for i, f in enumerate(features):
        if isinstance(f, (Running, Position)):
            how = f.how if isinstance(f, Running) else "count"
            columns.append(_MERGE[how](f"__t{i}").over(earlier).alias(f"__c{i}"))

    back = max((_reach(f) for f in features), default=0)
    ahead = max((-f.n for f in features if isinstance(f, Shift)), default=0)
    item = _item(order, features)
    # A single edge row is a plain aggregate; more of them are ranked, and cut off on the map side.
    aggs += [F.array(F.max(item)).alias("__own_tail")] if back == 1 else []
    aggs += [F.array(F.min(item)).alias("__own_head")] if ahead == 1 else []
    carry = hot.groupBy(*group).agg(*aggs)
    if back:
        if back > 1:
            carry = carry.join(_edge(hot, group, order, item, back, F.desc, "__own_tail"), group)
        near = F.flatten(F.collect_list("__own_tail").over(by_piece.rowsBetween(-back, -1)))
        columns.append(last_of(near, back).alias(_TAIL))
    else:
        columns.append(F.lit(None).alias(_TAIL))
    if ahead > 0:
        if ahead > 1:
            carry = carry.join(_edge(hot, group, order, item, ahead, F.asc, "__own_head"), group)
        near = F.flatten(F.collect_list("__own_head").over(by_piece.rowsBetween(1, ahead)))
        columns.append(F.slice(near, 1, ahead).alias(_HEAD))
    return carry.select(*columns)


def _reach(f: Feature) -> int:
    if isinstance(f, Shift):
        return max(f.n, 0)
    if isinstance(f, LastN):
        return f.n
    if isinstance(f, RollingMean):
        return f.n - 1
    return 0


def _item(order: list[str], features: Sequence[Feature]) -> Column:
    """A row as carried across an edge: its place in the order, then its values."""
    values = [F.col(f"__v{i}") for i, f in enumerate(features) if _reach(f) or isinstance(f, Shift)]
    return F.struct(F.struct(*order).alias("at"), *values)


def _edge(hot: DataFrame, group: list[str], order: list[str], item: Column, n: int, direction, name: str) -> DataFrame:
    """The first or last `n` rows of each piece, in order."""
    w = Window.partitionBy(*group).orderBy(*[direction(o) for o in order])
    kept = hot.withColumn("__edge_rn", F.row_number().over(w)).where(F.col("__edge_rn") <= n)
    return kept.groupBy(*group).agg(F.sort_array(F.collect_list(item)).alias(name))
