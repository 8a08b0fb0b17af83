"""A user's function over ordered groups, with a state carried from one batch of a group to the next.

No group is held whole: rows stream through in Arrow batches, sorted by key and order. A group with
too many rows for one task is cut into pieces. The state of each piece alone comes from a first pass over
the cut groups; merged in order, the states give every piece what the pieces before it would have
handed on. A piece's state travels as one row of its own ahead of the piece's rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from clickloom.plans.splits import CHUNK, is_null_key, split_points

_STATE = "__state"


@dataclass(frozen=True)
class Carried:
    """The function of a group.

    `start()` is the state before the first row. `step(state, rows)` gives the output for some rows in order
    and the state after them; how rows are cut into batches must not change results. `merge(earlier, later)` is
    the state after two runs of rows, `later` reached from `start()` over the second run alone.
    """

    start: Callable[[], Any]
    step: Callable[[Any, pd.DataFrame], tuple[pd.DataFrame, Any]]
    merge: Callable[[Any, Any], Any]


def apply_ordered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Carried, schema: str | T.StructType, chunk_rows: int | None = None
) -> DataFrame:
    """What `fn` gives for the rows of each `keys` group in `order` (unique within a group), as `schema`.

    Rows with a null key belong to no group and are left out; an empty table gives an empty one. States have to
    be picklable and small: one per piece of a cut group is kept. Columns reach the function as pandas reads them from Arrow
    (a batch of an integer column that holds nulls comes as floats).
    """
    keys, order = list(keys), list(order)
    floats = [k for k in keys if isinstance(df.schema[k].dataType, (T.FloatType, T.DoubleType))]
    if floats:
        raise TypeError(f"groups by floating point columns are not supported: {floats}")
    # Through an empty frame, which knows how to read a DDL string.
    schema = df.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    rows = df.where(~is_null_key(keys))
    splits = split_points(rows, keys, order, chunk_rows)
    group = [*keys, *splits.columns]
    base = splits.assign(rows)
    if splits.table is not None:
        states = _states_before(splits.assign(rows, only_cut=True), keys, order, fn, df.columns)
        base = base.unionByName(states, allowMissingColumns=True)
    else:
        base = base.withColumn(_STATE, F.lit(None).cast("binary"))
    names, arrow = list(df.columns), to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(_, found):
            return pa.RecordBatch.from_pandas(pd.concat(found, ignore_index=True)[arrow.names], schema=arrow, preserve_index=False)

        return _walk(batches, len(group), names, fn, made)

    return _sorted(base, group, order, names).mapInArrow(run, schema)


def _sorted(base: DataFrame, group: list[str], order: list[str], names: list[str]) -> DataFrame:
    """Group columns under names of their own, the state, then the columns of the table; each group's state row first."""
    ids = [F.col(g).alias(f"__g{i}") for i, g in enumerate(group)]
    placed = base.select(*ids, _STATE, *names).repartition(*[f"__g{i}" for i in range(len(group))])
    return placed.sortWithinPartitions(*[f"__g{i}" for i in range(len(group))], F.col(_STATE).isNull(), *order)


def _runs(batch: pa.RecordBatch, depth: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with equal values in the first `depth` columns."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for i in range(depth):
        codes = batch.column(i).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    starts = np.flatnonzero(new).tolist()
    return zip(starts, [*starts[1:], batch.num_rows])


def _walk(batches, depth: int, names: list[str], fn: Carried, made, closed=None) -> Iterator[pa.RecordBatch]:
    """Step through sorted batches. `made` turns the outputs of a batch into one; `closed` sees the last state of each group."""
    key, state, ended = None, None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        heads = batch.column(depth).is_valid().to_numpy(zero_copy_only=False)
        # State rows have nulls elsewhere: taken out first, they leave the column types of pandas alone.
        table = pa.Table.from_batches([batch.select(names)])
        table = table.filter(pa.array(~heads)).to_pandas() if heads.any() else table.to_pandas()
        at = np.concatenate([[0], np.cumsum(~heads)])
        found = []
        for first, last in _runs(batch, depth):
            this = tuple(batch.column(i)[first].as_py() for i in range(depth))
            if this != key:
                if key is not None and closed:
                    ended.append((key, state))
                key, state = this, fn.start()
            if heads[first]:
                state = pickle.loads(batch.column(depth)[first].as_py())
            if at[first] < at[last]:
                out, state = fn.step(state, table.iloc[at[first]:at[last]].reset_index(drop=True))
                found.append(out)
        if made and found:
            yield made(key, found)
        if closed and ended:
            yield closed(ended)
            ended = []
    if closed and key is not None:
        yield closed([(key, state)])


def _states_before(hot: DataFrame, keys: list[str], order: list[str], fn: Carried, names: list[str]) -> DataFrame:
    """keys, piece, and the state that the rows before the piece lead to. One row per piece of a cut group."""
    group = [*keys, CHUNK]
    schema = T.StructType([*[hot.schema[g] for g in group], T.StructField(_STATE, T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(ended):
            rows = [dict(zip(arrow.names, (*key, pickle.dumps(state)))) for key, state in ended]
            return pa.RecordBatch.from_pylist(rows, schema=arrow)

        return _walk(batches, len(group), names, fn, None, closed)

    def before(key_rows: pa.Table) -> pa.Table:
        key_rows = key_rows.sort_by(CHUNK)
        out, state = [], fn.start()
        for own in key_rows.column(_STATE).to_pylist():
            out.append(pickle.dumps(state))
            state = fn.merge(state, pickle.loads(own))
        return key_rows.set_column(key_rows.schema.get_field_index(_STATE), arrow.field(_STATE), pa.array(out, pa.binary()))

    alone = _sorted(hot.withColumn(_STATE, F.lit(None).cast("binary")), group, order, names).mapInArrow(sums, schema)
    return alone.groupBy(*keys).applyInArrow(before, schema)
