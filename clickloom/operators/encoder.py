"""Group encoders: a statistic of a target per key tuple, joined back to rows."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.operators.counts import GroupedMaps
from clickloom.operators.splits import kfold
from clickloom.plans.joins import attach, attach_all
from clickloom.plans.quantiles import grouped_quantiles
from clickloom.plans.splits import is_null_key
from clickloom.schema import ROW_ID, as_list, feature_name


def _deviation(sample, population):
    def build(c: Column, ddof: int = 1) -> Column:
        if ddof not in (0, 1):
            raise ValueError("ddof must be 0 or 1")
        return sample(c) if ddof else population(c)

    return build


# Statistic name -> aggregate; all of them combine on the map side.
NAMED = {
    "mean": F.avg,
    "count": F.count,
    "size": lambda c: F.count(F.lit(1)),
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "nunique": F.count_distinct,
    "approx_nunique": F.approx_count_distinct,
    "std": _deviation(F.stddev_samp, F.stddev_pop),
    "var": _deviation(F.var_samp, F.var_pop),
}
QUANTILES = ("median", "quantile")


@dataclass(frozen=True)
class AdditiveAggregate:
    """A custom aggregate in pandas, in a form that never needs a whole group in one place.

    `partial` maps the target values of a group in one batch to a few numbers. The
    numbers of all batches are added up, and `finish` turns the sums into the result.
    """

    partial: Callable[..., Sequence[float]]
    finish: Callable[[list[Column]], Column]
    states: int

    def table(self, df: DataFrame, cols: list[str], target: str, name: str, kwargs: Mapping[str, object]) -> DataFrame:
        partial = functools.partial(self.partial, **kwargs)
        states = [f"_s{i}" for i in range(self.states)]

        def per_batch(batches):
            for pdf in batches:
                if len(pdf):
                    groups = pdf.groupby(cols, sort=False)[target]
                    rows = [(*(k if isinstance(k, tuple) else (k,)), *map(float, partial(s))) for k, s in groups]
                    yield pd.DataFrame(rows, columns=[*cols, *states])

        narrow = df.select(*cols, target).where(~is_null_key(cols))
        schema = T.StructType([df.schema[c] for c in cols] + [T.StructField(s, T.DoubleType()) for s in states])
        summed = narrow.mapInPandas(per_batch, schema).groupBy(*cols).agg(*[F.sum(s).alias(s) for s in states])
        return summed.select(*cols, self.finish([F.col(s) for s in states]).alias(name))


@dataclass(frozen=True)
class GroupModel:
    """A fitted encoder: one row per key, ready to be joined, saved or loaded."""

    cols: list[str]
    name: str
    table: DataFrame

    def transform(
        self, df: DataFrame, add_to_orig: bool = True, row_id: str = ROW_ID, chunk_rows: int | None = None
    ) -> DataFrame:
        """Rows with the feature added, or just (row id, feature). Unseen and null keys get null."""
        if not isinstance(df, DataFrame):
            raise TypeError("input should be a Spark DataFrame")
        source = df if add_to_orig else df.select(*dict.fromkeys([row_id, *self.cols]))
        out = attach(source.drop(self.name), self.table, self.cols, chunk_rows=chunk_rows)
        return out if add_to_orig else out.select(row_id, self.name)


@dataclass
class GroupEncoder:
    """Fit a statistic of `target` per key tuple.

    `func` is a statistic name (see `NAMED`, plus 'median' and 'quantile' with `q`), a
    function from the target column to an aggregate column, or an `AdditiveAggregate`.
    `func_kwargs` go to it. Keys with fewer than `min_count` rows get null.
    """

    cols: str | Sequence[str]
    target: str
    func: str | Callable[..., Column] | AdditiveAggregate = "mean"
    name: str | None = None
    min_count: int = 0
    func_kwargs: Mapping[str, object] = field(default_factory=dict)

    @property
    def feature(self) -> str:
        if self.name:
            return self.name
        kind = self.func if isinstance(self.func, str) else getattr(self.func, "__name__", "custom")
        return feature_name(self.cols, kind)

    def fit(self, *dfs: DataFrame) -> GroupModel:
        """Fit over the rows of all given tables."""
        cols = as_list(self.cols)
        narrow = [df.select(*dict.fromkeys([*cols, self.target])) for df in dfs]
        union = functools.reduce(DataFrame.unionByName, narrow).where(~is_null_key(cols))
        aggregate = self._aggregate()
        if aggregate is not None:
            table = union.groupBy(*cols).agg(aggregate.alias(self.feature), F.count(F.lit(1)).alias("_n"))
            table = table.where(F.col("_n") >= self.min_count) if self.min_count > 0 else table
            return GroupModel(cols, self.feature, table.drop("_n"))
        table = self._table(union, cols)
        if self.min_count > 0:
            sizes = union.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= self.min_count)
            table = table.join(sizes, cols, "left_semi")
        return GroupModel(cols, self.feature, table)

    def _aggregate(self) -> Column | None:
        """The statistic as one aggregate expression, where it is one."""
        if isinstance(self.func, AdditiveAggregate) or self.func in QUANTILES:
            return None
        if isinstance(self.func, str) and self.func not in NAMED:
            raise ValueError(f"unknown statistic {self.func!r}; known: {sorted([*NAMED, *QUANTILES])}")
        build = NAMED[self.func] if isinstance(self.func, str) else self.func
        return build(F.col(self.target), **self.func_kwargs)

    def _table(self, df: DataFrame, cols: list[str]) -> DataFrame:
        if isinstance(self.func, AdditiveAggregate):
            return self.func.table(df, cols, self.target, self.feature, self.func_kwargs)
        q = self.func_kwargs.get("q", 0.5)
        found = grouped_quantiles(df.withColumn("_value", F.col(self.target)), cols, "_value", [q])
        # Keys whose targets are all null keep a row, with a null statistic.
        every = df.select(*cols).distinct().join(found, cols, "left")
        return every.select(*cols, F.get("quantiles", F.lit(0)).alias(self.feature))


def add_encodings(
    fit_on: Sequence[DataFrame],
    apply_to: Sequence[DataFrame],
    encoders: Sequence[GroupEncoder],
    fill: float | int | None = None,
    chunk_rows: int | None = None,
) -> list[DataFrame]:
    """Fit all encoders on the same tables, add their features to each table, and fill what is missing.

    Fitting reads the tables as given, not as extended by the other features, so the
    plan grows with the number of features and not with its square or worse.
    """
    models = [e.fit(*fit_on) for e in encoders]
    out = [attach_all(df, [(m.cols, m.table) for m in models], chunk_rows) for df in apply_to]
    return [df.fillna({m.name: fill for m in models}) for df in out] if fill is not None else out


KeySets = Sequence[str | Sequence[str]]


def count_features(
    tr: DataFrame, val: DataFrame, key_sets: KeySets, target: str, supp: DataFrame | None = None, chunk_rows: int | None = None,
    by: str | None = None, determines: Sequence[str] = (),
) -> list[DataFrame]:
    """Non-null targets per key, fitted on both tables, or on `tr` and the supplement when one is given.

    Key sets with a column of `determines`, whose value determines that of `by` (such as a code of a tuple with it), are
    grouped and joined with `by` in front, so that they share one shuffle of the log unless a value of `by` is hot.
    """
    names = {feature_name(as_list(cols), "count"): as_list(cols) for cols in key_sets}
    sets = {name: [by, *[k for k in keys if k != by]] if set(determines) & set(keys) else keys for name, keys in names.items()}
    maps = GroupedMaps([tr, val if supp is None else supp], list(sets.values()), [F.count(target).alias("_n")], [target])
    tables = [(keys, maps.of(keys).select(*keys, F.col("_n").alias(name))) for name, keys in sets.items()]
    return [attach_all(df, tables, chunk_rows) for df in (tr, val)]


def distinct_features(
    tr: DataFrame,
    val: DataFrame,
    pairs: Sequence[tuple[Sequence[str], str]],
    approximate: bool = False,
    chunk_rows: int | None = None,
) -> list[DataFrame]:
    """Distinct targets per key over both tables, for (keys, target) pairs; 0 where the key is null.

    The exact counts come from the distinct (keys, target) tuples of all pairs, found in one pass and combined before
    the shuffle. A tuple is a few bytes; a bitmap per key would be 4 KB, also for the many keys with few targets.
    """
    if approximate:
        encoders = [GroupEncoder(cols, target, "approx_nunique", feature_name(cols, "unq", target)) for cols, target in pairs]
        return add_encodings([tr, val], [tr, val], encoders, 0, chunk_rows)
    pairs = [(as_list(cols), target, feature_name(cols, "unq", target)) for cols, target in pairs]
    maps = GroupedMaps([tr, val], [[*cols, target] for cols, target, _ in pairs], [F.count(F.lit(1)).alias("_n")])
    tables = [(cols, maps.of([*cols, target]).groupBy(*cols).agg(F.count(F.lit(1)).alias(name))) for cols, target, name in pairs]
    return [attach_all(df, tables, chunk_rows).fillna({name: 0 for *_, name in pairs}) for df in (tr, val)]


def std_features(
    tr: DataFrame, val: DataFrame, key_sets: KeySets, target: str, chunk_rows: int | None = None
) -> list[DataFrame]:
    """Sample deviation of the target per key over both tables; null for keys with one row."""
    return add_encodings([tr, val], [tr, val], [GroupEncoder(c, target, "std") for c in key_sets], chunk_rows=chunk_rows)


def mean_features(
    tr: DataFrame, val: DataFrame, key_sets: KeySets, target: str, min_count: int = 0, chunk_rows: int | None = None
) -> list[DataFrame]:
    """Mean target per key, fitted on `tr` and applied to both. On `tr` it sees the row's own target."""
    encoders = [GroupEncoder(c, target, "mean", min_count=min_count) for c in key_sets]
    return add_encodings([tr], [tr, val], encoders, chunk_rows=chunk_rows)


def _fold_means(per_fold: DataFrame, cols: list[str], min_count: int) -> tuple[DataFrame, DataFrame]:
    """(mean over the other folds per key and fold, mean over all folds per key)."""
    name = feature_name(cols, "mean")
    # At most k rows per key meet in a window of this small table.
    key = Window.partitionBy(*cols)
    rest = lambda c: F.sum(c).over(key) - F.coalesce(F.col(c), F.lit(0))
    enough = rest("_rows") >= min_count
    folds = per_fold.select(*cols, "_fold", F.when(enough, F.try_divide(rest("_s"), rest("_n"))).alias(name))
    totals = per_fold.groupBy(*cols).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"), F.sum("_rows").alias("_rows"))
    return folds, totals.select(*cols, F.when(F.col("_rows") >= min_count, F.try_divide("_s", "_n")).alias(name))


def out_of_fold_means(
    tr: DataFrame,
    val: DataFrame,
    key_sets: KeySets,
    target: str,
    k: int = 5,
    seed: int | None = 786,
    fold: Column | None = None,
    min_count: int = 0,
    chunk_rows: int | None = None,
) -> list[DataFrame]:
    """Mean target per key: on `tr` over the other folds only, on `val` over all of `tr`.

    One grouping by (key, fold) gives every fold's answer: the total of the key minus
    the share of the fold. Null where the other folds lack the key.
    """
    tr = tr.withColumn("_fold", kfold(k, seed) if fold is None else fold)
    sets = [as_list(c) for c in key_sets]
    sums = [F.sum(target).alias("_s"), F.count(target).alias("_n"), F.count(F.lit(1)).alias("_rows")]
    maps = GroupedMaps([tr], [[*cols, "_fold"] for cols in sets], sums, [target])
    tables = [_fold_means(maps.of([*cols, "_fold"]), cols, min_count) for cols in sets]
    tr_out = attach_all(tr, [([*cols, "_fold"], folds) for cols, (folds, _) in zip(sets, tables)], chunk_rows)
    val_out = attach_all(val, [(cols, totals) for cols, (_, totals) in zip(sets, tables)], chunk_rows)
    return [tr_out.drop("_fold"), val_out]


def stacked_count_means(tr: DataFrame, val: DataFrame, key_sets: KeySets, target: str) -> list[DataFrame]:
    """Mean target per value of a count feature: rows whose keys are equally frequent share a mean."""
    encoders = [GroupEncoder(c, target, "count", feature_name(c, "count")) for c in key_sets]
    counted = add_encodings([tr], [tr, val], encoders)
    return mean_features(*counted, [e.feature for e in encoders], target)
