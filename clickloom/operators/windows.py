"""Per-entity ordered features: gaps, expanding statistics, running sums, plateau tests.

Order is `(epoch_time, row_id)` unless given. Features that must not mix splits take
the split column as part of the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.operators.encoder import GroupEncoder, add_encodings
from clickloom.plans.joins import KeySample, attach
from clickloom.plans.ordered import RollingMean, Running, Shift, ordered_features
from clickloom.plans.splits import split_points
from clickloom.schema import LABEL, ROW_ID, SPLIT, TIME, TIME_ORDER, as_list, feature_name


def click_gaps(
    df: DataFrame,
    cols,
    prev: Sequence[int] = (1,),
    nxt: Sequence[int] = (),
    within: Sequence[str] = (),
    fill: int | None = -1,
    time: str = TIME,
    order: Sequence[str] = TIME_ORDER,
    names: Sequence[str] | None = None,
    chunk_rows: int | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Time since the n-th earlier click and until the n-th later click of the same key.

    All gaps of a key share one exchange and one sort. `within` adds columns (such as
    the split) that a gap may not cross. Missing neighbours get `fill`.
    """
    cols = as_list(cols)
    names = list(names or [feature_name(cols, f"prev_click_{n}") for n in prev] + [feature_name(cols, f"next_click_{n}") for n in nxt])
    t = F.col(time)
    shifts = [Shift(f"_p{n}", t, n) for n in prev] + [Shift(f"_n{n}", t, -n) for n in nxt]
    out = ordered_features(df, [*cols, *within], order, shifts, chunk_rows, source=source)
    gaps = [t - F.col(f"_p{n}") for n in prev] + [F.col(f"_n{n}") - t for n in nxt]
    if fill is not None:
        gaps = [F.coalesce(g, F.lit(fill)) for g in gaps]
    return out.select(*df.columns, *[g.alias(name) for g, name in zip(gaps, names)])


def click_gaps_all(df: DataFrame, key_sets: Sequence[str | Sequence[str]], **options) -> DataFrame:
    """`click_gaps` for several key sets."""
    out = df
    for cols in key_sets:
        out = click_gaps(out, cols, source=df, **options)
    return out


def last_next_union(tr: DataFrame, val: DataFrame, cols, chunk_rows: int | None = None) -> DataFrame:
    """Gaps over both tables together (tagged by split), nulls where there is no neighbour."""
    cols = as_list(cols)
    both = tr.withColumn(SPLIT, F.lit("tr")).unionByName(val.withColumn(SPLIT, F.lit("val")), allowMissingColumns=True)
    names = [feature_name(cols, "last_click"), feature_name(cols, "next_click")]
    return click_gaps(both, cols, (1,), (1,), fill=None, names=names, chunk_rows=chunk_rows)


def _previous_group(tr: DataFrame, col: str, target: str, chunk_rows: int | None) -> DataFrame:
    """Per key, the whole-group sum and count of the key before it in key order."""
    totals = (
        tr.where(F.col(col).isNotNull()).groupBy(col)
        .agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    )
    before = [Shift("_prev_s", F.col("s")), Shift("_prev_n", F.col("n"))]
    return ordered_features(totals, [], [col], before, chunk_rows).select(col, "_prev_s", "_prev_n")


def expanding(
    tr: DataFrame,
    val: DataFrame | None,
    cols: Sequence[str],
    target: str = LABEL,
    stats: Sequence[str] = ("mean", "count"),
    group_shift: str = "group",
    order: Sequence[str] = TIME_ORDER,
    chunk_rows: int | None = None,
) -> list[DataFrame]:
    """Per key column, mean and count of the target over the earlier rows of the key (`_expmean`, `_expcount`).

    On `val` it is the statistic over all of `tr`. Fills: -1 for means, 0 for counts.
    `group_shift='global'` gives the first row of a key the final value of the previous
    key in key order, as a shift over the whole sorted result would.
    """
    if group_shift not in ("group", "global"):
        raise ValueError(f"unknown group_shift {group_shift!r}")
    empty = {"mean": -1.0, "count": 0}
    y = F.col(target)
    out = tr
    for col in as_list(cols):
        parts = [Running("_s", y, "sum"), Running("_n", y, "count"), Running("_rows", F.lit(1), "count")]
        step = ordered_features(out, [col], order, parts, chunk_rows, source=tr)
        s, n = F.col("_s"), F.col("_n")
        if group_shift == "global":
            step = attach(step, _previous_group(tr, col, target, chunk_rows), [col], KeySample(tr, [col], chunk_rows))
            first = F.col("_rows") == 0
            s, n = F.when(first, F.col("_prev_s")).otherwise(s), F.when(first, F.col("_prev_n")).otherwise(n)
        made = {"mean": F.coalesce(F.try_divide(s, n), F.lit(-1.0)), "count": F.coalesce(n, F.lit(0))}
        out = step.select(*out.columns, *[made[stat].alias(feature_name(col, f"exp{stat}")) for stat in stats])
    outs = [out]
    if val is not None:
        encoders = [GroupEncoder(c, target, stat, feature_name(c, f"exp{stat}")) for c in as_list(cols) for stat in stats]
        (val,) = add_encodings([tr], [val], encoders, chunk_rows=chunk_rows)
        outs.append(val.fillna({feature_name(c, f"exp{stat}"): empty[stat] for c in as_list(cols) for stat in stats}))
    return outs


def cumulative_sum(
    tr: DataFrame, val: DataFrame, cols, target: str = LABEL, chunk_rows: int | None = None
) -> DataFrame:
    """Running sum of the target per key, the row itself included.

    `val` carries no time, so its rows come after all of `tr`, in row order. The sum
    sees the row's own target: it leaks by design, and serves as an upper bound.
    """
    cols = as_list(cols)
    need = [ROW_ID, *cols, target]
    both = tr.select(*need, TIME, F.lit("tr").alias(SPLIT)).unionByName(
        val.select(*need, F.lit(None).cast("bigint").alias(TIME), F.lit("val").alias(SPLIT))
    )
    both = both.withColumn("_late", F.col(TIME).isNull().cast("int"))
    made = [Running(feature_name(cols, "cusum"), F.col(target), "sum", current=True)]
    return ordered_features(both, cols, ["_late", TIME, ROW_ID], made, chunk_rows).drop("_late")


def sortedness(df: DataFrame, time: str = TIME, order: Sequence[str] = (ROW_ID,), chunk_rows: int | None = None) -> DataFrame:
    """Rows that are earlier than the row before them, and whether there are none."""
    out = ordered_features(df.select(*dict.fromkeys([*order, time])), [], order, [Shift("_before", F.col(time))], chunk_rows)
    late = F.count_if(F.col(time) < F.col("_before"))
    return out.agg(late.alias("out_of_order"), (late == 0).alias("is_sorted"))


def adjacent_diff(
    df: DataFrame,
    group: Column,
    time: Column,
    na_val: int = 7200,
    order: Sequence[str] = (ROW_ID,),
    name: str = "group_diff",
    chunk_rows: int | None = None,
) -> DataFrame:
    """Difference to the row before in table order; `na_val` on the first row and where the group changes."""
    marked = df.select("*", group.alias("_g"), time.alias("_t"))
    out = ordered_features(marked, [], order, [Shift("_bg", F.col("_g")), Shift("_bt", F.col("_t"))], chunk_rows)
    same = F.col("_g") == F.col("_bg")
    return out.select(*df.columns, F.when(same, F.col("_t") - F.col("_bt")).otherwise(F.lit(na_val)).alias(name))


def plateau(
    log: DataFrame,
    run: str,
    step: str,
    loss: str,
    window: int = 100,
    patience: int | None = None,
    order: Sequence[str] | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Progress of training runs, from a table of losses per step.

    Adds the mean loss over the last `window` steps, the best mean so far, the step it
    was reached, the steps since then, and (with `patience`) whether the run should stop.
    """
    order = list(order or [step])
    splits = split_points(log, [run], order, chunk_rows)
    out = ordered_features(log, [run], order, [RollingMean("avg_loss", F.col(loss), window)], splits=splits)
    out = ordered_features(out, [run], order, [Running("_best", F.col("avg_loss"), "min")], splits=splits)
    better = F.col("_best").isNull() | (F.col("avg_loss") < F.col("_best"))
    out = out.withColumn("best_loss", F.least("avg_loss", "_best")).withColumn("_at", F.when(better, F.col(step)))
    out = ordered_features(out, [run], order, [Running("best_step", F.col("_at"), "max", current=True)], splits=splits)
    out = out.withColumn("steps_since_best", F.col(step) - F.col("best_step"))
    made = ["avg_loss", "best_loss", "best_step", "steps_since_best"]
    if patience is not None:
        out = out.withColumn("should_stop", F.col("steps_since_best") > patience)
        made.append("should_stop")
    return out.select(*log.columns, *made)
