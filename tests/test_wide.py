"""Functions over ordered groups, event lists and quantile sketches, each against a plain computation."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clickloom.functions.numeric import normal_quantile
from clickloom.operators.eventlists import load_lists, sequence_input, store_lists
from clickloom.operators.scaling import QuantileMap
from clickloom.operators.sequences import histories
from clickloom.operators.windows import click_gaps
from clickloom.plans.grouped import Carried, apply_ordered
from clickloom.plans.quantiles import sketch_quantiles, sketch_size
from clickloom.registry.ordered import time_diff

ROWS = 1200


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(8)
    key = rng.integers(1, 30, ROWS)
    key[rng.random(ROWS) < 0.35] = 0
    return pd.DataFrame({"row_id": np.arange(ROWS), "ip": key, "app": rng.integers(0, 3, ROWS),
                         "epoch_time": rng.integers(0, 300, ROWS), "is_attributed": rng.integers(0, 2, ROWS)})


@pytest.fixture(scope="module")
def log(spark, frame):
    return spark.createDataFrame(frame).repartition(5, "epoch_time").withColumn("ip", F.when(F.col("row_id") % 11 != 4, F.col("ip")))


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("cut", [None, 40])
@pytest.mark.parametrize("batch", [7, 10_000])
def test_diff_of_a_group_equals_the_window(spark, log, cut, batch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = rows(apply_ordered(log, ["ip"], ["epoch_time", "row_id"], time_diff(), "row_id long, click_diff long", cut).fillna(-1), "row_id", "click_diff")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = click_gaps(log.where("ip IS NOT NULL"), "ip", fill=-1, names=["click_diff"])
    assert got == rows(want, "row_id", "click_diff")


def test_a_cut_group_carries_a_state_of_several_values(spark, log, frame):
    """Running count and largest time so far, one summary row at a time; keys of two columns."""

    def step(state, part):
        n, top = state
        tops = np.maximum.accumulate(np.maximum(part.epoch_time.to_numpy(), top))
        out = pd.DataFrame({"row_id": part.row_id, "n": n + np.arange(1, len(part) + 1), "top": tops})
        return out, (n + len(part), int(tops[-1]))

    fn = Carried(lambda: (0, -1), step, lambda a, b: (a[0] + b[0], max(a[1], b[1])))
    got = apply_ordered(log, ["ip", "app"], ["row_id"], fn, "row_id long, n long, top long", 25).orderBy("row_id").toPandas()
    known = frame[frame.row_id % 11 != 4].sort_values("row_id")
    groups = known.groupby(["ip", "app"])
    assert got.n.tolist() == (groups.cumcount() + 1).tolist()
    assert got.top.tolist() == groups.epoch_time.cummax().tolist()


def test_groups_may_be_dropped_and_tables_may_be_empty(log):
    last = Carried(lambda: None, lambda s, part: (part[["row_id"]].iloc[:0], None), lambda a, b: None)
    assert apply_ordered(log, ["ip"], ["row_id"], last, "row_id long", 40).count() == 0
    none = log.where(F.lit(False))
    assert apply_ordered(none, ["ip"], ["epoch_time", "row_id"], time_diff(), "row_id long, click_diff long").collect() == []
    with pytest.raises(TypeError, match="floating"):
        apply_ordered(log.withColumn("x", F.lit(0.5)), ["x"], ["row_id"], last, "row_id long")


@pytest.mark.parametrize("cut", [None, 40])
@pytest.mark.parametrize("list_events", [21, 64])
def test_event_lists_equal_the_window(spark, log, tmp_path, cut, list_events):
    path = f"{tmp_path}/lists"
    lists = store_lists(log, path, list_events=list_events, chunk_rows=cut)
    got = sequence_input(lists, 20).where("ip_id IS NOT NULL")
    plain = histories(log, values=["is_attributed"]).where("ip IS NOT NULL")
    n = F.greatest(F.size(F.filter("is_attributed_history", lambda v: v >= 0)), F.lit(1))
    plain = plain.withColumn("n", n)
    assert rows(got, "row_id", "ip_id", "ip_attributed_history", "ip_time_delta_history", "ip_history_length", "ip_next_download") == rows(
        plain, "row_id", "ip", "is_attributed_history", "time_history", "n", "is_attributed")
    again = load_lists(spark, path, list_events=list_events)
    assert again.lists.agg(F.max(F.size("epoch_time"))).first()[0] <= list_events
    assert again.lists.agg(F.sum(F.size("epoch_time"))).first()[0] == log.where("ip IS NOT NULL").count()
    assert sequence_input(again, 20).count() == ROWS


def test_rows_without_a_key_and_empty_logs(log, tmp_path):
    lists = store_lists(log, f"{tmp_path}/a", list_events=32)
    (none,) = sequence_input(lists, 5).where("row_id = 4").collect()
    assert (none.ip_id, none.ip_attributed_history, none.ip_history_length) == (None, [-1] * 5, 1)
    with pytest.raises(ValueError, match="lists"):
        lists.histories(33)
    assert sequence_input(store_lists(log.where(F.lit(False)), f"{tmp_path}/b"), 5).count() == 0


def test_sketch_ranks_stay_within_the_stated_error(spark):
    rng = np.random.default_rng(2)
    n, error = 60_000, 0.002
    data = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 40, n).astype(float), "c": rng.exponential(size=n) ** 3, "d": np.nan})
    data.loc[rng.random(n) < 0.3, "c"] = np.nan
    df = spark.createDataFrame(data).repartition(23).withColumn("e", F.lit(None).cast("int"))
    got = {r["name"]: r for r in sketch_quantiles(df, ["a", "b", "c", "d", "e"], 1000, error).collect()}
    assert got["d"].quantiles is None and got["e"].quantiles is None and got["d"].n == 0
    for c in "abc":
        x = np.sort(data[c].dropna().to_numpy())
        q = np.asarray(got[c].quantiles)
        assert got[c].n == len(x) and len(q) == 1000 and (q[0], q[-1]) == (x[0], x[-1])
        assert (np.diff(q) >= 0).all() and np.isin(q, x).all()
        wanted = np.linspace(0, 1, 1000)
        low, high = np.searchsorted(x, q, "left") / len(x), np.searchsorted(x, q, "right") / len(x)
        assert np.maximum(low - wanted, wanted - high).max() <= error


def test_sketch_of_few_rows_and_map(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(5)], "row_id long, x double")
    assert QuantileMap.fit(df, ["x"], 1000, rank_error=0.001).landmarks == {"x": [0.0, 1.0, 2.0, 3.0, 4.0]}
    assert QuantileMap.fit(df.where("row_id < 0"), ["x"], 1000, rank_error=0.001).landmarks == {}
    with pytest.raises(ValueError, match="rank error"):
        sketch_size(1e-6)


def test_sketch_map_is_close_to_the_exact_one(spark):
    df = spark.range(40_000).select("id", F.pmod(F.xxhash64("id"), F.lit(10_007)).cast("double").alias("x"))
    exact = QuantileMap.fit(df, ["x"]).transform(df, "uniform").orderBy("id").toPandas().x
    sketch = QuantileMap.fit(df, ["x"], rank_error=0.0005).transform(df, "uniform").orderBy("id").toPandas().x
    assert np.abs(exact - sketch).max() < 0.002


def test_normal_quantile_against_the_standard_library():
    p = np.concatenate([np.linspace(1e-7, 1 - 1e-7, 2001), 10.0 ** -np.arange(1, 16)])
    assert normal_quantile(p) == pytest.approx([NormalDist().inv_cdf(x) for x in p], rel=1e-12, abs=1e-12)
