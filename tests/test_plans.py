"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from clickloom.operators import windows as W
from clickloom.operators.counts import add_count_maps, add_counts_in_place, count_map, count_maps, grouped
from clickloom.operators.keys import encode_all, encode_keys, key_dictionary
from clickloom.operators.metrics import roc_auc
from clickloom.registry.base import BUCKETED_BY, DETERMINE_IT, clicks, coded
from clickloom.schema import COUNT_KEYS
from clickloom.sources import store
from clickloom.functions.calendar import epoch_between
from clickloom.sources.scans import EVENTS_ORIGIN, read_table, skip_limit
from clickloom.streaming.chunked import chunked_count_map, read_chunks

def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("make", [
    lambda df: key_dictionary([df], ["ip", "channel"], chunk_rows=50),
    lambda df: W.adjacent_diff(df, F.col("app"), F.col("epoch_time"), chunk_rows=50),
    lambda df: roc_auc(df.withColumn("score", F.col("epoch_time")), chunk_rows=50),
])
def test_global_order_is_cut_into_pieces(spark, sf, make):
    text = plan(make(clicks(spark, sf)))
    assert "hashpartitioning(__chunk" in text
    # Only the per-piece totals, never the rows, may meet in one partition.
    for part in text.split("Exchange SinglePartition")[1:]:
        assert "Aggregate" in part.split("Exchange")[0] or "Join" in part.split("Exchange")[0]


def test_nested_key_sets_share_one_exchange(spark, sf):
    out = W.click_gaps_all(clicks(spark, sf), [["ip"], ["ip", "device"], ["ip", "device", "os"]], prev=(1, 2), nxt=(1, 2))
    assert len(re.findall(r"Exchange hashpartitioning", plan(out))) == 1


def test_nested_count_maps_share_one_shuffle_of_the_log(spark, sf):
    log = clicks(spark, sf)
    out = add_count_maps(log, [log], [["ip", "app", "hourofday"], ["ip"], ["ip", "app"]])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        text = plan(out)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    joins = re.findall(r"SortMergeJoin \[(ip#\d+L)", text)
    assert len(joins) == 3 and len(set(joins)) == 1
    assert re.findall(rf"Exchange hashpartitioning\(({joins[0]}[^)]*)\)", text) == [f"{joins[0]}, 8"]


def test_features_of_one_key_share_one_sort(spark, sf):
    text = plan(W.click_gaps(clicks(spark, sf), "ip", prev=(1, 2), nxt=(1, 2)))
    assert text.count("Sort [") == 1 and len(re.findall(r"\+- Window \[", text)) == 1


def test_scan_is_pruned_and_filtered(spark, sf):
    text = plan(clicks(spark, sf).where(F.col("ip") == 8).select("row_id", "ip"))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(user_id,8\)", text)
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in text


def test_edges_are_limited_before_the_exchange(spark, sf):
    text = plan(W.click_gaps(clicks(spark, sf), "app", prev=(2,), chunk_rows=50))
    assert "row_number(), 2, Partial" in text


def test_chunked_counts_equal_batch_counts(spark, sf):
    events = read_table(spark, sf, "events").select("user_id")
    folder = store.scratch_path(spark, "test-chunks")
    for _ in range(2):
        events.repartition(3).write.mode("append").parquet(folder)
    got = chunked_count_map(read_chunks(spark, folder, events.schema), "user_id")
    want = events.groupBy("user_id").agg((F.count(F.lit(1)) * 2).alias("user_id_cnt"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_materialize_computes_once(spark, sf):
    calls = []

    def compute():
        calls.append(1)
        return {"a": spark.range(3), "b": spark.range(4)}

    paths = {k: store.scratch_path(spark, f"once-{k}") for k in "ab"}
    for rewrite in (False, False, True):
        out = store.materialize(spark, compute, paths, rewrite)
    assert len(calls) == 2 and (out["a"].count(), out["b"].count()) == (3, 4)


def test_cache_path_depends_on_parameters(spark):
    base = store.cache_path(spark, "op", {"seed": 1}, ["x"])
    assert base == store.cache_path(spark, "op", {"seed": 1}, ["x"])
    assert len({base, store.cache_path(spark, "op", {"seed": 2}, ["x"]), store.cache_path(spark, "op", {"seed": 1}, ["y"])}) == 3


@pytest.fixture
def no_broadcast(spark):
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"]
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("-1", "false")):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def test_all_count_maps_come_from_one_scan(spark, sf):
    log = coded(spark, sf)
    text = plan(grouped([log], COUNT_KEYS, [F.count(F.lit(1))]))
    assert text.count("FileScan") == 1 and text.count("Expand") == 1 and text.count("Exchange hashpartitioning") == 1
    for keys, got in count_maps([log]):
        want = count_map([log], keys)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_count_maps_of_nulls_repeats_and_nothing(spark):
    log = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, 2, "y"), (1, 2, None)], "a int, b int, c string")
    sets = [["a"], ["b", "a"], ["a", "b"], ["c", "b"], ["a"]]
    for keys, got in count_maps([log, log], sets):
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, count_map([log, log], keys).collect()), key=str)
    assert all(m.count() == 0 for _, m in count_maps([log.where("false")], sets))


def test_counts_in_buckets_move_nothing(spark, sf, no_broadcast):
    log = coded(spark, sf)
    local = [k for k in COUNT_KEYS if "ip" in k or any(c.startswith("ip_") for c in k)]
    assert len(local) == 7
    out = add_counts_in_place(log, BUCKETED_BY, DETERMINE_IT, local)
    assert "Exchange" not in plan(out)
    want = add_count_maps(log, [log], local)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.select(*out.columns).collect()))


def test_bucketed_table_of_another_session(spark, sf):
    log = clicks(spark, sf).select("row_id", "ip", "app")
    path = store.scratch_path(spark, "test-buckets")
    store.save_bucketed(log, path, "ip", 4)
    spark.sql(f"DROP TABLE {store._bucket_table(path)}")
    back = store.load_bucketed(spark, path, "ip", 4)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, log.collect()))
    assert "Exchange" not in plan(back.groupBy("ip", "app").count())


@pytest.mark.parametrize("cut", [None, 2])
def test_nested_dictionaries_equal_single_ones(spark, cut):
    rows = [(i, i % 4 if i % 9 else None, i % 3, "abc"[i % 2] if i % 5 else None, None if i % 7 == 0 else i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "row_id int, p int, q int, r string, s int")
    sets = [["p", "q"], ["p", "q", "r"], ["p", "q", "r", "s"]]
    got = {tuple(r) for r in encode_all(df, [df], sets, cut).select("row_id", "p_q", "p_q_r", "p_q_r_s").collect()}
    want = df
    for keys in sets:
        want = encode_keys(want, key_dictionary([df], keys, chunk_rows=cut), keys)
    assert got == {tuple(r) for r in want.select("row_id", "p_q", "p_q_r", "p_q_r_s").collect()}
    # Fitted on other rows: beginnings that are known have a code, whatever follows.
    half = encode_all(df, [df.where("row_id < 9")], sets, cut)
    for keys in sets:
        one = encode_keys(df, key_dictionary([df.where("row_id < 9")], keys, chunk_rows=cut), keys)
        assert {tuple(r) for r in half.select("row_id", "_".join(keys)).collect()} == {tuple(r) for r in one.select("row_id", "_".join(keys)).collect()}
    assert encode_all(df.where("false"), [df.where("false")], sets, cut).count() == 0


@pytest.mark.parametrize("skip, limit", [(0, 5), (300, 40), (995, 100), (0, None), (990, None), (2000, 3), (999, 1)])
@pytest.mark.parametrize("cut", [None, 64])
def test_slice_equals_limit_offset(spark, skip, limit, cut):
    rows = [(i * 7 % 1000, i % 3, None if i % 50 == 0 else i % 40) for i in range(1000)]
    df = spark.createDataFrame(rows, "row_id long, app int, x int").repartition(4)
    for order in (["row_id"], ["x", "row_id"]):
        want = sorted(rows, key=lambda r: r[0]) if order == ["row_id"] else sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        got = sorted(map(tuple, skip_limit(df, skip, limit, order, cut).collect()), key=str)
        assert got == sorted(want[skip : None if limit is None else skip + limit], key=str)


def test_slice_reads_and_sorts_only_its_pieces(spark, sf):
    path = store.scratch_path(spark, "test-slice")
    clicks(spark, sf).select("row_id", "ip").write.parquet(path)
    out = skip_limit(spark.read.parquet(path), 300, 40, chunk_rows=50)
    text = plan(out)
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(row_id,\d+\)[^\]]*LessThanOrEqual\(row_id,\d+\)", text)
    low, high = (int(re.search(rf"{name}\(row_id,(\d+)\)", text)[1]) for name in ("GreaterThanOrEqual", "LessThanOrEqual"))
    ids = sorted(r.row_id for r in spark.read.parquet(path).collect())
    assert sum(low <= i <= high for i in ids) <= 40 + 2 * 2 * 50  # pieces are about 50 rows, by sample
    assert sorted(r.row_id for r in out.collect()) == ids[300:340]


def test_epoch_range_reaches_the_scan(spark, sf):
    at = F.col("click_time")
    log = clicks(spark, sf)
    for low, high in ((309600, 349200), (None, 1000000), (2000000, None)):
        got = log.where(epoch_between(at, low, high, EVENTS_ORIGIN))
        assert re.search(r"PushedFilters: \[[^\]]*(GreaterThanOrEqual|LessThan)\(ts,", plan(got))
        t = F.col("epoch_time")
        want = log.where(F.lit(True) if low is None else t >= low).where(F.lit(True) if high is None else t <= high)
        assert sorted(r.row_id for r in got.collect()) == sorted(r.row_id for r in want.collect())
