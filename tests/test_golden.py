"""Small cases with results worked out by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from clickloom.functions import arrays as A
from clickloom.functions.calendar import time_details, with_calendar
from clickloom.functions.columns import narrow
from clickloom.operators import encoder as E
from clickloom.operators import metrics as M
from clickloom.operators import windows as W
from clickloom.operators.sequences import histories
from clickloom.operators.splits import split_complement
from clickloom.operators.timefeat import add_time_features, from_supplement

# Both ways through the ordered features: whole groups, and groups cut after every row or two.
CUTS = [None, 2, 1]


def col(df, name, order="row_id"):
    return [r[name] for r in df.orderBy(order).collect()]


@pytest.mark.parametrize("cut", [None, 3])
def test_adjacent_diff(spark, cut):
    groups = [7, 7, 2, 7, 2, 2, 9, 9, 9, 7]
    times = [3, 5, 5, 9, 12, 20, 20, 21, 30, 31]
    df = spark.createDataFrame(list(zip(range(10), groups, times)), "row_id bigint, g int, t bigint")
    out = W.adjacent_diff(df, F.col("g"), F.col("t"), chunk_rows=cut)
    assert col(out, "group_diff") == [7200, 2, 7200, 7200, 7200, 8, 7200, 1, 9, 7200]


@pytest.mark.parametrize("cut", CUTS)
def test_time_pairs(spark, cut):
    keys = [6, 6, 1, 6, 1, 3, 3, 6, 1]
    times = [0, 0, 1, 4, 5, 5, 9, 9, 9]
    df = spark.createDataFrame(list(zip(range(9), keys, times)), "row_id bigint, k int, epoch_time bigint")
    out = add_time_features(df, [df], ["k"], na_val=7200, chunk_rows=cut)
    assert col(out, "k_timecount") == [2, 2, 1, 1, 1, 1, 1, 1, 1]
    assert col(out, "k_timediff") == [7200, 7200, 7200, 4, 4, 7200, 4, 5, 4]


def labelled(spark):
    rows = [(0, "a", 1, 0), (1, "b", 0, 1), (2, "a", 0, 2), (3, "b", 1, 3), (4, "c", 1, 4)]
    tr = spark.createDataFrame(rows, "row_id bigint, k string, is_attributed int, epoch_time bigint")
    val = spark.createDataFrame([(5, "a"), (6, "z"), (7, None)], "row_id bigint, k string")
    return tr, val


@pytest.mark.parametrize("cut", CUTS)
def test_expanding(spark, cut):
    tr, val = W.expanding(*labelled(spark), ["k"], chunk_rows=cut)
    assert col(tr, "k_expmean") == [-1, -1, 1.0, 0.0, -1]
    assert col(tr, "k_expcount") == [0, 0, 1, 1, 0]
    assert col(val, "k_expmean") == [0.5, -1, -1]
    assert col(val, "k_expcount") == [2, 0, 0]


@pytest.mark.parametrize("cut", CUTS)
def test_expanding_global_shift(spark, cut):
    (tr,) = W.expanding(labelled(spark)[0], None, ["k"], group_shift="global", chunk_rows=cut)
    assert col(tr, "k_expmean") == [-1, 0.5, 1.0, 0.0, 0.5]
    assert col(tr, "k_expcount") == [0, 2, 1, 1, 2]


@pytest.mark.parametrize("cut", CUTS)
def test_gaps(spark, cut):
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate([10, 10, 13, 20])], "row_id bigint, ip int, epoch_time bigint")
    out = W.click_gaps(df, "ip", prev=(1, 2), nxt=(1, 2), chunk_rows=cut)
    assert col(out, "ip_prev_click_1") == [-1, 0, 3, 7]
    assert col(out, "ip_prev_click_2") == [-1, -1, 3, 10]
    assert col(out, "ip_next_click_1") == [0, 3, 7, -1]
    assert col(out, "ip_next_click_2") == [3, 10, -1, -1]


@pytest.mark.parametrize(("length", "kept", "kept_slice"), [(0, 0, 0), (5, 5, 5), (10, 10, 10), (11, 11, 9), (19, 19, 1), (20, 20, 20), (25, 20, 20)])
def test_left_pad(spark, length, kept, kept_slice):
    df = spark.createDataFrame([(list(range(length)),)], "a array<int>")
    for mode, want in (("keep", kept), ("slice", kept_slice)):
        padded, n = A.left_pad(F.col("a"), 20, mode)
        row = df.select(padded.alias("p"), n.alias("n")).first()
        assert row["n"] == want
        assert row["p"] == [-1] * (20 - want) + list(range(length))[length - want:]


@pytest.mark.parametrize("cut", CUTS)
def test_history(spark, cut):
    rows = [(i, 7, a, 1, 1, 1, t) for i, (a, t) in enumerate([(3, 1), (4, 4), (5, 9)])]
    df = spark.createDataFrame(rows, "row_id bigint, ip int, app int, os int, device int, channel int, epoch_time bigint")
    out = histories(df, chunk_rows=cut)
    apps = col(out, "app_history")
    assert [a[-2:] for a in apps] == [[-1, -1], [-1, 3], [3, 4]]
    assert all(len(a) == 20 and set(a[:-2]) == {-1} for a in apps)
    assert [a[-1] for a in col(out, "time_history")] == [-1, -1, 3]
    assert col(out, "history_length") == [0, 0, 1]


@pytest.mark.parametrize("cut", CUTS)
def test_auc(spark, cut):
    rows = list(zip([0, 0, 1, 1, 0], [0.1, 0.4, 0.4, 0.8, 0.4]))
    df = spark.createDataFrame(rows, "is_attributed int, score double")
    assert M.roc_auc(df, chunk_rows=cut).first()["auc"] == pytest.approx(5 / 6)
    one_class = df.where("is_attributed = 0")
    assert M.roc_auc(one_class).first()["auc"] is None


def test_null_rules(spark):
    rows = [(0, "a", 1), (1, "a", None), (2, None, 1), (3, "b", 2), (4, "a", 3)]
    tr = spark.createDataFrame(rows, "row_id bigint, k string, y int")
    val = spark.createDataFrame([(5, "z", 1)], tr.schema)
    fit_tr = tr.where("k is null or k <> 'none'")
    assert col(E.count_features(fit_tr, val, ["k"], "y")[0], "k_count") == [2, 2, None, 1, 2]
    assert col(E.distinct_features(tr, val, [(["k"], "y")])[0], "k_unq_y") == [2, 2, 0, 1, 2]
    assert col(E.std_features(tr, val, ["k"], "y")[0], "k_std") == [pytest.approx(2**0.5)] * 2 + [None, None] + [pytest.approx(2**0.5)]
    assert col(E.mean_features(tr, val, ["k"], "y")[1], "k_mean") == [None]


def test_calendar(spark):
    rows = [(0, dt.datetime(2017, 11, 6, 14)), (1, dt.datetime(2017, 11, 6, 13, 59, 59, 500000))]
    df = time_details(with_calendar(spark.createDataFrame(rows, "row_id bigint, click_time timestamp_ntz")))
    got = df.orderBy("row_id").select("dayofweek", "hourofday", "epoch_time", "seconds", "epoch_minute", "minutes").collect()
    assert [tuple(r) for r in got] == [(0, 14, 0, 0, 0, 0), (0, 13, -1, 59, -1, 59)]


def test_supplement_takes_the_first_row(spark):
    supp = spark.createDataFrame([(1, 5, 10, "x"), (0, 5, 10, "w"), (2, 6, 10, "y")], "row_id bigint, k int, t int, v string")
    test = spark.createDataFrame([(0, 5, 10), (1, 5, 10), (2, 9, 10)], "row_id bigint, k int, t int")
    assert col(from_supplement(test, supp, ["k", "t"], ["v"]), "v") == ["w", "w", None]


def test_series(spark):
    df = spark.createDataFrame([(0, "1_2_3"), (1, "4"), (2, None)], "row_id int, s string")
    history, label = A.split_series(F.col("s"))
    out = df.select("row_id", history.alias("h"), label.alias("l"), A.drop_last(F.col("s")).alias("d"))
    assert col(out, "h") == [[1, 2], [-1], None]
    assert col(out, "l") == [3, 4, None]
    assert col(out, "d") == [[1, 2], [], [-1]]


def test_narrow(spark):
    df = spark.createDataFrame([(255,), (256,)], "x int")
    assert [r[0] for r in df.select(narrow(F.col("x"), "uint8", wrap=True)).collect()] == [255, 0]
    with pytest.raises(Exception, match="outside uint8"):
        df.select(narrow(F.col("x"), "uint8")).collect()


def test_complement_takes_null_as_not_met(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    met, rest = split_complement(df, F.col("x") > 2)
    assert (met.count(), rest.count()) == (1, 2)


def test_sequence_metrics(spark):
    df = spark.createDataFrame([([1, 0, -1], [0.8, 0.4, 0.5], 2), ([0, -1, -1], [0.1, 0.5, 0.5], 1)], "y array<int>, p array<double>, n int")
    import math

    want = -(math.log(0.8) + math.log(0.6) + math.log(0.9)) / 3
    assert M.sequence_log_loss(df, "y", "p", "n").first()[0] == pytest.approx(want)
    assert M.sequence_rmse(df, "y", "p", "n").first()[0] == pytest.approx(((0.2**2 + 0.4**2 + 0.1**2) / 3) ** 0.5)


def test_calendar_ignores_the_session_time_zone(spark):
    rows = [(0, dt.datetime(2024, 3, 10, 2, 30)), (1, dt.datetime(2024, 3, 11, 0, 0))]
    df = spark.createDataFrame(rows, "row_id bigint, click_time timestamp_ntz")
    origin = dt.datetime(2024, 3, 10, 0, 0)
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        made = time_details(with_calendar(df), origin=origin)
        assert col(made, "epoch_time") == [9000, 86400] and col(made, "hourofday") == [2, 0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_negative_codes_are_an_error(spark):
    from clickloom.operators.profile import bincount

    with pytest.raises(ValueError):
        bincount(spark.createDataFrame([(-2,), (0,), (3,)], "c int"), "c")


def test_adding_a_feature_twice_replaces_it(spark):
    from clickloom.operators.encoder import mean_features

    tr, val = labelled(spark)
    once = mean_features(tr, val, ["k"], "is_attributed")
    twice = mean_features(*once, ["k"], "is_attributed")
    assert [sorted(map(str, a.collect())) for a in once] == [sorted(map(str, a.select(b.columns).collect())) for a, b in zip(twice, once)]


def test_empty_chunk_folder(spark, tmp_path):
    from clickloom.streaming.chunked import chunked_count_map, read_chunks

    empty = spark.createDataFrame([], "k int")
    empty.limit(0).write.parquet(str(tmp_path / "chunks"))
    assert chunked_count_map(read_chunks(spark, str(tmp_path / "chunks"), empty.schema), ["k"]).count() == 0


def test_cache_path_follows_the_input(spark, tmp_path):
    from clickloom.sources.store import cache_path

    path = str(tmp_path / "input")
    spark.range(3).write.parquet(path)
    before = cache_path(spark, "op", {}, [path])
    assert before == cache_path(spark, "op", {}, [path])
    spark.range(9).write.mode("overwrite").parquet(path)
    assert before != cache_path(spark, "op", {}, [path])
