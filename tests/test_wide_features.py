"""What the steps of the 23 columns read and move."""

from __future__ import annotations

import re

import pytest

import clickloom.plans.joins as joins
import clickloom.plans.ordered as ordered
from clickloom.operators.encoder import count_features
from clickloom.operators.keys import encode_all
from clickloom.registry import base, scores
from clickloom.sources import store


def test_wide_features_count_and_sample_tables_only(spark, sf, monkeypatch):
    """A count or a sample of a long plan runs all its joins and windows again, and keeps another such plan on the driver."""
    read, find, start = [], ordered.split_points, joins.KeySample.__init__

    def points(df, keys, order, *args, **options):
        read.append(df.select(*dict.fromkeys([*keys, *order])))
        return find(df, keys, order, *args, **options)

    def sample(self, df, cols, *args):
        read.append(df.select(*dict.fromkeys(cols)))
        start(self, df, cols, *args)

    monkeypatch.setattr(ordered, "split_points", points)
    monkeypatch.setattr(joins.KeySample, "__init__", sample)
    scores.wide_features(spark, sf)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in read]
    assert len(plans) > 10 and not any("Join" in p or "Window" in p for p in plans)


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_codes_stay_where_their_ip_is(spark, sf, no_broadcast, monkeypatch):
    """The windows of three codes and four joins need one shuffle by ip, not one each."""
    written, write = [], scores.roundtrip
    monkeypatch.setattr(scores, "roundtrip", lambda df, name: (written.append(df), write(df, name))[1])
    tr, _ = scores.wide_features(spark, sf)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in written]
    assert tr.columns == ["row_id", *scores.NORMAL_COLUMNS]
    assert not any(re.search(r"Exchange hashpartitioning\([^)]*ip_device_os", p) for p in plans)
    assert plans[0].count("Exchange hashpartitioning") == 3


def test_counts_with_the_ip_in_front(spark):
    log = spark.createDataFrame([(1, 7, 0, 1), (1, 7, 1, None), (2, 8, 0, 1), (None, None, 1, 1), (2, None, 0, 0)], "ip long, code long, app int, y int")
    sets = [["ip"], ["code"], ["app"], ["app", "code"]]
    want = count_features(log, log.limit(0), sets, "y")[0]
    got = count_features(log, log.limit(0), sets, "y", by="ip", determines=["code"])[0]
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_the_base_table_is_dealt_without_what_the_time_gives(spark, sf, monkeypatch):
    dealt, save = [], base.save_bucketed
    monkeypatch.setattr(base, "is_written", lambda *_: False)
    monkeypatch.setattr(base, "cache_path", lambda spark, *_: store.scratch_path(spark, "test-base"))
    monkeypatch.setattr(base, "save_bucketed", lambda df, *args: (dealt.append(df), save(df, *args)))
    got = base.coded(spark, sf)
    assert not {"epoch_time", "epoch_minute", "split", "hourofday"} & set(dealt[0].columns)
    log = base.clicks(spark, sf)
    assert got.columns == [*log.columns, *base.DETERMINE_IT]
    assert got.drop(*base.DETERMINE_IT).exceptAll(log).isEmpty() and got.count() == log.count()


def test_keys_with_nulls_come_back_from_their_stand_ins(spark):
    rows = [(1, 5, None), (1, None, "x"), (None, 5, "x"), (0, 0, ""), (1, 5, "x"), (None, None, None)]
    log = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, a int, b long, c string")
    got = encode_all(log, [log], [["a", "b"], ["a", "b", "c"]])
    assert [(c.name, c.dataType) for c in got.schema][:4] == [(c.name, c.dataType) for c in log.schema]
    assert sorted(map(str, got.select(*log.columns).collect())) == sorted(map(str, log.collect()))
    assert all((r.a_b is None) == (None in rows[r.row_id][:2]) for r in got.collect())
