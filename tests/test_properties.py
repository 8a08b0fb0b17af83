"""Properties that must hold on any data, checked on a log where one key has a third of the rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clickloom.functions.arrays import repeat_rows
from clickloom.operators import counts as N
from clickloom.operators import encoder as E
from clickloom.operators import metrics as M
from clickloom.operators import profile as P
from clickloom.operators import splits as S
from clickloom.operators import windows as W
from clickloom.operators.keys import encode_keys, key_dictionary
from clickloom.operators.scaling import QuantileMap
from clickloom.operators.sequences import histories
from clickloom.plans.joins import KeySample, attach
from clickloom.plans.ordered import LastN, Position, RollingMean, Running, Shift, ordered_features
from clickloom.plans.quantiles import grouped_quantiles
from clickloom.plans.splits import split_points
from clickloom.sources.scans import skip_limit

ROWS = 900


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    key = rng.integers(1, 25, ROWS)
    key[rng.random(ROWS) < 0.35] = 0
    t = rng.integers(0, 200, ROWS)
    t[rng.random(ROWS) < 0.1] = 77
    return pd.DataFrame({"row_id": np.arange(ROWS), "ip": key, "app": rng.integers(0, 4, ROWS), "epoch_time": t,
                         "is_attributed": rng.integers(0, 2, ROWS), "x": rng.normal(size=ROWS).round(2)})


@pytest.fixture(scope="module")
def log(spark, frame):
    """The log with a share of null keys, in no particular order."""
    df = spark.createDataFrame(frame).repartition(5, "x")
    return df.withColumn("ip", F.when(F.col("row_id") % 10 != 3, F.col("ip")))


def rows(df, order="row_id"):
    return [tuple(r) for r in df.orderBy(order).collect()]


NAMES = ["s", "n", "lo", "hi", "b1", "b3", "a2", "last", "mean", "at"]


def features():
    return [
        Running("s", F.col("is_attributed"), "sum"),
        Running("n", F.lit(1), "count", current=True),
        Running("lo", F.col("x"), "min"),
        Running("hi", F.col("x"), "max", current=True),
        Shift("b1", F.col("x"), 1),
        Shift("b3", F.col("x"), 3),
        Shift("a2", F.col("x"), -2),
        LastN("last", F.when(F.col("app") > 0, F.col("app")), 4),
        RollingMean("mean", F.col("x"), 5),
        Position("at"),
    ]


def by_hand(frame):
    known = frame[frame.row_id % 10 != 3].sort_values(["ip", "epoch_time", "row_id"])
    out = {int(i): (int(i), *[None] * len(NAMES)) for i in frame.row_id}
    for _, g in known.groupby("ip"):
        x, y, app, ids = g.x.tolist(), g.is_attributed.tolist(), g.app.tolist(), g.row_id.tolist()
        for i, r in enumerate(ids):
            recent = x[max(0, i - 4): i + 1]
            out[r] = (r, sum(y[:i]) if i else None, i + 1, min(x[:i], default=None), max(x[: i + 1]),
                      x[i - 1] if i >= 1 else None, x[i - 3] if i >= 3 else None, x[i + 2] if i + 2 < len(x) else None,
                      [a if a > 0 else None for a in app[max(0, i - 4): i]], pytest.approx(sum(recent) / len(recent)), i)
    return [out[i] for i in sorted(out)]


@pytest.mark.parametrize("cut", [None, 100, 20, 3])
def test_cut_groups_equal_brute_force(log, frame, cut):
    out = ordered_features(log, ["ip"], ["epoch_time", "row_id"], features(), cut)
    assert rows(out.select("row_id", *NAMES)) == by_hand(frame)


def test_pieces_are_bounded(log):
    splits = split_points(log, ["ip"], ["epoch_time", "row_id"], 40)
    sizes = splits.assign(log).groupBy("ip", *splits.columns).count().agg(F.max("count")).first()[0]
    assert sizes <= 80
    assert splits.spread_nulls >= 2


def test_partitioning_changes_nothing(log):
    gaps = [rows(W.click_gaps(df, "ip", (1, 2), (1,), chunk_rows=30)) for df in (log, log.repartition(1), log.repartition(7, "app"))]
    assert gaps[0] == gaps[1] == gaps[2]


def test_previous_of_next(log):
    df = log.where("ip is not null")
    out = ordered_features(df, ["ip"], ["epoch_time", "row_id"], [Shift("nxt", F.col("row_id"), -2), Shift("prv", F.col("row_id"), 2)], 25)
    back = out.select("row_id", "nxt").where("nxt is not null").alias("a").join(out.alias("b"), F.col("a.nxt") == F.col("b.row_id"))
    assert back.where(F.col("b.prv") != F.col("a.row_id")).count() == 0


@pytest.mark.parametrize("cut", [None, 50, 7])
def test_codes_are_dense_and_sorted(log, frame, cut):
    found = rows(key_dictionary([log.where("ip is not null")], ["ip", "x"], "code", cut), "code")
    want = sorted({(i, x) for i, x, r in zip(frame.ip, frame.x, frame.row_id) if r % 10 != 3})
    assert [(a, b) for a, b, _ in found] == want
    assert [c for *_, c in found] == list(range(len(want)))


@pytest.mark.parametrize("cut", [None, 60])
def test_salted_join_keeps_every_row(log, cut):
    table = N.count_map([log], ["ip"])
    plain = log.join(table, "ip", "left").select(*log.columns, "ip_cnt")
    assert rows(attach(log, table, ["ip"], chunk_rows=cut)) == rows(plain)


def test_hot_key_is_found(log):
    hot = KeySample(log, ["ip"], 60).hot(["ip"])
    assert {h[0] for h in hot} >= {0, None}


def test_counts_add_up(log):
    assert N.count_map([log], ["app"]).agg(F.sum("app_cnt")).first()[0] == ROWS


def test_out_of_fold_never_sees_own_fold(log, frame):
    fold = (F.col("row_id") % 4).cast("int")
    tr, _ = E.out_of_fold_means(log, log, ["app"], "is_attributed", fold=fold, chunk_rows=100)
    for r in tr.select("row_id", "app", "app_mean").collect():
        rest = frame[(frame.app == r["app"]) & (frame.row_id % 4 != r["row_id"] % 4)]
        assert r["app_mean"] == pytest.approx(rest.is_attributed.mean())


def test_out_of_fold_is_null_without_other_folds(spark):
    tr = spark.createDataFrame([(0, "a", 1), (5, "a", 0), (1, "b", 1), (2, "b", 0)], "row_id bigint, k string, y int")
    out = rows(E.out_of_fold_means(tr, tr, ["k"], "y", k=5, seed=None)[0].select("row_id", "k_mean"))
    assert out == [(0, None), (1, 0.0), (2, 1.0), (5, None)]


@pytest.mark.parametrize("cut", [None, 40])
def test_auc_equals_brute_force(log, frame, cut):
    scored = log.withColumn("score", F.floor(F.col("x") * 4))
    got = {r["app"]: r["auc"] for r in M.roc_auc(scored, by=["app"], chunk_rows=cut).collect()}
    for app, g in frame.assign(score=np.floor(frame.x * 4)).groupby("app"):
        pos, neg = g[g.is_attributed == 1].score.to_numpy(), g[g.is_attributed == 0].score.to_numpy()
        wins = (pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2
        assert got[app] == pytest.approx(wins / len(pos) / len(neg))


@pytest.mark.parametrize("cut", [None, 30])
@pytest.mark.parametrize("probs", [[0.25, 0.5, 0.9], 11])
def test_quantiles_equal_numpy(log, frame, cut, probs):
    got = {r["app"]: r["quantiles"] for r in grouped_quantiles(log.select("app", "x"), ["app"], "x", probs, cut).collect()}
    grid = np.linspace(0, 1, probs) if isinstance(probs, int) else probs
    for app, g in frame.groupby("app"):
        assert got[app] == pytest.approx(np.quantile(g.x, grid).tolist())


def test_median_encoder(log, frame):
    got = {r["app"]: r["app_median"] for r in E.GroupEncoder("app", "x", "median").fit(log).table.collect()}
    assert got == {k: pytest.approx(v) for k, v in frame.groupby("app").x.median().items()}


def test_unknown_statistic(log):
    with pytest.raises(ValueError, match="unknown statistic"):
        E.GroupEncoder("app", "x", "mode_of_nothing").fit(log)
    with pytest.raises(TypeError):
        E.GroupEncoder("app", "x").fit(log).transform([1])


def test_encoder_names():
    assert E.GroupEncoder(["a", "b"], "y", "mean").feature == "a_b_mean"
    assert E.GroupEncoder("ab", "y", "count").feature == "ab_count"


def test_additive_aggregate_over_many_batches(spark, log, frame):
    share = E.AdditiveAggregate(lambda s, cut: [(s > cut).sum(), len(s)], lambda st: st[0] / st[1], 2)
    got = E.GroupEncoder("app", "x", share, "v", func_kwargs={"cut": 0.5}).fit(log.repartition(9)).table.collect()
    assert {r["app"]: r["v"] for r in got} == {k: pytest.approx(v) for k, v in (frame.x > 0.5).groupby(frame.app).mean().items()}


def test_normal_map(spark):
    x = np.random.default_rng(1).exponential(size=2000)
    df = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(2000), "x": x}))
    df = df.withColumn("x", F.when(F.col("row_id") != 7, F.col("x")))
    got = QuantileMap.fit(df, ["x"]).transform(df).orderBy("row_id").toPandas().x
    assert np.isnan(got[7])
    keep = np.arange(2000) != 7
    z = got[keep].to_numpy()
    assert (np.diff(z[np.argsort(x[keep])]) >= 0).all()
    inner = np.abs(z) < 5
    assert abs(z[inner].mean()) < 0.02 and abs(z[inner].std() - 1) < 0.05
    assert z.max() == pytest.approx(5.199337582, abs=1e-6) and z.min() == pytest.approx(-5.199337582, abs=1e-6)


def test_batches(log):
    out = S.shuffled_batches(log, 64, chunk_rows=100)
    sizes = [r["count"] for r in out.groupBy("batch_id").count().collect()]
    assert sizes == [64] * (ROWS // 64)
    kept = S.shuffled_batches(log, 64, keep_short=True, chunk_rows=100)
    assert kept.count() == ROWS and kept.select("batch_id").distinct().count() == ROWS // 64 + 1
    other = S.shuffled_batches(log, 64, epoch=1, chunk_rows=100)
    assert rows(other.select("row_id", "batch_id")) != rows(out.select("row_id", "batch_id"))


def test_random_split_is_repeatable(log):
    a, b = S.random_split(log, 0.8)
    again, _ = S.random_split(log.repartition(3), 0.8)
    assert rows(a.select("row_id")) == rows(again.select("row_id"))
    assert a.count() + b.count() == ROWS and 0.7 < a.count() / ROWS < 0.9


def test_skip_limit(log):
    assert [r[0] for r in rows(skip_limit(log, 100, 50, chunk_rows=64).select("row_id"))] == list(range(100, 150))
    assert skip_limit(log, 850, chunk_rows=64).count() == 50


def test_repeat_rows(spark):
    df = spark.createDataFrame([("a", 7), ("b", 0), ("c", 3)], "k string, n bigint")
    got = {r["k"]: r["count"] for r in repeat_rows(df, "n", block=2).groupBy("k").count().collect()}
    assert got == {"a": 7, "c": 3}


def test_bincount_fills_zeros(spark):
    df = spark.createDataFrame([(0,), (3,), (3,), (None,)], "c bigint")
    assert rows(P.bincount(df, "c"), "c") == [(0, 1), (1, 0), (2, 0), (3, 2)]


def test_plateau_cut_equals_whole(log):
    df = log.withColumn("run", F.col("app")).select("run", F.col("row_id").alias("step"), "x")
    whole, cut = (W.plateau(df, "run", "step", "x", 10, 50, chunk_rows=c) for c in (None, 30))
    pick = ["step", "best_step", "steps_since_best", "should_stop"]
    assert rows(whole.select(*pick), "step") == rows(cut.select(*pick), "step")


def test_histories_cut_equal_whole(log):
    df = log.withColumns({"os": F.col("app"), "device": F.col("app"), "channel": F.col("app")}).where("ip is not null")
    assert rows(histories(df, width=6, mode="slice")) == rows(histories(df, width=6, mode="slice", chunk_rows=20))


def test_encode_unseen_is_null(spark, log):
    d = key_dictionary([log.where("app < 3")], ["app"], "code")
    out = encode_keys(log, d, ["app"], chunk_rows=100)
    assert out.where("app = 3 and code is not null or app < 3 and code <> app").count() == 0


def test_double_registration_is_refused():
    from clickloom.registry.base import query

    with pytest.raises(ValueError, match="twice"):
        query("win_prev_click")(lambda s, d: None)
