"""Model jobs: trees chosen by AUC, fits side by side, columns binned once."""

from __future__ import annotations

import threading
import time
from dataclasses import replace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.operators import model as L

FEATS = ["a", "b", "c"]
PARAMS = L.BoostParams(trees=6, depth=3, bins=16, pos_weight=2.0, patience=3)

#: AUC by the rank sum of the positives, ties at their middle rank.
AUC = """SELECT trees, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc
FROM (SELECT trees, is_attributed AS y, rank() OVER (PARTITION BY trees ORDER BY score) + (count(*) OVER (PARTITION BY trees, score) - 1) / 2 AS r FROM '{path}/*.parquet')
GROUP BY trees ORDER BY trees"""


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(6)
    a, b, c = rng.normal(size=900), rng.integers(0, 5, 900), rng.normal(size=900)
    y = (a + 0.5 * (b == 2) + rng.normal(size=900) * 0.8 > 0.6).astype(int)
    rows = [(i, float(a[i]), int(b[i]) if i % 9 else None, float(c[i]), int(y[i])) for i in range(900)]
    df = spark.createDataFrame(rows, "row_id long, a double, b int, c double, is_attributed int")
    return df.where("row_id < 600").repartition(2).cache(), df.where("row_id >= 600").repartition(2).cache()


@pytest.fixture(scope="module")
def fitted(tables):
    return L.fit_score(*tables, FEATS, PARAMS)


def test_prefix_aucs_equal_sql_over_written_scores(fitted, tmp_path):
    path = str(tmp_path / "scores")
    L.per_prefix(fitted.staged).write.parquet(path)
    want = duckdb.connect().execute(AUC.format(path=path)).fetchall()
    assert [t for t, _ in want] == list(range(1, fitted.model.getNumTrees + 1))
    assert fitted.aucs == pytest.approx([auc for _, auc in want])
    assert fitted.auc == max(fitted.aucs[: fitted.best_trees])


def test_all_trees_give_the_models_own_scores(fitted, tables):
    own = {r.row_id: r.score for r in L.score(fitted.model, tables[1], FEATS).collect()}
    all_trees = L.per_prefix(fitted.staged).where(F.col("trees") == fitted.model.getNumTrees)
    got = {r.row_id: r.score for r in all_trees.collect()}
    assert got == pytest.approx(own) and len(got) == 300
    best = {r.row_id: r.score for r in L.per_prefix(fitted.staged).where(F.col("trees") == fitted.best_trees).collect()}
    assert best == {r.row_id: r.score for r in fitted.scores.collect()}


@pytest.mark.parametrize("aucs, patience, want", [
    ([0.5], 5, 1), ([0.5, 0.7, 0.6], 5, 2), ([0.7, 0.7], 5, 1), ([0.6, 0.5, 0.5, 0.9], 2, 1), ([0.6, 0.5, 0.5, 0.9], 3, 4),
])
def test_best_prefix(aucs, patience, want):
    assert L.best_prefix(aucs, patience) == want


def test_refit_scales_the_best_number_of_trees(fitted, tables):
    again = L.refit_full(*tables, replace(fitted, best_trees=2), 100, 250)
    assert again.model.getNumTrees == 5 and again.scores.count() == 300


def test_one_class_in_validation(tables):
    fitted = L.fit_score(tables[0], tables[1].where("is_attributed = 0"), FEATS, replace(PARAMS, trees=2))
    assert fitted.aucs == [0.5, 0.5] and fitted.best_trees == 1


def test_bins_by_quantiles_of_the_first_table(tables):
    tr, val = L.binned(tables, FEATS, 16)
    for df, raw in ((tr, tables[0]), (val, tables[1])):
        both = df.join(raw.select("row_id", *[F.col(f).alias(f"raw_{f}") for f in FEATS]), "row_id").toPandas()
        assert len(both) == raw.count()
        for f in FEATS:
            known = both[both[f"raw_{f}"].notna()].sort_values(f"raw_{f}")
            assert known[f].is_monotonic_increasing and known[f].nunique() > 4
            assert both[both[f"raw_{f}"].isna()][f].isna().all() and known[f].notna().all()
    assert max(tr.agg(*[F.max(f) for f in FEATS]).first()) < 15


def by_loop(tables, base, candidates):
    """Forward selection as a plain loop over single fits."""
    tr, val = L.binned(tables, [*base, *candidates], PARAMS.bins)
    kept, best = [], L.fit_score(tr, val, base, PARAMS).auc
    rows = [(0, "", best, True)]
    for i, c in enumerate(candidates, 1):
        got = L.fit_score(tr, val, [*base, *kept, c], PARAMS).auc
        rows.append((i, c, got, got > best))
        if got > best:
            best = got
            kept.append(c)
    return rows


@pytest.mark.parametrize("at_once", [1, 3])
def test_forward_selection_equals_a_loop(tables, at_once):
    seen = []
    got = L.forward_selection(*tables, ["c"], ["b", "a"], PARAMS, seen.append, at_once)
    want = by_loop(tables, ["c"], ["b", "a"])
    assert [tuple(r) for r in got.orderBy("step").collect()] == want
    assert len(seen) == sum(kept for _, c, _, kept in want if c)


def test_incremental_and_sweep_equal_single_fits(tables):
    tr, val = L.binned(tables, FEATS, PARAMS.bins)
    got = {r.candidate: (r.trees, r.auc) for r in L.incremental_eval(*tables, ["c"], ["a", "b"], PARAMS).collect()}
    one = L.fit_score(tr, val, ["c", "a"], PARAMS)
    assert set(got) == {"a", "b"} and got["a"] == (one.best_trees, one.auc)
    sets = {"x": PARAMS, "y": replace(PARAMS, trees=2, depth=2)}
    swept = {r.params: (r.trees, r.auc) for r in L.param_sweep(*tables, FEATS, sets).collect()}
    assert list(swept) == ["x", "y"] and swept["y"][0] <= 2


def test_side_by_side_keeps_order_and_bounds(spark):
    lock, now, most = threading.Lock(), [0], [0]

    def job(i):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.05 * (5 - i % 5))
        pool = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
        with lock:
            now[0] -= 1
        return i, pool

    got = L.side_by_side(spark, [lambda i=i: job(i) for i in range(9)], 3)
    assert [i for i, _ in got] == list(range(9)) and 1 < most[0] <= 3
    assert {p for _, p in got} == {"fit-0", "fit-1", "fit-2"}
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None

    def fails():
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        L.side_by_side(spark, [fails, lambda: 1], 2)
