"""Group statistics as an ML stage: persistence, pipelines, validators."""

from __future__ import annotations

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

from clickloom.operators.encoder import GroupEncoder
from clickloom.operators.stage import GroupStatistic, GroupStatisticModel


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, "abc"[i % 3] if i % 8 else None, i % 5, float(i * i % 17) if i % 6 else None, float(i * 7 % 3 == 0)) for i in range(90)]
    return spark.createDataFrame(data, "row_id long, k string, j int, y double, label double")


@pytest.fixture(scope="module")
def others(spark, rows):
    return rows.unionByName(spark.createDataFrame([(900, "new", 1, 1.0, 0.0), (901, None, None, None, 1.0)], rows.schema))


def said(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("how, keys, more", [("mean", ["k"], {}), ("count", ["k", "j"], {"minCount": 4}), ("std", ["j"], {}), ("nunique", ["k"], {}),
                                             ("median", ["k"], {}), ("quantile", ["k", "j"], {"quantile": 0.25})])
def test_fit_save_load_equals_the_encoder(rows, others, tmp_path, how, keys, more):
    stage = GroupStatistic(keyCols=keys, targetCol="y", statistic=how, outputCol="f", **more)
    kwargs = {"q": more["quantile"]} if how == "quantile" else {}
    want = GroupEncoder(keys, "y", how, "f", more.get("minCount", 0), kwargs).fit(rows).transform(others)
    stage.write().save(str(tmp_path / "stage"))
    model = GroupStatistic.load(str(tmp_path / "stage")).fit(rows)
    model.write().save(str(tmp_path / "model"))
    back = GroupStatisticModel.load(str(tmp_path / "model"))
    assert said(model.transform(others)) == said(want) == said(back.transform(others))
    assert back.uid == model.uid and back.feature() == "f"
    assert {r.row_id: r.f for r in back.transform(others).collect()}[901] is None


def test_pipeline_and_cross_validator(rows, tmp_path):
    stage = GroupStatistic(keyCols=["k"], targetCol="y")
    assert stage.feature() == "k_mean"
    fill = Imputer(inputCols=["k_mean"], outputCols=["filled"])
    flow = Pipeline(stages=[stage, fill, VectorAssembler(inputCols=["filled"], outputCol="features"), LogisticRegression(maxIter=3)])
    model = flow.fit(rows)
    model.write().save(str(tmp_path / "flow"))
    assert said(PipelineModel.load(str(tmp_path / "flow")).transform(rows).select("row_id", "k_mean", "prediction")) == said(
        model.transform(rows).select("row_id", "k_mean", "prediction"))
    grid = ParamGridBuilder().addGrid(stage.minCount, [0, 5]).addGrid(stage.statistic, ["mean", "max"]).build()
    for params in grid:
        params[stage.outputCol] = "k_mean"
    tuned = CrossValidator(estimator=flow, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(), numFolds=2, seed=3).fit(rows)
    assert len(tuned.avgMetrics) == 4 and "k_mean" in tuned.transform(rows).columns


def test_unknown_statistic(rows):
    with pytest.raises(ValueError, match="unknown statistic"):
        GroupStatistic(keyCols=["k"], targetCol="y", statistic="none").fit(rows)
