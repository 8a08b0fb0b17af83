"""Fit and score jobs around Spark's gradient-boosted trees.

The number of trees is chosen by the validation AUC of every prefix of the ensemble, found in one pass over the
validation rows. Selection and sweep jobs bin the columns once and run a bounded number of fits side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.operators.metrics import roc_auc
from clickloom.schema import LABEL, ROW_ID
from clickloom.sources.store import roundtrip, shared_dir

Made = TypeVar("Made")

MISSING = -1.0


@dataclass(frozen=True)
class BoostParams:
    """Boosting parameters.

    `pos_weight` weighs positive rows, `min_rows` is the smallest leaf, `row_share` and
    `feature_share` are sampled per tree and per split. With a validation table, the trees that count
    are those up to the best validation AUC, where `patience` more trees without a better one end the search.
    """

    trees: int = 20
    depth: int = 4
    step: float = 0.1
    pos_weight: float = 1.0
    min_rows: int = 1
    row_share: float = 1.0
    feature_share: str = "all"
    patience: int = 100
    bins: int = 64
    seed: int = 786


@dataclass(frozen=True)
class Fitted:
    """A model, its scores, and with a validation table the AUC of each prefix of its trees and the best prefix."""

    model: GBTClassificationModel
    feats: list[str]
    params: BoostParams
    scores: DataFrame = field(repr=False)
    best_trees: int
    aucs: list[float] = field(default_factory=list)
    staged: DataFrame | None = field(default=None, repr=False)

    @property
    def auc(self) -> float:
        """Validation AUC of the trees that count."""
        return self.aucs[self.best_trees - 1]


def assemble(df: DataFrame, feats: Sequence[str]) -> DataFrame:
    """Add the feature vector; missing values become a value of their own."""
    dense = df.withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in feats})
    vector = VectorAssembler(inputCols=[f"_f_{c}" for c in feats], outputCol="features").transform(dense)
    return vector.drop(*[f"_f_{c}" for c in feats])


def score(model: GBTClassificationModel, df: DataFrame, feats: Sequence[str], keep: Sequence[str] = (ROW_ID, LABEL)) -> DataFrame:
    """Probability of the positive class as `score`, with the kept columns."""
    kept = [c for c in keep if c in df.columns]
    narrow = assemble(df.select(*dict.fromkeys([*kept, *feats])), feats).select(*kept, "features")
    return model.transform(narrow).select(*kept, F.get(vector_to_array("probability"), F.lit(1)).alias("score"))


def probability(margin: Column) -> Column:
    """Probability of the positive class at a margin of the boosted trees."""
    return 1 / (1 + F.exp(-2 * margin))


def staged_margins(
    model: GBTClassificationModel, df: DataFrame, feats: Sequence[str], keep: Sequence[str] = (ROW_ID, LABEL)
) -> DataFrame:
    """The kept columns and `margins`: the summed vote after each tree, all trees in one pass over the rows."""
    kept = [c for c in keep if c in df.columns]
    out = assemble(df.select(*dict.fromkeys([*kept, *feats])), feats).select(*kept, "features")
    votes = []
    for i, (tree, weight) in enumerate(zip(model.trees, model.treeWeights)):
        out = tree.setFeaturesCol("features").setPredictionCol(f"_tree{i}").transform(out)
        votes.append(F.col(f"_tree{i}") * weight)
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("all"))
    step = lambda acc, v: F.struct((acc["sum"] + v).alias("sum"), F.array_append(acc["all"], acc["sum"] + v).alias("all"))
    return out.select(*kept, F.aggregate(F.array(*votes), start, step, lambda acc: acc["all"]).alias("margins"))


def per_prefix(staged: DataFrame) -> DataFrame:
    """A row per row and number of trees, with the score of these trees."""
    kept = [c for c in staged.columns if c != "margins"]
    each = staged.select(*kept, F.posexplode("margins").alias("_at", "_margin"))
    return each.select(*kept, (F.col("_at") + 1).alias("trees"), probability(F.col("_margin")).alias("score"))


def prefix_aucs(staged: DataFrame) -> list[float]:
    """AUC after 1, 2, ... trees: one number per tree reaches the driver. A class that is missing counts as 0.5."""
    found = roc_auc(per_prefix(staged), by=["trees"]).collect()
    return [0.5 if r["auc"] is None else float(r["auc"]) for r in sorted(found, key=lambda r: r["trees"])]


def best_prefix(aucs: Sequence[float], patience: int) -> int:
    """Number of trees with the best AUC (the fewest of equals), seen until `patience` trees bring no better one."""
    best = 0
    for i, value in enumerate(aucs):
        if value > aucs[best]:
            best = i
        if i - best >= patience:
            break
    return best + 1


def fit_score(
    tr: DataFrame,
    val: DataFrame,
    feats: Sequence[str],
    params: BoostParams = BoostParams(),
    is_develop: bool = True,
    save_path: str | None = None,
) -> Fitted:
    """Fit on `tr` and score `val`; in development the AUC on `val` decides how many trees count."""
    feats = list(feats)
    spark = tr.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    rows = tr.select(*feats, LABEL).withColumn("_weight", F.when(F.col(LABEL) == 1, params.pos_weight).otherwise(1.0))
    booster = GBTClassifier(
        featuresCol="features",
        labelCol=LABEL,
        weightCol="_weight",
        maxIter=params.trees,
        maxDepth=params.depth,
        stepSize=params.step,
        minInstancesPerNode=params.min_rows,
        subsamplingRate=params.row_share,
        featureSubsetStrategy=params.feature_share,
        maxBins=params.bins,
        seed=params.seed,
    )
    model = booster.fit(assemble(rows, feats).select("features", LABEL, "_weight"))
    if is_develop:
        staged = roundtrip(staged_margins(model, val, feats), "staged")
        aucs = prefix_aucs(staged)
        best = best_prefix(aucs, params.patience)
        kept = [c for c in staged.columns if c != "margins"]
        scores = staged.select(*kept, probability(F.col("margins")[best - 1]).alias("score"))
    else:
        staged, aucs, best = None, [], model.getNumTrees
        scores = score(model, val, feats)
    if save_path:
        scores.write.mode("overwrite").parquet(save_path)
    return Fitted(model, feats, params, scores, best, aucs, staged)


def side_by_side(spark: SparkSession, jobs: Sequence[Callable[[], Made]], at_once: int) -> list[Made]:
    """Results of driver jobs in their order, `at_once` of them running at a time, each slot in a scheduler pool.

    With `spark.scheduler.mode` FAIR the slots share the executors evenly; without, earlier jobs come first. The
    first job that fails raises its error, and jobs that have not begun are dropped.
    """
    def run(i: int, job: Callable[[], Made]) -> Made:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{i % at_once}")
        return job()

    with ThreadPoolExecutor(at_once) as pool:
        futures = [pool.submit(inheritable_thread_target(spark)(run), i, job) for i, job in enumerate(jobs)]
        try:
            return [f.result() for f in futures]
        except BaseException:
            pool.shutdown(wait=False, cancel_futures=True)
            raise


def binned(tables: Sequence[DataFrame], feats: Sequence[str], bins: int, accuracy: float = 0.001) -> list[DataFrame]:
    """The tables, written once, with their features as bin numbers by quantiles of the first table.

    All cuts come from one pass of mergeable sketches (`bins - 2` numbers per column on the driver). Missing values and
    NaN stay null, the one further value, so that a learner with `bins` bins sees the same candidates in every fit.
    """
    feats = list(dict.fromkeys(feats))
    numbers = [df.select(*[c for c in df.columns if c in (ROW_ID, LABEL)], *[F.nullif(F.col(f).cast("double"), F.lit(float("nan"))).alias(f"_raw_{f}") for f in feats]) for df in tables]
    cuts = numbers[0].approxQuantile([f"_raw_{f}" for f in feats], [i / (bins - 1) for i in range(1, bins - 1)], accuracy)
    out = []
    for i, df in enumerate(numbers):
        splits = [[-float("inf"), *sorted(set(c)), float("inf")] for c in cuts]
        cut = Bucketizer(splitsArray=splits, inputCols=[f"_raw_{f}" for f in feats], outputCols=feats, handleInvalid="keep").transform(df)
        kept = [c for c in df.columns if not c.startswith("_raw_")]
        out.append(roundtrip(cut.select(*kept, *[F.col(f).cast("int").alias(f) for f in feats]), f"binned-{i}"))
    return out


def incremental_eval(
    tr: DataFrame, val: DataFrame, base: Sequence[str], candidates: Sequence[str], params: BoostParams = BoostParams(), at_once: int = 4
) -> DataFrame:
    """Validation AUC and trees of the base features plus one candidate at a time, `at_once` fits side by side."""
    tr, val = binned([tr, val], [*base, *candidates], params.bins)
    fits = side_by_side(tr.sparkSession, [lambda c=c: fit_score(tr, val, [*base, c], params) for c in candidates], at_once)
    rows = [(c, f.best_trees, f.auc) for c, f in zip(candidates, fits)]
    return tr.sparkSession.createDataFrame(rows, "candidate string, trees int, auc double")


def forward_selection(
    tr: DataFrame,
    val: DataFrame,
    base: Sequence[str],
    candidates: Sequence[str],
    params: BoostParams = BoostParams(),
    on_gain: Callable[[list[str]], None] | None = None,
    at_once: int = 4,
) -> DataFrame:
    """Keep a candidate only if the validation AUC rises; one row per step.

    The next `at_once` candidates are fitted side by side on the features kept so far; after a gain those
    behind it are fitted again, so that rows are the ones of a loop over single fits. `on_gain` is called with
    the feature list after each kept candidate (refit, submission).
    """
    tr, val = binned([tr, val], [*base, *candidates], params.bins)
    kept: list[str] = []
    best = fit_score(tr, val, base, params).auc
    rows = [(0, "", best, True)]
    while len(rows) <= len(candidates):
        ahead = candidates[len(rows) - 1 : len(rows) - 1 + at_once]
        fits = side_by_side(tr.sparkSession, [lambda c=c: fit_score(tr, val, [*base, *kept, c], params) for c in ahead], at_once)
        for c, fitted in zip(ahead, fits):
            gain = fitted.auc > best
            rows.append((len(rows), c, fitted.auc, gain))
            if gain:
                best = fitted.auc
                kept.append(c)
                if on_gain:
                    on_gain([*base, *kept])
                break
    return tr.sparkSession.createDataFrame(rows, "step int, candidate string, auc double, kept boolean")


def refit_full(train: DataFrame, test: DataFrame, developed: Fitted, tr_rows: int, train_rows: int) -> Fitted:
    """Refit on all training rows, with the best number of trees raised by the ratio of rows, and score the test rows."""
    trees = max(1, int(developed.best_trees * train_rows / tr_rows))
    return fit_score(train, test, developed.feats, replace(developed.params, trees=trees), is_develop=False)


def param_sweep(tr: DataFrame, val: DataFrame, feats: Sequence[str], sets: dict[str, BoostParams], at_once: int = 4) -> DataFrame:
    """Validation AUC and number of trees per parameter set, `at_once` fits side by side; columns are binned once per `bins`."""
    tables = {b: binned([tr, val], feats, b) for b in sorted({p.bins for p in sets.values()})}
    fits = side_by_side(tr.sparkSession, [lambda p=p: fit_score(*tables[p.bins], feats, p) for p in sets.values()], at_once)
    rows = [(name, f.best_trees, f.auc) for name, f in zip(sets, fits)]
    return tr.sparkSession.createDataFrame(rows, "params string, trees int, auc double")
