"""Ranking and loss metrics as table aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.numeric import clip_probability
from clickloom.plans.ordered import Running, ordered_features
from clickloom.schema import LABEL
from clickloom.sources.store import roundtrip


def roc_auc(
    df: DataFrame, label: str = LABEL, score: str = "score", by: Sequence[str] = (), chunk_rows: int | None = None
) -> DataFrame:
    """Area under the ROC curve, ties counted half; null when a class is missing.

    Rows are first counted per distinct score and that small table is written; running counts over its sorted
    scores then give the negatives ranked below each positive.
    """
    by = list(by)
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(*by, label, score)
    per_score = roundtrip(known.groupBy(*by, score).agg(
        F.sum(F.col(label).cast("bigint")).alias("_pos"), F.sum(1 - F.col(label).cast("bigint")).alias("_neg")
    ), "per-score")
    ranked = ordered_features(per_score, by, [score], [Running("_below", F.col("_neg"), "sum")], chunk_rows)
    below = F.coalesce("_below", F.lit(0)) + F.col("_neg") / 2
    pos, neg = F.sum("_pos").cast("double"), F.sum("_neg").cast("double")
    return ranked.groupBy(*by).agg(F.try_divide(F.sum(F.col("_pos") * below), pos * neg).alias("auc"))


def auc_by_epoch(
    df: DataFrame, epoch: str = "epoch", interval: int = 1, label: str = LABEL, score: str = "score", chunk_rows: int | None = None
) -> DataFrame:
    """AUC of every `interval`-th epoch, counted from 0."""
    return roc_auc(df.where(F.col(epoch) % interval == 0), label, score, [epoch], chunk_rows)


def _point_loss(y: Column, p: Column, eps: float) -> Column:
    p = clip_probability(p, eps)
    return y * F.log(p) + (1 - y) * F.log(1 - p)


def log_loss(df: DataFrame, label: str = LABEL, score: str = "score", eps: float = 1e-15) -> DataFrame:
    y = F.col(label).cast("double")
    return df.agg((-F.avg(_point_loss(y, F.col(score), eps))).alias("log_loss"))


def _valid_sum(y: str, p: str, length: str, loss) -> Column:
    """Loss summed over the valid steps of one padded sequence."""
    steps = F.greatest(F.col(length), F.lit(0))
    terms = F.zip_with(F.slice(F.col(y), F.lit(1), steps), F.slice(F.col(p), F.lit(1), steps), loss)
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def sequence_log_loss(df: DataFrame, y: str, p: str, length: str, eps: float = 1e-15) -> DataFrame:
    """Log loss over the valid steps of padded sequences, averaged over all steps."""
    total = _valid_sum(y, p, length, lambda a, b: _point_loss(a.cast("double"), b.cast("double"), eps))
    return df.agg((-F.try_divide(F.sum(total), F.sum(length))).alias("log_loss"))


def sequence_rmse(df: DataFrame, y: str, p: str, length: str) -> DataFrame:
    """Root mean squared error over the valid steps of padded sequences."""
    total = _valid_sum(y, p, length, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    return df.agg(F.sqrt(F.try_divide(F.sum(total), F.sum(length))).alias("rmse"))
