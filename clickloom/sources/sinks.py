"""CSV exports."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.plans.joins import attach
from clickloom.schema import LABEL


def append_csv(parts: Iterable[DataFrame], path: str) -> None:
    """Append each part to the same CSV table; every file carries the header."""
    for part in parts:
        part.write.mode("append").option("header", True).csv(path)


def export_features(df: DataFrame, feats: Sequence[str], path: str) -> None:
    df.select(*feats).write.mode("overwrite").option("header", True).csv(path)


def submission(template: DataFrame, scores: DataFrame, id_col: str = "click_id", score: str = "score") -> DataFrame:
    """Scores put on the template by id. An id without a score stays, with a null score."""
    scored = attach(template.select(id_col), scores.select(id_col, F.col(score).alias(LABEL)), [id_col])
    return scored.select(id_col, LABEL)


def write_submission(template: DataFrame, scores: DataFrame, path: str, id_col: str = "click_id") -> None:
    submission(template, scores, id_col).write.mode("overwrite").option("header", True).csv(path)
