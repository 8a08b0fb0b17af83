"""Whole-column scaling: L2 norm, and rank maps to uniform or normal."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.functions.numeric import normal_quantile
from clickloom.plans.quantiles import grouped_quantiles, melt, sketch_quantiles

# Fixed value: distance within which a value counts as the lowest or highest seen.
EDGE = 1e-7
P_MIN = EDGE - float(np.spacing(1))


def scale_l2(df: DataFrame, cols: Sequence[str], suffix: str = "_normalized") -> DataFrame:
    """Divide each column by its L2 norm over the table; an all-zero column stays zero."""
    squares = [F.sqrt(F.sum(F.col(c).cast("double") * F.col(c).cast("double"))).alias(c) for c in cols]
    names = df.columns
    normed = df.withColumn("_norms", df.agg(F.struct(*squares)).scalar())
    out = []
    for c in cols:
        norm = F.col("_norms")[c]
        out.append((F.col(c).cast("double") / F.when(norm == 0, 1.0).otherwise(norm)).alias(f"{c}{suffix}"))
    return normed.select(*names, *out)


@dataclass(frozen=True)
class QuantileMap:
    """Monotone map of each column through its own quantiles.

    Fitting gathers only the landmarks: `n_quantiles` numbers per column. It is exact (values are counted and
    ranked) or, with a `rank_error`, reads all columns in one scan into sketches that merge.
    """

    landmarks: dict[str, list[float]]

    @classmethod
    def fit(
        cls, df: DataFrame, cols: Sequence[str], n_quantiles: int = 1000, chunk_rows: int | None = None,
        rank_error: float | None = None,
    ) -> QuantileMap:
        n = max(1, min(n_quantiles, df.count()))
        if rank_error is not None:
            found = sketch_quantiles(df, cols, n, rank_error).collect()
            return cls({r["name"]: r["quantiles"] for r in found if r["quantiles"]})
        found = grouped_quantiles(melt(df, cols), ["name"], "value", n, chunk_rows).collect()
        return cls({r["name"]: r["quantiles"] for r in found})

    def transform(self, df: DataFrame, output: str = "normal", suffix: str = "") -> DataFrame:
        """Replace the fitted columns (or add suffixed ones). Values outside the fitted range go to its ends."""
        if output not in ("uniform", "normal"):
            raise ValueError(f"unknown output {output!r}")
        cols = [c for c in df.columns if c in self.landmarks]
        quantiles = {c: np.asarray(self.landmarks[c]) for c in cols}
        place = _normal_rank if output == "normal" else _rank
        schema = T.StructType([T.StructField(c, T.DoubleType()) for c in cols])

        @F.pandas_udf(schema)
        def ranks(values: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({c: place(values[c].to_numpy(dtype=float), q) for c, q in quantiles.items()})

        names = df.columns
        out = df.withColumn("_ranks", ranks(F.struct(*[F.col(c).cast("double").alias(c) for c in cols])))
        made = {f"{c}{suffix}": F.nanvl(F.col("_ranks")[c], F.lit(None).cast("double")) for c in cols}
        return out.withColumns(made).select(*dict.fromkeys([*names, *made]))


def _rank(x: np.ndarray, q: np.ndarray, edge: float = 0.0) -> np.ndarray:
    """Share of the fitted values below x; a run of equal landmarks maps to the middle of its share."""
    at = np.linspace(0, 1, len(q))
    p = (np.interp(x, q, at) - np.interp(-x, -q[::-1], -at[::-1])) / 2
    p[x + edge >= q[-1]] = 1.0
    p[x - edge <= q[0]] = 0.0
    return p


def _normal_rank(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return normal_quantile(np.clip(_rank(x, q, EDGE), P_MIN, 1 - P_MIN))


def normalize_splits(
    tr: DataFrame, val: DataFrame, train: DataFrame, test: DataFrame, cols: Sequence[str], n_quantiles: int = 1000,
    rank_error: float | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Map to normal: fitted on `tr` for tr/val, and again on `train` for train/test."""
    develop, final = (QuantileMap.fit(df, cols, n_quantiles, rank_error=rank_error) for df in (tr, train))
    return develop.transform(tr), develop.transform(val), final.transform(train), final.transform(test)
