"""Staged feature tables: base columns, then counts, then time features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from clickloom.operators.counts import count_maps
from clickloom.operators.timefeat import time_tables
from clickloom.plans.joins import attach_all
from clickloom.schema import COUNT_KEYS, TIME, TIME_KEYS, feature_name

BASE_FEATURES = [
    "ip", "app", "device", "os", "channel", "hourofday", "ip_device_os", "ip_device_os_app", "ip_device_os_app_channel",
]
COUNT_FEATURES = [feature_name(cols, "cnt") for cols in COUNT_KEYS]
TIME_FEATURES = [feature_name(k, kind) for k in TIME_KEYS for kind in ("timecount", "timediff")]


def staged_features(
    df: DataFrame,
    fit_on: Sequence[DataFrame],
    counts: bool = True,
    times: bool = True,
    time: str = TIME,
    wrap: bool = False,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Base table (with codes) plus 12 count and 8 time features, fitted over `fit_on`."""
    tables = []
    if counts:
        tables += count_maps(fit_on, COUNT_KEYS)
    if times:
        tables += time_tables(fit_on, TIME_KEYS, time, wrap=wrap, chunk_rows=chunk_rows)
    return attach_all(df, tables, chunk_rows)
