"""Last-n event histories per entity, left-padded to a fixed width."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions.arrays import left_pad, roll_left
from clickloom.plans.ordered import LastN, ordered_features
from clickloom.schema import TIME, TIME_ORDER

WIDTH = 20
HISTORY_COLUMNS = ("app", "os", "device", "channel")


def histories(
    df: DataFrame,
    key: str = "ip",
    values: Sequence[str] = HISTORY_COLUMNS,
    width: int = WIDTH,
    mode: str = "keep",
    deltas: bool = True,
    order: Sequence[str] = TIME_ORDER,
    chunk_rows: int | None = None,
) -> DataFrame:
    """`<value>_history`, `time_history` (gaps between earlier clicks) and `history_length` (gaps kept).

    One window of bounded frames serves all of them: the last `width` earlier values and
    the last `width + 1` earlier times, which hold `width` gaps.
    """
    features = [LastN(f"_h_{v}", F.col(v).cast("int"), width) for v in values]
    if deltas:
        features.append(LastN("_times", F.col(TIME), width + 1))
    out = ordered_features(df, [key], order, features, chunk_rows)
    made = [left_pad(F.col(f"_h_{v}"), width, mode)[0].alias(f"{v}_history") for v in values]
    if deltas:
        times = F.col("_times")
        size = F.size(times)
        later = F.slice(times, F.lit(2), F.greatest(size - 1, F.lit(0)))
        earlier = F.slice(times, F.lit(1), F.greatest(size - 1, F.lit(0)))
        gaps = F.when(size > 1, F.zip_with(later, earlier, lambda s, t: (s - t).cast("int"))).otherwise(
            F.array().cast("array<int>")
        )
        padded, kept = left_pad(gaps, width, mode)
        made += [padded.alias("time_history"), kept.alias("history_length")]
    return out.select(*df.columns, *made)


def next_step_input(df: DataFrame, arrays: Sequence[str], label: str, length: str, is_test: bool = False) -> DataFrame:
    """Shift sequence inputs by one step: rotate the arrays, lower the label and (not on test) the length."""
    changed = {a: roll_left(F.col(a)) for a in arrays} | {label: F.col(label) - 1}
    if not is_test:
        changed[length] = F.col(length) - 1
    return df.withColumns(changed)
