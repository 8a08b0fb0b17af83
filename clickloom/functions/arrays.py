"""Array columns: padding, rotation, one-hot, splitting, dot products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.plans.ordered import last_of

PAD = -1
REPEAT_BLOCK = 10_000


def left_pad(array: Column, width: int, mode: str = "keep", pad: int = PAD) -> tuple[Column, Column]:
    """(padded array of `width`, number of items kept).

    `keep` keeps the last `width` items. `slice` repeats a historic indexing rule:
    an array longer than half of `width` but shorter than it keeps only its last
    `width - length` items.
    """
    size = F.size(array)
    keep = F.least(size, F.lit(width))
    if mode == "slice":
        keep = F.when((size * 2 > width) & (size < width), F.lit(width) - size).otherwise(keep)
    elif mode != "keep":
        raise ValueError(f"unknown pad mode {mode!r}")
    padded = F.concat(F.array_repeat(F.lit(pad).cast("int"), F.lit(width) - keep), last_of(array, keep))
    return padded, keep


def roll_left(array: Column) -> Column:
    """Rotate left by one; an empty array stays empty."""
    size = F.size(array)
    return F.when(size < 2, array).otherwise(F.concat(F.slice(array, F.lit(2), size - 1), F.slice(array, 1, 1)))


def one_hot(code: Column, depth: int) -> Column:
    """Zeros with a one at `code`; all zeros when the code is out of range or null."""
    hit = lambda i: F.coalesce((i == code).cast("int"), F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), hit)


def split_series(series: Column, sep: str = "_") -> tuple[Column, Column]:
    """A joined series -> (history, label): the last item is the label, the ones before it the history.

    A series of one item has history ``[-1]``. A null series gives nulls.
    """
    items = F.split(series, sep).cast("array<int>")
    size = F.size(items)
    history = F.when(size > 1, F.slice(items, F.lit(1), F.greatest(size - 1, F.lit(0)))).otherwise(
        F.array(F.lit(PAD).cast("int"))
    )
    known = series.isNotNull()
    return F.when(known, history), F.when(known, F.try_element_at(items, F.lit(-1)))


def drop_last(series: Column, sep: str = "_") -> Column:
    """A joined series without its last item; ``[-1]`` when the series is null."""
    items = F.split(series, sep).cast("array<int>")
    kept = F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0)))
    return F.when(series.isNotNull(), kept).otherwise(F.array(F.lit(PAD).cast("int")))


def last_valid(array: Column, length: Column) -> Column:
    """Item at the last valid step of a padded sequence; null when there is none."""
    return F.when(length > 0, F.try_element_at(array, length))


def repeat_rows(df: DataFrame, count: str, block: int = REPEAT_BLOCK) -> DataFrame:
    """Repeat each row `count` times.

    Rows are multiplied in two steps and redistributed in between, so no array grows
    with the count and a single huge count is not served by a single task.
    """
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(count) - 1) / block)))
    spread = df.where(F.col(count) > 0).select("*", blocks.alias("_block"))
    spread = spread.repartition(*df.columns, "_block")
    left = F.least(F.lit(block), F.col(count) - F.col("_block") * block).cast("int")
    return spread.select(*df.columns, F.explode(F.array_repeat(F.lit(1), left))).select(*df.columns)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
