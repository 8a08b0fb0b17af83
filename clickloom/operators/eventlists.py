"""Wide histories read from event lists: each event is stored once, however wide the histories are.

A key's events are stored in order, in lists of at most `list_events`. Every row of the log keeps only its
list and its position there. A history is sliced out of the row's own list and the end of the one before it
when it is read, so what is written grows with the events and not with events times width.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.arrays import left_pad
from clickloom.plans.ordered import Position, ordered_features
from clickloom.schema import LABEL, TIME, TIME_ORDER
from clickloom.sources.store import load_table, save_table

LIST_EVENTS = 2048
_LIST, _AT = "__list", "__at"


@dataclass(frozen=True)
class EventLists:
    """Written event lists of one key: `rows` (kept columns, key, list, position) and `lists` (key, list, one array per value)."""

    rows: DataFrame
    lists: DataFrame
    key: str
    values: tuple[str, ...]
    list_events: int

    def histories(self, width: int, values: Sequence[str] | None = None) -> DataFrame:
        """The kept columns and key of every row, with the last `width` earlier values of each value column as `<value>_earlier`, oldest first.

        Rows with a null key have empty histories. A list and the end of its neighbour meet once, before the
        rows are joined to them; at most `list_events` rows meet one list.
        """
        values = list(self.values if values is None else values)
        if width > self.list_events:
            raise ValueError(f"histories of {width} need lists of as many events, these hold {self.list_events}")
        # Only a full list has one after it, so the end of a full list is all that is passed on.
        end = lambda v: F.slice(v, self.list_events - width + 1, width).alias(f"__b_{v}")
        ends = self.lists.where(F.size(values[0]) == self.list_events)
        ends = ends.select(self.key, (F.col(_LIST) + 1).alias(_LIST), *[end(v) for v in values])
        both = self.lists.select(self.key, _LIST, *values).join(ends, [self.key, _LIST], "left")
        joined = [F.when(F.col(f"__b_{v}").isNull(), F.col(v)).otherwise(F.concat(f"__b_{v}", v)).alias(f"__a_{v}") for v in values]
        head = F.when(F.col(f"__b_{values[0]}").isNull(), 0).otherwise(F.size(f"__b_{values[0]}"))
        both = both.select(self.key, _LIST, head.alias("__head"), *joined)
        keep = [c for c in self.rows.columns if c not in (_LIST, _AT)]
        found = self.rows.join(both, [self.key, _LIST], "left")
        stop = F.col("__head") + F.col(_AT)
        n = F.least(stop, F.lit(width))
        cut = lambda v: F.when(n > 0, F.slice(f"__a_{v}", stop - n + 1, n))
        types = {f.name: f.dataType for f in self.lists.schema}
        made = [F.coalesce(cut(v), F.array().cast(types[v])).alias(f"{v}_earlier") for v in values]
        return found.select(*keep, *made)


def store_lists(
    df: DataFrame,
    path: str,
    key: str = "ip",
    values: Sequence[str] = (LABEL, TIME),
    keep: Sequence[str] = ("row_id", LABEL),
    list_events: int = LIST_EVENTS,
    order: Sequence[str] = TIME_ORDER,
    chunk_rows: int | None = None,
) -> EventLists:
    """Write the lists of `values` per key below `path`, and the place of every row with the columns of `keep`.

    Rows are numbered once (hot keys in pieces) and written; a hot key has many lists, none longer than `list_events`.
    """
    columns = list(dict.fromkeys([*keep, key, *values]))
    numbered = ordered_features(df.select(*dict.fromkeys([*columns, *order])), [key], order, [Position("__n")], chunk_rows)
    place = [F.floor(F.col("__n") / list_events).alias(_LIST), F.pmod("__n", F.lit(list_events)).cast("int").alias(_AT)]
    save_table(numbered.select(*columns, *place), f"{path}/rows")
    placed = load_table(df.sparkSession, f"{path}/rows")
    event = F.struct(_AT, *[F.col(v).alias(f"__v{i}") for i, v in enumerate(values)])
    lists = placed.where(F.col(key).isNotNull()).groupBy(key, _LIST).agg(F.sort_array(F.collect_list(event)).alias("__e"))
    save_table(lists.select(key, _LIST, *[F.col("__e")[f"__v{i}"].alias(v) for i, v in enumerate(values)]), f"{path}/lists")
    return load_lists(df.sparkSession, path, key, values, list_events, keep)


def load_lists(
    spark: SparkSession, path: str, key: str = "ip", values: Sequence[str] = (LABEL, TIME), list_events: int = LIST_EVENTS,
    keep: Sequence[str] = ("row_id", LABEL),
) -> EventLists:
    rows = load_table(spark, f"{path}/rows").select(*dict.fromkeys([*keep, key]), _LIST, _AT)
    return EventLists(rows, load_table(spark, f"{path}/lists"), key, tuple(values), list_events)


def gaps_of(times: Column) -> Column:
    """Differences of neighbours; empty for fewer than two times."""
    n = F.size(times)
    later, earlier = F.slice(times, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(times, F.lit(1), F.greatest(n - 1, F.lit(0)))
    return F.when(n > 1, F.zip_with(later, earlier, lambda s, t: (s - t).cast("int"))).otherwise(F.array().cast("array<int>"))


def sequence_input(lists: EventLists, width: int, label: str = LABEL, time: str = TIME) -> DataFrame:
    """The input table of a sequence model: row's kept columns and, under the key's name,
    `_id`, `_attributed_history`, `_time_delta_history`, `_history_length`, `_next_download`.

    Histories are of the earlier rows only, padded on the left with -1 to `width`; gaps lie between earlier rows. A row
    without earlier rows has one step of -1, so its length is 1.
    """
    key = lists.key
    # One time more than gaps.
    found = lists.histories(width + 1, [label, time])
    labels = left_pad(F.col(f"{label}_earlier").cast("array<int>"), width)
    gaps = left_pad(gaps_of(F.col(f"{time}_earlier")), width)
    made = {
        f"{key}_id": F.col(key),
        f"{key}_attributed_history": labels[0],
        f"{key}_time_delta_history": gaps[0],
        f"{key}_history_length": F.greatest(labels[1], F.lit(1)),
        f"{key}_next_download": F.col(label).cast("int"),
    }
    kept = [c for c in lists.rows.columns if c not in (_LIST, _AT, key, label)]
    return found.select(*kept, *[c.alias(name) for name, c in made.items()])
