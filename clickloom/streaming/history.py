"""Prior-rows features on a stream: count, mean and gaps per entity, as the batch windows give them.

A row's features need all earlier rows of its entity, so rows wait in keyed state until the watermark has passed
them: `delay` is the stated bound on disorder. A timer per entity then works them off in `(time, row id)` order and
keeps a running count, a running sum and the last few times. A row older than the watermark is late: its successors
may be out already, so it goes to the side output without features and changes nothing.

State lives in RocksDB under the checkpoint, results in one folder per batch that a repeated batch replaces, so
that a restart gives the same rows. Rows still waiting when a stream stops stay in state for its next start;
`History.waiting` computes their features from the state as a batch, without touching it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from clickloom.plans.ordered import LastN, Position, Running, ordered_features
from clickloom.plans.splits import is_null_key
from clickloom.schema import LABEL, ROW_ID, TIME, feature_name
from clickloom.sources.store import load_table, save_table

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows that are handed over at once when an entity's waiting rows are worked off.
ROWS = 10_000
#: Seconds added to times in the stream: a watermark begins at 0, and no row may be late for that.
SHIFT = 1 << 33
# Names without a leading underscore: Spark hands rows over as named tuples.
_AT, _Y, _LATE = "event_ms", "event_y", "late"


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A session setting for the time of a block; a stream keeps what was set when it started."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class _Worker(StatefulProcessor):
    """Rows of one entity: held until the watermark is past them, then given their features in order."""

    def __init__(self, keys: list[str], kept: int):
        self.keys, self.kept = keys, kept

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, row long, y double")
        self.done = handle.getValueState("done", "n long, s double, rows long, last array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        first = None
        for df in rows:
            late = df[_AT] < mark
            if late.any():
                yield self._out(key, df.loc[late, [ROW_ID, _AT]].itertuples(index=False), True)
            df = df[~late]
            if len(df):
                self.held.appendList([(int(a), int(r), None if pd.isna(y) else float(y)) for a, r, y in zip(df[_AT], df[ROW_ID], df[_Y])])
                first = int(df[_AT].min()) if first is None else min(first, int(df[_AT].min()))
        if first is not None:
            self.handle.registerTimer(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = sorted(self.held.get(), key=lambda r: (r[0], r[1]))
        ready = [r for r in held if r[0] < mark]
        if not ready:
            return
        stay = held[len(ready):]
        if stay:
            self.held.put(stay)
            self.handle.registerTimer(stay[0][0])
        else:
            self.held.clear()
        n, s, rows, last = self.done.get() if self.done.exists() else (0, 0.0, 0, [])
        last, made = list(last), []
        for at, row, y in ready:
            made.append((row, at, n, s if n else None, list(last)))
            if y is not None:
                n, s = n + 1, s + y
            last = (last + [at])[-self.kept:]
        self.done.update((n, s, rows + len(ready), last))
        for i in range(0, len(made), ROWS):
            yield self._out(key, made[i : i + ROWS], False)

    def _out(self, key, rows, late: bool) -> pd.DataFrame:
        rows = [r if len(r) > 2 else (*r, None, None, None) for r in rows]
        out = pd.DataFrame({k: pd.Series([v] * len(rows), dtype="object") for k, v in zip(self.keys, key)})
        out[ROW_ID], out[_AT] = [r[0] for r in rows], [r[1] for r in rows]
        out["n"] = pd.array([r[2] for r in rows], dtype="Int64")
        out["s"], out["last"] = [r[3] for r in rows], [r[4] for r in rows]
        out[_LATE] = late
        return out

    def close(self) -> None:
        pass


@dataclass(frozen=True)
class History:
    """Running features of `keys` over a stream of rows with `time` (whole seconds), `target` and a unique row id.

    `prev` are the gaps wanted, in rows back; `delay` bounds how far rows may be out of order. Rows with a null key
    or a null time have no place in an order and are left out. What one entity may hold in a task is bounded by
    its rows of one batch and of one `delay`; `read_arriving` bounds a batch by its files.
    """

    keys: tuple[str, ...]
    time: str = TIME
    target: str = LABEL
    prev: tuple[int, ...] = (1, 2)
    delay: str = "0 seconds"

    def _schema(self, source: DataFrame) -> str:
        keys = "".join(f"{k} {source.schema[k].dataType.simpleString()}, " for k in self.keys)
        return f"{keys}{ROW_ID} long, {_AT} long, n long, s double, last array<long>, {_LATE} boolean"

    def start(self, rows: DataFrame, out: str, checkpoint: str):
        """Start (or go on with) the stream over what is there now; results go below `out`, state to `checkpoint`."""
        spark, keys = rows.sparkSession, list(self.keys)
        usable = rows.where(~is_null_key([*keys, self.time])).withColumn("__event_time", F.timestamp_seconds(F.col(self.time) + SHIFT))
        # Only a copy of the time goes on: Spark would drop late rows by the column that carries the watermark.
        marked = usable.withWatermark("__event_time", self.delay).select(*keys, ROW_ID, F.unix_millis("__event_time").alias(_AT), F.col(self.target).cast("double").alias(_Y))
        schema = self._schema(rows)
        if not _exists(spark, out):
            save_table(spark.createDataFrame([], schema).drop(_LATE), f"{out}/batch=-1/{_LATE}=false")

        def keep(batch: DataFrame, batch_id: int) -> None:
            save_table(batch, f"{out}/batch={batch_id}", partition_by=_LATE)

        with setting(spark, "spark.sql.streaming.stateStore.providerClass", ROCKSDB):
            worker = _Worker(keys, max(self.prev, default=1))
            made = marked.groupBy(*keys).transformWithStateInPandas(worker, outputStructType=schema, outputMode="Append", timeMode="EventTime")
            return made.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def run(self, rows: DataFrame, out: str, checkpoint: str) -> None:
        """Work off all files that are there now."""
        self.start(rows, out, checkpoint).awaitTermination()

    def _features(self) -> list[Column]:
        at, n, s, last = (F.col(c) for c in (_AT, "n", "s", "last"))
        gap = lambda p: ((at - F.get(last, F.size(last) - p)) / 1000).cast("bigint")
        gaps = [F.coalesce(gap(p), F.lit(-1)).alias(feature_name(self.keys, f"prev_click_{p}")) for p in self.prev]
        mean = F.coalesce(F.try_divide(s, n), F.lit(-1.0))
        return [mean.alias(feature_name(self.keys, "expmean")), n.alias(feature_name(self.keys, "expcount")), *gaps]

    def final(self, spark: SparkSession, out: str) -> DataFrame:
        """Row id, keys and features of all rows that the watermark has passed."""
        return load_table(spark, out).where(F.col(_LATE) == "false").select(ROW_ID, *self.keys, *self._features())

    def late(self, spark: SparkSession, out: str) -> DataFrame:
        """The side output: row id, keys and time of rows that came after the watermark."""
        rows = load_table(spark, out).where(F.col(_LATE) == "true")
        return rows.select(ROW_ID, *self.keys, ((F.col(_AT) / 1000).cast("bigint") - SHIFT).alias(self.time))

    def waiting(self, spark: SparkSession, checkpoint: str) -> DataFrame:
        """Row id, keys and features of the rows in state, as they would be if nothing came before them any more."""
        def state(name: str) -> DataFrame:
            return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()

        keys = [F.col("key")[k].alias(k) for k in self.keys]
        held = state("held").select(*keys, "list_element.*")
        done = state("done").select(*keys, F.col("value.n").alias("n0"), F.col("value.s").alias("s0"), F.col("value.last").alias("last0"))
        kept = max(self.prev, default=1)
        parts = [Running("n1", F.col("y"), "count"), Running("s1", F.col("y"), "sum"), LastN("last1", F.col("at"), kept)]
        own = ordered_features(held, list(self.keys), ["at", "row"], parts)
        both = own.join(done, list(self.keys), "left")
        n = F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))
        s = F.coalesce("s0", F.lit(0.0)) + F.coalesce("s1", F.lit(0.0))
        last = F.concat(F.coalesce("last0", F.array().cast("array<bigint>")), F.coalesce("last1", F.array().cast("array<bigint>")))
        made = both.select(F.col("row").alias(ROW_ID), *self.keys, F.col("at").alias(_AT), n.alias("n"), F.when(n > 0, s).alias("s"), last.alias("last"))
        return made.select(ROW_ID, *self.keys, *self._features())


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_arriving(spark: SparkSession, folder: str, schema: T.StructType, files: int | None = None) -> DataFrame:
    """The Parquet files of a folder as a stream, in order of arrival, at most `files` a batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)
