"""Chunked scans as bounded streams: partial counts per chunk, merged into a running total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.plans.splits import is_null_key
from clickloom.schema import as_list, feature_name
from clickloom.sources.store import load_table, save_table, scratch_path


def read_chunks(spark: SparkSession, folder: str, schema: T.StructType, files_per_chunk: int = 1) -> DataFrame:
    """The Parquet files of a folder, a few per chunk, in order of arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_chunk).parquet(folder)


def chunked_count_map(chunks: DataFrame, cols: str | Sequence[str], name: str | None = None) -> DataFrame:
    """Rows per key tuple over all chunks that are there when the job starts.

    Spark keeps the merged counts as state, checkpointed in the shared folder, so a lost
    executor costs the current chunk only. The last update of each key is its total.
    """
    spark, cols = chunks.sparkSession, as_list(cols)
    name = name or feature_name(cols, "cnt")
    counted = chunks.where(~is_null_key(cols)).groupBy(*cols).agg(F.count(F.lit(1)).alias(name))
    out, checkpoint = scratch_path(spark, "chunk-counts"), scratch_path(spark, "chunk-state")

    # A folder without chunks gives no rows rather than no table.
    save_table(spark.createDataFrame([], counted.schema), f"{out}/chunk=-1")

    def keep(batch: DataFrame, batch_id: int) -> None:
        # One folder per chunk: a chunk that is run again replaces what it wrote.
        save_table(batch, f"{out}/chunk={batch_id}")

    query = (
        counted.writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return load_table(spark, out).groupBy(*cols).agg(F.max(name).alias(name))
