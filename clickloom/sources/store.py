"""Written tables: feature tables, dictionaries, and compute-once results in the shared folder."""

from __future__ import annotations

import gc
import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, from `spark.checkpoint.dir`.

    Only a local session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="clickloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/clickloom/{name}-{uuid.uuid4().hex}"


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, bytes, modification time) of all files below a path; none when it does not exist."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    if store.exists(place):
        files = store.listFiles(place, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


def cache_path(spark: SparkSession, operator: str, params: Mapping[str, object], inputs: list[str]) -> str:
    """A path that stands for an operator, all its parameters and its inputs as they are now: files, sizes and times."""
    key = json.dumps([operator, sorted(params.items()), sorted((i, files_of(spark, i)) for i in inputs)], default=str)
    return f"{shared_dir(spark)}/clickloom/{operator}-{hashlib.sha256(key.encode()).hexdigest()[:24]}"


def is_written(spark: SparkSession, path: str) -> bool:
    """True when `path` holds a completed table (its success marker is there)."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def save_table(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def roundtrip(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write to a fresh path in the shared folder and read back; also cuts the lineage."""
    path = scratch_path(df.sparkSession, name)
    save_table(df, path, partition_by)
    # The schema is known: an empty partitioned table has no file to read it from.
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files and plans that nothing refers to any more."""
    spark.sql("SELECT 1").collect()  # listeners keep the last query until they hear of another
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(
    spark: SparkSession,
    compute: Callable[[], Mapping[str, DataFrame]],
    paths: Mapping[str, str],
    rewrite: bool = False,
) -> dict[str, DataFrame]:
    """Load all outputs when all are written and `rewrite` is off; else compute, write and load them."""
    if rewrite or not all(is_written(spark, p) for p in paths.values()):
        for name, df in compute().items():
            save_table(df, paths[name])
    return {name: load_table(spark, path) for name, path in paths.items()}


def _bucket_table(path: str) -> str:
    return f"clickloom_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def save_bucketed(df: DataFrame, path: str, by: str, buckets: int, finish: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Write a table in buckets by a column, each sorted by it, one file per bucket.

    `finish` adds columns that follow from those of the row, once the rows are in their buckets.
    """
    spark, table = df.sparkSession, _bucket_table(path)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    dealt = df.repartition(buckets, by)
    (finish(dealt) if finish else dealt).write.mode("overwrite").bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(table)


def load_bucketed(spark: SparkSession, path: str, by: str, buckets: int) -> DataFrame:
    """A table of `save_bucketed`, also one of another session: joins and groupings by the column need no exchange."""
    table = _bucket_table(path)
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in load_table(spark, path).schema)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)
