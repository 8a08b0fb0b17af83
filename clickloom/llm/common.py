"""Helpers that several operators share: reading, Arrow text buffers, written tables, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from ctypes import CDLL

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.sources.store import release, roundtrip, scratch_path, shared_dir  # noqa: F401

# Rows per Arrow batch; texts are long, so that the default of 10,000 would make batches of hundreds of MB.
BATCH_ROWS = 512


def read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*cols) if cols else df


def small_batches(spark: SparkSession) -> SparkSession:
    """Bound the memory of Python workers and of scans by the rows of a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(BATCH_ROWS))
    return spark


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: cuts lineage, survives lost executors."""
    return roundtrip(df, f"llm-{name}")


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow that hands freed memory back to the system when a task ends: workers outlive their tasks, and an
    executor has more of them than cores where a stage has two such functions."""

    def each(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(frames)
        pa.default_memory_pool().release_unused()
        if trim := getattr(CDLL(None), "malloc_trim", None):  # glibc has it
            trim(0)

    return each


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in one array, and the n + 1 offsets of its rows. Null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start..start+length-1 of every row, one after the other."""
    total = int(lengths.sum())
    before = np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.repeat(starts, lengths) + (np.arange(total) - before)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# Text byte hash: a polynomial over the 2**64 ring with an odd base, on bytes spread by `mix`.
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


# Powers up to here are kept, by base; longer texts get theirs anew.
_KEPT, _kept = (1 << 16) + 1, {}


def _powers(base: int, n: int) -> np.ndarray:
    if n <= _KEPT and base in _kept:
        return _kept[base][:n]
    out = np.full(max(n, _KEPT), base, np.uint64)
    out[:1] = 1
    out = np.cumprod(out, dtype=np.uint64)
    if len(out) == _KEPT:
        _kept[base] = out
    return out[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes give equal hashes wherever they stand."""
    inverse = pow(_BASE, -1, 1 << 64)
    values = _BYTE[data] * _powers(_BASE, len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values, dtype=np.uint64, out=total[1:])
    back = _powers(inverse, len(data) + 1)
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def row_hashes(rows: np.ndarray) -> np.ndarray:
    """`span_hashes` of whole rows of a byte matrix."""
    width = rows.shape[1]
    total = np.full(len(rows), width, np.uint64)
    for k, power in enumerate(_powers(_BASE, width)):
        total += _BYTE[rows[:, k]] * power
    return mix(total)


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows (runs of non-space bytes), and the n + 1 offsets of rows into them."""
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    if len(data):
        edge[0], edge[-1] = inside[0], inside[-1]
        edge[1:-1] = inside[1:] != inside[:-1]
        # A row ends a word and the next row begins one where two words touch across rows.
        cut = offsets[1:-1]
        cut = np.unique(cut[(cut > 0) & (cut < len(data))])
        joint = cut[inside[cut] & inside[cut - 1]]
    else:
        joint = np.zeros(0, np.int64)
    at = np.flatnonzero(edge)
    if len(joint):
        at = np.sort(np.concatenate([at, joint, joint]))
    starts, ends = at[0::2], at[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


def batches(frames: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows."""
    for b in frames:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def by_bytes(frames: Iterator[pa.RecordBatch], column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices whose texts add up to about `most` bytes; a longer text is a slice of its own."""
    for b in frames:
        _, offsets = utf8(b.column(column))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield b.slice(at, end - at)
            at = end


def sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of `mask` in each row."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def bucket(column: str, n: int):
    """crc32 of an id's decimal text, modulo n. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def _settled(stars: DataFrame) -> bool:
    """True when every node points to one root and no root points on."""
    ends = stars.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.unionByName(stars.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR out > 0 AND into > 0").isEmpty()


def components(edges: DataFrame, name: str = "cc", most: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b): the least node it can reach.

    Alternates large-star and small-star steps until nothing changes. Each step joins edges with one least
    neighbour per node; both sides are plain written tables, so that adaptive execution can split the edges
    of a hub. Rows with a null end or a = b only name nodes. No edges: no rows.
    """
    stars = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    for _ in range(most):
        if _settled(stars):
            break
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        stars = written(small.select("e.*").where("u <> v").distinct(), name)
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    roots = stars.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
