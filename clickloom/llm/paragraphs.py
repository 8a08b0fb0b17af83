"""Substring dedup: paragraphs and passages that repeat, nearly or exactly, are kept once.

Units of a text are its lines of at least `LEAST` words, and passages of `PASSAGE` words that begin at anchors. An
anchor is a word whose hash (with the word after it) is least in some window of `WINDOW` words, so that it depends on
the words around it alone: every stretch of `WINDOW + PASSAGE - 1` words or more that repeats, wherever its lines
break, holds a whole passage that is cut alike in all its copies. Equal units (after lowering A-Z and joining words by
single spaces) are one class. Classes of lines get MinHash signatures of their 5-word shingles; bands are tuned so that a
pair at the threshold collides with the wanted recall. Colliding lines are checked by the exact Jaccard similarity of
their whole shingle sets (first against one candidate each, then all pairs that are not connected yet),
links make components, and of each component the first unit by (doc_id, place in the text) stays. Passages go only where
they are equal: of 20 words, any two that reach the threshold differ in one word at an end, and passages next to
them are equal then. Words around a unit that goes stay, unless they go with a unit of their own.

Classes are told apart by a 64-bit hash of their text.

Defined cases: null text has no units; shorter lines go only with a passage that covers them; rows that repeat an id are units
of one document, and units at the same byte of such rows stay together; a unit that overlaps the one that stays for it
(passages a word apart are near copies) stays as well; rows with a null id lose nothing; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickloom.llm.common import LOWER, by_bytes, mix, partitions, read, scratch_path, small_batches, span_hashes, utf8, words, written
from clickloom.llm.jaccard import link_classes, repeated_signatures, shingles

N, PERCENT, LEAST, RECALL, HASHES = 5, 80, 10, 0.995, 96
#: Words of a passage, and of the windows that choose where passages begin.
PASSAGE, WINDOW = 20, 31
TASK_SIGNATURES = 2_000_000


def tune(percent: int = PERCENT, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows per band): the most selective banding with the wanted recall at the threshold."""
    t = percent / 100
    fits = [(r, hashes // r) for r in range(1, hashes + 1) if 1 - (1 - t**r) ** (hashes // r) >= recall]
    r, b = max(fits)
    while 1 - (1 - t**r) ** (b - 1) >= recall:
        b -= 1
    return b, r


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number in its text, start and end of every paragraph."""
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([breaks + 1, offsets[:-1]]))
    begin = begin[begin < len(data)]
    row = np.searchsorted(offsets, begin, "right") - 1
    stop = np.append(breaks, len(data))
    end = np.minimum(stop[np.searchsorted(stop, begin)], offsets[row + 1])
    first = np.searchsorted(row, row)
    starts, _, _ = words(data, offsets)
    long = np.searchsorted(starts, end) - np.searchsorted(starts, begin) >= LEAST
    return row[long], (np.arange(len(row)) - first)[long], begin[long], end[long]


def sliding(x: np.ndarray, width: int, pick: np.ufunc, blank: np.uint64) -> np.ndarray:
    """`pick` over x[i : i + width] for every i; beyond the end, x is `blank`."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out, np.concatenate([out[step:], np.full(min(step, len(out)), blank, x.dtype)]))
        have += step
    return out


def passages(data: np.ndarray, offsets: np.ndarray, passage: int = PASSAGE, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of every passage."""
    low = LOWER[data]
    starts, ends, rows = words(low, offsets)
    none = np.zeros(0, np.int64)
    if len(starts) <= window:
        return none, none, none
    h = span_hashes(low, starts, ends)
    two = mix(h[:-1] * np.uint64(31) + h[1:])
    least = np.uint64(np.iinfo(np.uint64).max)
    word_row = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
    left = rows[1:][word_row] - np.arange(len(starts))  # words of the row from here on
    lowest = np.where(left[:-1] > window, sliding(two, window, np.minimum, least), np.uint64(0))
    # A word is an anchor if it is the least of any whole window that it lies in.
    before = np.concatenate([np.zeros(window - 1, np.uint64), lowest])
    anchor = sliding(before, window, np.maximum, np.uint64(0))[: len(two)] == two
    at = np.flatnonzero(anchor & (left[:-1] >= passage))
    return word_row[at], starts[at], ends[at + passage - 1]


def keys(data: np.ndarray, offsets: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the lower-case words of each span, in order."""
    low = LOWER[data]
    out = np.zeros(len(begin), np.uint64)
    starts, ends, _ = words(low, offsets)
    h = span_hashes(low, starts, ends)
    a, z = np.searchsorted(starts, begin), np.searchsorted(starts, end)
    size = z - a
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    at = np.repeat(a, size) + place
    np.add.at(out, np.repeat(np.arange(len(a)), size), mix(h[at] + mix(place.astype(np.uint64))))
    return mix(out + size.astype(np.uint64))


def units(docs: DataFrame) -> DataFrame:
    """(id, text, doc_id, copy, place, start, end) of all lines and passages; id stands for the class, copy for the row's text.

    place is the number of a line; a passage has none, and no text.
    """
    schema = "id long, text string, doc_id long, copy long, place int, start int, end int"

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(frames, 1):
            data, offsets = utf8(b.column(1))
            raw = data.tobytes()
            row, place, begin, end = split(data, offsets)
            more, first, last = passages(data, offsets)
            text = [raw[x:y] for x, y in zip(begin.tolist(), end.tolist())] + [None] * len(more)
            row, begin, end = np.concatenate([row, more]), np.concatenate([begin, first]), np.concatenate([end, last])
            place = pa.array(np.concatenate([place, np.zeros(len(more), np.int64)]), pa.int32(), mask=np.arange(len(row)) >= len(place))
            of, at = pa.array(row), offsets[row]
            yield pa.RecordBatch.from_arrays([
                pa.array(keys(data, offsets, begin, end).view(np.int64)),
                pa.array(text, pa.binary()).cast(pa.string()),
                b.column(0).take(of), b.column(2).take(of), place, pa.array((begin - at).astype(np.int32)), pa.array((end - at).astype(np.int32)),
            ], [x.split()[0] for x in schema.split(", ")])

    return docs.withColumn("copy", F.xxhash64("text")).mapInArrow(run, schema)


def band_signatures(sets: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each band of each set, and the set."""
    size = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(size > 0)
    if not len(full):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    every = np.concatenate([sets[i] for i in full])
    first = np.cumsum(size[full]) - size[full]
    made = []
    for band in range(bands):
        sig = np.full(len(full), band + 1, np.uint64)
        for r in range(rows):
            salt = mix(np.array([band * rows + r + 1], np.uint64))[0]
            # A product with an odd salt orders the (already well mixed) hashes anew; the high bits decide.
            sig = mix(sig * np.uint64(31) + np.minimum.reduceat((every ^ salt) * (salt | np.uint64(1)), first))
        made.append(sig)
    return np.concatenate(made), np.tile(full, bands)


def repeats(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """Every unit that goes, with the one that stays for it.

    doc_id, copy (the row's text as a hash), place (number of a line; null for a passage), start and end (bytes), kept_doc, kept_place,
    kept_start.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    path = scratch_path(spark, "llm-paragraphs")
    units(docs).write.option("compression", "zstd").parquet(path)
    made = spark.read.parquet(path)
    rows, known = made.drop("text"), made.where("text IS NOT NULL").select(F.col("id").alias("doc_id"), "text")
    bands, height = tune(percent)
    sign = lambda data, offsets: band_signatures(shingles(data, offsets, n), bands, height)
    tasks = max(partitions(spark), -(-known.count() * bands // TASK_SIGNATURES))
    entries = written(repeated_signatures(known, sign, tasks).select("signature", F.col("doc_id").alias("class")).distinct(), "paragraph-entries")
    spare = entries.select("class").distinct().select("class", F.lit(0).alias("spare0"), F.lit(0).alias("spare1"), F.lit(0).alias("parity"))
    parts = link_classes(known, entries, spare, n, percent)
    first = rows.groupBy("id").agg(F.min(F.struct("doc_id", "start", "end", "place")).alias("first"), F.count("*").alias("n"))
    first = first.join(parts.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("part"), "first", "n")
    first = written(first, "paragraph-classes")
    kept = first.groupBy("part").agg(F.min("first").alias("kept"), F.sum("n").alias("n")).where("n > 1").drop("n")
    of = written(first.select("id", "part").join(written(kept, "paragraph-kept"), "part").select("id", "kept"), "paragraph-repeats")
    gone = rows.join(of, "id")
    overlaps = (F.col("doc_id") == F.col("kept.doc_id")) & (F.col("start") < F.col("kept.end")) & (F.col("end") > F.col("kept.start"))
    return gone.where(~overlaps).select("doc_id", "copy", "place", "start", "end", F.col("kept.doc_id").alias("kept_doc"), F.col("kept.place").alias("kept_place"),
                                        F.col("kept.start").alias("kept_start"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines and passages removed, bytes they cover, the lines' places, and the documents that keep them."""
    small_batches(spark)
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    # A byte that several units cover counts once: a unit adds what lies beyond all units that begin before it.
    before = F.max("end").over(Window.partitionBy("doc_id", "copy").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    gone = repeats(docs).withColumn("n_bytes", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0)))))
    gone = gone.groupBy("doc_id").agg(F.count("*").alias("n_removed"), F.sum("n_bytes").cast("long").alias("bytes_removed"),
                                      F.sort_array(F.collect_set("place")).alias("places"), F.sort_array(F.collect_set("kept_doc")).alias("kept_docs"))
    out = docs.select("doc_id").join(written(gone, "paragraph-docs"), "doc_id", "left")
    none = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    return out.select("doc_id", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("bytes_removed", F.lit(0)).alias("bytes_removed"),
                      none("places", "array<int>"), none("kept_docs", "array<bigint>"))
