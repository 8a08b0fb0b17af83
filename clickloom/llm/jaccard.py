"""Exact Jaccard join of word n-gram sets: partitions of the universe, pigeonhole signatures, exact checks.

1. A text becomes the set of 64-bit hashes of its distinct n-word shingles. Texts with equal sets are one
   class, named by its least id; copies are never paired.
2. Sizes fall into bands such that the partners of a set are in its own band or a neighbour. A set gets
   signatures for its band and the next one: there, hashing deals the universe into segments, and two sets
   that may link differ in at most H shingles. Long sets use H + 1 segments and a tenth more: sets that link
   agree in more than the spare ones. Short sets use half as many segments, and for some of them also the
   hashes of all subsets with one shingle less, which find segments that differ by one shingle.
3. Signatures are exchanged in packed runs. A run sends one entry per signature, so that a signature of very
   many sets costs as much as there are runs; only signatures that occur twice come back as rows.
4. Every class is checked against the class that most often is the least one of its signatures. The links
   found make components. What is left are pairs of different components that share a signature. A class may
   leave out as many signatures as it has spare ones, and leaves out those that meet the most components
   (cost-based allocation); all other such pairs are checked, so no link between components is lost.
   Of pairs that meet in few signatures only those are checked that share one more signature than can be missing.
5. Checks compare whole sets: pair by pair, or, for signatures that meet many components, group by group: classes of
   signatures with the same least class are one group. A group is cut into blocks of so many bytes, and every two blocks
   meet in a task.

Defined cases: null or empty texts and texts of spaces have an empty set and link with nothing; fewer words
than n: the whole sequence is one shingle; null ids link with nothing; repeated rows give repeated results, and rows that share an id
but not a text are linked each by its own text (one row each); an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickloom.llm.common import LOWER, by_bytes, components, mix, partitions, read, release, small_batches, span_hashes, tidy, utf8, words, written

N, PERCENT = 4, 85
#: Share of spare segments, and the greatest H for which one-deletion neighbourhoods are used.
SPARE, SHORT = 0.2, 3
#: Text bytes per run, and signatures per reading task aimed at.
RUN_BYTES, TASK_SIGNATURES = 1 << 23, 2_000_000
#: Signatures that meet this many components are compared group by group, others pair by pair; spare ones are left out from LEAVE on.
MANY, LEAVE = 16, 8
#: Bytes of sets in a block of a group, and sets of a block that are multiplied at once.
BLOCK_BYTES, TILE = 1 << 22, 256
#: Bits of the filter that thins texts before a join; its size is fixed, its answers are checked by the join.
FILTER_BITS = 1 << 23
#: Names a row by its id and its text.
ID_AND_TEXT = lambda: F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = N) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of every text."""
    low = LOWER[data]
    starts, ends, rows = words(low, offsets)
    h = span_hashes(low, starts, ends)
    whole = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for k in range(n):
        whole = mix(whole * np.uint64(31) + h[k : k + len(whole)])
    out = []
    for a, z in zip(rows[:-1], rows[1:]):
        if z - a >= n:
            out.append(np.unique(whole[a : z - n + 1]))
        else:
            one = np.zeros(1, np.uint64)
            for k in range(a, z):
                one = mix(one * np.uint64(31) + h[k] + np.uint64(1))
            out.append(one[: int(z > a)])
    return out


@lru_cache
def bands(percent: int = PERCENT, most: int = 1 << 40) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per band: greatest size, segments, segments with deletions, least number of signatures that settle it (H + 1)."""
    upper = [1]
    while upper[-1] < most:
        upper.append(max(100 * upper[-1] // percent, upper[-1] + 1))
    upper = np.array(upper, np.int64)
    need = 2 * upper * (100 - percent) // (100 + percent) + 1
    short = need <= SHORT + 1
    segments = np.where(short, -(-need // 2), need + np.maximum(1, np.ceil(need * SPARE).astype(np.int64)))
    return upper, segments, np.where(short, need - segments, 0), need


def signatures(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, the set each belongs to, and per set the spare signatures in its band and in the next one.

    The last bit of a signature is the parity of its band.
    """
    upper, segments, deletions, need = bands(percent)
    n = np.array([len(s) for s in sets], np.int64)
    own = np.searchsorted(upper, n)
    every = np.concatenate([*sets, np.zeros(0, np.uint64)])
    doc = np.repeat(np.arange(len(sets)), n)
    made, of, spare = [], [], np.zeros((2, len(sets)), np.int64)
    for t in (0, 1):
        band = own + t
        m = np.where(n > 0, segments[band], 0)
        first = np.cumsum(m) - m
        total = int(m.sum())
        at = first[doc] + (mix(every ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.maximum(m[doc], 1).astype(np.uint64)).astype(np.int64)
        spread = mix(every + np.uint64(0x632BE59BD9B4E019))
        sums = np.zeros(total, np.uint64)
        np.add.at(sums, at, spread)
        filled = np.bincount(at, minlength=total) > 0
        owner = np.repeat(np.arange(len(sets)), m)
        segment = np.arange(total) - first[owner]
        place = mix((band[owner] << 32 | segment).astype(np.uint64) + np.uint64(1))
        finish = lambda value, at: (mix(value + place[at]) & ~np.uint64(1)) | (band[owner[at]] & 1).astype(np.uint64)  # noqa: E731, B023
        n_filled = np.bincount(owner[filled], minlength=len(sets))
        long = deletions[band] == 0
        enough = n_filled >= need[band]
        # An empty segment is a signature only of sets that would have too few without it.
        out = np.flatnonzero(filled | ~(enough & long)[owner])
        made.append(finish(sums[out], out))
        of.append(owner[out])
        spare[t] = np.where(long & (n > 0), np.where(enough, n_filled, m) - need[band], 0)
        drop = np.flatnonzero((at - first[doc]) < deletions[band][doc])
        made.append(finish(sums[at[drop]] - spread[drop], at[drop]))
        of.append(doc[drop])
    return np.concatenate(made), np.concatenate(of), spare


def describe(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, key of the set (two 64-bit hashes), spare signatures, and the id and text as one hash."""
    schema = "doc_id long, n_shingles long, key1 long, key2 long, spare0 long, spare1 long, both long"

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in by_bytes(frames, 1):
            sets = shingles(*utf8(b.column(1)), n)
            spare = signatures(sets, percent)[2]
            keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            sizes = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (sizes, keys[:, 0], keys[:, 1], spare[0], spare[1])), b.column(2)],
                                             [x.split()[0] for x in schema.split(", ")])

    return docs.withColumn("both", ID_AND_TEXT()).mapInArrow(tidy(run), schema)


def told_apart(rows: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Rows and docs with a row id `rid` that names one set only, and whether any differs from its doc_id.

    That is the doc_id, but for ids whose texts have different sets: there, a hash of id and text. The ids are
    found in the written rows; texts are joined to them only if there are any.
    """
    twofold = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(*[f(k).alias(f"{f.__name__}_{k}") for f in (F.min, F.max) for k in ("key1", "key2")])
    twofold = written(twofold.where("min_key1 <> max_key1 OR min_key2 <> max_key2").select("doc_id", F.lit(True).alias("twofold")), "jaccard-twofold")
    if twofold.isEmpty():
        return rows.withColumn("rid", F.col("doc_id")), docs.withColumn("rid", F.col("doc_id")), False
    rid = lambda both: F.when(F.col("twofold"), both).otherwise(F.col("doc_id")).alias("rid")
    return (rows.join(twofold, "doc_id", "left").select(*rows.columns, rid(F.col("both"))),
            docs.join(twofold, "doc_id", "left").select(*docs.columns, rid(ID_AND_TEXT())), True)


def distinct_pairs(s: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of signature and id, in order."""
    order = np.lexsort((ids, s))
    s, ids = s[order], ids[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (ids[1:] != ids[:-1])
    return s[new], ids[new]


def repeated_signatures(docs: DataFrame, sign, tasks: int) -> DataFrame:
    """(signature, doc_id) of all signatures that occur with more than one id.

    `sign` gets the bytes and offsets of a batch of texts and returns signatures and the row of each.
    """

    def emit(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, turn = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            s, ids = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            s, ids = distinct_pairs(s, ids)
            new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
            again = ~new
            local = again | np.concatenate([again[1:], [False]]) if len(s) else again
            rows = []
            bucket = (s[new] >> np.uint64(32)) % np.uint64(tasks)
            by = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by], np.arange(tasks + 1, dtype=np.uint64))
            low = int(ids.min()) if len(ids) else 0
            narrow = len(ids) and int(ids.max()) - low < 1 << 32
            pack = lambda x: (x - low).astype("<u4").tobytes() if narrow else x.astype("<i8").tobytes()
            for k in range(tasks):
                some = by[cuts[k] : cuts[k + 1]]
                if len(some):
                    rows.append((k, False, s[new][some].tobytes(), pack(ids[new][some]), low, bool(narrow)))
            # What repeats within the run is known already; it goes to any task, in parts.
            s, ids = s[local], ids[local]
            for i in range(0, len(s), 100_000):
                rows.append((int(mix(np.array([(low + turn + i) % (1 << 64)], np.uint64))[0] % np.uint64(tasks)), True, s[i : i + 100_000].tobytes(),
                             pack(ids[i : i + 100_000]), low, bool(narrow)))
            kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())
            for r in rows:
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(r, kinds)], ["task", "known", "s", "ids", "low", "narrow"])

        for b in by_bytes(frames, 1):
            s, of = sign(*utf8(b.column(1)))
            held.append((s, b.column(0).to_numpy()[of]))
            size += b.nbytes
            if size >= RUN_BYTES:
                yield from flush()
                held, size, turn = [], 0, turn + 1
        if held:
            yield from flush()

    def gather(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda s, ids: pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(ids)], ["signature", "doc_id"])
        held = []
        for b in frames:
            for _, known, s, ids, low, narrow in zip(*(c.to_pylist() for c in b.columns)):
                ids = np.frombuffer(ids, "<u4").astype(np.int64) + low if narrow else np.frombuffer(ids, "<i8")
                s = np.frombuffer(s, np.uint64)
                if known:
                    yield rows(s, ids)
                else:
                    held.append((s, ids))
        if held:
            s, ids = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            held.clear()
            s, ids = distinct_pairs(s, ids)
            same = s[1:] == s[:-1]
            some = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
            for i in range(0, len(some), 100_000):
                yield rows(s[some[i : i + 100_000]], ids[some[i : i + 100_000]])

    packed = docs.mapInArrow(tidy(emit), "task int, known boolean, s binary, ids binary, low long, narrow boolean")
    return packed.repartition(tasks, "task").mapInArrow(tidy(gather), "signature long, doc_id long")


def thinned(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose id may be among `ids` (column id): a bitmap of fixed size, built by Spark."""
    spot = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(FILTER_BITS)).cast("long")
    at = ids.select((spot("id") + 1).alias("at"))  # bitmaps count from 1
    parts = at.groupBy(F.expr("bitmap_bucket_number(at)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits")).collect()
    table = np.zeros(FILTER_BITS // 8, np.uint8)  # FILTER_BITS / 2**15 parts of 2**12 bytes at most
    for r in parts:
        table[(r["part"] - 1) << 12 : r["part"] << 12] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    names = list(docs.columns)

    def keep(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            at = b.column(len(names)).to_numpy()
            hit = (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(hit)) for c in b.columns[:-1]], names)

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.withColumn("__at", spot(names[0])).mapInArrow(tidy(keep), schema)


def sets_of(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(id, items): the whole sets of the texts named by `ids` (a written table)."""

    def sets(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(frames, 1):
            found = [s.tobytes() for s in shingles(*utf8(b.column(1)), n)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["id", "items"])

    of = thinned(docs, ids).mapInArrow(tidy(sets), "id long, items binary")
    return written(of.join(ids, "id", "left_semi").dropDuplicates(["id"]), "jaccard-sets")


def meeting(sets: list[np.ndarray], parts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): for each part that a link joins to others, the least part that it can reach."""
    order = np.argsort([len(x) for x in sets], kind="stable")
    sets, size = [sets[i] for i in order], np.array([len(sets[i]) for i in order])
    names, label = np.unique(parts[order], return_inverse=True)
    _, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(len(sets)), size)
    keep = times[where] > 1  # values of one set alone are in no intersection
    doc, where = doc[keep], where[keep]
    root = np.arange(len(names))
    for i in range(0, len(sets), TILE):
        here = slice(i, min(i + TILE, len(sets)))
        a, z = np.searchsorted(doc, [here.start, here.stop])
        columns, column = np.unique(where[a:z], return_inverse=True)
        for j in range(i, len(sets), TILE):
            there = slice(j, min(j + TILE, len(sets)))
            if 100 * size[here.stop - 1] < percent * size[j]:
                break  # sizes ascend: no later set is near enough in size
            if (label[here] == label[i]).all() and (label[there] == label[i]).all():
                continue
            c, d = np.searchsorted(doc, [there.start, there.stop])
            at = np.searchsorted(columns, where[c:d])
            hit = columns[np.minimum(at, len(columns) - 1)] == where[c:d] if len(columns) else np.zeros(d - c, bool)
            other, at = doc[c:d][hit] - j, at[hit]
            common = np.zeros((here.stop - i, there.stop - j), np.float32)
            for first in range(0, len(columns), 4096):
                left, right = np.zeros((len(common), 4096), np.float32), np.zeros((common.shape[1], 4096), np.float32)
                some = (column >= first) & (column < first + 4096)
                left[doc[a:z][some] - i, column[some] - first] = 1
                some = (at >= first) & (at < first + 4096)
                right[other[some], at[some] - first] = 1
                common += left @ right.T
            near = 100 * common >= percent * (size[here][:, None] + size[there][None] - common)
            near &= label[here][:, None] != label[there][None]
            x, y = np.nonzero(near)
            if not len(x):
                continue
            for u, v in np.unique(np.stack([label[here][x], label[there][y]]), axis=1).T.tolist():
                while root[u] != u:
                    u = root[u]
                while root[v] != v:
                    v = root[v]
                root[max(u, v)] = min(u, v)
            while (root != root[root]).any():
                root = root[root]
            label = root[label]
    some = np.flatnonzero(root != np.arange(len(root)))
    return names[root[some]], names[some]


def checked_blocks(docs: DataFrame, entries: DataFrame, n: int, percent: int) -> DataFrame:
    """Edges (a, b) that connect the linked sets within each signature of entries (signature, class).

    With a column `part`, sets of one part count as connected and the edges are between parts. A signature's sets are
    dealt by hash into blocks of about BLOCK_BYTES, mostly one, and every two blocks meet in a task of their own.
    """
    entries = entries if "part" in entries.columns else entries.withColumn("part", F.col("class"))
    ids = written(entries.select(F.col("class").alias("id")).distinct(), "jaccard-ids")
    of = sets_of(docs, ids, n).withColumnRenamed("id", "class")
    sizes = entries.join(of.select("class", F.octet_length("items").alias("bytes")), "class")
    sizes = written(sizes.groupBy("signature").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("long").alias("blocks")), "jaccard-sizes")
    rows = entries.join(sizes, "signature").withColumn("own", F.pmod(F.xxhash64("class", "signature"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("signature", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "class", "part").join(of, "class")

    def meet(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for c in table.column("items").chunks for x in c]
        a, b = meeting(sets, table.column("part").to_numpy(), percent)
        return pa.table([pa.array(a), pa.array(b)], ["a", "b"])

    return written(rows.groupBy("signature", "i", "j").applyInArrow(meet, "a long, b long").distinct(), "jaccard-links")


def checked(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "jaccard-ids")
    of = sets_of(docs, ids, n)
    both = pairs.join(of.select(F.col("id").alias("b"), F.col("items").alias("of_b")), "b")
    both = both.join(of.select(F.col("id").alias("a"), F.col("items").alias("of_a")), "a").select("a", "b", "of_a", "of_b")

    def compare(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(i).filter(keep) for i in (0, 1)], ["a", "b"])

    return written(both.mapInArrow(tidy(compare), "a long, b long").distinct(), "jaccard-links")


def link_classes(known: DataFrame, entries: DataFrame, spare: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, component) of the classes that link.

    known: the texts (id first, then text); entries: (signature, class), a written table of the signatures that several
    classes may share; spare: (class, spare0, spare1, parity), the signatures a class may leave out among those
    of its own band (last bit = parity) and of the next.
    """
    # Each class against the class that is most often the least of its signatures, if they share as many as linked ones do.
    spark = entries.sparkSession
    spare = spare.select("class", F.array("spare0", "spare1").alias("spare"), "parity")
    next_ = F.when(F.pmod("signature", F.lit(2)) == F.col("parity"), 0).otherwise(1).alias("next")
    least = written(entries.groupBy("signature").agg(F.min("class").alias("least")), "jaccard-least")
    shared = entries.join(least, "signature").where("class <> least").groupBy("class", "least", F.pmod("signature", F.lit(2)).alias("signature")).agg(F.count("*").alias("n"))
    shared = shared.join(spare, "class").withColumn("next", next_).where(F.col("n") > F.col("spare")[F.col("next")])
    best = shared.groupBy("class").agg(F.max(F.struct("n", (-F.col("least")).alias("neg"))).alias("top"))
    stars = written(best.select((-F.col("top.neg")).alias("a"), F.col("class").alias("b")), "jaccard-stars")
    release(spark)
    links = checked(known, stars, n, percent)
    release(spark)
    parts = written(components(links, "jaccard-cc"), "jaccard-parts")

    # What is left: pairs of different parts that share a signature which one of them cannot leave out.
    entries = entries.join(parts.withColumnRenamed("node", "class"), "class", "left")
    entries = written(entries.select("signature", "class", F.coalesce("component", "class").alias("part")), "jaccard-left")
    cost = entries.groupBy("signature", "part").agg(F.lit(1).alias("one")).groupBy("signature").agg(F.count("*").alias("cost")).where("cost > 1")
    entries = written(entries.join(written(cost, "jaccard-cost"), "signature"), "jaccard-open")
    release(spark)
    priced = entries.join(spare, "class").select("*", next_).withColumn("spare", F.col("spare")[F.col("next")])
    of_class = Window.partitionBy("class", "next")
    out = (F.row_number().over(of_class.orderBy(F.desc("cost"), "signature")) <= F.col("spare")) & (F.col("cost") >= LEAVE)
    priced = priced.withColumn("out", out.cast("int")).withColumn("need", F.col("spare") + 1 - F.sum("out").over(of_class))
    kept = written(priced.where("out = 0").select("signature", F.col("class").alias("x"), F.col("part").alias("px"), "cost", "next", "need"), "jaccard-kept")
    many = kept.where(F.col("cost") >= MANY).select("signature").distinct()
    groups = entries.join(many, "signature", "left_semi").join(least, "signature").select(F.col("least").alias("signature"), "class", "part").distinct()
    blocks = checked_blocks(known, written(groups, "jaccard-groups"), n, percent)
    release(spark)
    # A pair that meets in a group is compared there; any other that links shares `need` signatures of x, all met by few.
    pairs = kept.where(F.col("cost") < MANY).join(entries.select("signature", F.col("class").alias("y"), F.col("part").alias("py")), "signature").where("px <> py")
    pairs = pairs.groupBy("x", "y", "next").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n >= need")
    pairs = written(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "jaccard-pairs")
    release(spark)
    more = checked(known, pairs, n, percent)
    release(spark)
    edges = parts.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b").unionByName(more).unionByName(blocks)
    return written(components(edges, "jaccard-cc"), "jaccard-parts")


def near_copies(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, docs, renamed = told_apart(written(describe(docs, n, percent), "jaccard-rows"), docs)
    known = docs.where("rid IS NOT NULL").select(F.col("rid").alias("doc_id"), "text")
    full = rows.where("n_shingles > 0 AND rid IS NOT NULL")
    classes = written(full.groupBy("key1", "key2").agg(F.min("rid").alias("class"), F.first("n_shingles").alias("n"),
                                                       F.first("spare0").alias("spare0"), F.first("spare1").alias("spare1")), "jaccard-classes")
    of_doc = written(full.select(F.col("rid").alias("doc_id"), "key1", "key2").join(classes.select("key1", "key2", "class"), ["key1", "key2"])
                     .select("doc_id", "class").distinct(), "jaccard-members")

    total = full.agg(F.sum(F.col("n_shingles"))).first()[0] or 0
    tasks = max(partitions(spark), -(-int(total * 0.4) // TASK_SIGNATURES))
    sign = lambda data, offsets: signatures(shingles(data, offsets, n), percent)[:2]
    # Only the text that names a class is signed: copies have its signatures.
    copies = written(of_doc.where("doc_id <> class").select("doc_id").distinct(), "jaccard-copies")
    known = known.join(copies, "doc_id", "left_anti")
    entries = written(repeated_signatures(known, sign, tasks).select("signature", F.col("doc_id").alias("class")).distinct(), "jaccard-entries")
    release(spark)
    upper = F.array(*[F.lit(int(u)) for u in bands(percent)[0]])
    own = F.size(F.filter(upper, lambda u: u < F.col("n")))
    parts = link_classes(known, entries, classes.select("class", "spare0", "spare1", (own % 2).alias("parity")), n, percent)

    placed = of_doc.join(parts.withColumnRenamed("node", "class"), "class", "left")
    placed = written(placed.select(F.col("doc_id").alias("rid"), F.coalesce("component", "class").alias("component_id")), "jaccard-placed")
    if renamed:  # a component is named by its least doc_id, which a row id of its own may hide
        least = full.select("rid", "doc_id").join(placed, "rid").groupBy("component_id").agg(F.min("doc_id").alias("least"))
        placed = written(placed.join(least, "component_id").select("rid", F.col("least").alias("component_id")), "jaccard-placed")
    return rows.select("doc_id", "rid", "n_shingles").join(placed, "rid", "left").select(
        "doc_id", "n_shingles", F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), "doc_id").alias("component_id"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_copies(read(spark, sf_dir, "documents", "doc_id", "text"))

