"""Near-duplicate vectors by an inverted multi-index.

1. Equal vectors are one class, named by the least id; copies are never paired.
2. Two codebooks, one per half of the (unit) vectors, are fitted by k-means on at most `SAMPLE` classes taken by
   the hash of their id (the documented bound of the index's sample). Their product is a grid of cells.
3. Every class is put into its cell. For its search it visits cells in the order of a multi-sequence traversal:
   by the sum, over both halves, of the squared distance to the region of a centroid. A pair of cells is visited
   once, from the lower one.
4. The traversal ends where the target recall is reached. The radius that gives it is measured: `PROBES` classes
   are compared with all classes by brute force, and the radius covers their links (twice the distance that
   does, and at least a twentieth of the squared distance of the threshold). Without any link among the probes
   it is the full distance, at which no link can be missed.
5. Cells are cut into blocks by hash and their visitors into parts, so that a cell with a third of all
   vectors is many tasks. A block counts links and returns per vector one number and one representative of its
   links, never the pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor
do rows with a null id; vectors link only with others of their own length, and each length has a grid and a pass of its own;
equal vectors with other ids are copies and link; an empty table gives no rows; only the id and vector columns are read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import components, mix, read, small_batches, written

COSINE = 0.95
SAMPLE, PROBES, RECALL = 20_000, 256, 0.999
#: Classes per cell aimed at, and most centroids per half (so that tables by cell stay bounded).
CELL, CENTROIDS = 48, 256
#: Vectors of a cell, and visitors, that meet in one block.
BLOCK, PART = 256, 512


def unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    k = min(k, len(np.unique(x, axis=0)))
    centers = np.unique(x, axis=0)[np.random.default_rng(seed).permutation(len(np.unique(x, axis=0)))[:k]]
    for _ in range(rounds):
        near = (-2 * x @ centers.T + (centers**2).sum(1)).argmin(1)
        n = np.bincount(near, minlength=k)
        for j in range(x.shape[1]):
            centers[:, j] = np.where(n > 0, np.bincount(near, x[:, j], k) / np.maximum(n, 1), centers[:, j])
    return centers


class Grid:
    """The product of two codebooks."""

    def __init__(self, sample: np.ndarray, k: int):
        self.cut = sample.shape[1] // 2
        self.books = [kmeans(h, k) for h in self.halves(sample)]
        self.apart = [np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(2), 1e-18)) for c in self.books]

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.cut], x[:, self.cut :]

    def bounds(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per half: the nearest centroid, and the squared distance to the half space of each centroid's region."""
        out = []
        for h, book, apart in zip(self.halves(x), self.books, self.apart):
            d = (h**2).sum(1)[:, None] - 2 * h @ book.T + (book**2).sum(1)
            near = d.argmin(1)
            far = np.maximum(0, (d - d.min(1, keepdims=True)) / (2 * apart[near]))
            far[np.arange(len(x)), near] = 0
            out.append((near, far**2))
        return out

    def cells(self, x: np.ndarray) -> np.ndarray:
        (a, _), (b, _) = self.bounds(x)
        return a * len(self.books[1]) + b

    def visits(self, bounds, i: int, radius: float) -> list[int]:
        """Cells of row i in ascending order of distance, up to `radius`: the multi-sequence traversal."""
        (_, da), (_, db) = bounds
        oa, ob = np.argsort(da[i], kind="stable"), np.argsort(db[i], kind="stable")
        a, b, wide = da[i][oa], db[i][ob], len(self.books[1])
        heap, seen, out = [(a[0] + b[0], 0, 0)], {(0, 0)}, []
        while heap:
            d, p, q = heapq.heappop(heap)
            if d > radius:
                break
            out.append(int(oa[p]) * wide + int(ob[q]))
            for nxt in ((p + 1, q), (p, q + 1)):
                if nxt[0] < len(a) and nxt[1] < len(b) and nxt not in seen:
                    seen.add(nxt)
                    heapq.heappush(heap, (a[nxt[0]] + b[nxt[1]], *nxt))
        return out


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid members: vec_id and vector), (classes: class, n, vector, length)."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    rows = rows.where(~bad & F.exists("v", lambda x: x != 0))
    rows = written(rows, "vectors")
    return rows, written(rows.groupBy("v").agg(F.min("vec_id").alias("class"), F.count("*").alias("n")).withColumn("d", F.size("v")), "vector-classes")


def packed(classes: DataFrame) -> DataFrame:
    """Classes with vectors as bytes, which Python reads without a loop."""

    def run(frames):
        for b in frames:
            v = b.column(2)
            values = np.ascontiguousarray(v.flatten().to_numpy())
            width = len(values) // max(b.num_rows, 1) * 8
            raw = values.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([raw[i * width : (i + 1) * width] for i in range(b.num_rows)], pa.binary())],
                                             ["class", "n", "x"])

    return classes.select("class", "n", "v").mapInArrow(run, "class long, n long, x binary")


def radius(rows: DataFrame, grid: Grid, probes: list[bytes], cosine: float, recall: float) -> float:
    """The traversal radius at which the probes' links with all classes are found with the target recall."""
    full = 2 - 2 * cosine
    shared = rows.sparkSession.sparkContext.broadcast((grid, unit(probes)))

    def run(frames):
        grid, q = shared.value
        (_, da), (_, db) = grid.bounds(q)
        for b in frames:
            x = unit(b.column(2).to_pylist())
            (ca, _), (cb, _) = grid.bounds(x)
            i, j = np.nonzero(q @ x.T >= cosine)
            # Counts by rounded distance: a table of fixed size, however many links there are.
            step, n = np.unique(np.ceil((da[i, ca[j]] + db[i, cb[j]]) / full * 1000).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(n)], ["step", "n"])

    # A probe's link with itself has distance 0 and is left out of the count.
    got = sorted((r.step, r.n) for r in rows.mapInArrow(run, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect())
    got = [(s, n - len(probes) if s == 0 else n) for s, n in got]
    total = sum(n for _, n in got)
    if total <= 0:
        return full
    done = 0
    for step, n in got:
        done += n
        if done >= recall * total:
            return min(full, max(full / 20, 2 * step / 1000 * full))
    return full


def links(rows: DataFrame, grid: Grid, reach: float, cosine: float) -> DataFrame:
    """(class, links, root): per class and block, linked vectors there and a class that its links there lead to."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(grid)
    wide = len(grid.books[1])

    def place(frames):
        for b in frames:
            x = unit(b.column(2).to_pylist())
            grid = shared.value
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(grid.cells(x).astype(np.int64))], ["class", "n", "x", "cell"])

    def visit(frames):
        grid = shared.value
        for b in frames:
            bounds = grid.bounds(unit(b.column(2).to_pylist()))
            own = b.column(3).to_numpy()
            to = [[c for c in grid.visits(bounds, i, reach) if c >= own[i]] for i in range(b.num_rows)]
            at = pa.array(np.repeat(np.arange(b.num_rows), [len(t) for t in to]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(3).take(at), pa.array([c for t in to for c in t], pa.int64())], ["class", "own", "cell"])

    placed = written(rows.mapInArrow(place, "class long, n long, x binary, cell long"), "vector-cells")
    visits = written(placed.mapInArrow(visit, "class long, own long, cell long"), "vector-visits")
    # Blocks of a cell and parts of its visitors: tables by cell, of at most len(grid) rows.
    blocks, parts = np.ones((2, len(grid.books[0]) * wide), np.int64)
    for r in placed.groupBy("cell").count().collect():
        blocks[r["cell"]] = -(-r["count"] // BLOCK)
    for r in visits.groupBy("cell").count().collect():
        parts[r["cell"]] = -(-r["count"] // PART)
    tables = spark.sparkContext.broadcast((blocks, parts))

    def deal(kind: int):
        def run(frames):
            blocks, parts = tables.value
            mine, theirs = (blocks, parts) if kind else (parts, blocks)
            for b in frames:
                cell = b.column(3).to_numpy()
                own = (mix(b.column(0).to_numpy().astype(np.uint64) + np.uint64(kind)) % mine[cell].astype(np.uint64)).astype(np.int64)
                times = theirs[cell]
                at = np.repeat(np.arange(len(cell)), times)
                other = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                block, part = (own[at], other) if kind else (other, own[at])
                took = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell[at]), pa.array(block), pa.array(part), pa.array(np.full(len(at), kind)), *(b.column(i).take(took) for i in (0, 1, 2, 4))],
                    ["cell", "block", "part", "kind", "class", "n", "x", "own"])
        return run

    schema = "cell long, block long, part long, kind long, class long, n long, x binary, own long"
    index = placed.withColumn("own", F.col("cell")).mapInArrow(deal(1), schema)
    visitors = visits.join(placed.select("class", "n", "x"), "class").select("class", "n", "x", "cell", "own").mapInArrow(deal(0), schema)

    def meet(table: pa.Table) -> pa.Table:
        kind, ids, n = (table.column(c).to_numpy() for c in ("kind", "class", "n"))
        names = ["class", "links", "root"]
        p, q = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        if not len(p) or not len(q):
            return pa.table([pa.array([], pa.int64())] * 3, names)
        x = unit(table.column("x").to_pylist())
        near = x[p] @ x[q].T >= cosine
        inside = table.column("own").to_numpy()[p] == table.column("cell").to_numpy()[p]
        near &= ~inside[:, None] | (ids[p][:, None] < ids[q][None])  # within a cell every pair is met from both sides
        a, b = near @ n[q], near.T @ n[p]
        low_p, low_q = ids[p].copy(), ids[q].copy()
        top = np.iinfo(np.int64).max
        while True:  # spread the least id along links
            new_q = np.minimum(low_q, np.where(near, low_p[:, None], top).min(0))
            new_p = np.minimum(low_p, np.where(near, new_q[None], top).min(1))
            if (new_q == low_q).all() and (new_p == low_p).all():
                break
            low_p, low_q = new_p, new_q
        out = [np.concatenate(c) for c in ((ids[p], ids[q]), (a, b), (low_p, low_q))]
        return pa.table([pa.array(c[out[1] > 0].astype(np.int64)) for c in out], names)

    return index.unionByName(visitors).groupBy("cell", "block", "part").applyInArrow(meet, "class long, links long, root long")


def placed_of(classes: DataFrame, cosine: float, recall: float) -> DataFrame:
    """v, n_links, component_id of classes of one length."""
    rows = written(packed(classes), "vector-rows")
    count = rows.count()
    sample = [bytes(r.x) for r in rows.orderBy(F.xxhash64("class"), "class").limit(SAMPLE).select("x").collect()]
    if sample and len(sample[0]) > 8:
        grid = Grid(unit(sample), int(min(max(math.sqrt(count / CELL), 1), CENTROIDS)))
        reach = radius(rows, grid, sample[:PROBES], cosine, recall)
        found = written(links(rows, grid, reach, cosine), "vector-links")
    else:
        # No vectors, or numbers: all of one sign are the same direction.
        sign = F.when(F.col("v")[0] > 0, 1).otherwise(-1)
        side = classes.groupBy(sign.alias("side")).agg(F.min("class").alias("root"), F.sum("n").alias("all"))
        found = written(classes.withColumn("side", sign).join(side, "side").select("class", (F.col("all") - F.col("n")).alias("links"), "root"), "vector-links")
    linked = found.groupBy("class").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")), "vector-cc")
    placed = classes.join(linked, "class", "left").join(parts.withColumnRenamed("node", "class"), "class", "left")
    return written(placed.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "class").alias("component_id")), "vector-placed")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding)."""
    members, classes = classes_of(vectors)
    lengths = [r["d"] for r in classes.select("d").distinct().orderBy("d").collect()]
    placed = classes.select("v", F.lit(0).cast("long").alias("n_links"), F.col("class").alias("component_id")).where("false")
    for d in lengths:
        placed = placed.unionByName(placed_of(classes.where(F.col("d") == d), cosine, recall))
    own = written(members.join(placed, "v").select("vec_id", "n_links", "component_id").dropDuplicates(["vec_id"]), "vector-own")
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(own, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_vectors(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
