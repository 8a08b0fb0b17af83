"""Exact top-k inner products by a pivot-distance index.

1. Vectors become integers; each is keyed by its nearest pivot and the distance to it. Pivots are k-means centres
   of at most `SAMPLE` vectors taken by the hash of their id (the documented bound), at most `PIVOTS` of them.
2. A pivot's vectors are cut by distance into annuli (cuts from the same sample), so that a table of at most
   PIVOTS * ANNULI annuli with their counts, distances and largest norm describes all data. Vectors of a length
   without a pivot are one annulus around zero. An annulus is dealt to slices by its size, and stored in
   blocks of bounded bytes, sorted by distance.
3. Queries are sorted by pivot and distance and packed. With |q - x| >= |d(q, p) - d(x, p)| for pivot p, the score
   2<q, x> = |q|^2 + |x|^2 - |q - x|^2 has an upper bound per annulus. A query expands annuli in descending order of
   bound, round by round (`GROWTH` times as many vectors seen each round), and stops when no bound of an annulus left
   reaches its k-th best score. Blocks inside an annulus are tested by the same bound again.
4. A pack visits a slice if one of its queries does: an equi-join of packs and blocks by slice, both plain written
   tables that adaptive execution can split. A joined row is one matrix product; k rows per query leave it.

Every vector is indexed and every bound is exact up to a stated slack, so results are exact; where bounds prune
nothing, each query meets each vector once, block by block.

Defined cases: vectors that are null or hold null or non-finite components, and rows with a null id, take no part.
Vectors of different lengths are not compared; an empty vector scores 0 with other empty ones. Rows that repeat an id
are queries and candidates of their own. Components beyond a long are held at its ends, and so are scores. Fewer than k
candidates: all of them. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clickloom.llm.common import read, written
from clickloom.llm.vectors import kmeans

K, SCALE, EVERY = 5, 256, 50
SAMPLE, PIVOTS, ANNULI = 4096, 64, 32
#: Vectors of an annulus aimed at, and bytes of a slice's vectors.
ANNULUS, SLICE_BYTES = 1024, 64 << 20
#: Bytes of the vectors of a block and of a pack, which meet in one row.
BLOCK_BYTES, PACK_BYTES = 128 << 10, 32 << 10
#: Visits of a pack that leave a task in one batch.
VISITS = 256
#: Vectors that a query sees in the first round, and how many times more in each later one.
FIRST, GROWTH = 512, 8
#: Relative slack of bounds against rounding.
SLACK = 1e-9


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, q): floor(scale * x) of the vectors that take part, with a number per row."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("v", lambda x: F.floor(x * float(scale))).alias("q"))


def narrowest(rows: DataFrame) -> tuple[int, str]:
    """Number of rows, and the smallest integer type that holds all components."""
    reach = F.greatest(F.array_max("q"), -(F.array_min("q") + 1))
    got = rows.agg(F.count("*").alias("n"), F.max(reach).alias("most")).first()
    return got["n"], next(t for t in ("int16", "int32", "int64") if (got["most"] or 0) <= np.iinfo(t).max)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows, exact: in doubles below 2^53, in longs below 2^63, else in Python integers."""
    top = [int(max(-int(m.min()), int(m.max()))) if m.size else 0 for m in (a, b)]
    most = top[0] * top[1] * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), -(1 << 63), (1 << 63) - 1).astype(np.int64)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of integer rows to pivots, by differences (no cancellation)."""
    out = np.empty((len(x), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = np.sqrt(((x - p) ** 2).sum(1))
    return out


@dataclass
class Pivots:
    """Pivots and the cuts of their annuli by vector length. A length without pivots has one annulus around zero."""

    by_width: dict[int, tuple[np.ndarray, np.ndarray, int]]  # pivots, cuts (one row each), number of the first annulus

    @staticmethod
    def fit(sample: list[np.ndarray], rows: int) -> Pivots:
        """Pivots shared among lengths by their part of the sample."""
        by_width, first = {}, 1
        widths = sorted({len(x) for x in sample if len(x)}, key=lambda w: (-sum(len(x) == w for x in sample), w))
        for w in widths[:PIVOTS]:
            x = np.array([v for v in sample if len(v) == w], np.float64)
            share = rows * len(x) / len(sample)
            cells = min(max(int(share / ANNULUS), 1), PIVOTS * ANNULI * len(x) // len(sample) or 1)
            k = max(1, min(int(np.sqrt(cells)), PIVOTS * len(x) // len(sample)))
            pivots = kmeans(x, k)
            d = distances(x, pivots)
            own, rings = d.argmin(1), max(1, min(cells // len(pivots), ANNULI))
            cuts = np.array([np.quantile(d[own == j, j], np.arange(1, rings) / rings) if (own == j).any() else np.zeros(rings - 1) for j in range(len(pivots))])
            by_width[w] = (pivots, cuts.reshape(len(pivots), rings - 1), first)
            first += len(pivots) * rings
        return Pivots(by_width)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(annulus, distance to its pivot, squared norm) of rows of one length."""
        xf = x.astype(np.float64)
        norm = (xf**2).sum(1)
        if x.shape[1] not in self.by_width:
            return np.zeros(len(x), np.int64), np.sqrt(norm), norm
        pivots, cuts, first = self.by_width[x.shape[1]]
        d = distances(xf, pivots)
        own = d.argmin(1)
        at = d[np.arange(len(x)), own]
        ring = (cuts[own] <= at[:, None]).sum(1)
        return first + own * (cuts.shape[1] + 1) + ring, at, norm

    def to_pivots(self, x: np.ndarray) -> np.ndarray:
        """Distances of rows to the pivot of every annulus of their length, in the order of annuli."""
        pivots, cuts, _ = self.by_width[x.shape[1]]
        return np.repeat(distances(x.astype(np.float64), pivots), cuts.shape[1] + 1, axis=1)


def bound(q_norm: np.ndarray, q_dist: np.ndarray, near: np.ndarray, far: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """The most that <q, x> can be for x at a distance in [near, far] of a pivot, with a squared norm up to `norm`."""
    gap = np.maximum(0, np.maximum(near - q_dist, q_dist - far))
    size = q_norm + norm
    return (size - gap**2) / 2 + SLACK * (size + q_dist**2) + 1e-6


def by_width(q: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer matrix) for each vector length of an Arrow list column."""
    flat = q.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(np.asarray(q.value_lengths()))]).astype(np.int64)
    sizes = np.diff(offsets)
    for w in np.unique(sizes):
        at = np.flatnonzero(sizes == w)
        yield at, flat[offsets[at][:, None] + np.arange(w)]


POINT = "row long, vec_id long, width int, annulus int, distance double, norm double, x binary"


def keyed(rows: DataFrame, pivots: Pivots, kind: str) -> DataFrame:
    """Rows with their annulus, distance to its pivot, squared norm, and vector as bytes of integers of a kind."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(frames):
        for b in frames:
            for at, x in by_width(b.column(2)):
                annulus, d, norm = shared.value.place(x)
                narrow = x.astype(kind)
                raw, step = narrow.tobytes(), x.shape[1] * narrow.itemsize
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(np.full(len(at), x.shape[1]), pa.int32()), pa.array(annulus, pa.int32()),
                     pa.array(d), pa.array(norm), pa.array([raw[i * step : (i + 1) * step] for i in range(len(at))], pa.binary())],
                    ["row", "vec_id", "width", "annulus", "distance", "norm", "x"])

    return rows.select("row", "vec_id", "q").mapInArrow(run, POINT)


def packs_of(points: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Consecutive rows of equal keys, in the order given, as one row with their bytes, up to `most` bytes of vectors."""
    names = [*keys, "rows", "ids", "distances", "norms", "x"]
    schema = ", ".join([*(f"{k} int" for k in keys), "rows binary, ids binary, distances binary, norms binary, x binary"])

    def run(frames):
        held, key, size = [], None, 0

        def pack():
            cols = list(zip(*held))
            raw = [np.array(cols[0], np.int64), np.array(cols[1], np.int64), np.array(cols[2]), np.array(cols[3])]
            return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in key), *(pa.array([r.tobytes()]) for r in raw), pa.array([b"".join(cols[4])])], names)

        for b in frames:
            cols = [b.column(i).to_pylist() for i in range(len(keys) + 5)]
            for r in zip(*cols):
                k, size_now = r[: len(keys)], len(r[-1]) + 32  # the row's numbers count too
                if held and (k != key or size + size_now > most):
                    yield pack()
                    held, size = [], 0
                held.append(r[len(keys):])
                key, size = k, size + size_now
        if held:
            yield pack()

    return points.select(*keys, "row", "vec_id", "distance", "norm", "x").mapInArrow(run, schema)


@dataclass
class Annuli:
    """What is known of all annuli: counts, slices, distances and largest squared norms. At most PIVOTS * ANNULI rows."""

    known: dict[int, tuple[int, int, float, float, float]]
    widths: dict[int, np.ndarray]  # annuli of a length, ascending

    @staticmethod
    def of(points: DataFrame, pivots: Pivots) -> Annuli:
        got = points.where("annulus > 0").groupBy("annulus").agg(
            F.count("*").alias("n"), F.sum(F.octet_length("x").cast("long")).alias("bytes"), F.min("distance").alias("near"), F.max("distance").alias("far"), F.max("norm").alias("norm")).collect()
        known = {r.annulus: (r.n, max(1, -(-r.bytes // SLICE_BYTES)), r.near, r.far, r.norm) for r in got}
        widths = {}
        for w, (p, cuts, first) in pivots.by_width.items():
            widths[w] = np.array([a for a in range(first, first + len(p) * (cuts.shape[1] + 1)) if a in known], np.int64)
        return Annuli(known, widths)


def in_slices(points: DataFrame, annuli: Annuli) -> DataFrame:
    """Points with a slice of their annulus, by the row number. Annulus 0 is keyed by length and has one slice per length and hash."""
    big = {a: s for a, (_, s, *_) in annuli.known.items() if s > 1}
    if not big:
        return points.withColumn("slice", F.lit(0))
    table = F.create_map(*[F.lit(int(x)) for pair in big.items() for x in pair])
    return points.withColumn("slice", F.pmod(F.xxhash64("row"), F.coalesce(F.element_at(table, F.col("annulus")), F.lit(1))).cast("int"))


def visits(packs: DataFrame, pivots: Pivots, annuli: Annuli, kind: str, seen: int, upto: int) -> DataFrame:
    """(width, annulus, slice, pack columns, lows): slices that a pack visits between `seen` and `upto` vectors.

    `lows` holds each query's k-th best score so far if the query visits the annulus, else the greatest long.
    """
    spark = packs.sparkSession
    shared = spark.sparkContext.broadcast((pivots, annuli))
    least, most = -(1 << 63), (1 << 63) - 1
    cols = ["width", "rows", "ids", "norms", "x", "lows"]
    schema = "width int, annulus int, slice int, rows binary, ids binary, norms binary, x binary, lows binary, dists binary"

    def run(frames):
        pivots, annuli = shared.value
        for b in frames:
            for r in b.to_pylist():
                w, x = r["width"], np.frombuffer(r["x"], kind).reshape(len(r["rows"]) // 8, r["width"])
                lows = np.frombuffer(r["lows"], np.int64) if r["lows"] is not None else np.full(len(x), least)
                norms = np.frombuffer(r["norms"])
                out = []
                if w not in pivots.by_width:
                    if seen == 0:
                        out.append((0, 0, lows, np.sqrt(norms)))
                elif len(annuli.widths[w]):
                    own = annuli.widths[w]
                    n, slices, near, far, norm = (np.array(c) for c in zip(*(annuli.known[a] for a in own)))
                    d = pivots.to_pivots(x)[:, own - pivots.by_width[w][2]]
                    top = bound(norms[:, None], d, near, far, norm)
                    order = np.argsort(-top, axis=1, kind="stable")
                    before = np.empty_like(order)
                    np.put_along_axis(before, order, np.cumsum(n[order], axis=1) - n[order], axis=1)
                    # An annulus belongs to the round in which the vectors before it reach past `seen`.
                    wanted = (before >= seen) & (before < upto) & (top >= lows[:, None].astype(np.float64))
                    for j in np.flatnonzero(wanted.any(0)):
                        low = np.where(wanted[:, j], lows, most)
                        out += [(int(own[j]), s, low, d[:, j]) for s in range(int(slices[j]))]
                for i in range(0, len(out), VISITS):
                    part = out[i : i + VISITS]
                    m = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([w] * m, pa.int32()), *(pa.array([o[c] for o in part], pa.int32()) for c in (0, 1)),
                         *(pa.array([r[c]] * m, pa.binary()) for c in ("rows", "ids", "norms", "x")),
                         *(pa.array([np.ascontiguousarray(o[c], t).tobytes() for o in part]) for c, t in ((2, np.int64), (3, np.float64)))],
                        ["width", "annulus", "slice", "rows", "ids", "norms", "x", "lows", "dists"])

    return packs.select(*cols).mapInArrow(run, schema)


FOUND = "query long, query_id long, row long, vec_id long, score long"


def scored(joined: DataFrame, kind: str, k: int) -> DataFrame:
    """The k best candidates of each query in a pack and a block."""

    def run(frames):
        for b in frames:
            out = [[] for _ in range(5)]
            for r in b.to_pylist():
                q_rows, q_ids, lows = (np.frombuffer(r[c], np.int64) for c in ("rows", "ids", "lows"))
                rows, ids = (np.frombuffer(r[c], np.int64) for c in ("c_rows", "c_ids"))
                w = r["width"]
                at = np.frombuffer(r["c_distances"])
                top = bound(np.frombuffer(r["norms"]), np.frombuffer(r["dists"]), at.min(), at.max(), np.frombuffer(r["c_norms"]).max())
                go = np.flatnonzero((lows < (1 << 63) - 1) & (top >= lows.astype(np.float64)))
                if not len(go):
                    continue
                x = np.frombuffer(r["x"], kind).reshape(len(q_rows), w)[go]
                c = np.frombuffer(r["c_x"], kind).reshape(len(rows), w)
                got = products(x, c)
                for i, g in enumerate(go):
                    ok = np.flatnonzero((got[i] >= lows[g]) & (rows != q_rows[g]))
                    if len(ok) > k:
                        cut = np.partition(got[i, ok], len(ok) - k)[len(ok) - k]
                        ok = ok[got[i, ok] >= cut]
                        ok = ok[np.lexsort((ids[ok], -got[i, ok]))[:k]] if len(ok) > k else ok
                    for o, v in zip(out, (np.full(len(ok), q_rows[g]), np.full(len(ok), q_ids[g]), rows[ok], ids[ok], got[i, ok])):
                        o.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).astype(np.int64)) for o in out], ["query", "query_id", "row", "vec_id", "score"])

    return joined.mapInArrow(run, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best inner products of every row for which `is_query` (of vec_id) holds."""
    rows = written(integers(vectors, scale), "topk-rows")
    count, kind = narrowest(rows)
    sample = rows.orderBy(F.xxhash64("vec_id"), "row").limit(SAMPLE).select("q").collect()
    pivots = Pivots.fit([np.array(r.q, np.int64) for r in sample], count)
    points = written(keyed(rows, pivots, kind), "topk-points")
    annuli = Annuli.of(points, pivots)
    # The row number splits annuli of equal distances, so that no key is too large for a range.
    blocks = in_slices(points, annuli).repartitionByRange("width", "annulus", "slice", "distance", "row").sortWithinPartitions("width", "annulus", "slice", "distance", "row")
    blocks = written(packs_of(blocks, ["width", "annulus", "slice"], BLOCK_BYTES), "topk-blocks")
    blocks = blocks.select("width", "annulus", "slice", *(F.col(c).alias(f"c_{c}") for c in ("rows", "ids", "distances", "norms", "x")))
    asked = points.where(is_query).repartitionByRange("width", "annulus", "distance", "row").sortWithinPartitions("width", "annulus", "distance", "row")
    packs = written(packs_of(asked.withColumn("pack", F.lit(0)), ["width", "pack"], PACK_BYTES).withColumn("pack", F.monotonically_increasing_id()), "topk-packs")

    best, seen, upto = None, 0, FIRST
    total = max(count, 1)
    while True:
        if best is None:
            state = packs.withColumn("lows", F.lit(None).cast("binary"))
        else:
            state = packs.join(lows_of(packs, best, k), "pack", "left")
        joined = visits(state, pivots, annuli, kind, seen, upto).join(blocks, ["width", "annulus", "slice"])
        found = scored(joined, kind, k)
        best = written(ranked(found if best is None else found.unionByName(best.drop("rank")), k), "topk-best")
        if upto >= total:
            break
        seen, upto = upto, upto * GROWTH
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def lows_of(packs: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """(pack, lows): each query's k-th best score, or the least long while it has fewer than k candidates."""

    def rows_of(frames):
        for b in frames:
            for pack, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                q = np.frombuffer(rows, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), pack)), pa.array(np.arange(len(q))), pa.array(q)], ["pack", "place", "query"])

    places = packs.select("pack", "rows").mapInArrow(rows_of, "pack long, place long, query long")
    low = best.where(F.col("rank") == k).select("query", F.col("score").alias("low"))
    each = places.join(low, "query", "left").select("pack", "place", F.coalesce("low", F.lit(-(1 << 63))).alias("low"))
    listed = each.groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("place", "low"))).alias("all")).select("pack", F.col("all.low").alias("l"))

    def as_bytes(frames):
        for b in frames:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.array(v, np.int64).tobytes() for v in b.column(1).to_pylist()], pa.binary())], ["pack", "lows"])

    return listed.mapInArrow(as_bytes, "pack long, lows binary")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % EVERY == 0)


SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS own, vec_id, [floor({SCALE} * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
pairs AS (
  SELECT a.own, a.vec_id AS query_id, b.vec_id, b.own AS other, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v AS a JOIN v AS b ON len(a.q) = len(b.q) AND a.own <> b.own WHERE a.vec_id % {EVERY} = 0
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, (row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id, other))::INTEGER AS rank FROM pairs) WHERE rank <= {K}
"""
