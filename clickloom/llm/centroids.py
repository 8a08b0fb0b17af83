"""Centroid clustering of integer vectors by expressions of the JVM alone.

A vector's squared distance to a centroid is `aggregate` over `zip_with` of the vector and a literal array, its
cluster the least (distance, number) struct by `array_min`. A round is one grouped sum per component, combined
before the shuffle, so that k rows reach the driver, whatever the number of vectors or the size of a cluster.
The integer vectors are written once; every round reads that table, so that a lost executor costs its tasks alone.

Defined cases: vectors that are null, of another length, or hold null or non-finite components take no part, and
an empty table gives no rows. Rows that repeat all take part, each with its row of the result; first centroids with
equal hashes are ordered by their components; a null id counts as an empty text in the hash. Fewer vectors than
centroids: each is one. Equal centroids: the smaller number gets the vectors, the other stays empty where it is.
Components are held at +-1.5e9 after scaling and a squared distance beyond a long at the greatest long; sums of
distances that no long holds are null. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import read, written

CENTROIDS, ROUNDS, SCALE, DIMENSIONS, SEED = 8, 10, 1024, 64, 3
#: Largest scaled component; the difference of two has a square that fits a long.
MOST = 1_500_000_000
#: Up to here no squared distance of `SAFE_WIDTH` components can leave a long, and plain sums are right.
SAFE, SAFE_WIDTH = 1 << 27, 64
LONGEST = (1 << 63) - 1


@dataclass(frozen=True)
class Clustering:
    """Final centroids, and (vec_id, cluster, distance) of every vector that takes part."""

    centroids: list[list[int]]
    assigned: DataFrame


def integer_vectors(vectors: DataFrame, scale: int = SCALE, width: int = DIMENSIONS) -> DataFrame:
    """(vec_id, q, norm): floor(scale * x) of the vectors that take part; their squared norm, null if a sum might leave a long."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", v.alias("v")).where(F.size("v") == width)
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    held = lambda x: F.floor(F.greatest(F.least(x * float(scale), F.lit(float(MOST))), F.lit(float(-MOST))))
    rows = rows.select("vec_id", F.transform("v", held).alias("q"))
    small = F.lit(width <= SAFE_WIDTH) & ~F.exists("q", lambda x: F.abs(x) > SAFE)
    return rows.withColumn("norm", F.when(small, F.aggregate("q", F.lit(0).cast("bigint"), lambda total, x: total + x * x)))


def distance(centroid: list[int]) -> Column:
    """Squared distance of q to a centroid, exact where a long holds it."""
    literal = F.array(*[F.lit(c) for c in centroid]).cast("array<bigint>")
    zero = F.lit(0).cast("bigint")
    squares = F.zip_with("q", literal, lambda x, c: (x - c) * (x - c))
    careful = F.aggregate(squares, zero, lambda total, s: F.coalesce(F.try_add(total, s), F.lit(LONGEST)))
    if max(map(abs, centroid), default=0) > SAFE:
        return careful
    inner = F.aggregate(F.zip_with("q", literal, lambda x, c: x * c), zero, lambda total, p: total + p)
    own = F.lit(sum(c * c for c in centroid)).cast("bigint")
    return F.when(F.col("norm").isNotNull(), F.col("norm") - 2 * inner + own).otherwise(careful)


def nearest(centroids: list[list[int]]) -> Column:
    """Struct (distance, cluster) of the nearest centroid; ties go to the smaller number."""
    ways = [F.struct(distance(c).alias("distance"), F.lit(j).alias("cluster")) for j, c in enumerate(centroids)]
    return F.array_min(F.array(*ways))


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors whose ids have the smallest hashes; k rows reach the driver."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [list(r.q) for r in rows.select(digest.alias("digest"), "q").orderBy("digest", "q").limit(k).collect()]


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Every non-empty centroid at the floor of its vectors' mean."""
    sums = [F.sum(F.col("q")[i]).alias(f"s{i}") for i in range(len(centroids[0]))]
    found = rows.withColumn("cluster", nearest(centroids)["cluster"]).groupBy("cluster").agg(F.count("*").alias("n"), *sums)
    out = list(centroids)
    for r in found.collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(len(centroids[0]))]
    return out


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, width: int = DIMENSIONS, seed: int = SEED) -> Clustering:
    """Assign every vector of (vec_id, embedding) to one of k centroids after the given number of rounds."""
    rows = written(integer_vectors(vectors, scale, width), "centroid-vectors")
    centroids = first_centroids(rows, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids = moved(rows, centroids)
    if not centroids:
        return Clustering([], rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")))
    near = rows.select("vec_id", nearest(centroids).alias("near"))
    return Clustering(centroids, written(near.select("vec_id", "near.cluster", "near.distance"), "centroid-assigned"))


def with_inertia(found: Clustering) -> DataFrame:
    """The assigned vectors with the sums of distances of their cluster and of all, and the digest of their centroid."""
    sums = found.assigned.groupBy("cluster").agg(F.try_sum("distance").alias("total"))
    by_cluster = {r["cluster"]: r["total"] for r in sums.collect()}
    total = None if None in by_cluster.values() else sum(by_cluster.values())
    total = None if total is None or total > LONGEST else total
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids] or [""]
    one = lambda values, kind: F.array(*[F.lit(v).cast(kind) for v in values])[F.col("cluster")]
    return found.assigned.select(
        "vec_id", "cluster", "distance",
        one([by_cluster.get(j) for j in range(len(digests))], "bigint").alias("cluster_inertia"),
        F.lit(total).cast("bigint").alias("inertia"),
        one(digests, "string").alias("centroid_sha256"),
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(cluster(read(spark, sf_dir, "embeddings", "vec_id", "embedding")))


def _steps() -> str:
    parts = []
    for r in range(ROUNDS):
        parts.append(f"""
m{r} AS MATERIALIZED (
  SELECT cluster, i, sum(q[i]) AS s, count(*) AS n
  FROM (SELECT vec_id, q, arg_min(j, d * {CENTROIDS} + j) AS cluster FROM (
    SELECT v.vec_id, v.own, v.q, c.j, list_sum([(x - c.q[i]) * (x - c.q[i]) FOR x, i IN v.q])::HUGEINT AS d FROM v, c{r} AS c) GROUP BY own, vec_id, q),
    range(1, {DIMENSIONS + 1}) AS t(i)
  GROUP BY cluster, i
),
c{r + 1} AS MATERIALIZED (
  SELECT c.j, coalesce(any_value(m.q), any_value(c.q)) AS q
  FROM c{r} AS c LEFT JOIN (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS q FROM m{r} GROUP BY cluster) AS m ON m.cluster = c.j
  GROUP BY c.j
),""")
    return "".join(parts)


SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS own, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), q) - 1 AS j, q FROM v
  ORDER BY j LIMIT {CENTROIDS}
),{_steps()}
near AS MATERIALIZED (
  SELECT own, vec_id, arg_min(j, d * {CENTROIDS} + j)::INTEGER AS cluster, min(d)::BIGINT AS distance FROM (
    SELECT v.vec_id, v.own, c.j, list_sum([(x - c.q[i]) * (x - c.q[i]) FOR x, i IN v.q])::HUGEINT AS d FROM v, c{ROUNDS} AS c)
  GROUP BY own, vec_id
)
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
  sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM near JOIN c{ROUNDS} AS c ON c.j = near.cluster
"""
