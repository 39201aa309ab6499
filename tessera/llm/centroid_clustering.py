"""Centroid clustering of integer vectors with expressions of the JVM only.

Vectors become integers floor(scale * x) once and are written to the shared
folder. A round is one scan: zip_with and aggregate give the inner product with
each literal centroid array, so the squared distance is |v|^2 - 2 v.c + |c|^2 in
exact integers; array_min over (distance, number) structs chooses the cluster,
ties going to the smaller number; column sums by cluster, combined before the
shuffle, give the next centroids. What reaches the driver is a few rows of sums
for each centroid, whatever the input; a cluster with all vectors costs no more than others.

Defined results: vectors of another length, null ones and ones with a null or
non-finite component are left out. Fewer vectors than centroids: each is one.
Equal vectors and repeated or null ids are vectors like others (of equal ids the
smaller vector is the earlier seed, null ids come last). No vector: no rows.
Components beyond 2^26 after scaling raise an error, as squared distances could
leave 64 bits. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DIMENSION, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
_LARGEST = 1 << 26
#: Columns summed in one row; more would make a method too long for the JVM to compile.
_WIDTH = 16


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """(key, v, norm): the kept vectors as integers, with the squared length."""
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("x"))
    kept = common.filter_after(rows, (F.size("x") == dimension) & finite)
    whole = F.transform("x", lambda x: F.floor(x * float(scale)))
    fits = F.forall("v", lambda x: F.abs(x) <= _LARGEST)
    checked = F.when(fits, F.col("v")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("array<long>"))
    rows = kept.select("key", whole.alias("v")).select("key", checked.alias("v"))
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    return rows.withColumn("norm", norm)


def seeds(rows: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The first centroids: the vectors with the least sha256 of ``seed:key``, in order of the hash."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    return [list(r.v) for r in rows.select(rank.alias("rank"), "v").orderBy(F.asc_nulls_last("rank"), "v").limit(clusters).collect()]


def _nearest(centroids: list[list[int]]) -> Column:
    """(distance, cluster) of the nearest centroid."""

    def squared(number: int, c: list[int]) -> Column:
        # one parsed literal list for each centroid, folded to one array literal
        literal = F.expr(f"array({', '.join(f'{x}L' for x in c)})")
        product = F.zip_with("v", literal, lambda x, y: x * y)
        inner = F.aggregate(product, F.lit(0).cast("long"), lambda s, p: s + p)
        distance = F.col("norm") - 2 * inner + F.lit(sum(x * x for x in c)).cast("long")
        return F.struct(distance.alias("distance"), F.lit(number).alias("cluster"))

    return F.array_min(F.array(*[squared(i, c) for i, c in enumerate(centroids)]))


def assigned(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``rows`` with distance and cluster."""
    return rows.withColumn("_best", _nearest(centroids)).select(*rows.columns, "_best.distance", "_best.cluster")


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: floor(sum / count) by component; one without vectors stays."""
    parts = F.explode(F.sequence(F.lit(0), F.lit((len(centroids[0]) - 1) // _WIDTH)))
    sums = [F.sum(F.get("v", F.col("part") * _WIDTH + i)).alias(f"s{i}") for i in range(_WIDTH)]
    dealt = assigned(rows, centroids).select("cluster", "v", parts.alias("part"))
    found = {(r.cluster, r.part): r for r in dealt.groupBy("cluster", "part").agg(F.count("*").alias("n"), *sums).collect()}

    def mean(number: int, j: int) -> int:
        r = found[number, j // _WIDTH]
        return r[f"s{j % _WIDTH}"] // r.n

    return [[mean(i, j) for j in range(len(c))] if (i, 0) in found else c for i, c in enumerate(centroids)]


def fitted(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> list[list[int]]:
    """The centroids after all rounds; ``rows`` are staged quantised vectors."""
    centroids = seeds(rows, clusters, seed)
    for _ in range(rounds if centroids else 0):
        centroids = moved(rows, centroids)
    return centroids


def clustered(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """Per kept vector: key, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows = common.staged(quantised(vectors, key, vector, dimension, scale))
    centroids = fitted(rows, clusters, rounds, seed)
    spark = vectors.sparkSession
    if not centroids:
        centroids = [[0] * dimension]
    done = common.staged(assigned(rows, centroids).select(F.col("key").alias(key), "cluster", "distance"))
    common.release(rows)
    sums = {r.cluster: r.d for r in done.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = [(i, sums[i], sum(sums.values()), digest[i]) for i in sums]
    side = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(side), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings of 64 finite components in 16 clusters after 3 rounds."""
    return clustered(common.read(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Lloyd's rounds as common table expressions over (row, place) pairs; the integer division rounds down."""
    down = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    text = """WITH kept AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT 16))"""
    for i in range(4):
        text += f""",
d{i} AS (SELECT rid, k, CAST(list_sum(list_transform(list_zip(kept.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept CROSS JOIN c{i}),
a{i} AS (SELECT rid, k, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, k) = 1)"""
        if i < 3:
            text += f""",
s{i} AS (SELECT k, j, sum(v[j]) AS s, count(*) AS n FROM a{i} JOIN kept USING (rid) CROSS JOIN (SELECT unnest(range(1, 65)) AS j) GROUP BY k, j),
n{i} AS (SELECT k, list({down} ORDER BY j) AS v FROM s{i} GROUP BY k),
c{i + 1} AS (SELECT c{i}.k, coalesce(n{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN n{i} USING (k))"""
    return text + """
SELECT vec_id, CAST(k AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a3 JOIN kept USING (rid) JOIN c3 USING (k)"""


QUERIES = {"op12_centroid_clustering": op12_centroid_clustering}
ORACLE_SQL = {"op12_centroid_clustering": _sql()}
