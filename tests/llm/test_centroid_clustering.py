import hashlib
import math
import random

import duckdb
import pytest

from tessera.llm import centroid_clustering

INF, NAN = float("inf"), float("nan")


def plain(vectors, dimension, clusters, rounds, scale):
    """Lloyd's rounds in plain Python."""
    kept = [(k, [math.floor(scale * x) for x in v]) for k, v in vectors if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:clusters]]
    best = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(best(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if i in groups else c for i, c in enumerate(centroids)]
    done = [(k, *best(v)) for k, v in kept]
    own = [sum(d for _, d, c in done if c == i) for i in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((str(k), c, d, own[c], sum(own), digest[c]) for k, d, c in done))


def rows(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.fixture(scope="module")
def vectors():
    r = random.Random(2)
    centres = [[r.uniform(-1, 1) for _ in range(5)] for _ in range(6)]
    some = [(i, [x + r.gauss(0, 0.2) for x in r.choice(centres)]) for i in range(200)]
    odd = [(300, None), (301, []), (302, [0.5] * 4), (303, [0.5] * 6), (304, [0.1, None, 0, 0, 0]), (305, [NAN, 0, 0, 0, 0]), (306, [0, 0, INF, 0, 0]), (307, [-INF, 0, 0, 0, 0])]
    return some + odd + [(None, [0.2] * 5), (5, some[5][1]), (6, [-0.3] * 5), (308, [0.0] * 5), (309, [0.0] * 5)]


@pytest.mark.parametrize("clusters,rounds", [(4, 3), (16, 3), (1, 2), (7, 0), (400, 1)])
def test_against_plain_python(spark, tmp_path, vectors, clusters, rounds):
    full = [(i, None if v is None else [None if x is None else float(x) for x in v], "a", 1, "b") for i, v in vectors]
    spark.createDataFrame(full, "vec_id long, embedding array<double>, cluster string, v int, norm string").write.parquet(str(tmp_path / "e"))
    df = centroid_clustering.clustered(spark.read.parquet(str(tmp_path / "e")), clusters=clusters, rounds=rounds, dimension=5)
    assert rows(df) == plain(vectors, 5, clusters, rounds, 64)


def test_no_vectors(spark):
    for given in ([], [(1, None)], [(1, [1.0])]):
        df = centroid_clustering.clustered(spark.createDataFrame(given, "vec_id long, embedding array<float>"))
        assert df.columns[:3] == ["vec_id", "cluster", "distance"] and df.count() == 0


def test_too_large_components_stop(spark):
    with pytest.raises(Exception, match="too large"):
        centroid_clustering.clustered(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), dimension=2).count()


def test_sql_on_the_smallest_tables(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = con.execute(centroid_clustering.ORACLE_SQL["op12_centroid_clustering"]).fetchall()
    assert rows(centroid_clustering.op12_centroid_clustering(spark, sf_dir)) == sorted((str(k), *rest) for k, *rest in want)


def test_no_python_workers(spark, sf_dir):
    plan = centroid_clustering.assigned(centroid_clustering.quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), [[0] * 64, [1] * 64])
    assert "Python" not in plan._jdf.queryExecution().toString() and "Arrow" not in plan._jdf.queryExecution().toString()
