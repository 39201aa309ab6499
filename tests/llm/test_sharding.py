import math
import struct
import zlib

import xxhash
from pyspark.sql import functions as F

from tessera.llm import sharding


def test_permutation_and_inverse(spark):
    for n in (1, 2, 3, 7, 100, 1009):
        rows = spark.range(n).select("id", sharding.permuted(F.col("id"), n, 5).alias("p"))
        rows = rows.withColumn("back", sharding.permuted(F.col("p"), n, 5, back=True)).collect()
        assert sorted(r.p for r in rows) == list(range(n))
        assert all(r.back == r.id for r in rows)


def test_shards_are_even_and_gapless(table):
    docs = table([(i % 90, f"text {i % 40}") for i in range(203)] + [(None, None), (None, None), (5, "é")])
    rows = sharding.shard_table(docs, 7).collect()
    n = {}
    for r in rows:
        n.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == 206 and max(map(len, n.values())) - min(map(len, n.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in n.values())
    (e,) = [r for r in rows if r.text_crc32 == zlib.crc32("é".encode())]
    assert e.size == 18
    assert [r.size for r in rows if r.doc_id is None] == [16, 16]
    again = sharding.shard_table(docs.repartition(5), 7).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert sharding.shard_table(docs.filter("doc_id > 1000"), 7).count() == 0


def test_written_shards(table, spark, tmp_path):
    docs = table([(i, f"text {i}") for i in range(50)] + [(3, "text 3")])
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 51 and back.select("shard", "slot").distinct().count() == 51


def plain_permutation(n, seed):
    """The network in plain Python: six rounds over mixed radices, walked until below n."""
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)

    def value(half, j, radix):
        h = 42
        for form, x in (("<q", half), ("<q", seed), ("<i", j)):
            h = xxhash.xxh64_intdigest(struct.pack(form, x), h)
        return (h - (1 << 64) if h >> 63 else h) % radix

    def once(v):
        left, right = v % a, v // a
        for j in range(1, 7):
            if j % 2:
                left = (left + value(right, j, a)) % a
            else:
                right = (right + value(left, j, b)) % b
        return right * a + left

    def walk(v):
        v = once(v)
        while v >= n:
            v = once(v)
        return v

    return [walk(i) for i in range(n)]


def test_places_match_plain_python(table):
    docs = table([(i * 7 % 101, f"text {i}") for i in range(101)] + [(1000, "long " * 100_000), (1001, None)])
    where = plain_permutation(103, 0)
    rows = sorted(sharding.shard_table(docs, 7).collect(), key=lambda r: r.row_number)
    assert [r.row_number for r in rows] == list(range(103))
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    assert [(r.shard, r.slot) for r in rows] == [(p % 7, p // 7) for p in where]
    assert [r.size for r in rows if r.doc_id >= 1000] == [500_016, 16]


def test_written_shards_keep_every_column(spark, tmp_path):
    """Columns of the names that the writer uses inside, or writes, come back as they were."""
    rows = [(i % 5, f"text {i % 3}", 100 + i, f"k{i}", f"n{i}", i * 2, "z") for i in range(40)] + [(None, None, 1, "k", "n", 2, None)] * 3
    spark.createDataFrame(rows, "doc_id long, text string, shard int, _key string, _n string, slot int, `a.b` string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    names = sharding.write_shards(docs, str(tmp_path / "out"), 4)
    assert names == ("shard_", "slot_")
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select(*[f"`{c}`" for c in docs.columns]).collect())) == sorted(map(str, docs.collect()))
    assert back.select(*names).distinct().count() == 43


def test_walks_end_for_every_count(spark):
    """Counts with the most points above them, forth and back."""
    for n in (10, 26, 37, 101, 1000, 4097):
        rows = spark.range(n).select("id", sharding.permuted(F.col("id"), n, 3).alias("p"))
        rows = rows.withColumn("back", sharding.permuted(F.col("p"), n, 3, back=True)).collect()
        assert sorted(r.p for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)
