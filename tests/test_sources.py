import gzip
import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import checked, tables
from tessera.streaming import upserts

SCHEMA = T.StructType([T.StructField("code", T.StringType()), T.StructField("n", T.LongType()), T.StructField("x", T.DoubleType())])


def test_text_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code,n,x\n06,5,1.5\n07,bad,2\n")
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("code,n,x\n08,1,\n")
    (tmp_path / "c.tsv").write_text("code\tn\tx\n09\t3\t4\n---\nTotal\n")
    got = tables.read_text_table(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv.gz")], SCHEMA)
    assert sorted(map(tuple, got.collect()), key=str) == [("06", 5, 1.5), ("07", None, 2.0), ("08", 1, None)]
    tsv = tables.without_trailer(tables.read_text_table(spark, str(tmp_path / "c.tsv"), SCHEMA, "tsv"), "code", r"^\d{2}$")
    assert [tuple(r) for r in tsv.collect()] == [("09", 3, 4.0)]
    assert tables.read_text_table(spark, str(tmp_path / "a.csv"), SCHEMA, columns=["n"]).columns == ["n"]


def test_formats_by_name(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "k int, v string").write.parquet(str(tmp_path / "p"))
    (tmp_path / "j.json").write_text('{"k": 2, "w": true}\n')
    out = tables.read_any(spark, {"parquet": [str(tmp_path / "p")], "json": [str(tmp_path / "j.json")]})
    assert set(out.columns) == {"k", "v", "w"} and out.count() == 2


def test_series_payload(spark):
    payload = '{"Results": {"series": [{"seriesID": "LAUCN0000000006037003", "data": [{"year": "2020", "period": "M13", "value": "9.5"}, {"year": "2020", "period": "M01", "value": "1"}]}]}}'
    out = tables.series_rows(spark.createDataFrame([(payload,)], "p string"), "p").collect()
    assert [tuple(r) for r in out] == [("LAUCN0000000006037003", 2020, 9.5)]


def test_year_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "panel")
    tables.write_years(spark.createDataFrame([(2019, 1), (2020, 1)], "year int, v int"), path)
    tables.write_years(spark.createDataFrame([(2020, 2), (2021, 2)], "year int, v int"), path)
    assert sorted((r.year, r.v) for r in spark.read.parquet(path).collect()) == [(2019, 1), (2020, 2), (2021, 2)]
    old, new = spark.createDataFrame([(2019, 1), (2020, 1)], "year int, v int"), spark.createDataFrame([(2020, 2)], "year int, v int")
    assert sorted(map(tuple, tables.upserted(old, new).collect())) == [(2019, 1), (2020, 2)]


def test_stream_replaces_years(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(2019, 1), (2020, 1)], "year int, v int").coalesce(1).write.parquet(source)
    query = upserts.replace_years(spark.readStream.schema("year int, v int").parquet(source), out, str(tmp_path / "check"))
    query.processAllAvailable()
    spark.createDataFrame([(2020, 5)], "year int, v int").coalesce(1).write.mode("append").parquet(source)
    query.processAllAvailable()
    query.stop()
    assert sorted((r.year, r.v) for r in spark.read.parquet(out).collect()) == [(2019, 1), (2020, 5)]


def test_manifest_and_checksums(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_bytes(b"abc")
    assert [(r.name, r.extension, r.length) for r in tables.manifest(spark, str(tmp_path / "d")).collect()] == [("a.txt", "txt", 3)]
    assert tables.checksums(spark, str(tmp_path / "d")).first().sha256 == hashlib.sha256(b"abc").hexdigest()


def test_gates(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match="missing columns: x"):
        tables.require_columns(df, ["id", "x"])
    assert tables.with_optional(df, "y", 3).first().y == 3
    reg = spark.createDataFrame([("a", "sample", 1), ("a", "real", 2), ("b", "sample", 1)], "k string, mode string, fetched int")
    out = tables.with_provenance(spark.createDataFrame([("a", None), ("b", "real")], "k string, mode string"), reg, "k")
    assert sorted(map(tuple, out.collect())) == [("a", "real"), ("b", "real")]
    last = tables.latest_records(reg, ["k"], [F.desc("fetched")])
    assert sorted((r.k, r["mode"]) for r in last.collect()) == [("a", "real"), ("b", "sample")]


def test_a_long_payload_is_parsed_once(spark, tmp_path):
    n = 20000
    rows = [{"a": str(i), "b": f"x{i}"} for i in range(n)]
    layouts = {"list": rows, "rows": {"rows": rows}, "lists": {"a": [r["a"] for r in rows], "b": [r["b"] for r in rows][:-1]}, "empty": {"a": []}, "none": 7}
    for name, value in layouts.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    start = time.monotonic()
    got = checked.read_json_payloads(spark, [str(tmp_path)], ["a", "b"]).groupBy().agg(F.count("*"), F.count("b"), F.count_distinct("a"), F.sum(F.col("a").cast("long"))).first()
    assert tuple(got) == (3 * n, 3 * n - 1, n, 3 * n * (n - 1) // 2)
    # a parse for each record took minutes
    assert time.monotonic() - start < 30
