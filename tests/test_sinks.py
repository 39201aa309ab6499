"""Checked readers, payloads, gates, dated policies, curves and the release bundle on small given cases."""

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import policies, release, scenario
from tessera.sources import checked, gates

SCHEMA = T.StructType([T.StructField("code", T.StringType()), T.StructField("n", T.LongType()), T.StructField("x", T.DoubleType())])


def test_rejected_rows_are_kept_and_counted(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code,n,x\n06,5,1.5\n07,bad,2\n08,1\n09,1,2,3\n")
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("code,n,x\n10,1,\n")
    rows = checked.read_checked(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv.gz")], SCHEMA)
    assert {tuple(r) for r in checked.accepted(rows).collect()} == {("06", 5, 1.5), ("10", 1, None)}
    assert {(r.file, r.rows, r.rejected) for r in checked.rejected_by_file(rows).collect()} == {("a.csv", 4, 3), ("b.csv.gz", 1, 0)}
    assert {r[checked.CORRUPT] for r in rows.collect() if r[checked.CORRUPT]} == {"07,bad,2", "08,1", "09,1,2,3"}
    (tmp_path / "c.tsv").write_text("code\tn\tx\n06\t1\t2\n---\nTotal\n")
    assert [tuple(r) for r in checked.accepted(checked.read_checked(spark, str(tmp_path / "c.tsv"), SCHEMA, "tsv")).collect()] == [("06", 1, 2.0)]
    few = checked.read_checked(spark, str(tmp_path / "a.csv"), SCHEMA, columns=["code"])
    assert few.columns == ["code", checked.CORRUPT, "file"] and len([r for r in few.collect() if r[checked.CORRUPT]]) == 3


def test_formats_by_extension(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code,n\na,1\n")
    with gzip.open(tmp_path / "b.TSV.gz", "wt") as f:
        f.write("n\tcode\tother\n2\tb\tz\n")
    (tmp_path / "c.json").write_text('[{"code": "c", "n": 3, "x": 1.5},\n {"code": "c2"}]')
    (tmp_path / "d.json").write_text('{"rows": [{"code": "d", "n": "4"}], "note": "x"}')
    (tmp_path / "e.json").write_text('{"code": ["e", "e2"], "n": [5]}')
    (tmp_path / "f.json").write_text("not json")
    spark.createDataFrame([("f", 6)], "code string, n int").write.parquet(str(tmp_path / "g.parquet"))
    names = ["a.csv", "b.TSV.gz", "c.json", "d.json", "e.json", "f.json", "g.parquet"]
    out = checked.read_by_extension(spark, [str(tmp_path / n) for n in names], SCHEMA)
    assert {tuple(r) for r in out.collect()} == {("a", 1, None), ("b", 2, None), ("c", 3, 1.5), ("c2", None, None), ("d", 4, None), ("e", 5, None), ("e2", None, None), ("f", 6, None)}
    with pytest.raises(ValueError, match="no reader"):
        checked.read_by_extension(spark, ["x.xlsx"], SCHEMA)


def test_series_measures(spark):
    series = lambda i, *rows: {"seriesID": i, "data": [dict(zip(("year", "period", "value"), r)) for r in rows]}
    payload = {"Results": {"series": [
        series("LAUCN060370000000003", ("2020", "M13", "9.5"), ("2020", "M12", "1"), ("-", "M13", "4")), series("LAUCN060370000000004", ("2020", "M13", "12"), ("2020", "M13", "13")),
        series("LAUST060000000000006", ("2020", "M13", "100")), series("LAUMT060000000000006", ("2020", "M13", "7")), series("", ("2020", "M13", "7")),
    ]}}
    df = spark.createDataFrame([(json.dumps(payload),), ("broken",), (None,)], "p string")
    got = {(r.geography, r.state, r.county, r.year): (r.unemployment_rate, r.unemployed, r.labour_force) for r in checked.series_measures(df, "p").collect()}
    assert got == {("county", "06", "06037", 2020): (0.095, 12.0, None), ("state", "06", None, 2020): (None, None, 100.0)}
    assert ("county", "06", "06037", 2018) in {tuple(r)[:4] for r in checked.series_measures(df, "p", 2018).collect()}


def test_a_refused_artifact_stops_the_job(spark):
    required = spark.createDataFrame([("a", "pull a"), ("b", "pull b"), ("c", "pull c"), ("d", "pull d")], "artifact string, command string")
    provenance = spark.createDataFrame([("a", "real"), ("b", "sample"), ("c", None)], "artifact string, mode string")
    assert {tuple(r) for r in gates.refusals(required, provenance, "artifact").collect()} == {("b", "pull b", "sample"), ("c", "pull c", "unlabelled"), ("d", "pull d", "missing")}
    data = spark.range(5)
    with pytest.raises(Exception, match=r"artifacts are refused: b is sample: run pull b; c is unlabelled: run pull c; d is missing: run pull d"):
        gates.require_real(data, required, provenance, "artifact").count()
    assert gates.require_real(data, required.filter("artifact = 'a'"), provenance, "artifact").count() == 5
    assert gates.require_real(data, required.limit(0), provenance, "artifact").count() == 5


def test_dated_policies_overlap_and_end(spark):
    rows = [
        (1, "copay", 10.0, 2010, 2012, None, 1), (1, "copay", 20.0, 2012, 2999, "all", 2), (1, "copay", 30.0, 2011, 2011, "twins", 3),
        (1, "rate", 5.0, 2014, 2010, None, 4), (1, "rate", 6.0, 2011, None, "", 5), (2, "rate", 7.0, None, 2012, None, 6), (1, "copay", 40.0, 2012, 2999, "all", 7),
    ]
    df = spark.createDataFrame(rows, "place int, control string, value double, start int, end int, family string, row int").withColumn("sheet", F.lit(2014))
    out = policies.policy_years(df, ["place"], "control", "value", ["copay", "rate"], "start", "end", "sheet", ["family"], "row", 2010, 2013)
    assert {(r.place, r.year): (r.copay, r.rate, r.n_overlaps, r.n_general) for r in out.collect()} == {
        (1, 2010): (10.0, None, 0, 1), (1, 2011): (10.0, 6.0, 1, 2), (1, 2012): (40.0, 6.0, 1, 2), (1, 2013): (40.0, 6.0, 1, 2),
    }


def test_curves_meet_at_the_base(spark):
    df = spark.createDataFrame([(1, 100.0, 50.0, 0.4, 2.0, 100.0, 104.0)], "k int, base_price double, market double, demand_elasticity double, supply_elasticity double, low double, high double")
    out = scenario.curve_points(df, ["k"], [(0.5, "high"), (0.0, "low")]).collect()
    demand, supply = ({r.place: r for r in out if r.kind == kind} for kind in ("demand", "supply"))
    assert len(demand) == len(supply) == 60 and demand[0].price == pytest.approx(92.0) and demand[59].price == pytest.approx(104 * 1.08)
    assert all(demand[i].quantity == pytest.approx(50 * (demand[i].price / 100) ** -0.4) and supply[i].quantity == pytest.approx(50 * (supply[i].price / 100) ** 2) for i in range(60))
    assert {(r.alpha, r.price, round(r.quantity, 6)) for r in out if r.kind == "alpha"} == {(0.5, 104.0, 54.08), (0.0, 100.0, 50.0)}


def test_local_scenario(spark):
    base = spark.createDataFrame([(1, 2010, 100.0, 10.0, 5.0, 0.4), (1, 2010, 100.0, 10.0, 5.0, 0.4), (2, 2010, 300.0, 30.0, 15.0, 0.4), (3, 2010, 1.0, 1.0, 1.0, 0.4), (2, 2011, None, 1.0, 1.0, 0.4)], "geo int, year int, base_price double, market double, unpaid double, demand_elasticity double")
    treated, slope = spark.createDataFrame([(1,), (2,)], "geo int"), lambda v: spark.createDataFrame([(v,)], "supply_elasticity double")
    out = {r.alpha: r for r in scenario.local_scenario(base, treated, slope(1.6), "geo").collect()}
    assert out[0.0].price == 200.0 and out[1.0].price == pytest.approx(200 * 1.5**0.5, rel=1e-6) and out[0.5].n_rows == 2 and out[1.0].quantity == pytest.approx(20 * 1.5**0.8, rel=1e-6)
    for bad in (-1.0, None):
        assert {(r.status, r.price) for r in scenario.local_scenario(base, treated, slope(bad), "geo").collect()} == {("no_supply_curve", None)}
    assert {r.status for r in scenario.local_scenario(base, treated.limit(0), slope(1.0), "geo").collect()} == {"no_treated_rows"}


def test_bundle_index(spark, tmp_path):
    folder = str(tmp_path / "bundle")
    status = spark.createDataFrame([("a", "p", "explicit_sheet", False), ("a", "q", "proxy_share", False), ("b", "p", "explicit_sheet", True)], "component string, place string, status string, fallback boolean")
    controls = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 3.0)], "place int, x double, y double")
    support = release.support_tables(status, controls, ["x", "y"])
    assert support.columns == release.SUPPORT
    assert {tuple(r) for r in support.filter("table_name <> 'support_quality_summary'").collect()} == {
        ("support_mix_summary", "explicit", "explicit_sheet", 2, 1), ("support_mix_summary", "proxy", "proxy_share", 1, 0),
        ("policy_coverage_summary", "x", "promoted", 2, 2), ("policy_coverage_summary", "y", "sparse", 2, 1),
    }
    manifest = spark.createDataFrame([("one", "g", "csv", "main"), ("many", "g", "parquet", "main"), ("none", "g", "csv", "main")], "artifact string, group string, kind string, tier string")
    spark.range(10).repartition(3).write.parquet(f"{folder}/many")
    index = {r.artifact: r for r in release.write_bundle(spark, {"one": (spark.createDataFrame([("b", 2), ("a", 1)], "k string, v int"), ["k"])}, manifest, folder).collect()}
    assert index["one"].sha256 == hashlib.sha256(b"k,v\na,1\nb,2\n").hexdigest() and index["one"].n_bytes == 12 and index["one"].file_exists
    files = sorted((tmp_path / "bundle" / "many").glob("part-*"))
    assert index["many"].n_files == len(files) == 3 and index["many"].sha256 == hashlib.sha256("".join(hashlib.sha256(f.read_bytes()).hexdigest() for f in files).encode()).hexdigest()
    assert (index["none"].file_exists, index["none"].sha256, index["none"].n_files) == (False, "", 0)
    assert {json.loads(line)["artifact"] for f in (tmp_path / "bundle" / "_index").glob("part-*") for line in f.read_text().splitlines()} == {"one", "many", "none"}


def test_json_summaries_keep_sorted_keys(spark, tmp_path):
    from tessera.sources import tables

    path = str(tmp_path / "s")
    tables.write_json_summary(spark.createDataFrame([(2, "b", None), (1, "a", 5)], "z int, k string, m int"), path)
    lines = [line for f in (tmp_path / "s").glob("part-*") for line in f.read_text().splitlines()]
    assert sorted(lines) == ['{"k":"a","m":5,"z":1}', '{"k":"b","z":2}']
    assert sorted(map(tuple, tables.read_json_summary(spark, path, "k string, m int, new double").collect())) == [("a", 5, None), ("b", None, None)]


def test_places_come_from_any_number_of_names(spark):
    from tessera.operators import reporting

    names = spark.createDataFrame([(f"Place {i}", f"{i:02d}") for i in range(300)] + [("place 7", "99")], "name string, code string")
    rows = spark.createDataFrame([(1, "place 250 ", None, "FY2021"), (2, None, "6", "none"), (3, "elsewhere", "Place 7", "2019 and 2020"), (4, "elsewhere", None, None)], "id int, a string, b string, y string")
    out = reporting.with_place_and_year(rows, [F.col("a"), F.col("b")], [F.col("y"), F.lit("as of 2030")], names)
    assert out.columns == [*rows.columns, "place", "found_year"]
    assert {(r.id, r.place, r.found_year) for r in out.collect()} == {(1, "250", 2021), (2, "06", 2030), (3, "07", 2019), (4, None, 2030)}


def test_program_capacity_is_filled_by_level(spark, tmp_path):
    from tessera.operators import eav, panel
    from tessera.sources import tables

    df = tables.staged(spark.createDataFrame([(1, 10, 2000, 100.0), (1, 11, 2000, 50.0), (1, 11, 2001, 60.0), (2, 20, 2001, 10.0), (3, 30, 2002, 0.0)], "geo1 int, geo2 int, year int, population double"))
    slots = spark.createDataFrame([(10, 20.0), (99, 1.0)], "geo2 int, slots double")
    out = {(r.geo2, r.year): (r.slots, r.slots_source, r.capacity_share) for r in panel.with_share_fill(df, slots, "geo2").collect()}
    assert out == {(10, 2000): (20.0, "observed", 0.2), (11, 2000): (10.0, "state_year", 0.2), (11, 2001): (12.0, "state", 0.2), (20, 2001): (2.0, "national", 0.2), (30, 2002): (0.0, "national", None)}
    wide = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 5.0), (3, 3.0, None), (4, None, None)], "geo int, a double, b double")
    assert {tuple(r) for r in eav.promoted(wide, ["geo"], ["a", "b"]).collect()} == {(1, "a", 1.0), (2, "a", 2.0), (3, "a", 3.0)}
