"""The publication gate over typed nested rows, and the manifest of files."""

import pytest
from pyspark.sql import functions as F

from placewright.operators import boundary
from placewright.sources import releases

KIND = "id string, name string, holes int, address struct<city:string,lines:array<string>>, aliases array<struct<alias_id:string,name:string,tags:map<string,string>>>, deep array<array<string>>"
CLEAN = ("a", "One", 9, ("Town", ["1 Road"]), [("a-1", "Old name", {"kind": "x"})], [["p"], []])


def rows_of(spark):
    private = "/home/op/secret.txt"
    return spark.createDataFrame([
        CLEAN,
        ("b", None, None, None, None, None),
        ("c", "Two", 9, ("Town", ["1 Road", private]), [], [[], ["q", private]]),
        ("d", "Three", 9, (private, None), [("a-2", private, {"note": private, "api_key": "k"}), ("a-3", "fine", {private: "v"})], []),
    ], KIND)


def test_every_nested_text_is_walked(spark):
    found = sorted((r["id"], r["path"], r["rule"]) for r in boundary.typed_violations(rows_of(spark), "id", ".rows#").collect())
    assert [f for f in found if f[0] == "c"] == [("c", ".rows#.address.lines#", "private text"), ("c", ".rows#.deep##", "private text")]
    assert [(p, r) for i, p, r in found if i == "d"] == [
        (".rows#.address.city", "private text"), (".rows#.aliases#.name", "private text"), (".rows#.aliases#.tags./home/op/secret?txt", "private text"),
        (".rows#.aliases#.tags.api_key", "private key"), (".rows#.aliases#.tags.note", "private text"),
    ]
    assert {f[0] for f in found} == {"c", "d"}
    named = spark.createDataFrame([("a", (1, "x"))], "id string, inner struct<n:int,local_path:string>")
    assert [(r["id"], r["path"], r["rule"]) for r in boundary.typed_violations(named, "id", ".r#").collect()] == [(None, ".r#.inner.local_path", "private key")]
    assert boundary.typed_violations(named.select("inner.n"), "n", ".r#").collect() == []


def test_one_violation_publishes_nothing(spark, tmp_path):
    path, rows = str(tmp_path / "release"), rows_of(spark)
    violations, manifest = releases.publish(spark, {"rows": (rows, "id")}, None, path)
    assert manifest is None and violations.count() == 7 and not (tmp_path / "release").exists()
    licenses = spark.createDataFrame([("s-1", {"license": "CC0", "controls_reference": "k"}), ("s-2", {"odd": "x"})], "source_id string, license map<string,string>")
    clean = {"rows": (rows.where("id in ('a', 'b')"), "id")}
    violations, manifest = releases.publish(spark, clean, licenses, path)
    assert [tuple(r) for r in violations.collect()] == [("source_licenses", "s-2", "odd", "unknown license field")] and manifest is None
    violations, manifest = releases.publish(spark, clean, licenses.where("source_id = 's-1'"), path)
    assert violations.count() == 0 and {r["name"]: r["row_count"] for r in manifest.collect()} == {"rows": 2, "source_licenses": 1}
    assert spark.read.parquet(f"{path}/source_licenses").first()["license"] == {"license": "CC0"}
    assert sorted(r["id"] for r in spark.read.parquet(f"{path}/rows").collect()) == ["a", "b"]
    assert releases.restore(spark, path)[1].count() == 0 and releases.file_violations(spark, path).count() == 0
    spark.range(1).write.parquet(f"{path}/rows", mode="append")
    assert {r["rule"] for r in releases.file_violations(spark, path).collect()} == {"not pinned"}


def test_variants_are_refused(spark):
    rows = spark.sql("select 'a' as id, parse_json('{}') as value")
    with pytest.raises(ValueError):
        boundary.typed_violations(rows, "id", ".r#")
    assert boundary.typed_violations(rows.select("id", F.lit(1).alias("n")), "id", ".r#").collect() == []
