"""Digests written at once from sorted fields, and rules that are evaluated once."""

from pyspark.sql import functions as F

from placewright.functions import canon
from placewright.operators import boundary, reconcile

ODD = """select * from values
 (1, 'a"\\\\é', cast('NaN' as double), date'2020-01-02', array(named_struct('z', 1.0d, 'a', 'x'), null), named_struct('b', cast(null as string), 'a', 2)),
 (2, null, -0.0d, null, null, null), (3, '', 1e10d, null, array(), named_struct('b', 'q', 'a', null)), (4, 'x', 0.1d, null, array(named_struct('z', 1e-5d, 'a', null)), null),
 (5, 'x', 100.0d, null, null, null), (6, 'x', 1e7d, null, null, null), (7, 'x', -12.5d, null, null, null), (8, 'x', 123456789012.25d, null, null, null) as t(z, s, d, dt, arr, st)"""


def _plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_fast_digests_are_the_canonical_ones(spark):
    rows = spark.sql(ODD)
    assert "parse_json" not in _plan(rows.select(canon.rows_digest(rows)))
    assert rows.where(canon.row_digest(*rows.columns) != canon.rows_digest(rows)).count() == 0
    # Types that to_json writes in another way take the general form.
    other = spark.sql("select 1.50 as m, map('b', 1, 'a', 2) as x")
    assert other.where(canon.row_digest(*other.columns) != canon.rows_digest(other)).count() == 0


def test_table_digest_adds_up_tasks(spark):
    rows = spark.range(1000).select(F.col("id"), F.concat(F.lit("n"), "id").alias("name"))
    digests = rows.select(canon.row_digest("id", "name").alias("digest"))
    whole = digests.agg(*canon.lane_sums()).select(canon.lanes_digest().alias("x")).first()["x"]
    for parts in (1, 7):
        found = canon.table_digest(rows.repartition(parts)).first()
        assert (found["table_sha256"], found["row_count"]) == (whole, 1000)
    assert canon.table_digest(rows.where("false")).first()["row_count"] == 0


def test_only_rows_that_differ_are_digested(spark):
    before = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 3.0), ("c", None), (None, 4.0)], "k string, v double")
    after = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("d", 5.0), (None, 4.0)], "k string, v double")
    found = reconcile.changed_rows(before, after, "k")
    assert "parse_json" not in _plan(found)
    listed = sorted((r["k"] or "", r["change"]) for r in found.collect())
    assert listed == [("", "added"), ("", "removed"), ("b", "changed"), ("c", "removed"), ("d", "added")]
    maps = spark.sql("select 'a' as k, map('x', 1, 'y', 2) as m"), spark.sql("select 'a' as k, map('y', 2, 'x', 1) as m")
    assert reconcile.changed_rows(*maps, "k").count() == 0


def test_a_text_is_judged_once(spark):
    rows = spark.createDataFrame([("1", "see /home/op/x"), ("2", "a quiet place"), ("3", None)], "id string, name string")
    found = boundary.typed_violations(rows, "id", ".courses#")
    # No filter searches the texts once more.
    assert not [line for line in _plan(found).splitlines() if line.lstrip("+-: ").startswith("Filter") and "RLIKE" in line]
    assert [(r["id"], r["rule"]) for r in found.collect()] == [("1", "private text")]
    strict = rows.select(boundary.private_path(F.col("name"), F.lit(False)).alias("p")).collect()
    assert [r["p"] for r in strict] == [True, False, None]
