"""What a reconciliation run deals, gathers and broadcasts."""

import pytest
from pyspark.sql import functions as F

from placewright import standin
from placewright.functions import canon
from placewright.operators import cards, reconcile
from placewright.plans import reconciles


def plan_of(df):
    """The plan as it is before it runs."""
    return df.select("*")._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def unbroadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def rows_of(df):
    return sorted(map(repr, df.collect()))


VERSION = "id string, n long, name string"


def test_receipt_deals_each_version_once(spark, unbroadcast, tmp_path):
    before = [("a", 1, "x"), ("b", 2, "y"), ("b", 3, "z"), ("c", 4, None), (None, 5, "u"), (None, 6, "v")]
    after = [("a", 1, "x"), ("b", 2, "y"), ("c", 4, "new"), ("d", 7, "w"), (None, 5, "u")]
    sides = []
    for name, rows in (("before", before), ("after", after)):
        spark.createDataFrame(rows, VERSION).write.parquet(f"{tmp_path}/{name}")
        sides.append(spark.read.parquet(f"{tmp_path}/{name}"))
    record = reconcile.receipt(*sides, "id")
    # As by changed_rows and a join to the rows as they were, repeated and unknown keys included.
    kept = sides[0].select("id", F.struct(*sides[0].columns).alias("before_row"))
    assert rows_of(record) == rows_of(reconcile.changed_rows(*sides, "id").join(kept, "id", "left"))
    assert {(r.id, r.change) for r in record.collect()} == {("b", "changed"), ("c", "changed"), ("d", "added"), (None, "removed"), (None, "added")}
    assert plan_of(record).count("Exchange hashpartitioning") == 2


def test_lines_of_a_whole_run_are_dealt_once(spark, sf, monkeypatch):
    plans = []
    monkeypatch.setattr(reconciles, "settle", lambda rows, label: plans.append(plan_of(rows)) or rows)
    monkeypatch.setattr(reconciles.reconcile, "apply", lambda *a, **k: None)
    monkeypatch.setattr(reconciles.reconcile, "written", lambda before, result: before)
    tables, _ = reconciles.whole_run(spark, sf)
    for name, short in (("component", "p"), ("round_component", "m"), ("tee_set", "t")):
        assert tables[name].columns == standin.table(spark, sf, short).columns
        assert "Exchange" not in plans[list(tables).index(name)]


def test_first_columns_of_the_smallest_line(spark, sf):
    whole = standin._lines(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    assert rows_of(standin._lines(spark, sf, "l_suppkey")) == rows_of(whole)
    assert rows_of(standin._lines(spark, sf, "")) == rows_of(whole.select("l_orderkey", "l_linenumber"))
    assert "l_shipdate" not in plan_of(standin.table(spark, sf, "m"))


def test_lists_that_nobody_looks_at_are_not_gathered(spark):
    children = spark.createDataFrame([("a", 2, None), ("a", 1, "x"), ("b", 3, "y")], "key string, id long, name string")
    lists = {"ids": (children, ["id"], F.struct("id", "name")), "names": (children.where("id < 3"), ["id"], F.col("name"))}
    nested = cards.nest_lists("key", lists)
    found = {r.key: ([tuple(x) for x in r.ids], r["names"]) for r in nested.collect()}
    assert found == {"a": ([(1, "x"), (2, None)], ["x", None]), "b": ([(3, "y")], None)}
    read = plan_of(nested.select("key", "names")).split("ReadSchema:")[1]
    assert "i_names" in read and "i_ids" not in read


def test_courses_meet_affected_facilities_in_one_join(spark, unbroadcast):
    courses = spark.createDataFrame([("c1", "f1", "old"), ("c2", "f2", "old"), ("c3", None, "old"), ("c4", "f9", "old")], "course_id string, facility_id string, facility_name string")
    facilities = spark.createDataFrame([("f1", "One"), ("f2", "Two")], "facility_id string, name string")
    affected = spark.createDataFrame([("f1",), ("f9",)], "facility_id string")
    found = reconcile.refresh_children(courses, facilities, affected)
    assert {r.course_id: r.facility_name for r in found.collect()} == {"c1": "One", "c2": "old", "c3": "old", "c4": None}
    assert plan_of(found).count("SortMergeJoin") == 2  # what the affected show, and the courses


def test_lanes_are_the_numbers_of_the_digests(spark):
    rows = spark.range(300).select("id", F.concat(F.lit("n"), "id").alias("name"))
    digests = [r.d for r in rows.select(canon.rows_digest(rows).alias("d")).collect()]
    lanes = [sum(int(d[8 * k : 8 * k + 8], 16) for d in digests) for k in range(8)]
    assert [int(x) for x in canon.table_lanes(rows).first()] == [300, *lanes]


def test_a_run_broadcasts_no_table(spark, sf):
    _, result = reconciles.reconciled(spark, sf)
    back = reconcile.restored(result)
    for name in ("course", "alias", "round_option"):
        assert "BroadcastHashJoin" not in plan_of(result["tables"][name])
        assert "BroadcastHashJoin" not in plan_of(back[name])
