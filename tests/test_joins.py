"""Joins whose key is unknown in most rows."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from placewright.operators import links, reconcile
from placewright.operators.joins import join_known


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(k, None if k % 4 else f"f{k % 8}", None if k % 3 else "x") for k in range(4000)], "id long, own string, other string")


@pytest.mark.parametrize("on", ["own", ["own", "other"]])
@pytest.mark.parametrize("how", ["left", "left_anti"])
def test_as_a_plain_join(spark, rows, on, how):
    others = spark.createDataFrame([("f0", "x", 1), ("f0", "x", 2), ("f9", "x", 3), (None, "x", 4), (None, None, 5)], "own string, other string, n long")
    others = others.drop("other") if on == "own" else others
    names = ["id", *([] if how == "left_anti" else ["own", "n"])]
    keyed = rows.drop("other") if on == "own" else rows
    want, got = (sorted(map(repr, f.select(*names).collect())) for f in (keyed.join(others, on, how), join_known(keyed, others, on, how)))
    assert got == want


def largest(frame):
    """Rows of the largest partition."""
    return frame.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_rows_without_a_reference_are_not_one_task(spark, rows):
    mapping = spark.createDataFrame([("f0", "g0"), ("f9", "g9")], "old_id string, new_id string").hint("merge")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        renamed = links.rekey(rows, "own", mapping)
        assert largest(renamed) < 2200  # 3000 of 4000 rows have none, over 4 partitions
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert {r["own"] for r in renamed.select("own").distinct().collect()} == {"g0", "f4", None}


def test_courses_without_a_destination_are_not_one_task(spark):
    courses = spark.createDataFrame([(f"c{k}", None if k % 4 else f"f{k % 8}") for k in range(4000)], "course_id string, destination_id string")
    destinations = spark.createDataFrame([("f0",)], "id string")
    removed = spark.createDataFrame([("f0",), ("f4",)], "facility_id string")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        cleared = reconcile.clear_dangling(courses, destinations, removed)
        # Destinations are read too, or else both joins would be dropped.
        sizes = cleared.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.count("destination_id")).collect()
        assert max(r["n"] for r in sizes) < 2200  # 3000 of 4000 courses have none, over 4 partitions
        found = {r["destination_id"]: r["count"] for r in cleared.groupBy("destination_id").count().collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert found == {"f0": 500, None: 3500}


def test_tags_are_not_sent_whole_to_all_tasks(spark, sf):
    plan = entry.queries()["c07_fill_unknown_only"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
