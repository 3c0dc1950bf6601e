"""What joins deal, and what they leave on disk."""

import pytest

from placewright.operators import facts, joins, quality
from placewright.session import settle


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


def files_shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_what_a_settled_table_shuffled_is_removed(spark):
    before = files_shuffled(spark)
    assert settle(spark.range(1000).repartition(3, "id")).count() == 1000
    left = {name.split("_")[1] for name in files_shuffled(spark) - before}
    # The count's own shuffle may still be there, not that of the table.
    assert len(left) <= 1
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


@pytest.mark.parametrize("how", ["left", "left_anti"])
@pytest.mark.parametrize("dealt", [False, True])
def test_stored_rows_without_a_reference_are_not_dealt(spark, unbroadcast, how, dealt):
    rows = spark.createDataFrame([(f"r{k}", None if k % 4 else f"f{k % 8}") for k in range(400)], "id string, own string")
    others = spark.createDataFrame([("f0", 1), ("f0", 2), (None, 3)], "own string, n long")
    found = joins.join_stored(rows, others, "own", how, dealt)
    assert rows_of(found.select(*sorted(found.columns))) == rows_of(rows.join(others, "own", how).select(*sorted(found.columns)))
    plan = plan_of(found)
    assert "Union" in plan and plan.count("Exchange hashpartitioning") == 2


def test_owner_by_the_first_stated_subject(spark, unbroadcast):
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    bundle = {
        "facility": frame([("f1",)], "facility_id string"),
        "course": frame([("c1", "f1"), ("c2", None), ("c2", "f2")], "course_id string, facility_id string"),
        "round_option": frame([("r1", None, "c1"), ("r2", "f3", None)], "round_id string, facility_id string, course_id string"),
        "tee_set": frame([("t1", "c1", "r2"), ("t2", "c2", "r1"), ("t3", "", "r2"), ("t4", None, None), ("t5", "none", "r1")], "tee_id string, course_id string, round_id string"),
    }
    found = facts.owners(bundle, ["round_option", "tee_set"])
    want = {("r1", "f1"), ("r2", "f3"), ("t1", "f1"), ("t2", None), ("t2", "f2"), ("t3", "f3"), ("t4", None), ("t5", None)}
    assert {(r.id, r.facility_id) for r in found.collect()} == want and found.count() == len(want)
    # Each kind is written as it is resolved; nothing is left to deal.
    assert "Exchange" not in plan_of(found)


def test_only_facts_in_question_meet_the_membership(spark, unbroadcast):
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    bundle = {
        "course": frame([("c1", "f1"), ("c2", "f2"), ("c3", "f1")], "course_id string, facility_id string"),
        "round_option": frame([("r1", "f1", None), ("r2", None, "c3")], "round_id string, facility_id string, course_id string"),
        "fact_group": frame([("g1", None, "c1"), ("g2", "f2", None)], "group_id string, facility_id string, course_id string"),
        "source_observation": frame([("o1", "g1", None), ("o2", "g2", None), ("o3", None, "f1"), ("o4", None, None)], "observation_id string, retained_group_id string, retained_facility_id string"),
    }
    belongs = frame([("r1", "c1"), ("r2", "c3")], "round_id string, course_id string")
    facts_of = [
        ("own", "o1", None, "c1", None), ("other course", "o1", None, "c3", None), ("no course", "o1", "f1", None, None), ("its round", "o1", None, None, "r1"),
        ("another round", "o1", None, None, "r2"), ("group", "o2", "f2", None, None), ("group of another", "o2", None, "c1", None), ("retained", "o3", "f1", None, None),
        ("retained of another", "o3", "f2", None, None), ("about nothing", "o4", "f9", None, None), ("no observation", None, "f9", None, None),
    ]
    subjects = frame(facts_of, "id string, observation_id string, facility_id string, course_id string, round_id string")
    found = quality.check_observation_scope(subjects, bundle, belongs)
    assert {r.id for r in found.collect()} == {"other course", "no course", "another round", "group of another", "retained of another"}
    # Two tables of ids are left to join.
    assert plan_of(found).count("SortMergeJoin") == 1
