"""Tables over the order lines: a file split is never grouped where it is read."""

import datetime

from pyspark.sql import functions as F

from placewright import standin
from placewright.operators import cards

SCHEMA = (
    "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double,"
    " l_tax double, l_returnflag string, l_linestatus string, l_shipdate date"
)


def line(order, number, part, quantity=1.0, flag="A"):
    return (order, number, part, 3, quantity, 10.0, 0.0, 0.0, flag, "F", datetime.date(2026, 1, 1))


def write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_smallest_row_of_each_pair(spark, tmp_path):
    rows = [line(1, 1, 9), line(1, 1, 7), line(1, 2, 5), line(None, 1, 4), line(None, 1, 2), line(None, None, 1), line(1, 2, None)]
    found = standin.table(spark, write(spark, tmp_path, rows), "li").select("l_orderkey", "l_linenumber", "l_partkey").collect()
    # NULL comes first, as a value of a struct.
    assert sorted(map(tuple, found), key=str) == sorted([(1, 1, 7), (1, 2, None), (None, 1, 2), (None, None, 1)], key=str)


def test_lines_are_dealt_before_they_are_grouped(spark, tmp_path):
    rows = standin.table(spark, write(spark, tmp_path, [line(1, 1, 9)]), "m")
    plan = plan_of(rows)
    # The rows are dealt below the aggregate, so that none of it runs over a split of the file.
    assert plan.index("Aggregate") < plan.index("RepartitionByExpression") < plan.index("Relation")


def test_tables_of_one_written_copy(spark, tmp_path):
    sf = write(spark, tmp_path, [line(1, 1, 9), line(1, 1, 7), line(1, 2, 50), line(None, 3, 4)])
    made = standin.line_tables(spark, sf, "p", "m", "t")
    for name, rows in made.items():
        assert "Aggregate" not in plan_of(rows)
        one = standin.table(spark, sf, name)
        assert rows.columns == one.columns
        assert sorted(map(str, rows.collect())) == sorted(map(str, one.collect()))


def test_nested_lists_join_their_parents_where_they_are(spark):
    children = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "key string, id long")
    parents = spark.createDataFrame([("a",), ("c",)], "key string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nested = cards.nest(children, "key", ["id"], F.col("id"))
        made = cards.attach(parents, "key", {"ids": nested})
        assert sorted((r.key, r.part, tuple(r.ids)) for r in made.collect()) == [("a", 0, (1, 2)), ("c", 0, ())]
        plan = parents.join(nested, "key")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2  # the children by key, once, and the parents
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
