"""Withholding reviewed identities together with everything that depends on them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .joins import join_known

_REFERENCES = ["facility_id", "course_id", "component_id", "round_id", "destination_id"]
_KEYS = {
    "component": "component_id", "round_option": "round_id", "round_component": "member_id", "tee_set": "tee_id", "alias": "alias_id",
}


def _named(ids: DataFrame, column: str) -> DataFrame:
    return ids.withColumnRenamed("id", column)


def _dependents(rows: DataFrame, key: str, withheld: DataFrame) -> DataFrame:
    """Ids of rows that refer to anything withheld; one join for all reference columns."""
    columns = [c for c in _REFERENCES if c in rows.columns and c != key]
    references = F.array_compact(F.array(*columns))
    spread = rows.select(F.col(key).alias("own_id"), F.explode(references).alias("id"))
    return spread.join(withheld, "id", "left_semi").select(F.col("own_id").alias("id"))


def withhold(bundle: dict, reviewed: DataFrame) -> dict:
    """The bundle without the reviewed ids and their dependents; stored facts are untouched.

    `reviewed` has one column, id. The dependence tree has fixed depth: facility, course,
    component or round, then member, tee and alias. A round falls only through its own facility
    or course; a member row falls with its round, component or course.
    """
    ids = reviewed.select("id").distinct()
    facilities, courses = bundle["facility"], bundle["course"]
    known_as = F.array_compact(
        F.array(*[c for c in ("facility_id", "released_id", "osm_identity") if c in facilities.columns])
    )
    matched = (
        facilities.select(F.col("facility_id").alias("own_id"), F.explode(known_as).alias("id"))
        .join(ids, "id", "left_semi")
        .select(F.col("own_id").alias("id"))
    )
    removed = matched.unionByName(ids).distinct()
    fallen = courses.join(_named(removed, "facility_id"), "facility_id", "left_semi").select(F.col("course_id").alias("id"))
    # The id lists feed every table below, so each is computed once.
    places = settle(removed.withColumn("place", F.lit(True)).unionByName(fallen.withColumn("place", F.lit(False))), "withheld")
    removed, first = places.where("place").select("id"), places.select("id").distinct()
    parts = [_dependents(bundle[t], _KEYS[t], first) for t in ("component", "round_option")]
    second = settle(first.unionByName(parts[0]).unionByName(parts[1]).distinct(), "withheld")

    result = dict(bundle)
    result["facility"] = facilities.join(_named(removed, "facility_id"), "facility_id", "left_anti")
    result["course"] = join_known(courses, _named(removed, "facility_id"), "facility_id", "left_anti")
    for table, key in _KEYS.items():
        gone = second
        if table not in ("component", "round_option"):
            gone = second.unionByName(_dependents(bundle[table], key, second))
        result[table] = bundle[table].join(_named(gone, key), key, "left_anti")
    if "destination" in bundle:
        result["destination"] = bundle["destination"].join(second, "id", "left_anti")
    return result
