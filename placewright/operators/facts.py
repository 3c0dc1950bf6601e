"""Observed facts and their envelopes: views, subjects, owners, counts."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..session import settle
from . import cards
from .joins import join_known, join_stored


def fact_view(domain: DataFrame, observations: DataFrame, sources: DataFrame) -> DataFrame:
    """Domain rows with their observation's envelope and the source's license, exact subject only."""
    envelope = observations.select(
        "observation_id", "source_id", "collected_on", "status", "conflict", "qualification"
    )
    origin = sources.select(
        "source_id",
        F.col("url").alias("source_url"),
        F.col("license").alias("source_license"),
        F.col("attribution").alias("source_attribution"),
    )
    return domain.join(envelope, "observation_id").join(origin, "source_id", "left")


def per_subject(view: DataFrame, key: str, limit=cards.PART_ROWS) -> DataFrame:
    """Fact ids listed under their one exact subject; nothing is inherited."""
    subject = F.coalesce("facility_id", "course_id", "round_id")
    return cards.nest(view.withColumn("subject", subject), "subject", [key], F.col(key), limit)


def credits_per_event(credits: DataFrame, parties: DataFrame, limit=cards.PART_ROWS) -> DataFrame:
    named = credits.join(parties, "party_id")
    item = F.struct("credit_id", "role", "party_id", F.col("party_name").alias("name"))
    return cards.nest(named, "event_id", ["credit_id"], item, limit)


def subject_view(domains: dict, components: DataFrame) -> DataFrame:
    """All domains as (id, observation, facility, course, round); a component stands for its course."""
    part = components.select("component_id", F.col("course_id").alias("part_course"))
    none = F.lit(None).cast("string")
    views = []
    for rows in domains.values():
        course = F.col("course_id")
        if "component_id" in rows.columns:
            rows = join_known(rows, part, "component_id")
            course = F.coalesce("course_id", "part_course")
        views.append(
            rows.select(
                "id",
                "observation_id",
                "facility_id",
                course.alias("course_id"),
                (F.col("round_id") if "round_id" in rows.columns else none).alias("round_id"),
            )
        )
    result = views[0]
    for view in views[1:]:
        result = result.unionByName(view)
    return result


# A row's subject, by the first of these columns that it states, and the table that has it.
SUBJECT_ORDER = {"course_id": "course", "component_id": "component", "round_id": "round_option", "event_id": "architecture_event"}


def owners(bundle: dict, tables=None) -> DataFrame:
    """(entity, id, facility_id): each entity's facility, for every kind of entity in the bundle.

    One rule for all kinds: a facility is its own; a row that states a facility has that one; else it
    has the owner of its first stated subject, which may again be known by its subject only, or be
    NULL. Kinds are resolved along these references, each once, by joins on the subject's id; a
    subject that does not exist resolves to NULL (the reference rules report it). Each join's result is
    written, and only rows that state the subject are dealt, so that disks hold the shuffle of one join.
    """
    resolved = {}

    def of(kind):
        if kind in resolved:
            return resolved[kind]
        rows, key = bundle[kind], schemas.KEYS[kind]
        if kind == "facility":
            resolved[kind] = rows.select(F.col(key).alias("id"), F.col(key).alias("facility_id"))
            return resolved[kind]
        own = F.col("facility_id") if "facility_id" in rows.columns else F.lit(None).cast("string")
        subjects = {c: parent for c, parent in SUBJECT_ORDER.items() if c in rows.columns and c != key and parent in bundle}
        stated = lambda column: F.coalesce(column, F.lit("")) != ""
        found = rows.select(F.col(key).alias("id"), F.when(stated(own), own).alias("_owner"), stated(own).alias("_done"), *subjects)
        left = list(subjects)
        for column, parent in subjects.items():
            left.remove(column)
            theirs = of(parent).select(F.col("id").alias(column), F.col("facility_id").alias("_theirs"))
            here = F.when(~F.col("_done") & stated(F.col(column)), F.col("_theirs")).otherwise(F.col("_owner"))
            found = join_stored(found, theirs, column).select("id", here.alias("_owner"), (F.col("_done") | stated(F.col(column))).alias("_done"), *left)
            found = settle(found, "owners")
        resolved[kind] = found.select("id", F.col("_owner").alias("facility_id"))
        return resolved[kind]

    named = tables or [t for t in bundle if t in schemas.KEYS and {"facility_id", *SUBJECT_ORDER} & set(bundle[t].columns)]
    return reduce(DataFrame.unionByName, [of(t).select(F.lit(t).alias("entity"), "id", "facility_id") for t in named])


def course_counts(facilities: DataFrame, courses: DataFrame) -> DataFrame:
    counted = courses.where(F.col("facility_id").isNotNull()).groupBy("facility_id").agg(F.count("*").alias("n"))
    return facilities.select("facility_id").join(counted, "facility_id", "left").select(
        "facility_id", F.coalesce("n", F.lit(0)).alias("course_count")
    )


def state_choices(records: DataFrame) -> DataFrame:
    return records.where(F.col("state") != "").select("state").distinct().orderBy("state")
