"""Guarded change batches: digests, typing, evidence, duplicates, post-state and report.

A batch's changes are rows: ordinal, entity, id, expected (digest of the row being replaced, or
NULL for an addition), values (a JSON object of the changed fields) and the evidence columns
source_id, collected_on, status, observation_id, origin, observation_digest, review_reference.
An optional column retained holds the evidence of a course added from what was kept (retained.py).
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed, schemas
from ..functions import canon
from ..functions.text import ascii_lower
from . import quality
from .joins import join_known

SUBJECT_COLUMNS = ["facility_id", "course_id", "round_id", "component_id", "event_id", "party_id"]
EVIDENCE = ["source_id", "collected_on", "status", "observation_id", "origin", "observation_digest", "review_reference"]


def row_digests(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).alias("id"), canon.row_digest(*sorted(rows.columns)).alias("digest"))


# --- judging -----------------------------------------------------------------------------------


def envelope_violations(changes: DataFrame) -> DataFrame:
    """(ordinal, rule): unknown entity, malformed id, wrong prefix, or the same row twice."""
    entities = list(schemas.CORE) + list(schemas.DOMAINS)
    prefixes = F.create_map(*[F.lit(x) for pair in fixed.ID_PREFIXES.items() for x in pair])
    prefix = F.try_element_at(prefixes, F.col("entity"))
    first = changes.groupBy("entity", "id").agg(F.min("ordinal").alias("first_ordinal"))
    joined = changes.join(first, ["entity", "id"])
    keys = F.json_object_keys("values")
    # A stale change is a conflict; its values are not looked at.
    live = ~F.coalesce(F.col("stale"), F.lit(False)) if "stale" in changes.columns else F.lit(True)
    rule = (
        F.when(~F.col("entity").isin(entities), "unknown entity")
        .when(F.col("entity") == "quality_rating", "quality ratings are deferred")
        .when(~F.coalesce(F.col("id").rlike(fixed.ENTITY_UUID), F.lit(False)), "stable id required")
        .when(prefix.isNotNull() & ~F.col("id").startswith(F.concat(prefix, F.lit("-"))), "incorrect id prefix")
        .when(F.col("ordinal") > F.col("first_ordinal"), "duplicate entity in batch")
        .when(live & keys.isNull(), "values must be an object")
        .when(live & F.array_contains(keys, "id"), "identity cannot be changed")
    )
    judged = joined.select("ordinal", rule.alias("rule"))
    return judged.where(F.col("rule").isNotNull())


def guarded(changes: DataFrame, current: dict) -> DataFrame:
    """Changes with the digest of the row they meet and whether that is what they expected.

    Only rows a change names are digested; a small batch is broadcast to each table's scan.
    """
    digests = []
    for entity, key in schemas.KEYS.items():
        if entity in current:
            named = changes.where(F.col("entity") == entity).select(F.col("id").alias(key)).distinct()
            met = current[entity].join(named, key, "left_semi")
            digests.append(row_digests(met, key).withColumn("entity", F.lit(entity)))
    known = reduce(DataFrame.unionByName, digests).withColumnRenamed("digest", "current_digest")
    joined = changes.join(known, ["entity", "id"], "left")
    return joined.withColumn("stale", ~F.col("expected").eqNullSafe(F.col("current_digest")))


def _typed(entity: Column) -> Column:
    return entity.isin([d for d in schemas.DOMAINS if d not in ("source_observation", "design_party")])


def _stated(name: str, otherwise) -> Column:
    """A field of the merged row: the change's value where it states one, else the former one."""
    given = F.array_contains(F.json_object_keys("values"), name)
    return F.when(given, F.get_json_object("values", "$." + name)).otherwise(otherwise)


def with_observations(live: DataFrame, tables: dict) -> DataFrame:
    """Changes with fact_observation_id, the observation of the merged row, and before_observation_id.

    A credit takes its event's observation; the event may be stored or come in the same batch.
    """
    former = []
    for entity in [*schemas.TYPED, "architecture_credit"]:
        if entity not in tables:
            continue
        key = schemas.KEYS[entity]
        named = live.where(F.col("entity") == entity).select(F.col("id").alias(key)).distinct()
        met = tables[entity].join(named, key, "left_semi")
        column = "event_id" if entity == "architecture_credit" else "observation_id"
        former.append(met.select(F.lit(entity).alias("entity"), F.col(key).alias("id"), F.col(column).alias("_former")))
    none = F.lit(None).cast("string")
    if not former:
        return live.withColumns({"fact_observation_id": none, "before_observation_id": none})
    met = live.join(reduce(DataFrame.unionByName, former), ["entity", "id"], "left")
    is_credit = F.col("entity") == "architecture_credit"
    merged = met.withColumns({
        "_own": _stated("observation_id", F.when(~is_credit, F.col("_former"))),
        "_event": F.when(is_credit, _stated("event_id", F.col("_former"))),
    })
    events = merged.where("entity = 'architecture_event'").select(F.col("id").alias("_event"), F.col("_own").alias("_of_event"))
    if "architecture_event" in tables:
        wanted = merged.where(is_credit).select(F.col("_event").alias("event_id")).distinct()
        stored = tables["architecture_event"].join(wanted, "event_id", "left_semi")
        stored = stored.select(F.col("event_id").alias("_event"), F.col("observation_id").alias("_of_event"))
        events = events.unionByName(stored.join(events, "_event", "left_anti"))
    joined = join_known(merged, events, "_event")
    return joined.withColumns({
        "fact_observation_id": F.when(is_credit, F.col("_of_event")).otherwise(F.col("_own")),
        "before_observation_id": F.when(~is_credit, F.col("_former")),
    }).drop("_former", "_own", "_event", "_of_event")


def cited_observations(live: DataFrame, observations: DataFrame) -> DataFrame:
    """The observations that changes cite, stored or added by the batch: observation_id, source_id,
    collected_on, status, origin, digest (NULL for an added one)."""
    named = live.select("observation_id").where("observation_id is not null").distinct()
    fields = ["source_id", "collected_on", "status", "origin"]
    stored = observations.join(named, "observation_id", "left_semi").select(
        "observation_id", *[F.col(f).cast("string").alias(f) for f in fields], canon.row_digest(*sorted(observations.columns)).alias("digest")
    )
    new = live.where("entity = 'source_observation' and expected is null").select(
        F.col("id").alias("observation_id"), *[F.get_json_object("values", "$." + f).alias(f) for f in fields], F.lit(None).cast("string").alias("digest")
    )
    return stored.unionByName(new)


def ledger(live: DataFrame, observations: DataFrame, batch_id: str) -> DataFrame:
    """The evidence of every applied change: batch, row, source, date, origin, status, and a correction's review."""
    cited = observations.select(
        "observation_id", F.col("source_id").alias("o_source_id"), F.col("collected_on").alias("o_collected_on"), F.col("status").alias("o_status")
    )
    joined = join_known(live, cited, "observation_id")
    typed, fixing = _typed(F.col("entity")), F.coalesce(F.col("origin") == "retained_normalization", F.lit(False))
    known = F.when(F.col("o_status").isin("extracted", "confirmed"), F.col("o_status")).otherwise("extracted")
    review = F.struct("origin", "observation_id", "observation_digest", "review_reference", F.col("o_status").alias("original_status"))
    return joined.select(
        F.lit(batch_id).alias("batch_id"), F.col("entity").alias("entity_type"), F.col("id").alias("entity_id"),
        F.when(typed, F.col("o_source_id")).otherwise(F.col("source_id")).alias("source_id"),
        F.when(typed, F.col("o_collected_on")).otherwise(F.col("collected_on")).alias("collected_on"),
        F.when(fixing, "retained_normalization").otherwise("new_extraction").alias("origin"),
        F.when(fixing, canon.canonical_value(review)).alias("payload"),
        F.when(typed, known).otherwise(F.col("status")).alias("status"),
    )


def evidence_violations(changes: DataFrame, sources: DataFrame, observations: DataFrame, held_ids: DataFrame) -> DataFrame:
    """(ordinal, rule) of the evidence envelope.

    Core rows name source, date and status; typed facts name one new observation; a correction
    names the retained observation it keeps, by digest, and its review. `changes` carries the
    row's own observation in fact_observation_id and its former one in before_observation_id
    (both may be NULL). `observations` has observation_id, source_id, collected_on, status,
    origin and digest; `sources` has source_id and intake_policy.
    """
    cited = observations.select(
        F.col("observation_id"), F.col("source_id").alias("o_source_id"), F.col("collected_on").cast("string").alias("o_collected_on"),
        F.col("status").alias("o_status"), F.col("origin").alias("o_origin"), F.col("digest").alias("o_digest"),
    )
    joined = join_known(changes, cited, "observation_id")
    typed = _typed(F.col("entity"))
    correction = F.coalesce(F.col("origin") == "retained_normalization", F.lit(False))
    core_shape = (
        F.col("source_id").isNotNull() & F.col("collected_on").isNotNull() & F.col("status").isNotNull()
        & F.coalesce("observation_id", "origin", "observation_digest", "review_reference").isNull()
    )
    fact_shape = F.col("observation_id").isNotNull() & F.coalesce(
        "source_id", "collected_on", "status", "origin", "observation_digest", "review_reference"
    ).isNull()
    fix_shape = F.col("observation_id").isNotNull() & F.col("observation_digest").isNotNull() & F.coalesce("source_id", "collected_on", "status").isNull()
    effective = joined.withColumn("used_source", F.when(typed, F.col("o_source_id")).otherwise(F.col("source_id")))
    used = sources.select(F.col("source_id").alias("used_source"), "intake_policy")
    held = held_ids.select(F.col("source_id").alias("used_source")).distinct().withColumn("held", F.lit(True))
    effective = effective.join(used, "used_source", "left").join(held, "used_source", "left")
    date = canon.strict_date(F.when(typed, F.col("o_collected_on")).otherwise(F.col("collected_on")))
    status = F.when(typed, F.col("o_status")).otherwise(F.col("status"))
    permitted = F.coalesce(F.col("intake_policy") == "permitted", F.lit(False)) & F.col("held").isNull()
    envelope = (F.col("entity") == "source_observation") & ~typed
    stated = F.get_json_object("values", "$.origin") if "values" in changes.columns else F.lit(None).cast("string")
    differs = F.lit(False)
    if "values" in changes.columns:
        for name in ("source_id", "collected_on", "status"):
            differs = differs | ~F.get_json_object("values", "$." + name).eqNullSafe(F.col(name))
    same_observation = F.col("fact_observation_id").eqNullSafe(F.col("observation_id"))
    fixing = typed & correction
    # Additions from retained evidence have rules of their own.
    own_rules = F.col("retained").isNotNull() if "retained" in changes.columns else F.lit(False)
    rule = (
        F.when(own_rules, None)
        .when(typed & ~correction & ~F.coalesce(fact_shape, F.lit(False)), "typed facts need one observation")
        .when(fixing & ~F.coalesce(fix_shape, F.lit(False)), "invalid correction evidence")
        .when(~typed & ~F.coalesce(core_shape, F.lit(False)), "source, date and status required")
        .when(typed & ~same_observation, "evidence observation differs from fact")
        .when(fixing & F.col("before_observation_id").isNull(), "corrections change existing facts only")
        .when(fixing & (F.col("before_observation_id") != F.col("observation_id")), "correction cannot replace its envelope")
        .when(fixing & ~F.coalesce(F.col("o_origin").isin("retained_input", "retained_normalization"), F.lit(False)), "retained observation required")
        .when(fixing & (F.col("o_digest") != F.col("observation_digest")), "stale observation guard")
        .when(fixing & (F.coalesce(F.trim("review_reference"), F.lit("")) == ""), "review reference required")
        .when(fixing, None)
        .when(typed & ~F.coalesce(F.col("o_origin") == "new_extraction", F.lit(False)), "ordinary intake cannot promote retained evidence")
        .when(date.isNull(), "date must be YYYY-MM-DD")
        .when(~F.coalesce(status.isin("extracted", "confirmed"), F.lit(False)), "invalid extraction status")
        .when(~permitted, "source is not permitted")
        .when(envelope & ~F.coalesce(stated == "new_extraction", F.lit(False)), "new observations are new extractions")
        .when(envelope & differs, "observation differs from its evidence")
    )
    judged = effective.select("ordinal", rule.alias("rule"))
    return judged.where(F.col("rule").isNotNull())


# --- applying ----------------------------------------------------------------------------------


def _parsed(rows: DataFrame, key: str) -> Column:
    """The change's JSON as the table's own column types; absent and null fields are NULL."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != key)
    return F.from_json("values", fields)


def post_state(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table after its changes. The table itself is not shuffled when the batch is small:
    it is left-joined to the changes, and additions are appended."""
    parsed = changes.select(F.col("id").alias(key), _parsed(rows, key).alias("_new"), F.json_object_keys("values").alias("_given"))
    joined = rows.join(parsed, key, "left")

    def value(name):
        given = F.array_contains("_given", name)
        return F.when(given, F.col("_new")[name]).otherwise(F.col(name)).alias(name)

    updated = joined.select(*[F.col(key) if n == key else value(n) for n in rows.columns])
    fresh = parsed.join(rows.select(key), key, "left_anti")
    added = fresh.select(*[F.col(key) if n == key else F.col("_new")[n].alias(n) for n in rows.columns])
    return updated.unionByName(added)


def change_rows(before: DataFrame, after: DataFrame, touched: DataFrame, entity: str, key: str) -> DataFrame:
    """One row per changed entity: kind, the fields that differ, and their number."""
    ids = touched.select(F.col("id").alias(key)).distinct()
    old = before.join(ids, key, "left_semi").select(key, F.struct(*before.columns).alias("b"))
    new = after.join(ids, key, "left_semi").select(key, F.struct(*after.columns).alias("a"))
    both = new.join(old, key, "left")
    listed = F.array_compact(
        F.array(*[F.when(~F.col("a")[n].eqNullSafe(F.col("b")[n]), F.lit(n)) for n in after.columns])
    )
    shown = both.select(
        F.when(F.col("b").isNull(), "added").otherwise("updated").alias("kind"), F.lit(entity).alias("entity"), F.col(key).alias("id"),
        F.when(F.col("b").isNotNull(), listed).otherwise(F.array(*[F.lit(n) for n in after.columns])).alias("fields"),
    )
    return shown.where(F.size("fields") > 0)


def summary(report_rows: DataFrame) -> DataFrame:
    """Review lines, one per change: kind, entity, id and the fields in one text."""
    text = F.concat("kind", F.lit(": "), "entity", F.lit(" "), "id", F.lit(" ("), F.array_join("fields", ", "), F.lit(")"))
    return report_rows.select("kind", "entity", "id", text.alias("line"))


def report_counts(report_rows: DataFrame, owners: DataFrame) -> DataFrame:
    """Additions, updates, changed fields and distinct facilities. `owners` is (entity, id, facility_id)."""
    placed = report_rows.join(owners, ["entity", "id"], "left")
    updated = F.col("kind") == "updated"
    return placed.agg(
        F.count_if(~updated).alias("added"),
        F.count_if(updated).alias("updated"),
        F.coalesce(F.sum(F.when(updated, F.size("fields"))), F.lit(0)).cast("long").alias("changed_fields"),
        F.count_distinct("facility_id").alias("distinct_facilities"),
    )


def possible_duplicates(rows: DataFrame, added: DataFrame, key: str, same):
    """New rows that share a folded name and `same` columns with others. Rows of an unknown parent
    (NULL in a `same` column ending in _id) have no others.

    Returns (flagged, members): one row per flagged new id with the key of its group and the
    number of others in it, and the groups' members listed once each. Pairs are never formed,
    so a group holding very many copies stays linear.
    """
    folded = ascii_lower(F.trim("name"))
    group = F.sha2(F.to_json(F.array(folded, *[F.coalesce(F.concat(F.lit("="), F.col(n).cast("string")), F.lit("~")) for n in same])), 256)
    placed = rows
    for name in same:
        placed = placed.where(F.col(name).isNotNull()) if name.endswith("_id") else placed
    named = placed.where(F.coalesce("name", F.lit("")) != "").select(key, group.alias("group_key"))
    fresh = named.join(added.select(F.col("id").alias(key)), key, "left_semi")
    # Only groups of new rows matter, so the table is cut down to those before it is counted.
    near = named.join(fresh.select("group_key").distinct(), "group_key", "left_semi")
    counted = near.groupBy("group_key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    flagged = fresh.join(counted, "group_key").select(key, "group_key", (F.col("n") - 1).alias("others"))
    members = near.join(counted, "group_key", "left_semi")
    return flagged, members


def late_parents(changes: DataFrame) -> DataFrame:
    """(ordinal, rule) of additions whose parent is added later in the same batch."""
    additions = changes.where(F.col("expected").isNull()).select("ordinal", "entity", "id", "values")
    named = []
    for child, columns in schemas.REFERENCES.items():
        for column, parent in columns.items():
            identifier = F.get_json_object("values", "$." + column)
            stated = (F.col("entity") == child) & identifier.isNotNull()
            named.append(F.when(stated, F.struct(F.lit(parent).alias("entity"), identifier.alias("id"))))
    wanted = additions.select(F.col("ordinal").alias("child_ordinal"), F.inline(F.array_compact(F.array(*named))))
    late = wanted.join(additions.select("entity", "id", "ordinal"), ["entity", "id"]).where(F.col("ordinal") > F.col("child_ordinal"))
    return late.select(F.col("child_ordinal").alias("ordinal"), F.lit("parent is added later").alias("rule")).distinct()


def value_violations(changes: DataFrame, entities) -> DataFrame:
    """(ordinal, rule) of wrongly typed values, over the given entities."""
    found = [
        quality.check_values(changes.where(F.col("entity") == entity), entity, "ordinal", "values").select(
            F.col("id").alias("ordinal"), F.concat_ws(" ", "detail", "rule").alias("rule")
        )
        for entity in entities
    ]
    return reduce(DataFrame.unionByName, found)


def moved_subjects(changes: DataFrame, current: dict) -> DataFrame:
    """(ordinal, rule) of updates that would move a row to another subject, or edit an observation."""
    found = [
        changes.where((F.col("entity") == "source_observation") & F.col("expected").isNotNull()).select(
            "ordinal", F.lit("source envelopes are immutable").alias("rule")
        )
    ]
    for entity, rows in current.items():
        key = schemas.KEYS[entity]
        subjects = [c for c in SUBJECT_COLUMNS if c in rows.columns and c != key]
        if not subjects or entity == "source_observation":
            continue
        updates = changes.where(F.col("entity") == entity).select("ordinal", F.col("id").alias(key), "values")
        both = updates.join(rows.select(key, *subjects), key)
        keys = F.json_object_keys("values")
        moved = F.lit(False)
        for name in subjects:
            new = F.get_json_object("values", "$." + name)
            moved = moved | (F.array_contains(keys, name) & ~new.eqNullSafe(F.col(name)))
        found.append(both.where(moved).select("ordinal", F.lit("subject identity cannot be moved").alias("rule")))
    return reduce(DataFrame.unionByName, found)


def clear_sources(sources: DataFrame, requests: DataFrame, held_ids: DataFrame):
    """(sources after clearance, outcome per request).

    A request names source_id, expected digest, controls_reference and collected_on. Only a
    retained-only source that is not held is cleared, under its own id.
    """
    digests = sources.select("source_id", "intake_policy", canon.row_digest(*sorted(sources.columns)).alias("digest"))
    held = held_ids.select("source_id").distinct().withColumn("held", F.lit(True))
    joined = requests.join(digests, "source_id", "left").join(held, "source_id", "left")
    rule = (
        F.when(canon.strict_date(F.col("collected_on")).isNull(), "date must be YYYY-MM-DD")
        .when(F.coalesce(F.trim("controls_reference"), F.lit("")) == "", "controls reference required")
        .when(F.col("digest").isNull(), "unknown source")
        .when(F.col("digest") != F.coalesce("expected", F.lit("")), "stale source guard")
        .when(F.col("held").isNotNull(), "source is held")
        .when(F.col("intake_policy") != "retained_only", "only retained sources can be cleared")
    )
    outcome = joined.select("source_id", F.coalesce(rule, F.lit("cleared")).alias("outcome"))
    cleared = outcome.where("outcome = 'cleared'").select("source_id", F.lit(True).alias("cleared"))
    policy = F.when(F.col("cleared"), "permitted").otherwise(F.col("intake_policy"))
    after = sources.join(cleared, "source_id", "left").withColumn("intake_policy", policy).select(*sources.columns)
    return after, outcome
