"""Reviewed id-to-id decisions: validate, merge, turn into courses, archive, and undo exactly."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import fixed, schemas
from ..functions import canon
from ..session import settle
from . import cards, links
from . import features as feature_ops
from .joins import join_dealt, join_known, join_stored

# Decisions of one target are scanned in blocks of this many plan positions.
BLOCK = 100_000


# --- plan --------------------------------------------------------------------------------------


def plan_violations(decisions: DataFrame, facilities: DataFrame, courses: DataFrame) -> DataFrame:
    """The first rule each decision breaks: (ordinal, source_id, rule).

    `decisions` has ordinal, action, source_id, target_facility_id, target_course_id, rule,
    reason, evidence_count, source_sha256 and withheld_fields; `facilities` has facility_id,
    sha256 and has_feature.
    """
    source = facilities.select(
        F.col("facility_id").alias("source_id"), F.col("sha256").alias("current_sha256"), "has_feature", F.lit(True).alias("source_known")
    )
    target = facilities.select(F.col("facility_id").alias("target_facility_id"), F.lit(True).alias("target_known"))
    owners = courses.where(F.col("facility_id").isNotNull()).select(F.col("facility_id").alias("source_id")).distinct()
    wanted = courses.select(
        F.col("course_id").alias("wanted_course"), F.col("facility_id").alias("course_facility"), F.lit(True).alias("course_known")
    )
    repeated = decisions.groupBy("source_id").agg(F.min("ordinal").alias("first_ordinal"))
    as_target = decisions.select(F.col("target_facility_id").alias("source_id")).distinct()
    chained = decisions.select("source_id").distinct().join(as_target, "source_id", "left_semi")
    # A link in a chain is the decision whose target is itself a source.
    chained = chained.select(F.col("source_id").alias("target_facility_id"), F.lit(True).alias("chained"))
    joined = (
        decisions.withColumn("wanted_course", F.coalesce("target_course_id", "source_id"))
        .join(source, "source_id", "left")
        .join(target, "target_facility_id", "left")
        .join(owners.withColumn("has_courses", F.lit(True)), "source_id", "left")
        .join(wanted, "wanted_course", "left")
        .join(repeated, "source_id", "left")
        .join(chained, "target_facility_id", "left")
    )
    blank = F.lit(False)
    for name in ("source_id", "target_facility_id", "rule", "reason"):
        blank = blank | (F.coalesce(F.trim(name), F.lit("")) == "")
    to_course = F.col("action").isin("course", "match_course")
    new_course = (F.col("action") == "course") & F.col("course_known").isNull()
    own_new_id = (F.col("action") == "course") & (F.col("target_course_id") == F.col("source_id"))
    allowed = F.array(*[F.lit(n) for n in fixed.WITHHOLDABLE_COURSE_FIELDS])
    bad_fields = (
        (F.size("withheld_fields") == 0)
        | (F.size(F.array_distinct("withheld_fields")) != F.size("withheld_fields"))
        | (F.size(F.array_except("withheld_fields", allowed)) > 0)
    )
    unknown_course = F.col("target_course_id").isNotNull() & F.col("course_known").isNull() & ~F.coalesce(own_new_id, F.lit(False))
    elsewhere = F.col("course_facility").isNotNull() & (F.col("course_facility") != F.col("target_facility_id"))
    rule = (
        F.when(~F.coalesce(F.col("action").isin(fixed.DECISION_ACTIONS), F.lit(False)), "unknown action")
        .when(blank, "missing decision text")
        .when(F.coalesce("evidence_count", F.lit(0)) == 0, "missing evidence")
        .when(F.col("ordinal") > F.col("first_ordinal"), "repeated source")
        .when(F.col("source_known").isNull() | F.col("target_known").isNull(), "unknown facility")
        .when(F.col("source_id") == F.col("target_facility_id"), "source targets itself")
        .when(F.col("has_courses").isNotNull(), "source has courses")
        .when(F.col("source_sha256") != F.col("current_sha256"), "source digest changed")
        .when(to_course & ~F.col("has_feature"), "course needs a source feature")
        .when((F.col("action") == "match_course") & F.col("target_course_id").isNull(), "match needs a course")
        .when(to_course & unknown_course, "unknown course")
        .when(to_course & elsewhere, "course of another facility")
        .when(~to_course & F.col("target_course_id").isNotNull(), "facility decision cannot target a course")
        .when(F.col("withheld_fields").isNotNull() & (~new_course | bad_fields), "withheld fields need a new course")
        .when(F.col("chained").isNotNull(), "target is also a source")
    )
    judged = joined.select("ordinal", "source_id", rule.alias("rule_broken"))
    return judged.where(F.col("rule_broken").isNotNull()).select("ordinal", "source_id", F.col("rule_broken").alias("rule"))


# --- appending ---------------------------------------------------------------------------------


def append_unique(rows: DataFrame, owner: str, ordinal: str, item: str) -> DataFrame:
    """Rows in order without repeats of the same content per owner; the first one stays.

    Repeats fold before the shuffle, so an owner with very many equal items costs little.
    """
    digest = F.sha2(canon.canonical_value(F.col(item)), 256)
    kept = rows.groupBy(owner, digest.alias("digest")).agg(
        F.min(ordinal).alias(ordinal), F.min_by(item, ordinal).alias(item)
    )
    return kept.select(owner, ordinal, item)


def append_by_id(rows: DataFrame, owner: str, key: str, ordinal: str, item: str):
    """(kept, conflicts): one row per id; the same id with other content is a conflict."""
    digest = F.sha2(canon.canonical_value(F.col(item)), 256)
    merged = rows.withColumn("_digest", digest).groupBy(owner, key).agg(
        F.min(ordinal).alias(ordinal),
        F.min_by(item, ordinal).alias(item),
        (F.min("_digest") != F.max("_digest")).alias("conflict"),
    )
    return merged.where(~F.col("conflict")).drop("conflict"), merged.where("conflict").select(owner, key)


# --- merging facilities ------------------------------------------------------------------------


def _usable(name: str, rows: DataFrame) -> Column:
    column = F.col(name)
    if rows.schema[name].dataType.typeName() == "string":
        return column.isNotNull() & (column != "")
    return column.isNotNull()


def merge_sources(facilities: DataFrame, merges: DataFrame) -> DataFrame:
    """Source rows of the merge decisions with their target and whether the source is preferred.

    A source wins over known values only if it is released and its target is not.
    """
    plan = merges.select("ordinal", F.col("source_id").alias("facility_id"), F.col("target_facility_id").alias("target_id"))
    released = facilities.select(F.col("facility_id").alias("target_id"), F.col("released_id").alias("target_released"))
    joined = join_dealt(join_dealt(facilities, plan, "facility_id"), released, "target_id")
    preferred = F.col("released_id").isNotNull() & F.col("target_released").isNull()
    return joined.withColumn("preferred", preferred).drop("target_released")


def merge_scalars(facilities: DataFrame, sources: DataFrame, fields) -> DataFrame:
    """Targets after all merges: last preferred value, else the target's own, else the first other.

    A closed form of applying the sources one by one, so many sources of one target combine
    before the shuffle.
    """
    collected = []
    for name in fields:
        usable = _usable(name, sources)
        collected.append(F.max_by(name, F.when(F.col("preferred") & usable, F.col("ordinal"))).alias("_win_" + name))
        collected.append(F.min_by(name, F.when(~F.col("preferred") & usable, F.col("ordinal"))).alias("_fill_" + name))
    # The location is taken whole, from the first source that has one.
    place = F.struct("latitude", "longitude", "location_kind")
    collected.append(F.min_by(place, F.when(F.col("latitude").isNotNull(), F.col("ordinal"))).alias("_place"))
    # So is the observed feature, where the target has none; later ones stay citations.
    observed = "osm_identity" in facilities.columns and "source_url" in facilities.columns
    if observed:
        first = F.when(F.col("source_url").isNotNull(), F.col("ordinal"))
        collected.append(F.min_by(F.coalesce("osm_identity", "facility_id"), first).alias("_feature"))
    merged = sources.groupBy(F.col("target_id").alias("facility_id")).agg(*collected)
    joined = join_dealt(facilities, merged, "facility_id", "left")
    if observed:
        joined = joined.withColumn("osm_identity", F.coalesce("osm_identity", "_feature"))
    adopt = F.col("latitude").isNull()
    columns = {name: F.coalesce("_win_" + name, F.col(name), F.col("_fill_" + name)) for name in fields}
    columns |= {
        name: F.coalesce(F.col(name), F.when(adopt, F.col("_place." + name))) for name in ("latitude", "longitude", "location_kind")
    }
    return joined.withColumns(columns).select(*facilities.columns)


def merge_steps(facilities: DataFrame, sources: DataFrame, fields, block=BLOCK) -> DataFrame:
    """Each source's value of each field with the target's value just before that step.

    The running value needs the last preferred value so far. It is carried within blocks of the
    plan, and from block to block by one row each, so no task holds all sources of a target.
    """
    values = F.array(
        *[F.struct(F.lit(n).alias("field"), F.when(_usable(n, sources), F.col(n)).cast("string").alias("value")) for n in fields]
    )
    own = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("own")) for n in fields])
    steps = sources.select("target_id", F.col("facility_id").alias("source_id"), "ordinal", "preferred", F.inline(values)).where(
        F.col("value").isNotNull()
    )
    steps = steps.withColumn("block", F.floor(F.col("ordinal") / block))
    key = ["target_id", "field"]
    won = F.when(F.col("preferred"), F.col("value"))
    ends = steps.groupBy(*key, "block").agg(F.max_by("value", F.when(F.col("preferred"), F.col("ordinal"))).alias("end"))
    earlier = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.withColumn("start", F.last("end", ignorenulls=True).over(earlier)).drop("end")
    inside = Window.partitionBy(*key, "block").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    carried = join_dealt(steps.withColumn("won_here", F.last(won, ignorenulls=True).over(inside)), starts, [*key, "block"])
    # The first value a non-preferred source could give, if it came before this step.
    plain = F.when(~F.col("preferred"), F.col("ordinal"))
    fills = steps.groupBy(*key).agg(F.min(plain).alias("fill_at"), F.min_by("value", plain).alias("fill"))
    originals = facilities.select(F.col("facility_id").alias("target_id"), F.inline(own))
    joined = join_dealt(join_dealt(carried, fills, key), originals, key, "left")
    filled = F.when(F.col("fill_at") < F.col("ordinal"), F.col("fill"))
    before = F.coalesce("won_here", "start", "own", filled)
    after = F.when(F.col("preferred") | F.col("before").isNull(), F.col("value")).otherwise(F.col("before"))
    return joined.withColumn("before", before).withColumn("after", after).select(
        *key, "source_id", "ordinal", "preferred", "before", "value", "after"
    )


def merge_conflicts(steps: DataFrame) -> DataFrame:
    """Known values that disagreed when their source was merged, and which one was kept."""
    clash = steps.where(F.col("before").isNotNull() & (F.col("before") != F.col("value")))
    return clash.select(
        "target_id", "source_id", "ordinal", "field", F.col("value").alias("source_value"), F.col("before").alias("target_value"),
        F.when(F.col("preferred"), "source").otherwise("target").alias("selected"),
    )


def alias_id(kind: Column, identifier: Column, name: Column) -> Column:
    text = F.to_json(F.array(kind, identifier, name))
    return F.concat(F.lit("reconciliation-alias-"), F.substring(F.sha2(text, 256), 1, 24))


def merge_aliases(steps: DataFrame, existing: DataFrame) -> DataFrame:
    """Names that lost at some step become aliases of the target, once each."""
    named = steps.where(F.col("field") == "name")
    offered = named.select("target_id", "after", F.explode(F.array("before", "value")).alias("name"))
    lost = offered.where((F.col("name") != F.col("after")) & (F.col("name") != "")).select(F.col("target_id").alias("facility_id"), "name").distinct()
    new = join_dealt(lost, existing.select("facility_id", "name"), ["facility_id", "name"], "left_anti")
    return new.select(
        alias_id(F.lit("facility"), F.col("facility_id"), F.col("name")).alias("alias_id"), "facility_id", F.lit(None).cast("string").alias("course_id"), "name"
    )


def listed_items(facilities: DataFrame, sources: DataFrame, column: str, name: str) -> DataFrame:
    """Items of a list column of each target and then of its sources, one row per item."""
    targets = sources.select(F.col("target_id").alias("facility_id")).distinct()
    own = join_dealt(facilities, targets, "facility_id", "left_semi").select(
        "facility_id", F.lit(-1).cast("long").alias("step"), F.posexplode(column).alias("at", name)
    )
    theirs = sources.select(
        F.col("target_id").alias("facility_id"), F.col("ordinal").cast("long").alias("step"), F.posexplode(column).alias("at", name)
    )
    return own.unionByName(theirs)


def merge_entities(facilities: DataFrame, sources: DataFrame) -> DataFrame:
    """Linked entities of each target and its sources, in order and without repeats."""
    rows = listed_items(facilities, sources, "wikidata", "entity").withColumn("position", F.struct("step", "at"))
    return append_unique(rows, "facility_id", "position", "entity")


def merge_citations(facilities: DataFrame, sources: DataFrame) -> DataFrame:
    """Citations of each target in order: its own, then each source's, then the merged feature's.

    One row per citation: (facility_id, position, citation); repeats are dropped.
    """
    observed = feature_ops.citation(F.array(F.lit("osm")), "reconciled_osm_observation", F.col("facility_id"))
    attached = sources.where(F.col("source_url").isNotNull()).select(
        F.col("target_id").alias("facility_id"), F.col("ordinal").cast("long").alias("step"), F.lit(1_000_000_000).alias("at"), observed.alias("citation")
    )
    rows = listed_items(facilities, sources, "fact_sources", "citation").unionByName(attached)
    return append_unique(rows.withColumn("position", F.struct("step", "at")), "facility_id", "position", "citation")


# --- archiving, courses, destinations ----------------------------------------------------------


def archive_relations(bundle: dict, removed: DataFrame) -> dict:
    """Drop relations of removed facilities: their rows, their rounds, and those rounds' rows.

    `removed` has facility_id.
    """
    gone = join_dealt(bundle["round_option"], removed, "facility_id", "left_semi").select("round_id")
    result = dict(bundle)
    for table in ("component", "round_option", "round_component", "tee_set", "alias"):
        rows = bundle[table]
        if "facility_id" in rows.columns:
            rows = join_stored(rows, removed, "facility_id", "left_anti", dealt=True)
        if "round_id" in rows.columns:
            rows = join_stored(rows, gone, "round_id", "left_anti", dealt=True)
        result[table] = rows
    if "intake" in bundle:
        named = removed.select(F.lit("facility").alias("entity_type"), F.col("facility_id").alias("entity_id"))
        result["intake"] = join_dealt(bundle["intake"], named, ["entity_type", "entity_id"], "left_anti")
    return result


def course_decisions(decisions: DataFrame, sources: DataFrame, courses: DataFrame):
    """(new courses, changed existing courses) of the course and match_course decisions.

    `sources` are feature records by source_id. A new course takes what its feature says, less
    the withheld fields, which also leave its citations; a matched one only fills unknowns.
    """
    wanted = decisions.where(F.col("action").isin("course", "match_course")).withColumn(
        "course_id", F.coalesce("target_course_id", "source_id")
    )
    # Tags are read from the decided features only, and once; they are far larger than their files.
    sources = settle(join_dealt(sources, wanted.select("source_id"), "source_id", "left_semi"), "sources")
    known = courses.select("course_id").withColumn("known", F.lit(True))
    marked = join_dealt(join_dealt(wanted, known, "course_id", "left"), sources, "source_id")
    fresh = marked.where(F.col("known").isNull())
    made = feature_ops.new_records(fresh.withColumn("feature_id", F.col("source_id")), "courses")
    made = join_dealt(
        made.withColumnRenamed("course_id", "source_id"),
        fresh.select("source_id", "course_id", F.col("target_facility_id").alias("facility_id"), "withheld_fields"), "source_id",
    )
    filled = feature_ops.fill_unknown(made)
    withheld = F.coalesce("withheld_fields", F.array().cast("array<string>"))
    for name in fixed.WITHHOLDABLE_COURSE_FIELDS:
        if name in filled.columns:
            filled = filled.withColumn(name, F.when(~F.array_contains(withheld, name), F.col(name)))
    kept = F.transform("fact_sources", lambda c: c.withField("fields", F.array_except(c["fields"], withheld)))
    observed = F.array(feature_ops.citation(F.array(F.lit("osm")), "reconciled_osm_observation", F.col("source_id")))
    new = filled.withColumn("fact_sources", F.concat(kept, observed)).drop("feature_tags", "source_url", "checked_on", "credit", "withheld_fields")

    matched = marked.where(F.col("known")).select(
        "course_id", "source_id", "ordinal", F.col("target_facility_id").alias("new_facility"), F.col("tags").alias("feature_tags"), "source_url", "checked_on", "credit",
        F.col("name").alias("source_name"),
    )
    changed = feature_ops.fill_unknown(join_dealt(courses, matched, "course_id"))
    changed = changed.withColumn("facility_id", F.col("new_facility")).withColumn("fact_sources", F.concat("fact_sources", observed))
    return new, changed.drop("feature_tags", "source_url", "checked_on", "credit", "new_facility", "ordinal")


def clean_destinations(destinations: DataFrame, removed: DataFrame, merged: DataFrame) -> DataFrame:
    """Destinations after the decisions: merged estimates take the target's id, estimates of
    removed facilities go, and of several with one (scope, id) the original one stays.

    `merged` is (old_id, new_id); `removed` has facility_id.
    """
    estimate = F.col("scope") == "facility_estimate"
    renamed = links.rekey(destinations.withColumn("original_id", F.col("id")), "id", merged, only=estimate, dealt=True)
    gone = removed.select(F.col("facility_id").alias("id"), F.lit("facility_estimate").alias("scope"))
    kept = join_dealt(renamed, gone, ["scope", "id"], "left_anti")
    names = [n for n in destinations.columns if n not in ("scope", "id")]
    preference = F.struct((F.col("original_id") != F.col("id")).alias("moved"), "original_id")
    best = kept.groupBy("scope", "id").agg(F.min_by(F.struct(*names), preference).alias("row"))
    return best.select("scope", "id", "row.*")


def clear_dangling(courses: DataFrame, destinations: DataFrame, removed: DataFrame) -> DataFrame:
    """Forget a course's destination if it was a removed facility's and no longer exists."""
    left = destinations.select(F.col("id").alias("destination_id"))
    gone = removed.select(F.col("facility_id").alias("destination_id")).distinct()
    # What dangles is found without the courses; of these, the ones with a destination are dealt by it, once.
    dangling = join_dealt(gone, left, "destination_id", "left_anti").withColumn("dangling", F.lit(True))
    joined = join_stored(courses, dangling, "destination_id", dealt=True)
    return joined.withColumn("destination_id", F.when(F.col("dangling").isNull(), F.col("destination_id"))).select(*courses.columns)


def refresh_parents(facilities: DataFrame, courses: DataFrame, affected: DataFrame) -> DataFrame:
    """Recompute course counts of the affected facilities only; all others pass through."""
    part = join_dealt(facilities, affected, "facility_id", "left_semi")
    rest = join_dealt(facilities, affected, "facility_id", "left_anti")
    counted = (
        join_dealt(courses, affected, "facility_id", "left_semi")
        .groupBy("facility_id")
        .agg(F.count("*").alias("_n"), F.count_if(F.col("identity_status") == "operator_defined").alias("_documented"))
    )
    zero = F.lit(0)
    fresh = join_dealt(part, counted, "facility_id", "left").withColumns(
        {"course_count": F.coalesce("_n", zero), "documented_course_count": F.coalesce("_documented", zero)}
    )
    return fresh.select(*facilities.columns).unionByName(rest)


# What a course shows of its facility.
PARENT_FIELDS = ["name", "access", "operating_status", "physical_holes", "website"]


def refresh_children(courses: DataFrame, facilities: DataFrame, affected: DataFrame) -> DataFrame:
    """Recompute the parent columns of courses of affected facilities only.

    State and country come from the facility; where it has none, from the course's own address.
    """
    shown = [n for n in PARENT_FIELDS if n in facilities.columns and "facility_" + n in courses.columns]
    plain = [n for n in ("county", "inventory_complete") if n in facilities.columns and n in courses.columns]
    placed = {n: a for n, a in (("state", "address_region"), ("country", "address_country")) if n in facilities.columns and n in courses.columns}
    taken = [F.col(n).alias("_p_" + n) for n in dict.fromkeys([*shown, *plain, *placed])]
    # Courses meet the affected facilities, with what these show, in one join; all others pass through it.
    parents = join_dealt(affected.distinct(), facilities.select("facility_id", *taken), "facility_id", "left").withColumn("_fresh", F.lit(True))
    new = {"facility_" + n: F.col("_p_" + n) for n in shown} | {n: F.col("_p_" + n) for n in plain}
    for name, address in placed.items():
        own = F.lit(None).cast("string")
        if address in courses.columns and "address_mode" in courses.columns:
            own = F.when(F.col("address_mode").isin("own", "override"), F.col(address))
        new[name] = F.coalesce("_p_" + name, own)
    joined = join_known(courses, parents, "facility_id", dealt=True)
    return joined.withColumns({n: F.when(F.col("_fresh"), value).otherwise(F.col(n)) for n, value in new.items()}).select(*courses.columns)


# --- cards -------------------------------------------------------------------------------------

_REFERRING = ("component", "round_option", "round_component", "tee_set", "alias")


def affected_cards(before: dict, after: dict, receipts: dict):
    """(facility ids, course ids) whose cards a run may have changed, by following the references of
    changed rows, as they were and as they are, to the cards that show them."""
    versions = {}
    for name, record in receipts.items():
        if name in _KEYS and name != "destination":
            # Changed rows as they were stand in the receipt.
            now = after[name].join(record.where("change <> 'removed'").select(_KEYS[name]), _KEYS[name], "left_semi")
            versions[name] = [record.where("before_row is not null").select("before_row.*"), now]
    pick = lambda names, column: [v.select(column) for n in names for v in versions[n] if column in v.columns]
    rounds = reduce(DataFrame.unionByName, pick(("round_option", "round_component", "tee_set"), "round_id")).where("round_id is not null").distinct()
    rounds = settle(rounds, "rounds")
    facilities = pick(("facility", "course", "round_option", "alias"), "facility_id")
    courses = pick(("course", *_REFERRING), "course_id")
    for version in (before, after):
        owned = version["round_option"].join(rounds, "round_id", "left_semi")
        facilities.append(owned.select("facility_id"))
        members = version["round_component"].join(rounds, "round_id", "left_semi")
        courses.append(cards.membership(owned, members, version["component"]).select("course_id"))
        # A component shows in every round that has it as a member.
        changed = reduce(DataFrame.unionByName, [v.select("component_id") for v in versions["component"]]).distinct()
        by_part = version["round_component"].join(changed, "component_id", "left_semi").select("round_id").distinct()
        courses.append(cards.membership(version["round_option"].join(by_part, "round_id", "left_semi"), version["round_component"].join(by_part, "round_id", "left_semi"), version["component"]).select("course_id"))
    facility_ids = settle(reduce(DataFrame.unionByName, facilities).where("facility_id is not null").distinct(), "facilities")
    # A course shows its facility's columns.
    courses.append(after["course"].join(facility_ids, "facility_id", "left_semi").select("course_id"))
    return facility_ids, settle(reduce(DataFrame.unionByName, courses).where("course_id is not null").distinct(), "courses")


def refresh_cards(made: dict, before: dict, after: dict, receipts: dict, limit=cards.PART_ROWS) -> dict:
    """The cards after a run: those it may have changed are nested anew, all others pass through.

    `made` has the facility and course cards of the version before.
    """
    facility_ids, course_ids = affected_cards(before, after, receipts)
    fresh = {"facility": cards.facility_cards_of(after, facility_ids, limit), "course": cards.cards_of(after, course_ids, limit)}
    ids = {"facility": facility_ids, "course": course_ids}
    return {kind: rows.join(ids[kind], kind + "_id", "left_anti").unionByName(fresh[kind].select(*rows.columns)) for kind, rows in made.items()}


# --- receipts ----------------------------------------------------------------------------------


def changed_rows(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Added, removed and changed rows of two versions: (key, change, before_sha256, after_sha256).

    Versions meet by their values; only rows that are not equal are digested, mostly few.
    """
    return _differing(_side(before, key, "old"), _side(after, key, "new"), key)


def _side(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.select(key, F.struct(*sorted(rows.columns)).alias(name))


def _differing(old: DataFrame, new: DataFrame, key: str, *kept) -> DataFrame:
    """changed_rows of two sides, with the columns `kept` of the old one."""
    sides = {"old": old, "new": new}
    kinds = {name: rows.schema[name].dataType for name, rows in sides.items()}
    both = old.join(new, key, "full_outer")
    if kinds["old"].simpleString() == kinds["new"].simpleString() and _comparable(kinds["old"]):
        both = both.where(~F.col("old").eqNullSafe(F.col("new")))
    digest = lambda name: F.when(F.col(name).isNotNull(), canon.struct_digest(kinds[name], lambda n: F.col(name)[n]))
    both = both.select(key, digest("old").alias("before_sha256"), digest("new").alias("after_sha256"), *kept)
    both = both.where(~F.col("before_sha256").eqNullSafe(F.col("after_sha256")))
    change = F.when(F.col("before_sha256").isNull(), "added").when(F.col("after_sha256").isNull(), "removed").otherwise("changed")
    return both.select(key, change.alias("change"), "before_sha256", "after_sha256", *kept)


def _comparable(kind: T.DataType) -> bool:
    """Whether values of a type can be compared by equality."""
    if isinstance(kind, T.StructType):
        return all(_comparable(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _comparable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def receipt(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Changed rows with the complete row as it was, so that the change can be undone.

    The rows of a key as they were, mostly one, are gathered where the versions meet, so each version is dealt once.
    """
    old = _side(before, key, "old")
    shown = lambda row: F.struct(*[row[n].alias(n) for n in before.columns])
    gathered = old.where(F.col(key).isNotNull()).withColumn("_kept", F.collect_list("old").over(Window.partitionBy(key)))
    found = _differing(gathered, _side(after, key, "new"), key, "_kept").withColumn("_kept", F.explode_outer("_kept"))
    found = found.withColumn("before_row", F.when(F.col("_kept").isNotNull(), shown(F.col("_kept")))).drop("_kept")
    # A row without a key meets nothing: it went, and can't be told from others like it.
    nothing = F.lit(None).cast(old.schema["old"].dataType)
    digest = canon.struct_digest(old.schema["old"].dataType, lambda n: F.col("old")[n])
    lost = old.where(F.col(key).isNull()).select(
        key, F.lit("removed").alias("change"), digest.alias("before_sha256"), F.lit(None).cast("string").alias("after_sha256"), F.when(F.lit(False), shown(nothing)).alias("before_row")
    )
    return found.unionByName(lost)


def receipt_violations(current: DataFrame, record: DataFrame, key: str) -> DataFrame:
    """Rows that no longer are what the receipt says it left behind, or whose kept copy changed."""
    # Only rows that the receipt names are digested.
    named = join_dealt(current, record.select(key), key, "left_semi")
    now = named.select(key, canon.rows_digest(named).alias("now_sha256"))
    kept = canon.struct_digest(record.schema["before_row"].dataType, lambda n: F.col("before_row")[n])
    joined = record.withColumn("kept_sha256", F.when(F.col("before_row").isNotNull(), kept))
    joined = join_dealt(joined, now, key, "left")
    rule = F.when(~F.col("now_sha256").eqNullSafe(F.col("after_sha256")), "row changed after the receipt").when(
        ~F.col("kept_sha256").eqNullSafe(F.col("before_sha256")), "kept row changed"
    )
    judged = joined.select(key, rule.alias("rule"))
    return judged.where(F.col("rule").isNotNull())


def restore(current: DataFrame, record: DataFrame, key: str) -> DataFrame:
    """The exact earlier version: untouched rows, and the kept copies of the others."""
    untouched = join_dealt(current, record.select(key), key, "left_anti")
    earlier = record.where(F.col("before_row").isNotNull()).select("before_row.*")
    return untouched.select(*earlier.columns).unionByName(earlier)


# --- the whole run -----------------------------------------------------------------------------

_KEYS = {
    "facility": "facility_id", "course": "course_id", "round_option": "round_id", "round_component": "member_id",
    "component": "component_id", "tee_set": "tee_id", "alias": "alias_id", "destination": "destination_key", "metadata": "key",
}


def keyed_destinations(destinations: DataFrame) -> DataFrame:
    """Destinations under one key, as an id may be both an estimate and an arrival."""
    return destinations.withColumn("destination_key", F.concat_ws("/", "scope", "id"))


def _with_lists(merged: DataFrame, facilities: DataFrame, merging: DataFrame) -> DataFrame:
    """Targets with the citations, and linked entities, of themselves and their sources in the row.

    A list is what the plan's decisions for one target bring together, without repeats.
    """
    parts = {"fact_sources": (merge_citations, "citation")}
    if "wikidata" in facilities.columns:
        parts["wikidata"] = (merge_entities, "entity")
    for column, (collect, item) in parts.items():
        rows = collect(facilities, merging)
        listed = F.array_sort(F.collect_list(F.struct("position", item)))
        lists = rows.groupBy("facility_id").agg(listed.getField(item).alias("_list"))
        merged = join_dealt(merged, lists, "facility_id", "left").withColumn(column, F.coalesce("_list", column)).drop("_list")
    return merged.select(*facilities.columns)


def apply(bundle: dict, decisions: DataFrame, sources: DataFrame, fields=None) -> dict:
    """Apply a valid plan. Returns the new tables, conflicts, and one receipt per table.

    `fields` are the scalars to merge; by default all mergeable ones and the address, as far as
    facilities have them. `bundle` has the tables of _KEYS and destination; facilities carry released_id, location and
    fact_sources, with the merged feature's source_url, checked_on and credit; `sources` are
    feature records by source_id.
    """
    if fields is None:
        mergeable = [*fixed.MERGED_SCALARS, *schemas.ADDRESS_COLUMNS]
        fields = [n for n in mergeable if n in bundle["facility"].columns]
    bundle = bundle | {"destination": keyed_destinations(bundle["destination"])}
    plan = settle(decisions, "decisions")
    merges = plan.where("action = 'merge_facility'")
    removed = plan.select(F.col("source_id").alias("facility_id"))
    archived = plan.where("action <> 'merge_facility'").select(F.col("source_id").alias("facility_id"))
    mapping = merges.select(F.col("source_id").alias("old_id"), F.col("target_facility_id").alias("new_id"))
    facilities = bundle["facility"]
    merging = settle(merge_sources(facilities, merges), "merging")
    steps = settle(merge_steps(facilities, merging, fields), "steps")

    kept = join_dealt(facilities, removed, "facility_id", "left_anti")
    merged = _with_lists(merge_scalars(kept, merging, fields), facilities, merging)
    relations = archive_relations(bundle, archived)
    for table in ("round_option", "alias"):
        relations[table] = links.rekey(relations[table], "facility_id", mapping, dealt=True).select(*bundle[table].columns)
    relations["alias"] = relations["alias"].unionByName(merge_aliases(steps, relations["alias"]))

    courses = links.rekey(bundle["course"], "facility_id", mapping, dealt=True).select(*bundle["course"].columns)
    # Courses that a decision names are told apart once, the others go past the decisions.
    to_course = plan.where(F.col("action").isin("course", "match_course"))
    named = to_course.select(F.coalesce("target_course_id", "source_id").alias("course_id"), F.lit(True).alias("_named")).distinct()
    courses = settle(join_dealt(courses, named, "course_id", "left"), "rekeyed")
    others, courses = courses.where("_named is null").drop("_named"), courses.where("_named").drop("_named")
    fresh, changed = course_decisions(plan, sources, courses)
    renamed = changed.where(F.col("source_name").isNotNull() & ~F.col("source_name").eqNullSafe(F.col("name")))
    aliases = renamed.select(
        alias_id(F.lit("course"), F.col("course_id"), F.col("source_name")).alias("alias_id"), F.lit(None).cast("string").alias("facility_id"), "course_id",
        F.col("source_name").alias("name"),
    ).distinct()
    relations["alias"] = relations["alias"].unionByName(join_dealt(aliases, relations["alias"], "alias_id", "left_anti"))
    names = bundle["course"].columns
    shaped = fresh.select(*[F.col(n) if n in fresh.columns else F.lit(None).cast(bundle["course"].schema[n].dataType).alias(n) for n in names])
    untouched = join_dealt(courses, changed.select("course_id"), "course_id", "left_anti")
    courses = others.unionByName(untouched).unionByName(changed.select(*names)).unionByName(shaped)

    destinations = clean_destinations(bundle["destination"].drop("destination_key"), removed, mapping)
    courses = clear_dangling(courses, destinations, removed)
    affected = plan.select(F.col("target_facility_id").alias("facility_id")).distinct()
    courses = settle(refresh_children(courses, merged, affected), "courses")
    merged = settle(refresh_parents(merged, courses, affected), "facilities")
    destinations = keyed_destinations(destinations).select(*bundle["destination"].columns)
    tables = relations | {"facility": merged, "course": courses, "destination": destinations}
    if "metadata" in bundle:
        tables["metadata"] = refreshed_metadata(bundle["metadata"], tables)
    receipts = receipts_of(bundle, tables)
    conflicts = merge_conflicts(steps)
    return {
        "tables": tables,  # of which those in `stored` are written
        "receipts": receipts,
        "conflicts": conflicts,
        "citations": merge_citations(facilities, merging),
        "plan": plan,
        "decisions": applied_decisions(plan, facilities, conflicts),
        "stored": {"facility", "course"},
    }


def receipts_of(before: dict, tables: dict) -> dict:
    """A receipt per table; those that the run leaves alone are not compared and have an empty one."""
    found = {}
    for name, key in _keys(before).items():
        sides = [before[name].where("false")] * 2 if tables[name] is before[name] else [before[name], tables[name]]
        found[name] = receipt(*sides, key)
    return found


def written(before: dict, result: dict) -> dict:
    """The run with its tables written once, and receipts taken from these and written too."""
    before = before | {"destination": keyed_destinations(before["destination"])}
    done = {name: rows if rows is before.get(name) or name in result["stored"] else settle(rows, name) for name, rows in result["tables"].items()}
    receipts = {name: settle(rows, "receipt") for name, rows in receipts_of(before, done).items()}
    return result | {"tables": done, "receipts": receipts, "decisions": settle(result["decisions"], "applied")}


def _keys(bundle: dict) -> dict:
    return {name: key for name, key in _KEYS.items() if name in bundle}


def refreshed_metadata(metadata: DataFrame, tables: dict) -> DataFrame:
    """The catalog's own facts (key, value) after a run: the next revision, and the counts it keeps."""
    counts = [
        tables[name].agg(F.count("*").alias(plural), F.count_if(F.col("name").isNull()).alias("unnamed_" + plural))
        for name, plural in (("facility", "facilities"), ("course", "courses"))
    ]
    fresh = reduce(DataFrame.unionByName, [c.select(F.inline(F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("fresh")) for n in c.columns]))) for c in counts])
    value = F.when(F.col("key") == "revision", (F.col("value").cast("long") + 1).cast("string")).otherwise(F.coalesce("fresh", "value"))
    return metadata.join(fresh, "key", "left").select("key", value.alias("value"))


def applied_decisions(plan: DataFrame, facilities: DataFrame, conflicts: DataFrame) -> DataFrame:
    """The plan's decisions with the source row as it was, its digest, and the digest of what disagreed."""
    source = facilities.select(
        F.col("facility_id").alias("source_id"), F.struct(*facilities.columns).alias("source_snapshot"), canon.rows_digest(facilities).alias("source_snapshot_sha256")
    )
    clashes = canon.group_digest(conflicts, "ordinal", *sorted(conflicts.columns)).withColumnRenamed("group_digest", "conflicts_sha256")
    return join_dealt(join_dealt(plan, source, "source_id", "left"), clashes, "ordinal", "left")


def restored(result: dict) -> dict:
    """Every table as it was before `apply`."""
    return {name: restore(result["tables"][name], result["receipts"][name], key) for name, key in _keys(result["receipts"]).items()}


def check_receipts(result: dict) -> DataFrame:
    found = [
        receipt_violations(result["tables"][name], result["receipts"][name], key).select(F.lit(name).alias("table"), F.col(key).alias("id"), "rule")
        for name, key in _keys(result["receipts"]).items()
    ]
    return reduce(DataFrame.unionByName, found)


# --- the sealed receipt ------------------------------------------------------------------------


def lanes_of(tables: dict) -> DataFrame:
    """item, n and lane sums of each table: one scan of each."""
    return reduce(DataFrame.unionByName, [canon.table_lanes(rows).select(F.lit(name).alias("item"), "*") for name, rows in tables.items()])


def _change_lanes(receipts: dict) -> DataFrame:
    """item, n and lane sums by which each table has changed, from the receipts alone."""
    parts = []
    for name, record in receipts.items():
        rows = record.select(F.inline(F.array(F.struct(F.lit(-1).alias("sign"), F.col("before_sha256").alias("digest")), F.struct(F.lit(1).alias("sign"), F.col("after_sha256").alias("digest")))))
        total = rows.where("digest is not null").agg(*canon.lane_sums(F.col("sign")))
        parts.append(total.select(F.lit(name).alias("item"), *[F.coalesce(n, F.lit(0)).alias("c_" + n) for n in canon.LANES]))
    return reduce(DataFrame.unionByName, parts)


def _fixed_parts(plan: DataFrame, decisions: DataFrame) -> DataFrame:
    return lanes_of({"plan": plan, "decisions": decisions}).select("item", canon.lanes_digest().alias("sha256"))


def whole_digest(rows: DataFrame, *columns) -> DataFrame:
    """One row for the catalog: the digest of all its tables' digests."""
    listed = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("item", F.lit("="), c))), ","), 256).alias(c)
    return rows.agg(*[listed(c) for c in columns]).select(F.lit("catalog").alias("item"), *columns)


def seal(before_lanes: DataFrame, receipts: dict, plan: DataFrame, decisions: DataFrame) -> DataFrame:
    """item, before_sha256, after_sha256 of every table (with rows_before, rows_after), of the catalog,
    the plan and the decisions.

    `before_lanes` are lanes_of the tables before the run, kept from the version that made them. A
    table's digest after the run is its lanes before it, less those of the rows that went and with
    those of the rows that came: no table is read again.
    """
    both = before_lanes.join(_change_lanes(receipts), "item")
    before = both.select("item", F.col("n").alias("rows_before"), canon.lanes_digest().alias("before_sha256"), *[(F.col(n) + F.col("c_" + n)).alias(n) for n in canon.LANES])
    tables = settle(before.select("item", "rows_before", F.col("n").alias("rows_after"), "before_sha256", canon.lanes_digest().alias("after_sha256")), "sealed")
    fixed_parts = _fixed_parts(plan, decisions).select("item", F.col("sha256").alias("before_sha256"), F.col("sha256").alias("after_sha256"))
    return tables.unionByName(whole_digest(tables, "before_sha256", "after_sha256").unionByName(fixed_parts), allowMissingColumns=True)


def seal_violations(result: dict, sealed: DataFrame) -> DataFrame:
    """(item, id, rule): what is no longer as the receipt says, and what can't be taken back to the baseline.

    All tables are read and digested, whether the run touched them or not, so tampering with any row of
    any table is found. The baseline follows from these digests and the receipts by subtraction.
    """
    now = settle(lanes_of({name: result["tables"][name] for name in _keys(result["receipts"])}), "lanes")
    both = now.join(_change_lanes(result["receipts"]), "item")
    back = both.select("item", canon.lanes_digest().alias("now"), *[(F.col(n) - F.col("c_" + n)).alias(n) for n in canon.LANES])
    back = settle(back.select("item", "now", canon.lanes_digest().alias("back")), "back")
    parts = _fixed_parts(result["plan"], result["decisions"]).select("item", F.col("sha256").alias("now"), F.col("sha256").alias("back"))
    found = back.unionByName(whole_digest(back, "now", "back")).unionByName(parts)
    joined = sealed.join(found, "item", "full_outer")
    rule = F.when(~F.col("now").eqNullSafe(F.col("after_sha256")), "digest after the run changed").when(
        ~F.col("back").eqNullSafe(F.col("before_sha256")), "baseline digest not reached"
    )
    whole = joined.select("item", F.lit(None).cast("string").alias("id"), rule.alias("rule")).where("rule is not null")
    kept = result["decisions"].where("source_snapshot is not null")
    snapshot = canon.struct_digest(result["decisions"].schema["source_snapshot"].dataType, lambda n: F.col("source_snapshot")[n])
    changed = kept.where(snapshot != F.col("source_snapshot_sha256")).select(F.lit("decisions").alias("item"), F.col("source_id").alias("id"), F.lit("source snapshot changed").alias("rule"))
    return whole.unionByName(check_receipts(result).withColumnRenamed("table", "item")).unionByName(changed)


def restore_proved(result: dict, sealed: DataFrame) -> dict:
    """Every table as it was, read once more and compared with the sealed baseline by equality.

    Raises ValueError naming the first item that is not as the receipt says.
    """
    broken = seal_violations(result, sealed).orderBy("item", "id").first()
    if broken:
        raise ValueError(f"{broken['item']}: {broken['rule']}" + (f" ({broken['id']})" if broken["id"] else ""))
    tables = {name: settle(rows, "restored") for name, rows in restored(result).items()}
    digests = lanes_of(tables).select("item", canon.lanes_digest().alias("found"))
    wrong = digests.join(sealed, "item").where("found <> before_sha256").orderBy("item").first()
    if wrong:
        raise ValueError(f"{wrong['item']}: baseline not restored")
    return tables
