"""Row rules, key rules and reference rules; every check yields (rule, table, id, detail)."""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed, schemas
from ..functions.canon import strict_date, valid_url
from ..session import settle
from .joins import join_known, join_stored


def _window(names):
    start, end, over = names.split(",")
    return (
        f"{start} is null or {end} is null or ({over} is not null and"
        f" case when {over} then {end} <= {start} else {end} >= {start} end)"
    )


def _field_rule(name, kind):
    """SQL text of one field's rule, or None where the column type already says it."""
    if kind in ("flag", "text"):
        return None
    if kind == "date":
        return None
    shape, *rest = kind
    if shape == "one of":
        return f"{name} in ({', '.join(repr(v) for v in rest[0])})"
    if shape in ("whole", "real"):
        low, high = rest
        return f"{name} >= {low}" if high is None else f"{name} between {low} and {high}"
    if shape == "above":
        return f"{name} > {rest[0]}"
    if shape == "longest":
        return f"length({name}) <= {rest[0]}"
    if shape == "code":
        return f"{name} rlike '^[A-Z]{{{rest[0]}}}$'"
    longest = "" if rest[0] is None else f" and length({name}) <= {rest[0]}"
    return f"length(trim({name})) > 0{longest}"


def row_rules(table: str, columns) -> dict:
    """Rules of a table that its columns can state: rule name -> SQL condition."""
    columns = set(columns)
    fields = (schemas.CORE | schemas.DOMAINS).get(table, {})
    rules = {}
    for name, kind in fields.items():
        text = _field_rule(name, kind)
        if name in columns and text:
            rules[name] = text
    for name in schemas.REQUIRED.get(table, []):
        if name in columns:
            rules[name + " required"] = f"{name} is not null"
    subjects = [s for s in schemas.SUBJECTS.get(table, []) if s in columns]
    if len(subjects) > 1:
        known = " + ".join(f"cast({s} is not null as int)" for s in subjects)
        rules["exactly one subject"] = f"{known} = 1"
    for name, text in schemas.ROW_RULES.get(table, {}).items():
        window = re.fullmatch(r"\{window:(.*)\}", text)
        if window:
            text = _window(window[1])
        if "{address}" in text:
            present = [c for c in schemas.ADDRESS_COLUMNS if c in columns]
            if not present:
                continue
            text = text.replace("{address}", ", ".join(present))
        words = set(re.findall(r"\b[a-z][a-z_]*\b", re.sub(r"'[^']*'", "", text)))
        stated = {w for w in words if w in fields or w.endswith("_id")}
        if stated <= columns:
            rules[name] = text
    return rules


def check_rows(rows: DataFrame, table: str, key: str, rules=None) -> DataFrame:
    """All broken rules of all rows in one pass; an unknown result passes, as in a SQL check."""
    rules = row_rules(table, rows.columns) if rules is None else rules
    broken = F.array_compact(F.array(*[F.when(F.expr(f"({text}) is false"), F.lit(name)) for name, text in rules.items()]))
    return rows.select(
        F.explode(broken).alias("rule"), F.lit(table).alias("table"), F.col(key).alias("id"), F.lit(None).cast("string").alias("detail")
    )


def check_finite(rows: DataFrame, table: str, key: str) -> DataFrame:
    names = [f.name for f in rows.schema if f.dataType.typeName() in ("double", "float")]
    bad = [
        F.when(F.isnan(n) | (F.abs(n) > 1.7976931348623157e308), F.lit(n)) for n in names
    ]
    return rows.select(
        F.lit("finite number").alias("rule"), F.lit(table).alias("table"), F.col(key).alias("id"), F.explode(F.array_compact(F.array(*bad))).alias("detail")
    )


def check_unique(rows: DataFrame, table: str, keys, where=None) -> DataFrame:
    """Repeated keys. A NULL in any key is not a repeat, so such rows are left out."""
    known = rows if where is None else rows.where(where)
    for key in keys:
        known = known.where(F.col(key).isNotNull())
    repeated = known.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)
    return repeated.select(
        F.lit("unique " + ",".join(keys)).alias("rule"),
        F.lit(table).alias("table"),
        F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("id"),
        F.col("copies").cast("string").alias("detail"),
    )


def check_present(rows: DataFrame, table: str, key: str) -> DataFrame:
    """Rows without a usable id."""
    missing = F.coalesce(F.col(key).cast("string"), F.lit("")) == ""
    return rows.where(missing).select(
        F.lit("missing id").alias("rule"), F.lit(table).alias("table"), F.col(key).cast("string").alias("id"), F.lit(None).cast("string").alias("detail")
    )


def check_references(bundle: dict, only: dict | None = None) -> DataFrame | None:
    """Every reference of the layout that points nowhere; `only` limits the rows that refer.

    The references to one parent, from all tables and columns, are one list, which meets the
    parent's keys in one join.
    """
    rows, by_parent = bundle if only is None else only, {}
    for child, columns in schemas.REFERENCES.items():
        if child not in rows:
            continue
        for column, parent in columns.items():
            if parent not in bundle or column not in rows[child].columns:
                continue
            stated = rows[child].where(F.col(column).isNotNull()).select(
                F.lit(f"{column} in {parent}").alias("rule"), F.lit(child).alias("table"), F.col(schemas.KEYS[child]).alias("id"), F.col(column).alias("detail")
            )
            by_parent.setdefault(parent, []).append(stated)
    found = []
    for parent, parts in by_parent.items():
        known = bundle[parent].select(F.col(schemas.KEYS[parent]).alias("detail"))
        found.append(reduce(DataFrame.unionByName, parts).join(known, "detail", "left_anti").select("rule", "table", "id", "detail"))
    return reduce(DataFrame.unionByName, found) if found else None


def check_inventory(facilities: DataFrame, courses: DataFrame) -> DataFrame:
    """Complete facilities whose courses, all known, do not add up to the facility's holes."""
    counted = (
        courses.where((F.col("identity_status") != "component") & F.col("facility_id").isNotNull())
        .groupBy("facility_id")
        .agg(F.count("*").alias("n"), F.count("physical_holes").alias("known"), F.sum("physical_holes").alias("holes"))
        .where(F.col("n") == F.col("known"))
    )
    complete = facilities.where(F.col("inventory_complete") & F.col("physical_holes").isNotNull())
    wrong = complete.join(counted, "facility_id").where(F.col("holes") != F.col("physical_holes"))
    return wrong.select(
        F.lit("inventory matches holes").alias("rule"), F.lit("facility").alias("table"), F.col("facility_id").alias("id"), F.col("holes").cast("string").alias("detail")
    )


def check_round_scope(bundle: dict) -> DataFrame:
    """Members outside their round's facility, or outside the round's own course."""
    courses = bundle["course"].select("course_id", F.col("facility_id").alias("course_facility"))
    rounds = (
        join_known(bundle["round_option"], courses, "course_id")
        .select("round_id", F.col("course_id").alias("round_course"), F.coalesce("facility_id", "course_facility").alias("round_facility"))
    )
    part = bundle["component"].select("component_id", F.col("course_id").alias("part_course"))
    members = join_known(bundle["round_component"], part, "component_id").withColumn(
        "played", F.coalesce("course_id", "part_course")
    )
    owner = courses.select(F.col("course_id").alias("played"), F.col("course_facility").alias("member_facility"))
    placed = join_known(members, owner, "played").join(rounds, "round_id")
    wrong = (F.col("member_facility") != F.col("round_facility")) | (F.col("played") != F.col("round_course"))
    return placed.where(wrong).select(
        F.lit("round scope").alias("rule"), F.lit("round_component").alias("table"), F.col("member_id").alias("id"), F.lit(None).cast("string").alias("detail")
    )


def _round_owner(bundle):
    courses = bundle["course"].select(F.col("course_id").alias("round_course"), F.col("facility_id").alias("via_course"))
    rounds = bundle["round_option"].select("round_id", F.col("course_id").alias("round_course"), F.col("facility_id").alias("round_facility"))
    return join_stored(rounds, courses, "round_course").select(
        "round_id", "round_course", F.coalesce("round_facility", "via_course").alias("round_facility")
    )


def check_observation_scope(subjects: DataFrame, bundle: dict, belongs: DataFrame) -> DataFrame:
    """Facts whose subject lies outside what their evidence is about.

    `subjects` is the union of the domains; `belongs` is (round, course) membership, each pair once. Evidence is
    placed before it meets the facts, and facts whose evidence is about nothing can't contradict it. What each
    step leaves is written, so that disks hold the shuffles of one step and only rows still in question travel.
    """
    courses = bundle["course"].select("course_id", F.col("facility_id").alias("course_facility"))
    groups = join_stored(bundle["fact_group"], courses, "course_id").select(
        F.col("group_id").alias("retained_group_id"),
        F.col("course_id").alias("group_course"),
        F.coalesce("facility_id", "course_facility").alias("group_facility"),
    )
    evidence = bundle["source_observation"].select("observation_id", "retained_group_id", "retained_facility_id")
    about = join_stored(evidence, groups, "retained_group_id").where(F.coalesce("retained_facility_id", "group_course", "group_facility").isNotNull())
    about = about.select("observation_id", "retained_facility_id", "group_course", "group_facility")
    stated = subjects.select("observation_id", "id", "facility_id", "course_id", "round_id")
    placed = settle(stated.join(about, "observation_id").drop("observation_id"), "placed")
    placed = join_stored(join_stored(placed, courses, "course_id"), _round_owner(bundle), "round_id")
    owner = F.coalesce("facility_id", "course_facility", "round_facility")
    no = F.lit(False)
    other_facility = F.coalesce((owner != F.col("retained_facility_id")) | (owner != F.col("group_facility")), no)
    other_course = F.col("group_course").isNotNull() & (
        F.coalesce(F.col("course_id") != F.col("group_course"), no) | (F.col("course_id").isNull() & F.col("round_id").isNull())
    )
    by_round = F.col("group_course").isNotNull() & F.col("round_id").isNotNull() & ~F.coalesce(F.col("round_course") == F.col("group_course"), no)
    judged = placed.select("id", "round_id", "group_course", (other_facility | other_course).alias("wrong"), by_round.alias("by_round"))
    judged = settle(judged.where(F.col("wrong") | F.col("by_round")), "judged")
    support = belongs.select("round_id", F.col("course_id").alias("group_course"))
    unsupported = judged.where(~F.col("wrong")).join(support, ["round_id", "group_course"], "left_anti")
    return judged.where("wrong").select("id").unionByName(unsupported.select("id")).select(
        F.lit("observation scope").alias("rule"), F.lit("subject").alias("table"), "id", F.lit(None).cast("string").alias("detail")
    )


def check_price_bundle(prices: DataFrame, bundle: dict) -> DataFrame:
    """Bundle prices whose qualifying round belongs to another facility."""
    courses = bundle["course"].select("course_id", F.col("facility_id").alias("course_facility"))
    owners = _round_owner(bundle)
    prior = owners.select(F.col("round_id").alias("qualifying_prior_round_id"), F.col("round_facility").alias("prior_facility"))
    own = owners.select("round_id", "round_facility")
    bundled = prices.where(F.col("qualifying_prior_round_id").isNotNull()).join(prior, "qualifying_prior_round_id")
    placed = join_known(join_known(bundled, courses, "course_id"), own, "round_id")
    owner = F.coalesce("facility_id", "course_facility", "round_facility")
    return placed.where(owner != F.col("prior_facility")).select(
        F.lit("price bundle scope").alias("rule"), F.lit("price_observation").alias("table"), F.col("price_id").alias("id"), F.lit(None).cast("string").alias("detail")
    )


def check_observation_references(bundle: dict) -> DataFrame:
    """Observations whose retained group and retained facility disagree."""
    courses = bundle["course"].select("course_id", F.col("facility_id").alias("course_facility"))
    groups = join_known(bundle["fact_group"], courses, "course_id").select(
        F.col("group_id").alias("retained_group_id"), F.coalesce("facility_id", "course_facility").alias("group_facility")
    )
    both = bundle["source_observation"].join(groups, "retained_group_id")
    return both.where(F.col("retained_facility_id") != F.col("group_facility")).select(
        F.lit("observation references").alias("rule"), F.lit("source_observation").alias("table"), F.col("observation_id").alias("id"), F.lit(None).cast("string").alias("detail")
    )


def check_immutable(old: DataFrame, new: DataFrame, key: str, fields, used: DataFrame | None = None) -> DataFrame:
    """Fields that must not change between two versions; `used` limits the check to used ids."""
    after = new.select(key, *[F.col(f).alias("new_" + f) for f in fields])
    both = old.select(key, *fields).join(after, key)
    if used is not None:
        both = both.join(used.select(key).distinct(), key, "left_semi")
    changed = F.array_compact(
        F.array(*[F.when(~F.col(f).eqNullSafe(F.col("new_" + f)), F.lit(f)) for f in fields])
    )
    return both.select(
        F.lit("immutable").alias("rule"), F.lit(key).alias("table"), F.col(key).alias("id"), F.explode(changed).alias("detail")
    )


def value_kinds(table: str) -> dict:
    """Declared kind of each writable field: flag, whole, real, date or text. References are texts."""
    kinds = dict.fromkeys(schemas.REFERENCES.get(table, {}), "text")
    for name, kind in (schemas.CORE | schemas.DOMAINS)[table].items():
        shape = kind if isinstance(kind, str) else kind[0]
        kinds[name] = {"flag": "flag", "whole": "whole", "real": "real", "above": "real", "date": "date"}.get(shape, "text")
    return kinds


def check_values(changes: DataFrame, table: str, key: str, values: str) -> DataFrame:
    """Typing of incoming values, one JSON object per change: declared fields of the right kind."""
    kinds = value_kinds(table)
    pairs = changes.select(key, F.explode(F.from_json(values, "map<string,variant>")).alias("field", "value"))
    shape = F.schema_of_variant("value")
    declared = F.try_element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("field"))
    text = F.try_variant_get("value", "$", "string")
    is_text = shape == "STRING"
    dated = F.col("field").isin(fixed.DATE_FIELDS)
    linked = F.col("field").endswith("_url") | (F.col("field") == "website")
    number = shape.isin("BIGINT", "DOUBLE", "FLOAT") | shape.startswith("DECIMAL")
    rule = (
        F.when(declared.isNull(), "unknown field")
        .when(shape == "VOID", None)
        .when((declared == "flag") & (shape != "BOOLEAN"), "must be boolean")
        .when((declared == "whole") & (shape != "BIGINT"), "must be integer")
        .when((declared == "real") & ~number, "must be finite number")
        .when(declared.isin("text", "date") & ~is_text, "must be text")
        .when(declared.isin("text", "date") & ((F.trim(text) == "") | text.contains("\x00")), "must be nonblank text")
        .when(dated & strict_date(text).isNull(), "must be a date")
        .when(linked & ~valid_url(text), "must be a web link")
    )
    judged = pairs.select(rule.alias("rule"), F.lit(table).alias("table"), F.col(key).alias("id"), F.col("field").alias("detail"))
    return judged.where(F.col("rule").isNotNull())


def split_tail(values: Column, count: Column):
    """(head, tail) of a list whose last `count` items were appended later; NULL if it is too short."""
    good = (count >= 0) & (count <= F.size(values))
    head = F.slice(values, F.lit(1), F.size(values) - count)
    tail = F.slice(values, F.size(values) - count + 1, count)
    return F.when(good, head), F.when(good, tail)
