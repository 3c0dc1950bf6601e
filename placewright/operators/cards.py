"""Course and facility cards: parent columns, derived facts, and nested children in bounded parts."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.text import access_label, filled, lookup, record_label
from .. import fixed
from ..session import settle
from .joins import join_known
from .ordering import number_rows

# The parts of an address.
ADDRESS_FIELDS = ["text", "purpose", "street_line1", "street_line2", "city", "region", "postal_code", "country"]
PART_ROWS = 10_000


def address_block(scope: str, prefix="address_", missing=()) -> Column:
    """Address struct of one record, or NULL where nothing is known."""
    values = {
        name: F.lit(None).cast("string") if name in missing else F.col(prefix + name) for name in ADDRESS_FIELDS
    }
    block = F.struct(*[v.alias(n) for n, v in values.items()], F.lit(scope).alias("scope"))
    return F.when(F.coalesce(*values.values()).isNotNull(), block)


def booleans(rows: DataFrame, names) -> DataFrame:
    """Stored 0/1 to booleans; unknown stays NULL."""
    return rows.withColumns({name: F.col(name).cast("boolean") for name in names})


def eligibility():
    """Whether a course may be planned, and why; NULL where access is unknown."""
    known, access = F.col("nonmember_bookable"), F.col("access")
    eligible = (
        F.when(known.isNotNull(), known)
        .when(access == "public", True)
        .when(access.isNotNull(), False)
    )
    basis = (
        F.when(known.isNotNull(), "explicit_nonmember_fact")
        .when(access == "public", "accepted_public_play_with_qualification")
        .otherwise("unknown_or_nonpublic_access")
    )
    return eligible.alias("plan_eligible"), basis.alias("planning_basis")


def course_listing(courses: DataFrame, facilities: DataFrame, how="inner") -> DataFrame:
    """Courses with their facility's columns, address, arrival, destination and eligibility."""
    parents = facilities.select(
        "facility_id",
        F.col("name").alias("facility_name"),
        "state",
        "country",
        "county",
        F.col("access").alias("facility_access"),
        F.col("operating_status").alias("facility_operating_status"),
        F.col("physical_holes").alias("facility_physical_holes"),
        "inventory_complete",
        F.col("website").alias("facility_website"),
        geo.point(F.col("latitude"), F.col("longitude"), F.col("location_kind")).alias("map_location"),
        address_block("facility").alias("facility_address"),
    )
    listed = join_known(courses, parents, "facility_id") if how == "left" else courses.join(parents, "facility_id", how)
    missing = [n for n in ADDRESS_FIELDS if "address_" + n not in courses.columns]
    address = F.when(F.col("address_mode") == "inherit", F.col("facility_address")).when(
        F.col("address_mode") == "override", address_block("course", missing=missing)
    )
    arrival = F.when(
        F.col("arrival_latitude").isNotNull(),
        F.struct(
            F.col("arrival_latitude").alias("latitude"),
            F.col("arrival_longitude").alias("longitude"),
            F.col("arrival_kind").alias("kind"),
            F.col("arrival_reference").alias("reference"),
        ),
    )
    return (
        listed.withColumn("address", address)
        .drop("facility_address")
        .withColumn("arrival", arrival)
        .withColumn("destination", destination())
        .withColumn("destination_id", F.col("destination.id"))
        .select("*", *eligibility(), F.col("booking_conditions").alias("access_qualification"))
    )


def destination() -> Column:
    """The course's own arrival, else the facility's estimate, else nothing."""
    none = F.lit(None).cast("string")
    own = F.struct(
        F.col("course_id").alias("id"),
        F.col("arrival.latitude").alias("latitude"),
        F.col("arrival.longitude").alias("longitude"),
        F.col("arrival.kind").alias("precision"),
        F.col("arrival.reference").alias("reference"),
        F.lit("course_arrival").alias("scope"),
        none.alias("qualification"),
    )
    estimate = F.struct(
        F.col("facility_id").alias("id"),
        F.col("map_location.latitude").alias("latitude"),
        F.col("map_location.longitude").alias("longitude"),
        F.col("map_location.kind").alias("precision"),
        none.alias("reference"),
        F.lit("facility_estimate").alias("scope"),
        F.lit("approximate planning estimate; does not establish an entrance").alias("qualification"),
    )
    return F.when(F.col("arrival").isNotNull(), own).when(F.col("map_location").isNotNull(), estimate)


def destinations(listed: DataFrame):
    """Distinct destinations by id, and the ids whose copies disagree."""
    shared = (
        listed.where(F.col("destination").isNotNull())
        .groupBy("destination.id")
        .agg(
            F.min("destination").alias("destination"),
            (F.min("destination") != F.max("destination")).alias("conflicting"),
        )
    )
    good = shared.where(~F.col("conflicting")).select("destination.*")
    return good, shared.where("conflicting").select("id")


def browse_cards(listed: DataFrame) -> DataFrame:
    basis = (
        F.when(F.col("destination.scope") == "facility_estimate", "approximate_facility_point")
        .when(F.col("destination").isNotNull(), "reviewed_course_arrival")
        .otherwise("arrival_unavailable")
    )
    identity = F.coalesce("facility_id", "course_id")
    return listed.select(
        F.col("course_id").alias("id"),
        "facility_id",
        record_label(F.col("name"), F.col("facility_name"), identity, "course").alias("name"),
        F.col("name").alias("course_name"),
        "facility_name",
        "state",
        F.col("physical_holes").alias("holes"),
        "style",
        "game_kind",
        "identity_status",
        access_label(F.col("access")).alias("access"),
        "booking_conditions",
        "nonmember_bookable",
        "plan_eligible",
        "planning_basis",
        F.coalesce("website", "facility_website").alias("website"),
        F.col("map_location.latitude").alias("latitude"),
        F.col("map_location.longitude").alias("longitude"),
        F.col("destination.precision").alias("destination_kind"),
        basis.alias("routing_basis"),
    )


def map_records(facilities: DataFrame, courses: DataFrame) -> DataFrame:
    """Facilities, and courses without a facility standing for themselves."""
    orphans = courses.where(F.col("facility_id").isNull()).withColumn("facility_id", F.col("course_id"))
    return facilities.withColumn("record_kind", F.lit("facility")).unionByName(
        orphans.withColumn("record_kind", F.lit("course")), allowMissingColumns=True
    )


def flat_facts(rows: DataFrame, domain: str, key: str, fields, known_only=True) -> DataFrame:
    """One row per recorded field of an observation; optionally unknown ones as Unconfirmed."""
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in fields])
    if known_only:
        pairs = F.filter(pairs, lambda p: p["value"].isNotNull())
    flat = rows.select(F.lit(domain).alias("domain"), F.col(key).alias("id"), F.explode(pairs).alias("p"))
    return flat.select("domain", "id", "p.field", F.coalesce("p.value", F.lit("Unconfirmed")).alias("value"))


def facility_facts(facilities: DataFrame) -> DataFrame:
    """The facility's headline facts in fixed order; unknown ones say so."""
    unknown = F.lit("not recorded")
    town = filled(F.concat_ws(", ", F.coalesce("address_city", unknown), filled(F.col("state"))))
    facts = [
        ("Town", town),
        ("Website", F.col("website")),
        ("Access", lookup(F.col("access"), fixed.ACCESS_LABELS)),
        ("Facility holes", F.concat(F.col("physical_holes").cast("string"), F.lit(" holes"))),
    ]
    listed = F.array(
        *[
            F.struct(F.lit(at).alias("at"), F.lit(label).alias("label"), F.coalesce(value, unknown).alias("value"))
            for at, (label, value) in enumerate(facts, 1)
        ]
    )
    return facilities.select("facility_id", F.inline(listed))


def _slots(columns, rows: DataFrame, width: int):
    """Order columns as (text, number) slots, so that lists of different orders sort as one table."""
    slots = []
    for name in columns:
        kind = rows.schema[name].dataType.typeName()
        if kind not in ("string", "byte", "short", "integer", "long"):
            raise ValueError(f"cannot order children by {name}: {kind}")
        text, number = (F.col(name), F.lit(None)) if kind == "string" else (F.lit(None), F.col(name))
        slots += [text.cast("string").alias(f"t{len(slots)}"), number.cast("long").alias(f"n{len(slots)}")]
    while len(slots) < 2 * width:
        slots += [F.lit(None).cast("string").alias(f"t{len(slots)}"), F.lit(None).cast("long").alias(f"n{len(slots)}")]
    return F.struct(*slots)


def nest_lists(key: str, lists: dict, limit=PART_ROWS) -> DataFrame:
    """Several child lists as arrays (key, part, and a column per list), in one pass.

    `lists` is name -> (children, order, item); `order` are the names of text or whole-number
    columns and ends in a unique one. All lists are one tagged table, grouped once by parent and
    part. Part n holds each list's children at positions n * limit and on: only the children of a
    crowded (parent, list) are put into global order to find these, and all others are part 0, so
    no task and no row ever holds an unbounded group.
    """
    width = max(len(order) for _, order, _ in lists.values())
    tagged = []
    for tag, (name, (children, order, item)) in enumerate(lists.items()):
        rows = children.where(F.col(key).isNotNull())
        tagged.append(rows.select(key, F.lit(tag).alias("tag"), _slots(order, rows, width).alias("at"), item.alias("i_" + name)))
    rows = settle(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tagged), "children")
    crowded = rows.groupBy(key, "tag").agg(F.count("*").alias("n")).where(F.col("n") > limit).select(key, "tag")
    # Without a crowded list all is part 0, and grouped by the key alone: joins on it find the rows where they are.
    placed, by, part = rows.withColumn("part", F.lit(0)), [key], F.lit(0).alias("part")
    if crowded.limit(1).count():
        by, part = [key, "part"], F.col("part")
        crowded = settle(crowded, "crowded")
        ordered = number_rows(rows.join(crowded, [key, "tag"], "left_semi"), [F.col(key), F.col("tag"), F.col("at")])
        # One narrow row per parent and list; one with very many children may be split by the join.
        first = ordered.groupBy(key, "tag").agg(F.min("position").alias("first"))
        at = F.floor((F.col("position") - F.col("first")) / limit).cast("int")
        parts = ordered.join(first, [key, "tag"]).withColumn("part", at).select(*placed.columns)
        placed = rows.join(crowded, [key, "tag"], "left_anti").withColumn("part", F.lit(0)).select(*placed.columns).unionByName(parts)
    # Each list is gathered on its own, so that one nobody looks at isn't, and sorted by the order Spark gives its rows.
    own = [F.collect_list(F.when(F.col("tag") == tag, F.struct("at", "i_" + name))).alias("l_" + name) for tag, name in enumerate(lists)]
    grouped = placed.groupBy(*by).agg(*own)
    sorted_items = {name: F.sort_array("l_" + name).getField("i_" + name) for name in lists}
    return grouped.select(key, part, *[F.when(F.size("l_" + name) > 0, items).alias(name) for name, items in sorted_items.items()])


def nest(children: DataFrame, key: str, order, item: Column, limit=PART_ROWS) -> DataFrame:
    """Children as arrays (key, part, items), in `order` inside a part and from part to part."""
    return nest_lists(key, {"items": (children, order, item)}, limit)


def attach(parents: DataFrame, key: str, nested: dict) -> DataFrame:
    """Cards with nested arrays: one row per parent, and a row per further part of its children.

    The parent's own columns are on part 0 only, a missing child list is an empty array; both hold
    for every parent alike. `nested` is name -> a frame of `nest`.
    """
    sides = [frame.withColumnRenamed("items", name) for name, frame in nested.items()]
    return _attached(parents, key, reduce(lambda left, right: left.join(right, [key, "part"], "full_outer"), sides), list(nested))


def attach_lists(parents: DataFrame, key: str, lists: dict, limit=PART_ROWS) -> DataFrame:
    """As `attach`, for lists that are nested together (see nest_lists)."""
    return _attached(parents, key, nest_lists(key, lists, limit), list(lists))


def _attached(parents, key, children, names):
    base = parents.withColumn("part", F.lit(0)).withColumn("own", F.lit(True))
    # Children of an unknown parent are key violations, not cards; a parent's further parts are.
    first = base.join(children, [key, "part"], "left")
    more = children.where("part > 0").join(parents.select(key), key, "left_semi")
    kept = first.drop("own").unionByName(more, allowMissingColumns=True)
    kinds = {name: children.schema[name].dataType for name in names}
    return kept.withColumns({name: F.coalesce(F.col(name), F.array().cast(kind)) for name, kind in kinds.items()})


def membership(rounds: DataFrame, members: DataFrame, components: DataFrame) -> DataFrame:
    """Distinct (round, course): owner, member course, or the course of a member component."""
    owned = rounds.where(F.col("course_id").isNotNull()).select("round_id", "course_id")
    part = components.select("component_id", F.col("course_id").alias("part_course"))
    played = join_known(members, part, "component_id").select(
        "round_id", F.coalesce("course_id", "part_course").alias("course_id")
    )
    return owned.unionByName(played.where(F.col("course_id").isNotNull())).distinct()


def detail_parts(courses, rounds, members, components, tees):
    """Tees of each course and of its rounds (named), and what `other_rounds` needs."""
    belongs = membership(rounds, members, components)
    own = tees.where(F.col("course_id").isNotNull()).select(
        "course_id", "tee_id", F.lit(None).cast("string").alias("round_name")
    )
    named = rounds.select("round_id", F.col("name").alias("round_name"))
    by_round = (
        belongs.join(tees.where(F.col("round_id").isNotNull()).select("round_id", "tee_id"), "round_id")
        .join(named, "round_id")
        .select("course_id", "tee_id", "round_name")
    )
    return own.unionByName(by_round), (rounds, belongs)


def other_rounds(courses: DataFrame, rounds: DataFrame, belongs: DataFrame) -> DataFrame:
    """How many rounds of its facility are not already the course's own.

    Counted as all rounds of the facility less the shared ones, so a facility with many courses
    and many rounds never forms pairs.
    """
    offered = rounds.where(F.col("facility_id").isNotNull())
    totals = offered.groupBy("facility_id").agg(F.count("*").alias("offered"))
    shared = (
        belongs.join(offered.select("round_id", F.col("facility_id").alias("round_facility")), "round_id")
        .join(courses, "course_id")
        .where(F.col("round_facility") == F.col("facility_id"))
        .groupBy("course_id")
        .agg(F.count("*").alias("shared"))
    )
    zero = F.lit(0)
    return (
        courses.join(totals, "facility_id")
        .join(shared, "course_id", "left")
        .select("course_id", (F.col("offered") - F.coalesce("shared", zero)).alias("other_facility_rounds"))
    )


def facility_rounds(courses: DataFrame, rounds: DataFrame, belongs: DataFrame, limit=PART_ROWS):
    """A facility's rounds, listed once, and per course the ones among them that are its own.

    A course's other rounds are the first list less the second, so a facility with many courses
    and many rounds never forms pairs.
    """
    offered = rounds.where(F.col("facility_id").isNotNull())
    listed = nest(offered, "facility_id", ["round_id"], F.struct("round_id", "name", "round_holes", "description"), limit)
    own = (
        belongs.join(offered.select("round_id", F.col("facility_id").alias("round_facility")), "round_id")
        .join(courses, "course_id")
        .where(F.col("round_facility") == F.col("facility_id"))
    )
    return listed, nest(own, "course_id", ["round_id"], F.col("round_id"), limit)


def inventory(courses: DataFrame, limit=PART_ROWS) -> DataFrame:
    """Per facility the inventory array in parts; the course and documented counts stand on part 0."""
    fields = ["course_id", "name", "physical_holes", "identity_status", "access", "nonmember_bookable"]
    items = nest(courses, "facility_id", ["course_id"], F.struct(*fields), limit)
    counts = courses.groupBy("facility_id").agg(
        F.count("*").alias("course_count"),
        F.count_if(F.col("identity_status") == "operator_defined").alias("documented_course_count"),
    )
    documented = F.filter("items", lambda c: F.coalesce(c["identity_status"] == "operator_defined", F.lit(False)))
    return items.join(counts, "facility_id").select(
        "facility_id",
        "part",
        F.when(F.col("part") == 0, F.col("course_count")).alias("course_count"),
        F.when(F.col("part") == 0, F.col("documented_course_count")).alias("documented_course_count"),
        F.col("items").alias("course_inventory"),
        F.transform("items", lambda c: c["course_id"]).alias("course_ids"),
        F.transform(documented, lambda c: c["course_id"]).alias("documented_course_ids"),
    )


def facility_inventory(facilities: DataFrame, courses: DataFrame, limit=PART_ROWS) -> DataFrame:
    """Every facility with its inventory; an empty one has zero counts and empty arrays."""
    listed = inventory(courses, limit)
    joined = facilities.select("facility_id").join(listed, "facility_id", "left")
    kinds = {f.name: f.dataType for f in listed.schema}
    empty = {
        n: F.coalesce(F.col(n), F.array().cast(kinds[n]))
        for n in ["course_inventory", "course_ids", "documented_course_ids"]
    }
    none = F.col("part").isNull()
    zero = {n: F.when(none, 0).otherwise(F.col(n)) for n in ["course_count", "documented_course_count"]}
    zero["part"] = F.coalesce("part", F.lit(0))
    return joined.withColumns(empty | zero)


def course_cards(bundle: dict, limit=PART_ROWS, lists=None, belongs=None) -> DataFrame:
    """Course cards with components, tees, aliases and rounds nested.

    `belongs` is the membership of the courses, where it is known already.

    What a course's rounds hold, members in playing order and tees, stands beside them under the
    round's id, so that a crowded round comes in parts like any other list.
    """
    listed = course_listing(bundle["course"], bundle["facility"], "left")
    if belongs is None:
        belongs = membership(bundle["round_option"], bundle["round_component"], bundle["component"])
    rounds = bundle["round_option"].drop("course_id").join(belongs, "round_id")
    shown_round = F.struct(
        "round_id",
        "name",
        "round_holes",
        "description",
        F.when(F.col("facility_id").isNotNull(), "facility").otherwise("course").alias("scope"),
    )
    children = {
        "components": (bundle["component"], ["component_id"], F.struct("component_id", "name", "physical_holes")),
        "tee_sets": (bundle["tee_set"], ["tee_id"], F.struct("tee_id", "name", "yardage", "yardage_unit", "par", "slope")),
        "aliases": (bundle["alias"], ["alias_id"], F.struct("alias_id", "name")),
        "round_options": (rounds, ["round_id"], shown_round),
        "round_members": (
            bundle["round_component"].select("round_id", "member_id", "ordinal", "component_id", F.col("course_id").alias("member_course"), "repetitions").join(belongs, "round_id"),
            ["round_id", "ordinal", "member_id"],
            F.struct("round_id", "ordinal", "member_id", "component_id", F.col("member_course").alias("course_id"), "repetitions"),
        ),
        "round_tee_sets": (
            bundle["tee_set"].where("round_id is not null").drop("course_id").join(belongs, "round_id"),
            ["round_id", "tee_id"], F.struct("round_id", "tee_id", "name", "yardage", "yardage_unit", "par", "slope"),
        ),
    }
    return attach_lists(listed, "course_id", {name: made for name, made in children.items() if lists is None or name in lists}, limit)


def facility_cards(bundle: dict, limit=PART_ROWS) -> DataFrame:
    """Facility cards with address, map point, inventory, own rounds and aliases nested."""
    fields = ["course_id", "name", "physical_holes", "identity_status", "access", "nonmember_bookable"]
    facilities = bundle["facility"]
    missing = [n for n in ADDRESS_FIELDS if "address_" + n not in facilities.columns]
    shown = facilities.withColumns({
        "map_location": geo.point(F.col("latitude"), F.col("longitude"), F.col("location_kind")),
        "address": address_block("facility", missing=missing),
    })
    rounds, aliases = bundle["round_option"], bundle["alias"]
    lists = {
        "course_inventory": (bundle["course"], ["course_id"], F.struct(*fields)),
        "round_options": (rounds, ["round_id"], F.struct("round_id", "name", "round_holes", "description")),
        "aliases": (aliases, ["alias_id"], F.struct("alias_id", "name")),
    }
    return attach_lists(shown, "facility_id", lists, limit)


def cards_of(bundle: dict, course_ids: DataFrame, limit=PART_ROWS) -> DataFrame:
    """Cards of some courses only, as after a change: every table is cut down before nesting."""
    part = dict(bundle)
    for name in ("course", "component", "alias"):
        part[name] = bundle[name].join(course_ids, "course_id", "left_semi")
    part["tee_set"] = bundle["tee_set"].join(course_ids, "course_id", "left_semi")
    # A member component may belong to a course that is not asked for, so membership is that of the whole tables,
    # found once; what it says of other courses is no card's.
    belongs = membership(bundle["round_option"], bundle["round_component"], bundle["component"])
    belongs = settle(belongs.join(course_ids, "course_id", "left_semi"), "belongs")
    part["component"] = part["component"].dropDuplicates(["component_id"])
    return course_cards(part, limit, belongs=belongs).join(course_ids, "course_id", "left_semi")


def facility_cards_of(bundle: dict, facility_ids: DataFrame, limit=PART_ROWS) -> DataFrame:
    """Cards of some facilities only, as after a change: every table is cut down before nesting."""
    names = ("facility", "course", "round_option", "alias")
    return facility_cards(bundle | {name: bundle[name].join(facility_ids, "facility_id", "left_semi") for name in names}, limit)


def round_cards(bundle: dict, limit=PART_ROWS) -> DataFrame:
    """Rounds with their members in playing order and their tees."""
    rounds = bundle["round_option"].withColumn(
        "scope", F.when(F.col("facility_id").isNotNull(), "facility").otherwise("course")
    )
    member = F.struct("member_id", "ordinal", "component_id", "course_id", "repetitions")
    lists = {
        "members": (bundle["round_component"], ["ordinal", "member_id"], member),
        "tee_sets": (bundle["tee_set"], ["tee_id"], F.struct("tee_id", "name", "yardage")),
    }
    return attach_lists(rounds, "round_id", lists, limit)
