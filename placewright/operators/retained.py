"""Adding courses from retained evidence: every guard must be current, and the support complete.

In a batch the guards are judged as of each addition's place. Inventory digests are sums of lanes,
so the inventory after every change is the one before the batch plus a running sum of what changed;
no inventory is read again (`InBatch`).
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import canon

# The fields a retained course may bring.
WRITABLE = ["facility_id", "name", "physical_holes", "identity_status", "game_kind", "address_mode"]


def _map_differences(proposals: DataFrame, column: str, actual: DataFrame, name: str) -> DataFrame:
    """Ordinals whose map of id -> digest does not match `actual` (id, digest)."""
    wanted = proposals.select("ordinal", F.explode(column).alias("id", "wanted"))
    joined = wanted.join(actual, "id", "left")
    return joined.where(~F.col("wanted").eqNullSafe(F.col("digest"))).select("ordinal", F.lit(True).alias(name)).distinct()


def course_evidence_violations(
    proposals: DataFrame, seen: DataFrame, facilities: DataFrame, courses: DataFrame, evidence: DataFrame, notes: DataFrame, sources: DataFrame,
    held_ids: DataFrame, during: dict | None = None,
) -> DataFrame:
    """(ordinal, rule): the first rule each proposed course breaks.

    `during` says what a batch has done before each proposal, where there is one: "facility"
    (ordinal, f_name, f_holes, f_digest as they are by then), "has_courses" (ordinal, of a facility
    that has courses by then) and "moved" (ordinal, of an inventory that is no longer the one before
    the batch, additions apart).

    `proposals`: ordinal, facility_id, facility_digest, retained_evidence_digest, note_digests,
    support_indexes, source_digests, review_reference, extended (false for the single-course
    form) and values, a struct of WRITABLE plus other_fields. `seen`: ordinal, course_id, wanted,
    the inventory an extended proposal was made on, one row per course.
    `facilities`: facility_id, name, physical_holes, digest. `courses`: course_id, facility_id,
    digest. `evidence`: facility_id, digest, notes, support(fields, source, note), listed_sources.
    `notes`: id, digest. `sources`: source_id, digest, intake_policy.
    """
    facility = facilities.select(
        "facility_id", F.col("name").alias("f_name"), F.col("physical_holes").alias("f_holes"), F.col("digest").alias("f_digest")
    )
    kept = evidence.select(
        "facility_id", F.col("digest").alias("e_digest"), F.col("notes").alias("allowed_notes"), "support", "listed_sources"
    )
    owned = courses.where(F.col("facility_id").isNotNull())
    if during is None:
        has_courses = owned.select("facility_id").distinct().withColumn("has_courses", F.lit(True))
        base = proposals.join(facility, "facility_id", "left").join(has_courses, "facility_id", "left")
    else:
        has_courses = during["has_courses"].select("ordinal", F.lit(True).alias("has_courses"))
        base = proposals.join(during["facility"], "ordinal", "left").join(has_courses, "ordinal", "left")
    base = base.join(kept, "facility_id", "left")

    # The whole inventory before the batch must be what the proposal saw. Each facility's and each
    # proposal's inventory is summed up once, in one pass, so that no proposal meets every course.
    extended = proposals.where("extended").select("ordinal", "facility_id")
    actual = canon.group_digest(owned, "facility_id", "course_id", "digest").withColumnRenamed("group_digest", "now")
    stated = canon.group_digest(seen, "ordinal", "course_id", F.col("wanted").alias("digest")).withColumnRenamed("group_digest", "then")
    both = extended.join(actual, "facility_id", "left").join(stated, "ordinal", "left")
    inventory = both.where(~F.col("now").eqNullSafe(F.col("then"))).select("ordinal", F.lit(True).alias("inventory_changed"))
    if during is not None:
        inventory = inventory.unionByName(during["moved"].select("ordinal", F.lit(True).alias("inventory_changed")))
    inventory = inventory.distinct()

    note_stale = _map_differences(proposals, "note_digests", notes, "note_stale")
    source_ids = sources.select(F.col("source_id").alias("id"), "digest")
    source_stale = _map_differences(proposals, "source_digests", source_ids, "source_stale")
    policies = sources.select(F.col("source_id").alias("id"), "intake_policy").join(
        held_ids.select(F.col("source_id").alias("id")).distinct().withColumn("held", F.lit(True)), "id", "left"
    )
    guarded = proposals.select("ordinal", F.explode(F.map_keys("source_digests")).alias("id")).join(policies, "id")
    blocked = guarded.where((F.col("intake_policy") == "blocked") | F.col("held").isNotNull()).select("ordinal", F.lit(True).alias("source_blocked")).distinct()

    joined = base
    for part in (inventory, note_stale, source_stale, blocked):
        joined = joined.join(part, "ordinal", "left")

    note_ids = F.map_keys("note_digests")
    indexes = F.col("support_indexes")
    # Support that mentions holes or one of the notes must all be named, in order.
    relevant = F.filter(
        F.transform(
            "support",
            lambda s, i: F.when(
                F.array_contains(s["fields"], "physical_holes") | F.coalesce(F.arrays_overlap(s["note"], note_ids), F.lit(False)), i
            ),
        ),
        lambda i: i.isNotNull(),
    )
    chosen = F.filter("support", lambda s, i: F.array_contains(indexes, i))
    wanted_sources = F.array_distinct(F.array_compact(F.transform(chosen, lambda s: s["source"])))
    given_sources = F.map_keys("source_digests")
    same_sources = (F.size(F.array_except(wanted_sources, given_sources)) == 0) & (F.size(F.array_except(given_sources, wanted_sources)) == 0)
    unrelated = F.size(F.array_except(given_sources, "listed_sources")) > 0
    values = F.col("values")
    single = ~F.col("extended")
    holes = values["physical_holes"]
    single_values = (
        (values["name"].isNull() | values["name"].eqNullSafe(F.col("f_name"))) & holes.eqNullSafe(F.col("f_holes")) & F.coalesce(holes > 0, F.lit(False))
    )
    several_values = (values["name"].isNull() | (F.trim(values["name"]) != "")) & (holes.isNull() | (holes > 0))
    fixed_values = (
        F.coalesce(values["identity_status"] == "operator_defined", F.lit(False))
        & F.coalesce(values["game_kind"] == "golf", F.lit(False))
        & (F.coalesce(values["address_mode"], F.lit("inherit")) == "inherit")
        & (F.size(F.coalesce(values["other_fields"], F.array().cast("array<string>"))) == 0)
    )
    valid_indexes = (F.size(F.array_distinct(indexes)) == F.size(indexes)) & F.forall(
        indexes, lambda i: (i >= 0) & (i < F.size("support"))
    )
    yes = lambda name: F.col(name).isNotNull()
    rule = (
        F.when(~F.col("facility_digest").eqNullSafe(F.col("f_digest")) | ~values["facility_id"].eqNullSafe(F.col("facility_id")), "stale facility guard")
        .when(~single & yes("inventory_changed"), "complete inventory guard required")
        .when(~single & ~several_values, "invalid layout name or holes")
        .when(single & yes("has_courses"), "single course needs an empty inventory")
        .when(single & ~single_values, "cannot invent names or split totals")
        .when(~fixed_values, "cannot promote other fields")
        .when(~F.col("retained_evidence_digest").eqNullSafe(F.col("e_digest")), "stale evidence guard")
        .when((F.size(note_ids) == 0) | (F.size(F.array_except(note_ids, "allowed_notes")) > 0), "accepted notes required")
        .when(yes("note_stale"), "stale note guard")
        .when(~valid_indexes, "invalid support indexes")
        .when(indexes != relevant, "complete support required")
        .when(~same_sources, "all source guards required")
        .when(yes("source_stale") | unrelated, "stale or unrelated source")
        .when(yes("source_blocked"), "source is blocked")
        .when(F.coalesce(F.trim("review_reference"), F.lit("")) == "", "identity review required")
    )
    judged = joined.select("ordinal", rule.alias("rule"))
    return judged.where(F.col("rule").isNotNull())


# --- in a batch ----------------------------------------------------------------------------------

#: A batch's column `retained`: what an addition from retained evidence says it rests on.
EVIDENCE = (
    "facility_id string, facility_digest string, retained_evidence_digest string, note_digests map<string,string>, "
    "support_indexes array<int>, source_digests map<string,string>, review_reference string, course_inventory_digests map<string,string>"
)
#: The tables of retained evidence that a catalog may have.
TABLES = {
    "retained_evidence": "facility_id string, notes array<string>, support array<struct<fields:array<string>,source:string,note:array<string>>>, listed_sources array<string>",
    "note": "note_id string",
}
BLOCK = 100_000  # changes of one facility are added up in blocks of this many places of the batch


def _rows_digests(rows: DataFrame, key: str, *more) -> DataFrame:
    return rows.select(key, *more, canon.row_digest(*sorted(rows.columns)).alias("digest"))


def _proposals(live: DataFrame) -> DataFrame:
    """The additions of a batch that rest on retained evidence, as course_evidence_violations takes them."""
    rows = live.where("retained is not null and entity = 'course' and expected is null")
    given = F.from_json("values", "facility_id string, name string, physical_holes int, identity_status string, game_kind string, address_mode string")
    said = F.map_keys(F.map_filter(F.from_json("values", "map<string,string>"), lambda _, v: v.isNotNull()))
    others = F.array_except(said, F.array(*[F.lit(n) for n in WRITABLE]))
    none = F.expr("cast(map() as map<string,string>)")
    return rows.select(
        "ordinal", "id", "retained.facility_id", "retained.facility_digest", "retained.retained_evidence_digest",
        F.coalesce("retained.note_digests", none).alias("note_digests"),
        F.coalesce("retained.support_indexes", F.array().cast("array<int>")).alias("support_indexes"),
        F.coalesce("retained.source_digests", none).alias("source_digests"), "retained.review_reference",
        F.col("retained.course_inventory_digests").isNotNull().alias("extended"), "retained.course_inventory_digests",
        given.withField("other_fields", others).alias("values"),
    )


def inventory_steps(updates: DataFrame, marks: DataFrame, block=BLOCK) -> DataFrame:
    """The lane sums by which each facility's inventory differs from the one before the batch, as of
    each mark (facility_id, ordinal): those of the updates at smaller ordinals.

    `updates` is facility_id, ordinal, sign (1 for a row as it becomes, -1 as it was), digest. Sums
    run within blocks of the batch and from block to block by one row each, so that a facility with
    a third of all changes is never one task's.
    """
    key = ["facility_id", "block"]
    placed = lambda rows: rows.withColumn("block", F.floor(F.col("ordinal") / block))
    events = placed(updates).groupBy(*key, "ordinal").agg(*canon.lane_sums(F.col("sign")))
    ends = events.groupBy(*key).agg(*[F.sum(n).alias(n) for n in canon.LANES])
    # A mark's block may have no update of its own; earlier blocks count all the same.
    ends = ends.unionByName(placed(marks).select(*key).distinct(), allowMissingColumns=True).groupBy(*key).agg(*[F.sum(n).alias(n) for n in canon.LANES])
    earlier = Window.partitionBy("facility_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(*key, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias("s_" + n) for n in canon.LANES])
    inside = Window.partitionBy(*key).orderBy("ordinal").rangeBetween(Window.unboundedPreceding, -1)
    both = events.unionByName(placed(marks).select(*key, "ordinal", F.lit(True).alias("mark")), allowMissingColumns=True)
    carried = both.select(*key, "ordinal", "mark", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(n) for n in canon.LANES])
    at = carried.where("mark").join(starts, key)
    return at.select("facility_id", "ordinal", *[(F.col(n) + F.col("s_" + n)).alias(n) for n in canon.LANES])


def batch_violations(live: DataFrame, tables: dict, after: dict, held_ids: DataFrame) -> DataFrame:
    """(ordinal, rule) of additions from retained evidence, each judged at its place in the batch, and
    of inventories that the batch has changed by its end (ordinal NULL).

    `live` are the changes with `retained` (EVIDENCE) and current_digest; `tables` the catalog before,
    `after` the touched tables after the batch. A facility's inventory must be the one before the
    batch, additions of the batch apart, at every addition and at the end.
    """
    shape = live.where("retained is not null").select("ordinal", _shape_rule().alias("rule")).where("rule is not null")
    proposals = _proposals(live)
    facilities, courses = tables["facility"], tables["course"]
    named = proposals.select("facility_id").distinct()
    mine = _rows_digests(facilities.join(named, "facility_id", "left_semi"), "facility_id", "name", "physical_holes")

    # Each facility as of the proposal: changed rows from their change on, others as stored.
    changed = live.where("entity = 'facility'").select(F.col("id").alias("facility_id"), F.col("ordinal").alias("changed_at"))
    later = after.get("facility", facilities).join(changed.join(named, "facility_id", "left_semi"), "facility_id", "left_semi")
    then = lambda rows, p: _rows_digests(rows, "facility_id", "name", "physical_holes").toDF("facility_id", *[p + n for n in ("name", "holes", "digest")])
    pick = F.coalesce(F.col("changed_at") < F.col("ordinal"), F.lit(False))
    facility = (
        proposals.select("ordinal", "facility_id").join(mine.toDF("facility_id", "b_name", "b_holes", "b_digest"), "facility_id", "left")
        .join(changed, "facility_id", "left").join(then(later, "a_"), "facility_id", "left")
        .select("ordinal", *[F.when(pick, F.col("a_" + n)).otherwise(F.col("b_" + n)).alias("f_" + n) for n in ("name", "holes", "digest")])
    )

    # Courses that the batch adds are staged; what it changes about others moves the inventory.
    near = _rows_digests(courses.join(named, "facility_id", "left_semi"), "course_id", "facility_id")
    staged = live.where("entity = 'course' and expected is null").select("ordinal", F.get_json_object("values", "$.facility_id").alias("facility_id"))
    first_staged = staged.groupBy("facility_id").agg(F.min("ordinal").alias("staged_at"))
    owners = near.select("facility_id").distinct().withColumn("stored", F.lit(True))
    has_courses = (
        proposals.select("ordinal", "facility_id").join(owners, "facility_id", "left").join(first_staged, "facility_id", "left")
        .where("stored or staged_at < ordinal").select("ordinal")
    )
    touched = live.where("entity = 'course' and expected is not null").select(F.col("id").alias("course_id"), "ordinal")
    old = near.join(touched, "course_id").withColumn("sign", F.lit(-1))
    became = after.get("course", courses).join(touched, "course_id", "left_semi")
    new = _rows_digests(became, "course_id").join(old.select("course_id", "facility_id", "ordinal"), "course_id").withColumn("sign", F.lit(1))
    columns = ["facility_id", "ordinal", "sign", "course_id", "digest"]
    # The row's digest within an inventory is that of (course_id, digest), as in group_digest.
    updates = old.select(*columns).unionByName(new.select(*columns)).withColumn("digest", canon.row_digest("course_id", "digest"))
    extended = proposals.where("extended").select("facility_id", "ordinal")
    last = extended.select("facility_id", F.lit(1 << 62).alias("ordinal")).distinct()
    marks = extended.withColumn("ordinal", F.col("ordinal").cast("long")).unionByName(last)
    steps = inventory_steps(updates.withColumn("ordinal", F.col("ordinal").cast("long")), marks)
    base = canon.group_lanes(near, "facility_id", "course_id", "digest").select("facility_id", *[F.col(n).alias("b_" + n) for n in canon.LANES])
    running = steps.join(base, "facility_id", "left").withColumns({n: F.col(n) + F.coalesce("b_" + n, F.lit(0)) for n in canon.LANES})
    moved = running.where(canon.lanes_digest() != canon.lanes_digest("b_")).select("ordinal")
    end = moved.where(F.col("ordinal") == (1 << 62)).select(F.lit(None).cast("long").alias("ordinal"), F.lit("retained course inventory changed during the batch").alias("rule"))

    during = {"facility": facility, "has_courses": has_courses, "moved": moved}
    seen = proposals.where("extended").select("ordinal", F.explode("course_inventory_digests").alias("course_id", "wanted"))
    kept = tables["retained_evidence"].join(named, "facility_id", "left_semi")
    evidence = kept.withColumn("digest", canon.row_digest(*sorted(kept.columns)))
    cited = proposals.select(F.explode(F.map_keys("note_digests")).alias("note_id")).distinct()
    notes = _rows_digests(tables["note"].join(cited, "note_id", "left_semi"), "note_id").withColumnRenamed("note_id", "id")
    sources = _rows_digests(tables["source"].join(cited_sources(live), "source_id", "left_semi"), "source_id", "intake_policy")
    judged = course_evidence_violations(proposals.drop("id", "course_inventory_digests"), seen, mine, near, evidence, notes, sources, held_ids, during)
    return reduce(DataFrame.unionByName, [shape.withColumn("ordinal", F.col("ordinal").cast("long")), judged.withColumn("ordinal", F.col("ordinal").cast("long")), end.distinct()])


def _shape_rule():
    """Retained evidence stands alone, and only adds courses."""
    alone = F.coalesce("source_id", "collected_on", "status", "observation_id", "origin", "observation_digest", F.col("review_reference")).isNull()
    return F.when((F.col("entity") != "course") | F.col("expected").isNotNull(), "retained evidence only adds a missing course").when(~alone, "invalid retained evidence")


def cited_sources(live: DataFrame) -> DataFrame:
    """The sources whose digests retained evidence states."""
    return live.where("retained is not null").select(F.explode(F.map_keys("retained.source_digests")).alias("source_id")).distinct()


def ledger(live: DataFrame, evidence: DataFrame, batch_id: str) -> DataFrame:
    """The ledger rows of additions from retained evidence. The date stays unknown; the source is
    named only where all chosen support rests on it and it covers every note."""
    rows = live.where("retained is not null").select("entity", "id", "retained", "retained.facility_id")
    joined = rows.join(evidence.select("facility_id", "support"), "facility_id", "left")
    chosen = F.filter("support", lambda s, i: F.array_contains("retained.support_indexes", i))
    named = F.map_keys("retained.source_digests")
    linked = F.flatten(F.transform("chosen", lambda s: F.coalesce(s["note"], F.array().cast("array<string>"))))
    covered = F.size(F.array_except(F.map_keys("retained.note_digests"), linked)) == 0
    only = (F.size(named) == 1) & covered & F.forall("chosen", lambda s: F.coalesce(s["source"] == named[0], F.lit(False)))
    none = F.lit(None).cast("string")
    payload = F.struct("retained", F.col("chosen").alias("original_support"), none.alias("original_status"))
    return joined.withColumn("chosen", chosen).select(
        F.lit(batch_id).alias("batch_id"), F.col("entity").alias("entity_type"), F.col("id").alias("entity_id"),
        F.when(only, named[0]).alias("source_id"), none.alias("collected_on"), F.lit("retained_normalization").alias("origin"),
        canon.canonical_value(payload).alias("payload"), F.lit("extracted").alias("status"),
    )
