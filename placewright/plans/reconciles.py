"""Reviewed decisions (inventory U2, U3, U6, Q16, C8-C16)."""

from pyspark.sql import functions as F

from .. import standin
from ..functions import canon
from ..operators import cards, features, reconcile
from ..operators.joins import join_dealt
from ..session import read, settle
from ..standin import cte
from .rebuilds import CITATION
from .registry import query
from .reads import bundle, lined_bundle
from .scalars import SQL_ACCESS, SQL_HOLES, tagged

T = standin.table

FIELDS = ["access", "address_city", "address_postal_code", "address_region", "booking_url", "country", "county", "name", "operating_status", "ownership", "physical_holes", "setting", "state", "website"]
RELEASED = "case when k%60=0 or (k%3<>0 and k%2=0) then 'f-' || k end"
ACTION = "case when k%30=13 then 'course' when k%30=22 then 'remove_component' when k%30=28 then 'match_course' else 'merge_facility' end"
# Every third facility is decided on; the target is the round number below it.
DECIDED = "k%3=1"
TARGET = "'f-' || (k-k%30)"
WANTED = "case when k%30=28 then 'c-' || (17*cast(floor(k/2) as bigint)) end"
COURSE_PARENT = "case when k%17=0 then null else 'f-' || (owner-owner%3) end"

SQL_FAC = f"select *, {RELEASED} as released_id from f"
SQL_DEC = f"select k as ordinal, {ACTION} as action, 'f-' || k as source_id, {TARGET} as target_id, {WANTED} as target_course_id from f where {DECIDED}"
SQL_CRS = f"select *, {COURSE_PARENT} as parent from (select c.*, cast(substr(coalesce(facility_id, 'f-0'),3) as bigint) as owner from c)"
BASE = {"fa": SQL_FAC, "de": SQL_DEC, "cr": SQL_CRS}


def cite(spark_kind):
    none = F.lit(None).cast("string")
    return F.array(
        F.struct(
            F.array(F.lit("name")).alias("fields"), F.lit(spark_kind).alias("source_kind"), F.concat(F.lit("https://r.example.org/"), F.col("state")).alias("source_url"),
            F.lit("2026-01-01").alias("checked_on"), none.alias("license"), none.alias("credit"), none.alias("original_source_id"),
        )
    ).cast(f"array<{CITATION}>")


def facilities(spark, sf):
    source = T(spark, sf, "feat").select("k", "source_url", "checked_on", "credit")
    zero = F.lit(0).cast("long")
    rows = join_dealt(T(spark, sf, "f"), source, "k").withColumn("released_id", F.expr(RELEASED))
    return rows.withColumns({"fact_sources": cite("release"), "course_count": zero, "documented_course_count": zero})


def decisions(spark, sf):
    rows = T(spark, sf, "f").where(DECIDED).selectExpr(
        "k as ordinal", f"{ACTION} as action", "facility_id as source_id", f"{TARGET} as target_facility_id", f"{WANTED} as target_course_id",
        "'same place' as rule", "'reviewed' as reason", "1 as evidence_count", "cast(null as string) as source_sha256",
        "case when k%60=13 then array('website','address_city') end as withheld_fields",
    )
    return rows


def courses(spark, sf):
    rows = T(spark, sf, "c").withColumn("owner", F.expr("cast(substring(coalesce(facility_id, 'f-0'),3) as bigint)"))
    rows = rows.withColumn("facility_id", F.expr(COURSE_PARENT)).withColumn("state", F.lit("none"))
    none = F.lit(None).cast("string")
    # Some courses rest on the estimate of a facility that a decision removes.
    moved = F.expr("case when k%9=4 then 'f-' || (owner-owner%3+1) when k%5=0 then course_id end")
    return rows.select(
        "course_id", "facility_id", "name", "access", "physical_holes", "nonmember_bookable", "identity_status", "website", "address_city",
        moved.alias("destination_id"), none.alias("facility_name"), none.alias("facility_access"), cite("release").alias("fact_sources"),
    )


def feature_records(spark, sf):
    rows = tagged(spark, sf).withColumn("tags", features.source_tags(F.col("tags")))
    return rows.select(
        F.concat(F.lit("f-"), F.col("k").cast("string")).alias("source_id"),
        F.coalesce(features.tag("name"), features.tag("name:en")).alias("name"), "tags", "position", "source_url", "checked_on", "credit",
    )


def destinations(spark, sf):
    rows = T(spark, sf, "f").where(F.col("latitude").isNotNull())
    return rows.select(
        F.lit("facility_estimate").alias("scope"), F.col("facility_id").alias("id"), "latitude", "longitude"
    ).unionByName(
        T(spark, sf, "c").where(F.col("arrival_latitude").isNotNull()).select(
            F.lit("course_arrival").alias("scope"), F.col("course_id").alias("id"), F.col("arrival_latitude").alias("latitude"), F.col("arrival_longitude").alias("longitude")
        )
    )


@query(
    "u02_append_unique",
    """select user_id, min(event_id) as first_at, event_type || ':' || (props->>'k') as item from events group by user_id, event_type || ':' || (props->>'k')""",
)
def u02(spark, sf):
    rows = read(spark, sf, "events").select(
        "user_id", "event_id", F.struct("event_type", F.get_json_object("props", "$.k").alias("k")).alias("item")
    )
    kept = reconcile.append_unique(rows, "user_id", "event_id", "item")
    return kept.select("user_id", F.col("event_id").alias("first_at"), F.concat_ws(":", "item.event_type", "item.k").alias("item"))


@query(
    "u03_append_by_id",
    """select user_id, k as item_id, case when count(distinct event_type)>1 then 'conflict' else min(event_type) end as outcome from (select user_id, props->>'k' as k, event_type from events) group by 1, 2""",
)
def u03(spark, sf):
    rows = read(spark, sf, "events").select(
        "user_id", F.get_json_object("props", "$.k").alias("item_id"), "event_id", F.struct("event_type").alias("item")
    )
    kept, conflicts = reconcile.append_by_id(rows, "user_id", "item_id", "event_id", "item")
    return kept.select("user_id", "item_id", F.col("item.event_type").alias("outcome")).unionByName(
        conflicts.withColumn("outcome", F.lit("conflict"))
    )


EDITED = "case when k%20=7 then name || '!' else name end"


@query(
    "u06_changed_rows",
    cte("f") + "select facility_id, 'removed' as change from f where k%25=3 union all select facility_id || '-new', 'added' from f where k%25=9 union all select facility_id, 'changed' from f where k%20=7 and k%25<>3",
)
def u06(spark, sf):
    before, after = versions(spark, sf)
    return reconcile.changed_rows(before, after, "facility_id").select("facility_id", "change")


def versions(spark, sf):
    rows = T(spark, sf, "f").select("k", "facility_id", "name", "state", "access", "physical_holes", "latitude")
    edited = rows.where("k%25<>3").withColumn("name", F.expr(EDITED))
    added = rows.where("k%25=9").withColumn("facility_id", F.concat("facility_id", F.lit("-new")))
    return rows, edited.unionByName(added)


@query(
    "q16_plan_validation",
    cte("f", "c", extra=BASE)
    + f"""select k as ordinal, case k%10 when 0 then 'unknown action' when 1 then 'missing decision text' when 2 then 'missing evidence' when 3 then 'unknown facility' when 4 then 'source targets itself'
 when 5 then 'source digest changed' when 6 then 'facility decision cannot target a course' when 7 then 'withheld fields need a new course' end as rule from f where {DECIDED} and k%10<8
 union all select k, 'target is also a source' from f where {DECIDED} and k%10=8 union all select k+1000000000, 'repeated source' from f where {DECIDED} and k%10=9""",
)
def q16(spark, sf):
    plan = decisions(spark, sf).withColumns({
        "target_course_id": F.when(F.col("ordinal") % 10 == 6, F.lit("c-1")),
        "withheld_fields": F.when(F.col("ordinal") % 10 == 7, F.array(F.lit("website"))),
        "action": F.when(F.col("ordinal") % 10 == 0, "guess").otherwise("merge_facility"),
        "reason": F.when(F.col("ordinal") % 10 == 1, " ").otherwise(F.col("reason")),
        "evidence_count": F.when(F.col("ordinal") % 10 == 2, 0).otherwise(1),
        "source_sha256": F.when(F.col("ordinal") % 10 == 5, "0"),
        "target_facility_id": F.when(F.col("ordinal") % 10 == 3, "f-none").when(F.col("ordinal") % 10 == 4, F.col("source_id"))
        .when(F.col("ordinal") % 10 == 8, F.expr("'f-' || (ordinal+1-(ordinal+1)%30+1)")).otherwise(F.col("target_facility_id")),
    })
    again = plan.where("ordinal%10=9").withColumn("ordinal", F.col("ordinal") + 1_000_000_000)
    rows = facilities(spark, sf).select("facility_id", canon.row_digest("facility_id", "name").alias("sha256"), F.lit(True).alias("has_feature"))
    return reconcile.plan_violations(plan.unionByName(again), rows, courses(spark, sf)).select("ordinal", "rule")


def sql_usable(name):
    return f"{name} is not null" if name == "physical_holes" else f"{name} is not null and {name}<>''"


SQL_SOURCES = """select s.*, de.ordinal, de.target_id, s.released_id is not null and t.released_id is null as pref from de join fa s on s.facility_id=de.source_id join fa t on t.facility_id=de.target_id where de.action='merge_facility'"""
SQL_AGG = "select target_id, " + ", ".join(
    f"arg_max({n}, ordinal) filter (where pref and {sql_usable(n)}) as w_{n}, arg_min({n}, ordinal) filter (where not pref and {sql_usable(n)}) as l_{n}" for n in FIELDS
) + ", arg_min(latitude, ordinal) filter (where latitude is not null) as p_lat, arg_min(longitude, ordinal) filter (where latitude is not null) as p_lon from so group by 1"
MERGED = {
    **BASE,
    "so": SQL_SOURCES,
    "ag": SQL_AGG,
    "mg": "select fa.facility_id, " + ", ".join(f"coalesce(w_{n}, fa.{n}, l_{n}) as {n}" for n in FIELDS)
    + ", coalesce(fa.latitude, p_lat) as latitude, coalesce(fa.longitude, p_lon) as longitude from fa left join ag on ag.target_id=fa.facility_id where fa.facility_id not in (select source_id from de)",
}


@query("c08_merge_facilities", cte("f", "c", extra=MERGED) + "select * from mg")
def c08(spark, sf):
    rows = facilities(spark, sf)
    plan = decisions(spark, sf)
    sources = reconcile.merge_sources(rows, plan.where("action='merge_facility'"))
    kept = rows.join(plan.select(F.col("source_id").alias("facility_id")), "facility_id", "left_anti")
    return reconcile.merge_scalars(kept, sources, FIELDS).select("facility_id", *FIELDS, "latitude", "longitude")


SQL_LONG = " union all ".join(
    f"select target_id, '{n}' as field, so.facility_id as source_id, ordinal, pref, cast(so.{n} as varchar) as value, cast(t.{n} as varchar) as own from so join fa t on t.facility_id=so.target_id where {sql_usable('so.' + n) if n != 'physical_holes' else 'so.physical_holes is not null'}"
    for n in FIELDS
)
STEPS = {
    **MERGED,
    "lg": SQL_LONG,
    "st": """select *, last_value(case when pref then value end ignore nulls) over w as won, first_value(case when not pref then value end ignore nulls) over w as fill
 from lg window w as (partition by target_id, field order by ordinal rows between unbounded preceding and 1 preceding)""",
    "sx": "select *, coalesce(won, own, fill) as before from st",
    "sy": "select *, case when pref or before is null then value else before end as after from sx",
}


@query(
    "c08_merge_conflicts",
    cte("f", "c", extra=STEPS)
    + "select target_id, source_id, field, value as source_value, before as target_value, case when pref then 'source' else 'target' end as selected from sy where before is not null and before<>value",
)
def c08_conflicts(spark, sf):
    steps = merge_steps(spark, sf)
    return reconcile.merge_conflicts(steps).select("target_id", "source_id", "field", "source_value", "target_value", "selected")


def merge_steps(spark, sf):
    rows = facilities(spark, sf)
    sources = reconcile.merge_sources(rows, decisions(spark, sf).where("action='merge_facility'"))
    return reconcile.merge_steps(rows, sources, FIELDS)


@query(
    "c08_merge_citations",
    cte("f", "c", extra=MERGED)
    + """select facility_id, count(*) as citations from (select distinct target_id as facility_id, 'https://r.example.org/' || t.state as url from so join fa t on t.facility_id=so.target_id
 union select target_id, 'https://r.example.org/' || state from so union select target_id, 'osm ' || facility_id from so) group by 1""",
)
def c08_citations(spark, sf):
    rows = facilities(spark, sf)
    sources = reconcile.merge_sources(rows, decisions(spark, sf).where("action='merge_facility'"))
    return reconcile.merge_citations(rows, sources).groupBy("facility_id").agg(F.count("*").alias("citations"))


@query(
    "c09_merge_aliases",
    cte("f", "c", "al", extra=STEPS)
    + """select distinct target_id as facility_id, name, 'reconciliation-alias-' || substr(sha256('["facility","' || target_id || '","' || name || '"]'),1,24) as alias_id
 from (select target_id, after, unnest([before, value]) as name from sy where field='name') where name<>after and not exists (select 1 from al where al.facility_id=target_id and al.name=name)""".replace("al.name=name)", "al.name=x.name)").replace("where field='name') where", "where field='name') x where"),
)
def c09(spark, sf):
    return reconcile.merge_aliases(merge_steps(spark, sf), T(spark, sf, "al")).select("facility_id", "name", "alias_id")


SQL_GONE = "select source_id from de where action<>'merge_facility'"


@query(
    "c10_archive_relations",
    cte("f", "c", "r", "m", "t", "al", extra={**BASE, "gr": f"select round_id from r where facility_id in ({SQL_GONE})"})
    + f"""select 'round_option' as entity, round_id as id from r where round_id not in (select round_id from gr) union all select 'round_component', member_id from m where round_id not in (select round_id from gr)
 union all select 'tee_set', tee_id from t where round_id is null or round_id not in (select round_id from gr) union all select 'alias', alias_id from al where facility_id is null or facility_id not in ({SQL_GONE})
 union all select 'intake', facility_id from f where facility_id not in ({SQL_GONE})""",
)
def c10(spark, sf):
    b = bundle(spark, sf)
    b["intake"] = T(spark, sf, "f").select(F.lit("facility").alias("entity_type"), F.col("facility_id").alias("entity_id"))
    gone = decisions(spark, sf).where("action<>'merge_facility'").select(F.col("source_id").alias("facility_id"))
    kept = reconcile.archive_relations(b, gone)
    names = {"round_option": "round_id", "round_component": "member_id", "tee_set": "tee_id", "alias": "alias_id", "intake": "entity_id"}
    return standin.union_all([kept[n].select(F.lit(n).alias("entity"), F.col(k).alias("id")) for n, k in names.items()])


SQL_COURSE_DEC = f"""select de.*, feat.k as fk, feat.latitude as fx, coalesce(t_name, t_name_en) as fname, t_website, t_a_city, {SQL_ACCESS} as va, {SQL_HOLES} as vh from de join feat on 'f-' || feat.k=de.source_id where action in ('course','match_course')"""


@query(
    "c11_course_decisions",
    cte("f", "c", "feat", extra={**BASE, "cd": SQL_COURSE_DEC})
    + """select source_id as course_id, target_id as facility_id, fname as name, va as access, vh as physical_holes, 'new' as outcome, case when fk%60<>13 and regexp_full_match(t_website,'https?://\\S+') then t_website end as website,
 case when fk%60<>13 then t_a_city end as address_city, 2 + (case when va is not null or vh is not null then 1 else 0 end) as citations from cd where action='course'
 union all select cr.course_id, target_id, cr.name, coalesce(cr.access, va), coalesce(cr.physical_holes, vh), 'matched', cr.website, cr.address_city, 2 + (case when (cr.access is null and va is not null) or (cr.physical_holes is null and vh is not null) then 1 else 0 end)
 from cd join cr on cr.course_id=cd.target_course_id where action='match_course'""",
)
def c11(spark, sf):
    new, changed = reconcile.course_decisions(decisions(spark, sf), feature_records(spark, sf), courses(spark, sf))
    shown = ["course_id", "facility_id", "name", "access", "physical_holes", "website", "address_city"]
    citations = F.size("fact_sources").alias("citations")
    return new.select(*shown, F.lit("new").alias("outcome"), citations).unionByName(
        changed.select(*shown, F.lit("matched").alias("outcome"), citations)
    )


SQL_DEST = "select 'facility_estimate' as scope, facility_id as id, latitude from f where latitude is not null union all select 'course_arrival', course_id, arrival_latitude from c where arrival_latitude is not null"
SQL_KEPT = """select scope, id, arg_min(latitude, o) as latitude from (select scope, latitude, case when scope='facility_estimate' then coalesce(mm.target_id, d.id) else d.id end as id, row(coalesce(mm.target_id, d.id)<>d.id and scope='facility_estimate', d.id) as o
 from ds d left join (select source_id, target_id from de where action='merge_facility') mm on mm.source_id=d.id) z where not (scope='facility_estimate' and id in (select source_id from de)) group by 1, 2"""


@query("c12_destination_cleanup", cte("f", "c", extra={**BASE, "ds": SQL_DEST}) + SQL_KEPT)
def c12(spark, sf):
    plan = decisions(spark, sf)
    mapping = plan.where("action='merge_facility'").select(F.col("source_id").alias("old_id"), F.col("target_facility_id").alias("new_id"))
    kept = reconcile.clean_destinations(destinations(spark, sf), plan.select(F.col("source_id").alias("facility_id")), mapping)
    return kept.select("scope", "id", "latitude")


@query(
    "c12_dangling_destinations",
    cte("f", "c", extra={**BASE, "ds": SQL_DEST, "kp": SQL_KEPT, "cx": "select course_id, case when k%9=4 then 'f-' || (owner-owner%3+1) when k%5=0 then course_id end as destination_id from cr"})
    + "select course_id, case when destination_id in (select source_id from de) and destination_id not in (select id from kp) then null else destination_id end as destination_id from cx",
)
def c12_dangling(spark, sf):
    plan = decisions(spark, sf)
    removed = plan.select(F.col("source_id").alias("facility_id"))
    mapping = plan.where("action='merge_facility'").select(F.col("source_id").alias("old_id"), F.col("target_facility_id").alias("new_id"))
    kept = reconcile.clean_destinations(destinations(spark, sf), removed, mapping)
    return reconcile.clear_dangling(courses(spark, sf), kept, removed).select("course_id", "destination_id")


@query(
    "c13_refresh_affected",
    cte("f", "c", extra={**BASE, "n": "select parent, count(*) as n, count(*) filter (where identity_status='operator_defined') as d from cr where parent is not null group by 1", "af": "select distinct target_id from de"})
    + """select facility_id as id, case when facility_id in (select target_id from af) then coalesce(n,0) else 0 end as course_count, case when facility_id in (select target_id from af) then coalesce(d,0) else 0 end as documented, null as facility_name from f left join n on n.parent=f.facility_id
 union all select cr.course_id, null, null, case when cr.parent in (select target_id from af) then f.name end from cr left join f on f.facility_id=cr.parent""",
)
def c13(spark, sf):
    affected = decisions(spark, sf).select(F.col("target_facility_id").alias("facility_id")).distinct()
    rows, children = facilities(spark, sf), courses(spark, sf)
    none = F.lit(None)
    parents = reconcile.refresh_parents(rows, children, affected).select(
        F.col("facility_id").alias("id"), "course_count", F.col("documented_course_count").alias("documented"), none.cast("string").alias("facility_name")
    )
    return parents.unionByName(
        reconcile.refresh_children(children, rows, affected).select(
            F.col("course_id").alias("id"), none.cast("long").alias("course_count"), none.cast("long").alias("documented"), "facility_name"
        )
    )


@query(
    "c14_receipt",
    cte("f") + "select facility_id, 'removed' as change, name as name_before from f where k%25=3 union all select facility_id || '-new', 'added', null from f where k%25=9 union all select facility_id, 'changed', name from f where k%20=7 and k%25<>3",
)
def c14(spark, sf):
    before, after = versions(spark, sf)
    record = reconcile.receipt(before, after, "facility_id")
    return record.select("facility_id", "change", F.col("before_row.name").alias("name_before"))


@query("c15_restore_baseline", cte("f") + "select facility_id, name, state, access, physical_holes from f")
def c15(spark, sf):
    before, after = versions(spark, sf)
    record = reconcile.receipt(before, after, "facility_id")
    return reconcile.restore(after, record, "facility_id").select("facility_id", "name", "state", "access", "physical_holes")


@query(
    "c15_receipt_tampering",
    cte("f") + "select facility_id, 'row changed after the receipt' as rule from f where k%20=7 and k%25<>3 and k%40=7",
)
def c15_tampering(spark, sf):
    before, after = versions(spark, sf)
    record = reconcile.receipt(before, after, "facility_id")
    tampered = after.withColumn("state", F.when(F.col("k") % 40 == 7, "elsewhere").otherwise(F.col("state")))
    tampered = tampered.where("not facility_id like '%-new'").unionByName(after.where("facility_id like '%-new'"))
    return reconcile.receipt_violations(tampered, record, "facility_id")


def reconciled(spark, sf):
    b = bundle(spark, sf)
    b["facility"], b["course"], b["destination"] = facilities(spark, sf), courses(spark, sf), destinations(spark, sf)
    return b, reconcile.apply(b, decisions(spark, sf), feature_records(spark, sf), FIELDS)


@query(
    "c16_reconciled_facilities",
    cte("f", "c", extra={**MERGED, "cm": "select course_id, target_id from (select source_id as course_id, target_id from de where action='course' union all select target_course_id, target_id from de where action='match_course')",
        "ct": """select facility_id, count(*) as citations from (select distinct target_id as facility_id, 'https://r.example.org/' || t.state as url from so join fa t on t.facility_id=so.target_id
 union select target_id, 'https://r.example.org/' || state from so union select target_id, 'osm ' || facility_id from so) group by 1""",
        "n": "select p, count(*) as n from (select coalesce(cm.target_id, cr.parent) as p from cr left join cm on cm.course_id=cr.course_id union all select target_id from de where action='course') where p is not null group by 1"})
    + "select mg.facility_id, name, access, physical_holes, latitude, case when mg.facility_id in (select target_id from de) then coalesce(n,0) else 0 end as course_count, coalesce(citations, 1) as citations from mg left join n on n.p=mg.facility_id left join ct on ct.facility_id=mg.facility_id",
)
def c16(spark, sf):
    _, result = reconciled(spark, sf)
    return result["tables"]["facility"].select("facility_id", "name", "access", "physical_holes", "latitude", "course_count", F.size("fact_sources").cast("long").alias("citations"))


@query(
    "c16_restore_after_run",
    cte("f", "c", "r", "al", extra={**BASE, "ds": SQL_DEST})
    + "select 'facility' as entity, facility_id as id, name from f union all select 'course', course_id, name from cr union all select 'round_option', round_id, coalesce(facility_id, course_id) from r union all select 'alias', alias_id, name from al union all select 'destination', scope || '/' || id, null from ds",
)
def c16_restored(spark, sf):
    _, result = reconciled(spark, sf)
    back = reconcile.restored(result)
    none = F.lit(None).cast("string")
    shown = {
        "facility": ("facility_id", F.col("name")), "course": ("course_id", F.col("name")), "round_option": ("round_id", F.coalesce("facility_id", "course_id")),
        "alias": ("alias_id", F.col("name")), "destination": ("destination_key", none),
    }
    return standin.union_all([back[t].select(F.lit(t).alias("entity"), F.col(key).alias("id"), value.alias("name")) for t, (key, value) in shown.items()])


def whole_run(spark, sf):
    """The tables before, with what cards show, and the run over them."""
    b = lined_bundle(spark, sf)
    ours = courses(spark, sf).select("course_id", F.col("facility_id").alias("parent"), F.col("destination_id").alias("rests_on"), "fact_sources")
    course = T(spark, sf, "c").join(ours, "course_id").withColumns({"facility_id": F.col("parent"), "destination_id": F.col("rests_on")}).drop("parent", "rests_on")
    before = {n: b[n] for n in ("round_option", "round_component", "component", "tee_set", "alias")}
    before |= {"facility": facilities(spark, sf), "course": course, "destination": reconcile.keyed_destinations(destinations(spark, sf))}
    # A catalog's tables are stored; the stand-ins are written once, as every step of the run reads them.
    before = {name: settle(rows, "before") for name, rows in before.items()}
    return before, reconcile.written(before, reconcile.apply(before, decisions(spark, sf), feature_records(spark, sf), FIELDS))


# The tables after the run.
AFTER = {
    **STEPS, "cd": SQL_COURSE_DEC, "mm": "select source_id, target_id from de where action='merge_facility'", "gr": f"select round_id from r where facility_id in ({SQL_GONE})",
    "ra": "select r.round_id, coalesce(mm.target_id, r.facility_id) as facility_id, r.course_id from r left join mm on mm.source_id=r.facility_id where r.round_id not in (select round_id from gr)",
    "ma": "select * from m where round_id not in (select round_id from gr)",
    "ta": "select * from t where round_id is null or round_id not in (select round_id from gr)",
    "ca": "select cr.course_id, coalesce(cd.target_id, cr.parent) as facility_id from cr left join cd on cd.action='match_course' and cd.target_course_id=cr.course_id union all select source_id, target_id from cd where action='course'",
    "ax": f"select alias_id, coalesce(mm.target_id, al.facility_id) as facility_id, al.course_id, al.name from al left join mm on mm.source_id=al.facility_id where al.facility_id is null or al.facility_id not in ({SQL_GONE})",
    "an": """select distinct 'reconciliation-alias-' || substr(sha256('["facility","' || target_id || '","' || name || '"]'),1,24) as alias_id, target_id as facility_id, null as course_id, name
 from (select target_id, after, unnest([before, value]) as name from sy where field='name') x where name<>after and not exists (select 1 from ax where ax.facility_id=target_id and ax.name=x.name)""",
    "ac": """select distinct 'reconciliation-alias-' || substr(sha256('["course","' || cr.course_id || '","' || fname || '"]'),1,24) as alias_id, null as facility_id, cr.course_id, fname as name
 from cd join cr on cr.course_id=cd.target_course_id where cd.action='match_course' and fname is not null and fname is distinct from cr.name""",
    "aa": "select * from ax union all select * from an union all select * from ac",
}


@query(
    "c13_refreshed_cards",
    cte("f", "c", "r", "m", "t", "p", "al", "feat", extra={
        **AFTER,
        "own": "select round_id, course_id from ra where course_id is not null union select ma.round_id, coalesce(ma.course_id, p.course_id) from ma left join p on p.component_id=ma.component_id where coalesce(ma.course_id, p.course_id) is not null and ma.round_id in (select round_id from ra)",
        "ci": "select facility_id, string_agg(course_id, ',' order by course_id) as v from ca where facility_id is not null group by 1",
        "ri": "select facility_id, string_agg(round_id, ',' order by round_id) as v from ra where facility_id is not null group by 1",
        "ai": "select facility_id, string_agg(name, ',' order by alias_id) as v from aa where facility_id is not null group by 1",
        "pi": "select course_id, string_agg(component_id, ',' order by component_id) as v from p group by 1",
        "ti": "select course_id, string_agg(tee_id, ',' order by tee_id) as v from ta where course_id is not null group by 1",
        "oi": "select course_id, string_agg(round_id, ',' order by round_id) as v from own group by 1",
        "li2": "select course_id, string_agg(name, ',' order by alias_id) as v from aa where course_id is not null group by 1",
    })
    + """select 'facility' as kind, mg.facility_id as id, mg.name, mg.latitude, coalesce(ci.v,'') as children, '' as tees, coalesce(ri.v,'') as rounds, coalesce(ai.v,'') as aliases
 from mg left join ci on ci.facility_id=mg.facility_id left join ri on ri.facility_id=mg.facility_id left join ai on ai.facility_id=mg.facility_id
 union all select 'course', ca.course_id, mg.name, mg.latitude, coalesce(pi.v,''), coalesce(ti.v,''), coalesce(oi.v,''), coalesce(li2.v,'')
 from ca left join mg on mg.facility_id=ca.facility_id left join pi on pi.course_id=ca.course_id left join ti on ti.course_id=ca.course_id left join oi on oi.course_id=ca.course_id left join li2 on li2.course_id=ca.course_id""",
)
def c13_cards(spark, sf):
    before, result = whole_run(spark, sf)
    made = {"facility": cards.facility_cards(before), "course": cards.course_cards(before)}
    fresh = reconcile.refresh_cards(made, before, result["tables"], result["receipts"])
    joined = lambda column: F.array_join(column, ",")
    facility = fresh["facility"].select(
        F.lit("facility").alias("kind"), F.col("facility_id").alias("id"), "name", F.col("map_location.latitude").alias("latitude"), joined("course_inventory.course_id").alias("children"),
        F.lit("").alias("tees"), joined("round_options.round_id").alias("rounds"), joined("aliases.name").alias("aliases"),
    )
    return facility.unionByName(fresh["course"].select(
        F.lit("course").alias("kind"), F.col("course_id").alias("id"), F.col("facility_name").alias("name"), F.col("map_location.latitude").alias("latitude"), joined("components.component_id").alias("children"),
        joined("tee_sets.tee_id").alias("tees"), joined("round_options.round_id").alias("rounds"), joined("aliases.name").alias("aliases"),
    ))


@query(
    "c14_sealed_receipt",
    cte("f", "c", "r", "m", "t", "p", "al", "feat", extra={**AFTER, "ds": SQL_DEST, "kp": SQL_KEPT})
    + """select item, rows_before, rows_after, true as as_scanned from (select 'facility' as item, (select count(*) from f) as rows_before, (select count(*) from mg) as rows_after
 union all select 'course', (select count(*) from c), (select count(*) from ca) union all select 'round_option', (select count(*) from r), (select count(*) from ra)
 union all select 'round_component', (select count(*) from m), (select count(*) from ma) union all select 'tee_set', (select count(*) from t), (select count(*) from ta)
 union all select 'component', (select count(*) from p), (select count(*) from p) union all select 'alias', (select count(*) from al), (select count(*) from aa)
 union all select 'destination', (select count(*) from ds), (select count(*) from kp) union all select 'catalog', null, null)""",
)
def c14_sealed(spark, sf):
    before, result = whole_run(spark, sf)
    names = list(result["receipts"])
    sealed = reconcile.seal(reconcile.lanes_of({n: before[n] for n in names}), result["receipts"], result["plan"], result["decisions"])
    # Digests that were carried along must be those of the tables read anew.
    read_anew = reconcile.lanes_of({n: result["tables"][n] for n in names}).select("item", canon.lanes_digest().alias("scanned"))
    scanned = settle(read_anew, "scanned")
    scanned = scanned.unionByName(reconcile.whole_digest(scanned, "scanned"))
    both = sealed.join(scanned, "item")
    return both.select("item", "rows_before", "rows_after", (F.col("scanned") == F.col("after_sha256")).alias("as_scanned"))


@query(
    "c15_seal_tampering",
    cte("f", "c", "r", "m", "t", "p", "al", extra={"x": "select count(*) as n from t where t.tee_id in (select min(tee_id) from t)"})
    + """select item, cast(null as varchar) as id, rule from (select unnest(['tee_set', 'destination', 'catalog', 'plan']) as item, 'digest after the run changed' as rule) where (select n from x) > 0""",
)
def c15_sealed(spark, sf):
    before, result = whole_run(spark, sf)
    sealed = settle(reconcile.seal(reconcile.lanes_of({n: before[n] for n in result["receipts"]}), result["receipts"], result["plan"], result["decisions"]), "seal")
    tees, places = result["tables"]["tee_set"], result["tables"]["destination"]
    first = tees.agg(F.min("tee_id").alias("tee_id")).withColumn("first", F.lit(True))
    # One row of a table that was hardly touched, a row that the receipt does not know, and the plan.
    forged = result["tables"] | {
        "tee_set": tees.join(first, "tee_id", "left").withColumn("name", F.when(F.col("first"), F.lit("forged")).otherwise(F.col("name"))).select(*tees.columns),
        "destination": places.unionByName(places.limit(1).withColumn("destination_key", F.lit("forged/1"))),
    }
    plan = result["plan"].withColumn("reason", F.when(F.col("ordinal") % 2 == 0, "other").otherwise(F.col("reason")))
    return reconcile.seal_violations(result | {"tables": forged, "plan": plan}, sealed)
