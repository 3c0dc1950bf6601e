"""Features, links, entities and the rebuild (inventory J1-J4, J14, J16, C6, C7, C19, F10, A1, A10, U5, Q14)."""

from pyspark.sql import functions as F

from .. import standin
from ..operators import entities, features, links, rebuild
from ..session import read, settle
from ..standin import cte, feature_key
from .registry import query
from .scalars import SQL_ACCESS, SQL_HOLES, SQL_QIDS, SQL_SELECTED, tagged

T = standin.table

# Entities of the knowledge base, from the event table: every event describes entity Q<id>.
SQL_ENTITY = "select 'Q' || event_id as entity_id, 'https://kb.example.org/Q' || event_id as entity_url, event_type as label, event_id%9=0 as person, event_id%11=0 as missing from events"


def entity_table(spark, sf):
    return read(spark, sf, "events").selectExpr(
        "'Q' || event_id as entity_id", "'https://kb.example.org/Q' || event_id as entity_url", "'2026-10-25' as entity_checked_on",
        "event_type as label", "event_id%9=0 as person", "event_id%11=0 as missing", "event_id%3 as claim_count",
    )


SQL_FEATURES = f"select *, {SQL_QIDS} as ids from feat where {SQL_SELECTED}"


@query(
    "j01_linked_entities",
    cte("feat", extra={"x": SQL_FEATURES, "e": SQL_ENTITY, "l": "select feature_id, unnest(ids) as entity_id, generate_subscripts(ids, 1)-1 as pos from x"})
    + "select feature_id, cast(pos as int) as position, l.entity_id, label from l join e on e.entity_id=l.entity_id",
)
def j01(spark, sf):
    linked = entities.linked_entities(features.records(tagged(spark, sf)), entity_table(spark, sf))
    return linked.select("feature_id", F.col("at").alias("position"), "entity_id", "label")


def layer_table(spark, sf):
    rows = T(spark, sf, "bind")
    one = rows.where(F.col("layer_1").isNotNull()).select(F.lit("layer_a.json").alias("file_name"), "facility_id", F.col("layer_1").alias("feature_id"))
    two = rows.where(F.col("layer_2").isNotNull()).select(F.lit("layer_a.json").alias("file_name"), "facility_id", F.col("layer_2").alias("feature_id"))
    return one.unionByName(two)


CITATION = "struct<fields:array<string>,source_kind:string,source_url:string,checked_on:string,license:string,credit:string,original_source_id:string>"


def released(spark, sf):
    bound = T(spark, sf, "bind").select("facility_id", "osm_identity", "location_cited")
    none = F.lit(None).cast("string")

    def cite(field):
        return F.struct(
            F.array(field).alias("fields"), F.lit("release").alias("source_kind"), F.lit("https://data.example.org/layers/layer_a.json").alias("source_url"),
            F.lit("2026-01-01").alias("checked_on"), none.alias("license"), none.alias("credit"), none.alias("original_source_id"),
        )

    kept = ["facility_id", "name", "state", "country", "website", "latitude", "longitude", "location_kind", "address_city", "access", "physical_holes"]
    facilities = T(spark, sf, "f").select(*kept).join(bound, "facility_id")
    field = F.when(F.col("location_cited"), "map_location").otherwise("name")
    facilities = facilities.withColumn("fact_sources", F.array(cite(field)).cast(f"array<{CITATION}>")).drop("location_cited")
    courses = T(spark, sf, "c").select(
        "course_id", "facility_id", "name", "website", "access", "physical_holes", "nonmember_bookable",
        F.expr(f"case when k%7=3 then {feature_key('k')} end").alias("osm_identity"),
        F.array(cite(F.lit("name"))).cast(f"array<{CITATION}>").alias("fact_sources"),
    )
    return facilities, courses


SQL_PAIRS = f"""select facility_id as released_id, osm_identity as feature_id from bind where osm_identity is not null
 union select facility_id, layer_1 from bind where osm_identity is null and location_cited and layer_1 is not null
 union select facility_id, layer_2 from bind where osm_identity is null and location_cited and layer_2 is not null
 union select course_id, {feature_key('k')} from c where k%7=3"""
SQL_MAP = """select min(released_id) as released_id, feature_id from (select released_id, min(feature_id) as feature_id from pairs group by 1 having count(*)=1) s
 where feature_id in (select feature_id from x) group by feature_id having count(*)=1"""


def all_pairs(spark, sf):
    facilities, courses = released(spark, sf)
    layers = layer_table(spark, sf)
    return links.candidates(facilities, "facility_id", layers).unionByName(links.candidates(courses, "course_id", layers))


@query("j02_binding_candidates", cte("bind", "c", extra={"pairs": SQL_PAIRS}) + "select released_id, 0 as part, string_agg(feature_id, ',' order by feature_id) as candidates from pairs group by 1")
def j02(spark, sf):
    facilities, courses = released(spark, sf)
    both = facilities.select(F.col("facility_id").alias("id")).unionByName(courses.select(F.col("course_id").alias("id")))
    listed = links.candidate_lists(all_pairs(spark, sf), both, "id")
    return listed.where(F.size("candidates") > 0).select("released_id", "part", F.array_join("candidates", ",").alias("candidates"))


@query("j03_one_to_one_owners", cte("feat", "bind", "c", extra={"x": SQL_FEATURES, "pairs": SQL_PAIRS}) + SQL_MAP)
def j03(spark, sf):
    return links.one_to_one(all_pairs(spark, sf), features.records(tagged(spark, sf))).select("released_id", "feature_id")


@query(
    "j04_rekey_references",
    cte("f", "c", "feat", "bind", extra={"x": SQL_FEATURES, "pairs": SQL_PAIRS, "mp": SQL_MAP, "lists": """select c.facility_id, string_agg(coalesce(mp.feature_id, course_id), ',' order by course_id) as ids from c left join mp on mp.released_id=course_id group by 1"""})
    + """select f.facility_id as own_id, 0 as part, coalesce(mp.feature_id, f.facility_id) as new_id, f.facility_id as note, coalesce(ids,'') as course_ids,
 case when k%2=0 then coalesce(mp.feature_id, f.facility_id) else f.facility_id end as scoped_id
 from f left join mp on mp.released_id=f.facility_id left join lists on lists.facility_id=f.facility_id""",
)
def j04(spark, sf):
    mapping = links.one_to_one(all_pairs(spark, sf), features.records(tagged(spark, sf)))
    mapping = mapping.select(F.col("released_id").alias("old_id"), F.col("feature_id").alias("new_id"))
    from ..operators import cards

    rows = cards.facility_inventory(T(spark, sf, "f"), T(spark, sf, "c")).select("facility_id", "part", "course_ids")
    rows = rows.select(
        F.col("facility_id").alias("own_id"),
        "part",
        F.col("facility_id").alias("new_id"),
        F.col("facility_id").alias("note"),
        F.col("facility_id").alias("scoped_id"),
        F.when(F.substring("facility_id", 3, 99).cast("long") % 2 == 0, "facility_estimate").otherwise("other").alias("scope"),
        "course_ids",
    )
    rows = links.rekey(rows, "new_id", mapping)
    rows = links.rekey(rows, "scoped_id", mapping, only=F.col("scope").isin("facility_estimate", "course_arrival"))
    rows = links.rekey_list(rows, ["own_id", "part"], "course_ids", mapping)
    return rows.select("own_id", "part", "new_id", "note", "scoped_id", F.array_join("course_ids", ",").alias("course_ids"))


@query(
    "j14_known_members",
    cte("feat", extra={"x": SQL_FEATURES})
    + "select feature_id, array_to_string(list_filter([case when osm_type='relation' and member_1 in (select feature_id from x) then member_1 end, case when osm_type='relation' and member_2 in (select feature_id from x) then member_2 end], lambda m: m is not null), ',') as members from x",
)
def j14(spark, sf):
    kept = features.with_known_members(features.records(tagged(spark, sf)))
    return kept.select("feature_id", F.array_join("member_feature_ids", ",").alias("members"))


@query(
    "j16_tag_refresh",
    cte("feat", extra={"x": SQL_FEATURES})
    + """select feature_id, 'version differs' as outcome from x where k%40=1 union all
 select feature_id, 'observation differs' from x where k%40=2 and t_access is not null union all select feature_id, 'identity set differs' from x where k%40=3
 union all select feature_id, 'added fee' from x where t_fee is not null and k%40 not in (1,2,3) union all select feature_id, 'added fee' from x where t_fee is not null and (k%40=1 or k%40=2)""",
)
def j16(spark, sf):
    newer = tagged(spark, sf).where(features.is_catalog_feature())
    old = features.records(tagged(spark, sf)).withColumn("tags", F.map_filter("tags", lambda key, _: key != "fee"))
    access = F.when((F.col("k") % 40 == 2) & F.map_contains_key("tags", F.lit("access")), F.map_from_arrays(F.array(F.lit("access")), F.array(F.lit("changed"))))
    edited = newer.withColumn(
        "tags",
        F.when(access.isNotNull(), F.map_concat(F.map_filter("tags", lambda key, _: key != "access"), access)).otherwise(F.col("tags")),
    ).withColumn("osm_version", F.when(F.col("k") % 40 == 1, F.col("osm_version") + 1).otherwise(F.col("osm_version")))
    refreshed, wrong = features.refresh_tags(old, edited.where(F.col("k") % 40 != 3))
    added = refreshed.select("feature_id", F.explode("added").alias("tag"))
    return wrong.select("feature_id", F.col("rule").alias("outcome")).unionByName(
        added.select("feature_id", F.concat(F.lit("added "), "tag").alias("outcome"))
    )


SQL_MEMBERS = "select 'Q' || (p_partkey%700) as entity_id from part"


@query(
    "a10_selection_sizes",
    cte("feat", extra={"x": SQL_FEATURES, "l": "select distinct unnest(ids) as entity_id from x", "n": f"select distinct entity_id from ({SQL_MEMBERS})"})
    + "select (select count(*) from l) as linked, (select count(*) from n) as national, (select count(*) from (select * from l union select * from n)) as every",
)
def a10(spark, sf):
    chosen = entities.selection(features.records(tagged(spark, sf)), read(spark, sf, "part").selectExpr("'Q' || (p_partkey%700) as entity_id"))
    return chosen.agg(
        F.count_if("linked").alias("linked"), F.count_if("from_query").alias("national"), F.count("*").alias("every")
    )


@query(
    "u05_linked_or_national_ids",
    cte("feat", extra={"x": SQL_FEATURES}) + f"select unnest(ids) as entity_id from x union select entity_id from ({SQL_MEMBERS})",
)
def u05(spark, sf):
    return entities.selection(features.records(tagged(spark, sf)), read(spark, sf, "part").selectExpr("'Q' || (p_partkey%700) as entity_id")).select("entity_id")


@query(
    "c19_entity_snapshot",
    cte("feat", extra={"x": SQL_FEATURES, "l": "select distinct unnest(ids) as entity_id from x", "n": f"select distinct entity_id from ({SQL_MEMBERS})", "e": SQL_ENTITY, "a": "select * from l union select * from n"})
    + """select a.entity_id, a.entity_id in (select entity_id from n) as from_query, case when not missing then label end as label, case when missing then 'missing_at_read' end as entity_status
 from a left join e on e.entity_id=a.entity_id where coalesce(not person, true) and (coalesce(not missing, false) or a.entity_id in (select entity_id from n))""",
)
def c19(spark, sf):
    members = read(spark, sf, "part").selectExpr("'Q' || (p_partkey%700) as entity_id")
    made = entities.snapshot(features.records(tagged(spark, sf)), members, entity_table(spark, sf))
    return made.select("entity_id", "from_query", "label", "entity_status")


@query(
    "f10_people_removed",
    cte("feat", extra={
        "x": SQL_FEATURES,
        "pp": "select 'Q' || event_id as entity_id from events where event_id%9=0 and event_type='click'",
        "u": "select feature_id, q, q in (select entity_id from pp) as person from (select feature_id, unnest(ids) as q from x) z",
        "g": "select feature_id, string_agg(q, ',' order by q) filter (where not person) as ids, bool_or(person) as named from u group by 1",
    })
    + """select x.feature_id, coalesce(g.ids,'') as ids, t_wikidata is not null and not coalesce(named, false) as keeps_link_tag from x left join g on g.feature_id=x.feature_id""",
)
def f10(spark, sf):
    from .scalars import claims

    people = claims(spark, sf).where(entities.is_person(F.col("claims"))).select("entity_id")
    kept = entities.drop_people(features.records(tagged(spark, sf)), people)
    return kept.select("feature_id", F.array_join("wikidata_ids", ",").alias("ids"), F.map_contains_key("tags", F.lit("wikidata")).alias("keeps_link_tag"))


# --- rebuild -----------------------------------------------------------------------------------

SQL_NEW = "select * from x where feature_id not in (select feature_id from mp) and not (coalesce(t_golf,'')<>'course' and coalesce(t_name,t_name_en) is null and geometry_status='source_polygon')"
REBUILD_CTES = {
    "x": SQL_FEATURES,
    "pairs": SQL_PAIRS,
    "mp": SQL_MAP,
    "nw": SQL_NEW,
    "e": SQL_ENTITY,
    "lk": "select feature_id, count(*) as links from (select feature_id, unnest(ids) as q from x) u where q in (select entity_id from e) group by 1",
    "vals": f"select x.feature_id, {SQL_ACCESS} as v_access, {SQL_HOLES} as v_holes, coalesce(links, 0) as links from x left join lk on lk.feature_id=x.feature_id",
    "rf": """select coalesce(mp.feature_id, f.facility_id) as record_id, f.facility_id as released_id, case when mp.feature_id is null then 'catalog_only' else 'matched_release' end as origin,
 f.access as a0, f.physical_holes as h0, mp.feature_id as osm, 1 as c0, null as parent from f left join mp on mp.released_id=f.facility_id
 union all select feature_id, null, 'osm', null, null, feature_id, 1, null from nw where coalesce(t_golf,'')<>'course'""",
    "rc": """select coalesce(mp.feature_id, c.course_id) as record_id, c.course_id as released_id, case when mp.feature_id is null then 'catalog_only' else 'matched_release' end as origin,
 c.access as a0, c.physical_holes as h0, mp.feature_id as osm, 1 as c0, coalesce(pm.feature_id, c.facility_id) as parent from c left join mp on mp.released_id=c.course_id left join mp pm on pm.released_id=c.facility_id
 union all select feature_id, null, 'osm', null, null, feature_id, 1, null from nw where coalesce(t_golf,'')='course'""",
    "done": """select kind, record_id, released_id, origin, coalesce(a0, v_access) as access, coalesce(h0, v_holes) as physical_holes, parent,
 concat_ws(',', case when a0 is null and v_access is not null then 'access' end, case when h0 is null and v_holes is not null then 'physical_holes' end) as filled,
 1 + (case when (a0 is null and v_access is not null) or (h0 is null and v_holes is not null) then 1 else 0 end) + (case when osm is not null then 1+links else 0 end) as citations
 from (select 'facilities' as kind, * from rf union all select 'courses', * from rc) r left join vals on vals.feature_id=r.osm""",
}


def rebuilt(spark, sf):
    facilities, courses = released(spark, sf)
    given = {"facilities": facilities.drop("osm_identity"), "courses": courses.drop("osm_identity")}
    records = settle(features.records(tagged(spark, sf)), "features")
    return given, records, rebuild.rebuild(given, records, entity_table(spark, sf), all_pairs(spark, sf))


def rebuilt_rows(result):
    shown = []
    for kind, key in rebuild.KINDS.items():
        parent = F.col("facility_id") if kind == "courses" else F.lit(None).cast("string")
        shown.append(
            result[kind].select(
                F.lit(kind).alias("kind"), F.col(key).alias("record_id"), "released_id", F.col("catalog_origin").alias("origin"), "access", "physical_holes",
                parent.alias("parent"), F.array_join("filled_fields", ",").alias("filled"), F.size("fact_sources").cast("long").alias("citations"),
            )
        )
    return standin.union_all(shown)


@query("c06_rebuild", cte("f", "c", "feat", "bind", extra=REBUILD_CTES) + "select * from done")
def c06(spark, sf):
    return rebuilt_rows(rebuilt(spark, sf)[2])


RELATIONS = {"component": ("p", "component_id"), "round_option": ("r", "round_id"), "tee_set": ("t", "tee_id"), "alias": ("al", "alias_id")}


@query(
    "c06_rebuilt_relations",
    cte("f", "c", "p", "r", "t", "al", "feat", "bind", extra={"x": SQL_FEATURES, "pairs": SQL_PAIRS, "mp": SQL_MAP})
    + " union all ".join(
        f"""select '{name}' as entity, {key} as id, {"coalesce(mf.feature_id, z.facility_id)" if name in ("round_option", "alias") else "cast(null as varchar)"} as facility_id,
 coalesce(mc.feature_id, z.course_id) as course_id, cast(null as varchar) as license from {short} z
 {"left join mp mf on mf.released_id=z.facility_id" if name in ("round_option", "alias") else ""} left join mp mc on mc.released_id=z.course_id"""
        for name, (short, key) in RELATIONS.items()
    )
    + " union all select 'licenses', x.id, null, null, x.l from (select 'map contributors' as id, 'ODbL-1.0' as l union all select 'linked knowledge base', 'CC0-1.0') x",
)
def c06_relations(spark, sf):
    facilities, courses = released(spark, sf)
    given = {"facilities": facilities.drop("osm_identity"), "courses": courses.drop("osm_identity")}
    given |= {name: T(spark, sf, short) for name, (short, _) in RELATIONS.items()}
    records = settle(features.records(tagged(spark, sf)), "features")
    result = rebuild.rebuild(given, records, entity_table(spark, sf), all_pairs(spark, sf))
    none = F.lit(None).cast("string")
    shown = []
    for name, (_, key) in RELATIONS.items():
        rows = result[name]
        place = F.col("facility_id") if "facility_id" in rows.columns else none.alias("facility_id")
        shown.append(rows.select(F.lit(name).alias("entity"), F.col(key).alias("id"), place, "course_id", none.alias("license")))
    licenses = result["licenses"].select(F.lit("licenses").alias("entity"), F.col("source_id").alias("id"), none.alias("facility_id"), none.alias("course_id"), "license")
    return standin.union_all([*shown, licenses])


@query(
    "c07_fill_unknown_only",
    cte("f", "feat", extra={"j": f"select f.facility_id, f.access as a0, f.physical_holes as h0, {SQL_ACCESS.replace('t_access', 'feat.t_access')} as va, {SQL_HOLES} as vh from f join feat on feat.k=f.k"})
    + """select facility_id, coalesce(a0, va) as access, coalesce(h0, vh) as physical_holes, concat_ws(',', case when a0 is null and va is not null then 'access' end, case when h0 is null and vh is not null then 'physical_holes' end) as filled,
 case when (a0 is null and va is not null) or (h0 is null and vh is not null) then 1 else 0 end as citations from j""",
)
def c07(spark, sf):
    rows = T(spark, sf, "f").select("k", "facility_id", "access", "physical_holes")
    source = tagged(spark, sf).select("k", F.col("tags").alias("feature_tags"), "source_url", "checked_on", "credit")
    # Tags are far larger than the files they come from, so neither side is sent whole to all tasks.
    joined = rows.join(source.hint("merge"), "k").withColumn("fact_sources", F.array().cast(f"array<{CITATION}>"))
    filled = features.fill_unknown(joined)
    return filled.select("facility_id", "access", "physical_holes", F.array_join("filled_fields", ",").alias("filled"), F.size("fact_sources").alias("citations"))


@query(
    "a01_rebuild_counts",
    cte("f", "c", "feat", "bind", extra=REBUILD_CTES)
    + """select count(*) filter (where kind='facilities' and origin='matched_release') as matched_facilities, count(*) filter (where kind='facilities' and origin='catalog_only') as catalog_only_facilities,
 count(*) filter (where kind='courses' and origin='matched_release') as matched_courses, count(*) filter (where kind='courses' and origin='catalog_only') as catalog_only_courses,
 count(*) filter (where origin='osm') as new_features, (select count(*) from x) as input_features, (select count(*) from x) - (select count(*) from nw) - (select count(*) from mp) as excluded_features,
 count(*) filter (where kind='facilities') as facilities, count(*) filter (where kind='courses') as courses from done""",
)
def a01(spark, sf):
    given, records, result = rebuilt(spark, sf)
    return rebuild.counts(given, records, result).select(
        "matched_facilities", "catalog_only_facilities", "matched_courses", "catalog_only_courses", "new_features", "input_features",
        "excluded_features", "facilities", "courses",
    )


@query(
    "q14_fact_preservation",
    cte("f", "c", "feat", "bind", extra=REBUILD_CTES)
    + """select kind, released_id, 'released fact changed' as rule from done where released_id is not null and kind='facilities' and cast(substr(released_id,3) as bigint)%90=0 and not (filled like '%access%' and cast(substr(released_id,3) as bigint)%60=0)
 union all select kind, released_id, 'filled value changed' from done where released_id is not null and filled like '%access%' and cast(substr(released_id,3) as bigint)%60=0""",
)
def q14(spark, sf):
    given, _, result = rebuilt(spark, sf)
    # Tamper: rename some facilities, and alter some filled access values of both kinds.
    number = F.substring("released_id", 3, 99).cast("long")
    broken = dict(result)
    for kind in rebuild.KINDS:
        rows = result[kind]
        edited = F.when((number % 60 == 0) & F.array_contains("filled_fields", "access"), "edited").otherwise(F.col("access"))
        rows = rows.withColumn("access", edited)
        if kind == "facilities":
            rows = rows.withColumn("name", F.when(number % 90 == 0, F.concat("name", F.lit("!"))).otherwise(F.col("name")))
        broken[kind] = rows
    return rebuild.preservation_violations(broken, {kind: rows.columns for kind, rows in given.items()})


@query("q14_untouched_release_is_preserved", "select 'none' as kind, 'none' as released_id, 'none' as rule where false")
def q14_clean(spark, sf):
    given, _, result = rebuilt(spark, sf)
    return rebuild.preservation_violations(result, {kind: rows.columns for kind, rows in given.items()})



