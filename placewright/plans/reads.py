"""Filters, read joins, aggregations, ordering and set operations (inventory F, J, A, O, U)."""

from pyspark.sql import functions as F

from .. import standin
from ..functions import geo
from ..operators import browse, cards, facts, features, ordering
from ..operators.joins import join_known

from ..standin import cte
from .registry import query
from .scalars import SQL_BASIS, SQL_ELIGIBLE, sql_distance, tagged

T = standin.table


def bundle(spark, sf):
    names = {
        "facility": "f", "course": "c", "component": "p", "round_option": "r", "round_component": "m",
        "tee_set": "t", "alias": "al", "source": "src", "source_observation": "obs", "price_observation": "price",
    }
    return {name: T(spark, sf, short) for name, short in names.items()}


def lined_bundle(spark, sf):
    """The bundle for queries that use all tables over order lines: these are drawn from one written copy."""
    lines = standin.line_tables(spark, sf, "p", "m", "t")
    return bundle(spark, sf) | {"component": lines["p"], "round_component": lines["m"], "tee_set": lines["t"]}


CENTER, RADIUS = (10.0, 20.0), 3000.0
NEAR = f"{sql_distance('10.0', '20.0', 'f.latitude', 'f.longitude')} <= 3000"
SQL_PLAN = "(c.nonmember_bookable or (c.nonmember_bookable is null and c.access='public'))"


@query(
    "read_plannable_courses_in_radius",
    cte("f", "c")
    + f"""select c.course_id, c.name, f.name as facility_name, f.state, f.country, c.physical_holes,
 {SQL_ELIGIBLE.replace('access', 'c.access')} as plan_eligible, round({sql_distance('10.0', '20.0', 'f.latitude', 'f.longitude')}, 6) as distance_km
 from f join c on c.facility_id=f.facility_id where {NEAR} and {SQL_PLAN}
 order by f.name, f.facility_id, c.name nulls first, c.course_id limit 100 offset 20""",
)
def plannable(spark, sf, offset=20):
    _, page = browse.query_courses(bundle(spark, sf), limit=100, offset=offset, plan=True, center=CENTER, radius_km=RADIUS)
    return page.select(
        "course_id", "name", "facility_name", "state", "country", "physical_holes", "plan_eligible",
        F.round("distance_km", 6).alias("distance_km"),
    )


@query(
    "f01_equality_filters",
    cte("f", "c")
    + """select c.course_id, f.state, c.style from c join f on f.facility_id=c.facility_id
 where f.country='ASIA' and c.access is null and c.style='par_3' and c.physical_holes=9""",
)
def f01(spark, sf):
    listed = cards.course_listing(
        T(spark, sf, "c").where(browse.equality(F.col("access"), "unknown", unknown=True))
        .where(browse.equality(F.col("style"), "par_3", unknown=True))
        .where(browse.whole(F.col("physical_holes"), 9)),
        T(spark, sf, "f").where(browse.equality(F.col("country"), "ASIA")),
    )
    return listed.select("course_id", "state", "style")


@query(
    "f02_literal_search",
    cte("f", "al")
    + """select facility_id, name from f where contains(lower(name), 'r#00000012')
 or facility_id in (select facility_id from al where contains(lower(name), 'r#00000012') and facility_id is not null)""",
)
def f02(spark, sf):
    return browse.matching_names(T(spark, sf, "f"), "facility_id", T(spark, sf, "al"), " R#00000012 ").select(
        "facility_id", "name"
    )


@query("f02_literal_search_wildcards", cte("f") + "select facility_id from f where contains(name, '%') or contains(name, '_')")
def f02b(spark, sf):
    percent = browse.matching_names(T(spark, sf, "f"), "facility_id", T(spark, sf, "al"), "%")
    under = browse.matching_names(T(spark, sf, "f"), "facility_id", T(spark, sf, "al"), "_")
    return percent.select("facility_id").unionByName(under.select("facility_id"))


@query(
    "f03_box_across_date_line",
    cte("f") + "select facility_id from f where latitude between -30 and 45.5 and (longitude >= 150 or longitude <= -120)",
)
def f03(spark, sf):
    box = browse.box_filter(F.col("latitude"), F.col("longitude"), (-30, 150, 45.5, -120))
    return T(spark, sf, "f").where(box).select("facility_id")


@query(
    "f04_radius_with_distance",
    cte("f")
    + f"select facility_id, round({sql_distance('10.0', '20.0', 'latitude', 'longitude')}, 6) as distance_km from f where {NEAR}",
)
def f04(spark, sf):
    place = F.col("latitude"), F.col("longitude")
    near = T(spark, sf, "f").where(browse.radius_filter(*place, CENTER, RADIUS))
    return near.select("facility_id", F.round(geo.distance_km(F.lit(10.0), F.lit(20.0), *place), 6).alias("distance_km"))


@query(
    "f05_plannable_reviewed",
    cte("c") + f"select course_id from c where {SQL_PLAN} and identity_status='operator_defined'",
)
def f05(spark, sf):
    reviewed = F.col("identity_status") == "operator_defined"
    return T(spark, sf, "c").where(browse.plannable() & reviewed).select("course_id")


SQL_BELONGS = (
    "select round_id, course_id from r where course_id is not null union select m.round_id, coalesce(m.course_id, p.course_id)"
    " from m left join p on p.component_id=m.component_id where coalesce(m.course_id, p.course_id) is not null"
)


@query(
    "f06_has_round_of_length",
    cte("c", "r", "m", "p", extra={"own": SQL_BELONGS})
    + "select course_id from c where course_id in (select own.course_id from own join r on r.round_id=own.round_id where r.round_holes=9)",
)
def f06(spark, sf):
    b = bundle(spark, sf)
    belongs = cards.membership(b["round_option"], b["round_component"], b["component"])
    return browse.with_round(b["course"], belongs, b["round_option"], 9).select("course_id")


@query(
    "f07_browse_predicate",
    cte("f", "c")
    + f"""select c.course_id from c join f on f.facility_id=c.facility_id where f.latitude between -40 and 40 and f.longitude between -90 and 90
 and {SQL_ELIGIBLE.replace('access', 'c.access')} and c.physical_holes=18 and c.style='putting' and c.game_kind<>'obstacle_minigolf'
 union all select c.course_id from c join f on f.facility_id=c.facility_id where c.access is null and f.state='NATION_3'""",
)
def f07(spark, sf):
    listed = browse.entries(T(spark, sf, "f"), T(spark, sf, "c")).where(F.col("course_id").isNotNull())
    one = browse.course_matches(access="nonmember", holes="18", style="putting", bounds=(-40, -90, 40, 90))
    two = browse.course_matches(access="unknown", state="NATION_3")
    return listed.where(one).select("course_id").unionByName(listed.where(two).select("course_id"))


@query(
    "f08_viewport_with_selected_facility",
    cte("f", "c", extra={"held": "select distinct facility_id from c where facility_id is not null"})
    + """select course_id as record_id from c left join f on f.facility_id=c.facility_id
 where (f.latitude between 0 and 60 and f.longitude between 0 and 90) or coalesce(c.facility_id, c.course_id)='f-5'
 union all select facility_id from f where latitude between 0 and 60 and longitude between 0 and 90 and facility_id not in (select facility_id from held)""",
)
def f08(spark, sf):
    shown = browse.viewport_matches((0, 0, 60, 90), "f-5")
    return browse.entries(T(spark, sf, "f"), T(spark, sf, "c")).where(shown).select("record_id")


@query(
    "f09_publication_policy",
    cte("feat", "bind", extra={"matched": "select distinct osm_identity as feature_id from bind where osm_identity is not null"})
    + """select feature_id from feat where coalesce(t_leisure='golf_course' or t_golf='course', false) and
 (feature_id in (select feature_id from matched) or not (coalesce(t_golf,'')<>'course' and coalesce(t_name, t_name_en) is null and geometry_status='source_polygon'))""",
)
def f09(spark, sf):
    matched = T(spark, sf, "bind").where(F.col("osm_identity").isNotNull()).select(F.col("osm_identity").alias("feature_id"))
    return features.publishable(features.records(tagged(spark, sf)), matched).select("feature_id")


@query(
    "f07_browse_groups",
    cte("f", "c", "al")
    + "select c.course_id as record_id from c where c.facility_id in (select facility_id from al where facility_id is not null) union all select facility_id from f where facility_id in (select facility_id from al where facility_id is not null) and facility_id not in (select facility_id from c where facility_id is not null)",
)
def f07_groups(spark, sf):
    wanted = T(spark, sf, "al").where(F.col("facility_id").isNotNull()).select(F.col("facility_id").alias("group_id"))
    return browse.in_groups(browse.entries(T(spark, sf, "f"), T(spark, sf, "c")), wanted).select("record_id")


@query(
    "f11_search_choice_scope",
    cte("f")
    + """select 'state' as kind, facility_id from f where state='NATION_7' union all
 select 'city', facility_id from f where address_city='Town 7' and state='NATION_7' union all select 'facility', facility_id from f where facility_id='f-9'""",
)
def f11(spark, sf):
    rows = T(spark, sf, "f")
    picked = [("state", "NATION_7"), ("city", "Town 7, NATION_7"), ("facility", "f-9")]
    return standin.union_all(
        [browse.scope_to(rows, kind, value).select(F.lit(kind).alias("kind"), "facility_id") for kind, value in picked]
    )


# --- joins -------------------------------------------------------------------------------------


@query(
    "j05_course_listing",
    cte("f", "c")
    + f"""select c.course_id, f.name as facility_name, f.county, f.access as facility_access, f.operating_status as facility_operating_status,
 f.physical_holes as facility_physical_holes, f.inventory_complete, f.website as facility_website, {SQL_BASIS.replace('access', 'c.access')} as planning_basis
 from c join f on f.facility_id=c.facility_id""".replace("nonmember_c.access", "nonmember_access").replace("unknown_or_nonpublic_c.access", "unknown_or_nonpublic_access"),
)
def j05(spark, sf):
    return cards.course_listing(T(spark, sf, "c"), T(spark, sf, "f")).select(
        "course_id", "facility_name", "county", "facility_access", "facility_operating_status",
        "facility_physical_holes", "inventory_complete", "facility_website", "planning_basis",
    )


@query(
    "j06_fact_views",
    cte("price", "obs", "src")
    + """select x.price_id as id, x.facility_id, x.course_id, x.round_id, o.source_id, s.url as source_url, cast(o.collected_on as varchar) as collected_on,
 o.status, o.conflict, o.qualification, s.license as source_license, s.attribution as source_attribution
 from price x join obs o on o.observation_id=x.observation_id left join src s on s.source_id=o.source_id""",
)
def j06(spark, sf):
    b = bundle(spark, sf)
    return facts.fact_view(b["price_observation"], b["source_observation"], b["source"]).select(
        F.col("price_id").alias("id"), "facility_id", "course_id", "round_id", "source_id", "source_url",
        F.col("collected_on").cast("string").alias("collected_on"), "status", "conflict", "qualification",
        "source_license", "source_attribution",
    )


@query(
    "j06_facts_per_subject",
    cte("price", "obs")
    + """select coalesce(facility_id, course_id, round_id) as subject, 0 as part, string_agg(price_id, ',' order by price_id) as ids, count(*) as facts
 from price join obs on obs.observation_id=price.observation_id group by 1""".replace("facility_id, course_id", "price.facility_id, course_id"),
)
def j06_nested(spark, sf):
    b = bundle(spark, sf)
    view = facts.fact_view(b["price_observation"], b["source_observation"], b["source"])
    nested = facts.per_subject(view, "price_id")
    return nested.select("subject", "part", F.array_join("items", ",").alias("ids"), F.size("items").cast("long").alias("facts"))


@query(
    "j07_event_credits",
    cte("c", extra={
        "credit": """select distinct 'c-' || l_orderkey as event_id, 's-' || l_suppkey as party_id, case l_returnflag when 'A' then 'redesign' when 'R' then 'restoration' end as role from lineitem""",
        "named": "select event_id, party_id, role, s_name from credit join supplier on party_id='s-' || s_suppkey",
    })
    + """select event_id, 0 as part, string_agg(party_id || ':' || coalesce(role,'unconfirmed') || ':' || s_name, ',' order by party_id, coalesce(role,'')) as credits
 from named group by 1""",
)
def j07(spark, sf):
    lines = standin.read(spark, sf, "lineitem").selectExpr(
        "'c-' || l_orderkey as event_id", "'s-' || l_suppkey as party_id",
        "case l_returnflag when 'A' then 'redesign' when 'R' then 'restoration' end as role",
    ).distinct()
    parties = standin.read(spark, sf, "supplier").selectExpr("'s-' || s_suppkey as party_id", "s_name as party_name")
    nested = facts.credits_per_event(lines.withColumn("credit_id", F.concat_ws("/", "party_id", F.coalesce("role", F.lit("")))), parties)
    shown = F.transform(
        "items", lambda c: F.concat_ws(":", c["party_id"], F.coalesce(c["role"], F.lit("unconfirmed")), c["name"])
    )
    return nested.select("event_id", "part", F.array_join(shown, ",").alias("credits"))


@query(
    "j08_round_membership",
    cte("r", "m", "p", extra={"own": SQL_BELONGS}) + "select round_id, course_id from own",
)
def j08(spark, sf):
    b = bundle(spark, sf)
    return cards.membership(b["round_option"], b["round_component"], b["component"])


@query(
    "j08_round_cards",
    cte("r", "m", "t", extra={
        "ms": "select round_id, string_agg(member_id, ',' order by ordinal, member_id) as members from m group by 1",
        "ts": "select round_id, string_agg(tee_id, ',' order by tee_id) as tees from t where round_id is not null group by 1",
    })
    + """select r.round_id, 0 as part, case when r.facility_id is not null then 'facility' else 'course' end as scope, coalesce(members,'') as members, coalesce(tees,'') as tees
 from r left join ms on ms.round_id=r.round_id left join ts on ts.round_id=r.round_id""",
)
def j08_cards(spark, sf):
    made = cards.round_cards(bundle(spark, sf))
    ids = lambda column, field: F.array_join(F.transform(column, lambda x: x[field]), ",")
    return made.select(
        "round_id", "part", "scope", ids("members", "member_id").alias("members"), ids("tee_sets", "tee_id").alias("tees")
    )


@query(
    "j09_destinations",
    cte("f", "c")
    + """select distinct case when c.arrival_latitude is not null then c.course_id else f.facility_id end as id,
 case when c.arrival_latitude is not null then 'course_arrival' else 'facility_estimate' end as scope,
 coalesce(c.arrival_latitude, f.latitude) as latitude, coalesce(c.arrival_longitude, f.longitude) as longitude
 from c left join f on f.facility_id=c.facility_id where coalesce(c.arrival_latitude, f.latitude) is not null""",
)
def j09(spark, sf):
    good, _ = cards.destinations(cards.course_listing(T(spark, sf, "c"), T(spark, sf, "f"), "left"))
    return good.select("id", "scope", "latitude", "longitude")


ORIGINS = [("a", -10.8, 147.3), ("b", 68.3, 114.5), ("c", -32.0, 81.8), ("d", 25.0, -16.5), ("e", 60.0, -179.9)]


@query(
    "j11_nearby_origins",
    cte("f", "c", "r", "m", "p", extra={"own": SQL_BELONGS})
    + f"""select c.course_id from c join f on f.facility_id=c.facility_id where {SQL_PLAN} and f.latitude is not null and (
 {" or ".join(sql_distance(str(a), str(b), 'f.latitude', 'f.longitude') + ' <= 160' for _, a, b in ORIGINS)})
 and c.course_id in (select own.course_id from own join r on r.round_id=own.round_id where r.round_holes=18)""",
)
def j11(spark, sf):
    b = bundle(spark, sf)
    close = b["facility"].where(browse.near_origins(F.col("latitude"), F.col("longitude"), ORIGINS, 160))
    listed = cards.course_listing(b["course"].where(browse.plannable()), close)
    belongs = cards.membership(b["round_option"], b["round_component"], b["component"])
    return browse.with_round(listed, belongs, b["round_option"], 18).select("course_id")


@query(
    "j11_nearby_origin_table",
    cte("f", "c", extra={"o": "select cast((n_nationkey*7)%181-90 as double) as a, cast((n_nationkey*31)%361-180 as double) as b from nation"})
    + f"""select c.course_id from c where c.arrival_latitude is not null and exists (select 1 from o where
 {sql_distance('o.a', 'o.b', 'c.arrival_latitude', 'c.arrival_longitude')} <= 450)""",
)
def j11_table(spark, sf):
    origins = standin.read(spark, sf, "nation").selectExpr(
        "cast((n_nationkey*7)%181-90 as double) as latitude", "cast((n_nationkey*31)%361-180 as double) as longitude"
    )
    places = T(spark, sf, "c").selectExpr("course_id", "arrival_latitude as latitude", "arrival_longitude as longitude")
    return browse.near_table(places, origins, 450).select("course_id")


# Events of a facility, a course or a component, and a credit for each.
_EVENT = [
    "'e-' || substr(course_id, 3) as event_id", "case when k%3=0 then facility_id end as facility_id", "case when k%3=1 then course_id end as course_id",
    "case when k%3=2 then 'p-' || substr(course_id, 3) || '-1' end as component_id",
]
_EVENTS = f"select {', '.join(_EVENT)} from (select *, cast(substr(course_id, 3) as bigint) as k from c)"


@query(
    "j17_owner_resolution",
    cte("f", "c", "p", "r", "m", "t", "al", "obs", "price", extra={
        "oc": "select course_id as id, facility_id from c", "op": "select p.component_id as id, oc.facility_id from p left join oc on oc.id=p.course_id",
        "orr": "select r.round_id as id, coalesce(r.facility_id, oc.facility_id) as facility_id from r left join oc on oc.id=r.course_id",
        "ev": _EVENTS,
        "oe": "select ev.event_id as id, case when ev.facility_id is not null then ev.facility_id when ev.course_id is not null then oc.facility_id else op.facility_id end as facility_id from ev left join oc on oc.id=ev.course_id left join op on op.id=ev.component_id",
    })
    + """select 'facility' as entity, facility_id as id, facility_id from f union all select 'course', id, facility_id from oc union all select 'component', id, facility_id from op union all select 'round_option', id, facility_id from orr
 union all select 'tee_set', t.tee_id, case when t.course_id is not null then oc.facility_id else orr.facility_id end from t left join oc on oc.id=t.course_id left join orr on orr.id=t.round_id
 union all select 'round_component', m.member_id, case when m.course_id is not null then oc.facility_id when m.component_id is not null then op.facility_id else orr.facility_id end
 from m left join oc on oc.id=m.course_id left join op on op.id=m.component_id left join orr on orr.id=m.round_id
 union all select 'alias', al.alias_id, case when al.facility_id is not null then al.facility_id else oc.facility_id end from al left join oc on oc.id=al.course_id
 union all select 'source_observation', observation_id, facility_id from obs
 union all select 'price_observation', pr.price_id, case when pr.facility_id is not null then pr.facility_id when pr.course_id is not null then oc.facility_id else orr.facility_id end
 from price pr left join oc on oc.id=pr.course_id left join orr on orr.id=pr.round_id
 union all select 'architecture_event', id, facility_id from oe union all select 'architecture_credit', 'k-' || r.round_id, oe.facility_id from r left join oe on oe.id='e-' || substr(r.round_id, 3)""",
)
def j17(spark, sf):
    lines = standin.line_tables(
        spark, sf, p=("component_id", "course_id"), m=("member_id", "round_id", "component_id", "course_id"), t=("tee_id", "course_id", "round_id"),
        price=("price_id", "facility_id", "course_id", "round_id"),
    )
    b = bundle(spark, sf) | {"component": lines["p"], "round_component": lines["m"], "tee_set": lines["t"], "price_observation": lines["price"]}
    events = b["course"].withColumn("k", F.expr("cast(substr(course_id, 3) as bigint)")).selectExpr(*_EVENT)
    credits = b["round_option"].selectExpr("'k-' || round_id as credit_id", "'e-' || substr(round_id, 3) as event_id")
    return facts.owners(b | {"architecture_event": events, "architecture_credit": credits})


@query(
    "j18_group_lookup",
    cte("f", "c", extra={"held": "select distinct facility_id from c where facility_id is not null"})
    + """select 'f-7' as asked, course_id as record_id from c where facility_id='f-7' union all
 select 'c-17', course_id from c where course_id='c-17' union all
 select 'f-7', facility_id from f where facility_id='f-7' and facility_id not in (select facility_id from held)""",
)
def j18(spark, sf):
    listed = browse.entries(T(spark, sf, "f"), T(spark, sf, "c"))
    return standin.union_all(
        [browse.group_of(listed, i).select(F.lit(i).alias("asked"), "record_id") for i in ("f-7", "c-17")]
    )


# --- aggregations ------------------------------------------------------------------------------


@query(
    "a02_geometry_histogram",
    cte("feat")
    + "select geometry_status, count(*) as features, count(*) filter (where geometry_status in ('invalid_source_polygon','assembly_failed')) as failures from feat group by 1",
)
def a02(spark, sf):
    return features.geometry_histogram(tagged(spark, sf))


@query(
    "a04_facility_inventory",
    cte("f", "c", extra={"i": """select facility_id, count(*) as course_count, count(*) filter (where identity_status='operator_defined') as documented,
 string_agg(course_id || '=' || coalesce(physical_holes||'','~') || '/' || coalesce(access,'~'), ',' order by course_id) as ids,
 string_agg(course_id, ',' order by course_id) filter (where identity_status='operator_defined') as documented_ids from c where facility_id is not null group by 1"""})
    + """select f.facility_id, 0 as part, coalesce(course_count,0) as course_count, coalesce(documented,0) as documented_course_count, coalesce(ids,'') as inventory, coalesce(documented_ids,'') as documented_ids
 from f left join i on i.facility_id=f.facility_id""",
)
def a04(spark, sf):
    made = cards.facility_inventory(T(spark, sf, "f"), T(spark, sf, "c"))
    shown = F.transform(
        "course_inventory",
        lambda c: F.concat(
            c["course_id"], F.lit("="), F.coalesce(c["physical_holes"].cast("string"), F.lit("~")), F.lit("/"), F.coalesce(c["access"], F.lit("~"))
        ),
    )
    return made.select(
        "facility_id", "part", "course_count", "documented_course_count",
        F.array_join(shown, ",").alias("inventory"), F.array_join("documented_course_ids", ",").alias("documented_ids"),
    )


@query(
    "a05_course_counts",
    cte("f", "c", extra={"n": "select facility_id, count(*) as n from c where facility_id is not null group by 1"})
    + "select f.facility_id, coalesce(n, 0) as course_count from f left join n on n.facility_id=f.facility_id",
)
def a05(spark, sf):
    return facts.course_counts(T(spark, sf, "f"), T(spark, sf, "c"))


@query(
    "a06_coincident_points",
    cte("f", extra={"g": "select *, cast(floor(latitude/10)*10 as int) as y, cast(floor(longitude/10)*10 as int) as x from f where latitude is not null and location_kind<>'address_range_estimate'"})
    + "select y || '.0,' || x || '.0' as point, 0 as part, string_agg(facility_id, ',' order by facility_id) as ids from g group by 1",
)
def a06(spark, sf):
    # Snapped to a 10 degree grid, so that points do coincide.
    snapped = T(spark, sf, "f").withColumn("latitude", F.floor(F.col("latitude") / 10) * 10.0).withColumn(
        "longitude", F.floor(F.col("longitude") / 10) * 10.0
    )
    in_range = snapped.where(F.col("longitude").isNotNull())
    return browse.coincident_points(in_range).select("point", "part", F.array_join("items", ",").alias("ids"))


@query(
    "a07_city_groups",
    cte("f") + "select address_city || ', ' || state as city, 0 as part, string_agg(facility_id, ',' order by facility_id) as ids from f where address_city is not null group by 1",
)
def a07(spark, sf):
    placed = T(spark, sf, "f").withColumn("city", browse.city_label())
    return cards.nest(placed, "city", ["facility_id"], F.col("facility_id")).select(
        "city", "part", F.array_join("items", ",").alias("ids")
    )


@query(
    "a08_progress_counts",
    cte("f", extra={"x": "select coalesce(latitude is not null and location_kind<>'address_range_estimate', false) as ok from f"})
    + "select count(*) as total, count(*) filter (where ok) as on_map, count(*) filter (where not ok) as pending from x",
)
def a08(spark, sf):
    return browse.catalog_counts(T(spark, sf, "f"))


@query(
    "a11_sibling_groups",
    cte("c") + "select facility_id, count(*) as siblings from c where facility_id is not null group by 1 having count(*) >= 2",
)
def a11(spark, sf):
    return browse.sibling_groups(T(spark, sf, "c"))


@query(
    "a12_course_cards",
    cte("f", "c", "p", "t", "r", "m", "al", extra={
        "own": SQL_BELONGS,
        "ps": "select course_id, string_agg(component_id || ':' || physical_holes, ',' order by component_id) as v from p group by 1",
        "ts": "select course_id, string_agg(tee_id, ',' order by tee_id) as v from t where course_id is not null group by 1",
        "als": "select course_id, string_agg(name, ',' order by alias_id) as v from al where course_id is not null group by 1",
        "rs": "select own.course_id, string_agg(r.round_id || ':' || case when r.facility_id is not null then 'facility' else 'course' end, ',' order by r.round_id) as v from own join r on r.round_id=own.round_id group by 1",
    })
    + """select c.course_id, 0 as part, f.name as facility_name, coalesce(ps.v,'') as components, coalesce(ts.v,'') as tees, coalesce(als.v,'') as aliases, coalesce(rs.v,'') as rounds
 from c left join f on f.facility_id=c.facility_id left join ps on ps.course_id=c.course_id left join ts on ts.course_id=c.course_id
 left join als on als.course_id=c.course_id left join rs on rs.course_id=c.course_id""",
)
def a12(spark, sf):
    made = cards.course_cards(lined_bundle(spark, sf), lists=["components", "tee_sets", "aliases", "round_options"])
    pair = lambda column, a, b: F.array_join(F.transform(column, lambda x: F.concat_ws(":", x[a], x[b].cast("string"))), ",")
    one = lambda column, a: F.array_join(F.transform(column, lambda x: x[a]), ",")
    return made.select(
        "course_id", "part", "facility_name", pair("components", "component_id", "physical_holes").alias("components"),
        one("tee_sets", "tee_id").alias("tees"), one("aliases", "name").alias("aliases"),
        pair("round_options", "round_id", "scope").alias("rounds"),
    )


@query(
    "a12_facility_cards",
    cte("f", "c", "r", "al", extra={
        "ci": "select facility_id, string_agg(course_id, ',' order by course_id) as ids from c group by 1",
        "ri": "select facility_id, string_agg(round_id || '/' || round_holes, ',' order by round_id) as ids from r where facility_id is not null group by 1",
        "ai": "select facility_id, string_agg(alias_id || '=' || name, ',' order by alias_id) as ids from al where facility_id is not null group by 1",
    })
    + """select f.facility_id, 0 as part, f.name, f.latitude is not null as mapped, coalesce(ci.ids,'') as courses, coalesce(ri.ids,'') as rounds, coalesce(ai.ids,'') as aliases
 from f left join ci on ci.facility_id=f.facility_id left join ri on ri.facility_id=f.facility_id left join ai on ai.facility_id=f.facility_id""",
)
def a12_facilities(spark, sf):
    made = cards.facility_cards(bundle(spark, sf))
    return made.select(
        "facility_id", "part", "name", F.col("map_location").isNotNull().alias("mapped"),
        F.array_join("course_inventory.course_id", ",").alias("courses"),
        F.array_join(F.transform("round_options", lambda r: F.concat(r["round_id"], F.lit("/"), r["round_holes"].cast("string"))), ",").alias("rounds"),
        F.array_join(F.transform("aliases", lambda a: F.concat(a["alias_id"], F.lit("="), a["name"])), ",").alias("aliases"),
    )


@query(
    "a12_round_contents",
    cte("c", "r", "m", "p", "t", extra={
        "own": "select r.round_id, r.course_id from r where r.course_id is not null union select m.round_id, coalesce(m.course_id, p.course_id) from m left join p on p.component_id=m.component_id",
        "o": "select distinct round_id, course_id from own where course_id is not null",
        "mi": "select o.course_id, string_agg(m.round_id || '#' || m.ordinal || '=' || m.member_id, ',' order by m.round_id, m.ordinal, m.member_id) as ids from m join o on o.round_id=m.round_id group by 1",
        "ti": "select o.course_id, string_agg(t.round_id || '=' || t.tee_id, ',' order by t.round_id, t.tee_id) as ids from t join o on o.round_id=t.round_id group by 1",
    })
    + "select c.course_id, 0 as part, coalesce(mi.ids,'') as members, coalesce(ti.ids,'') as tees from c left join mi on mi.course_id=c.course_id left join ti on ti.course_id=c.course_id",
)
def a12_contents(spark, sf):
    made = cards.course_cards(bundle(spark, sf), lists=["round_members", "round_tee_sets"])
    member = lambda m: F.concat(m["round_id"], F.lit("#"), m["ordinal"].cast("string"), F.lit("="), m["member_id"])
    return made.select(
        "course_id", "part", F.array_join(F.transform("round_members", member), ",").alias("members"),
        F.array_join(F.transform("round_tee_sets", lambda t: F.concat(t["round_id"], F.lit("="), t["tee_id"])), ",").alias("tees"),
    )


@query(
    "a13_extent",
    cte("f") + "select min(latitude) as south, min(longitude) as west, max(latitude) as north, max(longitude) as east from f where state='NATION_4' and latitude is not null",
)
def a13(spark, sf):
    return browse.extent(browse.scope_to(T(spark, sf, "f"), "state", "NATION_4"))


@query("a14_state_choices", cte("f") + "select distinct state from f where state is not null and state<>''")
def a14(spark, sf):
    return facts.state_choices(T(spark, sf, "f"))


# --- ordering ----------------------------------------------------------------------------------


@query(
    "o01_facility_page",
    cte("f", extra={"x": "select * from f where country='EUROPE' and access='public'"})
    + """select facility_id, name, (select count(*) from x) as total, (select count(*) from x) > 60 as has_more from x order by name, facility_id limit 50 offset 10""",
)
def o01(spark, sf):
    total, page = browse.query_facilities(bundle(spark, sf), limit=50, offset=10, country="EUROPE", access="public")
    counted = page.select("facility_id", "name", total.scalar().alias("total"))
    return counted.withColumn("has_more", F.col("total") > 60)


@query(
    "o01_facility_page_after",
    cte("f")
    + """select facility_id, name, (select count(*) from f) as total from f where name > 'Customer#000000500' or (name = 'Customer#000000500' and facility_id > 'f-500') order by name, facility_id limit 100""",
)
def o01_after(spark, sf):
    total, page = browse.query_facilities(bundle(spark, sf), limit=100, after=("Customer#000000500", "f-500"))
    return page.select("facility_id", "name", total.scalar().alias("total"))


SQL_ENTRIES = """select c.course_id as record_id, c.course_id, c.facility_id, coalesce(c.facility_id, c.course_id) as group_id,
 coalesce(c.name, f.name, 'Unnamed golf course · ' || coalesce(c.facility_id, c.course_id)) as label, c.physical_holes, c.access, f.state from c left join f on f.facility_id=c.facility_id
 union all select f.facility_id, null, f.facility_id, f.facility_id, f.name, f.physical_holes, f.access, f.state from f where f.facility_id not in (select facility_id from c where facility_id is not null)"""


@query(
    "o02_catalog_sort_by_holes",
    cte("f", "c", extra={"e": SQL_ENTRIES})
    + "select record_id, row_number() over (order by physical_holes nulls last, label, record_id) as position from e",
)
def o02(spark, sf):
    rows = browse.entries(T(spark, sf, "f"), T(spark, sf, "c")).select("record_id", "physical_holes", "label")
    return ordering.number_rows(rows, ordering.catalog_order("holes")).select("record_id", "position")


@query(
    "o03_browse_order_with_siblings",
    cte("f", "c", extra={"e": SQL_ENTRIES, "s": "select facility_id, count(*) as siblings from c where facility_id is not null group by 1 having count(*)>=2"})
    + """select record_id, group_id, row_number() over (order by label, record_id) as position, coalesce(siblings, 0) as siblings, e.facility_id is null as independent
 from e left join s on s.facility_id=e.facility_id""",
)
def o03(spark, sf):
    courses = T(spark, sf, "c")
    rows = browse.entries(T(spark, sf, "f"), courses).select("record_id", "group_id", "facility_id", "label")
    ordered = ordering.number_rows(rows, ordering.catalog_order("name"))
    return join_known(ordered, browse.sibling_groups(courses), "facility_id").select(
        "record_id", "group_id", "position", F.coalesce("siblings", F.lit(0)).alias("siblings"),
        F.col("facility_id").isNull().alias("independent"),
    )


@query(
    "o04_browse_window",
    cte("f", "c", extra={
        "e": SQL_ENTRIES,
        "k": "select * from e where access='public' and physical_holes=18",
        "g": """select group_id, min(row(label, record_id)) as first,
 case when max(case when course_id='c-25' then 1 else 0 end)=1 then 0 when group_id='f-3' then 1 else 3 end as promo from k group by 1""",
        "n": "select group_id, row_number() over (order by promo, first) as group_rank from g",
        "shown": "select group_id, case when group_rank<=20 then group_rank else 21 end as group_rank from n where group_rank<=20 or group_id='f-1111'",
    })
    + "select k.record_id, cast(shown.group_rank as int) as group_rank, (select count(*) from n where group_rank>20 and group_id<>'f-1111')>0 as more from k join shown on shown.group_id=k.group_id",
)
def o04(spark, sf):
    rows = browse.entries(T(spark, sf, "f"), T(spark, sf, "c"))
    window, more = ordering.browse_window(
        rows, browse.course_matches(access="public", holes="18"), limit=20, active_course="c-25", active_facility="f-3",
        focused_group="f-1111",
    )
    return window.select("record_id", "group_rank", more.scalar().alias("more"))


@query(
    "o04_browse_window_by_holes",
    cte("f", "c", extra={
        "e": SQL_ENTRIES,
        "g": "select group_id, min(row(physical_holes is null, coalesce(physical_holes,0), label, record_id)) as first, max(case when facility_id is null then 1 else 0 end) as orphan from e where access is null group by 1",
        "n": "select group_id, row_number() over (order by orphan desc, first) as group_rank from g",
    })
    + "select e.record_id, cast(n.group_rank as int) as group_rank, (select count(*) from n where group_rank>60)>0 as more from e join n on n.group_id=e.group_id where e.access is null and n.group_rank<=60",
)
def o04_holes(spark, sf):
    rows = browse.entries(T(spark, sf, "f"), T(spark, sf, "c"))
    window, more = ordering.browse_window(rows, browse.course_matches(access="unknown"), sort="holes", limit=60)
    return window.select("record_id", "group_rank", more.scalar().alias("more"))


@query(
    "o05_search",
    cte("f", extra={
        "s": "select n_name as id, 'State ' || n_nationkey as nm from nation",
        "cities": "select address_city || ', ' || state as label, min(row(name, facility_id)) as ord, count(*) as records from f where address_city is not null group by 1",
        "u": """select 'state' as kind, 0 as kr, row(id, id) as ord, id, nm || ' (' || id || ')' as label, 1 as records from s where lower(id)='nation_1' or contains(lower(nm),'nation_1')
 union all select 'city', 1, ord, null, label, records from cities where contains(lower(label),'nation_1')
 union all select 'facility', 2, row(name, facility_id), facility_id, name, 1 from f where contains(lower(name || ' ' || facility_id || ' ' || coalesce(address_city,'') || ' ' || state),'nation_1')""",
    })
    + "select kind, id, label, records from u order by kr, ord limit 12",
)
def o05(spark, sf):
    states = standin.read(spark, sf, "nation").selectExpr("n_name as state_id", "'State ' || n_nationkey as state_name")
    return browse.search_catalog(T(spark, sf, "f"), states, " Nation_1 ").select("kind", "id", "label", "records")


@query(
    "o06_id_order_on_output",
    cte("f") + "select facility_id, row_number() over (order by facility_id) as position from f",
)
def o06(spark, sf):
    return ordering.number_rows(T(spark, sf, "f").select("facility_id"), [F.col("facility_id")])


@query(
    "o07_planning_rank",
    cte("f", "c", "li", extra={
        "e": SQL_ENTRIES,
        "tm": "select 'c-' || l_orderkey as course_id, case when l_discount<0.095 then l_quantity*60 end as seconds from li",
        "mx": "select course_id, case when count(seconds)=count(*) then max(seconds) end as maximum, case when count(seconds)=count(*) then sum(seconds) end as combined from tm group by 1",
        "j": "select e.course_id, label, maximum, combined from e left join mx on mx.course_id=e.course_id where e.course_id is not null",
        "z": "select *, row_number() over (order by maximum nulls last, label, course_id) as position from j",
    })
    + "select course_id, maximum, combined, position, case when maximum is not null then position end as rank from z",
)
def o07(spark, sf):
    times = T(spark, sf, "li").selectExpr(
        "'c-' || l_orderkey as course_id", "case when l_discount<0.095 then l_quantity*60 end as seconds"
    )
    listed = browse.entries(T(spark, sf, "f"), T(spark, sf, "c")).where(F.col("course_id").isNotNull())
    timed = listed.select("course_id", "label").join(ordering.travel_metrics(times), "course_id", "left")
    return ordering.planning_rank(timed, "maximum").select("course_id", "maximum", "combined", "position", "rank")


@query(
    "o08_last_card_per_facility",
    cte("c") + "select facility_id, arg_max(course_id, k) as course_id from c where facility_id is not null group by 1",
)
def o08(spark, sf):
    return ordering.last_card(T(spark, sf, "c"), "k", ["course_id"])


@query(
    "o09_selected_first",
    cte("c")
    + """select course_id, row_number() over (order by case when course_id='c-40' then 0 when facility_id='f-11' then 1 else 2 end, k) as position from c""",
)
def o09(spark, sf):
    rows = T(spark, sf, "c").select("course_id", "facility_id", "k")
    return ordering.selected_first(rows, "c-40", "f-11", [F.col("k")]).select("course_id", "position")


# --- set operations ----------------------------------------------------------------------------


@query(
    "u01_subject_view",
    cte("price", "p", "li", "obs")
    + """select price_id as id, observation_id, facility_id, course_id, round_id from price
 union all select 'ph-' || l_orderkey || '-' || l_linenumber, 'o-' || l_suppkey, null, coalesce(null, p.course_id), null from li left join p on p.component_id='p-' || l_orderkey || '-' || l_linenumber
 union all select 'am-' || observation_id, observation_id, facility_id, null, null from obs""",
)
def u01(spark, sf):
    return facts.subject_view(domains(spark, sf), T(spark, sf, "p"))


def domains(spark, sf, price=None, lines=None):
    """Three observation domains over the stand-ins, of which some may be at hand."""
    price = (T(spark, sf, "price") if price is None else price).withColumnRenamed("price_id", "id")
    physical = (T(spark, sf, "li") if lines is None else lines).selectExpr(
        "'ph-' || l_orderkey || '-' || l_linenumber as id", "'o-' || l_suppkey as observation_id",
        "cast(null as string) as facility_id", "cast(null as string) as course_id", "'p-' || l_orderkey || '-' || l_linenumber as component_id",
    )
    amenity = T(spark, sf, "obs").selectExpr(
        "'am-' || observation_id as id", "observation_id", "facility_id", "cast(null as string) as course_id"
    )
    return {"price_observation": price, "physical_characteristics": physical, "amenity_observation": amenity}


@query(
    "u04_facilities_and_orphan_courses",
    cte("f", "c") + "select facility_id as id, state, website from f union all select course_id, null, website from c where facility_id is null",
)
def u04(spark, sf):
    return cards.map_records(T(spark, sf, "f"), T(spark, sf, "c")).select(F.col("facility_id").alias("id"), "state", "website")



