"""Projections, scalar functions and canonical forms (inventory P and X)."""

from pyspark.sql import functions as F

from .. import fixed, standin
from ..functions import canon, geo, text
from ..operators import cards, entities, features
from ..session import read
from ..standin import TAGS, cte, tag_column
from .registry import query

T = standin.table


def tagged(spark, sf):
    return standin.with_tags(T(spark, sf, "feat"))


# The contact patterns in the check dialect, which has no look-around.
SQL_EMAIL = r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
SQL_PHONE = r"(^|[^0-9])((?:\+?1[ .-]?)?\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4})($|[^0-9])"


def sql_clean(column):
    masked = f"regexp_replace({column}, '{SQL_EMAIL}', '[contact removed]', 'gi')"
    masked = rf"regexp_replace({masked}, '{SQL_PHONE}', '\1[contact removed]\3', 'g')"
    return f"case when lower({column}) like 'mailto:%' or lower({column}) like 'tel:%' then null else {masked} end"


SQL_TAGS = "array_to_string(list_sort(list_filter([" + ", ".join(
    f"'{t}=' || {sql_clean(tag_column(t))}" for t in TAGS if t in fixed.TAG_NAMES
) + "], lambda x: x is not null)), '|')"
SQL_SELECTED = "coalesce(t_leisure='golf_course' or t_golf='course', false)"


def joined_map(column):
    entries = F.transform(F.map_entries(column), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.array_join(F.array_sort(entries), "|")


@query("p01_feature_selection", cte("feat") + f"select feature_id from feat where {SQL_SELECTED}")
def p01(spark, sf):
    return tagged(spark, sf).where(features.is_catalog_feature()).select("feature_id")


@query("p02_tag_whitelist", cte("feat") + f"select feature_id, {SQL_TAGS} as kept_tags from feat")
def p02(spark, sf):
    return tagged(spark, sf).select(
        "feature_id", joined_map(features.source_tags(F.col("tags"))).alias("kept_tags")
    )


SQL_TEXTS = """(select 'documents' as origin, doc_id as id, 0 as turn, text from documents
 union all select 'conversations', conv_id, turn, text from conversations
 union all select 'pages', page_id, 0, html from pages)"""


def texts(spark, sf):
    docs = read(spark, sf, "documents").selectExpr("'documents' as origin", "doc_id as id", "0L as turn", "text")
    talks = read(spark, sf, "conversations").selectExpr("'conversations' as origin", "conv_id as id", "turn", "text")
    pages = read(spark, sf, "pages").selectExpr("'pages' as origin", "page_id as id", "0L as turn", "html as text")
    return docs.unionByName(talks).unionByName(pages)


@query(
    "p03_contact_scrub",
    f"select origin, id, turn, md5({sql_clean('text')}) as cleaned_md5, {sql_clean('text')} <> text as changed from {SQL_TEXTS}",
)
def p03(spark, sf):
    cleaned = texts(spark, sf).withColumn("cleaned", text.clean_text(F.col("text")))
    return cleaned.select(
        "origin", "id", "turn", F.md5("cleaned").alias("cleaned_md5"), (F.col("cleaned") != F.col("text")).alias("changed")
    )


@query(
    "p04_nested_scrub",
    f"""select conv_id, turn, role || '|' || coalesce({sql_clean('text')}, '~') || '|' ||
 coalesce({sql_clean("'Mailto:' || text")}, '~') || '|' || {sql_clean("'ask 212-555-0123 ' || text")} as nested_text
 from conversations""",
)
def p04(spark, sf):
    talks = read(spark, sf, "conversations")
    nested = talks.select(
        "conv_id",
        "turn",
        F.struct(
            "role",
            F.array(F.col("text"), F.concat(F.lit("Mailto:"), "text")).alias("items"),
            F.create_map(F.lit("note"), F.concat(F.lit("ask 212-555-0123 "), "text")).alias("notes"),
        ).alias("value"),
    )
    clean = text.clean_structure(F.col("value"), nested.schema["value"].dataType)
    shown = nested.withColumn("value", clean)
    return shown.select(
        "conv_id",
        "turn",
        F.concat_ws(
            "|",
            "value.role",
            F.array_join("value.items", "|", "~"),
            F.col("value.notes")["note"],
        ).alias("nested_text"),
    )


@query(
    "p05_entity_ids",
    r"""select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(
 text || ' Q' || doc_id || ' xQ5 Q012 Q' || (doc_id%7+1) || '.', '\bQ[1-9][0-9]*\b'))), ',') as entity_ids from documents""",
)
def p05(spark, sf):
    mentioned = F.expr("text || ' Q' || doc_id || ' xQ5 Q012 Q' || (doc_id%7+1) || '.'")
    ids = F.array_join(text.entity_ids(mentioned), ",")
    return read(spark, sf, "documents").select("doc_id", ids.alias("entity_ids"))


SQL_QIDS = r"list_sort(list_distinct(regexp_extract_all(coalesce(t_wikidata,''), '\bQ[1-9][0-9]*\b')))"


@query(
    "p06_feature_records",
    cte("feat")
    + f"""select feature_id, source_url, osm_version, coalesce(t_name, t_name_en) as name, {SQL_TAGS} as kept_tags,
 array_to_string({SQL_QIDS}, ',') as entity_ids,
 array_to_string(list_filter([member_1, member_2], lambda x: x is not null), ',') as members,
 case when latitude is null then 'unknown' when osm_type='node' then 'source_node' else 'derived_inside_source_polygon' end as position_kind
 from feat where {SQL_SELECTED}""",
)
def p06(spark, sf):
    return features.records(tagged(spark, sf)).select(
        "feature_id",
        "source_url",
        "osm_version",
        "name",
        joined_map("tags").alias("kept_tags"),
        F.array_join("wikidata_ids", ",").alias("entity_ids"),
        F.array_join("member_feature_ids", ",").alias("members"),
        "position_kind",
    )


@query(
    "p07_identity_text",
    cte("feat")
    + """select feature_id, case when osm_type in ('node','way') and geometry_status<>'source_polygon'
 then 'osm/' || osm_type || '/' || osm_id end as identity from feat""",
)
def p07(spark, sf):
    # Relations are given an unknown kind and polygons no number, so both must give NULL.
    kind = F.when(F.col("osm_type") == "relation", "area").otherwise(F.col("osm_type"))
    number = F.when(F.col("geometry_status") != "source_polygon", F.col("osm_id"))
    return tagged(spark, sf).select("feature_id", features.identity(kind, number).alias("identity"))


def claims(spark, sf):
    """Entities with typed claims, derived from the event table."""
    events = read(spark, sf, "events").selectExpr(
        "event_id", "event_type", "value", "get_json_object(props, '$.k') as k", "user_id"
    )
    claim = F.struct(
        F.concat_ws("-", "event_type", "event_id").alias("id"),
        F.when(F.col("event_id") % 2 == 0, "preferred").otherwise("normal").alias("rank"),
        F.struct(
            F.lit("value").alias("snaktype"),
            F.struct(F.when(F.col("event_id") % 9 == 0, "Q5").otherwise(F.concat(F.lit("Q"), "k")).alias("value")).alias("datavalue"),
        ).alias("mainsnak"),
        F.create_map(F.lit("P580"), F.array("k"), F.lit("P999"), F.array("event_type")).alias("qualifiers"),
        F.array(F.struct(F.create_map(F.lit("P854"), F.array("k"), F.lit("P1"), F.array("k")).alias("snaks"))).alias("references"),
    )
    return events.select(
        "event_id",
        F.concat(F.lit("Q"), F.col("event_id").cast("string")).alias("entity_id"),
        F.create_map(
            F.when(F.col("event_type") == "click", "P31").otherwise("P84"), F.array(claim),
            F.lit("P18"), F.array(claim),
        ).alias("claims"),
    )


@query(
    "p08_claim_projection",
    """select event_id, case when event_type='click' then 'P31' else 'P84' end as property,
 event_type || '-' || event_id as claim_id, case when event_id%2=0 then 'preferred' else 'normal' end as rank,
 case when event_id%9=0 then 'Q5' else 'Q' || (props->>'k') end as value, 'value' as snaktype, 'P580' as qualifier_keys, 'P854' as reference_keys
 from events""",
)
def p08(spark, sf):
    projected = claims(spark, sf).select("event_id", F.explode(entities.project_claims(F.col("claims"))).alias("property", "items"))
    one = projected.select("event_id", "property", F.explode("items").alias("c"))
    return one.select(
        "event_id",
        "property",
        F.col("c.id").alias("claim_id"),
        "c.rank",
        "c.value",
        "c.snaktype",
        F.array_join(F.map_keys("c.qualifiers"), ",").alias("qualifier_keys"),
        F.array_join(F.map_keys(F.col("c.references")[0]), ",").alias("reference_keys"),
    )


SQL_ACCESS = "case t_access " + " ".join(f"when '{k}' then '{v}'" for k, v in fixed.ACCESS_CODES.items()) + " end"
SQL_GIVEN = "list_filter([t_holes, t_golf_holes], lambda x: x is not null and x <> '')"
SQL_HOLES = (
    f"case when len({SQL_GIVEN})>0 and len(list_filter({SQL_GIVEN}, lambda x: not regexp_full_match(x,'[0-9]+')))=0"
    f" and len(list_distinct(list_transform({SQL_GIVEN}, lambda x: try_cast(x as bigint))))=1"
    f" and try_cast({SQL_GIVEN}[1] as bigint)>0 then try_cast({SQL_GIVEN}[1] as int) end"
)


@query("p09_access_code", cte("feat") + f"select feature_id, {SQL_ACCESS} as access from feat")
def p09(spark, sf):
    return tagged(spark, sf).select("feature_id", features.access_code(features.tag("access")).alias("access"))


@query("p10_agreed_holes", cte("feat") + f"select feature_id, {SQL_HOLES} as physical_holes from feat")
def p10(spark, sf):
    return tagged(spark, sf).select("feature_id", features.agreed_holes(F.col("tags")).alias("physical_holes"))


SQL_STREET = "nullif(concat_ws(' ', nullif(t_a_housenumber,''), nullif(t_a_street,'')),'')"
SQL_HAS_ADDRESS = f"coalesce(t_a_city, t_a_country, t_a_state, {SQL_STREET}) is not null"


@query(
    "p11_new_records",
    cte("feat")
    + f"""select feature_id as facility_id, coalesce(t_name, t_name_en) as name, t_a_state as state, t_a_country as country,
 case when regexp_full_match(t_website,'https?://\\S+') then t_website end as website, latitude, longitude,
 case when latitude is not null then 'property_point' end as location_kind,
 case when {SQL_HAS_ADDRESS} then t_a_city end as address_city,
 case when {SQL_HAS_ADDRESS} then {SQL_STREET} end as address_street_line1,
 case when {SQL_HAS_ADDRESS} then 'published_unspecified' end as address_purpose,
 array_to_string(list_filter(['facility_id', case when coalesce(t_name, t_name_en) is not null then 'name' end,
  case when t_a_state is not null then 'state' end, case when t_a_country is not null then 'country' end,
  case when regexp_full_match(t_website,'https?://\\S+') then 'website' end,
  case when latitude is not null then 'latitude' end, case when latitude is not null then 'longitude' end,
  case when latitude is not null then 'location_kind' end,
  case when t_a_city is not null then 'address_city' end, case when t_a_country is not null then 'address_country' end,
  case when t_a_state is not null then 'address_region' end, case when {SQL_STREET} is not null then 'address_street_line1' end,
  case when {SQL_HAS_ADDRESS} then 'address_purpose' end, 'course_count', 'documented_course_count'], lambda x: x is not null), ',') as cited
 from feat where {SQL_SELECTED}""",
)
def p11(spark, sf):
    made = features.new_records(features.records(tagged(spark, sf)), "facilities")
    return made.select(
        "facility_id", "name", "state", "country", "website", "latitude", "longitude", "location_kind",
        "address_city", "address_street_line1", "address_purpose",
        F.array_join(F.col("fact_sources")[0]["fields"], ",").alias("cited"),
    )


ADDRESS = ["text", "purpose", "street_line1", "street_line2", "city", "region", "postal_code", "country"]
SQL_BLOCK = " || '|' || ".join(f"coalesce(address_{n},'~')" for n in ADDRESS)
SQL_ANY = "coalesce(" + ", ".join(f"address_{n}" for n in ADDRESS) + ") is not null"


def shown_address(column):
    return F.concat_ws("|", *[F.coalesce(F.col(f"{column}.{n}"), F.lit("~")) for n in ADDRESS + ["scope"]])


@query(
    "p12_address_block",
    cte("f") + f"select facility_id, case when {SQL_ANY} then {SQL_BLOCK} || '|facility' end as address from f",
)
def p12(spark, sf):
    rows = T(spark, sf, "f").withColumn("address", cards.address_block("facility"))
    shown = F.when(F.col("address").isNotNull(), shown_address("address"))
    return rows.select("facility_id", shown.alias("address"))


SQL_COURSE_ANY = "coalesce(c.address_city, c.address_region, c.address_street_line1) is not null"


@query(
    "p13_address_inheritance",
    cte("f", "c")
    + """select c.course_id, case c.address_mode when 'inherit' then f.address_city when 'override' then c.address_city end as city,
 case when c.address_mode='inherit' and coalesce(f.address_text,f.address_purpose,f.address_street_line1,f.address_street_line2,f.address_city,f.address_region,f.address_postal_code,f.address_country) is not null then 'facility'
  when c.address_mode='override' and coalesce(c.address_city, c.address_region, c.address_street_line1) is not null then 'course' end as scope
 from c left join f on f.facility_id=c.facility_id""",
)
def p13(spark, sf):
    listed = cards.course_listing(T(spark, sf, "c"), T(spark, sf, "f"), "left")
    return listed.select("course_id", F.col("address.city").alias("city"), F.col("address.scope").alias("scope"))


@query(
    "p14_display_location",
    cte("f", "feat")
    + """select f.facility_id, coalesce(feat.latitude, f.latitude) as latitude, coalesce(feat.longitude, f.longitude) as longitude,
 case when feat.latitude is not null then 'property_point' else f.location_kind end as kind from f left join feat on feat.k=f.k""",
)
def p14(spark, sf):
    feature = T(spark, sf, "feat").selectExpr("k", "latitude as x", "longitude as y")
    rows = T(spark, sf, "f").join(feature, "k", "left")
    shown = geo.display_location(
        geo.point(F.col("x"), F.col("y"), F.lit("property_point")),
        geo.point(F.col("latitude"), F.col("longitude"), F.col("location_kind")),
    )
    return rows.select("facility_id", shown.alias("at")).select("facility_id", "at.*")


SQL_ELIGIBLE = "case when nonmember_bookable is not null then nonmember_bookable when access='public' then true when access is null then null else false end"
SQL_BASIS = "case when nonmember_bookable is not null then 'explicit_nonmember_fact' when access='public' then 'accepted_public_play_with_qualification' else 'unknown_or_nonpublic_access' end"


@query(
    "p15_planning_eligibility",
    cte("c") + f"select course_id, {SQL_ELIGIBLE} as plan_eligible, {SQL_BASIS} as planning_basis from c",
)
def p15(spark, sf):
    return T(spark, sf, "c").select("course_id", *cards.eligibility())


@query(
    "p16_stored_booleans",
    cte("c") + "select course_id, nonmember_bookable from c",
)
def p16(spark, sf):
    stored = T(spark, sf, "c").withColumn("nonmember_bookable", F.col("nonmember_bookable").cast("int"))
    return cards.booleans(stored, ["nonmember_bookable"]).select("course_id", "nonmember_bookable")


SQL_LINE = (
    "coalesce(address_text, nullif(concat_ws(', ', nullif(address_street_line1,''), nullif(address_street_line2,''),"
    " nullif(concat_ws(', ', address_city, address_region, address_postal_code),''), nullif(address_country,'')),''), 'Address not recorded')"
)


@query(
    "p17_labels",
    cte("f", "c")
    + f"""select course_id as id, coalesce(name, 'Unnamed golf course · ' || coalesce(facility_id, course_id)) as label,
 case access when 'public' then 'Public play' when 'private' then 'Private' when 'restricted' then 'Restricted' else 'Access unconfirmed' end as access_label,
 case style when 'regulation' then 'Regulation' when 'executive' then 'Executive' when 'par_3' then 'Par3' when 'pitch_and_putt' then 'Pitch & Putt' when 'putting' then 'Grass Putting' end as style_label,
 null as address_line from c
 union all select facility_id, name, case access when 'public' then 'Public play' when 'private' then 'Private' when 'restricted' then 'Restricted' else 'Access unconfirmed' end, null, {SQL_LINE} from f""",
)
def p17(spark, sf):
    none = F.lit(None).cast("string")
    courses = T(spark, sf, "c").select(
        F.col("course_id").alias("id"),
        text.record_label(F.col("name"), none, F.coalesce("facility_id", "course_id"), "course").alias("label"),
        text.access_label(F.col("access")).alias("access_label"),
        text.style_label(F.col("style")).alias("style_label"),
        none.alias("address_line"),
    )
    facilities = T(spark, sf, "f").select(
        F.col("facility_id").alias("id"),
        text.record_label(F.col("name"), none, F.col("facility_id"), "facility").alias("label"),
        text.access_label(F.col("access")).alias("access_label"),
        none.alias("style_label"),
        text.one_line_address(
            *[F.col("address_" + n) for n in ["text", "street_line1", "street_line2", "city", "region", "postal_code", "country"]]
        ).alias("address_line"),
    )
    return courses.unionByName(facilities)


@query(
    "p18_mappable",
    cte("f")
    + "select facility_id, coalesce(abs(latitude)<=90 and abs(longitude)<=180 and location_kind in ('property_point','reviewed_osm_point','verified_entrance'), false) as mappable from f",
)
def p18(spark, sf):
    shown = geo.mappable(F.col("facility_id"), F.col("latitude"), F.col("longitude"), F.col("location_kind"))
    return T(spark, sf, "f").select("facility_id", shown.alias("mappable"))


@query(
    "p19_browse_card",
    cte("f", "c")
    + """select c.course_id as id, coalesce(c.name, f.name, 'Unnamed golf course · ' || coalesce(c.facility_id, c.course_id)) as name, coalesce(c.website, f.website) as website,
 case when c.arrival_latitude is not null then 'reviewed_course_arrival' when f.latitude is not null then 'approximate_facility_point' else 'arrival_unavailable' end as routing_basis,
 case when c.arrival_latitude is not null then c.arrival_kind else f.location_kind end as destination_kind,
 f.latitude, f.longitude from c left join f on f.facility_id=c.facility_id""",
)
def p19(spark, sf):
    listed = cards.course_listing(T(spark, sf, "c"), T(spark, sf, "f"), "left")
    return cards.browse_cards(listed).select(
        "id", "name", "website", "routing_basis", "destination_kind", "latitude", "longitude"
    )


SQL_DISTANCE = (
    "6371.0088*2*asin(least(1.0, sqrt(pow(sin((radians({b})-radians({a}))/2),2)"
    " + cos(radians({a}))*cos(radians({b}))*pow(sin(radians({d}-({c}))/2),2))))"
)


def sql_distance(a, c, b, d):
    return SQL_DISTANCE.format(a=a, b=b, c=c, d=d)


@query(
    "p20_distance_km",
    cte("f", "c")
    + f"""select c.course_id, round({sql_distance('c.arrival_latitude','c.arrival_longitude','f.latitude','f.longitude')}, 6) as km
 from c join f on f.facility_id=c.facility_id""",
)
def p20(spark, sf):
    pairs = T(spark, sf, "c").select("course_id", "facility_id", "arrival_latitude", "arrival_longitude").join(
        T(spark, sf, "f").select("facility_id", "latitude", "longitude"), "facility_id"
    )
    km = geo.distance_km(F.col("arrival_latitude"), F.col("arrival_longitude"), F.col("latitude"), F.col("longitude"))
    return pairs.select("course_id", F.round(km, 6).alias("km"))


SQL_TYPED = "case when k%5=0 then '+' || (k%120) || '.5 , -' || (k%200) || '.' when k%5=1 then (k%90) || ',' || (k%180) when k%5=2 then '.5,.25' when k%5=3 then (k%90) || ' ' || (k%180) else 'x' || k end"


@query(
    "p21_parse_coordinate",
    cte("f", extra={"typed": f"select facility_id, {SQL_TYPED} as typed from f", "cut": r"""select facility_id,
 try_cast(nullif(regexp_extract(typed, '^\s*([+-]?(?:\d+(?:\.\d*)?|\.\d+))\s*,\s*([+-]?(?:\d+(?:\.\d*)?|\.\d+))\s*$', 1),'') as double) as a,
 try_cast(nullif(regexp_extract(typed, '^\s*([+-]?(?:\d+(?:\.\d*)?|\.\d+))\s*,\s*([+-]?(?:\d+(?:\.\d*)?|\.\d+))\s*$', 2),'') as double) as b from typed"""})
    + """select facility_id, case when abs(a)<=90 and abs(b)<=180 then a end as latitude, case when abs(a)<=90 and abs(b)<=180 then b end as longitude,
 case when abs(a)<=90 and abs(b)<=180 then a between -10 and 60 and b between -120 and 90 end as in_core from cut""",
)
def p21(spark, sf):
    typed = T(spark, sf, "f").select("facility_id", F.expr(SQL_TYPED).alias("typed"))
    at = typed.select("facility_id", text.parse_coordinate(F.col("typed")).alias("at"))
    return at.select("facility_id", "at.latitude", "at.longitude").withColumn(
        "in_core", text.inside_core(F.col("latitude"), F.col("longitude"), (-10, -120, 60, 90))
    )


@query(
    "p22_duration_and_place_text",
    cte("f", "c")
    + """select course_id as id, case when k%9=0 then 'Unavailable' when cast(floor(k*7/60.0+0.5) as bigint)<60 then cast(floor(k*7/60.0+0.5) as bigint) || ' min'
 when cast(floor(k*7/60.0+0.5) as bigint)%60=0 then cast(floor(cast(floor(k*7/60.0+0.5) as bigint)/60) as bigint) || ' hr'
 else cast(floor(cast(floor(k*7/60.0+0.5) as bigint)/60) as bigint) || ' hr ' || (cast(floor(k*7/60.0+0.5) as bigint)%60) || ' min' end as shown from c
 union all select facility_id, case when latitude is null then '' else printf('%.5f, %.5f', latitude, longitude) end || ' / ' ||
 concat_ws(', ', name, nullif(address_street_line1,''), case when address_city<>name then address_city end, case when state<>coalesce(address_city,'') then state end) from f""",
)
def p22(spark, sf):
    seconds = F.when(F.col("k") % 9 == 0, F.lit(None)).otherwise(F.col("k") * 7).cast("double")
    times = T(spark, sf, "c").select(F.col("course_id").alias("id"), text.duration(seconds).alias("shown"))
    at = F.coalesce(
        F.when(F.col("latitude").isNotNull(), text.format_coordinate(F.col("latitude"), F.col("longitude"))), F.lit("")
    )
    place = text.geocoder_address(F.col("name"), F.col("address_street_line1"), F.col("address_city"), F.col("state"))
    places = T(spark, sf, "f").select(F.col("facility_id").alias("id"), F.concat(at, F.lit(" / "), place).alias("shown"))
    return times.unionByName(places)


SQL_RING = "case k%5 when 0 then 'AK' when 1 then 'HI' else 'ZZ' end"


@query(
    "p23_inverse_projection",
    cte(
        "f",
        extra={
            "pts": f"""select {SQL_RING} as shape, state as ring, x, y from (
 select k, state, cast(k%1000 as double) as x, cast(k%500 as double)+0.5 as y from f union all
 select k, state, -cast(k%70 as double)-0.25, cast(k%300 as double) from f)""",
            "con": "select (sin(radians(29.5))+sin(radians(45.5)))/2 as n",
            "con2": "select n, pow(cos(radians(29.5)),2)+2*n*sin(radians(29.5)) as c from con",
            "con3": "select n, c, sqrt(c-2*n*sin(radians(38)))/n as rho0 from con2",
            "ats": """select shape, ring, case shape when 'AK' then 72-(y-435)/6 when 'HI' then 23-(y-490)/19
 else degrees(asin((c-pow(sqrt(pow((x-510)/1100,2)+pow(rho0+(y-270)/1100,2))*n,2))/(2*n))) end as lat,
 case shape when 'AK' then (x-25)/4.5-180 when 'HI' then (x-250)/19-161 else degrees(atan2((x-510)/1100, rho0+(y-270)/1100)/n)-96 end as lon
 from pts, con3""",
        },
    )
    + "select shape, ring, round(min(lat),5) as south, round(min(lon),5) as west, round(max(lat),5) as north, round(max(lon),5) as east, count(*) as points from ats group by 1, 2",
)
def p23(spark, sf):
    drawn = T(spark, sf, "f").selectExpr(
        f"{SQL_RING} as shape",
        "state as ring",
        "'M' || (k%1000) || ',' || (k%500) || '.5L-' || (k%70) || '.25,' || (k%300) || 'Z' as d",
    )
    points = drawn.select("shape", "ring", F.explode(geo.ring_points(F.col("d"))).alias("points"))
    points = points.select("shape", "ring", F.explode("points").alias("xy"))
    xy = F.split("xy", ",")
    at = points.select("shape", "ring", geo.unproject(xy[0].cast("double"), xy[1].cast("double"), F.col("shape")).alias("at"))
    return at.groupBy("shape", "ring").agg(
        F.round(F.min("at.latitude"), 5).alias("south"),
        F.round(F.min("at.longitude"), 5).alias("west"),
        F.round(F.max("at.latitude"), 5).alias("north"),
        F.round(F.max("at.longitude"), 5).alias("east"),
        F.count("*").alias("points"),
    )


@query(
    "p24_map_records",
    cte("f", "c")
    + """select facility_id as map_id, 'facility' as record_kind, name, physical_holes from f
 union all select course_id, 'course', name, physical_holes from c where facility_id is null""",
)
def p24(spark, sf):
    return cards.map_records(T(spark, sf, "f"), T(spark, sf, "c")).select(
        F.col("facility_id").alias("map_id"), "record_kind", "name", "physical_holes"
    )


@query(
    "p25_license_fields",
    cte("src")
    + """select source_id, concat_ws('|', case when attribution is not null then 'attribution=' || attribution end,
 case when license is not null then 'license=' || license end, 'source_url=' || url) as public_fields, k%13=0 as rejected from src""",
)
def p25(spark, sf):
    from ..operators import boundary

    raw = T(spark, sf, "src").select(
        "source_id",
        F.map_filter(
            F.create_map(
                F.lit("attribution"), F.col("attribution"), F.lit("license"), F.col("license"),
                F.lit("source_url"), F.col("url"), F.lit("controls_reference"), F.col("controls_reference"),
                F.when(F.col("k") % 13 == 0, "internal_note").otherwise("local_path"), F.lit("x"),
            ),
            lambda _, value: value.isNotNull(),
        ).alias("license"),
    )
    fields, unknown = boundary.license_fields(F.col("license"))
    return raw.select("source_id", joined_map(fields).alias("public_fields"), (F.size(unknown) > 0).alias("rejected"))


PRICE_FIELDS = ["fee_kind", "amount_kind", "currency", "billing_basis", "round_holes", "minimum_age", "maximum_age", "conditions"]


def sql_flat(value):
    return " union all ".join(
        f"select 'price_observation' as domain, price_id as id, '{n}' as field, {value.format(n=n)} as value from price" for n in PRICE_FIELDS
    )


@query(
    "p26_known_facts",
    cte("price") + f"select * from ({sql_flat('cast({n} as varchar)')}) where value is not null",
)
def p26(spark, sf):
    return cards.flat_facts(T(spark, sf, "price"), "price_observation", "price_id", PRICE_FIELDS)


@query(
    "p26_all_facts_with_unconfirmed",
    cte("price") + sql_flat("coalesce(cast({n} as varchar), 'Unconfirmed')"),
)
def p26_all(spark, sf):
    return cards.flat_facts(T(spark, sf, "price"), "price_observation", "price_id", PRICE_FIELDS, known_only=False)


@query(
    "p27_details_view",
    cte("c", "r", "t", "m", "p", extra={
        "own": "select r.round_id, r.course_id from r where r.course_id is not null union select m.round_id, coalesce(m.course_id, p.course_id) from m left join p on p.component_id=m.component_id",
        "ownc": "select distinct round_id, course_id from own where course_id is not null",
        "tees": "select course_id, tee_id, null as round_name from t where course_id is not null union all select o.course_id, t.tee_id, r.name from ownc o join t on t.round_id=o.round_id join r on r.round_id=o.round_id",
        "fr": """select c.course_id, count(*) as n from c join r on r.facility_id=c.facility_id
 left join ownc o on o.round_id=r.round_id and o.course_id=c.course_id where o.round_id is null group by 1""",
        "tc": "select course_id, string_agg(tee_id || coalesce('@' || round_name,''), ',' order by tee_id) as tees from tees group by 1",
    })
    + "select c.course_id, 0 as part, coalesce(tc.tees,'') as tees, coalesce(fr.n,0) as other_facility_rounds from c left join tc on tc.course_id=c.course_id left join fr on fr.course_id=c.course_id",
)
def p27(spark, sf):
    tees, rounds = cards.detail_parts(*[T(spark, sf, n) for n in ["c", "r", "m", "p", "t"]])
    courses = T(spark, sf, "c").select("course_id", "facility_id")
    shown = cards.nest(tees, "course_id", ["tee_id"], F.concat("tee_id", F.coalesce(F.concat(F.lit("@"), "round_name"), F.lit(""))))
    counted = cards.other_rounds(courses, *rounds)
    return (
        courses.join(shown, "course_id", "left")
        .join(counted, "course_id", "left")
        .select(
            "course_id",
            F.coalesce("part", F.lit(0)).alias("part"),
            F.coalesce(F.array_join("items", ","), F.lit("")).alias("tees"),
            F.coalesce("other_facility_rounds", F.lit(0)).alias("other_facility_rounds"),
        )
    )


@query(
    "p27_facility_rounds",
    cte("c", "r", "m", "p", extra={
        "own": "select r.round_id, r.course_id from r where r.course_id is not null union select m.round_id, coalesce(m.course_id, p.course_id) from m left join p on p.component_id=m.component_id",
        "sh": "select distinct o.course_id, r.round_id from own o join r on r.round_id=o.round_id join c on c.course_id=o.course_id where r.facility_id=c.facility_id",
    })
    + """select 'facility' as kind, facility_id as id, 0 as part, string_agg(round_id || '/' || coalesce(name,'~') || '/' || round_holes, ',' order by round_id) as rounds from r where facility_id is not null group by facility_id
 union all select 'own', course_id, 0, string_agg(round_id, ',' order by round_id) from sh group by course_id""",
)
def p27_rounds(spark, sf):
    rounds, members, components = [T(spark, sf, n) for n in ["r", "m", "p"]]
    courses = T(spark, sf, "c").select("course_id", "facility_id")
    listed, own = cards.facility_rounds(courses, rounds, cards.membership(rounds, members, components))
    shown = F.transform("items", lambda r: F.concat(r["round_id"], F.lit("/"), F.coalesce(r["name"], F.lit("~")), F.lit("/"), r["round_holes"].cast("string")))
    whole = listed.select(F.lit("facility").alias("kind"), F.col("facility_id").alias("id"), "part", F.array_join(shown, ",").alias("rounds"))
    return whole.unionByName(own.select(F.lit("own").alias("kind"), F.col("course_id").alias("id"), "part", F.array_join("items", ",").alias("rounds")))


@query(
    "p28_facility_fact_list",
    cte("f")
    + """select facility_id, 1 as at, 'Town' as label, coalesce(nullif(concat_ws(', ', coalesce(address_city,'not recorded'), state),''), 'not recorded') as value from f
 union all select facility_id, 2, 'Website', coalesce(website,'not recorded') from f
 union all select facility_id, 3, 'Access', coalesce(case access when 'public' then 'Public play' when 'private' then 'Private' when 'restricted' then 'Restricted' end,'not recorded') from f
 union all select facility_id, 4, 'Facility holes', coalesce(physical_holes || ' holes','not recorded') from f""",
)
def p28(spark, sf):
    return cards.facility_facts(T(spark, sf, "f"))


@query(
    "p29_map_point",
    cte("f") + "select facility_id, latitude, longitude, location_kind as kind from f",
)
def p29(spark, sf):
    at = geo.point(F.col("latitude"), F.col("longitude"), F.col("location_kind"))
    return T(spark, sf, "f").select("facility_id", at.alias("at")).select("facility_id", "at.*")


FACT_COLUMNS = ["access", "country", "county", "facility_id", "inventory_complete", "name", "physical_holes", "state", "website"]
SQL_JSON = "to_json({" + ", ".join(f"'{n}': {n}" for n in FACT_COLUMNS) + "})"
SQL_SHA = f"sha256({SQL_JSON})"


@query("x01_canonical_json", cte("f") + f"select facility_id, cast({SQL_JSON} as varchar) as canonical from f")
def x01(spark, sf):
    # Columns are given out of order: the canonical text must not depend on it.
    return T(spark, sf, "f").select("facility_id", canon.canonical_json(*reversed(FACT_COLUMNS)).alias("canonical"))


@query("x02_row_digest", cte("f") + f"select facility_id, sha256(cast({SQL_JSON} as varchar)) as digest from f")
def x02(spark, sf):
    return T(spark, sf, "f").select("facility_id", canon.row_digest(*FACT_COLUMNS).alias("digest"))


@query(
    "x03_strict_dates_and_urls",
    cte("c", "src")
    + r"""select course_id as id, cast(try_cast(d as date) as varchar) as valid_date, false as valid_url from
 (select course_id, '20' || lpad(cast(20+k%10 as varchar),2,'0') || '-' || lpad(cast(1+k%13 as varchar),2,'0') || '-' || lpad(cast(1+k%31 as varchar),2,'0') as d from c)
 union all select source_id, null, not (k%4=1 or k%4=2) and regexp_matches(url,'^https?://[^/?#]') from src""",
)
def x03(spark, sf):
    written = F.expr("'20' || lpad(cast(20+k%10 as string),2,'0') || '-' || lpad(cast(1+k%13 as string),2,'0') || '-' || lpad(cast(1+k%31 as string),2,'0')")
    dates = T(spark, sf, "c").select(
        F.col("course_id").alias("id"), canon.strict_date(written).cast("string").alias("valid_date"), F.lit(False).alias("valid_url")
    )
    url = F.expr("case k%4 when 1 then replace(url, '://', '://user:pw@') when 2 then 'ftp' || url else url end")
    urls = T(spark, sf, "src").select(
        F.col("source_id").alias("id"), F.lit(None).cast("string").alias("valid_date"), canon.valid_url(url).alias("valid_url")
    )
    return dates.unionByName(urls)


@query(
    "x04_table_digest",
    cte("f", extra={
        "d": f"select sha256(cast({SQL_JSON} as varchar)) as digest from f",
    })
    + "select sha256(count(*) || " + " || ".join(f"':' || sum(('0x' || substr(digest, {1 + 8 * k}, 8))::bigint)" for k in range(8)) + ") as table_sha256, count(*) as row_count from d",
)
def x04(spark, sf):
    return canon.table_digest(T(spark, sf, "f").select(*FACT_COLUMNS))


SQL_HOST = r"regexp_extract(url, '^https?://([^/?#:]+)', 1)"


@query("x05_canonical_host", cte("src") + f"select source_id, lower({SQL_HOST}) as host from src")
def x05(spark, sf):
    shouted = F.concat(F.upper(canon.url_part(F.col("url"), "host")), F.lit(".."))
    return T(spark, sf, "src").select("source_id", canon.canonical_host(shouted).alias("host"))


@query(
    "x06_canonical_percent",
    cte("src") + "select source_id, url || 'A~%2F%' || upper(substr(lpad(to_hex(128+k%128),2,'0'),1,2)) || '%zz%' as normal from src",
)
def x06(spark, sf):
    escaped = F.expr("url || '%41%7e%2f%' || lower(lpad(hex(128+k%128),2,'0')) || '%zz%'")
    return T(spark, sf, "src").select("source_id", canon.canonical_percent(escaped).alias("normal"))


SQL_PATH = r"regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"


@query(
    "x07_canonical_path",
    cte("src")
    + f"select source_id, case k%4 when 0 then '/x' || {SQL_PATH} when 1 then {SQL_PATH} || '/' when 2 then '/c//d/' else '/' end as path from src",
)
def x07(spark, sf):
    path = canon.url_part(F.col("url"), "path")
    dotted = (
        F.when(F.col("k") % 4 == 0, F.concat(F.lit("/a/../x/."), path))
        .when(F.col("k") % 4 == 1, F.concat(path, F.lit("/y/..")))
        .when(F.col("k") % 4 == 2, F.lit("/a/../../c//d/."))
        .otherwise(F.lit(""))
    )
    return T(spark, sf, "src").select("source_id", canon.canonical_path(dotted).alias("path"))


SQL_QUERY = r"regexp_extract(url, '\?([^#]*)', 1)"


@query(
    "x08_resource_identity",
    cte("src", extra={"i": f"""select regexp_replace({SQL_HOST}, '^(www|m|blog)\\.', '') as site,
 '[null,"' || regexp_replace(lower({SQL_HOST}), '^www\\.', '') || '",null,"' || coalesce(nullif({SQL_PATH},''),'/') || '","' || {SQL_QUERY} || '"]' as identity from src"""})
    + "select identity, count(*) as copies from i group by 1",
)
def x08(spark, sf):
    identity = canon.resource_identity(F.col("url"), hold=True)
    return T(spark, sf, "src").groupBy(identity.alias("identity")).agg(F.count("*").alias("copies"))
