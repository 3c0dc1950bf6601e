"""Stand-in catalog tables over the given test tables.

Every column is one expression that reads the same in Spark SQL and in DuckDB, so the Spark
side (`table`) and the check side (`cte`) share a single definition. All tables are whole: a
row of the underlying table is never dropped, only described differently.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import read, settle


def _kind(number):
    return f"case ({number})%3 when 0 then 'node' when 1 then 'way' else 'relation' end"


def feature_key(number):
    return f"'osm/' || {_kind(number)} || '/' || ({number})"


_LI = "l_orderkey || '-' || l_linenumber"

FACILITY = {
    "facility_id": "'f-' || c_custkey",
    "k": "c_custkey",
    "name": "c_name",
    "state": "n_name",
    "country": "r_name",
    "county": "case when c_custkey%6=0 then null else 'County ' || (c_custkey%30) end",
    "access": "case c_mktsegment when 'BUILDING' then 'public' when 'AUTOMOBILE' then 'public'"
    " when 'MACHINERY' then 'private' when 'FURNITURE' then 'restricted' end",
    "physical_holes": "case when c_custkey%7=0 then null else cast(9*(1+c_custkey%4) as int) end",
    "inventory_complete": "case c_custkey%5 when 0 then true when 1 then false end",
    "ownership": "case c_mktsegment when 'BUILDING' then 'municipal' when 'MACHINERY' then 'private' end",
    "setting": "case c_custkey%4 when 0 then 'links' when 1 then 'parkland' when 2 then 'desert' end",
    "operating_status": "case c_custkey%3 when 0 then 'open' when 1 then 'planned' end",
    "website": "case when c_custkey%4=0 then null else 'https://www.f' || c_custkey || '.example.com/' end",
    "booking_url": "case when c_custkey%9=0 then 'https://book.example.org/f/' || c_custkey end",
    "latitude": "case when c_custkey%11=0 then null else cast((c_custkey*7919)%18001 as double)/100-90 end",
    "longitude": "case when c_custkey%11=0 then null else cast((c_custkey*104729)%36001 as double)/100-180 end",
    "location_kind": "case when c_custkey%11=0 then null else case c_custkey%4 when 0 then 'property_point'"
    " when 1 then 'reviewed_osm_point' when 2 then 'verified_entrance' else 'address_range_estimate' end end",
    "address_text": "case when c_custkey%17=0 then c_custkey || ' Main Road, ' || n_name end",
    "address_street_line1": "case when c_custkey%3=0 then null else (c_custkey%200+1) || ' Green Lane' end",
    "address_street_line2": "case when c_custkey%19=0 then 'Suite ' || (c_custkey%7) end",
    "address_city": "case when c_custkey%13=0 then null else 'Town ' || (c_custkey%40) end",
    "address_region": "case when c_custkey%8=0 then null else n_name end",
    "address_postal_code": "case when c_custkey%5=0 then null else cast(10000+c_custkey%90000 as string) end",
    "address_country": "case when c_custkey%3=0 then null else 'US' end",
    "address_purpose": "case when c_custkey%3=0 then null else 'published_unspecified' end",
}

COURSE = {
    "course_id": "'c-' || o_orderkey",
    "k": "o_orderkey",
    "facility_id": "case when o_orderkey%17=0 then null else 'f-' || o_custkey end",
    "name": "case when o_orderkey%4=0 then null else 'Course ' || (o_orderkey%1000) end",
    "physical_holes": "case when o_orderkey%7=0 then null else cast(9*(1+o_orderkey%2) as int) end",
    "access": "case o_orderstatus when 'F' then 'public' when 'O' then 'private' end",
    "nonmember_bookable": "case o_orderkey%3 when 0 then true when 1 then false end",
    "booking_conditions": "case when o_orderkey%8=0 then 'Call ahead' end",
    "style": "case o_orderpriority when '1-URGENT' then 'regulation' when '2-HIGH' then 'executive'"
    " when '3-MEDIUM' then 'par_3' when '4-NOT SPECIFIED' then 'pitch_and_putt' else 'putting' end",
    "game_kind": "case when o_orderkey%50=0 then 'obstacle_minigolf' else 'golf' end",
    "identity_status": "case o_orderkey%4 when 0 then 'needs_review' when 1 then 'component' else 'operator_defined' end",
    "operating_status": "case o_orderkey%3 when 0 then 'open' when 1 then 'planned' end",
    "website": "case when o_orderkey%4=1 then 'http://c' || o_orderkey || '.example.net/play' end",
    "address_mode": "case o_orderkey%3 when 0 then 'inherit' when 1 then 'override' else 'suppress' end",
    "address_city": "case when o_orderkey%3=1 then 'Course Town ' || (o_orderkey%60) end",
    "address_region": "case when o_orderkey%6=1 then 'Region ' || (o_orderkey%9) end",
    "address_street_line1": "case when o_orderkey%12=1 then (o_orderkey%300) || ' Links Way' end",
    "arrival_latitude": "case when o_orderkey%5=0 then cast((o_orderkey*7907)%18001 as double)/100-90 end",
    "arrival_longitude": "case when o_orderkey%5=0 then cast((o_orderkey*104723)%36001 as double)/100-180 end",
    "arrival_kind": "case when o_orderkey%5=0 then case when o_orderkey%2=0 then 'verified_entrance' else 'reviewed_osm_point' end end",
    "arrival_reference": "case when o_orderkey%5=0 then 'gate ' || o_orderkey end",
    "total_price": "o_totalprice",
    "opened_on": "cast(o_orderdate as date)",
}

ROUND = {
    "round_id": "'r-' || o_orderkey",
    "facility_id": "case when o_orderkey%4=0 then 'f-' || o_custkey end",
    "course_id": "case when o_orderkey%4<>0 then 'c-' || o_orderkey end",
    "name": "'Round ' || (o_orderkey%50)",
    "round_holes": "cast(case when o_orderkey%3=0 then 9 else 18 end as int)",
    "description": "case when o_orderkey%6=0 then 'Front then back' end",
}

COMPONENT = {
    "component_id": f"'p-' || {_LI}",
    "course_id": "'c-' || l_orderkey",
    "name": "'Nine ' || l_linenumber",
    "physical_holes": "cast(l_quantity as int)",
}

MEMBER = {
    "member_id": f"'l-' || {_LI}",
    "round_id": "'r-' || l_orderkey",
    "ordinal": "cast(l_linenumber as int)",
    "component_id": f"case when l_linenumber%2=1 then 'p-' || (case when l_partkey%50=0 then l_orderkey+1 else l_orderkey end) || '-' || l_linenumber end",
    "course_id": "case when l_linenumber%2=0 then 'c-' || l_orderkey end",
    "repetitions": "cast(1+l_linenumber%2 as int)",
}

TEE = {
    "tee_id": f"'t-' || {_LI}",
    "course_id": "case when l_linenumber%3<>0 then 'c-' || l_orderkey end",
    "round_id": "case when l_linenumber%3=0 then 'r-' || l_orderkey end",
    "name": "'Tee ' || l_returnflag",
    "yardage": "case when l_quantity>45 then null else l_quantity*100 end",
    "yardage_unit": "case when l_quantity>40 then null else 'yards' end",
    "par": "cast(l_quantity+26 as int)",
    "slope": "cast(50+l_quantity*2 as int)",
}

PRICE = {
    "price_id": f"'pr-' || {_LI}",
    "observation_id": "'o-' || l_partkey",
    "facility_id": "case when l_linenumber%3=0 then 'f-' || l_suppkey end",
    "course_id": "case when l_linenumber%3=1 then 'c-' || l_orderkey end",
    "round_id": "case when l_linenumber%3=2 then 'r-' || l_orderkey end",
    "fee_kind": "case l_returnflag when 'A' then 'green_fee' when 'R' then 'golf_cart' else 'parking' end",
    "amount_min": "l_extendedprice*(1-l_discount)",
    "amount_max": "case when l_discount>0.08 then l_extendedprice*(1-2*l_discount) else l_extendedprice end",
    "amount_kind": "case when l_discount=0 then 'exact' when l_linestatus='F' then 'range' else 'exact' end",
    "currency": "case when l_tax>0.07 then 'usd' when l_tax=0 then null else 'USD' end",
    "billing_basis": "case when l_linestatus='F' then 'per_person' else 'per_cart' end",
    "round_holes": "cast(case when l_linenumber%2=0 then 18 else 9 end as int)",
    "minimum_age": "case when l_quantity>40 then cast(l_quantity as int) end",
    "maximum_age": "case when l_quantity>42 then 45 end",
    "second_round_required": "case when l_linenumber=5 then false end",
    "same_day_second_round_required": "case when l_linenumber in (5,6) then true end",
    "qualifying_prior_round_id": "case when l_linenumber in (5,6) then 'r-' || (l_orderkey-l_orderkey%10) end",
    "source_information_as_of": "cast(l_shipdate as date)",
    "conditions": "case when l_linenumber=7 then 'Weekday only' end",
}

OBSERVATION = {
    "observation_id": "'o-' || event_id",
    "k": "event_id",
    "source_id": "'s-' || user_id",
    "facility_id": "'f-' || user_id",
    "domain": "event_type",
    "collected_on": "cast(ts as date)",
    "value": "value",
    "props": "props",
    "status": "case event_type when 'view' then 'retained' when 'click' then 'confirmed' else 'extracted' end",
    "origin": "case event_type when 'view' then 'retained_input' when 'signup' then 'retained_normalization' else 'new_extraction' end",
    "conflict": "event_type='error'",
    "qualification": "case when event_type='purchase' then 'seen on site' end",
    "retained_facility_id": "case when event_type in ('view','signup') then 'f-' || (case when event_id%20=0 then user_id+1 else user_id end) end",
}

SOURCE = {
    "source_id": "'s-' || page_id",
    "k": "page_id",
    "url": "url",
    "license": "case page_id%4 when 0 then 'CC-BY-4.0' when 1 then 'ODbL-1.0' when 2 then 'custom' end",
    "attribution": "case when page_id%5=0 then null else 'Publisher ' || (page_id%20) end",
    "intake_policy": "case page_id%3 when 0 then 'permitted' when 1 then 'retained_only' else 'blocked' end",
    "controls_reference": "case when page_id%7=0 then 'review/' || page_id end",
}

ALIAS = {
    "alias_id": "'a-' || s_suppkey",
    "facility_id": "case when s_suppkey%2=0 then 'f-' || s_suppkey end",
    "course_id": "case when s_suppkey%2<>0 then 'c-' || s_suppkey end",
    "name": "s_name",
}

# Tag columns of a feature: tag name -> expression.
TAGS = {
    "name": "case when p_partkey%6=0 then null else p_name end",
    "name:en": "case when p_partkey%4=0 then p_name || ' en' end",
    "leisure": "case when p_type in ('ECONOMY','STANDARD','PROMO') then 'golf_course' when p_type='SMALL' then 'park' end",
    "golf": "case when p_type='LARGE' then 'course' when p_type='MEDIUM' then 'hole' end",
    "holes": "case when p_size%5=0 then null when p_size%7=0 then 'about ' || p_size when p_size%9=0 then '0' || p_size else cast(p_size as string) end",
    "golf:holes": "case when p_size%4=0 then cast(p_size as string) when p_size%6=0 then cast(p_size+1 as string) end",
    "access": "case p_partkey%12 when 0 then 'yes' when 1 then 'public' when 2 then 'private' when 3 then 'no' when 4 then 'restricted'"
    " when 5 then 'customers' when 6 then 'permissive' when 7 then 'permit' when 8 then 'guests' when 9 then 'residents' when 10 then 'fee' end",
    "fee": "case when p_partkey%2=0 then 'yes' end",
    "website": "case p_partkey%5 when 0 then 'https://site' || p_partkey || '.example.com/x' when 1 then 'MailTo:club@x.example.com'"
    " when 2 then 'www.noscheme.example.com' when 3 then 'https://has space.example.com/' end",
    "wikidata": "case when p_partkey%7=0 then 'Q12;Q' || (p_partkey%500+1) when p_partkey%3=0 then 'Q' || (p_partkey%500+1) when p_partkey%5=0 then 'xQ7 Q0' end",
    "phone": "'(212) 555-0100'",
    "designer": "case when p_partkey%8=0 then p_name || ' call 212-555-0199 or a@b.example.com' end",
    "addr:housenumber": "case when p_partkey%4=0 then cast(p_partkey%90 as string) end",
    "addr:street": "case when p_partkey%6=0 then 'Mill Road' end",
    "addr:city": "case when p_partkey%5=0 then 'Town ' || (p_partkey%40) end",
    "addr:state": "case when p_partkey%3=0 then 'S' || (p_partkey%25) end",
    "addr:country": "case when p_partkey%10=0 then 'US' end",
}


def tag_column(tag):
    return "t_" + tag.replace(":", "_").replace("addr_", "a_")


FEATURE = {
    "feature_id": feature_key("p_partkey"),
    "k": "p_partkey",
    "osm_type": _kind("p_partkey"),
    "osm_id": "p_partkey",
    "osm_version": "cast(1+p_partkey%5 as int)",
    "longitude": "case when p_partkey%9=0 then null else cast((p_partkey*7901)%36001 as double)/100-180 end",
    "latitude": "case when p_partkey%9=0 then null else cast((p_partkey*7883)%18001 as double)/100-90 end",
    "geometry_status": "case when p_partkey%9=0 then 'not_assembled' when p_partkey%3=0 then 'source_point'"
    " when p_partkey%10=1 then 'invalid_source_polygon' else 'source_polygon' end",
    "member_1": f"case when p_partkey%3=2 then {feature_key('p_partkey-1')} end",
    "member_2": f"case when p_partkey%3=2 then {feature_key('p_partkey*2')} end",
    "source_url": "'https://maps.example.org/' || p_partkey || '/' || (1+p_partkey%5)",
    "checked_on": "'2026-10-25'",
    "credit": "'map contributors'",
} | {tag_column(tag): expression for tag, expression in TAGS.items()}

# Stored identity, or the cited layer, of each released facility; collisions are deliberate.
BINDING = {
    "facility_id": "'f-' || c_custkey",
    "osm_identity": f"case when c_custkey%4=0 then {feature_key('case when c_custkey%12=8 then c_custkey-4 else c_custkey end')} end",
    "layer_1": f"case when c_custkey%4 in (1,2) then {feature_key('case when c_custkey%15=7 then c_custkey-1 else c_custkey end')} end",
    "layer_2": f"case when c_custkey%10=1 then {feature_key('c_custkey+1')} end",
    "location_cited": "c_custkey%6<>5",
}

# Reviewed duplicates: every tenth supplier row is copied under a new key. Releases of a supplier
# come from its own key; the copy is released when the original is not.
DUPLICATE = {
    "facility_id": "'f-' || s_suppkey",
    "name": "s_name",
    "access": "case s_suppkey%4 when 0 then 'public' when 1 then 'private' end",
    "physical_holes": "case when s_suppkey%3=0 then null else cast(9*(1+s_suppkey%2) as int) end",
    "state": "case when s_suppkey%5=0 then null else 'S' || s_nationkey end",
    "website": "case when s_suppkey%6=0 then null else 'https://s' || s_suppkey || '.example.com/' end",
    "latitude": "case when s_suppkey%4=1 then null else cast(s_suppkey%90 as double) end",
    "longitude": "case when s_suppkey%4=1 then null else cast(s_suppkey%180 as double) end",
    "released_id": "case when s_suppkey%2=0 then 'f-' || s_suppkey end",
}

_SOURCES = {
    "f": (FACILITY, "customer join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey"),
    "c": (COURSE, "orders"),
    "r": (ROUND, "orders"),
    "li": (None, None),
    "p": (COMPONENT, "li"),
    "m": (MEMBER, "li"),
    "t": (TEE, "li"),
    "price": (PRICE, "li"),
    "obs": (OBSERVATION, "events"),
    "src": (SOURCE, "pages"),
    "al": (ALIAS, "supplier"),
    "feat": (FEATURE, "part"),
    "bind": (BINDING, "customer"),
    "dup": (DUPLICATE, "supplier"),
}

_LINE_KEY = ["l_orderkey", "l_linenumber"]
_LINE_REST = [
    "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]


def _lines(spark, sf_dir, said=None):
    """One row per (order, line number): the raw pair repeats, so keep the smallest row.

    `said` is text that names the columns that are used. Rows are compared column by column, so the first
    columns of the smallest row are the smallest first columns, and those after the last one used stay unread.
    Rows are dealt by the pair before they are grouped: most pairs stand once in a split of the file, so grouping
    them there too would sort or hash the whole split in one task's memory and combine next to nothing.
    """
    used = [at for at, c in enumerate(_LINE_REST, 1) if said is None or c in said]
    lines = read(spark, sf_dir, "lineitem").repartition(*_LINE_KEY)
    if not used:
        return lines.select(*_LINE_KEY).distinct()
    return (
        lines.groupBy(*_LINE_KEY)
        .agg(F.min(F.struct(*_LINE_REST[: used[-1]])).alias("row"))
        .select(*_LINE_KEY, "row.*")
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    columns, origin = _SOURCES[name]
    if name == "li":
        return _lines(spark, sf_dir)
    if name == "f":
        base = (
            read(spark, sf_dir, "customer")
            .join(read(spark, sf_dir, "nation"), F.expr("c_nationkey=n_nationkey"))
            .join(read(spark, sf_dir, "region"), F.expr("n_regionkey=r_regionkey"))
        )
    elif origin == "li":
        base = _lines(spark, sf_dir, _said(columns))
    else:
        base = read(spark, sf_dir, origin)
    return _described(base, columns)


def _said(columns):
    return " ".join(columns.values())


def _described(base, columns):
    return base.selectExpr(*[f"{expression} as {column}" for column, expression in columns.items()])


def line_tables(spark: SparkSession, sf_dir: str, *names: str, **parts) -> dict:
    """Several tables over the order lines, of one written copy of what they use, so that the lines are dealt once.

    `parts` names the columns that are used of tables that are not used whole; li has the lines themselves.
    """
    tables = {name: _SOURCES[name][0] for name in names}
    tables |= {name: {c: c if name == "li" else _SOURCES[name][0][c] for c in columns} for name, columns in parts.items()}
    said = " ".join(_said(columns) for columns in tables.values())
    lines = settle(_lines(spark, sf_dir, said).select(*[c for c in _LINE_KEY + _LINE_REST if c in said]), "lines")
    return {name: _described(lines, columns) for name, columns in tables.items()}


def with_tags(features: DataFrame) -> DataFrame:
    """Turn the tag columns into one map, leaving out absent tags."""
    entries = F.array(*[F.struct(F.lit(t).alias("key"), F.col(tag_column(t)).alias("value")) for t in TAGS])
    present = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    kept = features.withColumn("tags", present).drop(*[tag_column(t) for t in TAGS])
    members = F.filter(F.array("member_1", "member_2"), lambda m: m.isNotNull())
    position = F.when(F.col("latitude").isNotNull(), F.array("longitude", "latitude"))
    return (
        kept.withColumn("member_feature_ids", members)
        .withColumn("position", position)
        .drop("member_1", "member_2", "longitude", "latitude")
    )


def _body(name):
    columns, origin = _SOURCES[name]
    if name == "li":
        keys = ", ".join(_LINE_KEY)
        order = ", ".join(_LINE_REST)
        return f"select * from lineitem qualify row_number() over (partition by {keys} order by {order}) = 1"
    listed = ", ".join(f"{expression} as {column}" for column, expression in columns.items())
    return f"select {listed} from {origin}"


def cte(*names: str, extra: dict | None = None) -> str:
    """`with ...` text holding the named stand-ins (and what they need), for the check SQL."""
    needed = []
    for name in names:
        origin = _SOURCES[name][1]
        if origin == "li" and "li" not in needed:
            needed.append("li")
        if name not in needed:
            needed.append(name)
    parts = [f"{name} as ({_body(name)})" for name in needed]
    parts += [f"{name} as ({body})" for name, body in (extra or {}).items()]
    return "with " + ",\n".join(parts) + "\n"


def union_all(frames):
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
