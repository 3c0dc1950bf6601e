"""Quality and integrity checks (inventory Q1-Q8, Q12, Q13, Q15, J15, A3)."""

from pyspark.sql import functions as F

from .. import standin
from ..operators import cards, facts, quality
from ..standin import cte
from .reads import SQL_BELONGS, bundle, domains
from .registry import query

T = standin.table


def rule_sql(table, rows, key, rules):
    return " union all ".join(
        f"select '{name}' as rule, '{table}' as \"table\", {key} as id from {rows} where ({text}) is false" for name, text in rules.items()
    )


ADDRESS_SQL = {
    f"address_{n}": f"length(trim(address_{n})) > 0 and length(address_{n}) <= {m}"
    for n, m in [("street_line1", 512), ("street_line2", 512), ("city", 255), ("region", 128), ("postal_code", 32)]
}
CORE_SQL = [
    rule_sql("facility", "f", "facility_id", {
        "name": "length(trim(name)) > 0", "physical_holes": "physical_holes >= 1",
        "access": "access in ('public','private','restricted')", "latitude": "latitude between -90 and 90", "longitude": "longitude between -180 and 180",
        "setting": "setting in ('parkland','links','desert')", "address_country": "regexp_full_match(address_country,'[A-Z]{2}')",
        "latitude and longitude together": "(latitude is null) = (longitude is null)",
        "location kind with location": "latitude is null or location_kind is not null", **ADDRESS_SQL,
    }),
    rule_sql("course", "c", "course_id", {
        "physical_holes": "physical_holes >= 1", "style": "style in ('regulation','executive','par_3','pitch_and_putt','putting')",
        "own address only where overridden": "address_mode='override' or coalesce(address_city, address_region, address_street_line1) is null",
        "arrival_latitude": "arrival_latitude between -90 and 90",
    }),
    rule_sql("component", "p", "component_id", {"physical_holes": "physical_holes >= 1"}),
    rule_sql("round_option", "r", "round_id", {"exactly one subject": "(case when facility_id is null then 0 else 1 end)+(case when course_id is null then 0 else 1 end)=1"}),
    rule_sql("round_component", "m", "member_id", {"ordinal": "ordinal >= 0", "exactly one subject": "(component_id is null) <> (course_id is null)"}),
    rule_sql("tee_set", "t", "tee_id", {
        "par": "par >= 1", "slope": "slope between 55 and 155", "yardage": "yardage > 0", "unit with yardage": "yardage is null or yardage_unit is not null",
    }),
    rule_sql("alias", "al", "alias_id", {"exactly one subject": "(facility_id is null) <> (course_id is null)"}),
]


@query("q01_core_row_rules", cte("f", "c", "p", "r", "m", "t", "al") + " union all ".join(CORE_SQL))
def q01(spark, sf):
    b = bundle(spark, sf)
    names = ["facility", "course", "component", "round_option", "round_component", "tee_set", "alias"]
    found = [quality.check_rows(b[n], n, quality.schemas.KEYS[n]) for n in names]
    return standin.union_all(found).select("rule", "table", "id")


PRICE_SQL = rule_sql("price_observation", "price", "price_id", {
    "fee_kind": "fee_kind in ('green_fee','golf_cart','push_cart','club_rental','nonplayer_rider','range_balls','practice_pass','instruction','booking_fee','membership','event','other_documented')",
    "currency": "regexp_full_match(currency,'[A-Z]{3}')",
    "amount_min": "amount_min between 0 and 1e12", "amount_max": "amount_max between 0 and 1e12",
    "amounts in order": "amount_min <= amount_max",
    "exact price is one amount": "amount_kind<>'exact' or (amount_min is not null and amount_max is not null and amount_min=amount_max)",
    "ages in order": "minimum_age <= maximum_age",
    "same-day round is a second round": "(same_day_second_round_required is distinct from true) or coalesce(second_round_required,false)",
    "exactly one subject": "(case when facility_id is null then 0 else 1 end)+(case when course_id is null then 0 else 1 end)+(case when round_id is null then 0 else 1 end)=1",
})
OBS_SQL = rule_sql("source_observation", "obs", "observation_id", {
    "status": "status in ('retained','extracted','confirmed')",
    "new extraction names source and date": "origin<>'new_extraction' or (source_id is not null and collected_on is not null)",
    "retained evidence is named": "origin not in ('retained_input','retained_normalization') or retained_facility_id is not null",
})


@query("q02_domain_row_rules", cte("price", "obs") + PRICE_SQL + " union all " + OBS_SQL)
def q02(spark, sf):
    b = bundle(spark, sf)
    observations = b["source_observation"].withColumn("retained_group_id", F.lit(None).cast("string"))
    prices = quality.check_rows(b["price_observation"], "price_observation", "price_id")
    return prices.unionByName(quality.check_rows(observations, "source_observation", "observation_id")).select("rule", "table", "id")


PERIOD_SQL = "'op-' || l_orderkey || '-' || l_linenumber"
PERIOD = {
    "id": PERIOD_SQL,
    "annual_start_month": "cast(1+l_linenumber%12 as int)",
    "annual_start_day": "cast(l_quantity%32 as int)",
    "annual_end_month": "case when l_tax>0.04 then cast(l_quantity%14 as int) end",
    "annual_end_day": "case when l_tax>0.02 then 30 end",
    "opens_minute_of_day": "cast(l_partkey%1500 as int)",
    "closes_minute_of_day": "cast(l_suppkey*17%1440 as int)",
    "closes_next_day": "case l_linenumber%3 when 0 then true when 1 then false end",
    "date_from": "cast(l_shipdate as date)",
    "date_to": "case when l_discount>0.05 then date '1999-01-01' end",
    "weekday_mask": "cast(l_quantity*3 as int)",
    "period_kind": "case when l_returnflag='A' then 'season' when l_returnflag='N' then 'holiday' end",
}
PERIOD_CTE = "select " + ", ".join(f"{e} as {n}" for n, e in PERIOD.items()) + " from li"


@query(
    "q02_period_rules",
    cte("li", extra={"op": PERIOD_CTE})
    + rule_sql("operating_period", "op", "id", {
        "annual_start_month": "annual_start_month between 1 and 12", "annual_start_day": "annual_start_day between 1 and 31",
        "annual_end_month": "annual_end_month between 1 and 12", "annual_end_day": "annual_end_day between 1 and 31",
        "opens_minute_of_day": "opens_minute_of_day between 0 and 1439", "weekday_mask": "weekday_mask between 1 and 127",
        "period_kind": "period_kind in ('regular_hours','season','maintenance','closure','planned_reopening')",
        "dates in order": "date_from <= date_to", "end day has a month": "annual_end_day is null or annual_end_month is not null",
        "start day is in the month": "try_cast(printf('2000-%02d-%02d', annual_start_month, annual_start_day) as date) is not null",
        "end day is in the month": "annual_end_day is null or annual_end_month is null or try_cast(printf('2000-%02d-%02d', annual_end_month, annual_end_day) as date) is not null",
        "opening window": "closes_next_day is not null and case when closes_next_day then closes_minute_of_day <= opens_minute_of_day else closes_minute_of_day >= opens_minute_of_day end",
    }),
)
def q02_periods(spark, sf):
    rows = T(spark, sf, "li").selectExpr(*[f"{e} as {n}" for n, e in PERIOD.items()])
    return quality.check_rows(rows, "operating_period", "id").select("rule", "table", "id")


SQL_ROUND_OWNER = "select r.round_id, r.course_id as round_course, coalesce(r.facility_id, c.facility_id) as round_facility from r left join c on c.course_id=r.course_id"


@query(
    "q03_round_scope",
    cte("c", "r", "m", "p", extra={
        "ro": SQL_ROUND_OWNER,
        "mm": "select m.member_id, m.round_id, coalesce(m.course_id, p.course_id) as played from m left join p on p.component_id=m.component_id",
    })
    + """select member_id as id from mm join ro on ro.round_id=mm.round_id left join c on c.course_id=mm.played
 where c.facility_id<>ro.round_facility or mm.played<>ro.round_course""",
)
def q03(spark, sf):
    return quality.check_round_scope(bundle(spark, sf)).select("id")


FACT_GROUP = {
    "group_id": "'g-' || event_id",
    "facility_id": "case when event_id%2=0 then 'f-' || user_id end",
    "course_id": "case when event_id%2<>0 then 'c-' || event_id end",
}
SQL_GROUPS = "select " + ", ".join(f"{e} as {n}" for n, e in FACT_GROUP.items()) + " from events"
SQL_EVIDENCE = "select observation_id, k, facility_id, case when domain='signup' then 'g-' || k end as retained_group_id, retained_facility_id from obs"


def evidence(spark, sf):
    b = bundle(spark, sf)
    b["fact_group"] = standin.read(spark, sf, "events").selectExpr(*[f"{e} as {n}" for n, e in FACT_GROUP.items()])
    b["source_observation"] = b["source_observation"].withColumn(
        "retained_group_id", F.expr("case when domain='signup' then 'g-' || k end")
    )
    return b


@query(
    "q04_observation_scope",
    cte("price", "p", "li", "obs", "c", "r", "m", extra={
        "ev": SQL_EVIDENCE,
        "fg": f"select g.group_id, g.course_id as group_course, coalesce(g.facility_id, c.facility_id) as group_facility from ({SQL_GROUPS}) g left join c on c.course_id=g.course_id",
        "ro": SQL_ROUND_OWNER,
        "own": SQL_BELONGS,
        "subj": """select price_id as id, observation_id, facility_id, course_id, round_id from price
 union all select 'ph-' || l_orderkey || '-' || l_linenumber, 'o-' || l_suppkey, null, p.course_id, null from li left join p on p.component_id='p-' || l_orderkey || '-' || l_linenumber
 union all select 'am-' || observation_id, observation_id, facility_id, null, null from obs""",
        "j": """select s.*, ev.retained_facility_id, fg.group_course, fg.group_facility, ro.round_course, coalesce(s.facility_id, c.facility_id, ro.round_facility) as owner
 from subj s join ev on ev.observation_id=s.observation_id left join fg on fg.group_id=ev.retained_group_id left join c on c.course_id=s.course_id left join ro on ro.round_id=s.round_id""",
    })
    + """select id from j where owner<>retained_facility_id or owner<>group_facility or (group_course is not null and (
 (course_id is not null and course_id<>group_course) or (course_id is null and round_id is null)
 or (round_id is not null and (round_course is null or round_course<>group_course) and not exists (select 1 from own where own.round_id=j.round_id and own.course_id=j.group_course))))""",
)
def q04(spark, sf):
    b = evidence(spark, sf)
    # Of the tables over order lines, what the scope needs, from one written copy.
    lines = standin.line_tables(
        spark, sf, "m", p=("component_id", "course_id"), li=("l_orderkey", "l_linenumber", "l_suppkey"),
        price=("price_id", "observation_id", "facility_id", "course_id", "round_id"),
    )
    subjects = facts.subject_view(domains(spark, sf, lines["price"], lines["li"]), lines["p"])
    belongs = cards.membership(b["round_option"], lines["m"], lines["p"])
    return quality.check_observation_scope(subjects, b, belongs).select("id")


@query(
    "q05_price_bundle_scope",
    cte("price", "c", "r", extra={"ro": SQL_ROUND_OWNER})
    + """select price_id as id from price x join ro prior on prior.round_id=x.qualifying_prior_round_id left join c on c.course_id=x.course_id
 left join ro mine on mine.round_id=x.round_id where coalesce(x.facility_id, c.facility_id, mine.round_facility)<>prior.round_facility""",
)
def q05(spark, sf):
    b = bundle(spark, sf)
    return quality.check_price_bundle(b["price_observation"], b).select("id")


@query(
    "q06_observation_references",
    cte("obs", "c", extra={
        "ev": SQL_EVIDENCE,
        "fg": f"select g.group_id, coalesce(g.facility_id, c.facility_id) as group_facility from ({SQL_GROUPS}) g left join c on c.course_id=g.course_id",
    })
    + "select observation_id as id from ev join fg on fg.group_id=ev.retained_group_id where retained_facility_id<>group_facility",
)
def q06(spark, sf):
    return quality.check_observation_references(evidence(spark, sf)).select("id")


@query(
    "q07_finite_numbers",
    cte("price")
    + "select price_id as id, 'amount_max' as detail from price where round_holes=9 and fee_kind='golf_cart' union all select price_id, 'amount_min' from price where amount_kind='range' and currency='usd'",
)
def q07(spark, sf):
    broken = T(spark, sf, "price").withColumns({
        "amount_max": F.expr("case when round_holes=9 and fee_kind='golf_cart' then cast('-Infinity' as double) else amount_max end"),
        "amount_min": F.expr("case when amount_kind='range' and currency='usd' then cast('NaN' as double) else amount_min end"),
    })
    return quality.check_finite(broken, "price_observation", "price_id").select("id", "detail")


VALUES = """'{"name":"Club ' || event_id || '","physical_holes":' || (case when event_id%4=0 then '"9"' when event_id%4=1 then '9.5' else '9' end)
 || ',"inventory_complete":' || (case when event_id%3=0 then '1' when event_id%3=1 then 'null' else 'true' end)
 || ',"website":"' || (case when event_id%5=0 then 'ftp://x/' when event_id%5=1 then '' else 'https://a.example.com/' end)
 || '","website_checked_on":"2026-02-' || (case when event_id%6=0 then '30' else '03' end) || '","latitude":' || (case when event_id%7=0 then '"x"' else '1.5' end)
 || (case when event_id%8=0 then ',"bogus":1' else '' end) || '}'"""


@query(
    "q08_incoming_values",
    """select event_id as id, 'physical_holes' as field, 'must be integer' as rule from events where event_id%4 in (0,1)
 union all select event_id, 'inventory_complete', 'must be boolean' from events where event_id%3=0
 union all select event_id, 'website', case when event_id%5=0 then 'must be a web link' else 'must be nonblank text' end from events where event_id%5 in (0,1)
 union all select event_id, 'website_checked_on', 'must be a date' from events where event_id%6=0
 union all select event_id, 'latitude', 'must be finite number' from events where event_id%7=0
 union all select event_id, 'bogus', 'unknown field' from events where event_id%8=0""",
)
def q08(spark, sf):
    changes = standin.read(spark, sf, "events").select("event_id", F.expr(VALUES).alias("values"))
    found = quality.check_values(changes, "facility", "event_id", "values")
    return found.select("id", F.col("detail").alias("field"), "rule")


@query(
    "q12_unique_keys",
    """select l_orderkey || '|' || l_linenumber as id, count(*) as copies from lineitem group by l_orderkey, l_linenumber having count(*)>1
 union all select x || '|' || y || '|' || z, n from (select 'c-' || l_orderkey as x, 's-' || l_suppkey as y, l_returnflag as z, count(*) as n from lineitem where l_returnflag<>'N' group by all having count(*)>1)
 union all select x || '|' || y, n from (select 'c-' || l_orderkey as x, 's-' || l_suppkey as y, count(*) as n from lineitem where l_returnflag='N' group by all having count(*)>1)
 union all select '', count(*) from lineitem where l_discount=0 group by l_discount having count(*)>0""",
)
def q12(spark, sf):
    lines = standin.read(spark, sf, "lineitem")
    credits = lines.selectExpr(
        "'c-' || l_orderkey as event_id", "'s-' || l_suppkey as party_id", "case when l_returnflag<>'N' then l_returnflag end as role"
    )
    blank = lines.selectExpr("case when l_discount=0 then '' else 'x' end as line_id")
    missing = quality.check_present(blank, "lineitem", "line_id").groupBy("id").agg(F.count("*").alias("copies"))
    found = [
        quality.check_unique(lines, "lineitem", ["l_orderkey", "l_linenumber"]),
        quality.check_unique(credits, "architecture_credit", ["event_id", "party_id", "role"]),
        quality.check_unique(credits, "architecture_credit", ["event_id", "party_id"], where="role is null"),
    ]
    repeated = standin.union_all(found).select("id", F.col("detail").cast("long").alias("copies"))
    return repeated.unionByName(missing)


@query(
    "q13_immutable_fields",
    cte("obs", "price")
    + """select observation_id as id, f as detail from (select observation_id, unnest([case when k%9=0 and qualification is distinct from 'edited' then 'qualification' end, case when k%14=0 then 'facility_id' end]) as f
 from obs where observation_id in (select observation_id from price)) where f is not null""",
)
def q13(spark, sf):
    old = T(spark, sf, "obs")
    new = old.withColumns({
        "qualification": F.expr("case when k%9=0 then 'edited' else qualification end"),
        "facility_id": F.expr("case when k%14=0 then facility_id || 'x' else facility_id end"),
    })
    fields = ["source_id", "facility_id", "collected_on", "status", "origin", "qualification"]
    return quality.check_immutable(old, new, "observation_id", fields, used=T(spark, sf, "price")).select("id", "detail")


@query(
    "q15_append_only_tail",
    """select event_id, case when event_id%4=3 then null else 'a' || event_id end as head, case when event_id%4=3 then null else case event_id%4 when 0 then '' when 1 then 'c' || event_id else 'b' || event_id || ',c' || event_id end end as tail_ids, event_id%4<3 and event_id%5<>0 as pinned
 from events""".replace("case when event_id%4=3 then null else 'a' || event_id end as head", "case event_id%4 when 3 then null when 0 then 'a' || event_id || ',b' || event_id || ',c' || event_id when 1 then 'a' || event_id || ',b' || event_id else 'a' || event_id end as head"),
)
def q15(spark, sf):
    lists = standin.read(spark, sf, "events").select(
        "event_id",
        F.array(*[F.concat(F.lit(letter), F.col("event_id").cast("string")) for letter in "abc"]).alias("items"),
        F.when(F.col("event_id") % 4 == 3, F.lit(9)).otherwise((F.col("event_id") % 4).cast("int")).alias("n"),
    )
    head, tail = quality.split_tail(F.col("items"), F.col("n"))
    pin = F.sha2(F.array_join(F.when(F.col("event_id") % 5 != 0, tail).otherwise(F.array(F.lit("other"))), ","), 256)
    cut = lists.select("event_id", head.alias("head"), tail.alias("tail"), pin.alias("pin"))
    same = F.coalesce(F.sha2(F.array_join("tail", ","), 256) == F.col("pin"), F.lit(False))
    return cut.select(
        "event_id", F.array_join("head", ",").alias("head"), F.array_join("tail", ",").alias("tail_ids"), same.alias("pinned")
    )


def lost(child, key, column, parent, parent_key, name=None):
    return f"select '{column} in {parent}' as rule, {key} as id from {child} where {column} is not null and {column} not in (select {parent_key} from {name})"


@query(
    "j15_references",
    cte("f", "c", "p", "r", "m", "t", "al", "src", "obs", "price")
    + " union all ".join([
        lost("al", "alias_id", "facility_id", "facility", "facility_id", "f"), lost("al", "alias_id", "course_id", "course", "course_id", "c"),
        lost("p", "component_id", "course_id", "course", "course_id", "c"), lost("c", "course_id", "facility_id", "facility", "facility_id", "f"),
        lost("r", "round_id", "facility_id", "facility", "facility_id", "f"), lost("r", "round_id", "course_id", "course", "course_id", "c"),
        lost("m", "member_id", "round_id", "round_option", "round_id", "r"), lost("m", "member_id", "component_id", "component", "component_id", "p"),
        lost("m", "member_id", "course_id", "course", "course_id", "c"), lost("t", "tee_id", "course_id", "course", "course_id", "c"),
        lost("t", "tee_id", "round_id", "round_option", "round_id", "r"), lost("obs", "observation_id", "source_id", "source", "source_id", "src"),
        lost("obs", "observation_id", "retained_facility_id", "facility", "facility_id", "f"),
        lost("price", "price_id", "observation_id", "source_observation", "observation_id", "obs"),
        lost("price", "price_id", "facility_id", "facility", "facility_id", "f"), lost("price", "price_id", "course_id", "course", "course_id", "c"),
        lost("price", "price_id", "round_id", "round_option", "round_id", "r"),
        lost("price", "price_id", "qualifying_prior_round_id", "round_option", "round_id", "r"),
    ]),
)
def j15(spark, sf):
    return quality.check_references(bundle(spark, sf)).select("rule", "id")


@query(
    "a03_inventory_rule",
    cte("f", "c")
    + """select f.facility_id as id, cast(sum(c.physical_holes) as bigint) as holes from f join c on c.facility_id=f.facility_id
 where f.inventory_complete and f.physical_holes is not null and c.identity_status<>'component' group by f.facility_id, f.physical_holes
 having count(c.physical_holes)=count(*) and sum(c.physical_holes)<>f.physical_holes""",
)
def a03(spark, sf):
    found = quality.check_inventory(T(spark, sf, "f"), T(spark, sf, "c"))
    return found.select("id", F.col("detail").cast("long").alias("holes"))
