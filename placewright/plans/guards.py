"""Privacy, holds and withholding (inventory Q9-Q11, J10, J13, C2, C17)."""

import re

from pyspark.sql import functions as F

from .. import fixed, standin
from ..operators import boundary, holds
from ..operators.withhold import withhold
from ..session import read
from ..standin import cte
from .reads import bundle
from .registry import query
from .scalars import SQL_HOST, SQL_PATH, SQL_QUERY, SQL_TEXTS, texts

T = standin.table

# --- the scan, in the check dialect ------------------------------------------------------------

SQL_SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"


def quoted(text):
    return "'" + text.replace("'", "''") + "'"


def sql_scan(text):
    spaced = f"regexp_replace({text}, '{SQL_SPACE}', ' ', 'g')"
    return f"translate({spaced}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def sql_decode(text):
    for letter in PLAIN:
        text = f"replace({text}, '%{ord(letter):02x}', '{letter}')"
    return text


SQL_KEYS = "(?:^|[^a-z0-9_])(?:" + "|".join(fixed.CREDENTIAL_KEYS) + ") *="


def sql_credential(text):
    def found(view):
        scan = sql_scan(sql_decode(sql_scan(view)))
        return f"regexp_matches({scan}, {quoted(fixed.USERINFO_URL)}) or regexp_matches({scan}, {quoted(SQL_KEYS)})"

    flat = f"regexp_replace({text}, '[\\t\\n\\r]', '', 'g')"
    return f"({found(text)} or {found(flat)})"


def ahead(pattern):
    """A trailing look-ahead matches the same texts as a plain group in a search."""
    return re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", pattern.replace("(?=", "(?:"))


def sql_private(text, operational):
    scan = f"regexp_replace({sql_scan(text)}, {quoted(fixed.HTTP_TOKEN)}, '\\1', 'g')"
    has = lambda pattern: f"regexp_matches({scan}, {quoted(ahead(pattern))})"
    if operational:
        rest = (
            f"{has(fixed.LOCAL_ROOT)} or ({has(fixed.POSIX_PATH)} and ({has(fixed.PRIVATE_COMPONENT)} or {has(fixed.PRIVATE_DECLARATION)}))"
        )
    else:
        rest = has(fixed.POSIX_PATH)
    return f"({sql_credential(text)} or {has(fixed.EXPLICIT_PATH)} or {rest})"


@query(
    "q10_credential_syntax",
    f"select origin, id, turn, {sql_credential('text')} as flagged from {SQL_TEXTS}",
)
def q10(spark, sf):
    return texts(spark, sf).select("origin", "id", "turn", boundary.credential_syntax(F.col("text")).alias("flagged"))


@query(
    "q11_private_path",
    f"select origin, id, turn, {sql_private('text', False)} as strict, {sql_private('text', True)} as lenient from {SQL_TEXTS}",
)
def q11(spark, sf):
    return texts(spark, sf).select(
        "origin",
        "id",
        "turn",
        boundary.private_path(F.col("text"), F.lit(False)).alias("strict"),
        boundary.private_path(F.col("text"), F.lit(True)).alias("lenient"),
    )


Q9_PATHS = {
    ".courses#.name": ("name", True),
    ".courses#.optional.price_observation#.conditions": ("conditions", True),
    ".courses#.optional.price_observation#.note": ("note", False),
    ".courses#.components#.name": ("part", True),
}


@query(
    "q09_public_boundary",
    "with d as (select doc_id, text as name, 'see /tmp/' || doc_id as conditions, text as note, text as part, doc_id%5 as m from documents)\n"
    + " union all ".join(
        [f"select doc_id as id, '{path}' as path, 'private text' as rule from d where {sql_private(column, lenient)}" for path, (column, lenient) in Q9_PATHS.items()]
        + [
            "select doc_id, '.courses#.extra.' || case m when 0 then 'Token' when 1 then 'payload' else 'plain' end, 'private key' from d where m<2",
            "select doc_id, '.courses#.extra.a/b /c', 'private text in key' from d where m=3",
            f"select doc_id, '.courses#.deep' || repeat('#.in', 20), 'private text' from d where {sql_private('note', False)}",
        ]
    ),
)
def q09(spark, sf):
    docs = read(spark, sf, "documents").withColumn("m", F.col("doc_id") % 5)
    price = F.struct(
        F.concat(F.lit("see /tmp/"), F.col("doc_id").cast("string")).alias("conditions"), F.col("text").alias("note")
    )
    key = F.expr("case m when 0 then 'Token' when 1 then 'payload' when 3 then 'a/b /c' else 'plain' end")
    record = F.struct(
        F.col("text").alias("name"),
        F.struct(F.array(price).alias("price_observation")).alias("optional"),
        F.array(F.struct(F.col("text").alias("name"))).alias("components"),
        F.create_map(key, F.lit(1)).alias("extra"),
    )
    deep = F.concat(F.lit('{"deep":' + '[{"in":' * 20), F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2), F.lit("}]" * 20 + "}"))
    nested = docs.select("doc_id", F.parse_json(deep).alias("value"))
    records = docs.select("doc_id", F.parse_json(F.to_json(record)).alias("value")).unionByName(nested)
    return boundary.violations(records, "doc_id", "value", ".courses#")


@query(
    "q09_license_and_note_shape",
    cte("src")
    + """select k as id, '.source_licenses#.private_note' as path from src where k%7=0
 union all select k, '.source_licenses#.changes' from src where k%6=0 union all select k, '.provenance.notes#' from src where k%4=0
 union all select k, '.provenance.notes#.body' from src where k%3=0""",
)
def q09_shape(spark, sf):
    rows = T(spark, sf, "src")
    found = []
    for root, text in {
        ".source_licenses#": """'{"license":' || coalesce('"' || license || '"', 'null') || ',"changes":' || (case when k%6=0 then '1' else '"none"' end)
 || (case when k%7=0 then ',"private_note":"x"' else '' end) || '}'""",
        ".provenance.notes#": """'{' || (case when k%4=0 then '"id":""' else '"id":"n' || k || '"' end) || (case when k%3=0 then ',"body":"text"' else '' end) || '}'""",
    }.items():
        records = rows.select("k", F.parse_json(F.expr(text)).alias("value"))
        found.append(boundary.violations(records, "k", "value", root).where("rule = 'license or note shape'").select("id", "path"))
    return standin.union_all(found)


# --- holds -------------------------------------------------------------------------------------

HOLDS = """select case k%3 when 0 then 'publisher' when 1 then 'host' else 'resource' end as kind, case k%3 when 0 then regexp_replace({host}, '^[a-z]+\\.([a-z]+\\.example\\.)', '\\1')
 when 1 then regexp_replace({host}, '^www\\.', '') else {identity} end as scope_key from src where k%10=3 or k%10=5 or k%10=7"""
SQL_IDENTITY = f"""'[null,"' || regexp_replace(lower({SQL_HOST}), '^www\\.', '') || '",null,"' || coalesce(nullif({SQL_PATH},''),'/') || '","' || {SQL_QUERY} || '"]'"""


def hold_list(spark, sf):
    """Every source row decides one hold; those of the named endings are in force."""
    rows = T(spark, sf, "src").withColumn("host", holds.canon.url_part(F.col("url"), "host"))
    in_force = rows.where((F.col("k") % 10).isin(3, 5, 7))
    return in_force.select(
        F.expr("case k%3 when 0 then 'publisher' when 1 then 'host' else 'resource' end").alias("kind"),
        F.when(F.col("k") % 3 == 0, F.regexp_replace("host", r"^[a-z]+\.([a-z]+\.example\.)", "$1"))
        .when(F.col("k") % 3 == 1, F.regexp_replace("host", r"^www\.", ""))
        .otherwise(holds.canon.resource_identity(F.col("url"), hold=True))
        .alias("scope_key"),
    )


SQL_HELD_SRC = f"select source_id, regexp_replace(lower({SQL_HOST}), '^www\\.', '') as host, {SQL_IDENTITY} as resource from src"
SQL_HOLDS = HOLDS.format(host=SQL_HOST, identity=SQL_IDENTITY)


@query(
    "j10_hold_matching",
    cte("src", extra={"h": SQL_HOLDS, "s": SQL_HELD_SRC})
    + """select distinct source_id, kind as hold_kind from s join h on (kind='resource' and resource=scope_key) or (kind='host' and host=scope_key)
 or (kind='publisher' and (host=scope_key or ends_with(host, '.' || scope_key)))""",
)
def j10(spark, sf):
    return holds.matched_holds(T(spark, sf, "src"), hold_list(spark, sf)).distinct()


@query(
    "c02_register_sources",
    cte("src", extra={
        "h": SQL_HOLDS, "s": SQL_HELD_SRC,
        "heldids": """select distinct source_id from s join h on (kind='resource' and resource=scope_key) or (kind='host' and host=scope_key)
 or (kind='publisher' and (host=scope_key or ends_with(host, '.' || scope_key)))""",
    })
    + """select src.source_id, case when k%11=0 then 'invalid source link' when src.source_id in (select source_id from heldids) then 'source is held'
 when controls_reference is null then 'controls reference required' when k%2=0 then 'already registered' end as rule from src""",
)
def c02(spark, sf):
    rows = T(spark, sf, "src")
    existing = rows.where(F.col("k") % 2 == 0).select("source_id", "url")
    declared = rows.select(
        F.col("k").alias("ordinal"),
        "source_id",
        F.when(F.col("k") % 11 == 0, F.concat(F.lit("mail"), "url")).otherwise(F.col("url")).alias("url"),
        "controls_reference",
    )
    return holds.register_sources(declared, existing, hold_list(spark, sf)).select("source_id", "rule")


CONTROL = """'{"groups":[{"kind":"' || (case when k%4=0 then 'profile_specific_stop' else 'publisher_stop' end) || '","url":"' || url || '","domains":["d' || k || '.example.com and x.' || k%7 || 'a.net"],'
 || '"scope":"' || (case when k%5=0 then 'No statewide rule, see https://s.example.org/a/b.' else 'seen at h' || k || '.example.net' end) || '"}],'
 || '"host":"www.q' || k || '.example.com","path":"/x' || (k%3) || '/","important_inherited_stop_groups":["first' || k || '.example.org; other.example.org"],'
 || '"recent_exact_stops":{"r' || k || '.example.com":"asked to stop"},"z' || k || '.example.com":{"reason":"root record"},"note":"n' || k || '.example.com is free",'
 || '"deep":' || repeat('{"in":[', 20) || '{"domains":["deep' || k || '.example.com"]}' || repeat(']}', 20) || '}'"""


@query(
    "c17_hold_scopes",
    cte("src", extra={"s": f"select k, url, {SQL_IDENTITY} as resource, regexp_replace(lower({SQL_HOST}), '^www\\.', '') as host, {SQL_HOST} as raw_host, {SQL_PATH} as path from src"})
    + """select k as control_id, 'publisher' as kind, 'd' || k || '.example.com' as scope_key, '/groups/0/domains/0' as control_path, 'd' || k || '.example.com' as original_scope from s
 union all select k, 'publisher', 'x.' || (k%7) || 'a.net', '/groups/0/domains/0', 'x.' || (k%7) || 'a.net' from s
 union all select k, case when k%4=0 then 'resource' when k%5=0 then 'host' else 'publisher' end, case when k%4=0 then resource else host end, '/groups/0/url', case when k%4=0 then url else raw_host end from s
 union all select k, 'resource', '[null,"s.example.org",null,"/a/b",""]', '/groups/0/scope', 'https://s.example.org/a/b' from s where k%5=0
 union all select k, 'host', 'h' || k || '.example.net', '/groups/0/scope', 'h' || k || '.example.net' from s where k%5<>0
 union all select k, 'resource', '[null,"q' || k || '.example.com",null,"/x' || (k%3) || '/",""]', '/host', 'https://www.q' || k || '.example.com/x' || (k%3) || '/' from s
 union all select k, 'publisher', 'first' || k || '.example.org', '/important_inherited_stop_groups/0', 'first' || k || '.example.org' from s
 union all select k, 'publisher', 'r' || k || '.example.com', '/recent_exact_stops/r' || k || '.example.com', 'r' || k || '.example.com' from s
 union all select k, 'publisher', 'z' || k || '.example.com', '/z' || k || '.example.com', 'z' || k || '.example.com' from s
 union all select k, 'publisher', 'deep' || k || '.example.com', '/deep' || repeat('/in/0', 20) || '/domains/0', 'deep' || k || '.example.com' from s""",
)
def c17(spark, sf):
    controls = T(spark, sf, "src").select("k", F.parse_json(F.expr(CONTROL)).alias("control"))
    found = holds.hold_scopes(controls, "k", "control")
    return found.select("control_id", "kind", "scope_key", "control_path", "original_scope")


# --- withholding -------------------------------------------------------------------------------

SQL_REVIEWED = "select case when s_suppkey%3=0 then 'rel-' else 'f-' end || s_suppkey as id from supplier"
W = "(select id from w)"


@query(
    "j13_withhold_cascade",
    cte("f", "c", "p", "r", "m", "t", "al", extra={
        "fr": "select *, 'rel-' || k as released_id from f",
        "w0": f"select facility_id as id from fr where facility_id in ({SQL_REVIEWED}) or released_id in ({SQL_REVIEWED}) union {SQL_REVIEWED}",
        "w1": "select id from w0 union select course_id from c where facility_id in (select id from w0)",
        "w2": "select id from w1 union select component_id from p where course_id in (select id from w1) union select round_id from r where facility_id in (select id from w1) or course_id in (select id from w1)",
        "w": """select id from w2 union select member_id from m where round_id in (select id from w2) or component_id in (select id from w2) or course_id in (select id from w2)
 union select tee_id from t where course_id in (select id from w2) or round_id in (select id from w2) union select alias_id from al where facility_id in (select id from w2) or course_id in (select id from w2)""",
    })
    + f"""select 'facility' as entity, facility_id as id from fr where facility_id not in {W} union all select 'course', course_id from c where facility_id is null or facility_id not in (select id from w0)
 union all select 'component', component_id from p where component_id not in {W} union all select 'round_option', round_id from r where round_id not in {W}
 union all select 'round_component', member_id from m where member_id not in {W} union all select 'tee_set', tee_id from t where tee_id not in {W} union all select 'alias', alias_id from al where alias_id not in {W}""",
)
def j13(spark, sf):
    b = bundle(spark, sf)
    b["facility"] = b["facility"].withColumn("released_id", F.expr("'rel-' || k"))
    reviewed = read(spark, sf, "supplier").selectExpr("case when s_suppkey%3=0 then 'rel-' else 'f-' end || s_suppkey as id")
    kept = withhold(b, reviewed)
    names = {"facility": "facility_id", "course": "course_id", "component": "component_id", "round_option": "round_id", "round_component": "member_id", "tee_set": "tee_id", "alias": "alias_id"}
    return standin.union_all([kept[t].select(F.lit(t).alias("entity"), F.col(key).alias("id")) for t, key in names.items()])



