"""Sources and sinks (inventory S)."""

from pyspark.sql import functions as F

from .. import standin
from ..operators import cards, facts
from ..session import new_folder, read, settle
from ..sources import csvfiles, jsonfiles, projections, releases
from ..standin import cte
from .reads import SQL_BELONGS, bundle, lined_bundle
from .registry import query
from .scalars import SQL_JSON, FACT_COLUMNS

T = standin.table

TEXT_CASE = "case when doc_id%10=0 then null when doc_id%11=0 then '' when doc_id%13=0 then '  \"q\", \\b ' || text || chr(13) || chr(10) || ' ' else text end"


@query(
    "s01_typed_csv_round_trip",
    f"select doc_id, md5({TEXT_CASE}) as text_md5, lang, doc_id%7 as nested_a, case when doc_id%3=0 then null else lang end as nested_b from documents",
)
def s01(spark, sf):
    rows = read(spark, sf, "documents").select(
        "doc_id",
        F.expr(TEXT_CASE.replace("\\b", "\\\\b")).alias("text"),
        "lang",
        F.struct((F.col("doc_id") % 7).alias("a"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("b")).alias("nested"),
    )
    path = new_folder(spark, "csv")
    kinds = csvfiles.write_rows(rows, path)
    back = csvfiles.read_rows(spark, path, kinds, {"doc_id": "bigint", "nested": "struct<a:bigint,b:string>"})
    return back.select(
        "doc_id", F.md5("text").alias("text_md5"), "lang", F.col("nested.a").alias("nested_a"), F.col("nested.b").alias("nested_b")
    )


@query(
    "s02_csv_column_kinds",
    "select 'conversations' as table_name, (select count(*) from conversations) as row_count, 'conv_id=json,turn=json,role=text,text=text' as kinds",
)
def s02(spark, sf):
    rows = read(spark, sf, "conversations")
    path = new_folder(spark, "csv")
    kinds = csvfiles.write_rows(rows, path)
    back = csvfiles.read_rows(spark, path, kinds, {"conv_id": "bigint", "turn": "bigint"})
    same = rows.join(back, ["conv_id", "turn", "role", "text"], "left_semi")
    return same.agg(
        F.lit("conversations").alias("table_name"),
        F.count("*").alias("row_count"),
        F.lit(",".join(f"{k}={v}" for k, v in kinds.items())).alias("kinds"),
    )


@query(
    "s03_bundle_round_trip",
    cte("f", "c")
    + "select 'facilities' as table_name, facility_id as id, physical_holes, inventory_complete as flag, '7' as revision from f union all select 'courses', course_id, physical_holes, nonmember_bookable, '7' from c",
)
def s03(spark, sf):
    path = new_folder(spark, "bundle")
    releases.write_bundle_csv(spark, {"facilities": T(spark, sf, "f"), "courses": T(spark, sf, "c")}, {"revision": 7}, path)
    typed = {"facilities": {"physical_holes": "int", "inventory_complete": "boolean"}, "courses": {"physical_holes": "int", "nonmember_bookable": "boolean"}}
    metadata, tables = releases.load_bundle_csv(spark, path, typed)
    revision = F.lit(metadata["revision"]).alias("revision")
    return tables["facilities"].select(
        F.lit("facilities").alias("table_name"), F.col("facility_id").alias("id"), "physical_holes", F.col("inventory_complete").alias("flag"), revision
    ).unionByName(
        tables["courses"].select(
            F.lit("courses").alias("table_name"), F.col("course_id").alias("id"), "physical_holes", F.col("nonmember_bookable").alias("flag"), revision
        )
    )


@query(
    "s04_json_record_arrays",
    "select event_id, event_type, cast(props->>'k' as bigint) as k from events",
)
def s04(spark, sf):
    events = read(spark, sf, "events").select("event_id", "event_type", F.from_json("props", "k bigint").alias("props"))
    # Files of one array each, cut by id so that no array grows with the table.
    blocks = events.groupBy(F.floor(F.col("event_id") / 2500).alias("block")).agg(
        F.to_json(F.collect_list(F.struct("event_id", "event_type", "props"))).alias("value")
    )
    path = new_folder(spark, "records")
    blocks.write.partitionBy("block").option("compression", "gzip").text(path)
    back = jsonfiles.read_records(spark, path + "/*", "event_id bigint, event_type string, props struct<k:bigint>")
    return back.select("event_id", "event_type", F.col("props.k").alias("k"))


def written_layers(spark, sf):
    """Layer files of both shapes, written from the stand-in bindings, cut by key."""
    rows = T(spark, sf, "bind").withColumn("k", F.expr("cast(substring(facility_id, 3) as bigint)"))

    def feature(column):
        parts = F.split(column, "/")
        return F.when(
            F.col(column).isNotNull(),
            F.struct(F.struct(parts[1].alias("type"), parts[2].cast("bigint").alias("id")).alias("osm")),
        )

    single = F.to_json(F.struct("facility_id", feature("layer_1").alias("selected_feature"))).alias("record")
    several = F.to_json(
        F.struct(
            F.struct(F.col("facility_id").alias("id")).alias("facility"),
            F.array_compact(F.array(feature("layer_1"), feature("layer_2"))).alias("matches"),
            F.lit("supported").alias("status"),
        )
    ).alias("record")
    block = F.floor(F.col("k") / 400).alias("block")
    path = new_folder(spark, "layers")
    for shape, record in (("records", single), ("results", several)):
        part = rows.where(F.col("k") % 2 == (0 if shape == "records" else 1)).select(block, record)
        files = part.groupBy("block").agg(
            F.concat(F.lit('{"' + shape + '":['), F.array_join(F.collect_list("record"), ","), F.lit("]}")).alias("value")
        )
        files.write.partitionBy("block").text(f"{path}/{shape}")
    return path


@query(
    "s05_layer_directory_scan",
    cte("bind", extra={"b": "select *, cast(substring(facility_id, 3) as bigint) as k from bind"})
    + "select facility_id, layer_1 as feature_id from b where layer_1 is not null union all select facility_id, layer_2 from b where k%2=1 and layer_2 is not null",
)
def s05(spark, sf):
    found = jsonfiles.layer_links(spark, written_layers(spark, sf) + "/*/*")
    return found.select("facility_id", "feature_id")


@query("s06_input_pins", "select 'orders.parquet' as name, 'sha256 differs' as rule union all select 'part.parquet', 'size differs' union all select 'labels.parquet', 'not pinned'")
def s06(spark, sf):
    actual = jsonfiles.file_pins(spark, sf.rstrip("/") + "/*.parquet")
    pinned = actual.where("name <> 'labels.parquet'").withColumns({
        "sha256": F.when(F.col("name") == "orders.parquet", F.lit("0")).otherwise(F.col("sha256")),
        "bytes": F.when(F.col("name") == "part.parquet", F.col("bytes") + 1).otherwise(F.col("bytes")),
    })
    return jsonfiles.pin_violations(actual, pinned)


@query(
    "s07_geojson_features",
    cte("f")
    + "select facility_id as id, 'Feature' as type, latitude is not null as has_geometry, longitude, latitude, name, county from f",
)
def s07(spark, sf):
    path = new_folder(spark, "geojson")
    rows = T(spark, sf, "f").select("facility_id", "name", "county", "latitude", "longitude")
    projections.write_geojson(rows, "facility_id", path)
    schema = "type string, id string, geometry struct<type:string,coordinates:array<double>>, properties struct<name:string,county:string>"
    back = spark.read.text(path).select(F.from_json("value", schema).alias("x")).select("x.*")
    return back.select(
        "id", "type", F.col("geometry").isNotNull().alias("has_geometry"), F.col("geometry.coordinates")[0].alias("longitude"),
        F.col("geometry.coordinates")[1].alias("latitude"), "properties.name", "properties.county",
    )


def sql_digest(rows, body):
    lanes = " || ".join(f"':' || sum(('0x' || substr(digest, {1 + 8 * k}, 8))::bigint)" for k in range(8))
    return f"""{rows}_d as (select sha256(cast({body} as varchar)) as digest from {rows}),
{rows}_t as (select sha256(count(*) || {lanes}) as sha256, count(*) as row_count from {rows}_d)"""


COURSE_COLUMNS = ["access", "course_id", "facility_id", "name", "physical_holes", "style"]
SQL_COURSE_JSON = "to_json({" + ", ".join(f"'{n}': {n}" for n in COURSE_COLUMNS) + "})"


def sql_release():
    head = cte("f", "c").rstrip("\n")
    return head + ",\n" + sql_digest("f", SQL_JSON) + ",\n" + sql_digest("c", SQL_COURSE_JSON) + "\n"


def release_tables(spark, sf):
    return {"facilities": T(spark, sf, "f").select(*FACT_COLUMNS), "courses": T(spark, sf, "c").select(*COURSE_COLUMNS)}


@query(
    "s08_release_manifest",
    sql_release()
    + "select 'facilities' as name, row_count, sha256 from f_t union all select 'courses', row_count, sha256 from c_t union all select 'release', (select cast(sum(row_count) as bigint) from (select row_count from f_t union all select row_count from c_t)), (select sha256('courses:' || c_t.sha256 || ',facilities:' || f_t.sha256) from c_t, f_t)",
)
def s08(spark, sf):
    manifest = releases.write_release(spark, release_tables(spark, sf), new_folder(spark, "release"))
    key = releases.release_key(manifest).select(F.lit("release").alias("name"), F.col("rows").alias("row_count"), F.col("release_key").alias("sha256"))
    return manifest.select("name", "row_count", "sha256").unionByName(key)


@query(
    "s09_transport_tables",
    cte("f", "c", "p", "r", "m", "t", "al", "src", "obs", extra={"d": """select distinct case when c.arrival_latitude is not null then c.course_id else f.facility_id end as id from c left join f on f.facility_id=c.facility_id where coalesce(c.arrival_latitude, f.latitude) is not null"""})
    + """select 'facilities' as table_name, count(*) as row_count from f union all select 'courses', count(*) from c union all select 'destinations', count(*) from d union all select 'destination_conflicts', 0
 union all select 'component', count(*) from p union all select 'round_option', count(*) from r union all select 'round_component', count(*) from m union all select 'tee_set', count(*) from t
 union all select 'alias', count(*) from al union all select 'sources', count(*) from src union all select 'notes', count(*) from documents union all select 'intake', count(*) from obs""",
)
def s09(spark, sf):
    b = bundle(spark, sf)
    b["note"] = read(spark, sf, "documents").selectExpr("'n-' || doc_id as note_id", "text")
    b["intake_evidence"] = b["source_observation"].selectExpr(
        "'b-1' as batch_id", "'facility' as entity_type", "facility_id as entity_id", "source_id", "collected_on", "origin", "status", "props as payload"
    )
    tables = projections.transport(b)
    return standin.union_all([t.agg(F.lit(n).alias("table_name"), F.count("*").alias("row_count")) for n, t in tables.items()])


def public_tables(spark, sf, alias_name):
    """Facility and course cards, with this name for every alias."""
    b = bundle(spark, sf)
    b["alias"] = b["alias"].withColumn("name", F.expr(alias_name))
    facility = cards.facility_cards(b).select("facility_id", "part", "name", "website", "address", "aliases", "course_inventory")
    course = cards.course_cards(b, lists=["aliases", "components"]).select("course_id", "part", "name", "facility_name", "arrival", "aliases", "components")
    return {"facilities": (facility, "facility_id"), "courses": (course, "course_id")}


@query(
    "s09_publication_gate",
    cte("f", "c", "al", "src", extra={"bad": "select * from al where cast(substr(alias_id, 3) as bigint)%7=0"})
    + """select 'facilities' as table_name, facility_id as id, '.facilities#.aliases#.name' as path, 'private text' as rule from bad where facility_id in (select facility_id from f)
 union all select 'courses', course_id, '.courses#.aliases#.name', 'private text' from bad where course_id in (select course_id from c)
 union all select 'source_licenses', source_id, 'capture_notes', 'unknown license field' from src where k%50=3""",
)
def s09_gate(spark, sf):
    odd = F.map_from_arrays(F.array(F.lit("license"), F.lit("controls_reference"), F.lit("capture_notes")), F.array(F.lit("CC0"), F.lit("kept/1"), F.lit("x")))
    plain = F.map_from_arrays(F.array(F.lit("license"), F.lit("controls_reference")), F.array(F.lit("CC0"), F.lit("kept/1")))
    licenses = T(spark, sf, "src").select("source_id", F.when(F.col("k") % 50 == 3, odd).otherwise(plain).alias("license"))
    tables = public_tables(spark, sf, "case when cast(substr(alias_id, 3) as bigint)%7=0 then 'see /home/op/' || alias_id else name end")
    found, manifest = releases.publish(spark, tables, licenses, new_folder(spark, "gated"))
    if manifest is not None:
        raise ValueError("a release with private text was published")
    return found.withColumnRenamed("table", "table_name")


@query(
    "s08_file_manifest",
    cte("f", "c", "al", "src")
    + """select 'facilities' as item, (select count(*) from f) as row_count, (select count(*) from al where facility_id in (select facility_id from f)) as aliases, cast(null as varchar) as rule
 union all select 'courses', (select count(*) from c), (select count(*) from al where course_id in (select course_id from c)), null
 union all select 'source_licenses', (select count(*) from src), null, null union all select 'courses', null, null, 'not pinned'""",
)
def s08_files(spark, sf):
    path = new_folder(spark, "public")
    licenses = T(spark, sf, "src").select("source_id", F.create_map(F.lit("license"), F.lit("CC0"), F.lit("controls_reference"), F.lit("kept/1")).alias("license"))
    _, manifest = releases.publish(spark, public_tables(spark, sf, "name"), licenses, path)
    if releases.file_violations(spark, path).limit(1).count():
        raise ValueError("the files differ from their manifest")
    counted = standin.union_all([
        spark.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("item"), F.coalesce(F.sum(F.size("aliases")), F.lit(0)).alias("aliases")) for name in ("facilities", "courses")
    ])
    rows = settle(manifest.select(F.col("name").alias("item"), "row_count").join(counted, "item", "left").withColumn("rule", F.lit(None).cast("string")), "counted")
    # One more file among the course cards.
    spark.read.parquet(f"{path}/courses").limit(1).write.mode("append").parquet(f"{path}/courses")
    wrong = releases.file_violations(spark, path).select(F.split("name", "/")[0].alias("item"), "rule")
    return rows.unionByName(wrong, allowMissingColumns=True)


@query(
    "s10_published_differences",
    cte("f")
    + "select 'published' as side, facility_id, name from f where k%50=0 union all select 'regenerated', facility_id, case when k%100=0 then name || ' (edited)' end from f where k%50=0",
)
def s10(spark, sf):
    rows = T(spark, sf, "f").select("k", "facility_id", "name", "state")
    path = new_folder(spark, "published")
    rows.drop("k").write.parquet(path)
    edited = F.expr("case when k%100=0 then name || ' (edited)' when k%50=0 then null else name end")
    again = rows.withColumn("name", edited).drop("k")
    return releases.differences(spark.read.parquet(path), again).select("side", "facility_id", "name")


@query(
    "s11_snapshot_and_restore",
    sql_release()
    + "select 'facilities' as name, row_count, sha256, cast(0 as bigint) as violations from f_t union all select 'courses', row_count, sha256, 0 from c_t",
)
def s11(spark, sf):
    path = new_folder(spark, "snapshot")
    manifest = releases.write_release(spark, release_tables(spark, sf), path)
    tables, wrong = releases.restore(spark, path)
    bad = wrong.groupBy("name").agg(F.count("*").alias("violations"))
    counted = standin.union_all([t.agg(F.lit(n).alias("name"), F.count("*").alias("row_count")) for n, t in tables.items()])
    return counted.join(manifest.select("name", "sha256"), "name").join(bad, "name", "left").select(
        "name", "row_count", "sha256", F.coalesce("violations", F.lit(0)).alias("violations")
    )


SQL_INDEX = """select 'facility' as kind, f.facility_id as id, f.name, f.state, f.address_city as city, f.latitude, f.longitude, case when f.latitude is not null then f.location_kind end as location_kind, f.physical_holes, coalesce(n,0) as course_count, f.access
 from f left join (select facility_id, count(*) as n from c where facility_id is not null group by 1) x on x.facility_id=f.facility_id
 union all select 'course', course_id, name, null, case when address_mode='override' then address_city end, null, null, null, physical_holes, 1, access from c where facility_id is null"""


@query("s12_compact_map_index", cte("f", "c") + SQL_INDEX)
def s12(spark, sf):
    e = projections.map_index(T(spark, sf, "f"), T(spark, sf, "c"))
    return e.select(
        "kind", F.col("entry._1").alias("id"), F.col("entry._2").alias("name"), F.col("entry._3").alias("state"), F.col("entry._4").alias("city"),
        F.col("entry._5.latitude").alias("latitude"), F.col("entry._5.longitude").alias("longitude"), F.col("entry._5.kind").alias("location_kind"),
        F.col("entry._6").alias("physical_holes"), F.col("entry._7").alias("course_count"), F.col("entry._8").alias("access"),
    )


@query("s14_decode_map_index", cte("f", "c", extra={"i": SQL_INDEX}) + "select case when kind='facility' then id end as facility_id, case when kind='course' then id end as course_id, name, city, latitude, course_count from i")
def s14(spark, sf):
    path = new_folder(spark, "index")
    index = projections.map_index(T(spark, sf, "f"), T(spark, sf, "c"))
    index.write.parquet(path)
    back = projections.decode_index(spark.read.parquet(path))
    return back.select("facility_id", "course_id", "name", "city", F.col("map_location.latitude").alias("latitude"), "course_count")


@query(
    "s13_display_details",
    cte("f", "c", "r", "m", "p", "t", extra={
        "own": SQL_BELONGS,
        "ps": "select course_id, count(*) as n from p group by 1",
        "rs": "select course_id, count(*) as n from own group by 1",
        "ts": "select course_id, count(*) as n from t where course_id is not null group by 1",
    })
    + """select c.course_id, c.name, f.name as facility_name, c.access, case c.address_mode when 'inherit' then f.address_city when 'override' then c.address_city end as city,
 c.arrival_kind, coalesce(ps.n,0) as components, coalesce(rs.n,0) as rounds, coalesce(ts.n,0) as tees, false as leaks from c left join f on f.facility_id=c.facility_id
 left join ps on ps.course_id=c.course_id left join rs on rs.course_id=c.course_id left join ts on ts.course_id=c.course_id""",
)
def s13(spark, sf):
    made = projections.display_details(cards.course_cards(lined_bundle(spark, sf), lists=["components", "tee_sets", "round_options"]))
    schema = "name string, facility_name string, access string, address struct<city:string>, arrival struct<kind:string>, components array<struct<name:string>>, round_options array<struct<name:string>>, tee_sets array<struct<name:string>>"
    x = made.select("course_id", "details", F.from_json("details", schema).alias("x"))
    leaks = F.col("details").rlike('"(tee_id|component_id|county|purpose)"|:null')
    return x.select(
        "course_id", "x.name", "x.facility_name", "x.access", F.col("x.address.city").alias("city"), F.col("x.arrival.kind").alias("arrival_kind"),
        F.size("x.components").cast("long").alias("components"), F.size("x.round_options").cast("long").alias("rounds"),
        F.size("x.tee_sets").cast("long").alias("tees"), leaks.alias("leaks"),
    )


@query(
    "s13_display_facts",
    cte("price", "obs", "src")
    + """select price_id, fee_kind, currency, o.conflict, false as leaks from price x join obs o on o.observation_id=x.observation_id""",
)
def s13_facts(spark, sf):
    b = bundle(spark, sf)
    view = facts.fact_view(b["price_observation"], b["source_observation"], b["source"])
    shown = projections.display_facts(view)
    x = shown.select("price_id", "fact", F.from_json("fact", "fee_kind string, currency string, conflict boolean").alias("x"))
    leaks = F.col("fact").rlike('"(source_url|source_license|collected_on|status)"|:null')
    return x.select("price_id", "x.fee_kind", "x.currency", "x.conflict", leaks.alias("leaks"))


@query(
    "s15_attribution",
    cte("src")
    + """select source_id, 'attribution' as field, attribution as value, null as link from src where attribution is not null
 union all select source_id, 'license', license, case license when 'CC-BY-4.0' then 'https://creativecommons.org/licenses/by/4.0/' when 'ODbL-1.0' then 'https://opendatacommons.org/licenses/odbl/1-0/' end from src where license is not null
 union all select source_id, 'source_url', url, url from src""",
)
def s15(spark, sf):
    return projections.credits(T(spark, sf, "src").withColumn("source_url", F.col("url")))
