"""Published projections: GeoJSON, compact map index, display details, attribution, transport."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.geo import point
from ..operators import cards


def geojson_features(rows: DataFrame, key: str) -> DataFrame:
    """One feature text per row; a record without a location has a null geometry."""
    geometry = F.when(
        F.col("latitude").isNotNull(),
        F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")),
    )
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.col(key).alias("id"),
        geometry.alias("geometry"),
        F.struct(*rows.columns).alias("properties"),
    )
    return rows.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def write_geojson(rows: DataFrame, key: str, path: str) -> None:
    """Line-delimited features, in id order within each file."""
    geojson_features(rows.sortWithinPartitions(key), key).write.text(path)


def map_index(facilities: DataFrame, courses: DataFrame) -> DataFrame:
    """Fixed 8-field tuples for the map: facilities, and courses without a facility."""

    def entry(rows, kind, identity, count):
        at = point(F.col("latitude"), F.col("longitude"), F.col("location_kind"))
        return rows.select(
            F.lit(kind).alias("kind"),
            F.struct(
                F.col(identity).alias("_1"),
                F.col("name").alias("_2"),
                F.col("state").alias("_3"),
                F.col("address_city").alias("_4"),
                at.alias("_5"),
                F.col("physical_holes").alias("_6"),
                count.cast("long").alias("_7"),
                F.col("access").alias("_8"),
            ).alias("entry"),
        )

    counted = courses.where(F.col("facility_id").isNotNull()).groupBy("facility_id").agg(F.count("*").alias("n"))
    own = facilities.join(counted, "facility_id", "left")
    orphans = courses.where(F.col("facility_id").isNull()).select(
        "course_id",
        "name",
        F.lit(None).cast("string").alias("state"),
        F.when(F.col("address_mode") == "override", F.col("address_city")).alias("address_city"),
        *[F.lit(None).cast(t).alias(n) for n, t in (("latitude", "double"), ("longitude", "double"), ("location_kind", "string"))],
        "physical_holes",
        "access",
    )
    return entry(own, "facility", "facility_id", F.coalesce("n", F.lit(0))).unionByName(
        entry(orphans, "course", "course_id", F.lit(1))
    )


def decode_index(index: DataFrame) -> DataFrame:
    """Tuples back to records; a course entry has no facility."""
    e = F.col("entry")
    return index.select(
        F.when(F.col("kind") == "facility", e["_1"]).alias("facility_id"),
        F.when(F.col("kind") == "course", e["_1"]).alias("course_id"),
        e["_2"].alias("name"),
        e["_3"].alias("state"),
        e["_4"].alias("city"),
        e["_5"].alias("map_location"),
        e["_6"].alias("physical_holes"),
        e["_7"].alias("course_count"),
        e["_8"].alias("access"),
    )


# Fields of the display projection (fixed values).
_DISPLAY = [
    "name", "state", "physical_holes", "access", "address", "map_location", "website", "booking_url", "facility_id",
    "course_id", "facility_name", "facility_website", "style", "game_kind", "identity_status", "nonmember_bookable",
    "booking_conditions", "plan_eligible", "planning_basis", "destination_id", "arrival",
]
# What public details leave out.
_HIDDEN = ["id", "observation_id", "facility_id", "course_id", "component_id", "round_id", "source_id", "source_url", "source_license", "source_attribution", "collected_on", "status"]


def _pick(value: Column, names) -> Column:
    return F.when(value.isNotNull(), F.struct(*[value[n].alias(n) for n in names]))


def display_details(course_cards: DataFrame) -> DataFrame:
    """Course cards reduced to what a reader sees: whitelisted fields, NULLs left out."""
    shown = course_cards.withColumns(
        {
            "address": _pick(F.col("address"), [n for n in cards.ADDRESS_FIELDS if n != "purpose"]),
            "map_location": _pick(F.col("map_location"), ["latitude", "longitude", "kind"]),
            "arrival": _pick(F.col("arrival"), ["kind"]),
            "components": F.transform("components", lambda c: F.struct(c["name"].alias("name"), c["physical_holes"].alias("physical_holes"))),
            "tee_sets": F.transform(
                "tee_sets", lambda t: F.struct(*[t[n].alias(n) for n in ("name", "yardage", "yardage_unit", "par", "slope")])
            ),
            "round_options": F.transform(
                "round_options", lambda r: F.struct(*[r[n].alias(n) for n in ("round_id", "name", "round_holes", "description")])
            ),
        }
    )
    fields = [n for n in _DISPLAY if n in shown.columns] + ["components", "tee_sets", "round_options"]
    return shown.select("course_id", "part", F.to_json(F.struct(*fields)).alias("details"))


def display_facts(facts: DataFrame) -> DataFrame:
    """Observed facts without their envelope's ids and source, NULLs left out."""
    names = [n for n in facts.columns if n not in _HIDDEN and not n.endswith("_id")]
    return facts.select(*[n for n in facts.columns if n.endswith("_id")], F.to_json(F.struct(*names)).alias("fact"))


def credits(licenses: DataFrame) -> DataFrame:
    """Attribution rows (source_id, field, value, link); a known license links to its text."""

    def link(name):
        if name == "license":
            known = F.create_map(*[F.lit(x) for pair in fixed.LICENSE_URLS.items() for x in pair])
            own = F.col("license_url") if "license_url" in licenses.columns else F.lit(None).cast("string")
            target = F.coalesce(own, F.try_element_at(known, F.col(name)))
        elif name.endswith("_url"):
            target = F.col(name)
        else:
            return F.lit(None).cast("string")
        return F.when(target.rlike(r"\Ahttps?://\S+\z"), target)

    present = [n for n in fixed.CREDIT_FIELDS if n in licenses.columns]
    entries = F.array(
        *[F.struct(F.lit(n).alias("field"), F.col(n).alias("value"), link(n).alias("link")) for n in present]
    )
    flat = licenses.select("source_id", F.inline(F.filter(entries, lambda e: e["value"].isNotNull())))
    return flat


def transport(bundle: dict, heavy=("fact_sources", "osm", "wikidata", "feature_tags")) -> dict:
    """The public tables of a catalog: cards, destinations, relations, and provenance by id only."""
    listed = cards.course_listing(bundle["course"], bundle["facility"], "left")
    places, conflicting = cards.destinations(listed)
    tables = {
        "facilities": cards.facility_cards(bundle),
        "courses": cards.course_cards(bundle).drop("destination"),
        "destinations": places,
        "destination_conflicts": conflicting,
        **{t: bundle[t] for t in ("component", "round_option", "round_component", "tee_set", "alias")},
        "sources": bundle["source"].select("source_id", "url", "license", "attribution"),
    }
    if "note" in bundle:
        tables["notes"] = bundle["note"].select("note_id")
    if "intake_evidence" in bundle:
        tables["intake"] = bundle["intake_evidence"].drop("payload")
    return {name: frame.drop(*heavy) for name, frame in tables.items()}
