"""Tagged source features: selection, whitelists, records, derived values, tag refresh."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import clean_text, entity_ids, filled, lookup


def tag(name: str) -> Column:
    return F.col("tags")[name]


def is_catalog_feature() -> Column:
    return F.coalesce(
        (tag("leisure") == "golf_course") | (tag("golf") == "course"), F.lit(False)
    )


def source_tags(tags: Column) -> Column:
    """Whitelisted tags, scrubbed; a tag that was only a contact disappears."""
    kept = F.map_filter(tags, lambda key, _: key.isin(fixed.TAG_NAMES))
    scrubbed = F.transform_values(kept, lambda _, value: clean_text(value))
    return F.map_filter(scrubbed, lambda _, value: value.isNotNull())


def identity(kind: Column, number: Column) -> Column:
    known = kind.isin("node", "way", "relation") & number.isNotNull()
    return F.when(known, F.concat_ws("/", F.lit("osm"), kind, number.cast("string")))


def access_code(value: Column) -> Column:
    """Mapped access; a fee or an unknown code says nothing."""
    return lookup(value, fixed.ACCESS_CODES)


def agreed_holes(tags: Column) -> Column:
    """A hole count only where every given tag is the same positive whole number."""
    given = F.filter(F.array(tags["holes"], tags["golf:holes"]), lambda v: v.isNotNull() & (v != ""))
    whole = F.forall(given, lambda v: v.rlike(r"\A[0-9]+\z"))
    numbers = F.array_distinct(F.transform(given, lambda v: v.try_cast("decimal(38,0)")))
    first = F.try_element_at(numbers, F.lit(1))
    return F.when((F.size(given) > 0) & whole & (F.size(numbers) == 1) & (first > 0), first.try_cast("int"))


def web_link(value: Column) -> Column:
    return F.when(value.rlike(r"(?U)\Ahttps?://\S+\z"), value)


def street_line(number: Column, street: Column) -> Column:
    return filled(F.concat_ws(" ", filled(number), filled(street)))


def records(features: DataFrame) -> DataFrame:
    """Feature records: scrubbed tags, name with its English fallback, links, and known members."""
    selected = features.where(is_catalog_feature()).withColumn("tags", source_tags(F.col("tags")))
    return selected.select(
        "feature_id",
        "osm_type",
        "osm_id",
        "osm_version",
        "source_url",
        "checked_on",
        "credit",
        F.coalesce(filled(tag("name")), filled(tag("name:en"))).alias("name"),
        "tags",
        entity_ids(tag("wikidata")).alias("wikidata_ids"),
        F.when(F.col("osm_type") == "relation", F.col("member_feature_ids"))
        .otherwise(F.expr("cast(array() as array<string>)"))
        .alias("member_feature_ids"),
        "position",
        F.when(F.col("position").isNull(), "unknown")
        .when(F.col("osm_type") == "node", "source_node")
        .otherwise("derived_inside_source_polygon")
        .alias("position_kind"),
        "geometry_status",
    )


def known_members(features: DataFrame) -> DataFrame:
    """Membership kept only where the member is itself a feature; order kept."""
    members = features.select("feature_id", F.posexplode("member_feature_ids").alias("at", "member_id"))
    known = features.select(F.col("feature_id").alias("member_id"))
    return members.join(known, "member_id", "left_semi").select("feature_id", "at", "member_id")


def with_known_members(features: DataFrame) -> DataFrame:
    # One feature's members were one array to begin with, so regrouping them is bounded.
    kept = known_members(features).groupBy("feature_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "member_id"))), lambda m: m["member_id"]).alias("kept")
    )
    empty = F.expr("cast(array() as array<string>)")
    return (
        features.join(kept, "feature_id", "left")
        .withColumn("member_feature_ids", F.coalesce("kept", empty))
        .drop("kept")
    )


def geometry_histogram(features: DataFrame) -> DataFrame:
    failed = F.col("geometry_status").isin("invalid_source_polygon", "assembly_failed")
    return features.groupBy("geometry_status").agg(
        F.count("*").alias("features"), F.count_if(failed).alias("failures")
    )


def new_records(features: DataFrame, kind: str) -> DataFrame:
    """Rows for features without a released record; what the tags do not say stays NULL."""
    facility = kind == "facilities"
    address_fields = {
        "city": tag("addr:city"),
        "country": tag("addr:country"),
        "postal_code": tag("addr:postcode"),
        "region": tag("addr:state"),
        "street_line1": street_line(tag("addr:housenumber"), tag("addr:street")),
    }
    known = [F.coalesce(value, F.lit("")) != "" for value in address_fields.values()]
    has_address = known[0] | known[1] | known[2] | known[3] | known[4]
    columns = {
        ("facility_id" if facility else "course_id"): F.col("feature_id"),
        "name": F.col("name"),
        "state": tag("addr:state"),
        "country": tag("addr:country"),
        "website": web_link(tag("website")),
        "latitude": F.when(F.col("position").isNotNull(), F.col("position")[1]),
        "longitude": F.when(F.col("position").isNotNull(), F.col("position")[0]),
        "location_kind": F.when(F.col("position").isNotNull(), F.lit("property_point")),
        **{f"address_{name}": F.when(has_address, value) for name, value in address_fields.items()},
        "address_purpose": F.when(has_address, F.lit("published_unspecified")),
        "access": F.lit(None).cast("string"),
        "physical_holes": F.lit(None).cast("int"),
    }
    if facility:
        columns |= {"course_count": F.lit(0), "documented_course_count": F.lit(0)}
    else:
        columns |= {
            "identity_status": F.lit("osm_course_feature"),
            "plan_eligible": F.lit(False),
            "planning_basis": F.lit("bookability_unconfirmed"),
            "address_mode": F.lit("own"),
        }
    rows = features.select(
        *[value.alias(name) for name, value in columns.items()],
        F.col("tags").alias("feature_tags"),
        "source_url",
        "checked_on",
        "credit",
    )
    stated = F.filter(
        F.array(*[F.when(F.col(name).isNotNull(), F.lit(name)) for name in columns]),
        lambda name: name.isNotNull(),
    )
    return rows.withColumn("fact_sources", F.array(citation(stated, "osm_snapshot")))


def citation(fields: Column, kind: str, source_id=None) -> Column:
    """One entry of a row's citation list, read from the row's source columns."""
    return F.struct(
        fields.alias("fields"),
        F.lit(kind).alias("source_kind"),
        F.col("source_url").alias("source_url"),
        F.col("checked_on").alias("checked_on"),
        F.lit("ODbL-1.0").alias("license"),
        F.col("credit").alias("credit"),
        (F.lit(None).cast("string") if source_id is None else source_id).alias("original_source_id"),
    )


def fill_unknown(rows: DataFrame, tags="feature_tags") -> DataFrame:
    """Fill access and holes where unknown; list the filled fields; cite the source once."""
    offered = {
        "access": access_code(F.col(tags)["access"]),
        "physical_holes": agreed_holes(F.col(tags)),
    }
    listed = F.filter(
        F.array(
            *[
                F.when(F.col(name).isNull() & value.isNotNull(), F.lit(name))
                for name, value in offered.items()
            ]
        ),
        lambda name: name.isNotNull(),
    )
    marked = rows.withColumn("filled_fields", listed)
    for name, value in offered.items():
        marked = marked.withColumn(name, F.coalesce(F.col(name), value))
    cited = F.concat("fact_sources", F.array(citation(F.col("filled_fields"), "osm_snapshot")))
    return marked.withColumn(
        "fact_sources", F.when(F.size("filled_fields") > 0, cited).otherwise(F.col("fact_sources"))
    )


def publishable(features: DataFrame, matched_ids: DataFrame) -> DataFrame:
    """Hold back new, unnamed facility polygons only; everything else may be published."""
    held = (
        (F.coalesce(tag("golf"), F.lit("")) != "course")
        & (F.coalesce(F.col("name"), F.lit("")) == "")
        & F.coalesce(F.col("geometry_status") == "source_polygon", F.lit(False))
    )
    marked = features.join(
        matched_ids.select("feature_id").distinct().withColumn("matched", F.lit(True)), "feature_id", "left"
    )
    return marked.where(F.col("matched").isNotNull() | ~held).drop("matched")


def refresh_tags(snapshot: DataFrame, newer: DataFrame):
    """Additions from a newer read of the same versions.

    Returns (refreshed rows, violations). A missing or extra id, another version, or a changed
    value is a violation; entity links are never refreshed.
    """
    # A pin on versions: compare every whitelisted tag but the entity link.
    fresh = newer.select(
        "feature_id",
        F.col("osm_version").alias("new_version"),
        F.map_filter(source_tags(F.col("tags")), lambda key, _: key != "wikidata").alias("new_tags"),
    )
    both = snapshot.select("feature_id", "osm_version", "tags").join(fresh, "feature_id", "full_outer")
    changed = F.filter(
        F.map_keys("new_tags"),
        lambda key: F.map_contains_key("tags", key) & (F.col("tags")[key] != F.col("new_tags")[key]),
    )
    rule = (
        F.when(F.col("tags").isNull() | F.col("new_tags").isNull(), "identity set differs")
        .when(F.col("osm_version") != F.col("new_version"), "version differs")
        .when(F.size(changed) > 0, "observation differs")
    )
    violations = both.select("feature_id", rule.alias("rule")).where("rule is not null")
    added = F.map_filter("new_tags", lambda key, _: ~F.map_contains_key("tags", key))
    refreshed = both.withColumn("additions", added).select(
        "feature_id", "osm_version", F.map_concat("tags", "additions").alias("tags"), F.map_keys("additions").alias("added")
    )
    return refreshed, violations
