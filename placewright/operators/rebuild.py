"""Rebuilding a release from features: rekey, mark origin, fill unknowns, add new rows, prove."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .. import schemas
from ..functions.canon import row_digest
from ..session import settle
from . import features as feature_ops
from . import links
from .entities import linked_entities
from .joins import join_known

KINDS = {"facilities": "facility_id", "courses": "course_id"}

LICENSES = [
    ("map contributors", "ODbL-1.0", "https://opendatacommons.org/licenses/odbl/1-0/"),
    ("linked knowledge base", "CC0-1.0", "https://creativecommons.org/publicdomain/zero/1.0/"),
]


def _entity_citations(features: DataFrame, entities: DataFrame) -> DataFrame:
    """Per feature, one citation for each entity it links to, in link order."""
    linked = linked_entities(features, entities)
    cited = F.struct(
        F.array(F.lit("wikidata")).alias("fields"),
        F.lit("explicit_wikidata_link").alias("source_kind"),
        F.col("entity_url").alias("source_url"),
        F.col("entity_checked_on").alias("checked_on"),
        F.lit("CC0-1.0").alias("license"),
        F.lit(None).cast("string").alias("credit"),
        F.lit(None).cast("string").alias("original_source_id"),
    )
    # A feature lists its links in one tag, so this list is bounded by that tag.
    listed = F.array_sort(F.collect_list(F.struct("at", cited.alias("c"))))
    return linked.groupBy("feature_id").agg(F.transform(listed, lambda x: x["c"]).alias("entity_citations"))


def _rekeyed(rows: DataFrame, name: str, rename: DataFrame) -> DataFrame:
    """A relation table with its catalog references under their new ids; other text stays."""
    key = schemas.KEYS.get(name)
    for column in schemas.REFERENCE_COLUMNS:
        if column not in rows.columns or column == key:
            continue
        if isinstance(rows.schema[column].dataType, ArrayType):
            rows = links.rekey_list(rows, [key], column, rename)
        elif column == "destination_id" and "scope" in rows.columns:
            rows = links.rekey(rows, column, rename, only=F.col("scope").isin("facility_estimate", "course_arrival"))
        else:
            rows = links.rekey(rows, column, rename)
    return rows


def rebuild(released: dict, features: DataFrame, entities: DataFrame, pairs: DataFrame) -> dict:
    """All tables of the rebuilt catalog.

    `released` holds facilities and courses with fact_sources, and any relation tables; `features`
    are feature records; `entities` has entity_id, entity_url, entity_checked_on; `pairs` the
    binding candidates. Relations come back with every declared reference rekeyed; `licenses` are
    the released ones and those of the features and entities.
    """
    # Joined by everything below, so it is computed once and its lineage is cut.
    mapping = settle(links.one_to_one(pairs, features), "mapping")
    rename = mapping.select(F.col("released_id").alias("old_id"), F.col("feature_id").alias("new_id"))
    open_features = feature_ops.publishable(features, mapping)
    source = features.select(
        F.col("feature_id").alias("osm_identity"), F.col("tags").alias("feature_tags"), "source_url", "checked_on", "credit"
    )
    entity_lists = _entity_citations(features, entities).withColumnRenamed("feature_id", "osm_identity")
    result, receipts = {"mapping": mapping}, []
    for kind, key in KINDS.items():
        rows = released[kind]
        matched = rows.join(mapping.select(F.col("released_id").alias(key), F.col("feature_id").alias("osm_identity")), key, "left")
        current = (
            matched.withColumn("released_id", F.col(key))
            .withColumn("catalog_origin", F.when(F.col("osm_identity").isNotNull(), "matched_release").otherwise("catalog_only"))
            .withColumn(key, F.coalesce("osm_identity", F.col(key)))
        )
        if kind == "courses":
            current = links.rekey(current, "facility_id", rename)
        wanted = F.coalesce(feature_ops.tag("golf") == "course", F.lit(False))
        fresh = open_features.where(wanted if kind == "courses" else ~wanted).join(mapping, "feature_id", "left_anti")
        new = (
            feature_ops.new_records(fresh, kind)
            .drop("feature_tags", "source_url", "checked_on", "credit")
            .withColumn("osm_identity", F.col(key))
            .withColumn("catalog_origin", F.lit("osm"))
        )
        together = join_known(current.unionByName(new, allowMissingColumns=True), source, "osm_identity")
        filled = join_known(feature_ops.fill_unknown(together), entity_lists, "osm_identity")
        own = F.when(
            F.col("source_url").isNotNull(),
            F.array(feature_ops.citation(F.array(F.lit("osm"), F.lit("osm_identity")), "osm_snapshot")),
        )
        none = F.array().cast(rows.schema["fact_sources"].dataType)
        cited = F.concat("fact_sources", F.coalesce(own, none), F.coalesce("entity_citations", none))
        rebuilt = filled.withColumn("fact_sources", cited).drop("entity_citations", "source_url", "checked_on", "credit")
        # Read again by the receipt, the counts and the proof, so each kind is written once.
        result[kind] = settle(rebuilt, "rebuilt")
        columns = sorted(rows.columns)
        receipts.append(
            rows.select(
                F.lit(kind).alias("kind"),
                F.col(key).alias("released_id"),
                row_digest(*columns).alias("sha256"),
                F.size("fact_sources").alias("citation_count"),
            )
        )
    for name, rows in released.items():
        if name not in KINDS and name != "licenses":
            result[name] = settle(_rekeyed(rows, name, rename), "relation")
    spark = features.sparkSession
    added = spark.createDataFrame(LICENSES, "source_id string, license string, license_url string")
    kept = released.get("licenses")
    result["licenses"] = added if kept is None else kept.unionByName(added.join(kept, "source_id", "left_anti"), allowMissingColumns=True)
    fills = [result[kind].where(F.col("released_id").isNotNull()).select("released_id", F.col(key).alias("record_id"), "filled_fields") for kind, key in KINDS.items()]
    receipt = reduce(DataFrame.unionByName, receipts)
    result["receipt"] = receipt.join(reduce(DataFrame.unionByName, fills), "released_id", "left")
    return result


def counts(released: dict, features: DataFrame, result: dict) -> DataFrame:
    """One row of rebuild counts."""
    mapping = result["mapping"]

    def split(kind):
        key = KINDS[kind]
        marked = released[kind].select(F.col(key).alias("released_id")).join(
            mapping.withColumn("m", F.lit(True)), "released_id", "left"
        )
        return marked.agg(F.count("m").alias(f"matched_{kind}"), F.count_if(F.col("m").isNull()).alias(f"catalog_only_{kind}"))

    def size(kind):
        return result[kind].agg(
            F.count("*").alias(kind),
            F.count_if(F.col("name").isNull()).alias(f"unnamed_{kind}"),
            F.count_if(F.col("catalog_origin") == "osm").alias(f"new_{kind}"),
        )

    kept = feature_ops.publishable(features, mapping).agg(F.count("*").alias("published_features"))
    every = features.agg(F.count("*").alias("input_features"))
    parts = [split("facilities"), split("courses"), size("facilities"), size("courses"), kept]
    # Each part is a single row, so each of its values is a scalar of the result.
    values = [part.select(name).scalar().alias(name) for part in parts for name in part.columns]
    return every.select("*", *values).withColumn("excluded_features", F.col("input_features") - F.col("published_features")).withColumn(
        "new_features", F.col("new_facilities") + F.col("new_courses")
    )


def preservation_violations(result: dict, columns: dict) -> DataFrame:
    """Released rows that the rebuilt catalog no longer reproduces: (released_id, rule).

    `columns` names the released columns of each kind. Undo in order: drop added columns, cut
    citations to the recorded count, set filled fields back to NULL if they still hold what the
    tags say, rename ids back, and compare digests.
    """
    back = result["mapping"].select(F.col("feature_id").alias("old_id"), F.col("released_id").alias("new_id"))
    found = []
    for kind, key in KINDS.items():
        receipt = result["receipt"].where(F.col("kind") == kind).select(
            "released_id", "sha256", "citation_count", F.col("filled_fields").alias("recorded_fills")
        )
        rows = result[kind].where(F.col("released_id").isNotNull())
        joined = receipt.join(rows, "released_id", "left")
        derived = {
            "access": feature_ops.access_code(F.col("feature_tags")["access"]),
            "physical_holes": feature_ops.agreed_holes(F.col("feature_tags")),
        }
        changed = F.lit(False)
        for name, value in derived.items():
            was_filled = F.array_contains("recorded_fills", name)
            changed = changed | (was_filled & ~F.col(name).eqNullSafe(value))
        joined = joined.withColumn("fill_changed", changed).withColumn("present", F.col(key).isNotNull())
        for name in derived:
            joined = joined.withColumn(name, F.when(~F.array_contains("recorded_fills", name), F.col(name)))
        undone = joined.withColumn(
            "fact_sources", F.slice("fact_sources", F.lit(1), F.greatest("citation_count", F.lit(0)))
        ).withColumn(key, F.col("released_id"))
        if kind == "courses":
            undone = links.rekey(undone, "facility_id", back)
        rule = (
            F.when(~F.col("present"), "released row missing")
            .when(F.col("fill_changed"), "filled value changed")
            .when(row_digest(*sorted(columns[kind])) != F.col("sha256"), "released fact changed")
        )
        judged = undone.select(F.lit(kind).alias("kind"), "released_id", rule.alias("rule"))
        found.append(judged.where(F.col("rule").isNotNull()))
    return reduce(DataFrame.unionByName, found)
