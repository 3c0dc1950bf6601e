"""Linked entities: claim projection, selection snapshot, person exclusion, link joins."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed


def project_claim(claim: Column) -> Column:
    """Structured value, dated qualifiers and reference ids of one claim; nothing else."""
    return F.struct(
        claim["id"].alias("id"),
        claim["rank"].alias("rank"),
        claim["mainsnak"]["datavalue"]["value"].alias("value"),
        claim["mainsnak"]["snaktype"].alias("snaktype"),
        F.map_filter(claim["qualifiers"], lambda key, _: key.isin(fixed.CLAIM_QUALIFIERS)).alias("qualifiers"),
        F.transform(
            claim["references"],
            lambda ref: F.map_filter(ref["snaks"], lambda key, _: key.isin(fixed.CLAIM_REFERENCES)),
        ).alias("references"),
    )


def project_claims(claims: Column) -> Column:
    kept = F.map_filter(claims, lambda key, _: key.isin(fixed.CLAIM_PROPERTIES))
    return F.transform_values(kept, lambda _, items: F.transform(items, project_claim))


def is_person(claims: Column) -> Column:
    kinds = F.coalesce(claims["P31"], F.expr("array()"))
    return F.exists(
        kinds,
        lambda claim: F.coalesce(claim["mainsnak"]["datavalue"]["value"] == fixed.PERSON, F.lit(False)),
    )


def linked_ids(features: DataFrame) -> DataFrame:
    return features.select(F.explode("wikidata_ids").alias("entity_id")).distinct()


def selection(features: DataFrame, members: DataFrame) -> DataFrame:
    """Linked and query-member ids in one set, each flagged by where it came from."""
    linked = linked_ids(features).withColumn("linked", F.lit(True))
    national = members.select("entity_id").distinct().withColumn("from_query", F.lit(True))
    false = F.lit(False)
    return linked.join(national, "entity_id", "full_outer").select(
        "entity_id",
        F.coalesce("linked", false).alias("linked"),
        F.coalesce("from_query", false).alias("from_query"),
    )


def snapshot(features: DataFrame, members: DataFrame, details: DataFrame) -> DataFrame:
    """Query membership first, details laid over it; people are left out, missing ones marked.

    `details` has entity_id, missing, person, label and claim_count.
    """
    chosen = selection(features, members)
    read = details.withColumnRenamed("entity_id", "read_id")
    joined = chosen.join(read, chosen["entity_id"] == read["read_id"], "left")
    known = F.col("read_id").isNotNull() & ~F.col("missing")
    kept = F.coalesce(~F.col("person"), F.lit(True)) & (known | F.col("from_query"))
    return joined.where(kept).select(
        "entity_id",
        "from_query",
        F.when(known, F.col("label")).alias("label"),
        F.when(known, F.col("claim_count")).otherwise(F.lit(0)).alias("claim_count"),
        F.when(F.coalesce("missing", F.lit(False)), "missing_at_read").alias("entity_status"),
    )


def drop_people(features: DataFrame, people: DataFrame) -> DataFrame:
    """Remove links to people, and the link tag of a feature that named one."""
    links = features.select("feature_id", F.posexplode("wikidata_ids").alias("at", "entity_id"))
    excluded = people.select("entity_id").distinct().withColumn("person", F.lit(True))
    # A feature's links come from one tag value, so regrouping them is bounded.
    judged = (
        links.join(excluded, "entity_id", "left")
        .groupBy("feature_id")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("person").isNull(), F.struct("at", "entity_id")))).alias("kept"),
            F.count("person").alias("people"),
        )
    )
    joined = features.join(judged, "feature_id", "left")
    without = F.map_filter("tags", lambda key, _: key != "wikidata")
    return joined.withColumn(
        "wikidata_ids", F.coalesce(F.transform("kept", lambda k: k["entity_id"]), F.col("wikidata_ids"))
    ).withColumn("tags", F.when(F.coalesce("people", F.lit(0)) > 0, without).otherwise(F.col("tags"))).drop(
        "kept", "people"
    )


def linked_entities(features: DataFrame, entities: DataFrame) -> DataFrame:
    """Explicit links resolved to entities, in the order the feature lists them."""
    links = features.select("feature_id", F.posexplode("wikidata_ids").alias("at", "entity_id"))
    return links.join(entities, "entity_id")
