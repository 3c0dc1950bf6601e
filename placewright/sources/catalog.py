"""The stored catalog: immutable versions, each with the batch that made it.

`<root>/versions/<n>/manifest` names the path of every table and the batch applied; it is written
last, so a half-written version is never seen, and a batch and its effect appear together. An
unchanged table keeps its earlier path. One writer at a time is a rule of deployment.
"""

import json
import re
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed, schemas
from ..functions import canon
from ..operators import cards, changes, holds, quality, retained
from ..session import settle

_MANIFEST = "table string, path string, version long, batch_id string, digest string, report string"


def _manifests(spark: SparkSession, root: str) -> DataFrame:
    """All complete versions, one row per table; a manifest is one file, moved in when done."""
    try:
        return spark.read.schema(_MANIFEST).json(f"{root}/versions/*/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def current_version(spark: SparkSession, root: str) -> int:
    return _manifests(spark, root).agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first()["v"]


def _table_paths(spark: SparkSession, root: str, version: int) -> dict:
    """The paths of every table of a version; a table that batches append to has several."""
    paths = {}
    for r in _manifests(spark, root).where(F.col("version") == version).select("table", "path").collect():
        paths.setdefault(r["table"], []).append(r["path"])
    return paths


def load(spark: SparkSession, root: str, version: int | None = None) -> dict:
    version = current_version(spark, root) if version is None else version
    return {table: spark.read.parquet(*paths) for table, paths in _table_paths(spark, root, version).items()}


def _publish(spark: SparkSession, root: str, version: int, changed: dict, kept: dict, batch=(None, None, None)) -> None:
    """Write the changed tables and appended parts under new names, then the manifest that makes them a version."""
    entries = [(name, path, version, *batch) for name, paths in kept.items() for path in paths]
    for name, rows in changed.items():
        path = f"{root}/tables/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        entries.append((name, path, version, *batch))
    manifest = spark.createDataFrame(entries, _MANIFEST).coalesce(1)
    # A leftover of a writer that died here has no readable manifest and is replaced.
    manifest.write.mode("overwrite").json(f"{root}/versions/{version}/manifest")


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    """A table of the layout without rows."""
    kinds = {"flag": "boolean", "whole": "int", "real": "double"}
    fields = {schemas.KEYS[name]: "string"}
    known = quality.value_kinds(name) if name in schemas.CORE or name in schemas.DOMAINS else dict.fromkeys(schemas.REFERENCES.get(name, {}), "text")
    fields |= {field: kinds.get(kind, "string") for field, kind in known.items()}
    return spark.range(1).where("false").select(*[F.lit(None).cast(kind).alias(field) for field, kind in fields.items()])


def complete(spark: SparkSession, tables: dict) -> dict:
    """All tables of the layout; those that the catalog has no row of yet are empty."""
    kept = {name: spark.range(1).where("false").selectExpr(*_none(fields)) for name, fields in retained.TABLES.items() if name not in tables}
    return {name: empty_table(spark, name) for name in schemas.KEYS if name not in tables and name != "source"} | kept | tables


def _none(fields: str) -> list:
    """Columns of these names and types without a value."""
    return [f"cast(null as {f.dataType.simpleString()}) as {f.name}" for f in T.StructType.fromDDL(fields)]


def create(spark: SparkSession, root: str, tables: dict) -> None:
    """Write the first version; an existing catalog is never overwritten."""
    if current_version(spark, root):
        raise ValueError("catalog already exists")
    _publish(spark, root, 1, tables, {})


def _stored_batch(spark: SparkSession, root: str, batch_id: str):
    return _manifests(spark, root).where(F.col("batch_id") == batch_id).select("digest", "report").first()


def _padded(rows: DataFrame, columns) -> DataFrame:
    """The rows with these text columns, NULL where the table was stored without them."""
    return rows.withColumns({c: F.lit(None).cast("string") for c in columns if c not in rows.columns})


def violations(spark: SparkSession, tables: dict, changed: dict | None = None) -> DataFrame:
    """All integrity rules over a catalog, as one table.

    `changed` (entity -> ids) limits the check to those rows and to what they can break: their own
    rules, their references, the keys they share, the facilities whose inventory they touch, and
    the scope of their facts. Rows are never deleted by a batch, so others stay as they were.
    """
    names = [n for n in tables if n in schemas.KEYS and n != "source" and (changed is None or n in changed)]
    rows = {}
    for name in names:
        key = schemas.KEYS[name]
        rows[name] = tables[name] if changed is None else tables[name].join(changed[name].select(F.col("id").alias(key)).distinct(), key, "left_semi")
    found = [quality.check_references(tables, rows)]
    for name in names:
        key = schemas.KEYS[name]
        found += [quality.check_rows(rows[name], name, key), quality.check_finite(rows[name], name, key), quality.check_unique(rows[name], name, [key])]
        for keys, where in schemas.UNIQUE.get(name, []):
            if {*keys, *(["role"] if where else [])} <= set(tables[name].columns):
                near = tables[name] if changed is None else tables[name].join(rows[name].select(*keys).distinct(), keys, "left_semi")
                found.append(quality.check_unique(near, name, keys, where))
    if {"facility", "course"} & set(names) and {"facility", "course"} <= tables.keys():
        facilities, courses = tables["facility"], tables["course"]
        if changed is not None:
            near = [rows[n].select("facility_id") for n in ("facility", "course") if n in rows]
            near = reduce(DataFrame.unionByName, near).distinct()
            facilities, courses = facilities.join(near, "facility_id", "left_semi"), courses.join(near, "facility_id", "left_semi")
        found.append(quality.check_inventory(facilities, courses))
    scope = {"course", "round_option", "round_component", "component"}
    if scope & set(names) and scope <= tables.keys() and (changed is None or {"round_option", "round_component", "component"} & set(names)):
        found.append(quality.check_round_scope(tables))
    typed = [n for n in schemas.TYPED if n in rows]
    if "source_observation" in tables:
        tables = tables | {"source_observation": _padded(tables["source_observation"], schemas.REFERENCES["source_observation"])}
    if typed and scope | {"source_observation", "fact_group"} <= tables.keys():
        subjects = []
        for name in typed:
            columns = rows[name].columns
            pick = [F.col(c) if c in columns else F.lit(None).cast("string").alias(c) for c in ("observation_id", "facility_id", "course_id", "round_id")]
            subjects.append(rows[name].select(F.col(schemas.KEYS[name]).alias("id"), *pick))
        belongs = cards.membership(tables["round_option"], tables["round_component"], tables["component"])
        found.append(quality.check_observation_scope(reduce(DataFrame.unionByName, subjects), tables, belongs))
        if "price_observation" in rows and "qualifying_prior_round_id" in rows["price_observation"].columns:
            found.append(quality.check_price_bundle(rows["price_observation"], tables))
    if "source_observation" in rows and {"fact_group", "course"} <= tables.keys():
        seen = _padded(rows["source_observation"], schemas.REFERENCES["source_observation"])
        found.append(quality.check_observation_references(tables | {"source_observation": seen}))
    columns = ["rule", "table", "id", "detail"]
    none = spark.range(1).where("false").select(*[F.lit(None).cast("string").alias(c) for c in columns])
    return reduce(DataFrame.unionByName, [f.select(*columns) for f in found if f is not None], none)


def judge_batch(tables: dict, batch: DataFrame, hold_list: DataFrame):
    """(guarded changes, violations by ordinal, conflicts, post-state tables).

    All set-based: a stale change is a conflict and is skipped; any violation rejects the batch.
    """
    tables = complete(batch.sparkSession, tables)
    guarded = settle(changes.guarded(batch, tables), "guarded")
    live = guarded.where(~F.col("stale"))
    # Only the observations and sources that the batch cites are read closely.
    observations = changes.cited_observations(live, tables["source_observation"])
    used = live.select("source_id").unionByName(observations.select("source_id"))
    by_retained = "retained" in batch.columns
    if by_retained:
        used = used.unionByName(retained.cited_sources(live))
    sources = settle(tables["source"].join(used.distinct(), "source_id", "left_semi"), "used")
    held = holds.held(sources, hold_list)
    fact = changes.with_observations(live, tables)
    entities = [e for e in tables if e in schemas.CORE or e in schemas.DOMAINS]
    bad = (
        changes.envelope_violations(guarded)
        .unionByName(changes.value_violations(live, entities))
        .unionByName(changes.moved_subjects(live, {e: tables[e] for e in entities}))
        .unionByName(changes.evidence_violations(fact, sources, observations, held))
        .unionByName(changes.late_parents(live))
    )
    after, flags = {}, []
    touched = {r["entity"] for r in live.select("entity").distinct().collect() if r["entity"] in entities}
    for entity in touched:
        key = schemas.KEYS[entity]
        mine = live.where(F.col("entity") == entity)
        after[entity] = changes.post_state(tables[entity], mine, key)
        if entity in ("facility", "course"):
            same = ["country", "state", "address_text"] if entity == "facility" else ["facility_id"]
            fresh = mine.where(F.col("current_digest").isNull())
            flagged, _ = changes.possible_duplicates(after[entity], fresh, key, [c for c in same if c in tables[entity].columns])
            flags.append(flagged.select(F.lit(entity).alias("entity"), F.col(key).alias("id"), F.lit("possible duplicate identity").alias("reason")))
    if by_retained:
        bad = bad.unionByName(retained.batch_violations(live, tables | {"source": sources}, after, held))
    conflicts = guarded.where("stale").select("entity", "id", F.lit("stale row or addition collision").alias("reason"))
    for part in flags:
        conflicts = conflicts.unionByName(part)
    return guarded, bad, conflicts, after


def apply_batch(
    spark: SparkSession, root: str, batch_id: str, batch: DataFrame, hold_list: DataFrame, apply=False, declared: DataFrame | None = None
) -> dict:
    """Preview or commit one batch, all or nothing; the same batch again returns its report.

    `declared` are sources the batch brings along: ordinal, source_id, url, license, attribution,
    controls_reference. They are registered as permitted before the changes are judged.
    """
    if not re.fullmatch(fixed.BATCH_ID, batch_id):
        raise ValueError("invalid batch id")
    batch = settle(batch, "batch")
    digest = canon.table_digest(batch).first()["table_sha256"]
    if declared is not None:
        declared = settle(declared, "declared")
        digest += canon.table_digest(declared).first()["table_sha256"]
    stored = _stored_batch(spark, root, batch_id)
    if stored:
        if stored["digest"] != digest:
            raise ValueError("batch id reused with different contents")
        return json.loads(stored["report"]) | {"state": "already_applied"}
    version = current_version(spark, root)
    tables = load(spark, root, version)
    report = {"batch_id": batch_id, "digest": digest, "state": "preview", "committed": False, "revision_before": version}
    registered = {}
    if declared is not None:
        judged = holds.register_sources(declared, tables["source"], hold_list)
        refused = judged.where(F.col("rule").isNotNull()).orderBy("ordinal").first()
        if refused:
            return report | {"state": "rejected", "reason": refused["rule"], "source_id": refused["source_id"]}
        columns = tables["source"].columns
        new = declared.withColumn("intake_policy", F.lit("permitted")).select(*columns)
        registered = {"source": settle(tables["source"].unionByName(new), "sources")}
        report["sources_added"] = declared.count()
        tables = tables | registered
    guarded, bad, conflicts, after = judge_batch(tables, batch, hold_list)
    # What only shows at the end of the batch has no ordinal.
    first = bad.orderBy(F.col("ordinal").asc_nulls_last(), "rule").first()
    if first:
        return report | {"state": "rejected", "reason": first["rule"], "ordinal": first["ordinal"]}
    after = {name: settle(rows, "after") for name, rows in after.items()}
    tables = complete(spark, tables)
    post = tables | after
    live = guarded.where(~F.col("stale"))
    named = {entity: live.where(F.col("entity") == entity).select("id") for entity in after}
    broken = violations(spark, post, named).orderBy("rule", "table", "id").first()
    if broken:
        return report | {"state": "rejected", "reason": f"{broken['table']}: {broken['rule']}"}
    report["conflicts"] = conflicts.count()
    rows = None
    for entity, new in after.items():
        part = changes.change_rows(tables[entity], new, guarded.where(F.col("entity") == entity), entity, schemas.KEYS[entity])
        rows = part if rows is None else rows.unionByName(part)
    if rows is not None:
        rows = settle(rows, "changes")
        own = post["facility"].select(F.lit("facility").alias("entity"), F.col("facility_id").alias("id"), "facility_id")
        if "course" in post:
            own = own.unionByName(post["course"].select(F.lit("course").alias("entity"), F.col("course_id").alias("id"), "facility_id"))
        report |= changes.report_counts(rows, own).first().asDict()
    if report["conflicts"]:
        return report | {"state": "conflicted"}
    if apply:
        report |= {"state": "applied", "committed": True, "revision_after": version + 1}
        # The ledger and the list of changes grow by a part per batch.
        seen = changes.cited_observations(live, tables["source_observation"])
        plain = live.where("retained is null") if "retained" in live.columns else live
        evidence = changes.ledger(plain, seen, batch_id)
        if "retained" in live.columns:
            evidence = evidence.unionByName(retained.ledger(live, tables["retained_evidence"], batch_id))
        appended = {"intake_evidence": evidence}
        if rows is not None:
            appended["batch_change"] = rows.select(F.lit(batch_id).alias("batch_id"), "*")
        after = registered | after
        kept = {n: p for n, p in _table_paths(spark, root, version).items() if n not in after}
        after |= appended
        _publish(spark, root, version + 1, after, kept, (batch_id, digest, json.dumps(report)))
    return report


