"""Versioned releases: bundles of tables with digests, written so that readers see all or nothing.

A release is a folder with one Parquet directory per table; its manifest is written last, and a
folder without a manifest is not a release.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canon
from ..operators import boundary
from ..session import settle
from . import csvfiles, jsonfiles

_MANIFEST = "name string, row_count long, sha256 string, columns string"


def write_bundle_csv(spark: SparkSession, tables: dict, metadata: dict, path: str) -> None:
    """Tables as typed CSV, and one metadata row that carries their column kinds."""
    kinds = {name: csvfiles.write_rows(rows, f"{path}/{name}.csv") for name, rows in tables.items()}
    pairs = [(k, str(v)) for k, v in metadata.items()]
    columns = [(table, column, kind, at) for table, c in kinds.items() for at, (column, kind) in enumerate(c.items())]
    spark.createDataFrame(columns, "table string, column string, kind string, at int").coalesce(1).write.json(f"{path}/columns")
    spark.createDataFrame(pairs, "key string, value string").coalesce(1).write.json(f"{path}/metadata")


def load_bundle_csv(spark: SparkSession, path: str, schemas: dict | None = None):
    """(metadata, tables) of a CSV bundle; the column list is small by nature."""
    listed = spark.read.schema("table string, column string, kind string, at int").json(f"{path}/columns").collect()
    metadata = {r["key"]: r["value"] for r in spark.read.schema("key string, value string").json(f"{path}/metadata").collect()}
    tables = {}
    for table in {r["table"] for r in listed}:
        kinds = {r["column"]: r["kind"] for r in sorted((r for r in listed if r["table"] == table), key=lambda r: r["at"])}
        tables[table] = csvfiles.read_rows(spark, f"{path}/{table}.csv", kinds, (schemas or {}).get(table))
    return metadata, tables


def manifest_rows(tables: dict) -> DataFrame:
    """One row per table: name, row count, digest and columns."""
    rows = [
        canon.table_digest(frame).select(
            F.lit(name).alias("name"), "row_count", F.col("table_sha256").alias("sha256"), F.lit(",".join(sorted(frame.columns))).alias("columns")
        )
        for name, frame in tables.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def write_release(spark: SparkSession, tables: dict, path: str) -> DataFrame:
    """Write every table, digest what was written, then the manifest."""
    for name, frame in tables.items():
        frame.write.parquet(f"{path}/{name}")
    written = {name: spark.read.schema(frame.schema).parquet(f"{path}/{name}") for name, frame in tables.items()}
    manifest_rows(written).coalesce(1).write.json(f"{path}/manifest")
    return read_manifest(spark, path)


def file_rows(spark: SparkSession, path: str, names) -> DataFrame:
    """name (table/file), bytes, sha256 of every file of a release's tables, from the files themselves."""
    parts = [jsonfiles.file_pins(spark, f"{path}/{name}/*.parquet").withColumn("name", F.concat(F.lit(name + "/"), "name")) for name in names]
    return reduce(DataFrame.unionByName, parts)


def file_violations(spark: SparkSession, path: str) -> DataFrame:
    """(name, rule) of files that are missing, extra, or not what the release's file manifest says."""
    pinned = settle(spark.read.schema("name string, bytes long, sha256 string").json(f"{path}/files"), "pins")
    names = [r["name"] for r in read_manifest(spark, path).select("name").collect()]
    return jsonfiles.pin_violations(file_rows(spark, path, names), pinned)


def publish(spark: SparkSession, tables: dict, licenses: DataFrame | None, path: str):
    """Publish typed nested tables if nothing in them is private: (violations, manifest or None).

    `tables` is name -> (rows, key); their walk begins at `.name#`. `licenses` are source_id and a
    map of license fields: the public ones are published as source_licenses, private ones are left
    out, and an unknown one is a violation. Everything is written to the shared folder and judged
    there first; the release is copied from what was judged, file manifest and manifest last, so a
    single violation publishes nothing.
    """
    staged = {name: (settle(rows, "staged"), key) for name, (rows, key) in tables.items()}
    if licenses is not None:
        public, unknown = boundary.license_fields(F.col("license"))
        split = settle(licenses.select("source_id", public.alias("license"), unknown.alias("unknown")), "licenses")
        staged["source_licenses"] = (split.select("source_id", "license"), "source_id")
    found = [boundary.typed_violations(rows, key, f".{name}#").select(F.lit(name).alias("table"), "id", "path", "rule") for name, (rows, key) in staged.items()]
    if licenses is not None:
        odd = split.select(F.lit("source_licenses").alias("table"), F.col("source_id").cast("string").alias("id"), F.explode("unknown").alias("path"))
        found.append(odd.withColumn("rule", F.lit("unknown license field")))
    violations = settle(reduce(DataFrame.unionByName, found), "violations")
    if violations.limit(1).count():
        return violations, None
    rows = {name: table for name, (table, _) in staged.items()}
    for name, frame in rows.items():
        frame.write.parquet(f"{path}/{name}")
    file_rows(spark, path, rows).coalesce(1).write.json(f"{path}/files")
    written = {name: spark.read.schema(frame.schema).parquet(f"{path}/{name}") for name, frame in rows.items()}
    manifest_rows(written).coalesce(1).write.json(f"{path}/manifest")
    return violations, read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).json(f"{path}/manifest")


def restore(spark: SparkSession, path: str):
    """(tables, violations): the release's tables, and where they differ from its manifest."""
    pinned = read_manifest(spark, path)
    names = [r["name"] for r in pinned.select("name").collect()]
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in names}
    actual = manifest_rows(tables)
    old = pinned.select("name", F.col("row_count").alias("pinned_rows"), F.col("sha256").alias("pinned_sha256"))
    both = actual.join(old, "name")
    wrong = (F.col("row_count") != F.col("pinned_rows")) | (F.col("sha256") != F.col("pinned_sha256"))
    return tables, both.where(wrong).select("name", "row_count", "pinned_rows")


def release_key(manifest: DataFrame) -> DataFrame:
    """One key for a whole release: the digest of its tables' digests (one row per table)."""
    parts = F.array_sort(F.collect_list(F.concat_ws(":", "name", "sha256")))
    return manifest.agg(F.sha2(F.array_join(parts, ","), 256).alias("release_key"), F.sum("row_count").alias("rows"))


def differences(published: DataFrame, regenerated: DataFrame) -> DataFrame:
    """Whole rows on one side only, copies counted."""
    columns = sorted(published.columns)
    left, right = published.select(*columns), regenerated.select(*columns)
    gone = left.exceptAll(right).withColumn("side", F.lit("published"))
    new = right.exceptAll(left).withColumn("side", F.lit("regenerated"))
    return gone.unionByName(new)
