"""Typed CSV: unknown values, empty texts, nested JSON cells and quoted line ends survive."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed

# A value that no cell holds, so that the reader itself never makes a NULL: a text that begins with
# this character, or that equals the mark for NULL, is written with one more of it in front.
_NO_NULL = "\u0001"
_DIALECT = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def column_kinds(schema: T.StructType) -> dict:
    """text for strings, json for everything else."""
    return {f.name: "text" if isinstance(f.dataType, T.StringType) else "json" for f in schema}


def write_rows(rows: DataFrame, path: str) -> dict:
    """Write a directory of CSV files and return the column kinds."""
    kinds = column_kinds(rows.schema)

    def cell(field):
        value = F.col(f"`{field.name}`")
        if kinds[field.name] == "json":
            # One-field JSON, unwrapped, so that scalars and nested values are written alike.
            wrapped = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
            value = F.when(value.isNotNull(), F.regexp_replace(wrapped, r'(?s)\A\{"v":(.*)\}\z', "$1"))
        guarded = F.when(value.startswith(_NO_NULL) | (value == fixed.CSV_NULL), F.concat(F.lit(_NO_NULL), value)).otherwise(value)
        return F.coalesce(guarded, F.lit(fixed.CSV_NULL)).alias(field.name)

    cells = rows.select(*[cell(f) for f in rows.schema])
    # Files stay small, since a file is later read by one task.
    cells.write.options(header=True, emptyValue="", lineSep="\n", maxRecordsPerFile=1_000_000, **_DIALECT).csv(path)
    return kinds


def read_rows(spark: SparkSession, path: str, kinds: dict, schemas: dict | None = None) -> DataFrame:
    """Read such files. JSON columns become VARIANT, or the given DDL type.

    A record may span lines, so a file is read by one task; the writer makes many files.
    """
    schemas = schemas or {}
    strings = T.StructType([T.StructField(name, T.StringType()) for name in kinds])
    raw = (
        spark.read.schema(strings)
        .options(header=True, multiLine=True, nullValue=_NO_NULL, maxCharsPerColumn=64 * 1024 * 1024, **_DIALECT)
        .csv(path)
    )

    def value(name):
        text = F.coalesce(F.col(f"`{name}`"), F.lit(""))
        plain = F.when(text.startswith(_NO_NULL), F.substring(text, 2, 2**31 - 1)).otherwise(text)
        known = F.when(text != fixed.CSV_NULL, plain)
        if kinds[name] == "json":
            if name in schemas:
                wrapped = F.concat(F.lit('{"v":'), known, F.lit("}"))
                known = F.from_json(wrapped, f"v {schemas[name]}")["v"]
            else:
                known = F.parse_json(known)
        return known.alias(name)

    return raw.select(*[value(name) for name in kinds])
