"""The public boundary: what may leave the catalog, and what must not."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions.text import ascii_lower
from ..functions.variants import every_node


def license_fields(license_map: Column):
    """(public fields, unknown keys) of a license map; private keys are dropped silently."""
    public = F.map_filter(license_map, lambda key, _: key.isin(fixed.LICENSE_FIELDS))
    known = F.array(*[F.lit(k) for k in fixed.LICENSE_FIELDS + fixed.LICENSE_PRIVATE_FIELDS])
    return public, F.array_except(F.map_keys(license_map), known)


def one_space(text: Column) -> Column:
    """Every kind of space as a plain one. Ordinary spaces already are, so they cost nothing."""
    return F.regexp_replace(text, fixed.SCAN_SPACE, " ")


def scan_text(text: Column) -> Column:
    """One kind of space, and A-Z folded; nothing depends on locale."""
    return ascii_lower(one_space(text))


def decode_plain(text: Column) -> Column:
    """Decode escapes of letters, digits and "._~-"."""

    def piece(item: Column, at: Column) -> Column:
        letter = F.char(F.conv(F.substring(item, 1, 2), 16, 10).cast("int"))
        plain = item.rlike(r"\A[2-7][0-9a-fA-F]") & letter.rlike(r"\A[A-Za-z0-9._~-]\z")
        decoded = F.concat(letter, F.substring(item, 3, 2**31 - 1))
        return F.when(at == 0, item).when(plain, decoded).otherwise(F.concat(F.lit("%"), item))

    pieces = F.array_join(F.transform(F.split(text, "%", -1), piece), "")
    return F.when(text.contains("%"), pieces).otherwise(text)


_KEYS = r"(?:^|[^a-z0-9_])(?:" + "|".join(fixed.CREDENTIAL_KEYS) + r") *="


def _let(value: Column, body) -> Column:
    """Evaluate `value` once and use it in several places of `body`."""
    return F.transform(F.array(value), body)[0]


def _finds(text: Column, pattern: str) -> Column:
    """Search folding A-Z only, which is what this flag means without the Unicode one; so the
    texts themselves need no folding."""
    return text.rlike("(?i)" + pattern)


# Each search below first asks for a character that every match must contain.


def _credential(view: Column) -> Column:
    user = (view.contains("@") | view.contains("%40")) & _finds(view, fixed.USERINFO_URL)
    return user | (view.contains("=") & _finds(view, _KEYS))


def _credential_in(spaced: Column) -> Column:
    return _let(decode_plain(spaced), _credential)


def _joined_credential(text: Column) -> Column:
    """The same rule on the text without tabs and line ends, where it has any."""
    flat = one_space(F.regexp_replace(text, r"[\t\n\r]", ""))
    return F.when(text.rlike(r"[\t\n\r]"), _let(flat, _credential_in)).otherwise(False)


def credential_syntax(text: Column) -> Column:
    """A URL with user information, or `key=` of a credential name, however broken by line ends."""
    return _let(one_space(text), _credential_in) | _joined_credential(text)


# Whatever is searched for holds one of these, so a text without any is done with after one look.
_TELLING = r"[@%=/\\:]"


def private_path(text: Column, operational: Column) -> Column:
    """Credentials or a local path in a text; public text fields may use plain slashes."""

    def path_in(scan: Column) -> Column:
        slash = scan.contains("/")
        slashed = slash & _finds(scan, fixed.POSIX_PATH)
        named = _finds(scan, fixed.PRIVATE_COMPONENT) | _finds(scan, fixed.PRIVATE_DECLARATION)
        lenient = (slash & _finds(scan, fixed.LOCAL_ROOT)) | (slashed & named)
        drive = (scan.contains(":") | scan.contains("\\")) & _finds(scan, fixed.EXPLICIT_PATH)
        return drive | F.when(operational, lenient).otherwise(slashed)

    def in_scan(spaced: Column) -> Column:
        linked = F.regexp_replace(spaced, "(?i)" + fixed.HTTP_TOKEN, "$1")
        unlinked = F.when(spaced.contains("://"), linked).otherwise(spaced)
        return _credential_in(spaced) | _let(unlinked, path_in)

    return F.when(~text.rlike(_TELLING), False).otherwise(_let(one_space(text), in_scan) | _joined_credential(text))


def _once(rows: DataFrame, *shown, rule: Column) -> DataFrame:
    """Rows that a rule names, the rule evaluated once. As a plain filter it is evaluated once more
    below the columns it is made from, and these with it each time they are used."""
    judged = rows.select(*shown, F.explode(F.array(rule)).alias("rule"))
    return judged.where(F.col("rule").isNotNull())


def _any(names):
    return "(?:" + "|".join(names) + ")"


# Paths of public text, written as .key for a field and # for a list position.
_TEXT_PATHS = [
    rf"\.relationships\.{_any(fixed.RELATION_TEXT_TABLES)}#\.{_any(fixed.CORE_TEXT)}",
    rf"\.{_any(['facilities', 'courses'])}#(?:\.{_any(fixed.CHILD_ROWS)}#)*(?:"
    + "|".join(
        [
            rf"\.{_any(fixed.CORE_TEXT)}",
            rf"\.address\.{_any(fixed.ADDRESS_TEXT)}",
            r"\.arrival\.reference",
            *[rf"\.optional\.{domain}#\.{_any(names.split())}" for domain, names in fixed.DOMAIN_TEXT.items()],
            r"\.optional\.architecture_event#\.credits#\.name",
        ]
    )
    + ")",
]
PUBLIC_TEXT = r"\A(?:" + "|".join(_TEXT_PATHS) + r")\z"


def public_text_path(path: Column) -> Column:
    return path.rlike(PUBLIC_TEXT)


def _children(node: Column) -> Column:
    """Nodes one level below a node: list items, or fields with their keys."""
    items = F.try_variant_get(node["value"], "$", "array<variant>")
    fields = F.map_entries(F.try_variant_get(node["value"], "$", "map<string,variant>"))
    # A key that looks like path syntax must not pass for one.
    from_list = F.transform(
        items, lambda v: F.struct(F.concat(node["path"], F.lit("#")).alias("path"), F.lit(None).cast("string").alias("key"), v.alias("value"))
    )
    from_object = F.transform(
        fields,
        lambda e: F.struct(
            F.concat(node["path"], F.lit("."), F.regexp_replace(e["key"], "[.#]", "?")).alias("path"),
            e["key"].alias("key"),
            e["value"].alias("value"),
        ),
    )
    return F.coalesce(from_list, from_object, F.slice(F.array(node), 1, 0))


def nodes(records: DataFrame, key: str, value: str, root: str) -> DataFrame:
    """Every node of a nested record, however deep: (id, path, key, shape, value)."""
    first = F.struct(F.lit(root).alias("path"), F.lit(None).cast("string").alias("key"), F.col(value).alias("value"))
    flat = every_node(records.select(F.col(key).alias("id"), F.array(first).alias("first")), "id", "first", _children)
    return flat.select("id", "n.path", "n.key", F.schema_of_variant("n.value").alias("shape"), "n.value")


def violations(records: DataFrame, key: str, value: str, root: str) -> DataFrame:
    """Nodes that may not be published: (id, path, rule). The record passes if there are none."""
    flat = nodes(records, key, value, root).withColumn("text", F.when(F.col("shape") == "STRING", F.try_variant_get("value", "$", "string")))
    license_path = F.col("path").rlike(r"\A\.source_licenses#\z")
    license_field = F.col("path").rlike(r"\A\.source_licenses#\.[^.#]*\z")
    note_path = F.col("path").rlike(r"\A\.provenance\.notes#\z")
    note_field = F.col("path").rlike(r"\A\.provenance\.notes#\.[^.#]*\z")
    is_object = F.col("shape").startswith("OBJECT")
    note_id = F.coalesce(F.try_variant_get("value", "$.id", "string"), F.lit(""))
    shaped = (
        (license_path & ~is_object)
        | (license_field & ~(F.col("key").isin(fixed.LICENSE_FIELDS) & F.col("shape").isin("STRING", "VOID")))
        | (note_path & (~is_object | (note_id == "")))
        | (note_field & ~((F.col("key") == "id") & (F.col("shape") == "STRING")))
    )
    bad_key = scan_text(F.col("key")).isin(fixed.PRIVATE_KEYS + fixed.CREDENTIAL_KEYS)
    bad_key_text = private_path(F.col("key"), F.lit(False))
    bad_text = F.col("text").contains("\x00") | private_path(F.col("text"), public_text_path(F.col("path")))
    rule = (
        F.when(F.coalesce(shaped, F.lit(False)), "license or note shape")
        .when(bad_key, "private key")
        .when(bad_key_text, "private text in key")
        .when(bad_text, "private text")
    )
    return _once(flat, "id", "path", rule=rule)


# --- typed rows --------------------------------------------------------------------------------


def _texts(value: Column, kind: T.DataType, path: Column):
    """Every text inside a typed value, however nested, as (path, text); None where its type has none."""

    def text(at, said, is_key=False):
        return F.struct(at.alias("path"), said.cast("string").alias("text"), F.lit(is_key).alias("is_key"))

    if isinstance(kind, T.StringType):
        return F.array(text(path, value))
    if isinstance(kind, T.StructType):
        parts = [_texts(value[f.name], f.dataType, F.concat(path, F.lit("." + f.name.replace(".", "?").replace("#", "?")))) for f in kind]
        parts = [p for p in parts if p is not None]
        return F.concat(*parts) if parts else None
    if isinstance(kind, T.ArrayType):
        if _texts(F.lit(None), kind.elementType, path) is None:
            return None
        inside = F.flatten(F.transform(value, lambda v: _texts(v, kind.elementType, F.concat(path, F.lit("#")))))
        return F.coalesce(inside, F.slice(F.array(text(F.lit(""), F.lit(""))), 1, 0))
    if isinstance(kind, T.MapType):

        def entry(e):
            at = F.concat(path, F.lit("."), F.regexp_replace(e["key"].cast("string"), "[.#]", "?"))
            more = _texts(e["value"], kind.valueType, at)
            own = F.array(text(at, e["key"], True))
            return own if more is None else F.concat(own, more)

        inside = F.flatten(F.transform(F.map_entries(value), entry))
        return F.coalesce(inside, F.slice(F.array(text(F.lit(""), F.lit(""))), 1, 0))
    if isinstance(kind, T.VariantType):
        raise ValueError("a variant is judged by `violations`")
    return None


def private_fields(kind: T.DataType, path="") -> list:
    """Paths of a schema's fields whose names may not be published."""
    if isinstance(kind, T.ArrayType):
        return private_fields(kind.elementType, path + "#")
    if isinstance(kind, T.MapType):
        return private_fields(kind.valueType, path + ".*")
    found = []
    if isinstance(kind, T.StructType):
        for f in kind:
            at = f"{path}.{f.name}"
            if f.name.lower() in fixed.PRIVATE_KEYS + fixed.CREDENTIAL_KEYS:
                found.append(at)
            found += private_fields(f.dataType, at)
    return found


def typed_violations(rows: DataFrame, key: str, root: str) -> DataFrame:
    """(id, path, rule) of typed nested rows that may not be published, by a walk made from their schema.

    The walk is one expression over each row, so nothing is parsed or shuffled; depth is the schema's.
    A field whose name is private is named once, with a NULL id, whatever its values.
    """
    named = private_fields(rows.schema, root)
    spark = rows.sparkSession
    wrong = spark.createDataFrame([(None, path, "private key") for path in named], "id string, path string, rule string")
    texts = _texts(F.struct(*[F.col(c) for c in rows.columns]), rows.schema, F.lit(root))
    if texts is None:
        return wrong
    said = rows.select(F.col(key).cast("string").alias("id"), F.explode(texts).alias("t")).select("id", "t.*").where("text is not null")
    bad_key = F.col("is_key") & scan_text(F.col("text")).isin(fixed.PRIVATE_KEYS + fixed.CREDENTIAL_KEYS)
    public = public_text_path(F.col("path")) & ~F.col("is_key")
    rule = F.when(bad_key, "private key").when(F.col("text").contains("\x00") | private_path(F.col("text"), public), "private text")
    return _once(said, "id", "path", rule=rule).unionByName(wrong)
