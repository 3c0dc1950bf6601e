"""Source holds: flattening control documents into scopes, matching, and registering sources."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import canon
from ..functions.variants import every_node

_NODE = "struct<path:string,mode:string,text:string,value:variant,item:variant>"


def _node(path, mode, text, value, item) -> Column:
    return F.struct(
        path.alias("path"),
        mode.alias("mode"),
        text.cast("string").alias("text"),
        value.cast("variant").alias("value") if value is not None else F.lit(None).cast("variant").alias("value"),
        item.alias("item"),
    )


def _string(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _field(item: Column, name: str) -> Column:
    return F.coalesce(_string(F.try_variant_get(item, "$." + name, "variant")), F.lit(""))


def _key_mode(key: Column, value: Column, item: Column) -> Column:
    """What a field of a control object means: how its value names a scope, or `visit`."""
    text = _string(value)
    shape = F.schema_of_variant(value)
    return (
        F.when(key.isin(fixed.HOLD_LIST_KEYS), "publisher text")
        .when((key == "host") & (_field(item, "path") != ""), "host with path")
        .when(key.isin(fixed.HOLD_HOST_KEYS), "publisher name")
        .when(key.isin(fixed.HOLD_URL_KEYS) & F.coalesce(text.rlike("^https?://"), F.lit(False)), F.concat(F.lit("url "), key))
        .when(key.isin(fixed.HOLD_SCOPE_KEYS), "host text")
        .when((key == "important_inherited_stop_groups") & shape.startswith("ARRAY"), "clauses")
        .when((key == "recent_exact_stops") & shape.startswith("OBJECT"), "exact stops")
        .otherwise("visit")
    )


def _children(node: Column) -> Column:
    """The nodes one level below; texts and named scopes end here."""
    none = F.lit(None)
    value, mode = node["value"], node["mode"]
    items = F.try_variant_get(value, "$", "array<variant>")
    fields = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    below = F.concat(node["path"], F.lit("/"))

    def list_item(v: Column, at: Column) -> Column:
        return _node(F.concat(below, at.cast("string")), mode, none, v, node["item"])

    def clause_item(v: Column, at: Column) -> Column:
        first = F.split(_string(v), ";")[0]
        return _node(F.concat(below, at.cast("string")), F.lit("publisher text"), first, None, node["item"])

    def field(e: Column) -> Column:
        return _node(F.concat(below, e["key"]), _key_mode(e["key"], e["value"], value), none, e["value"], value)

    def named(e: Column) -> Column:
        return _node(F.concat(below, e["key"]), F.lit("named host"), e["key"], None, e["value"])

    def stop(e: Column) -> Column:
        return _node(F.concat(below, e["key"]), F.lit("publisher text"), e["key"], None, e["value"])

    visited = F.transform(fields, field)
    host_key = rf"(?i)\A{fixed.HOST_NAME}\z"
    hosts = F.filter(fields, lambda e: e["key"].rlike(host_key) & (_key_mode(e["key"], e["value"], value) == "visit"))
    opened = F.concat(visited, F.transform(hosts, named))
    empty = F.array().cast(f"array<{_NODE}>")
    texts = mode.isin("publisher text", "host text")
    return F.coalesce(
        F.when((mode == "visit") | texts, F.transform(items, list_item)),
        F.when(mode == "visit", opened),
        F.when(mode == "clauses", F.transform(items, clause_item)),
        F.when(mode == "exact stops", F.transform(fields, stop)),
        empty,
    )


def hold_scopes(controls: DataFrame, key: str, value: str) -> DataFrame:
    """Scope rows of nested control documents, however deep: scope_id, control_id, control_path,
    kind, scope_key, original_scope, and the retained control item as JSON text.

    Publisher names, host mentions and exact resources; a profile URL never becomes a
    publisher ban.
    """
    root = _node(F.lit(""), F.lit("visit"), F.lit(None), F.col(value), F.col(value))
    rows = controls.select(F.col(key).alias("control_id"), F.array(root).alias("first"))
    leaf = every_node(rows, "control_id", "first", _children).select("control_id", "n.*")
    leaf = leaf.withColumn("text", F.coalesce("text", _string(F.col("value"))))

    kind, scope = _field(F.col("item"), "kind"), F.lower(_field(F.col("item"), "scope"))
    profile = (
        kind.contains("profile_specific")
        | F.lower(_field(F.col("item"), "disposition")).contains("no publisher-wide")
        | scope.contains("no publisher-wide")
    )
    path = canon.url_part(F.col("text"), "path")
    deep = (F.col("mode") == "url url") & ~path.isin("", "/", "/robots.txt") & ~kind.contains("publisher")
    exact = F.col("mode").startswith("url ") & (profile | deep)
    host_kind = F.when(scope.contains("no statewide"), "host").otherwise("publisher")
    texts = F.col("mode").isin("publisher text", "host text")
    urls = F.transform(
        F.regexp_extract_all("text", F.lit(fixed.URL_IN_TEXT), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;)]+\z", "")
    )
    rest = F.regexp_replace("text", fixed.URL_IN_TEXT, "")
    hosts = F.regexp_extract_all(rest, F.lit(fixed.HOST_IN_TEXT), F.lit(1))

    def pair(scope_kind, original):
        return F.struct(scope_kind.alias("kind"), original.alias("original"))

    text_kind = F.when(F.col("mode") == "publisher text", "publisher").otherwise("host")
    from_text = F.concat(
        F.transform(urls, lambda u: pair(F.lit("resource"), u)), F.transform(hosts, lambda h: pair(text_kind, h))
    )
    with_path = F.concat(F.lit("https://"), F.col("text"), _field(F.col("item"), "path"))
    found = (
        F.when(texts, from_text)
        .when(F.col("mode") == "host with path", F.array(pair(F.lit("resource"), with_path)))
        .when(F.col("mode").isin("publisher name", "named host"), F.array(pair(F.lit("publisher"), F.col("text"))))
        .when(exact, F.array(pair(F.lit("resource"), F.col("text"))))
        .when(F.col("mode").startswith("url "), F.array(pair(host_kind, canon.url_part(F.col("text"), "host"))))
    )
    scoped = leaf.where(F.col("text").isNotNull()).select("control_id", F.col("path").alias("control_path"), "item", F.explode(found).alias("s"))
    scope_key = F.when(F.col("s.kind") == "resource", canon.resource_identity(F.col("s.original"), hold=True)).otherwise(
        canon.hold_host(F.col("s.original"))
    )
    keyed = scoped.select(
        "control_id", "control_path", F.col("s.kind").alias("kind"), scope_key.alias("scope_key"),
        F.col("s.original").alias("original_scope"), F.to_json("item").alias("control"),
    )
    names = ["control_id", "control_path", "kind", "scope_key"]
    identity = F.sha2(F.to_json(F.array("kind", "scope_key", F.concat("control_id", "control_path"))), 256)
    # One text may name a scope twice in different spellings.
    kept = keyed.groupBy(*names).agg(F.max(F.struct("original_scope", "control")).alias("kept"))
    return kept.select(identity.alias("scope_id"), *names, "kept.*")


def matched_holds(sources: DataFrame, holds: DataFrame) -> DataFrame:
    """Ids of sources under a hold, with the kind that applies: (source_id, hold_kind).

    A publisher holds its subdomains: each distinct host is listed with its parent domains, so
    the suffix test is an equality. Hosts are made distinct first, so one crowded host is
    matched once.
    """
    target = sources.select(
        "source_id",
        canon.hold_host(canon.url_part(F.col("url"), "host")).alias("host"),
        canon.resource_identity(F.col("url"), hold=True).alias("resource"),
    )
    scopes = holds.select("kind", F.col("scope_key").alias("name")).distinct()
    hosts = target.select("host").distinct()
    by_suffix = hosts.select("host", F.explode(canon.host_suffixes(F.col("host"))).alias("name"))
    publishers = by_suffix.join(scopes.where("kind = 'publisher'"), "name", "left_semi").select("host")
    exact = hosts.join(scopes.where("kind = 'host'").select(F.col("name").alias("host")), "host", "left_semi")
    kinds = publishers.distinct().withColumn("hold_kind", F.lit("publisher")).unionByName(
        exact.withColumn("hold_kind", F.lit("host"))
    )
    by_host = target.join(kinds, "host").select("source_id", "hold_kind")
    resources = scopes.where("kind = 'resource'").select(F.col("name").alias("resource"))
    by_resource = target.join(resources, "resource", "left_semi").select("source_id", F.lit("resource").alias("hold_kind"))
    return by_host.unionByName(by_resource)


def held(sources: DataFrame, holds: DataFrame) -> DataFrame:
    return matched_holds(sources, holds).select("source_id").distinct()


def register_sources(declared: DataFrame, existing: DataFrame, holds: DataFrame) -> DataFrame:
    """Judge declared sources: NULL rule means accepted as permitted.

    `declared` has ordinal, source_id, url, controls_reference. A resource or id already
    registered, or declared earlier in the batch, is refused.
    """
    judged = declared.withColumn("identity", canon.resource_identity(F.col("url")))
    known = existing.select(canon.resource_identity(F.col("url")).alias("identity")).distinct()
    ids = existing.select("source_id").distinct().withColumn("id_taken", F.lit(True))
    first = judged.groupBy("identity").agg(F.min("ordinal").alias("first_ordinal"))
    first_id = judged.groupBy("source_id").agg(F.min("ordinal").alias("first_id_ordinal"))
    joined = (
        judged.join(known.withColumn("taken", F.lit(True)), "identity", "left")
        .join(ids, "source_id", "left")
        .join(first, "identity", "left")
        .join(first_id, "source_id", "left")
        .join(held(declared, holds).withColumn("held", F.lit(True)), "source_id", "left")
    )
    repeated = (
        F.col("taken").isNotNull()
        | F.col("id_taken").isNotNull()
        | (F.col("ordinal") > F.col("first_ordinal"))
        | (F.col("ordinal") > F.col("first_id_ordinal"))
    )
    bad_id = (F.trim("source_id") == "") | (F.length(F.trim("source_id")) > 200) | F.col("source_id").contains("\x00")
    rule = (
        F.when(bad_id, "invalid source id")
        .when(~canon.valid_url(F.col("url")) | F.col("identity").isNull(), "invalid source link")
        .when(F.col("url").rlike(r"[\x00-\x1f\x7f]"), "control characters in link")
        .when(F.col("held").isNotNull(), "source is held")
        .when(F.coalesce(F.trim("controls_reference"), F.lit("")) == "", "controls reference required")
        .when(repeated, "already registered")
    )
    return joined.select("ordinal", "source_id", "url", "identity", rule.alias("rule"))
