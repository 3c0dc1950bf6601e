"""Canonical forms: JSON, digests, dates, URLs, hosts, paths and resource identities."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed


def canonical_json(*columns) -> Column:
    """Compact JSON with sorted keys at every level; unknown values are kept as null."""
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return F.to_json(F.parse_json(text))


def canonical_value(value: Column) -> Column:
    """Canonical JSON of one nested value (struct, array, map or variant)."""
    text = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.to_json(F.variant_get(F.parse_json(text), "$.v", "variant"))


def row_digest(*columns) -> Column:
    return F.sha2(canonical_json(*columns), 256)


# What to_json writes as canonical JSON does, once the fields are in order.
_WRITTEN = (T.StringType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.DateType)


def _direct(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        names = [n.lower() for n in kind.names]
        return bool(names) and len(set(names)) == len(names) and all(_direct(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _direct(kind.elementType)
    return isinstance(kind, (*_WRITTEN, T.DoubleType))


def _in_order(value: Column, kind: T.DataType) -> Column:
    """A value whose to_json is canonical: fields sorted, and whole doubles without their ".0"."""
    if isinstance(kind, T.StructType):
        parts = [_in_order(value[f.name], f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, _WRITTEN):
        return F.transform(value, lambda v: _in_order(v, kind.elementType))
    if isinstance(kind, T.DoubleType):
        whole = (F.abs(value) < 1e7) & (value == F.floor(value).cast("double"))
        return F.when(whole, value.cast("long").cast("variant")).otherwise(value.cast("variant"))
    return value


def struct_digest(kind: T.StructType, value=F.col) -> Column:
    """row_digest of the fields of a known type, whose values `value` gives by name.

    The text is that of canonical_json. Where the types allow it is written at once from sorted
    fields, not parsed and written again.
    """
    fields = sorted(kind, key=lambda f: f.name)
    if _direct(kind):
        return F.sha2(F.to_json(F.struct(*[_in_order(value(f.name), f.dataType).alias(f.name) for f in fields]), {"ignoreNullFields": "false"}), 256)
    return row_digest(*[value(f.name).alias(f.name) for f in fields])


def rows_digest(rows: DataFrame, *columns) -> Column:
    """row_digest of all columns of `rows`, or of the named ones."""
    return struct_digest(T.StructType([rows.schema[n] for n in columns or rows.columns]))


_LANES = 8


def _lane(k: int) -> Column:
    """The k-th number of 32 bits in column digest."""
    return F.conv(F.substring("digest", 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)")


def lane_sums(sign=None) -> list:
    """Sums of the eight numbers of 32 bits in column digest, and the number of rows; order-free,
    combined before a shuffle. With `sign` (1 or -1) rows are added or taken away, so that the sums
    of a version are those of the one before and of what changed."""
    factor = F.lit(1) if sign is None else sign
    return [F.sum(factor.cast("long")).alias("n"), *[F.sum(_lane(k) * factor.cast("decimal(1,0)")).alias(f"lane{k}") for k in range(_LANES)]]


LANES = ["n", *[f"lane{k}" for k in range(_LANES)]]


def lanes_digest(prefix="") -> Column:
    """The digest that columns n, lane0, lane1... of one row or group make."""
    return F.sha2(F.concat_ws(":", *[F.coalesce(F.col(prefix + name).cast("decimal(38,0)").cast("string"), F.lit("0")) for name in LANES]), 256)


def group_lanes(rows: DataFrame, key: str, *columns) -> DataFrame:
    """key, n and lane sums of each group's rows, in one pass."""
    digest = rows_digest(rows, *columns) if all(isinstance(c, str) for c in columns) else row_digest(*columns)
    return rows.select(key, digest.alias("digest")).groupBy(key).agg(*lane_sums())


def group_digest(rows: DataFrame, key: str, *columns) -> DataFrame:
    """(key, group_digest): one order-free digest of each group's rows, in one pass."""
    return group_lanes(rows, key, *columns).select(key, lanes_digest().alias("group_digest"))


def table_lanes(rows: DataFrame, *columns) -> DataFrame:
    """n and lane sums of a whole table, in one pass: one row."""
    digests = rows.select(F.spark_partition_id().alias("task"), rows_digest(rows, *columns).alias("digest"))
    # Two lanes are read at once, as a signed number of 64 bits, and taken apart.
    pairs = [F.conv(F.substring("digest", 1 + 16 * k, 16), 16, -10).cast("long").alias(f"pair{k}") for k in range(_LANES // 2)]
    digests = digests.select("task", *pairs)
    # Within a task whole numbers hold the sums of two thousand million rows; decimals add up the tasks.
    low = F.lit(0xFFFFFFFF).cast("long")
    numbers = [x for k in range(_LANES // 2) for x in (F.shiftrightunsigned(f"pair{k}", 32), F.col(f"pair{k}").bitwiseAND(low))]
    tasks = digests.groupBy("task").agg(F.count("*").alias("n"), *[F.sum(x).alias(f"lane{k}") for k, x in enumerate(numbers)])
    total = tasks.agg(F.sum("n").alias("n"), *[F.sum(F.col(name).cast("decimal(20,0)")).alias(name) for name in LANES[1:]])
    return total.select(*[F.coalesce(name, F.lit(0)).alias(name) for name in LANES])


def table_digest(rows: DataFrame, *columns) -> DataFrame:
    """One order-free digest of a whole table and its row count, in one pass.

    Each row's digest is read as numbers of 32 bits, and each number is summed over the table; the
    count and the sums make the table's digest. Sums combine before the shuffle, whatever the size.
    """
    return table_lanes(rows, *columns).select(lanes_digest().alias("table_sha256"), F.col("n").alias("row_count"))


def strict_date(text: Column) -> Column:
    """A calendar date written as YYYY-MM-DD, else NULL."""
    shaped = F.when(text.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), text)
    return F.try_to_date(shaped, "yyyy-MM-dd")


# RFC 3986 appendix B, split once; group numbers as in the standard.
_URL = r"(?s)\A(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?\z"


def url_part(url: Column, part: str) -> Column:
    """scheme, userinfo, host, port, path or query of a URL; empty text when absent."""
    authority = F.regexp_extract(url, _URL, 2)
    if part == "scheme":
        return F.lower(F.regexp_extract(url, _URL, 1))
    if part == "path":
        return F.regexp_extract(url, _URL, 3)
    if part == "query":
        return F.regexp_extract(url, _URL, 4)
    if part == "userinfo":
        return F.regexp_extract(authority, r"\A(.*)@", 1)
    place = F.regexp_replace(authority, r"\A.*@", "")
    if part == "port":
        return F.regexp_extract(place, r":([0-9]*)\z", 1)
    return F.lower(F.regexp_replace(place, r":[0-9]*\z", ""))


def valid_url(url: Column) -> Column:
    """http or https, with a host and without user information; NULL input is not valid."""
    plain = url_part(url, "userinfo").isin("", ":")
    good = url_part(url, "scheme").isin("http", "https") & (url_part(url, "host") != "") & plain
    return F.coalesce(good, F.lit(False))


def canonical_host(host: Column) -> Column:
    """ASCII lower-case host without trailing dots; NULL if a label is malformed."""
    bare = F.regexp_replace(host, r"\.+\z", "")
    plain = F.when(bare.rlike(r"\A\p{ASCII}*\z"), bare).otherwise(
        F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), bare)
    )
    lowered = F.lower(plain)
    labels = F.split(lowered, r"\.", -1)
    return F.when(F.forall(labels, lambda label: label.rlike(fixed.HOST_LABEL)), lowered)


def canonical_percent(text: Column) -> Column:
    """Decode escapes of unreserved characters; write the others in upper case."""
    pieces = F.split(text, "%", -1)

    def piece(item: Column, index: Column) -> Column:
        digits = F.substring(item, 1, 2)
        rest = F.substring(item, 3, 2**31 - 1)
        escaped = item.rlike(r"\A[0-9a-fA-F]{2}")
        code = F.conv(digits, 16, 10).cast("int")
        letter = F.char(code)
        decoded = F.when(
            (code < 128) & letter.rlike(r"\A[A-Za-z0-9._~-]\z"), F.concat(letter, rest)
        ).otherwise(F.concat(F.lit("%"), F.upper(digits), rest))
        return (
            F.when(index == 0, item)
            .when(escaped, decoded)
            .otherwise(F.concat(F.lit("%"), item))
        )

    return F.array_join(F.transform(pieces, piece), "")


def canonical_path(path: Column) -> Column:
    """Remove dot segments (RFC 3986), keeping repeated slashes; an empty path is "/"."""
    rooted = canonical_percent(F.coalesce(filled_path(path), F.lit("/")))
    segments = F.split(rooted, "/", -1)
    start = F.slice(segments, 1, 0)
    kept = F.aggregate(
        segments,
        start,
        lambda stack, segment: F.when(segment == ".", stack)
        .when(
            segment == "..",
            F.when(F.size(stack) > 1, F.slice(stack, F.lit(1), F.size(stack) - 1)).otherwise(stack),
        )
        .otherwise(F.concat(stack, F.array(segment))),
    )
    joined = F.array_join(kept, "/")
    dotted = F.element_at(segments, -1).isin(".", "..")
    closed = F.when(dotted & ~((F.size(kept) == 0)), F.concat(joined, F.lit("/"))).otherwise(joined)
    return F.coalesce(filled_path(closed), F.lit("/"))


def filled_path(path: Column) -> Column:
    return F.when(path != "", path)


def resource_identity(url: Column, hold=False) -> Column:
    """JSON list of scheme, host, non-default port, path and query; NULL if not a plain web URL.

    A hold identity leaves out the scheme and a leading "www.".
    """
    scheme = url_part(url, "scheme")
    host = canonical_host(url_part(url, "host"))
    port = url_part(url, "port").try_cast("int")
    default = F.when(scheme == "http", fixed.DEFAULT_PORTS["http"]).otherwise(fixed.DEFAULT_PORTS["https"])
    port_text = F.when(port.isNull() | (port == default), F.lit("null")).otherwise(port.cast("string"))
    if hold:
        host = F.regexp_replace(host, r"\Awww\.", "")

    def quoted(text: Column) -> Column:
        return F.regexp_replace(F.to_json(F.array(text)), r"\A\[|\]\z", "")

    shown_scheme = F.lit("null") if hold else quoted(scheme)
    parts = F.concat_ws(
        ",",
        shown_scheme,
        quoted(host),
        port_text,
        quoted(canonical_path(url_part(url, "path"))),
        quoted(canonical_percent(url_part(url, "query"))),
    )
    good = valid_url(url) & host.isNotNull() & (F.coalesce(port, F.lit(0)) <= 65535)
    return F.when(good, F.concat(F.lit("["), parts, F.lit("]")))


def hold_host(host: Column) -> Column:
    return F.regexp_replace(canonical_host(host), r"\Awww\.", "")


def host_suffixes(host: Column) -> Column:
    """The host and every parent domain, so that a suffix test becomes an equality."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
