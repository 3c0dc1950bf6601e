"""Text columns: contact scrubbing, entity ids, labels, addresses, coordinates, durations."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed


def ascii_lower(text: Column) -> Column:
    """Fold A-Z only, as literal search and the privacy scan do."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def clean_text(text: Column) -> Column:
    """NULL for a whole contact value; e-mail addresses, then phone numbers, are masked."""
    masked = F.regexp_replace(text, fixed.EMAIL, fixed.CONTACT_REMOVED)
    masked = F.regexp_replace(masked, fixed.PHONE, fixed.CONTACT_REMOVED)
    contact = F.lower(text).startswith("mailto:") | F.lower(text).startswith("tel:")
    return F.when(~contact, masked)


def clean_structure(value: Column, data_type: T.DataType) -> Column:
    """`clean_text` on every string inside a nested value; keys stay as they are."""
    if isinstance(data_type, T.StringType):
        return clean_text(value)
    if isinstance(data_type, T.ArrayType):
        return F.transform(value, lambda item: clean_structure(item, data_type.elementType))
    if isinstance(data_type, T.MapType):
        return F.transform_values(value, lambda _, item: clean_structure(item, data_type.valueType))
    if isinstance(data_type, T.StructType):
        rebuilt = F.struct(
            *[clean_structure(value[f.name], f.dataType).alias(f.name) for f in data_type.fields]
        )
        return F.when(value.isNotNull(), rebuilt)
    return value


def entity_ids(text: Column) -> Column:
    """Sorted distinct entity ids mentioned in a text; empty for NULL."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(fixed.ENTITY_ID), F.lit(0))
    return F.array_sort(F.array_distinct(found))


def lookup(value: Column, table: dict, default: Column | None = None) -> Column:
    """Literal table lookup; a value outside the table gives the default, or NULL."""
    result = None
    for key, label in table.items():
        result = F.when(value == key, label) if result is None else result.when(value == key, label)
    return result if default is None else result.otherwise(default)


def access_label(access: Column) -> Column:
    return lookup(access, fixed.ACCESS_LABELS, F.lit(fixed.ACCESS_UNKNOWN_LABEL))


def style_label(style: Column) -> Column:
    return lookup(style, fixed.STYLE_LABELS)


def filled(text: Column) -> Column:
    """NULL for an empty text."""
    return F.when(text != "", text)


def record_label(name: Column, facility_name: Column, identity: Column, kind) -> Column:
    """Own name, else the facility's, else a neutral label made of kind and identity."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    shown = F.replace(F.regexp_replace(identity, r"\Aosm/", "OSM "), F.lit("/"), F.lit(" "))
    unnamed = F.concat(F.lit("Unnamed golf "), kind, F.lit(" · "), shown)
    return F.coalesce(filled(name), filled(facility_name), unnamed)


def one_line_address(text, line1, line2, city, region, postal_code, country) -> Column:
    """Published text if there is one, else the known parts in one line."""
    place = filled(F.concat_ws(", ", city, region, postal_code))
    parts = F.concat_ws(", ", filled(line1), filled(line2), place, filled(country))
    return F.coalesce(text, filled(parts), F.lit(fixed.NO_ADDRESS_LABEL))


def geocoder_address(*parts: Column) -> Column:
    """Distinct non-empty parts of a geocoder feature, in order."""
    kept = F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != ""))
    return F.array_join(F.array_distinct(kept), ", ")


_NUMBER = r"([+-]?(?:\d+(?:\.\d*)?|\.\d+))"
_COORDINATE = rf"\A\s*{_NUMBER}\s*,\s*{_NUMBER}\s*\z"


def parse_coordinate(text: Column) -> Column:
    """struct(latitude, longitude) of a typed "lat, lon"; NULL if malformed or out of range."""
    latitude = F.regexp_extract(text, _COORDINATE, 1).try_cast("double")
    longitude = F.regexp_extract(text, _COORDINATE, 2).try_cast("double")
    good = (F.abs(latitude) <= 90) & (F.abs(longitude) <= 180)
    return F.when(good, F.struct(latitude.alias("latitude"), longitude.alias("longitude")))


def inside_core(latitude: Column, longitude: Column, bounds=None) -> Column:
    if bounds is None:
        return F.lit(True)
    south, west, north, east = bounds
    return latitude.between(south, north) & longitude.between(west, east)


def format_coordinate(latitude: Column, longitude: Column) -> Column:
    return F.format_string("%.5f, %.5f", latitude, longitude)


def duration(seconds: Column) -> Column:
    """Minutes, then hours and minutes; unknown or negative times are unavailable."""
    minutes = F.floor(seconds / 60 + 0.5).cast("long")
    hours = F.floor(minutes / 60).cast("long")
    rest = minutes % 60
    usable = seconds.isNotNull() & ~F.isnan(seconds) & (seconds >= 0) & (seconds < float("inf"))
    return (
        F.when(~usable, "Unavailable")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min")))
        .when(rest == 0, F.concat(hours.cast("string"), F.lit(" hr")))
        .otherwise(F.concat(hours.cast("string"), F.lit(" hr "), rest.cast("string"), F.lit(" min")))
    )
