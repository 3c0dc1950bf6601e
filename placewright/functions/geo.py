"""Geographic columns: distance, boxes, cells, and the inverse of the boundary map projection."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed

KM_PER_DEGREE = fixed.EARTH_RADIUS_KM * math.pi / 180


def distance_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance; the root is clamped to 1 so antipodes stay defined."""
    a, b = F.radians(lat1), F.radians(lat2)
    half = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(fixed.EARTH_RADIUS_KM * 2) * F.asin(F.least(F.lit(1.0), F.sqrt(half)))


def located(latitude: Column, longitude: Column) -> Column:
    """Finite and in range; never NULL."""
    good = (F.abs(latitude) <= 90) & (F.abs(longitude) <= 180)
    return F.coalesce(good, F.lit(False))


def mappable(identity: Column, latitude: Column, longitude: Column, kind: Column) -> Column:
    return identity.isNotNull() & located(latitude, longitude) & F.coalesce(
        kind.isin(fixed.MAPPABLE_KINDS), F.lit(False)
    )


def in_box(latitude: Column, longitude: Column, box) -> Column:
    """(south, west, north, east); west > east means the box crosses the date line."""
    south, west, north, east = box
    if west <= east:
        wide = longitude.between(west, east)
    else:
        wide = (longitude >= west) | (longitude <= east)
    return latitude.between(south, north) & wide


def radius_box(center, radius_km):
    """A box that surely contains the circle, for pushdown; None where it covers all longitudes."""
    latitude, longitude = center
    # A hair wider than the exact angle, so rounding never drops a point on the circle.
    angle = radius_km / KM_PER_DEGREE + 1e-6
    south, north = max(-90.0, latitude - angle), min(90.0, latitude + angle)
    if south <= -90 or north >= 90:
        return south, -180.0, north, 180.0
    reach = math.sin(math.radians(angle)) / math.cos(math.radians(latitude))
    if reach >= 1 or angle >= 90:
        return south, -180.0, north, 180.0
    width = math.degrees(math.asin(reach)) + 1e-6
    west, east = longitude - width, longitude + width
    if width >= 180:
        return south, -180.0, north, 180.0
    return south, west + 360 if west < -180 else west, north, east - 360 if east > 180 else east


def within(latitude: Column, longitude: Column, center, radius_km) -> Column:
    near = distance_km(F.lit(float(center[0])), F.lit(float(center[1])), latitude, longitude) <= radius_km
    if radius_km >= 90 * KM_PER_DEGREE:
        return latitude.isNotNull() & near
    return in_box(latitude, longitude, radius_box(center, radius_km)) & near


def point(latitude: Column, longitude: Column, kind: Column) -> Column:
    """Map point struct; NULL without a latitude."""
    made = F.struct(latitude.alias("latitude"), longitude.alias("longitude"), kind.alias("kind"))
    return F.when(latitude.isNotNull(), made)


def display_location(feature_point: Column, released_point: Column) -> Column:
    """The source position first, else the released location."""
    return F.coalesce(feature_point, released_point)


def unproject(x: Column, y: Column, state: Column) -> Column:
    """Latitude and longitude of a drawn boundary point: Albers conic, and two linear insets."""
    # Fixed values of the drawing: standard parallels, origin, scale and the insets.
    low, high, middle, meridian = 29.5, 45.5, 38.0, 96.0
    n = (math.sin(math.radians(low)) + math.sin(math.radians(high))) / 2
    c = math.cos(math.radians(low)) ** 2 + 2 * n * math.sin(math.radians(low))
    rho0 = math.sqrt(c - 2 * n * math.sin(math.radians(middle))) / n
    px, py = (x - 510) / 1100, F.lit(rho0) + (y - 270) / 1100
    rho = F.sqrt(px * px + py * py)
    conic = F.struct(
        F.degrees(F.asin((F.lit(c) - F.pow(rho * n, 2)) / (2 * n))).alias("latitude"),
        (F.degrees(F.atan2(px, py) / n) - meridian).alias("longitude"),
    )
    north_inset = F.struct((72 - (y - 435) / 6).alias("latitude"), ((x - 25) / 4.5 - 180).alias("longitude"))
    west_inset = F.struct((23 - (y - 490) / 19).alias("latitude"), ((x - 250) / 19 - 161).alias("longitude"))
    return F.when(state == "AK", north_inset).when(state == "HI", west_inset).otherwise(conic)


def ring_points(path: Column) -> Column:
    """Rings of a drawn path: one array of "x,y" texts per move command."""
    parts = F.filter(F.split(path, "M"), lambda part: part != "")
    return F.transform(
        parts, lambda part: F.regexp_extract_all(part, F.lit(r"-?\d+(?:\.\d+)?,-?\d+(?:\.\d+)?"), F.lit(0))
    )
