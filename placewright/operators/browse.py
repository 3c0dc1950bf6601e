"""Reading the catalog: filters, literal search, radius, paging, browse predicates, nearby."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import geo
from ..functions.text import ascii_lower, filled, record_label
from . import cards
from .joins import join_known


def require(condition, message):
    if not condition:
        raise ValueError(message)


def text_value(value):
    return isinstance(value, str) and 0 < len(value.strip()) <= 256 and "\x00" not in value


def number(value):
    return type(value) in (int, float) and math.isfinite(value)


def equality(column: Column, value, unknown=False) -> Column:
    require(text_value(value), "invalid filter")
    if unknown and value == "unknown":
        return column.isNull()
    return column == value


def whole(column: Column, value) -> Column:
    require(type(value) is int and value > 0, "invalid filter")
    return column == value


def box_filter(latitude: Column, longitude: Column, bbox) -> Column:
    require(len(bbox) == 4 and all(number(n) for n in bbox), "invalid bounding box")
    south, west, north, east = bbox
    require(-90 <= south <= north <= 90 and abs(west) <= 180 and abs(east) <= 180, "invalid bounding box")
    return geo.in_box(latitude, longitude, bbox)


def radius_filter(latitude: Column, longitude: Column, center, radius_km) -> Column:
    good = center is not None and len(center) == 2 and all(number(n) for n in center) and number(radius_km)
    require(good, "invalid distance filter")
    require(abs(center[0]) <= 90 and abs(center[1]) <= 180 and 0 <= radius_km <= 20040, "invalid distance filter")
    return geo.within(latitude, longitude, center, radius_km)


def matching_names(rows: DataFrame, key: str, aliases: DataFrame, search: str) -> DataFrame:
    """Rows whose own name or any alias contains the literal text, folding A-Z only."""
    require(text_value(search), "invalid literal search")
    literal = ascii_lower(F.lit(search.strip()))
    hits = aliases.where(F.col(key).isNotNull() & ascii_lower(F.col("name")).contains(literal))
    marked = rows.join(hits.select(key).distinct().withColumn("alias_hit", F.lit(True)), key, "left")
    own = F.coalesce(ascii_lower(F.col("name")).contains(literal), F.lit(False))
    return marked.where(own | F.col("alias_hit").isNotNull()).drop("alias_hit")


def plannable() -> Column:
    known = F.col("nonmember_bookable")
    return F.coalesce(known | (known.isNull() & (F.col("access") == "public")), F.lit(False))


def with_round(courses: DataFrame, belongs: DataFrame, rounds: DataFrame, holes: int) -> DataFrame:
    """Courses that own, or are played by, a round of the given length."""
    require(type(holes) is int and holes > 0, "invalid round length")
    long_enough = rounds.where(F.col("round_holes") == holes).select("round_id")
    return courses.join(belongs.join(long_enough, "round_id", "left_semi"), "course_id", "left_semi")


def _common(state, country, county, access, holes, bbox, center, radius_km, place):
    clauses = []
    for column, value in (("state", state), ("country", country), ("county", county)):
        if value is not None:
            clauses.append(equality(F.col(column), value))
    if access is not None:
        clauses.append(equality(F.col("access"), access, unknown=True))
    if holes is not None:
        clauses.append(whole(F.col("physical_holes"), holes))
    latitude, longitude = place
    if bbox is not None:
        clauses.append(box_filter(latitude, longitude, bbox))
    if center is not None or radius_km is not None:
        clauses.append(radius_filter(latitude, longitude, center, radius_km))
    return clauses


def page_of(rows: DataFrame, order, limit, offset, after=None):
    """(total, page): the count before paging, and the ordered slice with distance kept.

    The slice is a top-k: no full sort, and at most offset + limit rows per task. Far pages are
    better asked for by `after`, the order values of the last row seen: then it is `limit` rows.
    `order` names columns, ascending with unknown first, the last one unique.
    """
    require(type(limit) is int and 1 <= limit <= 1000 and type(offset) is int and offset >= 0, "invalid pagination")
    total = rows.agg(F.count("*").alias("total"))
    if after is not None:
        require(offset == 0 and len(after) == len(order), "a page continues after one value per order column")
        # Structs compare field by field, unknown first, as the order does.
        last = F.struct(*[F.lit(v).cast(rows.schema[name].dataType).alias(name) for name, v in zip(order, after, strict=True)])
        rows = rows.where(F.struct(*order) > last)
    return total, rows.orderBy(*[F.asc_nulls_first(name) for name in order]).offset(offset).limit(limit)


def query_facilities(
    bundle, *, limit=100, offset=0, state=None, country=None, county=None, access=None, holes=None,
    search=None, bbox=None, center=None, radius_km=None, after=None,
):
    rows = bundle["facility"]
    place = F.col("latitude"), F.col("longitude")
    for clause in _common(state, country, county, access, holes, bbox, center, radius_km, place):
        rows = rows.where(clause)
    if search is not None:
        rows = matching_names(rows, "facility_id", bundle["alias"], search)
    if center is not None:
        rows = rows.withColumn("distance_km", geo.distance_km(F.lit(float(center[0])), F.lit(float(center[1])), *place))
    return page_of(rows, ["name", "facility_id"], limit, offset, after)


def query_courses(
    bundle, *, limit=100, offset=0, round_holes=None, plan=False, include_review=True, state=None,
    country=None, county=None, access=None, style=None, holes=None, search=None, bbox=None, center=None, radius_km=None, after=None,
):
    courses = bundle["course"]
    if plan:
        courses = courses.where(plannable())
    if not include_review:
        courses = courses.where(F.col("identity_status") == "operator_defined")
    if style is not None:
        courses = courses.where(equality(F.col("style"), style, unknown=True))
    if search is not None:
        courses = matching_names(courses, "course_id", bundle["alias"], search)
    if round_holes is not None:
        belongs = cards.membership(bundle["round_option"], bundle["round_component"], bundle["component"])
        courses = with_round(courses, belongs, bundle["round_option"], round_holes)
    facilities = bundle["facility"]
    place = F.col("latitude"), F.col("longitude")
    # Filters on the place belong to the facility and run before the join.
    for clause in _common(state, country, county, None, None, bbox, center, radius_km, place):
        facilities = facilities.where(clause)
    for clause in _common(None, None, None, access, holes, None, None, None, place):
        courses = courses.where(clause)
    rows = cards.course_listing(courses, facilities)
    if center is not None:
        point = F.col("map_location.latitude"), F.col("map_location.longitude")
        rows = rows.withColumn("distance_km", geo.distance_km(F.lit(float(center[0])), F.lit(float(center[1])), *point))
    return page_of(rows, ["facility_name", "facility_id", "name", "course_id"], limit, offset, after)


def course_matches(state="all", access="all", holes="all", style="all", bounds=None) -> Column:
    """The browse predicate on listed courses; `all` leaves a filter out."""
    clauses = []
    if state != "all":
        clauses.append(F.col("state") == state)
    if access == "nonmember":
        clauses.append(F.col("plan_eligible"))
    elif access == "unknown":
        clauses.append(F.col("access").isNull())
    elif access != "all":
        clauses.append(F.col("access") == access)
    if holes != "all":
        clauses.append(F.col("physical_holes") == int(holes))
    if style == "putting":
        clauses.append(~F.coalesce(F.col("game_kind") == "obstacle_minigolf", F.lit(False)))
    if style == "unknown":
        clauses.append(~F.coalesce(F.col("style").isin(list(fixed.STYLE_LABELS)), F.lit(False)))
    elif style != "all":
        clauses.append(F.col("style") == style)
    if bounds is not None:
        clauses.append(geo.in_box(F.col("latitude"), F.col("longitude"), bounds))
    result = F.lit(True)
    for clause in clauses:
        result = result & clause
    return result


def viewport_matches(bounds, active_facility=None) -> Column:
    """Inside the view, or a course of the selected facility (given while that is in view)."""
    inside = F.coalesce(geo.in_box(F.col("latitude"), F.col("longitude"), bounds), F.lit(False))
    if active_facility is None:
        return inside
    mine = F.col("course_id").isNotNull() & (F.coalesce("facility_id", "course_id") == active_facility)
    return inside | F.coalesce(mine, F.lit(False))


def entries(facilities: DataFrame, courses: DataFrame) -> DataFrame:
    """Browse entries: all courses, and the facilities that have none."""
    none = F.lit(None)
    held = courses.where(F.col("facility_id").isNotNull()).select("facility_id").distinct()
    parents = facilities.select("facility_id", F.col("name").alias("facility_name"), "state", "latitude", "longitude")
    identity = F.coalesce("facility_id", "course_id")
    shown = join_known(courses, parents, "facility_id").select(
        "course_id",
        "facility_id",
        F.col("course_id").alias("record_id"),
        identity.alias("group_id"),
        record_label(F.col("name"), F.col("facility_name"), identity, "course").alias("label"),
        "state",
        "access",
        "physical_holes",
        "style",
        "game_kind",
        "latitude",
        "longitude",
        *cards.eligibility(),
    )
    childless = facilities.join(held, "facility_id", "left_anti").select(
        none.cast("string").alias("course_id"),
        "facility_id",
        F.col("facility_id").alias("record_id"),
        F.col("facility_id").alias("group_id"),
        record_label(F.col("name"), none.cast("string"), F.col("facility_id"), "facility").alias("label"),
        "state",
        "access",
        "physical_holes",
        none.cast("string").alias("style"),
        none.cast("string").alias("game_kind"),
        "latitude",
        "longitude",
        none.cast("boolean").alias("plan_eligible"),
        none.cast("string").alias("planning_basis"),
    )
    return shown.unionByName(childless)


def in_groups(browse_entries: DataFrame, groups: DataFrame) -> DataFrame:
    """Entries of the given groups; `groups` has group_id."""
    return browse_entries.join(groups.select("group_id").distinct(), "group_id", "left_semi")


def sibling_groups(courses: DataFrame) -> DataFrame:
    """Facilities with two or more courses. Courses without a facility have no siblings."""
    return (
        courses.where(F.col("facility_id").isNotNull())
        .groupBy("facility_id")
        .agg(F.count("*").alias("siblings"))
        .where(F.col("siblings") >= 2)
    )


def group_of(browse_entries: DataFrame, identifier: str) -> DataFrame:
    """An id's group: its courses, or the single record."""
    mine = (F.col("group_id") == identifier) | (F.col("record_id") == identifier)
    return browse_entries.where(mine)


def city_label() -> Column:
    place = F.concat_ws(", ", "address_city", filled(F.col("state")))
    return F.when(F.col("address_city").isNotNull(), place)


def search_catalog(facilities: DataFrame, states: DataFrame, query: str, limit=12) -> DataFrame:
    """States, then cities, then facilities whose text contains the query; the first `limit`."""
    text = F.lit(query.strip().lower())
    none = F.lit(None).cast("string")
    found_states = states.where((F.lower("state_id") == text) | F.lower("state_name").contains(text)).select(
        F.lit("state").alias("kind"),
        F.lit(0).alias("kind_rank"),
        F.struct(F.col("state_id").alias("name"), F.col("state_id").alias("id")).alias("at"),
        F.col("state_id").alias("id"),
        F.format_string("%s (%s)", "state_name", "state_id").alias("label"),
        F.lit(1).cast("long").alias("records"),
    )
    at = F.struct(F.col("name"), F.col("facility_id").alias("id"))
    cities = (
        facilities.withColumn("city", city_label())
        .where(F.lower("city").contains(text))
        .groupBy("city")
        .agg(F.min(at).alias("at"), F.count("*").alias("records"))
        .select(F.lit("city").alias("kind"), F.lit(1).alias("kind_rank"), "at", none.alias("id"), F.col("city").alias("label"), "records")
    )
    label = record_label(F.col("name"), none, F.col("facility_id"), "facility")
    searched = F.concat(
        label, F.lit(" "), "facility_id", F.lit(" "), F.coalesce("address_city", F.lit("")), F.lit(" "), F.coalesce("state", F.lit(""))
    )
    places = facilities.where(F.lower(searched).contains(text)).select(
        F.lit("facility").alias("kind"),
        F.lit(2).alias("kind_rank"),
        at.alias("at"),
        F.col("facility_id").alias("id"),
        label.alias("label"),
        F.lit(1).cast("long").alias("records"),
    )
    everything = found_states.unionByName(cities).unionByName(places)
    return everything.orderBy("kind_rank", "at").limit(limit)


def scope_to(records: DataFrame, kind: str, value) -> DataFrame:
    """Records in a search choice: a state, a city label, or one facility."""
    if kind == "state":
        return records.where(F.col("state") == value)
    if kind == "city":
        return records.where(city_label() == value)
    require(kind == "facility", "unknown search choice")
    return records.where(F.col("facility_id") == value)


def extent(records: DataFrame) -> DataFrame:
    """South-west and north-east corners of the located records."""
    return records.where(geo.located(F.col("latitude"), F.col("longitude"))).agg(
        F.min("latitude").alias("south"),
        F.min("longitude").alias("west"),
        F.max("latitude").alias("north"),
        F.max("longitude").alias("east"),
    )


def catalog_counts(records: DataFrame) -> DataFrame:
    shown = geo.mappable(F.col("facility_id"), F.col("latitude"), F.col("longitude"), F.col("location_kind"))
    return records.agg(
        F.count("*").alias("total"), F.count_if(shown).alias("on_map"), F.count_if(~shown).alias("pending")
    )


def coincident_points(records: DataFrame, limit=cards.PART_ROWS) -> DataFrame:
    """Ids that share exact coordinates; a crowded point comes in several parts."""
    shown = geo.mappable(F.col("facility_id"), F.col("latitude"), F.col("longitude"), F.col("location_kind"))
    placed = records.where(shown).withColumn("point", F.concat_ws(",", F.col("latitude"), F.col("longitude")))
    return cards.nest(placed, "point", ["facility_id"], F.col("facility_id"), limit)


def near_origins(latitude: Column, longitude: Column, origins, radius_km=fixed.NEARBY_RADIUS_KM) -> Column:
    """Within the radius of any of a few origins, (id, latitude, longitude) each.

    At most eight origins are allowed, so they are literals of the filter and no join is needed.
    """
    require(len(origins) <= fixed.NEARBY_MAX_ORIGINS, "too many origins")
    require(len({o[0] for o in origins}) == len(origins), "origin ids must be unique")
    require(all(number(o[1]) and number(o[2]) and abs(o[1]) <= 90 and abs(o[2]) <= 180 for o in origins), "invalid origin")
    require(0 < radius_km <= fixed.NEARBY_MAX_RADIUS_KM, "invalid radius")
    result = F.lit(False)
    for _, a, b in origins:
        result = result | geo.within(latitude, longitude, (a, b), radius_km)
    return F.coalesce(result, F.lit(False))


def near_table(points: DataFrame, origins: DataFrame, radius_km: float) -> DataFrame:
    """Points within the radius of any origin of a table, by an equality join on grid cells.

    Both sides first shrink to distinct coordinates, so crowded places cost one test. An origin
    is listed in each cell its circle may touch: rows of cells one radius high, each cut into
    cells at least a radius wide at that latitude, and wrapping around the date line. `points`
    and `origins` need latitude and longitude.
    """
    # One latitude band is one radius high, a hair wider against rounding.
    step = radius_km / geo.KM_PER_DEGREE + 1e-6
    bands = math.ceil(180 / step)

    def band(latitude):
        return F.floor((latitude + 90) / step).cast("int")

    def columns_in(row):
        """Cells around the band's shortest parallel, each at least one radius of arc wide.

        A circle spans less than one cell to each side there, except near a pole, where the
        band is a single cell."""
        edge = F.greatest(F.abs(row * step - 90), F.abs((row + 1) * step - 90)) + step
        shrunk = F.cos(F.radians(F.least(edge, F.lit(90.0))))
        reach = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(math.radians(min(step, 89.9)))) / shrunk)))
        return F.when(edge >= 90, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(360 / (reach + 1e-6)).cast("int")))

    def column(longitude, count):
        return F.pmod(F.floor((longitude + 180) * count / 360).cast("int"), count)

    spots = points.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    spots = spots.select("latitude", "longitude").distinct()
    row = band(F.col("latitude"))
    cells = spots.withColumn("band", row).withColumn("cell", column(F.col("longitude"), columns_in(F.col("band"))))
    centers = (
        origins.where(F.col("latitude").isNotNull())
        .select(F.col("latitude").alias("o_lat"), F.col("longitude").alias("o_lon"))
        .distinct()
    )
    near_bands = F.sequence(
        F.greatest(band(F.col("o_lat")) - 1, F.lit(0)), F.least(band(F.col("o_lat")) + 1, F.lit(bands))
    )
    listed = centers.withColumn("band", F.explode(near_bands))
    count = columns_in(F.col("band"))
    middle = F.floor((F.col("o_lon") + 180) * count / 360).cast("int")
    around = F.array_distinct(F.array(*[F.pmod(middle + d, count) for d in (-1, 0, 1)]))
    listed = listed.withColumn("cell", F.explode(around))
    close = geo.distance_km(F.col("o_lat"), F.col("o_lon"), F.col("latitude"), F.col("longitude")) <= radius_km
    same = (cells["band"] == listed["band"]) & (cells["cell"] == listed["cell"]) & close
    hits = cells.join(listed, same, "left_semi").select("latitude", "longitude")
    return points.join(hits, ["latitude", "longitude"], "left_semi")
