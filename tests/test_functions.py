"""Text, canonical and geographic functions against small truth tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from placewright.functions import canon, geo, text
from placewright.operators import features


def one(spark, column, *values, schema="v string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
    return [r["o"] for r in rows.select("i", column.alias("o")).orderBy("i").collect()]


def test_contacts_are_masked_and_whole_contacts_vanish(spark):
    got = one(
        spark, text.clean_text(F.col("v")), "Mail a.b+c@x-y.example.com now", "call +1 (212) 555-0100, 212.555.0101", "MAILTO:x@y.example",
        "tel:1", "1212 555 01001", "no contact", None,
    )
    mask = "[contact removed]"
    assert got == [f"Mail {mask} now", f"call {mask}, {mask}", None, None, "1212 555 01001", "no contact", None]


def test_entity_ids_are_whole_sorted_and_distinct(spark):
    assert one(spark, text.entity_ids(F.col("v")), "Q20;Q3,Q20 xQ4 Q05 éQ6", None) == [["Q20", "Q3"], []]


@pytest.mark.parametrize(
    "seconds, shown",
    [(None, "Unavailable"), (-1.0, "Unavailable"), (29.0, "0 min"), (30.0, "1 min"), (3600.0, "1 hr"), (3660.0, "1 hr 1 min"), (float("nan"), "Unavailable")],
)
def test_durations(spark, seconds, shown):
    assert one(spark, text.duration(F.col("v")), seconds, schema="v double") == [shown]


def test_typed_coordinates(spark):
    got = one(spark, text.parse_coordinate(F.col("v")), " +1.5 , -2. ", ".5,.25", "91,0", "1 2", "1,2,3", "x")
    assert [tuple(g) if g else None for g in got] == [(1.5, -2.0), (0.5, 0.25), None, None, None, None]


ACCESS = {
    "yes": "public", "public": "public", "private": "private", "no": "restricted", "restricted": "restricted", "customers": "restricted",
    "permissive": "restricted", "permit": "restricted", "guests": "restricted", "residents": "restricted", "unknown": None, "fee": None, None: None,
}


def test_access_codes(spark):
    assert one(spark, features.access_code(F.col("v")), *ACCESS) == list(ACCESS.values())


@pytest.mark.parametrize(
    "tags, holes",
    [
        ({"holes": "18"}, 18), ({"golf:holes": "9"}, 9), ({"holes": "018", "golf:holes": "18"}, 18), ({"holes": "9", "golf:holes": "18"}, None),
        ({"holes": "0"}, None), ({"holes": "-9"}, None), ({"holes": "9.0"}, None), ({"holes": "nine", "golf:holes": "9"}, None), ({"holes": ""}, None), ({}, None),
        ({"holes": "9" * 60}, None),
    ],
)
def test_hole_tags_must_agree(spark, tags, holes):
    assert one(spark, features.agreed_holes(F.col("v")), tags, schema="v map<string,string>") == [holes]


@pytest.mark.parametrize(
    "path, normal",
    [
        ("", "/"), ("/a/b/../c", "/a/c"), ("/a/./b/.", "/a/b/"), ("/..", "/"), ("/a/..", "/"), ("/a//b/../c", "/a//c"), ("/%7Euser/%2f", "/~user/%2F"),
        ("/a/../../b", "/b"), ("/%zz%4", "/%zz%4"),
    ],
)
def test_paths(spark, path, normal):
    assert one(spark, canon.canonical_path(F.col("v")), path) == [normal]


def test_resource_identities(spark):
    same = ["http://Example.com:80/a/../b?x=%41", "http://example.com./b?x=A#f"]
    assert len(set(one(spark, canon.resource_identity(F.col("v")), *same))) == 1
    held = ["https://www.example.com/b", "http://example.com/b"]
    assert len(set(one(spark, canon.resource_identity(F.col("v"), hold=True), *held))) == 1
    bad = ["https://user:pw@example.com/", "ftp://example.com/", "https:///x", "https://a_b.example/", "https://x.example:99999/"]
    assert one(spark, canon.resource_identity(F.col("v")), *bad) == [None] * 5


def test_dates_are_strict(spark):
    got = one(spark, canon.strict_date(F.col("v")).cast("string"), "2026-02-28", "2026-02-30", "2026-2-3", " 2026-02-28", None)
    assert got == ["2026-02-28", None, None, None, None]


def test_table_digest_ignores_order_and_counts_copies(spark):
    rows = [(i % 50, f"n{i % 7}", None if i % 3 else i) for i in range(400)]
    schema = "a int, b string, c int"
    first = canon.table_digest(spark.createDataFrame(rows, schema)).first()
    random.Random(1).shuffle(rows)
    again = canon.table_digest(spark.createDataFrame(rows, schema).repartition(7).select("c", "b", "a")).first()
    assert first == again
    more = canon.table_digest(spark.createDataFrame(rows + rows[:1], schema)).first()
    assert more["table_sha256"] != first["table_sha256"] and more["row_count"] == 401
    assert canon.table_digest(spark.createDataFrame([], schema)).first()["row_count"] == 0


def km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 6371.0088 * 2 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("center", [(0.0, 179.9), (89.5, 10.0), (-60.0, -179.95), (45.0, 0.0)])
@pytest.mark.parametrize("radius", [0.0, 160.0, 3000.0, 15000.0])
def test_radius_box_loses_nothing(spark, center, radius):
    rng = random.Random(7)
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(400)] + [center]
    points += [(max(-90.0, min(90.0, center[0] + rng.uniform(-2, 2))), (center[1] + rng.uniform(-2, 2) + 180) % 360 - 180) for _ in range(200)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, a double, b double")
    got = {r["i"] for r in rows.where(geo.within(F.col("a"), F.col("b"), center, radius)).collect()}
    assert got == {i for i, p in enumerate(points) if km(*center, *p) <= radius}
