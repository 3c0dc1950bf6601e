"""Browse windows, nearby search and nesting against plain computations on small worlds."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from placewright.operators import browse, cards, links, ordering
from placewright.sources import jsonfiles
from test_functions import km


@pytest.fixture(scope="module")
def world(spark):
    facilities, courses = [], []
    for i in range(60):
        at = (35.0 + i % 12, -100.0 + i % 25) if i % 17 else (None, None)
        facilities.append((f"f-{i}", f"Facility {i}" if i % 9 else None, "IL" if i % 2 else "WI", "public" if i % 4 else None, 18 if i % 3 else 9, *at))
        if i % 3 == 0:
            for j in range(2 + i % 4):
                courses.append((f"c-{i}-{j}", f"f-{i}", f"{'Z' if j % 2 else 'A'} {i}-{j}", "public" if i % 4 else None, 18 if j % 2 else 9))
    courses += [(f"x-{i}", None, f"Independent {i}", "public", 9) for i in range(9)]
    f = spark.createDataFrame(facilities, "facility_id string, name string, state string, access string, physical_holes int, latitude double, longitude double")
    c = spark.createDataFrame(courses, "course_id string, facility_id string, name string, access string, physical_holes int")
    none = F.lit(None).cast("string")
    c = c.withColumns({"style": none, "game_kind": none, "nonmember_bookable": F.lit(None).cast("boolean")})
    return browse.entries(f, c).cache()


def plain_window(rows, sort, limit, matches, course, facility, focus):
    def order(r):
        label = (r["label"], r["record_id"])
        if sort == "name":
            return label
        return (r["physical_holes"] is None, r["physical_holes"] or 0, *label)

    kept = sorted([r for r in rows if matches(r)], key=order)
    first = lambda r: (
        not (course and any(k["course_id"] == course for k in kept if k["group_id"] == r["group_id"])),
        not (facility and r["group_id"] == facility),
        not (facility is None and r["facility_id"] is None),
    )
    groups = list(dict.fromkeys(r["group_id"] for r in sorted(kept, key=lambda r: (first(r), order(r)))))
    shown = groups[:limit]
    more = any(g != focus for g in groups[limit:])
    if focus in groups and focus not in shown:
        shown.append(focus)
    out = []
    for g in shown:
        out += sorted([r for r in kept if r["group_id"] == g], key=lambda r: (r["course_id"] != course if course else False, order(r)))
    return [r["record_id"] for r in out], more


@pytest.mark.parametrize("seed", range(10))
def test_window_equals_the_full_list(world, seed):
    rng = random.Random(seed)
    rows = world.collect()
    sort, limit = rng.choice(["name", "holes"]), rng.randint(1, 12)
    facility = rng.choice([None, f"f-{rng.randrange(60)}"])
    course = rng.choice([None, rng.choice([r["course_id"] for r in rows if r["course_id"]])])
    focus = rng.choice([None, rng.choice(rows)["group_id"]])
    access = rng.choice(["all", "public", "unknown"])
    holes = rng.choice(["all", "9", "18"])

    def matches(r):
        fits = access == "all" or (r["access"] is None if access == "unknown" else r["access"] == access)
        return fits and (holes == "all" or r["physical_holes"] == int(holes))

    window, more = ordering.browse_window(world, browse.course_matches(access=access, holes=holes), sort, limit, course, facility, focus)
    got = [r["record_id"] for r in window.collect()], more.first()["more"]
    assert got == plain_window(rows, sort, limit, matches, course, facility, focus)


@pytest.mark.parametrize("radius", [30.0, 160.0, 900.0])
def test_near_table_equals_brute_force(spark, radius):
    rng = random.Random(3)
    near_poles = [(s * rng.uniform(85, 90), rng.uniform(-180, 180)) for s in (1, -1) for _ in range(40)]
    seam = [(rng.uniform(-70, 70), s * rng.uniform(178, 180)) for s in (1, -1) for _ in range(40)]
    points = near_poles + seam + [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(500)]
    origins = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(40)] + [(90.0, 0.0), (-89.9, 50.0), (0.0, 180.0), (10.0, -179.99)] + points[:10]
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)] + [(-1, None, None)], "i int, latitude double, longitude double")
    o = spark.createDataFrame(origins, "latitude double, longitude double")
    got = {r["i"] for r in browse.near_table(p, o, radius).collect()}
    assert got == {i for i, x in enumerate(points) if any(km(*y, *x) <= radius for y in origins)}


def test_near_table_never_pairs_everything(spark):
    p = spark.range(100).selectExpr("id", "cast(id as double) as latitude", "cast(id as double) as longitude")
    plan = browse.near_table(p, p, 100.0)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_origin_limits():
    many = [(str(i), 0.0, 0.0) for i in range(9)]
    for origins, radius in ((many, 10), ([("a", 0.0, 0.0)] * 2, 10), ([("a", 91.0, 0.0)], 10), ([("a", 0.0, 0.0)], 0), ([("a", 0.0, 0.0)], 161)):
        with pytest.raises(ValueError):
            browse.near_origins(F.col("a"), F.col("b"), origins, radius)


def test_crowded_parents_come_in_parts(spark):
    rows = spark.range(1000).selectExpr("case when id < 900 then 'hot' else 'p' || (id % 10) end as parent", "id")
    nested = cards.nest(rows, "parent", ["id"], F.col("id"), limit=50).collect()
    hot = [r for r in nested if r["parent"] == "hot"]
    assert [len(r["items"]) for r in hot] == [50] * 18
    assert [i for r in sorted(hot, key=lambda r: r["part"]) for i in r["items"]] == list(range(900))
    assert all(r["items"] == sorted(r["items"]) for r in nested)
    assert all(r["part"] == 0 for r in nested if r["parent"] != "hot")
    parents = spark.createDataFrame([("hot", 1), ("p1", 2), ("empty", 3)], "parent string, own_value int")
    attached = cards.attach(parents, "parent", {"kids": cards.nest(rows, "parent", ["id"], F.col("id"), limit=50)}).collect()
    assert sum(len(r["kids"]) for r in attached if r["parent"] == "hot") == 900
    assert [r["kids"] for r in attached if r["parent"] == "empty"] == [[]]
    assert len([r for r in attached if r["parent"] == "hot" and r["own_value"] == 1]) == 1


def test_lists_nested_together_are_as_nested_alone(spark):
    one = spark.range(700).selectExpr("case when id < 500 then 'hot' else 'p' || (id % 7) end as parent", "'x' || (id % 100) as name", "id")
    two = spark.range(300).selectExpr("case when id < 120 then 'hot' when id < 200 then 'warm' else 'p' || (id % 9) end as parent", "cast(id as int) as id", "'y' || id as said")
    lists = {"ones": (one, ["name", "id"], F.struct("id", "name")), "twos": (two, ["id"], F.col("said"))}
    parents = spark.createDataFrame([(p,) for p in ("hot", "warm", "p1", "p8", "empty")], "parent string")
    both = cards.attach_lists(parents, "parent", lists, limit=50).collect()
    alone = cards.attach(parents, "parent", {n: cards.nest(rows, "parent", order, item, limit=50) for n, (rows, order, item) in lists.items()}).collect()
    shown = lambda rows: sorted((r["parent"], r["part"], str(r["ones"]), str(r["twos"])) for r in rows)
    assert shown(both) == shown(alone) and len(both) == 15
    hot = [r for r in sorted(both, key=lambda r: r["part"]) if r["parent"] == "hot"]
    assert [(i["name"], i["id"]) for r in hot for i in r["ones"]] == sorted((f"x{k % 100}", k) for k in range(500))
    assert [i for r in hot for i in r["twos"]] == [f"y{k}" for k in range(120)] and len(hot[3]["twos"]) == 0
    with pytest.raises(ValueError):
        cards.nest(one.selectExpr("parent", "id * 0.5 as half"), "parent", ["half"], F.col("half"))


def test_row_numbers_are_total_even_for_one_crowded_value(spark):
    rows = spark.range(2000).selectExpr("case when id % 3 = 0 then 'same' else 'n' || id end as label", "id")
    numbered = ordering.number_rows(rows, [F.col("label"), F.col("id")], partitions=6).collect()
    want = sorted((r["label"], r["id"]) for r in numbered)
    assert [(r["label"], r["id"]) for r in sorted(numbered, key=lambda r: r["position"])] == want
    assert sorted(r["position"] for r in numbered) == list(range(1, 2001))


def test_paging_limits(spark):
    rows = spark.range(5)
    for limit, offset in ((0, 0), (1001, 0), (1, -1), (True, 0)):
        with pytest.raises(ValueError):
            browse.page_of(rows, ["id"], limit, offset)
    total, page = browse.page_of(rows, ["id"], 2, 3)
    assert total.first()["total"] == 5 and [r["id"] for r in page.collect()] == [3, 4]


@pytest.mark.parametrize("search, count", [("100%", 1), ("%", 1), ("_", 0), ("' OR 1=1 --", 0), ("ALPHA", 1), ("second", 1)])
def test_literal_search(spark, search, count):
    rows = spark.createDataFrame([("f-1", "Alpha 100% Club"), ("f-2", "Beta"), ("f-3", None)], "facility_id string, name string")
    aliases = spark.createDataFrame([("f-2", "The Second Name"), (None, "second")], "facility_id string, name string")
    assert browse.matching_names(rows, "facility_id", aliases, search).count() == count


def test_box_crosses_the_date_line(spark):
    rows = spark.createDataFrame([(0.0, 179.5), (0.0, -179.5), (0.0, 0.0), (None, None)], "a double, b double")
    assert rows.where(browse.box_filter(F.col("a"), F.col("b"), (-1, 179, 1, -179))).count() == 2


def test_eligibility_is_three_valued(spark):
    rows = spark.createDataFrame(
        [(0, True, "private"), (1, False, "public"), (2, None, "public"), (3, None, "private"), (4, None, None)], "i int, nonmember_bookable boolean, access string"
    )
    got = [(r["plan_eligible"], r["planning_basis"]) for r in rows.select("i", *cards.eligibility()).orderBy("i").collect()]
    explicit, public, other = "explicit_nonmember_fact", "accepted_public_play_with_qualification", "unknown_or_nonpublic_access"
    assert got == [(True, explicit), (False, explicit), (True, public), (False, other), (None, other)]
    assert [r["i"] for r in rows.where(browse.plannable()).orderBy("i").collect()] == [0, 2]


def test_rekeyed_lists_stay_with_their_part(spark):
    rows = spark.createDataFrame([("k", 0, ["a", "b"]), ("k", 1, ["c", "d"]), ("e", 0, [])], "key string, part int, ids array<string>")
    mapping = spark.createDataFrame([("a", "A")], "old_id string, new_id string")
    got = {(r["key"], r["part"]): r["ids"] for r in links.rekey_list(rows, ["key", "part"], "ids", mapping).collect()}
    assert got == {("k", 0): ["A", "b"], ("k", 1): ["c", "d"], ("e", 0): []}


def test_large_files_are_pinned_by_their_stream(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 5000)
    (tmp_path / "b.bin").write_bytes(b"y")
    whole = sorted(map(tuple, jsonfiles.file_pins(spark, str(tmp_path)).collect()))
    assert whole == sorted(map(tuple, jsonfiles.file_pins(spark, str(tmp_path), whole_bytes=100).collect()))
    assert whole[0] == ("a.bin", 5000, hashlib.sha256(b"x" * 5000).hexdigest())


def test_pages_continue_after_the_last_row(spark):
    rows = spark.createDataFrame([(None if i % 5 == 0 else f"n{i % 7}", f"{i:02d}") for i in range(40)], "name string, id string")
    _, whole = browse.page_of(rows, ["name", "id"], 1000, 0)
    whole, seen, after = [tuple(r) for r in whole.collect()], [], None
    while True:
        total, page = browse.page_of(rows, ["name", "id"], 9, 0, after)
        page = [tuple(r) for r in page.collect()]
        if not page:
            break
        seen, after = seen + page, page[-1]
    assert seen == whole and total.first()["total"] == 40
    with pytest.raises(ValueError):
        browse.page_of(rows, ["name", "id"], 9, 3, ("a", "b"))
