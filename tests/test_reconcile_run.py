"""A whole reconciliation: cards kept by delta, and a sealed receipt that proves the baseline."""

import pytest
from pyspark.sql import functions as F

from placewright.functions import canon
from placewright.operators import cards, reconcile
from placewright.session import settle

CITATION = "array<struct<fields:array<string>,source_kind:string,source_url:string,checked_on:string,license:string,credit:string,original_source_id:string>>"
FACILITY = (
    "facility_id string, name string, state string, country string, county string, access string, operating_status string, physical_holes int, inventory_complete boolean, "
    f"website string, latitude double, longitude double, location_kind string, released_id string, address_text string, address_purpose string, address_street_line1 string, address_street_line2 string, address_city string, address_region string, address_postal_code string, address_country string, fact_sources {CITATION}, "
    "source_url string, checked_on string, credit string, course_count long, documented_course_count long"
)
COURSE = (
    "course_id string, facility_id string, name string, access string, physical_holes int, nonmember_bookable boolean, identity_status string, address_mode string, destination_id string, "
    f"arrival_latitude double, arrival_longitude double, arrival_kind string, arrival_reference string, booking_conditions string, fact_sources {CITATION}"
)


def facility(k, **own):
    row = dict.fromkeys([c.split()[0] for c in FACILITY.split(", ")]) | {
        "facility_id": f"f{k}", "name": f"F{k}", "latitude": float(k), "longitude": 1.0, "location_kind": "site", "fact_sources": [], "course_count": 0, "documented_course_count": 0, **own,
    }
    return tuple(row.values())


def bundle_of(spark):
    frame = spark.createDataFrame
    rows = [facility(1, name="Target", latitude=None), facility(2, name="Copy", access="public", source_url="u/2", checked_on="2026-01-01", credit="c"), facility(3), facility(4), facility(5), facility(6)]
    course = lambda c, f: (c, f, f"C{c}", None, 9, None, "operator_defined", "inherit", None, None, None, None, None, None, [])
    return {
        "facility": frame(rows, FACILITY),
        "course": frame([course("c1", "f1"), course("c3", "f3"), course("c6", "f6")], COURSE),
        "round_option": frame([("r1", "f2", None, "R1", 18, None), ("r2", None, "c1", "R2", 9, None), ("r4", "f4", None, "R4", 18, None), ("r6", "f6", None, "R6", 18, None)], "round_id string, facility_id string, course_id string, name string, round_holes int, description string"),
        "round_component": frame([("m1", "r1", 1, "p1", None, 1), ("m2", "r4", 1, "p3", None, 1), ("m3", "r6", 1, "p6", None, 1)], "member_id string, round_id string, ordinal int, component_id string, course_id string, repetitions int"),
        "component": frame([("p1", "c1", "front", 9), ("p3", "c3", "all", 9), ("p6", "c6", "all", 9)], "component_id string, course_id string, name string, physical_holes int"),
        "tee_set": frame([("t1", "c1", None, "blue", 6000, "yards", 72, 113), ("t2", None, "r4", "red", 5000, "yards", 70, 110)], "tee_id string, course_id string, round_id string, name string, yardage int, yardage_unit string, par int, slope int"),
        "alias": frame([("a1", "f2", None, "Old copy"), ("a2", None, "c3", "Three"), ("a3", "f4", None, "Gone")], "alias_id string, facility_id string, course_id string, name string"),
        "destination": frame([("facility_estimate", f"f{k}", float(k), 1.0) for k in (2, 4, 5)], "scope string, id string, latitude double, longitude double"),
        "metadata": frame([("revision", "4"), ("facilities", "6"), ("courses", "3"), ("unnamed_courses", "0"), ("note", "kept")], "key string, value string"),
    }


def plan_of(spark):
    none = (None, "same place", "reviewed", 1, None, None)
    return spark.createDataFrame(
        [(1, "merge_facility", "f2", "f1", *none), (2, "remove_component", "f4", "f3", *none)],
        "ordinal long, action string, source_id string, target_facility_id string, target_course_id string, rule string, reason string, evidence_count int, source_sha256 string, withheld_fields array<string>",
    )


@pytest.fixture(scope="module")
def run(spark):
    bundle = bundle_of(spark)
    sources = spark.createDataFrame([], "source_id string, name string, tags map<string,string>, position array<double>, source_url string, checked_on string, credit string")
    result = reconcile.written(bundle, reconcile.apply(bundle, plan_of(spark), sources))
    before = bundle | {"destination": reconcile.keyed_destinations(bundle["destination"])}
    sealed = settle(reconcile.seal(reconcile.lanes_of({n: before[n] for n in result["receipts"]}), result["receipts"], result["plan"], result["decisions"]), "seal")
    return before, result, sealed


def test_cards_by_delta_equal_cards_from_scratch(run):
    before, result, _ = run
    made = {"facility": cards.facility_cards(before), "course": cards.course_cards(before)}
    shown = lambda rows: sorted(map(repr, (r.asDict(True) for r in rows.collect())))
    facility_ids, course_ids = reconcile.affected_cards(before, result["tables"], result["receipts"])
    assert {r[0] for r in facility_ids.collect()} == {"f1", "f2", "f3", "f4"} and {r[0] for r in course_ids.collect()} == {"c1", "c3"}
    fresh = reconcile.refresh_cards(made, before, result["tables"], result["receipts"])
    assert shown(fresh["facility"]) == shown(cards.facility_cards(result["tables"]).select(*made["facility"].columns))
    assert shown(fresh["course"]) == shown(cards.course_cards(result["tables"]).select(*made["course"].columns))
    target = fresh["facility"].where("facility_id = 'f1'").first()
    assert [a["name"] for a in target["aliases"]].count("Old copy") == 1 and [r["round_id"] for r in target["round_options"]] == ["r1"]
    assert target["map_location"]["latitude"] == 2.0 and target["access"] == "public"


def test_seal_is_what_full_scans_say(run):
    before, result, sealed = run
    said = {r["item"]: r for r in sealed.collect()}
    for name in result["receipts"]:
        digests = [canon.table_digest(v[name]).first()["table_sha256"] for v in (before, result["tables"])]
        assert [said[name]["before_sha256"], said[name]["after_sha256"]] == digests, name
    assert said["component"]["before_sha256"] == said["component"]["after_sha256"] and said["catalog"]["before_sha256"] != said["catalog"]["after_sha256"]
    facts = {r["key"]: r["value"] for r in result["tables"]["metadata"].collect()}
    assert facts == {"revision": "5", "facilities": "4", "courses": "3", "unnamed_courses": "0", "note": "kept"}


def test_restore_proves_the_baseline(run):
    before, result, sealed = run
    back = reconcile.restore_proved(result, sealed)
    for name, rows in back.items():
        assert sorted(map(repr, rows.collect())) == sorted(map(repr, before[name].select(*rows.columns).collect())), name


def test_tampering_with_any_part_is_found(run):
    _, result, sealed = run
    assert reconcile.seal_violations(result, sealed).count() == 0
    # Every table at once, in a row that the run did not touch.
    edits = {
        "facility": ("facility_id = 'f6'", "county"), "course": ("course_id = 'c6'", "name"), "round_option": ("round_id = 'r6'", "name"), "round_component": ("member_id = 'm3'", "course_id"),
        "component": ("component_id = 'p6'", "name"), "tee_set": ("tee_id = 't1'", "name"), "alias": ("alias_id = 'a2'", "name"), "destination": ("id = 'f5'", "scope"), "metadata": ("key = 'note'", "value"),
    }
    forged = {name: result["tables"][name].withColumn(column, F.when(F.expr(where), "!").otherwise(F.col(column))) for name, (where, column) in edits.items()}
    found = {r["item"] for r in reconcile.seal_violations(result | {"tables": forged}, sealed).collect() if r["rule"] == "digest after the run changed"}
    assert found == {*edits, "catalog"}
    other = result | {"plan": result["plan"].withColumn("reason", F.lit("else")), "decisions": result["decisions"].withColumn("source_snapshot", F.col("source_snapshot").withField("name", F.lit("!")))}
    found = {(r["item"], r["rule"]) for r in reconcile.seal_violations(other, sealed).collect()}
    assert found == {("plan", "digest after the run changed"), ("decisions", "digest after the run changed"), ("decisions", "source snapshot changed")}
    # A receipt that no longer leads back to the baseline.
    lost = result | {"receipts": result["receipts"] | {"alias": result["receipts"]["alias"].where("change <> 'removed'")}}
    assert ("alias", "baseline digest not reached") in {(r["item"], r["rule"]) for r in reconcile.seal_violations(lost, sealed).collect()}
    with pytest.raises(ValueError, match="baseline"):
        reconcile.restore_proved(lost, sealed)
