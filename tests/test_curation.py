"""Links, reconciliation, withholding, rules, batches and files on small worlds."""

import json
import random

import pytest
from pyspark.sql import functions as F

from placewright.functions import canon
from placewright.operators import boundary, changes, holds, links, quality, reconcile
from placewright.operators.withhold import withhold
from placewright.sources import catalog, csvfiles, releases
from placewright.streaming import intake


def ids(frame, column):
    return sorted(r[column] for r in frame.collect())


# --- links -------------------------------------------------------------------------------------


def test_only_one_to_one_bindings_match(spark):
    pairs = spark.createDataFrame(
        [("a", "1"), ("b", "2"), ("b", "3"), ("c", "4"), ("d", "4"), ("e", "9")], "released_id string, feature_id string"
    )
    features = spark.createDataFrame([(x,) for x in "1234"], "feature_id string")
    assert [tuple(r) for r in links.one_to_one(pairs, features).select("released_id", "feature_id").collect()] == [("a", "1")]


def test_stored_identity_settles_a_record(spark):
    schema = "facility_id string, osm_identity string, fact_sources array<struct<fields:array<string>,source_url:string>>"
    cite = lambda field, url: [([field], url)]
    rows = spark.createDataFrame(
        [("a", "x", cite("map_location", "d/l.json")), ("b", None, cite("map_location", "d/l.json")), ("c", None, cite("name", "d/l.json"))], schema
    )
    layers = spark.createDataFrame([("l.json", i, "y" + i) for i in "abc"], "file_name string, facility_id string, feature_id string")
    got = {tuple(r) for r in links.candidates(rows, "facility_id", layers).collect()}
    assert got == {("a", "x"), ("b", "yb")}


def test_rekey_leaves_equal_text_alone(spark):
    rows = spark.createDataFrame([("f-1", "f-1", ["c-1", "f-1"])], "facility_id string, name string, course_ids array<string>")
    mapping = spark.createDataFrame([("f-1", "osm/way/1"), ("c-1", "osm/way/2")], "old_id string, new_id string")
    got = links.rekey_list(rows.withColumn("key", F.lit(1)), ["key"], "course_ids", mapping)
    got = links.rekey(got, "facility_id", mapping).first()
    assert (got["facility_id"], got["name"], got["course_ids"]) == ("osm/way/1", "f-1", ["osm/way/2", "osm/way/1"])


# --- reconciliation ----------------------------------------------------------------------------

FIELDS = ["name", "holes"]


def fold(targets, sources):
    """Apply sources one by one, the plain way."""
    conflicts, aliases = [], set()
    for s in sorted(sources, key=lambda s: s["ordinal"]):
        t = targets[s["target"]]
        prefer = s["released_id"] is not None and t["released_id"] is None
        before = t["name"]
        for field in FIELDS:
            value = s[field]
            if value is None or value == "":
                continue
            if t[field] is not None and t[field] != value:
                conflicts.append((s["target"], s["facility_id"], field, str(value), str(t[field]), "source" if prefer else "target"))
            if t[field] is None or prefer:
                t[field] = value
        if s["latitude"] is not None and t["latitude"] is None:
            t["latitude"] = s["latitude"]
        for name in (before, s["name"]):
            if name and name != t["name"]:
                aliases.add((s["target"], name))
    return conflicts, aliases


@pytest.mark.parametrize("block", [3, 1000])
def test_merging_equals_a_sequential_fold(spark, block):
    rng = random.Random(block)
    pick = lambda *v: rng.choice(v)
    row = lambda i: {
        "facility_id": i, "name": pick(None, "", "A", "B", "C"), "holes": pick(None, 9, 18), "released_id": pick(None, i), "latitude": pick(None, 1.0, 2.0),
    }
    targets = {f"t{i}": row(f"t{i}") for i in range(30)}
    for t in targets.values():
        t["name"] = t["name"] or None
    # One target holds a third of all sources.
    sources = [row(f"s{i}") | {"ordinal": i, "target": "t0" if i % 3 == 0 else f"t{rng.randrange(30)}"} for i in range(300)]
    columns = "facility_id string, name string, holes int, released_id string, latitude double"
    plain = [tuple(r[c.split()[0]] for c in columns.split(", ")) for r in [*targets.values(), *sources]]
    rows = spark.createDataFrame(plain, columns).withColumns({"longitude": F.col("latitude"), "location_kind": F.lit("property_point")})
    merges = spark.createDataFrame([(s["ordinal"], s["facility_id"], s["target"]) for s in sources], "ordinal int, source_id string, target_facility_id string")
    merging = reconcile.merge_sources(rows, merges).cache()
    steps = reconcile.merge_steps(rows, merging, FIELDS, block=block).cache()
    conflicts, aliases = fold(targets, sources)
    got = [tuple(r) for r in reconcile.merge_conflicts(steps).select("target_id", "source_id", "field", "source_value", "target_value", "selected").collect()]
    assert sorted(got) == sorted(conflicts)
    none = spark.createDataFrame([], "facility_id string, name string")
    assert {(r["facility_id"], r["name"]) for r in reconcile.merge_aliases(steps, none).collect()} == aliases
    merged = reconcile.merge_scalars(rows, merging, FIELDS).where("facility_id like 't%'").collect()
    assert {r["facility_id"]: (r["name"], r["holes"], r["latitude"]) for r in merged} == {
        k: (t["name"], t["holes"], t["latitude"]) for k, t in targets.items()
    }


def test_receipt_restores_and_detects_tampering(spark):
    before = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, v int")
    after = spark.createDataFrame([("a", 1), ("b", 5), ("d", 4)], "id string, v int")
    record = reconcile.receipt(before, after, "id").cache()
    assert {(r["id"], r["change"]) for r in record.collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}
    back = reconcile.restore(after, record, "id")
    assert canon.table_digest(back).first() == canon.table_digest(before).first()
    assert reconcile.receipt_violations(after, record, "id").count() == 0
    edited = after.withColumn("v", F.when(F.col("id") == "d", 9).otherwise(F.col("v")))
    assert ids(reconcile.receipt_violations(edited, record, "id"), "id") == ["d"]
    forged = record.withColumn("before_row", F.when(F.col("id") == "c", F.struct(F.lit("c").alias("id"), F.lit(7).alias("v"))).otherwise(F.col("before_row")))
    assert ids(reconcile.receipt_violations(after, forged, "id"), "id") == ["c"]


# --- withholding -------------------------------------------------------------------------------


def test_withholding_cascades_but_a_round_outlives_one_member(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    bundle = {
        "facility": make([("f1", "old", None), ("f2", None, None)], "facility_id string, released_id string, osm_identity string"),
        "course": make([("c1", "f1"), ("c2", "f2"), ("c3", None)], "course_id string, facility_id string"),
        "component": make([("p1", "c1"), ("p2", "c2")], "component_id string, course_id string"),
        "round_option": make([("r1", "f1", None), ("r2", "f2", None), ("r3", None, "c1")], "round_id string, facility_id string, course_id string"),
        "round_component": make([("m1", "r2", "p1", None), ("m2", "r2", "p2", None), ("m3", "r3", None, "c2")], "member_id string, round_id string, component_id string, course_id string"),
        "tee_set": make([("t1", None, "r3"), ("t2", "c2", None)], "tee_id string, course_id string, round_id string"),
        "alias": make([("a1", "f1", None), ("a2", None, "c2")], "alias_id string, facility_id string, course_id string"),
        "destination": make([("f1",), ("c1",), ("f2",)], "id string"),
    }
    kept = withhold(bundle, make([("old",)], "id string"))
    want = {
        "facility": ["f2"], "course": ["c2", "c3"], "component": ["p2"], "round_option": ["r2"], "round_component": ["m2"], "tee_set": ["t2"], "alias": ["a2"],
        "destination": ["f2"],
    }
    assert {t: ids(kept[t], kept[t].columns[0] if t == "destination" else [c for c in kept[t].columns if c == {"round_option": "round_id", "round_component": "member_id", "tee_set": "tee_id"}.get(t, t + "_id")][0]) for t in want} == want


# --- rules -------------------------------------------------------------------------------------


def broken(spark, table, **values):
    rows = spark.createDataFrame([(1,)], "id int").select("id", *[F.lit(v).alias(k) for k, v in values.items()])
    return ids(quality.check_rows(rows, table, "id"), "rule")


@pytest.mark.parametrize(
    "table, values, rules",
    [
        ("price_observation", {"amount_kind": "exact", "amount_min": 1.0, "amount_max": 2.0}, ["exact price is one amount"]),
        ("price_observation", {"amount_kind": "range", "amount_min": 3.0, "amount_max": 2.0}, ["amounts in order"]),
        ("price_observation", {"currency": "usd"}, ["currency"]),
        ("price_observation", {"same_day_second_round_required": True, "second_round_required": False}, ["same-day round is a second round"]),
        ("operating_period", {"annual_start_month": 2, "annual_start_day": 30}, ["start day is in the month"]),
        ("operating_period", {"annual_start_month": 2, "annual_start_day": 29}, []),
        ("operating_period", {"opens_minute_of_day": 600, "closes_minute_of_day": 500, "closes_next_day": False}, ["opening window"]),
        ("operating_period", {"opens_minute_of_day": 600, "closes_minute_of_day": 500, "closes_next_day": True}, []),
        ("architecture_event", {"event_year": 1999, "event_month": 2, "event_day": 29}, ["day is in the month"]),
        ("quality_rating", {"score": 5.0, "scale_min": 0.0, "scale_max": 4.0, "issuer_name": "x"}, ["score lies on its scale"]),
        ("tee_set", {"name": "x", "yardage": 100.0, "yardage_unit": "miles", "slope": 156}, ["slope", "yardage_unit"]),
        ("policy_observation", {"cancellation_charge_basis": "full_booking", "cancellation_charge_percent": 5.0}, ["percent only for a percent charge"]),
        ("facility", {"name": "  ", "country": "US", "access": "open"}, ["access", "name"]),
    ],
)
def test_row_rules(spark, table, values, rules):
    assert set(rules) <= set(broken(spark, table, **values)) and (rules or not broken(spark, table, **values))


def test_unknown_values_pass_row_rules(spark):
    rows = spark.createDataFrame([(1, None, None)], "id int, amount_min double, currency string")
    assert quality.check_rows(rows, "price_observation", "id").count() == 0


def test_unique_ignores_unknown_keys(spark):
    rows = spark.createDataFrame([("a", None), ("a", None), ("b", "x"), ("b", "x")], "p string, q string")
    assert [r["id"] for r in quality.check_unique(rows, "t", ["p", "q"]).collect()] == ["b|x"]


# --- boundary and holds ------------------------------------------------------------------------

TEXTS = {
    "Rates at https://club.example.com/fees/2026": (False, False),
    "1 token /30 balls": (True, False),
    "see /mnt/private/proof": (True, True),
    "price /ea; capture: note": (True, True),
    "half/full day": (False, False),
    "C:\\notes\\x": (True, True),
    "\\\\server\\share": (True, True),
    "file:///x": (True, True),
    "https://user:pw@club.example.com/": (True, True),
    "https://user:p\nw@club.example.com/": (True, True),
    "https://club.example.com/?ToKeN=1": (True, True),
    "https://club.example.com/?%74oken=1": (True, True),
    "my_token=1": (False, False),
    "https:/\\user%40x": (True, True),
    "Rates /2025 RATES%2fprivate": (True, True),
}


def test_private_text(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = {
        r["t"]: (r["strict"], r["lenient"])
        for r in rows.select(
            "t", boundary.private_path(F.col("t"), F.lit(False)).alias("strict"), boundary.private_path(F.col("t"), F.lit(True)).alias("lenient")
        ).collect()
    }
    assert got == TEXTS


def test_boundary_follows_paths_and_keys(spark):
    record = {
        "name": "half /full", "extra": "half /full", "optional": {"price_observation": [{"conditions": "each /ea", "id": "/x"}]},
        "components": [{"name": "ok /9"}], "Payload": 1, "a.optional": {"x": "y"},
    }
    rows = spark.createDataFrame([("r", json.dumps(record))], "id string, j string").select("id", F.parse_json("j").alias("v"))
    got = {(r["path"], r["rule"]) for r in boundary.violations(rows, "id", "v", ".courses#").collect()}
    assert got == {
        (".courses#.extra", "private text"), (".courses#.optional.price_observation#.id", "private text"), (".courses#.Payload", "private key"),
    }


def test_records_of_any_depth_are_checked(spark):
    def nested(inside):
        for _ in range(20):
            inside = {"a": [inside]}
        return json.dumps(inside)

    rows = spark.createDataFrame([("ok", nested("fine")), ("bad", nested("see /tmp/x")), ("key", nested({"Token": 1}))], "id string, j string")
    found = boundary.violations(rows.select("id", F.parse_json("j").alias("v")), "id", "v", ".courses#").collect()
    assert {(r["id"], r["rule"]) for r in found} == {("bad", "private text"), ("key", "private key")}
    assert {r["path"].count(".a#") for r in found} == {20}


def test_holds_of_any_depth_are_found(spark):
    inside = {"domains": ["deep.example.com"], "why": "asked"}
    for _ in range(20):
        inside = {"in": [inside]}
    rows = spark.createDataFrame([("c", json.dumps(inside))], "id string, j string").select("id", F.parse_json("j").alias("v"))
    (found,) = holds.hold_scopes(rows, "id", "v").collect()
    assert (found["kind"], found["scope_key"], found["original_scope"]) == ("publisher", "deep.example.com", "deep.example.com")
    assert json.loads(found["control"]) == {"domains": ["deep.example.com"], "why": "asked"}


def test_publisher_holds_cover_subdomains_and_hosts_do_not(spark):
    sources = spark.createDataFrame(
        [("1", "https://a.b.example.com/"), ("2", "https://b.example.com/x"), ("3", "https://xb.example.com/"), ("4", "https://www.h.example.net/"), ("5", "https://s.h.example.net/"), ("6", "http://www.r.example.org/p/../q?x=1")],
        "source_id string, url string",
    )
    in_force = spark.createDataFrame(
        [("publisher", "b.example.com"), ("host", "h.example.net"), ("resource", '[null,"r.example.org",null,"/q","x=1"]')], "kind string, scope_key string"
    )
    assert {(r[0], r[1]) for r in holds.matched_holds(sources, in_force).collect()} == {("1", "publisher"), ("2", "publisher"), ("4", "host"), ("6", "resource")}


# --- files -------------------------------------------------------------------------------------


def test_csv_keeps_unknown_empty_and_odd_texts(spark, tmp_path):
    odd = [None, "", "\u0001", "\u0001x", "\\N", " ", 'a"b', "a\\b", "x\r\ny", "\n", ",", "null", " lead", "trail ", "ü"]
    rows = spark.createDataFrame([(i, t, [t or "-"], i if i % 2 else None) for i, t in enumerate(odd)], "i int, t string, l array<string>, n int")
    kinds = csvfiles.write_rows(rows, str(tmp_path / "csv"))
    assert kinds == {"i": "json", "t": "text", "l": "json", "n": "json"}
    back = csvfiles.read_rows(spark, str(tmp_path / "csv"), kinds, {"i": "int", "l": "array<string>", "n": "int"})
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == sorted(map(tuple, rows.collect()), key=lambda r: r[0])


def test_release_detects_changed_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(100)], "i int, t string")
    path = str(tmp_path / "release")
    releases.write_release(spark, {"rows": rows}, path)
    assert releases.restore(spark, path)[1].count() == 0
    rows.where("i = 0").write.mode("append").parquet(path + "/rows")
    assert [r["name"] for r in releases.restore(spark, path)[1].collect()] == ["rows"]


# --- batches -----------------------------------------------------------------------------------


def uid(prefix, n):
    return f"{prefix}-00000000-0000-4000-8000-{n:012d}"


@pytest.fixture
def stored(spark, tmp_path):
    root = str(tmp_path / "catalog")
    facility = spark.createDataFrame(
        [(uid("f", 1), "One", "US", "public", 18, None), (uid("f", 2), "Two", "US", None, None, None)],
        "facility_id string, name string, country string, access string, physical_holes int, inventory_complete boolean",
    )
    course = spark.createDataFrame(
        [(uid("c", 1), uid("f", 1), "North", 9, "needs_review", "inherit")],
        "course_id string, facility_id string, name string, physical_holes int, identity_status string, address_mode string",
    )
    source = spark.createDataFrame(
        [("s-1", "https://ok.example.com/", None, None, "permitted", None), ("s-2", "https://held.example.org/", None, None, "permitted", None)],
        "source_id string, url string, license string, attribution string, intake_policy string, controls_reference string",
    )
    catalog.create(spark, root, {"facility": facility, "course": course, "source": source})
    return root


def digest_of(spark, root, table, key, identifier):
    return changes.row_digests(catalog.load(spark, root)[table], key).where(F.col("id") == identifier).first()["digest"]


def batch(spark, *rows, source="s-1"):
    full = [
        (i, entity, identifier, expected, json.dumps(values), source, "2026-02-03", "confirmed", None, None, None, None)
        for i, (entity, identifier, expected, values) in enumerate(rows)
    ]
    return spark.createDataFrame(full, intake.CHANGE.replace("batch_id string, ", ""))


@pytest.fixture
def no_holds(spark):
    return spark.createDataFrame([("publisher", "example.org")], "kind string, scope_key string")


def test_preview_apply_repeat_and_reuse(spark, stored, no_holds):
    old = digest_of(spark, stored, "facility", "facility_id", uid("f", 2))
    rows = batch(
        spark,
        ("facility", uid("f", 2), old, {"access": "private", "physical_holes": 9}),
        ("facility", uid("f", 3), None, {"name": "Three", "country": "US"}),
        ("course", uid("c", 3), None, {"facility_id": uid("f", 3), "name": "South", "identity_status": "needs_review", "address_mode": "inherit"}),
    )
    run = lambda r, apply: catalog.apply_batch(spark, stored, "b-1", r, no_holds, apply=apply)
    preview = run(rows, False)
    assert preview["state"] == "preview" and catalog.current_version(spark, stored) == 1
    done = run(rows, True)
    assert (done["state"], done["added"], done["updated"], done["changed_fields"], done["distinct_facilities"]) == ("applied", 2, 1, 2, 2)
    assert catalog.current_version(spark, stored) == 2
    now = {r["facility_id"]: r for r in catalog.load(spark, stored)["facility"].collect()}
    assert now[uid("f", 2)]["access"] == "private" and now[uid("f", 2)]["name"] == "Two" and len(now) == 3
    assert len(catalog.load(spark, stored, 1)["facility"].collect()) == 2
    assert run(rows, True)["state"] == "already_applied" and catalog.current_version(spark, stored) == 2
    with pytest.raises(ValueError):
        run(batch(spark, ("facility", uid("f", 9), None, {"name": "Nine", "country": "US"})), True)


@pytest.mark.parametrize(
    "change, source, state, reason",
    [
        (("facility", uid("f", 2), "stale", {"access": "private"}), "s-1", "conflicted", None),
        (("facility", uid("f", 5), None, {"name": " one ", "country": "US"}), "s-1", "conflicted", None),
        (("facility", uid("f", 5), None, {"name": "New", "country": "US"}), "s-2", "rejected", "source is not permitted"),
        (("facility", uid("f", 5), None, {"name": "New", "country": "US", "access": "open"}), "s-1", "rejected", "facility: access"),
        (("facility", uid("f", 5), None, {"country": "US"}), "s-1", "rejected", "facility: name required"),
        (("facility", "f-5", None, {"name": "New", "country": "US"}), "s-1", "rejected", "stable id required"),
        (("facility", uid("c", 5), None, {"name": "New", "country": "US"}), "s-1", "rejected", "incorrect id prefix"),
        (("facility", uid("f", 5), None, {"name": 5, "country": "US"}), "s-1", "rejected", "name must be text"),
        (("quality_rating", uid("q", 5), None, {}), "s-1", "rejected", "quality ratings are deferred"),
        (("course", uid("c", 5), None, {"facility_id": uid("f", 77), "name": "X", "identity_status": "needs_review", "address_mode": "inherit"}), "s-1", "rejected", "course: facility_id in facility"),
    ],
)
def test_refused_batches_change_nothing(spark, stored, no_holds, change, source, state, reason):
    report = catalog.apply_batch(spark, stored, "b-2", batch(spark, change, source=source), no_holds, apply=True)
    assert (report["state"], report.get("reason")) == (state, reason)
    assert catalog.current_version(spark, stored) == 1


def facts(spark, *rows):
    """Changes with any evidence: (entity, id, expected, values, evidence)."""
    names = ["source_id", "collected_on", "status", "observation_id", "origin", "observation_digest", "review_reference"]
    full = [(n, e, i, x, json.dumps(v), *[ev.get(k) for k in names]) for n, (e, i, x, v, ev) in enumerate(rows)]
    return spark.createDataFrame(full, intake.CHANGE.replace("batch_id string, ", ""))


CORE = {"source_id": "s-1", "collected_on": "2026-02-03", "status": "confirmed"}
OBSERVED = {**CORE, "origin": "new_extraction", "conflict": False}


def test_batches_take_observations_and_typed_facts(spark, stored, no_holds):
    seen = {"observation_id": uid("o", 1)}
    rows = facts(
        spark,
        ("source_observation", uid("o", 1), None, OBSERVED, CORE),
        ("amenity_observation", uid("am", 1), None, {**seen, "facility_id": uid("f", 1), "spa_available": True}, seen),
        ("price_observation", uid("pr", 1), None, {**seen, "course_id": uid("c", 1), "amount_min": 20.5, "currency": "USD"}, seen),
        ("design_party", uid("dp", 1), None, {"name": "A. Designer", "party_kind": "person"}, CORE),
        ("architecture_event", uid("ev", 1), None, {**seen, "course_id": uid("c", 1), "event_kind": "design", "event_year": 1999}, seen),
        ("architecture_credit", uid("cr", 1), None, {"event_id": uid("ev", 1), "party_id": uid("dp", 1), "role": "redesign"}, seen),
    )
    report = catalog.apply_batch(spark, stored, "t-1", rows, no_holds, apply=True)
    assert (report["state"], report["added"], report.get("reason")) == ("applied", 6, None)
    now = catalog.load(spark, stored)
    assert now["price_observation"].first()["amount_min"] == 20.5 and now["amenity_observation"].first()["spa_available"] is True
    ledger = {r["entity_id"]: r for r in now["intake_evidence"].collect()}
    assert len(ledger) == 6 and {(r["source_id"], r["collected_on"], r["status"], r["origin"]) for r in ledger.values()} == {("s-1", "2026-02-03", "confirmed", "new_extraction")}
    assert {r["kind"] for r in now["batch_change"].collect()} == {"added"}
    old = digest_of(spark, stored, "price_observation", "price_id", uid("pr", 1))
    second = facts(spark, ("price_observation", uid("pr", 1), old, {"amount_min": 30.0}, seen))
    assert catalog.apply_batch(spark, stored, "t-2", second, no_holds, apply=True)["updated"] == 1
    assert catalog.load(spark, stored)["intake_evidence"].count() == 7
    assert catalog.load(spark, stored)["price_observation"].first()["amount_min"] == 30.0


@pytest.mark.parametrize(
    "change, reason",
    [
        (("amenity_observation", uid("am", 2), None, {"observation_id": uid("o", 9), "facility_id": uid("f", 1)}, {"observation_id": uid("o", 8)}), "evidence observation differs from fact"),
        (("amenity_observation", uid("am", 2), None, {"observation_id": uid("o", 9), "facility_id": uid("f", 1)}, CORE), "typed facts need one observation"),
        (("amenity_observation", uid("am", 2), None, {"observation_id": uid("o", 9), "facility_id": uid("f", 1)}, {"observation_id": uid("o", 9)}), "ordinary intake cannot promote retained evidence"),
        (("source_observation", uid("o", 2), None, {**OBSERVED, "collected_on": "2026-02-04"}, CORE), "observation differs from its evidence"),
        (("source_observation", uid("o", 2), None, {**OBSERVED, "origin": "retained_input"}, CORE), "new observations are new extractions"),
        (("amenity_observation", uid("am", 3), None, {"observation_id": uid("o", 7), "facility_id": uid("f", 1), "course_id": uid("c", 1)}, {"observation_id": uid("o", 7)}), "amenity_observation: exactly one subject"),
        (("amenity_observation", uid("am", 3), None, {"observation_id": uid("o", 7), "facility_id": uid("f", 99)}, {"observation_id": uid("o", 7)}), "amenity_observation: facility_id in facility"),
    ],
)
def test_refused_facts(spark, stored, no_holds, change, reason):
    first = ("source_observation", uid("o", 7), None, OBSERVED, CORE)
    report = catalog.apply_batch(spark, stored, "t-3", facts(spark, first, change), no_holds, apply=True)
    assert (report["state"], report.get("reason")) == ("rejected", reason)


def test_a_correction_keeps_its_retained_observation(spark, tmp_path, no_holds):
    root = str(tmp_path / "retained")
    one = spark.createDataFrame([(uid("f", 1), "One", "US")], "facility_id string, name string, country string")
    source = spark.createDataFrame([("s-1", "https://ok.example.com/", "retained_only")], "source_id string, url string, intake_policy string")
    seen = spark.createDataFrame([(uid("o", 1), "s-1", "2020-01-01", "retained", "retained_input", False, uid("f", 1))], "observation_id string, source_id string, collected_on string, status string, origin string, conflict boolean, retained_facility_id string")
    fact = spark.createDataFrame([(uid("am", 1), uid("o", 1), uid("f", 1), True)], "amenity_id string, observation_id string, facility_id string, spa_available boolean")
    catalog.create(spark, root, {"facility": one, "source": source, "source_observation": seen, "amenity_observation": fact})
    guard = digest_of(spark, root, "source_observation", "observation_id", uid("o", 1))
    old = digest_of(spark, root, "amenity_observation", "amenity_id", uid("am", 1))
    review = {"origin": "retained_normalization", "observation_id": uid("o", 1), "observation_digest": guard, "review_reference": "review/7"}
    run = lambda name, evidence: catalog.apply_batch(spark, root, name, facts(spark, ("amenity_observation", uid("am", 1), old, {"spa_available": None}, evidence)), no_holds, apply=True)
    assert run("r-1", {**review, "observation_digest": "0"})["reason"] == "stale observation guard"
    assert run("r-2", review)["state"] == "applied"
    now = catalog.load(spark, root)
    assert now["amenity_observation"].first()["spa_available"] is None
    kept = now["intake_evidence"].first()
    assert (kept["origin"], kept["status"], json.loads(kept["payload"])["original_status"]) == ("retained_normalization", "extracted", "retained")


def test_a_parent_must_come_first(spark, stored, no_holds):
    course = ("course", uid("c", 6), None, {"facility_id": uid("f", 6), "name": "X", "identity_status": "needs_review", "address_mode": "inherit"})
    facility = ("facility", uid("f", 6), None, {"name": "Six", "country": "US"})
    late = catalog.apply_batch(spark, stored, "b-3", batch(spark, course, facility), no_holds)
    assert (late["state"], late["reason"]) == ("rejected", "parent is added later")
    assert catalog.apply_batch(spark, stored, "b-4", batch(spark, facility, course), no_holds)["state"] == "preview"


def test_subjects_do_not_move(spark, stored, no_holds):
    old = digest_of(spark, stored, "course", "course_id", uid("c", 1))
    moved = batch(spark, ("course", uid("c", 1), old, {"facility_id": uid("f", 2)}))
    assert catalog.apply_batch(spark, stored, "b-5", moved, no_holds)["reason"] == "subject identity cannot be moved"


def test_streamed_batches_apply_once(spark, stored, no_holds, tmp_path):
    rows = batch(spark, ("facility", uid("f", 7), None, {"name": "Seven", "country": "US"})).withColumn("batch_id", F.lit("s-b-1"))
    folder = str(tmp_path / "arriving")
    rows.coalesce(1).write.json(folder)
    reports = []

    def run(checkpoint):
        stream = intake.read_changes(spark, folder)
        intake.start(stream, stored, no_holds, str(tmp_path / checkpoint), reports.append).awaitTermination(120)

    run("first")
    run("first")
    run("second")
    assert [r["state"] for r in reports] == ["applied", "already_applied"]
    assert catalog.current_version(spark, stored) == 2


def test_duplicates_are_flagged_without_pairs(spark):
    rows = spark.range(3000).selectExpr("cast(id as string) as id", "case when id < 1000 then ' Same ' when id < 1500 then 'same' else 'n' || id end as name", "'US' as country")
    flagged, members = changes.possible_duplicates(rows, rows.select("id"), "id", ["country"])
    assert flagged.count() == 1500 and members.count() == 1500
    assert flagged.select("others").distinct().collect()[0]["others"] == 1499


def test_a_batch_may_bring_its_source(spark, stored, no_holds):
    rows = batch(spark, ("facility", uid("f", 8), None, {"name": "Eight", "country": "US"}), source="s-9")
    schema = "ordinal int, source_id string, url string, license string, attribution string, controls_reference string"
    good = spark.createDataFrame([(0, "s-9", "https://new.example.com/a", None, None, "review/9")], schema)
    again = spark.createDataFrame([(0, "s-9", "https://ok.example.com:443", None, None, "review/9")], schema)
    held = spark.createDataFrame([(0, "s-9", "https://x.example.org/", None, None, "review/9")], schema)
    run = lambda declared, apply=False: catalog.apply_batch(spark, stored, "b-9", rows, no_holds, apply=apply, declared=declared)
    assert run(again)["reason"] == "already registered" and run(held)["reason"] == "source is held"
    assert run(good, True)["state"] == "applied"
    assert "s-9" in ids(catalog.load(spark, stored)["source"], "source_id")
