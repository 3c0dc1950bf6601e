"""Courses added from retained evidence inside a batch, with inventories kept by running sums."""

import json

import pytest
from pyspark.sql import functions as F

from placewright.functions import canon
from placewright.operators import changes, retained
from placewright.sources import catalog
from placewright.streaming import intake


def uid(prefix, n):
    return f"{prefix}-00000000-0000-4000-8000-{n:012d}"


F1, F2 = uid("f", 1), uid("f", 2)
KIND = intake.CHANGE.replace("batch_id string, ", "") + f", retained struct<{', '.join(f.replace(' ', ':', 1) for f in retained.EVIDENCE.split(', '))}>"
CORE = ("s-2", "2026-02-03", "confirmed", None, None, None, None)


@pytest.fixture
def stored(spark, tmp_path):
    root = str(tmp_path / "catalog")
    courses = [(uid("c", 99), F1, "Baseline", 9, "needs_review", "inherit", None), (uid("c", 98), F2, "Elsewhere", 18, "needs_review", "inherit", None)]
    support = [(["physical_holes"], "s-1", ["n-1"]), (["access"], "s-2", ["n-9"]), (["name"], None, ["n-1"])]
    catalog.create(spark, root, {
        "facility": spark.createDataFrame([(F1, "One", "US", 27, None), (F2, "Two", "US", 18, None)], "facility_id string, name string, country string, physical_holes int, inventory_complete boolean"),
        "course": spark.createDataFrame(courses, "course_id string, facility_id string, name string, physical_holes int, identity_status string, address_mode string, game_kind string"),
        "source": spark.createDataFrame([("s-1", "https://kept.example.com/", "retained_only"), ("s-2", "https://ok.example.com/", "permitted")], "source_id string, url string, intake_policy string"),
        "retained_evidence": spark.createDataFrame([(F1, ["n-1", "n-2"], support, ["s-1"])], retained.TABLES["retained_evidence"]),
        "note": spark.createDataFrame([("n-1", "three nines"), ("n-2", "else")], "note_id string, body string"),
    })
    return root


def digest(spark, root, table, key, identifier):
    return changes.row_digests(catalog.load(spark, root)[table], key).where(F.col("id") == identifier).first()["digest"]


@pytest.fixture
def guards(spark, stored):
    d = lambda *x: digest(spark, stored, *x)
    return {
        "facility_id": F1, "facility_digest": d("facility", "facility_id", F1), "retained_evidence_digest": d("retained_evidence", "facility_id", F1),
        "note_digests": {"n-1": d("note", "note_id", "n-1")}, "support_indexes": [0, 2], "source_digests": {"s-1": d("source", "source_id", "s-1")},
        "review_reference": "review/1", "course_inventory_digests": {uid("c", 99): d("course", "course_id", uid("c", 99))},
    }


def added(n, guards, name="Great 9", holes=9, **values):
    row = {"facility_id": F1, "name": name, "physical_holes": holes, "identity_status": "operator_defined", "game_kind": "golf", "address_mode": "inherit", **values}
    return ("course", uid("c", n), None, json.dumps(row), *(None,) * 7, guards)


def run(spark, root, *rows, name="b-1", apply=True):
    holds = spark.createDataFrame([("publisher", "held.example")], "kind string, scope_key string")
    batch = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], KIND)
    return catalog.apply_batch(spark, root, name, batch, holds, apply=apply)


def test_several_courses_join_a_guarded_inventory(spark, stored, guards):
    rows = [added(10, guards), added(11, guards, None, None)]
    assert run(spark, stored, *rows, apply=False)["state"] == "preview" and catalog.current_version(spark, stored) == 1
    report = run(spark, stored, *rows)
    assert (report["state"], report["added"], report["updated"]) == ("applied", 2, 0), report
    assert run(spark, stored, *rows)["state"] == "already_applied"
    now = catalog.load(spark, stored)
    found = {r["course_id"]: r for r in now["course"].collect()}
    assert len(found) == 4 and found[uid("c", 11)]["name"] is None and found[uid("c", 10)]["physical_holes"] == 9
    ledger = now["intake_evidence"].collect()
    # The third support names no source, so none is named for the whole.
    assert {(r["source_id"], r["collected_on"], r["origin"], r["status"]) for r in ledger} == {(None, None, "retained_normalization", "extracted")}
    payload = json.loads(ledger[0]["payload"])
    assert payload["retained"]["course_inventory_digests"] == guards["course_inventory_digests"] and len(payload["original_support"]) == 2


def test_every_guard_at_its_place_in_one_batch(spark):
    """One facility per case, all in one batch, so that no case may change another's."""
    n = 16
    f, c = (lambda k: uid("f", k)), (lambda k: uid("c", 900 + k))
    support = [(["physical_holes"], "s-1", ["n-1"]), (["access"], "s-2", ["n-9"]), (["name"], None, ["n-1"])]
    tables = {
        "facility": spark.createDataFrame([(f(k), f"F{k}", 27) for k in range(n)], "facility_id string, name string, physical_holes int"),
        "course": spark.createDataFrame([(c(k), f(k), f"C{k}") for k in range(n) if k != 12], "course_id string, facility_id string, name string"),
        "source": spark.createDataFrame([("s-1", "https://kept.example.com/", "retained_only"), ("s-2", "https://ok.example.com/", "permitted")], "source_id string, url string, intake_policy string"),
        "retained_evidence": spark.createDataFrame([(f(k), ["n-1", "n-2"], support, ["s-1"]) for k in range(n)], retained.TABLES["retained_evidence"]),
        "note": spark.createDataFrame([("n-1", "three nines"), ("n-2", "else")], "note_id string, body string"),
    }
    key = {"facility": "facility_id", "course": "course_id", "source": "source_id", "retained_evidence": "facility_id", "note": "note_id"}
    now = {t: {r["id"]: r["digest"] for r in changes.row_digests(rows, key[t]).collect()} for t, rows in tables.items()}
    renamed = {r["id"]: r["digest"] for r in changes.row_digests(tables["course"].withColumn("name", F.lit("Changed")), "course_id").collect()}
    rows, wanted = [], []

    def guards(k, **other):
        return {
            "facility_id": f(k), "facility_digest": now["facility"][f(k)], "retained_evidence_digest": now["retained_evidence"][f(k)],
            "note_digests": {"n-1": now["note"]["n-1"]}, "support_indexes": [0, 2], "source_digests": {"s-1": now["source"]["s-1"]},
            "review_reference": "review/1", "course_inventory_digests": {c(k): now["course"][c(k)]} if k != 12 else None, **other,
        }

    def add(k, rule=None, values=None, core=(None,) * 7, **other):
        given = {"facility_id": f(k), "name": "Great 9", "physical_holes": 9, "identity_status": "operator_defined", "game_kind": "golf", "address_mode": "inherit", **(values or {})}
        wanted.append((len(rows), rule))
        rows.append(("course", uid("c", len(rows)), None, json.dumps(given), *core, guards(k, **other)))

    def update(entity, k, values):
        identifier = f(k) if entity == "facility" else c(k)
        wanted.append((len(rows), None))
        rows.append((entity, identifier, now[entity][identifier], json.dumps(values), *CORE, None))

    change = {"name": "Changed"}
    add(0), add(0)  # the plain case
    update("course", 1, change), add(1, "complete inventory guard required"), add(1, "complete inventory guard required")
    add(2), update("course", 2, change), add(2, "complete inventory guard required", course_inventory_digests={c(2): renamed[c(2)]})
    add(3), update("course", 3, change)  # found at the end
    wanted.append((None, "retained course inventory changed during the batch"))
    wanted.append((None, "retained course inventory changed during the batch"))
    wanted.append((None, "retained course inventory changed during the batch"))
    add(4, "complete inventory guard required", course_inventory_digests={})
    add(5), add(5, "complete inventory guard required", course_inventory_digests={c(5): now["course"][c(5)], uid("c", len(rows) - 1): "0" * 64})
    add(6, "single course needs an empty inventory", course_inventory_digests=None)
    add(7, "cannot promote other fields", values={"access": "public"})
    add(8, "invalid layout name or holes", values={"physical_holes": -1})
    add(9, "stale or unrelated source", source_digests={"s-1": "0"})
    add(10, "complete support required", support_indexes=[0])
    update("facility", 11, {"physical_holes": 36}), add(11, "stale facility guard")
    # An empty inventory takes one course of the facility's own holes, and then is empty no more.
    add(12, values={"name": "F12", "physical_holes": 27}), add(12, "single course needs an empty inventory", values={"name": "F12", "physical_holes": 27})
    add(13), update("facility", 13, {"physical_holes": 36})  # was current when it was used
    add(14, "invalid retained evidence", core=CORE)
    wanted.append((len(rows), "retained evidence only adds a missing course"))
    rows.append(("facility", f(15), now["facility"][f(15)], "{}", *(None,) * 7, guards(15)))

    batch = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], KIND)
    live = changes.guarded(batch, tables)
    assert live.where("stale").count() == 0
    after = {t: changes.post_state(tables[t], live.where(F.col("entity") == t), key[t]) for t in ("facility", "course")}
    bad = retained.batch_violations(live, tables, after, tables["source"].where("false").select("source_id")).collect()
    assert sorted(map(repr, {tuple(r) for r in bad})) == sorted(map(repr, {w for w in wanted if w[1]}))


def test_running_sums_against_sums_by_hand(spark):
    rows = [("f", n, s, c, f"{h:064x}") for n, s, c, h in [(3, -1, "a", 5), (3, 1, "a", 9), (12, -1, "b", 2**200), (12, 1, "b", 7), (25, 1, "c", 1)]]
    updates = spark.createDataFrame(rows, "facility_id string, ordinal long, sign int, course_id string, digest string")
    marks = spark.createDataFrame([("f", n) for n in (0, 3, 4, 12, 13, 30)] + [("g", 1)], "facility_id string, ordinal long")
    for block in (5, 100):
        found = {(r["facility_id"], r["ordinal"]): [int(r[n]) for n in canon.LANES] for r in retained.inventory_steps(updates, marks, block=block).collect()}
        for (f, n), lanes in found.items():
            used = [(s, int(h, 16)) for g, k, s, _, h in rows if g == f and k < n]
            wanted = [sum(s for s, _ in used), *[sum(s * (h >> (32 * (7 - k)) & 0xFFFFFFFF) for s, h in used) for k in range(8)]]
            assert lanes == wanted, (f, n, block)
        assert len(found) == 7
