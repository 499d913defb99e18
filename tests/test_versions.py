"""Tables in versions, logs of patches, and the feed on top of them."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from dispensary.operators import patches, store, sync
from dispensary.schemas import CHANGES, ENCOUNTERS, PATIENTS, VITALS
from dispensary.sources.buckets import BucketTable
from dispensary.streaming.feed import FOLDERS, Snapshots

ROWS = "id string, n long, text string"


def files_of(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_a_change_touches_its_buckets_only(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), ROWS, buckets=16)
    assert table.read().count() == 0 and table.versions() == []
    rows = spark.createDataFrame([(f"i{k}", k, "x") for k in range(500)], ROWS)
    assert table.write(rows) == 0
    before = files_of(tmp_path)
    touched = spark.createDataFrame([("i7",), ("i8",), ("new",)], "id string")
    bigger = lambda old: old.withColumn("n", F.when(F.col("id").isin("i7", "i8"), F.col("n") + 1000).otherwise(F.col("n"))).unionByName(spark.createDataFrame([("new", -1, "y")], ROWS))
    assert table.change(touched, bigger) == 1
    after = files_of(tmp_path)
    assert all(after[p] == t for p, t in before.items()) and 1 <= len(after) - len(before) <= 3
    assert {r.id: r.n for r in table.read().collect()} == {f"i{k}": k + 1000 * (k in (7, 8)) for k in range(500)} | {"new": -1}
    assert {r.id: r.n for r in table.read(0).collect()} == {f"i{k}": k for k in range(500)}
    assert [r.n for r in table.lookup("i8").collect()] == [1008] and table.lookup("none").count() == 0
    assert len(table.lookup("i8").inputFiles()) == 1
    assert table.change(touched.limit(0), lambda old: old) == 1  # nothing touched, no version


def test_one_of_two_writers_fails(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), ROWS, buckets=4)
    rows = spark.createDataFrame([("a", 1, "x")], ROWS)
    table.write(rows)

    def meanwhile(old):
        BucketTable(spark, str(tmp_path / "t"), ROWS, buckets=4).change(rows, lambda r: r.withColumn("n", F.lit(5).cast("long")))
        return old

    with pytest.raises(Exception, match="v=1.json"):
        table.change(rows, meanwhile)
    assert [r.n for r in table.read().collect()] == [5]


def test_pinned_versions_stay_readable(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), ROWS, buckets=4)
    table.write(spark.createDataFrame([(f"i{k}", 0, "x") for k in range(40)], ROWS))
    one = spark.createDataFrame([("i1",)], "id string")
    with table.pinned() as old:
        for _ in range(6):
            table.change(one, lambda r: r.withColumn("n", F.col("n") + 1))
            table.drop_old(2)
        assert old.agg(F.sum("n")).first()[0] == 0 and table.versions() == [0, 5, 6]
    table.drop_old(1)
    assert table.versions() == [6] and [r.n for r in table.lookup("i1").collect()] == [6]
    assert len(files_of(tmp_path)) <= 4


def test_feed_keeps_a_bounded_number_of_files(spark, tmp_path):
    r, every = random.Random(4), []
    snapshots = Snapshots(spark, str(tmp_path / "s"), keep=2, buckets=4)
    sizes = []
    for batch in range(FOLDERS + 8):
        rows = [("f", batch, k, "patient", f"i{r.randrange(20)}", float(r.randrange(50)), None, "b") for k in range(5)]
        every += rows
        df = spark.createDataFrame(rows, CHANGES).coalesce(1)
        snapshots.merge(df, "s", batch)
        if batch == 9:
            snapshots.merge(df, "s", batch)  # a replay
        sizes.append(len(files_of(tmp_path)))
    whole = spark.createDataFrame(every, CHANGES)
    assert sorted(map(tuple, snapshots.latest().collect())) == sorted(map(tuple, sync.apply_push(whole).collect()))
    assert sorted(map(str, snapshots.conflicts().collect())) == sorted(map(str, sync.conflicts(whole).collect()))
    assert [tuple(x) for x in snapshots.counters().collect()] == [("f", len(every))]
    assert max(sizes) <= 2 * (4 + 1) + FOLDERS + 6 and len(snapshots.versions()) == 2


def in_turn(encounters, log):
    """One entry after the other."""
    e = {x["id"]: x for x in encounters}
    for id_, _, at, op, sets, erase, attachment in sorted(log, key=lambda x: x[1]):
        x = e.get(id_)
        if x is None:
            continue
        if op == "patch":
            sets = sets or {}
            for f in patches.ENCOUNTER_FIELDS:
                if sets.get(f) is not None or f in (erase or ()):
                    x[f] = sets.get(f)
            for v in VITALS:
                new = (sets.get("vitals") or {}).get(v)
                if new is not None or f"vitals.{v}" in (erase or ()):
                    x["vitals"][v] = new
            x["provenance"] |= sets.get("provenance") or {}
        elif op == "finalise":
            x["status"] = "final"
        elif op == "delete":
            x["deletedAt"], x["attachmentIds"] = at, []
        elif op == "attach":
            x["attachmentIds"].append(attachment)
        elif op == "detach":
            x["attachmentIds"] = [a for a in x["attachmentIds"] if a != attachment]
        x["updatedAt"] = at
        if op != "detach":
            x["syncedAt"] = None
    return e


@pytest.mark.parametrize("seed", range(3))
def test_patch_log(spark, seed):
    r = random.Random(seed)
    encounters = [{"id": f"e{k}", "patientId": "p", "notes": "old", "vitals": {v: float(k) for v in VITALS}, "provenance": {"notes": {"source": "voice"}}, "attachmentIds": [f"a{j}" for j in range(k % 4)], "status": "draft", "updatedAt": 1, "syncedAt": 2, "prescriptions": []} for k in range(12)]
    log = []
    for ord_ in range(200):
        op = r.choice(("patch", "patch", "patch", "finalise", "attach", "attach", "detach", *(["delete"] if r.random() < 0.2 else [])))
        sets, erase = None, None
        if op == "patch":
            sets = {f: r.choice((None, f"{f}{ord_}")) for f in ("notes", "diagnosis", "chiefComplaint")} | {"occurredAt": r.choice((None, ord_)), "vitals": r.choice((None, {v: r.choice((None, ord_ * 1.5)) for v in VITALS})), "provenance": r.choice((None, {r.choice(("notes", "diagnosis")): {"source": f"s{ord_}"}}))}
            erase = r.choice((None, [], ["notes", "vitals.pulse"], ["vitals.weight", "nothing"]))
        log.append((r.choice(("e0", "e0", "ghost", f"e{r.randrange(12)}")), ord_, 1000 + ord_, op, sets, erase, f"a{r.randrange(5)}" if op in ("attach", "detach") else None))
    shape = spark.createDataFrame([], ENCOUNTERS).schema
    df = spark.createDataFrame([tuple(x.get(c) for c in shape.names) for x in encounters], shape)
    ld = spark.createDataFrame(log, patches.ENCOUNTER_PATCHES).repartition(5)
    got = {x.id: x.asDict(True) for x in patches.patch_encounters(df, ld).collect()}
    for id_, want in in_turn(encounters, log).items():
        want = dict.fromkeys(shape.names) | want
        want["provenance"] = {k: {"source": None, "confidence": None, "rawText": None} | v for k, v in want["provenance"].items()}
        assert got[id_] == want


def test_patches_of_patients_and_their_encounters(spark):
    p = store.with_search_key(spark.createDataFrame([("p1", "Rabe", "1"), ("p2", "Soa", "2")], "id string, familyName string, phone string").unionByName(spark.createDataFrame([], PATIENTS), allowMissingColumns=True))
    log = spark.createDataFrame([("p1", 1, 10, "update", {"familyName": "ÀB"}, None), ("p1", 2, 11, "update", {"phone": "9"}, ["phone"]), ("p1", 3, 12, "update", None, ["phone"]), ("p2", 4, 13, "delete", None, None)], patches.PATIENT_PATCHES)
    got = {r.id: (r.familyName, r.phone, r.searchKey, r.deletedAt, r.updatedAt) for r in patches.patch_patients(p, log).collect()}
    assert got == {"p1": ("ÀB", None, "ab", None, 12), "p2": ("Soa", "2", "soa 2", 13, 13)}
    e = spark.createDataFrame([("e1", "p2"), ("e2", "p1")], "id string, patientId string")
    own = spark.createDataFrame([("e1", 5, 20, "attach", None, None, "a")], patches.ENCOUNTER_PATCHES)
    all_ = patches.with_deleted_patients(e, own, log)
    assert sorted((r.id, r.ord, r.op) for r in all_.collect()) == [("e1", 4, "delete"), ("e1", 5, "attach")]


def test_timeline_needs_no_shuffle(spark, tmp_path):
    rows = spark.createDataFrame([(f"e{k}", f"p{k % 9}", k * 7 % 50, 1 if k % 5 == 0 else None) for k in range(300)], "id string, patientId string, occurredAt long, deletedAt long")
    table = BucketTable(spark, str(tmp_path / "t"), rows.schema, key="patientId", order=("patientId", "occurredAt"), buckets=8)
    table.write(rows)
    got = store.stored_timeline(table, "p4")
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in store.timeline(rows, "p4").collect()]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "EqualTo(patientId,p4)" in plan and len(got.inputFiles()) == 1
