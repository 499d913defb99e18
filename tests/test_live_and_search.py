"""Views kept up to date, documents of any size, search by postings."""

import json
import random

import pytest
from pyspark.sql import functions as F

from dispensary.operators import bundle, deid, report, store
from dispensary.schemas import PATIENTS
from dispensary.sources import sinks
from dispensary.sources.buckets import BucketTable
from dispensary.sources.documents import read_items, write_document
from dispensary.sources.postings import SearchIndex, pieces
from dispensary.streaming.live import VISIT_CHANGES, LiveReport, add_cells, annotation_table, live_annotations, start_annotations
from tests.test_records import NOW, encounters, patients


def test_annotations_take_back(spark, tmp_path):
    """Deletions, drafts that become final, stale and repeated versions, moves there and back, in batches of any order."""
    r, newest, view = random.Random(7), {}, annotation_table(spark, str(tmp_path / "view"), buckets=4)
    at = 100
    for batch in range(4):
        rows = []
        for _ in range(25):
            id_, at = f"v{r.randrange(12)}", at + 1
            old = newest.get(id_)
            stale = old is not None and r.random() < 0.2
            patient = old[1] if old and r.random() < 0.7 else f"p{r.randrange(4)}"
            row = (id_, patient, r.randrange(60), r.choice(("draft", "final", "final")), at - (500 if stale else 0), 1 if r.random() < 0.3 else None, old[1] if old and old[1] != patient else None)
            if stale:
                row = (*row[:1], old[1], *row[2:6], None)
            else:
                newest[id_] = row
            rows.append(row)
        rows += rows[:3]
        r.shuffle(rows)
        spark.createDataFrame(rows, VISIT_CHANGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        start_annotations(spark.readStream.schema(VISIT_CHANGES).parquet(str(tmp_path / "in")), view, str(tmp_path / "checkpoint")).awaitTermination()
        now = spark.createDataFrame(list(newest.values()), VISIT_CHANGES)
        assert sorted(map(str, live_annotations(view, 30).collect())) == sorted(map(str, store.annotations(now, 30).collect())), batch


def test_report_by_differences(spark, tmp_path):
    r = random.Random(3)
    july = 1656633600000
    people, visits = {}, {}
    kept = None
    for batch in range(3):
        changed_people = [{"id": f"p{r.randrange(6)}", "sex": r.choice(("male", "female", "unknown")), "approximateAge": r.randrange(70), "updatedAt": batch, **({"deletedAt": 1} if r.random() < 0.2 else {})} for _ in range(4)]
        changed_people = list({x["id"]: x for x in changed_people}.values())
        changed = [{"id": f"e{r.randrange(20)}", "patientId": f"p{r.randrange(7)}", "occurredAt": july + r.randrange(60) * 86400000, "diagnosis": r.choice(("palu", "tb", "x")), "status": r.choice(("draft", "final", "final")), "updatedAt": batch, **({"deletedAt": 1} if r.random() < 0.2 else {})} for _ in range(12)]
        changed = list({x["id"]: x for x in changed}.values())
        people |= {x["id"]: x for x in changed_people}
        visits |= {x["id"]: x for x in changed}
        p, e = patients(spark, *changed_people), encounters(spark, *changed)
        kept = kept or LiveReport(spark, str(tmp_path / "r"), p.schema, e.schema, 2022, 7, buckets=4)
        kept.merge(p, e, "s", batch)
        kept.merge(p, e, "s", batch)  # a replay
        kept.drop_old(1)
        want = report.aggregate_month(store.live(patients(spark, *people.values())), store.live(encounters(spark, *visits.values())), 2022, 7)
        columns = ["indicator", "ageBand", "sex", "count"]
        assert sorted(map(tuple, kept.cells().select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    nothing = kept.cells().limit(0)
    assert add_cells(nothing, nothing).count() == 0


def test_bundle_is_one_document(spark, tmp_path):
    p = patients(spark, *[{"id": f"p{k}", "approximateAge": k} for k in range(5)], {"id": "gone", "deletedAt": 1})
    drug = {"id": "r", "drug": 'a "quoted"\n drug'}
    e = encounters(spark, *[{"id": f"e{k:02}", "patientId": f"p{k % 5}", "vitals": {"pulse": 80, "systolic": 120}, "prescriptions": [drug], "diagnosis": "]}\n,{"} for k in range(30)])
    at = str(tmp_path / "bundle.json")
    sinks.write_bundle(p.repartition(3), e.repartition(7), NOW, at)
    doc = json.loads((tmp_path / "bundle.json").read_text())
    rows = bundle.bundle_entries(store.live(p), store.live(e), NOW).orderBy(*bundle.BUNDLE_ORDER).collect()
    assert [x["resource"] for x in doc["entry"]] == [json.loads(x.json) for x in rows] and len(rows) == 5 + 30 * 4
    assert doc["resourceType"] == "Bundle" and doc["timestamp"] == "2024-01-01T00:00:00.000Z"
    assert [x.name for x in tmp_path.iterdir() if not x.name.startswith(".")] == ["bundle.json"]
    sinks.write_bundle(p.limit(0), e.limit(0), NOW, at)  # in its place
    assert json.loads((tmp_path / "bundle.json").read_text())["entry"] == []


def test_dump_is_one_document(spark, tmp_path):
    p = patients(spark, {"id": "p2"}, {"id": "p1", "phone": "é\n"}, {"id": "p3", "deletedAt": 1})
    e = encounters(spark, {"id": "e1", "vitals": {"pulse": 80}}, {"id": "e0", "deletedAt": 2})
    at = str(tmp_path / "dump.json")
    sinks.write_dump_document(p, e, deid.deidentify(p, e, "identified", NOW)[2], "2024-01-01T00:00:00Z", "note", at)
    doc = json.loads((tmp_path / "dump.json").read_text())
    assert [x["id"] for x in doc["patients"]] == ["p1", "p2"] and [x["id"] for x in doc["encounters"]] == ["e1"]
    assert doc["deidentification"]["level"] == "identified" and doc["schemaVersion"] == 1
    back_p, back_e = sinks.read_dump_document(spark, at)
    assert sorted(map(str, back_p.collect())) == sorted(map(str, store.live(p).collect())) and [r.vitals.pulse for r in back_e.collect()] == [80.0]
    write_document(spark, str(tmp_path / "none.json"), "{}", {"a": (spark.range(0), F.to_json(F.struct("id")), ["id"])})
    assert json.loads((tmp_path / "none.json").read_text()) == {"a": []}
    assert read_items(spark, str(tmp_path / "none.json"), "id", "id long").count() == 0


@pytest.mark.parametrize("query", ["ra", "", "rab", "rabe soa", "abea", "aaaa", "zzz", "%_a", "ésoa", "soa 03", "a" * 40])
def test_search_by_postings(spark, tmp_path, query):
    r = random.Random(5)
    rows = [(f"p{k}", " ".join(r.choice(("rabe", "soa", "rabea", "aaaa" * r.randrange(1, 4), "l%_ala")) for _ in range(3)), f"03{k}", r.randrange(9), 1 if k % 7 == 0 else None) for k in range(60)]
    p = spark.createDataFrame(rows, "id string, familyName string, phone string, updatedAt long, deletedAt long").unionByName(spark.createDataFrame([], PATIENTS), allowMissingColumns=True)
    p = store.with_search_key(p.select([c.split()[0] for c in PATIENTS.replace("\n", " ").split(",")]))
    table = BucketTable(spark, str(tmp_path / "p"), p.schema, buckets=8)
    table.write(p)
    index = SearchIndex(spark, str(tmp_path / "i"), table, buckets=8)
    index.build()
    for limit in (3, 50):
        assert [x.id for x in index.search(query, limit).collect()] == [x.id for x in store.search_patients(p, query, limit).collect()]


def test_postings_follow_changes_and_open_few_buckets(spark, tmp_path):
    p = store.with_search_key(patients(spark, *[{"id": f"p{k}", "familyName": f"NAME{k:03}", "givenName": None} for k in range(100)]))
    table = BucketTable(spark, str(tmp_path / "p"), p.schema, buckets=16)
    table.write(p)
    index = SearchIndex(spark, str(tmp_path / "i"), table, buckets=16)
    index.build()
    assert len(index.search("e042").inputFiles()) == 1 and [x.id for x in index.search("e042").collect()] == ["p42"]
    before = table.lookup("p42")
    after = store.with_search_key(before.withColumn("familyName", F.lit("OTHER")))
    index.update(before, after)
    table.change(after, lambda rows: rows.filter("id <> 'p42'").unionByName(after))
    assert index.search("e042").count() == 0 and [x.id for x in index.search("other").collect()] == ["p42"]
    index.update(table.lookup("p42"), table.lookup("p42").withColumn("deletedAt", F.lit(5).cast("long")))
    assert index.candidates("other").count() == 0
    assert spark.range(1).select(pieces(F.lit("abab"))).first()[0] == ["aba", "bab"] and spark.range(1).select(pieces(F.lit("ab"))).first()[0] == []


def test_a_patient_of_many_visits_is_dealt(spark, tmp_path):
    """Its visits are in many buckets, and few rows leave the tasks that sum them up."""
    from dispensary.streaming.live import VISITS, annotations_of, visit_sides

    rows = [(f"v{k}", "p1", k, "final", 1, None, "p2") for k in range(400)]
    sides = visit_sides(spark.createDataFrame(rows, VISIT_CHANGES))
    assert sides.filter("patientId = 'p1'").select("part").distinct().count() == 8 and sides.count() == 800
    got = {r.patientId: tuple(r)[1:] for r in annotations_of(sides.select([c.split()[0] for c in VISITS.split(", ")])).collect()}
    assert got == {"p1": (399, False, 400), "p2": (None, False, 0)}


def test_parts_of_a_document_are_compressed(spark, tmp_path):
    from dispensary.sources.documents import _parts

    _parts(spark.range(2000), F.to_json(F.struct("id", F.repeat(F.lit("x"), F.lit(50)).alias("said"))), ["id"], str(tmp_path / "parts"))
    assert sum(f.stat().st_size for f in (tmp_path / "parts").glob("part-*")) * 5 < 2000 * 70
    write_document(spark, str(tmp_path / "d.json"), '{"a":1}', {"b": (spark.range(50).repartition(7), F.to_json(F.struct("id")), ["id"]), "c": (spark.range(0), F.to_json(F.struct("id")), ["id"])})
    assert json.loads((tmp_path / "d.json").read_text()) == {"a": 1, "b": [{"id": k} for k in range(50)], "c": []}


def test_report_by_differences_of_joined_changes(spark, tmp_path):
    """Changes that come sorted and dealt by id, from a join as in larger tables."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    july = 1656633600000
    p = patients(spark, *[{"id": f"p{k}", "sex": "male", "approximateAge": k, "updatedAt": 0} for k in range(20)]).repartition(3)
    e = encounters(spark, *[{"id": f"e{k}", "patientId": f"p{k % 20}", "occurredAt": july, "diagnosis": "palu", "status": "draft" if k % 5 == 0 else "final", "updatedAt": 0} for k in range(300)]).repartition(3)
    later = e.filter(F.substring("id", 2, 9).cast("int") % 3 == 0)
    later = later.drop("status").join(later.select("id", F.lit("final").alias("status")), "id").select(e.columns).withColumns({"updatedAt": F.lit(1).cast("long"), "deletedAt": F.when(F.substring("id", 2, 9).cast("int") % 2 == 0, 5).cast("long")})
    kept = LiveReport(spark, str(tmp_path / "r"), p.schema, e.schema, 2022, 7, buckets=4)
    try:
        for k in held:
            spark.conf.set(k, "-1" if "Threshold" in k else "false")
        kept.merge(p, e, "s", 0)
        kept.merge(p.filter("id = 'p1'").withColumn("sex", F.lit("female")).withColumn("updatedAt", F.lit(1).cast("long")), later, "s", 1)
        columns = ["indicator", "ageBand", "sex", "count"]
        want = report.aggregate_month(store.live(kept.patients.read()), store.live(kept.encounters.read()), 2022, 7)
        assert sorted(map(tuple, kept.cells().select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_bundle_entries_are_written_and_parsed_once(spark):
    """Neither in a filter beside the column, nor inside a list, where no code is generated."""
    from dispensary.plans import catalog

    plan = catalog.bundle_json(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("\n")
    assert any("from_json" in x for x in plan) and not any("from_json" in x for x in plan if "Filter" in x.split("(")[0])
    p, e = patients(spark, {"id": "p1"}), encounters(spark, {"id": "e1", "vitals": {"pulse": 80}})
    plan = bundle.bundle_entries(p, e, NOW)._jdf.queryExecution().executedPlan().toString().split("\n")
    assert any("StructsToJson" in x for x in plan) and not any("StructsToJson" in x for x in plan if "explode(" in x)


def test_a_stored_log_is_read_from_its_files(spark, tmp_path):
    """A fold that reads it several times does not derive it again."""
    from dispensary.operators import patches

    log = spark.createDataFrame([("e1", 1, 5, "patch", {"notes": "x"}, ["diagnosis"], None), ("e1", 2, 6, "attach", None, [], "a")], patches.ENCOUNTER_PATCHES)
    kept = patches.stored_log(log, str(tmp_path / "log"))
    assert kept.schema == log.schema and sorted(map(str, kept.collect())) == sorted(map(str, log.collect()))
    e = encounters(spark, {"id": "e1", "notes": "n", "diagnosis": "d"})
    plan = patches.patch_encounters(e, kept)._jdf.queryExecution().optimizedPlan().toString()
    assert all("/log" in f for f in kept.inputFiles()) and "LocalRelation" not in plan.replace("LogicalRDD", "")
    assert [(r.notes, r.diagnosis, r.attachmentIds) for r in patches.patch_encounters(e, kept).collect()] == [("x", None, ["a"])]


def test_document_of_joined_parts(spark, tmp_path, monkeypatch):
    """One gzip file that holds the plain document's text and is read between its seams by many tasks; the list is never written plain."""
    import gzip

    from dispensary.sources import documents

    monkeypatch.setattr(documents, "ITEMS", 40)
    said = F.concat(F.col("id").cast("string"), F.lit("é\n,{]} "), F.repeat(F.lit("x"), F.lit(90)))
    lists = {"b": (spark.range(2000).repartition(7), F.to_json(F.struct("id", said.alias("said"))), ["id"]), "none": (spark.range(0), F.to_json(F.struct("id")), ["id"]), "c": [(spark.range(k, k + 3), F.to_json(F.struct(F.col("id").alias("n"))), ["id"]) for k in (5, 1)]}
    for name in ("d.json", "d.json.gz-joined"):
        write_document(spark, str(tmp_path / name), '{"a":"é"}', lists)
    packed = (tmp_path / "d.json.gz-joined").read_bytes()
    assert gzip.decompress(packed) == (tmp_path / "d.json").read_bytes() and len(packed) * 4 < (tmp_path / "d.json").stat().st_size
    doc = json.loads(gzip.decompress(packed))
    assert [x["id"] for x in doc["b"]] == list(range(2000)) and doc["b"][7]["said"].startswith("7é\n,{]} x") and doc["none"] == [] and [x["n"] for x in doc["c"]] == [5, 6, 7, 1, 2, 3] and doc["a"] == "é"
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("777", "100", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = read_items(spark, str(tmp_path / "d.json.gz-joined"), "id", "id long, said string")
            assert sorted((x.id, x.said) for x in rows.collect()) == [(x["id"], x["said"]) for x in doc["b"]]
            assert size == "128m" or len({x.p for x in rows.select(F.spark_partition_id().alias("p")).collect()}) > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert [x.n for x in read_items(spark, str(tmp_path / "d.json.gz-joined"), "n", "n long").orderBy("n").collect()] == [1, 2, 3, 5, 6, 7]
    with pytest.raises(EOFError):
        list(documents._inflated(gzip.compress(b"cut off" * 99)[:-3]))


def test_bundle_sorts_records_not_entries(spark, tmp_path, monkeypatch):
    from dispensary.sources import documents

    p = patients(spark, *[{"id": f"p{k % 5}", "phone": "é"} for k in range(5)]).repartition(3)
    e = encounters(spark, *[{"id": f"e{k:02}", "patientId": f"p{k % 5}", "vitals": {"pulse": 80, "height": 99, "systolic": 120}, "prescriptions": [{"id": f"r{i}", "drug": "a\n"} for i in range(k % 3)], "status": "draft" if k % 7 == 0 else "final"} for k in range(30)]).repartition(7)
    plans, parts = [], documents._parts
    monkeypatch.setattr(documents, "_parts", lambda rows, item, order, path: (plans.append((rows, order)), parts(rows, item, order, path)))
    sinks.write_bundle(p, e, NOW, str(tmp_path / "b.json"))
    doc = json.loads((tmp_path / "b.json").read_text())
    want = bundle.bundle_entries(store.live(p), store.live(e), NOW).orderBy(*bundle.BUNDLE_ORDER).collect()
    assert [(x["fullUrl"], x["resource"]) for x in doc["entry"]] == [(x.fullUrl, json.loads(x.json)) for x in want] and len(want) > 100
    for rows, order in plans:  # the sort comes before the JSON is made
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert order == [] and "urn:uuid:" in plan[: plan.index("Sort ")] and "urn:uuid:" not in plan[plan.index("Sort ") :]


def test_queries_leave_compressed_documents(spark, tmp_path, monkeypatch):
    import gzip

    from dispensary.plans import catalog

    monkeypatch.setattr(catalog, "scratch", lambda _: str(tmp_path))
    for query in (catalog.dump_document, catalog.bundle_document):
        query(spark, "/root/testdata/sf0.001").count()
    files = [f for f in tmp_path.iterdir() if not f.name.startswith(".")]
    assert len(files) == 2
    for f in files:
        text = gzip.decompress(f.read_bytes())
        json.loads(text)
        assert f.stat().st_size * 4 < len(text)


def test_lines_of_a_document_are_parsed_once(spark, tmp_path):
    at = str(tmp_path / "d.json.gz-joined")
    write_document(spark, at, "{}", {"a": (spark.range(9), F.to_json(F.struct("id", F.lit("x").alias("b"))), ["id"])})
    rows = read_items(spark, at, "id", "id long, b string").filter("b = 'x'").select("id", "b")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.count() == 9 and plan.count("Generate explode") == 1 and "Filter" in plan[: plan.index("Generate explode")]
