"""De-identification, changes, sync and export on small hand-made records."""

import json

import pytest
from pyspark.sql import functions as F

from dispensary.functions import clinical as C
from dispensary.operators import bundle, deid, merge, report, store, sync
from dispensary.schemas import CHANGES, ENCOUNTERS, PATIENTS
from dispensary.sources import sinks
from dispensary.streaming.feed import Snapshots, live_last_visit, read_changes, start_feed

NOW = 1704067200000


def patients(spark, *rows):
    base = dict(sex="female", givenName="Voahirana", familyName="RAKOTOARISOA", preferredLang="mg", createdAt=0, updatedAt=0)
    return spark.read.schema(PATIENTS).json(spark.sparkContext.parallelize([json.dumps(base | r) for r in rows]))


def encounters(spark, *rows):
    base = dict(patientId="p1", occurredAt=NOW, vitals={}, prescriptions=[], provenance={}, attachmentIds=[], status="final", createdAt=0, updatedAt=0)
    return spark.read.schema(ENCOUNTERS).json(spark.sparkContext.parallelize([json.dumps(base | r) for r in rows]))


def test_scrub_terms_with_the_mark_in_them(spark):
    """Places are counted, not marks, where a term holds a sign of the mark; marks that were there before are not counted."""
    p = patients(spark, {"id": "1", "familyName": "ab[…]cd", "givenName": None}, {"id": "2", "familyName": "Rabe-Soa", "givenName": None}, {"id": "3", "familyName": "x-Rabe", "givenName": "'nana"})
    texts = ["ab[…]cd et […] ab[…]cd", "[…] x-Rabe-Soa […]", "rabe-soa, X-RABE", "la'nana 'nana", None]
    got = {r.key: (r.text, r.redactions) for r in deid.scrub(spark.createDataFrame(list(enumerate(texts)), "key long, text string"), deid.roster_terms(p)).collect()}
    assert got == {0: ("[…] et […] […]", 2), 1: ("[…] x-[…] […]", 1), 2: ("[…], […]", 2), 3: ("la[…] 'nana", 1), 4: (None, 0)}


@pytest.mark.parametrize(
    ("text", "want", "n"),
    [
        ("vue avec Rakotoarisoa, RAKOTOARISOA", "vue avec […], […]", 2),
        ("Bémanana et bemanana", "[…] et […]", 2),
        ("RAKOTO seul, RAKOTOARISOA aussi", "[…] seul, […] aussi", 2),
        ("tel 034 12 345 67 dossier 12345678", "tel […] dossier […]", 2),
        ("né à Saint-Denis", "né à […]", 1),
        ("Bob est court", "Bob est court", 0),
        ("rien", "rien", 0),
    ],
)
def test_scrub(spark, text, want, n):
    p = patients(spark, {"id": "1"}, {"id": "2", "familyName": "BÉMANANA", "givenName": "Bob"}, {"id": "3", "familyName": "RAKOTO", "address": "Saint-Denis"})
    row = deid.scrub(spark.createDataFrame([(1, text)], "key long, text string"), deid.roster_terms(p)).first()
    assert (row.text, row.redactions) == (want, n)


@pytest.mark.parametrize("digest", [None, 0])
def test_a_text_of_encounters_is_scrubbed_once(spark, monkeypatch, digest):
    """However many encounters say it, in whatever field; texts whose digests are equal don't get each other's changes."""
    scrubbed, seen = deid.scrubbed, []
    monkeypatch.setattr(deid, "scrubbed", lambda rows, *a: (seen.append(rows.count()), scrubbed(rows, *a))[1])
    if digest is not None:
        monkeypatch.setattr(deid, "_digest", lambda text: F.lit(digest).cast("long"))
    p = patients(spark, {"id": "p1"}, {"id": "p2", "familyName": "BÉMANANA", "givenName": None})
    said = ["vu par Bemanana", "Rakotoarisoa et BÉMANANA, dossier 12345678", "rien", None]
    want = ["vu par […]", "[…] et […], dossier […]", "rien", None]
    n = [1, 3, 0, 0]
    rows = [{"id": f"e{i}", "notes": said[i % 4], "diagnosis": said[i % 3], "provenance": {"notes": {"source": "voice", "rawText": said[i % 4]}}, "prescriptions": [{"id": "r", "notes": said[(i + 1) % 4]}, {"id": "s", "notes": said[i % 2]}]} for i in range(60)]
    out, counts = deid.deid_encounters(encounters(spark, *rows, {"id": "e60", "prescriptions": None, "provenance": None}), p, "s", False, strict=True)
    coded = {r.code: r.id for r in spark.createDataFrame([(f"e{i}",) for i in range(61)], "id string").select("id", C.pseudonym(F.col("id"), F.lit("s")).alias("code")).collect()}
    got = {coded[r.id]: r for r in out.collect()}
    for i in range(60):
        r = got[f"e{i}"]
        assert (r.chiefComplaint, r.notes, r.diagnosis, r.provenance["notes"].rawText) == (None, want[i % 4], want[i % 3], want[i % 4])
        assert [(x.id, x.notes) for x in r.prescriptions] == [("r", want[(i + 1) % 4]), ("s", want[i % 2])]
    assert (got["e60"].notes, got["e60"].prescriptions, got["e60"].provenance) == (None, None, None)
    assert {r.id: r.redactions for r in counts.collect()} == {f"e{i}": 2 * n[i % 4] + n[i % 3] + n[(i + 1) % 4] + n[i % 2] for i in range(60)} | {"e60": 0}
    assert seen == [3]
    with pytest.raises(Exception, match="without id"):
        deid.deid_encounters(encounters(spark, {"id": None, "notes": "Rakotoarisoa 12345678"}), p, "s", False)[0].collect()


def test_deidentify_levels(spark):
    p = patients(spark, {"id": "p1", "birthDate": "1920-01-01", "phone": "034", "registerNo": "2041"})
    e = encounters(spark, {"id": "e1", "notes": "patiente RAKOTOARISOA 2041", "provenance": {"notes": {"source": "voice", "rawText": "dossier 2041"}}, "attachmentIds": ["a"]}, {"id": "e2", "patientId": "ghost"})
    out_p, out_e, manifest = deid.deidentify(p, e, "pseudonymous", NOW, "s")
    code = spark.range(1).select(C.pseudonym(F.lit("p1"), F.lit("s")).alias("c")).first().c
    assert code == "KRZCXT39"
    row = out_p.first()
    assert (row.id, row.approximateAge, row.phone, row.birthDate) == (code, 90, None, None)
    got = {r.id: r for r in out_e.collect()}
    assert (got["e1"].patientId, got["e2"].patientId) == (code, "UNKNOWN")
    assert got["e1"].notes == "patiente […] […]" and got["e1"].provenance["notes"].rawText == "dossier […]" and got["e1"].attachmentIds == []
    assert manifest.first().freeTextRedactions == 3
    assert deid.deidentify(p, e, "identified", NOW)[2].first().freeTextRedactions == 0
    codes = {deid.deidentify(p, e, "anonymous", NOW, "s")[0].first().id for _ in range(2)}
    assert len(codes) == 2
    leak = "".join(r.json for r in bundle.bundle_entries(out_p, out_e, NOW).collect())
    assert "RAKOTOARISOA" not in leak and "2041" not in leak


def test_report_ages_are_those_at_the_encounter(spark):
    p = patients(spark, {"id": "p1", "birthDate": "2022-06-01"}, {"id": "p2", "approximateAge": 34})
    at = lambda day: 1659312000000 + day * 86400000  # noqa: E731  August 2022
    e = encounters(spark, {"id": "1", "occurredAt": at(2), "diagnosis": "CHOLÉRA"}, {"id": "2", "patientId": "p2", "occurredAt": at(3), "diagnosis": "éira"}, {"id": "3", "occurredAt": at(4), "status": "draft"}, {"id": "4", "occurredAt": at(40)}, {"id": "5", "patientId": "ghost", "occurredAt": at(5)})
    cells = {(r.indicator, r.ageBand, r.sex): r["count"] for r in report.aggregate_month(p, e, 2022, 8).collect()}
    assert cells == {("consultations", "<1", "female"): 1, ("diarrhoea", "<1", "female"): 1, ("consultations", "15-49", "female"): 1, ("ari", "15-49", "female"): 1, ("consultations", "unknown", "unknown"): 1, ("other", "unknown", "unknown"): 1}


def test_merge_fields_rules(spark):
    p = patients(spark, {"id": "k", "givenName": "", "sex": "unknown", "phone": "1"}, {"id": "d", "givenName": "Noro", "sex": "male", "phone": "2", "birthDate": "2000-01-01", "birthDatePrecision": "estimated"})
    row = merge.merge_fields(spark.createDataFrame([("k", "d")], "keepId string, duplicateId string"), p).first()
    assert (row.filled, row.phone, row.sex, row.birthDatePrecision) == (["givenName", "birthDate", "sex"], "1", "male", "estimated")
    with pytest.raises(ValueError):
        merge.merge_patients(p, encounters(spark, {"id": "e"}), spark.createDataFrame([("k", "k")], "keepId string, duplicateId string"), NOW)


def changes(spark, rows):
    return spark.createDataFrame([("f", push, o, kind, i, float(t), None, "{}") for push, o, kind, i, t in rows], CHANGES)


ROWS = [(0, 0, "encounter", "a", 5), (0, 1, "patient", "b", 5), (1, 0, "encounter", "a", 5), (1, 1, "encounter", "a", 7), (1, 2, "encounter", "", 9), (2, 0, "encounter", "a", 6), (2, 1, "encounter", "c", 1)]


def test_last_write_wins_and_numbers(spark):
    got = {(r.kind, r.id): (r.updatedAt, r.seq) for r in sync.apply_push(changes(spark, ROWS)).collect()}
    assert got == {("patient", "b"): (5.0, 1), ("encounter", "a"): (7.0, 3), ("encounter", "c"): (1.0, 5)}
    assert sorted((r.push, r.serverUpdatedAt) for r in sync.conflicts(changes(spark, ROWS)).collect()) == [(1, 5.0), (2, 7.0)]


def test_stream_equals_batch_and_replays(spark, tmp_path):
    for push in range(3):
        changes(spark, [r for r in ROWS if r[0] == push]).coalesce(1).write.parquet(f"{tmp_path}/in/push={push}")
    whole = {(r.kind, r.id): (r.updatedAt, r.seq) for r in sync.apply_push(changes(spark, ROWS)).collect()}
    snapshots = Snapshots(spark, f"{tmp_path}/state")
    for push in range(3):
        snapshots.merge(spark.read.parquet(f"{tmp_path}/in/push={push}").selectExpr("facilityId", f"cast({push} as long) push", "ord", "kind", "id", "updatedAt", "deletedAt", "body"), "s", push)
    assert {(r.kind, r.id): (r.updatedAt, r.seq) for r in snapshots.latest().collect()} == whole
    snapshots.merge(changes(spark, [r for r in ROWS if r[0] == 2]), "s", 2)  # a replayed batch
    assert {(r.kind, r.id): (r.updatedAt, r.seq) for r in snapshots.latest().collect()} == whole
    changes(spark, ROWS).coalesce(1).write.parquet(f"{tmp_path}/feed")
    streamed = Snapshots(spark, f"{tmp_path}/streamed")
    start_feed(read_changes(spark, f"{tmp_path}/feed"), streamed, f"{tmp_path}/checkpoint").awaitTermination()
    assert {(r.kind, r.id): (r.updatedAt, r.seq) for r in streamed.latest().collect()} == whole


def test_a_new_stream_adds_to_the_store(spark, tmp_path):
    """Another checkpoint starts at batch 0 again; its records are added, and a feed that is read anew changes no record."""
    changes(spark, ROWS).coalesce(1).write.parquet(f"{tmp_path}/a")
    changes(spark, [(9, 0, "patient", "new", 3)]).coalesce(1).write.parquet(f"{tmp_path}/b")
    changes(spark, []).write.parquet(f"{tmp_path}/none")
    store_ = Snapshots(spark, f"{tmp_path}/state")
    for name, checkpoint in (("a", "1"), ("b", "2"), ("a", "3"), ("none", "4")):
        start_feed(read_changes(spark, f"{tmp_path}/{name}"), store_, f"{tmp_path}/checkpoint-{checkpoint}").awaitTermination()
    got = {(r.kind, r.id): r.updatedAt for r in store_.latest().collect()}
    assert got == {("patient", "b"): 5.0, ("encounter", "a"): 7.0, ("encounter", "c"): 1.0, ("patient", "new"): 3.0}
    assert {(r.facilityId, r.value) for r in store_.counters().collect()} == {("f", 13)}


def test_live_last_visit(spark, tmp_path):
    for k, at in enumerate((5, 9, 7)):
        encounters(spark, {"id": str(k), "occurredAt": at}).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(ENCOUNTERS).parquet(f"{tmp_path}/in")
        live_last_visit(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert [r.lastVisit for r in spark.read.parquet(f"{tmp_path}/out/batch=2").collect()] == [9]


def test_report_counts_a_repeated_patient_once(spark):
    p = patients(spark, {"id": "p1", "approximateAge": 3, "updatedAt": 1}, {"id": "p1", "approximateAge": 30, "updatedAt": 2})
    e = encounters(spark, {"id": "1", "occurredAt": 1659312000000, "diagnosis": "palu"})
    assert {(r.indicator, r.ageBand): r["count"] for r in report.aggregate_month(p, e, 2022, 8).collect()} == {("consultations", "15-49"): 1, ("malaria", "15-49"): 1}


def test_search_keys_strip_any_mark(spark):
    p = store.with_search_key(patients(spark, {"id": "1", "familyName": "Kovač Őri", "givenName": "Ḥasan"}))
    assert p.first().searchKey == "kovac ori hasan"


def test_new_records_get_ids(spark):
    new = spark.createDataFrame([("A",), ("B",)], "familyName string")
    ids = [r.id for r in store.create_patients(patients(spark), new, NOW).collect()]
    assert len(set(ids)) == 2 and all(len(i) == 36 for i in ids)


def test_permuted_keys_give_the_same_state(spark):
    moved = sorted(ROWS, key=lambda r: (r[0], r[3], r[1]))
    assert {(r.id, r.updatedAt) for r in sync.apply_push(changes(spark, moved)).collect()} == {(r.id, r.updatedAt) for r in sync.apply_push(changes(spark, ROWS)).collect()}


def test_requests(spark):
    lines = ['{"facilityId":" f ","push":0,"changes":{"patients":[{"id":"b","updatedAt":5},{"id":"","updatedAt":5},{"updatedAt":1}],"encounters":[{"id":"a","updatedAt":6,"deletedAt":6}]}}', "not json", '{"facilityId":"  "}']
    good, bad = sync.parse_requests(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted((r.facilityId, r.kind, r.id, r.deletedAt) for r in good.collect()) == [("f", "encounter", "a", 6), ("f", "patient", "b", None)]
    assert bad.count() == 2


def test_client_keeps_drafts(spark):
    local = encounters(spark, {"id": "1", "status": "draft", "updatedAt": 5}, {"id": "2", "updatedAt": 5}, {"id": "3", "status": "draft", "updatedAt": 9})
    remote = encounters(spark, *[{"id": i, "updatedAt": 7} for i in ("1", "2", "3", "4")])
    got = {r.id: r.outcome for r in sync.client_decisions(local, remote, True).collect()}
    assert got == {"1": "refused", "2": "pulled", "3": "skipped", "4": "pulled"}
    assert {r.id: r.updatedAt for r in sync.client_apply(local, remote, NOW, True).collect()} == {"1": 5, "2": 7, "3": 9, "4": 7}


def test_search_is_literal(spark):
    p = store.with_search_key(patients(spark, {"id": "1", "familyName": "A%B_C", "updatedAt": 1}, {"id": "2", "familyName": "AXBYC", "updatedAt": 2}, {"id": "3", "deletedAt": 1, "familyName": "A%B"}))
    assert [r.id for r in store.search_patients(p, "a%b").collect()] == ["1"]
    assert [r.id for r in store.search_patients(p, "").collect()] == ["2", "1"]


def test_patch_erases_and_keeps(spark):
    e = encounters(spark, {"id": "e", "vitals": {"pulse": 80, "weight": 60}, "notes": "x", "provenance": {"notes": {"source": "voice"}}})
    row = store.patch_encounter(e, "e", NOW, vitals={"pulse": F.lit(90), "weight": F.lit(None)}, notes=F.lit(None)).first()
    assert (row.vitals.pulse, row.vitals.weight, row.notes, row.updatedAt, list(row.provenance)) == (90.0, None, None, NOW, ["notes"])


def test_anonymous_codes_do_not_meet(spark, monkeypatch):
    """Two ids whose eight characters are the same under this salt."""
    monkeypatch.setattr(deid, "random_salt", lambda: "s")
    p = patients(spark, {"id": "p189391"}, {"id": "p2042952"})
    e = encounters(spark, {"id": "e1", "patientId": "p189391"}, {"id": "e2", "patientId": "p2042952"})
    assert deid.deid_patients(p, "s", NOW).select("id").distinct().count() == 1
    people, visits, _ = deid.deidentify(p, e, "anonymous", NOW)
    codes = {r.id for r in people.collect()}
    assert len(codes) == 2 and {r.patientId for r in visits.collect()} == codes


def test_dump_is_compressed(spark, tmp_path):
    p = patients(spark, *[{"id": f"p{k}", "phone": "é\n"} for k in range(500)])
    e = encounters(spark, *[{"id": f"e{k}", "notes": "vu le matin", "vitals": {"pulse": k}} for k in range(500)])
    at = str(tmp_path / "dump")
    sinks.write_dump(p.coalesce(1), e.coalesce(1), deid.deidentify(p, e, "identified", NOW)[2], "2024-01-01T00:00:00Z", "note", at)
    lines = sum(len(json.dumps(r.asDict(recursive=True))) for r in e.collect())
    assert sum(f.stat().st_size for f in (tmp_path / "dump" / "encounters").glob("part-*")) * 4 < lines
    back_p, back_e, _ = sinks.read_dump(spark, at)
    assert sorted(map(str, back_p.collect())) == sorted(map(str, p.collect())) and sorted(r.vitals.pulse for r in back_e.collect()) == list(range(500))
