"""Many requests and many merges at once against one after the other."""

import random

import pytest

from dispensary.operators import mergelog, sync
from dispensary.operators.merge import MERGEABLE
from dispensary.schemas import CHANGES, ENCOUNTERS, PATIENTS, STATE
from dispensary.sources.pages import PageStore


def one_by_one(changes, requests, state, counters, page):
    """A server that takes the requests in order."""
    store, counter = {r[:3]: r for r in state}, dict(counters)
    told, sent = [], []
    for facility, push, cursor in sorted(requests, key=lambda r: r[1]):
        own = sorted((c for c in changes if c[0] == facility and c[1] == push), key=lambda c: (c[3] != "patient", c[2]))
        counter[facility] = counter.get(facility, 0)
        seq, pushed = counter[facility], 0
        counter[facility] += len(own)
        for _, _, _, kind, id_, at, deleted, body in own:
            held = store.get((facility, kind, id_))
            if held is None or held[3] < at:
                seq, pushed = seq + 1, pushed + 1
                store[facility, kind, id_] = (facility, kind, id_, at, deleted, seq, body)
        rows = sorted((r for r in store.values() if r[0] == facility and r[5] > cursor), key=lambda r: r[5])[:page]
        told.append((facility, push, pushed, len(own) - pushed, len(rows), max((r[5] for r in rows), default=cursor), len(rows) == page))
        sent += [(facility, push, k, r[1], r[2], r[5], r[6]) for k, r in enumerate(rows, 1)]
    return told, sent


@pytest.mark.parametrize("page", [3, 500])
def test_responses(spark, page):
    r = random.Random(page)
    changes = []
    for push in range(40):
        for f in ("f1", "f2", "hot"):
            for k in range(r.randrange(6 if f != "hot" else 15)):
                kind, at = r.choice(("patient", "encounter")), float(r.randrange(push, push + 30))
                changes.append((f, push, k, kind, f"i{r.randrange(12)}", at, None, f"{push}-{k}"))
    requests = [(f, push, r.choice((0, -5, 7, push, push * 5, 10**6, 10**12))) for f in ("f1", "f2", "hot", "silent") for push in range(-1, 41)]
    state = [("f1", "patient", "i1", 9.0, None, 2, "old"), ("f1", "patient", "i99", 9.0, 5, 3, "gone"), ("silent", "encounter", "i0", 1.0, None, 4, "s")]
    counters = [("f1", 3), ("silent", 900)]
    told, sent = one_by_one(changes, requests, state, counters, page)
    frames = [spark.createDataFrame(requests, "facilityId string, push long, cursor long"), spark.createDataFrame(changes, CHANGES), spark.createDataFrame(state, STATE), spark.createDataFrame(counters, "facilityId string, value long")]
    assert sorted(map(tuple, sync.responses(*frames, page=page).collect())) == sorted(told)
    assert sorted(map(tuple, sync.pages(*frames, page=page).collect())) == sorted(sent)


def test_a_string_is_no_cursor(spark):
    lines = [f'{{"facilityId":"f","push":{k},"cursor":{c},"changes":{{}}}}' for k, c in enumerate(('"5"', "5", "null", "5.5", "true", "[5]", "1e3"))]
    lines.append('{"facilityId":"f","push":7}')
    heads = sync.request_heads(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [r.cursor for r in heads.orderBy("push").collect()] == [0, 5, 0, 5, 0, 0, 1000, 0]


def test_page_opens_only_its_files(spark, tmp_path):
    rows = [(f, "patient", f"i{k}", 1.0, None, k, "b" * 20) for f in ("a", "b") for k in range(1, 1001)]
    pages = PageStore(spark, str(tmp_path / "pages"))
    state = spark.createDataFrame(rows, STATE)
    pages.write(state, file_rows=100)
    every = len(spark.read.parquet(str(tmp_path / "pages" / "records")).inputFiles())
    for facility, cursor, page in (("a", 0, 50), ("a", 437, 120), ("b", 990, 500), ("b", 1000, 5), ("c", 0, 5), ("b", -3, 1)):
        got = pages.pull(facility, cursor, page)
        assert list(map(tuple, got.collect())) == list(map(tuple, sync.pull(state, facility, cursor, page).collect()))
        assert len(pages.files(facility, cursor, page)) <= 1 + page / 60 + 1 < every


def merged_in_turn(patients, encounters, log):
    """Each entry on its own, as a device makes it."""
    p, e = {x["id"]: dict(x) for x in patients}, [dict(x) for x in encounters]
    out = []
    for ord_, at, keep, duplicate in sorted(log):
        if keep == duplicate or keep not in p or duplicate not in p:
            continue
        moved = [x for x in e if x["patientId"] == duplicate]
        for x in moved:
            x |= {"patientId": keep, "updatedAt": at, "syncedAt": None}
        a, b, filled = p[keep], p[duplicate], []
        for f in MERGEABLE:
            if a[f] in (None, "") and b[f] not in (None, ""):
                a[f] = b[f]
                filled.append(f)
                if f == "birthDate":
                    a["birthDatePrecision"] = b["birthDatePrecision"]
        if a["sex"] == "unknown" and b["sex"] != "unknown":
            a["sex"] = b["sex"]
            filled.append("sex")
        a |= {"updatedAt": at, "syncedAt": None, "searchKey": " ".join(filter(None, [a["familyName"], a["givenName"], a["registerNo"], a["phone"]])).lower()}
        b |= {"deletedAt": at, "updatedAt": at, "syncedAt": None}
        out.append((ord_, keep, duplicate, len(moved), filled))
    return p, e, out


@pytest.mark.parametrize("seed", range(3))
def test_merge_log(spark, seed):
    r = random.Random(seed)
    names = [c.split()[0] for c in PATIENTS.replace("\n", " ").split(",")]
    some = lambda *values: r.choice((None, "", *values))
    patients = []
    for k in range(14):
        row = dict.fromkeys(names) | {"id": f"p{k}", "familyName": f"F{k}", "givenName": some(f"g{k}"), "sex": r.choice(("unknown", "male", "female")), "birthDate": some(f"19{k + 10}-01-01"), "phone": some(f"{k}"), "address": some(f"a{k}"), "registerNo": some(f"r{k}"), "approximateAge": r.choice((None, k)), "createdAt": 1, "updatedAt": 2, "syncedAt": 3}
        row["birthDatePrecision"] = "day" if row["birthDate"] else None
        row["searchKey"] = "old"
        patients.append(row)
    encounters = [{"id": f"e{k}", "patientId": r.choice(["ghost", *[f"p{j}" for j in range(14)]]), "updatedAt": 5, "syncedAt": 6} for k in range(40)]
    if seed == 0:  # a long chain from its end, then from its beginning
        log = [(k, 1000 + k, f"p{12 - k}", f"p{13 - k}") for k in range(13)] + [(50 + k, 2000 + k, f"p{k + 1}", f"p{k}") for k in range(9)]
    else:  # anything: cycles over time, patients merged away and kept many times, a hot survivor, unknown ones
        log = [(k, 1000 + k, r.choice(("p0", f"p{r.randrange(14)}", "ghost")), f"p{r.randrange(14)}") for k in range(30)]
    p, e, out = merged_in_turn(patients, encounters, log)
    pd_ = spark.createDataFrame([[row[c] for c in names] for row in patients], PATIENTS)
    shape = spark.createDataFrame([], ENCOUNTERS)
    ed = shape.unionByName(spark.createDataFrame(encounters, "id string, patientId string, updatedAt long, syncedAt long"), allowMissingColumns=True)
    got_p, got_e, got_out = mergelog.apply_merge_log(pd_, ed, spark.createDataFrame(log, "ord long, at long, keepId string, duplicateId string"))
    rows = {x.id: x.asDict() for x in got_p.collect()}
    kept = {x[1] for x in out}
    for id_, want in p.items():
        if id_ not in kept:
            want["searchKey"] = "old"
        assert rows[id_] == want
    assert {(x.id, x.patientId, x.updatedAt, x.syncedAt) for x in got_e.collect()} == {(x["id"], x["patientId"], x["updatedAt"], x["syncedAt"]) for x in e}
    assert sorted((x.ord, x.keepId, x.duplicateId, x.moved, x.filled) for x in got_out.collect()) == out


def test_empty_merge_log(spark):
    patients, encounters = spark.createDataFrame([], PATIENTS), spark.createDataFrame([], ENCOUNTERS)
    log = spark.createDataFrame([(1, 1, "a", "b")], "ord long, at long, keepId string, duplicateId string")
    assert [x.count() for x in mergelog.apply_merge_log(patients, encounters, log)] == [0, 0, 0]


def test_responses_by_small_blocks(spark, monkeypatch):
    """Pages over many blocks, and blocks asked by more requests than one group takes."""
    monkeypatch.setattr(sync, "BLOCK", 4)
    monkeypatch.setattr(sync, "REQUESTS", 3)
    r, changes = random.Random(1), []
    for push in range(30):
        changes += [(f, push, k, "patient", f"i{r.randrange(40)}", float(r.randrange(push, push + 9)), None, f"{push}-{k}") for f in ("f1", "f2") for k in range(r.randrange(7))]
    requests = [(f, push, r.choice((0, 3, push * 3))) for f in ("f1", "f2") for push in range(30)]
    told, sent = one_by_one(changes, requests, [], [], 10)
    frames = [spark.createDataFrame(requests, "facilityId string, push long, cursor long"), spark.createDataFrame(changes, CHANGES)]
    assert sorted(map(tuple, sync.responses(*frames, page=10).collect())) == sorted(told)
    assert sorted(map(tuple, sync.pages(*frames, page=10).collect())) == sorted(sent)


def test_a_push_of_any_size(spark):
    """Numbered in ranges as in one piece, and no window sorts the rows of a push."""
    r = random.Random(2)
    changes = [(f, push, k, r.choice(("patient", "encounter")), f"i{r.randrange(300)}", float(r.randrange(50)), None, "b") for f in ("f1", "f2") for push in (1, 2) for k in range(500 if f == "f1" else 5)]
    frames = [spark.createDataFrame(changes, CHANGES), None, spark.createDataFrame([("f1", 7)], "facilityId string, value long")]
    wide, plain = sync.sequenced(*frames, wide=True), sync.sequenced(*frames)
    assert sorted(map(str, wide.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert "row_number" not in wide._jdf.queryExecution().optimizedPlan().toString()


def _generated(plan):
    """Rows that lists were taken apart into, in a plan that has run."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _generated(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _generated(plan.plan())
    own = plan.metrics().apply("numOutputRows").value() if kind == "GenerateExec" else 0
    return own + sum(_generated(plan.children().apply(k)) for k in range(plan.children().size()))


@pytest.mark.parametrize("answers", ["responses", "pages"])
def test_requests_do_not_meet_what_was_followed(spark, monkeypatch, answers):
    """Records that change all along, asked for from the beginning: what lies behind is not gone through by each request."""
    monkeypatch.setattr(sync, "BLOCK", 4)
    monkeypatch.setattr(sync, "RUN", 2)
    monkeypatch.setattr(sync, "REQUESTS", 50)
    r = random.Random(3)
    changes = [("f", push, k, "patient", f"i{r.randrange(9)}-{k}", float(push), None, f"{push}-{k}") for push in range(300) for k in range(4)]
    requests = [("f", push, r.choice((0, 0, push))) for push in range(300)]
    want = one_by_one(changes, requests, [], [], 10)[answers == "pages"]
    got = getattr(sync, answers)(spark.createDataFrame(requests, "facilityId string, push long, cursor long"), spark.createDataFrame(changes, CHANGES), page=10)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert _generated(got._jdf.queryExecution().executedPlan()) < 4 * (len(changes) + len(requests))


def test_sparse_pushes_and_a_long_way_to_look(spark, monkeypatch):
    """Numbers of pushes far apart, few requests among many pushes, and counts that are looked at in pieces."""
    monkeypatch.setattr(sync, "BLOCK", 2)
    monkeypatch.setattr(sync, "RUN", 3)
    monkeypatch.setattr(sync, "REQUESTS", 7)
    monkeypatch.setattr(sync, "_LOOK", 3)
    r = random.Random(4)
    at = sorted(r.sample(range(10**12), 60))
    changes = [(f, push, k, r.choice(("patient", "encounter")), f"i{r.randrange(60)}", float(n + r.randrange(3)), None, f"{push}-{k}") for n, push in enumerate(at) for f in ("f1", "f2") for k in range(r.randrange(6))]
    requests = [(f, push + r.randrange(3), r.choice((0, 7, 50, 10**11))) for f in ("f1", "f2") for push in r.sample(at, 25)] + [("f1", -(10**9), 0)]
    frames = [spark.createDataFrame(requests, "facilityId string, push long, cursor long"), spark.createDataFrame(changes, CHANGES)]
    assert sorted(map(tuple, sync.pages(*frames, page=25).collect())) == sorted(_sent_at(changes, requests, 25))
    assert sorted(x.records for x in sync.responses(*frames, page=25).collect()) == sorted(_records(changes, requests, 25))


def _sent_at(changes, requests, page):
    """Pages of requests that come with no push of their own: as after the last push until then."""
    out = []
    for facility, push, cursor in requests:
        before = [c for c in changes if c[0] == facility and c[1] <= push]
        pushes = sorted({c[1] for c in before})
        if pushes:
            asks = [(facility, p, cursor) for p in pushes]
            out += [(facility, push, *row[2:]) for row in one_by_one(before, asks, [], [], page)[1] if row[1] == pushes[-1]]
    return out


def _records(changes, requests, page):
    sent = [row[:2] for row in _sent_at(changes, requests, page)]
    return [sent.count((facility, push)) for facility, push, _ in requests]
