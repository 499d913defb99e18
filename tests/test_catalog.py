"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from dispensary.operators import bundle, store
from dispensary.plans import catalog
from dispensary.sources import testdata as data

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, "" if isinstance(v, (int, float)) else str(type(v)), 0 if v is None else v) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows(spark, db, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = db.sql(catalog.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    rows = [tuple(map(plain, r)) for r in got.select([f"`{c}`" for c in columns]).collect()]
    assert ordered(rows) == ordered([tuple(plain(r[i]) for i in at) for r in want.fetchall()])


def test_bundle_json_is_complete(spark):
    rows = bundle.bundle_entries(*(store.live(f(spark, DATA)) for f in (data.patients, data.encounters)), catalog.NOW)
    assert {r.resourceType for r in rows.select("resourceType").distinct().collect()} == {"Patient", "Encounter", "Observation", "MedicationRequest"}
    assert rows.filter("json is null or fullUrl is null").isEmpty()
    assert rows.filter(rows.json.contains('null')).isEmpty()


def test_report_plan_prunes_and_pushes(spark):
    plan = catalog.monthly_report(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
