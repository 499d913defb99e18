"""Every query over the record store, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dispensary.functions import clinical as C
from dispensary.functions import text as T
from dispensary.functions.extract import extraction, spoken_number
from dispensary.operators import bundle, deid, merge, mergelog, patches, report, store, sync
from dispensary.plans import oracle as O
from dispensary.schemas import RANGES, SEVERITY
from dispensary.session import shared_folder
from dispensary.sources import sinks
from dispensary.sources import testdata as data
from dispensary.sources.buckets import BucketTable
from dispensary.sources.documents import read_items
from dispensary.sources.pages import PageStore
from dispensary.sources.postings import SearchIndex
from dispensary.streaming import live as live_views
from dispensary.streaming.feed import Snapshots, read_changes, start_feed

#: Fixed instants: the month of the reports, a day and its month for dashboards, now, and the salt.
YEAR, MONTH = 1997, 7
DAY_START, MONTH_START, NOW = 995155200000, 993945600000, 1704067200000
SALT = "s"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(*parts: str, select: str | None = None):
    """Register a query, with its SQL if it has one."""

    def register(f):
        QUERIES[f.__name__] = f
        if select is not None:
            ORACLE[f.__name__] = O.sql(*parts, select=select)
        return f

    return register


def _live(spark, d):
    return store.live(data.patients(spark, d)), store.live(data.visits(spark, d))


def _cells(spark, d):
    return report.aggregate_month(*_live(spark, d), YEAR, MONTH)


REPORT = (O.PATIENTS, O.VISITS, O.CELLS)

# --- reports ----------------------------------------------------------------------------------------------------


@query(*REPORT, select='SELECT indicator, "ageBand", sex, count FROM cells')
def monthly_report(spark, d):
    return _cells(spark, d)


@query(*REPORT, select="""SELECT CASE indicator WHEN 'tuberculosis' THEN 'REPLACE_DE_TB' WHEN 'hypertension' THEN 'REPLACE_DE_HTN' ELSE 'REPLACE_DE_' || upper(indicator) END AS "dataElement",
  'REPLACE_COC_' || "ageBand" || '_' || s AS "categoryOptionCombo", CAST(count AS VARCHAR) AS value FROM named""")
def dhis2_data_values(spark, d):
    return report.data_values(_cells(spark, d))


@query(*REPORT, select="""SELECT '199707' AS periode, label AS indicateur, "ageBand" AS tranche_age, s AS sexe, CAST(count AS VARCHAR) AS nombre FROM named""")
def report_csv_rows(spark, d):
    return report.csv_rows(_cells(spark, d), YEAR, MONTH)


@query(*REPORT, select="""SELECT indicator, "ageBand", sex, count FROM cells ORDER BY indicator, CASE "ageBand" WHEN '<1' THEN 0 WHEN '1-4' THEN 1 WHEN '15-49' THEN 2 WHEN '5-14' THEN 3 WHEN '50+' THEN 4 ELSE 5 END, sex LIMIT 8""")
def report_preview(spark, d):
    return report.report_order(_cells(spark, d)).limit(8)


_PLACED = """placed AS (SELECT CAST(row_number() OVER (ORDER BY indicator, CASE "ageBand" WHEN '<1' THEN 0 WHEN '1-4' THEN 1 WHEN '15-49' THEN 2 WHEN '5-14' THEN 3 WHEN '50+' THEN 4 ELSE 5 END, sex) AS INTEGER) AS place, * FROM named)"""


@query(*REPORT, _PLACED, select="""SELECT place, '199707' AS period, 'REPLACE_DATASET_UID' AS "dataSet", 'REPLACE_ORG_UNIT_UID' AS "orgUnit", '2024-01-01' AS "completeDate", true AS placeholder,
  CASE indicator WHEN 'tuberculosis' THEN 'REPLACE_DE_TB' WHEN 'hypertension' THEN 'REPLACE_DE_HTN' ELSE 'REPLACE_DE_' || upper(indicator) END AS "dataElement", 'REPLACE_COC_' || "ageBand" || '_' || s AS "categoryOptionCombo", CAST(count AS VARCHAR) AS value,
  label AS "readIndicator", "ageBand" AS "readBand", s AS "readSex", count AS "readCount" FROM placed""")
def dhis2_document(spark, d):
    """The whole document, its two lists place by place."""
    doc = report.data_value_set(_cells(spark, d), YEAR, MONTH, "2024-01-01")
    shape = "dataSet string, period string, orgUnit string, completeDate string, _placeholderMapping boolean, dataValues array<struct<dataElement:string,categoryOptionCombo:string,value:string>>, _readable array<struct<indicator:string,ageBand:string,sex:string,count:long>>"
    rows = doc.select(F.from_json("json", shape).alias("j")).select("j.*", F.posexplode(F.arrays_zip("j.dataValues", "j._readable")).alias("i", "x"))
    names = {"indicator": "readIndicator", "ageBand": "readBand", "sex": "readSex", "count": "readCount"}
    return rows.select((F.col("i") + 1).alias("place"), "period", "dataSet", "orgUnit", "completeDate", F.col("_placeholderMapping").alias("placeholder"), "x.dataValues.*", *[F.col(f"x._readable.{a}").alias(b) for a, b in names.items()])


def _label_sql(lang: str) -> str:
    return "CASE ind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.INDICATOR_LABELS[lang].items()) + " END"


@query(O.PATIENTS, O.VISITS, O.CELLS.replace("AND status = 'final' AND \"occurredAt\" >= 867715200000 AND \"occurredAt\" < 870393600000", ""), select=f"""SELECT ind AS key, {_label_sql("fr")} AS fr, {_label_sql("mg")} AS mg, {_label_sql("en")} AS en, count(*) AS encounters FROM banded GROUP BY ALL""")
def indicator_labels(spark, d):
    """What all live encounters are counted as, in three languages."""
    kinds = _live(spark, d)[1].select(C.classify_diagnosis(F.col("diagnosis")).alias("key")).groupBy("key").agg(F.count("*").alias("encounters"))
    return kinds.select("key", *[C.indicator_label(F.col("key"), lang).alias(lang) for lang in ("fr", "mg", "en")], "encounters")


# --- scans, lookups, search -------------------------------------------------------------------------------------


@query(O.PATIENTS, select='SELECT id, "familyName", sex, "birthDate", CAST("approximateAge" AS INTEGER) AS "approximateAge" FROM patients WHERE "deletedAt" IS NULL')
def live_patients(spark, d):
    return _live(spark, d)[0].select("id", "familyName", "sex", "birthDate", "approximateAge")


@query(O.VISITS, select='SELECT id, "patientId", "occurredAt", status FROM visits WHERE "deletedAt" IS NULL')
def live_encounters(spark, d):
    return _live(spark, d)[1].select("id", "patientId", "occurredAt", "status")


@query(O.PATIENTS, O.VISITS, select='SELECT (SELECT count(*) FROM patients WHERE "deletedAt" IS NULL) AS patients, (SELECT count(*) FROM visits WHERE "deletedAt" IS NULL) AS encounters')
def live_counts(spark, d):
    return store.counts(data.patients(spark, d), data.visits(spark, d))


@query(O.PATIENTS, O.VISITS, select="""SELECT (SELECT count(*) FROM patients WHERE "syncedAt" IS NULL) + (SELECT count(*) FROM visits WHERE "syncedAt" IS NULL AND status = 'final') AS pending""")
def pending_sync(spark, d):
    return store.pending_sync(data.patients(spark, d), data.visits(spark, d))


@query(O.PATIENTS, O.VISITS, select="""SELECT 'patient' AS kind, id FROM patients WHERE "syncedAt" IS NULL UNION ALL SELECT 'encounter', id FROM visits WHERE "syncedAt" IS NULL AND status = 'final'""")
def unsynced_records(spark, d):
    p, e = store.dirty(data.patients(spark, d), False), store.dirty(data.visits(spark, d), True)
    return p.select(F.lit("patient").alias("kind"), "id").unionByName(e.select(F.lit("encounter").alias("kind"), "id"))


@query(O.PATIENTS, select="""SELECT id, "familyName", "deletedAt" FROM patients WHERE id = 'p49'""")
def patient_lookup(spark, d):
    return store.by_key(data.patients(spark, d), "id", "p49").select("id", "familyName", "deletedAt")


@query(O.VISITS, select="""SELECT id, "occurredAt", status, diagnosis FROM visits WHERE "patientId" = 'p7' AND "deletedAt" IS NULL""")
def patient_timeline(spark, d):
    return store.timeline(data.visits(spark, d), "p7").select("id", "occurredAt", "status", "diagnosis")


@query(O.PATIENTS, select='SELECT id, "searchKey" FROM keyed')
def search_keys(spark, d):
    return data.patients(spark, d).select("id", "searchKey")


@query(O.PATIENTS, select="""SELECT id, "updatedAt" FROM (SELECT * FROM keyed WHERE "deletedAt" IS NULL AND contains("searchKey", 'rakotoarison voa') ORDER BY id LIMIT 50)""")
def search_roster(spark, d):
    return store.search_patients(data.patients(spark, d), " RAKOTOÀRISON Voa").select("id", "updatedAt")


@query(O.PATIENTS, select="""SELECT id, "updatedAt" FROM (SELECT * FROM keyed WHERE "deletedAt" IS NULL AND contains("searchKey", 'rakotoarison voa') ORDER BY id LIMIT 50)""")
def search_postings(spark, d):
    """The same out of postings of three letters; then the table and its postings follow a change, and the new name is found."""
    at = scratch(spark)
    p = data.patients(spark, d)
    stored = BucketTable(spark, f"{at}/patients", p.schema)
    stored.write(p.withColumn("searchKey", F.when(F.col("id") == "p3", "someone else").otherwise(F.col("searchKey"))))
    index = SearchIndex(spark, f"{at}/postings", stored)
    index.build()
    before, after = stored.lookup("p3"), p.filter("id = 'p3'")
    index.update(before, after)
    stored.change(after, lambda rows: rows.filter("id <> 'p3'").unionByName(after))
    return index.search(" RAKOTOÀRISON Voa").select("id", "updatedAt")


@query(O.PATIENTS, select="""SELECT id, "updatedAt" FROM keyed WHERE "deletedAt" IS NULL ORDER BY "updatedAt" DESC, id LIMIT 50""")
def search_all(spark, d):
    return store.search_patients(data.patients(spark, d), "  ").select("id", "updatedAt")


@query(O.PATIENTS, select="""SELECT id FROM (SELECT * FROM keyed WHERE "deletedAt" IS NULL AND contains("searchKey", 'andrianjafy') ORDER BY id LIMIT 40) WHERE id <> 'p1'""")
def merge_candidates(spark, d):
    return store.merge_candidates(data.patients(spark, d), "andrianjafy", "p1").select("id")


@query(O.PATIENTS, O.VISITS, select="""SELECT v.id, v."patientId", p."familyName", p."deletedAt" AS "patientDeletedAt" FROM (SELECT * FROM visits WHERE "deletedAt" IS NULL AND status = 'draft' ORDER BY "updatedAt" DESC, id LIMIT 3) v LEFT JOIN patients p ON p.id = v."patientId\"""")
def draft_queue(spark, d):
    return store.draft_queue(data.visits(spark, d), data.patients(spark, d)).select("id", "patientId", "familyName", "patientDeletedAt")


_LAST = """last AS (SELECT "patientId", max("occurredAt") AS "lastVisit" FROM visits WHERE "deletedAt" IS NULL AND status = 'final' GROUP BY 1)"""


@query(O.VISITS, _LAST, select="SELECT * FROM last")
def last_visit(spark, d):
    return store.last_visit(data.visits(spark, d))


@query(O.PATIENTS, O.VISITS, _LAST, select="""SELECT id, "updatedAt", "lastVisit" FROM (SELECT * FROM patients WHERE "deletedAt" IS NULL ORDER BY "updatedAt" DESC, id LIMIT 5) LEFT JOIN last ON "patientId" = id""")
def recent_patients(spark, d):
    return store.recent_patients(data.patients(spark, d), data.visits(spark, d)).select("id", "updatedAt", "lastVisit")


_NOTED = f"""noted AS (SELECT "patientId", max(CASE WHEN status <> 'draft' THEN "occurredAt" END) AS "lastVisit", bool_or(status = 'draft') AS "hasDraft",
  bool_or(status <> 'draft' AND "occurredAt" >= {DAY_START}) AS "seenToday" FROM visits WHERE "deletedAt" IS NULL GROUP BY 1),
roster AS (SELECT id, "lastVisit", coalesce("hasDraft", false) AS "hasDraft", coalesce("seenToday", false) AS "seenToday" FROM patients LEFT JOIN noted ON "patientId" = id WHERE "deletedAt" IS NULL)"""


@query(O.PATIENTS, O.VISITS, _NOTED, select="SELECT * FROM noted")
def roster_annotations(spark, d):
    return store.annotations(data.visits(spark, d), DAY_START)


@query(O.PATIENTS, O.VISITS, _NOTED, select='SELECT id, "lastVisit" FROM roster WHERE "seenToday"')
def roster_today(spark, d):
    return store.roster(*_live(spark, d), DAY_START, "today").select("id", "lastVisit")


@query(O.PATIENTS, O.VISITS, _NOTED, select='SELECT count(*) AS "all", count(*) FILTER ("seenToday") AS today, count(*) FILTER ("hasDraft") AS drafts FROM roster')
def roster_filters(spark, d):
    return store.roster_counts(*_live(spark, d), DAY_START)


@query(O.VISITS, select=f"""SELECT count(*) FILTER ("occurredAt" >= {DAY_START}) AS today, count(*) FILTER ("occurredAt" >= {MONTH_START}) AS month FROM visits WHERE "deletedAt" IS NULL AND status = 'final'""")
def dashboard_counts(spark, d):
    return store.dashboard_counts(data.visits(spark, d), DAY_START, MONTH_START)


# --- vitals and prescriptions -----------------------------------------------------------------------------------


def _severity_sql(v: str, value: str) -> str:
    if v not in SEVERITY:
        return f"CASE WHEN {value} IS NOT NULL THEN 'normal' END"
    tests = []
    for name, (high, low) in zip(("urgent", "watch"), SEVERITY[v], strict=True):
        t = [f"{value} >= {high}" if high is not None else "", f"{value} < {low}" if low is not None else ""]
        tests.append(f"WHEN {' OR '.join(x for x in t if x)} THEN '{name}'")
    return f"CASE WHEN {value} IS NULL THEN NULL {' '.join(tests)} ELSE 'normal' END"


_FLAGS = "flags AS (" + " UNION ALL ".join(f"""SELECT id, '{v}' AS vital, "{v}" AS value, {_severity_sql(v, f'"{v}"')} AS severity, "{v}" BETWEEN {RANGES[v][0]} AND {RANGES[v][1]} AS plausible FROM visits WHERE "{v}" IS NOT NULL""" for v in RANGES) + ")"


@query(O.VISITS, _FLAGS, select="SELECT * FROM flags")
def vital_severity(spark, d):
    return store.vital_flags(data.visits(spark, d))


_SHIFTED = "shifted AS (" + " UNION ALL ".join(f"""SELECT id, '{v}' AS vital, {e} AS value, {low}::DOUBLE AS low, {high}::DOUBLE AS high FROM (SELECT *, CASE k % 4 WHEN 0 THEN "{v}" * 2 WHEN 1 THEN "{v}" / 3 WHEN 2 THEN {low} WHEN 3 THEN {high} END AS s FROM visits WHERE "{v}" IS NOT NULL)""" for v, (low, high, *_), e in ((v, RANGES[v], "s") for v in RANGES)) + ")"


@query(O.VISITS, _SHIFTED, select="SELECT id, vital, CAST(value AS DOUBLE) AS value FROM shifted WHERE NOT value BETWEEN low AND high")
def out_of_range(spark, d):
    """Values doubled, cut to a third, or put on either bound, which is still in range."""
    k = F.substring("id", 2, 20).cast("long") % 4
    moved = lambda v: F.when(k == 0, F.col(f"vitals.{v}") * 2).when(k == 1, F.col(f"vitals.{v}") / 3).when(k == 2, F.lit(RANGES[v][0])).otherwise(F.lit(RANGES[v][1]))
    vitals = F.struct(*[F.when(F.col(f"vitals.{v}").isNotNull(), moved(v)).alias(v) for v in RANGES])
    return store.vital_flags(data.visits(spark, d).withColumn("vitals", vitals)).filter("not plausible").select("id", "vital", "value")


@query(O.VISITS, _FLAGS, select="""SELECT v.id, CASE coalesce(max(CASE severity WHEN 'urgent' THEN 2 WHEN 'watch' THEN 1 ELSE 0 END), 0) WHEN 2 THEN 'urgent' WHEN 1 THEN 'watch' ELSE 'normal' END AS worst, count(vital) > 0 AS "hasAny" FROM visits v LEFT JOIN flags f ON f.id = v.id GROUP BY 1""")
def worst_severity(spark, d):
    return data.visits(spark, d).select("id", C.worst_severity().alias("worst"), C.has_any_vital().alias("hasAny"))


@query(O.VISITS, select="""SELECT id, format('{:.1f}', temperature) || ' °C' AS temperature, format('{:.0f}', pulse) || ' /min' AS pulse FROM visits""")
def format_vitals(spark, d):
    return data.visits(spark, d).select("id", T.format_vital("temperature", F.col("vitals.temperature")).alias("temperature"), T.format_vital("pulse", F.col("vitals.pulse")).alias("pulse"))


@query(O.PRESCRIPTIONS, select="""SELECT "encounterId", id,
  drug || coalesce(', ' || dose, '') || coalesce(', ' || "frequencyPerDay" || ' fois par jour', '') || coalesce(', pendant ' || "durationDays" || ' jour' || CASE WHEN "durationDays" > 1 THEN 's' ELSE '' END, '') AS fr,
  drug || coalesce(', ' || dose, '') || coalesce(', ' || "frequencyPerDay" || ' time' || CASE WHEN "frequencyPerDay" > 1 THEN 's' ELSE '' END || ' per day', '') || coalesce(', for ' || "durationDays" || ' day' || CASE WHEN "durationDays" > 1 THEN 's' ELSE '' END, '') AS en,
  drug || coalesce(', ' || dose, '') || coalesce(', ' || CASE "frequencyPerDay" WHEN 1 THEN 'indray mandeha' WHEN 2 THEN 'indroa' WHEN 3 THEN 'intelo' WHEN 4 THEN 'inefatra' END || ' isan''andro', '') || coalesce(', mandritra ny ' || "durationDays" || ' andro', '') AS mg FROM prescriptions""")
def prescription_instructions(spark, d):
    p = data.prescriptions(spark, d)
    parts = [F.col(c) for c in ("drug", "dose", "frequencyPerDay", "durationDays")]
    return p.select("encounterId", "id", *[T.prescription_instruction(*parts, lang).alias(lang) for lang in ("fr", "en", "mg")])


@query(O.PRESCRIPTIONS, select="""SELECT "encounterId", id, CAST("frequencyPerDay" * "durationDays" AS BIGINT) AS doses, CASE "frequencyPerDay" WHEN 1 THEN '1,0,0' WHEN 2 THEN '1,0,1' WHEN 3 THEN '1,1,1' WHEN 4 THEN '' END AS slots FROM prescriptions""")
def doses_and_slots(spark, d):
    p = data.prescriptions(spark, d)
    slots = F.array_join(F.transform(C.dosing_slots(F.col("frequencyPerDay")), lambda x: x.cast("string")), ",")
    return p.select("encounterId", "id", C.total_doses(F.col("frequencyPerDay"), F.col("durationDays")).alias("doses"), slots.alias("slots"))


@query(O.VISITS, select="""SELECT id, 'vitals.pulse' AS field, 'voice' AS source, CAST(k % 10 + 1 AS DOUBLE) / 10 AS confidence FROM visits WHERE k % 10 + 1 < 8""")
def uncertain_fields(spark, d):
    return store.uncertain_fields(data.visits(spark, d))


# --- text and labels --------------------------------------------------------------------------------------------

_AVATAR = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(id, ''), lambda c: ord(c)::BIGINT)), lambda a, c: ((a * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)"


@query(O.PATIENTS, select=f"""SELECT id, upper(substr(replace(id, '-', ''), 1, 6)) AS code, upper(substr(trim("familyName"), 1, 1) || substr(trim("givenName"), 1, 1)) AS initials,
  (['teal', 'sky', 'indigo', 'violet', 'fuchsia', 'rose', 'cyan', 'blue'])[abs({_AVATAR}) % 8 + 1] AS colour FROM patients""")
def patient_badges(spark, d):
    return data.patients(spark, d).select("id", T.short_code(F.col("id")).alias("code"), T.initials(F.col("familyName"), F.col("givenName")).alias("initials"), T.avatar_colour(F.col("id")).alias("colour"))


@query(select="""SELECT doc_id, CASE WHEN length(text) <= 90 THEN text ELSE rtrim(substr(text, 1, 90), E' \\n\\t') || '…' END AS short FROM documents""")
def truncate_text(spark, d):
    return data.table(spark, d, "documents").select("doc_id", T.truncate(F.col("text")).alias("short"))


@query(select="""SELECT doc_id, translate(lower(text), 'àáâãäåèéêëìíîïòóôõöùúûüçñÿýœæ', 'aaaaaaeeeeiiiiooooouuuucnyyea') AS clinical, translate(lower(text), 'àáâãäåèéêëìíîïòóôõöùúûüç', 'aaaaaaeeeeiiiiooooouuuuc') AS names FROM documents""")
def folded_texts(spark, d):
    return data.table(spark, d, "documents").select("doc_id", T.fold_clinical(F.col("text")).alias("clinical"), T.fold_names(F.col("text")).alias("names"))


@query(O.VISITS, select="""SELECT id, strftime(make_timestamp("occurredAt" * 1000), '%d ') || (['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sept', 'Oct', 'Nov', 'Dec'])[month(make_timestamp("occurredAt" * 1000))] || strftime(make_timestamp("occurredAt" * 1000), ' %Y') AS en,
  strftime(make_timestamp("occurredAt" * 1000), '%d ') || (['janv.', 'févr.', 'mars', 'avr.', 'mai', 'juin', 'juil.', 'août', 'sept.', 'oct.', 'nov.', 'déc.'])[month(make_timestamp("occurredAt" * 1000))] || strftime(make_timestamp("occurredAt" * 1000), ' %Y %H:%M') AS fr FROM visits""")
def format_dates(spark, d):
    return data.visits(spark, d).select("id", T.format_date(F.col("occurredAt"), "en").alias("en"), T.format_date_time(F.col("occurredAt"), "fr").alias("fr"))


@query(select="""SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN CAST(floor(n / 1024.0 + 0.5) AS BIGINT) || ' kB' ELSE format('{:.1f}', n / 1048576.0) || ' MB' END AS size FROM (SELECT doc_id, n_chars * 37 AS n FROM documents)""")
def format_sizes(spark, d):
    return data.table(spark, d, "documents").select("doc_id", T.format_bytes(F.col("n_chars") * 37).alias("size"))


@query(O.VISITS, select="""SELECT DISTINCT field, CASE field WHEN 'vitals.pulse' THEN 'Pulse' ELSE 'Notes' END AS label FROM (SELECT unnest(['vitals.pulse', 'notes']) AS field FROM visits)""")
def provenance_labels(spark, d):
    labels = {"pulse": "Pulse", "drug": "Drug", "notes": "Notes", "diagnosis": "Diagnosis", "chiefComplaint": "Complaint"}
    fields = data.visits(spark, d).select(F.explode(F.map_keys("provenance")).alias("field")).distinct()
    return fields.select("field", T.provenance_label(F.col("field"), labels).alias("label"))


@query(select="""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\\s*\\n\\s*', ' ', 'g'), '\\s{2,}', ' ', 'g')) AS line, greatest(0.4, least(1.0, CAST(n_chars % 130 AS DOUBLE) / 100)) AS confidence FROM documents""")
def recognised_lines(spark, d):
    docs = data.table(spark, d, "documents")
    return docs.select("doc_id", T.flatten_lines(F.col("text")).alias("line"), T.clamp_confidence((F.col("n_chars") % 130).cast("double") / 100).alias("confidence"))


@query(select="""SELECT doc_id, list_filter([{'t': ' a ', 'c': 10}, {'t': lang, 'c': n_chars % 100}, {'t': source, 'c': n_chars % 90}], lambda w: w.c < 70 AND length(trim(w.t)) > 1).list_transform(lambda w: w.t).array_to_string(',') AS words FROM documents""")
def doubtful_words(spark, d):
    word = lambda t, c: F.struct(t.alias("text"), c.cast("double").alias("confidence"))
    words = F.array(word(F.lit(" a "), F.lit(10)), word(F.col("lang"), F.col("n_chars") % 100), word(F.col("source"), F.col("n_chars") % 90))
    return data.table(spark, d, "documents").select("doc_id", F.array_join(T.doubtful_words(words), ",").alias("words"))


_FORM = """form AS (SELECT id, CASE WHEN k % 11 = 0 THEN '  ' ELSE ' ' || "familyName" || ' ' END AS f, ' ' || "givenName" AS g, "birthDate" AS b, CASE WHEN k % 3 = 0 THEN '-4' WHEN k % 3 = 1 THEN (k % 60) || ' ans' ELSE 'x' END AS a, phone, k FROM patients)"""


@query(O.PATIENTS, _FORM, select="""SELECT id, trim(f) AS "familyName", trim(g) AS "givenName", CASE WHEN b IS NOT NULL THEN 'day' END AS "birthDatePrecision",
  CASE WHEN k % 3 = 1 AND k % 60 > 0 THEN CAST(k % 60 AS INTEGER) END AS "approximateAge", nullif(trim(phone), '') AS phone, CASE WHEN trim(f) = '' THEN 'required' END AS error FROM form""")
def form_fields(spark, d):
    k = F.substring("id", 2, 20).cast("long")
    forms = data.patients(spark, d).select(
        "id", F.when(k % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), "familyName", F.lit(" "))).alias("familyName"), F.concat(F.lit(" "), "givenName").alias("givenName"), "sex", "birthDate",
        F.when(k % 3 == 0, "-4").when(k % 3 == 1, F.concat((k % 60).cast("string"), F.lit(" ans"))).otherwise("x").alias("approximateAge"), "phone", "address", F.col("id").alias("registerNo"), "preferredLang",
    )
    return store.form_fields(forms).select(F.col("registerNo").alias("id"), "familyName", "givenName", "birthDatePrecision", "approximateAge", "phone", "error")


# --- de-identification ------------------------------------------------------------------------------------------


def _code_sql(id_: str) -> str:
    byte = lambda i: f"CAST(CAST('0x' || substr(sha256('{SALT}:' || {id_}), {2 * i + 1}, 2) AS BIGINT) % 30 + 1 AS BIGINT)"
    return " || ".join(f"substr('0123456789BCDFGHJKLMNPQRSTVWXZ', {byte(i)}, 1)" for i in range(8))


@query(O.PATIENTS, select=f"SELECT id, {_code_sql('id')} AS code FROM patients")
def pseudonyms(spark, d):
    return data.patients(spark, d).select("id", C.pseudonym(F.col("id"), F.lit(SALT)).alias("code"))


@query(O.PATIENTS, select=f"""SELECT {_code_sql("id")} AS id, {_code_sql("id")} AS "familyName", lower({_code_sql("id")}) AS "searchKey", "birthDate" AS "birthDate", phone, CAST(CASE WHEN age >= 90 THEN 90 ELSE age END AS INTEGER) AS "approximateAge", sex
  FROM (SELECT id, sex, NULL AS "birthDate", NULL AS phone, CASE WHEN "birthDate" IS NOT NULL THEN CAST(floor(({NOW} - epoch_us(CAST("birthDate" AS TIMESTAMP)) // 1000) / 31557600000.0) AS BIGINT) ELSE "approximateAge" END AS age FROM patients WHERE "deletedAt" IS NULL)""")
def deid_patients(spark, d):
    return deid.deid_patients(_live(spark, d)[0], SALT, NOW).select("id", "familyName", "searchKey", "birthDate", "phone", "approximateAge", "sex")


_DEID = f"""known AS (SELECT id AS pid, {_code_sql("id")} AS code FROM patients WHERE "deletedAt" IS NULL),
clean AS (SELECT v.id, coalesce(code, 'UNKNOWN') AS "patientId", epoch_us(date_trunc('month', make_timestamp("occurredAt" * 1000))) // 1000 AS "occurredAt", "chiefComplaint", diagnosis,
  regexp_replace(notes, '^vu par \\S+ ', 'vu par […] ') AS notes, CASE WHEN notes IS NULL THEN 0 ELSE 2 END AS redactions, 'pouls ' || (k % 101 + 40) AS said, "syncedAt" FROM visits v LEFT JOIN known ON pid = "patientId" WHERE "deletedAt" IS NULL)"""


@query(O.PATIENTS, O.VISITS, _DEID, select="""SELECT id, "patientId", "occurredAt", "chiefComplaint", diagnosis, notes, notes AS "notesSaid", said AS "pulseSaid" FROM clean""")
def deid_encounters(spark, d):
    p, e = _live(spark, d)
    rows, _ = deid.deid_encounters(e.withColumn("prescriptions", F.array()), p, SALT, True)
    return rows.select("id", "patientId", "occurredAt", "chiefComplaint", "diagnosis", "notes", F.col("provenance")["notes"]["rawText"].alias("notesSaid"), F.col("provenance")["vitals.pulse"]["rawText"].alias("pulseSaid"))


@query(O.PATIENTS, O.VISITS, O.PRESCRIPTIONS, _DEID, select=f"""SELECT {_code_sql("c.id")} AS id, "patientId", notes, (SELECT count(*) FROM prescriptions p WHERE p."encounterId" = c.id) AS prescriptions,
  (SELECT count(*) FROM prescriptions p WHERE p."encounterId" = c.id AND p.notes = 'apres repas') AS said FROM clean c""")
def deid_strict(spark, d):
    """With ids under codes, and the notes of prescriptions scrubbed, too."""
    rows, _ = deid.deid_encounters(store.live(data.encounters(spark, d)), _live(spark, d)[0], SALT, True, strict=True)
    said = F.size(F.filter("prescriptions", lambda p: p["notes"] == "apres repas")).cast("long")
    return rows.select("id", "patientId", "notes", F.size("prescriptions").cast("long").alias("prescriptions"), said.alias("said"))


@query(O.PATIENTS, O.VISITS, _DEID, select="""SELECT 'pseudonymous' AS level, true AS "generalisedDates", (SELECT count(*) FROM known) AS "patientsProcessed", count(*) AS "encountersProcessed", 'givenName,familyName,birthDate,phone,address,registerNo,attachments' AS "fieldsRemoved", CAST(sum(redactions) AS BIGINT) AS "freeTextRedactions" FROM clean""")
def deid_manifest(spark, d):
    p, e = _live(spark, d)
    manifest = deid.deidentify(p, e, "pseudonymous", NOW, SALT, True)[2]
    return manifest.withColumn("fieldsRemoved", F.array_join("fieldsRemoved", ","))


@query(O.PATIENTS, O.VISITS, select="""SELECT 'anonymous' AS level, true AS "generalisedDates", count(*) AS patients, count(*) AS codes, CAST(0 AS BIGINT) AS "inBoth", (SELECT count(*) FROM visits WHERE "deletedAt" IS NULL) AS encounters,
  (SELECT count(*) FROM visits v JOIN patients p ON p.id = v."patientId" WHERE v."deletedAt" IS NULL AND p."deletedAt" IS NULL) AS linked FROM patients WHERE "deletedAt" IS NULL""")
def anonymous_export(spark, d):
    """Each export draws a salt of its own: codes are as many as patients, encounters keep to theirs, and a second export has none of them."""
    p, e = _live(spark, d)
    people, visits, manifest = deid.deidentify(p, e.select("id", "patientId", "occurredAt", "chiefComplaint", "diagnosis", "notes", "provenance", "attachmentIds", "syncedAt"), "anonymous", NOW)
    again = deid.deidentify(p, e.limit(0), "anonymous", NOW)[0].select("id")
    facts = people.agg(F.count("*").alias("patients"), F.count_distinct("id").alias("codes")).crossJoin(people.join(again, "id", "left_semi").agg(F.count("*").alias("inBoth")))  # one row each
    facts = facts.crossJoin(visits.agg(F.count("*").alias("encounters"))).crossJoin(visits.join(people.select(F.col("id").alias("patientId")), "patientId", "left_semi").agg(F.count("*").alias("linked")))
    return manifest.select("level", "generalisedDates").crossJoin(facts)


_PHONE_SQL = r"'\b(?:\+?261[\s.-]?)?0?\d{2}[\s.-]?\d{2}[\s.-]?\d{3}[\s.-]?\d{2}\b'"
_DIGITS_SQL = r"'\b\d{7,}\b'"


@query(select=f"""SELECT doc_id, regexp_replace(t, {_DIGITS_SQL}, '[…]', 'g') AS text, CAST(2 + n + len(regexp_extract_all(t, {_DIGITS_SQL})) AS INTEGER) AS redactions
  FROM (SELECT doc_id, regexp_replace(x, {_PHONE_SQL}, '[…]', 'g') AS t, len(regexp_extract_all(x, {_PHONE_SQL})) AS n FROM (SELECT doc_id, 'Vu […] avec […]. ' || text AS x FROM documents))""")
def scrub_notes(spark, d):
    family = data.pick(F.col("doc_id"), data.FAMILY_NAMES)
    other = data.pick(F.col("doc_id") + 1, data.FAMILY_NAMES)
    texts = data.table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.concat(F.lit("Vu "), family, F.lit(" avec "), F.lower(other), F.lit(". "), "text").alias("text"))
    named = data.patients(spark, d).select("familyName", *[F.lit(None).cast("string").alias(c) for c in ("givenName", "address", "registerNo")])
    return deid.scrub(texts, deid.roster_terms(named)).withColumnRenamed("key", "doc_id")


# --- bundle -----------------------------------------------------------------------------------------------------

_FINAL = """final AS (SELECT * FROM visits WHERE "deletedAt" IS NULL AND status = 'final')"""


def _bundle_rows(spark, d):
    return bundle.exported(store.live(data.encounters(spark, d)))


@query(O.PATIENTS, O.VISITS, O.PRESCRIPTIONS, _FINAL, _FLAGS, select="""SELECT 'Patient' AS "resourceType", count(*) AS n FROM patients WHERE "deletedAt" IS NULL UNION ALL SELECT 'Encounter', count(*) FROM final
  UNION ALL SELECT 'Observation', (SELECT count(*) FROM flags JOIN final USING (id) WHERE vital NOT IN ('systolic', 'diastolic')) + (SELECT count(*) FROM final WHERE systolic IS NOT NULL OR diastolic IS NOT NULL)
  UNION ALL SELECT 'MedicationRequest', count(*) FROM prescriptions JOIN final f ON f.id = "encounterId\"""")
def bundle_counts(spark, d):
    entries = bundle.bundle_entries(_live(spark, d)[0], store.live(data.encounters(spark, d)), NOW, json=False)
    return entries.groupBy("resourceType").agg(F.count("*").alias("n"))


@query(O.PATIENTS, select="""SELECT id, sex AS gender, "birthDate", phone AS telecom, address, "registerNo" AS identifier, "familyName" AS family, CASE WHEN "birthDate" IS NULL THEN "approximateAge" END AS age
  FROM (SELECT * REPLACE (nullif(phone, '') AS phone) FROM patients) WHERE "deletedAt" IS NULL""")
def bundle_patients(spark, d):
    r = bundle.patient_resources(_live(spark, d)[0], NOW)
    return r.select("id", "resource.gender", "resource.birthDate", F.col("resource.telecom")[0]["value"].alias("telecom"), F.col("resource.address")[0]["text"].alias("address"), F.col("resource.identifier")[0]["value"].alias("identifier"), F.col("resource.name")[0]["family"].alias("family"), F.col("resource.extension")[0]["valueInteger"].alias("age"))


_ISO = """strftime(make_timestamp("occurredAt" * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"""


@query(O.VISITS, _FINAL, select=f"""SELECT id, 'finished' AS status, 'Patient/' || "patientId" AS subject, {_ISO} AS start, nullif("chiefComplaint", '') AS reason, nullif(diagnosis, '') AS diagnosis FROM final""")
def bundle_encounters(spark, d):
    r = bundle.encounter_resources(bundle.exported(_live(spark, d)[1]))
    return r.select("id", "resource.status", F.col("resource.subject.reference").alias("subject"), F.col("resource.period.start").alias("start"), F.col("resource.reasonCode")[0]["text"].alias("reason"), F.col("resource.diagnosis")[0]["condition"]["display"].alias("diagnosis"))


@query(O.VISITS, _FINAL, _FLAGS, select="""SELECT id || '-' || vital AS id, value, CASE vital WHEN 'temperature' THEN '8310-5' WHEN 'pulse' THEN '8867-4' WHEN 'respiratoryRate' THEN '9279-1' WHEN 'weight' THEN '29463-7' WHEN 'height' THEN '8302-2' ELSE '59408-5' END AS loinc FROM flags JOIN final USING (id) WHERE vital NOT IN ('systolic', 'diastolic')""")
def bundle_observations(spark, d):
    o = bundle.observations(bundle.exported(_live(spark, d)[1]))
    return o.select("id", "value", F.col("resource.code.coding")[0]["code"].alias("loinc"))


@query(O.VISITS, _FINAL, select="""SELECT id || '-bp' AS id, systolic, diastolic, (systolic IS NOT NULL)::INTEGER + (diastolic IS NOT NULL)::INTEGER AS components FROM final WHERE systolic IS NOT NULL OR diastolic IS NOT NULL""")
def bundle_blood_pressure(spark, d):
    b = bundle.blood_pressures(bundle.exported(_live(spark, d)[1]))
    return b.select("id", "systolic", "diastolic", F.size("resource.component").alias("components"))


@query(O.VISITS, O.PRESCRIPTIONS, _FINAL, select="""SELECT "encounterId" || '-' || p.id AS id, drug, nullif(coalesce(dose, '') || CASE WHEN dose IS NOT NULL AND p.notes IS NOT NULL THEN ', ' ELSE '' END || coalesce(p.notes, ''), '') AS dosage, "frequencyPerDay" AS frequency, "durationDays" AS days FROM prescriptions p JOIN final f ON f.id = "encounterId\"""")
def bundle_medications(spark, d):
    return bundle.medication_requests(_bundle_rows(spark, d)).select("id", "drug", "dosage", "frequency", "days")


_MEASURED = "('temperature', 0, '8310-5'), ('pulse', 1, '8867-4'), ('respiratoryRate', 2, '9279-1'), ('weight', 3, '29463-7'), ('height', 4, '8302-2'), ('oxygenSaturation', 5, '59408-5')"


@query(O.PATIENTS, O.VISITS, O.PRESCRIPTIONS, _FINAL, _FLAGS, f"codes AS (SELECT * FROM (VALUES {_MEASURED}) c(vital, place, loinc))", select=f"""SELECT 0 AS part, id AS "encounterId", 0 AS section, 0 AS place, 'Patient' AS "resourceType", id AS rid, NULL AS subject, "familyName" AS said, NULL AS code, CAST(NULL AS DOUBLE) AS value, NULL AS at FROM patients WHERE "deletedAt" IS NULL
  UNION ALL SELECT 1, id, 0, 0, 'Encounter', id, 'Patient/' || "patientId", nullif("chiefComplaint", ''), NULL, NULL, {_ISO} FROM final
  UNION ALL SELECT 1, id, 1, place, 'Observation', id || '-' || vital, 'Patient/' || "patientId", NULL, loinc, value, {_ISO} FROM flags JOIN codes USING (vital) JOIN final USING (id)
  UNION ALL SELECT 1, id, 2, 0, 'Observation', id || '-bp', 'Patient/' || "patientId", NULL, '85354-9', NULL, {_ISO} FROM final WHERE systolic IS NOT NULL OR diastolic IS NOT NULL
  UNION ALL SELECT 1, f.id, 3, CAST(row_number() OVER (PARTITION BY f.id ORDER BY p.id) - 1 AS INTEGER), 'MedicationRequest', f.id || '-' || p.id, 'Patient/' || "patientId", drug, NULL, CAST("frequencyPerDay" AS DOUBLE), {_ISO} FROM prescriptions p JOIN final f ON f.id = "encounterId\"""")
def bundle_json(spark, d):
    """Every entry, its JSON parsed again."""
    e = bundle.bundle_entries(_live(spark, d)[0], store.live(data.encounters(spark, d)), NOW)
    ref = "struct<reference:string>"
    code = "struct<coding:array<struct<code:string>>>"
    shape = f"resourceType string, id string, subject {ref}, name array<struct<family:string>>, reasonCode array<struct<text:string>>, medicationCodeableConcept struct<text:string>, code {code}, valueQuantity struct<value:double>, dosageInstruction array<struct<timing:struct<repeat:struct<frequency:double>>>>, period struct<start:string>, effectiveDateTime string, authoredOn string"
    # a list of one, which no filter is pushed through: else each entry would be written and parsed twice
    j = e.select("part", "encounterId", "section", "place", F.col("fullUrl"), F.explode(F.array(F.from_json("json", shape))).alias("j"))
    j = j.filter(F.col("fullUrl") == F.concat(F.lit("urn:uuid:"), F.col("j.id")))
    said = F.coalesce(F.get("j.name", F.lit(0))["family"], F.get("j.reasonCode", F.lit(0))["text"], "j.medicationCodeableConcept.text")
    value = F.coalesce("j.valueQuantity.value", F.get("j.dosageInstruction", F.lit(0))["timing"]["repeat"]["frequency"])
    return j.select("part", "encounterId", "section", "place", "j.resourceType", F.col("j.id").alias("rid"), F.col("j.subject.reference").alias("subject"), said.alias("said"), F.get("j.code.coding", F.lit(0))["code"].alias("code"), value.alias("value"), F.coalesce("j.period.start", "j.effectiveDateTime", "j.authoredOn").alias("at"))


@query(O.PATIENTS, O.VISITS, O.PRESCRIPTIONS, _FINAL, _FLAGS, select="""SELECT 'Patient' AS "resourceType", count(*) AS n, min(id) AS first, max(id) AS last FROM patients WHERE "deletedAt" IS NULL UNION ALL SELECT 'Encounter', count(*), min(id), max(id) FROM final
  UNION ALL SELECT 'Observation', count(*), min(rid), max(rid) FROM (SELECT f.id || '-' || vital AS rid FROM flags JOIN final f USING (id) WHERE vital NOT IN ('systolic', 'diastolic') UNION ALL SELECT id || '-bp' FROM final WHERE systolic IS NOT NULL OR diastolic IS NOT NULL)
  UNION ALL SELECT 'MedicationRequest', count(*), min(rid), max(rid) FROM (SELECT f.id || '-' || p.id AS rid FROM prescriptions p JOIN final f ON f.id = "encounterId")""")
def bundle_document(spark, d):
    """The whole bundle, patients and encounters, written as one JSON document and read again entry by entry."""
    at = f"{scratch(spark)}/bundle.json.gz-joined"
    sinks.write_bundle(data.patients(spark, d), data.encounters(spark, d), NOW, at)
    entries = read_items(spark, at, "resource", "fullUrl string, resource struct<resourceType:string,id:string>").filter(F.col("fullUrl") == F.concat(F.lit("urn:uuid:"), F.col("resource.id")))
    return entries.groupBy("resource.resourceType").agg(F.count("*").alias("n"), F.min("resource.id").alias("first"), F.max("resource.id").alias("last"))


# --- change feed ------------------------------------------------------------------------------------------------

_STATE = 'SELECT "facilityId", kind, id, CAST("updatedAt" AS DOUBLE) AS "updatedAt", "deletedAt", seq, body FROM state'


@query(O.CHANGES, select=_STATE)
def lww_state(spark, d):
    return sync.apply_push(data.changes(spark, d))


@query(O.CHANGES, select="""SELECT "facilityId", push, kind, id, 'server_newer' AS reason, CAST(seen AS DOUBLE) AS "serverUpdatedAt" FROM judged WHERE "updatedAt" <= seen""")
def lww_conflicts(spark, d):
    return sync.conflicts(data.changes(spark, d))


@query(O.CHANGES, select='SELECT "facilityId", push, ord, kind, id, seq FROM accepted')
def sync_sequence(spark, d):
    return sync.sequenced(data.changes(spark, d)).select("facilityId", "push", "ord", "kind", "id", "seq")


@query(O.CHANGES, select='SELECT "facilityId", count(*) AS value FROM changes GROUP BY 1')
def sync_counters(spark, d):
    return sync.counters_after(data.changes(spark, d))


@query(O.CHANGES, select="""SELECT kind, id, body, seq FROM state WHERE "facilityId" = 'f1' AND seq > 20 ORDER BY seq LIMIT 25""")
def sync_page(spark, d):
    return sync.pull(sync.apply_push(data.changes(spark, d)), "f1", 20, 25)


@query(O.CHANGES, select="""SELECT max(seq) AS cursor, count(*) = 25 AS "hasMore", count(*) AS records FROM (SELECT seq FROM state WHERE "facilityId" = 'f1' AND seq > 20 ORDER BY seq LIMIT 25)""")
def sync_page_facts(spark, d):
    return sync.page_facts(sync.pull(sync.apply_push(data.changes(spark, d)), "f1", 20, 25), 20, 25)


_RESPONSES = """shown AS (SELECT *, lead(push) OVER (PARTITION BY "facilityId", kind, id ORDER BY seq) AS until FROM accepted),
asked AS (SELECT "facilityId", push, CASE push % 3 WHEN 0 THEN 0 ELSE push * 10 END AS cursor FROM counted),
sent AS (SELECT r."facilityId", r.push, row_number() OVER (PARTITION BY r."facilityId", r.push ORDER BY seq) AS place, kind, id, seq, body
  FROM asked r JOIN shown s ON s."facilityId" = r."facilityId" AND s.push <= r.push AND (until IS NULL OR until > r.push) AND seq > cursor QUALIFY place <= 100),
told AS (SELECT "facilityId", push, count(*) FILTER (seen IS NULL OR "updatedAt" > seen) AS pushed, count(*) FILTER ("updatedAt" <= seen) AS conflicts FROM judged GROUP BY ALL)"""


def _asked(spark, d):
    """Every push asks: one in three from a device that has nothing yet, the others from some way behind."""
    cursor = F.when(F.col("push") % 3 == 0, F.lit(0)).otherwise(F.col("push") * 10)
    return data.changes(spark, d).select("facilityId", "push").distinct().withColumn("cursor", cursor)


@query(O.CHANGES, _RESPONSES, select="""SELECT r."facilityId", r.push, any_value(pushed) AS pushed, any_value(conflicts) AS conflicts, count(seq) AS records, coalesce(max(seq), any_value(r.cursor)) AS cursor, count(seq) = 100 AS "hasMore"
  FROM asked r JOIN told USING ("facilityId", push) LEFT JOIN sent USING ("facilityId", push) GROUP BY 1, 2""")
def sync_responses(spark, d):
    """The answers to all pushes, each as of its own."""
    return sync.responses(_asked(spark, d), data.changes(spark, d), page=100)


@query(O.CHANGES, _RESPONSES, select='SELECT "facilityId", push, CAST(place AS INTEGER) AS place, kind, id, seq, body FROM sent')
def sync_response_pages(spark, d):
    return sync.pages(_asked(spark, d), data.changes(spark, d), page=100)


@query(O.CHANGES, select="""SELECT kind, id, body, seq FROM state WHERE "facilityId" = 'f1' AND seq > 300 ORDER BY seq LIMIT 25""")
def sync_stored_page(spark, d):
    """A page out of the files that hold it."""
    pages = PageStore(spark, scratch(spark))
    pages.write(sync.apply_push(data.changes(spark, d)), file_rows=200)
    return pages.pull("f1", 300, 25)


@query(select="""SELECT event_id, CASE WHEN event_id % 7 IN (0, 1, 2) THEN false ELSE true END AS valid, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'f' || event_id % 5 END AS facility, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id END AS cursor FROM events""")
def sync_validity(spark, d):
    e = F.col("event_id")
    id_ = F.when(e % 7 == 0, "").when(e % 7 == 1, F.repeat(F.lit("x"), F.lit(129))).otherwise("x")
    at = F.when(e % 7 == 2, F.lit(float("inf"))).otherwise(e.cast("double"))
    facility = F.when(e % 5 == 0, " \t\n ").otherwise(F.concat(F.lit("\tf"), (e % 5).cast("string"), F.lit("\n")))
    cursor = F.when(e % 3 == 0, "NaN").otherwise(e.cast("string"))
    return data.table(spark, d, "events").select("event_id", sync.valid(id_, at).alias("valid"), sync.clean_facility(facility).alias("facility"), sync.clean_cursor(cursor).alias("cursor"))


@query(O.CHANGES, select='SELECT "facilityId", kind, id, CAST("updatedAt" AS DOUBLE) AS "updatedAt" FROM state')
def sync_requests(spark, d):
    """The feed as JSON requests, one a push and facility, parsed and applied."""
    c = data.changes(spark, d)
    record = F.to_json(F.struct("id", "updatedAt", "deletedAt"))
    listed = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", record.alias("r"))))), lambda x: x["r"])
    changes = F.concat(F.lit('{"patients":['), F.array_join(F.col("p"), ","), F.lit('],"encounters":['), F.array_join(F.col("e"), ","), F.lit("]}"))
    requests = c.groupBy("facilityId", "push").agg(listed("patient").alias("p"), listed("encounter").alias("e"))
    lines = requests.select(F.concat(F.lit('{"facilityId":"'), "facilityId", F.lit('","push":'), F.col("push").cast("string"), F.lit(',"changes":'), changes, F.lit("}")).alias("value"))
    parsed, _ = sync.parse_requests(lines)
    return sync.apply_push(parsed).select("facilityId", "kind", "id", "updatedAt")


#: One for each event, with its number as that of the push.
_REQUESTS = (
    """{"facilityId":"\\tf1\\n","cursor":7,"push":@,"changes":{"patients":[{"id":5,"updatedAt":1},{"id":"5","updatedAt":1},{"id":"x","updatedAt":"2"},{"updatedAt":1},7,null],"encounters":[]}}""",
    """{"facilityId":"f2","cursor":"5","push":@,"changes":{"patients":[],"encounters":[{"id":"e","updatedAt":2.5,"deletedAt":3}]}}""",
    """{"facilityId":" \\t","push":@,"changes":{"patients":[{"id":"a","updatedAt":1}]}}""",
    """not JSON @""",
    """{"facilityId":"f3","push":@,"note":"%s","changes":{"patients":[{"id":"b","updatedAt":1}]}}""" % ("x" * 300),
    """{"facilityId":"f4","cursor":null,"push":@,"changes":{"patients":[{"id":"c","updatedAt":4}]}}""",
)


@query(select="""SELECT event_id AS push, 'f1' AS "facilityId", 7 AS cursor, 'patient' AS kind, '5' AS id, 1.0::DOUBLE AS "updatedAt", NULL::BIGINT AS "deletedAt" FROM events WHERE event_id % 6 = 0
  UNION ALL SELECT event_id, 'f2', 0, 'encounter', 'e', 2.5::DOUBLE, 3::BIGINT FROM events WHERE event_id % 6 = 1 UNION ALL SELECT event_id, 'f4', 0, 'patient', 'c', 4.0::DOUBLE, NULL::BIGINT FROM events WHERE event_id % 6 = 5
  UNION ALL SELECT -1, 'rejected', count(*)::INTEGER, NULL, NULL, NULL, NULL FROM events WHERE event_id % 6 IN (2, 3, 4)""")
def sync_request_rules(spark, d):
    """Ids that are no strings, cursors that are none, blank facilities, lines that are no JSON or too long."""
    k = F.col("event_id")
    lines = data.table(spark, d, "events").select(F.replace(data.pick(k, _REQUESTS), F.lit("@"), k.cast("string")).alias("value"))
    ok, bad = sync.parse_requests(lines, most_bytes=300)
    ok = ok.select("push", "facilityId", F.col("cursor").cast("int").alias("cursor"), "kind", "id", "updatedAt", "deletedAt")
    count = bad.agg(F.count("*").cast("int").alias("cursor")).select(F.lit(-1).cast("long").alias("push"), F.lit("rejected").alias("facilityId"), "cursor")
    return ok.unionByName(count, allowMissingColumns=True)


_ROUND = """here AS (SELECT k, "syncedAt" IS NULL AS dirty FROM patients), five AS (SELECT count(*) AS n FROM here WHERE k % 5 = 0),
sent AS (SELECT count(*) FILTER (dirty AND k % 5 <> 0) + (SELECT count(*) FROM visits WHERE "syncedAt" IS NULL AND status = 'final') AS accepted, count(*) FILTER (dirty AND k % 5 = 0) AS refused FROM here)"""


@query(O.PATIENTS, O.VISITS, _ROUND, select="""SELECT true AS ok, NULL AS error, accepted AS pushed, CAST(least(500, n) AS BIGINT) AS pulled, sent.refused AS conflicts, CAST(0 AS BIGINT) AS refused,
  CASE WHEN n >= 500 THEN 2496 WHEN accepted = 0 THEN 5 * n - 4 ELSE 1000000 + least(500 - n, accepted) END AS cursor FROM sent, five""")
def sync_round(spark, d):
    """A device whose server has newer versions of every fifth patient."""
    p, k = data.patients(spark, d), F.substring("id", 2, 20).cast("long")
    newer = p.filter(k % 5 == 0).withColumn("updatedAt", F.col("updatedAt") + 1000)
    state = newer.select(F.lit("f").alias("facilityId"), F.lit("patient").alias("kind"), "id", F.col("updatedAt").cast("double").alias("updatedAt"), "deletedAt", (k + 1).alias("seq"), F.to_json(F.struct("*")).alias("body"))
    counters = spark.createDataFrame([("f", 1_000_000)], "facilityId string, value long")
    return sync.sync_round(p, data.visits(spark, d), state, counters, "f", 0, 1, NOW).outcome


_REMOTE = """remote AS (SELECT CASE WHEN k % 10 = 0 THEN 'n' || k ELSE id END AS id, "updatedAt" + (k % 5 - 2) * 1000 AS "updatedAt" FROM visits WHERE k % 2 = 0)"""


def _remote(spark, d):
    k = F.substring("id", 2, 20).cast("long")
    r = data.visits(spark, d).filter(k % 2 == 0)
    return r.withColumns({"id": F.when(k % 10 == 0, F.concat(F.lit("n"), k.cast("string"))).otherwise(F.col("id")), "updatedAt": F.col("updatedAt") + (k % 5 - 2) * 1000, "status": F.lit("final")})


@query(O.VISITS, _REMOTE, select="""SELECT r.id, CASE WHEN v."updatedAt" >= r."updatedAt" THEN 'skipped' WHEN v.status = 'draft' THEN 'refused' ELSE 'pulled' END AS outcome FROM remote r LEFT JOIN visits v ON v.id = r.id""")
def client_decisions(spark, d):
    return sync.client_decisions(data.visits(spark, d), _remote(spark, d), True)


@query(O.VISITS, _REMOTE, select=f"""SELECT coalesce(r.id, v.id) AS id, coalesce(r."updatedAt", v."updatedAt") AS "updatedAt", CASE WHEN r.id IS NOT NULL THEN {NOW} ELSE v."syncedAt" END AS "syncedAt"
  FROM visits v FULL JOIN (SELECT r.* FROM remote r LEFT JOIN visits w ON w.id = r.id WHERE w.id IS NULL OR (w."updatedAt" < r."updatedAt" AND w.status <> 'draft')) r ON r.id = v.id""")
def client_apply(spark, d):
    return sync.client_apply(data.visits(spark, d), _remote(spark, d), NOW, True).select("id", "updatedAt", "syncedAt")


@query(O.VISITS, select=f"""SELECT id, CASE WHEN "syncedAt" IS NULL AND status = 'final' AND k % 4 <> 0 THEN {NOW} ELSE "syncedAt" END AS "syncedAt" FROM visits""")
def client_ack(spark, d):
    v = data.visits(spark, d)
    k = F.substring("id", 2, 20).cast("long")
    pushed = store.dirty(v, True).withColumn("updatedAt", F.when(k % 4 == 0, F.col("updatedAt") - 1).otherwise(F.col("updatedAt")))
    return sync.acknowledge(v, pushed, NOW).select("id", "syncedAt")


@query(O.CHANGES, select=_STATE)
def stream_lww(spark, d):
    """The feed arrives in two parts, and one stream under one checkpoint merges both, each as a micro-batch."""
    at, c = scratch(spark), data.changes(spark, d)
    half = (c.agg(F.max("push")).first()[0] or 0) // 2
    snapshots = Snapshots(spark, f"{at}/state")
    for part in (F.col("push") <= half, F.col("push") > half):
        c.filter(part).write.mode("append").parquet(f"{at}/in")
        start_feed(read_changes(spark, f"{at}/in"), snapshots, f"{at}/checkpoint").awaitTermination()
    return snapshots.latest()


def _visit_changes(spark, d):
    """All visits; then a third of them again, final now and some deleted; then a third of those again, with another patient."""
    k = F.substring("id", 2, 20).cast("long")
    first = data.visits(spark, d).select("id", "patientId", "occurredAt", "status", "updatedAt", "deletedAt").withColumn("movedFrom", F.lit(None).cast("string"))
    second = first.filter(k % 3 == 0).withColumns({"updatedAt": F.col("updatedAt") + 1, "status": F.lit("final"), "deletedAt": F.when(k % 2 == 0, F.lit(5)).cast("long")})
    third = second.filter(k % 9 == 0).withColumns({"updatedAt": F.col("updatedAt") + 1, "movedFrom": F.col("patientId"), "patientId": F.lit("p1")})
    return first, second, third


_CHANGED_VISITS = """visits2 AS (SELECT * REPLACE (CASE WHEN k % 9 = 0 THEN 'p1' ELSE "patientId" END AS "patientId", CASE WHEN k % 3 = 0 THEN 'final' ELSE status END AS status, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 5 END ELSE "deletedAt" END AS "deletedAt") FROM visits)"""


@query(O.VISITS, _CHANGED_VISITS, select=f"""SELECT "patientId", max(CASE WHEN status <> 'draft' THEN "occurredAt" END) AS "lastVisit", bool_or(status = 'draft') AS "hasDraft", bool_or(status <> 'draft' AND "occurredAt" >= {DAY_START}) AS "seenToday" FROM visits2 WHERE "deletedAt" IS NULL GROUP BY 1""")
def live_annotations(spark, d):
    """Kept up to date by a stream in which visits are deleted, finalised and moved; the last part comes twice."""
    at = scratch(spark)
    view = live_views.annotation_table(spark, f"{at}/view", buckets=16)
    parts = _visit_changes(spark, d)
    for part in (*parts, parts[2]):
        part.write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(live_views.VISIT_CHANGES).parquet(f"{at}/in")
        live_views.start_annotations(stream, view, f"{at}/checkpoint").awaitTermination()
    return live_views.live_annotations(view, DAY_START)


@query(O.PATIENTS, O.VISITS, _CHANGED_VISITS, """patients2 AS (SELECT * REPLACE (CASE WHEN k % 4 = 0 THEN 'male' ELSE sex END AS sex, CASE WHEN k % 7 = 0 THEN 7 ELSE "deletedAt" END AS "deletedAt") FROM patients)""", O.CELLS.replace("FROM visits v", "FROM visits2 v").replace("FROM patients", "FROM patients2"), select='SELECT indicator, "ageBand", sex, count FROM cells')
def live_report(spark, d):
    """The month's report after three batches of changes, to visits and to patients, each added as a difference."""
    p, v = data.patients(spark, d), data.visits(spark, d)
    k = F.substring("id", 2, 20).cast("long")
    _, second, third = _visit_changes(spark, d)
    whole = lambda part: v.drop("patientId", "status", "updatedAt", "deletedAt").join(part.select("id", "patientId", "status", "updatedAt", "deletedAt"), "id").select(v.columns)
    newer = p.filter((k % 4 == 0) | (k % 7 == 0)).withColumns({"updatedAt": F.col("updatedAt") + 1, "sex": F.when(k % 4 == 0, "male").otherwise(F.col("sex")), "deletedAt": F.when(k % 7 == 0, F.lit(7)).otherwise(F.col("deletedAt"))})
    kept = live_views.LiveReport(spark, scratch(spark), p.schema, v.schema, YEAR, MONTH, buckets=16)
    for batch, (people, visits) in enumerate(((p, v), (newer, whole(second)), (p.limit(0), whole(third)))):
        kept.merge(people, visits, "feed", batch)
        kept.drop_old()
    return kept.cells()


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares; in local runs a temporary one."""
    return f"{shared_folder(spark)}/dispensary-{uuid.uuid4().hex}"


# --- extraction and merges --------------------------------------------------------------------------------------


def _extracted(spark, d):
    return data.dictations(spark, d).select("conv_id", "turn", "text", extraction(F.col("text"), F.lit("fr")).alias("x"))


@query(select=f"SELECT conv_id, turn, temperature, pulse, systolic, diastolic FROM ({O.dictation_numbers()})")
def extract_vitals(spark, d):
    return _extracted(spark, d).select("conv_id", "turn", *[F.col(f"x.vitals.{v}.value").alias(v) for v in ("temperature", "pulse", "systolic", "diastolic")])


@query(select=f"SELECT conv_id, turn, drug, dose, CAST(frequency AS INTEGER) AS frequency, CAST(days AS INTEGER) AS days FROM ({O.dictation_numbers()})")
def extract_prescriptions(spark, d):
    p = _extracted(spark, d).select("conv_id", "turn", F.explode("x.prescriptions").alias("p"))
    return p.select("conv_id", "turn", "p.drug", "p.dose", F.col("p.frequencyPerDay").alias("frequency"), F.col("p.durationDays").alias("days"))


@query(select=f"SELECT conv_id, turn, complaint, diagnosis, 'Prescrire. Revoir si besoin' AS remainder FROM ({O.dictation_numbers()})")
def extract_narrative(spark, d):
    return _extracted(spark, d).select("conv_id", "turn", F.col("x.chiefComplaint.value").alias("complaint"), F.col("x.diagnosis.value").alias("diagnosis"), "x.remainder")


def _said(c: str, values: tuple) -> str:
    return f"CASE ({c}) % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _vitals_said(x: str):
    return [F.col(f"x.vitals.{v}.value").alias(v) for v in x.split()]


def _drugs_said(df: DataFrame) -> DataFrame:
    p = df.select("conv_id", "turn", F.posexplode("x.prescriptions").alias("i", "p"))
    return p.select("conv_id", "turn", "i", F.lower("p.drug").alias("drug"), "p.dose", F.col("p.frequencyPerDay").alias("frequency"), F.col("p.durationDays").alias("days"))


_CT = "conv_id + turn"


@query(select=f"""SELECT conv_id, turn, CASE WHEN ({_CT}) % 4 <> 0 THEN CAST((conv_id * 7 + turn) % 5 + 36 AS DOUBLE) + ({_CT}) % 10 / 10.0 END AS temperature, CAST((conv_id * 3 + turn) % 60 + 60 AS DOUBLE) AS pulse, CAST(({_CT}) % 60 + 100 AS DOUBLE) AS systolic, CAST(({_CT}) % 30 + 60 AS DOUBLE) AS diastolic,
  CAST({_said(_CT, (91, 92, 95))} AS DOUBLE) AS "oxygenSaturation", 'cough for ' || (turn + 2) || ' days' AS complaint, {_said(_CT, ("'malaria'", "'pneumonia'", "'simple cough'"))} AS diagnosis FROM conversations""")
def extract_english(spark, d):
    x = data.dictations_en(spark, d).withColumn("x", extraction(F.col("text"), F.lit("en")))
    return x.select("conv_id", "turn", *_vitals_said("temperature pulse systolic diastolic oxygenSaturation"), F.col("x.chiefComplaint.value").alias("complaint"), F.col("x.diagnosis.value").alias("diagnosis"))


@query(select=f"""SELECT conv_id, turn, 0 AS i, 'amoxicillin clavulanic acid' AS drug, '250 mg' AS dose, {_said(_CT, (6, 4, 3, 2))} AS frequency, CAST((conv_id % 3 + 1) * 7 AS INTEGER) AS days FROM conversations
  UNION ALL SELECT conv_id, turn, 1, 'paracetamol', '2 tablets', {_said(_CT, (1, 2, 3, 4, 2))}, CAST((conv_id * 5 + turn) % 14 + 1 AS INTEGER) FROM conversations""")
def extract_english_prescriptions(spark, d):
    return _drugs_said(data.dictations_en(spark, d).withColumn("x", extraction(F.col("text"), F.lit("en"))))


@query(select=f"""SELECT conv_id, turn, CASE WHEN ({_CT}) % 3 <> 0 THEN 38.5::DOUBLE END AS temperature, CAST({_said(_CT, (97, 71, 120))} AS DOUBLE) AS pulse, CAST((({_CT}) % 8 + 10) * 10 AS DOUBLE) AS systolic, CAST((({_CT}) % 4 + 6) * 10 AS DOUBLE) AS diastolic, 'fièvre' AS complaint, {_said(_CT, ("'angine'", "'HTA'"))} AS diagnosis FROM conversations""")
def extract_odd(spark, d):
    x = data.dictations_odd(spark, d).withColumn("x", extraction(F.col("text"), F.lit("fr")))
    return x.select("conv_id", "turn", *_vitals_said("temperature pulse systolic diastolic"), F.col("x.chiefComplaint.value").alias("complaint"), F.col("x.diagnosis.value").alias("diagnosis"))


@query(select=f"""SELECT conv_id, turn, 0 AS i, 'artéméther luméfantrine' AS drug, '4 comprimes' AS dose, {_said(_CT, (4, 3, 2))} AS frequency, CAST(conv_id % 12 + 1 AS INTEGER) AS days FROM conversations
  UNION ALL SELECT conv_id, turn, 1, 'amoxicilline', '500 mg', {_said(_CT, (2, 3, 1))}, {_said(_CT, (7, 14, 21))} FROM conversations""")
def extract_odd_prescriptions(spark, d):
    return _drugs_said(data.dictations_odd(spark, d).withColumn("x", extraction(F.col("text"), F.lit("fr"))))


_SPOKEN = [("trente-huit virgule cinq", "fr", 38.5), ("quatre-vingt-dix-sept", "fr", 97.0), ("soixante et onze", "fr", 71.0), ("deux cent trois", "fr", 203.0), ("trente-sept et demi", "fr", 37.5), ("bonjour", "fr", None), ("one hundred and twenty", "en", 120.0), ("thirty-eight point five", "en", 38.5), ("ninety nine and a half", "en", 99.5), ("two thousand", "en", 2000.0), ("hello", "en", None)]


@query(select=f"""SELECT conv_id, turn, {O.case("(conv_id * 3 + turn)", tuple(t for t, _, _ in _SPOKEN))} AS phrase, {_said("conv_id * 3 + turn", tuple("CAST(NULL AS DOUBLE)" if v is None else f"CAST({v} AS DOUBLE)" for _, _, v in _SPOKEN))} AS value FROM conversations""")
def number_words(spark, d):
    """A spoken number for each turn."""
    which = F.col("conv_id") * 3 + F.col("turn")
    p = data.table(spark, d, "conversations").select("conv_id", "turn", data.pick(which, tuple(t for t, _, _ in _SPOKEN)).alias("phrase"), data.pick(which, tuple(lang for _, lang, _ in _SPOKEN)).alias("lang"))
    return p.select("conv_id", "turn", "phrase", F.when(F.col("lang") == "fr", spoken_number(F.col("phrase"), "fr")).otherwise(spoken_number(F.col("phrase"), "en")).alias("value"))


@query(O.VISITS, O.PRESCRIPTIONS, select=f"""SELECT n.conv_id, n.turn, coalesce(v.pulse, n.pulse) AS pulse, CASE WHEN coalesce(v.diagnosis, '') = '' THEN n.diagnosis ELSE v.diagnosis END AS diagnosis,
  CAST((v.temperature IS NULL)::INTEGER + (v.pulse IS NULL)::INTEGER + (v.systolic IS NULL)::INTEGER + (v.diastolic IS NULL)::INTEGER + (coalesce(v."chiefComplaint", '') = '')::INTEGER + (coalesce(v.diagnosis, '') = '')::INTEGER + 1 + (v.id NOT IN (SELECT "encounterId" FROM prescriptions p WHERE p.drug = 'paracétamol'))::INTEGER AS INTEGER) AS applied,
  (SELECT count(*) FROM prescriptions p WHERE p."encounterId" = v.id) + (v.id NOT IN (SELECT "encounterId" FROM prescriptions p WHERE p.drug = 'paracétamol'))::INTEGER AS prescriptions,
  coalesce(v.notes || E'\\n', '') || 'Prescrire. Revoir si besoin' AS notes FROM ({O.dictation_numbers()}) n JOIN visits v ON v.k = n.conv_id * 8 + n.turn + 1""")
def merge_extraction(spark, d):
    v = data.encounters(spark, d)
    x = _extracted(spark, d).select(F.concat(F.lit("e"), (F.col("conv_id") * 8 + F.col("turn") + 1).cast("string")).alias("id"), "conv_id", "turn", F.col("text").alias("rawText"), F.col("x").alias("extraction"))
    merged = merge.merge_extraction(v.join(x, "id"))
    return merged.select("conv_id", "turn", "vitals.pulse", "diagnosis", "applied", "notes", F.size("prescriptions").cast("long").alias("prescriptions"))


_PAIRS = """pairs AS (SELECT 'p' || k AS "keepId", 'p' || (k + 1) AS "duplicateId", k FROM patients WHERE k % 2 = 0 AND k + 1 IN (SELECT k FROM patients)),
merged AS (SELECT "keepId", "duplicateId", a."givenName" = '' AND b."givenName" <> '' AS g, a."birthDate" IS NULL AND b."birthDate" IS NOT NULL AS bd, a."approximateAge" IS NULL AND b."approximateAge" IS NOT NULL AS ag,
  coalesce(a.phone, '') = '' AND coalesce(b.phone, '') <> '' AS ph, a.address IS NULL AND b.address IS NOT NULL AS ad, a."registerNo" IS NULL AND b."registerNo" IS NOT NULL AS rg, a.sex = 'unknown' AND b.sex <> 'unknown' AS sx,
  a."birthDate" AS abd, b."birthDate" AS bbd, a.sex AS asx, b.sex AS bsx, a."birthDatePrecision" AS apr, b."birthDatePrecision" AS bpr
  FROM pairs JOIN patients a ON a.id = "keepId" JOIN patients b ON b.id = "duplicateId")"""
_FILLED = """array_to_string(list_filter([CASE WHEN g THEN 'givenName' END, CASE WHEN bd THEN 'birthDate' END, CASE WHEN ag THEN 'approximateAge' END, CASE WHEN ph THEN 'phone' END, CASE WHEN ad THEN 'address' END, CASE WHEN rg THEN 'registerNo' END, CASE WHEN sx THEN 'sex' END], lambda x: x IS NOT NULL), ',')"""


def _pairs(spark, d):
    ids = data.patients(spark, d).select(F.substring("id", 2, 20).cast("long").alias("k"))
    both = ids.filter("k % 2 = 0").join(ids.select((F.col("k") - 1).alias("k")), "k", "left_semi")
    return both.select(F.concat(F.lit("p"), F.col("k").cast("string")).alias("keepId"), F.concat(F.lit("p"), (F.col("k") + 1).cast("string")).alias("duplicateId"))


@query(O.PATIENTS, _PAIRS, select=f"""SELECT "keepId", "duplicateId", {_FILLED} AS filled, CASE WHEN bd THEN bbd ELSE abd END AS "birthDate", CASE WHEN bd THEN bpr ELSE apr END AS "birthDatePrecision", CASE WHEN sx THEN bsx ELSE asx END AS sex FROM merged""")
def merge_fields(spark, d):
    return merge.merge_fields(_pairs(spark, d), data.patients(spark, d)).select("keepId", "duplicateId", F.array_join("filled", ",").alias("filled"), "birthDate", "birthDatePrecision", "sex")


@query(O.PATIENTS, O.VISITS, _PAIRS, select=f"""SELECT "keepId", "duplicateId", count(v.id) AS moved, {_FILLED} AS filled FROM merged LEFT JOIN visits v ON v."patientId" = "duplicateId" GROUP BY ALL""")
def merge_patients(spark, d):
    outcome = merge.merge_patients(data.patients(spark, d), data.visits(spark, d), _pairs(spark, d), NOW)[2]
    return outcome.withColumn("filled", F.array_join("filled", ","))


@query(O.PATIENTS, O.VISITS, _PAIRS, select=f"""SELECT v.id, coalesce("keepId", "patientId") AS "patientId", CASE WHEN "keepId" IS NULL THEN "updatedAt" ELSE {NOW} END AS "updatedAt", CASE WHEN "keepId" IS NULL THEN "syncedAt" END AS "syncedAt" FROM visits v LEFT JOIN merged ON "patientId" = "duplicateId\"""")
def merged_encounters(spark, d):
    return merge.merge_patients(data.patients(spark, d), data.visits(spark, d), _pairs(spark, d), NOW)[1].select("id", "patientId", "updatedAt", "syncedAt")


_LOG = """log AS (SELECT k // 6 * 10 + CASE k // 6 % 3 WHEN 0 THEN 5 - k % 6 WHEN 1 THEN k % 6 ELSE k % 6 END AS ord, 'p' || CASE WHEN k // 6 % 3 = 2 THEN k // 6 * 6 ELSE k - 1 END AS "keepId", 'p' || k AS "duplicateId" FROM patients WHERE k % 6 > 0 AND k // 6 * 6 IN (SELECT k FROM patients)),
stamped AS (SELECT *, 1700000000000 + ord AS ms FROM log),
walks AS (SELECT "duplicateId" AS start, min(ord) AS ord FROM log GROUP BY 1 UNION ALL
  SELECT w.start, n.ord FROM walks w JOIN log l USING (ord), LATERAL (SELECT min(m.ord) AS ord FROM log m WHERE m."duplicateId" = l."keepId" AND m.ord > l.ord) n WHERE n.ord IS NOT NULL),
ends AS (SELECT start, max(ord) AS ord FROM walks GROUP BY 1),
leaves AS (SELECT DISTINCT "keepId" AS root, "keepId" AS x, []::BIGINT[] AS path, 1000000000000 AS moment FROM log UNION ALL SELECT root, l."duplicateId", list_append(path, l.ord), l.ord FROM leaves v JOIN log l ON l."keepId" = v.x AND l.ord < v.moment),
""" + """valued AS (SELECT v.*, p.* FROM leaves v JOIN patients p ON p.id = v.x),
gained AS (SELECT root, """ + ", ".join(f"""arg_min("{f}", path) FILTER ({t}) AS "{f}", arg_min(path, path) FILTER ({t})[1] AS "{f}By\"""" for f, t in (("givenName", "\"givenName\" <> ''"), ("birthDate", '"birthDate" IS NOT NULL'), ("approximateAge", '"approximateAge" IS NOT NULL'), ("phone", "phone <> ''"), ("address", 'address IS NOT NULL'), ("registerNo", '"registerNo" IS NOT NULL'), ("sex", "sex <> 'unknown'"))) + """ FROM valued GROUP BY 1)"""


def _merge_log(spark, d):
    """Six patients after six: a chain merged from its end, so that all arrives at the first; one merged from its beginning, so that each step goes one on; a star."""
    k = data.patients(spark, d).select(F.substring("id", 2, 20).cast("long").alias("k"))
    g = F.floor(F.col("k") / 6)
    heads = k.filter("k % 6 = 0").select(F.floor(F.col("k") / 6).alias("g"))
    rows = k.filter("k % 6 > 0").withColumn("g", g).join(heads, "g", "left_semi")
    of = lambda x: F.concat(F.lit("p"), x.cast("string"))
    ord_ = F.col("g") * 10 + F.when(F.col("g") % 3 == 0, 5 - F.col("k") % 6).otherwise(F.col("k") % 6)
    rows = rows.select(ord_.alias("ord"), of(F.when(F.col("g") % 3 == 2, F.col("g") * 6).otherwise(F.col("k") - 1)).alias("keepId"), of(F.col("k")).alias("duplicateId"))
    return rows.withColumn("at", F.lit(1700000000000) + F.col("ord"))


def _merged_by_log(spark, d):
    return mergelog.apply_merge_log(data.patients(spark, d), data.visits(spark, d), _merge_log(spark, d))


@query("RECURSIVE " + O.PATIENTS, _LOG, select="""SELECT p.id, coalesce(g."givenName", p."givenName") AS "givenName", coalesce(g."birthDate", p."birthDate") AS "birthDate", CASE WHEN g."birthDate" IS NOT NULL THEN 'day' ELSE p."birthDatePrecision" END AS "birthDatePrecision",
  CAST(coalesce(g."approximateAge", p."approximateAge") AS INTEGER) AS "approximateAge", coalesce(g.phone, p.phone) AS phone, coalesce(g.address, p.address) AS address, coalesce(g."registerNo", p."registerNo") AS "registerNo", coalesce(g.sex, p.sex) AS sex,
  coalesce(d.ms, p."deletedAt") AS "deletedAt", coalesce(greatest(d.ms, k.ms), p."updatedAt") AS "updatedAt", CASE WHEN d.ms IS NULL AND k.ms IS NULL THEN p."syncedAt" END AS "syncedAt"
  FROM patients p LEFT JOIN gained g ON g.root = p.id LEFT JOIN (SELECT "duplicateId" AS id, max(ms) AS ms FROM stamped GROUP BY 1) d ON d.id = p.id LEFT JOIN (SELECT "keepId" AS id, max(ms) AS ms FROM stamped GROUP BY 1) k ON k.id = p.id""")
def merge_log_patients(spark, d):
    return _merged_by_log(spark, d)[0].select("id", "givenName", "birthDate", "birthDatePrecision", "approximateAge", "phone", "address", "registerNo", "sex", "deletedAt", "updatedAt", "syncedAt")


@query("RECURSIVE " + O.PATIENTS, O.VISITS, _LOG, select="""SELECT v.id, coalesce(l."keepId", v."patientId") AS "patientId", coalesce(l.ms, v."updatedAt") AS "updatedAt", CASE WHEN l.ms IS NULL THEN v."syncedAt" END AS "syncedAt"
  FROM visits v LEFT JOIN ends e ON e.start = v."patientId" LEFT JOIN stamped l ON l.ord = e.ord""")
def merge_log_encounters(spark, d):
    return _merged_by_log(spark, d)[1].select("id", "patientId", "updatedAt", "syncedAt")


@query("RECURSIVE " + O.PATIENTS, O.VISITS, _LOG, select="""SELECT l.ord, l."keepId", l."duplicateId", (SELECT count(*) FROM walks w JOIN visits v ON v."patientId" = w.start WHERE w.ord = l.ord) AS moved,
  array_to_string(list_filter([CASE WHEN "givenNameBy" = l.ord THEN 'givenName' END, CASE WHEN "birthDateBy" = l.ord THEN 'birthDate' END, CASE WHEN "approximateAgeBy" = l.ord THEN 'approximateAge' END, CASE WHEN "phoneBy" = l.ord THEN 'phone' END, CASE WHEN "addressBy" = l.ord THEN 'address' END, CASE WHEN "registerNoBy" = l.ord THEN 'registerNo' END, CASE WHEN "sexBy" = l.ord THEN 'sex' END], lambda x: x IS NOT NULL), ',') AS filled
  FROM log l JOIN gained g ON g.root = l."keepId\"""")
def merge_log_outcome(spark, d):
    return _merged_by_log(spark, d)[2].withColumn("filled", F.array_join("filled", ","))


# --- changes and sinks ------------------------------------------------------------------------------------------


@query(O.PATIENTS, select=f"""SELECT id, CASE WHEN id = 'p5' THEN '033 00 000 00' ELSE phone END AS phone, CASE WHEN id = 'p5' THEN 'rakotoarisoa voahirana 033 00 000 00' ELSE "searchKey" END AS "searchKey", CASE WHEN id = 'p5' THEN {NOW} ELSE "updatedAt" END AS "updatedAt" FROM keyed""")
def update_patient(spark, d):
    return store.update_patient(data.patients(spark, d), "p5", NOW, phone=F.lit("033 00 000 00")).select("id", "phone", "searchKey", "updatedAt")


@query(O.VISITS, select=f"""SELECT id, CASE WHEN id = 'e7' THEN 99.0 ELSE pulse END AS pulse, systolic, CASE WHEN id = 'e7' THEN NULL ELSE notes END AS notes, CASE WHEN id = 'e7' THEN 'final' ELSE status END AS status, CASE WHEN id = 'e7' THEN {NOW} + 1 ELSE "updatedAt" END AS "updatedAt", 2 + (id = 'e7')::INTEGER AS fields FROM visits""")
def patch_and_finalise(spark, d):
    said = F.create_map(F.lit("diagnosis"), F.struct(F.lit("manual").alias("source"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("rawText")))
    e = store.patch_encounter(data.visits(spark, d), "e7", NOW, vitals={"pulse": F.lit(99)}, provenance=said, notes=F.lit(None))
    return store.finalise(e, "e7", NOW + 1).select("id", "vitals.pulse", "vitals.systolic", "notes", "status", "updatedAt", F.size("provenance").alias("fields"))


@query(O.VISITS, select=f"""SELECT id, CASE WHEN "patientId" = 'p7' THEN {NOW} ELSE "deletedAt" END AS "deletedAt", CASE WHEN "patientId" <> 'p7' AND k % 11 = 0 THEN 1 ELSE 0 END AS attachments FROM visits""")
def delete_patient(spark, d):
    v = data.visits(spark, d)
    files = v.select(F.explode("attachmentIds").alias("id"), F.col("id").alias("encounterId"))
    e = store.delete_patient(data.patients(spark, d), v, files, "p7", NOW)[1]
    return e.select("id", "deletedAt", F.size("attachmentIds").alias("attachments"))


@query(O.VISITS, select="""SELECT 'a' || k AS id, id AS "encounterId" FROM visits WHERE k % 11 = 0 AND "patientId" <> 'p7'""")
def deleted_attachments(spark, d):
    """The attachments that are left after a patient's deletion; theirs go for good."""
    v = data.visits(spark, d)
    files = v.select(F.explode("attachmentIds").alias("id"), F.col("id").alias("encounterId"))
    return store.delete_patient(data.patients(spark, d), v, files, "p7", NOW)[2].select("id", "encounterId")


@query(O.VISITS, select=f"""SELECT id, CASE WHEN id = 'e11' THEN {NOW} ELSE "deletedAt" END AS "deletedAt", CASE WHEN id <> 'e11' AND k % 11 = 0 THEN 1 ELSE 0 END AS attachments, CASE WHEN id <> 'e11' THEN "syncedAt" END AS "syncedAt" FROM visits""")
def delete_encounter(spark, d):
    return store.delete_encounter(data.visits(spark, d), "e11", NOW).select("id", "deletedAt", F.size("attachmentIds").alias("attachments"), "syncedAt")


def _entry(k, ord_: int, op: str, **values) -> Column:
    """An entry of the log; the order is that of the kinds of entries, then that of the records."""
    sets = values.get("sets")
    return F.struct((F.lit(ord_ * 10**10) + k).alias("ord"), F.lit(1700000000000 + ord_ * 1000).alias("at"), F.lit(op).alias("op"), (F.lit(None) if sets is None else F.to_json(sets)).cast("string").alias("sets"), F.array(*[F.lit(x) for x in values.get("erase", ())]).cast("array<string>").alias("erase"), values.get("attachment", F.lit(None)).cast("string").alias("attachmentId"))


def _read_log(rows: DataFrame, entries: list[Column], schema: str) -> DataFrame:
    kind = StructType.fromDDL(schema)
    log = rows.select("id", F.explode(F.array_compact(F.array(*entries))).alias("p")).select("id", "p.*")
    return log.withColumn("sets", F.from_json("sets", kind["sets"].dataType)).select([F.col(c) for c in kind.names if c in log.columns])


def _encounter_log(spark, d):
    """Up to eight entries an encounter: values set and erased again, provenance, both states, attachments, tombstones."""
    v = data.visits(spark, d).select("id")
    k = F.substring("id", 2, 20).cast("long")
    manual = F.create_map(F.lit("diagnosis"), F.struct(F.lit("manual").alias("source")))
    named = lambda x: F.concat(F.lit(x), k.cast("string"))
    return _read_log(v, [
        F.when(k % 3 == 0, _entry(k, 1, "patch", sets=F.struct(F.struct((k % 50 + 50).cast("double").alias("pulse")).alias("vitals"), F.lit("revu").alias("diagnosis")))),
        F.when(k % 6 == 0, _entry(k, 2, "patch", sets=F.struct(named("note ").alias("notes")), erase=("vitals.pulse",))),
        F.when(k % 7 == 0, _entry(k, 3, "patch", sets=F.struct(manual.alias("provenance")))),
        F.when(k % 4 == 0, _entry(k, 4, "finalise")),
        F.when(k % 5 == 0, _entry(k, 5, "attach", attachment=named("b"))),
        F.when(k % 22 == 0, _entry(k, 6, "detach", attachment=named("a"))),
        F.when(k % 13 == 0, _entry(k, 7, "delete")),
        F.when(k % 26 == 0, _entry(k, 8, "attach", attachment=named("c"))),
    ], patches.ENCOUNTER_PATCHES)


def _patient_log(spark, d):
    p = data.patients(spark, d).select("id")
    k = F.substring("id", 2, 20).cast("long")
    return _read_log(p, [
        F.when(k % 3 == 0, _entry(k, 1, "update", sets=F.struct(F.lit("099 00").alias("phone")))),
        F.when(k % 6 == 0, _entry(k, 2, "update", erase=("phone",))),
        F.when(k % 10 == 0, _entry(k, 3, "update", sets=F.struct(F.lit("NOUVÉAU").alias("familyName")))),
        F.when(k % 17 == 0, _entry(k, 9, "delete")),
    ], patches.PATIENT_PATCHES)


_GONE = """CASE WHEN "patientId" <> 'ghost' THEN CAST(substr("patientId", 2) AS BIGINT) % 17 = 0 AND "patientId" IN (SELECT id FROM patients) ELSE false END AS gone"""


@query(O.PATIENTS, O.VISITS, f"""own AS (SELECT *, {_GONE} FROM visits)""", select="""SELECT id, CASE WHEN k % 6 = 0 THEN NULL WHEN k % 3 = 0 THEN CAST(k % 50 + 50 AS DOUBLE) ELSE pulse END AS pulse, systolic, CASE WHEN k % 3 = 0 THEN 'revu' ELSE diagnosis END AS diagnosis, CASE WHEN k % 6 = 0 THEN 'note ' || k ELSE notes END AS notes,
  CASE WHEN k % 4 = 0 THEN 'final' ELSE status END AS status, CASE WHEN k % 7 = 0 THEN 3 ELSE 2 END AS said, CASE WHEN gone THEN 1700000009000 WHEN k % 13 = 0 THEN 1700000007000 ELSE "deletedAt" END AS "deletedAt",
  CASE WHEN gone THEN '' WHEN k % 26 = 0 THEN 'c' || k WHEN k % 13 = 0 THEN '' ELSE array_to_string(list_filter([CASE WHEN k % 11 = 0 AND k % 22 <> 0 THEN 'a' || k END, CASE WHEN k % 5 = 0 THEN 'b' || k END], lambda x: x IS NOT NULL), ',') END AS attachments,
  CASE WHEN gone THEN 1700000009000 WHEN k % 26 = 0 THEN 1700000008000 WHEN k % 13 = 0 THEN 1700000007000 WHEN k % 22 = 0 THEN 1700000006000 WHEN k % 5 = 0 THEN 1700000005000 WHEN k % 4 = 0 THEN 1700000004000 WHEN k % 7 = 0 THEN 1700000003000 WHEN k % 6 = 0 THEN 1700000002000 WHEN k % 3 = 0 THEN 1700000001000 ELSE "updatedAt" END AS "updatedAt",
  CASE WHEN NOT gone AND k % 3 <> 0 AND k % 4 <> 0 AND k % 5 <> 0 AND k % 7 <> 0 AND k % 13 <> 0 THEN "syncedAt" END AS "syncedAt" FROM own""")
def patch_log_encounters(spark, d):
    """All entries at once, merged into a stored table bucket by bucket; encounters of deleted patients go with them."""
    v = data.visits(spark, d)
    table = BucketTable(spark, scratch(spark), v.schema)
    table.write(v)
    log = patches.stored_log(patches.with_deleted_patients(v, _encounter_log(spark, d), _patient_log(spark, d)), f"{table.path}/log")
    table.change(log, lambda rows: patches.patch_encounters(rows, log))
    return table.read().select("id", "vitals.pulse", "vitals.systolic", "diagnosis", "notes", "status", F.size("provenance").alias("said"), "deletedAt", F.array_join("attachmentIds", ",").alias("attachments"), "updatedAt", "syncedAt")


@query(O.PATIENTS, select="""SELECT id, CASE WHEN k % 6 = 0 THEN NULL WHEN k % 3 = 0 THEN '099 00' ELSE phone END AS phone, CASE WHEN k % 10 = 0 THEN 'NOUVÉAU' ELSE "familyName" END AS "familyName",
  CASE WHEN k % 3 <> 0 AND k % 10 <> 0 THEN "searchKey" ELSE regexp_replace(trim(strip_accents(lower(CASE WHEN k % 10 = 0 THEN 'NOUVÉAU' ELSE "familyName" END || ' ' || "givenName" || ' ' || coalesce("registerNo", '') || ' ' || coalesce(CASE WHEN k % 6 = 0 THEN NULL WHEN k % 3 = 0 THEN '099 00' ELSE phone END, '')))), '\\s+', ' ', 'g') END AS "searchKey",
  CASE WHEN k % 17 = 0 THEN 1700000009000 ELSE "deletedAt" END AS "deletedAt", CASE WHEN k % 17 = 0 THEN 1700000009000 WHEN k % 10 = 0 THEN 1700000003000 WHEN k % 6 = 0 THEN 1700000002000 WHEN k % 3 = 0 THEN 1700000001000 ELSE "updatedAt" END AS "updatedAt",
  CASE WHEN k % 17 <> 0 AND k % 10 <> 0 AND k % 3 <> 0 THEN "syncedAt" END AS "syncedAt" FROM keyed""")
def patch_log_patients(spark, d):
    return patches.patch_patients(data.patients(spark, d), _patient_log(spark, d)).select("id", "phone", "familyName", "searchKey", "deletedAt", "updatedAt", "syncedAt")


@query(O.PATIENTS, O.VISITS, f"""own AS (SELECT *, {_GONE} FROM visits)""", select="""SELECT 'a' || k AS id, id AS "encounterId" FROM own WHERE k % 11 = 0 AND k % 22 <> 0 AND k % 13 <> 0 AND NOT gone""")
def patch_log_attachments(spark, d):
    v = data.visits(spark, d)
    files = v.select(F.explode("attachmentIds").alias("id"), F.col("id").alias("encounterId"))
    log = patches.with_deleted_patients(v, _encounter_log(spark, d), _patient_log(spark, d))
    return patches.surviving_attachments(files, log).select("id", "encounterId")


@query(O.VISITS, select="""SELECT id, "occurredAt", status, diagnosis FROM visits WHERE "patientId" = 'p7' AND "deletedAt" IS NULL""")
def patient_timeline_stored(spark, d):
    """Out of the one bucket that holds the patient's encounters, without a shuffle."""
    v = data.visits(spark, d)
    table = BucketTable(spark, scratch(spark), v.schema, key="patientId", order=("patientId", "occurredAt"))
    table.write(v)
    return store.stored_timeline(table, "p7").select("id", "occurredAt", "status", "diagnosis")


@query(O.VISITS, select=f"""SELECT id, CASE WHEN id = 'e11' THEN 'b1' WHEN k % 11 = 0 THEN 'a' || k ELSE '' END AS attachments, CASE WHEN id = 'e11' THEN {NOW} + 1 ELSE "updatedAt" END AS "updatedAt", CASE WHEN id <> 'e11' THEN "syncedAt" END AS "syncedAt" FROM visits""")
def attachments(spark, d):
    e = store.add_attachment(data.visits(spark, d), "e11", "b1", NOW)
    return store.remove_attachment(e, "e11", "a11", NOW + 1).select("id", F.array_join("attachmentIds", ",").alias("attachments"), "updatedAt", "syncedAt")


@query(O.VISITS, select=f"""SELECT count(*) + 1 AS n, max("updatedAt") FILTER (true) < {NOW} AS older, 1 AS fresh FROM visits""")
def create_draft(spark, d):
    new = spark.createDataFrame([("new", "p1")], "id string, patientId string")
    v = data.encounters(spark, d)
    e = store.create_drafts(v, new, NOW)
    own = F.col("id") == "new"
    return e.agg(F.count("*").alias("n"), (F.max(F.when(~own, F.col("updatedAt"))) < NOW).alias("older"), F.count_if(own & (F.col("status") == "draft") & F.col("vitals.pulse").isNull() & (F.size("prescriptions") == 0)).cast("int").alias("fresh"))


@query(O.PATIENTS, select=f"""SELECT count(*) * 2 AS n, count(*) AS fresh, CAST(36 AS INTEGER) AS length, min("searchKey") AS first, CAST({NOW} AS BIGINT) AS created FROM keyed""")
def new_ids(spark, d):
    """As many new patients as there are, each with an identifier of its own."""
    p = data.patients(spark, d)
    all_ = store.create_patients(p, p.drop("id", "searchKey", "createdAt", "updatedAt", "syncedAt", "deletedAt"), NOW)
    path = f"{scratch(spark)}/patients"
    all_.write.parquet(path)  # identifiers are drawn as the rows are written
    rows = spark.read.parquet(path)
    own = F.length("id") == 36
    return rows.agg(F.count("*").alias("n"), F.count_distinct(F.when(own, F.col("id"))).alias("fresh"), F.max(F.when(own, F.length("id"))).alias("length"), F.min(F.when(own, F.col("searchKey"))).alias("first"), F.max(F.when(own, F.col("createdAt"))).alias("created"))


@query(O.PATIENTS, O.VISITS, select="""SELECT 'kept' AS what, id, "searchKey" AS said FROM keyed UNION ALL SELECT 'kept', id, "patientId" FROM visits
  UNION ALL SELECT * FROM (VALUES ('new', 'demo-1', 'rakotoarisoa voahirana 2041 034 12 345 67'), ('new', 'demo-2', 'andrianjafy naivo 2042'), ('new', 'demo-3', 'razafimahatratra hery 2043 032 98 765 43'), ('new', 'demo-4', 'randriambololona miora 2044'), ('new', 'demo-e1', 'demo-1'), ('new', 'demo-e2', 'demo-2'), ('new', 'demo-e3', 'demo-3')) t(what, id, said)""")
def seeded(spark, d):
    """A register with patients stays as it is; one that was cleared gets the demonstration patients and their encounters."""
    p, v = data.patients(spark, d), data.visits(spark, d)
    out = None
    for what, people, visits in (("kept", p, v), ("new", sinks.cleared(p), sinks.cleared(v))):
        rows = sinks.seed(people, NOW).select(F.lit(what).alias("what"), "id", F.col("searchKey").alias("said"))
        rows = rows.unionByName(sinks.seed_encounters(visits, people, NOW).select(F.lit(what).alias("what"), "id", F.col("patientId").alias("said")))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(O.PATIENTS, select='SELECT id, "familyName", "birthDate", phone, "updatedAt" FROM patients WHERE "deletedAt" IS NULL')
def dump_round_trip(spark, d):
    """Written as JSON and read again."""
    at = scratch(spark)
    p, e = _live(spark, d)
    sinks.write_dump(p, e, deid.deidentify(p, e, "identified", NOW)[2], "2024-01-01T00:00:00Z", "test", at)
    return sinks.read_patients(spark, f"{at}/patients").select("id", "familyName", "birthDate", "phone", "updatedAt")


@query(O.PATIENTS, O.VISITS, O.PRESCRIPTIONS, select="""SELECT id, "familyName" AS name, "updatedAt", 0 AS prescriptions, CAST(NULL AS DOUBLE) AS pulse FROM patients WHERE "deletedAt" IS NULL
  UNION ALL SELECT v.id, "patientId", "updatedAt", (SELECT count(*) FROM prescriptions p WHERE p."encounterId" = v.id), pulse FROM visits v WHERE "deletedAt" IS NULL""")
def dump_document(spark, d):
    """The dump as one document, both lists read again."""
    at = f"{scratch(spark)}/dump.json.gz-joined"
    p, e = data.patients(spark, d), data.encounters(spark, d)
    sinks.write_dump_document(p, e, deid.deidentify(*_live(spark, d), "identified", NOW)[2], "2024-01-01T00:00:00Z", "test", at)
    p, e = sinks.read_dump_document(spark, at)
    rows = p.select("id", F.col("familyName").alias("name"), "updatedAt", F.lit(0).cast("long").alias("prescriptions"), F.lit(None).cast("double").alias("pulse"))
    return rows.unionByName(e.select("id", F.col("patientId").alias("name"), "updatedAt", F.size("prescriptions").cast("long").alias("prescriptions"), F.col("vitals.pulse").alias("pulse")))


def _dumped(spark, d):
    at = scratch(spark)
    p, e = data.patients(spark, d), data.encounters(spark, d)
    sinks.write_dump(p, e, deid.deidentify(*_live(spark, d), "identified", NOW)[2], "2024-01-01T00:00:00Z", "test", at)
    return sinks.read_dump(spark, at)


@query(O.VISITS, O.PRESCRIPTIONS, select="""SELECT v.id, "patientId", pulse, systolic, status, notes, (SELECT count(*) FROM prescriptions p WHERE p."encounterId" = v.id) AS prescriptions, 2 AS said FROM visits v WHERE "deletedAt" IS NULL""")
def dump_encounters(spark, d):
    return _dumped(spark, d)[1].select("id", "patientId", "vitals.pulse", "vitals.systolic", "status", "notes", F.size("prescriptions").cast("long").alias("prescriptions"), F.size("provenance").alias("said"))


@query(O.PATIENTS, O.VISITS, select="""SELECT '2024-01-01T00:00:00Z' AS "exportedAt", 1 AS "schemaVersion", 'test' AS note, 'identified' AS level, (SELECT count(*) FROM patients WHERE "deletedAt" IS NULL) AS patients, (SELECT count(*) FROM visits WHERE "deletedAt" IS NULL) AS encounters""")
def dump_manifest(spark, d):
    m = _dumped(spark, d)[2]
    return m.select("exportedAt", F.col("schemaVersion").cast("int").alias("schemaVersion"), "note", "deidentification.level", F.col("deidentification.patientsProcessed").alias("patients"), F.col("deidentification.encountersProcessed").alias("encounters"))


@query(*REPORT, _PLACED, select="""SELECT 'periode,indicateur,tranche_age,sexe,nombre' || coalesce(string_agg(E'\\n199707,' || label || ',' || "ageBand" || ',' || s || ',' || count, '' ORDER BY place), '') AS file FROM placed""")
def csv_round_trip(spark, d):
    """Written as one file and read again whole, in report order and without a line end after the last row."""
    at = f"{scratch(spark)}/report.csv"
    sinks.write_report_csv(report.csv_text(_cells(spark, d), YEAR, MONTH), at)
    return spark.read.text(at, wholetext=True).withColumnRenamed("value", "file")
