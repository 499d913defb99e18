"""Sources and sinks of records: JSON, CSV, bundles and dumps.  Everything is written in parallel, a file a partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispensary.operators.bundle import bundle_head, encounter_entries, entry_json, exported, patient_entries
from dispensary.operators.store import DAY_MS, create_patients, live
from dispensary.schemas import ENCOUNTERS, PATIENTS
from dispensary.sources.documents import read_items, write_document


def read_patients(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; absent and null fields are alike."""
    return spark.read.schema(PATIENTS).json(path)


def read_encounters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENCOUNTERS).json(path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Sync requests, one JSON document a line, as text for parse_requests."""
    return spark.read.text(path)


def write_dump(patients: DataFrame, encounters: DataFrame, manifest: DataFrame, exported_at: str, note: str, path: str) -> None:
    """Live records as JSON lines in two folders, and a manifest with the schema version and what was removed.

    Attachments' contents are no part of a dump.  The lists are compressed, file by file, as JSON repeats its field names in every line."""
    live(patients).write.mode("overwrite").json(f"{path}/patients", compression="gzip")
    live(encounters).write.mode("overwrite").json(f"{path}/encounters", compression="gzip")
    facts = manifest.select(F.lit(exported_at).alias("exportedAt"), F.lit(1).alias("schemaVersion"), F.lit(note).alias("note"), F.struct("*").alias("deidentification"))
    facts.write.mode("overwrite").json(f"{path}/manifest")


def read_dump(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(patients, encounters, manifest) of a dump."""
    return read_patients(spark, f"{path}/patients"), read_encounters(spark, f"{path}/encounters"), spark.read.json(f"{path}/manifest")


def write_dump_document(patients: DataFrame, encounters: DataFrame, manifest: DataFrame, exported_at: str, note: str, path: str) -> None:
    """The same as one JSON document, as it is carried from a device: facts, then patients and encounters in the order of their ids."""
    facts = manifest.select(F.to_json(F.struct(F.lit(exported_at).alias("exportedAt"), F.lit(1).alias("schemaVersion"), F.lit(note).alias("note"), F.struct("*").alias("deidentification"))).alias("head"))
    row = F.to_json(F.struct("*"))
    write_document(patients.sparkSession, path, facts.first().head, {"patients": (live(patients), row, ["id"]), "encounters": (live(encounters), row, ["id"])})


def read_dump_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(patients, encounters) of such a document."""
    return read_items(spark, path, "familyName", PATIENTS), read_items(spark, path, "patientId", ENCOUNTERS)


def write_bundle(patients: DataFrame, encounters: DataFrame, as_of_ms: int, path: str) -> None:
    """The bundle as one JSON document: its head with the time of the export, and all entries in bundle order.

    Records are sorted, not their entries, which are many times as large and come in order from each record."""
    spark = patients.sparkSession
    head = spark.range(1).select(bundle_head(as_of_ms).alias("head")).first().head
    own = patient_entries(live(patients).orderBy("id"), as_of_ms), encounter_entries(exported(live(encounters)).orderBy("id"))
    write_document(spark, path, head, {"entry": [(entries, entry_json(), []) for entries in own]})


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One file with exactly this text, on whatever file system the path names; for reports of some hundred rows."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(text.encode())
    finally:
        out.close()


def write_report_csv(document: DataFrame, path: str) -> None:
    """What csv_text gives."""
    write_text(document.sparkSession, document.first().csv, path)


def write_data_value_set(document: DataFrame, path: str) -> None:
    """What data_value_set gives."""
    write_text(document.sparkSession, document.first().json, path)


# Demonstration patients.
DEMO = [
    ("demo-1", "2041", "Voahirana", "RAKOTOARISOA", "female", 34, "034 12 345 67", "Ambohimanga", "mg"),
    ("demo-2", "2042", "Naivo", "ANDRIANJAFY", "male", 6, None, "Anjozorobe", "mg"),
    ("demo-3", "2043", "Hery", "RAZAFIMAHATRATRA", "male", 58, "032 98 765 43", "Ambatolampy", "fr"),
    ("demo-4", "2044", "Miora", "RANDRIAMBOLOLONA", "female", 22, None, "Ambohimanga", "mg"),
]


# Their encounters, as days before now, complaint, diagnosis, vitals, prescriptions (drug, dose, times a day, days),
# and for each field its source, confidence and what was said.
DEMO_VISITS = [
    (
        "demo-1", 3, "fièvre depuis trois jours, frissons", "paludisme simple",
        {"temperature": 38.9, "pulse": 96.0, "systolic": 110.0, "diastolic": 70.0, "weight": 54.0},
        [("artéméther luméfantrine", "20/120 mg", 2, 3), ("paracétamol", "500 mg", 3, 5)],
        {
            "vitals.temperature": ("voice", 0.75, "température trente-huit virgule neuf"),
            "vitals.pulse": ("voice", 0.75, "pouls quatre-vingt-seize"),
            "vitals.systolic": ("voice", 0.8, "tension onze sur sept"),
            "vitals.diastolic": ("voice", 0.8, "tension onze sur sept"),
            "diagnosis": ("voice", 0.8, "diagnostic paludisme simple"),
        },
    ),
    (
        "demo-2", 1, "toux et difficulté à respirer", "pneumonie",
        {"temperature": 39.6, "pulse": 138.0, "respiratoryRate": 42.0, "oxygenSaturation": 91.0, "weight": 18.0},
        [("amoxicilline", "250 mg", 3, 7)],
        {"vitals.respiratoryRate": ("manual", None, None), "vitals.oxygenSaturation": ("manual", None, None)},
    ),
    (
        "demo-3", 10, "contrôle tension", "hypertension artérielle",
        {"systolic": 168.0, "diastolic": 98.0, "pulse": 78.0, "weight": 71.0},
        [("amlodipine", "5 mg", 1, 30)],
        {},
    ),
]


def seed(patients: DataFrame, now_ms: int) -> DataFrame:
    """Demonstration patients if the table is empty, else the table."""
    if not patients.isEmpty():
        return patients
    new = patients.sparkSession.createDataFrame(DEMO, "id string, registerNo string, givenName string, familyName string, sex string, approximateAge int, phone string, address string, preferredLang string")
    return create_patients(patients, new, now_ms)


def seed_encounters(encounters: DataFrame, patients: DataFrame, now_ms: int) -> DataFrame:
    """The demonstration patients' final encounters if the patients' table, as it was before it was seeded, is empty, else the table."""
    if not patients.isEmpty():
        return encounters
    rows = []
    for k, (patient, days, complaint, diagnosis, vitals, drugs, said) in enumerate(DEMO_VISITS, start=1):
        listed = [{"id": f"demo-rx-{k}-{i}", "drug": d, "dose": dose, "frequencyPerDay": times, "durationDays": n} for i, (d, dose, times, n) in enumerate(drugs, start=1)]
        provenance = {f: {"source": s, "confidence": c, "rawText": t} for f, (s, c, t) in said.items()}
        row = {"id": f"demo-e{k}", "patientId": patient, "occurredAt": now_ms - days * DAY_MS, "chiefComplaint": complaint, "diagnosis": diagnosis, "vitals": vitals, "prescriptions": listed, "provenance": provenance}
        rows.append(row | {"attachmentIds": [], "status": "final", "createdAt": now_ms, "updatedAt": now_ms})
    shape = encounters.sparkSession.createDataFrame([], ENCOUNTERS).schema
    new = encounters.sparkSession.createDataFrame([tuple(r.get(c) for c in shape.names) for r in rows], shape)
    return encounters.unionByName(new.select([c for c in shape.names if c in encounters.columns]))


def cleared(df: DataFrame) -> DataFrame:
    """The table without rows."""
    return df.limit(0)
