"""Scans, lookups, search, timelines and dashboard numbers over the record store.

"Now" is always a parameter: a query for a moment gives the same rows whenever it runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispensary.functions import clinical as C
from dispensary.functions.text import normalise, search_key, trim
from dispensary.schemas import RANGES
from dispensary.sources.buckets import BucketTable

DAY_MS = 86_400_000


def live(df: DataFrame) -> DataFrame:
    """Rows without a tombstone."""
    return df.filter(F.col("deletedAt").isNull())


def by_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """Point or secondary lookup; tombstones are seen.  The equality reaches the scan."""
    return df.filter(F.col(key) == F.lit(value))


def newest(df: DataFrame, k: int, by: str = "updatedAt") -> DataFrame:
    """The k latest rows; ids break ties."""
    return df.orderBy(F.desc(by), "id").limit(k)


def search_patients(patients: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Live patients whose search key holds the query literally; an empty query gives the latest.

    With a query the limit applies in id order, before the rows are put in order of their last change."""
    spark = patients.sparkSession
    q = spark.range(1).select(normalise(F.lit(query)).alias("q")).first().q
    if not q:
        return newest(live(patients), limit)
    return live(patients).filter(F.contains(F.col("searchKey"), F.lit(q))).orderBy("id").limit(limit).orderBy(F.desc("updatedAt"), "id")


def merge_candidates(patients: DataFrame, query: str, patient_id: str, limit: int = 40) -> DataFrame:
    """Whom a patient can be merged with: the limit counts the patient, who is then left out."""
    return search_patients(patients, query, limit).filter(F.col("id") != F.lit(patient_id))


def timeline(encounters: DataFrame, patient_id: str) -> DataFrame:
    """A patient's live encounters, latest first."""
    return live(by_key(encounters, "patientId", patient_id)).orderBy(F.desc("occurredAt"), "id")


def stored_timeline(encounters: BucketTable, patient_id: str) -> DataFrame:
    """The same out of a table that is dealt by patientId: one bucket is opened, and the patient's rows are sorted in one task."""
    return live(encounters.lookup(patient_id)).coalesce(1).sortWithinPartitions(F.desc("occurredAt"), "id")


def counts(patients: DataFrame, encounters: DataFrame) -> DataFrame:
    return live(patients).agg(F.count("*").alias("patients")).crossJoin(live(encounters).agg(F.count("*").alias("encounters")))  # one row each


def dirty(df: DataFrame, finals_only: bool) -> DataFrame:
    """Rows that the server has not acknowledged, tombstones included; of encounters only final ones."""
    out = df.filter(F.col("syncedAt").isNull())
    return out.filter(F.col("status") == "final") if finals_only else out


def pending_sync(patients: DataFrame, encounters: DataFrame) -> DataFrame:
    kinds = dirty(patients, False).select(F.lit(1).alias("one")).unionByName(dirty(encounters, True).select(F.lit(1).alias("one")))
    return kinds.agg(F.count("*").alias("pending"))


def draft_queue(encounters: DataFrame, patients: DataFrame, k: int = 3) -> DataFrame:
    """The k latest live drafts with their patients, tombstoned ones too."""
    drafts = newest(live(encounters).filter(F.col("status") == "draft"), k)
    p = patients.select(F.col("id").alias("patientId"), "familyName", "givenName", F.col("deletedAt").alias("patientDeletedAt"))
    return drafts.join(p, "patientId", "left")


def last_visit(encounters: DataFrame) -> DataFrame:
    """(patientId, lastVisit) over live final encounters."""
    return live(encounters).filter(F.col("status") == "final").groupBy("patientId").agg(F.max("occurredAt").alias("lastVisit"))


def recent_patients(patients: DataFrame, encounters: DataFrame, k: int = 5) -> DataFrame:
    """The k latest live patients with their last visit; only their encounters are aggregated."""
    top = newest(live(patients), k)
    visits = encounters.join(F.broadcast(top.select(F.col("id").alias("patientId"))), "patientId", "left_semi")  # k rows
    return top.join(last_visit(visits).withColumnRenamed("patientId", "id"), "id", "left")


def annotations(encounters: DataFrame, day_start_ms: int) -> DataFrame:
    """(patientId, lastVisit, hasDraft, seenToday)"""
    draft = F.col("status") == "draft"
    return live(encounters).groupBy("patientId").agg(
        F.max(F.when(~draft, F.col("occurredAt"))).alias("lastVisit"),
        F.bool_or(draft).alias("hasDraft"),
        F.bool_or(~draft & (F.col("occurredAt") >= day_start_ms)).alias("seenToday"),
    )


def roster(patients: DataFrame, encounters: DataFrame, day_start_ms: int, show: str = "all") -> DataFrame:
    """Patients with their annotations; `show` is all, today or drafts."""
    p = patients.join(annotations(encounters, day_start_ms).withColumnRenamed("patientId", "id"), "id", "left")
    p = p.withColumn("hasDraft", F.coalesce("hasDraft", F.lit(False))).withColumn("seenToday", F.coalesce("seenToday", F.lit(False)))
    return p.filter({"all": F.lit(True), "today": F.col("seenToday"), "drafts": F.col("hasDraft")}[show])


def roster_counts(patients: DataFrame, encounters: DataFrame, day_start_ms: int) -> DataFrame:
    p = roster(patients, encounters, day_start_ms)
    return p.agg(F.count("*").alias("all"), F.count_if("seenToday").alias("today"), F.count_if("hasDraft").alias("drafts"))


def dashboard_counts(encounters: DataFrame, day_start_ms: int, month_start_ms: int) -> DataFrame:
    """Final encounters since the start of the day and of the month, without an upper bound."""
    e = live(encounters).filter(F.col("status") == "final")
    return e.agg(F.count_if(F.col("occurredAt") >= day_start_ms).alias("today"), F.count_if(F.col("occurredAt") >= month_start_ms).alias("month"))


def vitals_long(encounters: DataFrame) -> DataFrame:
    """(id, vital, value), one row a value that is there."""
    pairs = F.array(*[F.struct(F.lit(v).alias("vital"), F.col(f"vitals.{v}").alias("value")) for v in RANGES])
    return encounters.select("id", F.explode(F.filter(pairs, lambda x: x["value"].isNotNull())).alias("x")).select("id", "x.*")


def vital_flags(encounters: DataFrame) -> DataFrame:
    """(id, vital, value, severity, plausible)"""
    severity, fits = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for v in RANGES:
        own = F.col("vital") == v
        severity, fits = F.when(own, C.vital_severity(v, F.col("value"))).otherwise(severity), F.when(own, C.plausible(v, F.col("value"))).otherwise(fits)
    return vitals_long(encounters).select("id", "vital", "value", severity.alias("severity"), fits.alias("plausible"))


def uncertain_fields(encounters: DataFrame, under: float = 0.8) -> DataFrame:
    """(id, field, source, confidence) of machine-captured fields below the confidence (a missing one counts as 1)."""
    fields = encounters.select("id", F.explode("provenance").alias("field", "p")).select("id", "field", "p.source", "p.confidence")
    return fields.filter((F.col("source") != "manual") & (F.coalesce("confidence", F.lit(1.0)) < under))


def form_fields(forms: DataFrame) -> DataFrame:
    """Normalise a registration form: trimmed, blank as null, age a positive number; without a family name it is an error."""
    blank = lambda c: F.nullif(trim(F.col(c)), F.lit(""))
    age = F.regexp_extract(trim(F.col("approximateAge")), "^[+-]?[0-9]+", 0).try_cast("int")
    return forms.select(
        trim(F.col("familyName")).alias("familyName"), trim(F.coalesce("givenName", F.lit(""))).alias("givenName"), "sex",
        F.nullif("birthDate", F.lit("")).alias("birthDate"), F.when(F.nullif("birthDate", F.lit("")).isNotNull(), "day").alias("birthDatePrecision"),
        F.when(age > 0, age).alias("approximateAge"), blank("phone").alias("phone"), blank("address").alias("address"), blank("registerNo").alias("registerNo"), "preferredLang",
        F.when(F.coalesce(trim(F.col("familyName")), F.lit("")) == "", "required").alias("error"),
    )


# --- changes; each gives the rows of the new version of the table ---------------------------------------------------


def with_search_key(patients: DataFrame) -> DataFrame:
    return patients.withColumn("searchKey", search_key(F.col("familyName"), F.col("givenName"), F.col("registerNo"), F.col("phone")))


def _touched(df: DataFrame, which: Column, now_ms: int, **changes: Column) -> DataFrame:
    """Set columns, the change time, and that the server doesn't know yet, where `which` holds."""
    changes = changes | {"updatedAt": F.lit(now_ms), "syncedAt": F.lit(None).cast("long")}
    return df.withColumns({c: F.when(which, v.cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in changes.items()})


def with_ids(new: DataFrame) -> DataFrame:
    """The rows with a random identifier each where they have none; write them before use, as a plan draws anew each time it runs."""
    return new if "id" in new.columns else new.select(F.uuid().alias("id"), "*")


def create_patients(patients: DataFrame, new: DataFrame, now_ms: int) -> DataFrame:
    """Append patients that come with their fields, and with an id or get one."""
    new = with_ids(new)
    given = [c for c in new.columns if c not in ("createdAt", "updatedAt", "searchKey")]
    rows = new.select(*given, F.lit(now_ms).alias("createdAt"), F.lit(now_ms).alias("updatedAt"))
    return with_search_key(patients.unionByName(rows, allowMissingColumns=True).select(patients.columns))


def create_drafts(encounters: DataFrame, new: DataFrame, now_ms: int) -> DataFrame:
    """Append empty drafts for (id, patientId), or for (patientId) with ids of their own."""
    new = with_ids(new)
    kind = lambda c: encounters.schema[c].dataType
    vitals = F.from_json(F.lit("{}"), kind("vitals"))
    empty = {c: F.array().cast(kind(c)) for c in ("prescriptions", "attachmentIds")} | {"vitals": vitals, "provenance": F.create_map().cast(kind("provenance")), "status": F.lit("draft")}
    times = {c: F.lit(now_ms) for c in ("occurredAt", "createdAt", "updatedAt")}
    return encounters.unionByName(new.select("id", "patientId").withColumns(empty | times), allowMissingColumns=True).select(encounters.columns)


def update_patient(patients: DataFrame, patient_id: str, now_ms: int, **changes: Column) -> DataFrame:
    """Merge changes into a patient and rebuild the search key."""
    which = F.col("id") == patient_id
    out = _touched(patients, which, now_ms, **changes)
    return out.withColumn("searchKey", F.when(which, search_key(F.col("familyName"), F.col("givenName"), F.col("registerNo"), F.col("phone"))).otherwise(F.col("searchKey")))


def patch_encounter(encounters: DataFrame, encounter_id: str, now_ms: int, vitals: dict[str, Column] | None = None, provenance: Column | None = None, **changes: Column) -> DataFrame:
    """Merge vitals and provenance field by field, replace other fields; a null Column erases."""
    if vitals:
        v = F.col("vitals")
        for name, value in vitals.items():
            v = v.withField(name, value.cast("double"))
        changes["vitals"] = v
    if provenance is not None:
        kept = F.map_filter("provenance", lambda k, _: ~F.array_contains(F.map_keys(provenance), k))
        changes["provenance"] = F.map_concat(kept, provenance.cast(encounters.schema["provenance"].dataType))
    return _touched(encounters, F.col("id") == encounter_id, now_ms, **changes)


def finalise(encounters: DataFrame, encounter_id: str, now_ms: int) -> DataFrame:
    return _touched(encounters, F.col("id") == encounter_id, now_ms, status=F.lit("final"))


def delete_encounter(encounters: DataFrame, encounter_id: str, now_ms: int) -> DataFrame:
    """A tombstone without attachments."""
    return _touched(encounters, F.col("id") == encounter_id, now_ms, deletedAt=F.lit(now_ms), attachmentIds=F.array())


def delete_patient(patients: DataFrame, encounters: DataFrame, attachments: DataFrame, patient_id: str, now_ms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tombstones for a patient and all encounters, deleted ones anew; the attachments go for good."""
    own = F.col("patientId") == patient_id
    gone = encounters.filter(own).select(F.col("id").alias("encounterId"))
    return (
        _touched(patients, F.col("id") == patient_id, now_ms, deletedAt=F.lit(now_ms)),
        _touched(encounters, own, now_ms, deletedAt=F.lit(now_ms), attachmentIds=F.array()),
        attachments.join(gone, "encounterId", "left_anti"),
    )


def add_attachment(encounters: DataFrame, encounter_id: str, attachment_id: str, now_ms: int) -> DataFrame:
    return _touched(encounters, F.col("id") == encounter_id, now_ms, attachmentIds=F.array_append("attachmentIds", attachment_id))


def remove_attachment(encounters: DataFrame, encounter_id: str, attachment_id: str, now_ms: int) -> DataFrame:
    """The change time moves on, but the acknowledgement stays."""
    which = F.col("id") == encounter_id
    return encounters.withColumns({"attachmentIds": F.when(which, F.array_remove("attachmentIds", attachment_id)).otherwise(F.col("attachmentIds")), "updatedAt": F.when(which, F.lit(now_ms)).otherwise(F.col("updatedAt"))})
