"""A log of changes to many records, folded to one change a record and merged in one pass.

An entry is (id, ord, at, op, sets, erase, attachmentId).  `sets` holds the new values, null where an entry says nothing; what is
to become null is named in `erase` (a vital as `vitals.pulse`).  For each field the last entry that sets or erases it
counts, so the result is that of one entry after the other.  Entries of unknown records change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispensary.functions.text import search_key
from dispensary.schemas import PRESCRIPTION, PROVENANCE, VITALS

_ENTRY = "id string, ord long, at long, op string"
#: Fields of encounters and patients that an entry may set whole.
ENCOUNTER_FIELDS = ("chiefComplaint", "notes", "diagnosis", "occurredAt", "prescriptions")
PATIENT_FIELDS = ("registerNo", "givenName", "familyName", "sex", "birthDate", "birthDatePrecision", "approximateAge", "phone", "address", "preferredLang")

#: op is patch, finalise, delete, attach or detach; provenance is merged by key.
ENCOUNTER_PATCHES = f"""{_ENTRY}, sets struct<chiefComplaint: string, notes: string, diagnosis: string, occurredAt: bigint,
prescriptions: array<struct<{PRESCRIPTION}>>, vitals: struct<{", ".join(f"{v}: double" for v in VITALS)}>, provenance: map<string, struct<{PROVENANCE}>>>,
erase array<string>, attachmentId string"""

#: op is update or delete.
PATIENT_PATCHES = f"{_ENTRY}, sets struct<{', '.join(f'{f}: ' + ('int' if f == 'approximateAge' else 'string') for f in PATIENT_FIELDS)}>, erase array<string>"


def _last(value: Column, name: str, op: str) -> Column:
    """The value of the last entry that sets or erases a field, in a struct that is null if there is none."""
    said = (F.col("op") == op) & (value.isNotNull() | F.coalesce(F.array_contains("erase", name), F.lit(False)))
    return F.max_by(F.struct(value.alias("value")), F.when(said, F.col("ord")))


def _now(field: str, old: Column) -> Column:
    return F.when(F.col(f"`last_{field}`").isNotNull(), F.col(f"`last_{field}`.value")).otherwise(old)


def fold_encounter_patches(patches: DataFrame) -> DataFrame:
    """One row an id: the last value of each field, the last times, and what is to be done to provenance and attachments."""
    fields = [_last(F.col(f"sets.{f}"), f, "patch").alias(f"last_{f}") for f in ENCOUNTER_FIELDS]
    vitals = [_last(F.col(f"sets.vitals.{v}"), f"vitals.{v}", "patch").alias(f"last_{v}") for v in VITALS]
    deleted = F.col("op") == "delete"
    main = patches.groupBy("id").agg(
        *fields, *vitals,
        F.bool_or(F.col("op") == "finalise").alias("finalised"),
        F.max_by("at", F.when(deleted, F.col("ord"))).alias("lastDelete"),
        F.max(F.when(deleted, F.col("ord"))).alias("deleteOrd"),
        F.max_by("at", "ord").alias("lastAt"),
        F.bool_or(F.col("op") != "detach").alias("unsynced"),
    )
    said = patches.filter("op = 'patch' and sets.provenance is not null").select("id", "ord", F.explode("sets.provenance").alias("key", "value"))
    said = said.groupBy("id", "key").agg(F.max_by("value", "ord").alias("value")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("said"))  # a record's fields
    own = patches.filter("op in ('attach', 'detach') and attachmentId is not null").groupBy("id", "attachmentId").agg(
        F.max(F.when(F.col("op") == "detach", F.col("ord"))).alias("off"), F.max(F.when(F.col("op") == "attach", F.col("ord"))).alias("on"))
    times = patches.filter("op = 'attach' and attachmentId is not null").select("id", "attachmentId", "ord")
    added = times.join(own.select("id", "attachmentId", "off"), ["id", "attachmentId"]).join(main.select("id", "deleteOrd"), "id")
    added = added.filter(F.col("ord") > F.greatest(F.coalesce("off", F.lit(-(1 << 62))), F.coalesce("deleteOrd", F.lit(-(1 << 62)))))
    added = added.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "attachmentId"))).alias("a")).select("id", F.col("a.attachmentId").alias("attached"))  # what an encounter holds
    taken = own.filter("off is not null").groupBy("id").agg(F.collect_set("attachmentId").alias("detached"))
    return main.join(said, "id", "left").join(added, "id", "left").join(taken, "id", "left")


def patch_encounters(encounters: DataFrame, patches: DataFrame) -> DataFrame:
    """The encounters after all entries: fields and vitals replaced or erased, provenance merged, drafts finalised, tombstones without
    attachments, attachments added and taken away.  Every entry sets the change time; all but a detachment take the acknowledgement."""
    e = encounters.join(fold_encounter_patches(patches).withColumnRenamed("id", "patchedId"), F.col("id") == F.col("patchedId"), "left")
    there = F.col("patchedId").isNotNull()
    vitals = F.col("vitals")
    for v in VITALS:
        vitals = vitals.withField(v, _now(v, F.col(f"vitals.{v}")))
    new = {f: _now(f, F.col(f)) for f in ENCOUNTER_FIELDS if f in encounters.columns}
    new["vitals"] = F.when(there, vitals).otherwise(F.col("vitals"))
    kind = encounters.schema["provenance"].dataType
    held = F.coalesce("provenance", F.create_map().cast(kind))
    new["provenance"] = F.when(F.col("said").isNull(), F.col("provenance")).otherwise(F.map_concat(F.map_filter(held, lambda k, _: ~F.array_contains(F.map_keys("said"), k)), F.col("said")))
    new["status"] = F.when(F.coalesce("finalised", F.lit(False)), "final").otherwise(F.col("status"))
    new["deletedAt"] = F.coalesce("lastDelete", "deletedAt")
    none = F.array().cast("array<string>")
    kept = F.when(F.col("deleteOrd").isNotNull(), none).otherwise(F.filter(F.coalesce("attachmentIds", none), lambda a: ~F.array_contains(F.coalesce("detached", none), a)))
    new["attachmentIds"] = F.when(there, F.concat(kept, F.coalesce("attached", none))).otherwise(F.col("attachmentIds"))
    new["updatedAt"] = F.coalesce("lastAt", "updatedAt")
    new["syncedAt"] = F.when(~F.coalesce("unsynced", F.lit(False)), F.col("syncedAt"))
    return e.select([new[c].alias(c) if c in new else F.col(c) for c in encounters.columns])


def patch_patients(patients: DataFrame, patches: DataFrame) -> DataFrame:
    """The patients after all entries, with search keys made anew where something changed."""
    deleted = F.col("op") == "delete"
    fold = patches.groupBy(F.col("id").alias("patchedId")).agg(
        *[_last(F.col(f"sets.{f}"), f, "update").alias(f"last_{f}") for f in PATIENT_FIELDS],
        F.max_by("at", F.when(deleted, F.col("ord"))).alias("lastDelete"), F.max_by("at", "ord").alias("lastAt"), F.bool_or(~deleted).alias("updated"),
    )
    p = patients.join(fold, F.col("id") == F.col("patchedId"), "left")
    new = {f: _now(f, F.col(f)) for f in PATIENT_FIELDS}
    key = search_key(*[new[f] for f in ("familyName", "givenName", "registerNo", "phone")])
    new["searchKey"] = F.when(F.coalesce("updated", F.lit(False)), key).otherwise(F.col("searchKey"))
    new["deletedAt"] = F.coalesce("lastDelete", "deletedAt")
    new["updatedAt"] = F.coalesce("lastAt", "updatedAt")
    new["syncedAt"] = F.when(F.col("patchedId").isNull(), F.col("syncedAt"))
    return p.select([new[c].alias(c) if c in new else F.col(c) for c in patients.columns])


def with_deleted_patients(encounters: DataFrame, encounter_patches: DataFrame, patient_patches: DataFrame) -> DataFrame:
    """The entries of encounters, and a deletion of each encounter of a deleted patient; `ord` is one order for both logs."""
    gone = patient_patches.filter("op = 'delete'").select(F.col("id").alias("patientId"), "ord", "at")
    own = encounters.select("id", "patientId").join(gone, "patientId").select("id", "ord", "at", F.lit("delete").alias("op"))
    return encounter_patches.unionByName(own, allowMissingColumns=True)


def stored_log(log: DataFrame, path: str) -> DataFrame:
    """The entries, written once; a fold reads them several times, a few columns each time."""
    log.write.parquet(path)
    return log.sparkSession.read.schema(log.schema).parquet(path)


def surviving_attachments(attachments: DataFrame, encounter_patches: DataFrame) -> DataFrame:
    """The attachments (id, encounterId) that no entry takes away, and no deletion of their encounter; deleted ones go for good."""
    deleted = encounter_patches.filter("op = 'delete'").select(F.col("id").alias("encounterId")).distinct()
    taken = encounter_patches.filter("op = 'detach'").select(F.col("id").alias("encounterId"), F.col("attachmentId").alias("id")).distinct()
    return attachments.join(deleted, "encounterId", "left_anti").join(taken, ["encounterId", "id"], "left_anti")
