"""Merging: duplicates into the patient that is kept, and extracted fields into drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispensary.functions.text import search_key, trim
from dispensary.schemas import VITALS

#: Fields that a survivor may inherit, in the order in which they are reported.
MERGEABLE = ("givenName", "birthDate", "approximateAge", "phone", "address", "registerNo")


def _is_blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) == ""


def merge_fields(pairs: DataFrame, patients: DataFrame) -> DataFrame:
    """(keepId, duplicateId, filled, and the merged columns) for (keepId, duplicateId).

    Blank fields (null or empty) of the survivor are filled from the duplicate, never overwritten; an unknown sex is
    replaced; the precision goes with an inherited birth date.  Pairs with an unknown patient are left out."""
    columns = [*MERGEABLE, "sex", "birthDatePrecision"]
    side = lambda name: patients.select(F.col("id").alias(f"{name}Id"), F.struct(*columns).alias(name))
    both = pairs.filter("keepId <> duplicateId").join(side("keep"), "keepId").join(side("duplicate"), "duplicateId")
    inherits = {f: _is_blank(F.col(f"keep.{f}")) & ~_is_blank(F.col(f"duplicate.{f}")) for f in MERGEABLE}
    inherits["sex"] = (F.col("keep.sex") == "unknown") & (F.col("duplicate.sex") != "unknown")
    new = {f: F.when(which, F.col(f"duplicate.{f}")).otherwise(F.col(f"keep.{f}")) for f, which in inherits.items()}
    new["birthDatePrecision"] = F.when(inherits["birthDate"], F.col("duplicate.birthDatePrecision")).otherwise(F.col("keep.birthDatePrecision"))
    filled = F.array_compact(F.array(*[F.when(which, F.lit(f)) for f, which in inherits.items()]))
    return both.select("keepId", "duplicateId", filled.alias("filled"), *[c.alias(f) for f, c in new.items()])


def merge_patients(patients: DataFrame, encounters: DataFrame, pairs: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(patients, encounters, outcome (keepId, duplicateId, moved, filled)) after merging disjoint pairs.

    The duplicate becomes a tombstone, and all its encounters, deleted ones too, move to the survivor.  A pair of one
    patient is an error, as is a patient in several pairs, which mergelog.apply_merge_log takes in order; pairs with an unknown
    patient change nothing."""
    ids = pairs.select(F.explode(F.array("keepId", "duplicateId")).alias("id"))
    if not ids.groupBy("id").count().filter("count > 1").isEmpty():
        raise ValueError("a patient can be merged once at a time, and not into itself")
    merged = merge_fields(pairs, patients)
    changed = [*MERGEABLE, "sex", "birthDatePrecision"]
    keep = merged.select(F.col("keepId").alias("id"), F.struct(*changed).alias("new"))
    gone = merged.select(F.col("duplicateId").alias("id"), F.lit(True).alias("gone"))
    p = patients.join(keep, "id", "left").join(gone, "id", "left")
    kept, dropped = F.col("new").isNotNull(), F.coalesce("gone", F.lit(False))
    new: dict[str, Column] = {f: F.when(kept, F.col(f"new.{f}")).otherwise(F.col(f)) for f in changed}
    new["searchKey"] = F.when(kept, search_key(F.col("familyName"), new["givenName"], new["registerNo"], new["phone"])).otherwise(F.col("searchKey"))
    new["deletedAt"] = F.when(dropped, F.lit(now_ms)).otherwise(F.col("deletedAt"))
    new["updatedAt"] = F.when(kept | dropped, F.lit(now_ms)).otherwise(F.col("updatedAt"))
    new["syncedAt"] = F.when(~kept & ~dropped, F.col("syncedAt"))
    out_patients = p.select([new[c].alias(c) if c in new else F.col(c) for c in patients.columns])

    to = merged.select(F.col("duplicateId").alias("patientId"), "keepId")
    e = encounters.join(to, "patientId", "left")
    moves = F.col("keepId").isNotNull()
    new = {"patientId": F.coalesce("keepId", "patientId"), "updatedAt": F.when(moves, F.lit(now_ms)).otherwise(F.col("updatedAt")), "syncedAt": F.when(~moves, F.col("syncedAt"))}
    out_encounters = e.select([new[c].alias(c) if c in new else F.col(c) for c in encounters.columns])
    moved = encounters.join(to, "patientId", "left_semi").groupBy(F.col("patientId").alias("duplicateId")).agg(F.count("*").alias("moved"))
    outcome = merged.join(moved, "duplicateId", "left").select("keepId", "duplicateId", F.coalesce("moved", F.lit(0)).alias("moved"), "filled")
    return out_patients, out_encounters, outcome


def merge_extraction(drafts: DataFrame, scale: float = 1.0, source: str = "voice") -> DataFrame:
    """Merge an extraction into drafts; adds `applied` to the encounter's columns.

    `drafts` holds encounters with two more columns, `extraction` and `rawText`.  Vitals fill nulls only, complaint and
    diagnosis fill blanks only, drugs are added unless the draft had them, what no rule claimed (or else the
    whole text) goes to the notes.  New prescriptions are named by encounter, text and place, so that a retry names them alike."""
    x = F.col("extraction")
    said = lambda f, confidence=None: F.struct(F.lit(source).alias("source"), ((f["confidence"] if confidence is None else F.lit(confidence)) * scale).alias("confidence"), f["rawText"].alias("rawText"))
    entries, vitals, applied = [], F.col("vitals"), F.lit(0)

    def claim(which: Column, key: Column, value: Column) -> None:
        nonlocal applied
        entries.append(F.when(which, F.struct(key.alias("key"), value.alias("value"))))
        applied = applied + F.when(which, 1).otherwise(0)

    for v in VITALS:
        which = F.col(f"vitals.{v}").isNull() & x["vitals"][v].isNotNull()
        vitals = vitals.withField(v, F.coalesce(F.col(f"vitals.{v}"), x["vitals"][v]["value"]))
        claim(which, F.lit(f"vitals.{v}"), said(x["vitals"][v]))
    new: dict[str, Column] = {"vitals": vitals}
    for f in ("chiefComplaint", "diagnosis"):
        which = _is_blank(F.col(f)) & x[f].isNotNull()
        new[f] = F.when(which, x[f]["value"]).otherwise(F.col(f))
        claim(which, F.lit(f), said(x[f]))

    plain = lambda c: trim(F.lower(c))
    id_of = lambda i: F.concat(F.lit("rx-"), F.substring(F.sha2(F.concat_ws("|", "id", "rawText", i.cast("string")), 256), 1, 12))
    # lambdas within lambdas would be evaluated anew for every element; these are columns of their own
    drafts = drafts.withColumn("had_", F.transform("prescriptions", lambda p: plain(p["drug"]))).withColumn("said_", F.transform(x["prescriptions"], lambda p, i: p.withField("id", id_of(i))))
    drafts = drafts.withColumn("added_", F.filter("said_", lambda p: ~F.array_contains(F.col("had_"), plain(p["drug"]))))
    row = lambda p: F.struct(p["id"].alias("id"), p["drug"].alias("drug"), p["dose"].alias("dose"), p["frequencyPerDay"].alias("frequencyPerDay"), p["durationDays"].alias("durationDays"), F.lit(None).cast("string").alias("notes"))
    new["prescriptions"] = F.concat("prescriptions", F.transform("added_", row))
    drugs = F.transform("added_", lambda p: F.struct(F.concat(F.lit("prescription."), p["id"]).alias("key"), said(p).alias("value")))

    leftover = F.coalesce(F.nullif(x["remainder"], F.lit("")), F.nullif("rawText", F.lit("")))
    new["notes"] = F.when(leftover.isNull(), F.col("notes")).when(_is_blank(F.col("notes")), leftover).otherwise(F.concat("notes", F.lit("\n"), leftover))
    whole = F.struct(F.lit(source).alias("source"), F.lit(0.6 * scale).alias("confidence"), F.col("rawText").alias("rawText"))
    claim(leftover.isNotNull(), F.lit("notes"), whole)

    fresh = F.map_from_entries(F.concat(F.array_compact(F.array(*entries)), drugs))
    none = F.create_map().cast("map<string,struct<source:string,confidence:double,rawText:string>>")
    drafts = drafts.withColumn("fresh_", fresh).withColumn("names_", F.map_keys("fresh_"))
    new["provenance"] = F.map_concat(F.map_filter(F.coalesce("provenance", none), lambda k, _: ~F.array_contains(F.col("names_"), k)), F.col("fresh_"))
    columns = [c for c in drafts.columns if c not in ("extraction", "rawText", "had_", "said_", "added_", "fresh_", "names_")]
    return drafts.select(*[new[c].alias(c) if c in new else F.col(c) for c in columns], (applied + F.size("added_")).alias("applied"))
