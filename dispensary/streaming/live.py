"""Views that are kept up to date while records change: annotations of patients, and the monthly report.

Annotations: the newest version of every visit of a patient is kept in a table in buckets, so a deletion, a draft that becomes final, or a
visit that moves to another patient takes back what it had given.  A micro-batch opens the buckets of the patients that it touches, and the
view, such a table too, rewrites only theirs.

Report: cells are sums, so a change is the old version's cells taken away and the new one's added.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dispensary.operators import report
from dispensary.operators.store import live
from dispensary.sources.buckets import BucketTable

#: What the stream needs of a visit; `movedFrom` names the patient that it belonged to before, if that is another one.
VISIT_CHANGES = "id string, patientId string, occurredAt long, status string, updatedAt long, deletedAt long, movedFrom string"
ANNOTATIONS = "patientId string, lastVisit long, hasDraft boolean, visits long"

#: The newest version of each visit of a patient, also of one that it left; a patient's visits are dealt into PARTS.
VISITS = "patientId string, part int, id string, occurredAt long, counts boolean, draft boolean, updatedAt long"
PARTS, VISIT_BUCKETS = 8, 64


def visit_sides(changes: DataFrame) -> DataFrame:
    """A row of VISITS for each patient that a change concerns: the one that has the visit, and the one that it left."""
    sides = F.array(F.struct(F.col("patientId").alias("patientId"), F.lit(True).alias("here")), F.when(F.col("movedFrom").isNotNull() & (F.col("movedFrom") != F.col("patientId")), F.struct(F.col("movedFrom").alias("patientId"), F.lit(False).alias("here"))))
    rows = changes.select("id", "occurredAt", "status", "updatedAt", "deletedAt", F.explode(F.array_compact(sides)).alias("s"))
    part = F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")
    return rows.select("s.patientId", part.alias("part"), "id", "occurredAt", (F.col("s.here") & F.col("deletedAt").isNull()).alias("counts"), F.coalesce(F.col("status") == "draft", F.lit(False)).alias("draft"), "updatedAt")


def _newest_sides(old: DataFrame, new: DataFrame) -> DataFrame:
    """Of each patient and visit the row with the latest change time, a stored one first."""
    both = old.withColumn("stored", F.lit(1)).unionByName(new.withColumn("stored", F.lit(0)))
    row = F.struct("occurredAt", "counts", "draft", "updatedAt")
    return both.groupBy("patientId", "part", "id").agg(F.max_by(row, F.struct("updatedAt", "stored")).alias("r")).select("patientId", "part", "id", "r.*")


def annotations_of(visits: DataFrame) -> DataFrame:
    """ANNOTATIONS of the patients of these rows of VISITS; combined before the shuffle, so a patient of very many visits is a row a task."""
    final = F.when(F.col("counts") & ~F.col("draft"), F.col("occurredAt"))
    return visits.groupBy("patientId").agg(F.max(final).alias("lastVisit"), F.bool_or(F.col("counts") & F.col("draft")).alias("hasDraft"), F.count_if("counts").alias("visits"))


def annotation_table(spark, path: str, buckets: int = 64) -> BucketTable:
    return BucketTable(spark, path, ANNOTATIONS, key="patientId", buckets=buckets)


def start_annotations(changes: DataFrame, view: BucketTable, checkpoint: str, keep: int = 2) -> StreamingQuery:
    """Bring the view up to date with everything that is there, then stop; a replayed batch changes nothing.

    The visits are a table beside the view, which moves on first; a batch that failed between both is done again, with the same outcome."""
    spark = view.spark
    visits = BucketTable(spark, f"{view.path}/visits", VISITS, key=("patientId", "part"), order=("patientId", "id"), buckets=VISIT_BUCKETS)

    def upsert(rows: DataFrame, batch: int) -> None:
        stream = json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]
        done = view.manifest().facts.get("batches", {})
        if done.get(stream, -1) >= batch:
            return
        sides = visit_sides(rows)
        version = visits.change(sides, lambda old: _newest_sides(old, sides))
        touched = sides.select("patientId").distinct()
        parts = touched.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        new = annotations_of(visits.read_keys(parts, version)).join(touched, "patientId", "left_semi").persist()  # a row a patient
        try:
            view.change(new, lambda old: old.join(new.select("patientId"), "patientId", "left_anti").unionByName(new.filter("visits > 0")), lambda _: ({}, {"batches": done | {stream: batch}}))
        finally:
            new.unpersist()
        view.drop_old(keep)
        visits.drop_old(keep)

    return changes.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_annotations(view: BucketTable, day_start_ms: int) -> DataFrame:
    """What store.annotations gives for all visits so far; who was seen today follows from the last visit."""
    seen = F.coalesce(F.col("lastVisit") >= day_start_ms, F.lit(False))
    return view.read().select("patientId", "lastVisit", "hasDraft", seen.alias("seenToday"))


# --- the report -----------------------------------------------------------------------------------------------------

CELLS = "indicator string, ageBand string, sex string, count long"


#: What the report needs of an encounter.
COUNTED = ("id", "patientId", "occurredAt", "diagnosis", "status", "updatedAt", "deletedAt")


def encounter_sides(before: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, old, new, changed) of every encounter: COUNTED as it was, null if it is new, and as it is; of versions the one with the
    latest change time, a stored one first.  One grouping of all rows, without semi or anti joins with the changes, whose plan gave
    changed encounters twice."""
    rows = before.select(*COUNTED, F.lit(True).alias("stored")).unionByName(changes.select(*COUNTED, F.lit(False).alias("stored")))
    row, stored = F.struct(*COUNTED), F.col("stored")
    return rows.groupBy("id").agg(F.max_by(row, F.when(stored, 1)).alias("old"), F.max_by(row, F.struct("updatedAt", "stored")).alias("new"), F.bool_or(~stored).alias("changed"))


def report_delta(patients_before: DataFrame, patients_after: DataFrame, encounters: DataFrame, people: DataFrame, year: int, month: int) -> DataFrame:
    """(indicator, ageBand, sex, count) by which a month's cells change, counts of either sign.

    `encounters` is what encounter_sides gives, `people` the ids of the patients that changed.  Only the encounters that changed, and
    those of patients that did, are counted, once as they were and once as they are."""
    theirs = people.select(F.col("id").alias("person")).distinct().withColumn("moved", F.lit(True))
    touched = encounters.join(theirs, F.col("new.patientId") == F.col("person"), "left").filter(F.col("changed") | F.col("moved")).select("old", "new")

    def cells(patients: DataFrame, side: str, sign: int) -> DataFrame:
        own = report.aggregate_month(live(patients), live(touched.filter(F.col(side).isNotNull()).select(f"{side}.*")), year, month)
        return own.withColumn("count", F.col("count") * sign)

    deltas = cells(patients_before, "old", -1).unionByName(cells(patients_after, "new", 1))
    return deltas.groupBy("indicator", "ageBand", "sex").agg(F.sum("count").alias("count")).filter("count <> 0")


def add_cells(cells: DataFrame, delta: DataFrame) -> DataFrame:
    """The report after the change; cells without encounters go."""
    both = cells.select("indicator", "ageBand", "sex", "count").unionByName(delta.select("indicator", "ageBand", "sex", "count"))
    return both.groupBy("indicator", "ageBand", "sex").agg(F.sum("count").alias("count")).filter("count <> 0")


class LiveReport:
    """A month's report beside the patients and encounters that it counts; each batch of changes moves all three on.

    Of a record the version with the latest `updatedAt` stays.  The manifest of the encounters names the cells and the version of
    the patients that they were counted with, so a batch that failed halfway is done again from there, and one that is in is passed over."""

    def __init__(self, spark, path: str, patient_schema, encounter_schema, year: int, month: int, buckets: int = 64):
        self.spark, self.year, self.month = spark, year, month
        self.patients = BucketTable(spark, f"{path}/patients", patient_schema, buckets=buckets)
        self.encounters = BucketTable(spark, f"{path}/encounters", encounter_schema, buckets=buckets)

    def cells(self) -> DataFrame:
        return self.encounters.open(self.encounters.manifest().folders.get("cells", []), CELLS)

    def merge(self, patients: DataFrame, encounters: DataFrame, source: str, batch: int) -> None:
        held = self.encounters.manifest()
        done = held.facts.get("batches", {})
        if done.get(source, -1) >= batch:
            return
        patients, encounters = patients.persist(), encounters.persist()
        try:
            counted_with = held.facts.get("patients")
            people_before = self.patients.read(counted_with) if counted_with is not None else self.spark.createDataFrame([], self.patients.schema)
            now_with = self.patients.change(patients, lambda old: _newest(old, patients))
            people_after = self.patients.read(now_with)
            before = self.encounters.read(max(self.encounters.versions(), default=-1))
            sides = encounter_sides(before, encounters)

            def also(version: int) -> tuple[dict, dict]:
                delta = report_delta(people_before, people_after, sides, patients, self.year, self.month)
                at = self.encounters.folder("cells", add_cells(self.cells(), delta).coalesce(1), version)  # some hundred cells
                return {"cells": [at]}, {"batches": done | {source: batch}, "patients": now_with}

            self.encounters.change(encounters, lambda old: _newest(old, encounters), also)
        finally:
            patients.unpersist()
            encounters.unpersist()

    def drop_old(self, keep: int = 2) -> None:
        """Old versions go; of the patients also stay those that a kept report was counted with."""
        self.encounters.drop_old(keep)
        with_ = [self.encounters.manifest(v).facts.get("patients") for v in self.encounters.versions()]
        newest = max(self.patients.versions(), default=0)
        self.patients.drop_old(max(keep, newest - min((v for v in with_ if v is not None), default=newest) + 1))


def _newest(old: DataFrame, changes: DataFrame) -> DataFrame:
    """Of each id the row with the latest change time, a stored one first."""
    rows = old.withColumn("stored", F.lit(1)).unionByName(changes.select(old.columns).withColumn("stored", F.lit(0)))
    row = F.struct(*[F.col(f"`{c}`") for c in old.columns])
    return rows.groupBy("id").agg(F.max_by(row, F.struct("updatedAt", "stored")).alias("r")).select("r.*")
