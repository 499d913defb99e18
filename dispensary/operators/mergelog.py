"""A log of patient merges, resolved at once as if its entries had been made one after the other.

`log` is (ord, at, keepId, duplicateId): the order of the entries, each one's time, and who is merged into whom.  Entries of a
patient with itself, or with an unknown one, change nothing.  A patient may be kept, and merged away, any number of times.

Encounters follow pointers between entries: from the first entry that merges their patient away, to the first later one that
merges away whoever was kept, and so on.  Fields are values of (patient, moment): what the patient had, else what the first
entry before the moment that brings a value brought, which is a value of its duplicate at the moment of that entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispensary.functions.text import search_key
from dispensary.operators.merge import MERGEABLE
from dispensary.session import shared_folder

#: After all entries.
END = (1 << 62) - 1


def _cut(df: DataFrame) -> DataFrame:
    """The rows, written to the folder that the cluster shares; what follows starts from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def valid_entries(log: DataFrame, patients: DataFrame) -> DataFrame:
    ids = patients.select("id")
    entries = log.select("ord", "at", "keepId", "duplicateId").filter("keepId <> duplicateId")
    for c in ("keepId", "duplicateId"):
        entries = entries.join(ids.withColumnRenamed("id", c), c, "left_semi")
    return entries


def next_entries(entries: DataFrame) -> DataFrame:
    """The entries with `next`: the first later one that merges away whom this one kept; null if there is none."""
    later = entries.select(F.col("ord").alias("laterOrd"), F.col("duplicateId").alias("keepId"))
    met = entries.join(later, "keepId").filter("laterOrd > ord").groupBy("ord").agg(F.min("laterOrd").alias("next"))
    return entries.join(met, "ord", "left")


def survivors(linked: DataFrame) -> DataFrame:
    """(ord, last): the entry at which whatever passes an entry ends, by doubling how far each one sees."""
    seen = _cut(linked.select("ord", F.coalesce("next", "ord").alias("last")))
    while True:
        further = seen.select(F.col("ord").alias("last"), F.col("last").alias("beyond"))
        moved = _cut(seen.join(further, "last").select("ord", F.col("beyond").alias("last"), (F.col("beyond") != F.col("last")).alias("moved")))
        if moved.filter("moved").isEmpty():
            return seen
        seen = moved.select("ord", "last")


def moved_encounters(encounters: DataFrame, linked: DataFrame) -> DataFrame:
    """(encounters with `first`, the entry that moves them first, and `lastOrd`, the one that moves them last; both may be null)."""
    first = linked.groupBy(F.col("duplicateId").alias("patientId")).agg(F.min("ord").alias("first"))
    ends = survivors(linked).select(F.col("ord").alias("first"), F.col("last").alias("lastOrd"))
    return encounters.join(first.join(ends, "first"), "patientId", "left")


def moved_counts(encounters: DataFrame, linked: DataFrame) -> DataFrame:
    """(ord, moved): how many encounters an entry moves; counts go from entry to entry, not encounters."""
    first = linked.groupBy(F.col("duplicateId").alias("patientId")).agg(F.min("ord").alias("ord"))
    going = _cut(encounters.select("patientId").join(first, "patientId").groupBy("ord").agg(F.count("*").alias("moved")))
    total = going
    links = linked.filter("next is not null").select("ord", "next")
    while True:
        going = _cut(going.join(links, "ord").groupBy(F.col("next").alias("ord")).agg(F.sum("moved").alias("moved")))
        if going.isEmpty():
            return total.groupBy("ord").agg(F.sum("moved").alias("moved"))
        total = _cut(total.unionByName(going).groupBy("ord").agg(F.sum("moved").alias("moved")))


#: What is inherited together, and when a patient has it.
_PARTS = {f: (f,) for f in MERGEABLE if f != "birthDate"} | {"birthDate": ("birthDate", "birthDatePrecision"), "sex": ("sex",)}


def _has(part: str, of: str) -> Column:
    c = F.col(f"{of}.{part}")
    return F.coalesce(c != "unknown", F.lit(False)) if part == "sex" else F.coalesce(c.cast("string"), F.lit("")) != ""


def folded_fields(patients: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, the fields after all entries, `filledBy`: for each part the entry that brought it), for all who were ever kept.

    A moment is asked for where a patient is merged away, and at the end.  Each round answers the moments whose own
    questions are answered; so there are as many rounds as merges are nested, however many entries keep one patient."""
    fields = [x for part in _PARTS.values() for x in part]
    own = patients.select("id", F.struct(*fields).alias("own"))
    asks = entries.select(F.col("duplicateId").alias("id"), F.col("ord").alias("moment")).unionByName(entries.select(F.col("keepId").alias("id"), F.lit(END).alias("moment")).distinct())
    asks = _cut(asks.join(own, "id"))
    brought = entries.select(F.col("keepId").alias("id"), "ord", F.col("duplicateId").alias("fromId"))
    needs = _cut(asks.select("id", "moment").join(brought, "id").filter("ord < moment"))
    counts = needs.groupBy("id", "moment").agg(F.count("*").alias("needs"))
    nothing = F.create_map().cast("map<string,bigint>")
    open_ = _cut(asks.join(counts, ["id", "moment"], "left"))
    done = _cut(open_.filter("needs is null").select("id", "moment", F.col("own").alias("now"), nothing.alias("filledBy")))
    open_ = open_.filter("needs is not null")
    while True:
        known = needs.join(done.select(F.col("id").alias("fromId"), F.col("moment").alias("ord"), F.col("now").alias("theirs")), ["fromId", "ord"])
        # of each part the first entry that brings it; combined before the shuffle, so a patient kept very often is no group
        firsts = [F.min_by(F.struct(*[F.col(f"theirs.{f}").alias(f) for f in parts], F.col("ord").alias("by")), F.when(_has(part, "theirs"), F.col("ord"))).alias(f"first_{part}") for part, parts in _PARTS.items()]
        ready = known.groupBy("id", "moment").agg(F.count("*").alias("answered"), *firsts)
        ready = open_.join(done.select("id", "moment"), ["id", "moment"], "left_anti").join(ready, ["id", "moment"]).filter("answered = needs")
        takes = {part: ~_has(part, "own") & F.col(f"first_{part}").isNotNull() for part in _PARTS}
        now = F.struct(*[F.when(takes[part], F.col(f"first_{part}.{f}")).otherwise(F.col(f"own.{f}")).alias(f) for part, parts in _PARTS.items() for f in parts])
        by = F.array_compact(F.array(*[F.when(takes[part], F.struct(F.lit(part).alias("part"), F.col(f"first_{part}.by").alias("by"))) for part in _PARTS]))
        new = _cut(ready.select("id", "moment", now.alias("now"), F.map_from_entries(by).alias("filledBy")))
        if new.isEmpty():
            break
        done = _cut(done.unionByName(new))
    return done.filter(F.col("moment") == END).select("id", "now.*", "filledBy")


def apply_merge_log(patients: DataFrame, encounters: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(patients, encounters, outcome (ord, keepId, duplicateId, moved, filled)) after all entries of the log.

    Survivors inherit what they left blank, duplicates become tombstones, encounters, deleted ones too, move on to whoever
    their patient was merged into by then.  `filled` names the fields in the order of merge_fields."""
    entries = _cut(valid_entries(log, patients))
    linked = _cut(next_entries(entries))
    fields = _cut(folded_fields(patients, entries))

    latest = lambda c: entries.groupBy(F.col(c).alias("id")).agg(F.max_by("at", "ord").alias(f"{c}At"), F.max("ord").alias(f"{c}Ord"))
    new = F.struct(*[F.col(f) for f in fields.columns if f not in ("id", "filledBy")]).alias("new")
    p = patients.join(fields.select("id", new), "id", "left").join(latest("keepId"), "id", "left").join(latest("duplicateId"), "id", "left")
    kept, gone = F.col("keepIdAt").isNotNull(), F.col("duplicateIdAt").isNotNull()
    changed = {f: F.when(kept, F.col(f"new.{f}")).otherwise(F.col(f)) for part in _PARTS.values() for f in part}
    changed["searchKey"] = F.when(kept, search_key(F.col("familyName"), changed["givenName"], changed["registerNo"], changed["phone"])).otherwise(F.col("searchKey"))
    changed["deletedAt"] = F.when(gone, F.col("duplicateIdAt")).otherwise(F.col("deletedAt"))
    last = F.when(~gone | (F.col("keepIdOrd") > F.col("duplicateIdOrd")), F.col("keepIdAt")).otherwise(F.col("duplicateIdAt"))
    changed["updatedAt"] = F.coalesce(last, "updatedAt")
    changed["syncedAt"] = F.when(~kept & ~gone, F.col("syncedAt"))
    out_patients = p.select([changed[c].alias(c) if c in changed else F.col(c) for c in patients.columns])

    ends = linked.select(F.col("ord").alias("lastOrd"), F.col("keepId").alias("movedTo"), F.col("at").alias("movedAt"))
    e = moved_encounters(encounters, linked).join(ends, "lastOrd", "left")
    moves = F.col("movedTo").isNotNull()
    changed = {"patientId": F.coalesce("movedTo", "patientId"), "updatedAt": F.coalesce("movedAt", "updatedAt"), "syncedAt": F.when(~moves, F.col("syncedAt"))}
    out_encounters = e.select([changed[c].alias(c) if c in changed else F.col(c) for c in encounters.columns])

    filled = fields.select(F.explode("filledBy").alias("part", "ord")).groupBy("ord").agg(F.collect_set("part").alias("parts"))  # the parts at most
    outcome = entries.join(moved_counts(encounters, linked), "ord", "left").join(filled, "ord", "left")
    order = F.array(*[F.lit(f) for f in (*MERGEABLE, "sex")])
    named = F.filter(order, lambda f: F.array_contains(F.coalesce("parts", F.array().cast("array<string>")), f))
    return out_patients, out_encounters, outcome.select("ord", "keepId", "duplicateId", F.coalesce("moved", F.lit(0).cast("long")).alias("moved"), named.alias("filled"))
