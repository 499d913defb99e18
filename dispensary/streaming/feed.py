"""The change feed in Structured Streaming: every micro-batch is merged into the newest version of the record store.

The store is a table in buckets (sources/buckets.py).  A version's manifest also names the counters, the conflicts, and of each stream
(by the identifier in its checkpoint) the last batch that it holds; all of it is there at once or not at all, so a replayed batch
is passed over and a batch that failed is done again.  Versions that nobody needs go, and conflicts are put together, so the number
of files does not follow the number of batches.
"""

from __future__ import annotations

import json
from contextlib import AbstractContextManager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from dispensary.operators import sync
from dispensary.operators.store import last_visit
from dispensary.schemas import CHANGES, STATE
from dispensary.sources.buckets import BUCKETS, BucketTable

COUNTERS = "facilityId string, value long"
CONFLICTS = "facilityId string, push long, kind string, id string, reason string, serverUpdatedAt double"

#: Folders of conflicts before they are put together, and conflicts in a file of these.
FOLDERS, FILE_ROWS = 16, 1_000_000


class Snapshots:
    """Versions of the record store, the counters and the conflicts.  One stream writes at a time; of two, one fails.

    With `keep`, only so many versions stay after each batch, besides those that a reader has pinned."""

    def __init__(self, spark: SparkSession, path: str, keep: int | None = None, buckets: int = BUCKETS):
        self.spark, self.keep = spark, keep
        self.table = BucketTable(spark, path, STATE, sync.KEY, buckets=buckets)

    def versions(self) -> list[int]:
        return self.table.versions()

    def latest(self) -> DataFrame:
        return self.table.read()

    def pinned(self, version: int | None = None) -> AbstractContextManager[DataFrame]:
        """The state of a version, which stays readable until the block ends."""
        return self.table.pinned(version)

    def counters(self) -> DataFrame:
        return self.table.open(self.table.manifest().folders.get("counters", []), COUNTERS)

    def conflicts(self) -> DataFrame:
        return self.table.open(self.table.manifest().folders.get("conflicts", []), CONFLICTS)

    def merge(self, changes: DataFrame, source: str, batch: int) -> None:
        """Add what a batch of a stream changes, once."""
        before = self.table.manifest()
        if before.facts.get("batches", {}).get(source, -1) >= batch:
            return
        counters = self.counters()
        changes = changes.persist()
        refused: list[DataFrame] = []

        def new_rows(state: DataFrame) -> DataFrame:
            refused.append(sync.conflicts(changes, state))
            return sync.apply_push(changes, state, counters)

        def also(version: int) -> tuple[dict, dict]:
            folders = [self.table.folder("conflicts", x, version) for x in refused]
            every = before.folders.get("conflicts", []) + folders
            if len(every) > FOLDERS:
                rows = self.table.open(every, CONFLICTS)
                every = [self.table.folder("conflicts", rows.repartition(1 + rows.count() // FILE_ROWS), version)]
            after = self.table.folder("counters", sync.counters_after(changes, counters).coalesce(1), version)
            return {"conflicts": every, "counters": [after]}, {"batches": before.facts.get("batches", {}) | {source: batch}}

        try:
            self.table.change(changes, new_rows, also)
        finally:
            changes.unpersist()
        if self.keep:
            self.table.drop_old(self.keep)


def read_changes(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A stream of changes, one file or more a micro-batch.  Late records need no watermark: their change time decides."""
    reader = spark.readStream.format(fmt).schema(CHANGES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def start_feed(changes: DataFrame, snapshots: Snapshots, checkpoint: str) -> StreamingQuery:
    """Merge everything that is there, then stop.  A new checkpoint reads the feed anew, which adds conflicts and changes no record."""

    def merge(df: DataFrame, batch: int) -> None:
        stream = json.loads(snapshots.spark.read.text(f"{checkpoint}/metadata").first().value)["id"]
        snapshots.merge(df, stream, batch)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_last_visit(encounters: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The last visit of each patient, kept up to date below `path` while encounters arrive; a folder for each batch, written by tasks."""
    write = lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return last_visit(encounters).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
