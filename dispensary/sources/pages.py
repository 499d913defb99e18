"""The record store laid out for pulls: files clustered by facility and sequence number, and a manifest of their ranges."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispensary.operators.sync import PAGE_SIZE
from dispensary.schemas import STATE

#: Records in a file.
FILE_ROWS = 100_000


class PageStore:
    """A state written once and read a page at a time; a page opens the files that hold its rows, and no others."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, state: DataFrame, file_rows: int = FILE_ROWS) -> None:
        """Files of about `file_rows` records, each a range of (facilityId, seq); a large facility has many, small ones share one."""
        files = max(1, math.ceil(state.count() / file_rows))
        state.repartitionByRange(files, "facilityId", "seq").sortWithinPartitions("facilityId", "seq").write.mode("overwrite").parquet(f"{self.path}/records")
        rows = self.spark.read.schema(STATE).parquet(f"{self.path}/records").select("facilityId", "seq", F.col("_metadata.file_path").alias("file"))
        ranges = rows.groupBy("facilityId", "file").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("records"))
        ranges.repartitionByRange("facilityId", "first").sortWithinPartitions("facilityId", "first").write.mode("overwrite").parquet(f"{self.path}/ranges")

    def files(self, facility: str, cursor: int, page: int = PAGE_SIZE) -> list[str]:
        """The files of a page: those after the cursor, in order, until their records fill it."""
        ranges = self.spark.read.parquet(f"{self.path}/ranges").filter((F.col("facilityId") == F.lit(facility)) & (F.col("last") > cursor))
        out, held = [], 0
        for r in ranges.orderBy("first").limit(page + 1).collect():  # each has a record of the page, but for the first one perhaps
            out.append(r.file)
            held += r.records if r.first > cursor else 0
            if held >= page:
                break
        return out

    def pull(self, facility: str, cursor: int, page: int = PAGE_SIZE) -> DataFrame:
        """As sync.pull gives it for the whole state."""
        files = self.files(facility, cursor, page)
        rows = self.spark.read.schema(STATE).parquet(*files) if files else self.spark.createDataFrame([], STATE)
        return rows.filter((F.col("facilityId") == F.lit(facility)) & (F.col("seq") > cursor)).orderBy("seq").limit(page).select("kind", "id", "body", "seq")
