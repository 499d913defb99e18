"""Substring search by postings: the ids under each three-letter piece of the search keys, in a table dealt by piece.

A query of three letters or more opens the buckets of its own pieces.  Its rarest pieces are intersected, and what is left is
compared letter by letter, so results are those of a scan; shorter queries scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dispensary.functions.text import normalise
from dispensary.operators.store import live, search_patients
from dispensary.sources.buckets import BUCKETS, BucketTable

#: Letters of a piece, and how many of a query's pieces are intersected.
SIZE, RAREST = 3, 3


def pieces(text: Column) -> Column:
    """The distinct pieces of a text; none of a shorter one."""
    starts = F.when(F.length(text) >= SIZE, F.sequence(F.lit(1), F.length(text) - SIZE + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(SIZE))))


class SearchIndex:
    """Patients dealt by id, and the postings of their search keys."""

    def __init__(self, spark: SparkSession, path: str, patients: BucketTable, buckets: int = BUCKETS):
        self.spark, self.patients = spark, patients
        self.postings = BucketTable(spark, path, "piece string, id string", key="piece", order=("piece", "id"), buckets=buckets)

    @staticmethod
    def _posts(patients: DataFrame) -> DataFrame:
        return live(patients).select(F.explode(pieces(F.col("searchKey"))).alias("piece"), "id")

    def build(self) -> None:
        self.postings.write(self._posts(self.patients.read()))

    def update(self, before: DataFrame, after: DataFrame) -> None:
        """Follow a change of some patients: only pieces that are new or gone are written again."""
        old, new = self._posts(before), self._posts(after)
        gone, come = old.exceptAll(new).persist(), new.exceptAll(old).persist()
        try:
            changed = gone.unionByName(come).select("piece")
            self.postings.change(changed, lambda rows: rows.join(gone, ["piece", "id"], "left_anti").unionByName(come))
        finally:
            gone.unpersist()
            come.unpersist()

    def _asked(self, query: str) -> tuple[str, list[str], list[int]]:
        """The normalised query, its pieces, and the buckets that these are in."""
        q = self.spark.range(1).select(normalise(F.lit(query)).alias("q"))
        r = q.select("q", pieces(F.col("q")).alias("p")).select("q", "p", F.transform("p", lambda x: self.postings.bucket_of(x)).alias("b")).first()
        return r.q, r.p, sorted(set(r.b))

    def candidates(self, query: str) -> DataFrame:
        """(id) of the patients that hold the query's rarest pieces; a query has SIZE letters at least."""
        _, own, buckets = self._asked(query)
        held = self.postings.manifest().buckets
        rows = self.postings.open([held[b] for b in buckets if b in held], self.postings.schema).filter(F.col("piece").isin(own))
        sizes = {r.piece: r["count"] for r in rows.groupBy("piece").count().collect()}  # a row a piece of the query
        rare = sorted(own, key=lambda p: (sizes.get(p, 0), p))[:RAREST]
        return rows.filter(F.col("piece").isin(rare)).groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(rare)).select("id")

    def search(self, query: str, limit: int = 50) -> DataFrame:
        """What search_patients gives for all patients."""
        q, own, _ = self._asked(query)
        if not own:
            return search_patients(self.patients.read(), query, limit)
        ids = self.candidates(query).persist()
        held = self.patients.manifest().buckets
        buckets = [r.b for r in ids.select(self.patients.bucket_of(F.col("id")).alias("b")).distinct().collect()]  # as many as buckets
        rows = self.patients.open([held[b] for b in sorted(buckets) if b in held], self.patients.schema).join(ids, "id", "left_semi")
        return live(rows).filter(F.contains(F.col("searchKey"), F.lit(q))).orderBy("id").limit(limit).orderBy(F.desc("updatedAt"), "id")
