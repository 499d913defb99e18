"""A table in versions, dealt into buckets by a key.

A version is a manifest that names the folder of each bucket.  A change rewrites only the buckets that it touches and writes the
next manifest; all other folders are shared with the version before.  Manifests are written last and never replaced, so
a version is either complete or not there, and of two writers one fails.  A lookup by the key opens one bucket.

A manifest may name more: folders of other tables that belong to the version, and facts.  They change with it, all or nothing.

Old versions go with `drop_old`, except those that a reader has pinned; a folder goes when no manifest names it any more.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dispensary.sources import files

BUCKETS = 64


@dataclass(frozen=True)
class Manifest:
    """The folder of each bucket that has rows; folders of other tables by name; facts."""

    buckets: dict[int, str] = field(default_factory=dict)
    folders: dict[str, list[str]] = field(default_factory=dict)
    facts: dict = field(default_factory=dict)

    def named(self) -> set[str]:
        return {*self.buckets.values(), *(x for own in self.folders.values() for x in own)}


class BucketTable:
    """`key`, one column or several, deals the rows; within a bucket's files they stand in `order`."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: str | tuple[str, ...] = "id", order: tuple[str, ...] = (), buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.key = (key,) if isinstance(key, str) else key
        self.order = order or self.key
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def bucket_of(self, *values: Column) -> Column:
        return F.pmod(F.xxhash64(*values), F.lit(self.buckets)).cast("int")

    def _bucket(self) -> Column:
        return self.bucket_of(*[F.col(k).cast(self.schema[k].dataType) for k in self.key])

    def versions(self) -> list[int]:
        return sorted(int(n[2:-5]) for n in files.names(self.spark, f"{self.path}/manifests") if n.startswith("v=") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """Of a version or the latest one; an empty one if there is none."""
        if version is None:
            version = max(self.versions(), default=-1)
        if version < 0:
            return Manifest()
        m = json.loads(files.get(self.spark, f"{self.path}/manifests/v={version}.json"))
        return Manifest({int(b): at for b, at in m["buckets"].items()}, m["folders"], m["facts"])

    def folder(self, name: str, rows: DataFrame, version: int) -> str:
        """Write rows of another table that are to belong to a version; gives the folder for its manifest."""
        at = f"data/{version}-{uuid.uuid4().hex}/{name}"
        rows.write.parquet(f"{self.path}/{at}")
        return at

    def open(self, folders: list[str], schema: StructType | str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{x}" for x in folders]) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self.open(sorted(self.manifest(version).buckets.values()), self.schema)

    def read_keys(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """All rows of the buckets that the keys are in; others are not opened."""
        mine = {r.b for r in keys.select(self._bucket().alias("b")).distinct().collect()}  # as many as buckets
        return self.open([at for b, at in sorted(self.manifest(version).buckets.items()) if b in mine], self.schema)

    def lookup(self, *values, version: int | None = None) -> DataFrame:
        """The rows of one key; only its bucket is opened, and the equality reaches the scan."""
        own = {k: F.lit(v).cast(self.schema[k].dataType) for k, v in zip(self.key, values, strict=True)}
        bucket = self.spark.range(1).select(self.bucket_of(*own.values()).alias("b")).first().b
        at = self.manifest(version).buckets.get(bucket)
        rows = self.open([at] if at else [], self.schema)
        for k, v in own.items():
            rows = rows.filter(F.col(k) == v)
        return rows

    def _write(self, rows: DataFrame | None, held: dict[int, str], version: int, folders: dict, facts: dict) -> int:
        """`rows` in place of all buckets that `held` does not name."""
        new = {}
        if rows is not None:
            at = f"data/{version}-{uuid.uuid4().hex}"
            dealt = rows.select([F.col(f"`{c}`") for c in self.schema.names]).withColumn("bucket", self._bucket())
            dealt.repartition("bucket").sortWithinPartitions("bucket", *self.order).write.partitionBy("bucket").parquet(f"{self.path}/{at}")
            new = {int(n[7:]): f"{at}/{n}" for n in files.names(self.spark, f"{self.path}/{at}") if n.startswith("bucket=")}
        files.put(self.spark, f"{self.path}/manifests/v={version}.json", json.dumps({"buckets": held | new, "folders": folders, "facts": facts}))
        return version

    def write(self, rows: DataFrame) -> int:
        """A new version that holds these rows only."""
        return self._write(rows, {}, max(self.versions(), default=-1) + 1, {}, {})

    def change(self, touched: DataFrame, new_rows: Callable[[DataFrame], DataFrame], also: Callable[[int], tuple[dict, dict]] | None = None) -> int:
        """A new version in which the buckets of the keys in `touched` hold what new_rows(their rows) gives; it may add rows of
        these keys, and leave some out.  also(version) gives the new version's other folders and facts."""
        last = max(self.versions(), default=-1)
        before = self.manifest(last)
        mine = {r.b for r in touched.select(self._bucket().alias("b")).distinct().collect()}  # as many as buckets
        if not mine and also is None:
            return last
        rows = new_rows(self.open([at for b, at in sorted(before.buckets.items()) if b in mine], self.schema)) if mine else None
        folders, facts = also(last + 1) if also else (before.folders, before.facts)
        return self._write(rows, {b: at for b, at in before.buckets.items() if b not in mine}, last + 1, folders, facts)

    @contextmanager
    def pinned(self, version: int | None = None) -> Iterator[DataFrame]:
        """The rows of a version that stays readable until the block ends, whatever is dropped meanwhile."""
        version = max(self.versions()) if version is None else version
        pin = f"{self.path}/pins/{version}-{uuid.uuid4().hex}"
        files.put(self.spark, pin, "")
        try:
            yield self.read(version)
        finally:
            files.delete(self.spark, pin)

    def drop_old(self, keep: int = 2) -> None:
        """Only the latest `keep` versions and those that are pinned stay; manifests go before the folders that they alone name."""
        versions = self.versions()
        pins = {int(n.split("-")[0]) for n in files.names(self.spark, f"{self.path}/pins")}
        stay = set(versions[-max(1, keep) :]) | pins & set(versions)
        named = {at for v in stay for at in self.manifest(v).named()}
        for v in versions:
            if v not in stay:
                files.delete(self.spark, f"{self.path}/manifests/v={v}.json")
        newest = max(versions, default=-1)
        for folder in files.names(self.spark, f"{self.path}/data"):
            if int(folder.split("-")[0]) > newest:
                continue  # a version that is being written
            own = [f"data/{folder}/{n}" for n in files.names(self.spark, f"{self.path}/data/{folder}") if not n.startswith(("_", "."))]
            if not named.intersection(own):
                files.delete(self.spark, f"{self.path}/data/{folder}")
                continue
            for at in own:
                if at not in named:
                    files.delete(self.spark, f"{self.path}/{at}")
