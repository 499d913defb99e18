"""Shards of near equal bytes: a minimax contiguous partition of ordered groups.

Equal texts are one group, which no cut may split.  Groups stand in the order of their key, the first 60 bits of the
text's MD5 (texts that share a key are one group, too); those that exceed an even share, fewer than there are shards, stand
before all others, so that they don't cut the rest into stretches of uneven shares.  Running sums of the groups' sizes, taken in parts of the key's
range, give the end of each group.  The capacity of a shard is found by binary search: a capacity is feasible if,
filling shard after shard as far as it goes, no more are needed than there are; a group larger than the capacity is a
shard of its own.  With the smallest feasible capacity, cuts are put where they leave the rest most even, never beyond
what the capacity allows for this shard or for those that follow.

The driver never holds all ends.  It holds the first and last end of each of some thousand stretches, searches with
these, and asks Spark for finer stretches only where the search could not tell; this ends when every answer is exact.
A row's shard follows from its key and the cuts alone, so texts are read once and nothing is joined back.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispensary.llm._spark import checkpointed

#: Bits of the key that name a part, in which running sums are taken; bits of a shard's buckets, in which slots are counted.
PART_BITS, BUCKET_HEX = 12, 3
#: Stretches that the driver asks for at a time.
STRETCHES = 1 << 15


def text_group(text: Column) -> Column:
    """The key of a text's group; a null text counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(text.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


class Ends:
    """What is known of the ends of the groups: stretches, each with its first and last end; others may lie between."""

    def __init__(self, points: DataFrame, total: int):
        self.points, self.total = points, total
        self.open: set[int] = set()  # stretches, by their first end, in which an answer was not exact
        shift = max(0, total.bit_length() - STRETCHES.bit_length() + 1)
        self.known = {0: (0, 0), **{a: (b, shift) for a, b in self._ask(points, shift)}}
        self.firsts = sorted(self.known)

    @staticmethod
    def _ask(points: DataFrame, shift: int) -> list:
        """First and last end of each stretch of 2 ** shift bytes; STRETCHES rows at most."""
        rows = points.groupBy(F.shiftright("end", shift).alias("stretch")).agg(F.min("end").alias("a"), F.max("end").alias("b")).collect()
        return [(r.a, r.b) for r in rows]

    def refine(self) -> None:
        """Ask for finer stretches where answers were not exact, the coarsest first."""
        shift = max(self.known[a][1] for a in self.open)
        chosen = sorted(a for a in self.open if self.known[a][1] == shift)[: STRETCHES // 2]
        finer = max(0, shift - (STRETCHES // len(chosen)).bit_length() + 1)
        spark = self.points.sparkSession
        asked = spark.createDataFrame([(a >> shift,) for a in chosen], "asked long")  # STRETCHES rows at most
        rows = self._ask(self.points.join(F.broadcast(asked), F.shiftright("end", shift) == F.col("asked"), "left_semi"), finer)
        for a in chosen:
            del self.known[a]
        self.known |= {a: (b, finer) for a, b in rows}
        self.firsts = sorted(self.known)
        self.open = set()

    def up_to(self, x: int) -> int:
        """The largest end that is not above x."""
        a = self.firsts[bisect_right(self.firsts, x) - 1]
        b = self.known[a][0]
        if x >= b or x == a:
            return min(b, x)
        self.open.add(a)
        return a

    def after(self, x: int) -> int:
        """The smallest end above x."""
        i = bisect_right(self.firsts, x)
        a = self.firsts[i - 1]
        b = self.known[a][0]
        if x < b:
            self.open.add(a)
            return b
        return self.firsts[i] if i < len(self.firsts) else self.total

    def filled(self, start: int, capacity: int) -> int:
        """Where a shard ends that begins at `start` and is filled as far as it goes."""
        end = self.up_to(start + capacity)
        return end if end > start or start == self.total else self.after(start)

    def feasible(self, capacity: int, shards: int) -> bool:
        end = 0
        for _ in range(shards):
            end = self.filled(end, capacity)
        return end == self.total


def _capacity(ends: Ends, shards: int) -> int:
    """The smallest feasible capacity; exact unless `ends` has open stretches afterwards."""
    low, high = 0, ends.total
    while high - low > 1:
        middle = (low + high) // 2
        if ends.feasible(middle, shards):
            high = middle
        else:
            low = middle
    return high


def _cuts(ends: Ends, capacity: int, shards: int) -> list[int]:
    """The ends of all shards but the last."""
    earliest, end = [0] * shards, ends.total
    for k in range(shards - 1, 0, -1):  # filled from behind: before this end, a cut leaves too much to the rest
        begin = 0 if end <= capacity else ends.after(end - capacity - 1)
        earliest[k] = end = begin if begin < end or not end else ends.up_to(end - 1)
    cuts, end = [], 0
    for k in range(1, shards):
        even = end + (ends.total - end) // (shards - k + 1)
        below, above = ends.up_to(even), ends.after(even) if even < ends.total else ends.total
        near = above if below <= end or above - even < even - below else below
        end = max(end, min(max(near, earliest[k]), ends.filled(end, capacity)))
        cuts.append(end)
    return cuts


@dataclass(frozen=True)
class Cuts:
    """The last key of every shard but the last one, and the keys of the groups that stand before all others."""

    last: list[int]
    large: list[int]

    def place(self, key: Column) -> Column:
        """What the groups are ordered by."""
        return F.when(key.isin(self.large), key - (1 << 60)).otherwise(key)

    def shard_of(self, key: Column) -> Column:
        """How many cuts lie before a key."""
        at = self.place(key)
        return F.size(F.filter(F.array(*[F.lit(x) for x in self.last]).cast("array<long>"), lambda x: x < at))


def _sums(groups: DataFrame) -> tuple[DataFrame, int]:
    """(place, end) of every group of (place, size), and the sum of all sizes."""
    groups = groups.withColumn("part", F.shiftright("place", 60 - PART_BITS))
    base, total = [], 0
    for r in sorted(groups.groupBy("part").agg(F.sum("size").alias("size")).collect()):  # 2 * 2 ** PART_BITS rows at most
        base.append((r.part, total))
        total += r["size"]
    bases = F.broadcast(groups.sparkSession.createDataFrame(base, "part long, base long"))  # as many
    running = F.sum("size").over(Window.partitionBy("part").orderBy("place"))
    return checkpointed(groups.join(bases, "part").select("place", (F.col("base") + running).alias("end"))), total


def balanced_cuts(rows: DataFrame, shards: int) -> Cuts:
    """The cuts for rows with a key (60 bits) and a size (1 at least)."""
    if shards < 1:
        raise ValueError("there must be a shard")
    groups = checkpointed(rows.groupBy("key").agg(F.sum("size").alias("size")))
    total = groups.agg(F.sum("size")).first()[0]
    if not total:
        return Cuts([-1] * (shards - 1), [])
    cuts = Cuts([], sorted(r.key for r in groups.filter(F.col("size") * shards > total).select("key").collect()))  # fewer than shards
    points, total = _sums(groups.select(cuts.place(F.col("key")).alias("place"), "size"))
    ends = Ends(points, total)
    while True:
        found = _cuts(ends, _capacity(ends, shards), shards)
        if not ends.open:
            break
        ends.refine()
    last = {r.end: r.place for r in points.filter(F.col("end").isin(found)).collect()} | {0: -(1 << 61)}  # a row a cut
    return Cuts([last[x] for x in found], cuts.large)


def sized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, size, crc, key) of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), text_group(F.col(text_col)).alias("key"))


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every row; sizes of shards are as equal as groups of equal texts allow.

    The size is the text's UTF-8 bytes plus 1.  A null text counts as an empty one.  Slots of a shard run from 0 without gaps, in
    an order that mixes documents: by the first digits of the MD5 of `id:key`, then by id, key and digest; equal rows get a slot each.
    Null ids stand before all others.  A group larger than an even share is a shard of its own; with fewer groups than
    shards some are empty, as they all are for an empty table.  Other columns, whatever their names, are ignored."""
    rows = checkpointed(sized(docs, id_col, text_col))
    cuts = balanced_cuts(rows, shards)
    name = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("key").cast("string"))
    rows = rows.select("id", "size", "crc", "key", cuts.shard_of(F.col("key")).alias("shard"), F.substring(F.md5(name), 1, BUCKET_HEX).alias("bucket"))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = F.broadcast(counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))  # 16 ** BUCKET_HEX rows a shard at most
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(F.col("id").asc_nulls_first(), "key", "size", "crc"))
    placed = rows.withColumn("place", place).join(counts, ["shard", "bucket"])
    return placed.select("id", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("base") + F.col("place") - 1).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The documents with all their columns as Parquet, a folder `shard=k` for each shard that has some.

    A shard is written by several tasks; which one a row is in follows from its text alone."""
    cuts = balanced_cuts(sized(docs, id_col, text_col), shards)
    columns = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "shard"]
    docs.select(*columns, cuts.shard_of(text_group(F.col(text_col))).alias("shard")).write.mode("overwrite").partitionBy("shard").parquet(path)
