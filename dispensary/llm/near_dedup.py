"""Near-duplicate classes by MinHash: a signature-coordinate inverted join, then exact counts on the full sets.

A document is the set of its word shingles.  Documents with equal sets form one class and travel as one row.  A
signature has COORDINATES minima, and every class is posted under each (coordinate, value) pair.  Two classes that
share MATCHES coordinates or more are candidates, and only these are compared on their full sets.

Prefix: a class orders its postings by the length of their lists, shortest first; postings of nobody else are left out,
and a class with fewer than MATCHES others is done.  Two classes with so many common postings have one among the first
(number - MATCHES + 1) of each, so lists of these prefixes are all that is merged; long lists are mostly left alone.

Skip: the members of a list first meet its pivot (the member with the least number) and are joined with it where their
full sets say so, which closes most lists of groups of copies.  A list whose members are in one component by then is
skipped.  In the others collisions are counted for all pairs of a list within tasks, as matrices, in the first list that a pair shares
and only across components; what leaves the task is one row a member that has a candidate, not the pairs.  A long list is cut into parts,
and each part meets each other part in a task of its own, so that no list has to fit into one task.

Shingles are 64-bit hashes in signatures and in the digests that name classes; where links are confirmed, they are numbers of the
words themselves.  At a similarity of 0.8 a pair shares fewer than 15 of 40 coordinates with probability below 1e-9.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispensary.llm._blocks import NO_ID
from dispensary.llm._components import components
from dispensary.llm._annotate import free_name
from dispensary.llm._spark import checkpointed, documents, give_back, squeeze, steps_of, text_key, text_keys, unsqueeze
from dispensary.llm._text import SPACED, STEP_BYTES, flat, mix, windows, words

#: Minima in a signature; how many two classes must share to be compared.
COORDINATES, MATCHES = 40, 15
#: Members, and shingles of members, in a part of a list; cells of an incidence matrix.
PART_MEMBERS, PART_SHINGLES, CELLS = 1024, 1 << 20, 1 << 24

_MULTIPLIERS = np.random.default_rng(7).integers(1, 2**63, COORDINATES, dtype=np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Per document its sorted distinct 64-bit shingle hashes; a shorter document is one shingle of all its words."""
    w = words(data, offsets, SPACED, lower=True)
    n, hashes, left = w.counts(), w.hashes(), w.left()
    grams = windows(hashes, size)
    out = []
    for first, count in zip(w.first[:-1].tolist(), n.tolist(), strict=True):
        if count >= size:
            out.append(np.unique(grams[first : first + count - size + 1]))
        elif count:
            out.append(windows(hashes[first : first + count], count)[:1] ^ np.uint64(count))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_SIGNED = pa.schema([("id", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("cls", pa.binary()), ("coords", pa.list_(pa.int32()))])


def signatures(docs: DataFrame, size: int = 4, step_bytes: int = STEP_BYTES) -> DataFrame:
    """(id, key, n, cls, coords): digest of the text, set size, 128-bit digest of the set, signature."""

    def sign(batches):
        for t in steps_of(batches, step_bytes // 2):
            sets = shingle_sets(*flat(t.column("text")), size)
            n = np.array([len(s) for s in sets])
            full = np.flatnonzero(n)
            joined = np.concatenate([*sets, np.zeros(0, np.uint64)])
            starts = np.concatenate(([0], np.cumsum(n[full])[:-1])) if len(full) else full
            coords = np.zeros((len(sets), COORDINATES), np.uint64)
            if len(full):
                for k, m in enumerate(_MULTIPLIERS):
                    coords[full, k] = np.minimum.reduceat(joined * m, starts)
            coords = (mix(coords) >> np.uint64(32)).astype(np.uint32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * COORDINATES), pa.array(coords.view(np.int32).ravel()))
            cls = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([t.column("id").combine_chunks(), pa.array(text_keys(t.column("text")), pa.binary()), pa.array(n), pa.array(cls, pa.binary()), lists], schema=_SIGNED)
            del sets, joined, coords, lists
            give_back()

    return docs.select("id", "text").mapInArrow(sign, "id long, key binary, n long, cls binary, coords array<int>")


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share."""
    n = len(sets)
    out = np.zeros((n, n), np.float32)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1  # a shingle of one set is shared with none
    shared = count[number] > 1
    owner, number = owner[shared], rank[number[shared]]
    by = np.argsort(number, kind="stable")
    owner, number = owner[by], number[by]
    last = int(number[-1]) + 1 if len(number) else 0
    wide = min(max(1, CELLS // n), max(1, last))
    for low in range(0, last, wide):
        i, j = np.searchsorted(number, (low, low + wide))
        cells = np.zeros((n, wide), np.float32)
        cells[owner[i:j], number[i:j] - low] = 1
        out += cells @ cells.T
    return out


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the first set of its component, under links of that similarity."""
    both = common(sets).astype(np.int64)
    size = np.array([len(x) for x in sets])
    link = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(link, True)
    label = np.arange(len(sets))
    while True:
        new = np.where(link, label[None, :], len(sets)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _parts(members: DataFrame, *by: str) -> DataFrame:
    """Groups of (*by, c, n) with the number of parts that each is cut into."""
    return members.groupBy(*by).agg(F.greatest(F.ceil(F.count("*") / PART_MEMBERS), F.ceil(F.sum("n") / PART_SHINGLES), F.lit(1)).cast("int").alias("parts"))


def _part():
    return F.pmod(F.xxhash64("c"), F.col("parts")).cast("int")


_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def exact_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Per text its distinct shingles, as numbers that are equal if and only if the words are; texts as in shingle_sets."""
    number: dict[bytes, int] = {}
    short: dict[tuple, int] = {}
    codes = [[number.setdefault(x, len(number)) for x in t.lower().split()] for t in texts]
    every = np.fromiter((x for c in codes for x in c), np.int64, sum(map(len, codes)))
    grams = every
    for j in range(1, size):
        grams = np.unique(grams[: max(0, len(every) - j)] << 32 | every[j:], return_inverse=True)[1]
    out, first = [], 0
    for c in codes:
        if len(c) >= size:
            out.append(np.unique(grams[first : first + len(c) - size + 1]))
        else:
            out.append(np.array([-1 - short.setdefault(tuple(c), len(short))] if c else [], np.int64))
        first += len(c)
    return out


def _decoded(t: pa.Table, size: int) -> list[np.ndarray]:
    return exact_sets([unsqueeze(x) for x in t.column("body").to_pylist()], size)


def _pivot_links(posts: DataFrame, held: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) of the members of each list (key, c, n) with its pivot, compared once however many lists they share."""
    pivots = posts.groupBy("key").agg(F.min("c").alias("pivot"), F.count("*").alias("size")).filter("size > 1").select("key", "pivot")
    pairs = posts.join(pivots, "key").filter("c <> pivot").groupBy("pivot", "c").agg(F.min("n").alias("n"))
    pairs = checkpointed(pairs)
    parts = _parts(pairs, "pivot")
    own = parts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("pivot").alias("c"))
    rows = pairs.join(parts, "pivot").select("pivot", _part().alias("part"), "c").unionByName(own)

    def meet(t: pa.Table) -> pa.Table:
        t = t.sort_by("cls")
        c, cls, sets = np.asarray(t.column("c")), t.column("cls").to_pylist(), _decoded(t, size)
        coords = np.asarray(t.column("coords").combine_chunks().flatten()).reshape(len(c), COORDINATES)
        out = []
        for p in np.flatnonzero(c == t.column("pivot")[0].as_py()).tolist():  # classes that share a number are all pivots
            close = (coords == coords[p]).sum(axis=1) >= MATCHES
            for i in np.flatnonzero(close).tolist():
                if i != p:
                    both = len(np.intersect1d(sets[p], sets[i], assume_unique=True))
                    if 100 * both >= percent * (len(sets[p]) + len(sets[i]) - both):
                        out.append((cls[p], cls[i]))
        return pa.table({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())}, schema=_LINKS)

    return rows.join(held, "c").groupBy("pivot", "part").applyInArrow(meet, "a binary, b binary")


def _candidates(coords: np.ndarray, labels: np.ndarray, parts: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
    """Which members have a candidate: enough collisions, another component, another part (if there are two), no earlier list."""
    n = len(coords)
    if n <= 64:
        count = (coords[:, None, :] == coords[None, :, :]).sum(axis=2)
    else:
        count = np.zeros((n, n), np.uint8)
        for k in range(COORDINATES):
            count += coords[:, k][:, None] == coords[:, k][None, :]
    pairs = (count >= MATCHES) & (labels[:, None] != labels[None, :])
    if parts.min() != parts.max():
        pairs &= parts[:, None] != parts[None, :]
    if pairs.any() and any(map(len, before)):
        pairs &= common(before) == 0
    return pairs.any(axis=1)


def _open_links(posts: DataFrame, labels: DataFrame, prefixes: DataFrame, held: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that join the members of lists that several components share."""
    own = held.select("c", "cls").join(labels, "cls", "left").groupBy("c").agg(F.min(F.coalesce("label", "cls")).alias("label"))
    posts = posts.join(own, "c")
    open_ = posts.groupBy("key").agg((F.min("label") != F.max("label")).alias("open")).filter("open").select("key")
    posts = posts.join(open_, "key")
    met = posts.join(_parts(posts, "key"), "key").withColumn("part", _part())
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "place", "c", "label")
    counted = met.join(prefixes.select("c", "keys"), "c").withColumn("before", F.slice("keys", F.lit(1), F.col("place"))).drop("keys", "place").join(held.select("c", "coords"), "c")

    def count(t: pa.Table) -> pa.Table:
        coords = np.asarray(t.column("coords").combine_chunks().flatten()).reshape(t.num_rows, COORDINATES)
        number: dict[bytes, int] = {}
        labels = np.array([number.setdefault(x, len(number)) for x in t.column("label").to_pylist()])
        before = [np.array(x, np.int64) for x in t.column("before").to_pylist()]
        return t.filter(pa.array(_candidates(coords, labels, np.asarray(t.column("part")), before))).select(["key", "p", "q", "c"])

    some = checkpointed(counted.groupBy("key", "p", "q").applyInArrow(count, "key long, p int, q int, c long"))

    def meet(t: pa.Table) -> pa.Table:
        t = t.sort_by("cls")
        cls = t.column("cls").to_pylist()
        first = linked(_decoded(t, size), percent).tolist()
        pairs = [(cls[i], x) for x, i in zip(cls, first, strict=True) if cls[i] != x]
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.binary()), "b": pa.array([b for _, b in pairs], pa.binary())}, schema=_LINKS)

    return some.join(held.select("c", "cls", "body"), "c").groupBy("key", "p", "q").applyInArrow(meet, "a binary, b binary")


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every document.

    Words are maximal runs without white space after lower-casing A-Z; a set is the distinct `size`-word shingles,
    or the whole sequence of a shorter document.  Documents are linked at 100 * common >= percent * union; a
    component is named by its smallest id, and `kept` marks the document of that id.  Null, empty and blank texts
    have an empty set, are linked with nothing and are kept.  Rows that share an id are separate documents; null
    ids are smaller than none (a component of null ids alone is named null, and kept).  An empty table gives an
    empty result.  Texts of any length are compared whole.  Other columns, whatever their names, are ignored.
    """
    signed, joined = _joined(documents(docs, id_col, text_col), size, percent)
    classes = signed.filter("n > 0").groupBy("cls").agg(F.min("id").alias("rep"))
    named = classes.join(joined, "cls", "left").select("cls", "rep", F.coalesce("label", "cls").alias("label"))
    names = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(names, "label").select("cls", "component_id")
    full = signed.filter("n > 0").join(named, "cls").select("id", "n", "component_id")
    out = full.unionByName(signed.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select("id", F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _joined(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The signatures of (id, text), and (cls, label) of the classes that are linked with another one."""
    signed = checkpointed(signatures(docs, size))
    some = signed.filter("n > 0")
    # c is a short number of the class; should two classes share one, they are taken as candidates together
    classes = some.groupBy("cls").agg(F.min("n").alias("n"), F.min("coords").alias("coords")).withColumn("c", F.xxhash64("cls"))
    posting = F.shiftleft(F.col("k").cast("long"), 32) + F.col("v").cast("long") + (1 << 31)
    posts = classes.select("c", "n", F.posexplode("coords").alias("k", "v")).select("c", "n", posting.alias("key"))
    shared = posts.join(posts.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "key")
    ordered = shared.groupBy("c").agg(F.min("n").alias("n"), F.sort_array(F.collect_list(F.struct("size", "key"))).alias("keys"))  # at most COORDINATES a class
    prefix = F.slice(F.col("keys.key"), F.lit(1), F.size("keys") - MATCHES + 1)
    prefixes = checkpointed(ordered.filter(F.size("keys") >= MATCHES).select("c", "n", prefix.alias("keys")))
    posts = prefixes.select("c", "n", F.posexplode("keys").alias("place", "key"))
    met = posts.join(posts.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key"), "key")
    met = checkpointed(met)
    # the text of one document of each class that is in such a list
    owner = some.select("cls", "id", "key", "coords").withColumn("c", F.xxhash64("cls")).join(met.select("c").distinct(), "c", "left_semi")
    owner = owner.groupBy("cls").agg(F.min(F.struct(F.coalesce("id", F.lit(NO_ID)).alias("id"), "key", "coords")).alias("o"))
    texts = docs.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "text").mapInArrow(_squeezed, "id long, key binary, body binary")
    held = texts.join(owner.select("cls", "o.*"), ["id", "key"]).groupBy("cls").agg(F.min("coords").alias("coords"), F.min("body").alias("body"))
    held = checkpointed(held.withColumn("c", F.xxhash64("cls")))
    joined = components(_pivot_links(met, held, size, percent))
    found = _open_links(met, joined, prefixes, held, size, percent)
    joined = components(found.unionByName(joined.select(F.col("label").alias("a"), F.col("cls").alias("b")).filter("a != b")))
    return signed, joined


def _squeezed(batches):
    schema = pa.schema([("id", pa.int64()), ("key", pa.binary()), ("body", pa.binary())])
    for b in batches:
        texts = b.column("text")
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(text_keys(texts), pa.binary()), pa.array([squeeze((x or "").encode()) for x in texts.to_pylist()], pa.binary())], schema=schema)


def near_dedup(docs: DataFrame, size: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with their own columns: one row of each component, and all rows without words.

    It is the row with the smallest id, null ids being the largest, then with the least digest of its text.  Rows
    that share an id are separate documents, as in near_duplicates; of rows with equal id and text any one stays."""
    signed, joined = _joined(documents(docs, id_col, text_col), size, percent)
    some = signed.filter("n > 0")
    best = some.groupBy("cls").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("best"))
    best = best.join(joined, "cls", "left").select("cls", "best", F.coalesce("label", "cls").alias("label"))
    chosen = best.join(best.groupBy("label").agg(F.min("best").alias("chosen")), "label").select("cls", F.col("chosen.id").alias("own_id"), F.col("chosen.key").alias("own_key"))
    stays = F.col("id").eqNullSafe(F.col("own_id")) & (F.col("key") == F.col("own_key"))
    judged = some.join(chosen, "cls").groupBy("id", "key").agg(F.max(stays).alias("stays"), F.count("*").alias("copies"))
    judged = checkpointed(judged.filter("not stays or copies > 1"))
    names = free_name(docs, "row_id"), free_name(docs, "row_key")
    keyed = docs.withColumns({names[0]: docs[id_col].cast("long"), names[1]: text_key(docs[text_col])})

    def pairs(condition: str):
        rows = judged.filter(condition).select(F.col("id").alias("judged_id"), F.col("key").alias("judged_key"))
        return rows, keyed[names[0]].eqNullSafe(rows["judged_id"]) & (keyed[names[1]] == rows["judged_key"])

    again, equal = pairs("stays")
    out = keyed.join(*pairs("not stays"), "left_anti")
    if not again.isEmpty():  # equal rows, found in parts by each task first
        out = out.join(again, equal, "left_anti").unionByName(keyed.join(again, equal, "left_semi").dropDuplicates(list(names)))
    return out.drop(*names)
