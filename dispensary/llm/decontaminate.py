"""Benchmark decontamination with suffix arrays over the training documents.

Each few megabytes of documents are a shard.  A shard's suffix array has the suffixes of all its documents, word by word
and to the end of the document, in order; it is made by prefix doubling, which from the second round on only touches
suffixes that are still alike.  Every test suffix that a window begins is looked up in it by binary search, one word
further at a time, as long as anything matches; the places that match a whole window are its occurrences.  Occurrences
that follow each other on a diagonal are one verbatim match, whose length and places are then known.

The search compares words by 64-bit hashes; what it finds is then compared word by word.  The test set is a query set: it goes to the
tasks in parts of bounded size, one part a pass over the documents, and with several parts each pass is written to
the shared folder before the next one, so that neither the driver nor a task ever holds more than one part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispensary.llm._annotate import annotated, free_name
from dispensary.llm._spark import checkpointed
from dispensary.llm._text import ALNUM, STEP_BYTES, Words, equal_words, flat, words

#: Bytes of test text in one part.
PART_BYTES = 16 << 20

FOUND = "n_words long, matches array<struct<item:string,doc_word:int,item_word:int,n_words:int>>"
_MATCH = pa.struct([("item", pa.string()), ("doc_word", pa.int32()), ("item_word", pa.int32()), ("n_words", pa.int32())])


def suffix_array(codes: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The places of word numbers (from 1), ordered by the suffixes that begin there and run over `left` words."""
    order = np.argsort(codes, kind="stable")
    begins = np.searchsorted(codes[order], codes, side="left")
    rank, size = begins + 1, np.bincount(codes)[codes]  # the rank of a group of equal ones is that of its first
    tied, h = order[size[order] > 1], 1
    while len(tied):
        after = np.zeros(len(tied), np.int64)
        on = left[tied] > h
        after[on] = rank[tied[on] + h]
        key = rank[tied] << 32 | after
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        place, old = np.arange(len(key)), key >> 32
        new_first, old_first = np.ones(len(key), bool), np.ones(len(key), bool)
        new_first[1:], old_first[1:] = key[1:] != key[:-1], old[1:] != old[:-1]
        in_old = place - np.maximum.accumulate(np.where(old_first, place, 0))
        order[old - 1 + in_old] = tied
        first = np.flatnonzero(new_first)
        group = np.cumsum(new_first) - 1
        rank[tied] = (old + in_old)[first][group]
        sizes = np.diff(np.append(first, len(key)))
        tied = tied[(sizes[group] > 1) & (left[tied] > h)]  # suffixes that have ended by now are equal
        h *= 2
    return order


def index(items: list[str], texts: list[str | None], width: int) -> dict | None:
    """What a task needs of one part of the test set; plain data, as it is broadcast."""
    data, offsets = flat(pa.array(texts, pa.string()))
    w = words(data, offsets, ALNUM, lower=True)
    n = w.counts()
    if not n.sum():
        return None
    item = np.repeat(np.arange(len(items)), n)
    length = np.minimum(n[item], width)
    begins = np.flatnonzero(w.left() >= length)  # of windows
    return {"items": items, "text": (w.data, w.starts, w.ends, w.first), "words": w.hashes(), "begins": begins, "item": item[begins], "length": length[begins], "place": begins - w.first[:-1][item[begins]]}


def _bound(suffixes: np.ndarray, codes: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, wanted: np.ndarray) -> np.ndarray:
    """For each interval of the suffix array the first entry whose word at `depth` is `wanted` or above."""
    low, high = low.copy(), high.copy()
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) >> 1
        at = suffixes[middle]
        word = np.where(left[at] > depth, codes[np.minimum(at + depth, len(codes) - 1)], 0)
        under = word < wanted[open_]
        low[open_[under]] = middle[under] + 1
        high[open_[~under]] = middle[~under]
    return low


def search(codes: np.ndarray, left: np.ndarray, suffixes: np.ndarray, known: np.ndarray, part: dict) -> tuple[np.ndarray, np.ndarray]:
    """(word of the shard, test window) for every occurrence; `known` are the sorted hashes of the shard's words, by number."""
    place = np.minimum(np.searchsorted(known, part["words"]), len(known) - 1)
    tests = np.where(known[place] == part["words"], place + 1, -1)
    some = np.arange(len(part["begins"]))
    low, high = np.zeros(len(some), np.int64), np.full(len(some), len(suffixes))
    found = []
    depth = 0
    while len(some):
        wanted = tests[part["begins"][some] + depth]
        low, high = _bound(suffixes, codes, left, low, high, depth, wanted), _bound(suffixes, codes, left, low, high, depth, wanted + 1)
        depth += 1
        some, low, high = (x[(low < high) & (wanted > 0)] for x in (some, low, high))
        whole = part["length"][some] == depth
        found += zip(some[whole].tolist(), low[whole].tolist(), high[whole].tolist(), strict=True)
        some, low, high = (x[~whole] for x in (some, low, high))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.concatenate([suffixes[i:j] for _, i, j in found])
    return at, np.repeat([t for t, _, _ in found], [j - i for _, i, j in found])


def verified(w: Words, at: np.ndarray, test: np.ndarray, part: dict) -> np.ndarray:
    """Which occurrences have the words of their test windows, not only words of equal hashes."""
    size = part["length"][test]
    owner = np.repeat(np.arange(len(at)), size)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    tests = Words(*part["text"])
    # windows overlap, so each pair of words is compared once
    pairs, number = np.unique((at[owner] + inside) * len(tests.starts) + part["begins"][test][owner] + inside, return_inverse=True)
    same = equal_words(w, pairs // len(tests.starts), tests, pairs % len(tests.starts))[number]
    return np.bincount(owner, same, len(at)) == size


def _parts(benchmark: DataFrame, id_col: str, text_col: str, width: int, part_bytes: int):
    """The test set part by part; the driver holds one at a time."""
    tests = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).filter("item is not null and text is not null").distinct()
    total = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / part_bytes))
    for k in range(n):
        rows = tests.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()
        if rows and (part := index([r.item for r in rows], [r.text for r in rows], width)):
            yield benchmark.sparkSession.sparkContext.broadcast(part)


def _matched(docs: DataFrame, part, name: str, text_col: str, step_bytes: int) -> DataFrame:
    """One pass: the number of words and the matches with one part (or none)."""

    def make():
        def f(data, offsets):
            w = words(data, offsets, ALNUM, lower=True)
            n, first, left = w.counts(), w.first, w.left()
            rows = []  # document, item, word in document, word in item, words
            if part is not None and len(left):
                tests = part.value
                known, codes = np.unique(w.hashes(), return_inverse=True)
                codes = codes + 1
                at, test = search(codes, left, suffix_array(codes, left), known, tests)
                true = verified(w, at, test, tests)
                at, test = at[true], test[true]
                size, item, place = tests["length"][test], tests["item"][test], tests["place"][test]
                by = np.lexsort((at, at - place, item))
                at, item, place, size = at[by], item[by], place[by], size[by]
                doc = np.searchsorted(first, at, side="right") - 1
                new = np.ones(len(at), bool)
                new[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] != 1) | (place[1:] - place[:-1] != 1)
                begin = np.flatnonzero(new)
                stop = np.append(begin[1:], len(at)) - 1
                rows = sorted(zip(doc[begin].tolist(), (tests["items"][i] for i in item[begin].tolist()), (at - first[doc])[begin].tolist(), place[begin].tolist(), (at[stop] - at[begin] + size[stop]).tolist(), strict=True)) if len(at) else []
            lists = np.searchsorted(np.array([r[0] for r in rows], np.int64), np.arange(len(n) + 1)).astype(np.int32)
            columns = [pa.array([r[k] for r in rows], x.type) for k, x in enumerate(_MATCH, start=1)]
            return {"n_words": n, "matches": pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays(columns, fields=list(_MATCH)))}

        return f

    return annotated(docs, text_col, name, FOUND, make, step_bytes)


def _covered(matches: Column) -> Column:
    """How many words the matches cover together."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["doc_word"].cast("long").alias("start"), (m["doc_word"] + m["n_words"]).cast("long").alias("stop"))))
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    add = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], a["end"]))).alias("n"), F.greatest(a["end"], s["stop"]).alias("end"))
    return F.aggregate(spans, nothing, add, lambda a: a["n"])


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, name: str = "found", width: int = 13, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", part_bytes: int = PART_BYTES, step_bytes: int = STEP_BYTES) -> DataFrame:
    """Add a struct column: n_words, n_hit, items (with an occurring window, sorted as strings), matches.

    Words are maximal runs of digits, letters a-z and non-ASCII characters after lower-casing A-Z.  A window is
    `width` consecutive words of an item; a shorter item is one window, an item without words none.  n_hit counts
    the document's words inside any occurrence of a window; matches are the longest verbatim runs (of a window at
    least), with word numbers from 0 in document and item.  Null and empty texts have no words and no hits; a very
    long text is a shard of its own; repeated rows get a result each.  Items with a null id or text play no part; items
    that share an id count as one.  An empty table on either side gives no hits.  All columns of `docs`, whatever
    their names, are returned; the struct takes the place of a column of its own name.
    """
    columns = [c for c in docs.columns if c.lower() != name.lower()]
    docs = docs.select([F.col(f"`{c}`") for c in columns])
    own, done = free_name(docs, "part"), None
    for part in _parts(benchmark, item_id, item_text, width, part_bytes):
        if done is None:
            done = _matched(docs, part, own, text_col, step_bytes)
            continue
        before = free_name(done, "before")
        done = _matched(checkpointed(done).withColumnRenamed(own, before), part, own, text_col, step_bytes)
        both = F.struct(F.col(f"{own}.n_words").alias("n_words"), F.concat(f"{before}.matches", f"{own}.matches").alias("matches"))
        done = done.withColumn(own, both).drop(before)
    if done is None:
        done = _matched(docs, None, own, text_col, step_bytes)
    matches = F.col(f"{own}.matches")
    items = F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["item"])))
    found = F.struct(F.col(f"{own}.n_words").alias("n_words"), _covered(matches).alias("n_hit"), items.alias("items"), matches.alias("matches"))
    return done.select([*[F.col(f"`{c}`") for c in columns], found.alias(name)])


def is_contaminated(found: str = "found"):
    """At least one word in twenty, and one at all, stands in a benchmark passage."""
    return (F.col(f"{found}.n_hit") > 0) & (20 * F.col(f"{found}.n_hit") >= F.col(f"{found}.n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    name = free_name(docs, "found")
    return benchmark_matches(docs, benchmark, name=name, **options).filter(~is_contaminated(name)).select([F.col(f"`{c}`") for c in docs.columns])
