"""Substring dedup: repeated windows of a fixed number of words merge into maximal removal intervals.

Every window's Rabin-Karp hash is computed.  A first count works on one short run of words per window, chosen
by content (the run with the least hash), so that equal windows choose equal runs; a window whose run occurs
once in the whole table cannot repeat and is settled.  The hashes of all other windows, 128 bits each, are counted by
Spark and get their first place, in order of (id, position); every other place is a repeat.

Documents travel in blocks (see _blocks).  A block sends a run or window once, so one that stands in every document is a row
a block; rows are dealt by their hash, and what is found out about them is joined back by block.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dispensary.llm import _blocks as B
from dispensary.llm._spark import documents
from dispensary.llm._text import SPACED, STEP_BYTES, windows, words

OUT = "id long, n_words long, n_removed long, kept string, removed array<struct<start:int,stop:int>>"
_SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
_OUT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("removed", pa.list_(_SPAN))])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` entries; runs that pass the end are cut short."""
    x, have = x.copy(), 1
    while have < width:
        by = min(have, width - have)
        x[:-by] = np.minimum(x[:-by], x[by:])
        have += by
    return x


def _new(*keys: np.ndarray) -> np.ndarray:
    """In sorted keys, which entries differ from the one before."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


class _Windows:
    """Windows of one block."""

    def __init__(self, data, offsets, width: int):
        self.words = words(data, offsets, SPACED, lower=False)
        self.n, self.width = len(self.words.starts), width
        self.left = self.words.left()
        self.hash = self.words.hashes()
        self.at = np.flatnonzero(self.left >= width)

    def runs(self, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct chosen runs, the number of each window's one, and which stand in the block twice."""
        runs = windows(self.hash, run)
        runs[self.left < run] = ~np.uint64(0)
        chosen = _least(runs, self.width - run + 1)[self.at] if len(self.at) else runs[:0]
        values, value_of = np.unique(chosen, return_inverse=True)
        runs.sort()
        return values, value_of, np.searchsorted(runs, values, side="right") - np.searchsorted(runs, values) > 1

    def hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return windows(self.hash, self.width)[at], windows(self.words.hashes(1), self.width)[at]

    def suspects(self, run: int, elsewhere: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows whose run occurs again, here or in another block, the first of equal ones: place and hash."""
        values, value_of, again = self.runs(run)
        at = self.at[(again | np.isin(values, elsewhere))[value_of]]
        h1, h2 = self.hashes(at)
        by = np.lexsort((h2, h1))
        by = by[_new(h1[by], h2[by])] if len(by) else by
        return at[by], h1[by], h2[by]

    def covered(self, later1: np.ndarray, later2: np.ndarray) -> np.ndarray:
        """Words that a repeated window covers: one that also stands earlier here, or is among `later`."""
        h1 = windows(self.hash, self.width)[self.at]
        by = np.argsort(h1, kind="stable")
        new = _new(h1[by]) if len(by) else np.zeros(0, bool)
        alone = np.zeros(len(by), bool)
        alone[by] = new & np.append(new[1:], True)[: len(by)]
        at = self.at[~alone | np.isin(h1, later1)]
        h1, h2 = self.hashes(at)
        kind = np.concatenate((np.zeros(len(later1), np.int8), np.ones(len(at), np.int8)))
        h1, h2 = np.concatenate((later1, h1)), np.concatenate((later2, h2))
        by = np.lexsort((np.arange(len(h1)), h2, h1))  # what is repeated already comes first, then places in their order
        repeat = np.zeros(len(by), bool)
        repeat[by] = ~_new(h1[by], h2[by]) if len(by) else repeat
        edge = np.zeros(self.n + 1, np.int64)
        hit = at[repeat[kind == 1]]
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + self.width, -1)
        return np.cumsum(edge)[: self.n] > 0


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _hashes(column) -> np.ndarray:
    return np.asarray(column).astype(np.int64).view(np.uint64)


def substring_dedup(docs: DataFrame, width: int = 20, run: int = 8, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = STEP_BYTES) -> DataFrame:
    """Remove every word that a window covers whose words also start earlier (smaller id, or same document).

    Returns (id, n_words, n_removed, kept, removed): the kept words joined by one space, and the maximal
    removed intervals in word numbers.  Null and empty texts have no words and keep an empty text.  A null id
    sorts before all others; rows that share an id are separate documents, one of which counts as earlier.
    A very long text is a block of its own.  An empty table gives an empty result.  Other columns, whatever their names, are ignored.
    """
    return _removed(documents(docs, id_col, text_col), width, run, block_bytes)


def _removed(docs: DataFrame, width: int = 20, run: int = 8, block_bytes: int = STEP_BYTES) -> DataFrame:
    """The result of substring_dedup for (id, text).  Of (id, text, rest), each row's own `rest` with the text that
    it has now and whether that is a new one; `rest` is a struct, whose first field says whether the text is null."""
    if not 0 < run <= width:
        raise ValueError("run must be from 1 to width")
    packed = B.blocks(docs, block_bytes)

    def send(batches):
        for b in batches:
            for i in range(b.num_rows):
                runs = _Windows(*B.opened(b.column("ids")[i], b.column("body")[i])[1:], width).runs(run)[0]
                yield pa.RecordBatch.from_arrays([_signed(runs), pa.array(np.full(len(runs), b.column("block")[i].as_py(), np.int64))], names=["run", "of_block"])

    def suspects(block, ids, data, offsets, got):
        w = _Windows(data, offsets, width)
        at, h1, h2 = w.suspects(run, _hashes(got.column("run")))
        keys = np.array([B.NO_ID if x is None else x for x in ids], np.int64)
        owner = np.searchsorted(w.words.first, at, side="right") - 1
        return pa.RecordBatch.from_arrays([_signed(h1), _signed(h2), pa.array(keys[owner] if len(at) else at), pa.array(np.full(len(at), block, np.int64))], names=["h1", "h2", "key", "of_block"])

    def finish(block, ids, data, offsets, got, rest=None):
        w = _Windows(data, offsets, width)
        gone = w.covered(_hashes(got.column("h1")), _hashes(got.column("h2")))
        first, counts = w.words.first, w.words.counts()
        total = np.zeros(w.n + 1, np.int64)
        np.cumsum(gone, out=total[1:])
        removed = total[first[1:]] - total[first[:-1]]
        kept = []
        for k in range(len(ids)):
            parts = data[offsets[k] : offsets[k + 1]].tobytes().split()
            kept.append(b" ".join(compress(parts, (~gone[first[k] : first[k + 1]]).tolist()) if removed[k] else parts))
        if rest is not None:
            texts = [None if null else new if cut else data[i:j].tobytes() for null, new, cut, i, j in zip(rest.field(0).to_pylist(), kept, removed.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([rest, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(removed > 0)], names=["rest", "text", "changed"])
        begins = np.zeros(w.n, bool)
        begins[first[:-1][counts > 0]] = True
        before, after = np.zeros(w.n, bool), np.zeros(w.n, bool)
        before[1:], after[:-1] = gone[:-1], gone[1:]
        after[first[1:][counts > 0] - 1] = False
        starts, stops = np.flatnonzero(gone & (~before | begins)), np.flatnonzero(gone & ~after) + 1
        doc = np.searchsorted(first, starts, side="right") - 1
        base = first[:-1][doc] if len(doc) else starts
        spans = pa.StructArray.from_arrays([pa.array((starts - base).astype(np.int32)), pa.array((stops - base).astype(np.int32))], fields=list(_SPAN))
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(ids) + 1)).astype(np.int32)), spans)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string()), lists], schema=_OUT)

    runs = packed.mapInArrow(send, "run long, of_block long").repartition("run")  # dealt once, for both uses
    elsewhere = runs.join(runs.groupBy("run").agg(F.count("*").alias("n")).filter("n > 1"), "run").select("of_block", "run")
    seen = B.with_rows(packed, elsewhere, suspects, "h1 long, h2 long, key long, of_block long").repartition("h1", "h2")
    first = seen.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("key", "of_block")).alias("first")).filter("n > 1")
    later = seen.join(first, ["h1", "h2"]).filter(F.struct("key", "of_block") != F.col("first")).select("of_block", "h1", "h2")
    if "rest" not in docs.columns:
        return B.with_rows(packed, later, finish, OUT)
    return B.with_rows(packed, later, finish, StructType([docs.schema["rest"]]).add("text", "string").add("changed", "boolean"), rest=True)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """The documents with what is kept of their texts, in their own columns; all of them, even if nothing is left.

    A text from which nothing is removed stays as it is, white space included.  `length_col`, where the table has
    it, is set to the new length in characters.  The other columns travel with the text, so that rows without an id,
    rows that share one, and equal rows each get their own text; of equal rows one keeps the passage."""
    rest = F.struct(F.col(text_col).isNull().alias("null"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text_col])
    done = _removed(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), rest.alias("rest")), **options)
    new = {c: F.col(f"rest.c{k}") for k, c in enumerate(docs.columns) if c != text_col} | {text_col: F.col("text")}
    if length_col in docs.columns:
        new[length_col] = F.when(F.col("changed"), F.length("text")).otherwise(new[length_col]).cast(docs.schema[length_col].dataType)
    return done.select([new[c].alias(c) for c in docs.columns])
