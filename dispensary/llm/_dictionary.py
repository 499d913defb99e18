"""Blocks of documents written as numbers into a block's own list of distinct pieces of text.

A table of distinct pieces for the whole corpus is too large to send to every task, and a row for every place
of every piece is larger than the corpus.  So a block (see _blocks) keeps its documents as piece numbers, and its
distinct pieces go out as compressed lists, one for each value of a byte of their hash.  Lists of up to FAN blocks meet in a
group, which makes them distinct.  With more blocks than that, what a group has is itself a list of distinct
pieces, which goes out by the next byte of the hash, until one group holds all that is alike; so the number of lists follows the
number of blocks, and no group grows with it.  There each distinct piece of the corpus is handled once, and the
results go back the way that the pieces came and are joined by position.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

from dispensary.llm import _blocks as B
from dispensary.llm._spark import give_back, pack, squeeze, steps_of, unpack, unsqueeze

#: Bytes of text in a block.
BLOCK_BYTES = 12 << 20


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2 ** 32, low bytes first, which compresses better than whole numbers."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _whole(data: bytes, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def _cut(texts, split) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(piece numbers, distinct pieces, pieces per text, bytes per text), for all texts at once."""
    texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "")
    lists = split(texts) if split else pc.ascii_split_whitespace(texts)
    encoded = lists.flatten().dictionary_encode()
    codes, words = np.asarray(encoded.indices).astype(np.int64), encoded.dictionary.cast(pa.binary()).to_pylist()
    ends = np.asarray(lists.offsets).astype(np.int64)
    ends -= ends[0]
    if not split and b"" in words:  # beside white space at either end
        blank = words.index(b"")
        full = codes != blank
        ends, codes = np.concatenate(([0], np.cumsum(full)))[ends], codes[full]
        codes, words = codes - (codes > blank), words[:blank] + words[blank + 1 :]
    return codes, words, np.diff(ends), np.asarray(pc.binary_length(texts)).astype(np.int64)


def coded(docs: DataFrame, split, frequencies: bool, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of (id, text); split(array of texts) gives the lists of their pieces; None stands for runs without white space.

    With `frequencies` a document keeps its distinct pieces and how often each stands in it, not their order.  A
    struct column `rest` travels along, as a list."""
    schema, rest = StructType.fromDDL(B.BLOCKS), [c for c in docs.columns if c == "rest"]
    for c in rest:
        schema = schema.add(c, ArrayType(docs.schema[c].dataType))

    def code(batches):
        part = TaskContext.get().partitionId()
        for k, t in enumerate(steps_of(batches, block_bytes)):
            codes, words, n_pieces, n_bytes = _cut(t.column("text"), split)
            by = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")  # frequent pieces get small numbers
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            codes, words = rank[codes], [words[i] for i in by.tolist()]
            times = np.zeros(0, np.int64)
            if frequencies and len(codes):
                pairs, times = np.unique(np.repeat(np.arange(len(n_pieces)), n_pieces) * len(words) + codes, return_counts=True)
                n_pieces, codes = np.bincount(pairs // len(words), minlength=len(n_pieces)), pairs % len(words)
                del pairs
            head = np.array([len(n_pieces), len(codes), len(times)], np.int64).tobytes()
            listed = pack(words)
            body = squeeze(head + n_pieces.astype(np.int64).tobytes() + n_bytes.tobytes() + _planes(codes) + _planes(times))
            body = np.int64(len(listed)).tobytes() + listed + body
            lists = [pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column(c).combine_chunks()) for c in rest]
            yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + k], pa.int64()), pa.array([t.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([body], pa.binary()), *lists], names=[*B._BLOCKS.names, *rest])
            del t, codes, words, times, by, rank, listed, body, lists
            give_back()

    return docs.select("id", "text", *rest).mapInArrow(code, schema).repartition("block")


def listed_words(body: bytes) -> list[bytes]:
    """The distinct pieces of a block."""
    return unpack(body[8 : 8 + int(np.frombuffer(body, np.int64, 1)[0])])


def coded_texts(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces per document, bytes per document, piece numbers, how often (or nothing)."""
    data = unsqueeze(body[8 + int(np.frombuffer(body, np.int64, 1)[0]) :])
    n_docs, n_codes, n_times = np.frombuffer(data, np.int64, 3).tolist()
    at = 24 + 16 * n_docs
    return np.frombuffer(data, np.int64, n_docs, 24), np.frombuffer(data, np.int64, n_docs, 24 + 8 * n_docs), _whole(data, n_codes, at), _whole(data, n_times, at + 4 * n_codes)


#: Lists that meet in a group, and lists that a block's pieces go out in.
FAN = 256

_LETTERS = "prefix long, owner long, bucket long, payload binary"
_LETTER = pa.schema([("prefix", pa.int64()), ("owner", pa.int64()), ("bucket", pa.int64()), ("payload", pa.binary())])


def _dealt(words: list[bytes], level: int) -> list[tuple[int, np.ndarray]]:
    """The values that byte `level` of the hashes has, and the places of the words with each of them."""
    byte = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) >> 8 * level & 255
    order = np.argsort(byte, kind="stable")
    bounds = np.searchsorted(byte[order], np.arange(257))
    return [(k, order[bounds[k] : bounds[k + 1]]) for k in np.flatnonzero(np.diff(bounds)).tolist()]


def _distinct(payloads) -> tuple[list[list[bytes]], list[bytes]]:
    lists = [unpack(p) for p in payloads.to_pylist()]
    return lists, list(dict.fromkeys(w for own in lists for w in own))


def _put(results: list, words: list[bytes], level: int, buckets, payloads) -> None:
    """Results that came back by bucket, at the places of their words."""
    came = {b & 255: p for b, p in zip(buckets.to_pylist(), payloads.to_pylist(), strict=True)}
    for k, places in _dealt(words, level):
        for i, x in zip(places.tolist(), unpack(came[k]), strict=True):
            results[i] = x


def _of_block(b: pa.RecordBatch):
    for owner, body in zip(b.column("block").to_pylist(), b.column("body").to_pylist(), strict=True):
        yield 0, owner, listed_words(body)


def _of_list(b: pa.RecordBatch):
    for prefix, owner, payload in zip(*(b.column(c).to_pylist() for c in ("prefix", "owner", "payload")), strict=True):
        yield prefix, owner, unpack(payload)


def _resolved(lists: DataFrame, read, make, n: int, level: int, fan: int) -> DataFrame:
    """(prefix, owner, bucket, payload): the results of the lists (prefix, owner, words) that `read` gives, `n` for a prefix, by bucket."""
    parts = -(-n // fan) if level < 3 else 1  # a hash has four bytes

    def split(batches):
        for b in batches:
            for prefix, owner, words in read(b):
                out = [(prefix << 8 | k, pack([words[i] for i in places.tolist()])) for k, places in _dealt(words, level)]
                yield pa.RecordBatch.from_arrays([pa.array([prefix] * len(out), pa.int64()), pa.array([owner] * len(out), pa.int64()), pa.array([k for k, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], schema=_LETTER)

    part = F.pmod(F.xxhash64("owner"), F.lit(parts)).cast("long")
    letters = lists.mapInArrow(split, _LETTERS).withColumn("part", part)
    held: list = []

    def back(t: pa.Table, lists: list, known: dict) -> pa.Table:
        return t.drop_columns(["part"]).set_column(3, "payload", pa.array([pack([known[w] for w in own]) for own in lists], pa.binary())).cast(_LETTER)

    def answer(t: pa.Table) -> pa.Table:
        if not held:
            held.append(make())
        own, distinct = _distinct(t.column("payload"))
        return back(t, own, dict(zip(distinct, held[0](distinct), strict=True)))

    if parts == 1:
        return letters.groupBy("bucket").applyInArrow(answer, _LETTERS)

    def merge(t: pa.Table) -> pa.Table:
        distinct = _distinct(t.sort_by("owner").column("payload"))[1]
        return pa.table({"prefix": t.column("bucket").slice(0, 1), "owner": t.column("part").slice(0, 1), "payload": pa.array([pack(distinct)], pa.binary())})

    def spread(t: pa.Table, came: pa.Table) -> pa.Table:
        t = t.sort_by("owner")
        own, distinct = _distinct(t.column("payload"))
        results = [b""] * len(distinct)
        _put(results, distinct, level + 1, came.column("bucket"), came.column("payload"))
        return back(t, own, dict(zip(distinct, results, strict=True)))

    merged = letters.groupBy("bucket", "part").applyInArrow(merge, "prefix long, owner long, payload binary")
    came = _resolved(merged, _of_list, make, parts, level + 1, fan)
    return letters.groupBy("bucket", "part").cogroup(came.groupBy("prefix", "owner")).applyInArrow(spread, _LETTERS)


def expected_blocks(docs: DataFrame, block_bytes: int) -> int:
    """About how many blocks (id, text) makes."""
    return 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes


def each_distinct(blocks: DataFrame, make, n_blocks: int, fan: int = FAN) -> DataFrame:
    """make() gives f(distinct pieces) -> one byte string a piece; the results go back to the blocks, by bucket."""
    return _resolved(blocks, _of_block, make, n_blocks, 0, fan)


def joined_back(blocks: DataFrame, answers: DataFrame, finish, schema: str) -> DataFrame:
    """finish(ids, pieces, results, pieces per document, bytes per document, piece numbers, how often) -> columns."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return arrow.empty_table()
        give_back()
        body = left.column("body")[0].as_py()
        words = listed_words(body)
        results = [b""] * len(words)
        _put(results, words, 0, right.column("bucket"), right.column("payload"))
        columns = finish(left.column("ids")[0].as_py(), words, results, *coded_texts(body))
        return pa.Table.from_arrays([c if isinstance(c, pa.Array | pa.ChunkedArray) else pa.array(c, x.type) for c, x in zip(columns, arrow, strict=True)], schema=arrow)

    return blocks.groupBy("block").cogroup(answers.groupBy("owner")).applyInArrow(block, schema)
