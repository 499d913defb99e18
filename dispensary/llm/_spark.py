"""Small helpers that the operators share on the Spark side."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispensary.llm._text import flat, steps


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only in local runs that name none, as in tests, a new one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def few(df: DataFrame, most: int = 20_000) -> DataFrame:
    """The rows, counted first: sent to all tasks while there are at most so many, else joined like any other table."""
    df = checkpointed(df)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names; other columns and their names play no part."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def text_key(text):
    """128-bit digest of a text, a null one being empty; beside the id it tells rows apart that share one."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256), 1, 32))


def text_keys(texts) -> list[bytes]:
    """The same in a task."""
    return [hashlib.sha256((x or "").encode()).digest()[:16] for x in texts.to_pylist()]


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def give_back() -> None:
    """Return the memory that a block needed to the machine; Python workers live on between tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # a C library without it keeps nothing of that size
        trim(0)


def pack(items: list[bytes]) -> bytes:
    """A list of byte strings as one compressed byte string."""
    sizes = np.fromiter(map(len, items), np.int32, len(items))
    return squeeze(np.int32(len(items)).tobytes() + sizes.tobytes() + b"".join(items))


def unpack(data: bytes) -> list[bytes]:
    data = unsqueeze(data)
    n = int(np.frombuffer(data, np.int32, 1)[0])
    ends = np.cumsum(np.frombuffer(data, np.int32, n, 4)).tolist()
    at = 4 + 4 * n
    out, last = [], at
    for e in ends:
        out.append(data[last : at + e])
        last = at + e
    return out


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in zip(schema, (columns[f.name] for f in schema), strict=True)], schema=schema)


def steps_of(batches, size: int):
    """Regroup Arrow batches of documents into batches of up to `size` bytes of text (one document at least)."""
    held, held_bytes = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        _, offsets = flat(b.column("text"))
        for first, last in steps(offsets, size):
            n = int(offsets[last] - offsets[first])
            if held and held_bytes + n > size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, held_bytes = [], 0
            held.append(b.slice(first, last - first))
            held_bytes += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
