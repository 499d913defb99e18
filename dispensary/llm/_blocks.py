"""Documents packed into blocks: the unit that travels when a step needs whole texts again.

A block holds a few megabytes of documents, compressed, in one row.  Steps that must compare content across
the whole table send only fingerprints, one row (fingerprint, block) for each distinct one of a block.  Spark groups
them, and what is found out is joined back by block.  A fingerprint that occurs everywhere is a row a block, never a
row an occurrence.

A block is made of the rows in the order in which a task reads them, so the input is one that reads the same again: a
table, or a checkpoint.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

from dispensary.llm._spark import give_back, squeeze, steps_of, unsqueeze
from dispensary.llm._text import STEP_BYTES, flat

BLOCKS = "block long, ids array<long>, body binary"
_BLOCKS = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("body", pa.binary())])

#: How a null id sorts: before every other.
NO_ID = -(1 << 63)


def blocks(docs: DataFrame, block_bytes: int = STEP_BYTES) -> DataFrame:
    """(id, text) as one row per block, dealt by block.  Used more than once, it is one exchange that Spark reuses.

    Inside a block documents stand in the order of their ids.  A struct column `rest` travels along, as a list."""
    schema, rest = StructType.fromDDL(BLOCKS), [c for c in docs.columns if c == "rest"]
    for c in rest:
        schema = schema.add(c, ArrayType(docs.schema[c].dataType))

    def pack(batches):
        part = TaskContext.get().partitionId()
        for k, t in enumerate(steps_of(batches, block_bytes)):
            t = t.take(pc.sort_indices(t, sort_keys=[("id", "ascending")], null_placement="at_start"))
            data, offsets = flat(t.column("text"))
            body = squeeze(offsets.tobytes() + data.tobytes())
            ids = pa.array([t.column("id").to_pylist()], pa.list_(pa.int64()))
            lists = [pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column(c).combine_chunks()) for c in rest]
            yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + k], pa.int64()), ids, pa.array([body], pa.binary()), *lists], names=[*_BLOCKS.names, *rest])
            del t, data, offsets, body, ids, lists
            give_back()

    return docs.select("id", "text", *rest).mapInArrow(pack, schema).repartition("block")


def opened(ids, body: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """ids, bytes and offsets of a block."""
    ids, body = ids.as_py(), unsqueeze(body.as_py())
    offsets = np.frombuffer(body, np.int64, len(ids) + 1)
    return ids, np.frombuffer(body, np.uint8, offset=offsets.nbytes), offsets


def opened_ids(packed: DataFrame) -> DataFrame:
    """(block, place, id): which document of a block has which id."""
    return packed.select("block", F.posexplode("ids").alias("place", "id"))


def with_rows(packed: DataFrame, rows: DataFrame, finish, schema: str, rest: bool = False) -> DataFrame:
    """finish(block number, ids, data, offsets, rows of that block) gives a RecordBatch; with `rest`, it also gets that
    list.  `rows` name their block `of_block`."""
    empty = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema).empty_table()

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty
        give_back()
        more = [left.column("rest")[0].values] if rest else []
        return pa.Table.from_batches([finish(left.column("block")[0].as_py(), *opened(left.column("ids")[0], left.column("body")[0]), right, *more)])

    return packed.groupBy("block").cogroup(rows.groupBy("of_block")).applyInArrow(block, schema)
