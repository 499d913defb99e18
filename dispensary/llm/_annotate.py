"""Add one struct column to a table of documents, computed from whole texts in one pass without a shuffle."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from dispensary.llm._spark import give_back
from dispensary.llm._text import flat, steps


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have yet (names are matched without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def annotated(docs: DataFrame, text_col: str, name: str, ddl: str, make, step_bytes: int) -> DataFrame:
    """All columns of `docs` and a struct column `name` of type `ddl`.

    make() is called once a task and gives f(data, offsets) -> {field: Arrow array}, one entry a document."""
    kind = StructType.fromDDL(ddl)
    schema = StructType([*docs.schema.fields, StructField(name, kind)])
    arrow, fields = to_arrow_schema(schema), to_arrow_schema(kind)
    at = docs.columns.index(text_col)

    def each(batches):
        f = make()
        for b in batches:
            if not b.num_rows:
                continue
            data, offsets = flat(b.column(at))
            for first, last in steps(offsets, step_bytes):
                got = f(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                found = pa.StructArray.from_arrays([got[x.name] if isinstance(got[x.name], pa.Array) else pa.array(got[x.name], x.type) for x in fields], fields=list(fields))
                part = b.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*(c.cast(x.type) for c, x in zip(part.columns, arrow, strict=False)), found], schema=arrow)
                del got, found, part
                give_back()

    return docs.mapInArrow(each, schema)
