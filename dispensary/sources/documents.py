"""One JSON document of any size: its lists are written by tasks as ordered part files, which are then put together as one file.

The driver never holds a list.  It passes the bytes of the parts on, one after the other, on the file system that they are on.
A document appears under its name only when it is whole.

A document whose name ends in .gz-joined is one gzip file: the compressed parts as they are, one behind the other, which is how gzip files are
joined.  Before each stands a seam, an empty gzip member with a comment that is drawn for the document, so that tasks read
between seams, where a gzip file as such could only be read from its beginning.
"""

from __future__ import annotations

import gzip
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dispensary.sources import files

#: Bits of monotonically_increasing_id that count the rows of a partition.
_ROW_BITS = (1 << 33) - 1

#: What names of compressed documents end in; by a name that ends in .gz, readers would begin at the beginning.
JOINED = ".gz-joined"

#: Items in a part file.
ITEMS = 50_000

#: A seam: the header of a gzip member with a comment, the comment (32 characters), its end and the member's empty contents.
_HEADER, _COMMENT, _EMPTY = b"\x1f\x8b\x08\x10\0\0\0\0\0\xff", 32, b"\0\x03\0" + bytes(8)

#: Bytes that are inflated at once.
_PIECE = 4 << 20

#: Rows, the JSON of a row, and order; without an order, rows stay as they come.
Rows = tuple[DataFrame, Column, list]


def _parts(rows: DataFrame, item: Column, order: list, path: str) -> None:
    """Compressed files whose names are in order, an item a line; within a partition, lines but the first begin with a comma.

    What is sorted is the text, which takes less of the disk than rows of many fields."""
    items = rows.select(*order, item.alias("item"))
    ordered = (items.orderBy(*order) if order else items).select("item", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)).alias("row"))
    lines = ordered.select(F.when(F.col("row") == 0, F.col("item")).otherwise(F.concat(F.lit(","), "item")).alias("value"))
    lines.write.option("maxRecordsPerFile", ITEMS).text(path, compression="gzip")


def _in_order(names: list[str]) -> list[tuple[str, bool]]:
    """The part files by partition and number, and whether a file is the first of its partition."""
    numbered = [(int(m[1]), int(m[2]), name) for name in names if (m := re.match(r"part-(\d+)-.*-c(\d+)\.", name))]
    return [(name, file == 0) for _, file, name in sorted(numbered)]


def write_document(spark: SparkSession, path: str, head: str, lists: dict[str, Rows | list[Rows]]) -> None:
    """The object `head`, as JSON text, with further fields: name -> (rows, the JSON of a row, order), or some of these one after the other; a line an item.

    A part goes once it is passed on, so the disk holds little more than the document; a run that fails leaves no file of the document's name behind, nor replaces one."""
    at = f"{path}.parts-{uuid.uuid4().hex}"
    folders: dict[str, list[str]] = {}
    for k, (name, rows) in enumerate(lists.items()):
        folders[name] = [f"{at}/{k}/{i}" for i in range(len(rows) if isinstance(rows, list) else 1)]
        for folder, own in zip(folders[name], rows if isinstance(rows, list) else [rows], strict=True):
            _parts(*own, folder)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    whole = jvm.org.apache.hadoop.fs.Path(f"{at}/whole")
    fs = whole.getFileSystem(conf)
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    joined, seam = path.endswith(JOINED), _HEADER + uuid.uuid4().hex.encode() + _EMPTY
    out = fs.create(whole, True)

    def put(text: str) -> None:
        out.write(bytearray(gzip.compress(text.encode(), mtime=0) if joined else text.encode()))

    try:
        if joined:
            out.write(bytearray(seam))
        put(head.strip().removesuffix("}"))
        for k, name in enumerate(lists):
            begin = "," if k or head.strip() not in ("{}", "{ }") else ""
            put(f'{begin}"{name}":[\n')
            some = False
            for folder in folders[name]:
                for part, first in _in_order(files.names(spark, folder)):
                    own = jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}")
                    with_ = codecs.getCodec(own).createInputStream(fs.open(own))
                    try:
                        begins = with_.read()
                        if begins >= 0:  # a part without rows holds nothing
                            if some and first:
                                put(",")
                            some = True
                            if not joined:
                                out.write(begins)
                                jvm.org.apache.hadoop.io.IOUtils.copyBytes(with_, out, 1 << 16, False)
                    finally:
                        with_.close()
                    if joined and begins >= 0:
                        out.write(bytearray(seam))
                        as_it_is = fs.open(own)
                        try:
                            jvm.org.apache.hadoop.io.IOUtils.copyBytes(as_it_is, out, 1 << 16, False)
                        finally:
                            as_it_is.close()
                    fs.delete(own, False)
            put("]")
        put("}\n")
    finally:
        out.close()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs.delete(target, True)
    if not fs.rename(whole, target):
        raise OSError(f"{path} could not be put in place")
    files.delete(spark, at)


def _inflated(data: bytes) -> Iterator[bytes]:
    """What gzip members one behind the other hold, in pieces."""
    while data:
        member = zlib.decompressobj(31)
        while not member.eof:
            piece = member.decompress(data, _PIECE)
            if not piece and not member.eof:
                raise EOFError("a gzip member is cut off")
            data = member.unconsumed_tail
            yield piece
        data = member.unused_data


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of what stands between seams."""
    for batch in batches:
        for value in batch.column(0):
            rest = b""
            for piece in _inflated(value.as_py().removeprefix(_EMPTY).removesuffix(_HEADER)):
                *lines, rest = (rest + piece).split(b"\n")
                yield pa.record_batch([pa.array(lines, pa.string())], ["value"])
            yield pa.record_batch([pa.array([rest], pa.string())], ["value"])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of a document that write_document made, read in parallel."""
    if not path.endswith(JOINED):
        return spark.read.text(path)
    begin = files.begin(spark, path, len(_HEADER) + _COMMENT)
    if not begin.startswith(_HEADER):
        raise ValueError(f"{path} has no seams")
    return spark.read.text(path, lineSep=begin[len(_HEADER) :].decode()).select(F.col("value").cast("binary")).mapInArrow(_lines, "value string")


def read_items(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """The items of one list of a document that write_document made, as rows; lines are read in parallel.

    An item's line is known by the JSON that it holds, so lists are told apart by a field that only one of them has."""
    line = F.ltrim("value", F.lit(","))
    # only lines with the field are parsed, and each once: no filter is pushed through a list of one
    lines = read_lines(spark, path).filter(F.contains("value", F.lit(f'"{name}":')) & line.startswith("{") & F.col("value").endswith("}"))
    return lines.select(F.explode(F.array(F.from_json(line, schema))).alias("item")).filter(F.col(f"item.{name}").isNotNull()).select("item.*")
