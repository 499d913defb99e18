"""Small files and folders on whatever file system a path names, through Spark's own client."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if there is none."""
    at, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)


def put(spark: SparkSession, path: str, text: str, replace: bool = False) -> None:
    """One file with this text; unless it may replace one, an error if there is one."""
    at, fs = _at(spark, path)
    out = fs.create(at, replace)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def get(spark: SparkSession, path: str) -> str:
    at, fs = _at(spark, path)
    with_ = fs.open(at)
    try:
        return bytearray(with_.readAllBytes()).decode()
    finally:
        with_.close()


def begin(spark: SparkSession, path: str, n: int) -> bytes:
    """The first n bytes of a file, or all that it has."""
    at, fs = _at(spark, path)
    with_ = fs.open(at)
    try:
        return bytes(with_.readNBytes(n))
    finally:
        with_.close()
