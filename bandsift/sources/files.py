"""Files of the shared store, by the file system that Spark itself uses for a path."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder, in order; none if it isn't there. For folders of bounded size."""
    fs, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder; false if it wasn't there."""
    fs, where = _at(spark, path)
    return fs.delete(where, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, where = _at(spark, old)
    target = spark._jvm.org.apache.hadoop.fs.Path(new)
    fs.mkdirs(target.getParent())
    if not fs.rename(where, target):
        raise OSError(f"{old} could not be renamed to {new}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file, which is there whole or not at all under its name."""
    fs, where = _at(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.draft")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not fs.rename(draft, where):
        raise OSError(f"{path} is there already")


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    size = fs.getFileStatus(where).getLen()
    data = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(data, size)).decode()
    finally:
        data.close()
