"""Small state files beside the tables of an incremental operator, on whatever file system the path names."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_state(spark: SparkSession, path: str) -> dict | None:
    """The state written last, or None where there is none yet."""
    fs, p = _file(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def write_state(spark: SparkSession, path: str, state: dict) -> None:
    """Replace the state. It is written beside and renamed, so a reader sees the old state or the new one."""
    fs, p = _file(spark, path)
    _, beside = _file(spark, f"{path}.new")
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(json.dumps(state).encode()))
    finally:
        stream.close()
    fs.delete(p, False)
    if not fs.rename(beside, p):
        raise OSError(f"cannot write {path}")


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _file(spark, path)
    fs.delete(p, True)
