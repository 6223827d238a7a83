"""Single small files beside tables, in whatever store the path names, by the file systems that Spark has."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _place(spark, path)
    return store.exists(place)


def read_text(spark: SparkSession, path: str) -> str:
    store, place = _place(spark, path)
    if not store.exists(place):
        raise FileNotFoundError(path)
    stream = store.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def read_json(spark: SparkSession, path: str):
    return json.loads(read_text(spark, path))


def write_json(spark: SparkSession, path: str, value: object, replace: bool = False) -> None:
    """The value as JSON in a file that is there whole or not at all: written beside its place and then renamed."""
    store, place = _place(spark, path)
    if store.exists(place) and not replace:
        raise ValueError(f"{path} exists")
    _, beside = _place(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = store.create(beside, False)
    try:
        stream.write(bytearray((json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode()))
    finally:
        stream.close()
    if store.exists(place):
        store.delete(place, False)
    if not store.rename(beside, place):
        store.delete(beside, False)
        raise OSError(f"{path} was not written")
