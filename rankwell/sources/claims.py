"""Numbered records that exactly one writer can make, in a folder that all writers share.

A record is written beside its place and renamed into it, which fails where the place is taken; on file systems whose
renames check that in one step (HDFS does), two writers never get the same number. Object stores need a committer that
offers the same.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_TAKEN = "FileAlreadyExistsException"


def _hadoop(spark: SparkSession, path: str):
    files = spark._jvm.org.apache.hadoop.fs
    place = files.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return files, system, system.makeQualified(place)


def names(spark: SparkSession, folder: str) -> list[tuple[str, float]]:
    """(name, seconds since 1970 when it last changed) of what lies in ``folder``; none if it is not there."""
    _, system, place = _hadoop(spark, folder)
    if not system.exists(place):
        return []
    return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in system.listStatus(place)]


def delete(spark: SparkSession, path: str) -> None:
    _, system, place = _hadoop(spark, path)
    system.delete(place, True)


def _read(spark: SparkSession, path: str) -> dict:
    files, system, place = _hadoop(spark, path)
    size = system.getFileStatus(place).getLen()
    stream = system.open(place)
    try:
        return json.loads(bytes(stream.readNBytes(size)))
    finally:
        stream.close()


def make(spark: SparkSession, folder: str, name: str, record: dict) -> bool:
    """Whether ``record`` now stands at ``name``, which nobody had taken."""
    files, system, place = _hadoop(spark, f"{folder}/{name}")
    beside = files.Path(f"{folder}/.{name}-{uuid.uuid4().hex}")
    stream = system.create(beside, True)
    stream.write(bytearray(json.dumps(record).encode()))
    stream.close()
    context = files.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration())
    how = getattr(files, "Options$Rename")
    flags = spark.sparkContext._gateway.new_array(how, 1)
    flags[0] = how.NONE
    try:
        context.rename(system.makeQualified(beside), place, flags)
    except Py4JJavaError as error:
        system.delete(beside, False)
        if _TAKEN in error.java_exception.getClass().getName():
            return False
        raise
    return True


def claim(spark: SparkSession, folder: str, following: Callable[[int, list[dict]], dict], keep: Callable[[dict], bool]) -> dict:
    """Claim the next number: ``following(number, records)`` says what to write, given the ``keep`` records so far.

    Where another writer takes the number first, its record is read and the next number tried.
    """
    while True:
        numbers = sorted(int(name) for name, _ in names(spark, folder) if name.isdigit())
        records = [r for n in numbers if keep(r := _read(spark, f"{folder}/{n:020d}"))]
        number = numbers[-1] + 1 if numbers else 0
        record = following(number, records)
        if make(spark, folder, f"{number:020d}", record):
            return record
