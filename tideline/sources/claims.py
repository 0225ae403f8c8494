"""Small JSON notes that exactly one writer can create; they are the points at which a commit, a fold or a snapshot counts.

A note appears with its whole content or not at all: it is written beside its place and moved there, and the move fails if
the place is taken. Stores without an atomic move that refuses to replace are not fit for writers that run at the same time.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def create(spark: SparkSession, path: str, note: dict) -> bool:
    """Create the note at ``path``. False if there is one."""
    jvm = spark._jvm
    place, files = _files(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}.{uuid.uuid4().hex}")
    out = files.create(beside, True)
    out.write(bytearray(json.dumps(note, sort_keys=True).encode()))
    out.close()
    try:
        if files.getScheme() == "file":  # a local rename replaces; a second name for a file does not
            paths = [jvm.java.nio.file.Paths.get(files.makeQualified(p).toUri()) for p in (place, beside)]
            jvm.java.nio.file.Files.createLink(*paths)
        else:
            rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            keep = spark.sparkContext._gateway.new_array(rename, 1)
            keep[0] = rename.NONE
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(files.makeQualified(beside), files.makeQualified(place), keep)
        return True
    except Py4JJavaError as error:
        if "AlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False
    finally:
        files.delete(beside, False)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder in ascending order, none if it does not exist."""
    place, files = _files(spark, folder)
    if not files.exists(place):
        return []
    found = [status.getPath().getName() for status in files.listStatus(place)]
    return sorted(name for name in found if not name.startswith((".", "_")))


def read(spark: SparkSession, path: str) -> dict:
    place, files = _files(spark, path)
    stream = files.open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file, or a folder with all in it."""
    place, files = _files(spark, path)
    files.delete(place, True)


def number(n: int) -> str:
    """A number as a name, so that names sort as numbers do."""
    return f"{n:020d}"


def bound_name(spark: SparkSession, root: str, run: str, checkpoint: str) -> str:
    """The name under which the checkpoint with that id writes: ``run`` for the first one, one of its own for others.

    A new checkpoint numbers its batches from 0 again. Under the name of an earlier one they would pass for stored.
    """
    note = f"{root}/runs/{run}"
    if create(spark, note, {"checkpoint": checkpoint}) or read(spark, note)["checkpoint"] == checkpoint:
        return run
    return f"{run}@{checkpoint}"
