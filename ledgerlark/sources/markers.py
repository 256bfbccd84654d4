"""Small marker files in a shared folder: put-if-absent, the one step that must be atomic between drivers.

Claims of a day, leases and table versions are markers. Each is some bytes, their number is bounded by what
they name (days, buckets, versions), and only drivers write them.
"""

from __future__ import annotations

import datetime as dt
import os
from urllib.parse import unquote, urlparse

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def make_folder(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.mkdirs(target)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Whether this call made the file.

    Spark's view of local files has no exclusive create, so a file: path is made by the operating system; other stores
    refuse to create what is there.
    """
    local = urlparse(path)
    if local.scheme in ("", "file"):
        name = unquote(local.path)
        os.makedirs(os.path.dirname(name), exist_ok=True)
        whole = f"{name}.{os.getpid()}.{id(text)}.new"
        with open(whole, "w") as f:
            f.write(text)
        try:
            os.link(whole, name)  # whole or not at all, and never over another
        except FileExistsError:
            return False
        finally:
            os.unlink(whole)
        return True
    fs, target = _fs(spark, path)
    try:
        out = fs.create(target, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def names(spark: SparkSession, folder: str) -> list[str]:
    """The markers of a folder, in order; none where there is no folder."""
    fs, target = _fs(spark, folder)
    if not fs.exists(target):
        return []
    return sorted(n for s in fs.listStatus(target) if not (n := s.getPath().getName()).endswith((".new", ".crc")))


def text(spark: SparkSession, path: str) -> str:
    fs, target = _fs(spark, path)
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def claim_day(spark: SparkSession, folder: str, job: str, when: dt.datetime) -> bool:
    """Whether this is the first run of the job on that day; a second one gets False, whichever driver asks."""
    return put_if_absent(spark, f"{folder}/{job}/{when:%Y-%m-%d}", when.isoformat())


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)
