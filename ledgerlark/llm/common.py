"""Reading, staging in the shared folder, and Arrow plumbing for the llm operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word contract: U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of an Arrow batch: what a Python worker and its JVM side hold of the input at once, but for one long row.
BATCH_BYTES = 16 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_own_base: dict[str, str] = {}
_staged: dict[str, list[str]] = {}
_cleaned: set[str] = set()


_own_thread = threading.local()


def _scopes() -> list[list[str]]:
    """For this thread, the lists of paths that staged_from() will remove."""
    if not hasattr(_own_thread, "scopes"):
        _own_thread.scopes = []
    return _own_thread.scopes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where that is unset and the master is local, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: staged tables need a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_base:
        _own_base[app] = "file://" + tempfile.mkdtemp(prefix="ledgerlark-")
    return _own_base[app]


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/ledgerlark/{tag}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _cleaned:
        _cleaned.add(app)
        atexit.register(_clean, spark, app)
    _staged.setdefault(app, []).append(path)
    if _scopes():
        _scopes()[-1].append(path)
    return path


def _clean(spark: SparkSession, app: str) -> None:
    for path in _staged.pop(app, []):
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before the interpreter
            return


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_from(build: Callable[[], DataFrame], spark: SparkSession, tag: str) -> DataFrame:
    """staged() of what build returns; what build staged on the way goes as soon as the result is written."""
    _scopes().append([])
    try:
        df = build()
    finally:
        made = _scopes().pop()
    out = staged(df, tag)
    for path in made:
        delete(spark, path)
        _staged[spark.sparkContext.applicationId].remove(path)
    return out


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: What a Python worker keeps from one task to the next, by name, and how to let go of it.
_kept: dict[str, Callable[[], None]] = {}


def worker_cache(name: str, forget: Callable[[], None]) -> None:
    _kept[name] = forget


def tidy(keep: str | None = None) -> None:
    """Let go of what other operators keep in this worker, and give freed memory back: a worker serves all stages in turn."""
    for name, forget in _kept.items():
        if name != keep:
            forget()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def bound_batches(spark: SparkSession) -> None:
    """Set the session's bytes of an Arrow batch to BATCH_BYTES where it has no setting of its own.

    For the queries and pipelines that own their session; operators leave it as it is.
    """
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def map_arrow(
    df: DataFrame,
    fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: T.StructType | str,
    keep: str | None = None,
) -> DataFrame:
    """mapInArrow() between two tidyings of the worker; keep: the worker cache it uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy(keep)
        yield from fn(batches)
        tidy(keep)

    return df.mapInArrow(run, schema)
