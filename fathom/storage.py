"""Intermediate tables in the folder that all machines of a cluster share.

The folder is the session's spark.checkpoint.dir. A local session that names none gets a temporary one; on a cluster
that would be lost with the machine, so there it is an error.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ARROW_ROWS, _ARROW_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch for Python while a table is written.
ARROW_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI that Spark can open."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='fathom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        _remove_at_exit(spark, found)
    return found if "://" in found else f"file://{found}" if found.startswith("/") and _is_local(spark) else found


def _is_local(spark: SparkSession) -> bool:
    return spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:")


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    atexit.register(remove, spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there and the session still runs."""
    with contextlib.suppress(Exception):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None if there is none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return None
    source = fs.open(target)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def table_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None if there is nothing at the path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.parquet(path)


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file, or put it in place of the one that is there, in one rename."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    fresh = hadoop.Path(f"{path}-{uuid.uuid4().hex[:8]}.tmp")
    out = fresh.getFileSystem(conf).create(fresh)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fresh.toUri(), conf).rename(fresh, hadoop.Path(path), options)


def sweep(spark: SparkSession) -> None:
    """Give memory and disk back between the steps of a long job. The driver collects its garbage, whereupon Spark removes
    the shuffle files and broadcasts of plans that nothing refers to any more; the executors collect theirs, whereupon
    their heaps shrink to what is in use. One short task for each core; nothing depends on where they run."""
    gc.collect()
    spark._jvm.System.gc()
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


class _Held:
    """Settings that hold while any write of this process needs them; the values before come back after the last."""

    def __init__(self) -> None:
        self.lock, self.users, self.before = threading.Lock(), 0, {}

    @contextlib.contextmanager
    def held(self, spark: SparkSession, settings: dict[str, object]) -> Iterator[None]:
        with self.lock:
            self.users += 1
            if self.users == 1:
                self.before = {k: spark.conf.get(k) for k in settings}
            for k, v in settings.items():
                spark.conf.set(k, v)
        try:
            yield
        finally:
            with self.lock:
                self.users -= 1
                if not self.users:
                    for k, v in self.before.items():
                        spark.conf.set(k, v)


_HELD, _SCOPES = _Held(), threading.local()


@contextlib.contextmanager
def temporary() -> Iterator[None]:
    """Workspaces that this thread makes inside go at the end; what is still needed has to be written by then."""
    outer, mine = getattr(_SCOPES, "open", None), []
    _SCOPES.open = mine
    try:
        yield
    finally:
        _SCOPES.open = outer
        for work in mine:
            work.remove()


def written(df: DataFrame, path: str, arrow_rows: int = 1000, compression: str | None = None) -> DataFrame:
    """df as the table at path, with the batches of `Workspace.table`."""
    with _HELD.held(df.sparkSession, {_ARROW_ROWS: arrow_rows, _ARROW_BYTES: ARROW_BYTES}):
        df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Workspace:
    """A folder of its own below the shared one; it goes when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.root = spark, name, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        _remove_at_exit(spark, self.root)
        if (scope := getattr(_SCOPES, "open", None)) is not None:
            scope.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, arrow_rows: int = 1000) -> DataFrame:
        """Write df once and read it back: cuts the lineage, and survives the loss of any executor. While it is
        written, batches for Python hold arrow_rows rows or ARROW_BYTES at most, which bounds a worker's memory when
        texts are long."""
        return written(df, self.path(f"{name}-{uuid.uuid4().hex[:6]}"), arrow_rows)

    def finish(self, df: DataFrame) -> DataFrame:
        """df as a table of its own; all else in this workspace goes."""
        out = Workspace(self.spark, f"{self.name}-result").table(df, "result")
        self.remove()
        sweep(self.spark)
        return out

    def remove(self) -> None:
        remove(self.spark, self.root)
