"""Intermediate tables on shared storage: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of the innermost scratch() of each thread or task; those outside of any go when the interpreter ends.
_loose: list[DataFrame] = []
_scope: ContextVar[list[DataFrame] | None] = ContextVar("runlens_scratch", default=None)

#: Bytes of files, and rows, up to which a written table is sent to every executor.
SMALL = 32 << 20
SMALL_ROWS = 2_000_000
#: Bytes of large rows that are written and read together.
LARGE = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local session without one gets a folder of its own, a cluster an error: its executors could not read it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="runlens-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def written(df: DataFrame, name: str = "t", large_rows: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder; of large rows a few are written and read at a time."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/runlens-{name}-{uuid.uuid4().hex}"
    # Parquet looks at sizes, a group's as well as a page's, only every 100 rows, and a reader decodes a group of rows at once
    some = {"parquet.block.size": str(LARGE), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"} if large_rows else {}
    df.write.options(**some).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.runlens_path = path
    own = _scope.get()
    (_loose if own is None else own).append(out)
    return out


def small(df: DataFrame) -> DataFrame:
    """A table that written() made, marked for broadcast if it is SMALL; else Spark shuffles both sides."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.runlens_path)
    size = path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return F.broadcast(df) if size <= SMALL and df.count() <= SMALL_ROWS else df


def drop(df: DataFrame) -> None:
    """Delete a table that written() made, once nothing reads it."""
    path = getattr(df, "runlens_path", None)
    if path:
        for tables in (_loose, _scope.get() or []):
            tables[:] = [t for t in tables if t.runlens_path != path]
        _delete(df)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes the tables written inside by the same thread when it ends; those put on the list that it gives pass to the scope around it."""
    own, kept = [], []
    before = _scope.get()
    token = _scope.set(own)
    try:
        yield kept
    finally:
        _scope.reset(token)
        stay = {t.runlens_path for t in kept}
        for t in own:
            if t.runlens_path in stay:
                (_loose if before is None else before).append(t)
            else:
                _delete(t)


def _delete(df: DataFrame) -> None:
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.runlens_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _clean() -> None:
    for df in _loose:
        try:
            if df.sparkSession.sparkContext._jsc is not None:
                _delete(df)
        except Exception:  # noqa: BLE001  the session may be gone by now, the others' may not
            continue
