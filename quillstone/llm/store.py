"""Cut lineage by writing a table into the folder every executor shares."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folders that tables are written to, as (application, folder), the innermost last. Each thread has its own.
_open: ContextVar[tuple[tuple[str, str], ...]] = ContextVar("open", default=())
_leaving: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, local sessions get a temporary folder; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "quillstone-checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _clear_at_exit(spark: SparkSession, folder: str) -> None:
    """Remove an application's folder when the driver ends, if its session is still there to do it."""
    if folder in _leaving:
        return
    _leaving.add(folder)

    def clear() -> None:
        if spark.sparkContext._jsc is not None:
            _delete(spark, folder)

    atexit.register(clear)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stashed inside are deleted at its end. What is still needed must have been written elsewhere by then."""
    application = spark.sparkContext.applicationId
    folder = f"{shared_folder(spark)}/quillstone/{application}/{uuid.uuid4().hex}"
    before = _open.set((*_open.get(), (application, folder)))
    try:
        yield
    finally:
        _open.reset(before)
        _delete(spark, folder)


def stash(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The copy outlives any executor, so later stages restart from it and not
    from the inputs. It is deleted with the ``scratch`` around it, or (outside of one, or with
    ``keep``) when the driver ends. An empty ``df`` keeps its schema.
    """
    spark = df.sparkSession
    application = spark.sparkContext.applicationId
    own = f"{shared_folder(spark)}/quillstone/{application}"
    _clear_at_exit(spark, own)
    inner = [folder for app, folder in _open.get() if app == application]
    path = f"{own if keep or not inner else inner[-1]}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a table that may be broadcast.
BROADCAST_BYTES = 32 << 20


def fits(df: DataFrame, weight: Column) -> bool:
    """Whether rows of these ``weight`` in bytes add up to no more than BROADCAST_BYTES. Reads ``df`` once."""
    return (df.agg(F.sum(weight)).first()[0] or 0) <= BROADCAST_BYTES


def within_bounds(df: DataFrame, weight: Column) -> DataFrame:
    """``df``, to be broadcast if it ``fits``; else Spark shuffles and splits skewed keys."""
    return F.broadcast(df) if fits(df, weight) else df
