"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, local sessions get a temporary folder; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partition(name: str, value: str | None) -> str:
    """The folder name of one value of a partition column, as Spark writes it."""
    return f"{name}={_HIVE if value in (None, '') else _escaped(value)}"


_HIVE = "__HIVE_DEFAULT_PARTITION__"


def _escaped(value: str) -> str:
    odd = set('"#%\'*/:=?\\{[]^\x7f') | set(map(chr, range(1, 32)))
    return "".join(f"%{ord(c):02X}" if c in odd else c for c in value)


def state_of(files: DataFrame) -> str:
    """A name for the files of a DataFrame as they are now: their paths, sizes and times. No data is read."""
    seen = files.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    digest = F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(20,0)"))
    row = seen.agg(F.count(F.lit(1)).alias("n"), digest.alias("d")).first()
    return f"{row['n']}_{row['d']}".replace("-", "m")
