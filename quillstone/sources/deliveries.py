"""Deliveries: payload files with JSON sidecars in one folder, as a batch or a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.rules import has_key

# Keys that no sidecar may have at any depth.
FORBIDDEN = ("authorization", "cookie", "set-cookie", "proxy-authorization")
ENVELOPE = "status int, transport string, retrieved_at timestamp, archive_permitted boolean, uri string"
FILES = "path string, modificationTime timestamp, length long, content binary"


def status_state(code: Column) -> Column:
    """What a status code means for a delivery; without one it goes on."""
    return F.when(code.isin(401, 403), "blocked_entitlement").when(code == 429, "blocked_rate_limit").when(code >= 500, "failed").otherwise("continue")


def _sidecars(files: DataFrame) -> DataFrame:
    """``stem, envelope, state`` of each sidecar. What is wrong with one is its state; no file stops the others."""
    text = F.decode("content", "UTF-8")
    envelope = F.from_json("json", ENVELOPE, {"mode": "PERMISSIVE"})
    rows = files.select(F.regexp_replace("path", r"\.json$", "").alias("stem"), text.alias("json"))
    rows = rows.select("stem", envelope.alias("envelope"), has_key(F.col("json"), list(FORBIDDEN)).alias("secret"))
    state = F.when(F.col("secret").isNull() | F.col("envelope").isNull(), "malformed_sidecar").when(F.col("secret"), "forbidden_key")
    state = F.coalesce(state, F.when(~F.coalesce(F.col("envelope.archive_permitted"), F.lit(False)), "archive_not_permitted"), status_state(F.col("envelope.status")))
    return rows.select("stem", "envelope", state.alias("state"))


def _read(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """``name, state, status, transport, retrieved_at, digest, length`` of each delivery in a folder.

    ``x.json`` describes the payload ``x.xml``, ``x.html`` or ``x.txt``. Files are read by Spark, so the folder may be in any store. ``state`` is ``continue`` for what may be taken in, else why not: the sidecar is
    malformed, has a forbidden key, doesn't permit archiving or tells of a failure, or one of the two files is missing. Columns that can't be told are null.
    """
    sides = _sidecars(_read(spark, folder, "*.json"))
    payloads = _read(spark, folder, "*.{xml,html,txt}").select(F.regexp_replace("path", r"\.[^./]+$", "").alias("p_stem"), F.sha2("content", 256).alias("digest"), "length")
    met = sides.join(payloads, F.col("stem") == F.col("p_stem"), "full")
    state = F.when(F.col("stem").isNull(), "missing_sidecar").when((F.col("state") == "continue") & F.col("p_stem").isNull(), "missing_payload").otherwise(F.col("state"))
    name = F.substring_index(F.coalesce("stem", "p_stem"), "/", -1)
    return met.select(name.alias("name"), state.alias("state"), F.col("envelope.status").alias("status"), F.col("envelope.transport").alias("transport"), F.col("envelope.retrieved_at").alias("retrieved_at"), "digest", "length")


def sidecar_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecars of a folder as a stream: ``name, state, status`` of each as it arrives."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.json").load(folder)
    return _sidecars(files).select(F.substring_index("stem", "/", -1).alias("name"), "state", F.col("envelope.status").alias("status"))
