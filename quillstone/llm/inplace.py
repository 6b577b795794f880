"""Joins of a table of long rows with a table of keys, for which rows without a match stay in their tasks.

Keys that ``fits`` are broadcast. More keys are broadcast as a filter of bits, which may let
rows without a match through but keeps none with a match back; what it lets through is shuffled to the exact join.
A filter that is full lets more through and grows no further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm import store

#: Bits of the filter for each key, and of all at least; at most they take BROADCAST_BYTES.
BITS_EACH, LEAST_BITS = 16, 1 << 18
#: Bits of one row of the filter, as Spark's bitmaps have them.
ROW_BITS = 8 * 4096


def parted(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``key`` may be in the one column of ``keys``, and those of which it is not, or null. No row is shuffled; each part reads ``rows``, whose columns have plain names."""
    size = LEAST_BITS
    wanted = min(BITS_EACH * keys.count(), 8 * store.BROADCAST_BYTES)
    while size < wanted:
        size *= 2
    place = lambda c: F.when(c.isNotNull(), F.pmod(F.xxhash64(c), F.lit(size)))
    part = lambda p: F.floor(p / ROW_BITS).cast("int")
    places = keys.select(place(F.col(keys.columns[0])).alias("p")).where("p is not null")
    bitmaps = places.groupBy(part(F.col("p")).alias("__part")).agg(F.bitmap_construct_agg(F.col("p") % ROW_BITS).alias("__bits"))
    at = F.col("__place") % ROW_BITS
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("__place", place(key)).join(F.broadcast(bitmaps), part(F.col("__place")) == F.col("__part"), "left")
    may = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return marked.where(may).select(*rows.columns), marked.where(~may).select(*rows.columns)


def among(rows: DataFrame, key: Column, keys: DataFrame, weight: Column) -> DataFrame:
    """The rows whose ``key`` is in the one column of ``keys``, whose rows take ``weight`` bytes; no key is null there. Reads ``keys`` again and again."""
    match = key == F.col(keys.columns[0])
    if store.fits(keys, weight):
        return rows.join(F.broadcast(keys), match, "left_semi")
    return parted(rows, key, keys)[0].join(keys, match, "left_semi")


def without(rows: DataFrame, key: Column, keys: DataFrame, weight: Column) -> DataFrame:
    """The rows of which ``among`` gives none, those with a null ``key`` too."""
    match = key == F.col(keys.columns[0])
    if store.fits(keys, weight):
        return rows.join(F.broadcast(keys), match, "left_anti")
    may, others = parted(rows, key, keys)
    return others.union(may.join(keys, match, "left_anti"))
