"""A persistent inverted index: postings by term, replaced one representation at a time.

An index is a folder of two tables.

``postings``: a row for each term of each unit, with the term's count and the unit's size, in partitions of ``representation``,
``index_id`` and ``band``. A band is a share of all terms by their hash, and files are sorted by term: a search reads the
bands of its terms alone, and of these the row groups that may hold them.

``manifests``: one row for each representation, with the index that is valid for it and what that index holds. ``index_id`` is
a digest of the representation's units and texts.

Publishing writes the postings of those representations that changed into partitions of their new ``index_id``, counts
what was written against what was given, and only then puts the new manifests in place of the old. Searches see the old
index up to that point and the new one from then on. Superseded partitions are deleted last. What is published
again unchanged is reused, and no other representation's files are touched.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.text import record_id, terms
from quillstone.operators.digests import set_digest
from quillstone.operators.graph import durable
from quillstone.sources.shared import delete, exists, partition

#: Bands of an index, if it isn't said otherwise.
BANDS = 16
K1, B = 1.2, 0.75

POSTINGS = "term string, unit long, tf int, size int, representation string, index_id string, band int"
MANIFESTS = "index_id string, n_units long, n_postings long, total_size long, bands int, representation string"


class IncompleteIndex(ValueError):
    """What was written is not what was given."""


def band_of(term: Column, bands: int = BANDS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(bands)).cast("int")


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """What is published: one row for each representation."""
    if not exists(spark, f"{folder}/manifests"):
        return spark.createDataFrame([], MANIFESTS)
    return spark.read.schema(MANIFESTS).parquet(f"{folder}/manifests")


def postings(spark: SparkSession, folder: str) -> DataFrame:
    """The postings of all that is published; filters on ``band`` and ``term`` reach the files."""
    if not exists(spark, f"{folder}/postings"):
        return spark.createDataFrame([], POSTINGS)
    valid = manifests(spark, folder).select(F.col("representation").alias("m_representation"), F.col("index_id").alias("m_index"))
    rows = spark.read.schema(POSTINGS).parquet(f"{folder}/postings")
    return rows.join(valid, F.col("representation").eqNullSafe(F.col("m_representation")) & (F.col("index_id") == F.col("m_index")), "left_semi")


def _posted(units: DataFrame, bands: int) -> DataFrame:
    """The postings of ``units(representation, index_id, unit, text)``. A text's words are sorted and counted within its row, so nothing is shuffled for that."""
    each = units.select("representation", "index_id", "unit", F.sort_array(terms(F.col("text"))).alias("w"))
    last = F.size("w") - 1
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    ends = F.filter(places, lambda i: (i == last) | (F.get("w", i) != F.get("w", i + 1)))
    runs = each.select("representation", "index_id", "unit", F.size("w").alias("size"), "w", ends.alias("ends"))
    counts = F.transform("ends", lambda e, k: F.struct(F.get("w", e).alias("term"), (e - F.coalesce(F.get("ends", k - 1), F.lit(-1))).alias("tf")))
    counted = runs.select("representation", "index_id", "unit", "size", F.explode(counts).alias("p"))
    return counted.select("p.term", "unit", "p.tf", "size", "representation", "index_id", band_of(F.col("p.term"), bands).alias("band"))


def _mark(times: str) -> Column:
    """A sum over rows by which units and their sizes are recognised, whether it is taken over postings or over units."""
    return F.sum(F.pmod(F.xxhash64("unit", "size"), F.lit(2**20)) * F.col(times)).alias("mark")


def publish(units: DataFrame, folder: str, bands: int = BANDS) -> DataFrame:
    """Bring the index in ``folder`` to ``units(representation, unit, text)``; ``representation, index_id, outcome`` of each representation given.

    ``outcome`` is ``created``, ``replaced`` or ``reused``. A null text counts as empty and its unit has no postings but is counted. Units
    are expected once each: repeated ones would be written as often. ``bands`` is for what is written now; an index may hold representations of several numbers of bands. Representations that are not given stay as they are. If what
    was written isn't complete, IncompleteIndex is raised, and the index is what it was before.
    """
    spark = units.sparkSession
    units = units.select(F.col("representation").cast("string").alias("representation"), F.col("unit").cast("long").alias("unit"), F.coalesce("text", F.lit("")).alias("text"))
    digests = set_digest(units.select("representation", F.sha2(F.concat_ws(":", F.col("unit").cast("string"), F.sha2("text", 256)), 256).alias("d")), ["representation"], "d")
    asked = digests.select("representation", record_id("idx", F.coalesce("representation", F.lit("")), "digest").alias("index_id"))
    old = manifests(spark, folder).select(F.col("representation").alias("o_representation"), F.col("index_id").alias("old_id"))
    outcome = F.when(F.col("old_id").isNull(), "created").when(F.col("old_id") == F.col("index_id"), "reused").otherwise("replaced")
    plan = durable(asked.join(old, F.col("representation").eqNullSafe(F.col("o_representation")), "left").select("representation", "index_id", "old_id", outcome.alias("outcome")))
    changed = plan.where("outcome <> 'reused'").select(F.col("representation").alias("c_representation"), "index_id")
    told = plan.select("representation", "index_id", "outcome")
    if changed.isEmpty():
        return told
    given = units.join(changed, F.col("representation").eqNullSafe(F.col("c_representation"))).select("representation", "index_id", "unit", "text")
    by = ["representation", "index_id", "band"]
    # Small partitions are written together and large ones split; files are sorted, so that a term is in few row groups.
    spread = _posted(given, bands).hint("rebalance", *by).sortWithinPartitions(*by, "term", "unit")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{folder}/postings")
    held = spark.read.schema(POSTINGS).parquet(f"{folder}/postings").join(changed.select("c_representation", F.col("index_id").alias("c_index")), F.col("representation").eqNullSafe(F.col("c_representation")) & (F.col("index_id") == F.col("c_index")), "left_semi")
    # Each unit's counts must add up to its size. Both sides are summed up in their tasks: the words of the texts, and the postings that were read back.
    written = held.groupBy(F.col("index_id").alias("w_index")).agg(F.count(F.lit(1)).alias("n_postings"), F.sum("tf").alias("n_words"), _mark("tf").alias("w_mark"))
    sized = given.select("representation", "index_id", "unit", F.size(terms(F.col("text"))).alias("size"))
    sizes = sized.groupBy("representation", "index_id").agg(F.count(F.lit(1)).alias("n_units"), F.sum("size").alias("total_size"), _mark("size"))
    zero = F.lit(0).cast("long")
    or_none = lambda c: F.coalesce(c, zero).alias(c)
    new = durable(sizes.join(written, F.col("index_id") == F.col("w_index"), "left").select("index_id", "n_units", or_none("n_postings"), "total_size", F.lit(bands).alias("bands"), or_none("n_words"), or_none("w_mark"), "mark", "representation"))
    if not new.where("total_size <> n_words or mark <> w_mark").isEmpty():
        raise IncompleteIndex("postings do not add up to their units")
    new.drop("n_words", "mark", "w_mark").repartition("representation").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("representation").parquet(f"{folder}/manifests")
    for r in plan.where("outcome = 'replaced'").toLocalIterator():  # folders to delete, not rows of them
        delete(spark, f"{folder}/postings/{partition('representation', r['representation'])}/{partition('index_id', r['old_id'])}")
    return told


def lookup(spark: SparkSession, folder: str, words: list[str]) -> DataFrame:
    """The postings of some terms: of all files, the bands and row groups that may hold them are read."""
    numbers = [r["bands"] for r in manifests(spark, folder).select("bands").distinct().collect()]  # few: they are chosen by publishers
    places = spark.range(1).select(F.array(*[band_of(F.lit(w), n) for w in words for n in numbers or [1]]).alias("b")).first()["b"]
    return postings(spark, folder).where(F.col("band").isin(*sorted(set(places))) & F.col("term").isin(*words))


def bm25(spark: SparkSession, folder: str, words: list[str]) -> DataFrame:
    """``unit, score`` of published units with any of the words; less is better, repeated words count repeatedly.

    Reads the postings of these words alone. What is known of the whole corpus comes from the manifests; document frequencies are
    counted from the postings at hand, one row a word.
    """
    times = Counter(words)
    hits = lookup(spark, folder, list(times)).select("term", "unit", "tf", "size")
    whole = manifests(spark, folder).agg(F.sum("n_units").alias("n"), (F.sum("total_size") / F.sum("n_units")).alias("mean"))
    per_term = hits.groupBy(F.col("term").alias("d_term")).agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(whole))  # one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    often = F.element_at(F.create_map(*[F.lit(x) for pair in times.items() for x in pair]), F.col("d_term"))
    weights = per_term.select("d_term", "mean", (F.when(idf <= 0, 1e-6).otherwise(idf) * often).alias("weight"))
    scored = hits.join(F.broadcast(weights), F.col("term") == F.col("d_term"))  # at most a row for each word asked
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    return scored.groupBy("unit").agg(F.round(-F.sum(part), 6).alias("score"))
