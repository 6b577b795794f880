"""Benchmark decontamination by winnowing.

Of every 10 consecutive words one 5-gram is kept: the one of least hash among
the six in that span. As the choice depends on the span's words alone, a
span that a benchmark item and a document share leaves the same fingerprint in both,
so joining fingerprints finds every shared span. Each joined pair is then
extended over the words around it, compared as text, up to the span's length.
Items shorter than a span are spans of their own length and are winnowed with
a guarantee for that length.

A filter over the benchmark's fingerprints, of 16 bits for each up to 64 MB in all, keeps a document's
other fingerprints in their task; it can only let too many through. The join
itself is left to Spark, which broadcasts the benchmark side if it is small and else
shuffles both, splitting skewed keys.

Hits depend on a text alone, so they are gathered by the SHA-256 of the text and joined back to every row that
has it, whatever its doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.columns import unwrapped, wrapped
from quillstone.llm.inplace import without
from quillstone.llm.spans import before, given
from quillstone.llm.store import stash
from quillstone.llm.wordkernel import ALPHANUMERIC, SMALL_SLICE_BYTES, U64, slices, winnow, words_of

SPAN = 10
#: Bits of the filter over the benchmark's fingerprints: so many for each, at least and at most so many in all.
BITS_EACH = 16
LEAST_BITS, MOST_BITS = 1 << 18, 1 << 29
BUCKET_BITS = 8 * 4096

CANDIDATE = T.StructType(
    [
        T.StructField("span", T.IntegerType()),
        T.StructField("fingerprint", T.LongType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("left", T.ArrayType(T.StringType())),
        T.StructField("right", T.ArrayType(T.StringType())),
    ]
)


def _gram(span: int) -> int:
    """Words of a fingerprint for spans of this length."""
    return (span + 1) // 2


def _fingerprints(words, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the chosen grams and their hashes."""
    k = _gram(span)
    grams, _ = words.grams(k)
    _, room = words.grams(span)
    chosen = np.unique(winnow(grams, room, span - k + 1))
    return chosen, grams[chosen]


def _candidates(words, spans: list[int], bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chosen grams that the filter lets through, by document: their document, span, hash, and the word ranges before and from them on."""
    parts = []
    for span in spans:
        at, prints = _fingerprints(words, span)
        if bits is not None and len(at):
            place = prints % U64(8 * len(bits))
            hit = (bits[(place >> U64(3)).astype(np.int64)] >> (place & U64(7)).astype(np.uint8)) & 1 == 1
            at, prints = at[hit], prints[hit]
        parts.append((np.searchsorted(words.bounds, at, side="right") - 1, np.full(len(at), span), at, prints))
    doc, span, at, prints = (np.concatenate(x) if parts else np.zeros(0, dtype=np.int64) for x in zip(*parts)) if parts else [np.zeros(0, dtype=np.int64)] * 4
    order = np.argsort(doc, kind="stable")
    return doc[order], span[order], at[order], prints[order].astype(U64), order


def _texts(words, first: np.ndarray, last: np.ndarray, backward: bool = False) -> pa.ListArray:
    """For each range of words, their texts in a list, the last one first if ``backward``."""
    counts = last - first
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    within = np.arange(offsets[-1]) - np.repeat(offsets[:-1], counts)
    at = np.repeat(last - 1, counts) - within if backward else np.repeat(first, counts) + within
    raw = words.data
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array([raw[a:b].tobytes() for a, b in zip(words.start[at], words.end[at])], pa.binary()).cast(pa.string()))


def _columns(words, doc: np.ndarray, span: np.ndarray, at: np.ndarray, prints: np.ndarray) -> list[pa.Array]:
    """Arrow columns of CANDIDATE."""
    lo, hi = words.bounds[doc], words.bounds[doc + 1]
    left = _texts(words, np.maximum(lo, at - (span - (span + 1) // 2)), at, backward=True)
    right = _texts(words, at, np.minimum(hi, at + span))
    return [pa.array(span, pa.int32()), pa.array(prints.astype(np.int64)), pa.array(at - lo, pa.int32()), left, right]


def _documents(spans: list[int], shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in slices(batches, "text", SMALL_SLICE_BYTES):
            words = words_of(batch.column("text"), ALPHANUMERIC, lower=True)
            doc, span, at, prints, _ = _candidates(words, spans, bits)
            each = pa.StructArray.from_arrays(_columns(words, doc, span, at, prints), names=CANDIDATE.names)
            found = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)), each)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(words.counts, pa.int64()), found], names=["doc_id", "row", "n_words", "found"])

    return run


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["item_id", *CANDIDATE.names]
    for batch in slices(batches, "text", SMALL_SLICE_BYTES):
        words = words_of(batch.column("text"), ALPHANUMERIC, lower=True)
        own = np.minimum(words.counts, SPAN)
        doc, span, at, prints, _ = _candidates(words, [n for n in np.unique(own).tolist() if n], None)
        mine = own[doc] == span
        doc, span, at, prints = doc[mine], span[mine], at[mine], prints[mine]
        yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(doc)), *_columns(words, doc, span, at, prints)], names=names)


def _filter_bits(prints: DataFrame) -> np.ndarray:
    """The filter as bytes, from bitmaps of 4 KB made by the executors; MOST_BITS bound it."""
    wanted = BITS_EACH * prints.count()
    size = LEAST_BITS
    while size < min(wanted, MOST_BITS):
        size *= 2
    place = F.pmod(F.col("fingerprint"), F.lit(size))
    maps = prints.select(place.alias("p")).groupBy((F.col("p") / BUCKET_BITS).cast("int").alias("bucket")).agg(
        F.bitmap_construct_agg((F.col("p") % BUCKET_BITS).cast("long")).alias("bits")
    )
    out = np.zeros(size // 8, dtype=np.uint8)
    for row in maps.toLocalIterator():
        out[row["bucket"] * 4096 : (row["bucket"] + 1) * 4096] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return out


def _agreement(a: Column, b: Column) -> Column:
    """How many leading elements two arrays of words have in common."""
    first_other = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(first_other == 0, F.size(a)).otherwise(first_other - 1).cast("int")


def _row() -> Column:
    """The name of a text: hits depend on it alone."""
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def _merged(hits: Column) -> Column:
    """Ranges in order of their starts, with those that overlap or touch made one."""

    def cut(hits: Column) -> Column:
        last = before(F.transform(hits, lambda h: h["end"]), lambda a, b: F.greatest(a, b), -1)
        return F.filter(F.zip_with(hits, last, lambda h, at: F.struct(h["start"].alias("start"), at.alias("at"))), lambda x: x["start"] > x["at"])

    def closed(heads: Column) -> Column:
        ends = F.concat(F.transform(F.slice(heads, 2, F.greatest(F.size(heads) - 1, F.lit(0))), lambda x: x["at"]), F.array(F.array_max(F.transform(hits, lambda h: h["end"]))))
        return F.zip_with(heads, ends, lambda x, end: F.struct(x["start"].alias("start"), end.alias("end")))

    return given(given(hits, cut), closed)


def _hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id, row, n_words`` of each row of ``docs``, and ``h_row, hits, items`` of each text with a hit."""
    kind = benchmark.schema["item_id"].dataType
    prints = stash(benchmark.select("item_id", "text").mapInArrow(_items, T.StructType([T.StructField("item_id", kind)] + CANDIDATE.fields)), "items")
    distinct = prints.groupBy("span", "fingerprint", "left", "right").agg(F.collect_set("item_id").alias("items"))
    bench = distinct.select(
        F.col("span").alias("b_span"), F.col("fingerprint").alias("b_fingerprint"), F.col("left").alias("b_left"), F.col("right").alias("b_right"), F.col("items").alias("b_items")
    )
    spans = sorted(r["span"] for r in prints.select("span").distinct().collect())  # SPAN values at most
    schema = T.StructType([docs.schema["doc_id"], T.StructField("row", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("found", T.ArrayType(CANDIDATE))])
    shared = docs.sparkSession.sparkContext.broadcast(_filter_bits(prints.select("fingerprint").distinct()).tobytes())  # MOST_BITS / 8 at most
    rows = stash(docs.select("doc_id", _row().alias("row"), "text").mapInArrow(_documents(spans, shared), schema), "candidates")
    each = rows.where(F.size("found") > 0).dropDuplicates(["row"]).select("row", F.explode("found").alias("c")).select("row", "c.*")
    joined = each.join(bench, (F.col("fingerprint") == F.col("b_fingerprint")) & (F.col("span") == F.col("b_span")))
    k = ((F.col("span") + 1) / 2).cast("int")
    ahead, after = _agreement(F.col("left"), F.col("b_left")), _agreement(F.col("right"), F.col("b_right"))
    marked = joined.where((after >= k) & (ahead + after >= F.col("span"))).select("row", F.struct((F.col("pos") - ahead).alias("start"), (F.col("pos") + after).alias("end")).alias("hit"), F.col("b_items").alias("items"))
    per = marked.groupBy("row").agg(F.array_sort(F.collect_set("hit")).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    found = stash(per.select(F.col("row").alias("h_row"), _merged(F.col("hit")).alias("hits"), "items"), "hits")
    return rows.select("doc_id", "row", "n_words"), found


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Hits of ``benchmark(item_id, text)`` in ``docs(doc_id, text)``, one row per row of ``docs``.

    ``doc_id, n_words, hits array<struct<start, end>>, items array``: word ranges,
    disjoint and in order, that the hits cover, and the ids of the items with
    a hit. Null and empty texts have no words and no hits; an item without words
    hits nothing. Each row is judged by its own text, so repeated rows, rows of one doc_id with different texts and
    null doc_ids don't mix; item ids that are null are not reported though their
    words count. Empty tables and other columns do no harm.
    """
    rows, found = _hits(docs, benchmark)
    none = F.array().cast("array<struct<start:int,end:int>>")
    no_items = F.array().cast(found.schema["items"].dataType)
    return rows.join(found, F.col("row") == F.col("h_row"), "left").select("doc_id", "n_words", F.coalesce("hits", none).alias("hits"), F.coalesce("items", no_items).alias("items"))


def hit_words(hits: Column) -> Column:
    """The number of words that disjoint ranges cover."""
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose own text has no hit, with their columns unchanged.

    Rows with a null text or doc_id are judged like any other; repeated rows go or stay together. Columns may have any names.
    """
    _, found = _hits(docs.select("doc_id", "text"), benchmark)
    return unwrapped(without(wrapped(docs), _row(), found.select("h_row"), F.lit(100)), docs.columns)
