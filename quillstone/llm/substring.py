"""Substring deduplication by seeds and extension, with joins in place of comparisons.

Seeds. Of every 13 consecutive words one 5-gram is kept by winnowing, so any
span of 13 words that two documents share has the same seed in both. Seeds
are joined over all documents, and those of a single document go no further.

Extension. A seed that several documents hold is extended to its left and right, a word at a time: the
13-word windows around it that chose it are joined in turn, each with the least
doc_id that holds it. So no match is grown from one anchor in one pair of documents: a passage may be in millions of them, and
the earliest of these need not share most of it. Windows go by two independent 64-bit hashes, so that different words
are not taken for equal. Windows that are repeats and overlap or touch make one range, whose words go; where its parts repeat
different documents, it is the union of their maximal repeats over the length threshold.

Rows of equal doc_id and text are judged once. Documents are dealt once into chunks of about 4 MB, and what is shuffled is summed up by
chunk: a passage that every document holds is one entry for each chunk, not for
each document, and no document's text is shuffled twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.store import stash, within_bounds
from quillstone.llm.wordkernel import SPACED, U64, Words, covered, per_doc, winnow, words_of

LENGTH = 13
SEED = 5
CHUNK_BYTES = 4 << 20
LAST = np.iinfo(np.int64).max

ENTRIES = "bucket int, chunk int, keys array<long>, more array<long>, low array<long>, span array<long>"
ANSWERS = "chunk int, keys array<long>, more array<long>, first array<long>"
#: What makes the second hash of a window independent of the first.
SALT = 0x8C5FB2A9D3E41F67
REPEATS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
KEPT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("repeats", REPEATS), T.StructField("copies", T.LongType())])
LONGS = pa.list_(pa.int64())


def _ids(table: pa.Table) -> np.ndarray:
    """doc_id as numbers; a null id is later than any other."""
    return table.column("doc_id").combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False)


def _seeds(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window: where it begins, where its seed is, and the seeds' hashes by place."""
    grams, _ = words.grams(SEED)
    _, room = words.grams(LENGTH)
    return np.flatnonzero(room), winnow(grams, room, LENGTH - SEED + 1), grams


def _lists(offsets: np.ndarray, columns: list[np.ndarray]) -> list[pa.ListArray]:
    return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int64))) for x in columns]


def _cuts(sorted_ids: np.ndarray) -> np.ndarray:
    """Offsets of the runs of equal ids."""
    return np.concatenate([[0], np.flatnonzero(np.diff(sorted_ids)) + 1, [len(sorted_ids)]]).astype(np.int32) if len(sorted_ids) else np.zeros(1, dtype=np.int32)


def _entries(keys: np.ndarray, more: np.ndarray, docs: np.ndarray, chunk: int, buckets: int) -> pa.Table:
    """The least document of each key and how far the greatest is from it, dealt by key into buckets. ``more``: second hashes, or all zero for seeds.

    Most keys of a chunk are in one document; their spans are zeros, which are shuffled at next to no size.
    """
    order = np.lexsort((docs, more, keys))
    keys, more, docs = keys[order], more[order], docs[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (more[1:] != more[:-1])])) if len(keys) else np.zeros(0, dtype=np.int64)
    last = np.append(first[1:], len(keys)) - 1 if len(keys) else first
    keys, more, low, span = keys[first], more[first], docs[first], docs[last] - docs[first]
    bucket = ((keys >> U64(32)) % U64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    offsets = _cuts(bucket[order])
    ids = bucket[order][offsets[:-1]]
    return pa.Table.from_arrays([pa.array(ids, pa.int32()), pa.array(np.full(len(ids), chunk), pa.int32()), *_lists(offsets, [x[order] for x in (keys, more, low, span)])], names=["bucket", "chunk", "keys", "more", "low", "span"])


def _flat(table: pa.Table, name: str) -> np.ndarray:
    col = table.column(name).combine_chunks()
    return (col.flatten() if len(col) else pa.array([], pa.int64())).to_numpy(zero_copy_only=False)


def _first_holders(only_later: bool):
    """Answers each chunk's entries: the keys that several documents hold, with the least of these.

    ``only_later``: only where the chunk has a later document than that.
    """

    def run(table: pa.Table) -> pa.Table:
        sizes = np.asarray(table.column("keys").combine_chunks().value_lengths())
        chunk = np.repeat(table.column("chunk").to_numpy(), sizes)
        keys, more, low, span = (_flat(table, c) for c in ("keys", "more", "low", "span"))
        high = low + span
        order = np.lexsort((more, keys))
        new = (keys[order][1:] != keys[order][:-1]) | (more[order][1:] != more[order][:-1])
        start = np.flatnonzero(np.concatenate([[True], new]))
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
        least = np.minimum.reduceat(low[order], start)[group]
        most = high[order] if only_later else np.maximum.reduceat(high[order], start)[group]
        told = least < most
        order, least = order[told], least[told]
        by = np.argsort(chunk[order], kind="stable")
        order, least = order[by], least[by]
        to = chunk[order]
        offsets = _cuts(to)
        return pa.Table.from_arrays([pa.array(to[offsets[:-1]], pa.int32()), *_lists(offsets, [keys[order], more[order], least])], names=["chunk", "keys", "more", "first"])

    return run


def _chunk_of(table: pa.Table) -> int:
    return table.column("chunk")[0].as_py()


def _seed_entries(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        words = words_of(table.column("text"), SPACED)
        _, seeds, grams = _seeds(words)
        at = np.unique(seeds)
        return _entries(grams[at], np.zeros(len(at), dtype=U64), _ids(table)[words.doc[at]], _chunk_of(table), buckets)

    return run


def _window_entries(buckets: int):
    def run(table: pa.Table, shared: pa.Table) -> pa.Table:
        known = np.unique(_flat(shared, "keys").astype(U64)) if shared.num_rows else np.zeros(0, dtype=U64)
        if not table.num_rows or not len(known):
            return _entries(np.zeros(0, dtype=U64), np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64), 0, buckets)
        words = words_of(table.column("text"), SPACED)
        begins, seeds, grams = _seeds(words)
        own = grams[seeds]
        at = np.searchsorted(known, own)
        at[at == len(known)] = 0
        begins = begins[known[at] == own]
        return _entries(words.grams(LENGTH)[0][begins], words.grams(LENGTH, SALT)[0][begins], _ids(table)[words.doc[begins]], _chunk_of(table), buckets)

    return run


def _extended(words: Words, ids: np.ndarray, answers: pa.Table) -> np.ndarray:
    """Which windows begin in an earlier document as well, by where they begin in ``words``."""
    hit = np.zeros(len(words.hash), dtype=bool)
    keys, more, first = (_flat(answers, c) for c in ("keys", "more", "first"))
    if not len(keys):
        return hit
    keys, more = keys.astype(U64), more.astype(U64)
    order = np.lexsort((more, keys))
    keys, more, first = keys[order], more[order], first[order]
    grams, room = words.grams(LENGTH)
    begins = np.flatnonzero(room)
    own, other = grams[begins], words.grams(LENGTH, SALT)[0][begins]
    at = np.searchsorted(keys, own)
    at[at == len(keys)] = 0
    while True:  # on to the next of keys that differ in their second hash alone
        on = np.flatnonzero((keys[at] == own) & (more[at] != other) & (at + 1 < len(keys)))
        on = on[keys[at[on] + 1] == own[on]]
        if not len(on):
            break
        at[on] += 1
    hit[begins] = (keys[at] == own) & (more[at] == other) & (first[at] < ids[words.doc[begins]])
    return hit


def _kept(table: pa.Table, answers: pa.Table) -> pa.Table:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.int64()]
    if not table.num_rows:
        return pa.Table.from_arrays([pa.array([], t) for t in kinds], names=KEPT.names)
    text = table.column("text")
    words = words_of(text, SPACED)
    removed = covered(len(words.hash), np.flatnonzero(_extended(words, _ids(table), answers)), LENGTH)
    counts = per_doc(removed, words.bounds)
    whole = words.data.tobytes()
    kept, repeats = [], []
    for d, n in enumerate(counts.tolist()):
        all_words = whole[words.offsets[d] : words.offsets[d + 1]].split()
        runs = np.zeros(0, dtype=np.int64)
        if n:
            gone = removed[words.bounds[d] : words.bounds[d + 1]]
            runs = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            all_words = [w for w, g in zip(all_words, gone.tolist()) if not g]
        kept.append(b" ".join(all_words))
        repeats.append([{"start": a, "end": b} for a, b in zip(runs[::2].tolist(), runs[1::2].tolist())])
    return pa.Table.from_arrays(
        [table.column("doc_id").cast(pa.int64()), pa.array(words.counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(repeats, kinds[4]), table.column("copies")], names=KEPT.names
    )


def remove_repeats(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text, repeats`` of each row of ``docs(doc_id, text)``.

    A word is removed if a window of 13 words that covers it begins in a
    document with a smaller doc_id as well; ``kept_text`` has the others, joined
    by blanks, and ``repeats`` are the word ranges that go. Null and empty texts have no words; shorter texts than a window lose
    none. Rows of one doc_id never remove each other's words, so repeated rows
    fare alike. A null doc_id counts as greater than all others. An empty table gives an
    empty result; other columns are not read. A text of any length is handled
    whole, in one chunk.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    copies = docs.groupBy("doc_id", *_text_keys(F.col("text"))).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copies = stash(copies, "copies")
    if copies.isEmpty():
        return _removed(docs.withColumn("copies", F.lit(1).cast("long")), chunk_bytes).drop("copies")
    # Rows that are there several times are judged once, and told to each.
    keys = ["hash", "other", "bytes"]
    repeated = copies.select(F.col("doc_id").alias("c_doc"), *[F.col(c).alias(f"c_{c}") for c in keys], "copies")
    keyed = docs.select("doc_id", "text", *_text_keys(F.col("text")))
    is_copy = F.col("doc_id").eqNullSafe(F.col("c_doc"))
    for c in keys:
        is_copy = is_copy & F.col(c).eqNullSafe(F.col(f"c_{c}"))
    small = within_bounds(repeated, F.lit(40))
    single = keyed.join(small, is_copy, "left_anti").select("doc_id", "text", F.lit(1).cast("long").alias("copies"))
    several = keyed.join(small, is_copy).groupBy("doc_id", *keys).agg(F.any_value("text").alias("text"), F.any_value("copies").alias("copies"))
    told = _removed(single.union(several.select("doc_id", "text", "copies")), chunk_bytes)
    return told.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")


def _text_keys(text: Column) -> list[Column]:
    """What tells texts of one doc_id apart."""
    return [F.xxhash64(text).alias("hash"), F.hash(text).alias("other"), F.octet_length(text).alias("bytes")]


def _removed(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // chunk_bytes))
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")).repartition("chunk")
    seeds = dealt.groupBy("chunk").applyInArrow(_seed_entries(n), ENTRIES)
    shared = seeds.groupBy("bucket").applyInArrow(_first_holders(False), ANSWERS)
    windows = dealt.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_window_entries(n), ENTRIES)
    earlier = windows.groupBy("bucket").applyInArrow(_first_holders(True), ANSWERS)
    return dealt.groupBy("chunk").cogroup(earlier.groupBy("chunk")).applyInArrow(_kept, KEPT)
