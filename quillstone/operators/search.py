"""Ranked retrieval as DataFrames.

Top-k uses Spark's per-partition heaps (``orderBy().limit()``); ranks are then numbered
over the k rows that are left, so no window sorts the whole table in one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import folded, terms
from quillstone.operators.graph import durable

K1, B = 1.2, 0.75
RRF = 60


def top(hits: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows with their ``rank`` from 1."""
    return hits.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))


def exact(units: DataFrame, literal: str) -> DataFrame:
    """Units that contain a literal, whatever its case."""
    return units.where(folded(F.col("text")).contains(literal.lower().replace("ß", "ss"))).select("unit")


def bm25(units: DataFrame, words: list[str]) -> DataFrame:
    """``unit, score`` of units with any of the words; less is better, repeated words count repeatedly.

    Texts are tokenised once: each unit's size and its counts of the query's words come from one pass and are written,
    and both the corpus statistics and the scores are read from there. The statistics are one row, broadcast to the scores.
    """
    times = Counter(words)
    names = {w: f"tf{i}" for i, w in enumerate(times)}
    found = F.filter("w", lambda x: x.isin(*times))
    counts = F.aggregate(found, F.array(*[F.lit(0) for _ in times]), lambda done, x: F.zip_with(done, F.array(*[F.lit(w) for w in times]), lambda n, w: n + (x == w).cast("int")))
    rows = units.select("unit", terms(F.col("text")).alias("w")).select("unit", F.size("w").alias("size"), counts.alias("c"))
    rows = durable(rows.select("unit", "size", *[F.get("c", F.lit(i)).alias(c) for i, c in enumerate(names.values())]))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean"), *[F.count_if(F.col(c) > 0).alias(f"df_{c}") for c in names.values()])
    score = F.lit(0.0)
    for w, c in names.items():
        idf = F.log((F.col("n") - F.col(f"df_{c}") + 0.5) / (F.col(f"df_{c}") + 0.5))
        weight = F.when(idf <= 0, 1e-6).otherwise(idf) * times[w]
        score = score + weight * F.col(c) * (K1 + 1) / (F.col(c) + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    any_word = F.greatest(*map(F.col, names.values())) if len(names) > 1 else F.col(next(iter(names.values())))
    return rows.where(any_word > 0).join(F.broadcast(stats)).select("unit", F.round(-score, 6).alias("score"))


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """``unit, score`` of all vectors against the one row of ``query``."""
    q = query.select(F.col("embedding").alias("q"))
    near = dot(F.col("embedding"), F.col("q")) / F.sqrt(dot(F.col("embedding"), F.col("embedding"))) / F.sqrt(dot(F.col("q"), F.col("q")))
    return vectors.join(F.broadcast(q)).select("unit", F.round(near, 6).alias("score"))


def fuse(channels: dict[str, DataFrame], k: int) -> DataFrame:
    """Reciprocal rank fusion of ranked channels; ties go to the lesser unit."""
    rows = None
    for name, hits in channels.items():
        one = hits.select("unit", F.lit(name).alias("channel"), "rank")
        rows = one if rows is None else rows.union(one)
    score = F.round(F.sum(1 / (RRF + F.col("rank"))), 9)
    fused = rows.groupBy("unit").agg(score.alias("score"), F.array_join(F.array_sort(F.collect_list("channel")), ",").alias("channels"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "unit")).cast("long")  # at most a page for each channel
    return fused.withColumn("rank", place).select("unit", "score", "rank", (F.col("rank") <= k).alias("selected"), "channels")



#: A word with something else on both sides: whatever holds the text around it holds it as a whole word.
INNER = r"(?<=[^\p{L}\p{N}])[\p{L}\p{N}]+(?=[^\p{L}\p{N}])"


#: So many words of anchors are looked for within a document's row, and so many short anchors are compared with all documents at once.
FEW_WORDS = 2_000
SHORT_BLOCK = 1_000


def occurrences(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """``item_id, n_documents, n_occurrences`` of each anchor text in the documents, as a plain literal.

    An anchor meets only documents that hold the rarest of its inner words, those between its first and last, which may be parts of
    longer words in a document. Anchors without inner words are compared with every document, in blocks of SHORT_BLOCK. Candidates are
    confirmed on whole texts. If anchors have few words, a document's other words don't leave its row.
    """
    wanted = anchors.select("item_id", F.col("text").alias("anchor")).where("anchor != ''").withColumn("inner", F.array_distinct(F.regexp_extract_all("anchor", F.lit(INNER), F.lit(0))))
    pieces = wanted.select("item_id", "anchor", F.explode("inner").alias("word"))
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    distinct = pieces.select(F.col("word").alias("w")).distinct()
    few = [r["w"] for r in distinct.limit(FEW_WORDS + 1).collect()]
    if len(few) <= FEW_WORDS:
        held = docs.select("doc_id", F.explode(F.array_intersect(words, F.array(*map(F.lit, few)).cast("array<string>"))).alias("w"))
    else:
        held = docs.select("doc_id", F.explode(words).alias("w")).join(distinct, "w", "left_semi")
    held = durable(held)
    counts = held.groupBy(F.col("w").alias("c_word")).agg(F.count(F.lit(1)).alias("k"))
    # A word that no document has makes its anchor's count zero, so absent ones are the rarest.
    rarest = pieces.join(counts, F.col("word") == F.col("c_word"), "left").groupBy("item_id", "anchor").agg(F.min(F.struct(F.coalesce("k", F.lit(0)).alias("k"), "word")).alias("r")).where("r.k > 0")
    pairs = held.join(rarest.select("item_id", "anchor", F.col("r.word").alias("r_word")), F.col("w") == F.col("r_word")).select(F.col("doc_id").alias("d"), "item_id", "anchor")
    own = docs.select("doc_id", "text")
    each = own.join(pairs, F.col("doc_id") == F.col("d")).where(F.col("text").contains(F.col("anchor"))).select("text", "item_id", "anchor")
    short = wanted.where(F.size("inner") == 0).select("item_id", "anchor")
    blocks = -(-short.count() // SHORT_BLOCK)
    for i in range(blocks):
        part = short.where(F.pmod(F.xxhash64("item_id", "anchor"), F.lit(blocks)) == i)
        each = each.union(own.join(F.broadcast(part), F.col("text").contains(F.col("anchor"))).select("text", "item_id", "anchor"))
    n = (F.length("text") - F.length(F.replace("text", "anchor", F.lit("")))) / F.length("anchor")
    counted = each.groupBy(F.col("item_id").alias("i")).agg(F.count(F.lit(1)).alias("n_documents"), F.sum(n).cast("long").alias("n_occurrences"))
    zero = F.lit(0).cast("long")
    return anchors.select("item_id").join(counted, F.col("item_id") == F.col("i"), "left").select("item_id", F.coalesce("n_documents", zero).alias("n_documents"), F.coalesce("n_occurrences", zero).alias("n_occurrences"))


#: Queries that are broadcast together, and those that are multiplied at once.
BLOCK = 10_000
SLICE = 256
#: Scores in millionths; a pair without a score is below all, and one that is no number above all.
_NONE, _NAN = -(2**62), 2**62


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest of ``vectors(vec_id, embedding, label)`` for each row of ``queries(query_id, q, q_label)``, itself left out, by cosine to six places and then ``vec_id``.

    The queries come in blocks of about BLOCK, each broadcast to tasks that go through all vectors batch by batch. A product of matrices finds
    the pairs that may be among the nearest, and these are scored in the order of ``dot``. A task keeps and hands on k rows of a query, so
    what is shuffled grows with the queries and not with the pairs.
    """
    spark = vectors.sparkSession
    blocks = max(1, -(-queries.count() // BLOCK))
    kind = lambda rows, c: rows.schema[c].dataType.simpleString()
    schema = f"query_id {kind(queries, 'query_id')}, q_label {kind(queries, 'q_label')}, vec_id {kind(vectors, 'vec_id')}, label {kind(vectors, 'label')}, micro long"
    dealt = vectors.select("vec_id", "embedding", "label").repartition(2 * spark.sparkContext.defaultParallelism)
    out = None
    for i in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).select("query_id", "q", "q_label").toArrow()  # about BLOCK rows
        part = spark.sparkContext.broadcast((rows["query_id"].to_pylist(), rows["q"].to_pylist(), rows["q_label"].to_pylist()))
        own = dealt.mapInArrow(lambda batches, part=part: _nearest(batches, *part.value, k), schema)
        out = own if out is None else out.union(own)
    w = Window.partitionBy("query_id").orderBy(F.desc("micro"), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
    score = F.when(F.col("micro") == _NAN, F.lit("NaN").cast("double")).when(F.col("micro") != _NONE, F.col("micro") / 1_000_000)
    return ranked.select("query_id", "q_label", "vec_id", "label", score.alias("score"), "rank")


def _matrices(vectors: list | pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The places and doubles of the vectors that hold no null, by their length."""
    array = vectors if isinstance(vectors, pa.Array) else pa.array(vectors, pa.list_(pa.float64()))
    sizes = np.asarray(pc.fill_null(pc.list_value_length(array), 0))
    flat = array.flatten()
    if flat.null_count:
        holes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[np.asarray(flat.is_null())], minlength=len(sizes)) > 0
    else:
        holes = np.zeros(len(sizes), dtype=bool)
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    good = ~holes & ~np.asarray(array.is_null())
    places = {n: np.flatnonzero(good & (sizes == n)) for n in np.unique(sizes[good]).tolist()}
    return {n: (at, values[(ends[at] - n)[:, None] + np.arange(n)]) for n, at in places.items()}


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up from the first entry to the last as ``dot`` does."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _millionths(x: np.ndarray) -> np.ndarray:
    """Whole millionths, halves of the shortest decimals away from zero as in ``round``."""
    x = np.where(np.isnan(x), 0.0, x)
    scaled = np.abs(x) * 1e6
    whole = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        whole[i] = float((Decimal(repr(abs(float(x[i])))) * 1_000_000).quantize(Decimal(1), ROUND_HALF_UP))
    return (np.sign(x) * whole).astype(np.int64)


def _best(query: np.ndarray, micro: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best of each query."""
    order = np.lexsort((vec, -micro, query))
    q = query[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return order[rank < k]


def _nearest(batches: Iterator[pa.RecordBatch], ids: list, vectors: list, labels: list, k: int) -> Iterator[pa.RecordBatch]:
    """``query_id, q_label, vec_id, label, micro`` of the k best of all batches for each query."""
    asked, own_ids = _matrices(vectors), np.array([_NONE if i is None else i for i in ids], dtype=np.int64)
    norms = {n: np.sqrt(_dots(m, m)) for n, (_, m) in asked.items()}
    bar = np.full(len(ids), -np.inf)  # what a pair must reach, in the rough products
    held = {"q": np.zeros(0, np.int64), "micro": np.zeros(0, np.int64), "vec": np.zeros(0, np.int64)}
    held_labels, schema = None, None

    def score(n: int, at: np.ndarray, m: np.ndarray, size: np.ndarray, vec: np.ndarray, q: slice) -> list[tuple[np.ndarray, ...]]:
        places, wanted = asked[n][0][q], asked[n][1][q]
        with np.errstate(all="ignore"):
            rough = (wanted / norms[n][q][:, None]) @ (m / size[:, None]).T
            odd = np.isnan(rough)
            rough[own_ids[places][:, None] == vec[at][None, :]] = -np.inf
            seen = np.where(odd, np.inf, rough)
            least = bar[places]
            if rough.shape[1] > k:
                least = np.maximum(least, np.partition(seen, -k, axis=1)[:, -k] - 2e-6)
            i, j = np.nonzero((seen >= least[:, None]) & (seen != -np.inf))
            exact = _dots(m[j], wanted[i]) / size[j] / norms[n][q][i]
        return places[i], np.where(np.isnan(exact), _NAN, _millionths(exact)), at[j]

    for batch in batches:
        schema = batch.schema
        vec = np.asarray(batch.column(0).cast(pa.int64()))
        found = []
        given = _matrices(batch.column(1))
        for n in given.keys() & asked.keys():
            at, m = given[n]
            size = np.sqrt(_dots(m, m))
            found += [score(n, at, m, size, vec, slice(s, s + SLICE)) for s in range(0, len(asked[n][0]), SLICE)]
        # Pairs without a score count only where a query has fewer than k with one.
        scored = np.bincount(held["q"][held["micro"] != _NONE], minlength=len(ids)) + sum((np.bincount(f[0], minlength=len(ids)) for f in found), np.zeros(len(ids), np.int64))
        alike = {int(p): n for n, (places, _) in asked.items() for p in places} if (scored < k).any() else {}
        for q in np.flatnonzero(scored < k):
            mute = np.setdiff1d(np.arange(len(vec)), given[alike[int(q)]][0] if alike.get(int(q)) in given else [])
            mute = mute[vec[mute] != own_ids[q]]
            mute = mute[np.argsort(vec[mute], kind="stable")[:k]]
            found.append((np.full(len(mute), q), np.full(len(mute), _NONE), mute))
        if not found:
            continue
        q, micro, at = (np.concatenate([f[c] for f in found]).astype(np.int64) for c in range(3))
        label = batch.column(2).take(pa.array(at))
        held = {"q": np.r_[held["q"], q], "micro": np.r_[held["micro"], micro], "vec": np.r_[held["vec"], vec[at]]}
        held_labels = label if held_labels is None else pa.concat_arrays([held_labels, label])
        best = _best(held["q"], held["micro"], held["vec"], k)
        held, held_labels = {c: v[best] for c, v in held.items()}, held_labels.take(pa.array(best))
        full = np.flatnonzero(np.bincount(held["q"], minlength=len(ids)) >= k)
        worst = np.full(len(ids), _NAN)
        np.minimum.at(worst, held["q"], held["micro"])
        good = full[(worst[full] != _NONE)]
        bar[good] = np.where(worst[good] == _NAN, np.inf, worst[good] / 1e6 - 2e-6)
    if held_labels is not None and len(held_labels):
        q = held["q"].tolist()
        columns = [pa.array([ids[i] for i in q]), pa.array([labels[i] for i in q], held_labels.type), pa.array(held["vec"]).cast(schema.field(0).type), held_labels, pa.array(held["micro"])]
        yield pa.RecordBatch.from_arrays(columns, ["query_id", "q_label", "vec_id", "label", "micro"])
