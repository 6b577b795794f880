"""Near-duplicate groups: SuperMinHash, banding, verification, union-find.

Signatures. Each shingle gives every slot a rank of its own: slot ``a + b (j + c) ** e
mod 127`` has rank j plus a hash in [0, 1), with a, b, c and the exponent e (prime to 126) from the shingle's
hash. So the ranks of one shingle are one of 73 million permutations of the slots, and the minima over a
set are less scattered than with independent hashes. Ranks are taken level by
level for all shingles of a batch; a document stops at the first level that is above all
its minima, after a level or three if it has a few hundred shingles.

Banding. 31 bands of four slots: a pair at the threshold of 0.75 shares none
with probability 0.684 ** 31 = 8e-6.

Verification. Documents with equal shingle sets are one class, of which only the
least doc_id goes on. In each bucket the members are compared with its least member
on full shingle sets, one comparison a member. A bucket whose members are then in one
component is done. The members of the others share a common passage more often than
a likeness, or are versions of one text that lie just too far apart. They are dealt into
new buckets by an exact rule. A document's shingles are ordered from the rarest among
these members on. Texts of n and m shingles with a similarity of 0.75 have at
least 3/7 (n + m) in common, so the first common one can't come later than that leaves room for, in
either. So a document is at home under its first n - 6/7 n shingles in
the bucket of its size, and looks for smaller ones in the buckets of those sizes that its place
allows. Homes become pivots in turn, more of them each round, compared with those that
look there and are in other components, until each bucket is in one component or all its
homes have been pivots. No bucket is cut off and no pair is judged by an estimate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.columns import unwrapped, wrapped
from quillstone.llm.components import components
from quillstone.llm.inplace import among, without
from quillstone.llm.store import stash
from quillstone.llm.wordkernel import GRAM, SMALL_SLICE_BYTES, SPACED, U64, Words, mix, slices, words_of

SHINGLE = 5
PERCENT = 75
SLOTS = 127
ROWS = 4
BANDS = 31
#: Ratio of the sizes that share a bucket.
SIZE_STEP = 1.05
#: A round has so many times the pivots of those before it.
PIVOTS = 8
#: Members of one pivot that are compared in one task.
MEMBERS = 500
#: Members of one bucket that are put in order in one task.
DEALT = 20_000
#: Powers modulo SLOTS by the exponents that permute all residues.
POWERS = np.array([[pow(x, e, SLOTS) for x in range(SLOTS)] for e in range(1, SLOTS - 1) if math.gcd(e, SLOTS - 1) == 1], dtype=np.int64)

SKETCH = [
    T.StructField("n_shingles", T.LongType()),
    T.StructField("d1", T.LongType()),
    T.StructField("d2", T.LongType()),
    T.StructField("bands", T.ArrayType(T.LongType())),
]


def shingle_sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all documents, and each document's range in them."""
    grams, room = words.grams(SHINGLE)
    counts = words.counts
    use = room
    for k in range(1, SHINGLE):  # a shorter text is one shingle
        first = words.bounds[:-1][counts == k]
        if len(first):
            grams[first] = words.grams(k)[0][first]
            use[first] = True
    at = np.flatnonzero(use)
    keys = grams[at]
    bounds = np.searchsorted(at, words.bounds)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        keys[a:b].sort()
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    new[bounds[:-1][bounds[:-1] < len(keys)]] = True
    sums = np.zeros(len(keys) + 1, dtype=np.int64)
    np.cumsum(new, out=sums[1:])
    return keys[new], sums[bounds]


def signatures(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of SLOTS minima (rank << 25 | hash) for each document."""
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(bounds))
    least = np.full(n * SLOTS, np.iinfo(np.uint32).max, dtype=np.uint32)
    spread = mix(keys ^ U64(0x5851F42D4C957F2D))
    a = (spread % U64(SLOTS)).astype(np.int64)
    b = (1 + (spread >> U64(16)) % U64(SLOTS - 1)).astype(np.int64)
    c = ((spread >> U64(32)) % U64(SLOTS)).astype(np.int64)
    e = ((spread >> U64(48)) % U64(len(POWERS))).astype(np.int64)
    for rank in range(SLOTS):
        value = (mix(keys + U64((rank + 1) * int(GRAM) & 0xFFFFFFFFFFFFFFFF)) >> U64(39)).astype(np.uint32) | np.uint32(rank << 25)
        np.minimum.at(least, doc * SLOTS + (a + b * POWERS[e, (c + rank) % SLOTS]) % SLOTS, value)
        open_docs = least.reshape(n, SLOTS).max(axis=1) >= np.uint32((rank + 1) << 25)
        left = open_docs[doc]
        if not left.any():
            break
        if not left.all():
            keys, doc, a, b, c, e = keys[left], doc[left], a[left], b[left], c[left], e[left]
    return least.reshape(n, SLOTS)


def bands_of(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = signature[:, : BANDS * ROWS].reshape(len(signature), BANDS, ROWS).astype(U64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64), parts.shape[:2]).copy()
    for i in range(ROWS):
        out = mix(out * GRAM + parts[:, :, i])
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SMALL_SLICE_BYTES):
        keys, bounds = shingle_sets(words_of(batch.column("text"), SPACED, lower=True))
        counts = np.diff(bounds)
        digests = []
        for salt in (U64(0x2545F4914F6CDD1D), U64(0x9FB21C651E98DF25)):
            sums = np.zeros(len(keys) + 1, dtype=U64)
            np.cumsum(mix(keys ^ salt), out=sums[1:])
            digests.append((sums[bounds[1:]] - sums[bounds[:-1]]).astype(np.int64))
        full = np.flatnonzero(counts)
        own = np.concatenate([[0], np.cumsum(counts[full])])
        bands = bands_of(signatures(keys, own)).astype(np.int64) if len(full) else np.zeros((0, BANDS), dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum((counts > 0) * BANDS)]).astype(np.int32)
        arrays = [batch.column("doc_id"), pa.array(counts, pa.int64()), *[pa.array(d) for d in digests], pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.ravel()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *[f.name for f in SKETCH]])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by pivot, the pivot's own text first: one set is held at a time."""
    pivot, mine = None, np.zeros(0, dtype=U64)
    for batch in slices(batches, "text", SMALL_SLICE_BYTES):
        keys, bounds = shingle_sets(words_of(batch.column("text"), SPACED, lower=True))
        found = []
        for i, (p, m) in enumerate(zip(batch.column("p").to_pylist(), batch.column("m").to_pylist())):
            own = keys[bounds[i] : bounds[i + 1]]
            if p == m:
                pivot, mine = p, own.copy()
            elif p == pivot and PERCENT * max(len(own), len(mine)) <= 100 * min(len(own), len(mine)):
                at = np.searchsorted(mine, own)
                at[at == len(mine)] = 0
                shared = int((mine[at] == own).sum())
                if 100 * shared >= PERCENT * (len(own) + len(mine) - shared):
                    found.append((p, m))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["p", "m"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs ``(p, m)`` whose shingle sets are similar enough."""
    count = pairs.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("parts"))
    dealt = pairs.join(count, "p").select("p", F.pmod(F.xxhash64("m"), F.col("parts")).alias("part"), "m")
    rows = dealt.union(dealt.select("p", "part", F.col("p").alias("m")).distinct())
    full = rows.join(texts, F.col("m") == F.col("doc_id")).select("p", "part", "m", "text")
    order = full.repartition("p", "part").sortWithinPartitions("p", "part", F.col("m") != F.col("p"), "m")
    return order.select("p", "m", "text").mapInArrow(_compare, "p long, m long").distinct()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SMALL_SLICE_BYTES):
        keys, bounds = shingle_sets(words_of(batch.column("text"), SPACED, lower=True))
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(keys.astype(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), lists], names=["doc_id", "n", "keys"])


def _rare_buckets(texts: DataFrame) -> DataFrame:
    """``key, doc_id, n, at, home``: documents under those rare shingles, and sizes of partners, of which a similar pair must share one.

    ``at`` is the shingle's place in the document's order, from 0.
    """
    each = texts.mapInArrow(_sets, "doc_id long, n long, keys array<long>").select("doc_id", "n", F.explode("keys").alias("key"))
    common = each.groupBy("key").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
    held = each.join(common, "key")
    own = Window.partitionBy("doc_id")
    held = held.withColumns({"place": F.row_number().over(own.orderBy("holders", "key")), "held": F.count(F.lit(1)).over(own)})
    held = held.withColumn("at", F.col("n") - F.col("held") + F.col("place") - 1)  # shingles that nobody else has come before all others
    least = F.ceil(F.col("n") * PERCENT / 100)
    most = F.least(F.col("n"), F.floor((F.col("n") - F.col("at")) * (100 + PERCENT) / PERCENT) - F.col("n"))
    held = held.select("key", "doc_id", "n", "at", least.alias("least"), most.alias("most")).where("most >= least")
    size = lambda c: F.floor(F.log(F.col(c).cast("double")) / math.log(SIZE_STEP)).cast("int")
    dealt = held.select("*", F.explode(F.sequence(size("least"), size("most"))).alias("size"))
    home = (F.col("size") == size("n")) & (F.col("most") == F.col("n"))
    return dealt.select(F.xxhash64("key", "size").alias("key"), "doc_id", "n", "at", home.alias("home"))


def _named(members: DataFrame, groups: DataFrame) -> DataFrame:
    """The members of those buckets that are not yet in one component, with the ``label`` of theirs and the ``parts`` that their bucket is dealt into."""
    named = members.drop("label", "parts").join(groups, F.col("doc_id") == F.col("node"), "left").withColumn("label", F.coalesce("component", "doc_id")).drop("node", "component")
    home = F.max("home") if "home" in members.columns else F.lit(True)  # nobody is compared in a bucket without homes
    still = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), home.alias("any"), F.ceil(F.count(F.lit(1)) / DEALT).alias("parts"))
    return named.join(still.where("low != high and any").select("key", "parts"), "key")


def _close(members: DataFrame, texts: DataFrame, groups: DataFrame, checked: DataFrame) -> DataFrame:
    """Components after comparing, in each bucket, all homes with those of other components that a similar pair could be made of."""
    dealt = _named(members, groups).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts"))).repartition("key", "part")
    place = F.row_number().over(Window.partitionBy("key", "part").orderBy(F.desc("home"), "doc_id"))
    # The parts of a bucket take turns in turn, so that none of its turns comes twice though no task orders the whole bucket.
    turn = F.when(F.col("home"), (place - 1) * F.col("parts") + F.col("part") + 1)
    named = stash(dealt.withColumn("turn", turn).drop("part", "parts"), "open")
    last = named.agg(F.max("turn")).first()[0] or 0
    done = 0  # homes of each bucket that have been its pivots
    while done < last:
        upto = PIVOTS * done + 1
        pivots = named.where(F.col("turn").between(done + 1, upto)).select("key", *[F.col(c).alias(f"p_{c}") for c in ("doc_id", "label", "n", "at")])
        needed = PERCENT * (F.col("n") + F.col("p_n"))
        room = (100 + PERCENT) * F.least(F.col("n") - F.col("at"), F.col("p_n") - F.col("p_at"))
        more = named.join(pivots, "key").where((F.col("label") != F.col("p_label")) & (F.col("n") >= F.col("p_n")) & (room >= needed))
        more = more.select(F.least("p_doc_id", "doc_id").alias("p"), F.greatest("p_doc_id", "doc_id").alias("m")).distinct()
        more = stash(more.join(checked, ["p", "m"], "left_anti"), "pairs")
        if more.take(1):
            checked = checked.union(more)
            found = stash(_verified(more, texts), "links")
            if found.take(1):
                groups = components(groups.select(F.col("component").alias("p"), F.col("node").alias("m")).union(found), "p", "m")
                if upto < last:
                    named = stash(_named(named, groups), "open")
        done = upto
    return groups


def _texts_of(texts: DataFrame, members: DataFrame) -> DataFrame:
    """``texts(doc_id, text)`` of these documents; the others' stay in their tasks."""
    ids = stash(members.select(F.col("doc_id").alias("id")).distinct(), "ids")
    return among(texts, F.col("doc_id"), ids, F.lit(16))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row of ``docs(doc_id, text)``.

    Texts are linked from a similarity of 0.75 on; a component is named by its
    least doc_id, and that document is kept. Null, empty and blank texts have no
    shingles and are linked with nothing. Rows with a null doc_id are linked with nothing, and kept.
    Repeated rows have the same component, so both are kept or neither; rows of
    one doc_id with different texts count as linked. An empty table gives an empty
    result; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *SKETCH])
    sketch = stash(docs.mapInArrow(_sketch, schema), "sketch")
    linked = sketch.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    digest = ["d1", "d2", "n_shingles"]
    classes = linked.groupBy(*digest).agg(F.min("doc_id").alias("rep"))
    firsts = linked.join(classes.select("rep", *[F.col(c).alias(f"r_{c}") for c in digest]), (F.col("doc_id") == F.col("rep")) & (F.col("d1") == F.col("r_d1")) & (F.col("d2") == F.col("r_d2")), "left_semi")
    keyed = firsts.select("doc_id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("doc_id").alias("p"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stash(keyed.join(shared, "key").select("key", "p", "size", "doc_id"), "buckets")
    texts = stash(_texts_of(docs, members), "texts")

    pairs = stash(members.where("doc_id != p").select("p", F.col("doc_id").alias("m")).distinct(), "pairs")
    links = stash(_verified(pairs, texts), "links")
    groups = components(links, "p", "m")
    rest = _named(members.where("size > 2").select("key", "doc_id"), groups)
    rest = stash(_texts_of(texts, rest), "rest")
    if rest.take(1):
        groups = _close(_rare_buckets(rest), rest, groups, pairs)
    grouped = classes.join(groups, F.col("rep") == F.col("node"), "left").select(*[F.col(c).alias(f"r_{c}") for c in digest], F.coalesce("component", "rep").alias("component"))
    same = (F.col("d1") == F.col("r_d1")) & (F.col("d2") == F.col("r_d2")) & (F.col("n_shingles") == F.col("r_n_shingles"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return sketch.select("doc_id", *digest).join(grouped, same, "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns unchanged. Columns may have any names."""
    gone = stash(near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct(), "gone")
    return unwrapped(without(wrapped(docs), F.col("doc_id").cast("long"), gone, F.lit(16)), docs.columns)
