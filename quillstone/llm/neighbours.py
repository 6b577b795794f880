"""Nearest neighbours by largest inner product: cross-polytope hashing, multiprobe tables, exact reranking.

Hashing. A vector of unit length is turned by fast pseudo-rotations, each of three rounds of random signs and a Hadamard transform, and its code is the
signed axis nearest to each of the results. A table's bucket is the codes of one or several rotations, the last of them on
fewer axes, so that buckets hold about BUCKET_ROWS rows at any size of the table. Vectors of other lengths get one more
entry first, that fills candidates up to the greatest length and is 0 in queries: then nearest is largest inner product.

Multiprobe. A query looks into the buckets whose axes it lies nearest to, in that order. How many it takes is fitted: a bounded
sample of queries is compared with every row, and the fewest probes are taken with which FIT_RECALL of the sample's true neighbours are found.

Reranking. Candidates lie by bucket, in parts of PART_ROWS rows each, so that a bucket of a third of all rows is many parts. The
queries of a bucket go to each of its parts and are scored there in blocks with the original vectors; of each query
only the nearest of all parts of a task leave it. A bounded sample of rows gives each query a floor that more than k rows are above.
A query that finds fewer than k rows above it looks into four times as many buckets, and so on to all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.store import stash, within_bounds
from quillstone.llm.vectors import dimension, matrix, pieces, usable

NEAREST = 20
TABLES = 2
#: Rows that a bucket holds on average, where rotations have axes enough.
BUCKET_ROWS = 400
#: Candidates that are held at once.
PART_ROWS = 512
#: Rows of results that a task holds before it hands them on.
HELD_ROWS = 1_000_000
#: Queries that are scored at once.
BLOCK = 256
#: The sample of queries that probes are fitted on, and the share of its neighbours that are found.
FIT_QUERIES = 256
FIT_RECALL = 0.95
#: The sample of rows that floors are taken from, and how many times k of it may lie above a floor.
FLOOR_ROWS = 8192
FLOOR_TIMES = 3
#: Sums of axes that are put in order at once.
SUMS = 4_000_000
#: Lengths within this share of the greatest count as equal.
SAME_LENGTH = 1e-4
ROUNDS = 3
SEED = 71_993

FOUND = "query_id long, vec_id long, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Hadamard transform of each row, scaled to keep lengths. Rows have a power of two of entries."""
    width = x.shape[1]
    x = x.copy()
    step = 1
    while step < width:
        pairs = x.reshape(len(x), width // (2 * step), 2, step)
        low, high = pairs[:, :, 0, :] + pairs[:, :, 1, :], pairs[:, :, 0, :] - pairs[:, :, 1, :]
        pairs[:, :, 0, :], pairs[:, :, 1, :] = low, high
        step *= 2
    return x / math.sqrt(width)


@dataclass(frozen=True)
class Tables:
    """Hash tables for vectors of ``width`` entries, of a greatest length ``most``. ``axes``: of each rotation of a table, how many axes count."""

    width: int
    most: float
    lifted: bool
    axes: tuple[int, ...]
    tables: int = TABLES
    seed: int = SEED

    @property
    def turned(self) -> int:
        return 1 << max(0, self.width + self.lifted - 1).bit_length()

    @property
    def buckets(self) -> int:
        return math.prod(2 * a for a in self.axes)

    def _unit(self, x: np.ndarray, query: bool) -> np.ndarray:
        own = np.linalg.norm(x, axis=1)
        out = np.zeros((len(x), self.turned))
        if self.lifted and not query:
            out[:, : self.width] = x / self.most
            out[:, self.width] = np.sqrt(np.maximum(0.0, 1 - (own / self.most) ** 2))
        else:
            out[:, : self.width] = x / own[:, None]
        return out

    def _signed(self, unit: np.ndarray, table: int) -> Iterator[np.ndarray]:
        """For each rotation, how near each vector is to each signed axis."""
        for i, axes in enumerate(self.axes):
            signs = np.random.default_rng([self.seed, table, i]).choice([-1.0, 1.0], (ROUNDS, self.turned))
            y = unit
            for s in signs:
                y = hadamard(y * s)
            yield np.concatenate([y[:, :axes], -y[:, :axes]], axis=1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each candidate in each table."""
        unit = self._unit(x, False)
        out = np.zeros((len(x), self.tables), dtype=np.int64)
        for t in range(self.tables):
            for near in self._signed(unit, t):
                out[:, t] = out[:, t] * near.shape[1] + near.argmax(axis=1)
        return out

    def probes(self, x: np.ndarray, most: int) -> np.ndarray:
        """The first ``most`` buckets of each query in each table, the likeliest first."""
        most = min(most, self.buckets)
        out = np.zeros((len(x), self.tables, most), dtype=np.int64)
        rows = max(1, SUMS // (most * 2 * self.turned))
        for a in range(0, len(x), rows):
            unit = self._unit(x[a : a + rows], True)
            for t in range(self.tables):
                code, value = np.zeros((len(unit), 1), dtype=np.int64), np.zeros((len(unit), 1))
                for near in self._signed(unit, t):
                    # The best sums of so many are sums of the best of each.
                    value = (value[:, :, None] + near[:, None, :]).reshape(len(unit), -1)
                    code = (code[:, :, None] * near.shape[1] + np.arange(near.shape[1])).reshape(len(unit), -1)
                    order = np.argsort(-value, axis=1, kind="stable")[:, :most]
                    value, code = np.take_along_axis(value, order, 1), np.take_along_axis(code, order, 1)
                out[a : a + rows, t] = code
        return out


def _axes(rows: int, turned: int) -> tuple[int, ...]:
    """Axes of each rotation, for buckets of about BUCKET_ROWS rows. The first has all."""
    left = rows / BUCKET_ROWS / (2 * turned)
    out = [turned]
    while left >= 2:
        out.append(min(turned, 1 << int(left / 2).bit_length() - 1))
        left /= 2 * out[-1]
    return tuple(out)


def _top(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best of these rows by falling score, then vec_id; of rows of one vec_id the best."""
    order = np.lexsort((-score, vec, query))
    query, vec, score = query[order], vec[order], score[order]
    new = np.ones(len(query), dtype=bool)
    new[1:] = (query[1:] != query[:-1]) | (vec[1:] != vec[:-1])
    query, vec, score = query[new], vec[new], score[new]
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    top = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[top], vec[top], score[top]


def _best(q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, candidate and score of each query's k nearest among these candidates, none under its floor and none of its own id."""
    out = []
    slack = 1e-9 * (np.linalg.norm(q, axis=1) * (np.linalg.norm(c, axis=1).max() if len(c) else 0.0) + 1e-300)
    many = len(c) > 4 * k and len(np.unique(c_ids)) == len(c)
    for a in range(0, len(q), BLOCK):
        b = min(len(q), a + BLOCK)
        rough = q[a:b] @ c.T
        rough[q_ids[a:b, None] == c_ids[None, :]] = -np.inf
        least = floor[a:b]
        if many:
            least = np.maximum(least, np.partition(rough, len(c) - k, axis=1)[:, len(c) - k])
        qi, ci = np.nonzero((rough >= (least - slack[a:b])[:, None]) & (rough > -np.inf))
        # Scores are added up entry by entry in one order, so that equal vectors have equal scores.
        score = np.concatenate([(q[a + qi[i : i + 65536]] * c[ci[i : i + 65536]]).sum(axis=1) for i in range(0, len(qi), 65536)]) if len(qi) else np.zeros(0)
        keep = score >= floor[a:b][qi]
        out.append(_top(q_ids[a + qi[keep]], c_ids[ci[keep]], score[keep], k))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


class Nearest:
    """The k nearest of each query so far, handed on when they are many."""

    def __init__(self, k: int):
        self.k = k
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0
        self.full = False

    def add(self, part: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        self.parts.append(part)
        self.rows += len(part[0])
        if self.rows > 2 * HELD_ROWS:
            self._shrink()
            self.full = self.rows > HELD_ROWS

    def _shrink(self) -> None:
        self.parts = [_top(*map(np.concatenate, zip(*self.parts)), self.k)] if self.parts else []
        self.rows = sum(len(p[0]) for p in self.parts)

    def taken(self) -> list[pa.RecordBatch]:
        self._shrink()
        out, self.parts, self.rows = [_found(*p) for p in self.parts], [], 0
        self.full = False
        return out


def _found(query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score)], names=["query_id", "vec_id", "score"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """FOUND with ``rank``: each query's k nearest, each vec_id once with its best score."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _sample(rows: DataFrame, width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` rows, those of least hash: ids and vectors."""
    got = rows.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(most).toArrow()
    return got.column("vec_id").to_numpy(), matrix(got.column("embedding").combine_chunks(), width) if got.num_rows else np.zeros((0, width))


def nearest_in(rows: DataFrame, width: int, q_ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """FOUND of a bounded block of queries against every row, by comparing all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Nearest(k)
        for batch in pieces(batches, width):
            best.add(_best(q, q_ids, np.full(len(q), -np.inf), matrix(batch.column(1), width), batch.column(0).to_numpy(), k))
        yield from best.taken()

    return _ranked(rows.select("vec_id", "embedding").mapInArrow(run, FOUND), k).select("query_id", "vec_id", "score")


def fit_probes(rows: DataFrame, queries: DataFrame, tables: Tables, k: int, most: int = FIT_QUERIES, recall: float = FIT_RECALL) -> tuple[int, float]:
    """The fewest probes of each table with which this share of the true neighbours of a sample of queries is found, and that share."""
    q_ids, q = _sample(queries, tables.width, most)
    if not len(q):
        return tables.buckets, 1.0
    true = nearest_in(rows, tables.width, q_ids, q, k).select("query_id", F.col("vec_id").alias("t_id"))
    near = rows.join(F.broadcast(true), F.col("vec_id") == F.col("t_id")).select("query_id", "vec_id", "embedding").toArrow()  # k rows a query
    if not near.num_rows:
        return tables.buckets, 1.0
    order = np.argsort(q_ids, kind="stable")
    at = order[np.searchsorted(q_ids[order], near.column("query_id").to_numpy())]
    codes = tables.codes(matrix(near.column("embedding").combine_chunks(), tables.width))
    tried = 64
    while True:
        tried = min(tables.buckets, tried)
        place = np.full(len(codes), tables.buckets, dtype=np.int64)
        for a in range(0, len(codes), BLOCK):
            hit = tables.probes(q[at[a : a + BLOCK]], tried) == codes[a : a + BLOCK, :, None]
            first = np.where(hit.any(axis=2), hit.argmax(axis=2), tables.buckets)
            place[a : a + BLOCK] = first.min(axis=1)
        enough = int(np.sort(place)[math.ceil(recall * len(place)) - 1]) + 1
        if enough <= tried or tried == tables.buckets:
            return min(enough, tables.buckets), float((place < enough).mean())
        tried *= 4


def _index(rows: DataFrame, tables: Tables) -> DataFrame:
    """``table, bucket, vec_id, embedding`` of each row in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, tables.width):
            codes = tables.codes(matrix(batch.column("embedding"), tables.width))
            for t in range(tables.tables):
                columns = [pa.array(np.full(len(codes), t), pa.int32()), pa.array(codes[:, t]), batch.column("vec_id"), batch.column("embedding")]
                yield pa.RecordBatch.from_arrays(columns, names=["table", "bucket", "vec_id", "embedding"])

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.select("vec_id", "embedding").mapInArrow(run, f"table int, bucket long, vec_id long, embedding {kind}")


def _probed(queries: DataFrame, tables: Tables, probes: int, floors: tuple[np.ndarray, np.ndarray], k: int) -> DataFrame:
    """``table, bucket, vec_id, floor, embedding`` of each probe of each query."""
    f_ids, f = floors
    above = FLOOR_TIMES * k
    kind = queries.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                q, ids = matrix(part.column("embedding"), tables.width), part.column("vec_id").to_numpy()
                floor = np.full(len(q), -np.inf)
                if len(f) > above:
                    rough = q @ f.T
                    rough[ids[:, None] == f_ids[None, :]] = -np.inf
                    floor = np.partition(rough, len(f) - above, axis=1)[:, len(f) - above]
                at = tables.probes(q, probes)
                each = np.repeat(np.arange(len(q)), at.shape[2])
                for t in range(tables.tables):
                    take = pa.array(each)
                    columns = [pa.array(np.full(len(each), t), pa.int32()), pa.array(at[:, t].ravel()), part.column("vec_id").take(take), pa.array(floor[each]), part.column("embedding").take(take)]
                    yield pa.RecordBatch.from_arrays(columns, names=["table", "bucket", "vec_id", "floor", "embedding"])

    return queries.select("vec_id", "embedding").mapInArrow(run, f"table int, bucket long, vec_id long, floor double, embedding {kind}")


def _rerank(width: int, k: int):
    """Rows come by part of a bucket, its candidates first; the queries stream past these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, best = None, [], Nearest(k)
        for batch in pieces(batches, width):
            x, ids, floor = matrix(batch.column("embedding"), width), batch.column("vec_id").to_numpy(), batch.column("floor").to_numpy(zero_copy_only=False)
            is_query = batch.column("is_query").to_numpy(zero_copy_only=False)
            place = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("table", "bucket", "part")], axis=1)
            cuts = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)]):
                key = tuple(place[a])
                if key != now:
                    now, held = key, []
                c = a + int((~is_query[a:b]).sum())
                if c > a:
                    held.append((x[a:c], ids[a:c]))
                if b > c and held:
                    if len(held) > 1:
                        held = [(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))]
                    best.add(_best(x[c:b], ids[c:b], floor[c:b], *held[0], k))
            if best.full:
                yield from best.taken()
        yield from best.taken()

    return run


def _search(index: DataFrame, parts: DataFrame, probed: DataFrame, width: int, k: int) -> DataFrame:
    """FOUND of the probes against the parts of their buckets."""
    parts = within_bounds(parts, F.lit(24))
    own = index.join(parts, ["table", "bucket"]).select("table", "bucket", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("is_query"), "vec_id", F.lit(0.0).alias("floor"), "embedding")
    asked = probed.join(parts, ["table", "bucket"]).select("table", "bucket", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("part"), F.lit(True).alias("is_query"), "vec_id", "floor", "embedding")
    by = ["table", "bucket", "part"]
    return own.union(asked).repartition(*by).sortWithinPartitions(*by, "is_query").mapInArrow(_rerank(width, k), FOUND)


def prepared(vectors: DataFrame) -> DataFrame:
    """The rows of ``vectors(vec_id, embedding)`` that take part, but for their length."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).where(F.exists("embedding", lambda c: c != 0))


def nearest(vectors: DataFrame, is_query, k: int = NEAREST, recall: float = FIT_RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each row of ``vectors(vec_id, embedding)`` of which ``is_query`` holds.

    Nearness is the inner product of the vectors as given, in double precision; equally near rows come by vec_id. Vectors that are null, zero or
    hold null or non-finite entries take no part, nor do rows without a vec_id or of a length that isn't the commonest (of equally common
    ones the greatest). A query's candidates are the rows of other vec_ids, each of which is returned once: repeated
    rows count as one, and of different vectors of one vec_id the nearest counts. With fewer candidates than k all are
    returned. An empty table gives an empty result; other columns are not read.
    """
    rows = prepared(vectors)
    width, n = dimension(rows, "embedding")
    rows = rows.where(F.size("embedding") == width)
    spark: SparkSession = vectors.sparkSession
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
    ends = rows.agg(F.min(length).alias("least"), F.max(length).alias("most")).first()
    lifted = ends["least"] < (1 - SAME_LENGTH) * ends["most"]
    tables = Tables(width, ends["most"], lifted, ())
    tables = replace(tables, axes=_axes(n, tables.turned))
    queries = rows.where(is_query)
    probes, _ = fit_probes(rows, queries, tables, k, recall=recall)
    index = _index(rows, tables)
    parts = stash(index.groupBy("table", "bucket").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("parts")), "parts")
    floors = _sample(rows, width, FLOOR_ROWS)
    done = None
    while True:
        probed = _probed(queries, tables, probes, floors, k)
        ranked = stash(_ranked(_search(index, parts, probed, width, k), k), "nearest")
        done = ranked if done is None else done.union(ranked)
        full = done.groupBy("query_id").agg(F.count(F.lit(1)).alias("found")).where(F.col("found") >= k)
        queries = queries.join(full, F.col("vec_id") == F.col("query_id"), "left_anti")
        if probes == tables.buckets or not queries.take(1):
            return done
        queries = stash(queries, "short")
        done = done.join(queries.select(F.col("vec_id").alias("s_id")).distinct(), F.col("query_id") == F.col("s_id"), "left_anti")
        probes = min(tables.buckets, 4 * probes)
