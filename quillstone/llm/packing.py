"""Cost-balanced packing of tokenised documents into training sequences.

A piece of n tokens costs ``LINEAR * n + QUADRATIC * n * n`` (projections and
attention). Within a window of documents the pieces are taken in descending
order, and each goes to the sequence of least cost that still has room for it.
There are just enough sequences to hold the window's tokens; when no sequence
has room for a whole piece, it is cut and its head fills the sequence of least
cost that has any room. So at most one sequence's worth of padding is left in a window.

Packing is a narrow transformation: each partition packs its own documents in
windows of ``WINDOW`` tokens, without a shuffle. A lost task packs the same rows again.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillstone.llm.wordkernel import slices

SEQUENCE_TOKENS = 2048
WINDOW = 512 * SEQUENCE_TOKENS
LINEAR = 1.0
QUADRATIC = 1.0 / 1024
END_ID = 1

#: Chunks of more bytes than this are not kept between batches, nor more chunks than that: of those met in one batch, and of those met again.
CACHED_BYTES = 64
CACHED_CHUNKS = 250_000
#: Words encoded in one go, and marks that may end one of them.
LINE = 100
PUNCTUATION = frozenset(",.;:!?")

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


class ChunkEncoder:
    """Ids of texts by the tokenizers library, one white-space separated chunk at a time.

    Exact for tokenizers that drop white space before splitting: no token and
    no normalisation reaches across an ASCII blank. Chunks recur, so their ids are kept.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.met: dict[bytes, bytes] = {}
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)

    def _each(self, chunks: list[bytes]) -> list[bytes]:
        texts = [c.decode() for c in chunks]
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each chunk. Plain words go in lines, whose ids are cut where a word ends."""
        known: dict[bytes, bytes] = {}
        plain = [(c, 2 if t[-1] in PUNCTUATION else 1) for c in chunks if (t := c.decode()).isalpha() or (t[-1] in PUNCTUATION and t[:-1].isalpha())]
        lines = [plain[i : i + LINE] for i in range(0, len(plain), LINE)]
        encoded = self.tokenizer.encode_batch_fast([b" ".join([c for c, _ in line]).decode() for line in lines], add_special_tokens=False)
        for line, e in zip(lines, encoded):
            ids = np.array(e.ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids])
            last = np.cumsum([n for _, n in line]) - 1
            if len(ends) == last[-1] + 1:  # else lower-casing has split some word
                raw, at = ids.tobytes(), 0
                for (c, _), end in zip(line, (4 * ends[last] + 4).tolist()):
                    known[c], at = raw[at:end], end
        rest = [c for c in chunks if c not in known]
        known.update(zip(rest, self._each(rest)))
        return [known[c] for c in chunks]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        wanted = set().union(*split)
        ids = {c: i for c in wanted if (i := self.known.get(c)) is not None}
        again = {c: i for c in wanted if (i := self.met.get(c)) is not None and c not in ids}
        new = list(wanted.difference(ids, again))
        fresh = dict(zip(new, self._encode(new)))
        # What recurs stays when what was met once goes.
        if len(self.known) > CACHED_CHUNKS:
            self.known.clear()
        if len(self.met) > CACHED_CHUNKS:
            self.met.clear()
        self.known.update(again)
        for c in again:
            self.met.pop(c, None)
        self.met.update((c, i) for c, i in fresh.items() if len(c) <= CACHED_BYTES)
        ids.update(again)
        ids.update(fresh)
        return [b"".join(map(ids.__getitem__, chunks)) for chunks in split]


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def balance(lengths: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pack documents of these lengths: ``(document, start, length, sequence, offset)`` of each piece.

    Documents longer than a sequence are first cut into full pieces and a rest.
    """
    total = int(lengths.sum())
    n = -(-total // capacity)
    room = np.full(n, capacity, dtype=np.int64)
    cost = np.zeros(n)
    out = []
    full = lengths // capacity
    next_sequence = int(full.sum())
    at = 0
    for i in np.flatnonzero(full):  # the longest pieces come first; each fills a sequence
        for k in range(full[i]):
            out.append((int(i), k * capacity, capacity, at, 0))
            at += 1
    room[:next_sequence] = 0
    cost[:next_sequence] = np.inf
    rest = lengths - full * capacity
    for i in np.argsort(-rest, kind="stable"):
        start, left = int(full[i]) * capacity, int(rest[i])
        while left:
            fits = room >= left
            if fits.any():
                s, take = int(np.where(fits, cost, np.inf).argmin()), left
            else:
                s = int(np.where(room > 0, cost, np.inf).argmin())
                take = int(room[s])
            out.append((int(i), start, take, s, int(capacity - room[s])))
            room[s] -= take
            cost[s] = cost[s] + LINEAR * take + QUADRATIC * take * take
            start, left = start + take, left - take
    return out


def _emit(ids: list, docs: list[bytes], first: int, capacity: int) -> tuple[pa.RecordBatch, int]:
    lengths = np.array([len(d) // 4 for d in docs], dtype=np.int64)
    pieces = balance(lengths, capacity)
    columns = list(zip(*pieces))
    index = np.array(columns[0])
    arrays = [
        pa.array([ids[i] for i in columns[0]], pa.int64()),
        pa.array(columns[1], pa.int64()),
        pa.array(columns[2], pa.int64()),
        pa.array([docs[i][4 * s : 4 * (s + n)] for i, s, n, _, _ in pieces], pa.binary()),
        pa.array(lengths[index], pa.int64()),
        pa.array(np.array(columns[3]) + first, pa.int64()),
        pa.array(columns[4], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=PIECES.names), first + int(-(-lengths.sum() // capacity))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = SEQUENCE_TOKENS, window: int = WINDOW) -> DataFrame:
    """Pieces of the tokenised ``docs(doc_id, text)``, as PIECES; ``ids`` holds little-endian 32-bit ids.

    Each document gets ``END_ID`` after its ids, so an empty or null text is a
    piece of one token. Repeated rows and null ids are packed like any other row;
    other columns are not read. An empty table gives no pieces. A text longer
    than a window is a window of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        sequence = TaskContext.get().partitionId() << 40
        end = np.array([END_ID], dtype="<u4").tobytes()
        ids: list = []
        kept: list[bytes] = []
        held = 0
        for batch in slices(batches, "text"):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            for doc_id, encoded in zip(batch.column("doc_id").to_pylist(), encode(texts)):
                ids.append(doc_id)
                kept.append(encoded + end)
                held += len(encoded) // 4 + 1
                if held >= window:
                    out, sequence = _emit(ids, kept, sequence, capacity)
                    yield out
                    ids, kept, held = [], [], 0
        if kept:
            yield _emit(ids, kept, sequence, capacity)[0]

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)
