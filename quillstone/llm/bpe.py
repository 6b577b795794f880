"""Token counts by byte-pair merging with a heap and a linked list.

Every pre-token starts as its bytes. A heap holds the adjacent pairs that have
a merge rank; the pair of lowest rank (then leftmost) is popped and merged,
and the pairs around it are pushed again. A count is the initial symbols minus
the merges made; token ids are never looked up.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from quillstone.llm.wordkernel import slices

LIMIT = 2048
CACHED_BYTES = 64
CACHED_CHUNKS = 1_000_000

COUNTS = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_bytes", "n_tokens")])


class HeapCounter:
    """Counts the tokens of texts for a byte-level BPE file that drops white space and marks word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        # What letters are, and how they are lower-cased, is for the file's own rules to say: other libraries have other versions of Unicode.
        rules = Tokenizer.from_file(path)
        self.normal, self.cut = rules.normalizer, rules.pre_tokenizer
        self.special = sorted((t["content"] for t in spec["added_tokens"] if t["special"]), key=len, reverse=True)
        self.specials = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.known: dict[bytes, int] = {}

    def merged(self, symbols: list[str]) -> int:
        """How many symbols are left of these when no pair can be merged any more."""
        n = len(symbols)
        rank = self.rank
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(rank[p], i, p) for i in range(n - 1) if (p := (symbols[i], symbols[i + 1])) in rank]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, (a, b) = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has been merged with another since
            symbols[i], symbols[j] = a + b, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            merges += 1
            for left in (before[i], i):
                if left >= 0 and after[left] < n and (p := (symbols[left], symbols[after[left]])) in rank:
                    heapq.heappush(heap, (rank[p], left, p))
        return n - merges

    def _plain(self, text: str) -> int:
        count = 0
        for piece, _ in self.cut.pre_tokenize_str(self.normal.normalize_str(text)):
            symbols = list(piece)  # one letter for each byte
            symbols[-1] += self.suffix
            count += self.merged(symbols)
        return count

    def chunk(self, raw: bytes) -> int:
        """Tokens of a run without ASCII blanks. Special tokens' strings count as one token each."""
        text = raw.decode()
        if self.specials is None:
            return self._plain(text)
        return sum(map(self._plain, self.specials.split(text))) + len(self.specials.findall(text))

    def count(self, raw: bytes) -> int:
        """Tokens of a text."""
        known, total = self.known, 0
        for c in raw.split():
            n = known.get(c)
            if n is None:
                n = self.chunk(c)
                if len(c) <= CACHED_BYTES:
                    if len(known) >= CACHED_CHUNKS:
                        known.clear()
                    known[c] = n
            total += n
        return total


_counters: dict[str, HeapCounter] = {}


def counter(path: str) -> HeapCounter:
    if path not in _counters:
        _counters[path] = HeapCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of each row of ``docs(doc_id, text)``.

    Null and empty texts have none of either. Repeated rows are counted row by
    row; an empty table gives an empty result; other columns are not read.
    Texts are counted whole, whatever their length: only recurring runs
    between blanks are remembered, up to ``CACHED_CHUNKS`` of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path).count
        for batch in slices(batches, "text"):
            raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(map(len, raw), pa.int64()), pa.array(map(count, raw), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=COUNTS.names)

    return docs.select("doc_id", "text").mapInArrow(run, COUNTS)
