"""Digests of sets of rows that are merged, not gathered, and of lists that are streamed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_digest(rows: DataFrame, by: list[str], digest: str) -> DataFrame:
    """The groups ``by`` with ``digest`` of the multiset of their rows' SHA-256 hex digests, whatever their order.

    Rows are dealt by the first two hex digits of their digest. A part is the sums of three 32-bit pieces and the count, which
    each task adds up before the shuffle; the final digest is over at most 256 parts in order. A group of any
    size comes to one bounded row.
    """
    piece = lambda at: F.sum(F.conv(F.substring(digest, at, 8), 16, 10).cast("long")).cast("string")
    parts = rows.groupBy(*by, F.substring(digest, 1, 2).alias("prefix")).agg(F.concat_ws("-", piece(3), piece(11), piece(19), F.count(F.lit(1)).cast("string")).alias("part"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("prefix", "part"))), lambda p: F.concat(p["prefix"], F.lit(":"), p["part"]))
    return parts.groupBy(*by).agg(F.sha2(F.array_join(listed, ","), 256).alias("digest"))


def list_digest(rows: DataFrame, by: str, item: str) -> DataFrame:
    """``by, n, digest``: the count of each group's rows, and the SHA-256 of its items as texts, in order and joined by commas; null without items.

    Rows are dealt by group and sorted, and each group is hashed as it streams by: SHA-256 goes through its input in order, so a group is read by one
    task, but only a batch of it is held at a time.
    """
    dealt = rows.select(by, F.col(item).cast("string").alias("item")).repartition(by).sortWithinPartitions(by, "item")
    return dealt.mapInArrow(_streamed, f"`{by}` {rows.schema[by].dataType.simpleString()}, n long, digest string")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, n, state, names, kind = None, 0, None, None, None

    def batch(done: list[tuple]) -> pa.RecordBatch:
        keys, counts, digests = zip(*done)
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], names)

    for rows in batches:
        kind, names, done = rows.schema.field(0).type, [rows.schema.names[0], "n", "digest"], []
        for own, item in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            if n and own != key:
                done.append((key, n, state and state.hexdigest()))
                n, state = 0, None
            key, n = own, n + 1
            if item is not None:
                if state is None:
                    state = hashlib.sha256(item.encode())
                else:
                    state.update(b"," + item.encode())
        if done:
            yield batch(done)
    if n:
        yield batch([(key, n, state and state.hexdigest())])
