"""Vector columns: which rows can be used, and their numbers as matrices inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there, without null or non-finite entries."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))


def dimension(vectors: DataFrame, column: str) -> tuple[int, int]:
    """The commonest length of the vectors (of equally common ones the greatest), and how many have it; (0, 0) of no rows."""
    size = F.size(column).alias("size")
    first = vectors.groupBy(size).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return (first["size"], first["n"]) if first else (0, 0)


def matrix(col: pa.Array, width: int) -> np.ndarray:
    """The vectors of a column as rows of doubles."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), width)


#: Numbers of a matrix that are held at once.
MOST_NUMBERS = 2_000_000


def pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the vectors of each piece have a bounded number of entries."""
    rows = max(1, MOST_NUMBERS // width)
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
