"""A table's own columns kept apart from those that an operator adds, so that they may have any names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def wrapped(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as one struct ``own`` of plain names, beside their ``text`` and ``doc_id``."""
    own = F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    return docs.select(own.alias("own"), *[named(c) for c in ("doc_id", "text") if c in docs.columns])


def unwrapped(rows: DataFrame, columns: list[str], **instead: Column) -> DataFrame:
    """The columns of a table that was wrapped, in their order, some with other values."""
    return rows.select(*[instead.get(c, F.col("own")[f"c{i}"]).alias(c) for i, c in enumerate(columns)])
