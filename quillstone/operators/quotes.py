"""Quotes found again in their nodes, with what stands around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points of context on either side.
AROUND = 32


def grounded(quotes: DataFrame, nodes: DataFrame) -> DataFrame:
    """``quote, status, start_char, end_char, prefix, suffix`` of each of ``quotes(quote, node, exact, start)`` in ``nodes(node, begin, text)``.

    ``start`` is where the quote is said to begin in its node, or null. With it the text there must be the quote's (``mismatch`` else); without, the quote must
    occur just once (``missing`` or ``ambiguous`` else). Spans are those of the document: a node begins there at ``begin``. Contexts are AROUND code points,
    and end with the node. An empty or null quote is ``empty``; a node that isn't there is ``unknown_node``. Spans and contexts are null unless ``grounded``.
    """
    known = nodes.select(F.col("node").alias("n_node"), "begin", "text")
    met = quotes.join(known, F.col("node") == F.col("n_node"), "left")
    size = F.length("exact")
    first = F.position(F.col("exact"), F.col("text"))
    again = F.position(F.col("exact"), F.substring(F.col("text"), first + 1, F.length("text")))  # overlapping occurrences count too
    at = F.coalesce("start", (first - 1).cast("long"))
    there = F.substring(F.col("text"), (at + 1).cast("int"), size) == F.col("exact")
    status = (
        F.when(F.coalesce(size, F.lit(0)) == 0, "empty")
        .when(F.col("n_node").isNull(), "unknown_node")
        .when(F.col("start").isNotNull(), F.when((F.col("start") >= 0) & F.coalesce(there, F.lit(False)), "grounded").otherwise("mismatch"))
        .when(F.coalesce(first, F.lit(0)) == 0, "missing")
        .when(again > 0, "ambiguous")
        .otherwise("grounded")
    )
    rows = met.withColumns({"status": status, "at": at})
    good = lambda c: F.when(F.col("status") == "grounded", c)
    lead = F.greatest(F.col("at") - AROUND, F.lit(0))
    prefix = F.substring(F.col("text"), (lead + 1).cast("int"), (F.col("at") - lead).cast("int"))
    suffix = F.substring(F.col("text"), (F.col("at") + size + 1).cast("int"), F.lit(AROUND))
    return rows.select("quote", "status", good(F.col("begin") + F.col("at")).alias("start_char"), good(F.col("begin") + F.col("at") + size).alias("end_char"), good(prefix).alias("prefix"), good(suffix).alias("suffix"))
