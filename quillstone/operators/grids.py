"""Tables as grids of spanning cells: places, overlaps, holes, headers and what may be planned.

A cell is ``table, cell, row, column, row_span, column_span, is_row_header, is_column_header, text``. Spans become rows of places by
``explode``, so cells meet their headers within a table's row or column, and never all cells of a table with all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _along(start: str, span: str) -> Column:
    """The places of a cell along one axis; a span under one is one."""
    return F.explode(F.sequence(F.col(start), F.col(start) + F.greatest(F.coalesce(span, F.lit(1)), F.lit(1)) - 1))


def places(cells: DataFrame) -> DataFrame:
    """``table, cell, r, c``: each place of the grid that each cell takes."""
    rows = cells.select("table", "cell", "column", "column_span", _along("row", "row_span").alias("r"))
    return rows.select("table", "cell", "r", _along("column", "column_span").alias("c"))


def overlaps(cells: DataFrame) -> DataFrame:
    """``table, r, c, n``: places that several cells take."""
    return places(cells).groupBy("table", "r", "c").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def holes(cells: DataFrame) -> DataFrame:
    """``table, r, c``: places that no cell takes, within the rows and columns from 0 up to a table's last ones."""
    taken = places(cells).select("table", "r", "c").distinct()
    size = taken.groupBy("table").agg(F.max("r").alias("last_r"), F.max("c").alias("last_c"))
    zero = F.lit(0)
    all_ = size.select("table", F.explode(F.sequence(zero.cast("long"), F.col("last_r").cast("long"))).alias("r"), "last_c").select("table", "r", F.explode(F.sequence(zero.cast("long"), F.col("last_c").cast("long"))).alias("c"))
    return all_.join(taken, ["table", "r", "c"], "left_anti")


def headers(cells: DataFrame) -> DataFrame:
    """``table, cell, row_headers, column_headers`` of each cell: the ids of its headers from the outermost in.

    A row header of a cell spans the row in which the cell begins and begins to the left of it; a column header spans the
    column in which it begins and begins above. A header may have headers too. Cells without headers have empty arrays.
    """
    ids = lambda c: F.transform(c, lambda h: h["cell"]).alias(c)
    return _with_headers(cells).select("table", "cell", ids("row_headers"), ids("column_headers"))


def _with_headers(cells: DataFrame) -> DataFrame:
    """``cells`` with ``has_text``, and structs ``at, cell, has_text`` of their ``row_headers`` and ``column_headers`` in order.

    Headers stand beside the cells in each row, and then each column, that they span, and a cell takes those that begin before it by a running list: cells
    are put in order twice, and joined with nothing.
    """
    rows = cells.withColumn("has_text", F.coalesce(F.trim("text") != "", F.lit(False)))
    for is_header, at, span, other, name in (("is_row_header", "row", "row_span", "column", "row_headers"), ("is_column_header", "column", "column_span", "row", "column_headers")):
        # A header's own row has its first place; others, of the rest of its span, only bring it there.
        further = F.sequence(F.col(at) + 1, F.col(at) + F.col(span) - 1)
        places = F.when(F.col(is_header) & (F.col(span) > 1), F.concat(F.array(F.col(at)), further)).otherwise(F.array(F.col(at)))
        spread = rows.withColumn("__begins", F.col(at)).withColumn("__at", F.explode_outer(places))
        own = F.when(F.col(is_header), F.struct(F.col(other).alias("at"), "cell", "has_text"))
        before = Window.partitionBy("table", "__at").orderBy(other).rangeBetween(Window.unboundedPreceding, -1)
        listed = F.array_sort(F.collect_list(own).over(before))
        rows = spread.withColumn(name, listed).where(F.col("__at").eqNullSafe(F.col("__begins"))).drop("__at", "__begins")
    return rows


def repeated_headers(fragments: DataFrame) -> DataFrame:
    """Those header cells of ``fragments(table, fragment, cell, is_row_header, is_column_header)`` that a later fragment of a table says again."""
    return fragments.where("fragment > 0 and (is_row_header or is_column_header)").select("table", "fragment", "cell")


#: Why a cell is not planned, in the order in which reasons are looked for.
BLOCKED = ("table_cell_text_unavailable", "table_header_is_not_a_claim_value", "missing_row_header_ancestry", "missing_column_header_ancestry", "table_header_text_unavailable")


def cell_plan(cells: DataFrame) -> DataFrame:
    """``table, cell, state, row_headers, column_headers``: ``planned``, or the first reason of BLOCKED that a cell is not.

    A cell is planned as a claim only with its own text and with both its headers, all of which have texts. A blank text is none.
    """
    rows = _with_headers(cells)
    mute = F.exists(F.concat("row_headers", "column_headers"), lambda h: ~h["has_text"])
    reasons = (~F.col("has_text"), F.col("is_row_header") | F.col("is_column_header"), F.size("row_headers") == 0, F.size("column_headers") == 0, mute)
    state = F.lit("planned")
    for reason, holds in reversed(list(zip(BLOCKED, reasons))):
        state = F.when(holds, reason).otherwise(state)
    ids = lambda c: F.transform(c, lambda h: h["cell"]).alias(c)
    return rows.select("table", "cell", state.alias("state"), ids("row_headers"), ids("column_headers"))
