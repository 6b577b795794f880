"""Grids of cells with their headers, and boxes on pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.operators import geometry, graph, grids
from quillstone.registry import query
from quillstone.sources.tables import table

# Each order is a table: two rows of column headers, of which the first spans, and a row for each line with the part as its header.
_HEADS = [("c-0-0", 0, 0, 2, 1, "part"), ("c-0-1", 0, 1, 1, 2, "amounts"), ("c-0-3", 0, 3, 1, 2, "rates"), ("c-1-1", 1, 1, 1, 1, "quantity"), ("c-1-2", 1, 2, 1, 1, "price"), ("c-1-3", 1, 3, 1, 1, "discount"), ("c-1-4", 1, 4, 1, 1, "tax")]
_VALUES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

_CELLS = f"""WITH l AS (SELECT l_orderkey AS table_id, CAST(l_linenumber + 1 AS BIGINT) AS r, min(l_partkey) AS part, {", ".join(f"min({v}) AS v{i}" for i, v in enumerate(_VALUES))} FROM lineitem GROUP BY 1, 2),
cells AS MATERIALIZED (
SELECT table_id, 'c-' || r || '-0' AS cell, r, 0 AS c, 1 AS rs, 1 AS cs, true AS rh, false AS ch, 'part ' || part AS text FROM l
{" ".join(f"UNION ALL SELECT table_id, 'c-' || r || '-{i + 1}', r, {i + 1}, 1, 1, false, false, CASE WHEN v{i} <> 0 THEN 'value' END FROM l" for i in range(4))}
{" ".join(f"UNION ALL SELECT DISTINCT table_id, '{cell}', {r}, {c}, {rs}, {cs}, false, true, '{text}' FROM l" for cell, r, c, rs, cs, text in _HEADS)}),
heads AS (SELECT x.table_id, x.cell, list(h.cell ORDER BY h.c, h.cell) FILTER (h.rh AND h.r <= x.r AND x.r < h.r + h.rs AND h.c < x.c) AS row_headers,
 list(h.cell ORDER BY h.r, h.cell) FILTER (h.ch AND h.r < x.r AND h.c <= x.c AND x.c < h.c + h.cs) AS column_headers,
 count(*) FILTER (((h.rh AND h.r <= x.r AND x.r < h.r + h.rs AND h.c < x.c) OR (h.ch AND h.r < x.r AND h.c <= x.c AND x.c < h.c + h.cs)) AND coalesce(trim(h.text), '') = '') AS mute
 FROM cells x JOIN cells h ON h.table_id = x.table_id AND (h.rh OR h.ch) GROUP BY 1, 2)"""


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    """The cells of all tables, dealt by table while they are lines yet: what follows for each table, row or column stays in its task."""
    # Of values only the sign counts, and the least value's sign is the least sign.
    sign = lambda v: F.when(F.col(v) > 0, 1).when(F.col(v) < 0, -1).when(F.col(v) == 0, 0).cast("byte").alias(v)
    given = table(spark, sf, "lineitem")
    rows = given.select(F.col("l_orderkey").alias("table"), (F.col("l_linenumber") + 1).cast("long").alias("r"), F.col("l_partkey").alias("part"), *map(sign, _VALUES))
    n_cells = given.count() * (1 + len(_VALUES) + len(_HEADS))
    lines = graph.dealt(rows, n_cells, "table").groupBy("table", "r").agg(F.min("part").alias("part"), *[F.min(v).alias(v) for v in _VALUES])
    lines = lines.withColumn("first", F.row_number().over(Window.partitionBy("table").orderBy("r")) == 1)

    def cell(name: Column, row: Column, column: int, spans: tuple[int, int], heads: tuple[bool, bool], text: Column) -> Column:
        values = (name, row.cast("long"), F.lit(column).cast("long"), F.lit(spans[0]), F.lit(spans[1]), F.lit(heads[0]), F.lit(heads[1]), text)
        return F.struct(*[v.alias(n) for v, n in zip(values, ("cell", "row", "column", "row_span", "column_span", "is_row_header", "is_column_header", "text"))])

    name = lambda i: F.concat(F.lit("c-"), F.col("r"), F.lit(f"-{i}"))
    own = [cell(name(0), F.col("r"), 0, (1, 1), (True, False), F.concat(F.lit("part "), "part"))]
    own += [cell(name(i + 1), F.col("r"), i + 1, (1, 1), (False, False), F.when(F.col(v) != 0, "value")) for i, v in enumerate(_VALUES)]
    heads = [cell(F.lit(n), F.lit(r), c, (rs, cs), (False, True), F.lit(text)) for n, r, c, rs, cs, text in _HEADS]
    cells = F.when(F.col("first"), F.array(*own, *heads)).otherwise(F.array(*own))
    return lines.select("table", F.explode(cells).alias("x")).select("table", "x.*")


@query(f"{_CELLS} SELECT table_id, cell, coalesce(array_to_string(row_headers, ','), '') AS row_headers, coalesce(array_to_string(column_headers, ','), '') AS column_headers FROM heads")
def header_ancestry(spark: SparkSession, sf: str) -> DataFrame:
    """Row and column headers of each cell on grids with spanning headers."""
    return grids.headers(_cells(spark, sf)).select(F.col("table").alias("table_id"), "cell", F.array_join("row_headers", ",").alias("row_headers"), F.array_join("column_headers", ",").alias("column_headers"))


@query(f"""{_CELLS} SELECT cells.table_id, cells.cell, CASE WHEN coalesce(trim(text), '') = '' THEN 'table_cell_text_unavailable' WHEN rh OR ch THEN 'table_header_is_not_a_claim_value' WHEN row_headers IS NULL THEN 'missing_row_header_ancestry'
WHEN column_headers IS NULL THEN 'missing_column_header_ancestry' WHEN mute > 0 THEN 'table_header_text_unavailable' ELSE 'planned' END AS state FROM cells JOIN heads ON heads.table_id = cells.table_id AND heads.cell = cells.cell""")
def table_cell_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Which cells are planned as claims: those with a text and both headers."""
    return grids.cell_plan(_cells(spark, sf)).select(F.col("table").alias("table_id"), "cell", "state")


@query("""WITH t AS (SELECT l_orderkey AS table_id, max(l_linenumber) AS last FROM lineitem GROUP BY 1), r AS (SELECT table_id, unnest(range(1, last + 1)) AS line FROM t)
SELECT r.table_id, CAST(r.line - 1 AS BIGINT) AS r, 0::BIGINT AS c FROM r WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = r.table_id AND l_linenumber = r.line)""")
def grid_holes(spark: SparkSession, sf: str) -> DataFrame:
    """Line numbers that an order leaves out, as empty places of a grid of one column."""
    cells = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("table"), F.concat_ws("-", "l_linenumber", "l_partkey").alias("cell"), (F.col("l_linenumber") - 1).cast("long").alias("row"), F.lit(0).cast("long").alias("column"), F.lit(1).alias("row_span"), F.lit(1).alias("column_span"))
    return grids.holes(cells).select(F.col("table").alias("table_id"), "r", "c")


# Lines are boxes cropped from a page of their price and quantity by discount and tax, and turned by what became of them.
_TURNS = {"A": 0, "N": 90, "R": 180}
_TURN_SQL = "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 270 WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 90 ELSE 180 END"


@query(f"""WITH b AS (SELECT l_orderkey, l_linenumber, {_TURN_SQL} AS turn, l_extendedprice AS w, l_quantity AS h, l_extendedprice * l_discount AS x0, l_quantity * l_tax AS y0, l_extendedprice * (1 - l_tax) AS x1, l_quantity * (1 - l_discount) AS y1 FROM lineitem)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, turn, CASE WHEN turn IN (90, 270) THEN h ELSE w END AS width, CASE WHEN turn IN (90, 270) THEN w ELSE h END AS height,
round(CASE turn WHEN 0 THEN x0 WHEN 90 THEN y0 WHEN 180 THEN w - x1 ELSE h - y1 END, 6) AS left_edge, round(CASE turn WHEN 0 THEN h - y1 WHEN 90 THEN x0 WHEN 180 THEN y0 ELSE w - x1 END, 6) AS top_edge,
round(CASE turn WHEN 0 THEN x1 WHEN 90 THEN y1 WHEN 180 THEN w - x0 ELSE h - y0 END, 6) AS right_edge, round(CASE turn WHEN 0 THEN h - y0 WHEN 90 THEN x1 WHEN 180 THEN y1 ELSE w - x0 END, 6) AS bottom_edge FROM b""")
def page_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes as seen on the page once it is turned."""
    turn = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), 270)
    for flag, degrees in _TURNS.items():
        turn = turn.when(F.col("l_returnflag") == flag, degrees)
    zero, price, quantity = F.lit(0.0), F.col("l_extendedprice"), F.col("l_quantity")
    pdf = lambda left, bottom, right, top: F.struct(left.alias("left"), bottom.alias("bottom"), right.alias("right"), top.alias("top"))
    outer, inner = pdf(zero, zero, price, quantity), pdf(price * F.col("l_discount"), quantity * F.col("l_tax"), price * (1 - F.col("l_tax")), quantity * (1 - F.col("l_discount")))
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), turn.alias("turn"), geometry.turned(outer, inner, turn).alias("b"))
    edges = [F.round(f"b.{e}", 6).alias(f"{e}_edge") for e in ("left", "top", "right", "bottom")]
    return rows.select("l_orderkey", "line", "turn", "b.width", "b.height", *edges)


@query("""SELECT l_orderkey AS doc, CAST(l_linenumber AS BIGINT) AS region, CASE WHEN o_orderkey IS NULL THEN 'unknown_page' WHEN NOT l_quantity < 50 THEN 'page_size' WHEN NOT l_extendedprice * l_discount < l_extendedprice THEN 'not_a_box'
WHEN l_extendedprice - o_totalprice > 0.001 THEN 'outside_page' WHEN (l_linestatus = 'F') <> (o_orderstatus = 'F') THEN 'rotation' ELSE 'none' END AS issue
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderpriority <> '5-LOW'""")
def geometry_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as regions of their order's page: as wide as its total and 50 high, turned if it isn't finished; orders of low priority have no page."""
    turned = lambda c: F.when(F.col(c) == "F", 0).otherwise(90)
    zero, one = F.lit(0.0), F.lit(1)
    pages = table(spark, sf, "orders").where("o_orderpriority <> '5-LOW'").select(
        F.col("o_orderkey").alias("doc"), one.alias("page"), F.lit(1.0).alias("width"), F.lit(50.0).alias("height"), zero.alias("crop_left"), zero.alias("crop_top"), F.col("o_totalprice").alias("crop_right"), F.lit(50.0).alias("crop_bottom"), turned("o_orderstatus").alias("rotation")
    )
    regions = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("region"), one.alias("page"), F.lit(1.0).alias("page_width"), F.when(F.col("l_quantity") < 50, 50.0).otherwise(51.0).alias("page_height"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("left"), zero.alias("top"), F.col("l_extendedprice").alias("right"), F.col("l_quantity").alias("bottom"), turned("l_linestatus").alias("rotation"),
    )
    return geometry.region_issues(regions, pages)


@query("""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, p_partkey IS NOT NULL AND abs(l_extendedprice / l_quantity - p_retailprice) <= 0.001 AS agrees FROM lineitem LEFT JOIN part ON p_partkey = l_partkey""")
def geometry_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    """Whether two sizes of one thing agree within a tolerance: a line's price by quantity and its part's."""
    parts = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    rows = table(spark, sf, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
    return rows.select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), geometry.agrees(F.col("l_extendedprice") / F.col("l_quantity"), F.col("p_retailprice")).alias("agrees"))
