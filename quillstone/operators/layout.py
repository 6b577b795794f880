"""Reading order of laid-out pages, and references between the nodes of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.graph import dealt

#: Items whose left edges are further apart than this share of the page's width are in different columns.
COLUMN_GAP = 0.15


def reading_order(items: DataFrame) -> DataFrame:
    """``items(page, item, kind, top_edge, left_edge, width, height)`` with their ``place`` on the page, from 0.

    Furniture of the upper half comes first and that of the lower half last. In between, a heading
    ends a segment: what begins from the last heading's top on, and above this one's, comes before it. What lies above the first heading that
    is no lower, or below all, is the last segment. A segment is read column by column; columns part where left edges leave a gap.
    """
    furniture = F.col("kind") == "furniture"
    zone = F.when(furniture & (F.col("top_edge") < F.col("height") / 2), 0).when(furniture, 2).otherwise(1).cast("byte")
    heading = F.coalesce(F.col("kind") == "heading", F.lit(False))
    # Every sort holds the rows, so they are made narrow first, and dealt by their number.
    rows = items.select("page", "item", "top_edge", "left_edge", (COLUMN_GAP * F.col("width")).alias("gap"), zone.alias("zone"), heading.alias("heading"))
    rows = dealt(rows, items.count(), "page")
    # Headings above or level with an item, as those of one height come first; a heading itself comes last in the segment that it ends.
    down = Window.partitionBy("page").orderBy("zone", "top_edge", F.desc("heading"), "left_edge", "item").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    body_zone = F.col("zone") == 1
    rows = rows.withColumn("segment", F.when(body_zone, F.count_if("heading").over(down) - F.col("heading").cast("int")).otherwise(F.lit(0)).cast("int"))
    body = Window.partitionBy("page", "zone", "segment", "heading").orderBy("left_edge", "item")
    rows = rows.withColumn("opens", F.coalesce((F.col("left_edge") - F.lag("left_edge").over(body) > F.col("gap")).cast("int"), F.lit(0))).drop("gap")
    column = F.when(body_zone & ~F.col("heading"), F.sum("opens").over(body.rowsBetween(Window.unboundedPreceding, Window.currentRow))).otherwise(F.lit(0))
    rows = rows.withColumn("column", column.cast("int")).drop("opens")
    order = Window.partitionBy("page").orderBy("zone", "segment", "heading", "column", "top_edge", "left_edge", "item")
    return rows.withColumn("place", (F.row_number().over(order) - 1).cast("long")).select("page", "item", "place")


def columns(items: DataFrame) -> DataFrame:
    """``page, item, column, place`` of ``items(page, item, left_edge, top_edge, width)``: columns from 0, which part where left edges leave a gap, and places from 0 within each, from the top."""
    w = Window.partitionBy("page").orderBy("left_edge", "item")
    opens = F.when(F.col("left_edge") - F.lag("left_edge").over(w) > COLUMN_GAP * F.col("width"), 1).otherwise(0)
    rows = items.withColumn("opens", opens).withColumn("column", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    place = F.row_number().over(Window.partitionBy("page", "column").orderBy("top_edge", "left_edge", "item")) - 1
    return rows.select("page", "item", F.col("column").cast("long").alias("column"), place.cast("long").alias("place"))


def heading_levels(items: DataFrame) -> DataFrame:
    """``doc, item, level`` of the headings of ``items(doc, item, kind, text_height, declared)``.

    If a document declares several levels these stand, and headings without one are of the first. Else levels are the ranks of the text
    heights to a tenth, from the tallest; headings without a height come last.
    """
    own = items.where("kind = 'heading'").withColumn("tall", F.round("text_height", 1))
    varied = own.groupBy(F.col("doc").alias("v_doc")).agg((F.min("declared") < F.max("declared")).alias("varied"))
    heights = own.select("doc", "tall").distinct()
    ranks = heights.withColumn("rank", F.dense_rank().over(Window.partitionBy("doc").orderBy(F.desc_nulls_last("tall")))).select(F.col("doc").alias("r_doc"), F.col("tall").alias("r_tall"), "rank")
    met = own.join(varied, F.col("doc") == F.col("v_doc")).join(ranks, (F.col("doc") == F.col("r_doc")) & F.col("tall").eqNullSafe(F.col("r_tall")))
    level = F.when(F.coalesce("varied", F.lit(False)), F.coalesce("declared", F.lit(1))).otherwise(F.col("rank"))
    return met.select("doc", "item", level.cast("long").alias("level"))


def cross_references(targets: DataFrame, markers: DataFrame) -> DataFrame:
    """Each marker tied to the nearest target of its label: ``targets(doc, label, node, order_index)``, ``markers(doc, label, node, order_index, start_char, end_char)``.

    A node never refers to itself; of two targets as near the one with the lesser node is taken. No marker meets all targets of its
    label: both are put in order of their places, and a running value from either side brings the nearest place with targets. Of each place the two least
    targets are kept, the second for markers that are the first themselves. Markers without a target are left out; null labels have none.
    """
    key = Window.partitionBy("doc", "label")
    place = Window.partitionBy("doc", "label", "order_index").orderBy("node")
    ranked = targets.where("doc is not null and label is not null").select("doc", "label", "order_index", "node").distinct().withColumn("n", F.row_number().over(place)).where("n <= 2")
    at = ranked.groupBy("doc", "label", "order_index").agg(F.min("node").alias("first"), F.max(F.when(F.col("n") == 2, F.col("node"))).alias("second"))
    held = at.select("doc", "label", "order_index", F.struct(F.col("order_index").alias("at"), "first", "second").alias("target"))
    own = markers.where("doc is not null and label is not null").select("doc", "label", "order_index", F.struct("node", "start_char", "end_char").alias("marker"))
    both = held.unionByName(own, allowMissingColumns=True)
    up, down = key.orderBy("order_index"), key.orderBy(F.desc("order_index"))
    ahead = (Window.unboundedPreceding, -1)
    near = both.select(
        "doc", "label", "order_index", "marker", F.last("target", ignorenulls=True).over(up.rangeBetween(*ahead)).alias("before"), F.last("target", ignorenulls=True).over(down.rangeBetween(*ahead)).alias("after"), F.max("target").over(up.rangeBetween(0, 0)).alias("here")
    ).where("marker is not null")
    itself = F.col("here")["first"] == F.col("marker")["node"]
    one = lambda distance, node: F.when(node.isNotNull(), F.struct(distance.alias("distance"), node.alias("node")))
    choices = [one(F.lit(0).cast("long"), F.when(itself, F.col("here")["second"]).otherwise(F.col("here")["first"]))]
    choices += [one(F.abs(F.col("order_index") - F.col(c)["at"]).cast("long"), F.col(c)["first"]) for c in ("before", "after")]
    found = near.select("doc", "label", "marker.*", F.array_min(F.filter(F.array(*choices), lambda x: x.isNotNull())).alias("near"))
    return found.where("near is not null").select("doc", "label", "node", "start_char", "end_char", F.col("near.node").alias("target"))
