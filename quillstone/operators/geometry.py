"""Boxes on pages: turned to the page as it is read, and held against the page they lie on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How far sizes may be apart and still agree.
TOLERANCE = 0.001
ROTATIONS = (0, 90, 180, 270)


def box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """A box as a struct."""
    return F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))


def _quarter(page: dict[str, Column]) -> dict[str, Column]:
    """A page and a box on it after a quarter turn clockwise: what was at the foot comes to the left, and what was at the left on top."""
    return {"width": page["height"], "height": page["width"], "left": page["height"] - page["bottom"], "top": page["left"], "right": page["height"] - page["top"], "bottom": page["right"]}


def turned(outer: Column, inner: Column, rotation: Column) -> Column:
    """``inner`` as seen on the turned page ``outer``: ``struct<width, height, left, top, right, bottom>``, from the page's upper left corner, downwards.

    Both boxes are as files have them: ``left, bottom, right, top`` in points, upwards from any corner. The page is turned clockwise by ``rotation``
    degrees, quarter by quarter; other turns give null.
    """
    page = {"width": outer["right"] - outer["left"], "height": outer["top"] - outer["bottom"]}
    page |= {side: inner[side] - outer["left"] for side in ("left", "right")} | {"top": outer["top"] - inner["top"], "bottom": outer["top"] - inner["bottom"]}
    out = F.lit(None)
    for degrees in ROTATIONS:
        out = F.when(rotation == degrees, F.struct(*[page[n].alias(n) for n in ("width", "height", "left", "top", "right", "bottom")])).otherwise(out)
        page = _quarter(page)
    return out


def agrees(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """Whether two sizes are the same within a tolerance; one that is missing agrees with nothing."""
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def scaled_pixels(edge: Column, scale: Column) -> Column:
    """An edge in pixels, halves upwards."""
    return F.floor(edge * scale + 0.5).cast("long")


#: The rules for regions, in the order in which the first broken one is told.
RULES = ("unknown_page", "page_size", "not_a_box", "outside_page", "rotation")


def region_issues(regions: DataFrame, pages: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``doc, region, issue`` of each of ``regions``: the first of RULES that it breaks, or ``none``.

    ``regions(doc, region, page, page_width, page_height, left, top, right, bottom, rotation)`` are joined with
    ``pages(doc, page, width, height, crop_left, crop_top, crop_right, crop_bottom, rotation)`` by document and page. A region may go beyond the crop
    box, and sizes may differ, by ``tolerance``. Missing numbers break the rule that reads them.
    """
    known = pages.select(*[F.col(c).alias(f"p_{c}") for c in pages.columns])
    rows = regions.join(known, (F.col("doc") == F.col("p_doc")) & (F.col("page") == F.col("p_page")), "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    inside = F.lit(True)
    for edge, sign in (("left", 1), ("top", 1), ("right", -1), ("bottom", -1)):
        inside = inside & (sign * (F.col(edge) - F.col(f"p_crop_{edge}")) >= -tolerance)
    broken = {
        "unknown_page": F.col("p_page").isNull(),
        "page_size": ~(agrees(F.col("page_width"), F.col("p_width"), tolerance) & agrees(F.col("page_height"), F.col("p_height"), tolerance)),
        "not_a_box": no((F.col("left") < F.col("right")) & (F.col("top") < F.col("bottom"))),
        "outside_page": no(inside),
        "rotation": no(F.col("rotation") == F.col("p_rotation")),
    }
    issue = F.lit("none")
    for rule in reversed(RULES):
        issue = F.when(broken[rule], rule).otherwise(issue)
    return rows.select("doc", "region", issue.alias("issue"))
