"""Boxes on turned pages, and grids of spanning cells."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillstone.operators import geometry, grids

BOXES = "name string, left double, bottom double, right double, top double, rotation int"


@pytest.mark.parametrize(
    "rotation, want",
    [(0, (200, 300, 10, 250, 110, 280)), (90, (300, 200, 20, 10, 50, 110)), (180, (200, 300, 90, 20, 190, 50)), (270, (300, 200, 250, 90, 280, 190)), (45, None), (None, None)],
)
def test_boxes_on_turned_pages(spark, rotation, want):
    """A page of 200 by 300 whose corner is not at zero, and a box 10 from its left and 20 from its foot."""
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("left", "bottom", "right", "top"))])
    got = spark.range(1).select(geometry.turned(box(5, 7, 205, 307), box(15, 27, 115, 57), F.lit(rotation).cast("int")).alias("b")).first()["b"]
    assert (tuple(got) if got else None) == want


REGIONS = "doc string, region string, page int, page_width double, page_height double, left double, top double, right double, bottom double, rotation int"
PAGES = "doc string, page int, width double, height double, crop_left double, crop_top double, crop_right double, crop_bottom double, rotation int"


def test_regions_lie_on_their_page(spark):
    pages = spark.createDataFrame([("d", 1, 200.0, 300.0, 10.0, 10.0, 190.0, 290.0, 0), ("d", 2, 300.0, 200.0, 0.0, 0.0, 300.0, 200.0, 90), ("e", 1, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0, 0)], PAGES)
    good = [200.0, 300.0, 10.0, 10.0, 190.0, 290.0, 0]
    put = lambda **kw: [kw.get(n, v) for n, v in zip(("w", "h", "l", "t", "r", "b", "rot"), good)]
    rows = [("fits", 1, put()), ("nearly", 1, put(r=190.0005, w=200.0009)), ("out by 0.002", 1, put(r=190.002)), ("above", 1, put(t=9.9)), ("other page", 3, put()), ("size", 1, put(w=201.0)), ("thin", 1, put(r=10.0)), ("turned", 1, put(rot=90)), ("no edge", 1, put(l=None)), ("second", 2, [300.0, 200.0, 0.0, 0.0, 5.0, 5.0, 90])]
    regions = spark.createDataFrame([("d", n, p, *v) for n, p, v in rows], REGIONS)
    got = {r.region: r.issue for r in geometry.region_issues(regions, pages).collect()}
    assert got == {"fits": "none", "nearly": "none", "out by 0.002": "outside_page", "above": "outside_page", "other page": "unknown_page", "size": "page_size", "thin": "not_a_box", "turned": "rotation", "no edge": "not_a_box", "second": "none"}


def test_sizes_agree_within_a_tolerance(spark):
    rows = spark.createDataFrame([(1.0, 1.0005), (1.0, 1.002), (None, 1.0)], "a double, b double")
    assert [r[0] for r in rows.select(geometry.agrees(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    assert [r[0] for r in rows.select(geometry.scaled_pixels(F.lit(2.25), F.lit(2.0))).collect()] == [5] * 3


CELLS = 'table string, cell string, row int, column int, row_span int, column_span int, is_row_header boolean, is_column_header boolean, text string'


@pytest.fixture
def cells(spark):
    """Years over halves, regions over towns: two levels of spanning headers on either axis, and an empty corner."""
    h = lambda name, r, c, rs, cs, row, col, text: ("t", name, r, c, rs, cs, row, col, text)
    rows = [
        h("2023", 0, 2, 1, 2, False, True, "2023"), h("2024", 0, 4, 1, 2, False, True, "2024"), *[h(f"h{i}", 1, 2 + i, 1, 1, False, True, f"half {i % 2}") for i in range(4)],
        h("north", 2, 0, 2, 1, True, False, "North"), h("a", 2, 1, 1, 1, True, False, "A"), h("b", 3, 1, 1, 1, True, False, " "), h("south", 4, 0, 1, 2, True, False, "South"),
        h("n-a", 2, 2, 1, 1, False, False, "1"), h("n-b", 3, 5, 1, 1, False, False, "2"), h("s", 4, 3, 1, 1, False, False, "3"), h("blank", 4, 4, 1, 1, False, False, None), h("wide", 4, 5, None, 0, False, False, "5"),
        ("u", "lone", 0, 0, 1, 1, False, False, "x"), ("u", "side", 1, 0, 1, 1, True, False, "y"), ("u", "right", 1, 1, 1, 1, False, False, "z"),
    ]
    return spark.createDataFrame(rows, CELLS)


def test_header_ancestry(cells):
    got = {(r.table, r.cell): (r.row_headers, r.column_headers) for r in grids.headers(cells).collect()}
    assert got["t", "n-a"] == (["north", "a"], ["2023", "h0"]) and got["t", "n-b"] == (["north", "b"], ["2024", "h3"])
    assert got["t", "s"] == (["south"], ["2023", "h1"]) and got["t", "wide"] == (["south"], ["2024", "h3"])
    assert got["t", "h3"] == ([], ["2024"]) and got["t", "a"] == (["north"], []) and got["u", "lone"] == ([], []) and got["u", "right"] == (["side"], [])
    assert len(got) == cells.count()


def test_cells_are_planned_with_both_headers(cells):
    got = {(r.table, r.cell): r.state for r in grids.cell_plan(cells).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "t" and k[1] in ("n-a", "n-b", "s", "blank", "north", "wide", "b")} == {
        "n-a": "planned", "n-b": "table_header_text_unavailable", "s": "planned", "blank": "table_cell_text_unavailable", "north": "table_header_is_not_a_claim_value", "wide": "planned", "b": "table_cell_text_unavailable"
    }
    assert got["u", "lone"] == "missing_row_header_ancestry" and got["u", "right"] == "missing_column_header_ancestry"


def test_places_overlaps_and_holes(spark, cells):
    assert grids.overlaps(cells).isEmpty()
    more = cells.union(spark.createDataFrame([("t", "over", 3, 1, 2, 2, False, False, "")], CELLS))
    assert {(r.r, r.c, r.n) for r in grids.overlaps(more).collect()} == {(3, 1, 2), (4, 1, 2)}
    assert {(r.r, r.c) for r in grids.holes(cells).where("table = 't'").collect()} == {(0, 0), (0, 1), (1, 0), (1, 1), (2, 3), (2, 4), (2, 5), (3, 2), (3, 3), (3, 4), (4, 2)}
    assert {(r.r, r.c) for r in grids.holes(cells).where("table = 'u'").collect()} == {(0, 1)}
    fragments = spark.createDataFrame([("t", 0, "h", False, True), ("t", 1, "h2", False, True), ("t", 1, "v", False, False)], "table string, fragment int, cell string, is_row_header boolean, is_column_header boolean")
    assert [r.cell for r in grids.repeated_headers(fragments).collect()] == ["h2"]
