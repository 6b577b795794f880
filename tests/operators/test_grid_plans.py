"""Headers are found without joins, whatever they span."""

from __future__ import annotations

import random

from quillstone.operators import grids

CELLS = "table long, cell string, row long, column long, row_span int, column_span int, is_row_header boolean, is_column_header boolean, text string"


def test_headers_without_joins_equal_all_pairs(spark):
    r = random.Random(3)
    rows = [(t, f"c{r_}-{c}", r_, c, r.choice([None, 0, 1, 2, 3]), r.choice([None, 0, 1, 2, 3]), r.random() < 0.3, r.random() < 0.3, r.choice(["x", " ", None])) for t in range(6) for r_ in range(6) for c in range(5) if r.random() < 0.9]
    cells = spark.createDataFrame(rows, CELLS)
    plan = grids.cell_plan(cells)
    assert "Join" not in plan._jdf.queryExecution().executedPlan().toString()
    span = lambda n: max(n or 1, 1)
    want = {}
    for t, cell, y, x, _, _, rh, ch, text in rows:
        own = [h for h in rows if h[0] == t]
        left = sorted((h for h in own if h[6] and h[2] <= y < h[2] + span(h[4]) and h[3] < x), key=lambda h: (h[3], h[1]))
        above = sorted((h for h in own if h[7] and h[3] <= x < h[3] + span(h[5]) and h[2] < y), key=lambda h: (h[2], h[1]))
        blank = lambda s: not (s or "").strip()
        reasons = [blank(text), rh or ch, not left, not above, any(blank(h[8]) for h in left + above)]
        state = next((name for name, holds in zip(grids.BLOCKED, reasons) if holds), "planned")
        want[t, cell] = (state, [h[1] for h in left], [h[1] for h in above])
    assert {(x.table, x.cell): (x.state, x.row_headers, x.column_headers) for x in plan.collect()} == want
    assert {(x.table, x.cell): (x.row_headers, x.column_headers) for x in grids.headers(cells).collect()} == {k: v[1:] for k, v in want.items()}
