"""Reports: sections with and without lines, and headings over others."""

from __future__ import annotations

from quillstone.operators import report


def test_sections(spark):
    reports = spark.createDataFrame([("r", ["# R", ""]), ("s", ["# S", ""])], "report string, head array<string>")
    lines = lambda *rows: spark.createDataFrame(list(rows), "report string, at int, line string")
    out = report.render(reports, [("One", [], lines(("r", 2, "- b"), ("r", 1, "- a"))), ("Appendix", [], None), ("### Table", ["| x |", "|---|"], lines(("s", 1, "| 1 |")))])
    got = {r.report: (r.markdown, r.n_lines) for r in out.collect()}
    assert got["r"][0] == "# R\n\n## One\n\n- a\n- b\n\n## Appendix\n\n### Table\n\n- None\n"
    assert got["s"][0] == "# S\n\n## One\n\n- None\n\n## Appendix\n\n### Table\n\n| x |\n|---|\n| 1 |\n"
    assert all(n == text.count("\n") for text, n in got.values())
