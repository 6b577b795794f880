"""Reports as ordered lines: sections of bullets and tables, joined to Markdown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an empty section says.
NONE = "- None"


def citations(numbers: Column) -> Column:
    """``[1][2]`` of an array of numbers."""
    return F.array_join(F.transform(numbers, lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), "")


def table_row(*cells: Column) -> Column:
    """Cells of a pipe table."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[c.cast("string") for c in cells]), F.lit(" |"))


def render(reports: DataFrame, sections: list[tuple[str, list[str], DataFrame | None]]) -> DataFrame:
    """``report, markdown, n_lines`` for ``reports(report, head array<string>)`` and sections ``(title, lines before its own, rows(report, at, line))``.

    A title may say its level by hashes of its own; a section of no rows at all (None) is a heading over those that follow. Sections come in the order given; their lines by ``at``. One without lines says that there are none, without what would come before its
    lines. Lines are short and few for each report, as what they list has been cut to the report's own limits before.
    """
    names = [t for t, _, _ in sections]
    rows = reduce(DataFrame.union, [d.select("report", F.lit(i).alias("section"), F.struct(F.col("at").cast("long").alias("at"), "line").alias("line")) for i, (_, _, d) in enumerate(sections) if d is not None])
    held = rows.groupBy(F.col("report").alias("r"), "section").agg(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["line"]).alias("lines"))
    by_report = held.groupBy("r").agg(F.map_from_entries(F.collect_list(F.struct("section", "lines"))).alias("lines"))
    joined = reports.join(by_report, F.col("report") == F.col("r"), "left")
    parts = [F.col("head")]
    for i, name in enumerate(names):
        own = F.try_element_at("lines", F.lit(i))
        before = F.array(*map(F.lit, sections[i][1])) if sections[i][1] else F.array().cast("array<string>")
        title = F.array(F.lit(name if name.startswith("#") else f"## {name}"), F.lit(""))
        if sections[i][2] is None:
            parts.append(title)
            continue
        parts.append(F.concat(title, F.when(own.isNull(), F.array(F.lit(NONE))).otherwise(F.concat(before, own)), F.array(F.lit(""))))
    every = F.flatten(F.array(*parts))
    return joined.select("report", every.alias("every")).select("report", F.concat(F.rtrim(F.array_join("every", "\n"), F.lit("\n")), F.lit("\n")).alias("markdown"), (F.size("every") - 1).cast("long").alias("n_lines"))
