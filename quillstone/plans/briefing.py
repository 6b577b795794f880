"""Briefings: what a supplier's claims amount to, as Markdown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions.text import confidence_label, record_id
from quillstone.operators import report
from quillstone.registry import query
from quillstone.sources.tables import ASSERTIONS_SQL, assertions, date_text

#: Bullets of a section.
MOST = 5
#: Claims that a judgment rests on.
BASIS = 2
HEADER = "| Scope | Claims | Objects |"
RULE = "|---|---:|---:|"
# The sections of a briefing and of its appendix, in order, with the heads of their tables.
CITED = ["| Number | Type | Summary | Confidence |", "|---:|---|---|---:|"]
TRACED = ["| Finding | Support | Relation | Confidence |", "|---|---|---|---:|"]
SECTIONS = [("Executive Judgment", []), ("What Changed", []), ("Judgment Basis", []), ("Evidence and Source Quality", [HEADER, RULE]), ("Open Questions and Collection Gaps", []), ("Indicators to Watch", []), ("Implications", []), ("Reference Appendix", []), ("### Citation Register", CITED), ("### Analytic Trace", TRACED), ("### Entity/Event Index", [])]
APPENDIX = 7

_LABEL = "CASE WHEN confidence >= 0.75 THEN 'High' WHEN confidence >= 0.5 THEN 'Moderate' ELSE 'Low' END"
_HEADS = ", ".join(f"({k}, '{t if t.startswith('#') else '## ' + t}', '{''.join(x + chr(10) for x in before)}')" for k, (t, before) in enumerate(SECTIONS))


@query(f"""WITH a AS (SELECT *, replace(scope, '_', ' ') AS label, {_LABEL} AS sure, row_number() OVER (PARTITION BY subject_id ORDER BY updated_at DESC, id, object_id) AS latest,
 row_number() OVER (PARTITION BY subject_id ORDER BY confidence DESC, id, object_id) AS best FROM ({ASSERTIONS_SQL})),
i AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY id, object_id) AS n FROM a WHERE scope = 'analytic_inference' AND confidence >= 0.75),
j AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY confidence DESC, id, object_id) AS n FROM a WHERE scope = 'analytic_inference'),
b AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY updated_at DESC, id, object_id) AS n FROM a WHERE scope <> 'analytic_inference'),
o AS (SELECT subject_id, object_id, count(*) AS k, row_number() OVER (PARTITION BY subject_id ORDER BY object_id) AS n FROM a GROUP BY 1, 2),
l AS (SELECT subject_id, 0 AS s, 0 AS pos, subject_id || ' and ' || object_id || ': ' || label || '.[1]' AS line FROM a WHERE best = 1
UNION ALL SELECT subject_id, 1, latest, '- ' || object_id || ' by ' || label || '.[' || latest || ']' FROM a WHERE latest <= {MOST}
UNION ALL SELECT subject_id, 2, x.pos, x.line FROM j, (VALUES (0, '- Source basis:'), (100, '- Observed effects:')) x(pos, line) WHERE n = 1
UNION ALL SELECT b.subject_id, 2, b.n, '  - ' || b.object_id || ' by ' || b.label || '.' FROM b JOIN j ON j.subject_id = b.subject_id AND j.n = 1 WHERE b.n <= {BASIS}
UNION ALL SELECT b.subject_id, 2, 100 + b.n, '  - ' || b.object_id || ' is ' || b.status || '.' FROM b JOIN j ON j.subject_id = b.subject_id AND j.n = 1 WHERE b.n <= {BASIS}
UNION ALL SELECT subject_id, 2, 200, '- Assessment: ' || subject_id || ' and ' || object_id || ': ' || label || '.' FROM j WHERE n = 1
UNION ALL SELECT subject_id, 2, 201, '- Confidence: ' || sure || '.' FROM j WHERE n = 1
UNION ALL SELECT subject_id, 3, ascii(scope) * 1000 + ascii(substr(scope, 2)), '| ' || any_value(label) || ' | ' || count(*) || ' | ' || count(DISTINCT object_id) || ' |' FROM a GROUP BY subject_id, scope
UNION ALL SELECT subject_id, 4, ascii(scope) * 1000 + ascii(substr(scope, 2)), '- ' || count(*) || ' of ' || any_value(label) || ' await review.' FROM a WHERE status = 'proposed' GROUP BY subject_id, scope
UNION ALL SELECT subject_id, 5, n, '- Watch ' || object_id || ' (' || id || ').' FROM i WHERE n <= {MOST}
UNION ALL SELECT subject_id, 6, n, '- ' || object_id || ' may involve ' || subject_id || '.' FROM i WHERE n <= {MOST}
UNION ALL SELECT subject_id, 8, latest, '| [' || latest || '] | ' || CASE WHEN scope = 'analytic_inference' THEN 'Analytic inference' ELSE 'Assertion' END || ' | ' || object_id || ' by ' || label || ' | ' || sure || ' |' FROM a WHERE latest <= {MOST}
UNION ALL SELECT subject_id, 9, n, '| ' || object_id || ' | ' || id || ' | infers | ' || sure || ' |' FROM j WHERE n <= {MOST}
UNION ALL SELECT subject_id, 10, n, '- ' || object_id || ': ' || k FROM o WHERE n <= {MOST}),
p AS (SELECT subject_id, s, string_agg(line, chr(10) ORDER BY pos, line) AS t FROM l GROUP BY 1, 2),
r AS (SELECT subject_id, min(updated_at) AS since, max(updated_at) AS upto FROM a GROUP BY 1),
m AS (SELECT subject_id, '# Briefing on ' || subject_id || chr(10) || chr(10) || 'Briefing ID: `brf_' || left(sha256('briefing:' || subject_id), 24) || '`' || chr(10) || 'Generated: `' || strftime(upto, '%Y-%m-%dT%H:%M:%SZ') || '`' || chr(10) || 'Previous Briefing: `none`' || chr(10) || chr(10)
 || (SELECT string_agg(title || chr(10) || chr(10) || CASE WHEN k = {APPENDIX} THEN '' WHEN p.t IS NULL THEN '- None' || chr(10) || chr(10) ELSE head || p.t || chr(10) || chr(10) END, '' ORDER BY k)
 FROM (VALUES {_HEADS}) v(k, title, head) LEFT JOIN p ON p.subject_id = r.subject_id AND p.s = k) AS whole FROM r),
t AS (SELECT subject_id, rtrim(whole, chr(10)) || chr(10) AS markdown FROM m)
SELECT subject_id AS report, markdown, CAST(length(markdown) - length(replace(markdown, chr(10), '')) AS BIGINT) AS n_lines FROM t""")
def briefing_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """A report for each subject in seven sections and an appendix: judgment, changes, basis, evidence, gaps, indicators and implications; citations, trace and index."""
    label = F.replace("scope", F.lit("_"), F.lit(" "))
    rows = assertions(spark, sf).withColumn("label", label)
    own = Window.partitionBy("subject_id")
    ranked = rows.withColumns({"latest": F.row_number().over(own.orderBy(F.desc("updated_at"), "id", "object_id")), "best": F.row_number().over(own.orderBy(F.desc("confidence"), "id", "object_id"))})
    line = lambda d, at, *parts: d.select(F.col("subject_id").alias("report"), at.alias("at"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("line"))
    c = F.col
    judgment = line(ranked.where("best = 1"), F.lit(0), c("subject_id"), " and ", c("object_id"), ": ", c("label"), ".", report.citations(F.array(c("best"))))
    changed = line(ranked.where(c("latest") <= MOST), c("latest"), "- ", c("object_id"), " by ", c("label"), ".", report.citations(F.array(c("latest"))))
    place = F.ascii("scope") * 1000 + F.ascii(F.substring("scope", 2, 1))
    scopes = rows.groupBy("subject_id", "scope", "label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("object_id").alias("objects"))
    quality = line(scopes, place, report.table_row(c("label"), c("n"), c("objects")))
    waiting = rows.where("status = 'proposed'").groupBy("subject_id", "scope", "label").agg(F.count(F.lit(1)).alias("n"))
    gaps = line(waiting, place, "- ", c("n").cast("string"), " of ", c("label"), " await review.")
    watched = rows.where("scope = 'analytic_inference' and confidence >= 0.75").withColumn("n", F.row_number().over(own.orderBy("id", "object_id"))).where(c("n") <= MOST)
    watch = line(watched, c("n"), "- Watch ", c("object_id"), " (", c("id"), ").")
    inferred = rows.where("scope = 'analytic_inference'").withColumn("n", F.row_number().over(own.orderBy(F.desc("confidence"), "id", "object_id"))).where(c("n") <= MOST)
    first = inferred.where("n = 1")
    backed = rows.where("scope <> 'analytic_inference'").withColumn("n", F.row_number().over(own.orderBy(F.desc("updated_at"), "id", "object_id"))).where(c("n") <= BASIS)
    backed = backed.join(first.select(c("subject_id").alias("f")), c("subject_id") == c("f"), "left_semi")
    sure = confidence_label(c("confidence"))
    basis = [line(first, F.lit(0), "- Source basis:"), line(backed, c("n"), "  - ", c("object_id"), " by ", c("label"), "."), line(first, F.lit(100), "- Observed effects:"), line(backed, c("n") + 100, "  - ", c("object_id"), " is ", c("status"), ".")]
    basis += [line(first, F.lit(200), "- Assessment: ", c("subject_id"), " and ", c("object_id"), ": ", c("label"), "."), line(first, F.lit(201), "- Confidence: ", sure, ".")]
    implied = line(watched, c("n"), "- ", c("object_id"), " may involve ", c("subject_id"), ".")
    kind = F.when(c("scope") == "analytic_inference", "Analytic inference").otherwise("Assertion")
    cited = line(ranked.where(c("latest") <= MOST), c("latest"), report.table_row(F.concat(F.lit("["), c("latest"), F.lit("]")), kind, F.concat(c("object_id"), F.lit(" by "), c("label")), sure))
    traced = line(inferred, c("n"), report.table_row(c("object_id"), c("id"), F.lit("infers"), sure))
    named = rows.groupBy("subject_id", "object_id").agg(F.count(F.lit(1)).alias("k")).withColumn("n", F.row_number().over(own.orderBy("object_id"))).where(c("n") <= MOST)
    index = line(named, c("n"), "- ", c("object_id"), ": ", c("k").cast("string"))
    tick = lambda name, value: F.concat(F.lit(f"{name}: `"), value, F.lit("`"))
    head = F.array(F.concat(F.lit("# Briefing on "), "subject_id"), F.lit(""), tick("Briefing ID", record_id("brf", F.lit("briefing"), "subject_id")), tick("Generated", date_text("upto")), F.lit("Previous Briefing: `none`"), F.lit(""))
    reports = rows.groupBy("subject_id").agg(F.max("updated_at").alias("upto")).select(F.col("subject_id").alias("report"), head.alias("head"))
    own_rows = [judgment, changed, reduce(DataFrame.union, basis), quality, gaps, watch, implied, None, cited, traced, index]
    return report.render(reports, [(title, before, lines) for (title, before), lines in zip(SECTIONS, own_rows)])
