"""Contexts for units of analysis: candidates, manifests and their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions.text import record_id
from quillstone.operators import contexts
from quillstone.operators.graph import durable
from quillstone.registry import query
from quillstone.sources.tables import lines, table

PROMPT = "List the claims of the focus."
#: Focus nodes of a unit.
FOCUS = 4
#: A small budget, so that long lines don't fit.
BUDGET = 400
#: What lines did not have when the manifests that are verified were stored.
SYMBOLS = "[#*$%&|<>]"
PLAIN_LINE = f"regexp_replace(line, '{SYMBOLS}', '', 'g')"


def _nodes(spark: SparkSession, sf: str, plain: bool = False) -> DataFrame:
    """Lines as nodes: blank ones are furniture, the first is a heading over the others."""
    kind = F.when(F.trim("line") == "", "furniture").when(F.col("order_index") == 0, "heading").otherwise("paragraph")
    text = F.regexp_replace("line", SYMBOLS, "") if plain else F.col("line")
    return lines(spark, sf).select(F.col("doc_id").alias("doc"), F.col("order_index").alias("node"), "order_index", kind.alias("node_type"), F.when(F.col("order_index") > 0, F.lit(0).cast("long")).alias("parent"), text.alias("text"))


def _units(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that aren't blank, four to a unit."""
    w = Window.partitionBy("doc").orderBy("node")
    rows = _nodes(spark, sf).where("node_type <> 'furniture'").select("doc", "node", F.floor((F.row_number().over(w) - 1) / FOCUS).alias("n"))
    grouped = rows.groupBy("doc", "n").agg(F.array_sort(F.collect_list("node")).alias("focus"))  # FOCUS nodes at most
    return durable(grouped.select(record_id("unit", F.lit("analysis"), "doc", "n").alias("unit"), "doc", "focus", F.array().cast("array<bigint>").alias("dependencies")))


_NODES = """SELECT doc_id AS doc, node, line, CASE WHEN trim(line) = '' THEN 'furniture' WHEN node = 0 THEN 'heading' ELSE 'paragraph' END AS kind FROM
(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(unnest(range(len(string_split(text, chr(10))))) AS BIGINT) AS node FROM documents)"""


def _tokens(text: str) -> str:
    return f"len(regexp_extract_all({text}, '[^ \\t\\n\\r\\x0b\\x0c]+'))"


def _manifests(name: str, text: str) -> str:
    """CTEs for the manifests over the nodes, with this expression for a line's text."""
    lead = len(PROMPT.encode()) + 2
    return f"""{name}_r AS (SELECT unit, doc, node, priority, role, '[' || kind || ':' || node || ']' || chr(10) || {text} AS seg FROM required),
{name}_p AS (SELECT *, {lead} + coalesce(sum(strlen(seg) + 2) OVER (PARTITION BY unit ORDER BY priority, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM {name}_r),
{name}_t AS (SELECT unit, doc, {_tokens(f"'{PROMPT}'")} + sum({_tokens("seg")}) AS needs, '{PROMPT}' || chr(10) || chr(10) || string_agg(seg, chr(10) || chr(10) ORDER BY priority, node) AS body, count(*) AS n,
 string_agg(node || ':' || CAST(start AS BIGINT) || ':' || CAST(start + strlen(seg) AS BIGINT), ',' ORDER BY priority, node) AS segs, string_agg('unit_' || left(sha256(doc || ':' || node), 24), ',' ORDER BY node) FILTER (role = 'focus') AS kids, count(*) FILTER (role = 'focus') AS n_focus FROM {name}_p GROUP BY 1, 2),
{name}_s AS (SELECT {name}_t.*, CASE WHEN needs <= {BUDGET} THEN 'ready' WHEN n_focus > 1 THEN 'split' ELSE 'blocked' END AS status, coalesce(k, 0) AS excluded FROM {name}_t LEFT JOIN furniture f ON f.doc = {name}_t.doc),
{name}_v AS (SELECT unit, doc, status, CASE WHEN status = 'ready' THEN needs ELSE 0 END AS input_tokens, sha256(CASE WHEN status = 'ready' THEN body ELSE '' END) AS rendered_digest, CASE WHEN status = 'ready' THEN segs ELSE '' END AS segments,
 CASE WHEN status = 'split' THEN kids ELSE '' END AS children, excluded, CASE WHEN status = 'blocked' THEN 'required_context_exceeds_budget' END AS blocked_reason, CASE WHEN status = 'ready' THEN n ELSE 0 END AS n_selected FROM {name}_s),
{name} AS (SELECT 'ctx_' || left(sha256(concat_ws(chr(10), unit, doc, status, CAST(input_tokens AS BIGINT), rendered_digest, segments, children, excluded, coalesce(blocked_reason, ''))), 24) AS manifest_id, * FROM {name}_v)"""


_REQUIRED = f"""WITH nodes AS MATERIALIZED ({_NODES}),
f AS (SELECT *, (row_number() OVER (PARTITION BY doc ORDER BY node) - 1) // {FOCUS} AS n FROM nodes WHERE kind <> 'furniture'),
units AS (SELECT DISTINCT doc, n, 'unit_' || left(sha256('analysis:' || doc || ':' || n), 24) AS unit FROM f),
focus AS (SELECT unit, f.* FROM f JOIN units ON units.doc = f.doc AND units.n = f.n),
required AS MATERIALIZED (SELECT unit, doc, node, line, kind, 'focus' AS role, 1 AS priority FROM focus UNION ALL
 SELECT unit, units.doc, node, line, kind, 'heading', 3 FROM units JOIN nodes ON nodes.doc = units.doc AND node = 0 AND kind = 'heading' WHERE n > 0),
furniture AS (SELECT doc, count(*) AS k FROM nodes WHERE kind = 'furniture' GROUP BY 1)"""


@query(f"{_REQUIRED} SELECT unit, doc, node, role, priority, CAST({_tokens("'[' || kind || ':' || node || ']' || chr(10) || line")} AS BIGINT) AS tokens FROM required")
def context_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """What each unit's context must hold, by role and priority."""
    return contexts.candidates(_units(spark, sf), _nodes(spark, sf)).select("unit", "doc", "node", "role", "priority", "tokens")


@query(f"{_REQUIRED}, {_manifests('m', 'line')} SELECT manifest_id, unit, doc, status, CAST(input_tokens AS BIGINT) AS input_tokens, rendered_digest, segments, children, excluded, blocked_reason, n_selected FROM m")
def context_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Whether all that is required fits the budget, must be split, or can't be handled, with the context to the byte."""
    return contexts.manifests(_units(spark, sf), _nodes(spark, sf), PROMPT, BUDGET).drop("rendered")


@query(f"""{_REQUIRED}, {_manifests('m', 'line')}, {_manifests('o', PLAIN_LINE)}
SELECT o.manifest_id, CASE WHEN o.rendered_digest <> m.rendered_digest THEN 'input' WHEN o.segments <> m.segments THEN 'segments' WHEN o.children <> m.children OR o.status <> m.status THEN 'children' ELSE 'none' END AS fault FROM o JOIN m ON m.unit = o.unit""")
def manifest_verify(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests that were stored when lines had no symbols, against the documents as they are."""
    units, nodes = _units(spark, sf), _nodes(spark, sf)
    known = durable(contexts.named(units, nodes))  # symbols change texts alone
    stored = contexts.manifests(units, _nodes(spark, sf, plain=True), PROMPT, BUDGET, known)
    return contexts.verified(stored, units, nodes, PROMPT, BUDGET, known).select("manifest_id", F.coalesce("fault", F.lit("none")).alias("fault"))


@query(f"""SELECT doc_id, CAST(n AS BIGINT) AS required_tokens, CASE WHEN n <= {contexts.BUDGET} THEN 'ready' WHEN f > 1 THEN 'split' ELSE 'blocked' END AS outcome FROM (SELECT doc_id, {_tokens('text')} AS n, len(string_split(text, chr(10))) AS f FROM documents)""")
def document_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a whole document fits a model's budget, may be split at its lines, or neither."""
    n = contexts.tokens(F.col("text"))
    outcome: Column = F.when(n <= contexts.BUDGET, "ready").when(F.col("text").contains("\n"), "split").otherwise("blocked")
    return table(spark, sf, "documents").select("doc_id", n.alias("required_tokens"), outcome.alias("outcome"))
