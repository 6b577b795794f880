"""Evidence over the lines of documents, grounded contexts and batches, and the hand-off from search to context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions.text import record_id
from quillstone.operators import evidence
from quillstone.plans import retrieval
from quillstone.registry import query
from quillstone.sources.tables import table

#: Code points of context that a selector keeps on each side.
AROUND = 8
BUDGET = 15744

# Targets are the lines of documents. A document labelled of low quality has been extracted anew since (its pinned digest
# is another text's); one labelled toxic had its spans moved by one when words were cut out.
_NODES = """SELECT doc_id, source, order_index, line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY order_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a FROM
(SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, CAST(unnest(range(len(string_split(text, chr(10))))) AS BIGINT) AS order_index FROM documents)"""
_TARGETS = f"""SELECT n.doc_id, n.source, order_index, 'evt-' || n.doc_id || '-' || order_index AS target_id, a + moved AS s, a + length(line) + moved AS e, line AS exact,
substr(text, greatest(a - {AROUND}, 0) + 1, a - greatest(a - {AROUND}, 0)) AS prefix, substr(text, a + length(line) + 1, {AROUND}) AS suffix, sha256(CASE WHEN anew THEN lower(text) ELSE text END) AS pinned, a, a + length(line) AS b, text
FROM ({_NODES}) n JOIN (SELECT d.doc_id, text, coalesce(quality = 0, false) AS anew, coalesce(toxic, 0) AS moved FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) d ON d.doc_id = n.doc_id WHERE line <> ''"""
_ISSUE = """CASE WHEN pinned <> sha256(text) THEN 'stale_view' WHEN e > length(text) THEN 'outside_view' WHEN substr(text, s + 1, e - s) <> exact THEN 'exact_text'
WHEN s - length(prefix) < 0 OR substr(text, s - length(prefix) + 1, length(prefix)) <> prefix THEN 'prefix' WHEN substr(text, e + 1, length(suffix)) <> suffix THEN 'suffix' WHEN a > s OR b < e THEN 'outside_node' END"""
_DIGEST = "sha256(target_id || '|' || s || '|' || e || '|' || exact || '|' || prefix || '|' || suffix || '|' || pinned)"


def _targets(spark: SparkSession, sf: str, moved: bool = True) -> DataFrame:
    """Evidence targets by line; ``moved``: as they are now, not as they were when they were attempted."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("l_id"), "quality", "toxic")
    parts = F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(i.cast("long").alias("order_index"), line.alias("line")))
    rows = docs.join(labels, F.col("doc_id") == F.col("l_id"), "left")
    anew, by = F.coalesce(F.col("quality") == 0, F.lit(False)), F.coalesce(F.col("toxic"), F.lit(0)) if moved else F.lit(0)
    pinned = F.sha2(F.when(anew, F.lower("text")).otherwise(F.col("text")), 256)
    each = rows.select("doc_id", "source", by.cast("long").alias("by"), pinned.alias("view_digest"), F.explode(parts).alias("p")).select("*", "p.*")
    w = Window.partitionBy("doc_id").orderBy("order_index")
    each = each.withColumn("a", F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    # The text on either side: the ends of the lines before, and the beginnings of those after.
    near = [F.coalesce(F.lag("line", i).over(w), F.lit(None).cast("string")).alias(f"b{i}") for i in range(AROUND, 0, -1)]
    far = [F.lead("line", i).over(w).alias(f"f{i}") for i in range(1, AROUND + 1)]
    each = each.select("*", *near, *far)
    join = lambda cols: F.array_join(F.filter(F.array(*cols), lambda x: x.isNotNull()), "\n")
    has_before, has_after = F.col("b1").isNotNull(), F.col("f1").isNotNull()
    lead = F.when(has_before, F.concat(join([f"b{i}" for i in range(AROUND, 0, -1)]), F.lit("\n"))).otherwise("")
    tail = F.when(has_after, F.concat(F.lit("\n"), join([f"f{i}" for i in range(1, AROUND + 1)]))).otherwise("")
    return each.where("line != ''").select(
        "source",
        F.col("doc_id").alias("view_id"),
        "order_index",
        F.concat_ws("-", F.lit("evt"), "doc_id", "order_index").alias("target_id"),
        (F.col("a") + F.col("by")).alias("start_char"),
        (F.col("a") + F.length("line") + F.col("by")).alias("end_char"),
        F.col("line").alias("exact_text"),
        F.right(lead, F.lit(AROUND)).alias("prefix_text"),
        F.left(tail, F.lit(AROUND)).alias("suffix_text"),
        "view_digest",
        F.col("a").alias("node_start"),
        (F.col("a") + F.length("line")).alias("node_end"),
    )


def _views(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("view_id"), "text")


@query(f"SELECT target_id, {_ISSUE} AS issue FROM ({_TARGETS})")
def evidence_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Whether evidence still stands where it was found, by the first check that fails."""
    return evidence.replay(_targets(spark, sf), _views(spark, sf)).select("target_id", "issue")


@query(f"""SELECT 'eva_' || left(sha256(target_id || ':' || {_DIGEST}), 24) AS attempt_id, target_id, {_DIGEST} AS target_digest,
CASE WHEN {_ISSUE} IS NULL THEN 'succeeded' ELSE 'failed' END AS status, {_ISSUE} AS error FROM ({_TARGETS})""")
def evidence_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """The validation attempt that is recorded for each target, whether it succeeds or fails."""
    return evidence.attempts(_targets(spark, sf), _views(spark, sf))


_BEFORE = _TARGETS.replace("a + moved AS s, a + length(line) + moved AS e", "a AS s, a + length(line) AS e")


@query(f"""WITH r AS (SELECT target_id AS r_id, order_index AS r_order, doc_id AS r_doc, 'eva_' || left(sha256(target_id || ':' || {_DIGEST}), 24) AS attempt_id, {_DIGEST} AS r_digest, {_ISSUE} IS NULL AS good FROM ({_BEFORE})),
t AS (SELECT doc_id, order_index, target_id, {_DIGEST} AS digest, {_ISSUE} AS issue FROM ({_TARGETS})),
p AS (SELECT t.*, r.*, CASE WHEN r_id <> target_id THEN 'other_target' WHEN NOT good THEN 'not_succeeded' WHEN r_digest <> digest THEN 'stale_target' ELSE issue END AS error
FROM t JOIN r ON r_doc = doc_id AND r_order = CASE WHEN order_index = 3 THEN 2 ELSE order_index END)
SELECT target_id, attempt_id, error IS NULL AS valid, error FROM p""")
def evidence_verify(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts that were recorded before spans were moved, against the targets now; the fourth line's record names the third's attempt."""
    views = _views(spark, sf)
    before = _targets(spark, sf, moved=False)
    recorded = evidence.attempts(before, views)
    named = F.when(F.col("order_index") == 3, F.concat_ws("-", F.lit("evt"), "view_id", F.lit(2))).otherwise(F.col("target_id"))
    links = before.select(F.col("target_id").alias("for_target"), named.alias("named"))
    recorded = links.join(recorded, F.col("named") == F.col("target_id")).select("for_target", "attempt_id", "target_id", "target_digest", "status")
    return evidence.verify(_targets(spark, sf), recorded, views)


@query(f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY source, exact ORDER BY doc_id, s, target_id) AS n, first_value(target_id) OVER (PARTITION BY source, exact ORDER BY doc_id, s, target_id) AS earlier_id FROM ({_TARGETS}))
SELECT 'err_' || left(sha256(earlier_id || ':' || target_id), 24) AS relation_id, earlier_id, target_id AS later_id FROM t WHERE n > 1""")
def reanchor(spark: SparkSession, sf: str) -> DataFrame:
    """Later evidence tied to the first of the same text and source."""
    return evidence.reanchored(_targets(spark, sf), "source")


@query("""WITH l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
s AS (SELECT doc_id, source, text, count(*) FILTER (regexp_matches(line, '[0-9]')) AS n, string_agg('node-' || doc_id || '-' || i, ':' ORDER BY 'node-' || doc_id || '-' || i) FILTER (regexp_matches(line, '[0-9]')) AS ids FROM l GROUP BY ALL)
SELECT doc_id, n AS n_nodes, CASE WHEN trim(text) = '' THEN 'not_acceptable' WHEN n = 0 THEN 'no_nodes' ELSE 'built' END AS state,
CASE WHEN trim(text) <> '' AND n > 0 THEN 'ctx_' || left(sha256(source || ':' || doc_id || ':rep-' || doc_id || ':' || sha256(text) || ':' || ids), 24) END AS context_id FROM s""")
def grounded_context(spark: SparkSession, sf: str) -> DataFrame:
    """Contexts of the lines that hold figures, named by source, document, representation, its digest and the nodes in order."""
    docs = table(spark, sf, "documents")
    named = F.transform(F.split("text", "\n", -1), lambda line, i: F.when(line.rlike("[0-9]"), F.concat_ws("-", F.lit("node"), F.col("doc_id"), i)))
    rows = docs.select("doc_id", "source", "text", F.array_sort(F.filter(named, lambda x: x.isNotNull())).alias("nodes"))
    state = F.when(F.trim("text") == "", "not_acceptable").when(F.size("nodes") == 0, "no_nodes").otherwise("built")
    name = record_id("ctx", "source", "doc_id", F.concat(F.lit("rep-"), "doc_id"), F.sha2("text", 256), F.array_join("nodes", ":"))
    return rows.select("doc_id", F.size("nodes").cast("long").alias("n_nodes"), state.alias("state"), F.when(state == "built", name).alias("context_id"))


@query("""WITH c AS (SELECT l_orderkey AS task_id, l_suppkey, l_partkey, l_linenumber, sha256('task:' || l_orderkey) AS f FROM lineitem),
bad AS (SELECT task_id FROM c GROUP BY task_id, l_linenumber HAVING count(*) > 1 UNION SELECT task_id FROM c GROUP BY task_id, l_partkey HAVING count(*) > 1),
good AS (SELECT * FROM c WHERE task_id NOT IN (SELECT task_id FROM bad))
SELECT task_id, 'organization' AS kind, 'org-' || l_suppkey AS local_id, 'org_' || left(sha256(f || ':organization:org-' || l_suppkey), 24) AS record_id, NULL AS evidence_id, NULL AS validation_id FROM (SELECT DISTINCT task_id, f, l_suppkey FROM good)
UNION ALL SELECT task_id, 'assertion', 'ast-' || l_linenumber, 'ast_' || left(sha256(f || ':assertion:ast-' || l_linenumber), 24), 'evt_' || left(sha256(f || ':evidence:' || l_partkey), 24),
'eva_' || left(sha256(f || ':validation:evt_' || left(sha256(f || ':evidence:' || l_partkey), 24)), 24) FROM good
UNION ALL SELECT DISTINCT task_id, 'rejected', 'duplicate', NULL, NULL, NULL FROM bad""")
def grounded_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The proposals of each extraction task: organisations, and assertions with their evidence and its validation.

    Local ids become ids that follow from the task. A task that names one assertion or one piece of evidence twice is rejected whole.
    """
    f = F.sha2(F.concat(F.lit("task:"), "l_orderkey"), 256)
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task_id"), "l_suppkey", "l_partkey", "l_linenumber", f.alias("f"))
    twice = lambda c: rows.groupBy("task_id", c).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("task_id")
    bad = twice("l_linenumber").union(twice("l_partkey")).distinct()
    good = rows.join(bad, "task_id", "left_anti")
    none = F.lit(None).cast("string")
    local, claim = F.concat(F.lit("org-"), "l_suppkey"), F.concat(F.lit("ast-"), "l_linenumber")
    target = record_id("evt", "f", F.lit("evidence"), "l_partkey")
    organizations = good.select("task_id", "f", "l_suppkey").distinct().select("task_id", F.lit("organization").alias("kind"), local.alias("local_id"), record_id("org", "f", F.lit("organization"), local).alias("record_id"), none.alias("evidence_id"), none.alias("validation_id"))
    assertions = good.select("task_id", F.lit("assertion"), claim, record_id("ast", "f", F.lit("assertion"), claim), target, record_id("eva", "f", F.lit("validation"), target))
    return organizations.union(assertions).union(bad.select("task_id", F.lit("rejected"), F.lit("duplicate"), none, none, none))


@query(f"""WITH s AS (SELECT unit, rank, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\r\\x0b\\x0c]+')) AS BIGINT) AS n_tokens FROM ({retrieval.SELECTED_SQL}) JOIN documents ON doc_id = unit)
SELECT unit, rank, n_tokens, CAST(sum(n_tokens) OVER (ORDER BY rank) AS BIGINT) AS upto, sum(n_tokens) OVER () <= {BUDGET} AS ready FROM s""")
def retrieval_context(spark: SparkSession, sf: str) -> DataFrame:
    """What a search selects, and nothing else, handed to the context planner: tokens, their running total, and whether all fit the budget."""
    selected = retrieval.exact_search(spark, sf)
    n = F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\x0b\x0c]+"), F.lit(0))).cast("long")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = docs.join(F.broadcast(selected), F.col("doc_id") == F.col("unit")).select("unit", "rank", n.alias("n_tokens"))  # a page of results at most
    w = Window.partitionBy(F.lit(0))
    return rows.select("unit", "rank", "n_tokens", F.sum("n_tokens").over(w.orderBy("rank")).alias("upto"), (F.sum("n_tokens").over(w) <= BUDGET).alias("ready"))
