"""Evidence graph, mining, chains and closures; briefing and review queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions.text import record_id
from quillstone.operators import graph
from quillstone.registry import query
from quillstone.sources.tables import ASSERTIONS_SQL, PROPOSALS_SQL, assertions, proposals, table

_NODES = f"""SELECT 'org-' || s_suppkey AS id, 'organization' AS node_type, s_name AS label FROM supplier
UNION ALL SELECT 'ent-' || p_partkey, 'entity', p_name FROM part UNION ALL SELECT 'out-' || o_orderkey, 'outcome', 'order ' || o_orderkey FROM orders
UNION ALL SELECT id, 'assertion', scope FROM ({ASSERTIONS_SQL})"""
_EDGES = f"""SELECT DISTINCT edge_type || ':' || source_id || ':' || target_id AS id, source_id, target_id, edge_type FROM (
SELECT id AS source_id, subject_id AS target_id, 'has_subject' AS edge_type FROM ({ASSERTIONS_SQL}) UNION ALL SELECT id, object_id, 'has_object' FROM ({ASSERTIONS_SQL})
UNION ALL SELECT outcome_id, id, 'supported_by' FROM ({ASSERTIONS_SQL}) UNION ALL SELECT outcome_id, subject_id, 'involves' FROM ({ASSERTIONS_SQL}))"""


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Records of four kinds as nodes."""
    one = lambda t, key, kind, label: table(spark, sf, t).select(key.alias("id"), F.lit(kind).alias("node_type"), label.alias("label"))
    name = lambda prefix, c: F.concat(F.lit(prefix), c)
    out = one("supplier", name("org-", "s_suppkey"), "organization", F.col("s_name")).union(one("part", name("ent-", "p_partkey"), "entity", F.col("p_name")))
    out = out.union(one("orders", name("out-", "o_orderkey"), "outcome", F.concat(F.lit("order "), "o_orderkey")))
    return out.union(assertions(spark, sf).select("id", F.lit("assertion"), "scope"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """References between them as edges; equal ones are one edge. Each claim gives four in one pass."""
    kinds = [("id", "subject_id", "has_subject"), ("id", "object_id", "has_object"), ("outcome_id", "id", "supported_by"), ("outcome_id", "subject_id", "involves")]
    pairs = F.array(*[F.struct(F.col(a).alias("source_id"), F.col(b).alias("target_id"), F.lit(t).alias("edge_type")) for a, b, t in kinds])
    rows = assertions(spark, sf).select(F.explode(pairs).alias("e")).select("e.*").distinct()
    return rows.select(F.concat_ws(":", "edge_type", "source_id", "target_id").alias("id"), "source_id", "target_id", "edge_type")


@query(_NODES)
def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of the evidence graph."""
    return nodes(spark, sf)


@query(_EDGES)
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of the evidence graph."""
    return edges(spark, sf)


@query(f"SELECT id, target_id FROM ({_EDGES}) WHERE edge_type = 'has_object' AND target_id NOT IN (SELECT 'ent-' || p_partkey FROM part WHERE p_size > 2)")
def graph_dangling(spark: SparkSession, sf: str) -> DataFrame:
    """Edges to records that aren't there."""
    known = table(spark, sf, "part").where("p_size > 2").select(F.concat(F.lit("ent-"), "p_partkey").alias("n"))
    return edges(spark, sf).where("edge_type = 'has_object'").join(known, F.col("target_id") == F.col("n"), "left_anti").select("id", "target_id")


_MINE = """SELECT a.l_suppkey AS first_id, b.l_suppkey AS second_id, count(DISTINCT a.l_orderkey) AS n_outcomes FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a
JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey
JOIN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) >= 2) c ON c.l_orderkey = a.l_orderkey GROUP BY 1, 2"""


def _mined(spark: SparkSession, sf: str) -> DataFrame:
    return graph.cooccurrence(assertions(spark, sf), "l_orderkey", "l_suppkey", least=2)


@query(_MINE)
def graph_mine(spark: SparkSession, sf: str) -> DataFrame:
    """Organisations that take part in the same outcomes."""
    return _mined(spark, sf)


@query(f"SELECT m.* FROM ({_MINE}) m WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = m.first_id AND l_partkey % 100 = m.second_id)")
def graph_mine_new(spark: SparkSession, sf: str) -> DataFrame:
    """Mined pairs that no relationship states yet."""
    known = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("x"), (F.col("l_partkey") % 100).alias("y")).distinct()
    return _mined(spark, sf).join(known, (F.col("first_id") == F.col("x")) & (F.col("second_id") == F.col("y")), "left_anti")


_PROPOSED = f"""WITH h AS (SELECT outcome_id, list_sort(list(DISTINCT subject_id) FILTER (subject_id IS NOT NULL)) AS o, list_sort(list(DISTINCT id) FILTER (id IS NOT NULL)) AS a FROM ({ASSERTIONS_SQL}) WHERE outcome_id IS NOT NULL
GROUP BY 1 HAVING count(DISTINCT subject_id) > 1 AND count(DISTINCT id) > 1),
m AS (SELECT outcome_id, unnest(o) AS organization FROM h),
c AS (SELECT outcome_id, x.organization AS subject, y.organization AS object, a FROM m x JOIN m y USING (outcome_id) JOIN h USING (outcome_id) WHERE x.organization < y.organization),
d AS (SELECT *, left(sha256(subject || ':{graph.PREDICATE}:' || object || ':' || outcome_id || ':' || array_to_string(a, ':')), 24) AS digest, '_' || subject || '_{graph.PREDICATE}_' || object || '_' || outcome_id AS label FROM c),
e AS (SELECT *, 'arg_' || left(sha256(support || ':{graph.PREDICATE}:ast_' || digest), 24) AS edge FROM (SELECT *, unnest(a) AS support FROM d)),
r AS (SELECT 'Assertion' AS record_type, 'assertion' AS kind, label, 'ast_' || digest AS record_id, subject AS subject_id, object AS object_id, outcome_id, 0.5::DOUBLE AS confidence FROM d
UNION ALL SELECT 'Relationship', 'relationship', label, 'rel_' || digest, subject, object, outcome_id, NULL FROM d
UNION ALL SELECT 'ArgumentEdge', 'argument_edge', label || '_' || edge, edge, support, 'ast_' || digest, outcome_id, 0.7 FROM e)
SELECT 'pcg_' || left(sha256('{graph.MINING}:' || record_type || ':' || kind || label), 24) AS id, kind, record_id, subject_id, object_id, outcome_id, confidence FROM r"""


@query(_PROPOSED)
def graph_mine_proposals(spark: SparkSession, sf: str) -> DataFrame:
    """What mined connections propose: of each two organisations of an outcome an assertion, a relationship and an edge from each supporting assertion."""
    held = graph.supported(table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey", "l_linenumber")
    ids = lambda c, *prefix: F.transform(c, lambda x: F.concat(*prefix, x))
    return graph.proposed(held.select(F.concat(F.lit("out-"), "l_orderkey").alias("outcome_id"), ids("members", F.lit("org-")).alias("organizations"), ids("claims", F.lit("ast-"), "l_orderkey", F.lit("-")).alias("assertions")))


@query("""SELECT conv_id, max(turn) AS tip_turn, max_by(role, turn) AS tip_role, CASE WHEN max_by(role, turn) = 'user' THEN NULL ELSE max(turn) END AS current_turn
FROM conversations GROUP BY conv_id""")
def current_revision(spark: SparkSession, sf: str) -> DataFrame:
    """The record of a chain that nobody replaces; a withdrawn one leaves none."""
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("tip_turn"), F.max_by("role", "turn").alias("tip_role"))
    return rows.withColumn("current_turn", F.when(F.col("tip_role") != "user", F.col("tip_turn")))


@query("SELECT c.conv_id, c.turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn + 1)")
def revision_tip(spark: SparkSession, sf: str) -> DataFrame:
    """Records that are nobody's predecessor."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn")
    later = rows.select(F.col("conv_id").alias("c"), (F.col("turn") - 1).alias("t"))
    return rows.join(later, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left_anti")


@query("""SELECT conv_id, turn AS from_turn, next AS to_turn FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) WHERE next IS NOT NULL""")
def reading_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours in reading order."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("from_turn"), F.lead("turn").over(w).alias("to_turn")).where("to_turn IS NOT NULL")


@query("""SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char FROM conversations""")
def text_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Where each element begins in the joined text."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("long").alias("start_char"))


@query("""SELECT a.conv_id, count(*) AS n_ancestors FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.role = 'assistant' AND b.turn < a.turn WHERE a.role = 'user' GROUP BY 1""")
def ancestor_headings(spark: SparkSession, sf: str) -> DataFrame:
    """How many ancestors of a kind stand before the nodes of another, by one running count."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    before = F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).over(w)
    rows = table(spark, sf, "conversations").select("conv_id", "role", before.alias("b")).where("role = 'user' and b > 0")
    return rows.groupBy("conv_id").agg(F.sum("b").alias("n_ancestors"))


@query(f"SELECT object_id AS id, count(*) AS n, min(id) AS first_edge FROM ({ASSERTIONS_SQL}) WHERE scope = 'analytic_inference' GROUP BY 1")
def supporting_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges into each claim."""
    return assertions(spark, sf).where("scope = 'analytic_inference'").groupBy(F.col("object_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_edge"))


_QUEUE = f"SELECT id, record_type, type_rank, label FROM ({PROPOSALS_SQL}) WHERE review_status = 'pending'"


@query(_QUEUE)
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Pending proposals in the order of review."""
    return proposals(spark, sf).where("review_status = 'pending'").select("id", "record_type", "type_rank", "label").orderBy("type_rank", "label", "id")


@query(f"SELECT id, label FROM ({_QUEUE}) WHERE record_type = '2-HIGH' AND label = 'order-11'")
def review_queue_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The queue under optional filters."""
    wanted = {"record_type": "2-HIGH", "label": "order-11", "id": None}
    rows = proposals(spark, sf).where("review_status = 'pending'")
    for c, value in wanted.items():
        rows = rows if value is None else rows.where(F.col(c) == value)
    return rows.select("id", "label")


@query(f"SELECT id, record_type FROM ({_QUEUE}) ORDER BY type_rank, label, id LIMIT 1")
def review_next(spark: SparkSession, sf: str) -> DataFrame:
    """The head of the queue."""
    return proposals(spark, sf).where("review_status = 'pending'").orderBy("type_rank", "label", "id").limit(1).select("id", "record_type")


@query(f"SELECT id, CAST(row_number() OVER (ORDER BY type_rank, label, id) AS BIGINT) AS place, 'limit_reached' AS stop_reason FROM (SELECT * FROM ({_QUEUE}) ORDER BY type_rank, label, id LIMIT 25)")
def review_drain(spark: SparkSession, sf: str) -> DataFrame:
    """The first decisions of a drain with the reason to stop."""
    order = ["type_rank", "label", "id"]
    first = proposals(spark, sf).where("review_status = 'pending'").orderBy(*order).limit(25)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long")
    return first.select("id", place.alias("place"), F.lit("limit_reached").alias("stop_reason"))


@query(f"""SELECT record_type, count(*) AS n_pending, count(*) FILTER (c_acctbal >= 0) AS n_resolved, count(*) FILTER (c_acctbal < 0) AS n_unresolved
FROM ({PROPOSALS_SQL}) JOIN customer ON o_custkey = c_custkey WHERE review_status = 'pending' GROUP BY record_type""")
def review_readiness(spark: SparkSession, sf: str) -> DataFrame:
    """Pending proposals by type, and how many references of theirs are resolved."""
    people = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    rows = proposals(spark, sf).where("review_status = 'pending'").join(people, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("record_type").agg(F.count(F.lit(1)).alias("n_pending"), F.count_if(F.col("c_acctbal") >= 0).alias("n_resolved"), F.count_if(F.col("c_acctbal") < 0).alias("n_unresolved"))


@query(f"SELECT id, CASE WHEN value > 300000 THEN 'accepted' ELSE 'rejected' END AS new_status, 'act_' || left(sha256('review:' || id), 24) AS activity_id FROM ({PROPOSALS_SQL}) WHERE review_status = 'pending'")
def review_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions on pending proposals, with the activity that records each."""
    rows = proposals(spark, sf).where("review_status = 'pending'")
    return rows.select("id", F.when(F.col("value") > 300000, "accepted").otherwise("rejected").alias("new_status"), record_id("act", F.lit("review"), "id").alias("activity_id"))


@query(f"SELECT id, review_status FROM ({PROPOSALS_SQL}) WHERE review_status <> 'pending' AND value > 400000")
def decision_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions on what isn't pending."""
    return proposals(spark, sf).where("review_status <> 'pending' and value > 400000").select("id", "review_status")


@query(f"SELECT id, CASE WHEN status = 'proposed' AND scope = 'analytic_inference' THEN 'corroborated' WHEN status = 'proposed' THEN 'reported' ELSE status END AS promoted FROM ({ASSERTIONS_SQL})")
def acceptance_status(spark: SparkSession, sf: str) -> DataFrame:
    """What a claim becomes when it is accepted."""
    to = F.when((F.col("status") == "proposed") & (F.col("scope") == "analytic_inference"), "corroborated").when(F.col("status") == "proposed", "reported").otherwise(F.col("status"))
    return assertions(spark, sf).select("id", to.alias("promoted"))


_STATE = f"""SELECT (SELECT count(*) FROM documents) AS n_documents, (SELECT count(*) FROM ({ASSERTIONS_SQL}) WHERE status = 'accepted') AS n_assertions,
(SELECT count(*) FROM ({PROPOSALS_SQL}) WHERE review_status = 'pending') AS n_pending, (SELECT count(*) FROM conversations) AS n_briefings"""


@query(f"SELECT *, CASE WHEN n_documents = 0 THEN 'capture' WHEN n_pending > 0 THEN 'review' WHEN n_assertions = 0 THEN 'extract' ELSE 'brief' END AS stage FROM ({_STATE})")
def pipeline_status(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of the ledger and the stage that they call for."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    row = n(table(spark, sf, "documents"), "n_documents").join(n(assertions(spark, sf).where("status = 'accepted'"), "n_assertions"))
    row = row.join(n(proposals(spark, sf).where("review_status = 'pending'"), "n_pending")).join(n(table(spark, sf, "conversations"), "n_briefings"))
    stage = F.when(F.col("n_documents") == 0, "capture").when(F.col("n_pending") > 0, "review").when(F.col("n_assertions") == 0, "extract").otherwise("brief")
    return row.withColumn("stage", stage)


@query(f"SELECT stage, CASE stage WHEN 'capture' THEN 'add sources' WHEN 'review' THEN 'decide on proposals' WHEN 'extract' THEN 'run extraction' ELSE 'generate briefing' END AS command FROM (SELECT CASE WHEN n_documents = 0 THEN 'capture' WHEN n_pending > 0 THEN 'review' WHEN n_assertions = 0 THEN 'extract' ELSE 'brief' END AS stage FROM ({_STATE}))")
def pipeline_next(spark: SparkSession, sf: str) -> DataFrame:
    """The next command."""
    commands = {"capture": "add sources", "review": "decide on proposals", "extract": "run extraction", "brief": "generate briefing"}
    known = F.create_map(*[F.lit(x) for pair in commands.items() for x in pair])
    return pipeline_status(spark, sf).select("stage", known[F.col("stage")].alias("command"))


@query(f"""WITH c AS (SELECT * FROM ({ASSERTIONS_SQL}) WHERE updated_at > TIMESTAMP '1998-09-01')
SELECT 'assertion' AS kind, id FROM c UNION SELECT 'outcome', outcome_id FROM c UNION SELECT 'organization', subject_id FROM c UNION SELECT 'entity', object_id FROM c""")
def briefing_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Changed claims with all that they refer to."""
    changed = assertions(spark, sf).where(F.col("updated_at") > F.lit("1998-09-01").cast("timestamp_ntz"))
    kinds = {"assertion": "id", "outcome": "outcome_id", "organization": "subject_id", "entity": "object_id"}
    refs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("id")) for k, c in kinds.items()])
    return changed.select(F.explode(refs).alias("r")).select("r.*").distinct()


@query(f"SELECT scope, count(*) AS n_claims, count(DISTINCT subject_id) AS n_sources, round(avg(confidence), 6) AS mean_confidence FROM ({ASSERTIONS_SQL}) GROUP BY scope")
def evidence_quality(spark: SparkSession, sf: str) -> DataFrame:
    """What stands behind the claims of each kind."""
    return assertions(spark, sf).groupBy("scope").agg(F.count(F.lit(1)).alias("n_claims"), F.count_distinct("subject_id").alias("n_sources"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query(f"""WITH p AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS s, min(confidence) AS c, count(*) FILTER (scope = 'analytic_inference') AS d, count(*) FILTER (scope = 'source_statement') AS pr FROM ({ASSERTIONS_SQL}) GROUP BY 1)
SELECT l_partkey AS id, 'single_source' AS gap FROM p WHERE s = 1 UNION ALL SELECT l_partkey, 'no_primary' FROM p WHERE pr = 0 UNION ALL SELECT l_partkey, 'low_confidence' FROM p WHERE c < 0.5 UNION ALL SELECT l_partkey, 'derived_inference' FROM p WHERE d > 0""")
def collection_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """What evidence is wanting, all kinds of gaps from one aggregate."""
    rows = assertions(spark, sf).groupBy(F.col("l_partkey").alias("id")).agg(
        F.count_distinct("l_suppkey").alias("s"), F.min("confidence").alias("c"), F.count_if(F.col("scope") == "analytic_inference").alias("d"), F.count_if(F.col("scope") == "source_statement").alias("pr")
    )
    gaps = {"single_source": F.col("s") == 1, "no_primary": F.col("pr") == 0, "low_confidence": F.col("c") < 0.5, "derived_inference": F.col("d") > 0}
    return rows.select("id", F.explode(F.filter(F.array(*[F.when(cond, name) for name, cond in gaps.items()]), lambda g: g.isNotNull())).alias("gap"))


@query(f"""SELECT subject_id, CAST(row_number() OVER (ORDER BY min(l_orderkey * 10 + l_linenumber), subject_id) AS BIGINT) AS number FROM ({ASSERTIONS_SQL}) GROUP BY subject_id""")
def citations(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of distinct citations by first use, numbered without a global sort in one task."""
    first = assertions(spark, sf).groupBy("subject_id").agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first"))
    return graph.numbered(first, ["first", "subject_id"], "number").select("subject_id", "number")


@query(f"""SELECT id, CASE scope WHEN 'analytic_inference' THEN 'Assessment: ' WHEN 'reported_claim' THEN 'Reported: ' ELSE '' END || s_name || ' supplies ' || p_name || '.' AS text
FROM ({ASSERTIONS_SQL}) JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE status = 'accepted'""")
def assertion_text(spark: SparkSession, sf: str) -> DataFrame:
    """Claims as sentences."""
    lead = F.when(F.col("scope") == "analytic_inference", "Assessment: ").when(F.col("scope") == "reported_claim", "Reported: ").otherwise("")
    rows = assertions(spark, sf).where("status = 'accepted'").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("id", F.concat(lead, "s_name", F.lit(" supplies "), "p_name", F.lit(".")).alias("text"))


@query(f"""SELECT id, 'object_missing' AS rule FROM ({ASSERTIONS_SQL}) WHERE l_partkey % 97 = 0 UNION ALL SELECT id, 'accepted_without_confidence' FROM ({ASSERTIONS_SQL}) WHERE status = 'accepted' AND confidence = 0.5
UNION ALL SELECT id, 'inference_too_sure' FROM ({ASSERTIONS_SQL}) WHERE scope = 'analytic_inference' AND confidence >= 1""")
def assertion_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Rules that claims break, all in one pass."""
    rules = {
        "object_missing": F.col("l_partkey") % 97 == 0,
        "accepted_without_confidence": (F.col("status") == "accepted") & (F.col("confidence") == 0.5),
        "inference_too_sure": (F.col("scope") == "analytic_inference") & (F.col("confidence") >= 1),
    }
    broken = F.filter(F.array(*[F.when(c, r) for r, c in rules.items()]), lambda r: r.isNotNull())
    return assertions(spark, sf).select("id", F.explode(broken).alias("rule"))
