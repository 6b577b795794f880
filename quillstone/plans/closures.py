"""What selections need, trees of parents, and the persistent index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.operators import postings, references
from quillstone.operators.references import Link
from quillstone.plans.retrieval import TERMS_SQL, published_index
from quillstone.registry import query
from quillstone.sources.tables import table

#: Parts smaller than this are not accepted, so references to them dangle.
LEAST_SIZE = 3

_RECORDS = f"""SELECT 'outcome' AS type, 'out-' || o_orderkey AS id FROM orders UNION SELECT 'claim', 'ast-' || l_orderkey || '-' || l_linenumber FROM lineitem UNION SELECT 'organization', 'org-' || s_suppkey FROM supplier
UNION SELECT 'entity', 'ent-' || p_partkey FROM part WHERE p_size >= {LEAST_SIZE} UNION SELECT 'actor', 'act-' || c_custkey FROM customer UNION SELECT 'place', 'pla-' || n_nationkey FROM nation"""
_LINKS = """SELECT 'out-' || l_orderkey AS src, 'claim' AS type, 'ast-' || l_orderkey || '-' || l_linenumber AS dst FROM lineitem UNION SELECT 'out-' || o_orderkey, 'actor', 'act-' || o_custkey FROM orders
UNION SELECT 'ast-' || l_orderkey || '-' || l_linenumber, 'organization', 'org-' || l_suppkey FROM lineitem UNION SELECT 'ast-' || l_orderkey || '-' || l_linenumber, 'entity', 'ent-' || l_partkey FROM lineitem
UNION SELECT 'org-' || s_suppkey, 'place', 'pla-' || s_nationkey FROM supplier UNION SELECT 'act-' || c_custkey, 'place', 'pla-' || c_nationkey FROM customer"""


@query(f"""WITH RECURSIVE rec AS MATERIALIZED ({_RECORDS}), link AS MATERIALIZED ({_LINKS}),
r AS (SELECT 'outcome' AS type, 'out-' || o_orderkey AS id, 0 AS depth FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'
UNION SELECT rec.type, rec.id, r.depth + 1 FROM r JOIN link ON link.src = r.id JOIN rec ON rec.type = link.type AND rec.id = link.dst)
SELECT type, id, CAST(min(depth) AS BIGINT) AS depth, 'reached' AS state FROM r GROUP BY 1, 2
UNION ALL SELECT DISTINCT link.type, link.dst, NULL::BIGINT, 'missing' FROM r JOIN link ON link.src = r.id WHERE NOT EXISTS (SELECT 1 FROM rec WHERE rec.type = link.type AND rec.id = link.dst)""")
def context_closure(spark: SparkSession, sf: str) -> DataFrame:
    """All records of six types that urgent open outcomes need, and those that they need and that aren't there."""
    orders, claims, suppliers, people = (table(spark, sf, t) for t in ("orders", "lineitem", "supplier", "customer"))
    key = lambda prefix, *cols: F.concat_ws("-", F.lit(prefix), *cols)
    claim = key("ast", "l_orderkey", "l_linenumber")
    records = {
        "outcome": orders.select(key("out", "o_orderkey").alias("id")),
        "claim": claims.select(claim.alias("id")),
        "organization": suppliers.select(key("org", "s_suppkey").alias("id")),
        "entity": table(spark, sf, "part").where(F.col("p_size") >= LEAST_SIZE).select(key("ent", "p_partkey").alias("id")),
        "actor": people.select(key("act", "c_custkey").alias("id")),
        "place": table(spark, sf, "nation").select(key("pla", "n_nationkey").alias("id")),
    }
    of = lambda rows, src, dst: rows.select(src.alias("src"), dst.alias("dst"))
    links = {
        "outcome_claim": Link("outcome", "claim", of(claims, key("out", "l_orderkey"), claim)),
        "outcome_actor": Link("outcome", "actor", of(orders, key("out", "o_orderkey"), key("act", "o_custkey"))),
        "claim_subject": Link("claim", "organization", of(claims, claim, key("org", "l_suppkey"))),
        "claim_object": Link("claim", "entity", of(claims, claim, key("ent", "l_partkey"))),
        "organization_place": Link("organization", "place", of(suppliers, key("org", "s_suppkey"), key("pla", "s_nationkey"))),
        "actor_place": Link("actor", "place", of(people, key("act", "c_custkey"), key("pla", "c_nationkey"))),
    }
    seeds = orders.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").select(F.lit("outcome").alias("type"), key("out", "o_orderkey").alias("id"))
    reached, missing = references.closure(records, links, seeds)
    gone = missing.select(F.col("dst_type").alias("type"), F.col("dst").alias("id"), F.lit(None).cast("long").alias("depth"), F.lit("missing").alias("state")).distinct()
    return reached.withColumn("state", F.lit("reached")).union(gone)


@query("""WITH RECURSIVE p AS MATERIALIZED (SELECT a.conv_id, a.turn AS id, max(b.turn) AS parent FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn < a.turn AND b.role <> a.role GROUP BY 1, 2),
w AS (SELECT conv_id, id, 0 AS depth FROM p WHERE parent IS NULL UNION ALL SELECT p.conv_id, p.id, w.depth + 1 FROM w JOIN p ON p.conv_id = w.conv_id AND p.parent = w.id),
n AS (SELECT conv_id, count(*) AS n_rows, count(DISTINCT turn) AS n_nodes FROM conversations GROUP BY 1)
SELECT n.conv_id, n_nodes, count(*) FILTER (w.depth = 0) AS n_roots, 0::BIGINT AS n_orphans, n_nodes - count(w.id) AS n_cyclic, n_rows - n_nodes AS n_repeated, CAST(max(depth) AS BIGINT) AS depth,
count(*) FILTER (w.depth = 0) = 1 AND n_nodes = count(w.id) AND n_rows = n_nodes AS valid FROM n JOIN w ON w.conv_id = n.conv_id GROUP BY n.conv_id, n_rows, n_nodes""")
def tree_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Whether turns form one tree by what they reply to: the latest earlier turn of another role."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return references.trees(references.replied_to(turns, "conv_id", "turn", "role"), "conv_id")


@query("""WITH RECURSIVE n AS MATERIALIZED (SELECT p_partkey AS id, CASE WHEN p_size <> p_partkey AND p_size < 45 THEN p_size::BIGINT END AS parent FROM part),
e AS MATERIALIZED (SELECT n.id, n.parent, CASE WHEN n.parent IS NULL THEN 'root' WHEN m.id IS NULL THEN 'orphan' ELSE 'child' END AS state FROM n LEFT JOIN n m ON m.id = n.parent),
w AS (SELECT id, id AS at, 0 AS depth FROM e UNION ALL SELECT w.id, e.parent, w.depth + 1 FROM w JOIN e ON e.id = w.at WHERE e.state = 'child' AND w.depth < 60),
t AS (SELECT w.id, w.at AS top, CAST(w.depth AS BIGINT) AS depth FROM w JOIN e ON e.id = w.at WHERE e.state <> 'child')
SELECT e.id, t.top, t.depth, CASE WHEN t.id IS NULL THEN 'cyclic' ELSE e.state END AS state FROM e LEFT JOIN t ON t.id = e.id""")
def parent_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as nodes that point to the part numbered by their size, if that is under 45: where each pointer ends, or that it never does."""
    parent = F.when((F.col("p_size") != F.col("p_partkey")) & (F.col("p_size") < 45), F.col("p_size").cast("long"))
    nodes = table(spark, sf, "part").select(F.lit("parts").alias("tree"), F.col("p_partkey").alias("id"), parent.alias("parent"))
    return references.rooted(nodes, "tree").select("id", "top", "depth", "state")


@query("""SELECT conv_id, CAST(max(depth) AS BIGINT) AS depth, count(*) AS n FROM (WITH RECURSIVE s AS (SELECT conv_id, turn, 0 AS depth FROM conversations WHERE turn = 0 UNION ALL
SELECT c.conv_id, c.turn, s.depth + 1 FROM s JOIN conversations c ON c.conv_id = s.conv_id AND c.turn = s.turn + 1) SELECT * FROM s) GROUP BY conv_id""")
def reply_chains(spark: SparkSession, sf: str) -> DataFrame:
    """How far the turns of a conversation follow one another from the first, with none left out: runs of consecutive numbers."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn").where("turn >= 0")
    at = turns.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    first = at.withColumn("place", F.row_number().over(w) - 1).where(F.col("place") == F.col("turn"))
    return first.groupBy("conv_id").agg(F.max("turn").alias("depth"), F.sum("n").alias("n"))


@query(f"""SELECT source AS representation, count(*) AS n_units, CAST(sum(len(list_distinct(w))) AS BIGINT) AS n_postings, CAST(sum(len(w)) AS BIGINT) AS total_size FROM (SELECT source, {TERMS_SQL} AS w FROM documents) GROUP BY source""")
def postings_index(spark: SparkSession, sf: str) -> DataFrame:
    """What the index that lexical searches read holds of each representation, by its manifests."""
    return postings.manifests(spark, published_index(spark, sf)).select("representation", "n_units", "n_postings", "total_size")


@query(f"""WITH t AS (SELECT doc_id, source, unnest({TERMS_SQL}) AS term FROM documents), b AS (SELECT DISTINCT unnest({TERMS_SQL}) AS term FROM benchmark)
SELECT term, count(DISTINCT doc_id) AS n_units, count(*) AS n_occurrences, count(DISTINCT source) AS n_representations FROM t JOIN b USING (term) GROUP BY term""")
def postings_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """How often the index has each word of the benchmark: a join of the words with the postings."""
    words = table(spark, sf, "benchmark").select(F.explode(F.array_distinct(postings.terms(F.col("text")))).alias("word")).distinct()
    held = postings.postings(spark, published_index(spark, sf))
    met = held.join(words, F.col("term") == F.col("word"))
    return met.groupBy("term").agg(F.count(F.lit(1)).alias("n_units"), F.sum("tf").alias("n_occurrences"), F.count_distinct("representation").alias("n_representations"))
