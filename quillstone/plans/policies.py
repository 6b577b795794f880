"""Capture, rights, review context, table, evidence and integrity rules that single rows decide."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions.text import record_id, slug
from quillstone.registry import query
from quillstone.sources.tables import ASSERTIONS_SQL, PROPOSALS_SQL, assertions, proposals, table


@query("""SELECT doc_id, count(*) OVER (PARTITION BY sha256(text)) AS n_same, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY sha256(text)) THEN 'created' ELSE 'reused' END AS disposition FROM documents""")
def capture_disposition(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a capture brings new bytes; counts are joined back, so a hot digest may be split."""
    rows = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    same = rows.groupBy(F.col("digest").alias("d")).agg(F.count(F.lit(1)).alias("n_same"), F.min("doc_id").alias("first"))
    return rows.join(same, F.col("digest") == F.col("d")).select("doc_id", "n_same", F.when(F.col("doc_id") == F.col("first"), "created").otherwise("reused").alias("disposition"))


@query("""SELECT d.doc_id, d.text = '' AS no_bytes, l.doc_id IS NULL AS no_assessment, e.vec_id IS NULL AS no_vector FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id WHERE d.text = '' OR l.doc_id IS NULL OR e.vec_id IS NULL""")
def closure_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """What is missing for a document to be complete."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("l"))
    vectors = table(spark, sf, "embeddings").select("vec_id")
    rows = table(spark, sf, "documents").join(labels, F.col("doc_id") == F.col("l"), "left").join(vectors, F.col("doc_id") == F.col("vec_id"), "left")
    rows = rows.select("doc_id", (F.col("text") == "").alias("no_bytes"), F.col("l").isNull().alias("no_assessment"), F.col("vec_id").isNull().alias("no_vector"))
    return rows.where("no_bytes or no_assessment or no_vector")


@query(f"""SELECT id, c_name AS label, CASE WHEN c_acctbal >= 0 THEN 'accepted' WHEN c_acctbal > -500 THEN 'pending' ELSE 'missing' END AS reference, CAST(n AS BIGINT) AS n_evidence
FROM ({PROPOSALS_SQL}) JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE review_status = 'pending'""")
def review_packet(spark: SparkSession, sf: str) -> DataFrame:
    """A pending proposal with its evidence and references."""
    evidence = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_evidence"))
    people = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    rows = proposals(spark, sf).where("review_status = 'pending'").join(people, F.col("o_custkey") == F.col("c_custkey")).join(evidence, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    reference = F.when(F.col("c_acctbal") >= 0, "accepted").when(F.col("c_acctbal") > -500, "pending").otherwise("missing")
    return rows.select("id", F.col("c_name").alias("label"), reference.alias("reference"), "n_evidence")


@query(f"SELECT id, CASE WHEN review_status = 'pending' THEN 'approve,edit,export,reject' ELSE 'export' END AS actions FROM ({PROPOSALS_SQL})")
def action_plans(spark: SparkSession, sf: str) -> DataFrame:
    """What may be done with a proposal."""
    return proposals(spark, sf).select("id", F.when(F.col("review_status") == "pending", "approve,edit,export,reject").otherwise("export").alias("actions"))


@query(f"SELECT id, CASE WHEN object_id IS NULL THEN 'no_object' WHEN confidence > 1 THEN 'range' ELSE 'self_relation' END AS rule FROM ({ASSERTIONS_SQL}) WHERE l_suppkey = l_partkey OR confidence > 1 OR object_id IS NULL")
def shape_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose values can't be."""
    rule = F.when(F.col("object_id").isNull(), "no_object").when(F.col("confidence") > 1, "range").otherwise("self_relation")
    return assertions(spark, sf).where("l_suppkey = l_partkey or confidence > 1 or object_id is null").select("id", rule.alias("rule"))


@query("SELECT o_orderkey AS id, CASE WHEN n IS NULL THEN 'no_claims' WHEN n > 6 THEN 'too_many' ELSE 'undated' END AS rule FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE n IS NULL OR n > 6 OR o_orderdate IS NULL")
def outcome_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes without just what their state asks for."""
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").where("n is null or n > 6 or o_orderdate is null")
    return rows.select(F.col("o_orderkey").alias("id"), F.when(F.col("n").isNull(), "no_claims").when(F.col("n") > 6, "too_many").otherwise("undated").alias("rule"))


@query("""SELECT conv_id, 'not_contiguous' AS rule FROM conversations GROUP BY conv_id HAVING max(turn) + 1 <> count(*) UNION ALL SELECT conv_id, 'starts_without_user' FROM conversations WHERE turn = 0 AND role <> 'user' UNION ALL SELECT conv_id, 'repeated_role' FROM
(SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) WHERE role = prev GROUP BY conv_id""")
def page_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences that don't account for every element, all rules from one window and one aggregate."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("prev"))
    per = rows.groupBy("conv_id").agg(F.max("turn").alias("m"), F.count(F.lit(1)).alias("n"), F.max((F.col("turn") == 0) & (F.col("role") != "user")).alias("s"), F.max(F.coalesce(F.col("role") == F.col("prev"), F.lit(False))).alias("r"))
    rules = {"not_contiguous": F.col("m") + 1 != F.col("n"), "starts_without_user": F.col("s"), "repeated_role": F.col("r")}
    return per.select("conv_id", F.explode(F.filter(F.array(*[F.when(c, name) for name, c in rules.items()]), lambda x: x.isNotNull())).alias("rule"))


@query("""SELECT vec_id AS unit, 'dimension' AS rule FROM embeddings WHERE len(embedding) <> 64 UNION ALL SELECT vec_id, 'not_finite' FROM embeddings WHERE len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0 UNION ALL SELECT vec_id, 'no_unit' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))""")
def retrieval_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors that an index must not hold."""
    barred = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    units = table(spark, sf, "documents").select("doc_id").join(barred, "doc_id", "left_anti")
    rows = table(spark, sf, "embeddings").join(units, F.col("vec_id") == F.col("doc_id"), "left")
    odd = F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    rules = {"dimension": F.size("embedding") != 64, "not_finite": odd, "no_unit": F.col("doc_id").isNull()}
    return rows.select(F.col("vec_id").alias("unit"), F.explode(F.filter(F.array(*[F.when(c, name) for name, c in rules.items()]), lambda x: x.isNotNull())).alias("rule"))


@query("""SELECT 'act_' || left(sha256('capture:' || doc_id), 24) AS id, 'capture' AS kind, 'doc-' || doc_id AS output_id, 'src-' || source AS input_id FROM documents""")
def provenance_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Activities with what went in and what came out."""
    return table(spark, sf, "documents").select(record_id("act", F.lit("capture"), "doc_id").alias("id"), F.lit("capture").alias("kind"), F.concat(F.lit("doc-"), "doc_id").alias("output_id"), F.concat(F.lit("src-"), "source").alias("input_id"))


@query("""SELECT o_custkey AS report_id, string_agg(kind || ':' || id, ',' ORDER BY section, id) AS refs FROM (SELECT o_custkey, 0 AS section, 'report' AS kind, o_custkey::VARCHAR AS id FROM orders GROUP BY o_custkey UNION ALL SELECT o_custkey, 1, 'page', o_orderkey::VARCHAR FROM orders) GROUP BY 1""")
def artifact_refs(spark: SparkSession, sf: str) -> DataFrame:
    """What a report refers to, in the order of its sections."""
    pages = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.col("o_orderkey").cast("string"))).alias("p"))
    refs = F.concat(F.array(F.concat(F.lit("report:"), "o_custkey")), F.transform("p", lambda x: F.concat(F.lit("page:"), x)))
    return pages.select(F.col("o_custkey").alias("report_id"), F.array_join(refs, ",").alias("refs"))


@query("""SELECT user_id, 'task_' || left(sha256('task:' || user_id || ':' || count(*)), 24) AS task_id, count(*) AS n_inputs FROM events GROUP BY user_id""")
def task_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks named by what they are to do."""
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_inputs"))
    return rows.select("user_id", record_id("task", F.lit("task"), "user_id", "n_inputs").alias("task_id"), "n_inputs")


@query("""WITH s AS (SELECT user_id, max(CASE WHEN event_type = 'signup' THEN ts END) AS started, max(CASE WHEN event_type IN ('purchase', 'error') THEN ts END) AS ended FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN ended IS NULL OR started > ended THEN 'interrupted' ELSE 'closed' END AS outcome FROM s WHERE started IS NOT NULL""")
def reconcile_interrupted(spark: SparkSession, sf: str) -> DataFrame:
    """Starts after the last outcome were interrupted."""
    when = lambda *kinds: F.max(F.when(F.col("event_type").isin(*kinds), F.col("ts")))
    rows = table(spark, sf, "events").groupBy("user_id").agg(when("signup").alias("started"), when("purchase", "error").alias("ended")).where("started is not null")
    return rows.select("user_id", F.when(F.col("ended").isNull() | (F.col("started") > F.col("ended")), "interrupted").otherwise("closed").alias("outcome"))


@query("""SELECT p_partkey AS id, regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g') || '-' || left(sha256(p_name), 8) AS task_id FROM part""")
def task_slugs(spark: SparkSession, sf: str) -> DataFrame:
    """Task names with a digest that tells equal slugs apart."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(slug(F.col("p_brand")), F.lit("-"), F.substring(F.sha2("p_name", 256), 1, 8)).alias("task_id"))


@query("""SELECT l_suppkey AS source_id, n_name AS place, count(*) AS n_claims FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY 1, 2""")
def analytic_trace(spark: SparkSession, sf: str) -> DataFrame:
    """Inferences with both endpoints; they are counted before the names are joined."""
    counts = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_claims"))
    places = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("place"))
    return counts.join(places, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_suppkey").alias("source_id"), "place", "n_claims")


@query(f"""WITH t AS (SELECT l_orderkey AS id FROM ({ASSERTIONS_SQL}) GROUP BY 1 ORDER BY count(*) DESC, count(DISTINCT l_suppkey) DESC, id LIMIT 1)
SELECT a.id, a.subject_id FROM ({ASSERTIONS_SQL}) a JOIN t ON a.l_orderkey = t.id WHERE a.scope <> 'analytic_inference' ORDER BY a.l_linenumber, a.id, a.subject_id LIMIT 2""")
def what_changed(spark: SparkSession, sf: str) -> DataFrame:
    """The first two source-backed claims of the top outcome."""
    rows = assertions(spark, sf)
    first = rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("m")).orderBy(F.desc("n"), F.desc("m"), "l_orderkey").limit(1)
    claims = rows.where("scope <> 'analytic_inference'").join(F.broadcast(first.select(F.col("l_orderkey").alias("t"))), F.col("l_orderkey") == F.col("t"))  # one row
    return claims.orderBy("l_linenumber", "id", "subject_id").limit(2).select("id", "subject_id")


@query(f"""SELECT id, subject_id, confidence FROM ({ASSERTIONS_SQL}) a WHERE scope = 'analytic_inference' AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_partkey = a.l_partkey AND b.l_returnflag = 'N' AND b.l_quantity > 49)""")
def judgment_basis(spark: SparkSession, sf: str) -> DataFrame:
    """Inferences that a source-backed observation supports."""
    seen = table(spark, sf, "lineitem").where("l_returnflag = 'N' and l_quantity > 49").select(F.col("l_partkey").alias("part"))
    return assertions(spark, sf).where("scope = 'analytic_inference'").join(seen, F.col("l_partkey") == F.col("part"), "left_semi").select("id", "subject_id", "confidence")
