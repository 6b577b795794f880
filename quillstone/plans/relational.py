"""Scans, lookups, paging, integrity, set operations and dispositions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.registry import query
from quillstone.sources.tables import ASSERTIONS_SQL, PROPOSALS_SQL, assertions, date_text, proposals, table


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def scan_ordered(spark: SparkSession, sf: str) -> DataFrame:
    """All records in id order."""
    return table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey").orderBy("c_custkey")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The record of one id, by a pushed-down filter."""
    return table(spark, sf, "orders").where("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 11")
def owner_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The records of one owner in id order."""
    return table(spark, sf, "orders").where("o_custkey = 11").select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_orderkey")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT c_nationkey + 1 FROM customer WHERE c_acctbal < 0)")
def id_set_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The records of a set of ids; an empty set gives none."""
    wanted = table(spark, sf, "customer").where("c_acctbal < 0").select((F.col("c_nationkey") + 1).cast("long").alias("id")).distinct()
    return table(spark, sf, "supplier").join(wanted, F.col("s_suppkey") == F.col("id"), "left_semi").select("s_suppkey", "s_name")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 11)")
def children_of_set(spark: SparkSession, sf: str) -> DataFrame:
    """The children of a set of parents, in parent and child order."""
    parents = table(spark, sf, "orders").where("o_custkey = 11").select(F.col("o_orderkey").alias("id"))
    return table(spark, sf, "lineitem").join(parents, F.col("l_orderkey") == F.col("id"), "left_semi").select("l_orderkey", "l_linenumber", "l_partkey").orderBy("l_orderkey", "l_linenumber")


_UNION = """SELECT 'place' AS kind, 'r-' || r_regionkey AS id FROM region UNION ALL SELECT 'place', 'n-' || n_nationkey FROM nation
UNION ALL SELECT 'organization', 's-' || s_suppkey FROM supplier UNION ALL SELECT 'actor', 'c-' || c_custkey FROM customer WHERE c_acctbal >= 0
UNION ALL SELECT 'entity', 'p-' || p_partkey FROM part"""


def _accepted(spark: SparkSession, sf: str) -> DataFrame:
    parts = [("place", "region", "r", "r_regionkey", None), ("place", "nation", "n", "n_nationkey", None), ("organization", "supplier", "s", "s_suppkey", None), ("actor", "customer", "c", "c_custkey", "c_acctbal >= 0"), ("entity", "part", "p", "p_partkey", None)]
    out = None
    for kind, name, prefix, key, where in parts:
        rows = table(spark, sf, name)
        rows = (rows.where(where) if where else rows).select(F.lit(kind).alias("kind"), F.concat(F.lit(prefix + "-"), key).alias("id"))
        out = rows if out is None else out.union(rows)
    return out


@query(_UNION)
def accepted_union(spark: SparkSession, sf: str) -> DataFrame:
    """All accepted records of every type."""
    return _accepted(spark, sf)


@query(f"SELECT kind, count(*) AS n FROM ({_UNION}) GROUP BY kind")
def accepted_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many accepted records of each kind there are."""
    return _accepted(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey AS id, count(l_orderkey) AS n_children, CAST(coalesce(sum(l_quantity), 0) AS DOUBLE) AS quantity
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def bundle_assemble(spark: SparkSession, sf: str) -> DataFrame:
    """Each parent with what its children add up to; children are summed before the join."""
    children = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    return table(spark, sf, "orders").join(children, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("id"), F.coalesce("n", F.lit(0)).alias("n_children"), F.coalesce("q", F.lit(0.0)).alias("quantity"))


@query("""WITH i AS (SELECT l_suppkey AS id, md5(string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR)) AS d FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1),
e AS (SELECT l_suppkey AS id, md5(string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR)) AS d FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT i.id, CASE WHEN e.id IS NULL THEN 'created' WHEN e.d = i.d THEN 'reused' ELSE 'conflict' END AS disposition FROM i LEFT JOIN e ON i.id = e.id""")
def immutable_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Incoming append-only records (open lines of a supplier) against those present (its finished ones): created, reused or in conflict."""
    digest = F.md5(F.array_join(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))), ","))
    rows = table(spark, sf, "lineitem")
    incoming = rows.where("l_linestatus = 'O'").groupBy(F.col("l_suppkey").alias("id")).agg(digest.alias("d"))
    present = rows.where("l_linestatus = 'F'").groupBy(F.col("l_suppkey").alias("e_id")).agg(digest.alias("e_d"))
    state = F.when(F.col("e_id").isNull(), "created").when(F.col("d") == F.col("e_d"), "reused").otherwise("conflict")
    return incoming.join(present, F.col("id") == F.col("e_id"), "left").select("id", state.alias("disposition"))


@query("""SELECT user_id, event_id, event_type, round(value, 4) AS value FROM
(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The last written version of each record, as one aggregate rather than a sort."""
    last = F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id"))
    return table(spark, sf, "events").groupBy("user_id").agg(last.alias("r")).select("user_id", "r.event_id", "r.event_type", F.round("r.value", 4).alias("value"))


@query("""SELECT event_id, user_id FROM events s WHERE event_type = 'signup' AND NOT EXISTS
(SELECT 1 FROM events e WHERE e.user_id = s.user_id AND e.event_type IN ('purchase', 'error') AND (e.ts > s.ts OR (e.ts = s.ts AND e.event_id > s.event_id)))
AND event_id > 100 ORDER BY event_id LIMIT 50""")
def open_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts without a later outcome, after a cursor, one page of them.

    Only the last outcome of a user matters, so the anti join is an aggregate and an equi-join.
    """
    events = table(spark, sf, "events")
    last = events.where(F.col("event_type").isin("purchase", "error")).groupBy(F.col("user_id").alias("u")).agg(F.max(F.struct("ts", "event_id")).alias("last"))
    starts = events.where("event_type = 'signup' and event_id > 100")
    unclosed = starts.join(last, F.col("user_id") == F.col("u"), "left").where(F.col("last").isNull() | (F.struct("ts", "event_id") > F.col("last")))
    return unclosed.select("event_id", "user_id").orderBy("event_id").limit(50)


@query("""SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderstatus = 'F') WHERE n = 1""")
def latest_complete(spark: SparkSession, sf: str) -> DataFrame:
    """The newest complete report of each owner."""
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'")
    return done.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey")).select("o_orderkey", "o_custkey")


@query("SELECT event_id, user_id, event_type FROM events WHERE ts > (SELECT ts FROM events WHERE event_id = 500) OR (ts = (SELECT ts FROM events WHERE event_id = 500) AND event_id > 500) ORDER BY ts, event_id LIMIT 100")
def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    """The page of 100 rows after a (time, id) cursor. The cursor's one row is read first, so that its time reaches the scan as a filter."""
    events = table(spark, sf, "events")
    at = events.where("event_id = 500").select(F.col("ts").cast("string")).first()
    ts = F.lit(at[0] if at else None).cast(events.schema["ts"].dataType)
    later = events.where((F.col("ts") >= ts) & ((F.col("ts") > ts) | (F.col("event_id") > 500)))
    return later.orderBy("ts", "event_id").limit(100).select("event_id", "user_id", "event_type")


@query("""SELECT o_orderkey AS run_id, l_linenumber AS position, l_partkey AS part_id, p_brand AS brand FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'P'""")
def link_join(spark: SparkSession, sf: str) -> DataFrame:
    """Runs, their links and the records linked."""
    runs = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("run_id"))
    links = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("part_id"))
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    return runs.join(links, F.col("run_id") == F.col("l_orderkey")).join(parts, F.col("part_id") == F.col("p_partkey")).select("run_id", "position", "part_id", "brand")


_REFERENCE = """SELECT o_orderkey AS record_id, o_custkey AS reference_id, CASE WHEN c_acctbal >= 0 THEN 'accepted' WHEN c_acctbal > -500 THEN 'pending' ELSE 'missing' END AS resolution
FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    people = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    state = F.when(F.col("c_acctbal") >= 0, "accepted").when(F.col("c_acctbal") > -500, "pending").otherwise("missing")
    return table(spark, sf, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("reference_id"), state.alias("resolution"))


@query(_REFERENCE)
def reference_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Each reference: to an accepted record, to one still proposed, or to none."""
    return _resolved(spark, sf)


@query(f"SELECT record_id, reference_id FROM ({_REFERENCE}) WHERE resolution <> 'accepted'")
def fk_violations(spark: SparkSession, sf: str) -> DataFrame:
    """References that keep a record from being accepted."""
    return _resolved(spark, sf).where("resolution <> 'accepted'").select("record_id", "reference_id")


@query("""SELECT c_custkey AS subject_id, k.kind FROM customer CROSS JOIN (VALUES ('1-URGENT'), ('2-HIGH'), ('5-LOW')) k(kind)
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = k.kind)""")
def missing_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Required kinds of evidence that a subject lacks, by set difference within each subject."""
    have = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderpriority").alias("have"))
    need = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "5-LOW")))
    rows = table(spark, sf, "customer").select("c_custkey").join(have, F.col("c_custkey") == F.col("k"), "left")
    return rows.select(F.col("c_custkey").alias("subject_id"), F.explode(F.array_except(need, F.coalesce("have", F.array().cast("array<string>")))).alias("kind"))


@query("""SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_suppkey NOT IN (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49)""")
def scope_complement(spark: SparkSession, sf: str) -> DataFrame:
    """Inputs outside the frozen scope."""
    rows = table(spark, sf, "lineitem")
    return rows.select(F.col("l_suppkey").alias("id")).distinct().subtract(rows.where("l_returnflag = 'R' and l_quantity > 49").select("l_suppkey"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Children whose owner isn't there."""
    owners = table(spark, sf, "customer").where("c_acctbal >= 0").select("c_custkey")
    return table(spark, sf, "orders").join(owners, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select(F.col("o_orderkey").alias("id"))


@query("SELECT text_hash, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, sha256(text) AS text_hash FROM documents) GROUP BY text_hash HAVING count(*) > 1")
def blob_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Contents that are stored more than once."""
    rows = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"))
    return rows.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 6")
def unique_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Ids that occur more often than they may."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 6")


@query(f"SELECT id, subject_id, updated_at FROM ({ASSERTIONS_SQL}) WHERE updated_at > TIMESTAMP '1998-06-01'")
def changed_since(spark: SparkSession, sf: str) -> DataFrame:
    """Records changed strictly after a boundary; the filter reaches the scan."""
    return assertions(spark, sf).where(F.col("updated_at") > F.lit("1998-06-01").cast("timestamp_ntz")).select("id", "subject_id", "updated_at")


@query(f"SELECT id, scope FROM ({ASSERTIONS_SQL}) WHERE status <> 'proposed'")
def accepted_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Claims that are no longer proposals."""
    return assertions(spark, sf).where("status <> 'proposed'").select("id", "scope")


@query(f"SELECT scope, count(*) AS n, count(*) FILTER (status = 'accepted') AS n_accepted FROM ({ASSERTIONS_SQL}) GROUP BY scope")
def assertion_split(spark: SparkSession, sf: str) -> DataFrame:
    """Source-backed claims and inferences."""
    return assertions(spark, sf).groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "accepted").alias("n_accepted"))


@query(f"SELECT id, confidence FROM ({ASSERTIONS_SQL}) WHERE scope <> 'analytic_inference' AND (confidence IS NULL OR confidence < 0.5)")
def low_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Source-backed claims that are hardly believed."""
    rows = assertions(spark, sf).where("scope <> 'analytic_inference'")
    return rows.where(F.col("confidence").isNull() | (F.col("confidence") < 0.5)).select("id", "confidence")


@query("""SELECT id, CASE split_part(id, '-', 1) WHEN 'p' THEN 'Entity' WHEN 'c' THEN 'Actor' WHEN 's' THEN 'Organization' WHEN 'n' THEN 'Place' WHEN 'r' THEN 'Place' END AS ref_type FROM (""" + _UNION + ")")
def ref_type(spark: SparkSession, sf: str) -> DataFrame:
    """The record type that an id's prefix tells."""
    kinds = F.create_map(*[F.lit(x) for pair in {"p": "Entity", "c": "Actor", "s": "Organization", "n": "Place", "r": "Place"}.items() for x in pair])
    return _accepted(spark, sf).select("id", kinds[F.substring_index("id", "-", 1)].alias("ref_type"))


@query("""SELECT user_id, max(ts) AS latest, CAST(max_by(event_id, (ts, event_id)) AS BIGINT) AS latest_id FROM events GROUP BY user_id""")
def latest_run(spark: SparkSession, sf: str) -> DataFrame:
    """The last run of each key."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("latest"), F.max_by("event_id", F.struct("ts", "event_id")).alias("latest_id"))


@query("""SELECT source, max_by(doc_id, (n_chars, doc_id)) AS doc_id, max(n_chars) AS n_chars FROM documents GROUP BY source""")
def latest_document(spark: SparkSession, sf: str) -> DataFrame:
    """The extreme record of each group."""
    return table(spark, sf, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("doc_id"), F.max("n_chars").alias("n_chars"))


@query("""SELECT l_suppkey AS id, string_agg(DISTINCT l_shipmode, ',' ORDER BY l_shipmode) AS ids FROM (SELECT l_suppkey, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1""")
def id_union(spark: SparkSession, sf: str) -> DataFrame:
    """The sorted union of the id sets of each group."""
    flags = F.array_join(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))), ",")
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(flags.alias("ids"))


@query("""SELECT l_partkey AS id, count(DISTINCT l_suppkey) AS n_sources, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN 'single' ELSE 'multiple' END AS corroboration,
CASE WHEN count(DISTINCT l_returnflag) = 1 THEN 'single' ELSE 'mixed' END AS authority FROM lineitem GROUP BY 1""")
def corroboration(spark: SparkSession, sf: str) -> DataFrame:
    """How many sources and authorities stand behind a claim."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count_distinct("l_suppkey").alias("n_sources"), F.count_distinct("l_returnflag").alias("a"))
    return rows.select("id", "n_sources", F.when(F.col("n_sources") == 1, "single").otherwise("multiple").alias("corroboration"), F.when(F.col("a") == 1, "single").otherwise("mixed").alias("authority"))


@query("""SELECT o_orderkey AS id, count(DISTINCT l_suppkey) AS n_orgs, count(*) AS n_assertions FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 ORDER BY n_assertions DESC, n_orgs DESC, id LIMIT 1""")
def top_outcome(spark: SparkSession, sf: str) -> DataFrame:
    """The outcome with most claims, organisations, and the least id."""
    rows = assertions(spark, sf).groupBy(F.col("l_orderkey").alias("id")).agg(F.count_distinct("l_suppkey").alias("n_orgs"), F.count(F.lit(1)).alias("n_assertions"))
    return rows.orderBy(F.desc("n_assertions"), F.desc("n_orgs"), "id").limit(1)


@query("""SELECT o_custkey AS owner_id, o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS ordinal FROM orders""")
def revision_order(spark: SparkSession, sf: str) -> DataFrame:
    """The place of each version in its owner's history."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("owner_id"), F.col("o_orderkey").alias("id"), F.row_number().over(w).cast("long").alias("ordinal"))


@query("""WITH p AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)
SELECT conv_id, count(*) AS n, bool_and(prev IS NULL OR prev = turn - 1) AND min(turn) = 0 AS contiguous FROM p GROUP BY conv_id""")
def contiguity(spark: SparkSession, sf: str) -> DataFrame:
    """Whether ordinals run from 0 without gaps; counts alone tell, without a sort."""
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("turn").alias("d"), F.min("turn").alias("low"), F.max("turn").alias("high"))
    return rows.select("conv_id", "n", ((F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("d") == F.col("n"))).alias("contiguous"))


@query(f"SELECT subject_id, first(id ORDER BY l_orderkey, l_linenumber) AS first_id, count(*) AS n FROM ({ASSERTIONS_SQL}) GROUP BY subject_id")
def reference_list(spark: SparkSession, sf: str) -> DataFrame:
    """The first mention of each distinct reference."""
    return assertions(spark, sf).groupBy("subject_id").agg(F.min_by("id", F.struct("l_orderkey", "l_linenumber")).alias("first_id"), F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey AS id, o_orderdate AS started_at, min(l_shipdate) AS completed_at FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2 HAVING min(l_shipdate) < o_orderdate""")
def time_order_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Runs that ended before they began."""
    first = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("completed_at"))
    rows = table(spark, sf, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey")).where("completed_at < o_orderdate")
    return rows.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("started_at"), "completed_at")


@query("""SELECT n_name AS name, 'n-' || n_nationkey AS id FROM nation UNION ALL SELECT s_name, 's-' || s_suppkey FROM supplier UNION ALL SELECT c_name, 'c-' || c_custkey FROM customer""")
def name_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Names by id over several tables."""
    pick = lambda t, name, key, prefix: table(spark, sf, t).select(F.col(name).alias("name"), F.concat(F.lit(prefix), key).alias("id"))
    return pick("nation", "n_name", "n_nationkey", "n-").union(pick("supplier", "s_name", "s_suppkey", "s-")).union(pick("customer", "c_name", "c_custkey", "c-"))


@query("""SELECT doc_id, CASE WHEN quality IS NULL THEN 'unassessed' WHEN toxic = 1 THEN 'blocked' WHEN quality = 1 THEN 'admitted' ELSE 'review' END AS admission
FROM (SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""")
def admission(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a document's quality admits it to analysis."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("l_id"), "quality", "toxic")
    state = F.when(F.col("quality").isNull(), "unassessed").when(F.col("toxic") == 1, "blocked").when(F.col("quality") == 1, "admitted").otherwise("review")
    return table(spark, sf, "documents").join(labels, F.col("doc_id") == F.col("l_id"), "left").select("doc_id", state.alias("admission"))


@query(f"SELECT id, record_type, label, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created FROM ({PROPOSALS_SQL}) WHERE review_status = 'pending'")
def pending_proposals(spark: SparkSession, sf: str) -> DataFrame:
    """Proposals that await a decision."""
    return proposals(spark, sf).where("review_status = 'pending'").select("id", "record_type", "label", date_text("created_at").alias("created"))
