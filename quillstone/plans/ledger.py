"""Records of the ledger: bundles, manifests, contexts, pages, tables, news and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators.digests import set_digest
from quillstone.registry import query
from quillstone.sources.tables import ASSERTIONS_SQL, assertions, lines, table

_LINES = "SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, CAST(unnest(range(len(string_split(text, chr(10))))) AS BIGINT) AS order_index FROM documents"


@query("SELECT doc_id, 'doc-' || doc_id || '.txt' AS name, CASE WHEN trim(text) = '' THEN 'empty_text' ELSE 'stored' END AS outcome FROM documents")
def ingest_text_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Text files as documents."""
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("doc-"), "doc_id", F.lit(".txt")).alias("name"), F.when(F.trim("text") == "", "empty_text").otherwise("stored").alias("outcome"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS end_char, CASE WHEN trim(text) = '' THEN 'blocked' ELSE 'acceptable' END AS quality FROM documents")
def text_representation(spark: SparkSession, sf: str) -> DataFrame:
    """One logical view with one root node for each text."""
    return table(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("end_char"), F.when(F.trim("text") == "", "blocked").otherwise("acceptable").alias("quality"))


@query(r"SELECT doc_id, coalesce(nullif(trim(regexp_extract(text, '(?m)^# ([^\n]*)', 1)), ''), 'doc-' || doc_id) AS title FROM documents")
def source_title(spark: SparkSession, sf: str) -> DataFrame:
    """The first heading, or the file's name."""
    head = F.trim(F.regexp_extract("text", r"(?m)^# ([^\n]*)", 1))
    return table(spark, sf, "documents").select("doc_id", F.when(head != "", head).otherwise(F.concat(F.lit("doc-"), "doc_id")).alias("title"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_valid(props) AS valid FROM events")
def event_log_read(spark: SparkSession, sf: str) -> DataFrame:
    """Log records as typed rows; malformed ones are flagged and not fatal."""
    parsed = F.from_json("props", "k long")
    return table(spark, sf, "events").select("event_id", parsed["k"].alias("k"), F.coalesce(F.try_parse_json("props").isNotNull(), F.lit(False)).alias("valid"))


@query("SELECT source, CASE WHEN count(*) = count(DISTINCT sha256(text)) THEN 'created' ELSE 'conflict' END AS disposition, count(*) AS n_children FROM documents GROUP BY source")
def bundle_commit_disposition(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a bundle may be committed: no child twice."""
    rows = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_children"), F.count_distinct(F.sha2("text", 256)).alias("d"))
    return rows.select("source", F.when(F.col("n_children") == F.col("d"), "created").otherwise("conflict").alias("disposition"), "n_children")


#: A digest of a set of rows in two steps: rows by the first two hex digits of their own digest, then the at most 256 parts.
_DIGEST = """SELECT source, sha256(string_agg(prefix || ':' || part, ',' ORDER BY prefix)) AS digest FROM
(SELECT source, left(d, 2) AS prefix, sum(('0x' || substr(d, 3, 8))::BIGINT) || '-' || sum(('0x' || substr(d, 11, 8))::BIGINT) || '-' || sum(('0x' || substr(d, 19, 8))::BIGINT) || '-' || count(*) AS part
 FROM (SELECT source, sha256(text) AS d FROM documents) GROUP BY 1, 2) GROUP BY source"""


def _bundle(docs: DataFrame) -> DataFrame:
    """Parts are sums of pieces of the rows' digests, so they add up in each task, and no row holds a whole bundle."""
    return set_digest(docs.select("source", F.sha2("text", 256).alias("d")), ["source"], "d")


@query(_DIGEST)
def bundle_digest(spark: SparkSession, sf: str) -> DataFrame:
    """The digest of a bundle, whatever the order of its children."""
    return _bundle(table(spark, sf, "documents"))


@query("""SELECT source, count(*) AS n_units, count(*) FILTER (sha256(text) <> sha256(r)) AS n_mismatches, count(*) FILTER (sha256(text) <> sha256(r)) = 0 AS equivalent
FROM (SELECT source, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS r FROM documents) GROUP BY source""")
def rebuild_equivalence(spark: SparkSession, sf: str) -> DataFrame:
    """An index of whole texts against its rebuild from squeezed ones: units whose digests differ, by source."""
    docs = table(spark, sf, "documents")
    rebuilt = docs.select(F.col("doc_id").alias("r_id"), F.sha2(X.squeeze(F.col("text")), 256).alias("r"))
    rows = docs.select("doc_id", "source", F.sha2("text", 256).alias("d")).join(rebuilt, F.col("doc_id") == F.col("r_id"))
    counted = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_units"), F.count_if(F.col("d") != F.col("r")).alias("n_mismatches"))
    return counted.withColumn("equivalent", F.col("n_mismatches") == 0)


@query(f"SELECT doc_id, order_index, 'fp_' || left(sha256('unit:' || doc_id || ':' || order_index || ':' || sha256(line)), 24) AS fingerprint FROM ({_LINES}) WHERE line <> ''")
def unit_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of line units."""
    return lines(spark, sf).where("line <> ''").select("doc_id", "order_index", X.record_id("fp", F.lit("unit"), "doc_id", "order_index", F.sha2("line", 256)).alias("fingerprint"))


@query("SELECT source AS manifest, count(*) AS n FROM documents GROUP BY source HAVING count(*) > 1")
def duplicate_manifests(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests that occur more than once."""
    return table(spark, sf, "documents").groupBy(F.col("source").alias("manifest")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT o_custkey AS plan_id, o_orderkey AS item_id, 'frozen' AS origin FROM orders UNION ALL SELECT o_custkey, o_orderkey * 10 + l_linenumber, 'split_child' FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'")
def planned_items(spark: SparkSession, sf: str) -> DataFrame:
    """Frozen units and the children of split ones."""
    orders = table(spark, sf, "orders")
    children = orders.where("o_orderstatus = 'P'").join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    frozen = orders.select(F.col("o_custkey").alias("plan_id"), F.col("o_orderkey").alias("item_id"), F.lit("frozen").alias("origin"))
    return frozen.union(children.select("o_custkey", F.col("o_orderkey") * 10 + F.col("l_linenumber"), F.lit("split_child")))


@query("SELECT l_orderkey AS manifest_id, l_linenumber AS position, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) AS ordinal FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def split_children(spark: SparkSession, sf: str) -> DataFrame:
    """The children of a split manifest in order."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("manifest_id"), F.col("l_linenumber").alias("position")).distinct()
    return rows.withColumn("ordinal", F.dense_rank().over(Window.partitionBy("manifest_id").orderBy("position")).cast("long"))


@query("SELECT e.event_id, c.c_custkey IS NOT NULL AND e.event_type <> 'view' AS member FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id")
def attempt_membership(spark: SparkSession, sf: str) -> DataFrame:
    """Whether an attempt belongs to a planned item."""
    people = table(spark, sf, "customer").select("c_custkey")
    rows = table(spark, sf, "events").join(people, F.col("c_custkey") == F.col("user_id"), "left")
    return rows.select("event_id", (F.col("c_custkey").isNotNull() & (F.col("event_type") != "view")).alias("member"))


@query(f"""SELECT doc_id, sha256(string_agg('[line:' || order_index || ']' || chr(10) || line, chr(10) ORDER BY order_index)) AS digest, CAST(sum(strlen('[line:' || order_index || ']' || chr(10) || line)) + count(*) - 1 AS BIGINT) AS byte_length FROM ({_LINES}) GROUP BY doc_id""")
def context_render(spark: SparkSession, sf: str) -> DataFrame:
    """Contexts as text, to the byte."""
    parts = F.transform(F.split("text", "\n", -1), lambda line, i: F.concat(F.lit("[line:"), i.cast("string"), F.lit("]\n"), line))
    whole = F.array_join(parts, "\n")
    return table(spark, sf, "documents").select("doc_id", F.sha2(whole, 256).alias("digest"), F.octet_length(whole).cast("long").alias("byte_length"))


@query("""SELECT l_orderkey AS table_id, CAST(l_linenumber AS BIGINT) AS row_index, count(*) AS n_cells, CAST(sum(count(*)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS offset_cells FROM lineitem GROUP BY 1, l_linenumber""")
def table_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a table with the cells before them."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").cast("long").alias("row_index")).agg(F.count(F.lit(1)).alias("n_cells"))
    w = Window.partitionBy("table_id").orderBy("row_index").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset_cells", F.sum("n_cells").over(w))


@query("""SELECT l_orderkey AS table_id, CAST(l_linenumber AS BIGINT) AS start_row, CAST(coalesce(lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 8) AS BIGINT) AS end_row FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)""")
def header_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Header spans end where the next begins, or at the grid's edge."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").cast("long").alias("start_row")).distinct()
    return rows.withColumn("end_row", F.coalesce(F.lead("start_row").over(Window.partitionBy("table_id").orderBy("start_row")), F.lit(8).cast("long")))


@query("SELECT l_orderkey AS table_id, count(*) - count(DISTINCT l_linenumber) AS n_repeated FROM lineitem GROUP BY 1 HAVING count(*) <> count(DISTINCT l_linenumber)")
def table_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Tables with rows of the same index."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("table_id")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_linenumber").alias("d"))
    return rows.where("n <> d").select("table_id", (F.col("n") - F.col("d")).alias("n_repeated"))


@query("SELECT l_orderkey AS page_id, round(sum(CAST(round(l_discount * 100) AS BIGINT)) / (10.0::DOUBLE * count(*)), 6) AS confidence, sum(CAST(round(l_discount * 100) AS BIGINT)) < 3 * count(*) AS degraded FROM lineitem GROUP BY 1")
def ocr_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Mean confidence of each page's lines. Hundredths are summed as whole numbers, so that the bar is met exactly."""
    cents = F.round(F.col("l_discount") * 100).cast("long")
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.sum(cents).alias("s"), F.count(F.lit(1)).alias("n"))
    return rows.select("page_id", F.round(F.col("s") / (10.0 * F.col("n")), 6).alias("confidence"), (F.col("s") < 3 * F.col("n")).alias("degraded"))


@query("SELECT l_orderkey AS page_id, min(l_quantity) AS left_edge, max(l_quantity) AS right_edge, min(l_extendedprice) AS top_edge, max(l_extendedprice) AS bottom_edge FROM lineitem GROUP BY 1")
def ocr_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes around scattered corners."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(
        F.min("l_quantity").alias("left_edge"), F.max("l_quantity").alias("right_edge"), F.min("l_extendedprice").alias("top_edge"), F.max("l_extendedprice").alias("bottom_edge")
    )


@query("SELECT l_orderkey AS target_id, count(*) AS n_rectangles, CAST(floor(min(l_quantity) * 2 + 0.5) AS BIGINT) AS left_pixel FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1")
def evidence_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Rectangles that mark a target's regions, in pixels."""
    return table(spark, sf, "lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("target_id")).agg(F.count(F.lit(1)).alias("n_rectangles"), F.floor(F.min("l_quantity") * 2 + 0.5).cast("long").alias("left_pixel"))


@query("SELECT o_custkey AS report_id, count(*) AS n_pages, count(*) FILTER (o_orderstatus = 'F') AS n_complete, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'complete' ELSE 'partial' END AS state FROM orders GROUP BY 1")
def page_accounting(spark: SparkSession, sf: str) -> DataFrame:
    """Pages by outcome, with the state of the whole."""
    done = F.col("o_orderstatus") == "F"
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("report_id")).agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(done).alias("n_complete"), F.bool_and(done).alias("all"))
    return rows.select("report_id", "n_pages", "n_complete", F.when(F.col("all"), "complete").otherwise("partial").alias("state"))


@query("SELECT o_custkey AS report_id, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS pages FROM orders GROUP BY 1")
def page_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """A report's pages in the order that it declares."""
    pages = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey")))
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("report_id")).agg(pages.alias("p")).select("report_id", F.array_join(F.transform("p", lambda x: x["o_orderkey"].cast("string")), ",").alias("pages"))


@query("SELECT c_custkey AS report_id, CAST(coalesce(n, c_nationkey, 1) AS BIGINT) AS n_pages FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def page_denominator(spark: SparkSession, sf: str) -> DataFrame:
    """How many pages there are, by the first source that tells."""
    n = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf, "customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("c_custkey").alias("report_id"), F.coalesce(F.col("n"), F.col("c_nationkey").cast("long"), F.lit(1).cast("long")).alias("n_pages"))


_SETS = "SELECT l_suppkey AS id, list_sort(list(DISTINCT l_returnflag) FILTER (l_quantity > 40)) AS a, list_sort(list(DISTINCT l_returnflag) FILTER (l_discount > 0.09)) AS b FROM lineitem GROUP BY 1"


def _sets(spark: SparkSession, sf: str) -> DataFrame:
    some = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("l_returnflag"))))
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(some(F.col("l_quantity") > 40).alias("a"), some(F.col("l_discount") > 0.09).alias("b"))


@query(f"SELECT id, coalesce(list_has_all(coalesce(a, []), coalesce(b, [])), true) AS contained FROM ({_SETS})")
def subset_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Whether one set holds another."""
    return _sets(spark, sf).select("id", (F.size(F.array_except("b", "a")) == 0).alias("contained"))


@query(f"SELECT id, coalesce(a, []) = coalesce(b, []) AS equal FROM ({_SETS})")
def page_set_equality(spark: SparkSession, sf: str) -> DataFrame:
    """Whether expected and actual sets are the same."""
    return _sets(spark, sf).select("id", (F.col("a") == F.col("b")).alias("equal"))


@query("SELECT p_partkey AS id, p_brand || ':' || p_size AS version, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS first_id FROM part")
def version_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The first record of each version key."""
    rows = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    first = rows.groupBy(F.col("p_brand").alias("b"), F.col("p_size").alias("s")).agg(F.min("p_partkey").alias("first_id"))
    return rows.join(first, (F.col("p_brand") == F.col("b")) & (F.col("p_size") == F.col("s"))).select(F.col("p_partkey").alias("id"), F.concat_ws(":", "p_brand", "p_size").alias("version"), "first_id")


@query("SELECT l_orderkey * 10 + l_linenumber AS ref_id, p_partkey IS NOT NULL AS exists_ FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 5")
def artifact_existence(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each artifact that is referred to exists."""
    known = table(spark, sf, "part").where("p_size > 5").select("p_partkey")
    return table(spark, sf, "lineitem").join(known, F.col("p_partkey") == F.col("l_partkey"), "left").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref_id"), F.col("p_partkey").isNotNull().alias("exists_"))


@query(f"SELECT id, contains(scope, 'inference') AS inference, contains(scope, 'claim') AS reported FROM ({ASSERTIONS_SQL})")
def keyword_effects(spark: SparkSession, sf: str) -> DataFrame:
    """Effects by the words of a predicate."""
    return assertions(spark, sf).select("id", F.col("scope").contains("inference").alias("inference"), F.col("scope").contains("claim").alias("reported"))


@query(f"SELECT id, upper(left(scope, 1)) || replace(substr(scope, 2), '_', ' ') AS phrase FROM ({ASSERTIONS_SQL})")
def phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Codes as phrases."""
    return assertions(spark, sf).select("id", F.concat(F.upper(F.substring("scope", 1, 1)), F.replace(F.substring(F.col("scope"), F.lit(2), F.length("scope")), F.lit("_"), F.lit(" "))).alias("phrase"))


@query(f"SELECT scope, CASE WHEN starts_with(scope, 'analytic') THEN 'A primary source for the inference' WHEN contains(scope, 'claim') THEN 'A second source' ELSE 'None' END AS requirement, count(*) AS n FROM ({ASSERTIONS_SQL}) GROUP BY 1, 2")
def collection_requirements(spark: SparkSession, sf: str) -> DataFrame:
    """What would close a gap."""
    need = F.when(F.col("scope").startswith("analytic"), "A primary source for the inference").when(F.col("scope").contains("claim"), "A second source").otherwise("None")
    return assertions(spark, sf).groupBy("scope").agg(F.count(F.lit(1)).alias("n")).select("scope", need.alias("requirement"), "n")


@query("SELECT s_suppkey AS id, 'nation: ' || n_name || '; region: ' || coalesce(r_name, 'none') AS context FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def entity_index(spark: SparkSession, sf: str) -> DataFrame:
    """Entities with what places them."""
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("nation: "), "n_name", F.lit("; region: "), "r_name").alias("context"))


@query(f"SELECT id, 'Watch ' || subject_id || ' for ' || object_id || '.' AS sentence FROM ({ASSERTIONS_SQL}) WHERE scope = 'analytic_inference' AND confidence >= 0.75")
def indicators(spark: SparkSession, sf: str) -> DataFrame:
    """What to watch, a sentence for each inference that is believed."""
    rows = assertions(spark, sf).where("scope = 'analytic_inference' and confidence >= 0.75")
    return rows.select("id", F.concat(F.lit("Watch "), "subject_id", F.lit(" for "), "object_id", F.lit(".")).alias("sentence"))


@query(f"SELECT id, replace(replace(subject_id, 'org-', 'organisation '), '-', ' ') || ' / ' || replace(object_id, 'ent-', 'entity ') AS text FROM ({ASSERTIONS_SQL})")
def humanize_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids in words, the longest first."""
    subject = F.replace(F.replace("subject_id", F.lit("org-"), F.lit("organisation ")), F.lit("-"), F.lit(" "))
    return assertions(spark, sf).select("id", F.concat(subject, F.lit(" / "), F.replace("object_id", F.lit("ent-"), F.lit("entity "))).alias("text"))


@query(f"SELECT subject_id, CAST(count(*) AS BIGINT) AS n, min(id) AS first_id FROM ({ASSERTIONS_SQL}) WHERE subject_id IN ('org-1', 'org-2', 'org-3') GROUP BY 1")
def resolve_citation(spark: SparkSession, sf: str) -> DataFrame:
    """The records behind some citations."""
    return assertions(spark, sf).where(F.col("subject_id").isin("org-1", "org-2", "org-3")).groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("SELECT event_id, user_id, event_type <> 'error' AND value >= 0 AS shaped FROM events WHERE event_type IN ('error', 'purchase')")
def model_run_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Runs whose output doesn't fit their outcome."""
    return table(spark, sf, "events").where(F.col("event_type").isin("error", "purchase")).select("event_id", "user_id", ((F.col("event_type") != "error") & (F.col("value") >= 0)).alias("shaped"))


@query("SELECT conv_id, count(*) AS n_items, array_to_string(list(role ORDER BY turn, role)[1:2], ',') AS first_two, list_contains(list(role), 'system') AS has_system FROM conversations GROUP BY conv_id")
def array_ops(spark: SparkSession, sf: str) -> DataFrame:
    """Size, head and membership of each conversation's roles."""
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_items"), roles.alias("roles"))
    return rows.select("conv_id", "n_items", F.array_join(F.slice("roles", 1, 2), ",").alias("first_two"), F.array_contains("roles", "system").alias("has_system"))


@query(rf"""WITH l AS ({_LINES}), u AS (SELECT DISTINCT doc_id, order_index, unnest(regexp_extract_all(line, '[A-Z]{{2,}}')) AS acronym FROM l)
SELECT u.doc_id, u.order_index, u.acronym, max(d.order_index) AS defined_at FROM u JOIN l d ON d.doc_id = u.doc_id AND d.order_index < u.order_index AND contains(d.line, '(' || u.acronym || ')') GROUP BY 1, 2, 3""")
def acronym_definitions(spark: SparkSession, sf: str) -> DataFrame:
    """For each acronym in a line, the latest earlier line of the document that defines it in parentheses."""
    found = F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit("[A-Z]{2,}"), F.lit(0)))).alias("acronym")
    uses = lines(spark, sf).select("doc_id", "order_index", "line", found)
    defines = F.when(F.col("line").contains(F.concat(F.lit("("), "acronym", F.lit(")"))), F.col("order_index"))
    before = Window.partitionBy("doc_id", "acronym").orderBy("order_index").rowsBetween(Window.unboundedPreceding, -1)
    return uses.withColumn("defined_at", F.max(defines).over(before)).where("defined_at is not null").select("doc_id", "order_index", "acronym", "defined_at")
