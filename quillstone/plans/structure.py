"""Document structure: furniture, levels, columns, sections, tables, spans, contexts and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions.text import furniture_key, record_id
from quillstone.registry import query
from quillstone.sources.tables import lines, table

_LINES = "SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, CAST(unnest(range(len(string_split(text, chr(10))))) AS BIGINT) AS order_index FROM documents"


@query(rf"""WITH k AS (SELECT doc_id, regexp_replace(trim(regexp_replace(replace(lower(line), 'ß', 'ss'), '\s+', ' ', 'g')), '[0-9]+', '#', 'g') AS key FROM ({_LINES}))
SELECT md5(key) AS key, count(DISTINCT doc_id) AS n_pages FROM k WHERE key <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2""")
def repeated_furniture(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that recur on several pages but for case, spacing and numbers."""
    keys = lines(spark, sf).select("doc_id", furniture_key(F.col("line")).alias("key")).where("key <> ''").distinct()
    return keys.groupBy(F.md5("key").alias("key")).agg(F.count(F.lit(1)).alias("n_pages")).where("n_pages >= 2")


@query("""SELECT conv_id, turn, CAST(max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section_turn,
CAST(count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM conversations""")
def section_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest enclosing heading of each element, and the segment that it opens."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.when(F.col("role") == "user", F.col("turn"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.max(heading).over(w).alias("section_turn"), F.count(heading).over(w).alias("segment"))


@query("""WITH a AS (SELECT DISTINCT l_orderkey, l_linenumber AS n, l_returnflag AS f FROM lineitem),
c AS (SELECT x.l_orderkey, x.n AS annotation, t.n AS target, row_number() OVER (PARTITION BY x.l_orderkey, x.n ORDER BY abs(x.n - t.n), t.n) AS place
FROM a x JOIN a t ON x.l_orderkey = t.l_orderkey AND x.f = 'R' AND t.f = 'A')
SELECT l_orderkey, CAST(annotation AS BIGINT) AS annotation, CAST(target AS BIGINT) AS target FROM c WHERE place = 1""")
def nearest_table(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest table of each annotation: the last before it or the first after it, by two running values."""
    w = Window.partitionBy("l_orderkey").orderBy("n")
    target = F.when(F.col("l_returnflag") == "A", F.col("n"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_linenumber").alias("n")).distinct()
    rows = rows.select("l_orderkey", "l_returnflag", "n", F.max(target).over(w.rangeBetween(Window.unboundedPreceding, 0)).alias("before"), F.min(target).over(w.rangeBetween(0, Window.unboundedFollowing)).alias("after"))
    near = F.when(F.col("after").isNull() | (F.col("n") - F.col("before") <= F.col("after") - F.col("n")), F.col("before")).otherwise(F.col("after"))
    return rows.where("l_returnflag = 'R'").select("l_orderkey", F.col("n").cast("long").alias("annotation"), near.cast("long").alias("target")).where("target is not null")


@query("""WITH c AS (SELECT l_orderkey AS table_id, unnest(range(l_linenumber, l_linenumber + 2)) AS r, l_suppkey % 3 AS c FROM lineitem)
SELECT table_id, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, count(*) AS n FROM c GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def grid_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Grid places that several spanning cells take."""
    cells = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.explode(F.sequence(F.col("l_linenumber").cast("long"), F.col("l_linenumber").cast("long") + 1)).alias("r"), (F.col("l_suppkey") % 3).alias("c"))
    return cells.groupBy("table_id", "r", "c").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_returnflag, lag(l_returnflag) OVER w AS pf, lag(l_linenumber) OVER w AS pn FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS fragment, CAST(sum(CASE WHEN pf = l_returnflag AND pn + 1 = l_linenumber THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) AS BIGINT) AS logical_table FROM p""")
def table_continuation(spark: SparkSession, sf: str) -> DataFrame:
    """Fragments of one table: same header as the fragment on the page before."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    goes_on = (F.lag("l_returnflag").over(w) == F.col("l_returnflag")) & (F.lag("l_linenumber").over(w) + 1 == F.col("l_linenumber"))
    fragments = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"))
    rows = fragments.select("l_orderkey", "l_linenumber", F.when(goes_on, 0).otherwise(1).alias("new"))
    return rows.select("l_orderkey", F.col("l_linenumber").cast("long").alias("fragment"), F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("logical_table"))


@query(f"SELECT source, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars, count(*) FILTER (line = '') AS n_blank, count(DISTINCT doc_id) AS n_pages FROM ({_LINES}) GROUP BY source")
def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of what each source's documents hold."""
    return lines(spark, sf).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_chars"), F.count_if(F.col("line") == "").alias("n_blank"), F.count_distinct("doc_id").alias("n_pages")
    )


@query(f"SELECT doc_id, CAST(sum(length(line)) AS BIGINT) AS n_chars, CAST(sum(length(line) * (CASE WHEN order_index < 3 THEN 1 ELSE 0 END)) AS BIGINT) AS n_head FROM ({_LINES}) GROUP BY doc_id")
def chars_per_page(spark: SparkSession, sf: str) -> DataFrame:
    """Characters by page, without exploding the lines."""
    parts = F.split("text", "\n", -1)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    return table(spark, sf, "documents").select("doc_id", total(parts).alias("n_chars"), total(F.slice(parts, 1, 3)).alias("n_head"))


@query("SELECT l_orderkey AS page_id, round(least(1.0, sum(l_discount * l_quantity / 10)), 6) AS coverage FROM lineitem GROUP BY 1")
def capped_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """The share of a page that images cover, at most all."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.round(F.least(F.lit(1.0), F.sum(F.col("l_discount") * F.col("l_quantity") / 10)), 6).alias("coverage"))


@query("""SELECT l_orderkey AS id, bool_or(l_returnflag = 'A') AS directly_supported, count(*) FILTER (l_returnflag = 'A') AS n_direct, CASE WHEN bool_or(l_returnflag = 'A') THEN 'accept' ELSE 'withhold' END AS gate FROM lineitem GROUP BY 1""")
def direct_support_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Claims pass with at least one direct support."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.bool_or(F.col("l_returnflag") == "A").alias("directly_supported"), F.count_if(F.col("l_returnflag") == "A").alias("n_direct"))
    return rows.withColumn("gate", F.when(F.col("directly_supported"), "accept").otherwise("withhold"))


@query(f"""WITH f AS (SELECT doc_id, order_index, line, row_number() OVER (PARTITION BY doc_id ORDER BY order_index) - 1 AS n FROM ({_LINES}) WHERE trim(line) <> '')
SELECT doc_id, CAST(n // 4 AS BIGINT) AS unit, 'unit_' || left(sha256('analysis:' || doc_id || ':' || n // 4), 24) AS unit_id, count(*) AS n_focus, CAST(min(order_index) AS BIGINT) AS first_index FROM f GROUP BY 1, 2, n // 4""")
def analysis_units(spark: SparkSession, sf: str) -> DataFrame:
    """Focus nodes in groups of four, in order."""
    w = Window.partitionBy("doc_id").orderBy("order_index")
    rows = lines(spark, sf).where("trim(line) <> ''").select("doc_id", "order_index", F.floor((F.row_number().over(w) - 1) / 4).alias("unit"))
    grouped = rows.groupBy("doc_id", "unit").agg(F.count(F.lit(1)).alias("n_focus"), F.min("order_index").alias("first_index"))
    return grouped.select("doc_id", "unit", record_id("unit", F.lit("analysis"), "doc_id", "unit").alias("unit_id"), "n_focus", "first_index")


@query("""SELECT user_id, CAST(max_by(event_id, (ts, event_id)) AS BIGINT) AS attempt_id, max(ts) AS completed_at FROM events WHERE event_type = 'purchase' AND value > 20 GROUP BY user_id""")
def latest_valid_attempt(spark: SparkSession, sf: str) -> DataFrame:
    """The last completed attempt of each item that counts."""
    rows = table(spark, sf, "events").where("event_type = 'purchase' and value > 20")
    return rows.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("attempt_id"), F.max("ts").alias("completed_at"))


@query("""WITH e AS (SELECT user_id, count(*) FILTER (event_type = 'signup') AS s, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'error') AS f FROM events GROUP BY user_id)
SELECT c_custkey AS item_id, CASE WHEN user_id IS NULL THEN 'planned' WHEN p > 0 AND f > p THEN 'failed' WHEN p > 0 THEN 'succeeded' WHEN f > 0 THEN 'failed' WHEN s > 0 THEN 'running' ELSE 'planned' END AS status FROM customer LEFT JOIN e ON c_custkey = user_id""")
def coverage_report(spark: SparkSession, sf: str) -> DataFrame:
    """Where each planned item stands."""
    n = lambda kind, name: F.count_if(F.col("event_type") == kind).alias(name)
    runs = table(spark, sf, "events").groupBy("user_id").agg(n("signup", "s"), n("purchase", "p"), n("error", "f"))
    rows = table(spark, sf, "customer").join(runs, F.col("c_custkey") == F.col("user_id"), "left")
    status = F.when(F.col("user_id").isNull(), "planned").when((F.col("p") > 0) & (F.col("f") > F.col("p")), "failed").when(F.col("p") > 0, "succeeded").when(F.col("f") > 0, "failed").when(F.col("s") > 0, "running").otherwise("planned")
    return rows.select(F.col("c_custkey").alias("item_id"), status.alias("status"))


@query("""SELECT o_custkey AS item_id, bool_and(o_orderstatus <> 'P') AS resolved, count(*) AS n_children FROM orders GROUP BY 1""")
def split_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """A split item is resolved if all its children are."""
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("item_id")).agg(F.bool_and(F.col("o_orderstatus") != "P").alias("resolved"), F.count(F.lit(1)).alias("n_children"))


@query("""SELECT o_custkey AS item_id, count(DISTINCT CAST(o_orderdate AS DATE)) AS n_pages, min(CAST(o_orderdate AS DATE)) AS first_page FROM orders GROUP BY 1""")
def represented_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct pages that the units of each item touch."""
    day = F.to_date("o_orderdate")
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("item_id")).agg(F.count_distinct(day).alias("n_pages"), F.min(day).alias("first_page"))


@query("""SELECT doc_id, 'src_' || left(sha256(source), 24) AS source_id, 'cap_' || left(sha256(source || ':' || sha256(text)), 24) AS capture_id FROM documents""")
def capture_identity(spark: SparkSession, sf: str) -> DataFrame:
    """The ids that a capture gives rise to."""
    return table(spark, sf, "documents").select("doc_id", record_id("src", "source").alias("source_id"), record_id("cap", "source", F.sha2("text", 256)).alias("capture_id"))


@query("""SELECT o_custkey AS source_id, CAST(o_orderdate AS DATE) AS version, count(DISTINCT o_totalprice) AS n_contents FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_totalprice) > 1""")
def version_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Versions with different contents."""
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("source_id"), F.to_date("o_orderdate").alias("version")).agg(F.count_distinct("o_totalprice").alias("n_contents"))
    return rows.where("n_contents > 1")


@query("""SELECT * FROM (SELECT o_orderkey AS later_id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS earlier_id, 'update' AS kind FROM orders) WHERE earlier_id IS NOT NULL""")
def revision_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Each version and the one that it replaces."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("later_id"), F.lag("o_orderkey").over(w).alias("earlier_id"), F.lit("update").alias("kind")).where("earlier_id is not null")
