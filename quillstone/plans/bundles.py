"""Integrity of documents with their parts, and quotes and hits against their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.operators import bundles, graph, quotes
from quillstone.plans.contexts import PLAIN_LINE, SYMBOLS
from quillstone.registry import query
from quillstone.sources.tables import lines, table

#: Lines of a page.
PAGE = 40
_LINES = "SELECT doc_id, n_chars, text, unnest(string_split(text, chr(10))) AS line, CAST(unnest(range(len(string_split(text, chr(10))))) AS BIGINT) AS node FROM documents"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as nodes of their document, with where they begin and end, the next one, their digests trimmed and of when lines had no symbols.

    Lines are digested where they are read, so no text is shuffled, and written once for all the rules that look at them.
    """
    docs = table(spark, sf, "documents")
    n = docs.agg(F.sum(F.size(F.split("text", "\n", -1)))).first()[0] or 0
    rows = lines(spark, sf).select(
        F.col("doc_id").alias("bundle"), F.col("order_index").cast("string").alias("node"), "order_index", F.length("line").cast("long").alias("chars"), (F.trim("line") == "").alias("blank"),
        F.sha2(F.regexp_replace("line", SYMBOLS, ""), 256).alias("digest"), F.when(F.col("order_index") == 0, F.sha2(F.trim("line"), 256)).alias("trimmed"),
    )
    w = Window.partitionBy("bundle").orderBy("order_index")
    begin = F.coalesce(F.sum(F.col("chars") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    rows = graph.dealt(rows, n, "bundle").withColumns({"start_char": begin, "next": F.lead("node").over(w)})
    return graph.durable(rows.withColumns({"end_char": F.col("start_char") + F.col("chars"), "page": F.floor(F.col("order_index") / PAGE).cast("int")}))


def _views(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.explode(F.array(F.lit("logical"), F.lit("display")))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("bundle"), kinds.alias("kind"), "text").withColumn("view", F.col("kind"))


@query(f"""SELECT doc_id AS bundle, 'other_digest' AS rule, node::VARCHAR AS child FROM ({_LINES}) WHERE {PLAIN_LINE} <> line
UNION ALL SELECT doc_id, 'out_of_range', 'root' FROM documents WHERE n_chars > length(text)
UNION ALL SELECT doc_id, 'other_selector_digest', '0' FROM ({_LINES}) WHERE node = 0 AND trim(line) <> line UNION ALL SELECT doc_id, 'selector_without_node', 'root-' || quality FROM labels WHERE toxic = 1 AND doc_id IN (SELECT doc_id FROM documents)
UNION ALL SELECT doc_id, 'selectors_without_bundle', 'root-' || quality FROM labels WHERE toxic = 1 AND doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'selector_without_node', 'root-' || quality FROM labels WHERE toxic = 1 AND doc_id NOT IN (SELECT doc_id FROM documents)""")
def bundle_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """Rules that documents and their lines, regions, edges and selectors break against texts as they are."""
    docs, own = table(spark, sf, "documents"), _lines(spark, sf)
    root = docs.select(F.col("doc_id").alias("bundle"), F.lit("root").alias("node"), F.lit("logical").alias("view"), F.lit(None).cast("string").alias("parent"), F.lit("document").alias("node_type"), F.lit(0).cast("long").alias("start_char"), F.col("n_chars").alias("end_char"), F.array().cast("array<string>").alias("regions"), F.array().cast("array<int>").alias("pages"), F.lit(None).cast("string").alias("digest"))
    region = F.concat(F.lit("r"), "node")
    nodes = own.select("bundle", "node", F.when(F.col("blank"), "display").otherwise("logical").alias("view"), F.lit("root").alias("parent"), F.when(F.col("blank"), "furniture").otherwise("paragraph").alias("node_type"), "start_char", "end_char", F.array(region).alias("regions"), F.array("page").alias("pages"), "digest")
    zero = F.lit(0.0)
    regions = own.select("bundle", region.alias("region"), "page", zero.alias("left"), F.col("order_index").cast("double").alias("top"), F.col("chars").cast("double").alias("right"), (F.col("order_index") + 1.0).alias("bottom"))
    edges = own.select("bundle", F.concat(F.lit("e"), "node").alias("edge"), F.col("node").alias("src"), F.col("next").alias("dst")).where("dst is not null")
    heads = own.where("order_index = 0").select("bundle", "node", F.col("trimmed").alias("digest"))
    marked = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("bundle"), F.concat(F.lit("root-"), "quality").alias("node"), F.lit("").alias("digest"))
    return bundles.violations(_views(spark, sf), nodes.union(root), regions, edges, heads.union(marked), docs.select(F.col("doc_id").alias("bundle")))


@query(f"SELECT doc_id, node AS order_index, CASE WHEN {PLAIN_LINE} <> line THEN 'hit_digest_mismatch' ELSE 'none' END AS fault FROM ({_LINES}) WHERE line <> ''")
def hit_verification(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a hit's node still has the text that was indexed, when lines had no symbols."""
    own = _lines(spark, sf)
    hits = own.where("chars > 0").select(F.struct("bundle", "order_index").alias("hit"), "bundle", "node", "digest")
    nodes = own.select("bundle", "node", F.lit("logical").alias("view"), "start_char", "end_char")
    found = bundles.hit_faults(hits, _views(spark, sf).where("kind = 'logical'"), nodes)
    return found.select(F.col("hit.bundle").alias("doc_id"), F.col("hit.order_index").alias("order_index"), F.coalesce("fault", F.lit("none")).alias("fault"))


@query("SELECT doc_id, substr(text, 11, 30) AS span, sha256(substr(text, 11, 30)) AS digest FROM documents")
def span_text(spark: SparkSession, sf: str) -> DataFrame:
    """The text of a span of code points, or what there is of it."""
    span = F.substring("text", 11, 30)
    return table(spark, sf, "documents").select("doc_id", span.alias("span"), F.sha2(span, 256).alias("digest"))


@query("""WITH q AS (SELECT doc_id, text, substr(text, length(text) // 2 + 1, 6) AS exact FROM documents),
p AS (SELECT *, strpos(text, exact) AS pos FROM q), s AS (SELECT *, CASE WHEN length(exact) = 0 THEN 'empty' WHEN strpos(substr(text, pos + 1), exact) > 0 THEN 'ambiguous' ELSE 'grounded' END AS status FROM p)
SELECT doc_id, status, CASE WHEN status = 'grounded' THEN CAST(pos - 1 AS BIGINT) END AS start_char, CASE WHEN status = 'grounded' THEN CAST(pos - 1 + length(exact) AS BIGINT) END AS end_char,
CASE WHEN status = 'grounded' THEN substr(text, greatest(pos - 32, 1), pos - greatest(pos - 32, 1)) END AS prefix, CASE WHEN status = 'grounded' THEN substr(text, pos + length(exact), 32) END AS suffix FROM s""")
def quote_grounding(spark: SparkSession, sf: str) -> DataFrame:
    """The span and contexts of a short quote of each document, if it occurs just once."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    exact = F.substring(F.col("text"), (F.floor(F.length("text") / 2) + 1).cast("int"), F.lit(6))
    asked = docs.select(F.col("doc_id").alias("quote"), F.col("doc_id").alias("node"), exact.alias("exact"), F.lit(None).cast("long").alias("start"))
    nodes = docs.select(F.col("doc_id").alias("node"), F.lit(0).cast("long").alias("begin"), "text")
    return quotes.grounded(asked, nodes).withColumnRenamed("quote", "doc_id")
