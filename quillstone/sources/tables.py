"""The tables of a folder and the record views that the operators work on.

A view derives the typed records of one kind from the tables. Nothing here is
cached or collected; each function only adds to the logical plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table; filters and columns are pushed into its scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def date_text(c: str | Column) -> Column:
    """An instant as ISO text in UTC."""
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval units: one per document, in document order."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("unit_"), F.substring(F.sha2(F.concat_ws(":", F.lit("unit-v1"), "doc_id", F.sha2("text", 256)), 256), 1, 24)).alias("unit_id"), F.col("doc_id").alias("source_order"), "text", "lang", "source")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document nodes: the lines of each document in order."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("order_index", "line")).withColumn("order_index", F.col("order_index").cast("long"))


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims: one per order line, with the supplier as subject and the part as object."""
    rows = table(spark, sf_dir, "lineitem")
    confidence = F.round(F.greatest(F.lit(0.0), 1 - 5 * F.col("l_discount")), 4)
    return rows.select(
        F.concat_ws("-", F.lit("ast"), "l_orderkey", "l_linenumber").alias("id"),
        F.concat_ws("-", F.lit("org"), "l_suppkey").alias("subject_id"),
        F.concat_ws("-", F.lit("ent"), "l_partkey").alias("object_id"),
        F.concat_ws("-", F.lit("out"), "l_orderkey").alias("outcome_id"),
        F.when(F.col("l_returnflag") == "R", "analytic_inference").when(F.col("l_returnflag") == "A", "reported_claim").otherwise("source_statement").alias("scope"),
        F.when(F.col("l_linestatus") == "O", "proposed").otherwise("accepted").alias("status"),
        confidence.alias("confidence"),
        F.col("l_shipdate").alias("updated_at"),
        "l_orderkey",
        "l_suppkey",
        "l_partkey",
        "l_linenumber",
    )


#: The SQL of ``assertions`` for oracles.
ASSERTIONS_SQL = """SELECT 'ast-' || l_orderkey || '-' || l_linenumber AS id, 'org-' || l_suppkey AS subject_id, 'ent-' || l_partkey AS object_id,
'out-' || l_orderkey AS outcome_id, CASE l_returnflag WHEN 'R' THEN 'analytic_inference' WHEN 'A' THEN 'reported_claim' ELSE 'source_statement' END AS scope,
CASE WHEN l_linestatus = 'O' THEN 'proposed' ELSE 'accepted' END AS status, round(greatest(0.0, 1 - 5 * l_discount), 4) AS confidence,
l_shipdate AS updated_at, l_orderkey, l_suppkey, l_partkey, l_linenumber FROM lineitem"""

#: Review states by order status, and the rank in which record types are reviewed.
REVIEW_STATUS = {"O": "pending", "F": "accepted", "P": "rejected"}
TYPE_RANK = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 3, "5-LOW": 4}


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals under review: one per order."""
    orders = table(spark, sf_dir, "orders")
    status = F.lit("edited")
    for code, name in REVIEW_STATUS.items():
        status = F.when(F.col("o_orderstatus") == code, name).otherwise(status)
    rank = F.lit(7)
    for kind, n in TYPE_RANK.items():
        rank = F.when(F.col("o_orderpriority") == kind, n).otherwise(rank)
    return orders.select(F.concat(F.lit("prop-"), "o_orderkey").alias("id"), status.alias("review_status"), F.col("o_orderpriority").alias("record_type"), rank.alias("type_rank"), F.concat(F.lit("order-"), "o_custkey").alias("label"), "o_custkey", "o_orderkey", F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("value"))


PROPOSALS_SQL = """SELECT 'prop-' || o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'accepted' WHEN 'P' THEN 'rejected' ELSE 'edited' END AS review_status,
o_orderpriority AS record_type, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 WHEN '5-LOW' THEN 4 ELSE 7 END AS type_rank,
'order-' || o_custkey AS label, o_custkey, o_orderkey, o_orderdate AS created_at, o_totalprice AS value FROM orders"""
