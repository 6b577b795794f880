"""What may be done with a provider's texts, as of a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import rights
from quillstone.registry import query
from quillstone.sources.tables import table

# An order is what its customer, as a provider, allows from its date on: signals by priority, an embargo while it is pending, and an entitlement that ends while it is open.
_SIGNALS = {"1-URGENT": ["news:Restricted"], "2-HIGH": ["x:No-Model", "no-log"], "3-MEDIUM": ["redistributable"], "5-LOW": ["no-embed", "vendor:area:no-index"]}
_PURPOSE = {"R": "model_context", "A": "archive", "N": "body_text"}
_NEW_POLICY = "1996-06-01"

_PURPOSE_ROWS = ", ".join(f"('{p}')" for p in rights.PURPOSES)
_GONE = " ".join(f"WHEN '{s}' THEN '{p}'" for s, p in rights.WITHDRAWN.items())
_SIGNAL_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _SIGNALS.items()) + " ELSE []::VARCHAR[] END"
_HISTORY = f"""WITH f AS (SELECT o_orderkey, o_custkey, o_orderdate, {_SIGNAL_SQL} AS signals, CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL 40 DAY END AS embargo_until, CASE WHEN o_orderstatus = 'O' THEN o_orderdate + INTERVAL 400 DAY END AS entitlement_expires_at,
o_totalprice >= 1000 AS archive_permitted, CASE WHEN o_orderdate < TIMESTAMP '{_NEW_POLICY}' THEN 'rights-policy-v0' ELSE '{rights.POLICY}' END AS policy FROM orders),
s AS (SELECT *, [lower(regexp_replace(x, '^.*:', '')) for x in signals] AS suffix FROM f),
p AS (SELECT o_orderkey, string_agg(purpose, ',' ORDER BY purpose) AS purposes FROM s, (VALUES {_PURPOSE_ROWS}) v(purpose) WHERE archive_permitted
 AND (purpose <> 'public_fixture' OR list_has_any(suffix, ['public-fixture', 'redistributable'])) AND (purpose IN ('archive', 'diagnostic', 'review') OR NOT (embargo_until IS NOT NULL OR list_has_any(suffix, ['restricted', 'withheld'])))
 AND NOT list_contains([CASE x {_GONE} ELSE '' END for x in suffix], purpose) GROUP BY 1),
h AS (SELECT s.*, coalesce(purposes, '') AS purposes FROM s LEFT JOIN p ON p.o_orderkey = s.o_orderkey)"""


def _history(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles by provider and time; of one time the greatest order counts."""
    signals = F.element_at(F.create_map(*[x for k, v in _SIGNALS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("o_orderpriority"))
    later = lambda status, days: F.when(F.col("o_orderstatus") == status, F.col("o_orderdate") + F.make_dt_interval(F.lit(days)))
    facts = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("provider"), F.col("o_orderdate").alias("evaluated_at"), signals.alias("signals"), later("P", 40).alias("embargo_until"), later("O", 400).alias("entitlement_expires_at"),
        (F.col("o_totalprice") >= 1000).alias("archive_permitted"), F.when(F.col("o_orderdate") < F.lit(_NEW_POLICY).cast("timestamp_ntz"), "rights-policy-v0").otherwise(rights.POLICY).alias("policy"),
    )
    return rights.profiles(facts)


def _uses(spark: SparkSession, sf: str) -> DataFrame:
    """Each line is a use of what its customer provides, when it is shipped."""
    own = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("provider"))
    purpose = F.element_at(F.create_map(*[F.lit(x) for pair in _PURPOSE.items() for x in pair]), F.col("l_returnflag"))
    rows = table(spark, sf, "lineitem").join(own, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("provider", purpose.alias("purpose"), F.col("l_shipdate").alias("at"), "l_orderkey", F.col("l_linenumber").cast("long").alias("line"))


_DECISION = """CASE WHEN h.o_orderkey IS NULL THEN 'no_profile' WHEN policy <> 'rights-policy-v1' THEN 'rights_policy_mismatch' WHEN entitlement_expires_at <= u.at THEN 'entitlement_expired'
WHEN embargo_until > u.at AND u.purpose NOT IN ('archive', 'diagnostic', 'review') THEN 'embargo_active' WHEN NOT list_contains(string_split(purposes, ','), u.purpose) THEN 'purpose_not_permitted' ELSE 'permitted' END"""
_AUTHORIZED = f"""{_HISTORY}, one AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) = 1),
u AS (SELECT o_custkey AS provider, {{purpose}} AS purpose, l_shipdate AS at, l_orderkey, CAST(l_linenumber AS BIGINT) AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT u.l_orderkey, u.line, {_DECISION} AS decision FROM u ASOF LEFT JOIN one h ON u.provider = h.o_custkey AND u.at >= h.o_orderdate"""


@query(f"{_HISTORY} SELECT o_orderkey, CASE WHEN NOT archive_permitted THEN 'archive_not_permitted' END AS refused, purposes FROM h")
def rights_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The purposes that a provider's signals leave, by set algebra."""
    return _history(spark, sf).select("o_orderkey", "refused", F.array_join("purposes", ",").alias("purposes"))


@query(_AUTHORIZED.format(purpose="CASE l_returnflag WHEN 'R' THEN 'model_context' WHEN 'A' THEN 'archive' ELSE 'body_text' END"))
def rights_authorize(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a use is allowed, by the profile that was valid at its time."""
    return rights.authorize(_uses(spark, sf), _history(spark, sf)).select("l_orderkey", "line", "decision")


@query(f"SELECT l_orderkey, line, decision = 'permitted' AS planned, decision AS reason FROM ({_AUTHORIZED.format(purpose=chr(39) + 'model_context' + chr(39))})")
def rights_gated_plan(spark: SparkSession, sf: str) -> DataFrame:
    """What may be shown to a model at its time."""
    uses = _uses(spark, sf).withColumn("purpose", F.lit("model_context"))
    return rights.authorize(uses, _history(spark, sf)).select("l_orderkey", "line", (F.col("decision") == "permitted").alias("planned"), F.col("decision").alias("reason"))
