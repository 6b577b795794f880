"""Process metrics, scorecards, receipts and state machines over event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.operators import graph
from quillstone.registry import query
from quillstone.sources.tables import date_text, table


@query("""SELECT user_id, count(*) AS n_events, count(DISTINCT event_type) AS n_kinds, count(*) FILTER (event_type = 'error') AS n_errors,
strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS first_at, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS last_at, CAST(epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))) AS BIGINT) AS seconds FROM events GROUP BY user_id""")
def event_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and times of each key's events."""
    rows = table(spark, sf, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_distinct("event_type").alias("n_kinds"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.min("ts").alias("a"), F.max("ts").alias("b")
    )
    seconds = F.unix_timestamp(F.col("b").cast("timestamp")) - F.unix_timestamp(F.col("a").cast("timestamp"))
    return rows.select("user_id", "n_events", "n_kinds", "n_errors", date_text("a").alias("first_at"), date_text("b").alias("last_at"), seconds.alias("seconds"))


@query("""WITH s AS (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events WHERE event_type IN ('error', 'purchase'))
SELECT user_id, count(*) FILTER (event_type = 'error' AND next = 'purchase') AS n_repairs, count(*) FILTER (event_type = 'error') AS n_failures FROM s GROUP BY user_id""")
def repair_history(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of failures that a success ended: each has just one failure with a success right after it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf, "events").where(F.col("event_type").isin("error", "purchase")).select("user_id", "event_type", F.lead("event_type").over(w).alias("next"))
    failed = F.col("event_type") == "error"
    return rows.groupBy("user_id").agg(F.count_if(failed & (F.col("next") == "purchase")).alias("n_repairs"), F.count_if(failed).alias("n_failures"))


_DIMENSIONS = """SELECT user_id, least(100.0, count(*) * 1.0) AS activity, 100.0 * count(*) FILTER (event_type = 'purchase') / count(*) AS success,
100.0 - 100.0 * count(*) FILTER (event_type = 'error') / count(*) AS health, CASE WHEN count(*) FILTER (event_type = 'signup') > 0 THEN 100.0 * least(1.0, count(*) FILTER (event_type = 'view') / count(*) FILTER (event_type = 'signup')::DOUBLE) END AS reach FROM events GROUP BY user_id"""
_SCORES = f"""SELECT user_id, CAST(floor((0.4 * success + 0.3 * health + 0.2 * activity + coalesce(0.1 * reach, 0)) / (0.9 + CASE WHEN reach IS NULL THEN 0 ELSE 0.1 END) * 10 + 0.5) AS BIGINT) AS score_tenths, reach IS NOT NULL AS complete FROM ({_DIMENSIONS})"""


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), n("purchase").alias("p"), n("error").alias("e"), n("signup").alias("s"), n("view").alias("v"))
    part = lambda share, value: (share, share / 10 * value)
    weighed = [
        part(4, 100.0 * F.col("p") / F.col("n")),
        part(3, 100.0 - 100.0 * F.col("e") / F.col("n")),
        # An exact decimal, rounded once: 0.2 as a double times the count is off by a last place for some counts (96, 56), which halves show.
        (2, F.least(F.lit(100), F.col("n")) * 2 / 10),
        part(1, F.when(F.col("s") > 0, 100.0 * F.least(F.lit(1.0), F.try_divide(F.col("v"), F.col("s"))))),
    ]
    # Weights add up in whole tenths: as doubles 0.4 + 0.3 + 0.2 is less than 0.9, and halves would be rounded up that aren't.
    total, tenths = F.lit(0.0), F.lit(0)
    for share, value in weighed:
        total = total + F.coalesce(value, F.lit(0.0))
        tenths = tenths + F.when(value.isNotNull(), share).otherwise(0)
    return rows.select("user_id", F.floor(total / (tenths / 10) * 10 + 0.5).alias("score_tenths"), (F.col("s") > 0).alias("complete"))


@query(_SCORES)
def scorecard(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted means of the dimensions that are known, rounded half up."""
    return _scores(spark, sf)


@query(f"""WITH s AS (SELECT coalesce(c_mktsegment, 'none') AS team, x.* FROM ({_SCORES}) x LEFT JOIN customer ON c_custkey = user_id)
SELECT user_id, team, CAST(row_number() OVER (PARTITION BY team ORDER BY complete DESC, score_tenths DESC, user_id) AS BIGINT) AS rank, max(score_tenths) OVER (PARTITION BY team) - score_tenths AS behind FROM s""")
def scorecard_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks within each team, the segment of the market, and distances to its best. Places are numbered over ranges of all rows, so that no team is put in order in one task."""
    teams = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    scores = _scores(spark, sf).join(teams, F.col("user_id") == F.col("c_custkey"), "left")
    rows = scores.select("user_id", F.coalesce("c_mktsegment", F.lit("none")).alias("team"), "score_tenths", (~F.col("complete")).alias("open"), (-F.col("score_tenths")).alias("less"))
    placed = graph.numbered(rows, ["team", "open", "less", "user_id"], "place")
    first = placed.groupBy(F.col("team").alias("t")).agg(F.min("place").alias("first"), F.max("score_tenths").alias("best"))
    return placed.join(first, F.col("team") == F.col("t")).select("user_id", "team", (F.col("place") - F.col("first") + 1).alias("rank"), (F.col("best") - F.col("score_tenths")).alias("behind"))


@query("""SELECT user_id, CASE WHEN count(DISTINCT event_type) = 5 THEN 'complete' WHEN count(DISTINCT event_type) >= 3 THEN 'partial' ELSE 'incomplete' END AS state,
array_to_string(list_sort(list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda k: NOT list_contains(list(DISTINCT event_type), k))), ',') AS missing FROM events GROUP BY user_id""")
def receipt_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Which receipts are there, and which are missing."""
    need = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("have"))
    n = F.size("have")
    return rows.select("user_id", F.when(n == 5, "complete").when(n >= 3, "partial").otherwise("incomplete").alias("state"), F.array_join(F.array_sort(F.array_except(need, "have")), ",").alias("missing"))


@query("""WITH t AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
SELECT event_id, prev AS from_state, event_type AS to_state FROM t WHERE prev IS NOT NULL AND (prev, event_type) NOT IN (('signup', 'view'), ('view', 'click'), ('click', 'purchase'), ('error', 'view'), ('view', 'view'), ('click', 'view'))""")
def illegal_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """Steps that the state machine doesn't allow."""
    allowed = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("error", "view"), ("view", "view"), ("click", "view")]
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf, "events").select("event_id", F.lag("event_type").over(w).alias("from_state"), F.col("event_type").alias("to_state"))
    step = F.concat_ws(">", "from_state", "to_state")
    return rows.where(F.col("from_state").isNotNull() & ~step.isin(*[">".join(a) for a in allowed]))


@query("""SELECT p_brand AS task, count(*) AS n_files, CAST(sum(p_size) AS BIGINT) AS n_lines, sum(p_size) > 1500 OR count(*) > 90 AS over_budget FROM part GROUP BY 1""")
def path_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Files and lines of each task against its budget."""
    rows = table(spark, sf, "part").groupBy(F.col("p_brand").alias("task")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("p_size").cast("long").alias("n_lines"))
    return rows.withColumn("over_budget", (F.col("n_lines") > 1500) | (F.col("n_files") > 90))


@query("""WITH r AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS failed FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT o_orderkey AS check_id, CASE WHEN n IS NULL THEN 'missing' WHEN failed > 0 THEN 'failed' WHEN n > 4 THEN 'duplicate' ELSE 'passed' END AS state FROM orders LEFT JOIN r ON o_orderkey = l_orderkey""")
def check_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Planned checks against the records of their runs."""
    runs = table(spark, sf, "lineitem").where("l_linestatus = 'F'").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("failed"))
    rows = table(spark, sf, "orders").join(runs, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    state = F.when(F.col("n").isNull(), "missing").when(F.col("failed") > 0, "failed").when(F.col("n") > 4, "duplicate").otherwise("passed")
    return rows.select(F.col("o_orderkey").alias("check_id"), state.alias("state"))


@query("""SELECT c_mktsegment AS goal, bool_and(c_acctbal > -900) AS met, count(*) FILTER (c_acctbal <= -900) AS n_deferred FROM customer GROUP BY 1""")
def goal_report(spark: SparkSession, sf: str) -> DataFrame:
    """Which goals are met, and what is deferred."""
    return table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("goal")).agg(F.bool_and(F.col("c_acctbal") > -900).alias("met"), F.count_if(F.col("c_acctbal") <= -900).alias("n_deferred"))


@query("""SELECT o_custkey AS task_id, array_to_string(list_sort(list_filter(['1-URGENT', '2-HIGH', '3-MEDIUM'], lambda k: NOT list_contains(list(DISTINCT o_orderpriority), k))), ',') AS missing FROM orders GROUP BY 1""")
def phase_readiness(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds that a phase requires and a task lacks."""
    need = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM")))
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("task_id")).agg(F.collect_set("o_orderpriority").alias("have"))
    return rows.select("task_id", F.array_join(F.array_sort(F.array_except(need, "have")), ",").alias("missing"))


@query("""SELECT event_type AS kind, count(*) AS n, count(DISTINCT user_id) AS n_subjects, round(avg(value), 6) AS mean_value FROM events GROUP BY 1""")
def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of records by kind."""
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_subjects"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("""SELECT event_id, sha256(event_id || ':' || event_type || ':' || user_id) AS digest, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'passed' ELSE 'recorded' END AS outcome FROM events""")
def evidence_index(spark: SparkSession, sf: str) -> DataFrame:
    """Records of the log with their digests and outcomes."""
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "passed").otherwise("recorded")
    return table(spark, sf, "events").select("event_id", F.sha2(F.concat_ws(":", "event_id", "event_type", "user_id"), 256).alias("digest"), outcome.alias("outcome"))
