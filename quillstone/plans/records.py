"""Rules over records, runs and failures, and digests of what was planned and published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.operators import machines, postings, rules
from quillstone.operators.digests import list_digest
from quillstone.plans.retrieval import TERMS_SQL, published_index
from quillstone.registry import query
from quillstone.sources.deliveries import status_state
from quillstone.sources.tables import table

#: Keys that no record may have; kinds of events are keys here.
FORBIDDEN = ["error", "authorization", "cookie", "set-cookie", "proxy-authorization"]


def _nested(spark: SparkSession, sf: str) -> DataFrame:
    """Events as JSON with their kind as a key two levels down, beside a text that looks like one."""
    inner = F.concat(F.lit('{"seen":[{"'), F.initcap("event_type"), F.lit('":'), "props", F.lit('}],"note":"\\"error\\": '), F.col("user_id").cast("string"), F.lit('"}'))
    return table(spark, sf, "events").select("event_id", inner.alias("json"))


@query("""SELECT event_id, event_type = 'error' AS forbidden FROM events""")
def secret_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a JSON record has a key of the deny list at any depth, in any case; a string that looks like one is none."""
    return _nested(spark, sf).select("event_id", rules.has_key(F.col("json"), FORBIDDEN).alias("forbidden"))


@query("""SELECT event_id, array_to_string(list_concat(['seen', upper(left(event_type, 1)) || substr(event_type, 2)], json_keys(props), ['note']), ',') AS keys FROM events""")
def json_keys(spark: SparkSession, sf: str) -> DataFrame:
    """All keys of JSON records, at any depth, in order."""
    return _nested(spark, sf).select("event_id", F.array_join(rules.keys(F.col("json")), ",").alias("keys"))


_PATHS = "SELECT page_id AS id, regexp_replace(regexp_replace(url, '^[^:]*://', ''), '[?#].*$', '', 's') AS path FROM pages"
_PATH_RULES = """SELECT split_part(path, '/', 1) || '/' AS rule, 'host' AS verdict FROM paths GROUP BY 1 HAVING count(*) > 2 UNION ALL
SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) || '/', 'section' FROM paths WHERE len(string_split(path, '/')) > 2 GROUP BY 1 HAVING count(*) > 4 UNION ALL SELECT path, 'exact' FROM paths GROUP BY 1 HAVING count(*) > 1"""


@query(f"""WITH paths AS MATERIALIZED ({_PATHS}), r AS MATERIALIZED ({_PATH_RULES}), m AS (SELECT id, path, rule, verdict FROM paths LEFT JOIN (SELECT rule, min(verdict) AS verdict FROM r GROUP BY 1) r ON path = rule OR (ends_with(rule, '/') AND starts_with(path, rule)))
SELECT id, path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict FROM m GROUP BY 1, 2""")
def path_scope(spark: SparkSession, sf: str) -> DataFrame:
    """The longest rule that each path falls under. The rules are made from the pages: their larger hosts and sections, and paths that occur twice."""
    path = F.regexp_replace(F.regexp_replace("url", "^[^:]*://", ""), r"(?s)[?#].*$", "")
    paths = table(spark, sf, "pages").select(F.col("page_id").alias("id"), path.alias("path"))
    parts = F.split("path", "/", -1)
    often = lambda rule, verdict, least: paths.where(rule.isNotNull()).groupBy(rule.alias("rule")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select("rule", F.lit(verdict).alias("verdict"))
    host = F.concat(F.get(parts, F.lit(0)), F.lit("/"))
    section = F.when(F.size(parts) > 2, F.concat(host, F.get(parts, F.lit(1)), F.lit("/")))
    table_of_rules = often(host, "host", 2).union(often(section, "section", 4)).union(often(F.col("path"), "exact", 1))
    return rules.longest_rule(paths, table_of_rules)


_FACTS = {"signup": "called", "view": "archived", "click": "parsed", "purchase": "published", "error": "failed"}
_FACT_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _FACTS.items()) + " END"
_STEPS = ", ".join(f"('{s}', '{f}', '{to}')" for (s, f), to in machines.EXTRACTION.steps.items())


@query(f"""WITH RECURSIVE steps(state, fact, onward) AS (VALUES {_STEPS}), e AS MATERIALIZED (SELECT user_id, {_FACT_SQL} AS fact, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
w AS (SELECT DISTINCT user_id, 0::BIGINT AS i, n, '{machines.EXTRACTION.start}' AS state, 0::BIGINT AS off FROM e UNION ALL
SELECT w.user_id, e.i, w.n, coalesce(onward, w.state), w.off + CASE WHEN onward IS NULL THEN 1 ELSE 0 END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1 LEFT JOIN steps ON steps.state = w.state AND steps.fact = e.fact)
SELECT user_id, state, n AS n_facts, off AS n_out_of_order FROM w WHERE i = n""")
def run_status(spark: SparkSession, sf: str) -> DataFrame:
    """Where each user's run of extractions stands after all facts in order."""
    fact = F.element_at(F.create_map(*[F.lit(x) for pair in _FACTS.items() for x in pair]), F.col("event_type"))
    facts = table(spark, sf, "events").select("user_id", "ts", "event_id", fact.alias("fact"))
    return machines.final_states(facts, machines.EXTRACTION, "user_id", ["ts", "event_id"], "fact", F.date_trunc("week", "ts"))


@query("""SELECT event_id AS id, CASE WHEN floor(value) IN (401, 403) THEN 'blocked_entitlement' WHEN floor(value) = 429 THEN 'blocked_rate_limit' WHEN floor(value) >= 500 THEN 'failed' ELSE 'continue' END AS state FROM events""")
def delivery_status(spark: SparkSession, sf: str) -> DataFrame:
    """What a status code means for a delivery."""
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), status_state(F.floor("value")).alias("state"))


# The stage of each failure, and whether trying again may help.
FAILURES = {"entitlement_required": ("delivery", False), "rate_limited": ("delivery", True), "provider_unavailable": ("delivery", True), "malformed_payload": ("parse", False), "publish_failed": ("publish", True)}


@query("""SELECT event_id AS attempt_id, code, CASE code WHEN 'malformed_payload' THEN 'parse' WHEN 'publish_failed' THEN 'publish' ELSE 'delivery' END AS stage, code IN ('rate_limited', 'provider_unavailable', 'publish_failed') AS retryable FROM
(SELECT event_id, CASE WHEN floor(value) IN (401, 403) THEN 'entitlement_required' WHEN floor(value) = 429 THEN 'rate_limited' WHEN floor(value) >= 500 THEN 'provider_unavailable' WHEN NOT json_valid(props) THEN 'malformed_payload' WHEN event_type = 'error' THEN 'publish_failed' END AS code FROM events) WHERE code IS NOT NULL""")
def failure_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Typed failures of attempts, with their stage and whether trying again may help."""
    state = status_state(F.floor("value"))
    code = F.when(state == "blocked_entitlement", "entitlement_required").when(state == "blocked_rate_limit", "rate_limited").when(state == "failed", "provider_unavailable")
    code = code.when(F.try_parse_json("props").isNull(), "malformed_payload").when(F.col("event_type") == "error", "publish_failed")
    known = F.create_map(*[x for k, (stage, again) in FAILURES.items() for x in (F.lit(k), F.struct(F.lit(stage).alias("stage"), F.lit(again).alias("retryable")))])
    rows = table(spark, sf, "events").select(F.col("event_id").alias("attempt_id"), code.alias("code")).where("code is not null")
    return rows.withColumn("is", F.element_at(known, F.col("code"))).select("attempt_id", "code", "is.stage", "is.retryable")


@query("""SELECT l.doc_id AS id, CASE WHEN d.doc_id IS NULL OR trim(d.text) = '' THEN 'original_missing' ELSE 'accepted_missing' END AS rule FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id LEFT JOIN embeddings e ON e.vec_id = l.doc_id
WHERE d.doc_id IS NULL OR trim(d.text) = '' OR e.vec_id IS NULL""")
def review_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Reviewed records that don't keep both what they were, a text, and what was accepted, a vector."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("d"), (F.trim("text") != "").alias("said"))
    vectors = table(spark, sf, "embeddings").select("vec_id")
    rows = table(spark, sf, "labels").join(docs, F.col("doc_id") == F.col("d"), "left").join(vectors, F.col("doc_id") == F.col("vec_id"), "left")
    broken = rules.first_broken({"original_missing": F.col("said"), "accepted_missing": F.col("vec_id").isNotNull()})
    return rows.select(F.col("doc_id").alias("id"), broken.alias("rule")).where("rule <> 'none'")


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '(?im)^\s*source type: synthetic news fixture\s*$') THEN 'article' ELSE 'manual_file' END AS source_type FROM documents")
def source_type(spark: SparkSession, sf: str) -> DataFrame:
    """What kind of source a text says it is, by a line of its own."""
    return table(spark, sf, "documents").select("doc_id", inferred_type(F.col("text")).alias("source_type"))


def inferred_type(text: Column) -> Column:
    """The type of source by the marker line; a null text is a manual file."""
    return F.when(text.rlike(r"(?im)^\s*source type: synthetic news fixture\s*$"), "article").otherwise("manual_file")


@query("SELECT o_custkey AS plan_id, count(*) AS n_units, 'plan_' || left(sha256(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR)), 24) AS digest FROM orders GROUP BY 1")
def freeze_plan(spark: SparkSession, sf: str) -> DataFrame:
    """A plan's units, fixed by the digest of all their ids in order."""
    own = list_digest(table(spark, sf, "orders"), "o_custkey", "o_orderkey")
    return own.select(F.col("o_custkey").alias("plan_id"), F.col("n").alias("n_units"), F.concat(F.lit("plan_"), F.substring("digest", 1, 24)).alias("digest"))


@query("SELECT label, count(*) AS n_units, sha256(string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id::VARCHAR)) AS manifest FROM embeddings GROUP BY 1")
def index_publish(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest that an index is published under: the digest of all its units in order."""
    return list_digest(table(spark, sf, "embeddings"), "label", "vec_id").select("label", F.col("n").alias("n_units"), F.col("digest").alias("manifest"))


@query(r"""WITH t AS (SELECT page_id, regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1) AS tags FROM pages), e AS (SELECT page_id, lower(unnest(tags)) AS tag, unnest(range(len(tags))) AS i FROM t)
SELECT page_id, CAST(i AS BIGINT) AS place, tag || '[' || row_number() OVER (PARTITION BY page_id, tag ORDER BY i) || ']' AS path FROM e""")
def element_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of all elements, each by its tag's running counter."""
    tags = F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))
    rows = table(spark, sf, "pages").select("page_id", F.posexplode(tags).alias("place", "tag")).select("page_id", F.col("place").cast("long").alias("place"), F.lower("tag").alias("tag"))
    n = F.row_number().over(Window.partitionBy("page_id", "tag").orderBy("place"))
    return rows.select("page_id", "place", F.concat("tag", F.lit("["), n, F.lit("]")).alias("path"))


@query("""SELECT coalesce(d.doc_id, e.vec_id) AS unit, CASE WHEN e.vec_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'orphan' WHEN n > 1 THEN 'repeated' ELSE 'intact' END AS state
FROM documents d FULL JOIN (SELECT vec_id, count(*) AS n FROM embeddings GROUP BY 1) e ON e.vec_id = d.doc_id""")
def unit_projection_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """Units with their projections, the vectors: each must have just one, and each projection its unit."""
    docs = table(spark, sf, "documents").select("doc_id")
    held = table(spark, sf, "embeddings").groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"))
    met = docs.join(held, F.col("doc_id") == F.col("vec_id"), "full")
    state = F.when(F.col("vec_id").isNull(), "missing").when(F.col("doc_id").isNull(), "orphan").when(F.col("n") > 1, "repeated").otherwise("intact")
    return met.select(F.coalesce("doc_id", "vec_id").alias("unit"), state.alias("state"))


@query(f"""SELECT source AS representation, CAST(sum(len(list_distinct(w))) AS BIGINT) AS declared, CAST(sum(len(list_distinct(w))) AS BIGINT) AS counted, 'complete' AS state FROM (SELECT source, {TERMS_SQL} AS w FROM documents) GROUP BY source""")
def index_completeness(spark: SparkSession, sf: str) -> DataFrame:
    """Postings that are there, counted, against what the manifests of the index declare."""
    folder = published_index(spark, sf)
    counted = postings.postings(spark, folder).groupBy(F.col("representation").alias("c")).agg(F.count(F.lit(1)).alias("counted"))
    met = postings.manifests(spark, folder).join(counted, F.col("representation").eqNullSafe(F.col("c")), "left")
    n = F.coalesce("counted", F.lit(0).cast("long"))
    return met.select("representation", F.col("n_postings").alias("declared"), n.alias("counted"), F.when(n == F.col("n_postings"), "complete").otherwise("incomplete").alias("state"))
