"""Text, date, number, array, JSON and identity operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.registry import query
from quillstone.sources.tables import ASSERTIONS_SQL, assertions, date_text, lines, table


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


@query(r"SELECT doc_id, sha256(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g'))) AS digest FROM documents")
def normalize_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Texts in normal form C with white space squeezed, by digest."""
    return X.with_nfc(_docs(spark, sf), "text").select("doc_id", F.sha2(X.squeeze(F.col("text")), 256).alias("digest"))


@query("SELECT doc_id, sha256(regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g')) AS digest FROM documents")
def normalize_semantic(spark: SparkSession, sf: str) -> DataFrame:
    """Texts in normal form C with plain line ends, by digest."""
    return X.with_nfc(_docs(spark, sf), "text").select("doc_id", F.sha2(X.unix_lines(F.col("text")), 256).alias("digest"))


@query("SELECT doc_id, sha256(replace(lower(text), 'ß', 'ss')) AS digest FROM documents")
def casefold(spark: SparkSession, sf: str) -> DataFrame:
    """Case-folded texts, by digest."""
    return _docs(spark, sf).select("doc_id", F.sha2(X.folded(F.col("text")), 256).alias("digest"))


@query("SELECT doc_id, sha256(text) AS digest, CAST(strlen(text) AS BIGINT) AS byte_length FROM documents")
def content_digest(spark: SparkSession, sf: str) -> DataFrame:
    """The digest and size of each content."""
    return _docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("byte_length"))


@query("""SELECT doc_id, 'src_' || left(sha256('source:' || source), 24) AS source_id, 'blob_' || left(sha256(sha256(text)), 24) AS blob_id,
'doc_' || left(sha256('source:' || source || ':' || sha256(text)), 24) AS document_id FROM documents""")
def deterministic_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids made of digests of what they name."""
    rows = table(spark, sf, "documents")
    digest = F.sha2("text", 256)
    return rows.select("doc_id", X.record_id("src", F.lit("source"), "source").alias("source_id"), X.record_id("blob", digest).alias("blob_id"), X.record_id("doc", F.lit("source"), "source", digest).alias("document_id"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \t\n\r\x0b\x0c]+')) AS BIGINT) AS n_tokens FROM documents")
def token_count(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens between white space."""
    return _docs(spark, sf).select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\x0b\x0c]+"), F.lit(0))).cast("long").alias("n_tokens"))


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: regexp_matches(w, '^[A-Z]{2,}$')))), ',') AS acronyms FROM documents")
def acronyms(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct acronyms of each text."""
    return _docs(spark, sf).select("doc_id", F.array_join(X.acronyms(F.col("text")), ",").alias("acronyms"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '^(?i:https)://[^/?#@]+([/?#]|$)') THEN
'https://' || lower(regexp_extract(url, '^(?i:https)://([^/?#]*)', 1)) || CASE WHEN regexp_extract(url, '^(?i:https)://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^(?i:https)://[^/?#]*([^?#]*)', 1) END
|| regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) END AS normal_url FROM pages""")
def normalize_url(spark: SparkSession, sf: str) -> DataFrame:
    """Source addresses in normal form; others than https are rejected."""
    return table(spark, sf, "pages").select("page_id", X.normal_url(F.col("url")).alias("normal_url"))


@query(r"""SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part""")
def slug(spark: SparkSession, sf: str) -> DataFrame:
    """Names fit for file names."""
    return table(spark, sf, "part").select("p_partkey", X.slug(F.concat("p_name", F.lit(" / "), "p_type")).alias("slug"))


@query(f"SELECT id, CASE WHEN confidence IS NULL THEN 'Not assessed' WHEN confidence >= 0.75 THEN 'High' WHEN confidence >= 0.5 THEN 'Moderate' ELSE 'Low' END AS label FROM ({ASSERTIONS_SQL})")
def confidence_label(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence in words."""
    return assertions(spark, sf).select("id", X.confidence_label(F.col("confidence")).alias("label"))


@query("""WITH n AS (SELECT r_regionkey, list(n_name ORDER BY n_name) AS l FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1)
SELECT r_regionkey, CASE len(l) WHEN 1 THEN l[1] WHEN 2 THEN l[1] || ' and ' || l[2] ELSE array_to_string(l[:-2], ', ') || ', and ' || l[-1] END AS names FROM n""")
def join_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names in a sentence."""
    names = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_name")).alias("l"))
    return names.select("r_regionkey", X.joined_names(F.col("l")).alias("names"))


@query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN t = '' THEN '' WHEN regexp_matches(t, '[.!?]$') THEN upper(left(t, 1)) || substr(t, 2) ELSE upper(left(t, 1)) || substr(t, 2) || '.' END AS sentence FROM t""")
def sentence_text(spark: SparkSession, sf: str) -> DataFrame:
    """First lines as sentences."""
    return _docs(spark, sf).select("doc_id", X.sentence(F.get(F.split("text", "\n", -1), F.lit(0))).alias("sentence"))


@query("SELECT event_id, lpad((event_id % 1000)::VARCHAR, 20, '0') AS padded, CASE WHEN event_id % 2 = 0 THEN lpad((event_id % 1000)::VARCHAR, 20, '0') ELSE 'v' || event_id % 1000 END AS version_key FROM events")
def version_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Versions as keys that sort."""
    number = (F.col("event_id") % 1000).cast("string")
    version = F.when(F.col("event_id") % 2 == 0, number).otherwise(F.concat(F.lit("v"), number))
    return table(spark, sf, "events").select("event_id", X.version_key(number).alias("padded"), X.version_key(version).alias("version_key"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_type(props, '$.k') IS NULL AS missing FROM events")
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Typed fields of JSON records."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").select("event_id", k.cast("long").alias("k"), k.isNull().alias("missing"))


@query("""SELECT event_id, '{"id":' || event_id || ',"kind":"' || event_type || '","user":' || user_id || '}' AS json FROM events""")
def canonical_json(spark: SparkSession, sf: str) -> DataFrame:
    """Records as JSON with sorted keys and no blanks."""
    return table(spark, sf, "events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("user_id").alias("user"))).alias("json"))


@query("""SELECT vec_id, round(sqrt(list_sum([(x * x)::DOUBLE for x in embedding::DOUBLE[]])), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum([(x * x)::DOUBLE for x in embedding::DOUBLE[]])), 6) AS first_value FROM embeddings""")
def vector_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of unit length: their former length and first value."""
    norm = F.sqrt(F.aggregate(F.col("embedding"), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return table(spark, sf, "embeddings").select("vec_id", F.round(norm, 6).alias("norm"), F.round(F.get("embedding", F.lit(0)).cast("double") / norm, 6).alias("first_value"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(epoch(o_orderdate) AS BIGINT) AS seconds FROM orders")
def iso_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Instants read from ISO text."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), date_text("o_orderdate").alias("iso"))
    return rows.select("id", "iso", F.unix_timestamp(F.to_timestamp("iso", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("seconds"))


@query("SELECT o_orderkey AS id, strptime(regexp_extract(line, ', ([A-Z][a-z]+ [0-9]+, [0-9]{4})$', 1), '%B %d, %Y') AS at FROM (SELECT o_orderkey, 'Dateline: Lima, ' || strftime(o_orderdate, '%B %-d, %Y') AS line FROM orders)")
def dateline_parse(spark: SparkSession, sf: str) -> DataFrame:
    """The day of a dateline."""
    line = F.concat(F.lit("Dateline: Lima, "), F.date_format("o_orderdate", "MMMM d, yyyy"))
    day = F.regexp_extract(line, r", ([A-Z][a-z]+ [0-9]+, [0-9]{4})$", 1)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.to_timestamp_ntz(day, F.lit("MMMM d, yyyy")).alias("at"))


@query("""SELECT doc_id, order_index, CASE WHEN line = '' THEN 'blank' WHEN regexp_matches(line, '^(Table|Tab\\.) [0-9]') THEN 'table_caption' WHEN regexp_matches(line, '^# ') THEN 'heading' WHEN regexp_matches(line, '^([-*]|[0-9]+\\.) ') THEN 'list_item' WHEN NOT regexp_matches(line, '[\\p{L}\\p{N}]') THEN 'rule' ELSE 'paragraph' END AS label
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(unnest(range(len(string_split(text, chr(10))))) AS BIGINT) AS order_index FROM documents)""".replace("\\\\", "\\"))
def line_labels(spark: SparkSession, sf: str) -> DataFrame:
    """What kind of node a line is."""
    line = F.col("line")
    label = F.when(line == "", "blank").when(line.rlike(r"^(Table|Tab\.) [0-9]"), "table_caption").when(line.rlike("^# "), "heading").when(line.rlike(r"^([-*]|[0-9]+\.) "), "list_item").when(~line.rlike(r"[\p{L}\p{N}]"), "rule").otherwise("paragraph")
    return lines(spark, sf).select("doc_id", "order_index", label.alias("label"))


@query("""SELECT doc_id, CAST(count(*) FILTER (trim(line) <> '') AS BIGINT) AS n_paragraphs FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id""")
def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs with any text."""
    parts = F.filter(F.split("text", "\n", -1), lambda t: F.trim(t) != "")
    return _docs(spark, sf).select("doc_id", F.size(parts).cast("long").alias("n_paragraphs"))


@query("SELECT page_id, regexp_extract(html, '<html[^>]* lang=\"([^\"]*)\"', 1) AS lang, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages")
def html_lang(spark: SparkSession, sf: str) -> DataFrame:
    """The language and title that a page declares."""
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", r'<html[^>]* lang="([^"]*)"', 1).alias("lang"), F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query("""SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0 ELSE (length(text) - length(translate(text, '#$%&*', ''))) / length(text)::DOUBLE END, 9) AS rate FROM documents""")
def glyph_quality(spark: SparkSession, sf: str) -> DataFrame:
    """The rate of suspicious characters."""
    n = F.length("text")
    return _docs(spark, sf).select("doc_id", F.round(F.when(n == 0, 0.0).otherwise((n - F.length(F.translate("text", "#$%&*", ""))) / n), 9).alias("rate"))


@query("""WITH m AS (SELECT doc_id, length(text) AS n, (length(text) - length(translate(text, '#$%&*', ''))) / greatest(length(text), 1)::DOUBLE AS rate FROM documents)
SELECT doc_id, CASE WHEN n = 0 THEN 'ocr' WHEN rate >= 0.01 THEN 'ocr' WHEN n < 64 THEN 'ocr' ELSE 'embedded' END AS path,
CASE WHEN n = 0 THEN 'blocked' WHEN rate >= 0.01 THEN 'degraded' ELSE 'acceptable' END AS status FROM m""")
def page_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Where a page's text is taken from, and what it is worth."""
    n = F.length("text")
    rate = (n - F.length(F.translate("text", "#$%&*", ""))) / F.greatest(n, F.lit(1))
    path = F.when((n == 0) | (rate >= 0.01) | (n < 64), "ocr").otherwise("embedded")
    return _docs(spark, sf).select("doc_id", path.alias("path"), F.when(n == 0, "blocked").when(rate >= 0.01, "degraded").otherwise("acceptable").alias("status"))


@query("""SELECT p_partkey AS id, CASE WHEN p_type LIKE '%STEEL%' OR p_name LIKE '%red%' THEN 'withdrawal' WHEN p_name LIKE '%correct%' THEN 'correction' ELSE 'update' END AS kind FROM part""")
def revision_kind(spark: SparkSession, sf: str) -> DataFrame:
    """The kind of a revision by its words."""
    kind = F.when(F.col("p_type").contains("STEEL") | F.col("p_name").contains("red"), "withdrawal").when(F.col("p_name").contains("correct"), "correction").otherwise("update")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), kind.alias("kind"))


