"""Structured news made of documents, read back, represented, ingested and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions.text import record_id
from quillstone.operators import news
from quillstone.registry import query
from quillstone.sources.tables import table

# A document as a news item: its first line is the headline, short lines are headings, others paragraphs. Payloads of documents
# labelled of low quality were cut off in transport; those labelled toxic must not be archived.
SHORT = 40
#: Items are of a time after this one, in seconds, by their length.
FIRST = 1_704_067_200
_SOURCE = f"""SELECT d.doc_id, source, lang, n_chars, coalesce(quality = 0, false) AS cut, coalesce(toxic = 1, false) AS barred,
list_filter([trim(regexp_replace(x, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ') FOR x IN string_split(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), chr(10))], lambda x: x <> '') AS ls FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
_ELEMENTS = f"""SELECT *, list_concat(CASE WHEN len(ls) > 0 THEN ['headline|headline[1]|' || ls[1]] ELSE [] END, ['byline|by[1]|By ' || source], ['dateline|dateline[1]|' || upper(lang)],
list_transform(ls, lambda x, i: CASE WHEN length(x) < {SHORT} THEN 'heading|hl1[' || len(list_filter(ls[1:i], lambda y: length(y) < {SHORT})) ELSE 'paragraph|p[' || len(list_filter(ls[1:i], lambda y: length(y) >= {SHORT})) END || ']|' || x)) AS body FROM ({_SOURCE})"""


def _utc_text(at: Column) -> Column:
    """An instant as ISO text in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, source, payload``: documents as news items in XML."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").withColumnRenamed("doc_id", "l_id"), F.col("doc_id") == F.col("l_id"), "left")
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.split(F.regexp_replace("text", r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), "\n", -1)
    squeezed = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[ \t\n\r\f\v]+", " "))), lambda x: x != "")
    element = lambda x: F.concat(F.when(F.length(x) < SHORT, F.concat(F.lit("<hl1>"), escape(x), F.lit("</hl1>"))).otherwise(F.concat(F.lit("<p>"), escape(x), F.lit("</p>"))))
    head = F.when(F.size("ls") > 0, F.concat(F.lit("<headline>"), escape(F.get("ls", F.lit(0))), F.lit("</headline>"))).otherwise("")
    stamp = lambda seconds: _utc_text(F.timestamp_seconds(F.lit(FIRST) + seconds))
    times = F.concat(F.lit("<versionCreated>"), stamp(F.col("n_chars")), F.lit("</versionCreated>"), F.when(F.col("toxic").isNotNull(), F.concat(F.lit("<embargoed>"), stamp(2 * F.col("n_chars")), F.lit("</embargoed>"))).otherwise(""))
    topics = F.concat(F.lit("<subject><name>In "), "lang", F.lit("</name></subject><subject/><located><name>"), F.upper("lang"), F.lit("</name></located>"))
    signal = F.when(F.col("toxic") == 1, F.lit('<signal qcode="sig:noarchive"/>')).otherwise("")
    rows = docs.select("doc_id", "source", "lang", "n_chars", "quality", "toxic", squeezed.alias("ls"))
    whole = F.concat(
        F.lit('<newsItem xmlns="urn:news:item" guid="doc-'), "doc_id", F.lit('" version="'), "n_chars", F.lit('"><rightsInfo><usageTerms>As '), escape(F.col("source")), F.lit(' allows</usageTerms></rightsInfo><itemMeta>'), times, F.lit('<provider><name>'), escape(F.col("source")),
        F.lit('</name></provider><pubStatus qcode="stat:usable"/>'), signal, F.lit('</itemMeta><contentMeta><language tag="'), "lang", F.lit('"/>'), head, F.lit("<by>By "), escape(F.col("source")),
        F.lit("</by><dateline>"), F.upper("lang"), F.lit("</dateline>"), topics, F.lit("</contentMeta><contentSet><inlineXML><body>"), F.array_join(F.transform("ls", element), "\n"), F.lit("</body></inlineXML></contentSet></newsItem>"),
    )
    return rows.select("doc_id", "source", F.when(F.col("quality") == 0, F.substring(whole, F.lit(1), F.length(whole) - 11)).otherwise(whole).alias("payload"))


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return news.read(payloads(spark, sf), "payload")


def _parts(body: Column) -> Column:
    return F.transform(body, lambda e: F.concat_ws("|", e["kind"], e["path"], e["text"]))


@query(f"""SELECT doc_id, CASE WHEN NOT cut THEN 'doc-' || doc_id END AS item_id, CASE WHEN NOT cut THEN n_chars::VARCHAR END AS version, CASE WHEN NOT cut THEN source END AS provider, CASE WHEN NOT cut THEN lang END AS language,
CASE WHEN NOT cut THEN len(body) END AS n_elements, CASE WHEN NOT cut THEN sha256(array_to_string(body, chr(10))) END AS body_sha256, CASE WHEN cut THEN 'malformed' END AS error FROM ({_ELEMENTS})""")
def newsml_parse(spark: SparkSession, sf: str) -> DataFrame:
    """News items read from XML: identity, metadata and body elements with their kinds and paths."""
    n = F.when(F.col("body").isNotNull(), F.size("body").cast("long"))
    return _items(spark, sf).select("doc_id", "item_id", "version", "provider", "language", n.alias("n_elements"), F.sha2(F.array_join(_parts(F.col("body")), "\n"), 256).alias("body_sha256"), "error")


@query(f"""SELECT doc_id, CASE WHEN NOT cut THEN strftime(make_timestamp(({FIRST} + n_chars) * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS version_created, CASE WHEN NOT cut AND labelled THEN strftime(make_timestamp(({FIRST} + 2 * n_chars) * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS embargo_until, CASE WHEN NOT cut THEN 'In ' || lang END AS subjects,
CASE WHEN NOT cut THEN upper(lang) END AS locations, CASE WHEN NOT cut THEN 'As ' || source || ' allows' END AS usage_terms, CASE WHEN NOT cut THEN NOT barred END AS archive_permitted FROM (SELECT s.*, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = s.doc_id) AS labelled FROM ({_SOURCE}) s)""")
def newsml_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Times, subjects, places and rights of news items, read from their XML."""
    items = news.times(_items(spark, sf))
    joined = [F.array_join(c, ",").alias(c) for c in ("subjects", "locations", "usage_terms")]
    return items.select("doc_id", *[_utc_text(F.col(c)).alias(c) for c in ("version_created", "embargo_until")], *joined, "archive_permitted")


@query(f"""WITH e AS (SELECT doc_id, n_chars, list_transform(body, lambda x: string_split(x, '|')[1]) AS ks, list_transform(body, lambda x: x[length(string_split(x, '|')[1]) + length(string_split(x, '|')[2]) + 3:]) AS ts FROM ({_ELEMENTS}) WHERE NOT cut),
r AS (SELECT *, 'nod_' || left(sha256('doc-' || doc_id || ':' || n_chars || ':root'), 24) AS root, list_contains(ks, 'paragraph') AS analyzable FROM e),
n AS (SELECT *, unnest(range(len(ks))) AS i FROM r)
SELECT doc_id, 'nod_' || left(sha256('doc-' || doc_id || ':' || n_chars || ':' || i), 24) AS node_id, root AS parent_id, ks[i + 1] AS kind, CAST(i AS BIGINT) AS order_index,
CAST(coalesce(list_sum(list_transform(ts[1:i], lambda t: length(t) + 1)), 0) AS BIGINT) AS start_char, CAST(coalesce(list_sum(list_transform(ts[1:i], lambda t: length(t) + 1)), 0) + length(ts[i + 1]) AS BIGINT) AS end_char, analyzable FROM n
UNION ALL SELECT doc_id, root, NULL, 'root', -1, 0, CAST(greatest(list_sum(list_transform(ts, lambda t: length(t) + 1)) - 1, 0) AS BIGINT), analyzable FROM r""")
def news_representation(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of news items: one for each body element, contained in a root."""
    return news.representation(_items(spark, sf), "doc_id")


@query(f"""WITH e AS (SELECT *, sha256(array_to_string(list_transform(body[3:], lambda x: string_split(x, '|')[1] || '|' || x[length(string_split(x, '|')[1]) + length(string_split(x, '|')[2]) + 3:]), chr(10))) AS digest FROM ({_ELEMENTS})),
w AS (SELECT *, CASE WHEN NOT cut AND NOT barred THEN row_number() OVER (PARTITION BY cut OR barred, source, digest ORDER BY doc_id) END AS n, min(CASE WHEN NOT cut AND NOT barred THEN doc_id END) OVER (PARTITION BY source, digest) AS first FROM e)
SELECT doc_id, CASE WHEN cut THEN 'malformed' WHEN barred THEN 'rights_blocked' WHEN n > 1 THEN 'reused' ELSE 'created' END AS outcome, CASE WHEN NOT cut AND NOT barred AND n > 1 THEN first END AS earlier_id,
CASE WHEN NOT cut THEN 'cap_' || left(sha256(lower(replace(source, ' ', '-')) || ':doc-' || doc_id || ':' || n_chars), 24) END AS capture_id FROM w""")
def news_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """The outcome of each delivery: unreadable, barred from the archive, known already, or created. Captures are named by provider, item and version.

    A body is known if an earlier delivery of its provider that may be archived has it; the earliest is an aggregate, not a sort.
    """
    items = _items(spark, sf)
    body = F.transform(F.filter("body", lambda e, i: i >= F.size("body") - F.size(F.filter("body", lambda x: ~x["kind"].isin("headline", "byline")))), lambda e: F.concat_ws("|", e["kind"], e["text"]))
    barred = F.exists("signals", lambda s: F.substring_index(F.lower(s), ":", -1) == "noarchive")
    rows = items.select("doc_id", "source", "error", barred.alias("barred"), F.sha2(F.array_join(body, "\n"), 256).alias("digest"), record_id("cap", F.lower(F.replace("provider", F.lit(" "), F.lit("-"))), "item_id", "version").alias("capture_id"))
    open_ = F.col("error").isNull() & ~F.col("barred")
    first = rows.where(open_).groupBy(F.col("source").alias("f_source"), F.col("digest").alias("f_digest")).agg(F.min("doc_id").alias("first"))
    known = rows.join(first, (F.col("source") == F.col("f_source")) & (F.col("digest") == F.col("f_digest")), "left")
    again = F.col("doc_id") > F.col("first")
    outcome = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("barred"), "rights_blocked").when(again, "reused").otherwise("created")
    return known.select("doc_id", outcome.alias("outcome"), F.when(open_ & again, F.col("first")).alias("earlier_id"), F.when(F.col("error").isNull(), F.col("capture_id")).alias("capture_id"))


@query("""WITH v AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'original' WHEN 'O' THEN 'update' ELSE 'unknown' END AS kind,
lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS previous FROM orders),
p AS (SELECT l_orderkey AS id FROM lineitem GROUP BY 1 HAVING count(*) <> count(DISTINCT l_shipdate))
SELECT id, 'unknown_kind' AS rule FROM v WHERE kind = 'unknown' UNION ALL SELECT id, 'original_with_predecessor' FROM v WHERE kind = 'original' AND previous IS NOT NULL
UNION ALL SELECT id, 'no_predecessor' FROM v WHERE kind = 'update' AND previous IS NULL UNION ALL SELECT v.id, 'repeated_purpose' FROM v JOIN p ON p.id = v.id""")
def news_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Revision classifications and rights profiles that break their rules: kinds, predecessors and purposes that are named once."""
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    kind = F.when(F.col("o_orderstatus") == "F", "original").when(F.col("o_orderstatus") == "O", "update").otherwise("unknown")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), kind.alias("kind"), F.lag("o_orderkey").over(w).alias("previous"))
    purposes = table(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.count(F.lit(1)) != F.count_distinct("l_shipdate")).alias("repeated"))
    return classification_violations(rows.join(purposes, F.col("id") == F.col("l_orderkey"), "left"))


def classification_violations(rows: DataFrame) -> DataFrame:
    """``id, rule`` of ``rows(id, kind, previous, repeated)``."""
    rules = {
        "unknown_kind": F.col("kind") == "unknown",
        "original_with_predecessor": (F.col("kind") == "original") & F.col("previous").isNotNull(),
        "no_predecessor": ~F.col("kind").isin("original", "unknown") & F.col("previous").isNull(),
        "repeated_purpose": F.coalesce("repeated", F.lit(False)),
    }
    return rows.select("id", F.explode(F.filter(F.array(*[F.when(c, name) for name, c in rules.items()]), lambda x: x.isNotNull())).alias("rule"))


_TAGS = "|".join(f"<{t}[ >].*?</{t}>" for t in ("h2", "h3", "p", "blockquote", "li", "figcaption"))
_BARE = "trim(regexp_replace(regexp_replace({0}, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(rf"""WITH h AS (SELECT page_id, html, regexp_extract(html, '(?s)<script[^>]*application/ld\+json[^>]*>(.*?)</script>', 1) AS data, regexp_extract(html, '(?s)<article[ >].*?</article>') AS region FROM pages),
b AS (SELECT *, CASE WHEN data <> '' THEN json_extract_string(data, '$.articleBody') END AS body FROM h),
e AS (SELECT *, CASE WHEN coalesce(trim(body), '') <> '' THEN 'json_ld' WHEN region <> '' THEN 'semantic_html' ELSE 'page' END AS precedence FROM b),
l AS (SELECT *, list_filter(CASE precedence WHEN 'json_ld' THEN [trim(regexp_replace(p, '\s+', ' ', 'g')) FOR p IN regexp_split_to_array(body, '\n\s*\n')]
  ELSE [{_BARE.format('x')} FOR x IN regexp_extract_all(CASE precedence WHEN 'semantic_html' THEN region ELSE html END, '(?s){_TAGS}')] END, lambda x: x <> '') AS els FROM e)
SELECT page_id, precedence, len(els) AS n_elements, sha256(array_to_string(els, chr(10))) AS body_sha256, nullif({_BARE.format("regexp_extract(html, '(?s)<h1[ >].*?</h1>')")}, '') AS headline FROM l""")
def html_article(spark: SparkSession, sf: str) -> DataFrame:
    """The article of each page, by the first of the formats that it has."""
    rows = table(spark, sf, "pages").select("page_id", news.article(F.col("html")).alias("a"))
    return rows.select("page_id", "a.precedence", F.size("a.elements").cast("long").alias("n_elements"), F.sha2(F.array_join("a.elements", "\n"), 256).alias("body_sha256"), "a.headline")
