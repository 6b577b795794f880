"""News items: structured payloads, web articles, and what is kept of them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillstone.functions.text import record_id, text_slices


def _record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S = T.StringType()
BODY = T.ArrayType(_record(kind=_S, path=_S, text=_S))
ITEM = _record(item_id=_S, version=_S, provider=_S, status=_S, language=_S, headlines=T.ArrayType(_S), signals=T.ArrayType(_S), body=BODY, error=_S,
               version_created=_S, first_created=_S, embargo_until=_S, roles=T.ArrayType(_S), subjects=T.ArrayType(_S), locations=T.ArrayType(_S), usage_terms=T.ArrayType(_S), media=T.ArrayType(_S), archive_permitted=T.BooleanType())
_ARROW = to_arrow_schema(ITEM)
#: The fields of an item that are times, as they stand in it.
TIMES = ("version_created", "first_created", "embargo_until")
# The tags that body elements have, and what they are.
KINDS = {"hl1": "heading", "hl2": "heading", "p": "paragraph", "blockquote": "quote", "li": "list_item", "caption": "caption"}
PRECEDENCE = ("json_ld", "semantic_html", "page")


def _plain(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text(node: ElementTree.Element) -> str:
    return re.sub(r"[ \t\n\r\f\v]+", " ", "".join(node.itertext())).strip(" ")


def _faulty(error: str) -> tuple:
    return tuple(error if name == "error" else None for name in ITEM.names)


def _item(payload: str | None) -> tuple:
    """The fields of ITEM for one payload; a payload that can't be read has only an ``error``.

    Times are texts, null where there is none. Subjects and locations are those with names; what may be archived is all but items with
    a signal of that name, whatever its scheme and case.
    """
    try:
        root = ElementTree.fromstring(payload or "")
    except ElementTree.ParseError:
        return _faulty("malformed")
    if _plain(root.tag) != "newsItem":
        return _faulty("not_a_news_item")
    if not root.get("guid") or not root.get("version"):
        return _faulty("no_identity")
    by_tag: dict[str, list[ElementTree.Element]] = {}
    for node in root.iter():
        by_tag.setdefault(_plain(node.tag), []).append(node)
    first = lambda tag: next(iter(by_tag.get(tag, [])), None)
    texts = lambda tag: [t for n in by_tag.get(tag, []) if (t := _text(n))]
    provider, status, language = first("provider"), first("pubStatus"), first("language")
    headlines = texts("headline") or texts("title")[:1]
    body = [("headline", f"headline[{i}]", t) for i, t in enumerate(headlines, 1)]
    body += [("byline", f"by[{i}]", t) for i, t in enumerate(texts("by"), 1)] + [("dateline", "dateline[1]", t) for t in texts("dateline")[:1]]
    seen: dict[str, int] = {}
    inline = first("inlineXML")
    for node in inline.iter() if inline is not None else ():
        tag = _plain(node.tag)
        if tag in KINDS and (text := _text(node)):
            seen[tag] = seen.get(tag, 0) + 1
            body.append((KINDS[tag], f"{tag}[{seen[tag]}]", text))
    signals = [q for n in by_tag.get("signal", []) if (q := n.get("qcode"))]
    name = _text(provider) if provider is not None else ""
    named = lambda tag: [t for n in by_tag.get(tag, []) if (t := next((_text(c) for c in n if _plain(c.tag) == "name"), ""))]
    time = lambda tag: next(iter(texts(tag)), None)
    media = [h for n in by_tag.get("remoteContent", []) if (h := n.get("href"))]
    more = (time("versionCreated"), time("firstCreated"), time("embargoed"), named("role"), named("subject"), named("located"), texts("usageTerms"), media, not any(q.casefold().rsplit(":", 1)[-1] == "noarchive" for q in signals))
    return (root.get("guid"), root.get("version"), name or "unknown-provider", status.get("qcode", "unknown") if status is not None else "unknown", language.get("tag") if language is not None else None, headlines, signals, body, None, *more)


def _items_of(payloads: list[str | None]) -> pa.Array:
    rows = [_item(p) for p in payloads]
    bodies = [None if r[7] is None else [dict(zip(("kind", "path", "text"), e)) for e in r[7]] for r in rows]
    columns = [bodies if name == "body" else [r[i] for r in rows] for i, name in enumerate(ITEM.names)]
    return pa.StructArray.from_arrays([pa.array(c, _ARROW.field(name).type) for c, name in zip(columns, ITEM.names)], ITEM.names)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose last column is a payload, with its item in that place; no more than a slice of payloads is held as items."""
    for batch in batches:
        for begin, end in text_slices(batch.column(batch.num_columns - 1)):
            part = batch.slice(begin, end - begin)
            items = _items_of(part.column(part.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *items.flatten()], [*batch.schema.names[:-1], *ITEM.names])


def read(rows: DataFrame, payload: str) -> DataFrame:
    """``rows`` with the fields of their items in place of the column ``payload``: slices of rows go through Python one after the other."""
    kept = [c for c in rows.columns if c != payload]
    schema = T.StructType([*[rows.schema[c] for c in kept], *ITEM.fields])
    return rows.select(*kept, payload).mapInArrow(_read, schema)


@F.pandas_udf(ITEM)
def newsml(payload: pd.Series) -> pd.DataFrame:
    """News items read from their XML, whatever its namespaces. There is no built-in that keeps mixed tags in order. For tables of many rows ``read`` takes less memory."""
    rows = pd.DataFrame([_item(p) for p in payload], columns=ITEM.names, dtype=object)
    rows["body"] = [None if b is None else [dict(zip(("kind", "path", "text"), e)) for e in b] for b in rows["body"]]
    return rows


def times(items: DataFrame) -> DataFrame:
    """``items`` with their TIMES as instants; what is no time is null."""
    return items.withColumns({c: F.try_to_timestamp(c) for c in TIMES})


def article(html: Column) -> Column:
    """``struct<headline, precedence, elements>`` of a web page: JSON-LD's article first, then ``<article>``, then the whole page.

    Elements are texts without tags, in order; an element inside another of these belongs to the outer one.
    """
    bare = lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, "(?s)<[^>]*>", " "), r"\s+", " "))
    data = F.regexp_extract(html, r'(?s)<script[^>]*application/ld\+json[^>]*>(.*?)</script>', 1)
    body, title = F.get_json_object(data, "$.articleBody"), F.get_json_object(data, "$.headline")
    region = F.regexp_extract(html, r"(?s)<article[ >].*?</article>", 0)
    pattern = "|".join(f"<{t}[ >].*?</{t}>" for t in ("h2", "h3", "p", "blockquote", "li", "figcaption"))
    found = lambda t: F.filter(F.transform(F.regexp_extract_all(t, F.lit(f"(?s){pattern}"), F.lit(0)), bare), lambda x: x != "")
    paragraphs = F.filter(F.transform(F.split(body, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda x: x != "")
    has_body = F.coalesce(F.trim(body) != "", F.lit(False))
    kind = F.when(has_body, PRECEDENCE[0]).when(region != "", PRECEDENCE[1]).otherwise(PRECEDENCE[2])
    elements = F.when(has_body, paragraphs).when(region != "", found(region)).otherwise(found(html))
    headline = F.coalesce(F.nullif(F.trim(title), F.lit("")), F.nullif(bare(F.regexp_extract(html, r"(?s)<h1[ >].*?</h1>", 0)), F.lit("")))
    return F.struct(headline.alias("headline"), kind.alias("precedence"), elements.alias("elements"))


def representation(items: DataFrame, key: str) -> DataFrame:
    """A node for each body element: ``key, node_id, parent_id, kind, order_index, start_char, end_char, analyzable``.

    Texts are joined by line feeds; a root node, with index -1, contains all. An item is analyzable if it has a paragraph.
    """
    good = items.where(F.col("error").isNull()).withColumn("analyzable", F.exists("body", lambda e: e["kind"] == "paragraph"))
    root = record_id("nod", "item_id", "version", F.lit("root"))
    rows = good.select(key, "item_id", "version", "analyzable", root.alias("root"), "body")
    # A running sum over an item's elements: no array is copied for each of them.
    w = Window.partitionBy(key, "item_id", "version").orderBy("order_index").rowsBetween(Window.unboundedPreceding, -1)
    nodes = rows.select(key, "item_id", "version", "root", "analyzable", F.posexplode("body").alias("order_index", "e"))
    start = F.coalesce(F.sum(F.length("e.text") + 1).over(w), F.lit(0))
    nodes = nodes.withColumn("e", F.struct("e.kind", start.alias("start_char"), (start + F.length("e.text")).alias("end_char")))
    own = nodes.select(key, record_id("nod", "item_id", "version", "order_index").alias("node_id"), F.col("root").alias("parent_id"), "e.kind", F.col("order_index").cast("long").alias("order_index"), F.col("e.start_char").cast("long").alias("start_char"), F.col("e.end_char").cast("long").alias("end_char"), "analyzable")
    whole = rows.select(key, F.col("root").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("root").alias("kind"), F.lit(-1).cast("long").alias("order_index"), F.lit(0).cast("long").alias("start_char"), F.greatest(F.aggregate("body", F.lit(-1), lambda n, e: n + F.length(e["text"]) + 1), F.lit(0)).cast("long").alias("end_char"), "analyzable")
    return own.union(whole)
