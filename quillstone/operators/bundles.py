"""Integrity of a bundle's children: ownership, spans, digests, regions, edges and selectors, as rows that break a rule.

A bundle's children come as tables that all have its id: ``views(bundle, view, kind, text)``, ``nodes(bundle, node, view, parent, node_type, start_char, end_char,
regions, pages, digest)``, ``regions(bundle, region, page, left, top, right, bottom)``, ``edges(bundle, edge, src, dst)`` and
``selectors(bundle, node, digest)``. ``regions`` and ``pages`` of a node are arrays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.graph import durable

#: Code points of a text that are cut in one piece.
PIECE = 4096

#: The name of each collection's ids.
IDS = {"views": "view", "nodes": "node", "regions": "region", "edges": "edge"}


def _broken(rows: DataFrame, child: Column, rules: dict[str, Column]) -> DataFrame:
    """``bundle, rule, child`` of each rule that a row breaks, all in one pass of the rows; null breaks nothing."""
    return rows.select("bundle", F.explode(_names(rules)).alias("rule"), child.cast("string").alias("child"))


def _names(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(broken, F.lit(rule)) for rule, broken in rules.items()]))


def digests(views: DataFrame, nodes: DataFrame) -> DataFrame:
    """``s_bundle, s_node, span_digest``: the digest of each node's text, from its view.

    Views are cut into pieces of PIECE code points in one pass, and nodes meet the pieces that they lie in: a text with very many nodes isn't gone
    through from its beginning for each. What lies in one piece is digested where it meets it, and a node that has all of its view has the digest
    of the view, so only texts of other nodes that reach over several pieces are shuffled again. What is beyond a text is left out; an empty span has no row.
    """
    text = [F.col("bundle").alias("v_bundle"), F.col("view").alias("v_view"), F.length("text").alias("v_chars")]
    pieces = views.select(*text, F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("piece", "cut"))
    first, last = F.floor(F.col("start_char") / PIECE), F.floor((F.col("end_char") - 1) / PIECE)
    own = nodes.where("start_char >= 0 and end_char > start_char").select("bundle", "view", "node", "start_char", "end_char")
    met = own.withColumn("at", F.explode(F.sequence(first, last))).join(pieces, (F.col("bundle") == F.col("v_bundle")) & (F.col("view") == F.col("v_view")) & (F.col("at") == F.col("piece")))
    begin = F.greatest(F.col("start_char") - F.col("at") * PIECE, F.lit(0))
    part = F.substring(F.col("cut"), (begin + 1).cast("int"), (F.least(F.col("end_char") - F.col("at") * PIECE, F.lit(PIECE)) - begin).cast("int"))
    whole, inside = "start_char = 0 and end_char >= v_chars", first == last
    cut = met.where(f"not ({whole})").select("bundle", "node", "at", inside.alias("done"), F.when(inside, F.sha2(part, 256)).otherwise(part).alias("part"))
    all_ = own.where("start_char = 0").join(views.select(*text, F.sha2("text", 256).alias("part")), (F.col("bundle") == F.col("v_bundle")) & (F.col("view") == F.col("v_view"))).where(f"{whole} and v_chars > 0")
    every = cut.union(all_.select("bundle", "node", F.lit(0).cast("long").alias("at"), F.lit(True).alias("done"), "part"))
    listed = F.array_sort(F.collect_list(F.struct("at", "part")))
    span = every.groupBy(F.col("bundle").alias("s_bundle"), F.col("node").alias("s_node")).agg(F.max("done").alias("done"), F.array_join(F.transform(listed, lambda p: p["part"]), "").alias("span"))
    return span.select("s_bundle", "s_node", F.when(F.col("done"), F.col("span")).otherwise(F.sha2("span", 256)).alias("span_digest"))


def _nodes(views: DataFrame, nodes: DataFrame, regions: DataFrame) -> DataFrame:
    """Nodes beside what they refer to: their view, whether their parent is there, and what is known of their regions."""
    texts = views.select(F.col("bundle").alias("v_bundle"), F.col("view").alias("v_view"), "kind", F.length("text").alias("n_chars"))
    cut = durable(digests(views, nodes)).select(F.col("s_bundle").alias("c_bundle"), F.col("s_node").alias("c_node"), "span_digest")
    parents = nodes.select(F.col("bundle").alias("p_bundle"), F.col("node").alias("p_node")).distinct()
    asked = nodes.select("bundle", "node", F.explode("regions").alias("region"))
    plain = lambda c: F.when(F.col(c) == 0, F.col(c) - F.col(c)).otherwise(F.col(c)).alias(c)  # noqa: E731  one zero
    known = regions.select(F.col("bundle").alias("r_bundle"), F.col("region").alias("r_region"), F.struct("page", *map(plain, ("left", "top", "right", "bottom"))).alias("place"))
    met = asked.join(known, (F.col("bundle") == F.col("r_bundle")) & (F.col("region") == F.col("r_region")), "left")
    seen = met.groupBy(F.col("bundle").alias("s_bundle"), F.col("node").alias("s_node")).agg(F.count_if(F.col("r_region").isNull()).alias("unknown"), F.count("r_region").alias("met"), F.collect_set("place").alias("held"))
    pages = F.array_sort(F.array_distinct(F.array_compact(F.transform("held", lambda p: p["page"]))))
    seen = durable(seen.select("s_bundle", "s_node", "unknown", "met", F.size("held").alias("places"), pages.alias("seen_pages")))
    rows = nodes.join(cut, (F.col("bundle") == F.col("c_bundle")) & (F.col("node") == F.col("c_node")), "left")
    rows = rows.join(seen, (F.col("bundle") == F.col("s_bundle")) & (F.col("node") == F.col("s_node")), "left").drop("c_bundle", "c_node", "s_bundle", "s_node")
    rows = rows.join(texts, (F.col("bundle") == F.col("v_bundle")) & (F.col("view") == F.col("v_view")), "left")
    rows = rows.withColumns({"has_view": F.col("v_view").isNotNull(), "digest_now": F.coalesce("span_digest", F.sha2(F.lit(""), 256))}).drop("v_bundle", "v_view", "span_digest")
    return rows.join(parents, (F.col("bundle") == F.col("p_bundle")) & (F.col("parent") == F.col("p_node")), "left")


def violations(views: DataFrame, nodes: DataFrame, regions: DataFrame, edges: DataFrame, selectors: DataFrame, bundles: DataFrame) -> DataFrame:
    """``bundle, rule, child`` of each rule that is broken; ``child`` is null where it is the bundle's own.

    ``bundles(bundle)`` are those that there are. Each child must have its bundle and an id of its own kind once. A bundle has views of different kinds, of which one is
    logical. A node has a view, lies within its text, has a parent that is there and regions that are there, once a place, with just their pages; with regions it has the digest of
    its text, without it has none; furniture stays out of the logical view. Edges join two nodes. A node has one selector at most, with the digest of its text.
    """
    tables = {"views": views, "nodes": nodes, "regions": regions, "edges": edges}
    own = bundles.select(F.col("bundle").alias("b_bundle")).distinct()
    out = []
    for name, rows in [*tables.items(), ("selectors", selectors)]:
        child = F.col(IDS.get(name, "node"))
        lost = rows.join(own, F.col("bundle") == F.col("b_bundle"), "left_anti")
        out.append(lost.select("bundle", F.lit(f"{name}_without_bundle").alias("rule"), child.cast("string").alias("child")))
        many = rows.groupBy("bundle", child.alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        out.append(many.select("bundle", F.lit(f"{name}_repeated").alias("rule"), F.col("id").cast("string").alias("child")))
    kinds = views.groupBy(F.col("bundle").alias("k_bundle")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("kind").alias("d"), F.count_if(F.col("kind") == "logical").alias("logical"))
    per = own.join(kinds, F.col("b_bundle") == F.col("k_bundle"), "left").withColumnRenamed("b_bundle", "bundle")
    out.append(_broken(per, F.lit(None), {"no_view": F.col("n").isNull(), "repeated_kind": F.col("n") != F.col("d"), "not_one_logical_view": F.coalesce("logical", F.lit(0)) != 1}))

    twice = nodes.groupBy(F.col("bundle").alias("t_bundle"), F.col("node").alias("t_node")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    single = nodes.join(twice, (F.col("bundle") == F.col("t_bundle")) & (F.col("node") == F.col("t_node")), "left_anti")  # what is said twice is told once
    seen = _nodes(views, single, regions)
    has = F.coalesce("met", F.lit(0)) + F.coalesce("unknown", F.lit(0)) > 0
    none = F.array().cast(nodes.schema["pages"].dataType)
    rules = {
        "unknown_view": ~F.col("has_view"),
        "out_of_range": (F.col("end_char") > F.col("n_chars")) | (F.col("start_char") < 0) | (F.col("end_char") < F.col("start_char")),
        "unknown_parent": F.col("parent").isNotNull() & F.col("p_node").isNull(),
        "unknown_region": F.col("unknown") > 0,
        "other_pages": F.coalesce("pages", none) != F.coalesce("seen_pages", none),
        "other_digest": has & F.col("has_view") & ~F.col("digest").eqNullSafe(F.col("digest_now")),
        "digest_without_regions": ~has & F.col("digest").isNotNull(),
        "furniture_in_logical_view": (F.col("node_type") == "furniture") & (F.col("kind") == "logical"),
        "one_place_twice": F.col("met") > F.col("places"),
    }
    told = durable(seen.select("bundle", "node", "digest_now", _names(rules).alias("rules")))  # of the nodes' columns no more is needed
    out.append(told.select("bundle", F.explode("rules").alias("rule"), F.col("node").cast("string").alias("child")))

    ends = nodes.select(F.col("bundle").alias("n_bundle"), F.col("node").alias("n_node")).distinct()
    listed = edges.select("bundle", "edge", F.explode(F.array("src", "dst")).alias("end"))
    loose = listed.join(ends, (F.col("bundle") == F.col("n_bundle")) & (F.col("end") == F.col("n_node")), "left_anti").select("bundle", F.lit("unknown_end").alias("rule"), F.col("edge").cast("string").alias("child")).distinct()
    out += [loose, _broken(edges, F.col("edge"), {"edge_to_itself": F.col("src") == F.col("dst")})]

    now = told.select(F.col("bundle").alias("d_bundle"), F.col("node").alias("d_node"), "digest_now")
    held = selectors.join(ends, (F.col("bundle") == F.col("n_bundle")) & (F.col("node") == F.col("n_node")), "left")
    held = held.join(now, (F.col("bundle") == F.col("d_bundle")) & (F.col("node") == F.col("d_node")), "left")
    out.append(_broken(held, F.col("node"), {"selector_without_node": F.col("n_node").isNull(), "other_selector_digest": F.col("d_node").isNotNull() & ~F.col("digest").eqNullSafe(F.col("digest_now"))}))
    return reduce(DataFrame.union, out)


def hit_faults(hits: DataFrame, views: DataFrame, nodes: DataFrame) -> DataFrame:
    """``hit, fault`` of each of ``hits(hit, bundle, node, digest)``, with the digest that was indexed: ``hit_source_missing``, ``hit_digest_mismatch``, or null."""
    known = nodes.select(F.col("bundle").alias("n_bundle"), F.col("node").alias("n_node")).distinct()
    cut = digests(views, nodes).withColumnRenamed("span_digest", "digest_now")
    now = F.when(F.col("n_node").isNotNull(), F.coalesce("digest_now", F.sha2(F.lit(""), 256)))
    met = hits.join(known, (F.col("bundle") == F.col("n_bundle")) & (F.col("node") == F.col("n_node")), "left")
    met = met.join(cut, (F.col("bundle") == F.col("s_bundle")) & (F.col("node") == F.col("s_node")), "left").withColumn("now", now)
    return met.select("hit", F.when(F.col("now").isNull(), "hit_source_missing").when(~F.col("digest").eqNullSafe(F.col("now")), "hit_digest_mismatch").alias("fault"))
