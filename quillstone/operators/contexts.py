"""Contexts for a model: candidates by role, what fits the budget, and manifests that can be checked again.

``nodes(doc, node, order_index, node_type, parent, text)`` are a document's parts; ``units(unit, doc, focus, dependencies)`` have arrays of the nodes
to be analysed and of those that they depend on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import record_id
from quillstone.operators.graph import durable

#: A model's limit, less what is kept for its output and for safety.
BUDGET = 16384 - 512 - 128

# Types of nodes by the role they have as dependencies, and roles by priority.
HEADER_TYPES = ("table_row_header", "table_column_header", "table_corner_header")
TABLE_TYPES = ("table_caption", "table_unit", "table_note", "footnote")
PRIORITY = {"focus": 1, "table_header": 2, "heading": 3, "table_context": 3, "definition": 4}
#: Of several roles of a node in a unit the last one here stands.
PRECEDENCE = ("heading", "focus", "dependency")


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[^ \t\n\r\x0b\x0c]+"), F.lit(0))).cast("long")


def rendered(nodes: DataFrame) -> DataFrame:
    """``nodes`` with their ``segment``: type and id in brackets, then the text."""
    return nodes.withColumn("segment", F.concat(F.lit("["), "node_type", F.lit(":"), F.col("node").cast("string"), F.lit("]\n"), F.coalesce("text", F.lit(""))))


def ancestors(asked: DataFrame, nodes: DataFrame, wanted: str) -> DataFrame:
    """``unit, doc, node``: the nodes of a type above those of ``asked(unit, doc, node)``, one step up for each round and written, as trees of documents are low.

    A node is asked for its parent once a unit, so cycles end.
    """
    up = nodes.select(F.col("doc").alias("u_doc"), F.col("node").alias("u_node"), "parent", "node_type")
    seen = front = durable(asked.select("unit", "doc", "node").distinct())
    while True:
        step = front.join(up, (F.col("doc") == F.col("u_doc")) & (F.col("node") == F.col("u_node"))).where("parent is not null")
        step = step.select("unit", "doc", F.col("parent").alias("node")).distinct()
        old = seen.select(F.col("unit").alias("o_unit"), F.col("node").alias("o_node"))
        front = durable(step.join(old, (F.col("unit") == F.col("o_unit")) & (F.col("node") == F.col("o_node")), "left_anti"))
        if front.isEmpty():
            break
        seen = seen.union(front)
    own = asked.select(F.col("unit").alias("a_unit"), F.col("node").alias("a_node"))
    above = seen.join(own, (F.col("unit") == F.col("a_unit")) & (F.col("node") == F.col("a_node")), "left_anti")
    met = above.join(up, (F.col("doc") == F.col("u_doc")) & (F.col("node") == F.col("u_node")))
    return met.where(F.col("node_type") == wanted).select("unit", "doc", "node")


def named(units: DataFrame, nodes: DataFrame) -> DataFrame:
    """``unit, doc, node, as_``: nodes that units name or that are headings above their focus, with their place in PRECEDENCE. No text is looked at."""
    focus = units.select("unit", "doc", F.explode("focus").alias("node"))
    headings = ancestors(focus, nodes, "heading").withColumn("as_", F.lit(PRECEDENCE.index("heading")))
    needed = units.select("unit", "doc", F.explode("dependencies").alias("node"), F.lit(PRECEDENCE.index("dependency")).alias("as_"))
    every = focus.withColumn("as_", F.lit(PRECEDENCE.index("focus"))).unionByName(headings).unionByName(needed)
    return every.groupBy("unit", "doc", "node").agg(F.max("as_").alias("as_"))


def candidates(units: DataFrame, nodes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``unit, doc, node, role, priority, order_index, tokens, segment``: what each unit's context must hold.

    Its focus, the headings above the focus, and its dependencies: table headers, captions, units, notes and definitions. A node with several
    roles in a unit has one, by PRECEDENCE. Furniture is not required in any unit and is left out, whatever else it is. Nodes that aren't there are left out too;
    ``issues`` tells them. ``known`` is what ``named`` gives, where it is at hand.
    """
    one = named(units, nodes) if known is None else known
    own = rendered(nodes.where("node_type <> 'furniture'")).select(F.col("doc").alias("n_doc"), F.col("node").alias("n_node"), "order_index", "node_type", "segment")
    kind = F.when(F.col("node_type").isin(*HEADER_TYPES), "table_header").when(F.col("node_type").isin(*TABLE_TYPES), "table_context").otherwise("definition")
    role = F.when(F.col("as_") == PRECEDENCE.index("dependency"), kind).when(F.col("as_") == PRECEDENCE.index("focus"), "focus").otherwise("heading")
    met = one.join(own, (F.col("doc") == F.col("n_doc")) & (F.col("node") == F.col("n_node"))).withColumn("role", role)
    priority = F.element_at(F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair]), F.col("role"))
    return met.select("unit", "doc", "node", "role", priority.alias("priority"), "order_index", tokens(F.col("segment")).alias("tokens"), "segment")


def issues(units: DataFrame, nodes: DataFrame) -> DataFrame:
    """``unit, node``: nodes that units name and that their documents don't have."""
    named = units.select("unit", "doc", F.explode(F.array_distinct(F.concat("focus", "dependencies"))).alias("node"))
    known = nodes.select(F.col("doc").alias("n_doc"), F.col("node").alias("n_node"))
    return named.join(known, (F.col("doc") == F.col("n_doc")) & (F.col("node") == F.col("n_node")), "left_anti").select("unit", "node")


#: What a manifest's id is the digest of, in this order.
IDENTITY = ("unit", "doc", "status", "input_tokens", "rendered_digest", "segments", "children", "excluded", "blocked_reason")


def identity(*columns: Column) -> Column:
    """The id of a manifest by the values of IDENTITY."""
    return record_id("ctx", F.concat_ws("\n", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))


def manifests(units: DataFrame, nodes: DataFrame, prompt: str, budget: int = BUDGET, known: DataFrame | None = None) -> DataFrame:
    """One row a unit: ``manifest_id``, IDENTITY, ``n_selected`` and the ``rendered`` input.

    ``ready``: all that is required fits, and is rendered after the prompt by priority, place and id, with ``segments`` as ``node:start:end`` in bytes. Else
    ``split``, with a child unit for each focus, if there are several; else ``blocked``. Without a positive budget all are blocked. Tokens are added up before anything is gathered, so a row never
    holds more than the budget's worth of text. ``excluded`` is the count of the document's furniture.
    """
    said = tokens(F.lit(prompt))
    w = Window.partitionBy("unit").orderBy("priority", "order_index", "node")
    lead = len(prompt.encode()) + 2
    begin = F.coalesce(F.sum(F.octet_length("segment") + 2).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + lead
    own = F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # Texts meet their unit once: a unit beyond the budget hands on its count alone.
    placed = candidates(units, nodes, known).select("unit", "priority", "order_index", "node", "segment", begin.alias("start"), own.alias("own"))
    fits = F.lit(budget > 0) & (F.col("own") + said <= budget)
    listed = F.array_sort(F.collect_list(F.when(fits, F.struct("priority", "order_index", "node", "segment", "start"))))
    parts = placed.groupBy(F.col("unit").alias("p_unit")).agg(F.max("own").alias("own"), listed.alias("parts"))
    furniture = nodes.where("node_type = 'furniture'").groupBy(F.col("doc").alias("f_doc")).agg(F.count(F.lit(1)).alias("furniture"))
    rows = units.join(parts, F.col("unit") == F.col("p_unit"), "left").join(furniture, F.col("doc") == F.col("f_doc"), "left")
    needs = F.coalesce("own", F.lit(0)) + said
    status = F.when(F.lit(budget) <= 0, "blocked").when(needs <= budget, "ready").when(F.size("focus") > 1, "split").otherwise("blocked")
    rows = rows.select("unit", "doc", "focus", "parts", F.coalesce("furniture", F.lit(0).cast("long")).alias("excluded"), status.alias("status"), needs.alias("needs"))
    place = F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["node"].cast("string"), p["start"].cast("string"), (p["start"] + F.octet_length(p["segment"])).cast("string"))), ",")
    text = F.concat_ws("\n\n", F.lit(prompt), F.array_join(F.transform("parts", lambda p: p["segment"]), "\n\n"))
    is_ready = F.col("status") == "ready"
    body = F.when(is_ready, F.when(F.col("parts").isNull(), F.lit(prompt)).otherwise(text)).otherwise(F.lit(""))
    children = F.when(F.col("status") == "split", F.array_join(F.transform("focus", lambda n: record_id("unit", F.col("doc"), n)), ",")).otherwise("")
    reason = F.when(F.lit(budget) <= 0, "nonpositive_context_budget").when(F.col("status") == "blocked", "required_context_exceeds_budget")
    out = rows.select(
        "unit", "doc", "status", F.when(is_ready, F.col("needs")).otherwise(F.lit(0).cast("long")).alias("input_tokens"), F.sha2(body, 256).alias("rendered_digest"),
        F.coalesce(F.when(is_ready, place), F.lit("")).alias("segments"), children.alias("children"), "excluded", reason.alias("blocked_reason"),
        F.coalesce(F.size("parts"), F.lit(0)).cast("long").alias("n_selected"), body.alias("rendered"),
    )
    return out.select(identity(*[F.col(c) for c in IDENTITY]).alias("manifest_id"), *out.columns)


#: What a stored manifest may be at fault in, in the order in which it is looked for.
FAULTS = ("identity", "rendered_digest", "unit", "input", "segments", "tokens", "budget", "children")


def verified(stored: DataFrame, units: DataFrame, nodes: DataFrame, prompt: str, budget: int = BUDGET, known: DataFrame | None = None) -> DataFrame:
    """``manifest_id, fault`` of each stored manifest: the first of FAULTS that holds against units and nodes as they are now, else null.

    ``identity``: its id is not the digest of what it says. ``rendered_digest``: nor is that of its input. ``unit``: its unit is gone. ``input`` and
    ``segments``: the context would be rendered otherwise now. ``tokens``: another count. ``budget``: it doesn't fit. ``children``: other children, or another status.
    """
    now = manifests(units, nodes, prompt, budget, known)
    now = now.select(*[F.col(c).alias(f"now_{c}") for c in now.columns])
    met = stored.join(now, F.col("unit") == F.col("now_unit"), "left")
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"now_{c}"))
    holds = {
        "identity": F.col("manifest_id") != identity(*[F.col(c) for c in IDENTITY]),
        "rendered_digest": F.col("rendered_digest") != F.sha2("rendered", 256),
        "unit": F.col("now_unit").isNull(),
        "input": differs("rendered_digest"),
        "segments": differs("segments"),
        "tokens": tokens(F.col("rendered")) != F.col("input_tokens"),
        "budget": F.col("input_tokens") > budget,
        "children": differs("children") | differs("status"),
    }
    fault = F.lit(None).cast("string")
    for name in reversed(FAULTS):
        fault = F.when(F.coalesce(holds[name], F.lit(False)), name).otherwise(fault)
    return met.select("manifest_id", fault.alias("fault"))
