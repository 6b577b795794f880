"""Chat logs as events, folded into messages and rendered with reversible escapes.

An event log has rows ``(conv_id, seq, kind, role, target, text)``:

* ``message`` opens a message named by its ``seq`` with this role and text;
* ``delta`` adds its text to the message ``target``;
* ``edit`` sets the text of ``target``, whatever was there;
* ``regenerate`` empties ``target`` to be streamed anew by later deltas;
* ``delete`` withdraws ``target``.

Events of one message are applied by ``seq``: the last edit or regeneration cuts
off what came before. That makes the fold a window per message and an
aggregate per message and conversation; no Python runs on the executors.

A turn is rendered as ``<s>[role]\\n`` + text + ``</s>\\n``. Inside texts the
backslash, ``<`` and ``[`` are escaped, so no control string of this template, or of
any that opens with these brackets, can come out of a text, and reading back is exact. Roles
have their closing brackets escaped as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>[", "</s>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("]"), F.lit("\\e"))


def unescape(text: Column) -> Column:
    """Doubled backslashes are split off first; what is left has single ones alone."""
    plain = lambda t: F.replace(F.replace(F.replace(t, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")), F.lit("\\e"), F.lit("]"))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def fold(events: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of the messages that an event log leaves.

    Messages come in the order of their opening ``seq``. Events with a null
    or unknown target, and those before their message or after its deletion, change
    nothing; null text is empty. Rows with the same ``seq`` are applied by kind and text, so
    of messages with one ``seq`` (a repeated delivery) the last stands; a repeated delta is
    applied each time it is logged.
    """
    opens = F.col("kind") == "message"
    given = events.select("conv_id", "seq", "kind", "role", F.when(opens, F.col("seq")).otherwise(F.col("target")).alias("turn"), F.coalesce("text", F.lit("")).alias("text"))
    by_message = Window.partitionBy("conv_id", "turn").orderBy("seq", F.when(opens, 0).otherwise(1), "kind", "text")
    marked = given.where(F.col("turn").isNotNull()).withColumn("n", F.row_number().over(by_message))
    whole = Window.partitionBy("conv_id", "turn")
    cut = F.max(F.when(F.col("kind").isin("message", "edit", "regenerate"), F.col("n"))).over(whole)
    live = marked.withColumns({"cut": cut, "gone": F.max(F.col("kind") == "delete").over(whole), "opened": F.min(F.when(opens, F.col("n"))).over(whole)})
    live = live.where(~F.col("gone") & F.col("opened").isNotNull() & ((F.col("n") >= F.col("cut")) | opens))
    part = F.struct("n", F.when((F.col("n") >= F.col("cut")) & (F.col("kind") != "regenerate"), F.col("text")).otherwise("").alias("text"))
    messages = live.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max(F.when(opens, F.struct("n", "role"))).alias("who"))
    return messages.select("conv_id", "turn", F.col("who.role").alias("role"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """``conv_id, formatted``: the turns of each conversation in the template.

    Turns are ordered by ``turn``, then role and text; null text is empty, a
    null role is ``unknown``. Each row is a turn, repeated rows too. A null
    conv_id is a conversation of its own. Other columns are not read.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    one = lambda t: F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("]\n"), escape(t["text"]), F.lit(CLOSE))
    return grouped.select("conv_id", F.array_join(F.transform("turns", one), "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """``array<struct<role, text>>`` of a rendered conversation."""
    turns = F.filter(F.split(formatted, r"<s>\[", -1), lambda t: t != "")

    def one(t: Column) -> Column:
        role = F.substring_index(t, "]\n", 1)
        text = F.substring(t, F.length(role) + 3, F.length(t) - F.length(role) - 2 - len(CLOSE))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(turns, one)


def loss_text(turns: Column) -> Column:
    """The text that training is to predict: what the assistant said."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")


#: Events of one turn: the first names its message.
STEPS = 8


def as_events(conversations: DataFrame) -> DataFrame:
    """Turns as the event log that a chat service would have kept of them; folding it gives the turns back.

    Each row opens a message of its own, numbered by turn, role and text; rows without a turn come last. An
    assistant's text was streamed in two deltas, regenerated, and streamed again; a user's
    was sent without its second half and edited; other texts came whole.
    """
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    place = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), role, text)
    rows = conversations.select("conv_id", (F.row_number().over(place).cast("long") * STEPS).alias("first"), "role", text.alias("text"))
    half = F.ceil(F.length("text") / 2).cast("int")
    head, tail = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))

    def log(*steps: tuple[str, Column]) -> Column:
        one = lambda i, kind, said: F.struct((F.col("first") + i).alias("seq"), F.lit(kind).alias("kind"), F.when(F.lit(kind == "message"), F.col("role")).alias("role"), F.when(F.lit(kind != "message"), F.col("first")).alias("target"), said.alias("text"))
        return F.array(*[one(i, kind, said) for i, (kind, said) in enumerate(steps)])

    none = F.lit("")
    streamed = log(("message", none), ("delta", tail), ("delta", head), ("regenerate", none), ("delta", head), ("delta", tail))
    edited = log(("message", head), ("edit", F.col("text")))
    events = F.when(F.col("role") == "assistant", streamed).when(F.col("role") == "user", edited).otherwise(log(("message", F.col("text"))))
    return rows.select("conv_id", F.explode(events).alias("e")).select("conv_id", "e.seq", "e.kind", "e.role", "e.target", "e.text")
