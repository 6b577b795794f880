"""Places of pattern matches in texts, by built-in functions alone.

Running sums and extremes over an array go block by block, with about as many blocks as
elements in a block: a fold that appends to an array copies it at each step,
and so no array that is copied is long. A text with very many matches takes little more than linear time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"
FAR = 2**31 - 1


def blocks(items: Column) -> Column:
    """The elements of an array in order, in arrays of about the square root of its size. ``items`` is read for each block."""
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items))).cast("int"))
    first = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), size)).otherwise(F.array().cast("array<int>"))
    return F.transform(first, lambda i: F.slice(items, i, size))


def before(values: Column, join: Callable[[Column, Column], Column], zero: int) -> Column:
    """For each element of an array of ints, what ``join`` makes of ``zero`` and all elements before it."""

    def running(items: Column, start: Column) -> Column:
        step = lambda done, v: F.struct(join(done["at"], v).alias("at"), F.concat(done["out"], F.array(done["at"])).alias("out"))
        return F.aggregate(items, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), step)["out"]

    def by_block(split: Column) -> Column:
        whole = F.transform(split, lambda b: F.aggregate(b, F.lit(zero), join))
        return F.flatten(F.zip_with(split, running(whole, F.lit(zero)), running))

    return given(given(values, blocks), by_block)


def matches(text: Column, pattern: str, wanted=None) -> Column:
    """``array<struct<start, end, value>>`` of the leftmost non-overlapping matches; code points, end exclusive.

    The matches and the gaps between them alternate, so their lengths add up to
    the places. The pattern must not match the empty string. Null text: none. With
    ``wanted``, only the matches whose value it says true of.
    """
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))

    def placed(pairs: Column) -> Column:
        lengths = F.transform(pairs, lambda x: x["gap"] + F.coalesce(F.length(x["m"]), F.lit(0)))
        spans = F.zip_with(pairs, before(lengths, lambda a, b: a + b, 0), lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + F.length(x["m"])).alias("end"), x["m"].alias("value")))
        return F.filter(spans, lambda s: s["value"].isNotNull() if wanted is None else s["value"].isNotNull() & wanted(s["value"]))

    return F.when(text.rlike(pattern), given(pairs, placed)).otherwise(F.array().cast(SPAN))


def given(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tagged(spans: Column, kind: str) -> Column:
    """The spans with a ``kind``."""
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas in the given order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def clear_of(spans: Column, others: Column) -> Column:
    """The spans, by place, that overlap none of the others.

    All are put in order of their starts. A span overlaps an earlier one if it starts before the
    last end so far, and a later one if that starts before its end.
    """
    one = lambda s, mine: F.struct(s["start"].alias("start"), F.lit(mine).alias("mine"), s["end"].alias("end"), s["value"].alias("value"))
    both = F.array_sort(F.concat(F.transform(spans, lambda s: one(s, True)), F.transform(others, lambda s: one(s, False))))

    def kept(both: Column) -> Column:
        ends = before(F.transform(both, lambda s: F.when(s["mine"], F.lit(0)).otherwise(s["end"])), lambda a, b: F.greatest(a, b), 0)
        starts = F.reverse(before(F.reverse(F.transform(both, lambda s: F.when(s["mine"], F.lit(FAR)).otherwise(s["start"]))), lambda a, b: F.least(a, b), FAR))
        free = F.zip_with(F.zip_with(both, ends, lambda s, e: F.struct(s.alias("s"), (s["mine"] & (s["start"] >= e)).alias("free"))), starts, lambda x, n: F.struct(x["s"].alias("s"), (x["free"] & (x["s"]["end"] <= n)).alias("free")))
        return F.transform(F.filter(free, lambda x: x["free"]), lambda x: F.struct(x["s"]["start"].alias("start"), x["s"]["end"].alias("end"), x["s"]["value"].alias("value")))

    return F.when(F.size(others) == 0, spans).otherwise(given(both, kept))


def replaced(text: Column, spans: Column, label) -> Column:
    """``text`` with each span replaced by ``label(span)``; of overlapping spans the first one's label stands for all."""
    order = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))

    def cut(order: Column) -> Column:
        last = before(F.transform(order, lambda s: s["end"]), lambda a, b: F.greatest(a, b), 0)
        # The end so far of a span that begins a new group is where the text before it begins.
        heads = F.filter(F.zip_with(order, last, lambda s, at: F.struct(s.alias("s"), at.alias("at"))), lambda x: x["s"]["start"] >= x["at"])

        def part(block: Column) -> Column:
            begin = F.get(block, F.lit(0))["at"]
            stretch = F.substring(text, begin + 1, F.element_at(block, -1)["s"]["start"] - begin)
            each = lambda t: F.transform(block, lambda x: F.concat(F.substring(t, x["at"] - begin + 1, x["s"]["start"] - x["at"]), label(x["s"])))
            return F.array_join(given(stretch, each), "")

        rest = F.substring(text, F.array_max(F.transform(order, lambda s: s["end"])) + 1, F.length(text))
        return F.concat(F.array_join(F.transform(given(heads, blocks), part), ""), rest)

    return F.when(F.size(spans) == 0, text).otherwise(given(order, cut))
