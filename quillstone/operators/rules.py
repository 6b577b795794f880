"""Rules over records: forbidden keys at any depth of JSON, and paths under a table of prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A string of JSON with what makes it a key. Runs are taken whole and not given back, so long strings take linear time.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?+'


def keys(json: Column) -> Column:
    """The keys of all objects of a JSON text at any depth, in order, unescaped; null if it is no JSON.

    Every quote of valid JSON begins or ends a string, and a string with a colon after it is a key, so one pass
    over the text finds them all, whatever the nesting.
    """
    found = F.filter(F.regexp_extract_all(json, F.lit(_STRING), F.lit(0)), lambda s: s.endswith(":"))
    quoted = F.transform(found, lambda s: F.regexp_replace(s, r"\s*:$", ""))
    whole = F.from_json(F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]")), "array<string>")
    return F.when(F.try_parse_json(json).isNotNull(), whole)


def has_key(json: Column, forbidden: list[str]) -> Column:
    """Whether a JSON text has one of these keys at any depth, whatever its case; null if it is no JSON."""
    return F.exists(keys(json), lambda k: F.lower(k).isin(*[f.lower() for f in forbidden]))


def ancestors(path: Column) -> Column:
    """A path and all that it is under, the longest first: ``a/b/c``, ``a/b/``, ``a/``."""
    parts = F.split(path, "/", -1)
    over = F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))
    return F.array_distinct(F.concat(F.array(path), F.when(F.size(parts) > 1, over).otherwise(F.array().cast("array<string>"))))


def longest_rule(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """``id, path, rule, verdict`` of each of ``paths(id, path)``: the longest of ``rules(rule, verdict)`` that it falls under, else nulls.

    A rule that ends in a slash holds for all paths under it, any other for just that path. Paths meet rules by equality with what they are under, so
    any number of rules is one join. Equal rules with different verdicts: the least verdict counts. A null path falls under none.
    """
    named = rules.groupBy(F.col("rule").alias("r_rule")).agg(F.min("verdict").alias("verdict"))
    own = paths.select("id", "path", F.explode_outer(ancestors(F.col("path"))).alias("under"))
    met = own.join(named, F.col("under") == F.col("r_rule"), "left")
    best = F.max(F.when(F.col("r_rule").isNotNull(), F.struct(F.length("r_rule").alias("n"), F.col("r_rule").alias("rule"), "verdict")))
    return met.groupBy("id", "path").agg(best.alias("best")).select("id", "path", F.col("best")["rule"].alias("rule"), F.col("best")["verdict"].alias("verdict"))


def first_broken(rules: dict[str, Column], none: str = "none") -> Column:
    """The name of the first rule, of those in order, that doesn't hold; a rule that can't be told is broken."""
    out = F.lit(none)
    for name, holds in reversed(rules.items()):
        out = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out
