"""URL filters: rules first, then the reputation of hosts by empirical Bayes.

Outcomes of labelled pages are counted per host. The rate of bad pages is
shrunk in steps, each a beta-binomial model whose prior is the level
above: the corpus, the suffix (``com``), the registered domain (``example.com``), the
host. With ``a`` bad ones of ``n``, and a rate ``m`` above, the posterior is
``Beta(m S + a, (1 - m) S + n - a)``, of mean ``(m S + a) / (S + n)``, where the
strength S of each level is estimated from how far rates of the level differ
beyond chance. A page is blocked if the lower bound of its host's posterior lies above the bar: the rate at which the odds of a
bad page are ``ODDS`` times those of the corpus. So the bar follows the corpus, and a host is blocked only
where it is credibly that much worse. A host without labels has the posterior of the level above it.

Levels are those of the host's name: user names and ports are left out, and an IPv4 address is its own domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.store import stash

# The rules that are asked for, as (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

#: Suffixes under which domains are registered, where no table of them is given; all other suffixes are the last label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br")
ODDS = 2.0
#: Standard deviations from the mean to the bound.
BOUND = 1.645
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. A rule fits its host, all hosts below it, and paths that begin with its own."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def name_of(host: Column) -> Column:
    """The host without user name and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


IPV4 = r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"


def levels_of(names: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``name, domain, suffix, corpus`` of each distinct ``name``, by the longest of ``suffixes(suffix)`` that it ends in."""
    labels = names.select("name").distinct().withColumn("labels", F.split("name", r"\."))
    tails = labels.select("name", F.size("labels").alias("n"), F.posexplode(F.transform("labels", lambda _, i: F.array_join(F.slice("labels", i + 1, F.size("labels")), "."))).alias("at", "tail"))
    longest = tails.join(suffixes.select(F.col("suffix").alias("tail")).distinct(), "tail", "left_semi").groupBy(F.col("name").alias("s_name")).agg(F.min("at").alias("at"))
    rows = labels.join(longest, F.col("name") == F.col("s_name"), "left").withColumn("cut", F.coalesce("at", F.size("labels") - 1))
    from_ = lambda i: F.array_join(F.slice("labels", F.greatest(i, F.lit(0)) + 1, F.size("labels")), ".")
    address = F.col("name").rlike(IPV4)
    return rows.select("name", F.when(address, F.col("name")).otherwise(from_(F.col("cut") - 1)).alias("domain"), F.when(address, "(address)").otherwise(from_(F.col("cut"))).alias("suffix"), F.lit(1).alias("corpus"))


def _level(counts: DataFrame, name: str, above: DataFrame | None, above_name: str | None) -> DataFrame:
    """``name, rate, strength``: posterior means of one level, given those of the level above."""
    rows = counts.groupBy(name, *([above_name] if above_name else [])).agg(F.sum("bad").alias("a"), F.sum("n").alias("n"))
    rows = rows.join(above.select(F.col(above_name).alias("__up"), F.col("rate").alias("m")), F.col(above_name) == F.col("__up")) if above is not None else rows.withColumn("m", F.lit(0.5))
    # Moments: the weighted scatter of rates around the level above, less what chance explains.
    chance = F.sum(F.col("m") * (1 - F.col("m")))
    scatter = F.sum(F.pow(F.col("a") - F.col("n") * F.col("m"), F.lit(2.0)) / F.col("n"))
    weight = F.sum((F.col("n") - 1) * F.col("m") * (1 - F.col("m")))
    share = F.least(F.greatest(F.try_divide(scatter - chance, weight), F.lit(1 / (1 + MOST_STRENGTH))), F.lit(1 / (1 + LEAST_STRENGTH)))
    strength = rows.agg(F.round(F.coalesce(1 / share - 1, F.lit(MOST_STRENGTH)), 6).alias("s"))
    s, m = F.col("s"), F.col("m")
    rate = F.round((m * s + F.col("a")) / (s + F.col("n")), 9)
    return stash(rows.join(F.broadcast(strength)).select(name, rate.alias("rate"), (s + F.col("n")).alias("weight")), f"level-{name}")


def reputation(counts: DataFrame) -> dict[str, DataFrame]:
    """Posteriors ``<level>, rate, weight`` of each level, from the highest: ``corpus`` (key 1), ``suffix``, ``domain`` and ``name``.

    ``counts``: labelled pages (``n``) and bad ones of them (``bad``) of each ``name``, with its levels.
    """
    out: dict[str, DataFrame] = {}
    above = None
    for level in ("corpus", "suffix", "domain", "name"):
        out[level] = _level(counts, level, out.get(above), above)
        above = level
    return out


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, suffixes: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, bound, low, bar`` of each row of ``pages(page_id, url)``.

    ``outcomes(page_id, bad)`` labels some pages (1: bad, 0: good; null: no
    label; the worst of repeated labels counts). ``suffixes(suffix)`` is a table of public suffixes. ``bound`` and ``low`` are
    the upper and lower bounds of the host's rate of bad pages. A null url, or one without
    ``://``, has an empty host and path, fits no rule and is judged by the corpus.
    Without any labels the rate is taken for even, with bounds so wide that all pages without a rule are
    allowed. Repeated rows are judged row by row; empty tables and other columns do no harm.
    """
    spark = pages.sparkSession
    if suffixes is None:
        suffixes = spark.createDataFrame([(s,) for s in SUFFIXES], "suffix string")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("name", name_of(F.col("host")))
    levels = stash(levels_of(rows, suffixes), "hosts")
    labels = outcomes.groupBy(F.col("page_id").alias("o_page")).agg(F.max("bad").alias("bad"))
    labelled = rows.where("host != ''").join(labels, F.col("page_id") == F.col("o_page"))
    counts = labelled.groupBy("name").agg(F.sum("bad").alias("bad"), F.count("bad").alias("n")).where("n > 0")
    posteriors = reputation(stash(counts.join(levels, "name"), "outcomes"))
    # One posterior for each host, not each page: a host with very many pages meets only one row.
    known = levels
    for name, level in posteriors.items():
        known = known.join(level.select(F.col(name).alias(f"k_{name}"), F.struct("rate", "weight").alias(f"p_{name}")), F.col(name) == F.col(f"k_{name}"), "left")
    none = F.struct(F.lit(0.5).alias("rate"), F.lit(LEAST_STRENGTH).alias("weight"))
    best = F.coalesce(*[F.col(f"p_{name}") for name in ("name", "domain", "suffix", "corpus")], none)
    off = BOUND * F.sqrt(best["rate"] * (1 - best["rate"]) / (best["weight"] + 1))
    usual = F.coalesce(F.col("p_corpus"), none)["rate"]
    bar = F.round(ODDS * usual / (1 - usual + ODDS * usual), 6)
    known = known.select(F.col("name").alias("k_name"), F.round(best["rate"] + off, 6).alias("bound"), F.round(best["rate"] - off, 6).alias("low"), bar.alias("bar"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("low") > F.col("bar"), "block").otherwise("allow")
    return rows.join(known, F.col("name") == F.col("k_name"), "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "bound", "low", "bar")


def outcomes_of(labels: DataFrame) -> DataFrame:
    """Page outcomes from a table of labelled ids: a page is bad if it is toxic or of low quality."""
    bad = F.greatest(F.col("toxic"), 1 - F.col("quality")).cast("long")
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
