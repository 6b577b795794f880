"""Secrets: fixed patterns, and tokens that a battery of randomness tests finds random.

Candidates are runs of 16 characters or more of the base-64 alphabets; a shorter run that
never repeats a symbol is too common in text (its chance is over 0.001) to be told from it. The
smallest of the usual alphabets that holds a run is its encoding. A random run passes
three tests: chi-squared uniformity of its symbols, the number of runs above and
below the middle of the alphabet, and the serial correlation of neighbours.
Passing is no proof, as a short word passes too: so the chance that ordinary text of the
same length would be as even is computed from the corpus's own symbol frequencies
(at first from those of letters and digits in general, within the encoding's alphabet),
and candidates are taken by Benjamini-Hochberg within each class of length.

All of it is built-in functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.spans import clear_of, listed, matches, tagged
from quillstone.llm.store import stash

# The patterns that are asked for.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"

KINDS = ("assign", "access", "hex")
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings from the smallest alphabet on.
ALPHABETS = [
    ("decimal", _DIGITS),
    ("hex", _DIGITS + "abcdef"),
    ("hex_upper", _DIGITS + "ABCDEF"),
    ("base32", _UPPER + "234567"),
    ("base36", _DIGITS + _LOWER),
    ("base36_upper", _DIGITS + _UPPER),
    ("base62", _DIGITS + _UPPER + _LOWER),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64_url", _UPPER + _LOWER + _DIGITS + "-_"),
    ("base64_mixed", _UPPER + _LOWER + _DIGITS + "+/-_"),
]
#: A run that fails a test at this level isn't random.
FAILED = 0.001
#: The share of false findings that is let through.
FALSE_SHARE = 0.01
# Letters of English text in per mille, from e to z, and leading digits (Benford) likewise.
_LETTERS = dict(zip("etaoinshrdlcumwfgypbvkjxqz", (127, 91, 82, 75, 70, 67, 63, 61, 60, 43, 40, 28, 28, 24, 24, 22, 20, 20, 19, 15, 10, 8, 1.5, 1.5, 1, 0.7)))
_LEADING = dict(zip(_DIGITS, (20, 301, 176, 125, 97, 79, 67, 58, 51, 46)))
#: How often text has the lower and upper case, digits and other symbols, and how many symbols that prior is worth.
_CASES = (0.9, 0.06, 0.035, 0.005)
TEXT_WEIGHT = 100.0


def text_rates(symbols: str) -> tuple[float, float]:
    """How often two, and three, symbols of text are the same where it has none but these symbols."""
    weights = [
        _CASES[0] * _LETTERS[c] if c in _LETTERS else _CASES[1] * _LETTERS[c.lower()] if c.lower() in _LETTERS else _CASES[2] * _LEADING[c] if c in _LEADING else _CASES[3] * 250
        for c in symbols
    ]
    total = sum(weights)
    return sum((w / total) ** 2 for w in weights), sum((w / total) ** 3 for w in weights)


#: Chances are counted in steps of 1 / P_STEPS of a natural logarithm.
P_STEPS = 20
P_LAST = 40 * P_STEPS


def normal_tail(z: Column) -> Column:
    """P(Z > z): the rational approximation 26.2.17 of Abramowitz and Stegun."""
    # Its coefficients.
    coefficients = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = F.lit(0.0)
    for c in reversed(coefficients):
        series = t * (c + series)
    upper = F.exp(-z * z / 2) / 2.5066282746310002 * series
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _alphabet_of(token: Column) -> Column:
    out = None
    for name, symbols in ALPHABETS:
        fits = F.length(F.translate(token, symbols, "")) == 0
        one = F.struct(F.lit(name).alias("encoding"), F.lit(symbols).alias("symbols"))
        out = F.when(fits, one) if out is None else out.when(fits, one)
    return out


def _tests(found: DataFrame) -> DataFrame:
    """For each candidate ``token`` its length, chi-squared value and the three tests as normal deviates."""
    body = F.rtrim(F.col("token"), F.lit("="))
    rows = found.withColumn("body", body).withColumn("alphabet", _alphabet_of(F.col("body"))).where(F.col("alphabet").isNotNull())
    rows = rows.withColumns({"n": F.length("body").cast("double"), "size": F.length("alphabet.symbols").cast("double"), "letters": F.filter(F.split("body", ""), lambda c: c != "")})
    squares = F.aggregate(F.array_distinct("letters"), F.lit(0.0), lambda s, c: s + F.pow(F.col("n") - F.length(F.replace(F.col("body"), c, F.lit(""))), F.lit(2.0)))
    rows = rows.withColumn("chi", F.col("size") / F.col("n") * squares - F.col("n"))
    freedom = F.col("size") - 1
    wilson = (F.pow(F.greatest(F.col("chi"), F.lit(0.0)) / freedom, F.lit(1 / 3)) - (1 - 2 / (9 * freedom))) / F.sqrt(2 / (9 * freedom))
    place = F.transform("letters", lambda c: F.instr(F.col("alphabet.symbols"), c) - (F.col("size") + 1) / 2)
    rows = rows.withColumns({"z_chi": wilson, "place": place})
    above = F.size(F.filter("place", lambda v: v > 0)).cast("double")
    follow = F.zip_with(F.slice("place", 1, F.size("place") - 1), F.slice("place", 2, F.size("place") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = rows.withColumns({"above": above, "pairs": follow})
    rows = rows.withColumns(
        {
            "runs": F.lit(1.0) + F.size(F.filter("pairs", lambda p: (p["a"] > 0) != (p["b"] > 0))),
            "cross": F.aggregate("pairs", F.lit(0.0), lambda s, p: s + p["a"] * p["b"]),
            "power": F.aggregate("place", F.lit(0.0), lambda s, v: s + v * v),
        }
    )
    below = F.col("n") - F.col("above")
    product = 2 * F.col("above") * below
    spread = product * (product - F.col("n")) / (F.col("n") * F.col("n") * (F.col("n") - 1))
    z_runs = F.when(spread > 0, (F.col("runs") - product / F.col("n") - 1) / F.sqrt(spread)).otherwise(F.lit(99.0))
    z_serial = F.when(F.col("power") > 0, F.col("cross") / F.col("power") * F.sqrt("n")).otherwise(F.lit(99.0))
    scores = [F.col("alphabet.encoding").alias("encoding"), "n", "size", "letters", "chi"]
    return stash(rows.select(*found.columns, *scores, "z_chi", F.abs(z_runs).alias("z_runs"), F.abs(z_serial).alias("z_serial")), "tokens")


def _text_rates(tested: DataFrame) -> DataFrame:
    """``r_encoding, squares, cubes``: how often two, and three, symbols of ordinary text are the same. One row for each of ALPHABETS."""
    letters = tested.where(F.col("p_chi") < FAILED).select("encoding", F.explode("letters").alias("letter")).groupBy("encoding", "letter").agg(F.count(F.lit(1)).alias("k"))
    total = letters.groupBy("encoding").agg(F.sum("k").cast("double").alias("t"), F.sum(F.pow("k", F.lit(2.0))).alias("s"), F.sum(F.pow("k", F.lit(3.0))).alias("c"))
    general = tested.sparkSession.createDataFrame([(name, *text_rates(symbols)) for name, symbols in ALPHABETS], "r_encoding string, s0 double, c0 double")
    share = F.coalesce(F.col("t") / (F.col("t") + TEXT_WEIGHT), F.lit(0.0))
    seen = lambda own, power: F.coalesce(F.col(own) / F.pow("t", F.lit(power)), F.lit(0.0))
    mixed = [(share * seen(own, power) + (1 - share) * F.col(prior)).alias(name) for own, power, prior, name in (("s", 2.0, "s0", "squares"), ("c", 3.0, "c0", "cubes"))]
    return general.join(total, F.col("r_encoding") == F.col("encoding"), "left").select("r_encoding", *mixed)


def random_tokens(found: DataFrame) -> DataFrame:
    """The rows of ``found(token, ...)`` whose token the battery takes for random."""
    chances = [normal_tail(F.col("z_chi")).alias("p_chi"), (2 * normal_tail(F.col("z_runs"))).alias("p_runs"), (2 * normal_tail(F.col("z_serial"))).alias("p_serial")]
    tested = _tests(found).select("*", *chances)
    rates = stash(_text_rates(tested), "rates")
    rows = tested.join(F.broadcast(rates), F.col("encoding") == F.col("r_encoding"))
    s, c, n = F.col("squares"), F.col("cubes"), F.col("n")
    # The mean and variance of chi-squared when symbols come with the frequencies of text.
    mean = F.col("size") * ((n - 1) * s + 1) - n
    variance = F.pow(F.col("size") / n, F.lit(2.0)) * 2 * n * (n - 1) * (s + 2 * (n - 2) * c - (2 * n - 3) * s * s)
    rows = rows.withColumn("z", (mean - F.col("chi")) / F.sqrt(F.greatest(variance, F.lit(1e-9))))
    p_text = F.greatest(normal_tail(F.col("z")), F.lit(1e-300))
    passes = (F.col("p_chi") >= FAILED) & (F.col("p_runs") >= FAILED) & (F.col("p_serial") >= FAILED)
    step = F.least(F.floor(-F.log(F.when(passes, p_text).otherwise(F.lit(1.0))) * P_STEPS), F.lit(P_LAST)).cast("int")
    rows = stash(rows.select(*found.columns, step.alias("step"), F.floor(F.log2("n") * 2).cast("int").alias("class")), "chances")
    steps = rows.groupBy("class", "step").agg(F.count(F.lit(1)).alias("k"))  # a few classes of P_LAST + 1 steps at most
    ahead = Window.partitionBy("class").orderBy(F.desc("step"))
    ranked = steps.select("class", "step", F.sum("k").over(ahead).alias("rank"), F.sum("k").over(Window.partitionBy("class")).alias("m"))
    enough = F.exp(-F.col("step") / P_STEPS) <= FALSE_SHARE * F.col("rank") / F.col("m")
    bar = ranked.where(enough).groupBy(F.col("class").alias("b_class")).agg(F.min("step").alias("bar"))
    return rows.join(F.broadcast(bar), F.col("class") == F.col("b_class")).where(F.col("step") >= F.col("bar")).select(*found.columns)


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each fixed kind."""
    return {
        "assign": F.filter(matches(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN_VALUE, 1)) >= 6),
        "access": matches(text, ACCESS),
        "hex": matches(text, HEX),
    }


def secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, base, random`` of each row of ``docs(doc_id, text)``.

    ``base``: spans of the fixed kinds (``kind, start, end, value``) by start,
    then kind as listed. ``random``: spans of tokens that the battery finds
    random and that overlap no base span, by start. Null text is empty. Repeated
    rows get the same spans, a null doc_id is kept; empty tables and other columns do no
    harm, and texts of any length are searched whole.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.sha2("text", 256).alias("row"), *[c.alias(k) for k, c in base_spans(F.col("text")).items()], matches(F.col("text"), CANDIDATE).alias("found"))
    order = {k: i for i, k in enumerate(KINDS)}
    ranked = lambda k: F.transform(tagged(F.col(k), k), lambda s: F.struct(s["start"].alias("start"), F.lit(order[k]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    base = F.transform(F.array_sort(F.concat(*[ranked(k) for k in KINDS])), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    rows = rows.select("doc_id", "row", base.alias("base"), "found")
    rows = stash(rows.select("doc_id", "row", "base", clear_of(F.col("found"), F.col("base")).alias("found")), "secrets")
    tokens = rows.select("row", F.explode("found").alias("s")).distinct().select("row", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.value").alias("token"))
    more = random_tokens(tokens).groupBy(F.col("row").alias("t_row")).agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("token").alias("value")))).alias("random"))
    nothing = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return rows.join(more, F.col("row") == F.col("t_row"), "left").select("doc_id", "base", F.coalesce("random", nothing).alias("random"))


def digests(found: DataFrame) -> DataFrame:
    """Counts and lists of the spans of each row."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.array_sort(F.transform(F.concat("base", tagged(F.col("random"), "random")), lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, (*KINDS, "random"))), s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return found.select("doc_id", *map(n, KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(every).alias("spans"))
