"""Quality rules with thresholds that follow each language and source.

Fixed rules first (too few words, too much repetition). Then four ratios of
each text are compared with fences taken from quantile sketches of its (language, source).
A sketch counts values in buckets whose bounds grow by ``GROWTH``, so a quantile is within 0.1 % of a
value of its rank. Counts add up, in any order and to the same sum: sketches are made in
each task before anything is shuffled, merged upward to the language and to the corpus, and
runs over the same rows give the same verdicts. A group with fewer texts than ``MIN_ROWS`` takes the
fences of its language, and a language with fewer those of the corpus.

A fence stands ``FENCE_SPREADS`` spreads off the median. A spread is the distance of an inner quantile to
the median, which up to a quarter of junk does not reach; it counts for at most ``POOL`` times its language's
spread or the group's own median. Above it one incident (a symbol, a line, a repeated window) in
a text of median length is let through, as a smaller rate than that can't be told from none. A text is outside if its count
lies beyond the fence by more than the noise of counting, ``NOISE`` standard errors on the square-root scale.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.columns import named
from quillstone.llm.store import stash
from quillstone.llm.wordkernel import SMALL_SLICE_BYTES, SPACED, covered, per_doc, slices, string_buffer, words_of

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8

#: Ratio -> (numerator, denominator, what one incident adds to the numerator, which sides have a fence).
RATIOS = {
    "word_length": ("word_chars", "n_words", 1, ("low", "high")),
    "symbol_ratio": ("n_symbols", "n_words", 4, ("high",)),
    "dup_line_ratio": ("n_dup_lines", "n_lines", 1, ("high",)),
    "repeat_ratio": ("n_repeat_words", "n_words", REPEAT_WINDOW, ("high",)),
}
#: What is sketched besides: the lengths of texts.
SIZES = ("n_words", "n_lines")
#: Quantiles that the sketches are asked for, below and above the median alike.
INNER = 0.7
FENCE_SPREADS = 6.0
POOL = 2.0
NOISE = 1.5
MIN_ROWS = 100
GROWTH = 1.002
#: The bucket of zero.
ZERO = -(10**6)
#: Up to so many groups, of 60 bytes a fence, the fences are broadcast.
BROADCAST_GROUPS = 50_000

FEATURES = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")])


def _lines(raw: bytes) -> tuple[int, int]:
    """Lines that are not blank, and those of them that were there before."""
    seen: set[bytes] = set()
    n = 0
    for line in raw.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip():
            seen.add(line)
    return len(seen) + n, n


def _repeat_words(words) -> np.ndarray:
    grams, room = words.grams(REPEAT_WINDOW)
    at = np.flatnonzero(room)
    doc = words.doc
    keys = grams[at] + doc[at].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(at) + 1, dtype=bool)
    same[1:-1] = (keys[order][1:] == keys[order][:-1]) & (doc[at[order[1:]]] == doc[at[order[:-1]]])
    return per_doc(covered(len(words.hash), at[order[same[1:] | same[:-1]]], REPEAT_WINDOW), words.bounds)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "__text", SMALL_SLICE_BYTES):
        text = batch.column("__text")
        words = words_of(text, SPACED)
        raw, offsets = string_buffer(text)
        in_word = SPACED[raw] & ((raw & 0xC0) != 0x80)
        whole = raw.tobytes()
        lines = np.array([_lines(whole[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], dtype=np.int64).reshape(-1, 2)
        columns = [words.counts, per_doc(in_word, offsets), per_doc(SYMBOLS[raw], offsets), lines[:, 1], _repeat_words(words), lines[:, 0]]
        kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "__text"]
        names = [name for name in batch.schema.names if name != "__text"] + FEATURES.names
        yield pa.RecordBatch.from_arrays(kept + [pa.array(c, pa.int64()) for c in columns], names=names)


def measure(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the counts of FEATURES of ``text``; null text has no words."""
    keep = ["doc_id", "lang", "source"] if keep is None else keep
    given = docs.select(*[F.col(c) for c in keep], F.col("text").alias("__text"))
    schema = T.StructType([docs.schema[c] for c in keep] + FEATURES.fields)
    return given.mapInArrow(_measure, schema)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def _group(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(f"__{name}")


def sketches(features: DataFrame) -> DataFrame:
    """``__lang, __source, measure, bucket, k``: the sketch of each ratio and size in each group.

    Only texts that pass the fixed rules are counted. A group has some 1200 buckets a measure for each power of ten that its values span, whatever its size.
    """
    good = features.where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    values = {r: F.try_divide(F.col(top), F.col(of)) for r, (top, of, *_) in RATIOS.items()} | {c: F.col(c).cast("double") for c in SIZES}
    each = F.array(*[F.struct(F.lit(name).alias("measure"), v.alias("value")) for name, v in values.items()])
    rows = good.select(_group("lang"), _group("source"), F.explode(each).alias("m")).select("__lang", "__source", "m.measure", "m.value").where("value is not null")
    bucket = F.when(F.col("value") == 0, F.lit(ZERO)).otherwise(F.floor(F.log("value") / math.log(GROWTH))).cast("int")
    return rows.groupBy("__lang", "__source", "measure", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("k"))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """The groups ``by`` with ``n``, the texts in them, and ``<measure>_<low|mid|high>``, the three quantiles of each measure."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("k").alias("k"))
    whole = Window.partitionBy(*by, "measure")
    ranked = merged.withColumns({"upto": F.sum("k").over(whole.orderBy("bucket")), "n": F.sum("k").over(whole)})
    value = F.when(F.col("bucket") == ZERO, 0.0).otherwise(F.pow(F.lit(GROWTH), F.col("bucket") + 0.5))
    asked = {"low": 1 - INNER, "mid": 0.5, "high": INNER}
    at = [F.min(F.when(F.col("upto") >= q * F.col("n"), value)).alias(name) for name, q in asked.items()]
    rows = ranked.groupBy(*by, "measure").agg(F.max("n").alias("n"), *at)
    wide = [F.max(F.when(F.col("measure") == m, F.col(q))).alias(f"{m}_{q}") for m in (*RATIOS, *SIZES) for q in asked]
    return rows.groupBy(*by).agg(F.max(F.when(F.col("measure") == "n_words", F.col("n"))).alias("n"), *wide)


def thresholds(features: DataFrame) -> DataFrame:
    """Fences per (language, source) present in ``features``: ``__lang, __source, <ratio>_<side>``.

    Null languages and sources form groups of their own, with the empty name.
    A group of which no text passes the fixed rules has no row, and no text of it needs one.
    """
    sketch = stash(sketches(features), "sketches")
    groups = quantiles(sketch, ["__lang", "__source"])
    names = [c for c in groups.columns if not c.startswith("__")]
    language = quantiles(sketch, ["__lang"]).select(F.col("__lang"), *[F.col(c).alias(f"l_{c}") for c in names])
    corpus = quantiles(sketch.withColumn("__all", F.lit(1)), ["__all"]).select("__all", *[F.col(c).alias(f"c_{c}") for c in names])
    rows = groups.join(language, "__lang").withColumn("__all", F.lit(1)).join(F.broadcast(corpus), "__all")  # one row
    wide = lambda c: F.when(F.col("l_n") >= MIN_ROWS, F.col(f"l_{c}")).otherwise(F.col(f"c_{c}"))
    pick = lambda c: F.when(F.col("n") >= MIN_ROWS, F.col(c)).otherwise(wide(c))
    out = [F.col("__lang"), F.col("__source")]
    for r, (_, of, incident, sides) in RATIOS.items():
        for side in sides:
            sign = 1 if side == "high" else -1
            own, around = (F.abs(p(f"{r}_{side}") - p(f"{r}_mid")) for p in (pick, wide))
            spread = F.least(own, POOL * F.greatest(around, pick(f"{r}_mid")))
            out.append((pick(f"{r}_mid") + sign * (FENCE_SPREADS * spread + F.try_divide(F.lit(float(incident)), pick(f"{of}_mid")))).alias(f"{r}_{side}"))
    return rows.select(*out)


def judge(features: DataFrame, fences: DataFrame) -> DataFrame:
    """``features`` with ``base_failed`` and ``kept``, by a join with the fences of each row's group."""
    inside = F.lit(True)
    for r, (top, of, incident, sides) in RATIOS.items():
        for side in sides:
            # Incidents have about a constant spread of one half once their root is taken.
            root = lambda c: F.sqrt(F.greatest(c, F.lit(0.0)) / incident + 0.375)  # noqa: B023, E731
            off = root(F.col(top).cast("double")) - root(F.col(of) * F.col(f"{r}_{side}"))
            within = off <= NOISE / 2 if side == "high" else off >= -NOISE / 2
            inside = inside & F.coalesce(within, F.lit(True))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    small = fences.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    fences = F.broadcast(fences) if small else fences  # else Spark shuffles both sides and splits skewed groups
    joined = features.withColumns({"__lang": _group("lang"), "__source": _group("source")}).join(fences, ["__lang", "__source"], "left")
    return joined.select(*[F.col(c) for c in features.columns], failed.alias("base_failed"), (~failed & inside).alias("kept"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, lang, source)``: the counts of FEATURES, ``base_failed`` and ``kept``.

    Null text: no words, so ``base_failed``. Empty and one-word texts likewise.
    Null ``lang`` or ``source``: a group of its own. Repeated rows are judged
    row by row. An empty table gives an empty result. Other columns are not
    read. Very long texts are handled whole. Texts are read once; their counts are written and serve both passes.
    """
    features = stash(measure(docs), "features")
    return judge(features, stash(thresholds(features), "fences"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns unchanged.

    Nulls, empty and long texts, repeated rows and empty tables are as in ``quality_rules``; columns may have any names.
    The rows are written with their counts, so that no text is measured twice or shuffled.
    """
    inner = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[named(c).alias(n) for c, n in inner.items()], F.col("text"), F.col("lang"), F.col("source"))
    features = stash(measure(plain, [*inner.values(), "lang", "source"]), "measured")
    kept = judge(features, stash(thresholds(features), "fences")).where(F.col("kept"))
    return kept.select(*[F.col(n).alias(c) for c, n in inner.items()])
