"""Personal data: fixed patterns, and terms that give a protected entity away.

An entity is a value that a pattern finds (an e-mail address, say). A term of
the same documents discloses it as far as the two occur together more than chance
would have it: with N documents and their counts n, the term tells
``PMI = log2(n(e, t) N / (n(e) n(t)))`` of the entity's own information
``IC = log2(N / n(e))``. That share is weighed by its evidence: each context after
the first is worth PMI bits, and B bits weigh ``B / (B + DOUBT)``. Copies of a document
repeat one context, and a single context weighs nothing, as it fits each word of its document
alike. Terms that tell ``GENERALISE`` or more are generalised to a class, those
that tell ``REMOVE`` or more are removed, wherever they stand in any document.
Counts cover all documents and whole texts.

All of it is built-in functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.columns import unwrapped, wrapped
from quillstone.llm.inplace import parted
from quillstone.llm.spans import blocks, given, listed, matches, replaced, tagged
from quillstone.llm.store import fits, stash, within_bounds

# The patterns that are asked for. A run is entered only at its
# beginning or where the last match ended, and is not given back, so that long runs take linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

KINDS = ("email", "ip", "card", "phone")
TERM = r"[\p{L}\p{N}]++"
#: Code points on each side of an entity that tell its context from others.
REACH = 60
#: Bits of evidence that weigh a half.
DOUBT = 1.0
GENERALISE = 0.8
REMOVE = 0.95


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _ip_valid(value: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each fixed kind."""
    return {
        "email": matches(text, EMAIL),
        "ip": F.filter(matches(text, IP), lambda s: _ip_valid(s["value"])),
        "card": F.filter(matches(text, CARD), lambda s: F.length(_digits(s["value"])).between(13, 19) & F.call_function("luhn_check", _digits(s["value"]))),
        "phone": F.filter(matches(text, PHONE), lambda s: F.length(_digits(s["value"])).between(9, 15)),
    }


def _entity(s: Column) -> Column:
    """One name for all spellings of a value."""
    return F.concat_ws(":", s["kind"], F.when(s["kind"] == "email", F.lower(s["value"])).when(s["kind"] == "ip", s["value"]).otherwise(_digits(s["value"])))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _row(text: Column) -> Column:
    """The name of a text: all that is found in it depends on it alone."""
    return F.sha2(text, 256)


def _masked(text: Column, base: Column) -> Column:
    """The text with blanks in place of base spans, so that terms keep their places and overlap none of these."""
    return replaced(text, base, lambda s: F.repeat(F.lit(" "), s["end"] - s["start"]))


def _found(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, row, base`` (all base spans, by kind and place), ``entities`` with their contexts, and, where there are any, the ``terms`` outside of them."""
    rows = docs.select("doc_id", "text", *[c.alias(k) for k, c in base_spans(F.col("text")).items()])
    rows = rows.select("doc_id", "text", F.concat(*[tagged(F.col(k), k) for k in KINDS]).alias("base"))

    def contexts(block: Column) -> Column:
        """The mentions of a block of spans with their contexts, cut from the stretch of text that holds them all."""
        begin = F.greatest(F.array_min(F.transform(block, lambda s: s["start"])) - REACH, F.lit(0))
        stretch = F.substring(F.col("text"), begin + 1, F.array_max(F.transform(block, lambda s: s["end"])) + REACH - begin)

        def around(t: Column, s: Column) -> Column:
            lead = F.greatest(s["start"] - REACH, F.lit(0))
            before, after = F.substring(t, lead - begin + 1, s["start"] - lead), F.substring(t, s["end"] - begin + 1, F.lit(REACH))
            return F.struct(_entity(s).alias("entity"), F.xxhash64(before, after).alias("context"))

        return given(stretch, lambda t: F.transform(block, lambda s: around(t, s)))

    terms = F.when(F.size("base") > 0, _terms(_masked(F.col("text"), F.col("base"))))
    return rows.select("doc_id", _row(F.col("text")).alias("row"), "base", F.flatten(F.transform(given(F.col("base"), blocks), contexts)).alias("entities"), terms.alias("terms"))


def _disclosing(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``term, share``: terms that disclose at least GENERALISE of some entity's information, and the most that they do.

    What can't reach that is left out before any pair is made: entities with one context, terms that stand in one text
    with an entity, and, as n(e, t) <= n(e), terms that are more common than ``N (n(e) / N) ** GENERALISE``. Terms that stand in the same texts have
    the same counts with every entity, so one of them stands for all of its class.
    """
    held = found.where(F.size("entities") > 0).select("row", "entities", "terms")
    # An entity counts once a row, with one of its contexts; repeated rows count as often as they are there.
    ordered = held.select("row", F.array_sort("entities").alias("es"))
    once = F.filter("es", lambda e, i: (i == 0) | (F.get("es", i - 1)["entity"] != e["entity"]))
    mentions = ordered.select("row", F.explode(once).alias("e")).groupBy("row", "e.entity").agg(F.min("e.context").alias("context"), F.count(F.lit(1)).alias("copies"))
    mentions = stash(mentions, "mentions")
    size = docs.agg(F.count(F.lit(1)).alias("n"))
    several = mentions.groupBy(F.col("entity").alias("of")).agg(F.sum("copies").alias("n_entity"), F.min("context").alias("low"), F.max("context").alias("high")).where("low != high")
    most = 1.000001 * F.col("n") * F.pow(F.col("n_entity") / F.col("n"), F.lit(GENERALISE))
    entities = several.join(F.broadcast(size)).select("of", "n_entity", "n", most.alias("most"))  # one row
    known = stash(mentions.join(entities, F.col("entity") == F.col("of")).drop("of"), "known")
    if known.isEmpty():
        return docs.sparkSession.createDataFrame([], "term string, share double")

    texts = held.join(known.select(F.col("row").alias("k_row")), F.col("row") == F.col("k_row"), "left_semi").dropDuplicates(["row"])
    terms = stash(texts.select("row", F.explode("terms").alias("term")), "terms")
    # Two sums of hashes name the set of texts that a term stands in.
    place = [F.sum(F.xxhash64("row", F.lit(salt)).cast("decimal(20,0)")).alias(f"at{salt}") for salt in (1, 2)]
    sets = terms.groupBy("term").agg(F.count(F.lit(1)).alias("texts"), *place).where("texts > 1")
    counted = _occurring(docs, sets.select("term")).groupBy("word").agg(F.count(F.lit(1)).alias("n_term"))
    bound = known.agg(F.max("most").alias("bound"))
    rare = counted.join(F.broadcast(bound)).where(F.col("n_term") <= F.col("bound")).select("word", "n_term")  # one row
    sets = stash(sets.join(rare, F.col("term") == F.col("word")).drop("word"), "rare")
    of = ["texts", "at1", "at2", "n_term"]
    firsts = sets.groupBy(*of).agg(F.min("term").alias("first"))
    at = terms.join(firsts.select("first", "n_term"), F.col("term") == F.col("first")).select("row", "term", "n_term")
    pairs = at.join(known.withColumnRenamed("row", "k_row"), (F.col("row") == F.col("k_row")) & (F.col("n_term") <= F.col("most")))
    pairs = pairs.groupBy("entity", "term", "context").agg(F.sum("copies").alias("k"), *[F.first(c).alias(c) for c in ("n_term", "n_entity", "n")])
    pairs = pairs.groupBy("entity", "term").agg(F.sum("k").alias("n_pair"), F.count(F.lit(1)).alias("contexts"), *[F.first(c).alias(c) for c in ("n_term", "n_entity", "n")])
    own = F.log2(F.col("n") / F.col("n_entity"))
    told = F.log2(F.col("n_pair") * F.col("n") / (F.col("n_entity") * F.col("n_term")))
    bits = (F.col("contexts") - 1) * told
    weighed = pairs.where((F.col("contexts") > 1) & (own > 0) & (told > 0)).select("term", (told / own * bits / (bits + DOUBT)).alias("share"))
    shares = weighed.where(F.col("share") >= GENERALISE).groupBy(F.col("term").alias("told")).agg(F.max("share").alias("share"))
    classes = firsts.join(shares, F.col("first") == F.col("told")).select(*[F.col(c).alias(f"c_{c}") for c in of], "share")
    same = [F.col(c) == F.col(f"c_{c}") for c in of]
    return sets.join(classes, same[0] & same[1] & same[2] & same[3]).select("term", "share")


def _occurring(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``row, word``: each of the terms in each row that it stands in. Words that are no terms stay in their task if the terms are few enough."""
    terms = within_bounds(stash(terms.select(F.col("term").alias("t")), "asked"), 20 + F.octet_length("t"))
    words = docs.select(_row(F.col("text")).alias("row"), F.explode(_terms(F.col("text"))).alias("word"))
    return words.join(terms, F.col("word") == F.col("t"), "left_semi")


def sanitise(docs: DataFrame) -> DataFrame:
    """``f_doc, row, base, terms`` (``f_doc`` is the doc_id) of each row of ``docs(doc_id, text)``; ``row`` is the SHA-256 of its text.

    ``base``: spans of the fixed kinds (``kind, start, end, value``), by kind and
    place. ``terms``: the disclosing terms' spans (``start, end, value, share``), by place; none overlaps a
    base span. Null text is empty. Repeated rows count as often as they are there, and get the same spans;
    a null doc_id is kept. Empty tables and other columns do no harm; texts of any length are searched whole.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = stash(_found(own), "personal")
    told = stash(_disclosing(own, found), "disclosing")
    nothing = F.array().cast("array<struct<start:int,end:int,value:string,share:double>>")
    if told.isEmpty():
        return found.select(F.col("doc_id").alias("f_doc"), "row", "base", nothing.alias("terms"))
    texts = own.select(_row(F.col("text")).alias("t_row"), "text")
    words = _occurring(own, told).join(told, F.col("word") == F.col("term"))
    hits = words.groupBy(F.col("row").alias("h_row")).agg(F.collect_set(F.struct("term", "share")).alias("told"))
    hits = stash(hits, "told")
    # Texts without such terms stay in their tasks: by a broadcast of all hits where these are few, else of the hashes of the texts that have some, else not at all.
    if fits(hits, 100 + 40 * F.size("told")):
        hits = F.broadcast(hits)
    else:
        held = hits.select(F.xxhash64("h_row").alias("held"))
        texts = texts.join(F.broadcast(held), F.xxhash64("t_row") == F.col("held"), "left_semi") if fits(held, F.lit(16)) else texts
    bases = found.select(F.col("row").alias("b_row"), F.col("base").alias("b_base")).join(hits.select("h_row"), F.col("b_row") == F.col("h_row"), "left_semi").dropDuplicates(["b_row"])
    bases = within_bounds(stash(bases, "bases"), 100 + 60 * F.size("b_base"))
    at = texts.join(hits, F.col("t_row") == F.col("h_row")).join(bases, F.col("t_row") == F.col("b_row"))  # each copy in its own task; spans are shuffled, not texts
    share = lambda v: F.try_element_at(F.col("told"), F.lower(v))
    spans_in = lambda t: matches(t, TERM, lambda v: share(v).isNotNull())
    at = at.select("t_row", "text", "b_base", F.map_from_entries("told").alias("told"))
    at = at.select("t_row", given(_masked(F.col("text"), F.col("b_base")), spans_in).alias("at"), "told")
    flagged = at.select("t_row", F.transform("at", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lower(t["value"]).alias("value"), share(t["value"]).alias("share"))).alias("told")).dropDuplicates(["t_row"])
    spans = found.select(F.col("row"), "base", F.col("doc_id").alias("f_doc"))
    return spans.join(flagged, F.col("row") == F.col("t_row"), "left").select("f_doc", "row", "base", F.coalesce("told", nothing).alias("terms"))


def with_text(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows of ``docs`` with their text sanitised by these spans and other columns unchanged.

    Each base span becomes its kind in brackets, a disclosing term [NUMBER], [CODE] or [TERM], or nothing.
    A text without spans stays as it is and, however many others have some, in its task, null too. Repeated rows are replaced alike; columns may have any names.
    """
    one = spans.where((F.size("base") > 0) | (F.size("terms") > 0)).select("row", "base", "terms")
    one = stash(one.dropDuplicates(["row"]), "replaced")
    rows, key, others = wrapped(docs), _row(F.coalesce("text", F.lit(""))), None
    if fits(one, 100 + 60 * (F.size("base") + F.size("terms"))):
        one = F.broadcast(one)
    else:
        rows, others = parted(rows, key, one.select("row"))
    joined = rows.join(one, key == F.col("row"), "left")
    as_text = F.transform("terms", lambda t: F.struct(_class_of(t).alias("kind"), t["start"].alias("start"), t["end"].alias("end"), t["value"].alias("value")))
    both = F.concat(F.transform("base", lambda s: F.struct(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))), as_text)
    text = F.when(F.col("row").isNull(), F.col("text")).otherwise(replaced(F.col("text"), both, lambda s: s["kind"]))
    out = unwrapped(joined, docs.columns, text=text)
    return out.union(unwrapped(others, docs.columns)) if others is not None else out


def _class_of(term: Column) -> Column:
    """What stands for a disclosing term."""
    general = F.when(term["value"].rlike(r"^[0-9]+$"), F.lit("[NUMBER]")).when(term["value"].rlike(r"[0-9]"), F.lit("[CODE]")).otherwise(F.lit("[TERM]"))
    return F.when(term["share"] >= REMOVE, F.lit("")).otherwise(general)


def digests(spans: DataFrame) -> DataFrame:
    """Counts and lists of the spans of each row."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.concat(F.col("base"), F.transform("terms", lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end"), t["value"].alias("value"))))
    return spans.select(F.col("f_doc").alias("doc_id"), *map(n, KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(every).alias("spans"))
