"""Spelling variants: a self-join of the vocabulary's trie by active-node sets, for an edit distance of one.

Partitions. Two words at distance one, the shorter of m letters, agree on their first ``m // 2`` letters or else on
their last ``m - m // 2``. So each word goes into the partition of its first half and the one of its last half, for m its own length and one less,
and no pair is looked for anywhere else. A partition that is too large for one task is dealt into
finer ones by the same rule, applied to the letters on which its words may still differ: the first half of those, or else the last, is
agreed on as well. This ends with one letter left, so no partition holds more than about the alphabet's square.
A partition takes the pairs that part before a given letter only, so each pair is found in exactly one.

Trie. The letters that may differ in a partition form a trie. Going down from its root, each node has its active nodes: those whose
strings are at most one edit from its own, with that distance. A child's active nodes follow from its parent's, so subtrees without a partner end there.
At the end of a word, the active nodes that end words at distance one are its near words. Only their number and the commonest of them leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.store import stash

# What a run of letters is, and which runs lose a letter.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOSES = 199

LETTERS = 6
OCCURRENCES = 5
#: How many times as common as a word its form is at least.
RATIO = 5
#: Words, and letters that may differ, that one partition's trie holds; larger ones are dealt on.
MOST_WORDS = 2000
MOST_LETTERS = 100_000

PARTITION = ["m", "a", "b", "upto", "lead", "trail"]
NEAR = ["word", "n_near", "best_n", "best"]


def altered(doc_id: Column, run: Column) -> Column:
    """A run without the letter that its hash names, if the hash is a multiple of LOSES; else the run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % LOSES == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """``word, n``: the distinct altered runs of all texts that are long and common enough. Counts are summed up before the shuffle."""
    runs = F.filter(F.regexp_extract_all("text", F.lit(RUN), F.lit(0)), lambda r: F.length(r) >= letters)
    each = docs.select("doc_id", F.explode(runs).alias("run"))
    lowered = each.select("doc_id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))
    words = lowered.select(altered(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= occurrences)


def _partition(m: Column, a: Column, b: Column, upto: Column) -> Column:
    """A partition of words that agree on the first ``a`` and the last ``b`` letters; of its pairs it takes those that part before letter ``upto``."""
    lead, trail = F.substring(F.col("word"), F.lit(1), a), F.substring(F.col("word"), F.length("word") - b + 1, b)
    return F.struct(m.alias("m"), a.alias("a"), b.alias("b"), upto.alias("upto"), lead.alias("lead"), trail.alias("trail"))


def _halves(m: Column, a: Column, b: Column, upto: Column) -> list[Column]:
    """The two partitions that the pairs of one are dealt into."""
    rest = m - a - b
    half = F.floor(rest / 2).cast("int")
    return [_partition(m, a + half, b, upto), _partition(m, a, b + rest - half, a + half)]


def _dealt(words: DataFrame, most_words: int, most_letters: int) -> DataFrame:
    """``word, n`` and PARTITION: each word in those of its partitions that may have a pair, all of them small enough for one task."""
    length, none = F.length("word").cast("int"), F.lit(0)
    own, less = (_halves(m, none, none, m + 1) for m in (length, length - 1))
    at = words.select("word", "n", F.explode(F.array(*own, *less)).alias("p")).select("word", "n", "p.*")
    done = None
    while True:
        sizes = at.groupBy(*PARTITION).agg(F.count(F.lit(1)).alias("words"), F.sum(F.length("word") - F.col("a") - F.col("b")).alias("letters"), F.min(F.length("word")).alias("least"))
        # Without a word of m letters the partition's pairs all belong to another m.
        sizes = sizes.where((F.col("words") > 1) & (F.col("least") == F.col("m"))).drop("least")
        at = stash(at.join(sizes, PARTITION), "partitions")
        last = F.col("m") - F.col("a") - F.col("b") <= 1
        small = last | ((F.col("words") <= most_words) & (F.col("letters") <= most_letters))
        ready = at.where(small).select("word", "n", *PARTITION)
        done = ready if done is None else done.union(ready)
        large = at.where(~small)
        if not large.take(1):
            return done
        finer = _halves(*[F.col(c) for c in ("m", "a", "b", "upto")])
        at = large.select("word", "n", F.explode(F.array(*finer)).alias("p")).select("word", "n", "p.*")


class Trie:
    """A trie of distinct strings; ``pairs`` are those of them at distance one."""

    def __init__(self, strings: list[str]):
        self.kids: list[dict[str, int]] = [{}]
        self.ends: dict[int, int] = {}
        for i, s in enumerate(strings):
            node = 0
            for letter in s:
                child = self.kids[node].get(letter)
                if child is None:
                    child = self.kids[node][letter] = len(self.kids)
                    self.kids.append({})
                node = child
            self.ends[node] = i

    def _active(self, node: int, letter: str, near: list[int]) -> list[int]:
        """The nodes one edit from the child of ``node`` by ``letter``, given those one edit from ``node`` itself.

        The one at distance zero is the child itself and is not listed.
        """
        child = self.kids[node][letter]
        found = {self.kids[u][letter] for u in near if letter in self.kids[u]}  # the edit was above, this letter agrees
        found.add(node)  # the letter is left out
        found.update(self.kids[node].values())  # another letter in its place
        found.update(self.kids[child].values())  # one more letter after it
        found.discard(child)
        return list(found)

    def pairs(self) -> Iterator[tuple[int, int]]:
        """``(i, j)`` and ``(j, i)`` of each two strings at distance one."""
        stack = [(0, list(self.kids[0].values()))]
        while stack:
            node, near = stack.pop()
            if node in self.ends:
                for u in near:
                    if u in self.ends:
                        yield self.ends[node], self.ends[u]
            for letter, child in self.kids[node].items():
                stack.append((child, self._active(node, letter, near)))


def _near(words: list[str], counts: list[int], m: int, a: int, b: int, upto: int) -> Iterator[tuple[str, int, int, str]]:
    """NEAR of the words of one partition that have a near word there."""
    rests = [w[a : len(w) - b] for w in words]
    found: dict[int, list] = {}
    for i, j in Trie(rests).pairs():
        if min(len(words[i]), len(words[j])) != m or words[i][:upto] == words[j][:upto]:
            continue  # these are another partition's
        one = found.setdefault(i, [0, 0, ""])
        one[0] += 1
        if (-counts[j], words[j]) < (-one[1], one[2]):
            one[1:] = counts[j], words[j]
    for i, (n, best_n, best) in found.items():
        yield words[i], n, best_n, best


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by partition; one partition is held at a time."""
    now, words, counts, out = None, [], [], []

    def table() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string()))] if out else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.string())]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=NEAR)

    for batch in batches:
        rows = batch.to_pydict()
        for word, n, *place in zip(rows["word"], rows["n"], *[rows[c] for c in PARTITION]):
            if place != now:
                if now:
                    out.extend(_near(words, counts, *now[:4]))
                now, words, counts = place, [], []
            words.append(word)
            counts.append(n)
        yield table()
    if now:
        out.extend(_near(words, counts, *now[:4]))
    yield table()


def near_words(words: DataFrame, most_words: int = MOST_WORDS, most_letters: int = MOST_LETTERS) -> DataFrame:
    """``word, n_near, best_n, best`` of each of ``words(word, n)`` that has a near word: how many, and the commonest (of equally common ones the least)."""
    dealt = _dealt(words, most_words, most_letters).repartition(*PARTITION).sortWithinPartitions(*PARTITION)
    found = dealt.mapInArrow(_join, "word string, n_near long, best_n long, best string")
    least = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("least")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), least).select("word", "n_near", (-F.col("least.n")).alias("best_n"), F.col("least.word").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``forms(word, form)``: from each word the last of its chain. A step doubles each round, so rounds grow with the logarithm of the longest chain."""
    at = stash(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("via"), F.col("root").alias("on"))
        at = stash(at.join(step, F.col("root") == F.col("via"), "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "roots")
        if not at.where("moved").take(1):
            return at.select("word", "root")
        at = at.drop("moved")


def variants(docs: DataFrame, most_words: int = MOST_WORDS, most_letters: int = MOST_LETTERS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word of ``docs(doc_id, text)`` that is long and common enough.

    A null text has no words, as an empty one; a null doc_id is written as the empty string where runs are hashed. Repeated rows
    count as often as they are there. Of equally common forms the least in code-point order is taken. Words of any length are
    compared whole. An empty table gives an empty result; other columns are not read.
    """
    words = stash(vocabulary(docs.select("doc_id", "text")), "vocabulary")
    near = near_words(words, most_words, most_letters).withColumnRenamed("word", "near_word")
    with_near = words.join(near, F.col("word") == F.col("near_word"), "left")
    is_form = F.col("best_n") >= RATIO * F.col("n")
    formed = stash(with_near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "forms")
    roots = _roots(formed.where("form is not null")).withColumnRenamed("word", "of")
    return formed.join(roots, F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
