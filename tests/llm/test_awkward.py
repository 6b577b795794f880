"""Clashing names, every code point, crowded texts, repeated rows and concurrent runs."""

from __future__ import annotations

import math
import os
import random
import re
import threading
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillstone.llm import bpe, decontam, neardup, pii, quality, substring
from quillstone.llm import queries as Q
from quillstone.llm.columns import named
from quillstone.llm.store import scratch, stash

SF = "/root/testdata/sf0.001"
#: Names that the operators use themselves, and awkward ones.
INTERNAL = "own row h_row gone base terms key __key __row __base __terms __gone __text __lang __source __all __c0 c0 c1 c3 hits items found bands told t_row b_row f_doc copies hash other bytes".split()
AWKWARD = ["a.b", "a`b", "two words", "é", "select", "doc_id.x", "text.y"]


@pytest.fixture(scope="module")
def named_docs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = [F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in INTERNAL + AWKWARD]
    return docs.select("*", *more)


def unchanged(out, docs):
    """Whether the further columns of ``out`` are as they were."""
    assert out.columns == docs.columns
    rows = out.select("doc_id", *[named(c).alias(f"x{i}") for i, c in enumerate(INTERNAL + AWKWARD)]).collect()
    assert rows
    for r in rows:
        assert [r[f"x{i}"] for i in range(len(INTERNAL + AWKWARD))] == [f"{c}-{r['doc_id']}" for c in INTERNAL + AWKWARD]


@pytest.mark.parametrize("name", ["keep_good", "keep_first", "clean", "with_text"])
def test_stages_leave_columns_of_any_name(spark, named_docs, name):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    stage = {"keep_good": quality.keep_good, "keep_first": neardup.keep_first, "clean": lambda d: decontam.clean(d, bench), "with_text": lambda d: pii.with_text(d, pii.sanitise(d))}[name]
    unchanged(stage(named_docs), named_docs)


def test_pipeline_with_columns_of_any_name(spark, named_docs, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    named_docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    os.symlink(f"{SF}/benchmark.parquet", tmp_path / "benchmark.parquet")
    key = lambda rows: sorted(map(tuple, rows))
    columns = ["doc_id", "start", "length", "doc_tokens"]
    assert key(pipeline.run(spark, str(tmp_path)).select(columns).collect()) == key(pipeline.run(spark, SF).select(columns).collect())


# --- token counts ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(Q.tokenizer_path())


def differing(library, texts):
    count = bpe.counter(Q.tokenizer_path()).count
    ids = library.encode_batch(texts, add_special_tokens=False)
    return [t for t, e in zip(texts, ids) if len(e.ids) != count(t.encode())]


def test_token_counts_of_every_code_point(library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert differing(library, points) == []


def test_token_counts_of_random_texts(library):
    r = random.Random(13)
    point = lambda: r.choice([r.randrange(0x20, 0x250), r.randrange(0x20, 0xD800), r.randrange(0xE000, 0x20000), 0x301, 0x27, 0x20])
    texts = ["".join(chr(point()) for _ in range(r.randrange(1, 12))) for _ in range(20_000)]
    texts += ["ЫՌ", "━\U000125d3", "\U00018ef8뢀", "<|endoftext|>x<|startoftext|>"]
    assert differing(library, texts) == []


def test_token_counts_forget_within_a_text(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_CHUNKS", 50)
    counter = bpe.HeapCounter(Q.tokenizer_path())
    text = " ".join(f"w{i}" for i in range(500))
    assert counter.count(text.encode()) == len(library.encode(text, add_special_tokens=False).ids)
    assert len(counter.known) <= 50


# --- personal data -----------------------------------------------------------------------------------------------


def shares(rows):
    """The most that each term tells, by counting over all pairs."""
    held, n_term, n_entity, contexts, pairs = [], defaultdict(int), defaultdict(int), defaultdict(set), defaultdict(set)
    for text in rows:
        mails = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text)]
        for t in {t.lower() for t in re.findall(r"[^\W_]+", text)}:
            n_term[t] += 1
        masked = text
        for a, b, _ in mails:
            masked = masked[:a] + " " * (b - a) + masked[b:]
        seen = {}
        for a, b, e in mails:
            seen.setdefault(e, set()).add((text[max(a - 60, 0) : a], text[b : b + 60]))
        held.append((seen, {t.lower() for t in re.findall(r"[^\W_]+", masked)} if mails else set()))
        for e in seen:
            n_entity[e] += 1
    n, out = len(rows), {}
    k = defaultdict(int)
    for seen, terms in held:
        for e, c in seen.items():
            assert len(c) == 1
            for t in terms:
                k[e, t] += 1
                pairs[e, t] |= c
    for (e, t), count in k.items():
        own, told = math.log2(n / n_entity[e]), math.log2(count * n / (n_entity[e] * n_term[t]))
        if len(pairs[e, t]) > 1 and own > 0 and told > 0:
            bits = (len(pairs[e, t]) - 1) * told
            share = told / own * bits / (bits + pii.DOUBT)
            if share >= pii.GENERALISE:
                out[t] = max(share, out.get(t, 0))
    return out


def test_disclosing_terms_by_counting_all_pairs(spark):
    r = random.Random(6)
    people = [(f"p{i}@mail.org", [f"code{i}x{j}" for j in range(3)]) for i in range(12)]
    rows = [" ".join(f"word{r.randrange(60)}" for _ in range(25)) for _ in range(150)]
    for mail, codes in people:
        for _ in range(r.randrange(1, 6)):
            words = [f"word{r.randrange(60)}" for _ in range(20)] + r.sample(codes, r.randrange(1, 4)) + ["team"] * r.randrange(2)
            r.shuffle(words)
            rows.append(" ".join([*words[:9], mail, *words[9:]]))
    rows += [f"footer@site.org {t}" for t in rows[::3]]
    rows += rows[160:164]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    own = docs.select("doc_id", "text")
    got = {x.term: x.share for x in pii._disclosing(own, stash(pii._found(own), "found")).collect()}
    want = shares(rows)
    assert want and got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in want)


@pytest.mark.parametrize("pages", [1, 2])
def test_directory_pages_make_no_pairs(spark, pages):
    """2,000 addresses and 8,000 rare words in one text, or in two that differ around each address."""
    page = lambda p: " ".join(f"name{i} a{i}@mail.org x{i % 7 + p} rare{i} other{i} third{i} " for i in range(2_000))
    docs = spark.createDataFrame([(p, page(p)) for p in range(pages)] + [(9, "plain words")], "doc_id long, text string")
    began = time.perf_counter()
    assert {x.f_doc for x in pii.sanitise(docs).select("f_doc").collect()} == {*range(pages), 9}
    assert time.perf_counter() - began < 60


# --- repeated rows, spans and concurrent runs ----------------------------------------------------------------------


def test_repeated_rows_are_judged_once(spark):
    words = [f"w{i}" for i in range(40)]
    text, other = " ".join(words), " ".join(words[10:30] + ["more"])
    rows = [(5, text)] * 300 + [(2, other), (5, other), (None, text), (None, text), (None, None), (7, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = substring.remove_repeats(docs)
    assert "copies" not in out.columns
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.collect()), key=str)
    cut = " ".join(words[:10] + words[30:])
    want = [(5, 40, 20, cut)] * 300 + [(2, 21, 0, other), (5, 21, 21, ""), (None, 40, 40, ""), (None, 40, 40, ""), (None, 0, 0, ""), (7, 0, 0, ""), (7, 0, 0, "")]
    assert got == sorted(want, key=str)


def test_touching_repeats_are_one_range(spark):
    a, b = [f"a{i}" for i in range(15)], [f"b{i}" for i in range(20)]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(["x", *a, *b, "y"])), (4, " ".join([*a, "gap", *b[:12]]))]
    got = {r.doc_id: [tuple(x) for x in r.repeats] for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [], 3: [(1, 36)], 4: [(0, 15)]}


def test_ranges_are_merged(spark):
    r = random.Random(1)
    rows = []
    for i in range(60):
        hits = sorted({(s, s + r.randrange(1, 9)) for s in (r.randrange(60) for _ in range(r.randrange(1, 30)))})
        rows.append((i, hits))
    df = spark.createDataFrame(rows, "i int, hit array<struct<start:int,end:int>>").select("i", decontam._merged(F.col("hit")).alias("m"))
    for x in df.collect():
        want = []
        for s, e in rows[x.i][1]:
            if want and s <= want[-1][1]:
                want[-1][1] = max(want[-1][1], e)
            else:
                want.append([s, e])
        assert [list(h) for h in x.m] == want


def test_scratch_of_each_thread_is_its_own(spark):
    inside, leave, seen = threading.Event(), threading.Event(), {}

    def other():
        with scratch(spark):
            seen["other"] = stash(spark.range(3).toDF("x"), "x").inputFiles()[0]
            inside.set()
            leave.wait(60)

    thread = threading.Thread(target=other)
    thread.start()
    inside.wait(60)
    with scratch(spark):
        mine = stash(spark.range(5).toDF("x"), "x")
        assert os.path.dirname(os.path.dirname(mine.inputFiles()[0])) != os.path.dirname(os.path.dirname(seen["other"]))
        leave.set()
        thread.join()
        assert mine.count() == 5
