"""Nearest neighbours, spelling variants and whitening against brute-force versions."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import neighbours, spelling, vectors, whitening
from quillstone.llm import queries as Q

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>"
OTHER = ["n", "rank", "score", "table", "bucket", "part", "word", "query_id", "floor", "a.b", "component"]


def clashing(df, but=()):
    return df.select("*", *[F.lit("clash").alias(c) for c in OTHER if c not in but])


def made(n, width, seed, spread=0.0):
    """Random float vectors; with a spread, of different lengths."""
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, width))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return (x * np.exp(spread * r.standard_normal((n, 1)))).astype(np.float32)


def frame(spark, x, ids=None, more=()):
    ids = range(len(x)) if ids is None else ids
    return clashing(spark.createDataFrame([(i, row) for i, row in zip(ids, x.tolist())] + list(more), VECTORS)).repartition(3)


def odd_rows(width):
    """Rows that take no part."""
    return [(9000, None), (9020, [0.0] * width if width else []), (9040, [None] + [1.0] * (width - 1)), (9060, [float("nan")] * width), (9080, [float("inf")] * width), (9100, [1.0] * (width + 1)), (9120, [])]


def all_pairs(x, ids, k):
    """Each query's k nearest by comparing all: ``{query: [(vec_id, score)]}``."""
    x = x.astype(np.float64)
    out = {}
    for i in np.flatnonzero(np.asarray(ids) % 20 == 0):
        score = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[ids[i]] = [(ids[j], float(score[j])) for j in order]
    return out


def answers(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def recall_of(got, want):
    assert got.keys() == want.keys()
    scores = {q: dict(v) for q, v in got.items()}
    for q, v in got.items():
        assert [(-s, i) for i, s in v] == sorted((-s, i) for i, s in v)
        assert len(v) == len(want[q])
    for q, v in want.items():
        assert all(abs(scores[q][i] - s) <= 1e-12 * max(1, abs(s)) for i, s in v if i in scores[q])
    return np.mean([1.0] * (not want) + [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / max(1, len(want[q])) for q in want])


@pytest.mark.parametrize("width, spread", [(16, 0.0), (20, 0.7)])
def test_neighbours_recall(spark, monkeypatch, width, spread):
    monkeypatch.setattr(neighbours, "BUCKET_ROWS", 4)  # several rotations a table
    monkeypatch.setattr(neighbours, "PART_ROWS", 16)
    monkeypatch.setattr(neighbours, "FLOOR_ROWS", 200)
    x = made(2500, width, 3, spread)
    got = answers(neighbours.nearest(frame(spark, x, more=odd_rows(width)), F.col("vec_id") % 20 == 0))
    assert recall_of(got, all_pairs(x, np.arange(len(x)), 20)) >= 0.9


def test_neighbours_of_one_hot_vector(spark):
    x = made(900, 8, 4)
    x[::3] = x[0]  # a third of the rows are equal: ties go by vec_id
    got = answers(neighbours.nearest(frame(spark, x), F.col("vec_id") % 20 == 0))
    want = all_pairs(x, np.arange(len(x)), 20)
    assert recall_of(got, want) >= 0.9
    assert all(got[q] == want[q] for q in want if q % 3 == 0)


@pytest.mark.parametrize("n", [1, 2, 15, 21])
def test_neighbours_of_few_rows(spark, n):
    x = made(n, 5, n)
    got = answers(neighbours.nearest(frame(spark, x, more=odd_rows(5)), F.col("vec_id") % 20 == 0))
    want = {q: v for q, v in all_pairs(x, np.arange(n), 20).items() if v}
    assert recall_of(got, want) == 1.0


def test_neighbours_repeated_rows_and_no_rows(spark):
    x = made(30, 4, 9)
    rows = frame(spark, np.concatenate([x, x[:5], -x[5:6]]), [*range(30), *range(5), 5], more=[(None, [1.0] * 4)])
    got = answers(neighbours.nearest(rows, F.col("vec_id") % 20 == 0))
    assert set(got) == {0, 20} and all(len({i for i, _ in v}) == 20 and q not in dict(v) for q, v in got.items())
    none = spark.createDataFrame([], VECTORS)
    assert neighbours.nearest(none, F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], VECTORS), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    want = all_pairs(np.array([r["embedding"] for r in rows], dtype=np.float32), np.array([r["vec_id"] for r in rows]), 20)
    assert recall_of(answers(Q.op11_nearest_neighbours(spark, SF)), want) >= 0.9


def test_pseudo_rotations_keep_lengths_and_codes_follow_probes():
    x = made(50, 24, 1).astype(np.float64)
    assert np.allclose(np.linalg.norm(neighbours.hadamard(np.pad(x, ((0, 0), (0, 8)))), axis=1), 1)
    tables = neighbours.Tables(24, 1.0, False, (32, 4))
    first = tables.probes(x, tables.buckets)
    assert (first[:, :, 0] == tables.codes(x)).all()  # a unit vector's own bucket is its first probe
    assert all(sorted(first[0, t].tolist()) == list(range(tables.buckets)) for t in range(tables.tables))
    assert (tables.probes(x, 7) == first[:, :, :7]).all()
    assert neighbours._axes(10**9, 64)[0] == 64 and 100 < 10**9 / np.prod([2.0 * a for a in neighbours._axes(10**9, 64)]) < 2000


def spelled(rows, letters=6, occurrences=5, ratio=5):
    """The contract of spelling variants, by comparing deletions."""
    up = str.maketrans(spelling.UPPER, spelling.LOWER)
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(up)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= letters and k >= occurrences}
    near, cut = defaultdict(set), defaultdict(list)
    for w in n:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            cut[i, rest].append(w)
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
    for same in cut.values():
        for w in same:
            near[w].update(v for v in same if v != w)
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: v for w, v in best.items() if n[v] >= ratio * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def variant_rows(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("words, letters", [(2000, 100_000), (2, 100_000), (50, 12)])
def test_spelling_variants(spark, words, letters):
    r = random.Random(5)
    stems = ["".join(r.choice("aé") for _ in range(r.randint(6, 7))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaab", "ÀÉÿaaa", "àÉÿaaa"]
    texts = [" ".join(w for s in stems for w in [s] * int(r.paretovariate(0.4) % 60)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "aaaaaa " * 9), (3, texts[3]), (7, None), (8, ""), (9, "x" * 30_000 + " " + "y1 Ābcdefg")]
    rows += [(40 + i, "q" * 3000 + ("", "r", "s")[i % 3]) for i in range(18)]  # long near words
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"), ["n", "word"]).repartition(3)
    got, want = variant_rows(spelling.variants(df, words, letters)), spelled(rows)
    assert got == want
    assert any(f for f, *_ in want.values()) and max(k for *_, k, _ in want.values()) > 3


def test_spelling_chains(spark):
    words = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb"]
    rows = [(i, (w + " ") * 6**i) for i, w in enumerate(words)]
    got = variant_rows(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == spelled(rows) and got["aaaaab"][:2] == ("aaaabb", "aabbbb")
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trie_pairs():
    r = random.Random(2)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(0, 6))) for _ in range(80)})

    def one_apart(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if one_apart(a, b)}
    got = list(spelling.Trie(words).pairs())
    assert set(got) == want and len(got) == len(want)


def whitened(x, k):
    """Means, covariance and components by plain linear algebra."""
    n = len(x)
    total = x.sum(axis=0)
    off = (n * x - total) / n
    values, turn = np.linalg.eigh(off.T @ off / n)
    values, turn = values[::-1], turn[:, ::-1]
    return ((n * x - total) ** 2).sum(axis=1), off @ turn[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


@pytest.mark.parametrize("decay", [1.0, 0.5])  # a flat spectrum needs the full dimension, a steep one does not
def test_whitening(spark, decay):
    r = np.random.default_rng(8)
    c = (r.standard_normal((600, 40)) * decay ** np.arange(40) + 0.3).astype(np.float32)
    c = np.concatenate([c, c[:100]])  # repeated rows count
    got = whitening.whiten(frame(spark, c, more=[o for o in odd_rows(40) if o[0] != 9020])).collect()
    x = np.floor(1024 * c.astype(np.float64)).astype(np.int64) + 100_000
    deviation, white, explained = whitened(x, 8)
    assert len(got) == 8 * len(c)
    by = {(r["vec_id"], r["component"]): r for r in got}
    sign = [np.sign(sum(by[i, j + 1]["whitened"] * white[i, j] for i in range(len(c)))) for j in range(8)]
    for (i, j), row in by.items():
        assert (row["n"], row["deviation"]) == (len(c), deviation[i])
        assert abs(row["whitened"] * sign[j - 1] - white[i, j - 1]) < 1e-9
        assert abs(row["explained"] / explained[j - 1] - 1) < 1e-9
    assert {r["identity_error"] < 1e-9 for r in got} == {True} and len({r["identity_error"] for r in got}) == 1


def test_whitening_stops_early_or_widens(spark):
    for decay, few in ((0.2, True), (1.0, False)):
        c = (np.random.default_rng(8).standard_normal((400, 60)) * decay ** np.arange(60) * 100).astype(np.float32)
        rows = spark.createDataFrame([(c_.tolist(),) for c_ in c], "embedding array<float>")
        x = np.floor(1024 * c.astype(np.float64)).astype(np.int64) + 100_000
        centre = whitening.Centre(whitening._totals(rows, 60), 400)
        basis, values, trace, passes = whitening.principal(rows, 60, centre, 3)
        off = x - x.mean(axis=0)
        exact, turn = np.linalg.eigh(off.T @ off / 400)
        assert np.allclose(values, exact[::-1][:3], rtol=1e-12) and np.allclose(np.abs(np.diag(basis.T @ turn[:, ::-1][:, :3])), 1, atol=1e-12)
        assert np.isclose(trace, exact.sum()) and (passes < whitening.PASSES) == few or not few


def test_whitening_without_variance_and_huge_entries(spark):
    one = {r["component"]: r for r in whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], VECTORS)).collect()}
    assert set(one) == {1, 2} and all((r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (2, 0, None, None, None) for r in one.values())
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 0.0, float(i)]) for i in range(5)], VECTORS)).collect()
    assert len(line) == 15 and all((r["whitened"] is None) == (r["component"] > 1) and r["identity_error"] < 1e-9 for r in line)
    huge = whitening.whiten(spark.createDataFrame([(0, [3e38, 1.0]), (1, [-3e38, 1.0]), (2, [0.0, 2.0])], VECTORS)).collect()
    assert len(huge) == 6 and {r["deviation"] for r in huge if r["vec_id"] < 2} == {None}
    exact = whitening.Centre([0, 0], 3).deviation(np.array([[2**30, 1], [2**31 // 3, 0]]))
    assert exact == [9 * 2**60 + 9 if 9 * 2**60 + 9 < 2**63 else None, (3 * (2**31 // 3)) ** 2]
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, None)], VECTORS)).count() == 0


def test_dimension_is_the_commonest(spark):
    rows = spark.createDataFrame([([1.0],), ([1.0, 2.0],), ([2.0, 3.0],), ([1.0, 2.0, 3.0],)], "embedding array<double>")
    assert vectors.dimension(rows, "embedding") == (2, 2)
