"""Source divergence and periodic runs against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelasflow.llm import divergence, ntt, periodic_runs, queries_audit
from kelasflow.llm.common import table
from tests.conftest import SF001
from tests.llm.test_brute_force import lower

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
WORD = re.compile("[^\x20\x09-\x0d]+")


# ------------------------------------------------------------------ op11
def audit(rows, min_docs=10, top=10):
    """rows of (lang, source, text) -> set of (lang, source, part, item, value, rank)"""
    rows = [(a or "", b or "", TERM.findall(lower(t))) for a, b, t in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        docs = Counter(t for r in mine for t in set(r[2]))
        kept = sorted(t for t, n in docs.items() if n >= min_docs)
        v, k = len(kept), set(kept)
        count = {s: Counter() for s in {r[1] for r in mine}}
        for _, s, ts in mine:
            count[s].update(t for t in ts if t in k)
        whole = sum(count.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * v) for t in kept}
        ps, q = {s: p(c) for s, c in count.items()}, p(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in count:
            pair = sorted((-sum(f(ps[s][t], ps[o][t]) for t in kept), o.encode()) for o in count if o != s)
            term = sorted((-f(ps[s][t], q[t]), t.encode()) for t in kept if count[s][t] and ps[s][t] > q[t])[:top]
            for part, ranked in (("pair", pair), ("term", term)):
                out |= {(lang, s, part, i.decode(), -x, r) for r, (x, i) in enumerate(ranked, 1)}
    return out


def audited(df):
    rows = [(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("levels,tile", [(12, 32), (2, 2)])     # one block for all; many blocks and tiles
def test_divergence_equals_brute_force(spark, monkeypatch, levels, tile):
    monkeypatch.setattr(divergence, "LEVELS", levels)
    monkeypatch.setattr(divergence, "BLOCK", 1 << levels)
    monkeypatch.setattr(divergence, "TILE", tile)
    rnd = random.Random(7)
    words = [f"wört{chr(97 + i)}" for i in range(20)] + ["Ab", "ab", "É", "é"]
    rows = [(rnd.choice(["x", "y", None]), rnd.choice(["a", "b", "c", None, "é"]),
             " ".join(rnd.choices(words, k=rnd.randint(0, 12))) + "1-") for _ in range(240)]
    rows += [("x", "a", None), ("x", "empty", ""), ("alone", "s", "one two"), ("alone", "t", None)]
    rows += [("x", "a", "ab " * 40_000)] + [("y", "b", "ab cd")] * 3
    docs = spark.createDataFrame([(i, *r, 1, 2) for i, r in enumerate(rows)],
                                 "doc_id long, lang string, source string, text string, value int, term int")
    assert audited(divergence.source_divergence(docs)) == audit(rows)


def test_divergence_ties_and_empty_table(spark):
    docs = spark.createDataFrame([("l", s, "p q r") for s in "abc" for _ in range(10)],
                                 "lang string, source string, text string")
    got = audited(divergence.source_divergence(docs))
    assert got == {("l", s, "pair", o, 0, i) for s in "abc" for i, o in enumerate(sorted(set("abc") - {s}), 1)}
    assert divergence.source_divergence(docs.where("false")).count() == 0


def test_divergence_of_large_counts_is_exact():
    leaves = np.array([[10**10, 0, 5, 7], [3, 0, 0, 10**11]])
    totals, terms = leaves.sum(1), 3
    p = [[1 + 10**9 * (int(c) + 2) // (int(n) + 2 * terms) for c in row] for row, n in zip(leaves, totals)]
    want = sum((a - b) ** 2 // (a + b) for a, b in zip(*p))
    assert divergence.price_pairs(leaves, totals, np.array([[0, 1]]), terms).tolist() == [want]


# ------------------------------------------------------------------ op13
def stretches(x):
    n, out = len(x), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                out.setdefault((i, j + q), q)           # the smallest period comes first
            i = j
    return sorted((s, e - s, q) for (s, e), q in out.items())


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def described(words):
    runs = stretches(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            digest("".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))),
            digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def repeated(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str("" if doc_id is None else doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    return words


@pytest.mark.parametrize("size", [1, 2, 8, 64])
def test_occurrences_equal_comparison(size):
    r = np.random.default_rng(size)
    block, window = r.integers(0, 2, (30, size)), r.integers(0, 2, (30, 2 * size))
    window[::3, size // 2:size // 2 + size] = block[::3]
    got = set(zip(*(a.tolist() for a in ntt.occurrences(block, window))))
    assert got == {(i, t) for i in range(30) for t in range(size) if (window[i, t:t + size] == block[i]).all()}
    big = block * ((1 << 31) - 1)                       # needs more than one prime
    got = set(zip(*(a.tolist() for a in ntt.occurrences(big, window * ((1 << 31) - 1)))))
    assert got == {(i, t) for i in range(30) for t in range(size) if (window[i, t:t + size] == block[i]).all()}


def test_stretches_equal_brute_force():
    rnd = random.Random(3)
    for _ in range(200):
        k, x = rnd.choice([2, 3, 5, 50]), []
        for _ in range(rnd.randint(1, 6)):
            if rnd.random() < 0.5:
                u = [rnd.randrange(k) for _ in range(rnd.randint(1, 30))]
                x += (u * 7)[:rnd.randint(1, len(u) * 6)]
            else:
                x += [rnd.randrange(k * 4) for _ in range(rnd.randint(1, 60))]
        got = [(s, e - s, q) for s, e, q in periodic_runs.periodic_stretches(np.array(x), len(x))]
        assert sorted(got) == stretches(x)


def test_runs_of_documents_equal_brute_force(spark):
    rnd = random.Random(5)
    texts = [None, "", " \n ", "a", "a " * 23, "a " * 24, "A a " * 30, "é b c\t" * 9, "x y " * 40 + "z " + "x y " * 40]
    texts += [" ".join(rnd.choices("abcdefgh", k=rnd.randint(1, 300))) for _ in range(60)]
    texts += [" ".join(f"w{rnd.randrange(40)}" for _ in range(17)) + " " + " ".join(
        ["one", "two", "three", "four", "five", "six", "seven"] * 9)] * 2
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)],
                                 "doc_id long, text string, runs int, collapsed string")
    got = {r.doc_id: r for r in periodic_runs.find_runs(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        words, r = WORD.findall(t or ""), got[i]
        runs = [(x.start, x.length, x.period) for x in r.runs]
        assert (r.n_words, runs) == (len(words), stretches(words))
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert r.collapsed == " ".join(w for k, w in enumerate(words) if k not in gone)
    assert periodic_runs.find_runs(docs.where("false")).count() == 0


def test_run_query_equals_brute_force(spark):
    rows = [r for r in table(spark, SF001, "documents").select("doc_id", "text").collect() if len(r.text) < 6000]
    got = {tuple(r)[0]: tuple(r)[1:] for r in queries_audit.op13_periodic_runs(spark, SF001).collect()}
    assert rows and all(got[r.doc_id] == described(repeated(r.doc_id, r.text)) for r in rows)


def test_repetitions_of_null_ids_and_texts(spark):
    rows = [(i, t) for i in [*range(40), None] for t in (None, "", "a b c d e f g h i j k l m n o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, tuple(WORD.findall(r.text))) for r in queries_audit.with_repetitions(docs).collect())
    assert got == Counter((i, tuple(repeated(i, t))) for i, t in rows)


def test_long_texts_of_few_words_are_linear(spark):
    """A megabyte of each kind that meets many scales or many runs."""
    fib = ["a", "a b"]
    while len(fib[-1]) < 200_000:
        fib = [fib[1], fib[1] + " " + fib[0]]
    texts = ["a " * 500_000, "a b " * 250_000, fib[-1], "word " * 200_000 + "end", "x" * 1_000_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in periodic_runs.find_runs(docs).select("doc_id", "n_words", F.size("runs").alias("n"), "strongest").collect()}
    assert (got[0].n, got[0].strongest.length, got[1].strongest.period, got[3].n, got[4].n) == (1, 500_000, 2, 1, 0)
    assert got[2].n > 1000
