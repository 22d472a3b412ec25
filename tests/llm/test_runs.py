"""Periodic runs against all periods of all words."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import registry, runs


def brute(words, least=12):
    """(start, length, period) of every run, by all periods."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def found(texts):
    first = np.cumsum([0, *map(len, texts)])
    got = runs.runs_of(np.asarray([w for t in texts for w in t], np.int64), first)
    return [[tuple(x[1:]) for x in got.tolist() if x[0] == i] for i in range(len(texts))]


nested = st.recursive(st.lists(st.integers(0, 2), min_size=1, max_size=6), lambda inner: st.one_of(st.tuples(inner, st.integers(2, 5)).map(lambda x: (x[0] * x[1])[:400]), st.tuples(inner, inner).map(lambda x: (x[0] + x[1] + x[0])[:400])), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(nested, min_size=1, max_size=4))
def test_runs(texts):
    assert found(texts) == [brute(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=1, max_size=4), st.integers(9, 60), st.integers(0, 40), st.booleans())
def test_runs_whose_periods_are_periodic(word, size, more, twice):
    own = (word * 60)[: max(size, 9 * len(word))]
    text = own + own + own[: min(more, len(own) - 1)]
    text = text + [7] + text if twice else text
    assert found([text]) == [brute(text)]


def test_runs_do_not_rest_on_hashes(monkeypatch):
    """With hashes that say little, equal words still decide."""
    monkeypatch.setattr(runs, "_PRIMES", (np.int64(31), np.int64(29)))
    monkeypatch.setattr(runs, "_powers", [np.ones(1, np.int64), np.ones(1, np.int64)])
    monkeypatch.setattr(runs.Text, "names", lambda self, n, size: self.windows(np.arange(n - size + 1), size))
    rng = np.random.default_rng(3)
    for _ in range(60):
        part = rng.integers(0, 3, rng.integers(1, 30)).tolist()
        text = rng.integers(0, 3, 20).tolist() + part * 4 + rng.integers(0, 3, 20).tolist()
        assert found([text]) == [brute(text)]


def test_long_text_is_quick():
    rng = np.random.default_rng(0)
    words = np.concatenate((rng.integers(0, 1000, 300_000), np.tile(rng.integers(0, 1000, 777), 200)))
    got = runs.runs_of(words, np.asarray([0, len(words)]))
    assert (300_000, 777 * 200, 777) in [tuple(x[1:]) for x in got.tolist()]


WORDS = re.compile("[^\x20\x09-\x0d]+").findall


def plain(doc_id, text):
    """The contract, word by word."""
    w = WORDS(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    own = brute(w)
    best = min(own, key=lambda r: (-r[1], r[0], r[2])) if own else (None, None, None)
    gone = {i for s, m, q in own for i in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(own), *best, None if not own else 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in own)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b " * 40), (6, "x " * 13), (7, "q " * 11), (None, "a b c d e f " * 5), (8, "é  ü " * 20), (8, "é  ü " * 20), (10, "A a " * 20), (11, " ".join(f"w{i % 40}" for i in range(100)))]


def test_edge_rows(spark):
    rows = [(d, t, 1, 2, "x", "y") for d, t in ROWS]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs int, best int, words string, collapsed string")
    got = runs.digest(runs.detect(runs.with_planted_runs(docs)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((plain(d, t) for d, t in ROWS), key=str)
    assert runs.digest(runs.detect(runs.with_planted_runs(docs.limit(0)))).count() == 0


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect() if len(WORDS(r.text or "")) < 1500]
    want = {d: plain(d, t) for d, t in docs}
    got = {r.doc_id: tuple(r) for r in registry.op11_periodic_runs(spark, sf_dir).collect()}
    assert sum(x[1] for x in want.values()) > 5
    assert {d: got[d] for d in want} == want


@pytest.mark.parametrize("least", [4, 12])
def test_real_outputs(spark, least):
    docs = spark.createDataFrame([(1, "start a b a b a b end")], "doc_id bigint, text string")
    r = runs.detect(docs, least).first()
    assert ([tuple(x) for x in r.runs], r.collapsed) == (([(1, 6, 2)], "start a b end") if least == 4 else ([], "start a b a b a b end"))
