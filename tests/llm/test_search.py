"""Ranked search against all scores of all documents."""

import math
import re
from collections import Counter

import pytest

from tessera.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, top):
    own = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(x for _, c in own for x in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, want in asked.items():
        scored = []
        for d, c in own:
            m = 50 + 50 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1_000_000_000 * c[x] // (1000 * c[x] + 20 * m)) for x in want if c[x])
            if s > 0:
                scored.append((-s, d is not None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


DOCS = [(i, " ".join(f"w{(i * k) % 23}" for k in range(1, 3 + i % 17))) for i in range(300)]
EDGES = [(1000, None), (1001, ""), (1002, "... !!"), (1003, "É w1 W1 w1_w2 w3-w4"), (1004, "w5 " * 30_000), (1005, "w7"), (1005, "w7"), (None, "w7 w8"), (1006, "é w9")]
ITEMS = [(1, "w1 w2 w3"), (2, "W5"), (3, None), (4, "??"), (5, "w7 w8 w7 É"), (6, "unseen"), (None, "w9"), (7, "w1"), (7, "w2 w4"), (8, " ".join(f"w{i}" for i in range(23)) + " " + " ".join(f"u{i}" for i in range(120)) + " é")]


@pytest.mark.parametrize(("segment", "top"), [(8192, 50), (40, 5), (7, 50)])
def test_search(spark, monkeypatch, segment, top):
    monkeypatch.setattr(search, "SEGMENT", segment)
    monkeypatch.setattr(search, "AHEAD", 3)
    docs = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in DOCS + EDGES], "doc_id bigint, text string, n int, terms int, rank int").repartition(3)
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id bigint, text string, doc_id string")
    got = search.search(docs, items, top)
    assert sorted(map(tuple, got.collect()), key=str) == plain(DOCS + EDGES, ITEMS, top)
    assert search.search(docs.limit(0), items, top).count() == 0 == search.search(docs, items.limit(0), top).count()


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_CHARS", 60)
    docs, items = spark.createDataFrame(DOCS, "doc_id bigint, text string"), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert sorted(map(tuple, search.search(docs, items).collect()), key=str) == plain(DOCS, ITEMS, 50)


def test_many_terms_need_several_words_of_masks(spark):
    docs = [(i, " ".join(f"t{j}" for j in range(150) if (i >> (j % 8)) & 1 or j == i)) for i in range(200)]
    items = [(1, " ".join(f"t{j}" for j in range(150)))]
    got = search.search(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items, 50)
