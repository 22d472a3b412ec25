"""Words that are alike to sums of powers, against what decides on words: near-duplicates, removed windows, matches of items."""

import numpy as np
import pyarrow as pa

from tessera.llm import language, neardup, phrases
from tessera.llm.words import words_of


def twins(n=10):
    """Two words of 2^n letters whose polynomials modulo 2^64 are equal for every odd base."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(1 << n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_of_two_letters_have_own_hashes():
    one, other = twins()
    found = words_of([one, other, f"{one} x {other}", None, "", "A a", "É é"], lower=True)
    assert len(set(found.hashes.tolist())) == 6 and found.hashes[0] == found.hashes[2] and found.hashes[5] == found.hashes[6]
    assert found.first.tolist() == [0, 1, 2, 5, 5, 5, 7, 9]


def test_hashes_depend_on_all_bytes_and_on_nothing_else():
    rng = np.random.default_rng(1)
    own = {"".join(rng.choice(list("abc"), int(n))) for n in rng.integers(1, 40, 3000)}
    texts = [f"{x}\t{y} {x}\n" for x, y in zip(sorted(own), sorted(own, reverse=True), strict=True)]
    found = words_of(texts)
    by_word = {}
    for i in range(len(texts)):
        for word, value in zip(found.strings(i), found.hashes[found.first[i] : found.first[i + 1]].tolist(), strict=True):
            assert by_word.setdefault(word, value) == value
    assert len(set(by_word.values())) == len(by_word) == len(own)


def test_windows_and_sets_with_twin_words(spark):
    one, other = twins()
    start = " ".join(f"w{i}" for i in range(34))
    docs = spark.createDataFrame([(1, f"{start} {one}"), (2, f"{start} {other}"), (3, f"x y {one}"), (4, f"x y {other}"), (5, f"x y {other}")], "doc_id bigint, text string")
    assert {r.doc_id: r.n_removed for r in phrases.digest(docs).collect()} == dict.fromkeys(range(1, 6), 0)
    assert {r.doc_id: r.component_id for r in neardup.classes(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_a_shard_of_many_phrases_needs_few_automata(monkeypatch):
    """Phrases come to a full shard as many at a time as it holds segments."""
    calls = []
    plain = phrases.locate
    monkeypatch.setattr(phrases, "locate", lambda *a: calls.append(len(a[1])) or plain(*a))
    text = [" ".join(f"v{i}x{k}" for k in range(35)) for i in range(2_000)]
    for segments in (900, 1_024, 1_100):
        calls.clear()
        rows = [(7, 0, True, i, text[i], None) for i in range(segments)] + [(7, 0, False, 10_000 + i, text[i], 1) for i in range(2_000)]
        names = ["anchor", "salt", "searched", "segment", "text", "mask"]
        batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[k : k + 300]], schema=pa.schema([("anchor", pa.int64()), ("salt", pa.int64()), ("searched", pa.bool_()), ("segment", pa.int64()), ("text", pa.string()), ("mask", pa.int64())])) for k in range(0, len(rows), 300)]
        found = {s for out in phrases._located(35)(iter(batches)) for s in out.column("segment").to_pylist()}
        assert found == set(range(segments))
        assert len(calls) <= 4 and sum(calls) == 2_000


def test_grams_of_a_long_run_of_letters(spark):
    """Every n-gram by code points, and a run of a million letters in one pass."""
    own = spark.createDataFrame([(" a ",), (" añ𝒳b ",), (" " + "xy" * 500_000 + " ",)], "padded string")
    for k in range(1, language.LONGEST + 1):
        got = [r.g for r in own.select(language._grams(k).alias("g")).limit(2).collect()]
        assert got == [[p[i : i + k] for i in range(max(len(p) - k + 1, 1))] for p in (" a ", " añ𝒳b ")]
        assert {r.n for r in own.selectExpr("padded").select(language._grams(k).alias("g")).selectExpr("size(g) as n").collect()} == {max(4 - k, 1), 7 - k, 1_000_003 - k}
