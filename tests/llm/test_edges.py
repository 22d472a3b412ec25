"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, against plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import decontaminate, html, language, lines, neardup, packing, phrases, privacy, quality

WORDS = re.compile("[^\x20\x09-\x0d]+").findall
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(60_000))
BASE = " ".join(f"base{i}" for i in range(120))
NEAR = BASE.replace("base60 ", "other ")
PASSAGE = " ".join(f"pass{i}" for i in range(60))
ROWS = [
    (1, BASE), (2, BASE), (3, NEAR), (3, NEAR), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "one"), (9, LONG), (None, BASE), (None, None), (10, "a\x1fb\xa0c d"), (11, "x " * 40 + PASSAGE), (12, PASSAGE + " y z"),
    (13, "head\nfirst line here\nsecond line\n\ntail"), (14, "first line here\n \nsecond line\nother"), (15, "first line here\nfirst line here\nfirst line here\nfirst line here"), (16, "UPPER lower\nsecond line\nend"), (17, "upper LOWER\nSECOND line\nend"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """The rows with extra columns whose names operators use themselves."""
    rows = [(d, t, None if i % 3 else "en", "s", i, "k", i, -1, "L") for i, (d, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, d string, t int, key string, rank int, n_lines int, _text string").repartition(3)


def words(text):
    return WORDS(text or "")


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (9, 1), (11, 0), (None, 1), (7, None)], "doc_id bigint, quality int")
    trees = quality.train(docs, labels)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.score(docs, trees).collect())

    def plain(text):
        w = words(text)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = [any(windows[tuple(w[j : j + 3])] > 1 for j in range(max(0, i - 2), i + 1) if j + 3 <= len(w)) for i in range(len(w))]
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, sum(hit), len(w) < 50 or 100 * sum(hit) > 50 * len(w)

    assert got == Counter((d, *plain(t)) for d, t in ROWS)
    kept = quality.score(docs, None, keep_columns=True)
    assert kept.columns == docs.columns and kept.count() == sum(not plain(t)[-1] for _, t in ROWS)
    assert quality.score(docs.limit(0), trees).count() == 0 and quality.train(docs.limit(0), labels) is None
    assert quality.train(docs, labels.limit(0)) is None


def test_trees_are_monotonic_and_learn():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality.FEATURES)))
    y = ((x[:, 2] < 0.5) & (x[:, 0] > 0.2)).astype(float)
    trees = quality.fit(x, y, list(quality.FEATURES.values()))
    assert ((trees.score(x) > 0.5) == y).mean() > 0.97
    for j, sign in enumerate(quality.FEATURES.values()):
        if sign:
            grid = np.repeat(x[:50], 20, 0)
            grid[:, j] = np.tile(np.linspace(0, 1, 20), 50)
            assert (np.diff(trees.score(grid).reshape(50, 20)) <= 1e-12).all()


def test_packing(spark, docs):
    rows = packing.pack(docs).toPandas()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    want = Counter()
    for d, text in ROWS:
        ids = np.asarray([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        start, k, length = 0, 0, len(ids) % 1024 or 1024
        while start < len(ids):
            want[d, k, start, length, zlib.crc32(ids[start : start + length].tobytes())] += 1
            start, k, length = start + length, k + 1, 1024
    got = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows.itertuples())
    assert got == want
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert list(own.offset) == [0, *own.length.cumsum()[:-1]] and own.length.sum() <= 1024
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["hello <|endoftext|> world", "<|endoftext|><|endoftext|>a", "<|endoftext|", " x \n<|endoftext|>\n y", "a<|ENDOFTEXT|>", "word " * 3000 + "<|endoftext|>"])
def test_packing_encodes_added_tokens_as_the_tokenizer_does(text):
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.encoder(path).encode([text])[0], "<u4").tolist() == want


def test_packing_plan():
    rng = np.random.default_rng(2)
    for capacity in (7, 64, 1024):
        for _ in range(20):
            histogram = {int(n): int(rng.integers(1, 50)) for n in rng.integers(1, capacity + 1, 40)}
            runs, total = packing.plan(histogram, capacity)
            fill, seen, large = np.zeros(total, int), Counter(), Counter()
            spans = []
            for length, first, count, sequence, offset in runs:
                assert first == seen[length]
                seen[length] += count
                fill[sequence : sequence + count] += length
                spans += [(s, offset, length) for s in range(sequence, sequence + count)]
                if 3 * length > capacity:
                    large.update(range(sequence, sequence + count))
            assert seen == Counter(histogram) and fill.max() <= capacity and fill.min() > 0 and max(large.values(), default=0) <= 2
            end = Counter()
            for s, offset, length in sorted(spans):
                assert end[s] == offset
                end[s] += length


def plain_lines(rows, k):
    """Later copies by all runs of lines with k words or more, in document order."""
    unique = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    first, gone = {}, {r: set() for r in unique}
    own = {r: [x for x in (r[1] or "").split("\n") if words(x)] for r in unique}
    for r in unique:
        count = [len(words(x)) for x in own[r]]
        for i in range(len(own[r])):
            for n in range(1, min(len(own[r]) - i, k + 2) + 1):
                if sum(count[i : i + n]) >= k and first.setdefault(tuple(own[r][i : i + n]), (r, i)) != (r, i):
                    gone[r].update(range(i, i + n))
    return own, gone


def lines_left(r, gone):
    left, n = [], -1
    for x in (r[1] or "").split("\n"):
        n += bool(words(x))
        if not (words(x) and n in gone[r]):
            left.append(x)
    return "\n".join(left)


@pytest.mark.parametrize("k", [1, 5, 9])
def test_lines(spark, docs, k):
    own, gone = plain_lines(ROWS, k)
    want = Counter((r[0], None if r[1] is None else lines_left(r, gone), len(own[r]), len(gone[r])) for r in ROWS)
    found = lines.dedup(docs, k)
    assert found.columns == [*docs.columns, "_n_lines", "n_removed"]  # docs has its own n_lines
    assert Counter((r.doc_id, r.text, r._n_lines, r.n_removed) for r in found.collect()) == want
    assert {r.n_lines for r in found.collect()} == {-1}
    assert lines.dedup(docs.limit(0), k).count() == 0
    assert lines.dedup(docs.select("doc_id", "text"), k).columns == ["doc_id", "text", "n_lines", "n_removed"]


@pytest.mark.parametrize("k", [5, 12])
def test_lines_of_one_word_make_long_runs(spark, k):
    """Runs that only count over many lines, so every round of doubling is needed; a common line between unlike ones stays."""
    rng = np.random.default_rng(5)
    run = [f"r{i}" for i in range(k)]
    rows = [(1, "\n".join(["a", *run, "b"])), (2, "\n".join(["c", *run, "d", *run[:-1], "e"])), (3, "\n".join(run[1:])), (4, "\n".join(["f", *run[: k // 2], "\t", *run[k // 2 :], *run]))]
    rows += [(10 + i, "\n".join("x" + str(x) + " y" * (x % 3) for x in rng.integers(0, 4, 30))) for i in range(12)]
    own, gone = plain_lines(rows, k)
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), k).collect()}
    assert got == {r[0]: (lines_left(r, gone), len(gone[r])) for r in rows}
    assert got[2][1] == k and got[3][1] == 0 and got[4][1] == 2 * k


def test_suffix_array_ranks_beginnings(spark):
    texts = [(1, "a\nb\na\nb\na"), (2, "b\na\nb\nz"), (3, "a\nb\nc\na"), (4, "c\na\nb"), (5, "a\nb\na\nb\nc")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    at = {(d, p): t.split("\n")[p:] for d, t in texts for p in range(len(t.split("\n")))}
    count = lambda run: sum(own[: len(run)] == run for own in at.values())
    found = {(r.d, r.p): r for r in lines.suffix_array(df).collect()}
    assert found.keys() == {k for k, own in at.items() if count(own[:1]) > 1}
    for k, r in found.items():
        assert r.lines == max(h for h in (1, 2, 4) if len(at[k]) >= h and count(at[k][:h]) > 1)
    name = {x: r.a for x in "abc" for r in [lines.lines_of(spark.createDataFrame([(1, x)], "doc_id bigint, text string")).first()]}
    for i, r in found.items():
        for j, o in found.items():
            if r.lines == o.lines:
                one, other = ([name[x] for x in at[k][: r.lines]] for k in (i, j))
                assert (r.rank < o.rank) == (one < other) and (r.rank == o.rank) == (one == other)


def test_language(spark, docs):
    rows = [(i, text, lang) for i in range(200) for text, lang in [(f"the cat sat on the mat {i}", "en") if i % 2 else (f"der hund und die katze {i}", "de")]]
    model = language.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    texts = [(1, "the cats"), (2, "die hunde"), (3, None), (4, "123 !"), (5, ""), (6, "\u00bd \u00b2"), (7, "die\u00b2hunde \u2462"), (8, "the " * 200_000)]
    found = {r.doc_id: r for r in language.identify(spark.createDataFrame(texts, "doc_id bigint, text string"), model).collect()}
    assert [found[i].lang_pred for i in range(1, 9)] == ["en", "de", "und", "und", "und", "und", "de", "en"]
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found.values())
    assert language.identify(docs).count() == len(ROWS) and language.identify(docs.limit(0)).count() == 0
    assert language.identify(docs.withColumn("lang", docs.lang.cast("string")).where("false")).count() == 0


def test_language_by_a_plain_scorer(spark, sf_dir):
    """Counts and backoff word by word over whole texts, written out plainly, against the operator."""
    own = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    runs = lambda text: "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    counts = {}  # (length or 0 for words) -> term -> language -> count
    for r in own:
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang is not None:
            for w in runs(r.text):
                terms = [(0, w), *((k, f" {w} "[i : i + k]) for k in range(1, 5) for i in range(max(len(w) + 3 - k, 1)))]
                for k, term in terms:
                    counts.setdefault(k if k == 0 else len(term), {}).setdefault(term, Counter())[r.lang] += 1
    languages = sorted({lang for terms in counts.values() for c in terms.values() for lang in c})
    total = {k: {lang: sum(c[lang] for c in terms.values()) + 0.5 * len(terms) for lang in languages} for k, terms in counts.items()}
    log = lambda k, term, lang: np.log((counts[k][term][lang] + 0.5) / total[k][lang])

    def grams(text):
        if text in counts.get(len(text), {}):
            return [(text, 4 - len(text))]
        return grams(text[:-1]) + grams(text[1:]) if len(text) > 1 else []

    def plain(text):
        scores = {}
        for lang in languages:
            scores[lang] = 0.0
            for w in runs(text):
                if w in counts[0]:
                    scores[lang] += log(0, w, lang)
                elif found := [g for i in range(max(len(w) - 1, 1)) for g in grams(f" {w} "[i : i + 4])]:
                    scores[lang] += sum(log(len(g), g, lang) - down for g, down in found) / len(found)
        best = max(languages, key=lambda lang: (scores[lang], [-ord(c) for c in lang]))
        return best, 1 / sum(np.exp(v - scores[best]) for v in scores.values())

    own = [r for r in own if len(r.text or "") < 3000][:120]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    for r in own:
        if not runs(r.text):
            assert got[r.doc_id].lang_pred == "und" and got[r.doc_id].score == 0
        else:
            lang, score = plain(r.text)
            assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - score) < 1e-6


def test_language_learns_rare_languages(spark):
    rows = [(i, f"the cat sat on the mat {i}", "en") for i in range(600)] + [(i, "der hund und die katze", "de") for i in range(600, 606)] + [(i, "le chien et le chat", "fr") for i in range(606, 612)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train(docs, rows=20)
    assert model.languages == ["de", "en", "fr"]
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, model).collect()}
    assert got == {d: lang for d, _, lang in rows}
    usable = docs.where(~language.held_out())
    want = {}
    for lang, d in usable.selectExpr("lang", "doc_id").orderBy(language.F.xxhash64("doc_id")).collect():
        want.setdefault(lang, []).append(d)
    found = sorted(map(tuple, language._lowest(usable.select("lang", "doc_id"), 20).collect()))
    assert found == sorted((lang, d) for lang, own in want.items() for d in own[:20])


def test_language_held_out(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language.identify(own).join(own.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count() > 0


def plain_components(rows, n, least):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = words((text or "").translate(low))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        root = (min(ids) if ids else None) if sets[i] else d
        out.append((d, len(sets[i]), root, root is None or d == root))
    return Counter(out)


@pytest.mark.parametrize("n", [4, 5])
def test_neardup(spark, docs, n):
    got = neardup.classes(docs, n)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == plain_components(ROWS, n, 80)
    assert neardup.dedup(docs, n).columns == docs.columns
    assert neardup.classes(docs.limit(0)).count() == 0 and neardup.dedup(docs.limit(0)).count() == 0


def test_neardup_chains(spark):
    """Variants of one text at all distances, so that many aren't linked with their centre."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(160):
        own = list(base)
        for at in rng.integers(0, 150, int(rng.integers(0, 16))):
            own[at] = f"x{rng.integers(0, 40)}"
        rows.append((d, " ".join(own[: 150 - 30 * (d % 7 == 3)])))
    got = neardup.classes(spark.createDataFrame(rows, "doc_id bigint, text string"), 4)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == plain_components(rows, 4, 80)


def test_neardup_of_many_copies_that_share_edits(spark):
    """Hundreds of copies of one text that share their edits, all links by brute force over sets of numbers."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(220)]
    rows = []
    for d in range(700):
        own = list(base)
        for at in rng.choice(24, int(rng.integers(0, 14)), replace=False):
            own[9 * at] = f"edit{at}" if rng.random() < 0.8 else f"own{d}"
        rows.append((d, " ".join(own)))
    sets = []
    name = {}
    for _, text in rows:
        w = text.split()
        sets.append(np.asarray(sorted({name.setdefault(tuple(w[i : i + 4]), len(name)) for i in range(len(w) - 3)})))
    held = np.zeros((len(rows), len(name)), np.float32)
    for i, own in enumerate(sets):
        held[i, own] = 1
    same = held @ held.T
    size = held.sum(1)
    linked = 100 * same >= 80 * (size[:, None] + size[None] - same)
    root = np.arange(len(rows))
    while True:
        new = np.where(linked, root[None], len(rows)).min(1)
        if (new == root).all():
            break
        root = new
    got = {r.doc_id: r.component_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id bigint, text string"), 4).collect()}
    assert got == dict(enumerate(root.tolist()))
    assert 10 < len(set(root.tolist())) < 690


def test_neardup_keeps_the_root_of_each_component(spark):
    other = " ".join(f"unlike{i}" for i in range(90))
    rows = [(1, BASE), (1, other), (2, NEAR), (2, ""), (2, " "), (None, other + " more"), (None, "lone one"), (None, "solo"), (None, PASSAGE), (None, PASSAGE + " y"), (None, PASSAGE + " z"), (3, "lone one two three four five"), (3, "lone one two three four five")]
    got = Counter((r.doc_id, r.text) for r in neardup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    passages = [x for x in got.elements() if x[1].startswith(PASSAGE)]
    assert len(passages) == 1 and passages[0] in rows
    assert got - Counter(passages) == Counter([(1, BASE), (1, other), (2, ""), (2, " "), (None, "lone one"), (None, "solo"), (3, "lone one two three four five")])


def test_phrases(spark, docs):
    rows = ROWS
    own = [words(t) for _, t in rows]
    count = Counter(tuple(w[i : i + 35]) for w in own for i in range(len(w) - 34))
    want = Counter()
    for (d, _), w in zip(rows, own, strict=True):
        gone = set()
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        want[d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()] += 1
    assert Counter(map(tuple, phrases.digest(docs).collect())) == want
    assert phrases.digest(docs.limit(0)).count() == 0


def plain_removed(rows, n):
    own = [words(t) for _, t in rows]
    count = Counter(tuple(w[i : i + n]) for w in own for i in range(len(w) - n + 1))
    return [len({j for i in range(len(w) - n + 1) if count[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}) for w in own]


def test_phrases_of_a_hot_anchor(spark, monkeypatch):
    """One common passage between all kinds of others, so that its anchor's segments are dealt to several shards and come in several turns."""
    rng = np.random.default_rng(6)
    common = [f"common{i}" for i in range(24)]
    rows = [(d, " ".join([*(f"a{x}" for x in rng.integers(0, 2, 14)), *common, *(f"b{x}" for x in rng.integers(0, 2, 14)), f"end{d}"])) for d in range(400)]
    rows += [(400 + d, " ".join(common * 3)) for d in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = dict(zip(range(403), plain_removed(rows, 35), strict=True))
    assert 0 < sum(v == 0 for v in want.values()) < 300
    for held in (phrases.HELD, 7):
        monkeypatch.setattr(phrases, "HELD", held)
        assert {r.doc_id: r.n_removed for r in phrases.dedup(docs).collect()} == want


def test_automaton_finds_every_window_of_a_phrase():
    rng = np.random.default_rng(7)
    for _ in range(150):
        n = int(rng.integers(3, 8))
        make = lambda size: [f"w{x}" for x in rng.integers(0, 3, size)]
        own = [make(int(rng.integers(n, 3 * n))) for _ in range(4)]
        masks = [int(rng.integers(0, 1 << (len(w) - n + 1))) for w in own]
        texts = [make(int(rng.integers(1, 60))) for _ in range(5)] + [own[0] + make(2)]
        known = {tuple(w[i : i + n]) for w, m in zip(own, masks, strict=True) for i in range(len(w) - n + 1) if m >> i & 1}
        want = [sum(1 << i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in known) for w in texts]
        assert phrases.locate(texts, list(zip(own, masks, strict=True)), n) == want
    assert phrases.locate([["a"] * 9], [], 3) == [0]


def test_privacy(spark, docs):
    texts = [(1, "mail a.b@c.de, +1 (974) 555-3436 and 192.168.0.1 or 999.1.1.1; 4111 1111 1111 1111 4111"), (2, "ann [at] example.org"), (3, None), (4, ""), (5, "card 4451718024887799 27.65.93.188")]
    got = {r.doc_id: r for r in privacy.find(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 0, 1) and got[1].spans.startswith("email:5:13,ip:37:48")
    assert got[2].spans == "email:0:20" and got[2].n_email == 0
    assert got[3].spans == got[4].spans == "" and got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert "card:5:21" in got[5].spans and "ip:22:34" in got[5].spans
    assert privacy.find(docs).count() == len(ROWS) and privacy.find(docs.limit(0)).count() == 0


_PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    """The base spans by the patterns as they are written."""
    out = []
    for kind, pattern in _PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1]))
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(digits) <= 19 and doubled % 10 == 0 or kind == "phone" and 8 <= len(digits) <= 15:
                out.append((kind, *m.span()))
    return out


def test_base_spans_by_a_plain_scanner(spark, sf_dir):
    rng = np.random.default_rng(8)
    for _ in range(20_000):
        text = "".join(rng.choice(list("ab1.@-_ 2%+0(")) for _ in range(int(rng.integers(1, 22))))
        assert privacy.base_spans(text) == plain_spans(text), text
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in privacy.find(docs).collect():
        want = plain_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in want) for kind in privacy.KINDS)
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


@pytest.mark.parametrize("text", ["1" * 1_000_000, "a" * 1_000_000, "1." * 500_000, "a@" * 500_000, "+1" + "(" * 1_000_000, "a.b@c" + ".c" * 500_000, "1 " * 500_000, "%" * 1_000_000 + "@"])
def test_base_spans_of_long_runs(text):
    import time

    began = time.process_time()
    privacy.base_spans(text)
    assert time.process_time() - began < 2


def test_field_on_held_out_phrases():
    """Recall and precision of the spans that the field adds, on names, hosts and numbers it was not trained on."""
    rng = np.random.default_rng(9)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    lead, tail = ("please write to", "you can reach me under", "contact is", "tel:", "ring me on"), ("tomorrow", "or come by", "thanks")
    phrases, quiet = [], []
    for i in range(60):
        name, host = rng.choice(["zoe", "li.wei", "bob_77", "office"]), rng.choice(["sample.net", "dept2.school.edu", "x-y.info"])
        email = (f"{name} [at] {host}", f"{name}(at){host}", f"{name} at {host.replace('.', ' dot ')}")[i % 3]
        phone = (f"0{digits(3)} {digits(3)} {digits(4)}", f"0{digits(4)} {digits(6)}", f"0{digits(3)}/{digits(7)}")[i % 3]
        phrases.append(("email", f"{lead[i % 3]} ", email, f" {tail[i % 3]}"))
        phrases.append(("phone", f"{lead[3 + i % 2]} ", phone, f" {tail[i % 3]}"))
        quiet += [f"chapter {digits(1)} of {digits(2)} in 19{digits(2)}", f"about {digits(2)} 000 people at {digits(2)}:30", f"he sat at the {rng.choice(['table', 'desk'])} by {digits(1)}", f"version {digits(1)}.{digits(2)}.{digits(1)} of 20{digits(2)}-0{digits(1)}-1{digits(1)}"]
    reader = privacy._Reader(privacy.train())

    def added(text):
        parts = privacy.lines_of(text)
        tags = reader.decode([w for w, _ in parts])
        return privacy.added_spans(text, [(at, t) for (_, at), t in zip(parts, tags, strict=True)], privacy.base_spans(text))

    hit = sum((kind, len(a), len(a) + len(b)) in added(a + b + c) for kind, a, b, c in phrases)
    false = sum(len(added(x)) for x in quiet)
    assert hit >= 0.9 * len(phrases), hit
    assert false <= 0.02 * len(quiet), false


def test_viterbi_is_best():
    field = privacy.train(steps=30)
    import itertools

    phrases = [["one"], "tel: 0171 555 now".split(), "my tel: 0171 555 now".split(), [], "a b".split(), "12 12 12 at".split()]
    found = field.decode(phrases)
    for phrase, tags in zip(phrases, found, strict=True):
        if phrase:
            e = field.emissions(phrase)
            score = lambda tags: sum(e[i, t] for i, t in enumerate(tags)) + sum(field.pairs[a, b] for a, b in itertools.pairwise(tags))  # noqa: B023, E731
            assert tuple(tags) == max(itertools.product(range(5), repeat=len(phrase)), key=score)
        else:
            assert len(tags) == 0


def test_field_reads_whole_words_and_lines(monkeypatch):
    assert privacy.shape("a1-" * 40) == "ad-" * 40
    line = ["x"] * 4000 + "tel: 0171 555 0199 please".split()
    reader = privacy._Reader(privacy.train(steps=30))
    whole = reader.decode([line, line[-5:], [], line])
    monkeypatch.setattr(privacy, "_WORDS", 3)
    assert all((a == b).all() for a, b in zip(whole, reader.decode([line, line[-5:], [], line]), strict=True))
    assert (whole[0] == whole[3]).all()


def test_field_scores_words_of_like_traits_once(monkeypatch):
    field, scored = privacy.train(steps=30), []
    monkeypatch.setattr(privacy._Reader, "_weight", lambda self, trait, plain=privacy._Reader._weight: scored.append(trait) or plain(self, trait))
    lines = [["tel:", f"0171 555 {i}", f"word{'x' * (i % 9)}{chr(97 + i % 26)}", f"a{i:04}@example{i}.org", "É" * (i + 1), f"x_{'y' * i}", f"+{i}", "(at)", "..."] for i in range(1000)]
    reader = privacy._Reader(field)
    found = reader.decode(lines)
    assert len(reader.words) > 4000 and len(scored) < 1000
    for line in lines[::50]:
        for word in line:
            own = privacy._own_traits(word, name := privacy.shape(word))
            at = reader.words[word]
            assert reader.names[reader.shape_of[at]] == name
            assert (reader.own[at] == sum((field.weights[field.traits[x]] for x in own if x in field.traits), np.zeros(len(privacy.TAGS)))).all()
    assert all((a == b).all() for a, b in zip(found[::50], (field.decode([line])[0] for line in lines[::50]), strict=True))


def test_html(spark):
    page = "<title>no</title><body><h1>Head</h1><p>one<p>two <b>bold</b><br>next<div hidden>x</div><ul><li>a<li>b<ol><li>c</ol></ul><table><tr><th>k<th>value<tr><td>long cell<td>1</table><pre>a  b\n c</pre><script>no</script><p style='display:none'>no</p>&amp; 1 < 2"
    assert html.text_of(page) == "Head\n\none\n\ntwo bold\nnext\n\n- a\n- b\n\n  1. c\n\nk          value\nlong cell  1\n\na  b\n c\n\n& 1 < 2"
    rows = [(1, None), (2, ""), (3, "<p>" * 3000 + "deep" + "<td>x"), (4, "plain  text"), (4, "plain  text"), (None, "<b>n")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, html string, text string")
    got = Counter((r.page_id, r.text, r.n_chars) for r in html.extract(pages).collect())
    assert got[(4, "plain text", 10)] == 2 and got[(1, "", 0)] == got[(2, "", 0)] == 1 and got[(None, "n", 1)] == 1 and sum(got.values()) == 6
    assert any("deep" in r[1] and "x" in r[1] for r in got if r[0] == 3)
    assert html.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ("<tr><td rowspan=2>A<td>b<tr><td>c", "A  b\n   c"),
        ("<tr><td>x<td rowspan=3>mid<td>y<tr><td>xx<td>yy<tr><td>xxx<td>yyy<tr><td>p<td>q<td>r", "x    mid  y\nxx        yy\nxxx       yyy\np    q    r"),
        ("<tr><td rowspan=0>A<td colspan=2 rowspan=2>bc<td>d<tr><td>e<tr><td>f<td>g<td>h", "A  bc     d\n          e\n   f   g  h"),
        ("<tr><td colspan=2>wide<td>z<tr><td>1<td>2<td>3", "wide     z\n1     2  3"),
        ("<tr><td rowspan=99999999999>A<td>b<tr><td rowspan=-1>c<tr>", "A  b\n   c"),
    ],
)
def test_html_spans(rows, want):
    assert html.text_of(f"<table>{rows}</table>") == want


def test_html_by_a_plain_reader(spark, sf_dir):
    """The visible words of whole pages in their order, by the parser of the standard library."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.words = [], []

        def handle_starttag(self, tag, attrs):
            own = dict(attrs)
            hidden = tag in html.HIDDEN or "hidden" in own or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*(hidden|collapse)", own.get("style") or "")) or (tag == "dialog" and "open" not in own)
            if tag in html.IMPLIED_END:
                ends, within = html.IMPLIED_END[tag]
                for i in range(len(self.open) - 1, -1, -1):
                    if self.open[i][0] in within:
                        break
                    if self.open[i][0] in ends:
                        del self.open[i:]
                        break
            if tag in html.ENDS_PARAGRAPH and any(t == "p" for t, _ in self.open):
                while self.open.pop()[0] != "p":
                    pass
            if tag not in html.VOID:
                self.open.append((tag, hidden))

        def handle_endtag(self, tag):
            if any(t == tag for t, _ in self.open):
                while self.open.pop()[0] != tag:
                    pass

        def handle_data(self, data):
            if not any(hidden for _, hidden in self.open):
                self.words += data.split()

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    raw = {r.page_id: r.html or "" for r in pages.collect()}
    marks = re.compile(r"^(?:-|\d+\.)$")
    same = 0
    for r in html.extract(pages).collect():
        reader = Reader()
        reader.feed(raw[r.page_id])
        reader.close()
        same += Counter(w for w in r.text.split() if not marks.match(w)) == Counter(w for w in reader.words if not marks.match(w))
    assert same == len(raw) > 0


@pytest.mark.parametrize("depth", [0, 100, 200, 50_000])
def test_html_is_whole_at_any_depth(depth):
    inside = "<div hidden>no<div>no</div>no</div>yes<p style='display:none'>no</p><ul><li>a<li>b<ol><li>c</ol></ul><table><tr><th>k<th>value<tr><td>long cell<td>1</table><blockquote>q</blockquote>"
    want = "yes\n\n- a\n- b\n\n  1. c\n\nk          value\nlong cell  1\n\n  q"
    assert html.text_of("<font>" * depth + inside) == want
    assert html.text_of("<div>" * depth + inside + "</div>" * depth + "<p>after") == want + "\n\nafter"
    assert html.text_of("<p>before<div hidden>" + "<b>" * depth + "<div>no</div><i hidden>no</i>no</div>" + "after") == "before\n\nafter"


def test_decontaminate(spark, docs):
    items = [(1, PASSAGE), (2, "one"), (3, None), (4, ""), (5, " ".join(f"base{i}" for i in range(30, 70))), (6, PASSAGE), (7, "second line end"), (8, " ".join(f"pass{i}" for i in range(58)) + " q q")]
    bench = spark.createDataFrame([(*r, 0) for r in items], "item_id bigint, text string, doc_id int")

    def shingled(w):
        k = min(5, len(w))
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()

    want = Counter()
    for d, text in ROWS:
        w = words((text or "").lower() if d != 10 else text)
        for item, passage in items:
            p = words(passage)
            k = min(5, len(p))
            if not p or not w:
                continue
            span = min(len(p), len(w))
            best = None
            for s in range(len(w) - span + 1):
                own = Counter(tuple(w[s : s + span][i : i + k]) for i in range(span - k + 1))
                like = decontaminate.weighted_jaccard(own, shingled(p))
                if like >= 0.8 and (best is None or like > best[1]):
                    best = (s, like)
            if best:
                want[d, item, best[0], round(best[1], 9)] += 1
    got = Counter((r.doc_id, r.item_id, r.start_word, round(r.similarity, 9)) for r in decontaminate.matches(docs, bench).collect())
    assert got == want and len(want) > 6
    hit = Counter(d for d, *_ in {(d, i) for d, i, *_ in want.elements()})
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and not {r.doc_id for r in kept.collect()} & (set(hit) - {None})
    assert decontaminate.matches(docs.limit(0), bench).count() == 0 and decontaminate.matches(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(ROWS)


def test_decontaminate_by_blocks_of_the_benchmark(spark, docs, monkeypatch):
    """A benchmark that takes several passes over the documents."""
    items = [(i, text) for i, text in enumerate((PASSAGE, "one", None, BASE[:200], "second line end", PASSAGE + " q", LONG[:3000]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = lambda: (Counter(map(tuple, decontaminate.matches(docs, bench).collect())), Counter(map(str, decontaminate.clean(docs, bench).collect())))
    want = found()
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 700)
    assert sum(1 for _ in decontaminate._indexes(bench, 0.8, 24)) > 3
    assert found() == want and len(want[0]) > 5


def test_decontaminate_parts_in_another_order(spark):
    item = [f"item{i}" for i in range(60)]
    around = [f"around{i}" for i in range(200)]
    texts = [(1, around[:100] + item[30:] + item[:30] + around[100:]), (2, item[30:] + item[:30]), (3, around[:50] + item[:30] + around[50:] + item[30:]), (4, (item[30:] + item[:30] + around) * 40)]
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in texts], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    shingled = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    want = set()
    for d, w in texts:
        like, start = max((decontaminate.weighted_jaccard(shingled(w[s : s + 60]), shingled(item)), -s) for s in range(len(w) - 59))
        if like >= 0.8:
            want.add((d, 1, -start, round(like, 9)))
    assert {d for d, *_ in want} == {1, 2, 4}
    assert {(r.doc_id, r.item_id, r.start_word, round(r.similarity, 9)) for r in decontaminate.matches(frame, bench).collect()} == want
    assert [r.doc_id for r in decontaminate.clean(frame, bench).collect()] == [3]
