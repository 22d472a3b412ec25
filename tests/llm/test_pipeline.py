"""The pipeline stage by stage against plain versions of its stages on the smallest documents."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tessera.llm import decontaminate, packing, quality
from tessera.llm.common import slices
from tests.llm.test_edges import BASE, NEAR, PASSAGE, ROWS, lines_left, plain_components, plain_lines, words


def test_stages(spark, sf_dir):
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    docs = table("documents")
    found = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf_dir)
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        now = spark.createDataFrame(rows, out.schema) if (rows := out.collect()) else out
        found[name] = rows
    text = lambda rows: [(r.doc_id, r.text) for r in rows]

    trees = quality.train(docs, table("labels"))
    keep = []
    for r in docs.collect():
        counts, features = quality.statistics(r.text)
        if not quality.base_failed(counts[0], counts[4]) and trees.score(np.asarray([features]))[0] >= quality.LEAST_SCORE:
            keep.append((r.doc_id, r.text))
    assert Counter(text(found["quality rules"])) == Counter(keep)

    own, gone = plain_lines(keep, 5)
    left = [(r[0], lines_left(r, gone)) for r in keep if len(gone[r]) < len(own[r])]
    assert Counter(text(found["line dedup"])) == Counter(left)
    assert all(r.n_chars == len(r.text) for r in found["line dedup"])

    stay = {d for d, _, _, kept in plain_components(left, 5, 80).elements() if kept}
    assert Counter(text(found["near-dedup"])) == Counter(r for r in left if r[0] in stay)

    bench = [(r.item_id, words(r.text.lower())) for r in table("benchmark").collect()]
    index = [(p, Counter(tuple(p[i : i + 5]) for i in range(len(p) - 4))) for _, p in bench]
    clean = []
    for d, t in text(found["near-dedup"]):
        w = words(t.lower())
        every = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        held = set(every)
        hit = any(
            held & own.keys() and any(decontaminate.weighted_jaccard(Counter(every[s : s + min(len(p), len(w)) - 4]), own) >= 0.8 for s in range(len(w) - min(len(p), len(w)) + 1))
            for p, own in index
        )
        if not hit:
            clean.append((d, t))
    assert Counter(text(found["decontamination"])) == Counter(clean)

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    want = Counter()
    for d, t in clean:
        ids = np.asarray([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        start, k, length = 0, 0, len(ids) % 1024 or 1024
        while start < len(ids):
            want[d, k, start, length, zlib.crc32(ids[start : start + length].tobytes())] += 1
            start, k, length = start + length, k + 1, 1024
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found["packing"]) == want
    ends = {}
    for r in sorted(found["packing"], key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 1024 and len(ends) <= 1 + 1.03 * sum(n[3] for n in want.elements()) / 1024


CLASHES = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_lines int, n_removed string, kept boolean, _kept int, _text string, d int, t string, p int, o string, row int, key string, rank int, part int, length int, component_id string"


@pytest.mark.parametrize("rows", [ROWS, [], [(None, None), (None, None), (1, "")]])
def test_stages_on_edge_rows_with_clashing_columns(spark, tmp_path, rows):
    """Nulls, empty and very long texts, repeated rows, ties, empty tables: no stage fails, and other columns come back as they were."""
    spark.createDataFrame([(1, 1), (9, 0)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (None, None), (2, "")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    more = ("en", "s", 5, -1, "r", False, 2, "T", 3, "u", 4, "v", 5, "w", 6, 7, 8, "c")
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame([(d, t, *more) for d, t in rows], CLASHES)
        out = stage(spark, docs, str(tmp_path))
        found = out.collect()
        if name == "packing":
            assert Counter(r.doc_id for r in found if r.piece == 0) == Counter(d for d, _ in rows)
            continue
        assert out.columns == docs.columns
        assert all(tuple(r)[2:4] == more[:2] and tuple(r)[5:] == more[3:] for r in found)
        assert {r.doc_id for r in found} <= {d for d, _ in rows}
        if name == "near-dedup" and rows is ROWS:
            assert sum(r.text in (BASE, NEAR) for r in found) == 1
        if name == "decontamination" and rows is ROWS:
            assert {d for d, _ in rows} - {r.doc_id for r in found} == {11, 12}


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_packing_in_the_pipeline_leaves_workers_small(monkeypatch):
    """A worker keeps the chunks that it remembers when the next stages run, so the pipeline remembers fewer; the ids are the same."""
    monkeypatch.setattr(packing, "pack", lambda docs, **given: given)
    assert corpus_pipeline.best_fit_packing(None, None, "")["remembered"] <= 250_000
    few, many = packing.encoder(packing.vocabulary_path(), 20), packing.encoder(packing.vocabulary_path())
    texts = [" ".join(f"w{i}x, {i % 7}" for i in range(500)), PASSAGE, "", BASE]
    assert few.encode(texts) == many.encode(texts) and few.encode(texts) == many.encode(texts)
    assert len(few.known) == 20 < len(many.known)


def test_decontamination_takes_little_text_at_a_time():
    """Texts are cut into slices of a megabyte by rows, never within one."""
    batch = pa.RecordBatch.from_pydict({"t": ["x" * 600_000, None, "y" * 600_000, "z" * 3_000_000, ""]})
    parts = list(slices(batch, "t", decontaminate.CLEAN_BYTES))
    assert [p.num_rows for p in parts] == [2, 1, 1, 1] and pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
