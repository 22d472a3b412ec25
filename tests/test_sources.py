"""The data source for decks: ranges, sections over ranges and parts, tries and failures of writers."""

import json
import os
import tempfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import export
from tessera.sources import deck_source
from tessera.sources.deck import Deck, lines_of_text, sections

TEXT = "\n".join(["$ head", "lost", "*KEYWORD", "*NODE", *(f"{i:8d}{i:16.2f}{0:16.2f}{1:16.2f}" for i in range(1, 40)), "$ between", "", "*part", "a part  ", "         1         2         3", "*SET_NODE_LIST_TITLE", "a set", "         7", "         1         2         3\r", "*END"]) + "\n"


def new_dir():
    return tempfile.mkdtemp(prefix="spark-")


@pytest.fixture
def path():
    at = f"{new_dir()}/one.k"
    with open(at, "w", newline="") as f:
        f.write(TEXT)
    return at


def seen(rows):
    return sorted((r.line.rstrip(" \r"), r.keyword, r.kind) for r in rows.collect())


@pytest.mark.parametrize("size", [40, 300, 1 << 20])
def test_ranges(spark, path, size):
    want = seen(sections(lines_of_text(spark, TEXT)))
    rows = deck_source.load(spark, path, range_bytes=size)
    assert seen(rows) == want
    assert all(TEXT.encode()[r.line_no :].startswith(r.line.encode()) and TEXT.encode()[r.section :][:1] == b"*" for r in rows.collect())


@pytest.mark.parametrize("block", [3, 16, 1 << 20])
def test_blocks_of_any_size(path, block, monkeypatch):
    monkeypatch.setattr(deck_source, "BLOCK_BYTES", block)
    whole = None
    for size in (11, 90, 10_000):
        reader = deck_source.DeckReader({"path": path, "range_bytes": str(size)})
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        whole = whole or rows
        assert sorted(rows, key=lambda r: r["line_no"]) == sorted(whole, key=lambda r: r["line_no"])
    assert len(whole) == 39 + 2 + 3


def test_kinds_are_left_out_in_the_reader(spark, path):
    deck = Deck.open(spark, path, ["part", "set_node"], range_bytes=100)
    assert deck["part"].select("title", "pid").collect() == [("a part", 1)] and deck["set_node"].first().ids == [1, 2, 3]
    assert deck["node"].count() == 0 == Deck.open(spark, path, [])["part"].count()
    reader = deck_source.DeckReader({"path": path, "kinds": "part"})
    assert {r["kind"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()} == {"part"}
    with pytest.raises(ValueError, match="no such kinds"):
        deck_source.DeckReader({"path": path, "kinds": "parts"})


def test_missing_decks(spark):
    for at in (f"{new_dir()}/none.k", f"{new_dir()}/*.k"):
        with pytest.raises(FileNotFoundError, match="deck"):
            Deck.open(spark, at)


def test_patterns_and_folders(spark, path):
    folder = os.path.dirname(path)
    with open(f"{folder}/two.k", "w") as f:
        f.write("*NODE\n" + f"{5:8d}{1:16.1f}\n")
    assert Deck.open(spark, f"{folder}/*.k")["node"].count() == 40 == Deck.open(spark, folder)["node"].count()
    assert Deck.open(spark, f"{folder}/t?o.k")["node"].count() == 1


def test_stored_reads_one_kind(spark, path):
    deck = Deck.open(spark, path).stored()
    assert deck["node"].count() == 39 and deck.counts().where("n > 0").orderBy("kind").collect() == [("node", 39), ("part", 1), ("set_node", 1)]
    plan = deck["part"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "kind#" in plan and "part" in plan
    only = deck.only(["part"])
    assert only["node"].count() == 0 and only["part"].count() == 1


def tables(spark, n=3000):
    ids = spark.range(n).select((F.col("id") + 1).cast("int").alias("id"))
    return {
        "node": ids.select(F.col("id").alias("nid"), (F.col("id") / 4).alias("x")), "part": ids.where("id < 50").select(F.col("id").alias("pid"), F.concat(F.lit("part "), F.col("id").cast("string")).alias("title")),
        "boundary_spc": ids.where("id < 9").select(F.col("id").alias("nid"), F.when(F.col("id") % 2 == 0, "SET").otherwise("NODE").alias("type")),
    }


def test_written_deck_is_one_in_order(spark):
    at = f"{new_dir()}/deck"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        export.save(tables(spark), at)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    listed = json.load(open(f"{at}/_deck.json"))["parts"]
    assert len(listed) > 2 and sorted(x["name"] for x in listed) == [x["name"] for x in listed] and sorted(os.listdir(at)) == sorted(["_deck.json", *(x["name"] for x in listed)])
    whole = "".join(open(f"{at}/{x['name']}").read() for x in listed)
    assert whole.startswith("*KEYWORD\n*TITLE\ndeck\n*NODE\n") and whole.endswith("*END\n")
    back = Deck.open(spark, at, range_bytes=5000)
    assert [r.nid for r in back["node"].orderBy("line_no").collect()] == list(range(1, 3001))
    assert {(r.nid, r.type) for r in back["boundary_spc"].collect()} == {(i, "SET" if i % 2 == 0 else "NODE") for i in range(1, 9)}
    assert seen(back.data) == seen(sections(lines_of_text(spark, whole)))
    export.save({"part": tables(spark)["part"]}, at)  # replaces the deck
    assert Deck.open(spark, at)["node"].count() == 0 and Deck.open(spark, at)["part"].count() == 49
    assert sum(x.endswith(".k") for x in os.listdir(at)) == len(json.load(open(f"{at}/_deck.json"))["parts"])


def batch(*rows):
    return pa.RecordBatch.from_pylist([{"section": s, "item": i, "line": x} for s, i, x in rows])


def writer(at, overwrite=True):
    from pyspark.sql.types import StructType

    return deck_source.DeckWriter({"path": at}, StructType.fromDDL("section int, item bigint, line string"), overwrite)


def test_tasks_that_are_tried_again(spark):
    at = f"{new_dir()}/deck"
    own = writer(at)
    later = own.write(iter([batch((2, 1, "*PART"), (2, 1, "t"), (2, 1, "         1"))]))
    own.write(iter([batch((1, 1, "*NODE"))]))  # an attempt that is lost
    first = own.write(iter([batch((1, 1, "*NODE"), (1, 2, "       1             2.0")), batch((1, 3, "       2             2.0"))]))
    own.commit([later, first, own.write(iter([])), None])
    assert Deck.open(spark, at)["node"].count() == 2 and Deck.open(spark, at)["part"].count() == 1
    assert not [x for x in os.listdir(at) if x.startswith("_writing")]
    more = writer(at, overwrite=False)  # appended lines go on in the last section
    more.commit([more.write(iter([batch((0, 0, "$ more"), (0, 1, "another"), (0, 1, "         9"))]))])
    assert Deck.open(spark, at).data.where("keyword = '*PART'").count() == 4


def test_an_abort_leaves_the_old_deck(spark):
    at = f"{new_dir()}/deck"
    old = writer(at)
    old.commit([old.write(iter([batch((1, 1, "*NODE"), (1, 1, "       1             2.0"))]))])
    new = writer(at)
    message = new.write(iter([batch((1, 1, "*NODE"))]))
    new.abort([message, None])
    assert Deck.open(spark, at)["node"].count() == 1 and len(os.listdir(at)) == 2


def test_lines_out_of_order_are_refused():
    own = writer(f"{new_dir()}/deck")
    with pytest.raises(ValueError, match="order"):
        own.write(iter([batch((2, 1, "b"), (1, 1, "a"))]))
    a, b = own.write(iter([batch((1, 1, "a"), (3, 1, "a"))])), own.write(iter([batch((2, 1, "b"))]))
    with pytest.raises(ValueError, match="ranges"):
        own.commit([a, b])
