"""Decoding, number fields, export round trips and the edit model."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import fields
from tessera.operators import edit, export
from tessera.sources import library
from tessera.sources.cards import KINDS
from tessera.sources.cards import fields as card_fields
from tessera.sources.deck import Deck, lines_of_text


@pytest.mark.parametrize(("text", "number"), [("12abc", 12), ("  -7", -7), ("", 0), ("abc", 0), ("99999999999", 0), ("1.9", 1), ("+3", 3)])
def test_lenient_int(spark, text, number):
    assert spark.createDataFrame([(text,)], "t string").select(fields.lenient_int(F.col("t"))).first()[0] == number


@pytest.mark.parametrize(("text", "number"), [("1.5d", 1.5), ("1.0-5", 1.0), (" .5", 0.5), ("2e3x", 2000.0), ("", 0.0), ("-", 0.0), ("7.", 7.0)])
def test_lenient_double(spark, text, number):
    assert spark.createDataFrame([(text,)], "t string").select(fields.lenient_double(F.col("t"))).first()[0] == number


@pytest.mark.parametrize("value", [0.0, 0.5, 1.0, -2.25, 123456.0, 0.001, 3.14159265, 999999.0, 0.0001, 12.5])
def test_format_like_general(spark, value):
    got = spark.createDataFrame([(value,)], "v double").select(fields.format_double(F.col("v"), 16)).first()[0]
    assert got == (f"{value:.12g}" if value else "0.0").rjust(16)


def test_format_extremes(spark):
    got = [r[0] for r in spark.createDataFrame([(2.5e6,), (1e-5,), (-3e10,)], "v double").select(fields.format_double(F.col("v"), 16)).collect()]
    assert [float(x) for x in got] == [2.5e6, 1e-5, -3e10] and all("e" in x and len(x) == 16 for x in got)


def write_card(layout, values):
    return "".join(f"{values[name]!s:>{width}}" for name, _, _, width in card_fields(layout))


@pytest.mark.parametrize("name", sorted(k for k, v in KINDS.items() if v.mode in ("each", "first") and not k.startswith("element_") and k not in ("contact", "include")))
def test_every_kind_of_cards(spark, name):
    """Two records of each kind, written by the catalog: the first alone counts where one is read."""
    import re

    kind = KINDS[name]
    keyword = re.sub(r"\\s\*|\$|\^|\\", "", kind.keyword)
    keyword = re.sub(r"\(([^|)]*)[^)]*\)\??", lambda m: m[1], keyword)
    out, want = [keyword], []
    for record in range(2):
        values = {}
        if kind.titled == "always":
            out.append(f"title {record}")
        for i, card in enumerate(kind.cards):
            own = {f: (i * 10 + k + 1 + record if t != "d" else (k + 1 + record) / 4) for k, (f, t, _, _) in enumerate(card_fields(card))}
            out.append(write_card(card, own))
            values |= own
        want.append(values)
    found = Deck.parse(spark, "\n".join(out) + "\n*END")[name].orderBy("line_no").collect()
    want = want if kind.mode == "each" else want[:1]
    assert [{k: r[k] for k in w} for r, w in zip(found, want, strict=True)] == want


DECK = """*KEYWORD
*PART
wheel
         1         2         3
second title
         9         9         9
*NODE
$ comment
       1             1.0             2.0            -3.5       0       1
       2         1.5e+01             2.0

*ELEMENT_SOLID
       7       1       1       2       3       4       5       6       7       8
*ELEMENT_BEAM
       8       1       1       2
*SET_NODE_LIST_TITLE
my set
        10
         1         2         0         3         4         5         6         7
         8
*SET_SEGMENT
         3
         1         2         3         4
         0         0         0         0
*CONTACT_TIED_NODES_TO_SURFACE
         1         2
       0.1
*MAT_COMPOSITE_DAMAGE_TITLE
cfrp
         3       1.5     100.0      10.0       9.0       0.3
       4.0       5.0       6.0
      50.0      60.0      70.0      80.0      90.0
*DEFINE_CURVE
         5
                 0.0                 1.0
                 2.0                 3.0
*INCLUDE_PATH_RELATIVE
sub/mesh.k
*DATABASE_HISTORY_NODE
         4         5
*END
"""


#: Both pairs after *PART count for names, only the first for records.
PART_NAMES = {1: "wheel", 9: "second title"}


def test_deck(spark):
    deck = Deck.parse(spark, DECK)
    one = lambda kind: deck[kind].collect()
    assert [(r.pid, r.title) for r in one("part")] == [(1, "wheel")]
    assert [(r.nid, r.x, r.z, r.tc, r.rc) for r in deck["node"].orderBy("nid").collect()] == [(1, 1.0, -3.5, 0, 1), (2, 15.0, 0.0, 0, 0)]
    assert {(r.eid, r.type, r.node_count, tuple(r.nodes)) for r in one("element")} == {(7, "solid", 8, tuple(range(1, 9))), (8, "beam", 2, (1, 2))}
    assert [(r.sid, r.title, r.ids) for r in one("set_node")] == [(10, "my set", [1, 2, 3, 4, 5, 6, 7, 8])]
    assert [len(r.segments) for r in one("set_segment")] == [1]
    assert one("contact") == []  # cut short before its third card
    m = one("material")[0]
    assert (m.mid, m.title, m.type, m.cards_parsed, m.e, m.eb, m.pr, m.gab, m.xc, m.sc) == (3, "cfrp", "COMPOSITE_DAMAGE", 3, 100.0, 10.0, 0.3, 4.0, 50.0, 90.0)
    assert [tuple(p) for p in one("curve")[0].points] == [(0.0, 1.0), (2.0, 3.0)]
    assert (one("include")[0].filepath, one("include")[0].is_path_only, one("include")[0].is_relative) == ("sub/mesh.k", True, True)
    assert one("database_history")[0].ids == [4, 5]
    assert {r.pid: r.name for r in deck.part_names().collect()} == PART_NAMES
    assert {r.kind: r.n for r in deck.counts().collect()}["node"] == 2


def test_files_and_blocks(spark, tmp_path, monkeypatch):
    """A file in several parts, and sections carried over many blocks of lines."""
    from tessera.sources import deck as source

    monkeypatch.setattr(source, "BLOCK_LINES", 7)
    body = "".join(f"{i:8d}{i / 2:16.1f}{0:16.1f}{0:16.1f}\n" for i in range(1, 400))
    (tmp_path / "a.k").write_text("*NODE\n" + body + "*END\n")
    (tmp_path / "b.k").write_text("*PART\nlast\n         5\n" + "$ x\n" * 900 + "*NODE\n" + body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        deck = Deck.read(spark, str(tmp_path / "*.k"))
        assert deck.lines.select("file", "line_no").distinct().count() == deck.lines.count() == 401 + 1303
        ordered = [r.nid for r in deck["node"].where("file LIKE '%a.k'").orderBy("line_no").collect()]
        assert ordered == list(range(1, 400)) and deck["node"].count() == 798
        assert deck["node"].agg(F.sum("x")).first()[0] == sum(range(1, 400)) and deck["part"].first().title == "last"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_export_round_trip(spark, tmp_path):
    deck = Deck.parse(spark, DECK)
    kinds = ["node", "element_solid", "part", "material", "set_node", "set_segment", "curve"]
    path = str(tmp_path / "out")
    export.write(export.deck_lines({k: deck[k] for k in kinds}), path)
    text = "\n".join(r.value for r in spark.read.text(path).collect())
    lines = "\n".join(r.line for r in export.deck_lines({k: deck[k] for k in kinds}).orderBy("section", "item", "card").collect())
    assert sorted(text.split("\n")) == sorted(lines.split("\n"))
    again = Deck.parse(spark, lines)
    for k in kinds:
        drop = ["file", "line_no", "section"]
        assert sorted(map(str, again[k].drop(*drop).collect())) == sorted(map(str, deck[k].drop(*drop).collect()))


def test_expressions(spark):
    df = spark.createDataFrame([(1, 2.5), (2, -3.5), (3, 0.0)], "i int, v double")
    names = {"v": F.col("v"), "i": F.col("i")}
    got = [r[0] for r in df.orderBy("i").select(edit.expression("max(abs(v), i) * 2 if v < 0 else round(v)", names)).collect()]
    assert got == [2.0, 7.0, 0.0]
    for bad in ("__import__('os')", "v.real", "[v]", "x + 1", "'a'", "lambda: 1", "v if", "round(v, i)"):
        with pytest.raises(edit.Unsupported):
            edit.expression(bad, names)
    assert df.select(edit.expression("1 / v", names).alias("x")).where("x IS NULL").count() == 1


def test_history(spark):
    h = edit.History(spark.range(3).toDF("id"), most=2)
    h.apply(lambda t: t.where("id > 0"))
    h.apply(lambda t: t.where("id > 1"), lambda t: t.withColumn("x", F.lit(1)))
    assert h.table.count() == 1 and h.undo().count() == 2 and h.redo().columns == ["id", "x"]
    with pytest.raises(ZeroDivisionError):
        h.apply(lambda t: 1 / 0)
    assert h.table.columns == ["id", "x"]


def test_library(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Name,Modulus,Density,type,add1,add2,add3\nPET,3.5 GPa,1.4,elastic,0.3,,\nPET,2 GPa,1.3,elastic,0.3,,\nOCA, 500kPa,1.0,viscoelastic,1,2,3\n")
    got = {r.name: (r.modulus, r.type, r.density) for r in library.materials(spark, str(tmp_path / "m.csv")).collect()}
    assert got == {"PET": (2000.0, "ELASTIC", 1.3), "OCA": (0.5, "VISCOELASTIC", 1.0)}
    (tmp_path / "s.csv").write_text("PET,0.1,1,7\nOCA,x,1,7\nbad\n")
    assert [(r.material, r.thickness, r.part_id) for r in library.stacks(spark, str(tmp_path / "s.csv")).collect()] == [("PET", 0.1, 7)]
    script = "*Inputfile\na.k\n**PartExchange,12\n*MID01,*MAT_ELASTIC_TITLE\nPET_OCA\n*THK01,0.200\n*MID02,*MAT_VISCOELASTIC_TITLE\nOCA\n**EndPartExchange\n*MID03,*MAT_ELASTIC_TITLE\nlost\n"
    got = sorted((r.pid, r.mid, r.part_no, r["name"], r.thickness) for r in library.script_blocks(lines_of_text(spark, script)).collect())
    assert got == [(12, 1, 0, "PET", 0.1), (12, 1, 1, "OCA", 0.1), (12, 2, 0, "OCA", 0.05)]


def test_ingest(spark, tmp_path):
    from tessera.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.k").write_text(DECK)
    args = (spark, str(tmp_path / "in"), ["node", "part"], str(tmp_path / "out"))
    ingest.watch(*args, str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out" / "node")).count() == 2
    ingest.watch(*args, str(tmp_path / "other")).awaitTermination(60)  # the first batch again
    assert spark.read.parquet(str(tmp_path / "out" / "node")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out" / "part")).columns[-1] == "batch"
