import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import script, views
from tessera.sources.deck import Deck, lines_of_text
from tessera.sources.library import script_blocks

WANT = """*Inputfile
a.k
*Mode
PART_EXCHANGE,9
PART_EXCHANGE,4
**PartExchange,9
*PID,9
*ConvertHexato,SolidComp,(0.0,0.0,1.0),0.0
*MID01,*MAT_ELASTIC_TITLE
PET
$#     mid       rho         e        pr
     MID011.4000e-09 3.500e+03    0.3000
*THK01,0.100
*NUME1,2
*MID02,*MAT_VISCOELASTIC_TITLE
OCA_PET
$#     mid       rho      bulk        g0        gi      beta
     MID021.1333e-09 1.306e+03 1.499e+00 1.499e+00    2.0000
*THK02,0.300
*NUME2,2
*Layup
$$THK,MID,EOSID,HGID from bottom side
THK01,MID01,EOS,HGID,NUME1
THK02,MID02,EOS,HGID,NUME2
*EndLayup
**EndPartExchange
**PartExchange,4
*PID,4
*ConvertHexato,SolidComp,(1.0,0.0,0.0),45.0
*MID03,*MAT_VISCOELASTIC_TITLE
OCA
$#     mid       rho      bulk        g0        gi      beta
     MID031.0000e-09 5.000e+02 1.000e+00 1.000e+00    3.0000
*THK03,0.050
*NUME3,2
*Layup
$$THK,MID,EOSID,HGID from bottom side
THK03,MID03,EOS,HGID,NUME3
*EndLayup
**EndPartExchange
*End"""


def test_script(spark):
    parts = spark.createDataFrame([(0, 9, True, 0.0, 0.0, 1.0, 0.0), (1, 4, True, 1.0, 0.0, 0.0, 45.0), (2, 5, False, 1.0, 0.0, 0.0, 0.0), (3, 6, True, 1.0, 0.0, 0.0, 0.0)], "part_ord int, part_id int, enabled boolean, dx double, dy double, dz double, angle double")
    pet, oca = ("PET", "ELASTIC", 1.4, 3500.0, 0.3, 0.0, 0.0), ("OCA", "VISCOELASTIC", 1.0, 500.0, 0.5, 0.2, 3.0)
    rows = [(9, 1, 0, *pet[:1], 0.1, *pet[1:]), (9, 2, 1, *oca[:1], 0.2, *oca[1:]), (9, 2, 2, *pet[:1], 0.1, *pet[1:]), (4, 1, 0, *oca[:1], 0.05, *oca[1:]), (5, 1, 0, *oca[:1], 0.05, *oca[1:])]
    layers = spark.createDataFrame(rows, "part_id int, layer_set int, ord int, name string, thickness double, type string, density double, modulus double, add1 double, add2 double, add3 double")
    got = [r.line for r in script.script(parts, layers, "a.k").orderBy("block", "part_ord", "step", "mid", "i").collect()]
    assert "\n".join(got) == WANT
    found = script_blocks(lines_of_text(spark, WANT + "\n**PartExchange,8\n*MID07,*MAT_ELASTIC_TITLE\n_lone_name\n**EndPartExchange\n*THK07,9.0"))
    assert sorted((r.pid, r.mid, round(r.thickness, 9), r.part_no, r.name) for r in found.collect()) == [(4, 3, 0.05, 0, "OCA"), (8, 7, 0.05, 0, "_lone_name"), (9, 1, 0.1, 0, "PET"), (9, 2, 0.15, 0, "OCA"), (9, 2, 0.15, 1, "PET")]


def test_views(spark):
    deck = Deck.parse(spark, "*PART\nwheel\n         1         2         3\n*PART\n\n*NODE\n       7             1.0\n")
    assert [r[0] for r in deck["part"].select(views.label("part", deck["part"].columns)).collect()] == ["1: wheel"]
    assert [r[0] for r in deck["node"].select(views.label("node", deck["node"].columns)).collect()] == ["Node 7"]
    assert '"nid":7' in views.details(deck["node"]).first()[0]
    assert views.new_record(spark, "node", nid=3, x=1.5).first()["x"] == 1.5
    with pytest.raises(ValueError, match="over 0"):
        views.new_record(spark, "node")
    ring = spark.createDataFrame([(1, [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)])], "pid int, ring array<struct<u:double,v:double>>")
    got = [(r.u, r.v) for r in views.along(ring, "pid", 6).orderBy("sample").collect()]
    assert all(math.isclose(a, b, abs_tol=1e-9) for p, q in zip(got, [(0, 0), (2, 0), (4, 0), (4, 2), (2, 2), (0, 2)], strict=True) for a, b in zip(p, q, strict=True))
    assert deck["node"].where(F.col("nid") == 7).count() == 1
