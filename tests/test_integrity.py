"""Scopes of checks, and checks of what changed against checks of everything."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import integrity


def deck(spark, seed):
    r = random.Random(seed)
    e = [(i, r.randint(1, 6), r.choice(["shell", "solid", "beam"]), [r.randint(0, 60) for _ in range(4)]) for i in range(1, 60)] + [(5, 1, "solid", [1, 2, 3])]
    n = [(i, float(i) if i % 9 else float("nan"), 1e12 if i % 13 == 0 else 0.0, 0.0) for i in range(1, 55) if r.random() < 0.9] + [(2, 0.0, 0.0, 0.0)]
    p = [(i, r.randint(0, 3), r.randint(0, 3)) for i in range(1, 6)]
    frame = spark.createDataFrame
    return frame(e, "eid long, pid long, type string, nodes array<long>"), frame(n, "nid long, x double, y double, z double"), frame(p, "pid long, secid long, mid long"), frame([(1,), (2,)], "secid long"), frame([(1,), (3,)], "mid long")


def seen(issues):
    return sorted(map(str, issues.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_recheck(spark, seed):
    e, n, p, s, m = deck(spark, seed)
    standing = integrity.check_deck(e, n, p, s, m)
    now = e.where("eid % 7 <> 0").withColumn("pid", F.when(F.col("eid") % 11 == 0, 9).otherwise(F.col("pid"))), n.where("nid % 10 <> 1"), p.where("pid <> 2").unionByName(p.where("pid = 3")), s.where("secid = 1"), m.union(spark.range(2, 3))
    changed = e.where("eid % 7 = 0 OR eid % 11 = 0").select(F.lit("element").alias("category"), F.col("eid").alias("item_id")).unionByName(n.where("nid % 10 = 1").select(F.lit("node").alias("category"), F.col("nid").alias("item_id")))
    changed = changed.unionByName(spark.createDataFrame([("part", 2), ("part", 3), ("section", 2), ("material", 2)], "category string, item_id long"))
    want = seen(integrity.check_deck(*now))
    assert want and seen(integrity.recheck(standing, changed, *now)) == want != seen(standing)
    assert seen(integrity.recheck(standing, changed.limit(0), e, n, p, s, m)) == seen(standing)


def test_scopes(spark):
    own = deck(spark, 3)
    whole = integrity.check_deck(*own)
    parts = [seen(integrity.check_deck(*own, category=c)) for c in ("element", "node", "part")]
    assert sorted(sum(parts, [])) == seen(whole) and all(parts)
    one = spark.createDataFrame([("element", 5)], "category string, item_id long")
    assert seen(integrity.check_deck(*own, touched=one)) == seen(whole.where("category = 'element' AND item_id = 5"))
