"""Stored orders against plain lists."""

import random

import pytest

from tessera.operators import ordered


def listed(rows):
    return [x.id for x in rows.orderBy("at").collect()]


@pytest.mark.parametrize("gap,span,most", [(1 << 20, 1 << 36, 1 << 20), (4, 64, 1 << 20), (4, 64, 30), (2, 16, 1 << 20)])
def test_insert(spark, gap, span, most):
    r = random.Random(gap + most)
    want = list(range(40))
    rows = ordered.spread(spark.createDataFrame([(i, i) for i in want], "id long, v long"), ["id"], gap)
    for turn in range(4):
        new = [(100 * (turn + 1) + i, r.choice([None, 999, 7, 7, 7, *want]), r.random()) for i in range(30)]
        df = spark.createDataFrame(new, "id long, before long, seq double").repartition(3)
        for id_, before, _ in sorted(new, key=lambda x: x[2]):
            want.insert(want.index(before) if before in want and before < 100 * (turn + 1) else len(want), id_)
        rows = ordered.checkpointed(ordered.insert(rows, df, "id", ["seq"], gap, span, most))
        got = rows.collect()
        assert listed(rows) == want and len({x["at"] for x in got}) == len(want) and min(x["at"] for x in got) > 0
        assert {x.v for x in got if x.id >= 100} == {None} and rows.columns == ["id", "v", "at"]


def test_untouched_keys_stay(spark):
    rows = ordered.checkpointed(ordered.spread(spark.range(100), ["id"]))
    old = {x.id: x["at"] for x in rows.collect()}
    new = spark.range(1000, 1500).selectExpr("id", "50L AS before")
    found = {x.id: x["at"] for x in ordered.insert(rows, new, "id", ["id"]).collect()}
    assert len(found) == 600 and all(found[i] == a for i, a in old.items()) and all(old[49] < found[i] < old[50] for i in range(1000, 1500))


def test_empty(spark):
    none = ordered.spread(spark.range(0), ["id"])
    new = spark.createDataFrame([(5, None), (6, 1)], "id long, before long")
    assert listed(ordered.insert(none, new, "id", ["id"])) == [5, 6]
    rows = ordered.spread(spark.range(3), ["id"])
    assert listed(ordered.insert(rows, new.limit(0), "id", ["id"])) == [0, 1, 2]


def test_edits(spark):
    rows = ordered.checkpointed(ordered.spread(spark.createDataFrame([(1, "a"), (2, "b"), (1, "c"), (3, "d"), (1, "e")], "id long, v string"), ["v"]))
    gone = spark.createDataFrame([(1,), (1,), (9,)], "id long")
    show = lambda df: [(x.id, x.v) for x in df.orderBy("at").collect()]
    assert show(ordered.remove(rows, gone, "id")) == [(2, "b"), (3, "d")]
    assert show(ordered.remove_first(rows, gone, "id")) == [(2, "b"), (1, "c"), (3, "d"), (1, "e")]
    new = spark.createDataFrame([(1, 1, "x"), (1, 2, None), (3, 1, "y"), (9, 1, "z")], "id long, seq int, v string")
    assert show(ordered.change(rows, new, "id", ["v"], "seq")) == [(1, None), (2, "b"), (1, None), (3, "y"), (1, None)]
    at = ordered.at_places(rows, spark.createDataFrame([(2, "new"), (0, "top"), (77, "end")], "place long, v string"))
    got = ordered.insert(rows, at, "at", ["v"])
    assert show(got) == [(None, "top"), (1, "a"), (2, "b"), (None, "new"), (1, "c"), (3, "d"), (1, "e"), (None, "end")]
    assert [x.place for x in ordered.places(got).orderBy("at").collect()] == list(range(8))


def test_change_without_seq(spark):
    rows = ordered.checkpointed(ordered.spread(spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3), (4, "d", 4)], "id long, v string, w int"), ["id"]))
    new = spark.createDataFrame([(1, None, None, 9), (2, None, "x", 9), (2, -5, "y", None), (3, 7, "u", 1), (3, 7, "v", 0), (3, 7, None, 5)], "id long, seq int, v string, w int")
    got = ordered.change(rows, new, "id", ["v", "w"], "seq").orderBy("at").collect()
    assert [(x.id, x.v, x.w) for x in got] == [(1, None, 9), (2, "y", None), (3, "v", 0), (4, "d", 4)]
