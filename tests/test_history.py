"""Histories against a plain undo manager, and tree searches against a plain walk."""

import random

import pytest

from tessera.operators import history, select


def plain(log, most):
    """Executed commands with undone ones taken away, step by step."""
    force, undo, redo, batch = {}, [], [], None
    for _, seq, action in sorted(log, key=lambda r: (r[1], r[2] or "")):
        if action == "do":
            force[seq] = True
            if batch is None:
                undo, redo = [*undo, [seq]][-most:], []
            else:
                batch.append(seq)
        elif action == "undo" and undo:
            redo.append(undo.pop())
            for s in redo[-1]:
                del force[s]
        elif action == "redo" and redo:
            undo.append(redo.pop())
            for s in undo[-1]:
                force[s] = True
        elif action == "begin":
            batch = batch or [] if batch is None else batch
        elif action == "commit":
            if batch:
                undo, redo = [*undo, batch][-most:], []
            batch = None
        elif action == "rollback":
            for s in batch or []:
                del force[s]
            batch = None
        elif action == "clear":
            undo, redo, batch = [], [], None
    held = {s for own in undo for s in own}
    return {(s, s in held) for s in force}


@pytest.mark.parametrize("most", [1, 3, 100])
def test_in_force(spark, most):
    r = random.Random(most)
    log = [(s, i * 3 + s, r.choices(["do", "undo", "redo", "begin", "commit", "rollback", "clear", "odd", None], [12, 6, 4, 2, 2, 1, 0.3, 1, 1])[0]) for s in range(9) for i in range(r.randint(0, 400))]
    log += [(None, 1, "do"), (None, 2, "undo"), (None, 3, "redo"), (50, 1, "undo"), (51, 1, "begin"), (51, 2, "do")]
    df = spark.createDataFrame([(*x, "x") for x in log], "session long, seq long, action string, undo string").repartition(3)
    got = {}
    for x in history.in_force(df, most).collect():
        got.setdefault(x.session, set()).add((x.seq, x.undoable))
    want = {s: own for s in {x[0] for x in log} if (own := plain([x for x in log if x[0] == s], most))}
    assert got == want and got[None] == {(1, True)} and got[51] == {(2, False)}
    assert history.in_force(df.limit(0), most).count() == 0


def test_state_stays_small():
    stack = history.Stack(100)
    for i in range(10_000):
        stack.step("do", i)
    assert len(stack.undo) == 100 and stack.settled == list(range(9_900))


@pytest.mark.parametrize("text", ["ab", "A ", "", "zz", "77"])
def test_visible_tree(spark, text):
    r = random.Random(4)
    rows = [(i, None if i < 3 or r.random() < 0.02 else r.randrange(max(0, i - 6), i), r.choice([None, "", "xab", "B a", "Ab 77", "c", "d", "e", "f"]) if i % 5 == 0 else "n") for i in range(120)]
    rows += [(200, 201, "ab"), (201, 202, "n"), (202, 200, "n"), (203, 999, "A")]  # a ring, and a row whose parent isn't there
    want, low = set(), text.lower().strip()
    parent = {i: p for i, p, _ in rows}
    hit = {i for i, _, label in rows if not low or low in (label or "").lower()}
    for i in hit:
        while i in parent and i not in want:
            want.add(i)
            i = parent[i]
    want |= hit | {i for i, p, _ in rows if p in hit}
    tree = spark.createDataFrame([(*x, 1) for x in rows], "id long, parent long, label string, own int")
    got = select.visible_tree(tree, text)
    assert got.columns == tree.columns and {x.id for x in got.collect()} == want
