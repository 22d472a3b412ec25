"""Undo and redo over a log of commands: which commands are in force, folded as the log streams by."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Commands, or batches of them, that can be undone.
MOST = 100
ACTIONS = ("do", "undo", "redo", "begin", "commit", "rollback", "clear")


class Stack:
    """One session. ``settled`` takes what can no longer be undone; a batch is one entry."""

    def __init__(self, most: int) -> None:
        self.most, self.settled = most, []
        self.undo: deque[list[int]] = deque()
        self.redo: list[list[int]] = []
        self.batch: list[int] | None = None

    def step(self, action: str, seq: int) -> None:
        if action == "do" and self.batch is not None:
            self.batch.append(seq)
        elif action == "do":
            self._push([seq])
        elif action == "undo" and self.undo:
            self.redo.append(self.undo.pop())
        elif action == "redo" and self.redo:
            self.undo.append(self.redo.pop())
        elif action == "begin" and self.batch is None:
            self.batch = []
        elif action == "commit":
            done, self.batch = self.batch, None
            if done:
                self._push(done)
        elif action == "rollback":
            self.batch = None
        elif action == "clear":
            self.settled += [x for own in (*self.undo, self.batch or []) for x in own]
            self.undo, self.redo, self.batch = deque(), [], None

    def _push(self, entry: list[int]) -> None:
        self.undo.append(entry)
        self.redo = []
        if len(self.undo) > self.most:
            self.settled += self.undo.popleft()


def in_force(log: DataFrame, most: int = MOST) -> DataFrame:
    """session, seq and ``undoable`` of every command that is in force at the end of its session's log.

    log: session, seq and an action: ``do``, a command; ``undo`` and ``redo``; ``begin``, ``commit`` and ``rollback`` of a batch,
    which is undone as one; ``clear``, which forgets what could be undone. A new command forgets what could be redone;
    of more than most entries the oldest stay in force and can't be undone. A batch inside a batch is part of it. The commands of a batch that is still open are
    in force and not undoable yet. Unknown and null actions do nothing; actions of one seq are taken in the order of ACTIONS' names.
    Null sessions are one session. An empty log gives no rows; other columns are ignored.

    Sessions are dealt to tasks and sorted, and each is folded as it streams by: a task holds the entries that can be undone or redone
    and an open batch, however long the session is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack, rows = None, None, []

        def settle(last: bool) -> None:
            rows.extend((now[0], seq, False) for seq in stack.settled)
            stack.settled = []
            if last:
                rows.extend((now[0], seq, True) for own in stack.undo for seq in own)
                rows.extend((now[0], seq, False) for seq in stack.batch or [])

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.bool_()))], names=["session", "seq", "undoable"])
            rows.clear()
            return out

        for batch in batches:
            for session, seq, action in zip(*(batch.column(c).to_pylist() for c in ("session", "seq", "action")), strict=True):
                if now is None or now[0] != session:
                    if now is not None:
                        settle(True)
                    now, stack = (session,), Stack(most)
                stack.step(action, seq)
            settle(False)
            yield made()
        if now is not None:
            settle(True)
            yield made()

    own = log.select(F.col("session").cast("bigint").alias("session"), F.col("seq").cast("bigint").alias("seq"), "action")
    dealt = own.repartition("session").sortWithinPartitions("session", "seq", "action")
    return dealt.mapInArrow(run, "session bigint, seq bigint, undoable boolean")
