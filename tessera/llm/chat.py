"""Chat formatting from event logs.

A log row is one event of a conversation: ``open`` starts a message with a role,
``delta`` adds text to it, ``edit`` replaces its text, ``regenerate`` empties it for
further deltas, ``retract`` drops it. Logs are dealt by conversation and sorted by
sequence; each task then folds them as they stream by and renders every message as it
is complete, so a task holds one message at a time, however long the conversation is.

Template: ``<turn ROLE>\\n`` text ``\\n</turn>\\n``. In texts and roles a backslash becomes
two, and a backslash goes before each ``<turn``, ``</turn`` and ``###``; in roles also
before ``>`` and newlines. Dropping the single backslashes gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENTS = ("open", "delta", "edit", "regenerate", "retract")
OPEN, END = "<turn ", "\n</turn>\n"
_CONTROL = re.compile(r"\\|<turn|</turn|###")
_ROLE_CONTROL = re.compile(r"\\|<turn|</turn|###|>|\n")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: Code points of a text that go into one delta of a log made from whole messages.
DELTA_CHARS = 2000


def escape(text: str, role: bool = False) -> str:
    return (_ROLE_CONTROL if role else _CONTROL).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> str:
    """One message as it stands in the formatted conversation."""
    return f"{OPEN}{escape(role, True)}>\n{escape(text)}{END}"



def read_back(formatted: str) -> list[tuple[str, int, int]]:
    """Roles of a formatted conversation, or of part of one between messages, and where their texts, still escaped, begin and end."""
    found, at = [], 0
    while at < len(formatted):
        head = formatted.index(">\n", at)
        while _open_escape(formatted, at, head):
            head = formatted.index(">\n", head + 1)
        # texts cannot hold an unescaped end mark, so the first one ends the turn
        end = formatted.index(END, head + 1)
        found.append((unescape(formatted[at + len(OPEN) : head]), head + 2, end))
        at = end + len(END)
    return found


def loss_mask(formatted: str, trained: str = "assistant") -> list[tuple[int, int]]:
    """The parts (begin, end) of a formatted conversation that a model is trained on: the texts of one role."""
    return [(begin, end) for role, begin, end in read_back(formatted) if role == trained]


def _open_escape(text: str, start: int, at: int) -> bool:
    """Whether the character at ``at`` is escaped: an odd number of backslashes stands before it."""
    n = at
    while n > start and text[n - 1] == "\\":
        n -= 1
    return (at - n) % 2 == 1


def log_of_messages(messages: DataFrame) -> DataFrame:
    """The event log of whole messages (conv_id, turn, role, text): an ``open`` and the text in deltas.

    Null roles and texts are empty. Rows of one turn keep the order of role and text, and
    repeated rows are messages of their own.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    deltas = F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{DELTA_CHARS}}}"), F.lit(0))  # one pass over a text of any length
    rows = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("_text"))
    rows = rows.groupBy("conv_id", "turn", "role", "_text").agg(F.count("*").alias("_n")).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    key = F.struct("turn", "role", F.md5("_text").alias("text"), F.col("_copy").alias("copy"))
    events = rows.select("conv_id", key.alias("message"), "role", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), deltas)).alias("part", "text"))
    return events.select("conv_id", F.struct("message", "part").alias("seq"), F.when(F.col("part") == 0, "open").otherwise("delta").alias("event"), F.when(F.col("part") == 0, F.col("role")).alias("role"), "text")


def fold(log: DataFrame, trained: str = "assistant", keep_text: bool = False) -> DataFrame:
    """Fold a log (conv_id, seq, event, role, text) into one row per conversation.

    ``seq`` may be of any sortable type; equal ones are folded in the order of event, role and
    text. Returns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    all read back from the rendered output, the loss through its mask; with keep_text formatted itself and
    ``loss_mask``, the parts (begin, end) of it that count (then a whole conversation is held in memory). Very long conversations and
    texts are streamed, one message held at a time. Events before any ``open`` and unknown events are skipped;
    null text adds nothing. A null conv_id is a conversation. An empty log gives no rows.
    """

    class Folded:
        def __init__(self, conv_id: int | None) -> None:
            self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
            self.turns_sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()
            self.role: str | None = None
            self.parts: list[str] = []
            self.formatted: list[str] = []
            self.mask: list[tuple[int, int]] = []

        def event(self, event: str, role: str | None, text: str | None) -> None:
            if event == "open":
                self.flush()
                self.role = role or ""
            if self.role is None:
                return
            if event in ("open", "edit", "regenerate"):
                self.parts = []
            if event in ("open", "delta", "edit") and text:
                self.parts.append(text)
            if event == "retract":
                self.role = None

        def flush(self) -> None:
            if self.role is None:
                return
            formatted = render(self.role, "".join(self.parts))
            mask = loss_mask(formatted, trained)
            if keep_text:
                self.formatted.append(formatted)
                self.mask += [(self.chars + begin, self.chars + end) for begin, end in mask]
            self.chars += len(formatted)
            for role, begin, end in read_back(formatted):
                self.turns += 1
                self.turns_sha.update(f"{role}\n{unescape(formatted[begin:end])}\n".encode())
            for begin, end in mask:
                text = unescape(formatted[begin:end])
                self.loss_chars += len(text)
                self.loss_sha.update(text.encode())
            self.role, self.parts = None, []

        def row(self) -> tuple:
            self.flush()
            row = (self.conv_id, self.turns, self.turns_sha.hexdigest(), self.loss_chars, self.loss_sha.hexdigest(), self.chars)
            return (*row, "".join(self.formatted), [{"begin": a, "end": b} for a, b in self.mask]) if keep_text else row

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", *["formatted", "loss_mask"] * keep_text]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), *[pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))] * keep_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for conv_id, event, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "event", "role", "text")), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = Folded(conv_id)
                now.event(event, role, text)
            if len(done) >= 500:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], pa.schema(list(zip(names, kinds, strict=True))))
                done = []
        if now is not None:
            done.append(now.row())
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], pa.schema(list(zip(names, kinds, strict=True))))

    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint" + ", formatted string, loss_mask array<struct<begin: bigint, end: bigint>>" * keep_text
    own = log.select(F.col("conv_id").cast("bigint").alias("conv_id"), "seq", "event", "role", "text")
    return own.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "event", "role", "text").select("conv_id", "event", "role", "text").mapInArrow(run, schema)


#: The query over whole messages in DuckDB, with the fixed conversation.
DIGEST_SQL = r"""
WITH message AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), part AS (
  SELECT *, length(regexp_replace(role, '(\\|<turn|</turn|###|>|\n)', '+\1', 'g')) + length(regexp_replace(text, '(\\|<turn|</turn|###)', '+\1', 'g')) + length('<turn >') + 1 + length('</turn>') + 2 AS chars FROM message
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, md5(text))) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, md5(text)) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM part GROUP BY conv_id
"""
