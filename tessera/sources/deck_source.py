"""Decks as a Spark data source: ``spark.read.format("deck")`` and ``df.write.format("deck")``.

A deck is a text file, or a folder of numbered part files with a manifest, ``_deck.json``, that
says their order; a folder without one holds a deck in each file. A deck is read in ranges of bytes. Each range
finds the keyword that holds where it begins by reading backwards, or takes it from the manifest at
a part's beginning, so sections may run over ranges and parts and no line is shuffled. The option ``kinds`` is for
the reader: lines of other kinds are never handed to Spark. (Filters aren't taken from the plan: Spark keeps one reader for a
loaded DataFrame, so two filters on it would meet in one.)

Writing expects lines in the order of their place, dealt to tasks by ranges of it. Each attempt of a task writes a file
of its own; the commit puts the files of the attempts that count in order, numbers them and replaces the manifest last, so that
readers see the old deck or the new one; abort removes what was written.

Paths are local ones or URIs of file systems that pyarrow opens. Where only Spark's readers reach a path,
``tessera.sources.deck.read_lines`` reads the same lines.
"""

from __future__ import annotations

import fnmatch
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tessera.sources.cards import KINDS

MANIFEST = "_deck.json"
#: Bytes of a range, and of a block that is read at a time.
RANGE_BYTES, BLOCK_BYTES = 64 << 20, 4 << 20
SCHEMA = "file string, line_no bigint, line string, section bigint, keyword string, kind string"
_KIND = [(name, re.compile(kind.keyword)) for name, kind in KINDS.items()]


def kind_of(keyword: str) -> str | None:
    """The kind whose pattern an upper-cased keyword fits."""
    return next((name for name, pattern in _KIND if pattern.search(keyword)), None)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


@dataclass
class Part:
    """A file of a deck, where its bytes begin in the deck, and the keyword that holds there (section, keyword), if that is known."""

    path: str
    size: int
    begin: int = 0
    head: tuple[int, str] | None = None
    known: bool = False


@dataclass
class Range(InputPartition):
    """Lines of a deck that begin in [begin, end) of its last part; the parts before are there to read backwards."""

    deck: str
    parts: list[Part]
    begin: int
    end: int


def decks(path: str) -> list[tuple[str, list[Part]]]:
    """Name and parts of every deck at a path, which may end in a pattern. FileNotFoundError if there is none."""
    store, at = _opened(path)
    base, _, last = at.rpartition("/")
    if any(c in last for c in "*?["):
        files = sorted((x.path, x.size) for x in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, last))
        if not files:
            raise FileNotFoundError(f"no deck fits {path}")
        return [(p, [Part(p, n)]) for p, n in files]
    found = store.get_file_info(at)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"there is no deck at {path}")
    if found.type == fs.FileType.File:
        return [(at, [Part(at, found.size)])]
    if store.get_file_info(f"{at}/{MANIFEST}").type == fs.FileType.File:
        return [(at, _listed(store, at))]
    files = sorted((x.path, x.size) for x in store.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File and x.base_name[0] not in "_.")
    return [(p, [Part(p, n)]) for p, n in files]


def _listed(store: fs.FileSystem, at: str) -> list[Part]:
    with store.open_input_stream(f"{at}/{MANIFEST}") as f:
        listed = json.loads(f.read())["parts"]
    out, begin = [], 0
    for x in listed:
        out.append(Part(f"{at}/{x['name']}", x["bytes"], begin, tuple(x["head"]) if x["head"] else None, True))
        begin += x["bytes"]
    return out


def _head_before(store: fs.FileSystem, parts: list[Part], at: int) -> tuple[int, str] | None:
    """Place and text of the last keyword line that begins before a place of the last part."""
    for part in reversed(parts):
        with store.open_input_file(part.path) as f:
            stop = at if part is parts[-1] else part.size
            tail = b""
            while stop > 0:
                start = max(0, stop - BLOCK_BYTES)
                block = f.read_at(stop - start, start) + tail
                found = block.rfind(b"\n*", 0, stop - start + 1) + 1
                if not found and start == 0 and block[:1] == b"*":
                    return part.begin, _line_at(f, 0)
                if found:
                    return part.begin + start + found, _line_at(f, start + found)
                stop, tail = start, block[:1]
        if part.known:
            return part.head
    return None


def _line_at(f: pa.NativeFile, at: int) -> str:
    line = b""
    while b"\n" not in line:
        more = f.read_at(4096, at + len(line))
        if not more:
            break
        line += more
    return _keyword(line.partition(b"\n")[0])


def _keyword(line: bytes) -> str:
    return line.decode(errors="replace").strip().upper()


def _blocks(f: pa.NativeFile, begin: int, end: int, size: int) -> Iterator[tuple[int, list[bytes]]]:
    """Lines that begin in [begin, end) of a file, some at a time, with the place of the first."""
    if begin:
        begin -= 1
        held = f.read_at(min(BLOCK_BYTES, size - begin), begin)
        while (cut := held.find(b"\n")) < 0 and begin + len(held) < size:
            held += f.read_at(min(BLOCK_BYTES, size - begin - len(held)), begin + len(held))
        begin = begin + cut + 1 if cut >= 0 else size
    while begin < min(end, size):
        held = f.read_at(min(BLOCK_BYTES, size - begin), begin)
        while (cut := held.rfind(b"\n")) < 0 and begin + len(held) < size:
            held += f.read_at(min(BLOCK_BYTES, size - begin - len(held)), begin + len(held))
        whole = held if begin + len(held) >= size else held[: cut + 1]
        if begin + len(whole) > end:  # the line that the end falls into is the last
            stop = whole.find(b"\n", end - begin - 1)
            whole = whole if stop < 0 else whole[: stop + 1]
        yield begin, (whole[:-1] if whole.endswith(b"\n") else whole).split(b"\n")
        begin += len(whole)


class DeckReader(DataSourceReader):
    """Data lines with their section and kind; kinds that aren't asked for are left out as they are read."""

    def __init__(self, options: dict) -> None:
        if "path" not in options:
            raise ValueError("load(path) says where the deck is")
        self.path, self.bytes = options["path"], int(options.get("range_bytes", RANGE_BYTES))
        self.kinds: set[str] | None = {x.strip() for x in options["kinds"].split(",") if x.strip()} if "kinds" in options else None
        if self.kinds and (unknown := self.kinds - set(KINDS)):
            raise ValueError(f"no such kinds: {sorted(unknown)}")

    def partitions(self) -> list[Range]:
        out = []
        for name, parts in decks(self.path):
            for i, part in enumerate(parts):
                before = parts[i : i + 1] if part.known else parts[: i + 1]
                out += [Range(name, before, a, min(a + self.bytes, part.size)) for a in range(0, part.size, self.bytes)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(self.path)
        part, head = partition.parts[-1], None
        names: dict[str, str | None] = {}
        with store.open_input_file(part.path) as f:
            for at, lines in _blocks(f, partition.begin, partition.end, part.size):
                if head is None:
                    head = _head_before(store, partition.parts, at) or (-1, "")
                sizes = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
                place = part.begin + at + np.concatenate(([0], np.cumsum(sizes)[:-1]))
                stars = np.asarray([i for i, x in enumerate(lines) if x[:1] == b"*"], np.int64)
                heads = [head, *((int(place[i]), _keyword(lines[i])) for i in stars.tolist())]
                owner = np.searchsorted(stars, np.arange(len(lines)), "right")
                kinds = [names.setdefault(k, kind_of(k)) for _, k in heads]
                wanted = np.asarray([bool(k) and (self.kinds is None or kinds[i] in self.kinds) for i, (_, k) in enumerate(heads)])[owner]
                wanted[stars] = False
                chosen = np.flatnonzero(wanted)
                text = pc.utf8_rtrim(pa.array([lines[i].decode(errors="replace") for i in chosen.tolist()], pa.string()), " \r")
                data = pc.invert(pc.or_(pc.starts_with(text, "$"), pc.equal(pc.utf8_trim(text, " "), "")))
                own = owner[chosen]
                columns = [pa.array([partition.deck] * len(chosen), pa.string()), pa.array(place[chosen]), text, pa.array(np.asarray([p for p, _ in heads])[own]), pa.array([heads[i][1] for i in own.tolist()], pa.string()), pa.array([kinds[i] for i in own.tolist()], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "line_no", "line", "section", "keyword", "kind"]).filter(data)
                head = heads[-1]


@dataclass
class Written(WriterCommitMessage):
    """What one attempt of a task wrote: the file, its first and last place, its bytes, and its last keyword (place in the file, text)."""

    path: str = ""
    first: tuple = ()
    last: tuple = ()
    bytes: int = 0
    head: tuple[int, str] | None = field(default=None)


class DeckWriter(DataSourceArrowWriter):
    """Lines (``line``, and ``section`` and ``item``, their place) into one ordered deck."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        if "line" not in schema.names:
            raise ValueError("a deck is written from a column line")
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.place = [c for c in ("section", "item") if c in schema.names]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, at = _opened(self.path)
        folder = f"{at}/_writing-{self.job}"
        store.create_dir(folder, recursive=True)
        out = Written(f"{folder}/{uuid.uuid4().hex}")
        with store.open_output_stream(out.path) as f:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                places = list(zip(*(batch.column(c).to_pylist() for c in self.place), strict=True)) or [()] * batch.num_rows
                ends = places[0], places[-1]
                if any(a > b for a, b in zip([out.last or ends[0], *places], places, strict=False)):
                    raise ValueError("lines aren't in the order of their place")
                out.first, out.last = out.first or ends[0], ends[1]
                lines = [(x or "").encode() for x in batch.column("line").to_pylist()]
                for i in range(len(lines) - 1, -1, -1):
                    if lines[i][:1] == b"*":
                        out.head = (out.bytes + sum(len(x) + 1 for x in lines[:i]), _keyword(lines[i]))
                        break
                whole = b"\n".join(lines) + b"\n"
                f.write(whole)
                out.bytes += len(whole)
        return out

    def commit(self, messages: list[Written | None]) -> None:
        store, at = _opened(self.path)
        store.create_dir(at, recursive=True)
        new = sorted((m for m in messages if m and m.bytes), key=lambda m: m.first)
        for a, b in zip(new, new[1:], strict=False):
            if a.last > b.first:
                raise ValueError("tasks hold lines of the same places; deal them by ranges first")
        known = store.get_file_info(f"{at}/{MANIFEST}").type == fs.FileType.File
        old = _listed(store, at) if known else []
        kept = [] if self.overwrite else old
        parts = [{"name": p.path.rpartition("/")[2], "bytes": p.size, "head": p.head} for p in kept]
        begin = sum(p.size for p in kept)
        head = _head_before(store, kept, kept[-1].size) if kept else None
        for m in new:
            name = f"part-{len(parts):05d}-{self.job[:8]}.k"
            store.move(m.path, f"{at}/{name}")
            parts.append({"name": name, "bytes": m.bytes, "head": head})
            head = (begin + m.head[0], m.head[1]) if m.head else head
            begin += m.bytes
        with store.open_output_stream(f"{at}/{MANIFEST}.{self.job}") as f:
            f.write(json.dumps({"parts": parts}).encode())
        store.move(f"{at}/{MANIFEST}.{self.job}", f"{at}/{MANIFEST}")
        for p in old if self.overwrite else []:
            store.delete_file(p.path)
        self._clear(store, at)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_opened(self.path))

    def _clear(self, store: fs.FileSystem, at: str) -> None:
        """Remove what attempts wrote and no part is of."""
        if store.get_file_info(f"{at}/_writing-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/_writing-{self.job}")


class DeckSource(DataSource):
    """The format ``deck``. Options for reading: kinds, a list with commas; range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "deck"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DeckReader:
        return DeckReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DeckWriter:
        return DeckWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(DeckSource)


def load(spark: SparkSession, path: str, kinds: list[str] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Data lines of the decks at a path, of some kinds or of all; FileNotFoundError if there is none."""
    register(spark)
    decks(path)
    reader = spark.read.format("deck").option("range_bytes", range_bytes)
    return (reader if kinds is None else reader.option("kinds", ",".join(kinds))).load(path)
