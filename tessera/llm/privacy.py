"""Personal data: base patterns, and a linear-chain conditional random field over word shapes.

Base patterns give the spans that are certain. The field, trained when a job starts from a
small labelled table of short phrases, tags words as part of an email, ip, card or phone
from their shapes and those of their neighbours, and so adds forms that the patterns miss,
such as ``ann [at] example.org`` or ``tel. 0171 555 0199``. It reads every line of every text, whole;
words and pairs of shapes are scored once and remembered, and the lines of a batch are decoded together by Viterbi in numpy.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices, small_batches

#: Words remembered by a task, and words that are decoded at a time.
_REMEMBERED, _WORDS = 500_000, 300_000
KINDS = ("email", "ip", "card", "phone")
TAGS = ("none", *KINDS)

# Each pattern is tried once at a run of its characters, so that long runs take time in proportion.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"\S+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, from each @ outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        local = len(before) - len(before.rstrip(_LOCAL))
        host = _HOST.match(text, at + 1) if local else None
        done = host.end() if host else at + 1
        if host:
            yield at - local, done
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _byte_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Certain spans (kind, start, end) in code points, by kind as listed and then start."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", *span) for span in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_byte_part, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


# ---- the labelled table -------------------------------------------------------------------


def labelled_table() -> list[list[tuple[str, str]]]:
    """Short phrases of (word, tag), spelled out by rule from a few forms of each kind and of look-alikes."""
    names, hosts = ("ann", "j.doe", "maria_9", "info"), ("example.org", "mail3.example.com", "uni-x.edu")
    forms: list[list[tuple[str, str]]] = []

    def add(kind: str, *phrases: str) -> None:
        for lead, tail in (("", ""), ("call or write", "today"), ("see", "and"), ("the", ".")):
            forms.extend([*((w, "none") for w in lead.split()), *((w, kind) for w in p.split()), *((w, "none") for w in tail.split())] for p in phrases)

    for i, name in enumerate(names):
        host = hosts[i % len(hosts)]
        add("email", f"{name}@{host}", f"{name} [at] {host}", f"{name} (at) {host}", f"{name}[at]{host}", f"{name}(at){host}", f"{name} at {host.replace('.', ' dot ')}", f"{name} [at] {host.replace('.', ' [dot] ')}")
    for ip in ("10.0.0.1", "192.168.17.4", "8.8.8.8", "203.0.113.77", "151.7.220.45"):
        add("ip", ip)
    for card in ("4111 1111 1111 1111", "5500-0000-0000-0004", "4012888888881881", "3782 8224 6310 0005 4", "6011000990139424"):
        add("card", card)
    for phone in ("+1 (974) 555-3436", "+44 20 7946 0958", "+49 171 5550199", "(212) 555-0187", "+33.1.55.50.12.34"):
        add("phone", phone)
    for cue in ("tel.", "phone:", "tel:", "call", "fax", "telefon", "mobile:", "ring me on"):
        for number in ("0171 555 0199", "555-0187-33", "020 7946 0958", "212.555.0187", "0171/5550199", "07700 900123", "5550187"):
            forms.append([("my", "none"), *((w, "none") for w in cue.split()), *((w, "phone") for w in number.split()), ("please", "none")])
    add("none", "he sat at home", "look at this dot here", "all of it", "nothing at all")
    add("none", "12 of 40", "in 1999", "3.14", "v2.10.4", "2024-05-17", "12:30", "1,200.50 euro", "page 7", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "order 20240517 item 3", "@home", "meet @ noon", "(at) last", "sat at home", "10 000 people", "1914-1918", "abc123", "5%", "16 17 18 19", "555 of 1000", "978-3-16-148410-0", "in 07700 of 900123", "from 1200 to 900123", "isbn 5550187")
    return forms


# ---- the field ----------------------------------------------------------------------------

_CUES = frozenset("tel tel. tel: phone phone: call fax fax: telefon telefon: mobile mobile: teléfono tél. on ring number reach".split())


def shape(word: str) -> str:
    """Runs of digits with their length, runs of letters, and the marks as they are."""
    low = word.lower().rstrip(",;!?\"'")
    if low in _CUES:
        return "CUE"
    if low in ("at", "dot", "[at]", "(at)", "[dot]", "(dot)"):
        return low
    out, i = [], 0
    low = low.rstrip(".")
    if low.isalpha():
        return "a"
    while i < len(low):
        c, j = low[i], i + 1
        if "0" <= c <= "9":
            while j < len(low) and "0" <= low[j] <= "9":
                j += 1
            n = j - i
            out.append("d" if n <= 3 else "dd" if n <= 6 else "ddd" if n <= 12 else "dddd" if n <= 19 else "ddddd")
        elif c.isalpha() or c == "_":
            while j < len(low) and (low[j].isalpha() or low[j] == "_"):
                j += 1
            out.append("at" if low[i:j] == "at" and i and low[i - 1] in "[(" else "a")
        else:
            out.append(c)
        i = j
    return "".join(out)


def _own_traits(word: str, name: str) -> list[str]:
    """Traits of a word of that shape that do not depend on its neighbours."""
    n = sum("0" <= c <= "9" for c in word)
    return ["bias", f"s={name}", f"digits={min(n, 20) // 2}", f"at={'@' in word or '[at]' in word or '(at)' in word}", f"plus={word.startswith('+')}", f"alpha={name == 'a'}"]


def _traits(words: list[str]) -> list[list[str]]:
    shapes = ["<", *map(shape, words), ">"]
    out = []
    for i, word in enumerate(words):
        s, before, after = shapes[i + 1], shapes[i], shapes[i + 2]
        out.append([*_own_traits(word, s), f"p={before}", f"n={after}", f"sp={before}|{s}", f"sn={s}|{after}"])
    return out


class Field:
    """Weights of traits and of tag pairs."""

    def __init__(self, traits: dict[str, int], weights: np.ndarray, pairs: np.ndarray) -> None:
        self.traits, self.weights, self.pairs = traits, weights, pairs

    def emissions(self, words: list[str]) -> np.ndarray:
        return np.stack([self.weights[[self.traits[x] for x in own if x in self.traits]].sum(0) for own in _traits(words)])

    def decode(self, phrases: list[list[str]]) -> list[np.ndarray]:
        """The best tags of each phrase."""
        return _Reader(self).decode(phrases)


def viterbi(scores: np.ndarray, lengths: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The best tags of sequences that stand one after the other, all of them a step at a time, the longest first."""
    first = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    first, lengths = first[order], lengths[order]
    live = np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0))), side="left")  # how many are longer than t
    back, tags = np.zeros(scores.shape, np.int8), np.zeros(len(scores), np.int8)
    best = scores[first[: live[0]]] if len(live) else scores
    for t in range(1, len(live)):
        at = first[: live[t]] + t
        step = best[: live[t], :, None] + pairs
        back[at] = step.argmax(1)
        best[: live[t]] = step.max(1) + scores[at]
    last = best.argmax(1)
    for t in range(len(live) - 1, -1, -1):
        ends = live[t + 1] if t + 1 < len(live) else 0
        at = first[: live[t]] + t
        tag = last[: live[t]].copy()
        if ends:
            tag[:ends] = back[at[:ends] + 1, tags[at[:ends] + 1]]
        tags[at] = tag
    return tags


class _Reader:
    """A field at work: words by class, each class with its shape and its own score, and pairs of shapes with theirs.

    Words of one class have the same traits of their own, so a class is scored once, however many words it has.
    """

    def __init__(self, field: Field) -> None:
        self.field, self.words, self.shapes = field, {}, {}
        self.classes: dict[tuple, int] = {}
        self.shape_of, self.own = np.zeros(1 << 8, np.int64), np.zeros((1 << 8, len(TAGS)))
        self.names: list[str] = []
        self.pairs: dict[tuple[int, int], np.ndarray] = {}
        self.edges = self._shape("<"), self._shape(">")

    def _weight(self, trait: str) -> np.ndarray:
        at = self.field.traits.get(trait)
        return self.field.weights[at] if at is not None else np.zeros(len(TAGS))

    def _shape(self, name: str) -> int:
        found = self.shapes.setdefault(name, len(self.shapes))
        if found == len(self.names):
            self.names.append(name)
        return found

    def _number(self, word: str) -> int:
        """The class of a word that is not yet known."""
        name = shape(word)
        kind = "a" if name == "a" else tuple(_own_traits(word, name))  # of that shape are letters and marks at their end only
        at = self.words[word] = self.classes.setdefault(kind, count := len(self.classes))
        if at == count:
            if at == len(self.own):
                self.own, self.shape_of = np.concatenate((self.own, self.own)), np.concatenate((self.shape_of, self.shape_of))
            self.shape_of[at] = self._shape(name)
            self.own[at] = sum(map(self._weight, _own_traits(word, name)), np.zeros(len(TAGS)))
        return at

    def _pair(self, a: int, b: int) -> np.ndarray:
        """What shape b after shape a adds, for the word of b and for that of a."""
        found = self.pairs.get((a, b))
        if found is None:
            a_, b_ = self.names[a], self.names[b]
            found = self.pairs[a, b] = np.stack((self._weight(f"p={a_}") + self._weight(f"sp={a_}|{b_}"), self._weight(f"n={b_}") + self._weight(f"sn={a_}|{b_}")))
        return found

    def tags(self, lines: list[list[str]]) -> np.ndarray:
        """Tags of the words of all lines, one after the other; no line is empty."""
        known = self.words
        if len(known) > _REMEMBERED:
            known.clear()
        ids = np.asarray([known[w] if w in known else self._number(w) for line in lines for w in line], np.int64)
        lengths = np.asarray([len(line) for line in lines], np.int64)
        shapes, scores = self.shape_of[ids], self.own[ids]
        end = np.cumsum(lengths)
        before, after = np.empty_like(shapes), np.empty_like(shapes)
        before[1:], after[:-1] = shapes[:-1], shapes[1:]
        before[end - lengths], after[end - 1] = self.edges
        count = len(self.names)
        for one, two, k in ((before, shapes, 0), (shapes, after, 1)):
            codes, inverse = np.unique(one * count + two, return_inverse=True)
            scores += np.stack([self._pair(int(c) // count, int(c) % count)[k] for c in codes])[inverse]
        return viterbi(scores, lengths, self.field.pairs)

    def decode(self, lines: list[list[str]]) -> list[np.ndarray]:
        """Tags of each line; lines are taken ``_WORDS`` words at a time, or one longer one alone."""
        out: list[np.ndarray] = []
        held: list[list[str]] = []
        size = 0
        for i, line in enumerate(lines):
            held.append(line)
            size += len(line)
            if size >= _WORDS or i + 1 == len(lines):
                worded = [x for x in held if x]
                parts = iter(np.split(self.tags(worded), np.cumsum([len(x) for x in worded])[:-1]) if worded else ())
                out += [next(parts) if x else np.zeros(0, np.int8) for x in held]
                held, size = [], 0
        return out


def train(table: list[list[tuple[str, str]]] | None = None, steps: int = 150, rate: float = 0.5, ridge: float = 1e-3) -> Field:
    """Maximise the conditional likelihood by gradient steps with momentum, the phrases of a length at a time."""
    table = table or labelled_table()
    names: dict[str, int] = {}
    for phrase in table:
        for own in _traits([w for w, _ in phrase]):
            for x in own:
                names.setdefault(x, len(names))
    k, m = len(TAGS), len(names)
    groups = []
    for n in sorted({len(p) for p in table}):
        own = [p for p in table if len(p) == n]
        ids = np.asarray([[[names[x] for x in t] for t in _traits([w for w, _ in p])] for p in own])
        groups.append((ids, np.asarray([[TAGS.index(t) for _, t in p] for p in own])))
    weights, pairs = np.zeros((m, k)), np.zeros((k, k))
    speed_w, speed_p = np.zeros_like(weights), np.zeros_like(pairs)
    log_sum = lambda x, axis: (top := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - top).sum(axis))
    for _ in range(steps):
        grad_w, grad_p = -ridge * len(table) * weights, -ridge * len(table) * pairs
        for ids, gold in groups:
            b, n = gold.shape
            e = weights[ids].sum(2)
            forward, backward = np.zeros((b, n, k)), np.zeros((b, n, k))
            forward[:, 0] = e[:, 0]
            for t in range(1, n):
                forward[:, t] = e[:, t] + log_sum(forward[:, t - 1, :, None] + pairs, 1)
            for t in range(n - 2, -1, -1):
                backward[:, t] = log_sum(pairs + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            whole = log_sum(forward[:, -1], 1)[:, None]
            delta = np.eye(k)[gold] - np.exp(forward + backward - whole[..., None])
            np.add.at(grad_w, ids.reshape(b * n, -1), np.broadcast_to(delta.reshape(b * n, 1, k), (b * n, ids.shape[2], k)))
            for t in range(1, n):
                joint = np.exp(forward[:, t - 1, :, None] + pairs + (e[:, t] + backward[:, t])[:, None, :] - whole[..., None])
                np.add.at(grad_p, (gold[:, t - 1], gold[:, t]), 1)
                grad_p -= joint.sum(0)
        speed_w, speed_p = 0.9 * speed_w + grad_w / len(table), 0.9 * speed_p + grad_p / len(table)
        weights, pairs = weights + rate * speed_w, pairs + rate * speed_p
    return Field(names, weights, pairs)


_EDGE = "\"'.,;:!?<>{}|*#"


_SPELT = re.compile(r"[\w.%+-]+\s*(?:@|[\[(]at[\])])\s*[\w-]+(?:\s*(?:\.|[\[(]dot[\])])\s*[\w-]+)+|[\w.%+-]+ at [\w-]+(?: dot [\w-]+)+", re.IGNORECASE)


def _valid(kind: str, text: str) -> bool:
    """Whether a span that the field gives has the form of its kind; an email may be spelt with at and dot."""
    n = len(_digits(text))
    if kind == "email":
        return _SPELT.fullmatch(text) is not None
    if kind == "ip":
        return len(parts := text.split(".")) == 4 and all(p.isascii() and p.isdigit() and _byte_part(p) for p in parts)
    if kind == "card":
        return 13 <= n <= 19 and luhn(_digits(text))
    return 7 <= n <= 15


def lines_of(text: str) -> list[tuple[list[str], int]]:
    """The words of each line that has any, and where the line begins."""
    out, at = [], 0
    for line in text.split("\n"):
        if own := line.split():
            out.append((own, at))
        at += len(line) + 1
    return out


def added_spans(text: str, tagged: list[tuple[int, np.ndarray]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the field that are well-formed and touch no base span: runs of one tag in the line that begins there, edge marks trimmed."""
    taken = sorted((a, b) for _, a, b in base)
    found = []
    for begin, tags in tagged:
        end = text.find("\n", begin)
        places = [m.span() for m in _WORD.finditer(text, begin, end if end >= 0 else len(text))]
        i = 0
        while i < len(tags):
            j = i + 1
            while j < len(tags) and tags[j] == tags[i]:
                j += 1
            if tags[i]:
                a, b = places[i][0], places[j - 1][1]
                while a < b and text[a] in _EDGE:
                    a += 1
                while b > a and text[b - 1] in _EDGE:
                    b -= 1
                near = bisect_left(taken, (b, b))  # base spans from here on begin at b or later
                if a < b and _valid(TAGS[tags[i]], text[a:b]) and not any(a < y for _, y in taken[max(0, near - len(KINDS)) : near]):
                    found.append((TAGS[tags[i]], a, b))
            i = j
    return found


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Personal data of every whole text.

    Returns doc_id, the base spans' counts n_email, n_ip, n_card and n_phone, base_sha256 over
    the base spans, and spans: base spans and those that the field adds. Null and empty texts
    have none. Very long texts and lines are read whole; time and memory are in proportion to them. Of tags that
    score alike the first listed is taken. Repeated rows are judged alike; an empty table gives no rows; extra columns are
    ignored, whatever they are called.
    """
    small_batches(docs.sparkSession)
    field = field or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(field)
        for whole in batches:
            for batch in slices(whole):
                texts = [x or "" for x in batch.column("text").to_pylist()]
                parts = [lines_of(x) for x in texts]
                tags = iter(reader.decode([words for part in parts for words, _ in part]))
                out: list[list] = [[] for _ in range(6)]
                for text, part in zip(texts, parts, strict=True):
                    base = base_spans(text)
                    read = [(begin, next(tags)) for _, begin in part]
                    more = added_spans(text, [x for x in read if x[1].any()], base)
                    for i, kind in enumerate(KINDS):
                        out[i].append(sum(k == kind for k, _, _ in base))
                    out[4].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                    out[5].append(_joined(base + more))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")
