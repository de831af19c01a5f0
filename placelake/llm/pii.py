"""Personal data by candidate gradient boosting.

Generators of high recall propose spans, which may overlap: whatever could be an address, number or
secret in some spelling. Those that fit the strict forms (``base``) always stay. Of the others boosted
trees judge form and context; a span is taken from the threshold of its kind on, if it overlaps no better
one. The trees are fitted on values of our own making, good and bad, planted in contexts from the corpus.
"""

from __future__ import annotations

import bisect
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelake.llm import bytehash as bh
from placelake.llm.boosting import Boosted, Calibration, threshold
from placelake.llm.shared import byte_arrays, chunks

KINDS = ("email", "ip", "card", "phone", "secret")
SAMPLE_DOCS = 2000
"""Documents, those of the smallest hashes of doc_id, that give contexts to plant values in."""
CONTEXTS = 2000
"""At most so many contexts are used, those of the smallest hashes."""
PLANTED = 6000
PRECISION = 0.97
BEFORE, AFTER = 48, 24
"""Bytes of a context."""


def _class(*ranges: str) -> np.ndarray:
    out = np.zeros(256, bool)
    for r in ranges:
        out[ord(r[0]) : ord(r[-1]) + 1] = True
    return out


_DIGIT, _UPPER, _LOWER = _class("09"), _class("AZ"), _class("az")
_ALNUM = _DIGIT | _UPPER | _LOWER
_LOCAL = _ALNUM | _class(".") | _class("_") | _class("%") | _class("+") | _class("-")
_TOKEN = _ALNUM | _class("_") | _class("+") | _class("/") | _class("-")
_NEAR = _class(" ") | _class("(") | _class(")") | _class(".") | _class("-")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_SPELLED = re.compile(rb"[\])}]? ?[A-Za-z0-9-]{1,63}(?: ?[\[({]? ?(?:dot|DOT|\.) ?[\])}]? ?[A-Za-z0-9-]{1,63}){1,4}")
_KEYED = re.compile(rb"(?i)(?:pass(?:word|wd)?|pwd|token|secret|api[_-]?key|auth|credential|key)[\"']? {0,2}$")
_VALUE = re.compile(rb" {0,2}[\"']?([^\s\"']{8,200})")
# Words before a value that tell its kind, a group per feature.
_HINTS = tuple(re.compile(p) for p in (rb"(?i)pass|pwd|token|secret|key|auth|credential", rb"(?i)tel|phone|call|mobile|fax|cell", rb"(?i)mail|contact|write", rb"(?i)card|visa|credit|payment|amex", rb"(?i)\bip\b|host|server|addr", rb"(?i)version|isbn|order|id\b|no\.|date|on "))


@dataclass(frozen=True, slots=True)
class Span:
    kind: int
    start: int
    end: int
    base: bool


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = (c - 48) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _small(part: bytes) -> bool:
    """Whether digits are at most 255."""
    part = part.lstrip(b"0")
    return len(part) < 3 or len(part) == 3 and part <= b"255"


def _digits(part: bytes) -> bytes:
    return part.translate(None, b" ().-+")


def propose(data: np.ndarray, offsets: np.ndarray) -> dict[int, list[Span]]:
    """The spans of all generators by row, as places in ``data``; strict ones are marked ``base``."""
    out: dict[int, list[Span]] = {}
    buf = data.tobytes()
    row_of = lambda at: int(np.searchsorted(offsets, at, "right") - 1)

    def add(row: int, kind: int, start: int, end: int, base: bool = False) -> None:
        out.setdefault(row, []).append(Span(kind, start, end, base))

    # runs of digits, and what joins each to the next
    start, end = bh.spans(_DIGIT[data], offsets)
    size = end - start
    row = np.searchsorted(offsets, start, "right") - 1
    gap = start[1:] - end[:-1]
    same = row[1:] == row[:-1]
    between = data[np.minimum(end[:-1], max(0, len(data) - 1))] if len(start) else data[:0]
    near = np.concatenate([[0], np.cumsum(_NEAR[data])])
    joins = {
        "card": same & (gap == 1) & ((between == 0x20) | (between == 0x2D)),
        "dot": same & (gap == 1) & (between == 0x2E),
        "near": same & (gap <= 3) & (near[start[1:]] - near[end[:-1]] == gap),
    }

    def chains(join: np.ndarray, least_digits: int, least_runs: int = 1) -> Iterator[tuple[int, int]]:
        if len(start):
            first = np.flatnonzero(np.concatenate([[True], ~join]))
            stop = np.append(first[1:], len(start))
            good = (np.add.reduceat(size, first) >= least_digits) & (stop - first >= least_runs)
            yield from zip(first[good].tolist(), stop[good].tolist(), strict=True)

    def windows(first: int, stop: int, least: int, most: int, runs: int) -> Iterator[tuple[int, int]]:
        for i in range(first, stop):
            n = 0
            for j in range(i, min(stop, i + runs)):
                n += int(size[j])
                if n > most:
                    break
                if n >= least:
                    yield i, j

    for first, stop in chains(joins["card"], 13):
        s, e = int(start[first]), int(end[stop - 1])
        if size[first:stop].sum() <= 19 and luhn(_digits(buf[s:e])):
            add(int(row[first]), 2, s, e, True)
    for first, stop in chains(joins["card"] | joins["dot"], 13):
        for i, j in windows(first, stop, 13, 19, 19):
            add(int(row[i]), 2, int(start[i]), int(end[j]))
    for first, stop in chains(joins["dot"], 4, 4):
        for i in range(first, stop - 3):
            if all(_small(buf[start[k] : end[k]]) for k in range(i, i + 4)):
                add(int(row[i]), 1, int(start[i]), int(end[i + 3]), (i - first) % 4 == 0)
    for first, stop in chains(joins["near"], 9):
        for i, j in windows(first, stop, 9, 15, 6):
            s = int(start[i])
            s -= s > offsets[row[i]] and buf[s - 1 : s] in (b"(", b"+")
            s -= s > offsets[row[i]] and buf[s : s + 1] == b"(" and buf[s - 1 : s] == b"+"
            add(int(row[i]), 3, s, int(end[j]))

    for at in np.flatnonzero(data == 0x2B).tolist():
        r = row_of(at)
        if (m := _PHONE.match(buf, at, int(offsets[r + 1]))) and 9 <= len(_digits(m[0])) <= 15:
            add(r, 3, at, m.end(), True)

    ats = np.flatnonzero(data == 0x40)
    if len(ats):
        outside = np.maximum.accumulate(np.where(_LOCAL[data], -1, np.arange(len(data))))
        done = 0
        for at in ats.tolist():
            r = row_of(at)
            first = max(int(outside[at - 1]) + 1 if at else 0, int(offsets[r]), done)
            m = _DOMAIN.match(buf, at + 1, int(offsets[r + 1]))
            if m and first < at:
                add(r, 0, first, m.end(), True)
                done = m.end()
            else:  # blanks around the sign
                s = at - 1 if at - 1 >= offsets[r] and buf[at - 1] == 0x20 else at
                t = at + 2 if buf[at + 1 : at + 2] == b" " else at + 1
                first = max(int(outside[s - 1]) + 1 if s else 0, int(offsets[r]))
                if first < s and (m := _DOMAIN.match(buf, t, int(offsets[r + 1]))):
                    add(r, 0, first, m.end())
    if len(data) > 4:
        opens, closes = _class(" ") | _class("(") | _class("[") | _class("{"), _class(" ") | _class(")") | _class("]") | _class("}")
        spelled = np.flatnonzero(opens[data[:-3]] & ((data[1:-2] | 32) == 0x61) & ((data[2:-1] | 32) == 0x74) & closes[data[3:]])
        for at in spelled.tolist():  # "name at host dot org"
            r = row_of(at + 1)
            m = _SPELLED.match(buf, at + 3, int(offsets[r + 1]))
            s = at
            while s > offsets[r] and buf[s] == 0x20:
                s -= 1
            s += buf[s] not in b" ([{"
            e = s
            while s > offsets[r] and _LOCAL[buf[s - 1]] and e - s < 64:
                s -= 1
            if m and s < e:
                add(r, 0, s, m.end())

    start, end = bh.spans(_TOKEN[data], offsets)
    long_ = end - start >= 16
    start, end = start[long_], end[long_]
    if len(start):
        digits, letters = (np.concatenate([[0], np.cumsum(c[data])]) for c in (_DIGIT, _UPPER | _LOWER))
        mixed = (digits[end] - digits[start] >= 2) & (letters[end] - letters[start] >= 2)
        for s, e in zip(start[mixed].tolist(), end[mixed].tolist(), strict=True):
            add(row_of(s), 4, s, e)
    for at in np.flatnonzero((data == 0x3D) | (data == 0x3A)).tolist():
        r = row_of(at)
        if _KEYED.search(buf, max(int(offsets[r]), at - 24), at) and (m := _VALUE.match(buf, at + 1, int(offsets[r + 1]))):
            add(r, 4, *m.span(1))
    return {r: sorted(set(spans), key=lambda x: (x.kind, x.start, x.end, not x.base)) for r, spans in out.items()}


def features(buf: bytes, first: int, last: int, x: Span) -> list[float]:
    """Of a span in the text ``buf[first:last]``: its form, then its context."""
    value = buf[x.start : x.end]
    array = np.frombuffer(value, np.uint8)
    digits, upper, lower = (float(c[array].sum()) for c in (_DIGIT, _UPPER, _LOWER))
    groups = [len(g) for g in re.findall(rb"[0-9]+", value)]
    counts = np.bincount(array)
    share = counts[counts > 0] / len(array)
    kinds = _DIGIT[array].astype(np.int8) + 2 * (_UPPER | _LOWER)[array]
    number = _digits(value) if x.kind in (2, 3) else b""
    before, after = buf[max(first, x.start - BEFORE) : x.start], buf[x.end : min(last, x.end + AFTER)]
    hint = before[-24:]
    left, right = before[-1:], after[:1]
    words = re.findall(rb"[A-Za-z]+", value)
    return [
        *(float(x.kind == k) for k in range(len(KINDS))),
        float(len(value)), digits, upper, lower, len(value) - digits - upper - lower, digits / len(value), float(len(groups)), float(max(groups, default=0)), float(min(groups, default=0)),
        float(number.isdigit() and luhn(number)), float(number[:1] in (b"3", b"4", b"5", b"6") and number != b""), float(value[:1] in (b"+", b"(")), float(-(share * np.log2(share)).sum()),
        float(np.count_nonzero(np.diff(kinds))), float(re.fullmatch(rb"[0-9a-f]+|[0-9A-F]+", value) is not None), float(b"@" in value), float(len(set(re.findall(rb"[ ().-]+", value)))),
        float(len(set(groups)) == 1), float(groups[-1] if groups else 0), float(groups[0] if groups else 0), float(max(map(len, words), default=0)),
        *(float(bool(h.search(hint))) for h in _HINTS),
        float(left in (b"=", b":", b'"', b"'") or before[-2:] in (b"= ", b": ")), float(left.isalnum()), float(right.isalnum()), float(left in (b".", b"-", b"/")), float(right in (b'"', b"'")),
        float(re.search(rb"[0-9][ .-]?$", before) is not None), float(re.match(rb"[ .-]?[0-9]", after) is not None), float(b"://" in hint),
    ]


def _number(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _card(rng: random.Random, n: int = 16, good: bool = True) -> str:
    body = rng.choice("3456") + _number(rng, n - 2)
    last = next(d for d in "0123456789" if luhn((body + d).encode()))
    return body + (last if good else str((int(last) + rng.randint(1, 9)) % 10))


def _some(rng: random.Random, alphabet: str, least: int, most: int) -> str:
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(least, most)))


_LETTERS, _HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
_MIXED = _LETTERS + _LETTERS.upper() + "0123456789"


def planted(rng: random.Random) -> tuple[str, str, int, str]:
    """(text before the value, value, its kind or -1, text after it) of our own making."""
    word = lambda a=2, b=9: _some(rng, _LETTERS, a, b)
    fours = lambda c, s: s.join(c[i : i + 4] for i in range(0, 16, 4))
    area = f"{rng.randint(200, 999)}", f"{rng.randint(200, 999)}", _number(rng, 4)
    kind = rng.randrange(-3, 5)
    if kind == 0:
        user, host, top = word() + rng.choice(["", _number(rng, 2), "." + word()]), word(), rng.choice(["com", "org", "net", "de"])
        return "", rng.choice([f"{user}@{host}.{top}", f"{user} at {host} dot {top}", f"{user} (at) {host} (dot) {top}", f"{user}[at]{host}[dot]{top}", f"{user} @ {host}.{top}", f"{user} [at] {host}.{top}"]), 0, ""
    if kind == 1:
        return "", ".".join(str(rng.randint(1, 254)) for _ in range(4)), 1, rng.choice(["", ":8080", "/24"])
    if kind == 2:
        card, amex = _card(rng), "37" + _number(rng, 12)
        amex += next(d for d in "0123456789" if luhn((amex + d).encode()))
        beside = rng.choice(["", "", f"{rng.randint(1, 99)} ", f"{rng.randint(1990, 2030)} ", fours(_card(rng), " ") + " "]), rng.choice(["", "", f" {rng.randint(1, 12):02d}-{rng.randint(24, 35)}", f" {rng.randint(100, 999)}"])
        return beside[0], rng.choice([card, fours(card, " "), fours(card, "-"), fours(card, "."), f"{amex[:4]} {amex[4:10]} {amex[10:]}"]), 2, beside[1]
    if kind == 3:
        a, b, c = area
        spelled = [f"+1 ({a}) {b}-{c}", f"+{rng.randint(20, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"00{rng.randint(20, 99)} {a} {b}{c}"]
        if rng.random() < 0.2:
            return rng.choice(["call ", "phone: ", "tel. ", "mobile "]), a + b + c, 3, ""
        lead = rng.choice(["", "", "", rng.choice(spelled) + rng.choice([" ", ", "])])
        return lead, rng.choice(spelled), 3, rng.choice(["", "", " " + rng.choice(spelled), f" {rng.randint(1990, 2030)} {_number(rng, 4)} {_number(rng, 4)}"])
    if kind == 4:
        key = rng.choice(["password", "passwd", "token", "secret", "api_key", "apikey", "auth_token", "access_key"])
        sign = rng.choice(["=", ": ", " = ", ":"])
        quote = rng.choice(["", '"', "'"])
        if rng.random() < 0.4:
            return "", rng.choice(["AKIA", "ASIA"]) + _some(rng, _LETTERS.upper() + "234567890", 16, 16) if rng.random() < 0.5 else rng.choice(["ghp_", "sk-", "xoxb-"]) + _some(rng, _MIXED, 24, 36), 4, ""
        return key + sign + quote, rng.choice([_some(rng, _HEX, 16, 64), _some(rng, _MIXED, 16, 40), _some(rng, _MIXED, 9, 16)]) + rng.choice("0123456789") + rng.choice(_LETTERS), 4, quote
    y, m, d = rng.randint(1950, 2030), rng.randint(1, 12), rng.randint(1, 28)
    fail = _card(rng, 16, False)
    return "", rng.choice([
        f"{y}-{m:02d}-{d:02d} {rng.randint(0, 23)}:{rng.randint(10, 59)}", f"{d:02d}.{m:02d}.{y} {rng.randint(10, 23)}.{rng.randint(10, 59)}", f"{y}-{y + 1} {y + 2}-{y + 3}",
        f"{rng.randint(1, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 99)}", f"{rng.randint(1, 9)}.{_number(rng, 10)}", f"{rng.randint(1, 9)},{_number(rng, 3)},{_number(rng, 3)}.{_number(rng, 2)}",
        f"978-{_number(rng, 1)}-{_number(rng, 2)}-{_number(rng, 6)}-{_number(rng, 1)}", fail, fours(fail, " "), fours(fail, "-"), _number(rng, rng.randint(9, 19)), f"{_number(rng, 4)} {_number(rng, 5)} {_number(rng, 4)}",
        f"{word(6, 10)}-{y}-{m:02d}-{word()}-{word()}", f"{word(8, 12)}{rng.randint(10, 99)}{word(6, 9)}", f"{word(4, 8)}/{word(4, 8)}/{word(3, 5)}{y}/{word(4, 9)}", f"{word()}_{word()}_{word()}_{_number(rng, 2)}", f"{y}/{m:02d}/{d:02d}/{word()}-{word()}-{word()}",
        f"{word()} at {word()}. {word().capitalize()}", f"{word()} at the {word()}.{rng.randint(1, 9)}", f"key: {word(8, 12)}", f"auth: {word(8, 12)}", f"{rng.randint(256, 999)}.{_number(rng, 3)}.{_number(rng, 3)}.{_number(rng, 3)}", " ".join(_number(rng, rng.randint(1, 4)) for _ in range(6)),
    ]), -1, ""


class Taken:
    """Ranges that spans were taken from, apart from each other; base spans may overlap and are joined."""

    def __init__(self, spans: list[Span]):
        self.start: list[int] = []
        self.end: list[int] = []
        for s in sorted(spans, key=lambda s: s.start):
            if self.end and s.start < self.end[-1]:
                self.end[-1] = max(self.end[-1], s.end)
            else:
                self.start.append(s.start)
                self.end.append(s.end)

    def free(self, s: Span) -> bool:
        i = bisect.bisect_left(self.start, s.end)
        return not i or self.end[i - 1] <= s.start

    def add(self, s: Span) -> None:
        i = bisect.bisect_left(self.start, s.start)
        self.start.insert(i, s.start)
        self.end.insert(i, s.end)


def unsettled(spans: list[Span]) -> list[Span]:
    """Those that aren't base spans and overlap none."""
    taken = Taken([s for s in spans if s.base])
    return [s for s in spans if not s.base and taken.free(s)]


def _rank(p: float, s: Span) -> tuple:
    """Better spans first: the likelier, then the longer."""
    return -p, s.start - s.end, s.start, s.kind


class Model:
    """Trees, their calibration, and a threshold for each kind."""

    def __init__(self, contexts: list[tuple[bytes, bytes]], strings: int = PLANTED, precision: float = PRECISION):
        rng = random.Random(31)
        contexts = contexts or [(b"", b"")]
        x, y, of, spans = [], [], [], []
        for i in range(strings):
            before, after = contexts[rng.randrange(len(contexts))]
            lead, value, what, rest = planted(rng)
            lead, value, rest = (t.encode() for t in (lead, value, rest))
            before += b"" if not before or before.endswith((b" ", b"\n")) else b" "
            after = (b"" if after[:1] in (b"", b" ", b"\n", b".", b",") else b" ") + after
            text, s = before + lead + value + rest + after, len(before + lead)
            true = (what, s, s + len(value))
            for found in propose(np.frombuffer(text, np.uint8), np.array([0, len(text)])).values():
                for c in unsettled(found):
                    if c.start < true[2] and c.end > s:  # others may be real ones, of the context or beside it
                        x.append(features(text, 0, len(text), c))
                        y.append(float((c.kind, c.start, c.end) == true))
                        of.append(i)
                        spans.append(c)
        x, y, of = np.array(x), np.array(y), np.array(of)
        held = of % 3 == 2
        self.trees = Boosted(x[~held], y[~held])
        raw = self.trees.raw(x[held])
        self.calibration = Calibration(raw, y[held])
        p, y, of, spans = self.calibration(raw), y[held], of[held], [c for c, h in zip(spans, held, strict=True) if h]
        # thresholds are for the spans that are left when each has given way to better ones
        kept, taken = [], {int(i): Taken([]) for i in of}
        for i in sorted(range(len(p)), key=lambda i: _rank(p[i], spans[i])):
            if taken[int(of[i])].free(spans[i]):
                taken[int(of[i])].add(spans[i])
                kept.append(i)
        self.held_out = p[kept], y[kept], np.array([spans[i].kind for i in kept])
        self.thresholds = [threshold(*(v[self.held_out[2] == k] for v in self.held_out[:2]), precision) for k in range(len(KINDS))]

    def score(self, x: list[list[float]]) -> np.ndarray:
        return self.calibration(self.trees.raw(np.array(x)))


def chosen(model: Model, buf: bytes, first: int, last: int, spans: list[Span]) -> list[Span]:
    """The base spans, and of the others the best that overlap no base span and no better one."""
    base, open_ = [s for s in spans if s.base], unsettled(spans)
    taken, found = Taken(base), list(base)
    if open_:
        p = model.score([features(buf, first, last, s) for s in open_]).tolist()
        for v, s in sorted(zip(p, open_, strict=True), key=lambda x: _rank(*x)):
            if v >= model.thresholds[s.kind] and taken.free(s):
                taken.add(s)
                found.append(s)
    return sorted(set(found), key=lambda s: (s.kind, s.start, s.end))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stands around base spans, and the first and last bytes of texts without any."""
    for batch in batches:
        for part in chunks(batch, "text"):
            data, offsets = byte_arrays(part.column("text"))
            found, out = propose(data, offsets), []
            for r in range(part.num_rows):
                text = data[offsets[r] : offsets[r + 1]].tobytes()
                at = [(s.start - int(offsets[r]), s.end - int(offsets[r])) for s in found.get(r, []) if s.base]
                middle = text.find(b" ", len(text) // 2)
                for s, e in at or [(middle, middle)] * (middle > 0):
                    out.append((text[max(0, s - BEFORE) : s], text[e : e + AFTER]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], ["before", "after"])


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, contexts: int = CONTEXTS) -> Model:
    """Fit on values planted in at most ``contexts`` contexts out of ``sample_docs`` documents; without any, in empty ones."""
    known = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)  # a bounded side
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text").mapInArrow(_contexts, "before binary, after binary")
    rows = sample.distinct().orderBy(F.xxhash64("before", "after"), "before", "after").limit(contexts).collect()
    return Model([(bytes(r.before), bytes(r.after)) for r in rows])


def find(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The personal data in every whole text: ``row`` (struct of the columns ``carry``) and ``found``, a list of (kind, start, end, base).

    Places count code points, the end is exclusive, and the list is in the order of KINDS, then of places.
    ``base`` spans fit the strict forms; base spans of different kinds may overlap. Null and empty texts have none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                data, offsets = byte_arrays(part.column("text"))
                found, buf = propose(data, offsets), data.tobytes()
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                lists = []
                for r in range(part.num_rows):
                    spans = chosen(shared.value, buf, int(offsets[r]), int(offsets[r + 1]), found[r]) if r in found else []
                    zero = points[offsets[r]]
                    lists.append([{"kind": KINDS[s.kind], "start": int(points[s.start] - zero), "end": int(points[s.end] - zero), "base": s.base} for s in spans])
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(lists, kind)], ["row", "found"])

    row = F.struct(*carry).alias("row")
    kind = docs.select(row).schema["row"].dataType.simpleString()
    return docs.select(row, "text").mapInArrow(run, f"row {kind}, found array<struct<kind:string,start:long,end:long,base:boolean>>")


def of_kind(kind: str):
    """A test of one span for ``filter``."""
    return lambda s: s["kind"] == kind


def joined(spans):
    """``kind:start:end`` of a list of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``<kind>`` in the place of each span in ``text``; of overlapping ones the first stands, of equal starts the longest. Null texts stay null."""
    found = find(docs, model, carry=tuple(docs.columns))
    ordered = F.array_sort("found", lambda a, b: F.when(a["start"] != b["start"], (a["start"] - b["start"]).cast("int")).otherwise((b["end"] - a["end"]).cast("int")))
    text = F.col("row.text")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, s):
        kept = F.struct(F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("<"), s["kind"], F.lit(">")).alias("out"), s["end"].alias("at"))
        return F.when(s["start"] < acc["at"], acc).otherwise(kept)

    done = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    return found.withColumn("text", F.when(F.size("found") > 0, done).otherwise(text)).select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
