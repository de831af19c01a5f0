"""Bounded-space online packing of token sequences.

Each partition keeps at most WINDOWS open windows. A document's tokens fill whole windows first; its
tail goes to the open window that it fits best. When it fits none and no window may be opened, the
fullest is completed with the head of the tail and emitted. What is left open at the end of the
partitions is merged in a tree of groups of FAN partitions, by the same rule.
"""

from __future__ import annotations

import functools
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelake.llm import bytehash as bh
from placelake.llm.shared import byte_arrays, checkpoint, chunks, write_table

WINDOWS = 16
FAN = 64
CACHE = 1 << 20
"""Distinct pieces of text whose ids a worker keeps."""
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, open int, part long"

_LETTER, _DIGIT, _OTHER, _BLANK, _UNKNOWN = range(5)


@functools.cache
def _classes() -> np.ndarray:
    """The class of code points whose class is the same in all versions of Unicode; the rest is unknown."""
    out = np.full(0x110000, _UNKNOWN, np.uint8)
    for a, b in ((0, 0x500), (0x2010, 0x2028), (0x2030, 0x205F), (0x20A0, 0x20BD), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4)):
        for c in range(a, b):
            kind = unicodedata.category(chr(c))
            out[c] = _UNKNOWN if kind == "Cn" else {"L": _LETTER, "N": _DIGIT}.get(kind[0], _OTHER)
    out[[*range(9, 14), 0x20, 0x85, 0xA0]] = _BLANK
    return out


def pieces(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of a batch of texts start, by the pattern of byte-level BPE.

    ``codes`` are code points, ``offsets`` the n + 1 bounds of the texts. Contractions at the start of
    a match, runs of letters, digits or other signs with one space before them, and white space.
    """
    n = len(codes)
    start = np.zeros(n + 1, bool)
    start[offsets] = True
    edge = start.copy()
    kind = _classes()[codes]
    run = edge[:-1].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start[:-1] |= run
    blank, space = kind == _BLANK, codes == 0x20
    # the last of some white space before a sign stands alone, or goes with the sign if it is a space
    tail = np.zeros(n, bool)
    tail[:-1] = blank[:-1] & ~blank[1:] & ~edge[1:-1]
    start[:-1] |= tail
    after = np.flatnonzero(tail & space) + 1
    start[after] = False
    # 's 't 're 've 'm 'll 'd where a match starts at the apostrophe
    q = np.flatnonzero((codes == 0x27) & start[:-1])
    q = q[q + 1 < n]
    q = q[(kind[q + 1] == _LETTER) & ~edge[q + 1]]
    if len(q):
        one = codes[q + 1]
        two = np.where((q + 2 < n) & ~edge[np.minimum(q + 2, n)], codes[np.minimum(q + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long_ = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for at, k in ((q[short], 2), (q[long_ & ~short], 3)):
            start[at + 1] = False
            start[at + k] |= True
    start[n] = False
    return np.flatnonzero(start)


class Encoder:
    """Token ids of whole batches with a public byte-level BPE; every distinct pre-token is encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        size = np.zeros(self.plain.get_vocab_size(), np.int64)
        for token, i in self.plain.get_vocab().items():
            size[i] = len(token)  # a sign of the vocabulary stands for a byte
        self.size = size
        self._forget()

    def _forget(self) -> None:
        self.levels: list[tuple[np.ndarray, ...]] = []  # sorted keys with the place and number of their ids and bytes; each level is at most half of the one before
        self.ids, self.pool = _Pool(np.uint32), _Pool(np.uint8)

    def _joined(self, parts: list[str], glue: str) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for i in range(0, len(parts), 512):
            some = parts[i : i + 512]
            ids = np.array(self.plain.encode(glue.join(some), add_special_tokens=False).ids, np.uint32)
            ends = np.cumsum(self.size[ids])
            want = np.cumsum([len(x.encode()) + len(glue) for x in some])
            cut = np.searchsorted(ends, want - len(glue)) + 1
            from_ = np.concatenate([[0], np.searchsorted(ends, want[:-1]) + 1])
            out += [ids[a:b] for a, b in zip(from_.tolist(), cut.tolist(), strict=True)]
        return out

    def distinct(self, parts: list[str]) -> list[np.ndarray]:
        """The ids of each of ``parts``, which are pre-tokens."""
        out: list = [None] * len(parts)
        spaced = [i for i, x in enumerate(parts) if x[0] == " " and not x[-1].isspace()]
        bare = [i for i, x in enumerate(parts) if not x[0].isspace()]
        for some, glue in ((spaced, ""), (bare, "\n")):
            for i, ids in zip(some, self._joined([parts[i] for i in some], glue), strict=True):
                out[i] = ids
        for i, x in enumerate(parts):
            if out[i] is None:
                out[i] = np.array(self.plain.encode(x, add_special_tokens=False).ids, np.uint32)
        return out

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch of UTF-8 texts and the n + 1 bounds of each text's ids."""
        text = data.tobytes().decode()
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        place = np.concatenate([[0], np.cumsum(width)])
        bounds = np.searchsorted(place, offsets)
        odd = np.add.reduceat(np.append(_classes()[codes] == _UNKNOWN, False).astype(np.int64), bounds[:-1]) * (np.diff(bounds) > 0) if len(codes) else np.zeros(len(bounds) - 1)
        start = place[pieces(codes, bounds)]
        end = np.append(start[1:], len(data))
        h = bh.range_hash(bh.prefix_sums(data), start, end)
        unique, where, back = np.unique(h, return_index=True, return_inverse=True)
        size = end - start
        found = self._find(unique)
        new = np.flatnonzero(found[1] < 0)
        if self.levels and sum(len(x[0]) for x in self.levels) + len(new) > CACHE:
            self._forget()
            new = np.arange(len(unique))
        if len(new):
            self._learn(unique[new], data, start[where[new]], end[where[new]])
            found = self._find(unique)
        first, count, place, length = (x[back] for x in found)
        # bytes decide: a piece that has another one's hash sends its text through the tokenizer
        same = size == length
        same[same] = bh.same_bytes(data, start[same], self.pool.data, place[same], size[same])
        if not same.all():
            odd = odd + np.bincount(np.searchsorted(offsets, start[~same], "right") - 1, minlength=len(offsets) - 1)
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids.data[np.repeat(first - total[:-1], count) + np.arange(total[-1])]
        of = total[np.searchsorted(start, offsets)]
        if odd.any():
            rows = [ids[a:b] for a, b in zip(of[:-1], of[1:], strict=True)]
            for i in np.flatnonzero(odd).tolist():
                rows[i] = np.array(self.plain.encode(data[offsets[i] : offsets[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
            of = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
            ids = np.concatenate(rows)
        return ids, of

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """Place and number of the ids and of the bytes of each key; numbers of -1 where it is unknown."""
        out = tuple(np.full(len(keys), v, np.int64) for v in (0, -1, 0, -1))
        for own, *columns in self.levels:
            at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
            hit = own[at] == keys
            for x, column in zip(out, columns, strict=True):
                x[hit] = column[at[hit]]
        return out

    def _learn(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        parts = [data[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        ids = self.distinct([x.decode() for x in parts])
        count, size = np.array([len(x) for x in ids]), end - start
        level = (keys, len(self.ids.data) + np.cumsum(count) - count, count, len(self.pool.data) + np.cumsum(size) - size, size)
        self.ids.add(np.concatenate(ids))
        self.pool.add(np.frombuffer(b"".join(parts), np.uint8))
        self.levels.append(level)
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) > len(self.levels[-2][0]):
            joined = tuple(np.concatenate(c) for c in zip(self.levels.pop(-2), self.levels.pop(), strict=True))
            order = np.argsort(joined[0], kind="stable")
            self.levels.append(tuple(c[order] for c in joined))


class _Pool:
    """An array that grows at its end; its room doubles, so that adding costs no more than what is added."""

    def __init__(self, kind: type):
        self.room, self.used = np.zeros(1 << 16, kind), 0

    @property
    def data(self) -> np.ndarray:
        return self.room[: self.used]

    def add(self, more: np.ndarray) -> None:
        while self.used + len(more) > len(self.room):
            self.room = np.concatenate([self.room, np.zeros_like(self.room)])
        self.room[self.used : self.used + len(more)] = more
        self.used += len(more)


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Packer:
    """Open windows of ``size`` ids; pieces go in, rows of full windows come out."""

    def __init__(self, size: int, first_id: int, limit: int = WINDOWS):
        self.size, self.limit, self.next_id, self.open, self.rows = size, limit, first_id, [], []

    def emit(self, window: list) -> None:
        offset = 0
        for doc, start, ids, total in window:
            self.rows.append((doc, start, len(ids), ids.tobytes(), total, self.next_id, offset, -1))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc: int | None, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.size:
            self.emit([(doc, start, ids[: self.size], total)])
            start, ids = start + self.size, ids[self.size :]
        if not len(ids):
            return
        fits = [w for w in self.open if self.size - w[0] >= len(ids)]
        if fits:
            window = max(fits, key=lambda w: w[0])
            window[0] += len(ids)
            window[1].append((doc, start, ids, total))
            if window[0] == self.size:
                self._close(window)
        elif len(self.open) < self.limit:
            self.open.append([len(ids), [(doc, start, ids, total)]])
        else:
            window = max(self.open, key=lambda w: w[0])
            gap = self.size - window[0]
            window[1].append((doc, start, ids[:gap], total))
            self._close(window)
            self.open.append([len(ids) - gap, [(doc, start + gap, ids[gap:], total)]])

    def _close(self, window: list) -> None:
        self.open = [w for w in self.open if w is not window]
        self.emit(window[1])

    def leave(self) -> None:
        """Put the open windows out as such."""
        for k, (_, window) in enumerate(self.open):
            offset = 0
            for doc, start, ids, total in window:
                self.rows.append((doc, start, len(ids), ids.tobytes(), total, -1, offset, k))
                offset += len(ids)
        self.open = []

    def finish(self) -> None:
        """Close everything: windows are filled from each other, and only the last one is short."""
        rest, self.open, self.limit = sorted(self.open, key=lambda w: -w[0]), [], 1
        for _, window in rest:
            for piece in window:
                self.add(*piece)
        for _, window in self.open:
            self.emit(window)
        self.open = []

    def take(self, part: int) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[]] * 8
        self.rows = []
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([part] * len(arrays[0]), pa.int64())], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "open", "part"])


def _first_pass(path: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer, code = Packer(size, part << 33), encoder(path)
        for batch in batches:
            for some in chunks(batch, "text"):
                ids, of = code.batch(*byte_arrays(some.column("text")))
                n = np.diff(of)
                ids = np.insert(ids, of[1:], np.uint32(end_id))
                stop = np.cumsum(n + 1)
                for doc, a, b in zip(some.column("doc_id").to_pylist(), (stop - n - 1).tolist(), stop.tolist(), strict=True):
                    packer.add(doc, 0, ids[a:b], b - a)
                yield packer.take(part)
        packer.leave()
        yield packer.take(part)

    return run


def _merge(size: int, level: int, last: bool):
    """Rows sorted by group: the left-over pieces of each go through a packer of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, packer = None, None
        for batch in batches:
            for g, doc, start, ids, total in zip(*(batch.column(c).to_pylist() for c in ("group", "doc_id", "start", "ids", "doc_tokens")), strict=True):
                if g != group:
                    if packer:
                        packer.finish() if last else packer.leave()
                        yield packer.take(group)
                    group, packer = g, Packer(size, (level << 58) | (g << 33))
                packer.add(doc, start, np.frombuffer(ids, np.uint32), total)
            if packer:
                yield packer.take(group)
        if packer:
            packer.finish() if last else packer.leave()
            yield packer.take(group)

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 0) -> DataFrame:
    """Pack the tokens of all documents into sequences of at most ``size``.

    ``docs`` needs doc_id (long) and text; ``tokenizer`` is the path of a byte-level BPE file of the
    library tokenizers, present on every machine. Strings of special tokens in a text are ordinary
    text. Returns a row per piece: doc_id, start, length, ids (binary: little-endian 32-bit), doc_tokens
    (with the end id), sequence_id, offset, padded_length. Null and empty texts are a single end id;
    texts of any length are cut into windows; repeated rows and null ids are packed like any other. All
    sequences but one are full: that one is padded to ``size`` unless its length is a power of two.
    """
    packed = write_table(docs.select("doc_id", "text").mapInArrow(_first_pass(tokenizer, size, end_id), SCHEMA), "pieces")
    done, level = packed.where("open < 0"), 1
    rest = packed.where("open >= 0")
    groups = (packed.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        last = groups <= FAN
        rows = rest.withColumn("group", F.floor(F.col("part") / FAN)).repartition(min(-(-groups // FAN), 2000), "group").sortWithinPartitions("group", "part", "open", "offset")
        merged = checkpoint(rows.mapInArrow(_merge(size, level, last), SCHEMA))
        done = done.unionByName(merged.where("open < 0"))
        if last:
            break
        rest, groups, level = merged.where("open >= 0"), -(-groups // FAN), level + 1
    # only in the last sequence of all can there be fewer ids
    short = merged.where("open < 0").groupBy("sequence_id").agg(F.sum("length").alias("n")).where(F.col("n") < size)
    out = done.drop("open", "part").join(F.broadcast(short), "sequence_id", "left")
    power = (F.col("n").bitwiseAND(F.col("n") - 1)) == 0
    return out.withColumn("padded_length", F.when(F.col("n").isNull() | ~power, F.lit(size)).otherwise(F.col("n")).cast("long")).drop("n")
