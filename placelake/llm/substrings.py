"""Removal of long repeated byte strings by prefix-free parsing.

A hash over TRIGGER bytes marks triggers in every text. A phrase runs from one trigger (or the start of
the text) to the end of the next trigger (or of the text), so that neighbours overlap by a trigger and
no suffix of a phrase that is longer than a trigger begins another one.

1. Dictionary: the phrases of all texts are sorted as bytes by a range partitioning over the cluster.
   Those that occur twice or more get ranks, which are in the order of their bytes. A phrase that
   occurs once can't lie in a repeated string, so it gets none.
2. Parse: each text becomes the sequence of its phrases' ranks.
3. Suffix array of the parse: the suffixes of the parse, as ranks and up to ``width`` bytes, are
   sorted over the cluster, those that are equal by the rank of the phrase before. Of a suffix, none
   shares more phrases than a neighbour in that order does, so the common prefix with the neighbours, in
   bytes, says which windows are repeated: a window is named by the first trigger in it, starts ``d``
   bytes before it, and is repeated if both suffixes share the phrase before and ``width - d`` bytes.
4. Corpus order at the rims: a window whose first or last phrase is only in part that of its equal, by a
   suffix or a prefix of the phrase, isn't settled by ranks. Windows that may be such are combined from
   the phrase's suffix and the parse suffix and compared in a second sort: first in blocks of BLOCK windows, by what the block's windows share and by
   all that they cover, then one by one. Here two hashes (62 and 62 bits or more) stand for the bytes.

Windows with no trigger or with one between two unranked phrases, which are rare or periodic, go through step 4 only.
Every order is range-partitioned with a hash of the place as its last key, so that a phrase or passage in
a third of all texts is spread over many tasks; the rims of partitions are compared on the driver (a
row or two per partition) in step 1, and go through step 4 after step 3. Where ranges end is found by
what a few texts have (SAMPLED_TEXTS per range): it decides how even the tasks are, not what is found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelake.llm import bytehash as bh
from placelake.llm.shared import binary_column, bounds_of, byte_arrays, chunks, in_ranges, release, write_counted, write_table

TRIGGER = 16
TRIGGER_BITS = 6
"""A trigger starts at one position in 2**6."""
BLOCK = 6
SHINGLE = 16
"""Words of the shingles that stand for windows of words."""
SAMPLED_TEXTS = 4
RANGE_BYTES = 1 << 19
"""Of text per range at least, where there is too little for ``spark.sql.shuffle.partitions`` ranges."""
SPAN, EMIT = 0, 1
"""What becomes of a region: all its windows are repeated, or some may be."""

_NO_ID = -(2**63)
_ELEMENT = 12
"""Bytes of a phrase in the key of a parse suffix: its rank and its length, the highest byte first."""
_UNRANKED = -1


def triggers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where triggers start in a batch of texts, and their rows. It depends on the TRIGGER bytes from there on alone.

    The last eight of them are hashed. Eight bytes that stood among the TRIGGER already don't count, so that texts of a
    period of up to eight bytes have no triggers.
    """
    eight = bh.eights(data)
    half = TRIGGER - 8
    at = np.flatnonzero((bh.mix(eight[half:] + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(64 - TRIGGER_BITS)) == 0)
    for k in range(half):
        at = at[eight[at + k] != eight[at + half]]
    row = np.searchsorted(offsets, at, "right") - 1
    inside = at + TRIGGER <= offsets[1:][row]
    return at[inside], row[inside]


def phrases(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The phrases of a batch of texts in order: row, start and end in ``data``, ``before`` (how many windows have the trigger at the start as their first one; 0 where none is there) and ``after`` (bytes of the next phrase)."""
    at, row = triggers(data, offsets)
    first = offsets[:-1][np.diff(offsets) > 0]
    start = np.union1d(first, at)
    row = np.searchsorted(offsets, start, "right") - 1
    opens = np.isin(start, first, assume_unique=True)
    follows = np.append(~opens[1:], False) if len(start) else opens
    end = np.where(follows, np.append(start[1:], 0) + TRIGGER, offsets[1:][row])
    trigger = np.isin(start, at, assume_unique=True)
    gap = np.diff(start, prepend=0)
    second = np.concatenate([[False], opens[:-1] & ~trigger[:-1]]) if len(start) else opens
    before = np.where(opens, 1, gap + second) * trigger  # the first trigger names the windows from the text's start on
    size = end - start
    return {"row": row, "start": start, "end": end, "before": before, "after": np.where(follows, np.append(size[1:], 0), 0)}


_PHRASES = "phrase binary, id long, h long, place long"
_FAR = 2**16 - 1


def _place(at: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Start of a phrase in its text, and ``before`` and ``after`` up to _FAR, as one number in the order of starts."""
    return (at << 32) | (np.minimum(before, _FAR) << 16) | np.minimum(after, _FAR)


def _placed(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 32, (place >> 16) & _FAR, place & _FAR


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            data, offsets = byte_arrays(part.column("text"))
            p = phrases(data, offsets)
            size = p["end"] - p["start"]
            stop = np.cumsum(size)
            bytes_ = data[np.repeat(p["start"] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
            take = pa.array(p["row"], pa.int64())
            at = p["start"] - offsets[p["row"]]
            yield pa.RecordBatch.from_arrays(
                [binary_column(bytes_, np.concatenate([[0], stop])), part.column("id").take(take), part.column("h").take(take), pa.array(_place(at, p["before"], p["after"]))],
                [x.split()[0] for x in _PHRASES.split(", ")],
            )


_RANKED = "rank long, id long, h long, place long, n int, digest binary"


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over phrases in order: rank and length of those that occur again. Those of the first and the last phrase of a partition have its digest and are put out in any case."""
    base, run, held = TaskContext.get().partitionId() << 40, 0, None

    def put(x: pa.RecordBatch, again: np.ndarray, rank: np.ndarray, edge: bool) -> pa.RecordBatch:
        keep = np.flatnonzero(again | edge)
        y = x.take(pa.array(keep))
        digest = pa.array([hashlib.sha256(v.as_py()).digest() for v in y.column("phrase")] if edge else [None] * len(keep), pa.binary())
        columns = [y.column(c) for c in ("id", "h", "place")]
        return pa.RecordBatch.from_arrays([pa.array(base + rank[keep]), *columns, pc.binary_length(y.column("phrase")).cast(pa.int32()), digest], [c.split()[0] for c in _RANKED.split(", ")])

    def judge(x: pa.RecordBatch, last: bool) -> Iterator[pa.RecordBatch]:
        """``x`` holds whole runs, but perhaps for the last one."""
        nonlocal run
        phrase = x.column("phrase")
        same = pc.equal(phrase.slice(1), phrase.slice(0, len(phrase) - 1)).to_numpy(zero_copy_only=False).astype(bool)
        again = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        rank = run + np.concatenate([[0], np.cumsum(~same)])
        head = rank == 0
        tail = (rank == rank[-1]) & last
        for part, edge in ((head, True), (tail & ~head, True), (~head & ~tail, False)):
            at = np.flatnonzero(part)
            if len(at):
                for i in range(0, len(at), 1 << 16):
                    some = at[i : i + (1 << 16)]
                    yield put(x.take(pa.array(some)), again[some], rank[some], edge)
        run = int(rank[-1])

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is None:
            held = batch
            continue
        # the run at the end of what is held goes on with the batch; the tail of the batch waits
        x = pa.concat_batches([held, batch])
        phrase = x.column("phrase")
        same = pc.equal(phrase.slice(1), phrase.slice(0, len(phrase) - 1)).to_numpy(zero_copy_only=False).astype(bool)
        cut = int(np.flatnonzero(~same)[-1]) + 1 if (~same).any() else 0
        if cut:
            yield from judge(x.slice(0, cut), False)
            run += 1
            held = x.slice(cut)
        elif x.num_rows > _HELD:  # one phrase all along: what is held twice already is known to be repeated
            yield from judge(x.slice(0, x.num_rows - 2), False)
            held = x.slice(x.num_rows - 2)
        else:
            held = x
    if held is not None:
        yield from judge(held, True)


_HELD = 1 << 17
"""Rows of a single phrase that are held before they are put out."""


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def one_in(share: int | Column, *key: str) -> Column:
    """Whether a row is one of the sample of one in ``share``, by its key."""
    return F.pmod(F.xxhash64(*key), F.lit(share) if isinstance(share, int) else share) == 0


def dictionary(texts: DataFrame, few: DataFrame | None = None, ranges: int | None = None) -> tuple[DataFrame, dict[int, int], set[int]]:
    """``texts(id, h, text)`` -> the occurrences of repeated phrases (RANKED), which ranks of them are another one's, and which occur once after all.

    Both are about the first and last phrase of each partition, so their number is at most twice that of partitions, ``ranges``.
    ``few`` is a sample of the texts.
    """
    how = _phrases, _PHRASES, ("phrase",), ("id", "place")
    ordered = in_ranges(texts, *how, bounds_of(texts if few is None else few, *how, ranges or _partitions(texts)))
    ranked = write_table(ordered.mapInArrow(_ranks, _RANKED), "ranks")
    edges = ranked.where("digest is not null").groupBy("rank", "digest").agg(F.count("*").alias("n")).collect()
    same: dict[int, int] = {}
    count: dict[int, int] = {}
    before = None
    for e in sorted(edges, key=lambda e: e["rank"]):
        rank = before[0] if before and before[1] == e["digest"] else e["rank"]
        if rank != e["rank"]:
            same[e["rank"]] = rank
        count[rank] = count.get(rank, 0) + e["n"]
        before = (rank, e["digest"])
    return ranked.drop("digest"), same, {r for r, n in count.items() if n == 1}


_SUFFIXES = "seq binary, prev long, id long, h long, at int, far int, tail int, limit int"


def _parse_suffixes(width: int, same: dict[int, int], once: set[int]):
    """Over the ranked phrases of whole texts, in order: the suffixes of the parse from each trigger on, up to ``width`` bytes or to the next phrase without rank.

    ``prev`` is the rank of the phrase before, ``far`` how far before the trigger the first of its windows starts, ``tail``
    how many bytes of the text, up to ``width``, the suffix could share with another one at most, ``limit`` how far before the trigger a
    window may start that isn't over before the next trigger (or the text) ends.
    """
    was = np.array(sorted(same), np.int64)
    now = np.array([same[r] for r in sorted(same)], np.int64)
    single = np.array(sorted(once), np.int64)

    def suffixes(x: pa.RecordBatch) -> pa.RecordBatch:
        rank, id_, h, place, n = (x.column(c).to_numpy().astype(np.int64) for c in ("rank", "id", "h", "place", "n"))
        if len(was):
            i = np.minimum(np.searchsorted(was, rank), len(was) - 1)
            rank = np.where(was[i] == rank, now[i], rank)
        keep = ~np.isin(rank, single)
        rank, id_, h, place, n = (c[keep] for c in (rank, id_, h, place, n))
        at, before, after = _placed(place)
        m = len(rank)
        row = np.cumsum(np.concatenate([[0], (id_[1:] != id_[:-1]) | (h[1:] != h[:-1])])[:m])
        joined = np.zeros(m + 1, bool)  # whether a phrase goes on from the one before
        joined[1:-1] = (row[1:] == row[:-1]) & (at[1:] == at[:-1] + n[:-1] - TRIGGER)
        run_end = np.flatnonzero(~joined[1:])  # the last phrase of each run
        stop = run_end[np.searchsorted(run_end, np.arange(m))] if m else at
        end = (row << 40) + at + n
        last = np.minimum(np.searchsorted(end, (row << 40) + at + width), stop)
        tail = np.minimum(at[last] + n[last] - at + np.maximum(after[last] - TRIGGER, 0), width)
        far, limit = np.minimum(before - 1, width - TRIGGER), width - n - (after == 0)
        j = np.flatnonzero((before > 0) & (tail >= width - far))
        element = np.empty((m, _ELEMENT), np.uint8)
        element[:, :8] = rank.astype(">u8")[:, None].view(np.uint8)
        element[:, 8:] = n.astype(">u4")[:, None].view(np.uint8)
        size = last[j] - j + 1
        total = np.cumsum(size)
        which = np.repeat(j - (total - size), size) + np.arange(total[-1] if len(total) else 0)
        seq = binary_column(element[which].ravel(), np.concatenate([[0], total]) * _ELEMENT)
        prev = np.where(joined[:-1], np.concatenate([[_UNRANKED], rank])[:m], _UNRANKED)[j]
        return pa.RecordBatch.from_arrays([seq, pa.array(prev), pa.array(id_[j]), pa.array(h[j]), *(pa.array(c[j], pa.int32()) for c in (at, far, tail, limit))], [c.split()[0] for c in _SUFFIXES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = pa.concat_batches([held, batch]) if held is not None else batch
            id_, h = x.column("id").to_numpy(), x.column("h").to_numpy()
            cut = np.flatnonzero((id_[1:] != id_[:-1]) | (h[1:] != h[:-1]))
            cut = int(cut[-1]) + 1 if len(cut) else 0
            held = x.slice(cut)
            for i in range(0, cut, 1 << 16):  # texts aren't cut
                a, b = (_whole(id_, h, k, cut) for k in (i, i + (1 << 16)))
                if b > a:
                    yield suffixes(x.slice(a, b - a))
        if held is not None:
            yield suffixes(held)

    return run


def _whole(id_: np.ndarray, h: np.ndarray, k: int, end: int) -> int:
    """The first start of a text at ``k`` or after it."""
    while 0 < k < end and id_[k] == id_[k - 1] and h[k] == h[k - 1]:
        k += 1
    return min(k, end)


def common_phrases(seq: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of suffixes in order: how many phrases each shares with the one before, the offsets of their phrases, and the bytes from a trigger to the end of each phrase."""
    data, offsets = byte_arrays(seq)
    element = data.reshape(-1, _ELEMENT)
    offsets = offsets // _ELEMENT
    rank = np.ascontiguousarray(element[:, :8]).view(">u8").ravel()
    n = np.ascontiguousarray(element[:, 8:]).view(">u4").ravel().astype(np.int64)
    size = np.diff(offsets)
    step = np.concatenate([[0], np.cumsum(n - TRIGGER)])
    end = step[1:] - np.repeat(step[offsets[:-1]], size) + TRIGGER
    common = np.zeros(len(size), np.int64)
    open_ = np.arange(1, len(size))
    k = 0
    while len(open_):
        open_ = open_[(size[open_] > k) & (size[open_ - 1] > k)]
        open_ = open_[rank[offsets[open_] + k] == rank[offsets[open_ - 1] + k]]
        k += 1
        common[open_] = k
    return common, offsets, end


_JUDGED = "id long, h long, lo int, n int, at long, kind int"


def _lcp(width: int):
    """Over the parse's suffixes in order: the windows that are repeated for certain, and those that may be. At the rims of a partition all may be."""

    def judge(x: pa.RecordBatch, skip: int, before: bool, after: bool) -> pa.RecordBatch:
        """``skip`` rows at the start are there as neighbours only, as is the last row if ``after``; ``before`` says that the first row has no neighbour."""
        m = x.num_rows
        common, offsets, end = common_phrases(x.column("seq"))
        prev, at, far, tail, limit = (x.column(c).to_numpy().astype(np.int64) for c in ("prev", "at", "far", "tail", "limit"))
        size = np.diff(offsets)
        ended = np.concatenate([end, [0]])

        def shared(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The bytes of ``c`` common phrases, and those that can be shared at most."""
            sure = np.where(c > 0, ended[offsets[:-1] + np.maximum(c, 1) - 1], 0)
            most = np.where(c < size, ended[np.minimum(offsets[:-1] + c, offsets[1:])], tail)
            return sure, np.minimum(most, tail)

        up, up_most = shared(common)
        down, down_most = shared(np.append(common[1:], 0))
        equal = np.zeros(m + 1, bool)
        equal[1:-1] = (prev[1:] == prev[:-1]) & (prev[1:] != _UNRANKED)
        whole = np.zeros(m + 1, bool)
        whole[1:-1] = equal[1:-1] & (size[1:] == size[:-1]) & (common[1:] == size[1:])
        if m:
            up_most[0] = tail[0] if before else 0
            down_most[-1] = 0 if after else tail[-1]
        settled = np.maximum(np.where(equal[:-1], up, 0), np.where(equal[1:], down, 0))
        most = np.maximum(up_most, down_most)
        least = width - far  # bytes after the trigger that the first window needs
        other = ((up_most >= least) & ~whole[:-1]) | ((down_most >= least) & ~whole[1:])
        own = np.zeros(m, bool)
        own[skip : m - after] = True
        span = np.flatnonzero(own & (settled >= least))
        near = np.maximum(width - settled, 0)[span]
        emit = np.flatnonzero(own & (most >= least) & (other | (most > np.minimum(settled, width))))
        d = np.maximum(width - most, 0)[emit]
        top = np.where(other, far, np.minimum(far, width - settled - 1))
        top = np.minimum(top, limit)[emit]  # those that hold one trigger are among the bare ones
        keep = top >= d
        emit, d, top = emit[keep], d[keep], top[keep]
        y = x.select(["id", "h"]).take(pa.array(np.concatenate([span, emit])))
        lo = np.concatenate([at[span] - far[span], at[emit] - top])
        n = np.concatenate([far[span] - near + 1, top - d + 1])
        kind = np.repeat([SPAN, EMIT], [len(span), len(emit)])
        arrays = [pa.array(lo, pa.int32()), pa.array(n, pa.int32()), pa.array(np.concatenate([at[span], at[emit]])), pa.array(kind, pa.int32())]
        return pa.RecordBatch.from_arrays([*y.columns, *arrays], [c.split()[0] for c in _JUDGED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, skip = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield judge(pa.concat_batches([held, batch.slice(0, 1)]), skip, not skip, True)
                held, skip = pa.concat_batches([held.slice(held.num_rows - 1), batch]), 1
            else:
                held = batch
        if held is not None:
            yield judge(held, skip, not skip, False)

    return run


def _bare_slices(width: int):
    """The windows that hold no trigger, or one alone, as slices: see ``_slices``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                data, offsets = byte_arrays(part.column("text"))
                p = phrases(data, offsets)
                row, start, before, after = (p[c] for c in ("row", "start", "before", "after"))
                last = np.where(after > 0, p["end"] - 1, offsets[1:][row]) - width  # of the windows without the next trigger
                far = np.minimum(before - 1, width - TRIGGER)
                one = np.flatnonzero((before > 0) & (last >= start - far))
                none = np.flatnonzero(last >= start + (before > 0))
                which = np.concatenate([one, none])
                lo = np.concatenate([start[one] - far[one], start[none] + (before[none] > 0)])
                hi = np.concatenate([np.minimum(start[one], last[one]), last[none]])
                at = np.concatenate([start[one] - lo[: len(one)], np.full(len(none), -1)])
                size = hi - lo + width
                stop = np.cumsum(size)
                source = np.repeat(lo - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)
                take = pa.array(row[which], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(take), part.column("h").take(take), *(pa.array(c, pa.int32()) for c in (lo - offsets[row[which]], hi - lo + 1, at)), binary_column(data[source], np.concatenate([[0], stop]))],
                    ["id", "h", "lo", "n", "at", "text"],
                )

    return run


def _neighbours(split: set[tuple[int, int]]):
    """Over regions in order: what becomes of each, from the one before and the one after it. The rims of a partition are looked for; regions in ``split``, all of which are repeated, may go on in the next partition."""

    def judge(x: pa.RecordBatch, before: tuple | None, after: tuple | None) -> pa.RecordBatch:
        key, region, at = (x.column(c).to_numpy() for c in ("key", "region", "at"))
        same_key = np.ones(len(key) + 1, bool)
        same = np.zeros(len(key) + 1, bool)
        same_key[1:-1] = key[1:] == key[:-1]
        same[1:-1] = same_key[1:-1] & (region[1:] == region[:-1])
        if before:
            same_key[0], same[0] = key[0] == before[0], (key[0], region[0]) == before
        else:
            same[0] = (key[0], region[0]) in split
        if after:
            same_key[-1], same[-1] = key[-1] == after[0], (key[-1], region[-1]) == after
        else:
            same[-1] = (key[-1], region[-1]) in split
        again = (same[:-1] | same[1:]) & (at >= 0)
        rim = (same_key[:-1] & ~same[:-1]) | (same_key[1:] & ~same[1:]) | (at < 0)
        span, emit = np.flatnonzero(again), np.flatnonzero(rim)  # one of equal regions speaks for them among the others
        y = x.select(["id", "h", "lo", "n", "at"]).take(pa.array(np.concatenate([span, emit])))
        return pa.RecordBatch.from_arrays([*y.columns, pa.array(np.repeat(np.array([SPAN, EMIT], np.int32), [len(span), len(emit)]))], ["id", "h", "lo", "n", "at", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield judge(held, before, (batch.column("key")[0].as_py(), batch.column("region")[0].as_py()))
                before = (held.column("key")[-1].as_py(), held.column("region")[-1].as_py())
            held = batch
        if held is not None:
            yield judge(held, before, None)

    return run


def _slices(width: int):
    """The bytes that chosen regions cover, a row per region; ``at`` counts from the region's start from here on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                data, offsets = byte_arrays(part.column("text"))
                lists = part.column("regions")
                flat = lists.flatten()
                lo, n, at = (flat.field(c).to_numpy().astype(np.int64) for c in ("lo", "n", "at"))
                row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                size = n + width - 1
                stop = np.cumsum(size)
                source = np.repeat(offsets[row] + lo - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(take), part.column("h").take(take), pa.array(lo, pa.int32()), pa.array(n, pa.int32()), pa.array(np.where(at < 0, -1, at - lo), pa.int32()), binary_column(data[source], np.concatenate([[0], stop]))],
                    ["id", "h", "lo", "n", "at", "text"],
                )

    return run


def _blocks(width: int):
    """Regions as blocks of windows whose distances before the trigger are alike: key is of the bytes that they share, region of all that they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                data, offsets = byte_arrays(part.column("text"))
                sums = bh.prefix_sums(data)
                n, at = (part.column(c).to_numpy().astype(np.int64) for c in ("n", "at"))
                near, far = (at - n + 1) // BLOCK, at // BLOCK
                count = far - near + 1
                row = np.repeat(np.arange(len(n)), count)
                j = near[row] + np.arange(len(row)) - (np.cumsum(count) - count)[row]
                full = at[row] - BLOCK * j
                x, y = np.maximum(full - BLOCK + 1, 0), np.minimum(full, n[row] - 1)
                base = offsets[row]
                key = bh.mix(bh.range_hash(sums, base + full, base + full - BLOCK + 1 + width) + j.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                region = bh.range_hash(sums, base + x, base + y + width) + (full - x).astype(np.uint64)
                take = pa.array(row)
                lo = part.column("lo").to_numpy().astype(np.int64)[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(region.view(np.int64)), part.column("id").take(take), part.column("h").take(take), pa.array(lo + x, pa.int32()), pa.array(y - x + 1, pa.int32()), pa.array((lo << 32) | n[row])],
                    ["key", "region", "id", "h", "lo", "n", "at"],
                )

    return run


def _windows(width: int):
    """The windows of chosen blocks. A row with hash has the weight 1 and a place, or 2 and none; those without hash are runs of places that are known to be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                data, offsets = byte_arrays(part.column("text"))
                sums = bh.prefix_sums(data)
                lists = part.column("blocks")
                flat = lists.flatten()
                lo, n = (flat.field(c).to_numpy().astype(np.int64) for c in ("lo", "n"))
                row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                which = np.repeat(np.arange(len(n)), n)
                place = lo[which] + np.arange(len(which)) - (np.cumsum(n) - n)[which]
                row = row[which]
                i = offsets[row] + place - part.column("lo").to_numpy()[row]
                h, other = bh.two_hashes(sums, data, i, i + width)
                order = np.lexsort((h, row))
                row, place, h, other = row[order], place[order], h[order], other[order]
                new = np.ones(len(h), bool)
                new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
                size = np.diff(np.append(np.flatnonzero(new), len(h)))
                again, one = size > 1, np.flatnonzero(new)
                # places that are repeated within their text, as runs
                r, at = np.divmod(np.sort((row * (1 << 40) + place)[np.repeat(again, size)]), 1 << 40)
                head = np.ones(len(r), bool)
                head[1:] = (r[1:] != r[:-1]) | (at[1:] > at[:-1] + 1)
                head = np.flatnonzero(head)
                run_n = np.diff(np.append(head, len(r)))
                take = pa.array(np.concatenate([row[one], r[head]]), pa.int64())
                absent = np.arange(len(one) + len(head)) >= len(one)
                hashes = (pa.array(np.concatenate([x[one], np.zeros(len(head), np.uint64)]).view(np.int64), mask=absent) for x in (h, other))
                columns = [
                    np.concatenate([np.where(again, 2, 1), np.zeros(len(head))]),
                    np.concatenate([np.where(again, -1, place[one]), at[head]]),
                    np.concatenate([np.ones(len(one)), run_n]),
                ]
                weight, at, many = (pa.array(c.astype(np.int32)) for c in columns)
                yield pa.RecordBatch.from_arrays([*hashes, weight, part.column("id").take(take), part.column("h").take(take), at, many], ["window", "other", "weight", "id", "h", "lo", "n"])

    return run


def _cut(width: int, carry: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                data, offsets = byte_arrays(part.column("text"))
                lists = part.column("repeats")
                per = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten()
                lo, n = flat.field("lo").to_numpy().astype(np.int64), flat.field("n").to_numpy()
                passage = flat.field("passage").to_numpy(zero_copy_only=False).astype(bool)
                row = np.repeat(np.arange(len(per)), per)

                def covered(some: np.ndarray, row: np.ndarray = row, lo: np.ndarray = lo, n: np.ndarray = n, offsets: np.ndarray = offsets) -> np.ndarray:
                    step = np.zeros(offsets[-1] + 1, np.int64)
                    np.add.at(step, (offsets[row] + lo)[some], 1)
                    np.add.at(step, (offsets[row] + lo + n - 1 + width)[some], -1)
                    return np.cumsum(step[:-1]) > 0

                gone = covered(~passage)
                all_ = gone | covered(passage) if passage.any() else gone
                start, end = bh.spans(gone, offsets)
                left = np.concatenate([[0], np.cumsum(~gone)])[offsets]
                of = np.searchsorted(start, offsets)
                r = np.repeat(np.arange(len(offsets) - 1), np.diff(of))
                ranges = pa.StructArray.from_arrays([pa.array(start - offsets[r]), pa.array(end - offsets[r])], ["start", "end"])
                size, removed = np.diff(offsets), np.diff(offsets) - np.diff(left)
                kept = binary_column(data[~gone], left)
                rest_of = np.concatenate([[0], np.cumsum(~all_)])[offsets]
                rest = binary_column(data[~all_], rest_of)
                own = dict(zip((f.name for f in part.column("row").type), part.column("row").flatten(), strict=True))
                whole = pa.StructArray.from_arrays([own[c] if c in own else part.column(c) for c in carry], list(carry))
                texts = [rest[i].as_py().decode("utf-8", "ignore") if x else None for i, x in enumerate((size > np.diff(rest_of)).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [whole, pa.array(size), pa.array(removed), pa.ListArray.from_arrays(pa.array(of, pa.int32()), ranges), kept, pa.array(texts, pa.string())],
                    ["row", "n_bytes", "n_removed", "spans", "kept", "rest"],
                )

    return run


_SLICES = "id long, h long, lo int, n int, at int, text binary"
_ORDERED = "key long, region long, id long, h long, lo int, n int, at long"


def _judged(rows: DataFrame, few: DataFrame, make, name: str, ranges: int) -> DataFrame:
    """Order the regions that ``make`` makes of ``rows`` by key and region over the cluster, and keep those that are repeated or may be in part; ``few`` is a sample of ``rows``."""
    how = make, _ORDERED, ("key", "region"), ("id", "lo")
    found = bounds_of(few, *how, ranges)
    # equal regions are parted only where they alone fill a range
    bounds = [b if i and found[i - 1][:2] == b[:2] else b[:2] for i, b in enumerate(found)]
    split = {b[:2] for b in bounds if len(b) > 2}
    return write_table(in_ranges(rows, *how, bounds).mapInArrow(_neighbours(split), _JUDGED), name)


def parse_suffixes(ranked: DataFrame, same: dict[int, int], once: set[int], width: int, share: int = 1, ranges: int | None = None) -> DataFrame:
    """The suffix array of the parse, over the cluster: its suffixes, up to ``width`` bytes, in order; one in ``share`` texts says where ranges end."""
    how = _parse_suffixes(width, same, once), _SUFFIXES, ("seq", "prev"), ("id", "at")
    whole, few = (x.repartition("id", "h").sortWithinPartitions("id", "h", "place") for x in (ranked, ranked.where(one_in(share, "id", "h"))))
    return in_ranges(whole, *how, bounds_of(few, *how, ranges or _partitions(ranked)))


def _word_windows(data: np.ndarray, offsets: np.ndarray, words: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each window of ``words`` words, the place of the least hash of the shingles in it (the first of equal ones), and the hashes of all shingles; ``sums`` are the prefix sums of ``data``."""
    size = min(SHINGLE, words)
    start, end, of = bh.words(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(of))
    m = len(start) - words + 1
    if m <= 0:
        return *(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, np.uint64)
    hashes = bh.range_hash(sums, start[: len(start) - size + 1], end[size - 1 :])
    least, place, span, reach = hashes, np.arange(len(hashes)), words - size + 1, 1

    def earlier(a: slice, b: slice) -> tuple[np.ndarray, np.ndarray]:
        after = least[b] < least[a]
        return np.where(after, least[b], least[a]), np.where(after, place[b], place[a])

    while 2 * reach <= span:
        least, place = earlier(slice(None, -reach), slice(reach, None))
        reach *= 2
    if reach < span:
        least, place = earlier(slice(0, m), slice(span - reach, span - reach + m))
    at = np.flatnonzero(row[:m] == row[words - 1 :])
    return row[at], start[at], end[at + words - 1], place[at], hashes


def _anchors(words: int, width: int):
    """A row per shingle that stands for windows of words, in order of their starts: equal windows have equal ones, at different places.

    ``region`` is of all bytes that its windows cover, ``lo`` and ``n`` say which those are, as windows of ``width`` bytes, ``at`` which windows of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                data, offsets = byte_arrays(part.column("text"))
                sums = bh.prefix_sums(data)
                row, start, end, place, hashes = _word_windows(data, offsets, words, sums)
                head = np.flatnonzero(np.diff(place, prepend=-1) | np.diff(row, prepend=-1))
                last = np.append(head[1:], len(row))[: len(head)] - 1
                region = bh.range_hash(sums, start[head], end[last])
                window = ((head - np.searchsorted(row, row[head])) << 32) | (last - head + 1)
                take = pa.array(row[head], pa.int64())
                lo, n = start[head] - offsets[row[head]], end[last] - start[head] - width + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[place[head]].view(np.int64)), pa.array(region.view(np.int64)), part.column("id").take(take), part.column("h").take(take), pa.array(lo, pa.int32()), pa.array(n, pa.int32()), pa.array(window)],
                    ["key", "region", "id", "h", "lo", "n", "at"],
                )

    return run


def _chosen_windows(words: int, width: int):
    """The windows of words of ``anchors``, as the bytes that they cover; ``n`` windows of ``width`` bytes from ``lo`` on, perhaps below 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                data, offsets = byte_arrays(part.column("text"))
                sums = bh.prefix_sums(data)
                row, start, end, _, _ = _word_windows(data, offsets, words, sums)
                lists = part.column("anchors")
                per = np.diff(lists.offsets.to_numpy())
                window = lists.flatten().to_numpy()
                lo, n = window >> 32, window & 0xFFFFFFFF
                lo = lo + np.searchsorted(row, np.repeat(np.arange(len(per)), per))
                at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row, start, end = row[at], start[at], end[at]
                key, other = (pa.array(x.view(np.int64)) for x in bh.two_hashes(sums, data, start, end))
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([key, other, part.column("id").take(take), part.column("h").take(take), pa.array(start - offsets[row], pa.int32()), pa.array(end - start - width + 1, pa.int32()), pa.array(np.zeros(len(at)), pa.int64())], ["key", "region", "id", "h", "lo", "n", "at"])

    return run


def _repeated_words(texts: DataFrame, few: DataFrame, words: int, width: int, ranges: int) -> DataFrame:
    """id, h, lo and n of the windows of ``words`` words whose bytes also stand anywhere else."""
    texts, few = (x.where(F.octet_length("text") >= 2 * words - 1) for x in (texts, few))
    anchors = _judged(texts, few, _anchors(words, width), "anchors", ranges)
    emit = anchors.where(F.col("kind") == EMIT)

    def chosen(texts: DataFrame, emit: DataFrame) -> DataFrame:
        return texts.join(emit.groupBy("id", "h").agg(F.collect_set("at").alias("anchors")).hint("shuffle_hash"), ["id", "h"])

    some = chosen(few, emit.join(F.broadcast(few.select("id", "h")), ["id", "h"], "left_semi"))
    windows = _judged(chosen(texts, emit), some, _chosen_windows(words, width), "word-windows", ranges)
    return anchors.unionByName(windows).where(F.col("kind") == SPAN).select("id", "h", "lo", "n")


def remove_repeats(docs: DataFrame, width: int = 400, carry: tuple[str, ...] = ("doc_id",), words: int | None = None) -> DataFrame:
    """Cut every byte out of ``text`` that a ``width``-byte string covers which also starts anywhere else.

    With ``words``, ``rest`` is also without the bytes that so many whole words cover which stand
    anywhere else too, however few bytes they are; the other columns follow ``width`` alone.

    ``docs`` needs doc_id (long) and text; returns a row per row: ``row`` (a struct of the columns
    ``carry``), n_bytes, n_removed, spans (array of start, end in bytes of the input: the maximal
    removed runs), kept (binary: the remaining bytes, perhaps no valid UTF-8 at the cuts) and rest (kept
    as text, without the passages of ``words`` and the bytes of broken characters; null where nothing was removed). Strings are judged on the input; occurrences may overlap or lie in one text, but never cross texts. Null
    and empty texts have no bytes and keep none; texts shorter than ``width`` stay whole; every one of
    several equal rows counts, so that equal texts of at least ``width`` bytes are removed in full.
    """
    fields = docs.select(*carry).schema.simpleString()
    beside = [c for c in carry if c != "text"] or list(carry)  # the text goes along once
    docs = docs.select(F.struct(*beside).alias("row"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.xxhash64("text").alias("h"), "text")
    texts = docs.select("id", "h", "text")
    size = F.octet_length("text")
    long_ = texts.where(size >= width)
    # of rows that are equal in id and text, one stands for all, and all its windows are repeated
    more = long_.groupBy("id", "h").agg(F.count("*").alias("rows"), F.min(size).alias("bytes")).where("rows > 1").select("id", "h", F.lit(0).alias("lo"), (F.col("bytes") - width + 1).alias("n"))
    more = write_table(more, "equal-rows")
    count = texts.agg(F.count_if(size >= width).alias("long"), F.count("*").alias("all"), F.sum(F.when(size >= width, size)).alias("bytes")).first()
    ranges = min(_partitions(docs), 1 + (count["bytes"] or 0) // RANGE_BYTES)
    least = max(1000, SAMPLED_TEXTS * ranges)
    share, shorter = (1 + n // least for n in (count["long"], count["all"] - count["long"]))
    few = write_table(texts.where(one_in(F.when(size >= width, share).otherwise(shorter), "id", "h")), "few")
    if not more.isEmpty():
        long_ = long_.dropDuplicates(["id", "h"])

    ranked, same, once = dictionary(long_, few.where(size >= width), ranges)
    judged = write_table(parse_suffixes(ranked, same, once, width, share, ranges).mapInArrow(_lcp(width), _JUDGED), "regions")
    release(ranked)
    wanted = judged.where(F.col("kind") == EMIT).groupBy("id", "h").agg(F.collect_set(F.struct("lo", "n", "at")).alias("regions"))
    chosen = long_.join(wanted.hint("shuffle_hash"), ["id", "h"]).mapInArrow(_slices(width), _SLICES).unionByName(long_.mapInArrow(_bare_slices(width), _SLICES))
    slices, n_cut = write_counted(chosen, "slices", F.count_if(F.col("at") >= 0))

    cut = slices.where("at >= 0")
    blocks = _judged(cut, cut.where(one_in(1 + n_cut // least, "id", "h", "lo")), _blocks(width), "blocks", ranges)
    wanted = blocks.where(F.col("kind") == EMIT).groupBy("id", "h", "at").agg(F.collect_set(F.struct("lo", "n")).alias("blocks"))
    name = (F.shiftleft(F.col("lo").cast("long"), 32).bitwiseOR(F.col("n").cast("long"))).alias("at")  # of a region, as in _blocks
    bare = slices.where("at < 0").select("id", "h", "lo", "text", F.array(F.struct("lo", "n")).alias("blocks"))
    rims = slices.where("at >= 0").select("id", "h", "lo", "text", name).join(wanted.hint("shuffle_hash"), ["id", "h", "at"]).drop("at").unionByName(bare)
    windows = write_table(rims.mapInArrow(_windows(width), "window long, other long, weight int, id long, h long, lo int, n int"), "windows")
    again = windows.where("window is not null").groupBy("window", "other").agg(F.sum("weight").alias("w")).where("w > 1").select("window", "other")
    found = windows.where("weight = 1").join(again.hint("shuffle_hash"), ["window", "other"]).unionByName(windows.where("window is null"))
    found = write_table(found.select("id", "h", "lo", "n"), "found")
    release(slices, windows)

    repeats = judged.unionByName(blocks).where(F.col("kind") == SPAN).select("id", "h", "lo", "n").unionByName(found).unionByName(more).withColumn("passage", F.lit(False))
    if words:
        repeats = repeats.unionByName(_repeated_words(texts, few, words, width, ranges).withColumn("passage", F.lit(True)))
    repeats = repeats.groupBy("id", "h").agg(F.collect_list(F.struct("lo", "n", "passage")).alias("repeats"))
    none = F.expr("cast(array() as array<struct<lo:int,n:int,passage:boolean>>)")
    all_ = docs.join(repeats.hint("shuffle_hash"), ["id", "h"], "left").select("row", "text", F.coalesce("repeats", none).alias("repeats"))
    return all_.mapInArrow(_cut(width, carry), f"row {fields}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary, rest string")
