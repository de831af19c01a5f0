"""Quality rules on repetition, from a suffix array of each text's words.

The suffix array of a text's words and its longest common prefixes give intervals of suffixes that
share a prefix; each is a repeated substring that can't be longer on the right, and one that can't
be longer on the left either is maximal. The union of the spans of those of at least ``shortest``
words is limited as a share of the text, and so is the longest of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelake.llm import bytehash as bh
from placelake.llm.shared import byte_arrays, chunks

SHORTEST = 8
MOST_COVERED = 0.30
SHORT = 3
MOST_SHORT = 0.50
"""At most this share of a text is in maximal repeats of SHORT words or more, which the base rules don't see."""
LONGEST = 200
"""Words; and at most half of the text."""

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_PLACE = np.random.Generator(np.random.PCG64(17)).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a sequence and the common prefix of each suffix with the one before it in order, by prefix doubling."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    levels, k = [rank], 1
    order = np.argsort(rank, kind="stable")
    while k < n and rank.max() < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        pair = rank * (n + 1) + after
        order = np.argsort(pair, kind="stable")
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(pair[order[1:]] != pair[order[:-1]])
        rank, k = new, 2 * k
        levels.append(rank)
    lcp = np.zeros(n, np.int64)
    if n > 1:
        a, b = order[:-1].copy(), order[1:].copy()
        for j in range(len(levels) - 1, -1, -1):
            inside = (a < n) & (b < n)
            x = np.where(inside, levels[j][np.minimum(a, n - 1)], -1)
            y = np.where(inside, levels[j][np.minimum(b, n - 1)], -2)
            step = np.where((x == y) & (a + (1 << j) <= n) & (b + (1 << j) <= n), 1 << j, 0)
            lcp[1:] += step
            a, b = a + step, b + step
    return order, lcp


_MIXED = -1
"""What stands on the left of an interval's suffixes, if not one symbol."""


def maximal_repeats(symbols: np.ndarray, shortest: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The suffix array, and (length, first, end) of each maximal repeated substring of at least ``shortest`` symbols: its occurrences are ``order[first:end]``.

    They are the LCP intervals whose suffixes differ on the left. What stands on the left of an
    interval is carried up from those below, so that all is linear in the symbols beyond the sort.
    """
    order, lcp = suffix_array(symbols)
    out: list[tuple[int, int, int]] = []
    ranks = np.unique(symbols, return_inverse=True)[1]
    left = np.where(order > 0, ranks[order - 1], _MIXED).tolist() if len(order) else []  # a text's start differs from everything
    values = [*lcp.tolist(), 0]
    stack: list[list[int]] = []  # length, first, what stands on the left
    for i in np.union1d(marks := np.flatnonzero(lcp >= shortest), marks + 1).tolist():
        v = values[i] if values[i] >= shortest else 0
        first, before = i - 1, left[i - 1]
        while stack and stack[-1][0] > v:
            length, first, before = stack.pop()
            if before == _MIXED:
                out.append((length, first, i))
            if stack and stack[-1][0] >= v and stack[-1][2] != before:
                stack[-1][2] = _MIXED
        if v and (not stack or stack[-1][0] < v):
            stack.append([v, first, before])
        if v and stack[-1][2] != left[i]:
            stack[-1][2] = _MIXED
    return order, out


def _spans(n: int, order: np.ndarray, repeats: list[tuple[int, int, int]]) -> np.ndarray:
    """For each suffix the longest of the repeats that it begins with, 0 where there is none; intervals nest, so a stack does."""
    longest = np.zeros(n, np.int64)
    # inner intervals are longer and were put out first; outer ones fill what is left of their range
    nxt = np.arange(n + 1).tolist()
    for length, first, end in repeats:
        i = first
        while True:
            while nxt[i] != i:
                nxt[i] = i = nxt[nxt[i]]
            if i >= end:
                break
            longest[order[i]] = length
            nxt[i] = i + 1
    return longest


def _covered(longest: np.ndarray, shortest: int) -> int:
    """Symbols in repeats of at least ``shortest``, given the longest repeat from each place on."""
    reach = np.maximum.accumulate(np.where(longest >= shortest, np.arange(len(longest)) + longest, 0))
    return int(np.count_nonzero(reach > np.arange(len(longest))))


def _measure(shortest: int, short: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                data, offsets = byte_arrays(part.column("text"))
                rows = len(offsets) - 1
                space = bh.SPACE[data]
                start, end, of = bh.words(data, offsets)
                sums = bh.prefix_sums(data)
                n_words = np.diff(of)

                def per_row(mask: np.ndarray, offsets: np.ndarray = offsets) -> np.ndarray:
                    return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])

                signs = per_row(((data & 0xC0) != 0x80) & ~space)
                symbols = per_row(_SYMBOL[data])

                # lines: cut at \n and at the ends of texts; those with a word, without the first of each kind
                cut = np.flatnonzero(data == 0x0A)
                line = np.union1d(cut + 1, offsets[:-1])
                line = line[line < len(data)]  # nothing follows a last \n, nor stands in an empty last text
                line_row = np.searchsorted(offsets, line, "right") - 1
                fits = line < offsets[line_row + 1]
                line, line_row = line[fits], line_row[fits]
                next_cut = np.append(cut, len(data))[np.searchsorted(cut, line)]
                stop = np.minimum(next_cut, offsets[line_row + 1])
                full = np.searchsorted(start, stop) > np.searchsorted(start, line)
                key = bh.mix(bh.range_hash(sums, line[full], stop[full]) + line_row[full].astype(np.uint64) * _PLACE[63])
                first = np.unique(key, return_index=True)[1]
                dup_lines = np.bincount(line_row[full], minlength=rows) - np.bincount(line_row[full][first], minlength=rows)

                word = bh.range_hash(sums, start, end)
                row = np.repeat(np.arange(rows), n_words)

                def in_repeats(size: int, word: np.ndarray = word, row: np.ndarray = row, of: np.ndarray = of, per_row=per_row) -> np.ndarray:
                    """Words in windows of ``size`` words that occur twice or more in their text."""
                    m = max(0, len(word) - size + 1)
                    window = np.zeros(m, np.uint64)
                    for k in range(size):
                        window += word[k : k + m] * _PLACE[k]
                    inside = row[:m] == row[size - 1 :][:m] if m else np.zeros(0, bool)
                    at = np.flatnonzero(inside)
                    key = bh.mix(window[at] + row[at].astype(np.uint64) * _PLACE[62])
                    order = np.argsort(key)
                    same = key[order[1:]] == key[order[:-1]] if len(order) else np.zeros(0, bool)
                    again = np.zeros(len(at), bool)
                    again[order[1:]] |= same
                    again[order[:-1]] |= same
                    step = np.zeros(len(word) + 1, np.int64)
                    np.add.at(step, at[again], 1)
                    np.add.at(step, at[again] + size, -1)
                    return per_row(np.cumsum(step[:-1]) > 0, of)

                repeated = in_repeats(shortest)
                covered, longest, short_covered = (np.zeros(rows, np.int64) for _ in range(3))
                for r in np.flatnonzero(in_repeats(short)).tolist():  # in others no interval reaches ``short``
                    spans = _spans(int(n_words[r]), *maximal_repeats(word[of[r] : of[r + 1]], short))
                    covered[r], short_covered[r], longest[r] = _covered(spans, shortest), _covered(spans, short), spans.max()
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), *(pa.array(x.astype(np.int64)) for x in (n_words, signs, symbols, dup_lines, repeated, covered, longest, short_covered))],
                    ["row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "short_covered"],
                )

    return run


def repetition_rules(docs: DataFrame, shortest: int = SHORTEST, most_covered: float = MOST_COVERED, longest: int = LONGEST, carry: tuple[str, ...] = ("doc_id",), short: int = SHORT, most_short: float = MOST_SHORT) -> DataFrame:
    """Measure the repetition in each text and judge it.

    ``docs`` needs text. Returns a row per row: ``row`` (struct of the columns ``carry``), n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words (in maximal repeats of at least
    ``shortest`` words), longest_repeat (words, of at least ``short``), short_covered (words in maximal
    repeats of at least ``short`` words), base_failed (fewer than 20 words, or over 30 % of them
    in windows of ``shortest`` words found twice or more) and kept. A text is kept if the base rules
    hold, at most ``most_covered`` of its words are in repeats, at most ``most_short`` of them in short ones too, and its longest repeat has at most
    ``longest`` words and is at most half of the text. Null and empty texts have no words and fail.
    Words are cut at ASCII white space and compared byte by byte; whole texts are read, however long.
    """
    row = F.struct(*carry).alias("row")
    kind = docs.select(row).schema["row"].dataType.simpleString()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "short_covered")
    out = docs.select(row, "text").mapInArrow(_measure(shortest, min(short, shortest)), f"row {kind}, " + ", ".join(f"{c} long" for c in columns))
    out = out.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
    good = (F.col("short_covered") <= most_short * F.col("n_words")) & (F.col("covered_words") <= most_covered * F.col("n_words")) & (F.col("longest_repeat") <= longest) & (2 * F.col("longest_repeat") <= F.col("n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & good)
