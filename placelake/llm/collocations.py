"""Phrase collocation mining by hierarchical pair naming.

Texts become sequences of names. On the first level a name stands for a frequent word of a language;
on level k every two adjacent names of level k-1, that is of two phrases of k-1 words that overlap in
k-2, are replaced by the name of their pair, if the pair is frequent in the whole corpus. Names are
given by one join over the cluster, so that equal phrases have one name everywhere. The pair's two
names are its parents: the phrase without its last and without its first word. Down the parents lie all
parts that a cut can give, and the children of a phrase are the longer phrases that it stands in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelake.llm import bytehash as bh
from placelake.llm.shared import byte_arrays, chunks, release, write_table

LONGEST = 4
LEAST = 30
SUBSUMED_PERCENT = 80
SCALE = 2_000_000
TOP = 2000
TEXT_BYTES = 1 << 21
"""Bytes of text in one sequence; a longer text is one alone."""
PIECE_NAMES = 1 << 14
"""Names in one row of a table of sequences, so that neither a file's pages nor a batch of its rows grow large; a row is cut between pieces of text only."""
BLOCK_BYTES = 1 << 24
"""Bytes of sequences that a reader of their files holds at once."""
BROADCAST_PAIRS = 1 << 20
"""Up to so many frequent pairs (24 bytes each) are sent to all tasks; more are joined to the sequences."""

_GAP = np.array([-1], np.int64)
_BREAK, _WORD = np.zeros(256, bool), np.ones(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_WORD[[ord(c) for c in ".,;:!?\n\x0b\x0c\r \t"]] = False


def _sequence(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``codes`` with a -1 before each place that is marked in ``starts``."""
    at = np.arange(len(codes)) + np.cumsum(starts)
    out = np.full(len(codes) + int(starts.sum()), -1, np.int64)
    out[at] = codes
    return out


_CODED = ["chunk", "codes", "code", "lang", "word", "n"]


def _coded(text_bytes: int):
    """For each chunk of texts a row with the sequence of its words' places in the chunk's own dictionary, where -1 parts pieces, and a row (code, lang, word, n) per word of that dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for whole in batches:
            for part in chunks(whole, "text", text_bytes):
                data, offsets = byte_arrays(part.column("text"))
                low = bh.LOWER[data]
                member = _WORD[low]
                start, end = bh.spans(member, offsets)
                if not len(start):
                    continue
                row = np.searchsorted(offsets, start, "right") - 1
                piece = np.concatenate([[0], np.cumsum(_BREAK[low])])[start]
                starts = np.ones(len(start), bool)
                starts[1:] = (row[1:] != row[:-1]) | (piece[1:] != piece[:-1])
                words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)), pa.py_buffer(low[member])])
                words, langs = words.dictionary_encode(), part.column("lang").dictionary_encode()
                size = len(words.dictionary)
                key = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row] * size + words.indices.to_numpy(zero_copy_only=False)
                key, codes, count = np.unique(key, return_inverse=True, return_counts=True)
                sequence = _sequence(codes, starts).astype(np.int32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sequence], pa.binary()), *(pa.nulls(1, kind) for kind in (pa.int32(), pa.string(), pa.string(), pa.int64()))], _CODED)
                chunk, places = pa.array(np.full(len(key), number, np.int64)), pa.array(np.arange(len(key), dtype=np.int32))
                lang, word = langs.dictionary.take(pa.array(key // size)), words.dictionary.cast(pa.string()).take(pa.array(key % size))
                yield pa.RecordBatch.from_arrays([chunk, pa.nulls(len(key), pa.binary()), places, lang, word, pa.array(count.astype(np.int64))], _CODED)
                number += 1

    return run


def _squeezed(names: np.ndarray) -> np.ndarray:
    """``names`` without a -1 that follows another or stands first."""
    gap = names < 0
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    return names[keep]


def _rows(chunk: int, names: np.ndarray, piece: int) -> list[tuple[int, bytes]]:
    """The rows of a sequence, cut at the first -1 after each ``piece`` names."""
    gaps = np.flatnonzero(names < 0)
    at = np.searchsorted(gaps, np.arange(piece, len(names), piece))
    return [(chunk, x.tobytes()) for x in np.split(names, np.unique(gaps[at[at < len(gaps)]])) if len(x)]


def _sequences(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["chunk", "names"])


def _stored(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(chunk, names) of the rows of a table of sequences; rows of one chunk that follow each other come as one."""
    chunk, names = batch.column("chunk").to_numpy(), batch.column("names")
    for run in np.split(np.arange(len(chunk)), np.flatnonzero(np.diff(chunk)) + 1):
        parts = [np.frombuffer(names[r].as_buffer(), np.int64) for r in run.tolist()]
        if parts:
            yield int(chunk[run[0]]), np.concatenate([x for part in parts for x in (_GAP, part)])


def _named_words(piece: int):
    def run(codes: pa.Table, found: pa.Table) -> pa.Table:
        rows = []
        for chunk, code in zip(codes.column("chunk").to_pylist(), codes.column("codes"), strict=True):
            places = np.frombuffer(code.as_buffer(), np.int32)
            name = np.full(int(places.max(initial=-1)) + 2, -1, np.int64)  # the last place is that of -1
            name[found.column("code").to_numpy()] = found.column("id").to_numpy()
            rows += _rows(chunk, _squeezed(name[places]), piece)
        return pa.Table.from_batches([_sequences(rows)])

    return run


def _adjacent(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs in a sequence, and their two names."""
    at = np.flatnonzero((names[:-1] >= 0) & (names[1:] >= 0))
    return at, names[at], names[at + 1]


def _distinct(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and how often each occurs."""
    known, codes = np.unique(np.concatenate([left, right]), return_inverse=True)
    key, count = np.unique(codes[: len(left)] * len(known) + codes[len(left) :], return_counts=True)
    return (known[key // len(known)], known[key % len(known)], count) if len(known) else (left, right, left)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, left, right, n): the distinct pairs of each sequence."""
    for batch in batches:
        for number, names in _stored(batch):
            _, left, right = _adjacent(names)
            left, right, n = _distinct(left, right)
            chunk = pa.array(np.full(len(left), number, np.int64))
            yield pa.RecordBatch.from_arrays([chunk, pa.array(left), pa.array(right), pa.array(n.astype(np.int64))], ["chunk", "left", "right", "n"])


class _Names:
    """Names of pairs: sorted by (left, right)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, name: np.ndarray):
        order = np.lexsort((right, left))
        self.known = np.unique(np.concatenate([left, right]))
        self.key = self._code(left[order]) * len(self.known) + self._code(right[order])
        self.name = name[order]

    def _code(self, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.known, x)

    def of(self, names: np.ndarray) -> np.ndarray:
        """The names of the pairs in a sequence, at the place of their first word; -1 where there is none."""
        out = np.full(max(0, len(names) - 1), -1, np.int64)
        at, left, right = _adjacent(names)
        if len(at) and len(self.key):
            a, b = (np.minimum(self._code(x), len(self.known) - 1) for x in (left, right))
            key = a * len(self.known) + b
            place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            good = (self.key[place] == key) & (self.known[a] == left) & (self.known[b] == right)
            out[at[good]] = self.name[place[good]]
        return _squeezed(out)


def _named_by(shared, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _Names(*shared.value)
        for batch in batches:
            for chunk, x in _stored(batch):
                yield _sequences(_rows(chunk, names.of(x), piece))

    return run


def _named_pairs(piece: int):
    def run(stored: pa.Table, found: pa.Table) -> pa.Table:
        names = _Names(*(found.column(c).to_numpy() for c in ("left", "right", "id")))
        rows = [row for batch in stored.to_batches() for chunk, x in _stored(batch) for row in _rows(chunk, names.of(x), piece)]
        return pa.Table.from_batches([_sequences(rows)])

    return run


_NAMES = "chunk long, names binary"


def _write_names(df: DataFrame) -> DataFrame:
    return write_table(df, "names", {"parquet.block.size": BLOCK_BYTES})


def _next_level(sequences: DataFrame, pairs: DataFrame, frequent: DataFrame, most: int, piece: int) -> DataFrame:
    """The sequences of the names of pairs. Few frequent pairs are sent to all tasks, many are joined to the distinct pairs of each sequence, which meet it chunk by chunk."""
    rows = frequent.select("left", "right", "id")
    if frequent.count() <= most:
        table = rows.toArrow()
        shared = sequences.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("left", "right", "id")))
        return sequences.mapInArrow(_named_by(shared, piece), _NAMES)
    found = pairs.join(rows, ["left", "right"]).select(F.col("chunk").alias("of"), "left", "right", "id")
    return sequences.groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(_named_pairs(piece), _NAMES)


def _with_id(df: DataFrame) -> DataFrame:
    return df.withColumn("id", F.monotonically_increasing_id())


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, broadcast_pairs: int = BROADCAST_PAIRS, text_bytes: int = TEXT_BYTES, piece_names: int = PIECE_NAMES) -> tuple[DataFrame, list[DataFrame]]:
    """``(lang, n)``, the words of each language, and for each length a table of the phrases found ``least`` times or more.

    The tables have id, lang, a (occurrences), phrase, last (its last word), first_n and last_n (how often the
    first and the last 1, 2, ... words of it occur) and, from two words on, the ids left and right of its parents.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    coded = write_table(texts.mapInArrow(_coded(text_bytes), "chunk long, codes binary, code int, lang string, word string, n long"), "coded")
    entries = coded.where("code IS NOT NULL").select("chunk", "code", "lang", "word", "n")
    words = write_table(entries.groupBy("lang", "word").agg(F.sum("n").alias("a")), "words")
    totals = write_table(words.groupBy("lang").agg(F.sum("a").alias("n")), "totals")
    counts = F.array("a")
    level = write_table(_with_id(words.where(F.col("a") >= least)).select("id", "lang", "a", F.col("word").alias("phrase"), F.col("word").alias("last"), counts.alias("first_n"), counts.alias("last_n"), "word"), "frequent")
    found = entries.join(level.select("id", "lang", "word"), ["lang", "word"]).select(F.col("chunk").alias("of"), "code", "id")
    # what a chunk has meets it sorted, group by group: no list of a chunk's words is held beside others
    codes = coded.where("codes IS NOT NULL").select("chunk", "codes")
    sequences = _write_names(codes.groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(_named_words(piece_names), _NAMES))
    release(coded, words)
    levels = [level.drop("word")]
    for k in range(2, longest + 1):
        pairs = sequences.mapInArrow(_pairs, "chunk long, left long, right long, n long")
        often = write_table(_with_id(pairs.groupBy("left", "right").agg(F.sum("n").alias("a")).where(F.col("a") >= least)), "pairs")
        before = levels[-1]
        left = before.select(F.col("id").alias("left"), "lang", "phrase", "first_n")
        right = before.select(F.col("id").alias("right"), "last", "last_n")
        own = F.array("a")
        named = often.join(left, "left").join(right, "right").select(
            "id", "lang", "a", F.concat("phrase", F.lit(" "), "last").alias("phrase"), "last", F.concat("first_n", own).alias("first_n"), F.concat("last_n", own).alias("last_n"), "left", "right",
        )
        levels.append(write_table(named, "frequent"))
        if k < longest:
            used, sequences = sequences, _write_names(_next_level(sequences, pairs, often, broadcast_pairs, piece_names))
            release(used)
    release(sequences)
    return totals, levels


def _cut(length: int, scale: int) -> Column:
    """(score, k, l, r) of the lowest-scoring cut of a phrase of ``length`` words, the first of equal ones; products are decimals."""

    def at(k: int) -> Column:
        l, r = F.col("first_n")[k - 1], F.col("last_n")[length - k - 1]  # noqa: E741
        score = F.expr(f"CAST({scale} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(19,0)) DIV (CAST(first_n[{k - 1}] AS DECIMAL(19,0)) + CAST(last_n[{length - k - 1}] AS DECIMAL(19,0)))")
        return F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r"))

    cuts = [at(k) for k in range(1, length)]
    return F.least(*cuts) if len(cuts) > 1 else cuts[0]


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, subsumed_percent: int = SUBSUMED_PERCENT, scale: int = SCALE, broadcast_pairs: int = BROADCAST_PAIRS, text_bytes: int = TEXT_BYTES, piece_names: int = PIECE_NAMES) -> DataFrame:
    """Phrases of 2 to ``longest`` words found ``least`` times or more, with the score of their weakest cut.

    ``docs`` needs lang (null: und) and text (null: empty). A-Z count as a-z; pieces end at ``.,;:!?`` and line
    ends, words at blanks and tabs, and no phrase crosses a piece. Returns lang, phrase, a, l, r (how often the
    two parts occur), n (words of the language) and score, ``floor(scale * a / (l + r))``, for all phrases but those
    that stand inside a longer one, kept or not, of at least ``subsumed_percent`` of their occurrences. As a phrase is no
    more frequent than what it contains, the longer ones by one word tell. Repeated rows count each; no rows give none.
    """
    totals, levels = frequent_phrases(docs, longest, least, broadcast_pairs, text_bytes, piece_names)
    out = None
    for k in range(2, longest + 1):
        level = levels[k - 1]
        if k < longest:
            longer = levels[k]
            over = longer.select(F.col("left").alias("id"), F.col("a").alias("inner_a")).unionByName(longer.select(F.col("right").alias("id"), F.col("a").alias("inner_a")))
            level = level.join(over.groupBy("id").agg(F.max("inner_a").alias("inner_a")), "id", "left")
            wide = lambda c, n: F.lit(n).cast("decimal(10,0)") * F.col(c).cast("decimal(19,0)")
            level = level.where(F.coalesce(wide("inner_a", 100) < wide("a", subsumed_percent), F.lit(True)))
        rows = level.withColumn("cut", _cut(k, scale)).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        out = rows if out is None else out.unionByName(rows)
    return out.join(F.broadcast(totals) if totals.count() <= 10000 else totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def top(phrases: DataFrame, most: int = TOP) -> DataFrame:
    """The first ``most`` phrases of each language by score and a, both descending, and phrase; rank counts from 1. Spark cuts each task's rows before it shuffles them."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return phrases.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).withColumn("rank", F.col("rank").cast("long"))
