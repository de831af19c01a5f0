"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised byte by byte (A-Z lower-cased, what is no word sign to a space, spaces merged),
so that every match ends at the end of a word whose place in the original text is known. The
automaton holds all windows of the benchmark's items and reads every text once.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelake.llm import bytehash as bh
from placelake.llm.shared import byte_arrays

AUTOMATON_BYTES = 32 << 20
"""Bytes of item texts that one automaton may hold; a larger benchmark goes through several, one after the other."""

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_NORMAL = bytes(c if _WORD[c] else 0x20 for c in bh.LOWER.tolist())


def normal_words(text: bytes) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text, A-Z lower-cased."""
    return text.translate(_NORMAL).split()


@functools.lru_cache(maxsize=2)
def _automaton(_: bytes, items: tuple[tuple[str, bytes], ...], width: int):
    import ahocorasick

    windows: dict[str, set[str]] = {}
    for item, text in items:
        words = normal_words(text)
        for i in range(max(len(words) - width + 1, min(len(words), 1))):
            windows.setdefault(" " + b" ".join(words[i : i + width]).decode("latin-1") + " ", set()).add(item)
    found = ahocorasick.Automaton()
    for window, own in windows.items():
        found.add_word(window, (window.count(" ") - 1, frozenset(own)))
    if windows:
        found.make_automaton()
    return found if windows else None


def _scan(shared: Broadcast, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, items = shared.value
        automaton = _automaton(key, items, width)
        for batch in batches:
            data, offsets = byte_arrays(batch.column("text"))
            raw, n_words, hits, found = data.tobytes(), [], [], []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                words = raw[a:b].translate(_NORMAL).split()
                n_words.append(len(words))
                text = f" {b' '.join(words).decode('latin-1')} "
                matches = list(automaton.iter(text)) if automaton and words else ()
                ranges, own = [], set()
                if matches:
                    ends = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 0x20)
                    last = np.searchsorted(ends, [m[0] for m in matches]).tolist()
                    for stop, (_, (count, names)) in zip(last, matches, strict=True):
                        own |= names
                        if ranges and stop - count <= ranges[-1][1]:
                            while ranges and stop - count <= ranges[-1][1]:
                                count = max(count, stop - ranges.pop()[0])
                        ranges.append((stop - count, stop))
                old, names = batch.column("hits")[i].as_py(), batch.column("items")[i].as_py()
                if old:
                    merged: list[tuple[int, int]] = []
                    for x, y in sorted([*((r["first"], r["end"]) for r in old), *ranges]):
                        if merged and x <= merged[-1][1]:
                            merged[-1] = (merged[-1][0], max(y, merged[-1][1]))
                        else:
                            merged.append((x, y))
                    ranges = merged
                places = []
                if ranges:
                    piece = data[a:b]
                    start, end = bh.spans(_WORD[bh.LOWER[piece]], np.array([0, b - a]))
                    signs = np.concatenate([[0], np.cumsum((piece & 0xC0) != 0x80)])
                    places = [{"first": x, "end": y, "start_char": int(signs[start[x]]), "end_char": int(signs[end[y - 1]])} for x, y in ranges]
                hits.append(places)
                found.append(sorted(own.union(names)))
            kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(n_words, pa.int64()), pa.array(hits, kind), pa.array(found, pa.list_(pa.string()))], ["row", "text", "n_words", "hits", "items"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, percent: int = 5, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Find the words of ``docs`` that occurrences of the benchmark's windows cover.

    ``docs`` needs text, ``benchmark`` item_id and text. A window is ``width`` consecutive words of an
    item, or all words of a shorter one. Returns a row per row of ``docs``: ``row`` (struct of the columns
    ``carry``), text, n_words, hits (array of word ranges first, end with start_char, end_char in the
    original text), n_hit, items (ids of the items that occur, as strings in order), contaminated
    (``n_hit > 0 and 100 * n_hit >= percent * n_words``). Null and empty texts have no words and are
    clean; null and empty items have no windows; an item without id is named ''. Repeated rows and
    items count alike; an empty benchmark finds nothing.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // AUTOMATON_BYTES) or 1
    none = "cast(array() as array<struct<first:long,end:long,start_char:long,end_char:long>>)"
    out = docs.select(F.struct(*carry).alias("row"), "text", F.expr("0L as n_words"), F.expr(f"{none} as hits"), F.expr("cast(array() as array<string>) as items"))
    schema = out.schema
    for k in range(blocks):
        # a hash deals the items to blocks of about the size that the bound allows
        own = tuple(sorted((r.item, bytes(r.text)) for r in items.where(F.expr(f"pmod(xxhash64(item, text), {blocks}) = {k}")).collect()))
        key = hashlib.sha256(repr(own).encode()).digest()
        out = out.mapInArrow(_scan(spark.sparkContext.broadcast((key, own)), width), schema)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["first"])
    return out.withColumn("n_hit", n_hit).withColumn("contaminated", F.expr(f"n_hit > 0 and 100 * n_hit >= {percent} * n_words"))
