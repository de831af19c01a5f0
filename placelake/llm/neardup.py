"""MinHash-style near-duplicate detection with SetSketch registers.

Every distinct text is a vertex. Its set of word shingles is sketched into registers: register j is
``floor(1 - log_b(m_j))``, m_j being the least of the set's exponential draws, truncated to
``0 .. q + 1``. Sketches of parts merge by the maximum, and two registers are equal with nearly the
Jaccard similarity as probability, so that four of them make the key of a band. Candidates that
share a band are judged jointly by the likelihood of how many registers are greater, smaller and
equal given both set sizes, and those that might reach the threshold are verified on full sets.

No bucket emits all its pairs. First a bucket's members meet its pivot, the member that shares the
most buckets with others, and each goes on with its best pivot. Where these links leave several
components in a bucket, every member outside the bucket's largest component meets all members of
other components, block by block, by sketches first, and only links are put out. So no two documents that share a band
and end in different components remain untested.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelake.llm import bytehash as bh
from placelake.llm.components import components
from placelake.llm.shared import byte_arrays, chunks, release, write_counted, write_table

REGISTERS = 128
ROWS_PER_BAND = 4
BASE = 1.001
RATE = 20.0
TOP = 2**16 - 2
"""Registers hold 0 .. TOP + 1, in 16 bits."""
ESTIMATE_SLACK = 0.2
"""Candidates whose estimate lies this far under the threshold aren't verified: over five standard deviations with 128 registers."""
EDGES_PER_TASK = 64
"""Members that meet one copy of a pivot's set; a pivot with more of them is copied."""

BLOCK = 256
MOST_COMMON = 4000
"""There are at most so many texts with more than one in MOST_COMMON of all rows."""

_MULTIPLIERS = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, REGISTERS, dtype=np.uint64)
_PLACE = np.random.Generator(np.random.PCG64(13)).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of ``width`` words, A-Z lower-cased.

    With fewer words the whole sequence is one shingle; without words the set is empty.
    """
    data, offsets = byte_arrays(column)
    data = bh.LOWER[data]
    start, end, of = bh.words(data, offsets)
    word = bh.range_hash(bh.prefix_sums(data), start, end)
    n = max(0, len(word) - width + 1)
    shingle = np.zeros(n, np.uint64)
    for k in range(width):
        shingle += word[k : k + n] * _PLACE[k]
    shingle = bh.mix(shingle)
    for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(shingle[a : b - width + 1])
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for k in range(a, b):
                    h = h * np.uint64(0x2545F4914F6CDD1D) + word[k]
            yield bh.mix(np.array([h], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The SetSketch of a set of hashes, zeros for an empty one; the union's sketch is the greater of each register."""
    if not len(hashes):
        return np.zeros(REGISTERS, np.uint16)
    least = np.full(REGISTERS, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 512):
        np.minimum(least, (hashes[i : i + 512, None] * _MULTIPLIERS + _SHIFTS).min(axis=0), out=least)
    draw = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(draw) / math.log(BASE)), 0, TOP + 1).astype(np.uint16)


def estimate(greater: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The most likely Jaccard similarities, given how many registers of a are greater and smaller than b's and the set sizes.

    A register of a is greater with probability p(u - v J) and smaller with p(v - u J), where u and v
    are the shares of the sizes and p(x) = -log_b(1 - x (b - 1) / b). The maximum is taken on a grid.
    """
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    top = np.minimum(u / v, v / u)
    equal = REGISTERS - greater - smaller
    best, out = np.full(len(u), -np.inf), np.zeros(len(u))
    for step in np.linspace(0, 1, 101):
        j = step * top
        p = -np.log1p(-np.maximum(u - v * j, 0) * (BASE - 1) / BASE) / math.log(BASE)
        m = -np.log1p(-np.maximum(v - u * j, 0) * (BASE - 1) / BASE) / math.log(BASE)
        tiny = 1e-12
        like = greater * np.log(p + tiny) + smaller * np.log(m + tiny) + equal * np.log(np.maximum(1 - p - m, 0) + tiny)
        out, best = np.where(like > best, j, out), np.maximum(best, like)
    return out


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                sizes, sketches = [], []
                for s in shingle_sets(part.column("text"), width):
                    sizes.append(len(s))
                    sketches.append(registers(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("vid"), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())], ["doc_id", "vid", "n", "regs"])

    return run


def _likely(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb"))
            j = estimate((a > b).sum(1), (a < b).sum(1), na, nb)
            yield batch.select(["a", "b", "bands"]).filter(pa.array((j >= threshold - ESTIMATE_SLACK) & (np.minimum(na, nb) >= (threshold - 1e-9) * np.maximum(na, nb))))

    return run


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Of two full sets, sorted and distinct."""
    if not len(a) or not len(b):
        return False
    both = int(np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            for part in chunks(batch, "text"):
                found = []
                rows = zip(part.column("b").to_pylist(), part.column("a").to_pylist(), part.column("member").to_pylist(), shingle_sets(part.column("text"), width), strict=True)
                for b, a, member, s in rows:
                    if not member:
                        pivot, own = b, s
                    elif pivot == b:
                        if _similar(own, s, percent):
                            found.append((a, b))
                yield _pairs(found)

    return run


PAIRS_AT_ONCE = 1 << 15


def _met(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Of rows sorted by (key, block, visitor): batches with pairs of rows in them, a visitor and one of its block's own members, that may be similar.

    A pair is judged only in the first of the bands that it shares. The own members of the last block go on to the next batch.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = pa.concat_batches([held, batch]) if held is not None else batch
        old = held.num_rows if held is not None else 0
        key, block, band, v, root, n = (x.column(c).to_numpy() for c in ("key", "block", "band", "v", "root", "n"))
        visitor, minor = (x.column(c).to_numpy(zero_copy_only=False) for c in ("visitor", "minor"))
        sketch = np.frombuffer(b"".join(x.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])]))
        group = np.cumsum(np.bincount(head, minlength=len(key))) - 1
        own = np.bincount(group, weights=~visitor).astype(np.int64)  # they come first
        who = np.flatnonzero(visitor & (np.arange(len(key)) >= old))
        many = own[group[who]]
        part = np.cumsum(many) // PAIRS_AT_ONCE
        for some in np.split(np.arange(len(who)), np.flatnonzero(np.diff(part)) + 1):
            k = many[some]
            a = np.repeat(who[some], k)
            b = head[group[a]] + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
            fit = (root[a] != root[b]) & (~minor[b] | (v[b] > v[a])) & (np.minimum(n[a], n[b]) >= (threshold - 1e-9) * np.maximum(n[a], n[b]))
            a, b = a[fit], b[fit]
            first = (sketch[a] == sketch[b]).reshape(len(a), -1, ROWS_PER_BAND).all(axis=2).argmax(axis=1) == band[a]
            a, b = a[first], b[first]
            if len(a):
                j = estimate((sketch[a] > sketch[b]).sum(1), (sketch[a] < sketch[b]).sum(1), n[a].astype(float), n[b].astype(float))
                a, b = a[j >= threshold - ESTIMATE_SLACK], b[j >= threshold - ESTIMATE_SLACK]
            if len(a):
                yield x, a, b
        last = head[-1]
        held = x.slice(last, own[-1])


def _likely_mates(percent: int):
    """The vertices, perhaps more than once, that have a likely mate of another component in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, a, b in _met(batches, percent / 100):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(x.column("v").to_numpy()[np.concatenate([a, b])]))], ["v"])

    return run


def _blocks(width: int, percent: int):
    """Every visitor meets its block's own members; the links of likely pairs on full sets go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets = None, {}
        for x, a, b in _met(batches, percent / 100):
            if at is not x:
                at, sets = x, {}
            new = [i for i in np.unique(np.concatenate([a, b])).tolist() if i not in sets]
            sets.update(zip(new, shingle_sets(x.column("text").take(pa.array(new, pa.int64())), width), strict=True))
            v = x.column("v").to_numpy()
            good = np.array([_similar(sets[i], sets[j], percent) for i, j in zip(a.tolist(), b.tolist(), strict=True)], bool)
            yield pa.RecordBatch.from_arrays([pa.array(v[a[good]]), pa.array(v[b[good]])], ["a", "b"])

    return run


def _with_common(rows: DataFrame, side: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined with ``side``, which has each ``key`` once and in ``size`` how many rows have it, ``total`` in all.

    The keys of more than one in MOST_COMMON of all rows, which are fewer than MOST_COMMON, are joined by broadcast, so that
    no task of the other join gets a great part of the rows.
    """
    many = total // MOST_COMMON
    common = F.broadcast(side.where(F.col(size) > many).select(key, F.struct(*(c for c in side.columns if c != key)).alias("__common")))
    flagged = rows.join(common, key, "left")
    often = flagged.where("__common is not null").select(*rows.columns, *(F.col("__common").getField(c).alias(c) for c in side.columns if c != key))
    rare = flagged.where("__common is null").drop("__common").join(side.where(F.col(size) <= many), key)
    return rare.select(often.columns).unionByName(often)


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def _band_keys() -> Column:
    size = 2 * ROWS_PER_BAND
    bands = F.sequence(F.lit(0), F.lit(REGISTERS // ROWS_PER_BAND - 1))
    return F.transform(bands, lambda i: F.xxhash64(i, F.substring(F.col("regs"), i * size + 1, F.lit(size))))


class _Links:
    """Candidate pairs in, verified links out."""

    def __init__(self, docs: DataFrame, vertices: DataFrame, width: int, percent: int):
        self.docs, self.vertices, self.width, self.percent = docs, vertices, width, percent

    def likely(self, pairs: DataFrame) -> DataFrame:
        one, two = (self.vertices.select(F.col("v").alias(c), F.col("n").alias(f"n{c}"), F.col("regs").alias(f"r{c}")) for c in "ab")
        return pairs.join(one, "a").join(two, "b").mapInArrow(_likely(self.percent / 100), "a long, b long, bands long")

    def texts(self, need: DataFrame) -> DataFrame:
        """(v, text) of the vertices ``need(v)``, each from one row of its class."""
        need = self.vertices.join(need, "v").select("v", "vid", F.col("rep_key").alias("doc_key"))
        return self.docs.join(need, ["vid", "doc_key"]).select("v", "text")

    def verified(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """The links among ``pairs(a, b)``, b being the side with many partners."""
        load = pairs.groupBy("b").agg(F.ceil(F.count("*") / EDGES_PER_TASK).alias("parts"))
        e = pairs.join(load, "b").select("a", "b", F.expr("pmod(xxhash64(a), parts)").alias("part"))
        members = e.join(texts.withColumnRenamed("v", "a"), "a").select("b", "part", F.lit(True).alias("member"), "a", "text")
        pivots = e.select("b", "part").distinct().join(texts.withColumnRenamed("v", "b"), "b").select("b", "part", F.lit(False).alias("member"), F.col("b").alias("a"), "text")
        rows = members.unionByName(pivots).repartition("b", "part").sortWithinPartitions("b", "part", "member")
        return write_table(rows.mapInArrow(_verify(self.width, self.percent), "a long, b long").distinct(), "links")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """Groups of near-duplicate documents.

    ``docs`` needs doc_id (long) and text; other columns are ignored. Returns a row per row of
    ``docs``: doc_id, n_shingles, component_id, kept and text_key (the text's MD5). Documents are linked when
    ``100 * |A & B| >= percent * |A | B|`` over their shingle sets, component_id is the smallest doc_id
    reachable over links, kept says that this is the document's own.

    Texts that are null, empty or without words have no shingles and are linked with nothing. Rows
    with one doc_id and different texts are separate documents in the search; rows with equal texts
    are always linked. A null doc_id takes part but never names a group: its row is kept only if its
    whole group has no doc_id. A pair at the threshold shares one of the 32 bands with probability
    1 - 5e-6, a more similar one with a greater one.
    """
    docs = docs.select("doc_id", "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("vid"))
    sketched = write_table(docs.mapInArrow(_sketch(width), "doc_id long, vid binary, n long, regs binary"), "sketches")
    rep = F.min(F.coalesce("doc_id", F.lit(-(2**63))))
    vertices = sketched.where("n > 0").groupBy("vid").agg(rep.alias("rep_key"), F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.count("*").alias("copies"))
    vertices = write_table(vertices.withColumn("v", F.monotonically_increasing_id()), "vertices")
    work = _Links(docs.withColumn("doc_key", F.coalesce("doc_id", F.lit(-(2**63)))), vertices, width, percent)

    rows = vertices.select("v", F.posexplode(_band_keys()).alias("band", "key"))
    shared, total = write_counted(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared", F.sum("size"))
    hits = write_table(_with_common(rows, shared, "key", "size", total).select("key", "band", "v", "size"), "buckets")
    texts = write_table(work.texts(hits.select("v").distinct()), "texts")

    degree = hits.groupBy("v").agg(F.sum("size").alias("degree"))
    pivot = hits.join(degree, "v").groupBy("key").agg(F.max(F.struct("degree", (-F.col("v")).alias("minus"))).alias("p"), F.count("*").alias("members"))
    pivot = write_table(pivot.select("key", (-F.col("p.minus")).alias("b"), "members"), "pivots")
    pairs = _with_common(hits, pivot, "key", "members", total).where("v <> b").groupBy(F.col("v").alias("a"), "b").agg(F.count("*").alias("bands"))
    likely = work.likely(pairs).select("a", "b", "bands")
    best = write_table(likely.groupBy("a").agg(F.max(F.struct("bands", (-F.col("b")).alias("minus"))).alias("p")).select("a", (-F.col("p.minus")).alias("b")), "best")
    links = work.verified(best, texts)
    roots = components(links)
    rooted = write_table(hits.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v")), "rooted")
    release(shared, pivot, hits, best, roots)

    more = _across(rooted, vertices, texts, width, percent)
    release(rooted, texts)
    labels = components(links.unionByName(more))

    groups = vertices.join(labels, "v", "left").select("vid", "rep", "copies", F.coalesce("root", "v").alias("root"))
    first = groups.groupBy("root").agg(F.min("rep").alias("component_id"))
    groups, total = write_counted(groups.join(first, "root").select("vid", "copies", "component_id"), "groups", F.sum("copies"))
    release(vertices, links, more, labels)
    rows = sketched.select("doc_id", "vid", F.col("n").alias("n_shingles"))
    worded = _with_common(rows.where("n_shingles > 0"), groups, "vid", "copies", total).select("vid", "doc_id", "n_shingles", "component_id")
    bare = rows.where("n_shingles = 0").select("vid", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = worded.unionByName(bare)  # texts without words have no group
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), F.col("vid").alias("text_key"))


def _across(rooted: DataFrame, vertices: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between bucket mates of different components; at least one of them is outside its bucket's largest component.

    The buckets are gone through with sketches alone first; only the vertices with a likely mate go on to a second pass with their texts.
    """
    parts = rooted.groupBy("key", "root").agg(F.count("*").alias("n"))
    major = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("members")).where("parts > 1")
    major, total = write_counted(major.select("key", F.col("m.root").alias("major"), "members"), "majors", F.sum("members"))
    rows = write_table(_with_common(rooted, major, "key", "members", total).select("key", "band", "v", "root", (F.col("root") != F.col("major")).alias("minor"), "size"), "divided")

    def met(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("blocks", F.ceil(F.col("size") / BLOCK)).drop("size")
        own = rows.withColumn("block", F.expr("pmod(xxhash64(v), blocks)")).withColumn("visitor", F.lit(False))
        visit = rows.where("minor").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("visitor", F.lit(True))
        return own.unionByName(visit).drop("blocks").repartition("key", "block").sortWithinPartitions("key", "block", "visitor")

    sketches = vertices.select("v", "n", "regs")
    likely = write_table(met(rows.join(sketches, "v")).mapInArrow(_likely_mates(percent), "v long").distinct(), "mates")
    mated, total = write_counted(rows.join(likely, "v").drop("size"), "mated", F.count("*"))
    sizes = mated.groupBy("key").agg(F.count("*").alias("size"))
    sized = write_table(_with_common(mated, sizes, "key", "size", total), "sized")
    more = write_table(met(sized.join(sketches, "v").join(texts, "v")).mapInArrow(_blocks(width, percent), "a long, b long").distinct(), "more")
    release(major, rows, likely, mated, sized)
    return more
