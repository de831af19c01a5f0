"""Brute-force versions, round trips and edge cases of the operators."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from placelake.llm import chat, decontam, html, neardup, packing, quality, repetition, shared, sharding, substrings, warc
from pyspark.sql import functions as F

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, row string, n int, kept int"


def corpus(seed=1, n=120):
    """Texts with nulls, empties, copies, near copies, shared passages, periodic and long ones; columns with clashing names."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passage = " ".join(word() for _ in range(150))
    texts = [None, "", " \n\t ", "a", "The " * 400, "ab" * 900, passage, passage, "x" * 450 + "y" + "x" * 450]
    while len(texts) < n:
        kind, body = rng.random(), [word() for _ in range(rng.randint(1, 300))]
        if kind < 0.3:
            body[rng.randrange(len(body)) :] = [passage[rng.randint(0, 80) :], *body[:40]]
        elif kind < 0.5 and texts[-1]:
            body = texts[-1].split(" ")
            for _ in range(rng.randint(0, 12)):
                body[rng.randrange(len(body))] = word()
        texts.append(rng.choice([" ", "\n", "  "]).join(body).capitalize())
    texts.append(" ".join(word() for _ in range(20000)))
    return [(i if i != 11 else None, t, "r", 1, 2) for i, t in enumerate(texts)] + [(5, texts[5], "r", 1, 2), (8, "other text", None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_duplicates(spark, rows, docs):
    sets = [(i, r[0], shingles(r[1]), r[1]) for i, r in enumerate(rows)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, _, a, _ in sets:
        for j, _, b, _ in sets[:i]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, key, _, _ in sets:
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    want = sorted(((key, len(s), least.get(find(i)) if s else key) for i, key, s, _ in sets), key=repr)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()), key=repr)
    assert got == want
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_sketch():
    rng = np.random.Generator(np.random.PCG64(1))
    a, b = rng.integers(0, 2**63, 900, dtype=np.uint64), rng.integers(0, 2**63, 300, dtype=np.uint64)
    both = np.concatenate([a, b])
    ra, rb = neardup.registers(a), neardup.registers(both)
    assert (np.maximum(ra, neardup.registers(b)) == rb).all()
    j = neardup.estimate(np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), np.array([900.0]), np.array([1200.0]))
    assert abs(j[0] - 0.75) < 0.15


def test_remove_repeats(spark, rows, docs):
    width, count = 400, {}
    for r in rows:
        b = (r[1] or "").encode()
        for k in range(len(b) - width + 1):
            count[b[k : k + width]] = count.get(b[k : k + width], 0) + 1
    want = []
    for r in rows:
        b = (r[1] or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if count[b[k : k + width]] > 1:
                gone[k : k + width] = b"\x01" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want.append(repr((r[0], len(b), sum(gone), runs, kept)))
    out = substrings.remove_repeats(docs, carry=("doc_id", "row", "kept"))
    got = [repr((r.row.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept))) for r in out.collect()]
    assert sorted(got) == sorted(want)
    assert substrings.remove_repeats(empty(spark)).count() == 0


def test_parse_order(spark, docs):
    """Ranks are in the order of the phrases' bytes, and the parse's suffixes in that of a plain suffix array."""
    texts = docs.where("octet_length(text) >= 400").select(F.monotonically_increasing_id().alias("id"), F.xxhash64("text").alias("h"), "text").cache()
    whole = {r.id: r.text.encode() for r in texts.collect()}
    ranked, same, once = substrings.dictionary(texts)
    own, place = {}, {}
    for r in ranked.collect():
        rank = same.get(r["rank"], r["rank"])
        if rank not in once:
            at = r.place >> 32
            assert own.setdefault(rank, whole[r.id][at : at + r.n]) == whole[r.id][at : at + r.n]
            place.setdefault(rank, set()).add((r.id, at))
    assert [own[r] for r in sorted(own)] == sorted(own.values()) and len(set(own.values())) == len(own) > 50
    assert all(len(x) > 1 for x in place.values())
    count = {}
    for b in whole.values():
        p = substrings.phrases(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
        for a, e in zip(p["start"].tolist(), p["end"].tolist(), strict=True):
            count[b[a:e]] = count.get(b[a:e], 0) + 1
    assert set(own.values()) == {x for x, n in count.items() if n > 1}
    rows = substrings.parse_suffixes(ranked, same, once, 400).collect()
    seqs = pa.array([bytes(r.seq) for r in rows], pa.binary())
    common, offsets, end = substrings.common_phrases(seqs)
    suffixes = [whole[r.id][r["at"] : r["at"] + end[offsets[i + 1] - 1]] for i, r in enumerate(rows)]
    assert suffixes == sorted(suffixes) and len(rows) > 100
    for i in range(1, len(rows)):
        shared = end[offsets[i] + common[i] - 1] if common[i] else 0
        assert suffixes[i][:shared] == suffixes[i - 1][:shared]


def test_passages_in_many_ranges(spark, monkeypatch):
    """Pairs of passages of 51 words are found wherever ranges of their windows end."""
    monkeypatch.setattr(substrings, "RANGE_BYTES", 1)
    rng = random.Random(5)
    some = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(n))
    rows = []
    for i in range(400):
        passage = some(51)
        rows += [(2 * i + k, f"{a} {passage} {b}", f"{a}  {b}") for k, (a, b) in enumerate((some(12), some(12)) for _ in range(2))]
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame(rows, "doc_id long, text string, want string")
        got = {r.row.doc_id: (r.rest, r.row.want) for r in substrings.remove_repeats(df, carry=("want", "text", "doc_id"), words=51).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == len(rows) and not [i for i, (rest, want) in got.items() if rest != want]


def test_ranges(spark):
    """Ranges follow one another in the order of their keys, also of short and empty ones, and a frequent key is spread evenly though few texts have it."""
    rng = random.Random(3)
    rows = [(bytes(rng.choices(b"\x00ab\xff", k=rng.randint(0, 20))), i, 0) for i in range(3000)] + [(b"often", 10**6 + i // 300, i % 300) for i in range(6000)]
    df, schema = spark.createDataFrame(rows, "k binary, id long, at int"), "k binary, id long, at int"
    how = iter, schema, ("k",), ("id", "at")
    few = df.where("id % 10 = 0")
    bounds = shared.bounds_of(few, *how, 30)
    out = shared.in_ranges(df, *how, bounds).withColumn("p", F.spark_partition_id()).collect()
    assert sorted((bytes(r.k), r.id, r["at"]) for r in out) == sorted(rows)
    keys = [bytes(r.k) for r in sorted(out, key=lambda r: r.p)]
    assert keys == sorted(keys)
    count = {}
    for r in out:
        count[r.p] = count.get(r.p, 0) + 1
    assert len(count) > 25 and max(count.values()) < 3 * len(rows) / 30


def test_phrases_are_made_once(spark, monkeypatch):
    """Where ranges end is found on a sample, so that the phrases aren't made twice."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches, real=substrings._phrases):
        for batch in real(batches):
            made.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(substrings, "_phrases", counted)
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefgh ", k=500)) for _ in range(4000)]
    want = sum(len(substrings.phrases(np.frombuffer(t.encode(), np.uint8), np.array([0, 500]))["row"]) for t in texts)
    substrings.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert want < made.value < 1.5 * want


def thue_morse(n, letters):
    out = letters[0]
    while len(out) < n:
        out += out.translate(str.maketrans(letters, letters[::-1]))
    return out


def test_thue_morse(spark):
    """Words that collide under polynomials modulo 2**64, for all that compares strings by hashes first."""
    from placelake.llm.shared import byte_arrays

    code = packing.encoder(TOKENIZER)
    for n in (1024, 2048):
        a, b = thue_morse(n, "ab"), thue_morse(n, "ba")
        ids, of = code.batch(*byte_arrays(pa.array([a, b])))
        for i, t in enumerate((a, b)):
            assert code.plain.encode(t, add_special_tokens=False).ids == ids[of[i] : of[i + 1]].tolist()
        x, y = neardup.shingle_sets(pa.array([a, b]))
        assert x.tolist() != y.tolist()
        df = spark.createDataFrame([(1, f"{a}\n{b}"), (2, f"{a} x x x\n{a} x x x")], "doc_id long, text string")
        got = {r.row.doc_id: (r.n_dup_lines, r.n_repeat_words) for r in repetition.repetition_rules(df).collect()}
        assert got == {1: (0, 0), 2: (1, 0)}
        df = spark.createDataFrame([(1, a), (2, b), (3, "-" * 399 + a[:50])], "doc_id long, text string")
        count = {}
        for r in df.collect():
            for k in range(len(r.text) - 399):
                count[r.text[k : k + 400]] = count.get(r.text[k : k + 400], 0) + 1
        for r in substrings.remove_repeats(df).collect():
            t = {1: a, 2: b, 3: "-" * 399 + a[:50]}[r.row.doc_id]
            gone = {i for k in range(len(t) - 399) if count[t[k : k + 400]] > 1 for i in range(k, k + 400)}
            assert r.n_removed == len(gone)


def test_tokens():
    code = packing.encoder(TOKENIZER)
    rng = random.Random(2)
    texts = ["don't we'll I've 's ''s  a\n\nb  \n d", "<|endoftext|> hi", "日本語 текст ͸ x", "it's'm  'm\n're'rex 'l"]
    texts += ["".join(rng.choice([" ", "  ", "\n", "\t", "'", "s", "re", "ll", "Z9", "é", "!", "%", "я", "\r\n"]) for _ in range(rng.randint(0, 14))) for _ in range(500)]
    from placelake.llm.shared import byte_arrays

    ids, of = code.batch(*byte_arrays(pa.array(texts)))
    for i, t in enumerate(texts):
        assert code.plain.encode(t, add_special_tokens=False).ids == ids[of[i] : of[i + 1]].tolist()


def test_tokens_with_colliding_hashes(monkeypatch):
    """Equal hashes change nothing, in a batch or against what is kept; nor does a cache that overflows."""
    from placelake.llm.shared import byte_arrays

    rng = random.Random(7)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(20)) for _ in range(40)]
    for few, room in ((5, 1 << 20), (1 << 60, 60)):
        monkeypatch.setattr(packing, "CACHE", room)
        monkeypatch.setattr(packing.bh, "range_hash", lambda sums, a, b, few=few, real=packing.bh.range_hash: real(sums, a, b) % np.uint64(few))
        code = packing.Encoder(TOKENIZER)
        for k in range(0, 40, 8):
            ids, of = code.batch(*byte_arrays(pa.array(texts[k : k + 8])))
            for i, t in enumerate(texts[k : k + 8]):
                assert code.plain.encode(t, add_special_tokens=False).ids == ids[of[i] : of[i + 1]].tolist()
        monkeypatch.undo()


def test_packing(spark, rows, docs):
    code = packing.encoder(TOKENIZER)
    out = packing.pack(docs, TOKENIZER).collect()
    by, sequences = {}, {}
    for r in out:
        assert r.length * 4 == len(r.ids) and r.length > 0
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    short = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        short += at < 1024
        assert at <= 1024
    assert short <= 1
    ids = [(r[0], np.array([*code.plain.encode(r[1] or "", add_special_tokens=False).ids, 0], np.uint32)) for r in rows]
    assert sum(r.length for r in out) == sum(len(x) for _, x in ids)
    for key, want in ids:
        pieces = sorted(by[key, len(want)], key=lambda r: r.start)
        if len({r.start for r in pieces}) == len(pieces):
            assert b"".join(bytes(r.ids) for r in pieces) == want.tobytes()
    assert packing.pack(empty(spark), TOKENIZER).count() == 0


def test_packing_merges_in_a_tree(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "FAN", 2)
    out = packing.pack(docs.repartition(9), TOKENIZER)
    sizes = [r.n for r in out.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert sum(n < 1024 for n in sizes) <= 1 and max(sizes) <= 1024


def test_decontaminate(spark, docs):
    import re

    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [(1, "One two, three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "kurz É"), (3, None), (4, ""), (10, "kurz é"), (None, "nine ten")]
    texts = [(1, "x one TWO three-four five six seven eight nine ten eleven twelve thirteen y"), (2, "kurz é kurz"), (3, None), (4, "nine ten " * 3), (5, "Kurz É"), (6, "nineten")]
    b, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")
    windows = {}
    for i, t in items:
        w = find(t)
        for k in range(max(len(w) - 12, min(len(w), 1))):
            windows.setdefault(tuple(w[k : k + 13]), set()).add("" if i is None else str(i))
    for r in decontam.decontaminate(d, b).collect():
        w = find(dict(texts)[r.row.doc_id])
        hit, own = set(), set()
        for k in range(len(w)):
            for win, names in windows.items():
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    own |= names
        assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(own)), r
        for h in r.hits:
            assert find(r.text[h.start_char : h.end_char]) == w[h.first : h.end]
    assert decontam.decontaminate(docs, b.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.decontaminate(empty(spark), b).count() == 0


def test_decontaminate_in_blocks(spark, monkeypatch):
    b = spark.createDataFrame([(i, f"alpha{i} beta{i}") for i in range(20)], "item_id long, text string")
    d = spark.createDataFrame([(1, "alpha3 beta3 alpha7 beta7 x")], "doc_id long, text string")
    whole = decontam.decontaminate(d, b).first()
    monkeypatch.setattr(decontam, "AUTOMATON_BYTES", 60)
    parts = decontam.decontaminate(d, b).first()
    assert (parts.n_hit, parts["items"], parts.hits) == (whole.n_hit, whole["items"], whole.hits) and whole.n_hit == 4


def test_repetition(spark, rows, docs):
    def brute(t):
        w = (t or "").encode().split()
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        seen = {}
        for k in range(len(w) - 7):
            seen.setdefault(tuple(w[k : k + 8]), []).append(k)
        cover = {i for at in seen.values() if len(at) > 1 for k in at for i in range(k, k + 8)}
        return len(w), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)

    want = sorted(repr((r[0], *brute(r[1]))) for r in rows)
    out = repetition.repetition_rules(docs).collect()
    assert sorted(repr((r.row.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in out) == want
    assert all(r.covered_words == r.n_repeat_words for r in out)
    assert repetition.repetition_rules(empty(spark)).count() == 0


@pytest.mark.parametrize("texts", [["a b\n"], ["a b", ""], ["a b", None], [""], [None], ["a b", "c\n"], ["x y\nx y\n", None, ""]])
def test_lines_of_last_texts(spark, monkeypatch, texts):
    """Empty, null and newline-ended texts in last place, together in a chunk and each in its own."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for size in (1 << 20, 1):
        monkeypatch.setattr(repetition, "chunks", lambda batch, column, size=size: shared.chunks(batch, column, size))
        got = {}
        for batch in repetition._measure(8, 3)(df.select(F.struct("doc_id").alias("row"), "text").toArrow().to_batches()):
            got |= {r["row"]["doc_id"]: r["n_dup_lines"] for r in batch.to_pylist()}
        want = {}
        for i, t in enumerate(texts):
            lines = [x for x in (t or "").split("\n") if x.split()]
            want[i] = len(lines) - len(set(lines))
        assert got == want
    assert repetition.repetition_rules(df).count() == len(texts)


def test_template_text(spark):
    template = " ".join(f"please call our friendly staff today about w{k}" for k in range(40))
    plain = " ".join(f"v{k}" for k in range(320))
    df = spark.createDataFrame([(1, template), (2, plain)], "doc_id long, text string")
    got = {r.row.doc_id: (r.base_failed, r.short_covered, r.longest_repeat, r.kept) for r in repetition.repetition_rules(df).collect()}
    assert got == {1: (False, 280, 7, False), 2: (False, 0, 0, True)}


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(200):
        s = [rng.randint(0, 2) for _ in range(rng.randint(1, 40))]
        order, lcp = repetition.suffix_array(np.array(s))
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        for k in range(1, len(s)):
            a, b = s[order[k - 1] :], s[order[k] :]
            assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_maximal_repeats():
    rng = random.Random(6)
    for _ in range(200):
        s, shortest = [rng.randint(0, rng.choice([1, 2, 4])) for _ in range(rng.randint(1, 30))], rng.choice([1, 2, 3])
        want = set()
        for size in range(shortest, len(s)):
            seen = {}
            for i in range(len(s) - size + 1):
                seen.setdefault(tuple(s[i : i + size]), []).append(i)
            for at in seen.values():
                left, right = {s[i - 1] if i else None for i in at}, {s[i + size] if i + size < len(s) else None for i in at}
                if len(at) > 1 and (len(left) > 1 or None in left) and (len(right) > 1 or None in right):
                    want.add((size, tuple(at)))
        order, found = repetition.maximal_repeats(np.array(s), shortest)
        assert sorted((n, tuple(sorted(order[a:b].tolist()))) for n, a, b in found) == sorted(want)
        longest = repetition._spans(len(s), order, found)
        assert longest.max() == max((n for n, _ in want), default=0)
        assert repetition._covered(longest, shortest) == len({i for n, at in want for k in at for i in range(k, k + n)})


def test_long_periodic_text(spark):
    import time

    began = time.monotonic()
    order, found = repetition.maximal_repeats(np.zeros(100_000, np.int64), 3)
    assert repetition._covered(repetition._spans(100_000, order, found), 3) == 100_000 and time.monotonic() - began < 10
    df = spark.createDataFrame([(1, "a b " * 50_000)], "doc_id long, text string")
    r = repetition.repetition_rules(df).first()
    assert (r.n_words, r.n_repeat_words, r.covered_words, r.short_covered, r.longest_repeat, r.kept) == (100_000, 100_000, 100_000, 100_000, 99_998, False)


def test_sharding(spark, docs, rows):
    out = sharding.assign(docs, sharding.topology(8), sharding.topology(9)).collect()
    assert len(out) == len(rows)
    assert all(r.grown_shard in (r.shard, 8) for r in out)
    for s in range(8):
        own = sorted((r for r in out if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
    assert sorted((r.size, r.text_crc32) for r in out) == sorted((len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    ids = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    for n in (1, 4, 9, 10):
        moved = ids.select(sharding.descend(F.col("k"), sharding.topology(n)).alias("a"), sharding.descend(F.col("k"), sharding.topology(n + 1)).alias("b"))
        assert moved.where(f"a <> b and b <> {n}").count() == 0
    heavy = sharding.topology(8, {5: 3.0})
    moved = ids.select(sharding.descend(F.col("k"), sharding.topology(8)).alias("a"), sharding.descend(F.col("k"), heavy).alias("b"))
    assert moved.where("a <> b and b <> 5").count() == 0
    assert 0.25 < moved.where("b = 5").count() / 4000 < 0.35
    assert sharding.assign(empty(spark), sharding.topology(8)).count() == 0


def test_quality(spark, docs):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        words = ["".join(rng.choice("aeiou") + rng.choice("bcd") for _ in range(rng.randint(1, 4))) for _ in range(60)]
        bad = i % 3 == 0
        rows.append((i, " ".join(w + "%%%" for w in words) if bad else " ".join(words), 0 if bad else 1))
    all_ = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(all_.select("doc_id", "text"), all_.select("doc_id", "quality").where(~quality.held_out()))
    out = quality.classify(all_, model, carry=("doc_id", "quality")).where(quality.held_out("row.doc_id")).collect()
    assert sum(r.predicted == r.row.quality for r in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 for r in quality.classify(docs, model).collect())
    none = quality.fit(all_, all_.select("doc_id", "quality").limit(0))
    assert [r.score for r in quality.classify(docs.limit(1), none).collect()] == [0.5]
    assert quality.classify(empty(spark), model).count() == 0


PAGES = [
    (1, "http://a.com/x y", b"<p>WARC/1.1\r\n\r\nHTTP/1.1 200"), (2, "http://b.com", b"same"), (3, None, b"same"), (4, "http://c.com", b""), (5, "http://d.com", b"\n\n"),
    (6, "http://e.com", None), (None, "http://f.com", "é\x00".encode()), (None, "http://g.com", b"\xff\x1f\x8b\n"), (2, "http://b.com", b"same"), (7, "http://h.com/" + "u" * 90000, b"long " * 400000), (-9, "é\n", b"long " * 400000),
]
PAGES_SCHEMA = "key long, url string, payload binary, archive int, digest int, first int, error int, value int"


def pages(spark, rows=None, parts=3):
    rows = PAGES if rows is None else rows
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], PAGES_SCHEMA).repartition(parts).withColumn("date", F.lit("20010203040506"))


def check_warc(spark, path, rows=PAGES):
    got = warc.read_warc(spark, path).collect()
    firsts = {}
    for key, _, body in rows:
        firsts[body or b""] = min(firsts.get(body or b"", (True, 0)), (key is None, key or 0))
    want = []
    for key, _, body in rows:
        none, first = firsts[body or b""]
        revisit = not none and key != first
        want.append((key, "revisit" if revisit else "response", first if revisit else None, len(body or b""), base64.b32encode(hashlib.sha1(body or b"").digest()).decode(), None if revisit else body or b""))
    assert sorted(map(repr, want)) == sorted(repr((r.key, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload and bytes(r.payload) if r.payload else r.payload if r.payload is None else b"")) for r in got)
    assert all(r.date == "2001-02-03T04:05:06Z" and r.error is None for r in got) and len({r.record_id for r in got}) == len(got)
    return got


@pytest.mark.parametrize("version", [1, 2])
def test_warc(spark, tmp_path, version):
    """Archives of many records through both ways, with nulls, repeated rows, copies and columns of clashing names."""
    arcs = warc.arc_archives(pages(spark), versions=(version,))
    records = warc.parse_arcs(arcs)
    assert arcs.count() < len(PAGES) and records.agg(F.max("position")).first()[0] > 0
    warc.write_warc(warc.resolve_revisits(records), str(tmp_path / "w"))
    check_warc(spark, str(tmp_path / "w"))
    warc.write_arcs(pages(spark), str(tmp_path / "a"), archive_bytes=100, versions=(version,))  # an archive is closed once it holds 100 bytes
    warc.write_warc(warc.resolve_revisits(warc.read_arcs(spark, str(tmp_path / "a"))), str(tmp_path / "v"), file_bytes=3000)
    check_warc(spark, str(tmp_path / "v"))


def test_warc_files(spark, tmp_path):
    """Files are gzipped by record, open with a warcinfo that their records name, and revisits name a record that is there."""
    import gzip

    warc.write_warc(warc.resolve_revisits(warc.parse_arcs(warc.arc_archives(pages(spark)))), str(tmp_path / "w"))
    files = [f for f in (tmp_path / "w").iterdir() if not f.name.startswith((".", "_"))]
    assert files and all(f.name.endswith(".warc.gz") for f in files)
    ids, refers = set(), set()
    for f in files:
        data, members = f.read_bytes(), []
        while data:
            z = zlib.decompressobj(31)
            members.append(z.decompress(data) + z.flush())
            assert z.eof
            data = z.unused_data
        assert b"".join(members) == gzip.decompress(f.read_bytes())
        assert not members.pop() and all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in members)
        heads = [next(warc.warc_records(m))[0] for m in members]
        assert [h["warc-type"] == "warcinfo" for h in heads] == [True] + [False] * (len(heads) - 1)
        assert {h["warc-warcinfo-id"] for h in heads[1:]} == {heads[0]["warc-record-id"]}
        ids |= {h["warc-record-id"] for h in heads}
        refers |= {h["warc-refers-to"] for h in heads if "warc-refers-to" in h}
    assert refers and refers <= ids


def test_warc_empty(spark, tmp_path):
    warc.write_warc(warc.resolve_revisits(warc.parse_arcs(warc.arc_archives(pages(spark, [])))), str(tmp_path / "w"))
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == 0
    none = spark.createDataFrame([("a", None), ("b", b""), (None, b"\n\r\n")], "archive string, arc binary")
    assert warc.parse_arcs(none).count() == 0


def test_warc_damaged_archives(spark, tmp_path):
    """What can't be read is a row with an error after what stands before it, and other archives are read whole."""
    block = b"filedesc://x 0.0.0.0 1996 text/plain 4\n1 0\n\n"
    one = b"http://a b/ 0.0.0.0 1996 text/html 4\nabcd\n"
    members = b"".join(zlib.compress(x, wbits=31) for x in (block, one, one))
    arcs = {
        "good": block + one * 2, "crlf": block.replace(b"\n\n", b"\r\n\n") + one, "members": members, "whole": zlib.compress(block + one, wbits=31), "cut": block + one + one[:-3], "cut member": members[:-20], "rubbish": members + b"rubbish",
        "negative": block + b"http://a 0.0.0.0 1996 text/html -4\nabcd", "fields": block + one + b"http://a 4\nabcd", "no end": block + b"http://a", "no version": one, "version 3": block.replace(b"1 0", b"3 0"), "empty block": b"filedesc://x 0 0 t/p 0\n\n", "bytes": block + one + b"\xff\xfe",
    }
    got = {}
    for r in warc.parse_arcs(spark.createDataFrame(list(arcs.items()), "archive string, arc binary").repartition(2)).collect():
        n, bad = got.get(r.archive, (0, False))
        got[r.archive] = (n + (r.error is None), bad or r.error is not None)
        assert r.error is not None or (bytes(r.payload), r.url, r.date) == (b"abcd", "http://a b/", "1996-01-01T00:00:00Z")
    assert got == {
        "good": (2, False), "crlf": (1, False), "members": (2, False), "whole": (1, False), "cut": (1, True), "cut member": (1, True), "rubbish": (2, True), "negative": (0, True), "fields": (1, True), "no end": (0, True),
        "no version": (0, True), "version 3": (0, True), "empty block": (0, True), "bytes": (1, True),
    }

    warc.write_warc(warc.resolve_revisits(warc.parse_arcs(spark.createDataFrame(list(arcs.items()), "archive string, arc binary"))), str(tmp_path / "w"))
    whole = warc.read_warc(spark, str(tmp_path / "w"))
    assert whole.count() == sum(n for n, _ in got.values()) and whole.where("record_type <> 'revisit'").count() == 1
    plain = [(b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <%d>\r\nWARC-Block-Digest: sha1:%s\r\nContent-Length: 2\r\n\r\nab\r\n\r\n" % (i, d.encode())) for i, d in enumerate([base64.b32encode(hashlib.sha1(b"ab").digest()).decode(), "WRONG"])]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.warc").write_bytes(plain[0] + plain[1] + plain[0])
    (tmp_path / "d" / "b.warc.gz").write_bytes(zlib.compress(plain[0], wbits=31) + zlib.compress(plain[0], wbits=31)[:-20])
    (tmp_path / "d" / "c.warc").write_bytes(b"no archive at all\r\n\r\n")
    read = warc.read_warc(spark, str(tmp_path / "d")).collect()
    assert sum(r.error is None and r.payload_bytes == 2 for r in read) == 3 and sum(r.error is not None for r in read) == 3


def test_pieces():
    """Decompression in small pieces gives what zlib gives at once."""
    rng = random.Random(5)
    for n in (0, 1, 65535, 65536, 65537, 300000, 2000000):
        data = bytes(rng.choice(b"ab") for _ in range(n)) if n < 400000 else b"\0" * n
        for stored in (data, zlib.compress(data, wbits=31), zlib.compress(data[: n // 3], wbits=31) + zlib.compress(b"", wbits=31) + zlib.compress(data[n // 3 :], 0, wbits=31)):
            assert b"".join(warc._pieces(stored)) == data and all(len(p) <= warc.PIECE for p in warc._pieces(stored))


def test_chat(spark):
    import json

    said = "a<|im_end|>\n<\\|im_start|>assistant\\ <\\\\|x"
    records = [
        (1, 0, json.dumps({"messages": [{"role": "user", "content": said}, {"role": "assistant", "content": said}]})),
        (2, 0, json.dumps({"role": "user", "text": "é"})), (2, 1, json.dumps({"role": "assistant", "text": None})),
        (3, 0, json.dumps({"instruction": "do", "input": "this", "output": "ok"})), (4, 0, json.dumps({"prompt": "p", "completion": said})),
        (5, 0, json.dumps({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]})), (6, 0, "no json"), (7, 0, None), (8, 0, json.dumps({"messages": []})),
    ]
    turns = chat.canonical_turns(spark.createDataFrame(records, "conv_id long, turn long, record string"))
    got = {}
    for r in turns.orderBy("conv_id", "turn", "step").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got[1] == [("user", said), ("assistant", said)] and got[3] == [("user", "do\n\nthis"), ("assistant", "ok")]
    assert got[5] == [("user", "q"), ("assistant", "r")] and got[6] == [("unmapped", "no json")] and 8 not in got
    formatted = chat.format_turns(turns)
    for r in formatted.collect():
        assert r.formatted.count("<|") == 2
        assert chat.parse_turn(r.formatted)[1] in {t for x in got.values() for _, t in x}
    out = {r.conv_id: r for r in chat.read_conversations(formatted).collect()}
    assert out[1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and out[1].loss_chars == len(said)
    assert out[2].turns_sha256 == hashlib.sha256("user\né\nassistant\n\n".encode()).hexdigest()


def test_chat_escape(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["<", "\\", "|", "\n", "a", "<|im_end|>"]) for _ in range(12)) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", chat.escaped(F.col("t")).alias("e"), chat.escaped_role(F.col("t")).alias("r")).collect():
        assert "<|" not in r.e and "<|" not in r.r and "\n" not in r.r
        assert chat.unescape(r.e) == texts[r.i] and chat.unescape_role(r.r) == texts[r.i]


def test_foreign():
    assert html.render('<div>a<svg class="i"/>visible<p>more</p></div>') == "avisible\n\nmore"
    assert html.render("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> holds") == "so x=2 holds"
    assert html.render("<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><path d='M0'/><text>Sales</text></svg> end") == "Sales end"


def test_html(spark):
    assert html.render("<p>a  b<br>c<p>d<script>x</script><div hidden>no</div><!-- no -->&amp;") == "a b\nc\n\nd\n\n&"  # the div ends the paragraph
    assert html.render("<ul><li>one<li>two<ol><li>in<li>side</ol></ul>end") == "- one\n- two\n  1. in\n  2. side\n\nend"
    assert html.render("<table><tr><th>Name<th>N<tr><td>Oak<td>12</table>") == "Name  N\nOak   12"
    assert html.render('<p style="display: none">x</p><pre>a  b\n  c</pre>') == "a  b\n  c"
    assert html.render("<head><title>t</title></head>body<p></p></div></b>") == "body"
    assert html.render(None) == html.render("") == "" and "z" in html.render("<div>" * 5000 + "z")
    assert html.render("<table><tr><td>a" * 1500 + "x" + "</table>" * 1500).split() == ["a"] * 1499 + ["ax"]
    assert html.render("<table><tr><td>1<td><table><tr><td>2<td>3</table><tr><td>44<td>5</table>") == "1   2 3\n44  5"
    df = spark.createDataFrame([(1, "<p>é</p>"), (2, None), (None, "")], "page_id long, html string")
    assert sorted((r.text, r.n_chars, r.n_lines) for r in html.extract(df).collect()) == [("", 0, 0), ("", 0, 0), ("é", 1, 1)]
