"""The pipeline's stages at the smallest size, each on what the one before kept."""

import random
import re
from collections import Counter

import corpus_pipeline
from placelake.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == before.columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert docs.select("doc_id").distinct().count() == before.count()


def test_queries(spark):
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
    for name in ("op2_arc_to_warc", "op6_sharding", "op8_html_extraction", "op9_chat_formatting", "op11_personal_data", "op13_centroid_clustering"):
        assert queries.QUERIES[name](spark, SF).count() > 0


def test_repeated_rows(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, None, None), (None, "q r s", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    out = corpus_pipeline.near_dedup(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, [rows[0], rows[3], rows[4]]))


def test_short_passages(spark):
    """Shared passages of 51 words are cut whatever their bytes, those of 50 aren't, and nothing else is."""
    rng = random.Random(5)

    def some(n, letters=8):
        return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=letters)) for _ in range(n))

    short, tiny, fifty, many = some(51, 4), some(51, 1), some(50, 6), " ".join(some(1, 3) for _ in range(60))
    loop = "x y z " * 30
    texts = [f"{some(30)} {p} {some(30)}" for p in (short, short, tiny, tiny, fifty, fifty, many, many, loop)] + [some(200), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = {i: [(m.start(), m.end()) for m in re.finditer(r"\S+", t or "")] for i, t in enumerate(texts)}
    windows = [(t[w[k][0] : w[k + 50][1]], i, w[k][0], w[k + 50][1]) for i, t in enumerate(texts) if (w := words[i]) for k in range(len(w) - 50)]
    count = Counter(x[0] for x in windows)
    gone = {(i, b) for x, i, lo, hi in windows if count[x] > 1 for b in range(lo, hi)}
    want = {i: t and "".join(c for b, c in enumerate(t) if (i, b) not in gone) for i, t in enumerate(texts)}
    got = {r.doc_id: r.text for r in corpus_pipeline.suffix_dedup(spark, docs, SF).collect()}
    assert got == want
    assert all(len(got[i].split()) == 60 for i in (0, 1, 2, 3, 6, 7)) and got[4] == texts[4] and len(got[8]) < len(texts[8])
