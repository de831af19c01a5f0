"""Links between pages: extraction, ranking and the frontier of a crawl."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from placelake.constants import LISTING_PARTS
from placelake.functions import anchors as A
from placelake.functions import urls
from placelake.operators.extract import FLUSH_CHARS
from placelake.operators.rounds import cut


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["base", "pos", "href", "text", "url"]
    for batch in batches:
        chars = 0
        rows: list[tuple] = []
        taken: list[int] = []
        for i in range(batch.num_rows):
            base, html = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
            for pos, (href, text) in enumerate(A.anchors(html)):
                rows.append((base, pos, href, text, A.join(base, href)))
                taken.append(i)
            chars += len(html or "")
            if chars > FLUSH_CHARS or i == batch.num_rows - 1:
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                arrays = [pa.array(c, pa.int32() if n == "pos" else pa.string()) for c, n in zip(columns, names, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(taken, pa.int64())), *arrays], [batch.schema.names[0], *names])
                rows, taken, chars = [], [], 0


def anchors(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, base, pos, href, text, url): a row per anchor with an href, decoded, resolved against its page; url is null where it can't be."""
    fields = [StructField(n, IntegerType() if n == "pos" else StringType()) for n in ("base", "pos", "href", "text", "url")]
    return pages.select(key, "url", "html").mapInArrow(_anchor_rows, StructType([StructField(key, pages.schema[key].dataType), *fields]))


def links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, base, pos, href, url): the anchors without their texts."""
    return anchors(pages, key).drop("text")


def top_links(scored: DataFrame, n: int, key: str = "page_id") -> DataFrame:
    """The best ``n`` links of each page; ties keep the order on the page."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "pos")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def unvisited(frontier: DataFrame, visited: DataFrame) -> DataFrame:
    return frontier.join(visited.select("url").distinct(), "url", "left_anti")


def reach(edges: DataFrame, seeds: DataFrame, most: int = 3) -> DataFrame:
    """(url, depth): what is reached from ``seeds(url)`` over ``edges(src, dst)`` in at most ``most`` steps, by anti-joins; each level starts from the written last one."""
    found = front = cut(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    for step in range(1, most + 1):
        front = edges.join(front.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct()
        front = cut(front.join(found, "url", "left_anti").withColumn("depth", F.lit(step)))
        found = found.unionByName(front)
    return found


def frontier_statistics(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("n"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score"))


def next_best(frontier: DataFrame, visited: DataFrame, n: int) -> DataFrame:
    """The best ``n`` URLs of ``frontier(url, score)`` that weren't visited; equal scores in the order of URLs."""
    best = frontier.groupBy("url").agg(F.max("score").alias("score"))
    return unvisited(best, visited).orderBy(F.desc("score"), "url").limit(n)


def candidates(sites: DataFrame, url: str = "url") -> DataFrame:
    """``sites`` with a row per ``candidate``: the usual places of listings on a site, in their usual spellings."""
    base = F.col(url)
    spelled = [urls.resolve(base, F.lit(form.format(p))) for p in LISTING_PARTS for form in ("{}", "/{}", "/{}/", "/{}.html", "/{}.php")]
    return sites.withColumn("candidate", F.explode(F.array_distinct(F.array(*spelled))))
