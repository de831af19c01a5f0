"""Sharding by a hierarchical weighted hash tree.

Regions hold racks, racks hold shards. For a key every shard draws ``-ln(u) / weight`` from a hash of
key and shard; a rack's draw is the least of its shards', a region's the least of its racks', so that
a subtree draws as one node of its total weight. The key descends to the least draw at each level.
When weights change, only draws below them change, and keys move only out of or into those subtrees:
one more shard takes keys, and only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelake.llm.shared import checkpoint

RACKS_PER_REGION = 2
SHARDS_PER_RACK = 2


@dataclass(frozen=True)
class Shard:
    number: int
    rack: int
    region: int
    weight: float = 1.0


def topology(shards: int, weights: dict[int, float] | None = None) -> list[Shard]:
    """``shards`` shards, filled into racks and regions in order; a shard of weight 0 takes nothing."""
    per_region = RACKS_PER_REGION * SHARDS_PER_RACK
    return [Shard(i, i // SHARDS_PER_RACK, i // per_region, (weights or {}).get(i, 1.0)) for i in range(shards)]


def draw(key: Column, shard: Shard) -> Column:
    """An exponential draw of the rate ``weight``: from the first 52 bits of an MD5 of key and shard."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard.number}")).cast("binary")), 1, 13), 16, 10).cast("long")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(2**52))) / F.lit(shard.weight)


def _least(columns: list[Column]) -> Column:
    return F.least(*columns) if len(columns) > 1 else columns[0]


def descend(key: Column, shards: list[Shard]) -> Column:
    """The number of the shard that ``key`` (a string) goes to; of equal draws the first node in order wins."""
    tree: dict[int, dict[int, list[Shard]]] = {}
    for s in shards:
        if s.weight > 0:
            tree.setdefault(s.region, {}).setdefault(s.rack, []).append(s)
    draws = {s.number: draw(key, s) for s in shards if s.weight > 0}

    def choose(nodes: list[tuple[Column, Column]]) -> Column:
        least = _least([d for d, _ in nodes])
        out = nodes[-1][1]
        for d, below in reversed(nodes[:-1]):
            out = F.when(d == least, below).otherwise(out)
        return out

    regions = []
    for racks in tree.values():
        below = []
        for own in racks.values():
            below.append((_least([draws[s.number] for s in own]), choose([(draws[s.number], F.lit(s.number)) for s in own])))
        regions.append((_least([d for d, _ in below]), choose(below)))
    return choose(regions)


def assign(docs: DataFrame, shards: list[Shard], grown: list[Shard] | None = None) -> DataFrame:
    """Give every document a shard by its doc_id, and a slot in it.

    ``docs`` needs doc_id and text. Returns a row per row: doc_id, size (UTF-8 bytes of the text plus 1),
    text_crc32, shard, slot (0, 1, ... within the shard, in the order of doc_id, text_crc32 and size) and
    grown_shard (by the topology ``grown``, or null). Null texts count as empty. Rows without doc_id share
    the key '' and come first. Equal rows go to one shard and get different slots.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    grown_shard = descend(key, grown).cast("int") if grown else F.lit(None).cast("int")
    rows = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), descend(key, shards).cast("int").alias("shard"), grown_shard.alias("grown_shard"))
    # a global order; the last key splits rows that are equal. What it is holds from the checkpoint on.
    order = ["shard", "doc_id", "text_crc32", "size"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("seen", F.monotonically_increasing_id()).repartitionByRange(parts, *order, "seen").sortWithinPartitions(*order, "seen")
    rows = checkpoint(rows.drop("seen").withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()))
    # a shard's rows are a run of the order: one row per shard and partition tells where its slots start
    runs = rows.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    starts = runs.select("shard", "part", "first", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("offset"))
    out = rows.join(starts, ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("place") - F.col("first")).alias("slot"), "grown_shard")
