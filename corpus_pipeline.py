"""From raw documents to packed training sequences: five stages, each an operator of placelake.llm.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept. The first
four return the columns of ``docs``; the last returns the pieces of the packed sequences. Columns
beyond those of documents are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelake.llm import quality
from placelake.llm.decontam import decontaminate
from placelake.llm.neardup import near_duplicates
from placelake.llm.packing import pack
from placelake.llm.queries import PASSAGE_WORDS, TOKENIZER
from placelake.llm.shared import checkpoint, new_folder
from placelake.llm.substrings import remove_repeats


def _columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` back from the carried struct."""
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; fitted on the labels outside the held-out fold."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality.held_out()))
    return _columns(quality.classify(docs, model, carry=tuple(docs.columns)).where("predicted = 1"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id. Of equal rows with that id one stays."""
    kept = near_duplicates(docs).where("kept").groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.count("*").alias("__n"))
    kept = checkpoint(kept)

    def of(side: DataFrame) -> DataFrame:
        key = F.unhex(F.md5(docs["text"].cast("binary")))
        return docs.join(side, docs["doc_id"].eqNullSafe(side["__id"]) & key.eqNullSafe(side["__key"]), "left_semi")

    once, more = of(kept.where("__n = 1")), kept.where("__n > 1")
    # the texts are shuffled again only where there are repeated rows
    return once if more.isEmpty() else once.unionByName(of(more).dropDuplicates(["doc_id", "text"]))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the bytes of passages that are repeated; what a cut leaves of a character goes too. Null texts stay null."""
    out = remove_repeats(docs, carry=tuple(docs.columns), words=PASSAGE_WORDS)
    rows = out.select("row", F.coalesce("rest", "row.text").alias("text"))
    fields = [F.col("text") if c == "text" else F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return rows.select(*fields)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=tuple(docs.columns))
    return _columns(out.where("not contaminated"), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces, with a checksum of their ids."""
    out = pack(docs, public_tokenizers.path(TOKENIZER))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_length")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
