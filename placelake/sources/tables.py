"""Sources and sinks: catalogs, URL lists, pages, facility files, sitemaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from placelake import constants as K
from placelake.operators.rounds import numbered

CATALOG = "corporation_name primary_url secondary_urls facility_types priority notes estimated_facilities last_updated".split()


def read_catalog(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The catalog of organisations; rows without name or URL go, and in strict mode those whose priority is no integer."""
    raw = spark.read.option("header", True).csv(path)
    have = [F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) if c in raw.columns else F.lit("1" if c == "priority" else "").alias(c) for c in CATALOG]
    df = raw.select(have).where("corporation_name <> '' and primary_url <> ''").withColumn("priority", F.expr("try_cast(priority as int)"))
    return df.where("priority is not null") if strict else df.fillna({"priority": 1})


def read_urls(spark: SparkSession, path: str, prefix: bool = True) -> DataFrame:
    """A URL a line; blank lines and comments go. With ``prefix`` a missing scheme is added and a comment may be indented; without, an indented ``#`` begins no comment."""
    lines = spark.read.text(path).where(~F.startswith(F.trim("value") if prefix else F.col("value"), F.lit("#")))
    df = lines.select(F.trim("value").alias("url")).where("url <> ''")
    return df.withColumn("url", F.when(F.col("url").startswith("http"), F.col("url")).otherwise(F.concat(F.lit("https://"), "url"))) if prefix else df


def read_facilities(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def json_ld(df: DataFrame, schema: str, column: str = "html") -> DataFrame:
    """A row per JSON-LD block, parsed; bad JSON gives nulls."""
    blocks = F.regexp_extract_all(column, F.lit(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), 1)
    return df.select("*", F.explode(blocks).alias("_block")).withColumn("item", F.from_json("_block", schema)).drop("_block")


def flat(df: DataFrame) -> DataFrame:
    """Lists of strings joined by `` | ``, blank items left out; for CSV."""
    return df.select(*(F.array_join(F.filter(c, lambda x: x != ""), " | ").alias(c) if t == "array<string>" else F.col(c) for c, t in df.dtypes))


def nested_flat(df: DataFrame) -> DataFrame:
    """Nested fields as columns of dotted names, lists as JSON text; for CSV."""

    def leaves(column: Column, kind: DataType, name: str) -> list[Column]:
        if isinstance(kind, StructType):
            return [leaf for f in kind.fields for leaf in leaves(column.getField(f.name), f.dataType, f"{name}.{f.name}")]
        return [(F.to_json(column) if isinstance(kind, (ArrayType, MapType)) else column).alias(name)]

    return df.select(*(leaf for f in df.schema.fields for leaf in leaves(F.col(f"`{f.name}`"), f.dataType, f.name)))


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", partition_by: tuple[str, ...] = ()) -> None:
    """Write a table as json, csv (lists joined) or parquet, in folders by the values of ``partition_by``."""
    if kind not in ("json", "csv", "parquet"):
        raise ValueError(f"unknown format {kind}")
    writer = (flat(df) if kind == "csv" else df).write.mode(mode).partitionBy(*partition_by)
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def write_run(path: str, generated: str, mode: str = "error", **tables: DataFrame) -> None:
    """A run as one folder: a JSON table for each of ``tables`` (facilities, validation_reports, scraping_results),
    and their sizes with the date in ``summary``. Tables stay apart, as one document of them all would pass through one task."""
    sizes = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n", F.lit(generated).alias("generation_date")) for name, df in tables.items()]
    for name, df in tables.items():
        df.write.mode(mode).json(f"{path}/{name}")
    reduce(DataFrame.unionByName, sizes).coalesce(1).write.mode(mode).json(f"{path}/summary")


def consolidate(runs: list[DataFrame]) -> DataFrame:
    """All records of several runs, whatever columns each has."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs)


def write_summary(summary: DataFrame, path: str, mode: str = "error") -> None:
    """A summary (of validations, a batch, several sites, methods or downloads) as one JSON file; it has a row per group, so one task writes it."""
    summary.coalesce(1).write.mode(mode).option("ignoreNullFields", False).json(path)


def file_name(kind: str, form: str, **values: str) -> str:
    """The name of a run's file of a ``kind`` in K.FILE_NAMES; signs in values that folders can't hold become ``_``."""
    return K.FILE_NAMES[kind].format(format=form, **{k: "".join(c if c.isalnum() or c in "-." else "_" for c in v) for k, v in values.items()})


def markdown(df: DataFrame, *order: str) -> DataFrame:
    """(line, value): a summary as the lines of a Markdown table, two of head and one per row in ``order``. Nulls are blank; ``|`` is escaped and line breaks become blanks."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"[\r\n]+", " "), r"\|", r"\\|")
    row = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = numbered(df, *order, name="line").select((F.col("line") + 2).alias("line"), row(cell(c) for c in df.columns).alias("value"))
    head = df.sparkSession.range(2).select(F.col("id").alias("line"), F.when(F.col("id") == 0, row(F.lit(c) for c in df.columns)).otherwise("|" + "---|" * len(df.columns)).alias("value"))
    return head.unionByName(body)


def write_comparison(summary: DataFrame, path: str, *order: str, mode: str = "error") -> None:
    """A summary as one CSV file and one Markdown table, in the folders ``csv`` and ``markdown``; it has a row per group, so one task writes each."""
    summary.orderBy(*order).coalesce(1).write.mode(mode).option("header", True).csv(f"{path}/csv")
    markdown(summary, *order).orderBy("line").coalesce(1).select("value").write.mode(mode).text(f"{path}/markdown")
