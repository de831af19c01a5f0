"""Operators on the catalog of organisations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelake import constants as K
from placelake.functions.text import first_integer
from placelake.operators.rounds import numbered


def pieces(text: Column, sign: str = r"\|") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), sign), lambda x: F.trim(x)), lambda x: x != "")


def all_urls(df: DataFrame) -> DataFrame:
    return df.withColumn("urls", F.concat(F.array("primary_url"), pieces(F.col("secondary_urls"))))


def up_to_priority(df: DataFrame, most: int | None = 3, column: str = "priority") -> DataFrame:
    return df.where(F.col(column) <= most) if most else df


def of_type(df: DataFrame, kind: str, column: str = "facility_types", exact: bool = True) -> DataFrame:
    if not exact:
        return df.where(F.lower(column).contains(kind.lower()))
    return df.where(F.exists(pieces(F.col(column)), lambda t: F.lower(t) == kind.lower()))


def due(last: Column, as_of: Column, days: int = 30) -> Column:
    """Whether a date is unknown or lies more than ``days`` before ``as_of``."""
    return F.coalesce(F.to_date(last) < F.date_sub(as_of, days), F.lit(True))


def batches(df: DataFrame, size: int, *order: str) -> DataFrame:
    """Batch numbers from 1 in the given order, by positions that no single task works out."""
    return numbered(df, *order, name="batch").withColumn("batch", (F.floor(F.col("batch") / size) + 1).cast("long"))


def statistics(df: DataFrame, as_of: Column, by: str = "priority") -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"), F.coalesce(F.sum(first_integer(F.col("estimated_facilities"))), F.lit(0)).alias("estimated"), F.count_if(due(F.col("last_updated"), as_of)).alias("n_due"))


def url_owner(chains: DataFrame) -> DataFrame:
    """(url, corporation_name) of the first organisation in order ``ord`` that has a URL."""
    long_ = all_urls(chains).select(F.explode("urls").alias("url"), "corporation_name", "ord")
    return long_.groupBy("url").agg(F.min_by("corporation_name", "ord").alias("corporation_name"))


def tag(facilities: DataFrame, chains: DataFrame, key: str) -> DataFrame:
    """Organisation columns on each facility; the planner broadcasts a catalog that is small."""
    return facilities.join(chains, key)


def type_counts(chains: DataFrame, column: str = "facility_types", sign: str = r"\|") -> DataFrame:
    """How many organisations have each type; a type that one names twice counts twice."""
    return chains.select(F.explode(pieces(F.col(column), sign)).alias("facility_type")).groupBy("facility_type").agg(F.count("*").alias("n"))


def sizes(chains: DataFrame, megabytes: Column | float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """A row for each catalog (all rows, or those of equal ``by``) with its size and whether it is beyond what is advised; ``megabytes`` is its file's size, if known, or an aggregate that tells it. Nothing is refused."""
    size = megabytes if isinstance(megabytes, Column) else F.max(F.lit(megabytes).cast("double"))
    large = F.col("_megabytes") > K.CATALOG_MEGABYTES
    return chains.groupBy(*by).agg(F.count("*").alias("n"), size.alias("_megabytes")).select(*by, "n", (F.col("n") > K.CATALOG_ADVISED).alias("many"), (F.col("n") > K.CATALOG_MOST).alias("too_many"), F.coalesce(large, F.lit(False)).alias("large_file"))


def results(chains: DataFrame, facilities: DataFrame, key: str) -> DataFrame:
    """Each organisation with facilities_count and success, which takes one facility at least. Null keys have none."""
    found = facilities.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("facilities_count"))
    n = F.coalesce("facilities_count", F.lit(0))
    return chains.join(found, key, "left").withColumns({"facilities_count": n, "success": n > 0})


def batch_summary(results: DataFrame, by: str = "batch") -> DataFrame:
    """Per batch: organisations, those that succeeded and failed, and their facilities. A null success is a failure."""
    good = F.coalesce("success", F.lit(False))
    return results.groupBy(by).agg(F.count("*").alias("n"), F.count_if(good).alias("successful"), F.count_if(~good).alias("failed"), F.coalesce(F.sum("facilities_count"), F.lit(0)).alias("facilities"))
