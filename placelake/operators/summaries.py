"""Summaries of plans, runs, methods, validations and files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelake import constants as K
from placelake.functions.text import first_integer
from placelake.operators.catalog import batches

HOURS_PER_CHAIN = 0.5


def plan(chains: DataFrame, batch_size: int = 10, by: str | None = None) -> DataFrame:
    """What a run over the organisations takes: their number, batches, facilities to expect and hours."""
    n = F.count("*")
    return chains.groupBy(*([by] if by else [])).agg(
        n.alias("total_chains"), F.ceil(n / batch_size).alias("total_batches"),
        F.coalesce(F.sum(first_integer(F.col("estimated_facilities"))), F.lit(0)).alias("estimated_facilities"), (n * HOURS_PER_CHAIN).alias("estimated_hours"),
    )


def plan_chains(chains: DataFrame, *order: str, batch_size: int = 10) -> DataFrame:
    """The plan's list: (batch, name, url, priority) of each organisation, in batches by ``order``. It stays a table, as a list of all would pass through one task."""
    return batches(chains, batch_size, *order).select("batch", F.col("corporation_name").alias("name"), F.col("primary_url").alias("url"), "priority")


def runs(results: DataFrame, *by: str) -> DataFrame:
    """Of ``results(success, facilities, seconds)``: counts, facilities of successful runs, and guarded averages and rates."""
    n, good = F.count("*"), F.count_if("success")
    total = F.coalesce(F.sum(F.when(F.col("success"), F.col("facilities"))), F.lit(0))
    return results.groupBy(*by).agg(
        n.alias("n"), good.alias("n_success"), F.count_if(~F.col("success")).alias("n_failed"), total.alias("facilities"),
        F.coalesce(F.try_divide(good, n), F.lit(0.0)).alias("success_rate"), F.coalesce(F.try_divide(total, n), F.lit(0.0)).alias("facilities_per_url"),
        F.coalesce(F.avg("seconds"), F.lit(0.0)).alias("avg_seconds"),
    )


def method_rates(results: DataFrame, methods: dict[str, str], method: str = "method") -> DataFrame:
    """The number and share of each method's results; ``methods`` maps methods to column prefixes. Shares of nothing are 0."""
    n = F.count("*")
    each = [(F.count_if(F.col(method) == m), prefix) for m, prefix in methods.items()]
    rates = [F.coalesce(F.try_divide(c, n), F.lit(0.0)).alias(f"{p}_rate") for c, p in each]
    return results.agg(n.alias("n"), *(c.alias(f"n_{p}") for c, p in each), *rates)


def compare(results: DataFrame, base: str, other: str, by: str) -> DataFrame:
    """Facilities and seconds of two methods side by side; the change in per cent and seconds only where both found some."""
    value = lambda column, m: F.sum(F.when(F.col("method") == m, F.col(column)))
    columns = [F.coalesce(value(c, m), F.lit(0)).alias(f"{m}_{c}") for m in (base, other) for c in ("facilities", "seconds")]
    out = results.groupBy(by).agg(*columns)
    a, b = F.col(f"{base}_facilities"), F.col(f"{other}_facilities")
    both = (a > 0) & (b > 0)
    return out.withColumn("improvement", F.when(both, F.try_divide((b - a) * 100.0, a))).withColumn("seconds_more", F.when(both, F.col(f"{other}_seconds") - F.col(f"{base}_seconds")))


def pivot(results: DataFrame, rows: str, columns: str, names: list[str], value: str = "facilities") -> DataFrame:
    """Sums of ``value``, a column for each of ``names``; given names spare a pass over the data to find them."""
    return results.groupBy(rows).pivot(columns, names).agg(F.coalesce(F.sum(value), F.lit(0))).fillna(0)


def files(listing: DataFrame, size: str = "length") -> DataFrame:
    return listing.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.round(F.coalesce(F.sum(size), F.lit(0)) / (1024 * 1024), 2).alias("megabytes"))


def duplicates(marked: DataFrame) -> DataFrame:
    """Of records marked by the greedy scan: all, duplicates and unique ones."""
    return marked.agg(F.count("*").alias("n"), F.count_if("is_duplicate").alias("n_duplicates"), F.count_if(~F.col("is_duplicate")).alias("n_unique"))


def flags(reports: DataFrame) -> DataFrame:
    return reports.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def confidences(reports: DataFrame, confidence: str = "overall_confidence") -> DataFrame:
    """How many reports are of high (over 0.8), medium (over 0.5) and low confidence."""
    c = F.col(confidence)
    return reports.agg(F.count_if(c > 0.8).alias("high"), F.count_if((c > 0.5) & (c <= 0.8)).alias("medium"), F.count_if(c <= 0.5).alias("low"))


def overall_quality(completeness: Column, accuracy: Column, consistency: Column, freshness: Column) -> Column:
    """The weighted sum of the four declared criteria, each from 0 to 1; unknown ones count as 0."""
    parts = dict(completeness=completeness, accuracy=accuracy, consistency=consistency, freshness=freshness)
    return reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0.0)) * K.QUALITY_WEIGHTS[name] for name, c in parts.items()))


def quality_filter(reports: DataFrame, least: float = 0.6) -> DataFrame:
    """Records whose report is likely valid and above a confidence."""
    return reports.where(F.col("is_likely_valid") & (F.col("overall_confidence") > least))


def cached(requests: DataFrame, cache: DataFrame, as_of: Column, hours: int = 168) -> DataFrame:
    """``requests(domain)`` with the schema of ``cache(domain, schema, created)`` that is younger than ``hours``, the latest; null if none."""
    fresh = cache.where(F.col("created") > as_of - F.expr(f"interval {int(hours)} hours"))
    latest = fresh.groupBy("domain").agg(F.max_by("schema", F.struct("created", "schema")).alias("schema"))
    return requests.join(latest, "domain", "left")
