"""Numbering plans: what kind of line a phone number is, where it is and whose, by its longest known prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOBILE = "mobile"
PLAN = "prefix string, number_type string, location string, carrier string"


def international(phone: Column, country: str = "1", national: int = 10) -> Column:
    """The digits of a number with its country's code: of one that begins with + or 00 its own, else ``country`` before ``national`` digits; null if neither."""
    text = F.trim(F.coalesce(phone, F.lit("")))
    digits = F.regexp_replace(text, r"[^0-9]", "")
    own = F.when(text.startswith("+"), digits).when(digits.startswith("00"), F.substring(digits, 3, 100))
    bare = F.when(F.length(digits) == national, F.concat(F.lit(country), digits)).when((F.length(digits) == national + len(country)) & digits.startswith(country), digits)
    return F.nullif(F.coalesce(own, bare), F.lit(""))


def with_plan(df: DataFrame, plans: DataFrame, phone: str = "phone", country: str = "1") -> DataFrame:
    """``df`` with number_type, location and carrier of its phones, from ``plans(prefix, number_type, location, carrier)``.

    Each distinct number is looked up once, by equal prefixes of every length that the plans have; the longest wins, and of
    plans with one prefix the least row. Blank and unknown numbers, and prefixes that aren't digits, give nulls.
    """
    known = plans.where(r"prefix rlike '^[0-9]{1,15}$'").groupBy("prefix").agg(F.min(F.struct("number_type", "location", "carrier")).alias("plan"))
    lengths = sorted(r[0] for r in known.select(F.length("prefix")).distinct().collect())  # fifteen at most
    rows = df.withColumn("_number", international(F.col(phone), country))
    numbers = rows.where("_number is not null").select("_number").distinct()
    sizes = F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")
    cut = numbers.select("_number", F.explode(sizes).alias("size")).where("size <= length(_number)").withColumn("prefix", F.expr("substring(_number, 1, size)"))
    best = cut.join(known, "prefix").groupBy("_number").agg(F.max_by("plan", "size").alias("plan"))
    return rows.join(best, "_number", "left").select(*df.columns, "plan.number_type", "plan.location", "plan.carrier")
