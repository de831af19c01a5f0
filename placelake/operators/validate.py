"""Validation of contacts, reports and their summaries; scores of completeness and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelake import constants as K
from placelake.operators.numbering import MOBILE

MOBILE_SHARE = 0.8
"""What a valid or possible number's confidence comes to if it is a mobile's."""

EMAIL_OK = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"
URL_OK = r"^https?://[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(:[0-9]+)?([/?#].*)?$"
# A rule for North American numbers stands in for a numbering library.
NANP = r"^[2-9](?!11)[0-9]{2}[2-9][0-9]{6}$"


def _result(name: str, value: Column, valid: Column, confidence: Column) -> Column:
    return F.struct(F.lit(name).alias("field_name"), value.alias("original_value"), valid.alias("is_valid"), confidence.cast("double").alias("confidence"))


def phone_confidence(phone: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(phone, F.lit("")), r"\D", "")
    ten = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)
    return F.when(digits == "", 0.0).when(ten.rlike(NANP), 0.95).when(F.length(digits).isin(10, 11), 0.7).otherwise(0.3)


def address_confidence(address: Column) -> Column:
    a = F.coalesce(address, F.lit(""))
    count = lambda ps: sum((F.when(a.rlike(f"(?i){p}"), 1).otherwise(0) for p in ps), F.lit(0))
    return count(K.ADDRESS_NEEDS) / 2 * 0.7 + count(K.ADDRESS_MAY) / 3 * 0.3


def address_valid(address: Column) -> Column:
    a = F.coalesce(address, F.lit(""))
    return a.rlike(K.ADDRESS_NEEDS[0]) & a.rlike(f"(?i){K.ADDRESS_NEEDS[1]}")


def email_confidence(email: Column) -> Column:
    e = F.coalesce(email, F.lit(""))
    common = F.lower(F.regexp_extract(e, r"@(.*)$", 1)).isin(*K.MAIL_PROVIDERS)
    return F.when(e == "", 0.0).when(~e.rlike(EMAIL_OK), 0.1).when(common, 0.7).otherwise(0.9)


def url_confidence(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    return F.when(u == "", 0.0).when(u.rlike(URL_OK), 0.95).otherwise(0.1)


def report(df: DataFrame) -> DataFrame:
    """Field results, flags, overall confidence and verdict of each record; only fields that aren't blank are judged.

    Where ``df`` has a number_type (``numbering.with_plan``), mobile numbers are flagged and count less.
    """
    mobile = F.coalesce(F.col("number_type") == MOBILE, F.lit(False)) if "number_type" in df.columns else F.lit(False)
    get = lambda c: F.coalesce(F.col(c), F.lit(""))
    address = F.array_join(F.filter(F.array(*(get(c) for c in ("address", "city", "state", "zip_code"))), lambda x: x != ""), ", ")
    cases = [
        ("phone", get("phone"), phone_confidence(get("phone")) >= 0.95, phone_confidence(get("phone")) * F.when(mobile, MOBILE_SHARE).otherwise(1.0), "invalid_phone_format"),
        ("address", address, address_valid(address), address_confidence(address), "invalid_address"),
        ("website", get("website"), url_confidence(get("website")) >= 0.95, url_confidence(get("website")), "invalid_website"),
        ("email", get("email"), email_confidence(get("email")) >= 0.7, email_confidence(get("email")), "invalid_email"),
    ]
    fields = F.filter(F.array(*(F.when(v != "", _result(n, v, ok, c)) for n, v, ok, c, _ in cases)), lambda x: x.isNotNull())
    flags = F.filter(F.array(*(F.when((v != "") & ~ok, F.lit(flag)).when((v != "") & (mobile if n == "phone" else F.lit(False)), "mobile_phone_number") for n, v, ok, _, flag in cases), F.when(email_confidence(get("email")) == 0.7, "generic_email_provider")), lambda x: x.isNotNull())
    df = df.withColumn("field_validations", fields).withColumn("flags", flags)
    positive = F.filter("field_validations", lambda x: x["confidence"] > 0)
    mean = F.when(F.size(positive) > 0, F.aggregate(positive, F.lit(0.0), lambda a, x: a + x["confidence"]) / F.size(positive)).otherwise(0.0)
    n_valid = F.size(F.filter("field_validations", lambda x: x["is_valid"]))
    return df.withColumn("overall_confidence", mean).withColumn("n_fields", F.size("field_validations")).withColumn("n_valid", n_valid).withColumn("is_likely_valid", F.expr("overall_confidence > 0.6 and n_valid >= 0.5 * n_fields"))


def summary_by_field(reports: DataFrame) -> DataFrame:
    x = reports.select(F.explode("field_validations").alias("f")).select("f.*")
    return x.groupBy("field_name").agg(F.count("*").alias("total"), F.count_if("is_valid").alias("valid"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


def completeness(required: list[Column], optional: list[Column]) -> Column:
    share = lambda cs: sum((F.when(F.coalesce(F.trim(c), F.lit("")) != "", 1).otherwise(0) for c in cs), F.lit(0)) / len(cs)
    return share(required) * 0.7 + share(optional) * 0.3


def method_score(method: Column) -> Column:
    out = F.when(F.lit(False), 0.0)
    for name, value in K.METHOD_SCORES.items():
        out = out.when(method == name, value)
    return out.otherwise(K.OTHER_METHOD)


def mean_of_present(*columns: Column) -> Column:
    have = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.when(F.size(have) > 0, F.aggregate(have, F.lit(0.0), lambda a, x: a + x) / F.size(have))


def primary_method(df: DataFrame, method: str, order: str, *by: str) -> DataFrame:
    """The most frequent method of each group, of equal ones the first seen."""
    n = df.groupBy(*by, method).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    return n.groupBy(*by).agg(F.max_by(method, F.struct("n", -F.col("seen"))).alias("primary_method"))


def valid_facility(name: Column, *places: Column, generic: tuple[str, ...] = K.GENERIC_NAMES) -> Column:
    n = F.trim(F.coalesce(name, F.lit("")))
    some = F.lit(False)
    for p in places:
        some = some | (F.trim(F.coalesce(p, F.lit(""))) != "")
    return (F.length(n) >= 3) & ~F.lower(n).isin(*generic) & some
