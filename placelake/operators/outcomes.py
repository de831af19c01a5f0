"""What lookups, runs and failures make of records: geocodes, reachability, repeated and broken records, fallbacks.

Services are tables here: their answers are joined by equality, and a record without an answer counts as
one that the service didn't reach. Null and blank fields are never matched with each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelake import constants as K
from placelake.operators import validate as V


def _by(value: Column, scores: dict[str, float], other: float) -> Column:
    return reduce(lambda out, x: out.when(value == x[0], x[1]), scores.items(), F.when(F.lit(False), 0.0)).otherwise(other)


def both(valid: Column, confidence: Column, other_valid: Column, other: Column) -> Column:
    """Of a format's and a service's verdict: valid if both are, and the mean confidence."""
    return F.struct((valid & other_valid).alias("is_valid"), ((confidence + other) / 2).alias("confidence"))


def with_geocodes(records: DataFrame, places: DataFrame, address: str = "address") -> DataFrame:
    """``records`` with ``address_check``, from the format and ``places(address, status, formatted)``.

    Of several answers for an address that of the best status counts, then the least formatted one.

    status is found, missing, service_error or anything else for another failure; no row is a service error. A blank
    address isn't valid, with confidence 0.
    """
    known = F.coalesce("status", F.lit("error"))
    best = F.min_by(F.struct(known.alias("status"), "formatted"), F.struct(-_by(known, K.GEOCODE_SCORES, 0.0), known, F.col("formatted").isNull(), "formatted"))
    side = places.groupBy(F.col("address").alias("__address")).agg(best.alias("__best")).select("__address", F.col("__best.status").alias("__status"), F.col("__best.formatted").alias("corrected_address"))
    out = records.join(side, F.col(address) == F.col("__address"), "left")
    status = F.coalesce("__status", F.lit("service_error"))
    a = F.coalesce(F.col(address), F.lit(""))
    check = both(V.address_valid(a), V.address_confidence(a), status == "found", _by(status, K.GEOCODE_SCORES, 0.0))
    check = F.when(a != "", check).otherwise(F.struct(F.lit(False).alias("is_valid"), F.lit(0.0).alias("confidence")))
    return out.withColumn("address_check", check).drop("__address", "__status")


def with_fetches(records: DataFrame, fetches: DataFrame, url: str = "website", by: tuple[str, ...] = ()) -> DataFrame:
    """``records`` with ``website_check``, from the format and ``fetches(url, status_code, error, final_url, html)``.

    With ``by``, columns of both, a record takes the answers to its own requests alone, and not those that others with its URL got.
    Of several answers for a URL one without error counts before others, then the least status code, final URL and title; nulls come last.

    error is null, timeout or another failure; no row is a failure. ``title`` is that of the page that was found. A blank
    URL isn't valid, with confidence 0.
    """
    title = F.trim(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<title>(.*?)</title>", 1))
    side = fetches.select(F.col("url").alias("__url"), *(F.col(c).alias(f"__{c}") for c in by), "status_code", "error", F.col("final_url").alias("corrected_website"), F.when(title != "", title).alias("title"))
    rest = ("status_code", "corrected_website", "title", "error")
    order = F.struct(F.col("error").isNotNull().alias("bad"), *(x for c in rest for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))))
    key = ["__url", *(f"__{c}" for c in by)]
    side = side.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("__best")).select(*key, "__best.*", F.lit(True).alias("__known"))
    same = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"__{c}") for c in by), F.col(url) == F.col("__url"))
    out = records.join(side, same, "left")
    good = F.coalesce(F.col("error").isNull() & (F.col("status_code") == 200), F.lit(False))
    score = F.when(F.col("__known").isNull(), K.FETCH_FAILED).when(F.col("error") == "timeout", K.FETCH_TIMEOUT).when(F.col("error").isNotNull() | F.col("status_code").isNull(), K.FETCH_FAILED)
    score = score.when(good, K.FETCH_GOOD).otherwise(K.FETCH_OTHER)
    u = F.coalesce(F.col(url), F.lit(""))
    check = F.when(u != "", both(V.url_confidence(u) >= 0.95, V.url_confidence(u), good, score)).otherwise(F.struct(F.lit(False).alias("is_valid"), F.lit(0.0).alias("confidence")))
    return out.withColumn("website_check", check).drop(*key, "__known", "status_code", "error")


def mark_repeats(records: DataFrame, order: str, *key: str) -> DataFrame:
    """``duplicate_of``: the least ``order`` of the records of equal ``key``, null for that record itself; records with a blank part of the key repeat nothing."""
    blank = reduce(lambda a, b: a | b, (F.coalesce(F.trim(F.col(c)), F.lit("")) == "" for c in key))
    whole = records.where(~blank)
    first = whole.groupBy(*key).agg(F.min(order).alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    again = F.when(F.col("__first") != F.col(order), F.col("__first")).alias("duplicate_of")
    found = whole.join(first, list(key), "left").select(*records.columns, again)
    return found.unionByName(records.where(blank).withColumn("duplicate_of", F.lit(None).cast(records.schema[order].dataType)))


def read_records(df: DataFrame, column: str, schema: str) -> DataFrame:
    """``record`` out of JSON text and ``broken``: text that isn't such a record. A broken row never stops the others; null text is broken."""
    parsed = F.from_json(column, f"{schema}, __broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"})
    out = df.withColumn("__parsed", parsed)
    return out.withColumn("broken", F.col("__parsed").isNull() | F.col("__parsed.__broken").isNotNull()).withColumn("record", F.col("__parsed").dropFields("__broken")).drop("__parsed")


def error_report(df: DataFrame) -> DataFrame:
    """Reports of the broken rows of ``read_records``: no confidence, one flag, not valid."""
    return df.where("broken").withColumn("overall_confidence", F.lit(0.0)).withColumn("flags", F.array(F.lit("validation_error"))).withColumn("is_likely_valid", F.lit(False))


def slim(reports: DataFrame) -> DataFrame:
    """Reports whose field results go without the original values."""
    return reports.withColumn("field_validations", F.transform("field_validations", lambda x: F.struct(x["field_name"].alias("field_name"), x["is_valid"].alias("is_valid"), x["confidence"].alias("confidence"))))


def rates(reports: DataFrame) -> DataFrame:
    """The share of reports of high confidence and of flagged ones; 0 of none."""
    n = F.count("*")
    share = lambda c: F.coalesce(F.try_divide(F.count_if(c), n), F.lit(0.0))
    return reports.agg(n.alias("n"), share(F.col("overall_confidence") > 0.8).alias("high_confidence_rate"), share(F.size("flags") > 0).alias("flagged_rate"))


def fallback(found: Column, error: Column) -> Column:
    """Method and confidence of the extraction that stands in for one that failed: ``found`` records, or none with an ``error``."""
    failed = error.isNotNull()
    return F.struct(
        F.when(failed, "failed").otherwise("fallback_schema").alias("method"),
        F.when(failed, 0.0).otherwise(0.4).alias("confidence"),
        F.when(failed, 0).otherwise(F.coalesce(found, F.lit(0))).alias("n_facilities"),
    )


def corrected_phone(phone: Column) -> Column:
    """A valid number in its national form, else null."""
    digits = F.regexp_replace(F.coalesce(phone, F.lit("")), r"\D", "")
    ten = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)
    return F.when(ten.rlike(V.NANP), F.concat(F.lit("("), F.substring(ten, 1, 3), F.lit(") "), F.substring(ten, 4, 3), F.lit("-"), F.substring(ten, 7, 4)))


def finished(results: DataFrame) -> DataFrame:
    """Results with the minutes between ``started`` and ``ended``, to two places; null if either is."""
    seconds = F.col("ended").cast("timestamp").cast("double") - F.col("started").cast("timestamp").cast("double")
    return results.withColumn("processing_time_minutes", F.round(seconds / 60, 2))


def run_summary(results: DataFrame) -> DataFrame:
    """The eight columns of a run's summary, a row per organisation; missing values as blanks and zeros, files joined."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return results.select(
        text("corporation_name").alias("corporation_name"), text("url").alias("url_scraped"), F.coalesce("facilities_count", F.lit(0)).alias("facilities_found"),
        F.coalesce("success", F.lit(False)).alias("scraping_success"), text("scraping_date").alias("scraping_date"), F.coalesce("processing_time_minutes", F.lit(0.0)).alias("processing_time_minutes"),
        text("error").alias("error_message"), F.coalesce(F.array_join("files", "|"), F.lit("")).alias("output_files"),
    )


def word_chunks(text: Column, size: int, overlap: int) -> Column:
    """Array of chunks of ``size`` words, each beginning with the last ``overlap`` of the one before; null and blank text has none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\r\n]+"), F.lit(0))
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - overlap, F.lit(1)) - 1, F.lit(size - overlap))
    return F.when(F.size(words) > 0, F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, F.lit(size)), " "))).otherwise(F.array().cast("array<string>"))


def confident(records: DataFrame, least: float = 0.8, name: str = "name", confidence: str = "confidence") -> DataFrame:
    """Records with a name and a confidence above ``least``; without a confidence it is 0. Names of spaces count as names."""
    return records.where((F.coalesce(F.col(name), F.lit("")) != "") & (F.coalesce(F.col(confidence), F.lit(0.0)) > least))
