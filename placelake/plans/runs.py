"""Queries over plans, runs, methods, validations and quality, with SQL of equal meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelake import constants as K
from placelake.functions import text as T
from placelake.operators import dedup as D
from placelake.operators import summaries as S
from placelake.operators import validate as V
from placelake.plans.locations import GREEDY, chains, facilities
from placelake.plans.registry import query, table

_PRIORITY = "cast(substr(o_orderpriority, 1, 1) AS integer) AS priority"


@query(f"SELECT {_PRIORITY}, count(*) AS total_chains, ceil(count(*) / 10)::BIGINT AS total_batches, sum(floor(o_totalprice)::BIGINT)::BIGINT AS estimated_facilities, (count(*) * 0.5)::DOUBLE AS estimated_hours FROM orders GROUP BY 1")
def chain_plan(spark, d):
    return S.plan(chains(spark, d), by="priority")


@query(f"""SELECT {_PRIORITY}, count(*) AS n, count(*) FILTER (o_orderstatus <> 'F') AS n_success, count(*) FILTER (o_orderstatus = 'F') AS n_failed, coalesce(sum(o_custkey) FILTER (o_orderstatus <> 'F'), 0)::BIGINT AS facilities,
  round(count(*) FILTER (o_orderstatus <> 'F') / count(*), 6)::DOUBLE AS success_rate, round(coalesce(sum(o_custkey) FILTER (o_orderstatus <> 'F'), 0) / count(*), 6)::DOUBLE AS facilities_per_url, round(avg(o_custkey % 7), 6)::DOUBLE AS avg_seconds FROM orders GROUP BY 1""")
def run_rates(spark, d):
    o = table(spark, d, "orders").select(F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), (F.col("o_orderstatus") != "F").alias("success"), F.col("o_custkey").alias("facilities"), (F.col("o_custkey") % 7).alias("seconds"))
    rates = ("success_rate", "facilities_per_url", "avg_seconds")
    out = S.runs(o, "priority")
    return out.select(*(F.round(c, 6).alias(c) if c in rates else F.col(c) for c in out.columns))


@query("SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS n_schema, count(*) FILTER (event_type = 'signup') AS n_regex, round(count(*) FILTER (event_type = 'error') / count(*), 6)::DOUBLE AS schema_rate, round(count(*) FILTER (event_type = 'signup') / count(*), 6)::DOUBLE AS regex_rate FROM events")
def method_rates(spark, d):
    out = S.method_rates(table(spark, d, "events"), {"error": "schema", "signup": "regex"}, "event_type")
    return out.select("n", "n_schema", "n_regex", *(F.round(c, 6).alias(c) for c in ("schema_rate", "regex_rate")))


@query("""WITH s AS (SELECT l_suppkey, coalesce(sum(l_linenumber) FILTER (l_returnflag = 'A'), 0)::BIGINT AS a_facilities, round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0), 2)::DOUBLE AS a_seconds,
  coalesce(sum(l_linenumber) FILTER (l_returnflag = 'R'), 0)::BIGINT AS r_facilities, round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0), 2)::DOUBLE AS r_seconds FROM lineitem GROUP BY 1)
  SELECT l_suppkey, a_facilities, r_facilities, CASE WHEN a_facilities > 0 AND r_facilities > 0 THEN round((r_facilities - a_facilities) * 100 / a_facilities, 4)::DOUBLE END AS improvement, CASE WHEN a_facilities > 0 AND r_facilities > 0 THEN round(r_seconds - a_seconds, 2)::DOUBLE END AS seconds_more FROM s""")
def method_comparison(spark, d):
    x = table(spark, d, "lineitem").select("l_suppkey", F.lower("l_returnflag").alias("method"), F.col("l_linenumber").alias("facilities"), F.col("l_quantity").alias("seconds"))
    return S.compare(x, "a", "r", "l_suppkey").select("l_suppkey", "a_facilities", "r_facilities", F.round("improvement", 4).alias("improvement"), F.round("seconds_more", 2).alias("seconds_more"))


@query("SELECT l_returnflag, coalesce(sum(l_linenumber) FILTER (l_linestatus = 'O'), 0)::BIGINT AS O, coalesce(sum(l_linenumber) FILTER (l_linestatus = 'F'), 0)::BIGINT AS F FROM lineitem GROUP BY 1")
def approach_pivot(spark, d):
    return S.pivot(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["O", "F"], "l_linenumber")


@query("SELECT count(*) AS n, coalesce(sum(n_chars), 0)::BIGINT AS bytes, round(coalesce(sum(n_chars), 0) / 1048576, 2)::DOUBLE AS megabytes FROM documents")
def file_summary(spark, d):
    return S.files(table(spark, d, "documents"), "n_chars")


@query(f"WITH RECURSIVE {GREEDY} SELECT count(*) AS n, count(*) FILTER (dup) AS n_duplicates, count(*) FILTER (NOT dup) AS n_unique FROM g WHERE i > 0")
def dedup_statistics(spark, d):
    return S.duplicates(D.greedy(facilities(spark, d), "ord"))


def _contacts(spark: SparkSession, d: str) -> DataFrame:
    """Reports of the contacts found in documents."""
    blank = (F.lit("").alias(c) for c in ("address", "city", "state", "zip_code", "website"))
    return V.report(table(spark, d, "documents").select("doc_id", T.phone(F.col("text")).alias("phone"), T.email(F.col("text")).alias("email"), *blank))


_CONTACTS = rf"""x AS (SELECT doc_id, regexp_extract(coalesce(text, ''), '{K.PHONE}', 1) AS phone, regexp_extract(coalesce(text, ''), '{K.EMAIL}', 1) AS email FROM documents),
  y AS (SELECT *, regexp_replace(phone, '\D', '', 'g') AS n FROM x), z AS (SELECT *, CASE WHEN length(n) = 11 AND starts_with(n, '1') THEN substr(n, 2) ELSE n END AS t FROM y),
  v AS (SELECT *, CASE WHEN n = '' THEN 0.0 WHEN regexp_matches(t, '^[2-9][0-9]{{2}}[2-9][0-9]{{6}}$') AND substr(t, 2, 2) <> '11' THEN 0.95 WHEN length(n) IN (10, 11) THEN 0.7 ELSE 0.3 END::DOUBLE AS pc,
   CASE WHEN email = '' THEN 0.0 WHEN NOT regexp_matches(email, '{V.EMAIL_OK}') THEN 0.1 WHEN regexp_extract(lower(email), '@(.*)$', 1) IN ('gmail.com', 'yahoo.com', 'hotmail.com', 'outlook.com') THEN 0.7 ELSE 0.9 END::DOUBLE AS ec FROM z),
  r AS (SELECT *, (pc > 0)::INT + (ec > 0)::INT AS n_fields, (pc >= 0.95)::INT + (ec >= 0.7)::INT AS n_valid, CASE WHEN pc + ec > 0 THEN (pc + ec) / ((pc > 0)::INT + (ec > 0)::INT) ELSE 0.0 END AS overall FROM v)"""


@query(f"WITH {_CONTACTS} SELECT doc_id, pc AS confidence FROM r")
def validate_phone(spark, d):
    return table(spark, d, "documents").select("doc_id", V.phone_confidence(T.phone(F.col("text"))).alias("confidence"))


@query(f"""WITH {_CONTACTS}, f AS (SELECT 'invalid_phone_format' AS flag FROM r WHERE pc > 0 AND pc < 0.95 UNION ALL SELECT 'invalid_email' FROM r WHERE ec > 0 AND ec < 0.7 UNION ALL SELECT 'generic_email_provider' FROM r WHERE ec = 0.7)
  SELECT flag, count(*) AS n FROM f GROUP BY 1""")
def validation_flags(spark, d):
    return S.flags(_contacts(spark, d))


@query(f"WITH {_CONTACTS} SELECT count(*) FILTER (overall > 0.8) AS high, count(*) FILTER (overall > 0.5 AND overall <= 0.8) AS medium, count(*) FILTER (overall <= 0.5) AS low FROM r")
def confidence_buckets(spark, d):
    return S.confidences(_contacts(spark, d))


@query(f"WITH {_CONTACTS} SELECT doc_id, round(overall, 6)::DOUBLE AS overall_confidence FROM r WHERE overall > 0.6 AND n_valid >= 0.5 * n_fields")
def quality_filter(spark, d):
    return S.quality_filter(_contacts(spark, d)).select("doc_id", F.round("overall_confidence", 6).alias("overall_confidence"))


@query("SELECT c_custkey, round(0.4 * ((c_custkey % 3) / 2) + 0.3 * ((c_custkey % 5) / 4) + 0.2 * ((c_custkey % 2) / 1), 6)::DOUBLE AS quality FROM customer")
def declared_quality(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.round(S.overall_quality((k % 3) / 2, (k % 5) / 4, (k % 2) / 1, F.lit(None).cast("double")), 6).alias("quality"))


@query("""WITH m AS (SELECT user_id, avg(CASE event_type WHEN 'error' THEN 0.5 ELSE 0.85 END) AS methods, avg(value / 1000) FILTER (event_type = 'error') AS validation FROM events GROUP BY 1)
  SELECT user_id, round((0.4 + methods + coalesce(validation, 0)) / CASE WHEN validation IS NULL THEN 2 ELSE 3 END, 6)::DOUBLE AS confidence FROM m""")
def confidence(spark, d):
    """The mean of the site's, the methods' and, where there are reports, the validation's confidence."""
    e = table(spark, d, "events")
    score = F.avg(V.method_score(F.when(F.col("event_type") == "error", "other").otherwise("predefined_schema")))
    checked = F.avg(F.when(F.col("event_type") == "error", F.col("value") / 1000))
    x = e.groupBy("user_id").agg(score.alias("methods"), checked.alias("validation"))
    return x.select("user_id", F.round(V.mean_of_present(F.lit(0.4), F.col("methods"), F.col("validation")), 6).alias("confidence"))


@query("""WITH f AS (SELECT user_id, arg_max(event_type, (ts, event_type)) AS schema FROM events WHERE ts > timestamp '2024-01-08 00:00:00' - INTERVAL 168 HOURS GROUP BY 1)
  SELECT c_custkey AS domain, schema FROM customer LEFT JOIN f ON user_id = c_custkey""")
def schema_cache(spark, d):
    cache = table(spark, d, "events").select(F.col("user_id").alias("domain"), F.col("event_type").alias("schema"), F.col("ts").alias("created"))
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("domain"))
    return S.cached(wanted, cache, F.expr("timestamp '2024-01-08 00:00:00'"))


@query(r"""WITH x AS (SELECT c_custkey, c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ', TX ' ELSE ' ' END || lpad((c_custkey % 90000)::VARCHAR, 5, '7') AS line FROM customer)
  SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN split_part(line, ',', 1) END AS city, CASE WHEN c_custkey % 2 = 0 THEN 'TX' END AS state, CASE WHEN c_custkey % 2 = 0 THEN right(line, 5) END AS zip_code FROM x""")
def city_state_zip(spark, d):
    line = F.concat("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, ", TX ").otherwise(" "), F.lpad((F.col("c_custkey") % 90000).cast("string"), 5, "7"))
    return table(spark, d, "customer").select("c_custkey", T.city_state_zip(line).alias("x")).select("c_custkey", "x.*")
