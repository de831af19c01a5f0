"""Queries over links, contacts, catalogs, deduplication and validation, with SQL of equal meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelake import constants as K
from placelake.functions import text as T
from placelake.functions import urls as U
from placelake.operators import catalog as C
from placelake.operators import dedup as D
from placelake.operators import extract as E
from placelake.operators import links as L
from placelake.operators import validate as V
from placelake.plans.registry import query, table

# words of the test tables in the place of the default weights, which hardly occur there
WEIGHTS = {"blog": 7, "utm_": -3, "page=": 2, "/en/": 4, "the": 1}
TYPES = {"plain": ("the", "of"), "double": ("ing", "and"), "other": ("die", "le")}


_RFC = "'^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#(.*))?'"
_PART = lambda c, i: f"regexp_extract({c}, {_RFC}, {i})"
_SEG = lambda c: f"len(list_filter(string_split({_PART(c, 3)}, '/'), lambda x: x <> ''))"
LINKS = f"""links AS (SELECT page_id, base, i - 1 AS pos, hrefs[i] AS href, CASE WHEN regexp_matches(hrefs[i], '^[A-Za-z][A-Za-z0-9+.-]*:') THEN hrefs[i] ELSE {_PART('base', 1)} || '://' || {_PART('base', 2)} || hrefs[i] END AS url
  FROM (SELECT *, unnest(range(1, len(hrefs) + 1)) AS i FROM (SELECT page_id, url AS base, regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1) AS hrefs FROM pages)))"""


def _score_sql(url: str, base: str, weights: dict[str, int], good: str = "|".join(K.URL_GOOD), bad: str = "|".join(K.URL_BAD)) -> str:
    p, q = f"lower({_PART(url, 3)})", f"lower({_PART(url, 4)})"
    words = "".join(f" + CASE WHEN contains(lower({url}), '{w}') THEN {v} ELSE 0 END" for w, v in weights.items())
    return f"""(CASE WHEN {_SEG(url)} - {_SEG(base)} > 3 THEN -100 ELSE -2 * ({_SEG(url)} - {_SEG(base)})
      + CASE WHEN regexp_matches({p}, '{good}') OR regexp_matches({q}, '{good}') THEN 20 ELSE 0 END + CASE WHEN regexp_matches({p}, '{bad}') THEN -50 ELSE 0 END {words}
      + CASE WHEN contains({p}, '/our-') AND regexp_matches({p}, 'location|facilities|communities') THEN 15 ELSE 0 END
      + CASE WHEN contains({q}, 'page=') OR contains({p}, '/page/') THEN 5 ELSE 0 END
      + CASE WHEN regexp_matches({p}, '\\.(pdf|doc|docx|xls|xlsx)$') THEN -30 ELSE 0 END END)::BIGINT"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return L.links(table(spark, d, "pages")).withColumn("score", U.score(F.col("url"), F.col("base"), WEIGHTS))


_SCORED = f"WITH {LINKS}, scored AS (SELECT *, {_score_sql('url', 'base', WEIGHTS)} AS score FROM links)"


@query(f"WITH {LINKS} SELECT page_id, pos::BIGINT AS pos, href, url FROM links")
def link_extract(spark, d):
    return L.links(table(spark, d, "pages")).select("page_id", F.col("pos").cast("long").alias("pos"), "href", "url")


@query(f"SELECT page_id, {_PART('url', 1)} AS scheme, {_PART('url', 2)} AS authority, {_PART('url', 3)} AS path, {_PART('url', 4)} AS query, {_PART('url', 5)} AS fragment FROM pages")
def url_parts(spark, d):
    return table(spark, d, "pages").select("page_id", *(U.part(F.col("url"), i).alias(n) for i, n in enumerate(("scheme", "authority", "path", "query", "fragment"), 1)))


@query(f"WITH {LINKS} SELECT page_id, pos::BIGINT AS pos, ({_SEG('url')} - {_SEG('base')})::BIGINT AS depth FROM links")
def url_depth(spark, d):
    return L.links(table(spark, d, "pages")).select("page_id", F.col("pos").cast("long").alias("pos"), U.depth(F.col("url"), F.col("base")).cast("long").alias("depth"))


@query(f"SELECT page_id, {_score_sql('url', chr(39) + chr(39), K.URL_KEYWORDS)} AS score FROM pages")
def url_score(spark, d):
    return table(spark, d, "pages").select("page_id", U.score(F.col("url"), F.lit("")).alias("score"))


@query(f"{_SCORED} SELECT page_id, pos::BIGINT AS pos, url, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS rank FROM scored) WHERE rank <= 10")
def url_rank_topk(spark, d):
    return L.top_links(_scored(spark, d), 10).select("page_id", F.col("pos").cast("long").alias("pos"), "url", "score", F.col("rank").cast("long").alias("rank"))


@query(f"{_SCORED} SELECT page_id, url, score FROM scored WHERE score >= 0")
def url_filter(spark, d):
    return _scored(spark, d).where("score >= 0").select("page_id", "url", "score")


@query(f"{_SCORED} SELECT count(*) AS n, round(avg(score), 6) AS avg_score FROM scored")
def frontier_stats(spark, d):
    return L.frontier_statistics(_scored(spark, d)).select("n", F.round("avg_score", 6).alias("avg_score"))


_ANY = lambda c, parts: f"regexp_matches(lower({c}), '{'|'.join(parts)}')"


@query(f"""SELECT page_id, CASE WHEN regexp_matches(lower(url), '{K.DETAIL_URL}') THEN 'detail' WHEN {_ANY('url', K.LISTING_PARTS)} THEN 'listing' ELSE 'other' END AS kind, {_ANY('url', K.EXCLUDED_PARTS)} AS excluded,
  CASE WHEN {_ANY('url', K.LISTING_PARTS)} THEN true WHEN {_ANY('url', K.EXCLUDED_PARTS)} THEN false ELSE {_ANY(_PART('url', 3), K.SEGMENT_PARTS)} END AS facility FROM pages""")
def url_classify(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", U.classify(u).alias("kind"), U.is_excluded(u).alias("excluded"), U.is_facility(u).alias("facility"))


@query(f"WITH {LINKS} SELECT page_id, count(*) FILTER ({_PART('url', 2)} = {_PART('base', 2)}) AS n_same, count(*) AS n FROM links GROUP BY 1")
def same_domain(spark, d):
    x = L.links(table(spark, d, "pages"))
    return x.groupBy("page_id").agg(F.count_if(U.same_domain(F.col("url"), F.col("base"))).alias("n_same"), F.count("*").alias("n"))


@query("SELECT page_id, CASE WHEN lower(url) LIKE '%/en/%' THEN 'english' WHEN lower(url) LIKE 'https://m.%' THEN 'mobile' WHEN lower(url) LIKE '%page=%' THEN 'paged' ELSE 'none' END AS schema_name FROM pages")
def glob_schema_select(spark, d):
    out = F.when(F.lit(False), "")
    for pattern, name in (("*/en/*", "english"), ("https://m.*", "mobile"), ("*page=*", "paged")):
        out = out.when(U.glob(F.col("url"), pattern), name)
    return table(spark, d, "pages").select("page_id", out.otherwise("none").alias("schema_name"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_extract(html, '(?i)<title>(.*?)</title>', 1), '\s*\|.*$', ''), '\s*-.*$', '') AS title FROM pages")
def title_clean(spark, d):
    return table(spark, d, "pages").select("page_id", T.title(T.first(F.col("html"), "(?i)<title>(.*?)</title>")).alias("title"))


_PHONE_CLEAN = "CASE WHEN length(t) = 10 THEN '(' || substr(t, 1, 3) || ') ' || substr(t, 4, 3) || '-' || substr(t, 7, 4) ELSE t END"


@query(rf"""SELECT doc_id, phone, {_PHONE_CLEAN} AS cleaned FROM (SELECT *, CASE WHEN length(c) = 11 AND starts_with(c, '1') THEN substr(c, 2, 10) ELSE c END AS t FROM
  (SELECT *, regexp_replace(phone, '[^\d+]', '', 'g') AS c FROM (SELECT doc_id, regexp_extract(coalesce(text, ''), '{K.PHONE}', 1) AS phone FROM documents)))""")
def phone_extract(spark, d):
    return table(spark, d, "documents").select("doc_id", T.phone(F.col("text")).alias("phone")).withColumn("cleaned", T.clean_phone(F.col("phone")))


@query(rf"SELECT doc_id, regexp_extract(coalesce(text, ''), '{K.EMAIL}', 1) AS email, regexp_extract(coalesce(text, ''), '{K.ZIP}', 1) AS zip_code FROM documents")
def contact_extract(spark, d):
    return table(spark, d, "documents").select("doc_id", T.email(F.col("text")).alias("email"), T.zip_code(F.col("text")).alias("zip_code"))


_KW = lambda w: rf"(3 * len(regexp_extract_all(lower(text), '\b{w}\b')) + (length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)} - len(regexp_extract_all(lower(text), '\b{w}\b')))"


@query(f"""SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN '' WHEN a >= b AND a >= c THEN 'plain' WHEN b >= c THEN 'double' ELSE 'other' END AS kind FROM
  (SELECT doc_id, {_KW('the')} + {_KW('of')} AS a, {_KW('ing')} + {_KW('and')} AS b, {_KW('die')} + {_KW('le')} AS c FROM documents)""")
def keyword_classify(spark, d):
    return table(spark, d, "documents").select("doc_id", T.best_type(F.col("text"), TYPES).alias("kind"))


def chains(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("ord"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.concat(F.floor(F.col("o_totalprice")).cast("string"), F.lit("+")).alias("estimated_facilities"), F.col("o_orderdate").cast("date").alias("last_updated"))


@query("SELECT o_orderkey, cast(substr(o_orderpriority, 1, 1) AS integer) AS priority FROM orders WHERE cast(substr(o_orderpriority, 1, 1) AS integer) <= 2")
def chain_filter_priority(spark, d):
    return C.up_to_priority(chains(spark, d), 2).select(F.col("ord").alias("o_orderkey"), "priority")


@query("SELECT s_suppkey, ((row_number() OVER (ORDER BY s_suppkey) - 1) // 7 + 1)::BIGINT AS batch FROM supplier")
def chain_batches(spark, d):
    return C.batches(table(spark, d, "supplier"), 7, "s_suppkey").select("s_suppkey", "batch")


@query("""SELECT cast(substr(o_orderpriority, 1, 1) AS integer) AS priority, count(*) AS n, sum(cast(floor(o_totalprice) AS bigint))::BIGINT AS estimated,
  count(*) FILTER (cast(o_orderdate AS date) < date '1997-01-01' - 30) AS n_due FROM orders GROUP BY 1""")
def chain_stats(spark, d):
    return C.statistics(chains(spark, d), F.lit("1997-01-01").cast("date"))


@query("SELECT o_orderkey, cast(o_orderdate AS date) < date '1997-01-01' - 30 AS is_due FROM orders")
def due_for_update(spark, d):
    return chains(spark, d).select(F.col("ord").alias("o_orderkey"), C.due(F.col("last_updated"), F.lit("1997-01-01").cast("date")).alias("is_due"))


@query("SELECT c_custkey, c_name, n_name AS source_corporation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def consolidate_tag(spark, d):
    corporations = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("source_corporation"))
    return C.tag(table(spark, d, "customer"), corporations, "c_nationkey").select("c_custkey", "c_name", "source_corporation")


@query("SELECT url, min_by(p_brand, p_partkey) AS corporation_name FROM (SELECT p_brand, p_partkey, unnest(list_filter(string_split(p_type, ' '), lambda x: x <> '')) AS url FROM part) GROUP BY 1")
def chain_url_lookup(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("corporation_name"), F.col("p_partkey").alias("ord"), F.split("p_type", " ").alias("w"))
    p = p.withColumn("primary_url", F.col("w")[0]).withColumn("secondary_urls", F.array_join(F.slice("w", 2, 1000), "|"))
    return C.url_owner(p)


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS word FROM part) WHERE word <> '' GROUP BY 1")
def split_explode(spark, d):
    return table(spark, d, "part").select(F.explode(C.pieces(F.col("p_type"), " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT doc_id, key FROM (SELECT doc_id, md5(lower(text)) AS key, row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def key_dedup_first(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.md5(F.lower("text").cast("binary")).alias("key"))  # of whole texts
    return D.first_per_key(x, ["key"], "doc_id")


def facilities(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("ord"), F.col("c_name").alias("name"), F.concat(F.col("c_custkey") % 50, F.lit(" Main St")).alias("address"), F.col("c_mktsegment").alias("city"), F.lit("TX").alias("state"),
        F.lpad((F.col("c_custkey") % 7).cast("string"), 5, "7").alias("zip_code"), F.concat(F.lit("555-201-00"), F.lpad((F.col("c_custkey") % 40).cast("string"), 2, "0")).alias("phone"),
        F.concat(F.lower("c_mktsegment"), F.lit("@gmail.com")).alias("email"), F.lit("https://a.example.com/x").alias("website"),
    )


FACILITIES = """f AS (SELECT c_custkey AS ord, c_name AS name, (c_custkey % 50) || ' Main St' AS address, c_mktsegment AS city, 'TX' AS state, lpad((c_custkey % 7)::VARCHAR, 5, '7') AS zip_code,
  '555-201-00' || lpad((c_custkey % 40)::VARCHAR, 2, '0') AS phone, lower(c_mktsegment) || '@gmail.com' AS email, 'https://a.example.com/x' AS website FROM customer)"""


@query(rf"WITH {FACILITIES}, k AS (SELECT ord, regexp_replace(phone, '\D', '', 'g') AS p, lower(address || '|' || city || '|' || zip_code) AS a, regexp_replace(lower(name), '[^\w\s]', '', 'g') AS n FROM f) SELECT ord, substr(md5(p), 1, 8) AS phone_hash, substr(md5(a), 1, 8) AS address_hash, substr(md5(n), 1, 8) AS name_hash, md5(p || '|' || a || '|' || n) AS full_hash FROM k")
def dedup_signature(spark, d):
    return D.signature(facilities(spark, d)).select("ord", "phone_hash", "address_hash", "name_hash", "full_hash")


@query(rf"""WITH {FACILITIES}, k AS (SELECT ord, regexp_replace(phone, '\D', '', 'g') AS p, lower(address) AS a, regexp_replace(lower(name), '[^\w\s]', '', 'g') AS n, zip_code AS z FROM f),
  j AS (SELECT x.ord AS a_ord, y.ord AS b_ord, x.a AS xa, y.a AS ya, x.n AS xn, y.n AS yn, x.z AS xz, y.z AS yz FROM k x JOIN k y ON x.p = y.p AND x.ord <> y.ord),
  s AS (SELECT a_ord, b_ord, round(0.4 + CASE WHEN xa = ya THEN 0.3 WHEN len(list_filter(range(1, least(length(xa), length(ya)) + 1), lambda i: substr(xa, i, 1) = substr(ya, i, 1))) / greatest(length(xa), length(ya)) >= 0.8 THEN 0.21 ELSE 0 END
   + CASE WHEN xn = yn THEN 0.2 WHEN len(list_filter(range(1, least(length(xn), length(yn)) + 1), lambda i: substr(xn, i, 1) = substr(yn, i, 1))) / greatest(length(xn), length(yn)) >= 0.7 THEN 0.1 ELSE 0 END
   + CASE WHEN xz = yz THEN 0.1 ELSE 0 END, 6)::DOUBLE AS similarity FROM j)
  SELECT ord, count(b_ord) AS n_links, min(b_ord) AS first_link FROM f LEFT JOIN (SELECT * FROM s WHERE similarity >= 0.85) ON a_ord = ord GROUP BY 1""")
def similarity_links(spark, d):
    return D.links(facilities(spark, d), "ord")


def _match_sql(x: str, y: str) -> str:
    return f"len(list_filter(range(1, least(length({x}), length({y})) + 1), lambda i: substr({x}, i, 1) = substr({y}, i, 1))) / greatest(length({x}), length({y}))"


# The scan as it is told: each phone's records one after the other, with what was kept so far as a list.
GREEDY = rf"""{FACILITIES}, k AS (SELECT ord, regexp_replace(phone, '\D', '', 'g') AS p, lower(address) AS a, regexp_replace(lower(trim(name)), '[^\w\s]', '', 'g') AS n, substr(zip_code, 1, 5) AS z, lower(address || '|' || city || '|' || zip_code) AS w FROM f),
  o AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY ord) AS i FROM k),
  g AS (SELECT DISTINCT p, 0::BIGINT AS i, NULL::BIGINT AS ord, false AS dup, []::STRUCT(a VARCHAR, n VARCHAR, z VARCHAR, w VARCHAR)[] AS kept FROM o
    UNION ALL SELECT p, i, ord, dup, CASE WHEN dup THEN kept ELSE list_append(kept, struct_pack(a := a, n := n, z := z, w := w)) END FROM (
      SELECT o.p, o.i, o.ord, o.a, o.n, o.z, o.w, g.kept, len(list_filter(g.kept, lambda x: x.w = o.w OR round(0.4 + CASE WHEN x.a = o.a THEN 0.3 WHEN {_match_sql('x.a', 'o.a')} >= 0.8 THEN 0.21 ELSE 0 END
        + CASE WHEN x.n = o.n THEN 0.2 WHEN {_match_sql('x.n', 'o.n')} >= 0.7 THEN 0.1 ELSE 0 END + CASE WHEN x.z = o.z THEN 0.1 ELSE 0 END, 6) >= 0.85)) > 0 AS dup FROM g JOIN o ON o.p = g.p AND o.i = g.i + 1))"""


@query(f"WITH RECURSIVE {GREEDY} SELECT ord, dup AS is_duplicate FROM g WHERE i > 0")
def dedup_greedy(spark, d):
    return D.greedy(facilities(spark, d), "ord").select("ord", "is_duplicate")


@query(rf"WITH e AS (SELECT doc_id, regexp_extract(coalesce(text, ''), '{K.EMAIL}', 1) AS e FROM documents) SELECT doc_id, CASE WHEN e = '' THEN 0.0 WHEN NOT regexp_matches(e, '{V.EMAIL_OK}') THEN 0.1 WHEN lower(regexp_extract(e, '@(.*)$', 1)) IN ('gmail.com', 'yahoo.com', 'hotmail.com', 'outlook.com') THEN 0.7 ELSE 0.9 END::DOUBLE AS confidence FROM e")
def validate_email(spark, d):
    return table(spark, d, "documents").select("doc_id", V.email_confidence(T.email(F.col("text"))).alias("confidence"))


@query(f"SELECT page_id, CASE WHEN regexp_matches(url, '{V.URL_OK}') THEN 0.95 ELSE 0.1 END::DOUBLE AS confidence FROM pages")
def validate_url(spark, d):
    return table(spark, d, "pages").select("page_id", V.url_confidence(F.col("url")).alias("confidence"))


_ADDRESS = "address || ', ' || city || ', ' || state || ', ' || zip_code"


@query(rf"""WITH {FACILITIES}, a AS (SELECT ord, {_ADDRESS} AS a FROM f) SELECT ord, regexp_matches(a, '^\d+') AND regexp_matches(a, '(?i)\d+\s+([A-Za-z0-9\s]+(?:{K.STREET}))') AS is_valid,
  round((regexp_matches(a, '^\d+')::INT + regexp_matches(a, '(?i)\d+\s+([A-Za-z0-9\s]+(?:{K.STREET}))')::INT) / 2 * 0.7 + (regexp_matches(a, '(?i)([A-Za-z\s]+),\s*[A-Z]{{2}}')::INT + regexp_matches(a, '(?i)\b[A-Z]{{2}}\b')::INT + regexp_matches(a, '\b\d{{5}}(?:-\d{{4}})?\b')::INT) / 3 * 0.3, 6)::DOUBLE AS confidence FROM a""")
def validate_address(spark, d):
    a = F.concat_ws(", ", "address", "city", "state", "zip_code")
    return facilities(spark, d).select("ord", V.address_valid(a).alias("is_valid"), F.round(V.address_confidence(a), 6).alias("confidence"))


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    """Facilities of which some have a short phone, a blank or bad website, a bad or an own e-mail address."""
    f, k = facilities(spark, d), F.col("ord")
    return f.withColumns({
        "phone": F.when(k % 5 == 0, "999").otherwise(F.col("phone")),
        "website": F.when(k % 3 == 0, "").when(k % 3 == 1, "no url").otherwise(F.col("website")),
        "email": F.when(k % 7 == 0, "bad@").when(k % 7 == 1, "desk@own.org").otherwise(F.col("email")),
    })


_MIXED = rf"""{FACILITIES}, m AS (SELECT ord, CASE WHEN ord % 5 = 0 THEN '999' ELSE regexp_replace(phone, '\D', '', 'g') END AS p, CASE ord % 3 WHEN 0 THEN '' WHEN 1 THEN 'no url' ELSE website END AS w, CASE ord % 7 WHEN 0 THEN 'bad@' WHEN 1 THEN 'desk@own.org' ELSE email END AS e FROM f),
  v AS (SELECT ord, 'phone' AS field_name, CASE WHEN regexp_matches(p, '^[2-9](?:[02-9]\d|1[02-9])[2-9]\d{{6}}$') THEN 0.95 WHEN length(p) IN (10, 11) THEN 0.7 ELSE 0.3 END::DOUBLE AS c, 0.95 AS least FROM m
    UNION ALL SELECT ord, 'address', 1.0, 0 FROM m UNION ALL SELECT ord, 'website', CASE WHEN regexp_matches(w, '{V.URL_OK}') THEN 0.95 ELSE 0.1 END::DOUBLE, 0.95 FROM m WHERE w <> ''
    UNION ALL SELECT ord, 'email', CASE WHEN NOT regexp_matches(e, '{V.EMAIL_OK}') THEN 0.1 WHEN e LIKE '%@gmail.com' THEN 0.7 ELSE 0.9 END::DOUBLE, 0.7 FROM m)"""


@query(f"WITH {_MIXED} SELECT ord, count(*) AS n_fields, count(*) FILTER (c >= least) AS n_valid, avg(c) > 0.6 AND 2 * count(*) FILTER (c >= least) >= count(*) AS is_likely_valid FROM v GROUP BY 1")
def validation_report(spark, d):
    return V.report(_mixed(spark, d)).select("ord", F.col("n_fields").cast("long").alias("n_fields"), F.col("n_valid").cast("long").alias("n_valid"), "is_likely_valid")


@query(f"WITH {_MIXED} SELECT field_name, count(*) AS total, count(*) FILTER (c >= least) AS valid, round(avg(c), 6)::DOUBLE AS avg_confidence FROM v GROUP BY 1")
def validation_summary(spark, d):
    return V.summary_by_field(V.report(_mixed(spark, d)))


@query("""SELECT c_custkey, round(((c_custkey % 2 = 0)::INT + 1 + (c_acctbal > 0)::INT) / 3 * 0.7 + ((c_nationkey > 9)::INT + (c_custkey % 5 = 1)::INT) / 2 * 0.3, 6)::DOUBLE AS completeness FROM customer""")
def completeness(spark, d):
    # some fields are null, empty or blank
    needed = [F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), F.col("c_mktsegment"), F.when(F.col("c_acctbal") > 0, "x").otherwise("")]
    more = [F.when(F.col("c_nationkey") > 9, F.col("c_nationkey").cast("string")).otherwise(" "), F.when(F.col("c_custkey") % 5 == 1, "y")]
    return table(spark, d, "customer").select("c_custkey", F.round(V.completeness(needed, more), 6).alias("completeness"))


@query("SELECT user_id, arg_max(event_type, (n, -seen)) AS primary_method FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS seen FROM events GROUP BY ALL) GROUP BY 1")
def primary_method(spark, d):
    return V.primary_method(table(spark, d, "events"), "event_type", "event_id", "user_id")


@query("SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_totalprice > 100000) AS n_large, round(count(*) FILTER (o_totalprice > 100000) / count(*), 6)::DOUBLE AS rate FROM orders GROUP BY 1")
def result_summary(spark, d):
    big = F.count_if(F.col("o_totalprice") > 100000)
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), big.alias("n_large"), F.round(F.try_divide(big, F.count("*")), 6).alias("rate"))


@query(f"WITH {LINKS} SELECT DISTINCT l.url FROM links l WHERE l.url NOT IN (SELECT url FROM links WHERE page_id % 2 = 0)")
def anti_visited(spark, d):
    x = L.links(table(spark, d, "pages"))
    return L.unvisited(x.select("url"), x.where("page_id % 2 = 0")).distinct()


@query("""WITH RECURSIVE e AS (SELECT o_custkey AS src, o_orderkey AS dst FROM orders), r AS (SELECT c_custkey AS url, 0 AS depth FROM customer WHERE c_nationkey = 3 UNION SELECT dst, depth + 1 FROM r JOIN e ON src = url WHERE depth < 3)
  SELECT url, min(depth)::INTEGER AS depth FROM r GROUP BY 1""")
def bfs_depth(spark, d):
    """Orders as edges from their customer to the customer whose key is the order's; from all customers of a nation on."""
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    return L.reach(edges, table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("url")), 3)


@query("SELECT event_id, cast(json_extract(props, '$.k') AS bigint) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT page_id, i - 1 AS pos, x[i] AS label FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a></li>', 1) AS x FROM pages))")
def css_schema_extract(spark, d):
    schema = {"name": "menu", "baseSelector": "nav ul li", "fields": [{"name": "label", "selector": "a", "type": "text"}]}
    return E.css_extract(table(spark, d, "pages"), schema).select("page_id", "pos", "label")
