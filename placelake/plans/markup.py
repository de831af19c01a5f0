"""Queries over pages and texts: facts of the markup, schemas, blocks, the cascade, site targets, with SQL of equal meaning."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from placelake import constants as K
from placelake.functions import text as T
from placelake.functions import urls as U
from placelake.operators import cascade as X
from placelake.operators import facts as P
from placelake.operators import links as L
from placelake.plans.locations import LINKS, TYPES
from placelake.plans.registry import query, table
from placelake.schemas import SCHEMAS


def _sql(text: str) -> str:
    """A text as a literal of SQL."""
    return "'" + text.replace("'", "''") + "'"


def _case(cases: dict[str, str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {condition} THEN {_sql(value)}" for condition, value in cases.items()) + f" ELSE {other} END"


def _first_sql(text: str, patterns: tuple[str, ...]) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({text}, {_sql('(?i)' + p)}, 1), '')" for p in patterns) + ", '')"


@query("""SELECT DISTINCT page_id, href FROM (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a[^>]*href="([^"]*)"', 1)) AS href FROM pages)""")
def nav_links(spark, d):
    return P.page_facts(table(spark, d, "pages")).select("page_id", F.explode("nav_links").alias("href"))


@query()
def facility_assembly(spark, d):
    """Records assembled from microdata, contacts, services and texts; lists as JSON, so that rows are plain."""
    records = P.assemble(P.page_facts(table(spark, d, "pages")))
    return records.select(*(F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in records.dtypes))


@query(r"""WITH p AS (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS plain, regexp_extract(url, '^[^:]*://[^/?#]*', 0) AS site FROM pages WHERE url IS NOT NULL)
  SELECT DISTINCT page_id, unnest([url, plain || '?page=' || page_id, site || '/list/' || (page_id % 7), CASE WHEN plain = site THEN site || '/more' ELSE regexp_replace(plain, '[^/]*$', '') || 'more' END]) AS page_url FROM p""")
def pagination(spark, d):
    """Pages with links to further ones: two numbered, one next; an unnumbered link among them leads to none."""
    k = F.col("page_id")
    links = F.concat(F.lit('<ul class="pagination"><li><a href="?page='), k, F.lit('">2</a><li><a href="/list/'), k % 7, F.lit('">3</a><li><a href="/about">Help</a></ul><a class="next-page" href="more">Next</a>'))
    pages = table(spark, d, "pages").withColumn("html", F.concat("html", links))
    return P.page_links(P.page_facts(pages).join(pages.select("page_id", "url"), "page_id"))


def _compatibility_sql(schema) -> str:
    bases = schema.base.split(", ")
    words = [(m[1], 1.0) for b in bases if (m := re.search(r"\.([^. ]+)", b))]
    classes = [(c, 0.5) for selector in schema.fields.values() for c in re.findall(r"\.([\w-]+)", selector)]
    points = " + ".join(f"CASE WHEN contains(html, {_sql(w)}) THEN {p} ELSE 0 END" for w, p in words + classes)
    return f"({points}) / {len(bases) + len(classes)}"


@query(
    "SELECT page_id, coalesce("
    + _case({" OR ".join(f"lower(url) LIKE {_sql(g.replace('*', '%'))}" for g in s.globs): s.name for s in SCHEMAS}, "NULL")
    + ", CASE WHEN greatest(a0, a1, a2, a3, a4) > 0.3 THEN "
    + _case({f"a{i} = greatest(a0, a1, a2, a3, a4)": s.name for i, s in enumerate(SCHEMAS)}, "NULL")
    + " END) AS schema_name FROM (SELECT *, "
    + ", ".join(f"{_compatibility_sql(s)} AS a{i}" for i, s in enumerate(SCHEMAS))
    + " FROM pages)"
)
def schema_choice(spark, d):
    return table(spark, d, "pages").select("page_id", X.choose_schema(F.col("url"), F.col("html")).alias("schema_name"))


@query(
    f"""WITH b AS (SELECT page_id, regexp_extract_all(html, {_sql('(?is)' + K.BLOCK)}, 0) AS x, html FROM pages), u AS (SELECT page_id, unnest(CASE WHEN len(x) > 0 THEN x ELSE [html] END) AS block FROM b)
  SELECT page_id, trim({_first_sql('block', K.BLOCK_NAMES)}) AS name, regexp_extract(block, {_sql(K.BLOCK_PHONE)}, 0) AS phone, regexp_extract(block, {_sql(K.EMAIL)}, 0) AS email,
  regexp_extract(block, {_sql('(?i)' + K.BLOCK_STREET)}, 0) AS address, regexp_extract(block, {_sql(chr(92) + 'b' + K.ZIP + chr(92) + 'b')}, 1) AS zip_code, regexp_extract(block, '(?:^|[^\\p{{L}}\\p{{N}}_])([A-Z]{{2}})(?:[^\\p{{L}}\\p{{N}}_]|$)', 1) AS state,
  CASE WHEN NOT regexp_matches(block, {_sql('(?i)' + K.BLOCK_CONTEXT)}) THEN '' ELSE {_case({f"regexp_matches(block, {_sql('(?i)' + p)})": t for p, t in K.BLOCK_TYPES.items()}, _sql(K.OTHER_TYPE))} END AS facility_type FROM u"""
)
def block_records(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.explode(X.blocks(F.col("html"))).alias("block"))
    return rows.select("page_id", X.block_record(F.col("block")).alias("r")).select("page_id", *(F.col(f"r.{c}") for c in ("name", "phone", "email", "address", "zip_code", "state", "facility_type")))


@query()
def keyed_block_records(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.explode(X.keyed_records(F.col("html"))).alias("r"))
    return rows.select("page_id", "r.name", "r.phone", "r.email", "r.address", "r.zip_code")


@query()
def cascade_methods(spark, d):
    """The way that gave each page its records, linked pages included."""
    pages = table(spark, d, "pages")
    found = X.extract(pages)
    links = L.links(pages).where(U.is_facility(F.col("url"))).select("page_id", "url")
    return X.with_links(found, links).select("page_id", "method", "schema_name", F.size("records").cast("long").alias("n_records"))


_SITE = _case({f"regexp_matches(lower(html), {_sql('|'.join(signs))})": name for name, signs in K.SITE_TYPES.items()}, "'unknown'")


@query(f"SELECT page_id, {_SITE} AS site_type FROM pages")
def site_type(spark, d):
    return table(spark, d, "pages").select("page_id", T.site_type(F.col("html")).alias("site_type"))


@query(f"""WITH {LINKS}, kept AS (SELECT DISTINCT l.page_id, l.url AS target, {_SITE} AS site_type FROM links l JOIN pages p USING (page_id)
  WHERE regexp_matches(href, '(?i)location|facility|community|center|find|search|directory')) SELECT page_id, target, 0.6::DOUBLE AS confidence, site_type FROM kept""")
def site_targets(spark, d):
    return X.site_targets(table(spark, d, "pages"))


@query(f"""WITH {LINKS}, t AS (SELECT DISTINCT page_id, url AS target, (length(href) % 10) / 10.0 AS confidence FROM links),
  r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, target) AS rank FROM t), b AS (SELECT page_id, target, confidence::DOUBLE AS confidence FROM r WHERE rank <= 5)
  SELECT * FROM b UNION ALL SELECT page_id, url, 0.7::DOUBLE FROM pages p WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.page_id = p.page_id AND b.target = p.url)""")
def best_targets(spark, d):
    pages = table(spark, d, "pages")
    targets = L.links(pages).select("page_id", F.col("url").alias("target"), ((F.length("href") % 10) / 10.0).alias("confidence"), F.lit(None).cast("int").alias("expected"), F.lit("corporate_chain").alias("site_type"))
    return X.best_targets(targets.distinct(), pages.select("page_id", "url"))


@query(f"""SELECT s_suppkey, 'https://s' || s_suppkey || '.com' || x AS candidate FROM supplier, (SELECT '/' || p || f AS x FROM (SELECT unnest([{', '.join(map(_sql, K.LISTING_PARTS))}]) AS p), (SELECT unnest(['', '/', '.html', '.php']) AS f))""")
def candidate_urls(spark, d):
    sites = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("https://s"), "s_suppkey", F.lit(".com")).alias("url"))
    return L.candidates(sites).select("s_suppkey", "candidate")


@query(f"""WITH {LINKS} SELECT url, max(length(url))::INTEGER AS score FROM links WHERE url NOT IN (SELECT url FROM links WHERE page_id % 2 = 0) GROUP BY 1 ORDER BY score DESC, url LIMIT 20""")
def frontier_next(spark, d):
    x = L.links(table(spark, d, "pages")).withColumn("score", F.length("url"))
    return L.next_best(x, x.where("page_id % 2 = 0"), 20)


@query("SELECT doc_id, " + _case({" OR ".join(f"contains(lower(text), {_sql(w)})" for w in words): name.title() for name, words in TYPES.items()}, _sql(K.OTHER_TYPE)) + " AS kind FROM documents")
def keyword_first(spark, d):
    return table(spark, d, "documents").select("doc_id", T.first_type(F.col("text"), TYPES).alias("kind"))


_T = "coalesce(text, '')"


@query(f"""SELECT doc_id, trim({_first_sql(_T, K.ADMINISTRATOR)}) AS administrator, {_first_sql(_T, K.LICENSE)} AS license_number, {_first_sql(_T, K.MEDICARE)} AS medicare_provider_id,
  coalesce(list_filter(regexp_extract_all({_T}, {_sql(K.EMAIL)}, 1), lambda e: NOT regexp_matches(lower(e), 'example|test|noreply'))[1], '') AS email FROM documents""")
def operational_facts(spark, d):
    text = F.col("text")
    columns = {"administrator": T.administrator, "license_number": T.license_number, "medicare_provider_id": T.medicare_id, "email": T.real_email}
    return table(spark, d, "documents").select("doc_id", *(f(text).alias(name) for name, f in columns.items()))


_STATES = "MAP {" + ", ".join(f"{_sql(k)}: {_sql(v)}" for k, v in K.STATES.items()) + "}"


@query(f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split({_T}, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM documents),
  z AS (SELECT *, list_filter(lines, lambda x: regexp_matches(x, {_sql(K.ZIP)}))[1] AS line FROM l), c AS (SELECT *, regexp_extract(line, {_sql(K.ZIP)}, 1) AS zip_code FROM z),
  p AS (SELECT *, list_transform(string_split(trim(replace(line, zip_code, '')), ','), lambda x: trim(x)) AS parts FROM c), w AS (SELECT *, list_filter(regexp_split_to_array(parts[1], '\\s+'), lambda x: x <> '') AS words FROM p),
  s AS (SELECT *, CASE WHEN len(parts) >= 2 THEN parts[-2] WHEN len(words) >= 2 THEN array_to_string(words[:-2], ' ') END AS city, CASE WHEN len(parts) >= 2 THEN parts[-1] WHEN len(words) >= 2 THEN words[-1] END AS code FROM w)
  SELECT doc_id, list_filter(lines, lambda x: regexp_matches(x, '^\\d'))[1] AS address, city, CASE WHEN length(lower(trim(code))) = 2 THEN upper(trim(code)) ELSE coalesce({_STATES}[lower(trim(code))], upper(trim(code))) END AS state, zip_code FROM s""")
def address_parse(spark, d):
    return table(spark, d, "documents").select("doc_id", T.parse_address(F.col("text")).alias("a")).select("doc_id", "a.*")


@query("""SELECT event_id, CASE event_id % 5 WHEN 3 THEN trim(event_type) ELSE 'Event ' || event_id END AS name, event_type AS city, CASE WHEN event_id % 2 = 0 THEN '(555) 201-' || lpad((event_id % 10000)::VARCHAR, 4, '0') ELSE '' END AS phone
  FROM events WHERE event_id % 5 < 4 AND (event_id % 5 <> 2 OR event_id % 3 > 0)""")
def model_replies(spark, d):
    """Records out of replies that are JSON in fences, in prose, or cut off; without a name, or with no place, a record doesn't count."""
    k = F.col("event_id")
    phone = F.when(k % 2 == 0, F.concat(F.lit("555.201."), F.lpad((k % 10000).cast("string"), 4, "0"))).otherwise("")
    name = F.when(k % 5 == 3, F.concat(F.lit("  "), "event_type", F.lit(" "))).when((k % 5 == 2) & (k % 3 == 0), "").otherwise(F.concat(F.lit("Event "), k))
    body = F.concat(F.lit('{"facilities": [{"name": "'), name, F.lit('", "city": "'), "event_type", F.lit('", "phone": "'), phone, F.lit('"}, {"name": "No Place"}]}'))
    reply = F.when(k % 5 == 0, F.concat(F.lit("Sure: "), body, F.lit(" Done."))).when(k % 5 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k % 5 == 4, F.substring(body, 1, 40)).otherwise(body)
    rows = table(spark, d, "events").select("event_id", F.explode(X.reply_records(reply)).alias("r"))
    return rows.select("event_id", "r.name", "r.city", "r.phone")
