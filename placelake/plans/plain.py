"""Queries over the plain path of a page and the plan's list, with SQL of equal meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from placelake import constants as K
from placelake.operators import plain as P
from placelake.operators import summaries as S
from placelake.operators.rounds import spread
from placelake.plans.registry import query, table


@query(f"""SELECT c_custkey, c_name || ' Home!' AS name, CASE WHEN c_custkey % 2 = 1 THEN 'Memory Care' ELSE '{K.OTHER_TYPE}' END AS facility_type, '(702) 555-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS phone, c_custkey || '@mail.org' AS email,
  CASE c_custkey % 3 WHEN 0 THEN c_custkey || ' Oak Avenue' WHEN 1 THEN c_custkey || ' Long' ELSE '' END AS address, CASE WHEN c_custkey % 3 = 0 THEN 'Reno' ELSE '' END AS city, CASE WHEN c_custkey % 3 = 0 THEN 'NV' ELSE '' END AS state,
  CASE WHEN c_custkey % 3 = 0 THEN '89501' ELSE '' END AS zip_code, (c_custkey % 90)::VARCHAR AS beds, 'AB-' || c_custkey AS license_number, '45-' || c_custkey AS medicare_provider_id,
  '["' || c_mktsegment || '","' || c_mktsegment || '"]' AS services FROM customer WHERE c_custkey % 10 <> 0""")
def plain_records(spark, d):
    """Customers as pages: an address in an element, in the text (where a line break ends it), or none; a part about services that two selectors reach; every tenth page has no name."""
    k = F.col("c_custkey")
    place = F.when(k % 3 == 0, F.concat(F.lit('<div class="contact-info"><p>'), k, F.lit(" Oak <i>Avenue</i></p><p>Reno, NV 89501</p></div>")))
    place = place.when(k % 3 == 1, F.concat(F.lit("<p>Come to "), k, F.lit(" Long\n Elm Street to rest!</p>"))).otherwise("<p>Come!</p>")
    rest = F.concat(F.lit("<p>Call (702) 555-"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("! "), k, F.lit("@mail.org! "), k % 90, F.lit(" Beds! Lic. #AB-"), k, F.lit("! Provider Number: 45-"), k, F.lit("!"), F.when(k % 2 == 1, "Memory Care").otherwise(""))
    services = F.concat(F.lit('</p><div class="services"><ul><li>'), "c_mktsegment", F.lit("<li>abc</ul></div>"))
    name = F.when(k % 10 != 0, F.concat(F.lit("<title>no</title><h1>"), "c_name", F.lit(" <b>Home!</b></h1>"))).otherwise("")
    customers = spread(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"))
    pages = customers.select("c_custkey", F.concat(name, place, rest, services).alias("html"))
    return P.records(P.facts(pages, "c_custkey"), "c_custkey").withColumn("services", F.to_json("services"))


_SITE = "SELECT page_id, regexp_replace(url, '[?#].*$', '') AS plain, regexp_extract(url, '^[^:]*://[^/?#]*', 0) AS site FROM pages WHERE url IS NOT NULL"


@query(f"""SELECT DISTINCT page_id, url FROM (SELECT page_id, site, unnest([plain || '?Page=' || page_id, CASE WHEN plain = site THEN site || '/' ELSE regexp_replace(plain, '[^/]*$', '') END || 'more-page', site || '/page/' || (page_id % 5)]) AS url FROM ({_SITE}))
  WHERE url <> site || '/page/0'""")
def further_pages(spark, d):
    """Pages with links to further ones: in a pager, by what their address says, or by their text; those to other sites, without "page", or visited are left out."""
    k, site = F.col("page_id"), F.regexp_extract("url", "^[^:]*://[^/?#]*", 0)
    links = F.concat(F.lit('<p class="pager"><a href="/list/'), k, F.lit('">Next</a><a href="?Page='), k, F.lit('">2</a></p><a href="more-page">x</a><a href="http://elsewhere.org/page">y</a><a href="/page/'), k % 5, F.lit('">Load</a>'))
    pages = table(spark, d, "pages").select("page_id", "url", F.concat(F.coalesce("html", F.lit("")), links).alias("html"))
    facts = P.facts(pages).join(pages.select("page_id", "url"), "page_id")
    return P.further_pages(facts, pages.select(F.concat(site, F.lit("/page/0")).alias("url")))


@query(f"""SELECT DISTINCT page_id, unnest([site || '/Locations/' || page_id, CASE WHEN plain = site THEN site || '/' ELSE regexp_replace(plain, '[^/]*$', '') END || 'facility.html', site || '/find-a-location?a=1&b=2']) AS url FROM ({_SITE})""")
def place_anchors(spark, d):
    """Pages with links that speak of places, of their own site and of others."""
    site = F.regexp_extract("url", "^[^:]*://[^/?#]*", 0)
    links = F.concat(F.lit("<a href='/Locations/"), "page_id", F.lit("'>a</a><A HREF=facility.html>b</A><a href=\"http://elsewhere.org/facility/1\">c</a><a href=\"/about\">d</a><a href=\""), site, F.lit('/find-a-location?a=1&amp;b=2">e</a>'))
    return P.place_anchors(table(spark, d, "pages").where("url IS NOT NULL").withColumn("html", F.concat(F.coalesce("html", F.lit("")), links)))


@query("SELECT ((row_number() OVER (ORDER BY s_nationkey, s_suppkey) - 1) // 7 + 1)::BIGINT AS batch, s_name AS name, 'https://' || s_suppkey || '.org' AS url, s_nationkey AS priority FROM supplier")
def chain_plan_list(spark, d):
    chains = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("corporation_name"), F.concat(F.lit("https://"), "s_suppkey", F.lit(".org")).alias("primary_url"), F.col("s_nationkey").alias("priority"))
    return S.plan_chains(chains, "priority", "s_suppkey", batch_size=7)
