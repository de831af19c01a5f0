"""Sitemaps: where sites keep them, what they hold, and the indexes that lead from one to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelake import constants as K
from placelake.functions import urls as U
from placelake.operators.discover import Lexicon
from placelake.operators.rounds import cut

_XML = "url array<struct<loc:string,lastmod:string>>, sitemap array<struct<loc:string,lastmod:string>>, _corrupt string"
_ROOT = rf"(?s)^\s*\ufeff?(?:<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>|\s)*<(?:\w+:)?(urlset|sitemapindex)\b[^>]*\bxmlns(?::\w+)?\s*=\s*[\"']{K.SITEMAP_SPACE}[\"']"


def probes(sites: DataFrame) -> DataFrame:
    """(site, url): the addresses at which each of ``sites(site)`` is asked for a sitemap, robots.txt among them."""
    paths = F.array(*map(F.lit, K.SITEMAP_PATHS))
    return sites.select("site", F.explode(paths).alias("path")).select("site", U.resolve(F.col("site"), F.col("path")).alias("url"))


def robots_sitemaps(df: DataFrame, column: str = "robots") -> DataFrame:
    """(columns of ``df`` but ``column``, url): the sitemaps that a robots.txt names."""
    rows = df.withColumn("_line", F.explode(F.split(column, "\n"))).where(F.col("_line").rlike(r"(?i)^\s*sitemap:"))
    return rows.withColumn("url", F.trim(F.regexp_replace(F.regexp_extract("_line", r"(?i)^\s*sitemap:(.*)$", 1), r"\s+$", ""))).drop("_line", column)


def parsed(xml: Column) -> Column:
    """A sitemap as a struct of ``url`` and ``sitemap``, lists of (loc, lastmod); null where it is no XML or of another kind."""
    x = F.from_xml(xml, _XML, {"ignoreNamespace": "true", "columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    return F.when(xml.rlike(_ROOT) & x["_corrupt"].isNull(), x)


def entries(documents: DataFrame, column: str = "xml") -> DataFrame:
    """(columns of ``documents`` but ``column``, loc, is_index): a row per location, entities and CDATA decoded; blank ones are left out."""
    rows = documents.withColumn("_x", parsed(F.col(column))).drop(column)
    locations = lambda name, index: F.transform(F.coalesce(F.col(f"_x.{name}"), F.array()), lambda e: F.struct(F.trim(F.regexp_replace(e["loc"], r"^\s+|\s+$", "")).alias("loc"), F.lit(index).alias("is_index")))
    rows = rows.withColumn("_e", F.explode(F.concat(locations("url", False), locations("sitemap", True)))).drop("_x")
    return rows.select(*(c for c in rows.columns if c != "_e"), "_e.loc", "_e.is_index").where("loc <> ''")


def follow(documents: DataFrame, sites: DataFrame, most: int | None = None) -> DataFrame:
    """(site, url, source): what the sitemaps of ``sites(site)`` list, however many indexes lie between.

    ``documents(url, xml)`` holds what was fetched: sitemaps and robots.txt files by their address. Each site's probes are
    looked up, then what robots.txt and indexes name, until nothing is new or ``most`` levels are done; an index that names
    itself ends there. Every document is parsed once, where it lies. Of several sitemaps that list a page the least is its source.
    """
    known = documents.where("url is not null and xml is not null").select("url", "xml")
    robots = F.col("url").endswith("/robots.txt")
    listed = entries(known.where(~robots)).select(F.col("url").alias("source"), "loc", "is_index")
    named = robots_sitemaps(known.where(robots).withColumnRenamed("url", "source"), "xml").select("source", F.col("url").alias("loc"), F.lit(True).alias("is_index")).where("loc <> ''")
    links = cut(listed.unionByName(named).distinct())
    front = seen = cut(probes(sites.where("site is not null").distinct()).distinct())
    level, found = 0, None
    while (most is None or level < most) and not front.isEmpty():
        level += 1
        here = cut(links.join(front.withColumnRenamed("url", "source"), "source"))
        pages = here.where("not is_index").select("site", F.col("loc").alias("url"), "source")
        found = pages if found is None else found.unionByName(pages)
        front = cut(here.where("is_index").select("site", F.col("loc").alias("url")).distinct().join(seen, ["site", "url"], "left_anti"))
        seen = cut(seen.unionByName(front))
    if found is None:
        found = links.where("false").select(F.lit("").alias("site"), F.col("loc").alias("url"), "source")
    return found.groupBy("site", "url").agg(F.min("source").alias("source"))


def places(listed: DataFrame, lexicon: Lexicon = Lexicon()) -> DataFrame:  # noqa: B008
    """``listed(.., url)`` that lead to places, with ``kind``: detail or listing."""
    return listed.where(lexicon.related(F.col("url"))).withColumn("kind", lexicon.kind(F.col("url")))
