"""Staged discovery of places on sites: what leads where, level by level, and how each place was found."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelake import constants as K
from placelake.functions import urls as U
from placelake.functions.dom import parse, select
from placelake.operators import facts as P
from placelake.operators import links as L
from placelake.operators.extract import map_pages
from placelake.operators.rounds import cut

STEPS = ("sitemap", "navigation", "search", "links")
"""The steps of a discovery, in the order in which an earlier one counts as a place's source."""


@dataclass(frozen=True)
class Lexicon:
    """What tells listings, details and pages to leave alone apart, in lower-case URLs."""

    listing: tuple[str, ...] = K.LISTING_PARTS
    excluded: tuple[str, ...] = K.EXCLUDED_PARTS
    segments: tuple[str, ...] = K.SEGMENT_PARTS
    detail: str = K.DETAIL_URL

    def related(self, url: Column) -> Column:
        return U.contains_any(F.lower(url), self.listing)

    def kind(self, url: Column) -> Column:
        return F.when(F.lower(url).rlike(self.detail), "detail").otherwise("listing")

    def excludes(self, url: Column) -> Column:
        return U.contains_any(F.lower(url), self.excluded)

    def place(self, url: Column) -> Column:
        """Whether a URL leads to places: by a listing's part, or else, unless excluded, by its path."""
        return F.when(self.related(url), True).when(self.excludes(url), False).otherwise(U.contains_any(F.lower(U.path(url)), self.segments))


def crawled(pages: DataFrame) -> DataFrame:
    """``pages`` that were fetched: with a URL and content, and not marked as failed in a column ``success``."""
    good = pages.where("url is not null and html is not null")
    return good.where("success") if "success" in pages.columns else good


def _anchors(pages: DataFrame) -> DataFrame:
    return L.anchors(crawled(pages).select(F.col("url").alias("page"), "url", "html"), "page")


def edges(pages: DataFrame, lexicon: Lexicon = Lexicon()) -> DataFrame:  # noqa: B008
    """(src, dst, kind): the links of every page to its own site that aren't excluded; kind is detail or listing where one leads to places, else null.

    A page is parsed where it lies, and only its links are shuffled.
    """
    found = _anchors(pages).select(F.col("base").alias("src"), F.col("url").alias("dst"))
    dst = F.col("dst")
    found = found.where(U.same_domain(dst, F.col("src")) & ~lexicon.excludes(dst))
    return found.select("src", "dst", F.when(lexicon.related(dst), lexicon.kind(dst)).alias("kind")).distinct()


def walk(graph: DataFrame, seeds: DataFrame, most: int | None = 3) -> tuple[DataFrame, DataFrame]:
    """What is met from ``seeds(site, url)`` over ``graph(src, dst, kind)``: ``(met, passed)``.

    A node with a kind is met and stops there; one without is passed, and its links are followed at the next level, up to
    ``most`` levels (None: until nothing is new). met has (site, url, kind, depth, source), the first way to each node:
    the least depth, then the least source. passed has (site, url, depth). Each level starts from the written last one.
    """
    front = cut(seeds.select("site", "url").where("url is not null").distinct())
    passed, met, depth = front.withColumn("depth", F.lit(0)), None, 0
    while (most is None or depth < most) and not front.isEmpty():
        depth += 1
        step = cut(graph.join(front.withColumnRenamed("url", "src"), "src").select("site", F.col("dst").alias("url"), "kind", F.lit(depth).alias("depth"), F.col("src").alias("source")))
        here = step.where("kind is not null").groupBy("site", "url", "kind", "depth").agg(F.min("source").alias("source"))
        met = here if met is None else met.unionByName(here)
        front = cut(step.where("kind is null").select("site", "url").distinct().join(passed, ["site", "url"], "left_anti"))
        passed = cut(passed.unionByName(front.withColumn("depth", F.lit(depth))))
    if met is None:
        met = graph.select(F.lit("").alias("site"), "dst", "kind").where("false").select("site", F.col("dst").alias("url"), "kind", F.lit(0).alias("depth"), F.col("dst").alias("source"))
    first = met.groupBy("site", "url").agg(F.min(F.struct("depth", "source", "kind")).alias("f"))
    return first.select("site", "url", "f.kind", "f.depth", "f.source"), passed


def _menus(html: str | None) -> list[tuple]:
    return [(x.attrs["href"],) for x in select(parse(html), K.NAV_LINK_SELECTORS) if x.attrs.get("href")]


def discover(pages: DataFrame, sites: DataFrame, sitemap_entries: DataFrame | None = None, most: int = 3, lexicon: Lexicon = Lexicon()) -> DataFrame:  # noqa: B008
    """All places that the pages of sites lead to, each with the step that found it first.

    ``pages`` needs url and html, and may have success; ``sites`` needs site (its first page). The steps are the site's
    sitemaps (``sitemap_entries(site, url, source)``, as ``sitemaps.follow`` gives them), the menus and footers of the first
    page, its search forms and scripts' endpoints, and the links of pages up to ``most`` levels down: a link to a place is
    recorded and stops, other links of the same site are followed. Returns (site, url, kind, step, depth, source), kind
    being detail, listing or endpoint; of several steps the first in STEPS stands, of several sources the least depth,
    then the least source. Pages that aren't there, or failed, lead nowhere; null sites and URLs are left out.
    """
    sites = sites.select("site").where("site is not null").distinct()
    url = F.col("url")
    found = []
    if sitemap_entries is not None:
        told = sitemap_entries.join(sites, "site").where(lexicon.related(url))
        found.append(told.select("site", "url", lexicon.kind(url).alias("kind"), F.lit(0).alias("step"), F.lit(0).alias("depth"), "source"))
    first = cut(crawled(pages).join(sites.withColumnRenamed("site", "url"), "url", "left_semi").select("url", "html"))
    menus = map_pages(first, _menus, "url", [pa.field("href", pa.string())]).withColumn("target", U.resolve(url, F.col("href")))
    target = F.col("target")
    menus = menus.where(U.same_domain(target, url) & lexicon.related(target))
    found.append(menus.select(url.alias("site"), target.alias("url"), lexicon.kind(target).alias("kind"), F.lit(1).alias("step"), F.lit(0).alias("depth"), url.alias("source")))
    facts = P.page_facts(first, "url")
    forms = P.search_forms(facts.withColumn("page", url), "page", "url").select(F.col("page").alias("site"), F.col("endpoint").alias("url"))
    scripts = P.ajax_endpoints(first.withColumn("page", url), "page", "url").select(F.col("page").alias("site"), F.col("endpoint").alias("url"))
    ends = forms.unionByName(scripts)
    found.append(ends.select("site", "url", F.lit("endpoint").alias("kind"), F.lit(2).alias("step"), F.lit(0).alias("depth"), F.col("site").alias("source")))
    met, _ = walk(cut(edges(pages, lexicon)), sites.select("site", F.col("site").alias("url")), most)
    found.append(met.select("site", "url", "kind", F.lit(3).alias("step"), "depth", "source"))
    rows = found[0]
    for other in found[1:]:
        rows = rows.unionByName(other)
    rows = rows.groupBy("site", "url").agg(F.min(F.struct("step", "depth", "source", "kind")).alias("f"))
    return rows.select("site", "url", "f.kind", F.element_at(F.array(*map(F.lit, STEPS)), F.col("f.step") + 1).alias("step"), "f.depth", "f.source")


def place_links(pages: DataFrame, lexicon: Lexicon = Lexicon()) -> DataFrame:  # noqa: B008
    """(src, url, text): links to places of the page's own site, told by their address or, where a listing's part stands in it, their text."""
    found = _anchors(pages)
    href, text = F.col("href"), F.lower(F.col("text"))
    hinted = U.contains_any(href, lexicon.segments) | U.contains_any(F.lower(href), lexicon.listing) | U.contains_any(text, lexicon.listing)
    rows = found.where(hinted & U.same_domain(F.col("url"), F.col("base")) & lexicon.place(F.col("url")))
    return rows.select(F.col("base").alias("src"), "url", "text")


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, kind null): links to further pages of a listing, on the same site; their address speaks of a page."""
    found = _anchors(pages)
    rows = found.where(F.lower("href").contains("page") & U.same_domain(F.col("url"), F.col("base")))
    return rows.select(F.col("base").alias("src"), F.col("url").alias("dst"), F.lit(None).cast("string").alias("kind")).distinct()


def scrape(pages: DataFrame, sites: DataFrame, lexicon: Lexicon = Lexicon()) -> DataFrame:  # noqa: B008
    """Records of the places on sites in three stages: listings, their cards, and each place's own page.

    The first page of a site, the usual addresses of listings and all further pages that they lead to are searched for
    links to places; then the cards on what was found; then every page found is read as a record. Returns site, page_url and the
    fields of ``facts.assemble``. Pages that aren't there give nothing; copies of a page's row give one record each.
    """
    sites = sites.select("site").where("site is not null").distinct()
    seeds = sites.select("site", F.col("site").alias("url")).unionByName(L.candidates(sites, "site").select("site", F.col("candidate").alias("url")))
    have = cut(crawled(pages).select("url").distinct())
    _, listings = walk(cut(page_edges(pages)), seeds.join(have, "url", "left_semi"), None)
    places = cut(place_links(pages, lexicon).select("src", "url").distinct())
    one = cut(listings.select("site", F.col("url").alias("src")).join(places, "src").select("site", "url").distinct())
    cards = crawled(pages).join(one.select("url").distinct(), "url", "left_semi").select("url", "html")
    targets = P.card_targets(P.page_facts(cards, "url").withColumn("page", F.col("url")), "page", "url").select(F.col("page").alias("src"), "target").distinct()
    two = targets.join(one.withColumnRenamed("url", "src"), "src").select("site", F.col("target").alias("url"))
    wanted = cut(one.unionByName(two).distinct())
    final = crawled(pages).join(wanted.select("url").distinct(), "url", "left_semi").select("url", "html")
    records = P.assemble(P.page_facts(final, "url"), "url")
    return records.join(wanted, "url").select("site", F.col("url").alias("page_url"), *(c for c in records.columns if c != "url"))
