"""The plain path over a page: its first heading, first matches of patterns, the lists of its services, further pages.

A page is parsed once, on the executors; what is left to do over its text is done in columns.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelake import constants as K
from placelake.functions import text as T
from placelake.functions import urls as U
from placelake.functions.dom import Element, parse, select, select_first
from placelake.operators.extract import map_pages
from placelake.operators.links import anchors, unvisited

_TEXTS = pa.list_(pa.string())
FIELDS = [pa.field("text", pa.string()), pa.field("name", pa.string()), pa.field("address_text", pa.string()), pa.field("services", _TEXTS), pa.field("page_hrefs", _TEXTS)]
RECORD = ("name", "facility_type", "phone", "email", "address", "city", "state", "zip_code", "beds", "license_number", "medicare_provider_id", "services")

_RUN = re.compile(r"[A-Za-z0-9\s,.-]+", re.ASCII)
_NUMBER = re.compile(r"\d+\s", re.ASCII)
_SUFFIX = re.compile(f"(?=({K.STREET}))")


def wide_address(text: str) -> str:
    """What ``K.WIDE_STREET`` finds first, or ''; in linear time, where the pattern itself tries each number against all that follows it.

    The pattern can't leave a run of its own characters, and being greedy ends at the last street word of the run: so the first
    number that stands before that word, with a character between them, begins the match.
    """
    for run in _RUN.finditer(text):
        piece = run[0]
        last = None
        for last in _SUFFIX.finditer(piece):
            pass
        if last is not None:
            for number in _NUMBER.finditer(piece):
                if number.end() < last.start():
                    return piece[number.start() : last.end(1)]
    return ""


def _services(root: Element) -> list[str]:
    """Items and paragraphs of more than three characters in the parts about services; one that several selectors reach comes as often."""
    parts = (part for selector in K.PLAIN_SERVICES for part in select(root, selector))
    return [t for part in parts for x in select(part, "li, p") if len(t := x.text()) > 3]


def _pages(root: Element) -> list[str]:
    hrefs = (x.attrs.get("href") or "" for selector in K.PLAIN_PAGERS for x in select(root, selector))
    return list(dict.fromkeys(h for h in hrefs if "page" in h.lower()))


def _plain(html: str | None) -> tuple:
    root = parse(html)
    text = root.lines()
    name = next((t for s in K.PLAIN_NAMES if (x := select_first(root, s)) is not None and len(t := x.text()) > 3), "")
    if not name and (x := select_first(root, "title")) is not None:
        name = x.text()
    address = next((x.lines() for s in K.PLAIN_ADDRESSES if (x := select_first(root, s)) is not None), "")
    return text, name, address or wide_address(text), _services(root), _pages(root)


def facts(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, text, name, address_text, services, page_hrefs) of ``pages(key, html)``; null and empty pages give empty ones.

    Texts have a line for each block, and line breaks of the source part lines too. ``address_text`` is that of the first selector that finds an element; where there is none, or it is empty, the first address in the text.
    """
    return map_pages(pages, lambda html: [_plain(html)], key, FIELDS)


def records(facts_df: DataFrame, key: str = "page_id") -> DataFrame:
    """A record per page that has a name; missing parts are ''. Services keep their order and repeats."""
    text, place = F.col("text"), T.address_lines(F.col("address_text"))
    df = facts_df.where("name <> ''").withColumns({"_place": place, "_short": T.short_facts(text)})
    blank = lambda c: F.coalesce(c, F.lit(""))
    return df.select(
        key, "name", T.first_type(text, K.FACILITY_TYPES).alias("facility_type"), T.first(text, K.PHONE).alias("phone"), T.first(text, K.EMAIL).alias("email"),
        *(blank(F.col("_place")[c]).alias(c) for c in ("address", "city", "state", "zip_code")), "_short.beds", "_short.license_number", "_short.medicare_provider_id", "services",
    )


def further_pages(facts_df: DataFrame, visited: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, url): the pages that a listing goes on to, on its own site and not among ``visited(url)``; ``facts_df`` has the page's ``url`` too. A page without one goes on to none."""
    rows = facts_df.where(F.col(url).isNotNull()).select(key, F.col(url).alias("_base"), F.explode("page_hrefs").alias("_href"))
    rows = rows.withColumn("url", U.resolve(F.col("_base"), F.col("_href"))).where(U.same_domain(F.col("url"), F.col("_base")))
    return unvisited(rows.select(key, "url").distinct(), visited).select(key, "url")


def _speaks_of_places(href: Column) -> Column:
    return U.contains_any(F.lower(href), K.PLACE_TOKENS)


def place_anchors(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, url): distinct addresses of a page's links that speak of places, relative ones and those to the page's own host."""
    rows = anchors(pages, key).where(_speaks_of_places(F.col("href")) & U.authority(F.col("href")).isin("", U.authority(F.col("base"))))
    return rows.where("url IS NOT NULL").select(key, "url").distinct()
