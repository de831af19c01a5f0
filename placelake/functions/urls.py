"""Columns over URLs; missing parts are ''."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from placelake import constants as K

PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, group)


def authority(url: Column) -> Column:
    return part(url, 2)


def path(url: Column) -> Column:
    return part(url, 3)


def query(url: Column) -> Column:
    return part(url, 4)


def domain(url: Column) -> Column:
    return F.lower(authority(url))


def resolve(base: Column, href: Column) -> Column:
    """An absolute, protocol-relative, root-relative, query or fragment reference against ``base``; others go beside its last segment. Null where that takes a ``base`` and there is none. Paths of the last two kinds lose ``.`` and ``..``, those beside also empty segments."""
    site = F.concat(part(base, 1), F.lit("://"), authority(base))
    plain = F.regexp_replace(base, r"[?#].*$", "")
    beside = F.concat(F.regexp_replace(path(base), r"[^/]*$", ""), F.when(path(base) == "", F.lit("/")).otherwise(F.lit("")), F.regexp_extract(href, r"^[^?#]*", 0))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(base.isNull(), None)
        .when(href.startswith("//"), F.concat(part(base, 1), F.lit(":"), href))
        .when(href.startswith("/"), normal(F.concat(site, href)))
        .when(href == "", base)
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), href))
        .when(href.startswith("?"), F.concat(plain, href))
        .otherwise(normal(F.concat(site, F.regexp_replace(beside, r"/{2,}", "/"), F.regexp_extract(href, r"[?#].*$", 0))))
    )


def normal(url: Column) -> Column:
    """An absolute URL without ``.`` and ``..`` segments in its path; ``..`` at the root stays at the root."""
    parts = F.split(path(url), "/")
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda out, x: F.when(x == "..", F.when(F.size(out) > 1, F.slice(out, 1, F.size(out) - 1)).otherwise(out)).when(x == ".", out).otherwise(F.concat(out, F.array(x))),
    )
    folder = F.element_at(parts, -1).isin(".", "..")
    clean = F.concat(F.array_join(kept, "/"), F.when(folder, "/").otherwise(""))
    return F.when(path(url).rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.regexp_extract(url, r"^[^?#]*?://[^/?#]*", 0), clean, F.regexp_extract(url, r"[?#].*$", 0))).otherwise(url)


def segments(url: Column) -> Column:
    return F.size(F.filter(F.split(path(url), "/"), lambda x: x != ""))


def depth(url: Column, base: Column) -> Column:
    return segments(url) - segments(base)


def same_domain(url: Column, base: Column) -> Column:
    return authority(url) == authority(base)


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether one of ``parts`` stands in a text; without parts, false."""
    return text.rlike("|".join(re.escape(p) for p in parts)) if parts else F.lit(False)


def is_listing(url: Column) -> Column:
    return contains_any(F.lower(url), K.LISTING_PARTS)


def is_detail(url: Column) -> Column:
    return F.lower(url).rlike(K.DETAIL_URL)


def is_excluded(url: Column) -> Column:
    return contains_any(F.lower(url), K.EXCLUDED_PARTS)


def is_facility(url: Column) -> Column:
    return F.when(is_listing(url), True).when(is_excluded(url), False).otherwise(contains_any(F.lower(path(url)), K.SEGMENT_PARTS))


def classify(url: Column) -> Column:
    return F.when(is_detail(url), "detail").when(is_listing(url), "listing").otherwise("other")


def score(url: Column, base: Column | None = None, keywords: dict[str, int] | None = None, good: tuple[str, ...] = K.URL_GOOD, bad: tuple[str, ...] = K.URL_BAD) -> Column:
    """How promising a URL is: -100 beyond the greatest depth, else the sum of its signs."""
    level = depth(url, base) if base is not None else F.lit(0)
    good, bad = "|".join(good), "|".join(bad)
    p, q, low = F.lower(path(url)), F.lower(query(url)), F.lower(url)
    total = -K.DEPTH_PENALTY * level
    total += F.when(p.rlike(f"(?i){good}") | q.rlike(f"(?i){good}"), 20).otherwise(0)
    total += F.when(p.rlike(f"(?i){bad}"), -50).otherwise(0)
    for word, weight in (K.URL_KEYWORDS if keywords is None else keywords).items():
        total += F.when(low.contains(word), weight).otherwise(0)
    total += F.when(p.contains("/our-") & p.rlike("location|facilities|communities"), 15).otherwise(0)
    total += F.when(q.contains("page=") | p.contains("/page/"), 5).otherwise(0)
    total += F.when(p.rlike(r"\.(pdf|doc|docx|xls|xlsx)$"), -30).otherwise(0)
    return F.when(level > K.MAX_DEPTH, -100).otherwise(total).cast("long")


def glob(url: Column, pattern: str) -> Column:
    """Whether a URL matches a pattern with ``*``, ignoring case."""
    return F.lower(url).like(pattern.lower().replace("\\", "\\\\").replace("_", "\\_").replace("%", "\\%").replace("*", "%"))


def file_name(url: Column) -> Column:
    return F.translate(authority(url), ".", "_")


def maps_address(url: Column) -> Column:
    """The address in a link to a map: what stands after the first ``q=``."""
    q = F.regexp_extract(url, r"q=([^&]*)", 1)
    return F.replace(F.replace(q, F.lit("+"), F.lit(" ")), F.lit("%20"), F.lit(" "))
