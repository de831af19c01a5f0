"""What the markup of a page says: one parse per page on the executors, everything after it in columns."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelake import constants as K
from placelake.functions import text as T
from placelake.functions import urls as U
from placelake.functions.dom import Element, parse, select, select_first
from placelake.operators.extract import map_pages

_TEXT, _TEXTS = pa.string(), pa.list_(pa.string())
_PAIR = pa.struct([("name", _TEXT), ("value", _TEXT)])
_ITEM = pa.struct([("kind", _TEXT), ("item", _TEXT)])
_INPUT = pa.struct([("name", _TEXT), ("type", _TEXT), ("required", pa.bool_())])
_FORM = pa.struct([("action", _TEXT), ("method", _TEXT), ("text", _TEXT), ("fields", pa.list_(_INPUT))])
FIELDS = [
    pa.field("text", _TEXT), pa.field("title", _TEXT), pa.field("name", _TEXT), pa.field("description", _TEXT),
    pa.field("microdata", pa.list_(_PAIR)), pa.field("json_ld", pa.list_(_PAIR)), pa.field("contact_texts", _TEXTS), pa.field("tel", _TEXT), pa.field("mailto", _TEXT),
    pa.field("address_parts", pa.list_(_PAIR)), pa.field("address_text", _TEXT), pa.field("maps_links", _TEXTS),
    pa.field("services", pa.list_(_ITEM)), pa.field("forms", pa.list_(_FORM)), pa.field("nav_links", _TEXTS),
    pa.field("numbered_links", _TEXTS), pa.field("next_links", _TEXTS), pa.field("card_links", pa.list_(_TEXTS)),
]

def _name(root: Element, title: str) -> str:
    for selector in K.NAME_SELECTORS:
        x = select_first(root, selector)
        if x is not None and 3 < len(x.text()) < 100:
            return x.text()
    return title.split("|")[0].split("-")[0].strip()


def _description(root: Element) -> str:
    for selector in K.DESCRIPTION_SELECTORS:
        x = select_first(root, selector)
        if x is not None and x.tag == "meta":
            return x.attrs.get("content", "")
        if x is not None and len(x.text()) > 20:
            return x.text()
    return ""


def _value(x: Element) -> str:
    carrier = {"meta": "content", "input": "value", "textarea": "value", "a": "href"}.get(x.tag)
    return x.attrs.get(carrier, "") if carrier else x.text()


def _microdata(root: Element) -> dict[str, str]:
    """Properties of organisations and businesses; later ones win, empty ones are left out."""
    out: dict[str, str] = {}
    for item in select(root, "[itemscope]"):
        kind = item.attrs.get("itemtype", "")
        if "Organization" in kind or "LocalBusiness" in kind:
            out |= {x.attrs["itemprop"]: v for x in select(item, "[itemprop]") if (v := _value(x))}
    return out


def _json_ld(root: Element) -> dict[str, str]:
    """Fields of the organisations and businesses in JSON-LD blocks; later items win, also by empty values. Bad JSON is passed over."""
    out: dict[str, str] = {}
    for script in select(root, 'script[type="application/ld+json"]'):
        try:
            data = json.loads("".join(c for c in script.children if isinstance(c, str)))
        except (ValueError, RecursionError):
            continue
        for item in data if isinstance(data, list) else [data]:
            if not isinstance(item, dict) or item.get("@type") not in K.JSON_LD_TYPES:
                continue
            address = item.get("address", {})
            found = {name: item.get(key, "") for name, key in K.JSON_LD_FIELDS.items()}
            if isinstance(address, dict):
                found |= {name: address.get(key, "") for name, key in K.JSON_LD_ADDRESS.items()}
            out |= {k: v if isinstance(v, str) else "" if not v else json.dumps(v, ensure_ascii=False) for k, v in found.items()}
    return out


def _address(root: Element) -> tuple[dict[str, str], str]:
    x = select_first(root, '[itemprop="address"], .address, .location')
    if x is None:
        return {}, ""
    parts = {name: p.text() for name, selector in K.ADDRESS_SELECTORS.items() if (p := select_first(x, selector)) is not None and p.text()}
    return parts, x.lines()


def _kind(section: Element) -> str:
    said = section.text().lower() + " " + section.attrs.get("class", "").lower()
    return next((kind for kind, words in K.SERVICE_KINDS.items() if any(w in said for w in words)), "services_offered")


def _items(section: Element) -> list[str]:
    items = [t for x in select(section, "li") if (t := x.text())]
    items = items or [t for x in select(section, "p, div") if (t := x.text()) and len(t) < 200]
    whole = section.text()
    return items or ([t.strip() for t in whole.split(",") if t.strip()] if "," in whole else [])


def _services(root: Element) -> list[tuple[str, str]]:
    """Distinct (kind, item) of the sections about services, sorted."""
    sections = select(root, K.SERVICE_SELECTORS)
    for heading in select(root, "h1, h2, h3, h4, h5, h6"):
        if any(w in heading.text().lower() for w in K.SERVICE_HEADINGS) and (after := heading.next_element()) is not None:
            sections.append(after)
    unique = {id(s): s for s in sections}.values()
    return sorted({(_kind(s), item) for s in unique for item in _items(s) if len(item.strip()) > 2})


def _forms(root: Element) -> list[dict]:
    forms = []
    for form in select(root, "form"):
        fields = [{"name": x.attrs.get("name", ""), "type": x.attrs.get("type", "text"), "required": "required" in x.attrs} for x in select(form, "input, select")]
        forms.append({"action": form.attrs.get("action", ""), "method": form.attrs.get("method", "get").lower(), "text": form.text(), "fields": fields})
    return forms


def _hrefs(root: Element, selector: str) -> list[str]:
    return list(dict.fromkeys(h for x in select(root, selector) if (h := x.attrs.get("href"))))


def _cards(root: Element) -> list[list[str]]:
    cards = select(root, K.CARD_SELECTORS) or select(root, "li") + select(root, "tr")
    return [_hrefs(card, "a[href]") for card in cards]


def facts(html: str | None) -> tuple:
    root = parse(html)
    title = t.text() if (t := select_first(root, "title")) is not None else ""
    tel, mail = (next(iter(_hrefs(root, f'a[href^="{scheme}:"]')), "").replace(f"{scheme}:", "").strip() for scheme in ("tel", "mailto"))
    parts, address_text = _address(root)
    pairs = lambda d: [{"name": k, "value": v} for k, v in d.items()]
    return (
        root.lines(), title, _name(root, title), _description(root),
        pairs(_microdata(root)), pairs(_json_ld(root)), [x.lines() for x in select(root, K.CONTACT_SELECTORS)], tel, mail,
        pairs(parts), address_text, _hrefs(root, 'a[href*="maps.google"], a[href*="google.com/maps"]'),
        [{"kind": k, "item": i} for k, i in _services(root)], _forms(root), _hrefs(root, K.NAV_LINK_SELECTORS),
        _hrefs(root, K.NUMBERED_SELECTORS), _hrefs(root, K.NEXT_SELECTORS), _cards(root),
    )


def page_facts(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, facts of the markup). Null and empty pages give empty facts."""
    return map_pages(pages, lambda html: [facts(html)], key, FIELDS)


def _of(pairs: Column, name: str) -> Column:
    """The value that a list of pairs has for ``name``; null if none."""
    return T.head(F.filter(pairs, lambda p: p["name"] == name))["value"]


def _first_text(texts: Column, how) -> Column:
    return T.head(F.filter(F.transform(texts, how), lambda x: x != ""))


def contacts(df: DataFrame) -> DataFrame:
    """Phone, email and address of a page: of contact sections, of the whole text, of elements, of links to maps; a later way overrules an earlier one."""
    section = T.head(F.filter(F.transform("contact_texts", T.parse_address), lambda a: a["address"].isNotNull() | a["zip_code"].isNotNull()))
    # columns of their own, so that each is worked out once
    df = df.withColumns({"_section": section, "_element": T.parse_address(F.col("address_text"))})
    section, element = F.col("_section"), F.col("_element")
    phones = F.filter(F.transform(F.regexp_extract_all("text", F.lit(K.PHONE), 1), T.clean_phone), T.valid_phone)
    emails = F.filter(F.regexp_extract_all("text", F.lit(K.EMAIL), 1), lambda e: ~F.lower(e).rlike("|".join(K.EMAIL_FALSE)))
    full = lambda c: F.nullif(c, F.lit(""))
    parts = F.col("address_parts")
    street = F.coalesce(T.head(F.filter(F.transform("maps_links", U.maps_address), lambda a: a != "")), _of(parts, "address"), element["address"], section["address"])
    return df.select(
        "*",
        F.coalesce(full(T.clean_phone(F.col("tel"))), T.head(phones), T.clean_phone(_first_text(F.col("contact_texts"), T.phone)), F.lit("")).alias("phone"),
        F.coalesce(full(F.col("mailto")), T.head(emails), _first_text(F.col("contact_texts"), T.email), F.lit("")).alias("email"),
        F.coalesce(street, F.lit("")).alias("address"),
        *(F.coalesce(_of(parts, c), element[c], section[c], F.lit("")).alias(c) for c in ("city", "state", "zip_code")),
    ).drop("_section", "_element")


def assemble(facts_df: DataFrame, key: str = "page_id") -> DataFrame:
    """A facility record per page: microdata first, then JSON-LD, contacts, type, services and what the text says of beds, staff and licences."""
    df = contacts(facts_df)
    micro = F.col("microdata")
    ld = lambda name: F.nullif(_of(F.col("json_ld"), name), F.lit(""))
    first = lambda name, other: F.coalesce(_of(micro, name), ld(name), other, F.lit(""))
    place = lambda name, other: first(name, F.col(other)).alias(other)
    items = lambda kind: F.transform(F.filter("services", lambda s: s["kind"] == kind), lambda s: s["item"])
    text = F.col("text")
    return df.select(
        key,
        first("name", F.col("name")).alias("name"), first("description", F.col("description")).alias("description"),
        first("telephone", F.col("phone")).alias("phone"), first("email", F.col("email")).alias("email"),
        place("street_address", "address"), *(place(c, c) for c in ("city", "state", "zip_code")),
        F.coalesce(F.nullif(T.title_case(T.best_type(text, K.FACILITY_TYPES)), F.lit("")), F.lit(K.OTHER_TYPE)).alias("facility_type"),
        T.beds(text).alias("beds"), T.administrator(text).alias("administrator"), T.license_number(text).alias("license_number"), T.medicare_id(text).alias("medicare_provider_id"),
        *(items(kind).alias(kind) for kind in ("services_offered", *K.SERVICE_KINDS)),
    )


def search_forms(df: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, endpoint, method, field, type, required): a row per input of the forms that search for places."""
    forms = df.select(key, url, F.explode("forms").alias("form")).where(F.lower("form.text").rlike("|".join(K.FORM_WORDS)))
    rows = forms.select(key, U.resolve(F.col(url), F.col("form.action")).alias("endpoint"), F.col("form.method").alias("method"), F.explode_outer("form.fields").alias("f"))
    return rows.select(key, "endpoint", "method", F.col("f.name").alias("field"), F.col("f.type").alias("type"), F.col("f.required").alias("required"))


def ajax_endpoints(pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, endpoint): addresses in scripts that speak of places, on the page's own site."""
    scripts = F.array_join(F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*>(.*?)</script>"), 1), "\n")
    found = F.flatten(F.array(*(F.regexp_extract_all(scripts, F.lit(f"(?i){p}"), 1) for p in K.AJAX_PATTERNS)))
    rows = pages.select(key, url, F.explode(found).alias("href")).where(F.lower("href").rlike("location|facility"))
    rows = rows.withColumn("endpoint", U.resolve(F.col(url), F.col("href")))
    return rows.where(U.same_domain(F.col("endpoint"), F.col(url))).select(key, "endpoint").distinct()


def page_links(df: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, page_url): further pages of a listing, itself included; numbered ones have a digit."""
    numbered = F.filter("numbered_links", lambda h: h.rlike(r"\d"))
    hrefs = F.transform(F.concat(numbered, "next_links"), lambda h: U.resolve(F.col(url), h))
    return df.select(key, F.explode(F.array_distinct(F.concat(F.array(url), hrefs))).alias("page_url")).where("page_url is not null")


def nav_targets(df: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, target, kind): links of menus and footers to places on the same site, detail or listing."""
    rows = df.select(key, url, F.explode("nav_links").alias("href")).withColumn("target", U.resolve(F.col(url), F.col("href")))
    t = F.col("target")
    rows = rows.where(U.same_domain(t, F.col(url)) & U.is_listing(t))
    return rows.select(key, "target", F.when(U.is_detail(t), "detail").otherwise("listing").alias("kind")).distinct()


def card_targets(df: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, card, target): the first link of each card to a place on the same site."""
    rows = df.select(key, url, F.posexplode("card_links").alias("card", "hrefs"))
    targets = F.transform("hrefs", lambda h: U.resolve(F.col(url), h))
    fits = F.filter(targets, lambda t: U.is_facility(t) & U.same_domain(t, F.col(url)))
    return rows.withColumn("target", T.head(fits)).where("target is not null").select(key, "card", "target")
