"""Schemas out of the pages of a site: what is repeated, and where in it names, phones and addresses stand."""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelake import constants as K
from placelake.functions import urls as U
from placelake.functions.dom import Element, parse, select, select_first
from placelake.operators import cascade as X
from placelake.operators.extract import map_pages

FIELDS = ("name", "address", "city_state_zip", "phone", "email")
LEAST_ITEMS = 2
"""So often an item stands beside others of its kind, in one page at least."""
MOST_SCHEMAS = 50_000
"""Up to so many schemas are sent to all tasks; more are joined."""

_HEADS = ("h1", "h2", "h3", "h4", "h5", "h6", "strong", "b", "a", "dt")
_TESTS = (
    ("city_state_zip", re.compile(K.CITY_STATE_ZIP)),
    ("phone", re.compile(K.PHONE)),
    ("email", re.compile(K.EMAIL)),
    ("address", re.compile(rf"^\d+\s+[A-Za-z0-9 .'-]+\b(?:{K.STREET})\b", re.I)),
)
_SAFE = re.compile(r"[A-Za-z_][\w-]*")


def _signature(x: Element) -> str:
    """Tag and classes of an element as a selector."""
    classes = sorted(c for c in x.attrs.get("class", "").split() if _SAFE.fullmatch(c))
    return ".".join([x.tag, *dict.fromkeys(classes)])


def _base(x: Element) -> str:
    """A selector of the items like ``x``; one without classes is told by its parent as well."""
    own = _signature(x)
    return own if "." in own or x.parent is None or not x.parent.tag else f"{_signature(x.parent)} {own}"


def _field(x: Element) -> str | None:
    """Which field the text of a small element is."""
    text = x.text()
    if not 3 <= len(text) <= 200:
        return None
    found = next((name for name, test in _TESTS if test.search(text)), None)
    return found or ("name" if x.tag in _HEADS and len(text) <= 100 else None)


def _proposals(html: str | None) -> list[tuple]:
    """(base, field, selector, n) of a page: how many of the items ``base`` have the field at the selector; with field '' how many items there are."""
    groups: dict[tuple[int, str], list[Element]] = defaultdict(list)
    for x in parse(html).all():
        groups[id(x.parent), _base(x)].append(x)
    count: Counter = Counter()
    for (_, base), items in groups.items():
        if len(items) < LEAST_ITEMS:
            continue
        for item in items:
            places: dict[str, str] = {}
            before: set[str] = set()
            for x in item.all():  # the first place of each field, the innermost of those that begin with it
                own = _signature(x)
                place = f"{own}:nth-child({x.index})" if own in before else own
                before.add(own)
                if (field := _field(x)) and field not in places and not any(isinstance(c, Element) and _field(c) == field for c in x.children):
                    places[field] = place
            if "name" in places and len(places) > 1:
                count[base, "", ""] += 1
                count.update((base, field, place) for field, place in places.items())
    return [(*k, n) for k, n in sorted(count.items())]


def induce(pages: DataFrame, key: str = "page_id", url: str = "url", least: int = 3) -> DataFrame:
    """(domain, base, fields): for each site the selector of its items and a map of field to selector, the most frequent.

    Repeated elements are counted in each page where it lies and summed over the site's pages. A site needs ``least`` items with
    a name and some other field; the base with the most fields wins, then that of the most items, then the first by name. A field
    is taken if a third of the items have one at its selector. Pages without URL or content give nothing.
    """
    counted = map_pages(pages.where(F.col(url).isNotNull()), _proposals, key, [pa.field(c, pa.string()) for c in ("base", "field", "selector")] + [pa.field("n", pa.int64())])
    sums = counted.join(pages.select(key, U.domain(F.col(url)).alias("domain")), key).groupBy("domain", "base", "field", "selector").agg(F.sum("n").alias("n"))
    fields = sums.where("field <> ''").groupBy("domain", "base", "field").agg(F.max(F.struct("n", "selector")).alias("best"))
    items = sums.where("field = ''").select("domain", "base", F.col("n").alias("items")).where(F.col("items") >= least)
    good = fields.join(items, ["domain", "base"]).where("3 * best.n >= items")
    schemas = good.groupBy("domain", "base", "items").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", F.col("best.selector").alias("selector"))))).alias("fields"))
    ranked = schemas.where(F.map_contains_key("fields", "name") & (F.size("fields") > 1))
    best = ranked.groupBy("domain").agg(F.min(F.struct(-F.size("fields"), -F.col("items"), F.col("base"), F.to_json("fields").alias("json"))).alias("s"))
    return best.select("domain", "s.base", F.from_json("s.json", "map<string,string>").alias("fields"))


def _items(html: str | None, base: str | None, fields: list[tuple[str, str]] | None) -> list[dict]:
    if not html or not base:
        return []
    wanted = dict(fields or ())
    return [{f: (x.text() if f in wanted and (x := select_first(item, wanted[f])) is not None else "") for f in FIELDS} for item in select(parse(html), base)]


def items(html: Column, base: Column, fields: Column) -> Column:
    """The items of a page by a schema of its own: structs of FIELDS; none without a schema."""
    kind = pa.list_(pa.struct([(f, pa.string()) for f in FIELDS]))

    @F.arrow_udf(f"array<struct<{', '.join(f'{f}: string' for f in FIELDS)}>>")
    def run(pages: pa.Array, bases: pa.Array, maps: pa.Array) -> pa.Array:
        return pa.array([_items(p.as_py(), b.as_py(), json.loads(m.as_py()) if m.as_py() else None) for p, b, m in zip(pages, bases, maps, strict=True)], kind)

    entries = F.to_json(F.transform(F.map_entries(fields), lambda e: F.array(e["key"], e["value"])))
    return run(html, base, entries)


def hybrid(pages: DataFrame, schemas: DataFrame | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, method, records): of each page the records of the first way that gives valid ones.

    The ways are the schema of the page's site (``schemas(domain, base, fields)``, by default those that ``induce`` finds), the
    library's schemas, patterns, and blocks with a keyed name. method is generated_schema, predefined_schema,
    regex_extraction, keyed_blocks or none. Only pages without records of a way go on to the next.
    """
    schemas = induce(pages, key, url) if schemas is None else schemas
    schemas = F.broadcast(schemas) if schemas.count() <= MOST_SCHEMAS else schemas
    with_schema = pages.withColumn("domain", U.domain(F.col(url))).join(schemas.select("domain", "base", "fields"), "domain", "left")
    found = with_schema.select(key, F.col(url).alias("url"), "html", items(F.col("html"), F.col("base"), F.col("fields")).alias("_items"))
    found = found.withColumn("_own", F.filter(F.transform("_items", lambda i: X.normalise(i, FIELDS)), X.is_valid)).drop("_items")
    own = found.where(F.size("_own") > 0).select(key, F.lit("generated_schema").alias("method"), F.col("_own").alias("records"))
    rest = found.where(F.size("_own") == 0).select(key, "url", "html")
    known = X.extract(rest, key, "url").select(key, "method", "records")
    blocks = known.where("method = 'none'").select(key).join(rest.select(key, "html"), key).select(key, X.keyed_records(F.col("html")).alias("records"))
    last = blocks.select(key, F.when(F.size("records") > 0, "keyed_blocks").otherwise("none").alias("method"), "records")
    return own.unionByName(known.where("method <> 'none'")).unionByName(last)
