"""Records of a page by the first way that finds valid ones: CSS schemas, patterns over blocks, linked pages, a model's replies."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelake import constants as K
from placelake.functions import text as T
from placelake.functions import urls as U
from placelake.functions.dom import parse, select
from placelake.operators.extract import field
from placelake.operators.validate import valid_facility
from placelake.schemas import MODEL_REPLY, SCHEMAS, Schema

CSS_FIELDS = tuple(dict.fromkeys(f for s in SCHEMAS for f in s.fields))
RECORD = ("name", "facility_type", "address", "city", "state", "zip_code", "phone", "email", "website", "services")
LEAST_COMPATIBILITY = 0.3


def compatibility(html: Column, schema: Schema) -> Column:
    """The share of a schema's classes that occur in the page: one for each base selector, a half for each class of a field."""
    page = F.coalesce(html, F.lit(""))
    has = lambda word, points: F.when(F.contains(page, F.lit(word)), points).otherwise(0.0)
    bases = schema.base.split(", ")
    classes = [c for selector in schema.fields.values() for c in re.findall(r"\.([\w-]+)", selector)]
    score = F.lit(0.0)
    for base in bases:
        if found := re.search(r"\.([^. ]+)", base):
            score += has(found[1], 1.0)
        elif found := re.search(r"#([^# ]+)", base):
            score += has(f'id="{found[1]}"', 1.0)
    for c in classes:
        score += has(c, 0.5)
    return score / (len(bases) + len(classes))


def schema_by_url(url: Column, most_specific: bool = False) -> Column:
    """The first schema of which a glob fits; with ``most_specific`` that of the longest glob. Null if none fits."""
    globs = [(s.name, g) for s in SCHEMAS for g in s.globs]
    if most_specific:
        globs.sort(key=lambda x: -len(x[1].replace("*", "")))
    return F.coalesce(*(F.when(U.glob(url, g), name) for name, g in globs))


def schema_by_markup(html: Column) -> Column:
    """The first schema of the greatest compatibility, if that is above the least; else null."""
    scored = F.array(*(F.struct(compatibility(html, s).alias("score"), F.lit(-i).alias("order"), F.lit(s.name).alias("name")) for i, s in enumerate(SCHEMAS)))
    best = F.array_max(scored)
    return F.when(best["score"] > LEAST_COMPATIBILITY, best["name"])


def choose_schema(url: Column, html: Column, most_specific: bool = False) -> Column:
    return F.coalesce(schema_by_url(url, most_specific), schema_by_markup(html))


def _items(html: str | None, name: str | None) -> list[dict]:
    schema = next((s.css() for s in SCHEMAS if s.name == name), None)
    if schema is None:
        return []
    out = []
    for x in select(parse(html), schema["baseSelector"]):
        values = {f["name"]: field(x, f) for f in schema["fields"]}
        out.append({k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in values.items()})
    return out


def css_items(html: Column, schema_name: Column) -> Column:
    """The items of a page by a schema of the library: structs of ``CSS_FIELDS``, lists as JSON text."""
    kind = pa.list_(pa.struct([(f, pa.string()) for f in CSS_FIELDS]))

    @F.arrow_udf(f"array<struct<{', '.join(f'{f}: string' for f in CSS_FIELDS)}>>")
    def run(pages: pa.Array, names: pa.Array) -> pa.Array:
        return pa.array([_items(p.as_py(), n.as_py()) for p, n in zip(pages, names, strict=True)], kind)

    return run(html, schema_name)


def normalise(item: Column, have: tuple[str, ...], default_type: str = "") -> Column:
    """A record of the fields of ``item``, whose names are ``have``: aliases, a joint city line, care types before services. An item whose type is null has the ``default_type``; a blank type stays blank."""
    alias = lambda name: T.non_blank(*(item[a] for a in K.ALIASES[name] if a in have)) if set(K.ALIASES[name]) & set(have) else F.lit("")
    joint = T.city_state_zip(item["city_state_zip"]) if "city_state_zip" in have else None
    part = lambda name: F.coalesce(joint[name], alias(name)) if joint is not None else alias(name)
    lists = [F.from_json(item[c], "array<string>") for c in ("care_types", "services") if c in have]
    filled = [F.when(F.size(x) > 0, x) for x in lists]
    services = F.filter(F.transform(F.coalesce(*filled, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    own = {c: part(c) for c in ("city", "state", "zip_code")} | {"services": services}
    kinds = [item[a] for a in K.ALIASES["facility_type"] if a in have]
    own |= {"facility_type": F.when(F.coalesce(*kinds, F.lit(None).cast("string")).isNull(), default_type).otherwise(alias("facility_type"))} if default_type else {}
    return F.struct(*((own[c] if c in own else alias(c)).alias(c) for c in RECORD))


def is_valid(record: Column) -> Column:
    """A name of three characters that isn't generic, and some part of an address."""
    return valid_facility(record["name"], *(record[c] for c in ("address", "city", "state", "zip_code")))


def blocks(html: Column) -> Column:
    """The blocks whose opening tag speaks of a place; the whole page if there are none."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(f"(?is){K.BLOCK}"), 0)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.coalesce(html, F.lit(""))))


def wide_blocks(html: Column, most: int | None = None) -> Column:
    """The blocks by four patterns, one after another; else the pieces over 100 characters between blocks. All of them, or the first ``most``."""
    page = F.coalesce(html, F.lit(""))
    found = F.concat(*(F.regexp_extract_all(page, F.lit(f"(?is){p}"), 0) for p in K.BLOCKS))
    pieces = F.filter(F.split(page, K.BLOCK_SPLIT), lambda x: F.length(x) > 100)
    out = F.when(F.size(found) > 0, found).otherwise(pieces)
    return F.slice(out, 1, most) if most else out


def block_record(block: Column, keyed: bool = False) -> Column:
    """A record of what the patterns find in a block. With ``keyed`` the name has to hold a word such as care, and there is no state or type."""
    ci = lambda p: f"(?i){p}"
    name = T.first(block, ci(K.BLOCK_NAME_KEYED)) if keyed else T.first_of(block, *K.BLOCK_NAMES)
    kind = F.when(F.lit(False), "")
    for pattern, title in K.BLOCK_TYPES.items():
        kind = kind.when(block.rlike(ci(pattern)), title)
    kind = F.when(block.rlike(ci(K.BLOCK_CONTEXT)), kind.otherwise(K.OTHER_TYPE)).otherwise("")
    found = {
        "name": F.trim(name), "phone": T.first(block, K.BLOCK_PHONE, 0), "email": T.first(block, K.EMAIL, 0), "address": T.first(block, ci(K.BLOCK_STREET), 0),
        "zip_code": T.zip_code(block, bounded=True), "services": F.array().cast("array<string>"),
    }
    if not keyed:
        found |= {"state": T.first(block, r"(?U)\b[A-Z]{2}\b", 0), "facility_type": kind}
    return F.struct(*(found.get(c, F.lit("")).alias(c) for c in RECORD))


def regex_records(html: Column) -> Column:
    return F.filter(F.transform(blocks(html), lambda b: block_record(b)), is_valid)


def keyed_records(html: Column, most: int | None = None) -> Column:
    """Records of the wide blocks that have a keyed name and some contact."""
    ok = lambda r: valid_facility(r["name"], *(r[c] for c in ("phone", "email", "address", "city", "zip_code")), generic=K.GENERIC_NAMES[:5])
    return F.filter(F.transform(wide_blocks(html, most), lambda b: block_record(b, keyed=True)), ok)


def reply_records(reply: Column) -> Column:
    """Valid records of a model's reply, phones cleaned."""
    found = T.reply_facilities(reply, MODEL_REPLY)

    def record(item: Column) -> Column:
        get = lambda c: F.trim(F.coalesce(item[c], F.lit("")))
        own = {"phone": T.clean_phone(get("phone")), "services": F.coalesce(item["services_offered"], F.array().cast("array<string>"))}
        return F.struct(*((own[c] if c in own else get(c)).alias(c) for c in RECORD))

    return F.filter(F.transform(found, record), lambda r: valid_facility(r["name"], r["address"], r["city"], r["state"], generic=K.GENERIC_NAMES[:4]))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", most_specific: bool = False) -> DataFrame:
    """(key, url, method, schema_name, records): CSS records where a schema gives valid ones, else those of patterns, else none.

    One narrow pass: a page is read once, no stage shuffles or scans again. ``method`` is
    predefined_schema, regex_extraction or none.
    """
    chosen = pages.select(key, F.col(url).alias("url"), "html", choose_schema(F.col(url), F.col("html"), most_specific).alias("schema_name"))
    items = chosen.withColumn("items", css_items(F.col("html"), F.col("schema_name")))
    found = items.select(
        key, "url", "html", "schema_name", F.filter(F.transform("items", lambda i: normalise(i, CSS_FIELDS)), is_valid).alias("by_schema")
    )
    found = found.withColumn("records", F.when(F.size("by_schema") > 0, F.col("by_schema")).otherwise(regex_records(F.col("html"))))
    method = F.when(F.size("by_schema") > 0, "predefined_schema").when(F.size("records") > 0, "regex_extraction").otherwise("none")
    return found.select(key, "url", method.alias("method"), "schema_name", "records")


def with_links(found: DataFrame, links: DataFrame, key: str = "page_id") -> DataFrame:
    """``found`` with the records of linked pages, first of each name and postal code, where a page has none of its own.

    ``links(key, url)`` are the page's links to places. Only pages without records, and their links, are joined.
    """
    empty = found.where(F.size("records") == 0)
    wanted = links.join(empty.select(key), key, "left_semi").select(F.col(key).alias("_page"), "url").distinct()
    got = found.where(F.size("records") > 0).select(F.col(key).alias("_source"), "url", F.explode("records").alias("r")).join(wanted, "url")
    first = got.groupBy("_page", F.lower("r.name").alias("_name"), F.col("r.zip_code").alias("_zip")).agg(F.min_by("r", F.struct("_source", "r")).alias("r"))
    linked = first.groupBy("_page").agg(F.sort_array(F.collect_list("r")).alias("linked"))
    out = found.join(linked, found[key] == linked["_page"], "left").drop("_page")
    take = F.col("linked").isNotNull()
    return out.select(key, "url", F.when(take, "internal_links").otherwise(F.col("method")).alias("method"), "schema_name", F.when(take, F.col("linked")).otherwise(F.col("records")).alias("records"))


def with_replies(found: DataFrame, replies: DataFrame, key: str = "page_id") -> DataFrame:
    """``found`` with the records of a model's ``replies(key, reply)`` where a page has none; a row per reply that is used."""
    have = found.where(F.size("records") > 0)
    last = found.where(F.size("records") == 0).drop("records", "method").join(replies.select(key, reply_records(F.col("reply")).alias("records")), key, "left")
    none = found.schema["records"].dataType
    last = last.withColumn("records", F.coalesce("records", F.array().cast(none)))
    method = F.when(F.size("records") > 0, "llm_fallback").otherwise("llm_fallback_failed")
    return have.unionByName(last.withColumn("method", method))


def flat(found: DataFrame, key: str = "page_id") -> DataFrame:
    """A row per record, with the method and schema that gave it."""
    return found.select(key, "url", "method", "schema_name", F.posexplode("records").alias("pos", "r")).select(key, "url", "method", "schema_name", "pos", "r.*")


def site_targets(pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, target, confidence, site_type): links that may lead to listings, by patterns over the HTML; confidence 0.6 each."""
    hrefs = F.flatten(F.array(*(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(f"(?i){p}"), 1) for p in K.SITE_LINKS)))
    rows = pages.select(key, url, T.site_type(F.col("html")).alias("site_type"), F.explode(F.array_distinct(hrefs)).alias("href"))
    return rows.select(key, U.resolve(F.col(url), F.col("href")).alias("target"), F.lit(0.6).alias("confidence"), "site_type").distinct()


def best_targets(targets: DataFrame, main: DataFrame, key: str = "page_id", chain: int = 5, other: int = 2) -> DataFrame:
    """The best targets of a site, five of a chain's and two of others, and the main page at 0.7 where it isn't among them.

    ``targets(key, target, confidence, expected, site_type)``, ``main(key, url)``. The list of a site is cut
    by rank; Spark keeps only the first ranks of each task before the shuffle (WindowGroupLimit).
    """
    most = F.when(F.col("site_type") == "corporate_chain", chain).otherwise(other)
    order = F.struct(-F.col("confidence"), -F.coalesce("expected", F.lit(0)), F.col("target"))
    w = F.row_number().over(Window.partitionBy(key).orderBy(order))
    best = targets.withColumn("_rank", w).where(F.col("_rank") <= max(chain, other)).where(F.col("_rank") <= most).select(key, "target", "confidence")
    mine = main.select(key, F.col("url").alias("target"))
    return best.unionByName(mine.join(best, [key, "target"], "left_anti").withColumn("confidence", F.lit(0.7)))
