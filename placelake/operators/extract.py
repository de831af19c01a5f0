"""Records from HTML by declarative CSS schemas."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructField, StructType

from placelake.functions.dom import Element, parse, select

# Characters of HTML after which the rows made so far are handed on, so that a batch of long pages stays small.
FLUSH_CHARS = 4_000_000


def map_pages(pages: DataFrame, make: Callable[[str | None], list[tuple]], key: str, fields: list[pa.Field]) -> DataFrame:
    """Rows ``(key, *make(html))`` of each page, parsed on the executors in Arrow batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([pa.field(key, batch.schema.field(0).type), *fields])

            def flush(rows: list[tuple], schema: pa.Schema = schema) -> pa.RecordBatch:
                columns = list(zip(*rows, strict=True)) or [()] * len(schema)
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

            rows: list[tuple] = []
            chars = 0
            for k, html in zip(batch.column(0), batch.column(1), strict=True):
                html = html.as_py()
                rows += [(k.as_py(), *row) for row in make(html)]
                chars += len(html or "")
                if chars > FLUSH_CHARS:
                    yield flush(rows)
                    rows, chars = [], 0
            yield flush(rows)

    out = StructType([StructField(key, pages.schema[key].dataType), *from_arrow_schema(pa.schema(fields)).fields])
    return pages.select(key, "html").mapInArrow(run, out)


def field(item: Element, spec: dict) -> object:
    """The value of one field of a schema in one element: text or an attribute, the first or all."""
    found = select(item, spec["selector"])
    values = [x.attrs.get(spec["attribute"], "") if spec.get("type") == "attribute" else x.text() for x in found]
    if spec.get("multiple"):
        return [v for v in values if v]
    return values[0] if values else ""


def css_rows(html: str | None, schema: dict) -> list[tuple]:
    """(pos, field values...) of each element of ``baseSelector``; lists as JSON text."""
    rows = []
    for i, item in enumerate(select(parse(html), schema["baseSelector"])):
        values = (field(item, f) for f in schema["fields"])
        rows.append((i, *(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in values)))
    return rows


def css_extract(pages: DataFrame, schema: dict, key: str = "page_id") -> DataFrame:
    """A row per element of ``baseSelector``: key, pos and the fields, lists as JSON text."""
    names = [f["name"] for f in schema["fields"]]
    fields = [pa.field("pos", pa.int64()), *(pa.field(n, pa.string()) for n in names)]
    return map_pages(pages, lambda html: css_rows(html, schema), key, fields)
