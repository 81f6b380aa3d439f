"""Content lists of document parsers: JSON files of typed items, as nodes. A file is one document and one value; its items are rows."""

from __future__ import annotations

import json
import posixpath
import re

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql.functions import pandas_udf

from dossier.functions.blocks import block_kind
from dossier.functions.text import clean_text, doc_name, node_id

# Keys of parsers' items, in the order in which they are read.
NESTED = ("text", "content", "html", "latex", "paragraph_content", "table_body", "table_data", "table_caption", "image_caption", "chart_caption", "image_path", "img_path")
PARTS = ("text", "content", "html", "table_body", "table_data", "table_caption", "table_footnote", "image_caption", "image_footnote", "chart_caption", "chart_footnote", "latex")
TYPE_KEYS = ("type", "block_type", "category_type", "category", "label")
PATH_KEYS = ("image_path", "img_path", "path")
KINDS = {"figure": ("image", "image_body", "figure", "figure_body", "chart", "chart_body"), "table": ("table", "table_body"), "caption": ("image_caption", "table_caption", "chart_caption", "caption"), "equation": ("equation", "interline_equation", "inline_equation", "formula"), "title": ("title", "doc_title")}
FILES = ("_content_list_v2.json", "_content_list.json", "content_list_v2.json", "content_list.json")
ITEM = "array<struct<page: int, raw_type: string, content: string, image_path: string>>"


def value_text(value: object) -> str:
    """A JSON value as text: lists line by line, objects by their known keys, else as JSON."""
    if isinstance(value, dict):
        known = [t for t in (value_text(value.get(k)) for k in NESTED) if t]
        return "\n".join(known) if known else json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        return "\n".join(t for t in map(value_text, value) if t)
    return "" if value is None else str(value).replace("\0", " ").strip()


def page_of(item: dict) -> int:
    """Pages count from 1; indexes of pages from 0."""
    for key in ("page_idx", "page_index"):
        if key in item:
            return int(item[key] or 0) + 1
    return max(1, int(item.get("page") or item.get("page_no") or 1))


def items_of(payload: object) -> list[dict]:
    """The items of a content list: of an object's content_list, items or pages, of a list, of a list of pages, or of pages with blocks; blocks without a page take their place's."""
    if isinstance(payload, dict):
        payload = next((payload[k] for k in ("content_list", "items", "pages") if payload.get(k)), [])
    if not isinstance(payload, list) or not payload:
        return []
    if isinstance(payload[0], list):
        return [{"page_idx": n, **b} for n, page in enumerate(payload) for b in page if isinstance(b, dict)]
    if isinstance(payload[0], dict) and "blocks" in payload[0]:
        return [{"page_idx": page.get("page_idx", page.get("page", n)), **b} for n, page in enumerate(payload) for b in page.get("blocks") or [] if isinstance(b, dict)]
    return [i for i in payload if isinstance(i, dict)]


def image_of(item: dict, folder: str) -> str:
    """An image's path beside its list; addresses and absolute paths stay."""
    path = next((str(item[k]).strip() for k in PATH_KEYS if item.get(k)), "")
    return path if not path or re.match(r"(https?|data):", path, re.I) else posixpath.join(folder, path)


def _read(text: str | None, path: str | None) -> list[dict] | None:
    try:
        items = items_of(json.loads(text or "null"))
    except ValueError:
        return None
    out = []
    for item in items:
        image = image_of(item, posixpath.dirname(path or ""))
        parts = [t for t in (value_text(item.get(k)) for k in PARTS) if t] + ([f"Image path: {image}"] if image else [])
        kind = next((str(item[k]) for k in TYPE_KEYS if item.get(k)), "text")
        out.append({"page": page_of(item), "raw_type": kind.strip().lower().replace("-", "_").replace(" ", "_"), "content": "\n".join(parts), "image_path": image})
    return out


def _parsed(text: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([_read(t, p) for t, p in zip(text, path, strict=True)], dtype=object)


def kind_of(raw_type: Column, content: Column) -> Column:
    out = F.when(raw_type.isin(*KINDS["figure"]), "figure")
    for kind in ("table", "caption", "equation", "title"):
        out = out.when(raw_type.isin(*KINDS[kind]), kind)
    return out.otherwise(block_kind(content))


def content_nodes(lists: DataFrame) -> DataFrame:
    """(doc_id, pos, page, node_type, content, image_path, node_id): the items of each list, numbered for each kind and page. A text that is no JSON has none.

    lists: (doc_id, text, path)."""
    parsed = pandas_udf(_parsed, ITEM)
    rows = lists.select("doc_id", F.posexplode(parsed("text", "path")).alias("pos", "i")).select("doc_id", "pos", "i.page", "i.raw_type", clean_text(F.col("i.content")).alias("content"), "i.image_path")
    rows = rows.withColumn("node_type", kind_of(F.col("raw_type"), F.col("content"))).drop("raw_type")
    n = F.row_number().over(Window.partitionBy("doc_id", "page", "node_type").orderBy("pos"))
    return rows.withColumn("node_id", node_id(F.col("node_type"), F.col("doc_id").cast("string"), F.col("page").cast("string"), n.cast("string")))


def read_content_lists(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, path) of JSON files; a document is called by its file."""
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"(_content_list(_v2)?)?\.json$", "")
    return spark.read.option("wholetext", True).text(path).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path")).select(doc_name(name).alias("doc_id"), "text", "path")


def find_content_list(spark: SparkSession, folder: str, name: str | None = None) -> str | None:
    """The newest content list under a folder, of those whose path names the document; without such a one the only one there is, if there is one. Files are listed, not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*content_list*.json").load(folder).select("path", "modificationTime")
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    found = found.where(base.endswith(FILES[0]) | base.endswith(FILES[1]) | base.isin(*FILES[2:])).orderBy(F.desc("modificationTime"), "path")
    if name is None:
        rows = found.take(1)
        return rows[0]["path"] if rows else None
    stems = {name, posixpath.splitext(name)[0]}
    fits = F.lit(False)
    for stem in sorted(stems):
        fits = fits | F.contains("path", F.lit(stem)) | F.contains(F.col("path"), doc_name(F.lit(stem)))
    rows = found.where(fits).take(1) or (found.take(2) if len(found.take(2)) == 1 else [])
    return rows[0]["path"] if rows else None


def manual_nodes(rows: DataFrame) -> DataFrame:
    """Nodes of a table that people wrote: names are made ids, pages are 1 and types text by default; an id that is missing is made from a count for each type and page.

    rows: (pos, doc_id, page, node_type, node_id, content), all but pos as texts."""
    some = lambda n, other: F.when(F.trim(F.coalesce(n, F.lit(""))) != "", F.trim(F.col(n))).otherwise(other)
    out = rows.withColumn("doc_id", doc_name(some("doc_id", "manual"))).withColumn("page", some("page", "1").cast("int")).withColumn("node_type", some("node_type", "text"))
    n = F.row_number().over(Window.partitionBy("node_type", "page").orderBy("pos"))
    made = node_id(F.col("node_type"), F.col("doc_id"), F.col("page").cast("string"), n.cast("string"))
    return out.withColumn("node_id", some("node_id", made))
