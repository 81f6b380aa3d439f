"""The texts of a node by which routes, guards and the after-sales score find it. A column that the nodes lack, or that is null, is an empty text."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .text import casefold, clean_text, preview

# What a vision model says of a node.
VISUAL_FIELDS = ("visual_title", "visual_type", "key_objects", "ocr_text", "data_or_trends", "qa_evidence", "limitations", "visual_caption", "visual_summary")


def field(nodes: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in nodes.columns else F.lit("")


def _joined(*parts: Column) -> Column:
    return clean_text(F.concat_ws(" ", *parts))


def _fields(nodes: DataFrame, *names: str) -> Column:
    return _joined(*[field(nodes, n) for n in names])


def visual_text(nodes: DataFrame) -> Column:
    """The cleaned fields that are not empty."""
    return F.array_join(F.filter(F.array(*[clean_text(field(nodes, n)) for n in VISUAL_FIELDS]), lambda x: x != ""), " ")


def retrieval_text(nodes: DataFrame) -> Column:
    before = [field(nodes, n) for n in ("doc_id", "product_category", "service_intents", "section", "source_ref", "previous_chunk_preview", "content", "next_chunk_preview", "searchable_text")]
    return _joined(*before, visual_text(nodes))


def section_text(nodes: DataFrame) -> Column:
    named = [F.concat(F.lit(f"{n}:"), field(nodes, n)) for n in ("paper_domain", "section", "node_type", "structure_type", "chunk_strategy", "layout_role", "explicit_refs")]
    return _joined(*named, preview(field(nodes, "content"), 240))


def table_text(nodes: DataFrame) -> Column:
    known = [clean_text(field(nodes, n)) for n in ("node_type", "section", "source_ref", "table_caption", "table_headers", "table_shape", "table_key_facts", "table_numeric_facts", "table_summary", "table_structured_json")]
    own = F.when(clean_text(field(nodes, "node_type")) == "table", clean_text(field(nodes, "qa_evidence"))).otherwise("")
    return _joined(*known, own, preview(field(nodes, "content"), 500))


def product_text(nodes: DataFrame) -> Column:
    return casefold(_fields(nodes, "doc_id", "product_category", "section", "source_ref", "content", "visual_title", "key_objects", "qa_evidence", "visual_caption"))


def after_sales_text(nodes: DataFrame) -> Column:
    return casefold(_fields(nodes, "paper_domain", "chunk_template", "requested_chunk_template", "doc_id", "section", "node_type", "source_ref", "visual_summary", "previous_chunk_preview", "content", "next_chunk_preview"))


def guard_text(nodes: DataFrame) -> Column:
    return _fields(nodes, "node_type", "section", "source_ref", "content", "visual_title", "visual_type", "ocr_text", "data_or_trends", "qa_evidence", "visual_summary", "visual_caption")


#: Texts by the name of what reads them.
TEXTS = {"retrieval": retrieval_text, "section": section_text, "table": table_text, "product": product_text, "after_sales": after_sales_text, "visual": visual_text, "guard": guard_text}


def with_texts(nodes: DataFrame, *names: str) -> DataFrame:
    """The nodes with a column text_<name> for each named text, all of them by default."""
    return nodes.select("*", *[TEXTS[n](nodes).alias(f"text_{n}") for n in names or TEXTS])
