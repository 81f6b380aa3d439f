"""Traits of page blocks, headings and short texts as Column builders. Boxes are array<double> (x0, y0, x1, y1)."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

from .text import CJK, clean_text


def area(box: Column) -> Column:
    return F.greatest(F.lit(0.0), box[2] - box[0]) * F.greatest(F.lit(0.0), box[3] - box[1])


def parse_box(c: Column) -> Column:
    """A JSON array of four numbers with an area, else null."""
    box = F.from_json(c, "array<double>")
    return F.when((F.size(box) == 4) & (area(box) > 0), box)


def union_box(box: Column) -> list[Column]:
    """Aggregates: the sides of the box around a group's boxes that have an area."""
    real = F.when(area(box) > 0, box)
    return [F.min(real[0]).alias("x0"), F.min(real[1]).alias("y0"), F.max(real[2]).alias("x1"), F.max(real[3]).alias("y1")]


def median_positive(c: Column) -> Column:
    """Aggregate: the median of the values above 0, the mean of the middle two of an even number; 0 without any."""
    return F.coalesce(F.percentile(F.when(c > 0, c), 0.5), F.lit(0.0))


def in_margin(box: Column, page_height: Column) -> Column:
    """Whether a block's middle is in the upper or lower 8 % of a page."""
    y = (box[1] + box[3]) / 2
    return F.coalesce((page_height > 0) & ((y <= page_height * 0.08) | (y >= page_height * 0.92)), F.lit(False))


def is_page_number(text: Column) -> Column:
    """Up to four digits, perhaps after the word page, or up to eight Roman ones."""
    return clean_text(text).rlike(r"(?i)^(?:(?:page\s*)?\d{1,4}|[ivxlcdm]{1,8})$")


def is_side_noise(box: Column, text: Column, page_width: Column, page_height: Column) -> Column:
    """A slender block at the side of a page that is very high, or high and says where the paper is from."""
    width, height, x = F.greatest(F.lit(0.0), box[2] - box[0]), F.greatest(F.lit(0.0), box[3] - box[1]), (box[0] + box[2]) / 2
    side = (x <= page_width * 0.12) | (x >= page_width * 0.88)
    slender = (width <= page_width * 0.12) & (height >= page_height * 0.18)
    says = clean_text(text).rlike("(?i)arxiv|copyright|doi|preprint|submitted|accepted")
    return F.coalesce((page_width > 0) & (page_height > 0) & side & slender & (says | (height >= page_height * 0.28)), F.lit(False))


def heading_text(c: Column) -> Column:
    """A heading without its number and its last colon."""
    c = F.regexp_replace(clean_text(c), r"(?i)^\s*(?:[IVXLC]+|\d+(?:\.\d+)*|[一二三四五六七八九十]+)[\.\s、-]+", "")
    return F.trim(F.regexp_replace(c, r"[:：]\s*$", ""))


def latin_letters(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[A-Za-z]"))


def cjk_letters(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[{CJK}]"))


def mostly_english(c: Column) -> Column:
    c = clean_text(c)
    return latin_letters(c) > F.greatest(F.lit(20), cjk_letters(c) * 2)


def looks_chinese(c: Column) -> Column:
    return cjk_letters(c) >= F.greatest(F.lit(2), F.floor(latin_letters(c) / 3))


def trim_tail(c: Column) -> Column:
    """A sentence without the marks and blanks at its end."""
    return F.regexp_replace(clean_text(c), r"[\s。；;,.，、]+$", "")


def submission_id(c: Column) -> Column:
    """The digits at the end of an id, else the id."""
    c = clean_text(c)
    return F.when(c.rlike(r"\d$"), F.regexp_extract(c, r"(\d+)$", 1)).otherwise(c)


def online_type(question: Column) -> Column:
    """The type of a question that comes without one (fixed values)."""
    low = F.lower(question)
    has = lambda *terms: low.rlike("|".join(t.replace(".", r"\.") for t in terms))
    return F.when(has("table", "表格", "表 ", "表中"), "表格问答").when(has("figure", "fig.", "图", "图片", "曲线", "趋势"), "图表理解").when(has("跨模态", "结合", "图文", "多模态"), "跨模态综合").otherwise("自定义问题")


def correction_wants(question: Column, question_type: Column) -> dict[str, Column]:
    """What the self-correction takes a question to want: table, figure, cross, visual."""
    kind = F.lower(clean_text(question_type))
    blob = F.concat_ws(" ", kind, F.lower(clean_text(question)))
    table, figure = blob.rlike("table|tabular|表"), blob.rlike(r"image|figure|fig\.|chart|plot|diagram|图")
    cross = blob.rlike("cross|multi") | F.contains(kind, F.lit("text-table-image")) | (table & figure)
    return {"table": table, "figure": figure, "cross": cross, "visual": table | figure | cross}


def block_kind(c: Column, math: bool = False) -> Column:
    """The kind of a text block: caption, table, equation or text (fixed patterns)."""
    caption = c.rlike(r"(?i)^\s*(图|圖|Fig\.?|Figure|表|Table)\s*(?U:[\w\-\.]+)[:：]?")
    rows = c.rlike(r"(\d+\s+\d+\s+\d+)|(\|.+\|)|(指标|方法|准确率|召回率|F1|Accuracy|Recall)") & (c.rlike(r"\n.") | c.rlike(r"\d+\s+\d+\s+\d+"))
    formula = c.rlike(r"(\\begin\{equation\}|\\\[|\\\(|\bEq\.?\s*\(?\d+|\([0-9]{1,3}\)\s*$|[=<>]\s*[-+*/()A-Za-z0-9_{}^\\]+|[∑∫√∞≤≥≈≠±])")
    short = (F.length(c) < 500) & (F.regexp_count(c, F.lit("[=∑∫≤≥≈]")) >= 2)
    return F.when(caption, "caption").when(rows, "table").when(formula & (F.lit(math) | short), "equation").otherwise("text")
