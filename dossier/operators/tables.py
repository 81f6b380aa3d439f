"""Tables in text: lines with at least two | that follow each other; header, shape, facts of rows and columns."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from dossier.functions.text import clean_text


def table_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, block, row, cells): the rows of each document's longest table block (the first of equal ones), without separator rows.

    Blocks are islands of table lines, found by a window over one document's lines."""
    lines = documents.where(F.contains("text", F.lit("|"))).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    kept = lines.where(F.length("content") - F.length(F.replace("content", F.lit("|"), F.lit(""))) >= 2)
    order = Window.partitionBy("doc_id").orderBy("line")
    kept = kept.withColumn("block", F.col("line") - F.row_number().over(order))
    size = F.count("*").over(Window.partitionBy("doc_id", "block"))
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("size"), "block", "line"))
    sized = kept.withColumn("size", size).where("size >= 2").withColumn("first", best)
    chosen = sized.withColumn("keep", F.first("block").over(Window.partitionBy("doc_id").orderBy("first"))).where("block = keep")
    body = F.regexp_replace(F.trim("content"), r"^\||\|$", "")
    cells = F.transform(F.split(body, r"\|"), lambda c: F.regexp_replace(F.trim(c), r"[ \t]+", " "))
    rows = chosen.withColumn("cells", cells).where(F.exists("cells", lambda c: c != ""))
    rows = rows.where(~F.forall("cells", lambda c: (c == "") | F.replace(c, F.lit(" "), F.lit("")).rlike("^:?-{2,}:?$")))
    return rows.select("doc_id", "block", F.row_number().over(Window.partitionBy("doc_id").orderBy("line")).alias("row"), "cells")


def table_shapes(rows: DataFrame) -> DataFrame:
    """(doc_id, n_rows, n_columns, headers) of tables with a header and a row at least."""
    out = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.size("cells")).alias("n_columns"), F.max_by("cells", -F.col("row")).alias("h"))
    return out.where("n >= 2").select("doc_id", (F.col("n") - 1).alias("n_rows"), F.col("n_columns").cast("long").alias("n_columns"), F.array_join(F.filter("h", lambda c: c != ""), "; ").alias("headers"))


def numeric_facts(rows: DataFrame) -> DataFrame:
    """(doc_id, col, header, low, low_row, high, high_row) for columns with two numbers or more; the first row of equal values."""
    header = rows.where("row = 1").select("doc_id", F.posexplode("cells").alias("col", "header"))
    cells = rows.where("row > 1").select("doc_id", "row", F.col("cells")[0].alias("label"), F.posexplode("cells").alias("col", "cell"))
    number = F.regexp_extract(F.replace("cell", F.lit(","), F.lit("")), r"([-+]?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    got = cells.withColumn("v", number).where("v is not null")
    low, high = F.min(F.struct("v", "row", "label")), F.max(F.struct("v", (-F.col("row")).alias("r"), "label"))
    out = got.groupBy("doc_id", "col").agg(F.count("*").alias("n"), low.alias("low"), high.alias("high")).where("n >= 2").join(header, ["doc_id", "col"])
    return out.select("doc_id", F.col("col").cast("long").alias("col"), "header", F.col("low.v").alias("low"), F.col("low.label").alias("low_row"), F.col("high.v").alias("high"), F.col("high.label").alias("high_row"))


def table_text(rows: DataFrame) -> DataFrame:
    """(doc_id, text): each table as lines of cells between bars, short rows filled up with empty cells."""
    out = rows.groupBy("doc_id").agg(F.max(F.size("cells")).alias("n"), F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("r"))
    line = lambda r: F.array_join(F.concat(r["cells"], F.array_repeat(F.lit(""), F.col("n") - F.size(r["cells"]))), " | ")
    return out.select("doc_id", clean_text(F.array_join(F.transform("r", line), "\n")).alias("text"))
