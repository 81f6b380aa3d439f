"""Layout of pages: columns and reading order of text blocks (doc_id, page, block_id, x0, y0, x1, y1, text, page_width)."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

_PAGE = ("doc_id", "page")


def column_counts(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, columns): two where at least eight narrow blocks, three on each half, have their upper medians left of 43 % and right of 57 %."""
    center = (F.col("x0") + F.col("x1")) / 2
    wide = F.col("page_width")
    ok = ((F.col("x1") - F.col("x0")) <= 0.72 * wide) & (F.length(F.trim("text")) >= 20)
    half = lambda left: F.sort_array(F.collect_list(F.when(ok & ((center < wide / 2) if left else (center >= wide / 2)), center)))
    got = blocks.groupBy(*_PAGE).agg(half(True).alias("l"), half(False).alias("r"), F.max("page_width").alias("w"))
    median = lambda a: F.get(a, F.floor(F.size(a) / 2).cast("int"))
    two = (F.size("l") + F.size("r") >= 8) & (F.size("l") >= 3) & (F.size("r") >= 3) & (median(F.col("l")) < 0.43 * F.col("w")) & (median(F.col("r")) > 0.57 * F.col("w"))
    return got.select(*_PAGE, F.when(F.coalesce(two, F.lit(False)), 2).otherwise(1).alias("columns"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, block_id, layout_column, reading_order): top to bottom; on two columns in bands between full-width blocks, left before right.

    A block of a column belongs to the band above the first full-width block that begins below its centre."""
    out = blocks.join(column_counts(blocks), list(_PAGE))
    width, wide = F.col("x1") - F.col("x0"), F.col("page_width")
    full = (width >= 0.72 * wide) | ((F.col("x0") < 0.42 * wide) & (F.col("x1") > 0.58 * wide))
    side = F.when((F.col("x0") + F.col("x1")) / 2 < wide / 2, "left").otherwise("right")
    out = out.withColumn("layout_column", F.when(F.col("columns") == 1, "single").when(full, "full").otherwise(side))
    # Full-width blocks and centres in one order: the number of full-width blocks at or above gives the band.
    at = F.when(F.col("layout_column") == "full", F.col("y0")).otherwise((F.col("y0") + F.col("y1")) / 2)
    is_full = (F.col("layout_column") == "full").cast("int")
    w = Window.partitionBy(*_PAGE).orderBy("at", F.desc("full"), "x0", "block_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn("full", is_full).withColumn("at", at).withColumn("seen", F.sum("full").over(w))
    band = F.when(F.col("layout_column") == "single", 0).when(F.col("full") == 1, 2 * F.col("seen") - 1).otherwise(2 * F.col("seen"))
    order = Window.partitionBy(*_PAGE).orderBy("band", F.when(F.col("layout_column") == "right", 1).otherwise(0), "y0", "x0", "block_id")
    return out.withColumn("band", band).select(*_PAGE, "block_id", "layout_column", F.row_number().over(order).cast("long").alias("reading_order"))
