"""Ablation variants of node tables, and reports over runs."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

VISUAL_COLUMNS = ("visual_summary", "visual_caption", "crop_image_path", "page_image_path")


def variant(nodes: DataFrame, text_only: bool = False, strip_visual: bool = False) -> DataFrame:
    """Nodes as all text, or without what vision added: the visual columns, and a content's part from its visual summary on."""
    out = nodes
    if strip_visual:
        out = out.withColumn("content", F.substring_index("content", "\n\nVisual summary:", 1))
        for c in VISUAL_COLUMNS:
            if c in out.columns:
                out = out.withColumn(c, F.lit(None).cast("string"))
    if text_only:
        out = out.withColumn("node_type", F.lit("text"))
    return out


def deltas(summary: DataFrame, base: str, names: tuple[str, ...]) -> DataFrame:
    """Each method's metrics less those of the base, a row of the summary."""
    ref = summary.where(F.col("method") == base).agg(*[F.max(n).alias(n) for n in names]).first()
    return summary.select("method", *[F.round(F.col(n) - F.lit(ref[n]), 4).alias(f"delta_{n}") for n in names])


def route_counts(ranked: DataFrame) -> DataFrame:
    """(route, n, share): how many ranked rows each route brought, of strings route:rank joined by |, and the share of all rows."""
    each = ranked.select(F.explode(F.split("routes", r"\|")).alias("r")).select(F.substring_index("r", ":", 1).alias("route"))
    total = max(1, ranked.count())
    return each.groupBy("route").agg(F.count("*").alias("n")).select("route", "n", F.round(F.col("n") / total, 4).alias("share"))


def route_combinations(ranked: DataFrame, k: int = 20) -> DataFrame:
    """The k commonest sets of routes."""
    combo = F.array_join(F.transform(F.split("routes", r"\|"), lambda r: F.regexp_replace(r, ":.*$", "")), "+")
    return ranked.groupBy(combo.alias("combination")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "combination").limit(k)
