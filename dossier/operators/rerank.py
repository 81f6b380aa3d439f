"""Reranking of candidates (question_id, node_id, score): context expansion, answer priors, and smoothing of table and text pairs."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from dossier.functions.lexicon import VISUAL_TYPES
from dossier.functions.text import is_toc_entry
from dossier.operators.fusion import min_max


def _map(d: dict[str, float], key: Column, default: float) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), key), F.lit(default))


def expand_context(candidates: DataFrame, nodes: DataFrame, k: int, seeds: int = 14, neighbours: int = 8, wants_visual: bool = False) -> DataFrame:
    """(question_id, node_id, score, rank): candidates with companions of their section and page, the best k.

    Each of the first seeds lends its score to up to `neighbours` nodes, by relation, distance and kind; a node keeps its greatest score."""
    by_score = Window.partitionBy("question_id").orderBy(F.desc("score"), "node_pos")
    placed = candidates.join(nodes.select("node_id", "doc_id", "section", "page", "node_type", "node_pos"), "node_id")
    seed = placed.withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= seeds)
    lent = F.when(F.col("score") > 0, F.col("score")).otherwise(F.greatest(F.lit(0.01), 1.0 / (F.col("r") + 3.0)))
    seed = seed.select("question_id", F.col("node_id").alias("seed"), "doc_id", "section", "page", F.col("node_type").alias("kind"), F.col("node_pos").alias("at"), lent.alias("lent"))
    other = nodes.where(~is_toc_entry(F.col("content"))).select("node_id", "doc_id", "section", "page", "node_type", "node_pos")
    by_section = seed.drop("page").join(other.drop("page"), ["doc_id", "section"]).where("section <> ''").withColumn("base", F.lit(0.82))
    by_page = seed.drop("section").join(other.drop("section"), ["doc_id", "page"]).withColumn("base", F.lit(0.62))
    both = by_section.drop("section").unionByName(by_page.drop("page")).where("seed <> node_id")
    visual = F.col("node_type").isin(*VISUAL_TYPES)
    base = F.col("base") + F.when(visual, 0.12).otherwise(0.0) + F.when(F.col("kind").isin(*VISUAL_TYPES) & (F.col("node_type") == "text"), 0.05).otherwise(0.0)
    base = F.least(F.lit(1.0), base * F.when(F.col("node_type") == "page", 0.35).otherwise(1.0))
    near = 0.75 + 0.25 / F.sqrt(1.0 + F.least(F.abs(F.col("at") - F.col("node_pos")), F.lit(24)))
    value = F.round(F.col("lent") * base * near * F.when(visual, 1.08 if wants_visual else 1.0).otherwise(0.92), 9)
    best = both.withColumn("value", value).groupBy("question_id", "seed", "node_id", "node_pos").agg(F.max("value").alias("value"))
    kept = best.withColumn("r", F.row_number().over(Window.partitionBy("question_id", "seed").orderBy(F.desc("value"), "node_pos"))).where(F.col("r") <= neighbours)
    every = kept.select("question_id", "node_id", "node_pos", F.col("value").alias("score")).unionByName(placed.select("question_id", "node_id", "node_pos", "score"))
    merged = every.groupBy("question_id", "node_id", "node_pos").agg(F.max("score").alias("score"))
    return merged.withColumn("rank", F.row_number().over(by_score).cast("long")).where(F.col("rank") <= k).drop("node_pos")


def reference_weight(node_type: Column, has_table: Column) -> Column:
    """What a node that a question refers to is worth, by its kind."""
    table = _map({"table": 0.9, "caption": 0.95, "text": 0.75, "page": 0.1, "figure": 0.1}, node_type, 0.2)
    return F.when(has_table, table).otherwise(_map({"figure": 1.0, "caption": 0.95, "text": 0.75, "page": 0.1, "table": 0.1}, node_type, 0.2))


def answer_prior(node_type: Column, visual: Column, structured: Column, after_sales: Column, captioned: Column) -> Column:
    seen = F.when(structured, F.when(node_type == "table", 1.08).when(node_type == "caption", 0.86).otherwise(0.66)).when(visual, F.when(captioned, 1.02).otherwise(0.92)).otherwise(0.72)
    is_visual = node_type.isin(*VISUAL_TYPES)
    prior = F.when(node_type == "title", 0.72).when(node_type == "page", 0.42).when(node_type == "text", 1.08).when(is_visual, seen).otherwise(1.0)
    return prior * F.when(after_sales & is_visual, 0.55).otherwise(1.0)


def smooth_pairs(scores: DataFrame, nodes: DataFrame) -> DataFrame:
    """Scores of tables and texts of one group drawn towards the group's best: max(s, .72 s + .28 best)."""
    group = F.regexp_replace("node_id", "(?i)_(?:table|text|caption|figure|page)$", "")
    placed = scores.join(nodes.select("node_id", "node_type"), "node_id").withColumn("g", group).withColumn("s", min_max(F.col("score"), "question_id"))
    w = Window.partitionBy("question_id", "g")
    pair = F.max((F.col("node_type") == "table").cast("int")).over(w) + F.max((F.col("node_type") == "text").cast("int")).over(w) == 2
    drawn = F.when(pair, F.greatest(F.col("s"), 0.72 * F.col("s") + 0.28 * F.max("s").over(w))).otherwise(F.col("s"))
    out = placed.withColumn("d", drawn)
    return out.select("question_id", "node_id", min_max(F.col("d"), "question_id").alias("score"))
