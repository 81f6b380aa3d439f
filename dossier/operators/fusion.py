"""Fusion of routes: long tables (question_id, route, node_id, score) to one score for each question and node."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window


def min_max(score: Column, *by: str) -> Column:
    """A score between the least and the greatest of its group as 0 to 1; if all are alike, 0 for zeros and else 1."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    alike = F.abs(high - low) <= 1e-9 * F.greatest(F.abs(high), F.abs(low))
    return F.when(alike, F.when(high == 0, 0.0).otherwise(1.0)).otherwise((score - low) / (high - low))


def rrf(routes: DataFrame, weights: dict[str, float], k: int = 60, half: float = 0.5) -> DataFrame:
    """(question_id, node_id, score): weight / (k + rank) * (half + (1 - half) * normalised score), summed over routes, normalised.

    Scores are normalised over the nodes that any route has for the question, missing ones being 0."""
    keys = routes.select("question_id", "node_id").distinct()
    names = routes.select("question_id", "route").distinct()
    full = keys.join(names, "question_id").join(routes, ["question_id", "route", "node_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    full = full.withColumn("s", min_max(F.col("score"), "question_id", "route"))
    rank = F.row_number().over(Window.partitionBy("question_id", "route").orderBy(F.desc("s"), "node_id"))
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("route")), F.lit(0.5))
    part = F.when(F.col("s") > 0, weight / (k + F.col("rank")) * (half + (1 - half) * F.col("s"))).otherwise(0.0)
    summed = full.withColumn("rank", rank).groupBy("question_id", "node_id").agg(F.sum(part).alias("raw"))
    return summed.select("question_id", "node_id", min_max(F.col("raw"), "question_id").alias("score"))


def multiroute(routes: DataFrame, weights: dict[str, float], limit: int = 80, k: int = 50) -> DataFrame:
    """(question_id, node_id, score, routes): the first `limit` of each route at weight / (k + rank) * (.35 + .65 * score), with bonuses for agreement and the routes' names and ranks."""
    scored = routes.where("score > 0").withColumn("s", min_max(F.col("score"), "question_id", "route"))
    rank = F.row_number().over(Window.partitionBy("question_id", "route").orderBy(F.desc("s"), "node_id"))
    kept = scored.withColumn("rank", rank).where(F.col("rank") <= limit)
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("route")), F.lit(0.5))
    part = weight / (k + F.col("rank")) * (0.35 + 0.65 * F.col("s"))
    got = kept.groupBy("question_id", "node_id").agg(F.sum(part).alias("raw"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.concat_ws(":", "route", F.col("rank").cast("string")))).alias("names"))
    has = lambda r: F.exists("names", lambda x: x.startswith(f"{r}:"))
    base = min_max(F.col("raw"), "question_id")
    bonus = F.least(F.lit(0.08), 0.018 * (F.col("n") - 1)) + F.when(has("embedding") & has("bm25"), 0.018).otherwise(0.0)
    out = got.withColumn("base", base).withColumn("boosted", F.col("base") + bonus)
    return out.select("question_id", "node_id", min_max(F.col("boosted"), "question_id").alias("score"), F.array_join("names", "|").alias("routes"))


def anchor(fused: DataFrame, bm25: DataFrame, weight: float = 0.38) -> DataFrame:
    """Fused scores drawn towards the normalised BM25 score of the same nodes."""
    both = fused.join(bm25.select("question_id", "node_id", F.col("score").alias("b")), ["question_id", "node_id"], "left").withColumn("b", F.coalesce("b", F.lit(0.0)))
    drawn = both.withColumn("b", min_max(F.col("b"), "question_id")).withColumn("x", (1 - weight) * F.col("score") + weight * F.col("b"))
    return drawn.select("question_id", "node_id", min_max(F.col("x"), "question_id").alias("score"))


def hybrid(embedding: DataFrame, lexical: DataFrame, alpha: float = 0.7) -> DataFrame:
    """alpha * normalised embedding score + (1 - alpha) * normalised lexical score, over the nodes of both."""
    both = embedding.select("question_id", "node_id", F.col("score").alias("e")).join(lexical.select("question_id", "node_id", F.col("score").alias("l")), ["question_id", "node_id"], "full")
    both = both.select("question_id", "node_id", F.coalesce("e", F.lit(0.0)).alias("e"), F.coalesce("l", F.lit(0.0)).alias("l"))
    both = both.withColumn("en", min_max(F.col("e"), "question_id")).withColumn("ln", min_max(F.col("l"), "question_id"))
    return both.select("question_id", "node_id", (alpha * F.col("en") + (1 - alpha) * F.col("ln")).alias("score"))
