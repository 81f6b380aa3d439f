"""Adapters of public benchmarks: questions, nodes and gold from their own shapes."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window


def safe_id(c: Column) -> Column:
    """Letters, digits, _ and - of an id, the rest as _, at most 120 characters."""
    return F.substring(F.regexp_replace(F.trim(c), r"[^0-9A-Za-z_\-]+", "_"), 1, 120)


def evidence_gold(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(question_id, gold): the nodes that a query's evidence names by URL, else by title, in order, each once.

    queries: (question_id, evidence: array<struct<url, title>>); corpus: (node_id, url, title). Of nodes with one URL or title the first counts."""
    first = lambda c: corpus.where(F.col(c).isNotNull() & (F.col(c) != "")).groupBy(c).agg(F.min("node_id").alias(f"by_{c}"))
    each = queries.select("question_id", F.posexplode("evidence").alias("pos", "e")).select("question_id", "pos", "e.url", "e.title")
    found = each.join(first("url"), "url", "left").join(first("title"), "title", "left").withColumn("node_id", F.coalesce("by_url", "by_title")).where("node_id is not null")
    once = found.groupBy("question_id", "node_id").agg(F.min("pos").alias("pos"))
    got = once.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id"))).alias("g")).select("question_id", F.transform("g", lambda x: x["node_id"]).alias("gold"))
    return queries.select("question_id").join(got, "question_id", "left").select("question_id", F.coalesce("gold", F.array().cast("array<bigint>")).alias("gold"))


def first_context(rows: DataFrame, key: str, order: str) -> DataFrame:
    """A node for each context, the first row in order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")


def qrels_gold(qrels: DataFrame, selected: DataFrame) -> DataFrame:
    """(question_id, gold): judged nodes with a positive score among the selected, sorted. qrels: (question_id, node_id, score)."""
    kept = qrels.where("score > 0").join(selected.select("node_id"), "node_id", "left_semi")
    return kept.groupBy("question_id").agg(F.array_sort(F.collect_set("node_id")).alias("gold"))
