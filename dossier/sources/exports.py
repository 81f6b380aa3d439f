"""Sinks of results: an overview, a JSON document for each question, and chains as Markdown."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from dossier.functions.text import clean_text, preview

# What roles are called.
ROLE_LABELS = {"main_evidence": "主证据", "explicit_reference": "显式编号证据", "table_or_figure": "图表节点", "caption": "图注/表题", "context_text": "上下文解释", "graph_neighbor": "图关系补充", "visual_companion": "视觉伴随证据"}


def write_overview(df: DataFrame, path: str) -> None:
    """All columns as CSV with a header; nothing for an empty table."""
    if not df.isEmpty():
        df.write.option("header", True).option("escape", '"').csv(path)


def question_json(df: DataFrame) -> DataFrame:
    """(question_id, json): a question's row as a JSON document."""
    return df.select("question_id", F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_questions(df: DataFrame, path: str, buckets: int = 64) -> None:
    """JSON lines in folders by a hash of the question, so that folders do not grow with the questions."""
    df.withColumn("bucket", F.pmod(F.xxhash64("question_id"), F.lit(buckets))).repartition("bucket").write.partitionBy("bucket").json(path)


def chain_markdown(chains: DataFrame) -> DataFrame:
    """(question_id, markdown): each chain with its question, summary and steps.

    chains: (question_id, question_type, question, summary, steps: array of struct<chain_step, role, node_id, node_type, page, relation, reason, crop_image_path, visual_summary, content_preview>)."""
    labels = F.create_map(*[F.lit(x) for kv in ROLE_LABELS.items() for x in kv])
    s = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    line = lambda head, c: F.when(clean_text(c) != "", F.concat(F.lit(head), c, F.lit("\n"))).otherwise("")

    def step(x: Column) -> Column:
        head = F.concat(s(x["chain_step"]), F.lit(". **"), F.coalesce(labels[x["role"]], s(x["role"])), F.lit("** `"), s(x["node_id"]), F.lit("` ("), s(x["node_type"]), F.lit(", p."), s(x["page"]), F.lit(") - "), s(x["relation"]), F.lit("\n\n"))
        return F.concat(head, F.lit("   - 原因: "), s(x["reason"]), F.lit("\n"), line("   - 视觉裁剪: ", s(x["crop_image_path"])), line("   - 视觉摘要: ", preview(s(x["visual_summary"]), 260)), F.lit("   - 证据: "), s(x["content_preview"]), F.lit("\n\n"))

    head = F.concat(F.lit("## "), s(F.col("question_id")), F.lit(" | "), s(F.col("question_type")), F.lit("\n\n**问题**: "), s(F.col("question")), F.lit("\n\n**链路摘要**: "), s(F.col("summary")), F.lit("\n\n"))
    return chains.select("question_id", F.concat(head, F.array_join(F.transform("steps", step), "")).alias("markdown"))


def write_markdown(df: DataFrame, path: str) -> None:
    """Text files of the chains, in the order of the questions."""
    df.orderBy("question_id").select(F.col("markdown").alias("value")).write.text(path)
