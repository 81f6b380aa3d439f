"""Scans and sinks with explicit schemas, and evidence nodes from document tables.

A missing path is an empty table. JSON lines keep null keys out; CSV files are all strings, with a header, quotes doubled."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from dossier.functions.text import node_id

#: Core columns of evidence nodes, and the optional ones that later stages add.
NODE_SCHEMA = "node_id string, doc_id string, page int, node_type string, content string, source_ref string, section string, parent_chunk_id string, previous_node_id string, next_node_id string, chunk_order int, bbox string, page_height double, explicit_refs string, visual_summary string, visual_caption string, crop_image_path string, page_image_path string, structure_type string"
QUESTION_SCHEMA = "question_id string, doc_id string, question string, answer string, question_type string, gold_node_ids string, gold_pages string, gold_modalities string, evidence_note string"
EDGE_SCHEMA = "source_id string, target_id string, edge_type string, weight double"


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether any file or folder fits the path, which may hold patterns, in whatever store it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def read_jsonl(spark: SparkSession, path: str, schema: str = NODE_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path) if _exists(spark, path) else _empty(spark, schema)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def read_csv(spark: SparkSession, path: str, schema: str = QUESTION_SCHEMA) -> DataFrame:
    """All columns as strings, chosen by name; a byte-order mark before the first name is dropped, columns that a file lacks are null."""
    if not _exists(spark, path):
        return _empty(spark, schema)
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    names = [f.split()[0] for f in schema.split(", ")]
    return raw.select(*[F.col(n) if n in raw.columns else F.lit(None).cast("string").alias(n) for n in names])


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    df.select(*fields).write.option("header", True).option("escape", '"').csv(path)


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the first in order: the rule of the vector and caption caches."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the last in order: the rule of the answer cache, of routes and of repeated node ids."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__n = 1").drop("__n")


def document_nodes(documents: DataFrame, lines_per_page: int = 10, titles: bool = False) -> DataFrame:
    """A node for each line of each document: the first is its title, lines with a | are table rows, the rest text; pages have ten lines, sections are the sources. With `titles` each has its document's."""
    title = [F.substring_index("text", "\n", 1).alias("title")] if titles else []
    lines = documents.where("text is not null").select("doc_id", F.col("source").alias("section"), *title, F.posexplode(F.split("text", "\n")).alias("line", "content"))
    kind = F.when(F.col("line") == 0, "title").when(F.contains(F.col("content"), F.lit("|")), "table").otherwise("text")
    out = lines.withColumn("node_type", kind).withColumn("page", (F.floor(F.col("line") / lines_per_page) + 1).cast("int"))
    id_ = node_id(F.col("node_type"), F.col("doc_id").cast("string"), F.col("page").cast("string"), (F.col("line") % lines_per_page + 1).cast("string"))
    return out.select(id_.alias("node_id"), "doc_id", "page", "node_type", "section", F.col("line").alias("node_pos"), "content", *(["title"] if titles else []))
