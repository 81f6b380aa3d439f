"""The queries op1 to op10 with their production parameters: each derives the columns of its contract from the operator's output."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, language, media, mixing, near_dedup, sharding, toxicity, url_filter, warc
from .common import held_out, materialize, table, utf8


#: (host, path, action); the longest that fits wins.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg((F.min("quality") == 0).alias("low"))
    labelled = pages.join(labels, "page_id").select("url", "low")
    return url_filter.judge(pages, labelled, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "mined", F.round("confidence", 6).alias("confidence"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op3_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.describe(media.store(table(spark, sf_dir, "documents")))
    feature = F.concat_ws(" ", F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string")), "thumb_hash")
    return found.select(F.col("id").alias("doc_id"), "n_bytes", F.col("n_samples").alias("payload_bytes"), F.col("samples_sha256").alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = language.fit(docs.select("doc_id", "text", "lang"), ~held_out(F.col("doc_id")))
    return language.identify(docs.select("doc_id", "text"), net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket, order = sharding.row_keys(F.col("doc_id"), F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(utf8(F.col("text"))).cast("long") + 8).alias("size"), F.crc32(utf8(F.col("text"))).alias("text_crc32"), F.lit("rows").alias("law"), bucket.alias("bucket"), order.alias("order"))
    return sharding.shard(rows, 24, id_col="doc_id", bucket="bucket", order="order").select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "start", "similarity")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (-7L, 0L, 'user'), (-7L, 1L, 'assistant') AS t(conv_id, turn, role)")
    messages = materialize(chat.reply_chains(rows.unionByName(extra)), "messages")
    done = chat.format_paths(chat.best_paths(messages), messages)
    turns, learned = chat.parse(F.col("formatted")), chat.learned_text(F.col("formatted"), F.col("mask"))
    back = done.select(F.col("tree.conv_id").alias("conv_id"), turns.alias("turns"), learned.alias("learned"), "formatted")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic")
    model = toxicity.fit(docs, labels, ~held_out(F.col("id")))
    return toxicity.score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.rewrite(table(spark, sf_dir, "pages").select("page_id", "url", "html"), min_bytes=100).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_minhash_near_dedup, op3_pareto_mixing, op4_media_columns, op5_language_id, op6_feistel_sharding, op7_decontamination, op8_chat_formatting, op9_toxicity, op10_warc_revisits)}
