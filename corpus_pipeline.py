"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing and sharding, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run() writes
each stage's rows to the shared folder and reads them back, so a stage's work is done once and survives lost executors.

SQL can't express the network of the first stage, so there is no oracle for the whole. The operators' own tests hold near-duplicates,
decontamination, mixing and sharding against brute force or SQL, and the network against plain Python.

Nulls, repeats and edge cases: a null text has no letter, so language_id rejects it; empty texts likewise. Rows with a null id stay
in every stage that decides by id; rows that repeat an id are each decided by their own text. Texts are read whole. Ties go to the
smaller id. Columns beyond those of documents pass through all stages but names that begin with __; an empty table passes as an empty table."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from dossier.llm import decontaminate, language, mixing, near_dedup, sharding
from dossier.llm.common import held_out, materialize, release, table

#: Documents whose language is less probable than this are rejected, and those without a letter.
LEAST_SCORE = 0.5
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose text is in one of the learned languages."""
    net = language.fit(docs, ~held_out(F.col("doc_id")))
    found = language.identify(docs, net, lang_out="__lang", score_out="__score")
    return found.where((F.col("__lang") != "und") & (F.col("__score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose sets of five-word shingles are linked by similarities of 0.8 and more. Documents without words are copies of nothing and stay."""
    return near_dedup.drop_near_duplicates(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to the sources' target weights takes it."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard (0 to 23) and slot."""
    return sharding.shard(docs, 24)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("sharding", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents: the mixed documents with shard and slot."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        done = materialize(stage(spark, docs, sf_dir), name)
        if i:
            release(docs)
        docs = done
    return docs
