"""The pipeline's stages keep what they should, and their decisions take effect."""

from collections import Counter

import pyspark.sql.functions as F
import pytest

import corpus_pipeline
from dossier.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_eleven_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, seen, DATA).persist()
        if name != "sharding":
            assert after.columns == docs.columns
        if name == "near_duplicates":
            assert after.count() == after.select("text").distinct().count()
        if name == "decontamination":
            assert after.where(F.contains("text", F.lit(item))).count() == 0
            assert after.count() >= 0.7 * docs.count()
        seen = after
    rows = seen.collect()
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) <= set(range(24))
    assert max(sizes.values()) - min(sizes.get(i, 0) for i in range(24)) <= 1
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)


@pytest.mark.parametrize("k", range(5))
def test_empty_tables(spark, k):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0).withColumn("extra", F.lit(1))
    assert corpus_pipeline.STAGES[k][1](spark, docs, DATA).count() == 0
