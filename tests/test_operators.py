"""Operators on small cases worked out by hand."""

import re

import pyspark.sql.functions as F
import pytest

from dossier.functions import text as T
from dossier.operators import answers, chains, chunking, fusion, knowledge, retrieval, structure
from dossier.sources import tables as S


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("Straße DDR4-x a/b.", ["strasse", "ddr4-x", "a/b"]),
        ("cables gas", ["cables", "cable", "gas"]),
        ("空调机安装步骤", ["空", "调", "机", "安", "装", "步", "骤", "空调", "调机", "机安", "安装", "装步", "步骤", "空调机", "调机安", "机安装", "安装步", "装步骤"]),
        ("表格", ["表格", "表", "格", "表格"]),
        (None, []),
        ("", []),
    ],
)
def test_tokens(spark, text, tokens):
    assert one(spark, T.bm25_tokens, text) == tokens


def test_text_functions(spark):
    assert one(spark, T.clean_text, " a\t\tb\n\n\n\nc ") == "a b\n\nc"
    assert one(spark, T.clean_text, None) == ""
    assert one(spark, lambda c: T.preview(c, 5), "abcdefgh") == "abcd..."
    assert one(spark, T.split_multi, "a; b，c| ") == ["a", "b", "c"]
    assert one(spark, T.split_ints, "p3; 12, x, p3") == [3, 12]
    assert one(spark, T.as_float, "x") == 0.0
    assert one(spark, T.doc_name, "dir/My file (1).v2.pdf") == "My_file__1_v2"
    assert one(spark, T.document_refs, "F i g u r e 2 and table S1a, 图3") == ["figure:2", "figure:3", "table:s1"]
    assert one(spark, T.is_toc_entry, "Intro ..... 3")
    assert one(spark, T.source_context, "p/1/figure_2") == "p/1"
    assert re.search(T.term_pattern("cash flow"), "the cash  flows rose")
    assert not re.search(T.term_pattern("table"), "stable")


def test_chunks_keep_all_sentences(spark):
    text = "One two. " * 30 + "x" * 250 + ". End here."
    got = one(spark, lambda c: chunking.sentence_chunks(c, 100), text)
    assert all(len(c) <= 100 for c in got)
    assert "".join(got).replace(" ", "") == text.replace(" ", "")
    assert one(spark, lambda c: chunking.sentence_chunks(c, 100), "") == []
    assert one(spark, lambda c: chunking.sentence_chunks(c, 100), "short") == ["short"]


def test_min_max(spark):
    rows = [("a", 1.0), ("a", 3.0), ("b", 0.0), ("b", 0.0), ("c", 2.0)]
    got = spark.createDataFrame(rows, "q string, score double").select("q", fusion.min_max(F.col("score"), "q").alias("s")).collect()
    assert sorted((r["q"], r["s"]) for r in got) == [("a", 0.0), ("a", 1.0), ("b", 0.0), ("b", 0.0), ("c", 1.0)]


def test_scope_falls_back(spark):
    scores = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.9), (2, 10, 0.1)], "question_id long, node_id long, score double")
    docs = spark.createDataFrame([(10, "x"), (11, "y")], "node_id long, doc_id string")
    scopes = spark.createDataFrame([(1, "x"), (2, "z")], "question_id long, scope string")
    got = retrieval.scoped_top_k(scores, docs, scopes, 5).select("question_id", "node_id").collect()
    assert sorted(map(tuple, got)) == [(1, 10), (2, 10)]


def test_pagerank_sums_to_one_and_converges(spark):
    links = spark.createDataFrame([(1, a, b, 1.0) for a, b in ("xy", "yx", "yz", "zy", "zx", "xz")], "question_id long, x string, y string, weight double")
    seeds = spark.createDataFrame([(1, "x", 1.0), (1, "alone", 1.0)], "question_id long, node_id string, weight double")
    got = {r["node_id"]: r["score"] for r in structure.pagerank(links, seeds, rounds=60).collect()}
    assert abs(sum(got.values()) - 1) < 1e-6
    assert got["x"] > got["y"]
    assert abs(got["y"] - got["z"]) < 1e-6


def test_edges_dedup_is_idempotent(spark):
    e = spark.createDataFrame([("b", "a", "t", 0.1), ("a", "b", "t", 0.2), ("a", "b", "u", 0.5)], "source_id string, target_id string, edge_type string, weight double")
    once = structure.dedup(e)
    assert sorted(map(tuple, once.collect())) == [("a", "b", "t", 0.3), ("a", "b", "u", 0.5)]
    assert sorted(map(tuple, structure.dedup(once).collect())) == sorted(map(tuple, once.collect()))


def test_text_references(spark):
    nodes = spark.createDataFrame([("d", "t1", "text", ["table:1"]), ("d", "tb", "table", ["table:1"]), ("d", "c", "caption", ["table:1"])], "doc_id string, node_id string, node_type string, refs array<string>")
    got = {(r["source_id"], r["target_id"]) for r in structure.text_references(nodes).where("source_id <> target_id").collect()}
    assert got == {("t1", "tb"), ("t1", "c"), ("c", "tb")}


def test_terms_of_references_and_cjk(spark):
    texts = {
        1: "空气净化器的滤网，见图 3和表S2a。滤网",
        2: "如何安全地清洁滤网组件",
        3: "See Fig. 2, figure 2 and Table 1-4b; the Motor，motor",
        4: "使用Motor功能",
        5: "the and",
    }
    df = spark.createDataFrame([(k, 1, "s", v) for k, v in texts.items()], "node_id long, doc_id long, section string, content string")
    got = {(r["node_id"], r["term"]): (r["n"], r["place"]) for r in knowledge.node_terms(df, 40).collect()}
    of = lambda k: {t: n for (i, t), (n, _) in got.items() if i == k}
    long = "空气净化器的滤网"
    grams = {long[i : i + k]: 1 for k in (2, 3, 4) for i in range(len(long) - k + 1)}
    assert of(1) == grams | {"figure 3": 4, "table S2a": 4, "见图": 2, "和表": 2, "滤网": 3}
    run = texts[2]
    assert of(2) == {run[i : i + k]: 1 for k in (2, 3, 4) for i in range(len(run) - k + 1)}
    assert of(3) == {"figure 2": 8, "table 1-4b": 4, "See Fig": 2, "Motor": 2, "motor": 1}
    assert of(4) == {"使用": 2, "功能": 2}
    assert not of(5)
    assert got[1, "table S2a"][1] == 1 and got[1, "figure 3"][1] == 2
    nodes = df.withColumn("page", F.lit(1)).withColumn("node_type", F.lit("text"))
    terms = knowledge.node_terms(nodes)
    assert {"part:滤网", "part:figure 3"} <= {r["entity_id"] for r in knowledge.entities(terms).collect()}
    assert knowledge.relations(terms).where("relation_type = 'concept_cooccurs' and source_id = 'part:使用' and target_id = 'part:功能'").count() == 1
    assert {"figure 3", "使用"} <= set(knowledge.communities(nodes, terms).first()["top_terms"].split("|"))


def test_answers(spark):
    rows = [("a", "who", "The motor drives a pump quietly here; see below now.\nUnicorns dance over purple mountains nightly forever.", "the motor drives a pump quietly here")]
    got = answers.correct(spark.createDataFrame(rows, "answer_id string, question string, answer string, evidence string")).first()
    assert got["status"] == "corrected"
    assert "Unicorns" not in got["answer"]


def test_verifier_and_choice(spark):
    base = {"question_id": 1, "wants_table": True, "wants_figure": False, "wants_cross": False, "kinds": ["text"], "top_kind": "text", "grounded": False, "n_rows": 5, "n_steps": 4, "n_related": 3, "sim": 0.9, "chain": 0.8, "visual": 0.5, "routes": 4, "margin": 0.2}
    schema = "question_id long, wants_table boolean, wants_figure boolean, wants_cross boolean, kinds array<string>, top_kind string, grounded boolean, n_rows int, n_steps int, n_related int, sim double, chain double, visual double, routes int, margin double"
    bad = chains.verify(spark.createDataFrame([base], schema)).first()
    good = chains.verify(spark.createDataFrame([base | {"kinds": ["text", "table"], "top_kind": "table"}], schema)).first()
    assert "missing_table" in bad["flags"] and bad["needs_correction"]
    assert good["flags"] == [] and not good["needs_correction"] and good["score"] > bad["score"]
    pair = spark.createDataFrame([(bad["score"], good["score"], bad["flags"], good["flags"])], "p_score double, f_score double, p_flags array<string>, f_flags array<string>")
    assert chains.choose(pair).first()["source"] in ("merge", "fallback")
    steps = "array<struct<node_id: string, node_type: string>>"
    rows = spark.createDataFrame([([("a", "text"), ("b", "text"), ("c", "text"), ("d", "text"), ("e", "text")], [("a", "text"), ("t", "table"), ("f", "figure")], ["table"])], f"p {steps}, f {steps}, need array<string>")
    got = rows.select(chains.merge(F.col("p"), F.col("f"), F.col("need")).alias("m")).first()["m"]
    assert [s["node_id"] for s in got] == ["a", "b", "c", "d", "t"]


def test_sources(spark, tmp_path):
    assert S.read_jsonl(spark, str(tmp_path / "none")).count() == 0
    nodes = S.read_jsonl(spark, str(tmp_path / "none"))
    S.write_jsonl(nodes, str(tmp_path / "nodes"))
    (tmp_path / "q.csv").write_text('﻿question_id,question\n1,"a ""b"", c"\n', encoding="utf-8")
    got = S.read_csv(spark, str(tmp_path / "q.csv")).first()
    assert (got["question_id"], got["question"], got["doc_id"]) == ("1", 'a "b", c', None)
    rows = spark.createDataFrame([("k", 1), ("k", 2)], "key string, n int")
    assert S.first_wins(rows, "key", "n").first()["n"] == 1
    assert S.last_wins(rows, "key", "n").first()["n"] == 2
