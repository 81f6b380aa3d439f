"""Routes by names, answers from chains, content lists and reports on cases worked out by hand."""

import json

import pyspark.sql.functions as F

from dossier.operators import answers, evaluate, expansion, signals
from dossier.operators import knowledge_route as K
from dossier.operators.questions import after_sales, intents
from dossier.sources import content, exports


def asked(spark, rows):
    return after_sales(intents(spark.createDataFrame([(i, q, "") for i, q in rows], "question_id string, question string, question_type string")))


def scores(df):
    return {(r["question_id"], r["node_id"]): r["score"] for r in df.collect()}


def test_names_are_whole_words_but_for_ideographs(spark):
    texts = spark.createDataFrame([("a", "the e-reader of c++ and acme"), ("b", "空调如何安装"), ("c", "")], "text_id string, text string")
    names = spark.createDataFrame([(n, n) for n in ("e-reader", "reader", "ac", "c++", "空调", "装", "")], "name_id string, name string")
    assert sorted((r["text_id"], r["name_id"]) for r in K.name_hits(texts, names).collect()) == [("a", "c++"), ("a", "e-reader"), ("a", "reader"), ("b", "空调"), ("b", "装")]


def test_product_scores(spark):
    nodes = [("q", "n1", "dishwasher_manual", "", "", "text", "dishwasher door", ""), ("q", "n2", "x", "Dishwasher care", "", "figure", "a dishwasher", "seen"), ("q", "n3", "x", None, None, "text", "oven", ""), ("r", "n4", "x", "", "", "text", "dishwasher", "")]
    pairs = spark.createDataFrame(nodes, "question_id string, node_id string, doc_id string, section string, source_ref string, node_type string, text_product string, text_visual string")
    got = scores(K.product_scores(pairs, spark.createDataFrame([("q", "how to clean the dishwasher"), ("r", "why")], "question_id string, blob string"), K.product_groups(spark)))
    # An underscore is no letter, so that the file's name counts.
    assert got == {("q", "n1"): 0.84, ("q", "n2"): 0.74, ("q", "n3"): 0.0, ("r", "n4"): 0.0}


def test_graph_scores(spark):
    entities = spark.createDataFrame([("pump", "water pump", ["pump"], "product"), ("seal", "seal", None, "part"), ("fix", "replace", ["use"], "action"), ("use", "use", None, "action"), ("img", "seal", [], "image"), ("pol", "保修维修", ["warranty"], "policy")], "entity_id string, name string, aliases array<string>, entity_type string")
    asks = asked(spark, [("q", "replace the seal of the pump, use it"), ("w", "is it under warranty repair"), ("n", "use it")])
    context = K.query_context(asks, entities)
    assert sorted((r["question_id"], r["entity_id"], r["kind"]) for r in context.collect()) == [("q", "fix", "action"), ("q", "pump", "concrete"), ("q", "seal", "concrete"), ("w", "pol", "policy")]
    links = spark.createDataFrame([("a", "pump"), ("a", "seal"), ("a", "fix"), ("b", "seal"), ("p", "pol"), ("m", "pol")], "node_id string, entity_id string")
    edges = spark.createDataFrame([("pump", "seal", "product_has_part", "a"), ("fix", "seal", "action_targets_part", "b"), ("img", "seal", "image_depicts_part", "f")], "source_id string, target_id string, relation_type string, evidence_node_id string")
    nodes = [(q, n, t, s, c) for q in ("q", "w", "n") for n, t, s, c in (("a", "text", "", False), ("b", "text", "manual_profile", False), ("f", "figure", None, True), ("p", "text", "after_sales_policy", False), ("m", "text", "", False))]
    got = scores(K.graph_scores(spark.createDataFrame(nodes, "question_id string, node_id string, node_type string, structure_type string, captioned boolean"), context, links, edges))
    assert {k: v for k, v in got.items() if v} == {("q", "a"): 1.0, ("q", "b"): 0.64, ("q", "f"): 0.34, ("w", "p"): 1.0, ("w", "m"): 0.45}


def test_after_sales_scores(spark):
    pairs = spark.createDataFrame([("q", "a", "title", "after_sales_policy", "", "refund manual"), ("q", "b", "text", "", "", "zzz"), ("n", "c", "title", "", "", "refund")], "question_id string, node_id string, node_type string, structure_type string, paper_domain string, text_after_sales string")
    got = scores(signals.after_sales_scores(pairs, asked(spark, [("q", "can I get a refund"), ("n", "who wrote it")])))
    assert got[("n", "c")] == 0.0 and got[("q", "b")] == 0.0
    assert got[("q", "a")] > 0.12 + 0.12 + 0.04 + 0.25 * 0.53


def test_expansion(spark):
    rows = [("1", "", "manual", "boat", "安装", "售后", "sail; anchor light", 1), ("", "x-2", "", "raft", "", "售后，退款", "", 2), ("1", "", "service", "", "", "售后", "", 3), ("", "", "service", "", "", "", "", 4), ("5", "", "", "", "", "售后", None, 5)]
    routes = expansion.keyed(spark.createDataFrame(rows, "submission_id string, question_id string, route string, product string, question_type string, service_terms string, matched_aliases string, pos int"), "pos")
    got = {r["question_id"]: r for r in expansion.expand(spark.createDataFrame([("q1", " how "), ("q2", "why"), ("q3", "what"), ("q5", "who ")], "question_id string, question string"), routes).collect()}
    assert got["q1"]["expanded"].startswith("how\nSearch context: route=service; intent aliases=after-sales policy") and got["q1"]["expanded"].endswith(" | service_term=售后; after-sales customer service handling procedure responsibility proof")
    assert got["q2"]["expanded"] == "why\nSearch context: product=raft | service_term=售后; after-sales customer service handling procedure responsibility proof | service_term=退款; refund return eligibility proof processing"
    assert (got["q3"]["expanded"], got["q5"]["expanded"], got["q5"]["route_name"]) == ("what", "who ", "")


def chains(spark, steps, question="what is it"):
    step = lambda i, kind, said: (f"n{i}", kind, i, said, "", "", "", "")
    return spark.createDataFrame([("q", question, "", [step(i, k, t) for i, (k, t) in enumerate(steps, 1)])], f"question_id string, question string, summary string, steps array<{answers.STEP}>")


def test_answers(spark):
    say = lambda df: answers.extractive(df).first()["fallback"]
    some = [("text", "One."), ("table", "Two"), ("text", ""), ("figure", "One.")]
    assert say(chains(spark, some)) == "Based on the evidence chain, One.; Two <PIC:n2> <PIC:n4>. Sources: [E1] [E2] [E4]"
    assert say(chains(spark, some, "这是什么")) == "根据证据链，One；Two <PIC:n2> <PIC:n4>。证据来源：[E1] [E2] [E4]"
    assert say(chains(spark, [])) == answers.UNSURE[False] and say(chains(spark, [("text", "")], "这是什么")) == answers.UNSURE[True]
    told = answers.evidence_metadata(chains(spark, some)).first()
    assert (told["evidence_node_ids"], told["evidence_modalities"], told["evidence_count"], told["visual_evidence_count"]) == ("n1;n2;n3;n4", "text;table;figure", 4, 2)
    assert told["citations"].startswith("[E1] n1 (text, p.1) | [E2] n2 (table, p.2)")
    fresh = answers.generate(chains(spark, some))
    first = fresh.first()
    assert first["status"].startswith("fallback")
    cache = fresh.select("cache_key", F.lit("Two things, One and Two, are said by One and by Two.").alias("answer"), F.lit("").alias("status"))
    assert answers.generate(chains(spark, some), cache).first()["status"].startswith("cached")
    assert answers.generate(chains(spark, some), provider="m", answer=F.lit("")).first()["status"].startswith("empty_fallback")
    local = chains(spark, some).select(answers.local_answer(F.col("question"), F.col("steps")).alias("x")).first()["x"]
    assert local == "The answer is grounded in the top evidence: One.. Supporting evidence: [E1] page 1 text: One.; [E2] page 2 table: Two."


def test_content_lists(spark, tmp_path):
    pages = [{"page": 4, "blocks": [{"type": "Image-Body", "img_path": "i/a.png", "image_caption": ["Fig 1", {"text": "x"}]}, 3]}, {"blocks": [{"type": "text", "text": "F1 1 2 3"}, {"label": "title", "text": "T"}]}]
    rows = [("a", json.dumps({"content_list": [], "pages": pages}), "/d/l.json"), ("b", json.dumps([[{"text": "Table 2: x"}], [{"content": {"rows": 1}, "page_idx": 0}]]), ""), ("c", "no json", ""), ("e", None, None), ("f", json.dumps([{"page_no": 2, "type": "table", "path": "HTTP://x/y"}]), "")]
    got = [(r["doc_id"], r["page"], r["node_type"], r["content"], r["node_id"]) for r in content.content_nodes(spark.createDataFrame(rows, "doc_id string, text string, path string")).orderBy("doc_id", "pos").collect()]
    assert got == [("a", 5, "figure", "Fig 1\nx\nImage path: /d/i/a.png", "F_a_5_1"), ("a", 2, "table", "F1 1 2 3", "TB_a_2_1"), ("a", 2, "title", "T", "H_a_2_1"), ("b", 1, "caption", "Table 2: x", "C_b_1_1"), ("b", 1, "text", '{"rows": 1}', "T_b_1_1"), ("f", 2, "table", "Image path: HTTP://x/y", "TB_f_2_1")]
    for name in ("one/my_doc_content_list.json", "two/other.json"):
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text(rows[0][1])
    assert content.find_content_list(spark, str(tmp_path), "my doc.pdf").endswith("one/my_doc_content_list.json")
    assert content.find_content_list(spark, str(tmp_path), "else").endswith("one/my_doc_content_list.json")
    assert content.read_content_lists(spark, str(tmp_path / "one")).first()["doc_id"] == "my_doc"
    manual = [(0, "My file.pdf", "", "", "", "x"), (1, None, "2", "table", None, "y"), (2, "b", "1", "text", "own", "z"), (3, "b", "1", "text", "", "z")]
    made = content.manual_nodes(spark.createDataFrame(manual, "pos int, doc_id string, page string, node_type string, node_id string, content string")).orderBy("pos").collect()
    assert [r["node_id"] for r in made] == ["T_My_file_1_1", "TB_manual_2_1", "own", "T_b_1_3"]


def test_reports_and_exports(spark, tmp_path):
    questions = spark.createDataFrame([("q", "", "see the chart", "a", ""), ("r", "", "why", "a", ""), ("s", "", "why", None, "")], "question_id string, question_type string, question string, answer string, gold_modalities string")
    steps = [(q, "text", "c.png", True, "", p) for q in "qr" for p in (3, 1, 2)]
    cards = spark.createDataFrame([("q", 1920, 1080, True), ("r", 1920, 1080, True)], "question_id string, width int, height int, nonblank boolean")
    got = {r["question_id"]: r for r in evaluate.card_checks(questions, spark.createDataFrame(steps, "question_id string, node_type string, crop_image_path string, crop_exists boolean, visual_caption string, page int"), cards).collect()}
    assert [got[q]["status"] for q in "qrs"] == ["warn", "pass", "fail"] and got["r"]["source_pages"] == "1;2;3"
    assert got["q"]["issues"] == "visual_required_without_visual_node;visual_required_without_caption"
    kinds = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "", 2), (1, "", 3), (2, "", 0)], "doc_id int, kind string, pos int")
    assert {r["doc_id"]: r["kind"] for r in evaluate.most_common(kinds, "doc_id", "kind", "pos").collect()} == {1: "b", 2: "unknown"}
    step = "struct<chain_step: int, role: string, node_id: string, node_type: string, page: int, relation: string, reason: string, crop_image_path: string, visual_summary: string, content_preview: string>"
    told = exports.chain_markdown(spark.createDataFrame([("q", "t", "why", "s", [(1, "caption", "n", "text", 2, "r", "w", "", None, "e")])], f"question_id string, question_type string, question string, summary string, steps array<{step}>"))
    assert told.first()["markdown"] == "## q | t\n\n**问题**: why\n\n**链路摘要**: s\n\n1. **图注/表题** `n` (text, p.2) - r\n\n   - 原因: w\n   - 证据: e\n\n"
    exports.write_questions(exports.question_json(cards), str(tmp_path / "j"), 4)
    assert spark.read.json(str(tmp_path / "j")).count() == 2
