"""Plans whose rows or memory would grow faster than their tables, and the results of what they do instead."""

import contextlib
import io
import tracemalloc

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F

from dossier.functions import text as T
from dossier.operators import knowledge
from dossier.operators import knowledge_route as K
from dossier.operators import retrieval, signals, sparse
from dossier.plans import catalog


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


def test_texts_meet_names_without_broadcast(spark):
    # Names that begin alike meet a text only if it holds the first five tokens of each.
    names = spark.createDataFrame([(n, n) for n in ("water", "water pump", "water pump seal", "water pump of the old well", "water pump of the new well", "water p", "-x", "c++", "a空调b c", "空调")], "name_id string, name string")
    texts = spark.createDataFrame([("a", "the water pump of the old well"), ("b", "water-pump a-x"), ("e", "c++ -x"), ("f", "c++x"), ("c", "xa空调b cd"), ("d", "")], "text_id string, text string")
    got = K.name_hits(texts, names)
    assert sorted((r["text_id"], r["name_id"]) for r in got.collect()) == [("a", "water"), ("a", "water pump"), ("a", "water pump of the old well"), ("b", "water"), ("c", "a空调b c"), ("c", "空调"), ("e", "-x"), ("e", "c++")]
    assert "BroadcastHashJoin" not in plan(got)


def test_context_and_relations_are_not_broadcast(spark):
    pairs = spark.createDataFrame([("q", "a", "text", "", False)], "question_id string, node_id string, node_type string, structure_type string, captioned boolean")
    context = spark.createDataFrame([("q", "pump", "concrete")], "question_id string, entity_id string, kind string")
    links = spark.createDataFrame([("a", "pump")], "node_id string, entity_id string")
    edges = spark.createDataFrame([("pump", "seal", "product_has_part", "a")], "source_id string, target_id string, relation_type string, evidence_node_id string")
    got = K.graph_scores(pairs, context, links, edges)
    assert got.first()["score"] == 0.46
    assert "BroadcastHashJoin" not in plan(got)


def test_local_lexical_makes_no_row_for_each_run(spark, monkeypatch):
    monkeypatch.setattr(signals, "CHARACTERS", 20)
    rows = [(q, f"{q}{i}", "pump seal", t) for q in ("a", "b", "c") for i, t in enumerate(("pump seal", "zzz", "", "pump", "a seal of a pump"))]
    df = spark.createDataFrame(rows, "question_id string, node_id string, question string, text string")
    got = signals.local_lexical(df)
    score = {r["node_id"]: r["score"] for r in got.collect()}
    assert len(score) == 15 and "Generate" not in plan(got)
    for q in ("a", "b", "c"):
        assert (score[f"{q}0"], score[f"{q}1"], score[f"{q}2"]) == (1.0, 0.0, 0.0)
        assert 0 < score[f"{q}4"] < 1 and score[f"{q}3"] == score["a3"]


def test_nearest_holds_a_bounded_number_of_products():
    rng = np.random.default_rng(1)
    v, q = rng.normal(size=(6000, 8)), rng.normal(size=(1000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(6000)), pa.FixedSizeListArray.from_arrays(v.ravel(), 8).cast(pa.list_(pa.float64()))], ["vec_id", "embedding"])
    tracemalloc.start()
    got = next(retrieval.nearest(np.arange(1000), retrieval.unit(q), 3)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    best = np.argsort(-(retrieval.unit(q) @ retrieval.unit(v).T), axis=1)[:, :3]
    # 48 MB for one table of all products, of which several are needed at once.
    assert peak < 100e6 and (got.column(1).to_numpy().reshape(1000, 3) == best).all()


def test_bigrams_are_compared_without_lambdas_and_by_pieces(spark, monkeypatch):
    monkeypatch.setattr(T, "CHARACTERS", 8)
    rows = [("", ""), ("", "a"), ("a", "a"), ("a", "aa"), ("abc", "bcd"), ("aaaa", "aa"), ("\U0001f600b", "\U0001f600b\U0001f600b"), ("x" * 50, "x" * 40 + "y"), (None, "a")]
    got = T.bigram_jaccard(pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.string())).to_pylist()
    assert got == [1.0, 0.0, 1.0, 0.0, 1 / 3, 1.0, 0.5, 0.5, None]
    assert T.bigram_jaccard(pa.array([], pa.string()), pa.array([], pa.string())).to_pylist() == []
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string").select("i", T.char_jaccard(F.col("a"), F.col("b")).alias("j"))
    assert [r["j"] for r in df.orderBy("i").collect()] == got and "lambda" not in plan(df)


def test_titles_come_without_a_shuffle_of_texts(spark, tmp_path):
    spark.createDataFrame([(1, "a b\nc", "s"), (2, "x", "s"), (3, "\ny", "s"), (4, None, "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.titled(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["title"], r["content"]) for r in got.collect()) == [(1, "a b", "a b"), (1, "a b", "c"), (2, "x", "x"), (3, "", ""), (3, "", "y")]
    assert "Exchange" not in plan(got) and "Exchange" not in plan(catalog.char_jaccard(spark, str(tmp_path)))


def test_terms_are_counted_by_pieces(spark, monkeypatch):
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(97, 123, 8000))) for _ in range(1000)] + [None, "", "a", "ab"]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))), pa.array(texts)], ["node_id", "x"])
    tracemalloc.start()
    got = sparse.added([(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in sparse.counter(sparse.gram_terms, None)(iter([batch]))])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 192 MB for one table of the runs of all texts, of which several were needed at once.
    assert peak < 180e6
    grams = {g for n in (2, 3, 4) for g in (texts[0][i : i + n] for i in range(len(texts[0]) - n + 1))}
    assert len(sparse.counted(*sparse.gram_terms(batch.column(1).slice(0, 1)))[1]) == len(grams) and got[1].max() > 999
    assert sum(sparse.gram_terms(pa.array([None, "", "a"]))[1]) == 0


def test_scores_by_table_and_by_index_are_alike(monkeypatch):
    rng = np.random.default_rng(2)
    q, v = 30, 50
    question, term = (x.ravel() for x in np.meshgrid(np.arange(q), np.arange(v), indexing="ij"))
    there = rng.random(len(term)) < 0.5
    vocabulary, begin, asked, weight = sparse.inverted(question[there], term[there], rng.random(int(there.sum())))
    row, place, _ = sparse.distinct(np.repeat(np.arange(40), 20), rng.integers(0, len(vocabulary), 800))
    w, many = rng.random(len(row)), begin[place + 1] - begin[place]
    table = np.zeros((len(vocabulary), q))
    table[np.repeat(np.arange(len(vocabulary)), np.diff(begin)), asked] = weight
    monkeypatch.setattr(sparse, "CELLS", 70)
    monkeypatch.setattr(sparse, "PRODUCTS", 90)
    by_table, by_index = sparse.by_table(row, place, w, 40, table), sparse.by_index(row, place, w, many, 40, q, begin, asked, weight)
    assert by_table.shape == (40, q) and np.allclose(by_table, by_index) and by_table.max() > 0


def test_walks_of_many_graphs_run_side_by_side(spark, monkeypatch):
    monkeypatch.setattr(signals, "LINKS", 4)
    rng = np.random.default_rng(3)
    links = [(q, f"n{a}", f"n{b}", float(w)) for q in range(12) for a, b, w in zip(rng.integers(0, 6, 8), rng.integers(0, 6, 8), rng.random(8) + 0.1, strict=True)]
    seeds = [(q, f"n{i}", 0.0 if q == 3 else float(i)) for q in range(13) for i in range(3)]
    l = spark.createDataFrame(links, "question_id long, x string, y string, weight double")
    s = spark.createDataFrame(seeds, "question_id long, node_id string, weight double")
    for rounds in (5, 400):
        got = {(r["question_id"], r["node_id"]): r["score"] for r in signals.walk(l, s, rounds=rounds, tolerance=0.0 if rounds == 5 else 1e-14).collect()}
        want = {}
        for q in range(13):
            own, given = [x[1:] for x in links if x[0] == q], {x[1]: x[2] for x in seeds if x[0] == q}
            names = sorted({n for x in own for n in x[:2]} | set(given))
            total = sum(given.values())
            start = {n: (given.get(n, 0) / total if total else (n in given) / len(given)) for n in names}
            score = dict.fromkeys(names, 1 / len(names))
            out = {n: sum(w for a, _, w in own if a == n) for n in names}
            for _ in range(rounds):
                lost = sum(score[n] for n in names if not out[n])
                score = {n: 0.85 * (sum(score[a] * w / out[a] for a, b, w in own if b == n) + lost * start[n]) + 0.15 * start[n] for n in names}
            want |= {(q, n): v for n, v in score.items()}
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
    text = plan(signals.walk(l, s))
    assert "FlatMapGroupsInPandas" not in text and text.count("Exchange") == 1


def test_the_ranker_reads_its_inputs_once(spark, tmp_path, monkeypatch):
    words = "pump seal water filter of the old well a | b | c | 1"
    text = "\n".join(f"{words[i:]} {i}" for i in range(0, 30, 2))
    spark.createDataFrame([(i, text, "s", "en") for i in range(4)], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    made, own = [], catalog.structure.settle
    monkeypatch.setattr(catalog.structure, "settle", lambda df, name: made.append(name) or own(df, name))
    got = catalog.QUERIES["g_methods_rank"](spark, str(tmp_path))
    assert {"candidates", "traits", "graph", "plans", "signals"} <= set(made) and got.count() == 4 * 5 * 5
    # The ranker's plan reads settled tables, no documents.
    assert "documents.parquet" not in "".join(got.inputFiles())
    made.clear()
    assert catalog.QUERIES["evidence_chain"](spark, str(tmp_path)).count() > 4 and made.count("graph") == 1


def test_pairs_meet_terms_in_one_map(spark):
    terms = ("pump", "pump,", "-x", "c++", "water pump", "空调", "a空", "ße", "...", "o'clock")
    texts = ("water pump, c++", "pumps c++x", "x-x a-x", "a空调b", "water  pump", "...", "a...b", "it is o'clock", "o'clocks o'clock2 o'clock", "", None)
    own = K.Terms()
    for t in terms:
        own.add(t, t)
    pairs = spark.createDataFrame([(x, t) for x in texts for t in terms], "x string, t string").where(F.coalesce(K.holds(F.col("x"), F.col("t")), F.lit(False)))
    want = {}
    for r in pairs.collect():
        want.setdefault(r["x"], set()).add(r["t"])
    assert {x: own.groups(x) for x in texts if own.groups(x)} == want
    runs = K.text_runs("water pump, c++ x")
    keys = frozenset(("water pump", "c++", "pump", ", c", "x", "pump, c+"))
    assert ("water pump", True) in runs and ("+", False) in runs and ("pump, c", True) in runs and {r for r in runs if r[0] in keys} == K.text_runs("water pump, c++ x", keys, K.key_sizes(keys))
    nodes = [("q", n, "d", "", "", "figure", t, "seen") for n, t in (("a", "a pump"), ("a", "no"), ("b", "no"))] + [(None, "c", "d", "", "", "text", "a pump", ""), ("r", "d", "d", "", "", "text", "a pump", "")]
    df = spark.createDataFrame(nodes, "question_id string, node_id string, doc_id string, section string, source_ref string, node_type string, text_product string, text_visual string")
    got = K.product_scores(df, spark.createDataFrame([("q", "the pump"), (None, "the pump")], "question_id string, blob string"), spark.createDataFrame([("pump", ["pump"])], "canonical string, terms array<string>"))
    assert sorted((r["node_id"], r["score"]) for r in got.collect()) == [("a", 0.32), ("b", 0.06), ("c", 0.0), ("d", 0.0)]
    # One join, of runs with names, at most; none of pairs with terms, whose search was a lambda over each pair's.
    assert "lambda" not in plan(got) and plan(got).count("Join") <= 1


def test_cleaning_looks_for_what_it_replaces(spark):
    rows = ["a  b", "a\tb", " \t\x0b\f\r\na\n\n\n\nb\x00c　 \x85 ", "᠎a​", "  x\xa0", "\n", None, "a b"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, a string").select("i", T.clean_text(F.col("a")).alias("c"))
    assert [r["c"] for r in df.orderBy("i").collect()] == ["a b", "a b", "a\n\nb c", "᠎a​", "x", "", "", "a b"]
    assert "[ \\t" not in plan(df)


def test_scoped_questions_keep_the_best_of_each_task(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(12)]
    nodes = [(i, " ".join(["all", *rng.choice(words, 6)]), [None, "a", "b", "c"][i % 4]) for i in range(300)]
    # All nodes share one term; no node shares zzz, none is in the scope d, and the last question has no scope.
    asks = [(1, "w1 w2 w2", "a"), (2, "w3 all", "b"), (3, "all", "c"), (4, "zzz", "a"), (5, "w5 w6", "d"), (6, "w7 all", None)]
    n = spark.createDataFrame(nodes, "node_id long, text string, doc_id string").repartition(5)
    q = spark.createDataFrame(asks, "question_id long, text string, scope string")
    scores = retrieval.bm25(n, q).withColumn("score", F.round("score", 6))
    rows = lambda df: sorted((r["question_id"], r["rank"], r["node_id"], r["score"]) for r in df.collect())
    got = sparse.bm25_scoped(n, q, 5)
    want = rows(retrieval.scoped_top_k(scores, n.select("node_id", "doc_id"), q.select("question_id", "scope"), 5))
    assert rows(got) == want and {r[0] for r in want} == {1, 2, 3, 5, 6}
    # No row for each pair of a question and a node: what is shuffled are the best of tasks.
    assert "Join" not in plan(got) and "Generate" not in plan(got)


def test_terms_are_counted_by_node_in_a_map(spark, monkeypatch):
    monkeypatch.setattr(knowledge, "HELD", 4)
    rows = [("a", 1, "s", "The Pump and the pump; the Pump seal of Table 2"), ("b", 1, "s", "größe Größe Zähler with pumps 空调"), ("c", 2, None, "the and 12"), ("d", 2, "s", None)]
    # An id that two rows have is one node, whose twelve terms are of both; rows without an id too.
    rows += [("e", 3, "s", " / ".join(f"word{i}x" for i in range(10))), ("e", 4, "t", " / ".join(f"longer{i}x" for i in range(10))), (None, 5, "s", "pump"), (None, 5, "s", "pump")]
    df = spark.createDataFrame(rows, "node_id string, doc_id long, section string, content string").repartition(3)
    made = knowledge.node_terms(df)
    got = {(r["node_id"], r["place"]): (r["doc_id"], r["term"], r["n"]) for r in made.collect()}
    assert got["a", 1][1:] == ("table 2", 4) and got["a", 2][1:] == ("Pump seal", 2) and got["a", 3][1:] == ("The Pump", 2)
    assert sum(k[0] == "e" for k in got) == 12 and sum(k[0] == "e" and v[0] == 4 for k, v in got.items()) == 10
    assert got[None, 1] == (5, "pump", 2) and not [k for k in got if k[0] in ("c", "d")]
    assert [got["b", i][1] for i in (1,)] == ["空调"] and ("b", 2) in got and all("hler" not in v[1] and "gr" not in v[1].lower() for v in got.values())
    assert "Window" not in plan(made) and "HashAggregate" not in plan(made)
    plain = spark.createDataFrame([("Pump seal x1 a-b-c of the old well, S2 \n 12ab Ab_c C++ abcd\x1cefgh",)], "t string").select(F.regexp_extract_all("t", F.lit(knowledge._PLAIN), F.lit(0)).alias("p"), F.regexp_extract_all("t", F.lit(knowledge._LATIN), F.lit(0)).alias("l")).first()
    assert plain["p"] == plain["l"] and len(plain["p"]) > 3


def test_entities_are_counted_where_their_documents_stand(spark, tmp_path, monkeypatch):
    rows = [(1, "The Pump and the pump\nPump seal of Table 2 | a\n\nWeb", "web"), (2, "größe pumps 空调\npump", "Web"), (3, "the and", "web"), (4, None, "web"), (5, "", None), (None, "a pump\nPump", "web"), (None, "pump", "web"), (6, "pump  seal\x00Pump", "")]
    # Lines that two texts of an id have at the same place are one node, whose terms and sources are of both.
    rows += [(7, " / ".join(f"word{i}x" for i in range(10)), "Web"), (7, " / ".join(f"longer{i}x" for i in range(10)), "web"), (7, "x\npump", "S"), (7, "x\npump | seal", "S")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want = sorted(map(str, knowledge.entities(knowledge.node_terms(catalog.document_nodes(documents))).collect()))
    got = {r["entity_id"]: tuple(r)[2:] for r in knowledge.document_entities(documents).collect()}
    assert sorted(map(str, knowledge.document_entities(documents).collect())) == want
    assert got["part:pump"] == (6, 4, 6) and got["product:1"] == (3, 1, 3) and got["product:7"] == (3, 1, 3) and "product:3" not in got
    # A section counts once a node, however it is spelt; what a line says and its source are one entity.
    assert got["part:web"] == (8, 4, 9) and got["part:s"] == (2, 1, 2)
    # What a task holds between is bounded, and gives the same sums.
    counts = lambda batches: [len(b) for b in knowledge.counted(12)(iter(batches))]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 2, 3], "name": ["1", "2", "2", "3"], "source": ["web"] * 4, "lower": ["web"] * 4, "text": [b"pump seal", b"pump\nseal", b"pump\nseal", b"seal"]})
    assert counts([batch.slice(0, 2), batch.slice(2)]) == [7]
    monkeypatch.setattr(knowledge, "ENTITIES", 2)
    assert counts([batch.slice(0, 2), batch.slice(2)]) == [3, 4, 3]
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    query = plan(catalog.QUERIES["entities"](spark, str(tmp_path)))
    # Texts and the sums of entities are shuffled once each: no row for a line or a term, nothing written between or read again.
    assert query.count("Exchange") == 2 and query.count("Scan") == 1 and "Generate" not in query and "Union" not in query


def test_terms_are_found_as_by_the_patterns(spark):
    bits = ("Pump", "seal", "with", "The", "C++", "a-b-c", "Ab_c", "größe", "xé", "éxyz", "élan", "fig", "Fig.", "fıg 3", "TABLE 7", "表", "見图", "使用", "3", "S2a", "ſ3", "3K", "３", "𝒜bcd", "abc𝟛", "😀abcd", "½abcd", " ", "　", "\x85", "\x1c", "\x0b", "\x00", "  ", "-", "_", "|", "İst", "Kelvin", "á")
    rng = np.random.default_rng(5)
    texts = sorted({"".join(x + rng.choice(["", " "]) for x in rng.choice(bits, rng.integers(1, 6))) for _ in range(4000)})
    said = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.clean_text(F.col("t")).alias("c"))
    rows = said.select("t", "c", F.regexp_extract_all("c", F.lit(knowledge._LATIN), F.lit(0)).alias("l")).collect()
    assert all(knowledge.cleaned(r["t"]) == r["c"] and (knowledge._plain if r["c"].isascii() else knowledge._latin)(r["c"]) == r["l"] for r in rows)
    assert sum(bool(r["l"]) for r in rows) > 1000
    assert knowledge.text_terms("Fig. 3ſ, taBLE\xa0S2-1 and 图３") == {"figure ": 4, "table S2-1": 4, "figure ３": 4, "Fig": 2, "S2-1": 2}
