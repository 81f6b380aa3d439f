"""Queries of the library's operators over the driver's tables. Each is a plan over whole tables.

Questions are the texts of benchmark items; the corpus has a node for each document; structure queries use a node
for each line. Vectors stand for the documents of the same id."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from dossier.functions import blocks, node_texts
from dossier.functions import lexicon as L
from dossier.functions import text as T
from dossier.operators import ablation, answers, chains, chunking, evaluate, expansion, fusion, knowledge, knowledge_route, layout, planning, questions, rerank, retrieval, signals, sparse, structure, tables
from dossier.operators import routes as routes_of
from dossier.sources import benchmarks, content
from dossier.sources.tables import document_nodes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
WEIGHTS = {"bm25": 1.7, "lexical": 1.12, "embedding": 0.7}
#: Kinds of evidence that languages stand for, where a query needs some.
KINDS = {"en": "text", "fr": "table", "de": "figure", "es": "caption"}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), F.coalesce("text", F.lit("")).alias("text"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.coalesce("text", F.lit("")).alias("text"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_nodes(read(spark, sf_dir, "documents"))


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the title of their document, which comes with its row and needs no shuffle of texts."""
    return document_nodes(read(spark, sf_dir, "documents"), titles=True)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumn("score", F.round("score", digits))


def bm25_best(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return sparse.bm25_topk(corpus(spark, sf_dir), asked(spark, sf_dir), k)


def lexical_best(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return sparse.gram_topk(corpus(spark, sf_dir), asked(spark, sf_dir), k)


def vector_scores(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))
    return rounded(retrieval.embedding_topk(vectors, vectors.join(items, "vec_id", "left_semi"), k))


def routes(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    """(question_id, route, node_id, score): the k best of three routes."""
    got = (("bm25", bm25_best(spark, sf_dir, k)), ("lexical", lexical_best(spark, sf_dir, k)), ("embedding", vector_scores(spark, sf_dir, k)))
    out = None
    for name, df in got:
        part = df.where("score > 0").select("question_id", F.lit(name).alias("route"), "node_id", "score")
        out = part if out is None else out.unionByName(part)
    # A few rows for each question, which the fusion reads several times.
    return structure.settle(out, "routes")


@query
def bm25_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = corpus(spark, sf_dir).select("node_id", T.bm25_tokens(F.col("text")).alias("t"))
    return t.select("node_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("chars"))


@query
def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    out = retrieval.document_frequencies(retrieval.postings(docs, "node_id", T.bm25_tokens(F.col("text"))), docs.count())
    return out.select("term", "df", F.round("idf", 4).alias("idf"))


@query
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_best(spark, sf_dir, 10).select("question_id", "rank", "node_id", "score")


@query
def tfidf_char_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_best(spark, sf_dir, 10).select("question_id", "rank", "node_id", "score")


@query
def char_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's title against the line."""
    return titled(spark, sf_dir).select("node_id", F.round(T.char_jaccard(F.col("title"), F.col("content")), 4).alias("jaccard"))


@query
def embedding_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all vectors."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return retrieval.embedding_topk(v, v.where("vec_id % 20 = 0"), 10).select("question_id", "rank", "node_id", F.round("score", 6).alias("score"))


@query
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fusion.hybrid(vector_scores(spark, sf_dir, 50), lexical_best(spark, sf_dir, 50))
    return retrieval.top_k(rounded(out), 10).select("question_id", "rank", "node_id", "score")


@query
def minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes(spark, sf_dir).select("question_id", "route", "node_id", F.round(fusion.min_max(F.col("score"), "question_id", "route"), 4).alias("score"))


@query
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top_k(rounded(fusion.rrf(routes(spark, sf_dir), WEIGHTS)), 10).select("question_id", "rank", "node_id", "score")


@query
def multiroute_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top_k(rounded(fusion.multiroute(routes(spark, sf_dir), WEIGHTS)), 10).select("question_id", "rank", "node_id", "score", "routes")


@query
def bm25_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = routes(spark, sf_dir)
    out = fusion.anchor(rounded(fusion.rrf(got, WEIGHTS)), got.where("route = 'bm25'"))
    return retrieval.top_k(rounded(out), 10).select("question_id", "rank", "node_id", "score")


@query
def doc_scoped_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions scoped to a source: the one of the document of the same id, or none that exists for every third."""
    docs = read(spark, sf_dir, "documents")
    scope = docs.select(F.col("doc_id").alias("question_id"), F.when(F.col("doc_id") % 3 == 0, "absent").otherwise(F.col("source")).alias("scope"))
    nodes = docs.select(F.col("doc_id").alias("node_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("source").alias("doc_id"))
    return sparse.bm25_scoped(nodes, asked(spark, sf_dir).join(scope, "question_id", "left"), 5).select("question_id", "rank", "node_id", "score")


@query
def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(read(spark, sf_dir, "documents"))


@query
def document_nodes_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("node_id", "doc_id", "page", "node_type", "section", "node_pos", F.length("content").alias("n_chars"))


@query
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaning, preview and splitting of every line."""
    c = F.col("content")
    return lines(spark, sf_dir).select("node_id", F.md5(T.clean_text(c).cast("binary")).alias("clean_md5"), T.preview(c, 60).alias("preview"), F.size(T.split_multi(c)).cast("long").alias("parts"), T.is_toc_entry(c).alias("toc"))


#: What is asked of each document, after its title.
ASKS = ("", "in the table?", "as shown in Figure 1", "compare the table and the chart of both", "on which page, 定位", "how do I return the dishwasher for a refund?", "what was net sales growth in 2019 in Table 2?", "what came before and after it")


def document_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each document: its title and one of ASKS."""
    ask = F.element_at(F.array(*map(F.lit, ASKS)), (F.pmod(F.col("doc_id"), F.lit(len(ASKS))) + 1).cast("int"))
    title = F.substring_index("text", "\n", 1)
    return read(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("question_id"), F.concat_ws(" ", title, ask).alias("question"), F.lit("").alias("question_type"), title.alias("title"))


def planned(spark: SparkSession, sf_dir: str, asked_of: DataFrame) -> DataFrame:
    plans = planning.query_plan(questions.understand(asked_of))
    return planning.anchor_weight(planning.g4_profile(planning.graph_multipliers(planning.graph_profile(plans))))


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a question, one for each route, and one of each document."""
    turns = read(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("question_id"), F.coalesce("text", F.lit("")).alias("question"), F.lit("").alias("question_type")).dropDuplicates()
    fixed = spark.sql(f"SELECT question_id, question, question_type FROM VALUES {QUESTION_FIXTURE} AS t(question_id, question, question_type)")
    own = document_questions(spark, sf_dir).select(F.concat(F.lit("d"), F.col("question_id").cast("string")).alias("question_id"), "question", "question_type")
    return turns.unionByName(fixed).unionByName(own)


@query
def document_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of the documents' questions and of fixed sentences."""
    rows = spark.sql("SELECT id, s FROM VALUES (-1L, 'See Figure 2 and fig. 3b'), (-2L, 'F i g u r e 12 beside T a b l e S1'), (-3L, '如图 4 和表2所示'), (-4L, 'Table of contents'), (-5L, 'Tables and figures'), (-6L, '') AS t(id, s)")
    rows = rows.unionByName(document_questions(spark, sf_dir).select(F.col("question_id").alias("id"), F.col("question").alias("s")))
    return rows.select("id", F.array_join(T.document_refs(F.col("s")), ";").alias("refs"))


@query
def query_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = planned(spark, sf_dir, said(spark, sf_dir))
    return out.select("question_id", "route", "profile", "has_refs", "context_expansion", "rerank_boost", "graph_boost", planning.plan_summary().alias("summary"), *[F.round(f"x_{r}", 4).alias(f"x_{r}") for r in planning.ROUTES])


@query
def route_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of routes by profile and plan, those of the precision profile, and how many nodes each route may bring."""
    out = planning.route_limits(planning.precision_weights(planning.route_weights(planned(spark, sf_dir, said(spark, sf_dir)))))
    return out.select("question_id", "bm25_anchor", *[F.col(f"{k}_{r}") for k in "wp" for r in planning.ROUTES], *[F.col(f"n_{r}") for r in planning.ROUTES])


@query
def graph_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kinds of nodes and relations are worth for each question, and the bounds of the ranker's weights."""
    out = planned(spark, sf_dir, said(spark, sf_dir))
    return out.select("question_id", "ppr_mult", "bridge_mult", "ref_mult", *[F.element_at("kind_weights", F.lit(k)).alias(f"kind_{k}") for k in planning.KINDS], *[F.element_at("relation_weights", F.lit(k)).alias(f"rel_{k}") for k in ("text_ref_table", "text_ref_figure", "table_caption", "figure_caption", "same_page", "belongs_to_page", "same_section", "chunk_sequence", "section_title")], *[c for c in out.columns if c.startswith("g4_")])


@query
def chunk_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.chunk_context(lines(spark, sf_dir))


@query
def margin_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.repeated_margins(lines(spark, sf_dir))


def _edge_query(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(lines(spark, sf_dir))

    QUERIES[name] = run


_edge_query("edges_same_page", structure.same_page)
_edge_query("edges_belongs_to_page", structure.belongs_to_page)
_edge_query("edges_chunk_sequence", structure.chunk_sequence)
_edge_query("edges_same_section", structure.same_section)
_edge_query("edges_section_title", structure.section_title)
_edge_query("edges_all", structure.all_edges)
_edge_query("graph_degree", lambda n: structure.degrees(structure.collapse(structure.all_edges(n))))
_edge_query("chunk_quality", structure.document_summary)

#: Five nodes of a page with boxes, a caption without one, and references.
_FIXTURE = """SELECT node_id, doc_id, page, node_type, content, bbox, page_height, refs FROM VALUES
 ('C_d_1_1', 'd', 1, 'caption', 'Figure 2: growth', array(10d, 300d, 200d, 320d), 800d, array('figure:2')),
 ('F_d_1_2', 'd', 1, 'figure', '', array(10d, 100d, 210d, 290d), 800d, array()),
 ('F_d_1_3', 'd', 1, 'figure', '', array(400d, 100d, 600d, 290d), 800d, array()),
 ('C_d_1_4', 'd', 1, 'caption', 'Table 1. sums', array(10d, 700d, 200d, 720d), 800d, array('table:1')),
 ('TB_d_1_5', 'd', 1, 'table', 'a | b', array(10d, 20d, 200d, 60d), 800d, array('table:1')),
 ('T_d_1_6', 'd', 1, 'text', 'see Table 1 and Figure 2', null, 800d, array('table:1', 'figure:2')),
 ('C_e_1_1', 'e', 1, 'caption', '图 1', null, null, array('figure:1')),
 ('F_e_1_2', 'e', 1, 'figure', '', array(1d, 1d, 5d, 5d), null, array('figure:1')) AS t(node_id, doc_id, page, node_type, content, bbox, page_height, refs)"""


@query
def edges_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.captions(spark.sql(_FIXTURE))


@query
def edges_text_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.dedup(structure.text_references(spark.sql(_FIXTURE)))


@query
def ppr_5_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rounds of PageRank over every document's graph, from its title."""
    nodes = lines(spark, sf_dir)
    graph = structure.both_ways(structure.collapse(structure.all_edges(nodes)))
    doc = F.split("x", "_")[1].cast("long").alias("question_id")
    seeds = nodes.where("node_type = 'title'").select(F.col("doc_id").alias("question_id"), "node_id", F.lit(1.0).alias("weight"))
    out = signals.walk(graph.select(doc, "x", "y", "weight"), seeds, rounds=5, tolerance=0.0)
    return out.select("question_id", "node_id", F.round("score", 5).alias("score"))


@query
def question_understanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a question, and one for each route."""
    said = read(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("question_id"), F.col("text").alias("question"), F.lit("").alias("question_type"))
    fixed = spark.sql(f"SELECT question_id, question, question_type FROM VALUES {QUESTION_FIXTURE} AS t(question_id, question, question_type)")
    out = questions.understand(said.unionByName(fixed))
    return out.select("question_id", "wants_table", "wants_figure", "wants_cross", "wants_location", "wants_visual", "structured", "hops", "has_product", "sales_score", "route")


QUESTION_FIXTURE = """('f1', 'What was net sales growth in 2019 in the table?', 'table_qa'), ('f2', 'Compare Apple and Google before the merger', 'x'),
 ('f3', 'How do I clean the dishwasher shown in the figure? manual', ''), ('f4', 'Can I return the air purifier for a refund?', ''),
 ('f5', 'Combine the table and the chart', ''), ('f6', 'Where on the page is the plot', ''), ('f7', 'Who wrote it', '文本事实'), ('f8', 'Who wrote it', ''), ('f9', '空调如何安装', ''), ('f10', 'setup', '')"""


@query
def embedding_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of two rankings of vectors, gold being the query's label: cosine, and the same ten by id."""
    return evaluate.ranking_metrics(_judged(spark, sf_dir))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    got = retrieval.embedding_topk(v, v.where("vec_id % 20 = 0"), 10).select("question_id", "node_id", "rank")
    by_id = F.row_number().over(Window.partitionBy("question_id").orderBy("node_id")).cast("long")
    both = got.select("question_id", "node_id", "rank", F.lit("cosine").alias("method")).unionByName(got.select("question_id", "node_id", by_id.alias("rank"), F.lit("by_id").alias("method")))
    ideal = v.groupBy("label").agg(F.count("*").alias("ideal"))
    ask = v.select(F.col("vec_id").alias("question_id"), F.col("label").alias("want")).join(ideal.withColumnRenamed("label", "want"), "want")
    return both.join(v.select(F.col("vec_id").alias("node_id"), "label"), "node_id").join(ask, "question_id").select("question_id", "method", "rank", (F.col("label") == F.col("want")).alias("relevant"), "ideal")


@query
def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.method_summary(evaluate.ranking_metrics(_judged(spark, sf_dir)))


@query
def method_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.compare_methods(evaluate.ranking_metrics(_judged(spark, sf_dir)), "by_id", "cosine")


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first one to six BM25 documents of each question as its chain."""
    got = bm25_best(spark, sf_dir, 6).where(F.col("rank") <= 1 + F.col("question_id") % 6)
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("lang"))
    rows = got.join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), kind.alias("kind")), "node_id")
    out = rows.groupBy("question_id").agg(F.collect_list("node_id").alias("nodes"), F.collect_list(F.col("node_id") % 7).alias("pages"), F.collect_list("kind").alias("kinds"), F.count_if(F.col("node_id") % 2 == 0).alias("grounded"), F.min_by("node_id", "rank").alias("top"))
    q = F.col("question_id")
    route = F.when(q % 3 == 0, "multihop_graph").when(q % 3 == 1, "cross_modal").otherwise("general_text")
    gold = F.when(q % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(F.array("top", "question_id")))
    return out.select("question_id", route.alias("route"), (q % 2 == 0).alias("visual_required"), "nodes", "pages", "kinds", "grounded", F.floor(F.size("nodes") / 2).alias("related"), gold.alias("gold_nodes"), F.array(q % 7).alias("gold_pages"), F.array(F.lit("text"), F.lit("table")).alias("gold_kinds"))


@query
def chain_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.chain_metrics(_chains(spark, sf_dir))


@query
def chain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.chain_summary(evaluate.chain_metrics(_chains(spark, sf_dir)))


def _runs(spark: SparkSession, sf_dir: str, best: DataFrame) -> DataFrame:
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("lang"))
    top = best.join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), kind.alias("kind")), "node_id")
    norm = fusion.min_max(F.col("score"), "question_id")
    out = top.withColumn("s", norm).groupBy("question_id").agg(F.collect_set("kind").alias("kinds"), F.min_by("kind", "rank").alias("top_kind"), F.count("*").alias("n_rows"), F.max("s").alias("sim"), (F.max(F.when(F.col("rank") == 1, F.col("s"))) - F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("s"))), F.lit(0.0))).alias("margin"), F.array_sort(F.collect_list(F.struct("rank", "node_id", "kind"))).alias("steps"))
    q = F.col("question_id")
    return out.select("*", (q % 3 == 0).alias("wants_table"), (q % 5 == 0).alias("wants_figure"), (q % 7 == 0).alias("wants_cross"), (q % 2 == 0).alias("grounded"), (q % 6).alias("n_steps"), F.floor((q % 6) / 2).alias("n_related"), ((q % 10) / 10).alias("chain"), F.lit(0.5).alias("visual"), (q % 4).alias("routes"))


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = chains.verify(_runs(spark, sf_dir, bm25_best(spark, sf_dir, 5))).select("question_id", F.col("score").alias("p_score"), F.col("flags").alias("p_flags"), F.col("steps").alias("p_steps"))
    f = chains.verify(_runs(spark, sf_dir, lexical_best(spark, sf_dir, 5))).select("question_id", F.col("score").alias("f_score"), F.col("flags").alias("f_flags"), F.col("steps").alias("f_steps"))
    return chains.choose(p.join(f, "question_id"))


@query
def verifier_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _decisions(spark, sf_dir)
    return out.select("question_id", "p_score", "f_score", F.array_join("p_flags", ";").alias("p_flags"), F.array_join("f_flags", ";").alias("f_flags"), "source")


@query
def chain_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 chains completed by steps of the lexical chains of the kinds that the verifier misses."""
    step = lambda c: F.transform(c, lambda s: F.struct(s["node_id"].alias("node_id"), s["kind"].alias("node_type")))
    needed = F.when(F.array_contains("p_flags", "missing_table"), F.array(F.lit("table"))).otherwise(F.array(F.lit("figure"), F.lit("caption")))
    out = _decisions(spark, sf_dir).withColumn("m", chains.merge(step(F.col("p_steps")), step(F.col("f_steps")), needed))
    return out.select("question_id", F.array_join(F.transform("m", lambda s: s["node_id"].cast("string")), ";").alias("nodes"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as answers to the turn before, the conversation's first turn being the evidence."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.coalesce(F.lag("text").over(w), F.lit("")).alias("question"), F.first("text").over(w).alias("evidence"), F.row_number().over(w).alias("n"))
    return rows.where("role = 'assistant'").select(F.concat_ws("-", "conv_id", "n").alias("answer_id"), "question", F.col("text").alias("answer"), "evidence")


@query
def answer_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.sentence_support(_answers(spark, sf_dir)).select("answer_id", "pos", "support", "n_terms")


@query
def answer_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.correct(_answers(spark, sf_dir)).select("answer_id", F.md5(F.col("answer").cast("binary")).alias("answer_md5"), "status", F.col("removed").cast("long").alias("removed"))


@query
def answer_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("answer_id", F.round(answers.lexical_overlap(F.col("question"), F.col("answer")), 4).alias("overlap"))


@query
def table_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table_shapes(tables.table_lines(read(spark, sf_dir, "documents")))


@query
def table_numeric_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.numeric_facts(tables.table_lines(read(spark, sf_dir, "documents")))


@query
def entity_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.node_terms(lines(spark, sf_dir)).select("node_id", "term", "n", F.col("place").cast("long").alias("place"))


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A few rows for each line, which three branches read.
    return structure.settle(knowledge.node_terms(lines(spark, sf_dir)), "terms")


@query
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.document_entities(read(spark, sf_dir, "documents"))


@query
def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.relations(_terms(spark, sf_dir))


@query
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = lines(spark, sf_dir)
    return knowledge.communities(nodes, knowledge.node_terms(nodes))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with what they name, and for table rows with three bars and more a caption."""
    caption = F.when((F.col("node_type") == "table") & (F.length("content") - F.length(F.replace("content", F.lit("|"), F.lit(""))) >= 3), F.col("content")).otherwise("")
    return signals.node_refs(lines(spark, sf_dir)).withColumn("visual_caption", caption)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's question with all its lines, by their likeness to its title."""
    return titled(spark, sf_dir).select(F.col("doc_id").alias("question_id"), "node_id", F.round(T.char_jaccard(F.col("title"), F.col("content")), 6).alias("sim"))


@query
def context_expansion_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten likest lines of each document, and their companions."""
    first = retrieval.top_k(_candidates(spark, sf_dir).withColumnRenamed("sim", "score"), 10).select("question_id", "node_id", "score")
    out = rerank.expand_context(first, lines(spark, sf_dir), 24)
    return out.select("question_id", "node_id", F.round("score", 6).alias("score"), "rank")


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.collapse(structure.all_edges(lines(spark, sf_dir)))


def _signals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every signal of the documents' candidates, the questions' plans and the graph."""
    plans = structure.settle(planned(spark, sf_dir, document_questions(spark, sf_dir)), "plans")
    # Each is read several times, and the texts are read for it once.
    cand, graph = structure.settle(_candidates(spark, sf_dir), "candidates"), structure.settle(_graph(spark, sf_dir), "graph")
    traits = ("node_id", "doc_id", "section", "page", "node_type", "node_pos", "refs", "visual_caption")
    nodes = structure.settle(_placed(spark, sf_dir).select(*traits, T.is_toc_entry(F.col("content")).alias("toc")), "traits")
    got = signals.graph_signals(cand, nodes, graph, plans)
    ppr = _walked(graph, cand).select("question_id", "node_id", F.round("score", 6).alias("ppr"))
    ref = signals.reference_scores(cand, nodes, graph, plans).withColumnRenamed("score", "ref")
    out = got.join(ppr, ["question_id", "node_id"], "left").join(ref, ["question_id", "node_id"]).withColumn("ppr", F.coalesce("ppr", F.lit(0.0)))
    return structure.settle(out, "signals"), plans, graph


def _walked(graph: DataFrame, candidates: DataFrame) -> DataFrame:
    links = structure.both_ways(graph).select(F.split("x", "_")[1].cast("long").alias("question_id"), "x", "y", "weight")
    return signals.walk(links, candidates.select("question_id", "node_id", F.col("sim").alias("weight")))


@query
def personalised_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk over each document's graph from its lines, as far as they are like its title, to its end."""
    return _walked(_graph(spark, sf_dir), _candidates(spark, sf_dir)).select("question_id", "node_id", F.round("score", 6).alias("score"))


@query
def graph_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridge, modality, visual grounding and chain coherence of every line."""
    plans = planned(spark, sf_dir, document_questions(spark, sf_dir))
    return signals.graph_signals(_candidates(spark, sf_dir), _placed(spark, sf_dir), _graph(spark, sf_dir), plans).drop("caption")


@query
def reference_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = planned(spark, sf_dir, document_questions(spark, sf_dir))
    return signals.reference_scores(_candidates(spark, sf_dir), _placed(spark, sf_dir), _graph(spark, sf_dir), plans)


@query
def local_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's question against its lines, fitted on these alone."""
    asks = document_questions(spark, sf_dir).select("question_id", "question")
    pairs = lines(spark, sf_dir).select(F.col("doc_id").alias("question_id"), "node_id", F.col("content").alias("text")).join(asks, "question_id")
    return signals.local_lexical(pairs)


@query
def g_methods_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G0 to G4: the five best lines of every document by each method, over all signals."""
    got, plans, _ = _signals(spark, sf_dir)
    return signals.rank_methods(got, plans, 5)


@query
def answer_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = lines(spark, sf_dir)
    q = F.col("doc_id")
    prior = rerank.answer_prior(F.col("node_type"), q % 2 == 0, q % 3 == 0, q % 5 == 0, q % 7 == 0)
    return nodes.select("node_id", F.round(prior, 4).alias("prior"))


@query
def layout_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's lines as blocks in two columns, every fifth across the page."""
    i = F.col("node_pos") % 10
    full = i % 5 == 4
    blocks = lines(spark, sf_dir).select("doc_id", "page", F.col("node_id").alias("block_id"), F.when(full | (i % 2 == 0), 0.0).otherwise(310.0).alias("x0"), (i * 50.0).alias("y0"), F.when(full | (i % 2 == 1), 600.0).otherwise(290.0).alias("x1"), (i * 50.0 + 40).alias("y1"), F.col("content").alias("text"), F.lit(600.0).alias("page_width"))
    return layout.reading_order(blocks)


@query
def ragbench_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold documents of questions from sentence keys such as 2b; all of them where no key tells."""
    rows = spark.sql("SELECT id, n, keys FROM VALUES (1L, 3, array('0a', '2b', '2c')), (2L, 2, array('x', '')), (3L, 4, array('9a', '1z')) AS t(id, n, keys)")
    found = F.filter(F.transform(F.filter("keys", lambda k: k.rlike("^[0-9]+[A-Za-z]")), lambda k: F.regexp_extract(k, "^([0-9]+)", 1).cast("int")), lambda i: i < F.col("n"))
    gold = F.array_sort(F.array_distinct(F.when(F.size(found) > 0, found).otherwise(F.sequence(F.lit(0), F.col("n") - 1))))
    return rows.select("id", F.array_join(F.transform(gold, lambda i: i.cast("string")), ";").alias("gold"))


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's title as a question to its lines, wants and traits by remainders of ids and positions."""
    q, p = F.col("doc_id"), F.col("node_pos")
    flags = {"wants_table": q % 2, "wants_figure": q % 3, "wants_cross": q % 5, "wants_location": q % 7, "wants_visual": q % 4, "structured": q % 11, "numeric": q % 13, "bbox": p % 2, "captioned": p % 3, "section_hit": p % 5, "has_headers": p % 4, "has_facts": p % 6, "has_numbers": p % 7, "page_image": p % 8, "crop_image": p % 9, "parsed": p % 10}
    return titled(spark, sf_dir).select(q.alias("question_id"), "node_id", "node_type", F.round(T.char_jaccard(F.col("title"), F.col("content")), 6).alias("lexical"), F.lit("").alias("structure_type"), *[(v == 0).alias(k) for k, v in flags.items()])


@query
def route_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(routes_of.all_routes(_flagged(spark, sf_dir)), 8)


@query
def domain_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = {"a": ("the", "and"), "b": ("der", "und"), "c": ("les", "que")}
    strong = {"a": ("that",), "b": ("nicht",), "c": ("pour",)}
    return routes_of.domain_scores(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")), words, strong)


@query
def evidence_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains from the ten best lines by G4, with their bridge and reference scores."""
    got, plans, graph = _signals(spark, sf_dir)
    best = signals.rank_methods(got, plans, 10).where("method = 'G4'")
    ranked = best.join(got.select("question_id", "node_id", "bridge", "ref"), ["question_id", "node_id"]).join(plans.select("question_id", "wants_visual"), "question_id")
    links = structure.both_ways(graph).withColumnRenamed("weight", "relation")
    return chains.build(ranked, lines(spark, sf_dir), links)


@query
def edges_enhanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context edges: a line's parent is its document's first, its source the page, with the number of a table row."""
    nodes = lines(spark, sf_dir)
    parent = F.first("node_id").over(Window.partitionBy("doc_id").orderBy("node_pos"))
    source = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("/p"), F.col("page").cast("string"), F.when(F.col("node_type") == "table", F.concat(F.lit("/table_"), (F.col("node_pos") + 1).cast("string"))).otherwise(""))
    return structure.enhanced_edges(nodes.withColumn("parent_chunk_id", parent).withColumn("source_ref", source))


@query
def table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table_text(tables.table_lines(read(spark, sf_dir, "documents"))).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").alias("n_chars"))


@query
def layout_block_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as blocks down a page, as wide as they are long: margins, page numbers, notes at the side; boxes through JSON."""
    i, wide = F.col("node_pos") % 10, F.least(F.lit(600.0), F.length("content") * 5.0)
    json = F.concat(F.lit("[0, "), (i * 80.0).cast("string"), F.lit(", "), wide.cast("string"), F.lit(", "), (i * 80.0 + F.length("content")).cast("string"), F.lit("]"))
    rows = lines(spark, sf_dir).withColumn("box", blocks.parse_box(json))
    w, h, c = F.lit(600.0), F.lit(800.0), F.col("content")
    return rows.select("node_id", F.round(blocks.area(F.col("box")), 3).alias("area"), blocks.in_margin(F.col("box"), h).alias("margin"), blocks.is_page_number(c).alias("page_number"), blocks.is_side_noise(F.col("box"), c, w, h).alias("side_noise"))


@query
def document_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around all lines of a page, and the median length of those that have any."""
    i = F.col("node_pos") % 10
    box = F.array((i % 3) * 10.0, i * 80.0, F.length("content") * 1.0, i * 80.0 + 40)
    return lines(spark, sf_dir).withColumn("box", box).groupBy("doc_id", "page").agg(*blocks.union_box(F.col("box")), blocks.median_positive(F.length("content")).alias("median_length"))


@query
def heading_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    return lines(spark, sf_dir).select("node_id", F.md5(blocks.heading_text(c).cast("binary")).alias("heading_md5"), F.md5(blocks.trim_tail(c).cast("binary")).alias("trimmed_md5"), blocks.mostly_english(c).alias("english"), blocks.looks_chinese(c).alias("chinese"))


@query
def question_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The online type of every question, what the self-correction takes it to want, and its submission."""
    wants = blocks.correction_wants(F.col("question"), F.col("question_type"))
    return said(spark, sf_dir).select("question_id", blocks.online_type(F.col("question")).alias("online_type"), blocks.submission_id(F.col("question_id")).alias("submission_id"), *[c.alias(f"wants_{k}") for k, c in wants.items()])


@query
def corpus_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: pages and nodes by kind, and the questions of the same id, of documents and questions both."""
    nodes = lines(spark, sf_dir).groupBy("doc_id").agg(F.max("page").alias("pages"), *[F.count_if(F.col("node_type") == t).alias(t) for t in ("title", "text", "table")])
    asks = read(spark, sf_dir, "benchmark").groupBy(F.col("item_id").alias("doc_id")).agg(F.count("*").alias("questions"))
    out = nodes.join(asks, "doc_id", "full")
    return out.select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pages", "title", "text", "table", "questions")])


@query
def multihop_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's evidence: the pages of its remainder, every second one named by its title only."""
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("node_id"), "url", title.alias("title"))
    step = F.struct(F.col("node_id").alias("pos"), F.struct(F.when(F.col("node_id") % 2 == 0, F.col("url")).alias("url"), "title").alias("e"))
    evidence = pages.groupBy((F.col("node_id") % 40).alias("question_id")).agg(F.transform(F.array_sort(F.collect_list(step)), lambda s: s["e"]).alias("evidence"))
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id")).join(evidence, "question_id", "left")
    out = benchmarks.evidence_gold(items, pages)
    return out.select("question_id", F.array_join(F.transform("gold", lambda g: g.cast("string")), ";").alias("gold"))


@query
def qrels_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as judgements: toxic documents of each quality, among those that are documents."""
    qrels = read(spark, sf_dir, "labels").select(F.col("quality").cast("long").alias("question_id"), F.col("doc_id").alias("node_id"), F.col("toxic").alias("score"))
    out = benchmarks.qrels_gold(qrels, read(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id")))
    return out.select("question_id", F.array_join(F.transform("gold", lambda g: g.cast("string")), ";").alias("gold"))


@query
def variant_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = lines(spark, sf_dir).withColumn("content", F.when(F.col("node_pos") % 3 == 0, F.concat("content", F.lit("\n\nVisual summary: a chart"))).otherwise(F.col("content"))).withColumn("visual_caption", F.lit("a chart"))
    out = ablation.variant(nodes, text_only=True, strip_visual=True)
    return out.select("node_id", "node_type", F.length("content").alias("n_chars"), F.col("visual_caption").isNull().alias("stripped"))


@query
def ablation_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablation.deltas(evaluate.method_summary(evaluate.ranking_metrics(_judged(spark, sf_dir))), "by_id", ("hit_at_1", "mrr", "ndcg_at_5"))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top_k(rounded(fusion.multiroute(routes(spark, sf_dir), WEIGHTS)), 10)


@query
def route_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablation.route_counts(_ranked(spark, sf_dir))


@query
def route_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablation.route_combinations(_ranked(spark, sf_dir))


@query
def table_text_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table and a text of each document, scored by remainders of its length, for its source as the question."""
    docs = read(spark, sf_dir, "documents").where("doc_id is not null")
    each = F.explode(F.array(F.struct(F.lit("table").alias("kind"), (F.col("n_chars") % 97).alias("score")), F.struct(F.lit("text").alias("kind"), (F.col("n_chars") % 53).alias("score"))))
    rows = docs.select(F.col("source").alias("question_id"), "doc_id", each.alias("e")).select("question_id", F.concat_ws("_", F.col("doc_id").cast("string"), "e.kind").alias("node_id"), F.col("e.kind").alias("node_type"), F.col("e.score").cast("double").alias("score"))
    return rounded(rerank.smooth_pairs(rows.select("question_id", "node_id", "score"), rows.select("node_id", "node_type")), 4)


@query
def node_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node with its degree, its terms and its community's label."""
    nodes = lines(spark, sf_dir)
    degree = structure.degrees(structure.collapse(structure.all_edges(nodes))).select("node_id", "degree")
    terms = knowledge.node_terms(nodes).groupBy("node_id").agg(F.count("*").alias("terms"))
    label = F.when(F.col("section") != "", F.col("section")).otherwise(F.concat(F.lit("page:"), F.col("page").cast("string")))
    out = nodes.join(degree, "node_id", "left").join(terms, "node_id", "left")
    return out.select("node_id", "doc_id", "page", "node_type", label.alias("label"), F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("terms", F.lit(0)).alias("terms"))


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the beginnings of the lines around them."""
    w = Window.partitionBy("doc_id").orderBy("node_pos")
    return lines(spark, sf_dir).withColumns({f"{n}_chunk_preview": f(T.preview(F.col("content"), 120)).over(w) for n, f in (("previous", F.lag), ("next", F.lead))})


@query
def node_texts_by_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the texts by which routes find each line."""
    names = ("retrieval", "section", "table", "product", "after_sales", "guard")
    return node_texts.with_texts(_described(spark, sf_dir), *names).select("node_id", *[F.md5(F.col(f"text_{n}").cast("binary")).alias(n) for n in names])


@query
def question_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's question with the hints of the route that it is understood to take."""
    asks = document_questions(spark, sf_dir).withColumn("question_id", F.concat(F.lit("d"), F.col("question_id").cast("string")))
    routes = expansion.keyed(expansion.routing(questions.understand(asks)), "question_id")
    return expansion.expand(asks.select("question_id", "question"), routes)


@query
def product_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's question, with its source, against its lines; products are the known groups and the first words of titles."""
    source = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), "source").dropDuplicates(["question_id"])
    blob = T.casefold(T.clean_text(F.concat_ws(" ", "question", "source")))
    word = T.casefold(F.regexp_extract(T.clean_text(F.col("title")), r"^\S+", 0))
    # The names and the search of them read the questions.
    asks = structure.settle(document_questions(spark, sf_dir).join(source, "question_id", "left").select("question_id", blob.alias("blob"), word.alias("canonical")), "asks")
    groups = knowledge_route.product_groups(spark).unionByName(asks.select("canonical").where("canonical <> ''").distinct().select("canonical", F.array("canonical").alias("terms")))
    nodes = node_texts.with_texts(lines(spark, sf_dir), "product", "visual").withColumn("source_ref", F.lit(""))
    return knowledge_route.product_scores(nodes.withColumn("question_id", F.col("doc_id")), asks, groups)


def _knowledge(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, their nodes, and relations with the nodes that they come from: documents, terms, and the policies whose words a line holds."""
    nodes = lines(spark, sf_dir)
    terms = _terms(spark, sf_dir)
    nodes = nodes.withColumn("said", T.casefold(T.clean_text(F.col("content"))))
    part, product = F.concat(F.lit("part:"), F.lower("term")), F.concat(F.lit("product:"), F.col("doc_id").cast("string"))
    policy = spark.createDataFrame([(f"policy:{L.KG_POLICIES[k]}", L.KG_POLICIES[k], list(v), "policy") for k, v in L.AFTER_SALES_TERMS.items()], "entity_id string, name string, aliases array<string>, entity_type string")
    none = F.array().cast("array<string>").alias("aliases")
    parts = terms.select(part.alias("entity_id"), F.lower("term").alias("name"), none, F.lit("part").alias("entity_type")).distinct()
    products = terms.select(product.alias("entity_id"), F.col("doc_id").cast("string").alias("name"), none, F.lit("product").alias("entity_type")).distinct()
    told = F.array_compact(F.array(*[F.when(T.has_any(F.col("said"), v), f"policy:{L.KG_POLICIES[k]}") for k, v in L.AFTER_SALES_TERMS.items()]))
    links = terms.select("node_id", part.alias("entity_id")).unionByName(terms.select("node_id", product.alias("entity_id"))).unionByName(nodes.select("node_id", F.explode(told).alias("entity_id"))).distinct()
    of_part = terms.select(product.alias("source_id"), part.alias("target_id"), F.lit("product_has_part").alias("relation_type"), F.col("node_id").alias("evidence_node_id"))
    of_policy = nodes.select(F.explode(told).alias("source_id"), product.alias("target_id"), F.lit("policy_applies_to_product").alias("relation_type"), F.col("node_id").alias("evidence_node_id"))
    return parts.unionByName(products).unionByName(policy), links, of_part.unionByName(of_policy).distinct()


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Dozens of patterns a question, which several joins read.
    return structure.settle(questions.after_sales(questions.intents(document_questions(spark, sf_dir))).select("question_id", "question", "blob", "sales"), "known")


@query
def kg_query_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge_route.query_context(_known(spark, sf_dir), _knowledge(spark, sf_dir)[0])


@query
def kg_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's question against its lines by the entities and relations of both."""
    entities_, links, relations_ = _knowledge(spark, sf_dir)
    context = structure.settle(knowledge_route.query_context(_known(spark, sf_dir), entities_), "context")
    pairs = lines(spark, sf_dir).select(F.col("doc_id").alias("question_id"), "node_id", "node_type", F.lit("").alias("structure_type"), F.lit(False).alias("captioned"))
    return knowledge_route.graph_scores(pairs, context, links, relations_)


@query
def after_sales_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = node_texts.with_texts(_described(spark, sf_dir), "after_sales")
    pairs = nodes.select(F.col("doc_id").alias("question_id"), "node_id", "node_type", F.lit("").alias("structure_type"), F.lit("").alias("paper_domain"), "text_after_sales")
    return signals.after_sales_scores(pairs, _known(spark, sf_dir).select("question_id", "question", "sales"))


def _answer_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of the five best documents by BM25, of the kinds that their languages stand for."""
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("lang")), F.lit("text"))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), kind.alias("node_type"), T.preview(F.col("text"), 220).alias("content_preview"))
    best = bm25_best(spark, sf_dir, 5).join(docs, "node_id")
    empty = [F.lit("").alias(n) for n in ("visual_summary", "visual_caption", "crop_image_path", "page_image_path")]
    step = F.struct("rank", F.struct(F.col("node_id").cast("string").alias("node_id"), "node_type", F.lit(1).alias("page"), "content_preview", *empty).alias("s"))
    steps = best.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(step)), lambda x: x["s"]).alias("steps"))
    out = asked(spark, sf_dir).select("question_id", F.col("text").alias("question"), F.lit("").alias("summary")).join(steps, "question_id", "left")
    return out.withColumn("steps", F.coalesce("steps", F.array().cast(f"array<{answers.STEP}>")))


@query
def chain_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractive answers of every benchmark question, what an upload's answer would say, and the evidence of both."""
    out = answers.evidence_metadata(answers.extractive(_answer_chains(spark, sf_dir)))
    return out.select("question_id", F.col("fallback").alias("answer"), answers.local_answer(F.col("question"), F.col("steps")).alias("local_answer"), "evidence_node_ids", "evidence_pages", "evidence_modalities", "citations", "evidence_count", "visual_evidence_count")


@query
def card_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of the benchmark questions' chains; no card has been drawn and no crop cut."""
    chains_ = _answer_chains(spark, sf_dir)
    steps = chains_.select("question_id", F.explode("steps").alias("s")).select("question_id", "s.*", F.lit(False).alias("crop_exists"))
    asks = chains_.select("question_id", F.lit("").alias("question_type"), "question", F.lit("").alias("answer"), F.lit("").alias("gold_modalities"))
    return evaluate.card_checks(asks, steps, spark.createDataFrame([], "question_id long, width int, height int, nonblank boolean"))


@query
def chunk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = lines(spark, sf_dir)
    edges = structure.all_edges(nodes).withColumn("doc_id", F.split("source_id", "_")[1].cast("long"))
    return evaluate.chunk_report(nodes, edges)


@query
def common_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's most frequent kind of node, of equals the first."""
    return evaluate.most_common(lines(spark, sf_dir), "doc_id", "node_type", "node_pos")


@query
def content_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as content lists, an item for each line, and read as nodes."""
    item = F.struct(F.when(F.col("node_type") == "title", "doc-title").otherwise(F.col("node_type")).alias("type"), F.col("content").alias("text"), (F.col("page") - 1).alias("page_idx"))
    items = lines(spark, sf_dir).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("node_pos", item.alias("i")))), lambda x: x["i"]).alias("content_list"))
    lists = items.select("doc_id", F.to_json(F.struct("content_list")).alias("text"), F.lit("").alias("path"))
    return content.content_nodes(lists).select("doc_id", "node_id", "pos", "page", "node_type", F.md5(F.col("content").cast("binary")).alias("content_md5"))
