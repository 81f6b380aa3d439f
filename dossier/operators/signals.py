"""The default ranker: what a candidate's neighbours in the document graph, its own kind and its references say for a question, and the five methods that blend it.

Candidates are (question_id, node_id, sim); plans are planning.query_plan() with graph_profile(), graph_multipliers() and g4_profile().
All signals of the graph are one join of candidates with their edges and one aggregation by candidate: sums are of whole numbers
(billionths), so that they don't depend on the order of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from dossier.functions import lexicon as L
from dossier.functions.lexicon import VISUAL_TYPES
from dossier.functions.text import clean_text, document_refs, has_any, is_toc_entry
from dossier.operators.fusion import min_max
from dossier.operators.rerank import answer_prior, reference_weight
from dossier.operators.sparse import distinct, gram_rows

STRONG = ("text_ref_table", "text_ref_figure", "table_caption", "figure_caption")
CONTEXT = ("same_context_visual", "same_context_table", "same_context_figure")
#: What the neighbours of a table question's candidates may count at most over context edges.
TABLE_ONLY_CONTEXT = (*CONTEXT, "section_multimodal_peer")
BILLION = 1e9
#: Added before scores are rounded to six digits: a decimal that ends in 5 goes up, whatever its last bit.
UP = 1e-10


def billionths(c: Column) -> Column:
    return F.round(c * BILLION).cast("long")


def has(c: str, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(c, F.array(*map(F.lit, names)))


def _plus(cond: Column, x: float) -> Column:
    return F.when(cond, x).otherwise(0.0)


def node_refs(nodes: DataFrame) -> DataFrame:
    """Nodes with refs: what they name, and for the k-th table of a document table:k."""
    is_table = F.col("node_type") == "table"
    nth = F.sum(is_table.cast("int")).over(Window.partitionBy("doc_id").orderBy("node_pos"))
    own = F.when(is_table, F.array(F.concat(F.lit("table:"), nth.cast("string")))).otherwise(F.array().cast("array<string>"))
    return nodes.withColumn("refs", F.array_sort(F.array_union(document_refs(F.col("content")), own)))


def local_lexical(pairs: DataFrame) -> DataFrame:
    """(question_id, node_id, score): cosine of character TF-IDF fitted on a question and its own candidates, the question being one of the texts.

    pairs: (question_id, node_id, question, text). Texts are shuffled once, as they are, to stand by question; their runs of characters are
    counted in a map over them, a few questions at a time, and leave no row of their own."""
    text = lambda c: F.regexp_replace(F.lower(clean_text(F.col(c))), r"\s\s+", " ")
    rows = pairs.where("question_id is not null").select("question_id", "node_id", text("question").alias("q"), text("text").alias("x"))
    kinds = [f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("question_id", "node_id")]
    out = rows.repartition("question_id").sortWithinPartitions("question_id").mapInArrow(_likeness, f"{', '.join(kinds)}, score double")
    return out.select("question_id", "node_id", F.round("score", 6).alias("score"))


#: Characters of texts whose runs are counted at a time, of one question at least.
CHARACTERS = 1 << 18


def _likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of rows (question_id, node_id, q, x) that stand by question."""
    held = None
    for batch in batches:
        if len(batch):
            held = batch if held is None else pa.concat_batches([held, batch])
            begin = _begins(held.column(0))
            if len(begin) > 1:
                yield from _by_pieces(held.slice(0, begin[-1]), begin[:-1])
                held = held.slice(begin[-1])
    if held is not None:
        yield from _by_pieces(held, _begins(held.column(0)))


def _begins(ids: pa.Array) -> np.ndarray:
    new = pa.compute.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _by_pieces(rows: pa.RecordBatch, begin: np.ndarray) -> Iterator[pa.RecordBatch]:
    size = np.cumsum(pa.compute.utf8_length(rows.column(3)).to_numpy(zero_copy_only=False))
    ends = np.append(begin[1:], len(rows))
    first = 0
    while first < len(begin):
        before = size[begin[first] - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(size[ends - 1], before + CHARACTERS, "right")))
        part = rows.slice(begin[first], ends[last - 1] - begin[first])
        score = _cosines(part.column(3).to_pylist(), part.column(2).take(pa.array(begin[first:last] - begin[first])).to_pylist(), np.diff(np.append(begin[first:last], ends[last - 1])))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score)], ["question_id", "node_id", "score"])
        first = last


def _cosines(texts: list[str], questions: list[str], size: np.ndarray) -> np.ndarray:
    """Likeness of each text to its question; the i-th question has the next size[i] texts."""
    n, asks = len(texts), np.arange(len(questions))
    row, term = gram_rows([*texts, *questions])
    order = np.argsort(row, kind="stable")
    row, term, tf = distinct(row[order], term[order])
    group = np.concatenate([np.repeat(asks, size), asks])[row]
    order = np.lexsort((term, group))
    new = np.ones(len(order), bool)
    new[1:] = (term[order][1:] != term[order][:-1]) | (group[order][1:] != group[order][:-1])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    # A question's texts and itself are what its terms are fitted on.
    idf = (np.log((2.0 + size[group]) / (1 + np.bincount(of)[of])) + 1) if len(of) else np.zeros(0)
    asked, own = row >= n, row < n
    qtf = np.zeros(int(new.sum()))
    qtf[of[asked]] = tf[asked]
    w, whole = tf * idf, lambda x: np.floor(x * BILLION + 0.5).astype(np.int64)
    sums = lambda at, x, many: np.diff(np.concatenate([[0], np.cumsum(whole(x))])[np.searchsorted(at, np.arange(many + 1))]).astype(float)
    dot, norm = sums(row[own], (w * qtf[of] * idf)[own], n), sums(row[own], (w * w)[own], n)
    length = np.repeat(sums(row[asked] - n, (w * w)[asked], len(asks)), size)
    there = (norm > 0) & (length > 0)
    return np.where(there, dot / np.sqrt(np.where(there, norm * length, 1.0)), 0.0)


def walk(links: DataFrame, seeds: DataFrame, alpha: float = 0.85, rounds: int = 400, tolerance: float = 1e-14) -> DataFrame:
    """(question_id, node_id, score): personalised PageRank where each question has a graph of its own, such as a document's: the power iterations of many questions run side by side in a map over rows that stand by question.

    links and seeds as in structure.pagerank(), which is for graphs that no task could hold. Seeds that are all 0 count alike."""
    rows = links.select("question_id", "x", "y", F.col("weight").cast("double").alias("weight")).unionByName(seeds.select("question_id", F.col("node_id").alias("x"), F.lit(None).cast("string").alias("y"), F.greatest(F.col("weight").cast("double"), F.lit(0.0)).alias("weight")))
    rows = rows.where("x is not null and weight is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole(batches):
            new = _begins(part.column(0))
            group = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(part))))
            names = pa.concat_arrays([part.column(1), part.column(2)]).dictionary_encode()
            code = pa.compute.fill_null(names.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            x, y = np.split(code, 2)
            score, key = _walked(group, x, y, part.column(3).to_numpy(zero_copy_only=False), len(names.dictionary), len(new), alpha, rounds, tolerance)
            of, node = np.divmod(key, len(names.dictionary))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(new[of])), names.dictionary.take(pa.array(node)), pa.array(score)], ["question_id", "node_id", "score"])

    kind = links.schema["question_id"].dataType.simpleString()
    return rows.repartition("question_id").sortWithinPartitions("question_id").mapInArrow(run, f"question_id {kind}, node_id string, score double")


#: Rows of graphs that are walked at a time, of one question at least.
LINKS = 1 << 16


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of whole questions, LINKS at a time where a question has no more, of batches that stand by question."""
    held, n = [], 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            n += len(batch)
            if n >= LINKS and (held[0].column(0)[0] != batch.column(0)[-1]):
                every = pa.concat_batches(held)
                end = int(_begins(every.column(0))[-1])
                yield every.slice(0, end)
                held, n = [every.slice(end)], len(every) - end
    if held:
        yield pa.concat_batches(held)


def _walked(group: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, many: int, groups: int, alpha: float, rounds: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores of nodes and their keys, group * many + name; rows are links, or seeds where y is -1. A group ends by itself."""
    seed = y < 0
    link = ~seed
    key, place = np.unique(np.concatenate([group * many + x, group[link] * many + y[link]]), return_inverse=True)
    n, of = len(key), key // many
    size = np.bincount(of, minlength=groups)
    at, x, y, w, given = place[: len(x)][seed], place[: len(x)][link], place[len(x) :], w[link], w[seed]
    sums = lambda v: np.bincount(of, v, minlength=groups)
    start = np.bincount(at, given, minlength=n)
    none = sums(start) <= 0
    start = np.where(none[of], np.bincount(at, minlength=n), start)
    start = np.where((sums(start) <= 0)[of], 1.0, start)
    start = start / sums(start)[of]
    total = np.bincount(x, w, minlength=n)
    p = w / total[x]
    score, lost, going = 1.0 / size[of], total <= 0, np.ones(groups, bool)
    for _ in range(rounds):
        new = alpha * (np.bincount(y, score[x] * p, minlength=n) + sums(np.where(lost, score, 0.0))[of] * start) + (1 - alpha) * start
        moved = sums(np.abs(new - score))
        score = np.where(going[of], new, score)
        going &= moved >= size * tolerance
        if not going.any():
            break
    return score, key


def around(candidates: DataFrame, nodes: DataFrame, graph: DataFrame, plans: DataFrame) -> DataFrame:
    """A row for each candidate and neighbour: both nodes' traits, the edge, the neighbour's similarity and the question's flags. nodes: with content, or toc made of it."""
    toc = F.col("toc") if "toc" in nodes.columns else is_toc_entry(F.col("content")).alias("toc")
    info = nodes.select("node_id", "doc_id", "section", "node_type", toc, *[F.coalesce(F.col(c) != "", F.lit(False)).alias(a) if c in nodes.columns else F.lit(False).alias(a) for c, a in (("crop_image_path", "crop"), ("visual_caption", "caption"))])
    side = lambda s: info.select(*[F.col(c).alias(f"{c}_{s}") for c in info.columns])
    links = graph.select(F.col("u").alias("node_id_x"), F.col("v").alias("node_id_y"), "weight", "edge_types")
    links = links.unionByName(links.select(F.col("node_id_y").alias("node_id_x"), F.col("node_id_x").alias("node_id_y"), "weight", "edge_types"))
    own = candidates.select("question_id", F.col("node_id").alias("node_id_x"), F.greatest(F.col("sim"), F.lit(0.0)).alias("sim_x"))
    sims = own.select("question_id", F.col("node_id_x").alias("node_id_y"), F.col("sim_x").alias("sim_y"))
    flags = plans.select("question_id", "wants_table", "wants_figure", "wants_cross", "wants_location", "wants_visual", "structured", F.size("sales").alias("n_sales"), "kind_weights", "relation_weights")
    rows = own.join(side("x"), "node_id_x").join(links, "node_id_x", "left").join(side("y"), "node_id_y", "left").join(sims, ["question_id", "node_id_y"], "left")
    return rows.withColumn("sim_y", F.coalesce("sim_y", F.lit(0.0))).join(flags, "question_id")


def graph_signals(candidates: DataFrame, nodes: DataFrame, graph: DataFrame, plans: DataFrame, tau: float = 0.2) -> DataFrame:
    """(question_id, node_id, sim, node_type, caption, bridge, modality, grounding, chain): the signals of a candidate's neighbourhood.

    grounding lacks what the candidate's own visual text says, which is added by ground()."""
    rows = around(candidates, nodes, graph, plans)
    here = F.coalesce(F.col("node_type_y").isNotNull() & ~F.col("toc_y"), F.lit(False))
    kind, table, figure, cross = F.col("node_type_y"), F.col("wants_table"), F.col("wants_figure"), F.col("wants_cross")
    table_only = table & ~figure & ~cross
    worth = F.coalesce(F.element_at("kind_weights", kind), F.lit(0.0))
    relation = lambda e: F.when(table_only & e.isin(*TABLE_ONLY_CONTEXT), F.least(F.coalesce(F.element_at("relation_weights", e), F.lit(0.0)), F.lit(0.03))).otherwise(F.coalesce(F.element_at("relation_weights", e), F.element_at("relation_weights", F.lit("related"))))
    strongest = F.array_max(F.transform("edge_types", relation))
    counts = here & kind.isin("text", "table", "figure", "page", "caption") & ((F.col("sim_y") >= tau) | kind.isin(*VISUAL_TYPES))
    tied = has("edge_types", STRONG) | (~table_only & has("edge_types", CONTEXT))
    loose = has("edge_types", ("same_section", "section_multimodal_peer"))
    shown = F.when(has("edge_types", ("table_caption", "figure_caption")), 0.08).otherwise(0.03) + _plus(F.col("crop_y"), 0.02) + _plus(F.col("caption_y"), 0.03)
    weight = F.least(F.col("weight"), F.lit(2.0))
    step = F.when(has("edge_types", (*STRONG, "section_title", "parent_section")), 0.22 * weight).when(has("edge_types", ("chunk_sequence", "same_section", "same_page")), 0.08 * weight).otherwise(0.0)
    near = _plus(F.col("doc_id_y") == F.col("doc_id_x"), 0.03) + _plus((F.col("section_x") != "") & (F.col("section_y") == F.col("section_x")), 0.04)
    kinds = lambda *k: F.coalesce(F.max(here & kind.isin(*k)), F.lit(False))
    one = ("sim_x", "node_type_x", "toc_x", "crop_x", "caption_x", "wants_table", "wants_figure", "wants_cross", "wants_visual", "n_sales", "kind_weights")
    got = rows.groupBy("question_id", F.col("node_id_x").alias("node_id")).agg(
        *[F.first(c).alias(f"one_{c}") for c in one],
        F.count("node_id_y").alias("degree"),
        (F.sum(F.when(counts, billionths(strongest * worth * (0.5 + F.col("sim_y"))))) / BILLION).alias("near"),
        (F.sum(F.when(counts, billionths(worth))) / BILLION).alias("covered"),
        F.max(F.when(here & tied, 0.22).when(here & loose, 0.12).otherwise(0.0)).alias("tie"),
        F.max(F.when(kind.isin(*VISUAL_TYPES), shown).otherwise(0.0)).alias("shown"),
        (F.sum(F.when(here, billionths(step))) / BILLION).alias("steps"),
        F.max(F.when(here, F.col("sim_y")).otherwise(0.0)).alias("said"),
        (F.sum(F.when(here, billionths(near))) / BILLION).alias("beside"),
        kinds("text").alias("y_text"),
        kinds("table").alias("y_table"),
        kinds("figure", "caption").alias("y_figure"),
        kinds("title").alias("y_title"),
        F.coalesce(F.max(here & (kind == "figure")), F.lit(False)).alias("y_image"),
        (F.coalesce(F.max((here & kind.isin("text")).cast("int")), F.lit(0)) + F.coalesce(F.max((here & (kind == "table")).cast("int")), F.lit(0)) + F.coalesce(F.max((here & (kind == "figure")).cast("int")), F.lit(0)) + F.coalesce(F.max((here & (kind == "caption")).cast("int")), F.lit(0))).alias("y_kinds"),
    )
    got = got.withColumnsRenamed({f"one_{c}": c for c in one})
    own, zero = F.col("node_type_x"), F.lit(0.0)
    mine = F.coalesce(F.element_at("kind_weights", own), zero)
    in_modes = own.isin("text", "table", "figure", "page", "caption")
    target = F.greatest(F.lit(1.0), F.aggregate(F.map_values("kind_weights"), zero, lambda s, x: s + x))
    coverage = F.least(F.lit(1.0), (F.when(in_modes, mine).otherwise(0.0) + F.coalesce("covered", zero)) / target)
    bridge = F.when(F.col("toc_x"), 0.0).otherwise((0.35 * mine + 0.65 * F.coalesce("near", zero)) * coverage / F.ln(2.0 + F.least(F.col("degree"), F.lit(12))))
    wanted = (own == "text") | (table & own.isin("table", "caption")) | (figure & own.isin("figure", "caption")) | (cross & own.isin("table", "figure", "caption"))
    kind_score = F.when(wanted, F.when(own == "text", 0.36).when(own.isin("table", "figure"), 0.58).otherwise(0.48)).otherwise(0.0) + _plus(own.isin(*VISUAL_TYPES) & F.col("caption_x"), 0.08)
    seen_table, seen_figure = (own == "table") | F.col("y_table"), own.isin("figure", "caption") | F.col("y_figure")
    covers = _plus(table & seen_table, 0.24) + _plus(figure & seen_figure, 0.24) + F.when(cross, _plus(((own == "text") | F.col("y_text")) & (seen_table | seen_figure), 0.22) + _plus(seen_table & seen_figure, 0.14)).otherwise(0.0)
    modality = F.when(F.col("wants_visual") | table | figure | cross, F.greatest(zero, F.least(F.lit(1.0), kind_score + F.col("tie") + covers))).otherwise(0.0)
    grounding = _plus(table & (own == "table"), 0.18) + _plus(figure & own.isin("figure", "caption"), 0.18) + _plus(F.col("wants_visual") & own.isin(*VISUAL_TYPES), 0.08) + _plus(F.col("crop_x"), 0.03) + _plus(F.col("caption_x"), 0.05) + F.col("shown")
    sold = F.col("n_sales") > 0
    covered = _plus(table & F.col("y_table"), 0.22) + _plus(figure & F.col("y_figure"), 0.22) + _plus(cross & (F.col("y_kinds") >= 2), 0.25) + _plus(sold & (F.col("y_title") | F.col("y_text") | F.col("y_image")), 0.12)
    covered = covered * F.when(own.isin("page", "title") & ~sold, 0.65).otherwise(1.0)
    chain = F.greatest(zero, F.least(F.lit(1.0), 0.45 * F.least(F.coalesce("steps", zero), F.lit(1.0)) + 0.3 * F.col("said") + 0.15 * F.least(F.coalesce("beside", zero), F.lit(1.0)) + covered))
    chain = F.when(F.col("toc_x") | (F.col("degree") == 0), 0.0).otherwise(chain)
    digits = lambda c, name: F.round(c + UP, 6).alias(name)
    return got.select("question_id", "node_id", F.col("sim_x").alias("sim"), own.alias("node_type"), F.col("caption_x").alias("caption"), digits(bridge, "bridge"), digits(modality, "modality"), digits(grounding, "grounding"), digits(chain, "chain"))


def reference_scores(candidates: DataFrame, nodes: DataFrame, graph: DataFrame, plans: DataFrame) -> DataFrame:
    """(question_id, node_id, score): candidates that a question's references name, that stand beside such a node, or that are linked to it; the greatest counts.

    nodes: with refs (node_refs()) and node_pos, the order within the document. A named table lends to the first table within three nodes after
    it, a named figure to the first figure or caption within three after and two before it, on its page. Questions without references score 0."""
    asked = plans.select("question_id", document_refs(F.col("question")).alias("wanted")).where(F.size("wanted") > 0)
    info = nodes.select("node_id", "doc_id", "page", "node_type", "node_pos", "refs")
    inside = candidates.select("question_id", "node_id").join(asked, "question_id").join(info, "node_id")
    # A question's references are looked for in the documents of its candidates.
    scope = inside.select("question_id", "wanted", "doc_id").distinct()
    anchors = scope.join(info, "doc_id").withColumn("hits", F.array_intersect("refs", "wanted")).where(F.size("hits") > 0)
    starts = lambda k: F.exists("hits", lambda h: h.startswith(k))
    anchors = anchors.select("question_id", "doc_id", "page", F.col("node_id").alias("anchor"), F.col("node_pos").alias("at"), starts("table:").alias("a_table"), starts("figure:").alias("a_figure"), reference_weight(F.col("node_type"), starts("table:")).alias("worth"))
    named = anchors.select("question_id", F.col("anchor").alias("node_id"), F.col("worth").alias("score"))
    place = info.select("doc_id", "page", F.col("node_id").alias("near"), F.col("node_type").alias("near_type"), F.col("node_pos").alias("near_pos"))
    close = anchors.join(place, ["doc_id", "page"]).withColumn("step", F.col("near_pos") - F.col("at")).where("step between -2 and 3 and step <> 0")
    fits = F.when(F.col("step") > 0, (F.col("a_table") & (F.col("near_type") == "table")) | (F.col("a_figure") & F.col("near_type").isin("figure", "caption"))).otherwise(F.col("a_figure") & F.col("near_type").isin("figure", "caption"))
    first = F.row_number().over(Window.partitionBy("question_id", "anchor", F.col("step") > 0).orderBy(F.abs("step")))
    beside = close.where(fits).withColumn("first", first).where("first = 1").select("question_id", F.col("near").alias("node_id"), (F.when(F.col("step") > 0, 0.95).otherwise(0.75) / F.sqrt(F.abs("step").cast("double"))).alias("score"))
    links = graph.select(F.col("u").alias("anchor"), F.col("v").alias("node_id"), "edge_types").unionByName(graph.select(F.col("v").alias("anchor"), F.col("u").alias("node_id"), "edge_types"))
    factor = F.when(has("edge_types", STRONG), 0.85).when(F.array_contains("edge_types", "same_page"), 0.35).otherwise(0.2)
    linked = anchors.join(links, "anchor").select("question_id", "node_id", (F.col("worth") * factor).alias("score"))
    every = named.unionByName(beside).unionByName(linked).groupBy("question_id", "node_id").agg(F.max("score").alias("score"))
    out = candidates.select("question_id", "node_id").join(every, ["question_id", "node_id"], "left")
    return out.select("question_id", "node_id", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))


def rank_methods(signals: DataFrame, plans: DataFrame, k: int = 10, alpha: float = 0.93, beta: float = 0.07, lambda_s: float = 0.85, lambda_p: float = 0.0, lambda_b: float = 0.15, lambda_r: float = 0.1) -> DataFrame:
    """(question_id, method, rank, node_id, score): the k best of G0 (retrieval's order), G1 (similarity), G2 (with the walk), G3 (with bridges and references) and G4 (with all signals).

    signals: (question_id, node_id, node_type, caption, sim, ppr, bridge, ref, grounding, modality, chain, and where there are such domain, product, kg
    and model). Each is normalised over a question's candidates. Weights come from the question's plan; ties go by node."""
    names = ("sim", "ppr", "bridge", "ref", "grounding", "modality", "chain", "domain", "product", "kg", "model")
    flags = plans.select("question_id", "route", "wants_table", "wants_figure", "wants_cross", "wants_location", "wants_visual", "text_fact", "structured", "hops", "has_product", (F.size("sales") > 0).alias("sold"), "rerank_boost", "graph_boost", "ppr_mult", "bridge_mult", "ref_mult", *[F.col(c) for c in plans.columns if c.startswith("g4_")])
    rows = signals.select("question_id", "node_id", "node_type", "caption", *[F.col(c) if c in signals.columns else F.lit(0.0).alias(c) for c in names]).join(flags, "question_id")
    whole = Window.partitionBy("question_id")
    rows = rows.withColumn("modality", F.when(F.col("rerank_boost"), F.col("modality")).otherwise(0.0))
    rows = rows.withColumns({f"n_{c}": min_max(F.col(c), "question_id") for c in names} | {f"any_{c}": F.max(c).over(whole) > 0 for c in names})
    table, figure, cross, place, visual = (F.col(f"wants_{c}") for c in ("table", "figure", "cross", "location", "visual"))
    boost, graph, route = F.col("rerank_boost"), F.col("graph_boost"), F.col("route")
    table_only = table & ~figure & ~cross
    looks = visual | table | figure | cross
    walk_w = F.when(graph & ~table_only, F.greatest(F.lit(lambda_p), F.when(looks, 0.035).when(F.col("hops"), 0.07).otherwise(0.02))).otherwise(lambda_p)
    bridge_w = F.when(graph & ~table_only, F.greatest(F.lit(lambda_b), F.when(looks, 0.17).when(F.col("hops"), 0.18).otherwise(0.15))).otherwise(lambda_b)
    p, b = F.col("ppr_mult"), F.col("bridge_mult")
    g2 = (alpha + beta * (1 - p)) * F.col("n_sim") + beta * p * F.col("n_ppr")
    sim_w = lambda_s + walk_w * (1 - p) + bridge_w * (1 - b)
    ref_w = F.least(F.when(F.col("any_ref"), lambda_r * F.col("ref_mult")).otherwise(0.0), sim_w)
    g3 = (sim_w - ref_w) * F.col("n_sim") + walk_w * p * F.col("n_ppr") + bridge_w * b * F.col("n_bridge") + ref_w * F.col("n_ref")
    bounded = lambda w, name: F.least(F.col(f"g4_{name}_max"), F.greatest(F.col(f"g4_{name}_min"), w))
    seen = F.when(~F.col("any_grounding") | F.col("structured"), 0.0).when(F.col("text_fact") & ~(table | figure | place), 0.02).when(table | figure, 0.08).when(cross | place, 0.05).when(visual, 0.035).otherwise(0.015)
    linked = F.when(~F.col("any_chain"), 0.0).when(F.col("sold"), 0.09).when(F.col("structured"), 0.025).when(cross | table | figure, 0.08).when(place, 0.06).when(F.col("text_fact"), 0.025).otherwise(0.04)
    modal = F.when(~F.col("any_modality") | ~boost, 0.0).when(cross & (table | figure), 0.18).when(table & figure, 0.17).when(table | figure, 0.14).when(visual, 0.10).otherwise(0.0)
    shows = route.isin("visual_grounding", "cross_modal")
    visual_w = F.greatest(bounded(seen, "visual"), F.when(boost & shows, 0.16).when(boost & (route != "structured_table") & visual, 0.12))
    chain_w = F.greatest(bounded(linked, "chain"), F.when(boost & shows, 0.12).when(boost & (route == "structured_table"), 0.06), F.when(graph & F.col("any_chain"), F.when(visual, 0.09).otherwise(0.055)))
    modal_w = F.greatest(modal, F.when(boost & ~shows & (route == "structured_table"), 0.11).when(boost & ~shows & visual, 0.10))
    domain_w = F.when(F.col("any_domain"), F.greatest(F.col("g4_domain_min"), F.when(F.col("sold"), 0.11).otherwise(0.0))).otherwise(0.0)
    product_w = F.when(F.col("any_product"), F.greatest(F.col("g4_product_min"), F.when(F.col("has_product"), F.when(F.col("sold"), 0.04).otherwise(0.08)).otherwise(0.0))).otherwise(0.0)
    kg_w = F.when(F.col("any_kg"), F.greatest(F.least(F.col("g4_kg_max"), F.greatest(F.col("g4_kg_min"), F.lit(0.018))), F.when(graph, 0.025))).otherwise(0.0)
    model_w = F.when(F.col("any_model"), F.least(F.col("g4_model_max"), F.lit(0.08))).otherwise(0.0)
    rows = rows.withColumns({"g2": g2, "g3": g3})
    rest = F.greatest(F.lit(0.05), 1 - F.col("g3"))
    raw = F.col("g3") + rest * (visual_w * F.col("n_grounding") + modal_w * F.col("n_modality") + chain_w * F.col("n_chain") + domain_w * F.col("n_domain") + product_w * F.col("n_product") + kg_w * F.col("n_kg") + model_w * F.col("n_model"))
    rows = rows.withColumn("raw", (1 - F.col("g4_retrieval_anchor")) * raw + F.col("g4_retrieval_anchor") * F.col("n_sim")).withColumn("domain_w", F.least(F.lit(0.22), 2 * domain_w))
    raw = (1 - F.col("domain_w")) * F.col("raw") + F.col("domain_w") * F.col("n_domain")
    prior = answer_prior(F.col("node_type"), table | figure | place | cross, F.col("structured"), F.col("sold"), F.col("caption"))
    rows = rows.withColumn("g4", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw * prior)), 9)).withColumn("g4", min_max(F.col("g4"), "question_id"))
    each = F.array(*[F.struct(F.lit(m).alias("method"), F.round(s + UP, 6).alias("score")) for m, s in (("G0", F.col("n_sim")), ("G1", F.col("n_sim")), ("G2", F.col("g2")), ("G3", F.col("g3")), ("G4", F.col("g4")))])
    long = rows.select("question_id", "node_id", F.explode(each).alias("e")).select("question_id", "node_id", "e.method", "e.score")
    rank = F.row_number().over(Window.partitionBy("question_id", "method").orderBy(F.desc("score"), "node_id")).cast("long")
    return long.withColumn("rank", rank).where(F.col("rank") <= k).select("question_id", "method", "rank", "node_id", "score")


def after_sales_scores(pairs: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, node_id, score): .65 * likeness to the question and its intents' terms, fitted on the question's own nodes, and bonuses for manuals, policies, titles and shared intents; 0 for questions without an intent.

    pairs: (question_id, node_id, node_type, structure_type, paper_domain, text_after_sales); questions: (question_id, question, sales)."""
    text, sales = F.col("text_after_sales"), F.map_from_entries("sales")
    terms = F.create_map(*[x for k, v in L.AFTER_SALES_TERMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    words = F.flatten(F.transform("sales", lambda s: F.coalesce(terms[s["intent"]], F.array().cast("array<string>"))))
    sold = questions.where(F.size("sales") > 0).select("question_id", F.array_join(F.concat(words, F.array("question")), " ").alias("question"), sales.alias("__sales"))
    rows = pairs.join(sold, "question_id")
    alike = local_lexical(rows.select("question_id", "node_id", "question", text.alias("text"))).withColumnRenamed("score", "__alike")
    shared = F.greatest(F.lit(0.0), *[F.when(has_any(text, v), F.coalesce(F.col("__sales")[k], F.lit(0.0))) for k, v in L.AFTER_SALES_TERMS.items()])
    plus = lambda cond, x: F.when(cond, x).otherwise(0.0)
    bonus = plus(has_any(text, L.AFTER_SALES_HINTS), 0.12) + plus(F.col("paper_domain") == "after_sales_knowledge_base", 0.18) + plus(F.col("structure_type").isin("after_sales_policy", "manual_profile"), 0.12) + plus(F.col("node_type") == "title", 0.04)
    own = rows.join(alike, ["question_id", "node_id"]).select("question_id", "node_id", (0.65 * F.col("__alike") + bonus + 0.25 * shared).alias("score"))
    return pairs.select("question_id", "node_id").join(own, ["question_id", "node_id"], "left").select("question_id", "node_id", F.round(F.coalesce("score", F.lit(0.0)), 4).alias("score"))
