"""Metrics of rankings and chains, each one aggregation, and reports on nodes and cards."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from dossier.functions.lexicon import VISUAL_TYPES
from dossier.functions.text import clean_text


def ndcg_at_5(rel: Column, rank: Column, ideal: Column) -> Column:
    """Binary nDCG@5 of a group of rows; ideal is the number of relevant nodes there are."""
    gain = F.sum(F.when((rank <= 5) & rel, 1 / F.log2(rank + 1.0)).otherwise(0.0))
    best = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.max(ideal), F.lit(5)).cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return F.when(F.max(ideal) > 0, gain / best).otherwise(0.0)


def ranking_metrics(rankings: DataFrame) -> DataFrame:
    """Per question and method: hits at 1, 3, 5 and 10, reciprocal rank and nDCG@5. rankings: (question_id, method, rank, relevant, ideal)."""
    rel, rank = F.col("relevant"), F.col("rank")
    hit = lambda k: F.max(F.when((rank <= k) & rel, 1).otherwise(0))
    out = rankings.groupBy("question_id", "method").agg(*[hit(k).alias(f"hit_at_{k}") for k in (1, 3, 5, 10)], F.round(F.coalesce(1.0 / F.min(F.when(rel, rank)), F.lit(0.0)), 6).alias("mrr"), F.round(ndcg_at_5(rel, rank, F.col("ideal")), 4).alias("ndcg_at_5"))
    return out


def method_summary(metrics: DataFrame) -> DataFrame:
    names = ("hit_at_1", "hit_at_3", "hit_at_5", "hit_at_10", "mrr", "ndcg_at_5")
    return metrics.groupBy("method").agg(F.count("*").alias("num_questions"), *[F.round(F.avg(n), 4).alias(n) for n in names])


def compare_methods(metrics: DataFrame, base: str, other: str) -> DataFrame:
    """Per question: the change of nDCG@5 and hit@5 from one method to another, and its direction."""
    a = metrics.where(F.col("method") == base).select("question_id", F.col("ndcg_at_5").alias("a_ndcg"), F.col("hit_at_5").alias("a_hit"))
    b = metrics.where(F.col("method") == other).select("question_id", F.col("ndcg_at_5").alias("b_ndcg"), F.col("hit_at_5").alias("b_hit"))
    out = a.join(b, "question_id").select("question_id", F.round(F.col("b_ndcg") - F.col("a_ndcg"), 4).alias("delta_ndcg"), (F.col("b_hit") - F.col("a_hit")).alias("delta_hit"))
    up, down = (F.col("delta_ndcg") > 0) | (F.col("delta_hit") > 0), (F.col("delta_ndcg") < 0) | (F.col("delta_hit") < 0)
    return out.withColumn("status", F.when(up & ~down, "improved").when(down & ~up, "regressed").when(up & down, "mixed").otherwise("same"))


def chain_metrics(chains: DataFrame) -> DataFrame:
    """Per question: the share of gold nodes, pages and kinds that a chain holds, and its score.

    chains: (question_id, route, visual_required, nodes, pages, kinds, grounded, related: arrays and counts of the steps; gold_nodes, gold_pages, gold_kinds)."""
    n = F.size("nodes")
    share = lambda own, gold: F.size(F.array_intersect(F.array_distinct(own), gold)) / F.size(gold)
    some = F.when(n > 0, 1.0).otherwise(0.0)
    page = F.when(F.size("gold_pages") > 0, F.arrays_overlap("pages", "gold_pages").cast("double")).otherwise(some)
    out = chains.withColumn("node_coverage", F.when(F.size("gold_nodes") > 0, share("nodes", "gold_nodes")).otherwise(page)).withColumn("page_hit", page)
    out = out.withColumn("kind_coverage", F.when(F.size("gold_kinds") > 0, share("kinds", "gold_kinds")).otherwise(some))
    out = out.withColumn("visual_hit", F.when(F.col("visual_required"), (F.col("grounded") > 0).cast("double")).otherwise(some))
    needed = F.col("visual_required") | F.col("route").isin("cross_modal", "structured_table", "visual_grounding")
    cross = F.when(F.col("route") == "multihop_graph", (F.size(F.array_distinct("nodes")) >= 2).cast("double")).otherwise((~needed | (F.size(F.array_distinct("kinds")) >= 2)).cast("double"))
    out = out.withColumn("cross_hit", cross).withColumn("relation_support", F.when(n > 1, F.col("related") / (n - 1)).otherwise(0.0))
    length = F.when(n > 5, 0.75).when(n >= 2, 1.0).when(n == 1, 0.55).otherwise(0.0)
    score = 0.38 * F.col("node_coverage") + 0.14 * F.col("page_hit") + 0.16 * F.col("kind_coverage") + 0.14 * F.col("visual_hit") + 0.10 * F.col("cross_hit") + 0.05 * F.col("relation_support") + 0.03 * length
    return out.select("question_id", "route", n.alias("step_count"), *[F.round(c, 4).alias(c) for c in ("node_coverage", "page_hit", "kind_coverage", "visual_hit", "cross_hit", "relation_support")], F.round(score, 4).alias("chain_score"))


def chain_summary(metrics: DataFrame) -> DataFrame:
    """Averages by route, and over all routes as `all`, by one rollup."""
    names = ("node_coverage", "page_hit", "kind_coverage", "visual_hit", "cross_hit", "relation_support", "chain_score")
    out = metrics.rollup("route").agg(F.count("*").alias("num_questions"), F.round(F.avg("step_count"), 4).alias("avg_steps"), *[F.round(F.avg(n), 3).alias(n) for n in names])
    return out.withColumn("route", F.coalesce("route", F.lit("all")))


def most_common(df: DataFrame, by: str, value: str, order: str, default: str = "unknown") -> DataFrame:
    """(by, value): each group's most frequent non-empty value, of equals the one that comes first in order."""
    counts = df.groupBy(by, value).agg(F.count("*").alias("n"), F.min(order).alias("o"))
    best = F.max_by(F.when(F.col(value) != "", F.col(value)), F.when(F.col(value) != "", F.struct(F.col("n"), (-F.col("o")).alias("o"))))
    return counts.groupBy(by).agg(F.coalesce(best, F.lit(default)).alias(value))


def edge_counts(edges: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Per document the number of edges of each kind. edges: (doc_id, source_id, target_id, edge_type)."""
    return edges.groupBy("doc_id").agg(*[F.count_if(F.col("edge_type") == k).alias(f"{k}_edges") for k in kinds])


def chunk_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per document: nodes by kind, lengths, sections, rates of captions and of nodes without an edge, and warnings, joined by ;.

    nodes: (doc_id, node_id, node_type, section, content); edges: (doc_id, source_id, target_id, edge_type)."""
    linked = edges.select(F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct().withColumn("linked", F.lit(True))
    rows = nodes.join(linked, "node_id", "left").withColumn("long", F.length(clean_text(F.col("content")))).withColumn("own", F.col("node_type") != "page")
    kind = lambda k: F.count_if(F.col("node_type") == k)
    own = lambda cond: F.count_if(F.col("own") & cond)
    out = rows.groupBy("doc_id").agg(
        F.count("*").alias("total_nodes"), F.count_if("own").alias("evidence_nodes"), *[kind(k).alias(k) for k in ("title", "text", "table", "figure", "caption", "equation")],
        F.countDistinct(F.when(clean_text(F.col("section")) != "", clean_text(F.col("section")))).alias("section_count"),
        F.round(F.coalesce(F.avg(F.when(F.col("own"), F.col("long"))), F.lit(0.0)), 2).alias("avg_chunk_chars"), F.round(F.coalesce(F.percentile(F.when(F.col("own"), F.col("long")), 0.5), F.lit(0.0)), 2).alias("median_chunk_chars"),
        own(F.col("long") > 1200).alias("long_chunks"), own(F.col("long") < 80).alias("short_chunks"), own(F.col("linked").isNull()).alias("isolated_chunks"))
    out = out.join(edge_counts(edges, ("table_caption", "figure_caption", "section_title", "same_section", "chunk_sequence")), "doc_id", "left").na.fill(0)
    rate = lambda x, y: F.round(F.col(x) / F.greatest(F.lit(1), F.col(y)), 4)
    out = out.withColumn("visual_nodes", F.col("table") + F.col("figure") + F.col("caption")).withColumns({"table_caption_pair_rate": rate("table_caption_edges", "table"), "figure_caption_pair_rate": rate("figure_caption_edges", "figure"), "isolated_rate": rate("isolated_chunks", "evidence_nodes")})
    return out.withColumn("warnings", F.array_join(warnings(), ";"))


def warnings() -> Column:
    """The warnings of a row of chunk_report()."""
    c = F.col
    pairs = (c("caption") > 0) & (c("figure_caption_pair_rate") < 0.25) & (c("table_caption_pair_rate") < 0.25)
    each = (("no_sections", c("section_count") == 0), ("no_visual_nodes", c("visual_nodes") == 0), ("high_isolated_rate", c("isolated_rate") > 0.35), ("low_caption_pair_rate", pairs), ("many_long_chunks", c("long_chunks") > F.greatest(F.lit(2.0), c("evidence_nodes") * 0.08)))
    return F.array_compact(F.array(*[F.when(cond, name) for name, cond in each]))


#: Issues that fail a card; others are warnings (fixed values).
CARD_FAILS = ("missing_card", "unexpected_card_size", "blank_or_unreadable_card", "missing_question", "missing_answer", "too_few_chain_steps", "missing_existing_crop")
CARD_SIZE = (1920, 1080)
LOOK_TERMS = ("table", "figure", "fig.", "chart", "plot", "表", "表格", "图", "图表", "图文", "跨模态")


def requires_visual() -> Column:
    """Whether a question's type, text or gold kinds name something to look at."""
    blob = F.lower(clean_text(F.concat_ws(" ", *[F.coalesce(n, F.lit("")) for n in ("question_type", "question", "gold_modalities")])))
    out = F.lit(False)
    for t in LOOK_TERMS:
        out = out | F.contains(blob, F.lit(t))
    return out


def card_checks(questions: DataFrame, steps: DataFrame, cards: DataFrame) -> DataFrame:
    """Per question: counts of steps, status (pass, warn, fail) and issues of its evidence card.

    questions: (question_id, question_type, question, answer, gold_modalities); steps: (question_id, node_type, crop_image_path, crop_exists,
    visual_caption, page); cards: (question_id, width, height, nonblank), a row for each card there is."""
    some = lambda n: clean_text(F.col(n)) != ""
    own = steps.groupBy("question_id").agg(F.count("*").alias("chain_steps"), F.count_if(F.col("node_type").isin(*VISUAL_TYPES)).alias("visual_node_steps"), F.count_if(some("crop_image_path")).alias("crop_steps"), F.count_if(some("crop_image_path") & F.col("crop_exists")).alias("existing_crop_steps"), F.count_if(some("visual_caption")).alias("captioned_steps"), F.array_join(F.transform(F.array_sort(F.collect_set("page")), lambda p: p.cast("string")), ";").alias("source_pages"))
    out = questions.withColumn("visual_required", requires_visual()).join(own, "question_id", "left").join(cards.withColumn("card_exists", F.lit(True)), "question_id", "left")
    out = out.na.fill(0, ["chain_steps", "visual_node_steps", "crop_steps", "existing_crop_steps", "captioned_steps", "width", "height"]).na.fill(False, ["card_exists", "nonblank"]).na.fill("", ["source_pages"])
    c = F.col
    each = (
        ("missing_card", ~c("card_exists")), ("unexpected_card_size", (c("width") != CARD_SIZE[0]) | (c("height") != CARD_SIZE[1])), ("blank_or_unreadable_card", ~c("nonblank")),
        ("missing_question", ~some("question")), ("missing_answer", ~some("answer")), ("too_few_chain_steps", c("chain_steps") < 3), ("missing_existing_crop", c("existing_crop_steps") < 1),
        ("visual_required_without_visual_node", c("visual_required") & (c("visual_node_steps") < 1)), ("visual_required_without_caption", c("visual_required") & (c("captioned_steps") < 1)),
    )
    issues = F.array_compact(F.array(*[F.when(cond, name) for name, cond in each]))
    out = out.withColumn("issues", issues)
    status = F.when(F.arrays_overlap("issues", F.array(*map(F.lit, CARD_FAILS))), "fail").when(F.size("issues") > 0, "warn").otherwise("pass")
    return out.select("question_id", "visual_required", "card_exists", "chain_steps", "visual_node_steps", "crop_steps", "existing_crop_steps", "captioned_steps", "source_pages", status.alias("status"), F.array_join("issues", ";").alias("issues"))
