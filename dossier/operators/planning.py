"""Plans of questions, as projections over understand()'s columns: the query plan, weights of routes, limits, profiles of ranking and of the graph.

Each plan is a table of fixed values by route or profile and a few conditions on the question's flags; maps are literal columns."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from dossier.functions import lexicon as L
from dossier.functions.text import document_refs, holds_any

ROUTES = ("lexical", "bm25", "embedding", "product", "kg", "section", "reference", "visual", "table_structure", "layout")

# The query plan of each adaptive route. Strategy, multipliers of routes, what an answer must do.
STRATEGY = {"structured_table": "table_first", "visual_grounding": "visual_first", "cross_modal": "cross_modal_bridge", "multihop_graph": "graph_bridge", "after_sales_visual": "policy_or_manual", "after_sales_policy": "policy_or_manual", "text_fact": "text_precision", "general_text": "balanced"}
MULTIPLIERS = {
    "structured_table": {"table_structure": 1.55, "bm25": 1.16, "lexical": 1.08, "embedding": 0.92, "visual": 0.35, "layout": 0.2, "kg": 0.3},
    "visual_grounding": {"visual": 1.45, "layout": 1.25, "embedding": 1.05, "section": 1.08},
    "cross_modal": {"visual": 1.35, "table_structure": 1.30, "section": 1.25},
    "multihop_graph": {"section": 1.30, "embedding": 1.05, "visual": 0.72},
    "after_sales_visual": {"bm25": 1.12, "lexical": 1.08, "section": 1.22},
    "after_sales_policy": {"bm25": 1.12, "lexical": 1.08, "section": 1.22},
    "text_fact": {"bm25": 1.15, "lexical": 1.08, "embedding": 0.92, "visual": 0.35, "layout": 0.35, "table_structure": 0.55, "kg": 0.65},
    "general_text": {"embedding": 1.08, "bm25": 1.04, "visual": 0.72, "layout": 0.72},
}
REQUIREMENTS = {"structured_table": ("preserve_numbers", "explain_table_basis"), "visual_grounding": ("mention_visual_evidence", "keep_pic_marker"), "cross_modal": ("combine_modalities", "keep_pic_marker"), "multihop_graph": ("show_reasoning_path",), "after_sales_visual": ("actionable_steps", "avoid_unverified_policy"), "after_sales_policy": ("actionable_steps", "avoid_unverified_policy")}

# Weights of routes, and what the primary profile puts in their place.
WEIGHTS = {"lexical": 1.12, "bm25": 1.7, "embedding": 0.7, "section": 0.38, "visual": 0.12, "table_structure": 0.18, "layout": 0.05}
PROFILE_WEIGHTS = {
    "policy": {"lexical": 1.08, "bm25": 1.58, "embedding": 0.68, "product": 0.0, "section": 0.9, "visual": 0.08, "layout": 0.05},
    "manual": {"lexical": 1.16, "bm25": 1.78, "embedding": 0.72, "section": 0.62},
    "troubleshooting": {"lexical": 1.16, "bm25": 1.78, "embedding": 0.72, "section": 0.62},
    "manual_visual": {"lexical": 1.08, "bm25": 1.5, "embedding": 0.68, "visual": 0.55, "layout": 0.22, "section": 0.62},
    "structured_table": {"lexical": 1.2, "bm25": 2.05, "embedding": 0.88, "product": 0.0, "kg": 0.0, "section": 0.18, "visual": 0.06, "table_structure": 1.35, "layout": 0.0},
    "visual": {"visual": 0.7},
}
# G4's profile of each route, beside the defaults.
G4 = {"retrieval_anchor": 0.12, "visual_min": 0.0, "visual_max": 0.12, "chain_min": 0.0, "chain_max": 0.14, "domain_min": 0.0, "product_min": 0.0, "kg_min": 0.0, "kg_max": 0.08, "model_max": 0.16}
G4_ROUTES = {
    "structured_table": {"retrieval_anchor": 0.30, "visual_max": 0.0, "chain_min": 0.02, "chain_max": 0.04, "kg_max": 0.0, "model_max": 0.08},
    "multihop_graph": {"retrieval_anchor": 0.08, "chain_min": 0.10, "chain_max": 0.16, "kg_min": 0.02, "kg_max": 0.08, "visual_max": 0.03},
    "visual_grounding": {"retrieval_anchor": 0.05, "visual_min": 0.08, "visual_max": 0.14, "chain_min": 0.08, "chain_max": 0.14, "kg_max": 0.04},
    "cross_modal": {"retrieval_anchor": 0.05, "visual_min": 0.08, "visual_max": 0.14, "chain_min": 0.08, "chain_max": 0.14, "kg_max": 0.04},
    "after_sales_visual": {"retrieval_anchor": 0.14, "domain_min": 0.10, "product_min": 0.04, "kg_max": 0.06, "chain_min": 0.08, "chain_max": 0.12},
    "after_sales_policy": {"retrieval_anchor": 0.14, "domain_min": 0.10, "product_min": 0.04, "kg_max": 0.06, "chain_min": 0.08, "chain_max": 0.12},
    "text_fact": {"retrieval_anchor": 0.22, "visual_max": 0.02, "chain_max": 0.035, "kg_max": 0.02, "model_max": 0.08},
}
# Weights of kinds of nodes and of relations by what a question wants, each step over the one before.
KINDS = {"text": 1.0, "caption": 0.8, "table": 0.5, "figure": 0.5, "page": 0.1}
KINDS_WANTED = (
    ("wants_table", {"table": 1.6, "caption": 1.1, "text": 0.9, "figure": 0.2, "page": 0.05}),
    ("wants_figure", {"figure": 1.6, "caption": 1.2, "text": 0.9, "table": 0.25, "page": 0.05}),
    ("wants_cross", {"text": 1.1, "table": 1.2, "figure": 1.2, "caption": 1.1, "page": 0.05}),
    ("wants_location", {"text": 1.0, "table": 1.0, "figure": 1.0, "caption": 1.2, "page": 0.4}),
)
KINDS_STRUCTURED = {"text": 1.25, "table": 1.35, "caption": 0.35, "figure": 0.05, "page": 0.03}
RELATIONS_WANTED = (
    ("wants_table", {"text_ref_table": 1.5, "table_caption": 1.4, "same_page": 0.03}),
    ("wants_figure", {"text_ref_figure": 1.5, "figure_caption": 1.4, "same_page": 0.03}),
    ("wants_cross", {"text_ref_table": 1.5, "text_ref_figure": 1.5, "table_caption": 1.4, "figure_caption": 1.4, "same_page": 0.04}),
    ("wants_location", {"belongs_to_page": 0.2, "same_page": 0.04}),
)
RELATIONS_STRUCTURED = {"text_ref_table": 0.8, "table_caption": 0.55, "same_page": 0.02, "same_section": 0.05, "chunk_sequence": 0.04}


def literal_map(d: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def by_key(table: dict[str, float], key: Column, default: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(table), key), default) if table else default


def wants_more(questions: DataFrame) -> DataFrame:
    """The graph's looser wants: also the words themselves, anywhere in the question or its type."""
    t, q = F.col("t"), F.col("q")
    out = questions.withColumn("wants_table", F.col("wants_table") | holds_any(t, ("表格",)) | holds_any(q, ("table", "表")))
    out = out.withColumn("wants_figure", F.col("wants_figure") | holds_any(t, ("图表", "图文")) | holds_any(q, ("figure", "fig.", "图", "chart")))
    out = out.withColumn("wants_cross", F.col("wants_cross") | holds_any(t, ("跨模态",)) | (holds_any(q, ("结合",)) & (F.col("wants_table") | F.col("wants_figure"))))
    return out.withColumn("wants_location", F.col("wants_location") | holds_any(t, ("证据定位",)) | holds_any(q, ("定位", "页")))


def graph_profile(questions: DataFrame) -> DataFrame:
    """Adds kind_weights and relation_weights, maps of node kinds and relations to what they are worth for the question."""
    wants = wants_more(questions).select("question_id", "wants_table", "wants_figure", "wants_cross", "wants_location", "structured")

    def column(base: dict[str, float], steps: tuple, structured: dict[str, float]) -> Column:
        parts = []
        for k, v in base.items():
            value = F.lit(v)
            for want, over in steps:
                if k in over:
                    value = F.when(F.col(want), over[k]).otherwise(value)
            parts += [F.lit(k), F.when(F.col("structured"), structured.get(k, v)).otherwise(value)]
        return F.create_map(*parts)

    maps = wants.select("question_id", column(KINDS, KINDS_WANTED, KINDS_STRUCTURED).alias("kind_weights"), column(L.RELATION_WEIGHTS, RELATIONS_WANTED, RELATIONS_STRUCTURED).alias("relation_weights"))
    return questions.join(maps, "question_id")


def graph_multipliers(questions: DataFrame) -> DataFrame:
    """Adds ppr_mult, bridge_mult and ref_mult: how much of the graph's signals and of references a question takes."""
    t, q, table, figure = F.col("t"), F.col("q"), F.col("wants_table"), F.col("wants_figure")
    plain = holds_any(t, ("文本事实", "证据定位"))
    says_table, says_chart, says_figure = holds_any(t, ("表格",)) | holds_any(q, ("table", "表")), holds_any(t, ("图表理解",)) | holds_any(q, ("chart",)), holds_any(q, ("figure", "fig.", "图"))
    agree, cross = holds_any(t, ("图文一致性",)), holds_any(t, ("跨模态",))
    cases = ((F.col("structured"), 0.1, 0.25), (plain, 0.0, 0.0), (F.col("wants_cross") & (table | figure), 0.75, 1.0), (table & figure, 0.85, 1.0), (table, 0.8, 0.85), (figure, 0.75, 0.85), (says_table, 1.0, 0.8), (says_chart, 1.0, 1.0), (agree, 0.2, 0.0), (cross, 0.1, 1.0), (says_figure, 0.5, 0.6), (F.lit(True), 0.0, 0.0))
    refs = ((F.col("structured"), F.when(F.col("has_refs"), 0.8).otherwise(0.0)), (plain, F.lit(0.0)), (table & figure, F.lit(1.2)), (table, F.lit(1.3)), (figure, F.lit(1.1)), (says_table, F.lit(1.5)), (says_chart, F.lit(1.0)), (agree, F.lit(1.5)), (cross, F.lit(0.2)), (says_figure, F.lit(1.0)))
    first = lambda pairs: F.coalesce(*[F.when(c, v) for c, v in pairs], F.lit(0.0))
    return questions.withColumn("ppr_mult", first([(c, F.lit(p)) for c, p, _ in cases])).withColumn("bridge_mult", first([(c, F.lit(b)) for c, _, b in cases])).withColumn("ref_mult", first(refs))


def query_plan(questions: DataFrame) -> DataFrame:
    """Adds has_refs, strategy, modalities, answer (requirements), context_expansion, rerank_boost, graph_boost and x_<route>, the multipliers of routes.

    questions: understand()'s, with has_kg where entities of a knowledge graph are named (else false)."""
    out = questions if "has_kg" in questions.columns else questions.withColumn("has_kg", F.lit(False))
    out = out.withColumn("has_refs", F.size(document_refs(F.col("question"))) > 0)
    route, refs, kg, table = F.col("route"), F.col("has_refs"), F.col("has_kg"), F.col("wants_table")
    some = lambda cond, *names: F.when(cond, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    kinds = F.array_distinct(F.concat(F.array(F.lit("text")), some(table | (route == "structured_table"), "table"), some(F.col("wants_figure") | F.col("wants_location"), "figure", "caption"), some(F.col("wants_cross"), "table", "figure", "caption")))
    needs = F.concat(F.array(F.lit("cite_evidence")), *[some(route == r, *names) for r, names in REQUIREMENTS.items()], some(F.col("wants_visual"), "verify_visual_support"))
    fixed = {r: by_key({k: m[r] for k, m in MULTIPLIERS.items() if r in m}, route, F.lit(1.0)) for r in ROUTES}
    after = route.startswith("after_sales")
    fixed["reference"] = F.when(refs, F.when(route == "visual_grounding", 1.18).when(route == "cross_modal", 1.20).when(route == "multihop_graph", 1.15).otherwise(1.0)).when(route == "cross_modal", 1.05).otherwise(1.0)
    fixed["reference"] = F.greatest(fixed["reference"], F.when(refs, 1.35))
    fixed["table_structure"] = F.when(route == "visual_grounding", F.when(table, 1.22).otherwise(0.76)).otherwise(fixed["table_structure"])
    fixed["kg"] = F.when(route == "cross_modal", F.when(kg, 1.08).otherwise(0.9)).when(route == "multihop_graph", F.when(kg, 1.45).otherwise(1.05)).when(after & kg, 1.18).otherwise(fixed["kg"])
    fixed["product"] = F.when(after, F.when(F.col("has_product"), 1.20).otherwise(0.85)).otherwise(1.0)
    fixed["visual"] = F.when(after, F.when(F.col("wants_visual"), 1.20).otherwise(0.62)).otherwise(fixed["visual"])
    fixed["layout"] = F.greatest(fixed["layout"], F.when(F.col("wants_location"), 1.35))
    out = out.withColumns({"strategy": F.element_at(F.create_map(*[F.lit(x) for kv in STRATEGY.items() for x in kv]), route), "modalities": kinds, "answer": F.array_distinct(needs)})
    out = out.withColumns({"context_expansion": refs | route.isin("visual_grounding", "cross_modal", "multihop_graph") | (after & F.col("wants_visual")), "rerank_boost": route != "text_fact", "graph_boost": route.isin("cross_modal", "multihop_graph")})
    return out.withColumns({f"x_{r}": c.cast("double") for r, c in fixed.items()})


def plan_summary() -> Column:
    return F.concat(F.lit("route="), "route", F.lit(";strategy="), "strategy", F.lit(";modalities="), F.array_join("modalities", ","), F.lit(";answer="), F.array_join("answer", ","))


def route_weights(plans: DataFrame) -> DataFrame:
    """Adds w_<route>, the weights of routes by the question's profile and plan. plans: query_plan()'s, with kg_weight where there is a knowledge graph."""
    table, figure, cross, place = F.col("wants_table"), F.col("wants_figure"), F.col("wants_cross"), F.col("wants_location")
    primary, structured, refs, product = F.col("profile"), F.col("structured"), F.col("has_refs"), F.col("has_product")
    out = plans if "kg_weight" in plans.columns else plans.withColumn("kg_weight", F.lit(0.0))
    base = {r: F.lit(v) for r, v in WEIGHTS.items()} | {"product": F.when(product, 0.8).otherwise(0.0), "kg": F.least(F.lit(0.04), F.col("kg_weight")), "reference": F.when(refs, 0.95).otherwise(0.35)}
    w = {r: by_key({p: d[r] for p, d in PROFILE_WEIGHTS.items() if r in d}, primary, base[r]) for r in ROUTES}
    # A null is no bound: greatest() and least() skip it.
    manual, looks, loose = primary.isin("manual", "troubleshooting"), primary == "visual", ~structured
    w["product"] = F.greatest(w["product"], F.when(manual, F.when(product, 0.55).otherwise(0.18)))
    w["visual"] = F.greatest(w["visual"], F.when(manual, 0.28))
    w["reference"] = F.when(primary == "structured_table", F.when(refs, 0.3).otherwise(0.12)).otherwise(F.greatest(w["reference"], F.when(primary == "manual_visual", 0.65).when(looks, 0.9)))
    w["table_structure"] = F.when(looks, F.when(table, 0.72).otherwise(0.22)).otherwise(w["table_structure"])
    w["layout"] = F.greatest(w["layout"], F.when(looks, 0.28))
    fact = primary == "text_fact"
    w["visual"], w["layout"] = w["visual"] * F.when(fact, 0.25).otherwise(1.0), w["layout"] * F.when(fact, 0.3).otherwise(1.0)
    w["bm25"], w["embedding"] = F.greatest(w["bm25"], F.when(fact, 1.85)), F.least(w["embedding"], F.when(fact, 0.62))
    w["visual"] = F.greatest(w["visual"], F.when((table | figure) & loose, 0.62), F.when(cross & loose, 0.55))
    w["table_structure"] = F.greatest(w["table_structure"], F.when(table & loose, 0.88), F.when(cross & loose, F.when(table, 0.72).otherwise(0.28)), F.when(structured, 1.35))
    w["reference"] = F.greatest(w["reference"], F.when((table | figure) & loose, 0.8))
    w["section"] = F.greatest(w["section"], F.when(cross & loose, 0.62))
    w["layout"] = F.when(place & loose, 0.4).otherwise(w["layout"])
    told = F.col("text_fact")
    w["visual"], w["layout"] = w["visual"] * F.when(told, 0.35).otherwise(1.0), w["layout"] * F.when(told, 0.4).otherwise(1.0)
    w["visual"] = F.least(w["visual"], F.when(structured, 0.06))
    w["layout"], w["kg"] = F.when(structured, 0.0).otherwise(w["layout"]), F.when(structured, 0.0).otherwise(w["kg"])
    return out.withColumns({f"w_{r}": F.round(c.cast("double") * F.col(f"x_{r}"), 9) for r, c in w.items()})


def precision_weights(weighed: DataFrame) -> DataFrame:
    """Adds p_<route>: route_weights() with embeddings as the anchor, for the precision profile of several routes."""
    route, table = F.col("route"), F.col("wants_table")
    plain = route.isin("general_text", "text_fact")
    is_ = lambda r: route == r
    times = {
        "embedding": 1.35 * F.when(plain, 1.18).when(is_("visual_grounding"), 1.05).when(is_("cross_modal"), 1.02).otherwise(1.0),
        "bm25": 0.72 * F.when(is_("structured_table"), 0.95).when(is_("cross_modal"), 0.92).otherwise(1.0),
        "lexical": F.lit(0.72),
        "section": 0.82 * F.when(is_("multihop_graph"), 1.1).otherwise(1.0),
        "visual": F.when(plain | is_("structured_table"), 0.45).when(is_("visual_grounding"), 1.18).when(is_("cross_modal"), 1.12).otherwise(1.0),
        "table_structure": F.when(plain, 0.45).when(is_("structured_table"), 1.28).when(is_("visual_grounding"), F.when(table, 1.05).otherwise(0.5)).when(is_("cross_modal"), 1.15).otherwise(1.0),
        "kg": F.when(is_("multihop_graph"), 1.25).otherwise(1.0),
    }
    return weighed.withColumns({f"p_{r}": F.round(F.col(f"w_{r}") * times.get(r, F.lit(1.0)), 9) for r in ROUTES})


def route_limits(plans: DataFrame, base: int = 80) -> DataFrame:
    """Adds n_<route>: how many nodes each route may bring."""
    part = lambda least, by: F.lit(max(least, base // by))
    few = {
        "visual": (~F.col("wants_visual"), part(8, 4)),
        "layout": (~F.col("wants_visual"), part(8, 4)),
        "table_structure": (~(F.col("wants_table") | F.col("wants_cross") | F.col("structured")), part(8, 5)),
        "kg": (~(F.col("hops") | (F.size("sales") > 0)), part(8, 3)),
        "reference": (~F.col("has_refs"), part(12, 3)),
    }
    return plans.withColumns({f"n_{r}": F.when(*few[r]).otherwise(F.lit(base)) if r in few else F.lit(base) for r in ROUTES})


def anchor_weight(plans: DataFrame) -> DataFrame:
    """Adds bm25_anchor: how far fused scores are drawn to BM25."""
    return plans.withColumn("bm25_anchor", F.when(F.col("structured"), 0.54).when(F.col("text_fact"), 0.46).when(F.col("wants_table") | F.col("wants_figure") | F.col("wants_location"), 0.12).when(F.col("wants_cross"), 0.30).otherwise(0.38))


def g4_profile(questions: DataFrame) -> DataFrame:
    """Adds g4_<name>, the bounds of G4's weights."""
    return questions.withColumns({f"g4_{k}": by_key({r: d[k] for r, d in G4_ROUTES.items() if k in d}, F.col("route"), F.lit(v)) for k, v in G4.items()})
