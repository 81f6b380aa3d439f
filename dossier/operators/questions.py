"""Understanding of questions, as projections: intents, adaptive route, profile. Questions have question_id, question and question_type."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from dossier.functions import lexicon as L
from dossier.functions.text import casefold, clean_text, count_terms, has_any, holds_any

POLICY = ("return_refund", "invoice", "shipping_damage", "warranty_repair")
MANUAL = ("usage_operation", "spec_parts", "safety")


def intents(questions: DataFrame) -> DataFrame:
    """Adds q and t (casefolded question and type), blob, and the flags table, figure, cross, location, text_fact and visual."""
    out = questions.withColumn("q", casefold(clean_text(F.col("question")))).withColumn("t", casefold(clean_text(F.col("question_type"))))
    out = out.withColumn("blob", clean_text(F.concat_ws(" ", "t", "q")))
    image = F.contains(F.col("t"), F.lit("image")) | F.contains(F.col("t"), F.lit("figure"))
    out = out.withColumn("wants_table", has_any(F.col("blob"), L.TABLE_TERMS) | F.contains(F.col("t"), F.lit("table")))
    out = out.withColumn("wants_figure", has_any(F.col("blob"), L.FIGURE_TERMS) | image)
    out = out.withColumn("wants_cross", has_any(F.col("blob"), L.CROSS_MODAL_TERMS) | (F.col("wants_table") & F.col("wants_figure")))
    out = out.withColumn("wants_location", has_any(F.col("blob"), L.LOCATION_TERMS)).withColumn("text_fact", has_any(F.col("t"), L.TEXT_FACT_TERMS))
    return out.withColumn("wants_visual", has_any(F.col("t"), L.VISUAL_TYPE_TERMS) | F.col("wants_table") | F.col("wants_figure") | F.col("wants_cross") | F.col("wants_location"))


def structured_table() -> Column:
    tableish = holds_any(F.col("blob"), L.TABLEISH_TERMS)
    numeric = F.col("q").rlike(r"[$%]|\b\d+")
    return holds_any(F.col("t"), L.STRUCTURED_TYPE_TERMS) | (tableish & numeric & holds_any(F.col("q"), L.STRUCTURED_QUERY_TERMS))


def multihop() -> Column:
    hits = count_terms(F.col("q"), L.MULTIHOP_QUERY_TERMS, whole=False)
    names = F.regexp_count(clean_text(F.col("question")), F.lit(r"\b[A-Z][A-Za-z0-9&.'-]{2,}"))
    return holds_any(F.col("t"), L.MULTIHOP_TYPE_TERMS) | (hits >= 2) | ((hits >= 1) & (names >= 2))


def products() -> Column:
    """Whether a product group is named."""
    terms = tuple(dict.fromkeys([*L.PRODUCT_ALIASES, *(a for g in L.PRODUCT_ALIASES.values() for a in g)]))
    return has_any(F.col("blob"), terms, plural=False)


def after_sales(df: DataFrame) -> DataFrame:
    """Adds has_product, and sales: map of intent to min(1, .35 + .18 * hits); a lone generic intent without a manual or product is dropped."""
    out = df.withColumn("has_product", products()).withColumn("hinted", has_any(F.col("blob"), L.AFTER_SALES_HINTS))
    hits = F.array(*[F.struct(F.lit(k).alias("intent"), count_terms(F.col("blob"), v).alias("hits")) for k, v in L.AFTER_SALES_TERMS.items()])
    out = out.withColumn("hit", F.filter(hits, lambda h: h["hits"] > 0))
    lone = (F.size("hit") == 1) & F.element_at(F.concat(F.transform("hit", lambda h: h["intent"]), F.array(F.lit(""))), 1).isin("usage_operation", "spec_parts")
    out = out.withColumn("hit", F.when(lone & ~(F.col("hinted") | F.col("has_product")), F.filter("hit", lambda h: h["hits"] < 0)).otherwise(F.col("hit")))
    scores = F.transform("hit", lambda h: F.struct(h["intent"].alias("intent"), F.least(F.lit(1.0), 0.35 + 0.18 * h["hits"]).alias("score")))
    general = F.array(F.struct(F.lit("general_after_sales").alias("intent"), F.lit(0.45).alias("score")))
    return out.withColumn("sales", F.when((F.size("hit") == 0) & F.col("hinted"), general).otherwise(scores)).drop("hit")


def understand(questions: DataFrame) -> DataFrame:
    """The questions with their flags, adaptive route (seven values), primary profile and strongest after-sales score."""
    out = after_sales(intents(questions)).withColumn("structured", structured_table()).withColumn("hops", multihop())
    sold = F.size("sales") > 0
    route = F.when(F.col("structured"), "structured_table").when(F.col("hops"), "multihop_graph").when(sold & F.col("wants_visual"), "after_sales_visual").when(sold, "after_sales_policy")
    route = route.when(F.col("wants_cross"), "cross_modal").when(F.col("wants_table") | F.col("wants_figure") | F.col("wants_location"), "visual_grounding").when(F.col("text_fact"), "text_fact").otherwise("general_text")
    best = F.array_max(F.transform("sales", lambda s: s["score"]))
    first = F.element_at(F.transform(F.filter("sales", lambda s: s["score"] == best), lambda s: s["intent"]), 1)
    out = out.withColumn("route", route).withColumn("strongest", F.when(sold, first)).withColumn("sales_score", F.round(F.coalesce(best, F.lit(0.0)), 4))
    look = F.col("wants_table") | F.col("wants_figure") | F.col("wants_cross") | F.col("wants_location")
    primary = F.when(sold & F.col("strongest").isin(*POLICY) & ~F.col("has_product"), "policy").when(sold & (F.col("strongest") == "troubleshooting"), "troubleshooting")
    primary = primary.when(sold & F.col("strongest").isin(*MANUAL) & F.col("wants_visual"), "manual_visual").when(sold & F.col("strongest").isin(*MANUAL), "manual").when(sold, "after_sales")
    primary = primary.when(F.col("structured"), "structured_table").when(look, "visual").when(F.col("text_fact"), "text_fact").otherwise("general")
    return out.withColumn("profile", primary)
