"""Routes that adjust a lexical score by what a node is and what a question wants.

pairs: (question_id, node_id, lexical, node_type, and the question's flags wants_table, wants_figure, wants_cross, wants_location, wants_visual,
structured, numeric; and of the node bbox, captioned, section_hit, structure_type, has_headers, has_facts, has_numbers, page_image, crop_image, parsed)."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from dossier.functions.lexicon import VISUAL_TYPES


def _plus(cond: Column, x: float) -> Column:
    return F.when(cond, x).otherwise(0.0)


def section(lexical: Column) -> Column:
    kind = F.col("structure_type")
    return lexical + _plus(F.col("node_type") == "title", 0.08) + _plus((kind != "") & (kind != "section_title"), 0.08) + _plus(F.col("section_hit"), 0.12)


def visual(lexical: Column) -> Column:
    t = F.col("node_type")
    score = lexical + _plus(F.col("wants_table") & (t == "table"), 0.35) + _plus(F.col("wants_figure") & t.isin("figure", "caption"), 0.35) + _plus(t.isin(*VISUAL_TYPES), 0.15) + _plus(F.col("bbox"), 0.05) + _plus(F.col("captioned"), 0.08)
    return F.when(F.col("wants_visual"), score).otherwise(0.0)


def table(lexical: Column) -> Column:
    t = F.col("node_type")
    own = lexical + 0.32 + _plus(F.col("has_headers"), 0.10) + _plus(F.col("has_facts"), 0.10) + _plus(F.col("numeric") & F.col("has_numbers"), 0.12) + _plus(F.col("structured"), 0.12)
    score = F.when(t == "table", own).when(t == "caption", 0.72 * lexical + 0.04).when(t == "text", 0.58 * lexical).when(t == "figure", 0.45 * lexical).otherwise(lexical)
    return F.when(F.col("structured") | F.col("wants_table") | F.col("wants_cross"), score).otherwise(0.0)


def layout() -> Column:
    score = _plus(F.col("bbox"), 0.35) + _plus(F.col("page_image"), 0.15) + _plus(F.col("crop_image"), 0.2) + _plus(F.col("parsed"), 0.1)
    return F.when(F.col("wants_location"), score).otherwise(0.0)


def all_routes(pairs: DataFrame) -> DataFrame:
    """(question_id, route, node_id, score) of the routes that score some node of a question above 0: a question's all-zero routes are left out."""
    lexical = F.col("lexical")
    each = F.array(*[F.struct(F.lit(n).alias("route"), s.cast("double").alias("score")) for n, s in (("lexical", lexical), ("section", section(lexical)), ("visual", visual(lexical)), ("table", table(lexical)), ("layout", layout()))])
    long = pairs.select("question_id", "node_id", F.explode(each).alias("e")).select("question_id", "e.route", "node_id", "e.score")
    live = long.groupBy("question_id", "route").agg(F.max("score").alias("m")).where("m > 0").select("question_id", "route")
    return long.join(live, ["question_id", "route"], "left_semi")


def domain_scores(texts: DataFrame, keywords: dict[str, tuple[str, ...]], strong: dict[str, tuple[str, ...]]) -> DataFrame:
    """Adds for each domain its keyword count, and domain: the best by keywords if a strong one occurs and the second is not as good, else general.

    texts: (id, text). Counts are of non-overlapping occurrences, letters' case aside."""
    low = F.lower("text")
    count = lambda words: sum(((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w) for w in words), F.lit(0.0)).cast("int")
    names = sorted(keywords)
    out = texts.select("id", *[count(keywords[n]).alias(f"k_{n}") for n in names], *[count(strong[n]).alias(f"s_{n}") for n in names])
    rank = F.array_sort(F.array(*[F.struct((-F.col(f"k_{n}")).alias("k"), F.lit(n).alias("name"), F.col(f"s_{n}").alias("s")) for n in names]))
    out = out.withColumn("r", rank).withColumn("first", F.col("r")[0]).withColumn("second", F.col("r")[1])
    weak, unsure = -F.col("first.k") < 2, (F.col("second.k") < 0) & (-F.col("first.k") < -1.15 * F.col("second.k")) & (F.col("first.s") <= F.col("second.s"))
    return out.select("id", *[f"k_{n}" for n in names], F.when(weak | (F.col("first.s") == 0) | unsure, "general").otherwise(F.col("first.name")).alias("domain"))
