"""Evidence chains: the verifier of two rankings, the choice between them, and the merge of their chains."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from dossier.functions.text import is_toc_entry

#: Flags that call for correction (fixed values).
SEVERE = ("no_ranking", "no_chain", "missing_table", "missing_figure", "ungrounded_figure", "missing_cross_modal_pair", "visual_top1_for_text_query")


def _share(x: Column, y: Column) -> Column:
    return F.when(y > 0, x / y).otherwise(0.0)


def verify(runs: DataFrame) -> DataFrame:
    """Adds score, flags and needs_correction to each question's run.

    runs: wants_table, wants_figure, wants_cross; kinds (of the first five and the steps), top_kind, grounded, n_rows, n_steps, n_related,
    sim, chain, visual (scores of the first), routes (of the first five), margin (of the first two's scores)."""
    has = lambda *k: F.arrays_overlap("kinds", F.array(*map(F.lit, k)))
    table, figure, text = has("table"), has("figure", "caption"), has("text")
    t, f, c = F.col("wants_table"), F.col("wants_figure"), F.col("wants_cross")
    looks = t | f | c
    grounded = F.col("grounded")
    each = [(t, table), (f, figure & grounded), (c, text & (table | figure) & (~f | grounded)), (~looks, text)]
    need = sum((w.cast("int") for w, _ in each[1:]), each[0][0].cast("int"))
    met = sum(((w & s).cast("int") for w, s in each[1:]), (each[0][0] & each[0][1]).cast("int"))
    required = met / F.greatest(F.lit(1), need)
    visual_top = F.col("top_kind").isin("table", "figure", "caption")
    top = F.when(t & (F.col("top_kind") == "table"), 1.0).when(f & F.col("top_kind").isin("figure", "caption"), 1.0).when(~looks & (F.col("top_kind") == "text"), 1.0).when(F.col("top_kind") == "text", 0.65).when(visual_top & looks, 0.72).otherwise(0.0)
    semantic = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.55 * F.col("sim") + 0.25 * F.col("chain") + 0.2 * F.col("visual")))
    steps = F.when(F.col("n_steps") > 0, F.least(F.lit(1.0), F.col("n_steps") / 4)).otherwise(F.least(F.lit(0.5), F.least(F.col("n_rows"), F.lit(5)) / 10))
    margin = F.when(F.col("n_rows") >= 2, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("margin") * 3))).when(F.col("n_rows") == 1, 0.2).otherwise(0.0)
    related = F.when(F.col("n_steps") > 1, F.col("n_related") / (F.col("n_steps") - 1)).otherwise(0.0)
    score = 0.34 * required + 0.22 * semantic + 0.14 * steps + 0.10 * related + 0.08 * top + 0.07 * F.least(F.lit(1.0), F.col("routes") / 5) + 0.05 * margin
    flag = lambda name, cond: F.when(cond, name)
    flags = F.array(flag("no_ranking", F.col("n_rows") == 0), flag("no_chain", F.col("n_steps") == 0), flag("missing_table", t & ~table), flag("missing_figure", f & ~figure), flag("ungrounded_figure", f & figure & ~grounded), flag("missing_cross_modal_pair", c & ~(text & (table | figure))), flag("visual_top1_for_text_query", ~looks & visual_top), flag("low_semantic_confidence", semantic < 0.42), flag("requirement_not_satisfied", required < 1))
    out = runs.withColumn("score", F.round(score, 6)).withColumn("flags", F.filter(flags, lambda x: x.isNotNull()))
    return out.withColumn("needs_correction", severe(F.col("flags")) | (F.col("score") < 0.58))


def severe(flags: Column) -> Column:
    return F.arrays_overlap(flags, F.array(*map(F.lit, SEVERE)))


def choose(pairs: DataFrame, min_gain: float = 0.06) -> DataFrame:
    """Adds `source`: primary, fallback or merge. pairs: p_score, f_score, p_flags, f_flags."""
    bad = lambda c: F.size(F.array_intersect(F.col(c), F.array(*map(F.lit, SEVERE))))
    p, f = F.col("p_score"), F.col("f_score")
    fixed = (bad("p_flags") > 0) & (bad("f_flags") < bad("p_flags"))
    source = F.when(F.array_contains("p_flags", "visual_top1_for_text_query") & (bad("f_flags") == 0) & (f >= p - 0.02), "fallback").when((p < 0.52) & fixed & (f >= p + min_gain), "fallback")
    return pairs.withColumn("source", source.when(fixed & (f >= p - 0.04), "merge").when((p < 0.50) & (f >= p + 0.02), "fallback").otherwise("primary"))


def merge(primary: Column, fallback: Column, needed: Column, most: int = 5, added: int = 2) -> Column:
    """The primary chain with up to two of the fallback's steps of the needed kinds that it lacks; trailing steps make room, the first stays.

    Chains are arrays of struct<node_id, node_type>; an empty chain gives way to the other."""
    own = F.transform(primary, lambda s: s["node_id"])
    new = F.filter(fallback, lambda s: ~F.array_contains(own, s["node_id"]) & ((F.size(needed) == 0) | F.array_contains(needed, s["node_type"])))
    new = F.slice(new, 1, added)
    room = F.greatest(F.lit(1), most - F.size(new))
    return F.when(F.size(primary) == 0, fallback).otherwise(F.concat(F.slice(primary, F.lit(1), room), new))


def build(ranked: DataFrame, nodes: DataFrame, links: DataFrame, most: int = 5) -> DataFrame:
    """(question_id, step, node_id, role): each question's evidence chain of at most `most` different nodes.

    Steps come by phases: the best node that is no page and no entry of a table of contents; nodes with a reference score; the best
    visual on the page of the first three, where the question wants one; other visuals by reference, bridge and score; the first
    node's neighbours by relation; the other texts by rank. A node takes the first phase it is in.
    ranked: (question_id, node_id, rank, score, bridge, ref, wants_visual); links: (x, y, relation) both ways."""
    info = nodes.select("node_id", "doc_id", "page", "node_type", is_toc_entry(F.col("content")).alias("toc")).where("not toc")
    rows = ranked.join(info, "node_id").where("node_type <> 'page'")
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("rank", "node_id"))
    rows = rows.withColumn("n", place)
    visual = F.col("node_type").isin("table", "figure", "caption")
    step = lambda df, phase, role, *order: df.select("question_id", "node_id", F.lit(phase).alias("phase"), F.lit(role).alias("role"), F.struct(*[(o if isinstance(o, Column) else F.col(o)).cast("double").alias(f"o{i}") for i, o in enumerate((*order, *[F.lit(0)] * (3 - len(order))))]).alias("o"))
    main = rows.where("n = 1")
    pages = rows.where("n <= 3").select("question_id", "doc_id", "page").distinct()
    near = rows.where(visual & F.col("wants_visual")).join(pages, ["question_id", "doc_id", "page"], "left_semi")
    near = near.withColumn("v", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "rank", "node_id"))).where("v = 1")
    around = main.select("question_id", F.col("node_id").alias("x")).join(links, "x").select("question_id", F.col("y").alias("node_id"), "relation").join(info.select("node_id", "node_type"), "node_id").where("node_type <> 'page'")
    around = around.withColumn("v", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("relation"), "node_id"))).where("v <= 8")
    every = step(main, 1, "main", "n")
    for part in (step(rows.where("ref > 0"), 2, "reference", "n"), step(near, 4, "visual_companion", "n"), step(rows.where(visual), 5, "visual", -F.col("ref"), -F.col("bridge"), -F.col("score")), step(around, 7, "graph_neighbor", "v"), step(rows.where("node_type = 'text'"), 8, "context", "n")):
        every = every.unionByName(part)
    first = every.groupBy("question_id", "node_id").agg(F.min(F.struct("phase", "o", "role")).alias("m"))
    order = F.row_number().over(Window.partitionBy("question_id").orderBy("m.phase", "m.o", "node_id")).cast("long")
    return first.withColumn("step", order).where(F.col("step") <= most).select("question_id", "step", "node_id", "m.role")
