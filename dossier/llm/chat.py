"""Conversations from reply trees: root-to-leaf paths by iterative self-joins, branches ranked by score, each chosen path formatted as one text.

Paths grow by doubling: after k self-joins a message knows its ancestor 2^k replies above it, so a tree of depth d takes
log2(d) joins up to the root, and as many from the chosen leaves over their paths. Messages whose parent is unknown or null are
roots. Messages on or below a cycle have no root and are in no conversation.

The template opens a turn with <|im_start|>role and a line feed, and ends it with <|im_end|> and a line feed. Texts and roles have
each backslash doubled, and a backslash put after the first character of each control string of common templates, so no text
can end its turn, and taking backslashes out gives it back. Null roles and texts are empty; texts of any length are kept whole. Rows
that repeat are turns of their own, in any order of equal ones. Null scores are 0. Empty tables give empty results. Other columns of
the caller are not read, whatever their names."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from .common import materialize, release

START, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings of common chat templates (fixed values).
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_HEAD = r"(?s)^<\|im_start\|>((?:[^\\\n]|\\.)*)\n"


def escape(c: Column) -> Column:
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for s in CONTROL:
        c = F.replace(c, F.lit(s), F.lit(f"{s[0]}\\{s[1:]}"))
    return c


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\\n"))


def best_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, id, depth, score) for each message on one of the `top` best root-to-leaf paths of its tree.

    messages: (tree, id, parent, score), tree and id not null and unique together. A path's score is the mean of its messages';
    ties go to the longer path, then to the smaller leaf."""
    spark = messages.sparkSession
    own = messages.select("tree", "id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = own.select("tree", F.col("id").alias("parent"), F.lit(True).alias("known"))
    step = own.join(known, ["tree", "parent"], "left").select("tree", "id", F.when(F.col("known"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("depth"), "score")
    steps, waiting = [materialize(step, "paths")], None
    while True:
        now = steps[-1]
        left = now.where("up is not null").count()
        if left == 0 or left == waiting:
            break
        waiting = left
        above = now.select("tree", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("score").alias("score2"))
        # Messages that have reached their root are not joined again.
        step = now.where("up is not null").join(above, ["tree", "up"], "left").select("tree", "id", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), (F.col("score") + F.coalesce("score2", F.lit(0.0))).alias("score"))
        step = now.where("up is null").unionByName(step)
        steps.append(materialize(step, "paths"))
    done = steps[-1].where("up is null").select("tree", "id", "depth", (F.col("score") / F.col("depth")).alias("score"))
    leaves = done.join(steps[0].select("tree", F.col("up").alias("id")).where("id is not null").distinct(), ["tree", "id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("depth"), "id"))
    paths = materialize(leaves.withColumn("rank", rank).where(F.col("rank") <= top).select("tree", F.col("id").alias("leaf"), "id", F.col("score").alias("total")), "chosen")
    for now in steps[:-1]:
        up = paths.join(now.where("up is not null").select("tree", "id", "up"), ["tree", "id"]).select("tree", "leaf", F.col("up").alias("id"), "total")
        new = materialize(paths.unionByName(up), "chosen")
        release(paths)
        paths = new
    out = materialize(paths.join(done.select("tree", "id", "depth"), ["tree", "id"]).select("tree", "leaf", "id", "depth", F.col("total").alias("score")), "best")
    release(paths, *steps)
    return out


def format_paths(paths: DataFrame, messages: DataFrame, learned: str = "assistant") -> DataFrame:
    """(tree, leaf, score, formatted, mask): one text for each path, and the spans (start, length, in code points) of the learned role's texts."""
    turns = paths.join(messages.select("tree", "id", "role", "text"), ["tree", "id"])
    turns = turns.withColumn("head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))).withColumn("body", escape(F.col("text"))).withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = F.coalesce(F.sum(F.length("piece")).over(Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    span = F.when(F.col("role") == learned, F.struct((before + F.length("head")).alias("start"), F.length("body").cast("long").alias("length")))
    turns = turns.withColumn("span", span)
    rows = turns.groupBy("tree", "leaf").agg(F.max("score").alias("score"), F.array_sort(F.collect_list(F.struct("depth", "piece", "span"))).alias("t"))
    return rows.select("tree", "leaf", "score", F.array_join("t.piece", "").alias("formatted"), F.filter(F.col("t.span"), lambda x: x.isNotNull()).alias("mask"))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(pieces, lambda p: F.struct(unescape(F.regexp_extract(p, _HEAD, 1)).alias("role"), unescape(F.regexp_replace(p, _HEAD, "")).alias("text")))


def learned_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def reply_chains(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages of linear conversations: each row replies to the one before it by turn (null first), equal turns by role and text.

    A null conversation id is a conversation of its own."""
    order = Window.partitionBy(conv).orderBy(F.col(turn).asc_nulls_first(), F.col(role).asc_nulls_first(), F.col(text).asc_nulls_first())
    id_ = F.row_number().over(order).cast("long")
    out = rows.select(F.struct(F.col(conv)).alias("tree"), F.col(role).alias("role"), F.col(text).alias("text"), id_.alias("id"))
    return out.withColumn("parent", F.when(F.col("id") > 1, F.col("id") - 1)).withColumn("score", F.lit(0.0))
