"""Connected components of links in DataFrames: min-label hooking, then pointer jumping. Nothing is collected but row counts."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import materialize, release


def roots(parents: DataFrame) -> DataFrame:
    """(v, comp) of a forest (v, comp) whose comp is smaller than v or v itself: follows each pointer to its end, doubling its reach each round."""
    parents = materialize(parents, "forest")
    while True:
        up = parents.where("v <> comp").select(F.col("v").alias("comp"), F.col("comp").alias("above"))
        step = materialize(parents.join(up, "comp", "left").select("v", F.coalesce("above", "comp").alias("comp"), F.col("above").isNotNull().alias("moved")), "forest")
        moved = step.where("moved").limit(1).count()
        release(parents)
        parents = step.drop("moved")
        parents.dossier_path = step.dossier_path
        if not moved:
            return parents


def with_tops(down: DataFrame) -> DataFrame:
    """A forest's (v, comp), each v once and below its comp, with a row for each comp that is no v."""
    tops = down.select(F.col("comp").alias("v")).distinct().join(down.select("v"), "v", "left_anti")
    return down.select("v", "comp").unionByName(tops.select("v", F.col("v").alias("comp")))


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(v, comp) for every v of the links (a, b) and of the given labels; comp is the smallest v of the component.

    labels: (v, comp) found before, comp being the smallest v of its class. Every round at least halves the classes that still have a link outwards."""
    ends = links.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    if labels is None:
        labels = ends.select("v", F.col("v").alias("comp"))
    else:
        labels = ends.join(labels, "v", "full").select("v", F.coalesce("comp", "v").alias("comp"))
    labels = materialize(labels, "labels")
    rest = links
    while True:
        a, b = labels.select(F.col("v").alias("a"), F.col("comp").alias("x")), labels.select(F.col("v").alias("b"), F.col("comp").alias("y"))
        between = rest.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        between = materialize(between, "between")
        if not between.limit(1).count():
            release(between)
            return labels
        down = between.select(F.col("b").alias("v"), F.col("a").alias("comp"))
        top = roots(with_tops(down.groupBy("v").agg(F.min("comp").alias("comp"))))
        new = labels.join(top.select(F.col("v").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("v", F.coalesce("top", "comp").alias("comp"))
        new = materialize(new, "labels")
        release(labels, top, *([rest] if rest is not links else []))
        labels, rest = new, between
