"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words. Every document is taken floor(target / source size) whole times; what is left of the target
is filled by one more copy of some documents, in the order of (u / (1-u)) / (p / (1-p)), u being a hash of the id and p an
inclusion probability that grows with the root of the document's size. The sample has a fixed size, in words: it ends where
the words come nearest to the target. The cut is found from sums of 1024 rank classes for each source and one class's rows,
so no source is sorted in one task; with the cut known, taking is a map over the documents.

A null text or one without words has size 0 and is never taken. Null is a source of its own, the last. A null id counts as the
smallest; ids are whole numbers. Rows that repeat an id and size are taken or left together; other rows of equal rank go by id, then
size. Texts of any length are counted whole. An empty table gives an empty result. mix() replaces columns of the names it adds,
mixed() keeps all of the caller's columns; names that begin with __ are taken for its own."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from .common import materialize, n_words, release, small

WEIGHTS = (5, 2, 1)
#: No target and no document beyond so many times its size.
MOST = 3
CLASSES = 1024
#: A table of sources of up to so many rows is broadcast, a larger one is joined.
BROADCAST_ROWS = 100_000
#: The columns that mix() adds, in place of the caller's of these names.
ADDED = ("size", "source_size", "target", "copies", "taken")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight, target, roots) from (source, size): shares of all words by weight, capped at MOST times the source's size, the excess reshared."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("root")).alias("roots"))
    # Only sources are ordered in one task, a row each.
    by = by.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("place") - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("double"))
    whole, upto = Window.partitionBy(), Window.orderBy(F.col("source_size") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("left", (F.sum("source_size").over(whole) - MOST * F.coalesce(F.sum("source_size").over(upto), F.lit(0))).cast("double")).withColumn("heavy", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    # In the order of the size for each weight, sources are capped up to the first that is not.
    by = by.withColumn("capped", MOST * F.col("source_size") <= F.col("weight") * F.col("left") / F.col("heavy"))
    first = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("weight"), "place", "left", "heavy"))).over(whole)
    by = by.withColumn("first", first)
    capped = F.col("first").isNull() | F.col("capped")
    return by.select("source", "source_size", "roots", "weight", F.when(capped, (MOST * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.col("first.left") / F.col("first.heavy")).alias("target"))


def ranked(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """docs with __id, source, size, root and u."""
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    out = docs.withColumn("__source", F.col(source_col)).withColumn("__size", n_words(F.col(text_col))).withColumn("__u", (F.conv(F.substring(mark, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52))
    return out.withColumn("__root", F.floor(F.sqrt(F.col("__size").cast("double")) * 10)).withColumn("__id", F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))))


def with_rank(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Joins the sources' targets, and adds __copies (the certain ones), __need (words left), __q (the rank) and __class."""
    named = small(sources.select(*[F.col(c).alias("__of" if c == "source" else f"__{c}") for c in sources.columns if c != "weight"]), BROADCAST_ROWS)
    out = rows.join(named, F.col("__source").eqNullSafe(F.col("__of"))).drop("__of")
    size = F.col("__source_size")
    out = out.withColumn("__copies", F.when(size > 0, F.floor(F.col("__target") / size)).otherwise(0)).withColumn("__need", F.col("__target") - F.col("__copies") * size)
    p = F.when(F.col("__roots") > 0, F.col("__need") * F.col("__root") / F.col("__roots")).otherwise(0.5)
    p = F.least(F.lit(0.999), F.greatest(F.lit(0.001), p))
    out = out.withColumn("__p", p).withColumn("__q", (F.col("__u") / (1 - F.col("__u"))) / (F.col("__p") / (1 - F.col("__p"))))
    return out.withColumn("__class", F.floor(F.col("__q") / (1 + F.col("__q")) * CLASSES).cast("int"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11) -> DataFrame:
    """docs with size, source_size, target (of the source, in words), copies and taken (copies times size)."""
    rows = ranked(docs, id_col, text_col, source_col, seed)
    small = materialize(rows.select("__id", "__source", "__size", "__root", "__u"), "sizes")
    sources = materialize(targets(small.select(F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__root").alias("root"))), "sources")
    rank = with_rank(small.where("__size > 0"), sources)
    sums = rank.groupBy("__source", "__class", "__need").agg(F.sum("__size").alias("__sum"))
    sums = sums.withColumn("__before", F.sum("__sum").over(Window.partitionBy("__source").orderBy("__class")) - F.col("__sum"))
    # The first class that does not fit whole; a source without one takes all.
    cuts = sums.where("__before + __sum > __need").groupBy("__source").agg(F.min(F.struct("__class", "__before")).alias("c")).select(F.col("__source").alias("source"), F.col("c.__class").alias("cut"), F.col("c.__before").alias("before"))
    cuts = materialize(cuts, "cuts")
    edge = with_rank(small.where("__size > 0"), sources.join(cuts.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")).where("__class = __cut")
    upto = F.sum("__size").over(Window.partitionBy("__source").orderBy("__q", "__id", "__size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = edge.withColumn("__upto", F.col("__before") + upto).where("__upto - __size / 2 <= __need").groupBy("__source").agg(F.max(F.struct("__q", "__id", "__size")).alias("last"))
    known = sources.join(cuts.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s", "before")
    known = materialize(known.join(last, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source"), "known")
    release(cuts)
    out = with_rank(rows, known)
    one = (F.col("__size") > 0) & (F.col("__cut").isNull() | (F.col("__class") < F.col("__cut")) | (F.col("__class") == F.col("__cut")) & F.coalesce(F.struct("__q", "__id", "__size") <= F.col("__last"), F.lit(False)))
    copies = (F.when(F.col("__size") > 0, F.col("__copies")).otherwise(0) + F.when(one & (F.col("__need") > 0), 1).otherwise(0)).cast("long")
    kept = [F.col(c) for c in docs.columns if c.lower() not in ADDED]
    return out.select(*kept, F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), copies.alias("copies"), (copies * F.col("__size")).alias("taken"))


def mixed(docs: DataFrame, **options: str) -> DataFrame:
    """The mix itself: each row as often as it is taken."""
    named = docs.select(*[F.col(c).alias(f"{c}__in") if c.lower() in ADDED else F.col(c) for c in docs.columns])
    out = mix(named, **options).where("copies > 0")
    out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(*[F.col(f"{c}__in").alias(c) if f"{c}__in" in named.columns else F.col(c) for c in docs.columns])
