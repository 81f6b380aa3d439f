"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows get numbers 0 to N-1 in an order that depends on their id and text alone. A keyed Feistel network over Z_a x Z_b, with
a * b >= N and fewer than a values beyond N, permutes the numbers; a value beyond N is permuted again until it is below N. The
place p of a row gives its shard p mod n and its slot p div n, so shard sizes differ by one at most and slots have no gaps.

Rows with equal id and text (nulls being empty) get neighbouring numbers in any order, equal texts of other ids places of their
own. Texts of any length are hashed whole. An empty table gives an empty result. Columns of the caller named shard or slot, in any
case of letters, are replaced; names that begin with __ are taken for its own."""

from __future__ import annotations

from math import isqrt

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from .common import utf8

#: The field of the round function; products of two of its values fit in 63 bits.
PRIME = (1 << 31) - 1
ROUNDS = 6
#: Steps of a walk within one expression. Fewer than a of the a * b values lie beyond N, a being about the root of N: a longer walk has probability below (1 / a) ** WALK.
WALK = 16
#: Row numbers are dealt in so many buckets, each numbered on its own.
BUCKETS = 4096


def sides(n: int) -> tuple[int, int]:
    a = max(1, isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def constants(seed: int) -> list[tuple[int, int, int]]:
    """Three field elements for each round, from the seed by a linear congruential rule."""
    out, x = [], (seed * 48271 + 11) % PRIME or 1
    for _ in range(ROUNDS):
        row = []
        for _ in range(3):
            x = x * 48271 % PRIME
            row.append(x)
        out.append(tuple(row))
    return out


def feistel(x: str, n: int, seed: int) -> str:
    """SQL for the permuted value of x, over a * b values."""
    a, b = sides(n)
    pick = [f"element_at(array({', '.join(f'{c[k]}L' for c in constants(seed))}), i + 1)" for k in range(3)]
    square = f"element_at(transform(array((s.r + {pick[0]}) % {PRIME}L), y -> y * y % {PRIME}L), 1)"
    f = f"(({square} * {pick[1]} + {pick[2]}) % {PRIME}L)"
    return (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', {x} div {b}L, 'r', {x} % {b}L), "
        f"(s, i) -> named_struct('l', s.r, 'r', (s.l + {f}) % if(i % 2 = 0, {a}L, {b}L)), s -> s.l * {b}L + s.r)"
    )


def permuted(x: str, n: int, seed: int) -> Column:
    """The place of row number x among n."""
    a, b = sides(n)
    step = lambda p, most: f"aggregate(sequence(1, {most}), {p}, (p, j) -> if(p < {n}L, p, {feistel('p', n, seed)}))"
    # Each value beyond N is permuted to another value at each step, so a walk ends after as many steps as there are such values.
    beyond = a * b - n
    walk = step(feistel(x, n, seed), min(WALK, max(1, beyond)))
    if beyond > WALK:
        walk = f"transform(array({walk}), w -> if(w < {n}L, w, {step('w', beyond)}))[0]"
    return F.expr(walk).cast("long")


def row_keys(id_col: Column, text: Column) -> tuple[Column, Column]:
    """The bucket of a row, and what orders rows of one id."""
    digest = F.md5(utf8(text))
    mark = F.md5(F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("")), digest).cast("binary"))
    return (F.conv(F.substring(mark, 1, 8), 16, 10).cast("long") % BUCKETS).cast("int"), digest


def shard(docs: DataFrame, n: int = 24, seed: int = 7, id_col: str = "doc_id", bucket: str | None = None, order: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with shard (0 to n-1) and slot (from 0, without gaps). bucket and order name columns that already hold row_keys(). Columns named shard or slot are replaced."""
    docs = docs.drop("shard", "slot")
    keyed = docs
    if bucket is None:
        bucket, order = "__bucket", "__order"
        b, o = row_keys(F.col(id_col), F.col(text_col))
        keyed = docs.withColumn(bucket, b).withColumn(order, o)
    counts = keyed.groupBy(bucket).agg(F.count("*").alias("__n"))
    # BUCKETS rows at most.
    offsets = counts.withColumn("__before", F.sum("__n").over(Window.orderBy(bucket)) - F.col("__n"))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    numbered = keyed.withColumn("__k", F.row_number().over(Window.partitionBy(bucket).orderBy(id_col, order)).cast("long"))
    numbered = numbered.join(F.broadcast(offsets.select(F.col(bucket).alias("__b"), "__before")), F.col(bucket) == F.col("__b")).withColumn("__row", F.col("__before") + F.col("__k") - 1)
    placed = numbered.withColumn("__p", permuted("__row", total, seed))
    return placed.withColumn("shard", (F.col("__p") % n).cast("int")).withColumn("slot", F.expr(f"__p div {n}")).select(*docs.columns, "shard", "slot")
