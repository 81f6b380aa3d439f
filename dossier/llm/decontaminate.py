"""Benchmark decontamination: SimHash of item-sized windows, a multi-index Hamming join, then exact weighted-shingle similarity.

Words are runs of letters and digits, lower-cased; shingles are five words, each counted as often as it occurs. A window is as
long as the item (shorter at the end of a text) and may start at any word. Its similarity is at most the share of the item's
shingles that it can hold, so the windows made are all those that hold enough shingles of items of that length, wherever
these stand in the item: no other can match, and reordered or interrupted copies are found. Fingerprints have 256 bits in 16
blocks of 16. Two at a distance of at most 63 agree in one block up to 3 bits (16 * 4 - 1 = 63); items are indexed under each block
with up to 3 bits flipped (697 values), so that a window has one look-up for each of its blocks. At similarity 0.8 the expected distance is
39 +- 5.7, beyond 63 with probability 1e-5; a window and an item that have nothing in common meet with probability 0.16. What is found
is verified: the sum of smaller counts over the sum of larger ones.

Items of fewer words than a shingle are one shingle. Null and empty texts, and items without words, match nothing. Texts of
any length are searched whole. Rows that repeat an id are searched each on its own, equal rows once; a null id is reported as null. Of
equally similar windows the first is reported. Empty tables hold nothing. Columns of the caller named __key are taken for its own."""

from __future__ import annotations

from itertools import combinations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .common import materialize, release, small

#: 64-bit hashes of a shingle, blocks of a fingerprint, bits of a block, and how many bits the index and a look-up flip.
HASHES, BLOCKS, BITS, FLIP_ITEM, FLIP_WINDOW = 4, 16, 16, 3, 0
#: Up to so many hashes are counted four bits at a time.
FIELD = (1 << 16) - 1
RADIUS = BLOCKS * (FLIP_ITEM + FLIP_WINDOW + 1) - 1
#: Up to so many rows of item shingles or keys are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words: Column, size: int) -> Column:
    """Hashes of the runs of size words, in order."""
    n = F.size(words) - size + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, size)))).otherwise(F.array().cast("array<long>"))


def simhash(hashes: Column) -> Column:
    """The signs of the sums of the hashes' bits, as blocks: array<int>."""

    def seeded(k: int) -> Column:
        return F.transform(hashes, lambda h: F.xxhash64(h, F.lit(k)))

    def total_of(hs: Column, j: int) -> Column:
        """How often bits j, j + 16, j + 32 and j + 48 are set, in four fields of 16 bits of one long."""
        return F.aggregate(hs, F.lit(0).cast("long"), lambda s, h: s + F.shiftright(h, j).bitwiseAND(F.lit(0x0001000100010001)))

    def blocks(totals: Column, n: Column) -> Column:
        most = lambda f, j: F.shiftright(totals[j], BITS * f).bitwiseAND(F.lit(0xFFFF)) * 2 > n
        return F.array(*[sum((F.when(most(f, j), 1 << j).otherwise(0) for j in range(1, BITS)), F.when(most(f, 0), 1).otherwise(0)) for f in range(BLOCKS // HASHES)])

    def slow(hs: Column) -> Column:
        bit = lambda b: F.aggregate(hs, F.lit(0), lambda s, h: s + F.getbit(h, b).cast("int") * 2 - 1)
        block = lambda k: F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0), lambda s, j: s + F.when(bit(k * BITS + j) > 0, F.pow(F.lit(2), j).cast("int")).otherwise(0))
        return F.transform(F.sequence(F.lit(0), F.lit(BLOCKS // HASHES - 1)), block)

    each, n = F.array(*[seeded(k) for k in range(HASHES)]), F.size(hashes)
    fast = F.transform(F.transform(each, lambda hs: F.array(*[total_of(hs, j) for j in range(BITS)])), lambda totals: blocks(totals, n))
    return F.flatten(F.when(n <= FIELD, fast).otherwise(F.transform(each, slow)))


def flipped(block: Column, most: int) -> Column:
    """The values that differ from a block in at most so many bits."""
    masks = F.array(*[F.lit(sum(1 << j for j in c)) for e in range(most + 1) for c in combinations(range(BITS), e)])
    return F.transform(masks, lambda m: block.bitwiseXOR(m))


def block_keys(rows: DataFrame, most: int, *columns: str) -> DataFrame:
    """The columns with k and block: each block of `print` in all its values with up to `most` bits flipped."""
    each = rows.select(*columns, F.posexplode("print").alias("k", "own"))
    return each.select(*columns, "k", F.explode(flipped(F.col("own"), most)).alias("block"))


def bits_apart(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def similarity(a: Column, b: Column) -> Column:
    """Sum of the smaller counts of each shingle over the sum of the larger ones."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    each = F.array_distinct(F.concat(a, b))
    both = F.aggregate(each, F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    return F.when(F.array_sort(a) == F.array_sort(b), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def starts(at: Column, n: Column, percent: int) -> Column:
    """All starts, in order, of windows of n shingles that hold at least percent of n of the sorted positions at."""
    least = F.greatest(F.lit(1), F.ceil(n * percent / 100).cast("int"))

    def first(i: Column) -> Column:
        """The starts of such windows whose first position is the i-th."""
        low = F.greatest(F.when(i > 0, at[i - 1] + 1).otherwise(0), at[i + least - 1] - n + 1)
        return F.when(low <= at[i], F.sequence(low, at[i])).otherwise(F.array().cast("array<int>"))

    return F.when(F.size(at) >= least, F.flatten(F.transform(F.sequence(F.lit(0), F.size(at) - least), first))).otherwise(F.array().cast("array<int>"))


def key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    return F.xxhash64(docs[id_col], docs[text_col])


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(key, id, item, start, similarity): each document and item that it holds, with the best window's first word and similarity."""
    items = benchmark.select(F.col(item_col).alias("item"), words(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    items = items.select("item", F.size("w").alias("length"), F.least(F.lit(size), F.size("w")).alias("size"), "w")
    items = items.withColumn("s", F.coalesce(*[F.when(F.col("size") == k, shingles(F.col("w"), k)) for k in range(1, size + 1)])).drop("w")
    items = materialize(items.withColumn("print", simhash(F.col("s"))).withColumn("number", F.xxhash64("item", "length", "s")), "items")
    # At most five sizes, nearly always one.
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    texts = docs.select(key(docs, id_col, text_col).alias("key"), F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    at = small(materialize(items.select("size", "length", F.explode("s").alias("h")).distinct(), "shingles"), BROADCAST_ROWS)
    hits = []
    for k in sizes:
        runs = texts.select("key", F.posexplode(shingles(F.col("w"), k)).alias("pos", "h"))
        hits.append(runs.join(at.where(F.col("size") == k).drop("size"), "h").select("key", F.lit(k).alias("size"), "length", "pos"))
    if not hits:
        return texts.select("key", "id", items_type(benchmark, item_col), F.lit(0).alias("start"), F.lit(0.0).alias("similarity")).where("false")
    found = hits[0]
    for h in hits[1:]:
        found = found.unionByName(h)
    # Equal rows have equal keys and positions: one of them is enough.
    found = found.groupBy("key", "size", "length").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    windows = materialize(found.select("key", "size", "length", F.explode(starts(F.col("at"), F.col("length") - F.col("size") + 1, percent)).alias("start")), "windows")
    held = windows.groupBy("key", "size").agg(F.collect_list(F.struct("start", "length")).alias("at"))
    here = docs.select(key(docs, id_col, text_col).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(held, "key").dropDuplicates(["key", "size"])
    here = here.withColumn("w", words(F.col("text"))).withColumn("s", F.coalesce(*[F.when(F.col("size") == k, shingles(F.col("w"), k)) for k in sizes])).select("key", "id", "size", "s", F.explode("at").alias("at"))
    prints = here.select("key", "id", "size", "at.start", "at.length", F.slice("s", F.col("at.start") + 1, F.col("at.length") - F.col("size") + 1).alias("s"))
    prints = materialize(prints.withColumn("print", simhash(F.col("s"))), "prints")
    near = candidates(prints, items).where(bits_apart(F.col("print"), F.col("print_i")) <= RADIUS)
    near = near.withColumn("similarity", similarity(F.col("s"), F.col("s_i"))).where(F.col("similarity") * 100 >= percent)
    best = near.groupBy("key", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("before"))).alias("m"), F.first("id").alias("id"))
    out = materialize(best.select("key", "id", "item", (-F.col("m.before")).alias("start"), F.col("m.similarity").alias("similarity")), "leaks")
    release(windows, prints)
    return out


def candidates(prints: DataFrame, items: DataFrame) -> DataFrame:
    """Windows with the items of their length that share a block up to the flipped bits, each pair once.

    An id may stand for several texts; each of them, told by its number, is held against the window."""
    index = small(block_keys(items, FLIP_ITEM, "length", "number").distinct(), BROADCAST_ROWS)
    met = block_keys(prints, FLIP_WINDOW, "key", "start", "length").join(index, ["length", "k", "block"]).select("key", "start", "length", "number").distinct()
    own = small(items.select("number", "item", F.col("print").alias("print_i"), F.col("s").alias("s_i")).dropDuplicates(["number", "item"]), BROADCAST_ROWS)
    return prints.join(met, ["key", "start", "length"]).join(own, "number")


def items_type(benchmark: DataFrame, item_col: str) -> Column:
    return F.lit(None).cast(benchmark.schema[item_col].dataType).alias("item")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """docs without the rows that hold an item."""
    found = leaks(docs, benchmark, id_col, text_col, **options).select(F.col("key").alias("__key")).distinct()
    return docs.join(found, key(docs, id_col, text_col) == F.col("__key"), "left_anti")
