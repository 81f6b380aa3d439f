"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of word shingles gives 129 MinHash values of 15 bits, its signature, kept as 43 longs of three values. The
first 72 are indexed, in 12 chunks of 6: two documents that differ in at most 12 * (1 + 1) - 1 = 23 of them have, by the
pigeonhole principle, a chunk with at most one differing value; so every chunk is indexed once for each value left out, and such
pairs always share a key. Pairs of similarity 0.8 share none with probability 3e-6. Of a bucket's pairs, those whose sizes
allow the similarity and whose signatures are near are confirmed on the full sets.

No bucket is expanded into all pairs. Documents with equal sets form a class with one representative. First each
representative is paired with the smallest of its buckets (pairs grow with the documents, not with their square), and confirmed
links merge into components. Only members of one bucket in different components are compared after that: those outside the
largest component that are near by a finer sketch of 3072 bits to members of others are listed, a pair at the first key it
shares only. Each is confirmed against the nearest of its list, components merge again, and the pairs that are still apart are
confirmed, all of them. A text is sent once for each meeting of its block of about 64 with another, not once for each pair.

Ids are whole numbers. Null or empty texts have empty sets and are linked with nothing. A text with fewer words than a shingle is
one shingle; texts of any length are read whole, one at a time. Rows with a null id are linked with nothing and have a null
component. Rows that repeat an id count as one document. Ties between equally near partners go to the smaller id. Columns of the
caller but id and text are not touched, whatever their names. An empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from .common import materialize, release, small
from .components import components, roots, with_tops
from .kernels import min_hashes, mix, shingle_set, slices, text_bytes, word_hashes

#: Candidates are dealt to blocks of about so many documents; two blocks at a time are held in memory.
BLOCK = 64
#: Up to so many rows of ids (16 bytes each) are broadcast; more are joined by a shuffle, with equal results.
BROADCAST_IDS = 500_000
#: The same for the rows that drop_near_duplicates leaves out (64 MB), which saves a shuffle of the texts.
BROADCAST_ROWS = 2_000_000
#: Classes of more than this share of all rows are broadcast: there are no more of them than its inverse.
HEAVY = 1e-5
CHUNKS = 12
LANES = 43
SIG = [f"s{i}" for i in range(LANES)]
#: Longs of the finer sketch.
WIDE = 48
#: Distances up to which a pair is confirmed. At similarity 0.8 they are 26 +- 4.5 of 129 values and 307 +- 16.6 of 3072 bits; beyond these with probability 1e-5 each.
NEAR, NEAR_BITS = 45, 378


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 2) -> DataFrame:
    """(id, n_shingles, set_a, set_b, s0 to s42): the size of each document's set, a 128-bit hash of the set, and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, first = word_hashes(*text_bytes(part.column("text")))
                n = len(first) - 1
                sizes, sums, packed = np.zeros(n, np.int64), np.zeros((n, 2), np.int64), np.zeros((n, LANES), np.int64)
                for i in range(n):
                    s = shingle_set(hashes[first[i] : first[i + 1]], words)
                    if len(s):
                        sizes[i], sums[i] = len(s), (mix(s).sum().astype(np.int64), mix(s ^ np.uint64(0x5DEECE66D)).sum().astype(np.int64))
                        v = (min_hashes(s, 3 * LANES) >> 1).astype(np.int64).reshape(LANES, 3)
                        packed[i] = v[:, 0] | v[:, 1] << 16 | v[:, 2] << 32
                yield pa.RecordBatch.from_arrays([part.column("id"), *map(pa.array, (sizes, sums[:, 0], sums[:, 1])), *[pa.array(packed[:, k]) for k in range(LANES)]], ["id", "n_shingles", "set_a", "set_b", *SIG])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id long, n_shingles long, set_a long, set_b long, {', '.join(f'{c} long' for c in SIG)}")


def value(i: int) -> Column:
    """The i-th value of a signature."""
    return F.shiftright(F.col(SIG[i // 3]), 16 * (i % 3)).bitwiseAND(F.lit(0x7FFF))


def index_keys() -> Column:
    """The keys of a signature: each chunk without each of its values. A key's lowest seven bits tell which."""
    keys = []
    for c in range(CHUNKS):
        for m in range(6):
            kept = [value(6 * c + i) for i in range(6) if i != m]
            keys.append(F.shiftleft(F.xxhash64(F.lit(6 * c + m), *kept), 7).bitwiseOR(F.lit(6 * c + m).cast("long")))
    return F.array(*keys)


def apart(i: int, x: str = "x", y: str = "y") -> Column:
    """How many of the three values of lane i differ: a value of 15 bits that isn't 0 carries into the 16th."""
    return F.bit_count((F.col(f"{x}{i}").bitwiseXOR(F.col(f"{y}{i}")) + F.lit(0x7FFF7FFF7FFF)).bitwiseAND(F.lit(0x800080008000)))


def total(columns: list[Column]) -> Column:
    return sum(columns[1:], columns[0])


def first_shared(k: Column) -> Column:
    """Whether k is the first key that a pair shares."""
    errors = [apart(2 * c) + apart(2 * c + 1) for c in range(CHUNKS)]
    first, of = F.lit(-1), F.lit(-1)
    for c in reversed(range(CHUNKS)):
        first, of = F.when(errors[c] <= 1, c).otherwise(first), F.when(errors[c] <= 1, errors[c]).otherwise(of)
    return (first == F.floor(k / 6)) & ((of == 1) | (k % 6 == 0))


def signature_distance() -> Column:
    return total([apart(i) for i in range(LANES)])


def sketches(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(v, b0 to b47): one bit of each of 3072 MinHash values for the documents of these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, first = word_hashes(*text_bytes(part.column("text")))
                n = len(first) - 1
                bits = np.zeros((n, 64 * WIDE), np.uint8)
                for i in range(n):
                    bits[i] = min_hashes(shingle_set(hashes[first[i] : first[i + 1]], words), 64 * WIDE, 2) & 1
                packed = np.packbits(bits, axis=1).view(np.int64).reshape(n, WIDE)
                yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(np.ascontiguousarray(packed[:, k])) for k in range(WIDE)]], ["v", *[f"b{k}" for k in range(WIDE)]])

    rows = candidate_texts(ids, docs, id_col, text_col)
    return rows.mapInArrow(run, f"v long, {', '.join(f'b{k} long' for k in range(WIDE))}").dropDuplicates(["v"])


def candidate_texts(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the documents of these ids."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(small(ids, BROADCAST_IDS), "id", "left_semi")


def confirm(pairs: DataFrame, docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    Documents that share a smallest partner, as those of a group of copies do, are dealt to blocks of about BLOCK; a pair is checked
    where its two blocks meet. So a text is sent once for each meeting of its block, not once for each of its pairs, and a
    task holds the sets of two blocks at a time, however large a group is."""
    both = pairs.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(pairs.select(F.col("b").alias("v"), F.col("a").alias("w")))
    anchors = both.groupBy("v").agg(F.least("v", F.min("w")).alias("anchor"))
    parts = anchors.groupBy("anchor").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("parts"))
    blocks = materialize(anchors.join(small(parts, BROADCAST_IDS), "anchor").select("v", F.xxhash64("anchor", F.pmod(F.xxhash64("v"), F.col("parts"))).alias("block")), "blocks")
    # Only the candidates' texts are shuffled.
    texts = materialize(candidate_texts(blocks.select(F.col("v").alias("id")), docs, id_col, text_col), "texts")
    of = lambda c, x: small(blocks.select(F.col("v").alias(c), F.col("block").alias(x)), BROADCAST_IDS)
    meets = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q"), "a", "b")
    # One row for each first end in a meeting, with up to a block of others.
    meets = materialize(meets.groupBy("p", "q", "a").agg(F.collect_set("b").alias("bs")), "meets")
    others = meets.select("p", "q", F.explode("bs").alias("id")).distinct()
    members = meets.select("p", "q", F.col("a").alias("id")).unionByName(others).distinct().join(texts, "id").select("p", "q", F.col("id").alias("a"), F.lit(None).cast("array<long>").alias("bs"), "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = members.unionByName(meets.withColumn("text", F.lit(None).cast("string"))).repartition(n, "p", "q").sortWithinPartitions("p", "q", F.col("bs").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sets = None, {}
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, first = word_hashes(*text_bytes(part.column("text")))
                found = []
                for i, (p, q, a, bs) in enumerate(zip(*[part.column(c).to_pylist() for c in ("p", "q", "a", "bs")], strict=True)):
                    if key != (p, q):
                        key, sets = (p, q), {}
                    if bs is None:
                        # Of rows that repeat an id, the last counts.
                        sets[a] = shingle_set(hashes[first[i] : first[i + 1]], words)
                    elif a in sets:
                        x = sets[a]
                        for b, y in ((b, sets[b]) for b in bs if b in sets):
                            same = len(np.intersect1d(x, y, assume_unique=True))
                            if same and 100 * same >= percent * (len(x) + len(y) - same):
                                found.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    links = materialize(rows.mapInArrow(run, "a long, b long").distinct(), "links")
    release(blocks, texts, meets)
    return links


def side(lanes: DataFrame, v: str, n: str, x: str) -> DataFrame:
    """The signatures (v, n_shingles, s0 to s42) under other names."""
    return lanes.select(F.col("v").alias(v), F.col("n_shingles").alias(n), *[F.col(c).alias(f"{x}{i}") for i, c in enumerate(SIG)])


def near_pairs(pairs: DataFrame, lanes: DataFrame, percent: int) -> DataFrame:
    """(a, b, d): the pairs whose sizes allow the similarity and whose signatures differ in d of 129 values, NEAR at most."""
    both = pairs.join(side(lanes, "a", "nx", "x"), "a").join(side(lanes, "b", "ny", "y"), "b").where(sizes_allow(percent))
    return both.select("a", "b", signature_distance().alias("d")).where(F.col("d") <= NEAR)


def sizes_allow(percent: int) -> Column:
    return F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent


def mixed_buckets(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, v, comp, main) of the buckets with members of several components, main being the one with most members."""
    member = shared.join(small(labels, BROADCAST_IDS), "v", "left").select("key", "v", F.coalesce("comp", "v").alias("comp"))
    by_comp = member.groupBy("key", "comp").agg(F.count("*").alias("n"))
    main = by_comp.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("m"), F.count("*").alias("kinds")).where("kinds > 1")
    return materialize(member.join(main.select("key", F.col("m.comp").alias("main")), "key"), "mixed")


def apart_pairs(mixed: DataFrame, lanes: DataFrame, docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b, place): all pairs of members of one bucket in different components that are near by signature and by sketch; place counts from the nearest of each member outside its bucket's main component."""

    def ends(rows: DataFrame, extra: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
        full = rows.join(extra, "v")
        return tuple(full.select("key", F.col("v").alias(f"v{s}"), F.col("comp").alias(f"c{s}"), F.col("main").alias(f"m{s}"), F.col("n_shingles").alias(f"n{s}"), *[F.col(c).alias(s + c[1:] if c in SIG else f"{s}_{c}") for c in names]) for s in "xy")

    def near(one: DataFrame, two: DataFrame) -> Column:
        return (one["key"] == two["key"]) & (F.col("cx") != F.col("cy")) & sizes_allow(percent) & (signature_distance() <= NEAR)

    one, two = ends(mixed, lanes, SIG)
    outer = one.where("cx <> mx").join(two, near(one, two), "left_semi").select(F.col("vx").alias("id"))
    inner = one.where("cx = mx").join(two.where("cy <> my"), near(one, two), "left_semi").select(F.col("vx").alias("id"))
    close = materialize(outer.union(inner).distinct(), "close")
    fine = materialize(sketches(close, docs, id_col, text_col, words), "sketches")
    extra = lanes.select("v", "n_shingles", *SIG[: 2 * CHUNKS]).join(fine, "v")
    one, two = ends(mixed, extra, [*SIG[: 2 * CHUNKS], *[f"b{k}" for k in range(WIDE)]])
    bits = total([F.bit_count(F.col(f"x_b{k}").bitwiseXOR(F.col(f"y_b{k}"))) for k in range(WIDE)])
    k = one["key"].bitwiseAND(F.lit(127))
    meets = one.where("cx <> mx").join(two, (one["key"] == two["key"]) & (F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("my")) | (F.col("vx") < F.col("vy"))) & sizes_allow(percent) & (bits <= NEAR_BITS) & first_shared(k))
    place = F.row_number().over(Window.partitionBy("vx").orderBy("bits", "vy"))
    rest = meets.select("vx", "vy", bits.alias("bits")).distinct().select(F.least("vx", "vy").alias("a"), F.greatest("vx", "vy").alias("b"), place.alias("place"))
    rest = materialize(rest, "apart")
    release(close, fine)
    return rest


def linked_components(shared: DataFrame, lanes: DataFrame, docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(v, comp) of the linked representatives, from buckets (key, v, a) with their smallest member a."""
    check = lambda pairs: confirm(pairs, docs, words, percent, id_col, text_col)
    stars = near_pairs(shared.where("a <> v").select("a", F.col("v").alias("b")).distinct(), lanes, percent)
    first = materialize(stars.groupBy("b").agg(F.min(F.struct((F.col("d") > NEAR // 2).alias("far"), "a")).alias("m")).select("m.a", "b"), "pairs")
    linked = check(first)
    # Each b has one smaller a: a forest.
    labels = roots(with_tops(linked.select(F.col("b").alias("v"), F.col("a").alias("comp"))))
    mixed = mixed_buckets(shared.select("key", "v"), labels)
    rest = apart_pairs(mixed, lanes, docs, words, percent, id_col, text_col)
    nearest = check(rest.where("place = 1").select("a", "b"))
    merged = components(nearest, labels)
    of = lambda v, c: small(merged.select(F.col("v").alias(v), F.col("comp").alias(c)), BROADCAST_IDS)
    left = rest.where("place > 1").join(of("a", "ca"), "a", "left").join(of("b", "cb"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    left = materialize(left.select("a", "b"), "pairs")
    last = check(left)
    out = components(last, merged)
    release(first, linked, labels, mixed, rest, nearest, merged, left, last)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 2, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id), a row for each row of docs: the size of its set and the smallest id of its component.

    Links are the pairs of documents whose sets have 100 * intersection >= percent * union; percent is 80 at least, to which the index and its distances are made."""
    assert percent >= 80
    sigs = materialize(signatures(docs, id_col, text_col, words), "signatures")
    # Equal sets have equal signatures: one class each, whose first row stands for it. A group of copies of any size is a partial aggregate.
    classes = sigs.where("n_shingles > 0 and id is not null").groupBy("set_a", "set_b").agg(F.min("id").alias("v"), F.count("*").alias("members"), *[F.first(c).alias(c) for c in ("n_shingles", *SIG)])
    classes = materialize(classes, "classes")
    # A set of fewer shingles than this can't reach the similarity with a different set.
    least = next(n for n in range(1, 102) if 100 * n >= percent * (n + 1))
    keyed = classes.where(F.col("n_shingles") >= least).select("v", F.explode(index_keys()).alias("key"))
    buckets = materialize(keyed.groupBy("key").agg(F.min("v").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a"), "buckets")
    shared = materialize(keyed.join(buckets, "key").select("key", "a", "v"), "shared")
    met = shared.select("v").distinct()
    lanes = classes.where(F.col("n_shingles") >= least).select("v", "n_shingles", *SIG).join(small(met, BROADCAST_IDS), "v", "left_semi")
    # Only where ids repeat do classes share one.
    lanes = materialize(lanes.dropDuplicates(["v"]), "lanes")
    labels = linked_components(shared, lanes, docs, words, percent, id_col, text_col)
    named = materialize(classes.select("set_a", "set_b", "v", "members").join(small(labels, BROADCAST_IDS), "v", "left").select("set_a", "set_b", "members", F.coalesce("comp", "v").alias("comp")), "named")
    release(buckets, shared, lanes, labels, classes)
    rows = sigs.select("id", "n_shingles", "set_a", "set_b")
    filled = rows.where("n_shingles > 0 and id is not null")
    heavy = F.greatest(F.lit(2), F.ceil(F.lit(HEAVY) * sigs.count()))
    large = F.broadcast(named.where(F.col("members") >= heavy).drop("members"))
    light = named.where(F.col("members") < heavy).drop("members")
    names = ("id", "n_shingles", F.col("comp").alias("component_id"))
    out = filled.join(large, ["set_a", "set_b"]).select(*names).unionByName(filled.join(large, ["set_a", "set_b"], "left_anti").join(light, ["set_a", "set_b"]).select(*names))
    rest = rows.where("n_shingles = 0 or id is null")
    return out.unionByName(rest.select("id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("id")).alias("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near-duplicates, the one with the smallest id. Documents without words and rows with a null id all stay.

    Rows that repeat an id and a text are one document. Rows that repeat an id with other texts are documents of their own, after
    all others in the order of ids. Texts are not shuffled while the ids to leave out are few enough to be broadcast."""
    own = docs.select("*", F.col(id_col).cast("long").alias("__id"))
    text = F.xxhash64(F.col(text_col))
    several = own.where("__id is not null").groupBy(F.col("__id").alias("__of")).agg(F.min(text).alias("x"), F.max(text).alias("y")).where("x <> y").select("__of")
    several = materialize(several, "several")
    if several.limit(1).count():
        marked = own.join(small(several, BROADCAST_ROWS), F.col("__id") == F.col("__of"), "left")
        apart_id = F.shiftrightunsigned(F.xxhash64(F.col("__id"), F.col(text_col)), 2).bitwiseOR(F.lit(1 << 62))
        own = marked.withColumn("__id", F.when(F.col("__of").isNull(), F.col("__id")).otherwise(apart_id)).drop("__of")
    found = materialize(near_duplicates(own.select("__id", F.col(text_col).alias("__text")), "__id", "__text", words, percent).where("id is not null"), "found")
    gone = materialize(found.where("id <> component_id").select(F.col("id").alias("__gone")).distinct(), "gone")
    again = materialize(found.where("id = component_id").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "again")
    release(found)
    out = own.join(small(gone, BROADCAST_ROWS), F.col("__id") == F.col("__gone"), "left_anti")
    if again.limit(1).count():
        few = small(again.select(F.col("id").alias("__again")), BROADCAST_ROWS)
        out = out.join(few, F.col("__id") == F.col("__again"), "left_anti").unionByName(out.join(few, F.col("__id") == F.col("__again"), "left_semi").dropDuplicates(["__id"]))
    return out.select(*[F.col(c) for c in docs.columns])
