"""The structure of documents: context of chunks, margins, edges between nodes, and personalised PageRank over them.

Edges are unions of joins on a document's page or section, so every shuffle is on a document's key. Pairs are made within a page
only, which bounds them."""

from __future__ import annotations

import uuid

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from dossier.functions.lexicon import EDGE_WEIGHTS
from dossier.functions.text import preview
from dossier.functions.text import source_context as source_context_name


def chunk_context(nodes: DataFrame) -> DataFrame:
    """Order of a document's nodes, with the id and a preview of the ones before and after."""
    w = Window.partitionBy("doc_id").orderBy("node_pos")
    out = nodes.where("node_type <> 'page'")
    return out.select("node_id", "doc_id", F.row_number().over(w).alias("chunk_order"), F.lag("node_id").over(w).alias("previous_node_id"), F.lead("node_id").over(w).alias("next_node_id"), F.lag(preview(F.col("content"), 120)).over(w).alias("previous_preview"), F.lead(preview(F.col("content"), 120)).over(w).alias("next_preview"))


def repeated_margins(nodes: DataFrame, share: float = 0.25) -> DataFrame:
    """(doc_id, key, pages): normalised texts on at least two and a quarter of a document's pages, which are headers or footers."""
    key = F.substring(F.regexp_replace(F.lower("content"), "[^0-9a-z一-鿿]+", ""), 1, 100)
    keyed = nodes.select("doc_id", "page", key.alias("key")).where("key <> ''")
    pages = nodes.groupBy("doc_id").agg(F.countDistinct("page").alias("n"))
    seen = keyed.groupBy("doc_id", "key").agg(F.countDistinct("page").alias("pages"))
    return seen.join(pages, "doc_id").where(F.col("pages") >= F.greatest(F.lit(2), F.ceil(share * F.col("n")))).select("doc_id", "key", "pages")


def _edge(df: DataFrame, source: str, target: str, kind: str) -> DataFrame:
    return df.select(F.col(source).alias("source_id"), F.col(target).alias("target_id"), F.lit(kind).alias("edge_type"), F.lit(EDGE_WEIGHTS[kind]).alias("weight"))


def same_page(nodes: DataFrame) -> DataFrame:
    a = nodes.where("node_type <> 'page'").select("doc_id", "page", F.col("node_id").alias("a"), F.col("node_pos").alias("i"))
    b = a.select("doc_id", "page", F.col("a").alias("b"), F.col("i").alias("j"))
    return _edge(a.join(b, ["doc_id", "page"]).where("i < j"), "a", "b", "same_page")


def belongs_to_page(nodes: DataFrame) -> DataFrame:
    out = nodes.where("node_type <> 'page'").withColumn("p", F.concat_ws("_", F.lit("P"), "doc_id", "page"))
    return _edge(out, "p", "node_id", "belongs_to_page")


def chunk_sequence(nodes: DataFrame) -> DataFrame:
    return _edge(chunk_context(nodes).where("previous_node_id is not null"), "previous_node_id", "node_id", "chunk_sequence")


def same_section(nodes: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id", "section").orderBy("node_pos")
    out = nodes.where("node_type not in ('page', 'title') and section <> ''").withColumn("b", F.lead("node_id").over(w))
    return _edge(out.where("b is not null"), "node_id", "b", "same_section")


def section_title(nodes: DataFrame, titles: int = 2, contents: int = 30) -> DataFrame:
    """The first two titles of a section with its first thirty other nodes."""
    is_title = (F.col("node_type") == "title").alias("t")
    w = Window.partitionBy("doc_id", "section", is_title).orderBy("node_pos")
    ranked = nodes.where("node_type <> 'page' and section <> ''").withColumn("n", F.row_number().over(w))
    a = ranked.where((F.col("node_type") == "title") & (F.col("n") <= titles)).select("doc_id", "section", F.col("node_id").alias("a"))
    b = ranked.where((F.col("node_type") != "title") & (F.col("n") <= contents)).select("doc_id", "section", F.col("node_id").alias("b"))
    return _edge(a.join(b, ["doc_id", "section"]), "a", "b", "section_title")


def parent_section(nodes: DataFrame) -> DataFrame:
    """nodes: with parent_chunk_id."""
    return _edge(nodes.where("parent_chunk_id <> '' and parent_chunk_id <> node_id"), "parent_chunk_id", "node_id", "parent_section")


def _pairs(rows: DataFrame, group: tuple[str, ...], most: int) -> DataFrame:
    """(a, b, ta, tb, pa, pb): the ordered pairs of the first `most` nodes of each group."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy("node_pos"))
    kept = rows.withColumn("n", place).where(F.col("n") <= most).select(*group, "node_id", "node_type", "page", "n")
    side = lambda x: kept.select(*group, F.col("node_id").alias(x), F.col("node_type").alias(f"t{x}"), F.col("page").alias(f"p{x}"), F.col("n").alias(f"n{x}"))
    return side("a").join(side("b"), list(group)).where("na < nb")


def section_context(nodes: DataFrame, most: int = 24) -> DataFrame:
    """Within a section, its first texts with its first visuals, and these with each other, if on one page."""
    rows = nodes.where("node_type not in ('page', 'title') and section <> ''").select("doc_id", "section", "node_id", "node_type", F.col("page").alias("on"), "node_pos")
    place = F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("node_pos")).alias("n")
    texts, visuals = rows.where("node_type = 'text'"), rows.where("node_type in ('table', 'figure', 'caption')")
    first = lambda df, x: df.select("*", place).where(F.col("n") <= most).select("doc_id", "section", "on", F.col("node_id").alias(x), F.col("node_type").alias(f"t{x}"), F.col("n").alias(f"n{x}"))
    kind = F.when(F.col("tb") == "table", "same_context_table").otherwise("same_context_figure")
    mixed = first(texts, "a").join(first(visuals, "b"), ["doc_id", "section", "on"]).select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), kind.alias("edge_type"), F.lit(0.24).alias("weight"))
    peers = first(visuals, "a").join(first(visuals, "b"), ["doc_id", "section", "on"]).where("na < nb")
    return mixed.unionByName(_edge(peers, "a", "b", "section_multimodal_peer"))


def source_context(nodes: DataFrame, most: int = 36) -> DataFrame:
    """The pairs of the first nodes that come from one source, figures' and tables' numbers in its name aside. nodes: with source_ref."""
    rows = nodes.where("node_type <> 'page'").withColumn("context", source_context_name(F.col("source_ref"))).where("context <> ''")
    pairs = _pairs(rows, ("context",), most)
    any_of = lambda *k: F.col("ta").isin(*k) | F.col("tb").isin(*k)
    kind = F.when((F.col("ta") == "text") & (F.col("tb") == "text"), "same_context_text").when(any_of("table"), "same_context_table").when(any_of("figure", "caption"), "same_context_figure").otherwise("same_context_visual")
    weight = F.element_at(F.create_map(*[F.lit(x) for k in ("same_context_text", "same_context_table", "same_context_figure", "same_context_visual") for x in (k, EDGE_WEIGHTS[k])]), kind)
    return pairs.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), kind.alias("edge_type"), weight.alias("weight"))


def enhanced_edges(nodes: DataFrame) -> DataFrame:
    """The context edges of the enhanced graph, and those from sections to their parts."""
    return dedup(parent_section(nodes).unionByName(section_context(nodes)).unionByName(source_context(nodes)))


def horizontal_overlap(a: Column, b: Column) -> Column:
    """Shared width of two boxes (x0, y0, x1, y1) over the lesser width, at least 1."""
    shared = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    return shared / F.greatest(F.lit(1.0), F.least(a[2] - a[0], b[2] - b[0]))


def vertical_gap(a: Column, b: Column) -> Column:
    return F.when(a[3] < b[1], b[1] - a[3]).when(b[3] < a[1], a[1] - b[3]).otherwise(0.0)


def captions(nodes: DataFrame) -> DataFrame:
    """Figure and table captions with what they stand beside on the page; where none is near, with all of the page's. nodes: bbox as array<double>, page_height."""
    out = None
    for kind, pattern in (("figure", "(?i)^(图|圖|Fig|Figure)"), ("table", "(?i)^(表|Table)")):
        c = nodes.where((F.col("node_type") == "caption") & F.col("content").rlike(pattern)).select("doc_id", "page", F.col("node_id").alias("a"), F.col("bbox").alias("x"), "page_height")
        t = nodes.where(F.col("node_type") == kind).select("doc_id", "page", F.col("node_id").alias("b"), F.col("bbox").alias("y"))
        near = (horizontal_overlap(F.col("x"), F.col("y")) >= 0.03) & (vertical_gap(F.col("x"), F.col("y")) <= 0.45 * F.coalesce("page_height", F.lit(800.0)))
        pairs = c.join(t, ["doc_id", "page"]).withColumn("near", F.coalesce(near, F.lit(True)))
        kept = pairs.withColumn("any", F.max("near").over(Window.partitionBy("a"))).where("near or not any")
        edge = _edge(kept, "a", "b", f"{kind}_caption")
        out = edge if out is None else out.unionByName(edge)
    return out


def text_references(nodes: DataFrame) -> DataFrame:
    """Texts and captions that name a figure or table, with the nodes of that kind and the captions that carry the name. nodes: refs, array of kind:number."""
    each = nodes.select("doc_id", "node_id", "node_type", F.explode("refs").alias("ref"))
    a = each.where("node_type in ('text', 'caption')").select("doc_id", "ref", F.col("node_id").alias("a"))
    b = each.where((F.col("node_type") == "caption") | (F.col("node_type") == F.substring_index("ref", ":", 1))).select("doc_id", "ref", F.col("node_id").alias("b"))
    pairs = a.join(b, ["doc_id", "ref"])
    return pairs.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.concat(F.lit("text_ref_"), F.substring_index("ref", ":", 1)).alias("edge_type"), F.lit(1.0).alias("weight"))


def dedup(edges: DataFrame) -> DataFrame:
    """One edge for each unordered pair and type, weights summed."""
    out = edges.where("source_id <> '' and target_id <> ''").select(F.least("source_id", "target_id").alias("source_id"), F.greatest("source_id", "target_id").alias("target_id"), "edge_type", "weight")
    return out.groupBy("source_id", "target_id", "edge_type").agg(F.round(F.sum("weight"), 4).alias("weight"))


def all_edges(nodes: DataFrame) -> DataFrame:
    out = chunk_sequence(nodes)
    for kind in (belongs_to_page, same_page, section_title, same_section):
        out = out.unionByName(kind(nodes))
    return dedup(out)


def collapse(edges: DataFrame) -> DataFrame:
    """The simple undirected graph: weights of parallel edges summed, at least 0.01 each, types as a sorted set, loops dropped."""
    out = edges.where("source_id <> target_id").select(F.least("source_id", "target_id").alias("u"), F.greatest("source_id", "target_id").alias("v"), F.greatest(F.lit(0.01), "weight").alias("weight"), "edge_type")
    return out.groupBy("u", "v").agg(F.round(F.sum("weight"), 6).alias("weight"), F.array_sort(F.collect_set("edge_type")).alias("edge_types"))


def both_ways(graph: DataFrame) -> DataFrame:
    return graph.select(F.col("u").alias("x"), F.col("v").alias("y"), "weight").unionByName(graph.select(F.col("v").alias("x"), F.col("u").alias("y"), "weight"))


def degrees(graph: DataFrame) -> DataFrame:
    return both_ways(graph).groupBy(F.col("x").alias("node_id")).agg(F.count("*").alias("degree"), F.round(F.sum("weight"), 4).alias("strength"))


def settle(df: DataFrame, name: str) -> DataFrame:
    """Cuts a loop's lineage: writes to the folder of spark.checkpoint.dir and reads back; without one the table is persisted, which spills to disk."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist()
    path = f"{folder.rstrip('/')}/dossier/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pagerank(links: DataFrame, seeds: DataFrame, alpha: float = 0.85, rounds: int = 200, tolerance: float = 1e-8) -> DataFrame:
    """(question_id, node_id, score): personalised PageRank of all questions at once, by power iteration.

    links: (question_id, x, y, weight) both ways, the graph of each question; seeds: (question_id, node_id, weight). It begins uniform;
    what nodes without links hold goes back to the seeds. Ends after `rounds`, or when the sum of a round's changes is below
    n * tolerance for every question, which is looked at every fifth round. A round is one join and one sum on (question_id, node)."""
    total = links.groupBy("question_id", "x").agg(F.sum("weight").alias("t"))
    moves = settle(links.join(total, ["question_id", "x"]).select("question_id", "x", "y", (F.col("weight") / F.col("t")).alias("p")), "moves")
    nodes = moves.select("question_id", F.col("x").alias("node_id"), F.lit(True).alias("linked")).union(seeds.select("question_id", "node_id", F.lit(False))).groupBy("question_id", "node_id").agg(F.max("linked").alias("linked"))
    given = seeds.groupBy("question_id", "node_id").agg(F.sum("weight").alias("w"))
    whole = Window.partitionBy("question_id")
    base = nodes.join(given, ["question_id", "node_id"], "left").withColumn("w", F.coalesce("w", F.lit(0.0))).withColumn("all", F.sum("w").over(whole)).withColumn("n", F.count("*").over(whole))
    state = settle(base.select("question_id", "node_id", F.when(F.col("all") > 0, F.col("w") / F.col("all")).otherwise(0.0).alias("seed"), "n", "linked", (1.0 / F.col("n")).alias("score"), F.lit(0.0).alias("before")), "rank")
    for i in range(1, rounds + 1):
        got = state.select("question_id", F.col("node_id").alias("x"), "score").join(moves, ["question_id", "x"]).groupBy("question_id", F.col("y").alias("node_id")).agg(F.sum(F.col("score") * F.col("p")).alias("got"))
        lost = F.sum(F.when(F.col("linked"), 0.0).otherwise(F.col("score"))).over(whole)
        new = alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("seed")) + (1 - alpha) * F.col("seed")
        state = state.withColumn("lost", lost).join(got, ["question_id", "node_id"], "left").select("question_id", "node_id", "seed", "n", "linked", new.alias("score"), F.col("score").alias("before"))
        state = settle(state, "rank")
        if i % 5 == 0 and i < rounds:
            moved = state.groupBy("question_id").agg(F.sum(F.abs(F.col("score") - F.col("before"))).alias("d"), F.first("n").alias("n"))
            if not moved.where(F.col("d") >= F.col("n") * tolerance).limit(1).count():
                break
    return state.select("question_id", "node_id", "score")


def document_summary(nodes: DataFrame) -> DataFrame:
    """Per document: pages, counts by type, mean and median length."""
    length = F.length("content")
    return nodes.groupBy("doc_id").agg(F.count("*").alias("n_nodes"), F.max("page").alias("pages"), *[F.count_if(F.col("node_type") == t).alias(f"n_{t}") for t in ("title", "text", "table")], F.round(F.avg(length), 4).alias("mean_length"), F.percentile(length, 0.5).alias("median_length"))
