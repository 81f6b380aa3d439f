"""The entity graph of a corpus: terms of nodes, entities, relations and communities, as explodes and aggregations."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from dossier.functions.text import SPACES

# Words that are no terms.
STOP_TERMS = ("this", "that", "with", "from", "into", "were", "been", "have", "will", "should", "using", "based", "figure", "table", "page", "section", "system", "method", "result", "results", "the", "and", "for", "are", "not")
_WORD = r"(?:[A-Z][A-Za-z0-9+\-]{2,}|[a-z][a-z0-9+\-]{3,})"
TERM = rf"\b{_WORD}(?:\s+{_WORD}){{0,2}}\b"
#: For SQL, whose word boundaries know ASCII only: words with a letter beyond it, which hold no Latin term.
FOREIGN = "[A-Za-z0-9_À-￿]*[À-￿][A-Za-z0-9_À-￿]*"


#: A letter, digit or underscore of any script, and a boundary between such and others.
_IN = r"[\p{L}\p{N}_]"
_EDGE = rf"(?:(?<={_IN})(?!{_IN})|(?<!{_IN})(?={_IN}))"
#: Latin terms as Spark's patterns; the map finds the same by Python's, whose word boundaries know all scripts.
_LATIN = rf"(?U)(?<!{_IN}){_WORD}(?:\s+{_WORD}){{0,2}}{_EDGE}"
#: The same for texts of ASCII alone, for Spark and Python.
_PLAIN = rf"\b{_WORD}(?:\s+{_WORD}){{0,2}}\b"
_NUMBER = r"[Ss]?\d+(?:[.\-]\d+)?[A-Za-z]?"
_BLANK = f"[{SPACES}]"

#: Where a word may start. Letters beyond the BMP are none to what follows them, as to SQL and to lookbehinds of Spark's patterns.
_START = "(?:(?<!\\w)|(?<=[\U00010000-\U0010ffff]))"

_plain = re.compile(_PLAIN, re.ASCII).findall
_latin = re.compile(rf"{_START}{_WORD}(?:{_BLANK}+{_WORD}){{0,2}}\b").findall
_references = re.compile(rf"(?:{_START}(?:fig\.?|figure|table)|[图圖表]){_BLANK}*{_NUMBER}", re.IGNORECASE).findall
_is_table = re.compile("table|表", re.IGNORECASE | re.ASCII).match
_number = re.compile(rf"{_NUMBER}\Z").search
_has_digit = re.compile(r"\d").search
_cjk = re.compile("[一-鿿]{2,12}").findall
_blanks = re.compile("  +").sub
_feeds = re.compile("\n{3,}").sub
_STOP = frozenset(STOP_TERMS)


def cleaned(text: str) -> str:
    """clean_text() of a value."""
    for x in "\x00\t\r\f\x0b":
        text = text.replace(x, " ")
    if "  " in text:
        text = _blanks(" ", text)
    if "\n\n\n" in text:
        text = _feeds("\n\n", text)
    return text.strip(SPACES)


def text_terms(text: str) -> dict[str, int]:
    """The weights of a text's terms, in order: references, as figure 3 or table S2a, count 4; runs of one to three Latin words
    one, with a capital two; runs of up to six ideographs two, of longer ones (a run ends after twelve) the parts of two to four one."""
    out: dict[str, int] = {}
    text = cleaned(text)
    if plain := text.isascii():
        low = text.lower()
        named = "fig" in low or "table" in low
    else:
        named = True
    if named and _has_digit(text):
        for m in _references(text):
            n = _number(m)
            term = f"{'table' if _is_table(m) else 'figure'} {n[0] if n else ''}"
            out[term] = out.get(term, 0) + 4
    for t in _plain(text) if plain else _latin(text):
        low = t.lower()
        if low not in _STOP:
            out[t] = out.get(t, 0) + (1 if low == t else 2)
    if not plain:
        for run in _cjk(text):
            if len(run) <= 6:
                out[run] = out.get(run, 0) + 2
            else:
                for k in (2, 3, 4):
                    for i in range(len(run) - k + 1):
                        out[run[i : i + k]] = out.get(run[i : i + k], 0) + 1
    return out


def _weightiest(counts: dict, limit: int, size: Callable = len) -> list:
    """The keys of the `limit` heaviest, ties by the longer term, then in order."""
    best = sorted(counts, key=size, reverse=True)
    best.sort(key=counts.__getitem__, reverse=True)
    return best[:limit]


def node_weights(rows: list[tuple], limit: int) -> list[tuple]:
    """(doc_id, section, term, weight) of a node's weightiest terms. rows: (doc_id, section, text), most often one."""
    if len(rows) == 1:
        doc, section, text = rows[0]
        counts = text_terms(text)
        return [(doc, section, t, counts[t]) for t in _weightiest(counts, limit)]
    total: dict[tuple, int] = {}
    first: dict[tuple, int] = {}
    for doc, section, text in rows:
        for pos, (t, n) in enumerate(text_terms(text).items()):
            key = (doc, section, t)
            total[key] = total.get(key, 0) + n
            first[key] = min(first.get(key, pos), pos)
    ordered = {k: total[k] for k in sorted(total, key=first.__getitem__)}
    return [(*k, ordered[k]) for k in _weightiest(ordered, limit, lambda k: len(k[2]))]


def _text(value: bytes | None) -> str:
    return value.decode("utf-8", "replace") if value else ""


#: Rows that are sent on and entities that are held at a time, and input rows held as Python values.
HELD, ENTITIES, ROWS = 1 << 16, 1 << 18, 256


def _values(batches: Iterator[pa.RecordBatch], kinds: list[pa.DataType] | None = None) -> Iterator[tuple]:
    for batch in batches:
        if kinds is not None:
            kinds[:] = batch.schema.types
        for i in range(0, len(batch), ROWS):
            yield from zip(*(c.to_pylist() for c in batch.slice(i, ROWS).columns), strict=True)


def _standing(df: DataFrame, key: str) -> DataFrame:
    """Rows of a key stand together in one task."""
    return df.repartition(key).sortWithinPartitions(key)


def node_terms(nodes: DataFrame, limit: int = 12) -> DataFrame:
    """(node_id, doc_id, section, term, n, place): each node's `limit` weightiest references, Latin and CJK terms; ties go to the longer, then to the first in this order.

    Terms are found and counted in a map over texts that stand by node, so that no row is made for a term which is not among these."""
    own = nodes.select("node_id", "doc_id", "section", F.col("content").cast("binary").alias("__text"))
    kinds = ", ".join(f"{n} {nodes.schema[n].dataType.simpleString()}" for n in ("node_id", "doc_id", "section"))
    return _standing(own, "node_id").mapInArrow(placed(limit), f"{kinds}, term string, n long, place int")


def placed(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over batches (node_id, doc_id, section, text) that stand by node to the terms of node_terms()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []
        names, out = ["node_id", "doc_id", "section", "term", "n", "place"], []

        def made() -> pa.RecordBatch:
            types = [*kinds[:3], pa.string(), pa.int64(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names)

        for node, own in groupby(_values(batches, kinds), itemgetter(0)):
            best = node_weights([(doc, section, _text(t)) for _, doc, section, t in own], limit)
            out.extend((node, *x, place) for place, x in enumerate(best, 1))
            if len(out) >= HELD:
                yield made()
                out = []
        if out:
            yield made()

    return run


def entities(terms: DataFrame) -> DataFrame:
    """(entity_id, entity_type, n_nodes, n_docs, evidence_count): documents as products, sections and terms as parts; ids ignore case."""
    part = terms.select(F.concat(F.lit("part:"), F.lower("term")).alias("entity_id"), F.lit("part").alias("entity_type"), "node_id", "doc_id")
    section = terms.where("section <> ''").select(F.concat(F.lit("part:"), F.lower("section")).alias("entity_id"), F.lit("part").alias("entity_type"), "node_id", "doc_id").distinct()
    product = terms.select("node_id", "doc_id").distinct().select(F.concat(F.lit("product:"), F.col("doc_id").cast("string")).alias("entity_id"), F.lit("product").alias("entity_type"), "node_id", "doc_id")
    rows = part.unionByName(section).unionByName(product)
    by_node = rows.groupBy("entity_id", "entity_type", "doc_id", "node_id").agg(F.count("*").alias("n"))
    by_doc = by_node.groupBy("entity_id", "entity_type", "doc_id").agg(F.count("*").alias("nodes"), F.sum("n").alias("n"))
    return by_doc.groupBy("entity_id", "entity_type").agg(F.sum("nodes").alias("n_nodes"), F.count("*").alias("n_docs"), F.sum("n").alias("evidence_count"))


def document_entities(documents: DataFrame, limit: int = 12) -> DataFrame:
    """entities() of the terms of document_nodes(): a node is a line, whose kind and place in its document are its id.

    A document's lines stand in one task, so a map counts its nodes and evidence as it finds their terms; no row is made for a line or
    a term, and what is shuffled after are the entities of each task."""
    lower = F.lower("source").alias("lower")
    own = documents.where("text is not null").select("doc_id", F.col("doc_id").cast("string").alias("name"), "source", lower, F.col("text").cast("binary").alias("text"))
    schema = "entity_id string, entity_type string, n_nodes long, n_docs long, evidence_count long"
    sums = [F.sum(c).alias(c) for c in ("n_nodes", "n_docs", "evidence_count")]
    return _standing(own, "doc_id").mapInArrow(counted(limit), schema).groupBy("entity_id", "entity_type").agg(*sums)


def _lines(texts: list[tuple]) -> Iterator[list[tuple]]:
    """The nodes of one document's texts (section, lower, text), each with its rows ((section, lower), None, line), most often one."""
    if len(texts) == 1:
        ((section, lower, text),) = texts
        for line in text.split("\n"):
            yield [((section, lower), None, line)]
        return
    nodes: dict[tuple, list[tuple]] = {}
    for section, lower, text in texts:
        for i, line in enumerate(text.split("\n")):
            nodes.setdefault((i, i > 0 and "|" in line), []).append(((section, lower), None, line))
    yield from nodes.values()


def counted(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over batches (doc_id, name, source, lower, text) that stand by document to the nodes, documents and evidence of entities; an entity comes again when ENTITIES were held between."""
    names = ["entity_id", "entity_type", "n_nodes", "n_docs", "evidence_count"]

    def made(nodes: Counter, docs: Counter, more: dict[str, int], products: list[tuple]) -> pa.RecordBatch:
        ids = [f"part:{k}" for k in nodes] + [None if d is None else f"product:{d}" for d, _ in products]
        kinds = ["part"] * len(nodes) + ["product"] * len(products)
        own = [n for _, n in products]
        numbers = ([*nodes.values(), *own], [*map(docs.__getitem__, nodes), *[1] * len(products)], [*(n + more.get(k, 0) for k, n in nodes.items()), *own])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(kinds, pa.string()), *(pa.array(c, pa.int64()) for c in numbers)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of each part its nodes, its documents and, if a node tells it more than once, its further evidence.
        nodes, docs, more, products = Counter(), Counter(), {}, []
        for _, own in groupby(_values(batches), itemgetter(0)):
            texts, name = [], None
            for _, name, section, lower, text in own:  # noqa: B007
                texts.append((section, lower, _text(text)))
            found, n = [], 0
            for rows in _lines(texts):
                best = node_weights(rows, limit)
                if not best:
                    continue
                n += 1
                keys = [x[2].lower() for x in best]
                keys += {lower for (_, lower), *_ in best if lower}
                once = set(keys)
                found += once
                if len(once) < len(keys):
                    for k in keys:
                        if k in once:
                            once.remove(k)
                        else:
                            more[k] = more.get(k, 0) + 1
            if n:
                nodes.update(found)
                docs.update(set(found))
                products.append((name, n))
            if len(nodes) + len(products) >= ENTITIES:
                yield made(nodes, docs, more, products)
                nodes, docs, more, products = Counter(), Counter(), {}, []
        if products:
            yield made(nodes, docs, more, products)

    return run


def relations(terms: DataFrame) -> DataFrame:
    """(source_id, target_id, relation_type, weight, n): products and sections with their parts, and the pairs of a node's first six terms; weights summed."""
    term = F.concat(F.lit("part:"), F.lower("term"))
    product = F.concat(F.lit("product:"), F.col("doc_id").cast("string"))
    has = terms.select(product.alias("source_id"), term.alias("target_id"), F.lit("product_has_part").alias("relation_type"), F.lit(0.25).alias("weight"))
    of = terms.where("section <> ''").select(F.concat(F.lit("part:"), F.lower("section")).alias("source_id"), term.alias("target_id"), F.lit("product_has_part").alias("relation_type"), F.lit(0.35).alias("weight"))
    six = terms.where("place <= 6").groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.lower("term").alias("t")))), lambda x: F.concat(F.lit("part:"), x["t"])).alias("a"))
    pairs = six.select(F.posexplode("a").alias("i", "source_id"), "a").select("source_id", F.explode(F.slice("a", F.col("i") + 2, F.lit(6))).alias("target_id"))
    together = pairs.select("source_id", "target_id", F.lit("concept_cooccurs").alias("relation_type"), F.lit(0.08).alias("weight"))
    rows = has.unionByName(of).unionByName(together).where("source_id <> target_id")
    return rows.groupBy("source_id", "target_id", "relation_type").agg(F.round(F.sum("weight"), 2).alias("weight"), F.count("*").alias("n"))


def communities(nodes: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, label, node_count, pages, n_tables, top_terms): nodes by document and section, else page; the ten terms that are among the first eight of most nodes."""
    label = F.when(F.col("section") != "", F.col("section")).otherwise(F.concat(F.lit("page:"), F.col("page").cast("string")))
    named = nodes.withColumn("label", label)
    own = named.groupBy("doc_id", "label").agg(F.count("*").alias("node_count"), F.countDistinct("page").alias("pages"), F.count_if(F.col("node_type") == "table").alias("n_tables"))
    said = terms.where("place <= 8").join(named.select("node_id", "label"), "node_id").groupBy("doc_id", "label", "term").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "label").orderBy(F.desc("n"), "term"))
    top = said.withColumn("r", rank).where("r <= 10").groupBy("doc_id", "label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]), "|").alias("top_terms"))
    return own.join(top, ["doc_id", "label"], "left").withColumn("top_terms", F.coalesce("top_terms", F.lit("")))
