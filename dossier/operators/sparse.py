"""The best nodes of many questions by weighted terms, in one map over the nodes: BM25 and character TF-IDF.

Terms are 64-bit hashes, counted inside a task in numpy over Arrow batches. Document frequencies are partial counts of each task,
added up by one shuffle of distinct terms. Questions go out in blocks of bounded size as an inverted index; each task keeps its best k
nodes for each question, so what is shuffled at last has k rows for each question and task, however large the corpus is. A
vocabulary that is too large to be sent to every task is left to the joins of `retrieval`, with equal results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from dossier.functions.text import bm25_tokens, clean_text
from dossier.operators.retrieval import bm25, char_tfidf, top_k
from dossier.operators.structure import settle

#: Questions of a block, and terms whose frequencies are sent to every task (16 bytes each).
QUESTION_BLOCK, MOST_TERMS = 4096, 4_000_000
#: Products of a node's and a question's weight that are held at a time, and cells of a table of weights.
PRODUCTS, CELLS = 1 << 21, 1 << 22
#: Characters of texts that are counted at a time, of one text at least.
SIZE = 1 << 19
#: Distinct terms of a task that are counted before they are sent on.
HELD_TERMS = 1 << 20
#: How many products of a table take as long as one of the index.
TABLE_GAIN = 16
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)

Terms = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def listed_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All terms of an array<long> column, and where each row begins, with the end at last."""
    flat = column.flatten()
    lengths = np.array([0 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], np.int64)
    return flat.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)])


def gram_rows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the runs of 2, 3 and 4 characters of each text, size by size."""
    lengths = np.array([len(t or "") for t in texts], np.int64)
    c = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    row = np.repeat(np.arange(len(texts)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(c))
    rows, terms, h = [], [], c * _STEP[0]
    for n in (2, 3, 4):
        # Runs of so many characters, of which those are left out that go on into the next text.
        h = h[:-1] + c[n - 1 :] * _STEP[n - 1]
        whole = left[: len(h)] >= n
        rows.append(row[: len(h)][whole])
        terms.append(_spread(h[whole] + np.uint64(n)))
    return np.concatenate(rows), np.concatenate(terms).view(np.int64)


def gram_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The runs of 2, 3 and 4 characters of each text as numbers, as listed_terms(). A text at a time, whose numbers stay near the processor."""
    out, ends = [np.zeros(0, np.uint64)], [0]
    for text in column.to_pylist():
        c = np.frombuffer((text or "").encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        h, size = c * _STEP[0], 0
        for n in (2, 3, 4):
            # Runs of fewer characters than n + 1 are sums of fewer products.
            h = h[:-1] + c[n - 1 :] * _STEP[n - 1]
            out.append(h)
            size += len(h)
        ends.append(ends[-1] + size)
    return np.concatenate(out).view(np.int64), np.array(ends, np.int64)


def counted(terms: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of the distinct terms of each row, in order."""
    return distinct(np.repeat(np.arange(len(at) - 1), np.diff(at)), terms)


def distinct(row: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of the distinct terms of rows that ascend."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    if len(row):
        at = np.searchsorted(row, np.arange(int(row[0]), int(row[-1]) + 2))
        # A sort of a row's own terms is many times faster than one by two keys.
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True), int(row[0])):
            if b > a:
                t = np.sort(terms[a:b])
                first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
                out.append((np.full(len(first), i), t[first], np.diff(np.append(first, b - a))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def pieces(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of a batch (node_id, x) of so many rows and SIZE characters or terms at most, of one row at least."""
    x = batch.column(1)
    length = pa.compute.list_value_length(x) if pa.types.is_list(x.type) else pa.compute.utf8_length(x)
    ends, first = np.cumsum(pa.compute.fill_null(length, 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while first < len(batch):
        last = min(first + rows, max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SIZE, "right"))))
        yield batch.slice(first, last - first)
        first = last


def frequencies(nodes: DataFrame, terms_of: Terms, among: np.ndarray | None = None) -> DataFrame:
    """(term, df): in how many nodes (node_id, x) each term is; of all terms, or of those among sorted ones."""

    return nodes.mapInArrow(counter(terms_of, among), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def counter(terms_of: Terms, among: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over batches (node_id, x) that adds up a task's counts, a bounded number of terms at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in pieces(batch):
                _, terms, _ = counted(*terms_of(part.column(1)))
                if among is not None:
                    terms = terms[np.isin(terms, among)]
                held.append(np.unique(terms, return_counts=True))
                n += len(held[-1][0])
                if n > HELD_TERMS:
                    held, n = [added(held)], 0
                    if len(held[0][0]) > HELD_TERMS // 2:
                        yield row_of(held.pop())
        if held:
            yield row_of(added(held))

    row_of = lambda x: pa.RecordBatch.from_arrays([pa.array(x[0], pa.int64()), pa.array(x[1], pa.int64())], ["term", "df"])
    return run


def added(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of counts (term, n)."""
    terms, place = np.unique(np.concatenate([t for t, _ in counts]), return_inverse=True)
    return terms, np.bincount(place, np.concatenate([n for _, n in counts]), minlength=len(terms)).astype(np.int64)


def best(nodes: DataFrame, terms_of: Terms, weigh: Callable, index: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], names: np.ndarray, k: int, scopes: list[str | None] | None = None) -> DataFrame:
    """(question_id, node_id, score): each task's k best nodes above 0 of each question.

    index: sorted terms, where the postings of each begin, and the postings' questions and weights; weigh(row, term, count, n) gives the weights of nodes' terms.
    With a scope for each question, nodes have a third column, doc_id: (question_id, node_id, score, inside), the k best that share a term with the question of the nodes of its scope, and of the others."""
    vocabulary, begin, question, weight = index

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = len(names)
        table = None
        # The best of all nodes, or of those inside and of those outside a question's scope.
        kept = [(np.zeros((q, 0)), np.zeros((q, 0), np.int64)) for _ in range(1 if scopes is None else 2)]
        for batch in batches:
            for part in pieces(batch):
                ids = part.column(0).to_numpy()
                row, term, count = counted(*terms_of(part.column(1)))
                w = weigh(row, term, count, len(ids))
                place = np.searchsorted(vocabulary, term)
                found = np.flatnonzero((place < len(vocabulary)) & (vocabulary[np.minimum(place, len(vocabulary) - 1)] == term)) if len(vocabulary) else np.zeros(0, np.int64)
                row, place, w = row[found], place[found], w[found]
                many = begin[place + 1] - begin[place]
                if len(vocabulary) * q <= CELLS and len(ids) * len(vocabulary) * q <= TABLE_GAIN * int(many.sum()):
                    if table is None:
                        table = np.zeros((len(vocabulary), q))
                        table[np.repeat(np.arange(len(vocabulary)), np.diff(begin)), question] = weight
                    got = by_table(row, place, w, len(ids), table)
                else:
                    got = by_index(row, place, w, many, len(ids), q, begin, question, weight)
                got = np.where(got.T > 0, np.round(got.T, 6), -1.0)
                if scopes is None:
                    kept[0] = top(*kept[0], got, ids, k)
                else:
                    inside = within(scopes, part.column(2))
                    kept = [top(*x, np.where(inside == side, got, -1.0), ids, k) for x, side in zip(kept, (True, False), strict=True)]
        for (score, node), side in zip(kept, (True, False), strict=False):
            # A pair that shares a term may have a score that rounds to 0, which only a scope can have among its best.
            there = score > 0 if scopes is None else score >= 0
            out = [pa.array(np.broadcast_to(names[:, None], score.shape)[there]), pa.array(node[there]), pa.array(score[there])]
            yield pa.RecordBatch.from_arrays(out if scopes is None else [*out, pa.array(np.full(len(out[0]), side))], columns)

    columns = ["question_id", "node_id", "score"] + ([] if scopes is None else ["inside"])
    return nodes.mapInArrow(run, "question_id long, node_id long, score double" + ("" if scopes is None else ", inside boolean"))


def top(score: np.ndarray, node: np.ndarray, more: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of scores (question, place) with their nodes and of more of these, whose nodes are the ids; ties by node."""
    s, d = np.concatenate([score, more], 1), np.concatenate([node, np.broadcast_to(ids, more.shape)], 1)
    order = np.lexsort((d, -s), axis=1)[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(d, order, 1)


def within(scopes: list[str | None], docs: pa.Array) -> np.ndarray:
    """Whether a node (column) is in the scope of a question (row); a null is in none."""
    number = {x: i for i, x in enumerate(dict.fromkeys(x for x in scopes if x is not None))}
    own = np.array([number.get(x, -1) for x in scopes])
    named = np.array([number.get(x, -2) for x in docs.to_pylist()])
    return own[:, None] == named[None, :]


def by_table(row: np.ndarray, place: np.ndarray, w: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """Scores (node, question) by products of tables, where most terms are in many questions."""
    got, step = np.zeros((n, table.shape[1])), max(1, CELLS // max(1, len(table)))
    for a in range(0, n, step):
        low, high = np.searchsorted(row, (a, a + step))
        own = np.zeros((min(step, n - a), len(table)))
        own[row[low:high] - a, place[low:high]] = w[low:high]
        got[a : a + step] = own @ table
    return got


def by_index(row: np.ndarray, place: np.ndarray, w: np.ndarray, many: np.ndarray, n: int, q: int, begin: np.ndarray, question: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Scores (node, question) by the postings of the nodes' terms, some at a time."""
    got, ends, start = np.zeros(n * q), np.cumsum(many), 0
    while start < len(many):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PRODUCTS, "right")))
        m = many[start:stop]
        post = np.arange(int(m.sum())) + np.repeat(begin[place[start:stop]] - np.concatenate([[0], np.cumsum(m)[:-1]]), m)
        low = int(row[start])
        part_sum = np.bincount((np.repeat(row[start:stop], m) - low) * q + question[post], np.repeat(w[start:stop], m) * weight[post])
        got[low * q : low * q + len(part_sum)] += part_sum
        start = stop
    return got.reshape(n, q)


def question_blocks(questions: DataFrame, terms_of: Terms) -> Iterator[tuple[np.ndarray, list[list], np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of questions (question_id, x, ...) in the order of ids: their ids, their columns after x, and (row, term, count) of their terms. Only the first of rows that repeat an id counts."""
    asked, last = questions.dropDuplicates(["question_id"]).where("question_id is not null"), None
    while True:
        rest = asked if last is None else asked.where(F.col("question_id") > last)
        block = rest.orderBy("question_id").limit(QUESTION_BLOCK).toArrow()
        if not len(block):
            return
        names = block.column(0).to_numpy()
        last = int(names[-1])
        yield names, [c.to_pylist() for c in block.columns[2:]], *counted(*terms_of(block.column(1).combine_chunks()))


def inverted(row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((row, term))
    vocabulary, begin = np.unique(term[order], return_index=True)
    return vocabulary, np.append(begin, len(term)), row[order], weight[order]


def _hashed(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def bm25_topk(nodes: DataFrame, questions: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(question_id, node_id, score, rank): the k best nodes above 0 by BM25; scores have six digits, ties go by node. Ids are whole numbers."""
    out = _bm25(nodes, questions, k, k1, b)
    return top_k(out if out is not None else bm25(nodes, questions).select(F.col("question_id").cast("long"), F.col("node_id").cast("long"), "score"), k)


def bm25_scoped(nodes: DataFrame, questions: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(question_id, node_id, score, rank): the k best nodes that share a term with the question among those of its scope; among all where it has none or one without such a node. As bm25_topk(), which see.

    nodes: (node_id, text, doc_id); questions: (question_id, text, scope), doc_id and scope being texts."""
    out = _bm25(nodes, questions, k, k1, b, scoped=True)
    if out is None:
        return top_k(bm25(nodes, questions).select(F.col("question_id").cast("long"), F.col("node_id").cast("long"), "score"), k)
    some = F.max("inside").over(Window.partitionBy("question_id"))
    return top_k(out.withColumn("some", some).where(F.col("inside") == F.col("some")).select("question_id", "node_id", "score"), k)


def _bm25(nodes: DataFrame, questions: DataFrame, k: int, k1: float, b: float, scoped: bool = False) -> DataFrame | None:
    """The best nodes of each task, or None where there is no question."""
    own = nodes.select(F.col("node_id").cast("long").alias("node_id"), _hashed(bm25_tokens(F.col("text"))).alias("x"), *(["doc_id"] if scoped else []))
    # Three maps read them; to make them takes longer than all of these.
    own = settle(own, "tokens")
    asked = questions.select(F.col("question_id").cast("long").alias("question_id"), _hashed(bm25_tokens(F.col("text"))).alias("x"), *(["scope"] if scoped else []))
    size = own.agg(F.count("*").alias("n"), F.avg(F.size("x")).alias("mean")).first()
    out = None
    for names, rest, row, term, count in question_blocks(asked, listed_terms):
        df = frequencies(own, listed_terms, np.unique(term)).toArrow()
        at = np.argsort(df.column(0).to_numpy())
        known, n = df.column(0).to_numpy()[at], df.column(1).to_numpy()[at]
        place = np.searchsorted(known, term)
        there = (place < len(known)) & (known[np.minimum(place, max(0, len(known) - 1))] == term) if len(known) else np.zeros(len(term), bool)
        row, term, count, d = row[there], term[there], count[there], n[place[there]]
        idf = np.log(1 + (size["n"] - d + 0.5) / (d + 0.5))

        def weigh(r: np.ndarray, t: np.ndarray, tf: np.ndarray, rows: int) -> np.ndarray:
            length = np.bincount(r, tf, minlength=rows)
            return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[r] / size["mean"]))

        got = best(own, listed_terms, weigh, inverted(row, term, count * idf), names, k, rest[0] if scoped else None)
        out = got if out is None else out.unionByName(got)
    return out


def gram_topk(nodes: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(question_id, node_id, score, rank): the k best nodes above 0 by the cosine of character TF-IDF vectors fitted on the nodes; as bm25_topk()."""
    text = F.regexp_replace(F.lower(clean_text(F.col("text"))), r"\s\s+", " ")
    own = nodes.select(F.col("node_id").cast("long").alias("node_id"), text.alias("x"))
    asked = questions.select(F.col("question_id").cast("long").alias("question_id"), text.alias("x"))
    df = frequencies(own, gram_terms).limit(MOST_TERMS + 1).toArrow()
    if len(df) > MOST_TERMS:
        return top_k(char_tfidf(nodes, questions).withColumn("score", F.round("score", 6)).where("score > 0"), k)
    at = np.argsort(df.column(0).to_numpy())
    known, idf = df.column(0).to_numpy()[at], np.log((1.0 + nodes.count()) / (1 + df.column(1).to_numpy()[at])) + 1

    def weigh(r: np.ndarray, t: np.ndarray, tf: np.ndarray, rows: int) -> np.ndarray:
        w = tf * idf[np.searchsorted(known, t)]
        return w / np.sqrt(np.bincount(r, w * w, minlength=rows))[r]

    out = None
    for names, _, row, term, count in question_blocks(asked, gram_terms):
        there = np.isin(term, known)
        row, term, count = row[there], term[there], count[there]
        got = best(own, gram_terms, weigh, inverted(row, term, weigh(row, term, count, len(names))), names, k)
        out = got if out is None else out.unionByName(got)
    return top_k(out if out is not None else char_tfidf(nodes, questions).select(F.col("question_id").cast("long"), F.col("node_id").cast("long"), "score"), k)
