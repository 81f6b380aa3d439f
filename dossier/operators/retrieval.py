"""Retrieval routes as term joins over all questions at once: BM25, character TF-IDF, embeddings, and the choice of the best.

Corpora are tables (node_id, text), questions (question_id, text). Postings hold a row for each node and term, so partial sums
happen before a shuffle; only terms that some question has are joined."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from dossier.functions.text import bm25_tokens, clean_text, grams

#: A block of queries that goes to every task at once: 4096 x 1024 doubles are 32 MB.
QUERY_BLOCK = 4096
#: Products of a query and a row that a task holds at a time.
PRODUCTS = 1 << 20


def postings(texts: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, term, tf)"""
    return texts.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequencies(posts: DataFrame, n: int) -> DataFrame:
    """(term, df, idf) by BM25's formula."""
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def bm25(nodes: DataFrame, questions: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(question_id, node_id, score) of the pairs that share a term. Lengths count expanded tokens; a repeated question term counts again."""
    asked = postings(questions, "question_id", bm25_tokens(F.col("text"))).withColumnRenamed("tf", "qtf")
    own = nodes.select("node_id", bm25_tokens(F.col("text")).alias("t"))
    size = own.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("mean")).first()
    # The question terms prune the postings before their shuffle.
    words = own.select("node_id", F.size("t").alias("len"), F.explode("t").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    posts = words.groupBy("node_id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    idf = document_frequencies(posts, size["n"]).drop("df")
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(size["mean"])))
    weighted = posts.join(idf, "term").select("node_id", "term", (F.col("idf") * part).alias("w"))
    return weighted.join(asked, "term").groupBy("question_id", "node_id").agg(F.sum(F.col("qtf") * F.col("w")).alias("score"))


def char_terms(c: Column) -> Column:
    """The character 2- to 4-grams of a text, lower-cased, white space runs as one blank."""
    c = F.regexp_replace(F.lower(clean_text(c)), r"\s\s+", " ")
    return grams(c, 2, 3, 4)


def char_tfidf(nodes: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, node_id, score): cosine of character TF-IDF vectors fitted on the nodes; grams that no node has are dropped."""
    posts = postings(nodes, "node_id", char_terms(F.col("text")))
    n = nodes.count()
    idf = posts.groupBy("term").agg((F.ln((1.0 + n) / (1 + F.count("*"))) + 1).alias("idf"))
    weighted = posts.join(idf, "term").select("node_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weighted.groupBy("node_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    asked = postings(questions, "question_id", char_terms(F.col("text"))).join(idf, "term").select("question_id", "term", (F.col("tf") * F.col("idf")).alias("q"))
    lengths = asked.groupBy("question_id").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("length"))
    dots = weighted.join(asked, "term").groupBy("question_id", "node_id").agg(F.sum(F.col("q") * F.col("w")).alias("dot"))
    return dots.join(norms, "node_id").join(lengths, "question_id").select("question_id", "node_id", (F.col("dot") / (F.col("norm") * F.col("length"))).alias("score"))


def embedding_topk(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(question_id, node_id, score, rank): the k nearest by cosine, negatives as 0; ties by the smaller id.

    Queries go out in blocks of bounded size; each task keeps the best k of its rows for each query, so the shuffle has k rows for each query and task."""
    schema = "question_id long, node_id long, score double"
    asked = queries.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).dropDuplicates(["id"])
    own = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("node_id"), vector_col)
    out, last = own.select(F.lit(0).cast("long").alias("question_id"), "node_id", F.lit(0.0).alias("score")).where("false"), None
    while True:
        rest = asked if last is None else asked.where(F.col("id") > last)
        block = rest.where("id is not null").orderBy("id").limit(QUERY_BLOCK).toArrow()
        if not len(block):
            return top_k(out, k)
        last = block.column("id")[-1].as_py()
        out = out.unionByName(own.mapInArrow(nearest(block.column("id").to_numpy(), unit(matrix(block.column("v"))), k), schema))


def nearest(names: np.ndarray, q: np.ndarray, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over batches (id, vector) that ends with the best k of a task's rows for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, node = np.full((len(names), 0), -1.0), np.zeros((len(names), 0), np.int64)
        step = max(1, PRODUCTS // max(1, len(names)))
        for part in (batch.slice(i, step) for batch in batches for i in range(0, len(batch), step)):
            s = np.round(np.maximum(q @ unit(matrix(part.column(1))).T, 0), 9)
            s, d = np.concatenate([score, s], 1), np.concatenate([node, np.broadcast_to(part.column(0).to_numpy(), s.shape)], 1)
            order = np.lexsort((d, -s), axis=1)[:, :k]
            score, node = np.take_along_axis(s, order, 1), np.take_along_axis(d, order, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, score.shape[1])), pa.array(node.ravel()), pa.array(score.ravel())], ["question_id", "node_id", "score"])

    return run


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    return np.asarray(pa.compute.list_flatten(column), np.float64).reshape(len(column), -1)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; a zero row stays."""
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def top_k(scores: DataFrame, k: int, tie: str = "node_id") -> DataFrame:
    """The k best rows of each question with their rank; ties in the order of `tie`."""
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), tie)).cast("long")
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def scoped_top_k(scores: DataFrame, node_docs: DataFrame, scopes: DataFrame, k: int) -> DataFrame:
    """Top k among the nodes of the question's document; among all where the question names none or none that has a scored node."""
    placed = scores.join(node_docs, "node_id").join(scopes, "question_id", "left")
    inside = F.coalesce(F.col("doc_id") == F.col("scope"), F.lit(False))
    any_inside = F.max(inside).over(Window.partitionBy("question_id"))
    kept = placed.withColumn("inside", inside).withColumn("any", any_inside).where("inside or not any")
    return top_k(kept.select("question_id", "node_id", "score"), k)
