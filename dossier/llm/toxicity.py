"""Toxicity by non-negative positive-unlabelled learning.

Known are confirmed toxic texts and texts of which nothing is known; the class prior is the toxic share of the labelled rows. A
linear model over the presence of words and word beginnings minimises, in numpy, the class-prior-corrected risk

    prior * E_toxic[l(g)] + max(0, E_unlabelled[l(-g)] - prior * E_toxic[l(-g)])

with the logistic loss l: when the part in max() falls below 0, it is stepped back from, so that it can't be driven down
by overfitting. Features are those that make a text toxic with a probability of 0.6 at least, by the prior and Bayes' rule,
the most telling first, at most `n_features`. Training takes whole texts of at most `n_toxic` toxic and `n_unlabelled` other rows, chosen by a hash of the id.

A text's score is the sigmoid of its sum over the distinct features it holds, read whole. Null and empty texts get the score of
a text without any feature. Without a confirmed toxic text all scores are the prior (0 without labels). Rows that repeat an id are
scored each by its own text; ids are whole numbers. An empty table gives an empty result. Columns of the caller named score or predicted
are replaced, others pass through."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .common import materialize, release
from .kernels import slices

#: Lengths of word beginnings that are features beside the words.
BEGINNINGS = (3, 4, 5, 6, 7)
_WORDS = re.compile(r"[^\W\d_]+")
#: Words whose weight a task remembers.
REMEMBERED = 500_000


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]


def features(text: str) -> set[str]:
    return {f for w in set(_WORDS.findall(text.lower())) for f in features_of(w)}


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def scores(self, texts: list[str], known: dict[str, tuple[str, ...]]) -> np.ndarray:
        """known: for words seen before, the features of them that have a weight."""
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            held: set[str] = set()
            for w in set(_WORDS.findall(text.lower())):
                own = known.get(w)
                if own is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    own = known[w] = tuple(f for f in features_of(w) if f in self.weights)
                if own:
                    held.update(own)
            out[i] = self.bias + sum(sorted(self.weights[f] for f in held))
        return 0.5 * (1 + np.tanh(out / 2))


def choose_features(sample: DataFrame, n_toxic: int, n_other: int, prior: float, n_features: int, least: int = 5, sure: float = 0.6) -> list[str]:
    """The features seen in at least `least` toxic texts that make a text toxic with a probability of `sure` at least, by Bayes' rule; those that tell the most apart first.

    sample: (text, toxic, other). Tasks count the features of their own texts, one sum adds them up; n_features names come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                p, u = Counter(), Counter()
                for text, toxic, other in zip(*[part.column(c).to_pylist() for c in ("text", "toxic", "other")], strict=True):
                    held = features(text)
                    if toxic:
                        p.update(held)
                    if other:
                        u.update(held)
                names = sorted(p.keys() | u.keys())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([p[f] for f in names], pa.int64()), pa.array([u[f] for f in names], pa.int64())], ["feature", "p", "u"])

    sums = sample.mapInArrow(count, "feature string, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    there, here = F.col("p") / max(1, n_toxic), F.least(F.lit(1.0), (F.col("u") + 1) / max(1, n_other))
    apart = (there - here) / F.sqrt(there * (1 - there) / max(1, n_toxic) + here * (1 - here) / max(1, n_other) + 1e-9)
    found = sums.where((F.col("p") >= least) & (prior * there >= sure * here)).select("feature", F.round(apart, 6).alias("apart"))
    return [r["feature"] for r in found.orderBy(F.desc("apart"), "feature").limit(n_features).collect()]


def matrices(sample: DataFrame, chosen: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Presence of the chosen features in the toxic and the other texts, rows in the order of ids."""
    at = {f: i for i, f in enumerate(chosen)}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                held = [sorted(at[f] for f in features(x) if f in at) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("toxic"), part.column("other"), pa.array(held, pa.list_(pa.int32()))], ["id", "toxic", "other", "held"])

    got = sorted(map(tuple, sample.mapInArrow(look, "id long, toxic boolean, other boolean, held array<int>").collect()))
    out = []
    for k in (1, 2):
        rows = [r[3] for r in got if r[k]]
        m = np.zeros((len(rows), len(chosen)), np.float32)
        for i, held in enumerate(rows):
            m[i, held] = 1
        out.append(m)
    return out[0], out[1]


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """The risk of toxic texts, the part in max(), and the gradient that is stepped along: the risk's, or against that part's when it is below 0."""
    sigmoid = lambda z: 0.5 * (1 + np.tanh(z / 2))
    now = w[:-1].astype(np.float32)
    g_p, g_u = p @ now + w[-1], u @ now + w[-1]
    # l(g) = log(1 + exp(-g)), its slope is sigmoid(g) - 1; that of l(-g) is sigmoid(g).
    negative = np.logaddexp(0, g_u).mean() - prior * np.logaddexp(0, g_p).mean()
    sign = 1.0 if negative >= 0 else -1.0
    d_p = prior * ((sigmoid(g_p) - 1) * (negative >= 0) - sign * sigmoid(g_p)) / len(p)
    d_u = sign * sigmoid(g_u) / len(u)
    grad = np.append(p.T @ d_p.astype(np.float32) + u.T @ d_u.astype(np.float32), d_p.sum() + d_u.sum())
    return float(prior * np.logaddexp(0, -g_p).mean()), float(negative), grad


def train(p: np.ndarray, u: np.ndarray, chosen: list[str], prior: float, steps: int = 200, rate: float = 0.05, ridge: float = 5e-4) -> Model:
    """Adam on the non-negative risk. p, u: presence of the chosen features in toxic and unlabelled texts."""
    w = np.zeros(len(chosen) + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        grad = risk(w, p, u, prior)[2]
        grad[:-1] += ridge * w[:-1]
        first += 0.1 * (grad - first)
        second += 0.001 * (grad * grad - second)
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model({f: float(x) for f, x in zip(chosen, w[:-1], strict=True) if abs(x) > 1e-3}, float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", n_toxic: int = 2000, n_unlabelled: int = 6000, n_features: int = 600, seed: int = 9) -> Model:
    """labels: (id, toxic 0 or 1); only rows for which `learn` is true are used, of docs and labels both. Of rows that repeat an id, one text is taken, and the label 1 if any is."""
    known = labels.where("toxic is not null and id is not null").groupBy("id").agg(F.max("toxic").alias("toxic")).where(learn)
    prior = known.agg(F.avg("toxic").alias("share")).first()["share"] or 0.0
    if prior <= 0:
        return Model({}, -30.0)
    mark = F.xxhash64(F.lit(seed), F.col("id"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    # Bounded by the parameters: the first rows by the hash.
    toxic = known.where("toxic = 1").orderBy(mark, "id").limit(n_toxic).select("id", F.lit(True).alias("toxic"))
    other = rows.select("id").where(learn).distinct().orderBy(mark, "id").limit(n_unlabelled).select("id", F.lit(True).alias("other"))
    ids = materialize(toxic.join(other, "id", "full").select("id", F.coalesce("toxic", F.lit(False)).alias("toxic"), F.coalesce("other", F.lit(False)).alias("other")), "sampled")
    # One text of an id, however many rows repeat it.
    sample = materialize(rows.join(F.broadcast(ids), "id").groupBy("id", "toxic", "other").agg(F.min("text").alias("text")), "sample")
    counts = sample.agg(F.count_if("toxic").alias("p"), F.count_if("other").alias("u")).first()
    prior = min(max(prior, 0.001), 0.999)
    if not counts["p"] or not counts["u"]:
        return Model({}, float(np.log(prior / (1 - prior))))
    chosen = choose_features(sample, counts["p"], counts["u"], prior, n_features)
    model = train(*matrices(sample, chosen), chosen, prior)
    release(ids, sample)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """docs with score and predicted (1 from `least` on)."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            for part in slices(batch, text_col):
                got = model.scores([t or "" for t in part.column(text_col).to_pylist()], known)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(got), pa.array((got >= least).astype(np.int32))], [*kept, "score", "predicted"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*kept).mapInArrow(run, f"{fields}, score double, predicted int")
