"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of 32; a GRU reads each forwards, another backwards, and a softmax over both states labels
every byte. The document's probabilities are the softmax of the mean log-probabilities of all its bytes, times a
sharpness. Training is backpropagation through time in numpy on the driver, on a sample of at most `per_language` labelled
documents for each language, the same for equal input: for each language and each value of a hash, the first id.

Null texts and texts without a letter are `und` with score 0. A language label of null teaches nothing. Without any labelled
text all documents are `und`. Texts are read whole, whatever their length. Of rows that repeat an id and a language, one text is
learned from; each row is judged on its own. Equally probable languages go by name. An empty table teaches nothing and gives an empty
result. Columns of the caller with the names of the results are replaced, others pass through."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .kernels import slices, text_bytes

WINDOW = 32
HIDDEN = 8
#: The token that fills up a document's last window; it is no position of the document.
PAD = 256
#: The mean log-probability of many dependent positions, as so many independent ones.
SHARPNESS = 8.0


@dataclass
class Network:
    """languages, and for both directions the table of input terms (257, 3H), the recurrent matrix (H, 3H); then the output (2H, K) and its bias.

    The input terms of a byte are looked up, which is the product of its one-hot vector with the input matrix, bias included."""

    languages: list[str]
    table: np.ndarray
    loop: np.ndarray
    out: np.ndarray
    bias: np.ndarray


def start(languages: list[str], seed: int = 5) -> Network:
    rng, h, k = np.random.default_rng(seed), HIDDEN, len(languages)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    return Network(languages, draw(2, 257, 3 * h), draw(2, h, 3 * h), draw(2 * h, k), np.zeros(k, np.float32))


def states(net: Network, direction: int, tokens: np.ndarray, keep: list | None = None) -> np.ndarray:
    """The states (positions, windows, H) of one direction. keep: gets each step's gates for the way back."""
    h, (n, length) = HIDDEN, tokens.shape
    state, out = np.zeros((n, h), np.float32), np.empty((length, n, h), np.float32)
    table, gates, candidate = net.table[direction], np.ascontiguousarray(net.loop[direction][:, : 2 * h]), np.ascontiguousarray(net.loop[direction][:, 2 * h :])
    for t in range(length) if direction == 0 else range(length - 1, -1, -1):
        x = table[tokens[:, t]]
        zr = x[:, : 2 * h] + state @ gates
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        z, r = zr[:, :h], zr[:, h:]
        held = state @ candidate
        c = np.tanh(x[:, 2 * h :] + r * held)
        if keep is not None:
            keep.append((t, state, z, r, held, c))
        state = c + z * (state - c)
        out[t] = state
    return out


def log_probabilities(net: Network, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """Of the languages, at every position."""
    score = forward @ net.out[:HIDDEN] + backward @ net.out[HIDDEN:] + net.bias
    score -= score.max(axis=-1, keepdims=True)
    return score - np.log(np.exp(score).sum(axis=-1, keepdims=True))


def gradients(net: Network, tokens: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The mean cross-entropy over all positions, and its gradients by backpropagation through time."""
    h, (n, length) = HIDDEN, tokens.shape
    real = (tokens != PAD).T
    count = max(1, int(real.sum()))
    kept: tuple[list, list] = ([], [])
    both = [states(net, d, tokens, kept[d]) for d in (0, 1)]
    logs = log_probabilities(net, *both)
    loss = -float((logs[:, np.arange(n), labels] * real).sum()) / count
    d_score = np.exp(logs)
    d_score[:, np.arange(n), labels] -= 1
    d_score *= (real / count)[:, :, None]
    flat = d_score.reshape(-1, d_score.shape[-1])
    d_out = np.vstack([s.reshape(-1, h).T @ flat for s in both])
    d_table, d_loop = np.zeros_like(net.table), np.zeros_like(net.loop)
    for d in (0, 1):
        from_above = d_score @ net.out[d * h : (d + 1) * h].T
        gates, candidate = net.loop[d][:, : 2 * h], net.loop[d][:, 2 * h :]
        d_state = np.zeros((n, h), np.float32)
        for t, before, z, r, held, c in reversed(kept[d]):
            d_state = d_state + from_above[t]
            d_c = d_state * (1 - z) * (1 - c * c)
            d_z = d_state * (before - c) * z * (1 - z)
            d_r = d_c * held * r * (1 - r)
            d_held = d_c * r
            d_x = np.concatenate([d_z, d_r, d_c], axis=1)
            np.add.at(d_table[d], tokens[:, t], d_x)
            d_gates = d_x[:, : 2 * h]
            d_loop[d][:, : 2 * h] += before.T @ d_gates
            d_loop[d][:, 2 * h :] += before.T @ d_held
            d_state = d_state * z + d_gates @ gates.T + d_held @ candidate.T
    return loss, [d_table, d_loop, d_out, flat.sum(axis=0)]


def train(tokens: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = 240, batch: int = 512, rate: float = 0.02, seed: int = 5) -> Network:
    """Adam over random batches of windows, each language as likely as the others."""
    net, rng = start(languages, seed), np.random.default_rng(seed)
    parts = [net.table, net.loop, net.out, net.bias]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    of = [np.flatnonzero(labels == k) for k in range(len(languages))]
    for step in range(1, steps + 1):
        own = rng.integers(0, len(languages), batch)
        pick = np.array([of[k][rng.integers(0, len(of[k]))] for k in own])
        _, grads = gradients(net, tokens[pick], labels[pick])
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(parts, grads, first, second, strict=True):
            g = np.clip(g, -1, 1)
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows (n, WINDOW) of the texts, and each text's first window, with their number at last."""
    lengths = np.diff(offsets)
    counts = -(-lengths // WINDOW)
    first = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.full(int(first[-1]) * WINDOW, PAD, np.uint16)
    shift = np.repeat(first[:-1] * WINDOW - offsets[:-1], lengths)
    tokens[np.arange(len(data)) + shift] = data
    return tokens.reshape(-1, WINDOW), first


def document_probabilities(net: Network, data: np.ndarray, offsets: np.ndarray, side: int = 2048) -> np.ndarray:
    """(texts, languages): pooled over all positions of each text."""
    tokens, first = windows(data, offsets)
    sums = np.zeros((len(tokens) + 1, len(net.languages)))
    for i in range(0, len(tokens), side):
        part = tokens[i : i + side]
        logs = log_probabilities(net, states(net, 0, part), states(net, 1, part))
        logs *= (part != PAD).T[:, :, None]
        sums[i + 1 : i + 1 + len(part)] = logs.sum(axis=0)
    sums = np.cumsum(sums, axis=0)
    mean = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(1, np.diff(offsets))[:, None] * SHARPNESS
    mean -= mean.max(axis=1, keepdims=True)
    p = np.exp(mean)
    return p / p.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 256, windows_each: int = 12, seed: int = 5) -> Network | None:
    """Trains on the rows for which `learn` is true. The sample holds at most per_language documents of each language, and windows_each windows from anywhere in each."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    mark = F.xxhash64(F.lit(seed), F.col(id_col))
    # A row for each language and hash value: partial minima, then at most per_language ids of a language.
    chosen = rows.groupBy(F.col(lang_col).alias("lang"), F.pmod(mark, F.lit(per_language)).alias("slot")).agg(F.min(F.struct(mark.alias("mark"), F.col(id_col).alias("id"))).alias("m")).select("lang", "m.id")
    sample = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).join(F.broadcast(chosen), ["id", "lang"], "left_semi")
    # One text of an id, however many rows repeat it.
    sample = sample.groupBy("id", "lang").agg(F.min("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, first = windows(*text_bytes(part.column("text")))
                ids, langs, bodies = [], [], []
                for i, (id_, lang) in enumerate(zip(part.column("id").to_pylist(), part.column("lang").to_pylist(), strict=True)):
                    n = int(first[i + 1] - first[i])
                    for k in sorted({j * n // windows_each for j in range(windows_each)} if n else ()):
                        ids.append(str(id_))
                        langs.append(lang)
                        bodies.append(tokens[first[i] + k].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(langs, pa.string()), pa.array(bodies, pa.binary())], ["id", "lang", "window"])

    got = sample.mapInArrow(cut, "id string, lang string, window binary").collect()
    if not got:
        return None
    got = sorted((r["lang"], r["id"], r["window"]) for r in got)
    languages = sorted({lang for lang, _, _ in got})
    tokens = np.frombuffer(b"".join(w for _, _, w in got), np.uint16).reshape(-1, WINDOW)
    return train(tokens, np.array([languages.index(lang) for lang, _, _ in got]), languages, seed=seed)


def identify(docs: DataFrame, net: Network | None, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with the predicted language and its probability, in place of columns of these names. Other columns pass through."""
    kept = [c for c in docs.columns if c not in (lang_out, score_out)]
    letters = docs.select(*kept, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                n = len(part)
                names, score = np.full(n, "und", object), np.zeros(n)
                if net is not None:
                    p = document_probabilities(net, *text_bytes(part.column(text_col)))
                    known = part.column("__letters").to_numpy(zero_copy_only=False).astype(bool)
                    names[known], score[known] = np.array(net.languages, object)[p.argmax(axis=1)][known], p.max(axis=1)[known]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(names, pa.string()), pa.array(score)], [*kept, lang_out, score_out])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return letters.mapInArrow(run, f"{fields}, `{lang_out}` string, `{score_out}` double")
