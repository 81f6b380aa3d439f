"""The operators with numpy kernels, against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import struct
import zlib
from itertools import combinations

import numpy as np
import pyspark.sql.functions as F
import pytest

from dossier.llm import jpeg, language, media, near_dedup, toxicity, warc
from dossier.llm.common import held_out

# op2


def sets(rows, size):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    return out


def brute(rows, size, percent=80):
    s = sets(rows, size)
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(s), 2):
        both = len(s[a] & s[b])
        if both and 100 * both >= percent * (len(s[a]) + len(s[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s[i]), find(i)) for i in s}


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 2, 5, 6, 30, 120]))] for _ in range(n // 6)]
    shared = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            w[rng.randrange(len(w))] = rng.choice(words)
        if rng.random() < 0.2:
            w += shared
        rows.append((i, "\t".join(w).upper() if i % 7 == 0 else " ".join(w)))
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    rows = [*corpus(300, size), (1000, None), (1001, ""), (1002, " \n"), (1003, " "), (1004, "one"), (1005, "ONE")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, words=size).collect()}
    assert got == brute(rows, size)


def test_a_large_group_of_copies(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i * 3, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect()} == brute(rows, 2)


def test_drop_near_duplicates(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text, "x"), (3, text, "y"), (3, text, "y"), (None, text, "z"), (9, None, "n"), (10, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, comp string")
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.schema == docs.schema or kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["comp"]) for r in kept.collect()) == [(-1, "z"), (3, "y"), (9, "n"), (10, "e")]
    assert near_dedup.drop_near_duplicates(docs.limit(0)).count() == 0


def test_ids_that_repeat_with_other_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    rows = [(3, a), (7, a + " more"), (7, b), (7, b), (8, b + " more"), (9, "z " * 300_000), (11, "z " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("text_hash", F.lit("clash"))
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(3, a), (8, b + " more"), (9, "z " * 300_000)]


def test_loose_copies_that_are_linked_over_others(spark):
    """Texts that drift away step by step: neighbours are linked, ends share nothing."""
    rows, rng = [], random.Random(8)
    w = [f"w{i}" for i in range(120)]
    for i in range(200):
        rows.append((i * 7 % 200, " ".join(w)))
        w = list(w)
        for _ in range(rng.choice([2, 6, 9])):
            w[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect()} == brute(rows, 2)


# op4


class Bits:
    def __init__(self):
        self.b = []

    def put(self, v, n):
        self.b += [v >> (n - 1 - i) & 1 for i in range(n)]

    def number(self, v, table):
        size = abs(v).bit_length()
        self.put(*table[size])
        self.put(v if v >= 0 else v + (1 << size) - 1, size)

    def end(self):
        bits = self.b + [1] * (-len(self.b) % 8)
        return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def test_decoder_reads_colour_and_ac():
    """A 2x1-sampled image of three components with AC coefficients and restarts, encoded by hand here."""
    ac_counts, ac_symbols = (0, 2, 1, 2) + (0,) * 12, bytes([0x00, 0x01, 0xF0, 0x23, 0x05])
    dc = {s: (c, n) for s, c, n in jpeg.codes(jpeg.DC_COUNTS, jpeg.DC_SYMBOLS)}
    ac = {s: (c, n) for s, c, n in jpeg.codes(ac_counts, ac_symbols)}
    rng = random.Random(2)
    luma = [[rng.randrange(-60, 60) for _ in range(4)] for _ in range(2)]
    scan, pred = b"", [0, 0, 0]
    bits = Bits()
    for m in range(4):
        y, x = divmod(m, 2)
        for comp, v in ((0, luma[y][2 * x]), (0, luma[y][2 * x + 1]), (1, rng.randrange(-9, 9)), (2, rng.randrange(-9, 9))):
            bits.number(v - pred[comp], dc)
            pred[comp] = v
            for s in rng.choice([[], [0x01], [0xF0, 0x23], [0x05, 0x01]]):
                bits.put(*ac[s])
                bits.put(rng.randrange(1 << (s & 15)), s & 15)
            bits.put(*ac[0])
        if m == 1:
            scan, bits, pred = bits.end() + b"\xff\xd0", Bits(), [0, 0, 0]
    scan += bits.end()
    data = b"\xff\xd8" + jpeg.marker(0xFE, b"comment \xff\xd9") + jpeg.marker(0xDB, bytes([0] + [16] * 64)) + jpeg.marker(0xDB, bytes([1] + [4] * 64))
    data += jpeg.marker(0xC0, struct.pack(">BHHB", 8, 16, 30, 3) + bytes([1, 0x21, 0, 2, 0x11, 1, 3, 0x11, 1]))
    data += jpeg.marker(0xC4, bytes([0, *jpeg.DC_COUNTS]) + jpeg.DC_SYMBOLS + bytes([0x10, *ac_counts]) + ac_symbols)
    data += jpeg.marker(0xDD, struct.pack(">H", 2)) + jpeg.marker(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    [[(frame, thumb)]] = jpeg.decode([data])
    assert (frame.width, frame.height) == (30, 16)
    assert thumb.tolist() == [[min(255, max(0, (v * 16 + 4) // 8 + 128)) for v in row] for row in luma]
    for broken in (data[:50], data[:-2], b"", b"\xff\xd8\xff\xc2" + data[4:], data[: len(data) // 2]):
        with pytest.raises((ValueError, IndexError, KeyError)):
            jpeg.decode([broken])


def test_media_round_trip(spark):
    texts = [None, "", "a", "x" * 576, "é😀\x00" * 400, "\xff" * 700, "long " * 90_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("width", F.lit("clash"))
    stored = media.store(docs)
    for r in media.describe(stored).collect():
        raw = (texts[r["id"]] or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r["n_bytes"], r["n_samples"], r["samples_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["n_images"] == -(-len(payload) // jpeg.MOST)
    odd = spark.createDataFrame([(1, None), (2, b"junk")], "id long, media binary").unionByName(stored.where("id = 2").select("id", "media"))
    got = media.describe(odd).collect()
    assert [r["n_samples"] for r in got] == [None, None, 576]


def plain_thumb_hash(rows):
    """The average hash with loops over cells, for sides of 8 and more."""
    h, w = len(rows), len(rows[0])
    cells = []
    for i in range(8):
        for j in range(8):
            band = range(i * h // 8, (i + 1) * h // 8)
            part = range(j * w // 8, (j + 1) * w // 8)
            down = [sum(rows[y][x] for y in band) * 840 // len(band) for x in part]
            cells.append(sum(down) * 840 // len(down))
    mean = sum(cells) / 64
    return f"{int(''.join('1' if c > mean else '0' for c in cells), 2):016x}"


def test_media_features_by_hand(spark):
    texts = ["", "ab" * 900, "the same", "the same", "é" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(4, texts[4])], "doc_id long, text string")
    stored = {r["id"]: bytes(r["media"]) for r in media.store(docs).collect()}
    for r in media.describe(media.store(docs)).collect():
        data = stored[r["id"]]
        assert (r["media_bytes"], r["media_sha256"]) == (len(data), hashlib.sha256(data).hexdigest())
        at = data.index(b"\xff\xc0")
        height, width = struct.unpack(">HH", data[at + 5 : at + 9])
        assert (r["width"], r["height"]) == (width, height)
        raw = texts[r["id"]].encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        side = -(-width // 8)
        rows = [list(payload[i : i + side]) for i in range(0, len(payload), side)]
        assert r["thumb_hash"] == plain_thumb_hash(rows)
    assert stored[2] == stored[3]
    assert media.describe(media.store(docs.limit(0))).count() == 0


# op5


def plain_probabilities(net, text):
    """The network's pooled probabilities of one text, a byte at a time in Python floats."""
    data, h = text.encode(), language.HIDDEN
    sums = [0.0] * len(net.languages)
    for i in range(0, len(data), language.WINDOW):
        tokens = list(data[i : i + language.WINDOW])
        tokens += [language.PAD] * (language.WINDOW - len(tokens))
        both = []
        for d in (0, 1):
            state, found = [0.0] * h, {}
            for t in range(language.WINDOW) if d == 0 else reversed(range(language.WINDOW)):
                x, loop = net.table[d][tokens[t]], net.loop[d]
                gate = [1 / (1 + math.exp(-(float(x[k]) + sum(state[j] * float(loop[j][k]) for j in range(h))))) for k in range(2 * h)]
                new = []
                for k in range(h):
                    held = sum(state[j] * float(loop[j][2 * h + k]) for j in range(h))
                    c = math.tanh(float(x[2 * h + k]) + gate[h + k] * held)
                    new.append(c + gate[k] * (state[k] - c))
                state = found[t] = new
            both.append(found)
        for t in range(min(language.WINDOW, len(data) - i)):
            s = both[0][t] + both[1][t]
            raw = [sum(s[j] * float(net.out[j][k]) for j in range(2 * h)) + float(net.bias[k]) for k in range(len(sums))]
            norm = math.log(sum(math.exp(r) for r in raw))
            sums = [a + r - norm for a, r in zip(sums, raw, strict=True)]
    e = [math.exp(a / max(1, len(data)) * language.SHARPNESS) for a in sums]
    return [x / sum(e) for x in e]


def test_network_against_plain_python():
    net = language.start(["a", "b", "c"], seed=3)
    texts = ["a", "hello world, é😀 " * 5, "x" * 64, "y" * 65]
    data, at = b"".join(t.encode() for t in texts), np.cumsum([0] + [len(t.encode()) for t in texts])
    got = language.document_probabilities(net, np.frombuffer(data, np.uint8), at)
    for row, t in zip(got, texts, strict=True):
        assert np.allclose(row, plain_probabilities(net, t), atol=1e-4)


def spoken(lang, n, rng):
    letters = {"aa": "abcde ", "bb": "vwxyz ", "cc": "lmnop "}[lang]
    return "".join(rng.choice(letters) for _ in range(n)) + letters[0]


def test_gradients():
    rng = np.random.default_rng(0)
    tokens, labels = rng.integers(0, 256, (6, language.WINDOW)), rng.integers(0, 3, 6)
    tokens[0, 20:] = language.PAD
    net = language.start(["a", "b", "c"])
    _, grads = language.gradients(net, tokens, labels)
    for p, g in zip((net.table, net.loop, net.out, net.bias), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, h = p[at], 1e-2
        p[at] = old + h
        up = language.gradients(net, tokens, labels)[0]
        p[at] = old - h
        down = language.gradients(net, tokens, labels)[0]
        p[at] = old
        assert abs((up - down) / (2 * h) - g[at]) < 2e-3 + 0.02 * abs(g[at])


def test_language(spark):
    rng = random.Random(3)
    rows = [(i, spoken(lang, rng.choice([10, 60, 300]), rng), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(900, None, "aa"), (901, "", None), (902, "123 !?", "bb"), (903, spoken("bb", 70_000, rng), None), (904, "é", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    net = language.fit(docs, ~held_out(F.col("doc_id")))
    got = {r["doc_id"]: r for r in language.identify(docs, net).collect()}
    test = [r for r in rows[:180] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in test) >= 0.95 * len(test)
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "bb"]
    assert got[904]["lang_pred"] in net.languages
    assert all(0 <= r["score"] <= 1 for r in got.values())
    again = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), "cc").otherwise(F.col("lang")))
    other = language.fit(again, ~held_out(F.col("doc_id")))
    assert all(np.array_equal(a, b) for a, b in ((net.table, other.table), (net.out, other.out)))
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}
    assert language.fit(docs.limit(0), F.lit(True)) is None


# op9


def plain_risk(w, p, u, prior):
    score = lambda row: w[-1] + sum(a * b for a, b in zip(row, w, strict=False))
    loss = lambda g: math.log1p(math.exp(-g))
    toxic = prior * sum(loss(score(r)) for r in p) / len(p)
    rest = sum(loss(-score(r)) for r in u) / len(u) - prior * sum(loss(-score(r)) for r in p) / len(p)
    return toxic, rest


@pytest.mark.parametrize("bias", [-1.0, 3.0, -6.0])
def test_risk_and_its_gradient(bias):
    rng = np.random.default_rng(1)
    p, u = (rng.random((n, 5)) < 0.4 for n in (7, 30))
    p, u, w = p.astype(np.float32), u.astype(np.float32), np.append(rng.standard_normal(5), bias)
    if bias == 3.0:
        # Toxic texts score far above the others: the estimate of the others' risk falls below 0.
        p, u, w = np.ones((7, 5), np.float32), np.zeros((30, 5), np.float32), np.array([2.0] * 5 + [-8.0])
    toxic, rest, grad = toxicity.risk(w, p, u, 0.4)
    assert np.allclose((toxic, rest), plain_risk(w, p, u, 0.4), atol=1e-5)
    assert (rest < 0) == (bias == 3.0)
    value = lambda x: (lambda t, r: t + r if rest >= 0 else -r)(*plain_risk(x, p, u, 0.4))
    for k in range(6):
        step = np.zeros(6)
        step[k] = 1e-4
        assert abs((value(w + step) - value(w - step)) / 2e-4 - grad[k]) < 1e-4


def test_scores_against_plain_python(spark):
    model = toxicity.Model({"scum": 2.0, "zqu*": 1.5, "zquexa": 0.25, "the": -0.5}, -3.0)
    texts = ["", None, "The scum.", "SCUM scum the ZQUexa", "zquexb the " * 50_000, "é zqu"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(5, "é zqu")], "doc_id long, text string")
    for r in toxicity.score(docs, model).collect():
        words = set(re.findall(r"[^\W\d_]+", (texts[r["doc_id"]] or "").lower()))
        held = {f for f in model.weights if f in words or f.endswith("*") and any(w.startswith(f[:-1]) and len(w) > len(f) - 1 for w in words)}
        expected = 1 / (1 + math.exp(-(model.bias + sum(model.weights[f] for f in held))))
        assert abs(r["score"] - expected) < 1e-9 and r["predicted"] == int(expected >= 0.3)


def test_toxicity(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne") for b in ("ra", "su", "ti", "vo", "wu")]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        w = [rng.choice(words) for _ in range(rng.choice([20, 200]))]
        if toxic:
            w[5:5] = [rng.choice(["scum", "zquexa", "zquebo", "zqueli"]) for _ in range(3)]
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (902, "SCUM! zquenew")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    marks = spark.createDataFrame(labels + [(950, None), (None, 1)], "id long, toxic int")
    model = toxicity.fit(docs, marks, ~held_out(F.col("id")))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    test = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["predicted"] == y for i, y in test) >= 0.97 * len(test)
    assert got[900]["score"] == got[901]["score"] and got[900]["predicted"] == 0
    assert got[902]["predicted"] == 1
    assert toxicity.fit(docs, marks.limit(0), F.lit(True)).weights == {}
    assert toxicity.score(docs.limit(0), model).count() == 0


# op10


def test_warc(spark):
    same = "s" * 100
    rows = [(4, "http://a/1", same), (2, "http://a/2", same), (9, None, same), (9, None, same), (7, "bad\r\nurl x", "short"), (8, "u", "short"), (1, "u", None), (3, "u", ""), (None, "u", same), (5, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (6, "u", "é😀" * 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r["page_id"] or 0), r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.rewrite(pages).collect())
    expected = []
    for i, _, html in rows:
        raw = (html or "").encode()
        again = html == same and i != 2
        expected.append((i or 0, "revisit" if again else "response", 2 if again else None, len(raw), hashlib.sha256(raw).hexdigest()))
    assert got == sorted(expected)
    assert warc.rewrite(pages.limit(0)).count() == 0


def test_warc_records_stand_alone():
    block = b"HTTP/1.1 200 OK\r\n\r\nabc\r\n\r\ndef"
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    assert [(h["WARC-Type"], bytes(b)) for h, b in warc.records(record * 3)] == [("response", block)] * 3
