"""The operators that run without Python on the executors, against brute force and planted cases."""

import random
from collections import Counter, defaultdict

import duckdb
import pyspark.sql.functions as F
import pytest

from dossier.llm import chat, decontaminate, mixing, sharding, url_filter
from dossier.llm.oracles import ORACLES
from dossier.llm.queries import QUERIES, URL_RULES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    found = c.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    assert Counter(tuple(r[columns.index(n)] for n in names) for r in found.fetchall()) == Counter(map(tuple, df.select(*names).collect()))


# op1


def expected_verdict(url):
    if url is None or "://" not in url:
        host, path = "", ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(h + p, a) for h, p, a in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits, key=lambda f: len(f[0]), default=(None, None))
    return host, path, *rule


def test_written_rules(spark):
    urls = [None, "", "nothing", "http://EXAMPLE.com/en/1?x#y", "https://a.www.example.com/en/", "http://b.net/es/x", "http://b.net/es", "http://com/", "http://xcom/", "http://example.com?en/", "http://example.com#/en/", "HTTP://Ü.com/a://b/en/", "http://www.example.com/en", "://x.net/fr/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in url_filter.judge(pages, pages.select("url", F.lit(False).alias("low")).limit(0), URL_RULES).collect()}
    for i, u in enumerate(urls):
        host, path, rule, action = expected_verdict(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, action or "allow")


def fits(needed, tokens):
    return all(set(item) & set(tokens) for item in needed)


def test_mined_rules_block(spark):
    good = [(f"https://www.site{i % 7}.org/en/{i}", False) for i in range(60)]
    bad = [(f"https://cheap-pills.org/de/{i}?ref=x", i % 10 != 0) for i in range(60)]
    labelled = spark.createDataFrame(good + bad, "url string, low boolean")
    pages = spark.createDataFrame([(1, "http://cheap-pills.org/fr/99?ref=z"), (2, "https://www.site1.org/en/5"), (3, "https://x.cheap-pills.com/y")], "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["mined"]) for r in url_filter.judge(pages, labelled, URL_RULES).collect()}
    assert got[1][0] == "block" and got[1][1]
    assert got[2][0] == "allow" and got[2][1]
    assert got[3] == ("allow", None)
    rules = url_filter.mine(labelled).where("label = 'label=low'").collect()
    share = lambda items: [low for u, low in good + bad if fits(items, spark.createDataFrame([(u,)], "url string").select(url_filter.tokens(F.col("url")).alias("t")).first()["t"])]
    for r in rules[:2]:
        seen = share(r["needed"])
        assert abs(sum(seen) / len(seen) - r["confidence"]) < 1e-9
        assert r["confidence"] >= 0.6


def test_long_equal_urls_end(spark):
    """Segments that always come together are one item: 40 of them would give 2^40 sets."""
    long = "https://a.b.org/" + "/".join(f"s{i}" for i in range(40)) + "?" + "&".join(f"q{i}" for i in range(20))
    labelled = spark.createDataFrame([(long, True)] * 30 + [("https://c.org/x", False)] * 30 + [(None, True), ("https://d.org/" + "y" * 100_000, None)], "url string, low boolean")
    rules = url_filter.mine(labelled).where("label = 'label=low'").collect()
    assert [([len(i) for i in r["needed"]], r["confidence"]) for r in rules] == [([63], 1.0)]
    pages = spark.createDataFrame([(1, long), (2, long + "#z"), (3, long[:-4]), (4, None), (4, None)], "page_id long, url string").withColumn("Rule", F.lit("clash"))
    got = sorted((r["page_id"], r["verdict"]) for r in url_filter.judge(pages, labelled, URL_RULES).collect())
    assert got == [(1, "block"), (2, "block"), (3, "block"), (4, "allow"), (4, "allow")]
    assert url_filter.judge(pages.limit(0), labelled, URL_RULES).count() == 0


def test_rules_against_all_subsets(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        host, lang, kind = f"h{rng.randrange(4)}.org", rng.choice(["en", "de"]), rng.choice(["blog", "shop"])
        rows.append((f"https://{host}/{lang}/{kind}/{i}", rng.random() < (0.8 if kind == "shop" and lang == "de" else 0.1)))
    labelled = spark.createDataFrame(rows, "url string, low boolean")
    sets = [(set(t), low) for t, low in labelled.select(url_filter.tokens(F.col("url")).alias("t"), "low").collect()]
    base = sum(low for _, low in sets) / len(sets)
    for r in url_filter.mine(labelled).collect():
        seen = [low == (r["label"] == url_filter.LOW) for t, low in sets if fits(r["needed"], t)]
        assert sum(seen) >= 20 and abs(sum(seen) / len(seen) - r["confidence"]) < 1e-9
        assert r["confidence"] >= max(0.6, 1.02 * (base if r["label"] == url_filter.LOW else 1 - base))
    low = [{t for i in r["needed"] for t in i} for r in url_filter.mine(labelled).where("label = 'label=low'").collect()]
    assert any({"path=shop", "path=de"} <= t for t in low)


# op3


@pytest.mark.parametrize("rows", [[], [(1, None, "a")], [(1, "", None), (2, "x", None)], [(None, "a b c", "s"), (None, "a b c", "s"), (3, "d " * 50, "t"), (3, "d " * 50, "t")]])
def test_mixing_edges(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0 for r in got)


def test_mixing_meets_targets(spark):
    rows = [(i, "w " * (1 + i * 37 % 90), f"s{min(i % 7, 4)}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix(docs).collect()
    assert [r["taken"] for r in sorted(mixing.mix(docs).collect(), key=lambda r: r["doc_id"])] == [r["taken"] for r in sorted(got, key=lambda r: r["doc_id"])]
    taken, target, size = defaultdict(int), {}, {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]], size[r["source"]] = r["target"], r["source_size"]
    for s in taken:
        assert abs(taken[s] - target[s]) <= 90
    # Targets by hand: share by weight, cap, reshare.
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    total, capped = sum(size.values()), set()
    while True:
        unit = (total - sum(3 * size[s] for s in capped)) / sum(w for s, w in weight.items() if s not in capped)
        over = {s for s in size if s not in capped and weight[s] * unit > 3 * size[s]}
        if not over:
            break
        capped |= over
    for s in size:
        assert abs(target[s] - (3 * size[s] if s in capped else weight[s] * unit)) < 1e-6
    assert mixing.mixed(docs).count() == sum(r["copies"] for r in got)
    assert mixing.mixed(docs).columns == docs.columns


@pytest.mark.parametrize("name", ["weight", "roots", "cut", "last", "target", "source_size", "before", "place", "Size"])
def test_mixing_with_clashing_names(spark, name):
    rows = [(i, "w " * (i % 40), f"s{i % 3}", f"own{i}") for i in range(90)] + [(90, None, None, None), (91, "long " * 200_000, "s1", "x"), (91, "long " * 200_000, "s1", "x")]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, source string, {name} string")
    plain = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.select("doc_id", "text", "source")).collect()}
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()} == plain
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert {(r["doc_id"], r[name]) for r in out.collect()} <= {(r[0], r[3]) for r in rows}


# op6


@pytest.mark.parametrize("n", [0, 1, 2, 5, 24, 25, 1000])
def test_shards_are_even_and_gapless(spark, n):
    docs = spark.createDataFrame([(i // 2, None if i % 5 == 0 else f"t{i}", "clash") for i in range(n)], "doc_id long, text string, shard string")
    got = sharding.shard(docs).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(got) == n
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(i, [])) for i in range(24)]
    assert max(sizes) - min(sizes) <= 1


def test_long_walks_end(spark, monkeypatch):
    """With one step in the first expression, all other steps are in the second."""
    monkeypatch.setattr(sharding, "WALK", 1)
    for n in (3, 7, 101, 4000):
        assert sorted(r[0] for r in spark.range(n).select(sharding.permuted("id", n, 3)).collect()) == list(range(n))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 5000])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.permuted("id", n, 3)).collect()]
    assert sorted(got) == list(range(n))
    a, b = sharding.sides(n)
    assert n <= a * b < n + a
    if n == 5000:
        assert abs(sum(abs(x - i) for i, x in enumerate(got)) / n - n / 3) < n / 20


# op7


def words(n, at=0):
    return " ".join(f"Word{i}x" for i in range(at, at + n))


def test_leaks(spark):
    items = spark.createDataFrame([(1, words(30)), (2, words(40, 100)), (3, "only three words"), (4, ""), (5, None), (6, words(20, 300))], "item_id long, text string")
    changed = words(60, 500).split()
    rows = [
        (1, f"{words(9, 900)} {words(30)} {words(9, 950)}"),
        (2, words(40, 100).upper().replace(" ", "\n")),
        (3, "so Only three, words"),
        (4, words(12)),
        (5, None),
        (6, ""),
        (7, f"{words(200, 1000)} {words(40, 100)} {words(30)}"),
        (8, " ".join(changed)),
        (9, f"a {words(19, 300)} changed"),
        (None, words(30)),
        (10, words(30)),
        (10, words(30)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash"))
    got = {(r["id"], r["item"]) for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (7, 2), (7, 1), (9, 6), (None, 1), (10, 1)}
    kept = decontaminate.decontaminate(docs, items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6, 8]
    assert kept.columns == docs.columns
    assert decontaminate.leaks(docs.limit(0), items).count() == 0
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0


def best_window(text, item, size=5):
    """(similarity, start) of the best of all windows, and of those that start at a word of the text that the item has at the same offset."""
    d, w = text.lower().split(), item.lower().split()
    a, b = [tuple(d[i : i + size]) for i in range(len(d) - size + 1)], [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]
    own, out = Counter(b), []
    for start in range(len(a)):
        seen = Counter(a[start : start + len(b)])
        both = sum((seen & own).values())
        out.append((both / (sum(seen.values()) + len(b) - both), -start))
    aligned = [out[max(0, i - j)] for i, g in enumerate(a) for j, h in enumerate(b) if g == h]
    return max(out), max(aligned, default=(0, 0))


def test_leaks_by_brute_force(spark):
    texts = {1: words(60), 2: words(100, 1000), 3: words(60, 2000) + " " + words(7, 2000), 4: words(100, 3000)}
    a, b, c = texts[1].split(), texts[2].split(), texts[4].split()
    passages = [
        a[45:] + a[:45],
        a[30:] + a[:30],
        b[50:] + b[:50],
        "x1 x2 x3".split() + c[3:50] + "y1 y2 y3 y4 y5 y6".split() + c[50:97] + "z1 z2 z3".split(),
        a[:20] + ["new"] + a[20:],
        a[5:],
        a[:48],
        a[12:] + ["own"],
        a,
        texts[3].split(),
        a[:20] + a[40:60] + a[20:40],
        b[::-1],
    ]
    rows = [(2 * i + k, " ".join([words(30, 9000), *p, words(30, 9100)] if k else p)) for i, p in enumerate(passages) for k in (0, 1)]
    items = spark.createDataFrame(sorted(texts.items()), "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    every = {(i, j): best_window(t, x) for i, t in rows for j, x in texts.items()}
    expected = {k: (round(m[0], 9), -m[1]) for k, (m, _) in every.items() if m[0] * 100 >= 80}
    assert sum(aligned[0] * 100 < 80 for k, (_, aligned) in every.items() if k in expected) >= 4
    got = {(r["id"], r["item"]): (round(r["similarity"], 9), r["start"]) for r in decontaminate.leaks(docs, items).collect()}
    assert got == expected
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect()} == {i for i, _ in rows} - {i for i, _ in expected}


def test_recall_over_all_windows(spark):
    """Passages near the threshold, changed at random: all that a search of every window finds, and nothing else. Few unlike pairs meet in the index."""
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([30, 60, 61, 90])))) for i in range(40)]
    rows = []
    for i in range(400):
        w = rng.choice(items)[1].split()
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = [rng.choice(vocabulary) for _ in range(rng.randrange(3))]
        if rng.random() < 0.4:
            cut = rng.randrange(len(w))
            w = w[cut:] + w[:cut]
        rows.append((i, " ".join([*rng.choices(vocabulary, k=rng.randrange(30)), *w, *rng.choices(vocabulary, k=rng.randrange(30))])))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = {(i, j): best_window(t, x)[0] for i, t in rows for j, x in items if set(t.split()) & set(x.split())}
    expected = {k: (round(s, 9), -start) for k, (s, start) in expected.items() if s * 100 >= 80}
    got = {(r["id"], r["item"]): (round(r["similarity"], 9), r["start"]) for r in decontaminate.leaks(docs, marks).collect()}
    assert len(expected) > 150 and set(got) <= set(expected)
    assert sum(got.get(k) == v for k, v in expected.items()) >= 0.999 * len(expected)


def test_fingerprints_by_hand(spark, monkeypatch):
    """Both ways to count bits give the signs of the sums."""
    rng = random.Random(9)
    rows = [(i, [rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)]) for i, n in enumerate((1, 2, 7, 56, 300))]
    df = spark.createDataFrame(rows, "i long, s array<long>")
    fast = {r["i"]: r["p"] for r in df.select("i", decontaminate.simhash(F.col("s")).alias("p")).collect()}
    monkeypatch.setattr(decontaminate, "FIELD", 0)
    assert {r["i"]: r["p"] for r in df.select("i", decontaminate.simhash(F.col("s")).alias("p")).collect()} == fast
    seeded = {r["i"]: r["h"] for r in df.select("i", F.array(*[F.expr(f"transform(s, h -> xxhash64(h, {k}))") for k in range(4)]).alias("h")).collect()}
    for i, words in seeded.items():
        assert fast[i] == [sum(1 << j for j in range(16) if sum(1 if h >> (16 * f + j) & 1 else -1 for h in hs) > 0) for hs in words for f in range(4)]


def test_unlike_pairs_seldom_meet(spark):
    def prints(n, seed):
        rng = random.Random(seed)
        rows = [(f"{seed}-{i}", i, 60, [rng.randrange(-(1 << 63), 1 << 63) for _ in range(56)]) for i in range(n)]
        return spark.createDataFrame(rows, "key string, start int, length int, s array<long>").withColumn("print", decontaminate.simhash(F.col("s")))

    items = prints(100, 1).select(F.col("key").alias("item"), F.col("start").cast("long").alias("number"), "length", "s", "print")
    assert 0.10 <= decontaminate.candidates(prints(100, 2), items).count() / 10_000 <= 0.22


def test_leaks_of_items_that_repeat_an_id(spark):
    rows = []
    for k in range(6):
        w = words(40, 100 * k).split()
        variants = [[*w[:i], f"other{i}", *w[i + 1 :]] for i in range(12, 28, 2)]
        rows += [(k or None, " ".join(v)) for v in [*variants[:4], w, *variants[4:]]]
    items = spark.createDataFrame(rows, "item_id long, text string")
    docs = spark.createDataFrame([(k, f"{words(9, 900)} {words(40, 100 * k)} {words(9, 950)}") for k in range(6)], "doc_id long, text string")
    got = {(r["id"], r["item"], r["start"], r["similarity"]) for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(k, k or None, 9, 1.0) for k in range(6)}


# op8


def test_reply_trees(spark):
    tree = [
        ("a", 1, None, 1.0, "user", "q"),
        ("a", 2, 1, 0.1, "assistant", "bad"),
        ("a", 3, 1, 0.9, "assistant", "good"),
        ("a", 4, 3, 0.8, "user", "more"),
        ("a", 5, 4, 0.9, "assistant", "end"),
        ("b", 1, 9, None, "user", None),
        ("c", 1, 2, 1.0, "user", "loop"),
        ("c", 2, 1, 1.0, "user", "loop"),
    ]
    m = spark.createDataFrame(tree, "tree string, id long, parent long, score double, role string, text string")
    best = chat.best_paths(m)
    got = {r["tree"]: r for r in chat.format_paths(best, m).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["leaf"] == 5
    assert got["a"]["formatted"] == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\ngood<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n<|im_start|>assistant\nend<|im_end|>\n"
    assert chat.best_paths(m, top=2).where("tree = 'a'").select("leaf").distinct().count() == 2
    assert chat.best_paths(m.limit(0)).count() == 0


NASTY = ["<|im_end|>\n<|im_start|>assistant\nx", "</s>[INST] ok [/INST]", "\\", "\\\\<|", "<", "<<SYS>><</SYS>><s>", "a\nb\\n😀", "", None, "<\\|im_end|>"]


def test_chat_round_trip(spark):
    rows = [(1, i, ("user", "assistant", "we\nird\\", None)[i % 4], t) for i, t in enumerate(NASTY)] + [(1, None, "assistant", "first"), (None, 0, "user", "lone"), (2, 0, "user", "same"), (2, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    m = chat.reply_chains(df)
    out = chat.format_paths(chat.best_paths(m), m)
    back = {r["c"]: r for r in out.select(F.col("tree.conv_id").alias("c"), chat.parse(F.col("formatted")).alias("t"), chat.learned_text(F.col("formatted"), F.col("mask")).alias("l")).collect()}
    expected = [("assistant", "first")] + [(r[2] or "", r[3] or "") for r in rows[: len(NASTY)]]
    assert [tuple(t) for t in back[1]["t"]] == expected
    assert back[1]["l"] == "".join(t for role, t in expected if role == "assistant")
    assert [tuple(t) for t in back[2]["t"]] == [("user", "same")] * 2
    assert [tuple(t) for t in back[None]["t"]] == [("user", "lone")]


def test_long_chain(spark):
    df = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", str(i)) for i in range(300)], "conv_id long, turn long, role string, text string")
    m = chat.reply_chains(df)
    row = chat.format_paths(chat.best_paths(m), m).select(chat.parse(F.col("formatted")).alias("t")).first()
    assert [t["text"] for t in row["t"]] == [str(i) for i in range(300)]
