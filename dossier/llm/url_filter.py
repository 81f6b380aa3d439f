"""URL filters: written rules first, then association rules that FP-growth mines from labelled URLs.

A URL is a set of tokens: scheme, host labels, the host's ending, path segments (numbers as one token), file ending, query
names, fragment. Tokens that occur in just the same labelled URLs are merged into one item, which a URL has if it has any of them:
rules of either would be equally sure, and one that asks for several no surer, so no rule that would be kept is lost, and a long path
that repeats is one item, not a set with a subset for each choice of its segments. FP-growth over the labelled URLs,
each with a token for its label, gives rules "these items, so low quality" and "so high quality". Kept are rules with the support, the
confidence and a lift over their label's share of all URLs, but for those of which a part is as sure of the same label. They stand
in an inverted index under their rarest item: a URL looks up its items, and checks the rules found there in full. The surest rule that
fits judges: a low one blocks, a high one allows.

A null URL or one without :// has an empty host and path; a rule's host never fits it. Repeated URLs count each time and get equal
verdicts; of equally sure rules the first by name judges. Without labels, or on empty tables, there are no mined rules, and every URL
that no written rule judges is allowed. URLs of any length are read whole. Columns of the caller named host, path, rule, verdict,
mined and confidence are replaced."""

from __future__ import annotations

from math import ceil

import pyspark.sql.functions as F
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame

from .common import lower_ascii, materialize, release, small

#: The items of labels; no token begins so.
LOW, HIGH = "label=low", "label=high"
#: Joins the tokens of a merged item.
OR = " | "
#: Up to so many rules or items are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return F.coalesce(lower_ascii(rest), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)), F.lit(""))


def written_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (host, path, action) that fits, and its action; null if none does. The rules are a short list in code."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, act in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, action = F.when(fits, h + p).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL."""
    labels = F.split(host(url), r"\.")
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    segments = F.transform(segments, lambda s: F.concat(F.lit("path="), F.when(s.rlike("^[0-9]+"), "<number>").otherwise(s)))
    query = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda s: s != "")
    parts = F.concat(
        F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))), F.concat(F.lit("ending="), F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), "."))),
        F.transform(F.filter(labels, lambda s: s != ""), lambda s: F.concat(F.lit("host="), s)),
        segments,
        F.transform(F.filter(F.array(F.regexp_extract(path(url), r"\.([A-Za-z0-9]+)$", 1)), lambda s: s != ""), lambda s: F.concat(F.lit("file="), s)),
        F.transform(query, lambda s: F.concat(F.lit("query="), F.substring_index(s, "=", 1))),
        F.transform(F.filter(F.array(F.regexp_extract(url, "#(.*)$", 1)), lambda s: s != ""), lambda s: F.concat(F.lit("fragment="), s)),
    )
    return F.array_distinct(F.coalesce(parts, F.array().cast("array<string>")))


def merged_tokens(baskets: DataFrame, least: int) -> DataFrame:
    """(token, item, n): the tokens of at least so many baskets (id, tokens); those of just the same baskets, told by a 128-bit sum of ids, are one item."""
    mark = lambda k: F.xxhash64("id", F.lit(k)).cast("decimal(20,0)")
    each = baskets.select("id", F.explode("tokens").alias("token"))
    seen = each.groupBy("token").agg(F.count("*").alias("n"), F.sum(mark(1)).alias("a"), F.sum(mark(2)).alias("b")).where(F.col("n") >= least)
    named = seen.groupBy("n", "a", "b").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    return named.select("n", F.explode("tokens").alias("token"), F.array_join("tokens", OR).alias("item"))


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.6, min_count: int = 20, min_lift: float = 1.02) -> DataFrame:
    """(rule, label, needed, confidence, support, rarest) from (url, low): pruned rules for either label, each seen min_count times at least.

    needed are the rule's items as arrays of tokens, of each of which a URL must have one; rarest is the item that fewest labelled URLs have."""
    spark = labelled.sparkSession
    rows = labelled.where("url is not null and low is not null").select(F.monotonically_increasing_id().alias("id"), tokens(F.col("url")).alias("tokens"), F.when(F.col("low"), LOW).otherwise(HIGH).alias("label"))
    baskets = materialize(rows, "baskets")
    shares = {r["label"]: r["count"] for r in baskets.groupBy("label").count().collect()}
    n = sum(shares.values())
    support = max(min_support, min_count / max(n, 1))
    if support > 1:
        release(baskets)
        return spark.createDataFrame([], "rule string, label string, needed array<array<string>>, confidence double, support double, rarest array<string>")
    items = materialize(merged_tokens(baskets.select("id", "tokens"), max(1, ceil(support * n - 1e-9))), "items")
    # Rare tokens are in no frequent set: only the others are joined, each basket's once for each item.
    named = items.groupBy("item").agg(F.min("token").alias("token"), F.max("n").alias("n"))
    sets = baskets.select("id", "label", F.explode("tokens").alias("token")).join(small(named, BROADCAST_ROWS), "token")
    sets = sets.groupBy("id").agg(F.array_append(F.collect_set("item"), F.first("label")).alias("items"))
    bare = baskets.join(sets.select("id"), "id", "left_anti").select("id", F.array("label").alias("items"))
    sets = materialize(sets.unionByName(bare).select("items"), "sets")
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(sets).associationRules
    label = F.element_at("consequent", 1)
    rules = found.where(label.isin(LOW, HIGH) & ~F.arrays_overlap("antecedent", F.array(F.lit(LOW), F.lit(HIGH))))
    share = F.when(label == LOW, shares.get(LOW, 0) / n).otherwise(shares.get(HIGH, 0) / n)
    rules = rules.where(F.col("confidence") >= min_lift * share).select(label.alias("label"), F.array_sort("antecedent").alias("items"), "confidence", "support")
    rules = materialize(rules.withColumn("rule", F.array_join("items", " ")), "rules")
    rarest = rules.select("rule", "label", F.explode("items").alias("item")).join(named.select("item", "n"), "item").groupBy("rule", "label").agg(F.min(F.struct("n", "item")).alias("k"))
    rules = rules.join(rarest.select("rule", "label", F.col("k.item").alias("key")), ["rule", "label"])
    part = rules.select("label", F.col("key").alias("item"), F.col("items").alias("part"), F.col("confidence").alias("sure"))
    whole = rules.select("rule", "label", "items", "confidence", F.explode("items").alias("item"))
    # A shorter rule that is as sure judges all that the longer one does. Each part is looked up by its rarest item only.
    spare = whole.join(part, ["label", "item"]).where((F.size("part") < F.size("items")) & (F.size(F.array_except("part", "items")) == 0) & (F.col("sure") >= F.col("confidence"))).select("rule", "label").distinct()
    kept = rules.join(spare, ["rule", "label"], "left_anti").select("rule", "label", F.transform("items", lambda i: F.split(i, r" \| ")).alias("needed"), "confidence", "support", F.split("key", r" \| ").alias("rarest"))
    out = materialize(kept, "kept")
    release(baskets, items, sets, rules)
    return out


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined, label, confidence): each distinct URL that fits a mined rule, and the surest rule (ties: the first by name)."""
    index = small(rules.select(F.explode("rarest").alias("token"), "rule", "label", "needed", "confidence"), BROADCAST_ROWS)
    seen = urls.select("url").where("url is not null").distinct().withColumn("all", tokens(F.col("url"))).select("url", "all", F.explode("all").alias("token"))
    fits = seen.join(index, "token").where(F.forall("needed", lambda item: F.arrays_overlap(item, F.col("all"))))
    best = fits.groupBy("url").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "rule", "label")).alias("m"))
    return best.select("url", F.col("m.rule").alias("mined"), F.col("m.label").alias("label"), (-F.col("m.c")).alias("confidence"))


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", **options: float) -> DataFrame:
    """pages with host, path, rule (written), verdict, and mined and confidence of the mined rule that judges where no written one does."""
    added = ("host", "path", "rule", "verdict", "mined", "confidence")
    named = pages.drop(*[c for c in pages.columns if c.lower() in added])
    out = named.withColumn("host", host(F.col(url_col))).withColumn("path", path(F.col(url_col)))
    rule, action = written_rule(F.col("host"), F.col("path"), rules)
    out = out.withColumn("rule", rule).withColumn("verdict", action)
    mined = match(out.where("rule is null").select(F.col(url_col).alias("url")), mine(labelled, **options))
    mined = mined.select(F.col("url").alias("__url"), "mined", F.col("label").alias("__label"), "confidence")
    out = out.join(mined, (F.col(url_col) == F.col("__url")) & F.col("rule").isNull(), "left").drop("__url")
    return out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("__label") == LOW, "block"), F.lit("allow"))).drop("__label")
