"""Answers: extractive ones from evidence chains, support of each sentence by the evidence, and answers without unsupported sentences."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from dossier.functions.blocks import looks_chinese, trim_tail
from dossier.functions.lexicon import ANSWER_STOPWORDS, VISUAL_TYPES
from dossier.functions.text import clean_text, preview, support_terms


def sentences(c: Column) -> Column:
    """At line feeds, and after 。！？!?；; and white space."""
    marked = F.regexp_replace(clean_text(c), r"([。！？!?；;])\s+", "$1\n")
    return F.filter(F.transform(F.split(marked, r"\n+"), lambda s: F.trim(s)), lambda s: s != "")


def sentence_support(answers: DataFrame) -> DataFrame:
    """(answer_id, pos, sentence, support, n_terms): a sentence's terms that the question lacks (all, if it lacks none), those in the evidence over their number to the power .72.

    answers: (answer_id, question, answer, evidence)."""
    terms = lambda c: support_terms(c, ANSWER_STOPWORDS)
    out = answers.select("answer_id", F.posexplode(sentences(F.col("answer"))).alias("pos", "sentence"), terms(F.col("question")).alias("q"), terms(F.col("evidence")).alias("e"))
    out = out.withColumn("s", terms(F.col("sentence"))).withColumn("new", F.array_except("s", "q"))
    claim = F.when(F.size("new") > 0, F.col("new")).otherwise(F.col("s"))
    support = F.when(F.size("s") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.size(F.array_intersect(claim, F.col("e"))) / F.greatest(F.lit(1.0), F.pow(F.size(claim), F.lit(0.72)))))
    return out.select("answer_id", "pos", "sentence", F.round(support, 4).alias("support"), F.size("s").alias("n_terms"))


def correct(answers: DataFrame) -> DataFrame:
    """(answer_id, answer, status, removed): unsupported sentences dropped, unless too little would be left."""
    cited = F.col("sentence").rlike(r"\[E\d+\]|<PIC")
    keep = (F.col("support") >= 0.18) | (cited & (F.col("support") >= 0.08)) | (F.col("n_terms") <= 4)
    rows = sentence_support(answers).withColumn("keep", keep).groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sentence", "keep"))).alias("s"))
    out = answers.select("answer_id", clean_text(F.col("answer")).alias("original")).join(rows, "answer_id")
    kept = F.filter("s", lambda x: x["keep"])
    out = out.withColumn("kept", clean_text(F.array_join(F.transform(kept, lambda x: x["sentence"]), " "))).withColumn("n", F.size("s") - F.size(kept))
    short = F.length("kept") < F.greatest(F.lit(24), F.floor(F.length("original") * 0.45))
    status = F.when(short, "kept_original_low_support").when(F.col("n") > 0, "corrected").otherwise("verified")
    return out.select("answer_id", F.when(short, F.col("original")).otherwise(F.col("kept")).alias("answer"), status.alias("status"), F.when(short, 0).otherwise(F.col("n")).alias("removed"))


def lexical_overlap(a: Column, b: Column) -> Column:
    """.65 * the share of a's words in b + .35 * the share of its CJK characters."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(clean_text(c)), F.lit("[a-z0-9]{2,}"), F.lit(0)))
    chars = lambda c: F.array_distinct(F.regexp_extract_all(clean_text(c), F.lit("[一-鿿]"), F.lit(0)))
    share = lambda x, y: F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x)).otherwise(0.0)
    return 0.65 * share(words(a), words(b)) + 0.35 * share(chars(a), chars(b))


#: A step of a chain; chains are (question_id, question, summary, steps: array of these, in order).
STEP = "struct<node_id: string, node_type: string, page: int, content_preview: string, visual_summary: string, visual_caption: string, crop_image_path: string, page_image_path: string>"
# Sentences without evidence, and around it.
UNSURE = {True: "根据当前证据链，暂时无法确认该问题的答案。", False: "The current evidence chain is insufficient to answer the question."}
NOTHING_FOUND = "未检索到可用于回答该问题的证据。"


def evidence(step: Column, limit: int) -> Column:
    parts = F.array(*[clean_text(step[n]) for n in ("content_preview", "visual_summary", "visual_caption")])
    return preview(F.array_join(F.filter(parts, lambda x: x != ""), " "), limit)


def is_visual(step: Column) -> Column:
    out = F.coalesce(F.lower(clean_text(step["node_type"])).isin(*VISUAL_TYPES), F.lit(False))
    for n in ("crop_image_path", "page_image_path", "visual_summary", "visual_caption"):
        out = out | (clean_text(step[n]) != "")
    return out


def _numbered(steps: Column) -> Column:
    return F.transform(steps, lambda s, i: F.struct((i + 1).alias("n"), s.alias("s")))


def extractive(chains: DataFrame, most: int = 5) -> DataFrame:
    """The chains with `fallback`: the first three different pieces of evidence in the question's language, marks of the first two visual steps, and the steps cited."""
    told = F.filter(F.transform(_numbered(F.slice("steps", 1, most)), lambda x: F.struct(x["n"].alias("n"), evidence(x["s"], 240).alias("text"), is_visual(x["s"]).alias("visual"), clean_text(x["s"]["node_id"]).alias("id"))), lambda x: x["text"] != "")
    out = chains.withColumn("__told", told).withColumn("__zh", looks_chinese(F.coalesce("question", F.lit(""))))
    first = F.slice("__told", 1, 3)
    main = F.array_distinct(F.transform(first, lambda x: x["text"]))
    tails = F.filter(F.transform(main, trim_tail), lambda x: x != "")
    cited = F.array_join(F.transform(first, lambda x: F.concat(F.lit("[E"), x["n"].cast("string"), F.lit("]"))), " ")
    marks = F.transform(F.slice(F.filter("__told", lambda x: x["visual"]), 1, 2), lambda x: F.when(x["id"] == "", "<PIC>").otherwise(F.concat(F.lit("<PIC:"), x["id"], F.lit(">"))))
    marks = F.when(F.size(marks) > 0, F.concat(F.lit(" "), F.array_join(marks, " "))).otherwise("")
    zh = F.concat(F.lit("根据证据链，"), F.array_join(tails, "；"), marks, F.lit("。证据来源："), cited)
    en = F.concat(F.lit("Based on the evidence chain, "), F.array_join(main, "; "), marks, F.lit(". Sources: "), cited)
    none = F.when(F.col("__zh"), UNSURE[True]).otherwise(UNSURE[False])
    return out.withColumn("fallback", F.when(F.size("__told") == 0, none).otherwise(clean_text(F.when(F.col("__zh"), zh).otherwise(en)))).drop("__told", "__zh")


def evidence_metadata(chains: DataFrame, most: int = 5) -> DataFrame:
    """The chains with the different nodes, pages and kinds of their steps, a citation of each step, and the numbers of steps and of visual ones."""
    steps = F.slice("steps", 1, most)
    each = lambda name: F.array_join(F.array_distinct(F.filter(F.transform(steps, lambda s: clean_text(s[name].cast("string"))), lambda x: x != "")), ";")
    page = lambda s: F.coalesce(s["page"].cast("string"), F.lit("?"))
    cite = lambda x: F.concat(F.lit("[E"), x["n"].cast("string"), F.lit("] "), clean_text(x["s"]["node_id"]), F.lit(" ("), clean_text(x["s"]["node_type"]), F.lit(", p."), page(x["s"]), F.lit(")"))
    counts = [F.size(steps).alias("evidence_count"), F.size(F.filter(steps, is_visual)).alias("visual_evidence_count")]
    return chains.select("*", each("node_id").alias("evidence_node_ids"), each("page").alias("evidence_pages"), each("node_type").alias("evidence_modalities"), F.array_join(F.transform(_numbered(steps), cite), " | ").alias("citations"), *counts)


def cache_key(provider: str, model: str, version: str, most: int = 5) -> Column:
    """The digest of all that an answer depends on."""
    used = F.transform(F.slice("steps", 1, most), lambda s: F.struct(clean_text(s["node_id"]).alias("node_id"), evidence(s, 700).alias("content"), F.when(clean_text(s["visual_summary"]) != "", clean_text(s["visual_summary"])).otherwise(clean_text(s["visual_caption"])).alias("visual")))
    return F.sha2(F.to_json(F.struct(F.lit(version).alias("version"), F.lit(provider).alias("provider"), F.lit(model).alias("model"), clean_text(F.col("question")).alias("question"), clean_text(F.col("summary")).alias("summary"), used.alias("steps"))), 256)


def generate(chains: DataFrame, cache: DataFrame | None = None, provider: str = "none", model: str = "", version: str = "1", most: int = 5, answer: Column | None = None) -> DataFrame:
    """The chains with answer, status, removed and cache_key: the cached answer of the same key, else `answer` (a model's, as a column), else the extractive one; each corrected by its evidence.

    cache: (cache_key, answer, status), one row for each key (sources.last_wins). A cached row keeps its status, an empty one is `cached`;
    without a model the status is `fallback`, and `empty_fallback` where the model says nothing. A correction adds its own status."""
    out = extractive(chains, most).withColumn("cache_key", cache_key(provider, model, version, most))
    kept = cache.select("cache_key", clean_text(F.col("answer")).alias("__cached"), clean_text(F.col("status")).alias("__was")) if cache is not None else None
    out = out.join(kept, "cache_key", "left") if kept is not None else out.withColumns({"__cached": F.lit(None).cast("string"), "__was": F.lit(None).cast("string")})
    said = clean_text(answer) if answer is not None else F.lit("")
    fresh, fresh_status = (F.col("fallback"), F.lit("fallback")) if provider == "none" else (F.when(said != "", said).otherwise(F.col("fallback")), F.when(said != "", "ok").otherwise("empty_fallback"))
    hit = F.col("__cached").isNotNull()
    out = out.withColumn("raw", F.when(hit, F.col("__cached")).otherwise(fresh)).withColumn("raw_status", F.when(~hit, fresh_status).when(F.col("__was") == "", "cached").otherwise(F.col("__was")))
    proof = F.array_join(F.transform(F.slice("steps", 1, most), lambda s: evidence(s, 700)), "\n")
    checked = correct(out.select(F.col("question_id").alias("answer_id"), "question", F.col("raw").alias("answer"), proof.alias("evidence")))
    checked = checked.select(F.col("answer_id").alias("question_id"), "answer", F.col("status").alias("__check"), "removed")
    out = out.join(checked, "question_id", "left").drop("__cached", "__was", "fallback")
    plain = F.coalesce(F.col("__check"), F.lit("verified")) == "verified"
    status = F.when(plain, F.col("raw_status")).otherwise(F.concat_ws(";answer_self_correction=", "raw_status", "__check"))
    return out.withColumn("answer", F.when(F.coalesce("answer", F.lit("")) != "", F.col("answer")).otherwise(F.col("raw"))).withColumn("status", status).withColumn("removed", F.coalesce("removed", F.lit(0))).drop("raw", "raw_status", "__check")


def local_answer(question: Column, steps: Column) -> Column:
    """What an upload's chain says at once: the main evidence and the first three steps."""
    zh = looks_chinese(F.coalesce(question, F.lit("")))
    text = lambda s: F.coalesce(*[F.nullif(clean_text(s[n]), F.lit("")) for n in ("content_preview", "visual_caption", "visual_summary")], F.lit(""))
    page, kind = lambda s: F.coalesce(s["page"].cast("string"), F.lit("?")), lambda s: F.coalesce(s["node_type"], F.lit(""))
    told = F.filter(F.transform(_numbered(F.slice(steps, 1, 3)), lambda x: F.struct(x["n"].alias("n"), x["s"].alias("s"), text(x["s"]).alias("t"))), lambda x: x["t"] != "")
    tag = lambda x: F.concat(F.lit("[E"), x["n"].cast("string"), F.lit("] "))
    one_zh = F.transform(told, lambda x: F.concat(tag(x), F.lit("第"), page(x["s"]), F.lit("页"), kind(x["s"]), F.lit(": "), preview(x["t"], 110)))
    one_en = F.transform(told, lambda x: F.concat(tag(x), F.lit("page "), page(x["s"]), F.lit(" "), kind(x["s"]), F.lit(": "), preview(x["t"], 110)))
    main = preview(text(F.get(steps, 0)), 180)
    out_zh = F.concat(F.lit("根据上传文档的证据链，可以直接依据主证据回答："), main, F.lit("。支撑证据包括"), F.array_join(one_zh, "；"), F.lit("。"))
    out_en = F.concat(F.lit("The answer is grounded in the top evidence: "), main, F.lit(". Supporting evidence: "), F.array_join(one_en, "; "), F.lit("."))
    return F.when(F.size(steps) == 0, NOTHING_FOUND).otherwise(F.when(zh, out_zh).otherwise(out_en))
