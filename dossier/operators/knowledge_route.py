"""Routes by names: product groups, and a knowledge graph of entities and relations with the nodes they come from.

Names are found by an equi-join of whole names with runs of a text's words, so that a text meets the names that it holds however many begin alike."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window

from dossier.functions import lexicon as L
from dossier.functions.text import CJK, casefold, clean_text
from dossier.operators.structure import settle

VISUAL = ("table", "figure", "caption")


#: Tokens are Latin words and numbers, and single other characters. Runs of so many tokens of a text are met with names.
RUN = 5
_TOKEN = r"(?s)[a-z0-9]+|[^a-z0-9]"
#: Noncharacters, which no text holds: around Latin words and numbers, before and after other characters that stand beside none.
_WORD, _BEFORE, _AFTER = "\ufdd0", "\ufdd1", "\ufdd2"


def marked(c: Column) -> Column:
    """A casefolded text with marks, such that it holds a marked name where the text holds the name and no Latin letter or digit stands on either side."""
    c = F.regexp_replace(c, "([a-z0-9]+)", f"{_WORD}$1{_WORD}")
    c = F.regexp_replace(c, f"(?s)(?<!{_WORD})([^a-z0-9{_WORD}])", f"{_BEFORE}$1")
    return F.regexp_replace(c, f"(?s)([^a-z0-9{_WORD}{_BEFORE}])(?!{_WORD})", f"$1{_AFTER}")


def holds(text: Column, name: Column, text_marked: Column | None = None) -> Column:
    """Whether a casefolded text holds a casefolded name: names with ideographs anywhere, others not within a Latin word or number."""
    return F.when(name == "", False).when(name.rlike(f"[{CJK}]"), F.contains(text, name)).otherwise(F.contains(marked(text) if text_marked is None else text_marked, marked(name)))


#: Distinct keys of names that are sent to every task, which then makes no rows of runs that meet none.
MOST_KEYS = 500_000
#: Rows of a batch whose texts are held as Python texts at a time.
ROWS = 256
_BLANK = frozenset(" \t\n\x0b\f\r")
_LATIN = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_TOKENS, _WORDS, _IDEOGRAPH = re.compile(_TOKEN), re.compile("[a-z0-9]+"), re.compile(f"[{CJK}]")


def key_sizes(keys: frozenset[str]) -> dict[str, tuple[int, ...]]:
    """How many tokens the keys have that begin with a token, but for those of a word alone."""
    sizes: dict[str, set[int]] = {}
    for key in keys:
        t = _TOKENS.findall(key)
        if t and (len(t) > 1 or t[0][0] not in _LATIN):
            sizes.setdefault(t[0], set()).add(len(t))
    return {t: tuple(sorted(n)) for t, n in sizes.items()}


def text_runs(text: str | None, keys: frozenset[str] | None = None, sizes: dict[str, tuple[int, ...]] | None = None) -> set[tuple[str, bool]]:
    """The distinct runs (run, free) of up to RUN tokens of a text that neither begin nor end with white space, free being whether no Latin letter or digit stands on either side; of all runs, or of those among the keys, with their key_sizes()."""
    t = _TOKENS.findall(text or "")
    # A word alone is free.
    out = {(w, True) for w in (keys.intersection(t) if keys is not None else ()) if w[0] in _LATIN}
    every = range(1, RUN + 1)
    for i, first in enumerate(t):
        many = every if sizes is None else sizes.get(first)
        if many and first not in _BLANK:
            for n in many:
                if i + n > len(t):
                    break
                last = t[i + n - 1]
                run = "".join(t[i : i + n])
                if last not in _BLANK and (keys is None or run in keys):
                    out.add((run, (first[0] in _LATIN or not i or t[i - 1][0] not in _LATIN) and (last[0] in _LATIN or i + n == len(t) or t[i + n][0] not in _LATIN)))
    return out


def run_rows(keys: frozenset[str] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over batches (text_id, text) that makes a row (text_id, __key, free) for each of a text's runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = key_sizes(keys) if keys is not None else None
        for part in (batch.slice(i, ROWS) for batch in batches for i in range(0, len(batch), ROWS)):
            found = [(i, *r) for i, text in enumerate(part.column(1).to_pylist()) for r in text_runs(text, keys, sizes)]
            for at in range(0, len(found), 1 << 16):
                row, key, free = zip(*found[at : at + (1 << 16)], strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(key, pa.string()), pa.array(free)], ["text_id", "__key", "free"])

    return run


def name_hits(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(text_id, name_id, name) for the names that a text holds. texts: (text_id, text); names: (name_id, name); both casefolded, names cleaned.

    Runs of tokens meet names by an equi-join, without the texts, and both sides are shuffled: the planner does not see how many runs a
    text has. Where the names have no more than MOST_KEYS keys, only runs among these become rows. Names of more than RUN tokens are met
    by their first ones, of ideographs by the first run of these, and then held against the text."""
    first = lambda pattern: F.regexp_replace(F.regexp_extract("name", pattern, 0), r"\s+$", "")
    cjk = F.col("name").rlike(f"[{CJK}]")
    key = F.when(cjk, first(f"(?s)[{CJK}][^a-z0-9]{{0,{RUN - 1}}}")).otherwise(first(f"(?s)^(?:[a-z0-9]+|[^a-z0-9]){{1,{RUN}}}"))
    own = settle(names.where("name <> ''").select("name_id", "name", key.alias("__key"), cjk.alias("__cjk")).distinct(), "names")
    keys = own.select("__key").distinct()
    few = frozenset(keys.toArrow().column(0).to_pylist()) if keys.count() <= MOST_KEYS else None
    kind = texts.schema["text_id"].dataType.simpleString()
    found = texts.select("text_id", "text").mapInArrow(run_rows(few), f"text_id {kind}, __key string, free boolean")
    # A few rows for each text, which are read twice; the runs, hundreds for each, are made once.
    met = settle(found.join(own.hint("merge"), "__key"), "met")
    whole = met.where("name = __key and (free or __cjk)").select("text_id", "name_id", "name")
    rest = met.where("name <> __key").select("text_id", "name_id", "name").join(texts.select("text_id", "text").hint("merge"), "text_id")
    rest = rest.where(F.contains("text", F.col("name")) & holds(F.col("text"), F.col("name"))).select("text_id", "name_id", "name")
    return whole.unionByName(rest).distinct()


def product_groups(spark: SparkSession) -> DataFrame:
    """(canonical, terms) of the known product groups."""
    return spark.createDataFrame([(k, [k, *v]) for k, v in L.PRODUCT_ALIASES.items()], "canonical string, terms array<string>")


def product_scores(pairs: DataFrame, questions: DataFrame, groups: DataFrame) -> DataFrame:
    """(question_id, node_id, score), once each: for the group that fits best, .58 if its terms in the question are in the document's name, .42 in section or source, .26 in the text, .06 for visuals that are described.

    pairs: (question_id, node_id, doc_id, section, source_ref, node_type, text_product, text_visual); questions: (question_id, blob).
    A question's terms and then its pairs go through one map over rows that stand by question, so that no row is made for a pair and a term."""
    names = groups.select(F.col("canonical").alias("name_id"), F.explode("terms").alias("name")).withColumn("name", casefold(clean_text(F.col("name"))))
    found = name_hits(questions.select(F.col("question_id").alias("text_id"), F.col("blob").alias("text")), names)
    place = casefold(clean_text(F.concat_ws(" ", F.coalesce("section", F.lit("")), F.coalesce("source_ref", F.lit("")))))
    looks = F.coalesce(F.col("node_type").isin(*VISUAL) & (F.col("text_visual") != ""), F.lit(False))
    lines = pairs.select("question_id", F.lit(True).alias("pair"), F.col("node_id").cast("string").alias("node_id"), casefold(clean_text(F.col("doc_id").cast("string"))).alias("own"), place.alias("place"), F.col("text_product").alias("text"), looks.alias("looks"))
    none = lambda name: F.lit(None).cast("string").alias(name)
    terms = found.select(F.col("text_id").alias("question_id"), F.lit(False).alias("pair"), none("node_id"), F.col("name_id").cast("string").alias("own"), F.col("name").alias("place"), none("text"), F.lit(False).alias("looks"))
    rows = terms.unionByName(lines).repartition("question_id").sortWithinPartitions("question_id", "pair")
    kind = rows.schema["question_id"].dataType.simpleString()
    got = rows.mapInArrow(fitted, f"question_id {kind}, node_id string, score double").groupBy("question_id", "node_id").agg(F.max("score").alias("score"))
    return got.select("question_id", F.col("node_id").cast(pairs.schema["node_id"].dataType).alias("node_id"), F.round("score", 4).alias("score"))


class Terms:
    """The terms of a question's groups, and which groups have one in a text, as holds() has it."""

    def __init__(self) -> None:
        #: Groups by terms of one word; longer terms by their first word, and those without a word.
        self.words: dict[str, set[str]] = {}
        self.longer: dict[str, list[tuple[str, list[str], str]]] = {}
        self.others: list[tuple[str, bool, str]] = []
        self.before: dict[str, set[str]] = {}

    def add(self, group: str, term: str) -> None:
        words = _WORDS.findall(term)
        if words == [term]:
            self.words.setdefault(term, set()).add(group)
        elif words and not _IDEOGRAPH.search(term):
            self.longer.setdefault(words[0], []).append((term, words, group))
        else:
            self.others.append((term, bool(_IDEOGRAPH.search(term)), group))

    def groups(self, text: str | None) -> set[str]:
        out: set[str] = set()
        if not text:
            return out
        words = set(_WORDS.findall(text)) if self.words or self.longer else set()
        for w in words & self.words.keys():
            out |= self.words[w]
        for w in words & self.longer.keys():
            out.update(group for term, parts, group in self.longer[w] if group not in out and words.issuperset(parts) and _apart(text, term))
        out.update(group for term, cjk, group in self.others if group not in out and (term in text if cjk else _apart(text, term)))
        return out

    def names(self, text: str | None) -> set[str]:
        """The groups of a name or place, which many lines share."""
        text = text or ""
        if text not in self.before:
            if len(self.before) >= ROWS:
                self.before.clear()
            self.before[text] = self.groups(text)
        return self.before[text]


def _apart(text: str, term: str) -> bool:
    """Whether the text holds the term somewhere with no Latin letter or digit on either side."""
    at = text.find(term)
    while at >= 0:
        end = at + len(term)
        if (not at or text[at - 1] not in _LATIN) and (end == len(text) or text[end] not in _LATIN):
            return True
        at = text.find(term, at + 1)
    return False


def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A map over rows (question_id, pair, node_id, own, place, text, looks) that stand by question, its terms (group and term as own and place) before its pairs, to (question_id, node_id, score)."""
    asked, terms = None, Terms()
    for part in (batch.slice(i, ROWS) for batch in batches for i in range(0, len(batch), ROWS)):
        at, score = [], []
        for i, (question, pair, own, place, text, looks) in enumerate(zip(*(part.column(c).to_pylist() for c in (0, 1, 3, 4, 5, 6)), strict=True)):
            if question != asked:
                asked, terms = question, Terms()
            if not pair:
                # Texts without an id meet no pair.
                if question is not None:
                    terms.add(own, place)
                continue
            at.append(i)
            if not (terms.words or terms.longer or terms.others):
                score.append(0.0)
                continue
            in_name, in_place, in_text = terms.names(own), terms.names(place), terms.groups(text)
            each = ((0.58 if g in in_name else 0.0) + (0.42 if g in in_place else 0.0) + (0.26 if g in in_text else 0.0) for g in in_name | in_place) if in_name or in_place else ()
            best = max(each, default=0.0)
            score.append(min(1.0, max(best, 0.26 if in_text else 0.0) + (0.06 if looks else 0.0)))
        at = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(2).take(at), pa.array(score, pa.float64())], ["question_id", "node_id", "score"])


def entity_names(entities: DataFrame) -> DataFrame:
    """(entity_id, name): each entity's name and aliases, cleaned and casefolded. entities: (entity_id, name, aliases, entity_type, node_ids)."""
    every = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return entities.where("entity_id <> ''").select("entity_id", F.explode(every).alias("name")).select("entity_id", casefold(clean_text(F.col("name"))).alias("name")).where("name <> ''").distinct()


def node_entities(entities: DataFrame) -> DataFrame:
    """(node_id, entity_id): the nodes an entity is evidenced by."""
    return entities.where("entity_id <> ''").select(F.explode("node_ids").alias("node_id"), "entity_id").where("node_id <> ''").distinct()


def query_context(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """(question_id, entity_id, kind): the entities that a question is about, kind being concrete, action, policy or other.

    An image needs a name of more than four characters, a policy a name that is not generic or an intent of .65 and more (or its name in
    the question), an action a name that is not generic and some concrete entity beside it; others need to be named.
    questions: (question_id, blob, sales) as questions.after_sales() gives them."""
    info = entities.where("entity_id <> ''").select("entity_id", F.col("entity_type").alias("type"), clean_text(F.col("name")).alias("title")).dropDuplicates(["entity_id"])
    names = entity_names(entities).select(F.col("entity_id").alias("name_id"), "name")
    found = name_hits(questions.select(F.col("question_id").alias("text_id"), F.col("blob").alias("text")), names)
    special = lambda terms: F.max(~F.col("name").isin(*terms))
    found = found.groupBy(F.col("text_id").alias("question_id"), F.col("name_id").alias("entity_id")).agg(special(L.KG_GENERIC_POLICY).alias("own_policy"), special(L.KG_GENERIC_ACTION).alias("own_action"), F.max(F.length("name") > 4).alias("long"))
    intents = F.transform(F.filter("sales", lambda s: s["score"] >= 0.65), lambda s: F.element_at(F.create_map(*[F.lit(x) for kv in L.KG_POLICIES.items() for x in kv]), s["intent"]))
    titles = F.array_distinct(F.concat(F.filter(intents, lambda x: x.isNotNull()), F.array_compact(F.array(*[F.when(F.contains("blob", F.lit(n)), n) for n in L.KG_POLICIES.values()]))))
    strong = questions.select("question_id", F.explode(titles).alias("title")).join(info.where("type = 'policy'"), "title").select("question_id", "entity_id", "type")
    concrete = F.col("type").isin(*L.KG_CONCRETE)
    rows = found.join(info.hint("merge"), "entity_id").withColumn("beside", F.max(concrete).over(Window.partitionBy("question_id")))
    fits = F.when(F.col("type") == "image", F.col("long")).when(F.col("type") == "policy", F.col("own_policy")).when(F.col("type") == "action", F.col("beside") & F.col("own_action")).otherwise(True)
    kind = F.when(concrete, "concrete").when(F.col("type").isin("action", "policy"), F.col("type")).otherwise("other")
    return rows.where(fits).select("question_id", "entity_id", "type").unionByName(strong).distinct().select("question_id", "entity_id", kind.alias("kind"))


def _relation_bonus(looks: bool) -> Column:
    """A relation's bonus by its ends that the question is about; relations of images count more on a visual node."""
    c, kind = F.col, F.col("relation_type")
    some = F.when(c("ends") >= 2, 0.32).when(c("concrete") > 0, 0.16).otherwise(0.0)
    own = F.when((kind == "product_has_part") & (c("concrete") >= 2), 0.36).when((kind == "action_targets_part") & c("action") & (c("concrete") > 0), 0.34).when((kind == "fault_solved_by_action") & c("action") & (c("concrete") > 0), 0.32)
    own = own.when(kind.isin("image_depicts_part", "image_illustrates_action") & (c("action") | (c("concrete") > 0)), 0.26 if looks else 0.18)
    own = own.when(kind.isin("product_supports_action", "policy_applies_to_product") & (c("concrete") > 0) & (c("action") | c("policy")), 0.2).otherwise(0.0)
    return F.max(F.greatest(some, own))


def graph_scores(pairs: DataFrame, context: DataFrame, links: DataFrame, relations: DataFrame) -> DataFrame:
    """(question_id, node_id, score) by a node's entities and relations; questions that are about policies alone score nodes by these.

    pairs: (question_id, node_id, node_type, structure_type, captioned); context, links: query_context(), node_entities(); relations:
    (source_id, target_id, relation_type, evidence_node_id). A pair meets its own node's entities and relations only. All
    tables grow with the nodes, and files of the few long ids that they hold are small: no side is broadcast."""
    context, links = context.hint("merge"), links.hint("merge")
    own = pairs.select("question_id", "node_id")
    direct = own.join(links, "node_id").join(context, ["question_id", "entity_id"]).groupBy("question_id", "node_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("concrete", "action", "policy")])
    edges = relations.select("source_id", "target_id", "relation_type", F.col("evidence_node_id").alias("node_id")).where("node_id <> ''").distinct()
    ends = own.join(edges.hint("merge"), "node_id").withColumn("entity_id", F.explode(F.array_distinct(F.array("source_id", "target_id"))))
    met = ends.join(context, ["question_id", "entity_id"])
    met = met.groupBy("question_id", "node_id", "source_id", "target_id", "relation_type").agg(F.count("*").alias("ends"), F.count_if(F.col("kind") == "concrete").alias("concrete"), F.max(F.col("kind") == "action").alias("action"), F.max(F.col("kind") == "policy").alias("policy"))
    bonus = met.groupBy("question_id", "node_id").agg(_relation_bonus(True).alias("look_bonus"), _relation_bonus(False).alias("bonus"))
    about = context.groupBy("question_id").agg((F.max(F.col("kind") == "policy") & ~F.max(F.col("kind").isin("concrete", "action"))).alias("policies"))
    out = pairs.join(direct.hint("merge"), ["question_id", "node_id"], "left").join(bonus.hint("merge"), ["question_id", "node_id"], "left").join(about.hint("merge"), "question_id", "left").na.fill(0)
    visual, kind, n = F.col("node_type").isin(*VISUAL), F.coalesce("structure_type", F.lit("")), lambda k: F.col(f"n_{k}")
    alone = 0.55 + 0.12 * F.least(F.lit(2), n("policy"))
    alone = F.when(n("policy") == 0, 0.0).when(kind == "after_sales_policy", alone + 0.35).when((kind == "manual_profile") | (F.col("node_type") == "title"), F.least(alone, F.lit(0.18))).when(visual, F.least(alone, F.lit(0.25))).otherwise(F.least(alone, F.lit(0.45)))
    score = F.least(F.lit(0.72), 0.30 * n("concrete") + 0.12 * n("action") + 0.08 * n("policy")) + F.when(visual, F.col("look_bonus")).otherwise(F.col("bonus"))
    score = score + F.when(visual & (score > 0) & F.col("captioned"), 0.08).otherwise(0.0) + F.when((kind == "after_sales_policy") & (n("policy") > 0), 0.12).otherwise(0.0)
    score = score * F.when((kind == "manual_profile") & (n("concrete") == 0), 0.4).otherwise(1.0)
    final = F.when(F.col("policies"), alone).otherwise(score)
    return out.select("question_id", "node_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), final)), 4).alias("score"))
