"""Question expansion: a routing table's hints, appended to the questions that it lists."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from dossier.functions import lexicon as L
from dossier.functions.blocks import submission_id
from dossier.functions.text import clean_text, has_any
from dossier.operators.planning import literal_map
from dossier.sources.tables import last_wins

SERVICE = "售后"


def _parts(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[;,；，]\s*"), clean_text), lambda x: x != "")


def _listed(cond: Column, *texts: Column) -> Column:
    return F.when(cond, F.array(*texts)).otherwise(F.array().cast("array<string>"))


def keyed(routes: DataFrame, order: str) -> DataFrame:
    """A routing table by submission (`sid`): its own id, else that of its question; the last row of a submission in `order` counts, rows without one go."""
    own = clean_text(F.col("submission_id"))
    out = routes.withColumn("sid", F.when(own != "", own).otherwise(submission_id(F.col("question_id"))))
    return last_wins(out.where("sid <> ''"), "sid", order)


def hints() -> Column:
    """The hints of a row of a routing table (route, product, question_type, service_terms, matched_aliases), each once, in order."""
    route, product, kind = (clean_text(F.col(c)) for c in ("route", "product", "question_type"))
    services, aliases = _parts(F.col("service_terms")), _parts(F.col("matched_aliases"))
    of_route, of_product = literal_map(L.ROUTE_HINTS)[route], literal_map(L.PRODUCT_HINTS)[product]
    known = F.when(of_product.isNotNull(), F.concat(F.lit("product="), product, F.lit("; product aliases="), of_product)).otherwise(F.concat(F.lit("product="), product))
    wide = (route == "service") | F.exists(services, lambda s: s != SERVICE)
    of_services = F.transform(F.filter(services, lambda s: literal_map(L.SERVICE_HINTS)[s].isNotNull()), lambda s: F.concat(F.lit("service_term="), s, F.lit("; "), literal_map(L.SERVICE_HINTS)[s]))
    return F.array_distinct(F.concat(
        _listed(of_route.isNotNull(), F.concat(F.lit("route="), route, F.lit("; intent aliases="), of_route)),
        _listed(product != "", known),
        _listed(F.size(aliases) > 0, F.concat(F.lit("matched product aliases="), F.array_join(F.slice(aliases, 1, 10), " "))),
        *[_listed(F.contains(kind, F.lit(k)), F.lit(f"question_type_hint={v}")) for k, v in L.TYPE_HINTS.items()],
        F.when(wide, of_services).otherwise(F.array().cast("array<string>")),
    ))


def expand(questions: DataFrame, routes: DataFrame, most: int = 8) -> DataFrame:
    """The questions with `expanded` (the question and up to `most` hints), route_name and route_product; without hints the question as it is.

    questions: (question_id, question); routes as keyed() gives them."""
    told = routes.select("sid", hints().alias("__hints"), clean_text(F.col("route")).alias("route_name"), clean_text(F.col("product")).alias("route_product"))
    out = questions.withColumn("sid", submission_id(F.col("question_id"))).join(told, "sid", "left").drop("sid")
    some = F.size(F.coalesce("__hints", F.array().cast("array<string>"))) > 0
    text = F.concat(clean_text(F.col("question")), F.lit("\nSearch context: "), F.array_join(F.slice("__hints", 1, most), " | "))
    named = lambda c: F.when(some, F.col(c)).otherwise("").alias(c)
    return out.select(*questions.columns, F.when(some, text).otherwise(F.col("question")).alias("expanded"), named("route_name"), named("route_product"))


def routing(understood: DataFrame) -> DataFrame:
    """A routing table of understood questions: service or manual by profile, the first product group that is named, its aliases and the service terms that the question holds."""
    blob, sold = F.col("blob"), F.size("sales") > 0
    route = F.when(sold & F.col("profile").isin("policy", "after_sales"), F.when(F.col("has_product"), "service_with_product").otherwise("service"))
    route = route.when(F.col("profile") == "manual_visual", "manual_visual").when(F.col("profile").isin("manual", "troubleshooting"), "manual").when(F.col("wants_visual"), "visual").otherwise("")
    named = lambda *terms: has_any(blob, terms, plural=False)
    product = F.coalesce(*[F.when(named(k, *v), k) for k, v in L.PRODUCT_ALIASES.items()], F.lit(""))
    every = tuple(dict.fromkeys(a for v in L.PRODUCT_ALIASES.values() for a in v))
    aliases = F.array_join(F.array(*[F.when(named(a), a) for a in every]), ";")
    services = F.array_join(F.array(*[F.when(F.contains(blob, F.lit(s)), s) for s in L.SERVICE_HINTS]), ";")
    return understood.select("question_id", F.lit("").alias("submission_id"), "question_type", route.alias("route"), product.alias("product"), aliases.alias("matched_aliases"), services.alias("service_terms"))
