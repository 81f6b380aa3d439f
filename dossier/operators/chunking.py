"""Chunks of texts by sentences within a size, as an ordered fold over one text at a time, in SQL."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from dossier.functions.text import clean_text


def pieces(text: Column, size: int) -> Column:
    """The sentences; those longer than `size` cut into slices of it."""
    parts = F.filter(F.transform(F.split(clean_text(text), r"(?<=[。！？.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / size).cast("int")), lambda i: F.trim(F.substr(s, i * size + 1, F.lit(size))))
    return F.transform(parts, lambda s: F.struct((F.length(s) > size).alias("long"), F.when(F.length(s) > size, cut(s)).otherwise(F.array(s)).alias("p")))


def sentence_chunks(text: Column, size: int = 900) -> Column:
    """Sentences joined while they stay within the size; an oversized sentence stands alone, sliced. A text within the size is one chunk, an empty one none."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(s: Column, x: Column) -> Column:
        closed = F.when(s["now"] != "", F.array_append(s["done"], s["now"])).otherwise(s["done"])
        one = x["p"][0]
        over = (s["now"] != "") & (F.length(s["now"]) + F.length(one) > size)
        done = F.when(x["long"], F.concat(closed, x["p"])).when(over, closed).otherwise(s["done"])
        now = F.when(x["long"], "").when(over | (s["now"] == ""), one).otherwise(F.concat_ws(" ", s["now"], one))
        return F.struct(done.alias("done"), now.alias("now"))

    folded = F.aggregate(pieces(text, size), start, step, lambda s: F.when(s["now"] != "", F.array_append(s["done"], s["now"])).otherwise(s["done"]))
    whole = clean_text(text)
    return F.when(whole == "", F.array().cast("array<string>")).when(F.length(whole) <= size, F.array(whole)).otherwise(folded)


def chunk_documents(documents: DataFrame, size: int = 900) -> DataFrame:
    """(doc_id, chunk, text)"""
    return documents.select("doc_id", F.posexplode(sentence_chunks(F.col("text"), size)).alias("chunk", "text"))
