"""Text functions as Column builders. Everything but char_jaccard() stays in the JVM; nulls are empty texts unless said otherwise."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyspark.sql.functions as F
from pyspark.sql import Column

from .lexicon import NODE_PREFIX

CJK = "一-鿿"
_TOKEN = rf"[a-z0-9][a-z0-9_+\-./]{{1,}}|[{CJK}]+"


#: White space of Unicode, as (?U)\s has it.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def clean_text(c: Column) -> Column:
    """Null to empty, NUL to a blank, runs of blanks to one, more than two line feeds to two, trimmed of Unicode white space.

    Most texts hold little to clean: the patterns look for what is replaced only, since each blank replaced by itself takes longer than all else."""
    c = F.coalesce(c, F.lit(""))
    for x in "\x00\t\r\f\x0b":
        c = F.replace(c, F.lit(x), F.lit(" "))
    c = F.regexp_replace(c, "  +", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.trim(c, F.lit(SPACES))


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def preview(c: Column, limit: int = 140) -> Column:
    """One line of at most limit + 2 characters."""
    c = F.regexp_replace(clean_text(c), r"(?U)\s+", " ")
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit - 1), F.lit("...")))


def split_multi(c: Column) -> Column:
    """The trimmed, non-empty parts between ; ； , ， and |."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"[;；,，|]"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def split_ints(c: Column) -> Column:
    """The distinct first numbers of the parts, sorted."""
    numbers = F.transform(F.filter(split_multi(c), lambda p: p.rlike(r"\d")), lambda p: F.regexp_extract(p, r"(\d+)", 1).cast("int"))
    return F.array_sort(F.array_distinct(numbers))


def as_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))


def doc_name(c: Column) -> Column:
    """A file name as a document id."""
    stem = F.regexp_replace(F.regexp_extract(c, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    safe = F.regexp_replace(F.regexp_replace(stem, r"\s+", "_"), rf"[^0-9A-Za-z_\-{CJK}]+", "_")
    safe = F.regexp_replace(safe, "^_+|_+$", "")
    return F.when(safe == "", "doc").otherwise(safe)


def node_id(node_type: Column, doc_id: Column, page: Column, index: Column) -> Column:
    """P_doc_page, or prefix_doc_page_index."""
    prefix = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in NODE_PREFIX.items() for x in kv]), node_type), F.lit("N"))
    return F.when(node_type == "page", F.concat_ws("_", prefix, doc_id, page)).otherwise(F.concat_ws("_", prefix, doc_id, page, index))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once though a lambda refers to it often."""
    return F.element_at(F.transform(F.array(value), use), 1)


def grams(c: Column, *sizes: int) -> Column:
    """The runs of so many characters, size by size; none of a size if the text is shorter. Linear in the text."""

    def runs_of(chars: Column, n: int) -> Column:
        k = F.size(chars) - (n - 1)
        run = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.concat(*[F.get(chars, i + j) for j in range(n)]))
        return F.when(k > 0, run).otherwise(F.array().cast("array<string>"))

    def runs(chars: Column) -> Column:
        return F.concat(*[runs_of(chars, n) for n in sizes])

    return let(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), runs)


def bm25_tokens(c: Column) -> Column:
    """Words of at least two characters with + - . / _ inside, also without a plural s beyond four letters; runs of CJK characters as uni-, bi- and trigrams, and whole up to four."""
    found = F.regexp_extract_all(casefold(clean_text(c)), F.lit(_TOKEN), F.lit(0))
    found = F.filter(F.transform(found, lambda t: F.regexp_replace(t, r"^[._\-/]+|[._\-/]+$", "")), lambda t: t != "")
    cjk = lambda t: F.concat(F.when(F.length(t) <= 4, F.array(t)).otherwise(F.array().cast("array<string>")), grams(t, 1, 2, 3))
    word = lambda t: F.when(t.endswith("s") & (F.length(t) > 4), F.array(t, F.regexp_replace(t, "s$", ""))).otherwise(F.array(t))
    return F.flatten(F.transform(found, lambda t: F.when(t.rlike(f"^[{CJK}]"), cjk(t)).otherwise(word(t))))


#: Characters of texts whose bigrams are held at a time, of one pair of texts at least.
CHARACTERS = 1 << 20


def char_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of character bigrams; a text of one character is one, an empty text too. Null where a text is."""
    return F.arrow_udf(bigram_jaccard, "double")(a.cast("string"), b.cast("string"))


def bigram_jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
    size = np.cumsum([x + y for x, y in zip(*(pa.compute.fill_null(pa.compute.utf8_length(t), 0).to_pylist() for t in (a, b)), strict=True)])
    out, first = [np.zeros(0)], 0
    while first < len(size):
        last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + CHARACTERS, "right")))
        x, y = (_bigrams(t.slice(first, last - first).to_pylist()) for t in (a, b))
        both = np.sort(np.concatenate([x, y]))
        met = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(42)).astype(np.int64), minlength=last - first)
        every = sum(np.bincount((t >> np.uint64(42)).astype(np.int64), minlength=last - first) for t in (x, y))
        out.append(met / (every - met))
        first = last
    missing = pa.compute.or_(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate(out), mask=missing)


def _bigrams(texts: list[str | None]) -> np.ndarray:
    """The distinct bigrams of each text as row << 42 | first << 21 | second, sorted; characters count from 1, and 0 stands for one that is not there."""
    lengths = np.array([len(t or "") for t in texts], np.int64)
    c = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    row = np.repeat(np.arange(len(texts), dtype=np.uint64), lengths) << np.uint64(42)
    # Of a text's last character no bigram begins.
    inner = np.ones(len(c), bool)
    inner[np.cumsum(lengths)[lengths > 0] - 1] = False
    inner = np.flatnonzero(inner)
    short = np.flatnonzero(lengths < 2)
    alone = np.zeros(len(short), np.uint64)
    alone[lengths[short] == 1] = c[(np.cumsum(lengths) - lengths)[short[lengths[short] == 1]]] << np.uint64(21)
    found = np.sort(np.concatenate([row[inner] | c[inner] << np.uint64(21) | c[np.minimum(inner + 1, max(0, len(c) - 1))], short.astype(np.uint64) << np.uint64(42) | alone]))
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    return found[new]


def term_pattern(term: str, plural: bool = True) -> str:
    """A pattern, for Java and RE2, that finds a casefolded term: Latin terms as whole words with a plural s, CJK terms anywhere."""
    term = term.casefold()
    if re.search(f"[{CJK}]", term):
        return re.escape(term)
    body = r"\s+".join(re.escape(p) for p in term.split(" "))
    return rf"(?:^|[^a-z0-9]){body}{'s?' if plural else ''}(?:[^a-z0-9]|$)"


def _longest(term: str) -> str:
    """A part of a term that each text holds which term_pattern() fits."""
    term = term.casefold()
    return term if re.search(f"[{CJK}]", term) else max(term.split(" "), key=len)


def has_any(c: Column, terms: tuple[str, ...], plural: bool = True) -> Column:
    """Whether any term is in a text, which is best a column. The pattern, slow on long texts, runs only where a term's longest word is found."""
    return holds_any(c, tuple(dict.fromkeys(_longest(t) for t in terms))) & c.rlike("|".join(term_pattern(t, plural) for t in terms))


def holds_any(c: Column, terms: tuple[str, ...]) -> Column:
    """Whether any term is part of the text, anywhere."""
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(c, t))


def count_terms(c: Column, terms: tuple[str, ...], whole: bool = True) -> Column:
    """How many of the terms the text holds."""
    hits = [((F.contains(c, F.lit(_longest(t))) & c.rlike(term_pattern(t))) if whole else F.contains(c, F.lit(t))).cast("int") for t in terms]
    return sum(hits[1:], hits[0])


def document_refs(c: Column) -> Column:
    """The sorted distinct references kind:number, such as figure:2 or table:s1, spaced letters mended."""
    c = F.regexp_replace(F.regexp_replace(clean_text(c), r"(?i)F\s*i\s*g\s*u\s*r\s*e", "Figure"), r"(?i)T\s*a\s*b\s*l\s*e", "Table")
    no = r"([Ss]?\d+(?:[.\-]\d+)?[A-Za-z]?)"

    def numbers(pattern: str, kind: str) -> Column:
        found = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
        return F.transform(found, lambda x: F.concat(F.lit(f"{kind}:"), F.regexp_extract(F.lower(x), r"^(s?\d+)", 1)))

    found = [numbers(*x) for x in ((rf"(?i)\b(?:fig\.?|figure)\s*{no}", "figure"), (rf"(?i)\btable\s*{no}", "table"), (rf"[图圖]\s*{no}", "figure"), (rf"表\s*{no}", "table"))]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def is_toc_entry(c: Column) -> Column:
    c = clean_text(c)
    return F.contains(c, F.lit("···")) | c.rlike(r"\.{4,}\s*\d+\s*$")


def support_terms(c: Column, stopwords: tuple[str, ...]) -> Column:
    """The distinct words, numbers and CJK bigrams of a text but for stop words."""
    c = casefold(clean_text(c))
    terms = F.regexp_extract_all(c, F.lit(r"[a-zA-Z][a-zA-Z0-9_\-/]{2,}|\d+(?:\.\d+)?%?"), F.lit(0))
    cjk = grams(F.regexp_replace(c, f"[^{CJK}]", ""), 2)
    return F.array_except(F.array_distinct(F.concat(terms, cjk)), F.array(*map(F.lit, stopwords)))


def source_context(c: Column) -> Column:
    return F.regexp_replace(clean_text(c), r"(?i)/(?:figure|fig|table|caption|image)_?\d+[A-Za-z-]*$", "")
