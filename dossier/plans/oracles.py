"""DuckDB SQL for the queries of the catalog."""

from __future__ import annotations

import re

from dossier.functions import lexicon as L
from dossier.functions.text import term_pattern
from dossier.operators.knowledge import FOREIGN, STOP_TERMS, TERM
from dossier.operators import planning as P
from dossier.plans.catalog import ASKS, KINDS, QUESTION_FIXTURE, WEIGHTS

ORACLES: dict[str, str] = {}


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean(x: str) -> str:
    out = f"regexp_replace(coalesce({x}, ''), '\\x00', ' ', 'g')"
    out = f"regexp_replace({out}, '[ \\t\\r\\f\\x0B]+', ' ', 'g')"
    out = f"regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({out}, '^[\\s\\x{{0B}}\\x{{85}}\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{3000}}]+|[\\s\\x{{0B}}\\x{{85}}\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{3000}}]+$', '', 'g')"


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def any_of(x: str, terms: tuple[str, ...], plural: bool = True) -> str:
    return f"regexp_matches({x}, {lit('|'.join(term_pattern(t, plural) for t in terms))})"


def part_of(x: str, terms: tuple[str, ...]) -> str:
    return f"regexp_matches({x}, {lit('|'.join(re.escape(t) for t in terms))})"


def ratio(x: str, by: str) -> str:
    """Normalised over a window; x is a column."""
    lo, hi = f"min({x}) OVER (PARTITION BY {by})", f"max({x}) OVER (PARTITION BY {by})"
    return f"CASE WHEN abs({hi} - {lo}) <= 1e-9 * greatest(abs({hi}), abs({lo})) THEN CASE WHEN {hi} = 0 THEN 0.0 ELSE 1.0 END ELSE ({x} - {lo}) / ({hi} - {lo}) END"


_LATIN = r"[a-z0-9][a-z0-9_+\-./]{1,}"


def tokens(x: str) -> str:
    found = f"list_filter(list_transform(regexp_extract_all({fold(clean(x))}, '{_LATIN}'), lambda t: regexp_replace(t, '^[._\\-/]+|[._\\-/]+$', '', 'g')), lambda t: t <> '')"
    return f"flatten(list_transform({found}, lambda t: CASE WHEN t[-1] = 's' AND length(t) > 4 THEN [t, t[:-2]] ELSE [t] END))"


DOCS = "docs AS (SELECT doc_id AS node_id, coalesce(text, '') AS text FROM documents)"
ASKED = "asked AS (SELECT item_id AS question_id, coalesce(text, '') AS text FROM benchmark)"
BM25 = f"""{DOCS}, {ASKED},
dt AS (SELECT node_id, {tokens('text')} AS t FROM docs), size AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM dt),
dw AS (SELECT node_id, len(t) AS len, unnest(t) AS term FROM dt), dp AS (SELECT node_id, len, term, count(*) AS tf FROM dw GROUP BY ALL),
di AS (SELECT term, count(*) AS df, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM dp, size GROUP BY term, n),
qw AS (SELECT question_id, unnest({tokens('text')}) AS term FROM asked), qp AS (SELECT question_id, term, count(*) AS qtf FROM qw GROUP BY ALL),
bm25 AS (SELECT question_id, node_id, round(sum(qtf * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean)))), 6) AS score FROM qp JOIN dp USING (term) JOIN di USING (term), size GROUP BY question_id, node_id)"""
_GRAMS = "regexp_replace(lower(" + clean("text") + "), '\\s\\s+', ' ', 'g')"
LEXICAL = f"""dg AS (SELECT node_id, {_GRAMS} AS s FROM docs), qg AS (SELECT question_id, {_GRAMS} AS s FROM asked),
dc AS (SELECT node_id, generate_subscripts(regexp_extract_all(s, '(?s).'), 1) AS i, unnest(regexp_extract_all(s, '(?s).')) AS c FROM dg), qc AS (SELECT question_id, generate_subscripts(regexp_extract_all(s, '(?s).'), 1) AS i, unnest(regexp_extract_all(s, '(?s).')) AS c FROM qg),
dl AS (SELECT node_id, c, lead(c, 1) OVER w AS c1, lead(c, 2) OVER w AS c2, lead(c, 3) OVER w AS c3 FROM dc WINDOW w AS (PARTITION BY node_id ORDER BY i)), ql AS (SELECT question_id, c, lead(c, 1) OVER w AS c1, lead(c, 2) OVER w AS c2, lead(c, 3) OVER w AS c3 FROM qc WINDOW w AS (PARTITION BY question_id ORDER BY i)),
dn AS (SELECT node_id, unnest([c || c1, c || c1 || c2, c || c1 || c2 || c3]) AS term FROM dl), qn AS (SELECT question_id, unnest([c || c1, c || c1 || c2, c || c1 || c2 || c3]) AS term FROM ql),
gp AS (SELECT node_id, term, count(*) AS tf FROM dn WHERE term IS NOT NULL GROUP BY ALL),
gi AS (SELECT term, ln((1.0 + (SELECT count(*) FROM docs)) / (1 + count(*))) + 1 AS idf FROM gp GROUP BY term),
gw AS (SELECT node_id, term, tf * idf AS w FROM gp JOIN gi USING (term)), gl AS (SELECT node_id, sqrt(sum(w * w)) AS norm FROM gw GROUP BY node_id),
hp AS (SELECT question_id, term, count(*) AS tf FROM qn WHERE term IS NOT NULL GROUP BY ALL),
hw AS (SELECT question_id, term, tf * idf AS q FROM hp JOIN gi USING (term)), hl AS (SELECT question_id, sqrt(sum(q * q)) AS norm FROM hw GROUP BY question_id),
lexical AS (SELECT question_id, node_id, round(sum(q * w) / (any_value(gl.norm) * any_value(hl.norm)), 6) AS score FROM hw JOIN gw USING (term) JOIN gl USING (node_id) JOIN hl USING (question_id) GROUP BY question_id, node_id)"""


def vectors(where: str, k: int) -> str:
    return f"""vq AS (SELECT vec_id AS question_id, embedding::DOUBLE[] AS q, label AS want FROM embeddings WHERE {where}), vn AS (SELECT vec_id AS node_id, embedding::DOUBLE[] AS v, label FROM embeddings),
vs AS (SELECT question_id, node_id, want, label, round(greatest(0, list_cosine_similarity(q, v)), 9) AS score FROM vq, vn),
vt AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, node_id) AS rank FROM vs QUALIFY rank <= {k}),
embedding AS (SELECT question_id, node_id, rank, want, label, round(score, 6) AS score FROM vt)"""


def top(name: str, k: int, extra: str = "") -> str:
    return f"SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, node_id) AS rank, node_id, score{extra} FROM {name} QUALIFY rank <= {k}"


ITEMS = "vec_id IN (SELECT item_id FROM benchmark)"
ROUTES = f"""{BM25}, {LEXICAL}, {vectors(ITEMS, 50)},
routes AS (SELECT question_id, 'bm25' AS route, node_id, score FROM ({top('bm25', 50)}) WHERE score > 0 UNION ALL SELECT question_id, 'lexical', node_id, score FROM ({top('lexical', 50)}) WHERE score > 0
  UNION ALL SELECT question_id, 'embedding', node_id, score FROM embedding WHERE score > 0),
weights AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in WEIGHTS.items())}) AS w(route, weight))"""
RRF = f"""{ROUTES},
keys AS (SELECT DISTINCT question_id, node_id FROM routes), names AS (SELECT DISTINCT question_id, route FROM routes),
filled AS (SELECT question_id, route, node_id, coalesce(score, 0) AS score FROM keys JOIN names USING (question_id) LEFT JOIN routes USING (question_id, route, node_id)),
normed AS (SELECT *, {ratio('score', 'question_id, route')} AS s FROM filled),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id, route ORDER BY s DESC, node_id) AS r FROM normed),
raw AS (SELECT question_id, node_id, sum(CASE WHEN s > 0 THEN weight / (60 + r) * (0.5 + 0.5 * s) ELSE 0 END) AS x FROM ranked JOIN weights USING (route) GROUP BY ALL),
rrf AS (SELECT question_id, node_id, round({ratio('x', 'question_id')}, 6) AS score FROM raw)"""
_FINAL = "SELECT question_id, rank, node_id, score FROM "
ORACLES["bm25_tokens"] = f"WITH {DOCS}, t AS (SELECT node_id, {tokens('text')} AS t FROM docs) SELECT node_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, CAST(coalesce(list_sum(list_transform(t, lambda x: length(x))), 0) AS BIGINT) AS chars FROM t"
ORACLES["bm25_idf"] = f"WITH {BM25} SELECT term, df, round(idf, 4) AS idf FROM di"
ORACLES["bm25_topk"] = f"WITH {BM25} {_FINAL} ({top('bm25', 10)})"
ORACLES["tfidf_char_topk"] = f"WITH {DOCS}, {ASKED}, {LEXICAL} {_FINAL} ({top('lexical', 10)})"
ORACLES["embedding_cosine_topk"] = f"WITH {vectors('vec_id % 20 = 0', 10)} SELECT question_id, rank, node_id, score FROM embedding"
ORACLES["hybrid_topk"] = f"""WITH {DOCS}, {ASKED}, {LEXICAL}, {vectors(ITEMS, 50)}, l AS ({top('lexical', 50)}),
b AS (SELECT coalesce(e.question_id, l.question_id) AS question_id, coalesce(e.node_id, l.node_id) AS node_id, coalesce(e.score, 0) AS e, coalesce(l.score, 0) AS l FROM embedding e FULL JOIN l ON e.question_id = l.question_id AND e.node_id = l.node_id),
h AS (SELECT question_id, node_id, round(0.7 * ({ratio('e', 'question_id')}) + 0.3 * ({ratio('l', 'question_id')}), 6) AS score FROM b) {_FINAL} ({top('h', 10)})"""
ORACLES["minmax_norm"] = f"WITH {ROUTES} SELECT question_id, route, node_id, round({ratio('score', 'question_id, route')}, 4) AS score FROM routes"
ORACLES["rrf_fusion"] = f"WITH {RRF} {_FINAL} ({top('rrf', 10)})"
ORACLES["multiroute_fusion"] = f"""WITH {ROUTES}, n AS (SELECT *, {ratio('score', 'question_id, route')} AS s FROM routes),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id, route ORDER BY s DESC, node_id) AS r FROM n QUALIFY r <= 80),
g AS (SELECT question_id, node_id, sum(weight / (50 + r) * (0.35 + 0.65 * s)) AS x, count(*) AS n, list_sort(list(route || ':' || r)) AS names, bool_or(route = 'embedding') AND bool_or(route = 'bm25') AS agree FROM r JOIN weights USING (route) GROUP BY ALL),
b AS (SELECT *, {ratio('x', 'question_id')} + least(0.08, 0.018 * (n - 1)) + CASE WHEN agree THEN 0.018 ELSE 0 END AS y FROM g),
m AS (SELECT question_id, node_id, round({ratio('y', 'question_id')}, 6) AS score, array_to_string(names, '|') AS routes FROM b)
SELECT question_id, rank, node_id, score, routes FROM ({top('m', 10, ', routes')})"""
ORACLES["bm25_anchor"] = f"""WITH {RRF}, b AS (SELECT rrf.question_id, rrf.node_id, rrf.score, coalesce(routes.score, 0) AS b FROM rrf LEFT JOIN routes ON routes.question_id = rrf.question_id AND routes.node_id = rrf.node_id AND route = 'bm25'),
c AS (SELECT question_id, node_id, 0.62 * score + 0.38 * ({ratio('b', 'question_id')}) AS x FROM b), a AS (SELECT question_id, node_id, round({ratio('x', 'question_id')}, 6) AS score FROM c) {_FINAL} ({top('a', 10)})"""
ORACLES["doc_scoped_retrieval"] = f"""WITH {BM25}, p AS (SELECT b.question_id, b.node_id, b.score, d.source = CASE WHEN q.doc_id % 3 = 0 THEN 'absent' ELSE q.source END AS inside FROM bm25 b JOIN documents d ON d.doc_id = b.node_id LEFT JOIN documents q ON q.doc_id = b.question_id),
k AS (SELECT * FROM p QUALIFY coalesce(inside, false) OR NOT bool_or(coalesce(inside, false)) OVER (PARTITION BY question_id)) {_FINAL} ({top('k', 5)})"""

NODES = """ln AS (SELECT doc_id, source AS section, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS content FROM documents WHERE text IS NOT NULL),
lk AS (SELECT *, CASE WHEN line = 0 THEN 'title' WHEN contains(content, '|') THEN 'table' ELSE 'text' END AS node_type, CAST(line // 10 + 1 AS INTEGER) AS page FROM ln),
nodes AS (SELECT CASE node_type WHEN 'title' THEN 'H' WHEN 'table' THEN 'TB' ELSE 'T' END || '_' || doc_id || '_' || page || '_' || (line % 10 + 1) AS node_id, doc_id, page, node_type, section, CAST(line AS INTEGER) AS node_pos, content FROM lk)"""


def preview(x: str, n: int) -> str:
    y = f"regexp_replace({clean(x)}, '[\\s\\x{{0B}}\\x{{85}}\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{3000}}]+', ' ', 'g')"
    return f"CASE WHEN length({y}) <= {n} THEN {y} ELSE substr({y}, 1, {n - 1}) || '...' END"


_BIGRAMS = "CASE WHEN len({0}) < 2 THEN [array_to_string({0}, '')] ELSE list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || {0}[i + 1])) END"
ORACLES["char_jaccard"] = f"""WITH {NODES}, c AS (SELECT node_id, regexp_extract_all(first_value(content) OVER (PARTITION BY doc_id ORDER BY node_pos), '(?s).') AS x, regexp_extract_all(content, '(?s).') AS y FROM nodes),
s AS (SELECT node_id, {_BIGRAMS.format('x')} AS a, {_BIGRAMS.format('y')} AS b FROM c) SELECT node_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 4) AS jaccard FROM s"""
ORACLES["document_nodes_table"] = f"WITH {NODES} SELECT node_id, doc_id, page, node_type, section, node_pos, CAST(length(content) AS INTEGER) AS n_chars FROM nodes"
ORACLES["text_functions"] = f"WITH {NODES} SELECT node_id, md5({clean('content')}) AS clean_md5, {preview('content', 60)} AS preview, len(list_filter(list_transform(string_split_regex(content, '[;；,，|]'), lambda p: {clean('p')}), lambda p: p <> '')) AS parts, contains({clean('content')}, '···') OR regexp_matches({clean('content')}, '\\.{{4,}}\\s*[0-9]+\\s*$') AS toc FROM nodes"
ORACLES["chunk_context"] = f"""WITH {NODES} SELECT node_id, doc_id, CAST(row_number() OVER w AS INTEGER) AS chunk_order, lag(node_id) OVER w AS previous_node_id, lead(node_id) OVER w AS next_node_id, lag({preview('content', 120)}) OVER w AS previous_preview, lead({preview('content', 120)}) OVER w AS next_preview FROM nodes WINDOW w AS (PARTITION BY doc_id ORDER BY node_pos)"""
ORACLES["margin_text"] = f"""WITH {NODES}, k AS (SELECT doc_id, page, substr(regexp_replace(lower(content), '[^0-9a-z一-鿿]+', '', 'g'), 1, 100) AS key FROM nodes), p AS (SELECT doc_id, count(DISTINCT page) AS n FROM nodes GROUP BY doc_id),
s AS (SELECT doc_id, key, count(DISTINCT page) AS pages FROM k WHERE key <> '' GROUP BY ALL) SELECT doc_id, key, pages FROM s JOIN p USING (doc_id) WHERE pages >= greatest(2, ceil(0.25 * n))"""


def _edge(sql: str, kind: str) -> str:
    return f"SELECT a AS source_id, b AS target_id, '{kind}' AS edge_type, {L.EDGE_WEIGHTS[kind]}::DOUBLE AS weight FROM ({sql})"


_EDGES = {
    "same_page": "SELECT x.node_id AS a, y.node_id AS b FROM nodes x JOIN nodes y USING (doc_id, page) WHERE x.node_pos < y.node_pos",
    "belongs_to_page": "SELECT 'P_' || doc_id || '_' || page AS a, node_id AS b FROM nodes",
    "chunk_sequence": "SELECT lag(node_id) OVER (PARTITION BY doc_id ORDER BY node_pos) AS a, node_id AS b FROM nodes QUALIFY a IS NOT NULL",
    "same_section": "SELECT node_id AS a, lead(node_id) OVER (PARTITION BY doc_id, section ORDER BY node_pos) AS b FROM nodes WHERE node_type <> 'title' AND section <> '' QUALIFY b IS NOT NULL",
    "section_title": "SELECT x.node_id AS a, y.node_id AS b FROM (SELECT * FROM nodes WHERE node_type = 'title' AND section <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, section ORDER BY node_pos) <= 2) x JOIN (SELECT * FROM nodes WHERE node_type <> 'title' AND section <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, section ORDER BY node_pos) <= 30) y USING (doc_id, section)",
}
for _k, _sql in _EDGES.items():
    ORACLES[f"edges_{_k}"] = f"WITH {NODES} {_edge(_sql, _k)}"
ALL = f"""{NODES}, every AS ({' UNION ALL '.join(_edge(s, k) for k, s in _EDGES.items())}),
edges AS (SELECT least(source_id, target_id) AS source_id, greatest(source_id, target_id) AS target_id, edge_type, round(sum(weight), 4) AS weight FROM every WHERE source_id <> '' AND target_id <> '' GROUP BY 1, 2, 3),
graph AS (SELECT source_id AS u, target_id AS v, round(sum(greatest(0.01, weight)), 6) AS weight FROM edges WHERE source_id <> target_id GROUP BY ALL),
links AS (SELECT u AS x, v AS y, weight FROM graph UNION ALL SELECT v, u, weight FROM graph)"""
ORACLES["edges_all"] = f"WITH {ALL} SELECT * FROM edges"
ORACLES["graph_degree"] = f"WITH {ALL} SELECT x AS node_id, count(*) AS degree, round(sum(weight), 4) AS strength FROM links GROUP BY x"
ORACLES["chunk_quality"] = f"WITH {NODES} SELECT doc_id, count(*) AS n_nodes, max(page) AS pages, count(*) FILTER (WHERE node_type = 'title') AS n_title, count(*) FILTER (WHERE node_type = 'text') AS n_text, count(*) FILTER (WHERE node_type = 'table') AS n_table, round(avg(length(content)), 4) AS mean_length, quantile_cont(length(content)::DOUBLE, 0.5) AS median_length FROM nodes GROUP BY doc_id"
ORACLES["edges_caption"] = "SELECT * FROM (VALUES ('C_d_1_1', 'F_d_1_2', 'figure_caption', 1.2::DOUBLE), ('C_d_1_4', 'TB_d_1_5', 'table_caption', 1.2), ('C_e_1_1', 'F_e_1_2', 'figure_caption', 1.2)) AS t(source_id, target_id, edge_type, weight)"
_STEPS = "".join(f""", m{i} AS (SELECT s{i - 1}.question_id, l.y AS node_id, sum(score * weight / t) AS got FROM s{i - 1} JOIN l ON l.x = s{i - 1}.node_id GROUP BY ALL),
s{i} AS (SELECT question_id, node_id, seed, linked, 0.85 * (coalesce(got, 0) + lost * seed) + 0.15 * seed AS score FROM (SELECT *, sum(CASE WHEN linked THEN 0 ELSE score END) OVER (PARTITION BY question_id) AS lost FROM s{i - 1}) LEFT JOIN m{i} USING (question_id, node_id))""" for i in range(1, 6))
ORACLES["ppr_5_rounds"] = f"""WITH {ALL}, l AS (SELECT x, y, weight, sum(weight) OVER (PARTITION BY x) AS t, CAST(string_split(x, '_')[2] AS BIGINT) AS question_id FROM links),
a AS (SELECT question_id, x AS node_id FROM l UNION SELECT doc_id, node_id FROM nodes WHERE node_type = 'title'),
s0 AS (SELECT question_id, node_id, CASE WHEN n.node_type = 'title' THEN 1.0 ELSE 0.0 END::DOUBLE AS seed, node_id IN (SELECT x FROM l) AS linked, 1.0::DOUBLE / count(*) OVER (PARTITION BY question_id) AS score FROM a LEFT JOIN nodes n USING (node_id)){_STEPS}
SELECT question_id, node_id, round(score, 5) AS score FROM s5"""


def _count(x: str, terms: tuple[str, ...], whole: bool = True) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches({x}, {lit(term_pattern(t))}) AS INTEGER)" if whole else f"CAST(contains({x}, {lit(t)}) AS INTEGER)" for t in terms) + ")"


_PRODUCTS = tuple(dict.fromkeys([*L.PRODUCT_ALIASES, *(a for g in L.PRODUCT_ALIASES.values() for a in g)]))
UNDERSTOOD = f"""b AS (SELECT *, {fold(clean('question'))} AS q, {fold(clean('question_type'))} AS t, {clean('question')} AS plain FROM s), c AS (SELECT *, trim(t || ' ' || q) AS blob FROM b),
i AS (SELECT *, {any_of('blob', L.TABLE_TERMS)} OR contains(t, 'table') AS wants_table, {any_of('blob', L.FIGURE_TERMS)} OR contains(t, 'image') OR contains(t, 'figure') AS wants_figure, {any_of('blob', L.LOCATION_TERMS)} AS wants_location, {any_of('t', L.TEXT_FACT_TERMS)} AS text_fact FROM c),
j AS (SELECT *, {any_of('blob', L.CROSS_MODAL_TERMS)} OR (wants_table AND wants_figure) AS wants_cross FROM i),
k AS (SELECT *, {any_of('t', L.VISUAL_TYPE_TERMS)} OR wants_table OR wants_figure OR wants_cross OR wants_location AS wants_visual, {part_of('t', L.STRUCTURED_TYPE_TERMS)} OR ({part_of('blob', L.TABLEISH_TERMS)} AND regexp_matches(q, '[$%]|\\b\\d+') AND {part_of('q', L.STRUCTURED_QUERY_TERMS)}) AS structured,
  {_count('q', L.MULTIHOP_QUERY_TERMS, False)} AS hits, len(regexp_extract_all(plain, '\\b[A-Z][A-Za-z0-9&.''-]{{2,}}')) AS names, {any_of('blob', _PRODUCTS, False)} AS has_product, {any_of('blob', L.AFTER_SALES_HINTS)} AS hinted,
  [{', '.join(_count('blob', v) for v in L.AFTER_SALES_TERMS.values())}] AS h FROM j),
l AS (SELECT *, {part_of('t', L.MULTIHOP_TYPE_TERMS)} OR hits >= 2 OR (hits >= 1 AND names >= 2) AS hops, len(list_filter(h, lambda x: x > 0)) AS kinds, list_max(h) AS most, h[6] > 0 OR h[7] > 0 AS generic FROM k),
m AS (SELECT *, CASE WHEN kinds = 0 OR (kinds = 1 AND generic AND NOT (hinted OR has_product)) THEN CASE WHEN hinted THEN 0.45 ELSE 0 END ELSE least(1.0, 0.35 + 0.18 * most) END::DOUBLE AS score FROM l),
und AS (SELECT *, CASE WHEN structured THEN 'structured_table' WHEN hops THEN 'multihop_graph' WHEN score > 0 AND wants_visual THEN 'after_sales_visual' WHEN score > 0 THEN 'after_sales_policy' WHEN wants_cross THEN 'cross_modal' WHEN wants_table OR wants_figure OR wants_location THEN 'visual_grounding' WHEN text_fact THEN 'text_fact' ELSE 'general_text' END AS route, list_position(list_transform(h, lambda x: CASE WHEN x > 0 THEN least(1.0, 0.35 + 0.18 * x) ELSE 0 END), list_max(list_transform(h, lambda x: CASE WHEN x > 0 THEN least(1.0, 0.35 + 0.18 * x) ELSE 0 END))) AS strongest FROM m),
prof AS (SELECT *, CASE WHEN score > 0 THEN CASE WHEN kinds = 0 THEN 'after_sales' WHEN strongest <= 4 AND NOT has_product THEN 'policy' WHEN strongest = 5 THEN 'troubleshooting' WHEN strongest >= 6 THEN CASE WHEN wants_visual THEN 'manual_visual' ELSE 'manual' END ELSE 'after_sales' END
  WHEN structured THEN 'structured_table' WHEN wants_table OR wants_figure OR wants_cross OR wants_location THEN 'visual' WHEN text_fact THEN 'text_fact' ELSE 'general' END AS profile FROM und)"""
ORACLES["question_understanding"] = f"""WITH s AS (SELECT conv_id || '-' || turn AS question_id, text AS question, '' AS question_type FROM conversations WHERE role = 'user' UNION ALL SELECT * FROM (VALUES {QUESTION_FIXTURE}) AS f(question_id, question, question_type)), {UNDERSTOOD}
SELECT question_id, wants_table, wants_figure, wants_cross, wants_location, wants_visual, structured, hops, has_product, round(score, 4) AS sales_score, route FROM und"""

JUDGED = f"""{vectors('vec_id % 20 = 0', 10)}, both_ways AS (SELECT question_id, node_id, 'cosine' AS method, rank, label = want AS relevant, want FROM embedding UNION ALL SELECT question_id, node_id, 'by_id', row_number() OVER (PARTITION BY question_id ORDER BY node_id), label = want, want FROM embedding),
ideal AS (SELECT label AS want, count(*) AS ideal FROM embeddings GROUP BY label),
metrics AS (SELECT question_id, method, {', '.join(f'max(CASE WHEN rank <= {k} AND relevant THEN 1 ELSE 0 END) AS hit_at_{k}' for k in (1, 3, 5, 10))}, round(coalesce(1.0 / min(CASE WHEN relevant THEN rank END), 0), 6)::DOUBLE AS mrr,
  round(sum(CASE WHEN rank <= 5 AND relevant THEN 1 / log2(rank + 1.0) ELSE 0 END) / list_sum(list_transform(range(1, least(max(ideal), 5) + 1), lambda i: 1 / log2(i + 1.0))), 4) AS ndcg_at_5 FROM both_ways JOIN ideal USING (want) GROUP BY question_id, method)"""
ORACLES["embedding_metrics"] = f"WITH {JUDGED} SELECT * FROM metrics"
ORACLES["metrics_summary"] = f"WITH {JUDGED} SELECT method, count(*) AS num_questions, {', '.join(f'round(avg({m}), 4) AS {m}' for m in ('hit_at_1', 'hit_at_3', 'hit_at_5', 'hit_at_10', 'mrr', 'ndcg_at_5'))} FROM metrics GROUP BY method"
ORACLES["method_comparison"] = f"""WITH {JUDGED}, d AS (SELECT a.question_id, round(b.ndcg_at_5 - a.ndcg_at_5, 4) AS delta_ndcg, b.hit_at_5 - a.hit_at_5 AS delta_hit FROM metrics a JOIN metrics b ON a.question_id = b.question_id AND a.method = 'by_id' AND b.method = 'cosine')
SELECT question_id, delta_ndcg, delta_hit, CASE WHEN (delta_ndcg > 0 OR delta_hit > 0) AND NOT (delta_ndcg < 0 OR delta_hit < 0) THEN 'improved' WHEN (delta_ndcg < 0 OR delta_hit < 0) AND NOT (delta_ndcg > 0 OR delta_hit > 0) THEN 'regressed' WHEN delta_ndcg > 0 OR delta_hit > 0 THEN 'mixed' ELSE 'same' END AS status FROM d"""
_KIND = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END"
CHAIN = f"""{BM25}, tk AS ({top('bm25', 6)}), cr AS (SELECT tk.*, {_KIND} AS kind FROM tk JOIN documents d ON d.doc_id = tk.node_id WHERE rank <= 1 + question_id % 6),
cg AS (SELECT question_id, count(*) AS n, list(node_id) AS nodes, list(node_id % 7) AS pages, list(kind) AS kinds, count(*) FILTER (WHERE node_id % 2 = 0) AS grounded, min_by(node_id, rank) AS top FROM cr GROUP BY question_id),
cd AS (SELECT *, CASE question_id % 3 WHEN 0 THEN 'multihop_graph' WHEN 1 THEN 'cross_modal' ELSE 'general_text' END AS route, question_id % 2 = 0 AS visual, CASE WHEN question_id % 4 = 0 THEN [] ELSE list_distinct([top, question_id]) END AS gold FROM cg),
ce AS (SELECT *, CASE WHEN list_contains(pages, question_id % 7) THEN 1.0 ELSE 0.0 END AS page_hit, len(list_intersect(list_distinct(list_filter(kinds, lambda k: k IS NOT NULL)), ['text', 'table'])) / 2.0 AS kind_coverage, CASE WHEN visual THEN CASE WHEN grounded > 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 END AS visual_hit,
  CASE WHEN n > 1 THEN (n // 2) / (n - 1)::DOUBLE ELSE 0 END AS relation_support, CASE WHEN n > 5 THEN 0.75 WHEN n >= 2 THEN 1.0 ELSE 0.55 END AS length,
  CASE WHEN route = 'multihop_graph' THEN CASE WHEN len(list_distinct(nodes)) >= 2 THEN 1.0 ELSE 0.0 END WHEN NOT (visual OR route = 'cross_modal') OR len(list_distinct(kinds)) >= 2 THEN 1.0 ELSE 0.0 END AS cross_hit FROM cd),
cf AS (SELECT *, CASE WHEN len(gold) > 0 THEN len(list_intersect(list_distinct(nodes), gold)) / len(gold)::DOUBLE ELSE page_hit END AS node_coverage FROM ce),
cm AS (SELECT question_id, route, CAST(n AS INTEGER) AS step_count, {', '.join(f'round({c}, 4)::DOUBLE AS {c}' for c in ('node_coverage', 'page_hit', 'kind_coverage', 'visual_hit', 'cross_hit', 'relation_support'))},
  round(0.38 * node_coverage + 0.14 * page_hit + 0.16 * kind_coverage + 0.14 * visual_hit + 0.10 * cross_hit + 0.05 * relation_support + 0.03 * length, 4)::DOUBLE AS chain_score FROM cf)"""
ORACLES["chain_metrics"] = f"WITH {CHAIN} SELECT * FROM cm"
ORACLES["chain_summary"] = f"WITH {CHAIN} SELECT coalesce(route, 'all') AS route, count(*) AS num_questions, round(avg(step_count), 4) AS avg_steps, {', '.join(f'round(avg({m}), 3) AS {m}' for m in ('node_coverage', 'page_hit', 'kind_coverage', 'visual_hit', 'cross_hit', 'relation_support', 'chain_score'))} FROM cm GROUP BY ROLLUP (route)"

ANSWERS = f"""ar AS (SELECT conv_id, role, text AS answer, coalesce(lag(text) OVER w, '') AS question, first_value(text) OVER w AS evidence, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
answers AS (SELECT conv_id || '-' || n AS answer_id, question, answer, evidence FROM ar WHERE role = 'assistant')"""
ORACLES["answer_overlap"] = f"""WITH {ANSWERS}, w AS (SELECT answer_id, list_distinct(regexp_extract_all(lower({clean('question')}), '[a-z0-9]{{2,}}')) AS q, list_distinct(regexp_extract_all(lower({clean('answer')}), '[a-z0-9]{{2,}}')) AS a FROM answers)
SELECT answer_id, round(CASE WHEN len(q) > 0 THEN 0.65 * len(list_intersect(q, a)) / len(q) ELSE 0 END, 4)::DOUBLE AS overlap FROM w"""


def _terms(x: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all({fold(clean(x))}, '[a-zA-Z][a-zA-Z0-9_\\-/]{{2,}}|\\d+(?:\\.\\d+)?%?')), lambda t: NOT list_contains([{', '.join(map(lit, L.ANSWER_STOPWORDS))}], t))"


SUPPORT = f"""{ANSWERS}, sp AS (SELECT answer_id, question, evidence, list_filter(list_transform(string_split_regex(regexp_replace({clean('answer')}, '([。！？!?；;])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda s: trim(s)), lambda s: s <> '') AS s FROM answers),
su AS (SELECT answer_id, {_terms('question')} AS q, {_terms('evidence')} AS e, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence FROM sp),
st AS (SELECT *, {_terms('sentence')} AS t FROM su), sc AS (SELECT *, CASE WHEN len(list_filter(t, lambda x: NOT list_contains(q, x))) > 0 THEN list_filter(t, lambda x: NOT list_contains(q, x)) ELSE t END AS claim FROM st),
support AS (SELECT answer_id, CAST(pos AS INTEGER) AS pos, sentence, round(CASE WHEN len(t) = 0 THEN 1 ELSE least(1, len(list_intersect(claim, e)) / greatest(1, pow(len(claim), 0.72))) END, 4)::DOUBLE AS support, CAST(len(t) AS INTEGER) AS n_terms FROM sc)"""
ORACLES["answer_support"] = f"WITH {SUPPORT} SELECT answer_id, pos, support, n_terms FROM support"
ORACLES["answer_corrected"] = f"""WITH {SUPPORT}, k AS (SELECT *, support >= 0.18 OR (regexp_matches(sentence, '\\[E\\d+\\]|<PIC') AND support >= 0.08) OR n_terms <= 4 AS keep FROM support),
g AS (SELECT answer_id, coalesce(string_agg(sentence, ' ' ORDER BY pos) FILTER (WHERE keep), '') AS kept, count(*) FILTER (WHERE NOT keep) AS n FROM k GROUP BY answer_id),
o AS (SELECT answer_id, {clean('answer')} AS original, {clean('kept')} AS kept, n FROM answers JOIN g USING (answer_id)), s AS (SELECT *, length(kept) < greatest(24, floor(length(original) * 0.45)) AS short FROM o)
SELECT answer_id, md5(CASE WHEN short THEN original ELSE kept END) AS answer_md5, CASE WHEN short THEN 'kept_original_low_support' WHEN n > 0 THEN 'corrected' ELSE 'verified' END AS status, CASE WHEN short THEN 0 ELSE n END AS removed FROM s"""

TABLES = r"""tl AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS content FROM documents WHERE contains(text, '|')),
tb AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS block FROM tl WHERE length(content) - length(replace(content, '|', '')) >= 2),
ts AS (SELECT *, count(*) OVER (PARTITION BY doc_id, block) AS size FROM tb), tc AS (SELECT * FROM ts WHERE size >= 2),
tf AS (SELECT * FROM tc JOIN (SELECT doc_id, block FROM tc GROUP BY doc_id, block, size QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, block) = 1) USING (doc_id, block)),
tx AS (SELECT doc_id, line, list_transform(string_split(regexp_replace(trim(content), '^\||\|$', '', 'g'), '|'), lambda c: regexp_replace(trim(c), '[ \t]+', ' ', 'g')) AS cells FROM tf),
tr AS (SELECT doc_id, cells, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS row FROM tx WHERE len(list_filter(cells, lambda c: c <> '')) > 0 AND len(list_filter(cells, lambda c: c <> '' AND NOT regexp_matches(replace(c, ' ', ''), '^:?-{2,}:?$'))) > 0)"""
ORACLES["table_shapes"] = f"WITH {TABLES} SELECT doc_id, count(*) - 1 AS n_rows, max(len(cells)) AS n_columns, array_to_string(list_filter(min_by(cells, row), lambda c: c <> ''), '; ') AS headers FROM tr GROUP BY doc_id HAVING count(*) >= 2"
ORACLES["table_numeric_facts"] = f"""WITH {TABLES}, h AS (SELECT doc_id, generate_subscripts(cells, 1) - 1 AS col, unnest(cells) AS header FROM tr WHERE row = 1), c AS (SELECT doc_id, row, cells[1] AS label, generate_subscripts(cells, 1) - 1 AS col, unnest(cells) AS cell FROM tr WHERE row > 1),
v AS (SELECT *, TRY_CAST(nullif(regexp_extract(replace(cell, ',', ''), '([-+]?[0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) AS v FROM c)
SELECT doc_id, col, header, min(v) AS low, min_by(label, (v, row)) AS low_row, max(v) AS high, max_by(label, (v, -row)) AS high_row FROM v JOIN h USING (doc_id, col) WHERE v IS NOT NULL GROUP BY doc_id, col, header HAVING count(*) >= 2"""

KG = f"""{NODES}, kf AS (SELECT node_id, doc_id, section, regexp_extract_all(regexp_replace({clean('content')}, '{FOREIGN}', '§', 'g'), '{TERM}') AS t FROM nodes),
ku AS (SELECT node_id, doc_id, section, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS term FROM kf),
kc AS (SELECT node_id, doc_id, section, term, count(*) * CASE WHEN regexp_matches(term, '[A-Z]') THEN 2 ELSE 1 END AS n, min(pos) AS pos FROM ku WHERE lower(term) NOT IN ({', '.join(map(lit, STOP_TERMS))}) AND length(term) >= 3 GROUP BY node_id, doc_id, section, term),
terms AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY n DESC, length(term) DESC, pos) AS place FROM kc QUALIFY place <= 12)"""
ORACLES["entity_terms"] = f"WITH {KG} SELECT node_id, term, n, place FROM terms"
ORACLES["entities"] = f"""WITH {KG}, r AS (SELECT 'part:' || lower(term) AS entity_id, 'part' AS entity_type, node_id, doc_id FROM terms UNION ALL SELECT DISTINCT 'part:' || lower(section), 'part', node_id, doc_id FROM terms WHERE section <> '' UNION ALL SELECT DISTINCT 'product:' || doc_id, 'product', node_id, doc_id FROM terms)
SELECT entity_id, entity_type, count(DISTINCT node_id) AS n_nodes, count(DISTINCT doc_id) AS n_docs, count(*) AS evidence_count FROM r GROUP BY ALL"""
ORACLES["relations"] = f"""WITH {KG}, r AS (SELECT 'product:' || doc_id AS source_id, 'part:' || lower(term) AS target_id, 'product_has_part' AS relation_type, 0.25 AS weight FROM terms UNION ALL SELECT 'part:' || lower(section), 'part:' || lower(term), 'product_has_part', 0.35 FROM terms WHERE section <> ''
  UNION ALL SELECT 'part:' || lower(a.term), 'part:' || lower(b.term), 'concept_cooccurs', 0.08 FROM terms a JOIN terms b ON a.node_id = b.node_id AND a.place < b.place AND b.place <= 6)
SELECT source_id, target_id, relation_type, round(sum(weight), 2)::DOUBLE AS weight, count(*) AS n FROM r WHERE source_id <> target_id GROUP BY ALL"""
ORACLES["communities"] = f"""WITH {KG}, n AS (SELECT *, CASE WHEN section <> '' THEN section ELSE 'page:' || page END AS label FROM nodes), o AS (SELECT doc_id, label, count(*) AS node_count, count(DISTINCT page) AS pages, count(*) FILTER (WHERE node_type = 'table') AS n_tables FROM n GROUP BY ALL),
s AS (SELECT n.doc_id, n.label, term, count(*) AS c FROM terms JOIN n USING (node_id) WHERE place <= 8 GROUP BY ALL), t AS (SELECT doc_id, label, string_agg(term, '|' ORDER BY c DESC, term) AS top_terms FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, label ORDER BY c DESC, term) <= 10) GROUP BY ALL)
SELECT doc_id, label, node_count, pages, n_tables, coalesce(top_terms, '') AS top_terms FROM o LEFT JOIN t USING (doc_id, label)"""

def _weights(d: dict[str, float], x: str, default: float) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in d.items()) + f" ELSE {default}::DOUBLE END"


ORACLES["answer_priors"] = f"""WITH {NODES} SELECT node_id, round(CASE node_type WHEN 'title' THEN 0.72 WHEN 'text' THEN 1.08 ELSE (CASE WHEN doc_id % 3 = 0 THEN 1.08 WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 7 = 0 THEN 1.02 ELSE 0.92 END ELSE 0.72 END) * CASE WHEN doc_id % 5 = 0 THEN 0.55 ELSE 1 END END, 4)::DOUBLE AS prior FROM nodes"""
ORACLES["layout_reading_order"] = f"""WITH {NODES}, b AS (SELECT doc_id, page, node_id AS block_id, node_pos % 10 AS i, length(trim(content)) >= 20 AS ok FROM nodes), k AS (SELECT *, i % 5 = 4 AS wide FROM b),
c AS (SELECT doc_id, page, count(*) FILTER (WHERE ok AND NOT wide AND i % 2 = 0) AS l, count(*) FILTER (WHERE ok AND NOT wide AND i % 2 = 1) AS r FROM k GROUP BY ALL), d AS (SELECT k.*, l + r >= 8 AND l >= 3 AND r >= 3 AS two FROM k JOIN c USING (doc_id, page)),
e AS (SELECT *, CASE WHEN NOT two THEN 'single' WHEN wide THEN 'full' WHEN i % 2 = 0 THEN 'left' ELSE 'right' END AS layout_column, CASE WHEN NOT two THEN 0 ELSE CASE WHEN wide THEN 2 * (i // 5) + 1 ELSE 2 * (i // 5) END END AS band FROM d)
SELECT doc_id, page, block_id, layout_column, row_number() OVER (PARTITION BY doc_id, page ORDER BY band, layout_column = 'right', i) AS reading_order FROM e"""
ORACLES["ragbench_gold"] = "SELECT * FROM (VALUES (1::BIGINT, '0;2'), (2, '0;1'), (3, '1')) AS t(id, gold)"


def _plus(cond: str, x: float) -> str:
    return f"CASE WHEN {cond} THEN {x}::DOUBLE ELSE 0 END"


_FLAGS = {"wants_table": "doc_id % 2", "wants_figure": "doc_id % 3", "wants_cross": "doc_id % 5", "wants_location": "doc_id % 7", "wants_visual": "doc_id % 4", "structured": "doc_id % 11", "numeric": "doc_id % 13", "bbox": "node_pos % 2", "captioned": "node_pos % 3", "section_hit": "node_pos % 5", "has_headers": "node_pos % 4", "has_facts": "node_pos % 6", "has_numbers": "node_pos % 7", "page_image": "node_pos % 8", "crop_image": "node_pos % 9", "parsed": "node_pos % 10"}
ORACLES["route_scores"] = f"""WITH {NODES}, c AS (SELECT doc_id, node_id, node_type, node_pos, regexp_extract_all(first_value(content) OVER (PARTITION BY doc_id ORDER BY node_pos), '(?s).') AS x, regexp_extract_all(content, '(?s).') AS y FROM nodes),
s AS (SELECT *, {_BIGRAMS.format('x')} AS a, {_BIGRAMS.format('y')} AS b FROM c), f AS (SELECT doc_id AS question_id, node_id, node_type, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS l, {', '.join(f'{v} = 0 AS {k}' for k, v in _FLAGS.items())} FROM s),
r AS (SELECT question_id, node_id, 'lexical' AS route, l AS score FROM f UNION ALL SELECT question_id, node_id, 'section', l + {_plus("node_type = 'title'", 0.08)} + {_plus('section_hit', 0.12)} FROM f
  UNION ALL SELECT question_id, node_id, 'visual', CASE WHEN wants_visual THEN l + {_plus("wants_table AND node_type = 'table'", 0.35)} + {_plus("wants_figure AND node_type IN ('figure', 'caption')", 0.35)} + {_plus("node_type IN ('table', 'figure', 'caption')", 0.15)} + {_plus('bbox', 0.05)} + {_plus('captioned', 0.08)} ELSE 0 END FROM f
  UNION ALL SELECT question_id, node_id, 'table', CASE WHEN NOT (structured OR wants_table OR wants_cross) THEN 0 WHEN node_type = 'table' THEN l + 0.32::DOUBLE + {_plus('has_headers', 0.1)} + {_plus('has_facts', 0.1)} + {_plus('numeric AND has_numbers', 0.12)} + {_plus('structured', 0.12)} WHEN node_type = 'text' THEN 0.58::DOUBLE * l ELSE l END FROM f
  UNION ALL SELECT question_id, node_id, 'layout', CASE WHEN wants_location THEN {_plus('bbox', 0.35)} + {_plus('page_image', 0.15)} + {_plus('crop_image', 0.2)} + {_plus('parsed', 0.1)} ELSE 0 END FROM f)
SELECT question_id, route, node_id, round(score, 8) AS score FROM r QUALIFY max(r.score) OVER (PARTITION BY question_id, route) > 0"""


def _count_words(words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}" for w in words) + ")::INTEGER"


ORACLES["domain_scores"] = f"""WITH d AS (SELECT doc_id AS id, lower(coalesce(text, '')) AS t FROM documents), k AS (SELECT id, {_count_words(('the', 'and'))} AS k_a, {_count_words(('der', 'und'))} AS k_b, {_count_words(('les', 'que'))} AS k_c, {_count_words(('that',))} AS s_a, {_count_words(('nicht',))} AS s_b, {_count_words(('pour',))} AS s_c FROM d),
r AS (SELECT *, list_sort([(-k_a, 'a', s_a), (-k_b, 'b', s_b), (-k_c, 'c', s_c)]) AS r FROM k)
SELECT id, k_a, k_b, k_c, CASE WHEN -r[1][1] < 2 OR r[1][3] = 0 OR (r[2][1] < 0 AND -r[1][1] < -1.15 * r[2][1] AND r[1][3] <= r[2][3]) THEN 'general' ELSE r[1][2] END AS domain FROM r"""
ORACLES["corpus_index"] = f"WITH {NODES}, n AS (SELECT doc_id, max(page) AS pages, count(*) FILTER (WHERE node_type = 'title') AS title, count(*) FILTER (WHERE node_type = 'text') AS text, count(*) FILTER (WHERE node_type = 'table') AS tab FROM nodes GROUP BY doc_id), q AS (SELECT item_id, count(*) AS questions FROM benchmark GROUP BY item_id) SELECT coalesce(doc_id, item_id) AS doc_id, coalesce(pages, 0) AS pages, coalesce(title, 0) AS title, coalesce(text, 0) AS text, coalesce(tab, 0) AS \"table\", coalesce(questions, 0) AS questions FROM n FULL JOIN q ON doc_id = item_id"
ORACLES["edges_text_ref"] = "SELECT * FROM (VALUES ('C_d_1_1', 'C_d_1_1', 'text_ref_figure', 1.0::DOUBLE), ('C_d_1_4', 'C_d_1_4', 'text_ref_table', 1.0), ('C_d_1_4', 'TB_d_1_5', 'text_ref_table', 1.0), ('C_d_1_4', 'T_d_1_6', 'text_ref_table', 1.0), ('TB_d_1_5', 'T_d_1_6', 'text_ref_table', 1.0), ('C_d_1_1', 'T_d_1_6', 'text_ref_figure', 1.0), ('C_e_1_1', 'C_e_1_1', 'text_ref_figure', 1.0), ('C_e_1_1', 'F_e_1_2', 'text_ref_figure', 1.0)) AS t(source_id, target_id, edge_type, weight)"


def _verified(name: str) -> str:
    """CTEs that end in v_name: question_id, score, flags and the steps' ids and kinds."""
    has = lambda *k: f"list_has_any(kinds, [{', '.join(map(lit, k))}])"
    table, figure, text = has("table"), has("figure", "caption"), has("text")
    pairs = (("wt", table), ("wf", f"({figure} AND ok)"), ("wc", f"({text} AND ({table} OR {figure}) AND (NOT wf OR ok))"), ("NOT (wt OR wf OR wc)", text))
    need = " + ".join(f"({w})::INTEGER" for w, _ in pairs)
    met = " + ".join(f"(({w}) AND {s})::INTEGER" for w, s in pairs)
    flags = (("no_ranking", "n_rows = 0"), ("no_chain", "n_steps = 0"), ("missing_table", f"wt AND NOT {table}"), ("missing_figure", f"wf AND NOT {figure}"), ("ungrounded_figure", f"wf AND {figure} AND NOT ok"), ("missing_cross_modal_pair", f"wc AND NOT ({text} AND ({table} OR {figure}))"), ("visual_top1_for_text_query", "NOT (wt OR wf OR wc) AND top_kind IN ('table', 'figure', 'caption')"), ("low_semantic_confidence", "semantic < 0.42"), ("requirement_not_satisfied", "required < 1"))
    return f"""t_{name} AS (SELECT t.*, {_KIND} AS kind FROM ({top(name, 5)}) t JOIN documents d ON d.doc_id = t.node_id), n_{name} AS (SELECT *, {ratio('score', 'question_id')} AS s FROM t_{name}),
g_{name} AS (SELECT question_id, list_distinct(list(kind)) AS kinds, min_by(kind, rank) AS top_kind, count(*) AS n_rows, max(s) AS sim, max(CASE WHEN rank = 1 THEN s END) - coalesce(max(CASE WHEN rank = 2 THEN s END), 0) AS margin, list(node_id ORDER BY rank) AS ids, list(kind ORDER BY rank) AS ks FROM n_{name} GROUP BY question_id),
h_{name} AS (SELECT *, question_id % 3 = 0 AS wt, question_id % 5 = 0 AS wf, question_id % 7 = 0 AS wc, question_id % 2 = 0 AS ok, question_id % 6 AS n_steps, (question_id % 6) // 2 AS n_related, greatest(0, least(1, 0.55 * sim + 0.25 * ((question_id % 10) / 10.0) + 0.1))::DOUBLE AS semantic FROM g_{name}),
j_{name} AS (SELECT *, ({met})::DOUBLE / greatest(1, {need}) AS required FROM h_{name}),
v_{name} AS (SELECT question_id, ids, ks, round(0.34 * required + 0.22 * semantic + 0.14 * CASE WHEN n_steps > 0 THEN least(1, n_steps / 4.0) ELSE least(0.5, least(n_rows, 5) / 10.0) END + 0.10 * CASE WHEN n_steps > 1 THEN n_related / (n_steps - 1.0) ELSE 0 END
  + 0.08 * CASE WHEN wt AND top_kind = 'table' THEN 1 WHEN wf AND top_kind IN ('figure', 'caption') THEN 1 WHEN NOT (wt OR wf OR wc) AND top_kind = 'text' THEN 1 WHEN top_kind = 'text' THEN 0.65 WHEN wt OR wf OR wc THEN 0.72 ELSE 0 END
  + 0.07 * least(1, (question_id % 4) / 5.0) + 0.05 * CASE WHEN n_rows >= 2 THEN greatest(0, least(1, margin * 3)) WHEN n_rows = 1 THEN 0.2 ELSE 0 END, 6)::DOUBLE AS score,
  list_filter([{', '.join(f"CASE WHEN {c} THEN '{f}' END" for f, c in flags)}], lambda x: x IS NOT NULL) AS flags FROM j_{name})"""


_SEVERE = "[" + ", ".join(map(lit, ("no_ranking", "no_chain", "missing_table", "missing_figure", "ungrounded_figure", "missing_cross_modal_pair", "visual_top1_for_text_query"))) + "]"
DECISIONS = f"""{BM25}, {LEXICAL}, {_verified('bm25')}, {_verified('lexical')},
pf AS (SELECT p.question_id, p.score AS p, f.score AS f, p.flags AS pf, f.flags AS ff, p.ids AS pi, f.ids AS fi, f.ks AS fk, len(list_intersect(p.flags, {_SEVERE})) AS pb, len(list_intersect(f.flags, {_SEVERE})) AS fb FROM v_bm25 p JOIN v_lexical f USING (question_id)),
dc_ AS (SELECT *, CASE WHEN list_contains(pf, 'visual_top1_for_text_query') AND fb = 0 AND f >= p - 0.02 THEN 'fallback' WHEN p < 0.52 AND pb > 0 AND fb < pb AND f >= p + 0.06 THEN 'fallback' WHEN pb > 0 AND fb < pb AND f >= p - 0.04 THEN 'merge' WHEN p < 0.50 AND f >= p + 0.02 THEN 'fallback' ELSE 'primary' END AS source FROM pf)"""
ORACLES["verifier_decision"] = f"WITH {DECISIONS} SELECT question_id, p AS p_score, f AS f_score, array_to_string(pf, ';') AS p_flags, array_to_string(ff, ';') AS f_flags, source FROM dc_"
ORACLES["chain_merge"] = f"""WITH {DECISIONS}, nd AS (SELECT *, CASE WHEN list_contains(pf, 'missing_table') THEN ['table'] ELSE ['figure', 'caption'] END AS need FROM dc_),
ad AS (SELECT *, list_filter(list_transform(range(1, len(fi) + 1), lambda i: CASE WHEN list_contains(need, fk[i]) AND NOT list_contains(pi, fi[i]) THEN fi[i] END), lambda x: x IS NOT NULL)[1:2] AS a FROM nd)
SELECT question_id, array_to_string(list_concat(pi[1:greatest(1, 5 - len(a))], a), ';') AS nodes FROM ad"""

ORACLES["multihop_gold"] = r"""WITH p AS (SELECT page_id, url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages), u AS (SELECT url, min(page_id) AS id FROM p WHERE url <> '' GROUP BY url), t AS (SELECT title, min(page_id) AS id FROM p WHERE title <> '' GROUP BY title),
e AS (SELECT page_id % 40 AS question_id, page_id AS pos, coalesce(CASE WHEN page_id % 2 = 0 THEN u.id END, t.id) AS node FROM p LEFT JOIN u USING (url) LEFT JOIN t USING (title)),
g AS (SELECT question_id, node, min(pos) AS pos FROM e WHERE node IS NOT NULL GROUP BY ALL) SELECT item_id AS question_id, coalesce(string_agg(node, ';' ORDER BY pos), '') AS gold FROM benchmark LEFT JOIN g ON question_id = item_id GROUP BY item_id"""
ORACLES["qrels_gold"] = "SELECT quality::BIGINT AS question_id, string_agg(DISTINCT doc_id, ';' ORDER BY doc_id) AS gold FROM labels WHERE toxic > 0 AND doc_id IN (SELECT doc_id FROM documents) GROUP BY quality"
ORACLES["variant_transform"] = f"WITH {NODES} SELECT node_id, 'text' AS node_type, CAST(length(content) AS INTEGER) AS n_chars, true AS stripped FROM nodes"
ORACLES["ablation_deltas"] = f"WITH {JUDGED}, s AS (SELECT method, round(avg(hit_at_1), 4) AS h, round(avg(mrr), 4) AS m, round(avg(ndcg_at_5), 4) AS n FROM metrics GROUP BY method) SELECT s.method, round(s.h - b.h, 4) AS delta_hit_at_1, round(s.m - b.m, 4) AS delta_mrr, round(s.n - b.n, 4) AS delta_ndcg_at_5 FROM s, s b WHERE b.method = 'by_id'"
_RANKED = ORACLES["multiroute_fusion"][len("WITH "):ORACLES["multiroute_fusion"].rindex("\nSELECT question_id, rank")]
_TOP = f"ranked10 AS ({top('m', 10, ', routes')}), each AS (SELECT question_id, node_id, list_transform(string_split(routes, '|'), lambda r: string_split(r, ':')[1]) AS r FROM ranked10)"
ORACLES["route_stats"] = f"WITH {_RANKED}, {_TOP}, x AS (SELECT unnest(r) AS route FROM each) SELECT route, count(*) AS n, round(count(*) / (SELECT count(*) FROM each)::DOUBLE, 4) AS share FROM x GROUP BY route"
ORACLES["route_combinations"] = f"WITH {_RANKED}, {_TOP} SELECT array_to_string(r, '+') AS combination, count(*) AS n FROM each GROUP BY r ORDER BY n DESC, combination LIMIT 20"
ORACLES["table_text_smoothing"] = f"""WITH r AS (SELECT source AS question_id, doc_id, doc_id || '_table' AS node_id, (n_chars % 97)::DOUBLE AS score FROM documents WHERE doc_id IS NOT NULL UNION ALL SELECT source, doc_id, doc_id || '_text', (n_chars % 53)::DOUBLE FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT *, {ratio('score', 'question_id')} AS s FROM r), d AS (SELECT *, greatest(s, 0.72::DOUBLE * s + 0.28::DOUBLE * max(s.s) OVER (PARTITION BY question_id, doc_id)) AS d FROM s) SELECT question_id, node_id, round({ratio('d', 'question_id')}, 4)::DOUBLE AS score FROM d"""
ORACLES["node_index"] = f"WITH {ALL}, g AS (SELECT x AS node_id, count(*) AS degree FROM links GROUP BY x), {KG[len(NODES) + 2:]}, t AS (SELECT node_id, count(*) AS terms FROM terms GROUP BY node_id) SELECT node_id, doc_id, page, node_type, CASE WHEN section <> '' THEN section ELSE 'page:' || page END AS label, coalesce(degree, 0) AS degree, coalesce(terms, 0) AS terms FROM nodes LEFT JOIN g USING (node_id) LEFT JOIN t USING (node_id)"


# Plans of questions, and the signals of the default ranker.


def _case(d: dict[str, object], key: str, other: object) -> str:
    show = lambda v: lit(v) if isinstance(v, str) and not v.startswith("CASE") else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {show(v)}" for k, v in d.items()) + f" ELSE {show(other)} END" if d else show(other)


_NO = r"([Ss]?\d+(?:[.\-]\d+)?[A-Za-z]?)"


def refs(x: str) -> str:
    mended = f"regexp_replace(regexp_replace({clean(x)}, '(?i)F\\s*i\\s*g\\s*u\\s*r\\s*e', 'Figure', 'g'), '(?i)T\\s*a\\s*b\\s*l\\s*e', 'Table', 'g')"
    each = [f"list_transform(regexp_extract_all({mended}, '{p}', 1), lambda r: '{k}:' || regexp_extract(lower(r), '^(s?\\d+)', 1))" for p, k in ((rf"(?i)\b(?:fig\.?|figure)\s*{_NO}", "figure"), (rf"(?i)\btable\s*{_NO}", "table"), (rf"[图圖]\s*{_NO}", "figure"), (rf"表\s*{_NO}", "table"))]
    return f"list_sort(list_distinct(flatten([{', '.join(each)}])))"


DOC_ASKS = f"dq AS (SELECT doc_id AS question_id, rtrim(content || CASE WHEN a = '' THEN '' ELSE ' ' || a END, chr(0)) || CASE WHEN a = '' THEN ' ' ELSE '' END AS question, '' AS question_type, content AS title FROM (SELECT *, ([{', '.join(map(lit, ASKS))}])[doc_id % {len(ASKS)} + 1] AS a FROM nodes WHERE node_pos = 0))"
SAID = f"""{NODES}, {DOC_ASKS}, s AS (SELECT DISTINCT conv_id || '-' || turn AS question_id, coalesce(text, '') AS question, '' AS question_type FROM conversations WHERE role = 'user' UNION ALL SELECT * FROM (VALUES {QUESTION_FIXTURE}) AS f(question_id, question, question_type)
  UNION ALL SELECT 'd' || question_id, question, question_type FROM dq)"""
ORACLES["document_refs"] = f"""WITH {NODES}, {DOC_ASKS}, r AS (SELECT * FROM (VALUES (-1::BIGINT, 'See Figure 2 and fig. 3b'), (-2, 'F i g u r e 12 beside T a b l e S1'), (-3, '如图 4 和表2所示'), (-4, 'Table of contents'), (-5, 'Tables and figures'), (-6, '')) AS t(id, s) UNION ALL SELECT question_id, question FROM dq)
SELECT id, array_to_string({refs('s')}, ';') AS refs FROM r"""

_AFTER = "starts_with(route, 'after_sales')"
_X = {r: _case({k: m[r] for k, m in P.MULTIPLIERS.items() if r in m}, "route", 1.0) for r in P.ROUTES}
_X["reference"] = "CASE WHEN has_refs THEN greatest(1.35, CASE route WHEN 'visual_grounding' THEN 1.18 WHEN 'cross_modal' THEN 1.2 WHEN 'multihop_graph' THEN 1.15 ELSE 1 END) WHEN route = 'cross_modal' THEN 1.05 ELSE 1 END"
_X["table_structure"] = f"CASE WHEN route = 'visual_grounding' THEN CASE WHEN wants_table THEN 1.22 ELSE 0.76 END ELSE {_X['table_structure']} END"
_X["kg"] = f"CASE route WHEN 'cross_modal' THEN 0.9 WHEN 'multihop_graph' THEN 1.05 ELSE {_X['kg']} END"
_X["product"] = f"CASE WHEN {_AFTER} THEN CASE WHEN has_product THEN 1.2 ELSE 0.85 END ELSE 1 END"
_X["visual"] = f"CASE WHEN {_AFTER} THEN CASE WHEN wants_visual THEN 1.2 ELSE 0.62 END ELSE {_X['visual']} END"
_X["layout"] = f"CASE WHEN wants_location THEN greatest(1.35, {_X['layout']}) ELSE {_X['layout']} END"
_NEEDS = "list_concat(['cite_evidence'], CASE route " + " ".join(f"WHEN '{k}' THEN [{', '.join(map(lit, v))}]" for k, v in P.REQUIREMENTS.items()) + " ELSE [] END, CASE WHEN wants_visual THEN ['verify_visual_support'] ELSE [] END)"
_MODES = "list_concat(['text'], CASE WHEN wants_table OR wants_cross OR route = 'structured_table' THEN ['table'] ELSE [] END, CASE WHEN wants_figure OR wants_location OR wants_cross THEN ['figure', 'caption'] ELSE [] END)"
PLAN = f"""{UNDERSTOOD},
pl AS (SELECT *, len({refs('question')}) > 0 AS has_refs, {_case(P.STRATEGY, 'route', 'balanced')} AS strategy, {_MODES} AS modes, {_NEEDS} AS needs FROM prof),
plan AS (SELECT *, has_refs OR route IN ('visual_grounding', 'cross_modal', 'multihop_graph') OR ({_AFTER} AND wants_visual) AS context_expansion, route <> 'text_fact' AS rerank_boost, route IN ('cross_modal', 'multihop_graph') AS graph_boost, {', '.join(f'({c})::DOUBLE AS x_{r}' for r, c in _X.items())} FROM pl)"""
ORACLES["query_plan"] = f"WITH {SAID}, {PLAN} SELECT question_id, route, profile, has_refs, context_expansion, rerank_boost, graph_boost, 'route=' || route || ';strategy=' || strategy || ';modalities=' || array_to_string(modes, ',') || ';answer=' || array_to_string(needs, ',') AS summary, {', '.join(f'round(x_{r}, 4) AS x_{r}' for r in P.ROUTES)} FROM plan"

_LOOKS, _LOOSE = "profile = 'visual'", "NOT structured"
_W0 = {r: _case({p: d[r] for p, d in P.PROFILE_WEIGHTS.items() if r in d}, "profile", v) for r, v in {**P.WEIGHTS, "product": "CASE WHEN has_product THEN 0.8 ELSE 0 END", "kg": 0.0, "reference": "CASE WHEN has_refs THEN 0.95 ELSE 0.35 END"}.items()}
_MANUAL = "profile IN ('manual', 'troubleshooting')"
_W1 = {
    "lexical": "lexical", "embedding": "CASE WHEN profile = 'text_fact' THEN least(embedding, 0.62) ELSE embedding END", "kg": "0", "bm25": "CASE WHEN profile = 'text_fact' THEN greatest(bm25, 1.85) ELSE bm25 END",
    "product": f"CASE WHEN {_MANUAL} THEN greatest(product, CASE WHEN has_product THEN 0.55 ELSE 0.18 END) ELSE product END",
    "section": f"CASE WHEN wants_cross AND {_LOOSE} THEN greatest(section, 0.62) ELSE section END",
    "reference": f"greatest(CASE profile WHEN 'structured_table' THEN CASE WHEN has_refs THEN 0.3 ELSE 0.12 END WHEN 'manual_visual' THEN greatest(reference, 0.65) WHEN 'visual' THEN greatest(reference, 0.9) ELSE reference END, CASE WHEN (wants_table OR wants_figure) AND {_LOOSE} THEN 0.8 ELSE 0 END)",
    "visual": f"least(greatest(CASE WHEN {_MANUAL} THEN greatest(visual, 0.28) ELSE visual END * CASE WHEN profile = 'text_fact' THEN 0.25 ELSE 1 END, CASE WHEN (wants_table OR wants_figure) AND {_LOOSE} THEN 0.62 ELSE 0 END, CASE WHEN wants_cross AND {_LOOSE} THEN 0.55 ELSE 0 END) * CASE WHEN text_fact THEN 0.35 ELSE 1 END, CASE WHEN structured THEN 0.06 ELSE 9 END)",
    "table_structure": f"greatest(CASE WHEN {_LOOKS} THEN CASE WHEN wants_table THEN 0.72 ELSE 0.22 END ELSE table_structure END, CASE WHEN wants_table AND {_LOOSE} THEN 0.88 ELSE 0 END, CASE WHEN wants_cross AND {_LOOSE} THEN CASE WHEN wants_table THEN 0.72 ELSE 0.28 END ELSE 0 END, CASE WHEN structured THEN 1.35 ELSE 0 END)",
    "layout": f"CASE WHEN structured THEN 0 ELSE CASE WHEN wants_location THEN 0.4 ELSE CASE WHEN {_LOOKS} THEN greatest(layout, 0.28) ELSE layout END * CASE WHEN profile = 'text_fact' THEN 0.3 ELSE 1 END END * CASE WHEN text_fact THEN 0.4 ELSE 1 END END",
}
_PLAIN = "route IN ('general_text', 'text_fact')"
_TIMES = {
    "embedding": f"1.35 * CASE WHEN {_PLAIN} THEN 1.18 WHEN route = 'visual_grounding' THEN 1.05 WHEN route = 'cross_modal' THEN 1.02 ELSE 1 END", "bm25": "0.72 * CASE route WHEN 'structured_table' THEN 0.95 WHEN 'cross_modal' THEN 0.92 ELSE 1 END", "lexical": "0.72", "section": "0.82 * CASE route WHEN 'multihop_graph' THEN 1.1 ELSE 1 END",
    "visual": f"CASE WHEN {_PLAIN} OR route = 'structured_table' THEN 0.45 WHEN route = 'visual_grounding' THEN 1.18 WHEN route = 'cross_modal' THEN 1.12 ELSE 1 END", "kg": "1",
    "table_structure": f"CASE WHEN {_PLAIN} THEN 0.45 WHEN route = 'structured_table' THEN 1.28 WHEN route = 'visual_grounding' THEN CASE WHEN wants_table THEN 1.05 ELSE 0.5 END WHEN route = 'cross_modal' THEN 1.15 ELSE 1 END",
}
_LIMITS = {"visual": "CASE WHEN wants_visual THEN 80 ELSE 20 END", "layout": "CASE WHEN wants_visual THEN 80 ELSE 20 END", "table_structure": "CASE WHEN wants_table OR wants_cross OR structured THEN 80 ELSE 16 END", "kg": "CASE WHEN hops OR score > 0 THEN 80 ELSE 26 END", "reference": "CASE WHEN has_refs THEN 80 ELSE 26 END"}
ORACLES["route_weights"] = f"""WITH {SAID}, {PLAN}, w0 AS (SELECT *, {', '.join(f'({c})::DOUBLE AS {r}' for r, c in _W0.items())} FROM plan), w1 AS (SELECT * EXCLUDE ({', '.join(P.ROUTES)}), {', '.join(f'round(({_W1[r]})::DOUBLE * x_{r}, 9) AS w_{r}' for r in P.ROUTES)} FROM w0)
SELECT question_id, (CASE WHEN structured THEN 0.54 WHEN text_fact THEN 0.46 WHEN wants_table OR wants_figure OR wants_location THEN 0.12 WHEN wants_cross THEN 0.3 ELSE 0.38 END)::DOUBLE AS bm25_anchor, {', '.join(f'w_{r}' for r in P.ROUTES)}, {', '.join(f"round(w_{r} * ({_TIMES.get(r, '1')})::DOUBLE, 9) AS p_{r}" for r in P.ROUTES)}, {', '.join(f"{_LIMITS.get(r, '80')} AS n_{r}" for r in P.ROUTES)} FROM w1"""

MORE = """more AS (SELECT *, wants_cross OR contains(t, '跨模态') OR (contains(q, '结合') AND (mt OR mf)) AS mc, wants_location OR contains(t, '证据定位') OR contains(q, '定位') OR contains(q, '页') AS ml
  FROM (SELECT *, wants_table OR contains(t, '表格') OR contains(q, 'table') OR contains(q, '表') AS mt, wants_figure OR contains(t, '图表') OR contains(t, '图文') OR contains(q, 'figure') OR contains(q, 'fig.') OR contains(q, '图') OR contains(q, 'chart') AS mf FROM plan))"""


def _stepped(base: float, steps: tuple, key: str, structured: dict[str, float]) -> str:
    of = {"wants_table": "mt", "wants_figure": "mf", "wants_cross": "mc", "wants_location": "ml"}
    whens = "".join(f" WHEN {of[w]} THEN {d[key]}" for w, d in reversed(steps) if key in d)
    return f"(CASE WHEN structured THEN {structured.get(key, base)}{whens} ELSE {base} END)::DOUBLE"


_KINDS = {k: _stepped(v, P.KINDS_WANTED, k, P.KINDS_STRUCTURED) for k, v in P.KINDS.items()}
_RELS = {k: _stepped(v, P.RELATIONS_WANTED, k, P.RELATIONS_STRUCTURED) for k, v in L.RELATION_WEIGHTS.items()}
_SAYS = {"table": "(contains(t, '表格') OR contains(q, 'table') OR contains(q, '表'))", "chart": "(contains(t, '图表理解') OR contains(q, 'chart'))", "figure": "(contains(q, 'figure') OR contains(q, 'fig.') OR contains(q, '图'))", "plain": "(contains(t, '文本事实') OR contains(t, '证据定位'))"}
_MULT = lambda *v: f"(CASE WHEN structured THEN {v[0]} WHEN {_SAYS['plain']} THEN 0 WHEN wants_cross AND (wants_table OR wants_figure) THEN {v[1]} WHEN wants_table AND wants_figure THEN {v[2]} WHEN wants_table THEN {v[3]} WHEN wants_figure THEN {v[4]} WHEN {_SAYS['table']} THEN {v[5]} WHEN {_SAYS['chart']} THEN {v[6]} WHEN contains(t, '图文一致性') THEN {v[7]} WHEN contains(t, '跨模态') THEN {v[8]} WHEN {_SAYS['figure']} THEN {v[9]} ELSE 0 END)::DOUBLE"
_G4 = {k: _case({r: d[k] for r, d in P.G4_ROUTES.items() if k in d}, "route", v) for k, v in P.G4.items()}
PROFILES = f"""{MORE}, profiles AS (SELECT *, {_MULT(0.1, 0.75, 0.85, 0.8, 0.75, 1.0, 1.0, 0.2, 0.1, 0.5)} AS ppr_mult, {_MULT(0.25, 1.0, 1.0, 0.85, 0.85, 0.8, 1.0, 0.0, 1.0, 0.6)} AS bridge_mult, {_MULT('CASE WHEN has_refs THEN 0.8 ELSE 0 END', 'CASE WHEN wants_table AND wants_figure THEN 1.2 WHEN wants_table THEN 1.3 ELSE 1.1 END', 1.2, 1.3, 1.1, 1.5, 1.0, 1.5, 0.2, 1.0)} AS ref_mult,
  {', '.join(f'{c} AS kind_{k}' for k, c in _KINDS.items())}, {', '.join(f'{c} AS rel_{k}' for k, c in _RELS.items())}, {', '.join(f'{c} AS g4_{k}' for k, c in _G4.items())} FROM more)"""
ORACLES["graph_profiles"] = f"WITH {SAID}, {PLAN}, {PROFILES} SELECT question_id, ppr_mult, bridge_mult, ref_mult, {', '.join(f'kind_{k}' for k in P.KINDS)}, {', '.join(f'rel_{k}' for k in ('text_ref_table', 'text_ref_figure', 'table_caption', 'figure_caption', 'same_page', 'belongs_to_page', 'same_section', 'chunk_sequence', 'section_title'))}, {', '.join(f'g4_{k}' for k in P.G4)} FROM profiles"

CANDIDATES = f"""cc AS (SELECT doc_id AS question_id, node_id, node_pos, regexp_extract_all(first_value(content) OVER (PARTITION BY doc_id ORDER BY node_pos), '(?s).') AS x, regexp_extract_all(content, '(?s).') AS y FROM nodes),
cs AS (SELECT question_id, node_id, node_pos, {_BIGRAMS.format('x')} AS a, {_BIGRAMS.format('y')} AS b FROM cc), cand AS (SELECT question_id, node_id, node_pos, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS sim FROM cs)"""
_TOC = f"(contains({clean('content')}, '···') OR regexp_matches({clean('content')}, '\\.{{4,}}\\s*[0-9]+\\s*$'))"
_VIS = "('table', 'figure', 'caption')"
ORACLES["context_expansion_topk"] = f"""WITH {NODES}, {CANDIDATES}, ct AS (SELECT question_id, node_id, sim AS score FROM cand QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY sim DESC, node_id) <= 10),
p AS (SELECT c.*, doc_id, section, page, node_type, node_pos FROM ct c JOIN nodes USING (node_id)), s AS (SELECT *, CASE WHEN score > 0 THEN score ELSE greatest(0.01, 1 / (r + 3.0::DOUBLE)) END AS lent FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, node_pos) AS r FROM p QUALIFY r <= 14)), o AS (SELECT * FROM nodes WHERE NOT {_TOC}),
b AS (SELECT s.question_id, s.node_id AS seed, s.node_type AS kind, s.node_pos AS seed_pos, lent, o.node_id, o.node_type, o.node_pos, 0.82 AS base FROM s JOIN o ON s.doc_id = o.doc_id AND s.section = o.section AND s.section <> '' UNION ALL
  SELECT s.question_id, s.node_id, s.node_type, s.node_pos, lent, o.node_id, o.node_type, o.node_pos, 0.62 FROM s JOIN o ON s.doc_id = o.doc_id AND s.page = o.page),
v AS (SELECT question_id, seed, node_id, node_pos, max(round(lent * least(1.0, base::DOUBLE + CASE WHEN node_type IN {_VIS} THEN 0.12 ELSE 0 END + CASE WHEN kind IN {_VIS} AND node_type = 'text' THEN 0.05 ELSE 0 END) * (0.75 + 0.25 / sqrt(1.0 + least(abs(seed_pos - node_pos), 24))) * CASE WHEN node_type IN {_VIS} THEN 1.0 ELSE 0.92 END, 9)) AS value FROM b WHERE seed <> node_id GROUP BY ALL),
k AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY question_id, seed ORDER BY value DESC, node_pos) <= 8),
m AS (SELECT question_id, node_id, node_pos, max(score) AS score FROM (SELECT question_id, node_id, node_pos, value AS score FROM k UNION ALL SELECT question_id, node_id, node_pos, score FROM p) GROUP BY ALL)
SELECT question_id, node_id, round(score, 6) AS score, row_number() OVER (PARTITION BY question_id ORDER BY m.score DESC, node_pos) AS rank FROM m QUALIFY rank <= 24"""

#: Power iteration in lists, a row for each question.
WALK = """wn AS (SELECT question_id, node_id, sum(sim) AS seed FROM (SELECT question_id, node_id, sim FROM cand UNION ALL SELECT CAST(string_split(x, '_')[2] AS BIGINT), x, 0 FROM links) GROUP BY ALL),
wi AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY node_id) AS i, count(*) OVER (PARTITION BY question_id) AS n, sum(seed) OVER (PARTITION BY question_id) AS total FROM wn),
we AS (SELECT b.question_id, b.i AS target, list({'j': a.i, 'p': weight / t}) AS into_ FROM (SELECT *, sum(weight) OVER (PARTITION BY x) AS t FROM links) l JOIN wi a ON a.node_id = l.x JOIN wi b ON b.node_id = l.y GROUP BY ALL),
wg AS (SELECT wi.question_id, any_value(n) AS n, list(seed / total ORDER BY i) AS seed, list(coalesce(into_, []) ORDER BY i) AS adj, list(NOT EXISTS (SELECT 1 FROM links WHERE x = wi.node_id) ORDER BY i) AS lost, list(node_id ORDER BY i) AS ids FROM wi LEFT JOIN we ON we.question_id = wi.question_id AND we.target = wi.i GROUP BY wi.question_id),
wr AS (SELECT question_id, 0 AS it, list_transform(seed, lambda e: 1.0::DOUBLE / n) AS v FROM wg
  UNION ALL SELECT wr.question_id, it + 1, list_transform(range(1, n + 1), lambda k: 0.85::DOUBLE * (coalesce(list_sum(list_transform(adj[k], lambda e: v[e.j] * e.p)), 0) + seed[k] * coalesce(list_sum(list_transform(range(1, n + 1), lambda z: CASE WHEN lost[z] THEN v[z] ELSE 0 END)), 0)) + 0.15::DOUBLE * seed[k]) FROM wr JOIN wg USING (question_id) WHERE it < 160),
walked AS (SELECT question_id, unnest(ids) AS node_id, unnest(v) AS score FROM wr JOIN wg USING (question_id) WHERE it = 160)"""
ORACLES["personalised_pagerank"] = f"WITH RECURSIVE {ALL}, {CANDIDATES}, {WALK} SELECT question_id, node_id, round(score, 6) AS score FROM walked"

_B = lambda x: f"CAST(round(({x}) * 1e9) AS BIGINT)"
_HAS = lambda *k: f"list_has_any(types, [{', '.join(map(lit, k))}])"
_WORTH = lambda x: f"CASE {x} " + " ".join(f"WHEN '{k}' THEN kind_{k}" for k in P.KINDS) + " ELSE 0 END"
_REL = "CASE e " + " ".join(f"WHEN '{k}' THEN rel_{k}" for k in L.RELATION_WEIGHTS if k != "related") + " ELSE rel_related END"
PLACED = f"""pn AS (SELECT *, {_TOC} AS toc, node_type = 'table' AND length(content) - length(replace(content, '|', '')) >= 3 AS caption, list_sort(list_distinct(list_concat({refs('content')}, CASE WHEN node_type = 'table' THEN ['table:' || count(*) FILTER (WHERE node_type = 'table') OVER (PARTITION BY doc_id ORDER BY node_pos)] ELSE [] END))) AS refs FROM nodes),
gt AS (SELECT source_id AS u, target_id AS v, list(DISTINCT edge_type) AS types FROM edges WHERE source_id <> target_id GROUP BY ALL), tl AS (SELECT u AS x, v AS y, types, weight FROM gt JOIN graph USING (u, v) UNION ALL SELECT v, u, types, weight FROM gt JOIN graph USING (u, v))"""
DOC_PLANS = f"{DOC_ASKS}, s AS (SELECT * FROM dq), {PLAN}, {PROFILES}"
_AND = " AND "
SIGNALS = f"""{PLACED}, ar AS (SELECT c.question_id, c.node_id, c.sim AS sim_x, x.node_type AS tx, x.toc AS toc_x, x.caption AS cap_x, x.section AS sec_x, tl.y, types, weight, y.node_type AS ty, y.section AS sec_y, y.caption AS cap_y, coalesce(NOT y.toc, false) AS here, coalesce(cy.sim, 0) AS sim_y, p.*  EXCLUDE (question_id)
  FROM cand c JOIN profiles p USING (question_id) JOIN pn x ON x.node_id = c.node_id LEFT JOIN tl ON tl.x = c.node_id LEFT JOIN pn y ON y.node_id = tl.y LEFT JOIN cand cy ON cy.node_id = tl.y),
sg AS (SELECT question_id, node_id, any_value(sim_x) AS sim, any_value(tx) AS node_type, any_value(toc_x) AS toc, any_value(cap_x) AS caption, count(y) AS degree,
  sum(CASE WHEN here AND ty IN ('text', 'table', 'figure', 'page', 'caption') AND (sim_y >= 0.2 OR ty IN {_VIS}) THEN {_B(f"list_max(list_transform(types, lambda e: {_REL})) * ({_WORTH('ty')}) * (0.5 + sim_y)")} END) / 1e9 AS near, sum(CASE WHEN here AND ty IN ('text', 'table', 'figure', 'page', 'caption') AND (sim_y >= 0.2 OR ty IN {_VIS}) THEN {_B(_WORTH('ty'))} END) / 1e9 AS covered,
  max(CASE WHEN here AND {_HAS('same_section', 'section_multimodal_peer')} THEN 0.12 ELSE 0 END) AS tie, max(CASE WHEN ty IN {_VIS} THEN 0.03 + CASE WHEN cap_y THEN 0.03 ELSE 0 END ELSE 0 END) AS shown,
  sum(CASE WHEN here THEN {_B(f"CASE WHEN {_HAS('section_title')} THEN 0.22 * least(weight, 2) WHEN {_HAS('chunk_sequence', 'same_section', 'same_page')} THEN 0.08 * least(weight, 2) ELSE 0 END")} END) / 1e9 AS steps, max(CASE WHEN here THEN sim_y ELSE 0 END) AS said,
  sum(CASE WHEN here THEN {_B("0.03 + CASE WHEN sec_x <> '' AND sec_y = sec_x THEN 0.04 ELSE 0 END")} END) / 1e9 AS beside, bool_or(here AND ty = 'text') AS yt, bool_or(here AND ty = 'table') AS yb, bool_or(here AND ty = 'title') AS yh,
  any_value(wants_table) AS wt, any_value(wants_figure) AS wf, any_value(wants_cross) AS wc, any_value(wants_visual) AS wv, any_value(score) > 0 AS sold, any_value({_WORTH('tx')}) AS mine, any_value({' + '.join(f'kind_{k}' for k in P.KINDS)}) AS all_kinds FROM ar GROUP BY question_id, node_id),
sh AS (SELECT *, (node_type = 'table' OR coalesce(yb, false)) AS has_t, node_type IN ('figure', 'caption') AS has_f, (node_type = 'text' OR coalesce(yt, false)) AS has_x FROM sg),
signals AS (SELECT question_id, node_id, sim, node_type, caption,
  round(CASE WHEN toc THEN 0 ELSE (0.35 * mine + 0.65 * coalesce(near, 0)) * least(1, (CASE WHEN node_type = 'title' THEN 0 ELSE mine END + coalesce(covered, 0)) / greatest(1, all_kinds)) / ln(2.0 + least(degree, 12)) END + 1e-10, 6)::DOUBLE AS bridge,
  round(CASE WHEN wv OR wt OR wf OR wc THEN least(1, CASE WHEN node_type = 'text' THEN 0.36 WHEN node_type = 'table' AND (wt OR wc) THEN 0.58 ELSE 0 END + CASE WHEN node_type IN {_VIS} AND caption THEN 0.08 ELSE 0 END + tie + CASE WHEN wt AND has_t THEN 0.24 ELSE 0 END + CASE WHEN wf AND has_f THEN 0.24 ELSE 0 END + CASE WHEN wc THEN CASE WHEN has_x AND (has_t OR has_f) THEN 0.22 ELSE 0 END + CASE WHEN has_t AND has_f THEN 0.14 ELSE 0 END ELSE 0 END) ELSE 0 END + 1e-10, 6)::DOUBLE AS modality,
  round(CASE WHEN wt AND node_type = 'table' THEN 0.18 ELSE 0 END + CASE WHEN wv AND node_type IN {_VIS} THEN 0.08 ELSE 0 END + CASE WHEN caption THEN 0.05 ELSE 0 END + shown + 1e-10, 6)::DOUBLE AS grounding,
  round(CASE WHEN toc OR degree = 0 THEN 0 ELSE greatest(0, least(1, 0.45 * least(coalesce(steps, 0), 1) + 0.3 * said + 0.15 * least(coalesce(beside, 0), 1) + (CASE WHEN wt AND yb THEN 0.22 ELSE 0 END + CASE WHEN wc AND coalesce(yt, false)::INT + coalesce(yb, false)::INT >= 2 THEN 0.25 ELSE 0 END + CASE WHEN sold AND (yh OR yt) THEN 0.12 ELSE 0 END) * CASE WHEN node_type IN ('page', 'title') AND NOT sold THEN 0.65 ELSE 1 END)) END + 1e-10, 6)::DOUBLE AS chain FROM sh)"""
ORACLES["graph_signals"] = f"WITH {ALL}, {CANDIDATES}, {DOC_PLANS}, {SIGNALS} SELECT question_id, node_id, sim, node_type, bridge, modality, grounding, chain FROM signals"
_RW = lambda x, hit: f"CASE WHEN {hit} THEN CASE {x} WHEN 'table' THEN 0.9 WHEN 'caption' THEN 0.95 WHEN 'text' THEN 0.75 WHEN 'page' THEN 0.1 WHEN 'figure' THEN 0.1 ELSE 0.2 END ELSE CASE {x} WHEN 'figure' THEN 1 WHEN 'caption' THEN 0.95 WHEN 'text' THEN 0.75 WHEN 'page' THEN 0.1 WHEN 'table' THEN 0.1 ELSE 0.2 END END"
REFS = f"""ra AS (SELECT question_id, n.doc_id, page, node_id, node_pos, list_intersect(refs, {refs('question')}) AS hits, node_type FROM dq JOIN pn n ON n.doc_id = dq.question_id),
rb AS (SELECT *, len(list_filter(hits, lambda h: starts_with(h, 'table:'))) > 0 AS ht, len(list_filter(hits, lambda h: starts_with(h, 'figure:'))) > 0 AS hf FROM ra WHERE len(hits) > 0),
rn AS (SELECT b.question_id, p.node_id, CASE WHEN p.node_pos > b.node_pos THEN 0.95 ELSE 0.75 END / sqrt(abs(p.node_pos - b.node_pos)::DOUBLE) AS score FROM rb b JOIN pn p ON p.doc_id = b.doc_id AND p.page = b.page AND p.node_pos - b.node_pos BETWEEN -2 AND 3 AND p.node_pos <> b.node_pos
  WHERE CASE WHEN p.node_pos > b.node_pos THEN (ht AND p.node_type = 'table') OR (hf AND p.node_type IN ('figure', 'caption')) ELSE hf AND p.node_type IN ('figure', 'caption') END QUALIFY row_number() OVER (PARTITION BY b.question_id, b.node_id, p.node_pos > b.node_pos ORDER BY abs(p.node_pos - b.node_pos)) = 1),
re AS (SELECT question_id, node_id, ({_RW('node_type', 'ht')})::DOUBLE AS score FROM rb UNION ALL SELECT * FROM rn UNION ALL SELECT question_id, y, ({_RW('node_type', 'ht')})::DOUBLE * CASE WHEN {_HAS('text_ref_table', 'text_ref_figure', 'table_caption', 'figure_caption')} THEN 0.85 WHEN {_HAS('same_page')} THEN 0.35 ELSE 0.2 END FROM rb JOIN tl ON tl.x = rb.node_id),
refscore AS (SELECT c.question_id, c.node_id, round(coalesce(max(re.score), 0), 6)::DOUBLE AS score FROM cand c LEFT JOIN re ON re.question_id = c.question_id AND re.node_id = c.node_id GROUP BY ALL)"""
ORACLES["reference_scores"] = f"WITH {ALL}, {CANDIDATES}, {DOC_ASKS}, {PLACED}, {REFS} SELECT * FROM refscore"
_N = lambda c: f"({ratio(c, 'question_id')})"
METHODS = f"""al AS (SELECT sg.* EXCLUDE (sim), sg.sim AS sim, round(coalesce(w.score, 0), 6) AS ppr, r.score AS ref, CASE WHEN rerank_boost THEN modality ELSE 0 END AS mody, p.* EXCLUDE (question_id) FROM signals sg JOIN refscore r ON r.node_id = sg.node_id LEFT JOIN walked w ON w.node_id = sg.node_id JOIN profiles p ON p.question_id = sg.question_id),
nm AS (SELECT *, {', '.join(f"{_N(c)} AS n_{c}, max({c}) OVER (PARTITION BY question_id) > 0 AS any_{c}" for c in ('sim', 'ppr', 'bridge', 'ref', 'grounding', 'mody', 'chain'))}, wants_table AND NOT wants_figure AND NOT wants_cross AS tonly, wants_visual OR wants_table OR wants_figure OR wants_cross AS looks FROM al),
wt_ AS (SELECT *, CASE WHEN graph_boost AND NOT tonly THEN CASE WHEN looks THEN 0.035 WHEN hops THEN 0.07 ELSE 0.02 END ELSE 0 END::DOUBLE AS lp, CASE WHEN graph_boost AND NOT tonly THEN CASE WHEN looks THEN 0.17 WHEN hops THEN 0.18 ELSE 0.15 END ELSE 0.15 END::DOUBLE AS lb,
  CASE WHEN NOT any_grounding OR structured THEN 0 WHEN text_fact AND NOT (wants_table OR wants_figure OR wants_location) THEN 0.02 WHEN wants_table OR wants_figure THEN 0.08 WHEN wants_cross OR wants_location THEN 0.05 WHEN wants_visual THEN 0.035 ELSE 0.015 END::DOUBLE AS vw,
  CASE WHEN NOT any_chain THEN 0 WHEN nm.score > 0 THEN 0.09 WHEN structured THEN 0.025 WHEN wants_cross OR wants_table OR wants_figure THEN 0.08 WHEN wants_location THEN 0.06 WHEN text_fact THEN 0.025 ELSE 0.04 END::DOUBLE AS cw, CASE WHEN NOT any_mody OR NOT rerank_boost THEN 0 WHEN wants_cross AND (wants_table OR wants_figure) THEN 0.18 WHEN wants_table AND wants_figure THEN 0.17 WHEN wants_table OR wants_figure THEN 0.14 WHEN wants_visual THEN 0.1 ELSE 0 END::DOUBLE AS mw FROM nm),
g3 AS (SELECT *, 0.85 + lp * (1 - ppr_mult) + lb * (1 - bridge_mult) AS sw, least(CASE WHEN any_ref THEN 0.1 * ref_mult ELSE 0 END, 0.85 + lp * (1 - ppr_mult) + lb * (1 - bridge_mult)) AS rw, route IN ('visual_grounding', 'cross_modal') AS shows FROM wt_),
g4 AS (SELECT *, (0.93 + 0.07 * (1 - ppr_mult)) * n_sim + 0.07 * ppr_mult * n_ppr AS s2, (sw - rw) * n_sim + lp * ppr_mult * n_ppr + lb * bridge_mult * n_bridge + rw * n_ref AS s3,
  greatest(least(g4_visual_max, greatest(g4_visual_min, vw)), CASE WHEN rerank_boost AND shows THEN 0.16 WHEN rerank_boost AND route <> 'structured_table' AND wants_visual THEN 0.12 ELSE 0 END) AS vw2, greatest(least(g4_chain_max, greatest(g4_chain_min, cw)), CASE WHEN rerank_boost AND shows THEN 0.12 WHEN rerank_boost AND route = 'structured_table' THEN 0.06 ELSE 0 END, CASE WHEN graph_boost AND any_chain THEN CASE WHEN wants_visual THEN 0.09 ELSE 0.055 END ELSE 0 END) AS cw2,
  greatest(mw, CASE WHEN rerank_boost AND NOT shows AND route = 'structured_table' THEN 0.11 WHEN rerank_boost AND NOT shows AND wants_visual THEN 0.1 ELSE 0 END) AS mw2 FROM g3),
g5 AS (SELECT *, ((1 - g4_retrieval_anchor) * (s3 + greatest(0.05, 1 - s3) * (vw2 * n_grounding + mw2 * n_mody + cw2 * n_chain)) + g4_retrieval_anchor * n_sim)
  * CASE node_type WHEN 'title' THEN 0.72 WHEN 'text' THEN 1.08 ELSE CASE WHEN structured THEN 1.08 WHEN wants_table OR wants_figure OR wants_location OR wants_cross THEN CASE WHEN caption THEN 1.02 ELSE 0.92 END ELSE 0.72 END * CASE WHEN g4.score > 0 THEN 0.55 ELSE 1 END END AS s4 FROM g4),
g6 AS (SELECT *, round(least(1, greatest(0, s4)), 9)::DOUBLE AS s5 FROM g5),
mt_ AS (SELECT question_id, node_id, 'G0' AS method, round(n_sim + 1e-10, 6)::DOUBLE AS sc FROM g6 UNION ALL SELECT question_id, node_id, 'G1', round(n_sim + 1e-10, 6)::DOUBLE FROM g6 UNION ALL SELECT question_id, node_id, 'G2', round(s2 + 1e-10, 6)::DOUBLE FROM g6 UNION ALL SELECT question_id, node_id, 'G3', round(s3 + 1e-10, 6)::DOUBLE FROM g6 UNION ALL SELECT question_id, node_id, 'G4', round({_N('s5')} + 1e-10, 6)::DOUBLE FROM g6),
methods AS (SELECT question_id, method, row_number() OVER (PARTITION BY question_id, method ORDER BY sc DESC, node_id) AS rank, node_id, sc AS score FROM mt_)"""
_RANKING = f"{ALL}, {CANDIDATES}, {WALK}, {DOC_PLANS}, {SIGNALS}, {REFS}, {METHODS}"
ORACLES["g_methods_rank"] = f"WITH RECURSIVE {_RANKING} SELECT question_id, method, rank, node_id, score FROM methods WHERE rank <= 5"
ORACLES["evidence_chain"] = f"""WITH RECURSIVE {_RANKING}, ci AS (SELECT * FROM pn WHERE NOT toc),
cr AS (SELECT m.question_id, m.node_id, m.rank, m.score, sg.bridge, r.score AS ref, p.wants_visual AS wants, ci.doc_id, ci.page, ci.node_type, row_number() OVER (PARTITION BY m.question_id ORDER BY m.rank, m.node_id) AS n FROM methods m JOIN ci USING (node_id) JOIN signals sg USING (node_id) JOIN refscore r USING (node_id) JOIN profiles p ON p.question_id = m.question_id WHERE method = 'G4' AND m.rank <= 10),
pg AS (SELECT DISTINCT question_id, doc_id, page FROM cr WHERE n <= 3), nr AS (SELECT cr.* FROM cr JOIN pg USING (question_id, doc_id, page) WHERE wants AND node_type IN {_VIS} QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY cr.score DESC, rank, node_id) = 1),
cn AS (SELECT cr.question_id, tl.y AS node_id, row_number() OVER (PARTITION BY cr.question_id ORDER BY tl.weight DESC, tl.y) AS v FROM cr JOIN tl ON tl.x = cr.node_id JOIN ci ON ci.node_id = tl.y WHERE cr.n = 1 QUALIFY v <= 8),
ev AS (SELECT question_id, node_id, 1 AS phase, 'main' AS role, n::DOUBLE AS o0, 0::DOUBLE AS o1, 0::DOUBLE AS o2 FROM cr WHERE n = 1 UNION ALL SELECT question_id, node_id, 2, 'reference', n, 0, 0 FROM cr WHERE ref > 0 UNION ALL SELECT question_id, node_id, 4, 'visual_companion', n, 0, 0 FROM nr
  UNION ALL SELECT question_id, node_id, 5, 'visual', -ref, -bridge, -score FROM cr WHERE node_type IN {_VIS} UNION ALL SELECT question_id, node_id, 7, 'graph_neighbor', v, 0, 0 FROM cn UNION ALL SELECT question_id, node_id, 8, 'context', n, 0, 0 FROM cr WHERE node_type = 'text'),
fi AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY question_id, node_id ORDER BY phase, o0, o1, o2) = 1)
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY phase, o0, o1, o2, node_id) AS step, node_id, role FROM fi QUALIFY step <= 5"""
_LG = "regexp_replace(lower(" + clean("text") + "), '\\s\\s+', ' ', 'g')"
def _fitted(lt: str) -> str:
    """CTEs that end in ls: (question_id, node_id, dot, norm, length) of texts fitted on each question's own. lt selects question_id, node_id, ask, text."""
    return f"""lt AS ({lt}),
lc AS (SELECT question_id, node_id, ask, regexp_extract_all({_LG}, '(?s).') AS c FROM lt), lh AS (SELECT question_id, node_id, ask, generate_subscripts(c, 1) AS i, unnest(c) AS c FROM lc), lw AS (SELECT question_id, node_id, ask, c, lead(c, 1) OVER w AS c1, lead(c, 2) OVER w AS c2, lead(c, 3) OVER w AS c3 FROM lh WINDOW w AS (PARTITION BY question_id, node_id ORDER BY i)), lg AS (SELECT question_id, node_id, ask, unnest([c || c1, c || c1 || c2, c || c1 || c2 || c3]) AS term FROM lw),
lp AS (SELECT question_id, node_id, ask, term, count(*) AS tf FROM lg WHERE term IS NOT NULL GROUP BY ALL), ln_ AS (SELECT question_id, count(*) AS n FROM lt GROUP BY question_id), li AS (SELECT question_id, term, ln((1.0 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM lp JOIN ln_ USING (question_id) GROUP BY ALL),
lq AS (SELECT question_id, term, tf * idf AS w FROM lp JOIN li USING (question_id, term) WHERE ask), ll AS (SELECT question_id, sum({_B('w * w')}) AS length FROM lq GROUP BY question_id),
ld AS (SELECT p.question_id, p.node_id, sum({_B('tf * idf * coalesce(lq.w, 0)')}) AS dot, sum({_B('tf * idf * tf * idf')}) AS norm FROM lp p JOIN li USING (question_id, term) LEFT JOIN lq USING (question_id, term) WHERE NOT ask GROUP BY ALL),
ls AS (SELECT question_id, node_id, CASE WHEN norm > 0 AND length > 0 THEN dot::DOUBLE / sqrt(norm::DOUBLE * length::DOUBLE) END AS score FROM ld JOIN ll USING (question_id))"""


ORACLES["local_lexical"] = f"""WITH {NODES}, {DOC_ASKS}, {_fitted("SELECT question_id, '' AS node_id, true AS ask, question AS text FROM dq UNION ALL SELECT doc_id, node_id, false, content FROM nodes")}
SELECT n.doc_id AS question_id, n.node_id, round(coalesce(score, 0), 6) AS score FROM nodes n JOIN dq ON dq.question_id = n.doc_id LEFT JOIN ls ON ls.question_id = n.doc_id AND ls.node_id = n.node_id"""

_CUT = "CASE WHEN length(x) > 900 THEN list_transform(range(0, (length(x) - 1) // 900 + 1), lambda i: trim(substr(x, i * 900 + 1, 900))) ELSE [x] END"
ORACLES["sentence_chunks"] = f"""WITH d AS (SELECT doc_id, {clean('text')} AS t FROM documents),
p AS (SELECT doc_id, t, list_filter(list_transform(string_split(regexp_replace(t, '([。！？.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM d),
e AS (SELECT doc_id, t, list_transform(s, lambda x: {{'big': length(x) > 900, 'p': {_CUT}, 'done': CAST([] AS VARCHAR[]), 'now': ''}}) AS s FROM p),
f AS (SELECT doc_id, t, list_reduce(list_prepend({{'big': false, 'p': CAST([] AS VARCHAR[]), 'done': CAST([] AS VARCHAR[]), 'now': ''}}, s), lambda a, x: {{'big': false, 'p': CAST([] AS VARCHAR[]),
  'done': CASE WHEN x.big THEN list_concat(a.done, CASE WHEN a.now <> '' THEN [a.now] ELSE [] END, x.p) WHEN a.now <> '' AND length(a.now) + length(x.p[1]) > 900 THEN list_append(a.done, a.now) ELSE a.done END,
  'now': CASE WHEN x.big THEN '' WHEN a.now = '' OR length(a.now) + length(x.p[1]) > 900 THEN x.p[1] ELSE a.now || ' ' || x.p[1] END}}) AS r FROM e),
c AS (SELECT doc_id, CASE WHEN t = '' THEN [] WHEN length(t) <= 900 THEN [t] WHEN r.now <> '' THEN list_append(r.done, r.now) ELSE r.done END AS c FROM f)
SELECT doc_id, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS chunk, unnest(c) AS text FROM c"""

ORACLES["edges_enhanced"] = f"""WITH {NODES}, n AS (SELECT *, first_value(node_id) OVER (PARTITION BY doc_id ORDER BY node_pos) AS parent, 'doc' || doc_id || '/p' || page AS context FROM nodes),
t AS (SELECT * FROM n WHERE node_type = 'text' AND section <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, section ORDER BY node_pos) <= 24), v AS (SELECT * FROM n WHERE node_type = 'table' AND section <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, section ORDER BY node_pos) <= 24),
k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY context ORDER BY node_pos) <= 36),
e AS (SELECT parent AS a, node_id AS b, 'parent_section' AS edge_type, 0.45::DOUBLE AS weight FROM n WHERE parent <> node_id UNION ALL SELECT t.node_id, v.node_id, 'same_context_table', 0.24 FROM t JOIN v USING (doc_id, section, page) UNION ALL SELECT x.node_id, y.node_id, 'section_multimodal_peer', 0.18 FROM v x JOIN v y USING (doc_id, section, page) WHERE x.node_pos < y.node_pos
  UNION ALL SELECT x.node_id, y.node_id, CASE WHEN x.node_type = 'text' AND y.node_type = 'text' THEN 'same_context_text' WHEN 'table' IN (x.node_type, y.node_type) THEN 'same_context_table' ELSE 'same_context_visual' END, CASE WHEN x.node_type = 'text' AND y.node_type = 'text' THEN 0.2 WHEN 'table' IN (x.node_type, y.node_type) THEN 0.62 ELSE 0.48 END FROM k x JOIN k y USING (context) WHERE x.node_pos < y.node_pos)
SELECT least(a, b) AS source_id, greatest(a, b) AS target_id, edge_type, round(sum(weight), 4) AS weight FROM e GROUP BY 1, 2, 3"""
ORACLES["table_text"] = f"WITH {TABLES}, w AS (SELECT doc_id, max(len(cells)) AS n FROM tr GROUP BY doc_id), x AS (SELECT doc_id, string_agg(array_to_string(list_resize(cells, n, ''), ' | '), chr(10) ORDER BY row) AS t FROM tr JOIN w USING (doc_id) GROUP BY doc_id) SELECT doc_id, md5({clean('t')}) AS text_md5, CAST(length({clean('t')}) AS INTEGER) AS n_chars FROM x"
ORACLES["layout_block_flags"] = f"""WITH {NODES}, b AS (SELECT node_id, content, {clean('content')} AS c, least(600.0::DOUBLE, length(content) * 5.0::DOUBLE) AS w, (node_pos % 10) * 80.0::DOUBLE AS y0, length(content)::DOUBLE AS h FROM nodes), r AS (SELECT *, w * h > 0 AS ok FROM b)
SELECT node_id, CASE WHEN ok THEN round(w * h, 3) END AS area, ok AND (y0 + h / 2 <= 64 OR y0 + h / 2 >= 736) AS margin, regexp_matches(c, '(?i)^(?:(?:page\\s*)?\\d{{1,4}}|[ivxlcdm]{{1,8}})$') AS page_number,
  ok AND (w / 2 <= 72 OR w / 2 >= 528) AND w <= 72 AND h >= 144 AND (regexp_matches(c, '(?i)arxiv|copyright|doi|preprint|submitted|accepted') OR h >= 224) AS side_noise FROM r"""
ORACLES["document_boxes"] = f"""WITH {NODES}, b AS (SELECT doc_id, page, ((node_pos % 10) % 3) * 10.0::DOUBLE AS x0, (node_pos % 10) * 80.0::DOUBLE AS y0, length(content)::DOUBLE AS x1 FROM nodes)
SELECT doc_id, page, min(x0) FILTER (WHERE x1 > x0) AS x0, min(y0) FILTER (WHERE x1 > x0) AS y0, max(x1) FILTER (WHERE x1 > x0) AS x1, max(y0 + 40) FILTER (WHERE x1 > x0) AS y1, coalesce(quantile_cont(x1, 0.5) FILTER (WHERE x1 > 0), 0) AS median_length FROM b GROUP BY ALL"""
ORACLES["heading_texts"] = f"""WITH {NODES}, c AS (SELECT node_id, content, {clean('content')} AS c FROM nodes), l AS (SELECT *, len(regexp_extract_all(c, '[A-Za-z]')) AS la, len(regexp_extract_all(c, '[一-鿿]')) AS cj, len(regexp_extract_all(content, '[A-Za-z]')) AS lb, len(regexp_extract_all(content, '[一-鿿]')) AS ck FROM c)
SELECT node_id, md5(trim(regexp_replace(regexp_replace(c, '(?i)^\\s*(?:[IVXLC]+|\\d+(?:\\.\\d+)*|[一二三四五六七八九十]+)[\\.\\s、-]+', ''), '[:：]\\s*$', ''))) AS heading_md5, md5(regexp_replace(c, '[\\s。；;,.，、]+$', '')) AS trimmed_md5, la > greatest(20, cj * 2) AS english, ck >= greatest(2, lb // 3) AS chinese FROM l"""
ORACLES["question_kinds"] = f"""WITH {SAID}, b AS (SELECT *, lower(question) AS low, lower({clean('question_type')}) AS kind, lower({clean('question_type')}) || ' ' || lower({clean('question')}) AS blob FROM s),
w AS (SELECT *, regexp_matches(blob, 'table|tabular|表') AS wants_table, regexp_matches(blob, 'image|figure|fig\\.|chart|plot|diagram|图') AS wants_figure FROM b), x AS (SELECT *, regexp_matches(blob, 'cross|multi') OR contains(kind, 'text-table-image') OR (wants_table AND wants_figure) AS wants_cross FROM w)
SELECT question_id, CASE WHEN regexp_matches(low, 'table|表格|表 |表中') THEN '表格问答' WHEN regexp_matches(low, 'figure|fig\\.|图|曲线|趋势') THEN '图表理解' WHEN regexp_matches(low, '跨模态|结合|多模态') THEN '跨模态综合' ELSE '自定义问题' END AS online_type, CASE WHEN regexp_matches(question_id, '\\d$') THEN regexp_extract(question_id, '(\\d+)$', 1) ELSE question_id END AS submission_id, wants_table, wants_figure, wants_cross, wants_table OR wants_figure OR wants_cross AS wants_visual FROM x"""

DESCRIBED = f"nd AS (SELECT *, coalesce(lag({preview('content', 120)}) OVER w, '') AS before, coalesce(lead({preview('content', 120)}) OVER w, '') AS after, coalesce(section, '') AS sec FROM nodes WINDOW w AS (PARTITION BY doc_id ORDER BY node_pos))"
_PRODUCT_TEXT = fold(clean("doc_id || ' ' || sec || ' ' || content"))
_SALES_TEXT = fold(clean("doc_id || ' ' || sec || ' ' || node_type || ' ' || before || ' ' || content || ' ' || after"))
ORACLES["node_texts_by_route"] = f"""WITH {NODES}, {DESCRIBED} SELECT node_id, md5({clean("doc_id || ' ' || sec || ' ' || before || ' ' || content || ' ' || after")}) AS retrieval,
md5({clean("'paper_domain: section:' || sec || ' node_type:' || node_type || ' structure_type: chunk_strategy: layout_role: explicit_refs: ' || " + preview('content', 240))}) AS section, md5({clean("node_type || ' ' || " + clean('sec') + " || ' ' || " + preview('content', 500))}) AS "table",
md5({_PRODUCT_TEXT}) AS product, md5({_SALES_TEXT}) AS after_sales, md5({clean("node_type || ' ' || sec || ' ' || content")}) AS guard FROM nd"""


def _alias_of(x: str, terms: tuple[str, ...]) -> str:
    return any_of(x, terms, False)


_ROUTE = "CASE WHEN score > 0 AND profile IN ('policy', 'after_sales') THEN CASE WHEN has_product THEN 'service_with_product' ELSE 'service' END WHEN profile = 'manual_visual' THEN 'manual_visual' WHEN profile IN ('manual', 'troubleshooting') THEN 'manual' WHEN wants_visual THEN 'visual' ELSE '' END"
_NAMED = "CASE " + " ".join(f"WHEN {_alias_of('blob', (k, *v))} THEN {lit(k)}" for k, v in L.PRODUCT_ALIASES.items()) + " ELSE '' END"
_ALIASES = "list_filter([" + ", ".join(f"CASE WHEN {_alias_of('blob', (a,))} THEN {lit(a)} END" for a in dict.fromkeys(a for v in L.PRODUCT_ALIASES.values() for a in v)) + "], lambda a: a IS NOT NULL)"
_SERVICES = "list_filter([" + ", ".join(f"CASE WHEN contains(blob, {lit(a)}) THEN {lit(a)} END" for a in L.SERVICE_HINTS) + "], lambda a: a IS NOT NULL)"
_HINT = lambda d, x: f"CASE {x} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in d.items()) + " END"
ORACLES["question_expansion"] = f"""WITH {NODES}, {DOC_ASKS}, s AS (SELECT 'd' || question_id AS question_id, question, question_type FROM dq), {UNDERSTOOD},
r AS (SELECT question_id, question, plain, {_ROUTE} AS route, {_NAMED} AS product, {_ALIASES} AS aliases, {_SERVICES} AS services FROM prof), x AS (SELECT *, {_HINT(L.ROUTE_HINTS, 'route')} AS rh, {_HINT(L.PRODUCT_HINTS, 'product')} AS ph FROM r),
h AS (SELECT *, list_concat(list_filter([CASE WHEN rh IS NOT NULL THEN 'route=' || route || '; intent aliases=' || rh END, CASE WHEN product <> '' THEN 'product=' || product || CASE WHEN ph IS NOT NULL THEN '; product aliases=' || ph ELSE '' END END, CASE WHEN len(aliases) > 0 THEN 'matched product aliases=' || array_to_string(aliases[1:10], ' ') END], lambda a: a IS NOT NULL),
  CASE WHEN route = 'service' OR len(list_filter(services, lambda a: a <> '售后')) > 0 THEN list_transform(services, lambda a: 'service_term=' || a || '; ' || {_HINT(L.SERVICE_HINTS, 'a')}) ELSE [] END) AS hints FROM x)
SELECT question_id, question, CASE WHEN len(hints) > 0 THEN plain || chr(10) || 'Search context: ' || array_to_string(hints[1:8], ' | ') ELSE question END AS expanded, CASE WHEN len(hints) > 0 THEN route ELSE '' END AS route_name, CASE WHEN len(hints) > 0 THEN product ELSE '' END AS route_product FROM h"""
_HOLDS = lambda x, name: f"(contains({x}, {name}) AND (regexp_matches({name}, '[一-鿿]') OR regexp_matches({x}, '(^|[^a-z0-9])' || regexp_escape({name}) || '($|[^a-z0-9])')))"
_GROUPS = ", ".join(f"({lit(k)}, {lit(t.casefold())})" for k, v in L.PRODUCT_ALIASES.items() for t in (k, *v))
ORACLES["product_route"] = f"""WITH {NODES}, {DOC_ASKS}, {DESCRIBED}, qb AS (SELECT q.question_id, {fold(clean("concat_ws(' ', q.question, d.source)"))} AS blob FROM dq q LEFT JOIN documents d ON d.doc_id = q.question_id),
gr AS (SELECT DISTINCT * FROM (SELECT * FROM (VALUES {_GROUPS}) AS t(canonical, term) UNION ALL SELECT w, w FROM (SELECT DISTINCT {fold("regexp_extract(" + clean('title') + ", '^[^\s]+')")} AS w FROM dq) WHERE w <> '')),
gq AS (SELECT question_id, canonical, term FROM qb, gr WHERE {_HOLDS('blob', 'term')}), nt AS (SELECT doc_id AS question_id, node_id, {fold(clean('CAST(doc_id AS VARCHAR)'))} AS d, {fold(clean("sec || ' '"))} AS p, {_PRODUCT_TEXT} AS t FROM nd),
gs AS (SELECT question_id, node_id, canonical, least(1.0, CASE WHEN bool_or({_HOLDS('d', 'term')}) THEN 0.58 ELSE 0 END + CASE WHEN bool_or({_HOLDS('p', 'term')}) THEN 0.42 ELSE 0 END + CASE WHEN bool_or({_HOLDS('t', 'term')}) THEN 0.26 ELSE 0 END) AS score FROM nt JOIN gq USING (question_id) GROUP BY ALL)
SELECT n.question_id, n.node_id, round(coalesce(max(score), 0), 4)::DOUBLE AS score FROM nt n LEFT JOIN gs USING (question_id, node_id) GROUP BY ALL"""

_POLICIES = ", ".join(f"('policy:{L.KG_POLICIES[k]}', 'policy', {lit(L.KG_POLICIES[k])}, {lit(t.casefold())})" for k, v in L.AFTER_SALES_TERMS.items() for t in (L.KG_POLICIES[k], *v))
_KEPT = "NOT (kinds = 1 AND generic AND NOT (hinted OR has_product))"
_STRONG = "list_concat(CASE WHEN " + _KEPT + " THEN list_filter([" + ", ".join(f"CASE WHEN h[{i}] >= 2 THEN {lit(L.KG_POLICIES[k])} END" for i, k in enumerate(L.AFTER_SALES_TERMS, 1)) + "], lambda a: a IS NOT NULL) ELSE [] END, list_filter([" + ", ".join(f"CASE WHEN contains(blob, {lit(v)}) THEN {lit(v)} END" for v in L.KG_POLICIES.values()) + "], lambda a: a IS NOT NULL))"
KG_CONTEXT = f"""{KG}, {DOC_ASKS}, s AS (SELECT * FROM dq), {UNDERSTOOD},
en AS (SELECT DISTINCT * FROM (SELECT 'part:' || lower(term) AS entity_id, 'part' AS type, lower(term) AS title, {fold('lower(term)')} AS name FROM terms UNION ALL SELECT 'product:' || doc_id, 'product', doc_id::VARCHAR, doc_id::VARCHAR FROM terms UNION ALL SELECT * FROM (VALUES {_POLICIES}) AS t(a, b, c, d))),
eh AS (SELECT question_id, entity_id, type, bool_or(name NOT IN ({', '.join(map(lit, L.KG_GENERIC_POLICY))})) AS own FROM prof, en WHERE {_HOLDS('blob', 'name')} GROUP BY ALL),
es AS (SELECT question_id, unnest({_STRONG}) AS title FROM prof),
context AS (SELECT DISTINCT question_id, entity_id, CASE WHEN type = 'policy' THEN 'policy' ELSE 'concrete' END AS kind FROM (SELECT question_id, entity_id, type FROM eh WHERE type <> 'policy' OR own UNION ALL SELECT question_id, entity_id, type FROM es JOIN en USING (title) WHERE type = 'policy'))"""
ORACLES["kg_query_context"] = f"WITH {KG_CONTEXT} SELECT * FROM context"
_TOLD = "list_filter([" + ", ".join(f"CASE WHEN {any_of(fold(clean('content')), v)} THEN 'policy:{L.KG_POLICIES[k]}' END" for k, v in L.AFTER_SALES_TERMS.items()) + "], lambda a: a IS NOT NULL)"
ORACLES["kg_route"] = f"""WITH {KG_CONTEXT}, pl AS (SELECT node_id, doc_id, unnest({_TOLD}) AS entity_id FROM nodes),
lk_ AS (SELECT DISTINCT * FROM (SELECT node_id, 'part:' || lower(term) AS entity_id FROM terms UNION ALL SELECT node_id, 'product:' || doc_id FROM terms UNION ALL SELECT node_id, entity_id FROM pl)),
re AS (SELECT DISTINCT * FROM (SELECT node_id, 'product:' || doc_id AS a, 'part:' || lower(term) AS b, 'has' AS type FROM terms UNION ALL SELECT node_id, entity_id, 'product:' || doc_id, 'applies' FROM pl)),
pr AS (SELECT doc_id AS question_id, node_id, node_type IN {_VIS} AS looks, node_type = 'title' AS title FROM nodes),
di AS (SELECT pr.question_id, pr.node_id, count(*) FILTER (WHERE kind = 'concrete') AS c, count(*) FILTER (WHERE kind = 'policy') AS p FROM pr JOIN lk_ USING (node_id) JOIN context x ON x.question_id = pr.question_id AND x.entity_id = lk_.entity_id GROUP BY ALL),
rm AS (SELECT pr.question_id, pr.node_id, a, b, re.type, count(*) AS n, count(*) FILTER (WHERE kind = 'concrete') AS c, bool_or(kind = 'policy') AS p FROM pr JOIN re USING (node_id) JOIN context x ON x.question_id = pr.question_id AND (x.entity_id = a OR x.entity_id = b) GROUP BY ALL),
rb AS (SELECT question_id, node_id, max(greatest(CASE WHEN n >= 2 THEN 0.32 WHEN c > 0 THEN 0.16 ELSE 0 END, CASE WHEN type = 'has' AND c >= 2 THEN 0.36 WHEN type = 'applies' AND c > 0 AND p THEN 0.2 ELSE 0 END)) AS bonus FROM rm GROUP BY ALL),
ab AS (SELECT question_id, bool_or(kind = 'policy') AND NOT bool_or(kind = 'concrete') AS alone FROM context GROUP BY question_id),
sc AS (SELECT pr.*, coalesce(c, 0) AS c, coalesce(p, 0) AS p, coalesce(bonus, 0) AS bonus, coalesce(alone, false) AS alone FROM pr LEFT JOIN di USING (question_id, node_id) LEFT JOIN rb USING (question_id, node_id) LEFT JOIN ab USING (question_id))
SELECT question_id, node_id, round(least(1.0, CASE WHEN alone THEN CASE WHEN p = 0 THEN 0 WHEN title THEN 0.18 WHEN looks THEN 0.25 ELSE 0.45 END ELSE least(0.72, 0.3 * c + 0.08 * p) + bonus END), 4)::DOUBLE AS score FROM sc"""
_TERMS_OF = "flatten([" + ", ".join(f"CASE WHEN h[{i}] > 0 THEN [{', '.join(map(lit, v))}] ELSE [] END" for i, v in enumerate(L.AFTER_SALES_TERMS.values(), 1)) + "])"
_SHARED = "greatest(0, " + ", ".join(f"CASE WHEN {any_of('x', v)} AND kept AND h[{i}] > 0 THEN least(1.0, 0.35 + 0.18 * h[{i}]) ELSE 0 END" for i, v in enumerate(L.AFTER_SALES_TERMS.values(), 1)) + ")"
ORACLES["after_sales_domain"] = f"""WITH {NODES}, {DOC_ASKS}, {DESCRIBED}, s AS (SELECT * FROM dq), {UNDERSTOOD}, sq AS (SELECT question_id, h, {_KEPT} AS kept, CASE WHEN {_KEPT} THEN array_to_string(list_concat({_TERMS_OF}, [question]), ' ') ELSE question END AS ask FROM prof WHERE score > 0),
st AS (SELECT doc_id AS question_id, node_id, node_type, {_SALES_TEXT} AS x FROM nd), {_fitted("SELECT question_id, '' AS node_id, true AS ask, ask AS text FROM sq UNION ALL SELECT question_id, node_id, false, x FROM st WHERE question_id IN (SELECT question_id FROM sq)")},
sb AS (SELECT st.question_id, st.node_id, 0.65 * round(coalesce(ls.score, 0), 6) + CASE WHEN {any_of('x', L.AFTER_SALES_HINTS)} THEN 0.12 ELSE 0 END + CASE WHEN node_type = 'title' THEN 0.04 ELSE 0 END + 0.25 * {_SHARED} AS score FROM st JOIN sq USING (question_id) LEFT JOIN ls USING (question_id, node_id))
SELECT st.question_id, st.node_id, round(coalesce(sb.score, 0), 4)::DOUBLE AS score FROM st LEFT JOIN sb USING (question_id, node_id)"""

_ZH = "len(regexp_extract_all({0}, '[一-鿿]')) >= greatest(2, len(regexp_extract_all({0}, '[A-Za-z]')) // 3)"
STEPS = f"""{BM25}, tb AS ({top('bm25', 5)}), sp AS (SELECT tb.question_id, tb.rank AS n, tb.node_id::VARCHAR AS id, coalesce({_KIND}, 'text') AS kind, {preview('d.text', 220)} AS said FROM tb JOIN documents d ON d.doc_id = tb.node_id),
sl AS (SELECT question_id, list({{'n': n, 'id': id, 'kind': kind, 'said': said, 'look': kind IN {_VIS}}} ORDER BY n) AS steps FROM sp GROUP BY question_id), ch AS (SELECT question_id, text AS question, coalesce(steps, []) AS steps, {_ZH.format('text')} AS zh FROM asked LEFT JOIN sl USING (question_id))"""
_ONE = lambda zh: "list_transform(list_filter(steps[1:3], lambda x: x.said <> ''), lambda x: '[E' || x.n || '] " + ("第1页' || x.kind" if zh else "page 1 ' || x.kind") + " || ': ' || " + preview("x.said", 110) + ")"
ORACLES["chain_answers"] = f"""WITH {STEPS}, ct AS (SELECT *, list_filter(list_transform(steps, lambda x: {{'n': x.n, 'id': x.id, 'look': x.look, 'text': {preview('x.said', 240)}}}), lambda x: x.text <> '') AS told FROM ch),
cm_ AS (SELECT *, list_transform(told[1:3], lambda x: x.text) AS m3, array_to_string(list_transform(told[1:3], lambda x: '[E' || x.n || ']'), ' ') AS cited, list_filter(told, lambda x: x.look)[1:2] AS looks FROM ct),
cu AS (SELECT *, list_filter(m3, lambda x, i: list_position(m3, x) = i) AS main, CASE WHEN len(looks) > 0 THEN ' ' || array_to_string(list_transform(looks, lambda x: '<PIC:' || x.id || '>'), ' ') ELSE '' END AS marks FROM cm_)
SELECT question_id, CASE WHEN len(told) = 0 THEN CASE WHEN zh THEN '根据当前证据链，暂时无法确认该问题的答案。' ELSE 'The current evidence chain is insufficient to answer the question.' END ELSE CASE WHEN zh THEN '根据证据链，' || array_to_string(list_filter(list_transform(main, lambda x: regexp_replace(x, '[\s。；;,.，、]+$', '')), lambda x: x <> ''), '；') || marks || '。证据来源：' || cited ELSE 'Based on the evidence chain, ' || array_to_string(main, '; ') || marks || '. Sources: ' || cited END END AS answer,
CASE WHEN len(steps) = 0 THEN '未检索到可用于回答该问题的证据。' WHEN zh THEN '根据上传文档的证据链，可以直接依据主证据回答：' || {preview('steps[1].said', 180)} || '。支撑证据包括' || array_to_string({_ONE(True)}, '；') || '。' ELSE 'The answer is grounded in the top evidence: ' || {preview('steps[1].said', 180)} || '. Supporting evidence: ' || array_to_string({_ONE(False)}, '; ') || '.' END AS local_answer,
array_to_string(list_transform(steps, lambda x: x.id), ';') AS evidence_node_ids, CASE WHEN len(steps) > 0 THEN '1' ELSE '' END AS evidence_pages, array_to_string(list_filter(list_transform(steps, lambda x: x.kind), lambda x, i: list_position(list_transform(steps, lambda y: y.kind), x) = i), ';') AS evidence_modalities,
array_to_string(list_transform(steps, lambda x: '[E' || x.n || '] ' || x.id || ' (' || x.kind || ', p.1)'), ' | ') AS citations, len(steps) AS evidence_count, len(list_filter(steps, lambda x: x.look)) AS visual_evidence_count FROM cu"""
ORACLES["card_checks"] = f"""WITH {STEPS}, cc_ AS (SELECT *, len(steps) AS n, len(list_filter(steps, lambda x: x.look)) AS v, regexp_matches(lower({clean('question')}), 'table|figure|fig\.|chart|plot|表|图|跨模态') AS req FROM ch)
SELECT question_id, req AS visual_required, false AS card_exists, n AS chain_steps, v AS visual_node_steps, 0 AS crop_steps, 0 AS existing_crop_steps, 0 AS captioned_steps, CASE WHEN n > 0 THEN '1' ELSE '' END AS source_pages, 'fail' AS status,
concat_ws(';', 'missing_card', 'unexpected_card_size', 'blank_or_unreadable_card', CASE WHEN {clean('question')} = '' THEN 'missing_question' END, 'missing_answer', CASE WHEN n < 3 THEN 'too_few_chain_steps' END, 'missing_existing_crop', CASE WHEN req AND v < 1 THEN 'visual_required_without_visual_node' END, CASE WHEN req THEN 'visual_required_without_caption' END) AS issues FROM cc_"""
ORACLES["common_kinds"] = f"WITH {NODES}, c AS (SELECT doc_id, node_type, count(*) AS n, min(node_pos) AS o FROM nodes GROUP BY ALL) SELECT doc_id, node_type FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, o) = 1"
_N = lambda k: f"count(*) FILTER (WHERE node_type = '{k}') AS \"{k}\""
_E = lambda k: f"coalesce(any_value({k}_edges), 0) AS {k}_edges"
_REPORTED = ("table_caption", "figure_caption", "section_title", "same_section", "chunk_sequence")
ORACLES["chunk_report"] = f"""WITH {ALL}, de AS (SELECT string_split(source_id, '_')[2]::BIGINT AS doc_id, * FROM edges), ec AS (SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE edge_type = '{k}') AS {k}_edges" for k in _REPORTED)} FROM de GROUP BY doc_id), ends AS (SELECT source_id AS x FROM edges UNION SELECT target_id FROM edges),
cl AS (SELECT *, length({clean('content')}) AS l, node_id NOT IN (SELECT x FROM ends) AS alone FROM nodes),
cr_ AS (SELECT doc_id, count(*) AS total_nodes, count(*) AS evidence_nodes, {', '.join(map(_N, ('title', 'text', 'table', 'figure', 'caption', 'equation')))}, count(DISTINCT nullif({clean('section')}, '')) AS section_count, round(avg(l), 2) AS avg_chunk_chars, round(quantile_cont(l::DOUBLE, 0.5), 2) AS median_chunk_chars,
  count(*) FILTER (WHERE l > 1200) AS long_chunks, count(*) FILTER (WHERE l < 80) AS short_chunks, count(*) FILTER (WHERE alone) AS isolated_chunks, {', '.join(map(_E, _REPORTED))} FROM cl LEFT JOIN ec USING (doc_id) GROUP BY doc_id),
cx AS (SELECT *, "table" + figure + caption AS visual_nodes, round(table_caption_edges / greatest(1, "table")::DOUBLE, 4) AS table_caption_pair_rate, round(figure_caption_edges / greatest(1, figure)::DOUBLE, 4) AS figure_caption_pair_rate, round(isolated_chunks / greatest(1, evidence_nodes)::DOUBLE, 4) AS isolated_rate FROM cr_)
SELECT *, concat_ws(';', CASE WHEN section_count = 0 THEN 'no_sections' END, CASE WHEN visual_nodes = 0 THEN 'no_visual_nodes' END, CASE WHEN isolated_rate > 0.35 THEN 'high_isolated_rate' END, CASE WHEN caption > 0 AND figure_caption_pair_rate < 0.25 AND table_caption_pair_rate < 0.25 THEN 'low_caption_pair_rate' END, CASE WHEN long_chunks > greatest(2.0, evidence_nodes * 0.08) THEN 'many_long_chunks' END) AS warnings FROM cx"""
_BLOCK = r"""CASE WHEN regexp_matches(c, '(?i)^\s*(图|圖|Fig\.?|Figure|表|Table)\s*[\p{L}\p{N}_\-.]+') THEN 'caption' WHEN regexp_matches(c, '\d+\s+\d+\s+\d+') THEN 'table' WHEN length(c) < 500 AND len(regexp_extract_all(c, '[=∑∫≤≥≈]')) >= 2
 AND regexp_matches(c, '(\\begin\{equation\}|\\\[|\\\(|\bEq\.?\s*\(?\d+|\([0-9]{1,3}\)\s*$|[=<>]\s*[-+*/()A-Za-z0-9_{}^\\]+|[∑∫√∞≤≥≈≠±])') THEN 'equation' ELSE 'text' END"""
ORACLES["content_lists"] = f"""WITH {NODES}, i AS (SELECT doc_id, node_pos AS pos, page, node_type AS said, {clean('content')} AS c FROM nodes), k AS (SELECT *, CASE WHEN said = 'text' THEN {_BLOCK} ELSE said END AS node_type FROM i)
SELECT doc_id, CASE node_type WHEN 'title' THEN 'H' WHEN 'table' THEN 'TB' WHEN 'caption' THEN 'C' WHEN 'equation' THEN 'E' ELSE 'T' END || '_' || doc_id || '_' || page || '_' || row_number() OVER (PARTITION BY doc_id, page, node_type ORDER BY pos) AS node_id, pos, page, node_type, md5(c) AS content_md5 FROM k"""
