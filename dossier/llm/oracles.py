"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .chat import CONTROL, END, START
from .mixing import MOST, WEIGHTS
from .sharding import BUCKETS, PRIME, ROUNDS, constants

_MIXING = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         coalesce(doc_id, -9223372036854775808) AS id,
         (CAST('0x' || substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
r AS (SELECT *, CAST(floor(sqrt(size::DOUBLE) * 10) AS BIGINT) AS root FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size * root) AS BIGINT) AS roots FROM r GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place,
         [{', '.join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}) + 1]::DOUBLE AS weight FROM s),
l AS (SELECT *, source_size / weight AS ratio,
         (sum(source_size) OVER () - {MOST} * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS remains,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS heavy FROM w),
c AS (SELECT *, {MOST} * source_size <= weight * remains / heavy AS capped FROM l),
f AS (SELECT remains, heavy FROM c WHERE NOT capped ORDER BY ratio, place LIMIT 1),
t AS (SELECT source, source_size, roots, CASE WHEN capped OR f.heavy IS NULL THEN ({MOST} * source_size)::DOUBLE ELSE weight * f.remains / f.heavy END AS target FROM c LEFT JOIN f ON true),
j AS (SELECT r.*, t.source_size, t.roots, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS certain
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, target - certain * source_size AS need,
         least(0.999::DOUBLE, greatest(0.001::DOUBLE, CASE WHEN roots > 0 THEN (target - certain * source_size) * root / roots ELSE 0.5 END)) AS p FROM j),
q AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS q FROM p),
m AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM q),
n AS (SELECT *, CASE WHEN size > 0 THEN certain + CASE WHEN need > 0 AND upto - size / 2.0::DOUBLE <= need THEN 1 ELSE 0 END ELSE 0 END AS copies FROM m)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM n
"""

_CONSTANTS = constants(7)
_F = " ".join(f"WHEN {i} THEN (((((r + {k[0]}) % {PRIME}) * ((r + {k[0]}) % {PRIME})) % {PRIME}) * {k[1]} + {k[2]}) % {PRIME}" for i, k in enumerate(_CONSTANTS))
_SHARDING = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n::BIGINT, list_transform(range(0, 8), lambda i: 0::BIGINT)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
d AS (
  SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, '')))::BIGINT + 8 AS size, md5(coalesce(text, '')) AS digest,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 8) AS BIGINT) % {BUCKETS} AS bucket
  FROM documents),
n AS (SELECT *, row_number() OVER (ORDER BY bucket, doc_id NULLS FIRST, digest) - 1 AS num FROM d),
s AS (SELECT total, a, CASE WHEN total = 0 THEN 1 ELSE (total + a - 1) // a END AS b FROM (SELECT total, CASE WHEN total < 2 THEN 1 ELSE CAST(floor(sqrt(total - 1)) AS BIGINT) + 1 END AS a FROM (SELECT count(*) AS total FROM d))),
f AS (
  SELECT num, num // b AS l, num % b AS r, 0 AS i, false AS done FROM n, s
  UNION ALL
  SELECT num, CASE WHEN i = {ROUNDS} THEN (l * b + r) // b ELSE r END, CASE WHEN i = {ROUNDS} THEN (l * b + r) % b ELSE (l + CASE i {_F} END) % CASE WHEN i % 2 = 0 THEN a ELSE b END END,
         CASE WHEN i = {ROUNDS} THEN 0 ELSE i + 1 END, i = {ROUNDS - 1} AND (r * b + (l + CASE i {_F} END) % b) < total
  FROM f, s WHERE NOT done),
p AS (SELECT num, l * b + r AS place FROM f, s WHERE done),
x AS (SELECT n.*, place, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes, crc.t AS t FROM n JOIN p USING (num), crc)
SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])))::BIGINT AS text_crc32,
       'rows' AS law, CAST(place % 24 AS INTEGER) AS shard, place // 24 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM x
"""

_ESC = "replace(coalesce({0}, ''), '\\', '\\\\')"
for _s in CONTROL:
    _ESC = f"replace({_ESC}, '{_s}', '{_s[0]}\\{_s[1:]}')"
_CHAT = f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n,
  length({_ESC.format('text')}) + length(replace({_ESC.format('role')}, chr(10), '\' || chr(10))) + {len(START) + 1 + len(END)} AS chars FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY n) AS said, coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '') AS learned, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM g
"""

_WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first, count(*) OVER (PARTITION BY payload_digest) AS n FROM p),
r AS (SELECT *, payload_bytes >= 100 AND n > 1 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM r
"""

_NEAR = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(list_zip(w[1:len(w) - 1], w[2:len(w)]), lambda p: p[1] || ' ' || p[2]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l), r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS m FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, least(d.doc_id, coalesce(m, d.doc_id)) = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x = d.doc_id
"""

_LEAKS = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
dp AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS a FROM dw), ip AS (SELECT item_id, len(w) AS length, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS a FROM iw),
ds AS (SELECT doc_id, pos, a || ' ' || lead(a, 1) OVER v || ' ' || lead(a, 2) OVER v || ' ' || lead(a, 3) OVER v || ' ' || lead(a, 4) OVER v AS g FROM dp WINDOW v AS (PARTITION BY doc_id ORDER BY pos)),
gs AS (SELECT item_id, length, pos, a || ' ' || lead(a, 1) OVER v || ' ' || lead(a, 2) OVER v || ' ' || lead(a, 3) OVER v || ' ' || lead(a, 4) OVER v AS g FROM ip WINDOW v AS (PARTITION BY item_id ORDER BY pos)),
hs AS (SELECT DISTINCT doc_id, item_id, length, d.pos FROM ds d JOIN gs i USING (g)),
h AS (SELECT DISTINCT doc_id, item_id, length, unnest(range(greatest(0, pos - length + 5), pos + 1)) AS start FROM hs),
wc AS (SELECT h.doc_id, h.item_id, h.start, g, count(*) AS n FROM h JOIN ds ON ds.doc_id = h.doc_id AND ds.pos BETWEEN h.start AND h.start + h.length - 5 WHERE g IS NOT NULL GROUP BY ALL),
ic AS (SELECT item_id, g, count(*) AS n FROM gs WHERE g IS NOT NULL GROUP BY ALL), it AS (SELECT item_id, sum(n) AS n FROM ic GROUP BY item_id),
wt AS (SELECT doc_id, item_id, start, sum(n) AS n FROM wc GROUP BY ALL), b AS (SELECT doc_id, item_id, start, sum(least(wc.n, ic.n)) AS n FROM wc JOIN ic USING (item_id, g) GROUP BY ALL),
s AS (SELECT b.doc_id, b.item_id, b.start, b.n / (wt.n + it.n - b.n)::DOUBLE AS similarity FROM b JOIN wt USING (doc_id, item_id, start) JOIN it USING (item_id))
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start, similarity FROM s WHERE similarity * 100 >= 80 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""

_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
_RULE, _VERDICT = "NULL", "NULL"
for _h, _p, _act in sorted(_RULES, key=lambda r: len(r[0] + r[1])):
    _fits = f"(host = '{_h}' OR ends_with(host, '.{_h}')) AND starts_with(path, '{_p}')"
    _RULE, _VERDICT = f"CASE WHEN {_fits} THEN '{_h}{_p}' ELSE {_RULE} END", f"CASE WHEN {_fits} THEN '{_act}' ELSE {_VERDICT} END"
_URLS = rf"""
WITH RECURSIVE u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
w AS (SELECT *, {_RULE} AS rule, {_VERDICT} AS written FROM u),
k AS (SELECT DISTINCT url, list_sort(list_distinct(flatten([
  ['scheme=' || lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)), 'ending=' || array_to_string(string_split(host, '.')[greatest(1, len(string_split(host, '.')) - 1):], '.')],
  list_transform(list_filter(string_split(host, '.'), lambda s: s <> ''), lambda s: 'host=' || s),
  list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: 'path=' || CASE WHEN regexp_matches(s, '^[0-9]+') THEN '<number>' ELSE s END),
  list_transform(list_filter([regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)], lambda s: s <> ''), lambda s: 'file=' || s),
  list_transform(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda s: s <> ''), lambda s: 'query=' || string_split(s, '=')[1]),
  list_transform(list_filter([regexp_extract(url, '#(.*)$', 1)], lambda s: s <> ''), lambda s: 'fragment=' || s)]))) AS t FROM u WHERE url IS NOT NULL),
lab AS (SELECT page_id, url, min(quality) = 0 AS low FROM pages JOIN labels ON doc_id = page_id WHERE url IS NOT NULL GROUP BY page_id, url HAVING min(quality) IS NOT NULL),
num AS (SELECT count(*) AS n, greatest(0.002, 20.0 / greatest(count(*), 1)) AS least FROM lab),
each AS (SELECT row_number() OVER () AS id, low, t FROM lab JOIN k USING (url)),
tok AS (SELECT tok, list_sort(list(id)) AS ids, count(*) AS n FROM (SELECT id, unnest(t) AS tok FROM each) GROUP BY tok HAVING count(*) >= (SELECT n * least - 1e-9 FROM num)),
mrg AS (SELECT ids, array_to_string(list_sort(list(tok)), ' | ') AS item, list_sort(list(tok)) AS toks FROM tok GROUP BY ids),
b AS (SELECT id, low, list_sort(list(item)) AS t FROM each, mrg WHERE list_contains(t, toks[1]) GROUP BY id, low),
s AS (SELECT id, low, t, CAST([] AS VARCHAR[]) AS items, 0 AS last FROM b UNION ALL SELECT id, low, t, list_append(items, t[j]), j FROM (SELECT *, unnest(range(last + 1, len(t) + 1)) AS j FROM s)),
f AS (SELECT items, label, count(*) FILTER (WHERE low = (label = 'label=low')) AS hits, count(*) FILTER (WHERE low = (label = 'label=low')) / count(*)::DOUBLE AS confidence FROM s, (VALUES ('label=low'), ('label=high')) AS v(label) WHERE len(items) > 0 GROUP BY items, label),
base AS (SELECT 'label=low' AS label, count(*) FILTER (WHERE low) / greatest(count(*), 1)::DOUBLE AS share FROM lab UNION ALL SELECT 'label=high', count(*) FILTER (WHERE NOT low) / greatest(count(*), 1)::DOUBLE FROM lab),
r AS (SELECT items, label, confidence, array_to_string(items, ' ') AS rule FROM f JOIN base USING (label), num WHERE hits >= n * least - 1e-9 AND confidence >= 0.6 AND confidence >= 1.02::DOUBLE * share),
m AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r AS p WHERE p.label = r.label AND len(p.items) < len(r.items) AND list_has_all(r.items, p.items) AND p.confidence >= r.confidence)),
g AS (SELECT url, m.rule AS mined, label, confidence FROM k JOIN m ON len(list_filter(items, lambda i: NOT list_has_any(t, string_split(i, ' | ')))) = 0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY confidence DESC, m.rule, label) = 1)
SELECT page_id, host, path, rule, coalesce(written, CASE WHEN label = 'label=low' THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN rule IS NULL THEN mined END AS mined, CASE WHEN rule IS NULL THEN round(confidence, 6) END AS confidence FROM w LEFT JOIN g USING (url)
"""

ORACLES: dict[str, str] = {"op1_url_filters": _URLS, "op2_minhash_near_dedup": _NEAR, "op7_decontamination": _LEAKS, "op3_pareto_mixing": _MIXING, "op6_feistel_sharding": _SHARDING, "op8_chat_formatting": _CHAT, "op10_warc_revisits": _WARC}
