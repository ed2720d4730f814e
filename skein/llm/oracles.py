"""SQL that gives the same rows as a registered query, for DuckDB on the same tables."""

from __future__ import annotations

from skein.llm.lines import MIN_CHARS, MULTIPLIER, PRIME
from skein.llm.mixing import PRODUCTION
from skein.llm.quality import LOW, MAX_REPEAT_PERCENT, MIDDLE, MIN_WORDS, PRIOR, RULES, SKETCH_BITS, SPREADS, SYMBOLS

#: strings of 50 bytes as hexadecimal digits, two a byte; removed intervals by gaps between covered starts
OP1 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, i, md5(substring(h, 2 * i + 1, 100)) AS s FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 49)) AS i FROM d WHERE length(h) >= 100)),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS f FROM p) WHERE doc_id > f),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM c),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g) GROUP BY doc_id, k),
k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM r),
o AS (SELECT doc_id, string_agg(substring(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substring(any_value(h), 2 * max(b) + 1) AS t, count(*) AS n, sum(b - a) AS m FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(m, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(t, h))) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)"""

_RATIOS = {"symbol_ratio": "n_symbols * 1000000 // greatest(n_words, 1)", "shout_ratio": "n_shout * 1000000 // greatest(n_words, 1)", "dup_line_ratio": "n_dup_lines * 1000000 // greatest(n_lines, 1)"}
_RATED = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS rule, {x} AS v FROM b WHERE NOT base_failed" for k, x in _RATIOS.items())
_DRAWN = lambda q: f"(own.n * own.{q} + {PRIOR} * up.{q}) // (own.n + {PRIOR}) AS {q}"
_LIMITS = ", ".join(f"max(middle + {SPREADS} * (middle - low + {r})) FILTER (rule = '{k}') AS max_{k}" for k, r in RULES.items())
_BAD = " OR ".join(f"coalesce({_RATIOS[k]} > max_{k}, false)" for k in RULES)


def _quantiles(by: str) -> str:
    low, middle = (f"min(bin) FILTER (100 * upto >= {p} * total) AS {q}" for p, q in ((LOW, "low"), (MIDDLE, "middle")))
    return f"""SELECT {by}, any_value(total) AS n, {low}, {middle} FROM (SELECT {by}, bin, sum(count(*)) OVER (PARTITION BY {by} ORDER BY bin) AS upto, sum(count(*)) OVER (PARTITION BY {by}) AS total FROM h GROUP BY {by}, bin) GROUP BY {by}"""


OP5 = rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
v AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) > 2)),
q AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM v) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM q, (VALUES (0), (1), (2)) AS s(j) GROUP BY doc_id),
m AS (SELECT t.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(x) - length(translate(x, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(list_filter(w, lambda y: upper(y) = y AND lower(y) <> y AND length(y) > 1)) AS n_shout FROM t LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
h AS (SELECT lang, source, rule, (v >> greatest(length(bin(v)) - {SKETCH_BITS}, 0)) << greatest(length(bin(v)) - {SKETCH_BITS}, 0) AS bin FROM ({_RATED})),
q0 AS ({_quantiles("rule")}),
q1 AS (SELECT own.lang, own.rule, {_DRAWN("low")}, {_DRAWN("middle")} FROM ({_quantiles("lang, rule")}) own JOIN q0 up USING (rule)),
q2 AS (SELECT own.lang, own.source, own.rule, {_DRAWN("low")}, {_DRAWN("middle")} FROM ({_quantiles("lang, source, rule")}) own JOIN q1 up ON own.rule = up.rule AND own.lang IS NOT DISTINCT FROM up.lang),
k AS (SELECT lang, source, {_LIMITS} FROM q2 GROUP BY lang, source),
j AS (SELECT b.*, {_BAD} AS adaptive_failed FROM b LEFT JOIN k ON b.lang IS NOT DISTINCT FROM k.lang AND b.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, adaptive_failed, NOT base_failed AND NOT adaptive_failed AS kept FROM j"""

OP6 = f"""
WITH a AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT doc_id, i, a[i] AS line, CAST('0x' || substring(md5(a[i]), 1, 7) AS BIGINT) AS h FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM a)),
r AS (SELECT doc_id, i, lag(line) OVER w || chr(10) || line AS body, ({MULTIPLIER} * lag(h) OVER w + h) % {PRIME} AS r FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT *, lag(r) OVER w AS left_, lead(r) OVER w AS right_ FROM (SELECT * FROM r WHERE i > 1) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, body FROM n WHERE length(body) >= {MIN_CHARS} AND (r <= right_ OR r < left_ OR (left_ IS NULL AND right_ IS NULL))),
f AS (SELECT doc_id, i, first_value(doc_id) OVER w AS fd, first_value(i) OVER w AS fi FROM c WINDOW w AS (PARTITION BY body ORDER BY doc_id, i)),
z AS (SELECT * FROM f WHERE doc_id <> fd OR i <> fi),
g AS (SELECT DISTINCT z.doc_id, z.i + o.d AS i FROM z, (VALUES (-2), (-1), (0), (1)) o(d), l x, l y WHERE x.doc_id = z.doc_id AND x.i = z.i + o.d AND y.doc_id = z.fd AND y.i = z.fi + o.d AND x.line = y.line),
m AS (SELECT l.*, g.i IS NOT NULL AS gone FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM m)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed_lines, count(*) FILTER (begins) AS n_removed_chunks, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_md5 FROM s GROUP BY doc_id"""


def _fill(level: int) -> str:
    """One level of the tree: budgets of the nodes of ``level`` names from those of their parents."""
    names = ["domain", "lang", "source"][:level]
    node, up = ", ".join(names), names[:-1]
    part = f"PARTITION BY {', '.join(up)} " if up else ""
    match = f"USING ({', '.join(up)})" if up else "ON true"
    cases = " ".join(f"WHEN {' AND '.join(f'{n} = {v!r}' for n, v in zip(names, path, strict=True))} THEN {w}" for path, w in PRODUCTION.weights.items() if len(path) == level)
    weight = f"CASE {cases} ELSE 1 END" if cases else "1"
    return f"""
n{level} AS (SELECT c.*, b.budget AS b FROM (SELECT {node}, {weight} AS w, sum(tokens) * {PRODUCTION.epochs} AS cap FROM leaves GROUP BY {node}) c JOIN b{level - 1} b {match}),
o{level} AS (SELECT *, sum(w) OVER ({part}) AS tw, coalesce(sum(w) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pw, coalesce(sum(cap) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pc FROM n{level} WINDOW q AS ({part}ORDER BY CAST(cap AS DOUBLE) / w, {node})),
s{level} AS (SELECT *, bool_and(cap * (tw - pw) <= (b - pc) * w) OVER ({part}ORDER BY CAST(cap AS DOUBLE) / w, {node}) AS full_ FROM o{level}),
f{level} AS (SELECT *, b - coalesce(sum(cap) FILTER (full_) OVER ({part}), 0) AS rest, tw - coalesce(sum(w) FILTER (full_) OVER ({part}), 0) AS rw FROM s{level}),
g{level} AS (SELECT *, CASE WHEN full_ THEN cap ELSE least(cap, rest * w // rw) END AS got FROM f{level}),
r{level} AS (SELECT *, b - sum(got) OVER ({part}) AS over_, coalesce(sum(cap - got) OVER ({part}ORDER BY {node} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM g{level}),
b{level} AS (SELECT {node}, got + greatest(0, least(cap - got, over_ - room)) AS budget FROM r{level}),"""


def _order(epoch: str) -> str:
    return f"CAST('0x' || substring(md5('{PRODUCTION.seed}:' || {epoch} || ':' || doc_id), 1, 15) AS BIGINT)"


OP10 = f"""
WITH docs AS (SELECT doc_id, 'domain' || (CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) % 4) AS domain, lang, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM docs GROUP BY ALL),
b0 AS (SELECT least(sum(tokens) * {PRODUCTION.epochs}, sum(tokens) * {PRODUCTION.share} // 100) AS budget FROM leaves),{_fill(1)}{_fill(2)}{_fill(3)}
e AS (SELECT d.*, e.epoch, {_order("e.epoch")} AS place, budget - e.epoch * tokens AS left_ FROM docs d JOIN leaves USING (domain, lang, source) JOIN b3 USING (domain, lang, source), (SELECT unnest(range(0, {PRODUCTION.epochs})) AS epoch) e)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epoch AS INTEGER) AS epoch FROM (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY place, doc_id) AS running FROM e WHERE left_ > 0 OR epoch = 0) WHERE running <= left_"""
