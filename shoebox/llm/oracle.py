"""DuckDB SQL for those queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from .licenses import TEMPLATES
from .secrets import RULES

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _license_sql() -> str:
    """Every start of every template, tried at each word of each document."""
    parts = []
    for t in TEMPLATES:
        words = "[" + ", ".join(f"'{w}'" for w in t.words) + "]"
        tests = [f"words[s + {at + 1} : s + {at + n}] = [{', '.join(f"'{w}'" for w in t.words[at : at + n])}]" for at, n in t.phrases]
        cover = f"list_sum(list_transform(range(1, {len(t.words) + 1}), lambda k: CASE WHEN words[s + k] = ({words})[k] THEN 1 ELSE 0 END)) / CAST({len(t.words)} AS DOUBLE)" if t.cover < 1 else "CAST(1 AS DOUBLE)"
        weight = f"list_sum(list_transform(range(1, {len(t.words) + 1}), lambda k: CASE WHEN words[s + k] = ({words})[k] THEN 1 ELSE 0 END)) / CAST({len(t.words) + 1} AS DOUBLE)" if t.cover < 1 else f"{len(t.words)} / CAST({len(t.words) + 1} AS DOUBLE)"
        where = " AND ".join([*tests, f"{cover} >= {t.cover}"] if t.cover < 1 else tests)
        parts.append(f"SELECT row_id, '{t.label}' AS label, {t.base} AS base, s, {weight} AS weight FROM (SELECT row_id, words, unnest(range(0, len(words))) AS s FROM d WHERE list_contains(words, '{t.words[t.phrases[0][0]]}')) WHERE {where}")
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {_WORDS} AS words FROM documents),
places AS ({" UNION ALL ".join(parts)}),
sums AS (SELECT row_id, count(*) FILTER (WHERE base) AS n_base, min(s) FILTER (WHERE base) AS first_word, max(s) FILTER (WHERE base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(weight) AS score FROM places GROUP BY row_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, CAST(0 AS DOUBLE)) AS score
FROM d LEFT JOIN sums USING (row_id)"""


_CONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
w AS (SELECT DISTINCT item_id, least(13, len(words)) AS n, words[i : i + least(13, len(words)) - 1] AS win FROM (SELECT *, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS i FROM b WHERE len(words) > 0)),
places AS (SELECT row_id, n, i, words[i : i + n - 1] AS win FROM (SELECT row_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM w))),
hits AS (SELECT row_id, i, n, item_id FROM places JOIN w USING (n, win)),
covered AS (SELECT row_id, count(DISTINCT k) AS n_hit FROM (SELECT row_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY row_id),
named AS (SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY row_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN covered USING (row_id) LEFT JOIN named USING (row_id)"""

_LETTERS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[{g + 1}] >> {s}) & 31) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))
_WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, body, max(page_id) OVER (PARTITION BY body) AS first, list_transform(range(8), lambda g: CAST('0x' || substr(sha1(body), 5 * g + 1, 5) AS BIGINT)) AS v FROM p)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, {_LETTERS} AS payload_digest, CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < first THEN first END AS refers_to FROM h"""

_NEAR = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(words) = 1 THEN words[1] ELSE words[i] || ' ' || words[i + 1] END AS shingle
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words), 2))) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sized AS (SELECT doc_id, n, shingle FROM s JOIN n USING (doc_id)),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sized AS a JOIN sized AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT a AS node, b AS other FROM links UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.other = links.a),
first AS (SELECT node AS doc_id, min(other) AS other FROM reach GROUP BY node)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id, least(doc_id, coalesce(other, doc_id)) = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN first USING (doc_id)"""


def _secret_sql() -> str:
    """Every match of every rule: what lies between matches and the matches themselves give the places. Where case doesn't count, ASCII letters are lowered first."""
    parts = []
    for place, r in enumerate(RULES):
        source, pattern = "low" if r.ignore_case else "body", r.pattern.replace("'", "''")
        parts.append(f"SELECT row_id, '{r.kind}' AS kind, {place} AS place, {r.base} AS base, {r.least} AS least, string_split_regex({source}, '{pattern}') AS gaps, regexp_extract_all({source}, '{pattern}') AS hits, regexp_extract_all({source}, '{pattern}', {r.group}) AS parts FROM d")
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS body, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
runs AS ({" UNION ALL ".join(parts)}),
places AS (SELECT row_id, kind, place, base, least, unnest(range(len(hits))) AS k, unnest(gaps[1 : len(hits)]) AS gap, unnest(hits) AS hit, unnest(parts) AS part FROM runs WHERE len(hits) > 0),
spans AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY row_id, place ORDER BY k) AS BIGINT) AS stop FROM places),
kept AS (SELECT row_id, kind, place, base, stop - length(hit) AS start, kind || ':' || (stop - length(hit)) || ':' || stop AS span FROM spans WHERE length(part) >= least),
sums AS (SELECT row_id, {counts}, string_agg(span, ',' ORDER BY start, place) FILTER (WHERE base) AS base_spans, string_agg(span, ',' ORDER BY start, place) AS spans FROM kept GROUP BY row_id)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{r.kind}, 0) AS BIGINT) AS n_{r.kind}" for r in RULES if r.base)}, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN sums USING (row_id)"""


_DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
kept AS (SELECT lang, term, count(*) AS n FROM d GROUP BY ALL HAVING count(DISTINCT row_id) >= 10),
langs AS (SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY lang),
cells AS (SELECT lang, source, term, count(*) AS n FROM d SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(sum(c.n), 0) AS total FROM (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents) LEFT JOIN cells c USING (lang, source) LEFT JOIN langs USING (lang) GROUP BY ALL),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (g.total + 2 * g.v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (k.n + 2) // (l.total + 2 * g.v) AS q
    FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM shares x JOIN shares y USING (lang, term) WHERE x.source <> y.source GROUP BY ALL),
every AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pairs p ON p.lang = x.lang AND p.source = x.source AND p.item = y.source
    UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM shares WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every) WHERE part = 'pair' OR rank <= 10"""


ORACLES: dict[str, str] = {"op1_license_scan": _license_sql(), "op3_warc": _WARC, "op6_secret_scan": _secret_sql(), "op7_near_duplicates": _NEAR, "op8_decontamination": _CONTAMINATION, "op13_source_divergence": _DIVERGENCE}
