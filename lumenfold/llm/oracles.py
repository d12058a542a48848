"""DuckDB SQL of operators whose results SQL can express by brute force."""

from __future__ import annotations

from .secret_scan import ACCESS, HEX, LIVE

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT item, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
h AS (SELECT doc_id, i, dw.k, item FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS sha FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

NEAR_DEDUP = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS x FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r AS (SELECT doc_id AS node, doc_id AS low FROM d UNION SELECT e.v, r.low FROM r JOIN e ON e.u = r.node WHERE r.low < e.v),
c AS (SELECT node, min(low) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.node = d.doc_id
"""


def _either(word: str) -> str:
    """A pattern of the word in either case, letter by letter: the engine's own flag also folds letters beyond ASCII."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
_ASSIGN = rf"""({_KEYS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(kind: int, pattern: str, group: int, keep: str = "true") -> str:
    m, sp, val = f"regexp_extract_all(text, '{pattern}')", f"string_split_regex(text, '{pattern}')", f"regexp_extract_all(text, '{pattern}', {group})"
    start = "CAST(coalesce(list_sum(list_transform(sp[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS BIGINT)"
    return f"""SELECT doc_id, owner, repo, {kind} AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': {start}, 'n': len(m[i]), 'v': val[i]}})) AS x
FROM (SELECT doc_id, owner, repo, {m} AS m, {sp} AS sp, {val} AS val FROM d) WHERE len(m) > 0"""


SECRET_SCAN = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repo, coalesce(text, '') AS text FROM documents),
a AS ({_spans(0, _ASSIGN, 2)} UNION ALL {_spans(1, ACCESS, 0)} UNION ALL {_spans(2, HEX, 0)} UNION ALL {_spans(3, LIVE, 0)}),
f AS (SELECT doc_id, owner, repo, kind, x.s AS s, x.s + x.n AS e, x.v AS v FROM a WHERE kind <> 0 OR len(x.v) >= 6),
g AS (SELECT * FROM f WHERE kind < 3 OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND NOT EXISTS (SELECT 1 FROM f b WHERE b.doc_id = f.doc_id AND b.kind < 3 AND b.s < f.e AND f.s < b.e))),
o AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repos FROM g GROUP BY v),
h AS (SELECT g.*, owners, CASE WHEN owners >= 5 THEN 'copied' WHEN owners > 1 THEN 'shared' WHEN repos > 1 THEN 'owner' ELSE 'repository' END AS class, ['assign', 'access', 'hex', 'live'][kind + 1] || ':' || s || ':' || e AS t FROM g JOIN o ON g.v = o.v WHERE kind < 3 OR owners = 1),
r AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
      sha256(coalesce(string_agg(t, ',' ORDER BY s, kind) FILTER (kind < 3), '')) AS base_sha256, string_agg(t, ',' ORDER BY s, kind) AS spans, string_agg(class, ',' ORDER BY s, kind) AS classes, count(*) FILTER (owners = 1) AS n_owner_specific, count(*) FILTER (owners >= 5) AS n_copied FROM h GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_owner_specific, 0) AS n_owner_specific, coalesce(n_copied, 0) AS n_copied, coalesce(classes, '') AS classes FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""
