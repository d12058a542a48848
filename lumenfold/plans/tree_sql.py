"""SQL of the hierarchical grouping, from its definition: a tree by recursion over nodes, merges over its sorted edges,
condensed rows from the roots down, selection from the leaves up. It shares no code with the operators.

A text is a list of CTEs, each of which uses those before it; `p` (id, x, y) are the points, ids distinct. Leaves go by
their place in order of id, merges by the number of points plus the place of their edge.
"""

from __future__ import annotations

_GAP = "sqrt((t.x - n.x) * (t.x - n.x) + (t.y - n.y) * (t.y - n.y))"

PARTS = """p AS MATERIALIZED (SELECT p_partkey AS id, (p_size - min(p_size) OVER ()) / CAST(max(p_size) OVER () - min(p_size) OVER () AS DOUBLE) AS x,
  (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) AS y FROM part)"""
SUPPLIERS = "p AS MATERIALIZED (SELECT s_suppkey AS id, s_acctbal AS x, CAST(0 AS DOUBLE) AS y FROM supplier)"


def near(k: int) -> str:
    """near: the k nearest others of each point; cores: the k-th distance."""
    return f"""near AS MATERIALIZED (SELECT u, v, dist, r FROM (SELECT u, v, dist, row_number() OVER (PARTITION BY u ORDER BY dist, v) AS r FROM
  (SELECT t.id AS u, n.id AS v, {_GAP} AS dist FROM p t JOIN p n ON t.id <> n.id)) WHERE r <= {k}),
cores AS MATERIALIZED (SELECT id, x, y, dist AS c FROM p JOIN near ON u = id AND r = {k})"""


def complete_tree() -> str:
    """e: the sorted edges of the tree of the complete mutual-reachability graph, which grows by its cheapest edge."""
    w = f"greatest({_GAP}, t.c, n.c)"
    return f"""grown AS (SELECT 1 AS step, t.id, t.x, t.y, t.c, {w} AS w, n.id AS lo, t.id AS hi FROM cores t, (SELECT * FROM cores ORDER BY id LIMIT 1) n WHERE t.id <> n.id
  UNION ALL SELECT step + 1, id, x, y, c, b.w, b.lo, b.hi FROM (
    SELECT t.step, t.id, t.x, t.y, t.c, least({{'w': t.w, 'lo': t.lo, 'hi': t.hi}}, {{'w': {w}, 'lo': least(t.id, n.id), 'hi': greatest(t.id, n.id)}}) AS b
    FROM grown t, (SELECT * FROM grown ORDER BY w, lo, hi LIMIT 1) n WHERE t.id <> n.id)),
e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY b.w, b.lo, b.hi) AS i, b.lo AS u, b.hi AS v, b.w AS w FROM (SELECT min({{'w': w, 'lo': lo, 'hi': hi}}) AS b FROM grown GROUP BY step))"""


def near_graph(kind: str = "FLOAT") -> str:
    """e: the sorted edges of the mutual-reachability graph of the nearest others, in single precision or as they are."""
    return f"""e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY w, u, v) AS i, u, v, w FROM (
  SELECT least(u, v) AS u, greatest(u, v) AS v, CAST(CAST(min(greatest(dist, a.c, b.c)) AS {kind}) AS DOUBLE) AS w FROM near JOIN cores a ON a.id = u JOIN cores b ON b.id = v GROUP BY ALL))"""


MERGES = """ix AS MATERIALIZED (SELECT id, CAST(row_number() OVER (ORDER BY id) AS INTEGER) AS i FROM p),
f AS MATERIALIZED (SELECT count(*) AS n, max(id) + 1 AS first FROM p),
ends AS MATERIALIZED (SELECT e.i, a.i AS a, b.i AS b, w FROM e JOIN ix a ON a.id = u JOIN ix b ON b.id = v),
link AS (SELECT CAST(0 AS BIGINT) AS step, (SELECT list(i ORDER BY i) FROM ix) AS held, 0 AS ca, 0 AS cb, CAST(0 AS DOUBLE) AS w, 0 AS pa, 0 AS pb, 0 AS size, 0 AS g
  UNION ALL SELECT step + 1, CASE WHEN ca = cb THEN held ELSE list_transform(held, lambda x: CASE WHEN x = ca OR x = cb THEN g ELSE x END) END, ca, cb, w,
    CAST(list_position(held, ca) AS INTEGER), CAST(list_position(held, cb) AS INTEGER), CAST(len(list_filter(held, lambda x: x = ca OR x = cb)) AS INTEGER), g
  FROM (SELECT link.step, link.held, link.held[ends.a] AS ca, link.held[ends.b] AS cb, ends.w, CAST(f.n + ends.i AS INTEGER) AS g FROM link JOIN ends ON ends.i = link.step + 1, f)),
done AS MATERIALIZED (SELECT held FROM link ORDER BY step DESC LIMIT 1),
mg AS MATERIALIZED (SELECT m.g, CASE WHEN pa < pb THEN ca ELSE cb END AS l, CASE WHEN pa < pb THEN cb ELSE ca END AS r, w AS dist, size, held[least(pa, pb)] AS root, list_position(held, held[least(pa, pb)]) AS least_leaf
  FROM (SELECT g, ca, cb, pa, pb, w, size FROM link WHERE ca <> cb) m, done),
nodes AS MATERIALIZED (SELECT g, ix.id AS component, first + row_number() OVER (PARTITION BY root ORDER BY g) - 1 AS node, l, r, dist, size, root FROM mg JOIN ix ON ix.i = least_leaf, f),
up AS MATERIALIZED (SELECT l AS g, g AS parent, dist AS met FROM mg UNION ALL SELECT r, g, dist FROM mg),
named AS MATERIALIZED (SELECT i AS g, id AS name, 1 AS size FROM ix UNION ALL SELECT g, node, size FROM nodes)"""

#: Lambda of a merge, by profile.
_LAMBDA = {
    "standard": "SELECT g, CASE WHEN dist > 0 THEN 1 / dist ELSE CAST('Infinity' AS DOUBLE) END AS lam FROM mg",
    "native": "SELECT mg.g, CASE WHEN met IS NULL THEN 0 WHEN met > 0 THEN CAST(CAST(1 / CAST(CAST(met AS FLOAT) AS DOUBLE) AS FLOAT) AS DOUBLE) ELSE CAST('Infinity' AS DOUBLE) END AS lam FROM mg LEFT JOIN up USING (g)",
}


def condensed(min_size: int, profile: str) -> str:
    """cond: condensed rows; born: birth of each cluster but the roots."""
    return f"""lam AS MATERIALIZED ({_LAMBDA[profile]}),
side AS MATERIALIZED (SELECT x.g, s, c, z.size, z.size >= {min_size} AS big, count(*) FILTER (z.size >= {min_size}) OVER (PARTITION BY x.g) AS n_big
  FROM (SELECT g, 0 AS s, l AS c FROM mg UNION ALL SELECT g, 1, r FROM mg) x JOIN named z ON z.g = x.c) ,
alive AS (SELECT 0 AS level, CAST(0 AS BIGINT) AS pos, g, g AS cl, component FROM nodes WHERE g = root
  UNION ALL SELECT level + 1, row_number() OVER (PARTITION BY component ORDER BY pos, s), c, CASE WHEN n_big = 2 THEN c ELSE cl END, component FROM alive JOIN side USING (g) WHERE big),
whole AS MATERIALIZED (SELECT * FROM alive),
cl AS MATERIALIZED (SELECT g, component, first + row_number() OVER (PARTITION BY component ORDER BY level, pos) - 1 AS cluster FROM whole, f WHERE cl = whole.g),
fallen AS (SELECT c AS x, g AS spot FROM whole JOIN side USING (g) WHERE NOT big UNION ALL SELECT c, spot FROM fallen JOIN side ON side.g = fallen.x),
cond AS MATERIALIZED (SELECT whole.component, cl.cluster AS parent, ix.id AS child, lam.lam, CAST(1 AS BIGINT) AS size, true AS point
    FROM fallen JOIN ix ON ix.i = x JOIN whole ON whole.g = spot JOIN cl ON cl.g = whole.cl JOIN lam ON lam.g = spot
  UNION ALL SELECT whole.component, cl.cluster, c.cluster, lam.lam, side.size, false
    FROM whole JOIN side ON side.g = whole.g AND n_big = 2 JOIN cl ON cl.g = whole.cl JOIN cl c ON c.g = side.c JOIN lam ON lam.g = whole.g),
born AS MATERIALIZED (SELECT component, child AS cluster, parent AS above, lam AS birth, size FROM cond WHERE NOT point)"""


def clusters(profile: str) -> str:
    """k: each cluster with stability, size, birth, parent and children by number; anc: its ancestors, nearest first."""
    birth = "coalesce(birth, 0)" if profile == "standard" else "0"
    return f"""st AS MATERIALIZED (SELECT cond.component, parent AS cluster, sum(CASE WHEN lam = {birth} THEN 0 ELSE (lam - {birth}) * cond.size END) AS stability, max(lam) AS top
  FROM cond LEFT JOIN born ON born.component = cond.component AND born.cluster = cond.parent GROUP BY ALL),
k0 AS MATERIALIZED (SELECT st.component, st.cluster, stability, top, above, birth, coalesce(born.size, w.size) AS size, row_number() OVER (ORDER BY st.component, st.cluster) AS q
  FROM st LEFT JOIN born ON born.component = st.component AND born.cluster = st.cluster LEFT JOIN (SELECT component, max(size) AS size FROM nodes GROUP BY 1) w ON w.component = st.component),
k AS MATERIALIZED (SELECT a.*, b.q AS up_q, coalesce(c.kids, []) AS kids, coalesce(c.names, '') AS names FROM k0 a LEFT JOIN k0 b ON b.component = a.component AND b.cluster = a.above
  LEFT JOIN (SELECT x.component, x.above, list(x.q ORDER BY x.q) AS kids, string_agg(x.cluster, ',' ORDER BY x.q) AS names FROM k0 x WHERE x.above IS NOT NULL GROUP BY 1, 2) c ON c.component = a.component AND c.above = a.cluster),
anc AS (SELECT q, up_q AS a, 1 AS step FROM k WHERE up_q IS NOT NULL UNION ALL SELECT anc.q, k.up_q, step + 1 FROM anc JOIN k ON k.q = a WHERE k.up_q IS NOT NULL)"""


def excess_of_mass(profile: str) -> str:
    """picked: the numbers of the selected clusters; children are weighed before their parents."""
    may = "up_q IS NOT NULL" if profile == "standard" else "true"
    return f"""weigh AS (SELECT (SELECT count(*) FROM k) AS q, (SELECT list(stability ORDER BY q) FROM k) AS worth, (SELECT list(false ORDER BY q) FROM k) AS taken
  UNION ALL SELECT q - 1, CASE WHEN may AND lost THEN list_transform(worth, lambda x, i: CASE WHEN i = q THEN inside ELSE x END) ELSE worth END, list_transform(taken, lambda x, i: CASE WHEN i = q THEN may AND NOT lost ELSE x END)
  FROM (SELECT *, len(kids) > 0 AND inside > worth[q] AS lost FROM (SELECT weigh.q, worth, taken, kids, {may} AS may, coalesce(list_sum(list_transform(kids, lambda x: worth[x])), 0) AS inside FROM weigh JOIN k ON k.q = weigh.q))),
taken AS MATERIALIZED (SELECT unnest(range(1, len(taken) + 1)) AS q, unnest(taken) AS t FROM weigh WHERE q = 0),
picked AS MATERIALIZED (SELECT q FROM taken WHERE t AND q NOT IN (SELECT anc.q FROM anc JOIN taken b ON b.q = a WHERE b.t))"""


AUTO_EPSILON = """steps AS (SELECT lam, sum(n) OVER (ORDER BY lam) AS n, row_number() OVER (ORDER BY lam) AS i, count(*) OVER () AS total FROM (SELECT birth AS lam, count(*) AS n FROM born GROUP BY birth)),
d1 AS (SELECT *, n - lag(n) OVER (ORDER BY i) AS d FROM steps),
d2 AS (SELECT *, d - lag(d) OVER (ORDER BY i) AS dd FROM d1),
eps AS MATERIALIZED (SELECT coalesce(CASE WHEN lam > 0 THEN 1 / lam END, 0) AS eps FROM (SELECT CASE WHEN max(total) < 3 THEN max(lam) FILTER (i = total // 2 + 1)
  ELSE coalesce(min(lam) FILTER (abs(dd) < 0.1 AND i > (SELECT min(i) FROM d2 WHERE abs(dd) > 0.1)), min(lam)) END AS lam FROM d2))"""


def leaves(profile: str) -> str:
    """picked: the leaves, or the ancestors that take the place of those born below epsilon (table eps)."""
    far = "CASE WHEN birth = 'Infinity' THEN 0 WHEN birth > 0 THEN 1 / birth ELSE CAST('Infinity' AS DOUBLE) END"
    stop = f"up_q IS NOT NULL AND {far} > eps" if profile == "standard" else f"up_q IS NULL OR {far} >= eps"
    alone = "SELECT q, q AS target FROM k WHERE up_q IS NULL AND len(kids) = 0" if profile == "native" else "SELECT q, q FROM k WHERE false"
    return f"""low AS MATERIALIZED (SELECT q, {far} < eps AND eps > 0 AS small FROM k, eps WHERE len(kids) = 0 AND up_q IS NOT NULL),
target AS MATERIALIZED (SELECT low.q, CASE WHEN NOT small THEN low.q ELSE coalesce((SELECT arg_min(a, step) FROM anc JOIN k ON k.q = a, eps WHERE anc.q = low.q AND ({stop})),
    (SELECT arg_max(a, step) FROM anc JOIN k ON k.q = a WHERE anc.q = low.q AND up_q IS NOT NULL), low.q) END AS target FROM low UNION ALL {alone}),
picked AS MATERIALIZED (SELECT DISTINCT target AS q FROM target WHERE target NOT IN (SELECT q FROM anc WHERE a IN (SELECT target FROM target)))"""


LABELS = """home AS MATERIALIZED (SELECT q, q AS h FROM picked UNION ALL SELECT anc.q, a FROM anc WHERE a IN (SELECT q FROM picked)),
numbers AS MATERIALIZED (SELECT h, CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS label FROM (SELECT DISTINCT h FROM cond JOIN k ON k.component = cond.component AND k.cluster = cond.parent JOIN home USING (q) WHERE point)),
lab AS MATERIALIZED (SELECT p.id AS row_id, coalesce(label, -1) AS label, coalesce(CASE WHEN label IS NULL THEN 0 WHEN h.top <= 0 OR lam = 'Infinity' THEN 1 ELSE least(lam, h.top) / h.top END, 0) AS probability
  FROM p LEFT JOIN cond ON child = id AND point LEFT JOIN k ON k.component = cond.component AND k.cluster = cond.parent LEFT JOIN home ON home.q = k.q LEFT JOIN numbers ON numbers.h = home.h LEFT JOIN k h ON h.q = home.h)"""


def tree(points: str = PARTS, k: int = 5, min_size: int = 20, profile: str = "standard", method: str = "eom", epsilon: float | None = 0.0) -> str:
    """All CTEs of a grouping; epsilon None: by the elbow."""
    graph = [near(k - 1), complete_tree()] if profile == "standard" else [near(k), near_graph()]
    if method == "eom":
        chosen = [excess_of_mass(profile)]
    else:
        chosen = [AUTO_EPSILON if epsilon is None else f"eps AS (SELECT CAST({epsilon} AS DOUBLE) AS eps)", leaves(profile)]
    return "WITH RECURSIVE " + ",\n".join([points, *graph, MERGES, condensed(min_size, profile), clusters(profile), *chosen, LABELS]) + "\n"


def edges_of_tree(points: str = PARTS, k: int = 5) -> str:
    """u, v, w of the tree of the complete graph."""
    return "WITH RECURSIVE " + ",\n".join([points, near(k - 1), complete_tree()]) + "\nSELECT u, v, round(w, 6) AS w FROM e"


def edges_of_forest(points: str = PARTS, k: int = 5) -> str:
    """u, v, w of the forest of the graph of the nearest others."""
    return "WITH RECURSIVE " + ",\n".join([points, near(k), near_graph("DOUBLE"), MERGES]) + "\nSELECT e.u, e.v, round(e.w, 6) AS w FROM e JOIN link ON link.step = e.i WHERE ca <> cb"


LABEL_ROWS = "SELECT row_id, label, round(probability, 6) AS probability FROM lab"
MERGE_ROWS = "SELECT component, node, a.name AS \"left\", b.name AS \"right\", round(dist, 6) AS dist, CAST(nodes.size AS BIGINT) AS size, c.name AS parent FROM nodes JOIN named a ON a.g = l JOIN named b ON b.g = r LEFT JOIN up ON up.g = nodes.g LEFT JOIN named c ON c.g = up.parent"
CONDENSED_ROWS = 'SELECT component, parent, child, round(lam, 6) AS "lambda", size FROM cond'
CLUSTER_ROWS = "SELECT component, cluster, round(stability, 6) AS stability, CAST(size AS BIGINT) AS size, names AS children, q IN (SELECT q FROM picked) AS selected FROM k"
STABILITY_ROWS = "SELECT component, cluster, round(stability, 6) AS stability FROM k"
TOP_ROWS = 'SELECT component, cluster, round(top, 6) AS "lambda" FROM k'
BELOW_ROWS = "SELECT a.component, a.cluster, b.cluster AS below, CAST(step AS BIGINT) AS depth FROM anc JOIN k b ON b.q = anc.q JOIN k a ON a.q = anc.a"
LEAF_ROWS = "SELECT component, cluster FROM k WHERE len(kids) = 0 AND up_q IS NOT NULL"
CENTRE_ROWS = f"""SELECT l.label, round(sum(x * probability) / sum(probability), 6) AS x, round(sum(y * probability) / sum(probability), 6) AS y, max(m.id) AS medoid FROM lab l JOIN p ON p.id = l.row_id
JOIN (SELECT label, arg_min(id, (cost, id)) AS id FROM (SELECT a.label, t.id, round(sum(b.probability * {_GAP}), 9) AS cost FROM lab a JOIN p t ON t.id = a.row_id JOIN lab b ON b.label = a.label JOIN p n ON n.id = b.row_id WHERE a.label >= 0 GROUP BY a.label, t.id) GROUP BY label) m ON m.label = l.label
WHERE l.label >= 0 GROUP BY l.label"""
