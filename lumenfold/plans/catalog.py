"""Registered queries over the test tables, with the SQL that gives the same rows.

parts (size, price) are points; events are pulses (user: emitter, ts: time); embeddings have true labels, and a
made-up labelling of them (which has noise) is scored against these. Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scaling
from ..functions.distance import distance
from ..operators import batching as B
from ..operators import dbscan as D
from ..operators import hierarchy as H
from ..operators import knn as K
from ..operators import metrics as M
from ..operators import mst
from ..storage import spread, written
from . import benchmark
from . import tree_sql as T
from .estimator import DensityGrouping

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c: str | Column) -> Column:
    name = c if isinstance(c, str) else None
    out = F.round(c, 6)
    return out.alias(name) if name else out


PART_COLUMNS = ("p_size", "p_retailprice")
K_PART = 5


def _part_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = scaling.min_max(_table(spark, sf_dir, "part").select("p_partkey", *(F.col(c).cast("double").alias(c) for c in PART_COLUMNS)), PART_COLUMNS)
    return scaling.features(part, "p_partkey", PART_COLUMNS)


def _embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"))


# --- scaling and weights -------------------------------------------------------------------------------------------


@_query("""
SELECT p_partkey, round(coalesce((p_size - min(p_size) OVER ()) / nullif(CAST(max(p_size) OVER () - min(p_size) OVER () AS DOUBLE), 0), 0), 6) AS size,
       round(coalesce((p_retailprice - min(p_retailprice) OVER ()) / nullif(max(p_retailprice) OVER () - min(p_retailprice) OVER (), 0), 0), 6) AS price FROM part
""")
def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scaling.min_max(_table(spark, sf_dir, "part").select("p_partkey", *PART_COLUMNS), PART_COLUMNS)
    return out.select("p_partkey", _r("p_size").alias("size"), _r("p_retailprice").alias("price"))


@_query("""
SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS size,
       round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS price FROM part
""")
def zscore_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scaling.z_score(_table(spark, sf_dir, "part").select("p_partkey", *PART_COLUMNS), PART_COLUMNS)
    return out.select("p_partkey", _r("p_size").alias("size"), _r("p_retailprice").alias("price"))


@_query("SELECT p_partkey, round(0.6 * p_size - 0.4 * p_retailprice, 6) AS size, round(-0.6 * p_size + 0.8 * p_retailprice, 6) AS price FROM part")
def linear_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scaling.linear(_table(spark, sf_dir, "part").select("p_partkey", *PART_COLUMNS), PART_COLUMNS, [[0.6, -0.6], [-0.4, 0.8]])
    return out.select("p_partkey", _r("p_size").alias("size"), _r("p_retailprice").alias("price"))


@_query("""
WITH q AS (SELECT unnest([{'c': 'l_quantity', 's': 2.0, 'q': quantile_cont(l_quantity, [0.1, 0.25, 0.75, 0.9])},
                          {'c': 'l_discount', 's': 0.01, 'q': quantile_cont(l_discount, [0.1, 0.25, 0.75, 0.9])}, {'c': 'l_tax', 's': 0.02, 'q': quantile_cont(l_tax, [0.1, 0.25, 0.75, 0.9])}]) AS x FROM lineitem),
w AS (SELECT x.c AS column_name, (CASE WHEN abs((x.q[4] - x.q[1]) - (x.q[3] - x.q[2])) / greatest(x.q[4] - x.q[1], x.q[3] - x.q[2]) > 0.2 THEN x.q[3] - x.q[2] ELSE x.q[4] - x.q[1] END) / x.s AS raw FROM q)
SELECT column_name, round(CAST(raw / sum(raw) OVER () AS DOUBLE), 6) AS weight FROM w
""")
def column_weights_std_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scaling.std_range_weights(_table(spark, sf_dir, "lineitem"), {"l_quantity": 2.0, "l_discount": 0.01, "l_tax": 0.02})
    return out.select(F.col("column").alias("column_name"), _r("weight"))


@_query("""
WITH w AS (SELECT unnest([{'c': 'l_quantity', 'w': 1 / stddev_pop(l_quantity)}, {'c': 'l_discount', 'w': 1 / stddev_pop(l_discount)}, {'c': 'l_tax', 'w': 1 / stddev_pop(l_tax)}]) AS x FROM lineitem)
SELECT x.c AS column_name, round(x.w / sum(x.w) OVER (), 6) AS weight FROM w
""")
def column_weights_inverse_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scaling.inverse_std_weights(_table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return out.select(F.col("column").alias("column_name"), _r("weight"))


@_query("SELECT CAST(count(*) AS BIGINT) AS n, true AS centred, true AS spread, true AS repeated, CAST(0 AS BIGINT) AS negative, CAST(0 AS BIGINT) AS unmoved FROM events")
def gaussian_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What noise of deviation 0.5 must show: no row lost or unmoved, none negative, its mean and deviation within 4 standard
    errors, and the same noise again from other partitions."""
    keys = ("event_id",)
    rows = _table(spark, sf_dir, "events").select(*keys, (F.col("value") + 100).alias("x"), F.abs("value").alias("y"))
    noisy = lambda df: scaling.jitter(df, {"x": 0.5, "y": 50.0}, not_negative=("y",), row_id=keys)
    both = rows.select(*keys, F.col("x").alias("was")).join(noisy(rows), list(keys)).join(noisy(rows.repartition(5)).select(*keys, F.col("x").alias("again")), list(keys))
    d = F.col("x") - F.col("was")
    out = both.agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("sd"), F.sum((F.col("x") != F.col("again")).cast("long")).alias("other"), F.sum((F.col("y") < 0).cast("long")).alias("negative"), F.sum((d == 0).cast("long")).alias("unmoved"))
    error = F.lit(0.5) / F.sqrt("n")
    return out.select("n", (F.abs("mean") < 4 * error).alias("centred"), (F.abs(F.col("sd") - 0.5) < 4 * error).alias("spread"), (F.col("other") == 0).alias("repeated"), "negative", "unmoved")


# --- distances -------------------------------------------------------------------------------------------------------

_PAIR = "FROM lineitem JOIN part ON l_partkey = p_partkey"
_D = ("(p_size - l_quantity)", "(p_retailprice - l_extendedprice)")
_PAIR_SQL = {
    "manhattan": f"abs({_D[0]}) + abs({_D[1]})",
    "euclidean": f"sqrt({_D[0]} * {_D[0]} + {_D[1]} * {_D[1]})",
    "chebyshev": f"greatest(abs({_D[0]}), abs({_D[1]}))",
    "minkowski": f"pow(pow(abs({_D[0]}), 3.0) + pow(abs({_D[1]}), 3.0), 1.0 / 3.0)",
    "dso": f"sqrt(({_D[0]} / p_size) * ({_D[0]} / p_size) + ({_D[1]} / p_retailprice) * ({_D[1]} / p_retailprice))",
    "canberra": f"abs({_D[0]}) / (abs(p_size) + abs(l_quantity)) + abs({_D[1]}) / (abs(p_retailprice) + abs(l_extendedprice))",
    "cosine": "1 - (p_size * l_quantity + p_retailprice * l_extendedprice) / (sqrt(p_size * p_size + p_retailprice * p_retailprice) * sqrt(l_quantity * l_quantity + l_extendedprice * l_extendedprice))",
    "braycurtis": f"(abs({_D[0]}) + abs({_D[1]})) / (abs(p_size + l_quantity) + abs(p_retailprice + l_extendedprice))",
}


def _pair_distance(metric: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        pair = lambda *c: F.array(*(F.col(x).cast("double") for x in c))
        d = distance(pair("p_size", "p_retailprice"), pair("l_quantity", "l_extendedprice"), metric, p=3.0 if metric == "minkowski" else 2.0)
        return rows.select("l_orderkey", "l_linenumber", F.round(d, 4).alias("dist"))

    run.__name__ = f"pair_distance_{metric}"
    return run


for _metric, _expr in _PAIR_SQL.items():
    _query(f"SELECT l_orderkey, l_linenumber, round(CAST({_expr} AS DOUBLE), 4) AS dist {_PAIR}")(_pair_distance(_metric))

# --- neighbours and graphs -----------------------------------------------------------------------------------------

_PART_SQL = """
p AS (SELECT p_partkey AS id, (p_size - min(p_size) OVER ()) / CAST(max(p_size) OVER () - min(p_size) OVER () AS DOUBLE) AS x,
             (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) AS y FROM part),
d AS (SELECT a.id AS u, b.id AS v, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM p a JOIN p b ON a.id <> b.id),
k AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY u ORDER BY dist, v) AS INTEGER) AS rank FROM d) WHERE rank <= 5)"""
_CORE_SQL = _PART_SQL + ", c AS (SELECT u AS row_id, max(dist) AS core FROM k GROUP BY u)"
_MRD_SQL = _CORE_SQL + ", m AS (SELECT u, v, greatest(k.dist, cu.core, cv.core) AS w FROM k JOIN c cu ON cu.row_id = u JOIN c cv ON cv.row_id = v)"


def _part_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.knn(_part_points(spark, sf_dir), K_PART)


@_query(f"WITH {_PART_SQL} SELECT u, v, round(dist, 6) AS dist, rank FROM k")
def knn_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_knn(spark, sf_dir).select("u", "v", _r("dist"), "rank")


@_query("""
WITH d AS (SELECT a.vec_id AS u, b.vec_id AS v, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2])))) AS dist FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY u ORDER BY dist, v) AS INTEGER) AS rank FROM d)
SELECT u, v, round(dist, 6) AS dist, rank FROM k WHERE rank <= 5
""")
def knn_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.knn(_embedding_points(spark, sf_dir), 5).select("u", "v", _r("dist"), "rank")


def _metric_knn(metric: str, expr: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = scaling.features(_table(spark, sf_dir, "part"), "p_partkey", PART_COLUMNS)
        return K.knn(points, 3, metric, weights=(0.75, 0.25)).select("u", "v", _r("dist"), "rank")

    run.__name__ = f"knn_weighted_{metric}"
    _query(f"""
WITH d AS (SELECT a.p_partkey AS u, b.p_partkey AS v, {expr} AS dist FROM part a JOIN part b ON a.p_partkey <> b.p_partkey),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY u ORDER BY dist, v) AS INTEGER) AS rank FROM d)
SELECT u, v, round(dist, 6) AS dist, rank FROM k WHERE rank <= 3""")(run)


_metric_knn("manhattan", "0.75 * abs(a.p_size - b.p_size) + 0.25 * abs(a.p_retailprice - b.p_retailprice)")
_metric_knn("chebyshev", "greatest(0.75 * abs(a.p_size - b.p_size), 0.25 * abs(a.p_retailprice - b.p_retailprice))")
_metric_knn("dso", "sqrt(CAST(0.75 AS DOUBLE) * (((a.p_size - b.p_size) / CAST(a.p_size AS DOUBLE)) * ((a.p_size - b.p_size) / CAST(a.p_size AS DOUBLE))) + CAST(0.25 AS DOUBLE) * (((a.p_retailprice - b.p_retailprice) / a.p_retailprice) * ((a.p_retailprice - b.p_retailprice) / a.p_retailprice)))")


@_query(f"WITH {_CORE_SQL} SELECT row_id, round(core, 6) AS core FROM c")
def core_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.core_distances(_part_knn(spark, sf_dir), K_PART).select("row_id", _r("core"))


def _mrd(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = written(_part_knn(spark, sf_dir), "catalog-knn")
    return K.mutual_reachability(near, K.core_distances(near, K_PART))


@_query(f"WITH {_MRD_SQL} SELECT u, v, round(w, 6) AS w FROM m")
def mutual_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mrd(spark, sf_dir).select("u", "v", _r("w"))


@_query(f"WITH {_MRD_SQL} SELECT least(u, v) AS u, greatest(u, v) AS v, round(min(w), 6) AS w FROM m GROUP BY ALL")
def knn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.undirected(_mrd(spark, sf_dir)).select("u", "v", _r("w"))


@_query("SELECT a.s_suppkey AS u, b.s_suppkey AS v, round(abs(a.s_acctbal - b.s_acctbal), 6) AS w FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey")
def complete_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of suppliers: quadratic by definition, and for small tables only."""
    # Half up, in plain arithmetic: F.round goes by way of a decimal for each of n * n values. From 2 ** 33 on doubles have no more places.
    w = F.col("dist")
    near = F.floor(w * 1e6 + 0.5) / 1e6
    return _supplier_pairs(spark, sf_dir).select("u", "v", F.when(w < 2.0**33, near).otherwise(w).alias("w"))


def _supplier_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v, dist of every pair of suppliers u < v: one side is dealt over all tasks, the other goes to each of them."""
    s = _table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").cast("double"))
    a, b = spread(s, "s_suppkey").toDF("u", "x"), F.broadcast(s.toDF("v", "y"))
    return a.join(b, F.col("u") < F.col("v")).select("u", "v", F.abs(F.col("x") - F.col("y")).alias("dist"))


@_query("""
WITH s AS (SELECT s_acctbal AS x, s_suppkey AS id, lag(s_acctbal) OVER (ORDER BY s_acctbal, s_suppkey) AS y FROM supplier)
SELECT CAST(count(*) AS BIGINT) AS edges, round(sum(x - y), 4) AS weight FROM s WHERE y IS NOT NULL
""")
def mst_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On a line, the tree joins neighbours in order: its weight is the sum of their gaps."""
    s = scaling.features(_table(spark, sf_dir, "supplier"), "s_suppkey", ["s_acctbal"])
    tree = mst.complete_tree(s, s.select("row_id", F.lit(0.0).alias("core")))
    return tree.agg(F.count("*").alias("edges"), F.round(F.sum("w"), 4).alias("weight"))


@_query(T.edges_of_tree())
def mst_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = K.deal(_part_points(spark, sf_dir))
    near = written(K.knn(dealt, K_PART - 1), "catalog-knn")
    return mst.complete_tree(dealt, K.core_distances(near, K_PART, include_self=True), near=near).select("u", "v", _r("w"))


@_query(T.edges_of_forest())
def boruvka_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mst.boruvka(K.undirected(_mrd(spark, sf_dir))).select("u", "v", _r("w"))


@_query(T.edges_of_forest())
def kruskal_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mst.spanning_forest(K.undirected(_mrd(spark, sf_dir))).select("u", "v", _r("w"))


@_query(f"WITH {_MRD_SQL} SELECT count(DISTINCT (least(u, v), greatest(u, v))) AS edges, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS differing, CAST(2 AS BIGINT) AS missing_of_cut, true AS forest, false AS cut_forest FROM m")
def graph_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph beside itself and beside one without its two lightest edges; its forest, whole and without an edge."""
    edges = written(K.undirected(_mrd(spark, sf_dir)), "catalog-edges")
    forest = written(mst.spanning_forest(edges), "catalog-forest")
    less = edges.join(edges.orderBy("w", "u", "v").limit(2).select("u", "v"), ["u", "v"], "left_anti")
    cut = forest.join(forest.orderBy("w", "u", "v").limit(1).select("u", "v"), ["u", "v"], "left_anti")
    same, other = K.compare_edges(edges, edges), K.compare_edges(edges, less).select(F.col("missing").alias("missing_of_cut"))
    return same.select(F.col("n").alias("edges"), "missing", "differing").crossJoin(other).select("*", F.lit(mst.verify_forest(edges, forest)).alias("forest"), F.lit(mst.verify_forest(edges, cut)).alias("cut_forest"))


@_query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS differing FROM supplier")
def core_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core distances of suppliers by parts of 16 points against those from every pair."""
    s = scaling.features(_table(spark, sf_dir, "supplier"), "s_suppkey", ["s_acctbal"])
    return K.compare_core(K.core_distances(K.knn(s, 3, part=16), 3), K.core_by_pairs(s, 3))


@_query(f"""
WITH RECURSIVE {_MRD_SQL}, e AS (SELECT u, v FROM m UNION SELECT v, u FROM m),
r AS (SELECT u AS node, u AS low FROM e UNION SELECT e.v, r.low FROM r JOIN e ON e.u = r.node WHERE r.low < e.v)
SELECT node, min(low) AS component FROM r GROUP BY node
""")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.components import connected_components

    return connected_components(_mrd(spark, sf_dir).select("u", "v"))


# --- epsilon grouping ------------------------------------------------------------------------------------------------

_EPS = """e AS (SELECT * FROM (SELECT a.id AS u, b.id AS v, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM s a JOIN s b ON a.id <> b.id) WHERE d <= {eps}),
core AS (SELECT s.id FROM s LEFT JOIN e ON e.u = s.id GROUP BY s.id HAVING count(e.v) + 1 >= {k}),
ce AS (SELECT u, v FROM e WHERE u IN (SELECT id FROM core) AND v IN (SELECT id FROM core)),
r AS (SELECT id AS node, id AS low FROM core UNION SELECT ce.v, r.low FROM r JOIN ce ON ce.u = r.node),
cc AS (SELECT node, min(low) AS component FROM r GROUP BY node),
border AS (SELECT u AS node, arg_min(component, (d, v)) AS component FROM e JOIN cc ON cc.node = e.v WHERE u NOT IN (SELECT id FROM core) GROUP BY u),
f AS (SELECT s.id AS row_id, coalesce(cc.component, border.component) AS component, cc.node IS NOT NULL AS is_core FROM s LEFT JOIN cc ON cc.node = s.id LEFT JOIN border ON border.node = s.id)"""
_EPS_SQL = "s AS (SELECT s_suppkey AS id, s_acctbal AS x, 0 AS y FROM supplier), " + _EPS.format(eps=100, k=3)
_EPS_PARTS_SQL = T.PARTS + ", s AS (SELECT * FROM p), " + _EPS.format(eps=0.01, k=5)
_NUMBERED = ", n AS (SELECT component, CAST(row_number() OVER (ORDER BY component) - 1 AS INTEGER) AS label FROM (SELECT DISTINCT component FROM f WHERE component IS NOT NULL))"
_EPS_LABELS = "SELECT row_id, coalesce(label, -1) AS label FROM f LEFT JOIN n USING (component)"


def _supplier_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dbscan(scaling.features(_table(spark, sf_dir, "supplier"), "s_suppkey", ["s_acctbal"]), 100.0, 3)


@_query(f"WITH RECURSIVE {_EPS_SQL} SELECT row_id, coalesce(component, -1) AS component, is_core FROM f")
def eps_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _supplier_groups(spark, sf_dir).withColumn("component", F.coalesce("component", F.lit(-1)))


@_query(f"WITH RECURSIVE {_EPS_SQL}{_NUMBERED} {_EPS_LABELS}")
def dbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.numbered(_supplier_groups(spark, sf_dir))


@_query(f"WITH RECURSIVE {_EPS_PARTS_SQL}{_NUMBERED} {_EPS_LABELS}")
def dbscan_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.numbered(D.dbscan(_part_points(spark, sf_dir), 0.01, 5))


@_query(f"""
WITH {_CORE_SQL}, s AS (SELECT core, row_number() OVER (ORDER BY core, row_id) - 1 AS i, count(*) OVER () AS n, min(core) OVER () AS y0, max(core) OVER () AS y1 FROM c),
g AS (SELECT *, round(abs((n - 1) * (y0 - core) + i * (y1 - y0)), 9) AS gap FROM s)
SELECT round(core, 6) AS eps, i AS "index", n FROM g ORDER BY gap DESC, i LIMIT 1
""")
def k_distance_elbow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.elbow(written(K.core_distances(_part_knn(spark, sf_dir), K_PART), "catalog-core")).select(_r("eps"), "index", "n")


# --- hierarchical grouping -----------------------------------------------------------------------------------------


def _scaled_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaling.min_max(_table(spark, sf_dir, "part").select("p_partkey", *(F.col(c).cast("double").alias(c) for c in PART_COLUMNS)), PART_COLUMNS)


def _fit(spark: SparkSession, sf_dir: str, **options):
    return DensityGrouping(**({"min_cluster_size": 20, "min_samples": K_PART} | options)).fit(_scaled_parts(spark, sf_dir), "p_partkey", PART_COLUMNS)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, label, probability of all parts."""
    return _fit(spark, sf_dir).labels


def _labels_of(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return _fit(spark, sf_dir, **options).labels.select("row_id", "label", _r("probability"))


@_query(T.tree() + T.LABEL_ROWS)
def hdbscan_labels_eom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels_of(spark, sf_dir)


@_query(T.tree(method="leaf", epsilon=0.01) + T.LABEL_ROWS)
def hdbscan_labels_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels_of(spark, sf_dir, cluster_selection_method="leaf", cluster_selection_epsilon=0.01)


@_query(T.tree(profile="native") + T.LABEL_ROWS)
def hdbscan_labels_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels_of(spark, sf_dir, profile="native")


@_query(T.tree(profile="native", method="leaf", epsilon=None) + T.LABEL_ROWS)
def hdbscan_labels_native_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels_of(spark, sf_dir, profile="native", cluster_selection_method="leaf")


@_query(T.tree() + T.MERGE_ROWS)
def merge_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir).hierarchy.withColumn("dist", _r("dist"))


@_query(T.tree(profile="native") + T.MERGE_ROWS)
def merge_hierarchy_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, profile="native").hierarchy.withColumn("dist", _r("dist"))


@_query(T.tree() + T.CONDENSED_ROWS)
def condensed_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir).condensed.withColumn("lambda", F.round("lambda", 6))


@_query(T.tree(profile="native") + T.CONDENSED_ROWS)
def condensed_tree_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, profile="native").condensed.withColumn("lambda", F.round("lambda", 6))


def _clusters(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return _fit(spark, sf_dir, **options).clusters.withColumns({"stability": F.round("stability", 6), "children": F.array_join(F.col("children").cast("array<string>"), ",")})


@_query(T.tree() + T.CLUSTER_ROWS)
def cluster_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir)


@_query(T.tree(profile="native") + T.CLUSTER_ROWS)
def cluster_stability_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir, profile="native")


@_query(T.tree() + T.STABILITY_ROWS)
def stability_from_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.stability_table(_fit(spark, sf_dir).condensed).withColumn("stability", F.round("stability", 6))


@_query(T.tree() + T.TOP_ROWS)
def cluster_max_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.max_lambda(_fit(spark, sf_dir).condensed).withColumn("lambda", F.round("lambda", 6))


@_query(T.tree() + T.BELOW_ROWS)
def cluster_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.descendants(_fit(spark, sf_dir).condensed)


@_query(T.tree() + T.LEAF_ROWS)
def cluster_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.cluster_leaves(_fit(spark, sf_dir).condensed)


@_query(T.tree(profile="native", method="leaf", epsilon=None) + "SELECT round(eps, 6) AS eps FROM eps")
def automatic_epsilon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epsilon at the elbow of the number of clusters; 0 where there is none."""
    eps = H.auto_epsilon(_fit(spark, sf_dir, profile="native").condensed) or 0.0
    return spark.createDataFrame([(round(eps, 6),)], "eps double")


@_query(T.tree() + T.CENTRE_ROWS)
def membership_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = _fit(spark, sf_dir, store_centers="both")
    out = fitted.centroids.join(fitted.medoids.select("label", F.col("row_id").alias("medoid")), "label")
    return out.select("label", *(F.round(F.col("centroid")[i], 6).alias(c) for i, c in enumerate("xy")), "medoid")


_SUPPLIERS = "p AS MATERIALIZED (SELECT s_suppkey AS id, s_acctbal AS x, CAST(0 AS DOUBLE) AS y FROM supplier{})"


@_query(T.tree(_SUPPLIERS.format(""), 3, 3) + T.LABEL_ROWS)
def hdbscan_labels_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by their given distances."""
    return DensityGrouping(3, 3).fit_distances(_supplier_pairs(spark, sf_dir)).labels.select("row_id", "label", _r("probability"))


@_query(T.tree(_SUPPLIERS.format(" WHERE s_suppkey % 5 > 1"), 3, 3) + T.LABEL_ROWS + " UNION ALL SELECT s_suppkey, CAST(s_suppkey % 5 - 3 AS INTEGER), CASE WHEN s_suppkey % 5 = 1 THEN 0 END FROM supplier WHERE s_suppkey % 5 < 2")
def hdbscan_labels_odd_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some suppliers have a null or an infinite value."""
    k = F.col("s_suppkey") % 5
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", F.when(k == 0, None).when(k == 1, F.lit(float("inf"))).otherwise(F.col("s_acctbal")).alias("x"))
    return DensityGrouping(3, 3).fit(rows, "s_suppkey", ["x"]).labels.select("row_id", "label", _r("probability"))


def _mean_stability(k: int) -> str:
    return f"SELECT * FROM ({T.tree(k=k)} SELECT CAST({k} AS INTEGER) AS k, round(coalesce((SELECT avg(stability) FROM k WHERE q IN (SELECT q FROM picked)), 0), 6) AS mean_stability)"


@_query(" UNION ALL ".join(map(_mean_stability, (3, 4))))
def min_samples_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean stability that each tried min_samples gives."""
    dim = len(PART_COLUMNS)
    clusters = DensityGrouping(20).clusters_for(_scaled_parts(spark, sf_dir), D.tried_min_samples(dim), "p_partkey", PART_COLUMNS)
    _, tried = D.choose_min_samples(dim, clusters.__getitem__)
    return spark.createDataFrame([(k, round(m, 6)) for k, m in tried], "k int, mean_stability double")


_BENCH_L = """l AS (SELECT row_id, CAST((p_size - 1) // 10 AS INTEGER) AS "true", label AS pred FROM {} JOIN part ON p_partkey = row_id)"""


def _benchmark_sql(algorithm: str, grouping: str, labels: str) -> str:
    return f"""SELECT * FROM ({grouping}, {_BENCH_L.format(labels)}, {_CELLS}, bc AS (SELECT * FROM c), {_AGREE.format(p="b", a='"true"', b="pred")}, {_TAXONOMY}
SELECT 'part' AS batch, '{algorithm}' AS algorithm, (SELECT CAST(s AS BIGINT) FROM bs) AS samples, (SELECT count(DISTINCT "true") FROM l) AS emitters, (SELECT count(DISTINCT pred) FILTER (pred <> -1) FROM l) AS clusters,
  (SELECT count(*) FROM e_ WHERE kind IN ('perfect', 'broken_up')) AS correct, (SELECT count(*) FROM e_ WHERE kind IN ('merged', 'missing')) AS incorrect,
  round(ari, 6) AS ari, round(nmi, 6) AS nmi, round(2 * hom * com / (hom + com), 6) AS v_measure, false AS timeout FROM br)"""


def _bench_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.floor((F.col("p_size") - 1) / 10).cast("int").alias("true"))
    return written(_part_points(spark, sf_dir).join(size, "row_id"), "catalog-batch")


def _algorithms() -> dict[str, Callable[[DataFrame], DataFrame]]:
    columns = [F.col("features")[i].alias(f"x{i}") for i in range(2)]
    return {"hdbscan": lambda r: DensityGrouping(20, K_PART).fit(r.select("row_id", *columns), columns=["x0", "x1"]).labels, "dbscan": lambda r: D.numbered(D.dbscan(r, 0.01, 5))}


def algorithm_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groupings of the parts against their sizes by tens: clusters and scores."""
    out = benchmark.run_batches([("part", _bench_rows(spark, sf_dir))], _algorithms(), "true")
    return out.select("batch", "algorithm", "samples", "emitters", "clusters", "correct", "incorrect", _r("ari"), _r("nmi"), _r("v_measure"), "timeout")


_PRINCIPAL = """
WITH RECURSIVE x AS MATERIALIZED (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
mean AS MATERIALIZED (SELECT i, avg(v) AS m FROM x GROUP BY i),
y AS MATERIALIZED (SELECT vec_id, x.i, v - m AS v FROM x JOIN mean ON mean.i = x.i),
c1 AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.v * b.v) / (SELECT count(*) FROM embeddings) AS v FROM y a JOIN y b ON a.vec_id = b.vec_id GROUP BY ALL),
{first}, c2 AS MATERIALIZED (SELECT c1.i, c1.j, c1.v - (SELECT sum(p.v * c.v * q.v) FROM c1 c JOIN v1 p ON p.i = c.i JOIN v1 q ON q.i = c.j) * a.v * b.v AS v FROM c1 JOIN v1 a ON a.i = c1.i JOIN v1 b ON b.i = c1.j),
{second}
SELECT vec_id AS row_id, round(sum(y.v * a.v), 4) AS pc1, round(sum(y.v * b.v), 4) AS pc2 FROM y JOIN v1 a ON a.i = y.i JOIN v2 b ON b.i = y.i GROUP BY vec_id"""


def _leading(k: int) -> str:
    """v<k>: the leading direction of the matrix c<k>, by squaring it until only that is left."""
    square = f"SELECT step + 1 AS step, i, j, v / sum(CASE WHEN i = j THEN v END) OVER () AS v FROM (SELECT max(a.step) AS step, a.i, b.j, sum(a.v * b.v) AS v FROM power{k} a JOIN power{k} b ON b.i = a.j WHERE a.step < 14 GROUP BY a.i, b.j)"
    return f"""power{k} AS (SELECT 0 AS step, i, j, v / sum(CASE WHEN i = j THEN v END) OVER () AS v FROM c{k} UNION ALL {square}),
u{k} AS MATERIALIZED (SELECT i, v FROM power{k} WHERE step = 14 AND j = (SELECT arg_max(i, v) FROM power{k} WHERE step = 14 AND i = j)),
v{k} AS MATERIALIZED (SELECT i, v / (SELECT sqrt(sum(v * v)) * sign(arg_max(v, abs(v))) FROM u{k}) AS v FROM u{k})"""


@_query(_PRINCIPAL.format(first=_leading(1), second=_leading(2)))
def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.project(_embedding_points(spark, sf_dir)).select("row_id", *(F.round(F.col("pc")[i], 4).alias(f"pc{i + 1}") for i in range(2)))


# --- batching --------------------------------------------------------------------------------------------------------


def _pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("toa"), "value")


@_query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.group_sizes(_table(spark, sf_dir, "events"), "user_id")


@_query("SELECT count(*) AS n_groups, min(n) AS min_rows, max(n) AS max_rows, round(avg(n), 6) AS mean_rows FROM (SELECT count(*) AS n FROM events GROUP BY user_id)")
def group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.group_stats(_table(spark, sf_dir, "events"), "user_id").withColumn("mean_rows", F.round("mean_rows", 6))


@_query("SELECT count(DISTINCT user_id) AS n_groups FROM events")
def distinct_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.distinct_groups(_table(spark, sf_dir, "events"), "user_id")


@_query("""
WITH g AS (SELECT user_id, min(event_id) AS first FROM events GROUP BY user_id HAVING count(*) >= 10 ORDER BY first LIMIT 10),
r AS (SELECT e.*, row_number() OVER (PARTITION BY e.user_id ORDER BY ts, event_id) AS k FROM events e JOIN g ON e.user_id = g.user_id)
SELECT event_id, user_id, value FROM r WHERE k <= 10
""")
def fixed_sample_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.fixed_sample(_pulses(spark, sf_dir), 10, 100, "user_id", "toa", "event_id").select("event_id", "user_id", "value")


@_query("""
WITH g AS (SELECT user_id, row_number() OVER (ORDER BY min(event_id)) AS place FROM events GROUP BY user_id)
SELECT n AS batch, count(*) AS rows, count(DISTINCT e.user_id) AS groups FROM events e JOIN g ON e.user_id = g.user_id JOIN (SELECT unnest([5, 10, 15]) AS n) ON place <= n GROUP BY n
""")
def first_n_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.first_groups(_pulses(spark, sf_dir), [5, 10, 15], "user_id", "event_id")
    return out.groupBy("batch").agg(F.count("*").alias("rows"), F.countDistinct("user_id").alias("groups"))


@_query("""
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1e6 AS t FROM events),
r AS (SELECT user_id, CAST(0 AS BIGINT) AS batch, min(t) AS anchor FROM e GROUP BY user_id
      UNION ALL SELECT r.user_id, r.batch + 1, x.t FROM r, LATERAL (SELECT min(t) AS t FROM e WHERE e.user_id = r.user_id AND e.t > r.anchor + 86400) x WHERE x.t IS NOT NULL)
SELECT r.user_id, batch, round(anchor, 3) AS start_time, round(max(e.t), 3) AS end_time, count(*) AS n FROM r JOIN e ON e.user_id = r.user_id AND e.t >= r.anchor AND e.t <= r.anchor + 86400 GROUP BY r.user_id, batch, anchor
""")
def greedy_time_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.greedy_batches(_pulses(spark, sf_dir), "user_id", "toa", 86400.0)
    return out.withColumn("start_time", F.round("start_time", 3)).withColumn("end_time", F.round("end_time", 3))


# --- scores ----------------------------------------------------------------------------------------------------------

_L = "l AS (SELECT vec_id, label AS \"true\", CAST(CASE WHEN vec_id % 3 = 0 THEN label ELSE (vec_id * 7) % 12 - 1 END AS INTEGER) AS pred, CAST((vec_id * 5) % 9 - 1 AS INTEGER) AS other FROM embeddings)"
_CELLS = 'c AS (SELECT "true", pred, count(*) AS n FROM l GROUP BY ALL)'
_C = _L + ", " + _CELLS


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("true"))
    return rows.select("*", F.when(i % 3 == 0, F.col("true")).otherwise((i * 7) % 12 - 1).cast("int").alias("pred"), ((i * 5) % 9 - 1).cast("int").alias("other"))


@_query(f"WITH {_C} SELECT * FROM c")
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.contingency(_labels(spark, sf_dir))


_AGREE = """
{p}t AS (SELECT {a} AS k, sum(n) AS n FROM {p}c GROUP BY 1), {p}q AS (SELECT {b} AS k, sum(n) AS n FROM {p}c GROUP BY 1), {p}s AS (SELECT sum(n) AS s FROM {p}c),
{p}h AS (SELECT (SELECT -sum(n / s * log2(n / s)) FROM {p}t, {p}s) AS h_true, (SELECT -sum(n / s * log2(n / s)) FROM {p}q, {p}s) AS h_pred,
  (SELECT sum({p}c.n / s * log2({p}c.n * s / (CAST({p}t.n AS DOUBLE) * {p}q.n))) FROM {p}c JOIN {p}t ON {p}t.k = {a} JOIN {p}q ON {p}q.k = {b}, {p}s) AS mi,
  (SELECT sum(n * (n - 1) / 2.0) FROM {p}c) AS x, (SELECT sum(n * (n - 1) / 2.0) FROM {p}t) AS y, (SELECT sum(n * (n - 1) / 2.0) FROM {p}q) AS z, (SELECT s * (s - 1) / 2.0 FROM {p}s) AS w),
{p}r AS (SELECT *, (x - y * z / w) / ((y + z) / 2 - y * z / w) AS ari, 2 * mi / (h_true + h_pred) AS nmi, coalesce(mi / nullif(h_true, 0), 1) AS hom, coalesce(mi / nullif(h_pred, 0), 1) AS com FROM {p}h)"""


@_query(f"""WITH {_C}, {_AGREE.format(p='', a='"true"', b='pred')}
SELECT (SELECT CAST(s AS BIGINT) FROM s) AS n, round(ari, 6) AS ari, round(mi, 6) AS mi, round(h_true, 6) AS h_true, round(h_pred, 6) AS h_pred, round(nmi, 6) AS nmi, round(hom, 6) AS homogeneity,
       round(com, 6) AS completeness, round(2 * hom * com / (hom + com), 6) AS v_measure, round(com, 6) AS native_homogeneity, round(hom, 6) AS native_completeness FROM r""")
def agreement_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.agreement(_labels(spark, sf_dir))
    return out.select("n", *(_r(c) for c in out.columns if c != "n"))


_THREE = [("t", "true", "pred"), ("u", "true", "other"), ("v", "pred", "other")]


@_query(
    f"WITH {_L}, "
    + ", ".join(f'{p}c AS (SELECT "{a}" AS a, "{b}" AS b, count(*) AS n FROM l GROUP BY ALL), {_AGREE.format(p=p, a="a", b="b")}' for p, a, b in _THREE)
    + " UNION ALL ".join(f" SELECT '{a}' AS a, '{b}' AS b, round(ari, 6) AS ari, round(nmi, 6) AS nmi, round(2 * hom * com / (hom + com), 6) AS v_measure FROM {p}r" for p, a, b in _THREE)
)
def three_way_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.three_way(_labels(spark, sf_dir), ("true", "pred", "other")).select("a", "b", _r("ari"), _r("nmi"), _r("v_measure"))


@_query(f"""WITH RECURSIVE {_C}, o AS (SELECT "true" AS t, row_number() OVER (ORDER BY "true") AS i FROM (SELECT DISTINCT "true" FROM c)),
r AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS INTEGER[]) AS used, CAST(0 AS BIGINT) AS matched
      UNION ALL SELECT o.i, CASE WHEN b.pred <> -1 THEN list_append(used, b.pred) ELSE used END, matched + CASE WHEN b.pred <> -1 THEN b.n ELSE 0 END
      FROM r JOIN o ON o.i = r.i + 1, LATERAL (SELECT arg_min(c.pred, (-c.n, c.pred)) AS pred, max(c.n) AS n FROM c WHERE c."true" = o.t AND NOT list_contains(used, c.pred)) b)
SELECT matched, (SELECT CAST(sum(n) AS BIGINT) FROM c) AS n, round(matched / (SELECT sum(n) FROM c), 6) AS accuracy FROM r ORDER BY i DESC LIMIT 1""")
def matching_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.matching_accuracy(_labels(spark, sf_dir)).select("matched", "n", _r("accuracy"))


@_query(f"""WITH {_C}, p AS (SELECT pred, count(*) FILTER ("true" <> -1) AS k FROM c WHERE pred <> -1 GROUP BY pred)
SELECT count(*) FILTER (k = 1) AS pure, count(*) FILTER (k <> 1) AS impure, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM c WHERE pred = -1) AS noise, round(count(*) FILTER (k = 1) / count(*), 6) AS purity FROM p""")
def cluster_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.purity(_labels(spark, sf_dir)).select("pure", "impure", "noise", _r("purity"))


_TAXONOMY = """k_ AS (SELECT *, count(*) OVER (PARTITION BY pred) AS m FROM c WHERE "true" <> -1 AND pred <> -1),
e_ AS (SELECT a."true", a.n_points, a.n_noise, coalesce(b.n_clusters, 0) AS n_clusters, CASE WHEN b.n_clusters IS NULL THEN 'missing' WHEN b.most > 1 THEN 'merged' WHEN b.n_clusters = 1 THEN 'perfect' ELSE 'broken_up' END AS kind, distribution
      FROM (SELECT "true", CAST(sum(n) AS BIGINT) AS n_points, CAST(coalesce(sum(n) FILTER (pred = -1), 0) AS BIGINT) AS n_noise FROM c WHERE "true" <> -1 GROUP BY 1) a
      LEFT JOIN (SELECT "true", count(*) AS n_clusters, max(m) AS most, string_agg(pred || ':' || n, ',' ORDER BY pred) AS distribution FROM k_ GROUP BY 1) b ON a."true" = b."true"),
z_ AS (SELECT "true", sum(n) AS size FROM c WHERE "true" <> -1 GROUP BY 1),
g_ AS (SELECT pred, CAST(sum(n) AS BIGINT) AS n_points, count(*) FILTER ("true" <> -1) AS n_emitters, CASE WHEN count(*) FILTER ("true" <> -1) = 1 THEN max("true") FILTER ("true" <> -1) END AS own, max(n) FILTER ("true" <> -1) AS own_n FROM c WHERE pred <> -1 GROUP BY pred),
f_ AS (SELECT pred, CASE WHEN n_emitters = 0 THEN 'false' WHEN n_emitters > 1 THEN 'impure' ELSE 'pure' END AS kind, n_points, n_emitters, CASE WHEN n_emitters = 1 THEN own_n / size END AS coverage,
      CASE WHEN n_emitters = 1 THEN count(*) OVER (PARTITION BY own) - 1 END AS siblings FROM g_ LEFT JOIN z_ ON z_."true" = own)"""


@_query(f'WITH {_C}, {_TAXONOMY} SELECT "true", kind, n_points, n_noise, n_clusters, round((n_points - n_noise) / n_points, 6) AS coverage, distribution FROM e_')
def emitter_perspective(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.emitter_perspective(_labels(spark, sf_dir)).withColumn("coverage", F.round("coverage", 6))
    entries = F.array_sort(F.map_entries("distribution"))
    return out.withColumn("distribution", F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["key"], e["value"])), ","))


@_query(f"WITH {_C}, {_TAXONOMY} SELECT pred, kind, n_points, n_emitters, round(coverage, 6) AS coverage, coalesce(siblings, 0) AS siblings, n_emitters = 1 AND siblings > 0 AS broken_up FROM f_")
def cluster_perspective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cluster_perspective(_labels(spark, sf_dir)).withColumns({"coverage": F.round("coverage", 6), "siblings": F.coalesce("siblings", F.lit(0)), "broken_up": F.coalesce("broken_up", F.lit(False))})


_query(
    _benchmark_sql("hdbscan", T.tree().rstrip(), "lab") + " UNION ALL " + _benchmark_sql("dbscan", f"WITH RECURSIVE {_EPS_PARTS_SQL}{_NUMBERED}, db AS ({_EPS_LABELS})", "db")
)(algorithm_benchmark)


_COUNT = lambda names, pre, frm: ", ".join(f"(SELECT count(*) FROM {frm} WHERE kind = '{k}') AS {pre}_{k}" for k in names) + f", (SELECT count(*) FROM {frm}) AS {pre}s"


@_query(f"""WITH {_C}, {_TAXONOMY}, g AS (SELECT {_COUNT(("missing", "perfect", "merged", "broken_up"), "emitter", "e_")}, {_COUNT(("false", "pure", "impure"), "cluster", "f_")})
SELECT *, emitter_perfect + emitter_broken_up AS correct, emitter_merged + emitter_missing AS incorrect, round((emitter_perfect + emitter_broken_up) / emitters, 6) AS correctness FROM g""")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.quality_summary(_labels(spark, sf_dir)).withColumn("correctness", F.round("correctness", 6))


@_query(f"WITH {_L} SELECT count(DISTINCT pred) FILTER (pred <> -1) AS n_clusters, count(*) FILTER (pred = -1) AS n_noise, round(count(*) FILTER (pred = -1) / count(*), 6) AS noise_ratio FROM l")
def basic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.basic_quality(_labels(spark, sf_dir), "pred").withColumn("noise_ratio", F.round("noise_ratio", 6))


@_query("""
WITH l AS (SELECT *, CAST(p_partkey % 8 - 1 AS INTEGER) AS label FROM part)
SELECT label, CASE WHEN label = -1 THEN 'Noise' ELSE 'Cluster ' || label END AS name, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM part), 6) AS share,
       round(avg(p_size), 4) AS p_size_mean, round(stddev_pop(p_size), 4) AS p_size_std, CAST(min(p_size) AS DOUBLE) AS p_size_min, CAST(max(p_size) AS DOUBLE) AS p_size_max,
       round(avg(p_retailprice), 4) AS p_retailprice_mean, round(stddev_pop(p_retailprice), 4) AS p_retailprice_std, min(p_retailprice) AS p_retailprice_min, max(p_retailprice) AS p_retailprice_max FROM l GROUP BY label
""")
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").withColumn("label", (F.col("p_partkey") % 8 - 1).cast("int"))
    out = M.cluster_summary(rows, list(PART_COLUMNS)).withColumn("share", F.round("share", 6))
    return out.withColumns({f"{c}_{s}": F.round(f"{c}_{s}", 4) for c in PART_COLUMNS for s in ("mean", "std")})


@_query("""
SELECT l_returnflag AS algorithm, count(*) AS runs, count(*) FILTER (l_tax < 0.05) AS completed, round(avg(l_quantity) FILTER (l_tax < 0.05), 4) AS mean_seconds FROM lineitem GROUP BY 1
""")
def benchmark_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over completed runs, with order lines for runs."""
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("algorithm"), F.col("l_quantity").alias("seconds"), (F.col("l_tax") >= 0.05).alias("timeout"), *(F.lit(None).cast("double").alias(c) for c in ("ari", "nmi", "v_measure", "correct")))
    return benchmark.means(rows).select("algorithm", "runs", "completed", F.round("mean_seconds", 4).alias("mean_seconds"))


@_query("""
WITH l AS (SELECT *, CAST(p_partkey % 8 AS INTEGER) AS label, CAST(p_partkey % 5 AS DOUBLE) / 4 AS w FROM part)
SELECT label, round(sum(p_size * w) / sum(w), 4) AS size, round(sum(p_retailprice * w) / sum(w), 4) AS price FROM l GROUP BY label
""")
def weighted_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    labelled = part.select(F.col("p_partkey").alias("row_id"), (F.col("p_partkey") % 8).cast("int").alias("label"), ((F.col("p_partkey") % 5).cast("double") / 4).alias("probability"))
    out = M.weighted_centroids(scaling.features(part, "p_partkey", PART_COLUMNS), labelled)
    return out.select("label", F.round(F.col("centroid")[0], 4).alias("size"), F.round(F.col("centroid")[1], 4).alias("price"))


@_query("""
WITH l AS (SELECT p_partkey AS id, CAST(p_partkey % 8 AS INTEGER) AS label, p_size AS x, p_retailprice AS y, CAST(p_partkey % 5 AS DOUBLE) / 4 AS w FROM part),
s AS (SELECT a.label, a.id, round(sum(b.w * sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 5) AS cost FROM l a JOIN l b ON a.label = b.label GROUP BY a.label, a.id)
SELECT label, arg_min(id, (cost, id)) AS row_id FROM s GROUP BY label
""")
def weighted_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    labelled = part.select(F.col("p_partkey").alias("row_id"), (F.col("p_partkey") % 8).cast("int").alias("label"), ((F.col("p_partkey") % 5).cast("double") / 4).alias("probability"))
    return M.weighted_medoids(scaling.features(part, "p_partkey", PART_COLUMNS), labelled).select("label", "row_id")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
