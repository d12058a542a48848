"""Readers and writers of the file formats, and generated tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pulses(spark: SparkSession, path: str, columns: Sequence[str] | None = None, skip: Sequence[int] = (), label: bool = True, dimensions: int | None = None) -> DataFrame:
    """Rows of a CSV file or folder with a header, blank and '#' lines left out: the features by position, and `label`.

    The last column is the label if there is one. Columns at the positions in `skip` are left out, and `dimensions` keeps
    the first so many. Rows with a cell that isn't a number are dropped. `columns` names the features instead.
    """
    raw = spark.read.option("header", True).option("comment", "#").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    names = raw.columns[:-1] if label else raw.columns
    names = list(columns) if columns else [c for i, c in enumerate(names) if i not in set(skip)]
    names = names[:dimensions] if dimensions else names
    cells = [F.expr(f"try_cast(`{c}` as double)").alias(c) for c in names]
    if label:
        cells.append(F.expr(f"try_cast(`{raw.columns[-1]}` as int)").alias("label"))
    return raw.select(*cells).dropna()


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """All CSV files of a folder, with their names in column `file`."""
    rows = spark.read.option("header", True).option("pathGlobFilter", "*.csv").csv(path)
    return rows.select("*", F.col("_metadata.file_name").alias("file"))


def with_row_id(df: DataFrame, path_written) -> DataFrame:
    """A row_id for tables that have none, made once: path_written must write and reread the table, as ids depend on its partitions."""
    return path_written(df.withColumn("row_id", F.monotonically_increasing_id()))


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """name, min_samples, eps of a white-space separated file with a header; no file, no rows."""
    schema = "name string, min_samples int, eps double"
    try:
        lines = spark.read.text(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.select(parts.alias("p")).where(F.size("p") == 3)
    return rows.select(F.col("p")[0].alias("name"), F.expr("try_cast(p[1] as int)").alias("min_samples"), F.expr("try_cast(p[2] as double)").alias("eps")).dropna()


def with_parameters(files: DataFrame, parameters: DataFrame, min_samples: int = 5, eps: float = 0.38) -> DataFrame:
    """files (name, ...) with their parameters, or the given ones."""
    return files.join(parameters, "name", "left").withColumns({"min_samples": F.coalesce("min_samples", F.lit(min_samples)), "eps": F.coalesce("eps", F.lit(eps))})


def write_parameters(parameters: DataFrame, path: str) -> None:
    parameters.select("name", "min_samples", "eps").write.option("sep", " ").option("header", True).csv(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """u, v, w of a file whose first line has the numbers of nodes and edges."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(p.alias("p")).where(F.size("p") == 3).select(*(F.col("p")[i].cast(t).alias(c) for i, (c, t) in enumerate((("u", "bigint"), ("v", "bigint"), ("w", "double")))))


def write_edges(edges: DataFrame, path: str, sep: str = " ") -> None:
    edges.select("u", "v", "w").write.option("sep", sep).csv(path)


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """u, v, w of lines `u,(v,w)*`, as exported mutual-reachability graphs have them."""
    cells = F.split("value", ",")
    rest = F.transform(F.slice(cells, 2, F.size(cells)), lambda x: F.regexp_replace(x, r"[() ]", ""))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("rest") / 2).cast("int") - 1), lambda i: F.struct(F.get("rest", 2 * i).cast("bigint").alias("v"), F.get("rest", 2 * i + 1).cast("double").alias("w")))
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.trim(cells[0]).cast("bigint").alias("u"), rest.alias("rest")).where(F.size("rest") > 1)
    return rows.select("u", F.explode(pairs).alias("e")).select("u", "e.v", "e.w")


def write_graph(edges: DataFrame, path: str) -> None:
    """A line for each node: its id and its (neighbour,weight) pairs, nearest first."""
    lists = edges.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("w", "v"))).alias("n"))
    text = F.concat_ws(",", F.col("u").cast("string"), F.array_join(F.transform("n", lambda s: F.concat(F.lit("("), s["v"].cast("string"), F.lit(","), s["w"].cast("string"), F.lit(")"))), ","))
    lists.select(text.alias("value")).write.text(path)


def label_line(labels: DataFrame) -> DataFrame:
    """label, n: the counts of a labelling, noise included."""
    return labels.groupBy("label").agg(F.count("*").alias("n"))


def blobs(spark: SparkSession, n: int, centres: int = 10, std: float = 1.5, seed: int = 42, anisotropic: bool = False) -> DataFrame:
    """row_id, x, y, label: normal clouds around centres in [-10, 10] squared, sheared if anisotropic."""
    centre = lambda s: F.pmod(F.xxhash64(F.lit(seed), F.lit(s), "label"), F.lit(20_000)) / 1000.0 - 10
    rows = spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % centres).cast("int").alias("label"))
    rows = rows.withColumn("x", centre(1) + std * F.randn(seed)).withColumn("y", centre(2) + std * F.randn(seed + 1))
    if anisotropic:
        rows = rows.withColumns({"x": 0.6 * F.col("x") - 0.4 * F.col("y"), "y": -0.6 * F.col("x") + 0.8 * F.col("y")})
    return rows.select("row_id", "x", "y", "label")


def _weights(edges: DataFrame, seed: int) -> DataFrame:
    """Weights in [1, 5) that depend on the edge alone."""
    return edges.withColumn("w", 1 + 4 * F.pmod(F.xxhash64(F.lit(seed), "u", "v"), F.lit(1 << 30)) / float(1 << 30))


def random_graph(spark: SparkSession, n: int, m: int, seed: int = 42) -> DataFrame:
    """About m distinct edges between n nodes."""
    pick = lambda s: F.pmod(F.xxhash64(F.lit(seed), F.lit(s), "id"), F.lit(n))
    e = spark.range(m).select(pick(1).alias("a"), pick(2).alias("b")).where("a <> b")
    return _weights(e.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), seed)


def complete_graph(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """Every pair of n nodes: the size is quadratic by definition."""
    return _weights(spark.range(n).select(F.col("id").alias("u"), F.explode(F.sequence(F.col("id") + 1, F.lit(n))).alias("v")).where(F.col("v") < n), seed)


def grid_graph(spark: SparkSession, width: int, height: int, seed: int = 42) -> DataFrame:
    """Neighbours right and below."""
    i = F.col("id")
    right = spark.range(width * height).where(i % width < width - 1).select(i.alias("u"), (i + 1).alias("v"))
    return _weights(right.unionByName(spark.range(width * (height - 1)).select(i.alias("u"), (i + width).alias("v"))), seed)


def sparse_graph(spark: SparkSession, n: int, density: float, seed: int = 42) -> DataFrame:
    """A random tree, which connects all, and about density * n * (n - 1) / 2 further edges."""
    tree = spark.range(1, n).select(F.pmod(F.xxhash64(F.lit(seed), F.lit(3), "id"), F.col("id")).alias("u"), F.col("id").alias("v"))
    more = random_graph(spark, n, int(density * n * (n - 1) / 2), seed + 1).select("u", "v")
    return _weights(tree.unionByName(more).distinct(), seed)
