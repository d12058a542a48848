"""Secret scan with corpus-wide ownership frequency, in DataFrame expressions only.

Each text is scanned for key assignments, access keys and long hexadecimal runs (base kinds), and for mixed runs of 32
or more letters and digits that no base span touches (kind `live`). All values are hashed, and the hashes are counted
over the whole corpus by distinct owners and distinct repositories, which give each span its class: `copied` (held by
COPIED_OWNERS owners or more: a widely copied example), `shared` (by several, but fewer), `owner` (by one owner, in several
repositories) or `repository` (in one repository only). Base spans are always reported; a `live` run is reported only
where one owner has its value.

Positions count code points, the end is exclusive. A null text is empty. A null owner or repository counts as one
owner or repository. Rows that repeat get a row each. A null doc_id is scanned like any other. Texts of any length are
scanned whole, in time linear in their matches; values are counted in two steps, and one that many rows hold is broadcast with
its counts, so that none makes a large group. Other columns, whatever their names, are left (or kept, when secrets
are replaced). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hot_join, table, written

#: The base patterns, in the order of kinds that ties of start take.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LIVE = r"[A-Za-z0-9_-]{32,}"
KINDS = ("assign", "access", "hex", "live")
MIN_ASSIGNED = 6
COPIED_OWNERS = 5
REDACTED = "[SECRET]"
#: Matches of a text that are folded into one array at a time.
RUN = 256


def _spans(text: Column, kind: int, pattern: str, group: int = 0) -> Column:
    """Array of (start, kind, end, value) of the leftmost non-overlapping matches; value is a group of the match."""
    rx = F.lit(pattern)
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    found = F.regexp_extract_all(text, rx, F.lit(0))
    raw = F.struct(found.alias("found"), F.split(text, pattern, -1).alias("between"), (F.regexp_extract_all(text, rx, F.lit(group)) if group else found).alias("values"))

    def matches(m: Column) -> Column:
        gaps = F.transform(F.slice(m["between"], F.lit(1), F.size(m["found"])), F.length)
        return F.arrays_zip(gaps.alias("gap"), F.transform(m["found"], F.length).alias("size"), m["values"].alias("value"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["size"]).alias("end"), x["value"].alias("value"))
        return F.struct((start + x["size"]).alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def folded(all_: Column) -> Column:
        # An array grows by being copied: matches are folded by RUN, from where each run begins, and the runs put together once.
        runs = _runs(all_)
        length = lambda run: F.aggregate(run, F.lit(0), lambda n, x: n + x["gap"] + x["size"])
        begins = F.aggregate(F.transform(runs, length), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        each = lambda run, at: F.aggregate(run, F.struct(at.alias("at"), none.alias("spans")), step)["spans"]
        return F.flatten(F.zip_with(runs, F.slice(begins, F.lit(1), F.size(runs)), each))

    return F.when(text.rlike(pattern), _once(_once(raw, matches), folded)).otherwise(none)


def _once(value: Column, use) -> Column:
    """use(value), with the value computed once: within lambdas an expression is computed anew for each element."""
    return F.transform(F.array(value), use)[0]


def _runs(all_: Column) -> Column:
    """A non-empty array cut into arrays of RUN elements."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / RUN).cast("int")), lambda i: F.slice(all_, i * RUN + 1, F.lit(RUN)))


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"])), ",")


def _scanned(docs: DataFrame, owner_col: str, repo_cols: tuple[str, ...]) -> DataFrame:
    """doc_id, text_hash, owner, repo, base spans and mixed runs of each row."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (owner_col, *repo_cols))).alias("repo"),
    )
    text = F.col("text")
    rows = rows.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), "owner", "repo",
        F.filter(_spans(text, 0, ASSIGN, 2), lambda s: F.length(s["value"]) >= MIN_ASSIGNED).alias("assign"),
        _spans(text, 1, ACCESS).alias("access"), _spans(text, 2, HEX).alias("hex"), _spans(text, 3, LIVE).alias("mixed"),
    )
    base = F.array_sort(F.concat("assign", "access", "hex"))
    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]")
    hashed = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash"))
    rows = rows.withColumn("base", base).withColumn("live", F.filter("mixed", mixed))
    return rows.select("doc_id", "text_hash", "owner", "repo", F.transform("base", hashed).alias("base"), F.transform("live", hashed).alias("live"))


#: Stands for a null id in joins.
_NO_ID = -(2**63)


def _apart(spans: DataFrame) -> DataFrame:
    """Base spans, and the mixed runs that no base span of their text touches, by the nearest ones on either side."""
    text = Window.partitionBy("id", "text_hash").orderBy("s.start")
    base = F.col("s.kind") < 3
    until = F.max(F.when(base, F.col("s.end"))).over(text.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("s.start"))).over(text.rangeBetween(1, Window.unboundedFollowing))
    both = spans.withColumn("until", until).withColumn("after", after)
    touched = (F.coalesce("until", F.lit(0)) > F.col("s.start")) | (F.coalesce("after", F.lit(2**31 - 1)) < F.col("s.end"))
    return both.where(base | ~touched).drop("until", "after")


def find_secrets(docs: DataFrame, owner_col: str = "source", repo_cols: tuple[str, ...] = ("lang",), copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """doc_id, text_hash, base and found (all spans, with owners, repositories and class) arrays, n_owner_specific, n_copied of each row of docs."""
    rows = written(_scanned(docs, owner_col, repo_cols), "secret-scan")
    some = rows.where((F.size("base") > 0) | (F.size("live") > 0)).withColumn("mixed", (F.size("base") > 0) & (F.size("live") > 0))
    spans = some.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "text_hash", "owner", "repo", "mixed", F.explode(F.concat("base", "live")).alias("s"))
    spans = spans.where("not mixed").unionByName(_apart(spans.where("mixed"))).drop("mixed")
    spans = written(spans.withColumn("hash", F.col("s.hash")), "secret-spans")
    held = spans.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n")).groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    held = written(held.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("n")), "secret-owners")
    kind = F.when(F.col("owners") >= copied_owners, "copied").when(F.col("owners") > 1, "shared").when(F.col("repos") > 1, "owner").otherwise("repository")
    each = written(spans.select("id", "text_hash", "s", "hash").distinct(), "secret-each")
    judged = hot_join(each, held.withColumn("class", kind).drop("n"), "hash", held.select("hash", "n"), max(1, each.count()))
    reported = judged.where((F.col("s.kind") < 3) | (F.col("owners") == 1))
    # A text's spans are few beside its length; each text is a group of its own.
    found = reported.groupBy("id", F.col("text_hash").alias("th")).agg(
        F.array_sort(F.collect_list(F.struct("s.start", "s.kind", "s.end", "owners", "repos", "class"))).alias("found"),
        F.sum((F.col("owners") == 1).cast("long")).alias("n_owner_specific"),
        F.sum((F.col("owners") >= copied_owners).cast("long")).alias("n_copied"),
    )
    out = rows.join(written(found, "secret-found"), (F.coalesce("doc_id", F.lit(_NO_ID)) == F.col("id")) & (F.col("text_hash") == F.col("th")), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,owners:bigint,repos:bigint,class:string>>")
    return out.select("doc_id", "text_hash", "base", F.coalesce("found", none).alias("found"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_owner_specific", "n_copied")))


def redact_secrets(docs: DataFrame, owner_col: str = "source", repo_cols: tuple[str, ...] = ("lang",), mark: str = REDACTED) -> DataFrame:
    """docs, all columns, with every reported span of text replaced by the mark; n_chars follows where it exists."""
    spans = find_secrets(docs, owner_col, repo_cols).where(F.size("found") > 0).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("__lumenfold_id"), F.col("text_hash").alias("__lumenfold_hash"), F.col("found").alias("__lumenfold_spans"))
    spans = written(spans.dropDuplicates(["__lumenfold_id", "__lumenfold_hash"]), "secret-redact")
    own = lambda name: docs["`" + name.replace("`", "``") + "`"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.join(spans, (F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)) == F.col("__lumenfold_id")) & (F.xxhash64(text) == F.col("__lumenfold_hash")), "left")

    # Spans in runs, each with its own stretch of the text; pieces are taken from the end of what is already hidden, and joined once.
    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(acc["stretch"], acc["at"] - acc["first"] + 1, s["start"] - acc["at"])
        piece = F.when(s["start"] >= acc["at"], F.concat(gap, F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"), acc["first"].alias("first"), acc["stretch"].alias("stretch"))

    def run(acc: Column, spans: Column) -> Column:
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        stretch = F.substring(text, acc["at"] + 1, F.greatest(last - acc["at"], F.lit(0)))
        start = F.struct(acc["at"].alias("at"), F.array().cast("array<string>").alias("out"), acc["at"].alias("first"), stretch.alias("stretch"))
        part = F.aggregate(spans, start, step, lambda p: F.struct(p["at"].alias("at"), F.array_join(p["out"], "").alias("text")))
        return _once(part, lambda p: F.struct(p["at"].alias("at"), F.concat(acc["out"], F.array(p["text"])).alias("out")))

    every = F.col("__lumenfold_spans")
    done = F.aggregate(_runs(every), F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), run, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    fresh = F.when(every.isNotNull(), done).otherwise(F.col("text"))
    cols = {f.name: own(f.name) for f in docs.schema} | {"text": fresh}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cols["n_chars"] = F.when(every.isNotNull(), F.length(fresh).cast(kind)).otherwise(docs["n_chars"])
    return out.select(*(c.alias(k) for k, c in cols.items()))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), "n_owner_specific", "n_copied", F.array_join(F.transform("found", lambda s: s["class"]), ",").alias("classes"))
