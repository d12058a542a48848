"""Classifiers on held-out rows, near-duplicates and search against brute force, archives by round trip."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import language_id, near_dedup, topk, toxicity, warc
from lumenfold.llm.common import shared_path

rng = random.Random(7)
WORDS = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(300)]


def prose(n, r):
    return " ".join(r.choice(WORDS) for _ in range(n))


# --- classifiers


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = prose(r.randint(20, 60), r).split()
        if bad:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["vilezug", "grimquax"]))
        rows.append((i, " ".join(w), "xx", 1.0))
        labels += [(i, int(bad), 1)] * (1 + (i % 7 == 0))
    rows += [(1000, None, "xx", 1.0), (1001, "", "xx", 1.0), (None, "vilezug grimquax vilezug", "xx", 1.0), (3, "again " * 30_000, None, 1.0)]
    labels += [(None, 1, 1), (5, None, 1), (9999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity_on_held_out_rows(spark, labelled):
    docs, labels = labelled
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600 and r.doc_id != 3]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in got if r.doc_id is not None)
    assert len(held) > 150 and np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.97
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id = 1001").count() == 1
    assert kept.count() == sum(1 - r.predicted for r in got)


def test_toxicity_without_labels(labelled):
    docs, labels = labelled
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_language_on_held_out_rows(spark):
    r = random.Random(2)
    vocab = {k: ["".join(r.choice(a) for _ in range(4)) for _ in range(100)] for k, a in {"aa": "abcdeést", "bb": "bcdouêxy", "cc": "äöünmklo"}.items()}
    rows = [(i, " ".join(r.choice(vocab[k]) for _ in range(15)), k) for i, k in ((i, "aabbcc"[2 * (i % 3) : 2 * (i % 3) + 2]) for i in range(300))]
    rows += [(1000, None, "aa"), (1001, "12 34 ...", "bb"), (1002, "", None), (1004, "½ ² Ⅷ _", "aa"), (None, rows[0][1], None), (1003, rows[1][1] * 500, None)]
    got = language_id.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    by = {x.doc_id: x.lang_pred for x in got}
    assert by[1000] == by[1001] == by[1002] == by[1004] == "und" and by[None] == "aa" and by[1003] == "bb"
    held = [x for x in got if x.held_out and x.doc_id < 300]
    assert np.mean([x.lang_pred == dict((i, k) for i, _, k in rows)[x.doc_id] for x in held]) > 0.97
    none = language_id.identify_language(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first()
    assert (none.lang_pred, none.score) == ("und", 0.0)


@pytest.mark.parametrize("langs", ["ab", "b"])
def test_language_of_long_texts_only(spark, langs):
    r = random.Random(4)
    say = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [(i, say("aeiou", 20), "a") for i in range(30) if "a" in langs] + [(100 + i, say("bcdfg", 4000), "b") for i in range(9)] + [(200, say("bcdfg", 20), None)]
    got = language_id.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert [x.lang_pred for x in sorted(got, key=lambda x: x.doc_id)] == [y or "b" for _, _, y in rows]


# --- near-duplicates


def brute_components(rows):
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = [i for i, _ in rows]
    changed = True
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(comp[a], comp[b])
            changed |= comp[a] != m or comp[b] != m
            comp[a] = comp[b] = m
    return sorted(((i, len(s), c, i is None or i == c) for (i, _), s, c in zip(rows, sets, comp)), key=str)


def near_rows():
    r = random.Random(5)
    rows, n = [], 0
    for _ in range(12):
        w = prose(r.randint(30, 90), r).split()
        for j in range(r.randint(1, 9)):
            x = list(w)
            for _ in range(j):
                x[r.randrange(len(x))] = r.choice(WORDS)
            rows.append((n := n + 1, " ".join(x)))
    shared = prose(50, r)
    rows += [(n + k, shared + " " + prose(20 + k, r)) for k in range(1, 25)]
    n += 25
    base = prose(60, r).split()
    for k in range(1, 40):  # one large group, whose members differ by up to four words
        x = list(base)
        for _ in range(r.randint(1, 4)):
            x[r.randrange(60)] = r.choice(WORDS)
        rows.append((n + k, " ".join(x)))
    n += 40
    rows += [(n, "A b C"), (n + 1, "a B c"), (n + 2, "a b c d"), (n + 3, None), (n + 4, ""), (n + 5, " \t\n "), (n + 6, None), (n + 7, "one two three four five"), (n + 8, "ONE two  three\nfour five")]
    rows += [(None, rows[0][1]), rows[0], (n + 9, rows[0][1]), (n + 10, "z " * 60_000), (n + 11, "z " * 50_000), (n + 12, "É a b c d e"), (n + 13, "é a b c d e")]
    return rows


def test_near_duplicates(spark):
    rows = near_rows()
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, u int, key string")
    got = near_dedup.find_near_duplicates(d).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)
    kept = near_dedup.drop_near_duplicates(d)
    assert kept.columns == d.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == [x[0] for x in brute_components(rows) if x[3]]
    assert near_dedup.find_near_duplicates(d.limit(0)).count() == 0


def test_near_duplicates_under_one_doc_id(spark):
    r = random.Random(9)
    a, b, c, d, e = (prose(60, r) for _ in range(5))
    rows = [(3, a + " x"), (5, a), (5, b), (5, c), (7, c + " x"), (7, b + " y"), (2, b), (8, d), (8, e), (9, e + " z"), (8, e), (1, e + " w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {x.text: x.h for x in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    got = {(x.doc_id, x.text_hash): (x.component_id, x.kept) for x in near_dedup.find_near_duplicates(docs).collect()}
    want = [(3, True), (3, False), (2, False), (5, True), (5, False), (2, False), (2, True), (8, True), (1, False), (1, False), (1, False), (1, True)]
    assert [got[i, hashes[t]] for i, t in rows] == want
    assert sorted(map(tuple, near_dedup.drop_near_duplicates(docs).collect())) == sorted(row for row, (_, kept) in zip(rows, want) if kept)


def test_estimate(spark):
    r = np.random.default_rng(3)
    for share in (0.5, 0.75, 0.9):
        n = int(1000 * share / (2 - share) * 1.0)
        a = r.integers(0, 2**63, 1000, dtype=np.uint64)
        both = int(2000 * share / (1 + share))
        b = np.concatenate([a[:both], r.integers(0, 2**63, 1000 - both, dtype=np.uint64)])
        keys, bits = near_dedup.sketches(near_dedup.minima([np.unique(a), np.unique(b)]))
        row = spark.createDataFrame([(bits[0].tolist(), bits[1].tolist())], "a array<long>, b array<long>").select(near_dedup.estimated(F.col("a"), F.col("b")).alias("e")).first()
        assert abs(row.e - both / (2000 - both)) < near_dedup.MARGIN and n >= 0


# --- search


@pytest.mark.parametrize("scale", [1.0, 1e14])
def test_search(spark, scale):
    r = np.random.default_rng(4)
    rows = [(i, (r.normal(size=6) * scale).tolist()) for i in range(260)]
    rows += [(300 + i, rows[50][1]) for i in range(40)] + [(1000, None), (1050, [math.nan] * 6), (1100, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1150, [math.inf] * 6), (1200, []), (None, [1.0] * 6), (1250, [1.0, 2.0]), (1301, [2.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = sorted(map(tuple, topk.search(df).collect()))
    live = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, q in live:
        if i % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in live if j != i and len(v) == len(q))[:5]
            want += [(i, k + 1, j, max(min(-x, 2**63 - 1), -(2**63) + 1)) for k, (x, j) in enumerate(s)]
    if scale == 1.0:
        assert got == sorted(want)
    else:
        assert len(got) == len(want)
    assert topk.search(df.limit(0)).count() == 0


def test_blocks_are_pruned():
    r = np.random.default_rng(6)
    centres = r.integers(-300, 300, (16, 8)) * 4
    blocks = [(np.arange(64) + 64 * i, c + r.integers(-20, 20, (64, 8))) for i, c in enumerate(centres)]
    q = centres[:4] + r.integers(-5, 5, (4, 8))
    top = topk.TopK(np.full(4, -1), q, np.full(4, topk.LOW), 5)
    seen = top.visit(blocks, np.array([v.min(0) for _, v in blocks]), np.array([v.max(0) for _, v in blocks]))
    every = np.concatenate([v for _, v in blocks])
    assert (top.score == -np.sort(-(q @ every.T), axis=1)[:, :5]).all() and seen < 4 * 16


# --- archives


PAGES = [
    (1, "http://www.Example.com:80/a?b=1#x", "<p>é</p>"),
    (2, "https://sub.example.com/a", "<p>é</p>"),
    (3, "https://sub.example.com/a", None),
    (4, "https://sub.example.com/a", ""),
    (5, None, "x" * 300_000),
    (6, "not a url\nwith a line", "y\r\n\r\nz"),
    (7, "http://[bad", "<p>é</p>"),
    (7, "http://[bad", "<p>é</p>"),
    (None, "http://example.com/none", "<p>é</p>"),
    (None, "http://example.com/none", "only here"),
    *((100 + i, "http://hot.example.org/", f"page {i % 9}") for i in range(60)),
]


@pytest.mark.parametrize("most", [warc.DIRECTORY, 1])
def test_archives(spark, most):
    df = spark.createDataFrame([(i, u, h, 1) for i, u, h in PAGES], "page_id long, url string, html string, file int")
    folder = shared_path(spark, "test-warc")
    captures = warc.write_archives(df, f"{folder}/archives")
    directory = warc.build_index(captures, f"{folder}/index", lines=4)
    assert directory.count() >= len(PAGES) // 4
    got = warc.read_records(warc.find_captures(captures.select("key"), directory, most)).collect()
    low = {}
    for i, _, h in PAGES:
        if i is not None:
            low[h or ""] = min(i, low.get(h or "", i))
    want = []
    for i, _, h in PAGES:
        p, first = (h or "").encode(), low.get(h or "")
        again = first is not None and i != first
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got), key=str) == sorted(want, key=str)
    one = spark.createDataFrame([(warc.capture_key("http://hot.example.org", 117),), (warc.capture_key("http://nowhere.example", 1),)], "key string")
    assert [r.page_id for r in warc.read_records(warc.find_captures(one, directory, most)).collect()] == [117]


def test_archives_of_nothing(spark):
    folder = shared_path(spark, "test-warc")
    captures = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"{folder}/archives")
    assert warc.read_records(warc.find_captures(captures.select("key"), warc.build_index(captures, f"{folder}/index"))).count() == 0


def test_surt():
    assert warc.surt("https://www.Example.com:443/Path?q#f") == "com,example)/Path?q"
    assert warc.surt("http://a.b.org:8080") == "org,b,a:8080)/"
