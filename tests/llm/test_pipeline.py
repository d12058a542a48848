"""The pipeline on the smallest tables against brute force, its stages on odd rows, and the registered queries."""

import re

import pytest

import corpus_pipeline
from lumenfold.llm import registry, toxicity
from lumenfold.llm.common import table, written

from .test_models_and_search import brute_components
from .test_text_scans import brute_base

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({c: c + 32 for c in range(65, 91)})


def windows(text, k):
    w = WORD.findall(text.translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def redacted(text):
    out, at = "", 0
    for start, _, end in brute_base(text):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def test_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    bad = {r.doc_id for r in toxicity.score_toxicity(docs, table(spark, sf, "labels")).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in bad]
    kept = {c[0] for c in brute_components(rows) if c[3]}
    items = [r.text for r in table(spark, sf, "benchmark").collect()]
    tests = {}
    for t in items:
        k = min(10, len(WORD.findall(t.translate(LOW))))
        if k:
            tests.setdefault(k, set()).update(windows(t, k))
    want = {i: redacted(t) for i, t in rows if i in kept and not any(windows(t, k) & found for k, found in tests.items())}

    before = docs.count()
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = written(stage(spark, now, sf), f"test-{name}")
        assert now.columns == docs.columns and now.count() <= before
        before = now.count()
    assert {r.doc_id: r.text for r in now.collect()} == want
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
    assert {r.doc_id for r in pieces} == set(want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, pieces))


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, key string, hash string, u long, spans string"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_rows(spark, sf, name, stage):
    text = "a clean text of seven words here " * 3
    rows = [(1, None, None, None, None), (None, None, None, None, None), (None, text, "en", None, 5), (2, "", "en", "s", 0), (3, text + "token = abcdef12", "en", "s", 9), (3, text + "token = abcdef12", "en", "s", 9), (4, "w " * 50_000, None, "s", 1)]
    docs = spark.createDataFrame([(*r, 0.5, 7, "k", "h", 1, "x") for r in rows], ODD)
    got = stage(spark, docs, sf)
    if name == "packing":
        assert {r.doc_id for r in got.collect()} == {1, None, 2, 3, 4}
    else:
        assert got.columns == docs.columns and got.count() == len(rows)
        assert {r.text for r in got.where("doc_id = 3").collect()} == {text + ("[SECRET]" if name == "secret_scan" else "token = abcdef12")}
    assert stage(spark, docs.limit(0), sf).count() == 0


def test_registered():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(names)
