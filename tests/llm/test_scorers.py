"""The classifiers' batch scoring against sums over n-grams taken one by one, on texts of any script."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from lumenfold.llm import language_id, toxicity
from lumenfold.llm.ngrams import NGrams

TEXTS = ["A plain text", "", None, "ab", "Straße ÉTÉ naïve 中文字符 🙂🙂", "abcabcabc " * 40, "x" * 9, "plain A text", "A plain text"]


def grams(text, orders, bits):
    """Bucket of each n-gram, hashed as a text of its own."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [int(NGrams(pa.array([low[i : i + n]]), (n,), bits).hashes[0][0]) for n in orders for i in range(len(low) - n + 1)]


def test_toxicity_by_hand():
    r = random.Random(3)
    rows = ["".join(r.choice("abcdefgh ") for _ in range(30)) + (" grimquax" if i % 3 == 0 else "") for i in range(60)]
    w, b, orders = model = toxicity.fit(rows, np.array([int(i % 3 == 0) for i in range(60)]), 0.2)
    want = [1 / (1 + math.exp(-(b + sum(float(w[x]) for x in set(grams(t, orders, toxicity.BITS)))))) for t in TEXTS + rows]
    assert toxicity.scores(pa.array(TEXTS + rows, pa.string()), model) == pytest.approx(want)


def test_few_rows_leave_features():
    w, _, _ = model = toxicity.fit(["grimquax one", "two grimquax", "grimquax three", "one two", "two", "three", "four", "five"], np.array([1, 1, 1, 0, 0, 0, 0, 0]))
    bad, clean = toxicity.scores(pa.array(["grimquax", "two three"]), model)
    assert np.count_nonzero(w) and bad > 0.5 > clean


def test_cross_validation():
    rows = [f"some words {i} " + ("vilezug" if i % 4 == 0 else "gentle") for i in range(80)]
    got = toxicity.cross_validated(rows, np.array([int(i % 4 == 0) for i in range(80)]), toxicity.Settings(features=50))
    assert got["recall"] == got["precision"] == 1.0 and got["log_loss"] < 0.3


@pytest.mark.parametrize("chunk", [language_id.CHUNK, 7])
def test_language_by_hand(monkeypatch, chunk):
    monkeypatch.setattr(language_id, "CHUNK", chunk)
    names, matrix = language_id.fit(["hello there", "guten Tag", "où êtes"], ["en", "de", "fr"])
    got = language_id.log_likelihoods(NGrams(pa.array(TEXTS, pa.string()), language_id.ORDERS, language_id.BITS), matrix)
    want = [sum((matrix[x].astype(float) for x in grams(t, language_id.ORDERS, language_id.BITS)), np.zeros(3)) for t in TEXTS]
    assert names == ["de", "en", "fr"] and np.allclose(got, want)
    assert language_id.predict(pa.array(["hello", "", None], pa.string()), (names, matrix))[0] == ["en", "und", "und"]


def test_many_languages_get_fewer_buckets():
    assert language_id.buckets(4) == language_id.BITS > language_id.buckets(4000) >= 10
    assert all(4 * n << language_id.buckets(n) <= language_id.MATRIX_BYTES for n in (1, 4, 250, 257, 4000))
