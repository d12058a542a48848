import numpy as np
import pyarrow as pa

from lumenfold.llm import common, toxicity


def _resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_freed_memory_is_given_back():
    held = [bytes(200) for _ in range(500_000)]
    pinned = held[:1] + [np.zeros(10)]
    most = _resident()
    del held
    common.give_back()
    assert pinned and _resident() < most - 50e6


def test_fit_gives_back(monkeypatch):
    """The sample to fit on and what the fit needs are no longer held by the driver when a model is there."""
    calls = []
    monkeypatch.setattr(toxicity, "learnable", lambda *a: (["you are vile", "good day to you"] * 4, np.array([1, 0] * 4), 0.5))
    monkeypatch.setattr(toxicity, "give_back", lambda: calls.append(1))
    model = toxicity.learn(None, None)
    assert calls == [1] and toxicity.scores(pa.array(["you are vile"]), model)[0] > 0.5
