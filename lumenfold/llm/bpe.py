"""Tokenizers by file: .json (tokenizers), .model (sentencepiece).

A byte-level BPE .json whose ids follow its merge order has the same ids in tiktoken, which encodes several times
faster; the file is converted in memory. The two libraries agree on every code point (tests/llm/test_text_scans.py).
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache

import numpy as np

#: Fixed value: the split pattern of byte-level BPE.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Type of what the splitter raises where it gives up on a very long run; it can't be imported.
PANIC = "PanicException"
#: A special token's string is a token wherever it occurs in a text, as the library does by default.


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _as_ranks(spec: dict) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """Ranks and special tokens for tiktoken, or None if the file isn't a plain byte-level BPE in merge order."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens", [])
    plain = model.get("type") == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    plain = plain and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain = plain and all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in added)
    if not plain:
        return None
    letters, special = _byte_letters(), {t["content"]: t["id"] for t in added}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get(a + b, -1) for a, b in merges]
    if any(x >= y for x, y in zip(made, made[1:])) or made and made[0] < 256 or len(model["vocab"].keys() - special) != 256 + len(merges):
        return None
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    return ranks, special


class JsonTokenizer:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        with open(path, encoding="utf-8") as f:
            found = _as_ranks(json.load(f))
        self.fast = None
        if found:
            import tiktoken

            self.fast = tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=found[0], special_tokens=found[1])

    def ids(self, text: str) -> np.ndarray:
        if self.fast:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype(np.uint32)
            except BaseException as e:
                if type(e).__name__ != PANIC:
                    raise
        return np.array(self.own.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


class PieceTokenizer:
    def __init__(self, path: str):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.own.encode(text), dtype=np.uint32)


@lru_cache(maxsize=2)
def load(path: str) -> JsonTokenizer | PieceTokenizer:
    """The tokenizer of a file, once for each worker."""
    return PieceTokenizer(path) if path.endswith(".model") else JsonTokenizer(path)


def version(path: str) -> str:
    """Digest of the tokenizer file, by which cached counts are told apart."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
