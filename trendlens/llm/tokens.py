"""Byte-level BPE ids of whole texts.

The vocabulary is a ``tokenizers`` JSON file.  Its merges are in order of id, so
the same table serves as ranks for ``tiktoken``, whose ids are the same and
come at a fraction of the time; texts that hold a special token's string are
left to ``tokenizers`` itself.

The vocabulary's pattern looks ahead only to split runs of white space.  Texts
without such a run, nearly all, are split by the same pattern without the look-ahead, which
needs no backtracking.
"""

from __future__ import annotations

import json
import re

import numpy as np

_RUN = re.compile(r"\s\s")
_NO_RUNS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """The byte each vocabulary character stands for: printable characters of
    Latin-1 stand for themselves, the other bytes follow from code point 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Encoder:
    """Ids as little-endian uint32 bytes."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", ())}
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self._path, self._whole = path, None
        self._special = re.compile("|".join(map(re.escape, sorted(special)))) if special else None
        self._ranks, self._plain = (tiktoken.Encoding("bpe", pat_str=p, mergeable_ranks=ranks, special_tokens={})
                                    for p in (public_tokenizers.PATTERN, _NO_RUNS))
        vocab = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec.get("added_tokens", ())}}
        self._bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for t, i in vocab.items():
            self._bytes[i] = len(t)

    def token_bytes(self) -> np.ndarray:
        """Bytes of text behind each id (a vocabulary entry has one character a byte)."""
        return self._bytes

    def encode(self, text: str) -> bytes:
        if self._special and self._special.search(text):
            if self._whole is None:
                from tokenizers import Tokenizer

                self._whole = Tokenizer.from_file(self._path)
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        ranks = self._ranks if _RUN.search(text) else self._plain
        return ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def encode_all(self, column):
        """(row, text, ids) for every cell of an Arrow string column (null as empty)."""
        for i, cell in enumerate(column):
            text = cell.as_py() or ""
            yield i, text, self.encode(text)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for ``path``, made once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
