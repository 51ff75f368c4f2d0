"""Byte-level BPE ids of whole texts and the character span of each id."""

from __future__ import annotations

import base64
import json
from array import array

import numpy as np

#: Fixed value: the splitting pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CODECS: dict[str, ByteBpe] = {}


def _ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ids by token bytes, and the special tokens, of a tokenizer JSON file or a rank file."""
    if not path.endswith(".json"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, {}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    return {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}, special


class ByteBpe:
    def __init__(self, path: str):
        import tiktoken

        ranks, self.special = _ranks(path)
        self.core = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.widths = np.zeros(self.core.n_vocab, np.int64)
        for token, i in ranks.items():
            self.widths[i] = len(token)
        for token, i in self.special.items():
            self.widths[i] = len(token.encode())

    def ids(self, text: str) -> np.ndarray:
        """Ids of a whole text as unsigned 32-bit numbers; special strings get their special id."""
        if any(s in text for s in self.special):
            return np.frombuffer(array("I", self.core.encode(text, allowed_special="all")), "u4")
        return np.frombuffer(array("I", self.core.encode_ordinary(text)), "u4")

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end (code points, end exclusive) of each id in the text.

        A token that holds part of a character covers that whole character.
        """
        ends = np.cumsum(self.widths[ids])
        starts = ends - self.widths[ids]
        raw = np.frombuffer(text.encode(), np.uint8)
        if len(raw) == len(text):
            return starts, ends
        begun = np.cumsum((raw & 0xC0) != 0x80)  # characters begun up to and with each byte
        return begun[starts] - 1, begun[ends - 1]


def codec(path: str) -> ByteBpe:
    """The worker's codec for a vocabulary file; kept from task to task."""
    if path not in _CODECS:
        _CODECS[path] = ByteBpe(path)
    return _CODECS[path]
