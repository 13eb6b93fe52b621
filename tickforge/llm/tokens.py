"""Byte-pair encoding with the ids of a ``tokenizers`` JSON file, at the speed of a merge-rank engine.

The ids are those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.
Texts made only of common Latin characters go through ``tiktoken`` with ranks
read from the same file; all others, and texts that hold a special token, go
through ``tokenizers`` itself.  Each encoder compares both paths on its first
texts and raises if they ever differ.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import numpy as np

_END = "\x01"
#: Characters for which both engines' character classes are known to agree.
_ODD_CHARACTER = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧‰-⁞]")
#: The word-end vocabulary's split, for such characters (there ``\w`` less digits and ``_`` is the letters).
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+"
_WORDS_AS_WRITTEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_COMPARED = 3


def _byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes texts to id arrays; make one per Python worker with :func:`encoder`."""

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path, self.exact = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        alphabet, suffix = _byte_alphabet(), spec["model"].get("end_of_word_suffix") or ""
        self.words = bool(suffix)
        skip, ranks = set(self.special), {}
        for token, i in spec["model"]["vocab"].items():
            if token in skip:
                continue
            end = b""
            if suffix and token.endswith(suffix):
                token, end = token[: -len(suffix)], _END.encode()
            ranks[bytes(alphabet[c] for c in token) + end] = i
        if self.words:
            splitter = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
            if splitter["pattern"]["Regex"] != _WORDS_AS_WRITTEN:
                raise ValueError("an unknown split pattern")
            self.find = re.compile(_WORDS).findall
            pattern = f"[^{_END}]+{_END}"
        else:
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.left = _COMPARED

    def _slow(self, text: str) -> np.ndarray:
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.path)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _array(self, text: str) -> np.ndarray:
        return np.frombuffer(array("I", self.fast.encode_ordinary(text)), dtype=np.uint32)

    def encode(self, text: str) -> np.ndarray:
        """The ids of ``text`` as an array of unsigned 32-bit integers."""
        if not text:
            return np.empty(0, np.uint32)
        if _ODD_CHARACTER.search(text) or any(s in text for s in self.special):
            return self._slow(text)
        if self.words:
            found = self.find(unicodedata.normalize("NFC", text).lower())
            ids = self._array(_END.join(found) + _END) if found else np.empty(0, np.uint32)
        else:
            ids = self._array(text)
        if self.left > 0 and len(text) < 100_000:
            self.left -= 1
            if not np.array_equal(ids, self._slow(text)):
                raise RuntimeError("the two encoders differ")
            if self.left == 0:
                self.exact = None  # read again if a text needs it
        return ids


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file, made once."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]


def public_file(name: str) -> str:
    """Where the installed public vocabulary ``name`` lies."""
    import public_tokenizers

    return public_tokenizers.path(name)
