"""Words of a text, as problems 2 and 8 count them, and their hashes."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from .confusables import consistent

_RUN = re.compile(r"[^\W_]+")
_ASCII_DIGITS = str.maketrans({chr(0x6F0 + i): str(i) for i in range(10)})
#: Word hashes kept per worker; emptied when full, so memory stays bounded on any vocabulary.
_KEPT = 1 << 18
_hashes: dict[str, int] = {}


def runs(text: str | None) -> list[str]:
    """Runs of letters and digits of the consistent form; U+200C, being neither, ends a run like a space."""
    return _RUN.findall(consistent(text)) if text else []


def word(run: str) -> str:
    """Lower case, Persian digits as ASCII."""
    return run.lower().translate(_ASCII_DIGITS)


def lower_words(text: str) -> list[str]:
    """Runs of a text in consistent form that is changed to lower case and ASCII digits as a whole: the words of ``words``, but
    for letters whose lower case is more than a letter, at which a run ends."""
    return _RUN.findall(text.lower().translate(_ASCII_DIGITS))


def words(text: str | None) -> list[str]:
    return [word(r) for r in runs(text)]


def word_hashes(rs: list[str]) -> np.ndarray:
    """A 64-bit hash of the word of each run."""
    if len(_hashes) > _KEPT:
        _hashes.clear()
    out = list(map(_hashes.get, rs))
    if None in out:
        for i, h in enumerate(out):
            if h is None:
                out[i] = _hashes[rs[i]] = xxhash.xxh3_64_intdigest(word(rs[i]))
    return np.array(out, np.uint64)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive words, in order; empty if there are fewer words."""
    n = len(h) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out = mix(out) + h[i : i + n]
    return mix(out)
