"""Hashed character n-grams of words, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_CLASS: np.ndarray | None = None
_SLICE = 1 << 18


def _letters() -> np.ndarray:
    """Per code point: 1 if it belongs to a word (letters and combining marks)."""
    global _CLASS
    if _CLASS is None:
        import unicodedata

        _CLASS = np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), bool, 0x110000)
    return _CLASS


def has_letter(text: str) -> bool:
    return any(bool(_letters()[_codes(text[at : at + _SLICE])].any()) for at in range(0, len(text), _SLICE))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashed(text: str, sizes: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """Bucket numbers of the n-grams of lower-cased words, a space standing at each word's edges, by slices of a long text.

    An n-gram may hold an edge only at its ends. Slices overlap by the longest n-gram less one.
    """
    return (ids for ids, _ in located(text, sizes, bits))


def located(text: str, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same with the number of the word that each n-gram is of (counted from 0)."""
    t = " " + text.lower() + " "
    most, shift, words, after = max(sizes), np.uint64(64 - bits), 0, False
    for at in range(0, len(t), _SLICE):
        c = _codes(t[at : at + _SLICE + most - 1])
        inside = _letters()[c]
        c = np.where(inside, c, np.uint32(0)).astype(np.uint64)
        own, out, where = min(_SLICE, len(c)), [], []
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[0] &= not after
        word = words + np.cumsum(begins) - 1
        words, after = int(word[own - 1]) + 1, bool(inside[own - 1])
        for n in sizes:
            m = min(own, len(c) - n + 1)
            if m <= 0:
                continue
            ok = inside[1 : m + 1].copy() if n > 2 else (inside[:m] | inside[n - 1 : m + n - 1])
            for k in range(2, n - 1):
                ok &= inside[k : m + k]
            if n == 1:
                ok = inside[:m]
            p = np.flatnonzero(ok)
            h = c[p] + np.uint64(n)
            for k in range(1, n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + c[p + k]
            h ^= h >> np.uint64(29)
            out.append(((h * np.uint64(0xBF58476D1CE4E5B9)) >> shift).astype(np.int64))
            where.append(word[np.minimum(p + 1, p + n - 1)])
        yield (np.concatenate(out), np.concatenate(where)) if out else (np.empty(0, np.int64),) * 2
