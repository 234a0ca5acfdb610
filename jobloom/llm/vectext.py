"""Vectorised text kernels: word bounds, word hashes and n-gram hashes over many texts at once.

A block of texts is one UTF-8 byte array and an array of offsets. All hashes are 64-bit: a word's hash is
a polynomial over its bytes, taken from prefix sums modulo 2**64 and finished by a bit mixer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_codes = np.random.default_rng(20240501).integers(1, 1 << 63, 256, np.uint64)
PLAIN = _codes.copy()
FOLDED = _codes.copy()
FOLDED[65:91] = _codes[97:123]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x)
    up, down = _powers["up"], _powers["down"]
    if n <= 1 << 20 < len(up):  # a very long text came by: do not keep its tables
        _powers["up"], _powers["down"] = up[: 1 << 20].copy(), down[: 1 << 20].copy()
    return up, down


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    start: np.ndarray  # byte positions
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # per text: index of its first word; one more entry at the end
    sums: np.ndarray | None = None  # sums[i]: polynomial over the bytes before i

    @property
    def text(self) -> np.ndarray:
        """Index of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def prefix(self, size: int, which: np.ndarray) -> np.ndarray:
        """Hash of the first `size` bytes of the words `which`."""
        at = self.start[which]
        _, down = powers(len(self.sums))
        return mix((self.sums[at + size] - self.sums[at]) * down[at] + np.uint64(size))


def find_words(buf: np.ndarray, off: np.ndarray, table: np.ndarray = PLAIN, gap: np.ndarray | None = None) -> Words:
    """Words are runs without a separator byte (by default space and 0x09 to 0x0D); texts bound them too."""
    n, texts = len(buf), len(off) - 1
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(texts + 1, np.int64), np.zeros(1, np.uint64))
    inside = ~(SPACE if gap is None else gap)[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = off[:-1][np.diff(off) > 0]
    begins[at] = inside[at]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    at = off[1:][np.diff(off) > 0] - 1
    ends[at] = inside[at]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(table[buf] * up[:n], out=sums[1:])
    value = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    return Words(start, end, value, np.searchsorted(start, off), sums)


_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, 16, np.uint64) | np.uint64(1)


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every window of `size` words inside one text."""
    n = len(w.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for k in range(size):
        acc = (acc ^ w.hash[k : n + k]) * _SEEDS[k]
        acc ^= acc >> np.uint64(29)
    text = w.text
    inside = np.flatnonzero(text[:n] == text[size - 1 :])
    return inside, mix(acc[inside])


def letters_only(buf: np.ndarray, off: np.ndarray, digits: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case copy (ASCII and Latin-1 letters) with runs of other ASCII bytes made one space; new offsets."""
    if len(buf) == 0:
        return buf, off
    low = _LOWER_DIGITS[buf] if digits else _LOWER[buf]
    capital = np.flatnonzero((buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97) & (buf[:-1] == 0xC3)) + 1
    low[capital] += 0x20
    keep = low != 0x20
    keep[1:] |= low[:-1] != 0x20
    at = off[:-1][np.diff(off) > 0]
    keep[at] = True
    return low[keep], np.concatenate([[0], np.cumsum(keep)])[off]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[:128] = 0x20
_LOWER[97:123] = np.arange(97, 123)
_LOWER[65:91] = np.arange(97, 123)
_LOWER_DIGITS = _LOWER.copy()
_LOWER_DIGITS[48:58] = np.arange(48, 58)


def sum_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]] for every text i, empty runs included."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]
