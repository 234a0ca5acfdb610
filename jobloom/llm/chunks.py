"""Encodings of text chunks, cached by worker within a bound of bytes."""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Callable
from itertools import repeat

import numpy as np

#: Longer chunks are encoded where they occur and not kept.
LONGEST_KEPT = 64
KEPT_BYTES = 128 << 20
#: About what a kept chunk takes besides its characters and ids: its string, its entry and two numbers.
_ENTRY_BYTES = 180


def _places(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all ids of chunks that begin at `at`, chunk by chunk."""
    total = np.cumsum(sizes)
    return np.repeat(at - total + sizes, sizes) + np.arange(total[-1] if len(total) else 0)


class ChunkCache:
    """Ids of chunks of text; `learn` encodes a list of unseen chunks to (the chunks in an order of its own, ids of all, ids in each)."""

    def __init__(self, learn: Callable[[list[str]], tuple[list[str], np.ndarray, np.ndarray]], kept_bytes: int = KEPT_BYTES):
        self.learn, self.kept_bytes = learn, kept_bytes
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.at, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.calls = np.zeros(1 << 12, np.int32)
        self.used = self.bytes = 0

    def renew(self) -> None:
        """Make room: chunks that only one call asked for go; all go if less than half of them do."""
        names, keep = list(self.index), np.flatnonzero(self.calls[: len(self.index)] > 1)
        at, sizes = self.at[keep], self.size[keep]
        ids = self.flat[_places(at, sizes)]
        self.reset()
        if 2 * len(keep) <= len(names):
            self._keep([names[k] for k in keep.tolist()], ids, sizes)

    def _keep(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, last = len(self.index), len(self.index) + len(chunks)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while last > len(self.at):
            self.at, self.size, self.calls = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size, self.calls))
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[first:last] = self.used + np.cumsum(sizes) - sizes
        self.size[first:last] = sizes
        self.used += len(ids)
        self.bytes += sum(map(len, chunks)) + 4 * len(ids) + _ENTRY_BYTES * len(chunks)
        self.index.update(zip(chunks, range(first, last)))

    def encode(self, chunks: list[str], order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks in order, ids in each); with `order`, chunks are distinct and occur as these indices say."""
        if self.bytes > self.kept_bytes:
            self.renew()
        which = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        unseen = np.flatnonzero(which < 0).tolist()
        flat, at, size = self.flat, self.at, self.size
        if unseen:
            new = dict.fromkeys(chunks[k] for k in unseen)
            short, long = [c for c in new if len(c) <= LONGEST_KEPT], [c for c in new if len(c) > LONGEST_KEPT]
            if short:
                self._keep(*self.learn(short))
            flat, at, size, own = self.flat, self.at, self.size, self.index
            if long:
                n, (long, more, sizes) = len(self.index), self.learn(long)
                flat, at, size = np.concatenate([flat[: self.used], more]), np.concatenate([at[:n], self.used + np.cumsum(sizes) - sizes]), np.concatenate([size[:n], sizes])
                own = ChainMap(dict(zip(long, range(n, n + len(long)))), self.index)
            which[unseen] = [own[chunks[k]] for k in unseen]
        self.calls[which[which < len(self.index)]] += 1
        which = which if order is None else which[order]
        at, sizes = at[which], size[which]
        return flat[_places(at, sizes)], sizes
