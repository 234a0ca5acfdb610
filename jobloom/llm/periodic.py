"""Periodic runs of words: a phrase said four times or more in a row.

A run is a longest stretch of consecutive words with smallest period q (words q apart are identical) and at least
max(MIN_WORDS, REPEATS * q) words. All texts of a block are worked on at once, as one array of word numbers with a
number of its own between texts.

* Periods up to SHORT: one scan of the block for each lag.
* Longer periods, scale by scale: scale P has the periods above P and up to 2 * P. Positions are the P-word grams that
  do not lie in a run of period P / 4 or less found before; of every P positions in a row, the one with the least hash
  is a minimizer. A run of the scale repeats its minimizers at the distance of its period, and at least one of them is
  a position, as else the run had a shorter period. Equal positions are more than P / 4 apart, so that each minimizer
  meets at most eight equal ones within 2 * P, whatever the text: pairs stay linear and none is missed.
  A pair whose next or last 1.5 periods repeat too is extended on the words themselves, which also undoes any accident
  of hashes.

Work is n log n in the words of a block, and texts are never cut.

Defined results: a null, empty or blank text has no run and an empty collapsed text; texts are independent, so repeated
rows give repeated results and a null doc_id is kept; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks

MIN_WORDS, REPEATS = 6, 4
SHORT = 16
_LAST = np.uint64((1 << 40) - 1)
_PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
_RANDOM = np.random.default_rng(20240611)
_BASES = [int(_RANDOM.integers(1 << 20, p)) for p in _PRIMES]
_SCRAMBLE = _RANDOM.integers(1, 1 << 63, 2, np.uint64) | np.uint64(1)


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the stretches of True."""
    edge = np.diff(np.concatenate([[0], equal.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class _Grams:
    """Hashes of stretches of words: two polynomials modulo primes, from prefix sums."""

    def __init__(self, ids: np.ndarray):
        self.n, self.up, self.sums = len(ids), [], []
        for p, base in zip(_PRIMES, _BASES):
            up = np.ones(self.n + 1, np.uint64)
            size = 1
            while size <= self.n:  # powers by doubling
                more = min(size, self.n + 1 - size)
                up[size : size + more] = up[:more] * np.uint64(pow(base, size, p)) % np.uint64(p)
                size += more
            value = (ids.astype(np.uint64) * np.uint64(2654435761) + np.uint64(12345)) % np.uint64(p)
            sums = np.zeros(self.n + 1, np.uint64)
            # a sum of up to 2**32 words stays below 2**63
            np.cumsum(value * up[:-1] % np.uint64(p), out=sums[1:])
            self.up.append(up)
            self.sums.append(sums % np.uint64(p))

    def at(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """One 62-bit number for each stretch, equal for equal stretches wherever they are."""
        out = np.zeros(len(start), np.uint64)
        for p, up, sums in zip(_PRIMES, self.up, self.sums):
            p = np.uint64(p)
            out = out << np.uint64(31) | (sums[start + size] + p - sums[start]) % p * up[self.n - start] % p
        return out


def _minimizers(key: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the least key of some `width` positions in a row; keys carry their position in the last bits."""
    low, size = key, 1
    while size < width:
        step = min(size, width - size)
        low = np.minimum(low[:-step], low[step:])
        size += step
    return np.unique(low)


def _equal_pairs(at: np.ndarray, value: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of positions with equal values and low < j - i <= high."""
    order = np.lexsort((at, value))
    at, value = at[order], value[order]
    left, right, step = [], [], 1
    while True:
        near = (value[step:] == value[:-step]) & (at[step:] - at[:-step] <= high)
        if not near.any():
            break
        use = np.flatnonzero(near & (at[step:] - at[:-step] > low))
        left.append(at[use])
        right.append(at[use + step])
        step += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _extend(ids: np.ndarray, i: int, period: int) -> tuple[int, int]:
    """The longest stretch around i whose words equal those a period on."""
    a, b, step = ids[:-period], ids[period:], 4 * period
    end = i
    while end < len(a):
        other = np.flatnonzero(a[end : end + step] != b[end : end + step])
        if len(other):
            end += int(other[0])
            break
        end = min(end + step, len(a))
        step *= 2
    first, step = i, 4 * period
    while first > 0:
        lo = max(0, first - step)
        other = np.flatnonzero(a[lo:first] != b[lo:first])
        if len(other):
            first = lo + int(other[-1]) + 1
            break
        first, step = lo, step * 2
    return first, end + period


def find_runs(ids: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs, by start and period; ids of word numbers, no text longer than `longest`."""
    found: dict[tuple[int, int], int] = {}
    covered: list[tuple[np.ndarray, np.ndarray, int]] = []
    for q in range(1, min(SHORT, longest // REPEATS) + 1):
        first, end = _stretches(ids[q:] == ids[:-q])
        long = end - first >= max(MIN_WORDS, REPEATS * q) - q
        first, end = first[long], end[long] + q
        new = [k for k, span in enumerate(zip(first.tolist(), end.tolist())) if found.setdefault(span, q) == q]
        covered.append((first[new], end[new], q))
    scale, grams = SHORT, None
    while REPEATS * (scale + 1) <= longest:
        grams = grams or _Grams(ids)
        spots = np.arange(len(ids) - scale + 1)
        value = grams.at(spots, scale)
        scrambled = value * _SCRAMBLE[0]
        key = ((scrambled ^ scrambled >> np.uint64(29)) * _SCRAMBLE[1] & ~_LAST) >> np.uint64(1) | spots.astype(np.uint64)
        edge = np.zeros(len(ids) + 1, np.int64)
        for first, end, q in covered:
            if REPEATS * q <= scale:
                inside = end - first >= scale
                np.add.at(edge, first[inside], 1)
                np.add.at(edge, end[inside] - scale + 1, -1)
        key[np.cumsum(edge)[: len(key)] > 0] |= np.uint64(1 << 63)
        best = _minimizers(key, min(scale, len(key)))
        at = (best[best < np.uint64(1 << 63)] & np.uint64(_LAST >> np.uint64(1))).astype(np.int64)
        i, j = _equal_pairs(at, value[at], scale, 2 * scale)
        q = j - i
        more = q + q // 2
        ahead, behind = j + more <= len(ids), i - more >= 0
        likely = np.zeros(len(i), bool)
        likely[ahead] = grams.at(i[ahead], more[ahead]) == grams.at(j[ahead], more[ahead])
        likely[behind] |= grams.at(i[behind] - more[behind], more[behind]) == grams.at(j[behind] - more[behind], more[behind])
        i, q = i[likely], q[likely]
        order = np.lexsort((i, q))
        spans, last = [], (0, 0, 0)
        for at_i, period in zip(i[order].tolist(), q[order].tolist()):
            if period == last[2] and last[0] <= at_i < last[1] - period:
                continue
            last = (*_extend(ids, at_i, period), period)
            if last[1] - last[0] >= REPEATS * period and found.setdefault(last[:2], period) == period:
                spans.append(last)
        # a period up to a quarter of the next scale's grams hides positions there
        for period in sorted({s[2] for s in spans}):
            own = np.array([s[:2] for s in spans if s[2] == period])
            covered.append((own[:, 0], own[:, 1], period))
        scale *= 2
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def _block(raw: bytes, off: np.ndarray, numbers: dict[bytes, int]) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """(runs as (start, length, period), collapsed text) of each text of a block."""
    words = [raw[a:b].split() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
    numbers.clear()
    sizes = np.array([len(w) for w in words])
    ids = np.empty(int(sizes.sum()) + len(words), np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    for k, own in enumerate(words):
        ids[first[k] : first[k] + len(own)] = [numbers.setdefault(w, len(numbers)) for w in own]
    gaps = first + sizes
    ids[gaps] = len(numbers) + np.arange(len(words))
    runs = find_runs(ids, int(sizes.max())) if len(words) else []
    by_text: dict[int, list[tuple[int, int, int]]] = {}
    for s, e, q in runs:
        k = int(np.searchsorted(first, s, "right")) - 1
        by_text.setdefault(k, []).append((s - int(first[k]), e - s, q))
    out = []
    for k, own in enumerate(words):
        mine = by_text.get(k, [])
        if mine:
            keep = np.ones(len(own), bool)
            for s, length, q in mine:
                keep[s + q : s + length] = False
            own = [own[i] for i in np.flatnonzero(keep).tolist()]
        out.append((mine, b" ".join(own)))
    return out


RUNS_SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): its runs by start and period, and the text's words without repeated periods.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. A word is left out of `collapsed` if any run holds it after that run's
    first period; the others are joined by one space.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        numbers: dict[bytes, int] = {}
        for batch in batches:
            for lo, hi, raw, off in text_chunks(batch):
                done = _block(raw.tobytes(), off, numbers)
                runs = [[{"start": s, "length": n, "period": q} for s, n, q in mine] for mine, _ in done]
                texts = pa.array([t for _, t in done], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(runs, kind), texts], names=["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RUNS_SCHEMA)


def plant(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in which one document of ten repeats a stretch of its words up to its end, as the query asks.

    With h = crc32 of the decimal doc_id and n words, if h % 10 = 0 and n > 0, every word i >= a becomes word
    a + (i - a) % p, where g = h // 10, a = g % n and p = 1 + (n - a) // (3 + g % 8). Other texts, and those of a null
    doc_id, stay as they are.
    """
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")).alias("h"))

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for k, h in enumerate(batch.column(2).to_pylist()):
                own = (texts[k] or "").encode().split() if h is not None and h % 10 == 0 else []
                if own:
                    n, g = len(own), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    texts[k] = b" ".join(own[:a] + (own[a : a + p] * ((n - a) // p + 1))[: n - a]).decode()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return marked.mapInArrow(run, "doc_id long, text string")


def digest(found: DataFrame) -> DataFrame:
    """Digest columns of periodic_runs: the run of greatest exact length / period (ties: smallest start, then period), and hashes."""
    ahead = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]  # noqa: E731  exact: positive if x repeats more often
    first = F.aggregate(
        "runs", F.get("runs", F.lit(0)),
        lambda best, r: F.when((ahead(r, best) > 0) | ((ahead(r, best) == 0) & ((r["start"] < best["start"]) | ((r["start"] == best["start"]) & (r["period"] < best["period"])))), r).otherwise(best),
    )
    best = F.when(F.size("runs") > 0, first)
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
