"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Texts are sequences of lower-cased words of letters and digits. MATCH, MISMATCH and GAP score a local alignment
of an item and a passage, whose score over that of a perfect copy is the similarity. A pair at SIMILARITY or more
is a leak. An alignment that reaches it leaves a least number of the item's n-grams whole (whole_grams), wherever
the edits are; n is the largest up to NGRAM for which that number is not 0. All n-grams of an item are its seeds,
except the most frequent ones of the corpus (ties by hash), fewer than that number, so every leak holds a seed.
Documents that hold enough seeds are aligned with the item around each hit, as far as gaps can carry the passage.
Before aligning, pairs are passed over only if the seeds or words that item and passage share cannot reach it.

Test items are taken in blocks of about BLOCK_BYTES of text and BLOCK_ITEMS items, each broadcast in turn, so the
broadcast size is bounded whatever the benchmark's size (a longer item is a block of its own); all documents meet all
items, in two scans for each block.

Defined results: null, empty or wordless texts and items match nothing; items too short for
larger n-grams are seeded by their words; repeated rows of documents give repeated pairs, repeated rows of items count once,
and items with equal ids and different texts are all tried; ids may be null; other columns are ignored; an empty table on
either side gives no pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext as V
from .common import text_chunks, utf8_column, without_ids, written

NGRAM = 3
MATCH, MISMATCH, GAP = 2, -1, -1
SIMILARITY = 0.6
BLOCK_BYTES, BLOCK_ITEMS = 1 << 25, 200_000
MAX_HITS = 1 << 21  # pairs of a hit and a seed that are looked at together
PAIRS = "doc_id long, item_id long, similarity double, first_word long, last_word long"


def word_sequence(buf: np.ndarray, off: np.ndarray) -> V.Words:
    return V.find_words(*V.letters_only(buf, off, digits=True))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: score, first and last passage word, row by row over the item.

    Within a row the best gap from the left is a running maximum, so a row is a few vector operations.
    """
    n = len(passage)
    at = np.arange(n + 1)
    slope = -GAP * at
    row, start = np.zeros(n + 1, np.int64), at.copy()
    best, span = 0, (0, 0)
    for word in item:
        step = np.where(passage == word, MATCH, MISMATCH)
        new, came = np.zeros(n + 1, np.int64), at.copy()
        diagonal, above = row[:-1] + step, row[1:] + GAP
        up = above > diagonal
        value = np.where(up, above, diagonal)
        good = value > 0
        new[1:][good] = value[good]
        came[1:][good] = np.where(up, start[1:], start[:-1])[good]
        lifted = new + slope
        left = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == left, at, 0))
        gap = left - slope
        use = gap > new
        new[use], came[use] = gap[use], came[source[use]]
        row, start = new, came
        top = int(row.argmax())
        if row[top] > best:
            best, span = int(row[top]), (int(start[top]), top - 1)
    return best, *span


def longest_passage(length: int, similarity: float) -> int:
    """Words by which a passage that reaches the similarity can be longer than the item."""
    return math.floor(MATCH * (1 - similarity) * length / -GAP + 1e-9)


def whole_grams(length: int, n: int, similarity: float) -> int:
    """The least number of an item's n-grams that an alignment at `similarity` leaves whole.

    With m words matched there are at most (MATCH * m - need) / cost edits, each of which ends one run of matches;
    r runs hold m - r * (n - 1) whole n-grams at least. This is linear in m, so its ends are enough.
    """
    need, cost = similarity * MATCH * length, min(-MISMATCH, -GAP)
    ends = (need / MATCH, length)
    return math.ceil(min(m - (n - 1) * (1 + (MATCH * m - need) / cost) for m in ends) - 1e-9)


def gram_size(length: int, similarity: float) -> int:
    return next((n for n in range(NGRAM, 1, -1) if whole_grams(length, n, similarity) > 0), 1)


@dataclass
class Items:
    """One block of test items: words, seeds each needs in a document, and seeds sorted by hash."""

    ids: list
    words: list[np.ndarray]
    need: np.ndarray
    seed: np.ndarray
    item: np.ndarray
    at: np.ndarray
    size: np.ndarray


def _grams(items: DataFrame, similarity: float) -> tuple[list, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    table = items.select(F.col("item_id").cast("long").alias("item_id"), "text").toArrow()
    w = word_sequence(*utf8_column(table.column("text")))
    words = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
    owner, at, value, size = [], [], [], []
    text = w.text
    wanted = np.array([gram_size(k, similarity) for k in np.diff(w.first).tolist()])
    for n in range(1, NGRAM + 1):
        first, hashes = V.windows(w, n)
        take = wanted[text[first]] == n
        first, hashes = first[take], hashes[take]
        owner.append(text[first])
        at.append(first - w.first[text[first]])
        value.append(hashes)
        size.append(np.full(len(first), n))
    return table.column("item_id").to_pylist(), words, *map(np.concatenate, (value, owner, at, size))


def _sequences(buf: np.ndarray, off: np.ndarray, sizes: list[int]):
    w = word_sequence(buf, off)
    for n in sizes:
        yield w, *V.windows(w, n)


def _lookup(known: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of hashes that are known, and the first index of each in the sorted array."""
    spot = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    hit = np.flatnonzero(known[spot] == hashes)
    return hit, spot[hit]


def build_items(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> Items | None:
    """Choose the seeds of a block of items by how often their n-grams occur in all documents."""
    ids, words, value, owner, at, size = _grams(items, similarity)
    if not len(value):
        return None
    known = np.unique(value)
    sizes = sorted(set(size.tolist()))
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches):
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for _, _, buf, off in text_chunks(batch):
                for _, _, hashes in _sequences(buf, off, sizes):
                    total += np.bincount(_lookup(shared.value, hashes)[1], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["gram", "n"])

    found = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    often = np.zeros(len(known), np.int64)
    often[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    spot = np.searchsorted(known, value)
    rank = np.lexsort((known[spot], often[spot]))
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    order = np.lexsort((at, owner))
    chosen, need = [], np.ones(len(words), np.int64)
    bounds = np.searchsorted(owner[order], np.arange(len(words) + 1))
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        mine = order[a:b]
        if len(mine):
            whole = max(1, whole_grams(len(words[i]), int(size[mine[0]]), similarity))
            skipped = whole // 2
            need[i] = whole - skipped
            chosen.extend(mine[np.argsort(place[mine])][: len(mine) - skipped])
    chosen = np.unique(chosen)
    chosen = chosen[np.argsort(value[chosen], kind="stable")]
    return Items(ids, words, need, value[chosen], owner[chosen], at[chosen], size[chosen])


def _windows_of(hits_at: np.ndarray, item_at: np.ndarray, length: int, n: int, slack: int) -> list[tuple[int, int]]:
    """Passages of a document to align: around each hit, merged where they overlap."""
    lo = np.maximum(hits_at - item_at - slack, 0)
    hi = np.minimum(hits_at - item_at + length + slack, n)
    out: list[tuple[int, int]] = []
    for k in np.argsort(lo, kind="stable"):
        if out and lo[k] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], int(hi[k])))
        else:
            out.append((int(lo[k]), int(hi[k])))
    return out


def find_leaks(block: Items, buf: np.ndarray, off: np.ndarray, similarity: float):
    """(text, item, similarity, first, last) of the best passage of every leaking pair of a block of texts."""
    rows = []
    for n in sorted(set(block.size.tolist())):
        pick = np.flatnonzero(block.size == n)
        known = block.seed[pick]
        w = word_sequence(buf, off)
        at, hashes = V.windows(w, n)
        hit, spot = _lookup(known, hashes)
        if not len(hit):
            continue
        repeat = np.searchsorted(known, known[spot], "right") - spot
        order = np.argsort(at[hit], kind="stable")
        hit, spot, repeat = hit[order], spot[order], repeat[order]
        upto = np.cumsum(repeat)
        ends = np.flatnonzero(np.diff(w.text[at[hit]], append=-1)) + 1  # whole texts, about MAX_HITS pairs at a time
        turn = upto[ends - 1] // MAX_HITS
        lo = 0
        for hi in ends[np.flatnonzero(np.diff(turn, append=-1))].tolist():
            rows += _leaks_of(block, w, at[hit[lo:hi]], spot[lo:hi], repeat[lo:hi], pick, similarity)
            lo = hi
    return rows


def _leaks_of(block: Items, w: V.Words, at: np.ndarray, spot: np.ndarray, repeat: np.ndarray, pick: np.ndarray, similarity: float) -> list:
    """The leaks among hits: words `at`, each of which holds `repeat` seeds from `spot` on."""
    rows = []
    which = np.repeat(spot - np.cumsum(repeat) + repeat, repeat) + np.arange(repeat.sum())
    word, seed = np.repeat(at, repeat), pick[which]
    key = w.text[word] * len(block.words) + block.item[seed]
    order = np.argsort(key, kind="stable")
    key, word, seed = key[order], word[order], seed[order]
    cuts = np.flatnonzero(np.diff(key, prepend=-1))
    size = np.diff(cuts, append=len(key))
    maybe = np.flatnonzero(size >= block.need[key[cuts] % len(block.words)])
    for a, b in zip(cuts[maybe].tolist(), (cuts + size)[maybe].tolist()):
        t, i = divmod(int(key[a]), len(block.words))
        if len(np.unique(block.at[seed[a:b]])) < block.need[i]:
            continue
        item, passage = block.words[i], w.hash[w.first[t] : w.first[t + 1]]
        need = similarity * MATCH * len(item)
        best = (0, 0, 0)
        for lo, hi in _windows_of(word[a:b] - w.first[t], block.at[seed[a:b]], len(item), len(passage), longest_passage(len(item), similarity)):
            part = passage[lo:hi]
            if MATCH * np.isin(item, part).sum() < need:
                continue
            score, x, y = align(item, part)
            if score > best[0]:
                best = (score, lo + x, lo + y)
        if best[0] >= need:
            rows.append((t, i, best[0] / (MATCH * len(item)), best[1], best[2]))
    return rows


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    """Blocks of test items by a hash of id and text: item_id, text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    n, size = items.agg(F.count("*"), F.sum(F.octet_length("text").cast("long"))).first()
    blocks = max(-(-n // BLOCK_ITEMS), -(-(size or 0) // BLOCK_BYTES))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).distinct() for k in range(blocks)]


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Leaking pairs: doc_id, item_id, similarity, first_word, last_word (0-based words of the document)."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for items in _blocks(benchmark):
        block = build_items(own, items, similarity)
        if block is None:
            continue
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            b = shared.value
            for batch in batches:
                for lo, hi, buf, off in text_chunks(batch):
                    if rows := find_leaks(b, buf, off, similarity):
                        t, i, s, first, last = zip(*rows)
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(t)), pa.array([b.ids[x] for x in i], pa.int64()), pa.array(s, pa.float64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=["doc_id", "item_id", "similarity", "first_word", "last_word"])

        part = own.mapInArrow(run, PAIRS)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], PAIRS) if out is None else out


def _filtered(docs: DataFrame, shared, similarity: float, leaking: bool) -> DataFrame:
    """The documents that leak an item of a block, or those that do not."""

    def run(batches):
        for batch in batches:
            for lo, hi, buf, off in text_chunks(batch):
                take = np.full(hi - lo, not leaking)
                take[[r[0] for r in find_leaks(shared.value, buf, off, similarity)]] = leaking
                yield batch.slice(lo, hi - lo).filter(pa.array(take))

    return docs.mapInArrow(run, docs.schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents (all their columns) that leak no item.

    Rows are tested in place. With more than one block of items, the leaking rows' hashes (of id and text) are written block by
    block and taken out in one last scan, so no task holds two blocks; texts are not shuffled, but for those that may leak.
    """
    context, own = docs.sparkSession.sparkContext, docs.select("doc_id", "text")
    parts = _blocks(benchmark)
    if len(parts) <= 1:
        block = build_items(own, parts[0], similarity) if parts else None
        return docs if block is None else _filtered(docs, context.broadcast(block), similarity, leaking=False)
    key = F.xxhash64("doc_id", "text")
    gone = None
    for items in parts:
        block = build_items(own, items, similarity)
        if block is None:
            continue
        shared = context.broadcast(block)
        part = written(_filtered(own, shared, similarity, leaking=True).select(key.alias("key")), "leaking")
        shared.destroy()
        gone = part if gone is None else gone.unionByName(part)
    return docs if gone is None else without_ids(docs.withColumn("__leak_key", key), "__leak_key", gone).drop("__leak_key")
