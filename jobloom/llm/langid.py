"""Language identification with language-bitmask n-gram filters.

Byte n-grams of lower-cased letters are counted per language on a bounded sample of the learning rows. An
n-gram belongs to a language if its share there is at least half of its highest share anywhere. All languages'
n-gram sets go into one Bloom filter that is sliced by bit: every slot holds a bitmask of languages (any number of them), and the AND
of an n-gram's slots is the set of all languages that contain it. A text's n-grams are looked up in bulk; each
language's popcount, less the filter's expected false positives, decides.

Learning rows are those with a non-null lang outside fold 2 (crc32 of doc_id as text, mod 4). Defined results: a
null text or one without a letter is `und` with score 0; a text none of whose n-grams is known gets the most
frequent language with score 0; ties go to the language that sorts first; with nothing to learn from, all rows
are `und`. Repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext as V
from .common import below_share, fold, text_chunks

SAMPLE_ROWS = 1500  # for each language
SIZES = (3, 5)
MIN_COUNT, MIN_SHARE_OF_BEST = 5, 0.5
HASHES, SLOTS_PER_GRAM, MAX_BYTES = 2, 16, 1 << 27


def grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of all byte n-grams inside texts, of letters_only() bytes."""
    n, texts = len(buf), np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    where, keys = [], []
    for size in SIZES:
        m = n - size + 1
        if m <= 0:
            continue
        value = np.full(m, size, np.uint64)
        for k in range(size):
            value = (value << np.uint64(8)) | buf[k : m + k]
        inside = texts[:m] == texts[size - 1 :]
        where.append(texts[:m][inside])
        keys.append(V.mix(value[inside]))
    if not keys:
        return np.zeros(0, np.int32), np.zeros(0, np.uint64)
    return np.concatenate(where), np.concatenate(keys)


class Filter:
    """Bit-sliced Bloom filter: slot -> bitmask of languages, in as many mask words as there are languages for."""

    def __init__(self, languages: list[str], keys: np.ndarray, langs: list[np.ndarray], common: int):
        """langs: for every language, the indices of the keys that it contains."""
        self.languages, self.common = languages, common
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        width = 8 * np.dtype(kind).itemsize
        words = -(-len(languages) // width)
        slots = 1 << 12
        while slots < SLOTS_PER_GRAM * len(keys) and 2 * slots * words * np.dtype(kind).itemsize <= MAX_BYTES:
            slots *= 2
        self.slots = np.zeros((words, slots), kind)
        self.at = [(k // width, kind(k % width)) for k in range(len(languages))]
        for (word, bit), which in zip(self.at, langs):
            for spot in self._spots(keys[which]):
                self.slots[word, spot] |= kind(1) << bit
        fill = np.array([np.count_nonzero(self.slots[word] >> bit & kind(1)) / slots for word, bit in self.at])
        self.false_rate = fill**HASHES

    def _spots(self, keys: np.ndarray):
        bits = np.uint64(self.slots.shape[1] - 1)
        return [(keys >> np.uint64(32 * k)) & bits if k == 0 else (keys >> np.uint64(64 - 40)) & bits for k in range(HASHES)]

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """All languages that contain each n-gram: one row for each mask word."""
        first, second = self._spots(keys)
        return self.slots[:, first] & self.slots[:, second]

    def count(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams by text and language, n-grams by text)."""
        low, at = V.letters_only(buf, off)
        text, keys = grams(low, at)
        mask, n = self.masks(keys), len(off) - 1
        total = np.bincount(text, minlength=n)
        counts = np.empty((n, len(self.languages)))
        for k, ((word, bit), rate) in enumerate(zip(self.at, self.false_rate)):
            hits = np.bincount(text[(mask[word] >> bit & mask.dtype.type(1)).astype(bool)], minlength=n)
            counts[:, k] = np.maximum(0.0, (hits - rate * total) / (1 - rate))
        return counts, total

    def evidence(self, counts: np.ndarray, total: np.ndarray) -> np.ndarray:
        """By text: shares of its n-grams that the best language has, and has more than the next; free of how many languages there are."""
        high = np.sort(np.hstack([np.zeros((len(counts), 1)), counts]), axis=1)
        return np.stack([high[:, -1], high[:, -1] - high[:, -2]], 1) / np.maximum(total, 1)[:, None]

    def decide(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score) of every text."""
        return self.best(self.count(buf, off)[0])

    def best(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        every = counts.sum(1)
        best = np.where(every > 0, counts.argmax(1), self.common)
        return best, np.where(every > 0, counts.max(1) / np.maximum(every, 1e-9), 0.0)


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Filter | None:
    """Fit the filter; what reaches the driver is bounded by the sample, not by the table."""
    return _fit(docs, sample_rows)[0]


def _fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[Filter | None, DataFrame | None]:
    """The filter and its learning rows."""
    known = docs.where(F.col("lang").isNotNull() & (fold() != 2))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None, None
    languages = sorted(counts)
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, int(min(1.0, sample_rows / counts[lang]) * (1 << 30)))])
    code = F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)])
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < share[F.col("lang")]).select(code[F.col("lang")].alias("lang"), "text")

    def count(batches):
        for batch in batches:
            langs = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, buf, off in text_chunks(batch):
                text, keys = grams(*V.letters_only(buf, off))
                lang = langs[lo:hi][text].astype(np.uint64)
                _, first, n = np.unique(V.mix(keys + lang * V._BASE), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(lang[first].astype(np.int32)), pa.array(keys[first].view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    found = sample.mapInArrow(count, "lang int, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    found = found.persist()
    totals = {r["lang"]: r["n"] for r in found.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        found.unpersist()
        return Filter(languages, np.zeros(0, np.uint64), [np.zeros(0, np.int64)] * len(languages), 0), sample
    rate = F.col("n") / F.create_map(*[F.lit(x) for k, v in totals.items() for x in (k, float(v))])[F.col("lang")]
    rated = found.where(F.col("n") >= MIN_COUNT).select("gram", "lang", rate.alias("rate"))
    best = rated.groupBy("gram").agg(F.max("rate").alias("best"), F.collect_list(F.struct("lang", "rate")).alias("langs"))
    own = F.transform(F.filter("langs", lambda x: x["rate"] >= MIN_SHARE_OF_BEST * F.col("best")), lambda x: x["lang"])
    table = best.select("gram", own.alias("langs")).toArrow()  # bounded by the sample
    found.unpersist()
    keys = table.column("gram").to_numpy().astype(np.int64).view(np.uint64)
    lists = table.column("langs").combine_chunks()
    of, gram = lists.flatten().to_numpy(), np.repeat(np.arange(len(keys)), lists.value_lengths().to_numpy())
    langs = [gram[of == k] for k in range(len(languages))]
    most = max(range(len(languages)), key=lambda k: (counts[languages[k]], -k))
    return Filter(languages, keys, langs, most), sample


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def has_letter(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    found = V.sum_by_text(_ASCII_LETTER[buf], off) > 0
    for i in np.flatnonzero(~found & (V.sum_by_text(buf >= 0x80, off) > 0)):
        found[i] = any(c.isalpha() for c in buf[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def identify(docs: DataFrame, model: Filter | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = learn(docs) if model is None else model
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_BYTES

    def run(batches):
        filter_ = shared.value
        names = np.array([*filter_.languages, "und"], object)
        for batch in batches:
            for lo, hi, buf, off in text_chunks(batch):
                best, score = filter_.decide(buf, off)
                letters = has_letter(buf, off)
                pred = names[np.where(letters, best, len(names) - 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(pred, pa.string()), pa.array(np.where(letters, score, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


MIN_SCORE = 0.25
#: Parts of the learning rows' median share and margin that a text must reach.
MIN_OF_MEDIAN = (0.5, 0.125)


def floors(model: Filter, sample: DataFrame) -> np.ndarray:
    """Least share and margin of a text whose language is found, from the learning rows."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for _, _, buf, off in text_chunks(batch):
                counts, total = shared.value.count(buf, off)
                seen = shared.value.evidence(counts, total)[total > 0]
                yield pa.RecordBatch.from_arrays([pa.array(seen[:, 0]), pa.array(seen[:, 1])], names=["share", "margin"])

    table = sample.mapInArrow(run, "share double, margin double").toArrow()  # bounded by the sample
    shared.destroy()
    if not table.num_rows:
        return np.zeros(2)
    return np.array([part * np.median(table.column(k).to_numpy()) for k, part in enumerate(MIN_OF_MEDIAN)])


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents (all their columns) whose language is found: with `min_score`, and with share and margin of floors()."""
    model, sample = _fit(docs)
    if model is None:
        return docs.limit(0)
    least = floors(model, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for lo, hi, buf, off in text_chunks(batch):
                counts, total = shared.value.count(buf, off)
                found = (shared.value.evidence(counts, total) >= least).all(1) & (shared.value.best(counts)[1] >= min_score)
                yield batch.slice(lo, hi - lo).filter(pa.array(has_letter(buf, off) & found))

    return docs.mapInArrow(run, docs.schema)
