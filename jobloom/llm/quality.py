"""Quality selection by importance resampling (hashed n-gram models, Gumbel top-k).

Two bag-of-n-grams models share one table of hashed buckets: word unigrams, word bigrams, and unigrams and
bigrams of word shapes (length class, classes of the first and last byte, inner capitals, repetition of the word
before). The raw model counts all documents; the target model counts a bounded sample of documents labelled
good, smoothed towards the raw model. A document's log importance weight is the log ratio of the two models for
the whole text: the sum over all its n-grams, whatever their number.

k, the number of documents to draw, is how many have a weight above the cut that best separates the labelled
sample. Gumbel noise seeded by doc_id is added to the weights and the k largest are drawn without replacement,
by an exact radix selection over 16-bit digits of the perturbed weights; ties at the k-th place are all drawn.

Defined results: a null, empty or blank text has weight 0 and is never drawn; a null doc_id seeds as 0; repeated
rows are drawn or not together; without labels of either kind the cut is 0; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext as V
from .common import below_share, drop_written, text_chunks, written

SAMPLE_ROWS = 12000  # labelled rows, at most about
BUCKETS = 1 << 16
SMOOTHING = 2000.0
NOISE = 1.0

_CLASS = np.full(256, 5, np.uint64)  # other bytes of UTF-8
_CLASS[33:48] = 4
_CLASS[58:65] = 4
_CLASS[91:97] = 4
_CLASS[123:128] = 4
_CLASS[48:58] = 3
_CLASS[65:91] = 2
_CLASS[97:123] = 1
for _c in ".,":
    _CLASS[ord(_c)] = 6
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of all n-grams."""
    w = V.find_words(buf, off)
    if not len(w.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = w.text
    capitals = np.concatenate([[0], np.cumsum(_UPPER[buf])])
    again = np.zeros(len(text), np.uint64)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (text[1:] == text[:-1])
    size = np.searchsorted([2, 4, 8, 14, 24], w.end - w.start).astype(np.uint64)
    inner = np.minimum(capitals[w.end] - capitals[w.start + 1], 2).astype(np.uint64)
    before = _CLASS[buf[np.maximum(w.end - 2, w.start)]]
    shape = V.mix((((size * np.uint64(8) + _CLASS[buf[w.start]]) * np.uint64(8) + _CLASS[buf[w.end - 1]]) * np.uint64(8) + before) * np.uint64(8) + inner * np.uint64(2) + again + np.uint64(1))
    pair = np.flatnonzero(text[1:] == text[:-1])
    half = np.uint64(BUCKETS // 4 - 1)
    word1 = w.hash & half
    word2 = (V.mix(w.hash[pair] * V._SEEDS[3] + w.hash[pair + 1]) & half) + np.uint64(BUCKETS // 4)
    shape1 = (shape & half) + np.uint64(BUCKETS // 2)
    shape2 = (V.mix(shape[pair] * V._SEEDS[4] + shape[pair + 1]) & half) + np.uint64(3 * BUCKETS // 4)
    return np.concatenate([text, text[pair], text, text[pair]]), np.concatenate([word1, word2, shape1, shape2]).astype(np.int64)


def weights(table: np.ndarray, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log importance weight, number of n-grams) of every text."""
    text, bucket = features(buf, off)
    n = np.bincount(text, minlength=len(off) - 1)
    return np.bincount(text, table[bucket], minlength=len(off) - 1).astype(float), n


def perturbed(doc_id: pa.Array, weight: np.ndarray) -> np.ndarray:
    """Weight plus Gumbel noise drawn from doc_id, as a long that sorts alike."""
    ids = doc_id.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    u = (V.mix(V.mix(ids + np.uint64(77)) ^ V._SEEDS[5]) >> np.uint64(11)).astype(np.float64) / 2**53
    key = (weight - NOISE * np.log(-np.log(np.clip(u, 1e-12, 1 - 1e-12)))).view(np.int64)
    return np.where(key < 0, key ^ np.int64(0x7FFFFFFFFFFFFFFF), key)


def labelled_sample(labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About `rows` labelled ids by hash: (doc_id, quality); small whatever the table, so it can be broadcast."""
    rated = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    total = rated.count()
    return rated.where(below_share(F.col("doc_id"), rows / max(1, total), 21)).withColumnRenamed("doc_id", "__id").hint("broadcast")


def log_ratios(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """log p(target) - log p(raw) of every bucket; BUCKETS numbers reach the driver."""
    marked = docs.join(sample, F.col("doc_id") == F.col("__id"), "left").select((F.coalesce("quality", F.lit(0)) == 1).alias("good"), "text")

    def count(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            good = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, buf, off in text_chunks(batch):
                text, bucket = features(buf, off)
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[good[lo:hi][text]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    got = marked.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = got.column("bucket").to_numpy()
    raw[at], target[at] = got.column("raw").to_numpy(), got.column("target").to_numpy()
    p = (raw + 1.0) / (raw.sum() + BUCKETS)
    q = (target + SMOOTHING * p) / (target.sum() + SMOOTHING)
    return np.log(q) - np.log(p)


def _best_cut(weight: np.ndarray, good: np.ndarray) -> float:
    """The cut with the best balanced accuracy, halfway between the weights beside it."""
    if good.all() or not good.any():
        return 0.0
    order = np.argsort(weight)
    w, g = weight[order], good[order]
    accuracy = np.cumsum(~g) / (~g).sum() + 1 - np.cumsum(g) / g.sum()
    best = int(np.argmax(accuracy))
    return float((w[best] + w[min(best + 1, len(w) - 1)]) / 2)


def kth_largest(df: DataFrame, name: str, k: int) -> int:
    """Exact k-th largest of a long column by four rounds over 16-bit digits; 65,536 counts at most a round."""
    rest, prefix = df.select(name), 0
    for shift in (48, 32, 16, 0):
        counts = sorted(rest.groupBy(F.shiftright(name, shift).alias("p")).count().collect(), reverse=True)
        for r in counts:
            if k <= r["count"]:
                prefix = r["p"]
                break
            k -= r["count"]
        rest = rest.where(F.shiftright(name, shift) == prefix)
    return prefix


def _model(docs: DataFrame, labels: DataFrame):
    """(broadcast log ratios, least perturbed weight that is drawn or None, the written scores)."""
    sample = labelled_sample(labels)
    shared = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, sample))

    def run(batches):
        for batch in batches:
            for lo, hi, buf, off in text_chunks(batch):
                weight, n = weights(shared.value, buf, off)
                ids = batch.column(0).slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([ids, pa.array(weight), pa.array(n), pa.array(perturbed(ids, weight))], names=["doc_id", "weight", "n_grams", "rank_key"])

    scores = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, weight double, n_grams long, rank_key long"), "scores")
    seen = scores.join(sample, F.col("doc_id") == F.col("__id")).where("n_grams > 0").select("weight", "quality").toArrow()
    cut = _best_cut(seen.column("weight").to_numpy(), seen.column("quality").to_numpy() == 1) if seen.num_rows else 0.0
    real = scores.where("n_grams > 0")
    k = real.where(F.col("weight") > cut).count()
    return shared, kth_largest(real, "rank_key", k) if k else None, scores


def resample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, weight (log importance weight), n_grams, kept (drawn)."""
    _, least, scores = _model(docs, labels)
    kept = F.lit(False) if least is None else (F.col("n_grams") > 0) & (F.col("rank_key") >= least)
    return scores.select("doc_id", "weight", "n_grams", kept.alias("kept"))


def keep_drawn(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The drawn documents with all their columns; weighs again in place instead of joining texts."""
    shared, least, scores = _model(docs, labels)
    drop_written(scores)
    if least is None:
        return docs.limit(0)
    at = docs.columns.index("doc_id")

    def run(batches):
        for batch in batches:
            for lo, hi, buf, off in text_chunks(batch):
                weight, n = weights(shared.value, buf, off)
                rows = batch.slice(lo, hi - lo)
                yield rows.filter(pa.array((n > 0) & (perturbed(rows.column(at), weight) >= least)))

    return docs.mapInArrow(run, docs.schema)
