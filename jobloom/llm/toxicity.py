"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

1. Lexicon: lower-cased words and word beginnings of 4, 5 and 6 bytes that occur far more often in toxic than in
   other documents of labelled learning rows (bounded, hashed sample). Rows are dealt into two halves; each half
   is voted on by the lexicon of the other one, so no voter has read the label of a row that it votes on. Entries are dealt to
   small voters by kind and hash; pattern voters watch density of hits, and, free of any label, runs of symbols, capitals,
   exclamations and words masked by symbols.
2. Label model: the true label is latent. EM over the voters' patterns on the learning rows of a half gives each
   voter's rates of firing in either class. Correlations of every two voters inside the classes are estimated
   from what the rates leave over; voters joined by a correlation of MIN_CORRELATION or more form a cluster, inside
   which each counts the less the more it repeats the others. The posterior of a row is its probabilistic label. Given labels do not
   enter it; they only name the classes.
3. A logistic regression on hit counts (of the lexicon of both halves) and patterns is trained on those posteriors and scores every whole text.

Labels are learnt only from rows outside fold 2 (crc32 of doc_id as text, mod 4); lang, source and doc_id are
never inputs of a score. Defined results: a null or empty text is scored like one without words; repeated rows
get equal scores; with no toxic learning row all scores are 0; ids may be null; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext as V
from .common import below_share, fold, text_chunks

SAMPLE_ROWS = 12000  # labelled rows for the lexicon, and rows for the label model and classifier, at most about
MIN_TOXIC_ROWS, MIN_RATIO, MAX_ENTRIES = 6, 30.0, 4096
MIN_CORRELATION = 0.3
PREFIXES = (4, 5, 6)
VOTERS_PER_KIND = 4
CLASSIFIER_ENTRIES = 768
THRESHOLD = 0.3
LEXICAL = (1 + len(PREFIXES)) * VOTERS_PER_KIND
VOTERS = LEXICAL + 7

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "!#*$%&@"]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_LETTER = _CAPITAL.copy()
_LETTER[97:123] = True
_MASK = np.zeros(256, bool)
_MASK[[ord(c) for c in "*#$%@&"]] = True


def entries(buf: np.ndarray, off: np.ndarray):
    """(text, key, kind) of all words and word beginnings, and the words of each text."""
    w = V.find_words(*V.letters_only(buf, off))
    text, size = w.text, w.end - w.start
    keys, where, kinds = [V.mix(w.hash)], [text], [np.zeros(len(text), np.int8)]
    for k, p in enumerate(PREFIXES, 1):
        long_ = np.flatnonzero(size > p)
        keys.append(V.mix(w.prefix(p, long_) + np.uint64(k)) if len(long_) else np.zeros(0, np.uint64))
        where.append(text[long_])
        kinds.append(np.full(len(long_), k, np.int8))
    return np.concatenate(where), np.concatenate(keys), np.concatenate(kinds), np.diff(w.first)


class Lexicon:
    """Sorted entry keys with a table of their high bits that answers most look-ups."""

    def __init__(self, keys: np.ndarray, kinds: np.ndarray, rank: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.kinds, self.rank = keys[order], kinds[order], rank[order]
        self.may = np.zeros(1 << 18, bool)
        self.may[self.keys >> np.uint64(46)] = True

    def hits(self, text: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, index of the entry) of every occurrence."""
        at = np.flatnonzero(self.may[keys >> np.uint64(46)])
        spot = np.searchsorted(self.keys, keys[at])
        good = spot < len(self.keys)
        good[good] = self.keys[spot[good]] == keys[at][good]
        return text[at[good]], spot[good]


def observe(lexicon: Lexicon, buf: np.ndarray, off: np.ndarray):
    """Per text: bitmask of firing voters, and pattern features; then (text, entry) of all hits."""
    n = len(off) - 1
    text, keys, kinds, words = entries(buf, off)
    who, entry = lexicon.hits(text, keys)
    count = np.bincount(who, minlength=n)
    size = np.maximum(np.diff(off), 1)
    symbols, capitals = V.sum_by_text(_SYMBOL[buf], off) / size, V.sum_by_text(_CAPITAL[buf], off) / size
    votes = np.zeros(n, np.int64)
    voter = lexicon.kinds[entry].astype(np.int64) * VOTERS_PER_KIND + (lexicon.keys[entry] & np.uint64(VOTERS_PER_KIND - 1)).astype(np.int64)
    np.bitwise_or.at(votes, who, np.int64(1) << voter)
    dense = count / np.maximum(words, 1)
    shouts = V.sum_by_text(buf == ord("!"), off) / np.maximum(words, 1)
    letter = _LETTER[buf]
    masked = np.zeros(len(buf), bool)  # a symbol right after a letter and before a letter or symbol of the same text
    masked[1:-1] = letter[:-2] & _MASK[buf[1:-1]] & (letter[2:] | _MASK[buf[2:]])
    masks = V.sum_by_text(masked, off) / np.maximum(words, 1)
    for k, fires in enumerate((count >= 4, dense > 0.01, dense > 0.03, symbols > 0.05, capitals > 0.3, shouts > 0.1, masks > 0.02)):
        votes |= fires.astype(np.int64) << (LEXICAL + k)
    patterns = np.stack([np.log1p(count), np.sqrt(dense), np.minimum(symbols * 10, 1), np.minimum(capitals * 2, 1), np.log1p(words) / 10], 1)
    return votes, patterns, who, entry




@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray  # entries taken into the classifier, then patterns, then the constant
    accuracies: list[np.ndarray | None]  # by half of the rows: (2, VOTERS), firing rates by class
    discounts: list[np.ndarray | None]

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        _, patterns, who, entry = observe(self.lexicon, buf, off)
        z = _design(self.lexicon, n, patterns, who, entry, self.weights)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _design(lexicon, n, patterns, who, entry, weights):
    """The linear score without building a dense matrix: log1p(count) by entry, patterns, constant."""
    z = patterns @ weights[CLASSIFIER_ENTRIES:-1] + weights[-1]
    rank = lexicon.rank[entry]
    use = rank < CLASSIFIER_ENTRIES
    pair, count = np.unique(who[use].astype(np.int64) * CLASSIFIER_ENTRIES + rank[use], return_counts=True)
    return z + np.bincount(pair // CLASSIFIER_ENTRIES, np.log1p(count) * weights[pair % CLASSIFIER_ENTRIES], minlength=n)


def discounts(rho: np.ndarray) -> np.ndarray:
    """Weight of each voter: voters joined by MIN_CORRELATION or more form clusters, and copies in a cluster share one vote."""
    near = rho >= MIN_CORRELATION
    np.fill_diagonal(near, True)
    while not (more := (near.astype(int) @ near > 0))[~near].sum() == 0:
        near = more
    return 1 / np.where(near, rho, 0).sum(1)


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60):
    """EM for a latent binary label over voter bitmasks; returns posterior by pattern, rates and discounts."""
    fires = (patterns[:, None] >> np.arange(VOTERS) & 1).astype(float)
    lexical = fires[:, :LEXICAL].sum(1)
    q = np.where(lexical >= 3, 0.95, np.where(lexical > 0, 0.15, 0.01))
    discount, weight = np.ones(VOTERS), counts.astype(float)
    for step in range(rounds):
        w1, w0 = weight * q, weight * (1 - q)
        prior = np.clip(w1.sum() / weight.sum(), 0.005, 0.995)
        rate1 = (w1 @ fires + 1) / (w1.sum() + 2)
        rate0 = (w0 @ fires + 1) / (w0.sum() + 2)
        if step >= 5:  # correlations of every two voters inside the classes
            total = np.zeros((VOTERS, VOTERS))
            for w, rate in ((w1, rate1), (w0, rate0)):
                rest = fires - rate
                total += (rest * w[:, None]).T @ rest
            scale = np.sqrt(np.maximum(np.diag(total), 1e-9))
            rho = np.clip(total / scale[:, None] / scale[None, :], 0, 1)
            np.fill_diagonal(rho, 1)
            discount = discounts(rho)
        llr = fires * np.log(rate1 / rate0) + (1 - fires) * np.log((1 - rate1) / (1 - rate0))
        z = np.log(prior / (1 - prior)) + llr @ discount
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return q, np.stack([rate0, rate1]), discount


def _train(x: np.ndarray, q: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Logistic regression on soft labels, by accelerated gradient steps with a ridge."""
    n, d = x.shape
    step = 4.0 / (np.mean(np.sum(x * x, 1)) * 4 + 1e-9)
    w = v = np.zeros(d, np.float32)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        new = v - step * ((x.T @ (p - q)) / n + 1e-5 * v)
        v = new + k / (k + 3.0) * (new - w)
        w = new
    return w


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    rated = labels.where("toxic is not null and doc_id is not null").where(fold() != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = rated.count()
    half = lambda c: F.pmod(F.xxhash64(c, F.lit(8)), F.lit(2)).cast("int")
    sample = rated.where(below_share(F.col("doc_id"), sample_rows / max(1, total), 5)).select(F.col("doc_id").alias("__id"), (F.col("toxic") == 1).alias("toxic"))
    read = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).select("toxic", half("doc_id").alias("half"), "text")
    seen = {(r["half"], r["toxic"]): r["count"] for r in sample.groupBy(half("__id").alias("half"), "toxic").count().collect()}
    size = np.array([[seen.get((h, t), 0) for h in (0, 1)] for t in (False, True)], float)

    def distinct(batches, known=None):
        for batch in batches:
            halves = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, buf, off in text_chunks(batch):
                text, keys, kinds, _ = entries(buf, off)
                if known is not None:
                    at = np.flatnonzero(known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys)
                    text, keys, kinds = text[at], keys[at], kinds[at]
                _, first = np.unique(V.mix(keys + text.astype(np.uint64) * V._BASE), return_index=True)
                keys, kinds, of = keys[first], kinds[first], halves[lo:hi][text[first]]
                _, at, n = np.unique(V.mix(keys + of.astype(np.uint64)), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), pa.array(kinds[at].astype(np.int32)), *(pa.array(np.where(of[at] == h, n, 0)) for h in (0, 1))], names=["key", "kind", "n0", "n1"])

    def counted(rows, known=None):
        found = rows.select("half", "text").mapInArrow(lambda b: distinct(b, known.value if known else None), "key long, kind int, n0 long, n1 long")
        return found.groupBy("key").agg(F.first("kind").alias("kind"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))

    found = counted(read.where("toxic")).where(F.col("n0") + F.col("n1") >= MIN_TOXIC_ROWS).toArrow()
    if not found.num_rows or not size[0].sum():
        return None
    keys, kinds = found.column("key").to_numpy().view(np.uint64), found.column("kind").to_numpy()
    wanted = docs.sparkSession.sparkContext.broadcast(np.sort(keys))
    others = counted(read.where("not toxic"), wanted).toArrow()
    wanted.destroy()
    place = {k: i for i, k in enumerate(keys.tolist())}
    pos, neg = np.stack([found.column(c).to_numpy() for c in ("n0", "n1")]).astype(float), np.zeros((2, len(keys)))
    neg[:, [place[k] for k in others.column("key").to_numpy().view(np.uint64).tolist()]] = [others.column(c).to_numpy() for c in ("n0", "n1")]
    lexicon = _lexicon(keys, kinds, pos.sum(0), neg.sum(0), size.sum(1), MIN_TOXIC_ROWS)
    # by half of a row: the lexicon of the other half, and that of both
    across = [_lexicon(keys, kinds, pos[1 - h], neg[1 - h], size[:, 1 - h], MIN_TOXIC_ROWS / 2) for h in (0, 1)]
    if not len(lexicon.keys):
        return None
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, across))
    every = docs.where(fold() != 2)
    some = every.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__id"), "left")
    some = some.where(F.col("toxic").isNotNull() | below_share(F.col("doc_id"), sample_rows / max(1, every.count()), 6)).select("text", F.coalesce(F.when(F.col("toxic"), 1).otherwise(F.when(~F.col("toxic"), -1)), F.lit(0)).cast("int").alias("given"), F.coalesce(half("doc_id"), F.lit(0)).alias("half"))

    def watch(batches):
        lexicon, across = shared.value
        for batch in batches:
            halves = batch.column(2).to_numpy(zero_copy_only=False)
            for lo, hi, buf, off in text_chunks(batch):
                votes = np.where(halves[lo:hi] == 0, observe(across[0], buf, off)[0], observe(across[1], buf, off)[0])
                _, patterns, who, entry = observe(lexicon, buf, off)
                n, rank = len(off) - 1, lexicon.rank[entry]
                use = rank < CLASSIFIER_ENTRIES
                pair = np.sort(who[use].astype(np.int64) * CLASSIFIER_ENTRIES + rank[use])
                at = np.searchsorted(pair, np.arange(n + 1) * CLASSIFIER_ENTRIES).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(votes), pa.array(list(patterns), pa.list_(pa.float64())), pa.ListArray.from_arrays(pa.array(at), pa.array((pair % CLASSIFIER_ENTRIES).astype(np.int32))), batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo)], names=["votes", "patterns", "hits", "given", "half"])

    rows = some.mapInArrow(watch, "votes long, patterns array<double>, hits array<int>, given int, half int").toArrow()  # bounded by the samples
    shared.destroy()
    if not rows.num_rows:
        return None
    votes, given, halves = (rows.column(c).to_numpy().astype(np.int64) for c in ("votes", "given", "half"))
    q, rates, discount = np.zeros(len(votes)), [None, None], [None, None]
    for h in (0, 1):
        mine = np.flatnonzero(halves == h)
        if len(mine):
            kinds_of, back, n = np.unique(votes[mine], return_inverse=True, return_counts=True)
            found_q, rates[h], discount[h] = label_model(kinds_of, n)
            q[mine] = found_q[back]
            bad, good = q[mine][given[mine] > 0], q[mine][given[mine] < 0]
            if len(bad) and len(good) and bad.mean() < good.mean():  # which class is which
                q[mine], rates[h] = 1 - q[mine], rates[h][::-1]
    x = np.zeros((len(votes), CLASSIFIER_ENTRIES + 6), np.float32)
    for i, hits in enumerate(rows.column("hits").to_pylist()):
        np.add.at(x[i], hits, 1)
    x[:, :CLASSIFIER_ENTRIES] = np.log1p(x[:, :CLASSIFIER_ENTRIES])
    x[:, CLASSIFIER_ENTRIES:-1] = np.array(rows.column("patterns").to_pylist())
    x[:, -1] = 1
    return Model(lexicon, _train(x, q.astype(np.float32)).astype(float), rates, discount)


def _lexicon(keys: np.ndarray, kinds: np.ndarray, pos: np.ndarray, neg: np.ndarray, size: np.ndarray, least: float) -> Lexicon:
    """Entries on `least` toxic documents or more and far more frequent there; size: other and toxic documents read."""
    ratio = (pos / max(size[1], 1)) / ((neg + 0.5) / max(size[0], 1))
    value = np.where((ratio >= MIN_RATIO) & (pos >= least), pos * np.log(np.maximum(ratio, 1)), -1)
    best = np.argsort(-value, kind="stable")[:MAX_ENTRIES]
    best = best[value[best] > 0]
    return Lexicon(keys[best], kinds[best], np.arange(len(best)))


def score_toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = learn(docs, labels) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for lo, hi, buf, off in text_chunks(batch):
                score = shared.value.score(buf, off) if shared.value else np.zeros(hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
