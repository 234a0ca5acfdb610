"""Packing documents into sequences of at most CAPACITY tokens by length patterns.

Only the histogram of piece lengths, at most CAPACITY numbers, decides how many sequences of which kind are made:

* patterns are all groups of up to three lengths of the histogram that fill a sequence exactly (short lengths, which fill gaps
  anywhere, are left out);
* how often each is used is a non-negative least-squares fit of the patterns to the histogram, by coordinate descent on the
  patterns with the greatest gradients, which keeps the solution sparse; long lengths weigh more, as short pieces fit anywhere;
* counts are rounded and cut to what the histogram has; what is left over is packed best-fit, longest first, all
  sequences with equal room at a time. Rounding costs most where patterns are used once or twice, so rare patterns are left
  over too if that makes fewer sequences; of the few fits and least uses tried, the plan with the fewest sequences is taken.

The result is a plan: "pieces r to r + c of length l go to sequences s to s + c at offset o". Its size depends on CAPACITY alone.
Pieces get their rank among those of their length from counts of the tasks that wrote them, and take their place from the
plan, so documents are neither sorted nor gathered, and a length that a third of all pieces have is dealt out like any other.

Texts are encoded once; pieces with their ids are a table in the shared folder.

Defined results: a null or empty text has only the end id; repeated rows and null doc_ids are documents of their own;
an empty table packs to an empty table; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import ChunkCache
from .common import written

CAPACITY = 2048
END_ID = 0
ENCODED_CHARS = 1 << 18
LINES_AT_ONCE = 256
FIT_ROUNDS, STEPS_PER_ROUND = 400, 256
#: Fits tried: how steeply weights rise with length, and how often a pattern must be used at least; rarer ones are left to best fit.
STEEPNESS, LEAST_USES = (1, 3), (1, 3, 10, 1 << 62)
#: Lengths below a 32nd of the capacity are in no pattern: they fill what the rest leaves free.
PATTERN_SHARE = 32
#: White space as Unicode defines it; Python's own \s has four control characters more.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER, _SIGN = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff", r"!-&(-/:-@\[-`{-~"
#: The vocabulary's pre-tokenizer never joins these: letters end at a sign (but for an apostrophe), a space goes with what follows it, and white space before that stands alone.
_CHUNK = re.compile(rf" ?[{_LETTER}]++(?=[{_SIGN}])| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]")
#: Where none of these occurs, a text can be cut before every space, full stop and comma, and on both sides of a line feed.
_SPACES, _ASCII_SPACES, _BESIDE = re.compile(rf"[{_SPACE}][{_SPACE}]"), re.compile(r"[\t-\r ][\t-\r ]"), re.compile(rf"[^0-9{_LETTER}][.,]")
_PIECES = "part int, doc_id long, piece int, start long, length int, rank long, ids binary"


class ByteEncoder:
    """The library's encoding of whole texts, by cached chunks."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file)
        (self.line,) = self.library.encode("\n", add_special_tokens=False).ids
        self.cache = ChunkCache(self._learn)

    def _learn(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Encode chunks; those without white space but for a space before them go by the hundred, a line feed between two, which the pre-tokenizer sets apart."""
        sizes, parts, lo = np.zeros(len(chunks), np.int64), [], 0
        plain = [bool(c) and not c.isspace() and "<|" not in c for c in chunks]
        first = len(chunks) - sum(plain)
        chunks = [c for c, p in zip(chunks, plain) if not p] + [c for c, p in zip(chunks, plain) if p]
        while lo < len(chunks):
            hi = min(lo + LINES_AT_ONCE, first if lo < first else len(chunks))
            if lo >= first:
                flat = np.array(self.library.encode_batch_fast(["\n".join(chunks[lo:hi])], add_special_tokens=False)[0].ids, np.uint32)
                cut = np.flatnonzero(flat == self.line)
                sizes[lo:hi] = np.diff(np.concatenate([[-1], cut, [len(flat)]])) - 1
                flat = np.delete(flat, cut)
            else:
                lists = [e.ids for e in self.library.encode_batch_fast(chunks[lo:hi], add_special_tokens=False)]
                sizes[lo:hi] = [len(x) for x in lists]
                flat = np.fromiter((i for x in lists for i in x), np.uint32)
            parts.append(flat)
            lo = hi
        return chunks, np.concatenate(parts), sizes

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Chunks that encode alone as they do in the text; a text that may name a special token is one chunk."""
        if "<|" in text:
            return [text]
        if "\0" in text or (_ASCII_SPACES if text.isascii() else _SPACES).search(text) or _BESIDE.search(text):
            return _CHUNK.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").replace(".", "\0.").replace(",", "\0,").split("\0")

    def encode(self, texts: list[str | None], end_id: int = END_ID) -> list[np.ndarray]:
        """Ids of each text and end_id after them."""
        parts = [self.chunks(t or "") for t in texts]
        flat, sizes = self.cache.encode([c for p in parts for c in p])
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, parts)])]
        return [np.append(flat[a:b], np.uint32(end_id)) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


_encoders: dict[str, ByteEncoder] = {}


def _encoder(tokenizer_file: str) -> ByteEncoder:
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = ByteEncoder(tokenizer_file)
    return _encoders[tokenizer_file]


def encoded_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents, written: part, doc_id, piece, start, length, rank among the part's pieces of its length, ids (little-endian)."""
    own = docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches):
        seen = np.zeros(capacity + 1, np.int64)

        def rows(part, doc_ids, texts):
            columns = [[], [], [], [], [], []]
            for doc_id, ids in zip(doc_ids, _encoder(tokenizer_file).encode(texts, end_id)):
                n = len(ids)
                cuts = [0, *range(n - (n - 1) // capacity * capacity, n + 1, capacity)]
                raw = ids.astype("<u4")
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for column, value in zip(columns, (doc_id, piece, a, b - a, int(seen[b - a]), raw[a:b].tobytes())):
                        column.append(value)
                    seen[b - a] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), part, np.int32)), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["part", "doc_id", "piece", "start", "length", "rank", "ids"])

        for batch in batches:
            part = batch.column(0)[0].as_py() if batch.num_rows else 0
            ids, texts = batch.column(1).to_pylist(), batch.column(2)
            ends = np.cumsum(np.nan_to_num(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(float)))
            lo = 0
            while lo < len(ids):  # about ENCODED_CHARS of text at a time
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + ENCODED_CHARS, "right")))
                yield rows(part, ids[lo:hi], texts.slice(lo, hi - lo).to_pylist())
                lo = hi

    return written(own.mapInArrow(run, _PIECES), "pieces")


def patterns(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """All groups of up to three of the (distinct) lengths that fill the capacity, as rows of ascending lengths with zeros before."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    lengths = np.flatnonzero(have)
    one = lengths[lengths == capacity]
    two = lengths[(2 * lengths <= capacity) & have[capacity - lengths]]
    a, b = np.meshgrid(lengths[3 * lengths <= capacity], lengths[2 * lengths < capacity], indexing="ij")
    c = capacity - a - b
    fits = (a <= b) & (b <= c) & have[np.maximum(c, 0)]
    zero = lambda x: np.zeros_like(x)
    return np.concatenate([
        np.stack([zero(one), zero(one), one], 1),
        np.stack([zero(two), two, capacity - two], 1),
        np.stack([a[fits], b[fits], c[fits]], 1),
    ])


def fit_counts(histogram: np.ndarray, groups: np.ndarray, steepness: float = 1) -> np.ndarray:
    """x >= 0 that minimises the weighted squares of (histogram - what x uses of each length), weights rising with length.

    Coordinate descent: the patterns of the greatest projected gradients are solved for exactly, one after the other.
    """
    weight = (np.arange(len(histogram)) / (len(histogram) - 1)) ** steepness
    left = histogram.astype(float)
    left[0] = weight[0] = 0.0
    x = np.zeros(len(groups))
    # how often a length stands in its pattern, at its first place; 0 at the others
    times = np.ones(groups.shape)
    for k in (2, 1):
        same = groups[:, k] == groups[:, k - 1]
        times[same, k - 1] += times[same, k]
        times[same, k] = 0
    times[groups == 0] = 0
    norm = (times**2 * weight[groups]).sum(1)
    for _ in range(FIT_ROUNDS if len(groups) else 0):
        pull = weight * left
        gradient = sum(times[:, k] * pull[groups[:, k]] for k in range(3))
        step = np.maximum(gradient / norm, -x)
        gain = step * gradient
        best = np.argpartition(gain, -STEPS_PER_ROUND)[-STEPS_PER_ROUND:] if len(gain) > STEPS_PER_ROUND else np.arange(len(gain))
        best = best[np.argsort(-gain[best], kind="stable")]
        moved = 0.0
        for j in best.tolist():
            g, t = groups[j], times[j]
            step_j = max(float((t * weight[g] * left[g]).sum() / norm[j]), -x[j])
            if step_j:
                x[j] += step_j
                np.subtract.at(left, g, step_j * t)
                moved = max(moved, abs(step_j))
        if moved < 0.25:  # counts are rounded: no whole sequence is gained any more
            break
    return x


def plan_sequences(histogram: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """(plan, number of sequences) for histogram[l] pieces of each length l.

    A plan row is length, first rank, pieces, first sequence, offset: consecutive ranks go to consecutive sequences.
    """
    shortest = max(1, capacity // PATTERN_SHARE)
    groups = patterns(np.flatnonzero(histogram[shortest:]) + shortest, capacity)
    fits = [np.floor(fit_counts(histogram, groups, steepness) + 0.5).astype(np.int64) for steepness in STEEPNESS]
    tried = (_plan(histogram, groups, np.where(counts >= least, counts, 0), capacity) for counts in fits for least in LEAST_USES)
    return min(tried, key=lambda made: made[1])


def _plan(histogram: np.ndarray, groups: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Use patterns as often as counts say and the histogram allows, and pack the rest best-fit."""
    left = histogram.astype(np.int64).copy()
    rank = np.zeros(capacity + 1, np.int64)
    plan, made = [], 0

    def place(length, pieces, first, offset):
        plan.append((length, int(rank[length]), pieces, first, offset))
        rank[length] += pieces
        left[length] -= pieces

    used = np.flatnonzero(counts)
    for j in used[np.lexsort((used, -counts[used]))].tolist():
        group = [g for g in groups[j].tolist() if g]
        n = min(int(counts[j]), *(int(left[g]) // group.count(g) for g in group))
        if n > 0:
            offset = 0
            for g in reversed(group):
                place(g, n, made, offset)
                offset += g
            made += n
    # best fit for the rest: room[r] holds (first sequence, sequences) with r tokens free
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        free = length
        while left[length] and free < capacity:
            if not room[free]:
                free += 1
                continue
            first, n = room[free].pop()
            take = min(n, int(left[length]))
            place(length, take, first, capacity - free)
            room[free - length].append((first, take))
            if take < n:
                room[free].append((first + take, n - take))
        if left[length]:
            each = capacity // length
            full, rest = divmod(int(left[length]), each)
            for n, per in ((full, each), (1 if rest else 0, rest)):
                if n:
                    for k in range(per):
                        place(length, n, made, k * length)
                    room[capacity - per * length].append((made, n))
                    made += n
    return np.array(sorted(plan), np.int64).reshape(-1, 5), made


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset; other columns than part, length and rank are carried along."""
    spark = pieces.sparkSession
    counts = written(pieces.groupBy("part", "length").agg((F.max("rank") + 1).alias("n")), "lengths")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    plan, _ = plan_sequences(histogram, capacity)
    shared = spark.sparkContext.broadcast(plan)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select("part", "length", before.alias("before"))
    ranked = pieces.join(first.hint("merge"), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "part")
    names = [c for c in ranked.columns if c != "rank"]
    at_length, at_rank = ranked.columns.index("length"), ranked.columns.index("rank")

    def run(batches):
        plan = shared.value
        starts = np.searchsorted(plan[:, 0], np.arange(capacity + 2))
        for batch in batches:
            length, rank = batch.column(at_length).to_numpy(), batch.column(at_rank).to_numpy()
            row = np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            bounds = np.flatnonzero(np.diff(length[order])) + 1
            for own in np.split(order, bounds) if len(order) else []:
                lo, hi = starts[length[own[0]]], starts[length[own[0]] + 1]
                row[own] = lo + np.searchsorted(plan[lo:hi, 1], rank[own], "right") - 1
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(plan[row, 3] + rank - plan[row, 1]), pa.array(plan[row, 4])], names=[*names, "sequence_id", "offset"])

    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema.fields}
    return ranked.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, n_tokens, ids (little-endian, binary) and the offsets at which documents begin; a sequence is a bounded group."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    joined = F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))")
    return placed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("n_tokens")).select("sequence_id", "n_tokens", joined.alias("ids"), F.col("parts.offset").alias("offsets"))


def pack_digest(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Place and checksum of every piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The ids are read where they were written; only their checksums meet the plan.
    """
    pieces = encoded_pieces(docs, tokenizer_file, capacity, end_id)
    short = pieces.select("part", "rank", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return place_pieces(short, capacity).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
