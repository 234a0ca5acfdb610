"""Quality rules as a short-circuit cascade.

Each rule is a vectorised predicate over a block of texts that says which texts it rejects. A bounded
sample of rows gives each rule's marginal cost, which is what it takes when the facts that are computed anyway are known,
and which rows it rejects; rules are then ordered greedily by rejections among the rows still alive per cost, and a
rule only ever sees texts that all earlier rules let through. Facts are computed when a rule first asks for
them, for the texts alive then. The verdict is the same in any order: a text is kept if no rule rejects it.

keep_good() needs words only and saves every other fact of rejected texts; evaluations() counts what is saved.
apply_rules() returns five counts of every text, which are known facts to its rules; what it saves is the rest.

Defined results: a null text counts as empty, has no words and is rejected; repeated rows each get a row; an
empty table gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext as V
from .common import below_share, text_chunks

SAMPLE_ROWS = 2000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MAX_SYMBOLS_PER_100_WORDS = 10
MIN_DUP_LINES, MAX_DUP_LINE_PERCENT = 3, 30
MEAN_WORD_CHARS = (2, 14)
MAX_CAPITAL_PERCENT = 40
MAX_TOP_WORD_PERCENT = 30

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
CAPITAL = np.zeros(256, bool)
CAPITAL[65:91] = True
LETTER = CAPITAL.copy()
LETTER[97:123] = True


class Block:
    """Texts of one block with what rules share, computed when first asked for."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off, self._known = buf, off, {}

    def get(self, name: str, make: Callable):
        if name not in self._known:
            self._known[name] = make()
        return self._known[name]

    def bytes_in(self, table: np.ndarray) -> np.ndarray:
        return V.sum_by_text(table[self.buf], self.off)

    @property
    def words(self) -> V.Words:
        return self.get("words", lambda: V.find_words(self.buf, self.off))

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words.first)

    @property
    def word_chars(self) -> np.ndarray:
        """Code points in words: bytes that neither separate words nor continue a character."""
        return self.get("chars", lambda: self.bytes_in(_STARTS_CHARACTER))

    @property
    def n_symbols(self) -> np.ndarray:
        return self.get("symbols", lambda: self.bytes_in(SYMBOL))

    @property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Per text: lines that have a word, and those of them that equal an earlier one."""
        return self.get("lines", self._lines)

    def _lines(self):
        texts = len(self.off) - 1
        lines = V.find_words(self.buf, self.off, gap=_NEWLINE)
        has = np.searchsorted(self.words.start, lines.end) > np.searchsorted(self.words.start, lines.start)
        text, value = lines.text[has], lines.hash[has]
        _, first = np.unique(V.mix(value + text.astype(np.uint64) * V._BASE), return_index=True)
        n = np.bincount(text, minlength=texts)
        return n, n - np.bincount(text[first], minlength=texts)

    @property
    def n_repeat_words(self) -> np.ndarray:
        return self.get("repeats", self._repeats)

    def _repeats(self):
        w = self.words
        at, value = V.windows(w, 3)
        text = w.text
        _, back, count = np.unique(V.mix(value + text[at].astype(np.uint64) * V._BASE), return_inverse=True, return_counts=True)
        at = at[count[back] > 1]
        covered = np.zeros(len(w.hash), bool)
        for k in range(3):
            covered[at + k] = True
        return V.sum_by_text(covered, w.first)

    @property
    def top_word(self) -> np.ndarray:
        """Occurrences of each text's most frequent word."""
        w = self.words
        text = w.text
        _, first, count = np.unique(V.mix(w.hash + text.astype(np.uint64) * V._BASE), return_index=True, return_counts=True)
        top = np.zeros(len(self.off) - 1, np.int64)
        np.maximum.at(top, text[first], count)
        return top


_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_STARTS_CHARACTER = ~V.SPACE
_STARTS_CHARACTER[0x80:0xC0] = False


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Block], np.ndarray]


RULES = (
    Rule("few_words", lambda b: b.n_words < MIN_WORDS),
    Rule("repeated_windows", lambda b: 100 * b.n_repeat_words > MAX_REPEAT_PERCENT * b.n_words),
    Rule("symbols", lambda b: 100 * b.n_symbols > MAX_SYMBOLS_PER_100_WORDS * b.n_words),
    Rule("repeated_lines", lambda b: (b.lines[1] >= MIN_DUP_LINES) & (100 * b.lines[1] > MAX_DUP_LINE_PERCENT * b.lines[0])),
    Rule("word_length", lambda b: (b.word_chars < MEAN_WORD_CHARS[0] * b.n_words) | (b.word_chars > MEAN_WORD_CHARS[1] * b.n_words)),
    Rule("capitals", lambda b: 100 * b.bytes_in(CAPITAL) > MAX_CAPITAL_PERCENT * b.bytes_in(LETTER)),
    Rule("top_word", lambda b: 100 * b.top_word > MAX_TOP_WORD_PERCENT * b.n_words),
)


def _select(block: Block, rows: np.ndarray) -> Block:
    """The block of some of a block's texts, with what is known of them."""
    sizes = np.diff(block.off)
    off = np.concatenate([[0], np.cumsum(sizes[rows])])
    keep = np.repeat(np.isin(np.arange(len(sizes)), rows), sizes)
    out = Block(block.buf[keep], off)
    for name in ("chars", "symbols", "repeats"):
        if name in block._known:
            out._known[name] = block._known[name][rows]
    if "lines" in block._known:
        out._known["lines"] = tuple(x[rows] for x in block._known["lines"])
    return out


def cascade(block: Block, rules, seen: list[int] | None = None) -> np.ndarray:
    """True for the texts that no rule rejects; each rule runs on the texts alive before it, whose number is added to `seen`."""
    alive, now = np.arange(len(block.off) - 1), block
    for rule in rules:
        if seen is not None:
            seen.append(len(alive))
        if not len(alive):
            break
        passed = ~rule.rejects(now)
        if not passed.all():
            alive, now = alive[passed], _select(now, np.flatnonzero(passed))
    if seen is not None:
        seen.append(len(alive))
    kept = np.zeros(len(block.off) - 1, bool)
    kept[alive] = True
    return kept


WORDS = ("n_words",)
COUNTS = ("n_words", "word_chars", "n_symbols", "lines", "n_repeat_words")


def _known(buf: np.ndarray, off: np.ndarray, facts: tuple[str, ...]) -> Block:
    block = Block(buf, off)
    for name in facts:
        getattr(block, name)
    return block


def measured_order(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS, known: tuple[str, ...] = WORDS) -> list[str]:
    """Rule names ordered by rejection per marginal cost on a sample of about `sample_rows` rows; `known` facts cost nothing."""
    total = docs.count()
    if not total:
        return [r.name for r in rules]
    sample = docs.select("text").sample(min(1.0, sample_rows / total), seed=9)
    names = [r.name for r in rules]

    def probe(batches):
        for batch in batches:
            for _, _, buf, off in text_chunks(batch):
                bits, seconds = np.zeros(len(off) - 1, np.int64), []
                block = _known(buf, off, known)
                facts = dict(block._known)
                for k, r in enumerate(rules):
                    block._known = dict(facts)
                    began = time.perf_counter()
                    bits |= r.rejects(block).astype(np.int64) << k
                    seconds.append(time.perf_counter() - began)
                values, counts = np.unique(bits, return_counts=True)
                yield pa.RecordBatch.from_pydict({"bits": pa.array(values, pa.int64()), "n": pa.array(counts, pa.int64()), "seconds": pa.array([seconds] + [[0.0] * len(rules)] * (len(values) - 1), pa.list_(pa.float64()))})

    found = sample.mapInArrow(probe, "bits long, n long, seconds array<double>")
    rows = found.groupBy("bits").agg(F.sum("n").alias("n"), *[F.sum(F.get("seconds", F.lit(k))).alias(f"s{k}") for k in range(len(rules))]).collect()  # at most 2 ** rules
    cost = [sum(r[f"s{k}"] for r in rows) + 1e-9 for k in range(len(rules))]
    return [names[k] for k in best_order([(r["bits"], r["n"]) for r in rows], cost)]


def best_order(seen: list[tuple[int, int]], cost: list[float]) -> list[int]:
    """Greedy order of rules: most rejections among the rows still alive per cost. seen: (bits of rejecting rules, rows)."""
    alive, order = seen, []
    while len(order) < len(cost):
        left = [k for k in range(len(cost)) if k not in order]
        best = max(left, key=lambda k: (sum(n for bits, n in alive if bits >> k & 1) / cost[k], -cost[k], -k))
        order.append(best)
        alive = [(bits, n) for bits, n in alive if not bits >> best & 1]
    return order


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def apply_rules(docs: DataFrame, rules=RULES, order: list[str] | None = None) -> DataFrame:
    """One row per document: counts, the base verdict and the cascade's verdict (kept)."""
    order = measured_order(docs, rules, known=COUNTS) if order is None else order
    by_name = {r.name: r for r in rules}
    ordered = [by_name[n] for n in order]

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, off in text_chunks(batch):
                b = _known(buf, off, COUNTS)
                n, repeats = b.n_words, b.n_repeat_words
                failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
                columns = [n, b.word_chars, b.n_symbols, b.lines[1], repeats, failed, cascade(b, ordered) & ~failed]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *map(pa.array, columns)], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def _ordered(docs: DataFrame, rules, order: list[str] | None) -> list[Rule]:
    by_name = {r.name: r for r in rules}
    return [by_name[n] for n in (measured_order(docs, rules) if order is None else order)]


def keep_good(docs: DataFrame, rules=RULES, order: list[str] | None = None) -> DataFrame:
    """The documents (all their columns) that no rule rejects."""
    ordered = _ordered(docs, rules, order)

    def run(batches):
        for batch in batches:
            for lo, hi, buf, off in text_chunks(batch):
                yield batch.slice(lo, hi - lo).filter(pa.array(cascade(Block(buf, off), ordered)))

    return docs.mapInArrow(run, docs.schema)


def evaluations(docs: DataFrame, rules=RULES, order: list[str] | None = None) -> DataFrame:
    """One row per rule in the order they run: place, rule, seen (texts that it looked at), rejected."""
    ordered = _ordered(docs, rules, order)

    def run(batches):
        for batch in batches:
            for _, _, buf, off in text_chunks(batch):
                seen: list[int] = []
                cascade(Block(buf, off), ordered, seen)
                seen += [0] * (len(ordered) + 1 - len(seen))
                yield pa.RecordBatch.from_arrays([pa.array(range(len(ordered)), pa.int64()), pa.array([r.name for r in ordered]), pa.array(seen[:-1], pa.int64()), pa.array([a - b for a, b in zip(seen, seen[1:])], pa.int64())], names=["place", "rule", "seen", "rejected"])

    return docs.select("text").mapInArrow(run, "place long, rule string, seen long, rejected long").groupBy("place", "rule").agg(F.sum("seen").alias("seen"), F.sum("rejected").alias("rejected")).orderBy("place")
