"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three machines are compiled from a model file, each as arrays of arcs:

* Normaliser: one arc that writes the meta symbol before a text, one arc from a space to the meta symbol, and
  arcs that copy all other characters.
* Pieces: a trie whose arcs (state, symbol) -> state read characters; a state that ends a piece writes its id. The
  weight of a piece depends on the piece before. In a BPE model it is 1 if the two can stand side by side, else
  infinite; in a unigram model it is minus the log probability.
* Byte fallback: an arc over any character that is no piece, which writes the ids of its UTF-8 bytes.

When two BPE pieces can stand side by side is compiled, too. A piece is built by merges in one order; its edge
symbols, each with the rank of the merge that takes it away, are arrays (Edges). Two pieces stay apart exactly if
no edge symbols of them that exist at one time merge into a piece of a better rank than the merges which take
them away. By this the model's own segmentation is the only path of finite weight.

Texts are composed with the machines lazily, many words in step: at each position only the trie states that some
start reaches are held, and the arcs that end there are relaxed in (min, +). A text is cut into words only between
characters that no piece holds side by side, so words are independent. Shortest paths of words are kept in a cache
of CACHE_SLOTS words and CACHE_IDS ids, about 25 MB whatever the corpus.

Defined results: a null or empty text has no ids and decodes to an empty text; repeated rows get equal results;
ids may be null; an empty table gives an empty result; other columns of the input are ignored. A meta symbol in
a text decodes to a space. Models with rules of normalisation, user-defined or unused pieces, or a BPE model whose merges
are out of order, are refused when compiled.
"""

from __future__ import annotations

import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext as V
from .common import text_chunks, utf8_column

META = "▁"
UNIGRAM, BPE = 1, 2
CACHE_SLOTS, CACHE_IDS = 1 << 19, 1 << 21
PAIR_SLOTS = 1 << 19
MAX_CACHED = 64  # characters of a word that is cached
LATTICE = 1 << 19  # positions of the words that are composed in step
LONG, STRETCH, OVERLAP = 8192, 5040, 128  # characters of words that are taken in stretches
PART = 1 << 20  # characters of a text that are looked at together
CUT_BITS = 1 << 24
_NEVER = np.iinfo(np.int64).max
_UNKNOWN = 10.0  # how much an unknown character costs beyond the worst piece of a unigram model


class Keyed:
    """A sorted table of 64-bit keys with a value for each; missing keys have a default."""

    def __init__(self, known: dict[int, int], default: int):
        keys = np.array(sorted(known), np.int64)
        self.keys = np.append(keys, _NEVER)
        self.values = np.array([known[k] for k in keys.tolist()] + [default], np.int64)
        self.default = default

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.values[at], self.default)


class Edges:
    """For every piece, the symbols at one of its ends in the order of its merges, and the rank that ends each."""

    def __init__(self, rows: list[list[tuple[int, int]]]):
        self.at = np.cumsum([0] + [len(r) for r in rows[:-1]])
        self.symbol = np.array([s for r in rows for s, _ in r], np.int64)
        self.rank = np.array([k for r in rows for _, k in r], np.int64)


class Merges:
    """Which BPE pieces can stand side by side."""

    def __init__(self, pieces: list[str], ids: dict[str, int], scores: list[float]):
        order = {s: k for k, s in enumerate(sorted({-x for x in scores}))}
        rank = {p: order[-scores[i]] for p, i in ids.items()}
        self.width = len(pieces)
        left, right, self.built = [], [], np.zeros(len(pieces), bool)
        for i, p in enumerate(pieces):
            ends = self._history(list(p), rank) if ids.get(p) == i else None
            self.built[i] = ends is not None
            left.append([(ids[s], k) for s, k in ends[0]] if ends else [(i, _NEVER)])
            right.append([(ids[s], k) for s, k in ends[1]] if ends else [(i, _NEVER)])
        self.left, self.right = Edges(left), Edges(right)
        joins = {ids[a] * self.width + ids[b]: rank[p] for p in ids for k in range(1, len(p)) if (a := p[:k]) in ids and (b := p[k:]) in ids}
        self.joins = Keyed(joins, _NEVER)
        self.tags, self.good = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)

    @staticmethod
    def _history(symbols: list[str], rank: dict[str, int]):
        """((symbol, rank that ends it) at the left end, the same at the right end), or None if the merges end short of one piece."""
        left, right, now = [], [], -1
        while len(symbols) > 1:
            found = [(rank[a + b], k) for k, (a, b) in enumerate(pairwise(symbols)) if a + b in rank]
            if not found:
                return None
            best, k = min(found)
            if best < now:
                raise ValueError("merges are out of order")
            now = best
            if k == 0:
                left.append((symbols[0], best))
            if k == len(symbols) - 2:
                right.append((symbols[-1], best))
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        return [*left, (symbols[0], _NEVER)], [*right, (symbols[0], _NEVER)]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece a can stand before piece b."""
        key = a * self.width + b
        slot = (V.mix(key.view(np.uint64)) & np.uint64(PAIR_SLOTS - 1)).astype(np.int64)
        out, new = self.good[slot], np.flatnonzero(self.tags[slot] != key)
        if len(new):
            fresh, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            good = self._compare(fresh // self.width, fresh % self.width)
            out[new] = good[back]
            spot = slot[new][first]
            self.tags[spot], self.good[spot] = fresh, good  # of keys with one slot the last stays, in both tables
        return out

    def _compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        good = np.zeros(len(a), bool)
        open_, i, j = np.arange(len(a)), self.right.at[a], self.left.at[b]
        while len(open_):
            mine, other = self.right.rank[i], self.left.rank[j]
            across = self.joins.get(self.right.symbol[i] * self.width + self.left.symbol[j])
            # of equal ranks the leftmost merge comes first
            merged = (across < mine) & (across <= other)
            ended = (mine == _NEVER) & (other == _NEVER)
            good[open_[ended & ~merged]] = True
            step = mine <= other
            rest = ~(merged | ended)
            open_, i, j = open_[rest], (i + step)[rest], (j + ~step)[rest]
        return good


class Transducer:
    """The compiled machines of one model file, with encode and decode."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.kind = _model_type(model_file)
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        scores = [model.get_score(i) for i in range(n)]
        byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        silent = {i for i in range(n) if model.is_control(i) or model.is_unknown(i)}
        if any(model.is_unused(i) for i in range(n)):
            raise ValueError("unused pieces are not compiled")
        ids = {p: i for i, p in enumerate(self.pieces) if i not in silent and i not in byte.values()}
        # byte fallback: the ids of every byte, or the unknown id once for a run of unknown characters
        self.byte_ids = np.array([byte.get(b, model.unk_id()) for b in range(256)], np.uint32) if byte else None
        self.unknown = model.unk_id()
        # normaliser: an arc that writes META at the start, and arcs of characters that do not stay
        self.prefix, self.rewrite = ord(META), {ord(" "): ord(META)}
        # pieces
        if self.kind == BPE and any(c not in ids for p in ids for c in p):
            raise ValueError("a character of a piece is no piece")
        self.merges = Merges(self.pieces, ids, scores) if self.kind == BPE else None
        self.weight, self.length = -np.array(scores), np.array([len(p) for p in self.pieces])
        self.fallback = float(self.weight[list(ids.values())].max()) + _UNKNOWN if self.kind == UNIGRAM else 1.0
        letters = sorted({c for p in ids for c in p})
        self.symbols = len(letters) + 1  # 0: in no piece
        self.symbol = np.zeros(0x110000, np.uint16 if self.symbols < 1 << 16 else np.uint32)
        self.symbol[[ord(c) for c in letters]] = np.arange(1, self.symbols)
        self._compile_trie({p: i for p, i in ids.items() if self.merges is None or self.merges.built[i]})
        self.alone = np.array([False] + [c in ids for c in letters])
        # cuts: a filter of the pairs of characters that some piece holds side by side; a false hit only joins words
        self.beside = np.zeros(min(CUT_BITS, self.symbols**2), bool)
        self.beside[[(int(self.symbol[ord(a)]) * self.symbols + int(self.symbol[ord(b)])) % len(self.beside) for p in ids for a, b in pairwise(p)]] = True
        self.surface = [b"" if i in silent else p.replace(META, " ").encode() for i, p in enumerate(self.pieces)]
        for b, i in byte.items():
            self.surface[i] = bytes([b])
        # shortest paths of words
        self.tag, self.spot, self.size = np.zeros(CACHE_SLOTS, np.uint64), np.zeros(CACHE_SLOTS, np.int32), np.zeros(CACHE_SLOTS, np.int32)
        self.pool, self.used = np.zeros(CACHE_IDS, np.uint32), 0

    def _compile_trie(self, ids: dict[str, int]) -> None:
        arcs, ends, states = {}, {}, 1
        for p, i in ids.items():
            at = 0
            for c in p:
                key = at * self.symbols + int(self.symbol[ord(c)])
                if key not in arcs:
                    arcs[key], states = states, states + 1
                at = arcs[key]
            ends[at] = i
        self.arcs = Keyed(arcs, -1)
        self.final = np.full(states, -1, np.int64)
        self.final[list(ends)] = list(ends.values())

    # normaliser

    def normalise(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points written by the normaliser for UTF-8 texts, and where each text begins."""
        points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        n = V.sum_by_text((buf & 0xC0) != 0x80, off)
        first = np.concatenate([[0], np.cumsum(np.where(n > 0, n + 1, 0))])
        out = np.empty(first[-1], np.uint32)
        copied = np.ones(len(out), bool)
        copied[first[:-1][n > 0]] = False
        out[~copied], out[copied] = self.prefix, points
        for old, new in self.rewrite.items():
            out[out == old] = new
        return out, first

    # composition and shortest paths

    def _paths(self, points: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, one after the other; how many of each)."""
        long_ = (size > LONG) & (self.merges is not None)
        raw, n = self._in_step(points, start[~long_], size[~long_])
        word = np.repeat(np.flatnonzero(~long_), n)
        for k in np.flatnonzero(long_).tolist():
            mine = self._joined(points, int(start[k]), int(size[k]))
            raw, word = np.concatenate([raw, mine]), np.concatenate([word, np.full(len(mine), k)])
        order = np.argsort(word, kind="stable")
        return self._written(word[order], raw[order], len(size))

    def _in_step(self, points: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(arcs on the paths of all words, how many of each); words of about one length are taken in step."""
        order = np.argsort(-size, kind="stable")
        parts, counts = [np.zeros(0, np.int32)], np.zeros(len(size), np.int64)
        lo = 0
        while lo < len(order):
            hi = lo + max(1, LATTICE // (int(size[order[lo]]) + 1))
            which = order[lo:hi]
            flat, counts[which] = self._relax(points, start[which], size[which])
            parts.append(flat)
            lo = hi
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate(parts)[_ranges(back, counts)], counts

    def _joined(self, points: np.ndarray, start: int, size: int) -> np.ndarray:
        """The path of a long BPE word, from paths of stretches of it that are found in step.

        Two paths that end and begin at one place, with pieces that can stand side by side, make a path of finite
        weight, and there is only one. Stretches overlap, so that there is such a place; where there is none,
        the word is taken whole.
        """
        for shift in (0, 1):
            begin = np.concatenate([[0], np.arange(STRETCH + shift, size, STRETCH)])
            end = np.minimum(begin + STRETCH + OVERLAP, size)
            raw, n = self._in_step(points, start + begin, end - begin)
            out, at, stops = raw[:0], np.zeros(0, np.int64), np.cumsum(n)
            for k, (b, stop) in enumerate(zip(begin.tolist(), stops.tolist())):
                mine = raw[stop - n[k] : stop]
                to = b + np.cumsum(np.where(mine >= 0, self.length[mine], 1))
                if k:
                    _, i, j = np.intersect1d(at, to - np.where(mine >= 0, self.length[mine], 1), return_indices=True)
                    fits = np.flatnonzero(self._weights(out[i].astype(np.int64), np.maximum(mine[j], 0)) < np.inf) if len(i) else i
                    fits = fits[mine[j[fits]] >= 0]
                    if not len(fits):
                        break
                    i, j = int(i[fits[0]]), int(j[fits[0]])
                    out, at = np.concatenate([out[: i + 1], mine[j:]]), np.concatenate([at[: i + 1], to[j:]])
                else:
                    out, at = mine, to
            else:
                return out
        return self._in_step(points, np.array([start]), np.array([size]))[0]

    def _relax(self, points: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shortest paths of words sorted by falling size."""
        n, longest = len(start), int(size[0])
        cost, last, came = np.full((longest + 1, n), np.inf), np.full((longest + 1, n), -1, np.int32), np.zeros((longest + 1, n), np.int32)
        cost[0] = 0
        word, begin, state = (np.zeros(0, np.int64) for _ in range(3))
        for k in range(1, longest + 1):
            live = int(np.searchsorted(-size, -k, "right"))
            held = word < live
            word, begin, state = np.concatenate([word[held], np.arange(live)]), np.concatenate([begin[held], np.full(live, k - 1)]), np.concatenate([state[held], np.zeros(live, np.int64)])
            point = points[start[:live] + k - 1]
            symbol = self.symbol[point].astype(np.int64)
            state = self.arcs.get(state * self.symbols + symbol[word])
            held = state >= 0
            word, begin, state = word[held], begin[held], state[held]
            piece = self.final[state]
            ends = piece >= 0
            w, b, p = word[ends], begin[ends], piece[ends]
            total = cost[b, w] + self._weights(last[b, w].astype(np.int64), p)
            np.minimum.at(cost[k], w, total)
            best = np.flatnonzero((total == cost[k][w]) & (total < np.inf))[::-1]
            last[k, w[best]], came[k, w[best]] = p[best], b[best]
            lone = np.flatnonzero(~self.alone[symbol])
            if len(lone):
                total = cost[k - 1, lone] + self.fallback
                lone, total = lone[total < cost[k, lone]], total[total < cost[k, lone]]
                cost[k, lone], last[k, lone], came[k, lone] = total, -2 - point[lone].astype(np.int32), k - 1
        return self._trace(size, last, came)

    def _weights(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        if self.merges is None:
            return self.weight[piece]
        out = np.ones(len(piece))
        inner = np.flatnonzero(before >= 0)
        out[inner[~self.merges.apart(before[inner], piece[inner])]] = np.inf
        return out

    def _trace(self, size: np.ndarray, last: np.ndarray, came: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(arcs on the way back from each word's end, in order; how many of each word)."""
        at, word, steps = size.copy(), np.arange(len(size)), []
        while len(word):
            steps.append((word, last[at, word]))
            at = came[at, word]
            word, at = word[at > 0], at[at > 0]
        word, out = np.concatenate([s[0] for s in steps])[::-1], np.concatenate([s[1] for s in steps])[::-1]
        return out[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(size))

    def _written(self, word: np.ndarray, out: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids that the arcs write, how many for each word): a piece its id, the fallback the bytes of its character."""
        odd = out < 0
        if not odd.any():
            return out.astype(np.uint32), np.bincount(word, minlength=words)
        if self.byte_ids is None:
            return np.where(odd, self.unknown, out).astype(np.uint32), np.bincount(word, minlength=words)
        raw = {c: np.frombuffer(chr(-2 - c).encode(), np.uint8) for c in np.unique(out[odd]).tolist()}
        repeat = np.ones(len(out), np.int64)
        repeat[odd] = [len(raw[c]) for c in out[odd].tolist()]
        wide = np.repeat(out, repeat)
        wide[np.repeat(odd, repeat)] = self.byte_ids[np.concatenate([raw[c] for c in out[odd].tolist()])]
        return wide.astype(np.uint32), np.bincount(word, repeat, minlength=words).astype(np.int64)

    # whole texts

    def encode_block(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a block, how many of each)."""
        points, first = self.normalise(buf, off)
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        symbol = self.symbol[points].astype(np.int64)
        cut = np.append(~self.beside[(symbol[:-1] * self.symbols + symbol[1:]) % len(self.beside)], True)
        cut[first[1:][first[1:] > 0] - 1] = True
        end = np.flatnonzero(cut) + 1
        parts, sizes, lo = [], [], 0
        while lo < len(end):
            begin = int(end[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(end, begin + PART, "right")))
            ids, n = self._words(points[begin : end[hi - 1]], end[lo:hi] - begin)
            parts.append(ids)
            sizes.append(n)
            lo = hi
        total = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        at = np.concatenate([[0], total[1:]])[np.searchsorted(end, first, "right")]
        ids, n = np.concatenate(parts), np.diff(at)
        if self.byte_ids is None:  # a run of unknown characters is one
            text = np.repeat(np.arange(len(n)), n)
            keep = ~((ids == self.unknown) & np.concatenate([[False], (ids[:-1] == self.unknown) & (text[1:] == text[:-1])]))
            ids, n = ids[keep], np.bincount(text[keep], minlength=len(n))
        return ids, n

    def _words(self, points: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each word) of words that lie one after the other."""
        start = np.concatenate([[0], end[:-1]])
        size = end - start
        up, down = V.powers(len(points) + 1)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(V.mix(points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=sums[1:])
        key = V.mix((sums[end] - sums[start]) * down[start] + size.astype(np.uint64)) | np.uint64(1)
        slot = (key & np.uint64(2 * CACHE_SLOTS - 1)) >> np.uint64(1)
        slot = slot.astype(np.int64)
        new = self.tag[slot] != key
        spot, count = self.spot[slot].astype(np.int64), self.size[slot].astype(np.int64)
        flat = np.zeros(0, np.uint32)
        if new.any():
            _, one, back = np.unique(key[new], return_index=True, return_inverse=True)
            which = np.flatnonzero(new)[one]
            flat, n = self._paths(points, start[which], size[which])
            at = np.cumsum(n) - n
            spot[new], count[new] = at[back], n[back]
        where, fresh = _ranges(spot, count), np.repeat(new, count)
        ids = np.empty(len(where), np.uint32)
        ids[~fresh], ids[fresh] = self.pool[where[~fresh]], flat[where[fresh]]
        if new.any():
            self._keep(key[which], slot[which], size[which], flat, at, n)
        return ids, count

    def _keep(self, key, slot, size, flat, at, n) -> None:
        """Cache the paths of short words; the cache starts again when its ids are full."""
        short = np.flatnonzero(size <= MAX_CACHED)
        _, one = np.unique(slot[short], return_index=True)
        short = short[one]
        ids = flat[_ranges(at[short], n[short])]
        if self.used + len(ids) > CACHE_IDS:
            self.tag[:], self.used = 0, 0
            if len(ids) > CACHE_IDS:
                return
        self.pool[self.used : self.used + len(ids)] = ids
        self.tag[slot[short]], self.spot[slot[short]], self.size[slot[short]] = key[short], self.used + np.cumsum(n[short]) - n[short], n[short]
        self.used += len(ids)

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_block(*utf8_column(pa.array([text or ""])))[0]

    def decode(self, ids) -> str:
        """Text of ids: bytes are joined as UTF-8, meta symbols become spaces, the dummy prefix goes."""
        text = b"".join(map(self.surface.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... of count[i] places each, for all i."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def _model_type(model_file: str) -> int:
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(model_file, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
        raise ValueError("only identity normalisation with a dummy prefix is compiled")
    if any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in model.pieces) or model.trainer_spec.model_type not in (UNIGRAM, BPE):
        raise ValueError("only BPE and unigram models without user-defined pieces are compiled")
    return model.trainer_spec.model_type


_machines: dict[str, Transducer] = {}


def machine(model_file: str) -> Transducer:
    if model_file not in _machines:
        _machines[model_file] = Transducer(model_file)
    return _machines[model_file]


def _coded(batches, model_file: str):
    """(rows of a batch, their ids, how many of each) of about a block of texts at a time."""
    fst = machine(model_file)
    for batch in batches:
        for lo, hi, buf, off in text_chunks(batch):
            yield batch.slice(lo, hi - lo), *fst.encode_block(buf, off)


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """One row per document: doc_id, ids."""

    def run(batches):
        for rows, ids, n in _coded(batches, model_file):
            at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model_file: str) -> DataFrame:
    """One row per document: doc_id, text."""

    def run(batches):
        fst = machine(model_file)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                texts = [fst.decode(x.values.to_numpy()) if x.is_valid else "" for x in rows.column(1)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_file: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_crc32 (little-endian unsigned 32-bit ids), decoded_equal."""

    def run(batches):
        fst = machine(model_file)
        for rows, ids, n in _coded(batches, model_file):
            ends = np.cumsum(n)
            coded = [ids[e - k : e] for e, k in zip(ends.tolist(), n.tolist())]
            back = [fst.decode(c) == (t or "") for c, t in zip(coded, rows.column(1).to_pylist())]
            crc = [zlib.crc32(c.astype("<u4").tobytes()) for c in coded]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(back, pa.bool_())], names=["doc_id", "n_tokens", "ids_crc32", "decoded_equal"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_equal boolean")
