"""Token-id output as one wavelet matrix file per shard.

Documents are dealt by ranges of doc_id and sorted inside each, encoded with a `tokenizers` vocabulary, and cut
into shards of about SHARD_TOKENS ids (a document is never cut). Each shard becomes one Parquet file of one row
in the shared folder, whose payload is self-contained:

    magic, ids, planes | zeros and bytes of each plane | per plane: ones before each block, its start, blocks | doc_ids, lengths

Plane k holds bit (planes - 1 - k) of every id, stably sorted by the bits before it, in compressed blocks of BLOCK_BYTES; access,
rank, count, select and occurrence look-up unpack a block or two of each plane.

Texts are cut into pieces that the vocabulary's pre-tokenizer never joins, by array operations on the bytes of a block of texts. The block's
distinct pieces are looked up in a cache within a bound of bytes (chunks.py); unseen ones are encoded by the library in bulk.

Defined results: a null or empty text has only the end id; equal doc_ids are ordered by a hash of the text, a null doc_id comes
first; repeated rows are repeated documents; an empty table writes no shard; other columns are ignored.
"""

from __future__ import annotations

import re
import string
import struct
import unicodedata
import zlib
from bisect import bisect_right
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import LONGEST_KEPT, ChunkCache
from .common import shared_dir, text_chunks, utf8_column

SHARD_TOKENS = 1 << 22
ROWS_PER_RANGE, MAX_RANGES = 4000, 50_000
END_ID = 2
BLOCK_BYTES, KEPT_BLOCKS = 1 << 13, 64
PARTS_PER_BLOCK = 4096
WORDS_AT_ONCE, CHUNKS_AT_ONCE = 128, 1024
TEXT_BYTES = 1 << 21
_MAGIC = b"WVM2"


class WaveletMatrix:
    """Succinct sequence of ids: bit planes in compressed blocks, with rank and select.

    A plane is cut into blocks of BLOCK_BYTES, compressed one by one. Before them stand two arrays, the ones before every block and
    where its bytes begin, so that an access, count or select unpacks a block or two of each plane and reads nothing else
    of the file. `bytes_read` tells how much that was; a few unpacked blocks are kept.
    """

    def __init__(self, data):
        view = memoryview(data)
        if bytes(view[:4]) != _MAGIC:
            raise ValueError("not a wavelet matrix file")
        self.n, bits = struct.unpack_from("<QI", view, 4)
        self.zeros = np.frombuffer(view, "<u8", bits, 16).tolist()
        sizes, at = np.frombuffer(view, "<u8", bits, 16 + 8 * bits).tolist(), 16 + 16 * bits
        self.planes = [view[p : p + size] for p, size in zip(np.cumsum([at, *sizes]).tolist(), sizes)]
        self.blocks = -(-self.n // (8 * BLOCK_BYTES))
        self.bytes_read = 16 + 16 * bits
        self._kept: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()
        self._unpack = zstandard.ZstdDecompressor().decompress

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length() if len(ids) else 1)
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        pack = zstandard.ZstdCompressor(level=1).compress
        planes, zeros = [], []
        for k in reversed(range(bits)):
            b = (now >> now.dtype.type(k) & now.dtype.type(1)).astype(bool)
            packed = np.packbits(b, bitorder="little")
            cuts = range(0, len(packed), BLOCK_BYTES)
            ones = np.cumsum([0, *(int(np.bitwise_count(packed[c : c + BLOCK_BYTES]).sum(dtype=np.int64)) for c in cuts)])
            parts = [pack(packed[c : c + BLOCK_BYTES]) for c in cuts]
            starts = np.cumsum([16 * (len(parts) + 1), *map(len, parts)])
            planes.append(b"".join([ones.astype("<u8").tobytes(), starts.astype("<u8").tobytes(), *parts]))
            zeros.append(len(b) - int(ones[-1]))
            now = np.concatenate([np.compress(~b, now), np.compress(b, now)])
        head = _MAGIC + struct.pack("<QI", len(ids), bits)
        return cls(b"".join([head, np.array(zeros, "<u8").tobytes(), np.array([len(p) for p in planes], "<u8").tobytes(), *planes]))

    def to_bytes(self) -> bytes:
        head = _MAGIC + struct.pack("<QI", self.n, len(self.planes))
        return b"".join([head, np.array(self.zeros, "<u8").tobytes(), np.array([len(p) for p in self.planes], "<u8").tobytes(), *map(bytes, self.planes)])

    from_bytes = classmethod(lambda cls, data: cls(data))

    def _ones(self, k: int, block: int) -> int:
        """Ones of plane k before a block."""
        self.bytes_read += 8
        return struct.unpack_from("<Q", self.planes[k], 8 * block)[0]

    def _block(self, k: int, block: int) -> np.ndarray:
        key = (k, block)
        if key in self._kept:
            self._kept.move_to_end(key)
            return self._kept[key]
        lo, hi = struct.unpack_from("<QQ", self.planes[k], 8 * (self.blocks + 1 + block))
        self.bytes_read += 16 + hi - lo
        self._kept[key] = np.frombuffer(self._unpack(self.planes[k][lo:hi], max_output_size=BLOCK_BYTES), np.uint8)
        if len(self._kept) > KEPT_BLOCKS:
            self._kept.popitem(last=False)
        return self._kept[key]

    def _ones_before(self, k: int, i: int) -> int:
        block, rest = divmod(i, 8 * BLOCK_BYTES)
        if not rest:
            return self._ones(k, block)
        bits = self._block(k, block)
        odd = int(bits[rest >> 3]) & (1 << (rest & 7)) - 1 if rest & 7 else 0
        return self._ones(k, block) + int(np.bitwise_count(bits[: rest >> 3]).sum(dtype=np.int64)) + odd.bit_count()

    def __getitem__(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for k in range(len(self.planes)):
            block, rest = divmod(i, 8 * BLOCK_BYTES)
            b, ones = int(self._block(k, block)[rest >> 3]) >> (rest & 7) & 1, self._ones_before(k, i)
            out = out << 1 | b
            i = self.zeros[k] + ones if b else i - ones
        return out

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        if symbol >> len(self.planes):
            return 0, 0
        for k in range(len(self.planes)):
            a, b = self._ones_before(k, lo), self._ones_before(k, hi)
            if symbol >> (len(self.planes) - 1 - k) & 1:
                lo, hi = self.zeros[k] + a, self.zeros[k] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id in positions lo to hi."""
        a, b = self._range(symbol, lo, self.n if hi is None else hi)
        return b - a

    def select(self, symbol: int, j: int) -> int:
        """Position of the j-th occurrence (from 0) of an id; -1 if there are fewer."""
        lo, hi = self._range(symbol, 0, self.n)
        return int(self._back(symbol, np.array([lo + j]))[0]) if 0 <= j < hi - lo else -1

    def occurrences(self, symbol: int) -> list[int]:
        """All positions of an id, by one walk up the planes."""
        return self._back(symbol, np.arange(*self._range(symbol, 0, self.n))).tolist()

    def _back(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """Positions of the sequence for (rising) positions below the last plane."""
        for k in reversed(range(len(self.planes))):
            bit = symbol >> (len(self.planes) - 1 - k) & 1
            at = self._select_bits(k, at - self.zeros[k] if bit else at, bit)
        return at

    def _select_bits(self, k: int, js: np.ndarray, bit: int) -> np.ndarray:
        """Positions of the js-th bits of one kind in plane k; js rise."""
        before = lambda block: self._ones(k, block) if bit else min(8 * BLOCK_BYTES * block, self.n) - self._ones(k, block)
        out, done = [], 0
        while done < len(js):
            block = bisect_right(range(self.blocks), int(js[done]), key=before) - 1
            first = before(block)
            bits = np.unpackbits(self._block(k, block), bitorder="little")[: self.n - 8 * BLOCK_BYTES * block]
            places = np.flatnonzero(bits == bit)
            upto = done + int(np.searchsorted(js[done:], first + len(places), "left"))
            out.append(8 * BLOCK_BYTES * block + places[js[done:upto] - first])
            done = upto
        return np.concatenate(out) if out else js

    def decode(self) -> np.ndarray:
        """All ids in order, from the last plane to the first."""
        out = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k in reversed(range(len(self.planes))):
            packed = [self._block(k, block) for block in range(self.blocks)]
            b = np.unpackbits(np.concatenate(packed) if packed else np.zeros(0, np.uint8), count=self.n, bitorder="little").astype(bool)
            up, zeros = np.empty_like(out), self.zeros[k]
            up[np.flatnonzero(~b)], up[np.flatnonzero(b)] = out[:zeros], out[zeros:]
            out = up | (b.astype(out.dtype) << out.dtype.type(len(self.planes) - 1 - k))
        return out


def pack_shard(doc_ids: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    body = WaveletMatrix.build(ids).to_bytes()
    known = np.array(doc_ids.is_valid().to_numpy(zero_copy_only=False), bool)
    tail = zstandard.ZstdCompressor(level=1).compress(doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes() + np.asarray(lengths).astype("<u8").tobytes() + known.tobytes())
    return struct.pack("<QQ", len(body), len(lengths)) + body + tail


def unpack_shard(data) -> tuple[pa.Array, np.ndarray, WaveletMatrix]:
    view = memoryview(data)
    size, n = struct.unpack_from("<QQ", view)
    tail = zstandard.ZstdDecompressor().decompress(view[16 + size :])
    ids, lengths, known = np.frombuffer(tail, "<i8", n), np.frombuffer(tail, "<u8", n, 8 * n), np.frombuffer(tail, bool, n, 16 * n)
    return pa.array(ids, pa.int64(), mask=~known), lengths.astype(np.int64), WaveletMatrix.from_bytes(view[16 : 16 + size])


#: Python's white space has four control characters that the vocabulary's patterns take for signs.
_MARK = r"(?:[^\w\s]|[_\x1c-\x1f])"
_BESIDE = re.compile(f"{_MARK}[.,]|[.,]{_MARK}")

# Kinds of bytes in lower case. Letters of Latin-1 are 0xC3 and a byte that is not one of two signs, which takes its kind from it.
_SPACE, _LETTER, _DIGIT, _SIGN, _QUOTE, _OTHER = range(6)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[[ord(c) for c in string.punctuation]] = _SIGN
_KIND[ord("'")] = _QUOTE
_KIND[[ord(c) for c in string.digits]] = _DIGIT
_KIND[[*map(ord, string.ascii_lowercase), 0xC3]] = _LETTER
#: Whether the pre-tokenizer always parts two neighbours; a quote may begin a contraction, other kinds are left to the library.
_PARTED = np.zeros((6, 6), bool)
_PARTED[_SPACE] = True
for _a, _b in ((_LETTER, _DIGIT), (_LETTER, _SIGN), (_LETTER, _QUOTE), (_SIGN, _LETTER), (_SIGN, _DIGIT), (_QUOTE, _DIGIT), (_DIGIT, _LETTER), (_DIGIT, _DIGIT), (_DIGIT, _SIGN), (_DIGIT, _QUOTE)):
    _PARTED[_a, _b] = True
_PARTED = _PARTED.ravel()
_STOP = np.zeros(256, bool)
_STOP[[ord("."), ord(",")]] = True
_LOWER = bytes(range(256)).lower()
_LATIN_WORD = re.compile("[a-zß-öø-ÿ]+")


def _rows(off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts hold one of some places."""
    out = np.zeros(len(off) - 1, bool)
    out[np.searchsorted(off, at, "right") - 1] = True
    return out


def _special(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts that may hold a special token."""
    return _rows(off, np.array([m.start() for m in re.finditer(rb"<\|", raw.tobytes())], np.int64))


def _foreign(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts with characters beyond Latin-1 and the dashes, quotes and spaces of U+2000 to U+203F."""
    at = np.flatnonzero(raw >= 0xC4)
    return _rows(off, at[(raw[at] != 0xE2) | (raw[at + 1] != 0x80)] if len(at) else at)


def pieces(raw: np.ndarray, off: np.ndarray, special: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all pieces, where each begins and the last ends, pieces in each text): parts of texts that encode alone as they do in the text.

    Letters of Latin-1 are put into lower case, unless a mark could follow, and texts are cut at white space and wherever the pre-tokenizer
    always parts two characters of Latin-1; special texts are cut at white space only. A stretch without white space of more than
    LONGEST_KEPT bytes is cut at full stops and commas only, so that junk makes no cache entries.
    """
    own = np.repeat(special, np.diff(off)) if special.any() else None
    low = np.frombuffer(bytearray(raw.tobytes().translate(_LOWER)), np.uint8)
    wide = np.flatnonzero(raw == 0xC3)
    after = raw[wide + 1]
    low[wide[(after <= 0x9E) & (after != 0x97)] + 1] += 0x20
    marked = np.flatnonzero(raw[1:] >= 0xC4)
    low[marked] = raw[marked]
    if own is not None:
        low = np.where(own, raw, low)
    kind = _KIND[low]
    signs = (after == 0x97) | (after == 0xB7)
    kind[wide + 1] = _LETTER
    kind[wide[signs]] = kind[wide[signs] + 1] = _OTHER
    if own is not None:
        kind[own & (kind != _SPACE)] = _OTHER
    kept = kind != _SPACE
    first = np.ones(len(low), bool)
    first[1:] = _PARTED[6 * kind[:-1] + kind[1:]]
    first[off[:-1][np.diff(off) > 0]] = True
    first &= kept
    begins = np.flatnonzero(first)
    # stretches without white space
    whole = kept.copy()
    whole[1:] &= ~kept[:-1]
    whole[off[:-1][np.diff(off) > 0]] = True
    whole = np.flatnonzero(whole & kept)
    place = np.cumsum(kept, dtype=np.int64) - kept
    sizes = np.diff(np.append(place[whole], place[-1] + kept[-1])) if len(low) else whole
    if (sizes > LONGEST_KEPT).any():
        of = np.searchsorted(whole, begins, "right") - 1
        inside = (sizes > LONGEST_KEPT)[of] & (begins != whole[of])
        begins = begins[~inside | _STOP[low[begins]] | _STOP[low[begins - 1]]]
    ends = np.append(place[begins], place[-1] + kept[-1]) if len(low) else np.zeros(1, np.int64)
    return low[kept], ends, np.diff(np.searchsorted(begins, off))


class Encoder:
    """The library's encoding of whole texts, by cached pieces that its pre-tokenizer parts."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(tokenizer_file)
        #: The same model for words that normalizing leaves as they are.
        self.words = Tokenizer(self.library.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.library.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.cache = ChunkCache(self._learn)

    def _learn(self, new: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Encode chunks: plain words many in one call, as each ends with the one token that closes a word."""
        latin = [c for c in new if _LATIN_WORD.fullmatch(c)]
        rest = [c for c in new if not _LATIN_WORD.fullmatch(c)]
        words, others = [c for c in rest if c.isalpha()], [c for c in rest if not c.isalpha()]
        sizes, parts = [], []
        for kind, by in ((latin, self.words), (words, self.library), (others, None)):
            step = WORDS_AT_ONCE if by is self.words else CHUNKS_AT_ONCE
            for lo in range(0, len(kind), step):
                some = kind[lo : lo + step]
                flat, ends = np.zeros(0, np.uint32), np.zeros(0, np.int64)
                if by is not None:
                    flat = np.array(by.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
                    ends = np.flatnonzero(self.closes[flat]) + 1
                if len(ends) != len(some) or ends[-1] != len(flat):
                    lists = [e.ids for e in self.library.encode_batch_fast(some, add_special_tokens=False)]
                    ends = np.cumsum([len(x) for x in lists])
                    flat = np.fromiter((i for x in lists for i in x), np.uint32)
                sizes.append(np.diff(ends, prepend=0))
                parts.append(flat)
        return latin + words + others, np.concatenate(parts), np.concatenate(sizes)

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Chunks that encode alone as they do in the text."""
        if "<|" not in text:
            if text.isascii():
                text = text.lower()
            # a letter that becomes letter and mark could join the mark to a full stop
            steady = text.isascii() or ("İ" not in text and unicodedata.is_normalized("NFC", text))
            if steady and not _BESIDE.search(text):
                text = text.replace(".", " . ").replace(",", " , ")
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str | None], end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by end_id; lengths)."""
        return self.encode_utf8(*utf8_column(pa.array(texts, pa.string())), end_id)

    def encode_utf8(self, raw: np.ndarray, off: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts that lie end to end in a buffer."""
        special = _special(raw, off)
        foreign = _foreign(raw, off) & ~special
        if foreign.any():
            texts = [" ".join(self.chunks(raw[lo:hi].tobytes().decode())).encode() if other else raw[lo:hi].tobytes() for other, lo, hi in zip(foreign.tolist(), off[:-1].tolist(), off[1:].tolist())]
            raw, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        data, ends, counts = pieces(raw, off, special)
        column = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(data)).dictionary_encode()
        flat, sizes = self.cache.encode(column.dictionary.to_numpy(zero_copy_only=False).tolist(), column.indices.to_numpy())
        total = np.concatenate([[0], np.cumsum(sizes)])
        lengths = np.diff(total[np.cumsum(counts)], prepend=0)
        out = np.empty(total[-1] + len(counts), np.uint32)
        last = np.cumsum(lengths + 1) - 1
        plain = np.ones(len(out), bool)
        plain[last] = False
        out[last] = end_id
        out[plain] = flat
        return out, lengths + 1


_encoders: dict[str, Encoder] = {}


def encoder(tokenizer_file: str) -> Encoder:
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = Encoder(tokenizer_file)
    return _encoders[tokenizer_file]


def write_shards(docs: DataFrame, tokenizer_file: str, path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode docs in ascending doc_id order and write one wavelet matrix file per shard under path."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = min(max(8, own.count() // ROWS_PER_RANGE), MAX_RANGES)
    order = ("doc_id", F.xxhash64("text"), "text")
    ordered = own.repartitionByRange(ranges, *order[:2]).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def run(batches):
        encode, held, count, seq, part = encoder(tokenizer_file).encode_utf8, [], 0, 0, 0

        def shard():
            ids, lengths = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            data = pack_shard(pa.concat_arrays([h[0] for h in held]), lengths, ids)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": pa.array([len(lengths)], pa.int64()), "n_tokens": pa.array([len(ids)], pa.int64()), "payload": pa.array([data], pa.binary())})

        for batch in batches:
            part = batch.column(2)[0].as_py() if batch.num_rows else part
            for lo, hi, raw, off in text_chunks(batch, limit=TEXT_BYTES):
                ids, lengths = encode(raw, off, end_id)
                held.append((batch.column(0).slice(lo, hi - lo), ids, lengths))
                count += len(ids)
                if count >= shard_tokens:
                    yield shard()
                    held, count, seq = [], 0, seq + 1
        if held:
            yield shard()

    shards = ordered.mapInArrow(run, "part int, seq int, n_docs long, n_tokens long, payload binary")
    shards.write.option("maxRecordsPerFile", 1).option("compression", "none").parquet(path)


def shard_starts(sizes: DataFrame) -> DataFrame:
    """(part, seq, first: ids before the shard) of shards (part, seq, n_tokens), by sums of sums.

    Shards are summed inside blocks of PARTS_PER_BLOCK parts, and blocks inside blocks of blocks, so that the one window
    over all rows has a row for PARTS_PER_BLOCK ** 2 parts.
    """
    block = F.floor(F.col("part") / PARTS_PER_BLOCK)
    sizes = sizes.select("part", "seq", "n_tokens", block.alias("block"), F.floor(block / PARTS_PER_BLOCK).alias("top"))
    blocks = sizes.groupBy("top", "block").agg(F.sum("n_tokens").alias("n"))
    tops = blocks.groupBy("top").agg(F.sum("n").alias("n"))
    before = lambda n, *by, keys=(): F.coalesce(F.sum(n).over((Window.partitionBy(*keys) if keys else Window).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = tops.select("top", before("n", "top").alias("top_first"))
    blocks = blocks.select("top", "block", before("n", "block", keys=("top",)).alias("block_first")).join(tops, "top").select("block", (F.col("top_first") + F.col("block_first")).alias("block_first"))
    own = sizes.select("part", "seq", "block", before("n_tokens", "part", "seq", keys=("block",)).alias("own"))
    return own.join(blocks, "block").select("part", "seq", (F.col("own") + F.col("block_first")).alias("first"))


def read_shards(spark, path: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32.

    Payloads stay where they are read; only the short rows of documents meet the starts of their shards.
    """
    shards = spark.read.schema("part int, seq int, n_docs long, n_tokens long, payload binary").parquet(path)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, lengths, matrix = unpack_shard(batch.column(2)[k].as_buffer())
                ids, ends = matrix.decode().astype("<u4"), np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), lengths.tolist())]
                place = [pa.array(np.full(len(lengths), batch.column(c)[k].as_py(), np.int32)) for c in range(2)]
                yield pa.RecordBatch.from_arrays([*place, doc_ids, pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = shards.select("part", "seq", "payload").mapInArrow(run, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    starts = shard_starts(shards.select("part", "seq", "n_tokens"))
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_digest(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID) -> DataFrame:
    """Write docs as shards into the shared folder and read the digest of every document back from them."""
    import uuid

    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_shards(docs, tokenizer_file, path, end_id)
    return read_shards(docs.sparkSession, path)
