"""Token files: pieces that texts are cut into, and the cache of their ids."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from jobloom.llm import tokenfile
from jobloom.llm.chunks import ChunkCache
from jobloom.llm.common import tokenizer_path, utf8_column

FILE = tokenizer_path("word_bpe_49k.json")


def assert_library(encoder: tokenfile.Encoder, texts: list[str | None]) -> None:
    ids, lengths = encoder.encode(texts)
    want = encoder.library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
    ends = np.cumsum(lengths)
    for t, w, lo, hi in zip(texts, want, (ends - lengths).tolist(), ends.tolist()):
        assert ids[lo : hi - 1].tolist() == w.ids and ids[hi - 1] == tokenfile.END_ID, repr(t)


def pieces_of(text: str) -> list[str]:
    raw, off = utf8_column(pa.array([text]))
    data, ends, counts = tokenfile.pieces(raw, off, np.array([False]))
    assert counts.tolist() == [len(ends) - 1]
    return [data[a:b].tobytes().decode() for a, b in zip(ends[:-1], ends[1:])]


def test_pieces_are_cut_where_the_pre_tokenizer_always_does():
    assert pieces_of("Word.!! wórd&&& ÉTÉ,x2b 31\tWe'll\n'tis a'5") == ["word", ".!!", "wórd", "&&&", "été", ",", "x", "2", "b", "3", "1", "we", "'ll", "'tis", "a", "'", "5"]
    assert pieces_of("a×b a² \x1c. _x ÷") == ["a×b", "a²", "\x1c.", "_", "x", "÷"] and pieces_of("") == pieces_of(" \n") == []
    assert pieces_of("It’s “SO”, x–Y. AB̌c a,b’ слово.x") == ["it’s", "“sO”,", "x–y", ".", "aB̌c", "a", ",", "b’", "слово.", "x"]
    long = "ab1-" * 20 + "c"
    assert pieces_of(f"{long} {long}.{long},x y1") == [long, long, ".", long, ",", "x", "y", "1"]


def test_pieces_encode_as_the_library_does():
    encoder, rnd = tokenfile.Encoder(FILE), random.Random(7)
    latin = [*"aabcdestlrvem''''.,,.!?&_-0123459 \n\t\r\x0b\x0c\x1c\x1f\x00\x7fABSTZéÉßØø×÷ªºµ²¼¡¿\xa0\x85ÿÞð"]
    wide = [*latin, *"İΣςσаБ–’“…中文한글́̈̌ 　ǰJ①٣ⅷ𝔸😀ﬁ", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "'re", "'LL"]
    texts = ["it is\x1c. so", "x\x1f, y", "ends with <", "| begins", None, "", " ", "J̌. H̱,"]
    for signs in (latin, wide, [*"abcÉé.,'!-3"]):
        texts += ["".join(rnd.choice(signs if rnd.random() < 0.4 else latin) for _ in range(rnd.randrange(rnd.choice([4, 30, 300])))) for _ in range(1500)]
        texts += [" ".join("".join(rnd.choice(signs) for _ in range(rnd.randrange(1, 90))) for _ in range(rnd.randrange(9))) for _ in range(300)]
    rnd.shuffle(texts)
    assert_library(encoder, texts)
    for lo in range(0, 600, 7):
        assert_library(encoder, texts[lo : lo + 7])


def test_words_beside_signs_are_learnt_once():
    encoder, rnd = tokenfile.Encoder(FILE), random.Random(8)
    words = ["".join(rnd.choice("aeioubcdfgé") for _ in range(9)) for _ in range(300)]
    learnt, learn = [], encoder.cache.learn
    encoder.cache.learn = lambda new: learnt.extend(new) or learn(new)
    assert_library(encoder, [" ".join(f"{w}{rnd.choice(['!!', '&&&', '.', ',***', '', '7'])}" for w in rnd.sample(words, 200)) for _ in range(40)] + [" ".join(w.title() for w in words)])
    assert len(learnt) == len(set(learnt)) <= len(words) + 12


def test_a_full_cache_keeps_what_is_asked_for_again():
    learnt: list[str] = []

    def learn(new):
        learnt.extend(new)
        return new, np.fromiter((int(c) for c in new), np.uint32), np.ones(len(new), np.int64)

    cache = ChunkCache(learn, 200_000)
    often = [str(k) for k in range(200)]
    for round_ in range(60):
        some = often + [str(1000 + 100 * round_ + k) for k in range(100)]
        ids, sizes = cache.encode(some)
        assert ids.tolist() == [int(c) for c in some] and sizes.tolist() == [1] * len(some) and cache.bytes < 300_000
    assert len(learnt) == 200 + 60 * 100 and len(cache.index) < 2000
    # nothing asked for twice: all goes
    for round_ in range(60):
        cache.encode([str(100_000 + 100 * round_ + k) for k in range(100)])
        assert cache.bytes < 300_000
    ids, _ = cache.encode(["5", "7"], np.array([1, 0, 1, 1]))
    assert ids.tolist() == [7, 5, 7, 7]
