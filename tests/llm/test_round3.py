"""Whitening, periodic runs and packing against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.llm import packing, periodic, queries, whitening
from jobloom.llm.chunks import ChunkCache
from jobloom.llm.common import tokenizer_path
from tests.conftest import SF
from tests.llm.test_llm import documents, empty_docs, odd_docs

# embedding whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 7) for i, v in rows], "vec_id long, embedding array<float>, component string, n int")


def whitened(spark, rows, k=32):
    return whitening.whiten(vectors(spark, rows), k).collect()


def plain_whitening(rows, k):
    x = np.floor(64 * np.array([[float(c) for c in np.float32(v)] for _, v in rows])) + 1_000_000
    values, vectors_ = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    values, vectors_ = values[::-1][:k], vectors_[:, ::-1][:, :k]
    return (x - x.mean(0)) @ vectors_ / np.sqrt(values), values


def same_up_to_sign(got, want, tolerance=1e-8):
    for g, w in zip(got.T, want.T):
        assert min(np.abs(g - w).max(), np.abs(g + w).max()) < tolerance


def test_whitening_query_equals_dense_eigenvectors(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall()
    got = sorted(queries.op11_embedding_whitening(spark, SF).collect(), key=lambda r: (r.vec_id, r.component))
    assert len(got) == 32 * len(rows)
    want, values = plain_whitening(rows, 32)
    same_up_to_sign(np.array([r.whitened for r in got]).reshape(-1, 32), want)
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    exact = [sum((len(x) * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    assert [r.deviation for r in got[::32]] == exact and {r.n for r in got} == {len(rows)}
    total = float(np.var(np.array(x, float), axis=0).sum())
    assert np.allclose([r.explained for r in got[:32]], values / total, rtol=1e-9)
    assert got[0].identity_error < 1e-10 and len({r.identity_error for r in got}) == 1


@pytest.mark.parametrize("spectrum", ["steep", "flat", "twins"])
def test_components_are_certified_for_hard_spectra(spark, spectrum):
    rng = np.random.default_rng(3)
    scale = {"steep": 2.0 ** -np.arange(20), "flat": np.ones(20), "twins": np.repeat([8.0, 4.0, 2.0, 1.0], 5)}[spectrum]
    x = rng.standard_normal((700, 20)) * scale * 50
    if spectrum == "twins":  # pairs of exactly equal eigenvalues
        x = np.concatenate([x, x @ np.kron(np.eye(10), [[0, 1], [-1, 0]])])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = sorted(whitened(spark, rows, 6), key=lambda r: (r.vec_id, r.component))
    w = np.array([r.whitened for r in got]).reshape(-1, 6)
    assert np.abs(np.cov(w.T, bias=True) - np.eye(6)).max() < 1e-9 and got[0].identity_error < 1e-9
    if spectrum != "twins":
        same_up_to_sign(w, plain_whitening(rows, 6)[0], 1e-6)


def test_chebyshev_passes_damp_the_rest(spark, monkeypatch):
    monkeypatch.setattr(whitening, "GUARD", 2)
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((900, 40)) * np.linspace(3, 1, 40) * 20)]
    blocks = whitening.packed(vectors(spark, rows))
    n, sums = whitening.column_sums(blocks)
    values, q, took = whitening.leading_components(blocks, whitening.Centred(n, sums), 40, 4)
    x = np.floor(64 * np.array([np.float32(v) for _, v in rows], float))
    want, vecs = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(values, want[::-1][:4], rtol=1e-12) and np.abs(np.abs(q) - np.abs(vecs[:, ::-1][:, :4])).max() < 1e-9
    assert took["width"] < 40 and took["passes"] > 5


def test_whitening_edge_cases(spark):
    assert whitened(spark, []) == []
    assert whitened(spark, [(1, None), (2, [1.0, None]), (3, [1.0, math.nan]), (4, [math.inf, 0.0]), (5, [])]) == []
    assert whitened(spark, [(i, [1.0, 2.0]) for i in range(4)]) == []  # equal vectors have no component
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 3.0]), (2, [5.0, 4.0]), (3, [1.0, 2.0, 3.0]), (4, [3e30, 0.0]), (5, None)]
    got = whitened(spark, rows)
    assert sorted((r.vec_id is None, r.vec_id, r.component) for r in got) == [(False, 1, 1), (False, 1, 1), (False, 1, 2), (False, 1, 2), (False, 2, 1), (False, 2, 2), (True, None, 1), (True, None, 2)]
    assert {r.n for r in got} == {4} and got[0].identity_error < 1e-9
    line = whitened(spark, [(i, [float(i), float(i)]) for i in range(5)])  # rank one
    assert {r.component for r in line} == {1}
    far = whitened(spark, [(i, [float(i) * 1e9, 0.5]) for i in range(3)])
    assert [r.deviation for r in sorted(far, key=lambda r: r.vec_id)] == [None, 0, None] or all(r.deviation is None or r.deviation >= 0 for r in far)


def test_deviation_beyond_a_long_is_null():
    x = np.array([[1 << 45, 5], [-(1 << 45), 5], [0, 5]])
    assert whitening.deviations(x, 3, [0, 15]).to_pylist() == [None, None, 0]
    assert whitening.deviations(np.array([[3, 5], [4, 9]]), 2, [7, 14]).to_pylist() == [17, 17]


# periodic runs


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, planted=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_query_equals_brute_force(spark):
    got = sorted(tuple(r) for r in queries.op12_periodic_runs(spark, SF).collect())
    assert got == sorted(brute_row(i, t) for i, t, _ in documents())
    assert sum(r[1] > 0 for r in got) > 5


def test_find_runs_on_built_texts():
    rnd = random.Random(4)
    for _ in range(150):
        size, w = rnd.choice([1, 2, 3, 50]), []
        for _ in range(rnd.randint(1, 5)):
            p = rnd.choice([1, 2, 5, 16, 17, 31, 32, 33, 64, 65, 100])
            u = [rnd.randrange(size) for _ in range(p)]
            if rnd.random() < 0.4:  # a period that holds shorter runs
                u = ([rnd.randrange(size) for _ in range(rnd.choice([1, 2, 3, 5]))] * p)[: p - 1] + [size]
            w += (u * 8)[: rnd.randint(p, 6 * p)]
        got = [(s, e - s, q) for s, e, q in periodic.find_runs(np.array(w), len(w))]
        assert got == brute_runs(w)


def test_equal_positions_of_a_scale_stay_few():
    """A text of one word, and periods of a million-fold letter, leave no pairs to look at beyond the short lags."""
    pairs = []
    keep, periodic._equal_pairs = periodic._equal_pairs, lambda *a: (out := keep(*a), pairs.append(len(out[0])))[0]
    try:
        n = 60_000
        assert periodic.find_runs(np.zeros(n, np.int64), n) == [(0, n, 1)]
        long = np.tile(np.r_[np.zeros(2999, np.int64), 1], 20)
        assert (0, n, 3000) in periodic.find_runs(long, n)
    finally:
        periodic._equal_pairs = keep
    assert sum(pairs) < n


def test_periodic_edge_cases(spark):
    want = sorted((brute_row(r.doc_id, r.text) for r in odd_docs(spark).collect()), key=str)
    got = periodic.digest(periodic.periodic_runs(periodic.plant(odd_docs(spark)))).collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    assert periodic.digest(periodic.periodic_runs(empty_docs(spark))).collect() == []
    spans = periodic.periodic_runs(spark.createDataFrame([(1, "x " + "ab cd " * 5 + "ab y")], "doc_id long, text string")).collect()[0]
    assert [tuple(r) for r in spans.runs] == [(1, 11, 2)] and spans.collapsed == "x ab cd y"


# best-fit packing

FILE = tokenizer_path("byte_bpe_50k.json")
STRANGE = ["a  b", " a", "a ", "\n\n\na", "a\n b", "a \n", "don't we'll I'M", "x1y2 3.14", "\x1c\x1d a", "  b", "<|endoftext|> x", "é ²½ Ⅷ", "日本 語", "\r\n\r\n x", "a.b,c", "##&& %", "_a_b", "'s", "a'", "\t\ta\t"]


def library_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(FILE).encode_batch(texts, add_special_tokens=False)]


def test_chunks_encode_as_whole_texts_do():
    rnd = random.Random(6)
    texts = STRANGE + ["".join(rnd.choice(STRANGE + [" ", "word", "\n", ".", ",", "É"]) for _ in range(rnd.randint(1, 12))) for _ in range(2000)]
    encoder = packing.ByteEncoder(FILE)
    for lo in range(0, len(texts), 100):
        for got, want in zip(encoder.encode(texts[lo : lo + 100]), library_ids(texts[lo : lo + 100])):
            assert got[:-1].tolist() == want and got[-1] == 0


def test_cache_is_bounded_by_bytes():
    calls = []

    def learn(chunks):
        calls.append(chunks)
        return chunks, np.concatenate([np.arange(len(c), dtype=np.uint32) for c in chunks]), np.array([len(c) for c in chunks])

    cache = ChunkCache(learn, 50_000)
    for k in range(400):
        got, sizes = cache.encode([f"word{k}", "and", "y" * (5000 + k), "and"])
        assert sizes.tolist() == [len(f"word{k}"), 3, 5000 + k, 3] and got[sizes[0] : sizes[0] + 3].tolist() == [0, 1, 2]
        assert cache.bytes < 51_000 and all(len(c) <= 64 for c in cache.index)


def check_packing(rows, docs, capacity):
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(docs)
    for doc_id, ids in docs.items():
        own = sorted(pieces[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and len(own) == max(1, -(-len(ids) // capacity))
        assert sum(r.length for r in own) == len(ids) and all(r.length == capacity for r in own[1:])
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def best_fit(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        room = [(f, k) for k, f in enumerate(free) if f >= n]
        if room:
            free[min(room)[1]] -= n
        else:
            free.append(capacity - n)
    return len(free)


def test_packing_query(spark):
    rows = queries.op13_best_fit_packing(spark, SF).collect()
    texts = documents()
    docs = {i: ids + [0] for (i, _, _), ids in zip(texts, library_ids([t or "" for _, t, _ in texts]))}
    made = check_packing(rows, docs, 2048)
    assert made <= best_fit([r.length for r in rows], 2048)
    assert made <= math.ceil(sum(map(len, docs.values())) / 2048) + 2


def test_plan_serves_every_piece_once():
    rng = np.random.default_rng(8)
    for capacity, shape in ((64, "flat"), (64, "hot"), (64, "long"), (2048, "flat"), (5, "flat")):
        h = np.zeros(capacity + 1, np.int64)
        h[1:] = {"flat": rng.integers(0, 40, capacity), "hot": np.where(np.arange(1, capacity + 1) == capacity * 3 // 5, 5000, 3), "long": np.where(np.arange(1, capacity + 1) > capacity * 3 // 4, 20, 0)}[shape]
        plan, made = packing.plan_sequences(h, capacity)
        filled = np.zeros(made, np.int64)
        for length in range(1, capacity + 1):
            own = plan[plan[:, 0] == length]
            assert own[:, 2].sum() == h[length] and (own[:, 1] == np.cumsum(own[:, 2]) - own[:, 2]).all()
        for length, _, n, first, offset in sorted(plan.tolist(), key=lambda r: r[4]):
            assert (filled[first : first + n] == offset).all()
            filled[first : first + n] += length
        assert (filled > 0).all() and (filled <= capacity).all() and filled.sum() == (h * np.arange(capacity + 1)).sum()
        plain = best_fit(np.repeat(np.arange(capacity + 1), h).tolist(), capacity) if h.sum() < 8000 else made
        assert made <= plain


def test_plan_does_not_grow_with_the_documents():
    h = np.random.default_rng(9).integers(1, 50, 257)
    h[0] = 0
    small, made = packing.plan_sequences(h, 256)
    large, many = packing.plan_sequences(h * 10_000_000, 256)
    assert len(large) < 20 * len(small) and many <= made * 10_000_000


def test_packing_edge_cases(spark):
    assert packing.pack_digest(empty_docs(spark), FILE).collect() == []
    docs = odd_docs(spark).where("doc_id is not null").withColumn("doc_id", F.monotonically_increasing_id())
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = dict(zip(texts, library_ids([t or "" for t in texts.values()])))
    rows = packing.pack_digest(docs, FILE).collect()
    check_packing(rows, {i: x + [0] for i, x in ids.items()}, 2048)
    assert len(packing.pack_digest(odd_docs(spark), FILE).where("doc_id is null").collect()) == 1
    two = spark.createDataFrame([(7, "same"), (7, "same")], "doc_id long, text string")
    assert [(r.doc_id, r.sequence_id) for r in packing.pack_digest(two, FILE).collect()] == [(7, 0), (7, 0)]


def test_sequences_hold_the_ids_of_their_pieces(spark):
    docs = spark.createDataFrame([(i, f"word {i} " * (i % 40)) for i in range(120)], "doc_id long, text string")
    placed = packing.place_pieces(packing.encoded_pieces(docs, FILE, 64), 64)
    made = packing.sequences(placed).collect()
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in made}
    assert all(len(whole[r.sequence_id]) == r.n_tokens <= 64 and r.offsets[0] == 0 for r in made)
    for r in placed.collect():
        assert whole[r.sequence_id][r.offset : r.offset + r.length].tobytes() == bytes(r.ids)


# chat formatting of long conversations


@pytest.mark.parametrize("shape", ["numbered", "null", "equal"])
def test_long_conversations_take_linear_time(spark, shape):
    import time

    from jobloom.llm import chat

    turn = {"numbered": F.col("id"), "null": F.lit(None).cast("long"), "equal": F.lit(7).cast("long")}[shape]
    n = 200_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), turn.alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t<|"), F.col("id").cast("string")).alias("text"))
    began = time.time()
    (got,) = chat.digest(chat.format_turns(chat.canonical_rows(rows))).collect()
    assert time.time() - began < 60
    texts = [f"t<|{i}" for i in range(n)]
    order = list(range(n)) if shape == "numbered" else sorted(range(n), key=lambda i: (i % 2 == 0, texts[i]))
    turns = "".join(f"{'user' if i % 2 == 0 else 'assistant'}\n{texts[i]}\n" for i in order)
    loss = "".join(texts[i] for i in order if i % 2)
    assert got.n_turns == n and got.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert got.loss_chars == len(loss) and got.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_a_mask_that_is_not_the_assistant_texts_is_cut_out(spark):
    from jobloom.llm import chat

    df = spark.createDataFrame([(1, 0, "user", "one"), (1, 1, "assistant", "two<|x")], "conv_id long, turn long, role string, text string")
    formatted = chat.format_turns(df)
    moved = formatted.withColumn("loss_spans", F.transform("loss_spans", lambda s: F.struct((s["start"] + 1).alias("start"), (s["length"] - 1).alias("length"))))
    assert chat.read_back(moved).first().loss_text == "wo<|x" and chat.read_back(formatted).first().loss_text == "two<|x"
    none = formatted.withColumn("loss_spans", F.filter("loss_spans", lambda s: F.lit(False)))
    assert chat.read_back(none).first().loss_text == ""


def test_typed_layouts_reach_the_same_turns(spark):
    from jobloom.llm import chat

    t = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, None, None), (None, None, "assistant", "yo")], "conv_id long, turn long, role string, text string")
    nested = t.select("conv_id", F.col("turn").alias("index"), F.struct("role", F.col("text").alias("content")).alias("message"))
    spoken = t.select("conv_id", F.col("turn").alias("position"), F.col("role").alias("speaker"), F.col("text").alias("utterance"))
    event = t.select("conv_id", F.struct(F.col("turn").alias("n"), F.col("role").alias("from"), F.struct(F.col("text").alias("value")).alias("body")).alias("event"))
    want = sorted(map(str, chat.canonical_rows(t).collect()))
    for table in (nested, spoken, event):
        assert sorted(map(str, chat.canonical_rows(table).collect())) == want
    records = nested.where("conv_id = 1").select("conv_id", F.to_variant_object(F.struct("conv_id", "index", "message")).alias("record"))
    assert chat.canonical_turns(records).count() == 2 and chat.unmapped(records).count() == 0
    assert chat.canonical_tables([t, nested, spoken, event]).count() == 12


# article text stays whole


def site(n, body):
    return [(k, f"https://site.example/{k}", f"<html><body>{body(k)}</body></html>", "clash", 1) for k in range(n)]


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")


def extracted(spark, rows):
    from jobloom.llm import htmltemplate

    return {r.page_id: r.text for r in htmltemplate.extract_pages(pages_of(spark, rows)).collect()}


SHARED = ["The council met again to speak of the river and its banks.", "Nobody had expected so many people to come to the hall.", "A vote is planned for the first days of autumn."]


def test_editions_of_an_article_keep_their_text(spark):
    def body(k):
        paragraphs = [f"Edition {k}", *SHARED] if k < 9 else [f"Other story {k} of its own.", f"It tells of thing {k * 7} and more."]
        return "<div class='x1'>Home | About</div><article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article><div class='x2'>Copyright</div>"

    got = extracted(spark, site(16, body))
    assert got[0] == "\n".join(["Edition 0", *SHARED]) and got[8] == "\n".join(["Edition 8", *SHARED])
    assert got[12] == "Other story 12 of its own.\nIt tells of thing 84 and more."


def test_a_fixed_paragraph_of_the_article_is_kept(spark):
    got = extracted(spark, site(10, lambda k: f"<article><p>This week in review.</p><p>Story {k} begins here.</p></article>"))
    assert got == {k: f"This week in review.\nStory {k} begins here." for k in range(10)}


@pytest.mark.parametrize("n", [5, 7, 8, 40])
def test_hosts_of_any_size_are_treated_alike(spark, n):
    got = extracted(spark, site(n, lambda k: f"<div class='a1'>Home and News</div><div class='b1'><p>Story {k} is long enough to be the text of its page.</p><p>It has line {k * 3}.</p></div><div class='c1'>Copyright Example</div>"))
    assert got == {k: f"Story {k} is long enough to be the text of its page.\nIt has line {k * 3}." for k in range(n)}


def test_editions_without_a_main_element_are_kept(spark):
    got = extracted(spark, site(6, lambda k: f"<div><p>Edition {k}</p>" + "".join(f"<p>{p}</p>" for p in SHARED) + "</div>"))
    assert got == {k: "\n".join([f"Edition {k}", *SHARED]) for k in range(6)}


def test_a_title_beside_the_article_is_kept(spark):
    got = extracted(spark, site(5, lambda k: f"<div class='p'><h1>Title {k}</h1><article><p>Text {k} of the page.</p></article><div class='q'>More of this</div></div>"))
    assert got == {k: f"Title {k}\nText {k} of the page." for k in range(5)}


# token files: the encoder's cache


def test_junk_without_spaces_stays_out_of_the_cache():
    from tokenizers import Tokenizer

    from jobloom.llm import tokenfile

    rnd = random.Random(1)
    file = tokenizer_path("word_bpe_49k.json")
    encoder, library = tokenfile.Encoder(file), Tokenizer.from_file(file)
    texts = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789-") for _ in range(20_000)) for _ in range(12)] + ["plain words stay, and Más", "", None]
    ids, lengths = encoder.encode(texts)
    at = 0
    for t, n in zip(texts, lengths.tolist()):
        assert ids[at : at + n - 1].tolist() == library.encode(t or "", add_special_tokens=False).ids and ids[at + n - 1] == tokenfile.END_ID
        at += n
    assert encoder.cache.bytes < 10_000 and encoder.cache.used < 100


def test_an_access_unpacks_few_blocks():
    from jobloom.llm import tokenfile

    ids = np.random.default_rng(4).integers(0, 49_408, 600_000)
    data = tokenfile.WaveletMatrix.build(ids).to_bytes()
    for use in (lambda m: m[421_337] == ids[421_337], lambda m: m.count(int(ids[5]), 1000, 500_000) == int((ids[1000:500_000] == ids[5]).sum()), lambda m: m.select(int(ids[300_000]), 3) == int(np.flatnonzero(ids == ids[300_000])[3])):
        m = tokenfile.WaveletMatrix.from_bytes(data)
        assert use(m) and m.bytes_read < len(data) / 3
    m = tokenfile.WaveletMatrix.from_bytes(data)
    m[421_337]
    assert m.bytes_read < 16 * (tokenfile.BLOCK_BYTES + 200) < len(data) / 8
    hot = np.where(np.arange(300_000) % 3 == 0, 7, ids[:300_000])
    m = tokenfile.WaveletMatrix.build(hot)
    assert m.occurrences(7) == np.flatnonzero(hot == 7).tolist() and m.occurrences(49_409) == [] and (m.decode() == hot).all()
    for n in (0, 1, 8 * tokenfile.BLOCK_BYTES, 8 * tokenfile.BLOCK_BYTES + 1):
        some = ids[:n] % 5
        m = tokenfile.WaveletMatrix.from_bytes(tokenfile.WaveletMatrix.build(some).to_bytes())
        assert (m.decode() == some).all() and m.count(3) == int((some == 3).sum()) == len(m.occurrences(3)) and m.count(3, n, n) == 0
