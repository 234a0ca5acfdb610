"""Training-data operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from jobloom.llm import chat, decontam, htmltemplate, langid, neardup, piecefst, quality, queries, rules, tokenfile, toxicity
from jobloom.llm import vectext as V
from jobloom.llm.common import read_table, tokenizer_path, without_ids
from jobloom.llm.graph import components
from tests.conftest import SF

LARGER = "/root/testdata/sf0.01"
ODD = [None, "", "   \n", "one", "two words", "É à ß 日本語 🎉", "x" * 50_000, "a b c d e f g h " * 3000, "<|im_end|> <%| tail", "Dup line\nDup line\nDup line\nDup line"]


def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, a null id and extra columns with clashing names."""
    rows = [(i, t, "en", 7, "k", True) for i, t in enumerate(ODD)] + [(3, "one", "en", 7, "k", True), (None, "two words", None, 7, "k", True), (50, "one", "de", 7, "k", True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, a long, key string, kept boolean")


def empty_docs(spark):
    return odd_docs(spark).where("false")


def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def documents(sf=SF):
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()


def compare(spark, name, sf=SF):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, sf), con.sql(queries.ORACLE[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    at = [want.columns.index(c) for c in order]
    assert sorted(tuple(str(r[c]) for c in order) for r in df.collect()) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    compare(spark, name)


# kernels


def test_word_hashes_agree_with_words():
    texts = ["a b  a", "", " x\ty\nx ", "a"]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    w = V.find_words(np.frombuffer(b"".join(raw), np.uint8), off)
    assert np.diff(w.first).tolist() == [len(words(t)) for t in texts]
    assert w.hash[0] == w.hash[2] == w.hash[6] != w.hash[1] and w.hash[3] == w.hash[5]


def test_components_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[100 + k] == 100 for k in range(1, 30))


def test_without_ids(spark):
    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    left = without_ids(df, "doc_id", df.where("doc_id % 3 = 0").select("doc_id"))
    assert sorted(r["doc_id"] for r in left.collect()) == [i for i in range(1000) if i % 3]


# 1 quality


def test_quality_separates_labels_and_keeps_clean(spark):
    docs, marks = read_table(spark, LARGER, "documents"), read_table(spark, LARGER, "labels")
    got = quality.resample(docs, marks).join(marks, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r["quality"]: r["kept"] for r in got}
    assert share[1] > 0.97 and share[0] < 0.1


def test_kth_largest_is_exact(spark):
    values = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 500).tolist() + [5, 5, 5]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 7, 250, 503):
        assert quality.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


def test_weights_equal_a_plain_sum():
    table = np.random.default_rng(1).normal(size=quality.BUCKETS)
    raw = b"Some words, some WORDS!! and words"
    off = np.array([0, len(raw)])
    text, bucket = quality.features(np.frombuffer(raw, np.uint8), off)
    weight, n = quality.weights(table, np.frombuffer(raw, np.uint8), off)
    assert n[0] == len(bucket) == 6 + 5 + 6 + 5 and weight[0] == pytest.approx(sum(table[b] for b in bucket))


PER_ROW = {
    "quality": lambda s, d: quality.resample(d, labels(s)),
    "toxicity": lambda s, d: toxicity.score_toxicity(d, labels(s)),
    "rules": lambda s, d: rules.apply_rules(d),
    "language": lambda s, d: langid.identify(d),
    "near": lambda s, d: neardup.near_duplicates(d),
    "pieces": lambda s, d: piecefst.round_trip(d, tokenizer_path("piece_bpe_32k.model")),
    "tokens": lambda s, d: tokenfile.token_digest(d, tokenizer_path("word_bpe_49k.json")),
}


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_odd_and_empty_documents_get_a_row_each(spark, name):
    docs = odd_docs(spark)
    out = [r.asDict() for r in PER_ROW[name](spark, docs).collect()]
    ids = sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in docs.collect())
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in out) == ids
    assert PER_ROW[name](spark, empty_docs(spark)).count() == 0
    of = {}
    for r in out:
        of.setdefault(r["doc_id"], []).append(r)
    if name == "quality":
        assert all(of[i][0]["weight"] == 0 and of[i][0]["n_grams"] == 0 and not of[i][0]["kept"] for i in (0, 1, 2))
        assert of[3][0] == of[3][1] and of[3][0]["weight"] == of[50][0]["weight"] != 0
    if name == "toxicity":
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] is not None for r in out)
        assert of[0][0]["score"] == of[1][0]["score"] and of[3][0] == of[3][1]
    if name == "rules":
        assert all(r["base_failed"] and not r["kept"] and r["n_words"] == 0 for i in (0, 1, 2) for r in of[i])
        assert of[7][0]["n_words"] == 24_000 == of[7][0]["n_repeat_words"] and of[9][0]["n_dup_lines"] == 3
    if name == "language":
        assert all(of[i][0]["lang_pred"] == "und" and of[i][0]["score"] == 0 for i in (0, 1, 2))
        assert of[None][0]["held_out"] is False and all(0 <= r["score"] <= 1 for r in out)
    if name == "near":
        assert all(of[i][0]["n_shingles"] == 0 and of[i][0]["component_id"] == i and of[i][0]["kept"] for i in (0, 1, 2))
        assert of[3][0]["component_id"] == of[3][1]["component_id"] == of[50][0]["component_id"] == 3 and not of[50][0]["kept"]
        assert of[None][0]["component_id"] is None and of[None][0]["kept"]
    if name == "pieces":
        assert of[0][0]["n_tokens"] == of[1][0]["n_tokens"] == 0 and all(r["decoded_equal"] for r in out)
    if name == "tokens":
        assert of[0][0]["n_tokens"] == of[1][0]["n_tokens"] == 1 and of[None][0]["start"] == 0 and of[3][0]["ids_crc32"] == of[3][1]["ids_crc32"]


def test_filters_keep_all_columns_of_odd_documents(spark):
    docs, none = odd_docs(spark), empty_docs(spark).select(F.col("doc_id").alias("item_id"), "text")
    assert sorted(map(str, decontam.keep_clean(docs, none).collect())) == sorted(map(str, docs.collect()))
    items = docs.where("doc_id in (4, 50)").select(F.col("doc_id").alias("item_id"), "text")
    left = decontam.keep_clean(docs, items)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [0, 1, 2, 5, 6, 7, 8, 9]
    pairs = {(r["doc_id"], r["item_id"], r["similarity"]) for r in decontam.leaks(docs, items).collect()}
    assert pairs == {(3, 50, 1.0), (50, 50, 1.0), (4, 4, 1.0), (None, 4, 1.0)}
    for run in (lambda d: quality.keep_drawn(d, labels(spark)), langid.keep_identified, rules.keep_good):
        kept = run(docs)
        assert kept.schema == docs.schema and {str(r) for r in kept.collect()} <= {str(r) for r in docs.collect()}
        assert not {r["doc_id"] for r in kept.collect()} & {0, 1, 2} and run(empty_docs(spark)).count() == 0


def test_draw_equals_brute_force(spark):
    """Counts, log ratios, whole-text sums, noise, k and the k largest, in plain Python from the same hashed n-grams."""
    docs, marks = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    good = {r["doc_id"]: r["quality"] for r in marks.where("quality is not null").collect()}
    grams = {i: quality.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[1].tolist() for i, t in text.items()}
    raw = Counter(g for gs in grams.values() for g in gs)
    target = Counter(g for i, gs in grams.items() if good.get(i) == 1 for g in gs)
    n_raw, n_target = sum(raw.values()), sum(target.values())
    ratio = {}
    for g in raw:
        p = (raw[g] + 1) / (n_raw + quality.BUCKETS)
        ratio[g] = np.log((target[g] + quality.SMOOTHING * p) / (n_target + quality.SMOOTHING)) - np.log(p)
    weight = {i: sum(ratio[g] for g in gs) for i, gs in grams.items()}
    labelled = sorted((weight[i], q) for i, q in good.items() if grams.get(i))
    best, cut = -1.0, None
    for k in range(len(labelled)):  # reject the k + 1 lowest
        low, high = labelled[: k + 1], labelled[k + 1 :]
        score = sum(q == 0 for _, q in low) / sum(q == 0 for _, q in labelled) + sum(q == 1 for _, q in high) / sum(q == 1 for _, q in labelled)
        if score > best + 1e-12:
            best, cut = score, (labelled[k][0] + labelled[min(k + 1, len(labelled) - 1)][0]) / 2
    real = {i for i, gs in grams.items() if gs}
    k = sum(weight[i] > cut for i in real)
    mask = (1 << 64) - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    noisy = {i: weight[i] - quality.NOISE * np.log(-np.log((mix(mix((i + 77) & mask) ^ int(V._SEEDS[5])) >> 11) / 2**53)) for i in real}
    want = set(sorted(real, key=lambda i: -noisy[i])[:k])
    rows = {r["doc_id"]: r for r in quality.resample(docs, marks).collect()}
    assert all(rows[i]["weight"] == pytest.approx(weight[i], abs=1e-6) for i in weight)
    assert {i for i, r in rows.items() if r["kept"]} == want
    assert {r["doc_id"] for r in quality.keep_drawn(docs, marks).collect()} == want


# 2 toxicity


def test_toxicity_on_held_out_rows(spark):
    docs, marks = read_table(spark, "/root/testdata/sf0.1", "documents"), read_table(spark, "/root/testdata/sf0.1", "labels")
    rows = toxicity.score_toxicity(docs, marks).where("held_out").join(marks, "doc_id").select("score", "predicted", "toxic").collect()
    pos, neg = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.9 and np.mean([r["predicted"] for r in rows if not r["toxic"]]) < 0.02


def test_label_model_finds_accurate_voters():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.1
    votes = np.zeros(4000, np.int64)
    for k in range(toxicity.VOTERS - 2):
        votes |= (np.where(y, rng.random(4000) < 0.6, rng.random(4000) < 0.02)).astype(np.int64) << k
    seen, back, n = np.unique(votes, return_inverse=True, return_counts=True)
    q, rates, _ = toxicity.label_model(seen, n)
    assert ((q[back] > 0.5) == y).mean() > 0.99 and abs(rates[1][0] - 0.6) < 0.1


def simulated_votes(rng, y, voters):
    votes = np.zeros(len(y), np.int64)
    for k in range(voters):
        votes |= np.where(y, rng.random(len(y)) < 0.5, rng.random(len(y)) < 0.05).astype(np.int64) << k
    return votes


def test_label_model_equals_plain_em(monkeypatch):
    """Without correlated voters: the same posteriors as EM written row by row."""
    monkeypatch.setattr(toxicity, "MIN_CORRELATION", 2.0)
    rng = np.random.default_rng(5)
    y = rng.random(600) < 0.2
    votes = simulated_votes(rng, y, 8)
    seen, back, n = np.unique(votes, return_inverse=True, return_counts=True)
    q, rates, _ = toxicity.label_model(seen, n, rounds=20)
    rows = [[v >> k & 1 for k in range(toxicity.VOTERS)] for v in votes.tolist()]
    post = [0.95 if sum(r[: toxicity.LEXICAL]) >= 3 else 0.15 if sum(r[: toxicity.LEXICAL]) else 0.01 for r in rows]
    for _ in range(20):
        prior = min(max(sum(post) / len(post), 0.005), 0.995)
        one = [(sum(p for p, r in zip(post, rows) if r[k]) + 1) / (sum(post) + 2) for k in range(toxicity.VOTERS)]
        zero = [(sum(1 - p for p, r in zip(post, rows) if r[k]) + 1) / (len(post) - sum(post) + 2) for k in range(toxicity.VOTERS)]
        z = [np.log(prior / (1 - prior)) + sum(np.log(one[k] / zero[k]) if r[k] else np.log((1 - one[k]) / (1 - zero[k])) for k in range(toxicity.VOTERS)) for r in rows]
        post = [1 / (1 + np.exp(-min(max(x, -30), 30))) for x in z]
    assert np.allclose(q[back], post) and np.allclose(rates, [zero, one])


def test_copied_voters_count_once():
    rng = np.random.default_rng(7)
    y = rng.random(20_000) < 0.15
    votes = simulated_votes(rng, y, 6)
    copied = votes | (votes & 1) << 6 | (votes & 1) << 7  # voter 0 two times more

    def posterior(v):
        seen, back, n = np.unique(v, return_inverse=True, return_counts=True)
        q, _, discount = toxicity.label_model(seen, n)
        return q[back], discount

    (plain, _), (more, discount) = posterior(votes), posterior(copied)
    assert np.allclose(discount[[0, 6, 7]], 1 / 3, atol=0.02) and np.allclose(discount[1:6], 1, atol=0.02)
    assert np.abs(plain - more).mean() < 0.01


# 3 chat


def test_layouts_become_turns(spark):
    records = [(1, '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}]}'), (2, '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}'), (3, '{"instruction":"do","input":"","output":"done"}'), (4, '{"data":{"prompt":"p","response":"r"}}'), (5, '{"odd":1}'), (6, '{"messages":[]}'), (7, '{"dialog":{"turns":[{"speaker":"human","text":null}]}}')]
    df = spark.createDataFrame(records, "conv_id long, j string").select("conv_id", F.parse_json("j").alias("record"))
    got = {}
    for r in chat.canonical_turns(df).orderBy("conv_id", "turn").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got == {1: [("user", "hi"), ("assistant", "yo")], 2: [("user", "q"), ("assistant", "a")], 3: [("system", "do"), ("assistant", "done")], 4: [("user", "p"), ("assistant", "r")], 7: [("user", "")]}
    assert [r["conv_id"] for r in chat.unmapped(df).collect()] == [5]


def test_chat_round_trip(spark):
    tricky = ["<|im_end|>", "<%|", "<%%|x", "<", "%", "\n", "", "a\n<|im_start|>user\nb", None, "é🎉"]
    rows = [(c, 10 * k, ["user", "assistant", "sys%\n<tem", None][k % 4], t) for c in range(2) for k, t in enumerate(tricky)] + [(0, 10, "assistant", "<|im_end|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.read_back(chat.format_turns(df)).collect():
        want = sorted((k, role or "", t or "") for c, k, role, t in rows if c == r["conv_id"])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(role, t) for _, role, t in want]
        assert r["loss_text"] == "".join(t for _, role, t in want if role == "assistant")
        assert r["formatted"].count("<|im_start|>") == len(want)
    assert chat.digest(chat.format_turns(df.where("false"))).count() == 0


def test_order_of_turns_and_typed_layouts(spark):
    rows = [(1, None, "user", "first"), (1, -200, "user", "a"), (1, 0, "assistant", "b"), (1, 70, "user", "c"), (1, 70, "assistant", "c"), (None, 1, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.read_back(chat.format_turns(chat.canonical_rows(df))).collect()}
    assert got == {1: [("user", "first"), ("user", "a"), ("assistant", "b"), ("assistant", "c"), ("user", "c")], None: [("", "")]}
    odd = df.withColumn("more", F.lit(1))
    with pytest.raises(ValueError):
        chat.canonical_rows(odd)
    by_record = spark.createDataFrame([(1, '{"conv_id":1,"turn":0,"role":"user","text":"hi"}')], "conv_id long, j string").select("conv_id", F.parse_json("j").alias("record"))
    assert [tuple(r) for r in chat.canonical_turns(by_record).collect()] == [(1, 0, "user", "hi")]


def test_extra_columns_and_long_conversations(spark):
    """Columns with clashing names are no part of the layout that is formatted; spans stay right over many blocks."""
    rows = [(7, k, "assistant" if k % 2 else "user", f"text {k} " + "x" * (200_000 if k == 500 else 3), 1, "n") for k in range(1000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block long, formatted string")
    r = chat.read_back(chat.format_turns(df)).first()
    assert len(r["turns"]) == 1000 and r["loss_text"] == "".join(t for _, k, role, t, *_ in rows if role == "assistant")


def test_chat_plan_has_no_python(spark):
    plan = queries.op3_chat_formatting(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# 4 decontamination


def smith_waterman(a, b):
    best, old = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, old[j - 1] + (decontam.MATCH if x == y else decontam.MISMATCH), old[j] + decontam.GAP, new[-1] + decontam.GAP))
        best, old = max(best, *new), new
    return best


def test_alignment_equals_plain_dynamic_programming():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 25)), rng.integers(0, 5, rng.integers(1, 40))
        assert decontam.align(a.astype(np.uint64), b.astype(np.uint64))[0] == smith_waterman(a.tolist(), b.tolist())


def test_leaks_equal_brute_force_and_survive_edits(spark):
    docs, items = read_table(spark, SF, "documents"), read_table(spark, SF, "benchmark")
    tok = lambda t: re.findall(r"[^\W_]+", t.lower())
    want = set()
    bench = [(r["item_id"], tok(r["text"])) for r in items.collect()]
    for i, t, _ in documents():
        seq = tok(t)
        have = Counter(seq)
        for k, item in bench:
            need = decontam.SIMILARITY * decontam.MATCH * len(item)
            if decontam.MATCH * sum(have[w] > 0 for w in item) >= need and smith_waterman(item, seq) >= need:
                want.add((i, k))
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, items).collect()} == want and want
    passage = [w for _, item in bench for w in item][:60]
    edited = [w if i % 9 else "zz" for i, w in enumerate(passage)]
    d = spark.createDataFrame([(1, "intro " + " ".join(edited) + " outro"), (2, "nothing like it here at all")], "doc_id long, text string")
    assert [r["doc_id"] for r in decontam.leaks(d, spark.createDataFrame([(9, " ".join(passage))], "item_id long, text string")).collect()] == [1]


def test_dense_edits_equal_brute_force(spark):
    """Words replaced or inserted every few words, next to whole copies and common words, at all item lengths."""
    rng = np.random.default_rng(8)
    items, docs = [], []
    for k, length in enumerate([1, 2, 3, 5, 6, 8, 12, 16, 40, 90]):
        item = [f"i{k}w{j}" if rng.random() < 0.8 else "the" for j in range(length)]
        items.append((k, " ".join(item)))
        for every in (2, 3, 4, 5, 6):
            docs.append(" ".join(w if j % every != every - 1 else "zz" for j, w in enumerate(item)))
            docs.append(" ".join(w + " zz" * (j % every == every - 1) for j, w in enumerate(item)))
            docs.append(" ".join(w for j, w in enumerate(item) if j % every != every - 1))
        docs += ["intro the the " + " ".join(item) + " outro", " ".join("qq" if rng.random() < 0.2 else w for w in item)]
    rows = list(enumerate(docs))
    want = {(i, k) for i, t in rows for k, item in items if smith_waterman(item.split(), t.split()) >= decontam.SIMILARITY * decontam.MATCH * len(item.split())}
    got = decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want


def test_blocks_of_items_change_no_result(spark, monkeypatch):
    """Many small blocks, with repeated rows of items, null and empty ones, repeated and odd documents."""
    docs, items = read_table(spark, SF, "documents"), read_table(spark, SF, "benchmark")
    items = items.select(F.col("item_id"), "text").unionByName(items.select("item_id", "text").limit(5))
    items = items.unionByName(spark.createDataFrame([(None, None), (7, ""), (None, "?!")], "item_id long, text string"))
    odd = spark.createDataFrame([(None, None), (3, ""), (3, "")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(odd).unionByName(docs.select("doc_id", "text").where("doc_id < 20"))
    rows = lambda df: sorted(map(str, df.collect()))
    pairs, kept = rows(decontam.leaks(docs, items)), rows(decontam.keep_clean(docs, items))
    leaked = {r["doc_id"] for r in decontam.leaks(docs, items).collect()}
    assert pairs and kept == sorted(str(r) for r in docs.collect() if r["doc_id"] not in leaked)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", items.agg(F.sum(F.octet_length("text"))).first()[0] // 3)
    assert len(decontam._blocks(items)) > 2
    assert rows(decontam.leaks(docs, items)) == pairs
    assert rows(decontam.keep_clean(docs, items)) == kept


# 5 near duplicates


def brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_hard_group_of_near_copies(spark, monkeypatch):
    """A large group whose members differ from its first one by more than the threshold, in small cells."""
    for name, value in (("CELL", 8), ("GROUP_DOCS", 5), ("TILE", 3), ("GROUP_SHINGLES", 1000)):
        monkeypatch.setattr(neardup, name, value)
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for p in rng.choice(120, rng.integers(0, 9), replace=False):
            w[p] = f"e{i}x{p}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, rows[i][1]) for i in range(20)] + [(300, "lone text of words"), (301, "")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, 4, 80)


@pytest.mark.parametrize("small", [False, True])
def test_common_passage_in_documents_of_all_sizes(spark, monkeypatch, small):
    """One passage that many different documents share, among pairs right at the threshold and of unequal sizes."""
    if small:
        for name, value in (("CELL", 4), ("GROUP_DOCS", 2), ("GROUP_SHINGLES", 300), ("TILE", 2)):
            monkeypatch.setattr(neardup, name, value)
    rng, rows = np.random.default_rng(9), []
    passage = [f"p{k}" for k in range(60)]
    for i in range(120):
        own = [f"d{i}x{k}" for k in range(int(rng.integers(1, 60)))]
        rows.append((i, " ".join(passage + own)))
    for i in range(40):  # the first m words of a text: similarity m / n
        base = [f"b{i}x{k}" for k in range(103)]
        rows += [(1000 + 3 * i, " ".join(base)), (1001 + 3 * i, " ".join(base[: 80 + i % 8])), (1002 + 3 * i, " ".join(base[:83]))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, 4, 80)


def test_large_group_of_long_near_copies_is_compared_in_bounded_groups():
    """2,048 members of 20,000 shingles in one cell: every two meet in a group that stays under the bounds."""
    import pyarrow as pa

    n, size = 400, 20_000
    member = {"doc_id": pa.array(range(n), pa.int64()), "size": pa.array([size] * n, pa.int64()), "bits": pa.array([5] * n, pa.int64()), "component": pa.array(range(n), pa.int64()), "heads": pa.array([[7] + [k] * (neardup.PREFIX - 1) for k in range(n)], pa.list_(pa.int32())), "guest": pa.array([False] * n), "posted": pa.array([(1 << neardup.PREFIX) - 1] * n, pa.int64())}
    block = pa.StructArray.from_arrays(list(member.values()), names=list(member))
    cell = pa.ListArray.from_arrays(pa.array([0, 1], pa.int32()), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), block))
    group, ids, _ = neardup._close_members(7, cell[0], 80)
    held = {}
    for g, i in zip(group.tolist(), ids.tolist()):
        held.setdefault(g, set()).add(i)
    assert max(len(h) * size for h in held.values()) <= 2 * (neardup.GROUP_SHINGLES + size)
    met = {(i, j) for h in held.values() for i in h for j in h}
    assert len(met) == n * n


def test_five_word_components(spark):
    rows = [(i, t) for i, t, _ in documents()]
    got = neardup.near_duplicates(read_table(spark, SF, "documents")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, 5, 80)


# 6 SentencePiece


PUNCTUATED = ["He said 'no'.", "a->b", "<!-- note -->", "f('a', 'b');", "[-1, -2]", "foo-(bar)", "__init__.py", "it's 'fine', really", "<s> <0x41> <unk>", "  two  spaces ", "123,456.7 'quoted'", "naïve — Привет α٢", "▁meta", "\n\n\t x"]


def test_transducer_equals_library_and_round_trips():
    from sentencepiece import SentencePieceProcessor

    path = tokenizer_path("piece_bpe_32k.model")
    fst, library = piecefst.machine(path), SentencePieceProcessor(model_file=path)
    texts = [t for _, t, _ in documents()] + [o for o in ODD if o] + PUNCTUATED
    for t in texts:
        ids = fst.encode(t)
        assert ids.tolist() == library.encode(t)
        assert fst.decode(ids) == t.replace("▁", " ")


@pytest.mark.parametrize("alphabet", ["".join(map(chr, range(32, 127))), "!'()-_.,;:<>=/#*\"ab ", "abeéàßñЖдабαβ日本한🎉ا\u0301 \n\t'-1"])
def test_transducer_equals_library_on_random_texts(alphabet):
    from sentencepiece import SentencePieceProcessor

    path, rng = tokenizer_path("piece_bpe_32k.model"), np.random.default_rng(len(alphabet))
    letters = np.array(list(alphabet))
    texts = ["".join(letters[rng.integers(0, len(letters), rng.integers(0, 60))]) for _ in range(7000)]
    import pyarrow as pa

    from jobloom.llm.common import utf8_column

    ids, n = piecefst.machine(path).encode_block(*utf8_column(pa.array(texts)))
    got = np.split(ids, np.cumsum(n)[:-1])
    assert all(g.tolist() == w for g, w in zip(got, SentencePieceProcessor(model_file=path).encode(texts)))


def test_long_words_are_joined_from_stretches(monkeypatch):
    from sentencepiece import SentencePieceProcessor

    monkeypatch.setattr(piecefst, "LONG", 200)
    monkeypatch.setattr(piecefst, "STRETCH", 150)
    monkeypatch.setattr(piecefst, "OVERLAP", 40)
    path, rng = tokenizer_path("piece_bpe_32k.model"), np.random.default_rng(3)
    fst, library = piecefst.Transducer(path), SentencePieceProcessor(model_file=path)
    for letters in ("abcdefgh", "x", "yx", "etaoin", "q", "xyé"):
        for _ in range(5):
            t = "".join(np.array(list(letters))[rng.integers(0, len(letters), rng.integers(150, 2000))])
            assert fst.encode(t).tolist() == library.encode(t)


def test_cache_stays_small_and_right(monkeypatch):
    monkeypatch.setattr(piecefst, "CACHE_IDS", 64)
    monkeypatch.setattr(piecefst, "CACHE_SLOTS", 16)
    path = tokenizer_path("piece_bpe_32k.model")
    fst, plain = piecefst.Transducer(path), piecefst.machine(path)
    for _, t, _ in documents()[:60]:
        assert fst.encode(t).tolist() == plain.encode(t).tolist() and fst.used <= 64


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_model_equals_library(tmp_path, fallback):
    """A model written by hand: pieces with log probabilities, with and without bytes."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.pieces.add(piece="<unk>", score=0, type=2)
    if fallback:
        for b in range(256):
            model.pieces.add(piece=f"<0x{b:02X}>", score=0, type=6)
    for k, piece in enumerate(["▁", "a", "b", "c", "ab", "bc", "▁a", "abc", "cab", "▁ab", "ca"]):
        model.pieces.add(piece=piece, score=-1.0 - 0.37 * k - 0.011 * k * k)
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = piecefst.UNIGRAM, fallback
    spec = model.normalizer_spec
    spec.add_dummy_prefix, spec.escape_whitespaces, spec.remove_extra_whitespaces = True, True, False
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    fst, library, rng = piecefst.Transducer(str(path)), SentencePieceProcessor(model_file=str(path)), np.random.default_rng(2)
    for _ in range(300):
        t = "".join(np.array(list("aabbcc zé"))[rng.integers(0, 9, rng.integers(0, 25))])
        assert fst.encode(t).tolist() == library.encode(t)


def test_encode_and_decode_documents(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    d = spark.createDataFrame([(1, "Hello wörld"), (2, None)], "doc_id long, text string")
    back = piecefst.decode_documents(piecefst.encode_documents(d, path), path)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {1: "Hello wörld", 2: ""}


# 7 HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><p>no";</script></head><body><header>Top</header>
<nav><a href=/x>{0}</a></nav><div class="cookie-notice">We use cookies</div><article><h1>Head {0} &amp; tail</h1><p>First <b>bold</b>
 text<br>more<p>Second &lt;ok&gt;&nbsp;x<aside>Side</aside><div class="ad">Buy</div><form>f</form><ul><li>i1<li>i2</ul>
 <section class="comments"><p>Reader says</p></section></article><!-- no --><footer>&copy; {0}</footer></body></html>"""


def test_page_main_text(spark):
    rows = [(k, "https://h.example/a", PAGE.format(k)) for k in range(4)] + [(8, None, None), (9, "x", ""), (10, "http://one/", "<p>Only <i>this</i>"), (11, "http://two/", "plain &amp; text")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in htmltemplate.extract_pages(df).collect()}
    assert got[2] == "Head 2 & tail\nFirst bold text more\nSecond <ok> x\ni1\ni2"
    assert got[8] == got[9] == "" and got[10] == "Only this" and got[11] == "plain & text"
    assert htmltemplate.extract_pages(df.where("false")).count() == 0
    nodes = {t: n for t, n in htmltemplate.templates(df.where("page_id < 4")).groupBy("is_text").count().collect()}
    assert nodes[False] >= 4 and True not in nodes


@pytest.mark.parametrize("page, want", [("Intro text <p>para</p> tail", "Intro text\npara\ntail"), ("Hello <b>world</b>", "Hello world"), ("a < b and more text", "a < b and more text"), ("<article><div class=article-header>Top</div><section class='related-work'>Work</section></article>", "Top\nWork"), ("<p>a<p>b<div>c", "a\nb\nc"), ("<ul><li>a<li>b</ul>x", "a\nb\nx")])
def test_no_text_is_lost(spark, page, want):
    assert htmltemplate.extract(page) == want
    for n in (1, 9):  # alone, and as the whole host: a page of nothing but template words keeps them
        df = spark.createDataFrame([(k, "https://x.example/", page) for k in range(n)] + [(1, "https://x.example/", page)], "page_id long, url string, html string")
        assert [r["text"] for r in htmltemplate.extract_pages(df).collect()] == [want] * (n + 1)


def test_names_do_not_decide(spark):
    """The result stays when every class and id gets a random name."""
    import random

    def page(k, names):
        n = lambda x: names.setdefault(x, "n" + format(random.Random(x).getrandbits(40), "x"))
        return f"""<html><body><div class="{n('menu')}"><ul><li>Item {k}</li></ul></div><div id="{n('ad')}">Buy {k * 7}</div><div class="{n('wrap')}">
          <article class="{n('post')}"><h1>Title {k}</h1><p>Text {k} of it</p><div class="{n('body')}"><p>More {k}</p></div></article></div>
          <div class="{n('related')}"><p>Other story {k + 1}</p></div><div class="{n('legal')}">All rights reserved</div></body></html>"""

    keep = type("Same", (dict,), {"setdefault": lambda self, key, _: key})
    schema = "page_id long, url string, html string"
    plain, renamed = ({r["page_id"]: r["text"] for r in htmltemplate.extract_pages(spark.createDataFrame([(k, "https://r.example/x", page(k, names)) for k in range(12)], schema)).collect()} for names in (keep(), {}))
    assert plain == renamed == {k: f"Title {k}\nText {k} of it\nMore {k}" for k in range(12)}


def test_given_pages_do_not_depend_on_names(spark):
    src = read_table(spark, SF, "pages")
    renamed = src.withColumn("html", F.regexp_replace("html", 'class="ad"', 'class="q7f3"'))
    one, two = ({r["page_id"]: r["text"] for r in htmltemplate.extract_pages(d).collect()} for d in (src, renamed))
    many = {r["page_id"] for r in src.withColumn("h", htmltemplate.host_of("url")).withColumn("n", F.count("*").over(Window.partitionBy("h"))).where("n > 1").collect()}
    assert many and all(one[k] == two[k] for k in many)


def test_deep_pages_take_linear_memory():
    import time
    import tracemalloc

    for page in ("<div>" * 100_000 + "x", "<span>" * 100_000 + "<p>a" * 1000, "<b>" * 50_000 + "text</b>" * 50_000):
        tracemalloc.start()
        began = time.time()
        assert htmltemplate.extract(page).startswith(("x", "a", "text"))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 200e6 and time.time() - began < 60


def test_pages_keep_every_article_word(spark):
    import html

    src = {r["page_id"]: r["html"] for r in read_table(spark, SF, "pages").collect()}
    for r in queries.op7_html_extraction(spark, SF).collect():
        article = re.search(r"<article>(.*?)(</article>|<footer>|$)", src[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(b.replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article))]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("wrapper", ['<div class="layout has-sidebar">{}</div>', '<div class="no-sidebar">{}</div>', '<div class="page with-nav">{}</div>', '<div id="content-menu">{}</div>', '<form>{}</form>'])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_names_of_wrappers_drop_no_text(spark, wrapper, tag):
    body = "<nav>Menu one two three</nav>" + wrapper.format(f"<div class=sidebar>Side</div><{tag}><p>Main text of page {{}}</p><p>More of it</p></{tag}>") + "<footer>Foot</footer>"
    rows = [(k, "https://w.example/", f"<html><body>{body.format(k)}</body></html>") for k in range(3)]
    got = {r["page_id"]: r["text"] for r in htmltemplate.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    side = "Side\n" if wrapper.startswith("<form") and tag == "div" else ""  # found without names, so none is left out
    assert got == {k: f"{side}Main text of page {k}\nMore of it" for k in range(3)}


@pytest.mark.parametrize("form, want", [("<article><h1>Head {0}</h1><p>Lead {0}</p><div class=body><p>{1}</p></div><p>Tail {0}</p></article>", "Head {0}\nLead {0}\n{1}\nTail {0}"), ("<div class=one>{1}</div><div class=two>Second {0}</div>", "{1}\nSecond {0}"), ("By {0}<article>{1}</article>", "By {0}\n{1}")])
def test_slot_holds_all_text(spark, form, want):
    long = "most of the text is here " * 4
    rows = [(k, "https://s.example/", "<html><body><nav>Menu</nav>" + form.format(k, f"{long}{k}") + "</body></html>") for k in range(3)]
    got = {r["page_id"]: r["text"] for r in htmltemplate.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: want.format(k, f"{long}{k}") for k in range(3)}


def test_template_words_are_left_out(spark):
    """Words of the template in elements without a telling name; words that change their place or are rare stay."""
    def page(k):
        swap = ["<i>one</i>", "<i>two</i>"][:: 1 if k % 2 else -1]
        return f"<html><body><div class=x1>Site slogan</div><div class=x2><p>Story {k}</p>{'<p>Read also</p>' * (1 + k % 3)}<p>Same on two</p>{swap[0]} and {swap[1]}</div><div class=x3>(c) all rights {'' if k else 'x'}</div></body></html>"

    rows = [(k, "https://t.example/", page(k) if k < 2 else page(k).replace("<p>Same on two</p>", "")) for k in range(12)] + [(20 + k, "https://u.example/", "<body><div>All the same</div></body>") for k in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: r["text"] for r in htmltemplate.extract_pages(df).collect()}
    assert got[5] == "Story 5\none and two" and got[4] == "Story 4\ntwo and one"
    assert got[1] == "Story 1\nSame on two\none and two" and got[0] == "Story 0\nSame on two\ntwo and one\n(c) all rights x"
    assert {got[20 + k] for k in range(9)} == {"All the same"}


def test_comments_with_articles_stay_out():
    page = "<html><body><div class=post><p>A long text of the page itself</p></div><section class=comments><article>Reader</article></section></body></html>"
    assert htmltemplate.extract(page) == "A long text of the page itself"


# 8 token files


def test_token_files_equal_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = [(i, t) for i, t, _ in documents()] + [(100_000 + k, t) for k, t in enumerate(ODD + ["It's 3.14, ok.. <|endoftext|> A.B,C", "ΣΑΣ İ.x", "é x. y"])]
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenfile.token_digest(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path("word_bpe_49k.json")).collect()}
    start, want = 0, {}
    for i, t in sorted(rows):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == want


def test_wavelet_matrix():
    ids = np.random.default_rng(1).integers(0, 90, 3000)
    m = tokenfile.WaveletMatrix.from_bytes(tokenfile.WaveletMatrix.build(ids).to_bytes())
    assert (m.decode() == ids).all() and [m[i] for i in range(0, 3000, 101)] == ids[::101].tolist()
    for s in (0, 5, 89, 90, 5000):
        assert m.occurrences(s) == np.flatnonzero(ids == s).tolist() and m.count(s, 10, 2500) == (ids[10:2500] == s).sum()
    assert m.select(int(ids[0]), 10_000) == -1
    assert tokenfile.WaveletMatrix.build(np.array([1 << 20, 3])).decode().tolist() == [1 << 20, 3]


def test_shard_starts_are_sums_of_sums(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "PARTS_PER_BLOCK", 3)
    rows = [(p, q, 10 * p + q + 1) for p in range(40) for q in range(p % 3 + (p % 5 > 0))]
    got = {(r["part"], r["seq"]): r["first"] for r in tokenfile.shard_starts(spark.createDataFrame(rows, "part int, seq int, n_tokens long")).collect()}
    want, total = {}, 0
    for p, q, n in sorted(rows):
        want[p, q], total = total, total + n
    assert got == want


# 9 rules


def test_verdict_does_not_depend_on_order(spark):
    docs = read_table(spark, SF, "documents")
    names = [r.name for r in rules.RULES]
    one = {tuple(r) for r in rules.apply_rules(docs, order=names).collect()}
    assert one == {tuple(r) for r in rules.apply_rules(docs, order=names[::-1]).collect()}
    assert sorted(rules.measured_order(docs)) == sorted(names)


def test_rule_counts_on_odd_texts(spark):
    got = {r["doc_id"]: r for r in rules.apply_rules(odd_docs(spark).where("doc_id is not null and doc_id < 10").dropDuplicates(["doc_id"])).collect()}
    for i, t in enumerate(ODD):
        w = words(t)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        cover = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_repeat_words"], got[i]["n_dup_lines"]) == (len(w), sum(map(len, w)), len(cover), len(lines) - len(set(lines)))


def test_cascade_saves_evaluations(spark):
    docs = read_table(spark, SF, "documents")
    names = rules.measured_order(docs)
    seen = rules.evaluations(docs, order=names).collect()
    assert [r["rule"] for r in seen] == names and seen[0]["seen"] == docs.count()
    assert all(b["seen"] == a["seen"] - a["rejected"] for a, b in zip(seen, seen[1:])) and seen[-1]["seen"] < docs.count()
    kept = {r["doc_id"] for r in rules.keep_good(docs, order=names).collect()}
    assert len(kept) == seen[-1]["seen"] - seen[-1]["rejected"]
    assert kept == {r["doc_id"] for r in rules.apply_rules(docs).where("kept").collect()}


def test_order_of_rules_is_by_rejections_per_cost():
    # rule 0 rejects 60 of 100 at cost 6, rule 1 the same 60 at cost 3, rule 2 another 20 at cost 4
    assert rules.best_order([(0b011, 60), (0b100, 20), (0, 20)], [6.0, 3.0, 4.0]) == [1, 2, 0]


# 10 languages


def test_language_on_held_out_rows(spark):
    rows = langid.identify(read_table(spark, LARGER, "documents")).where("held_out").join(read_table(spark, LARGER, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97


def test_undetermined_texts(spark):
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd_docs(spark).where("doc_id < 6")).collect()}
    assert got[0] == got[1] == got[2] == "und" and got[3] != "und" and got[5] != "und"
    none = langid.identify(odd_docs(spark).withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}


@pytest.mark.parametrize("n", [4, 8, 70, 200])
def test_filter_has_no_false_negatives(n):
    keys, rng = V.mix(np.arange(5000, dtype=np.uint64)), np.random.default_rng(n)
    langs = [np.sort(rng.choice(5000, 900, replace=False)) for _ in range(n)]
    f = langid.Filter([f"l{k:03}" for k in range(n)], keys, langs, 0)
    has = lambda k, x: (f.masks(x)[f.at[k][0]] >> f.at[k][1] & f.slots.dtype.type(1)).astype(bool)
    for k in (0, 1, n - 1):
        assert has(k, keys[langs[k]]).all()
        assert abs(has(k, V.mix(np.arange(10_000, 60_000, dtype=np.uint64))).mean() - f.false_rate[k]) < 0.02


def test_more_languages_than_a_mask_word_holds(spark):
    names = [f"l{k:02}" for k in range(70)]
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    def word(k, j):
        rng = np.random.default_rng(k * 1000 + j)
        return "".join(alphabet[x] for x in rng.integers(0, 26, 6))
    rows = [(70 * j + k, " ".join(word(k, int(x)) for x in np.random.default_rng(j).integers(0, 8, 30)), name) for j in range(8) for k, name in enumerate(names)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    lang = {i: name for i, _, name in rows}
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got]) > 0.97


def test_languages_equal_exact_sets(spark):
    """The decisions of plain sets of n-grams per language; corrected popcounts may only differ where two languages are close."""
    docs = read_table(spark, SF, "documents")
    rows = docs.collect()
    learn = [r for r in rows if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]

    def grams(text):
        raw = (text or "").encode()
        low, off = V.letters_only(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        low = low.tobytes()
        return [low[i : i + k] for k in langid.SIZES for i in range(len(low) - k + 1)]

    counts = {}
    for r in learn:
        counts.setdefault(r["lang"], Counter()).update(grams(r["text"]))
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    rate = {lang: {g: n / total[lang] for g, n in c.items() if n >= langid.MIN_COUNT} for lang, c in counts.items()}
    best = Counter()
    for of in rate.values():
        for g, x in of.items():
            best[g] = max(best[g], x)
    sets = {lang: {g for g, x in of.items() if x >= langid.MIN_SHARE_OF_BEST * best[g]} for lang, of in rate.items()}
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    for r in rows:
        gs = grams(r["text"])
        hits = sorted(((sum(g in s for g in gs), lang) for lang, s in sets.items()), key=lambda x: (-x[0], x[1]))
        if not hits[0][0]:
            continue
        assert got[r["doc_id"]]["score"] == pytest.approx(hits[0][0] / sum(n for n, _ in hits), abs=0.02)
        if hits[0][0] - hits[1][0] > 0.01 * len(gs) + 1:
            assert got[r["doc_id"]]["lang_pred"] == hits[0][1]


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    from sentencepiece import SentencePieceProcessor

    docs = read_table(spark, SF, "documents")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = docs
    for name, stage in cp.STAGES[:-1]:
        before = {r["doc_id"] for r in kept.collect()}
        kept = stage(spark, kept, SF).cache()
        after = {r["doc_id"] for r in kept.collect()}
        assert kept.columns == docs.columns and after <= before and after
        if name == "MinHash near-dedup":
            comp = brute_components([(i, text[i]) for i in before], 5, 80)
            assert after == {i for i in before if comp[i][1] == i}
        if name == "benchmark decontamination":
            leaked = {r["doc_id"] for r in decontam.leaks(docs, read_table(spark, SF, "benchmark")).collect()}
            assert after == before - leaked
    library = SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    out = {r["doc_id"]: r for r in cp.STAGES[-1][1](spark, kept, SF).collect()}
    assert set(out) == {r["doc_id"] for r in kept.collect()}
    for i, r in out.items():
        ids = np.array(library.encode(text[i]), "<u4")
        assert r["n_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids.tobytes()) and r["decoded_equal"]


def test_hash_is_stable():
    assert chat.Mapping("x", ({"a": ""},)).fingerprints == [hashlib.sha256(b"{a>").hexdigest()]


@pytest.mark.parametrize("langs", [("de", "en", "es", "fr"), ("en", "fr")])
def test_foreign_text_and_gibberish_are_rejected(spark, langs):
    docs, marks = read_table(spark, LARGER, "documents"), read_table(spark, LARGER, "labels")
    docs = docs.where(F.col("lang").isin(*langs)).select("doc_id", "text", "lang")
    odd = ["Questo è un testo scritto in una lingua straniera che il modello non ha mai visto prima", "Przykładowy tekst w języku polskim, którego model nie zna", "xqzj wvkq zzxq jjkw pqxv bnmq wrtz kjhg fdsq the", "Быстрая лиса прыгает"]
    more = spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(odd)], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in langid.keep_identified(docs.unionByName(more)).select("doc_id").collect()}
    good = {r["doc_id"] for r in docs.join(marks.where("quality = 1"), "doc_id").select("doc_id").collect()}
    assert not {i for i in kept if i < 0} and len(good & kept) > 0.99 * len(good)
