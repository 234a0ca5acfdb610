"""Carry-forward by blocks, bounded top-k, one-exchange registry, bucketed state, probe groups and paging on small fixtures."""

import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from jobloom.operators import boards, evidence, matching, overlays, scoring
from jobloom.operators.carry import carry_forward
from jobloom.plans import registry
from jobloom.sources import payloads
from jobloom.streaming import snapshots
from jobloom.streaming.state import StateStore
from tests.conftest import SF


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# carry-forward


def marked_lines(spark, n=3000):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot", "hot", "hot", "b", None]), i, rnd.choice([None] * 40 + ["x", "y"]), rnd.choice([None] * 300 + ["z"])) for i in range(n)]
    return spark.createDataFrame(rows, "doc string, idx int, a string, b string")


@pytest.mark.parametrize("block", [1, 7, 100, 10_000])
def test_carry_forward_equals_the_window(spark, block):
    rows = marked_lines(spark)
    w = Window.partitionBy("doc").orderBy("idx")
    want = rows.select("doc", "idx", F.last("a", True).over(w).alias("x"), F.last("b", True).over(w).alias("y")).collect()
    got = carry_forward(rows, "doc", "idx", {"x": "a", "y": "b"}, block).select("doc", "idx", "x", "y").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_a_hot_document_is_spread_over_tasks(spark):
    one = spark.range(20_000).select(F.lit("hot").alias("doc"), F.col("id").cast("int").alias("idx"), F.when(F.col("id") % 5000 == 3, F.col("id").cast("string")).alias("a"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["n"] for r in carry_forward(one, "doc", "idx", {"x": "a"}, 100).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 10_000
    windows = [line for line in plan_of(carry_forward(one, "doc", "idx", {"x": "a"}, 100)).splitlines() if "Window [" in line]
    rows_window = [line for line in windows if "__last_x" not in line]
    assert rows_window and all("__block" in line for line in rows_window)


def test_carry_forward_of_an_empty_table(spark):
    assert carry_forward(marked_lines(spark).where("false"), "doc", "idx", {"x": "a"}).collect() == []


def test_narrative_paragraphs(spark):
    long = "I like to build tools that people use every day"
    rows = [
        ("q", 0, f"Why us? {long}", "application_qa"), ("q", 1, "short one", "application_qa"), ("q", 2, "Tell us about a tool", "application_qa"), ("q", 3, long, "application_qa"),
        ("q", 4, "me@example.org", "application_qa"), ("q", 5, f"as in your resume {long}", "application_qa"), ("q", 6, "1. Name one thing", "application_qa"), ("q", 7, long + " too", "application_qa"),
        ("l", 0, f"Thank you for considering me, {long}", "cover_letter"), ("l", 1, f"Why? {long}", "cover_letter"), ("l", 2, None, "cover_letter"), ("n", 0, long, None),
    ]
    got = evidence.narrative_paragraphs(spark.createDataFrame(rows, "doc string, idx int, text string, doc_type string"), block=2).orderBy("doc", "idx").collect()
    assert [(r["doc"], r["idx"], r["text"], r["location"]) for r in got] == [
        ("l", 1, f"Why? {long}", "paragraph_1"), ("n", 0, long, "paragraph_0"),
        ("q", 0, long, "paragraph_0 | prompt=Why us?"), ("q", 3, long, "paragraph_3 | prompt=Tell us about a tool"), ("q", 7, long + " too", "paragraph_7 | prompt=1. Name one thing"),
    ]


# registry


def test_registry_build_has_one_exchange_by_key(spark):
    plan = plan_of(registry.queries()["e6_registry_build"](spark, SF))
    above = plan.split("Union")[0]
    assert above.count("Exchange hashpartitioning") == 1 and "Join" not in above


# top-k by bounds


def zipf_pieces(spark, n=600, seed=5):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    jobs = [(j, sorted(set(rnd.choices(words, weights, k=25)))) for j in range(8)] + [(98, []), (99, ["nowhere"]), (97, None)]
    pieces = [(i, rnd.randrange(6), rnd.random() < 0.3, i, rnd.choices(words, weights, k=rnd.choice([0, 3, 30, 90]))) for i in range(n)]
    return jobs, pieces, spark.createDataFrame(jobs, "j int, tokens array<string>"), spark.createDataFrame(pieces, "e int, static int, strong boolean, seq int, tokens array<string>")


def test_bounded_top_equals_cross_join_and_looks_at_fewer_pairs(spark, monkeypatch):
    jobs, pieces, job_rows, piece_rows = zipf_pieces(spark)
    looked = []
    plain = scoring.bounded_pairs
    monkeypatch.setattr(scoring, "bounded_pairs", lambda *a: looked.append(plain(*a)) or looked[-1])
    got = {}
    for r in scoring.top_by_bounds(job_rows, piece_rows, "j", "e", "static", 5).orderBy("j", "rank").collect():
        got.setdefault(r["j"], []).append((r["e"], r["score"]))
    for j, t in jobs:
        scored = sorted((-(3 * len(set(t or []) & set(w)) + s), not b, q, e) for e, s, b, q, w in pieces)
        assert got.get(j, []) == [(e, -s) for s, _, _, e in scored if s < 0][:5]
    sharing = sum(bool(set(t or []) & set(p[4])) for _, t in jobs for p in pieces)
    assert looked[0].count() < 0.6 * sharing


def test_bounded_top_of_ties_and_hot_tokens(spark):
    pieces = [(i, 0, False, i, ["hot", "a"] if i % 2 else ["hot"]) for i in range(300)]
    rows = spark.createDataFrame(pieces, "e int, static int, strong boolean, seq int, tokens array<string>")
    jobs = spark.createDataFrame([(1, ["hot"]), (2, ["hot", "a"]), (None, ["hot"])], "j int, tokens array<string>")
    top = scoring.top_by_bounds(jobs, rows, "j", "e", "static", 3).orderBy("j", "rank").collect()
    assert [(r["j"], r["e"], r["score"]) for r in top] == [(1, 0, 3), (1, 1, 3), (1, 2, 3), (2, 1, 6), (2, 3, 6), (2, 5, 6)]


# bucketed state


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_batch_of_one_company_writes_one_bucket(spark, tmp_path):
    source, table = tmp_path / "in", tmp_path / "table"
    schema = "c string, id int, seq int"
    run = lambda: snapshots.refresh_stream(spark.readStream.schema(schema).parquet(f"file://{source}"), f"file://{table}", "c", ["c", "id"], f"file://{tmp_path}/ck", buckets=16).awaitTermination()
    spark.createDataFrame([(f"c{k}", 1, 0) for k in range(60)], schema).write.mode("append").parquet(f"file://{source}")
    run()
    before, store = files(table), StateStore(spark, f"file://{table}")
    old = store.manifest()
    spark.createDataFrame([("c7", 2, 1)], schema).write.mode("append").parquet(f"file://{source}")
    run()
    new = store.manifest()
    parts = lambda m: m["tables"]["snapshot"]["parts"]
    changed = [b for b in parts(new) if parts(new)[b] != parts(old).get(b)]
    assert len(changed) == 1 and len({f.rpartition("/")[0] for f in files(table) - before}) == 1
    rows = {(r["c"], r["id"]) for r in snapshots.current(spark, f"file://{table}").collect()}
    assert rows == {(f"c{k}", 1) for k in range(60) if k != 7} | {("c7", 2)}
    stale = {(r["c"], r["id"]) for r in store.read("snapshot", manifest=old).collect()}  # a slow reader still has its files
    assert ("c7", 1) in stale and len(stale) == 60


def test_tables_become_valid_together(spark, tmp_path, monkeypatch):
    store = StateStore(spark, f"file://{tmp_path}/s", buckets=4)
    table = lambda v: spark.createDataFrame([(k, v) for k in "abc"], "k string, v int")
    assert store.read("registry") is None
    store.commit({"registry": (table(1), "k", None), "hints": (table(1), "k", None)})
    seen = lambda: {t: {r["v"] for r in store.read(t).collect()} for t in ("registry", "hints")}

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(StateStore, "_point_to", die)
        with pytest.raises(RuntimeError):
            store.commit({"registry": (table(2), "k", None), "hints": (table(2), "k", None)})
    assert seen() == {"registry": {1}, "hints": {1}}
    store.commit({"registry": (table(3), "k", None), "hints": (table(3), "k", None)})
    assert seen() == {"registry": {3}, "hints": {3}}
    store.keep_ms = -60_000
    store.commit({"hints": (table(4).where("k = 'a'"), "k", None)})
    assert seen() == {"registry": {3}, "hints": {4}} and len(files(tmp_path / "s")) <= 4
    touched = store.touched(table(0).where("k = 'b'"), "k")
    with pytest.raises(ValueError):
        store.commit({"registry": (table(5), "k", touched)})
    store.commit({"registry": (table(5).where("false"), "k", touched)})
    assert {r["k"] for r in store.read("registry").collect()} < set("abc")


def test_discovery_results_reach_three_tables_in_one_commit(spark, tmp_path):
    store = StateStore(spark, f"file://{tmp_path}/d", buckets=4)
    reg = spark.createDataFrame([("a", "unknown", "", ""), ("b", "unknown", "", "")], "k string, status string, board_url string, last_checked string")
    hints = spark.createDataFrame([("b", "tb", "sb", "ub")], "k string, tenant string, site_id string, board_url string")
    results = spark.createDataFrame([("a", "confirmed", "ua", "ta", "sa", 1), ("b", "not_found", "", "", "", 1)], "k string, outcome string, board_url string, tenant string, site_id string, seq int")
    updated, revisits = overlays.apply_discoveries(reg, results, "k", "2024-06-01")
    store.commit({"registry": (updated, "k", None), "revisits": (revisits, "k", None), "hints": (overlays.hint_rows(hints, results, "k"), "k", None)})
    m = store.manifest()
    assert sorted(map(tuple, store.read("hints", manifest=m).collect())) == [("a", "ta", "sa", "ua"), ("b", "tb", "sb", "ub")]
    assert {r["k"]: r["status"] for r in store.read("registry", manifest=m).collect()} == {"a": "confirmed", "b": "not_found"} and store.read("revisits", manifest=m).count() == 2


# probe groups, paging, labels


def test_probe_groups(spark):
    rows = [
        ("a", 0, 0, "not_found", True, "a00"), ("a", 1, 0, "malformed", True, "a10"), ("a", 2, 1, "not_found", True, "a21"), ("a", 2, 0, "confirmed", False, "a20"), ("a", 3, 0, "error", True, "a30"),
        ("b", 0, 0, "confirmed", False, "b00"), ("b", 0, 1, "not_found", False, "b01"), ("c", 0, 0, "error", True, "c00"), ("c", 1, 0, "confirmed", True, "c10"), ("d", 0, 0, "not_found", None, "d00"), ("d", 0, 1, "confirmed", True, "d01"),
    ]
    probes = spark.createDataFrame([(*r, "t" + r[5], "s" + r[5]) for r in rows], "k string, group_no int, form_no int, outcome string, reachable boolean, board_url string, tenant string, site_id string")
    got = {r["k"]: (r["outcome"], r["board_url"], r["tenant"]) for r in boards.grouped_verdict(probes, "k").collect()}
    assert got == {"a": ("confirmed", "a21", "ta20"), "b": ("confirmed", "b00", "tb00"), "c": ("error", "", ""), "d": ("not_found", "", "")}
    assert {r["outcome"] for r in boards.grouped_verdict(probes, "k", False).collect()} == {"needs_retry"}


def test_short_page_ends_the_paging(spark):
    pages = spark.createDataFrame([("a", 0, 20), ("a", 40, 20), ("b", 0, 20), ("b", 20, 3), ("b", 40, 20), ("c", 0, None)], "b string, off int, n int")
    got = sorted(tuple(r) for r in payloads.short_page_gaps(pages, "b", "off", "n").collect())
    assert got == [("a", 20, "missing"), ("a", 60, "missing"), ("b", 40, "beyond")]


def test_hint_rows_keep_what_the_run_cannot_use(spark):
    hints = spark.createDataFrame([("a", "t", "s", "u"), ("b", "t", "s", "u")], "k string, tenant string, site_id string, board_url string")
    results = spark.createDataFrame([("a", "confirmed", " n ", "m", "v", 1), ("a", "confirmed", "n2", "m2", "v2", 2), ("b", "confirmed", "", "m", "v", 1), ("c", "not_found", "n", "m", "v", 1), ("d", "confirmed", "n", "m", None, 1)], "k string, outcome string, tenant string, site_id string, board_url string, seq int")
    assert sorted(tuple(r) for r in overlays.hint_rows(hints, results, "k").collect()) == [("a", "n2", "m2", "v2"), ("b", "t", "s", "u")]


def test_labels_and_focus(spark):
    df = spark.createDataFrame([("API api data",), ("data data api",), ("none",), (None,), ("C++ c++",)], "text string")
    label = matching.best_label("text", [("one", ("api", "c++")), ("two", ("data",))], "neither")
    assert [r[0] for r in df.select(label).collect()] == ["one", "two", "neither", "neither", "one"]
    value = matching.focus("text", {"x": ("api",), "y": ("data",)}, [("both", lambda n: (n["x"] > 0) & (n["y"] > n["x"])), ("x", lambda n: n["x"] > 0)], "rest")
    assert [r[0] for r in df.select(value).collect()] == ["x", "both", "rest", "rest", "rest"]


# rules as rows


def test_rule_hits_equal_every_contains(spark):
    from jobloom.operators import needles

    rnd = random.Random(9)
    alphabet = "abcde É\n日"
    texts = [(i, "".join(rnd.choices(alphabet, k=rnd.choice([0, 1, 3, 40, 400])))) for i in range(80)] + [(None, "abc"), (900, None)]
    rules = [(f"r{i}", "".join(rnd.choices(alphabet, k=rnd.randint(1, 7)))) for i in range(300)] + [("same", "ab"), ("same", "AB"), ("none", None), ("all", "")]
    got = needles.rule_hits(spark.createDataFrame(texts, "k long, t string"), spark.createDataFrame(rules, "name string, needle string"), "k", "t").collect()
    want = [(k, name) for k, t in texts if k is not None for name, n in rules if n is not None and n.lower() in (t or "").lower()]
    assert sorted(map(tuple, got)) == sorted(want)


def test_ten_thousand_rules_make_no_larger_plan(spark):
    from jobloom.operators import needles

    texts = spark.createDataFrame([(1, "needle 77 and needle 9999 here")], "k long, t string")
    size = lambda n: len(plan_of(needles.rule_hits(texts, spark.range(n).select(F.concat(F.lit("needle "), "id").alias("needle"), F.col("id").alias("rule")), "k", "t")))
    assert abs(size(10_000) - size(10)) < 200
    hits = needles.rule_hits(texts, spark.range(10_000).select(F.concat(F.lit("needle "), "id").alias("needle"), F.col("id").alias("rule")), "k", "t")
    assert {r["rule"] for r in hits.collect()} == {7, 77, 9, 99, 999, 9999}


def test_rules_give_tags_and_first_outcomes(spark):
    from jobloom.operators import needles

    texts = spark.createDataFrame([(1, "Big red ring"), (2, "nothing"), (3, None)], "k long, t string")
    rules = spark.createDataFrame([("color", 2, "RED"), ("shape", 1, "ring"), ("shape", 3, "rod"), ("color", 0, "blue")], "tag string, place int, needle string")
    assert sorted((r["k"], r["tags"]) for r in needles.tags_by_rules(texts, rules, "k", "t").collect()) == [(1, ["color", "shape"]), (2, []), (3, [])]
    assert sorted(map(tuple, needles.first_by_rules(texts, rules, "k", "t", "tag", "place", "rest").collect())) == [(1, "shape"), (2, "rest"), (3, "rest")]


# counts in the same pass


def test_distinct_supporters_by_bitmaps(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([rnd.randrange(50), rnd.randrange(10**12), -rnd.randrange(100_000), None]), rnd.choices("abc", k=rnd.randint(0, 3)), rnd.choice(["x", "y", None])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "id long, tags array<string>, c string")
    for ids in (df, df.withColumn("id", F.col("id").cast("string"))):
        got = {r["tag"]: (r["n_ids"], r["contexts"]) for r in evidence.tag_entries(ids, "tags", "id", F.col("c")).collect()}
        assert got == {t: (len({i for i, ts, _ in rows if t in ts and i is not None}), sorted({c for _, ts, c in rows if t in ts and c})) for t in "abc"}
    assert "Expand" not in plan_of(evidence.tag_entries(df, "tags", "id", F.col("c")))


def test_rejects_are_counted_with_the_write(spark, tmp_path):
    from pyspark.sql import Observation

    from jobloom.operators import training
    from jobloom.sources import jsonl

    (tmp_path / "in.jsonl").write_text('{"k": 1}\n\n[1]\nbroken\n{"k": 2}\n')
    counts = Observation()
    records = jsonl.scan_tolerant(spark, f"file://{tmp_path}/in.jsonl", "k int", counts)
    assert plan_of(records).count("FileScan") == 1
    records.write.parquet(f"file://{tmp_path}/out")
    want = jsonl.count_rejects(spark.read.text(f"file://{tmp_path}/in.jsonl")).first().asDict()
    assert counts.get == want == {"taken": 2, "blank": 1, "rejected": 2}
    assert jsonl.write_canonical(records, f"file://{tmp_path}/canon", ["k"]) == 2
    os.rename(tmp_path / "canon", tmp_path / "canon.old")  # a reader between the two renames
    assert jsonl.scan_tolerant(spark, f"file://{tmp_path}/canon", "k int").count() == 2
    good = [("system", "a"), ("user", "b"), ("assistant", "c")]
    df = spark.createDataFrame([(1, good), (2, good[:2]), (3, good)], "id int, messages array<struct<role:string,content:string>>")
    seen = Observation()
    valid, _ = training.validate(df, counts=seen)
    valid.write.parquet(f"file://{tmp_path}/valid")
    assert seen.get == {"examples": 2, "rejected": 1} and training.passes(seen, 2) and not training.passes(seen, 3)


def test_a_run_reaches_all_tables_by_touched_buckets(spark, tmp_path):
    from jobloom.streaming.upkeep import apply_run

    store = StateStore(spark, f"file://{tmp_path}/s", buckets=8)
    jobs = lambda rows: spark.createDataFrame(rows, "c string, id string, job_url string, seq int")
    looked = lambda rows: spark.createDataFrame(rows, "c string, last_scraped string, seq int, not_found boolean")
    names = [f"c{k}" for k in range(30)]
    first = apply_run(store, jobs([(c, "1", f"u{c}", 0) for c in names if c != "c5"]), looked([(c, "2024-01-01", 0, c == "c5") for c in names]), "c", ["c", "id"], "2024-01-01")
    before = store.manifest()
    assert len(first) > 3 and {r["c"] for r in store.read("negatives").collect()} == {"c5"}
    # c5 gets a board, c6 loses its job, c7 is not looked at, a stray listing of it does not count
    touched = apply_run(store, jobs([("c5", "9", "u9", 1), ("c7", "8", "u8", 1)]), looked([("c5", "2024-02-01", 1, False), ("c6", "2024-02-01", 1, False)]), "c", ["c", "id"], "2024-02-01")
    after = store.manifest()
    for table in ("snapshot", "search_cache", "negatives", "tracking"):
        parts = [m["tables"][table]["parts"] for m in (before, after)]
        assert {int(b) for b in parts[0].keys() | parts[1].keys() if parts[0].get(b) != parts[1].get(b)} <= set(touched) and len(touched) <= 2
    snapshot = {(r["c"], r["id"]) for r in store.read("snapshot").collect()}
    assert snapshot == {(c, "1") for c in names if c not in ("c5", "c6")} | {("c5", "9")}
    assert store.read("negatives").count() == 0
    dates = {r["c"]: r["last_scraped"] for r in store.read("search_cache").collect()}
    assert len(dates) == 30 and dates["c5"] == dates["c6"] == "2024-02-01" and dates["c7"] == "2024-01-01"
    reviews = {(r["c"], r["id"]): r["review_date"] for r in store.read("tracking").collect()}
    assert len(reviews) == 30 and reviews[("c5", "9")] == "2024-02-01" and reviews[("c6", "1")] == "2024-01-01"
    assert apply_run(store, jobs([]), looked([]), "c", ["c", "id"], "2024-03-01") == []
