"""Small rows taken from the branches of the operators, folds against plain loops, and plan shapes."""

import hashlib
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from jobloom.functions import text as T
from jobloom.operators import boards, evidence, matching, overlays, pages, scoring, training
from jobloom.plans import registry
from jobloom.sources import jsonl, lists, office
from tests.conftest import SF


def value(spark, column, **cells):
    df = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} string" for k in cells)) if cells else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("name, key", [("Acme Inc.", "acme"), ("ACME, LLC", "acme"), ("U.S.A. Parts Co", "usa parts"), ("Inc", ""), ("A&B (x) Ltd", "a and b"), (None, ""), ("Na Si", ""), ("x y", "xy")])
def test_fingerprint(spark, name, key):
    assert value(spark, T.company_fingerprint("n"), n=name) == key


def test_clean_takes_unicode_space(spark):
    assert value(spark, T.clean("n"), n=" a  b\n") == "a b"


@pytest.mark.parametrize("day, good", [("2026-05-01", True), ("2026-5-1", False), ("2026-02-30", False), ("", False), (None, False)])
def test_iso_date(spark, day, good):
    assert (value(spark, T.iso_date("d"), d=day) is not None) == good


def test_titles(spark):
    m = value(spark, matching.title_matches("t"), t="Senior  Python/Software Engineer (Remote)")
    assert m["keywords"] == ["software engineer", "python software engineer"] and m["families"] == ["software_engineering"]
    assert value(spark, matching.title_matches("t"), t="Account Executive, Developer")["keywords"] == []
    assert value(spark, matching.title_matches("t"), t=None)["families"] == []


def test_lists_order(spark):
    rows = spark.createDataFrame([(1, "# x"), (2, " "), (3, "Acme Inc"), (4, "ACME"), (5, "Beta")], "seq long, line string")
    assert {r["company_key"]: r["name"] for r in lists.first_wins(rows).collect()} == {"acme": "Acme Inc", "beta": "Beta"}
    assert {r["company_key"]: r["name"] for r in lists.last_wins(rows).collect()}["acme"] == "ACME"


def test_merge_equals_sequential_fold(spark):
    rng = random.Random(5)
    ranks = overlays.STATUS_RANK
    rows = [(rng.randrange(9), i, rng.choice(["", "a", "b"]), rng.choice(list(ranks) + [""]), rng.choice(["", "d1", "d2"]), rng.choice(["", "2024-01-01", "2024-05-05"])) for i in range(300)]
    want = {}
    for k, _, note, status, detail, day in rows:
        status = status or "unknown"
        old = want.get(k)
        if old is None:
            want[k] = [note, status, detail, day]
            continue
        new_detail = detail or old[2]
        if old[3] and old[3] > day:
            new_detail = old[2]
        want[k] = [note or old[0], status if ranks[status] >= ranks[old[1]] else old[1], new_detail, day or old[3]]
    df = spark.createDataFrame(rows, "k int, seq int, note string, status string, detail string, day string").repartition(3)
    got = overlays.merge_records(df, "k", ["note", "day"], ["status"], {"detail": "day"})
    assert {r["k"]: [r["note"], r["status"], r["detail"], r["day"]] for r in got.collect()} == want


def test_refresh_is_idempotent_and_drops_failed_companies(spark):
    old = spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], "c string, id int, seq int")
    new = spark.createDataFrame([("a", 2, 1), ("a", 2, 2)], "c string, id int, seq int")
    who = spark.createDataFrame([("a",), ("b",)], "c string")
    once = overlays.refresh_snapshot(old, new, who, "c", ["c", "id"])
    assert [tuple(r) for r in once.collect()] == [("a", 2, 2)]
    assert sorted(map(tuple, overlays.refresh_snapshot(once, new, who, "c", ["c", "id"]).collect())) == [("a", 2, 2)]


def test_prefix_ids_are_dense(spark):
    df = spark.createDataFrame([(d, i) for d in "cab" for i in range(3)], "doc string, idx int").repartition(4)
    ids = [r["id"] for r in overlays.prefix_ids(df, "doc", "idx", "ev_", 4).orderBy("doc", "idx").collect()]
    assert ids == [f"ev_{k:04d}" for k in range(1, 10)]


def test_select_targets_stops_at_limit(spark):
    df = spark.createDataFrame([(i, i % 3 == 0, False) for i in range(20)], "seq long, negative boolean, cached boolean")
    got = [(r["seq"], r["status"]) for r in boards.select_targets(df, 3).orderBy("seq").collect()]
    assert [s for s, x in got if x == "selected"] == [1, 2, 4] and max(s for s, _ in got) == 4


def test_overlap_top_equals_cross_join(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    jobs = [(i, rng.sample(words, 4)) for i in range(6)] + [(99, [])]
    pieces = [(i, rng.choice([0, 2, 5, -1]), rng.random() < 0.3, i, rng.sample(words, 3)) for i in range(40)]
    got = scoring.top_by_overlap(spark.createDataFrame(jobs, "j int, tokens array<string>"), spark.createDataFrame(pieces, "e int, static int, strong boolean, seq int, tokens array<string>"), "j", "e", "static", 5)
    have = {}
    for r in got.orderBy("j", "rank").collect():
        have.setdefault(r["j"], []).append(r["e"])
    for j, t in jobs:
        scored = sorted(((-(3 * len(set(t) & set(w)) + s), -b, q, e) for e, s, b, q, w in pieces))
        assert have.get(j, []) == [e for s, _, _, e in scored if s < 0][:5]


def test_overlap_pairs_are_not_shuffled(spark, tmp_path):
    """A token that all pieces hold makes a pair of every piece and job; where jobs are known to be small, only pieces and the best of each task move."""
    jobs = spark.createDataFrame([(j, ["hot", f"w{j}"], ["a"] if j % 2 else None) for j in range(5)] + [(9, None, ["a"])], "j int, tokens array<string>, wants array<string>")
    pieces = [(i, i % 3, i % 2 == 0, i, ["hot", "hot", f"w{i % 7}"], ["a"] if i % 50 == 0 else None) for i in range(300)] + [(None, 9, True, 0, ["hot"], None), (300, 1, True, 300, None, ["a"]), (301, 1, True, 301, [], None)]
    ev = spark.createDataFrame(pieces, "e int, static int, strong boolean, seq int, tokens array<string>, has array<string>")
    top = scoring.top_by_overlap(jobs, ev, "j", "e", "static", 4, wants="wants", has="has")
    got = {}
    for r in top.orderBy("j", "rank").collect():
        got.setdefault(r["j"], []).append((r["e"], r["score"]))
    for j in jobs.collect():
        score = lambda p: 3 * len(set(p[4] or []) & set(j["tokens"] or [])) + p[1] + (6 if set(p[5] or []) & set(j["wants"] or []) else 0)  # noqa: B023, E731
        ranked = sorted((-score(p), not p[2], p[3], p[0]) for p in pieces if p[0] is not None and score(p) > 0)
        assert got.get(j["j"], []) == [(e, -s) for s, _, _, e in ranked[:4]]
    jobs.write.parquet(str(tmp_path / "jobs"))
    small = scoring.top_by_overlap(spark.read.parquet(str(tmp_path / "jobs")), ev, "j", "e", "static", 4, wants="wants", has="has")
    assert sorted(small.collect(), key=str) == sorted(top.collect(), key=str)
    moved = [line for line in small._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert not [line for line in moved if "e#" in line.split("hashpartitioning")[1] and "j#" in line.split("hashpartitioning")[1]]
    pairs = scoring.overlap_scores(jobs, ev, "j", "e", "static")
    assert pairs.count() == 1500 and pairs.where("overlap = 2").count() == 5 * 300 // 7 + 1


def test_top_k_limits_before_the_shuffle(spark):
    scored = spark.createDataFrame([(1, "o", "s", True, 5, "a")], "job int, organisation string, summary string, strong boolean, score int, evidence_id string")
    assert "WindowGroupLimit" in scoring.top_by_tags(scored, "job")._jdf.queryExecution().toString()


def test_sections_reset(spark):
    rows = ["TECHNICAL SKILLS", "Knows many useful tools", "HOBBIES", "Enjoys long walks outside", "PROFESSIONAL EXPERIENCE", "Org | Role", "Did a thing for someone", "PROJECTS", "Plan (2024)", "Made another thing here", "JAN 2020", "email: x", "short"]
    p = spark.createDataFrame([("d", i, t) for i, t in enumerate(rows)], "doc string, idx int, text string")
    got = [(r["idx"], r["section"], r["organisation"]) for r in evidence.resume_sections(p).orderBy("idx").collect()]
    assert got == [(1, "skills", None), (3, "", None), (6, "experience", "Org"), (9, "projects", "Plan")]


@pytest.mark.parametrize("text, prompt, answer", [("Why (so)I think", "Why (so)", "I think"), ("What? Because", "What?", "Because"), ("No mark", None, "No mark"), ("Only?", None, "Only?"), ("", None, "")])
def test_prompt_split(spark, text, prompt, answer):
    assert tuple(value(spark, evidence.prompt_and_answer("t"), t=text)) == (prompt, answer)


def test_page_text_keeps_script_strings(spark):
    assert value(spark, pages.page_text("h"), h='<p>a&amp;b<script>var t="</p>";</script><!-- x --> c</p>') == 'a&b var t="</p>"; c'
    assert value(spark, pages.page_text("h"), h=None) == ""


def test_validation_reasons(spark):
    m = "array<struct<role:string,content:string>>"
    ok = [("system", "a"), ("user", "b"), ("assistant", "c")]
    rows = [(ok,), (ok[:2],), (ok[::-1],), ([("system", "a"), ("user", " "), ("assistant", "c")],), (None,)]
    valid, bad = training.validate(spark.createDataFrame(rows, f"messages {m}"))
    assert valid.count() == 1
    assert sorted(r["reason"] for r in bad.collect()) == ["empty content", "missing messages", "wrong number of messages", "wrong roles"]
    assert training.gate(valid).first()["passed"] is False


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "k int, v string")
    path = f"file://{tmp_path}/out"
    assert jsonl.write_canonical(df, path, ["k"]) == 2
    assert jsonl.write_canonical(df, path, ["k"]) == 2
    assert sorted(map(tuple, jsonl.scan_strict(spark, path, "k int, v string").collect())) == [(1, None), (2, "b")]
    assert jsonl.scan_tolerant(spark, f"file://{tmp_path}/missing", "k int").count() == 0
    (tmp_path / "bad.jsonl").write_text('{"k": 1}\n\n{oops\n[1]\n')
    assert jsonl.scan_tolerant(spark, f"file://{tmp_path}/bad.jsonl", "k int").count() == 1
    with pytest.raises(Exception):
        jsonl.scan_strict(spark, f"file://{tmp_path}/bad.jsonl", "k int").collect()


def _docx(paragraphs):
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_office_documents(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(_docx(["One  two", "", "Three"]))
    (tmp_path / "~$a.docx").write_bytes(b"lock")
    got = office.read_documents(spark, f"file://{tmp_path}").orderBy("idx").collect()
    assert [(r["idx"], r["text"]) for r in got] == [(0, "One two"), (2, "Three")]


def test_stream_refreshes_snapshot(spark, tmp_path):
    from jobloom.streaming import snapshots

    source, table = tmp_path / "in", f"file://{tmp_path}/table"
    schema = "c string, id int, seq int"
    for k, rows in enumerate(([("a", 1, 0), ("b", 1, 0)], [("a", 2, 1)])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"file://{source}")
        snapshots.refresh_stream(spark.readStream.schema(schema).parquet(f"file://{source}"), table, "c", ["c", "id"], f"file://{tmp_path}/ck").awaitTermination()
    assert sorted((r["c"], r["id"]) for r in snapshots.current(spark, table).collect()) == [("a", 2), ("b", 1)]


def test_patch_keeps_clears_and_rejects(spark):
    null = None
    tracking = spark.createDataFrame([("a", "u", "reviewed", "2024-01-01", "", "", "old")], "k string, job_url string, status string, review_date string, application_date string, next_action_date string, notes string")
    patches = spark.createDataFrame([("a", "applied", null, null, null, ""), ("b", "reviewed", null, null, null, null), ("c", "odd", null, null, null, null), ("d", "applied", null, null, null, null)], "k string, status string, review_date string, application_date string, next_action_date string, notes string")
    snapshot = spark.createDataFrame([("b", "ub"), ("c", "uc")], "k string, job_url string")
    rows, rejected = overlays.patch_tracking(tracking, patches, snapshot, ["k"], "2024-06-01")
    got = {r["k"]: r for r in rows.collect()}
    assert got["a"]["notes"] == "" and got["a"]["application_date"] == "2024-06-01" and got["a"]["review_date"] == "2024-01-01"
    assert got["b"]["job_url"] == "ub" and set(got) == {"a", "b"}
    assert {r["k"]: r["reason"] for r in rejected.collect()} == {"c": "status", "d": "job"}


def test_detail_filter_stays_below_the_join(spark):
    listings = spark.createDataFrame([(1, True)], "k int, title_matched boolean")
    details = spark.createDataFrame([(1, True)], "k int, has_detail boolean")
    m = boards.match_details(listings, details, ["k"], F.lit(True))
    assert m.first()["is_match"] is True


def test_text_list_keeps_file_order(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# head\nAcme Inc\n\nBeta\nACME\n")
    rows = lists.scan(spark, f"file://{tmp_path}/list.txt")
    assert {r["name"] for r in lists.first_wins(rows).collect()} == {"Acme Inc", "Beta"}
    assert {r["name"] for r in lists.last_wins(rows).collect()} >= {"ACME", "Beta"}


@pytest.mark.parametrize("build", ["d1_title_match", "g4_field_merge", "e6_registry_build", "h5_overlap_top", "b1_clean_text"])
def test_hot_paths_stay_in_the_jvm(spark, build):
    from jobloom.plans import registry
    from tests.conftest import SF

    plan = registry.queries()[build](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


def test_scan_reads_only_what_it_needs(spark):
    from jobloom.plans import registry
    from tests.conftest import SF

    plan = registry.queries()["slice_listing_assessment"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThanOrEqual(l_quantity,49.0)" in plan and "l_extendedprice" not in plan.split("Physical Plan")[1]


def test_tag_top_equals_all_pairs(spark):
    rng = random.Random(8)
    names = list("abcdefg")
    jobs = [(i, rng.choice(names), rng.sample(names, 2)) for i in range(12)]
    pieces = [(f"ev_{i:03d}", rng.choice("xyz"), rng.choice("pq"), rng.sample(names, rng.randint(0, 2)), rng.sample(names, rng.randint(0, 2)), rng.random() < 0.4, rng.random() < 0.3) for i in range(60)]
    got = {}
    evidence_rows = spark.createDataFrame(pieces, "evidence_id string, organisation string, summary string, role_tags array<string>, skill_tags array<string>, strong boolean, quantified boolean")
    for r in scoring.select_by_tags(spark.createDataFrame(jobs, "job int, family string, tags array<string>"), evidence_rows, "job", 4).orderBy("job", "rank").collect():
        got.setdefault(r["job"], []).append(r["evidence_id"])
    for j, family, want in jobs:
        score = lambda p: 5 * (family in p[3]) + 3 * len(set(want) & set(p[4])) + 2 * p[5] + p[6]  # noqa: B023, E731
        chosen, seen = [], set()
        for p in sorted(pieces, key=lambda p: (score(p), p[5], p[0]), reverse=True):
            if score(p) > 0 and (p[1], p[2]) not in seen and len(chosen) < 4:
                seen.add((p[1], p[2]))
                chosen.append(p[0])
        assert got.get(j, []) == chosen


def test_overlap_of_all_sources(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["source"] for r in registry.queries()["e12_token_overlap_all"](spark, SF).join(docs, "doc_id").select("source").distinct().collect()}
    assert got == {r["source"] for r in docs.select("source").distinct().collect()}


def test_prompts_of_all_lines(spark, tmp_path):
    text = "Why here? Because I can\nWhat (so)I did it\nReally?\n1. Name it\nPlain line"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.queries()["d13_prompts_all"](spark, str(tmp_path)).orderBy("idx").collect()
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert [(r["prompt"], r["answer"], r["question"]) for r in rows] == [("Why here?", md5("Because I can"), False), ("What (so)", md5("I did it"), False), (None, md5("Really?"), True), (None, md5("1. Name it"), True), (None, md5("Plain line"), False)]


def test_queries_on_all_rows_leave_none_out(spark):
    count = lambda name: registry.queries()[name](spark, SF).count()
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    assert count("g1_last_wins_all") == read("events").select("user_id").distinct().count() > count("g1_last_wins")
    assert count("b4_canonical_name_all") == count("b4_canonical_name") == read("supplier").count()


def test_last_keyed_drops_rows_without_a_key(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), ("a", "z", 2), (None, "n", 4), (" \t", "b", 5), ("", "e", 6)], "k string, v string, seq int")
    assert [(r["k"], r["v"]) for r in overlays.last_keyed(rows, ["k"], "seq").collect()] == [("a", "y")]
