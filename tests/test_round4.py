"""Cases of the round's findings: rules stated in full, bounded tasks, whole results."""

import random
from datetime import datetime

import duckdb
import numpy as np
from pyspark.sql import functions as F

from jobloom.plans import registry


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL over tables given as (rows, schema)."""
    con = duckdb.connect()
    for table, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).coalesce(1).write.mode("overwrite").parquet(f"file://{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df, want = registry.queries()[name](spark, f"file://{folder}"), con.sql(registry.oracle_sql()[name])
    at = [want.columns.index(c) for c in df.columns]
    return sorted(map(tuple, df.collect())), sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_line_classes_state_every_start(spark, tmp_path):
    starts = ["Location: x", "mobile: 1", "EMAIL: a", "LinkedIn: b", "website: c", "GitHub", "+1 (168) 555-5254 more words", "Dear hiring team", "Sincerely, me", "https://x y", "http://x", "httpd is no address", "a@b", "a @ b"]
    heads = ["ONE TWO", "A B C D E F", "A B C D E F G", "lower", "1999", "EDUCATION & PROFESSIONAL DEVELOPMENT", "MAY 2020", "MAY\t2020", "MAY2020", "MAY 2020", ""]
    got, want = both(spark, tmp_path, "d9_line_classes", documents=([(i, t) for i, t in enumerate([*starts, *heads, "\n".join(starts + heads), None])], "doc_id long, text string"))
    assert got == want
    assert {doc for doc, _, contacts, _ in got if doc < len(starts) and contacts} == set(range(len(starts))) - {starts.index("httpd is no address"), starts.index("a @ b")}


def test_intake_report_reads_all_customers_and_lists_missing_nations(spark, tmp_path):
    nation = ([(i, f"N{i}") for i in range(4)], "n_nationkey int, n_name string")
    customer = ([(1, 0, 10.0), (2, 3, 5.0), (3, 1, 9500.0)], "c_custkey long, c_nationkey int, c_acctbal double")
    orders = ([(i, i % 7, datetime(2020, 1, 1 + i % 28), "F") for i in range(1, 600)], "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderstatus string")
    got, want = both(spark, tmp_path, "n3_intake_report", nation=nation, customer=customer, orders=orders)
    assert got == want
    assert [r for r in got if r[0] == "missing"] == [("missing", "N2")] and len(got) == 26


def test_rules_are_found_in_place(spark, monkeypatch):
    """Blocks, slices and steps of any size find what plain comparison finds; texts are not shuffled."""
    from jobloom.operators import needles

    rnd = random.Random(4)
    texts = [(i, "".join(rnd.choices("abcÉ日\n", k=rnd.choice([0, 1, 5, 60, 900])))) for i in range(60)]
    rules = [(i, "".join(rnd.choices("abcÉ日\n", k=rnd.choice([1, 2, 3, 4, 5, 9])))) for i in range(200)] + [(900, ""), (901, texts[-1][1][:700])]
    want = sorted((k, i) for k, t in texts for i, n in rules if n.lower() in t.lower())
    frames = spark.createDataFrame(texts, "k long, t string"), spark.createDataFrame(rules, "i int, needle string")
    assert sorted(map(tuple, needles.rule_hits(*frames, "k", "t").collect())) == want
    for size in (1, 7, 64):
        found = needles._finder([n.lower().encode() for _, n in rules])
        monkeypatch.setattr(needles, "SLICE", size * 5)
        monkeypatch.setattr(needles, "PAIRS", size)
        parts = [t.lower().encode() for _, t in texts]
        ends = np.cumsum([0, *map(len, parts)])
        got = found(np.frombuffer(b"".join(parts), np.uint8), ends)
        assert sorted((texts[x // len(rules)][0], rules[x % len(rules)][0]) for x in got) == want
    monkeypatch.undo()
    monkeypatch.setattr(needles, "BLOCK", 30)
    assert sorted(map(tuple, needles.rule_hits(*frames, "k", "t").collect())) == want
    tags = {r["k"]: r["tags"] for r in needles.tags_by_rules(*frames, "k", "t", "i").collect()}
    assert tags == {k: sorted(i for j, i in want if j == k) for k, _ in texts}
    assert all(r["x"] == min(i for j, i in want if j == r["k"]) for r in needles.first_by_rules(frames[0], frames[1].withColumn("x", F.col("i")), "k", "t", "x", "i", -1).collect())
    monkeypatch.undo()
    plan = needles.rule_hits(*frames, "k", "t")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_board_candidates_are_made_in_place(spark):
    from jobloom.operators import boards

    names = [(1, "Acme Widget Group"), (1, "Acme Inc"), (1, "Acme Widget Group"), (2, "Bolt Co"), (None, "Bolt"), (3, None), (4, "")]
    out = boards.board_candidates(spark.createDataFrame(names, "k int, name string"), "k", "name")
    rows = out.collect()
    assert [tuple(f) for f in out.dtypes][-1] == ("order", "struct<t:int,h:int,s:int,f:int>")
    assert len({(r["k"], r["board_url"]) for r in rows}) == len(rows)
    best = {}
    for k, name in names:
        if name:
            mine = spark.createDataFrame([(name,)], "n string").select(boards.tenant_candidates("n").alias("t"), boards.site_candidates("n").alias("s")).first()
            for t, tenant in enumerate(mine["t"]):
                for h, host in enumerate(boards.HOSTS):
                    for s, site in enumerate(mine["s"]):
                        for f, (a, b) in enumerate((("/en-US/", ""), ("/en-US/", "/jobs"), ("/", ""))):
                            url = (k, f"https://{tenant}.{host}.myworkdayjobs.com{a}{site}{b}")
                            best[url] = min(best.get(url, (99,)), (t, h, s, f))
    assert {(r["k"], r["board_url"]): tuple(r["order"]) for r in rows} == best
    assert {(r["k"], r["probe_key"]) for r in rows if r["order"]["f"] == 0} == {(r["k"], r["probe_key"]) for r in rows}
    plan = boards.board_candidates(spark.range(9).select("id", F.lit("A B").alias("n")), "id", "n")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortAggregate" not in plan


def test_pieces_of_one_file_are_scored_in_many_tasks(spark):
    from jobloom.operators import scoring

    pieces = spark.range(0, 40, 1, 1).select(F.col("id").alias("evidence_id"), F.lit("o").alias("organisation"), F.col("id").cast("string").alias("summary"), F.array(F.lit("x")).alias("role_tags"), F.array(F.lit("y")).alias("skill_tags"), (F.col("id") % 2 == 0).alias("strong"), F.lit(False).alias("quantified"))
    jobs = spark.createDataFrame([(1, "x", ["y"])], "job int, family string, tags array<string>")
    top = scoring.select_by_tags(jobs, pieces, "job", 4)
    assert [r["evidence_id"] for r in top.orderBy("rank").collect()] == [38, 36, 34, 32]
    assert top._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 1  # as many tasks as the session shuffles to, whatever the file


def test_pairs_are_hashed_and_bounded_by_task(spark, monkeypatch):
    from jobloom.operators import scoring

    jobs = spark.createDataFrame([(j, [f"t{j}", "all"], ["x"] if j % 2 else ["y"]) for j in range(6)], "j int, tokens array<string>, wants array<string>")
    ev = spark.createDataFrame([(e, e % 5, e % 2 == 0, e, [f"t{e % 6}", "all"], ["x"] if e % 3 else None) for e in range(90)], "e int, static int, strong boolean, seq int, tokens array<string>, has array<string>")
    want = {}
    for j in range(6):
        scored = [(-(3 * (1 + (e % 6 == j)) + e % 5 + 6 * bool(j % 2 and e % 3)), e % 2, e) for e in range(90)]
        want |= {(j, k + 1): (e, -s) for k, (s, _, e) in enumerate(sorted(scored)[:4])}
    for bound in (scoring.PAIRS_PER_TASK, 20):
        monkeypatch.setattr(scoring, "PAIRS_PER_TASK", bound)
        top = scoring.top_by_overlap(jobs, ev, "j", "e", "static", 4, wants="wants", has="has")
        assert {(r["j"], r["rank"]): (r["e"], r["score"]) for r in top.collect()} == want
    pairs = scoring._matches(jobs.select("j", scoring._entries(0, F.col("tokens")).alias("entries")), ev.select("e", "has", scoring._entries(0, F.col("tokens")).alias("entries")), "j", "e", ["has"], 27)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert ", 27)" in plan and "HashAggregate" in plan and "SortAggregate" not in plan


def test_a_line_is_cleaned_once(spark, tmp_path):
    spark.createDataFrame([(1, "a  long enough line of text\nSincerely, somebody with words"), (2, None)], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    df = registry.queries()["d15_kept_evidence"](spark, f"file://{tmp_path}")
    assert [(r["doc"], r["idx"]) for r in df.collect()] == [(1, 0), (1, 1)][:1]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("(?U)") == 1


def test_documents_are_handed_on_in_small_batches(spark):
    from jobloom.sources import office

    schema = office.pa.schema([("path", office.pa.string()), ("content", office.pa.binary())])
    batches = list(office.in_batches(((f"f{i}", bytes(200_000)) for i in range(30)), schema))
    assert len(batches) == 5 and sum(b.num_rows for b in batches) == 30 and max(b.nbytes for b in batches) < office.FLUSH + 300_000
    texts = spark.createDataFrame([(f"f{i}", f"one {i}\n\n two  words ") for i in range(50)], "path string, text string")
    got = sorted(map(tuple, office.parse_files(office.build_files(texts)).collect()))
    assert got == sorted(x for i in range(50) for x in ((f"f{i}", 0, f"one {i}"), (f"f{i}", 2, "two words")))
