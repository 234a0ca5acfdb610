"""State tables over orders, customer, events, supplier and nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import filled
from ..operators import overlays as O
from . import query, table

RUN = "1999-06-01"


def _events(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_type", "props", F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("g1_last_wins", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS seq FROM events WHERE user_id % 7 <> 0 GROUP BY 1")
def g1(spark, sf):
    """All events; every seventh user's have a blank key, and the operator drops them."""
    key = F.expr("CASE WHEN user_id % 7 = 0 THEN '  ' ELSE CAST(user_id AS STRING) END")
    return O.last_keyed(_events(spark, sf).select(key.alias("user_id"), "event_type", "seq"), ["user_id"], "seq").withColumn("user_id", F.col("user_id").cast("long"))


@query("g1_last_wins_all", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS seq FROM events GROUP BY 1")
def g1_all(spark, sf):
    """g1 over all users."""
    return O.last_by(_events(spark, sf).select("user_id", "event_type", "seq"), ["user_id"], "seq")


@query("g3_latest_by_date", "SELECT user_id, arg_max(event_type, d || ' ' || lpad(event_id::VARCHAR, 12, '0')) AS event_type, max(d || ' ' || lpad(event_id::VARCHAR, 12, '0')) AS mark FROM (SELECT *, CASE WHEN event_type = 'view' THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS d FROM events) GROUP BY 1")
def g3(spark, sf):
    rows = _events(spark, sf).select("user_id", "event_type", "seq", F.when(F.col("event_type") == "view", "").otherwise(F.col("day")).alias("last_scraped"))
    out = O.latest_by_date(rows, ["user_id"], "last_scraped")
    return out.select("user_id", "event_type", F.concat_ws(" ", "last_scraped", F.lpad(F.col("seq").cast("string"), 12, "0")).alias("mark"))


_STATUS = "CASE event_type WHEN 'signup' THEN 'confirmed' WHEN 'view' THEN 'not_found' WHEN 'click' THEN 'needs_retry' WHEN 'error' THEN '' ELSE 'unknown' END"
_RANK = "CASE event_type WHEN 'signup' THEN 3 WHEN 'view' THEN 2 WHEN 'click' THEN 1 ELSE 0 END"


@query("g4_field_merge", f"WITH e AS (SELECT user_id, event_id, {_STATUS} AS status, {_RANK} AS r, CASE WHEN event_id % 3 = 0 THEN '' ELSE props END AS note FROM events) SELECT user_id, coalesce(arg_max(note, event_id) FILTER (note <> ''), '') AS note, arg_max(CASE WHEN status = '' THEN 'unknown' ELSE status END, r * 1000000000000 + event_id) AS status FROM e GROUP BY 1")
def g4(spark, sf):
    rows = _events(spark, sf).select("user_id", "seq", F.expr(_STATUS).alias("status"), F.when(F.col("seq") % 3 == 0, "").otherwise(F.col("props")).alias("note"))
    return O.merge_records(rows, "user_id", ["note"], ["status"])


@query("g5_snapshot_refresh", "WITH r AS (SELECT o_custkey, o_orderpriority, arg_max(o_orderkey, o_orderkey) AS o_orderkey FROM orders WHERE o_orderdate >= '2000-01-01' GROUP BY ALL) SELECT o_custkey, o_orderpriority, o_orderkey FROM r UNION ALL SELECT o_custkey, o_orderpriority, o_orderkey FROM orders WHERE o_orderdate < '2000-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM r)")
def g5(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", F.col("o_orderkey").alias("seq"), "o_orderdate")
    old, new = o.where("o_orderdate < '2000-01-01'").drop("o_orderdate"), o.where("o_orderdate >= '2000-01-01'").drop("o_orderdate")
    return O.refresh_snapshot(old, new, new, "o_custkey", ["o_custkey", "o_orderpriority"]).drop("seq")


def _tracking(spark, sf):
    return table(spark, sf, "orders").where("o_orderdate < '1998-01-01'").groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"), F.max("o_orderkey").alias("job")).select(F.col("o_custkey").alias("k"), "status", "job")


def _snapshot(spark, sf):
    return table(spark, sf, "customer").select((F.col("c_custkey") + 100).alias("k"), F.concat(F.lit("https://x/"), "c_name").alias("job_url"))


_T = "(SELECT o_custkey AS k, arg_max(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS job FROM orders WHERE o_orderdate < '1998-01-01' GROUP BY 1)"
_S = "(SELECT c_custkey + 100 AS k, 'https://x/' || c_name AS job_url FROM customer)"


@query("e3_tracked_in_snapshot", f"SELECT t.k, t.status, s.job_url FROM {_T} t JOIN {_S} s USING (k) UNION ALL SELECT k, status, NULL FROM {_T} t WHERE k NOT IN (SELECT k FROM {_S} s)")
def e3(spark, sf):
    found, missing = O.tracked_in_snapshot(_tracking(spark, sf), _snapshot(spark, sf), ["k"])
    return found.select("k", "status", "job_url").unionByName(missing.select("k", "status", F.lit(None).cast("string").alias("job_url")))


@query("e4_pending_reviews", f"SELECT k, job_url, 'pending_review' AS status, '{RUN}' AS review_date, '' AS application_date, '' AS next_action_date FROM {_S} s WHERE k NOT IN (SELECT k FROM {_T} t)")
def e4(spark, sf):
    return O.pending_reviews(_snapshot(spark, sf), _tracking(spark, sf), ["k"], RUN)


_CACHE = "(SELECT o_custkey AS k, CASE WHEN o_custkey % 9 = 0 THEN 'bad' WHEN o_custkey % 11 = 0 THEN ' ' ELSE strftime(max(o_orderdate), '%Y-%m-%d') END AS last_scraped FROM orders GROUP BY 1)"


@query("e5_new_revisits", f"SELECT c_custkey AS k, c_name AS company_name, CASE WHEN trim(coalesce(last_scraped, '')) = '' THEN '{RUN}' ELSE last_scraped END AS last_checked, (coalesce(try_cast(nullif(trim(last_scraped), '') AS DATE), DATE '{RUN}') + 30)::DATE::VARCHAR AS next_revisit FROM customer LEFT JOIN {_CACHE} c ON c.k = c_custkey WHERE c_custkey NOT IN (SELECT k FROM {_T} t)")
def e5(spark, sf):
    cache = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("d"))
    cache = cache.select("k", F.when(F.col("k") % 9 == 0, "bad").when(F.col("k") % 11 == 0, " ").otherwise(F.col("d")).alias("last_scraped"))
    who = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("company_name"))
    return O.new_revisits(who, _tracking(spark, sf), cache, "k", RUN)


@query("k1_next_revisit", f"SELECT o_orderkey, (CASE WHEN o_orderkey % 4 = 0 THEN DATE '{RUN}' ELSE o_orderdate::DATE END + 30)::DATE::VARCHAR AS next_revisit FROM orders")
def k1(spark, sf):
    from ..functions.text import iso_date

    day = F.when(F.col("o_orderkey") % 4 == 0, "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf, "orders").select("o_orderkey", F.date_add(F.coalesce(iso_date(day), F.lit(RUN).cast("date")), O.REVISIT_DAYS).cast("string").alias("next_revisit"))


@query("k2_due_revisits", f"SELECT o_orderdate::DATE <= DATE '{RUN}' AS due, count(*) AS n FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1")
def k2(spark, sf):
    r = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 4 == 0, "2026-5-1").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("next_revisit"))
    return O.due_revisits(r, RUN).groupBy("due").agg(F.count("*").alias("n"))


@query("k3_first_date", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderpriority LIKE '1%' THEN 'urgent' ELSE 'none' END AS d FROM orders")
def k3(spark, sf):
    a, b = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(""), F.when(F.col("o_orderpriority").startswith("1"), "urgent")
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(filled(a), filled(b), F.lit("none")).alias("d"))


@query("f1_status_counts", f"SELECT status, count(*) AS n FROM {_T} t GROUP BY 1")
def f1(spark, sf):
    return _tracking(spark, sf).groupBy("status").agg(F.count("*").alias("n")).orderBy("status")


@query("n1_tracking_report", f"SELECT 'status ' || status AS section, count(*) AS n FROM {_T} t GROUP BY 1 UNION ALL SELECT 'tracked', count(*) FROM {_T} t WHERE k IN (SELECT k FROM {_S} s) UNION ALL SELECT 'missing', count(*) FROM {_T} t WHERE k NOT IN (SELECT k FROM {_S} s)")
def n1(spark, sf):
    from ..operators import reports

    return reports.tracking_report(_tracking(spark, sf), _snapshot(spark, sf), ["k"])


@query("g7_cache_and_negatives", "WITH c AS (SELECT o_custkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderkey AS seq, o_orderstatus AS s FROM orders), w AS (SELECT k, max(d || lpad(seq::VARCHAR, 12, '0')) AS m, arg_max(s, d || lpad(seq::VARCHAR, 12, '0')) AS s FROM c GROUP BY 1) SELECT k, m AS mark, s AS status, (s = 'F' OR k % 5 = 0 AND k NOT IN (SELECT k FROM c WHERE seq % 2 = 1)) AS negative FROM w")
def g7(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("last_scraped"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"))
    cache = O.upsert_cache(o.where("seq % 2 = 0"), o.where("seq % 2 = 1"), ["k"])
    assessed = o.where("seq % 2 = 1").select("k").distinct().join(cache, "k").select("k", (F.col("status") == "F").alias("not_found"))
    other = cache.where("status = 'F'").select("k")
    negatives = O.update_negatives(cache.where("k % 5 = 0").select("k").union(other), assessed, "k").withColumn("negative", F.lit(True)).distinct()
    return cache.join(negatives, "k", "left").select("k", F.concat("last_scraped", F.lpad(F.col("seq").cast("string"), 12, "0")).alias("mark"), "status", F.coalesce("negative", F.lit(False)).alias("negative"))


_PATCH = f"(SELECT o_custkey AS k, CASE max(o_orderkey) % 4 WHEN 0 THEN 'applied' WHEN 1 THEN 'nonsense' ELSE 'reviewed' END AS status, CASE WHEN o_custkey % 2 = 0 THEN '' END AS note FROM orders WHERE o_orderdate >= '1998-01-01' GROUP BY 1)"


@query("g8_tracking_patch", f"""
WITH t AS (SELECT k, 'old' AS url, status, 'n' || job AS notes FROM {_T}), p AS {_PATCH}, s AS {_S},
j AS (SELECT coalesce(t.k, p.k) AS k, t.k IS NOT NULL AS tracked, p.k IS NOT NULL AS patched, t.status AS ts, p.status AS ps, p.note, t.notes, t.url, s.job_url,
  CASE WHEN p.k IS NULL THEN NULL WHEN p.status = 'nonsense' THEN 'status' WHEN t.k IS NULL AND s.k IS NULL THEN 'job' END AS reason
  FROM t FULL JOIN p ON t.k = p.k LEFT JOIN s ON s.k = coalesce(t.k, p.k))
SELECT k, 'row' AS kind, CASE WHEN patched AND reason IS NULL THEN coalesce(url, job_url, '') ELSE url END AS job_url,
  CASE WHEN patched AND reason IS NULL THEN ps ELSE ts END AS status,
  CASE WHEN patched AND reason IS NULL THEN '{RUN}' ELSE '' END AS review_date,
  CASE WHEN patched AND reason IS NULL AND ps = 'applied' THEN '{RUN}' ELSE '' END AS application_date,
  CASE WHEN patched AND reason IS NULL THEN coalesce(note, notes, '') ELSE coalesce(notes, '') END AS notes
FROM j WHERE tracked OR reason IS NULL
UNION ALL SELECT k, 'rejected', '', reason, '', '', '' FROM j WHERE reason IS NOT NULL""")
def g8(spark, sf):
    tracking = _tracking(spark, sf).select("k", F.lit("old").alias("job_url"), "status", *[F.lit("").alias(c) for c in ("review_date", "application_date", "next_action_date")], F.concat(F.lit("n"), "job").alias("notes"))
    recent = table(spark, sf, "orders").where("o_orderdate >= '1998-01-01'").groupBy(F.col("o_custkey").alias("k")).agg((F.max("o_orderkey") % 4).alias("m"))
    null = F.lit(None).cast("string")
    patches = recent.select("k", F.when(F.col("m") == 0, "applied").when(F.col("m") == 1, "nonsense").otherwise("reviewed").alias("status"), null.alias("review_date"), null.alias("application_date"), null.alias("next_action_date"), F.when(F.col("k") % 2 == 0, "").alias("notes"))
    rows, rejected = O.patch_tracking(tracking, patches, _snapshot(spark, sf), ["k"], RUN)
    none = [F.lit("").alias(c) for c in ("review_date", "application_date", "notes")]
    return rows.select("k", F.lit("row").alias("kind"), "job_url", "status", "review_date", "application_date", "notes").unionByName(rejected.select("k", F.lit("rejected").alias("kind"), F.lit("").alias("job_url"), F.col("reason").alias("status"), *none))


@query("g9_discovery_results", f"SELECT c_custkey AS k, CASE WHEN o IS NULL THEN 'unknown' ELSE o END AS status, CASE WHEN o = 'confirmed' THEN 'https://b/' || c_custkey ELSE '' END AS board_url, CASE WHEN o IS NULL THEN '' ELSE '{RUN}' END AS last_checked, CASE WHEN o IS NULL THEN '' ELSE '1999-07-01' END AS next_revisit FROM (SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'confirmed' WHEN 'BUILDING' THEN 'not_found' END AS o FROM customer)")
def g9(spark, sf):
    c = table(spark, sf, "customer")
    reg = c.select(F.col("c_custkey").alias("k"), F.lit("unknown").alias("status"), F.lit("").alias("board_url"), F.lit("").alias("last_checked"))
    res = c.select(F.col("c_custkey").alias("k"), F.expr("CASE c_mktsegment WHEN 'MACHINERY' THEN 'confirmed' WHEN 'BUILDING' THEN 'not_found' ELSE 'needs_retry' END").alias("outcome"), F.concat(F.lit("https://b/"), "c_custkey").alias("board_url"))
    updated, revisits = O.apply_discoveries(reg, res, "k", RUN)
    return updated.join(revisits.select("k", "next_revisit"), "k", "left").withColumn("next_revisit", F.coalesce("next_revisit", F.lit("")))


_HINTS = "WITH old AS (SELECT s_suppkey % 300 AS k, arg_max('t' || s_suppkey, s_suppkey) AS tenant, 'old' AS site_id, 'https://old/' || k AS board_url FROM supplier GROUP BY k), new AS (SELECT c_custkey % 300 AS k, max(c_custkey) AS c FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal >= 0 GROUP BY 1) SELECT coalesce(old.k, new.k) AS k, CASE WHEN new.k IS NULL THEN tenant ELSE 'n' || c END AS tenant, CASE WHEN new.k IS NULL THEN site_id ELSE 'jobs' END AS site_id, CASE WHEN new.k IS NULL THEN board_url ELSE 'https://b/' || c END AS board_url FROM old FULL JOIN new USING (k)"


@query("g9_hint_rows", _HINTS)
def g9_hints(spark, sf):
    """The hint table after a run: confirmed boards replace hints, those without an address do not."""
    k = (F.col("s_suppkey") % 300).alias("k")
    old = table(spark, sf, "supplier").groupBy(k).agg(F.max_by(F.concat(F.lit("t"), "s_suppkey"), "s_suppkey").alias("tenant"))
    old = old.select("k", "tenant", F.lit("old").alias("site_id"), F.concat(F.lit("https://old/"), "k").alias("board_url"))
    results = table(spark, sf, "customer").select((F.col("c_custkey") % 300).alias("k"), F.when(F.col("c_mktsegment") == "MACHINERY", "confirmed").otherwise("not_found").alias("outcome"), F.concat(F.lit("n"), "c_custkey").alias("tenant"), F.lit(" jobs ").alias("site_id"), F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("https://b/"), "c_custkey")).otherwise("").alias("board_url"), F.col("c_custkey").alias("seq"))
    return O.hint_rows(old, results, "k")


@query("g10_detail_backfill", "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS place, c_custkey % 3 = 0 AS changed FROM customer")
def g10(spark, sf):
    c = table(spark, sf, "customer")
    snap = c.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("place"), F.lit("d").alias("description"))
    det = c.select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, "new").otherwise("").alias("place"), F.lit("d").alias("description"))
    return O.backfill_details(snap, det, ["k"], ["place", "description"]).select("k", "place", "changed")


@query("g11_normalised_records", "SELECT trim(c_name) AS company_name, CASE WHEN c_custkey % 3 = 0 THEN 'pending_review' ELSE lower(c_mktsegment) END AS status, '' AS notes FROM customer WHERE c_custkey % 5 <> 0")
def g11(spark, sf):
    raw = table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(F.concat(F.lit(" "), "c_name", F.lit("  "))).alias("company_name"), F.when(F.col("c_custkey") % 3 != 0, F.lower("c_mktsegment")).alias("status"), "c_acctbal")
    return O.normalise(raw, ["company_name"], {"status": "pending_review", "notes": ""})


@query("g12_sequential_ids", "SELECT conv_id, turn, 'ev_' || CASE WHEN rn >= 10000 THEN rn::VARCHAR ELSE lpad(rn::VARCHAR, 4, '0') END AS id FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS rn FROM conversations)")
def g12(spark, sf):
    return O.prefix_ids(table(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", "turn", "ev_", 4)


@query("e10_lookup_by_key", "SELECT l_orderkey, l_linenumber, o.o_orderstatus FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) l LEFT JOIN (SELECT o_orderkey, arg_min(o_orderstatus, o_custkey) AS o_orderstatus FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) o ON o_orderkey = l_orderkey")
def e10(spark, sf):
    first = O.first_by(table(spark, sf, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"], "o_custkey")
    want = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return want.join(first, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("l_orderkey", "l_linenumber", "o_orderstatus")


@query("e13_preferred_text", "SELECT p_brand, arg_min(p_name, pos) AS text FROM (SELECT p_brand, p_name, CASE p_type WHEN 'PROMO' THEN 0 WHEN 'SMALL' THEN 1 ELSE 2 END * 1000000 + p_partkey AS pos FROM part WHERE p_partkey % 2 = 0 AND p_type IN ('PROMO', 'SMALL', 'LARGE')) GROUP BY 1")
def e13(spark, sf):
    prefs = F.posexplode(F.array(F.lit("PROMO"), F.lit("SMALL"), F.lit("LARGE")))
    wanted = spark.range(1).select(prefs.alias("pos", "p_type"))
    parts = table(spark, sf, "part").select("p_brand", "p_type", "p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise("").alias("text")).where("text <> ''")
    return parts.join(wanted, "p_type").groupBy("p_brand").agg(F.min_by("text", F.struct("pos", "p_partkey")).alias("text"))


_PREF = "(SELECT c_custkey AS k, i AS pos, c_custkey * i % 997 AS ref FROM customer, (VALUES (1), (2), (3)) v(i))"


@query("e13_preferred_ids", f"SELECT k, arg_min(ref, pos) AS ref, arg_min(text, pos) AS text FROM {_PREF} w JOIN (SELECT p_partkey AS ref, min(p_name) AS text FROM part WHERE p_partkey % 3 = 0 GROUP BY 1) e USING (ref) GROUP BY 1")
def e13_ids(spark, sf):
    return _preferred(spark, sf)[0]


@query("e13_missing_ids", f"SELECT DISTINCT k FROM {_PREF} w WHERE k NOT IN (SELECT k FROM {_PREF} x WHERE ref IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0))")
def e13_missing(spark, sf):
    return _preferred(spark, sf)[1]


def _preferred(spark, sf):
    wanted = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("pos")).withColumn("ref", F.col("k") * F.col("pos") % 997)
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("ref"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(" ").alias("text"))
    return O.preferred_text(parts, wanted, "k", "ref", "text")


@query("e14_source_precedence", "SELECT k, arg_min(src, p) AS src FROM (SELECT c_custkey AS k, CASE c_mktsegment WHEN 'MACHINERY' THEN 1 ELSE 5 END AS p, CASE c_mktsegment WHEN 'MACHINERY' THEN 'snapshot' ELSE 'fallback' END AS src FROM customer UNION ALL SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 2 ELSE 4 END, CASE o_orderstatus WHEN 'F' THEN 'page' ELSE 'listing' END FROM orders) GROUP BY 1")
def e14(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    part = lambda df, k, best, p, s: df.select(F.col(k).alias("k"), F.when(best, p[0]).otherwise(p[1]).alias("priority"), F.when(best, s[0]).otherwise(s[1]).alias("src"))
    every = part(c, "c_custkey", F.col("c_mktsegment") == "MACHINERY", (1, 5), ("snapshot", "fallback")).union(part(o, "o_custkey", F.col("o_orderstatus") == "F", (2, 4), ("page", "listing")))
    return O.by_priority(every, "k").select("k", "src")
