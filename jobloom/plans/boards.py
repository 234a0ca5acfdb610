"""Board checks, waterfall, discovery and registry over part, lineitem, orders, events, customer and supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boards as B
from ..operators import matching as M
from ..operators import registry as R
from ..operators import reports
from . import query, sqlparts as S, table
from .matching import EXCLUDED, FAMILIES, _title_sql

RUN = "1999-06-01"


def slice_matches(spark, sf):
    part, line = table(spark, sf, "part"), table(spark, sf, "lineitem")
    listings = part.select("p_partkey", "p_brand", "p_name", (F.size(M.title_matches("p_name", FAMILIES, EXCLUDED)["keywords"]) > 0).alias("title_matched"))
    details = line.where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("has_detail", F.lit(True))
    return B.match_details(listings, details, ["p_partkey"], F.col("p_partkey") % 3 != 0)


_TITLE = f"({_title_sql('p_name', 'k')}) <> ''"
_MATCHES = f"(SELECT p_partkey, p_brand, p_name, {_TITLE} AS title_matched, {_TITLE} AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49) AND p_partkey % 3 <> 0 AS is_match FROM part)"
_ASSESS = f"(SELECT p_brand, count(*) AS jobs_seen, count_if(is_match) AS matched_job_count, CASE WHEN bool_or(is_match) THEN 'Matched' WHEN bool_or(title_matched) THEN 'No matching locations' ELSE 'No matching job titles' END AS status FROM {_MATCHES} m GROUP BY 1)"


@query("slice_listing_assessment", f"SELECT * FROM {_ASSESS} a")
def slice_assessment(spark, sf):
    return B.assess(slice_matches(spark, sf), "p_brand").select("p_brand", "jobs_seen", "matched_job_count", "status")


@query("e1_listing_details", f"SELECT p_partkey, title_matched, is_match FROM {_MATCHES} m")
def e1(spark, sf):
    return slice_matches(spark, sf).select("p_partkey", "title_matched", "is_match")


@query("e2_hint_lookup", "SELECT p_partkey, 'site' || p_size AS site FROM part WHERE p_brand IN ('Brand#1', 'Brand#2')")
def e2(spark, sf):
    p = table(spark, sf, "part")
    hints = p.where("p_brand in ('Brand#1', 'Brand#2')").select("p_brand").distinct()
    return B.with_hint(p, hints, "p_brand").select("p_partkey", F.concat(F.lit("site"), "p_size").alias("site"))


_E7 = "(SELECT s_suppkey AS seq, s_nationkey IN (1, 2, 3) AS negative, s_acctbal < 2000 AS cached FROM supplier)"


@query("e7_target_selection", f"SELECT seq, status FROM (SELECT seq, CASE WHEN NOT negative AND NOT cached THEN 'selected' WHEN negative THEN 'Skipped (known negative)' ELSE 'Skipped (already searched)' END AS status, sum((NOT negative AND NOT cached)::INT) OVER (ORDER BY seq) AS run FROM {_E7} t) WHERE (status = 'selected' AND run <= 40) OR (status <> 'selected' AND run < 40)")
def e7(spark, sf):
    c = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("seq"), F.col("s_nationkey").isin(1, 2, 3).alias("negative"), (F.col("s_acctbal") < 2000).alias("cached"))
    return B.select_targets(c, 40).select("seq", "status")


@query("e8_partitioned_targets", "SELECT c_custkey AS k, c_custkey % 2 = 0 AND c_nationkey < 5 AS direct FROM customer")
def e8(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    direct, rest = B.partition_targets(c, c.where("k % 2 = 0"), c.where("c_nationkey < 5"), "k")
    return direct.select("k", F.lit(True).alias("direct")).union(rest.select("k", F.lit(False)))


_OUT = "(SELECT o_custkey AS k, CASE WHEN o_orderpriority < '3' THEN 1 ELSE 2 END AS provider, bool_or(o_orderstatus = 'F') AS matched, count(*) AS jobs FROM orders GROUP BY ALL)"


def _outcomes(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k"), F.when(F.col("o_orderpriority") < "3", 1).otherwise(2).alias("provider")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("matched"), F.count("*").alias("jobs"))


@query("e9_waterfall_targets", f"SELECT c_custkey AS k FROM customer WHERE c_nationkey % 2 = 0 AND c_custkey NOT IN (SELECT k FROM (SELECT k, arg_max(matched, provider) AS m FROM {_OUT} o GROUP BY 1) WHERE m)")
def e9(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    return B.waterfall_targets(c.select("k"), c.where("c_nationkey % 2 = 0"), _outcomes(spark, sf), "k")


@query("g6_waterfall_override", f"SELECT k, max(provider) AS provider, arg_max(jobs, provider) AS jobs FROM {_OUT} o GROUP BY 1")
def g6(spark, sf):
    out = _outcomes(spark, sf)
    final, jobs = B.waterfall_override(out.select("k", "provider", "matched"), out.select("k", "provider", "jobs"), "k")
    return final.join(jobs, ["k", "provider"]).select("k", "provider", "jobs")


@query("h10_first_success", "WITH a AS (SELECT user_id AS k, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), s AS (SELECT k, min(event_id) AS stop FROM a WHERE event_type IN ('purchase', 'error') GROUP BY 1), e AS (SELECT k, max(event_id) AS last FROM a WHERE event_type = 'signup' GROUP BY 1) SELECT t.k, CASE WHEN x.event_type = 'purchase' THEN 'b' || s.stop WHEN x.event_type IS NULL AND e.last IS NOT NULL THEN 'b' || e.last END AS board, CASE WHEN x.event_type = 'purchase' THEN 'ok' WHEN x.event_type = 'error' THEN 'HTTP 500' WHEN e.last IS NOT NULL THEN 'No open jobs' ELSE 'Greenhouse board not found' END AS status FROM (SELECT DISTINCT k FROM a) t LEFT JOIN s USING (k) LEFT JOIN events x ON x.event_id = s.stop LEFT JOIN e ON e.k = t.k")
def h10(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("attempt_no"), F.concat(F.lit("b"), "event_id").alias("board"), F.expr("CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'signup' THEN 'ok' WHEN 'error' THEN 'HTTP 500' ELSE 'not_found' END").alias("outcome"), F.when(F.col("event_type") == "purchase", 3).otherwise(0).alias("jobs"))
    return B.first_success(e, "k")


_CHAIN = """WITH a AS (SELECT user_id AS k, event_id, event_type, user_id % 40 AS brand FROM events),
s AS (SELECT k, min(event_id) AS stop FROM a WHERE event_type IN ('purchase', 'error') GROUP BY 1),
r AS (SELECT t.k, x.event_type AS how, EXISTS (SELECT 1 FROM a z WHERE z.k = t.k AND z.event_type = 'signup') AS empty FROM (SELECT DISTINCT k FROM a) t LEFT JOIN s USING (k) LEFT JOIN events x ON x.event_id = s.stop),
b AS (SELECT 'Brand#' || (c_custkey % 40) AS board, c_custkey AS k FROM customer)
SELECT b.k, CASE WHEN r.k IS NULL THEN 'No slug candidates' WHEN r.how = 'purchase' THEN coalesce(m.status, 'No open jobs') WHEN r.how = 'error' THEN CASE WHEN b.k % 2 = 0 THEN 'HTTP 500' ELSE 'Network error: timed out' END WHEN r.empty THEN 'No open jobs' ELSE 'Greenhouse board not found' END AS status,
CASE WHEN r.how = 'purchase' THEN coalesce(m.jobs_seen, 0) ELSE 0 END AS jobs_seen,
CASE WHEN r.how = 'error' AND b.k % 2 = 1 THEN 'needs_retry' WHEN r.k IS NOT NULL AND r.how IS NULL AND NOT r.empty THEN 'not_found' ELSE 'confirmed' END AS board1
FROM b LEFT JOIN r USING (k) LEFT JOIN (SELECT * FROM """ + _ASSESS + """ q) m ON m.p_brand = b.board"""


@query("f2_status_chain", _CHAIN)
def f2_chain(spark, sf):
    """Attempts to a resolved board, its assessment, the status text and what the registry makes of it."""
    e = table(spark, sf, "events")
    outcome = F.expr("CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'signup' THEN 'ok' WHEN 'error' THEN CASE WHEN user_id % 2 = 0 THEN 'HTTP 500' ELSE 'Network error: timed out' END ELSE 'not_found' END")
    attempts = e.select(F.col("user_id").alias("k"), F.col("event_id").alias("attempt_no"), F.concat(F.lit("Brand#"), F.col("user_id") % 40).alias("board"), outcome.alias("outcome"), F.when(F.col("event_type") == "purchase", 3).otherwise(0).alias("jobs"))
    targets = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    assessed = B.assess(slice_matches(spark, sf), "p_brand").withColumnRenamed("p_brand", "board")
    out = B.board_statuses(targets, B.first_success(attempts, "k"), assessed, "k")
    return out.select("k", "status", "jobs_seen", R.provider_status("status", "board1").alias("board1"))


@query("e7_explicit_list", "SELECT k, min(seq) AS seq FROM (SELECT s_nationkey AS k, s_suppkey AS seq FROM supplier ORDER BY s_suppkey LIMIT 40) GROUP BY 1")
def e7_explicit(spark, sf):
    return B.explicit_targets(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("seq")), 40, "k")


@query("l1_slug_candidates", "SELECT s_suppkey, array_to_string(list_filter([CASE WHEN s_suppkey % 2 = 0 THEN 'hinted' END, 'acme' || s_suppkey || 'labs', 'acme-' || s_suppkey || '-labs', 'acme_' || s_suppkey || '_labs', 'acme', 'acmelabs', 'acme-labs'], lambda x: x IS NOT NULL), '|') AS slugs FROM supplier")
def l1(spark, sf):
    hints = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("-hinted_")))
    return table(spark, sf, "supplier").select("s_suppkey", F.array_join(B.slug_candidates(F.concat(F.lit("Acme "), "s_suppkey", F.lit(" Labs!")), hints), "|").alias("slugs"))


@query("l2_tenants_and_sites", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'acme' || s_suppkey || '|acme|' || s_suppkey ELSE 'n' || s_suppkey END AS tenants, CASE WHEN s_suppkey % 2 = 0 THEN 'AcmeX' ELSE 'N' END AS head, CASE WHEN s_suppkey % 2 = 0 THEN 15 ELSE 11 END AS n_sites FROM supplier")
def l2(spark, sf):
    name = F.expr("CASE WHEN s_suppkey % 2 = 0 THEN 'Acme ' || s_suppkey || ' Group' ELSE 'N' || s_suppkey || ' Inc' END")
    s = table(spark, sf, "supplier").select("s_suppkey", B.tenant_candidates(name).alias("t"), B.site_candidates(name).alias("s"))
    return s.select("s_suppkey", F.array_join("t", "|").alias("tenants"), F.when(F.col("s_suppkey") % 2 == 0, "AcmeX").otherwise("N").alias("head"), F.size("s").alias("n_sites"))


@query("l3_board_candidates", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 3 * 5 * 15 * 3 ELSE 5 * 11 * 3 END AS urls, CASE WHEN s_suppkey % 2 = 0 THEN 3 * 5 * 15 ELSE 5 * 11 END AS probes FROM supplier")
def l3(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.expr("CASE WHEN s_suppkey % 2 = 0 THEN 'Acme ' || s_suppkey || ' Group' ELSE 'N' || s_suppkey || ' Inc' END").alias("name"))
    return B.board_candidates(s, "s_suppkey", "name").groupBy("s_suppkey").agg(F.count("*").cast("int").alias("urls"), F.count_if(F.col("order.f") == 0).cast("int").alias("probes"))


@query("l4_discovery_verdict", "WITH h AS (SELECT user_id AS k, min(event_id) AS i FROM events WHERE event_type IN ('purchase', 'error') AND event_id % 5 = 0 GROUP BY 1) SELECT u.k, CASE WHEN h.i IS NULL THEN 'not_found' WHEN e.event_type = 'purchase' THEN 'confirmed' ELSE 'needs_retry' END AS outcome, CASE WHEN e.event_type = 'purchase' THEN 'https://b/' || h.i ELSE '' END AS board_url FROM (SELECT DISTINCT user_id AS k FROM events) u LEFT JOIN h USING (k) LEFT JOIN events e ON e.event_id = h.i")
def l4(spark, sf):
    p = table(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("candidate_order"), F.expr("CASE WHEN event_id % 5 = 0 AND event_type = 'purchase' THEN 'confirmed' WHEN event_id % 5 = 0 AND event_type = 'error' THEN 'error' ELSE 'not_found' END").alias("outcome"), F.concat(F.lit("https://b/"), "event_id").alias("board_url"))
    return B.discovery_verdict(p, "k")


_GROUPS = """WITH p AS (SELECT user_id % 50 AS k, event_id // 40 AS g, event_id AS f, CASE event_type WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'confirmed' ELSE 'malformed' END WHEN 'error' THEN CASE WHEN event_id % 7 = 0 THEN 'error' ELSE 'not_found' END ELSE 'not_found' END AS o, value > 40 AS up FROM events),
h AS (SELECT k, g, min(f) AS f0, min(CASE WHEN up THEN f END) AS f1 FROM p GROUP BY ALL),
e AS (SELECT h.*, p.o, row_number() OVER (PARTITION BY h.k ORDER BY h.g) AS n FROM h JOIN p ON p.k = h.k AND p.g = h.g AND p.f = h.f0 WHERE p.o IN ('confirmed', 'error'))
SELECT u.k, coalesce(e.o, 'not_found') AS outcome, CASE WHEN e.o = 'confirmed' THEN 'https://b/' || coalesce(e.f1, e.f0) ELSE '' END AS board_url, CASE WHEN e.o = 'confirmed' THEN 't' || e.f0 ELSE '' END AS tenant, CASE WHEN e.o = 'confirmed' THEN 's' || e.g ELSE '' END AS site_id
FROM (SELECT DISTINCT k FROM p) u LEFT JOIN e ON e.k = u.k AND e.n = 1"""


def _probe_groups(spark, sf):
    outcome = F.expr("CASE event_type WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'confirmed' ELSE 'malformed' END WHEN 'error' THEN CASE WHEN event_id % 7 = 0 THEN 'error' ELSE 'not_found' END ELSE 'not_found' END")
    e = table(spark, sf, "events").select((F.col("user_id") % 50).alias("k"), F.floor(F.col("event_id") / 40).alias("group_no"), F.col("event_id").alias("form_no"), outcome.alias("outcome"), (F.col("value") > 40).alias("reachable"), F.concat(F.lit("https://b/"), "event_id").alias("board_url"))
    return e.select("*", F.concat(F.lit("t"), "form_no").alias("tenant"), F.concat(F.lit("s"), "group_no").alias("site_id"))


@query("l4_probe_groups", _GROUPS)
def l4_groups(spark, sf):
    """Probe groups in order: the first form decides, the address is the first reachable form's."""
    return B.grouped_verdict(_probe_groups(spark, sf), "k")


@query("f4_discovery_counts", "SELECT count_if(event_type = 'purchase') AS confirmed, count_if(event_type = 'view') AS not_found, count_if(event_type = 'error') AS needs_retry FROM events")
def f4(spark, sf):
    t = F.col("event_type")
    return reports.counts_by(table(spark, sf, "events"), {"confirmed": t == "purchase", "not_found": t == "view", "needs_retry": t == "error"})


@query("n4_discovery_report", "SELECT event_type AS section, user_id::VARCHAR AS entry FROM (SELECT DISTINCT event_type, user_id FROM events WHERE event_type IN ('purchase', 'error'))")
def n4(spark, sf):
    e = table(spark, sf, "events").select("event_type", "user_id").distinct()
    return reports.section(e.where("event_type = 'purchase'"), "purchase", F.col("user_id").cast("string")).union(reports.section(e.where("event_type = 'error'"), "error", F.col("user_id").cast("string")))


@query("f9_run_results", f"SELECT p_brand AS company, '-' AS slug, jobs_seen, matched_job_count, status FROM {_ASSESS} a UNION ALL SELECT n_name, lower(n_name), 0, 0, 'Skipped (already searched)' FROM nation")
def f9(spark, sf):
    done = slice_assessment(spark, sf).select(F.col("p_brand").alias("company"), F.lit("-").alias("slug"), "jobs_seen", "matched_job_count", "status")
    zero = F.lit(0).cast("long")
    skipped = table(spark, sf, "nation").select(F.col("n_name").alias("company"), F.lower("n_name").alias("slug"), zero.alias("jobs_seen"), zero.alias("matched_job_count"), F.lit("Skipped (already searched)").alias("status"))
    return done.unionByName(skipped)


@query("i1_report_order", "SELECT c_mktsegment, c_name, row_number() OVER (PARTITION BY c_mktsegment ORDER BY lower(c_name)) AS place FROM customer")
def i1(spark, sf):
    from pyspark.sql import Window

    return table(spark, sf, "customer").select("c_mktsegment", "c_name", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.lower("c_name"))).cast("long").alias("place"))


@query("j1_key_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation")
def j1(spark, sf):
    keys = [table(spark, sf, t).select(F.col(c).alias("k")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey"))]
    return keys[0].unionByName(keys[1]).unionByName(keys[2]).distinct()


@query("n5_matched_jobs", f"SELECT p_brand || ': ' || p_name AS line, 'https://jobs/' || p_partkey AS url FROM {_MATCHES} m WHERE is_match")
def n5(spark, sf):
    return slice_matches(spark, sf).where("is_match").select(F.concat("p_brand", F.lit(": "), "p_name").alias("line"), F.concat(F.lit("https://jobs/"), "p_partkey").alias("url"))


_CHECK = "CASE WHEN o_orderpriority LIKE '1%' THEN 'Greenhouse board not found' WHEN o_orderpriority LIKE '2%' THEN 'Network error: x' WHEN o_orderpriority LIKE '3%' THEN 'Skipped (x)' WHEN o_orderpriority LIKE '4%' THEN 'HTTP 500' ELSE '' END"


@query("d20_check_status", "SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 'not_found' WHEN '2' THEN 'needs_retry' WHEN '3' THEN 'unknown' ELSE 'confirmed' END AS board1, CASE left(o_orderpriority, 1) WHEN '2' THEN 'needs_retry' WHEN '3' THEN 'unknown' ELSE 'confirmed' END AS board2 FROM orders")
def d20(spark, sf):
    o = table(spark, sf, "orders").withColumn("s", F.expr(_CHECK))
    return o.select("o_orderkey", R.provider_status("s", "board1").alias("board1"), R.provider_status("s", "board2").alias("board2"))


_ST = "CASE {x} % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'not_found' WHEN 2 THEN 'unknown' ELSE 'needs_retry' END"
_STATUSES = f"(SELECT o_orderkey, o_custkey, o_orderdate, {_ST.format(x='(o_orderkey // 3)')} AS b1, {_ST.format(x='(o_custkey // 2)')} AS b2, {_ST.format(x='(o_orderkey + o_custkey)')} AS ot, o_orderstatus = 'F' AS rv FROM orders)"
_PRIMARY = "CASE WHEN b1 = 'confirmed' THEN 'board1' WHEN b2 = 'confirmed' THEN 'board2' WHEN ot = 'confirmed' THEN 'other' WHEN b1 = 'not_found' AND b2 = 'not_found' THEN 'none' ELSE 'unknown' END"
_ACTION = "CASE WHEN b1 = 'confirmed' THEN 'no_action' WHEN b2 = 'confirmed' THEN 'review_board2' WHEN ot = 'confirmed' THEN 'review_other' WHEN b1 = 'not_found' AND b2 = 'unknown' THEN 'check_board2' WHEN rv THEN 'check_other' ELSE 'no_action' END"
_BUCKET = "CASE WHEN b1 = 'confirmed' THEN 'confirmed_board1' WHEN b2 = 'confirmed' THEN 'confirmed_board2' WHEN ot = 'confirmed' THEN 'confirmed_other' WHEN b1 = 'not_found' AND b2 = 'unknown' THEN 'board1_not_found_board2_unchecked' WHEN b1 = 'not_found' AND b2 = 'not_found' THEN 'neither_confirmed' ELSE 'unknown' END"


def _statuses(spark, sf):
    s = lambda x: F.expr(_ST.format(x=x))
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", s("(o_orderkey div 3)").alias("board1_status"), s("(o_custkey div 2)").alias("board2_status"), s("(o_orderkey + o_custkey)").alias("other_status"), (F.col("o_orderstatus") == "F").alias("has_revisit"))


@query("d21_registry_decision", f'SELECT o_orderkey, {_PRIMARY} AS "primary", {_ACTION} AS next_action FROM {_STATUSES} s')
def d21(spark, sf):
    return R.decide(_statuses(spark, sf)).select("o_orderkey", "primary", "next_action")


@query("d22_registry_bucket", f"SELECT o_orderkey, {_BUCKET} AS bucket FROM {_STATUSES} s")
def d22(spark, sf):
    return _statuses(spark, sf).select("o_orderkey", R.bucket().alias("bucket"))


@query("f3_bucket_counts", f"SELECT {_BUCKET} AS bucket, count(*) AS n FROM {_STATUSES} s GROUP BY 1")
def f3(spark, sf):
    return _statuses(spark, sf).groupBy(R.bucket().alias("bucket")).agg(F.count("*").alias("n"))


_H9 = f"SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS last_overall_check FROM {_STATUSES} s WHERE {_ACTION} = 'check_board2' ORDER BY 2, lower('Order ' || lpad(o_orderkey::VARCHAR, 12, '0')) LIMIT 25"


@query("h9_review_queue", _H9)
def h9(spark, sf):
    reg = R.decide(_statuses(spark, sf)).withColumn("company_name", F.concat(F.lit("Order "), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))).withColumn("last_overall_check", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return R.review_queue(reg, "check_board2", 25).select("o_orderkey", "last_overall_check")


@query("n2_registry_report", f"SELECT 'bucket ' || {_BUCKET} AS section, count(*)::VARCHAR AS entry FROM {_STATUSES} s GROUP BY 1 UNION ALL SELECT 'queue', o_orderkey::VARCHAR FROM ({_H9}) q")
def n2(spark, sf):
    counts = f3(spark, sf).select(F.concat(F.lit("bucket "), "bucket").alias("section"), F.col("n").cast("string").alias("entry"))
    return counts.unionByName(reports.section(h9(spark, sf), "queue", F.col("o_orderkey").cast("string")))


@query("e11_intake_list", "SELECT n_name, coalesce(c.n, 0) AS records, c.n IS NULL AS missing FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey")
def e11(spark, sf):
    reg = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return table(spark, sf, "nation").join(reg, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("n_name", F.coalesce("n", F.lit(0)).alias("records"), F.col("n").isNull().alias("missing"))


@query("f10_intake_counts", f"SELECT count_if(b1 = 'confirmed') AS board1, count_if(b1 <> 'confirmed' AND b2 = 'confirmed') AS board2, count_if({_ACTION} = 'check_board2') AS queue, count_if({_PRIMARY} = 'other') AS other FROM {_STATUSES} s")
def f10(spark, sf):
    d = R.decide(_statuses(spark, sf))
    return reports.counts_by(d, {"board1": F.col("primary") == "board1", "board2": F.col("primary") == "board2", "queue": F.col("next_action") == "check_board2", "other": F.col("primary") == "other"})


@query("n3_intake_report", f"SELECT 'missing' AS section, n_name AS entry FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer) UNION ALL SELECT 'queue', o_orderkey::VARCHAR FROM ({_H9}) q")
def n3(spark, sf):
    return reports.section(e11(spark, sf).where("missing"), "missing", F.col("n_name")).union(reports.section(h9(spark, sf), "queue", F.col("o_orderkey").cast("string")))


@query("e6_registry_build", f"""
WITH a AS (SELECT c_nationkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'board1' WHEN 1 THEN 'board2' ELSE 'other' END AS provider, arg_max(CASE c_mktsegment WHEN 'MACHINERY' THEN 'Network error' WHEN 'BUILDING' THEN 'Skipped' WHEN 'HOUSEHOLD' THEN 'Greenhouse board not found' ELSE 'fine' END, c_custkey) AS status, arg_max(c_name, c_custkey) AS name FROM customer WHERE c_nationkey % 2 = 0 GROUP BY ALL),
s AS (SELECT s_nationkey AS k, arg_max(s_name, s_suppkey) AS name, CASE WHEN s_nationkey % 3 = 0 THEN 'board2' ELSE 'board1' END AS source, 'Workday board not configured' AS status, '1998-0' || (s_nationkey % 9 + 1) || '-01' AS d FROM supplier WHERE s_nationkey % 5 <> 0 GROUP BY s_nationkey),
n AS (SELECT n_nationkey AS k, n_name AS name FROM nation),
j AS (SELECT n.k, n.name, s.name AS sn, s.source, s.status AS ss, s.d, s.k IS NOT NULL AS in_s,
  (SELECT status FROM a WHERE a.k = n.k AND provider = 'board1') AS a1, (SELECT status FROM a WHERE a.k = n.k AND provider = 'board2') AS a2, (SELECT status FROM a WHERE a.k = n.k AND provider = 'other') AS a3,
  (SELECT name FROM a WHERE a.k = n.k AND provider = 'board1') AS n1, (SELECT name FROM a WHERE a.k = n.k AND provider = 'board2') AS n2, (SELECT name FROM a WHERE a.k = n.k AND provider = 'other') AS n3
  FROM n LEFT JOIN s ON s.k = n.k),
v AS (SELECT k, coalesce(n3, n2, n1, sn, CASE WHEN k % 4 = 0 THEN 'rev' || k END, CASE WHEN k % 7 = 1 THEN name END, k::VARCHAR) AS company_name,
  CASE WHEN a1 IS NOT NULL THEN CASE a1 WHEN 'Greenhouse board not found' THEN 'not_found' WHEN 'Network error' THEN 'needs_retry' WHEN 'Skipped' THEN 'unknown' ELSE 'confirmed' END WHEN in_s AND source = 'board1' THEN 'confirmed' WHEN k % 7 = 1 THEN 'not_found' ELSE 'unknown' END AS b1,
  CASE WHEN a2 IS NOT NULL THEN CASE a2 WHEN 'Network error' THEN 'needs_retry' WHEN 'Skipped' THEN 'unknown' ELSE 'confirmed' END ELSE 'unknown' END AS b2,
  CASE WHEN a3 IS NOT NULL THEN CASE a3 WHEN 'Network error' THEN 'needs_retry' WHEN 'Skipped' THEN 'unknown' ELSE 'confirmed' END ELSE 'unknown' END AS ot,
  CASE WHEN d IS NOT NULL THEN d WHEN coalesce(a1, a2, a3) IS NOT NULL THEN '{RUN}' ELSE '' END AS last_overall_check, k % 4 = 0 AS rv FROM j)
SELECT k, company_name, b1 AS board1_status, b2 AS board2_status, ot AS other_status, last_overall_check, rv AS has_revisit, {_PRIMARY} AS "primary", {_ACTION} AS next_action FROM v""")
def e6(spark, sf):
    c, s, n = table(spark, sf, "customer"), table(spark, sf, "supplier"), table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("company_name"))
    none = F.lit(None).cast("string")
    existing = n.where("false").select("k", "company_name", none.alias("board1_status"), none.alias("board2_status"), none.alias("other_status"), none.alias("last_overall_check"))
    # rows without a usable key are the operator's to leave out
    search = s.groupBy(F.when(F.col("s_nationkey") % 5 != 0, F.col("s_nationkey")).alias("k")).agg(F.max_by("s_name", "s_suppkey").alias("company_name"))
    search = search.select("k", "company_name", F.when(F.col("k") % 3 == 0, "board2").otherwise("board1").alias("source"), F.lit("Workday board not configured").alias("status"), F.concat(F.lit("1998-0"), F.col("k") % 9 + 1, F.lit("-01")).alias("last_scraped"))
    revisits = n.where("k % 4 = 0").select("k", F.concat(F.lit("rev"), "k").alias("company_name"))
    a = c.select(F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey")).alias("k"), F.expr("CASE c_custkey % 3 WHEN 0 THEN 'board1' WHEN 1 THEN 'board2' ELSE 'other' END").alias("provider"), F.expr("CASE c_mktsegment WHEN 'MACHINERY' THEN 'Network error' WHEN 'BUILDING' THEN 'Skipped' WHEN 'HOUSEHOLD' THEN 'Greenhouse board not found' ELSE 'fine' END").alias("status"), F.col("c_name").alias("company_name"), F.col("c_custkey").alias("seq"))
    return R.build(existing, search, n.where("k % 7 = 1"), revisits, n, n.select("k").where("k < 3"), a, "k", RUN)


@query("f2_board_status", f"SELECT status, count(*) AS boards, sum(matched_job_count)::BIGINT AS jobs FROM {_ASSESS} a GROUP BY 1")
def f2(spark, sf):
    return slice_assessment(spark, sf).groupBy("status").agg(F.count("*").alias("boards"), F.sum("matched_job_count").alias("jobs"))


@query("b5_company_key", f"SELECT c_custkey, {S.fingerprint(S.variants('c_mktsegment', 'c_custkey'))} AS company_key FROM customer")
def b5(spark, sf):
    return B.named(table(spark, sf, "customer").select("c_custkey", F.expr(S.variants("c_mktsegment", "c_custkey")).alias("name")), "name").select("c_custkey", "company_key")
