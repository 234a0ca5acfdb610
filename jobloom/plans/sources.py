"""Scans, hint tables, payloads and table sizes over conversations, nation, orders and part."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import jsonl, office, payloads
from ..sources.scratch import shared_folder
from . import query, table

TURN = "conv_id bigint, turn bigint, role string, text string"


def _lines(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    good = jsonl.canonical_lines(c)
    return good.unionAll(c.select(F.expr("CASE turn % 4 WHEN 0 THEN '  ' WHEN 1 THEN '{broken' WHEN 2 THEN '[1, 2]' ELSE '7' END").alias("value")))


@query("a1_tolerant_scan", "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def a1(spark, sf):
    return jsonl.parse_tolerant(_lines(spark, sf), TURN).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("a1_reject_counts", "SELECT count(*) AS taken, count_if(turn % 4 = 0) AS blank, count_if(turn % 4 <> 0) AS rejected FROM conversations")
def a1_rejects(spark, sf):
    return jsonl.count_rejects(_lines(spark, sf))


@query("a2_strict_scan", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1")
def a2(spark, sf):
    """All turns as canonical lines in the shared folder, scanned strictly."""
    path = f"{shared_folder(spark)}/turns-{uuid.uuid4().hex}"
    jsonl.write_canonical(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), path, ["conv_id", "turn"])
    return jsonl.scan_strict(spark, path, TURN).groupBy("conv_id").agg(F.count("*").alias("n"))


@query("a3_canonical_lines", """SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS value FROM nation""")
def a3(spark, sf):
    """The canonical sink, read back line by line."""
    path = f"{shared_folder(spark)}/nations-{uuid.uuid4().hex}"
    jsonl.write_canonical(table(spark, sf, "nation").select("n_regionkey", "n_nationkey", "n_name"), path, ["n_nationkey"])
    return spark.read.text(path)


@query("a4_hint_table", "SELECT 'nation ' || n_nationkey AS company_key, 't' || n_nationkey AS tenant, 'last' AS site_id FROM nation WHERE n_nationkey % 4 <> 0")
def a4(spark, sf):
    n = table(spark, sf, "nation")
    entry = lambda site: F.to_json(F.create_map(F.concat(F.lit("Nation "), "n_nationkey", F.lit(", Inc")), F.struct(F.when(F.col("n_nationkey") % 4 != 0, F.concat(F.lit("t"), "n_nationkey")).otherwise(" ").alias("tenant"), F.lit(site).alias("site_id")))).alias("value")
    docs = n.select(F.lit(1).alias("seq"), entry("first")).union(n.select(F.lit(2), entry("last")))
    return jsonl.hints_from_json(docs, "tenant string, site_id string", ["tenant", "site_id"])


def _pages(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("title")))).alias("jobs"))
    kind = F.expr("CASE o_custkey % 3 WHEN 0 THEN 'jobs' WHEN 1 THEN 'postings' ELSE 'embedded' END").alias("kind")
    n = F.size("jobs")
    body = F.when(F.col("o_custkey") % 3 == 0, F.to_json(F.struct("jobs"))).when(F.col("o_custkey") % 3 == 1, F.to_json(F.struct((n * 2).alias("total"), F.col("jobs").alias("jobPostings"))))
    body = body.otherwise(F.to_json(F.struct(F.struct(n.alias("totalHits"), F.struct("jobs").alias("data")).alias("eagerLoadRefineSearch"), F.struct(F.struct(F.lit("5").alias("size")).alias("data")).alias("siteConfig"))))
    return o.select("o_custkey", kind, body.alias("payload"))


@query("a7_listing_rows", "SELECT o_custkey, o_orderkey AS id, o_orderstatus AS title FROM orders")
def a7(spark, sf):
    rows = payloads.listing_rows(_pages(spark, sf))
    return rows.select("o_custkey", F.variant_get("job", "$.id", "bigint").alias("id"), F.variant_get("job", "$.title", "string").alias("title"))


@query("c7_page_facts", "SELECT o_custkey, n AS n_rows, CASE WHEN o_custkey % 3 = 1 THEN 2 * n ELSE n END AS total_hits, CASE WHEN o_custkey % 3 = 2 THEN 5 ELSE n END AS page_size FROM (SELECT o_custkey, count(*)::INT AS n FROM orders GROUP BY 1)")
def c7(spark, sf):
    return payloads.page_facts(_pages(spark, sf)).select("o_custkey", "n_rows", "total_hits", "page_size")


@query("c8_missing_pages", "SELECT o_custkey, x AS off FROM (SELECT o_custkey, unnest(range(0, n, 5)) AS x FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)) WHERE x % 10 <> 0")
def c8(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"))
    landed = n.select("o_custkey", "total", F.lit(5).cast("long").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("total"), F.lit(10).cast("long"))).alias("off"))
    return payloads.missing_pages(landed, "o_custkey", "off", "total", "size")


@query("c7_tile_facts", "SELECT o_custkey, n::INT AS n_rows, CASE WHEN o_custkey % 2 = 0 THEN 40 ELSE n::INT END AS total_hits, CASE WHEN n = 0 THEN 12 ELSE n::INT END AS page_size FROM (SELECT o_custkey, count_if(o_orderstatus = 'F') AS n FROM orders GROUP BY 1)")
def c7_tiles(spark, sf):
    """Tile listings: the count that the page states, and a page size of 12 where no tile is shown."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("tiles"))
    return payloads.tile_facts(o.withColumn("hits", F.when(F.col("o_custkey") % 2 == 0, 40)), "tiles", "hits").select("o_custkey", "n_rows", "total_hits", "page_size")


_SHORT = "WITH p AS (SELECT o_custkey AS k, 20 * (o_orderkey % 9) AS off, min(CASE WHEN o_orderkey % 5 = 0 THEN 7 ELSE 20 END) AS n FROM orders GROUP BY ALL), e AS (SELECT k, min(CASE WHEN n < 20 THEN off END) AS short, max(off) AS top FROM p GROUP BY 1), w AS (SELECT k, unnest(range(0, coalesce(short, top + 20) + 1, 20)) AS off FROM e) SELECT k, off, 'missing' AS state FROM w WHERE (k, off) NOT IN (SELECT (k, off) FROM p) UNION ALL SELECT p.k, p.off, 'beyond' FROM p JOIN e USING (k) WHERE p.off > e.short"


@query("c8_short_page_gaps", _SHORT)
def c8_short(spark, sf):
    """Paging by offset: pages missing before the first short page, and pages that landed after it."""
    p = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k"), (20 * (F.col("o_orderkey") % 9)).alias("off")).agg(F.min(F.when(F.col("o_orderkey") % 5 == 0, 7).otherwise(20)).alias("n"))
    return payloads.short_page_gaps(p, "k", "off", "n")


@query("c10_detail_records", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'ID' || p_partkey WHEN 1 THEN 'R-' || p_size ELSE 'x' || p_partkey END AS job_id, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_name END AS title, 'u' || p_partkey AS url FROM part")
def c10(spark, sf):
    rec = payloads.detail_record(F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'ID' || p_partkey END"), F.expr("CASE WHEN p_partkey % 3 = 1 THEN array('R-' || p_size) ELSE array() END").cast("array<string>"), F.expr("'/job/x' || p_partkey || '/'"), "p_name", F.expr("CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE ' ' END"), F.expr("'u' || p_partkey"), F.lit(""))
    return table(spark, sf, "part").select("p_partkey", rec.alias("r")).select("p_partkey", "r.*")


@query("a9_table_sizes", "SELECT 'nation' AS name, count(*) AS rows FROM nation UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'conversations', count(*) FROM conversations")
def a9(spark, sf):
    return jsonl.table_sizes({t: table(spark, sf, t) for t in ("nation", "orders", "conversations")})


@query("a8_office_documents", r"SELECT 'doc' || doc_id AS source_file, idx, md5(t) AS digest FROM (SELECT doc_id, (unnest(range(0, len(string_split(text, chr(10))))))::INT AS idx, trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g')) AS t FROM documents) WHERE t <> ''")
def a8(spark, sf):
    docs = table(spark, sf, "documents").where(F.trim("text") != "").select(F.concat(F.lit("doc"), "doc_id").alias("path"), "text")
    p = office.parse_files(office.build_files(docs))
    return p.select("source_file", "idx", F.md5("text").alias("digest"))
