"""Text normalisation, keys and first- or last-wins lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import overlays as O
from . import query, sqlparts as S, table


@query("b1_clean_text", f"SELECT doc_id, length({S.clean('text')}) AS n, md5({S.clean('text')}) AS digest FROM documents")
def b1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean("text").alias("c")).select("doc_id", F.length("c").cast("long").alias("n"), F.md5("c").alias("digest"))


@query("b2_match_text", f"SELECT doc_id, length({S.match('text')}) AS n, md5({S.match('text')}) AS digest FROM documents")
def b2(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.match_text("text").alias("c")).select("doc_id", F.length("c").cast("long").alias("n"), F.md5("c").alias("digest"))


@query("b3_company_fingerprint", f"SELECT s_suppkey, {S.fingerprint(S.variants('s_name', 's_suppkey'))} AS fp, replace({S.fingerprint(S.variants('s_name', 's_suppkey'))}, ' ', '') AS compact FROM supplier")
def b3(spark, sf):
    name = F.expr(S.variants("s_name", "s_suppkey"))
    return table(spark, sf, "supplier").select("s_suppkey", T.company_fingerprint(name).alias("fp"), T.compact_key(name).alias("compact"))


_B4 = f"SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'Vendor ' || s_suppkey ELSE {S.clean(S.variants('s_name', 's_suppkey'))} END AS canonical_name FROM supplier"


@query("b4_canonical_name", _B4)
@query("b4_canonical_name_all", _B4)
def b4(spark, sf):
    """All suppliers, those without a name of their own too; registered under both of its names."""
    s = table(spark, sf, "supplier").withColumn("name", F.expr(S.variants("s_name", "s_suppkey")))
    aliases = s.where("s_suppkey % 3 = 0").select(T.company_fingerprint("name").alias("fingerprint"), F.concat(F.lit("Vendor "), F.col("s_suppkey")).alias("canonical"))
    return T.canonical_name(s, "name", aliases).select("s_suppkey", "canonical_name")


@query("b6_job_ids", f"SELECT p_partkey, p_partkey::VARCHAR AS from_integer, {S.clean(chr(39) + ' ' + chr(39) + ' || p_brand')} AS from_text FROM part")
def b6(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.job_id_text("p_partkey", True).alias("from_integer"), T.job_id_text(F.concat(F.lit(" "), "p_brand")).alias("from_text"))


@query("b7_slugs", f"SELECT p_partkey, {S.slug(chr(39) + '--' + chr(39) + ' || p_name || p_brand')} AS slug, upper(p_name[1:1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1:1]) || split_part(p_name, ' ', 2)[2:] AS title FROM part")
def b7(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.slug(F.concat(F.lit("--"), "p_name", "p_brand")).alias("slug"), T.title_from_slug(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("title"))


@query("b8_summaries", f"SELECT doc_id, md5({S.summary('text', 20)}) AS s20, md5({S.summary('text', 80)}) AS s80 FROM documents")
def b8(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.summary("text", 20)).alias("s20"), F.md5(T.summary("text", 80)).alias("s80"))


@query("b9_tokens", f"SELECT doc_id, len(t) AS n, md5(array_to_string(list_sort(t), ' ')) AS digest FROM (SELECT doc_id, list_filter(list_distinct(string_split({S.match('text')}, ' ')), lambda w: length(w) >= 3 AND w NOT IN ('the', 'and', 'for')) AS t FROM documents)")
def b9(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", T.tokens("text", ("the", "and", "for")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("digest"))


_DAY_SPARK = "CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN '' WHEN 2 THEN '2026-5-1' WHEN 3 THEN '2026-02-30' ELSE 'soon' END"


@query("b10_iso_dates", f"SELECT d IS NOT NULL AS good, count(*) AS n, min(d)::VARCHAR AS first, max(d)::VARCHAR AS last FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate::DATE END AS d FROM orders) GROUP BY 1")
def b10(spark, sf):
    d = table(spark, sf, "orders").select(T.iso_date(F.expr(_DAY_SPARK)).alias("d"))
    return d.groupBy(F.col("d").isNotNull().alias("good")).agg(F.count("*").alias("n"), F.min("d").cast("string").alias("first"), F.max("d").cast("string").alias("last"))


@query("b11_dates_and_numbers", r"SELECT doc_id, array_to_string(regexp_extract_all(text, '(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)\s+\d{4}|(?:19|20)\d{2}'), '|') AS dates, regexp_matches(text, '\b\d') AS quantified FROM documents")
def b11(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.dates_mentioned("text"), "|").alias("dates"), T.is_quantified("text").alias("quantified"))


@query("b12_ordered_distinct", "SELECT l_orderkey, string_agg(l_returnflag, '' ORDER BY n, l_returnflag) AS flags FROM (SELECT l_orderkey, l_returnflag, min(l_linenumber * 1000000 + l_partkey) AS n FROM lineitem GROUP BY ALL) GROUP BY 1")
def b12(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct((F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("n"), "l_returnflag"))).alias("r"))
    return rows.select("l_orderkey", F.array_join(F.array_distinct(F.transform("r", lambda x: x["l_returnflag"])), "").alias("flags"))


@query("b13_labelled_lines", "SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN '' ELSE p_brand END AS label, CASE p_partkey % 4 WHEN 0 THEN ' – ' WHEN 1 THEN ' — ' ELSE ': ' END AS separator, CASE p_partkey % 4 WHEN 3 THEN p_brand || ' ' || p_name ELSE p_name END AS body FROM part")
def b13(spark, sf):
    line = F.expr("p_brand || CASE p_partkey % 4 WHEN 0 THEN ' – ' WHEN 1 THEN ' — ' WHEN 2 THEN ': ' ELSE '  ' END || p_name")
    return table(spark, sf, "part").select("p_partkey", T.labelled_line(line).alias("l")).select("p_partkey", "l.*")



@query("a5_list_first_wins", f"WITH l AS (SELECT seq, {S.clean('line')} AS name, {S.fingerprint('line')} AS company_key FROM (SELECT c_custkey AS seq, CASE WHEN c_custkey % 10 = 0 THEN '# note' WHEN c_custkey % 10 = 1 THEN '  ' ELSE {S.variants('c_mktsegment', 'c_custkey')} END AS line FROM customer)) SELECT company_key, arg_min(name, seq) AS name FROM l WHERE name <> '' AND name NOT LIKE '#%' GROUP BY 1")
def a5(spark, sf):
    from ..sources import lists

    line = F.expr(f"CASE WHEN c_custkey % 10 = 0 THEN '# note' WHEN c_custkey % 10 = 1 THEN '  ' ELSE {S.variants('c_mktsegment', 'c_custkey')} END")
    return lists.first_wins(table(spark, sf, "customer").select(F.col("c_custkey").alias("seq"), line.alias("line")))


@query("a6_list_last_wins", f"SELECT {S.fingerprint('line')} AS company_key, arg_max({S.clean('line')}, seq) AS name FROM (SELECT c_custkey AS seq, {S.variants('c_mktsegment', 'c_custkey')} AS line FROM customer) GROUP BY 1 HAVING company_key <> ''")
def a6(spark, sf):
    from ..sources import lists

    return lists.last_wins(table(spark, sf, "customer").select(F.col("c_custkey").alias("seq"), F.expr(S.variants("c_mktsegment", "c_custkey")).alias("line")))


@query("g2_first_seen", f"SELECT {S.fingerprint('n')} AS company_key, arg_min({S.clean('n')}, k) AS name, count(*) AS seen FROM (SELECT s_suppkey AS k, {S.variants('s_name', 's_suppkey')} AS n FROM supplier UNION ALL SELECT s_suppkey + 1000000000, s_name FROM supplier) GROUP BY 1")
def g2(spark, sf):
    s = table(spark, sf, "supplier")
    rows = s.select(F.col("s_suppkey").alias("seq"), F.expr(S.variants("s_name", "s_suppkey")).alias("name")).union(s.select(F.col("s_suppkey") + 1000000000, "s_name"))
    keyed = rows.select(T.company_fingerprint("name").alias("company_key"), T.clean("name").alias("name"), "seq")
    return O.first_by(keyed, ["company_key"], "seq").select("company_key", "name", "seen")


@query("c11_built_urls", "SELECT p_partkey, 'https://acme.wd5.host.com/wday/cxs/' || replace(p_brand, '#', '%23') || '/' || replace(p_name, ' ', '%20') || '/jobs' AS api, 'https://acme.wd5.host.com/en/jobs/x/job/' || p_partkey AS detail, 'https://acme.wd5.host.com/en/jobs/x/jobs/details/' || p_partkey AS route, 'https://w.host.com/us/job/' || p_partkey || '/' || replace(p_name, ' ', '-') AS page FROM part")
def c11(spark, sf):
    board = F.lit("https://acme.wd5.host.com/en/jobs/x/jobs")
    path = F.concat(F.lit("job/"), F.col("p_partkey"))
    return table(spark, sf, "part").select("p_partkey", U.listing_api_url(board, "p_brand", "p_name").alias("api"), U.detail_url(board, path).alias("detail"), U.detail_route(board, path).alias("route"), U.job_page_url(F.lit("https://w.host.com/us/search-results?from=5"), F.col("p_partkey").cast("string"), "p_name").alias("page"))


@query("c12_normal_urls", r"SELECT CASE WHEN lower(h) LIKE '%.com' THEN lower(h) || rtrim(p, '/') ELSE rtrim(url, '/') END AS normal, count(*) AS n FROM (SELECT url, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)([^?#]*)', 1) AS h, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)([^?#]*)', 2) AS p FROM pages) GROUP BY 1")
def c12(spark, sf):
    return table(spark, sf, "pages").groupBy(U.normal_url("url", ".com").alias("normal")).agg(F.count("*").alias("n"))


@query("c13_board_and_job", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'acme' WHEN 1 THEN 'beta' ELSE 'gamma' END AS board, page_id::VARCHAR AS job_id FROM pages")
def c13(spark, sf):
    url = F.expr("CASE page_id % 3 WHEN 0 THEN 'https://job-boards.x.io/acme/jobs/' || page_id || '?a=1' WHEN 1 THEN 'https://e.x.io/embed?for=beta&token=' || page_id ELSE 'https://www.careers.gamma.com/open?gh_jid=' || page_id END")
    found = table(spark, sf, "pages").select("page_id", U.board_and_job(url, "job-boards.x.io").alias("b"))
    return found.select("page_id", "b.board", "b.job_id")
