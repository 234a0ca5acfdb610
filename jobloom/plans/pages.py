"""Page extraction over pages, with head tags and embedded objects built from their addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean
from ..operators import pages as P
from . import query, table


_DECODED = "replace(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"')"


def _text_sql() -> str:
    """Text nodes of pages whose tags hold no quoted ">", and which use few kinds of references."""
    parts = "regexp_extract_all(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[^>]*>|[^<]+')"
    node = f"CASE WHEN regexp_matches(x, '(?i)^<(script|style)') THEN regexp_replace(regexp_replace(x, '^<[^>]*>', ''), '</[a-zA-Z]*>$', '') WHEN starts_with(x, '<') THEN '' ELSE regexp_replace({_DECODED}, '&amp;?', '&', 'g') END"
    cleaned = rf"list_transform({parts}, lambda x: trim(regexp_replace({node}, '\s+', ' ', 'g')))"
    return f"SELECT page_id, length(t) AS n, md5(t) AS digest FROM (SELECT page_id, array_to_string(list_filter({cleaned}, lambda y: y <> ''), ' ') AS t FROM pages)"


@query("c1_page_text", _text_sql())
def c1(spark, sf):
    t = table(spark, sf, "pages").select("page_id", P.page_text("html").alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


def _head(spark, sf):
    ld = F.concat(F.lit('<script type="application/ld+json">{broken</script><script type="application/ld+json"> {"@type":"Thing"} </script><script type="application/ld+json">{"@type":"JobPosting","title":"T'), "page_id", F.lit('","description":"D&amp;D"}</script>'))
    link = F.concat(F.lit('<link  rel="canonical" href="'), "url", F.lit('"/>'))
    meta = F.concat(F.lit('<meta name="x" property="og:title" content=" Page '), "page_id", F.lit(' &amp; more">'))
    state = F.concat(F.lit('phApp.ddo = {"jobDetail":{"data":{"job":{"jobDescription":"S'), "page_id", F.lit('"}}}}; phApp.x = 1;'))
    return table(spark, sf, "pages").select("page_id", "url", F.concat(link, meta, F.when(F.col("page_id") % 2 == 0, ld).otherwise(""), F.when(F.col("page_id") % 3 == 0, state).otherwise(""), "html").alias("html"))


@query("c2_canonical_url", "SELECT page_id, url AS canonical FROM pages")
def c2(spark, sf):
    return _head(spark, sf).select("page_id", P.canonical_url("html").alias("canonical"))


@query("c3_open_graph", "SELECT page_id, 'Page ' || page_id || ' & more' AS title FROM pages")
def c3(spark, sf):
    return _head(spark, sf).select("page_id", P.open_graph("html", "og:title").alias("title"))


@query("c4_job_posting", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'T' || page_id END AS title, CASE WHEN page_id % 2 = 0 THEN 'D&D' END AS description FROM pages")
def c4(spark, sf):
    p = _head(spark, sf).select("page_id", P.job_posting("html").alias("v"))
    return p.select("page_id", F.variant_get("v", "$.title", "string").alias("title"), P.unescaped(F.variant_get("v", "$.description", "string")).alias("description"))


@query("c5_state_object", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'S' || page_id END AS description FROM pages")
def c5(spark, sf):
    return _head(spark, sf).select("page_id", F.variant_get(P.state_object("html"), "$.jobDetail.data.job.jobDescription", "string").alias("description"))


@query("c6_listing_tiles", "SELECT page_id, 'Job ' || page_id AS title, 'J' || page_id AS job_id, CASE WHEN page_id % 2 = 0 THEN 'Rome' ELSE 'Land' END AS place, 'https://x.io/list/job/' || page_id AS url FROM pages")
def c6(spark, sf):
    card = F.concat(F.lit('<div class="tile"><a href="job/'), "page_id", F.lit('"> Job  '), "page_id", F.lit('</a><span class="jobId">J'), "page_id", F.lit("</span>"), F.when(F.col("page_id") % 2 == 0, F.lit('<span class="location">Rome</span>')).otherwise(F.lit("")), F.lit('<span class="country">Land</span></div><div class="tile"><a href="">no link</a></div>'))
    rows = table(spark, sf, "pages").select("page_id", F.explode(P.tiles(F.concat("html", card))).alias("t"))
    return rows.select("page_id", "t.title", "t.job_id", "t.place", P.absolute_url(F.lit("https://x.io/list/?page=2"), "t.link").alias("url"))


@query("c9_description_chain", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'D&amp;D' WHEN page_id % 3 = 0 THEN 'S' || page_id WHEN page_id % 5 = 0 THEN 'body ' || page_id ELSE 'Page ' || page_id || ' & more' END AS description FROM pages")
def c9(spark, sf):
    text = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("intro TITLE body "), "page_id", F.lit(" Apply now tail"))).otherwise("TITLE without an end")
    d = P.description(P.job_posting("html"), P.state_object("html"), text, "TITLE", ("Apply now", "Share this"), P.open_graph("html", "og:title"))
    return _head(spark, sf).select("page_id", d.alias("description"))


@query("b14_unescaped", "SELECT page_id, 'a & b <' || page_id || '> é' AS text FROM pages")
def b14(spark, sf):
    return table(spark, sf, "pages").select("page_id", clean(P.unescaped(F.concat(F.lit("a &amp; b &lt;"), "page_id", F.lit("&gt; &eacute;")))).alias("text"))


@query("b14_unescaped_json", "SELECT doc_id, md5(text) AS text, lang, n_chars::BIGINT AS n_chars FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def b14_json(spark, sf):
    """The texts of documents, escaped as references inside nested JSON, and read back from it."""
    code = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    d = table(spark, sf, "documents").where("text is not null and lang is not null")
    value = F.to_json(F.struct(F.struct(F.array(F.struct(code(F.col("text")).alias("t"), "n_chars")).alias("list")).alias("in"), code(F.col("lang")).alias("l")))
    read = F.from_json(P.unescaped_json(value), "`in` struct<list: array<struct<t: string, n_chars: bigint>>>, l string")
    return d.select("doc_id", read.alias("v")).select("doc_id", F.md5(F.col("v.in.list")[0]["t"]).alias("text"), F.col("v.l").alias("lang"), F.col("v.in.list")[0]["n_chars"].alias("n_chars"))
