"""Title, place and keyword matching over part, nation, customer and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators import needles as N
from . import query, sqlparts as S, table

FAMILIES = {"warm": ("red widget", "hot gear", "red ring", "hot plate"), "cool": ("blue widget", "cold gear", "blue ring"), "sizes": ("small ring", "large rod", "small widget")}
EXCLUDED = ("red anvil",)


def _title_sql(x: str, col: str) -> str:
    ks = ", ".join(f"CASE WHEN regexp_matches({x}, '\\b{p.replace(' ', chr(92) + 's+')}\\b') THEN '{p}' END" for ps in FAMILIES.values() for p in ps)
    fs = ", ".join(f"CASE WHEN regexp_matches({x}, '{'|'.join(chr(92) + 'b' + p.replace(' ', chr(92) + 's+') + chr(92) + 'b' for p in ps)}') THEN '{f}' END" for f, ps in FAMILIES.items())
    return f"CASE WHEN contains({x}, 'red anvil') THEN '' ELSE concat_ws('|', {ks if col == 'k' else fs}) END"


@query("d1_title_match", f"SELECT p_partkey, {_title_sql('p_name', 'k')} AS keywords, {_title_sql('p_name', 'f')} AS families FROM part")
def d1(spark, sf):
    m = table(spark, sf, "part").select("p_partkey", M.title_matches("p_name", FAMILIES, EXCLUDED).alias("m"))
    return m.select("p_partkey", F.array_join("m.keywords", "|").alias("keywords"), F.array_join("m.families", "|").alias("families"))


PLACES = (r"(?i)\bnation_1\b", r"(?i)\b(machinery|building)\b", r"(?i)\bregion 2\b")


@query("d2_target_place", "SELECT c_custkey, regexp_matches(p, '(?i)\\bnation_1\\b') OR (regexp_matches(p, '(?i)\\b(machinery|building)\\b') AND regexp_matches(p, '(?i)\\bregion 2\\b')) AS ok FROM (SELECT c_custkey, n_name || ' ' || c_mktsegment || ' region ' || n_regionkey AS p FROM customer JOIN nation ON c_nationkey = n_nationkey)")
def d2(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", M.is_target_place(F.expr("n_name || ' ' || c_mktsegment || ' region ' || n_regionkey"), *PLACES).alias("ok"))


_D3 = "CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 0 THEN c_mktsegment || ', C' || c_nationkey WHEN c_custkey % 3 <> 0 THEN c_mktsegment WHEN c_custkey % 5 = 0 THEN 'listed' WHEN c_custkey % 2 = 0 THEN 'C' || c_nationkey ELSE '' END"
_CITY, _LAND, _LISTED = "CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE ' ' END", "CASE WHEN c_custkey % 2 = 0 THEN 'C' || c_nationkey ELSE '' END", "CASE WHEN c_custkey % 5 = 0 THEN ' listed ' END"


@query("d3_place_name", f"SELECT c_custkey, {_D3} AS place FROM customer")
def d3(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", M.place_name(F.expr(_CITY), F.expr(_LAND), F.expr(_LISTED)).alias("place"))


_D4_NAME = "CASE c_nationkey % 5 WHEN 0 THEN 'Austin, TX' WHEN 1 THEN 'Remote hub' WHEN 2 THEN '' WHEN 3 THEN 'Hybrid spot' ELSE 'Paris' END"
_D4_KIND = "CASE c_mktsegment WHEN 'MACHINERY' THEN 'Remote' WHEN 'BUILDING' THEN 'On-site' WHEN 'HOUSEHOLD' THEN 'Hybrid' ELSE '' END"
_D4_MODE = "CASE WHEN c_custkey % 2 = 0 THEN 'TELECOMMUTE' ELSE '' END"
_D4_LAND = "CASE WHEN c_custkey % 3 = 0 THEN 'United States of America' ELSE 'France' END"


@query("d4_structured_place", f"SELECT c_custkey, CASE WHEN n = 'Austin, TX' THEN true WHEN k IN ('On-site', 'Hybrid') OR n = 'Hybrid spot' THEN false WHEN n <> '' AND n <> 'Remote hub' THEN false ELSE (k = 'Remote' OR m = 'TELECOMMUTE') AND l LIKE 'United%' END AS ok FROM (SELECT c_custkey, {_D4_NAME} AS n, {_D4_KIND} AS k, {_D4_MODE} AS m, {_D4_LAND} AS l FROM customer)")
def d4(spark, sf):
    ok = M.is_target_posting_place(F.expr(_D4_NAME), F.lit(""), F.lit(""), F.expr(_D4_KIND), F.expr(_D4_MODE), F.expr(_D4_LAND))
    return table(spark, sf, "customer").select("c_custkey", ok.alias("ok"))


@query("d5_first_target_place", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'Remote, USA' WHEN c_custkey % 3 = 0 THEN 'Austin Texas' WHEN c_mktsegment = 'MACHINERY' THEN 'Remote, United States' ELSE '' END AS place FROM customer")
def d5(spark, sf):
    many = F.expr("array('Paris', CASE WHEN c_custkey % 4 = 0 THEN ' Remote,  USA' ELSE 'Rome' END)")
    land = F.expr("CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Remote, United States' ELSE '' END")
    return table(spark, sf, "customer").select("c_custkey", M.first_target_place(many, F.lit("Oslo"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'Austin Texas' ELSE 'Lima' END"), remote_country=land).alias("place"))


@query("d6_snapshot_place", "SELECT c_custkey, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Hybrid - ' || t WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'Remote - United States' ELSE t END AS place FROM (SELECT *, CASE c_nationkey % 2 WHEN 0 THEN 'Dallas' || c_nationkey || ', TX' ELSE 'Lyon' END AS t FROM customer)")
def d6(spark, sf):
    town = F.expr("CASE c_nationkey % 2 WHEN 0 THEN 'TX Dallas' || c_nationkey || ' - AB1' ELSE 'Lyon' END")
    title = F.expr("CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Hybrid role' ELSE 'role' END")
    return table(spark, sf, "customer").select("c_custkey", M.snapshot_place(title, F.lit("old"), town, F.lit("France"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'United States' ELSE '' END"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'Telecommute' ELSE '' END")).alias("place"))


@query("d7_keyword_filter", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_name), 'giz')")
def d7(spark, sf):
    return table(spark, sf, "part").where(M.has_keyword("p_name", ("RED", "giz"))).select("p_partkey", "p_name")


TAGS = {"alpha": ("the ", "und "), "beta": ("tion", "ción"), "gamma": ("ment",), "delta": ("zzz",)}


def tag_sql(x: str) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower({x}), {chr(39)}{k}{chr(39)})' for k in TAGS[t])} THEN '{t}' END" for t in sorted(TAGS)) + ")"


@query("d10_keyword_tags", f"SELECT doc_id, {tag_sql('text')} AS tags FROM documents")
def d10(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(M.tags("text", TAGS), "|").alias("tags"))


@query("d17_role_by_rules", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 'lead' WHEN o_orderpriority LIKE '%LOW%' THEN 'support' WHEN o_orderpriority LIKE '%HIGH%' OR o_orderstatus = 'F' THEN 'engineer' WHEN o_orderstatus = 'P' THEN 'writer' ELSE 'general' END AS role FROM orders")
def d17(spark, sf):
    role = M.role_by_rules("o_orderpriority", F.concat(F.lit("status "), "o_orderstatus"), [("lead", ("urgent",)), ("support", ("low", "tiny"))], [("engineer", ("high", "status f")), ("writer", ("status p",))], "general")
    return table(spark, sf, "orders").select("o_orderkey", role.alias("role"))


ROLES = {"a": ("the", "tion", "ing"), "b": ("der", "ung", "ich"), "c": ("que", "ment", "les")}
_SCORE = {n: " + ".join(f"contains(lower(text), '{w}')::INT + 2 * contains(lower(source || lang), '{w}')::INT" for w in ws) for n, ws in ROLES.items()}


@query("d18_role_by_score", f"SELECT doc_id, CASE WHEN greatest({', '.join(_SCORE.values())}) = 0 THEN 'none' WHEN ({_SCORE['a']}) = greatest({', '.join(_SCORE.values())}) THEN 'a' WHEN ({_SCORE['b']}) = greatest({', '.join(_SCORE.values())}) THEN 'b' ELSE 'c' END AS role FROM documents")
def d18(spark, sf):
    return table(spark, sf, "documents").select("doc_id", M.role_by_score(F.concat("source", "lang"), "text", ROLES, "none").alias("role"))


@query("d19_inferred_names", "WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS idx FROM documents), h AS (SELECT doc_id, idx, 0 AS r, regexp_extract(t, '^(Der|Die|Das) ', 1) AS v FROM p WHERE idx < 15 UNION ALL SELECT doc_id, idx, 1, regexp_extract(t, '([A-Z][a-z]+)\\.$', 1) FROM p WHERE idx < 15) SELECT d.doc_id AS doc, coalesce(b.v, 'Unknown') AS value FROM documents d LEFT JOIN (SELECT doc_id, arg_min(v, idx * 10 + r) AS v FROM h WHERE v <> '' GROUP BY 1) b USING (doc_id)")
def d19(spark, sf):
    p = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    return M.infer_by_patterns(p, ["^(Der|Die|Das) ", r"([A-Z][a-z]+)\.$"], "Unknown")


@query("d23_template_family", "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'plain' WHEN 'PROMO' THEN 'bright' ELSE 'standard' END AS template FROM part")
def d23(spark, sf):
    return M.lookup(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type", {"ECONOMY": "plain", "PROMO": "bright"}, "template", "standard").select("p_partkey", "template")


_LABELS = [("gear work", "core", "gear"), ("ring work", "core", "ring"), ("colour", "look", "red"), ("heat", "look", "hot"), ("size", "form", "large")]


@query("h6_label_ranking", "WITH s AS (SELECT p_brand, label, slot, sum((length(p_name) - length(replace(p_name, kw, ''))) // length(kw)) AS score FROM part, (VALUES " + ", ".join(f"('{a}','{b}','{c}')" for a, b, c in _LABELS) + ") l(label, slot, kw) GROUP BY ALL), b AS (SELECT p_brand, slot, label, score, row_number() OVER (PARTITION BY p_brand, slot ORDER BY score DESC, label DESC) AS rn FROM s WHERE score > 0), e AS (SELECT p_brand, label, 0 AS o, -score AS k, label AS l FROM b WHERE rn = 1 UNION ALL SELECT p_brand, d.label, 1, d.ord, '' FROM (SELECT DISTINCT p_brand FROM part) p, (VALUES ('basics', 'core', 1), ('care', 'care', 2), ('shape', 'form', 3)) d(label, slot, ord) WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.rn = 1 AND b.p_brand = p.p_brand AND b.slot = d.slot)) SELECT p_brand, array_to_string(list(label ORDER BY o, k, l DESC)[1:4], '|') AS labels FROM e GROUP BY 1")
def h6(spark, sf):
    part = table(spark, sf, "part")
    hits = F.explode(F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("slot"), F.regexp_count("p_name", F.lit(c)).cast("long").alias("n")) for a, b, c in _LABELS]))
    scores = part.select("p_brand", hits.alias("h")).groupBy("p_brand", "h.label", "h.slot").agg(F.sum("h.n").alias("score"))
    out = M.ranked_labels(scores, "p_brand", [("basics", "core"), ("care", "care"), ("shape", "form")])
    return out.select("p_brand", F.array_join("labels", "|").alias("labels"))


@query("h7_best_label", "SELECT p_brand, CASE WHEN max(s1) = 0 AND max(s2) = 0 THEN 'fallback' WHEN max(s1) >= max(s2) THEN 'rings' ELSE 'rods' END AS label FROM (SELECT p_brand, sum(contains(p_name, 'ring')::INT) AS s1, sum(contains(p_name, 'rod')::INT) AS s2 FROM part GROUP BY 1) GROUP BY 1")
def h7(spark, sf):
    s = table(spark, sf, "part").groupBy("p_brand").agg(F.count_if(F.col("p_name").contains("ring")).alias("s1"), F.count_if(F.col("p_name").contains("rod")).alias("s2"))
    best = F.array_max(F.array(F.struct(F.col("s1").alias("s"), F.lit(0).alias("p"), F.lit("rings").alias("l")), F.struct(F.col("s2").alias("s"), F.lit(-1).alias("p"), F.lit("rods").alias("l"))))
    return s.select("p_brand", F.when(best["s"] > 0, best["l"]).otherwise("fallback").alias("label"))


@query("h8_focus_text", "SELECT doc_id, CASE WHEN a > b AND a >= c THEN 'first' WHEN c > b THEN 'third' ELSE 'second' END AS focus FROM (SELECT doc_id, len(regexp_extract_all(text, 'the')) AS a, len(regexp_extract_all(text, 'ing')) AS b, len(regexp_extract_all(text, 'que')) AS c FROM documents)")
def h8(spark, sf):
    n = {k: F.regexp_count("text", F.lit(k)) for k in ("the", "ing", "que")}
    focus = F.when((n["the"] > n["ing"]) & (n["the"] >= n["que"]), "first").when(n["que"] > n["ing"], "third").otherwise("second")
    return table(spark, sf, "documents").select("doc_id", focus.alias("focus"))


def _said(*words):
    return " + ".join(f"len(regexp_extract_all(t, '{w}'))" for w in words)


def _rules(spark):
    """The tag table as rows, one for each keyword."""
    return spark.createDataFrame([(tag, word) for tag, words in TAGS.items() for word in words], "tag string, needle string")


@query("d10_tag_rules", f"SELECT doc_id, {tag_sql('text')} AS tags FROM documents")
def d10_rules(spark, sf):
    """d10 with rules that come as rows: an index of the needles' rarest grams instead of a branch for each."""
    found = N.tags_by_rules(table(spark, sf, "documents"), _rules(spark), "doc_id", "text")
    return found.select("doc_id", F.array_join("tags", "|").alias("tags"))


@query("d14_name_rules", "WITH r AS (SELECT DISTINCT lower(n_name) AS needle FROM nation UNION SELECT DISTINCT p_name FROM part UNION SELECT 'item ' || item_id FROM benchmark UNION SELECT substr(text, 1, 12) FROM benchmark) SELECT d.doc_id, count(*) AS hits, min(r.needle) AS first FROM documents d JOIN r ON contains(lower(d.text), lower(r.needle)) GROUP BY 1")
def d14_names(spark, sf):
    """References by rules from the tables: names, and beginnings of test items, found in whole documents."""
    names = [table(spark, sf, "nation").select(F.lower("n_name").alias("needle")), table(spark, sf, "part").select(F.col("p_name")), table(spark, sf, "benchmark").select(F.concat(F.lit("item "), "item_id")), table(spark, sf, "benchmark").select(F.substring("text", 1, 12))]
    rules = names[0].union(names[1]).union(names[2]).union(names[3]).distinct()
    hits = N.rule_hits(table(spark, sf, "documents"), rules.withColumn("name", F.col("needle")), "doc_id", "text")
    return hits.groupBy("doc_id").agg(F.count("*").alias("hits"), F.min("name").alias("first"))


@query("d17_role_rules", "SELECT doc_id, CASE WHEN contains(lower(text), 'tion') THEN 'one' WHEN contains(lower(text), 'que') OR contains(lower(text), 'ung') THEN 'two' ELSE 'none' END AS role FROM documents")
def d17_rules(spark, sf):
    """The first of ordered rules that hits, with the rules as rows."""
    rules = spark.createDataFrame([("one", 0, "tion"), ("two", 1, "que"), ("two", 1, "ung")], "role string, place int, needle string")
    return N.first_by_rules(table(spark, sf, "documents"), rules, "doc_id", "text", "role", "place", "none")


@query("h7_document_label", f"SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'none' WHEN a >= b AND a >= c THEN 'plain' WHEN b >= c THEN 'joined' ELSE 'far' END AS label FROM (SELECT doc_id, {_said('the', 'of')} AS a, {_said('and', 'or')} AS b, {_said('tion')} AS c FROM (SELECT doc_id, {S.match('text')} AS t FROM documents))")
def h7_documents(spark, sf):
    """The label whose keywords a whole text holds most often."""
    label = M.best_label("text", [("plain", ("the", "of")), ("joined", ("and", "or")), ("far", ("tion",))], "none")
    return table(spark, sf, "documents").select("doc_id", label.alias("label"))


@query("h8_document_focus", f"SELECT doc_id, CASE WHEN a >= 3 AND a > b THEN 'infra' WHEN c > 0 THEN 'services' ELSE 'plain' END AS focus FROM (SELECT doc_id, {_said('ing', 'ly')} AS a, {_said('tion', 'ent')} AS b, {_said('que', 'ung')} AS c FROM (SELECT doc_id, {S.match('text')} AS t FROM documents))")
def h8_documents(spark, sf):
    """The first focus whose rule holds for the keyword counts of a whole text."""
    rules = [("infra", lambda n: (n["a"] >= 3) & (n["a"] > n["b"])), ("services", lambda n: n["c"] > 0)]
    return table(spark, sf, "documents").select("doc_id", M.focus("text", {"a": ("ing", "ly"), "b": ("tion", "ent"), "c": ("que", "ung")}, rules, "plain").alias("focus"))
