"""Training examples and their validation over conversations, part and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import training as T
from . import query, table


def _messages(spark, sf):
    c = table(spark, sf, "conversations")
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("t"))
    return g.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), F.when(F.col("conv_id") % 7 == 0, " ").otherwise(x["content"]).alias("content"))).alias("messages"))


@query("m1_examples", "SELECT p_partkey, t.task, t.variant, 'You write ' || t.task || 's.' AS system, 'Role: ' || p_name || chr(10) || 'Brand: ' || p_brand AS user, p_name || ' (' || t.variant || ')' AS assistant FROM part JOIN (VALUES ('PROMO', 'letter', 'short', 1), ('PROMO', 'resume', 'long', 2), ('SMALL', 'letter', 'plain', 1)) t(family, task, variant, ord) ON p_type = family")
def m1(spark, sf):
    variants = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(a).alias("family"), F.lit(b).alias("task"), F.lit(c).alias("variant"), F.lit(d).alias("ord")) for a, b, c, d in (("PROMO", "letter", "short", 1), ("PROMO", "resume", "long", 2), ("SMALL", "letter", "plain", 1))])).alias("v")).select("v.*")
    out = T.examples(table(spark, sf, "part"), variants, "p_partkey", "p_type", F.concat(F.lit("You write "), "task", F.lit("s.")), F.concat(F.lit("Role: "), "p_name", F.lit("\nBrand: "), "p_brand"), F.concat("p_name", F.lit(" ("), "variant", F.lit(")")))
    m = lambda i: F.get("messages", F.lit(i))["content"]
    return out.select("p_partkey", "task", "variant", m(0).alias("system"), m(1).alias("user"), m(2).alias("assistant"))


_REASON = "CASE WHEN len(roles) <> 2 THEN 'wrong number of messages' WHEN roles <> ['user', 'assistant'] THEN 'wrong roles' WHEN conv_id % 7 = 0 OR blank THEN 'empty content' END"
_CONV = "(SELECT conv_id, list(role ORDER BY turn) AS roles, bool_or(trim(text) = '') AS blank FROM conversations GROUP BY 1)"


@query("m2_reject_reasons", f"SELECT conv_id, {_REASON} AS reason FROM {_CONV} c")
def m2(spark, sf):
    return _messages(spark, sf).select("conv_id", T.reject_reason(F.col("messages"), ("user", "assistant")).alias("reason"))


@query("m2_gate", f"SELECT count(*) AS examples, count(*) >= 100 AS passed FROM {_CONV} c WHERE {_REASON} IS NULL")
def m2_gate(spark, sf):
    return T.gate(T.validate(_messages(spark, sf), roles=("user", "assistant"))[0])


@query("m3_integrity", "SELECT 'duplicate' AS kind, o_custkey::VARCHAR AS item, count(*) AS n FROM orders GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'unsupported', n_name, 0 FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def m3(spark, sf):
    dup = T.duplicate_ids(table(spark, sf, "orders"), "o_custkey")
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.when(F.col("c_acctbal") > 9900, F.col("c_custkey")).alias("id"))
    gone = T.unsupported(table(spark, sf, "nation"), c, "n_nationkey")
    return dup.select(F.lit("duplicate").alias("kind"), F.col("o_custkey").cast("string").alias("item"), "n").unionByName(gone.select(F.lit("unsupported").alias("kind"), F.col("n_name").alias("item"), F.lit(0).cast("long").alias("n")))


@query("m4_count_violations", "SELECT e.p_type, e.element, coalesce(c.n, 0) AS n, e.expected FROM (SELECT t AS p_type, b AS element, x AS expected FROM (VALUES ('PROMO', 10), ('SMALL', 14)) v(t, x), (SELECT DISTINCT p_brand AS b FROM part)) e LEFT JOIN (SELECT p_type, p_brand AS element, count(*) AS n FROM part GROUP BY ALL) c USING (p_type, element) WHERE coalesce(c.n, 0) <> e.expected")
def m4(spark, sf):
    p = table(spark, sf, "part")
    want = p.select(F.col("p_brand").alias("element")).distinct().select("element", F.explode(F.array(F.struct(F.lit("PROMO").alias("p_type"), F.lit(10).alias("expected")), F.struct(F.lit("SMALL").alias("p_type"), F.lit(14).alias("expected")))).alias("e")).select("element", "e.*")
    return T.count_violations(p.groupBy("p_type", F.col("p_brand").alias("element")).agg(F.count("*").alias("n")), want, "p_type")


@query("m5_focus_phrase", "SELECT p_partkey, concat_ws('; ', p_type || ', ' || p_brand, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'do ' || p_name END) AS focus FROM part")
def m5(spark, sf):
    none = F.array().cast("array<string>")
    need = F.when(F.col("p_partkey") % 3 == 0, F.array("p_name")).otherwise(none)
    duty = F.when(F.col("p_partkey") % 3 == 1, F.array(F.concat(F.lit("do "), "p_name"))).otherwise(none)
    return table(spark, sf, "part").select("p_partkey", T.focus_phrase(F.array("p_type", "p_brand"), need, duty).alias("focus"))


_SKILLS = "list_concat(['ring', p_type], list_sort([split_part(p_name, ' ', 2), 'b', 'a']))"


@query("f8_skill_lists", f"SELECT p_partkey, array_to_string(list_filter({_SKILLS}, lambda x, i: NOT list_contains(({_SKILLS})[1:i - 1], x)), ',') AS skills FROM part")
def f8(spark, sf):
    job = F.array(F.lit("ring"), "p_type")
    ev = F.array(F.substring_index("p_name", " ", -1), F.lit("b"), F.lit("a"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(T.skill_list(job, ev), ",").alias("skills"))
