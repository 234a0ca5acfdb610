"""Evidence, sections and top-k scoring over lines of documents, conversations, benchmark and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import evidence as E
from ..operators import scoring
from ..operators.matching import tags
from . import query, sqlparts as S, table
from .matching import TAGS, tag_sql


def lines(spark, sf):
    """Paragraphs: the lines of documents."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("idx", "text"))


LINES = "(SELECT doc_id AS doc, unnest(range(0, len(string_split(text, chr(10))))) AS idx, unnest(string_split(text, chr(10))) AS text FROM documents)"
_UPPER = r"(upper(text) = text AND lower(text) <> text AND len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) <= 6)"


@query("d8_document_types", "SELECT doc, CASE WHEN contains(doc, 'resume') THEN 'resume' WHEN contains(doc, 'question') THEN 'application_qa' WHEN bool_or(contains(lower(text), 'dear hiring')) THEN 'cover_letter' ELSE 'other' END AS doc_type FROM (SELECT CASE doc % 4 WHEN 0 THEN 'a/resume_' WHEN 1 THEN 'b/questions_' ELSE 'c/d_' END || doc AS doc, CASE WHEN doc % 4 = 2 AND idx = 0 THEN 'Dear Hiring team' ELSE text END AS text FROM " + LINES + ") GROUP BY doc")
def d8(spark, sf):
    p = lines(spark, sf)
    name = F.expr("CASE doc % 4 WHEN 0 THEN 'a/resume_' WHEN 1 THEN 'b/questions_' ELSE 'c/d_' END || doc")
    return E.document_types(p.select(name.alias("doc"), F.when((F.col("doc") % 4 == 2) & (F.col("idx") == 0), "Dear Hiring team").otherwise(F.col("text")).alias("text")))


#: The rules of is_contact() and is_heading() in full; the white space of headings is Unicode's.
_SPACE = r"[\t-\r \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_D9_CONTACT = "(" + " OR ".join(f"starts_with(lower(text), '{x}')" for x in E.CONTACT_STARTS) + " OR starts_with(text, 'http://') OR starts_with(text, 'https://') OR contains(text, '@') AND NOT contains(text, ' '))"
_D9_HEADING = "(text IN (" + ", ".join(f"'{x}'" for x in E.HEADINGS) + f") OR upper(text) = text AND lower(text) <> text AND len(list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda w: w <> '')) <= 6)"


@query("d9_line_classes", f"SELECT doc, count_if({_D9_HEADING}) AS headings, count_if({_D9_CONTACT}) AS contacts, count_if(regexp_matches(text, '(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[\\s\\x0B]+\\d{{4}}')) AS dates FROM {LINES} GROUP BY 1")
def d9(spark, sf):
    return lines(spark, sf).groupBy("doc").agg(F.count_if(E.is_heading("text")).alias("headings"), F.count_if(E.is_contact("text")).alias("contacts"), F.count_if(E.is_date_line("text")).alias("dates"))


def _any(words):
    return "(" + " OR ".join(f"contains(t, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


_TYPE = f"CASE WHEN s = 'skills' THEN 'skill_demonstration' WHEN s = 'education' THEN 'education' WHEN {_any(E.LEADERSHIP)} THEN 'leadership' WHEN {_any(E.CUSTOMER)} THEN 'customer_interaction' WHEN {_any(E.WRITING)} THEN 'writing_sample' WHEN {_any(E.PREFERENCE)} THEN 'preference' WHEN {_any(E.BUILDING)} THEN CASE WHEN s = 'projects' THEN 'project' ELSE 'achievement' END WHEN s = 'experience' THEN 'responsibility' ELSE 'other' END"
_SEC = "CASE doc % 6 WHEN 0 THEN 'skills' WHEN 1 THEN 'education' WHEN 2 THEN 'projects' WHEN 3 THEN 'experience' ELSE '' END"
_WORDED = "text || CASE idx % 7 WHEN 0 THEN ' built it' WHEN 1 THEN ' onboarding' WHEN 2 THEN ' user guides' WHEN 3 THEN ' looking for' WHEN 4 THEN ' 42 units' ELSE '' END"


def _worded(spark, sf):
    return lines(spark, sf).select("doc", "idx", F.expr(_WORDED).alias("text"), F.expr(_SEC).alias("section"))


@query("d11_evidence_types", f"SELECT doc, idx, {_TYPE} AS kind FROM (SELECT doc, idx, lower({_WORDED}) AS t, {_SEC} AS s FROM {LINES})")
def d11(spark, sf):
    return _worded(spark, sf).select("doc", "idx", E.evidence_type("text", "section", F.lit("other")).alias("kind"))


@query("d12_strength", f"SELECT doc, idx, CASE WHEN kind IN ('achievement', 'project', 'skill_demonstration', 'leadership', 'customer_interaction') THEN CASE WHEN regexp_matches(t, '\\b\\d') OR {_any(E.STRONG)} THEN 'strong' ELSE 'medium' END WHEN kind IN ('preference', 'education') THEN 'medium' ELSE 'weak' END AS strength FROM (SELECT doc, idx, t, {_TYPE} AS kind FROM (SELECT doc, idx, lower({_WORDED}) AS t, {_SEC} AS s FROM {LINES}))")
def d12(spark, sf):
    return _worded(spark, sf).withColumn("kind", E.evidence_type("text", "section", F.lit("other"))).select("doc", "idx", E.strength("text", "kind", F.lit("other")).alias("strength"))


_QA = "CASE idx % 4 WHEN 0 THEN 'Why (so)I ' || text WHEN 1 THEN 'How? Because ' || text WHEN 2 THEN text || '?' ELSE text END"


def _prompt_sql(t: str) -> str:
    """Rows doc, idx, prompt, answer, question of a text expression, by the ordered marks and else the last question mark."""
    at = lambda m: f"strpos(t, '{m}')"
    prompt = " ".join(f"WHEN {at(m)} > 0 THEN trim(substr(t, 1, {at(m)}))" for m in E.ANSWER_MARKS)
    answer = " ".join(f"WHEN {at(m)} > 0 THEN trim(regexp_replace(substr(t, {at(m)} + 1), '^[ )]+', ''))" for m in E.ANSWER_MARKS)
    inner = "contains(t, '?') AND NOT trim(t) LIKE '%?' AND trim(substr(t, q + 1)) <> ''"
    return f"""SELECT doc, idx, CASE {prompt} WHEN {inner} THEN trim(substr(t, 1, q - 1)) || '?' END AS prompt,
      md5(CASE {answer} WHEN {inner} THEN trim(substr(t, q + 1)) ELSE t END) AS answer,
      trim(t) LIKE '%?' OR regexp_matches(trim(t), '^[1-9]\\.') AS question
      FROM (SELECT doc, idx, t, CASE WHEN contains(t, '?') THEN length(t) - strpos(reverse(t), '?') + 1 ELSE length(t) + 1 END AS q FROM (SELECT doc, idx, coalesce({t}, '') AS t FROM {LINES}))"""


@query("d13_prompts", _prompt_sql(_QA))
def d13(spark, sf):
    p = lines(spark, sf).withColumn("qa", F.expr(_QA))
    return p.select("doc", "idx", E.prompt_and_answer("qa").alias("x"), (E.is_question("qa")).alias("question")).select("doc", "idx", "x.prompt", F.md5("x.answer").alias("answer"), "question")


@query("d13_prompts_all", _prompt_sql("text"))
def d13_all(spark, sf):
    """d13 over all lines as they are, with the prompts that they hold themselves."""
    p = lines(spark, sf)
    return p.select("doc", "idx", E.prompt_and_answer("text").alias("x"), E.is_question("text").alias("question")).select("doc", "idx", "x.prompt", F.md5("x.answer").alias("answer"), "question")


@query("d14_entity_references", f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN contains(text, 'the') THEN 'ref_a' END, CASE WHEN contains(text, 'tion') AND lang = 'en' THEN 'ref_b' END, CASE WHEN contains(text, 'ung') THEN 'ref_c' END, CASE WHEN source = 'src1' THEN 'ref_a' END], lambda x: x IS NOT NULL))), '|') AS refs FROM documents")
def d14(spark, sf):
    d = table(spark, sf, "documents")
    text = F.col("text")
    rules = [("ref_a", text.contains("the")), ("ref_b", text.contains("tion") & (F.col("lang") == "en")), ("ref_c", text.contains("ung")), ("ref_a", F.col("source") == "src1")]
    return d.select("doc_id", F.array_join(E.references(rules), "|").alias("refs"))


@query("d15_kept_evidence", rf"SELECT doc, idx, md5(c) AS digest FROM (SELECT doc, idx, trim(regexp_replace(regexp_replace('(n' || idx || ') ' || text, '^\([^)]*\)', ''), '\s+', ' ', 'g')) AS c FROM {LINES}) WHERE length(trim(c)) >= 20 AND NOT (contains(c, '@') AND NOT contains(c, ' ')) AND NOT starts_with(c, 'http') AND NOT regexp_matches(lower(c), '^(location:|mobile:|email:|linkedin:|website:|github|\+1 \(|dear hiring|sincerely)') AND NOT (c LIKE '%?' OR regexp_matches(c, '^[1-9]\.')) AND NOT contains(lower(c), 'resume honest') AND NOT contains(lower(c), 'for this posting')")
def d15(spark, sf):
    c = E.cleaned_lines("text", lambda i: F.concat(F.lit("(n"), i.cast("string"), F.lit(") ")))
    p = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(c).alias("idx", "c"))
    return p.where(E.keeps("c")).select("doc", "idx", F.md5("c").alias("digest"))


@query("d16_style_notes", "SELECT doc_id, concat_ws('|', CASE WHEN contains(lower(text), 'the') THEN 'plain' END, CASE WHEN contains(lower(text), 'que') OR contains(lower(text), 'ung') THEN 'foreign' END) AS notes FROM documents WHERE length(text) >= 120")
def d16(spark, sf):
    d = table(spark, sf, "documents").where(F.length("text") >= 120)
    return d.select("doc_id", F.array_join(E.style_notes("text", [("plain", ("the",)), ("foreign", ("que", "ung"))]), "|").alias("notes"))


_RES = "CASE WHEN idx % 9 = 0 THEN CASE doc % 5 WHEN 0 THEN 'TECHNICAL SKILLS' WHEN 1 THEN 'PROJECTS' WHEN 2 THEN 'PROFESSIONAL EXPERIENCE' WHEN 3 THEN 'EDUCATION' ELSE 'OTHER THINGS' END WHEN idx % 9 = 4 THEN 'PROFESSIONAL EXPERIENCE' WHEN idx % 9 = 2 THEN 'Org ' || idx || ' | Role' WHEN idx % 9 = 6 THEN 'Plan ' || idx || ' (2024) x' WHEN idx % 9 = 7 THEN 'JAN 2020 to MAY 2021' ELSE 'w ' || text END"


@query("h1_resume_sections", f"""
WITH p AS (SELECT doc, idx, {_RES} AS text FROM {LINES}),
c AS (SELECT *, (contains(text, '@') AND NOT contains(text, ' ')) AS contact, {_UPPER} AS heading FROM p),
s AS (SELECT *, coalesce(last_value(CASE WHEN heading AND NOT contact THEN CASE WHEN contains(upper(text), 'SKILLS') THEN 'skills' WHEN contains(upper(text), 'PROJECT') THEN 'projects' WHEN contains(upper(text), 'EXPERIENCE') THEN 'experience' WHEN contains(upper(text), 'EDUCATION') THEN 'education' ELSE '' END END IGNORE NULLS) OVER w, '') AS section FROM c WINDOW w AS (PARTITION BY doc ORDER BY idx)),
f AS (SELECT *, NOT contact AND NOT heading AND NOT regexp_matches(text, '(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)\\s+\\d{{4}}') AS free FROM s),
o AS (SELECT *, free AND contains(text, '|') AND section = 'experience' AS org FROM f),
j AS (SELECT *, free AND NOT org AND section = 'projects' AND regexp_matches(text, '\\(\\d{{4}}\\)') AS project FROM o),
v AS (SELECT *, last_value(CASE WHEN org THEN trim(split_part(text, '|', 1)) END IGNORE NULLS) OVER w AS so, last_value(CASE WHEN project THEN trim(split_part(text, '(', 1)) END IGNORE NULLS) OVER w AS sp FROM j WINDOW w AS (PARTITION BY doc ORDER BY idx))
SELECT doc, idx, section, coalesce(sp, so) AS organisation FROM v WHERE free AND NOT org AND NOT project AND length(text) >= 12""")
def h1(spark, sf):
    p = lines(spark, sf).select("doc", "idx", F.expr(_RES).alias("text"))
    return E.resume_sections(p).select("doc", "idx", "section", "organisation")


@query("h2_carried_question", "SELECT conv_id, turn, length(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn)) AS question_chars FROM conversations")
def h2(spark, sf):
    c = table(spark, sf, "conversations")
    return E.carry_question(c, "conv_id", "turn", F.col("role") == "user", "text", "question").select("conv_id", "turn", F.length("question").cast("long").alias("question_chars"))


_NARRATIVE_TEXT = "CASE idx % 8 WHEN 0 THEN 'Why do you write? ' || text WHEN 1 THEN text WHEN 2 THEN left(text, 60) || '?' WHEN 3 THEN 'Tell us about ' || text WHEN 4 THEN 'Thank you for considering ' || text WHEN 5 THEN 'one@example.org' WHEN 6 THEN 'How (so)I ' || text ELSE 'In your resume ' || text END"
_NARRATIVE_KIND = "CASE doc % 3 WHEN 0 THEN 'application_qa' WHEN 1 THEN 'cover_letter' ELSE 'other' END"


def _narrative_sql() -> str:
    """The same state by a window over each document, the prompt split by cases."""
    marks = " ".join(f"WHEN strpos(t, '{m}') > 0 THEN {{}}".format(f"trim(substr(t, 1, strpos(t, '{m}')))") for m in E.ANSWER_MARKS)
    rests = " ".join(f"WHEN strpos(t, '{m}') > 0 THEN trim(regexp_replace(substr(t, strpos(t, '{m}') + 1), '^[ )]+', ''))" for m in E.ANSWER_MARKS)
    inner = "contains(t, '?') AND NOT trim(t) LIKE '%?' AND trim(substr(t, q + 1)) <> ''"
    contact = "regexp_matches(lower(x), '^(location:|mobile:|email:|linkedin:|website:|github|\\+1 \\(|dear hiring|sincerely)') OR starts_with(x, 'http://') OR starts_with(x, 'https://') OR (contains(x, '@') AND NOT contains(x, ' '))"
    about = "contains(lower(x), 'your resume') OR contains(lower(x), 'resume honest') OR contains(lower(x), 'for this posting')"
    starts = "|".join(E.PROMPT_STARTS).replace(".", "[.]")
    return f"""WITH b AS (SELECT doc, idx, {_NARRATIVE_KIND} AS kind, {_NARRATIVE_TEXT} AS t FROM {LINES}),
c AS (SELECT *, CASE WHEN contains(t, '?') THEN length(t) - strpos(reverse(t), '?') + 1 ELSE length(t) + 1 END AS q FROM b),
d AS (SELECT *, CASE WHEN kind = 'application_qa' THEN CASE {marks} WHEN {inner} THEN trim(substr(t, 1, q - 1)) || '?' END END AS prompt,
  CASE WHEN kind = 'application_qa' THEN CASE {rests} WHEN {inner} THEN trim(substr(t, q + 1)) ELSE t END ELSE t END AS ans FROM c),
e AS (SELECT *, CASE WHEN coalesce(ans, '') <> '' THEN ans ELSE t END AS x FROM d),
f AS (SELECT *, ({contact} OR {about}) AS aside, kind = 'application_qa' AND (trim(x) LIKE '%?' OR regexp_matches(trim(x), '^[1-9][.]') OR regexp_matches(lower(trim(x)), '^({starts})')) AS asks FROM e),
g AS (SELECT *, last_value(CASE WHEN asks AND NOT aside THEN x WHEN prompt <> '' THEN prompt END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY idx) AS question FROM f)
SELECT doc, idx, md5(x) AS digest, 'paragraph_' || idx || CASE WHEN question IS NOT NULL AND question <> x THEN ' | prompt=' || {S.summary('question', 12)} ELSE '' END AS location
FROM g WHERE NOT aside AND NOT asks AND NOT (kind = 'cover_letter' AND regexp_matches(lower(x), '^(thank you for considering|please see my resume|i would welcome an opportunity)')) AND length(x) >= 25"""


@query("h2_narrative_paragraphs", _narrative_sql())
def h2_narrative(spark, sf):
    """Evidence of letters and of questions with answers, with the place and the question that it answers."""
    p = lines(spark, sf).select("doc", "idx", F.expr(_NARRATIVE_KIND).alias("doc_type"), F.expr(_NARRATIVE_TEXT).alias("text"))
    return E.narrative_paragraphs(p).select("doc", "idx", F.md5("text").alias("digest"), "location")


@query("h3_two_sections", f"SELECT doc, section, string_agg(md5(text), '' ORDER BY idx) AS digest, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc, section ORDER BY idx) AS pos FROM (SELECT doc, idx, text, mark, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc ORDER BY idx) AS section FROM (SELECT doc, idx, text, CASE WHEN idx % 11 = 1 THEN 'duties' WHEN idx % 11 = 6 THEN 'needs' END AS mark FROM {LINES})) WHERE mark IS NULL AND section IS NOT NULL) WHERE pos <= 10 GROUP BY ALL")
def h3(spark, sf):
    rows = E.two_sections(lines(spark, sf), {"duties": F.col("idx") % 11 == 1, "needs": F.col("idx") % 11 == 6})
    g = rows.groupBy("doc", "section").agg(F.array_sort(F.collect_list(F.struct("idx", F.md5("text").alias("m")))).alias("l"), F.count("*").alias("n"))
    return g.select("doc", "section", F.array_join(F.transform("l", lambda x: x["m"]), "").alias("digest"), "n")


@query("f5_supporting_ids", "SELECT item, count(*) AS n, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS ids FROM (SELECT doc_id, 'toxic' AS item FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 UNION ALL SELECT doc_id, 'good' FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND lang = 'en') GROUP BY 1")
def f5(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    s = E.folded_ids(E.supporting_ids([("toxic", F.col("toxic") == 1), ("good", (F.col("quality") == 1) & (F.col("lang") == "en"))], d, "doc_id"), "doc_id")
    return s.select("item", F.size("ids").cast("long").alias("n"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids"))


@query("f5_supporting_rows", "SELECT DISTINCT 'toxic' AS item, doc_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 UNION ALL SELECT DISTINCT 'good', doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND lang = 'en'")
def f5_rows(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return E.supporting_ids([("toxic", F.col("toxic") == 1), ("good", (F.col("quality") == 1) & (F.col("lang") == "en"))], d, "doc_id")


@query("f6_tag_entries", f"WITH t AS (SELECT doc_id, source, unnest(string_split({tag_sql('text')}, '|')) AS tag FROM documents) SELECT tag, count(DISTINCT doc_id) AS n_ids, array_to_string(list_sort(list(DISTINCT source)), ',') AS contexts FROM t WHERE tag <> '' GROUP BY 1")
def f6(spark, sf):
    d = table(spark, sf, "documents").withColumn("t", tags("text", TAGS))
    out = E.tag_entries(d, "t", "doc_id", F.col("source"))
    return out.select("tag", "n_ids", F.array_join("contexts", ",").alias("contexts"))


@query("f7_evidence_totals", f"SELECT lang, count(DISTINCT doc_id) AS docs, count(*) AS paragraphs, count_if(length(p) >= 120) AS long_ones FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS p FROM documents) GROUP BY 1")
def f7(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", F.explode(F.split("text", "\n")).alias("p"))
    return d.groupBy("lang").agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("paragraphs"), F.count_if(F.length("p") >= 120).alias("long_ones"))


_BT = f"list_filter(list_distinct(string_split({S.match('text')}, ' ')), lambda w: length(w) >= 3)"


_E12 = f"WITH a AS (SELECT item_id, unnest({_BT}) AS token FROM benchmark), b AS (SELECT doc_id, unnest({_BT}) AS token FROM documents) SELECT item_id, doc_id, count(*) AS overlap, 3 * count(*) + any_value(doc_id % 3) AS score FROM a JOIN b USING (token) GROUP BY item_id, doc_id"


@query("e12_token_overlap", _E12)
@query("e12_token_overlap_all", _E12)
def e12(spark, sf):
    """Documents of all sources; registered under both of its names."""
    jobs = table(spark, sf, "benchmark").select("item_id", tokens("text").alias("tokens"))
    ev = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 3).alias("static"), tokens("text").alias("tokens"))
    return scoring.overlap_scores(jobs, ev, "item_id", "doc_id", "static").select("item_id", "doc_id", "overlap", "score")


@query("h5_overlap_top", f"WITH a AS (SELECT item_id, unnest({_BT}) AS token FROM benchmark), b AS (SELECT doc_id, unnest({_BT}) AS token FROM documents), s AS (SELECT item_id, doc_id, count(*) AS overlap FROM a JOIN b USING (token) GROUP BY ALL), e AS (SELECT i.item_id, d.doc_id, 3 * coalesce(s.overlap, 0) + CASE WHEN d.doc_id % 5 = 0 THEN 4 ELSE 0 END + CASE WHEN d.n_chars > 500 THEN -1 ELSE 0 END + 2 AS score, d.doc_id % 5 = 0 AS strong FROM benchmark i CROSS JOIN documents d LEFT JOIN s USING (item_id, doc_id)) SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, strong DESC, doc_id) AS rank FROM e WHERE score > 0) WHERE rank <= 12")
def h5(spark, sf):
    jobs = table(spark, sf, "benchmark").select("item_id", tokens("text").alias("tokens"))
    static = (F.when(F.col("doc_id") % 5 == 0, 4).otherwise(0) + F.when(F.col("n_chars") > 500, -1).otherwise(0) + 2).cast("long")
    ev = table(spark, sf, "documents").select("doc_id", static.alias("static"), (F.col("doc_id") % 5 == 0).alias("strong"), F.col("doc_id").alias("seq"), tokens("text").alias("tokens"))
    return scoring.top_by_overlap(jobs, ev, "item_id", "doc_id", "static").select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


_H5F = ["['x', 'y']", "['z']", "['none']"]


@query("h5_family_bonus", f"WITH a AS (SELECT item_id, unnest({_BT}) AS token FROM benchmark), b AS (SELECT doc_id, unnest({_BT}) AS token FROM documents), s AS (SELECT item_id, doc_id, count(*) AS overlap FROM a JOIN b USING (token) GROUP BY ALL), e AS (SELECT i.item_id, d.doc_id, 3 * coalesce(s.overlap, 0) + CASE WHEN d.doc_id % 5 = 0 THEN 4 ELSE 0 END + 2 + CASE WHEN list_has_any(CASE i.item_id % 3 WHEN 0 THEN {_H5F[0]} WHEN 1 THEN {_H5F[1]} ELSE {_H5F[2]} END, CASE d.doc_id % 4 WHEN 0 THEN ['x'] WHEN 1 THEN ['y', 'z'] WHEN 2 THEN ['z'] ELSE []::VARCHAR[] END) THEN 6 ELSE 0 END AS score, d.doc_id % 5 = 0 AS strong FROM benchmark i CROSS JOIN documents d LEFT JOIN s USING (item_id, doc_id)) SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, strong DESC, doc_id) AS rank FROM e WHERE score > 0) WHERE rank <= 12")
def h5_bonus(spark, sf):
    """h5 with the bonus of the job's family: tags that it wants and pieces have."""
    wants = F.expr("CASE item_id % 3 WHEN 0 THEN array('x', 'y') WHEN 1 THEN array('z') ELSE array('none') END")
    has = F.expr("CASE doc_id % 4 WHEN 0 THEN array('x') WHEN 1 THEN array('y', 'z') WHEN 2 THEN array('z') ELSE array() END").cast("array<string>")
    jobs = table(spark, sf, "benchmark").select("item_id", tokens("text").alias("tokens"), wants.alias("wants"))
    static = (F.when(F.col("doc_id") % 5 == 0, 4).otherwise(0) + 2).cast("long")
    ev = table(spark, sf, "documents").select("doc_id", static.alias("static"), (F.col("doc_id") % 5 == 0).alias("strong"), F.col("doc_id").alias("seq"), tokens("text").alias("tokens"), has.alias("has"))
    return scoring.top_by_overlap(jobs, ev, "item_id", "doc_id", "static", wants="wants", has="has").select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


_PT = "list_distinct([p_type, CASE WHEN p_size > 25 THEN 'big' ELSE 'little' END, split_part(p_name, ' ', 1)])"


@query("h4_tag_top", f"WITH e AS (SELECT p_partkey AS id, p_brand AS org, p_name AS summary, {_PT} AS t, p_size % 2 = 0 AS strong, p_size % 5 = 0 AS q FROM part), j AS (SELECT n_nationkey AS job, CASE n_nationkey % 3 WHEN 0 THEN 'PROMO' WHEN 1 THEN 'big' ELSE 'SMALL' END AS family, ['red', CASE WHEN n_nationkey % 2 = 0 THEN 'blue' ELSE 'hot' END] AS tags FROM nation), s AS (SELECT job, id, org, summary, strong, CASE WHEN list_contains(t, family) THEN 5 ELSE 0 END + 3 * len(list_intersect(tags, t)) + CASE WHEN strong THEN 2 ELSE 0 END + CASE WHEN q THEN 1 ELSE 0 END AS score FROM e CROSS JOIN j), o AS (SELECT *, row_number() OVER (PARTITION BY job, org, summary ORDER BY score DESC, strong DESC, id DESC) AS rn FROM s WHERE score > 0) SELECT job, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY score DESC, strong DESC, id DESC) AS rank FROM o WHERE rn = 1) WHERE rank <= 8")
def h4(spark, sf):
    p = table(spark, sf, "part")
    t = F.array("p_type", F.when(F.col("p_size") > 25, "big").otherwise("little"), F.substring_index("p_name", " ", 1))
    ev = p.select(F.col("p_partkey").alias("evidence_id"), F.col("p_brand").alias("organisation"), F.col("p_name").alias("summary"), t.alias("t"), (F.col("p_size") % 2 == 0).alias("strong"), (F.col("p_size") % 5 == 0).alias("q"))
    jobs = table(spark, sf, "nation").select(F.col("n_nationkey").alias("job"), F.expr("CASE n_nationkey % 3 WHEN 0 THEN 'PROMO' WHEN 1 THEN 'big' ELSE 'SMALL' END").alias("family"), F.array(F.lit("red"), F.when(F.col("n_nationkey") % 2 == 0, "blue").otherwise("hot")).alias("tags"))
    ev = ev.withColumn("role_tags", F.col("t")).withColumnRenamed("t", "skill_tags").withColumnRenamed("q", "quantified")
    top = scoring.select_by_tags(jobs, ev, "job")
    return top.select("job", F.col("evidence_id").alias("id"), "score", F.col("rank").cast("long").alias("rank"))


@query("h4_text_bonus", "WITH e AS (SELECT p_partkey AS id, p_brand AS org, p_name AS summary, p_type, p_size % 2 = 0 AS strong, p_size % 5 = 0 AS q, contains(lower(p_name), 'ring') OR contains(lower(p_name), 'hot') AS says FROM part), j AS (SELECT n_nationkey AS job, CASE n_nationkey % 3 WHEN 0 THEN 'PROMO' WHEN 1 THEN 'support' ELSE 'SMALL' END AS family FROM nation), s AS (SELECT job, id, org, summary, strong, CASE WHEN p_type = family THEN 5 ELSE 0 END + CASE WHEN strong THEN 2 ELSE 0 END + CASE WHEN q THEN 1 ELSE 0 END + CASE WHEN family = 'support' AND says THEN 4 ELSE 0 END AS score FROM e CROSS JOIN j), o AS (SELECT *, row_number() OVER (PARTITION BY job, org, summary ORDER BY score DESC, strong DESC, id DESC) AS rn FROM s WHERE score > 0) SELECT job, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY score DESC, strong DESC, id DESC) AS rank FROM o WHERE rn = 1) WHERE rank <= 8")
def h4_bonus(spark, sf):
    """h4 with a bonus for words in the text of pieces that share no tag with the job."""
    says = F.lower("p_name").contains("ring") | F.lower("p_name").contains("hot")
    none = F.array().cast("array<string>")
    ev = table(spark, sf, "part").select(F.col("p_partkey").alias("evidence_id"), F.col("p_brand").alias("organisation"), F.col("p_name").alias("summary"), F.array("p_type").alias("role_tags"), none.alias("skill_tags"), (F.col("p_size") % 2 == 0).alias("strong"), (F.col("p_size") % 5 == 0).alias("quantified"), F.when(says, F.array(F.lit("words"))).otherwise(none).alias("says"))
    family = F.expr("CASE n_nationkey % 3 WHEN 0 THEN 'PROMO' WHEN 1 THEN 'support' ELSE 'SMALL' END")
    jobs = table(spark, sf, "nation").select(F.col("n_nationkey").alias("job"), family.alias("family"), none.alias("tags"), F.when(family == "support", F.array(F.lit("words"))).otherwise(none).alias("asks"))
    top = scoring.select_by_tags(jobs, ev, "job", bonus=F.when(F.arrays_overlap("asks", "says"), 4).otherwise(0), job_marks="asks", piece_marks="says")
    return top.select("job", F.col("evidence_id").alias("id"), "score", F.col("rank").cast("long").alias("rank"))


@query("j2_tag_sets", f"SELECT p_partkey, array_to_string(list_sort(list_intersect({_PT}, ['big', 'red', 'PROMO'])), '|') AS shared, len(list_filter({_PT}, lambda x: x NOT IN ('big', 'red'))) AS rest FROM part")
def j2(spark, sf):
    t = F.array("p_type", F.when(F.col("p_size") > 25, "big").otherwise("little"), F.substring_index("p_name", " ", 1))
    want = F.array(F.lit("big"), F.lit("red"), F.lit("PROMO"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(F.array_intersect(t, want)), "|").alias("shared"), F.size(F.array_except(t, F.array(F.lit("big"), F.lit("red")))).cast("long").alias("rest"))
