"""Evidence records from paragraph tables: line classes, section carry-forward, types, strength and aggregates.

Paragraph tables have (doc, idx, text); what lasts from line to line is carried forward by blocks of a document (carry.py).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.text import MONTH_YEAR, blank, column, is_quantified, summary
from .carry import BLOCK, carry_forward
from .matching import has_keyword

#: Headings that are not all capitals by rule, and starts of contact lines.
HEADINGS = ("SUMMARY", "TECHNICAL SKILLS", "RECENT PROFESSIONAL DEVELOPMENT", "PROJECTS", "RECENT PROJECTS", "PROFESSIONAL EXPERIENCE", "EDUCATION", "EDUCATION & PROFESSIONAL DEVELOPMENT")
CONTACT_STARTS = ("location:", "mobile:", "email:", "linkedin:", "website:", "github", "+1 (", "dear hiring", "sincerely")
#: Keywords of evidence types, in rule order.
LEADERSHIP = ("led", "coordinated", "tech lead", "planning", "code reviews")
CUSTOMER = ("guided users", "onboarding", "troubleshooting", "root cause", "primary technical contact", "technical support", "incident management")
WRITING = ("documentation", "user guides", "manuals", "sops", "architecture specifications", "confluence")
PREFERENCE = ("interested in", "looking for", "motivated", "i am applying", "i’m applying", "i'm applying")
BUILDING = ("built", "developed", "implemented", "designed", "deployed", "created")
STRONG = ("decreased", "enabled", "improved", "led", "developed", "implemented", "built", "deployed")
#: Marks that end a prompt inside a paragraph.
ANSWER_MARKS = (")I ", ")At ", ")One ", "?I ", "?At ", "?One ", "?In ")


def _starts(c: Column, prefixes) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def _lower_start(t: Column, prefixes) -> Column:
    """The lower-cased beginning of a text, long enough to compare with the prefixes."""
    return F.lower(F.substring(t, 1, max(map(len, prefixes))))


def is_contact(text, names: tuple = ()) -> Column:
    t = blank(text)
    starts = (*CONTACT_STARTS, *names)
    return _starts(_lower_start(t, starts), starts) | t.startswith("http://") | t.startswith("https://") | (t.contains("@") & ~t.contains(" "))


def is_heading(text) -> Column:
    t = blank(text)
    words = F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != ""))
    return t.isin(*HEADINGS) | ((F.upper(t) == t) & (F.lower(t) != t) & (words <= 6))


def is_date_line(text) -> Column:
    return blank(text).rlike(MONTH_YEAR)


def document_types(paragraphs: DataFrame, name: str = "doc") -> DataFrame:
    """(doc, doc_type): by file name, then by content, else other."""
    n = F.lower(F.element_at(F.split(F.col(name).cast("string"), "/"), -1))
    kinds = paragraphs.groupBy(name).agg(F.bool_or(F.lower("text").contains("dear hiring")).alias("letter"))
    return kinds.select(name, F.when(n.contains("resume"), "resume").when(n.contains("cover_letter"), "cover_letter").when(n.contains("question"), "application_qa").when(F.col("letter"), "cover_letter").otherwise("other").alias("doc_type"))


def evidence_type(text, section, doc_type) -> Column:
    t, s, d = F.lower(blank(text)), blank(section), blank(doc_type)
    any_ = lambda words: has_keyword(t, words)
    return (
        F.when(s == "skills", "skill_demonstration")
        .when(s == "education", "education")
        .when(any_(LEADERSHIP), "leadership")
        .when(any_(CUSTOMER), "customer_interaction")
        .when(any_(WRITING), F.when(d != "resume", "writing_sample").otherwise("skill_demonstration"))
        .when(any_(PREFERENCE), "preference")
        .when(any_(BUILDING), F.when(s == "projects", "project").otherwise("achievement"))
        .when(s == "experience", "responsibility")
        .otherwise("other")
    )


def strength(text, kind, doc_type) -> Column:
    shown = column(kind).isin("achievement", "project", "skill_demonstration", "leadership", "customer_interaction")
    return (
        F.when(shown, F.when(is_quantified(text) | has_keyword(text, STRONG), "strong").otherwise("medium"))
        .when((blank(doc_type) == "cover_letter") | column(kind).isin("preference", "education"), "medium")
        .otherwise("weak")
    )


def is_question(text) -> Column:
    t = F.trim(blank(text))
    return t.endswith("?") | t.rlike(r"^[1-9]\.")


def prompt_and_answer(text) -> Column:
    """struct(prompt, answer): at the first mark of the ordered list that occurs, else at the last `?`; prompt may be NULL."""
    t = blank(text)
    at = F.length(t) - F.locate("?", F.reverse(t)) + 1
    inner = t.contains("?") & ~F.trim(t).endswith("?") & (F.trim(F.substring(t, at + 1, F.length(t))) != "")
    pair = lambda p, a: F.struct(p.alias("prompt"), a.alias("answer"))
    out = F.when(inner, pair(F.concat(F.trim(F.substring(t, F.lit(1), at - 1)), F.lit("?")), F.trim(F.substring(t, at + 1, F.length(t))))).otherwise(pair(F.lit(None).cast("string"), t))
    for mark in reversed(ANSWER_MARKS):
        k = F.locate(mark, t)
        out = F.when(k > 0, pair(F.trim(F.substring(t, F.lit(1), k)), F.trim(F.regexp_replace(F.substring(t, k + 1, F.length(t)), "^[ )]+", "")))).otherwise(out)
    return out


def cleaned(text) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(blank(text), r"^\([^)]*\)", ""), r"(?U)\s+", " "))


def cleaned_lines(text, before: Callable[[Column], Column] | None = None) -> Column:
    """The cleaned lines of a text as an array; exploded, a line is cleaned once, however often later conditions read it.

    `before` gives what stands before a line, from its place."""
    return F.transform(F.split(text, "\n"), lambda t, i: cleaned(t if before is None else F.concat(before(i), t)))


def keeps(text, boilerplate: tuple = ("resume honest", "for this posting")) -> Column:
    t = blank(text)
    return (F.length(F.trim(t)) >= 20) & ~is_contact(t) & ~is_question(t) & ~has_keyword(t, boilerplate)


def style_notes(text, rules: list[tuple[str, tuple]]) -> Column:
    """Notes whose keywords occur, in rule order."""
    return F.filter(F.array(*[F.when(has_keyword(text, words), F.lit(n)) for n, words in rules]), lambda x: x.isNotNull())


def section_of(upper: Column) -> Column:
    return F.when(upper.contains("SKILLS"), "skills").when(upper.contains("PROJECT"), "projects").when(upper.contains("EXPERIENCE"), "experience").when(upper.contains("EDUCATION"), "education").otherwise("")


def resume_sections(paragraphs: DataFrame, doc: str = "doc", idx: str = "idx", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Evidence paragraphs of résumés with section and organisation or project.

    Tests run in order: contact, heading, date line, organisation, project, too short, evidence. A heading that
    names no section resets it (the empty string); organisation and project last to the end of the document, and
    a project beats an organisation.
    """
    t = F.col(text)
    p = paragraphs.withColumn("__contact", is_contact(t)).withColumn("__heading", ~F.col("__contact") & is_heading(t))
    p = carry_forward(p.withColumn("__named", F.when(F.col("__heading"), section_of(F.upper(t)))), doc, idx, {"__section": "__named"}, block)
    p = p.withColumn("__section", F.coalesce("__section", F.lit("")))
    free = ~F.col("__contact") & ~F.col("__heading") & ~is_date_line(t)
    org = free & t.contains("|") & (F.col("__section") == "experience")
    project = free & ~org & (F.col("__section") == "projects") & t.rlike(r"\(\d{4}\)")
    p = p.withColumn("__said", F.when(org, F.trim(F.substring_index(text, "|", 1)))).withColumn("__begun", F.when(project, F.trim(F.substring_index(text, "(", 1))))
    p = carry_forward(p.withColumn("__kept", free & ~org & ~project & (F.length(t) >= 12)), doc, idx, {"__org": "__said", "__project": "__begun"}, block)
    out = p.where("__kept").withColumn("section", F.col("__section")).withColumn("organisation", F.coalesce("__project", "__org"))
    return out.drop("__contact", "__heading", "__named", "__section", "__said", "__begun", "__kept", "__org", "__project")


def carry_question(rows: DataFrame, doc: str, idx: str, is_prompt: Column, text: str, out: str, block: int = BLOCK) -> DataFrame:
    """The last prompt strictly before each row, or the row's own if it is a prompt."""
    return carry_forward(rows.withColumn("__asked", F.when(is_prompt, F.col(text))), doc, idx, {out: "__asked"}, block).drop("__asked")


#: Words that mark a text about the résumé itself, and starts of prompts and courtesies.
ABOUT_RESUME = ("your resume", "resume honest", "for this posting")
PROMPT_STARTS = ("why are you interested", "in 3", "tell us about", "describe a political", "describe an engineering tool", "what should the requirements.txt")
COURTESIES = ("thank you for considering", "please see my resume", "i would welcome an opportunity")
MIN_CHARS, PROMPT_WORDS = 25, 12


def narrative_paragraphs(paragraphs: DataFrame, doc: str = "doc", idx: str = "idx", text: str = "text", kind: str = "doc_type", names: tuple = (), block: int = BLOCK) -> DataFrame:
    """Evidence paragraphs of letters and of questions with answers: the text, and the place with the question that it answers.

    In documents of kind application_qa a prompt inside a paragraph becomes the question and the rest the text; a
    paragraph that is a question only becomes the question and is no evidence. A question lasts until the next one. Contact
    lines, remarks about the résumé, courtesies of cover letters and texts below MIN_CHARS are no evidence, but a prompt before
    such a text counts. The place names the question's first PROMPT_WORDS words, unless it is the text itself.
    """
    qa = F.coalesce(F.col(kind) == "application_qa", F.lit(False))
    split = prompt_and_answer(text)
    p = paragraphs.withColumn("__split", F.when(qa, split))
    p = p.withColumn("__text", F.when(blank(F.col("__split.answer")) != "", F.col("__split.answer")).otherwise(blank(text)))
    aside = is_contact("__text", names) | has_keyword("__text", ABOUT_RESUME)
    asks = ~aside & qa & (is_question("__text") | _starts(F.lower(F.trim("__text")), PROMPT_STARTS))
    asked = F.when(asks, F.col("__text")).when(qa & (blank(F.col("__split.prompt")) != ""), F.col("__split.prompt"))
    courtesy = F.coalesce(F.col(kind) == "cover_letter", F.lit(False)) & _starts(F.lower("__text"), COURTESIES)
    p = p.withColumn("__asked", asked).withColumn("__kept", ~aside & ~asks & ~courtesy & (F.length("__text") >= MIN_CHARS))
    p = carry_forward(p, doc, idx, {"question": "__asked"}, block).where("__kept")
    place = F.concat(F.lit("paragraph_"), F.col(idx).cast("string"))
    place = F.when(F.coalesce(F.col("question") != F.col("__text"), F.lit(False)), F.concat(place, F.lit(" | prompt="), summary("question", PROMPT_WORDS))).otherwise(place)
    return p.withColumn("location", place).withColumn(text, F.col("__text")).drop("__split", "__text", "__asked", "__kept")


def two_sections(paragraphs: DataFrame, starts: dict[str, Column], first: int = 10, doc: str = "doc", idx: str = "idx", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Marker paragraphs switch the section; the others are numbered inside it, and the first `first` of each are kept."""
    mark = F.coalesce(*[F.when(c, F.lit(n)) for n, c in starts.items()])
    p = carry_forward(paragraphs.withColumn("__mark", mark), doc, idx, {"section": "__mark"}, block).where("__mark is null and section is not null")
    ranked = p.withColumn("pos", F.row_number().over(Window.partitionBy(doc, "section").orderBy(idx)))
    return ranked.where(F.col("pos") <= first).drop("__mark")


def supporting_ids(rules: list[tuple[str, Column]], evidence: DataFrame, key: str) -> DataFrame:
    """(item, key): the distinct ids of the evidence that meets each item's condition, one row each."""
    hit = F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())).alias("item")
    return evidence.select(hit, key).distinct()


def folded_ids(supporting: DataFrame, key: str) -> DataFrame:
    """(item, ids): the sorted ids of each item in one row, for profiles whose items have a few thousand pieces at most."""
    return supporting.groupBy("item").agg(F.array_sort(F.collect_list(key)).alias("ids"))


def references(rules: list[tuple[str, Column]]) -> Column:
    """Sorted distinct names of the rules (name, condition) that a row meets."""
    return F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())))


def tag_entries(evidence: DataFrame, tags: str, key: str, context: Column) -> DataFrame:
    """Per tag: number of distinct supporting ids and sorted distinct contexts.

    Whole-number ids are counted exactly by bitmaps of 32,768 ids, combined on the map side and summed by tag, so no id of a hot tag is
    shuffled; other ids become distinct rows first. Contexts are united inside the same buckets.
    """
    rows = evidence.select(F.col(key).alias("__id"), F.explode(tags).alias("tag"), context.alias("context"))
    if isinstance(evidence.schema[key].dataType, IntegralType):
        at = F.col("__id").cast("long")
        rows = rows.withColumn("__bucket", F.bitmap_bucket_number(at))
        parts = rows.groupBy("tag", "__bucket").agg(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(at))).alias("n"), F.collect_set("context").alias("c"))
    else:
        parts = rows.groupBy("tag", "__id").agg(F.collect_set("context").alias("c")).select("tag", F.col("__id").isNotNull().cast("long").alias("n"), "c")
    found = parts.groupBy("tag").agg(F.sum("n").alias("n_ids"), F.flatten(F.collect_set("c")).alias("contexts"))
    return found.select("tag", "n_ids", F.array_sort(F.array_distinct("contexts")).alias("contexts"))


def add_summary(df: DataFrame, text: str, words: int = 20) -> DataFrame:
    return df.withColumn("normalized_summary", summary(text, words))
