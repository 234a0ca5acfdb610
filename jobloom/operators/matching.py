"""Title, location and keyword matching. Phrase and tag tables are parameters."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, clean, column, first_filled, match_text

#: Titles by family, in order.
TITLE_FAMILIES = {
    "software_engineering": ("Software Engineer", "Python Software Engineer", "Python Software Developer", "Senior Software Engineer", "Senior Developer", "Backend Developer", "Backend Software Engineer", "Programmer", "Python Developer", "Python Programmer", "Applications Developer", "Applications Engineer", "Developer", "Data Engineer", "Senior Data Engineer", "Bioinformatics Software Engineer", "Software Engineer in Bioinformatics", "Bioinformatics Scientist", "Bioinformatics Engineer", "Bioinformatician", "AI Engineer", "Product Engineer", "DevOps Engineer", "QA Engineer", "Quality Assurance Engineer", "Test Engineer"),
    "solutions_engineering": ("Solutions Engineer", "Technical Account Manager", "Customer Success Engineer", "Customer Solutions Engineer", "Solutions Architect", "Implementation Specialist", "Integration Specialist", "Technical Trainer", "Training Specialist", "Customer Onboarding Specialist", "Technical Coordinator"),
    "technical_support_engineering": ("Technical Support Engineer", "Tier 2 Support", "Tier 3 Support", "Scientific Support Specialist", "Technical Support Specialist", "Product Support Specialist", "Application Specialist", "IT Help Desk Representative"),
    "technical_writing": ("Technical Writer",),
}
#: A title that holds one of these never matches.
EXCLUDED_TITLES = ("account executive", "sales representative", "sales development representative", "business development representative", "revenue operations", "field sales")
#: Place patterns.
CITY = r"(?i)\baustin(?:\s*,)?\s*(?:tx|texas)\b"
REMOTE = r"(?i)\b(remote|distributed|work from home|home based)\b"
COUNTRY = r"(?i)\b(?:united states|u\.?\s*s\.?\s*a?\.?)\b"


def _pattern(phrase: str) -> str:
    words = re.sub(r"[^a-z0-9+&.-]+", " ", re.sub(r"[_/|]+", " ", phrase.lower())).split()
    return r"\b" + r"\s+".join(re.sub(r"([.+&-])", r"\\\1", w) for w in words) + r"\b"


def title_matches(title, families: dict = TITLE_FAMILIES, excluded: tuple = EXCLUDED_TITLES) -> Column:
    """struct(keywords, families): all phrases found on word borders, in table order."""
    text = match_text(title)
    none = F.array().cast("array<string>")
    found = {f: F.filter(F.array(*[F.when(text.rlike(_pattern(p)), F.lit(p.lower())) for p in phrases]), lambda x: x.isNotNull()) for f, phrases in families.items()}
    out = F.lit(False)
    for word in excluded:
        out = out | text.contains(word)
    keywords = F.array_distinct(F.flatten(F.array(*found.values())))
    names = F.filter(F.array(*[F.when(F.size(x) > 0, F.lit(f)) for f, x in found.items()]), lambda x: x.isNotNull())
    return F.struct(F.when(out, none).otherwise(keywords).alias("keywords"), F.when(out, none).otherwise(names).alias("families"))


def is_target_place(place, city: str = CITY, remote: str = REMOTE, country: str = COUNTRY) -> Column:
    text = clean(place)
    return text.rlike(city) | (text.rlike(remote) & text.rlike(country))


def place_name(city, country, listed) -> Column:
    city, country, listed = clean(city), clean(country), clean(listed)
    return F.when((city != "") & (country != ""), F.concat(city, F.lit(", "), country)).otherwise(first_filled(city, listed, country))


def is_target_posting_place(city, country, listed, remote_type, place_type, applicant_country, onsite: str = r"(?i)\bon[\s-]?site\b", hybrid: str = r"(?i)\bhybrid\b", patterns: tuple = (CITY, REMOTE, COUNTRY)) -> Column:
    """Ordered rules over structured places: a target place, no onsite or hybrid work, else remote inside the country."""
    name, kind, mode = place_name(city, country, listed), match_text(remote_type), match_text(place_type)
    is_remote = kind.rlike(patterns[1]) | (mode == "telecommute")
    in_country = clean(applicant_country).rlike(patterns[2]) | clean(country).rlike(patterns[2])
    return (
        F.when(is_target_place(name, *patterns), True)
        .when(kind.rlike(onsite) | name.rlike(onsite) | kind.rlike(hybrid) | name.rlike(hybrid), False)
        .when((match_text(name) != "") & ~match_text(name).rlike(patterns[1]), False)
        .otherwise(is_remote & in_country)
    )


def first_target_place(places, *singles, remote_country=None, patterns: tuple = (CITY, REMOTE, COUNTRY)) -> Column:
    """The first acceptable of many places, then of single fields, then `Remote, X` for remote work."""
    every = F.concat(F.coalesce(places, F.array().cast("array<string>")), F.array(*[clean(s) for s in singles]))
    if remote_country is not None:
        every = F.concat(every, F.array(remote_country))
    return F.coalesce(F.get(F.filter(F.transform(every, clean), lambda p: is_target_place(p, *patterns)), F.lit(0)), F.lit(""))


def locality(c) -> Column:
    """Drop a trailing `- CODE`; `SS City` becomes `City, SS`."""
    text = F.regexp_replace(clean(c), r"\s*-\s*[A-Z0-9]+$", "")
    return F.regexp_replace(text, r"^([A-Z]{2})\s+(.+)$", "$2, $1")


def snapshot_place(title, existing, city, country, applicant_country, place_type) -> Column:
    """Canonical place of a stored posting."""
    town, country, applicant = locality(city), clean(country), clean(applicant_country)
    hybrid = match_text(title).contains("hybrid") | match_text(existing).contains("hybrid")
    remote = (match_text(place_type) == "telecommute") & match_text(first_filled(applicant, country)).contains("united states")
    where = first_filled(town, applicant, country)
    return (
        F.when(hybrid, F.when(where == "", "Hybrid").otherwise(F.concat(F.lit("Hybrid - "), where)))
        .when(remote, "Remote - United States")
        .otherwise(first_filled(town, country, existing))
    )


def has_keyword(text, keywords) -> Column:
    """Whether a text holds any of the keywords, case aside."""
    out = F.lit(False)
    for k in keywords:
        out = out | F.lower(blank(text)).contains(k.lower())
    return out


def tags(text, table: dict[str, tuple]) -> Column:
    """Sorted distinct tags whose keywords occur in the lower-cased text."""
    return F.array_sort(F.filter(F.array(*[F.when(has_keyword(text, words), F.lit(t)) for t, words in table.items()]), lambda x: x.isNotNull()))


def first_rule(text, rules: list[tuple[str, tuple]], default: str) -> Column:
    """The outcome of the first rule one of whose needles occurs."""
    out = F.lit(default)
    for outcome, needles in reversed(rules):
        out = F.when(has_keyword(text, needles), F.lit(outcome)).otherwise(out)
    return out


def role_by_rules(title, description, title_rules, text_rules, default: str) -> Column:
    """Ordered title rules, then ordered rules over title and description."""
    both = F.concat_ws(" ", blank(title), blank(description))
    return F.coalesce(F.nullif(first_rule(title, title_rules, ""), F.lit("")), first_rule(both, text_rules, default))


def role_by_score(title, text, table: dict[str, tuple], default: str) -> Column:
    """Keyword hits in the text and twice those in the title; the best family, ties to table order."""
    hits = lambda c, words: sum((F.lower(blank(c)).contains(w).cast("int") for w in words), F.lit(0))
    scored = F.array(*[F.struct((hits(text, words) + 2 * hits(title, words)).alias("score"), F.lit(-i).alias("rank"), F.lit(name).alias("name")) for i, (name, words) in enumerate(table.items())])
    best = F.array_max(scored)
    return F.when(best["score"] > 0, best["name"]).otherwise(F.lit(default))


def infer_by_patterns(paragraphs: DataFrame, patterns: list[str], fallback: str, first: int = 15) -> DataFrame:
    """Per document: group 1 of the first pattern that hits in the first paragraph that has a hit (doc, idx, text)."""
    hits = F.array(*[F.struct(F.lit(k).alias("rank"), F.regexp_extract("text", p, 1).alias("value")) for k, p in enumerate(patterns)])
    found = paragraphs.where(F.col("idx") < first).select("doc", "idx", F.explode(hits).alias("h")).where(F.col("h.value") != "")
    best = found.groupBy("doc").agg(F.min_by("h.value", F.struct("idx", "h.rank")).alias("value"))
    return paragraphs.select("doc").distinct().join(best, "doc", "left").select("doc", F.coalesce(F.trim("value"), F.lit(fallback)).alias("value"))


def lookup(df: DataFrame, key: str, mapping: dict, out: str, default: str) -> DataFrame:
    """Attach a value of a small constant mapping."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return df.withColumn(out, F.coalesce(table[column(key)], F.lit(default)))


def ranked_labels(scores: DataFrame, key: str, defaults: list[tuple[str, str]], limit: int = 4) -> DataFrame:
    """(key, label, slot, score) rows -> ordered labels: best per slot, then defaults of free slots; first `limit`.

    Order is score then label, both descending; labels without a score are left out.
    """
    best = Window.partitionBy(key, "slot").orderBy(F.desc("score"), F.desc("label"))
    chosen = scores.where("score > 0").withColumn("rn", F.row_number().over(best)).where("rn = 1").groupBy(key).agg(F.collect_list(F.struct("score", "label", "slot")).alias("c"))
    ordered = F.reverse(F.array_sort(F.coalesce("c", F.array().cast("array<struct<score:bigint,label:string,slot:string>>"))))
    extra = F.filter(F.array(*[F.struct(F.lit(label).alias("label"), F.lit(slot).alias("slot")) for label, slot in defaults]), lambda d: ~F.exists(F.col("o"), lambda x: x["slot"] == d["slot"]))
    every = scores.select(key).distinct().join(chosen, key, "left").withColumn("o", ordered)
    return every.select(key, F.slice(F.concat(F.transform("o", lambda x: x["label"]), F.transform(extra, lambda x: x["label"])), 1, limit).alias("labels"))


def best_label(text, labels: list[tuple[str, tuple[str, ...]]], fallback: str) -> Column:
    """The label whose keywords occur most often in the normal text (earlier ones win ties), the fallback if none occurs."""
    t = match_text(column(text))
    scores = [F.struct(reduce(lambda a, b: a + b, [F.regexp_count(t, F.lit(re.escape(w))) for w in words]).alias("score"), F.lit(-k).alias("place"), F.lit(name).alias("label")) for k, (name, words) in enumerate(labels)]
    best = F.array_max(F.array(*scores))
    return F.when(best["score"] > 0, best["label"]).otherwise(fallback)


def focus(text, counts: dict[str, tuple[str, ...]], rules: list[tuple[str, Callable[[dict[str, Column]], Column]]], otherwise: str) -> Column:
    """The value of the first rule that holds for the keyword counts of the normal text; each rule gets them by name."""
    t = match_text(column(text))
    seen = {name: reduce(lambda a, b: a + b, [F.regexp_count(t, F.lit(re.escape(w))) for w in words]) for name, words in counts.items()}
    return F.coalesce(*[F.when(rule(seen), F.lit(value)) for value, rule in rules], F.lit(otherwise))
