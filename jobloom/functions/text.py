"""Text normalisation as Column expressions. An empty string is the missing value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal suffixes that do not tell companies apart.
LEGAL_SUFFIXES = ("co", "company", "corp", "corporation", "inc", "incorporated", "llc", "lp", "ltd", "limited", "na", "plc", "pty", "sa", "si")


def column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c) -> Column:
    return F.coalesce(column(c).cast("string"), F.lit(""))


def filled(c) -> Column:
    """NULL where a value is missing, for use in coalesce."""
    return F.nullif(column(c), F.lit(""))


def first_filled(*cs) -> Column:
    """The first value that is not missing, else the empty string."""
    return F.coalesce(*[filled(c) for c in cs], F.lit(""))


def clean(c) -> Column:
    """Display text: every run of Unicode white space becomes one space; trimmed."""
    return F.trim(F.regexp_replace(blank(c), r"(?U)\s+", " "))


def match_text(c) -> Column:
    """Lower-case text for matching: only a-z, 0-9, + & . - and single spaces are left."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(blank(c)), r"[_/|]+", " "), r"[^a-z0-9+&.-]+", " "))


def company_fingerprint(c) -> Column:
    """What identifies a company: tokens before the first comma or semicolon, initials merged, suffixes dropped."""
    text = F.regexp_replace(F.lower(clean(c)), r"\([^)]*\)", " ")
    head = F.regexp_extract(F.replace(text, F.lit("&"), F.lit(" and ")), r"^[^,;]*", 0)
    spaced = F.regexp_replace(F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(head, F.lit("[a-z0-9]+"), F.lit(0)), "  "), F.lit(" ")), r" ([a-z]) ", "<$1>")
    merged = F.regexp_replace(F.replace(spaced, F.lit("><"), F.lit("")), "[<> ]+", " ")
    bare = F.regexp_replace(F.concat(F.lit(" "), F.trim(merged)), f"( ({'|'.join(LEGAL_SUFFIXES)}))+$", "")
    return F.trim(bare)


def compact_key(c) -> Column:
    return F.replace(company_fingerprint(c), F.lit(" "), F.lit(""))


def job_id_text(c, from_integer: bool = False) -> Column:
    """Ids as text: integers as they are, other values cleaned; falsy ones other than integers are missing."""
    return F.coalesce(column(c).cast("string"), F.lit("")) if from_integer else clean(c)


def slug(c, mark: str = "_") -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(blank(c)), "[^a-z0-9]+", mark), f"^{mark}+|{mark}+$", "")


def title_from_slug(c) -> Column:
    return F.array_join(F.transform(F.split(blank(c), "[-_]+"), lambda w: F.initcap(w)), " ")


def summary(c, words: int = 20) -> Column:
    """The first words of a text; a cut text loses trailing .,;: and gains three dots."""
    parts = F.filter(F.split(blank(c), r"(?U)\s+"), lambda w: w != "")
    return F.when(F.size(parts) <= words, blank(c)).otherwise(F.concat(F.regexp_replace(F.array_join(F.slice(parts, 1, words), " "), "[.,;:]+$", ""), F.lit("...")))


def tokens(c, stop: tuple[str, ...] = ()) -> Column:
    """Distinct matching tokens of three characters or more that are not stop words."""
    kept = F.filter(F.split(match_text(c), " "), lambda w: F.length(w) >= 3)
    return F.array_except(kept, F.array(*map(F.lit, stop)).cast("array<string>")) if stop else F.array_distinct(kept)


def iso_date(c) -> Column:
    """A date written exactly yyyy-MM-dd, else NULL."""
    return F.when(column(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(column(c), "yyyy-MM-dd"))


#: Fixed value: a month and a year.
MONTH_YEAR = r"(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)\s+\d{4}"


def dates_mentioned(c) -> Column:
    return F.regexp_extract_all(blank(c), F.lit(MONTH_YEAR + r"|(?:19|20)\d{2}"), F.lit(0))


def is_quantified(c) -> Column:
    return blank(c).rlike(r"\b\d")


def labelled_line(c) -> Column:
    """struct(label, separator, body) split at the first of ` – `, ` — `, `: `."""
    text, out = blank(c), F.struct(F.lit("").alias("label"), F.lit(": ").alias("separator"), clean(c).alias("body"))
    for mark in (": ", " — ", " – "):
        at = F.locate(mark, text)
        part = F.struct(clean(F.substring(text, F.lit(1), at - 1)).alias("label"), F.lit(mark).alias("separator"), clean(F.substring(text, at + len(mark), F.length(text))).alias("body"))
        out = F.when(at > 0, part).otherwise(out)
    return out


def line_body(c) -> Column:
    at = F.locate(":", blank(c))
    return F.when(at > 0, clean(F.substring(blank(c), at + 1, F.length(blank(c))))).otherwise(clean(c))


def canonical_name(df, name: str, aliases, out: str = "canonical_name"):
    """Left join with the alias table (fingerprint, canonical); names without an alias are only cleaned.

    The alias table is a hint file loaded as a dimension; Spark broadcasts it when its size allows.
    """
    keyed = df.withColumn("__fp", company_fingerprint(name))
    joined = keyed.join(aliases.select(F.col("fingerprint").alias("__fp"), F.col("canonical").alias("__canonical")), "__fp", "left")
    return joined.withColumn(out, F.coalesce("__canonical", clean(name))).drop("__fp", "__canonical")
