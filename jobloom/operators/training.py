"""Chat-format training examples and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import blank, summary

ROLES = ("system", "user", "assistant")
MIN_EXAMPLES = 100


def examples(jobs: DataFrame, variants: DataFrame, key: str, family: str, system: Column, user: Column, assistant: Column) -> DataFrame:
    """One example for each job and variant of its family: messages array<struct<role, content>>.

    variants (family, task, variant, ord) is a small template table; the texts are expressions over both sides.
    """
    rows = jobs.join(variants.withColumnRenamed("family", family), family)
    part = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return rows.select(key, "task", "variant", "ord", F.array(part("system", system), part("user", user), part("assistant", assistant)).alias("messages"))


def reject_reason(messages: Column, roles: tuple = ROLES) -> Column:
    """The first failing rule of an example, NULL if it is valid."""
    content = F.transform(messages, lambda m: m["content"])
    return (
        F.when(messages.isNull(), "missing messages")
        .when(F.size(messages) != len(roles), "wrong number of messages")
        .when(~F.coalesce(F.transform(messages, lambda m: m["role"]) == F.array(*map(F.lit, roles)), F.lit(False)), "wrong roles")
        .when(F.exists(content, lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""), "empty content")
    )


def validate(df: DataFrame, messages: str = "messages", roles: tuple = ROLES, counts: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid examples, rejects with a reason).

    An observation gets examples and rejected of the pass that writes or counts the valid ones, so the gate needs no scan of its own.
    """
    marked = df.withColumn("reason", reject_reason(F.col(messages), roles))
    seen = marked if counts is None else marked.observe(counts, F.count_if(F.expr("reason is null")).alias("examples"), F.count_if(F.expr("reason is not null")).alias("rejected"))
    return seen.where("reason is null").drop("reason"), marked.where("reason is not null")


def passes(counts: Observation, least: int = MIN_EXAMPLES) -> bool:
    """gate() by the numbers of a pass that validate() observed."""
    return counts.get["examples"] >= least


def gate(valid: DataFrame, least: int = MIN_EXAMPLES) -> DataFrame:
    """(examples, passed): whether there are enough valid examples."""
    return valid.agg(F.count("*").alias("examples")).withColumn("passed", F.col("examples") >= least)


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def unsupported(required: DataFrame, supported: DataFrame, item: str) -> DataFrame:
    """Required items with no supporting id; supported has a row for each item and id, null where there is none."""
    return required.join(supported.where(F.col("id").isNotNull()).select(item).distinct(), item, "left_anti")


def count_violations(counts: DataFrame, expected: DataFrame, family: str) -> DataFrame:
    """Elements (family, element, n) whose number differs from the family's expected one; absent ones count as 0."""
    both = expected.join(counts, [family, "element"], "left")
    return both.where(F.coalesce("n", F.lit(0)) != F.col("expected")).select(family, "element", F.coalesce("n", F.lit(0)).alias("n"), "expected")


def focus_phrase(tags: Column, requirements: Column, responsibilities: Column, words: int = 16) -> Column:
    """First four tags, then the first requirement, else the first responsibility, cut to `words` words."""
    line = F.coalesce(F.get(requirements, F.lit(0)), F.get(responsibilities, F.lit(0)), F.lit(""))
    return F.concat_ws("; ", F.nullif(F.array_join(F.slice(tags, 1, 4), ", "), F.lit("")), F.nullif(summary(line, words), F.lit("")))


def skill_list(job_tags: Column, evidence_tags: Column, limit: int = 10) -> Column:
    """Job tags first, then sorted evidence tags, distinct, the first `limit`."""
    return F.slice(F.array_distinct(F.concat(job_tags, F.array_sort(evidence_tags))), 1, limit)


def lines(items: Column, mark: str = "- ") -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit(mark), blank(x))), "\n")
