"""Board checks: listing and detail joins, assessments, provider waterfall, target selection, discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, column, company_fingerprint
from .registry import ABSENT

#: Status texts of companies whose board gave no listing.
NO_CANDIDATES, NO_OPEN_JOBS = "No slug candidates", "No open jobs"

#: Tokens that discovery drops from the end of a name.
DISCOVERY_SUFFIXES = ("co", "company", "corp", "corporation", "inc", "llc", "service", "services", "enterprise", "enterprises", "group", "holding", "holdings", "management", "technology", "technologies")
#: Site ids to try, and host numbers.
SITE_IDS = ("jobs", "Jobs", "careers", "Careers", "Search", "external", "External")
HOSTS = tuple(f"wd{i}" for i in range(1, 6))


def match_details(listings: DataFrame, details: DataFrame, keys: list[str], place_ok: Column, job_ok: Column | None = None) -> DataFrame:
    """Title-matched listings with their details: adds location_matched and is_match; a missing detail is no job.

    `details` carries the column `has_detail`; filters on the listing side stay below the join. With `job_ok` a
    place can match without there being a job.
    """
    joined = listings.join(details, keys, "left")
    matched = F.col("title_matched") & F.coalesce(F.col("has_detail"), F.lit(False))
    return joined.withColumn("location_matched", matched & F.coalesce(place_ok, F.lit(False))).withColumn("is_match", F.col("location_matched") & (F.lit(True) if job_ok is None else F.coalesce(job_ok, F.lit(False))))


def assess(matches: DataFrame, board: str) -> DataFrame:
    """Per board: jobs seen, matched jobs, any title match, any place match, and the status text."""
    sums = matches.groupBy(board).agg(F.count("*").alias("jobs_seen"), F.count_if("is_match").alias("matched_job_count"), F.bool_or("title_matched").alias("any_title"), F.bool_or("location_matched").alias("any_location"))
    status = F.when(F.col("matched_job_count") > 0, "Matched").when(F.col("any_title") & ~F.col("any_location"), "No matching locations").otherwise("No matching job titles")
    return sums.withColumn("status", status)


def with_hint(targets: DataFrame, hints: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Targets that have a hint (left_semi) or all targets with their hint (left)."""
    return targets.join(hints, key, how)


def select_targets(candidates: DataFrame, limit: int, seq: str = "seq") -> DataFrame:
    """Candidates (seq, negative, cached) in order: selected until the limit-th, skipped ones before it, nothing after.

    The default list of companies is a configuration of a few hundred names, so one ordered window is enough;
    the running count is taken over per-block sums, so that no task sees more than a block of the list.
    """
    block = F.floor(F.col(seq) / 10_000)
    chosen = candidates.withColumn("selected", ~(F.col("negative") | F.col("cached"))).withColumn("__block", block)
    per = chosen.groupBy("__block").agg(F.count_if("selected").alias("__n"))
    before = per.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__block", "__before")
    inside = F.sum(F.col("selected").cast("int")).over(Window.partitionBy("__block").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    counted = chosen.join(before, "__block").withColumn("__run", F.col("__before") + inside)
    kept = counted.where((F.col("selected") & (F.col("__run") <= limit)) | (~F.col("selected") & (F.col("__run") < limit)))
    status = F.when(F.col("selected"), "selected").when(F.col("negative"), "Skipped (known negative)").otherwise("Skipped (already searched)")
    return kept.withColumn("status", status).drop("__block", "__before", "__run")


def partition_targets(targets: DataFrame, explicit: DataFrame, hints: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(direct targets: explicit and hinted; all other targets)."""
    direct = explicit.join(hints.select(key), key, "left_semi").select(key).distinct()
    return targets.join(direct, key, "left_semi"), targets.join(direct, key, "left_anti")


def waterfall_targets(targets: DataFrame, hints: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """Targets of the next provider: hinted ones whose latest outcome is not a match; outcomes (key, provider, matched)."""
    latest = outcomes.groupBy(key).agg(F.max_by("matched", "provider").alias("matched"))
    return targets.join(hints.select(key).distinct(), key, "left_semi").join(latest.where("matched"), key, "left_anti")


def waterfall_override(assessments: DataFrame, jobs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The last provider's assessment of each company and that provider's jobs only."""
    rest = [c for c in assessments.columns if c != key]
    final = assessments.groupBy(key).agg(F.max_by(F.struct(*rest), "provider").alias("a")).select(key, "a.*")
    return final, jobs.join(final.select(key, "provider"), [key, "provider"], "left_semi")


def first_success(attempts: DataFrame, key: str) -> DataFrame:
    """First non-empty board in attempt order; a not_found moves on, other errors stop, the last empty board stays.

    attempts: (key, attempt_no, board, outcome, jobs) with outcome ok, not_found or an error text. The status is ok or
    a text that provider_status() reads.
    """
    ok = F.col("outcome") == "ok"
    stops = (ok & (F.col("jobs") > 0)) | ~F.col("outcome").isin("ok", "not_found")
    stop = F.min(F.when(stops, F.struct("attempt_no", "board", "outcome", "jobs"))).alias("stop")
    empty = F.max(F.when(ok & (F.col("jobs") == 0), F.struct("attempt_no", "board"))).alias("empty")
    g = attempts.groupBy(key).agg(stop, empty)
    status = F.when(F.col("stop.outcome") == "ok", "ok").when(F.col("stop").isNotNull(), F.col("stop.outcome")).when(F.col("empty").isNotNull(), NO_OPEN_JOBS).otherwise(ABSENT["board1"][0])
    return g.select(key, F.when(status == "ok", F.col("stop.board")).when(status == NO_OPEN_JOBS, F.col("empty.board")).alias("board"), status.alias("status"))


def board_statuses(targets: DataFrame, resolved: DataFrame, assessed: DataFrame, key: str) -> DataFrame:
    """Each target's status text and counts: the assessment of the board that it resolved to, else why there is none.

    resolved (key, board, status) from first_success(), assessed (board, jobs_seen, matched_job_count, status).
    """
    seen = assessed.select(F.col("board"), "jobs_seen", "matched_job_count", F.col("status").alias("__assessed"))
    out = targets.select(key).join(resolved.select(key, "board", F.col("status").alias("__resolved")), key, "left").join(seen, "board", "left")
    status = F.when(F.col("__resolved").isNull(), NO_CANDIDATES).when(F.col("__resolved") == "ok", F.coalesce("__assessed", F.lit(NO_OPEN_JOBS))).otherwise(F.col("__resolved"))
    zero = F.lit(0).cast("long")
    return out.select(key, "board", status.alias("status"), F.coalesce("jobs_seen", zero).alias("jobs_seen"), F.coalesce("matched_job_count", zero).alias("matched_job_count"))


def explicit_targets(names: DataFrame, limit: int | None, key: str, seq: str = "seq") -> DataFrame:
    """Names asked for one by one: the first `limit` of the list, repeats counted, then one row for each key; no skip tables."""
    first = names if limit is None else names.orderBy(seq).limit(limit)
    rest = [c for c in names.columns if c != key]
    return first.groupBy(key).agg(F.min_by(F.struct(*rest), seq).alias("__r")).select(key, "__r.*")


def _listed(*cs) -> Column:
    return F.array_distinct(F.filter(F.array(*cs), lambda x: F.coalesce(x, F.lit("")) != ""))


def slug_candidates(name, hints=None) -> Column:
    """Hinted slugs, then forms of the name's tokens, in order and distinct."""
    t = F.regexp_extract_all(F.lower(column(name)), F.lit("[a-z0-9]+"), F.lit(0))
    first, last = F.get(t, F.lit(0)), F.get(t, F.size(t) - 1)
    many = F.size(t) > 1
    forms = [F.array_join(t, ""), F.array_join(t, "-"), F.array_join(t, "_"), F.when(many, first), F.when(many, F.concat(first, last)), F.when(many, F.concat(first, F.lit("-"), last))]
    hinted = F.coalesce(hints, F.array().cast("array<string>")) if hints is not None else F.array().cast("array<string>")
    trimmed = F.transform(F.concat(hinted, F.array(*forms)), lambda x: F.regexp_replace(x, "^[-_]+|[-_]+$", ""))
    return F.when(F.size(t) > 0, F.array_distinct(F.filter(trimmed, lambda x: F.coalesce(x, F.lit("")) != ""))).otherwise(F.array().cast("array<string>"))


def _discovery_tokens(name) -> Column:
    t = F.filter(F.split(company_fingerprint(name), " "), lambda w: ~w.rlike("^[a-z]$") & (w != ""))
    bare = F.regexp_replace(F.concat(F.lit(" "), F.array_join(t, " ")), f"( ({'|'.join(DISCOVERY_SUFFIXES)}))+$", "")
    return F.filter(F.split(F.trim(bare), " "), lambda w: w != "")


def tenant_candidates(name) -> Column:
    """Compact name, then first token, last token and first two tokens of longer names."""
    t = _discovery_tokens(name)
    many = F.size(t) > 1
    return _listed(F.array_join(t, ""), F.when(many, F.get(t, F.lit(0))), F.when(many, F.get(t, F.size(t) - 1)), F.when(many, F.array_join(F.slice(t, 1, 2), "")))


def site_candidates(name) -> Column:
    """Common site ids, then branded forms over all tokens and over the trimmed ones."""
    every, out = F.filter(F.split(company_fingerprint(name), " "), lambda w: w != ""), [F.lit(s) for s in SITE_IDS]
    for t in (every, _discovery_tokens(name)):
        pascal = F.array_join(F.transform(t, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")
        compact = F.array_join(t, "")
        out += [F.when(F.size(t) > 0, F.concat(base, F.lit(end))) for base in (pascal, compact) for end in ("Careers", "Jobs")]
    return _listed(*out)


def board_candidates(companies: DataFrame, key: str, name: str) -> DataFrame:
    """Board addresses to probe in order: tenant x host x site x form; probe_key groups the forms of one site.

    A key's names can lead to the same tenant and site, so those are made distinct first, in as many tasks as the session shuffles to;
    hosts and forms, the same for all, are added to the distinct ones one by one and are held by no task. Each probe_key has one row of every form.
    """
    parts = int(companies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = companies.select(key, name).repartition(parts, key).select(key, F.posexplode(tenant_candidates(name)).alias("t", "tenant"), site_candidates(name).alias("sites"))
    rows = rows.select(key, "tenant", "t", F.posexplode("sites").alias("s", "site_id"))
    rows = rows.groupBy(key, "tenant", "site_id").agg(F.min(F.col("t").cast("long") * (1 << 31) + F.col("s")).alias("__at"))
    rows = rows.select("*", F.posexplode(F.array(*map(F.lit, HOSTS))).alias("h", "host"))
    forms = F.array(*[F.concat(F.lit("https://"), F.col("tenant"), F.lit("."), F.col("host"), F.lit(".myworkdayjobs.com"), F.lit(a), F.col("site_id"), F.lit(b)) for a, b in (("/en-US/", ""), ("/en-US/", "/jobs"), ("/", ""))])
    rows = rows.select("*", F.posexplode(forms).alias("f", "board_url"))
    probe = F.concat_ws("|", F.concat("tenant", F.lit("."), "host", F.lit(".myworkdayjobs.com")), "tenant", "site_id")
    at = (F.shiftright("__at", 31)).cast("int").alias("t"), F.col("h"), (F.col("__at") % (1 << 31)).cast("int").alias("s"), F.col("f")
    return rows.select(key, "tenant", "site_id", "board_url", probe.alias("probe_key"), F.struct(*at).alias("order"))


def discovery_verdict(probes: DataFrame, key: str, connected: bool | DataFrame = True) -> DataFrame:
    """Verdict per company over landed probes (candidate_order, outcome, board_url); without a connection all retry.

    The first confirmed or failing probe in order decides; if there is none the company is not found.
    """
    first = F.min(F.when(F.col("outcome") != "not_found", F.struct("candidate_order", "outcome", "board_url"))).alias("hit")
    g = probes.groupBy(key).agg(first)
    outcome = F.when(F.lit(connected), F.when(F.col("hit").isNull(), "not_found").when(F.col("hit.outcome") == "confirmed", "confirmed").otherwise("needs_retry")).otherwise("needs_retry")
    return g.select(key, outcome.alias("outcome"), F.when(F.lit(connected) & (F.col("hit.outcome") == "confirmed"), F.col("hit.board_url")).otherwise("").alias("board_url"))


def grouped_verdict(probes: DataFrame, key: str, connected: bool = True) -> DataFrame:
    """Verdict per company over probe groups: (key, outcome, board_url, tenant, site_id).

    probes (key, group_no, form_no, outcome, reachable, board_url, tenant, site_id): a group is one site, its forms are addresses
    of that site. The outcome of a group is that of its first form: `confirmed` and `error` end the search in group order,
    anything else (not_found, malformed) moves on. A confirmed board's address is the first reachable form of its group, or its first form.
    Without a connection every company is to be tried again. Both levels are combined before the shuffles.
    """
    first = F.min_by(F.struct("outcome", "board_url", "tenant", "site_id"), "form_no").alias("first")
    answers = F.min_by("board_url", F.when(F.col("reachable"), F.col("form_no"))).alias("answers")
    groups = probes.groupBy(key, "group_no").agg(first, answers)
    ends = F.when(F.col("first.outcome").isin("confirmed", "error"), F.col("group_no"))
    g = groups.groupBy(key).agg(F.min_by(F.struct("first.outcome", F.coalesce("answers", "first.board_url").alias("board_url"), "first.tenant", "first.site_id"), ends).alias("hit"))
    found = F.lit(connected) & (F.col("hit.outcome") == "confirmed")
    part = lambda c: F.when(found, F.coalesce(F.col(f"hit.{c}"), F.lit(""))).otherwise("").alias(c)
    outcome = F.when(F.lit(connected), F.coalesce("hit.outcome", F.lit("not_found"))).otherwise("needs_retry")
    return g.select(key, outcome.alias("outcome"), *[part(c) for c in ("board_url", "tenant", "site_id")])


def named(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("company_key", company_fingerprint(name)).withColumn(name, clean(name))
