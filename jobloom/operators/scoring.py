"""Evidence scored against jobs, and the best pieces of each job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import forget, kept_table


def tag_score(job_family: Column, job_tags: Column, role_tags: Column, skill_tags: Column, strong: Column, quantified: Column, bonus: Column | None = None) -> Column:
    """5 for the family, 3 for each shared skill, 2 if strong, 1 if quantified, and a bonus."""
    base = F.when(F.array_contains(role_tags, job_family), 5).otherwise(0) + 3 * F.size(F.array_intersect(job_tags, skill_tags))
    return base + F.when(strong, 2).otherwise(0) + F.when(quantified, 1).otherwise(0) + (bonus if bonus is not None else F.lit(0))


def top_by_tags(scored: DataFrame, job: str, limit: int = 8) -> DataFrame:
    """Best first (score, strong, id descending): scores above 0, one for each (organisation, summary), first `limit`."""
    order = [F.desc("score"), F.desc("strong"), F.desc("evidence_id")]
    one = Window.partitionBy(job, "organisation", "summary").orderBy(*order)
    first = scored.where("score > 0").withColumn("rn", F.row_number().over(one)).where("rn = 1")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(job).orderBy(*order))).where(F.col("rank") <= limit).drop("rn")


def select_by_tags(jobs: DataFrame, evidence: DataFrame, job: str, limit: int = 8, bonus: Column | None = None, job_marks: str | None = None, piece_marks: str | None = None) -> DataFrame:
    """Best pieces of each job by tags, through an inverted index instead of comparing all jobs with all pieces.

    jobs (job, family, tags), evidence (evidence_id, organisation, summary, role_tags, skill_tags, strong,
    quantified). Pieces that share no tag with a job can only score by themselves; the `limit` best of them, one
    for each (organisation, summary), stand in for all others, which is exact: whatever ranks above a piece by
    itself also ranks above it for the job. A bonus may only be given to pairs that share a tag, or a mark: arrays
    `job_marks` of jobs and `piece_marks` of evidence hold what else a bonus depends on, as words found in a text.

    A pair met through several tags counts once. Pieces are dealt by their id into as many tasks as the session shuffles to, as a small file
    can make many pairs, and are scored there while the jobs' tags are small enough for Spark to broadcast; one row for each job, organisation
    and summary leaves a task. Pieces without an id are left out.
    """
    none = F.array().cast("array<string>")
    every = lambda *names: _entries(0, F.concat(*[F.coalesce(F.col(n), none) for n in names if n]))
    marked = lambda name: [] if name is None else [_entries(2, F.coalesce(F.col(name), none))]
    rest = _entries(1, F.array(F.lit("")))
    wanted = jobs.select(job, F.explode_outer(F.concat(_entries(0, F.array("family")), every("tags"), rest, *marked(job_marks))).alias("__entry")).distinct()
    own = F.when(F.col("strong"), 2).otherwise(0) + F.when(F.col("quantified"), 1).otherwise(0)
    order = [F.desc("own"), F.desc("strong"), F.desc("evidence_id")]
    pieces = evidence.where(F.col("evidence_id").isNotNull()).repartition(_parts(evidence), "evidence_id")
    first = pieces.withColumn("own", own).withColumn("rn", F.row_number().over(Window.partitionBy("organisation", "summary").orderBy(*order)))
    best = first.where("rn = 1").orderBy(*order).limit(limit).select("evidence_id", F.lit(True).alias("__best"))  # at most `limit` rows
    entries = F.concat(every("role_tags", "skill_tags"), F.when(F.col("__best"), rest).otherwise(F.filter(rest, lambda e: F.lit(False))), *marked(piece_marks))
    offered = pieces.join(best, "evidence_id", "left").select(*evidence.columns, F.explode_outer(entries).alias("__entry"))
    scored = offered.join(wanted, "__entry").drop("__entry").join(jobs, job)
    score = tag_score(F.col("family"), F.col("tags"), F.col("role_tags"), F.col("skill_tags"), F.col("strong"), F.col("quantified"), bonus)
    return top_by_tags(scored.withColumn("score", score), job, limit)


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _entries(kind: int, tokens: Column) -> Column:
    return F.transform(F.array_distinct(tokens), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("token")))


#: Pairs of a job and a piece that a task counts: pieces are dealt into tasks by the number of jobs.
PAIRS_PER_TASK = 2_000_000


def _tasks(jobs: DataFrame, evidence: DataFrame) -> int:
    """As many tasks as the session shuffles to, or as keep the pairs of each below PAIRS_PER_TASK; counting reads no column."""
    return max(_parts(evidence), -(-jobs.count() * evidence.count() // PAIRS_PER_TASK))


def _matches(jobs: DataFrame, pieces: DataFrame, job: str, piece: str, carried: list[str], tasks: int) -> DataFrame:
    """(job, piece, overlap, carried columns) of all pairs that share an entry of `entries`, an inverted index.

    An entry is (kind, token); only those of kind 0 count. Pieces are dealt by their id first, so all entries of a pair meet
    where its piece is: pairs are counted in place and only pieces are shuffled, however many pairs a frequent token makes. What is
    carried is the piece's own, so it is part of the group: the buffer is one count, and the pairs of a task are hashed, not sorted.
    Entries of jobs are broadcast where Spark finds them small enough, and joined by token otherwise. The outer explode keeps
    Spark from adding a filter that makes all tokens a second time; its empty entries join nothing.
    """
    a = jobs.select(job, F.explode_outer("entries").alias("entry")).select(job, "entry.*")
    b = pieces.where(F.col(piece).isNotNull()).repartition(tasks, piece).select(piece, *carried, F.explode_outer("entries").alias("entry")).select(piece, *carried, "entry.*")
    return b.join(a, ["kind", "token"]).groupBy(piece, job, *carried).agg(F.count_if(F.col("kind") == 0).alias("overlap"))


def overlap_scores(jobs: DataFrame, evidence: DataFrame, job: str, piece: str, static: str) -> DataFrame:
    """(job, piece, overlap, score): 3 for each shared token plus the piece's own score, for pairs that share a token.

    Both sides have (id, tokens); evidence also has its static score. Ids of evidence are unique; rows without one, or without
    tokens, are in no pair. Every pair is a row of the result; `top_by_overlap` ranks pairs without shuffling them.
    """
    pairs = _matches(jobs.select(job, _entries(0, F.col("tokens")).alias("entries")), evidence.select(piece, static, _entries(0, F.col("tokens")).alias("entries")), job, piece, [static], _tasks(jobs, evidence))
    return pairs.select(job, piece, "overlap", static, (3 * F.col("overlap") + F.col(static)).alias("score"))


def top_by_overlap(jobs: DataFrame, evidence: DataFrame, job: str, piece: str, static: str, limit: int = 12, wants: str | None = None, has: str | None = None, bonus: int = 6) -> DataFrame:
    """Best pieces of each job by (score, strong) descending, then input order (seq); scores above 0.

    With arrays `wants` of jobs and `has` of evidence, a pair that shares an element scores `bonus` more. A piece that
    shares no token can still win by its own score or with the bonus, so the `limit` best pieces by that score, of all
    and of each element that is wanted, stand in for all the others: that is exact, as no job needs more of them. They are
    marked with entries of their own. Pieces are dealt by id (those without one are left out), and each task hands on its
    `limit` best of each job, so a token that all pieces hold costs counting in place and no shuffle. Null arrays are empty.
    """
    none = F.array().cast("array<struct<kind:int,token:string>>")
    order = [F.desc("__static"), F.desc("strong"), "seq"]
    own = evidence.select(piece, F.col(static).alias("__static"), "strong", "seq", "tokens", *([F.col(has).alias("__has")] if has else []))
    marks = own.orderBy(*order).limit(limit).select(piece, F.lit(1).alias("kind"), F.lit("").alias("token"))  # at most `limit` rows
    asked = _entries(0, F.col("tokens")), _entries(1, F.array(F.lit("")))
    if wants:
        tagged = own.select(piece, "__static", "strong", "seq", F.explode(F.array_distinct("__has")).alias("token"))
        tagged = tagged.join(jobs.select(F.explode(wants).alias("token")).distinct(), "token", "left_semi")  # `limit` rows of each wanted tag
        tagged = tagged.withColumn("rn", F.row_number().over(Window.partitionBy("token").orderBy(*order))).where(F.col("rn") <= limit)
        marks = marks.unionByName(tagged.select(piece, F.lit(2).alias("kind"), "token"))
        asked = *asked, _entries(2, F.col(wants))
    marks = marks.groupBy(piece).agg(F.collect_list(F.struct("kind", "token")).alias("marks"))
    entries = F.concat(*[F.coalesce(e, none) for e in (_entries(0, F.col("tokens")), F.col("marks"))])
    carried = ["__static", "strong", "seq", *(["__has"] if wants else [])]
    every = _matches(jobs.select(job, F.concat(*[F.coalesce(e, none) for e in asked]).alias("entries")), own.join(marks, piece, "left").select(piece, *carried, entries.alias("entries")), job, piece, carried, _tasks(jobs, evidence))
    score = 3 * F.col("overlap") + F.col("__static")
    if wants:
        every = every.join(jobs.select(job, F.col(wants).alias("__wants")), job)
        score = score + F.when(F.arrays_overlap("__wants", "__has"), bonus).otherwise(0)
    ranked = Window.partitionBy(job).orderBy(F.desc("score"), F.desc("strong"), "seq")
    out = every.withColumn("score", score.cast("long")).where("score > 0").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= limit)
    return out.withColumnRenamed("__static", static).drop("__has", "__wants")


#: Postings of rare tokens, for each piece wanted, from which a job's first bound is taken.
FIRST_LOOK = 4
POINTS = 3


def _exact(pairs: DataFrame, own: DataFrame, jobs: DataFrame, job: str, piece: str, bonus: int) -> DataFrame:
    """Scores of the (job, piece) pairs, from their whole token and tag sets."""
    asked = jobs.select(job, F.col("tokens").alias("__asked"), F.col("__wants"))
    both = pairs.join(own, piece).join(asked, job)
    overlap = F.coalesce(F.size(F.array_intersect("tokens", "__asked")), F.lit(0))
    overlap = F.when(overlap > 0, overlap).otherwise(0)
    score = POINTS * overlap + F.col("__static") + F.when(F.coalesce(F.arrays_overlap("__wants", "__has"), F.lit(False)), bonus).otherwise(0)
    return both.select(job, piece, overlap.alias("overlap"), "__static", "strong", "seq", score.cast("long").alias("score"))


def _ranked(scored: DataFrame, job: str, limit: int) -> DataFrame:
    order = Window.partitionBy(job).orderBy(F.desc("score"), F.desc("strong"), "seq")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _met(own: DataFrame, asked: DataFrame, job: str, piece: str) -> DataFrame:
    """(piece, job) of pairs that share an entry; pieces are dealt by id, so pairs stay where their piece is."""
    held = own.repartition(piece).select(piece, F.explode("entries").alias("entry")).select(piece, "entry.*")
    return held.join(asked, ["kind", "token"]).groupBy(piece, job).agg(F.count("*").alias("__shared")).drop("__shared")


def bounded_pairs(jobs: DataFrame, own: DataFrame, job: str, piece: str, limit: int, bonus: int = 0) -> DataFrame:
    """(piece, job) pairs that can be among the `limit` best of a job; all others are proven not to be.

    jobs (job, tokens, __wants), own (piece, tokens, __static, strong, seq, __has, entries): entries of kind 0 are a piece's tokens, others say
    that it stands in for pieces without a shared token. Tokens of a job are taken in order of rarity. A few postings of its rarest ones
    and the pieces that stand in give `limit` exact scores, the last of which is a bound: a piece that reaches it must share so
    many tokens with the job that it holds one of the job's rarest, however it is made up. Only postings of those are paired; those of
    frequent tokens never are.
    """
    wanted = jobs.select(job, F.explode("tokens").alias("token"))
    counts = own.select(F.explode("tokens").alias("token")).join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    rare = Window.partitionBy(job).orderBy("df", "token")
    reach = F.sum("df").over(rare.rowsBetween(Window.unboundedPreceding, -1))
    terms = kept_table(wanted.join(counts, "token").select(job, "token", F.row_number().over(rare).alias("place"), F.coalesce(reach, F.lit(0)).alias("before"), F.count("*").over(Window.partitionBy(job)).alias("terms")), "terms")
    token = lambda df: df.select(job, F.lit(0).alias("kind"), "token")
    standing = jobs.select(job, F.explode(F.concat(_entries(1, F.array(F.lit(""))), _entries(2, F.col("__wants")))).alias("entry")).select(job, "entry.*")
    first = kept_table(token(terms.where(F.col("before") < FIRST_LOOK * limit)).unionByName(standing), "first-terms")
    seen = _ranked(_exact(_met(own, first, job, piece), own, jobs, job, piece, bonus), job, limit)
    bounds = seen.groupBy(job).agg(F.when(F.count("*") == limit, F.min("score")).alias("bound"))
    most = own.agg((F.max("__static") + bonus).alias("most"))
    # a piece that reaches the bound shares at least so many tokens, and so one of the others' rarest
    least = F.ceil((F.col("bound") - F.col("most")) / POINTS)
    prefix = F.when(F.coalesce(least, F.lit(0)) > 0, F.col("terms") - least + 1).otherwise(F.col("terms"))
    paired = token(terms.join(bounds, job, "left").join(F.broadcast(most)).where(F.col("place") <= prefix))
    asked = kept_table(paired.unionByName(standing), "paired-terms")
    forget(terms)
    forget(first)
    return _met(own, asked, job, piece)


def top_by_bounds(jobs: DataFrame, evidence: DataFrame, job: str, piece: str, static: str, limit: int = 12, wants: str | None = None, has: str | None = None, bonus: int = 6) -> DataFrame:
    """top_by_overlap() by bounds: frequent tokens are never paired, but every pair that is left is compared on its whole tokens.

    That pays where jobs hold tokens that most pieces hold and rare ones that tell them apart; where all tokens are about as frequent,
    counting every pair in place is faster. The score is POINTS for each shared token and the piece's own; with arrays `wants` of jobs and `has` of evidence, a pair that
    shares an element scores `bonus` more. A piece that shares no token can still win by its own score or with the bonus, so the
    `limit` best pieces by that score, of all and of each element that is wanted, stand in for all the others: that is exact, as
    no job needs more of them. Of the pieces that share a token, only those are scored that bounded_pairs() cannot rule out.

    Tokens are made once, into a table of the shared folder. Ids of pieces are unique and pieces without one are left out; null
    arrays are empty; jobs without an id have no result.
    """
    none = F.array().cast("array<string>")
    order = [F.desc("__static"), F.desc("strong"), "seq"]
    tags = F.coalesce(F.col(has), none) if has else none
    own = kept_table(evidence.where(F.col(piece).isNotNull()).select(piece, F.col(static).alias("__static"), "strong", "seq", F.array_distinct(F.coalesce("tokens", none)).alias("tokens"), tags.alias("__has")), "pieces")
    jobs = jobs.where(F.col(job).isNotNull()).select(job, F.array_distinct(F.coalesce("tokens", none)).alias("tokens"), (F.coalesce(F.col(wants), none) if wants else none).alias("__wants"))
    marks = own.orderBy(*order).limit(limit).select(piece, F.lit(1).alias("kind"), F.lit("").alias("token"))  # at most `limit` rows
    if wants:
        tagged = own.select(piece, "__static", "strong", "seq", F.explode(F.array_distinct("__has")).alias("token"))
        tagged = tagged.join(jobs.select(F.explode("__wants").alias("token")).distinct(), "token", "left_semi")  # `limit` rows of each wanted tag
        tagged = tagged.withColumn("rn", F.row_number().over(Window.partitionBy("token").orderBy(*order))).where(F.col("rn") <= limit)
        marks = marks.unionByName(tagged.select(piece, F.lit(2).alias("kind"), "token"))
    marks = kept_table(marks.groupBy(piece).agg(F.collect_list(F.struct("kind", "token")).alias("marks")), "marks")
    entries = F.concat(_entries(0, F.col("tokens")), F.coalesce("marks", F.array().cast("array<struct<kind:int,token:string>>")))
    own = own.join(marks, piece, "left").withColumn("entries", entries).drop("marks")
    added = bonus if wants else 0
    pairs = bounded_pairs(jobs, own, job, piece, limit, added)
    scored = _exact(pairs, own, jobs, job, piece, added).where("score > 0")
    return _ranked(scored, job, limit).withColumnRenamed("__static", static)
