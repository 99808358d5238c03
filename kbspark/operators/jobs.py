"""Job table: state folding, recovery, retry decisions, queue positions, enqueueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.functions.rules import is_permanent, translate_error
from kbspark.operators.blocks import running_sum, top_k
from kbspark.session import salted_join

# Retry limit, stored error length, source-less ingest kinds.
MAX_RETRIES = 3
MAX_ERROR_CHARS = 4000
INGEST_KINDS = ("ingest", "ingest_text", "ingest_podcast")
WAITING = ("pending", "processing")
TERMINAL = ("done", "duplicate", "failed")


def fold_jobs(events: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Final state per job from ordered events (job_id, seq, event, error).

    Events are claim, done, duplicate and fail. A job ends at its first done or duplicate,
    its first permanent failure, or its ``max_retries``-th failure; later events do
    nothing. Ends are found by minima and a top-k, so a job with any number of events is
    never gathered.
    """
    e = events.withColumn("_perm", (F.col("event") == "fail") & is_permanent("error"))
    last_chance = top_k(
        e.filter(F.col("event") == "fail").select("job_id", "seq"), ["job_id"], [F.asc("seq")], max_retries
    ).groupBy("job_id").agg(
        F.max(F.when(F.col("rn") == max_retries, F.col("seq"))).alias("_spent"))
    ends = e.groupBy("job_id").agg(
        F.min(F.when(F.col("event").isin("done", "duplicate") | F.col("_perm"), F.col("seq"))).alias("_end")
    ).join(last_chance, "job_id", "left").select("job_id", F.least("_end", "_spent").alias("_stop"))
    live = salted_join(e, ends, ["job_id"], "seq").filter(F.col("_stop").isNull() | (F.col("seq") <= F.col("_stop")))
    out = live.groupBy("job_id").agg(
        F.max_by("event", F.when(F.col("event").isin("claim", "done", "duplicate", "fail"), F.col("seq"))).alias("_last"),
        F.count_if(F.col("event") == "fail").alias("retries"),
        F.max_by("error", F.when(F.col("event") == "fail", F.col("seq"))).alias("_error"),
        F.max("_stop").alias("_stop"),
    )
    status = (
        F.when(F.col("_last").isin("done", "duplicate"), F.col("_last"))
        .when(F.col("_last") == "fail", F.when(F.col("_stop").isNotNull(), "failed").otherwise("pending"))
        .when(F.col("_last") == "claim", "processing").otherwise("pending")
    )
    # finishing clears the error, as the stored row is overwritten with the outcome
    return out.select(
        "job_id", status.alias("status"), "retries",
        F.when(~F.col("_last").isin("done", "duplicate"), F.substring("_error", 1, MAX_ERROR_CHARS)).alias("error"),
    )


def scrub_payload(jobs: DataFrame) -> DataFrame:
    """Pasted bodies do not outlive their job: terminal text jobs keep an empty payload."""
    gone = (F.col("kind") == "ingest_text") & F.col("status").isin(*TERMINAL)
    return jobs.withColumn("payload", F.when(gone, "{}").otherwise(F.col("payload")))


def recover_jobs(jobs: DataFrame, now: Column | None = None) -> DataFrame:
    """After a crash: stranded jobs are retried while retries remain (tested before adding)."""
    stuck = F.col("status") == "processing"
    out = jobs.select(
        *[c for c in jobs.columns if c not in ("status", "retries", "error", "updated_at")],
        F.when(stuck, F.when(F.col("retries") < F.col("max_retries"), "pending").otherwise("failed"))
        .otherwise(F.col("status")).alias("status"),
        F.when(stuck, F.col("retries") + 1).otherwise(F.col("retries")).alias("retries"),
        F.when(stuck, F.coalesce("error", F.lit("recovered after restart"))).otherwise(F.col("error")).alias("error"),
        F.when(stuck, now if now is not None else F.current_timestamp()).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    return scrub_payload(out).select(*jobs.columns)


def recover_sources(sources: DataFrame) -> DataFrame:
    return sources.withColumn(
        "status", F.when(F.col("status") == "processing", "failed").otherwise(F.col("status")))


def fail_or_retry(failures: DataFrame) -> DataFrame:
    """Outcome of failed runs: retries + 1; failed when permanent or out of retries."""
    tries = F.col("retries") + 1
    out = failures.withColumn(
        "status", F.when(is_permanent("error") | (tries >= F.col("max_retries")), "failed").otherwise("pending")
    ).withColumn("retries", tries).withColumn("error", F.substring("error", 1, MAX_ERROR_CHARS))
    return scrub_payload(out) if "payload" in failures.columns else out


def enqueue_summaries(candidates: DataFrame, sources: DataFrame, jobs: DataFrame) -> DataFrame:
    """Source ids that need a summary job: stored, no summary yet, none waiting."""
    waiting = jobs.filter((F.col("kind") == "summarize") & F.col("status").isin(*WAITING)).select("source_id")
    lacking = sources.filter(F.coalesce(F.col("summary"), F.lit("")) == "").select("source_id")
    return candidates.select("source_id").distinct().join(lacking, "source_id", "left_semi").join(
        waiting, "source_id", "left_anti")


def claim_next(jobs: DataFrame, n: int = 1) -> DataFrame:
    """The pending jobs with the smallest ids."""
    return jobs.filter(F.col("status") == "pending").orderBy("job_id").limit(n)


def jobs_ahead(jobs: DataFrame) -> DataFrame:
    """Pending jobs with the number of waiting jobs before them (block-wise running count)."""
    waiting = F.when(F.col("status").isin(*WAITING), 1).otherwise(0).cast("long")
    return running_sum(jobs, [], "job_id", {"queue_position": waiting}, include_current=False).filter(
        F.col("status") == "pending")


def list_positions(jobs: DataFrame) -> DataFrame:
    """0-based position among pending ingest jobs that have no source row yet."""
    queued = jobs.filter(
        F.col("kind").isin(*INGEST_KINDS) & (F.col("status") == "pending") & F.col("source_id").isNull())
    return running_sum(queued, [], "job_id", {"queue_position": F.lit(1).cast("long")}, include_current=False)


def job_view(jobs: DataFrame) -> DataFrame:
    """Job status rows with the plain-language error of failed ones and the queue position."""
    ahead = jobs_ahead(jobs.select("job_id", "status")).select("job_id", "queue_position")
    human = F.when((F.col("status") == "failed") & F.col("error").isNotNull(), translate_error("error"))
    return jobs.join(ahead, "job_id", "left").withColumn("human_error", human)


def latest_errors(jobs: DataFrame) -> DataFrame:
    """(source_id, error): the error of each source's newest job that has one."""
    return jobs.filter(F.col("error").isNotNull() & F.col("source_id").isNotNull()).groupBy("source_id").agg(
        F.max_by("error", "job_id").alias("error"))
