"""Aggregates, calendar buckets, recent-k lists and rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kbspark.functions import dates as D
from kbspark.operators.admission import admitted_seconds, same
from kbspark.operators.blocks import top_k

# Prices in USD per million tokens (input, output), audio per hour, limits.
PRICES = {"claude-sonnet-4-6": (3.0, 15.0), "claude-haiku-4-5": (1.0, 5.0)}
AUDIO_USD_PER_HOUR = 0.111
HISTORY = 10
RATE_LIMIT = 30
RECENT_SOURCES = 8
HEAD_CHUNKS = 3
HEAD_CHARS = 1500


def session_list(messages: DataFrame) -> DataFrame:
    """Per session: smallest user text (as stored), earliest user text, last time, count."""
    user = F.when(F.col("role") == "user", F.col("content"))
    return messages.groupBy("session_id").agg(
        F.min(user).alias("first_question"),
        F.min_by("content", F.when(F.col("role") == "user", F.col("msg_id"))).alias("earliest_question"),
        F.max("created_at").alias("last_at"), F.count(F.lit(1)).alias("n"),
    ).withColumn("title", F.substring(F.coalesce("first_question", F.lit("(無標題)")), 1, 60))


def latest_session(messages: DataFrame) -> DataFrame:
    return messages.agg(F.max_by("session_id", "msg_id").alias("session_id"))


def usage_breakdown(usage: DataFrame, month: str | None = None) -> DataFrame:
    """Calls, tokens and cost per month, provider and model (one month when given)."""
    rows = usage.withColumn("month", D.month_of("ts"))
    if month is not None:
        # a range on the raw column reaches the scan, a condition on the label would not
        start = F.to_timestamp(F.lit(month + "-01"))
        rows = rows.filter((F.col("ts") >= start) & (F.col("ts") < F.add_months(start, 1).cast("timestamp")))
    return rows.groupBy("month", "provider", "model").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"))


def month_cost(usage: DataFrame) -> DataFrame:
    return usage.groupBy(D.month_of("ts").alias("month")).agg(
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"))


def budget_check(usage: DataFrame, budget: float) -> DataFrame:
    """Months with their cost, over-budget flag and warning text."""
    cost = F.col("cost_usd")
    warn = F.format_string(f"⚠️ 本月 API 費用約 US$%.2f,已超過預算 US${budget:.2f}", cost)
    return month_cost(usage).withColumn("over_budget", cost > budget).withColumn(
        "warning", F.when(cost > budget, warn))


def call_cost(calls: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Add cost_usd from the price table; an unknown model costs nothing but extras."""
    if prices is None:
        spark = calls.sparkSession
        prices = spark.createDataFrame(
            [(m, a, b) for m, (a, b) in PRICES.items()], "model string, _in double, _out double")
    extra = F.coalesce(F.col("extra_cost"), F.lit(0.0)) if "extra_cost" in calls.columns else F.lit(0.0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return calls.join(prices, "model", "left").withColumn(
        "cost_usd", F.col("input_tokens") / 1e6 * zero("_in") + F.col("output_tokens") / 1e6 * zero("_out") + extra
    ).drop("_in", "_out")


def audio_cost(secs: Column) -> Column:
    return secs / 3600 * AUDIO_USD_PER_HOUR


def health(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: queue length, failed sources, source count."""
    q = jobs.agg(F.count_if(F.col("status").isin("pending", "processing")).alias("v")).scalar()
    return sources.agg(
        F.count_if(F.col("status") == "failed").alias("failed_sources"), F.count(F.lit(1)).alias("source_count"),
    ).select(q.alias("queue_length"), "failed_sources", "source_count")


def collection_counts(collections: DataFrame, sources: DataFrame) -> DataFrame:
    """Every collection with its source count, ordered by name."""
    n = sources.groupBy("collection_id").agg(F.count(F.lit(1)).alias("source_count"))
    return collections.join(n, "collection_id", "left").select(
        "collection_id", "name", F.coalesce("source_count", F.lit(0)).alias("source_count")).orderBy("name")


def unfiled_count(sources: DataFrame) -> DataFrame:
    return sources.agg(F.count_if(F.col("collection_id").isNull()).alias("unfiled_count"))


def pending_notes(notes: DataFrame) -> DataFrame:
    return notes.agg(F.count_if(F.col("status") == "candidate").alias("pending_count"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_chunks"))


def history_window(messages: DataFrame, k: int = HISTORY) -> DataFrame:
    """Last ``k`` messages of each session; read back in msg_id order."""
    return top_k(messages, ["session_id"], [F.desc("msg_id")], k).drop("rn")


def rate_limited(notes: DataFrame, order: str, key: str | None = None, ts: str = "created_at", limit: int = RATE_LIMIT,
                 span: int = 3600) -> DataFrame:
    """Add recent (admitted rows of less than ``span`` seconds ago) and refused (recent >= limit).

    Refused rows are not stored and do not count. Within a second rows come in the order of
    ``order``, which is unique. A row without a time is not judged: both columns are null.

    Rows are counted per key and second first; which seconds let rows in is settled over blocks
    of seconds (:mod:`kbspark.operators.admission`). The rows meet the result by a join, and
    only the first ``limit`` rows of a second are ranked.
    """
    keys = [key] if key else []
    timed = notes.withColumn("_sec", F.unix_timestamp(ts))
    per_sec = timed.filter(F.col("_sec").isNotNull()).groupBy(*keys, "_sec").agg(F.count(F.lit(1)).alias("_n"))
    seconds = admitted_seconds(per_sec, keys, limit, span)
    ranked = top_k(timed.filter(F.col("_sec").isNotNull()).select(*keys, "_sec", order), [*keys, "_sec"], [F.asc(order)], limit + 1, "_rn")
    judged = timed.alias("t").join(seconds.alias("s"), same("t", "s", [*keys, "_sec"]), "left").join(
        ranked.alias("r"), same("t", "r", [*keys, "_sec", order]), "left")
    rank = F.coalesce(F.col("r._rn").cast("long"), F.lit(limit + 1)) - 1
    recent = F.col("s._before") + F.least(rank, F.col("s._admit"))
    return judged.select(*[F.col(f"t.{c}") for c in notes.columns], recent.alias("recent")).withColumn(
        "refused", F.col("recent") >= limit)


def recent_library(sources: DataFrame, k: int = RECENT_SOURCES) -> DataFrame:
    """Newest usable sources and the signature of that list (TakeOrdered, no full sort)."""
    return sources.filter(F.col("status").isin("ready", "enriched")).orderBy(
        F.desc("ingested_at"), F.desc("source_id")).limit(k)


def library_signature(sources: DataFrame, k: int = RECENT_SOURCES) -> DataFrame:
    top = recent_library(sources, k)
    order = F.sort_array(F.collect_list(F.struct("ingested_at", "source_id")), asc=False)  # at most k rows
    return top.agg(F.array_join(F.transform(order, lambda x: x["source_id"].cast("string")), ":").alias("signature"))


def head_text(chunks: DataFrame, sources: DataFrame, k: int = HEAD_CHUNKS, n: int = HEAD_CHARS) -> DataFrame:
    """Title and first chunks of each source, escaped and cut, as naming input."""
    from kbspark.functions import text as T

    first = top_k(chunks.select("source_id", "chunk_id", "text"), ["source_id"], [F.asc("chunk_id")], k)
    joined = first.groupBy("source_id").agg(
        F.sort_array(F.collect_list(F.struct("chunk_id", "text"))).alias("c"))  # at most k per source
    body = F.array_join(F.transform("c", lambda x: x["text"]), "\n")
    return sources.join(joined, "source_id").select(
        "source_id", F.substring(T.html_escape(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), body)), 1, n).alias("head"))
