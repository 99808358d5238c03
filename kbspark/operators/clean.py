"""Cleaning, validation and filter predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.functions.rules import PHANTOM_PHRASES
from kbspark.operators.blocks import lag_pair

# Recogniser thresholds, size limits, coverage floor.
PHANTOM_NO_SPEECH = 0.5
SILENCE_NO_SPEECH = 0.6
SILENCE_LOGPROB = -1.0
REPEAT_LIMIT = 2
MAX_DURATION = 10_800
MAX_TEXT_CHARS = 100_000
MIN_COVERAGE = 0.30
NOTE_KINDS = ("skill", "rule", "project", "money", "insight")
NOTE_CAPS = {"title": 100, "content": 2000, "application": 1000}
MAX_NOTE_SOURCES = 20
MAX_COLLECTION_NAME = 30
MAX_COLLECTIONS = 50
EPISODE_CAPS = {"guid": 500, "title": 200, "audio_url": 1000, "link": 1000, "published_at": 25, "feed_title": 100}
MAX_EPISODES_PER_BATCH = 10


def segment_reason(text="text", no_speech="no_speech_prob", logprob="avg_logprob") -> Column:
    """Row-local drop reason of a raw segment: blank, phantom, no_speech, or null."""
    norm = T.normalise_sentence(text)
    ns = F.coalesce(F.col(no_speech), F.lit(0.0))
    phantoms = [T.normalise_sentence(F.lit(p)) for p in PHANTOM_PHRASES]
    return (
        F.when(F.col(text).isNull() | ~T.non_blank(text), "blank")
        .when(norm.isin(*phantoms) & (ns > PHANTOM_NO_SPEECH), "phantom")
        .when((ns > SILENCE_NO_SPEECH) & (F.coalesce(F.col(logprob), F.lit(0.0)) < SILENCE_LOGPROB), "no_speech")
    )


def mark_segments(raw: DataFrame, keys=("media_id",), seq: str = "seq") -> DataFrame:
    """Add ``reason``: blank, phantom, no_speech, repeated, or null for a kept segment.

    Repeats are counted among survivors of the first three: a third and later row of a
    run of equal sentences goes. That needs only the two survivors before a row, so a
    medium of any length is worked on in blocks.
    """
    keys = list(keys)
    base = raw.withColumn("reason", segment_reason())
    alive = base.filter(F.col("reason").isNull()).withColumn("_norm", T.normalise_sentence("text"))
    seen = lag_pair(alive, keys, seq, "_norm")
    run = (F.col("_norm") != "") & (F.col("prev1") == F.col("_norm")) & (F.col("prev2") == F.col("_norm"))
    seen = seen.withColumn("reason", F.when(run, "repeated")).select(*raw.columns, "reason")
    return base.filter(F.col("reason").isNotNull()).select(*raw.columns, "reason").unionByName(seen)


def filter_segments(raw: DataFrame, keys=("media_id",), seq: str = "seq") -> DataFrame:
    return mark_segments(raw, keys, seq).filter(F.col("reason").isNull()).drop("reason")


def filter_counts(marked: DataFrame) -> DataFrame:
    """Rows per drop reason; kept rows count as ``kept``."""
    return marked.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"))


def duration_rejects(*durations: Column, limit: int = MAX_DURATION) -> Column:
    """True when any known duration exceeds the limit; unknown ones pass."""
    out = F.lit(False)
    for d in durations:
        out = out | F.coalesce(d > limit, F.lit(False))
    return out


def text_reject_reason(text, title=None) -> Column:
    body = T.strip(text)
    too_long_title = F.length(T.strip(title)) > 200 if title is not None else F.lit(False)
    return (
        F.when(F.length(body) == 0, "blank").when(F.length(body) > MAX_TEXT_CHARS, "too_long")
        .when(F.coalesce(too_long_title, F.lit(False)), "title_too_long")
    )


def validate_notes(notes: DataFrame, sources: DataFrame) -> DataFrame:
    """Trim and cap note fields, tidy source ids, add reject_reason (null when valid)."""
    out = notes
    for field, cap in NOTE_CAPS.items():
        out = out.withColumn(field, F.substring(T.strip(F.coalesce(F.col(field), F.lit(""))), 1, cap))
    ids = F.slice(F.array_sort(F.array_distinct(F.coalesce("source_ids", F.array().cast("array<long>")))), 1, MAX_NOTE_SOURCES)
    out = out.withColumn("source_ids", ids)
    known = (
        out.select("note_id", F.explode("source_ids").alias("source_id"))
        .join(sources.select("source_id"), "source_id", "left_semi")
        .select("note_id", F.lit(True).alias("_known")).distinct()
    )
    return out.join(known, "note_id", "left").withColumn(
        "reject_reason",
        F.when(~F.col("kind").isin(*NOTE_KINDS), "kind")
        .when((F.col("title") == "") | (F.col("content") == ""), "title_or_content")
        .when(F.col("application") == "", "application")
        .when(F.size("source_ids") == 0, "no_source_ids")
        .when(F.col("_known").isNull(), "unknown_sources"),
    ).drop("_known")


def clean_collection_names(df: DataFrame, existing: DataFrame, name: str = "name") -> DataFrame:
    """Collapse blanks and add reject_reason: empty, too_long, taken or full."""
    cleaned = df.withColumn(name, T.collapse(name))
    taken = existing.select(F.col("name").alias("_n"), F.lit(True).alias("_taken")).distinct()
    total = existing.agg(F.count(F.lit(1)).alias("c")).scalar()
    return cleaned.join(taken, F.col(name) == F.col("_n"), "left").withColumn(
        "reject_reason",
        F.when(F.col(name) == "", "empty").when(F.length(name) > MAX_COLLECTION_NAME, "too_long")
        .when(total >= MAX_COLLECTIONS, "full").when(F.col("_taken").isNotNull(), "taken"),
    ).drop("_n", "_taken")


def coerce_episodes(episodes: DataFrame, batch: str, order: str) -> DataFrame:
    """Cap string fields, read durations tolerantly; a batch over ten is rejected whole."""
    out = episodes
    for field, cap in EPISODE_CAPS.items():
        if field in episodes.columns:
            value = F.col(field).cast("string")
            if field == "title":
                value = F.coalesce(F.nullif(value, F.lit("")), F.lit("(無標題)"))
            if field in ("link", "published_at"):
                value = F.nullif(value, F.lit(""))
            out = out.withColumn(field, F.substring(value, 1, cap))
    raw = F.col("duration_secs").cast("string")
    out = out.withColumn("duration_secs", F.when(raw.rlike(r"^\d+$"), raw.try_cast("long")))
    sizes = out.groupBy(F.col(batch).alias("_batch")).agg(F.count(F.lit(1)).alias("_n"))
    return out.join(sizes, F.col(batch).eqNullSafe(F.col("_batch"))).withColumn(
        "reject_reason",
        F.when(F.col("_n") > MAX_EPISODES_PER_BATCH, "batch_too_large")
        .when(F.coalesce(F.col("guid"), F.lit("")) == "", "guid")
        .when(F.coalesce(F.col("audio_url"), F.lit("")) == "", "audio_url"),
    ).drop("_n", "_batch")


def library_view(sources: DataFrame, type_: str | None = None, collection: int | str | None = None) -> DataFrame:
    """Library filter: by type; by collection id, ``"none"`` for unfiled, or any."""
    out = sources if type_ is None else sources.filter(F.col("type") == type_)
    if collection == "none":
        return out.filter(F.col("collection_id").isNull())
    return out if collection is None else out.filter(F.col("collection_id") == collection)


def chat_scope(sources: DataFrame) -> DataFrame:
    return sources.filter(F.col("status").isin("ready", "enriched"))


def recent_sources(sources: DataFrame, now: Column, days: int | None = None, limit: int = 50) -> DataFrame:
    """Newest sources by id, optionally of the last N days; N >= 0, 1 <= limit <= 200."""
    out = sources
    if days is not None:
        out = out.filter(F.col("ingested_at") >= now - F.make_dt_interval(F.lit(max(0, days))))
    return out.orderBy(F.desc("source_id")).limit(max(1, min(limit, 200)))


def speech_coverage(media: DataFrame, segments: DataFrame) -> DataFrame:
    """Per medium (media_id, duration_secs, has_captions): coverage and hollow flag."""
    spoken = segments.groupBy("media_id").agg(
        F.sum(F.greatest(F.lit(0.0), F.col("end_sec") - F.col("start_sec"))).alias("_spoken"),
        F.count(F.lit(1)).alias("n_segments"),
    )
    out = media.join(spoken, "media_id", "left").withColumn("n_segments", F.coalesce("n_segments", F.lit(0)))
    d = F.col("duration_secs")
    cover = F.when(d.isNull() | (d <= 0), F.when(F.col("n_segments") > 0, 1.0).otherwise(0.0)).otherwise(
        F.least(F.lit(1.0), F.coalesce("_spoken", F.lit(0.0)) / d))
    return out.withColumn("coverage", cover).withColumn(
        "hollow",
        F.when(F.col("has_captions"), F.lit(False)).when(d.isNull(), F.col("n_segments") == 0)
        .otherwise(F.col("coverage") < MIN_COVERAGE),
    ).drop("_spoken")
