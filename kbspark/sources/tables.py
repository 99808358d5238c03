"""Table scans and adapters from the generated tables to knowledge-base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark import schemas
from kbspark.functions import text as T
from kbspark.session import spread

EPOCH = "2024-01-01 00:00:00"
NOW = "2024-01-31 00:00:00"


def given(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan one generated table with its declared schema."""
    df = spark.read.schema(schemas.GIVEN[name]).parquet(f"{root}/{name}.parquet")
    if name == "events":
        df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return spread(df) if name in ("documents", "pages") else df


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan one stored knowledge-base table with its declared schema."""
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{root}/{name}")


def _moment(hours) -> F.Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH).cast("timestamp")) + hours * 3600)


def sources(spark: SparkSession, root: str) -> DataFrame:
    """One pasted-text source per document; status follows the quality label."""
    docs, labels = given(spark, root, "documents"), given(spark, root, "labels")
    key = T.content_id("text")
    return docs.join(labels.select("doc_id", "quality"), "doc_id", "left").select(
        F.col("doc_id").alias("source_id"), F.lit("text").alias("type"), F.lit("manual").alias("platform"),
        key.alias("video_id"), T.first_line("text", 80).alias("title"),
        F.lit(None).cast("string").alias("display_title"),
        F.concat(F.lit("manual:"), key).alias("url_original"),
        F.concat(F.lit("manual:"), key).alias("url_normalized"),
        F.when(F.col("quality") == 1, "ready").when(F.col("quality") == 0, "failed")
        .otherwise("enriched").alias("status"),
        F.when(F.col("quality").isNull(), T.first_line("text", 120)).alias("summary"),
        _moment(F.col("doc_id") % 720).alias("published_at"),
        _moment(F.col("doc_id") % 720).alias("ingested_at"),
        F.lit(None).cast("timestamp").alias("summary_generated_at"),
        F.lit(None).cast("int").alias("duration_secs"),
        F.when(F.col("source") != "src0", F.substring("source", 4, 9).cast("long")).alias("collection_id"),
    )


def whole_chunks(spark: SparkSession, root: str) -> DataFrame:
    """One chunk per document, for queries that do not depend on chunk boundaries."""
    return given(spark, root, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("source_id"),
        F.lit("article").alias("modality"), "text",
        F.lit(0.0).alias("start_sec"), F.lit(0.0).alias("end_sec"),
    )


def document_segments(spark: SparkSession, root: str) -> DataFrame:
    return given(spark, root, "documents").select(
        F.col("doc_id").alias("source_id"), F.lit(0).cast("long").alias("seq"), T.strip("text").alias("text"),
        F.lit(0.0).alias("start_sec"), F.lit(0.0).alias("end_sec"),
    )


def turn_segments(spark: SparkSession, root: str) -> DataFrame:
    """Conversation turns as a timed transcript, ten seconds a turn."""
    return given(spark, root, "conversations").select(
        F.col("conv_id").alias("source_id"), F.col("turn").alias("seq"), "text",
        (F.col("turn") * 10.0).alias("start_sec"), (F.col("turn") * 10.0 + 10.0).alias("end_sec"),
    )


def collections(spark: SparkSession, root: str) -> DataFrame:
    docs = given(spark, root, "documents")
    return docs.select("source").distinct().select(
        F.substring("source", 4, 9).cast("long").alias("collection_id"), F.col("source").alias("name"),
        F.lit(EPOCH).cast("timestamp").alias("created_at"),
    )


def messages(spark: SparkSession, root: str) -> DataFrame:
    return given(spark, root, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"),
        F.col("conv_id").cast("string").alias("session_id"), "role", F.col("text").alias("content"),
        F.col("turn"), F.col("conv_id"),
        _moment(F.col("conv_id") % 720).alias("created_at"),
    )


def props_k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("long")


def api_usage(spark: SparkSession, root: str) -> DataFrame:
    return given(spark, root, "events").select(
        F.col("event_id").alias("id"), "ts", F.col("event_type").alias("provider"),
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
        props_k().alias("input_tokens"), (props_k() * 2).alias("output_tokens"),
        (F.col("value") / 10000).alias("cost_usd"),
    )


def jobs(spark: SparkSession, root: str) -> DataFrame:
    """One job per event; errors carry an HTTP status taken from the event."""
    k, kind = props_k(), F.col("event_type")
    status = (
        F.when(kind == "view", "pending").when(kind == "click", "processing")
        .when(kind == "purchase", "done").when(kind == "signup", "duplicate").otherwise("failed")
    )
    error = F.concat(F.lit("HTTP error "), (F.lit(400) + k).cast("string"), F.lit(": gone wrong"))
    return given(spark, root, "events").select(
        F.col("event_id").alias("job_id"),
        F.when(F.col("user_id") % 4 == 0, "ingest_text").when(F.col("user_id") % 4 == 1, "ingest_podcast")
        .when(F.col("user_id") % 4 == 2, "summarize").otherwise("ingest").alias("kind"),
        status.alias("status"), F.when(kind == "error", error).alias("error"),
        F.col("props").alias("payload"), (k % 4).cast("int").alias("retries"), F.lit(3).alias("max_retries"),
        F.when(k >= 20, F.col("user_id")).alias("source_id"), F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
    )


def raw_segments(spark: SparkSession, root: str) -> DataFrame:
    """Events as recogniser output: user as medium, event order as time."""
    return given(spark, root, "events").select(
        F.col("user_id").alias("media_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("text"),
        F.unix_timestamp("ts").cast("double").alias("start_sec"),
        (F.unix_timestamp("ts") + F.lit(5)).cast("double").alias("end_sec"),
        (F.col("value") - F.floor("value")).alias("no_speech_prob"),
        (-props_k() / F.lit(50.0)).alias("avg_logprob"),
    )


def notes(spark: SparkSession, root: str) -> DataFrame:
    docs, labels = given(spark, root, "documents"), given(spark, root, "labels")
    kinds = F.array(*[F.lit(x) for x in ("skill", "rule", "project", "money", "insight")])
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("note_id"), F.get(kinds, (F.col("doc_id") % 5).cast("int")).alias("kind"),
        T.first_line("text", 60).alias("title"), F.col("text").alias("content"),
        F.col("lang").alias("application"),
        F.when(F.col("quality") == 1, "kept").when(F.col("quality") == 0, "dropped")
        .otherwise("candidate").alias("status"),
        F.array(F.col("doc_id"), F.col("doc_id") + 1).alias("source_ids"),
        _moment(F.col("doc_id") % 720).alias("created_at"),
        F.when(F.col("quality").isNotNull(), _moment(F.col("doc_id") % 720)).alias("decided_at"),
    )


def questions(spark: SparkSession, root: str) -> DataFrame:
    """Every benchmark passage, whole, as a question."""
    return given(spark, root, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )
