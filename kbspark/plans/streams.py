"""Streams over the given tables, run until all of them has arrived."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark import schemas
from kbspark.functions import dates as D
from kbspark.functions import text as T
from kbspark.plans import sql
from kbspark.session import new_folder
from kbspark.sources import tables as S
from kbspark.streaming import streams as ST


def _b(c, name=None):
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("long").alias(name or c)


def _arriving(spark, sf, table):
    # a pattern, so that a table may be one file or a folder of files
    out = ST.read_files(spark, f"{sf}/{table}.parque[t]", schemas.GIVEN[table])
    return out.withColumn("ts", F.col("ts").cast("timestamp")) if table == "events" else out


def _run(spark, stream, name, mode="append"):
    return ST.settle_stream(stream, new_folder(spark, name), mode)


def stream_dedup(spark, sf):
    """Identities of arriving documents, each passed on once."""
    docs = _arriving(spark, sf, "documents").select(
        F.lit("manual").alias("platform"), T.content_id("text").alias("content_id"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"))
    return _run(spark, ST.dedup_stream(docs), "dedup").select("platform", "content_id")


def stream_rates(spark, sf):
    """Arrivals per sliding hour, of the days' busiest quarter of an hour."""
    events = _arriving(spark, sf, "events").select("ts")
    rates = _run(spark, ST.arrival_rate(events, "ts"), "rates", "complete")
    return rates.groupBy(F.date_trunc("hour", "start").alias("hour")).agg(F.max("n").alias("busiest"), F.sum("n").alias("seen")).select(
        D.iso_z("hour").alias("hour"), "busiest", "seen")


def stream_usage(spark, sf):
    """Monthly totals rolled up from the streamed daily ones."""
    k = S.props_k()
    usage = _arriving(spark, sf, "events").select(
        "ts", F.col("event_type").alias("provider"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
        k.alias("input_tokens"), (k * 2).alias("output_tokens"), (F.col("value") / 10000).alias("cost_usd"))
    return ST.month_rollup(_run(spark, ST.daily_usage(usage), "usage", "complete"))


def stream_drain(spark, sf):
    """Pending events worked off once: counts of done and to be tried again, by kind."""
    path = new_folder(spark, "drain")
    ok = lambda batch: batch.withColumn("ok", F.col("event_type") != "error")
    ST.drain(_arriving(spark, sf, "events"), ok, path, f"{path}/checkpoint").awaitTermination()
    rows = None
    for name in ("done", "retry"):
        part = spark.read.schema(schemas.GIVEN["events"]).parquet(f"{path}/{name}").select(F.lit(name).alias("outcome"), "event_type")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("outcome", "event_type").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (stream_dedup, stream_rates, stream_usage, stream_drain)}

ORACLES = {
    "stream_dedup": f"SELECT DISTINCT 'manual' AS platform, 'txt_' || left(sha256({sql.TRIMMED}), 16) AS content_id FROM documents",
    "stream_rates": """WITH m AS (SELECT date_trunc('minute', ts) AS m, count(*) AS n FROM events GROUP BY 1),
w AS (SELECT m - to_minutes(i) AS start, sum(n) AS n FROM m, range(0, 60) x(i) GROUP BY 1)
SELECT strftime(date_trunc('hour', start), '%Y-%m-%dT%H:%M:%SZ') AS hour, CAST(max(n) AS BIGINT) AS busiest, CAST(sum(n) AS BIGINT) AS seen FROM w GROUP BY 1""",
    "stream_usage": """SELECT strftime(ts, '%Y-%m') AS month, event_type AS provider, 'm' || (user_id % 3) AS model, count(*) AS calls,
 round(sum(value / 10000.0::DOUBLE), 4) AS cost_usd FROM events GROUP BY 1, 2, 3""",
    "stream_drain": """SELECT CASE WHEN event_type = 'error' THEN 'retry' ELSE 'done' END AS outcome, event_type, count(*) AS n FROM events GROUP BY 1, 2""",
}
