"""Continuous ingest, in-stream de-duplication, job states, rates and cost roll-ups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kbspark.functions.rules import is_permanent
from kbspark.operators.ingest import ingest_items, settle
from kbspark.operators.jobs import MAX_ERROR_CHARS, MAX_RETRIES
from kbspark.operators.vectors import DIM

HORIZON = "1 hour"


def dedup_stream(items: DataFrame, ts: str = "ts", horizon: str = HORIZON) -> DataFrame:
    """First arrival per (platform, content_id) within the watermark horizon."""
    return items.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(["platform", "content_id"])


def against_library(batch: DataFrame, library: DataFrame) -> DataFrame:
    """Items of a batch whose identity is not stored alive."""
    alive = library.filter(F.col("status") != "failed").select("platform", F.col("video_id").alias("content_id"))
    return batch.join(alive, ["platform", "content_id"], "left_anti")


def stored_sources(spark: SparkSession, root: str, but: int) -> DataFrame:
    """Sources under ``root`` that other batches than ``but`` have stored; none at first."""
    try:
        stored = spark.read.parquet(f"{root}/sources").filter(F.col("batch") != but)
    except Exception as exc:  # the first batch finds no table yet
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        stored = spark.createDataFrame([], "source_id long, platform string, video_id string, status string")
    return stored.select("source_id", "platform", "video_id", "status")


def ingest_batch(
    root: str, hops: DataFrame | None = None, pages: DataFrame | None = None, dim: int | None = DIM, text: str = "text",
) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: links, texts and rejects become jobs, sources, chunks and vectors.

    Rows are filed under the batch id and overwritten when a batch is replayed, so a
    restart after a crash leaves no doubles. With ``dim`` a source whose chunks or vectors are
    not whole is stored as failed, without them, and the rest of the batch goes on.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = lambda name: f"{root}/{name}/batch={batch_id}"
        new = dict(ingest_items(batch, stored_sources(spark, root, batch_id), hops, pages, text))
        if dim is not None:
            raw = {}
            for name in ("sources", "chunks", "chunk_vectors"):
                new[name].write.mode("overwrite").parquet(f"{root}/_staging/{name}/batch={batch_id}")
                raw[name] = spark.read.parquet(f"{root}/_staging/{name}/batch={batch_id}")
            new |= settle(raw, dim)
            failed = new["sources"].filter("status = 'failed'").select("source_id", F.col("error").alias("_why"))
            # a job whose source failed fails with it
            new["jobs"] = new["jobs"].join(failed, "source_id", "left").select(
                "item_id", "part", "kind", F.when(F.col("_why").isNotNull() & (F.col("status") == "done"), "failed")
                .otherwise(F.col("status")).alias("status"), "source_id", F.coalesce("error", F.when(F.col("status") == "done", F.col("_why"))).alias("error"))
        # sources go last: only a batch with all its chunks and vectors becomes visible
        for name in ("chunks", "chunk_vectors", "jobs", "sources"):
            new[name].write.mode("overwrite").parquet(at(name))

    return write


def ingest_stream(stream: DataFrame, root: str, checkpoint: str, hops: DataFrame | None = None, pages: DataFrame | None = None,
                  dim: int | None = DIM, **trigger) -> StreamingQuery:
    """Continuous ingest of (item_id, ts, text) rows, with an optional title, into the tables under ``root``."""
    writer = stream.writeStream.foreachBatch(ingest_batch(root, hops, pages, dim)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def drain(stream: DataFrame, work: Callable[[DataFrame], DataFrame], root: str, checkpoint: str) -> StreamingQuery:
    """Process everything pending once; rows that ``work`` marks failed go to a retry table.

    ``work`` returns its input with a boolean ``ok``. The retry table is the input of the
    next drain.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        out = work(batch)
        out.filter("ok").drop("ok").write.mode("overwrite").parquet(f"{root}/done/batch={batch_id}")
        out.filter(~F.col("ok")).drop("ok").write.mode("overwrite").parquet(f"{root}/retry/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATE = "status string, retries int, error string, stop boolean, seq long"
JOB_ROW = "job_id long, status string, retries int, error string"


def _advance(state: tuple, event: str, error: str | None, permanent: bool, limit: int) -> tuple:
    status, retries, last, stop = state
    if stop:
        return state
    if event == "claim":
        return ("processing", retries, last, False)
    if event in ("done", "duplicate"):
        return (event, retries, None, True)
    if event == "fail":
        retries += 1
        ended = permanent or retries >= limit
        return ("failed" if ended else "pending", retries, (error or "")[:MAX_ERROR_CHARS], ended)
    return state


def job_states(events: DataFrame, max_retries: int = MAX_RETRIES, ts: str = "ts", horizon: str = HORIZON) -> DataFrame:
    """Streaming job state: the current row of every job an arriving event touches.

    Events are (job_id, ts, seq, event, error). State per job is five scalars. An event whose
    seq is not above the last one applied to its job comes too late and is passed over. The
    state of a job that has ended is dropped ``horizon`` of event time after its last event.
    """
    rest = int(pd.Timedelta(horizon).total_seconds() * 1000)
    marked = events.withWatermark(ts, horizon).select(
        "job_id", ts, F.unix_millis(ts).alias("at"), "seq", F.when(F.col("event").isin("claim", "done", "duplicate", "fail"), F.col("event"))
        .otherwise("other").alias("event"), "error", F.coalesce(is_permanent("error"), F.lit(False)).alias("permanent"))

    def shrink(rows: pd.DataFrame) -> pd.DataFrame:
        """The few events of a job that can decide its state, however many arrived."""
        rows = rows.sort_values("seq")
        fails = rows[rows["event"] == "fail"]
        ends = rows[rows["event"].isin(["done", "duplicate"]) | ((rows["event"] == "fail") & rows["permanent"])]
        keep = pd.concat([fails.head(max_retries), ends.head(1), rows[rows["event"] != "other"].tail(1)])
        return keep.drop_duplicates("seq")

    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        *now, last = state.get if state.exists else ("pending", 0, None, False, None)
        held, newest = None, 0
        for frame in frames:
            newest = max(newest, int(frame["at"].max()))
            frame = frame if last is None else frame[frame["seq"] > last]
            held = shrink(frame if held is None else pd.concat([held, frame]))
        for r in held.sort_values("seq").itertuples(index=False):
            now, last = _advance(tuple(now), r.event, r.error, bool(r.permanent), max_retries), int(r.seq)
        state.update((*now, last))
        if now[3]:
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + rest + 1)
        yield pd.DataFrame([(key[0], now[0], now[1], now[2])], columns=["job_id", "status", "retries", "error"], dtype=object)

    return marked.groupBy("job_id").applyInPandasWithState(
        fold, JOB_ROW, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def arrival_rate(notes: DataFrame, ts: str = "created_at", horizon: str = HORIZON) -> DataFrame:
    """Arrivals per sliding hour, moved by the minute."""
    return notes.withWatermark(ts, horizon).groupBy(F.window(ts, "1 hour", "1 minute")).agg(
        F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def daily_usage(usage: DataFrame, ts: str = "ts", horizon: str = HORIZON) -> DataFrame:
    """Calls, tokens and cost per day, provider and model as calls arrive."""
    return usage.withWatermark(ts, horizon).groupBy(F.window(ts, "1 day"), "provider", "model").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("cost_usd").alias("cost_usd"),
    ).select(F.col("window.start").alias("day"), "provider", "model", "calls", "input_tokens", "output_tokens", "cost_usd")


def month_rollup(daily: DataFrame) -> DataFrame:
    """Monthly totals of the stored daily roll-up."""
    return daily.groupBy(F.date_format("day", "yyyy-MM").alias("month"), "provider", "model").agg(
        F.sum("calls").alias("calls"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"))


def settle_stream(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that has arrived and read back what it gives.

    Rows of an append stream are filed under their batch; of a complete stream the last whole
    result stays. Either way a replayed batch overwrites its own rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id if mode == 'append' else 0}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
    query.trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
    return rows.select(*stream.columns)


def read_files(spark: SparkSession, path: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)
