"""Files in and out, and streaming jobs against their batch results."""

import os

import pytest
from pyspark.sql import functions as F

from kbspark import schemas
from kbspark.operators import jobs as J
from kbspark.operators import rollups as A
from kbspark.plans import parts
from kbspark.sources import readers as RD
from kbspark.sources import sinks as SK
from kbspark.sources import tables as S
from kbspark.streaming import streams as ST

ROOT = os.environ.get("KBSPARK_TEST_DIR", "/root/testdata/sf0.001")


def run(df, mode="append"):
    name = f"t{abs(hash(tuple(df.columns)))}{os.urandom(4).hex()}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def split_files(df, path, order, n=3):
    df.repartitionByRange(n, order).sortWithinPartitions(order).write.parquet(path)


def test_text_files_and_jsonl(spark, tmp_path):
    (tmp_path / "one.txt").write_text("first\nsecond", encoding="utf-8")
    (tmp_path / "skip.md").write_text("no", encoding="utf-8")
    assert [tuple(r) for r in RD.text_directory(spark, str(tmp_path)).collect()] == [("one", "first\nsecond")]
    (tmp_path / "g.jsonl").write_text('{"id":"a","category":"c","query":"q","expect":[{"doc":"d","text":"t"}]}\n\n', encoding="utf-8")
    row = RD.jsonl(spark, str(tmp_path / "g.jsonl"), schemas.GOLDEN).first()
    assert row.id == "a" and row.expect[0].doc == "d"


def test_sinks(spark, tmp_path):
    rec = spark.createDataFrame([(1, 0.5)], "k int, recall double")
    for _ in range(2):
        SK.append_jsonl(rec, str(tmp_path / "hist"))
    assert RD.jsonl(spark, str(tmp_path / "hist"), "k int, recall double").count() == 2
    src = spark.createDataFrame([(1, "web", "v", "T", "u", None, None)],
                                "source_id long, platform string, video_id string, title string, url_normalized string, published_at timestamp, summary string")
    ch = spark.createDataFrame([(2, 1, "b", 65.0), (1, 1, "a", 0.0)], "chunk_id long, source_id long, text string, start_sec double")
    SK.write_markdown(src, ch, str(tmp_path / "md"))
    folder = tmp_path / "md" / "source_id=1"
    text = "".join(p.read_text(encoding="utf-8") for p in sorted(folder.glob("part-*")))
    assert text.startswith("## T\n- 平台:web") and text.index("**[0:00](u)**") < text.index("**[1:05](u)**") and text.rstrip().endswith("---")


def test_stream_ingest_and_replay(spark, tmp_path):
    docs = S.given(spark, ROOT, "documents").select(
        F.col("doc_id").alias("item_id"), F.timestamp_seconds(F.col("doc_id") + 1_700_000_000).alias("ts"), "text")
    split_files(docs.unionByName(docs.withColumn("item_id", F.col("item_id") + 10_000)), str(tmp_path / "in"), "item_id")
    stream = lambda: ST.read_files(spark, str(tmp_path / "in"), "item_id long, ts timestamp, text string", 1)
    root = str(tmp_path / "kb")
    ST.ingest_stream(stream(), root, str(tmp_path / "cp")).awaitTermination()
    src = spark.read.parquet(f"{root}/sources")
    want = docs.select(F.sha2(F.trim("text"), 256)).distinct().count()
    assert src.count() == src.select("video_id").distinct().count() and abs(src.count() - want) <= 5
    n_chunks, n_vec = spark.read.parquet(f"{root}/chunks").count(), spark.read.parquet(f"{root}/chunk_vectors").count()
    assert n_chunks == n_vec >= src.count()
    ST.ingest_stream(stream(), root, str(tmp_path / "cp")).awaitTermination()  # nothing new
    assert spark.read.parquet(f"{root}/chunks").count() == n_chunks


def test_stream_dedup(spark, tmp_path):
    rows = [(1, "web", "a", 0), (2, "web", "a", 10), (3, "web", "b", 20)]
    df = spark.createDataFrame(rows, "n long, platform string, content_id string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = run(ST.dedup_stream(ST.read_files(spark, str(tmp_path / "in"), "n long, platform string, content_id string, ts timestamp")))
    assert sorted(r.content_id for r in out.collect()) == ["a", "b"]


def test_stream_job_states_equal_batch_fold(spark, tmp_path):
    k, kind = S.props_k(), F.col("event_type")
    events = S.given(spark, ROOT, "events").select(
        (F.col("user_id") * 100 + F.dayofmonth("ts")).cast("long").alias("job_id"), "ts", F.col("event_id").alias("seq"),
        F.when(kind == "click", "claim").when(kind == "purchase", F.when(k < 30, "done").otherwise("claim"))
        .when(kind == "signup", "claim").when(kind == "error", "fail").otherwise("poll").alias("event"),
        F.when(kind == "error", F.concat(F.lit("HTTP error "), (F.lit(400) + k).cast("string"))).alias("error"))
    split_files(events, str(tmp_path / "in"), "seq", 4)
    schema = "job_id long, ts timestamp, seq long, event string, error string"
    out = run(ST.job_states(ST.read_files(spark, str(tmp_path / "in"), schema, 4)), "update")
    batch = {r.job_id: (r.status, r.retries, r.error) for r in J.fold_jobs(events).collect()}
    assert {r.job_id: (r.status, r.retries, r.error) for r in out.collect()} == batch


def test_stream_passes_over_events_that_come_too_late(spark, tmp_path):
    rows = [(1, 0, 5, "claim", None, 0), (2, 0, 1, "fail", "HTTP error 503", 0), (1, 1, 3, "done", None, 1), (2, 1, 2, "done", None, 1)]
    events = spark.createDataFrame(rows, "job_id long, s long, seq long, event string, error string, part int").withColumn(
        "ts", F.timestamp_seconds(F.col("s") + 1_700_000_000))
    (tmp_path / "in").mkdir()
    for part in (0, 1):  # the second file is the newer one by a minute
        events.filter(F.col("part") == part).drop("s", "part").coalesce(1).write.parquet(str(tmp_path / f"out{part}"))
        (file,) = (tmp_path / f"out{part}").glob("*.parquet")
        os.utime(file.rename(tmp_path / "in" / f"{part}.parquet"), (1_700_000_000 + 60 * part,) * 2)
    schema = "job_id long, ts timestamp, seq long, event string, error string"
    out = run(ST.job_states(ST.read_files(spark, str(tmp_path / "in"), schema, 1)), "update")
    assert (1, "done") not in {(r.job_id, r.status) for r in out.collect()}
    assert (2, "done") in {(r.job_id, r.status) for r in out.collect()}


def test_stream_usage_equals_batch(spark, tmp_path):
    usage = S.api_usage(spark, ROOT).select("id", "ts", "provider", "model", "input_tokens", "output_tokens", "cost_usd")
    split_files(usage, str(tmp_path / "in"), "id")
    daily = ST.daily_usage(ST.read_files(spark, str(tmp_path / "in"), "id long, ts timestamp, provider string, model string,"
                                         " input_tokens long, output_tokens long, cost_usd double", 3))
    months = ST.month_rollup(run(daily, "complete"))
    want = {(r.month, r.provider, r.model): (r.calls, r.cost_usd) for r in A.usage_breakdown(usage).collect()}
    assert {(r.month, r.provider, r.model): (r.calls, r.cost_usd) for r in months.collect()} == want


def test_arrival_rate(spark, tmp_path):
    df = spark.createDataFrame([(i * 60,) for i in range(30)], "s long").select(F.timestamp_seconds("s").alias("created_at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = run(ST.arrival_rate(ST.read_files(spark, str(tmp_path / "in"), "created_at timestamp")), "complete")
    assert out.agg(F.max("n")).first()[0] == 30


def test_drain_sends_failures_to_retry(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ST.read_files(spark, str(tmp_path / "in"), "id long")
    ST.drain(stream, lambda b: b.withColumn("ok", F.col("id") % 3 != 0), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out/retry")).collect()) == [0, 3, 6, 9]
    assert spark.read.parquet(str(tmp_path / "out/done")).count() == 6


def test_page_files_grow_with_tasks_not_with_pages(spark, tmp_path, monkeypatch):
    """No folder and no file of its own for a page; lines come back as they were."""
    monkeypatch.setattr(parts, "new_folder", lambda spark, name: str(tmp_path / name))
    root = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{root}/pages.parquet").count()
    assert parts.page_files(spark, root).count() > 2 * pages
    assert len(list((tmp_path / "files" / "text").rglob("*.txt"))) < min(pages, 17)
    lines = spark.createDataFrame([("a  b",), ("",), ("é \x0c\x85 ",)], "text string")
    SK.write_text_lines(lines, str(tmp_path / "l"))
    assert sorted(r["text"] for r in RD.text_directory(spark, str(tmp_path / "l"), lines=True).collect()) == ["", "a  b", "é \x0c\x85 "]
    with pytest.raises(Exception, match="line break"):
        SK.write_text_lines(spark.createDataFrame([("a\nb",)], "text string"), str(tmp_path / "m"))


def test_feed_errors_parse_a_feed_once(spark):
    """Errors need no join of feeds to their own items; a feed that comes twice is told by both."""
    good = '<rss><channel><item><title>a</title><enclosure url="u" type="audio/mpeg"/></item></channel></rss>'
    mute = '<rss><channel><item><title>a</title><enclosure url="u" type="image/png"/></item></channel></rss>'
    rows = [(1, "u", good), (2, "u", mute), (3, "u", "<rss><channel"), (4, "u", mute), (4, "u", good), (None, "u", good), (5, "u", "<feed></feed>")]
    bad = RD.rss_episodes(spark.createDataFrame(rows, "feed_id long, url string, xml string"))[1]
    assert "Join" not in bad._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["feed_id"] for r in bad.collect()) == [2, 3, 5]
