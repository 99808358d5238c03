"""Activity queries: usage, sessions, queue, library views, notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.functions import dates as D
from kbspark.functions import text as T
from kbspark.operators import clean as C
from kbspark.operators import jobs as J
from kbspark.operators import rollups as A
from kbspark.operators import views as VW
from kbspark.plans import sql
from kbspark.sources import tables as S


def _b(c, name=None):
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("long").alias(name or c)


def usage_breakdown(spark, sf):
    return A.usage_breakdown(S.api_usage(spark, sf))


def usage_month(spark, sf):
    return A.usage_breakdown(S.api_usage(spark, sf), "2024-01").drop("month")


def month_cost(spark, sf):
    return A.month_cost(S.api_usage(spark, sf)).withColumn("cost_usd", F.round("cost_usd", 6))


def budget(spark, sf):
    out = A.budget_check(S.api_usage(spark, sf), 3.0)
    return out.select("month", F.round("cost_usd", 6).alias("cost_usd"), _b("over_budget"), "warning")


def call_cost(spark, sf):
    models = F.array(F.lit("claude-sonnet-4-6"), F.lit("claude-haiku-4-5"), F.lit("other"))
    calls = S.api_usage(spark, sf).withColumn("model", F.get(models, (F.col("id") % 3).cast("int"))).drop("cost_usd")
    return A.call_cost(calls).select("id", "model", F.round("cost_usd", 9).alias("cost_usd"),
                                     F.round(A.audio_cost(F.col("input_tokens")), 6).alias("audio_usd"))


def health(spark, sf):
    return A.health(S.jobs(spark, sf), S.sources(spark, sf))


def session_list(spark, sf):
    out = A.session_list(S.messages(spark, sf))
    return out.select("session_id", F.md5("first_question").alias("first_question"), F.md5("earliest_question").alias("earliest_question"),
                      "title", D.iso_z("last_at").alias("last_at"), "n")


def latest_session(spark, sf):
    return A.latest_session(S.messages(spark, sf))


def history_window(spark, sf):
    return A.history_window(S.messages(spark, sf)).select("session_id", "msg_id", "role")


def session_messages(spark, sf):
    """Messages whose stored trace is JSON for some turns and broken for others."""
    raw = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('[{"label":1,"chunk_id":'), F.col("turn").cast("string"), F.lit(',"cited":true}]'))).when(
        F.col("turn") % 3 == 1, "[{broken")
    out = VW.session_messages(S.messages(spark, sf).withColumn("retrieval_trace", raw))
    return out.select("session_id", "msg_id", F.size("trace").cast("long").alias("n_trace"),
                      F.try_element_at("trace", F.lit(1))["chunk_id"].alias("first_chunk"))


def rate_limit(spark, sf):
    out = A.rate_limited(S.given(spark, sf, "events").withColumnRenamed("ts", "created_at"), "event_id", limit=10)
    return out.select("event_id", _b("recent"), _b("refused"))


def rate_limit_by_user(spark, sf):
    out = A.rate_limited(S.given(spark, sf, "events"), "event_id", "user_id", ts="ts", limit=2)
    return out.select("event_id", _b("recent"), _b("refused"))


def queue_position(spark, sf):
    return J.jobs_ahead(S.jobs(spark, sf)).select("job_id", "queue_position")


def list_position(spark, sf):
    return J.list_positions(S.jobs(spark, sf)).select("job_id", "queue_position")


def claim_next(spark, sf):
    return J.claim_next(S.jobs(spark, sf)).select("job_id", "kind")


def job_view(spark, sf):
    return J.job_view(S.jobs(spark, sf)).select(
        "job_id", "kind", "status", "queue_position", F.col("human_error.category").alias("category"))


def job_fold(spark, sf):
    """Events as job events, one job per user and day."""
    k, kind = S.props_k(), F.col("event_type")
    events = S.given(spark, sf, "events").select(
        (F.col("user_id") * 100 + F.dayofmonth("ts")).cast("long").alias("job_id"), F.col("event_id").alias("seq"),
        F.when(kind == "click", "claim").when(kind == "purchase", F.when(k < 30, "done").otherwise("claim"))
        .when(kind == "signup", F.when(k < 10, "duplicate").otherwise("claim")).when(kind == "error", "fail").otherwise("poll").alias("event"),
        F.when(kind == "error", F.concat(F.lit("HTTP error "), (F.lit(400) + k).cast("string"))).alias("error"))
    out = J.fold_jobs(events)
    return out.select("job_id", "status", _b("retries"), "error")


def recover(spark, sf):
    out = J.recover_jobs(S.jobs(spark, sf), F.lit(S.NOW).cast("timestamp"))
    return out.select("job_id", "status", _b("retries"), "error", F.col("payload").alias("payload"), D.iso_z("updated_at").alias("updated"))


def recover_sources(spark, sf):
    stranded = S.sources(spark, sf).withColumn("status", F.when(F.col("status") == "enriched", "processing").otherwise(F.col("status")))
    return J.recover_sources(stranded).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def retry_decision(spark, sf):
    out = J.fail_or_retry(S.jobs(spark, sf).filter(F.col("error").isNotNull()))
    return out.select("job_id", "status", _b("retries"), "payload")


def enqueue(spark, sf):
    """Every document is a candidate; labelled ones lack a summary."""
    src = S.sources(spark, sf)
    return J.enqueue_summaries(src, src, S.jobs(spark, sf))


def library(spark, sf):
    out = VW.library(S.sources(spark, sf), S.jobs(spark, sf))
    return out.select("source_id", "title", "status", F.col("human_error.category").alias("category"))


def latest_error(spark, sf):
    return J.latest_errors(S.jobs(spark, sf))


def library_feed(spark, sf):
    out = VW.library_feed(S.sources(spark, sf), S.jobs(spark, sf))
    return out.groupBy("entry", "status").agg(F.count(F.lit(1)).alias("n"), F.max("queue_position").alias("last_position"))


def week_bucket(spark, sf):
    now = F.lit("2024-01-25 09:00:00").cast("timestamp")
    return S.given(spark, sf, "events").select(D.week_label("ts", now).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def collections(spark, sf):
    return A.collection_counts(S.collections(spark, sf), S.sources(spark, sf))


def unfiled(spark, sf):
    return A.unfiled_count(S.sources(spark, sf))


def library_filter(spark, sf):
    src = S.sources(spark, sf)
    every = C.library_view(src, "text", 7).withColumn("view", F.lit("seven")).unionByName(
        C.library_view(src, None, "none").withColumn("view", F.lit("unfiled"))).unionByName(
        C.chat_scope(src).withColumn("view", F.lit("chat")))
    return every.groupBy("view").agg(F.count(F.lit(1)).alias("n"), F.max("source_id").alias("last_id"))


def recent_sources(spark, sf):
    out = C.recent_sources(S.sources(spark, sf), F.lit(S.NOW).cast("timestamp"), 9, 500)
    return out.select("source_id", D.iso_z("ingested_at").alias("ingested"))


def recent_library(spark, sf):
    return A.library_signature(S.sources(spark, sf))


def card_dates(spark, sf):
    return S.sources(spark, sf).select("source_id", F.date_format(VW.card_date(), "MM/dd").alias("shown"))


def head_text(spark, sf):
    chunks = S.turn_segments(spark, sf).select("source_id", (F.col("source_id") * 1000 + F.col("seq")).alias("chunk_id"), "text")
    titles = chunks.groupBy("source_id").agg(F.concat(F.lit("<"), F.min("chunk_id").cast("string"), F.lit(">")).alias("title"))
    return A.head_text(chunks, titles).select("source_id", F.md5("head").alias("digest"), F.length("head").cast("long").alias("n_chars"))


def _turn_library(spark, sf):
    turns = S.turn_segments(spark, sf)
    chunks = turns.select(
        (F.col("source_id") * 1000 + F.col("seq")).alias("chunk_id"), "source_id",
        F.when(F.col("seq") % 2 == 0, "audio").otherwise("visual").alias("modality"), "text",
        F.when(F.col("seq") % 5 != 4, F.col("start_sec")).alias("start_sec"), "end_sec")
    void = F.lit(None).cast("string")
    sources = turns.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).select(
        "source_id", F.lit("video").alias("type"), F.lit("youtube").alias("platform"), F.concat(F.lit("v"), F.col("source_id").cast("string")).alias("video_id"),
        F.concat(F.lit("talk "), F.col("n").cast("string")).alias("title"), F.when(F.col("source_id") % 2 == 0, "shown").alias("display_title"),
        F.lit("https://y.example/w?v=1").alias("url_normalized"), F.when(F.col("source_id") % 3 == 0, "short").otherwise(void).alias("summary"),
        F.lit(S.EPOCH).cast("timestamp").alias("published_at"))
    return chunks, sources


def transcript_truncate(spark, sf):
    """Which turns of every conversation fit a transcript of 2000 characters."""
    out = VW.mark_truncation(*_turn_library(spark, sf), limit=2000)
    return out.select("chunk_id", _b("used"), _b("fits"))


def transcript_document(spark, sf):
    out = VW.transcript_document(*_turn_library(spark, sf), limit=2000)
    return out.select("source_id", F.length("document").cast("long").alias("n_chars"), F.md5("document").alias("digest"), _b("truncated"))


def export_turns(spark, sf):
    chunks, sources = _turn_library(spark, sf)
    return VW.export_lines(sources, chunks).filter(F.col("part") == 1).select("chunk_id", F.md5("line").alias("digest"))


def chunk_counts(spark, sf):
    return A.chunk_counts(_turn_library(spark, sf)[0])


def pending_notes(spark, sf):
    return A.pending_notes(S.notes(spark, sf))


def note_sources(spark, sf):
    out = VW.note_sources(S.notes(spark, sf), S.sources(spark, sf))
    return out.select("note_id", _b("pos"), "source_id", "title")


def notes_view(spark, sf):
    out = VW.notes_view(S.notes(spark, sf), S.sources(spark, sf), "kept")
    return out.select("note_id", "kind", F.array_join(F.transform("sources", lambda x: x["source_id"].cast("string")), ",").alias("ids"))


def note_text(spark, sf):
    return VW.note_text(S.notes(spark, sf), S.sources(spark, sf)).select("note_id", F.md5("line").alias("digest"))


def source_list_text(spark, sf):
    return VW.source_list_text(S.sources(spark, sf))


def in_order(spark, sf):
    """Turns of every session with the library's display order as a number."""
    from kbspark.operators.blocks import row_index

    rows = S.messages(spark, sf).select("session_id", "msg_id")
    return row_index(rows, ["session_id"], "msg_id", "position", width=4)


QUERIES = {f.__name__: f for f in (
    usage_breakdown, usage_month, month_cost, budget, call_cost, health, session_list, latest_session, history_window, session_messages,
    rate_limit, rate_limit_by_user, queue_position, list_position, claim_next, job_view, job_fold, recover, recover_sources, retry_decision,
    enqueue, library, latest_error, library_feed, week_bucket, collections, unfiled, library_filter, recent_sources, recent_library,
    card_dates, head_text, transcript_truncate, transcript_document, export_turns, chunk_counts, pending_notes, note_sources, notes_view,
    note_text, source_list_text, in_order)}

_U = "u AS (SELECT event_id AS id, ts, event_type AS provider, 'm' || (user_id % 3) AS model, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value / 10000 AS cost FROM events)"
_AGG = "count(*) AS calls, CAST(sum(k) AS BIGINT) AS input_tokens, CAST(sum(k * 2) AS BIGINT) AS output_tokens, round(sum(cost), 4) AS cost_usd"
_FOLD = f"""
ev AS (SELECT user_id * 100 + day(ts) AS job_id, event_id AS seq, event_type AS e, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
x AS (SELECT job_id, seq, CASE e WHEN 'click' THEN 'claim' WHEN 'purchase' THEN (CASE WHEN k < 30 THEN 'done' ELSE 'claim' END)
  WHEN 'signup' THEN (CASE WHEN k < 10 THEN 'duplicate' ELSE 'claim' END) WHEN 'error' THEN 'fail' ELSE 'poll' END AS ev,
  CASE WHEN e = 'error' THEN 'HTTP error ' || (400 + k) END AS error FROM ev),
y AS (SELECT *, count(*) FILTER (WHERE ev = 'fail') OVER (PARTITION BY job_id ORDER BY seq) AS fails, coalesce({sql.CATEGORY} IN ('login_wall', 'content_gone'), false) AS perm FROM x),
z AS (SELECT *, (ev IN ('done', 'duplicate') OR (ev = 'fail' AND (perm OR fails >= 3))) AS ends FROM y),
s AS (SELECT job_id, min(seq) AS stop FROM z WHERE ends GROUP BY 1),
l AS (SELECT z.*, s.stop FROM z LEFT JOIN s USING (job_id) WHERE stop IS NULL OR seq <= stop),
a AS (SELECT job_id, arg_max(ev, seq) FILTER (WHERE ev <> 'poll') AS last, count(*) FILTER (WHERE ev = 'fail') AS retries, arg_max(error, seq) FILTER (WHERE ev = 'fail') AS err, max(stop) AS stop FROM l GROUP BY 1)"""
_STAMP = "CASE WHEN {s} IS NULL THEN '' WHEN {s} >= 3600 THEN printf('[%d:%02d:%02d]', CAST({s} AS BIGINT) // 3600, CAST({s} AS BIGINT) % 3600 // 60, CAST({s} AS BIGINT) % 60) ELSE printf('[%d:%02d]', CAST({s} AS BIGINT) // 60, CAST({s} AS BIGINT) % 60) END"
_TURNS = f"""
c AS (SELECT conv_id AS source_id, conv_id * 1000 + turn AS chunk_id, text, CASE WHEN turn % 5 <> 4 THEN turn * 10 END AS st, turn FROM conversations),
b AS (SELECT *, regexp_replace({_STAMP.format(s="st")} || CASE WHEN turn % 2 = 1 THEN '(visual)' ELSE '' END || ' ' || text, '^\\s+|\\s+$', '', 'g') AS block FROM c),
h AS (SELECT source_id, list_filter(['{VW.UNTRUSTED_NOTE}', '# ' || CASE WHEN source_id % 2 = 0 THEN 'shown' ELSE 'talk ' || count(*) END,
  'source_id=' || source_id || '|類型 video|平台 youtube|發布 2024-01-01|https://y.example/w?v=1', CASE WHEN source_id % 2 = 0 THEN '原始標題:talk ' || count(*) END, '',
  CASE WHEN source_id % 3 = 0 THEN '## 摘要' END, CASE WHEN source_id % 3 = 0 THEN 'short' END, CASE WHEN source_id % 3 = 0 THEN '' END, '## 逐字稿'], lambda x: x IS NOT NULL) AS head FROM c GROUP BY 1),
u AS (SELECT b.*, head, CAST(sum(length(block)) OVER (PARTITION BY b.source_id ORDER BY coalesce(st, 0), chunk_id) AS BIGINT) AS used,
  list_sum(list_transform(head, lambda x: length(x))) AS hl FROM b JOIN h USING (source_id))"""

def admission_sql(key: str, limit: int) -> str:
    """Row by row: the admitted times of the last hour, and whether one more fits."""
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, {key} AS k, CAST(floor(epoch(ts)) AS BIGINT) AS s,
  row_number() OVER (PARTITION BY {key} ORDER BY floor(epoch(ts)), event_id) AS r FROM events),
w AS (SELECT k, r, event_id, 0 AS recent, [s] AS a FROM e WHERE r = 1 UNION ALL
  SELECT k, r, event_id, len(l) AS recent, CASE WHEN len(l) < {limit} THEN list_append(l, s) ELSE l END AS a
  FROM (SELECT e.*, list_filter(w.a, lambda x: x > e.s - 3600) AS l FROM w JOIN e ON e.k = w.k AND e.r = w.r + 1))
SELECT event_id, CAST(recent AS BIGINT) AS recent, CAST(recent >= {limit} AS BIGINT) AS refused FROM w"""


ORACLES = {
    "usage_breakdown": f"WITH {_U} SELECT strftime(ts, '%Y-%m') AS month, provider, model, {_AGG} FROM u GROUP BY 1, 2, 3",
    "usage_month": f"WITH {_U} SELECT provider, model, {_AGG} FROM u WHERE strftime(ts, '%Y-%m') = '2024-01' GROUP BY 1, 2",
    "month_cost": f"WITH {_U} SELECT strftime(ts, '%Y-%m') AS month, round(sum(cost), 6) AS cost_usd FROM u GROUP BY 1",
    "budget": f"""WITH {_U}, m AS (SELECT strftime(ts, '%Y-%m') AS month, sum(cost) AS c FROM u GROUP BY 1)
SELECT month, round(c, 6) AS cost_usd, CAST(c > 3 AS BIGINT) AS over_budget, CASE WHEN c > 3 THEN printf('⚠️ 本月 API 費用約 US$%.2f,已超過預算 US$3.00', c) END AS warning FROM m""",
    "call_cost": f"""WITH {_U} SELECT id, CASE id % 3 WHEN 0 THEN 'claude-sonnet-4-6' WHEN 1 THEN 'claude-haiku-4-5' ELSE 'other' END AS model,
 round(CASE id % 3 WHEN 0 THEN k / 1e6 * 3 + k * 2 / 1e6 * 15 WHEN 1 THEN k / 1e6 + k * 2 / 1e6 * 5 ELSE 0.0 END, 9) AS cost_usd, round(k / 3600.0::DOUBLE * 0.111::DOUBLE, 6) AS audio_usd FROM u""",
    "health": f"WITH {sql.SOURCES}, {sql.JOBS} SELECT (SELECT count(*) FROM jobs WHERE status IN ('pending', 'processing')) AS queue_length, count(*) FILTER (WHERE status = 'failed') AS failed_sources, count(*) AS source_count FROM src",
    "session_list": """SELECT CAST(conv_id AS VARCHAR) AS session_id, md5(min(text) FILTER (WHERE role = 'user')) AS first_question, md5(arg_min(text, turn) FILTER (WHERE role = 'user')) AS earliest_question,
 substr(coalesce(min(text) FILTER (WHERE role = 'user'), '(無標題)'), 1, 60) AS title, strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id % 720 AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ') AS last_at, count(*) AS n FROM conversations GROUP BY conv_id""",
    "latest_session": "SELECT CAST(arg_max(conv_id, conv_id * 1000 + turn) AS VARCHAR) AS session_id FROM conversations",
    "history_window": """SELECT CAST(conv_id AS VARCHAR) AS session_id, conv_id * 1000 + turn AS msg_id, role FROM conversations
 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10""",
    "session_messages": """SELECT CAST(conv_id AS VARCHAR) AS session_id, conv_id * 1000 + turn AS msg_id, CAST(turn % 3 = 0 AS BIGINT) AS n_trace, CASE WHEN turn % 3 = 0 THEN turn END AS first_chunk FROM conversations""",
    "rate_limit": admission_sql("0", 10),
    "rate_limit_by_user": admission_sql("user_id", 2),
    "queue_position": f"""WITH {sql.JOBS}, r AS (SELECT job_id, status, count(*) FILTER (WHERE status IN ('pending', 'processing')) OVER (ORDER BY job_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS queue_position FROM jobs)
SELECT job_id, queue_position FROM r WHERE status = 'pending'""",
    "list_position": f"""WITH {sql.JOBS} SELECT job_id, row_number() OVER (ORDER BY job_id) - 1 AS queue_position FROM jobs WHERE kind <> 'summarize' AND status = 'pending' AND source_id IS NULL""",
    "claim_next": f"WITH {sql.JOBS} SELECT job_id, kind FROM jobs WHERE status = 'pending' ORDER BY job_id LIMIT 1",
    "job_view": f"""WITH {sql.JOBS}, r AS (SELECT *, count(*) FILTER (WHERE status IN ('pending', 'processing')) OVER (ORDER BY job_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM jobs)
SELECT job_id, kind, status, CASE WHEN status = 'pending' THEN q END AS queue_position, CASE WHEN status = 'failed' AND error IS NOT NULL THEN {sql.CATEGORY} END AS category FROM r""",
    "job_fold": f"""WITH {_FOLD} SELECT job_id, CASE WHEN last IN ('done', 'duplicate') THEN last WHEN last = 'fail' THEN (CASE WHEN stop IS NOT NULL THEN 'failed' ELSE 'pending' END)
 WHEN last = 'claim' THEN 'processing' ELSE 'pending' END AS status, retries, CASE WHEN coalesce(last, '') NOT IN ('done', 'duplicate') AND last IS NOT NULL THEN err END AS error FROM a""",
    "recover": f"""WITH {sql.JOBS}, r AS (SELECT job_id, kind, payload, CASE WHEN status <> 'processing' THEN status WHEN retries < max_retries THEN 'pending' ELSE 'failed' END AS status,
 retries + CASE WHEN status = 'processing' THEN 1 ELSE 0 END AS retries, CASE WHEN status = 'processing' THEN coalesce(error, 'recovered after restart') ELSE error END AS error,
 CASE WHEN jobs.status = 'processing' THEN TIMESTAMP '2024-01-31' ELSE ts END AS u FROM jobs JOIN events ON event_id = job_id)
SELECT job_id, status, retries, error, CASE WHEN kind = 'ingest_text' AND status IN ('done', 'duplicate', 'failed') THEN '{{}}' ELSE payload END AS payload, strftime(u, '%Y-%m-%dT%H:%M:%SZ') AS updated FROM r""",
    "recover_sources": f"WITH {sql.SOURCES} SELECT CASE WHEN status = 'enriched' THEN 'failed' ELSE status END AS status, count(*) AS n FROM src GROUP BY 1",
    "retry_decision": f"""WITH {sql.JOBS}, c AS (SELECT *, {sql.CATEGORY} IN ('login_wall', 'content_gone') OR retries + 1 >= max_retries AS dead FROM jobs WHERE error IS NOT NULL)
SELECT job_id, CASE WHEN dead THEN 'failed' ELSE 'pending' END AS status, retries + 1 AS retries, CASE WHEN dead AND kind = 'ingest_text' THEN '{{}}' ELSE payload END AS payload FROM c""",
    "enqueue": f"""WITH {sql.SOURCES}, {sql.JOBS} SELECT source_id FROM src WHERE coalesce(summary, '') = '' AND source_id NOT IN (
 SELECT source_id FROM jobs WHERE kind = 'summarize' AND status IN ('pending', 'processing') AND source_id IS NOT NULL)""",
    "library": f"""WITH {sql.SOURCES}, {sql.JOBS}, e AS (SELECT source_id, arg_max(error, job_id) AS error FROM jobs WHERE error IS NOT NULL AND source_id IS NOT NULL GROUP BY 1)
SELECT source_id, title, status, CASE WHEN status = 'failed' THEN (CASE WHEN error IS NULL THEN 'unknown' ELSE {sql.CATEGORY} END) END AS category FROM src LEFT JOIN e USING (source_id)""",
    "latest_error": f"WITH {sql.JOBS} SELECT source_id, arg_max(error, job_id) AS error FROM jobs WHERE error IS NOT NULL AND source_id IS NOT NULL GROUP BY 1",
    "library_feed": f"""WITH {sql.SOURCES}, {sql.JOBS}, q AS (SELECT job_id, status, CASE WHEN status = 'pending' THEN count(*) FILTER (WHERE status = 'pending') OVER (ORDER BY job_id) - 1 END AS p FROM jobs
 WHERE kind <> 'summarize' AND status IN ('pending', 'processing') AND source_id IS NULL)
SELECT 'queued' AS entry, status, count(*) AS n, max(p) AS last_position FROM q GROUP BY 2 UNION ALL SELECT 'source', status, count(*), NULL FROM src GROUP BY 2""",
    "week_bucket": """SELECT CASE WHEN ts >= TIMESTAMP '2024-01-22' THEN '本週' WHEN ts >= TIMESTAMP '2024-01-15' THEN '上週' ELSE year(ts) || '年' || month(ts) || '月' END AS bucket, count(*) AS n FROM events GROUP BY 1""",
    "collections": """SELECT CAST(substr(c.source, 4) AS BIGINT) AS collection_id, c.source AS name, count(d.doc_id) AS source_count FROM (SELECT DISTINCT source FROM documents) c
 LEFT JOIN documents d ON d.source = c.source AND d.source <> 'src0' GROUP BY 1, 2""",
    "unfiled": "SELECT count(*) AS unfiled_count FROM documents WHERE source = 'src0'",
    "library_filter": f"""WITH {sql.SOURCES} SELECT 'seven' AS view, count(*) AS n, max(source_id) AS last_id FROM src WHERE collection_id = 7
 UNION ALL SELECT 'unfiled', count(*), max(source_id) FROM src WHERE collection_id IS NULL UNION ALL SELECT 'chat', count(*), max(source_id) FROM src WHERE status <> 'failed'""",
    "recent_sources": f"""WITH {sql.SOURCES} SELECT source_id, strftime(ingested_at, '%Y-%m-%dT%H:%M:%SZ') AS ingested FROM src WHERE ingested_at >= TIMESTAMP '2024-01-22' ORDER BY source_id DESC LIMIT 200""",
    "recent_library": f"""WITH {sql.SOURCES}, t AS (SELECT source_id, ingested_at FROM src WHERE status <> 'failed' ORDER BY ingested_at DESC, source_id DESC LIMIT 8)
SELECT string_agg(source_id, ':' ORDER BY ingested_at DESC, source_id DESC) AS signature FROM t""",
    "card_dates": f"WITH {sql.SOURCES} SELECT source_id, strftime(ingested_at, '%m/%d') AS shown FROM src",
    "head_text": """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, min(turn) OVER (PARTITION BY conv_id) AS t0 FROM conversations),
j AS (SELECT conv_id, '<' || (conv_id * 1000 + min(t0)) || '>' || chr(10) || string_agg(text, chr(10) ORDER BY turn) AS x FROM t WHERE rn <= 3 GROUP BY 1),
h AS (SELECT conv_id, substr(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), 1, 1500) AS head FROM j)
SELECT conv_id AS source_id, md5(head) AS digest, length(head) AS n_chars FROM h""",
    "transcript_truncate": f"WITH {_TURNS} SELECT chunk_id, used, CAST(used + hl <= 2000 AS BIGINT) AS fits FROM u",
    "transcript_document": f"""WITH {_TURNS}, g AS (SELECT source_id, any_value(head) AS head, list(block ORDER BY coalesce(st, 0), chunk_id) FILTER (WHERE used + hl <= 2000) AS bs, bool_or(used + hl > 2000) AS cut FROM u GROUP BY 1),
d AS (SELECT source_id, cut, array_to_string(list_concat(list_concat(head, coalesce(bs, [])), CASE WHEN cut THEN ['{VW.TRUNCATED_NOTE}'] ELSE [] END), chr(10)) AS doc FROM g)
SELECT source_id, length(doc) AS n_chars, md5(doc) AS digest, CAST(cut AS BIGINT) AS truncated FROM d""",
    "export_turns": """SELECT conv_id * 1000 + turn AS chunk_id, md5(printf('**[%d:%02d](https://y.example/w?v=1&t=%ds)**', s // 60, s % 60, s) || chr(10) || text || chr(10)) AS digest
FROM (SELECT *, CASE WHEN turn % 5 <> 4 THEN turn * 10 ELSE 0 END AS s FROM conversations)""",
    "chunk_counts": "SELECT conv_id AS source_id, count(*) AS n_chunks FROM conversations GROUP BY 1",
    "pending_notes": "SELECT count(*) AS pending_count FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)",
    "note_sources": f"""WITH {sql.SOURCES}, n AS (SELECT doc_id AS note_id, unnest([0, 1]) AS pos FROM documents)
SELECT note_id, CAST(pos AS BIGINT) AS pos, note_id + pos AS source_id, nullif(title, '') AS title FROM n LEFT JOIN src ON src.source_id = note_id + pos""",
    "notes_view": f"""WITH {sql.NOTES} SELECT note_id, kind, note_id || ',' || (note_id + 1) AS ids FROM notes WHERE status = 'kept' ORDER BY note_id DESC LIMIT 100""",
    "note_text": f"""WITH {sql.SOURCES}, {sql.NOTES}, s AS (SELECT source_id, CASE WHEN title <> '' THEN '「' || title || '」' END AS n FROM src)
SELECT note_id, md5('【' || kind || '】' || n.title || '(note_id=' || note_id || ',' || strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(note_id % 720 AS BIGINT)), '%Y-%m-%d') || ')' || chr(10) || content || chr(10) || '應用:' || application
 || chr(10) || '溯源:' || coalesce(a.n, '(來源 ' || note_id || ' 已刪除)') || '、' || coalesce(b.n, '(來源 ' || (note_id + 1) || ' 已刪除)')) AS digest
FROM notes n LEFT JOIN s a ON a.source_id = note_id LEFT JOIN s b ON b.source_id = note_id + 1""",
    "source_list_text": f"""WITH {sql.SOURCES} SELECT source_id, 'source_id=' || source_id || '|' || CASE WHEN title = '' THEN '(未命名)' ELSE title END || '|manual/text|發布 ' || strftime(ingested_at, '%Y-%m-%d') || '|入庫 '
 || strftime(ingested_at, '%Y-%m-%d') || '|' || status || '|' || CASE WHEN summary IS NOT NULL THEN '已摘要' ELSE '無摘要' END AS line FROM src""",
    "in_order": "SELECT CAST(conv_id AS VARCHAR) AS session_id, conv_id * 1000 + turn AS msg_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations",
}
