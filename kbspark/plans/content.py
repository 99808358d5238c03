"""Content queries: identity, routing, cleaning, chunking, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.functions import dates as D
from kbspark.functions import rules as RU
from kbspark.functions import text as T
from kbspark.functions import urls as U
from kbspark.operators import chunking as K
from kbspark.operators import clean as C
from kbspark.operators import identity as I
from kbspark.operators import maintain as M
from kbspark.operators import views as VW
from kbspark.plans import sql
from kbspark.session import cut_lineage
from kbspark.sources import readers as RD
from kbspark.sources import tables as S


def _b(c, name=None):
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("long").alias(name or c)


def _shared_link():
    """A shared link of a document, in the forms that links arrive in."""
    h, d = F.md5("text"), F.col("doc_id").cast("string")
    forms = [
        F.concat(F.lit("https://youtu.be/"), F.left(h, F.lit(11)), F.lit("?si="), d),
        F.concat(F.lit("http://www.youtube.com/watch?list=a&v="), F.left(h, F.lit(11)), F.lit("&t=3s")),
        F.concat(F.lit("https://m.youtube.com/shorts/"), F.left(h, F.lit(11))),
        F.concat(F.lit("https://youtube.com.evil.com/watch?v="), F.left(h, F.lit(11))),
        F.concat(F.lit("https://www.tiktok.com/@u"), d, F.lit("/photo/"), d, F.lit("?x=1")),
        F.concat(F.lit("https://WWW.Instagram.com/reels/"), F.left(h, F.lit(9)), F.lit("/?igsh=q")),
        F.concat(F.lit("https://youtu.be/"), F.left(h, F.lit(8))),
        F.concat(F.lit("ftp://youtube.com/"), d),
        F.concat(F.lit("https://user@youtube.com:443/live/"), F.left(h, F.lit(11)), F.lit("#top")),
        F.concat(F.lit("https://vm.tiktok.com/"), F.left(h, F.lit(7))),
    ]
    return F.get(F.array(*forms), (F.col("doc_id") % 10).cast("int"))


def _shared_links(spark, sf):
    return S.given(spark, sf, "documents").select("doc_id", _shared_link().alias("url"))


def canonical_urls(spark, sf):
    return I.canonical_urls(_shared_links(spark, sf)).drop("url")


def classify_pages(spark, sf):
    pages = S.given(spark, sf, "pages").select("page_id", "url")
    return I.classify(pages).select("page_id", "platform", "content_id", "canonical_url", U.article_url_id("url").alias("url_id"))


def expand_redirects(spark, sf):
    """Chains of short links over the pages; some leave the whitelist, some are too long."""
    p = F.col("page_id")
    base = S.given(spark, sf, "pages").select("page_id", "url")
    short = F.concat(F.lit("https://youtu.be/r"), p.cast("string"))
    hops = base.select(short.alias("from_url"), F.when(p % 5 == 4, F.col("url")).otherwise(
        F.concat(F.lit("/r"), (p + 1).cast("string"))).alias("location")).filter(F.col("location").isNotNull())
    ends = hops.filter(~F.col("from_url").rlike("[69]$"))
    out = I.expand_redirects(base.select("page_id", short.alias("url")), ends)
    return out.select("page_id", "final_url", "expand_status")


def content_ids(spark, sf):
    return S.given(spark, sf, "documents").select(
        "doc_id", T.content_id("text").alias("content_id"), T.episode_id("text").alias("episode_id"))


def line_routing(spark, sf):
    url = F.col("url")
    pages = S.given(spark, sf, "pages").select("page_id", F.explode(F.array(
        url, F.concat(F.lit("  "), url, F.lit("\n\n "), url), F.concat(url, F.lit("\nnote")), F.lit(" \n "))).alias("paste"))
    return pages.select("page_id", "paste", _b(T.is_bare_url("paste"), "bare"), _b(T.is_url_batch("paste"), "batch"))


def route_ingest(spark, sf):
    """Pages as the incoming batch, labelled pages as the library."""
    pages = I.classify(S.given(spark, sf, "pages").select("page_id", "url"))
    labels = S.given(spark, sf, "labels").withColumnRenamed("doc_id", "page_id")
    library = pages.join(labels, "page_id").select(
        F.col("page_id").alias("source_id"), "platform", F.col("content_id").alias("video_id"),
        F.when(F.col("quality") == 1, "ready").otherwise("failed").alias("status"))
    return I.route_ingest(pages, library, "page_id").select("page_id", "content_id", "routing", "known_source_id")


def text_gate(spark, sf):
    out = I.route_text(S.given(spark, sf, "documents"), "text")
    return out.select("doc_id", "content_id", _b("is_url"), "reject_reason")


def text_sources(spark, sf):
    now = F.lit(S.NOW).cast("timestamp")
    out = RD.text_sources(S.given(spark, sf, "documents").select("doc_id", "text", "lang"), "text", now=now)
    return out.select("doc_id", "platform", "type", "video_id", "title", "url_normalized", D.iso_z("published_at").alias("published"))


def _signatures(spark, sf):
    return S.given(spark, sf, "embeddings").select("vec_id", "label", I.average_hash("embedding").alias("sig"))


def average_hash(spark, sf):
    return _signatures(spark, sf).select("vec_id", "sig")


def near_dedup(spark, sf):
    return I.near_dedup(_signatures(spark, sf), "label", "vec_id", "sig", 24).select("vec_id", _b("label"))


def wall_reason(spark, sf):
    return S.given(spark, sf, "documents").select("doc_id", RU.wall_reason("text").alias("reason"))


def repeat_limit(spark, sf):
    return C.mark_segments(S.raw_segments(spark, sf)).select("media_id", "seq", "reason")


def filter_counts(spark, sf):
    return C.filter_counts(C.mark_segments(S.raw_segments(spark, sf)))


def duration_gate(spark, sf):
    e = S.given(spark, sf, "events")
    feed, probed = F.when(S.props_k() > 20, S.props_k() * 150), F.when(F.col("event_type") != "view", F.col("value") * 300)
    return e.select("event_id", _b(C.duration_rejects(feed, probed), "rejected"))


def speech_coverage(spark, sf):
    segs = S.raw_segments(spark, sf)
    media = segs.groupBy("media_id").agg(F.count(F.lit(1)).alias("n")).select(
        "media_id", F.when(F.col("media_id") % 7 != 3, (F.col("n") * 5.0) * (F.col("media_id") % 5)).alias("duration_secs"),
        (F.col("media_id") % 10 == 0).alias("has_captions"))
    kept = C.filter_segments(segs)
    return C.speech_coverage(media, kept).select(
        "media_id", _b("n_segments"), F.round("coverage", 6).alias("coverage"), _b("hollow"))


def error_class(spark, sf):
    jobs = S.jobs(spark, sf).filter(F.col("error").isNotNull())
    return jobs.select("job_id", "error", RU.error_category("error").alias("category"),
                       _b(RU.is_permanent("error"), "permanent"), RU.translate_error("error")["action_kind"].alias("action_kind"))


def transport_message(spark, sf):
    text = (F.when(F.col("event_type") == "error", F.concat(F.lit("Dial TCP "), F.col("value").cast("string")))
            .when(F.col("event_type") == "view", "ssh: unable to authenticate").when(F.col("event_type") == "click", "directory Not Found")
            .otherwise("odd"))
    return S.given(spark, sf, "events").select(RU.transport_message(text).alias("message")).groupBy("message").agg(F.count(F.lit(1)).alias("n"))


def token_estimate(spark, sf):
    return S.given(spark, sf, "documents").select("doc_id", T.chunk_tokens("text").alias("chunk_tokens"), T.prompt_tokens("text").alias("prompt_tokens"))


def sentence_split(spark, sf):
    return K.sentence_pieces(S.document_segments(spark, sf)).select(F.col("source_id").alias("doc_id"), _b("piece"), "sentence")


def vocab_prefix(spark, sf):
    lines = S.turn_segments(spark, sf).select(F.col("source_id").alias("vocab_id"), F.col("seq").alias("line_no"), F.col("text").alias("line"))
    return K.vocabulary_prefix(lines).select("vocab_id", "prompt", _b("kept"), _b("total"))


def _chunk_rows(df):
    return df.select("source_id", "chunk_seq", "n_tokens", "n_segments", F.md5("text").alias("digest"),
                     F.round("start_sec", 3).alias("start_sec"), F.round("end_sec", 3).alias("end_sec"))


def chunk(spark, sf):
    return _chunk_rows(K.chunk(S.document_segments(spark, sf)))


def chunk_turns(spark, sf):
    return _chunk_rows(K.chunk(S.turn_segments(spark, sf)))


def chunk_events(spark, sf):
    """All events as one transcript: low values are missing, some texts are blank."""
    k = F.get_json_object("props", "$.k").cast("int")
    segs = S.given(spark, sf, "events").filter("value >= 3").select(
        F.lit(1).cast("long").alias("source_id"), F.col("event_id").alias("seq"),
        F.when(k % 5 == 0, "  ").otherwise(F.concat_ws(" ", "event_type", "props")).alias("text"),
        (F.col("event_id") * 1.0).alias("start_sec"), (F.col("event_id") + 1.0).alias("end_sec"))
    return _chunk_rows(K.chunk(segs, width=K.HALO))


def chunk_stats(spark, sf):
    """Packing checks, reconciled with the segments."""
    segments = S.document_segments(spark, sf)
    return K.chunk_audit(segments, K.chunk(segments)).select(*[_b(c) for c in (
        "n_chunks", "n_sources", "max_tokens", "min_tokens", "over_limit", "bad_times", "blank_chunks", "n_pieces", "lost", "disordered", "repeated",
        "overlapping", "overlap_chars", "late_starts")])


def chunk_overlap(spark, sf):
    return K.chunk_overlap(K.chunk(S.document_segments(spark, sf)))


def chunk_overlap_turns(spark, sf):
    return K.chunk_overlap(K.chunk(S.turn_segments(spark, sf)))


def chunk_ledger(spark, sf):
    """Chunks of transcripts with missing turns and missing or doubled chunks, against all turns."""
    segments = S.turn_segments(spark, sf)
    packed = K.chunk(segments.filter((F.col("source_id") * 7 + F.col("seq")) % 31 != 0), max_seq=1)
    c = F.col("source_id")
    packed = cut_lineage(packed.filter(~((c % 9 == 4) & (F.col("chunk_seq") == 1))))
    twice = packed.unionByName(packed.filter(c % 13 == 6))
    return K.chunk_ledger(segments, twice).select("source_id", "chunk_seq", "n_pieces", "lost", "disordered", _b("repeated"))


def note_validation(spark, sf):
    """Notes checked against the sources that have a quality label."""
    known = S.given(spark, sf, "labels").select(F.col("doc_id").alias("source_id"))
    out = C.validate_notes(S.notes(spark, sf), known)
    return out.select("note_id", "reject_reason", F.length("title").cast("long").alias("title_len"),
                      F.length("content").cast("long").alias("content_len"))


def collection_names(spark, sf):
    """First line of every conversation's turns offered as a collection name."""
    offered = S.given(spark, sf, "conversations").select("conv_id", "turn", F.concat(
        F.lit("  "), F.when(F.col("turn") % 3 == 0, F.concat(F.lit("src"), F.col("turn").cast("string"))).otherwise(T.first_line("text", 40))).alias("name"))
    return C.clean_collection_names(offered, S.collections(spark, sf)).select("conv_id", "turn", "name", "reject_reason")


def episode_coercion(spark, sf):
    turns = S.given(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.length("text") > 60, F.col("text")).alias("guid"), F.col("text").alias("title"),
        F.concat(F.lit("https://a.example/"), F.col("text")).alias("audio_url"), F.lit("").alias("link"),
        F.when(F.col("turn") % 2 == 0, F.col("turn").cast("string")).otherwise("x1").alias("duration_secs"))
    out = C.coerce_episodes(turns, "conv_id", "turn")
    return out.select("conv_id", "turn", F.length("title").cast("long").alias("title_len"), "duration_secs", "link", "reject_reason")


def page_articles(spark, sf):
    out = RD.page_articles(S.given(spark, sf, "pages"))
    return out.select("page_id", "video_id", "title", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"), "reject_reason")


def rendered_pages(spark, sf):
    """Documents wrapped the way a renderer returns pages, every third without a marker."""
    d = F.col("doc_id").cast("string")
    head = F.concat(F.lit("Title: page "), d, F.lit("\n\nURL Source: https://x.example/"), d, F.lit("\nPublished Time: 2024-02-0"),
                    (F.col("doc_id") % 9 + 1).cast("string"), F.lit("T10:20:30Z\nMarkdown Content:\n"))
    docs = S.given(spark, sf, "documents").select("doc_id", F.concat(F.lit("https://x.example/"), d).alias("url"), F.concat(
        F.when(F.col("doc_id") % 3 != 0, head).otherwise("Title: prose\n"), F.col("text")).alias("raw"))
    out = RD.parse_rendered(docs)
    return out.select("doc_id", "title", D.iso_z("published_at").alias("published"), F.md5("text").alias("digest"), "reject_reason")


def _feeds(spark, sf):
    """A feed per document: its text is the title of the first item and its digest names the others."""
    d = F.col("doc_id").cast("string")
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def item(i):
        n = i.cast("string")
        guid = F.when(i % 3 == 0, "").otherwise(F.concat(F.lit('<guid isPermaLink="false">'), F.md5("text"), F.lit("-"), d, F.lit("-"), n, F.lit("</guid>")))
        kind = F.when(i % 5 == 4, "image/png").when(i % 5 == 3, "").otherwise("audio/mpeg")
        return F.concat(
            F.lit("<item><title> "), F.when(i == 0, safe).otherwise(F.concat(F.lit("ep "), n)), F.lit(" </title><itunes:title>short</itunes:title>"), guid, F.lit("<pubDate>Wed, 0"), (i % 9 + 1).cast("string"),
            F.lit(" Oct 2002 13:00:00 +0200</pubDate><itunes:duration>1:0"), (i % 10).cast("string"),
            F.lit(":07</itunes:duration><enclosure url=\"https://a.example/"), d, F.lit("/"), n, F.lit(".mp3\" type=\""), kind,
            F.lit("\"/><enclosure url=\"https://a.example/v.mp4\" type=\"video/mp4\"/></item>"))

    n_items = (F.length("text") % 40).cast("int")
    items = F.transform(F.slice(F.sequence(F.lit(0), F.lit(39)), F.lit(1), n_items), item)
    return S.given(spark, sf, "documents").select(F.col("doc_id").alias("feed_id"), F.concat(F.lit("https://f.example/"), d).alias("url"), F.concat(
        F.lit("<rss version=\"2.0\" xmlns:itunes=\"http://www.itunes.com/dtds/podcast-1.0.dtd\"><channel><title>"),
        F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("feed "), d)), F.lit("</title>"),
        F.array_join(items, ""), F.lit("</channel></rss>")).alias("xml"))


def rss_episodes(spark, sf):
    episodes, _ = RD.rss_episodes(_feeds(spark, sf))
    return episodes.select("feed_id", "feed_title", _b("position"), "guid", F.md5("title").alias("title_digest"), "audio_url", D.iso_z("published_at").alias("published"),
                           "duration_secs", "episode_id")


def rss_errors(spark, sf):
    return RD.rss_episodes(_feeds(spark, sf))[1]


def episodes_in_library(spark, sf):
    """Feed items against a library that holds every third episode of each feed."""
    episodes, _ = RD.rss_episodes(_feeds(spark, sf))
    stored = episodes.filter(F.col("position") % 3 == 0).select(
        F.lit("podcast").alias("platform"), F.col("episode_id").alias("video_id"),
        F.when(F.col("feed_id") % 2 == 0, "ready").otherwise("failed").alias("status"))
    return I.in_library(episodes, stored).groupBy("feed_id").agg(
        F.count(F.lit(1)).alias("episodes"), F.count_if("in_library").alias("stored"))


_LANGS = ("zh-CN", "en", "fr", "zh-TW", "de", "zh")


def caption_pick(spark, sf):
    langs = F.array(*[F.lit(x) for x in _LANGS])
    tracks = S.given(spark, sf, "events").select(
        F.floor(F.col("event_id") / 6).alias("video_id"), F.col("event_id").alias("pos"),
        F.get(langs, (S.props_k() % 6).cast("int")).alias("lang"), (F.col("event_type").isin("view", "click")).alias("is_generated"))
    return RD.pick_captions(tracks).select(_b("video_id"), "pos", "lang")


def caption_segments(spark, sf):
    snippets = S.given(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") % 4 != 1, F.concat(F.lit(" "), F.col("text"), F.lit(" "))).otherwise(" ").alias("text"),
        (F.col("turn") * 2.5).alias("start"), F.lit(2.0).alias("duration"))
    return RD.caption_segments(snippets).select("conv_id", "turn", "start_sec", "end_sec", F.md5("text").alias("digest"))


def timeline_merge(spark, sf):
    segs = S.raw_segments(spark, sf).select("media_id", (F.col("seq") % 4).cast("int").alias("part"), "seq",
                                            (F.col("seq") % 100).cast("double").alias("start_sec"), (F.col("seq") % 100 + 1.5).alias("end_sec"))
    media = segs.groupBy("media_id").agg(F.lit(80_000_000).alias("n_bytes"), (F.count(F.lit(1)) * 60.0).alias("duration_secs"))
    return RD.merge_parts(segs, RD.part_offsets(media)).select("media_id", "seq", F.round("start_sec", 3).alias("start_sec"), F.round("end_sec", 3).alias("end_sec"))


def description_lines(spark, sf):
    docs = S.given(spark, sf, "documents").select("doc_id", "text", F.transform(
        F.sequence(F.lit(0), (F.col("doc_id") % 5).cast("int")), lambda i: i * 2.0).alias("times"))
    return RD.lines_to_chunks(docs).select("doc_id", _b("pos"), "start_sec", F.md5("text").alias("digest"))


def export_md(spark, sf):
    lines = VW.export_lines(S.sources(spark, sf), S.whole_chunks(spark, sf))
    return lines.select("source_id", _b("part"), "chunk_id", F.md5("line").alias("digest"))


def date_parsing(spark, sf):
    """Every event time written in one of the accepted forms and read back."""
    ts = F.col("ts")
    forms = [F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+08:00'"), F.date_format(ts, "yyyy/MM/dd"),
             F.concat(F.lit("Mon, "), F.date_format(ts, "d MMM yyyy HH:mm:ss"), F.lit(" -0500")), F.date_format(ts, "yyyyMMdd"),
             F.unix_timestamp(ts).cast("string"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("not a date")]
    raw = F.get(F.array(*forms), (F.col("event_id") % 8).cast("int"))
    return S.given(spark, sf, "events").select("event_id", D.iso_z(D.published_time(raw)).alias("parsed"))


def duration_parsing(spark, sf):
    k = S.props_k().cast("string")
    raw = F.get(F.array(k, F.concat(k, F.lit(":07")), F.concat(F.lit("1:"), k, F.lit(":30")), F.concat(k, F.lit(":x")), F.lit("1:2:3:4")),
                (F.col("event_id") % 5).cast("int"))
    return S.given(spark, sf, "events").select("event_id", D.duration_seconds(raw).alias("secs"), T.format_timestamp(D.duration_seconds(raw)).alias("stamp"))


def answer_parts(spark, sf):
    """Turns as stored answers: cited labels, suggestions, refusal test, bare JSON."""
    text = F.concat("text", F.lit("【S"), (F.col("turn") + 1).cast("string"), F.lit("】【S2】{\"a\":"), F.col("turn").cast("string"), F.lit("}"),
                    F.when(F.col("turn") % 2 == 0, F.concat(F.lit("\n 追問建議 : a | "), F.col("role"), F.lit("||c|d \n"))).otherwise("\n追問建議: x\nend"))
    rows = S.given(spark, sf, "conversations").select("conv_id", "turn", text.alias("answer")).withColumn("s", T.split_suggestions("answer"))
    return rows.select("conv_id", "turn", F.array_join(T.citation_labels("answer").cast("array<string>"), ",").alias("labels"),
                       F.array_join("s.suggestions", "/").alias("suggestions"), F.md5("s.body").alias("body"), T.json_in_prose("answer").alias("json"))


QUERIES = {f.__name__: f for f in (
    canonical_urls, classify_pages, expand_redirects, content_ids, line_routing, route_ingest, text_gate, text_sources, average_hash,
    near_dedup, wall_reason, repeat_limit, filter_counts, duration_gate, speech_coverage, error_class, transport_message, token_estimate,
    sentence_split, vocab_prefix, chunk, chunk_turns, chunk_events, chunk_stats, chunk_overlap, chunk_overlap_turns, chunk_ledger, note_validation, collection_names, episode_coercion, page_articles,
    rendered_pages, rss_episodes, rss_errors, episodes_in_library, caption_pick, caption_segments, timeline_merge, description_lines,
    export_md, date_parsing, duration_parsing, answer_parts)}

_HOST = "lower(regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^.*@', ''), ':\\d*$', ''))"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_MARKED = """
raw AS (SELECT user_id AS media_id, event_id AS seq, event_type AS t, value - floor(value) AS ns, -CAST(json_extract(props, '$.k') AS BIGINT) / 50.0 AS lp FROM events),
r1 AS (SELECT *, CASE WHEN ns > 0.6 AND lp < -1.0 THEN 'no_speech' END AS why FROM raw),
r2 AS (SELECT *, lag(t) OVER w AS p1, lag(t, 2) OVER w AS p2 FROM r1 WHERE why IS NULL WINDOW w AS (PARTITION BY media_id ORDER BY seq)),
marked AS (SELECT media_id, seq, why AS reason FROM r1 WHERE why IS NOT NULL
  UNION ALL SELECT media_id, seq, CASE WHEN t = p1 AND t = p2 THEN 'repeated' END FROM r2)"""
_TOK = "(n - length(regexp_replace(t, '[一-鿿㐀-䶿぀-ヿ가-힣]', '', 'g')))"
_WALL = """CASE WHEN n = 0 THEN '無法從此網頁擷取正文內容'
 WHEN n < {m} THEN '正文僅 ' || n || ' 字,疑似登入牆或需 JavaScript 動態載入的頁面'
 WHEN n >= 500 THEN NULL
 WHEN regexp_extract(lower(t), '\\b(sign in|log in|create an account|enable javascript|javascript is disabled|loading)\\b', 1) <> ''
 THEN '正文過短(' || n || ' 字)且含樣板字串「' || regexp_extract(lower(t), '\\b(sign in|log in|create an account|enable javascript|javascript is disabled|loading)\\b', 1) || '」,疑似登入牆' END"""
_SIG = """
sg AS (SELECT vec_id, label, CAST(list_sum(list_transform(range(64), lambda i: CASE WHEN e[i + 1] >= m THEN CAST(1 AS HUGEINT) << i ELSE CAST(0 AS HUGEINT) END)) AS UBIGINT) AS sig
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS m FROM embeddings))"""
_PIECES_DOC = f"""
seg AS (SELECT doc_id AS source_id, 0 AS seq, {sql.TRIMMED} AS t, 0.0 AS st, 0.0 AS en FROM documents)"""
_PIECES_TURN = """
seg AS (SELECT conv_id AS source_id, turn AS seq, text AS t, turn * 10.0 AS st, turn * 10.0 + 10.0 AS en FROM conversations)"""

_PIECES_EVENT = """
seg AS (SELECT 1 AS source_id, event_id AS seq, CASE WHEN CAST(json_extract(props, '$.k') AS INT) % 5 = 0 THEN '  ' ELSE event_type || ' ' || props END AS t,
  event_id * 1.0::DOUBLE AS st, event_id + 1.0::DOUBLE AS en FROM events WHERE value >= 3)"""


def chunk_sql(segments: str) -> str:
    """Packing by enumerating every (start, first new piece) state and walking from (0, 0)."""
    return f"""WITH RECURSIVE {segments},
cut AS (SELECT *, length(t) AS n,
  list_filter(string_split(regexp_replace(t, '([。!?;.])\\s*', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '\\S')) AS ss FROM seg),
big AS (SELECT *, {_TOK} AS cj FROM cut),
pre AS (SELECT source_id, seq, st, en, t, CASE WHEN cj + (n - cj) // 4 <= 500 THEN [t] WHEN len(ss) > 1 THEN ss
   ELSE list_transform(range(0, CAST(ceil(n / 500.0) AS BIGINT)), lambda i: substr(t, i * 500 + 1, 500)) END AS ps,
   cj + (n - cj) // 4 > 500 AS split FROM big WHERE regexp_matches(t, '\\S')),
un AS (SELECT source_id, seq, st, en, split, unnest(ps) AS x, unnest(range(len(ps))) AS i FROM pre),
sp AS (SELECT *, sum(length(x)) OVER (PARTITION BY source_id, seq ORDER BY i) AS upto, sum(length(x)) OVER (PARTITION BY source_id, seq) AS tot FROM un),
pc AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY seq, i) - 1 AS p,
   CASE WHEN split THEN regexp_replace(x, '^\\s+|\\s+$', '', 'g') ELSE x END AS t,
   CASE WHEN split THEN st + (en - st) * ((upto - length(x)) / tot) ELSE st END AS st,
   CASE WHEN split THEN st + (en - st) * (upto / tot) ELSE en END AS en FROM sp),
pn AS (SELECT *, length(t) AS n FROM pc),
pp AS (SELECT *, {_TOK} AS cj FROM pn),
cum AS (SELECT source_id, p, t, st, en, sum(cj) OVER w AS c, sum(n - cj) OVER w AS o, cj, n - cj AS ot FROM pp WINDOW w AS (PARTITION BY source_id ORDER BY p)),
span AS MATERIALIZED (SELECT a.source_id, a.p AS s, b.p + 1 AS e, b.c - a.c + a.cj + (b.o - a.o + a.ot + b.p - a.p) // 4 AS tok
  FROM cum a JOIN cum b ON a.source_id = b.source_id AND b.p BETWEEN a.p AND a.p + 400),
reach AS MATERIALIZED (SELECT source_id, s, max(e) AS e FROM span WHERE tok <= 500 GROUP BY 1, 2),
lastp AS (SELECT source_id, max(p) + 1 AS n FROM cum GROUP BY 1),
nxt AS MATERIALIZED (SELECT r.source_id, r.s, r.j, r.e, coalesce(min(q.s), CASE WHEN l.tok < 300 THEN r.e - 1 ELSE r.e END) AS tail
    FROM (SELECT d.source_id, d.s, d.j, greatest(coalesce(h.e, 0), d.j + 1) AS e
          FROM (SELECT a.source_id, a.p AS s, b.p AS j FROM cum a JOIN cum b ON a.source_id = b.source_id AND b.p BETWEEN a.p AND a.p + 60) d
          LEFT JOIN reach h ON h.source_id = d.source_id AND h.s = d.s) r
    JOIN span f ON f.source_id = r.source_id AND f.s = r.s AND f.e = r.e
    JOIN span l ON l.source_id = r.source_id AND l.s = r.e - 1 AND l.e = r.e
    LEFT JOIN span q ON q.source_id = r.source_id AND q.e = r.e AND q.s >= r.s AND q.tok <= CAST(floor(f.tok * 0.15::DOUBLE) AS BIGINT)
    GROUP BY r.source_id, r.s, r.j, r.e, l.tok),
walk AS (
  SELECT source_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS j FROM lastp
  UNION ALL
  SELECT w.source_id, w.k + 1, CAST(x.tail AS BIGINT), CAST(x.e AS BIGINT) FROM walk w JOIN nxt x ON x.source_id = w.source_id AND x.s = w.s AND x.j = w.j),
closed AS (SELECT w.source_id, w.k, w.s, greatest(coalesce(r.e, 0), w.j + 1) AS e FROM walk w JOIN lastp z USING (source_id)
  LEFT JOIN reach r ON r.source_id = w.source_id AND r.s = w.s WHERE w.j < z.n),
out AS (SELECT h.source_id, h.k AS chunk_seq, h.e - h.s AS n_segments, string_agg(c.t, ' ' ORDER BY c.p) AS text,
  min_by(c.st, c.p) AS start_sec, max_by(c.en, c.p) AS end_sec FROM closed h JOIN cum c ON c.source_id = h.source_id AND c.p >= h.s AND c.p < h.e GROUP BY 1, 2, 3),
fin AS (SELECT source_id, chunk_seq, n_segments, text AS t, length(text) AS n, start_sec, end_sec FROM out),
packed AS (SELECT source_id, chunk_seq, CAST({_TOK} + (n - {_TOK}) // 4 AS BIGINT) AS n_tokens, CAST(n_segments AS BIGINT) AS n_segments, md5(t) AS digest,
  round(CAST(start_sec AS DOUBLE), 3) AS start_sec, round(CAST(end_sec AS DOUBLE), 3) AS end_sec, t FROM fin)"""


# Longest end of each chunk's predecessor that is its own beginning.
_OVERLAPS = """ov AS (SELECT source_id, chunk_seq, coalesce(list_max(list_filter(range(1, least(length(prev), length(t)) + 1), lambda k: starts_with(t, right(prev, k)))), 0) AS overlap
 FROM (SELECT *, lag(t) OVER (PARTITION BY source_id ORDER BY chunk_seq) AS prev FROM packed) WHERE prev IS NOT NULL)"""

# Hybrid retrieval over packed chunks: packing, both arms and fusion in one statement.
RETRIEVE_CHUNKS = chunk_sql(_PIECES_DOC) + "," + ",".join([
    sql.SOURCES,
    "pk AS MATERIALIZED (SELECT p.source_id * 1048576 + p.chunk_seq AS chunk_id, p.source_id, p.t, s.title FROM packed p JOIN src s USING (source_id))",
    sql.bm25("SELECT chunk_id, t, greatest(length(t) - 2, 0) AS n_grams FROM pk"), sql.ranked(k=12),
    sql.encoded("eq", "SELECT item_id AS query_id, text AS t FROM benchmark", "query_id"),
    sql.encoded("ed", "SELECT chunk_id, title || chr(10) || t AS t FROM pk", "chunk_id"),
    sql.nearest("eq", "ed", 12, 1.25), sql.fused(),
]) + """
SELECT query_id, rn AS rank, chunk_id, source_id, vec_rank, vec_distance, fts_rank, round(score, 6) AS score, CASE WHEN title = '' THEN '(未命名)' ELSE title END AS title
FROM (SELECT f.*, k.source_id, k.title, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn FROM fused f JOIN pk k USING (chunk_id)) WHERE rn <= 6"""

_FEED = """
fd AS (SELECT doc_id AS feed_id, doc_id AS doc, text, unnest(range(length(text) % 40)) AS i FROM documents),
ep AS (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY i) AS position,
  CASE WHEN i % 3 = 0 THEN 'https://a.example/' || feed_id || '/' || i || '.mp3' ELSE md5(text) || '-' || doc || '-' || i END AS guid FROM fd WHERE i % 5 <> 4)"""

ORACLES = {
    "canonical_urls": """WITH d AS (SELECT doc_id, md5(text) AS h, doc_id % 10 AS f FROM documents)
SELECT doc_id, CASE WHEN f IN (0, 1, 2, 6, 8) THEN 'youtube' WHEN f IN (4, 9) THEN 'tiktok' WHEN f = 5 THEN 'instagram' END AS platform,
 CASE WHEN f IN (0, 1, 2, 8) THEN left(h, 11) WHEN f = 4 THEN CAST(doc_id AS VARCHAR) WHEN f = 5 THEN left(h, 9) END AS video_id,
 CASE WHEN f IN (0, 1, 2, 8) THEN 'https://www.youtube.com/watch?v=' || left(h, 11)
      WHEN f = 4 THEN 'https://www.tiktok.com/@u' || doc_id || '/video/' || doc_id
      WHEN f = 5 THEN 'https://www.instagram.com/reel/' || left(h, 9) || '/' END AS canonical_url,
 CASE f WHEN 3 THEN '網域不在支援平台白名單內:youtube.com.evil.com' WHEN 6 THEN '無法從 YouTube 連結取出影片 ID:https://youtu.be/' || left(h, 8)
   WHEN 7 THEN '僅接受 http(s) 連結:ftp://youtube.com/' || doc_id
   WHEN 9 THEN '無法從 TikTok 連結取出影片 ID(短連結需先展開):https://vm.tiktok.com/' || left(h, 7) END AS reason FROM d""",
    "classify_pages": f"""SELECT page_id, 'web' AS platform, rtrim({_HOST} || {_PATH}, '/') AS content_id, url AS canonical_url,
 rtrim(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/') AS url_id FROM pages""",
    "expand_redirects": """WITH RECURSIVE w AS (
 SELECT page_id, page_id AS cur, 0 AS hops, CAST(NULL AS VARCHAR) AS off FROM pages
 UNION ALL SELECT w.page_id, w.cur + 1, w.hops + 1, CASE WHEN w.cur % 5 = 4 THEN p.url END FROM w JOIN pages p ON p.page_id = w.cur
 WHERE w.off IS NULL AND w.hops < 4 AND w.cur % 10 NOT IN (6, 9)),
m AS (SELECT page_id, max(hops) AS h FROM w GROUP BY 1),
e AS (SELECT w.* FROM w JOIN m ON w.page_id = m.page_id AND w.hops = least(m.h, 3)), o AS (SELECT page_id, min(hops) AS oh FROM w WHERE off IS NOT NULL GROUP BY 1)
SELECT e.page_id, coalesce(e.off, 'https://youtu.be/r' || e.cur) AS final_url,
 CASE WHEN oh <= 3 THEN 'off_whitelist' WHEN m.h > 3 THEN 'too_many_hops' ELSE 'ok' END AS expand_status
FROM e JOIN m USING (page_id) LEFT JOIN o USING (page_id)""",
    "content_ids": f"""SELECT doc_id, 'txt_' || left(sha256({sql.TRIMMED}), 16) AS content_id, 'ep_' || left(sha256(text), 16) AS episode_id FROM documents""",
    "line_routing": """SELECT page_id, url AS paste, 1::BIGINT AS bare, 1::BIGINT AS batch FROM pages UNION ALL
SELECT page_id, '  ' || url || chr(10) || chr(10) || ' ' || url, 0, 1 FROM pages UNION ALL
SELECT page_id, url || chr(10) || 'note', 0, 0 FROM pages UNION ALL SELECT page_id, ' ' || chr(10) || ' ', 0, 0 FROM pages""",
    "route_ingest": f"""WITH p AS (SELECT page_id, rtrim({_HOST} || {_PATH}, '/') AS content_id FROM pages),
lib AS (SELECT p.content_id, min(page_id) FILTER (WHERE quality = 1) AS live_id, min(page_id) AS any_id FROM p JOIN labels l ON l.doc_id = p.page_id GROUP BY 1)
SELECT page_id, p.content_id, CASE WHEN live_id IS NOT NULL THEN 'duplicate' WHEN page_id <> min(page_id) OVER (PARTITION BY p.content_id) THEN 'duplicate'
 WHEN any_id IS NOT NULL THEN 'reingest' ELSE 'queued' END AS routing, coalesce(live_id, any_id) AS known_source_id
FROM p LEFT JOIN lib USING (content_id)""",
    "text_gate": f"""SELECT doc_id, 'txt_' || left(sha256({sql.TRIMMED}), 16) AS content_id, 0::BIGINT AS is_url,
 CASE WHEN length({sql.TRIMMED}) = 0 THEN 'blank' WHEN length({sql.TRIMMED}) > 100000 THEN 'too_long' END AS reject_reason FROM documents""",
    "text_sources": f"""WITH {sql.SOURCES} SELECT source_id AS doc_id, platform, type, video_id, title, 'manual:' || video_id AS url_normalized,
 '2024-01-31T00:00:00Z' AS published FROM src""",
    "average_hash": f"""WITH {_SIG} SELECT vec_id, CAST(CASE WHEN sig >= 9223372036854775808 THEN CAST(sig AS HUGEINT) - 18446744073709551616 ELSE CAST(sig AS HUGEINT) END AS BIGINT) AS sig FROM sg""",
    "near_dedup": f"""WITH RECURSIVE {_SIG}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM sg),
g AS (SELECT label, CAST(0 AS BIGINT) AS r, CAST([] AS UBIGINT[]) AS sigs, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT label FROM o)
 UNION ALL SELECT g.label, o.r, CASE WHEN k THEN list_append(sigs, o.sig) ELSE sigs END, CASE WHEN k THEN list_append(kept, o.vec_id) ELSE kept END
 FROM g JOIN o ON o.label = g.label AND o.r = g.r + 1, LATERAL (SELECT len(g.kept) < 12 AND len(list_filter(g.sigs, lambda x: bit_count(xor(x, o.sig)) <= 24)) = 0 AS k))
SELECT unnest(kept) AS vec_id, CAST(label AS BIGINT) AS label FROM g QUALIFY row_number() OVER (PARTITION BY label ORDER BY r DESC) = 1""",
    "wall_reason": f"WITH d AS (SELECT doc_id, text AS t, length(regexp_replace(text, '\\s+', '', 'g')) AS n FROM documents) SELECT doc_id, {_WALL.format(m=200)} AS reason FROM d",
    "repeat_limit": f"WITH {_MARKED} SELECT * FROM marked",
    "filter_counts": f"WITH {_MARKED} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM marked GROUP BY 1",
    "duration_gate": """WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CAST((CASE WHEN k > 20 THEN k * 150 > 10800 ELSE false END) OR (CASE WHEN event_type <> 'view' THEN value * 300 > 10800 ELSE false END) AS BIGINT) AS rejected FROM e""",
    "speech_coverage": f"""WITH {_MARKED}, m AS (SELECT media_id, CASE WHEN media_id % 7 <> 3 THEN count(*) * 5.0 * (media_id % 5) END AS d FROM raw GROUP BY 1),
k AS (SELECT media_id, count(*) AS ns, count(*) * 5.0 AS spoken FROM marked WHERE reason IS NULL GROUP BY 1),
c AS (SELECT m.media_id, d, coalesce(ns, 0) AS ns, CASE WHEN d IS NULL OR d <= 0 THEN (CASE WHEN coalesce(ns, 0) > 0 THEN 1.0 ELSE 0.0 END) ELSE least(1.0, coalesce(spoken, 0) / d) END AS cov
 FROM m LEFT JOIN k USING (media_id))
SELECT media_id, ns AS n_segments, round(CAST(cov AS DOUBLE), 6) AS coverage, CAST(CASE WHEN media_id % 10 = 0 THEN false WHEN d IS NULL THEN ns = 0 ELSE cov < 0.3 END AS BIGINT) AS hollow FROM c""",
    "error_class": f"""WITH {sql.JOBS}, c AS (SELECT job_id, error, {sql.CATEGORY} AS category FROM jobs WHERE error IS NOT NULL)
SELECT job_id, error, category, CAST(category IN ('login_wall', 'content_gone') AS BIGINT) AS permanent,
 CASE category WHEN 'login_wall' THEN 'paste' WHEN 'ig_cookie_expired' THEN 'cookie' WHEN 'llm_billing' THEN 'billing' WHEN 'content_gone' THEN 'remove'
 WHEN 'too_long' THEN 'none' WHEN 'extractor_broken' THEN 'update_ytdlp' ELSE 'retry' END AS action_kind FROM c""",
    "transport_message": """SELECT CASE event_type WHEN 'error' THEN '連不到 NAS(位址/port 錯誤,或 NAS 未開機/未開 SFTP)' WHEN 'view' THEN 'NAS 認證失敗(帳號或密碼錯誤)'
 WHEN 'click' THEN 'NAS 上找不到指定資料夾' ELSE '異地備份失敗,請確認 NAS 設定(詳見伺服器 log)' END AS message, count(*) AS n FROM events GROUP BY 1""",
    "token_estimate": f"""WITH d AS (SELECT doc_id, text AS t, length(text) AS n FROM documents)
SELECT doc_id, CAST({_TOK} + (n - {_TOK}) // 4 AS BIGINT) AS chunk_tokens,
 CAST(ceil(1.5::DOUBLE * (n - length(regexp_replace(t, '[一-鿿㐀-䶿]', '', 'g'))) + length(regexp_replace(t, '[一-鿿㐀-䶿]', '', 'g')) / 3.0::DOUBLE) AS BIGINT) AS prompt_tokens FROM d""",
    "sentence_split": f"""WITH {_PIECES_DOC}, d AS (SELECT source_id, t, length(t) AS n FROM seg), f AS (SELECT * FROM d WHERE {_TOK} + (n - {_TOK}) // 4 > 500),
s AS (SELECT source_id, list_filter(string_split(regexp_replace(t, '([。!?;.])\\s*', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '\\S')) AS ss FROM f)
SELECT source_id AS doc_id, unnest(range(len(ss))) AS piece, unnest(ss) AS sentence FROM s""",
    "vocab_prefix": f"""WITH l AS (SELECT conv_id AS vocab_id, turn, {sql.TRIMMED} AS line FROM conversations WHERE regexp_matches(text, '\\S') AND NOT starts_with(text, '#')),
x AS (SELECT *, length(line) AS n, length(line) - length(regexp_replace(line, '[一-鿿㐀-䶿]', '', 'g')) AS cj FROM l),
r AS (SELECT *, sum(cj) OVER w AS c, sum(n) OVER w + 2 * (count(*) OVER w - 1) AS full_len FROM x WINDOW w AS (PARTITION BY vocab_id ORDER BY turn)),
f AS (SELECT *, ceil(c * 1.5::DOUBLE + (full_len - c) / 3.0::DOUBLE) <= 224 AS ok FROM r)
SELECT vocab_id, coalesce(string_agg(line, ', ' ORDER BY turn) FILTER (WHERE ok), '') AS prompt, count(*) FILTER (WHERE ok) AS kept, count(*) AS total FROM f GROUP BY 1""",
    "chunk": chunk_sql(_PIECES_DOC) + " SELECT * EXCLUDE (t) FROM packed",
    "chunk_turns": chunk_sql(_PIECES_TURN) + " SELECT * EXCLUDE (t) FROM packed",
    "chunk_events": chunk_sql(_PIECES_EVENT) + " SELECT * EXCLUDE (t) FROM packed",
    "chunk_stats": chunk_sql(_PIECES_DOC) + f""", {_OVERLAPS} SELECT count(*) AS n_chunks, count(DISTINCT source_id) AS n_sources, max(n_tokens) AS max_tokens, min(n_tokens) AS min_tokens,
 count(*) FILTER (WHERE n_tokens > 500) AS over_limit, count(*) FILTER (WHERE start_sec > end_sec) AS bad_times, count(*) FILTER (WHERE trim(t) = '') AS blank_chunks,
 (SELECT count(*) FROM cum) AS n_pieces,
 (SELECT count(*) FROM cum c WHERE NOT EXISTS (SELECT 1 FROM packed p WHERE p.source_id = c.source_id AND contains(p.t, c.t))) AS lost,
 0::BIGINT AS disordered, count(*) - count(DISTINCT (source_id, chunk_seq)) AS repeated, (SELECT count(*) FROM ov WHERE overlap > 0) AS overlapping,
 (SELECT CAST(sum(overlap) AS BIGINT) FROM ov) AS overlap_chars, 0::BIGINT AS late_starts FROM packed""",
    "chunk_overlap": chunk_sql(_PIECES_DOC) + f""", {_OVERLAPS} SELECT source_id, chunk_seq, overlap FROM ov""",
    "chunk_overlap_turns": chunk_sql(_PIECES_TURN) + f""", {_OVERLAPS} SELECT source_id, chunk_seq, overlap FROM ov""",
    "note_validation": f"""WITH {sql.NOTES}, n AS (SELECT note_id, trim(substr(title, 1, 100)) AS ti, left({sql.TRIMMED.replace('text', 'content')}, 2000) AS co, application,
 EXISTS (SELECT 1 FROM labels l WHERE l.doc_id IN (note_id, note_id + 1)) AS known FROM notes)
SELECT note_id, CASE WHEN ti = '' OR co = '' THEN 'title_or_content' WHEN application = '' THEN 'application' WHEN NOT known THEN 'unknown_sources' END AS reject_reason,
 length(ti) AS title_len, length(co) AS content_len FROM n""",
    "collection_names": f"""WITH n AS (SELECT conv_id, turn, trim(regexp_replace(CASE WHEN turn % 3 = 0 THEN 'src' || turn ELSE substr(trim(split_part({sql.TRIMMED}, chr(10), 1)), 1, 40) END, '\\s+', ' ', 'g')) AS name FROM conversations)
SELECT conv_id, turn, name, CASE WHEN name = '' THEN 'empty' WHEN length(name) > 30 THEN 'too_long'
 WHEN name IN (SELECT source FROM documents) THEN 'taken' END AS reject_reason FROM n""",
    "episode_coercion": """SELECT conv_id, turn, CASE WHEN text = '' THEN 5 ELSE least(length(text), 200) END AS title_len, CASE WHEN turn % 2 = 0 THEN turn END AS duration_secs, CAST(NULL AS VARCHAR) AS link,
 CASE WHEN count(*) OVER (PARTITION BY conv_id) > 10 THEN 'batch_too_large' WHEN length(text) <= 60 THEN 'guid' END AS reject_reason FROM conversations""",
    "page_articles": f"""WITH a AS (SELECT page_id, url, html, regexp_replace(html, '(?is)<!--.*?-->', '', 'g') AS b FROM pages),
c AS (SELECT page_id, url, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '(?is)<script\\b[^>]*>.*?</script>', '', 'g'),
 '(?is)<style\\b[^>]*>.*?</style>', '', 'g'), '(?is)<nav\\b[^>]*>.*?</nav>', '', 'g'), '(?is)<footer\\b[^>]*>.*?</footer>', '', 'g') AS b FROM a),
e AS (SELECT page_id, url, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '(?is)<div class="(ad|comments?)"[^>]*>.*?</div>', '', 'g'), '(?is)<title\\b[^>]*>.*?</title>', '', 'g'),
 '(?i)</(p|h[1-6]|li|div|article|section|tr)>|<br\\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g') AS b FROM c),
u AS (SELECT page_id, url, regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1) AS ti, b FROM e),
v AS (SELECT page_id, url, list_reduce([ti, '&lt;', '&gt;', '&quot;'], lambda x, y: replace(x, y, CASE y WHEN '&lt;' THEN '<' WHEN '&gt;' THEN '>' ELSE '"' END)) AS ti,
 replace(replace(replace(replace(replace(replace(replace(b, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·') AS b FROM u),
f AS (SELECT page_id, url, trim(regexp_replace(replace(replace(ti, '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS title,
 regexp_replace(regexp_replace(regexp_replace(replace(b, '&amp;', '&'), '[ \t]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM v),
g AS (SELECT *, length(regexp_replace(t, '\\s+', '', 'g')) AS n FROM f)
SELECT page_id, rtrim(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/') AS video_id, title, md5(t) AS digest, length(t) AS n_chars, {_WALL.format(m=200)} AS reject_reason FROM g""",
    "rendered_pages": f"""WITH d AS (SELECT doc_id, regexp_replace(CASE WHEN doc_id % 3 <> 0 THEN text ELSE 'Title: prose' || chr(10) || text END, '^\\s+|\\s+$', '', 'g') AS t FROM documents),
g AS (SELECT *, length(regexp_replace(t, '\\s+', '', 'g')) AS n FROM d)
SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'page ' || doc_id ELSE 'x.example' END AS title,
 CASE WHEN doc_id % 3 <> 0 THEN '2024-02-0' || (doc_id % 9 + 1) || 'T10:20:30Z' END AS published, md5(t) AS digest, {_WALL.format(m=60)} AS reject_reason FROM g""",
    "rss_episodes": f"""WITH {_FEED} SELECT feed_id, CASE WHEN feed_id % 4 = 0 THEN 'https://f.example/' || feed_id ELSE 'feed ' || feed_id END AS feed_title, position, guid,
 md5(CASE WHEN i = 0 THEN {sql.TRIMMED} ELSE 'ep ' || i END) AS title_digest, 'https://a.example/' || feed_id || '/' || i || '.mp3' AS audio_url, '2002-10-0' || (i % 9 + 1) || 'T11:00:00Z' AS published,
 3600 + (i % 10) * 60 + 7 AS duration_secs, 'ep_' || left(sha256(guid), 16) AS episode_id FROM ep WHERE position <= 20""",
    "rss_errors": """SELECT doc_id AS feed_id, 'RSS 裡沒有任何帶音訊的集數' AS reason FROM documents WHERE length(text) % 40 = 0""",
    "episodes_in_library": f"""WITH {_FEED} SELECT feed_id, count(*) AS episodes, count(*) FILTER (WHERE position % 3 = 0 AND feed_id % 2 = 0) AS stored FROM ep WHERE position <= 20 GROUP BY 1""",
    "caption_pick": """WITH t AS (SELECT event_id // 6 AS video_id, event_id AS pos, ['zh-CN', 'en', 'fr', 'zh-TW', 'de', 'zh'][CAST(json_extract(props, '$.k') AS INT) % 6 + 1] AS lang, event_type FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY CASE lang WHEN 'zh-TW' THEN 1 WHEN 'zh' THEN 4 WHEN 'zh-CN' THEN 6 WHEN 'en' THEN 7 ELSE 8 END, pos) AS rn FROM t WHERE event_type NOT IN ('view', 'click'))
SELECT video_id, pos, lang FROM r WHERE rn = 1""",
    "caption_segments": f"""SELECT conv_id, turn, turn * 2.5::DOUBLE AS start_sec, turn * 2.5::DOUBLE + 2.0::DOUBLE AS end_sec, md5({sql.TRIMMED}) AS digest
FROM conversations WHERE turn % 4 <> 1 AND regexp_matches(text, '\\S')""",
    "timeline_merge": """WITH n AS (SELECT user_id, count(*) * 60.0::DOUBLE AS d FROM events GROUP BY 1)
SELECT user_id AS media_id, event_id AS seq, round(event_id % 100 + (event_id % 4) * d / 4, 3) AS start_sec, round(event_id % 100 + 1.5::DOUBLE + (event_id % 4) * d / 4, 3) AS end_sec FROM events JOIN n USING (user_id)""",
    "description_lines": """WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')) AS ls FROM documents),
u AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS x FROM l)
SELECT doc_id, pos, least(pos, doc_id % 5) * 2.0::DOUBLE AS start_sec, md5(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS digest FROM u""",
    "export_md": f"""WITH {sql.SOURCES}
SELECT source_id, 0::BIGINT AS part, CAST(NULL AS BIGINT) AS chunk_id, md5('## ' || CASE WHEN title = '' THEN video_id ELSE title END || chr(10) || '- 平台:manual' || chr(10) || '- 連結:manual:' || video_id || chr(10) || '- 發布日期:' || strftime(ingested_at, '%Y-%m-%d') || chr(10)
 || CASE WHEN coalesce(summary, '') <> '' THEN chr(10) || '### 摘要' || chr(10) || summary || chr(10) ELSE '' END || chr(10) || '### 逐字稿') AS digest FROM src
UNION ALL SELECT source_id, 1, source_id, md5('**[0:00](manual:' || video_id || ')**' || chr(10) || text || chr(10)) FROM src
UNION ALL SELECT source_id, 2, NULL, md5('---') FROM src""",
    "date_parsing": """SELECT event_id, strftime(CASE event_id % 8 WHEN 0 THEN date_trunc('day', ts) WHEN 2 THEN date_trunc('day', ts) WHEN 4 THEN date_trunc('day', ts)
 WHEN 3 THEN date_trunc('second', ts) + INTERVAL 5 HOUR WHEN 7 THEN NULL ELSE date_trunc('second', ts) END, '%Y-%m-%dT%H:%M:%SZ') AS parsed FROM events""",
    "duration_parsing": """WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
s AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN k WHEN 1 THEN k * 60 + 7 WHEN 2 THEN 3600 + k * 60 + 30 END AS secs FROM e)
SELECT event_id, secs, CASE WHEN secs IS NULL THEN '--:--' WHEN secs >= 3600 THEN printf('%d:%02d:%02d', secs // 3600, secs % 3600 // 60, secs % 60) ELSE printf('%d:%02d', secs // 60, secs % 60) END AS stamp FROM s""",
    "answer_parts": """SELECT conv_id, turn, CASE WHEN turn + 1 = 2 THEN '2' WHEN turn + 1 < 2 THEN '1,2' ELSE '2,' || (turn + 1) END AS labels,
 CASE WHEN turn % 2 = 0 THEN 'a/' || role || '/c' ELSE '' END AS suggestions,
 md5(text || '【S' || (turn + 1) || '】【S2】{"a":' || turn || '}' || CASE WHEN turn % 2 = 0 THEN '' ELSE chr(10) || '追問建議: x' || chr(10) || 'end' END) AS body,
 regexp_extract(text || '{"a":' || turn || '}', '(?s)\\{.*\\}') AS json FROM conversations""",
}
