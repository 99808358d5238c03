"""Declared schemas (DDL) of the knowledge-base tables; nothing is inferred."""

from __future__ import annotations

SOURCES = (
    "source_id long, type string, platform string, video_id string, title string,"
    " display_title string, url_original string, url_normalized string, status string,"
    " summary string, published_at timestamp, ingested_at timestamp,"
    " summary_generated_at timestamp, duration_secs int, collection_id long"
)
CHUNKS = (
    "chunk_id long, source_id long, modality string, text string, start_sec double, end_sec double"
)
CHUNK_VECTORS = ("chunk_id long, embedding array<float>")
TRACE = (
    "array<struct<label:int,chunk_id:long,source_id:long,title:string,platform:string,"
    "start_sec:double,timestamp:string,vec_rank:int,vec_distance:double,fts_rank:int,"
    "rrf_score:double,cited:boolean>>"
)
MESSAGES = (
    "msg_id long, session_id string, role string, content string, cited_chunk_ids array<long>,"
    f" retrieval_trace {TRACE}, created_at timestamp"
)
JOBS = (
    "job_id long, kind string, status string, error string, payload string, retries int,"
    " max_retries int, source_id long, created_at timestamp, updated_at timestamp"
)
NOTES = (
    "note_id long, kind string, title string, content string, application string, status string,"
    " source_ids array<long>, created_at timestamp, decided_at timestamp"
)
NOTE_VECTORS = ("note_id long, embedding array<float>")
COLLECTIONS = ("collection_id long, name string, created_at timestamp")
API_USAGE = (
    "id long, ts timestamp, provider string, model string, input_tokens long, output_tokens long,"
    " cost_usd double"
)
META = ("key string, value string")
SEGMENTS = ("source_id long, seq long, text string, start_sec double, end_sec double")
RAW_SEGMENTS = (
    "media_id long, seq long, text string, start_sec double, end_sec double,"
    " no_speech_prob double, avg_logprob double"
)
EPISODES = (
    "guid string, title string, audio_url string, link string, published_at timestamp, duration_secs long"
)
GOLDEN = ("id string, category string, query string, expect array<struct<doc:string,text:string>>")
ANSWER_GOLDEN = ("id string, question string, expect_source string, kind string")
EVAL_RUN = (
    "ts timestamp, k int, model string, rrf_k int, max_vector_distance double, n_docs long,"
    " n_chunks long, n_queries long, recall double, mrr double, coverage double, negatives long,"
    " false_hits long, attribution struct<both:long,vector_only:long,fts_only:long,neither:long>,"
    " recall_by_category map<string,double>"
)
TABLES = {
    "sources": SOURCES, "chunks": CHUNKS, "chunk_vectors": CHUNK_VECTORS, "messages": MESSAGES,
    "jobs": JOBS, "notes": NOTES, "note_vectors": NOTE_VECTORS, "collections": COLLECTIONS,
    "api_usage": API_USAGE, "meta": META,
}

# The driver's generated tables that the adapters read.
GIVEN = {
    "documents": ("doc_id long, text string, lang string, source string, n_chars long"),
    "pages": ("page_id long, url string, html string"),
    "embeddings": ("vec_id long, embedding array<float>, label int"),
    "events": (
        "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    ),
    "conversations": ("conv_id long, turn long, role string, text string"),
    "benchmark": ("item_id long, text string"),
    "labels": ("doc_id long, quality int, toxic int"),
}
