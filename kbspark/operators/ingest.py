"""Ingest of mixed batches: links, pasted texts and rejects in, table rows out.

One batch fans into branches. A paste whose lines are all links becomes one item a link; any
other paste is a text. Links get the identity of a video or a web page, texts a content id, and
an item that fails a gate carries its reason. Routing against the stored library then gives
every item exactly one outcome, which is data like any other: a rejected item is a failed
source and a failed job, and no branch can stop the batch.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.operators import identity as I
from kbspark.operators.chunking import chunk, chunk_id, modality_of
from kbspark.operators.vectors import embed_chunks
from kbspark.session import stored
from kbspark.sources.readers import page_articles

# Reasons of the text gate as they are stored.
TEXT_REASONS = {"blank": "內容是空的", "too_long": "內容過長", "title_too_long": "標題過長"}
ITEM = ("item_id", "part", "ts", "kind", "platform", "content_id", "canonical_url", "title", "text", "reason")


def split_pastes(items: DataFrame, text: str = "text") -> DataFrame:
    """One row per link of a paste of links, one row per other item; adds part and kind."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: T.strip(x)), lambda x: x != F.lit(""))
    links = F.coalesce(T.is_url_batch(text), F.lit(False))
    parts = F.when(links, lines).otherwise(F.array(F.coalesce(F.col(text), F.lit(""))))
    return items.select(
        *[c for c in items.columns if c != text], F.when(links, "link").otherwise("text").alias("kind"),
        F.posexplode(parts).alias("part", text))


def classify_items(items: DataFrame, hops: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Rows of ``ITEM`` for every item: identity, or the reason why it has none.

    Items are (item_id, text) with optional ts and title. ``hops`` is a redirect table.
    """
    for name, kind in (("ts", "timestamp"), ("title", "string")):
        if name not in items.columns:
            items = items.withColumn(name, F.lit(None).cast(kind))
    rows = split_pastes(items.select("item_id", "ts", "title", F.col(text).alias("text")))
    links = I.classify(rows.filter("kind = 'link'"), "text", hops)
    texts = I.route_text(rows.filter("kind = 'text'"), "text", "title")
    key, reason = F.col("content_id"), F.col("reject_reason")
    why = F.create_map(*[F.lit(x) for pair in TEXT_REASONS.items() for x in pair])
    texts = texts.withColumn("reason", F.try_element_at(why, reason)).withColumn("platform", F.lit("manual")).withColumn(
        "canonical_url", F.when(reason.isNull(), F.concat(F.lit("manual:"), key))).withColumn(
        "content_id", F.when(reason.isNull(), key))
    return links.select(*ITEM).unionByName(texts.select(*ITEM))


def source_key(item_id: str = "item_id", part: str = "part") -> Column:
    """Id of the source made from an item: its own for the first part, a hash for further ones."""
    digest = F.md5(F.concat_ws(":", F.col(item_id).cast("string"), F.col(part).cast("string")))
    far = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") + F.lit(1 << 62)
    return F.when(F.col(part) == 0, F.col(item_id)).otherwise(far)


def route_items(classified: DataFrame, library: DataFrame) -> DataFrame:
    """Classified items with routing, known_source_id and source_id.

    Library rows are (source_id, platform, video_id, status). The first item of an identity
    proceeds, later ones are duplicates of its source. Classified items are written first: they are
    read for the first of every identity and for the rows themselves.
    """
    classified = stored(classified, "classified")
    routed = I.routed_by(classified.withColumn("_at", F.struct("item_id", "part")), library, "_at")
    # a duplicate names the stored source or, if it has none, the first item of its own batch
    target = F.when(F.col("routing") == "duplicate", F.coalesce("live_id", source_key("_first.item_id", "_first.part"))).when(
        F.col("routing") == "reingest", F.col("any_id"))
    return routed.select(
        *classified.columns, "routing", target.alias("known_source_id"),
        F.when(F.col("routing") != "duplicate", source_key()).alias("source_id"))


def job_rows(routed: DataFrame) -> DataFrame:
    """(item_id, part, kind, status, source_id, error): one job per item.

    A link without a fetched page stays pending; its source is being processed.
    """
    status = (F.when(F.col("routing") == "rejected", "failed").when(F.col("routing") == "duplicate", "duplicate")
              .when((F.col("kind") == "link") & ~F.col("fetched"), "pending")
              .when(F.col("failure").isNotNull(), "failed").otherwise("done"))
    return routed.select("item_id", "part", "kind", status.alias("status"),
                         F.coalesce("source_id", "known_source_id").alias("source_id"), F.coalesce("reason", "failure").alias("error"))


def with_pages(routed: DataFrame, pages: DataFrame | None) -> DataFrame:
    """Bodies of links whose page is at hand: (url, html) rows, one per address.

    Adds fetched and failure (why the page has no usable text) and fills title and text.
    """
    go = F.col("routing").isin("queued", "reingest")
    if pages is None:
        none = F.lit(None).cast("string")
        return routed.withColumn("fetched", F.lit(False)).withColumn("failure", none).withColumn("published_at", none.cast("timestamp"))
    article = page_articles(pages.groupBy("url").agg(F.min("html").alias("html"))).select(
        F.col("url").alias("canonical_url"), F.col("title").alias("_title"), F.col("text").alias("_text"),
        F.col("reject_reason").alias("_failure"), "published_at", F.lit(True).alias("_page"))
    web = go & (F.col("kind") == "link")
    named = routed.withColumn("_go", web)
    out = named.join(article.withColumn("_go", F.lit(True)), ["canonical_url", "_go"], "left")
    link = F.col("kind") == "link"
    return out.select(
        *[c for c in routed.columns if c not in ("title", "text")],
        F.when(link, F.col("_title")).otherwise(F.col("title")).alias("title"),
        F.when(link, F.col("_text")).otherwise(F.col("text")).alias("text"),
        F.coalesce("_page", F.lit(False)).alias("fetched"), F.col("_failure").alias("failure"), "published_at")


def ingest_items(
    items: DataFrame, library: DataFrame, hops: DataFrame | None = None, pages: DataFrame | None = None, text: str = "text",
) -> Mapping[str, DataFrame]:
    """Tables a batch adds: jobs, sources, chunks and chunk_vectors; and purged source ids.

    Every item gives one job. New identities give a source: ready with its chunks and vectors,
    processing while a link waits for its page, or failed. Rejected items give a failed source
    without identity. ``purged`` are stored failed sources that are ingested anew.
    """
    rows = with_pages(route_items(classify_items(items, hops, text), library), pages)
    new = rows.filter(F.col("routing") != "duplicate")
    link = F.col("kind") == "link"
    status = (F.when(F.col("routing") == "rejected", "failed").when(link & ~F.col("fetched"), "processing")
              .when(F.col("failure").isNotNull(), "failed").otherwise("ready"))
    web = F.col("platform") == "web"
    sources = new.select(
        "source_id", F.when(~link, "text").when(web, "article").when(link, "video").alias("type"), "platform",
        F.col("content_id").alias("video_id"),
        F.when(~link & (status != "failed"), F.coalesce(F.nullif(T.strip("title"), F.lit("")), T.first_line("text", 80)))
        .otherwise(F.col("title")).alias("title"),
        F.coalesce("canonical_url", F.when(link, F.col("text"))).alias("url_normalized"), status.alias("status"),
        F.coalesce("reason", "failure").alias("error"), "published_at", F.col("ts").alias("ingested_at"))
    body = new.filter(status == "ready").select(
        "source_id", F.lit(0).cast("long").alias("seq"), T.strip("text").alias("text"), F.lit(0.0).alias("start_sec"), F.lit(0.0).alias("end_sec"))
    chunks = chunk(body, max_seq=0).join(sources.select("source_id", "type", "title"), "source_id").select(
        chunk_id("source_id", "chunk_seq").alias("chunk_id"), "source_id", modality_of("type").alias("modality"),
        "text", "start_sec", "end_sec", "title")
    return {
        "chunks": chunks.drop("title"), "chunk_vectors": embed_chunks(chunks).select("chunk_id", "embedding"),
        "jobs": job_rows(rows), "sources": sources,
        "purged": rows.filter(F.col("routing") == "reingest").select(F.col("known_source_id").alias("source_id")),
    }


def current_sources(stored: DataFrame) -> DataFrame:
    """Stored source rows without failed ones that were ingested again later.

    Batches only add rows, so a source that failed and came back is stored twice.
    """
    keys = ["platform", "video_id"]
    alive = stored.filter((F.col("status") != "failed") & F.col("video_id").isNotNull()).select(*keys).distinct()
    return stored.filter(F.col("status") != "failed").unionByName(
        stored.filter(F.col("status") == "failed").join(alive, keys, "left_anti"))


def failed_sources(tables: Mapping[str, DataFrame], dim: int) -> DataFrame:
    """(source_id, reason) of sources with a chunk that is not whole.

    A chunk is not whole when its id comes twice, when it has no vector or several, or when a
    vector has a missing value or another width than ``dim``. One reason is kept per source.
    """
    c, v = tables["chunks"], tables["chunk_vectors"]
    width = F.when(F.col("embedding").isNull(), F.lit(-1)).otherwise(F.size("embedding"))
    holes = F.coalesce(F.exists("embedding", lambda x: x.isNull()), F.lit(False))
    good = v.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if((width != dim) | holes).alias("_bad"))
    ids = c.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("_times"))
    faulty = c.select("chunk_id", "source_id").join(ids, "chunk_id").join(good, "chunk_id", "left")
    why = (F.when(F.col("_times") > 1, "chunk_id_repeated").when(F.col("_n").isNull(), "chunk_without_vector")
           .when(F.col("_n") > 1, "vector_repeated").when(F.col("_bad") > 0, "vector_dimension"))
    return faulty.select("source_id", why.alias("reason")).filter(F.col("reason").isNotNull()).groupBy("source_id").agg(
        F.min("reason").alias("reason"))


def settle(tables: Mapping[str, DataFrame], dim: int) -> dict[str, DataFrame]:
    """All or nothing for every source: a source with a fault loses its chunks and vectors and
    turns failed with the fault as its error, and all others stay as they are.

    Chunks of no source, and vectors of no chunk, are left out too. The tables should be
    stored ones: the verdict is used for each of them.
    """
    s, c, v = tables["sources"], tables["chunks"], tables["chunk_vectors"]
    bad = failed_sources(tables, dim)
    kept = s.select("source_id").distinct().join(bad, "source_id", "left_anti")
    chunks = c.join(kept, "source_id", "left_semi")
    vectors = v.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    own = F.col("error") if "error" in s.columns else F.lit(None).cast("string")
    marked = s.join(bad.withColumnRenamed("reason", "_why"), "source_id", "left")
    cols = [c for c in s.columns if c not in ("status", "error")]
    sources = marked.select(*cols, F.when(F.col("_why").isNotNull(), "failed").otherwise(F.col("status")).alias("status"),
                            F.coalesce("_why", own).alias("error"))
    return {**tables, "sources": sources, "chunks": chunks, "chunk_vectors": vectors}
