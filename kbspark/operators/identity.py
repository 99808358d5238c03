"""Identity, routing and de-duplication of incoming items."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.functions import urls as U
from kbspark.operators.blocks import WIDTH
from kbspark.session import BROADCAST_ROWS, at_most, cut_lineage, salted_join

# Redirect limit, signature distance, kept frames per medium.
MAX_HOPS = 3
HASH_DISTANCE = 6
MAX_FRAMES = 12


def canonical_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """Add platform, video_id, canonical_url and reason (null when accepted)."""
    return U.with_identity(df, url).select(
        *df.columns, F.col("_platform").alias("platform"), F.col("_vid").alias("video_id"),
        U.canonical_url(url, F.col("_platform"), F.col("_vid")).alias("canonical_url"), F.col("_reason").alias("reason"))


def expand_redirects(urls: DataFrame, hops: DataFrame, url: str = "url") -> DataFrame:
    """Follow a redirect table (from_url, location) for at most three hops.

    Adds final_url and expand_status: ok, off_whitelist or too_many_hops. Every visited
    address has to be on the whitelist; relative locations resolve against the current one.
    Of several locations of one address the least counts, so no row of ``urls`` is repeated.
    """
    step = hops.groupBy(F.col("from_url").alias("_from")).agg(F.min("location").alias("_to"))
    cur = urls.withColumn("final_url", F.col(url)).withColumn("_h", U.hostname(url)).withColumn(
        "expand_status", F.when(U.platform_of(F.col("_h")).isNull(), "off_whitelist")).drop("_h")
    off = lambda c: U.platform_of(F.col(c)).isNull()
    for hop in range(MAX_HOPS + 1):
        cur = cur.join(step, F.col("final_url") == F.col("_from"), "left").withColumn(
            "_go", F.col("expand_status").isNull() & F.col("_to").isNotNull())
        if hop == MAX_HOPS:
            cur = cur.withColumn("expand_status", F.when(F.col("_go"), "too_many_hops").otherwise(F.col("expand_status")))
        else:
            origin = F.concat(U.scheme("final_url"), F.lit("://"), U.netloc("final_url"))
            folder = F.coalesce(F.nullif(F.regexp_replace(U.path("final_url"), r"[^/]*$", ""), F.lit("")), F.lit("/"))
            target = (
                F.when(F.col("_to").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("_to"))
                .when(F.col("_to").startswith("//"), F.concat(U.scheme("final_url"), F.lit(":"), F.col("_to")))
                .when(F.col("_to").startswith("/"), F.concat(origin, F.col("_to")))
                .otherwise(F.concat(origin, folder, F.col("_to")))
            )
            cur = cur.withColumn("final_url", F.when(F.col("_go"), target).otherwise(F.col("final_url"))).withColumn(
                "_h", F.when(F.col("_go"), U.hostname("final_url"))).withColumn(
                "expand_status", F.when(F.col("_go") & off("_h"), "off_whitelist").otherwise(F.col("expand_status"))).drop("_h")
        cur = cur.drop("_from", "_to", "_go")
    return cur.withColumn("expand_status", F.coalesce("expand_status", F.lit("ok")))


def classify(df: DataFrame, url: str = "url", hops: DataFrame | None = None) -> DataFrame:
    """Route an address: whitelisted hosts to a video identity, other http(s) hosts to web.

    With a redirect table, whitelisted addresses that do not parse are expanded first.
    """
    plat, vid = F.col("_platform"), F.col("_vid")
    base = U.with_identity(df, url).withColumn("_final", F.col(url))
    if hops is not None:
        need = F.coalesce(F.col("_reason").isNotNull() & plat.isNotNull(), F.lit(False))
        opened = expand_redirects(base.filter(need).select(*df.columns), hops, url)
        refused = F.when(F.col("expand_status") == "off_whitelist", F.lit("轉址落到白名單外的網域,拒絕跟隨")).when(
            F.col("expand_status") == "too_many_hops", F.concat(F.lit(f"轉址超過 {MAX_HOPS} 層上限,拒絕跟隨:"), F.col(url)))
        opened = U.with_identity(opened, "final_url").withColumn("_bad", refused).withColumn(
            "_vid", F.when(F.col("_bad").isNull(), vid)).withColumn("_reason", F.coalesce("_bad", "_reason"))
        opened = opened.withColumnRenamed("final_url", "_final")
        base = base.filter(~need).unionByName(opened.select(*base.columns))
    web = F.col("_host").isNotNull() & plat.isNull()
    return base.select(
        *df.columns,
        F.when(web, F.lit("web")).otherwise(plat).alias("platform"),
        F.when(web, U.article_key(url)).otherwise(vid).alias("content_id"),
        F.when(web, F.col(url)).otherwise(U.canonical_url("_final", plat, vid)).alias("canonical_url"),
        F.when(~web, F.col("_reason")).alias("reason"),
    )


def route_text(df: DataFrame, text: str = "text", title: str | None = None, max_chars: int = 100_000,
               max_title: int = 200) -> DataFrame:
    """Gate pasted texts: reject_reason, is_url and the content id of the trimmed body."""
    body = T.strip(text)
    title_len = F.length(T.strip(title)) if title else F.lit(0)
    return df.withColumn("content_id", T.content_id(text)).withColumn("is_url", T.is_bare_url(text)).withColumn(
        "reject_reason",
        F.when(F.length(body) == 0, "blank").when(F.length(body) > max_chars, "too_long")
        .when(title_len > max_title, "title_too_long"),
    )


def route_ingest(incoming: DataFrame, sources: DataFrame, order: str) -> DataFrame:
    """Add routing (rejected, duplicate, reingest, queued) and known_source_id.

    An identity already stored and not failed is a duplicate of it; a failed one is
    purged and ingested again. Within the batch the first row per identity proceeds and
    later ones are duplicates; the first is found by a pre-aggregated minimum, so a group
    of copies is never gathered in one task.
    """
    return routed_by(incoming, sources, order).withColumn("known_source_id", F.coalesce("live_id", "any_id")).drop("_first", "live_id", "any_id")


def routed_by(incoming: DataFrame, sources: DataFrame, order: str) -> DataFrame:
    """Incoming rows with routing and what it rests on: the first row of their identity in
    ``_first``, the stored source in live_id (not failed) and any_id.

    Rows without an identity have no part in the join: they would all meet in one task.
    """
    live = sources.groupBy("platform", F.col("video_id").alias("content_id")).agg(
        F.min(F.when(F.col("status") != "failed", F.col("source_id"))).alias("live_id"),
        F.min("source_id").alias("any_id"),
    )
    first = incoming.filter(F.col("reason").isNull()).groupBy("platform", "content_id").agg(
        F.min(order).alias("_first"))
    keys = ["platform", "content_id"]
    named = F.col("platform").isNotNull() & F.col("content_id").isNotNull()
    rows = incoming.filter(named).join(first.join(live, keys, "left"), keys, "left").unionByName(
        incoming.filter(~named), allowMissingColumns=True)
    return rows.withColumn(
        "routing",
        F.when(F.col("reason").isNotNull(), "rejected")
        .when(F.col("live_id").isNotNull(), "duplicate")
        .when(F.col(order) != F.col("_first"), "duplicate")
        .when(F.col("any_id").isNotNull(), "reingest")
        .otherwise("queued"),
    )


def in_library(episodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Flag episodes whose identity is stored and not failed."""
    known = sources.filter((F.col("platform") == "podcast") & (F.col("status") != "failed")).select(
        F.col("video_id").alias("_vid"), F.lit(True).alias("_known")).distinct()
    return (
        episodes.join(known, T.episode_id("guid") == F.col("_vid"), "left")
        .withColumn("in_library", F.coalesce("_known", F.lit(False))).drop("_vid", "_known")
    )


def average_hash(values) -> Column:
    """64-bit signature of a 64-value array: bit i is set when value i reaches the mean."""
    arr = F.col(values) if isinstance(values, str) else values
    doubles = F.transform(arr, lambda x: x.cast("double"))
    mean = F.aggregate(doubles, F.lit(0.0), lambda a, x: a + x) / F.size(doubles)
    bits = F.transform(
        F.sequence(F.lit(0), F.size(doubles) - 1),
        lambda i: F.when(F.get(doubles, i) >= mean,
                         F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")),
    )
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def _far(sig: int | None, kept: list[int], max_dist: int) -> bool:
    # the sign bit counts like any other
    return sig is None or all(((sig ^ k) & 0xFFFFFFFFFFFFFFFF).bit_count() > max_dist for k in kept)


def _pick(batches: Iterator[pa.RecordBatch], max_dist: int, cap: int) -> Iterator[pa.RecordBatch]:
    """Rows that each block would keep by itself; rows arrive sorted by (group, block, order).

    ``_kept`` are signatures kept before, ``_n`` is how many rows were.
    """
    at, kept, n = None, [], 0
    for b in batches:
        take = []
        columns = [b.column(c).to_pylist() for c in ("_group", "_blk", "_s", "_kept", "_n")]
        for i, (group, blk, sig, before, count) in enumerate(zip(*columns)):
            if (group, blk) != at:
                at, kept, n = (group, blk), list(before), count
            if n < cap and _far(sig, kept, max_dist):
                n += 1
                take.append(i)
                if sig is not None:
                    kept.append(sig)
        yield b.take(pa.array(take, pa.int64()))


def _merge(batches: Iterator[pa.RecordBatch], max_dist: int, cap: int) -> Iterator[pa.RecordBatch]:
    """Picks of a group's blocks one after the other, up to the first that an earlier block rules out.

    From there on the block would have kept other rows: the group goes on from that row.
    """
    at, kept, n, stopped = None, [], 0, False
    for b in batches:
        take, going_on = [], []
        columns = [b.column(c).to_pylist() for c in ("_group", "_s", "_kept", "_n")]
        for i, (group, sig, before, count) in enumerate(zip(*columns)):
            if group != at:
                at, kept, n, stopped = group, list(before), count, False
            if stopped or n == cap:
                continue
            stopped = not _far(sig, kept, max_dist)
            take.append(i)
            going_on.append(stopped)
            if not stopped:
                n += 1
                if sig is not None:
                    kept.append(sig)
        out = b.take(pa.array(take, pa.int64()))
        yield pa.RecordBatch.from_arrays([*(out.column(c) for c in ("_group", "_o", "_s")), pa.array(going_on, pa.bool_())], ["_group", "_o", "_s", "_on"])


def near_dedup(
    df: DataFrame, group: str, order: str, sig: str, max_dist: int = HASH_DISTANCE, cap: int = MAX_FRAMES, width: int = WIDTH,
) -> DataFrame:
    """First ``cap`` rows per group that differ from every earlier kept one.

    A row is kept when its signature is more than ``max_dist`` bits away from all kept
    signatures of its group (a null signature is always kept). A group is cut into blocks of
    ``width`` order values, each block picks the rows it would keep by itself, at most ``cap``, and the picks
    are merged in order. A group of one block is done after one pass. A pick that an earlier block
    rules out sends its group into another pass, over its later rows that differ from the kept ones;
    every pass settles at least one more block or ``cap``.
    """
    own, key = df.columns, F.struct(F.col(group).alias("g")).alias("_group")  # rows without a group are one like the others
    rows = cut_lineage(df.select(key, F.col(order).cast("long").alias("_o"), F.col(sig).cast("long").alias("_s")))
    todo = rows.withColumn("_kept", F.array().cast("array<bigint>")).withColumn("_n", F.lit(0))
    kept = None
    kind = rows.schema["_group"].dataType.simpleString()
    while True:
        blocks = todo.withColumn("_blk", F.floor(F.col("_o") / width).cast("long"))
        picked = blocks.repartition("_group", "_blk").sortWithinPartitions("_group", "_blk", "_o").mapInArrow(
            lambda x: _pick(x, max_dist, cap), blocks.schema)
        merged = cut_lineage(picked.repartition("_group").sortWithinPartitions("_group", "_o").mapInArrow(
            lambda x: _merge(x, max_dist, cap), f"_group {kind}, _o bigint, _s bigint, _on boolean"))
        new = merged.filter(~F.col("_on")).select("_group", "_o", "_s")
        kept = new if kept is None else kept.unionByName(new)
        again = merged.filter("_on").select("_group", F.col("_o").alias("_from"))
        if again.isEmpty():
            break
        # at most ``cap`` rows a group
        state = kept.join(again.select("_group"), "_group", "left_semi").groupBy("_group").agg(
            F.collect_list("_s").alias("_kept"), F.count(F.lit(1)).cast("int").alias("_n")).join(again, "_group")
        few = at_most(again, BROADCAST_ROWS)
        later = rows.join(F.broadcast(state), "_group") if few else salted_join(rows, state, ["_group"], "_o")
        todo = later.filter((F.col("_o") > F.col("_from")) & (F.col("_s").isNull() | F.forall(
            "_kept", lambda k: F.bit_count(k.bitwiseXOR(F.col("_s"))) > max_dist))).select("_group", "_o", "_s", "_kept", "_n")
    hit = kept.select(F.col("_group.g").alias("_g"), "_o")
    return df.join(hit, F.col(group).eqNullSafe(F.col("_g")) & (F.col(order) == F.col("_o")), "left_semi").select(*own)


def first_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key, the first in order, by a pre-aggregated minimum of a struct."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*")
