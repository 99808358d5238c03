"""Mixed ingest, sources that fail by themselves, rate admission, chunk ledgers, cut-offs and sizes per query."""

import os
from collections import Counter, deque

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.operators import admission as AD
from kbspark.operators import chunking as K
from kbspark.operators import evaluate as E
from kbspark.operators import fulltext as X
from kbspark.operators import identity as I
from kbspark.operators import ingest as N
from kbspark.operators import maintain as M
from kbspark.operators import retrieve as R
from kbspark.operators import rollups as A
from kbspark.operators import vectors as V
from kbspark.plans import quality, retrieval
from kbspark.sources import readers as RD
from kbspark.sources import sinks as SK
from kbspark.sources import tables as S
from kbspark.streaming import streams as ST

ROOT = os.environ.get("KBSPARK_TEST_DIR", "/root/testdata/sf0.001")
LIBRARY = "source_id long, platform string, video_id string, status string"
VIDEO = "dQw4w9WgXcQ"
PAGE = "<html><title>T</title><body><p>" + "words of a page " * 40 + "</p></body></html>"
ITEMS = [
    (1, "  a pasted text\nsecond line ", None), (2, "a pasted text\nsecond line", "other title"), (3, " \n\t", None), (4, None, None),
    (5, "x" * 100_001, None), (6, "y" * 100_000, "y" * 200), (7, "z", "z" * 201), (8, f"https://youtu.be/{VIDEO}", None),
    (9, f"https://www.youtube.com/watch?v={VIDEO}\n\nhttps://news.example/a?x=1\nhttps://news.example/a/", None),
    (10, "https://youtu.be/short", None), (11, "https://news.example/thin", None), (12, "ftp://news.example/a", None), (13, "stored text", None),
    (14, "failed text", None)]


def library(spark):
    rows = [(71, "manual", "stored text", "ready"), (72, "manual", "failed text", "failed"), (73, "web", "elsewhere", "ready")]
    return spark.createDataFrame(rows, LIBRARY).withColumn("video_id", F.when(
        F.col("platform") == "manual", F.concat(F.lit("txt_"), F.left(F.sha2("video_id", 256), F.lit(16)))).otherwise(F.col("video_id")))


def items(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string, title string").withColumn("ts", F.timestamp_seconds(F.col("item_id") + 1_700_000_000))


def test_mixed_batch(spark):
    pages = spark.createDataFrame([("https://news.example/a?x=1", PAGE), ("https://news.example/thin", "<p>thin</p>")], "url string, html string")
    out = N.ingest_items(items(spark), library(spark), pages=pages)
    jobs = {(r.item_id, r.part): r for r in out["jobs"].collect()}
    assert len(jobs) == 16
    status = {k: r.status for k, r in jobs.items()}
    assert status == {(1, 0): "done", (2, 0): "duplicate", (3, 0): "failed", (4, 0): "failed", (5, 0): "failed", (6, 0): "done", (7, 0): "failed",
                      (8, 0): "pending", (9, 0): "duplicate", (9, 1): "done", (9, 2): "duplicate", (10, 0): "failed", (11, 0): "failed",
                      (12, 0): "done", (13, 0): "duplicate", (14, 0): "done"}
    assert jobs[2, 0].source_id == 1 and jobs[9, 0].source_id == 8 and jobs[13, 0].source_id == 71
    assert jobs[9, 2].source_id == jobs[9, 1].source_id and jobs[14, 0].source_id == 14
    assert [r.source_id for r in out["purged"].collect()] == [72]
    assert all(jobs[k].error for k, s in status.items() if s == "failed") and not any(jobs[k].error for k, s in status.items() if s != "failed")
    sources = {r.source_id: r for r in out["sources"].collect()}
    assert len(sources) == 12 and Counter(r.status for r in sources.values()) == {"ready": 5, "failed": 6, "processing": 1}
    assert sources[1].title == "a pasted text" and sources[6].title == "y" * 200 and sources[jobs[9, 1].source_id].title == "T"
    assert (sources[8].type, sources[8].url_normalized) == ("video", f"https://www.youtube.com/watch?v={VIDEO}")
    with_chunks = {r.source_id for r in out["chunks"].collect()}
    assert with_chunks == {k for k, r in sources.items() if r.status == "ready"}
    assert out["chunks"].select("chunk_id").exceptAll(out["chunk_vectors"].select("chunk_id")).count() == 0


def test_mixed_stream_and_replay(spark, tmp_path):
    """Three arrivals of overlapping items: one source per identity, one job per item, none twice after a replay."""
    root = str(tmp_path / "kb")
    write = ST.ingest_batch(root)
    first, second = items(spark, ITEMS[:8]), items(spark, [(100 + i, t, n) for i, t, n in ITEMS])
    for number, batch in ((0, first), (1, second), (1, second)):
        write(batch, number)
    jobs = spark.read.parquet(f"{root}/jobs")
    assert jobs.count() == 8 + 16 and jobs.select("item_id", "part").distinct().count() == 24
    late = {r.item_id: r.status for r in jobs.filter("item_id > 100 and part = 0").collect()}
    assert (late[101], late[102], late[103], late[108], late[113]) == ("duplicate", "duplicate", "failed", "duplicate", "done")
    src = spark.read.parquet(f"{root}/sources")
    named = src.filter("video_id is not null and status <> 'failed'")
    assert named.count() == named.select("platform", "video_id").distinct().count()
    chunks, vectors = spark.read.parquet(f"{root}/chunks"), spark.read.parquet(f"{root}/chunk_vectors")
    assert chunks.count() == vectors.count() == chunks.select("chunk_id").distinct().count()
    assert {r.status for r in src.join(chunks, "source_id", "left_semi").collect()} == {"ready"}


def test_failed_sources_come_back(spark):
    stored = spark.createDataFrame([(1, "manual", "a", "failed"), (2, "manual", "a", "ready"), (3, "manual", "b", "failed"), (4, None, None, "failed")], LIBRARY)
    assert sorted(r.source_id for r in N.current_sources(stored).collect()) == [2, 3, 4]


def test_a_bad_source_fails_alone(spark, tmp_path):
    """One vector of the wrong width: its source has no rows and is failed, the version is published."""
    sources = spark.createDataFrame([(i, "web", f"v{i}", "ready") for i in range(1, 5)], LIBRARY)
    chunks = spark.createDataFrame([(i * 10 + k, i, f"t{k}") for i in range(1, 5) for k in range(3)], "chunk_id long, source_id long, text string")
    vectors = [(i * 10 + k, [0.0] * (3 if (i, k) == (2, 2) else 4)) for i in range(1, 5) for k in range(3) if (i, k) != (3, 0)]
    vectors[-1] = (vectors[-1][0], [0.0, None, 0.0, 0.0])
    tables = {"sources": sources, "chunks": chunks, "chunk_vectors": spark.createDataFrame(vectors, "chunk_id long, embedding array<float>")}
    with pytest.raises(ValueError, match="vector_dimension"):
        M.publish(tables, str(tmp_path), "a", lambda t: M.require_clean(t, 4))
    final = M.publish(tables, str(tmp_path), "b", lambda t: M.require_clean(t, 4), lambda t: N.settle(t, 4))
    read = {n: spark.read.parquet(f"{final}/{n}") for n in tables}
    assert {r.source_id: (r.status, r.error) for r in read["sources"].collect()} == {
        1: ("ready", None), 2: ("failed", "vector_dimension"), 3: ("failed", "chunk_without_vector"), 4: ("failed", "vector_dimension")}
    assert {r.source_id for r in read["chunks"].collect()} == {1} and read["chunk_vectors"].count() == 3
    assert not [p for p in (tmp_path / "_staging").iterdir() if p.name.startswith("b")]


def loop(counts, limit, span):
    held, out = deque(), {}
    for sec in sorted(counts):
        while held and held[0][0] <= sec - span:
            held.popleft()
        before = sum(n for _, n in held)
        n = min(counts[sec], max(limit - before, 0))
        if n:
            held.append((sec, n))
        out[sec] = (before, n)
    return out


@pytest.mark.parametrize(("limit", "span", "width"), [(1, 5, 7), (3, 20, 16), (30, 60, 64), (4, 10, 1000)])
def test_admission_equals_the_loop(spark, limit, span, width):
    """Idle, sparse, saturated and bursting seconds, over stretches of many blocks; a missing key is a key."""
    rng = np.random.default_rng(limit)
    counts = {}
    for key, rate in (("hot", 0.9), ("mid", 0.2), (None, 0.02), ("burst", 0.05)):
        secs = np.flatnonzero(rng.random(3000) < rate) - 500
        counts[key] = {int(s): int(rng.integers(1, 60 if key == "burst" else 3)) for s in secs if not 900 < s < 1100}
    rows = [(k, s, n) for k, c in counts.items() for s, n in c.items()]
    df = spark.createDataFrame(rows, "k string, _sec long, _n long")
    got = {(r.k, r._sec): (r._before, r._admit) for r in AD.admitted_seconds(df, ["k"], limit, span, width).collect()}
    assert got == {(k, s): v for k, c in counts.items() for s, v in loop(c, limit, span).items()}
    whole = Counter()
    for _, s, n in rows:
        whole[s] += n
    every = df.groupBy("_sec").agg(F.sum("_n").alias("_n"))
    assert {r._sec: (r._before, r._admit) for r in AD.admitted_seconds(every, [], limit, span, width).collect()} == loop(whole, limit, span)


def test_a_hot_key_is_judged_in_many_tasks(spark):
    """Two million busy seconds of one key without a gap: equal to the loop, seconds dealt out evenly."""
    n = 2_000_000
    df = spark.range(n).select(F.lit("hot").alias("k"), F.col("id").alias("_sec"), F.lit(2).cast("long").alias("_n"))
    out = AD.admitted_seconds(df, ["k"], 30, 3600)
    rows = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    sizes = sorted(r["count"] for r in rows)
    assert sum(sizes) == n and sizes[-1] <= 2 * np.median(sizes) + AD.WIDTH
    want = [s for s in range(n) if s % 3600 < 15]
    assert [r._sec for r in out.filter("_admit > 0").orderBy("_sec").collect()] == want
    assert out.agg(F.sum("_admit")).first()[0] == 2 * len(want)


def test_rate_limit_over_many_keys(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(k), int(s)) for i, (k, s) in enumerate(zip(rng.integers(0, 5, 4000), rng.integers(0, 50_000, 4000)))]
    df = spark.createDataFrame(rows, "id long, k long, s long").withColumn("created_at", F.timestamp_seconds("s")).drop("s")
    got = {r.id: (r.recent, r.refused) for r in A.rate_limited(df, "id", "k", limit=7).collect()}
    for key in range(5):
        held = []
        for i, _, s in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])):
            held = [t for t in held if t > s - 3600]
            assert got[i] == (len(held), len(held) >= 7)
            if len(held) < 7:
                held.append(s)


def transcript(n=90, missing=()):
    return [(1, i, f"part {i} " + " ".join(f"w{i}x{j}" for j in range(40)), i * 10.0, i * 10.0 + 9.0) for i in range(n) if i not in missing]


SEGMENT = "source_id long, seq long, text string, start_sec double, end_sec double"


def test_ledger_of_whole_chunks(spark):
    rows = transcript() + [(2, 0, "Sentence of a text. " * 400, 0.0, 0.0), (3, 0, "z" * 9000, 0.0, 0.0), (4, 5, "  ", 0.0, 1.0), (4, 9, "same same", 1.0, 2.0)]
    segments = spark.createDataFrame(rows, SEGMENT)
    chunks = K.chunk(segments)
    got = K.chunk_ledger(segments, chunks).collect()
    assert len(got) == chunks.count() and all((r.lost, r.disordered, r.repeated) == (0, 0, False) for r in got)
    (report,) = K.chunk_audit(segments, chunks).collect()
    assert (report.lost, report.disordered, report.repeated, report.late_starts, report.over_limit) == (0, 0, 0, 0, 0)
    texts = {(r.source_id, r.chunk_seq): r.text for r in chunks.collect()}
    for r in K.chunk_overlap(chunks).collect():
        a, b = texts[r.source_id, r.chunk_seq - 1], texts[r.source_id, r.chunk_seq]
        assert r.overlap == max(k for k in range(min(len(a), len(b)) + 1) if b.startswith(a[len(a) - k :]))
    assert K.chunk_overlap(chunks).filter("source_id = 1 and overlap = 0").count() == 0


def test_ledger_finds_what_is_missing(spark):
    every = spark.createDataFrame(transcript(), SEGMENT)
    chunks = K.chunk(spark.createDataFrame(transcript(missing=(40,)), SEGMENT)).cache()
    sums = lambda c: K.chunk_ledger(every, c).agg(F.sum("n_pieces"), F.sum("lost"), F.sum("disordered"), F.count_if("repeated")).first()
    assert tuple(sums(chunks)) == (90, 1, 0, 0)
    whole = K.chunk(every).cache()
    n = {r.chunk_seq: r.n_pieces for r in K.chunk_ledger(every, whole).collect()}
    assert tuple(sums(whole.filter("chunk_seq <> 2"))) == (90, n[2], 0, 1)
    assert tuple(sums(whole.filter("chunk_seq > 0")))[:2] == (90, n[0])
    assert K.chunk_ledger(every, whole.filter("chunk_seq > 0")).filter("chunk_seq = -1").first().lost == n[0]
    assert tuple(sums(whole.unionByName(whole.filter("chunk_seq = 1")))) == (90, 0, 0, 1)
    swapped = whole.withColumn("text", F.when(F.col("chunk_seq") == 1, F.array_join(F.reverse(F.split("text", " (?=part )")), " ")).otherwise(F.col("text")))
    row = K.chunk_ledger(every, swapped).filter("chunk_seq = 1").first()
    assert row.lost == 0 and row.disordered > 0


def test_audit_shuffles_every_text_once(spark):
    """Chunks and segments meet in one shuffle, and no chunk is written or packed a second time."""
    segments = S.document_segments(spark, ROOT)
    plan = K.chunk_audit(segments, K.chunk(segments))._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert sum("REPARTITION_BY_COL" in x for x in moved) == 1 and len(moved) <= 2 and "Join" not in plan and "Subquery" not in plan


def test_ledger_and_audit_are_the_same_in_blocks(spark):
    """Whole, missing, doubled, swapped, foreign and empty chunks of short and long sources."""
    rows = transcript() + [(s, *r[1:]) for s in (2, 3) for r in transcript(40)] + [
        (4, 0, "Sentence of a text. " * 400, 0.0, 0.0), (5, 0, "z" * 9000, 0.0, 0.0), (6, 3, "alone", 0.0, 0.0), (7, 0, None, 0.0, 1.0), (8, 1, "  ", 0.0, 1.0)]
    segments = spark.createDataFrame(rows, SEGMENT)
    whole = K.chunk(segments)
    n, sid = F.col("chunk_seq"), F.col("source_id")
    text = (F.when((n == 1) & (sid == 1), F.array_join(F.reverse(F.split("text", " (?=part )")), " ")).when((n == 3) & (sid == 1), F.concat(F.lit("other "), "text"))
            .when((n == 2) & (sid == 4), F.lit(None)).when((n == 1) & (sid == 5), F.lit("")).otherwise(F.col("text")))
    damaged = whole.filter(~((sid == 1) & (n == 5)) & ~((sid == 3) & (n == 0)) & (sid != 6)).withColumn("text", text)
    damaged = damaged.unionByName(damaged.filter((n == 2) & (sid < 4)).withColumn("start_sec", F.lit(0.0))).cache()
    for chunks in (whole, damaged):
        want = sorted(map(tuple, K.chunk_ledger(segments, chunks).collect()))
        assert want == sorted(map(tuple, K._ledger_in_blocks(segments, chunks).collect()))
        assert want == sorted(map(tuple, K.chunk_ledger(segments, chunks, width=50).collect()))
        (row,) = K.chunk_audit(segments, chunks).collect()
        assert [row] == K.chunk_audit(segments, chunks, width=50).collect()
    assert row.lost > 0 and row.disordered > 0 and row.repeated > 3 and row.late_starts > 0 and row.overlap_chars > 0
    none = K.chunk_audit(segments.limit(0), damaged.limit(0)).first()
    assert (none.n_chunks, none.n_sources, none.lost, none.max_tokens) == (0, 0, 0, None)


def test_shared_end_is_the_longest(spark):
    rng = np.random.default_rng(4)
    for _ in range(5000):
        a, b = ("".join(rng.choice(list("ab"), rng.integers(0, 8))) for _ in range(2))
        assert K._shared_end(a, b) == max(k for k in range(min(len(a), len(b)) + 1) if b.startswith(a[len(a) - k :]))


def test_cut_offs_equal_separate_runs(spark):
    golden = quality.golden(spark, ROOT)
    parts = retrieval.embedded(spark, ROOT)
    got = {r.threshold: r for r in E.cutoff_scores(*parts, golden, (1.0, 1.25), 6).collect()}
    for cut, row in got.items():
        results = R.retrieve(*parts, max_dist=cut)
        want = E.recall_mrr(E.query_scores(results, golden)).filter("category = 'ALL'").first()
        wrong = E.false_hits(results, golden).first()
        assert (row.n, row.recall, row.mrr, row.coverage) == (want.n, want.recall, want.mrr, want.coverage)
        assert (row.negatives, row.false_hits) == (wrong.negatives, wrong.false_hits)


def test_sizes_per_query_equal_single_retrievals(spark):
    questions, *rest = retrieval._sized(spark, ROOT)
    got = R.bounded_search(questions, *rest, max_dist=1.25, scope_collection=7).select("query_id", "rank", "chunk_id", "score").collect()
    clamp = lambda v: min(max(v or 6, 1), 20)
    sizes = {r.query_id: clamp(r.top_k) for r in questions.collect()}
    assert len(set(sizes.values())) > 3
    want = []
    for size in sorted(set(sizes.values()))[::4]:
        few = questions.filter(F.col("query_id").isin([q for q, s in sizes.items() if s == size])).drop("top_k")
        want += [tuple(r) for r in R.retrieve(few, *rest, top_k_=size, max_dist=1.25, scope_collection=7).select("query_id", "rank", "chunk_id", "score").collect()]
    asked = {q for q, s in sizes.items() if s in sorted(set(sizes.values()))[::4]}
    assert sorted(tuple(r) for r in got if r.query_id in asked) == sorted(want)


def test_stored_index_grows_by_its_registry(spark, tmp_path):
    """Batches add only new texts; the plan of growth reads no posting; a broken batch does not count."""
    texts = spark.createDataFrame([(i, f"text number {i} of some") for i in range(20)], "chunk_id long, text string")
    path = str(tmp_path / "index")
    SK.write_index(texts.filter("chunk_id < 12"), path, batch="1")
    SK.write_index(texts, path, batch="2")
    SK.write_index(texts, path, batch="2")  # a replay
    want = sorted(map(tuple, X.gram_index(texts, "chunk_id").collect()))
    assert sorted(map(tuple, SK.read_index(spark, path).collect())) == want
    assert spark.read.parquet(f"{path}/registry").groupBy("batch").count().count() == 2
    X.gram_index(texts, "chunk_id").write.parquet(f"{path}/postings/batch=3")  # broke off before its registry
    assert SK.read_index(spark, path).count() == len(want)
    grown = X.gram_index(texts.join(SK.stored_ids(spark, path, texts.select("chunk_id").schema), "chunk_id", "left_anti"), "chunk_id")
    plan = grown._jdf.queryExecution().executedPlan().toString()
    assert "postings" not in plan and grown.count() == 0
    questions = spark.createDataFrame([(1, "number 17")], "query_id long, query string")
    found = X.bm25(questions, texts, 3, index=SK.read_index(spark, path)).collect()
    assert [tuple(r) for r in found] == [tuple(r) for r in X.bm25(questions, texts, 3).collect()]


def test_batch_encoder_equals_the_single_one():
    texts = ["", None, "ab", "abc", "日本語 text 😀 é", "x" * 5000, "a\u0000b c"] + [f"row {i} of many" for i in range(60)]
    got = np.concatenate(list(V.hash_trigram_matrix(pa.array(texts), 64, rows=7)))
    assert got.dtype == np.float32 and (got == np.stack([V.hash_trigram_vector(t, 64) for t in texts])).all()


def test_frames_are_picked_in_few_passes(spark):
    """Signatures in clusters over blocks of different sizes: equal to the plain walk."""
    rng = np.random.default_rng(12)
    rows = []
    for group in (1, 2, None):
        seeds = [int(x) for x in rng.integers(-(2**62), 2**62, 9)]
        for i in range(400):
            sig = None if i % 97 == 50 else seeds[int(rng.integers(0, 9))] ^ (1 << int(rng.integers(0, 63)) if rng.random() < 0.7 else -1)
            rows.append((group, i * 3, sig))
    df = spark.createDataFrame(rows, "g long, o long, s long").repartition(5)
    far = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") > 6
    for width, cap in ((65_536, 12), (100, 12), (7, 4), (30, 30)):
        want = []
        for group in (1, 2, None):
            kept = []
            for _, o, sig in sorted((r for r in rows if r[0] == group), key=lambda r: r[1]):
                if len(kept) < cap and (sig is None or all(far(sig, k) for _, k in kept if k is not None)):
                    kept.append((o, sig))
            want += [(group, o) for o, _ in kept]
        got = I.near_dedup(df, "g", "o", "s", 6, cap, width).select("g", "o").collect()
        assert Counter(map(tuple, got)) == Counter(want)


def test_nested_page_parts(spark):
    html = ("<title>t</title><nav>a<nav>b</nav>c</nav><p>one<p>two<div class=\"x ad\"><div>3<div>4</div></div>5</div>six"
            "<div id='comments'>7</div><div class='adage'>eight</div><form>9<p></form><aside>never closed <b>nine</b> &lt;ten&gt; a < b")
    rows = spark.createDataFrame([(1, html), (2, None), (3, ""), (3, ""), (4, "plain"), (5, "</nav></div>x<nav/>y<br>z")], "page_id long, html string")
    got = sorted((r.page_id, r.text) for r in RD.page_bodies(rows).collect())
    assert got == [(1, "onetwo\nsix\neight\nnever closed nine <ten> a < b"), (2, ""), (3, ""), (3, ""), (4, "plain"), (5, "xy\nz")]


def test_a_batch_is_classified_once_and_rows_without_identity_stay_where_they_are(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    batch = spark.createDataFrame([(i, " " if i % 4 else f"text {i}") for i in range(1000)], "item_id long, text string").repartition(8)
    rows = N.route_items(N.classify_items(batch.withColumn("text", read("text"))), library(spark))
    kept = rows.select("routing", F.spark_partition_id().alias("p")).collect()
    assert Counter(r.routing for r in kept) == {"rejected": 750, "queued": 250}
    assert len({r.p for r in kept if r.routing == "rejected"}) > 1
    assert seen.value <= 4000  # the links and the texts among the items, kind and body


def test_first_lines_and_pastes_of_links_by_their_first_word(spark):
    first = [("a\nb", "a"), (" \u2003\r\n\x0b x y \x85z", "x y"), (" \n ", ""), ("", ""), (None, None), ("one ", "one"), ("\u3000\u8a9e\u2028b", "\u8a9e")]
    rows = spark.createDataFrame(first, "t string, want string")
    assert [r.got for r in rows.select(T.first_line("t", 80).alias("got")).collect()] == [w for _, w in first]
    assert rows.filter("t is not null").select(T.first_line("t", 1).alias("x")).first().x == "a"
    pastes = [("https://a.b/c", True), (" \n\u2003HTTPS://a.b\n\n http://c ", True), ("https://a.b c", False), ("a\nhttps://a.b", False),
              (" \n ", False), ("", False), ("http\u017f://a.b", False), (None, None)]
    rows = spark.createDataFrame(pastes, "t string, want boolean")
    assert [r.got for r in rows.select(T.is_url_batch("t").alias("got")).collect()] == [w for _, w in pastes]


def test_many_small_blocks_are_judged_together():
    n, pair = 3000, pa.list_(pa.struct([("sec", pa.int64()), ("n", pa.int32())]))
    secs = [[{"sec": 10 * i + j, "n": 2} for j in range(1 + i % 3)] for i in range(n)]
    held = [[{"sec": 10 * i - 5, "n": i % 3}] if i % 2 else [] for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(secs, pair), pa.array(held, AD.STATE)], ["k", "_secs", "_held"])
    out = list(AD._judge(iter([batch]), 1, 3, 8))
    assert len(out) == 1
    got = list(zip(*(out[0].column(c).to_pylist() for c in ("k", "_sec", "_before", "_admit"))))
    want = []
    for i in range(n):
        let = deque((h["sec"], h["n"]) for h in held[i])
        for p in secs[i]:
            before = sum(m for s, m in let if s > p["sec"] - 8)
            admit = min(p["n"], max(3 - before, 0))
            want.append((i, p["sec"], before, admit))
            let.append((p["sec"], admit))
    assert got == want


@pytest.mark.parametrize("sizes", [(15, 40), (1, 3), (300, 1900), (1900, 2600)])
def test_a_block_is_entered_in_few_states_and_the_real_one_is_among_them(sizes):
    rng = np.random.default_rng(sum(sizes))
    p = K._Pieces([(i, "x" * int(n), 0.0, 0.0, i) for i, n in enumerate(rng.integers(*sizes, 3000))])
    for first in range(900, 2000, 97):
        entries = p.entries(first, 2900)
        s, j = 0, 0
        while j < first:
            s, j = p.step(s, j)
        assert (s, j) in entries
        for start in range(max(first - 12, 0), first):  # whichever piece the packing before began with
            s, j = start, start
            while j < first:
                s, j = p.step(s, j)
            assert (s, j) in entries
        if sizes == (15, 40):
            assert len(entries) < 300  # some 2000 when every tail of up to 120 tokens was followed
    assert p.entries(0, 2900) == [(0, 0)]


def test_tags_of_more_markup_go_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(RD, "SHARE_BYTES", 1000)
    pages = spark.createDataFrame([(i, f"<nav>m</nav><p>{'word ' * 40}{i}</p>") for i in range(200)], "page_id long, html string")
    tokens = RD.page_tokens(pages)
    n = len("<nav>m</nav><p>" + "word " * 40 + "</p>") * 200 // 1000
    assert tokens.rdd.getNumPartitions() > n
    assert {r.text for r in RD.page_bodies(pages).collect()} == {f"{'word ' * 40}{i}" for i in range(200)}
