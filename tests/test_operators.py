"""Operators against brute force and the cases they were specified with."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kbspark.operators import blocks as B
from kbspark.operators import chunking as K
from kbspark.operators import clean as C
from kbspark.operators import evaluate as E
from kbspark.operators import fulltext as X
from kbspark.operators import identity as I
from kbspark.operators import jobs as J
from kbspark.operators import maintain as M
from kbspark.operators import retrieve as R
from kbspark.operators import rollups as A
from kbspark.operators import vectors as V
from kbspark.sources import readers as RD

SEG = "source_id long, seq long, text string, start_sec double, end_sec double"


def tokens(text):
    cjk = len(re.findall("[一-鿿㐀-䶿぀-ヿ가-힣]", text))
    return cjk + (len(text) - cjk) // 4


def plain_pack(segments):
    """Packing written straight from the rules, one source, small segments only."""
    out, cur, fresh = [], [], False
    join = lambda xs: " ".join(x[0] for x in xs)
    for seg in segments:
        if cur and tokens(join(cur + [seg])) > 500:
            out.append(list(cur))
            limit, tail = int(tokens(join(cur)) * 0.15), []
            while len(tail) < len(cur) and tokens(join(cur[len(cur) - len(tail) - 1:])) <= limit:
                tail = cur[len(cur) - len(tail) - 1:]
            if not tail and tokens(cur[-1][0]) < 300:
                tail = [cur[-1]]
            cur = list(tail)
        cur.append(seg)
        fresh = True
    return out + ([cur] if fresh else [])


def test_packing_invariants(spark):
    segs = [(1, i, f"{i:03d} " + "word " * 31, i * 10.0, i * 10.0 + 10) for i in range(60)]
    rows = K.chunk(spark.createDataFrame(segs, SEG)).orderBy("chunk_seq").collect()
    assert len(rows) > 1 and all(r.n_tokens <= 500 for r in rows) and all(r.n_tokens >= 300 for r in rows[:-1])
    assert [r.start_sec for r in rows] == sorted({r.start_sec for r in rows})
    assert all(a.text[-30:] in b.text for a, b in zip(rows, rows[1:]))
    assert all(any(s[2] in r.text for r in rows) for s in segs)


def test_oversized_segment_is_split(spark):
    one = [(1, 0, "一二三四。" * 200, 0.0, 100.0), (2, 0, "x" * 3000, 0.0, 0.0), (3, 0, "   ", 0.0, 0.0), (4, 0, "ok", 0.0, 1.0)]
    rows = K.chunk(spark.createDataFrame(one, SEG)).collect()
    assert len([r for r in rows if r.source_id == 1]) > 1 and all(r.n_tokens <= 500 for r in rows)
    assert "".join(r.text for r in sorted((r for r in rows if r.source_id == 2), key=lambda r: r.chunk_seq)).count("x") >= 3000
    assert not [r for r in rows if r.source_id == 3] and [r.text for r in rows if r.source_id == 4] == ["ok"]


@pytest.mark.parametrize("seed", range(3))
def test_packing_matches_rules_and_does_not_depend_on_blocks(spark, seed, monkeypatch):
    rng = random.Random(seed)
    width = (160, 1900, 40)[seed]
    segs = [(7, i, "字" * rng.randint(0, 3) + "w" * rng.randint(1, width), float(i), i + 1.0) for i in range(900)]
    df = spark.createDataFrame(segs + [(8, 0, "abc. " * 900, 0.0, 90.0)], SEG)
    whole = K.chunk(df).orderBy("source_id", "chunk_seq").toPandas()
    want = plain_pack([(s[2],) for s in segs])
    got = whole[whole.source_id == 7]
    assert [" ".join(x[0] for x in c) for c in want] == list(got.text)
    monkeypatch.setattr(K, "HALO", 127)
    monkeypatch.setattr(K, "FAN", 3)
    assert whole.equals(K.chunk(df, width=128).orderBy("source_id", "chunk_seq").toPandas())


def test_packing_has_no_bound_on_pieces(spark):
    """Very short sentences: over 600 pieces a chunk, of which the next one repeats 100."""
    rows = K.chunk(spark.createDataFrame([(1, 0, "a. " * 3000, 0.0, 0.0)], SEG)).orderBy("chunk_seq").collect()
    want = plain_pack([("a.",)] * 3000)
    assert [r.text for r in rows] == [" ".join(x[0] for x in c) for c in want]
    assert max(r.n_segments for r in rows) > 600 and sum(r.n_segments for r in rows) - 3000 >= 60 * (len(rows) - 1)


def test_packing_ignores_blank_and_missing_segments(spark):
    rng = random.Random(4)
    segs, seq = [], 5
    for i in range(4000):
        segs.append((1, seq, "w" * rng.randint(1, 90), float(seq), seq + 1.0))
        seq += 1 if i % 50 else rng.randint(1, 40)
    blank = [(1, seq + i, " " if i % 2 else "\u3000", 0.0, 0.0) for i in range(3000)]
    tail = [(1, seq + 3000 + i, "v" * rng.randint(1, 90), 0.0, 0.0) for i in range(1500)]
    df = spark.createDataFrame(segs + blank + tail + [(1, seq + 9000, None, 0.0, 0.0)], SEG)
    want = [" ".join(x[0] for x in c) for c in plain_pack([(s[2],) for s in segs + tail])]
    for width in (1024, 1 << 20):
        rows = K.chunk(df, width=width).orderBy("chunk_seq").collect()
        assert [r.text for r in rows] == want and [r.chunk_seq for r in rows] == list(range(len(want)))
        assert rows[0].first_seq == 5


def test_chunk_ids_do_not_collide(spark):
    far = [(1, (1 << 19) - 1, False), (1, 1 << 19, False), (1, 1 << 20, False), (2, 0, False), (1, 0, True), (1 << 43, 0, False), (3, 5, False)]
    df = spark.createDataFrame(far, "s long, n long, v boolean")
    got = [r.id for r in df.select(F.when(F.col("v"), K.chunk_id("s", "n", True)).otherwise(K.chunk_id("s", "n")).alias("id")).collect()]
    assert len(set(got)) == len(far) and got[-1] == 3 * (1 << 20) + 5 and got[1] < 0 and got[5] < 0


def test_vocabulary_budget(spark):
    lines = [("a", 0, "# c"), ("a", 1, "x"), ("a", 2, " "), ("a", 3, "y"), ("a", 4, "z")] + [("b", i, "w" * 50) for i in range(100)]
    out = {r.vocab_id: r for r in K.vocabulary_prefix(spark.createDataFrame(lines, "vocab_id string, line_no long, line string")).collect()}
    assert (out["a"].prompt, out["a"].kept, out["a"].total) == ("x, y, z", 3, 3)
    assert out["b"].kept == 12 and -(-len(out["b"].prompt) // 3) <= 224 and out["b"].total == 100


def test_segment_filter_case(spark):
    raw = [("A", 0.1, 0.0)] + [("again", 0.1, 0.0)] * 8 + [("hush", 0.95, -1.5), ("loud", 0.95, -0.12), (" ", 0.0, 0.0), ("B", 0.0, 0.0),
           ("Thanks for watching!", 0.92, 0.0), ("Thank you for watching", 0.05, 0.0)]
    df = spark.createDataFrame([(1, i, t, 0.0, 1.0, n, p) for i, (t, n, p) in enumerate(raw)],
                               "media_id long, seq long, text string, start_sec double, end_sec double, no_speech_prob double, avg_logprob double")
    kept = [r.text for r in C.filter_segments(df).orderBy("seq").collect()]
    assert kept == ["A", "again", "again", "loud", "B", "Thank you for watching"]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from(["a", "a", "b", "!", "hush"]), min_size=1, max_size=40), st.sampled_from([3, 7, 1000]))
def test_runs_never_exceed_two(spark, words, width):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(words)], "k long, seq long, v string")
    rows = B.lag_pair(df, ["k"], "seq", "v", width=width).orderBy("seq").collect()
    for i, r in enumerate(rows):
        assert r.prev1 == (words[i - 1] if i > 0 else None) and r.prev2 == (words[i - 2] if i > 1 else None)


def test_block_sums_match_plain_running_sums(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), s, rng.randint(0, 9)) for s in rng.sample(range(5000), 400)]
    df = spark.createDataFrame(rows, "k string, s long, v long")
    for keys in (["k"], []):
        got = B.running_sum(df, keys, "s", {"t": F.col("v")}, width=100).collect()
        for r in got:
            assert r.t == sum(v for k, s, v in rows if s <= r.s and (not keys or k == r.k))


def test_speech_coverage_case(spark):
    media = spark.createDataFrame([(1, 60.0, True), (2, 60.0, False), (3, 60.0, False), (4, 9.0, False), (5, None, False)],
                                  "media_id long, duration_secs double, has_captions boolean")
    segs = [(2, i * 1.0, i + 0.9) for i in range(60)] + [(3, 0.0, 5.0)]
    out = {r.media_id: r.hollow for r in C.speech_coverage(media, spark.createDataFrame(segs, "media_id long, start_sec double, end_sec double")).collect()}
    assert out == {1: False, 2: False, 3: True, 4: True, 5: True}


def test_fulltext_rules(spark):
    chunks = spark.createDataFrame([(1, "台積電法說會"), (2, "ananan ETF"), (3, "an etf of ETFs"), (4, "")], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "積電法"), (2, "anan"), (3, "ETF etf"), (4, "of an"), (5, "?")], "query_id long, query string")
    hits = {(r.query_id, r.chunk_id, r.term): r.tf for r in X.fts_match(q, chunks).collect()}
    assert hits == {(1, 1, "積電法"): 1, (2, 2, "anan"): 2, (3, 2, "ETF"): 1, (3, 2, "etf"): 1, (3, 3, "ETF"): 2, (3, 3, "etf"): 2}


def test_index_and_scan_agree(spark, monkeypatch):
    rng = random.Random(5)
    chunks = spark.createDataFrame([(i, " ".join("".join(rng.choices("abc", k=5)) for _ in range(30))) for i in range(60)], "chunk_id long, text string")
    q = spark.createDataFrame([(i, " ".join("".join(rng.choices("abc", k=4)) for _ in range(3))) for i in range(9)], "query_id long, query string")
    want = sorted(map(tuple, X.bm25(q, chunks, 5).collect()))
    index = X.gram_index(chunks, "chunk_id")
    assert sorted(map(tuple, X.bm25(q, chunks, 5, index=index).collect())) == want
    named = chunks.withColumn("chunk_id", F.format_string("c%03d", "chunk_id"))
    spelt = [(q_, f"c{c:03d}", *rest) for q_, c, *rest in want]
    assert sorted(map(tuple, X.bm25(q, named, 5).collect())) == spelt
    monkeypatch.setattr(X, "bounded_values", lambda *a, **k: None)  # the way beyond the broadcast ceiling
    assert sorted(map(tuple, X.bm25(q, chunks, 5).collect())) == want
    assert sorted(map(tuple, X.bm25(q, named, 5).collect())) == spelt


def test_nearest_neighbours_both_ways(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vec, qry = rng.normal(size=(300, 8)), rng.normal(size=(40, 8))
    vs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)], "chunk_id long, embedding array<double>")
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(qry)], "query_id long, qvec array<double>")
    d = np.round(np.sqrt(((qry[:, None] - vec[None]) ** 2).sum(-1)), 6)
    want = sorted((q, int(i), r) for q in range(40) for r, i in enumerate([i for i in np.lexsort((np.arange(300), d[q])) if d[q][i] <= 3.0][:7]))
    run = lambda: sorted((r.query_id, r.chunk_id, r.vec_rank) for r in V.knn(qs, vs, 7, 3.0).collect())
    assert run() == want
    counts = lambda: {(r.query_id, r.threshold): r.hits for r in V.within(qs, vs, [2.5, 4.0]).collect()}
    near = {(q, c): int((d[q] <= c).sum()) for q in range(40) for c in (2.5, 4.0) if (d[q] <= c).any()}
    mixed = spark.createDataFrame([(1, [0.0] * 6), (2, [0.0] * 10)], "chunk_id long, embedding array<double>")
    assert counts() == near
    with pytest.raises(Exception, match="vectors of"):
        V.knn(qs, mixed, 3).collect()
    monkeypatch.setattr(V, "BLOCK_ROWS", 16)
    assert run() == want and counts() == near
    with pytest.raises(Exception, match="vectors of"):
        V.knn(qs, mixed, 3).collect()


def test_vector_gate(spark):
    ok = spark.createDataFrame([(1, [0.0, 1.0], "m")], "chunk_id long, embedding array<float>, model string")
    V.check_vectors(ok, 2, model="model", expected_model="m")
    for kw in ({"dim": 3}, {"dim": 2, "model": "model", "expected_model": "other"}):
        with pytest.raises(ValueError):
            V.check_vectors(ok, **kw)


def test_scope_and_fusion(spark):
    chunks = spark.createDataFrame([(i, i % 2, f"needle text {i}", 0.0, 1.0) for i in range(8)], "chunk_id long, source_id long, text string, start_sec double, end_sec double")
    sources = spark.createDataFrame([(0, None, 5), (1, "one", None)], "source_id long, title string, collection_id long")
    vectors = V.embed(chunks, "text").select("chunk_id", "embedding")
    q = V.embed(spark.createDataFrame([(1, "needle text 3")], "query_id long, query string"), "query", "qvec")
    rows = R.retrieve(q, chunks, vectors, sources, scope_source=1).collect()
    assert rows and {r.source_id for r in rows} == {1}
    nearest = R.retrieve(q, chunks, vectors, sources).filter("vec_rank = 0").first()
    assert nearest.chunk_id == 3 and nearest.vec_distance == 0.0
    assert {r.title for r in R.retrieve(q, chunks, vectors, sources, scope_collection=5).collect()} == {"(未命名)"}
    assert R.retrieve(q, chunks, vectors, sources, scope_collection=99).count() == 0
    sized = q.withColumn("top_k", F.lit(99))
    assert R.bounded_search(sized, chunks, vectors, sources).count() == 8
    cited = R.citation_rows(R.retrieve(q, chunks, vectors, sources), spark.createDataFrame([(1, "x【S2】")], "query_id long, answer string"))
    assert [r["rank"] for r in cited.collect()] == [2]
    trace = R.retrieval_trace(R.retrieve(q, chunks, vectors, sources).withColumn("display_title", F.lit(None).cast("string")).withColumn("platform", F.lit("web")))
    assert [t.label for t in trace.first().trace] == [1, 2, 3, 4, 5, 6]


def test_near_dedup_brute_force(spark):
    rng = random.Random(2)
    rows = [(g, i, None if rng.random() < .1 else rng.getrandbits(63) & rng.getrandbits(63) & rng.getrandbits(63)) for g in range(3) for i in range(40)]
    want = set()
    for g in range(3):
        kept, sigs = [], []
        for gg, i, s in rows:
            if gg == g and (s is None or all(bin(s ^ k).count("1") > 12 for k in sigs)):
                kept.append(i)
                if s is not None:
                    sigs.append(s)
        want |= {(g, i) for i in kept[:5]}
    df = spark.createDataFrame(rows, "g long, i long, s long")
    assert {(r.g, r.i) for r in I.near_dedup(df, "g", "i", "s", 12, 5).collect()} == want


def test_batch_routing(spark):
    inc = spark.createDataFrame([(1, "web", "a", None), (2, "web", "a", None), (3, "web", "b", None), (4, "web", "c", None), (5, None, None, "bad")],
                                "n long, platform string, content_id string, reason string")
    lib = spark.createDataFrame([(10, "web", "b", "ready"), (11, "web", "c", "failed")], "source_id long, platform string, video_id string, status string")
    out = {r.n: (r.routing, r.known_source_id) for r in I.route_ingest(inc, lib, "n").collect()}
    assert out == {1: ("queued", None), 2: ("duplicate", None), 3: ("duplicate", 10), 4: ("reingest", 11), 5: ("rejected", None)}


def test_summary_enqueue_is_idempotent(spark):
    src = spark.createDataFrame([(1, None), (2, "s"), (3, None)], "source_id long, summary string")
    jobs = spark.createDataFrame([], "kind string, status string, source_id long")
    new = J.enqueue_summaries(src, src, jobs)
    assert {r.source_id for r in new.collect()} == {1, 3}
    after = new.select(F.lit("summarize").alias("kind"), F.lit("pending").alias("status"), "source_id")
    assert J.enqueue_summaries(src, src, after).count() == 0


def test_cascade_delete_and_limit(spark):
    t = {"sources": spark.createDataFrame([(1,), (2,)], "source_id long"), "chunks": spark.createDataFrame([(5, 1), (6, 2)], "chunk_id long, source_id long"),
         "chunk_vectors": spark.createDataFrame([(5,), (6,)], "chunk_id long"), "jobs": spark.createDataFrame([(1, 1), (2, None)], "job_id long, source_id long")}
    out = M.cascade_delete(t, spark.createDataFrame([(1,), (9,)], "source_id long"))
    assert [r.chunk_id for r in out["chunk_vectors"].collect()] == [6] and [r.job_id for r in out["jobs"].collect()] == [2]
    assert {r.source_id: r.outcome for r in out["report"].collect()} == {1: "deleted", 9: "missing"}
    with pytest.raises(ValueError):
        M.cascade_delete(t, spark.range(21).withColumnRenamed("id", "source_id"))


def test_publish_is_all_or_nothing(spark, tmp_path):
    root = str(tmp_path)
    good = {"sources": spark.createDataFrame([(1, "web", "a")], "source_id long, platform string, video_id string"),
            "chunks": spark.createDataFrame([(1, 1), (2, 1)], "chunk_id long, source_id long"),
            "chunk_vectors": spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "chunk_id long, embedding array<float>")}
    bad = dict(good, chunk_vectors=spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "chunk_id long, embedding array<float>"))
    with pytest.raises(ValueError):
        M.publish(bad, root, "1", lambda r: M.require_clean(r, 2))
    assert not (tmp_path / "version=1").exists()
    M.publish(good, root, "2", lambda r: M.require_clean(r, 2))
    assert spark.read.parquet(f"{root}/version=2/chunks").count() == 2


def test_snapshot_retention(spark, tmp_path):
    t = {"meta": spark.createDataFrame([("a", "b")], "key string, value string")}
    for i in range(9):
        M.snapshot(t, str(tmp_path), f"2024010{i}-000000")
    M.snapshot(t, str(tmp_path), "20240108-000000")
    names = M.snapshots(spark, str(tmp_path))
    assert len(names) == 7 and names[0] == "snap=20240108-000000-1"
    broken = {"meta": t["meta"], "other": t["meta"].select(F.raise_error(F.lit("lost")).cast("string").alias("x"))}
    with pytest.raises(Exception, match="lost"):
        M.snapshot(broken, str(tmp_path), "20240109-000000")
    assert M.snapshots(spark, str(tmp_path)) == names


def test_collection_cap(spark):
    src = spark.createDataFrame([(i, None) for i in range(5)], "source_id long, collection_id long")
    have = spark.createDataFrame([(i, f"c{i}", None) for i in range(1, 49)], "collection_id long, name string, created_at timestamp")
    feed = spark.createDataFrame([(i, f"n{i}", i) for i in range(4)] + [(4, "c7", 9)], "source_id long, name string, seq long")
    moved, every = M.assign_collections(src, have, feed, ["seq"], F.current_timestamp())
    assert every.count() == 50
    assert {r.source_id: r.collection_id for r in moved.collect()} == {0: 49, 1: 50, 2: None, 3: None, 4: 7}


def test_evaluation_rules(spark):
    golden = spark.createDataFrame([(1, "c", [("a", "x1"), ("b", "x2")]), (2, "c", [("a", "zz")]), (3, "n", [])],
                                   "query_id long, category string, expect array<struct<doc:string,text:string>>")
    res = spark.createDataFrame([(1, 1, 10, "has x2"), (1, 2, 11, "has x1"), (3, 1, 12, "any")], "query_id long, rank int, chunk_id long, text string")
    s = {r.query_id: r for r in E.query_scores(res, golden).collect()}
    assert (s[1].first_rank, s[1].rr, s[1].coverage, s[1].gold_chunk) == (1, 1.0, 1.0, 11)
    assert (s[2].hit, s[2].rr) == (0.0, 0.0) and 3 not in s
    f = E.false_hits(res, golden).first()
    assert (f.negatives, f.false_hits) == (1, 1)


def test_rate_limit_window(spark):
    base = [(i, f"2024-01-01 00:{i:02d}:00") for i in range(31)] + [(40, "2024-01-01 00:30:30"), (41, "2024-01-01 01:00:00"), (42, "2024-01-01 03:00:00")]
    df = spark.createDataFrame(base, "id long, t string").withColumn("created_at", F.col("t").cast("timestamp"))
    got = {r.id: r.refused for r in A.rate_limited(df, "id").collect()}
    # row 0 is an hour old when row 41 comes, so its place is free
    assert not got[29] and got[30] and got[40] and not got[41] and not got[42]


def test_rate_limit_counts_admitted_rows_only(spark):
    start = 1_704_067_200
    steady = [(i, "a", start + 60 * i) for i in range(400)] + [(1000 + i, "b", start) for i in range(50)] + [(2000, None, start), (2001, "a", None)]
    df = spark.createDataFrame(steady, "id long, who string, s long").withColumn("created_at", F.timestamp_seconds("s"))
    rows = {r.id: r for r in A.rate_limited(df, "id", "who").collect()}
    assert len(rows) == len(steady) and sum(not rows[i].refused for i in range(400)) == 210
    assert [rows[1000 + i].refused for i in range(50)] == [False] * 30 + [True] * 20
    assert rows[2000].refused is False and rows[2001].refused is None


def test_parts_and_lines(spark):
    media = spark.createDataFrame([(1, 50_000_000, 90.0), (2, 1000, 9.0)], "media_id long, n_bytes long, duration_secs double")
    offs = {(r.media_id, r.part): r.offset_sec for r in RD.part_offsets(media).collect()}
    assert offs == {(1, 0): 0.0, (1, 1): 30.0, (1, 2): 60.0, (2, 0): 0.0}
    lines = RD.lines_to_chunks(spark.createDataFrame([(1, "a\n\n b \nc", [0.0, 4.0])], "id long, text string, times array<double>"))
    assert [(r.text, r.start_sec) for r in lines.orderBy("pos").collect()] == [("a", 0.0), ("b", 4.0), ("c", 4.0)]


def test_repeated_redirects_and_missing_groups(spark):
    urls = spark.createDataFrame([("https://youtu.be/abcdefghijk",)], "url string")
    hops = spark.createDataFrame([(urls.first().url, "https://www.youtube.com/watch?v=abcdefghijk")] * 2, "from_url string, location string")
    assert I.expand_redirects(urls, hops).count() == 1
    rows = spark.createDataFrame([(None, 1, 5), (None, 2, 5), ("a", 3, 9)], "g string, o long, s long")
    assert sorted(r.o for r in I.near_dedup(rows, "g", "o", "s").collect()) == [1, 3]
    episodes = spark.createDataFrame([(None, 1, "t", "g", "u", "60")], "b string, o long, title string, guid string, audio_url string, duration_secs string")
    assert C.coerce_episodes(episodes, "b", "o").count() == 1


def test_posting_table_searches_a_text_once_for_all_terms(spark):
    """A gram that all terms share pairs no text with each of them: candidates are walked once."""
    words = [f"w{i:02d}ing" for i in range(40)]
    texts = spark.createDataFrame([(i, " ".join(words[: i + 1]) + " Sing" * i) for i in range(30)] + [(90, "none"), (91, None)], "chunk_id long, text string")
    needles = spark.createDataFrame([(w,) for w in words], "needle string")
    index = X.gram_index(texts, "chunk_id")
    out = X.occurrences(texts, needles, "chunk_id", index=index, known=words)
    assert "regexp_count" not in out._jdf.queryExecution().toString()
    got = sorted(map(tuple, out.select("chunk_id", "needle", "tf").collect()))
    assert got == sorted((i, w, 1) for i in range(30) for w in words[: i + 1])
    asked = spark.createDataFrame([(1, "w03ing none"), (2, "w20ing sing")], "query_id long, query string")
    plain = list(map(tuple, X.bm25(asked, texts, 4).collect()))
    assert plain and sorted(map(tuple, X.bm25(asked, texts, 4, index=index).collect())) == sorted(plain)


def test_encoder_tiles_are_bounded_by_bytes():
    """The work arrays of an encoder grow with the bytes of a tile, not with its rows."""
    texts = pa.array([None, ""] + ["é" * 1000] * 2000 + ["x" * 3_000_000, "ab", None])
    tiles = list(B.text_tiles(texts, 2048))
    assert pa.concat_arrays(tiles).equals(texts)
    assert all(len(t) == 1 or sum(len((x or "").encode()) for x in t.to_pylist()) <= B.TILE_BYTES for t in tiles)
    assert max(len(m) for m in V.hash_trigram_matrix(texts)) < 300
    assert np.array_equal(np.concatenate(list(V.hash_trigram_matrix(texts))), np.stack([V.hash_trigram_vector(x) for x in texts.to_pylist()]))
    assert [len(t) for t in B.text_tiles(pa.array(["", None] * 5), 4)] == [4, 4, 2] and not list(B.text_tiles(pa.array([], pa.string()), 4))


def test_scans_hold_hits_of_bounded_text():
    """A batch is searched in slices of bounded text, each row once."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(["some words " * 400] * 2998 + [None, ""])], ["id", "_body"])
    parts = list(X._tiled(iter([batch, batch.slice(0, 0)]), "_body"))
    assert len(parts) > 3 and max(p.column(1).nbytes for p in parts) <= X.SCAN_BYTES + 8 * 3001
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(3000))


def counted(spark, df, column):
    """``df`` whose ``column`` counts how often it is computed, and the counter."""
    seen = spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    return df.withColumn(column, F.udf(read, "string").asNondeterministic()(column)), seen


def plain_bm25(texts, asked, k):
    """BM25 straight from its formula: (query, text, rank, score)."""
    size = {i: max(len(x) - 2, 0) for i, x in texts.items()}
    mean, out = sum(size.values()) / len(texts), []
    for q, terms in asked.items():
        tf = {w: {i: n for i, x in texts.items() if (n := len(re.findall(f"(?={w})", x.lower())))} for w in terms}
        score = {}
        for w, found in tf.items():
            idf = max(np.log((len(texts) - len(found) + 0.5) / (len(found) + 0.5)), 1e-6)
            for i, n in found.items():
                score[i] = score.get(i, 0) + idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size[i] / mean))
        best = sorted(score, key=lambda i: (-round(score[i], 9), i))[:k]
        out += [(q, i, r, round(score[i], 6)) for r, i in enumerate(best)]
    return sorted(out)


def test_keyword_search_walks_a_text_once(spark, monkeypatch):
    """Statistics and scores come from one walk; tiles of hits and long texts change nothing."""
    rng = random.Random(7)
    texts = {i: " ".join("".join(rng.choices("abcAB", k=5)) for _ in range(rng.randrange(40))) for i in range(80)} | {90: "aba " * 300_000, 91: ""}
    asked = {i: sorted({"".join(rng.choices("abc", k=3)) for _ in range(6)}) for i in range(7)}
    chunks, seen = counted(spark, spark.createDataFrame([*texts.items(), (92, None)], "chunk_id long, text string").repartition(3), "text")
    queries = spark.createDataFrame([(q, " ".join(w)) for q, w in asked.items()] + [(99, "zzzz"), (98, "?")], "query_id long, query string")
    want = plain_bm25(texts | {92: ""}, asked, 4)
    got = X.bm25(queries, chunks, 4)
    assert sorted((r.query_id, r.chunk_id, r.fts_rank, round(r.score, 6)) for r in got.collect()) == want
    assert seen.value == len(texts) + 1
    monkeypatch.setattr(X, "TILE_CELLS", 50)
    again = X.bm25(queries, chunks, 4).collect()
    assert sorted((r.query_id, r.chunk_id, r.fts_rank, round(r.score, 6)) for r in again) == want
    some = X.bm25(queries, chunks, 4, allowed=F.col("chunk_id") % 2 == 0).collect()
    whole = {(r.query_id, r.chunk_id): r.score for r in X.bm25(queries, chunks, 100).collect()}
    assert some and all(r.chunk_id % 2 == 0 and r.score == whole[r.query_id, r.chunk_id] for r in some)


def test_chunks_carry_columns_of_their_source(spark):
    """Texts are read once where the largest position is known, and meet their sources once."""
    rows = [(i, 0, f"Text {i}. " * (400 * (i % 3) + 1), None, None) for i in range(9)]
    segments, seen = counted(spark, spark.createDataFrame(rows, SEG), "text")
    sources = spark.createDataFrame([(i, "text", f"t{i}") for i in range(8)], "source_id long, type string, title string")
    got = K.build_chunks(segments, sources, max_seq=0, carry=("title",)).collect()
    assert seen.value == 9 and {(r.source_id, r.title) for r in got} == {(i, f"t{i}") for i in range(8)}
    plain = K.build_chunks(spark.createDataFrame(rows, SEG), sources).collect()
    assert sorted(tuple(r)[:-1] for r in got) == sorted(map(tuple, plain)) and len(plain) > 8
    seen_rows = spark.createDataFrame([(1, 0, "seen", 0.0, 0.0)], "source_id long, pos long, text string, start_sec double, end_sec double")
    both = K.build_chunks(spark.createDataFrame(rows, SEG), sources, seen_rows, carry=("title",))
    assert [r.title for r in both.filter("modality = 'visual'").collect()] == ["t1"] and both.count() == len(plain) + 1


def test_pieces_count_like_whole_segments():
    """Tokens of pieces, with and without characters that count as one each."""
    for text in ("Plain words. " * 300, "Mixed 電話 words. Then none. " * 200, "é" * 2100, "電" * 1100, " \n "):
        p = K._Pieces([(0, text, 0.0, 9.0, 0), (3, "last", 9.0, 10.0, 3)])
        assert p.given == [s for s, _ in p.pos] and [p.tokens(i, i + 1) for i in range(len(p.pos))] == [tokens(x) for x in p.text]


def test_broken_bytes_encode_as_before():
    """Bytes that are no UTF-8 do not stop an encoder, and change no other text."""
    whole = pa.array(["plain text", "grüße \U0001f600電話", "", None])
    assert np.array_equal(np.concatenate(list(V.hash_trigram_matrix(whole))), np.stack([V.hash_trigram_vector(x) for x in whole.to_pylist()]))
    code, at = V.code_points(pa.array([b"ab\xff\xe9cd", "é".encode()], pa.binary()).view(pa.string()))
    assert at.tolist()[0] == 0 and at.tolist()[-1] == len(code)


def test_arm_tops_are_those_of_a_shallower_search(spark):
    rng = np.random.default_rng(3)
    unit = lambda n: [[float(x) for x in v / np.linalg.norm(v)] for v in rng.normal(size=(n, 8))]
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    chunks = spark.createDataFrame([(i, i, " ".join(rng.choice(words, 6)), v, f"t{i}") for i, v in enumerate(unit(40))],
                                   "chunk_id long, source_id long, text string, embedding array<float>, title string")
    queries = spark.createDataFrame([(i, words[i], v) for i, v in enumerate(unit(5))], "query_id long, query string, qvec array<float>")
    vectors, sources, chunks = chunks.select("chunk_id", "embedding"), chunks.select("source_id", "title"), chunks.select("chunk_id", "source_id", "text")
    rows = lambda df: sorted(map(tuple, df.collect()))
    wide = R.arms(queries, chunks, vectors, 20, 2.0)
    own = R.arms(queries, chunks, vectors, 3, 2.0)
    assert [rows(t) for t in E.arm_tops(*wide, 3)] == [rows(a.select("query_id", "chunk_id")) for a in own]
    got = R.retrieve(queries, chunks, vectors, sources, 4, 2.0, searched=wide)
    assert rows(got) == rows(R.retrieve(queries, chunks, vectors, sources, 4, 2.0)) and got.count() == 20


def test_attribution_searches_every_arm_once(spark, monkeypatch):
    from kbspark.plans import quality

    calls = []
    for module in (R, E):
        for name in ("knn", "bm25"):
            monkeypatch.setattr(module, name, lambda *a, _f=getattr(module, name), _n=name, **kw: calls.append(_n) or _f(*a, **kw))
    sf = "/root/testdata/sf0.001"
    got = quality.attribution_counts(spark, sf).first().asDict()
    assert sorted(calls) == ["bm25", "knn"]
    routes = {r.route: r["count"] for r in quality.attribution(spark, sf).groupBy("route").count().collect()}
    assert sum(got.values()) > 0 and {k: v for k, v in got.items() if v} == routes
