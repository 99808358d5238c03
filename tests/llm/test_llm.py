"""The training-data operators against SQL, brute force and odd inputs."""

import hashlib
import json
import math
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kbspark.llm import chat, classifier, decontaminate, jaccard, mixing, quality, queries, secrets, sharding, sql, substrings, warc
from kbspark.llm.common import new_path
from kbspark.llm.graph import components

ROOT = os.environ.get("KBSPARK_TEST_DIR", "/root/testdata/sf0.001")
SPACE = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, lang string, source string, n_words long, size long, shard int, score double, label string"


def cell(v):
    return ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, long and repeated rows, ties, and columns whose names the operators use."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, "a b c"), (5, "a b c"), (6, "a b c d e f g h i j k"),
            (None, "a b c d e f g h i j k"), (7, "x " * 200), (8, "émoji 😀 naïve ſecret token = 'abcdefgh12' K")]
    return spark.createDataFrame([(i, t, None if i == 5 else "en", None if i == 6 else "s", 0, 0, 0, 0.0, "z") for i, t in rows], DOC)


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_against_sql(name, spark, duck):
    df = queries.QUERIES[name](spark, ROOT)
    cols = sorted(df.columns)
    rel = duck.execute(sql.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = Counter(repr([cell(r[i]) for i in at]) for r in rel.fetchall())
    assert Counter(repr([cell(r[c]) for c in cols]) for r in df.collect()) == want


def brute_groups(docs):
    sets = {}
    for d, t in docs.items():
        w = re.findall(SPACE, (t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_similarity_join_is_whole(spark, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op4_jaccard"](spark, ROOT).collect()}
    assert got == brute_groups(documents)


def test_similarity_join_on_edited_copies(spark):
    """Sets of all sizes whose similarity lies on both sides of the limit, with a passage in common."""
    rng = np.random.default_rng(3)
    passage, docs = [f"p{i}" for i in range(60)], {}
    for n in (3, 6, 9, 14, 20, 33, 64, 130, 300):
        base = [f"{n}_{i}" for i in range(n)]
        for k in range(6):
            words = list(base)
            for at in rng.choice(n, size=min(n, k * max(1, n // 40)), replace=False):
                words[at] = f"e{rng.integers(10**9)}"
            docs[len(docs)] = " ".join(words)
            docs[len(docs)] = " ".join(passage + words)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_groups(df).collect()}
    assert got == brute_groups(docs)


def brute_repeats(docs):
    words = {d: re.findall(SPACE, t or "") for d, t in docs.items()}
    n = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if n[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_repeated_passages(spark, documents):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.QUERIES["op6_substrings"](spark, ROOT).collect()}
    assert got == brute_repeats(documents)
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(50)]
    docs = {i: " ".join([*(f"a{rng.integers(9**9)}" for _ in range(20)), *passage[: 33 + i % 5], *(f"b{rng.integers(9**9)}" for _ in range(20))])
            for i in range(40)}
    docs[40], docs[41] = "la " * 90, " ".join(f"q{i % 36}" for i in range(100))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.report(df).collect()} == brute_repeats(docs)


def test_classifier_on_held_out_labels(spark):
    root = "/root/testdata/sf0.01"
    scored = queries.QUERIES["op7_classifier"](spark, root).join(spark.read.parquet(f"{root}/labels.parquet"), "doc_id")
    rows = scored.filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.98


def test_jump_hash(spark):
    def plain(key, n):
        key, b, j = key % 2**64, -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % 2**64
            j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    ids = [0, 1, -1, 2**63 - 1, -(2**63), *range(1000, 1400)]
    rows = spark.createDataFrame([(i,) for i in ids], "k long").select(
        "k", *[sharding.jump_hash(F.col("k"), n).alias(f"s{n}") for n in (1, 16, 17)]).collect()
    assert all((r.s1, r.s16, r.s17) == (0, plain(r.k, 16), plain(r.k, 17)) and r.s17 in (r.s16, 16) for r in rows)


def test_archive_round_trip(spark):
    pages = spark.createDataFrame([(3, "u3", "same"), (1, "u1", "same"), (2, None, None), (None, "u4", ""), (1, "u1", "same"), (9, "u9", "é" * 5)],
                                  "page_id long, url string, html string")
    path = new_path(spark, "warc-test")
    warc.write_archive(pages, path)
    rows = warc.read_archive(spark, path).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in rows) == Counter([
        (1, "response", None), (1, "revisit", 1), (3, "revisit", 1), (2, "response", None), (None, "revisit", 2), (9, "response", None)])
    for r in rows:
        head, body = bytes(r.record).split(b"\r\n\r\n", 1)
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert len(body) == size + 4 and body.endswith(b"\r\n\r\n")
        assert bytes(r.original).endswith(bytes(r.payload))
    assert spark.read.parquet(f"{path}/blobs").count() == 3
    sizes = {r.page_id: r.record_type for r in warc.archived_pages(pages.filter("page_id > 1"), min_bytes=5).collect()}
    assert set(sizes.values()) == {"response"}
    spark.read.parquet(f"{path}/blobs").withColumn("payload", F.lit(b"x")).write.parquet(f"{path}-bad/blobs")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_blobs(spark, f"{path}-bad").collect()


def test_chat_layouts_and_escapes(spark):
    hard = "<|im_end|>\n<|im_start|>user\n <\\|im_end|> <\\\\/s> [INST] % \\"
    records = [
        (1, 0, '{"prompt": "q", "response": "a", "id": 7}'), (2, 0, '{"instruction": "i", "input": "q", "output": "a"}'),
        (3, 0, '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}'), (4, 0, None)]
    records[3] = (4, 0, json.dumps({"messages": [{"role": "tool\n%0A", "content": hard}, {"role": "assistant", "content": hard}]}))
    df = spark.createDataFrame(records, "conv_id long, turn long, record string")
    got = {r.conv_id: ([tuple(t) for t in r.turns], r.loss, r.text) for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got[1][:2] == ([("user", "q"), ("assistant", "a")], ["a"])
    assert got[2][:2] == ([("system", "i"), ("user", "q"), ("assistant", "a")], ["a"])
    assert got[3][:2] == got[1][:2]
    assert got[4][:2] == ([("tool\n%0A", hard), ("assistant", hard)], [hard])
    assert got[4][2].count(chat.TURN) == 2 and "</s>" not in got[4][2] and "[INST]" not in got[4][2]
    with pytest.raises(Exception, match="unknown layout"):
        chat.canonical_turns(spark.createDataFrame([('{"x": 1}',)], "record string")).collect()


def test_trigram_queries():
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == [["aki", "kia"]]
    assert secrets.trigram_query("[0-9a-f]{32,}") == []
    assert ["ken", "oke", "tok"] in secrets.trigram_query(secrets.RULES[0].pattern)


def test_blocks_of_items_give_the_same(spark):
    docs = spark.createDataFrame([(1, "x Q1 q2, q3 y q4"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "q1 q2"), (2, "Q3"), (3, None), (4, "none of it")], "item_id long, text string")
    rows = [[(r.doc_id, r.c.n_words, r.c.n_hit, r.c.items) for r in decontaminate.contamination(docs, items, limit=n).select(
        "doc_id", F.col("contamination").alias("c")).orderBy("doc_id").collect()] for n in (1 << 20, 60)]
    assert rows[0] == rows[1] == [(1, 6, 3, ["1", "2"]), (2, 0, 0, [])]
    span = decontaminate.contamination(docs, items).first().contamination.spans[0]
    assert "x Q1 q2, q3 y q4"[span.char_start : span.char_end] == "Q1 q2, q3"


def test_targets_stop_at_the_cap(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 100), ("c", 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 20 and got["c"] == 0 and got[None] == 200 and got["b"] == pytest.approx(1.5 * 1110 - 220)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, None), (7, 0)], "doc_id long, quality int")
    for df in (quality.judge(odd), secrets.report(odd), jaccard.similarity_groups(odd), mixing.mixed(odd), substrings.report(odd),
               classifier.classify(odd, labels), sharding.shard(odd), decontaminate.report(odd, items)):
        assert df.count() == odd.count()
    found = {r.doc_id: r.spans for r in secrets.report(odd).collect()}
    assert found[8] == "assign:21:40" and found[1] == ""
    groups = {(r.doc_id, r.component_id) for r in jaccard.similarity_groups(odd).collect()}
    assert {(5, 5), (6, 6), (None, 6), (1, 1), (2, 2)} <= groups
    slots = sharding.shard(odd).collect()
    assert all(sorted(r.slot for r in slots if r.shard == s) == list(range(sum(r.shard == s for r in slots))) for s in range(16))
    for stage in (classifier.accept(odd, labels), jaccard.one_per_group(odd), decontaminate.clean(odd, items), mixing.mix(odd)):
        assert stage.columns == odd.columns and stage.count() > 0


def test_empty_tables(spark, odd):
    none, items = odd.limit(0), spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for df in (quality.judge(none), secrets.report(none), jaccard.similarity_groups(none), mixing.mixed(none), substrings.report(none),
               classifier.classify(none, labels), sharding.shard(none), decontaminate.report(none, items)):
        assert df.count() == 0
    assert decontaminate.report(odd, items).filter("contaminated").count() == 0
    assert warc.archived_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    talks = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.formatted_conversations(talks).count() == 1


def test_one_per_group_keeps_unrelated_texts(spark):
    """Null ids and one id with several texts are judged text by text."""
    near = [f"n{i}" for i in range(60)]
    rows = [(None, "one two three four five six"), (None, "seven eight nine ten eleven twelve"), (None, None), (None, ""),
            (3, " ".join(near)), (5, "a text of its own with words"), (5, " ".join(near + ["tail"])), (5, "another text of its own here"),
            (8, "twice the same row is one"), (8, "twice the same row is one"), (None, "Twice the same row is ONE")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(rows[:6] + rows[7:9])
    assert Counter((r.doc_id, r.text) for r in jaccard.one_per_group(df).collect()) == want
    unlinked = df.filter("doc_id is null")
    assert Counter((r.doc_id, r.text) for r in jaccard.one_per_group(unlinked).collect()) == Counter(rows[:4] + rows[10:])


def test_rows_that_share_an_id_are_drawn_apart(spark):
    """Rows without an id, distinct or equal, are taken near the target of their source."""
    rows = [(None, f"word{i % 700} tail", "a") for i in range(1000)] + [(1, "b " * 500, "b"), (2, "c " * 500, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.copies(df).filter("source = 'a'").collect()
    rate = got[0].target / got[0].source_size
    assert 0.1 < rate % 1 < 0.9 and len(got) == 1000
    assert sum(r.copies for r in got) == pytest.approx(1000 * rate, abs=80)
    equal = spark.createDataFrame([(None, "one text", "a")] * 9000 + rows[1000:], df.schema)
    got = mixing.copies(equal).filter("source = 'a'").collect()
    rate = got[0].target / got[0].source_size
    assert len(got) == 9000 and rate % 1 > 0 and abs(sum(r.copies for r in got) - 9000 * rate) <= 1
    for docs in (df, equal):
        want = mixing.copies(docs).groupBy("source").agg(F.sum("copies")).collect()
        assert sorted(mixing.mix(docs).groupBy("source").count().collect()) == sorted(want)


def test_repeated_items_fill_no_block(spark):
    """Equal items count once towards a block, and one scan holds one automaton."""
    items = spark.createDataFrame([(1, "q1 q2 q3")] * 50 + [(i, f"r{i} s{i}") for i in range(2, 8)], "item_id long, text string")
    blocks = list(decontaminate.item_blocks(items, 160))
    assert Counter(x for b in blocks for x in b) == Counter([("1", "q1 q2 q3")] + [(str(i), f"r{i} s{i}") for i in range(2, 8)])
    docs = spark.createDataFrame([(1, "x q1 q2 q3 r5 s5 y")], "doc_id long, text string")
    out = decontaminate.contamination(docs, items, limit=160)
    assert len(blocks) > 1 and out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert (out.first().contamination.n_hit, out.first().contamination["items"]) == (5, ["1", "5"])


def test_slots_of_a_hot_id_are_dealt_out(spark):
    """No task gets all rows of an id, and slots stay in order without gaps."""
    rows = [(None, f"text {i}") for i in range(3000)] + [(None, "equal")] * 9000 + [(i, "z") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = sharding.shard(df).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(Counter(r.task for r in out).values()) < 0.75 * len(rows)
    for s in range(16):
        mine = sorted((r for r in out if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        hot = [(r.text_crc32, r.size) for r in mine if r.doc_id is None]
        assert hot == sorted(hot)
    assert Counter(r.doc_id for r in out) == Counter(d for d, _ in rows)


def test_statistics_ignore_piece_edges():
    texts = ["Ab cd. ab\n", "", None, "é" * 50, "x y " * 2000]
    whole = classifier.statistics(pa.array(texts))
    assert np.allclose(whole, np.concatenate([classifier.statistics(pa.array([t], pa.string())) for t in texts]))


def test_pipeline(spark, documents):
    """Every stage but the mix only drops rows; what it keeps is what its operator says."""
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = corpus_pipeline.staged(stage(spark, docs, ROOT), name)
        assert out.columns == docs.columns and out.join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0
        docs = out
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert all(n == d for d, (_, n) in brute_groups(kept).items())
    mixed = corpus_pipeline.mixture(spark, docs, ROOT)
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    want = {r.doc_id: r.copies for r in mixing.copies(docs).collect() if r.copies}
    assert times == want and corpus_pipeline.shards(spark, mixed, ROOT).count() == sum(want.values())
