"""Stages on tables with clashing columns and odd rows, and what the operators owe beyond their queries."""

import os
import re
import resource
import time
import uuid
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kbspark.llm import classifier, decontaminate, jaccard, mixing, quality, sharding, substrings, warc
from kbspark.llm.common import new_path

ROOT = os.environ.get("KBSPARK_TEST_DIR", "/root/testdata/sf0.001")
# Names that operators give to columns of their own.
CLASHING = ("contamination next found doc row hash _hash _id _text_hash key label rows copies size target source_size _rate _again _n _digest _extra _from"
            " _at _mix_source shard slot slice text_crc32 x quality score held_out fence out _lang _source n_words salt one").split()


@pytest.fixture(scope="module")
def clashing(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 900, 40)) for _ in range(12)]
    rows = [(1, texts[0], "a"), (1, texts[0], "a"), (1, texts[1], "a"), (None, texts[2], "b"), (None, texts[2], "b"), (None, None, None), (3, "", "b"),
            (4, texts[3] + " q1 q2 q3 q4 q5 q6 q7 q8 q9 q10", "a"), (5, texts[3], None), (6, texts[3] + " tail", "a")]
    rows += [(10 + i, t, "ab"[i % 2]) for i, t in enumerate(texts[4:])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.select("*", F.lit("en").alias("lang"), *[F.concat(F.lit(f"{n}:"), F.coalesce("text", F.lit("-"))).alias(n) for n in CLASHING])


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_carry_columns_of_any_name(spark, clashing):
    """Rows come out as they went in, and which ones does not depend on the further columns."""
    items = spark.createDataFrame([(1, "Q1 q2 q3 q4 q5 q6 q7 q8 q9 q10")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (4, 0), (10, 1), (13, 0), (None, 1)], "doc_id long, quality int")
    plain = clashing.select("doc_id", "text", "source", "lang")
    given = rows_of(clashing)
    for stage in (lambda d: classifier.accept(d, labels), jaccard.one_per_group, lambda d: decontaminate.clean(d, items)):
        out = stage(clashing)
        assert out.columns == clashing.columns and not rows_of(out) - given
        assert rows_of(out.select(*plain.columns)) == rows_of(stage(plain))
    assert rows_of(decontaminate.clean(plain, items)) == rows_of(plain.filter("doc_id is null or doc_id <> 4"))
    mixed = mixing.mix(clashing)
    assert mixed.columns == clashing.columns and set(rows_of(mixed)) <= set(given)
    taken = {(r.doc_id, r.text): 0 for r in plain.collect()}
    for r in mixing.mix(clashing).collect():
        taken[r.doc_id, r.text] += 1
        assert all(r[n] == f"{n}:{'-' if r.text is None else r.text}" for n in CLASHING)
    assert sum(taken.values()) == mixing.mix(clashing).count() > 0
    found = decontaminate.contamination(clashing, items)
    assert found.filter("doc_id = 4").first().contamination.n_hit == 10 and found.count() == clashing.count()
    assert rows_of(sharding.shard(clashing)) == rows_of(sharding.shard(plain))
    assert rows_of(quality.judge(clashing)) == rows_of(quality.judge(plain))
    assert rows_of(substrings.report(clashing)) == rows_of(substrings.report(plain))


def test_pipeline_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{ROOT}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_quality_and_shards_of_repeated_and_null_rows(spark, clashing):
    docs = clashing.select("doc_id", "text", "source")
    labels = spark.createDataFrame([(10, 1), (11, 1), (13, 0)], "doc_id long, quality int")
    scored = {r.text: r.score for r in classifier.classify(docs, labels).join(docs.distinct(), "doc_id").collect() if r.doc_id not in (1, None)}
    kept = rows_of(classifier.accept(docs, labels))
    for row, n in rows_of(docs).items():
        if row[1] in scored:
            assert kept[row] == (n if scored[row[1]] >= classifier.CUT else 0)
        assert kept[row] in (0, n)
    shards = sharding.shard(docs).collect()
    assert Counter((r.doc_id, r.text_crc32, r["size"]) for r in shards) == Counter(
        (r.doc_id, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 1) for r in docs.collect())
    assert len({(r.shard, r.slot) for r in shards}) == len(shards)


def test_automata_are_bounded():
    """2 MB of items: two automata at most, each within its nodes, and far below 400 MB."""
    rng = np.random.default_rng(1)
    vocabulary = [f"{x:x}" for x in rng.integers(16**3, 16**7, 40_000)]
    items = [(str(i), " ".join(vocabulary[k] for k in rng.integers(0, 40_000, 90))) for i in range(2900)]
    assert sum(len(t) for _, t in items) > 2_000_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    parts = list(decontaminate.windows(items, 10).parts(decontaminate.MAX_NODES))
    assert sum(len(p.size) for p in parts) == 2900 * 81
    for p in parts:
        assert decontaminate.automaton({"patterns": p}).get_stats()["nodes_count"] <= decontaminate.MAX_NODES + 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000


def test_many_automata_find_what_one_does(spark, monkeypatch):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{ROOT}/benchmark.parquet").unionByName(
        spark.createDataFrame([(900, "the"), (901, "of the"), (902, " ! "), (None, None)], "item_id long, text string"))
    one, kept = rows_of(decontaminate.report(docs, items)), rows_of(decontaminate.clean(docs, items))
    monkeypatch.setattr(decontaminate, "MAX_NODES", 3000)
    assert len(list(decontaminate.automata(items, 10, 1 << 20))) > 2
    assert rows_of(decontaminate.report(docs, items)) == one and rows_of(decontaminate.clean(docs, items)) == kept
    spans = decontaminate.contamination(docs, items).filter("contamination.n_hit > 0").collect()
    words = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    for r in spans[:50]:
        covered = set()
        for s in r.contamination.spans:
            assert len(words.findall(r.text[s.char_start : s.char_end])) == s.word_end - s.word_start
            covered.update(range(s.word_start, s.word_end))
        assert len(covered) == r.contamination.n_hit


def filler(rng, n, symbols=0):
    words = [f"w{k:04d}" for k in rng.integers(0, 5000, n)]
    for k in range(symbols):
        words[k * 3 % n] += "#"
    return " ".join(words)


def test_limits_follow_their_own_source(spark):
    """Symbols rise in one source: its limit rises with them, others' hardly move."""
    rng = np.random.default_rng(9)
    base = [(i, filler(rng, 60, int(rng.integers(0, 3))), "en", f"s{i % 4}") for i in range(4000)]
    moved = [(i, filler(rng, 60, 20 + int(rng.integers(0, 8))), lang, src) if src == "s1" else (i, t, lang, src) for i, t, lang, src in base]
    limit = []
    for rows in (base, moved):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        counts = quality.text_counts(docs)
        limit.append({r._source: r.fence["symbols"].high for r in quality.fences(counts).collect()})
        if rows is moved:
            kept = quality.judge(docs).filter("kept").count()
            assert kept > 0.95 * len(rows)
            assert {r.measure: r.n for r in quality.rejections(docs).collect()}.keys() == quality.MEASURES.keys()
    before, after = limit
    assert after["s1"] > before["s1"] + 50
    assert all(abs(after[s] - before[s]) < 0.25 * (after["s1"] - before["s1"]) for s in ("s0", "s2", "s3"))


def test_limits_have_no_step_in_size(spark):
    """A source of few rows takes most of its limit from its language, and less with every row."""
    rng = np.random.default_rng(5)
    calm = [(i, filler(rng, 60), "en", "calm") for i in range(800)]
    limits = []
    for n in (1, 20, 49, 50, 51, 200):
        loud = [(10_000 + i, filler(rng, 60, 15), "en", "loud") for i in range(n)]
        docs = spark.createDataFrame(calm + loud, "doc_id long, text string, lang string, source string")
        limits.append({r._source: r.fence["symbols"].high for r in quality.fences(quality.text_counts(docs)).collect()}["loud"])
    assert limits == sorted(limits) and limits[-1] > 3 * limits[0]
    assert max(limits[3] - limits[2], limits[4] - limits[3]) < 0.05 * limits[-1]


def test_template_texts_do_not_meet_in_pairs(spark):
    """Texts that share all but one word, and are not similar enough: none linked, no n squared."""
    took = []
    for n in (4000, 16_000):
        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("the page that you asked for was not found "), F.col("id")).alias("text"))
        start = time.perf_counter()
        assert jaccard.similarity_groups(docs).filter("doc_id <> component_id").count() == 0
        took.append(time.perf_counter() - start)
    assert took[1] < 3 * took[0] + 10


def test_hot_passages_are_dealt_out(spark):
    """One passage in a third of the texts: removed from all of them, also from the only one with its own edges."""
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(60)]
    own = lambda: [f"u{x}" for x in rng.integers(0, 10**9, 30)]
    docs = {i: own() + (passage if i % 3 == 0 else []) + own() for i in range(900)}
    docs[900] = own() + passage[:40]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substrings.report(df).collect()}
    assert got == {i: 60 if i < 900 and i % 3 == 0 else 40 if i == 900 else 0 for i in docs}


def test_records_are_valid(spark):
    """Every record parses by the rules of WARC 1.1; ids are unique, references lead to responses."""
    pages = spark.createDataFrame([(3, "http://u3", "same"), (1, "http://u1", "same"), (2, None, None), (None, "http://u4", ""), (None, "http://u4", ""),
                                   (1, "http://u1", "same"), (9, "http://u9", "é" * 5)], "page_id long, url string, html string")
    path = new_path(spark, "warc-valid")
    warc.write_archive(pages, path)
    records = {}
    for r in warc.read_archive(spark, path).collect():
        head, body = bytes(r.record).split(b"\r\n\r\n", 1)
        version, *lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines)
        assert version == "WARC/1.1" and len(fields) == len(lines)
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= fields.keys()
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"])
        name = re.fullmatch(r"<urn:uuid:([0-9a-f-]{36})>", fields["WARC-Record-ID"])[1]
        assert uuid.UUID(name).version == 3 and uuid.UUID(name).variant == uuid.RFC_4122
        assert body.endswith(b"\r\n\r\n") and len(body) - 4 == int(fields["Content-Length"])
        status, rest = body[:-4].split(b"\r\n", 1)
        assert status == b"HTTP/1.1 200 OK" and b"\r\n\r\n" in rest
        records[fields["WARC-Record-ID"]] = fields
    assert len(records) == 7
    for fields in records.values():
        if fields["WARC-Type"] == "revisit":
            target = records[fields["WARC-Refers-To"]]
            assert target["WARC-Type"] == "response" and target["WARC-Payload-Digest"] == fields["WARC-Payload-Digest"]
            assert fields["WARC-Profile"] == warc.PROFILE


def test_classifier_equals_plain_arithmetic(spark):
    """Scores of every document against means, covariances and densities worked out in the open."""
    from kbspark.llm import queries

    root = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{root}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    plain = {d: plain_statistics(t) for d, t in docs.items()}
    x = {q: np.array([plain[d] for d, k in labels.items() if k == q and d in plain]) for q in (0, 1)}
    every = np.concatenate([x[0], x[1]])
    cov = lambda m: ((m - m.mean(0)).T @ (m - m.mean(0))) / len(m)
    width = every.shape[1]
    log = {}
    for q in (0, 1):
        s = 0.88 * cov(x[q]) + 0.1 * cov(every) + 0.02 * np.trace(cov(every)) / width * np.eye(width)
        inverse, (_, logdet), mean = np.linalg.inv(s), np.linalg.slogdet(s), x[q].mean(0)
        log[q] = {d: -0.5 * (v - mean) @ inverse @ (v - mean) - 0.5 * logdet for d, v in plain.items()}
    odds = np.log((len(x[1]) + 1) / (len(x[0]) + 1))
    got = {r.doc_id: r.score for r in queries.QUERIES["op7_classifier"](spark, root).collect()}
    for d in docs:
        want = 1 / (1 + np.exp(-np.clip(log[1][d] - log[0][d] + odds, -30, 30)))
        assert got[d] == pytest.approx(want, abs=1e-6)


def plain_statistics(text):
    """The statistics of one text, character by character."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, size = len(words), sum(map(len, words))
    some, inner = max(n, 1), max(size, 1)
    among = lambda chars: sum(text.count(c) for c in chars)
    ascii_rest = sum(1 for c in text if ord(c) < 128 and not c.isspace() and not c.isalnum() and c not in "#*$%&|<>!?.," and ord(c) > 0x20) + sum(
        1 for c in text if ord(c) < 128 and not c.isalnum() and c not in "\t\n\x0b\x0c\r " and ord(c) < 0x20)
    caps, digits = sum("A" <= c <= "Z" for c in text), sum("0" <= c <= "9" for c in text)
    log = np.log
    return np.array([
        log(1 + n), log(1 + inner / some), log(0.005 + among("#*$%&|<>") / inner), log(0.02 + caps / inner), log(0.01 + digits / inner),
        log(0.005 + among("!?") / inner), log(0.02 + among(".,") / some), log(0.01 + ascii_rest / inner), log(1 + some / (1 + text.count("\n"))),
        log(0.05 + len(set(words)) / some**0.85), log(0.01 + sum(a == b for a, b in zip(words, words[1:])) / some),
        log(0.05 + sum("A" <= w[0] <= "Z" for w in words) / some)])


def test_odd_conversations(spark):
    """Null role, text, turn and conv_id, repeated turns, a given conversation -1, clashing columns."""
    import hashlib

    from kbspark.llm import chat

    given = [(1, 0, None, "x"), (1, 0, None, "x"), (1, None, "assistant", None), (1, 2, "assistant", "<|im_end|>"), (None, 0, "user", "a"),
             (None, 1, "assistant", "b"), (-1, 5, "assistant", "given"), (3, 0, "user", "long " * 20_000)]
    df = spark.createDataFrame([(*r, "z", "z", "z") for r in given],
                               "conv_id long, turn long, role string, text string, record string, loss string, turns string")
    got = {r.conv_id: r for r in chat.formatted_conversations(df).collect()}
    talks = {}
    for c, t, role, text in given + [(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]:
        talks.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == talks.keys()
    for c, turns in talks.items():
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in sorted(turns))
        loss = "".join(text for _, _, role, text in sorted(turns) if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
