"""Importance resampling, centroid clustering and language identification against brute force."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kbspark.llm import clusters, importance, language, queries
from kbspark.llm.tokens import pieces

ROOT = os.environ.get("KBSPARK_TEST_DIR", "/root/testdata/sf0.001")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text):
    w = ALNUM.findall((text or "").translate(LOWER))
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])], len(w)


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def brute_resample(docs, target):
    """Rows of (doc_id, n_features, weight, score, rank) as a multiset, and the draw in order."""
    found = [(d, *runs(t)) for d, t in docs]
    s, t = Counter(bucket(f) for _, fs, _ in found for f in fs), Counter(bucket(f) for x in target for f in runs(x)[0])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    rows = []
    for d, fs, n in found:
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = [(*r[:4], i) for i, r in enumerate(able[: 25 * len(able) // 100], 1)]
    rest = Counter(r[:4] for r in rows)
    rest.subtract(r[:4] for r in drawn)
    return drawn, Counter({r: n for r, n in rest.items() if n})


def check_resample(got, docs, target):
    drawn, rest = brute_resample(docs, target)
    assert sorted((tuple(r) for r in got if r.rank is not None), key=lambda r: r[4]) == drawn
    assert Counter(tuple(r)[:4] for r in got if r.rank is None) == rest


def test_checksums_of_features():
    texts = ["Ab cD é 9", "", None, "x" * 200 + " y " + "z" * 65 + "ß" * 40 + " q", "one", "! ?"]
    (piece,) = pieces(pa.array(texts))
    row, found, words = importance.features(piece)
    got = Counter(zip(row.tolist(), found.tolist()))
    assert got == Counter((i, bucket(f)) for i, t in enumerate(texts) for f in runs(t)[0])
    assert words.counts.tolist() == [runs(t)[1] for t in texts]


def test_planes_give_exact_sums():
    rng = np.random.default_rng(4)
    gain = rng.integers(-9000, 12_000, importance.BUCKETS)
    row = np.sort(rng.integers(0, 40, 60_000))
    hit = np.where(rng.random(len(row)) < 0.3, 17, rng.integers(0, importance.BUCKETS, len(row)))
    keep = row != 5  # a row without features
    row, hit = row[keep], hit[keep]
    want = np.bincount(row, weights=gain[hit], minlength=40).astype(np.int64)
    for at_once in (1, 7, 512):
        assert (importance.plane_sums(row, hit, 40, importance.gain_planes(gain), at_once) == want).all()
    for flat in (np.zeros(importance.BUCKETS, np.int64), np.full(importance.BUCKETS, -1), np.full(importance.BUCKETS, 8)):
        assert (importance.plane_sums(row, hit, 40, importance.gain_planes(flat)) == np.bincount(row, minlength=40) * flat[0]).all()


def test_resampling_of_odd_rows(spark):
    """Null, empty and very long texts, null and repeated ids, equal scores, clashing columns."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    words = [f"t{i}" for i in range(25)]
    docs = [(None, None), (1, ""), (2, long), (3, " ".join(words)), (None, " ".join(words[:22])), (4, "a b")]
    docs += [(None, " ".join(words))] * 30 + [(7, " ".join(words[::-1]))] * 5 + [(100 + i, " ".join(words[i % 3 :] + ["é" * i])) for i in range(40)]
    df = spark.createDataFrame([(d, t, 0, 0, 0, True, 1) for d, t in docs],
                               "doc_id long, text string, score int, rank int, weight int, eligible boolean, _part int").repartition(5)
    target = ["t1 t2 t3 é", None, ""]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    check_resample(importance.resample(df, bench).collect(), docs, target)
    check_resample(importance.resample(df, bench.limit(0)).collect(), docs, [])
    assert importance.resample(df.limit(0), bench).count() == 0
    assert importance.resample(df.filter("doc_id = 4"), bench).collect()[0]["rank"] is None


def test_resampling_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()]
    check_resample(queries.QUERIES["op11_importance"](spark, ROOT).collect(), docs, target)


def brute_lloyd(vectors, k, rounds):
    """Multiset of (vec_id, cluster, distance, inertia of it, inertia, digest of its centroid)."""
    def fine(x):
        return x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x)

    kept = [(i, [math.floor(max(-2.0**27, min(2.0**27, 64 * v))) for v in x], x) for i, x in vectors if fine(x)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    cents = [q for _, q, _ in sorted(kept, key=lambda r: (name(r[0]), r[2]))[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, q, _ in kept:
            groups[near(q)[1]].append(q)
        cents = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else c for j, c in enumerate(cents)]
    found = [(i, *near(q)[::-1]) for i, q, _ in kept]
    own, total = Counter(), sum(d for _, _, d in found)
    for _, j, d in found:
        own[j] += d
    long = lambda v: v if v < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return Counter((i, j, d, long(own[j]), long(total), digest[j]) for i, j, d in found)


VECTORS = "vec_id long, embedding array<double>, cluster int, n int, block int, chunk long"


@pytest.mark.parametrize(("k", "width", "rows"), [(16, 16, 256), (3, 25, 4), (40, 64, 1)])
def test_clusters_of_odd_vectors(spark, k, width, rows):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=64).round(2).tolist()) for i in range(24)]
    vectors += [(30, vectors[0][1])] * 7 + [(None, vectors[1][1]), (30, vectors[2][1]), (31, [0.0] * 64), (32, [-0.0] * 64)]
    vectors += [(40, None), (41, []), (42, [1.0] * 63), (43, [1.0] * 65), (44, [float("nan")] + [0.0] * 63),
                (45, [float("-inf")] + [0.0] * 63), (46, [None] + [0.0] * 63), (47, [3e5, -3e5] * 32)]
    df = spark.createDataFrame([(*v, 9, 9, 9, 9) for v in vectors], VECTORS).repartition(3)
    got = clusters.cluster(df, k=k, width=width, rows=rows).collect()
    assert Counter(tuple(r) for r in got) == brute_lloyd(vectors, k, 3)


def test_clusters_of_large_values_and_of_nothing(spark):
    huge = [(1, [1e300] * 64), (2, [-1e300] * 64), (3, [1.7e308, -1.7e308] * 32), (4, [0.0] * 64)]
    df = spark.createDataFrame([(*v, 9, 9, 9, 9) for v in huge], VECTORS)
    got = clusters.cluster(df, k=2).collect()
    assert Counter(tuple(r) for r in got) == brute_lloyd(huge, 2, 3)
    assert clusters.cluster(df.limit(0)).count() == 0
    assert clusters.cluster(df.withColumn("embedding", F.lit(None).cast("array<float>"))).count() == 0


def test_clusters_of_the_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{ROOT}/embeddings.parquet").collect()]
    assert Counter(tuple(r) for r in queries.QUERIES["op12_clusters"](spark, ROOT).collect()) == brute_lloyd(rows, 16, 3)


LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\xBF -‿　-〿]+")


def held(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5 == 0


def brute_languages(docs, per_language=2000, longest=4):
    """(lang_pred, score) of every (doc_id, text, lang), with a model of plain strings."""
    rows = [r for r in docs if r[1] is not None and r[2] is not None and not held(r[0])]
    size, drawn = Counter(r[2] for r in rows), {}
    for d, t, l in rows:
        u = int(hashlib.sha256(f"language:{d}".encode()).hexdigest()[:8], 16) / 4294967296
        if u < per_language / size[l]:
            drawn[d, l] = min(t, drawn.get((d, l), t), key=lambda x: x.encode())
    names = sorted({l for _, l in drawn})
    counts = [defaultdict(Counter) for _ in range(longest + 1)]
    cut = lambda w, n: [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]
    for (_, l), t in drawn.items():
        for w in LETTERS.findall(t.lower()):
            counts[0][w][l] += 1
            for n in range(1, longest + 1):
                for g in cut(w, n):
                    counts[n][g][l] += 1
    total = [{l: sum(c[l] for c in o.values()) + 0.5 * len(o) for l in names} for o in counts]
    logs = lambda n, key: [math.log((counts[n][key][l] + 0.5) / total[n][l]) for l in names]

    def word(w):
        if w in counts[0]:
            return logs(0, w)
        for n in range(longest, 0, -1):
            known = [g for g in cut(w, n) if g in counts[n]]
            if known:
                return [sum(x) / len(known) for x in zip(*(logs(n, g) for g in known))]
        return [0.0] * len(names)

    out = []
    for _, t, _ in docs:
        if not names or not any(c.isalpha() for c in t or ""):
            out.append(("und", 0.0))
            continue
        sums = np.array([word(w) for w in LETTERS.findall(t.lower())] or [[0.0] * len(names)]).sum(axis=0)
        best = int(np.argmax(np.round(sums, 9)))
        out.append((names[best], float(1 / np.exp(sums - sums[best]).sum())))
    return out


def check_languages(docs, got):
    want = defaultdict(list)
    for (d, t, _), found in zip(docs, brute_languages(docs)):
        want[d].append(found)
    have = defaultdict(list)
    for r in got:
        assert r.held_out == held(r.doc_id) and 0 <= r.score <= 1
        have[r.doc_id].append((r.lang_pred, r.score))
    assert want.keys() == have.keys()
    for d in want:
        assert [x for x, _ in sorted(want[d])] == [x for x, _ in sorted(have[d])]
        assert np.allclose([s for _, s in sorted(want[d])], [s for _, s in sorted(have[d])], atol=2e-4)


def test_languages_of_the_whole_table(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()]
    check_languages(docs, queries.QUERIES["op13_language"](spark, ROOT).collect())


def test_languages_on_held_out_documents(spark):
    root = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op13_language"](spark, root).join(spark.read.parquet(f"{root}/documents.parquet"), "doc_id").filter(
        "held_out and lang is not null").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98


def test_languages_of_odd_rows(spark):
    docs = [(i, f"the cat{i % 3} and the dog sat", "en") for i in range(30)] + [(i, f"der hund{i % 3} und die katze saß", "de") for i in range(30, 60)]
    docs += [(100, None, "en"), (101, "", None), (102, " 12 – 34 … « 5 »", "en"), (103, "the " * 9000, None), (104, "KATZE", None),
             (105, "hunde katzen", None), (106, "ЖЖЖ", None), (107, "xdx", None), (None, "der hund", "de"), (None, None, None),
             (2, "the cat and the dog", "de"), (2, "the cat and the dog", "de"), (108, "ª", None), (109, "sa t—da", None)]
    df = spark.createDataFrame([(*r, "x", 0.5, False) for r in docs],
                               "doc_id long, text string, lang string, lang_pred string, score double, letters boolean").repartition(4)
    got = language.identify(df).collect()
    check_languages(docs, got)
    by = {r.doc_id: r for r in got}
    assert by[104].lang_pred == by[105].lang_pred == "de" and by[102].lang_pred == "und" and by[102].score == 0
    assert language.identify(df.limit(0)).count() == 0
    blank = language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in blank} == {("und", 0.0)} and len(blank) == len(docs)


def test_a_bounded_model_keeps_the_most_frequent_entries(spark):
    docs = [(i, f"the word{i} sat", "en") for i in range(40)] + [(i, f"der wort{i} saß", "de") for i in range(40, 80)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    whole, small = language.fit(df), language.fit(df, max_entries=30)
    assert sum(len(o.lang) for o in small.orders) == 30 < sum(len(o.lang) for o in whole.orders)
    assert small.langs == ["de", "en"]
    few = language.sample(df, per_language=5).groupBy("lang").count().collect()
    assert all(r["count"] <= 15 for r in few)
