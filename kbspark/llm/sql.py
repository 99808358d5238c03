"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

OP1 = f"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body) AS payload_bytes, body,
    array_to_string([substr('{BASE32}', 1 +
      ('0b' || substr(CAST(CAST(unhex(sha1(body)) AS BIT) AS VARCHAR), CAST(5 * i + 1 AS BIGINT), 5))::INT, 1)
      for i in range(32)], '') AS payload_digest
  FROM p
), f AS (SELECT payload_digest AS k, min(page_id) AS first_id FROM d GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d JOIN f ON d.payload_digest = f.k
"""

N_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP5 = f"""
WITH d AS (SELECT doc_id, source, CAST({N_WORDS} AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source
), l AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER before, 0))
      / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM s WINDOW before AS (ORDER BY source_size * 2.0::DOUBLE / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, coalesce(
    max(CASE WHEN level * w < cap THEN level END) OVER () * w, cap)) AS target FROM l
), r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END AS rate,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""

CRC_TABLE = """
  SELECT list(c ORDER BY i) AS t FROM (
    WITH RECURSIVE r(i, step, c) AS (
      SELECT range, 0, range FROM range(256)
      UNION ALL
      SELECT i, step + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM r WHERE step < 8
    ) SELECT i, c FROM r WHERE step = 8)
"""

OP8 = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}), j(k, n, state, shard, nxt) AS (
  SELECT k, n, (k::HUGEINT + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT, -1::BIGINT, 0::BIGINT
  FROM (SELECT DISTINCT coalesce(doc_id, 0) AS k FROM documents), (VALUES (16), (17)) v(n)
  UNION ALL
  SELECT k, n, s, nxt, floor((nxt + 1)::DOUBLE * (2147483648.0::DOUBLE / ((s // 8589934592::HUGEINT)::DOUBLE + 1)))::BIGINT
  FROM (SELECT *, (state * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS s FROM j) WHERE nxt < n
), d AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
      [('0x' || x)::BIGINT for x in regexp_extract_all(hex(encode(coalesce(text, ''))), '..')]),
      lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1]))) AS text_crc32
  FROM documents, crc
), r AS (
  SELECT d.*, a.shard, b.shard AS grown, substr(md5(CAST(coalesce(doc_id, 0) AS VARCHAR)), 1, 3) AS slice
  FROM d JOIN j a ON a.k = coalesce(doc_id, 0) AND a.n = 16 AND a.nxt >= 16
  JOIN j b ON b.k = coalesce(doc_id, 0) AND b.n = 17 AND b.nxt >= 17
)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY slice, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  CAST(grown AS INT) AS grown_shard
FROM r
"""

OP9 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g') AS safe FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(safe) + length(replace(replace(role, '%', '%25'), chr(10), '%0A')) + length('<|im_start|>') + 1
    + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

# Measure, value, value without one event.
_RATIOS = (
    ("symbols", "1000 * n_symbols // greatest(word_chars, 1)", "1000 * greatest(n_symbols - 1, 0) // greatest(word_chars, 1)"),
    ("capitals", "1000 * n_capitals // greatest(word_chars, 1)", "1000 * greatest(n_capitals - 1, 0) // greatest(word_chars, 1)"),
    ("dup_lines", "1000 * n_dup_lines // greatest(n_lines, 1)", "1000 * greatest(n_dup_lines - 1, 0) // greatest(n_lines, 1)"),
    ("repeats", "1000 * n_repeat_words // greatest(n_words, 1)", "1000 * greatest(n_repeat_words - 10, 0) // greatest(n_words, 1)"),
    ("word_length", "100 * word_chars // greatest(n_words, 1)", "100 * word_chars // greatest(n_words, 1)"),
)


def _least(b: str) -> str:
    """Least number in a bucket."""
    return f"CASE WHEN {b} < 16 THEN {b} ELSE ({b} % 16 + 16) << CAST({b} // 16 - 1 AS BIGINT) END"


OP2 = rf"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lines AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d
), l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1
), p AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5
), r AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i + 4]) AS n FROM p
), c AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM r WHERE n > 1) GROUP BY 1
), s AS (
  SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(regexp_extract_all(t, '[A-Z]')) AS BIGINT) AS n_capitals,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s
), m AS (
  {" UNION ALL ".join(f"SELECT doc_id, lang, source, base_failed, '{m}' AS measure, CAST({e} AS BIGINT) AS v, CAST({x} AS BIGINT) AS x FROM b" for m, e, x in _RATIOS)}
), k AS (
  SELECT *, CASE WHEN v < 16 THEN v ELSE (length(bin(v)) - 4) * 16 + (v >> (length(bin(v)) - 5)) - 16 END AS bucket FROM m
), g AS (
  SELECT 0 AS level, lang, source, measure, bucket FROM k WHERE NOT base_failed
  UNION ALL SELECT 1, lang, NULL, measure, bucket FROM k WHERE NOT base_failed
  UNION ALL SELECT 2, NULL, NULL, measure, bucket FROM k WHERE NOT base_failed
), o AS (
  SELECT level, lang, source, measure, bucket, count(*) AS few FROM g GROUP BY 1, 2, 3, 4, 5
), h AS (
  SELECT *, sum(few) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS c,
    sum(few) OVER (PARTITION BY level, lang, source, measure) AS many FROM o
), q AS (
  SELECT level, lang, source, measure, max(many)::DOUBLE AS n, min(CASE WHEN 10 * c >= many THEN bucket END) AS b1,
    min(CASE WHEN 10 * c >= 5 * many THEN bucket END) AS b5, min(CASE WHEN 10 * c >= 9 * many THEN bucket END) AS b9 FROM h GROUP BY 1, 2, 3, 4
), f AS (
  SELECT level, lang, source, measure, n, {_least("b1")} AS lo, {_least("b5")} AS mid, {_least("(b5 + 1)")} - 1 AS mid_top, {_least("(b9 + 1)")} - 1 AS hi FROM q
), e AS (
  SELECT *, CASE WHEN measure = 'word_length' THEN lo - 3 * (mid_top - lo) ELSE 0 END::DOUBLE AS low, (hi + 3 * (hi - mid))::DOUBLE AS high FROM f
), v AS (
  SELECT k.doc_id, bool_and(k.x BETWEEN
      (own.n * own.low + 50::DOUBLE * ((up.n * up.low + 50::DOUBLE * whole.low) / (up.n + 50::DOUBLE))) / (own.n + 50::DOUBLE)
    AND (own.n * own.high + 50::DOUBLE * ((up.n * up.high + 50::DOUBLE * whole.high) / (up.n + 50::DOUBLE))) / (own.n + 50::DOUBLE)) AS held
  FROM k JOIN e own ON own.level = 0 AND own.measure = k.measure AND own.lang IS NOT DISTINCT FROM k.lang AND own.source IS NOT DISTINCT FROM k.source
  JOIN e up ON up.level = 1 AND up.measure = k.measure AND up.lang IS NOT DISTINCT FROM k.lang
  JOIN e whole ON whole.level = 2 AND whole.measure = k.measure GROUP BY 1
)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(held, false) AS kept
FROM b LEFT JOIN v USING (doc_id)
"""


# Kind, expression, group that is measured, least characters of it, in the base.
_SECRETS = (
    ("assign", r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
     r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    ("access", "AKIA[A-Z0-9]+", 0, 16, True),
    ("hex", "[0-9a-f]+", 0, 32, True),
    ("github", "gh[pousr]_[A-Za-z0-9]{36}", 0, 0, False),
    ("google", "AIza[A-Za-z0-9_-]{35}", 0, 0, False),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0, False),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, False),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, False),
)


def _secret_spans(number: int) -> str:
    kind, pattern, group, least, base = _SECRETS[number]
    return f"""
  SELECT doc_id, {number} AS number, '{kind}' AS kind, {str(base).lower()} AS base,
    unnest([CAST(list_sum([length(x) for x in gap[1:i]]) + coalesce(list_sum([length(x) for x in found[1:i - 1]]), 0) AS BIGINT)
      for i in range(1, len(found) + 1)]) AS begins,
    unnest([length(x) for x in found]) AS size, unnest([length(x) for x in part]) AS part
  FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '{pattern}') AS gap,
    regexp_extract_all(coalesce(text, ''), '{pattern}') AS found,
    regexp_extract_all(coalesce(text, ''), '{pattern}', {group}) AS part FROM documents)"""


_CHECKED = " OR ".join(f"(number = {i} AND part >= {r[3]})" for i, r in enumerate(_SECRETS))
_N = ", ".join(f"count(*) FILTER (kind = '{r[0]}') AS n_{r[0]}" for r in _SECRETS if r[4])
_SHOWN = "kind || ':' || begins || ':' || (begins + size)"

OP3 = f"""
WITH s AS ({" UNION ALL ".join(_secret_spans(i) for i in range(len(_SECRETS)))}
), r AS (SELECT * FROM s WHERE {_CHECKED})
SELECT documents.doc_id, {_N},
  sha256(coalesce(string_agg({_SHOWN}, ',' ORDER BY begins, number) FILTER (base), '')) AS base_sha256,
  coalesce(string_agg({_SHOWN}, ',' ORDER BY begins, number), '') AS spans
FROM documents LEFT JOIN r ON r.doc_id = documents.doc_id GROUP BY documents.doc_id
"""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10 = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS w FROM benchmark),
n AS (SELECT item, w, least(10, len(w)) AS size FROM i WHERE len(w) > 0),
p AS (
  SELECT DISTINCT item, size, array_to_string(w[k:k + size - 1], ' ') AS pattern
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS k FROM n)
), d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
x AS (
  SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM p) WHERE len(w) >= size
), h AS (
  SELECT doc_id, k, p.size, item FROM x JOIN p ON p.size = x.size AND p.pattern = array_to_string(w[k:k + x.size - 1], ' ')
), c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(k, k + size)) AS j FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP11 = f"""
WITH RECURSIVE crc AS MATERIALIZED ({CRC_TABLE}), d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS w FROM documents
), b AS (SELECT {_ALNUM} AS w FROM benchmark),
fd AS MATERIALIZED (
  SELECT r, f, count(*) AS n FROM (
    SELECT r, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS f FROM d) GROUP BY 1, 2
), fb AS MATERIALIZED (
  SELECT f, count(*) AS n FROM (SELECT unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS f FROM b) GROUP BY 1
), k AS MATERIALIZED (
  SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
      [('0x' || x)::BIGINT for x in regexp_extract_all(hex(encode(f)), '..')]),
      lambda c, y: xor(c >> 8, t[CAST(xor(c, y) & 255 AS BIGINT) + 1]))) % 10000 AS bucket
  FROM (SELECT f FROM fd UNION SELECT f FROM fb), crc
), s AS (SELECT bucket, sum(n) AS n FROM fd JOIN k USING (f) GROUP BY 1),
t AS (SELECT bucket, sum(n) AS n FROM fb JOIN k USING (f) GROUP BY 1),
g AS (
  SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE
    / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t ON s.bucket = t.bucket
), m AS (
  SELECT r, CAST(sum(fd.n) AS BIGINT) AS n_features, CAST(sum(fd.n * gain) AS BIGINT) AS total
  FROM fd JOIN k USING (f) JOIN g USING (bucket) GROUP BY 1
), x AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
    coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
    CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN m USING (r)
), y AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM x
), z AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS i,
    count(*) FILTER (n_words >= 20) OVER () AS n FROM y
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND i <= 25 * n // 100 THEN i END AS rank FROM z
"""


def _near(number: int) -> str:
    """Assignment of every vector to the centroids of one round."""
    return f"""a{number} AS MATERIALIZED (
  SELECT r, min(struct_pack(d := CAST(list_sum([(q[i] - c[i]) * (q[i] - c[i]) for i in range(1, 65)]) AS BIGINT), cluster := cluster)) AS m
  FROM v, c{number} GROUP BY r
)"""


def _means(number: int) -> str:
    """Centroids of the round after: exact floored means, empty clusters as they were."""
    return f"""n{number} AS (
  SELECT m.cluster AS cluster, i, sum(q[i]) AS s, count(*) AS n FROM v JOIN a{number} USING (r), range(1, 65) x(i) GROUP BY 1, 2
), c{number + 1} AS MATERIALIZED (
  SELECT o.cluster, coalesce(n.c, o.c) AS c FROM c{number} o LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM n{number} GROUP BY 1) n ON n.cluster = o.cluster
)"""


OP12 = f"""
WITH k AS (
  SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(64 * x::DOUBLE) AS BIGINT) for x in embedding] AS q FROM k
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, q) - 1 AS cluster, q AS c FROM (
    SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, q FROM v) ORDER BY h, q LIMIT 16
), {", ".join(f"{_near(n)}, {_means(n)}" for n in range(3))}, {_near(3)},
f AS (SELECT vec_id, CAST(m.cluster AS INT) AS cluster, m.d AS distance FROM v JOIN a3 USING (r))
SELECT vec_id, f.cluster, distance, CAST(sum(distance) OVER (PARTITION BY f.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM f JOIN c3 ON c3.cluster = f.cluster
"""

ORACLES = {
    "op1_warc": OP1, "op2_quality": OP2, "op3_secrets": OP3, "op5_mixing": OP5, "op8_sharding": OP8, "op9_chat": OP9,
    "op10_decontamination": OP10, "op11_importance": OP11, "op12_clusters": OP12,
}
