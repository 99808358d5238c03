"""SQL fragments shared by the check queries: the adapters and the search steps."""

TRIMMED = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"

SOURCES = f"""
src AS (
  SELECT d.doc_id AS source_id, 'text' AS type, 'manual' AS platform,
         'txt_' || substr(sha256({TRIMMED}), 1, 16) AS video_id,
         substr(trim(split_part({TRIMMED}, chr(10), 1)), 1, 80) AS title,
         CASE WHEN l.quality = 1 THEN 'ready' WHEN l.quality = 0 THEN 'failed' ELSE 'enriched' END AS status,
         CASE WHEN l.quality IS NULL THEN substr(trim(split_part({TRIMMED}, chr(10), 1)), 1, 120) END AS summary,
         TIMESTAMP '2024-01-01' + to_hours(CAST(d.doc_id % 720 AS BIGINT)) AS ingested_at,
         CASE WHEN d.source <> 'src0' THEN CAST(substr(d.source, 4) AS BIGINT) END AS collection_id,
         d.text
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""

JOBS = """
ev AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
jobs AS (
  SELECT event_id AS job_id,
         CASE user_id % 4 WHEN 0 THEN 'ingest_text' WHEN 1 THEN 'ingest_podcast' WHEN 2 THEN 'summarize' ELSE 'ingest' END AS kind,
         CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'done'
              WHEN 'signup' THEN 'duplicate' ELSE 'failed' END AS status,
         CASE WHEN event_type = 'error' THEN 'HTTP error ' || CAST(400 + k AS VARCHAR) || ': gone wrong' END AS error,
         props AS payload, k % 4 AS retries, 3 AS max_retries,
         CASE WHEN k >= 20 THEN user_id END AS source_id
  FROM ev
)"""

NOTES = f"""
notes AS (
  SELECT d.doc_id AS note_id, substr(trim(split_part({TRIMMED}, chr(10), 1)), 1, 60) AS title, d.text AS content,
         d.lang AS application, CASE WHEN l.quality = 1 THEN 'kept' WHEN l.quality = 0 THEN 'dropped' ELSE 'candidate' END AS status,
         ['skill', 'rule', 'project', 'money', 'insight'][CAST(d.doc_id % 5 AS INT) + 1] AS kind
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""

# Error category of a column named error, by the ordered rules.
CATEGORY = """CASE
  WHEN regexp_matches(error, '疑似登入牆|無法從此網頁擷取正文內容|正文僅') THEN 'login_wall'
  WHEN regexp_matches(error, '(?i)login|cookie|authenticate|rate-?limit reached.*instagram|requested content is not available') THEN 'ig_cookie_expired'
  WHEN regexp_matches(error, '(?i)rate.?limit|429|quota|too many requests') THEN 'provider_quota'
  WHEN regexp_matches(error, '(?i)billing|credit balance|payment|insufficient.*(funds|credit)|purchase') THEN 'llm_billing'
  WHEN regexp_matches(error, '(?i)video unavailable|is private|no longer available|has been (removed|deleted)|account.*terminated|video.*not exist|http (error )?\\s*4(04|10)\\b|\\b4(04|10) (not found|gone)\\b') THEN 'content_gone'
  WHEN regexp_matches(error, '(?i)duration.*>.*limit|too_long|duration_check') THEN 'too_long'
  WHEN regexp_matches(error, '(?i)timed? ?out|connection|network|dns|unreachable|refused') THEN 'network'
  WHEN regexp_matches(error, '(?i)unable to extract|unsupported url|extractor|signature|403: forbidden|http error 403') THEN 'extractor_broken'
  ELSE 'unknown' END"""


def chars(name: str, query: str, id_col: str) -> str:
    """CTE of characters (id, p, c) of ``query`` = SELECT id, t."""
    return f"""{name} AS (
  SELECT {id_col}, CAST(p AS BIGINT) AS p, c FROM (
    SELECT {id_col}, unnest(cs) AS c, unnest(range(1, len(cs) + 1)) AS p
    FROM (SELECT {id_col}, string_split(t, '') AS cs FROM ({query}))))"""


def bm25(texts: str, terms: str = "SELECT item_id AS query_id, text AS q FROM benchmark", allowed: str = "true") -> str:
    """CTEs ending in ``scored`` (query_id, chunk_id, score); ``texts`` gives chunk_id, t, n_grams."""
    return f"""
texts AS ({texts}),
{chars('ch', "SELECT chunk_id, lower(t) AS t FROM texts", 'chunk_id')},
g3 AS (SELECT chunk_id, p, c || coalesce(lead(c) OVER w, '') || coalesce(lead(c, 2) OVER w, '') AS g
       FROM ch WINDOW w AS (PARTITION BY chunk_id ORDER BY p)),
win AS (SELECT chunk_id, p, g, g || coalesce(lead(g, 3) OVER w, '') || coalesce(lead(g, 6) OVER w, '')
        || coalesce(lead(g, 9) OVER w, '') || coalesce(lead(g, 12) OVER w, '') || coalesce(lead(g, 15) OVER w, '')
        || coalesce(lead(g, 18) OVER w, '') || coalesce(lead(g, 21) OVER w, '') || coalesce(lead(g, 24) OVER w, '')
        || coalesce(lead(g, 27) OVER w, '') || coalesce(lead(g, 30) OVER w, '') || coalesce(lead(g, 33) OVER w, '') AS s
        FROM g3 WINDOW w AS (PARTITION BY chunk_id ORDER BY p)),
terms AS (SELECT DISTINCT query_id, term, lower(term) AS needle FROM (
  SELECT query_id, unnest(regexp_extract_all(q, '[A-Za-z0-9]{{2,}}|[一-鿿]{{3,}}')) AS term FROM ({terms}))
  WHERE length(term) >= 3),
needles AS (SELECT DISTINCT needle, left(needle, 3) AS g FROM terms),
occ AS (SELECT w.chunk_id, n.needle, count(*) AS tf FROM win w JOIN needles n ON w.g = n.g
        WHERE left(w.s, length(n.needle)) = n.needle GROUP BY 1, 2),
stat AS (SELECT count(*) AS n_docs, avg(CAST(n_grams AS DOUBLE)) AS avg_len FROM texts),
idf AS (SELECT needle, greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) AS idf
        FROM (SELECT needle, count(*) AS df FROM occ GROUP BY needle), stat),
scored AS (SELECT t.query_id, o.chunk_id,
             round(sum(i.idf * o.tf * 2.2 / (o.tf + 1.2 * (0.25 + 0.75 * x.n_grams / s.avg_len))), 9) AS score
           FROM occ o JOIN terms t USING (needle) JOIN idf i USING (needle) JOIN texts x USING (chunk_id), stat s
           WHERE {allowed} GROUP BY 1, 2)"""


DOC_TEXTS = "SELECT doc_id AS chunk_id, text AS t, greatest(length(text) - 2, 0) AS n_grams FROM documents"


def ranked(source: str = "scored", k: int = 12, id_col: str = "chunk_id", name: str = "fts") -> str:
    return f"""{name} AS (SELECT query_id, {id_col}, rn - 1 AS fts_rank, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {id_col}) AS rn FROM {source}) WHERE rn <= {k})"""


def encoded(name: str, query: str, id_col: str, dim: int = 512) -> str:
    """CTEs giving ``name`` (id, slot, v FLOAT): hashed-trigram unit vectors of SELECT id, t."""
    return f"""
{chars(name + '_c', query, id_col)},
{name}_h AS (SELECT {id_col}, (unicode(c) * 961 + unicode(lead(c) OVER w) * 31 + unicode(lead(c, 2) OVER w)) % {dim} AS slot
  FROM {name}_c WINDOW w AS (PARTITION BY {id_col} ORDER BY p)),
{name}_n AS (SELECT {id_col}, slot, sqrt(CAST(count(*) AS DOUBLE)) AS x FROM {name}_h WHERE slot IS NOT NULL GROUP BY 1, 2),
{name} AS (SELECT {id_col}, slot, CAST(CAST(x / sqrt(sum(x * x) OVER (PARTITION BY {id_col})) AS FLOAT) AS DOUBLE) AS v FROM {name}_n)"""


def nearest(queries: str, vectors: str, k: int, max_dist: float, id_col: str = "chunk_id") -> str:
    """CTE ``vec`` (query_id, id, vec_rank, distance) from sparse vectors."""
    return f"""
vq AS (SELECT query_id, sum(v * v) AS n FROM {queries} GROUP BY 1),
vv AS (SELECT {id_col}, sum(v * v) AS n FROM {vectors} GROUP BY 1),
vd AS (SELECT a.query_id, b.{id_col}, sum(a.v * b.v) AS d FROM {queries} a JOIN {vectors} b USING (slot) GROUP BY 1, 2),
vec AS (SELECT query_id, {id_col}, rn - 1 AS vec_rank, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, {id_col}) AS rn FROM (
    SELECT query_id, {id_col}, round(sqrt(greatest(vq.n + vv.n - 2 * coalesce(d, 0), 0)), 6) AS distance
    FROM vq CROSS JOIN vv LEFT JOIN vd USING (query_id, {id_col})) WHERE distance <= {max_dist}) WHERE rn <= {k})"""


def fused(id_col: str = "chunk_id") -> str:
    return f"""
fused AS (SELECT query_id, {id_col}, v.vec_rank, v.distance AS vec_distance, f.fts_rank,
  round(coalesce(1.0::DOUBLE / (60 + v.vec_rank), 0) + coalesce(1.0::DOUBLE / (60 + f.fts_rank), 0), 9) AS score
  FROM vec v FULL JOIN fts f USING (query_id, {id_col}))"""


def hybrid(fetch: int = 12, max_dist: float = 1.25) -> str:
    """All CTEs up to ``fused`` over whole documents and whole benchmark passages."""
    title = f"substr(trim(split_part({TRIMMED}, chr(10), 1)), 1, 80)"
    return ",".join([
        bm25(DOC_TEXTS), ranked(k=fetch),
        encoded("eq", "SELECT item_id AS query_id, text AS t FROM benchmark", "query_id"),
        encoded("ed", f"SELECT doc_id AS chunk_id, {title} || chr(10) || text AS t FROM documents", "chunk_id"),
        nearest("eq", "ed", fetch, max_dist), fused(),
    ])
