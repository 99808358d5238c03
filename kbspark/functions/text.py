"""Text expressions. Every function takes Columns (or names) and returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kbspark.functions.rules import CLOSING_PUNCTUATION, DEFAULT_TITLE, QUERY_STOP_FRAGMENTS

# Character classes and numeric rules that results depend on.
CHUNK_CJK = "[\u4e00-\u9fff\u3400-\u4dbf\u3040-\u30ff\uac00-\ud7a3]"
HAN_CJK = "[\u4e00-\u9fff\u3400-\u4dbf]"
TERM_PATTERN = "[A-Za-z0-9]{2,}|[\u4e00-\u9fff]{3,}"
NORMALISE_PATTERN = r"(?U)[\s。,.!?~…·、]+"
SENTENCE_BREAK = r"(?<=[。!?;.])(?U:\s*)"
SUGGESTION_LINE = r"(?mU)^\s*追問建議\s*:\s*([^\n]+?)\s*\z"
CITATION_PATTERN = r"【S(\d+)】"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(col) -> Column:
    """Unicode-aware trim of both ends; blanks inside the text are not tried as its end."""
    return F.regexp_extract(_c(col), r"(?s)\A(?U:\s*)(.*(?U:\S))?", 1)


def collapse(col) -> Column:
    """Trim and turn every inner whitespace run into one blank."""
    return strip(F.regexp_replace(_c(col), r"(?U)\s+", " "))


def non_blank(col) -> Column:
    return _c(col).rlike(r"(?U)\S")


def compact(col) -> Column:
    return F.regexp_replace(_c(col), r"(?U)\s+", "")


def cjk_count(col, cls: str = CHUNK_CJK) -> Column:
    return F.length(_c(col)) - F.length(F.regexp_replace(_c(col), cls + "+", ""))


def chunk_tokens(col) -> Column:
    """Chunk-sizing estimate: one per CJK character, one per four others."""
    n = cjk_count(col)
    return (n + F.floor((F.length(_c(col)) - n) / 4)).cast("long")


def prompt_tokens(col) -> Column:
    """Prompt-budget estimate: 1.5 per Han character, a third per other, rounded up."""
    n = cjk_count(col, HAN_CJK)
    return F.ceil(n * F.lit(1.5) + (F.length(_c(col)) - n) / F.lit(3)).cast("long")


def normalise_sentence(col) -> Column:
    return F.lower(F.regexp_replace(_c(col), NORMALISE_PATTERN, ""))


def sentences(col) -> Column:
    """Array of non-blank sentences, split behind the closing marks."""
    return F.filter(F.split(_c(col), SENTENCE_BREAK), lambda s: s.rlike(r"(?U)\S"))


def query_terms(col) -> Column:
    """Distinct search terms of a question in order of first use."""
    q = _c(col)
    for frag in QUERY_STOP_FRAGMENTS:
        q = F.replace(q, F.lit(frag), F.lit(" "))
    return F.array_distinct(F.regexp_extract_all(q, F.lit(TERM_PATTERN), F.lit(0)))


def format_timestamp(secs) -> Column:
    s = _c(secs).cast("long")
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    minutes, seconds = F.floor(s / 60), s % 60
    return (
        F.when(_c(secs).isNull(), F.lit("--:--"))
        .when(
            s >= 3600,
            F.concat(
                F.floor(s / 3600).cast("string"), F.lit(":"),
                pad(F.floor((s % 3600) / 60)), F.lit(":"), pad(seconds),
            ),
        )
        .otherwise(F.concat(minutes.cast("string"), F.lit(":"), pad(seconds)))
    )


def minute_stamp(secs) -> Column:
    """m:ss without an hour part, null as zero (the export form)."""
    s = F.coalesce(_c(secs), F.lit(0)).cast("long")
    return F.concat(
        F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0")
    )


def html_escape(col, quote: bool = False) -> Column:
    c = _c(col)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    if quote:
        c = F.replace(c, F.lit('"'), F.lit("&quot;"))
        c = F.replace(c, F.lit("'"), F.lit("&#x27;"))
    return c


def html_unescape(col) -> Column:
    """The entities that matter in running text; the ampersand goes last."""
    c = _c(col)
    for safe, raw in (
        ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
        ("&#39;", "'"), ("&#x27;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
    ):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def citation_labels(col) -> Column:
    """Distinct label numbers cited in an answer."""
    found = F.regexp_extract_all(_c(col), F.lit(CITATION_PATTERN), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def cited_or_all(labels: Column, n: Column) -> Column:
    """Cited labels within 1..n; every label when none of them was cited."""
    every = F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(
        F.array().cast("array<int>")
    )
    used = F.array_intersect(every, labels)
    return F.when(F.size(used) > 0, used).otherwise(every)


def split_suggestions(col) -> Column:
    """struct(body, suggestions): the follow-up line counts only as the last line."""
    raw = F.regexp_extract(_c(col), SUGGESTION_LINE, 1)
    parts = F.filter(
        F.transform(F.split(raw, r"\|"), lambda x: strip(x)), lambda x: x != F.lit("")
    )
    cut = F.slice(F.transform(parts, lambda x: F.substring(x, 1, 40)), 1, 3)
    hit = raw != F.lit("")
    body = F.regexp_replace(F.regexp_replace(_c(col), SUGGESTION_LINE, ""), r"(?U)\s+\z", "")
    return F.struct(
        F.when(hit, body).otherwise(_c(col)).alias("body"),
        F.when(hit, cut).otherwise(F.array().cast("array<string>")).alias("suggestions"),
    )


def starter_lines(col) -> Column:
    """First three non-blank lines without list marks, each at most 40 characters."""
    lines = F.filter(F.split(_c(col), r"\R"), lambda x: x.rlike(r"(?U)\S"))
    clean = F.transform(
        F.slice(lines, 1, 3),
        lambda x: F.substring(F.regexp_replace(strip(x), r"^[-•0-9. ]+", ""), 1, 40),
    )
    return F.filter(clean, lambda x: x != F.lit(""))


def first_line(col, n: int) -> Column:
    """First line of the trimmed text, trimmed and cut to ``n``.

    Of a line that goes on behind ``n`` characters no more is looked at than its next solid one.
    """
    line = r"[^\n\x0B\f\r\x85\u2028\u2029]"
    whole, short = rf"{line}{{{n}}}(?={line}*?(?U:\S))", rf"(?:{line}{{0,{n - 1}}}(?U:\S))?"
    return F.regexp_extract(_c(col), rf"\A(?U:\s*)({whole}|{short})", 1)


def display_name(display_title, title, fallback=None) -> Column:
    """Display title, else title, else the fallback; empty strings count as missing."""
    last = F.lit(DEFAULT_TITLE) if fallback is None else _c(fallback)
    return F.coalesce(F.nullif(_c(display_title), F.lit("")), F.nullif(_c(title), F.lit("")), last)


def feed_title(feed, title) -> Column:
    """``feed:title`` without leading or trailing colons, at most 120 characters."""
    joined = F.concat(F.coalesce(_c(feed), F.lit("")), F.lit(":"), _c(title))
    return F.substring(F.regexp_replace(joined, r"^:+|:+\z", ""), 1, 120)


def clean_name(col) -> Column:
    """Generated topic name without surrounding quotes or full stops, at most 24 long."""
    trimmed = strip(F.regexp_replace(strip(col), CLOSING_PUNCTUATION, ""))
    return F.substring(trimmed, 1, 24)


def deep_link(platform, url, secs) -> Column:
    start = F.coalesce(_c(secs), F.lit(0)).cast("long").cast("string")
    return F.when(
        _c(platform) == F.lit("youtube"), F.concat(_c(url), F.lit("&t="), start, F.lit("s"))
    ).otherwise(_c(url))


def mask_key(col) -> Column:
    c = F.coalesce(_c(col), F.lit(""))
    return (
        F.when(c == "", F.lit("(未設定)"))
        .when(F.length(c) >= 8, F.concat(F.lit("****"), F.right(c, F.lit(4))))
        .otherwise(F.lit("****"))
    )


def parse_id_list(col) -> Column:
    """JSON id list to array<long>; anything unreadable becomes an empty list."""
    return F.coalesce(F.from_json(_c(col), "array<long>"), F.array().cast("array<long>"))


def parse_json_list(col, schema: str) -> Column:
    return F.coalesce(F.from_json(_c(col), schema), F.array().cast(schema))


def safe_key(col) -> Column:
    return F.translate(_c(col), "/:", "__")


def json_in_prose(col) -> Column:
    """First opening brace to last closing brace."""
    return F.nullif(F.regexp_extract(_c(col), r"(?s)\{.*\}", 0), F.lit(""))


def is_refusal(n_cited: Column, answer) -> Column:
    return (n_cited == 0) | (_c(answer).contains("沒有") & _c(answer).contains("相關"))


def is_bare_url(col) -> Column:
    return strip(col).rlike(r"(?i)^https?://\S+$")


def is_url_batch(col) -> Column:
    """Every non-blank line is a URL, and there is at least one line."""
    lines = F.filter(
        F.transform(F.split(_c(col), "\n"), lambda x: strip(x)), lambda x: x != F.lit("")
    )
    # most texts are told by their first word, and their lines are left alone
    other = ~_c(col).rlike(r"\A(?U:\s*)(?i:https?://)")
    return F.when(other, F.lit(False)).otherwise((F.size(lines) > 0) & F.forall(lines, lambda x: x.rlike(r"(?i)^https?://\S+$")))


def short_hash(prefix: str, col) -> Column:
    """Prefix plus the first 16 hex digits of SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(_c(col), 256), 1, 16))


def content_id(col) -> Column:
    return short_hash("txt_", strip(col))


def episode_id(guid) -> Column:
    return short_hash("ep_", guid)
