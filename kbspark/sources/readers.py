"""Sources: texts, JSON lines, web pages, feeds, captions, recognised speech, descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kbspark.functions import dates as D
from kbspark.functions import text as T
from kbspark.functions import urls as U
from kbspark.functions.rules import CAPTION_LANGUAGES, WALL_MIN_RENDERED, wall_reason
from kbspark.operators.blocks import top_k

SHARE_BYTES = 4 * 1024 * 1024  # of markup in one task; its tags take some fifty times as much

# Feed page size, marker position, titles.
MAX_EPISODES = 20
MARKER = "Markdown Content:"
MARKER_WITHIN = 2000
EPISODE_TITLE = "(無標題)"
FEED_SCHEMA = (
    "channel struct<title:array<string>,item:array<struct<title:array<string>,link:array<string>,pubDate:array<string>,"
    "guid:array<string>,feedDuration:array<string>,enclosure:array<struct<_url:string,_type:string>>>>>, _corrupt string"
)


def text_sources(df: DataFrame, text: str = "text", title: str | None = None, now: Column | None = None) -> DataFrame:
    """Pasted texts as source columns; the first line stands in for a missing title."""
    given = F.nullif(T.strip(F.col(title)), F.lit("")) if title else F.lit(None).cast("string")
    key, when = T.content_id(text), now if now is not None else F.current_timestamp()
    return df.select(
        *[c for c in df.columns if c not in ("title",)],
        F.lit("text").alias("type"), F.lit("manual").alias("platform"), key.alias("video_id"),
        F.coalesce(F.substring(given, 1, 200), T.first_line(text, 80)).alias("title"),
        F.concat(F.lit("manual:"), key).alias("url_original"), F.concat(F.lit("manual:"), key).alias("url_normalized"),
        when.alias("published_at"), when.alias("ingested_at"), F.lit("processing").alias("status"),
    )


def text_directory(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(title, text) per ``*.txt`` file, or with ``lines`` per line of one; the title is the file stem.

    A file per text costs the driver a listing and a commit each. Stored texts that hold no line
    break go many to a file instead (:func:`kbspark.sources.sinks.write_text_lines`).
    """
    df = spark.read.text(path, wholetext=not lines, pathGlobFilter="*.txt")
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1)
    return df.select(stem.alias("title"), F.col("value").alias("text"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; blank lines give no row."""
    return spark.read.schema(schema).json(path)


# Elements that frame an article, and words in a class, id or role that name such parts.
FURNITURE = ("nav", "footer", "aside", "noscript", "form", "menu", "button", "select", "iframe", "svg", "template", "title")
PARTS = "ads?|advert|advertisement|banner|comments?|menu|navigation|sidebar|share|cookie|related"
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
BLOCKS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "div", "article", "section", "tr")
_TOKEN = r"(?s)<[/!A-Za-z][^>]*>|[^<]+|<"
_NAMED = r"(?is)^<[^>]*[\s\"'](?:class|id|role)\s*=\s*(?:[\"'][^\"'>]*|)(?<![\w-])(?:" + PARTS + r")(?![\w-])"


def _shares(pages: DataFrame, html: str) -> int:
    """Partitions for the tags of all pages, so that a task sorts those of ``SHARE_BYTES`` of markup however many pages there are."""
    total = pages.agg(F.sum(F.octet_length(html))).first()[0] or 0
    return max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARE_BYTES))


def page_tokens(pages: DataFrame, html: str = "html") -> DataFrame:
    """Tags and texts of every page in order, with ``cover``: how many removed elements they lie in.

    A closing tag belongs to the last open tag of its name on its level. Levels are running
    sums over the tags of one name, so tags that are never closed (paragraphs, list items)
    disturb no other name. An element that is never closed is not removed. The other columns
    of a page ride on its first row, in ``page``.
    """
    own = [c for c in pages.columns if c != html]
    raw = F.regexp_replace(F.col(html), r"(?is)<!--.*?-->", "")
    for tag in ("script", "style"):  # their content is no markup
        raw = F.regexp_replace(raw, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    # pages are numbered before they are taken apart; one shuffle by page serves every window
    numbered = pages.select(F.monotonically_increasing_id().alias("_row"), F.struct(*own).alias("page"), raw.alias("_raw"))
    rows = numbered.select("_row", "page", F.posexplode_outer(F.regexp_extract_all("_raw", F.lit(_TOKEN), F.lit(0))).alias("pos", "token"))
    rows = rows.withColumn("pos", F.coalesce("pos", F.lit(0))).withColumn("page", F.when(F.col("pos") == 0, F.col("page")))
    rows = rows.repartition(_shares(pages, html), "_row")
    name = F.lower(F.regexp_extract("token", r"^</?([A-Za-z][\w:-]*)", 1))
    tag = rows.withColumn("name", F.coalesce(name, F.lit(""))).withColumn("closing", F.col("token").startswith("</"))
    paired = (F.col("name") != "") & ~F.col("name").isin(*VOID) & ~F.col("token").rlike(r"/\s*>$")
    tag = tag.withColumn("delta", F.when(paired, F.when(F.col("closing"), -1).otherwise(1)).otherwise(0)).withColumn(
        "part", (F.col("delta") == 1) & (F.col("name").isin(*FURNITURE) | F.col("token").rlike(_NAMED)))
    named = W.partitionBy("_row", "name").orderBy("pos")
    tag = tag.withColumn("level", F.sum("delta").over(named.rowsBetween(W.unboundedPreceding, 0)) + (F.col("delta") == -1).cast("int"))
    tag = tag.withColumn("level", F.when(F.col("delta") != 0, F.col("level")))  # texts and tags of their own are on none
    level = W.partitionBy("_row", "name", "level").orderBy("pos")
    tag = tag.withColumn("_shuts", F.lead("delta").over(level) == -1).withColumn("_opened", F.lag("part").over(level))
    step = F.when(F.col("part") & F.col("_shuts"), 1).when((F.col("delta") == -1) & F.col("_opened"), -1).otherwise(0)
    every = W.partitionBy("_row").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return tag.withColumn("_step", step).select(
        "_row", "page", "pos", "token", "name", "closing", F.sum("_step").over(every).alias("cover"))


def page_bodies(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Pages with their running text instead of ``html``: framing elements dropped whole, however
    deeply they nest, blocks to lines, other tags and entities resolved."""
    own = [c for c in pages.columns if c != html]
    kept = page_tokens(pages, html)
    broken = (F.col("closing") & F.col("name").isin(*BLOCKS)) | (F.col("name") == "br")
    piece = F.when(F.col("cover") > 0, "").when(broken, "\n").when((F.col("name") == "") & ~F.col("token").startswith("<!"), F.col("token")).otherwise("")
    # the pieces of one page, which is one cell of the input
    whole = kept.groupBy("_row").agg(F.first("page", ignorenulls=True).alias("page"), F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("pos", F.coalesce(piece, F.lit("")).alias("t")))), lambda x: x["t"]), "").alias("body"))
    body = T.html_unescape("body")
    text = T.strip(F.regexp_replace(F.regexp_replace(body, r"[ \t]+", " "), r"\s*\n\s*", "\n"))
    return whole.select(*[F.col("page")[c].alias(c) for c in own], text.alias(out))


def page_title(html: Column) -> Column:
    raw = F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1)
    return F.nullif(T.collapse(T.html_unescape(raw)), F.lit(""))


def page_date(html: Column) -> Column:
    raw = F.regexp_extract(
        html, r"(?is)<meta[^>]+(?:property|name)=[\"'](?:article:published_time|date)[\"'][^>]+content=[\"']([^\"']+)", 1)
    alt = F.regexp_extract(html, r"(?is)<time[^>]+datetime=[\"']([^\"']+)", 1)
    return D.article_date(F.coalesce(F.nullif(raw, F.lit("")), F.nullif(alt, F.lit(""))))


def page_articles(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Pages as article sources with one whole-document segment and a rejection reason."""
    # title and date come from the page as it is; its text from what is left of it
    facts = pages.select(
        *[c for c in pages.columns if c != html], F.col(html), F.lit("article").alias("type"), F.lit("web").alias("platform"),
        U.article_url_id(url).alias("video_id"), F.coalesce(page_title(F.col(html)), U.netloc(url)).alias("title"),
        page_date(F.col(html)).alias("published_at"))
    return page_bodies(facts, html).withColumn("reject_reason", wall_reason("text"))


def parse_rendered(df: DataFrame, raw: str = "raw", url: str = "url") -> DataFrame:
    """Rendered pages: header lines peeled when the content marker is near the start.

    Header lines are known ``Name: value`` lines and blanks; the last title and date given
    win and an unknown line ends the header.
    """
    text = F.col(raw)
    marked = F.locate(MARKER, text) > 0
    near = marked & (F.locate(MARKER, text) <= MARKER_WITHIN - len(MARKER) + 1)
    head_line = r"(?:[ \t]*(?:Title|URL Source|Published Time|Warning):[^\n]*(?:\n|\z)|[ \t]*\n)*"
    header = F.regexp_extract(text, rf"\A({head_line}(?:[ \t]*Markdown Content:[^\n]*(?:\n|\z))?)", 1)

    def last(name: str) -> Column:
        found = F.regexp_extract_all(header, F.lit(rf"(?m)^[ \t]*{name}:[ \t]*(\S[^\n]*?)[ \t]*$"), F.lit(1))
        return F.when(F.size(found) > 0, F.element_at(found, -1))

    body = T.strip(F.when(near, F.expr(f"substring({raw}, length(_header) + 1)")).otherwise(text))
    return (
        df.withColumn("_header", F.when(near, header).otherwise(F.lit("")))
        .withColumn("text", body)
        .withColumn("title", F.coalesce(F.when(near, last("Title")), U.netloc(url)))
        .withColumn("published_at", F.when(near, D.article_date(last("Published Time"))))
        .withColumn("reject_reason", wall_reason("text", WALL_MIN_RENDERED))
        .drop("_header")
    )


def rss_episodes(feeds: DataFrame, feed_id: str = "feed_id", url: str = "url", xml: str = "xml") -> tuple[DataFrame, DataFrame]:
    """Episodes of RSS feeds and the feeds that gave none.

    Episodes are the first 20 items, in document order, with an audio enclosure. Errors are
    (feed_id, reason): not XML, not RSS, or no audio item. Of a repeated element the first
    counts, and prefixed elements are others than those without a prefix.
    """
    # the duration element gets a name of its own, so that it parses by name
    plain = F.regexp_replace(F.col(xml), r"(</?)itunes:duration\b", "$1feedDuration")
    is_rss = F.col(xml).rlike(r"(?s)\A\s*(?:<\?.*?\?>|<!--.*?-->|<![A-Z].*?>|\s)*<rss[\s>].*<channel[\s>]")
    parsed = feeds.withColumn("_f", F.from_xml(plain, FEED_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"})).withColumn(
        "_f", F.struct(F.when(is_rss & F.col("_f._corrupt").isNull(), F.col("_f.channel")).alias("channel"), F.col("_f._corrupt").isNotNull().alias("broken")))
    items = parsed.select(
        feed_id, F.coalesce(F.nullif(T.strip(F.get("_f.channel.title", 0)), F.lit("")), F.col(url)).alias("feed_title"),
        F.posexplode_outer("_f.channel.item").alias("pos", "_i"))
    first = lambda name: F.get(F.col(f"_i.{name}"), 0)
    audio = first("enclosure")["_url"]

    def playable(enclosure: Column) -> Column:
        kind = F.coalesce(enclosure["_type"], F.lit(""))
        return (F.coalesce(enclosure["_url"], F.lit("")) != "") & ((kind == "") | kind.startswith("audio"))

    good = items.filter(F.col("pos").isNotNull() & playable(first("enclosure")))
    episodes = top_k(good, [feed_id], [F.asc("pos")], MAX_EPISODES).select(
        feed_id, "feed_title", F.col("rn").alias("position"),
        T.strip(F.coalesce(F.nullif(first("guid"), F.lit("")), audio)).alias("guid"),
        T.strip(F.coalesce(F.nullif(first("title"), F.lit("")), F.lit(EPISODE_TITLE))).alias("title"),
        audio.alias("audio_url"), F.nullif(T.strip(F.coalesce(first("link"), F.lit(""))), F.lit("")).alias("link"),
        D.mail_date(first("pubDate")).alias("published_at"), D.duration_seconds(first("feedDuration")).alias("duration_secs"),
    ).withColumn("episode_id", T.episode_id("guid"))
    # a feed is parsed once and told by its own items; a feed that comes twice needs no audio twice
    has = F.coalesce(F.exists("_f.channel.item", lambda i: playable(F.get(i["enclosure"], 0))), F.lit(False))
    told = parsed.select(
        feed_id, has.alias("_has"),
        F.when(F.col("_f.broken"), "不是有效的 RSS(XML 解析失敗)").when(F.col("_f.channel").isNull(), "找不到 rss/channel").otherwise("RSS 裡沒有任何帶音訊的集數").alias("reason"))
    some = F.when(F.col(feed_id).isNull(), F.col("_has")).otherwise(F.max("_has").over(W.partitionBy(feed_id)))
    bad = told.withColumn("_any", some).filter(~F.col("_any")).select(feed_id, "reason")
    return episodes, bad


def caption_rank(lang: str = "lang") -> Column:
    """Position in the preference list; languages outside it come last."""
    prefs = F.array(*[F.lit(x) for x in CAPTION_LANGUAGES])
    return F.coalesce(F.nullif(F.array_position(prefs, F.col(lang)), F.lit(0)), F.lit(len(CAPTION_LANGUAGES) + 1))


def pick_captions(tracks: DataFrame, key: str = "video_id", pos: str = "pos") -> DataFrame:
    """Best hand-made caption track per video: preferred language, then listing order.

    A minimum over (rank, position) pre-aggregates, so no window is needed.
    """
    manual = tracks.filter(~F.col("is_generated"))
    rest = [c for c in tracks.columns if c != key]
    return manual.groupBy(key).agg(
        F.min_by(F.struct(*rest), F.struct(caption_rank().alias("r"), F.col(pos).alias("p"))).alias("_t")
    ).select(key, "_t.*")


def caption_segments(snippets: DataFrame) -> DataFrame:
    """Caption snippets (text, start, duration) as segments; blank ones dropped."""
    rest = [c for c in snippets.columns if c not in ("text", "start", "duration")]
    return snippets.filter(T.non_blank("text")).select(
        *rest, T.strip("text").alias("text"), F.col("start").alias("start_sec"),
        (F.col("start") + F.col("duration")).alias("end_sec"))


def merge_parts(segments: DataFrame, parts: DataFrame, key: str = "media_id") -> DataFrame:
    """Segments of split recordings on one timeline: each part shifted by its offset."""
    shift = lambda c: (F.coalesce(F.col(c), F.lit(0.0)) + F.col("offset_sec")).alias(c)
    return segments.join(parts.select(key, "part", "offset_sec"), [key, "part"]).select(
        *[shift(c) if c in ("start_sec", "end_sec") else F.col(c) for c in segments.columns])


def part_offsets(media: DataFrame, key: str = "media_id", max_bytes: int = 25_000_000, target: int = 20_000_000) -> DataFrame:
    """(media, part, offset_sec): equal parts of recordings over the upload size."""
    n = F.when(F.col("n_bytes") <= max_bytes, F.lit(1)).otherwise(F.ceil(F.col("n_bytes") / target)).cast("int")
    return media.select(key, "duration_secs", n.alias("_n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("part")).select(
        key, "part", (F.col("part") * F.col("duration_secs") / F.col("_n")).cast("double").alias("offset_sec"))


def lines_to_chunks(df: DataFrame, text: str = "text", times: str | None = "times") -> DataFrame:
    """Non-blank description lines as visual rows at their frame's time (the last one repeats)."""
    lines = F.filter(F.split(F.col(text), r"\R"), lambda x: x.rlike(r"(?U)\S"))
    rest = [c for c in df.columns if c not in (text, times)]
    rows = df.select(*rest, *([times] if times else []), F.posexplode_outer(lines).alias("pos", "_line")).filter(
        F.col("pos").isNotNull())
    at = F.lit(0.0)
    if times:
        n = F.size(times)
        at = F.when(n > 0, F.try_element_at(F.col(times), F.least(F.col("pos") + 1, n))).otherwise(0.0)
    return rows.select(*rest, "pos", T.strip("_line").alias("text"), at.alias("start_sec"), at.alias("end_sec"))
