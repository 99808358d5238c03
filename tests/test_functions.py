"""Expression functions on the exact inputs they must handle."""

import random
import re

import pytest
from pyspark.sql import functions as F

from kbspark.functions import dates as D
from kbspark.functions import rules as RU
from kbspark.functions import text as T
from kbspark.functions import urls as U
from kbspark.operators import identity as I
from kbspark.sources.readers import parse_rendered, pick_captions, rss_episodes

V = "dQw4w9WgXcQ"


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(col.alias("out")).first()["out"]


@pytest.mark.parametrize("url", [
    f"https://youtu.be/{V}", f"https://www.youtube.com/watch?v={V}", f"https://www.youtube.com/watch?v={V}&t=10s&si=x",
    f"https://www.youtube.com/shorts/{V}", f"https://m.youtube.com/watch?v={V}", f"HTTPS://YouTube.com:443/watch?a=1&v={V}#t",
    f"https://youtube-nocookie.com/embed/{V}",
])
def test_youtube_forms_share_one_identity(spark, url):
    r = I.canonical_urls(spark.createDataFrame([(url,)], "url string")).first()
    assert (r.platform, r.video_id, r.canonical_url, r.reason) == ("youtube", V, f"https://www.youtube.com/watch?v={V}", None)


@pytest.mark.parametrize("url,platform,vid", [
    ("https://www.tiktok.com/@user/video/7300000000000000000", "tiktok", "7300000000000000000"),
    ("https://www.instagram.com/reel/C8abcDEfGhi/?igsh=xyz", "instagram", "C8abcDEfGhi"),
])
def test_other_platforms(spark, url, platform, vid):
    r = I.canonical_urls(spark.createDataFrame([(url,)], "url string")).first()
    assert (r.platform, r.video_id) == (platform, vid)


@pytest.mark.parametrize("url", [
    "https://example.com/watch?v=" + V, "https://youtube.com.evil.com/watch?v=" + V, "ftp://youtube.com/watch?v=" + V,
    "https://youtu.be/short", "file:///etc/passwd", f"https://youtu.be/shorts/{V}", f"https://youtube.com/watch?v=bad&v={V}",
])
def test_rejected_addresses(spark, url):
    assert I.canonical_urls(spark.createDataFrame([(url,)], "url string")).first().reason


def test_redirect_limits(spark):
    hops = spark.createDataFrame(
        [(f"https://youtu.be/{a}{i}", f"https://youtu.be/{a}{i + 1}") for a, n in (("o", 1), ("t", 3), ("f", 4)) for i in range(n)]
        + [("https://youtu.be/x0", "https://evil.example/x")], "from_url string, location string")
    urls = spark.createDataFrame([("https://youtu.be/" + x,) for x in ("o0", "t0", "f0", "x0")], "url string")
    out = {r.url[-2:]: r.expand_status for r in I.expand_redirects(urls, hops).collect()}
    assert out == {"o0": "ok", "t0": "ok", "f0": "too_many_hops", "x0": "off_whitelist"}


def test_classify_expands_short_links(spark):
    hops = spark.createDataFrame([("https://vm.tiktok.com/ab", "https://www.tiktok.com/@u/video/12?x=1")], "from_url string, location string")
    urls = spark.createDataFrame([("https://vm.tiktok.com/ab",), ("https://example.com/some/article",), ("https://vm.tiktok.com/zz",)], "url string")
    rows = {r.url: r for r in I.classify(urls, "url", hops).collect()}
    assert rows["https://vm.tiktok.com/ab"].content_id == "12"
    assert rows["https://vm.tiktok.com/ab"].canonical_url == "https://www.tiktok.com/@u/video/12"
    assert rows["https://example.com/some/article"].content_id == "example.com/some/article"
    assert rows["https://vm.tiktok.com/zz"].reason


def test_article_ids_differ(spark):
    u = "https://Me@Host.example:8080/a/b/?q=1#x"
    assert one(spark, U.article_key("u"), u=u) == "host.example/a/b"
    assert one(spark, U.article_url_id("u"), u=u) == "Me@Host.example:8080/a/b"


def test_time_stamps(spark):
    assert one(spark, T.format_timestamp("s"), s=754.0) == "12:34"
    assert one(spark, T.format_timestamp("s"), s=3723.9) == "1:02:03"
    assert one(spark, T.format_timestamp(F.lit(None).cast("double")), s=1) == "--:--"


def test_query_terms_follow_stop_fragments(spark):
    assert one(spark, T.query_terms("q"), q="乳酸閾值是什麼") == ["乳酸閾值"]
    assert one(spark, T.query_terms("q"), q="0050 vs 0050 ETF etf a 什麼") == ["0050", "vs", "ETF", "etf"]


def test_token_estimates(spark):
    assert one(spark, T.chunk_tokens("t"), t="台積電abcdefgh") == 5
    assert one(spark, T.prompt_tokens("t"), t="台積電abcd") == 6
    assert one(spark, T.chunk_tokens("t"), t="") == 0


def test_citations_and_suggestions(spark):
    a = "正文【S2】再【S1】又【S2】\n追問建議: 一| 二 ||三|四\n"
    assert one(spark, T.citation_labels("a"), a=a) == [1, 2]
    got = one(spark, T.split_suggestions("a"), a=a)
    assert got.suggestions == ["一", "二", "三"] and got.body == "正文【S2】再【S1】又【S2】"
    middle = "x\n追問建議: 一|二\nmore"
    got = one(spark, T.split_suggestions("a"), a=middle)
    assert got.suggestions == [] and got.body == middle
    assert one(spark, T.cited_or_all(T.citation_labels("a"), F.lit(3)), a="none") == [1, 2, 3]


def test_small_text_rules(spark):
    assert one(spark, T.starter_lines("t"), t="- 一\n\n2. 二\n• 三\n四") == ["一", "二", "三"]
    assert one(spark, T.clean_name("t"), t=" 「主題名」。 ") == "主題名"
    assert one(spark, T.mask_key("t"), t="abcdefgh1234") == "****1234"
    assert one(spark, T.mask_key("t"), t="abc") == "****"
    assert one(spark, T.mask_key("t"), t="") == "(未設定)"
    assert one(spark, T.safe_key("t"), t="a/b:c") == "a_b_c"
    assert one(spark, T.json_in_prose("t"), t='so {"a": {"b": 1}} ok') == '{"a": {"b": 1}}'
    assert one(spark, T.deep_link(F.lit("youtube"), F.lit("u"), F.lit(61.7)), t=1) == "u&t=61s"
    assert one(spark, T.feed_title(F.lit(""), F.lit("ep")), t=1) == "ep"
    assert one(spark, T.html_escape("t", True), t="<a href=\"x\">&'") == "&lt;a href=&quot;x&quot;&gt;&amp;&#x27;"
    assert one(spark, T.parse_id_list("t"), t="[broken") == []
    assert one(spark, T.is_refusal(F.lit(2), "t"), t="庫內沒有相關內容") is True


def test_dates(spark):
    iso = lambda c, v: one(spark, D.iso_z(c), t=v)
    assert iso(D.article_date("t"), "2024-01-05T10:00:00+02:00") == "2024-01-05T10:00:00Z"
    assert iso(D.article_date("t"), "2024-1-5") == "2024-01-05T00:00:00Z"
    assert iso(D.article_date("t"), "soon") is None
    assert iso(D.mail_date("t"), "Wed, 02 Oct 2002 13:00:00 GMT") == "2002-10-02T13:00:00Z"
    assert iso(D.mail_date("t"), "2 Oct 2002 13:00 EST") == "2002-10-02T18:00:00Z"
    assert iso(D.mail_date("t"), "nonsense") is None
    assert iso(D.compact_date("t"), "20240229") == "2024-02-29T00:00:00Z"
    assert iso(D.epoch_time("t"), "1700000000") == "2023-11-14T22:13:20Z"


def test_durations(spark):
    for raw, want in (("90", 90), ("1:30", 90), ("1:02:03", 3723), ("1:2:3:4", None), ("x", None), ("1:x", None)):
        assert one(spark, D.duration_seconds("t"), t=raw) == want
    assert one(spark, D.safe_int("t"), t="12.9") == 12
    assert one(spark, D.safe_int("t"), t="x") is None


@pytest.mark.parametrize("text,cat", [
    ("正文僅 3 字,疑似登入牆", "login_wall"), ("Login required", "ig_cookie_expired"), ("HTTP Error 429", "provider_quota"),
    ("credit balance too low", "llm_billing"), ("HTTP Error 404", "content_gone"), ("duration 5 > limit", "too_long"),
    ("connection refused", "network"), ("HTTP Error 403: Forbidden", "extractor_broken"), ("hmm", "unknown"), (None, "unknown"),
    ("id 404123", "unknown"),
])
def test_error_rules(spark, text, cat):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(RU.error_category("t")).first()[0] == cat
    assert df.select(RU.translate_error("t").alias("h")).first().h.category == cat


def test_wall_reasons(spark):
    why = lambda x: one(spark, RU.wall_reason("t"), t=x)
    assert why(" \n　") == "無法從此網頁擷取正文內容"
    assert "正文僅 50 字" in why("a" * 50)
    assert "sign in" in why("x" * 250 + " please sign in now")
    assert why("x" * 250 + " blog in downloading") is None
    assert "登入" in why("字" * 250 + "登\n入")
    assert why("x" * 600 + " sign in") is None


def test_rendered_page(spark):
    raw = "Title: T1\n\nURL Source: u\nPublished Time: 2024-03-02T01:02:03Z\nMarkdown Content:\n" + "body " * 40
    rows = spark.createDataFrame([(1, raw, "https://h.example/x"), (2, "Title: prose\n" + "body " * 40, "https://h.example/x")], "id int, raw string, url string")
    a, b = parse_rendered(rows).orderBy("id").collect()
    assert (a.title, a.text[:9], a.reject_reason) == ("T1", "body body", None) and a.published_at is not None
    assert b.title == "h.example" and b.text.startswith("Title: prose")


def test_caption_choice(spark):
    rows = [("a", 0, "fr", False), ("a", 1, "en", False), ("a", 2, "zh-TW", True), ("b", 0, "de", False), ("b", 1, "fr", False), ("c", 0, "en", True)]
    df = spark.createDataFrame(rows, "video_id string, pos int, lang string, is_generated boolean")
    assert {r.video_id: r.lang for r in pick_captions(df).collect()} == {"a": "en", "b": "de"}


def test_feed_errors(spark):
    df = spark.createDataFrame([(1, "u", "<html/>"), (2, "u", "<rss><channel><title>t</title></channel></rss>")], "feed_id int, url string, xml string")
    episodes, bad = rss_episodes(df.unionByName(spark.createDataFrame([(3, "u", "<rss><channel><title>t</channel>")], df.schema)))
    assert episodes.count() == 0
    why = {r.feed_id: r.reason for r in bad.collect()}
    assert set(why) == {1, 2, 3} and len(set(why.values())) == 3


def test_feed_elements(spark):
    item = ('<item><title>Real</title><itunes:title>Short</itunes:title><guid isPermaLink="false">g1</guid><itunes:duration>1:05</itunes:duration>'
            '<enclosure url="https://a/1.mp3" type="audio/mpeg" length="5"/><enclosure url="https://a/1.mp4" type="video/mp4"/></item>')
    xml = f'<?xml version="1.0"?><rss version="2.0" xmlns:itunes="x"><channel><title>Feed</title><itunes:title>IFeed</itunes:title>{item}</channel></rss>'
    episodes, bad = rss_episodes(spark.createDataFrame([(1, "u", xml)], "feed_id int, url string, xml string"))
    r = episodes.first()
    assert (r.feed_title, r.title, r.guid, r.audio_url, r.duration_secs) == ("Feed", "Real", "g1", "https://a/1.mp3", 65) and bad.count() == 0


def test_first_lines_of_any_length_and_blanks(spark):
    """Against the rule itself: trim the text, take its first line, trim it, cut it."""
    breaks = "\n\x0b\x0c\r\x85  "

    def plain(text, n):
        return re.split(f"[{breaks}]", text.strip(" 　 " + breaks))[0].strip(" 　 ")[:n]

    rng, parts = random.Random(2), ["a", "電", "\U0001f600", " ", "　", "  ", "\n", "\r\n", " ", "word "]
    texts = ["".join(rng.choices(parts, k=rng.randrange(14))) for _ in range(1500)] + ["x" * 300_000 + " ", "ab" + " " * 5000 + "c", "ab" + " " * 5000]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    sizes = (1, 2, 3, 5, 8, 80)
    for row in df.select("t", *[T.first_line("t", n).alias(str(n)) for n in sizes]).collect():
        assert [row[str(n)] for n in sizes] == [plain(row.t, n) for n in sizes]
    plan = df.select(T.first_line("t", 80))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def test_trims_of_any_text(spark):
    """Both ends lose every Unicode blank, whatever the length; missing texts stay missing."""
    blanks, rng = " \n\t\r\x0b\x0c\x85   　", random.Random(4)
    texts = ["".join(rng.choices("ab電\U0001f600\x1c​" + blanks, k=rng.randrange(9))) for _ in range(1500)]
    texts += ["", blanks, "a b " * 700_000 + blanks, " " * 100_000 + "x", "x" + "\n" * 100_000 + "y"]
    df = spark.createDataFrame([(x,) for x in [*texts, None]], "t string")
    assert [r.x for r in df.select(T.strip("t").alias("x")).collect()] == [x.strip(blanks) for x in texts] + [None]
    assert "regexp_replace" not in df.select(T.strip("t"))._jdf.queryExecution().optimizedPlan().toString()
