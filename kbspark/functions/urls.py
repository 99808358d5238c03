"""URL identity as expressions: host, whitelist, canonical video form, article ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted video hosts (any sub-domain too) and the address forms of a video.
PLATFORM_DOMAINS = {
    "youtube": ("youtube.com", "youtu.be", "youtube-nocookie.com"),
    "instagram": ("instagram.com",),
    "tiktok": ("tiktok.com",),
}
_USER = r"^(?i:https?://(?:[^/?#]*@)?"
_PORT = r"(?::\d*)?)"
_END = r"(?=[/?#]|$)"
_YOUTUBE = _USER + r"(?:(?:[^/?#@:]+\.)?(?:youtube|youtube-nocookie)\.com|[^/?#@:]+\.youtu\.be)" + _PORT
_TIKTOK = _USER + r"(?:[^/?#@:]+\.)?tiktok\.com" + _PORT
_INSTAGRAM = _USER + r"(?:[^/?#@:]+\.)?instagram\.com" + _PORT
YOUTUBE_FORMS = (
    _USER + r"youtu\.be" + _PORT + r"/+([A-Za-z0-9_-]{11})" + _END,
    _YOUTUBE + r"/+(?:shorts|live|embed|v)/+([A-Za-z0-9_-]{11})" + _END,
    _YOUTUBE + r"/watch\?(?:(?!v=[^&#])[^&#]*&)*v=([A-Za-z0-9_-]{11})(?=[&#]|$)",
)
TIKTOK_FORM = _TIKTOK + r"/+([^/?#]+)/+(?:video|photo)/+(\d+)" + _END
INSTAGRAM_FORM = _INSTAGRAM + r"/+(?:reel|reels|p|tv)/+([A-Za-z0-9_-]{5,})" + _END

_SPLIT = r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def scheme(url) -> Column:
    return F.lower(F.regexp_extract(_c(url), _SPLIT, 1))


def netloc(url) -> Column:
    return F.regexp_extract(_c(url), _SPLIT, 2)


def path(url) -> Column:
    return F.regexp_extract(_c(url), _SPLIT, 3)


def query_string(url) -> Column:
    return F.regexp_extract(_c(url), _SPLIT, 4)


def hostname(url) -> Column:
    """Lower-cased host without user info and port, null unless http(s)."""
    return F.nullif(F.lower(F.regexp_extract(_c(url), r"^(?i:https?)://(?:[^/?#]*@)?([^/?#:@]+)", 1)), F.lit(""))


def platform_of(host: Column) -> Column:
    """Platform whose domain equals the host or is a dot-separated suffix of it."""
    out = None
    for name, domains in PLATFORM_DOMAINS.items():
        pattern = r"^(?:.+\.)?(?:" + "|".join(d.replace(".", r"\.") for d in domains) + ")$"
        cond = host.rlike(pattern)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out


def video_id(url) -> Column:
    """Identifier of a video address in any accepted form, else null."""
    u, none = _c(url), F.lit("")
    found = [F.nullif(F.regexp_extract(u, p, 1), none) for p in YOUTUBE_FORMS]
    found += [F.nullif(F.regexp_extract(u, TIKTOK_FORM, 2), none), F.nullif(F.regexp_extract(u, INSTAGRAM_FORM, 1), none)]
    return F.coalesce(*found)


def canonical_url(url, platform: Column, vid: Column) -> Column:
    user = F.regexp_extract(_c(url), TIKTOK_FORM, 1)
    return (
        F.when(vid.isNull(), F.lit(None).cast("string"))
        .when(platform == "youtube", F.concat(F.lit("https://www.youtube.com/watch?v="), vid))
        .when(platform == "tiktok", F.concat(F.lit("https://www.tiktok.com/"), user, F.lit("/video/"), vid))
        .when(platform == "instagram", F.concat(F.lit("https://www.instagram.com/reel/"), vid, F.lit("/")))
    )


def reject_reason(url, host: Column, platform: Column, vid: Column) -> Column:
    """Why an address is no video address, null when it is one."""
    u = _c(url)
    return (
        F.when(host.isNull() & ~u.rlike("^(?i:https?):"), F.concat(F.lit("僅接受 http(s) 連結:"), u))
        .when(host.isNull(), F.concat(F.lit("無法解析主機名稱:"), u))
        .when(platform.isNull(), F.concat(F.lit("網域不在支援平台白名單內:"), host))
        .when(vid.isNotNull(), F.lit(None).cast("string"))
        .when(platform == "youtube", F.concat(F.lit("無法從 YouTube 連結取出影片 ID:"), u))
        .when(platform == "tiktok", F.concat(F.lit("無法從 TikTok 連結取出影片 ID(短連結需先展開):"), u))
        .otherwise(F.concat(F.lit("無法從 Instagram 連結取出內容代碼:"), u))
    )


def with_identity(df: DataFrame, url: str) -> DataFrame:
    """Add _host, _platform, _vid and _reason of an address column."""
    step = df.withColumn("_host", hostname(url)).withColumn("_vid", video_id(url))
    step = step.withColumn("_platform", platform_of(F.col("_host")))
    return step.withColumn("_reason", reject_reason(url, F.col("_host"), F.col("_platform"), F.col("_vid")))


def article_key(url) -> Column:
    """Routing id of a web page: host and path, no query, no trailing slashes."""
    return F.regexp_replace(F.concat(hostname(url), path(url)), r"/+\z", "")


def article_url_id(url) -> Column:
    """Stored id of a web page: keeps user info, port and case of the authority."""
    return F.regexp_replace(F.concat(netloc(url), path(url)), r"/+\z", "")
