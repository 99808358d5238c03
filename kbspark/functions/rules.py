"""Fixed values (word lists, patterns, messages) and the ordered-rule expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Question fragments removed before terms are taken.
QUERY_STOP_FRAGMENTS = (
    "為什麼", "是什麼", "怎麼樣", "怎麼辦", "怎麼", "什麼", "哪一個", "哪個", "哪些", "如何",
)

# Title shown when a source has none, marks stripped from topic names.
DEFAULT_TITLE = "(未命名)"
CLOSING_PUNCTUATION = "^[「」『』《》\"'。,]+|[「」『』《》\"'。,]+\\z"

# Login-wall markers and thresholds.
WALL_MIN_CHARS = 200
WALL_MIN_RENDERED = 60
WALL_MAX_CHARS = 500
WALL_LATIN = r"\b(sign in|log in|create an account|enable javascript|javascript is disabled|loading)\b"
WALL_CJK = (
    "載入中", "载入中", "登入", "登录", "登録", "請登錄", "请登录",
    "訂閱以繼續", "订阅以继续", "會員專屬", "会员专属",
    "開啟javascript", "开启javascript", "繼續瀏覽", "继续浏览",
)

# Stock phrases that recognisers produce on silence or music.
PHANTOM_PHRASES = (
    "Thank you for watching", "Thanks for watching",
    "Thank you for watching this video", "Please subscribe",
    "Like and subscribe", "Thanks for watching!",
    "谢谢观看", "謝謝觀看", "谢谢大家观看", "謝謝大家觀看",
    "请订阅", "請訂閱", "请点赞订阅", "請點贊訂閱",
    "请不吝点赞 订阅 转发 打赏", "請不吝點贊 訂閱 轉發 打賞",
    "明镜与点点栏目", "字幕志愿者",
    "ご視聴ありがとうございました", "시청해주셔서 감사합니다",
)

# Caption language preference, most wanted first.
CAPTION_LANGUAGES = ("zh-TW", "zh-Hant", "zh-HK", "zh", "zh-Hans", "zh-CN", "en")

# Error rules in order of precedence: category, pattern, message, action, kind.
ERROR_RULES = (
    ("login_wall", r"疑似登入牆|無法從此網頁擷取正文內容|正文僅",
     "這個頁面是動態載入(表單/商店頁)或需要登入,抓不到正文",
     "開啟該頁面全選複製內文,回研究庫貼上區以文字入庫", "paste"),
    ("ig_cookie_expired",
     r"(?i)login|cookie|authenticate|rate-?limit reached.*instagram|requested content is not available",
     "IG 需要重新登入才能讀取", "到管理頁更新 Instagram cookie", "cookie"),
    ("provider_quota", r"(?i)rate.?limit|429|quota|too many requests",
     "今日轉錄額度已滿,稍後會自動重試", "可改天再試,或等系統自動排程", "retry"),
    ("llm_billing", r"(?i)billing|credit balance|payment|insufficient.*(funds|credit)|purchase",
     "AI 服務餘額不足", "前往 console.anthropic.com 或 console.groq.com 儲值", "billing"),
    ("content_gone",
     r"(?i)video unavailable|is private|no longer available|has been (removed|deleted)"
     r"|account.*terminated|video.*not exist|http (error )?\s*4(04|10)\b|\b4(04|10) (not found|gone)\b",
     "這個內容已被下架、刪除或設為私人", "可將這筆記錄移除", "remove"),
    ("too_long", r"(?i)duration.*>.*limit|too_long|duration_check",
     "影片超過 3 小時上限,系統不收錄", "無需處理", "none"),
    ("network", r"(?i)timed? ?out|connection|network|dns|unreachable|refused",
     "網路連線不穩,抓取中斷", "稍後重試", "retry"),
    ("extractor_broken",
     r"(?i)unable to extract|unsupported url|extractor|signature|403: forbidden|http error 403",
     "平台改版導致抓取失敗", "到管理頁一鍵更新 yt-dlp 後重試", "update_ytdlp"),
)
ERROR_FALLBACK = (
    "unknown", "", "處理時發生預期外的錯誤", "重試一次;若持續失敗請看管理頁健康狀態", "retry",
)
PERMANENT_CATEGORIES = ("login_wall", "content_gone")

# Replication error rules in order of precedence: pattern, message.
TRANSPORT_RULES = (
    (r"(?i)connection refused|no route|timeout|dial tcp|i/o timeout|connect: ",
     "連不到 NAS(位址/port 錯誤,或 NAS 未開機/未開 SFTP)"),
    (r"(?i)permission denied|authentication|unable to authenticate|auth|password",
     "NAS 認證失敗(帳號或密碼錯誤)"),
    (r"(?i)not found|no such|does not exist", "NAS 上找不到指定資料夾"),
)
TRANSPORT_FALLBACK = "異地備份失敗,請確認 NAS 設定(詳見伺服器 log)"


def first_match(col: Column, rules: Sequence[tuple[str, Column]], otherwise: Column) -> Column:
    """Value of the first rule whose pattern is found in ``col``."""
    text = F.coalesce(col, F.lit(""))
    out = None
    for pattern, value in rules:
        cond = text.rlike(pattern)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(otherwise)


def translate_error(col) -> Column:
    """struct(category, message, action, action_kind) of a raw error text."""
    col = F.col(col) if isinstance(col, str) else col

    def human(rule) -> Column:
        return F.struct(
            F.lit(rule[0]).alias("category"), F.lit(rule[2]).alias("message"),
            F.lit(rule[3]).alias("action"), F.lit(rule[4]).alias("action_kind"),
        )

    return first_match(col, [(r[1], human(r)) for r in ERROR_RULES], human(ERROR_FALLBACK))


def error_category(col) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return first_match(col, [(r[1], F.lit(r[0])) for r in ERROR_RULES], F.lit(ERROR_FALLBACK[0]))


def is_permanent(col) -> Column:
    return error_category(col).isin(*PERMANENT_CATEGORIES)


def transport_message(col) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return first_match(
        col, [(p, F.lit(m)) for p, m in TRANSPORT_RULES], F.lit(TRANSPORT_FALLBACK)
    )


def wall_reason(text, min_chars: int = WALL_MIN_CHARS) -> Column:
    """Why a page text is no usable article body, null when it is one."""
    text = F.col(text) if isinstance(text, str) else text
    squeezed = F.regexp_replace(text, r"(?U)\s+", "")
    n = F.length(squeezed)
    lowered = F.lower(squeezed)
    hit = F.coalesce(
        *[F.when(lowered.contains(m), F.lit(m)) for m in WALL_CJK],
        F.nullif(F.regexp_extract(F.lower(text), WALL_LATIN, 1), F.lit("")),
    )
    return (
        F.when(n == 0, F.lit("無法從此網頁擷取正文內容"))
        .when(n < min_chars, F.concat(
            F.lit("正文僅 "), n.cast("string"), F.lit(" 字,疑似登入牆或需 JavaScript 動態載入的頁面")))
        .when(n >= WALL_MAX_CHARS, F.lit(None).cast("string"))
        .when(hit.isNotNull(), F.concat(
            F.lit("正文過短("), n.cast("string"), F.lit(" 字)且含樣板字串「"), hit, F.lit("」,疑似登入牆")))
    )
