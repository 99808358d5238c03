"""Date, duration and tolerant number parsing (null instead of an error)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zone names allowed in mail-style dates.
MAIL_ZONES = (
    ("GMT", "+0000"), ("UTC", "+0000"), ("UT", "+0000"), ("Z", "+0000"),
    ("EST", "-0500"), ("EDT", "-0400"), ("CST", "-0600"), ("CDT", "-0500"),
    ("MST", "-0700"), ("MDT", "-0600"), ("PST", "-0800"), ("PDT", "-0700"),
)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _parse(col: Column, pattern: str) -> Column:
    return F.try_to_timestamp(col, F.lit(pattern))


def article_date(col) -> Column:
    """ISO date, ISO date-time or slashed date in the first 19 characters, as UTC."""
    head = F.substring(_c(col), 1, 19)
    return F.coalesce(
        F.when(head.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), _parse(head, "yyyy-M-d")),
        F.when(
            head.rlike(r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$"),
            _parse(head, "yyyy-M-d'T'H:m:s"),
        ),
        F.when(head.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), _parse(head, "yyyy/M/d")),
    )


def mail_date(col) -> Column:
    """Mail-header date (feeds), converted to UTC."""
    body = F.regexp_replace(F.trim(_c(col)), r"^[A-Za-z]{3,9},\s*", "")
    base = F.regexp_extract(body, r"^(\d{1,2} [A-Za-z]{3} \d{4} \d{1,2}:\d{2}(?::\d{2})?)", 1)
    base = F.when(base.rlike(r"\d:\d{2}:\d{2}$"), base).otherwise(F.concat(base, F.lit(":00")))
    zone = F.upper(F.regexp_extract(body, r"([A-Za-z]+|[+-]\d{4})\s*$", 1))
    offset = F.when(zone.rlike(r"^[+-]\d{4}$"), zone)
    for name, off in MAIL_ZONES:
        offset = offset.when(zone == name, F.lit(off))
    offset = offset.otherwise(F.lit("+0000"))
    return F.when(
        base != ":00", F.try_to_timestamp(F.concat(base, F.lit(" "), offset), F.lit("d MMM yyyy H:mm:ss xx"))
    )


def compact_date(col) -> Column:
    return F.when(_c(col).rlike(r"^\d{8}$"), _parse(_c(col), "yyyyMMdd"))


def epoch_time(col) -> Column:
    return F.timestamp_seconds(_c(col).try_cast("double"))


def spaced_time(col) -> Column:
    return F.when(
        _c(col).rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), _parse(_c(col), "yyyy-MM-dd HH:mm:ss")
    )


def published_time(col) -> Column:
    """First reading that fits: epoch, compact date, article forms, spaced form, mail form."""
    return F.coalesce(
        compact_date(col),
        F.when(_c(col).rlike(r"^\d{9,11}(\.\d+)?$"), epoch_time(col)),
        article_date(col), spaced_time(col), mail_date(col),
    )


def duration_seconds(col) -> Column:
    """Plain digits, or up to three colon-separated numbers."""
    raw = F.trim(_c(col))
    parts = F.transform(F.split(raw, ":"), lambda p: p.try_cast("long"))
    return F.when(
        raw.rlike(r"^\d+(:\d+){0,2}$"),
        F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc * 60 + p),
    )


def safe_int(col) -> Column:
    return _c(col).try_cast("double").try_cast("long")


def iso_z(col) -> Column:
    """UTC timestamp as text in the library's ISO form."""
    return F.date_format(_c(col), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def month_of(col) -> Column:
    return F.date_format(_c(col), "yyyy-MM")


def week_label(ts, now) -> Column:
    """This week (from Monday), last week, a month label, or earlier for null."""
    t, start = _c(ts), F.date_trunc("week", now)
    month = F.concat(
        F.year(t).cast("string"), F.lit("年"), F.month(t).cast("string"), F.lit("月")
    )
    return (
        F.when(t.isNull(), F.lit("更早"))
        .when(t >= start, F.lit("本週"))
        .when(t >= start - F.expr("INTERVAL 7 DAYS"), F.lit("上週"))
        .otherwise(month)
    )
