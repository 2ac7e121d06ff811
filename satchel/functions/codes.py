"""Columns over times, codes and small numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST_YEAR = 946684800  # 2000-01-01; an earlier save time is rejected (fixed value)
MICROSECONDS_FROM = 95617584000  # a larger bookmark time is in microseconds (fixed value)


def local_time(epoch: Column, tz: str = "UTC") -> Column:
    """Wall-clock time of an epoch second in tz, whatever the session's zone is."""
    at = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=epoch.cast("decimal(18,6)"))
    return at if tz == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(tz), at)


def day_of(epoch: Column, tz: str = "UTC") -> Column:
    return F.date_from_unix_date(F.floor(epoch / 86400).cast("int")) if tz == "UTC" else F.to_date(local_time(epoch, tz))


def add_date_seconds(c: Column) -> Column:
    n = F.coalesce(F.trim(c).try_cast("long"), F.lit(0))
    return F.when(n <= 0, 0).when(n > MICROSECONDS_FROM, F.floor(n / 1_000_000)).otherwise(n).cast("long")


def valid_created_at(c: Column, now: int) -> Column:
    return (c == 0) | c.between(FIRST_YEAR, now)


def parse_published(c: Column) -> Column:
    """Epoch of four layouts (offset or Z, no zone, date and time with a blank, date alone); no zone means UTC."""
    text = F.trim(c)
    zone = F.regexp_extract(text, r"(Z|[+-]\d{2}:?\d{2})$", 1)
    local = F.regexp_replace(F.regexp_replace(text, r"(?<=\d{2}:\d{2}.{0,16})(Z|[+-]\d{2}:?\d{2})$", ""), "T", " ")
    at = F.when(local.rlike(r"^\d{4}-\d{2}-\d{2}( \d{2}:\d{2}:\d{2}(\.\d+)?)?$"), local.try_cast("timestamp_ntz"))
    seconds = F.unix_date(F.to_date(at)).cast("long") * 86400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    offset = F.when(zone.isin("", "Z"), 0).otherwise(sign * (F.substring(zone, 2, 2).try_cast("int") * 3600 + F.regexp_extract(zone, r"(\d{2})$", 1).try_cast("int") * 60))
    return seconds - offset


def confidence(score: Column) -> Column:
    return 1 - 1 / (1 + score)


def idf_multiplier(df: Column, n: Column) -> Column:
    """1 below 50 documents; else between .35 and 1, rarer terms higher."""
    return F.when(n < 50, 1.0).otherwise(0.35 + 0.65 * F.log((n + 1) / (df + 1)) / F.log(n + 1))


def facet_or_neutral(c: Column, facets: list[str]) -> Column:
    return F.when(c.isin(*facets), c).otherwise("neutral")


def status_normalise(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("neutral"))


def day_gap(epoch: Column, now: int, tz: str = "UTC") -> Column:
    return F.datediff(day_of(F.lit(now), tz), day_of(epoch, tz))


def relative_time(epoch: Column, now: int, *, day_stated: bool = False, tz: str = "UTC") -> Column:
    """A key and its value: just_now, minutes:n, hours:n, yesterday, time:H:MM, date:M-D."""
    gap, ago = day_gap(epoch, now, tz), F.lit(now) - epoch
    at = local_time(epoch, tz)
    clock = F.concat(F.lit("time:"), F.hour(at), F.lit(":"), F.lpad(F.minute(at).cast("string"), 2, "0"))
    date = F.concat(F.lit("date:"), F.month(at), F.lit("-"), F.dayofmonth(at))
    plain = F.when(ago < 60, "just_now").when(ago < 3600, F.concat(F.lit("minutes:"), F.floor(ago / 60))).when(ago < 86400, F.concat(F.lit("hours:"), F.floor(ago / 3600))).when(gap == 1, "yesterday").otherwise(date)
    return F.when(gap > 0, F.when(gap == 1, clock).otherwise(date)).otherwise(plain) if day_stated else plain


def time_group(epoch: Column, now: int, tz: str = "UTC") -> Column:
    gap, day = day_gap(epoch, now, tz), day_of(epoch, tz)
    return F.when(gap <= 0, "today").when(gap == 1, "yesterday").when(gap <= 6, "week").otherwise(F.concat(F.lit("m-"), F.year(day), F.lit("-"), F.month(day)))


def period_from(key: Column, now: int, tz: str = "UTC") -> Column:
    """First second of a period: 7d and 30d back, or the first day of this year."""
    year = F.unix_date(F.trunc(day_of(F.lit(now), tz), "year")).cast("long") * 86400
    return F.when(key == "7d", F.lit(now) - 7 * 86400).when(key == "30d", F.lit(now) - 30 * 86400).when(key == "year", year).cast("long")


def cursor_encode(mode: str, a: Column, b: Column) -> Column:
    text = F.concat_ws(":", F.lit(mode), a.cast("string"), b.cast("string"))
    return F.rtrim(F.translate(F.base64(F.encode(text, "UTF-8")), "+/", "-_"), F.lit("="))


def cursor_decode(mode: str, c: Column) -> Column:
    """struct<a, b>; null for another mode or shape."""
    text = F.decode(F.unbase64(F.translate(c, "-_", "+/")), "UTF-8")
    part = lambda i: F.regexp_extract(text, rf"^{mode}:(-?[0-9.eE+-]+):(-?\d+)$", i)
    return F.when(part(1) != "", F.struct(part(1).alias("a"), part(2).cast("long").alias("b")))


#: Spellings of a checked box (fixed values).
CHECKED = ["true", "y", "yes", "예", "o", "ok", "1", "v", "✓", "x"]


def checked(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(*CHECKED), F.lit(False))


def command_key(id_: Column, action: Column, value: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("\u0000", id_.cast("string"), action, value), 256), F.lit(24))


def status_class(status: Column, retry: Column) -> Column:
    return F.when(retry == "waiting", "retry_waiting").when(status == "failed", "failed").when(status.isin("pending", "scraping", "tagging"), "progress").otherwise("")
