"""Activity analytics: totals, gap-filled series, streaks, funnels, resurfacing, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import day_of
from ..storage import stored
from .tagging import live, small


def archive_totals(links: DataFrame, now: int, tz: str = "UTC") -> DataFrame:
    recent = F.datediff(day_of(F.lit(now), tz), day_of(F.col("created_at"), tz)).between(0, 6)
    return live(links).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(recent).alias("last_week"))


def count_by_tag(links: DataFrame, link_tags: DataFrame, tags: DataFrame) -> DataFrame:
    on = link_tags.join(live(links).select(F.col("id").alias("link_id")), "link_id", "left_semi").join(small(tags.select(F.col("id").alias("tag_id"), "name", "facet")), "tag_id")
    return on.groupBy("name", "facet").agg(F.count(F.lit(1)).alias("count"))


def day_spine(spark, now: int, days: int, tz: str = "UTC") -> DataFrame:
    today = day_of(F.lit(now), tz)
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("day"))


def daily_series(rows: DataFrame, at: Column, now: int, *, days: int = 30, tz: str = "UTC", by: str | None = None) -> DataFrame:
    """day, count (and the key): one slot for each of the last `days` days, today last, zeros kept.

    Counts are made before the spine is joined, so the spine meets a row per day and key.
    """
    key = [by] if by else []
    per = rows.withColumn("day", day_of(at, tz)).groupBy(*key, "day").agg(F.count(F.lit(1)).alias("count"))
    spine = day_spine(rows.sparkSession, now, days, tz)
    if by:
        spine = rows.select(by).distinct().crossJoin(F.broadcast(spine))  # days rows: a constant
    return spine.join(per, [*key, "day"], "left").select(*key, "day", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def streaks(series: DataFrame, by: str, days: int = 30, goal: int = 28) -> DataFrame:
    """Trailing run of non-zero slots (an empty today doesn't break it), whether it fills the window, days since the last save,
    active days, and the goal."""
    last = F.max("day").over(Window.partitionBy(by))
    s = series.withColumn("ago", F.datediff(last, F.col("day")))
    stop = F.min(F.when((F.col("count") == 0) & (F.col("ago") > 0), F.col("ago")))
    today_empty = F.max(((F.col("ago") == 0) & (F.col("count") == 0)).cast("int"))
    g = s.groupBy(by).agg(
        (F.coalesce(stop, F.lit(days)) - today_empty).cast("long").alias("streak"),
        F.min(F.when(F.col("count") > 0, F.col("ago"))).alias("days_since_last"),
        F.count_if(F.col("count") > 0).alias("active_days"),
    )
    return g.withColumn("capped", F.col("streak") >= days).withColumn("goal_reached", F.col("streak") >= goal).withColumn("days_left", F.greatest(F.lit(goal) - F.col("streak"), F.lit(0)))


def tag_inventory(tags: DataFrame, link_tags: DataFrame, links: DataFrame) -> DataFrame:
    on = link_tags.join(live(links).select(F.col("id").alias("link_id"), "created_at"), "link_id")
    per = on.groupBy("tag_id").agg(F.count("link_id").alias("link_count"), F.max("created_at").alias("last_saved_at"))
    return tags.join(per, tags["id"] == per["tag_id"], "left").select("id", "name", F.coalesce("link_count", F.lit(0)).alias("link_count"), "last_saved_at")


def recognition_funnel(events: DataFrame, now: int, days: int) -> DataFrame:
    """Shown and tapped per rung, with a total (rung null)."""
    recent = events.where(F.col("shown_at") >= now - days * 86400)
    g = recent.rollup("rung").agg(F.count(F.lit(1)).alias("shown"), F.count("tapped_at").alias("tapped"))
    return g.withColumn("rate", F.round(F.col("tapped") / F.col("shown"), 6))


def domain_encounter(links: DataFrame, least: int = 3) -> DataFrame:
    per = links.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    return per.select("domain", F.when(F.col("n") >= least, F.col("n")).otherwise(0).alias("n"))


def job_summary(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("link_id").pivot("kind", ["scrape", "tag", "thumb"]).agg(F.max_by("status", "id"))


def retry_state(links: DataFrame, jobs: DataFrame, now: int) -> DataFrame:
    waiting = jobs.where((F.col("status") == "pending") & (F.col("attempts") > 0) & (F.col("run_after") > now)).select(F.col("link_id").alias("id"), F.lit(True).alias("waits")).distinct()
    return links.select("id", "status").join(waiting, "id", "left").select("id", F.when(F.col("status") == "failed", "exhausted").when(F.col("waits"), "waiting").otherwise("none").alias("retry"))


def resurfaced(links: DataFrame, now: int, *, mix: str = "reference", by: str | None = None, tz: str = "UTC") -> DataFrame:
    """One unopened live link of at least seven days: the least key by id and day. mix='hash' draws anew every day."""
    old = live(links).where(F.col("opened_at").isNull() & (F.col("created_at") <= now - 7 * 86400))
    day = F.unix_date(day_of(F.lit(now), tz))
    product = (F.col("id").cast("decimal(20,0)") * F.lit(2654435761).cast("decimal(10,0)") % F.lit(4294967296).cast("decimal(10,0)")).cast("long")
    key = (product + day) % F.lit(4294967296) if mix == "reference" else F.xxhash64("id", day)
    old = old.withColumn("order_key", key)
    if by is None:
        return old.orderBy("order_key", "id").limit(1)
    return old.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy("order_key", "id"))).where("rn = 1").drop("rn")


def page_after(df: DataFrame, a: str, b: str, cursor: tuple | None, n: int) -> DataFrame:
    """A page of n rows and one more, newest first, after a keyset cursor; never an offset."""
    if cursor:
        df = df.where((F.col(a) < cursor[0]) | ((F.col(a) == cursor[0]) & (F.col(b) < cursor[1])))
    return df.orderBy(F.desc(a), F.desc(b)).limit(n + 1)


def chip_order(link_tags: DataFrame, tags: DataFrame) -> DataFrame:
    named = link_tags.join(small(tags.select(F.col("id").alias("tag_id"), "name", "facet")), "tag_id")
    w = Window.partitionBy("link_id").orderBy((F.col("source") != "manual"), F.desc_nulls_last("confidence"), "name")
    return named.withColumn("place", F.row_number().over(w))


def facet_groups(counts: DataFrame, facets: list[str]) -> DataFrame:
    g = counts.groupBy("facet").agg(F.sum("count").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), F.col("name")))).alias("t"))
    return g.select("facet", F.array_position(F.array(*map(F.lit, facets)), F.col("facet")).alias("place"), "total", F.transform("t", lambda x: x["name"]).alias("tags"))


def sliding_claims(series: DataFrame) -> DataFrame:
    """Over a dense daily series: totals of the last two weeks and their difference, the peak weekday of the last 30 days (Sunday = 0, ties to the lowest), and
    whether each claim changed from the day before. Ordering all days in one task is fine: the table has a row per day."""
    s = series.withColumn("n", F.unix_date("day")).withColumn("wd", F.dayofweek("day") - 1)
    back = lambda lo, hi: Window.orderBy("n").rangeBetween(lo, hi)
    week, before = F.sum("count").over(back(-6, 0)), F.coalesce(F.sum("count").over(back(-13, -7)), F.lit(0))
    totals = [F.coalesce(F.sum(F.when(F.col("wd") == d, F.col("count"))).over(back(-29, 0)), F.lit(0)) for d in range(7)]
    s = s.withColumns({"week": week, "week_before": before, "by_weekday": F.array(*totals)})
    s = s.withColumn("peak", F.when(F.array_max("by_weekday") > 0, F.array_position("by_weekday", F.array_max("by_weekday")) - 1))
    s = s.withColumn("wow", F.col("week") - F.col("week_before"))
    flip = lambda c: F.coalesce(F.lag(c).over(Window.orderBy("n")) != F.col(c), F.lit(False))
    return s.withColumn("week_flip", flip("week")).withColumn("peak_flip", flip("peak")).select("day", "count", "week", "wow", "peak", "week_flip", "peak_flip")


def ranked_values(df: DataFrame, col: str, *by: str) -> DataFrame:
    """by, value, upto, n: each distinct value with how many values are at most it, of n. Values are counted, dealt into ranges and summed
    range by range, so no task orders them all: only a row per range is ordered in one."""
    counts = stored(df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("c")).repartitionByRange(*by, "value").withColumn("part", F.spark_partition_id()), "counts")
    per = counts.groupBy(*by, "part").agg(F.sum("c").alias("in_part"))
    whole = Window.partitionBy(*by)
    per = per.select(*by, "part", (F.sum("in_part").over(whole.orderBy("part")) - F.col("in_part")).alias("before"), F.sum("in_part").over(whole).alias("n"))
    inside = Window.partitionBy(*by, "part").orderBy("value")
    ranked = counts.withColumn("inside", F.sum("c").over(inside))
    return ranked.join(per, [*by, "part"]).select(*by, "value", (F.col("before") + F.col("inside")).alias("upto"), "n")


def latency_report(df: DataFrame, col: str, qs: tuple[float, ...] = (0.5, 0.95, 0.99), gate: float | None = None) -> DataFrame:
    """Nearest-rank percentiles."""
    at = lambda q: F.min(F.when(F.col("upto") >= F.greatest(F.ceil(q * F.col("n")), F.lit(1)), F.col("value")))
    r = ranked_values(df, col).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *[at(q).alias(f"p{round(q * 100)}") for q in qs], F.max("value").alias("max"))
    return r if gate is None else r.withColumn("ok", F.col(f"p{round(qs[-1] * 100)}") <= gate)


def sort_tags(inventory: DataFrame, by: str = "recency") -> DataFrame:
    """inventory(name, link_count, last_saved_at) with its place: by count, name or recency; tags never used come last. A table of tags, ordered in one task."""
    order = {"count": [F.desc("link_count"), F.asc("name")], "name": [(F.col("link_count") == 0).asc(), F.asc("name")], "recency": [F.desc_nulls_last("last_saved_at"), F.asc("name")]}[by]
    return inventory.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def keep_last(log: DataFrame, order: list, n: int = 500) -> DataFrame:
    return log.orderBy(*order).limit(n)


def first_per(df: DataFrame, key: str, order: list) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__rn = 1").drop("__rn")


def latest_untapped(events: DataFrame, taps: DataFrame) -> DataFrame:
    """events(id, link_id, shown_at, tapped_at), taps(link_id, at): the newest untapped event of a link takes the tap."""
    w = Window.partitionBy("link_id").orderBy(F.desc("shown_at"), F.desc("id"))
    newest = events.where("tapped_at IS NULL").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("id", "link_id")
    hit = newest.join(taps.groupBy("link_id").agg(F.max("at").alias("at")), "link_id").select("id", "at")
    return events.join(hit, "id", "left").withColumn("tapped_at", F.coalesce("tapped_at", "at")).drop("at")


def sample_per_host(urls: DataFrame, key: str, host: str, cap: int, limit: int, seed: str, forced: list[str] | Column | None = None) -> DataFrame:
    """A fixed-seed sample, forced hosts (a list, or a condition) first, at most `cap` a host."""
    order = F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string")))
    capped = urls.withColumn("__o", order).withColumn("__rn", F.row_number().over(Window.partitionBy(host).orderBy("__o", key))).where(F.col("__rn") <= cap)
    first = forced if isinstance(forced, Column) else F.col(host).isin(forced or [])
    return capped.orderBy(~first, "__o", key).limit(limit).drop("__o", "__rn")
