"""Queries of the activity family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import activity as A
from ..views import FACETS, NOW
from .registry import query

D0 = "DATE '1970-01-01' + CAST(created_at // 86400 AS INTEGER)"
TODAY = f"(DATE '1970-01-01' + {NOW // 86400})"
SPINE = f"spine AS (SELECT CAST(unnest(generate_series({TODAY} - 29, {TODAY}, INTERVAL 1 DAY)) AS DATE) AS day)"
BY_DAY = "SELECT DATE '1970-01-01' + CAST(saved_at // 86400 AS INTEGER) AS day, count(*) AS c FROM saves GROUP BY 1"
USER_SERIES = f"{SPINE}, u AS (SELECT DISTINCT user_id FROM saves), pd AS (SELECT user_id, DATE '1970-01-01' + CAST(saved_at // 86400 AS INTEGER) AS day, count(*) AS c FROM saves GROUP BY ALL), se AS (SELECT u.user_id, s.day, coalesce(c, 0) AS count FROM u CROSS JOIN spine s LEFT JOIN pd ON pd.user_id = u.user_id AND pd.day = s.day), ag AS (SELECT *, CAST({TODAY} - day AS BIGINT) AS ago FROM se)"
STREAK = "coalesce(min(ago) FILTER (WHERE count = 0 AND ago > 0), 30) - max(CASE WHEN ago = 0 AND count = 0 THEN 1 ELSE 0 END)"

query("a01_archive_totals", f"SELECT count(*) AS total, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE {TODAY} - ({D0}) BETWEEN 0 AND 6) AS last_week FROM links WHERE deleted_at IS NULL", ("links",))(lambda l: A.archive_totals(l, NOW))  # noqa: E741
COUNTS_SQL = "SELECT name, facet, count(*) AS count FROM link_tags JOIN links ON links.id = link_id JOIN tags ON tags.id = tag_id WHERE deleted_at IS NULL GROUP BY ALL"
query("a02_count_by_tag", COUNTS_SQL, ("links", "link_tags", "tags"))(A.count_by_tag)
query("a03_saves_by_day", f"WITH {SPINE}, c AS ({BY_DAY}) SELECT day, coalesce(c, 0) AS count FROM spine LEFT JOIN c USING (day)", ("saves",))(lambda s: A.daily_series(s, F.col("saved_at"), NOW))
INVENTORY_SQL = "SELECT t.id, name, count(l.id) AS link_count, max(created_at) AS last_saved_at FROM tags t LEFT JOIN link_tags ON tag_id = t.id LEFT JOIN links l ON l.id = link_id AND deleted_at IS NULL GROUP BY t.id, name"
query("a04_tag_inventory", INVENTORY_SQL, ("links", "link_tags", "tags"))(lambda l, lt, t: A.tag_inventory(t, lt, l))  # noqa: E741
query("a05_recognition_funnel", f"SELECT rung, count(*) AS shown, count(tapped_at) AS tapped, round(count(tapped_at) / count(*), 6) AS rate FROM recognition WHERE shown_at >= {NOW} - 20 * 86400 GROUP BY ROLLUP (rung)", ("recognition",))(lambda e: A.recognition_funnel(e, NOW, 20))
query("a06_domain_encounter", "SELECT host AS domain, CASE WHEN count(*) >= 3 THEN count(*) ELSE 0 END AS n FROM page_links GROUP BY host", ("page_links",))(lambda p: A.domain_encounter(p.withColumnRenamed("host", "domain")))
query("a07_job_summary", "SELECT link_id, max_by(status, id) FILTER (WHERE kind = 'scrape') AS scrape, max_by(status, id) FILTER (WHERE kind = 'tag') AS tag, max_by(status, id) FILTER (WHERE kind = 'thumb') AS thumb FROM jobs GROUP BY link_id", ("jobs",))(A.job_summary)
query("j03_retry_state", f"SELECT id, CASE WHEN status = 'failed' THEN 'exhausted' WHEN EXISTS (SELECT 1 FROM jobs WHERE link_id = links.id AND jobs.status = 'pending' AND attempts > 0 AND run_after > {NOW}) THEN 'waiting' ELSE 'none' END AS retry FROM links", ("links", "jobs"))(lambda l, j: A.retry_state(l, j, NOW))  # noqa: E741
query("w02_streak", f"WITH {USER_SERIES} SELECT user_id, CAST({STREAK} AS BIGINT) AS streak, {STREAK} >= 30 AS capped FROM ag GROUP BY user_id", ("saves",))(lambda s: A.streaks(A.daily_series(s, F.col("saved_at"), NOW, by="user_id"), "user_id").select("user_id", "streak", "capped"))
query("w03_days_since_last", f"WITH {USER_SERIES} SELECT user_id, CAST(min(ago) FILTER (WHERE count > 0) AS INTEGER) AS days_since_last, count(*) FILTER (WHERE count > 0) AS active_days FROM ag GROUP BY user_id", ("saves",))(lambda s: A.streaks(A.daily_series(s, F.col("saved_at"), NOW, by="user_id"), "user_id").select("user_id", "days_since_last", "active_days"))
query("w14_streak_goal", f"WITH {USER_SERIES}, g AS (SELECT user_id, CAST({STREAK} AS BIGINT) AS streak FROM ag GROUP BY user_id) SELECT user_id, streak >= 5 AS goal_reached, greatest(5 - streak, 0) AS days_left FROM g", ("saves",))(lambda s: A.streaks(A.daily_series(s, F.col("saved_at"), NOW, by="user_id"), "user_id", goal=5).select("user_id", "goal_reached", "days_left"))
KEY = f"((CAST(id AS HUGEINT) * 2654435761 % 4294967296 + {NOW // 86400}) % 4294967296)"
OLD = f"deleted_at IS NULL AND opened_at IS NULL AND created_at <= {NOW} - 604800"
query("w04_resurfaced", f"SELECT id, CAST({KEY} AS BIGINT) AS order_key FROM links WHERE {OLD} ORDER BY {KEY}, id LIMIT 1", ("links",))(lambda l: A.resurfaced(l, NOW).select("id", "order_key"))  # noqa: E741
query("w04_resurfaced_by_domain", f"SELECT domain, id FROM links WHERE {OLD} QUALIFY row_number() OVER (PARTITION BY domain ORDER BY {KEY}, id) = 1", ("links",))(lambda l: A.resurfaced(l, NOW, by="domain").select("domain", "id"))  # noqa: E741
query("w05_page_after", "SELECT id, created_at FROM links WHERE deleted_at IS NULL AND (created_at < 1705400000 OR (created_at = 1705400000 AND id < 500)) ORDER BY created_at DESC, id DESC LIMIT 21", ("links",))(lambda l: A.page_after(A.live(l).select("id", "created_at"), "created_at", "id", (1705400000, 500), 20))  # noqa: E741
query("w07_sample_per_host", "WITH c AS (SELECT id, host, md5('7:' || id) AS o FROM page_links QUALIFY row_number() OVER (PARTITION BY host ORDER BY md5('7:' || id), id) <= 2) SELECT id, host FROM c ORDER BY host NOT LIKE 'm.%', o, id LIMIT 40", ("page_links",))(
    lambda p: A.sample_per_host(p.select("id", "host"), "id", "host", 2, 40, "7", F.col("host").startswith("m."))
)
query("w08_keep_last", "SELECT id FROM recognition ORDER BY shown_at DESC, id DESC LIMIT 500", ("recognition",))(lambda e: A.keep_last(e, [F.desc("shown_at"), F.desc("id")]).select("id"))
query("w09_first_per_url", "SELECT url, min(page_id) AS page_id FROM pages GROUP BY url", ("pages",))(lambda p: A.first_per(p.select("url", "page_id"), "url", ["page_id"]))
CHIP = "row_number() OVER (PARTITION BY link_id ORDER BY source <> 'manual', confidence DESC NULLS LAST, name)"
query("w10_chip_order", f"SELECT link_id, name, CAST({CHIP} AS INTEGER) AS place FROM link_tags JOIN tags ON tags.id = tag_id", ("link_tags", "tags"))(lambda lt, t: A.chip_order(lt, t).select("link_id", "name", "place"))
query("w10_dominant_facet", f"SELECT link_id, facet FROM link_tags JOIN tags ON tags.id = tag_id QUALIFY {CHIP} = 1", ("link_tags", "tags"))(lambda lt, t: A.chip_order(lt, t).where("place = 1").select("link_id", "facet"))
query("w11_sort_tags", "WITH i AS (" + INVENTORY_SQL + ") SELECT name, row_number() OVER (ORDER BY last_saved_at DESC NULLS LAST, name) AS by_recency, row_number() OVER (ORDER BY link_count DESC, name) AS by_count, row_number() OVER (ORDER BY link_count = 0, name) AS by_name FROM i", ("links", "link_tags", "tags"))(lambda *x: sorted_tags(*x))


def sorted_tags(l, lt, t):  # noqa: E741
    place = lambda by: A.sort_tags(A.tag_inventory(t, lt, l), by).select("name", F.col("place").cast("long").alias(f"by_{by}"))
    return place("recency").join(place("count"), "name").join(place("name"), "name")


query("w12_latest_untapped", "WITH n AS (SELECT id FROM recognition WHERE tapped_at IS NULL QUALIFY row_number() OVER (PARTITION BY link_id ORDER BY shown_at DESC, id DESC) = 1) SELECT id, CASE WHEN id IN (SELECT id FROM n) AND link_id % 2 = 0 THEN 9 ELSE tapped_at END AS tapped_at FROM recognition", ("recognition",))(
    lambda e: A.latest_untapped(e, e.where("link_id % 2 = 0").select("link_id", F.lit(9).alias("at")).distinct()).select("id", "tapped_at")
)
query("a21_facet_groups", "WITH c AS (" + COUNTS_SQL + ") SELECT facet, list_position(['" + "', '".join(FACETS) + "'], facet) AS place, CAST(sum(count) AS BIGINT) AS total, list(name ORDER BY count DESC, name) AS tags FROM c GROUP BY facet", ("links", "link_tags", "tags"))(lambda *x: A.facet_groups(A.count_by_tag(*x), FACETS).withColumn("place", F.col("place").cast("int")))
WD = ", ".join(f"coalesce(sum(CASE WHEN dayofweek(day) = {d} THEN count END) OVER w30, 0)" for d in range(7))
query(
    "a22_sliding_claims",
    f"WITH {SPINE}, c AS ({BY_DAY}), s AS (SELECT day, coalesce(c, 0) AS count FROM spine LEFT JOIN c USING (day)), x AS (SELECT day, count, CAST(sum(count) OVER (ORDER BY day ROWS 6 PRECEDING) AS BIGINT) AS week, CAST(coalesce(sum(count) OVER (ORDER BY day ROWS BETWEEN 13 PRECEDING AND 7 PRECEDING), 0) AS BIGINT) AS wb, [{WD}] AS wd FROM s WINDOW w30 AS (ORDER BY day ROWS 29 PRECEDING)), y AS (SELECT *, CAST(CASE WHEN list_max(wd) > 0 THEN list_position(wd, list_max(wd)) - 1 END AS BIGINT) AS peak FROM x) SELECT day, count, week, week - wb AS wow, peak, coalesce(lag(week) OVER (ORDER BY day) <> week, false) AS week_flip, coalesce(lag(peak) OVER (ORDER BY day) <> peak, false) AS peak_flip FROM y",
    ("saves",),
)(lambda s: A.sliding_claims(A.daily_series(s, F.col("saved_at"), NOW)))
query("a23_latency_report", "SELECT count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS max, quantile_disc(value, 0.99) <= 50 AS ok FROM events", ("events",))(lambda e: A.latency_report(e, "value", gate=50))
