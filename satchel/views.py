"""Archive views over the shared tables, as SQL text that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW = 1706659200  # 2024-01-31 00:00 UTC

#: Dictionary used over the shared tables: name, facet, aliases (surfaces are frequent words of the texts; one phrase, one case variant).
TAG_ROWS = [
    (1, "that", "craft", ["THAT", "thand"]),
    (2, "with", "craft", ["from"]),
    (3, "und", "life", ["der", "die"]),
    (4, "les", "life", ["des", "queeau"]),
    (5, "ofthe", "money", ["of the", "in the"]),
    (6, "los", "neutral", ["que"]),
    (7, "zzz", "neutral", ["nothing at all"]),
]
FACETS = ["craft", "life", "money", "neutral"]
DOMAIN_TAGS = {"_comment": ["x"], "example.com": ["with"], "src1.example.com": ["that", "und"], "example.net": ["los"]}


def _values(rows: list[tuple], names: list[str]) -> str:
    lit = lambda v: "'" + v + "'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


#: Each view is SELECT text; names in braces are base tables, other names are views listed before.
VIEWS: dict[str, str] = {
    "links": """
SELECT doc_id AS id, 'https://' || source || '.example.com/' || doc_id AS url, source || '.example.com' AS domain,
  split_part(text, chr(10), 1) AS title, substr(text, length(split_part(text, chr(10), 1)) + 2) AS description, text AS body_text,
  CASE WHEN doc_id % 6 = 0 THEN split_part(text, ' ', 2) || ', ' || split_part(text, ' ', 3) ELSE '' END AS keywords,
  '' AS note, lang,
  CASE WHEN doc_id % 13 = 0 THEN 'failed' WHEN doc_id % 11 = 0 THEN 'pending' ELSE 'done' END AS status,
  CASE WHEN doc_id % 5 = 0 THEN 'client' ELSE 'server' END AS body_source,
  1704067200 + (doc_id * 7919 * 61) % 2592000 AS created_at,
  CASE WHEN doc_id % 3 = 0 THEN 1704067200 + (doc_id * 7919 * 61) % 2592000 + 86400 END AS opened_at,
  CASE WHEN doc_id % 17 = 0 THEN CAST(1706600000 AS BIGINT) END AS deleted_at
FROM {documents}""",
    "tags": _values([(i, n, f) for i, n, f, _ in TAG_ROWS], ["id", "name", "facet"]),
    "surfaces": _values([(i, n, s) for i, n, _, a in TAG_ROWS for s in [n, *a]], ["tag_id", "tag", "surface"]),
    # some attachments that don't need the tagging job: manual ones and rules by arithmetic on the id
    "link_tags": """
SELECT doc_id AS link_id, CAST(1 + doc_id % 6 AS INT) AS tag_id, 'rules' AS source, CAST(0.5 + (doc_id % 4) / 8.0 AS DOUBLE) AS confidence FROM {documents} WHERE doc_id % 4 <> 1
UNION ALL SELECT doc_id, CAST(1 + (doc_id + 2) % 6 AS INT), 'manual', CAST(NULL AS DOUBLE) FROM {documents} WHERE doc_id % 7 = 0""",
    "jobs": """
SELECT doc_id AS id, doc_id AS link_id, CASE doc_id % 3 WHEN 0 THEN 'scrape' WHEN 1 THEN 'tag' ELSE 'thumb' END AS kind,
  CASE WHEN doc_id % 13 = 0 THEN 'failed' WHEN doc_id % 11 = 0 THEN 'pending' ELSE 'done' END AS status,
  doc_id % 4 AS attempts, 1706659200 + (doc_id % 9 - 4) * 60 AS run_after FROM {documents}
UNION ALL SELECT doc_id + 1000000, doc_id, 'tag', CASE WHEN doc_id % 10 = 0 THEN 'pending' ELSE 'failed' END, doc_id % 4, 1706659200 + (doc_id % 5 - 2) * 60 FROM {documents} WHERE doc_id % 5 = 0""",
    "recognition": """
SELECT event_id AS id, user_id AS link_id, user_id % 2 AS rung, EPOCH(ts) AS shown_at, CASE WHEN event_id % 3 = 0 THEN EPOCH(ts) + 30 END AS tapped_at FROM {events} WHERE event_type = 'view'""",
    "saves": "SELECT event_id, user_id, EPOCH(ts) AS saved_at FROM {events} WHERE event_type = 'purchase'",
    "page_links": r"""
SELECT page_id AS id, url, html, lower(regexp_extract(url, '^[a-zA-Z]+://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host,
  1704067200 + (page_id * 7919 * 61) % 2592000 AS created_at FROM {pages}""",
    # merges: every link is current; every link also comes in again, changed, a third of them as new links
    "old_links": "SELECT id, url, title, description, body_text, keywords, note, body_source, status, created_at, deleted_at FROM links",
    "new_links": """
SELECT CASE WHEN id % 3 = 1 THEN id + 1000000000 ELSE id END AS id, CASE WHEN id % 3 = 1 THEN url || '/more' ELSE url END AS url, 'new ' || title AS title, CASE WHEN id % 4 = 0 THEN '' ELSE description END AS description,
  'new ' || body_text AS body_text, CASE WHEN id % 5 = 0 THEN 'late' ELSE '' END AS keywords, 'again' AS note, CASE WHEN id % 7 = 0 THEN 'client' ELSE 'server' END AS body_source FROM links""",
}
_NEEDS = {"old_links": ["links"], "new_links": ["links"]}
_SPARK_EPOCH = "(CAST(unix_date(to_date({0})) AS BIGINT) * 86400 + hour({0}) * 3600 + minute({0}) * 60 + second({0}))"


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An archive view over the tables in sf_dir."""
    text = VIEWS[name].replace("EPOCH(ts)", _SPARK_EPOCH.format("ts"))
    text = text.replace("\\", "\\\\")  # Spark reads backslashes in literals as escapes
    for other in _NEEDS.get(name, []):
        text = text.replace(f"FROM {other}", f"FROM {{{other}}}")
    frames = {t: base(spark, sf_dir, t) for t in ("documents", "events", "pages", "benchmark") if f"{{{t}}}" in text}
    frames |= {t: view(spark, sf_dir, t) for t in _NEEDS.get(name, [])}
    return spark.sql(text, **frames) if frames else spark.sql(text)


def with_views(body: str, *names: str) -> str:
    """DuckDB text: body after the named views, in the order of VIEWS."""
    wanted = {n for name in names for n in [name, *_NEEDS.get(name, [])]}
    ctes = []
    for n, text in VIEWS.items():
        if n in wanted:
            text = text.replace("EPOCH(ts)", "CAST(floor(epoch(ts)) AS BIGINT)")
            for t in ("documents", "events", "pages", "benchmark"):
                text = text.replace(f"{{{t}}}", t)
            ctes.append(f"{n} AS ({text})")
    return "WITH " + ", ".join(ctes) + (", " + body.strip()[5:] if body.strip().upper().startswith("WITH ") else "\n" + body)
