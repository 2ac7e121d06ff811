"""Queries of the merge family: every link is current, and every link comes in again, changed or as a new one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merges as M
from ..views import NOW
from .registry import query

OLD_NEW = ("links", "old_links", "new_links")
c = F.col


def saves(new):
    return new.select("url", "title", "description", F.when(c("body_source") == "client", c("body_text")).otherwise("").alias("body_text"), "keywords", "note", F.lit(0).cast("long").alias("created_at"))


FILL = "n.url IS NOT NULL AND o.deleted_at IS NULL AND n.body_source = 'client' AND o.body_source <> 'client'"
BACK = "n.url IS NOT NULL AND o.deleted_at IS NOT NULL"
TEXT = "CASE WHEN o.url IS NULL THEN n.{0} WHEN ({1}) OR ({2}) THEN coalesce(nullif(n.{0}, ''), o.{0}) ELSE o.{0} END AS {0}"
query(
    "m01_merge_saves",
    "WITH n AS (SELECT url, title, description, CASE WHEN body_source = 'client' THEN body_text ELSE '' END AS body_text, keywords, note, body_source FROM new_links), o AS (SELECT * FROM old_links) SELECT o.id, coalesce(o.url, n.url) AS url, "
    + ", ".join(TEXT.format(f, FILL, BACK) for f in ("title", "description", "body_text", "keywords"))
    + f", CASE WHEN o.url IS NULL OR ({BACK}) THEN n.note ELSE o.note END AS note, CASE WHEN o.url IS NULL OR ({BACK}) THEN CASE WHEN n.body_text <> '' THEN 'client' ELSE '' END WHEN {FILL} THEN 'client' ELSE o.body_source END AS body_source, CASE WHEN o.url IS NULL OR ({BACK}) THEN 'pending' WHEN ({FILL}) AND o.status = 'failed' THEN 'done' ELSE o.status END AS status, coalesce(o.created_at, {NOW}) AS created_at, CASE WHEN NOT ({BACK}) THEN o.deleted_at END AS deleted_at, CASE WHEN o.url IS NULL THEN 'saved' WHEN {BACK} THEN 'revived' WHEN {FILL} THEN 'filled' WHEN n.url IS NOT NULL THEN 'duplicate' ELSE 'kept' END AS outcome FROM o FULL JOIN n ON sha256(o.url) = sha256(n.url)",
    OLD_NEW,
)(lambda _, old, new: M.merge_saves(old, saves(new), NOW))
query("j04_dedupe_new", "SELECT sha256(url) AS url_hash, id FROM new_links WHERE sha256(url) NOT IN (SELECT sha256(url) FROM old_links)", OLD_NEW)(lambda _, old, new: M.dedupe_new(new, old).select("url_hash", "id"))
TAKE = "n.id IS NOT NULL AND o.deleted_at IS NULL AND o.body_source <> 'client'"
query(
    "m02_merge_extractions",
    f"SELECT o.id, CASE WHEN {TAKE} THEN n.title ELSE o.title END AS title, CASE WHEN {TAKE} THEN n.description ELSE o.description END AS description, CASE WHEN {TAKE} AND n.keywords <> '' THEN n.keywords ELSE o.keywords END AS keywords, CASE WHEN {TAKE} AND n.body_text <> '' THEN n.body_text ELSE o.body_text END AS body_text, CASE WHEN {TAKE} AND n.body_text <> '' THEN 'server' ELSE o.body_source END AS body_source, CASE WHEN n.id IS NOT NULL AND o.deleted_at IS NULL THEN 'done' ELSE o.status END AS status FROM old_links o LEFT JOIN new_links n USING (id)",
    OLD_NEW,
)(lambda _, old, new: M.merge_extractions(old, new).select("id", "title", "description", "keywords", "body_text", "body_source", "status"))
query(
    "m03_apply_tags",
    "WITH s AS (SELECT id AS link_id, 1 + id % 3 AS tag_id, 0.75 AS confidence FROM links WHERE lang <> 'fr'), k AS (SELECT * FROM link_tags WHERE NOT (source = 'rules' AND link_id IN (SELECT link_id FROM s))) SELECT link_id, CAST(tag_id AS BIGINT) AS tag_id, source, CAST(confidence AS DOUBLE) AS confidence FROM k UNION ALL SELECT link_id, CAST(tag_id AS BIGINT), 'rules', CAST(confidence AS DOUBLE) FROM s WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.link_id = s.link_id AND k.tag_id = s.tag_id)",
    ("links", "link_tags"),
)(lambda l, lt: M.apply_tags(lt.withColumn("tag_id", c("tag_id").cast("long")), l.where("lang <> 'fr'").select(c("id").alias("link_id"), (1 + c("id") % 3).alias("tag_id"), F.lit(0.75).alias("confidence"))))  # noqa: E741
TERMS = "SELECT DISTINCT id AS link_id, unnest(string_split(body_text, ' ')) AS term FROM {0}"


def terms(df):
    """link_id, term, once each. A text travels as one row of its different terms, to the task that has all of its link; what else goes by link_id then stays there."""
    each = df.select(c("id").alias("link_id"), F.array_distinct(F.split("body_text", " ")).alias("terms")).repartition("link_id")
    return each.select("link_id", F.explode("terms").alias("term")).distinct()


query("m04_update_terms", "WITH a AS (" + TERMS.format("old_links") + "), b AS (" + TERMS.format("new_links") + ") SELECT * FROM a WHERE link_id NOT IN (SELECT id FROM new_links) UNION ALL SELECT * FROM b", OLD_NEW)(lambda _, old, new: M.update_terms(terms(old), new.select(c("id").alias("link_id")), terms(new)))
NAMED = "cur AS (SELECT link_id, name FROM link_tags JOIN tags ON tags.id = tag_id ), want AS (SELECT id AS link_id, CASE WHEN id % 2 = 0 THEN 'und' ELSE 'les' END AS name FROM links)"


def current_wanted(l, lt, t):  # noqa: E741
    cur = lt.join(t.select(c("id").alias("tag_id"), "name"), "tag_id").select("link_id", "name")
    return cur, l.select(c("id").alias("link_id"), F.when(c("id") % 2 == 0, "und").otherwise("les").alias("name"))


LLT = ("links", "link_tags", "tags")
DIFF = "SELECT DISTINCT link_id, name, 'added' AS action FROM want WHERE NOT EXISTS (SELECT 1 FROM cur WHERE cur.link_id = want.link_id AND cur.name = want.name) UNION ALL SELECT link_id, name, 'removed' FROM cur WHERE NOT EXISTS (SELECT 1 FROM want WHERE cur.link_id = want.link_id AND cur.name = want.name)"
query("u01_tag_diff", "WITH " + NAMED + " " + DIFF, LLT)(lambda *x: M.tag_diff(*current_wanted(*x)))
query("m05_replace_tags", "WITH " + NAMED + f", d AS ({DIFF}) SELECT link_id, name, action, {NOW} AS created_at FROM d UNION ALL SELECT DISTINCT link_id, name, 'attached', NULL FROM want", LLT)(lambda *x: replaced(*x))


def replaced(l, lt, t):  # noqa: E741
    """The feedback rows, and the new attachments as rows of their own."""
    attached, feedback, _ = M.replace_tags(*current_wanted(l, lt, t), t, NOW)
    return feedback.unionByName(attached.withColumns({"action": F.lit("attached"), "created_at": F.lit(None).cast("int")}))


query("m06_soft_delete", f"SELECT id, CASE WHEN deleted_at IS NULL AND id % 4 = 0 THEN {NOW} ELSE deleted_at END AS deleted_at FROM links", ("links",))(lambda l: M.soft_delete(l, l.where("id % 4 = 0"), NOW).select("id", "deleted_at"))  # noqa: E741
query("m06_retract", "WITH tm AS (" + TERMS.format("links") + "), g AS (SELECT id FROM links WHERE id % 4 = 0) SELECT 'term' AS what, link_id AS id, term FROM tm WHERE link_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'doc', id, title FROM links WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'job', id, status FROM jobs WHERE NOT (status = 'pending' AND link_id IN (SELECT id FROM g))", ("links", "jobs"))(lambda l, j: retracted(l, j))  # noqa: E741


def retracted(l, j):  # noqa: E741
    tm, docs, jobs = M.retract(l.where("id % 4 = 0"), terms(l), l.select(c("id").alias("doc_id"), "title"), j)
    rows = lambda df, what, id_, x: df.select(F.lit(what).alias("what"), c(id_).alias("id"), c(x).alias("term"))
    return rows(tm, "term", "link_id", "term").unionByName(rows(docs, "doc", "doc_id", "title")).unionByName(rows(jobs, "job", "id", "status"))


query("m01_revived_tags", "SELECT link_id, tag_id, source FROM link_tags WHERE link_id NOT IN (SELECT o.id FROM old_links o JOIN new_links n ON o.url = n.url WHERE o.deleted_at IS NOT NULL)", (*OLD_NEW, "link_tags"))(lambda _, old, new, lt: M.revived_tags(lt, M.merge_saves(old, saves(new), NOW)).select("link_id", "tag_id", "source"))
query("m07_mark_opened", "SELECT links.id, coalesce(max(shown_at), any_value(opened_at)) AS opened_at FROM links LEFT JOIN recognition ON link_id = links.id GROUP BY links.id", ("links", "recognition"))(lambda l, e: M.mark_opened(l, e.select(c("link_id").alias("id"), c("shown_at").alias("at"))).select("id", "opened_at"))  # noqa: E741
query("m08_upsert_tags", "WITH ch AS (SELECT lang AS name, 'life' AS facet FROM links UNION SELECT 'UND', 'money'), k AS (SELECT lower(name) AS k, min(name) AS nn, max(facet) AS nf FROM ch GROUP BY 1) SELECT coalesce(id, (SELECT max(id) FROM tags) + row_number() OVER (PARTITION BY id IS NULL ORDER BY k)) AS id, coalesce(name, nn) AS name, coalesce(nf, facet, 'neutral') AS facet FROM tags FULL JOIN k ON lower(name) = k", ("links", "tags"))(
    lambda l, t: M.upsert_tags(t, l.select(c("lang").alias("name"), F.lit("life").alias("facet")).distinct().unionByName(t.limit(1).select(F.lit("UND").alias("name"), F.lit("money").alias("facet"))))  # noqa: E741
)
query("m09_delete_tags", "SELECT link_id, tag_id, source FROM link_tags WHERE tag_id NOT IN (2, 3)", ("link_tags", "tags"))(lambda lt, t: M.delete_tags(t, lt, t.where("id IN (2, 3)"))[1].select("link_id", "tag_id", "source"))
query("m10_set_summaries", "SELECT id, CASE WHEN id % 3 = 0 THEN '' ELSE description END AS summary FROM links", ("links",))(lambda l: M.set_summaries(l.withColumn("summary", c("description")), l.where("id % 3 = 0").select("id", F.lit("").alias("summary"))).select("id", "summary"))  # noqa: E741
query("m11_refill", "SELECT o.id, coalesce(nullif(o.keywords, ''), n.title, o.keywords) AS keywords, o.title, coalesce(nullif(o.body_text, ''), n.body_text, o.body_text) AS body_text FROM old_links o LEFT JOIN new_links n USING (id)", OLD_NEW)(lambda _, o, n: M.refill(o, n.select("id", c("title").alias("keywords"), "title", "body_text"), "id", ["keywords", "title", "body_text"]).select("id", "keywords", "title", "body_text"))
FAILED = "fl AS (SELECT *, CASE WHEN status = 'failed' THEN 'cause ' || id END AS error FROM links)"


def with_error(l):  # noqa: E741
    return l.withColumn("error", F.when(c("status") == "failed", F.concat(F.lit("cause "), c("id"))))


query("m14_retry_failed", "WITH " + FAILED + ", r AS (SELECT id FROM fl WHERE id % 2 = 0 AND status = 'failed' AND deleted_at IS NULL) SELECT 'link' AS what, id, CASE WHEN id IN (SELECT id FROM r) THEN 'pending' ELSE status END AS status, CASE WHEN id NOT IN (SELECT id FROM r) THEN error END AS error FROM fl UNION ALL SELECT 'job', id, status, NULL FROM jobs WHERE NOT (status = 'failed' AND link_id IN (SELECT id FROM r)) UNION ALL SELECT 'refused', id, NULL, NULL FROM links WHERE id % 2 = 0 AND id NOT IN (SELECT id FROM r)", ("links", "jobs"))(lambda l, j: retried(l, j))  # noqa: E741


def retried(l, j):  # noqa: E741
    links, jobs, refused = M.retry_failed(with_error(l), j, l.where("id % 2 = 0").select("id"))
    none = F.lit(None).cast("string")
    out = links.select(F.lit("link").alias("what"), "id", "status", "error").unionByName(jobs.select(F.lit("job").alias("what"), "id", "status", none.alias("error")))
    return out.unionByName(refused.select(F.lit("refused").alias("what"), "id", none.alias("status"), none.alias("error")))


query("m15_settle_failures", "WITH " + FAILED + ", f AS (SELECT link_id, max_by(status, id) AS job, max_by('job ' || id, id) AS cause FROM jobs WHERE kind NOT IN ('tag', 'thumb') GROUP BY link_id) SELECT fl.id, CASE WHEN job = 'failed' AND body_source = 'client' THEN 'done' WHEN job = 'failed' THEN 'failed' ELSE status END AS status, CASE WHEN job = 'failed' THEN cause ELSE error END AS error FROM fl LEFT JOIN f ON link_id = fl.id", ("links", "jobs"))(lambda l, j: M.settle_failures(with_error(l), j.withColumn("error", F.concat(F.lit("job "), c("id")))).select("id", "status", "error"))  # noqa: E741
COMMANDS = "cmd AS (SELECT CASE id % 4 WHEN 0 THEN 'note' WHEN 1 THEN 'delete' WHEN 2 THEN 'retry' ELSE 'bad' END AS action, id, 'v' || id AS value FROM links WHERE id % 5 <> 0 AND id > 0)"
query(
    "m12_apply_commands",
    "WITH " + COMMANDS + f" SELECT l.id, CASE WHEN action = 'note' AND l.id % 3 <> 0 THEN value ELSE l.note END AS note, CASE WHEN action = 'delete' AND l.id % 3 <> 0 AND deleted_at IS NULL THEN {NOW} ELSE deleted_at END AS deleted_at, CASE WHEN action = 'retry' AND l.id % 3 <> 0 AND status = 'failed' AND deleted_at IS NULL THEN 'pending' ELSE status END AS status FROM links l LEFT JOIN cmd ON cmd.id = l.id",
    ("links",),
)(lambda l: commands(l)["links"].select("id", "note", "deleted_at", "status"))  # noqa: E741
query("u05_ledger_keep", "WITH " + COMMANDS + " SELECT substr(sha256(id || chr(0) || action || chr(0) || value), 1, 24) AS key FROM cmd WHERE action <> 'bad'", ("links",))(lambda l: commands(l)["ledger"])  # noqa: E741


def commands(l):  # noqa: E741
    """Commands on every link whose id isn't divisible by five; those on ids divisible by three were applied before."""
    from ..functions.codes import command_key

    action = F.when(c("id") % 4 == 0, "note").when(c("id") % 4 == 1, "delete").when(c("id") % 4 == 2, "retry").otherwise("bad")
    rows = l.where("id > 0").select(c("id"), action.alias("action"), F.concat(F.lit(" v"), c("id")).alias("value"), F.lit("").alias("n"), F.when(c("id") % 5 != 0, "TRUE").otherwise("no").alias("box"))
    ledger = rows.where("id % 3 = 0").select(command_key(c("id"), c("action"), F.trim("value")).alias("key"))
    return M.apply_commands(rows.withColumn("id", c("id").cast("string")), ledger, l, NOW)


query("m13_record_recognition", "WITH n AS (SELECT link_id, rung, shown_at FROM recognition WHERE tapped_at IS NULL) SELECT id, link_id, rung, shown_at, tapped_at FROM recognition UNION ALL SELECT (SELECT max(id) FROM recognition) + row_number() OVER (ORDER BY shown_at, link_id, rung), link_id, rung, shown_at, NULL FROM n", ("recognition",))(lambda e: M.record_recognition(e, e.where("tapped_at IS NULL").select("link_id", "rung", "shown_at")))
#: Two dictionaries of sources, from the documents with an even and those with an odd id: a language as facet, the languages as aliases.
DICTIONARY = "SELECT source AS name, min(lang) AS facet, list_sort(list(DISTINCT lang) FILTER (WHERE lang IS NOT NULL)) AS aliases FROM documents WHERE source IS NOT NULL AND doc_id % 2 = {0} GROUP BY source"
query("j06_dictionary_drift", "WITH a AS (" + DICTIONARY.format(0) + "), b AS (" + DICTIONARY.format(1) + "), j AS (SELECT coalesce(a.name, b.name) AS name, a.facet AS facet, b.facet AS other, coalesce(list_filter(a.aliases, lambda x: NOT list_contains(coalesce(b.aliases, []), x)), []) AS missing, coalesce(list_filter(b.aliases, lambda x: NOT list_contains(coalesce(a.aliases, []), x)), []) AS extra FROM a FULL JOIN b ON a.name = b.name) SELECT * FROM j WHERE facet IS DISTINCT FROM other OR len(missing) > 0 OR len(extra) > 0", ("documents",))(lambda d: M.dictionary_drift(dictionary(d, 0), dictionary(d, 1)))


def dictionary(d, half):
    return d.where(F.col("source").isNotNull() & (F.pmod("doc_id", F.lit(2)) == half)).groupBy(c("source").alias("name")).agg(F.min("lang").alias("facet"), F.collect_set("lang").alias("aliases"))


query("j07_split_leak", "WITH s AS (SELECT url, 'a' AS st FROM old_links UNION ALL SELECT url, 'b' FROM new_links) SELECT url, count(DISTINCT st) AS sets FROM s GROUP BY url HAVING count(DISTINCT st) > 1", OLD_NEW)(lambda _, o, n: M.split_leak(o.select("url", F.lit("a").alias("set")).unionByName(n.select("url", F.lit("b").alias("set")))))
query("j08_board", f"SELECT id FROM links WHERE deleted_at IS NULL AND id <> (SELECT id FROM links WHERE deleted_at IS NULL AND opened_at IS NULL AND created_at <= {NOW} - 604800 ORDER BY (CAST(id AS HUGEINT) * 2654435761 % 4294967296 + {NOW // 86400}) % 4294967296, id LIMIT 1)", ("links",))(lambda l: board(l))  # noqa: E741


def board(l):  # noqa: E741
    from ..operators.activity import resurfaced
    from ..operators.tagging import live

    return M.board(live(l).select("id"), resurfaced(l, NOW), filtered=False)


query("j14_merge_poll", "SELECT coalesce(n.id, o.id) AS id, coalesce(n.title, o.title) AS title FROM old_links o FULL JOIN new_links n USING (id) WHERE id NOT IN (SELECT id FROM links WHERE id % 17 = 0)", OLD_NEW)(lambda l, o, n: M.merge_poll(o.select("id", "title"), n.select("id", "title"), l.where("id % 17 = 0")))  # noqa: E741
query("u03_union_sets", "SELECT url, title FROM old_links UNION ALL SELECT url, title FROM new_links WHERE url NOT IN (SELECT url FROM old_links)", OLD_NEW)(lambda _, o, n: M.union_sets(o.select("url", "title"), n.select("url", "title")))
EXPORT = "n AS (SELECT link_id, string_agg(name, ', ' ORDER BY name) AS tags FROM link_tags JOIN tags ON tags.id = tag_id GROUP BY link_id)"
ESC = "CASE WHEN regexp_matches({0}, '^[=+@-]') THEN '''' || {0} ELSE {0} END AS {0}"
query("s10_export_links", "WITH " + EXPORT + f" SELECT id, created_at AS saved, url, domain, {ESC.format('title')}, {ESC.format('description')}, coalesce(tags, '') AS tags, note, status FROM links LEFT JOIN n ON link_id = id WHERE deleted_at IS NULL", LLT)(M.export_links)
query("s11_label_candidates", "WITH " + EXPORT + " SELECT url, length(body_text) AS n, coalesce(tags, '') AS tags FROM links LEFT JOIN n ON link_id = id WHERE deleted_at IS NULL AND body_source = 'client' AND length(body_text) >= 200", LLT)(lambda *x: M.label_candidates(*x).select("url", F.length("snapshot.body_text").cast("long").alias("n"), F.array_join("current_tags", ", ").alias("tags")))
