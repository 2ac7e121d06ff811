"""Queries of search and of tagging quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import search as S
from ..operators import tagging as T
from ..operators import vectors as V
from ..storage import stored
from .registry import query
from .tagging import ABLATIONS, GOLD_SQL, SCORES_SQL, domain_map, gold, scores

c = F.col
LLT = ("links", "link_tags", "tags")
DOCS = "sn AS (SELECT link_id, string_agg(name, ' ' ORDER BY name) AS tags FROM link_tags JOIN tags ON tags.id = tag_id GROUP BY link_id), sd AS (SELECT id AS doc_id, title, trim(description || ' ') AS description, note, coalesce(sn.tags, '') AS tags, created_at FROM links LEFT JOIN sn ON link_id = id WHERE deleted_at IS NULL)"
query("t2_search_documents", "WITH " + DOCS + " SELECT doc_id, title, description, note, tags FROM sd", LLT)(lambda *x: S.search_documents(*x).drop("created_at"))
#: The trigrams of each column at their places, from a list of its characters.
GRAMS = """g AS MATERIALIZED (SELECT doc_id, f.col AS col, lower(f.x) AS x, string_split(lower(f.x), '') AS ch FROM (SELECT doc_id, unnest([{'col': 'title', 'x': title}, {'col': 'description', 'x': description}, {'col': 'note', 'x': note}, {'col': 'tags', 'x': tags}]) AS f FROM sd)),
pg0 AS (SELECT doc_id, col, unnest(list_transform(generate_series(1, greatest(len(ch) - 2, 0)), lambda i: {'pos': i, 'gram': ch[i] || ch[i + 1] || ch[i + 2]})) AS u FROM g),
pg AS (SELECT doc_id, col, u.pos AS pos, u.gram AS gram FROM pg0 WHERE trim(u.gram, ' ' || chr(10) || chr(9) || chr(13)) <> '')"""
query("t3_postings", "WITH " + DOCS + ", " + GRAMS + " SELECT DISTINCT gram, doc_id, col FROM pg", LLT)(lambda *x: S.build_postings(S.search_documents(*x)))
query("t3_doc_lengths", "WITH " + DOCS + " SELECT doc_id, CAST(greatest(length(title) - 2, 0) + greatest(length(description) - 2, 0) + greatest(length(note) - 2, 0) + greatest(length(tags) - 2, 0) AS INTEGER) AS len FROM sd", LLT)(lambda *x: S.doc_lengths(S.search_documents(*x)))
QUERY_SQL = "q AS (SELECT item_id AS query_id, replace(text, chr(10), ' ') AS query FROM benchmark)"
SEARCH_SQL = DOCS + ", " + QUERY_SQL + ", " + GRAMS + """, w AS (SELECT query_id, unnest(list_distinct(list_filter(string_split(lower(query), ' '), lambda x: x <> ''))) AS word FROM q),
a AS (SELECT query_id, word AS phrase FROM w WHERE length(word) >= 3), nd AS (SELECT query_id, count(*) AS needed FROM a GROUP BY query_id),
ph AS (SELECT DISTINCT phrase FROM a),
h AS (SELECT phrase, pg.doc_id, count(*) AS f FROM pg JOIN ph ON pg.gram = substr(phrase, 1, 3) JOIN g ON g.doc_id = pg.doc_id AND g.col = pg.col WHERE length(phrase) = 3 OR substr(x, pos, length(phrase)) = phrase GROUP BY ALL),
hh AS (SELECT * FROM h WHERE f > 0), ln AS (SELECT doc_id, greatest(length(title) - 2, 0) + greatest(length(description) - 2, 0) + greatest(length(note) - 2, 0) + greatest(length(tags) - 2, 0) AS len FROM sd),
tt AS (SELECT count(*) AS n, avg(len) AS al FROM ln), dfq AS (SELECT phrase, count(*) AS df FROM hh GROUP BY phrase),
wt AS (SELECT phrase, doc_id, -greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / al)) AS wgt FROM hh JOIN dfq USING (phrase) JOIN ln USING (doc_id) CROSS JOIN tt),
sc AS (SELECT query_id, doc_id, sum(wgt) AS bm, count(*) AS got FROM a JOIN wt USING (phrase) GROUP BY ALL),
f1 AS (SELECT query_id, doc_id, 'fts' AS mode, bm FROM sc JOIN nd USING (query_id) WHERE got = needed),
f2 AS (SELECT query_id, doc_id, 'or' AS mode, bm FROM sc WHERE query_id NOT IN (SELECT query_id FROM f1)), fo AS (SELECT * FROM f1 UNION ALL SELECT * FROM f2),
lt2 AS (SELECT query_id, list(word) AS terms FROM w GROUP BY query_id),
rk AS (SELECT fo.query_id, fo.doc_id, mode, bm - 1000 * CASE WHEN len(terms) >= 2 THEN len(list_filter(terms, lambda t: contains(lower(title || ' ' || description || ' ' || tags), t))) ELSE 0 END AS rank FROM fo JOIN lt2 USING (query_id) JOIN sd USING (doc_id)),
res AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 9), doc_id) AS INTEGER) AS position FROM rk)"""  # fmt: skip


def batch(b):
    """Every item of the benchmark, whole, is a query."""
    return b.select(c("item_id").alias("query_id"), F.translate("text", "\n", " ").alias("query"))


SEARCHED = (*LLT, "benchmark")
query("t4_search", "WITH " + SEARCH_SQL + " SELECT query_id, doc_id, mode, round(rank, 6) AS rank FROM res", SEARCHED)(lambda l, lt, t, b: S.candidates(batch(b), S.search_documents(l, lt, t)).select("query_id", "doc_id", "mode", F.round("rank", 6).alias("rank")))  # noqa: E741
query("t4_search_expanded", None, (*SEARCHED, "surfaces"))(lambda l, lt, t, b, s: S.search(batch(b), S.search_documents(l, lt, t), s))  # noqa: E741
LIKE_SQL = "lq AS (SELECT item_id AS query_id, list_distinct(list_filter(string_split(replace(lower(text), chr(10), ' '), ' '), lambda x: length(x) BETWEEN 1 AND 2)) AS w FROM benchmark), tx AS (SELECT doc_id, created_at, lower(title || chr(10) || description || chr(10) || note) AS x FROM sd), jn AS (SELECT query_id, doc_id, created_at, len(list_filter(w, lambda t: contains(x, t))) AS n, len(w) AS m FROM lq CROSS JOIN tx), j AS (SELECT query_id, doc_id, created_at, n = m AS every FROM jn WHERE n > 0), k AS (SELECT * FROM j QUALIFY every OR NOT max(every) OVER (PARTITION BY query_id))"


def short_words(b):
    """All words of one or two letters of an item: queries that have no gram."""
    return b.select(c("item_id").alias("query_id"), F.array_distinct(F.filter(F.split(F.translate(F.lower("text"), "\n", " "), " "), lambda w: F.length(w).between(1, 2))).alias("w")).where(F.size("w") > 0)


query("t4_like_search", "WITH " + DOCS + ", " + LIKE_SQL + " SELECT query_id, doc_id, 'like' AS mode, CAST(row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, doc_id DESC) AS INTEGER) AS position FROM k", SEARCHED)(lambda l, lt, t, b: S.like_search(short_words(b), S.search_documents(l, lt, t)).drop("rank"))  # noqa: E741
query("a15_search_quality", "WITH " + SEARCH_SQL + ", an AS (SELECT query_id, query_id * 3 AS doc_id FROM q UNION ALL SELECT query_id, min(doc_id) FROM res GROUP BY query_id), r AS (SELECT an.query_id, min(position) AS p FROM an LEFT JOIN res ON res.query_id = an.query_id AND res.doc_id = an.doc_id AND position <= 10 GROUP BY 1) SELECT round(avg(CASE WHEN p = 1 THEN 1 ELSE 0 END), 6) AS hit1, round(avg(coalesce(1 / p, 0)), 6) AS mrr, count(p) AS reached, count(*) AS queries FROM r", SEARCHED)(lambda l, lt, t, b: quality(stored(S.candidates(batch(b), S.search_documents(l, lt, t)), "results"), b))  # noqa: E741


def quality(found, b):
    answers = batch(b).select("query_id", (c("query_id") * 3).alias("doc_id")).unionByName(found.groupBy("query_id").agg(F.min("doc_id").alias("doc_id")))
    return S.search_quality(S.with_positions(found, 10), answers).select(F.round("hit1", 6).alias("hit1"), F.round("mrr", 6).alias("mrr"), "reached", "queries")


UNIT = "SELECT vec_id, list_transform(embedding::DOUBLE[], lambda e: e / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS v FROM embeddings"
query("j15_cosine_knn", f"WITH u AS ({UNIT}), p AS (SELECT q.vec_id AS query_id, d.vec_id, round(list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2])), 6) AS score FROM u q JOIN u d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id) SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p QUALIFY rank <= 5", ("embeddings",))(lambda e: S.cosine_knn(e.where("vec_id % 20 = 0"), e, 5))

query("j15_bucketed_knn", None, ("embeddings",))(lambda e: V.bucketed_knn(e.where("vec_id % 20 = 0"), e, 5))

LS, LSL = ("links", "surfaces"), ("links", "surfaces", "labels")
PRED = "WITH " + SCORES_SQL + ", " + GOLD_SQL
query("a10_recall_at_k", PRED + ", h AS (SELECT gold.link_id, max(CASE WHEN rank IS NOT NULL THEN 1 ELSE 0 END) AS hit FROM gold LEFT JOIN top USING (link_id, tag) GROUP BY 1) SELECT round(avg(hit), 6) AS recall, count(*) AS links FROM h", LSL)(lambda l, s, g: E.recall_at_k(T.tag_corpus(l, s, domain_map(l)), gold(g), 3))  # noqa: E741
query("a12_tag_precision_recall", PRED + ", j AS (SELECT coalesce(top.tag, gold.tag) AS tag, top.tag IS NOT NULL AS p, gold.tag IS NOT NULL AS g FROM top FULL JOIN gold ON gold.link_id = top.link_id AND gold.tag = top.tag), r AS (SELECT tag, count(*) FILTER (WHERE p AND g) AS tp, count(*) FILTER (WHERE p AND NOT g) AS fp, count(*) FILTER (WHERE NOT p AND g) AS fn, count(*) FILTER (WHERE g) AS gold FROM j GROUP BY tag) SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall FROM r", LSL)(lambda l, s, g: E.tag_precision_recall(T.tag_corpus(l, s, domain_map(l)), gold(g)))  # noqa: E741
query("a13_miss_anatomy", PRED + ", rk AS (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY score DESC, uncapped DESC, tag) AS rank FROM sc WHERE score >= 1), att AS (SELECT link_id, max(score) FILTER (WHERE rank = 3) AS a, max(score) FILTER (WHERE rank = 4) AS b FROM rk GROUP BY 1), gg AS (SELECT gold.link_id, min(rank) AS best FROM gold LEFT JOIN rk USING (link_id, tag) GROUP BY 1) SELECT count(*) FILTER (WHERE a = b) AS tied, count(*) FILTER (WHERE best IS NULL) AS zero, count(*) FILTER (WHERE best > 3) AS outranked, count(best) AS reachable, count(*) AS links FROM gg LEFT JOIN att USING (link_id)", LSL)(lambda l, s, g: E.miss_anatomy(scores(l, s), gold(g)))  # noqa: E741
query("a14_eval_slices", PRED + ", h AS (SELECT gold.link_id, max(CASE WHEN rank IS NOT NULL THEN 1 ELSE 0 END) AS hit FROM gold LEFT JOIN top USING (link_id, tag) GROUP BY 1) SELECT lang, body_source, length(title) + length(description) + length(body_text) < 1000 AS thin, keywords <> '' AS has_keywords, count(*) AS links, round(avg(hit), 6) AS recall FROM h JOIN links ON id = link_id GROUP BY ALL", LSL)(lambda l, s, g: slices(l, s, g))  # noqa: E741


def slices(l, s, g):  # noqa: E741
    p = T.tag_corpus(l, s, domain_map(l)).select("link_id", "tag", F.lit(1).alias("hit"))
    hit = gold(g).join(p, ["link_id", "tag"], "left").groupBy("link_id").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    flags = hit.join(l.select(c("id").alias("link_id"), "lang", "body_source", (F.length("title") + F.length("description") + F.length("body_text") < 1000).alias("thin"), (c("keywords") != "").alias("has_keywords")), "link_id")
    return E.eval_slices(flags, "lang", "body_source", "thin", "has_keywords")


VARIANTS = ", ".join(f"('{v}', {off}::VARCHAR[])" for v, off in ABLATIONS.items())
ABLATION_SQL = "WITH " + SCORES_SQL + ", " + GOLD_SQL + f""", v AS (SELECT * FROM (VALUES {VARIANTS}) AS t(variant, off)),
va AS (SELECT variant, link_id, tag_id, tag, field, any_value(w) * least(count(*), 3) AS capped, any_value(w) * count(*) AS whole, count(*) AS n FROM m JOIN v ON NOT list_contains(off, field) GROUP BY ALL),
vg0 AS (SELECT variant, link_id, tag_id, tag, sum(capped) FILTER (WHERE field <> 'body') AS score, sum(whole) FILTER (WHERE field <> 'body') AS uncapped, sum(capped) FILTER (WHERE field = 'body') AS bc, sum(whole) FILTER (WHERE field = 'body') AS bw, max(n) FILTER (WHERE field = 'body') AS bn FROM va GROUP BY ALL
 UNION ALL SELECT variant, link_id, tag_id, dt.tag, 3.0, 0, 0, 0, 0 FROM dt JOIN (SELECT DISTINCT tag_id, tag FROM surfaces) x ON x.tag = dt.tag JOIN v ON NOT list_contains(off, 'domain')),
vg AS (SELECT variant, link_id, tag_id, tag, coalesce(sum(score), 0) AS score, coalesce(sum(uncapped), 0) AS uncapped, coalesce(sum(bc), 0) AS bc, coalesce(sum(bw), 0) AS bw, coalesce(sum(bn), 0) AS bn FROM vg0 GROUP BY ALL),
vn AS (SELECT vg.*, 1 + CASE WHEN list_contains(off, 'body') THEN 0 ELSE length(body_text) // 2000 END AS k FROM vg JOIN v USING (variant) JOIN links ON id = link_id),
vs AS (SELECT variant, link_id, tag, score + CASE WHEN bn >= CASE WHEN score > 0 THEN least(k, 2) ELSE least(k, 3) END THEN bc ELSE 0 END AS score, uncapped + CASE WHEN bn >= CASE WHEN score > 0 THEN least(k, 2) ELSE least(k, 3) END THEN bw ELSE 0 END AS uncapped FROM vn),
vt AS (SELECT *, row_number() OVER (PARTITION BY variant, link_id ORDER BY score DESC, uncapped DESC, tag) AS rank FROM vs WHERE score >= 1 QUALIFY rank <= 3),
vh AS (SELECT variant, gold.link_id, max(CASE WHEN rank IS NOT NULL THEN 1 ELSE 0 END) AS hit FROM gold CROSS JOIN (SELECT DISTINCT variant FROM vt) LEFT JOIN vt USING (variant, link_id, tag) GROUP BY ALL)
SELECT variant, round(avg(hit), 6) AS recall, count(*) AS links FROM vh GROUP BY variant"""  # fmt: skip
query("a11_ablation", ABLATION_SQL, LSL)(lambda l, s, g: E.ablation(l, s, domain_map(l), gold(g), ABLATIONS))  # noqa: E741
T7_SQL = PRED + """, rk AS (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY score DESC, uncapped DESC, tag) AS rank FROM sc WHERE score >= 1), att AS (SELECT link_id, max(score) FILTER (WHERE rank = 3) AS a, max(score) FILTER (WHERE rank = 4) AS b FROM rk GROUP BY 1), gg AS (SELECT gold.link_id, min(rank) AS best FROM gold LEFT JOIN rk USING (link_id, tag) GROUP BY 1),
fl AS (SELECT coalesce(lang, 'none') AS st, length(title) + length(description) + length(body_text) < 1000 AS thin, body_source, keywords <> '' AS has_keywords, best, a, b FROM gg LEFT JOIN att USING (link_id) JOIN links ON id = gg.link_id)
SELECT st AS "set", CASE WHEN grouping(thin) = 0 THEN 'thin' WHEN grouping(body_source) = 0 THEN 'body_source' WHEN grouping(has_keywords) = 0 THEN 'has_keywords' ELSE 'all' END AS slice, CASE WHEN grouping(thin) = 0 THEN CAST(thin AS VARCHAR) WHEN grouping(body_source) = 0 THEN body_source WHEN grouping(has_keywords) = 0 THEN CAST(has_keywords AS VARCHAR) END AS value,
round(avg(CASE WHEN best <= 3 THEN 1 ELSE 0 END), 6) AS recall, count(*) FILTER (WHERE a = b) AS tied, count(*) FILTER (WHERE best IS NULL) AS zero, count(*) FILTER (WHERE best > 3) AS outranked, count(best) AS reachable, count(*) AS links FROM fl GROUP BY GROUPING SETS ((st), (st, thin), (st, body_source), (st, has_keywords))"""  # fmt: skip


def facts(l):  # noqa: E741
    """Sets by language, and what tells thin, client and keyword links from the others."""
    return l.select(c("id").alias("link_id"), F.coalesce("lang", F.lit("none")).alias("set"), (F.length("title") + F.length("description") + F.length("body_text") < 1000).alias("thin"), "body_source", (c("keywords") != "").alias("has_keywords"))


query("t7_eval_tagging", T7_SQL, LSL)(lambda l, s, g: E.eval_tagging(scores(l, s), gold(g), s.select("tag"), facts(l), "thin", "body_source", "has_keywords"))  # noqa: E741
query("a15_search_misses", "WITH " + SEARCH_SQL + ", an AS (SELECT query_id, query_id * 3 AS doc_id FROM q) SELECT an.query_id, an.doc_id, position FROM an LEFT JOIN res USING (query_id, doc_id) WHERE coalesce(position, 11) > 10", SEARCHED)(lambda l, lt, t, b: misses(S.candidates(batch(b), S.search_documents(l, lt, t)), batch(b).select("query_id", (c("query_id") * 3).alias("doc_id"))))  # noqa: E741


def misses(found, answers):
    return S.search_misses(S.positions_of(found, answers), answers)


query("t4_search_filtered", "WITH " + SEARCH_SQL + ", al AS (SELECT doc_id FROM sd WHERE created_at BETWEEN 1704500000 AND 1706000000 AND doc_id IN (SELECT link_id FROM link_tags JOIN tags ON tags.id = tag_id WHERE name = 'with')), fs AS (SELECT * FROM sc WHERE doc_id IN (SELECT doc_id FROM al)), g1 AS (SELECT query_id, doc_id, 'fts' AS mode, bm FROM fs JOIN nd USING (query_id) WHERE got = needed), g2 AS (SELECT query_id, doc_id, 'or' AS mode, bm FROM fs WHERE query_id NOT IN (SELECT query_id FROM g1)), go AS (SELECT * FROM g1 UNION ALL SELECT * FROM g2), gr AS (SELECT go.query_id, go.doc_id, mode, bm - 1000 * CASE WHEN len(terms) >= 2 THEN len(list_filter(terms, lambda t: contains(lower(title || ' ' || description || ' ' || tags), t))) ELSE 0 END AS rank FROM go JOIN lt2 USING (query_id) JOIN sd USING (doc_id)), gp AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 9), doc_id) AS INTEGER) AS position FROM gr) SELECT query_id, doc_id, mode, position FROM gp WHERE position BETWEEN 6 AND 15", SEARCHED)(lambda l, lt, t, b: filtered(l, lt, t, b))  # noqa: E741


def filtered(l, lt, t, b):  # noqa: E741
    """The second page of ten behind place 5, of links with a tag from a range of days."""
    only = T.with_tag(l, lt, t, "with").select(c("id").alias("doc_id"))
    after = batch(b).select("query_id", F.lit(5).alias("position"))
    return S.search(batch(b), S.search_documents(l, lt, t), only=only, since=1704500000, until=1706000000, after=after, size=10).select("query_id", "doc_id", "mode", "position")


query("j05_unknown_labels", "WITH " + GOLD_SQL + " SELECT link_id, tag FROM gold WHERE tag NOT IN (SELECT name FROM tags WHERE id <> 4)", ("labels", "tags"))(lambda g, t: E.unknown_labels(gold(g), t.where("id <> 4").select(c("name").alias("tag"))).select("link_id", "tag"))
