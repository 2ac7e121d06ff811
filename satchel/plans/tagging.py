"""Queries of the tagging family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import tagging as T
from ..views import DOMAIN_TAGS
from .columns import TOKENS
from .registry import query

DOMAINS = [(h, t) for h, ts in DOMAIN_TAGS.items() if not h.startswith("_") for t in ts]
DOMAIN_SQL = "domain_map AS (SELECT * FROM (VALUES " + ", ".join(f"('{h}', '{t}')" for h, t in DOMAINS) + ") AS t(host, tag))"


def domain_map(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(DOMAINS, "host string, tag string")


FIELDS_SQL = """f AS (
 SELECT id AS link_id, unnest([{'field': 'title', 'x': title, 'w': 2.0}, {'field': 'keywords', 'x': keywords, 'w': 2.0}, {'field': 'description', 'x': description, 'w': 1.0}, {'field': 'note', 'x': note, 'w': 1.0}, {'field': 'body', 'x': body_text, 'w': 1.0}]) AS f FROM links
), t AS (SELECT link_id, f.field AS field, f.w AS w, """ + TOKENS.format("f.x") + """ AS tokens FROM f),
p AS (SELECT link_id, field, w, tokens, unnest(generate_series(1, len(tokens))) AS pos FROM t),
s AS (SELECT tag_id, tag, surface, """ + TOKENS.format("surface") + """ AS st FROM surfaces),
m AS (SELECT link_id, field, w, CAST(pos - 1 AS INTEGER) AS pos, tag_id, tag, array_to_string(st, ' ') AS surface FROM p JOIN s ON p.tokens[pos] = s.st[1] AND p.tokens[pos:pos + len(s.st) - 1] = s.st)"""  # fmt: skip
DOMAIN_HITS_SQL = DOMAIN_SQL + r""", hs AS (SELECT id AS link_id, string_split(domain, '.') AS l FROM links), hd AS (SELECT link_id, l, unnest(generate_series(0, greatest(len(l) - 2, 0))) AS depth FROM hs),
hit AS (SELECT link_id, depth, tag FROM hd JOIN domain_map ON host = array_to_string(l[depth + 1:], '.')),
dt AS (SELECT DISTINCT link_id, tag FROM hit QUALIFY depth = min(depth) OVER (PARTITION BY link_id))"""
SCORES_SQL = FIELDS_SQL + ", " + DOMAIN_HITS_SQL + """, a AS (
 SELECT link_id, tag_id, tag, field, any_value(w) * least(count(*), 3) AS capped, any_value(w) * count(*) AS whole, count(*) AS n FROM m GROUP BY ALL
), g0 AS (
 SELECT link_id, tag_id, tag, sum(capped) FILTER (WHERE field <> 'body') AS score, sum(whole) FILTER (WHERE field <> 'body') AS uncapped, sum(capped) FILTER (WHERE field = 'body') AS bc, sum(whole) FILTER (WHERE field = 'body') AS bw, max(n) FILTER (WHERE field = 'body') AS bn FROM a GROUP BY ALL
 UNION ALL SELECT link_id, tag_id, dt.tag, 3.0, 0, 0, 0, 0 FROM dt JOIN (SELECT DISTINCT tag_id, tag FROM surfaces) x ON x.tag = dt.tag
), g AS (
 SELECT link_id, tag_id, tag, coalesce(sum(score), 0) AS score, coalesce(sum(uncapped), 0) AS uncapped, coalesce(sum(bc), 0) AS bc, coalesce(sum(bw), 0) AS bw, coalesce(sum(bn), 0) AS bn FROM g0 GROUP BY ALL
), need AS (SELECT g.*, CASE WHEN score > 0 THEN least(1 + length(body_text) // 2000, 3, 2) ELSE least(1 + length(body_text) // 2000, 3) END AS need FROM g JOIN links ON id = link_id),
sc AS (SELECT link_id, tag_id, tag, CAST(score + CASE WHEN bn >= need THEN bc ELSE 0 END AS DOUBLE) AS score, CAST(uncapped + CASE WHEN bn >= need THEN bw ELSE 0 END AS DOUBLE) AS uncapped FROM need),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY link_id ORDER BY score DESC, uncapped DESC, tag) AS INTEGER) AS rank, 1 - 1 / (1 + score) AS confidence FROM sc WHERE score >= 1 QUALIFY rank <= 3)"""  # fmt: skip

query("j10_match_exact", "WITH " + FIELDS_SQL + " SELECT link_id, field, pos, tag_id, surface FROM m WHERE NOT contains(surface, ' ')", ("links", "surfaces"))(
    lambda links, s: T.match_exact(T.field_tokens(links), T.compile_surfaces(s)).select("link_id", "field", "pos", "tag_id", "surface")
)
#: The shared texts have no Hangul. Vowels stand in for syllables on both sides, so that every token of every text is judged at both its ends, by surfaces of two to eleven characters.
HANGUL = ("aeiou", "가나다라마")
EDGES = [(1, "that", "that"), (2, "with", "tion"), (3, "und", "und"), (4, "les", "en"), (5, "ofthe", "anderer"), (6, "los", "ment"), (7, "zzz", "oueuxquement")]
EDGE_SQL = f"""es AS (SELECT id AS tag_id, tag, translate(surface, '{HANGUL[0]}', '{HANGUL[1]}') AS surface FROM (VALUES {", ".join(map(str, EDGES))}) AS t(id, tag, surface)),
ef AS (SELECT link_id, f.field AS field, {TOKENS.format(f"translate(lower(f.x), '{HANGUL[0]}', '{HANGUL[1]}')")} AS tokens FROM (SELECT id AS link_id, unnest([{{'field': 'title', 'x': title}}, {{'field': 'body', 'x': body_text}}]) AS f FROM links)),
ep AS (SELECT link_id, field, tokens, unnest(generate_series(1, len(tokens))) AS pos FROM ef)"""
query("j11_match_edge", "WITH " + EDGE_SQL + " SELECT link_id, field, CAST(pos - 1 AS INTEGER) AS pos, tag_id, tag, surface FROM ep JOIN es ON starts_with(tokens[pos], surface) OR ends_with(tokens[pos], surface)", ("links",))(lambda links: edges(links))


def edges(links: DataFrame) -> DataFrame:
    hangul = lambda c: F.translate(F.lower(F.col(c)), *HANGUL)
    s = links.sparkSession.createDataFrame(EDGES, "tag_id int, tag string, surface string").withColumn("surface", hangul("surface"))
    tokens = T.field_tokens(links.withColumns({"title": hangul("title"), "body_text": hangul("body_text")}), {"title": "title", "body": "body_text"}, hangul=True)
    return T.match_edge(tokens, T.compile_surfaces(s))


query("j12_match_phrase", "WITH " + FIELDS_SQL + " SELECT link_id, field, pos, tag_id, surface FROM m WHERE contains(surface, ' ')", ("links", "surfaces"))(
    lambda links, s: T.match_whole(links, T.compile_surfaces(s).where("kind = 'phrase'")).select("link_id", "field", "pos", "tag_id", "surface")
)
query("j09_domain_tags", "WITH " + DOMAIN_HITS_SQL + " SELECT link_id, tag FROM dt", ("links",))(lambda links: T.domain_tags(links, domain_map(links)))
query("u02_matched_surfaces", "WITH " + FIELDS_SQL + " SELECT DISTINCT link_id, surface FROM m", ("links", "surfaces"))(lambda links, s: T.matches(links, T.compile_surfaces(s)).select("link_id", "surface").distinct())
query("a08_document_frequency", "WITH " + FIELDS_SQL + ", lt AS (SELECT DISTINCT link_id, surface FROM m) SELECT surface AS term, count(*) AS df, (SELECT count(DISTINCT link_id) FROM lt) AS n FROM lt GROUP BY surface", ("links", "surfaces"))(
    lambda links, s: T.document_frequency(T.matches(links, T.compile_surfaces(s)).select("link_id", F.col("surface").alias("term")))
)


def scores(links: DataFrame, s: DataFrame, df: DataFrame | None = None) -> DataFrame:
    hits = T.domain_tags(links, domain_map(links)).join(T.small(s.select("tag_id", "tag").distinct()), "tag")
    return T.tag_scores(T.matches(links, T.compile_surfaces(s)), links, hits, df)


query("a09_tag_scores", "WITH " + SCORES_SQL + " SELECT link_id, tag_id, tag, score, uncapped FROM sc", ("links", "surfaces"))(scores)
TOP_SQL = "SELECT link_id, tag_id, score, uncapped, round(confidence, 6) AS confidence, rank FROM top"
query("t1_tag_corpus", "WITH " + SCORES_SQL + " " + TOP_SQL, ("links", "surfaces"))(lambda links, s: T.tag_corpus(links, s, domain_map(links)).select("link_id", "tag_id", "score", "uncapped", F.round("confidence", 6).alias("confidence"), "rank"))
query("w01_top_tags", "WITH " + SCORES_SQL + " SELECT link_id, tag, rank FROM top", ("links", "surfaces"))(lambda links, s: T.top_tags(scores(links, s)).select("link_id", "tag", "rank"))
query("t1_count_by_tag", "WITH " + SCORES_SQL + " SELECT tag, count(*) AS links FROM top JOIN links ON id = link_id WHERE deleted_at IS NULL GROUP BY tag", ("links", "surfaces"))(
    lambda links, s: T.tag_corpus(T.live(links), s, domain_map(links)).groupBy("tag").agg(F.count(F.lit(1)).alias("links"))
)
query("j01_links_with_tag", "SELECT id FROM links WHERE id IN (SELECT link_id FROM link_tags JOIN tags ON tags.id = tag_id WHERE lower(name) = 'und')", ("links", "link_tags", "tags"))(lambda l, lt, t: T.with_tag(l, lt, t, "UND").select("id"))  # noqa: E741
query("j02_attach_tags", "WITH n AS (SELECT link_id, list_sort(list(name)) AS names FROM link_tags JOIN tags ON tags.id = tag_id GROUP BY link_id) SELECT id, names FROM links LEFT JOIN n ON id = link_id", ("links", "link_tags", "tags"))(
    lambda l, lt, t: T.attach_tags(l, lt, t).select("id", F.transform("tags", lambda x: x["name"]).alias("names"))  # noqa: E741
)
query("j16_tag_facets", "SELECT link_id, tag_id, coalesce(facet, 'neutral') AS facet FROM link_tags LEFT JOIN tags ON tags.id = tag_id AND tags.id <> 2", ("link_tags", "tags"))(lambda lt, t: T.tag_facets(lt, t.where("id <> 2")))
query("r47_live", "SELECT id FROM links WHERE deleted_at IS NULL", ("links",))(lambda l: T.live(l).select("id"))  # noqa: E741
query("r48_list_filter", "SELECT id FROM links WHERE deleted_at IS NULL AND status = 'done' AND opened_at IS NULL AND id IN (SELECT link_id FROM link_tags JOIN tags ON tags.id = tag_id WHERE name = 'with')", ("links", "link_tags", "tags"))(
    lambda *x: T.list_filter(*x, tag="with", status="done", unopened=True).select("id")
)
query("r49_created_between", "SELECT id FROM links WHERE created_at BETWEEN 1704500000 AND 1705500000", ("links",))(lambda l: T.created_between(l, 1704500000, 1705500000).select("id"))  # noqa: E741
query("w13_df_top", "WITH " + FIELDS_SQL + ", lt AS (SELECT DISTINCT link_id, surface FROM m), n AS (SELECT count(DISTINCT link_id) AS n FROM lt) SELECT surface AS term, count(*) AS df, round(count(*) / any_value(n.n), 6) AS ratio FROM lt, n GROUP BY surface ORDER BY df DESC, term LIMIT 5", ("links", "surfaces"))(
    lambda links, s: T.df_top(T.document_frequency(T.matches(links, T.compile_surfaces(s)).select("link_id", F.col("surface").alias("term"))), 5)
)
ABLATIONS = {"full": [], "no_body": ["body"], "no_keywords": ["keywords"], "bare": ["body", "keywords", "description"], "no_domain": ["domain"], "domain_only": ["title", "keywords", "description", "note", "body"]}
GOLD_SQL = "gold AS (SELECT doc_id AS link_id, CASE WHEN quality = 1 THEN 'that' ELSE 'und' END AS tag FROM labels UNION ALL SELECT doc_id, 'les' FROM labels WHERE toxic = 1)"


def gold(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").alias("link_id"), F.when(F.col("quality") == 1, "that").otherwise("und").alias("tag")).unionByName(labels.where("toxic = 1").select(F.col("doc_id").alias("link_id"), F.lit("les").alias("tag")))
