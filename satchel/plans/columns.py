"""One query for each column function that the shared tables can show."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, texts, tokens, urls
from ..views import FACETS, NOW
from .registry import columns, query

c = F.col
TOKEN = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
PARTICLE_SQL = "|".join(tokens.PARTICLES)
NORM = "CASE WHEN regexp_extract(t, '(" + PARTICLE_SQL + ")$', 1) <> '' AND length(t) - length(regexp_extract(t, '(" + PARTICLE_SQL + ")$', 1)) >= 2 THEN substr(t, 1, length(t) - length(regexp_extract(t, '(" + PARTICLE_SQL + ")$', 1))) ELSE t END"
TOKENS = "list_transform(" + TOKEN + ", lambda t: " + NORM + ")"
STOP = "[" + ", ".join(f"'{w}'" for w in tokens.STOPWORDS) + "]"
CONTENT = "list_sort(list_distinct(list_filter(" + TOKENS + ", lambda t: length(t) > 1 AND NOT list_contains(" + STOP + ", t))))"
HOST_SQL = r"lower(regexp_extract(url, '^[a-zA-Z]+://(?:[^/?#@]*@)?([^/:?#]+)', 1))"
MATCH = "(rtrim({0}, '.') = '{1}' OR rtrim({0}, '.') LIKE '%.{1}')"

columns("r01_is_http_url", "pages", "page_id", ok=(lambda: urls.is_http_url(c("url")), r"regexp_matches(url, '(?i)^https?://[^/?#]+')"))
columns("r02_url_hash", "pages", "page_id", url_hash=(lambda: urls.url_hash(c("url")), "sha256(url)"))
columns("r03_host_of", "pages", "page_id", host=(lambda: urls.host_of(c("url")), HOST_SQL))
columns("r04_host_matches", "page_links", "id", com=(lambda: urls.host_matches(c("host"), "example.com"), MATCH.format("host", "example.com")), org=(lambda: urls.host_matches(c("host"), "example.org"), MATCH.format("host", "example.org")))
columns("r05_content_type", "page_links", "id", content_type=(lambda: urls.content_type_of(c("host")), "CASE WHEN " + " OR ".join(MATCH.format("host", d) for d in ("youtube.com", "youtu.be", "vimeo.com")) + " THEN 'video' WHEN " + " OR ".join(MATCH.format("host", d) for d in ("twitter.com", "x.com", "instagram.com")) + " THEN 'post' ELSE 'article' END"))
columns("r06_mobile_host", "pages", "page_id", url=(lambda: urls.mobile_host_rewrite(c("url")), r"regexp_replace(url, '^(?i)(https?://)blog\.naver\.com([/:?#]|$)', '\1m.blog.naver.com\2')"))
columns("r08_is_watch", "pages", "page_id", watch=(lambda: urls.is_youtube_watch(c("url")), rf"(({HOST_SQL} = 'youtu.be' AND regexp_matches(url, '^[a-zA-Z]+://[^/?#]+/+[^/?#]')) OR ({HOST_SQL} IN ('youtube.com', 'www.youtube.com', 'm.youtube.com', 'music.youtube.com') AND regexp_matches(url, '^[a-zA-Z]+://[^/?#]+/watch\?([^#]*&)?v=[^&#]+')))"))
query(
    "r07_host_suffixes",
    r"""WITH b AS (SELECT id, string_split(regexp_replace(host, '^www\.', ''), '.') AS l FROM page_links), r AS (SELECT id, l, unnest(generate_series(0, greatest(len(l) - 2, 0))) AS depth FROM b)
SELECT id, CAST(depth AS INTEGER) AS depth, array_to_string(l[depth + 1:], '.') AS suffix FROM r""",
    ("page_links",),
)(lambda p: p.select("id", F.posexplode(urls.host_suffixes(c("host"))).alias("depth", "suffix")))
columns("r09_add_date", "links", "id", at=(lambda: codes.add_date_seconds((c("created_at") * F.when(c("id") % 2 == 0, 1_000_000).otherwise(1)).cast("string")), "CASE WHEN id % 2 = 0 THEN created_at ELSE created_at END"))
columns("r10_valid_created_at", "links", "id", ok=(lambda: codes.valid_created_at(c("created_at") + c("id") * 1000, NOW), f"(created_at + id * 1000 = 0 OR created_at + id * 1000 BETWEEN 946684800 AND {NOW})"))
#: The most characters of a text that fit into so many bytes.
FIT = "(SELECT max(k) FROM (SELECT unnest(generate_series(0, {1})) AS k) WHERE strlen(substr({0}, 1, CAST(k AS BIGINT))) <= {1})"
columns("r11_cap_bytes", "documents", "doc_id", cut=(lambda: texts.cap_bytes(c("text"), 301), "substr(text, 1, " + FIT.format("text", 301) + ")"))
columns("r12_sanitize", "documents", "doc_id", line=(lambda: texts.sanitize(c("text")), r"regexp_replace(translate(text, chr(10) || chr(9) || chr(13), '   '), '\p{Cc}', '', 'g')"))
columns("r13_clean", "documents", "doc_id", line=(lambda: texts.clean(c("text"), 512), r"trim(regexp_replace(translate(substr(text, 1, " + FIT.format("text", 512) + r"), chr(10) || chr(9) || chr(13) || chr(65533), '   '), '\p{Cc}', '', 'g'))"))
columns("r14_unescape", "pages", "page_id", text=(lambda: texts.unescape_entities(c("html")), "replace(replace(replace(replace(replace(replace(replace(replace(html, '&copy;', chr(169)), '&middot;', chr(183)), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&#39;', ''''), '&amp;', '&')"))
columns("r15_truncate", "links", "id", short=(lambda: texts.truncate_runes(c("body_text")), "substr(body_text, 1, 200)"))
columns("r16_is_thin", "links", "id", thin=(lambda: texts.is_thin(c("title"), c("description"), c("body_text")), "length(title) + length(description) + length(body_text) < 200"))
columns("r17_is_blocked", "links", "id", blocked=(lambda: texts.is_blocked_page(c("title"), c("description"), c("body_text")), "length(title || ' ' || description || ' ' || body_text) < 400 AND (" + " OR ".join(f"contains(lower(title || ' ' || description || ' ' || body_text), '{p}')" for p in texts.WALL_PHRASES) + ")"))
columns("r18_is_footer", "links", "id", footer=(lambda: texts.is_footer_only(c("body_text")), "length(body_text) > 0 AND length(body_text) < 1000 AND " + " + ".join(f"CAST(contains(lower(body_text), '{m}') AS INT)" for m in texts.FOOTER_MARKS) + " >= 3"))
columns("r27_normalize_token", "documents", "doc_id", words=(lambda: F.transform(F.split("text", " "), tokens.normalize_token), "list_transform(list_transform(string_split(text, ' '), lambda t: lower(regexp_replace(t, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g'))), lambda t: " + NORM + ")"))
columns("r28_tokenize", "documents", "doc_id", tokens=(lambda: tokens.tokenize(c("text")), TOKENS.format("text")))
columns("r29_has_hangul", "links", "id", hangul=(lambda: tokens.has_hangul(c("body_text")), "regexp_matches(body_text, '[가-힣]')"), korean=(lambda: tokens.is_korean(c("title"), c("description"), c("body_text")), "CASE WHEN length(regexp_replace(title || description || body_text, '[^가-힣A-Za-z]', '', 'g')) > 0 THEN length(regexp_replace(title || description || body_text, '[^가-힣]', '', 'g')) / length(regexp_replace(title || description || body_text, '[^가-힣A-Za-z]', '', 'g')) > 0.2 ELSE false END"))
CHARS = "string_split(lower({0}), '')"
#: Distinct trigrams of a list of characters.
THREES = "list_distinct(list_filter(list_transform(range(1, greatest(len({0}) - 1, 1)), lambda i: {0}[i] || {0}[i + 1] || {0}[i + 2]), lambda g: trim(g, ' ' || chr(10) || chr(9) || chr(13)) <> ''))"
query("r30_trigrams", "WITH x AS (SELECT id, " + CHARS.format("body_text") + " AS ch FROM links) SELECT id, list_sort(" + THREES.format("ch") + ") AS grams FROM x", ("links",))(lambda l: l.select("id", F.sort_array(tokens.trigrams(c("body_text"))).alias("grams")))  # noqa: E741
query("r31_split_sentences", None, ("documents",))(lambda d: d.select("doc_id", F.posexplode(tokens.split_sentences(c("text"))).alias("pos", "sentence")))
PROSE_SQL = r"""length({0}) BETWEEN 25 AND 400 AND regexp_matches({0}, '[.!?…。！？][\)\]\}}"''»”’]*$')
 AND length(regexp_replace({0}, '[^\p{{L}}]', '', 'g')) / length({0}) >= 0.55 AND length(regexp_replace({0}, '[^\p{{Nd}}]', '', 'g')) / length({0}) <= 0.12
 AND length(regexp_replace(regexp_replace({0}, '[,.''"?!()\-]', '', 'g'), '[^\p{{S}}\p{{P}}]', '', 'g')) / length({0}) <= 0.12
 AND length(regexp_replace({0}, '[^{{}}<>=;|\\()]', '', 'g')) <= 2"""
#: A run of four letters or more that comes twice in a row: looked for in every run of eight letters, at every place and length, since DuckDB has no back-references.
GLUED_SQL = "len(list_filter(regexp_extract_all({0}, '[A-Za-z]{{8,}}'), lambda w: len(list_filter(range(4, length(w) // 2 + 1), lambda n: len(list_filter(range(1, length(w) - 2 * n + 2), lambda i: substr(w, i, n) = substr(w, i + n, n))) > 0)) > 0)) > 0"
query(
    "r32_is_prose",
    "WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents) SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE " + PROSE_SQL.format("s") + " AND NOT " + GLUED_SQL.format("s") + ") AS prose FROM s GROUP BY doc_id",
    ("documents",),
)(lambda d: d.select("doc_id", F.explode(F.split("text", "\n")).alias("s")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(tokens.is_prose(c("s"))).alias("prose")))
# r32_is_prose judges lines, which DuckDB can cut too; this one the sentences
query("r32_prose_sentences", None, ("documents",))(lambda d: d.select("doc_id", F.explode(tokens.split_sentences(c("text"))).alias("s")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.count_if(tokens.is_prose(c("s"))).alias("prose")))
query("r33_glued_repeat", "SELECT doc_id, " + GLUED_SQL.format("text") + " AS glued FROM documents", ("documents",))(lambda d: d.select("doc_id", tokens.has_glued_repeat(c("text")).alias("glued")))
columns("r34_content_tokens", "documents", "doc_id", tokens=(lambda: tokens.content_tokens(c("text")), CONTENT.format("text")))
columns("r35_containment", "links", "id", share=(lambda: F.round(tokens.containment(tokens.content_tokens(c("description")), tokens.content_tokens(c("title"))), 6), "round(CASE WHEN len(" + CONTENT.format("description") + ") > 0 THEN len(list_intersect(" + CONTENT.format("description") + ", " + CONTENT.format("title") + ")) / len(" + CONTENT.format("description") + ") ELSE 0.0 END, 6)"))
columns("r36_confidence", "links", "id", confidence=(lambda: F.round(codes.confidence((c("id") % 9).cast("double")), 6), "round(1 - 1 / (1 + CAST(id % 9 AS DOUBLE)), 6)"))
columns("r37_idf", "links", "id", idf=(lambda: F.round(codes.idf_multiplier((c("id") % 40).cast("double"), (c("id") % 100 + 1).cast("double")), 6), "round(CASE WHEN id % 100 + 1 < 50 THEN 1.0 ELSE 0.35 + 0.65 * ln((id % 100 + 2.0) / (id % 40 + 1.0)) / ln(id % 100 + 2.0) END, 6)"))
columns("r38_neutral", "links", "id", facet=(lambda: codes.facet_or_neutral(F.when(c("id") % 2 == 0, "craft").otherwise(c("lang")), FACETS), "CASE WHEN id % 2 = 0 THEN 'craft' WHEN lang IN ('craft', 'life', 'money', 'neutral') THEN lang ELSE 'neutral' END"), status=(lambda: codes.status_normalise(c("keywords")), "coalesce(nullif(keywords, ''), 'neutral')"))
AGO, GAP = f"({NOW} - created_at)", f"(CAST({NOW} // 86400 AS BIGINT) - created_at // 86400)"
DAY = "(DATE '1970-01-01' + CAST(created_at // 86400 AS INTEGER))"
RELATIVE = f"CASE WHEN {AGO} < 60 THEN 'just_now' WHEN {AGO} < 3600 THEN 'minutes:' || ({AGO} // 60) WHEN {AGO} < 86400 THEN 'hours:' || ({AGO} // 3600) WHEN {GAP} = 1 THEN 'yesterday' ELSE 'date:' || month({DAY}) || '-' || day({DAY}) END"
columns("r39_relative_time", "links", "id", plain=(lambda: codes.relative_time(c("created_at"), NOW), RELATIVE), stated=(lambda: codes.relative_time(c("created_at"), NOW, day_stated=True), f"CASE WHEN {GAP} = 1 THEN 'time:' || (created_at % 86400 // 3600) || ':' || lpad(CAST(created_at % 3600 // 60 AS VARCHAR), 2, '0') WHEN {GAP} > 1 THEN 'date:' || month({DAY}) || '-' || day({DAY}) ELSE {RELATIVE} END"))
columns("r40_time_group", "links", "id", grp=(lambda: codes.time_group(c("created_at"), NOW + 5 * 86400), f"CASE WHEN {GAP} + 5 <= 0 THEN 'today' WHEN {GAP} + 5 = 1 THEN 'yesterday' WHEN {GAP} + 5 <= 6 THEN 'week' ELSE 'm-' || year({DAY}) || '-' || month({DAY}) END"))
columns("r41_period_from", "links", "id", at=(lambda: codes.period_from(F.when(c("id") % 3 == 0, "7d").when(c("id") % 3 == 1, "30d").otherwise("year"), NOW), f"CAST(CASE id % 3 WHEN 0 THEN {NOW} - 604800 WHEN 1 THEN {NOW} - 2592000 ELSE 1704067200 END AS BIGINT)"))
columns("r42_escape_formula", "links", "id", safe=(lambda: texts.escape_formula(F.when(c("id") % 2 == 0, F.concat(F.lit("="), c("title"))).otherwise(c("title"))), "CASE WHEN id % 2 = 0 THEN '''=' || title WHEN regexp_matches(title, '^[=+@-]') THEN '''' || title ELSE title END"))
columns("r43_cursor", "links", "id", cursor=(lambda: codes.cursor_encode("list", c("created_at"), c("id")), "rtrim(translate(base64(encode('list:' || created_at || ':' || id)), '+/', '-_'), '=')"), back=(lambda: codes.cursor_decode("list", codes.cursor_encode("list", c("created_at"), c("id")))["b"], "id"))
columns("r44_checked", "links", "id", checked=(lambda: codes.checked(F.when(c("id") % 3 == 0, " Yes ").when(c("id") % 3 == 1, "no").otherwise("✓")), "id % 3 <> 1"))
columns("r45_command_key", "links", "id", command_key=(lambda: codes.command_key(c("id"), c("status"), c("title")), "substr(sha256(id || chr(0) || status || chr(0) || title), 1, 24)"))
columns("r46_fill_empty", "links", "id", keywords=(lambda: texts.fill_empty(c("keywords"), c("title")), "coalesce(nullif(keywords, ''), title)"))
columns("r50_status_class", "links", "id", cls=(lambda: codes.status_class(c("status"), F.when(c("id") % 22 == 0, "waiting").otherwise("none")), "CASE WHEN id % 22 = 0 THEN 'retry_waiting' WHEN status = 'failed' THEN 'failed' WHEN status = 'pending' THEN 'progress' ELSE '' END"))
