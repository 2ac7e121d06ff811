"""Tagging a corpus against a controlled dictionary, with field weights and document frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import confidence, idf_multiplier
from ..functions.tokens import composed, has_hangul, tokenize
from ..functions.urls import host_suffixes
from .summaries import once

#: Weight of a field's matches; the domain's is per mapped tag (fixed values).
WEIGHTS = {"title": 2.0, "keywords": 2.0, "description": 1.0, "note": 1.0, "body": 1.0}
DOMAIN_WEIGHT, MATCH_CAP, THRESHOLD = 3.0, 3, 1.0


def small(df: DataFrame) -> DataFrame:
    """A dictionary table, hinted for broadcast: it is written by hand, tens to thousands of rows at any size of the archive."""
    return F.broadcast(df)


def compile_surfaces(surfaces: DataFrame) -> DataFrame:
    """surfaces(tag_id, tag, surface) -> tag_id, tag, kind (exact, edge, phrase), first, tail, surface, entry.

    Each name or alias stays an entry of its own, even when two of a tag are tokenised alike.
    """
    t = surfaces.withColumn("tokens", tokenize(F.col("surface"))).where(F.size("tokens") > 0)
    one = F.size("tokens") == 1
    edge = one & has_hangul(F.col("tokens")[0]) & (F.length(F.col("tokens")[0]) >= 2)
    kind = F.when(~one, "phrase").when(edge, "edge").otherwise("exact")
    return t.select("tag_id", "tag", kind.alias("kind"), F.col("tokens")[0].alias("first"), F.slice("tokens", F.lit(2), F.size("tokens")).alias("tail"), F.array_join("tokens", " ").alias("surface"), F.monotonically_increasing_id().alias("entry"))


FIELDS = {"title": "title", "keywords": "keywords", "description": "description", "note": "note", "body": "body_text"}


def _texts(links: DataFrame, fields: dict[str, str] | None) -> DataFrame:
    """link_id, field, text. Fields stay apart, so no phrase crosses them."""
    both = [F.struct(F.lit(f).alias("field"), F.col(c).alias("text")) for f, c in (fields or FIELDS).items()]
    return links.select(F.col("id").alias("link_id"), F.explode(F.array(*both)).alias("f")).select("link_id", "f.field", "f.text")


def field_tokens(links: DataFrame, fields: dict[str, str] | None = None, *, hangul: bool = False) -> DataFrame:
    """links -> link_id, field, pos, token, next (the token behind it, if any). hangul: only fields that have any."""
    t = _texts(links, fields)
    t = t.where(has_hangul(F.col("text"))) if hangul else t
    t = t.select("link_id", "field", tokenize(F.col("text")).alias("tokens"))
    t = t.select("link_id", "field", F.arrays_zip(F.col("tokens").alias("token"), F.slice("tokens", 2, 2_147_483_647).alias("next")).alias("pairs"))
    return t.select("link_id", "field", F.posexplode("pairs").alias("pos", "pair")).select("link_id", "field", "pos", "pair.token", "pair.next")


def match_exact(tokens: DataFrame, compiled: DataFrame) -> DataFrame:
    s = small(compiled.where("kind = 'exact'").select("tag_id", "tag", "surface", F.col("first").alias("token")))
    return tokens.join(s, "token").select("link_id", "field", "pos", "tag_id", "tag", "surface")


def match_edge(tokens: DataFrame, compiled: DataFrame) -> DataFrame:
    """Hangul surfaces at a token's beginning or end, once per token and entry. Pieces of the lengths that occur in the dictionary make it an equi join; the dictionary,
    written by hand, comes to the driver, so that only pieces that it holds become rows."""
    s = small(compiled.where("kind = 'edge'").select("tag_id", "tag", "surface", "entry", F.col("first").alias("piece")))
    known = sorted({r.piece for r in s.select("piece").collect()})
    tokens = tokens if known else tokens.where(F.lit(False))  # without such surfaces no text is read
    ends = F.array(*[end(F.col("token"), F.lit(n)) for n in sorted({len(k) for k in known}) for end in (F.left, F.right)]).cast("array<string>")  # of a shorter token, all of it
    held = F.array_distinct(F.filter(ends, lambda p: p.isin(known)))
    pieces = tokens.where(has_hangul(F.col("token"))).select("link_id", "field", "pos", F.explode(held).alias("piece"))
    return pieces.join(s, "piece").select("link_id", "field", "pos", "tag_id", "tag", "surface")


def _fits(token: Column, wanted: Column, ko: Column) -> Column:
    """A token of a phrase's tail: equal, or longer where the wanted one has Hangul."""
    return (token == wanted) | (ko & token.startswith(wanted))


def match_whole(links: DataFrame, compiled: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """Exact surfaces, and surfaces of several tokens in a row: the first is equal, a Hangul token of the tail may be longer.

    The dictionary's first words, written by hand, come to the driver. A text is cut once, in its own row; of its tokens only those that begin a surface become rows, each with
    as many tokens behind it as the longest surface from that word has, so that whole phrases are held against it in the join.
    """
    s = small(compiled.where("kind <> 'edge'").select("tag_id", "tag", "surface", "tail", F.col("first").alias("token")))
    lengths: dict[int, list[str]] = {}
    for r in s.groupBy("token").agg(F.max(F.size("tail")).alias("n")).collect():
        lengths.setdefault(r.n + 1, []).append(r.token)
    begins = lambda w, i: F.coalesce(*[F.when(w.isin(firsts), F.struct(i.alias("pos"), F.slice("tokens", i + 1, n).alias("words"))) for n, firsts in sorted((lengths or {1: []}).items())])
    cut = once(_texts(links, fields), tokens=tokenize(F.col("text")))
    met = cut.select("link_id", "field", F.explode(F.filter(F.transform("tokens", begins), lambda x: x.isNotNull())).alias("m")).select("link_id", "field", "m.pos", "m.words", F.col("m.words")[0].alias("token"))
    after = F.slice("words", F.lit(2), F.size("tail"))
    whole = (F.size(after) == F.size("tail")) & F.forall(F.zip_with(after, "tail", lambda a, b: F.coalesce(_fits(a, b, has_hangul(b)), F.lit(False))), lambda x: x)
    return met.join(s, "token").where((F.size("tail") == 0) | whole).select("link_id", "field", "pos", "tag_id", "tag", "surface")


def matches(links: DataFrame, compiled: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """All matches: whole surfaces in one pass, edges in a second one over the fields with Hangul."""
    return match_whole(links, compiled, fields).unionByName(match_edge(field_tokens(links, fields, hangul=True), compiled))


def domain_tags(links: DataFrame, domain_map: DataFrame) -> DataFrame:
    """links(id, domain), domain_map(host, tag) -> link_id, tag; the most specific mapped suffix wins."""
    c = links.select(F.col("id").alias("link_id"), F.posexplode(host_suffixes(F.col("domain"))).alias("depth", "host"))
    hit = c.join(small(domain_map), "host")
    best = Window.partitionBy("link_id")
    return hit.withColumn("best", F.min("depth").over(best)).where("depth = best").select("link_id", "tag").distinct()


def field_counts(found: DataFrame, df: DataFrame | None = None) -> DataFrame:
    """matches -> link_id, tag_id, tag, field, n, mul. df(term, df, n): document frequencies, off by default."""
    if df is not None:
        found = found.join(df, found["surface"] == df["term"], "left").withColumn("mul", F.coalesce(idf_multiplier(F.col("df"), F.col("n")), F.lit(1.0)))
    else:
        found = found.withColumn("mul", F.lit(1.0))
    return found.groupBy("link_id", "tag_id", "tag", "field").agg(F.count(F.lit(1)).alias("n"), F.max("mul").alias("mul"))


def tag_scores(found: DataFrame, links: DataFrame, domain_hits: DataFrame, df: DataFrame | None = None) -> DataFrame:
    """matches -> link_id, tag_id, tag, score, uncapped. df(term, df, n): document frequencies, off by default."""
    return count_scores(field_counts(found, df), links, domain_hits)


def count_scores(per: DataFrame, links: DataFrame, domain_hits: DataFrame, *by: str) -> DataFrame:
    """tag_scores from field_counts; by: more columns of per and domain_hits that keep their rows apart."""
    weight = F.lit(0.0)
    for f, w in WEIGHTS.items():
        weight = F.when(F.col("field") == f, w).otherwise(weight)
    per = per.withColumn("capped", weight * F.least("n", F.lit(MATCH_CAP)) * F.col("mul")).withColumn("whole", weight * F.col("n") * F.col("mul"))
    body, keys = F.col("field") == "body", [*by, "link_id", "tag_id", "tag"]
    part = lambda c, b: F.coalesce(F.sum(F.when(body == b, F.col(c))), F.lit(0.0))
    g = per.groupBy(*keys).agg(part("capped", False).alias("score"), part("whole", False).alias("uncapped"), part("capped", True).alias("body_score"), part("whole", True).alias("body_whole"), F.coalesce(F.max(F.when(body, F.col("n"))), F.lit(0)).alias("body_n"))
    g = g.unionByName(domain_hits.select(*keys, F.lit(DOMAIN_WEIGHT).alias("score"), F.lit(0.0).alias("uncapped"), F.lit(0.0).alias("body_score"), F.lit(0.0).alias("body_whole"), F.lit(0).cast("long").alias("body_n")))
    g = g.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("score", "uncapped", "body_score", "body_whole", "body_n")])
    size = links.select(F.col("id").alias("link_id"), F.length("body_text").alias("runes"))
    g = g.join(size, "link_id")
    need = F.least(1 + F.floor(F.col("runes") / 2000), F.lit(3))
    need = F.when(F.col("score") > 0, F.least(need, F.lit(2))).otherwise(need)
    counts = F.col("body_n") >= need
    return g.select(*keys, (F.col("score") + F.when(counts, F.col("body_score")).otherwise(0.0)).alias("score"), (F.col("uncapped") + F.when(counts, F.col("body_whole")).otherwise(0.0)).alias("uncapped"))


def top_tags(scores: DataFrame, k: int = 3, threshold: float = THRESHOLD, by: tuple[str, ...] = ()) -> DataFrame:
    w = Window.partitionBy(*by, "link_id").orderBy(F.desc("score"), F.desc("uncapped"), "tag")
    return scores.where(F.col("score") >= threshold).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("confidence", confidence(F.col("score")))


def tag_corpus(links: DataFrame, surfaces: DataFrame, domain_map: DataFrame, df: DataFrame | None = None, *, k: int = 3, fields: dict[str, str] | None = None, compose: bool = False) -> DataFrame:
    """compose: bring the texts into composed form first, for archives that may hold decomposed Hangul."""
    if compose:
        links = composed(links, "title", "keywords", "description", "note", "body_text")
    compiled = compile_surfaces(surfaces)
    ids = small(surfaces.select("tag_id", "tag").distinct())
    hits = domain_tags(links, domain_map).join(ids, "tag")
    return top_tags(tag_scores(matches(links, compiled, fields), links, hits, df), k)


def document_frequency(link_terms: DataFrame) -> DataFrame:
    """link_terms(link_id, term) -> term, df, n (documents that have any term)."""
    per = link_terms.distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return per.crossJoin(link_terms.agg(F.countDistinct("link_id").alias("n")))


def with_tag(links: DataFrame, link_tags: DataFrame, tags: DataFrame, name: str) -> DataFrame:
    ids = link_tags.join(small(tags.where(F.lower("name") == name.lower()).select(F.col("id").alias("tag_id"))), "tag_id", "left_semi")
    return links.join(ids.select(F.col("link_id").alias("id")), "id", "left_semi")


def list_filter(links: DataFrame, link_tags: DataFrame, tags: DataFrame, *, tag: str | None = None, status: str | None = None, unopened: bool = False) -> DataFrame:
    """Live links under the list's optional filters."""
    out = live(links) if status is None else live(links).where(F.col("status") == status)
    out = out.where("opened_at IS NULL") if unopened else out
    return out if tag is None else with_tag(out, link_tags, tags, tag)


def created_between(links: DataFrame, since: int | None = None, until: int | None = None) -> DataFrame:
    """Both ends included; an end that is left out is open."""
    out = links if since is None else links.where(F.col("created_at") >= since)
    return out if until is None else out.where(F.col("created_at") <= until)


def tag_facets(link_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """link_id, tag_id, facet of each attachment; neutral where the tag is unknown."""
    facets = tags.select(F.col("id").alias("tag_id"), "facet")
    return link_tags.join(small(facets), "tag_id", "left").select("link_id", "tag_id", F.coalesce("facet", F.lit("neutral")).alias("facet"))


def df_top(df: DataFrame, n: int = 15) -> DataFrame:
    """df(term, df, n) -> the n most common terms with their share of the documents."""
    return df.select("term", "df", F.round(F.col("df") / F.col("n"), 6).alias("ratio")).orderBy(F.desc("df"), "term").limit(n)


def attach_tags(links: DataFrame, link_tags: DataFrame, tags: DataFrame) -> DataFrame:
    named = link_tags.join(small(tags.select(F.col("id").alias("tag_id"), "name")), "tag_id")
    lists = named.groupBy("link_id").agg(F.array_sort(F.collect_list(F.struct("name", "source", "confidence"))).alias("tags"))
    return links.join(lists, links["id"] == lists["link_id"], "left").drop("link_id")


def live(df: DataFrame) -> DataFrame:
    return df.where("deleted_at IS NULL")


def mask(condition: Column, c: Column) -> Column:
    return F.when(condition, c).otherwise("")
