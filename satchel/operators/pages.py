"""Fields, keywords and readable text of raw HTML pages, by Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import parse_published
from ..functions.texts import LIMITS, cap_bytes, clean, clean_meta, unescape_entities
from ..functions.urls import host_matches, host_of, resolve_url
from .activity import ranked_values

META = r"""(?is)<meta\b(?=[^>]*\b(?:property|name)\s*=\s*["']?{0}["'\s/>])[^>]*\bcontent\s*=\s*(?:"([^"]*)"|'([^']*)')"""


def meta_content(html: Column, *keys: str) -> Column:
    """The first non-empty content of a meta property or name; the order of keys wins."""
    found = []
    for k in keys:
        p = META.format(k.replace(".", r"\."))
        found += [F.nullif(F.trim(F.regexp_extract(html, p, i)), F.lit("")) for i in (1, 2)]
    return F.coalesce(*found, F.lit(""))


def page_title(html: Column) -> Column:
    title = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return clean_meta(F.coalesce(F.nullif(meta_content(html, "og:title"), F.lit("")), title), LIMITS["title"])


def extract_page_fields(pages: DataFrame) -> DataFrame:
    h, m = F.col("html"), (lambda *k: meta_content(F.col("html"), *k))
    image = m("og:image", "twitter:image")
    return pages.select(
        *pages.columns,
        page_title(h).alias("title"),
        clean_meta(m("og:description", "description", "twitter:description"), LIMITS["description"]).alias("description"),
        clean_meta(m("author", "article:author"), LIMITS["title"]).alias("author"),
        clean_meta(m("og:site_name"), LIMITS["title"]).alias("site_name"),
        F.regexp_extract(h, r"""(?is)<html[^>]*\blang\s*=\s*["']?([A-Za-z-]+)""", 1).alias("lang"),
        parse_published(m("article:published_time", "datePublished", "date")).alias("published_at"),
        resolve_url(F.col("url"), image).alias("image_url"),
    )


def _unique_fold(words: Column) -> Column:
    """First spelling of each word, whatever its case."""
    low = F.transform(words, F.lower)
    return F.filter(words, lambda w, i: F.array_position(low, F.lower(w)) == i + 1)


def jsonld_keywords(html: Column, depth: int = 8) -> Column:
    """articleSection, keywords and genre of JSON-LD blocks, each a string or a list, from objects up to `depth` levels down, sorted. The blocks are read as JSON."""
    blocks = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), 1)
    none = F.array().cast("array<string>")
    starts = lambda n, mark: F.coalesce(F.ltrim(n).startswith(mark), F.lit(False))
    entries = lambda n: F.from_json(n, "map<string,string>")  # noqa: E731  values that are no string stay as JSON text
    items = lambda n: F.coalesce(F.when(starts(n, "["), F.from_json(n, "array<string>")).otherwise(F.array(n)), none)
    below = lambda n: F.coalesce(F.when(starts(n, "{"), F.map_values(entries(n))).when(starts(n, "["), items(n)), none)
    own = lambda n: F.flatten(F.transform(F.array(*map(F.lit, ["articleSection", "keywords", "genre"])), lambda k: F.coalesce(F.when(starts(n, "{"), items(F.try_element_at(entries(n), k))), none)))
    each = lambda nodes, f: F.flatten(F.transform(nodes, f))
    walk = F.aggregate(
        F.sequence(F.lit(0), F.lit(depth)),
        F.struct(blocks.alias("nodes"), none.alias("found")),
        lambda acc, _: F.struct(each(acc["nodes"], below).alias("nodes"), F.concat(acc["found"], each(acc["nodes"], own)).alias("found")),
        lambda acc: acc["found"],
    )
    words = F.filter(F.transform(walk, lambda s: F.trim(s)), lambda w: (w != "") & ~w.startswith("{"))
    return F.when(F.size(blocks) > 0, F.array_sort(F.array_distinct(words))).otherwise(none)


def publisher_keywords(html: Column) -> Column:
    tags = F.regexp_extract_all(html, F.lit(r"""(?is)<meta\b(?=[^>]*\b(?:property|name)\s*=\s*["']?article:(?:section|tag)["'\s/>])[^>]*\bcontent\s*=\s*["']([^"']*)["']"""), 1)
    all_ = F.concat(F.split(meta_content(html, "keywords"), ","), F.split(meta_content(html, "news_keywords"), ","), tags, F.flatten(F.transform(jsonld_keywords(html), lambda k: F.split(k, ","))))
    words = F.filter(F.transform(all_, lambda w: F.trim(unescape_entities(w))), lambda w: w != "")
    return cap_bytes(F.array_join(_unique_fold(words), ", "), LIMITS["keywords"])


#: Elements whose direct paragraphs may make them the body; elements that the outline of a page knows besides; what a body has at least (fixed values).
CONTAINERS = ("article", "main", "section", "div")
OTHERS = ("body", "p", "li", "ul", "ol", "dl", "dd", "dt", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "blockquote", "figure", "figcaption", "header", "footer", "aside", "nav", "form", "fieldset", "details", "pre", "h1", "h2", "h3", "h4", "h5", "h6")
LEAST_BODY = 200
#: What marks a page's body, the surest first: an element's name, or an attribute (fixed values).
ROOTS = (r"^<article\b", r"""^<[^>]*\brole\s*=\s*["']?main\b""", r"^<main\b", r"""^<[^>]*\bid\s*=\s*["']?content["'\s>]""", r"""^<[^>]*\bclass\s*=\s*["']?(?:[^"'>]*\s)?post-content["'\s>]""")


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _text_length(html: Column) -> Column:
    """Characters of an element's text; an entity counts as one."""
    return F.length(F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", ""), r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);", "x"), F.lit(" \n\t\r\f")))


def _outline(parts: Column) -> Column:
    """Parts of a page, each a tag and what follows it -> (paras: at of a container, length of a paragraph right inside it; ends: at and end of each element).

    A fold with a stack of open elements: a closing tag ends the last element of its name and all in it, one without an opening tag is passed over, and what never
    closes ends with the page.
    """
    piece = F.transform(parts, lambda p, i: F.struct(i.alias("at"), F.lower(F.regexp_extract(p, r"^</?([A-Za-z0-9]+)", 1)).alias("tag"), p.startswith("</").alias("close"), p.alias("part")))
    none = F.struct(
        F.array().cast("array<struct<at:int,tag:string>>").alias("stack"),
        F.array().cast("array<struct<at:int,len:int>>").alias("paras"),
        F.array().cast("array<struct<at:int,end:int>>").alias("ends"),
    )

    def step(state, p):
        stack = state["stack"]
        opened = F.struct(F.concat(stack, F.array(F.struct(p["at"], p["tag"]))).alias("stack"), state["paras"].alias("paras"), state["ends"].alias("ends"))
        inside = (F.size(stack) > 0) & F.coalesce(F.try_element_at(stack, F.lit(-1))["tag"].isin(*CONTAINERS), F.lit(False))
        para = F.struct(stack.alias("stack"), F.concat(state["paras"], F.array(F.struct(F.try_element_at(stack, F.lit(-1))["at"].alias("at"), _text_length(p["part"]).alias("len")))).alias("paras"), state["ends"].alias("ends"))
        from_top = F.array_position(F.reverse(F.transform(stack, lambda x: x["tag"])), p["tag"]).cast("int")
        closed = lambda n: F.struct(
            F.slice(stack, F.lit(1), F.size(stack) - n).alias("stack"),
            state["paras"].alias("paras"),
            F.concat(state["ends"], F.transform(F.slice(stack, F.size(stack) - n + 1, n), lambda x: F.struct(x["at"].alias("at"), p["at"].alias("end")))).alias("ends"),
        )
        closing = F.when(from_top > 0, closed(F.greatest(from_top, F.lit(1)))).otherwise(state)
        return F.when((p["tag"] == "") | (p["close"] & (p["tag"] == "p")), state).when(p["close"], closing).when(p["tag"] != "p", opened).when(inside, para).otherwise(state)

    rest = lambda s: F.concat(s["ends"], F.transform(s["stack"], lambda x: F.struct(x["at"].alias("at"), F.size(parts).alias("end"))))
    return F.aggregate(piece, none, step, lambda s: F.struct(s["paras"].alias("paras"), rest(s).alias("ends")))


def page_root(html: Column, closed: bool = False) -> Column:
    """The HTML of a page's body: the first element of the surest mark (ROOTS) that has more than LEAST_BODY characters; else the container whose direct paragraphs have the most
    text, if more than that (the first of equals); else the body element; else the page. With `closed`, only a body element that is closed stands in for the first two: a page that
    breaks off before its end has no text then."""
    plain = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->", " ")
    pieces = F.split(plain, r"(?i)(?=</?(?:" + "|".join((*CONTAINERS, *OTHERS)) + r")\b)")

    def chosen(parts, outline):
        until = lambda at: F.element_at(F.filter(outline["ends"], lambda e: e["at"] == at), 1)["end"]
        inner = lambda at: F.array_join(F.slice(parts, at + 1, until(at) - at), "")
        first = lambda mark: F.array_min(F.filter(F.transform(parts, lambda p, i: F.when(p.rlike("(?i)" + mark), i)), lambda i: i.isNotNull()))
        marked = [_let(first(mark), lambda at: F.when(at.isNotNull(), inner(at))) for mark in ROOTS]
        long = [_let(x, lambda t: F.when(_text_length(t) > LEAST_BODY, t)) for x in marked]
        total = lambda at: F.aggregate(F.filter(outline["paras"], lambda p: p["at"] == at), F.lit(0), lambda n, p: n + p["len"])
        sums = F.transform(F.array_distinct(F.transform(outline["paras"], lambda p: p["at"])), lambda at: F.struct(total(at).alias("len"), (-at).alias("back")))
        densest = _let(F.array_max(sums), lambda x: F.when(x["len"] > LEAST_BODY, inner(-x["back"])))
        body = _let(first(r"^<body\b"), lambda at: F.when(at.isNotNull(), inner(at)))
        if closed:
            whole = F.exists(parts, lambda p: p.rlike("(?i)^</body>"))
            return F.coalesce(*long, densest, F.when(whole, body), F.lit(""))
        return F.coalesce(*long, densest, body, F.array_join(parts, ""))

    return _let(pieces, lambda parts: _let(_outline(parts), lambda outline: chosen(parts, outline)))


def block_text(html: Column, closed: bool = False) -> Column:
    """Readable text of a page's root (see page_root): scripts, navigation and notes dropped; block ends are lines."""
    t = page_root(html, closed)
    t = F.regexp_replace(t, r"(?is)<(script|style|nav|aside|footer|form|noscript|iframe|svg)\b[^>]*>.*?</\1>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(?:p|div|h[1-6]|li|tr|section|article|blockquote|pre)>", "\n")
    t = unescape_entities(F.regexp_replace(t, r"<[^>]*>", ""))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t\r\f]+", " "), r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"), F.lit(" \n"))


def site_rules(html: Column, host: Column, rules: list[tuple[str, Column]] | None = None, closed: bool = False) -> Column:
    """A site's own body, by ordered rules (host suffix, expression); else the block text."""
    own = [
        ("youtube.com", F.replace(F.regexp_extract(html, r'"shortDescription":"((?:[^"\\]|\\.)*)"', 1), F.lit("\\n"), F.lit("\n"))),
        ("arxiv.org", F.trim(F.regexp_replace(F.regexp_extract(html, r"""(?is)<blockquote[^>]*class\s*=\s*["'][^"']*abstract[^"']*["'][^>]*>(.*?)</blockquote>""", 1), r"<[^>]*>", ""))),
        ("x.com", F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<blockquote[^>]*>.*?<p[^>]*>(.*?)</p>", 1), r"<[^>]*>", ""))),
    ]
    out = block_text(html, closed)
    for domain, rule in reversed([*(rules or []), *own]):
        out = F.when(host_matches(host, domain) & (F.coalesce(rule, F.lit("")) != ""), rule).otherwise(out)
    return out


def page_bodies(pages: DataFrame) -> DataFrame:
    return pages.withColumn("body_text", clean(site_rules(F.col("html"), host_of(F.col("url"))), LIMITS["body"], True))


def extraction_health(links: DataFrame, by: str = "domain", least: int = 200) -> DataFrame:
    """Bodies of at least 200 characters, by domain and overall (domain null)."""
    g = links.rollup(by).agg(F.count(F.lit(1)).alias("links"), F.count_if(F.length("body_text") >= least).alias("good"))
    return g.withColumn("failing", F.col("good") == 0)


def wall_stats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per text: blocks (lines with text), the longest run without a break, whether it is a wall, whether empty."""
    blocks = F.filter(F.transform(F.split(text_col, "\n"), lambda s: F.trim(s)), lambda b: b != "")
    longest = F.coalesce(F.array_max(F.transform(blocks, F.length)), F.lit(0))
    return docs.select(id_col, F.size(blocks).alias("blocks"), longest.alias("longest"), (longest >= 2000).alias("wall"), (F.size(blocks) == 0).alias("empty"))


def wall_percentiles(stats: DataFrame, qs: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """Of wall_stats: texts, walls, empty ones, and percentiles of the longest runs, taken at place floor(q * (n - 1)) from 0."""
    at = lambda q: F.min(F.when(F.col("upto") >= F.floor(q * (F.col("n") - 1)) + 1, F.col("value"))).alias(f"p{round(q * 100)}")
    p = ranked_values(stats, "longest").agg(*[at(q) for q in qs])
    return stats.agg(F.count(F.lit(1)).alias("texts"), F.count_if("wall").alias("walls"), F.count_if("empty").alias("empty")).crossJoin(p)  # one row each
