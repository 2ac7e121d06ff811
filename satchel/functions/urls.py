"""Columns over URLs and hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOST = r"^[a-zA-Z]+://(?:[^/?#@]*@)?([^/:?#]+)"


def is_http_url(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)^https?://[^/?#]+"), F.lit(False))


def url_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def host_of(c: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(c, HOST, 1)), F.lit(""))


def host_matches(host: Column, domain: str) -> Column:
    h = F.lower(F.rtrim(F.regexp_replace(host, r":\d+$", ""), F.lit(".")))
    return (h == domain) | h.endswith("." + domain)


def any_host(host: Column, *domains: str) -> Column:
    out = F.lit(False)
    for d in domains:
        out = out | host_matches(host, d)
    return out


def content_type_of(host: Column) -> Column:
    return F.when(any_host(host, "youtube.com", "youtu.be", "vimeo.com"), "video").when(any_host(host, "twitter.com", "x.com", "instagram.com"), "post").otherwise("article")


def mobile_host_rewrite(url: Column) -> Column:
    return F.regexp_replace(url, r"^(?i)(https?://)blog\.naver\.com(?=[/:?#]|$)", "$1m.blog.naver.com")


def host_suffixes(host: Column) -> Column:
    """Candidates for a lookup, the most specific first: without www., then left labels dropped while more than one dot remains."""
    bare = F.regexp_replace(F.lower(host), r"^www\.", "")
    labels = F.split(bare, r"\.")
    n = F.size(labels)
    from_ = F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)))
    return F.transform(from_, lambda i: F.array_join(F.slice(labels, i + 1, n), "."))


def is_youtube_watch(url: Column) -> Column:
    host = host_of(url)
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)
    v = F.regexp_extract(url, r"[?&]v=([^&#]+)", 1)
    short = (host == "youtu.be") & (F.length(F.trim(path, F.lit("/"))) > 0)
    long = host.isin("youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com") & (path == "/watch") & (v != "")
    return F.coalesce(short | long, F.lit(False))


def resolve_url(base: Column, ref: Column) -> Column:
    scheme = F.regexp_extract(base, r"^([a-zA-Z]+:)", 1)
    origin = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^[a-zA-Z]+://[^/?#]+(/(?:[^?#]*/)?)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    return F.when(ref.rlike("(?i)^https?:"), ref).when(ref == "", "").when(ref.startswith("//"), F.concat(scheme, ref)).when(ref.startswith("/"), F.concat(origin, ref)).otherwise(F.concat(origin, folder, ref))
