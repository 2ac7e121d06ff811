"""Readers and writers of archive files."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codes import add_date_seconds, valid_created_at
from ..functions.texts import unescape_entities
from ..functions.urls import is_http_url, is_youtube_watch
from ..operators.activity import first_per, ranked_values
from ..operators.merges import merge_saves

SNAPSHOT = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "description", "body_text", "keywords", "body_source")])
GOLDEN = T.StructType([T.StructField("url", T.StringType()), T.StructField("snapshot", SNAPSHOT), T.StructField("expected_tags", T.ArrayType(T.StringType()))])
SEARCH_QUERIES = T.StructType([T.StructField(n, T.StringType()) for n in ("query", "url", "why")])
PAGE_INDEX = "fetched int, skipped int, pages array<struct<file: string, url: string, host: string, bytes: bigint>>"
TABLES = {"links": {"id", "url"}, "tags": {"id", "name"}, "link_tags": {"link_id", "tag_id"}}
WATCH_URL = r"""(https?://(?:(?:www\.|m\.|music\.)?youtube\.com/watch\?|youtu\.be/)[^\s",<>]+)"""


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """file, content. Gzipped files are read as they are."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("content"))


def pieces(spark: SparkSession, path: str | list[str], end: str) -> DataFrame:
    """file, pos: struct<block, n>, value: the text of files cut behind every `end`, which value lacks. A large file is read by many tasks, each cutting its own range of bytes, and a
    piece belongs to one of them. pos orders a file's pieces: the range's first byte, then the piece's number in its task. Gzipped files are one task each."""
    raw = spark.read.text(path, lineSep=end)
    n = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return raw.select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), n.alias("n")).alias("pos"), "value")


def _anchor(tag: Column) -> Column:
    attr = lambda n: unescape_entities(F.regexp_extract(tag, rf"""(?i)\b{n}\s*=\s*["']([^"']*)["']""", 1))
    return F.struct(attr("href").alias("url"), attr("add_date").alias("add_date"))


def anchors(content: Column) -> Column:
    """array<struct<url, add_date>> of a document's links."""
    return F.transform(F.regexp_extract_all(content, F.lit(r"(?is)(<a\s[^>]*>)"), 1), _anchor)


def read_anchors(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, pos, a: struct<url, add_date> of HTML files of any size: the links of anchors(), found in pieces that end where a tag does. An anchor that the file's end cuts off
    still counts if its attributes are there."""
    tag = F.regexp_extract("value", r"(?is)(<a\s.*)$", 1)
    return pieces(spark, path, ">").select("file", "pos", tag.alias("tag")).where("tag <> ''").select("file", "pos", _anchor(F.col("tag")).alias("a"))


def read_bookmarks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """bookmarks() of files of any size: file, pos, url, created_at."""
    return read_anchors(spark, path).where(is_http_url(F.col("a.url"))).select("file", "pos", F.col("a.url").alias("url"), add_date_seconds(F.col("a.add_date")).alias("created_at"))


def sniff_files(spark: SparkSession, path: str | list[str]) -> dict[str, list[str]]:
    """json, html, csv -> the files at path that start like it (sniff_format). Blank and empty files are left out. The driver learns a name per file, as it does to list them."""
    first = pieces(spark, path, ",").where("pos.block = 0").select("file", "pos", F.substring(F.regexp_replace("value", r"^[\ufeff\s]+", ""), 1, 1).alias("first")).where("first <> ''")
    kinds = first.groupBy("file").agg(F.min_by("first", "pos").alias("first")).select("file", sniff_format(F.col("first")).alias("kind")).collect()
    out: dict[str, list[str]] = {}
    for r in kinds:
        out.setdefault(r.kind, []).append(re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(r.file)))
    return out


def read_takeout(spark: SparkSession, path: str | list[str], kind: str | None = None) -> DataFrame:
    """takeout() of files of any size: file, pos, url. kind (json, csv, html) holds for all files; without it each is told by its first character, for which all are read once more.

    JSON is cut at the key titleUrl, at whatever depth, and what follows it is the address; so the rest of a broken file still gives rows. CSV is taken line by line: an address holds no
    line end, whatever the quotes.
    """
    if kind is None:
        found = sniff_files(spark, path)
        none = spark.createDataFrame([], "file string, pos struct<block: bigint, n: bigint, k: int>, url string")
        return reduce(lambda a, b: a.unionByName(b), [read_takeout(spark, names, k) for k, names in found.items()], none)
    at = lambda k: F.struct("pos.block", "pos.n", k.alias("k")).alias("pos")
    if kind == "html":
        rows = read_anchors(spark, path).select("file", at(F.lit(0)), F.col("a.url").alias("url"))
    elif kind == "json":
        text = F.regexp_extract("value", r'^\s*:\s*("[^"\\]*+(?:\\.[^"\\]*+)*+")', 1)
        entry = F.from_json(F.concat(F.lit('{"u":'), text, F.lit("}")), "u string")["u"]
        rows = pieces(spark, path, '"titleUrl"').where(text != "").select("file", at(F.lit(0)), entry.alias("url"))
    elif kind == "csv":
        rows = pieces(spark, path, "\n").select("file", "pos", F.posexplode(F.regexp_extract_all("value", F.lit(WATCH_URL), 1)).alias("k", "url")).select("file", at(F.col("k")), "url")
    else:
        raise ValueError(f"no kind of history: {kind}")
    return rows.where(is_youtube_watch(F.col("url")))


def page_corpus(files: DataFrame, index: DataFrame) -> DataFrame:
    """files(file, content) of pages, as whole_files reads them, joined with their index(file, url, host, bytes); pages that no index row names are left out."""
    return index.join(files, "file").select("file", "url", "host", "bytes", F.col("content").alias("html"))


def read_page_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A folder of gzipped pages with an index.json beside them: file, url, host, bytes, html."""
    index = spark.read.option("multiLine", True).schema(PAGE_INDEX).json(f"{path}/index.json").select(F.explode("pages").alias("p")).select("p.*")
    pages = whole_files(spark, f"{path}/*.gz").withColumn("file", F.regexp_extract("file", r"([^/]*)$", 1))
    return page_corpus(pages, index)


def bookmarks(files: DataFrame) -> DataFrame:
    x = files.select("file", F.posexplode(anchors(F.col("content"))).alias("pos", "a"))
    return x.where(is_http_url(F.col("a.url"))).select("file", "pos", F.col("a.url").alias("url"), add_date_seconds(F.col("a.add_date")).alias("created_at"))


def sniff_format(content: Column) -> Column:
    first = F.ltrim(F.regexp_replace(content, "^\\ufeff", ""))
    return F.when(first.rlike(r"^\s*[\[{]"), "json").when(first.rlike(r"^\s*<"), "html").otherwise("csv")


def takeout(files: DataFrame) -> DataFrame:
    """Watch URLs of history exports, JSON, CSV or HTML by each file's first character: file, pos, url."""
    kind = sniff_format(F.col("content"))
    entry = F.from_json("content", T.ArrayType(T.StructType([T.StructField("titleUrl", T.StringType())])))
    urls = F.when(kind == "json", F.transform(entry, lambda e: e["titleUrl"])).when(kind == "html", F.transform(anchors(F.col("content")), lambda a: a["url"])).otherwise(F.regexp_extract_all("content", F.lit(WATCH_URL), 1))
    return files.select("file", F.posexplode(urls).alias("pos", "url")).where(is_youtube_watch(F.col("url")))


def ingest_import(found: DataFrame, links: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """found(file, pos, url, created_at), as read_bookmarks gives it -> (merged links, counts by outcome): bad URLs and times fail, the first of equal URLs counts."""
    good = is_http_url(F.col("url")) & valid_created_at(F.col("created_at"), now)
    bad = found.where(~good).select(F.lit("failed").alias("outcome"))
    first = first_per(found.where(good), "url", ["file", "pos"])
    again = found.where(good).join(first.select("file", "pos"), ["file", "pos"], "left_anti").select(F.lit("duplicate").alias("outcome"))
    saves = first.select("url", *[F.lit("").alias(n) for n in ("title", "description", "body_text", "keywords", "note")], "created_at")
    merged = merge_saves(links, saves, now)
    counts = merged.where("outcome <> 'kept'").select("outcome").unionByName(bad).unionByName(again).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    return merged, counts


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(GOLDEN).option("mode", "FAILFAST").json(path)
    if df.isEmpty():
        raise ValueError(f"no labelled snapshot in {path}")
    return df


def read_search_queries(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(SEARCH_QUERIES).option("mode", "FAILFAST").json(path)
    if not df.where("coalesce(trim(query), '') = '' OR coalesce(trim(url), '') = '' OR coalesce(trim(why), '') = ''").isEmpty():
        raise ValueError(f"incomplete query in {path}")
    return df


def load_domain_map(spark: SparkSession, path: str) -> DataFrame:
    """host, tag; keys that begin with _ are remarks."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("host", "tags")).where(~F.col("host").startswith("_"))
    return pairs.select(F.lower("host").alias("host"), F.explode("tags").alias("tag"))


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """tag_id, tag, facet, surface of a JSON list of tags; ids in order of the list."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<struct<name:string,facet:string,aliases:array<string>>>")).alias("pos", "t"))
    return rows.select((F.col("pos") + 1).alias("tag_id"), F.col("t.name").alias("tag"), F.col("t.facet").alias("facet"), F.explode(F.concat(F.array("t.name"), F.coalesce("t.aliases", F.array().cast("array<string>")))).alias("surface"))


def write_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Refuses a copy that lacks links, tags or link_tags, or one whose links are empty."""
    out = {}
    for name, need in TABLES.items():
        out[name] = spark.read.parquet(f"{path}/{name}")
        if missing := need - set(out[name].columns):
            raise ValueError(f"{name} lacks {sorted(missing)}")
    if out["links"].isEmpty():
        raise ValueError("the snapshot has no links")
    return out


def write_links_sheet(rows: DataFrame, path: str, *, rows_per_file: int = 100_000) -> None:
    """The flat table of links (export_links) as CSV files with a header, in the place of what was there; no file has more than rows_per_file rows. Times are written as a
    sheet reads them, quotes are doubled, cells may hold lines, and what is null is an empty cell."""
    sheet = rows.fillna("").withColumn("saved", F.date_format(F.timestamp_seconds("saved"), "yyyy-MM-dd HH:mm:ss"))
    sheet.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("maxRecordsPerFile", rows_per_file).csv(path)


def read_links_sheet(spark: SparkSession, path: str) -> DataFrame:
    kinds = "id long, saved timestamp, url string, domain string, title string, description string, tags string, note string, status string"
    read = spark.read.schema(kinds).option("header", True).option("escape", '"').option("multiLine", True).option("nullValue", "\\N").option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    return read.withColumn("saved", F.unix_timestamp("saved"))


def write_label_candidates(rows: DataFrame, path: str, *, rows_per_file: int = 100_000) -> None:
    """Candidates for labels (label_candidates) as JSON lines, in the place of what was there; read_golden reads them."""
    rows.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("ignoreNullFields", False).json(path)


def read_timing_log(spark: SparkSession, path: str, budget_ms: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(report of saved and failed durations, number of broken lines) of JSON lines with outcome and ms. A line is broken if it isn't JSON of these types, or has no ms."""
    kinds = "outcome string, ms double, _corrupt_record string"
    raw = spark.read.text(path).select(F.from_json("value", kinds, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    whole = F.col("r._corrupt_record").isNull() & F.col("r.ms").isNotNull()
    good = raw.where(whole).select(F.when(F.col("r.outcome").isin("saved", "duplicate"), "saved").otherwise("failed").alias("class"), "r.ms")
    at = lambda p: F.min(F.when(F.col("upto") >= F.greatest(F.floor(p * F.col("n") + 0.5), F.lit(1)), F.col("value"))).alias(f"p{round(p * 100)}")
    report = ranked_values(good, "ms", "class").groupBy("class").agg(F.max("n").alias("n"), at(0.5), at(0.95), F.max("value").alias("max"))
    report = report.join(good.groupBy("class").agg(F.count_if(F.col("ms") > budget_ms).alias("over_budget")), "class")
    return report, raw.where(~whole).agg(F.count(F.lit(1)).alias("broken"))


def timing_gate(report: DataFrame) -> None:
    """Fails the job if nothing was saved, or if a save was over its budget."""
    rows = {r["class"]: r for r in report.collect()}  # two rows at most
    failed = rows["failed"]["n"] if "failed" in rows else 0
    if "saved" not in rows:
        raise RuntimeError(f"no save came through ({failed} failed)")
    if rows["saved"]["over_budget"]:
        raise RuntimeError(f"{rows['saved']['over_budget']} of {rows['saved']['n']} saves were over budget")


def synthetic_links(spark: SparkSession, n: int, seed: int, now: int) -> DataFrame:
    """A fixed-seed bilingual archive; every choice is a hash of the id, so any partitioning gives the same rows."""
    domains = ["example.com", "example.org", "example.net", "blog.example.com", "news.example.org", "video.example.com", "wiki.example.net", "shop.example.org"]
    words = "spark 데이터 stream 검색 graph 요약 window 태그 join 학습 cache 언어 query 배포".split()
    h = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(f"{seed}:{salt}")), F.lit(m))
    word = lambda salt: F.element_at(F.array(*map(F.lit, words)), (h(salt, len(words)) + 1).cast("int"))
    domain = F.element_at(F.array(*map(F.lit, domains)), (h("d", len(domains)) + 1).cast("int"))
    title = F.array_join(F.slice(F.array(*[word(f"w{i}") for i in range(7)]), F.lit(1), (3 + h("n", 5)).cast("int")), " ")
    many = h("t", 100)
    return spark.range(n).select("id", F.concat(F.lit("https://"), domain, F.lit("/"), F.col("id")).alias("url"), domain.alias("domain"), title.alias("title"), F.when(h("note", 10) < 3, word("note")).otherwise("").alias("note"), (F.lit(now) - h("age", 730 * 86400)).alias("created_at"), F.when(many < 15, 0).when(many < 45, 1).when(many < 75, 2).when(many < 95, 3).otherwise(4).alias("tags"))
