"""Ranked search for tables of queries: trigram postings, phrases, bm25, coverage, OR retry, LIKE fallback."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tokens import has_hangul, normalize_token, trigrams
from ..ranking import ranked
from ..storage import spread, stored
from .tagging import attach_tags, compile_surfaces, live, matches

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
COVERAGE_WEIGHT = 1000
#: Queries that meet a row at once where there is no key to join on.
QUERIES = 256
#: Phrases that are counted in one pass over the texts, and spellings a task keeps what it found in, where no postings are stored.
PHRASES, SPELLINGS = 100_000, 200_000
#: Queries, and rows, whose cosines are computed in one task.
VECTORS = 16_384
#: Folders of stored postings.
BUCKETS = 64
COLUMNS = ("title", "description", "note", "tags")


def search_documents(links: DataFrame, link_tags: DataFrame, tags: DataFrame) -> DataFrame:
    t = attach_tags(live(links), link_tags, tags)
    summary = F.col("summary") if "summary" in links.columns else F.lit("")
    names = F.array_join(F.array_sort(F.transform("tags", lambda x: x["name"])), " ")
    return t.select(F.col("id").alias("doc_id"), "title", F.trim(F.concat_ws(" ", "description", summary)).alias("description"), "note", F.coalesce(names, F.lit("")).alias("tags"), "created_at")


def build_postings(docs: DataFrame) -> DataFrame:
    """gram, doc_id, col: distinct trigrams of each column."""
    cols = [F.struct(F.lit(c).alias("col"), trigrams(F.col(c)).alias("grams")) for c in COLUMNS]
    t = docs.select("doc_id", F.explode(F.array(*cols)).alias("c")).select("doc_id", "c.col", F.explode("c.grams").alias("gram"))
    return t.select("gram", "doc_id", "col")


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def write_postings(docs: DataFrame, path: str) -> None:
    """Store the postings in folders by a hash of the gram, sorted by gram, so that a search reads only the folders and row groups of the grams it asks for."""
    p = build_postings(docs).withColumn("bucket", _bucket(F.col("gram")))
    p.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def with_length(docs: DataFrame) -> DataFrame:
    return docs if "len" in docs.columns else docs.withColumn("len", sum((F.greatest(F.length(c) - 2, F.lit(0)) for c in COLUMNS), F.lit(0)))


def doc_lengths(docs: DataFrame) -> DataFrame:
    return with_length(docs).select("doc_id", "len")


def _pattern(phrase: Column) -> Column:
    """A regexp that matches once for each occurrence of a phrase. Only one that begins as it ends can overlap itself: it is looked for by empty matches in front of
    each occurrence, which is slower than a plain literal."""
    n = F.length(phrase)
    laps = F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: (k < n) & (F.left(phrase, k) == F.right(phrase, k)))
    literal = F.concat(F.lit("\\Q"), F.replace(phrase, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.when(laps, F.concat(F.lit("(?="), literal, F.lit(")"))).otherwise(literal)


def expand_queries(queries: DataFrame, surfaces: DataFrame) -> DataFrame:
    """queries(query_id, query) -> query_id, term: names of the tags in a query, and their surfaces of the other script."""
    c = compile_surfaces(surfaces)
    q = queries.select(F.col("query_id").alias("id"), normalize_token(F.col("query")).alias("q"), has_hangul(F.col("query")).alias("ko"))
    hit = matches(q, c, {"q": "q"}).select("link_id", "tag_id", "tag").distinct()
    hit = hit.join(q.select(F.col("id").alias("link_id"), "ko"), "link_id")
    others = hit.join(surfaces.select("tag_id", "surface"), "tag_id").where((F.col("surface") != F.col("tag")) & (has_hangul(F.col("surface")) != F.col("ko"))).select("link_id", F.col("surface").alias("term"))
    return hit.select("link_id", F.col("tag").alias("term")).unionByName(others).select(F.col("link_id").alias("query_id"), "term").distinct()


def _asked(phrases: DataFrame, postings: DataFrame) -> DataFrame:
    """gram, doc_id of the grams that phrases ask for, from stored postings, read by bucket."""
    grams = phrases.select(F.explode(trigrams(F.col("phrase"))).alias("gram")).distinct()
    if "bucket" in postings.columns:
        return postings.join(grams.withColumn("bucket", _bucket(F.col("gram"))), ["bucket", "gram"], "left_semi").select("gram", "doc_id").distinct()
    return postings.join(grams, "gram", "left_semi").select("gram", "doc_id").distinct()


def _finder(phrases: list[bytes]) -> Callable[[bytes], np.ndarray]:
    """Tells the places in `phrases` of those that a word holds, each as often as it occurs, overlaps included; looked up by the bytes they begin with."""
    heads: dict[bytes, list[tuple[bytes, int]]] = {}
    for at, p in enumerate(phrases):
        heads.setdefault(p[:3], []).append((p, at))
    sizes = sorted({len(h) for h in heads})
    none = np.empty(0, np.int64)

    def find(word: bytes) -> np.ndarray:
        found = [at for i in range(len(word)) for n in sizes if i + n <= len(word) for p, at in heads.get(word[i : i + n], ()) if word.startswith(p, i)]
        return np.array(found, np.int64) if found else none

    return find


def _overlapping(text: bytes, phrase: bytes) -> int:
    n, at = 0, text.find(phrase)
    while at >= 0:
        n, at = n + 1, text.find(phrase, at + 1)
    return n


def _counter(phrases: list[tuple[int, str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over doc_id, len and lower-case columns: a phrase has no blank, so it lies inside a word, and what a spelling holds is found once a task. The few
    phrases with a blank are looked for in the columns themselves."""
    blank = lambda p: len(p.split()) != 1 or p.strip() != p  # noqa: E731  bytes: ASCII blanks, as the regexp's \\s
    every = [(pid, p.encode()) for pid, p in phrases]
    plain, spaced = [x for x in every if not blank(x[1])], [x for x in every if blank(x[1])]
    pids = np.array([pid for pid, _ in plain], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, known = _finder([p for _, p in plain]), {}

        def counts(words: Counter) -> np.ndarray:
            if len(known) > SPELLINGS:
                known.clear()
            held = [known[w] if w in known else known.setdefault(w, find(w)) for w in words]
            times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), [len(h) for h in held])
            return np.bincount(np.concatenate(held), times, len(pids)).astype(np.int64) if len(times) else np.zeros(len(pids), np.int64)

        for b in batches:
            texts = [b.column(c).cast(pa.binary()).to_pylist() for c in COLUMNS]
            size, pid, f, near = [], [], [], []
            for title, description, note, tags in zip(*[[t or b"" for t in x] for x in texts]):
                words = Counter(title.split())
                words.update(description.split())
                words.update(tags.split())
                close = counts(words)
                whole = close + counts(Counter(note.split())) if note else close
                at = np.flatnonzero(whole)
                beside = b" ".join([title, description, tags])
                more = [(i, n, p in beside) for i, p in spaced if (n := sum(_overlapping(t, p) for t in (title, description, note, tags))) or p in beside]
                more = [x for x in more if x[1]]
                size.append(len(at) + len(more))
                pid += [pids[at], np.array([x[0] for x in more], np.int64)]
                f += [whole[at], np.array([x[1] for x in more], np.int64)]
                near += [close[at] > 0, np.array([x[2] for x in more], bool)]
            ends = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(t))) for x, t in ((pid, np.int64), (f, np.int32), (near, bool))] if size else [pa.array([], pa.list_(t)) for t in (pa.int64(), pa.int32(), pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("len"), *lists], ["doc_id", "len", "pid", "f", "near"])

    return run


def _counted(phrases: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """phrases(phrase), lower case -> (their numbers: phrase, pid; a row for each document and PHRASES phrases: doc_id, len, arrays pid, f, near of the phrases that it holds).
    A stated set of phrases goes to the tasks, PHRASES at a time; no text is shuffled."""
    numbers = stored(phrases.distinct().withColumn("pid", F.monotonically_increasing_id()), "phrases")
    blocks = max(1, -(-numbers.count() // PHRASES))
    texts = with_length(docs).select("doc_id", "len", *[F.lower(c).alias(c) for c in COLUMNS])
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, len int, pid array<bigint>, f array<int>, near array<boolean>"
    of = lambda b: [tuple(r) for r in numbers.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == b).select("pid", "phrase").collect()]
    out = [stored(texts.mapInArrow(_counter(of(b)), schema).where(F.size("pid") > 0), "counted") for b in range(blocks)]
    return numbers, reduce(lambda x, y: x.unionByName(y), out)


def _hit_rows(counted: DataFrame) -> DataFrame:
    return counted.select("doc_id", "len", F.explode(F.arrays_zip("pid", "f", "near")).alias("x")).select("doc_id", "len", "x.pid", "x.f", "x.near")


def _phrase_hits(phrases: DataFrame, docs: DataFrame, postings: DataFrame | None) -> DataFrame:
    """phrases(phrase), lower case -> phrase, doc_id, f, near: documents that hold the phrase in a column, with occurrences, and whether title, description or tags hold it.

    Without postings the words of every text are looked at. With them, a phrase's rarest gram names its candidates; a document's candidates meet its text in one row, where each
    is verified. So postings are read once for the frequencies and once for the rarest grams, and texts are shuffled once at most.
    """
    if postings is None:
        numbers, counted = _counted(phrases.select("phrase").where(F.length("phrase") >= 3), docs)  # shorter ones have no gram
        return _hit_rows(counted).join(numbers, "pid").select("phrase", "doc_id", "f", "near")
    grams = phrases.select("phrase", _pattern(F.col("phrase")).alias("pattern"), F.explode(trigrams(F.col("phrase"))).alias("gram"))
    asked = stored(_asked(phrases, postings), "asked")
    df = asked.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    rarest = grams.join(df, "gram", "left").groupBy("phrase", "pattern").agg(F.min(F.struct(F.coalesce("df", F.lit(0)), F.col("gram"))).alias("r")).select("phrase", "pattern", F.col("r.gram").alias("gram"))
    cand = asked.join(rarest, "gram").groupBy("doc_id").agg(F.collect_list(F.struct("phrase", "pattern")).alias("phrases"))
    texts = docs.select("doc_id", *[F.coalesce(F.lower(c), F.lit("")).alias(f"t_{c}") for c in COLUMNS])
    counts = lambda p: F.array(*[F.regexp_count(F.col(f"t_{c}"), p["pattern"]) for c in COLUMNS])
    counted = F.transform("phrases", lambda p: F.struct(p["phrase"].alias("phrase"), counts(p).alias("n")))
    found = cand.join(texts, "doc_id").select("doc_id", "t_title", "t_description", "t_tags", F.explode(F.filter(counted, lambda x: F.array_max(x["n"]) > 0)).alias("x"))
    near = F.array_max(F.transform("x.n", lambda n, i: F.when(i != COLUMNS.index("note"), n).otherwise(0))) > 0
    across = F.contains(F.concat_ws(" ", "t_title", "t_description", "t_tags"), F.col("x.phrase"))  # a phrase with a space may stand across two columns
    f = F.aggregate("x.n", F.lit(0), lambda a, n: a + n)
    return found.select("x.phrase", "doc_id", f.alias("f"), F.when(F.contains("x.phrase", F.lit(" ")), across).otherwise(near).alias("near"))


def _short_coverage(docs: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms of fewer than three letters have no grams: (doc_id, shorts: those of all queries that title, description or tags hold), found by a scan in blocks, and (query_id, short: its own)."""
    short = terms.where(F.length("term") < 3)
    lists = short.groupBy("query_id").agg(F.collect_set("term").alias("short"))
    every = in_blocks(short.select(F.col("term").alias("query_id")).distinct(), QUERIES)
    text = docs.select("doc_id", F.lower(F.concat_ws(" ", "title", "description", "tags")).alias("all"))
    held = text.crossJoin(every).select("doc_id", F.filter(F.transform("queries", lambda x: x["query_id"]), lambda t: F.contains(F.col("all"), t)).alias("held"))
    return held.groupBy("doc_id").agg(F.flatten(F.collect_list("held")).alias("shorts")), lists


def apply_expander(queries: DataFrame, expander: DataFrame) -> DataFrame:
    """expander(term, expansion) -> query_id, term: the expansions of the terms (words, or several in a row) that a query holds, whatever the case."""
    words = queries.select("query_id", F.concat(F.lit(" "), F.regexp_replace(F.lower(F.trim("query")), r"\s+", " "), F.lit(" ")).alias("all"))
    words = words.select("query_id", "all", F.explode(F.array_distinct(F.split(F.trim("all"), " "))).alias("word"))
    e = expander.select(F.regexp_replace(F.lower(F.trim("term")), r"\s+", " ").alias("asked"), "expansion").withColumn("word", F.substring_index("asked", " ", 1))
    held = F.contains(F.col("all"), F.concat(F.lit(" "), F.col("asked"), F.lit(" ")))
    return words.join(e, "word").where(held & (F.trim("expansion") != "")).select("query_id", F.col("expansion").alias("term")).distinct()


def candidates(queries: DataFrame, docs: DataFrame, surfaces: DataFrame | None = None, postings: DataFrame | None = None, *, expander: DataFrame | None = None, only: DataFrame | None = None, since: int | None = None, until: int | None = None) -> DataFrame:
    """All results of search, without their places: query_id, doc_id, mode, rank, and order and tie, by which a query's results are placed.

    A document's phrases meet the queries in its own task: rows of a query and a document are made once and never shuffled, unless postings are given.
    """
    docs = stored(spread(with_length(docs), "doc_id"), "docs")
    allowed = docs.select("doc_id", "created_at")
    allowed = allowed if only is None else allowed.join(only.select("doc_id").distinct(), "doc_id", "left_semi")
    allowed = allowed if since is None else allowed.where(F.col("created_at") >= since)
    allowed = (allowed if until is None else allowed.where(F.col("created_at") <= until)).select("doc_id")
    narrowed = any(x is not None for x in (only, since, until))
    narrow = lambda df: df.join(allowed, "doc_id", "left_semi") if narrowed else df
    words = queries.select("query_id", "query", F.explode(F.array_distinct(F.filter(F.split(F.lower("query"), r"\s+"), lambda w: w != ""))).alias("word"))
    asked = words.where(F.length("word") >= 3).select("query_id", F.col("word").alias("phrase"))
    extra = asked.limit(0).select("query_id", F.col("phrase").alias("term"))
    extra = extra if surfaces is None else expand_queries(queries, surfaces)
    extra = extra if expander is None else extra.unionByName(apply_expander(queries, expander)).distinct()
    added = extra.select("query_id", F.lower("term").alias("phrase")).where(F.length("phrase") >= 3)
    needed = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("needed"))
    # a query's terms are its words and expansions; with two or more, each that title, description or tags hold counts once
    terms = stored(words.select("query_id", F.col("word").alias("term")).unionByName(extra.select("query_id", F.lower("term").alias("term"))).distinct(), "terms")
    several = terms.groupBy("query_id").agg((F.count(F.lit(1)) >= 2).cast("int").alias("several"))
    of_query = asked.withColumn("own", F.lit(1)).unionByName(added.withColumn("own", F.lit(0))).groupBy("query_id", "phrase").agg(F.max("own").alias("own"), F.count_if(F.col("own") == 0).alias("extra"))
    # terms of fewer than three letters have no grams and no weight: the pass over the texts counts them with the others, stored postings leave them to a scan
    short_terms = terms.where((F.length("term") < 3) & (F.col("term") != "")).join(several.where("several = 1"), "query_id", "left_semi")
    if postings is None:
        of_query = of_query.unionByName(short_terms.select("query_id", F.col("term").alias("phrase"), F.lit(0).alias("own"), F.lit(0).cast("long").alias("extra")))
        numbers, counted = _counted(of_query.select("phrase"), docs)
        hits, of_query = _hit_rows(counted), of_query.join(numbers, "phrase")
        met = _hit_rows(narrow(counted.repartition("doc_id")))  # each document stays in its task from here on
    else:
        hits = stored(_phrase_hits(of_query.select("phrase").distinct(), docs, postings).join(doc_lengths(docs), "doc_id").withColumnRenamed("phrase", "pid"), "hits")
        met, of_query = narrow(hits), of_query.withColumn("pid", F.col("phrase"))

    total = doc_lengths(docs).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    df = hits.groupBy("pid").agg(F.count(F.lit(1)).alias("df"))
    idf = F.when(F.length("phrase") >= 3, F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))).otherwise(0.0)
    of_query = of_query.join(several, "query_id").join(df, "pid").crossJoin(total)  # one row
    of_query = stored(of_query.select("query_id", "pid", "own", "extra", "several", "avg_len", idf.alias("idf")), "of_query")
    tf = F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = of_query.join(met, "pid").groupBy("query_id", "doc_id")
    scored = scored.agg(F.sum(-F.col("idf") * tf).alias("bm25"), F.sum("own").alias("got"), F.sum("extra").alias("expanded"), F.sum(F.col("several") * F.col("near").cast("int")).alias("coverage"))
    # no document of a query that takes any phrase has an expansion, so its weights are those of its own phrases
    scored = scored.where("got > 0 OR expanded > 0").join(F.broadcast(stored(needed, "needed")), "query_id", "left")
    full = F.coalesce(F.expr("got = needed OR expanded > 0"), F.lit(False))
    scored = stored(scored.select("query_id", "doc_id", "bm25", "coverage", full.alias("full")), "scored")
    answered = F.broadcast(stored(scored.where("full").select("query_id").distinct().withColumn("answered", F.lit(True)), "answered"))
    found = scored.join(answered, "query_id", "left").where("full OR answered IS NULL")
    if postings is not None and not short_terms.isEmpty():
        shorts, lists = _short_coverage(docs, short_terms)
        found = found.join(shorts, "doc_id", "left").join(lists, "query_id", "left")
        found = found.withColumn("coverage", F.col("coverage") + F.coalesce(F.when(F.size(F.array_intersect("short", "shorts")) > 0, F.size(F.array_intersect("short", "shorts"))), F.lit(0))).drop("short", "shorts")
    found = found.select("query_id", "doc_id", F.when(F.col("full"), "fts").otherwise("or").alias("mode"), (F.col("bm25") - COVERAGE_WEIGHT * F.col("coverage")).alias("rank"))
    found = found.select("*", F.round("rank", 9).alias("order"), F.col("doc_id").alias("tie"))
    short = queries.join(needed.select("query_id").unionByName(extra.select("query_id")).distinct(), "query_id", "left_anti").select("query_id", F.filter(F.split(F.lower("query"), r"\s+"), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    if short.isEmpty():
        return found
    like = _like_hits(short, narrow(docs)).select("query_id", "doc_id", F.lit("like").alias("mode"), F.lit(None).cast("double").alias("rank"), (-F.col("created_at")).cast("double").alias("order"), (-F.col("doc_id")).alias("tie"))
    return found.unionByName(like)


def with_positions(found: DataFrame, most: int | None = None) -> DataFrame:
    """candidates -> query_id, doc_id, mode, rank, position; of each query the first `most`, if given: every task then hands on no more than that."""
    if most is not None:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("order", "tie"))
        return found.withColumn("position", place).where(F.col("position") <= most).select("query_id", "doc_id", "mode", "rank", "position")
    return ranked(found, "query_id", "order", "tie").select("query_id", "doc_id", "mode", "rank", (F.col("pos") + 1).cast("int").alias("position"))


def positions_of(found: DataFrame, answers: DataFrame) -> DataFrame:
    """candidates, answers(query_id, doc_id) -> query_id, doc_id, position of the answers that were found: results before them are counted, so nothing is sorted."""
    own = answers.select("query_id", "doc_id").distinct()
    at = stored(found.join(own, ["query_id", "doc_id"], "left_semi").select("query_id", F.col("doc_id").alias("answer"), F.col("order").alias("o"), F.col("tie").alias("t")), "answers")
    before = found.join(at, "query_id").where((F.col("order") < F.col("o")) | ((F.col("order") == F.col("o")) & (F.col("tie") <= F.col("t"))))
    return before.groupBy("query_id", F.col("answer").alias("doc_id")).agg(F.count(F.lit(1)).cast("int").alias("position"))


def search(queries: DataFrame, docs: DataFrame, surfaces: DataFrame | None = None, postings: DataFrame | None = None, *, expander: DataFrame | None = None, only: DataFrame | None = None, since: int | None = None, until: int | None = None, after: DataFrame | None = None, size: int | None = None) -> DataFrame:
    """queries(query_id, query) -> query_id, doc_id, mode (fts, or, like), rank, position.

    All phrases of at least three characters must occur (or any expansion of the query); ordered by bm25, less 1000 for each
    term covered. Queries without a hit ask for any phrase; queries without a phrase or expansion, and no hits, look for every word as a substring,
    newest first. Each step takes only the queries that the one before left unanswered.

    surfaces expands a query by the tags it names (see expand_queries), expander(term, expansion) by a table (see apply_expander).
    postings: stored ones (read_postings, SearchIndex.postings) spare the texts that hold no asked gram; without them grams are cut from all texts.
    Positions are counted by ranges (see ranked), so that no task sees all hits of a query of common words.

    Filters don't change the weights: `only` keeps its doc_id (those of a tag, say), since and until bound created_at, both included.
    after(query_id, position) and size give the page behind a position.
    """
    most = size
    if size is not None and after is not None:
        most = size + (after.agg(F.max("position")).first()[0] or 0)
    found = candidates(queries, docs, surfaces, postings, expander=expander, only=only, since=since, until=until)
    return page(with_positions(found, most), after, size)


def page(results: DataFrame, after: DataFrame | None, size: int | None) -> DataFrame:
    """The results of each query behind the position in after(query_id, position), as many as size."""
    if after is not None:
        results = results.join(after.select("query_id", F.col("position").alias("__from")), "query_id", "left").withColumn("__from", F.coalesce("__from", F.lit(0)))
    else:
        results = results.withColumn("__from", F.lit(0))
    results = results.where(F.col("position") > F.col("__from"))
    return (results if size is None else results.where(F.col("position") <= F.col("__from") + size)).drop("__from")


def in_blocks(queries: DataFrame, size: int) -> DataFrame:
    """queries(query_id, ...) -> block, queries (array of structs): a stated set of queries dealt into rows of about `size`, to meet all rows of a table block by block."""
    blocks = max(1, -(-queries.count() // size))
    return queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct(*queries.columns)).alias("queries"))


def _like_hits(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """queries(query_id, w: words) -> query_id, doc_id, created_at: every word in title, description or note, else any word. A scan: every row meets the queries in blocks.
    A text is searched once for each different word of a block, however many queries share it."""
    text = docs.select("doc_id", "created_at", F.lower(F.concat_ws("\n", "title", "description", "note")).alias("all"))
    blocks = in_blocks(queries.select("query_id", "w"), QUERIES).withColumn("words", F.array_distinct(F.flatten(F.transform("queries", lambda x: x["w"]))))
    places = F.transform("queries", lambda x: F.struct(x["query_id"].alias("query_id"), F.transform(x["w"], lambda w: (F.array_position("words", w) - 1).cast("int")).alias("at")))
    blocks = blocks.select("words", places.alias("queries"))
    j = text.crossJoin(F.broadcast(blocks)).select("doc_id", "created_at", "queries", F.transform("words", lambda w: F.contains(F.col("all"), w)).alias("holds"))
    held = lambda x: F.size(F.filter(x["at"], lambda i: F.get("holds", i)))
    found = F.filter(F.transform("queries", lambda x: F.struct(x["query_id"].alias("query_id"), held(x).alias("n"), F.size(x["at"]).alias("m"))), lambda x: x["n"] > 0)
    j = j.select("doc_id", "created_at", F.inline(found)).select("doc_id", "created_at", "query_id", (F.col("n") == F.col("m")).alias("every"))
    j = stored(j, "like")
    some = j.groupBy("query_id").agg(F.max("every").alias("some"))
    return j.join(some, "query_id").where("every OR NOT some").select("query_id", "doc_id", "created_at")


def like_search(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """queries(query_id, w: words) -> rows of mode like (see _like_hits), newest first."""
    j = _like_hits(queries, docs).select("query_id", "doc_id", (-F.col("created_at")).alias("__new"), (-F.col("doc_id")).alias("__last"))
    j = ranked(j, "query_id", "__new", "__last")
    return j.select("query_id", "doc_id", F.lit("like").alias("mode"), F.lit(None).cast("double").alias("rank"), (F.col("pos") + 1).cast("int").alias("position"))


def search_quality(results: DataFrame, answers: DataFrame, n: int = 10) -> DataFrame:
    """answers(query_id, doc_id) -> hit1, mrr, reached, queries."""
    r = answers.join(results.where(F.col("position") <= n).select("query_id", "doc_id", "position"), ["query_id", "doc_id"], "left")
    r = r.groupBy("query_id").agg(F.min("position").alias("p"))
    return r.agg(F.avg(F.coalesce((F.col("p") == 1).cast("int"), F.lit(0))).alias("hit1"), F.avg(F.coalesce(1 / F.col("p"), F.lit(0.0))).alias("mrr"), F.count("p").alias("reached"), F.count(F.lit(1)).alias("queries"))


def _best(k: int, block: int = 512) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The k rows of the best cosine, to six places (ties to the smaller id), of each query, for a block of queries and one of rows: a product of two matrices."""

    def best(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(queries) and len(rows):
            rows = rows.sort_values("vec_id", kind="stable")
            ids, vectors = rows["vec_id"].to_numpy(), np.stack(rows["v"].to_numpy())
            for at in range(0, len(queries), block):
                own = queries["query_id"].to_numpy()[at : at + block]
                dots = np.stack(queries["q"].to_numpy()[at : at + block]) @ vectors.T
                dots[own[:, None] == ids[None, :]] = -np.inf  # none is its own neighbour
                near = np.round(dots, 6)
                least = np.partition(near, len(ids) - min(k, len(ids)), axis=1)[:, len(ids) - min(k, len(ids))]
                q, r = np.nonzero((near >= least[:, None]) & (near > -np.inf))
                order = np.lexsort((r, -near[q, r], q))
                q, r = q[order], r[order]
                keep = np.arange(len(q)) - np.searchsorted(q, q) < k
                out.append((own[q[keep]], ids[r[keep]], dots[q[keep], r[keep]]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))

    return best


def cosine_knn(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Best k by cosine, for a stated set of queries against all rows: blocks of queries meet blocks of rows, each pair of blocks in one task that multiplies their matrices and hands on
    the best k of each query. All pairs are looked at, so the work is queries * rows. Vectors without a direction have no row."""
    x = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, y: s + y * y))
    unit = lambda df: df.withColumn("n", norm).where("n > 0").withColumn("v", F.transform(x, lambda e: e / F.col("n"))).withColumn("dim", F.size("v"))
    q = stored(unit(queries).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "dim"), "queries")
    v = stored(unit(vectors).select("vec_id", "v", "dim"), "unit")
    of_q, of_v = (max(1, -(-df.count() // VECTORS)) for df in (q, v))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.select("*", F.pmod(F.xxhash64("query_id"), F.lit(of_q)).cast("int").alias("a")).select("*", every(of_v).alias("b"))
    v = v.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(of_v)).cast("int").alias("b")).select("*", every(of_q).alias("a"))
    pairs = q.groupBy("dim", "a", "b").cogroup(v.groupBy("dim", "a", "b")).applyInPandas(_best(k), "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("score", F.round("score", 6)).withColumn("rank", place).where(F.col("rank") <= k)


def search_misses(results: DataFrame, answers: DataFrame, n: int = 10) -> DataFrame:
    """query_id, doc_id, position: answers that the first n results of their query lack; position is where they are further down, if anywhere."""
    return answers.join(results.select("query_id", "doc_id", "position"), ["query_id", "doc_id"], "left").where(F.coalesce("position", F.lit(n + 1)) > n)
