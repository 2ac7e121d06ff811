"""Line dedup by pairwise alignment: shared lines find overlapping documents, patience diff aligns them."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ranking import ranked
from ..storage import dropped, stored
from .tokens import lean

#: Words that a line needs to bring two documents together, and that an aligned block needs to be deleted.
MIN_WORDS = 6
#: A run that more documents hold does not choose whom a document is aligned with first.
RARE = 64


def _unique_matches(a: list[int], b: list[int], alo: int, ahi: int, blo: int, bhi: int) -> list[tuple[int, int]]:
    """Longest chain, in order on both sides, of lines that occur once on either side of a range."""
    ca, cb = Counter(a[alo:ahi]), Counter(b[blo:bhi])
    where = {b[j]: j for j in range(blo, bhi) if cb[b[j]] == 1}
    pairs = [(i, where[a[i]]) for i in range(alo, ahi) if ca[a[i]] == 1 and a[i] in where]
    tails: list[int] = []
    back, at_tail = [], []
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(tails, j)
        back.append(at_tail[n - 1] if n else -1)
        tails[n : n + 1], at_tail[n : n + 1] = [j], [k]
    chain, k = [], at_tail[-1] if at_tail else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    return chain[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned line numbers (i, j), increasing in both: equal ends first, then lines unique on both sides as anchors, then between them; without
    anchors, the longest block in common."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        alo, ahi, blo, bhi = work.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo < ahi and blo < bhi and (anchors := _unique_matches(a, b, alo, ahi, blo, bhi)):
            for i, j in [*anchors, (ahi, bhi)]:
                work.append((alo, i, blo, j))
                if i < ahi:
                    out.append((i, j))
                alo, blo = i + 1, j + 1
        elif alo < ahi and blo < bhi:
            i, j, n = SequenceMatcher(None, a[alo:ahi], b[blo:bhi], autojunk=False).find_longest_match()
            if n:
                i, j = alo + i, blo + j
                out += [(i + k, j + k) for k in range(n)]
                work += [(alo, i, blo, j), (i + n, ahi, j + n, bhi)]
    return sorted(out)


def runs(words: list[int], min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """The shortest runs of lines (from, to) of at least min_words words that begin, or that end, at each line with words.

    Every line with words in a block of at least min_words words lies in such a run inside the block.
    """
    out, n = set(), len(words)
    begin = stop = total = 0
    while begin < n:  # begins at each line
        while stop < n and total < min_words:
            total += words[stop]
            stop += 1
        if total < min_words:
            break
        if words[begin]:
            out.add((begin, stop))
        total -= words[begin]
        begin += 1
    begin = total = 0
    for end in range(n):  # ends at each line
        total += words[end]
        while total - words[begin] >= min_words:
            total -= words[begin]
            begin += 1
        if words[end] and total >= min_words:
            out.add((begin, end + 1))
    return sorted(out)


def settle(rows: list[tuple[int, int, int, int, int, int, int, int]]) -> tuple[list[int], list[int], list[int]]:
    """What a document loses to earlier holders of its runs: its lines to delete, the holders that these were aligned with, and which rows stay open.

    rows: (turn, holder, key, from, to, first, last, tried), a run of the document beside a holder's first and last place of it. Turn by turn and holder by holder, the document's
    runs that are still open are aligned with the holder's by patience diff; what is aligned goes. A run whose lines have all gone is settled too. After the
    first turn (-1), the holder that a run was tried with then (tried) is left out: one alignment with it is all there is.
    """
    turns: dict[tuple[int, int], list[int]] = {}
    for r in sorted(range(len(rows)), key=lambda r: rows[r]):
        if rows[r][0] < 0 or rows[r][1] != rows[r][7]:
            turns.setdefault(rows[r][:2], []).append(r)
    gone: set[int] = set()
    holders: set[int] = set()
    is_open = lambda r: any(k not in gone for k in range(rows[r][3], rows[r][4]))
    for (_, holder), here in turns.items():
        here = sorted((r for r in here if is_open(r)), key=lambda r: rows[r][3:5])
        if not here:
            continue
        theirs = sorted({(at, rows[r][4] - rows[r][3], rows[r][2]) for r in here for at in rows[r][5:7]})
        for _, j in patience([x[2] for x in theirs], [rows[r][2] for r in here]):
            gone.update(range(rows[here[j]][3], rows[here[j]][4]))
            holders.add(holder)
    return sorted(gone), sorted(holders), [r for r in range(len(rows)) if is_open(r)]


def _runs_of(min_words: int):
    @lean
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = [(k, hash(tuple(x[i:j])), i, j) for k, (x, w) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())) for i, j in runs(w, min_words)]
                of, key, begin, end = (pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([],) * 4))
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), key, begin.cast(pa.int32()), end.cast(pa.int32())], ["id", "key", "begin", "end"])

    return find


_SETTLED = "id long, gone array<int>, holders array<bigint>, left array<struct<key:bigint,begin:int,end:int,tried:bigint>>"


@lean
def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    left_type = pa.list_(pa.struct([("key", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("tried", pa.int64())]))
    for batch in batches:
        for i in range(batch.num_rows):  # a document at a time
            rows = [tuple(x.values()) for x in batch.column(1)[i].as_py()]
            gone, holders, left = settle(rows)
            own = [{"key": k, "begin": b, "end": e, "tried": t} for k, b, e, t in sorted({(*rows[r][2:5], rows[r][7]) for r in left})]
            cols = [pa.array([gone], pa.list_(pa.int32())), pa.array([holders], pa.list_(pa.int64())), pa.array([own], left_type)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *cols], ["id", "gone", "holders", "left"])


def _aligned(rows: DataFrame) -> DataFrame:
    """rows(id, turn, holder, key, begin, end, first, last, tried) -> what each document loses (see settle), and its runs that stay open."""
    each = rows.groupBy("id").agg(F.collect_list(F.struct("turn", "holder", "key", "begin", "end", "first", "last", "tried")).alias("rows"))  # of one document: no more than its runs, and holders of this round
    return stored(each.mapInArrow(_settle, _SETTLED), "aligned")


def line_overlaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per input row: id_col, n_lines, n_deleted, deleted_lines (numbers from 0), earlier_ids.

    Runs of lines of at least min_words words (one long line, or short ones in a row) that several documents share bring them together. A document is
    first aligned, by patience diff, with the earliest holder of the rarest of its runs that RARE documents at most hold, over all runs that this holder has too; its other runs with their
    own earliest holders. Aligned runs are deleted from the later document. A run that an alignment can't hold, because it stands in another order or more often than in that
    holder, is aligned with the next holders of it, 1, 2, 4, ... a round, until it is aligned or no earlier holder is left: then it stays.

    Only the runs that a document shares with a holder are set beside it, each with two places of the holder at most (the first and the last), never whole documents: a line
    that many documents have costs each of them a row, and the holder none. Runs of a document come together in one task, not those of a line.

    Lines are compared without white space at their ends. Defined cases: null, empty texts have one empty line and lose nothing;
    lines repeated inside one document stay unless earlier documents have them as often, or several do; rows with a null id take no part; rows
    that share an id get the same deletions; an empty table gives no rows; other columns, whatever their names, are ignored; a very long text is one row of line
    hashes, and what it shares is found as in any other.
    Only ids, places and hashes are shuffled, never texts.
    """
    line = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda s: F.trim(s, F.lit(" \t\r\x0b\x0c")))
    d = docs.select(F.col(id_col).cast("long").alias("id"), line.alias("l")).select("id", F.transform("l", lambda s: F.xxhash64(s)).alias("lines"), F.transform("l", lambda s: F.regexp_count(s, F.lit(r"\S+"))).alias("words"))
    d = stored(d, "lines")
    one = d.where("id is not null").select("id", "lines", "words").mapInArrow(_runs_of(min_words), "id long, key long, begin int, end int")
    own = stored(one.distinct(), "own_runs")
    held = own.groupBy("key", "id").agg(F.min("begin").alias("first"), F.max("begin").alias("last"))
    keys = held.groupBy("key").agg(F.min(F.struct("id", "first", "last")).alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    keys = stored(keys, "shared_runs")
    places = stored(held.join(keys.select("key"), "key"), "places")
    later = own.join(keys, "key").where(F.col("id") > F.col("earliest.id"))
    main = later.where(F.col("n") <= RARE).groupBy("id").agg(F.min_by("earliest.id", F.struct("n", "earliest.id")).alias("main"))
    at_main = places.select("key", F.col("id").alias("main"), F.struct("id", "first", "last").alias("there"))
    later = later.join(main, "id", "left").join(at_main, ["key", "main"], "left").withColumn("at", F.coalesce("there", "earliest"))
    done = [_aligned(later.select("id", F.lit(-1).alias("turn"), F.col("at.id").alias("holder"), "key", "begin", "end", "at.first", "at.last", F.col("at.id").alias("tried")))]
    ranks, turn, step = None, 0, 1
    while True:
        left = done[-1].select("id", F.explode("left").alias("run")).select("id", "run.key", "run.begin", "run.end", "run.tried")
        if ranks is None:
            ranks = stored(ranked(places.join(left.select("key").distinct(), "key").select("key", "id", "first", "last"), "key", "id").select("key", "pos", "id", "first", "last"), "ranks")
        own_rank = ranks.select("key", "id", F.col("pos").alias("rank"))
        tries = left.join(own_rank, ["key", "id"]).where(F.col("rank") > turn)
        if tries.isEmpty():
            break
        tries = tries.withColumn("pos", F.explode(F.sequence(F.lit(turn), F.least(F.col("rank") - 1, F.lit(turn + step - 1)))))
        tries = tries.join(ranks.select("key", "pos", F.col("id").alias("holder"), "first", "last"), ["key", "pos"])
        done.append(_aligned(tries.select("id", F.col("pos").cast("int").alias("turn"), "holder", "key", "begin", "end", "first", "last", "tried")))
        turn, step = turn + step, 2 * step
    cut = done[0].select("id", "gone", "holders")
    for more in done[1:]:
        cut = cut.unionByName(more.select("id", "gone", "holders"))
    cut = cut.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("deleted_lines"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("holders")))).alias("earlier_ids"))
    out = d.select("id", F.size("lines").cast("long").alias("n_lines")).join(cut.withColumnRenamed("id", "later"), F.col("id") == F.col("later"), "left")
    dropped(own, keys, places, *([ranks] if ranks is not None else []))
    return out.select(
        F.col("id").alias(id_col),
        "n_lines",
        F.coalesce(F.size("deleted_lines"), F.lit(0)).cast("long").alias("n_deleted"),
        F.coalesce("deleted_lines", F.array().cast("array<int>")).alias("deleted_lines"),
        F.coalesce("earlier_ids", F.array().cast("array<bigint>")).alias("earlier_ids"),
    )


def delete_lines(docs: DataFrame, overlaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with the overlaps' deleted lines taken out of the text.

    Null texts stay null; rows that share an id lose the same lines; without overlaps nothing changes; an empty table stays empty; columns of any name are kept as
    they are; a very long text is cut in its own row. Texts meet the overlaps by id, so a null id loses nothing.
    """
    o = overlaps.where("n_deleted > 0").select(F.col(id_col).alias("id"), F.col("deleted_lines").alias("gone")).dropDuplicates(["id"])
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("own"))
    kept = F.array_join(F.filter(F.split(F.col(f"doc.`{text_col}`"), "\n"), lambda s, i: ~F.array_contains(F.col("gone"), i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col(f"doc.`{text_col}`")).otherwise(kept).alias(text_col)
    return d.join(o, d["own"] == o["id"], "left").select(*[text if c == text_col else F.col(f"doc.`{c}`") for c in docs.columns])


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"))
