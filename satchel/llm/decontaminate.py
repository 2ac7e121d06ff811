"""Benchmark decontamination: a BM25 index of test items, queried with every training passage under block maxima."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .tokens import SHINGLE, U, blocks, hash_shingles, hash_words, lean, text_bytes, word_spans

K1, B = 1.2, 0.75
#: Share of an item's own BM25 score that a passage must reach; share of five-word shingles that must be in it.
RETRIEVE, OVERLAP = 0.45, 0.5
#: Items of one block of the index; items of one index (a larger benchmark is gone through index by index). An index takes about 2 KB an item.
BLOCK, INDEX_ITEMS = 16, 50_000
#: Words from one passage's start to the next, at least.
STRIDE = 96
#: Pairs of a passage and a block, or a posting, that are looked at together.
STEP = 1_000_000
#: What rounding may take from a bound.
SLACK = 1e-7
HITS = "array<struct<item_id:bigint,first_word:bigint,words:bigint,bm25:double,question_overlap:double,answer_overlap:double>>"


@dataclass
class Statistics:
    """Of all items, whatever index they are in."""

    items: int
    mean: float  # words of an item
    longest: int
    terms: np.ndarray  # sorted word hashes of the items at hand
    df: np.ndarray  # items that have each


@dataclass
class Index:
    ids: np.ndarray  # of the items, in index order: by length, so that a block's items weigh alike
    terms: np.ndarray  # sorted word hashes
    rank: np.ndarray  # the number of each term: by its largest weight, the smallest first
    post_at: np.ndarray  # where each term's postings begin
    post_item: np.ndarray
    post_weight: np.ndarray  # BM25 weight / the item's score against itself
    most: np.ndarray  # the largest weight of each term
    block_at: np.ndarray  # where each term's blocks begin
    block_key: np.ndarray  # term * blocks + block, sorted; only blocks with the term
    block_max: np.ndarray  # the largest weight of the term in the block
    question: list[np.ndarray]  # shingles
    answer: list[np.ndarray]
    longest: int  # words


def _words(text: str) -> np.ndarray:
    data, offsets = text_bytes(pa.array([text]))
    starts, ends, _ = word_spans(data, offsets)
    return hash_words(data, starts, ends)


def parts(text: str) -> tuple[str, str]:
    """Question and answer of an item's text: what follows its last question mark, else its last sentence, is the answer.
    An item of one sentence has no answer."""
    body = text.rstrip()
    cut = body.rfind("?", 0, -1) + 1
    if not cut:
        ends = [m.end() for m in re.finditer(r"[.!?](?=\s)", body)]
        cut = ends[-1] if ends else len(body)
    return body[:cut], body[cut:].strip()


def build_index(items: list[tuple[int, str]], of_all: Statistics | None = None) -> Index | None:
    """items(id, text); items without words are left out; None if none has any. of_all: statistics of a larger benchmark that these items are a part of."""
    read = [(i, t, w) for i, t in items if i is not None and len(w := _words(t or ""))]
    if not read:
        return None
    read.sort(key=lambda x: (len(x[2]), x[0], x[1]))
    lengths = np.array([len(w) for *_, w in read], float)
    item = np.repeat(np.arange(len(read)), lengths.astype(int))
    terms, term = np.unique(np.concatenate([w for *_, w in read]), return_inverse=True)
    pair, tf = np.unique(term.astype(np.int64) * len(read) + item, return_counts=True)
    term, item = pair // len(read), pair % len(read)
    if of_all is None:
        of_all = Statistics(len(read), float(lengths.mean()), int(lengths.max()), terms, np.bincount(term, minlength=len(terms)))
    df = of_all.df[np.searchsorted(of_all.terms, terms)]
    idf = np.log(1 + (of_all.items - df + 0.5) / (df + 0.5))
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / of_all.mean))
    weight /= np.bincount(item, weight)[item]
    most = np.maximum.reduceat(weight, np.searchsorted(term, np.arange(len(terms))))
    rank = np.empty(len(terms), np.int64)
    rank[np.argsort(most, kind="stable")] = np.arange(len(terms))
    order = np.lexsort((item, rank[term]))
    term, item, weight, most = rank[term][order], item[order], weight[order], np.sort(most)
    at = np.searchsorted(term, np.arange(len(terms) + 1))
    blocks_ = -(-len(read) // BLOCK)
    key = term * blocks_ + item // BLOCK  # sorted, since postings are
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    key = key[first]
    qa = [parts(t) for _, t, _ in read]
    shingled = lambda t: np.unique(hash_shingles(_words(t)))
    return Index(
        np.array([i for i, *_ in read], np.int64), terms, rank, at, item.astype(np.int32), weight, most,
        np.searchsorted(key, np.arange(len(terms) + 1) * blocks_), key, np.maximum.reduceat(weight, first),
        [shingled(q) for q, _ in qa], [shingled(a) for _, a in qa], of_all.longest,
    )


def _spread(at: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows `of` of a list table that begin at `at`: the number of the row in `of` that each entry belongs to, and the entry's place."""
    size = at[of + 1] - at[of]
    ends = np.cumsum(size)
    return np.repeat(np.arange(len(of)), size), np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[of] - ends + size, size)


def _retrieved(index: Index, window: np.ndarray, term: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(window, item, score) of all items that reach RETRIEVE. window, term (its rank): distinct pairs in order.

    The pivot: of a window's terms in order of their largest weights, the first ones that can't reach RETRIEVE together can't bring an item in alone; so only the blocks of
    the terms behind the pivot are candidates. The sum of a block's maxima over the window's terms bounds the score of each of its items; a block below RETRIEVE is
    skipped whole, and only the others' postings are scored. Bounds carry a margin over rounding, so none is too low.
    """
    if not len(window):
        return
    most = index.most[term]
    begin = np.flatnonzero(np.append(True, window[1:] != window[:-1]))
    of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(window))))
    total = np.cumsum(most)
    upto = total - (total[begin] - most[begin])[of]
    behind = upto >= RETRIEVE - SLACK
    before = np.maximum.reduceat(np.where(behind, 0.0, upto), begin)  # what the terms before the pivot bring at most
    n_blocks, n = -(-len(index.ids) // BLOCK), len(index.ids)
    ends = np.append(begin[1:], len(window))
    chosen = np.flatnonzero(behind)
    cost = index.block_at[term[chosen] + 1] - index.block_at[term[chosen]]
    # windows are taken together as long as their candidates, and a cell for each of their blocks, are about STEP
    part = np.cumsum(np.bincount(of[chosen], cost, minlength=len(begin)) + n_blocks) // STEP
    for lo, hi in zip(*(lambda c: (np.append(0, c), np.append(c, len(begin))))(np.flatnonzero(np.diff(part)) + 1)):
        mine = chosen[np.searchsorted(of[chosen], lo) : np.searchsorted(of[chosen], hi)]
        row, entry = _spread(index.block_at, term[mine])
        bound = np.bincount((of[mine][row] - lo) * n_blocks + index.block_key[entry] % n_blocks, index.block_max[entry], minlength=(hi - lo) * n_blocks)
        pair = np.flatnonzero((bound > 0) & (bound + np.repeat(before[lo:hi], n_blocks) >= RETRIEVE - SLACK))
        bound = bound[pair]
        # the maxima of the terms before the pivot, for the blocks that are left
        w = lo + pair // n_blocks
        count = np.bincount(of[~behind], minlength=len(begin))[w]
        some = np.repeat(np.arange(len(pair)), count)
        place = begin[w][some] + np.arange(len(some)) - np.repeat(np.cumsum(count) - count, count)
        key = term[place] * n_blocks + pair[some] % n_blocks
        at = np.searchsorted(index.block_key, key).clip(max=len(index.block_key) - 1)
        bound += np.bincount(some, np.where(index.block_key[at] == key, index.block_max[at], 0.0), minlength=len(pair)) if len(some) else 0
        pair = pair[bound >= RETRIEVE - SLACK]
        if not len(pair):
            continue
        # all postings of the windows that have such a block, kept where the block is one
        live_w = np.unique(pair // n_blocks)
        rows = np.concatenate([np.arange(begin[lo + w], ends[lo + w]) for w in live_w])
        row, entry = _spread(index.post_at, term[rows])
        item, own = index.post_item[entry], of[rows][row] - lo
        key = own * n_blocks + item // BLOCK
        open_ = pair[np.searchsorted(pair, key).clip(max=len(pair) - 1)] == key
        where, inverse = np.unique(own[open_] * n + item[open_], return_inverse=True)
        score = np.bincount(inverse, index.post_weight[entry[open_]], minlength=len(where)) if len(where) else np.zeros(0)
        for x in np.flatnonzero(score >= RETRIEVE):
            yield int(window[begin[lo + where[x] // n]]), int(where[x] % n), float(score[x])


def find_leaks(texts: pa.Array, index: Index) -> list[list[dict]]:
    """Verified items of each text of a column, at most one entry per item: the passage with the best overlap."""
    out: list[list[dict]] = []
    stride = max(STRIDE, index.longest)
    size = stride + index.longest
    maybe = np.zeros(1 << 20, bool)
    maybe[(index.terms & U(0xFFFFF)).astype(np.int64)] = True
    v = len(index.terms)
    for _, part in blocks(texts):
        data, offsets = text_bytes(part)
        starts, ends, at = word_spans(data, offsets)
        words = hash_words(data, starts, ends)
        count = np.diff(at)
        first_window = np.concatenate([[0], np.cumsum(np.maximum(-(-count // stride), 1))])
        known = np.flatnonzero(maybe[(words & U(0xFFFFF)).astype(np.int64)])
        term = np.searchsorted(index.terms, words[known]).clip(max=v - 1)
        same = index.terms[term] == words[known]
        known, term = known[same], index.rank[term[same]]
        doc = np.searchsorted(at, known, side="right") - 1
        place = known - at[doc]
        window = first_window[doc] + place // stride
        again = (place % stride < index.longest) & (place >= stride)
        pairs = np.unique(np.concatenate([window, window[again] - 1]) * v + np.concatenate([term, term[again]]))
        best: dict[tuple[int, int], dict] = {}
        for w, i, score in _retrieved(index, pairs // v, pairs % v):
            d = int(np.searchsorted(first_window, w, side="right") - 1)
            begin = (w - int(first_window[d])) * stride
            passage = words[at[d] + begin : min(at[d] + begin + size, at[d + 1])]
            q, a, both = _overlaps(index, i, passage)
            if q >= OVERLAP and a >= OVERLAP or both >= 0.8:
                hit = {"item_id": int(index.ids[i]), "first_word": begin, "words": len(passage), "bm25": score, "question_overlap": q, "answer_overlap": a}
                if (old := best.get((d, i))) is None or (q + a, score) > (old["question_overlap"] + old["answer_overlap"], old["bm25"]):
                    best[d, i] = hit
        found: list[list[dict]] = [[] for _ in range(len(part))]
        for (d, _), hit in sorted(best.items(), key=lambda x: x[1]["item_id"]):
            found[d].append(hit)
        out += found
    return out


def _overlaps(index: Index, item: int, passage: np.ndarray) -> tuple[float, float, float]:
    """Shares of the question's, the answer's (1 if there is none) and both parts' shingles in the passage. Parts of fewer words than a shingle must occur as they are."""
    have = hash_shingles(passage)
    total = hit = 0
    shares = []
    for s in (index.question[item], index.answer[item]):
        n = int(np.isin(s, have).sum())
        if len(s) == 1 and not n:  # a short part is hashed as a whole sequence, other than a run of five
            n = int(any(np.isin(s, _short(passage, k)).any() for k in range(1, SHINGLE)))
        shares.append(n / len(s) if len(s) else 1.0)
        total, hit = total + len(s), hit + n
    return shares[0], shares[1], hit / max(total, 1)


def _short(passage: np.ndarray, k: int) -> np.ndarray:
    """All runs of k < SHINGLE words, hashed as texts of k words are."""
    return np.concatenate([hash_shingles(passage[i : i + k]) for i in range(len(passage) - k + 1)] or [np.zeros(0, U)])


def leaks(text: Column, index: Index | None) -> Column:
    """The benchmark items that a text column's texts hold, as HITS; an empty list for null or clean texts."""

    @F.arrow_udf(HITS)
    @lean
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("words", pa.int64()), ("bm25", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))
        for texts in batches:
            yield pa.array(find_leaks(texts, index) if index else [[]] * len(texts), kind)

    return find(text)


def _of_all(items: DataFrame) -> tuple[DataFrame, int, float, int]:
    """items(i, t) of all indexes: (term, df), how many have words, their mean and largest number of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(0).to_pylist():
                terms, n = np.unique(w := _words(text or "")), len(w)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(np.full(len(terms), n)), pa.array(np.arange(len(terms)) == 0)], ["term", "n", "first"])

    t = stored(items.where("i is not null").select("t").mapInArrow(lean(count), "term long, n long, first boolean"), "terms")
    r = t.where("first").agg(F.count(F.lit(1)).alias("items"), F.avg("n").alias("mean"), F.max("n").alias("longest")).first()
    return stored(t.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df"), r["items"], r["mean"] or 1.0, r["longest"] or 0


def with_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", *, item_col: str = "item_id", item_text_col: str = "text", out: str = "leaks", index_items: int = INDEX_ITEMS) -> DataFrame:
    """docs, all columns, plus `out`: benchmark items found in each text, in order of item id.

    A passage is a window of words; windows overlap by the longest item, so any item lies whole in one. Every window
    of every whole text is a query. No shuffle: an index of about index_items items at most goes to each task. A larger
    benchmark is dealt over indexes by a hash of the item id, and the documents, written between, go through them one by one, so one index at a time is in the
    driver and in a task; document frequencies and lengths are those of all items, so scores don't depend on the dealing.

    Defined cases: null, empty or blank texts hold nothing; items with a null id, null text or no words are never found; equal
    items are all found; repeated documents give the same answer each; an empty benchmark or table finds nothing; a very long text is a row of many windows, looked at
    in steps; other columns, whatever their names, stay as they are (one named `out` is replaced).
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t"))
    pieces = max(1, -(-items.count() // index_items))
    if pieces == 1:
        return docs.withColumn(out, leaks(F.col(text_col), build_index([tuple(r) for r in items.collect()])))
    items = stored(items.withColumn("piece", F.pmod(F.xxhash64("i"), F.lit(pieces))), "items")
    df, n, mean, longest = _of_all(items)
    found = docs.select(F.struct(*docs.columns).alias("doc"), F.array().cast(HITS).alias("hits"))
    for piece in range(pieces):
        own = [tuple(r) for r in items.where(F.col("piece") == piece).select("i", "t").collect()]  # about index_items
        terms = np.unique(np.concatenate([np.zeros(0, U), *[_words(t or "") for i, t in own if i is not None]]))
        asked = items.sparkSession.createDataFrame(pa.table({"term": pa.array(terms.view(np.int64))}))
        counts = df.join(asked, "term", "left_semi").toArrow()
        term, c = counts["term"].to_numpy().view(U), counts["df"].to_numpy()
        index = build_index(own, Statistics(n, mean, longest, np.sort(term), c[np.argsort(term)]))
        found = stored(found.select("doc", F.concat("hits", leaks(F.col(f"doc.`{text_col}`"), index)).alias("hits")), f"leaks{piece}")
    return found.select(*[F.col(f"doc.`{c}`") for c in docs.columns if c != out], F.sort_array("hits").alias(out))


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out="leak")
    return found.select("doc_id", F.explode("leak").alias("leak")).select("doc_id", "leak.*")
