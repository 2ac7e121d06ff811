"""Substring dedup: paragraphs by MinHash bands, exact Jaccard and components; passages at any offset by winnowed word windows, grown word by word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import dropped, stored
from .components import components
from .membership import bitmap, in_bitmap, maybe_in
from .tokens import SHINGLE, U, _PLACE, _tables, blocks, hash_words, lean, mix, text_bytes, texts_words, word_spans

#: Words that a paragraph has at least, and that repeated passages which follow one another need in all before they count.
MIN_WORDS, MIN_RUN = 8, 50
#: A line of more than LONG words is cut where a pair of words has the smallest hash of all within REACH words: into pieces of about 50 words.
LONG, REACH = 96, 24
#: MinHash bands and rows of each: a pair at Jaccard 0.75 meets with a chance of 1 - (1 - 0.75 ** 3) ** 8 = 0.988, at 0.8 of 0.997, at 0.3 of 0.2.
BANDS, ROWS = 8, 3
#: Words of a window, and windows in a row of which the smallest is a seed: equal passages of GRAM + WINNOW - 1 = 23 words share a seed. Seeds in a row
#: are at most WINNOW windows apart, so those of one passage leave no word between them uncovered as long as WINNOW <= GRAM.
GRAM, WINNOW = 12, 12
#: Words beyond the ends of a run of seeds that are compared one by one: over one changed word and a part behind it that is too short for an own seed.
CONTEXT = 3 * GRAM
_GRAM_PLACE = mix(np.arange(301, 301 + GRAM, dtype=U)) | U(1)
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=U)) | U(1)
_PAIR = mix(np.arange(501, 503, dtype=U)) | U(1)
#: Bits of the parity sketch of a paragraph's shingles; the Hamming distance of two bounds the symmetric difference from below.
SKETCH = 256
DOC, PARA, KEY, SHAPE, SEED = range(5)
PLACES = "kind int, key long, id long, at int, words int, name long, s0 long, s1 long, s2 long, s3 long"
#: Ends of runs that are compared at once.
STEP = 20_000


def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op (minimum or maximum) over each w entries in a row."""
    have = 1
    while 2 * have <= w:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[: len(x) - (w - have)], x[w - have :]) if have < w else x


@dataclass
class Words:
    """The words of some texts, all at once, with a name for every word sequence: equal ones have equal names."""

    row: int  # number of the first text
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    at: np.ndarray  # where each text's words begin
    words: np.ndarray
    total: np.ndarray

    def names(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        _, down = _tables(len(self.words) + 1)
        with np.errstate(over="ignore"):
            return mix((self.total[j] - self.total[i]) * down[i] + (j - i).astype(U))


def _word_blocks(texts: pa.Array) -> Iterator[Words]:
    for begin, part in blocks(texts):
        data, offsets = text_bytes(part)
        starts, ends, at = word_spans(data, offsets)
        words = hash_words(data, starts, ends)
        up, _ = _tables(len(words) + 1)
        total = np.zeros(len(words) + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum(mix(words) * up[: len(words)], out=total[1:])
        yield Words(begin, data, starts, ends, at, words, total)


def _paragraphs(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word of each paragraph of at least MIN_WORDS words, and the word behind its last: lines, long ones cut by what stands around a cut."""
    n = len(w.words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.zeros(n + 1, bool)
    start[w.at] = True
    lines = np.append(0, np.cumsum(w.data == 0x0A))
    start[1:n] |= lines[w.starts[1:]] > lines[w.ends[:-1]]
    first = np.flatnonzero(start[:n])
    size = np.diff(np.append(first, n))
    if n > 2 * REACH + 1 and (size > LONG).any():
        with np.errstate(over="ignore"):
            pair = mix(w.words * _PAIR[0] + np.append(w.words[1:], U(0)) * _PAIR[1])
        low = np.flatnonzero(pair[REACH : n - REACH] == _slide(pair, 2 * REACH + 1, np.minimum)) + REACH
        line = np.searchsorted(first, low, side="right") - 1
        inside = (size[line] > LONG) & (low - first[line] >= REACH) & (first[line] + size[line] - low > REACH)
        start[low[inside]] = True
        first = np.flatnonzero(start[:n])
    stop = np.append(first[1:], n)
    keep = stop - first >= MIN_WORDS
    return first[keep], stop[keep]


def _shingles(words: np.ndarray) -> np.ndarray:
    """The shingle that begins at each word but the last few, whatever text they are of."""
    n = len(words) - SHINGLE + 1
    with np.errstate(over="ignore"):
        out = words[:n] * _PLACE[0]
        for k in range(1, SHINGLE):
            out += words[k : n + k] * _PLACE[k]
    return mix(out)


def _bands(shingles: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """[paragraphs, BANDS] band keys."""
    edges = np.column_stack([first, stop - SHINGLE + 1]).ravel()
    keys = np.empty((len(first), BANDS), U)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            k = np.full(len(first), U(band))
            for seed in _SEEDS[band * ROWS : (band + 1) * ROWS]:
                k = mix(k ^ np.minimum.reduceat(np.append(shingles * seed, U(0)), edges)[::2])
            keys[:, band] = k
    return keys


def _sketches(shingles: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct shingles each paragraph has, and their parity sketch as [paragraphs, SKETCH / 64]."""
    size = stop - first - SHINGLE + 1
    ends = np.cumsum(size)
    para = np.repeat(np.arange(len(first)), size)
    own = shingles[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)]
    with np.errstate(over="ignore"):
        _, some = np.unique(mix(own + para.astype(U) * _SEEDS[0]), return_index=True)
    own, para = own[some], para[some]
    odd = np.bincount(para * SKETCH + (own & U(SKETCH - 1)).astype(np.int64), minlength=len(first) * SKETCH) & 1
    return np.bincount(para, minlength=len(first)), np.packbits(odd.astype(np.uint8)).view(U).reshape(len(first), SKETCH // 64)


def _seeds(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the seeds: windows of GRAM words that are the smallest of WINNOW windows in a row of one text.

    A seed depends on the words of these windows alone, so equal passages have equal seeds wherever they stand.
    """
    n = len(w.words) - GRAM + 1
    if n < WINNOW:
        return np.zeros(0, np.int64), np.zeros(0, U)
    with np.errstate(over="ignore"):
        grams = w.words[:n] * _GRAM_PLACE[0]
        for k in range(1, GRAM):
            grams += w.words[k : n + k] * _GRAM_PLACE[k]
    grams = mix(grams) | U(1)
    end = np.repeat(w.at[1:], np.diff(w.at))[: n - WINNOW + 1]
    low = _slide(grams, WINNOW, np.minimum)
    low[np.arange(len(low)) + WINNOW + GRAM - 1 > end] = 0  # these run into the next text
    none = np.zeros(WINNOW - 1, U)
    place = np.flatnonzero(grams == _slide(np.concatenate([none, low, none]), WINNOW, np.maximum))
    return place, grams[place]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _fresh(names: np.ndarray, seen: set[int]) -> np.ndarray:
    out = np.zeros(len(names), bool)
    for i, n in enumerate(names.tolist()):
        if n not in seen:
            seen.add(n)
            out[i] = True
    return out


def key_values(docs: DataFrame) -> DataFrame:
    """docs(id, text) -> (key, value): each seed with its text's name, each band key with its paragraph's name, once per task for a text or paragraph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: set[int] = set()
        paras: set[int] = set()
        for batch in batches:
            for w in _word_blocks(batch.column(1)):
                if len(w.words) < MIN_WORDS:
                    continue
                owner = w.names(w.at[:-1], w.at[1:])
                place, gram = _seeds(w)
                row = np.searchsorted(w.at, place, side="right") - 1
                new = _fresh(owner, texts)[row]
                first, stop = _paragraphs(w)
                some = np.flatnonzero(_fresh(w.names(first, stop), paras))
                first, stop = first[some], stop[some]
                name = w.names(first, stop)
                keys = _bands(_shingles(w.words), first, stop) if len(first) else np.zeros((0, BANDS), U)
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate([gram[new], keys.ravel()])), _signed(np.concatenate([owner[row[new]], np.repeat(name, BANDS)]))], ["key", "value"])

    return docs.select("id", "text").mapInArrow(lean(run), "key long, value long")


def places(docs: DataFrame, shared=None) -> DataFrame:
    """docs(id, text) -> PLACES: a row for each text (name, words), paragraph (at, words, name), band key (key, name), paragraph with a band key (name, distinct shingles
    as words, sketch) and seed (key, at). shared: a broadcast bitmap (membership.bitmap); keys and seeds that are surely not in it are left out."""
    fields = [x.split() for x in PLACES.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64()}

    def table(kind: int, n: int, **have) -> pa.RecordBatch:
        have["kind"] = pa.array(np.full(n, kind, np.int32))
        return pa.RecordBatch.from_arrays([have[c].cast(kinds[t]) if c in have else pa.nulls(n, kinds[t]) for c, t in fields], [c for c, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        may = (lambda keys: np.ones(keys.shape, bool)) if shared is None else (lambda keys: in_bitmap(shared.value, keys))
        for batch in batches:
            for w in _word_blocks(batch.column(1)):
                ids = batch.column(0).slice(w.row, len(w.at) - 1)
                take = lambda row, ids=ids: ids.take(pa.array(row))
                yield table(DOC, len(ids), id=ids, words=pa.array(np.diff(w.at)), name=_signed(w.names(w.at[:-1], w.at[1:])))
                if len(w.words) < MIN_WORDS:
                    continue
                place, gram = _seeds(w)
                some = may(gram)
                place, gram = place[some], gram[some]
                row = np.searchsorted(w.at, place, side="right") - 1
                yield table(SEED, len(place), key=_signed(gram), id=take(row), at=pa.array(place - w.at[row]))
                first, stop = _paragraphs(w)
                row, name = np.searchsorted(w.at, first, side="right") - 1, w.names(first, stop)
                yield table(PARA, len(first), id=take(row), at=pa.array(first - w.at[row]), words=pa.array(stop - first), name=_signed(name))
                some = np.flatnonzero(_fresh(name, seen))
                if not len(some):
                    continue
                shingles = _shingles(w.words)
                keys = _bands(shingles, first[some], stop[some])
                kept = may(keys)
                yield table(KEY, int(kept.sum()), key=_signed(keys[kept]), name=_signed(np.repeat(name[some], kept.sum(1))))
                if len(some := some[kept.any(1)]):
                    n, bits = _sketches(shingles, first[some], stop[some])
                    yield table(SHAPE, len(some), words=pa.array(n), name=_signed(name[some]), **{f"s{k}": _signed(bits[:, k]) for k in range(SKETCH // 64)})

    return docs.select("id", "text").mapInArrow(lean(run), PLACES)


def paragraph_sets(docs: DataFrame) -> DataFrame:
    """docs(id, text) -> (name, shingles), each paragraph's shingles as they come, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for w in _word_blocks(batch.column(1)):
                if len(w.words) < MIN_WORDS:
                    continue
                first, stop = _paragraphs(w)
                some = np.flatnonzero(_fresh(w.names(first, stop), seen))
                first, stop = first[some], stop[some]
                size = stop - first - SHINGLE + 1
                ends = np.append(0, np.cumsum(size))
                flat = _shingles(w.words)[np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)]
                yield pa.RecordBatch.from_arrays([_signed(w.names(first, stop)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(flat))], ["name", "shingles"])

    return docs.select("id", "text").mapInArrow(lean(run), "name long, shingles array<long>")


def near_classes(docs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """docs(id, text), their rows(PLACES) -> (name, class_id) of the paragraphs that have a near copy: components over pairs whose sets of shingles have that Jaccard index.

    The members of a bucket (paragraphs with a band key in common) are compared with the one that occurs most often; what then still
    lies in different components is compared in full. Sizes and sketches are held against each other inside these joins, so they give only pairs that may link.
    """
    bits = [f"s{k}" for k in range(SKETCH // 64)]
    of = lambda kind: rows.where(F.col("kind") == kind)
    shapes = stored(of(SHAPE).select("name", F.col("words").alias("n"), *bits).dropDuplicates(["name"]), "shapes")
    shape = lambda x, end: shapes.select(F.col("name").alias(x), *[F.col(c).alias(f"{c}{end}") for c in ("n", *bits)])
    apart = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"{b}_"))) for b in bits), F.lit(0))
    may = (F.least("n", "n_") >= similarity * F.greatest("n", "n_")) & (apart * (1 + similarity) <= (1 - similarity) * (F.col("n") + F.col("n_")))
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))

    def verified(pairs: DataFrame) -> DataFrame:
        named = pairs.select(F.col("a").alias("name")).unionAll(pairs.select("b")).distinct()
        where = of(PARA).join(named, "name", "left_semi").groupBy("name").agg(F.min("id").alias("id"))
        sets = maybe_in(paragraph_sets(maybe_in(docs, F.col("id"), where.select("id"))), F.col("name"), named)
        sets = stored(sets.select("name", F.array_distinct("shingles").alias("s")).dropDuplicates(["name"]), "shingles")
        p = pairs.join(sets.select(F.col("name").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("name").alias("b"), F.col("s").alias("sb")), "b")
        both = F.size(F.array_intersect("sa", "sb"))
        links = stored(p.where(both >= similarity * (F.size("sa") + F.size("sb") - both)).select("a", "b"), "links")
        dropped(sets)
        return links

    often = of(PARA).groupBy("name").agg(F.count(F.lit(1)).alias("often"))
    keyed = of(KEY).select("key", "name").join(often, "name")
    lead = keyed.groupBy("key").agg(F.max(F.struct("often", "name")).alias("lead"), F.min("name").alias("lo"), F.max("name").alias("hi")).where("lo < hi")
    led = stored(of(KEY).select("key", "name").join(lead.select("key", F.col("lead.name").alias("lead")), "key").where("name <> lead").distinct(), "led")
    met = led.select(*pair("name", "lead")).distinct().join(shape("a", ""), "a").join(shape("b", "_"), "b")
    first = stored(met.where(may).select("a", "b"), "pairs")
    links = verified(first)
    comp = components(links)
    label = F.coalesce("component", "name").alias("comp")
    open_ = led.join(comp.withColumnRenamed("id", "name"), "name", "left").select("key", "name", label)
    unsettled = open_.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    open_ = stored(open_.join(unsettled, "key", "left_semi").join(shapes, "name"), "open")
    other = open_.select(*[F.col(c).alias(f"{c}_") for c in open_.columns])
    rest = open_.join(other, (F.col("key") == F.col("key_")) & (F.col("comp") < F.col("comp_")) & may).select(*pair("name", "name_")).distinct()
    rest = stored(rest, "pairs")
    if not rest.isEmpty():
        more = verified(rest)
        comp = components(links.unionByName(more))
        dropped(more)
    dropped(shapes, led, first, links, open_, rest)
    return comp.select(F.col("id").alias("name"), F.col("component").alias("class_id"))


def _at(docs: DataFrame, asked: DataFrame, columns: str, run) -> DataFrame:
    """mapInArrow over docs(id, text) joined with asked(id, ...), whose texts alone are shuffled."""
    return maybe_in(docs, F.col("id"), asked.select("id")).join(asked, "id").mapInArrow(lean(run), columns)


def _ints(words: np.ndarray) -> np.ndarray:
    return (words >> U(32)).astype(np.uint32).view(np.int32)


def _texts_together(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the words of all texts of a column, one after another, and where each text's begin."""
    found = [words for _, words in texts_words(texts)]
    return _ints(np.concatenate([np.zeros(0, U), *found])), np.cumsum([0, *map(len, found)])


def _flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The entries of a list column, and the row of each."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


def _around(words: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[ends, CONTEXT] words before each place (the nearest first) or from it on, and which of them lie between low and high."""
    step = np.arange(CONTEXT)
    index = np.where(left[:, None], at[:, None] - 1 - step, at[:, None] + step)
    inside = (index >= low[:, None]) & (index < high[:, None])
    return (words[np.where(inside, index, 0)] if len(words) else np.zeros(index.shape, np.int32)), inside


def _contexts(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """ends(k, kp, left) -> (k, kp, left, context): up to CONTEXT words before kp (the nearest first) or from kp on, as 32-bit hashes."""
    asked = ends.groupBy(F.col("k").alias("id")).agg(F.collect_set(F.struct("kp", "left")).alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, at = _texts_together(batch.column("text"))
            ends, row = _flat(batch.column("ends"))
            kp, left = ends.field("kp").to_numpy(), ends.field("left").to_numpy(zero_copy_only=False)
            for begin in range(0, len(row), STEP):
                r, p, x = row[begin : begin + STEP], kp[begin : begin + STEP], left[begin : begin + STEP]
                found, inside = _around(words, at[r], at[r + 1], at[r] + p, x)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(inside.sum(1))), pa.int32()), pa.array(found[inside]))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(r)).cast(pa.int64()), pa.array(p, pa.int32()), pa.array(x), lists], ["k", "kp", "left", "context"])

    return _at(docs, asked, "k long, kp int, left boolean, context array<int>", run)


def _leading(x: np.ndarray) -> np.ndarray:
    """How many entries of each row are true before the first that isn't."""
    return np.where(x.all(1), x.shape[1], x.argmin(1))


def grown(own: np.ndarray, have: np.ndarray, other: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair of contexts (rows of words, and which of them exist): how many words they share from a run's end on, and the part of GRAM words or more behind
    one or two changed words, as words skipped here, words skipped there, words (0 if there is none)."""
    n = _leading((own == other) & have & theirs)
    a, b, more = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    step = np.arange(CONTEXT)
    for x, y in ((1, 1), (0, 1), (1, 0), (2, 2)):
        rows = np.flatnonzero((more == 0) & (n + max(x, y) + GRAM <= CONTEXT))
        i, j = n[rows, None] + x + step, n[rows, None] + y + step
        inside = (i < CONTEXT) & (j < CONTEXT)
        i, j = np.where(inside, i, 0), np.where(inside, j, 0)
        pick = lambda m, k, rows=rows: np.take_along_axis(m[rows], k, 1)
        size = _leading((pick(own, i) == pick(other, j)) & pick(have, i) & pick(theirs, j) & inside)
        hit = size >= GRAM
        a[rows[hit]], b[rows[hit]], more[rows[hit]] = n[rows[hit]] + x, n[rows[hit]] + y, size[hit]
    return n, a, b, more


def bridged(parts: list[tuple[int, int, int]], similarity: float) -> list[tuple[int, int, int, int]]:
    """(first word, first word in the earlier document, words there, words) of near copies: exact parts (first, keep_first, words) in order, with the few words between them.

    A part goes on with the next as long as both sides together have a Jaccard index of five-word shingles of at least `similarity`,
    counted from the exact parts alone, so never too high.
    """
    out, at = [], 0
    while at < len(parts):
        first, keep, n = parts[at]
        end, keep_end, common, best = first + n, keep + n, n - SHINGLE + 1, None
        for k in range(at + 1, len(parts)):
            b, a, n = parts[k]
            if b < end or a < keep_end:
                break
            end, keep_end, common = b + n, a + n, common + n - SHINGLE + 1
            both = (end - first - SHINGLE + 1) + (keep_end - keep - SHINGLE + 1) - common
            if common < similarity * both:
                break
            best = (k, (first, keep, keep_end - keep, end - first))
        if best:
            out.append(best[1])
        at = best[0] if best else at + 1
    return out


def _joined(group: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of intervals in order of group, then first: the number of the run each is in; those of a group that touch or overlap are one run."""
    reach = np.maximum.accumulate(group.astype(np.int64) * (1 << 40) + first + size) if len(group) else group
    new = np.append(True, (group[1:] != group[:-1]) | (first[1:] > reach[:-1] - group[1:].astype(np.int64) * (1 << 40)))[: len(group)]
    return np.cumsum(new) - 1


def passages(own_id: np.ndarray, parts: dict[str, np.ndarray], similarity: float | None, min_run: int) -> dict[str, np.ndarray]:
    """row, first_word, words, keep_id, keep_first_word, keep_words of the passages of some texts, none inside another, from exact parts (row, first, k, kp, n)."""
    row, first, k, kp, n = (parts[c] for c in ("row", "first", "k", "kp", "n"))
    o = np.lexsort((first, kp - first, k, row))  # those on the same diagonal that touch or overlap are one
    row, first, k, kp, n = row[o], first[o], k[o], kp[o], n[o]
    line = np.cumsum(np.append(False, (row[1:] != row[:-1]) | (k[1:] != k[:-1]) | ((kp - first)[1:] != (kp - first)[:-1]))[: len(row)])
    run = _joined(line, first, n)
    at = np.flatnonzero(np.append(True, run[1:] != run[:-1])[: len(run)])
    size = np.maximum.reduceat(first + n, at) - first[at] if len(at) else n
    row, first, k, kp, n = row[at], first[at], k[at], kp[at], size
    m = n.copy()
    if similarity is not None and len(row):
        o = np.lexsort((kp, first, k, row))
        r2, f2, k2, p2, n2 = row[o], first[o], k[o], kp[o], n[o]
        cut = np.append(np.flatnonzero(np.append(True, (r2[1:] != r2[:-1]) | (k2[1:] != k2[:-1]))), len(o))
        more = []
        for i in np.flatnonzero(np.diff(cut) > 1):
            lo, hi = cut[i], cut[i + 1]
            if k2[lo] != own_id[r2[lo]]:
                more += [(r2[lo], b, k2[lo], a, x, y) for b, a, y, x in bridged(list(zip(f2[lo:hi].tolist(), p2[lo:hi].tolist(), n2[lo:hi].tolist())), similarity)]
        if more:
            row, first, k, kp, n, m = (np.concatenate([x, np.array(y, np.int64)]) for x, y in zip((row, first, k, kp, n, m), zip(*more)))
    o = np.lexsort((kp, k, -n, first, row))
    row, first, k, kp, n, m = row[o], first[o], k[o], kp[o], n[o], m[o]
    run = _joined(row, first, n)  # passages that overlap or touch count together
    if len(run):
        at = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        total = np.maximum.reduceat(first + n, at) - first[at]
        reach = np.append(-1, np.maximum.accumulate(row * (1 << 40) + first + n)[:-1])
        keep = (total[run] >= min_run) & (row * (1 << 40) + first + n > reach)  # else it lies inside one before it
        row, first, k, kp, n, m = row[keep], first[keep], k[keep], kp[keep], n[keep], m[keep]
    return {"row": row, "first_word": first, "words": n, "keep_id": k, "keep_first_word": kp, "keep_words": m}


def exact_passages(docs: DataFrame, rows: DataFrame | None = None, *, min_run: int = MIN_RUN, similarity: float | None = None) -> DataFrame:
    """docs(id, text), and their rows(PLACES) if they are there, -> (id, first_word, words, keep_id, keep_first_word, keep_words): word runs that stand in an earlier place too, across documents.

    Texts of the same words are one from the start: all but that of the smallest id are a passage as a whole. Every seed that several other texts hold is laid upon its
    first place (smallest id, then word); seeds in a row on places in a row are one run, whose ends then grow word by word, in the text
    and at the earlier place. What two documents share in 23 words or more holds a common seed, so all of it is found, word for word,
    at any offset and with any holder. Passages that overlap or touch count together for min_run.

    With a similarity, a run's end also grows over one or two changed words when at least GRAM equal words follow, and parts on the same earlier document
    are bridged over the words between them as long as the whole is that near a copy. Of two texts of more than 50 words at Jaccard 0.75 with
    single words changed, at least 24 words in a row are equal, which is enough for a seed.
    """
    rows = stored(places(docs), "places") if rows is None else rows
    texts = rows.where((F.col("kind") == DOC) & (F.col("words") >= MIN_WORDS)).select("id", "name", "words")
    first = texts.groupBy("name").agg(F.min("id").alias("rep"))
    copies = texts.where(F.col("words") >= min_run).join(first, "name").where("id <> rep")
    copies = copies.select("id", F.lit(0).alias("first_word"), "words", F.col("rep").alias("keep_id"), F.lit(0).alias("keep_first_word"), F.col("words").alias("keep_words"))
    seeds = rows.where(F.col("kind") == SEED).select("key", "id", "at").join(first.select(F.col("rep").alias("id")), "id", "left_semi")
    place = F.struct("id", "at")
    heads = seeds.groupBy("key").agg(F.min(place).alias("keep"), F.max("id").alias("hi")).where("keep.id < hi").drop("hi")
    hit = seeds.join(heads, "key").where(F.col("keep") != place).select("id", "at", F.col("keep.id").alias("k"), F.col("keep.at").alias("kp"))
    in_order = Window.partitionBy("id").orderBy("at")
    step = F.col("at") - F.lag("at").over(in_order)  # 0: rows that share an id
    same = (step <= GRAM) & (F.lag("k").over(in_order) == F.col("k")) & (F.col("kp") - F.lag("kp").over(in_order) == step)
    hit = hit.withColumn("new", (~F.coalesce(same, F.lit(False))).cast("long"))
    hit = hit.withColumn("part", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = hit.groupBy("id", "part").agg(F.min("at").alias("first_word"), (F.max("at") - F.min("at") + GRAM).cast("int").alias("words"), F.min("k").alias("k"), F.min("kp").alias("kp"))
    parts = stored(parts.drop("part"), "parts")
    ends = F.explode(F.array(F.struct(F.lit(True).alias("left"), F.col("kp").alias("kp")), F.struct(F.lit(False).alias("left"), (F.col("kp") + F.col("words")).alias("kp"))))
    ends = parts.select("id", "first_word", "words", "k", ends.alias("e")).select("id", "first_word", "words", "k", "e.left", "e.kp")
    told = ends.join(stored(_contexts(docs, ends.select("k", "kp", "left")), "contexts"), ["k", "kp", "left"])
    asked = told.groupBy("id").agg(F.collect_list(F.struct("first_word", "words", "k", "kp", "left", "context")).alias("ends"))
    asked = stored(asked, "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, at = _texts_together(batch.column("text"))
            ends, row = _flat(batch.column("ends"))
            first, n, k, kp = (ends.field(c).to_numpy().astype(np.int64) for c in ("first_word", "words", "k", "kp"))
            left = ends.field("left").to_numpy(zero_copy_only=False)
            context = ends.field("context")
            begins, size, values = context.offsets.to_numpy()[:-1], np.diff(context.offsets.to_numpy()), context.values.to_numpy()
            found: list[tuple] = []
            for begin in range(0, len(row), STEP):
                e = slice(begin, begin + STEP)
                r, x = row[e], left[e]
                own, have = _around(words, at[r], at[r + 1], at[r] + first[e] + np.where(x, 0, n[e]), x)
                theirs = np.arange(CONTEXT) < size[e][:, None]
                other = values[np.where(theirs, begins[e][:, None] + np.arange(CONTEXT), 0)] if len(values) else np.zeros(theirs.shape, np.int32)
                more, a, b, tail = grown(own, have, other, theirs)
                # to the left both begin earlier; to the right kp is the run's end
                f0, p0 = np.where(x, first[e] - more, first[e]), np.where(x, kp[e] - more, kp[e] - n[e])
                found.append((r, f0, k[e], p0, n[e] + more))
                t = tail > 0
                f1, p1 = np.where(x, first[e] - a - tail, first[e] + n[e] + a), np.where(x, kp[e] - b - tail, kp[e] + b)
                found.append((r[t], f1[t], k[e][t], p1[t], tail[t]))
            if found:
                ids = batch.column("id").to_numpy().astype(np.int64)
                out = passages(ids, dict(zip(("row", "first", "k", "kp", "n"), map(np.concatenate, zip(*found)))), similarity, min_run)
                kinds = {"first_word": pa.int32(), "words": pa.int32(), "keep_id": pa.int64(), "keep_first_word": pa.int32(), "keep_words": pa.int32()}
                yield pa.RecordBatch.from_arrays([pa.array(ids[out["row"]]), *[pa.array(out[c], t) for c, t in kinds.items()]], ["id", *kinds])

    return _at(docs, asked, "id long, first_word int, words int, keep_id long, keep_first_word int, keep_words int", run).unionByName(copies)


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, similarity: float = 0.75, min_run: int = MIN_RUN) -> DataFrame:
    """One row per occurrence of a repeated passage: id_col, first_word, words, class_id, keep_id, keep_first_word, removed.

    Passages are of two kinds, whose rows may overlap: paragraphs with near copies, and passages of any offset (exact_passages, grown and bridged over changed
    words), each with a row for its place and one for the place that stays. Removals always point to an earlier place.

    Paragraphs are lines, long ones cut by content. Those whose sets of five-word shingles have a Jaccard index of at least `similarity`, over
    paths of such pairs, are one class; its first occurrence (smallest id, then place) stays, the others are removed. Only
    runs of repeated paragraphs that follow one another in a document and have at least min_run words
    in all count; shorter ones (a common phrase, a licence line) are left alone. Occurrences of a class in one document
    alone are no repeat across documents and are left alone too.

    Equal paragraphs are one from the start, so copies cost a row each and no pair. Keys that only one text or paragraph has are dropped before
    anything is joined.

    Defined cases: null, empty and short texts have no paragraph; rows with a null id take no part; rows that share
    an id are one document; an empty table gives no rows; other columns, whatever their names, are ignored; a very long text is a row as any other, hashed
    as a whole. Of texts, only those that share a seed with another are shuffled.
    """
    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    shared = key_values(docs).groupBy("key").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo < hi").select("key")
    rows = stored(places(docs, bitmap(shared)), "places")
    classes = near_classes(docs, rows, similarity)
    classed = rows.where(F.col("kind") == PARA).select("id", F.col("at").alias("first_word"), "words", "name").join(classes, "name", "left").select("id", "first_word", "words", F.coalesce("class_id", "name").alias("class_id")).distinct()
    place = F.struct(F.col("id"), F.col("first_word"))
    heads = classed.groupBy("class_id").agg(F.min(place).alias("keep"), F.max("id").alias("hi")).where("keep.id < hi").drop("hi")
    hit = stored(classed.join(heads, "class_id"), "repeated")
    in_order = Window.partitionBy("id").orderBy("first_word")
    new = F.coalesce(F.lag(F.col("first_word") + F.col("words")).over(in_order) != F.col("first_word"), F.lit(True))
    runs = hit.withColumn("new", new.cast("long")).withColumn("run", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("total", F.sum("words").over(Window.partitionBy("id", "run"))).where(F.col("total") >= min_run)
    long = lambda *cols: [F.col(c).cast("long").alias(c) for c in cols]
    near = runs.select(F.col("id").alias(id_col), *long("first_word", "words"), "class_id", F.col("keep.id").alias("keep_id"), F.col("keep.first_word").cast("long").alias("keep_first_word"), (F.col("keep") != place).alias("removed"))
    exact = stored(exact_passages(docs, rows, min_run=min_run, similarity=similarity).withColumn("class_id", F.xxhash64("keep_id", "keep_first_word", "keep_words")).distinct(), "exact")
    gone = exact.select(F.col("id").alias(id_col), *long("first_word", "words"), "class_id", "keep_id", *long("keep_first_word"), F.lit(True).alias("removed"))
    stays = exact.select(F.col("keep_id").alias(id_col), F.col("keep_first_word").cast("long").alias("first_word"), F.col("keep_words").cast("long").alias("words"), "class_id", "keep_id", *long("keep_first_word"), F.lit(False).alias("removed")).distinct()
    return near.unionByName(gone).unionByName(stays)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
