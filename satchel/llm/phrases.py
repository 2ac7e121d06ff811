"""Phrase collocation mining: level by level, Apriori-safe candidates in broadcast double-array tries that numpy walks from all text positions at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import dropped, stored
from .membership import bitmap, in_bitmap
from .tokens import _PLACE, U, blocks, hash_words, lean, mix, text_bytes, word_spans

#: Words of the longest phrase.
LONGEST = 5
#: Candidates of one trie; with two slots a node and three numbers a slot it takes some 30 MB. More candidates make more tries, each walked in its turn.
TRIE = 500_000
#: Words that a task works on at once, and names whose counts it holds.
SLICE, NAMES = 1_000_000, 1_000_000
#: Word keys that a task reads, unless there are fewer tasks than two a core.
TASK = 8_000_000
#: Bits of a hashed phrase on the way to its sum: phrases that share them only make a candidate more.
HASHED = U((1 << 40) - 1)
#: Word keys of a stored row, unless a piece of text is longer.
ROW = 512
SALT = 32
#: Counts of a row on their way to be summed, and rows of a chunk that meet first, at most tasks / PARTS.
CHUNK, PARTS = 4096, 64

_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_APART = _PIECE.copy()
_APART[[0x20, 0x09]] = True


@dataclass
class Words:
    """Words of some texts in order: their keys (of word and language), whether a word starts a piece, its language's number, its bytes."""

    keys: np.ndarray
    fresh: np.ndarray
    lang: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: bytes
    langs: list[str]

    def text(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].lower().decode()  # bytes.lower() turns A-Z alone


def _seed(lang: str) -> np.uint64:
    return U(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _joined(parts: list[tuple], langs: list[str]) -> Words:
    at = np.cumsum([0, *(len(p[5]) for p in parts)])
    keys, fresh, lang = (np.concatenate([p[k] for p in parts]) for k in range(3))
    starts, ends = (np.concatenate([p[k] + np.int32(x) for p, x in zip(parts, at)]) for k in (3, 4))
    return Words(keys, fresh, lang, starts, ends, b"".join(p[5] for p in parts), langs)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """The words of a task's (lang, text) rows, about SLICE at a time."""
    parts, n = [], 0
    number: dict[str, int] = {}
    for batch in batches:
        of_row = np.array([number.setdefault(x, len(number)) for x in batch.column(0).to_pylist()], np.int32)
        seeds = np.array([_seed(x) for x in number], U)
        for first, part in blocks(batch.column(1)):
            data, offsets = text_bytes(part)
            starts, ends, at = word_spans(data, offsets, _APART)
            if not len(starts):
                continue
            piece = np.cumsum(_PIECE[data], dtype=np.int64)[starts]
            fresh = np.ones(len(starts), bool)
            fresh[1:] = piece[1:] != piece[:-1]
            fresh[at[:-1][at[:-1] < len(starts)]] = True
            lang = np.repeat(of_row[first : first + len(part)], np.diff(at))
            keys = np.maximum(mix(hash_words(data, starts, ends) ^ seeds[lang]), U(1))  # 0 parts runs
            parts.append((keys, fresh, lang, starts.astype(np.int32), ends.astype(np.int32), data.tobytes()))
            n += len(starts)
            if n >= SLICE:
                yield _joined(parts, list(number))
                parts, n = [], 0
    if parts:
        yield _joined(parts, list(number))


class Sums:
    """Counts of a task by name, given away once there are NAMES of them: bounds memory, and spares the shuffle what slices have in common."""

    def __init__(self):
        self.names, self.n = np.zeros(0, U), np.zeros(0, np.int64)

    def add(self, names: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        every = np.concatenate([self.names, names])
        order = np.argsort(every, kind="stable")
        every = every[order]
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
        n = np.concatenate([self.n, n])[order]
        self.names, self.n = every[first], np.add.reduceat(n, first) if len(first) else n
        if len(self.names) >= NAMES:
            yield from self.end()

    def end(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if len(self.names):
            yield self.names, self.n
        self.__init__()


@lean
def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, lang, word, n) of each word of a slice, (null, lang, null, n) of each language."""
    names = ["key", "lang", "word", "n"]
    for w in slices(batches):
        total = np.bincount(w.lang, minlength=len(w.langs)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(total), pa.int64()), pa.array(w.langs, pa.string()), pa.nulls(len(total), pa.string()), pa.array(total)], names)
        keys, first, n = np.unique(w.keys, return_index=True, return_counts=True)
        langs = pa.array(w.langs, pa.string()).take(pa.array(w.lang[first]))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), langs, pa.array([w.text(i) for i in first], pa.string()), pa.array(n)], names)


def gram_names(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit name of the k words from each place on; a single word's name is its key."""
    if k == 1 or len(words) < k:
        return words if k == 1 else words[:0]
    with np.errstate(over="ignore"):
        out = words[: len(words) - k + 1] * _PLACE[0]
        for j in range(1, k):
            out += words[j : len(words) - k + 1 + j] * _PLACE[j]
        return mix(out)


def _encoder(bits):
    """Texts -> rows of runs: word keys, a 0 after each run. A run is a stretch of at least two words of one piece that are all frequent, as far as the bitmap tells."""

    @lean
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in slices(batches):
            ok = in_bitmap(bits.value, w.keys)
            follows = np.zeros(len(ok) + 1, bool)  # follows[i]: words i - 1 and i are neighbours in a run
            follows[1:-1] = ok[:-1] & ok[1:] & ~w.fresh[1:]
            kept = np.flatnonzero(follows[:-1] | follows[1:])
            last = ~follows[1:][kept]
            out = np.zeros(len(kept) + last.sum(), U)
            out[np.arange(len(kept)) + np.cumsum(last) - last] = w.keys[kept]
            ends = np.flatnonzero(out == 0) + 1
            ends = ends[np.append(ends[1:] // ROW != ends[:-1] // ROW, True)] if len(ends) else ends
            runs = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(out.view(np.int64)))
            yield pa.RecordBatch.from_arrays([runs.cast(pa.list_(pa.int64()))], ["keys"])

    return encode


def _run_words(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The word keys of runs, about SLICE at a time."""
    for batch in batches:
        rows = batch.column(0)
        ends = rows.offsets.to_numpy()
        flat = rows.values.to_numpy(zero_copy_only=False).view(U)
        cut = np.append(0, np.flatnonzero(np.diff(ends // SLICE)) + 1)
        for a, b in zip(ends[cut], [*ends[cut[1:]], ends[-1]]):
            if b > a:
                yield flat[a:b]


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs -> (name, n) of all pairs of neighbours, hashed."""
    sums = Sums()
    rows = lambda names, n: pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n)], ["name", "n"])
    for words in _run_words(batches):
        both = (words[:-1] != 0) & (words[1:] != 0)
        for x in sums.add(*np.unique(gram_names(words, 2)[both] & HASHED, return_counts=True)):
            yield rows(*x)
    for x in sums.end():
        yield rows(*x)


def _extender(bits, k: int, *, grow: bool):
    """Runs -> (name, k0, k1, ...) of the (k - 1)-word phrases in the bitmap, once a task or so, and if `grow` (hashed name, n) of k-word phrases whose first and last
    k - 1 words are in it."""

    def counted(names: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), *[pa.nulls(len(names), pa.int64())] * LONGEST, pa.array(n)], _GROWN)

    @lean
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, told = Sums(), np.zeros(0, U)
        for words in _run_words(batches):
            if len(words) < k - 1:
                continue
            inside = words != 0
            whole = np.logical_and.reduce([inside[j : len(words) - k + 2 + j] for j in range(k - 1)])
            shorter = gram_names(words, k - 1)
            often = whole & in_bitmap(bits.value, shorter)
            at = np.flatnonzero(often)
            names, first = np.unique(shorter[at], return_index=True)
            new = ~np.isin(names, told, assume_unique=True)
            told = np.union1d(told, names) if len(told) < NAMES else names
            spots = at[first[new]]
            cols = [words[spots + j].view(np.int64) if j < k - 1 else np.zeros(len(spots), np.int64) for j in range(LONGEST)]
            yield pa.RecordBatch.from_arrays([pa.array(names[new].view(np.int64)), *map(pa.array, cols), pa.nulls(len(spots), pa.int64())], _GROWN)
            if grow and len(words) >= k:
                for x in sums.add(*np.unique(gram_names(words, k)[often[:-1] & often[1:]] & HASHED, return_counts=True)):
                    yield counted(*x)
        for x in sums.end():
            yield counted(*x)

    return extend


_KEYS = [f"k{j}" for j in range(LONGEST)]
_GROWN = ["name", *_KEYS, "n"]


@dataclass
class Trie:
    """A double-array trie over word keys: from state s, code c leads to slot base[s] + c if check[slot] is s. Codes are places in the sorted alphabet, from 1."""

    alphabet: np.ndarray
    base: np.ndarray
    check: np.ndarray
    accepts: np.ndarray  # the number of the phrase that ends at a slot, else -1

    def codes(self, words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, words), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == words, at + 1, 0)

    def walk(self, words: np.ndarray, longest: int = LONGEST) -> Iterator[np.ndarray]:
        """Level by level, the numbers of the phrases that end there, from any place: all places advance together, and those without a next state fall out."""
        codes = np.append(self.codes(words), np.zeros(longest, np.int64))
        at = np.flatnonzero(codes)
        state = np.zeros(len(at), np.int64)
        for j in range(longest):
            code = codes[at + j]
            slot = self.base[state] + code
            alive = (code > 0) & (self.check[slot] == state)
            at, state = at[alive], slot[alive]
            number = self.accepts[state]
            yield number[number >= 0]


def build_trie(phrases: np.ndarray) -> tuple[Trie, np.ndarray]:
    """The trie of the rows of phrases (different rows of word keys, filled up with 0 behind), and the row that each number stands for.

    Nodes with many children are placed first, at bases tried at random where all their slots are free; those with one child fill free slots.
    """
    alphabet = np.unique(phrases)
    alphabet = alphabet[alphabet != 0]
    codes = np.where(phrases != 0, np.searchsorted(alphabet, phrases) + 1, 0)
    order = np.lexsort(codes.T[::-1])
    codes = codes[order]
    n, k = codes.shape
    differs = np.ones((n, k), bool)
    differs[1:] = np.logical_or.accumulate(codes[1:] != codes[:-1], axis=1)
    differs &= codes > 0
    a = len(alphabet)
    size = int(2 * differs.sum() + 3 * a + 64)
    free = np.ones(size, bool)
    free[0] = False
    base, check, accepts = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)

    def room_for(more: int) -> None:
        nonlocal free, base, check, accepts, size
        free = np.append(free, np.ones(more, bool))
        base, check, accepts = (np.append(x, np.full(more, y)) for x, y in ((base, 0), (check, -1), (accepts, -1)))
        size += more

    rng = np.random.default_rng(1)
    state = np.zeros(n, np.int64)  # of each row's first words
    for j in range(k):
        first = np.flatnonzero(differs[:, j])
        if not len(first):
            break
        parent, code = state[first], codes[first, j]
        starts = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        children = np.diff(np.append(starts, len(parent)))
        slot = np.zeros(len(parent), np.int64)
        for g in np.argsort(-children, kind="stable"):
            if children[g] == 1:
                break
            own = code[starts[g] : starts[g] + children[g]]
            while True:
                tries = rng.integers(0, size - a - 1, 32)
                fits = free[tries[:, None] + own].all(axis=1)
                if fits.any():
                    break
                if rng.random() < 1 / 64:  # too dense for this node
                    room_for(a + 1)
            b = tries[np.argmax(fits)]
            slot[starts[g] : starts[g] + children[g]] = b + own
            base[parent[starts[g]]] = b
            free[b + own] = False
        single = starts[children == 1]
        room = np.flatnonzero(free[a : size - a - 1])[: len(single)] + a
        if len(room) < len(single):
            more = len(single) - len(room)
            room = np.append(room, np.arange(size, size + more))
            room_for(more + a + 1)
        slot[single] = room
        base[parent[single]] = room - code[single]
        free[room] = False
        check[slot] = parent
        inside = codes[:, j] > 0
        state = np.where(inside, slot[np.maximum(np.cumsum(differs[:, j]) - 1, 0)], state)
        ends = np.flatnonzero(inside & (codes[:, j + 1] == 0)) if j + 1 < k else np.flatnonzero(inside)
        accepts[state[ends]] = ends
    return Trie(alphabet, base.astype(np.int32), check.astype(np.int32), accepts.astype(np.int32)), order


def _packed(key, rows):
    trie, order = build_trie(np.column_stack([rows[c].to_numpy(np.int64) for c in _KEYS]).view(U))
    names = rows["name"].to_numpy(np.int64)[order]
    return pd.DataFrame([[key[0], names.tobytes(), *(x.tobytes() for x in (trie.alphabet, trie.base, trie.check, trie.accepts))]], columns=["trie", "names", "alphabet", "base", "check", "accepts"])


def _counter(held):
    """Runs -> (chunk, part, counts): how often a task has seen the phrases of one trie, by their numbers, CHUNK to a row."""

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, *arrays = (np.frombuffer(x, t) for x, t in zip(held.value, (np.int64, U, np.int32, np.int32, np.int32)))
        trie, total = Trie(*arrays), np.zeros(-(-len(names) // CHUNK) * CHUNK, np.int64)
        for words in _run_words(batches):
            for numbers in trie.walk(words):
                total += np.bincount(numbers, minlength=len(total))
        total = total.reshape(-1, CHUNK)
        seen = np.flatnonzero(total.any(axis=1))
        counts = pa.ListArray.from_arrays(pa.array(np.arange(len(seen) + 1, dtype=np.int32) * CHUNK), pa.array(total[seen].ravel()))
        part = np.full(len(seen), TaskContext.get().partitionId() % PARTS, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(part), counts], ["chunk", "part", "counts"])

    return count


def _namer(held, least: int):
    """(chunk, counts) -> (name, f) of those that come at least `least` times."""

    @lean
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.frombuffer(held.value[0], np.int64)
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                f = counts.values.to_numpy()
                often = np.flatnonzero(f >= least)
                yield pa.RecordBatch.from_arrays([pa.array(names[chunk * CHUNK + often]), pa.array(f[often])], ["name", "f"])

    return name


def _counted(runs: DataFrame, candidates: DataFrame, least: int) -> DataFrame:
    """name, keys, f of the candidates that come at least `least` times: tries built in tasks, broadcast one after the other, walked over all runs, counts summed."""
    spark = runs.sparkSession
    tries = -(-candidates.count() // TRIE)
    built = candidates.withColumn("trie", F.pmod(F.xxhash64("name"), F.lit(tries)).cast("int")) if tries > 1 else candidates.withColumn("trie", F.lit(0))
    built = stored(built.groupBy("trie").applyInPandas(_packed, "trie int, names binary, alphabet binary, base binary, check binary, accepts binary"), "tries")
    total = F.aggregate(F.collect_list("counts"), F.array_repeat(F.lit(0).cast("long"), CHUNK), lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias("counts")
    done = []
    for i in range(tries):
        row = built.where(F.col("trie") == i).first()  # one trie, of TRIE candidates or so
        if row is None:
            continue
        held = spark.sparkContext.broadcast(tuple(bytes(x) for x in row[1:]))
        counts = runs.mapInArrow(_counter(held), "chunk int, part int, counts array<bigint>")
        counts = counts.groupBy("chunk", "part").agg(total).groupBy("chunk").agg(total)  # a chunk's rows, one a task, meet in PARTS parts first
        done.append(stored(counts.mapInArrow(_namer(held, least), "name long, f long"), "counts"))
        held.destroy()
    keys = F.filter(F.array(*_KEYS), lambda x: x != 0).alias("keys")
    if not done:
        return candidates.select("name", keys, F.lit(0).cast("long").alias("f"))
    counts = done[0]
    for more in done[1:]:
        counts = counts.unionByName(more)
    out = stored(candidates.select("name", keys).join(counts, "name"), "frequent")
    dropped(built, *done)
    return out


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, min_count: int = 100, top: int = 2000, absorb: int = 100, longest: int = LONGEST) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at [.,;:!?\\x0A-\\x0D] and those into words [^\\x20\\x09]+. Phrases have 2 to `longest` (at most 5) words of
    one piece and come a >= min_count times in their language, overlaps included. score: the lowest floor(1000 a n / (l r)) of all cuts
    into a first part (l times) and a rest (r times), n words in all; of equal cuts the first. A phrase goes if a longer one that has at least
    min_count holds it and comes at least absorb % as often. Arithmetic is decimal, exact to 38 digits.

    Level by level, phrases are counted by a hash, summed by a shuffle, if their first and last words are frequent by the level before (a bitmap of fixed size tells):
    what comes min_count times by hash is a candidate, so no frequent phrase is lost. All candidates, of all lengths, become double-array tries of a
    bounded size, broadcast one after the other, that numpy walks from all places of the texts at once, word by word; accepting states are counted by bincount, and
    counts summed over tasks. Texts are read twice, for words and for runs of frequent words; only the runs, as word keys, are stored and read again for each level.

    Defined cases: null text is empty, null language is `und`; repeated rows count as often as they come; a very long text
    is worked on in its task, one row of runs unless it has a mark or a rare word; ties of score and count go by phrase in byte order; empty tables give no rows; other columns,
    whatever their names, are ignored.
    """
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"phrases have 2 to {LONGEST} words")
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = texts.mapInArrow(_count_words, "key long, lang string, word string, n long").groupBy("key", "lang", "word").agg(F.sum("n").alias("n"))
    counted = stored(counted.where((F.col("n") >= min_count) | F.col("key").isNull()), "words")
    totals, words = counted.where("key is null").select("lang", "n"), counted.where("key is not null").select("key", "lang", "word", F.col("n").alias("f"))
    bits = bitmap(words.select("key"))
    whole = stored(texts.mapInArrow(_encoder(bits), "keys array<bigint>"), "runs")
    bits.destroy()
    n = whole.agg(F.sum(F.size("keys"))).first()[0] or 0
    runs = whole.coalesce(max(2 * docs.sparkSession.sparkContext.defaultParallelism, n // TASK + 1))  # a task tells a phrase once, so fewer tasks tell less
    pairs = runs.mapInArrow(lean(_pair_counts), "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    bits, candidates, old = bitmap(pairs.select("name")), [], [whole]
    schema = ", ".join(f"{c} long" for c in _GROWN)
    for k in range(3, longest + 2):
        grown = runs.mapInArrow(_extender(bits, k, grow=k <= longest), schema)
        grown = grown.groupBy("name", F.col("k0").isNull().alias("hashed")).agg(*[F.min(c).alias(c) for c in _KEYS], F.sum("n").alias("n"))
        grown = stored(grown.where((F.col("n") >= min_count) | ~F.col("hashed")), f"grown{k}")
        old.append(grown)
        candidates.append(grown.where("not hashed").select("name", *_KEYS))
        bits.destroy()
        bits = bitmap(grown.where("hashed").select("name"))
    bits.destroy()
    found = candidates[0]
    for more in candidates[1:]:
        found = found.unionByName(more)
    found = _counted(runs, found, min_count)
    out = _ranked(found, words, totals, top, absorb)
    dropped(*old)
    return out


def _ranked(found: DataFrame, words: DataFrame, totals: DataFrame, top: int, absorb: int) -> DataFrame:
    size = F.size("keys")
    part = F.transform(F.sequence(F.lit(2), F.greatest(size - 1, F.lit(2))), lambda k: F.transform(F.sequence(F.lit(1), F.greatest(size - k + 1, F.lit(1))), lambda i: F.slice("keys", i, k)))
    inner = found.where(size > 2).select(F.explode(F.array_distinct(F.flatten(part))).alias("keys"), F.col("f").alias("longer")).groupBy("keys").agg(F.max("longer").alias("longer"))
    own = found.join(inner, "keys", "left").where(F.coalesce(F.lit(100) * F.col("longer") < F.lit(absorb) * F.col("f"), F.lit(True)))
    parts = words.select(F.array("key").alias("part"), F.col("f").alias("n_part")).unionByName(found.select(F.col("keys").alias("part"), F.col("f").alias("n_part")))
    cuts = own.select("name", "keys", "f", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    cuts = cuts.withColumns({"head": F.slice("keys", 1, F.col("cut")), "tail": F.slice("keys", F.col("cut") + 1, size - F.col("cut"))})
    cuts = cuts.join(parts.select(F.col("part").alias("head"), F.col("n_part").alias("l")), "head").join(parts.select(F.col("part").alias("tail"), F.col("n_part").alias("r")), "tail")
    cuts = cuts.select("name", "keys", "f", "cut", "l", "r")
    word = own.select("name", F.posexplode("keys").alias("i", "key")).join(words.select("key", "lang", "word"), "key")
    word = word.groupBy("name").agg(F.min("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))  # five words at most
    big = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.join(word, "name").join(totals, "lang").withColumns({"upper": big("f") * big("n") * F.lit(1000).cast("decimal(4,0)"), "lower": big("l") * big("r")})
    scored = scored.withColumn("score", F.expr("upper div lower"))
    best = scored.groupBy("name").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"), F.first("lang").alias("lang"), F.first("phrase").alias("phrase"), F.first("f").alias("a"), F.first("n").alias("n"))
    order = [F.col("best.score").desc(), F.col("a").desc(), F.col("phrase")]
    some = best.withColumn("__salt", F.pmod(F.xxhash64("phrase"), F.lit(SALT)))  # the best of each part first, so that no task ranks a whole language
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__salt").orderBy(*order))).where(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    out = some.withColumn("rank", rank).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))


def op11_phrases(spark, sf_dir: str) -> DataFrame:
    return phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]'), lambda x: x <> '') AS ws FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS p FROM words, range(1, 6) AS t(k) WHERE len(ws) >= k
), f AS (SELECT lang, k, p, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT *, array_to_string(p, ' ') AS phrase FROM f WHERE k >= 2 AND f >= 100),
kept AS (
  SELECT * FROM cand c WHERE NOT EXISTS (
    SELECT 1 FROM cand d WHERE d.lang = c.lang AND d.k > c.k AND 100 * d.f >= 100 * c.f AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, j, x.f AS l, y.f AS r, n.n, (1000::HUGEINT * c.f * n.n) // (x.f::HUGEINT * y.f) AS score
  FROM kept c JOIN range(1, 5) AS t(j) ON j < c.k JOIN f x ON x.lang = c.lang AND x.p = c.p[1:j] JOIN f y ON y.lang = c.lang AND y.p = c.p[j + 1:] JOIN totals n ON n.lang = c.lang
), best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS nr FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE nr = 1)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""
