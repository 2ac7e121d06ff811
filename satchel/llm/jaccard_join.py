"""N-gram Jaccard join by parity sketches.

Two sets of sizes a <= b with a Jaccard index of at least 3/4 differ in at most (a + b) / 7 elements, and b <= 4a/3.
A set's elements are dealt over K parts by their hash (K by size band) and each part is folded by XOR into a parity
word, so a part's word differs only if the symmetric difference has an element in that part. At most d = (a + b) / 7
parts can differ, so among the first d + 1 non-empty parts of either set, in any order that all sets share, the two
have one in common (pigeonhole). Those parts are the join keys. A pair that meets is first held against 2,048-bit
parity sketches, whose Hamming distance is a lower bound of the symmetric difference, and then verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .membership import maybe_in
from ..storage import dropped, stored
from .tokens import U, hash_shingles, lean, mix, texts_words

#: A sketch has this many 64-bit words, or 4 bits for each element of the size band's smallest set if that is more.
SKETCH_WORDS = 32
#: Sets smaller than this have one part for each element.
SMALL = 64
#: Shingles that are taken as frequent, at most, for the shared order of parts: the most frequent ones. 2 MB.
FREQUENT = 1 << 18


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def set_id(shingles: np.ndarray) -> np.uint64:
    """A 64-bit name of a set of distinct hashes: equal sets have equal names."""
    with np.errstate(over="ignore"):
        return mix(np.array([np.bitwise_xor.reduce(shingles) ^ mix(np.array([shingles.sum(dtype=U)]))[0] ^ U(len(shingles))]))[0]


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity bits: each element flips one. A wide sketch folds by XOR of its halves into that of half the width."""
    bits = 64 * max(SKETCH_WORDS, 2 ** (len(shingles).bit_length() - 5) if len(shingles) >= 1024 else 0)
    bit = np.bincount((shingles & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(bit.astype(np.uint8)).view(U)


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for i, words in texts_words(batch.column(1)):
        yield i, np.unique(hash_shingles(words))


def part_keys(s: np.ndarray, frequent: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The join keys of a set (sorted distinct hashes).

    A set emits keys for its own size band, and for the next band if partners up to 4/3 of its size reach it. Parts
    that hold a frequent element come last in the shared order, so passages that many texts share seldom make keys.
    """
    n = len(s)
    band, most = n.bit_length() - 1, 4 * n // 3
    runs = [(band, (n + min(most, 2 ** (band + 1) - 1)) // 7)]
    if most >= 2 ** (band + 1):
        runs.append((band + 1, (n + most) // 7))
    hot = seen[(s & U(len(seen) - 1)).astype(np.int64)]
    if hot.any():
        at = np.searchsorted(frequent, s[hot]).clip(max=len(frequent) - 1)
        hot[hot] = frequent[at] == s[hot]
    out = []
    for b, d in runs:
        if 2**b < SMALL:
            key, rare = mix(s ^ U(b + 1)), ~hot
        else:
            part = s >> U(63 - b)  # K = 2 ** (b + 1) parts; s is sorted, so a part is a run
            start = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            key, rare = mix(np.bitwise_xor.reduceat(s, start) ^ mix(part[start] + U(b << 40))), ~np.logical_or.reduceat(hot, start)
        if len(key) > d + 1:
            rank = (key >> U(1)) | (U(1) - rare.astype(U)) << U(63)
            key = key[np.argpartition(rank, d)[: d + 1]]
        out.append(key)
    return np.concatenate(out)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """docs(id, text) -> rows (id, n, set_id, sketch) of every text, and rows (shingle, times) of what is frequent in a task's share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n", "set_id", "sketch", "shingle", "times"]
        for b in batches:
            ns, ids, sketches, pool, size = [], [], [], [], 0

            def common(pool: list[np.ndarray]) -> pa.RecordBatch:
                value, times = np.unique(np.concatenate(pool), return_counts=True)
                value, times = value[times >= 4], times[times >= 4]
                none = lambda t: pa.nulls(len(value), t)
                return pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.list_(pa.int64())), _signed(value), pa.array(times)], names)

            for _, s in _sets(b):
                ns.append(len(s))
                ids.append(set_id(s) if len(s) else U(0))
                sketches.append(sketch(s))
                pool.append(s)
                size += len(s)
                if size > 4_000_000:
                    yield common(pool)
                    pool, size = [], 0
            if size:
                yield common(pool)
            if ns:
                flat = _signed(np.concatenate(sketches))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sketches)]), pa.int32()), flat)
                none = pa.nulls(len(ns), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(ns, pa.int64()), _signed(np.array(ids, U)), lists, none, none], names)

    return docs.mapInArrow(lean(run), "id long, n long, set_id long, sketch array<long>, shingle long, times long")


def key_rows(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """docs(id, text) -> (key, set_id). A task emits a set once, however many copies it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 20, bool)
        seen[(frequent & U(len(seen) - 1)).astype(np.int64)] = True
        done: set[int] = set()
        for b in batches:
            keys, owners, size = [], [], 0
            for _, s in _sets(b):
                if len(s) and (name := int(set_id(s))) not in done:
                    done.add(name)
                    keys.append(part_keys(s, frequent, seen))
                    owners.append(np.full(len(keys[-1]), U(name)))
                    size += len(keys[-1])
                    if size > 1_000_000:
                        yield pa.RecordBatch.from_arrays([_signed(np.concatenate(keys)), _signed(np.concatenate(owners))], ["key", "set_id"])
                        keys, owners, size = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(keys)), _signed(np.concatenate(owners))], ["key", "set_id"])

    return docs.select("id", "text").mapInArrow(lean(run), "key long, set_id long")


def whole_sets(docs: DataFrame) -> DataFrame:
    """docs(id, text) -> (set_id, shingles), once per set and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in batches:
            names, sets, size = [], [], 0
            for _, s in _sets(b):
                if len(s) and (name := int(set_id(s))) not in done:
                    done.add(name)
                    names.append(name)
                    sets.append(s)
                    size += len(s)
                    if size > 500_000:
                        yield _set_batch(names, sets)
                        names, sets, size = [], [], 0
            if sets:
                yield _set_batch(names, sets)

    return docs.select("id", "text").mapInArrow(lean(run), "set_id long, shingles array<long>")


def _set_batch(names: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, sets)])
    return pa.RecordBatch.from_arrays([_signed(np.array(names, U)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(np.concatenate(sets)))], ["set_id", "shingles"])


def _side(df: DataFrame, x: str, *cols: str) -> DataFrame:
    return df.select(F.col("set_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in cols])


def _folded(sketch: Column) -> Column:
    """A sketch of SKETCH_WORDS words: a wider one folded by XOR."""
    fold = F.transform(F.sequence(F.lit(0), F.lit(SKETCH_WORDS - 1)), lambda i: F.aggregate(F.filter(sketch, lambda x, k: k % SKETCH_WORDS == i), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y)))
    return F.when(F.size(sketch) > SKETCH_WORDS, fold).otherwise(sketch)


def _apart(a: str, b: str, words: range) -> Column:
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in words), F.lit(0))


def _measured(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """pairs(a, b) with sizes and `apart`, the distance of their folded sketches."""
    p = pairs.join(_side(sketches, "a", "n", "f"), "a").join(_side(sketches, "b", "n", "f"), "b")
    return p.select("a", "b", "n_a", "n_b", _apart("f_a", "f_b", range(SKETCH_WORDS)).alias("apart"))


def _near(measured: DataFrame, sketches: DataFrame) -> DataFrame:
    """Of measured pairs, those whose sizes and sketches, at the width that both have, leave a link possible."""
    p = measured.where("4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b) and apart * 7 <= n_a + n_b")
    p = p.join(_side(sketches, "a", "wide"), "a").join(_side(sketches, "b", "wide"), "b")
    width = F.least(F.size("wide_a"), F.size("wide_b"))
    xor = lambda x, y: x.bitwiseXOR(y)
    halved = lambda c: F.when(F.size(c) > width, F.zip_with(F.slice(c, 1, width), F.slice(c, width + 1, width), xor)).otherwise(F.col(c))
    apart = F.aggregate(F.zip_with(halved("wide_a"), halved("wide_b"), lambda x, y: F.bit_count(xor(x, y))), F.lit(0), lambda s, x: s + x)
    both = F.col("wide_a").isNotNull() & F.col("wide_b").isNotNull()
    return p.where(F.when(both, apart * 7 <= F.col("n_a") + F.col("n_b")).otherwise(F.lit(True))).select("a", "b", "n_a", "n_b")


def _verified(near: DataFrame, sets: DataFrame) -> DataFrame:
    """Of near pairs, those whose sets link."""
    p = near.join(_side(sets, "a", "shingles"), "a").join(_side(sets, "b", "shingles"), "b")
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return p.where(100 * both >= 75 * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id, set_id.

    Texts link when the Jaccard index of their sets of five-word shingles is at least 0.75; component_id is the smallest
    id that links reach. Equal sets are one set from the start. The members of a bucket (sets with a key in
    common) are not all paired: each is compared with the bucket's leader, and what is then
    linked through any path needs no comparison; only pairs of a bucket whose members still lie in different
    components are all compared, so no link is lost. Their sizes, distances to the leader and sketches are held against each other inside that join.

    Defined cases: null, empty and blank texts have no shingles, link with nothing and are their own component; texts
    of one to four words are one shingle; rows with a null id get no links, and component_id null; repeated rows are rows of their own
    with the same component; an empty table gives no rows; other columns are ignored. Hash collisions
    (2**-64 a pair of shingles) are taken as never happening; so is a set that has fewer than d + 1 non-empty
    parts (below 1e-15 for any set; sets under 64 elements can't). A very long text is a set as any other, with a sketch as wide as it needs.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    made = stored(shingle_sets(docs), "sets")
    top = made.where("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "shingle").limit(FREQUENT)
    frequent = np.sort(np.array([r[0] for r in top.select("shingle").collect()], np.int64).view(U))
    rows = made.where("n is not null").select("id", "n", "set_id", "sketch")
    real = rows.where("n > 0 and id is not null")
    reps = real.groupBy("set_id").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))

    by_key = Window.partitionBy("key")
    keyed = key_rows(docs.where("id is not null"), frequent)
    keyed = keyed.select("key", "set_id", F.min("set_id").over(by_key).alias("lead"), F.max("set_id").over(by_key).alias("last"))
    keyed = keyed.where("lead < last").select("key", "set_id").distinct()
    # Buckets with the same members ask for the same comparisons: one of them is kept.
    keyed = keyed.select("key", "set_id", F.expr("bit_xor(xxhash64(set_id)) OVER (PARTITION BY key)").alias("sig"), F.count(F.lit(1)).over(by_key).alias("members"))
    keyed = keyed.select("key", "set_id", F.min("key").over(Window.partitionBy("sig", "members")).alias("one"))
    buckets = stored(keyed.where("key = one").select("key", "set_id"), "buckets")
    reps = reps.join(buckets.select("set_id").distinct(), "set_id", "left_semi")
    wide = F.when(F.size("sketch") > SKETCH_WORDS, F.col("sketch"))  # a set under 1,024 shingles has no more than the folded sketch
    reps = stored(reps.select("set_id", "rep", "n", _folded(F.col("sketch")).alias("f"), wide.alias("wide")), "reps")

    def linked(near: DataFrame) -> DataFrame:
        # Whole sets are made again only for what is near; a bitmap of their documents spares texts a shuffle.
        named = near.select(F.col("a").alias("set_id")).unionAll(near.select("b")).distinct()
        wanted = reps.join(named, "set_id", "left_semi").select(F.col("rep").alias("id"))
        sets = stored(whole_sets(maybe_in(docs, F.col("id"), wanted)), "shingles")
        return stored(_verified(near, sets).distinct(), "links")

    as_pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    # The member that meets most others leads its bucket: of a text and its edited copies, that is the text.
    met = buckets.join(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("met")), "key").groupBy("set_id").agg(F.sum("met").alias("weight"))
    top = buckets.join(met, "set_id").groupBy("key").agg(F.max(F.struct(F.col("weight"), F.xxhash64("set_id"), F.col("set_id"))).alias("top"))
    led = stored(buckets.join(top.select("key", F.col("top.set_id").alias("lead")), "key").where("set_id <> lead"), "led")
    first = stored(_measured(led.select(*as_pair(F.col("set_id"), F.col("lead"))).distinct(), reps), "pairs")
    links = linked(stored(_near(first, reps), "near"))
    comp = components(links)

    # A bucket's other members have met its leader; those that still lie in different components are compared, but for pairs that can't be
    # near: sketches are a metric, so two differ by what their distances to the leader differ by at least. Buckets with one leader hold much the same
    # members, so these meet once below their leader instead of once in each bucket, unless that makes more pairs.
    label = F.coalesce("component", "set_id").alias("comp")
    open_ = led.join(comp.withColumnRenamed("id", "set_id"), "set_id", "left").select("key", "set_id", "lead", label)
    sizes = open_.groupBy("lead", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).cast("double").alias("m")).where("lo < hi")
    open_ = stored(open_.join(sizes.select("lead", "key"), ["lead", "key"], "left_semi"), "open")
    below = open_.select("lead", "set_id").distinct().groupBy("lead").agg(F.count(F.lit(1)).cast("double").alias("members"))
    below = below.join(sizes.groupBy("lead").agg(F.sum(F.col("m") * F.col("m")).alias("in_buckets")), "lead").where("members * members <= in_buckets").select("lead", F.lit(0).cast("long").alias("whole"))
    open_ = open_.join(below, "lead", "left").select("lead", F.coalesce("whole", "key").alias("group"), "set_id", "comp").distinct()
    open_ = open_.select("*", *as_pair(F.col("set_id"), F.col("lead"))).join(first.select("a", "b", "apart"), ["a", "b"])
    half = SKETCH_WORDS // 2
    folded = [F.expr(f"f[{w}] ^ f[{w + half}]").alias(f"f{w}") for w in range(half)]
    mine = stored(open_.join(reps.select("set_id", "n", *folded, *[F.col("f")[w].alias(f"w{w}") for w in range(half)]), "set_id").drop("a", "b"), "met")
    other = mine.select(*[F.col(c).alias(f"{c}_") for c in mine.columns])
    # Plain columns, the cheapest test first: all of it stays one small compiled method.
    sum_n = F.col("n") + F.col("n_")
    xor = lambda c: F.col(c).bitwiseXOR(F.col(f"{c}_"))
    may = (F.col("lead") == F.col("lead_")) & (F.col("group") == F.col("group_")) & (F.col("comp") < F.col("comp_")) & (4 * F.least("n", "n_") >= 3 * F.greatest("n", "n_")) & (7 * F.abs(F.col("apart") - F.col("apart_")) <= sum_n)
    may = may & (7 * sum((F.bit_count(xor(f"f{w}")) for w in range(half)), F.lit(0)) <= sum_n)
    may = may & (7 * sum((F.bit_count(xor(f"w{w}")) + F.bit_count(xor(f"w{w}").bitwiseXOR(xor(f"f{w}"))) for w in range(half)), F.lit(0)) <= sum_n)
    rest = mine.join(other, may).select(*as_pair(F.col("set_id"), F.col("set_id_"))).distinct()
    rest = stored(_near(_measured(rest.join(first, ["a", "b"], "left_anti"), reps), reps), "near")
    if not rest.isEmpty():
        comp = components(links.unionByName(linked(rest)))
    dropped(buckets, led, first, links, mine, rest)
    reached = real.groupBy("set_id").agg(F.min("id").alias("rep"))
    reached = reached.join(comp.withColumnRenamed("id", "set_id"), "set_id", "left").select("set_id", F.coalesce("component", "set_id").alias("component"), "rep")
    least = reached.groupBy("component").agg(F.min("rep").alias("component_id"))
    names = reached.select("set_id", "component").join(least, "component").select("set_id", "component_id")
    out = rows.drop("sketch").join(names, "set_id", "left")
    own = F.when(F.col("n") == 0, F.col("id")).when(F.col("id").isNotNull(), F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), "set_id")


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
