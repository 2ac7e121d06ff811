"""Best-fit packing of token sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, stored
from .token_ids import encoder
from .tokens import blocks, lean

#: Tokens of a sequence, and the id that ends a document.
SIZE, END = 1024, 2
#: Pieces that are packed together, about; each block is packed on ISLANDS islands.
BLOCK, ISLANDS = 8192, 3
#: Solutions of an island, children of an epoch, epochs at most, solutions that move to the next island after each.
PEOPLE, CHILDREN, EPOCHS, ELITE = 4, 8, 8, 1
#: The least filled share of a block's sequences that is packed anew with those of other blocks.
AGAIN = 1 / 8


def pieces_of(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of a document of n tokens: whole if it fits, else pieces of `size`, the first one of what is over."""
    first = (n - 1) % size + 1
    return [(0, first), *((s, size) for s in range(first, n, size))]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """id, piece, start, length, ids_crc32 of each piece of each row's token ids and the id that ends it. No shuffle."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(path)
        for batch in batches:
            for first, part in blocks(batch.column(1)):
                rows = []
                for i, ids in enumerate(library.all_ids(part.to_pylist())):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    rows += [(first + i, k, s, n, zlib.crc32(ids[s : s + n])) for k, (s, n) in enumerate(pieces_of(len(ids), size))]
                of, *cols = (pa.array(c, pa.int64()) for c in zip(*rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), cols[0].cast(pa.int32()), *cols[1:]], ["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long")


Bins = tuple[list[list[int]], list[int]]


def best_fit(items, lengths: list[int], packed: Bins, size: int) -> None:
    """Put items, in their order, each into the fullest bin that has room, or a new one. A number's bits tell which rooms there are, so each item is one look."""
    bins, fills = packed
    with_room: dict[int, list[int]] = {}
    rooms = 0
    for b, fill in enumerate(fills):
        with_room.setdefault(size - fill, []).append(b)
        rooms |= 1 << (size - fill)
    for i in items:
        n = lengths[i]
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
            bins[b].append(i)
            fills[b] += n
            room -= n
        else:
            b, room = len(bins), size - n
            bins.append([i])
            fills.append(n)
        with_room.setdefault(room, []).append(b)
        rooms |= 1 << room


def bound(lengths: list[int], size: int) -> int:
    """No packing has fewer bins: neither than the total length fills, nor than pieces that can't share one."""
    return max(-(-sum(lengths) // size), sum(2 * n > size for n in lengths))


def fitness(packed: Bins) -> tuple[int, int]:
    """Fewer bins are better; of equally many, those that are more unevenly filled."""
    return -len(packed[0]), sum(f * f for f in packed[1])


class Loose:
    """Items out of bins, by length; two numbers' bits tell which lengths there are, forwards and backwards, so that two of a given sum are found at once."""

    def __init__(self, items, lengths: list[int], size: int):
        self.of, self.lengths, self.size, self.there, self.back = {}, lengths, size, 0, 0
        for i in items:
            self.put(i)

    def put(self, i: int) -> None:
        n = self.lengths[i]
        self.of.setdefault(n, []).append(i)
        self.there |= 1 << n
        self.back |= 1 << (self.size - n)

    def take(self, n: int) -> int:
        i = self.of[n].pop()
        if not self.of[n]:
            self.there ^= 1 << n
            self.back ^= 1 << (self.size - n)
        return i

    def of_length(self, n: int) -> list[int]:
        """One or two items of this length together, taken out, if there are such."""
        if self.there >> n & 1:
            return [self.take(n)]
        pairs = self.there & (self.back >> (self.size - n)) & ((1 << n) - 1)
        if n % 2 == 0 and pairs >> (n // 2) & 1 and len(self.of[n // 2]) < 2:
            pairs ^= 1 << (n // 2)
        if not pairs:
            return []
        k = pairs.bit_length() - 1
        return [self.take(k), self.take(n - k)]


def refill(packed: Bins, out, lengths: list[int], size: int) -> None:
    """Put items back: bins are first filled to the brim where one or two of the items do so, alone or in the place of one or two that then are out; the rest
    goes in by best fit, the long ones first."""
    bins, fills = packed
    loose = Loose(out, lengths, size)
    for b, fill in enumerate(fills):
        if fill == size:
            continue
        own, room = bins[b], size - fill
        ways = [(), *((i,) for i in range(len(own))), *(((i, j) for i in range(len(own)) for j in range(i)) if len(own) < 8 else ())]
        for gone in ways:
            new = loose.of_length(room + sum(lengths[own[i]] for i in gone))
            if new:
                for i in gone:
                    loose.put(own[i])
                bins[b] = [x for i, x in enumerate(own) if i not in gone] + new
                fills[b] = size
                break
    rest = [i for n in sorted(loose.of, reverse=True) for i in loose.of[n]]
    best_fit(rest, lengths, packed, size)


def crossover(one: Bins, two: Bins, lengths: list[int], size: int, rng) -> Bins:
    """A child of one: whole well-filled bins of two are put in, bins of one that hold any of their items go, and what those held besides is put back (see refill)."""
    order = sorted(range(len(two[0])), key=lambda b: -two[1][b])
    good = order[: max(1, len(order) // 2)]
    take = [good[k] for k in np.flatnonzero(rng.random(len(good)) < rng.uniform(0.05, 0.5))]
    inside = {i for b in take for i in two[0][b]}
    bins, fills, out = [list(two[0][b]) for b in take], [two[1][b] for b in take], []
    for items, fill in zip(*one):
        if inside.isdisjoint(items):
            bins.append(list(items))
            fills.append(fill)
        else:
            out += [i for i in items if i not in inside]
    refill((bins, fills), out, lengths, size)
    return bins, fills


def mutated(packed: Bins, lengths: list[int], size: int, rng) -> Bins:
    """The least filled bins and some others are emptied, and their items put back (see refill)."""
    bins, fills = packed
    order = sorted(range(len(bins)), key=lambda b: fills[b])
    gone = {*order[: 2 + len(order) // 64], *(int(b) for b in rng.integers(0, len(bins), 2 + len(bins) // 64))}
    left = [b for b in range(len(bins)) if b not in gone]
    child = [list(bins[b]) for b in left], [fills[b] for b in left]
    refill(child, [i for b in gone for i in bins[b]], lengths, size)
    return child


def as_bins(of_item: list[int], lengths: list[int]) -> Bins:
    bins: list[list[int]] = [[] for _ in range(max(of_item, default=-1) + 1)]
    for i, b in enumerate(of_item):
        bins[b].append(i)
    return bins, [sum(lengths[i] for i in x) for x in bins]


def of_items(packed: Bins, n: int) -> list[int]:
    out = [0] * n
    for b, items in enumerate(packed[0]):
        for i in items:
            out[i] = b
    return out


def evolve(lengths: list[int], people: list[list[int]], seed: list[int], *, size: int = SIZE, children: int = CHILDREN) -> tuple[list[list[int]], int, int]:
    """An island's solutions (the bin of each item) after an epoch, the best first; that one's number of bins, and the best one's before the first child.

    At first, one is best fit by falling length, the others are so with noise. A child takes the place of the worst if it is better. It ends early
    once a solution has as few bins as can be (see bound).
    """
    rng = np.random.default_rng(seed)
    least = bound(lengths, size)
    found = [as_bins(p, lengths) for p in people]
    if not found:
        for k in range(PEOPLE):
            packed: Bins = ([], [])
            noise = rng.normal(0, 30 * k, len(lengths)) if k else np.zeros(len(lengths))
            best_fit([i for _, i in sorted((-n + e, i) for i, (n, e) in enumerate(zip(lengths, noise)))], lengths, packed, size)
            found.append(packed)
            if len(packed[0]) <= least:
                break
    found.sort(key=fitness, reverse=True)
    began = len(found[0][0])
    for _ in range(children):
        if len(found[0][0]) <= least:
            break
        a, b = rng.integers(0, len(found), 2)
        child = crossover(found[a], found[b], lengths, size, rng) if a != b else found[a]
        child = mutated(child, lengths, size, rng)
        if len(found) < PEOPLE or fitness(child) > fitness(found[-1]):
            found = sorted([*found[: PEOPLE - 1], child], key=fitness, reverse=True)
    return [of_items(p, len(lengths)) for p in found], len(found[0][0]), began


def _evolver(epoch: int, seed: int, size: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):  # a block of one island at a time
                block, island, rids, lengths, people = (batch.column(c)[row].as_py() for c in range(5))
                people, bins, began = evolve(lengths, people, [seed, epoch, block, island], size=size)
                cols = [[block], [island], [rids], [lengths], [people], [bins], [bins > bound(lengths, size) and bins < began]]
                kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["block", "island", "rids", "lengths", "people", "bins", "hopeful"])

    return run


_STATE = "block long, island int, rids array<bigint>, lengths array<int>, people array<array<int>>, bins int, hopeful boolean"


@lean
def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's solution -> rid, sequence_id (the smallest rid in it), offset, and the place of its sequence among the block's, by filling."""
    for batch in batches:
        for row in range(batch.num_rows):
            rids, lengths, of_item = (batch.column(c)[row].as_py() for c in range(3))
            bins, fills = as_bins(of_item, lengths)
            out = []
            for rank, b in enumerate(sorted(range(len(bins)), key=lambda b: fills[b])):
                at, name = 0, min(rids[i] for i in bins[b])
                for i in bins[b]:
                    out.append((rids[i], name, at, lengths[i], rank, fills[b], len(bins)))
                    at += lengths[i]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["rid", "sequence_id", "offset", "length", "rank", "fill", "n"])


def _pack_blocks(items: DataFrame, n_blocks: int, seed: int, size: int) -> DataFrame:
    """items(rid, length), rids all different -> rid, sequence_id, offset, length, rank, fill, n, after EPOCHS epochs of ISLANDS islands a block."""
    block = items.withColumn("block", F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(n_blocks))).groupBy("block")
    block = block.agg(F.array_sort(F.collect_list(F.struct("rid", "length"))).alias("items"))  # BLOCK rows or so: rids are dealt evenly
    block = block.select("block", F.col("items.rid").alias("rids"), F.transform("items.length", lambda n: n.cast("int")).alias("lengths"))
    state = block.select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "rids", "lengths", F.array().cast("array<array<int>>").alias("people"))
    settled, old = [], []
    for epoch in range(EPOCHS):
        spread = state.repartition(n_blocks * ISLANDS, "block", "island")
        state = stored(spread.mapInArrow(_evolver(epoch, seed, size), _STATE), f"epoch{epoch}")
        old.append(state)
        best = state.groupBy("block").agg(F.min(F.struct("bins", "island")).alias("best"), F.max("hopeful").alias("hopeful"))
        if epoch == EPOCHS - 1 or best.where("hopeful").isEmpty():
            break
        done = best.where("not hopeful").select("block", F.col("best.island").alias("island"))
        settled.append(state.join(done, ["block", "island"]).select("rids", "lengths", F.col("people")[0].alias("of_item")))
        open_ = state.join(best.where("hopeful").select("block"), "block").drop("bins", "hopeful")
        guests = open_.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.slice("people", 1, ELITE).alias("guests"))
        state = open_.join(guests, ["block", "island"]).withColumn("people", F.concat(F.slice("people", 1, PEOPLE - ELITE), "guests")).drop("guests")
    done = best.select("block", F.col("best.island").alias("island"))
    out = state.join(done, ["block", "island"]).select("rids", "lengths", F.col("people")[0].alias("of_item"))
    for more in settled:
        out = out.unionByName(more)
    out = stored(out.mapInArrow(_laid_out, "rid long, sequence_id long, offset long, length long, rank long, fill long, n long"), "laid_out")
    dropped(*old)
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None, size: int = SIZE, end: int = END, seed: int = 1) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset; sequences of at most `size` tokens, as few as the search finds.

    A document is its token ids and `end`; only longer ones than `size` are cut, into pieces of `size` tokens, the first of what is over. Whole pieces are sequences by themselves. The
    others are dealt over blocks of about BLOCK pieces by a hash; each block is packed on ISLANDS islands by a grouping genetic algorithm
    (see crossover), whose best solutions move to the next island after each epoch; the best of a block's islands stands. A block is
    done once it has as few sequences as can be, or an epoch made none of its islands better. Then the least filled sequences of all blocks are opened and packed again, in an eighth as many blocks,
    until one block has been packed: so what blocks waste is made good between them.

    Only piece numbers and lengths are shuffled. Defined cases: null and empty texts are the end id alone; null ids and repeated rows are documents of their own; a very long text
    is many pieces; ties of length don't matter; an empty table gives no rows; other columns, whatever their names, are ignored. Sequence ids are arbitrary numbers.
    """
    cut = stored(token_pieces(docs, id_col, text_col, path=path, size=size, end=end).withColumn("rid", F.monotonically_increasing_id()), "pieces")
    left = cut.where(F.col("length") < size).select("rid", "length")
    n_blocks = -(-left.count() // BLOCK)
    placed, round_no = [], 0
    while n_blocks:
        laid = _pack_blocks(left, n_blocks, seed + round_no, size)
        again = (F.col("rank") < F.ceil(F.col("n") * AGAIN)) & (F.col("fill") < size) if n_blocks > 1 else F.lit(False)
        placed.append(laid.where(~again).select("rid", "sequence_id", "offset"))
        left = laid.where(again).select("rid", "length")
        if n_blocks == 1 or left.isEmpty():
            break
        n_blocks = -(-n_blocks // 8)
        round_no += 1
    names = ["piece", "start", "length", "ids_crc32"]
    out = cut.where(F.col("length") >= size).select("id", *names, F.col("rid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if placed:
        where = placed[0]
        for more in placed[1:]:
            where = where.unionByName(more)
        out = out.unionByName(cut.where(F.col("length") < size).join(where, "rid").select("id", *names, "sequence_id", "offset"))
    return out.withColumnRenamed("id", id_col)


def op12_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
