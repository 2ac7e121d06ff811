"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import stored

#: No document is taken more often than this, and no source beyond this multiple of its size.
MOST = 3
#: Documents of a source that one flight phase moves together.
BLOCK = 2048
#: Documents of a source's last block that are left to the landing, beside the two that its flight may leave.
HELD = 12
EPS = 1e-9
#: Sources whose table, some 100 bytes a row, may be broadcast.
FEW_SOURCES = 100_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """sized(source, size) -> one row per source: source, source_size, target, docs.

    Sources in code-point order, null last, weigh 1, 2, 3, 1, ... and share the total of all sizes by weight. A
    target stops at MOST times its source's size; the excess goes to the others by weight until none is above.
    That is a water level: with sources ordered by MOST * size / weight, the first ones are capped and the rest
    share what is left, so two running sums over the table of sources give it. Only that table, a row per
    source, is ordered in one task.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("w", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    rise = Window.orderBy((MOST * F.col("source_size") / F.col("w")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = per.withColumn("below", F.coalesce(F.sum(MOST * F.col("source_size")).over(rise), F.lit(0))).withColumn("w_below", F.coalesce(F.sum("w").over(rise), F.lit(0)))
    per = per.withColumn("left", F.sum("source_size").over(every) - F.col("below")).withColumn("w_left", F.sum("w").over(every) - F.col("w_below"))
    capped = F.col("left") * F.col("w") >= MOST * F.col("source_size") * F.col("w_left")
    per = per.withColumn("capped", capped)
    first = F.when(~F.col("capped"), F.struct(F.col("below"), (F.col("left") / F.col("w_left")).alias("level")))
    level = F.min(first).over(every)["level"]
    return per.select("source", "source_size", F.when(F.col("capped"), (MOST * F.col("source_size")).cast("double")).otherwise(F.col("w") * level).alias("target"), "docs")


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight phase: move inclusion probabilities inside the null space of the constraints
    sum(p) and sum(p * size) until at most two are fractional. Expectations are kept at every step."""
    p = [float(x) for x in p]
    s = [float(x) for x in size]
    draws = iter(rng.random(2 * len(p) + 8))
    active: list[int] = []
    for i in range(len(p)):
        if p[i] <= EPS or p[i] >= 1 - EPS:
            p[i] = float(round(p[i]))
            continue
        active.append(i)
        if len(active) < 2 or len(active) < 3 and s[active[0]] != s[active[1]]:
            continue
        equal = next(((a, b) for n, a in enumerate(active) for b in active[n + 1 :] if s[a] == s[b]), None)
        if equal:
            at, u = list(equal), [1.0, -1.0]
        else:
            at = active[:3]
            a, b, c = (s[k] for k in at)
            u = [c - b, a - c, b - a]
        up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(at, u) if x)
        down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(at, u) if x)
        step = up if next(draws) * (up + down) < down else -down
        for k, x in zip(at, u):
            p[k] += step * x
            if p[k] <= EPS or p[k] >= 1 - EPS:
                p[k] = float(round(p[k]))
        active = [k for k in active if 0 < p[k] < 1]
    return np.array(p)


def landing(p: np.ndarray, size: np.ndarray, words: float, count: float) -> np.ndarray:
    """Round the few fractional entries: of all ways to do so, the one whose taken words come nearest to `words`,
    then whose count comes nearest to `count`."""
    p = p.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    ways = (np.arange(2 ** len(open_))[:, None] >> np.arange(len(open_))) & 1
    p[open_] = 0
    off = np.abs(ways @ size[open_] + (p * size).sum() - words)
    p[open_] = ways[np.lexsort((np.abs(ways.sum(1) + p.sum() - count), off))[0]]
    return p


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, seed: int = 1) -> DataFrame:
    """One row per input row: id_col, source, size, source_size, target, repeats, taken (= repeats * size).

    Every document of a source is taken floor(target / source_size) times, and once more for a balanced sample
    with the fractional part as inclusion probability. Blocks of about BLOCK documents of a source (by a hash of
    id and size, so a hot source is many blocks) run the flight phase on their own; the two fractional
    documents a block leaves at most are gathered into new blocks, round by round, until a source has one block left, whose
    fractional documents land. Document counts are balanced too, but for the landing.

    Defined cases: null text has size 0; null sources are one source, the last; a source without words has target 0; null
    ids and repeated rows are rows of their own; an empty table gives no rows; other columns are ignored.
    The draws depend on seed, ids and sizes alone, so reruns and other partitionings agree.
    """
    sized = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size")), "sized")
    targets = stored(source_targets(sized), "targets")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(0.0)
    t = targets.withColumns({"rate": rate, "base": F.floor(rate + EPS).cast("long"), "src": F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))})
    t = t.select(F.col("source").alias("s"), "src", F.ceil(F.col("docs") / BLOCK).cast("long").alias("blocks"), "source_size", "target", "base", F.greatest(F.col("rate") - F.col("base"), F.lit(0.0)).alias("p"))
    t = F.broadcast(t) if targets.count() <= FEW_SOURCES else t  # else a hot source is left to adaptive skew handling
    rows = sized.join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("order", F.xxhash64("id", "size", F.lit(seed)))
    settled = rows.where(F.col("p") <= EPS).withColumn("pick", F.lit(0).cast("long"))
    rest = rows.where(F.col("p") > EPS)
    schema = rest.schema

    def fly(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["order", "id", "size"], kind="stable")
        rng = np.random.default_rng([seed, zlib.crc32(str(key[0]).encode()), int(key[1])])
        p, size = part["p"].to_numpy(float), part["size"].to_numpy(float)
        if key[2] == 1:  # the source's last block: a few documents stay out of the flight, for the landing to choose among
            out = p.copy()
            out[:-HELD] = flight(p[:-HELD], size[:-HELD], rng)
            out = landing(out, size, float((p * size).sum()), float(p.sum()))
        else:
            out = flight(p, size, rng)
        return part.assign(p=out)

    done = []
    for round_no in range(12):
        if round_no:  # few rows by now; at first a source's blocks follow from its documents, without a join on a hot source
            blocks = rest.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
            rest = rest.drop("blocks").join(blocks, "src").select(*schema.names)
        dealt = rest.withColumn("block", F.pmod(F.xxhash64("order", F.lit(round_no)), F.col("blocks")))
        flown = dealt.groupBy("src", "block", "blocks").applyInPandas(lambda key, part: fly(key, part).drop(columns="block"), schema)
        flown = stored(flown.select(*schema.names), f"flown{round_no}")
        done.append(flown.where("p in (0.0, 1.0)").withColumn("pick", F.col("p").cast("long")))
        rest = flown.where("p not in (0.0, 1.0)")
        if rest.isEmpty():
            break
    else:
        raise RuntimeError("the flight phases left fractional documents")
    for part in done:
        settled = settled.unionByName(part)
    repeats = F.col("base") + F.col("pick")
    return settled.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"))


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
