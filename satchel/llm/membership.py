"""A bitmap of fixed size that tells which rows can't be in a set of keys, to spare them a shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2 MB at any number of keys; with too many keys it lets more rows through, never fewer.
BITS = 1 << 24
BUCKET = 32768


def maybe_in(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows of df whose key may be one of `keys` (one long column); those left out surely are not."""
    slot = F.pmod(F.xxhash64(F.col(keys.columns[0])), F.lit(BITS))
    bits = keys.select(F.floor(slot / BUCKET).alias("__bucket"), (slot % BUCKET).alias("__bit")).groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    own = F.pmod(F.xxhash64(key), F.lit(BITS))
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(F.col("__own") % BUCKET / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    joined = df.withColumn("__own", own).withColumn("__bucket", F.floor(F.col("__own") / BUCKET)).join(F.broadcast(bits), "__bucket")
    return joined.withColumn("__byte", byte).where(F.expr("shiftright(__byte, cast(__own % 8 as int)) % 2 = 1")).drop("__own", "__bucket", "__bits", "__byte")


#: Bits of a bitmap that Python tasks read: 8 MB.
KEY_BITS = 1 << 26


def bitmap(keys: DataFrame):
    """A broadcast of KEY_BITS bits, set for `keys` (one long column of hashes). Its size is fixed; with too many keys it tells less, never anything false."""
    slot = F.col(keys.columns[0]).bitwiseAND(F.lit(KEY_BITS - 1))
    got = keys.select(F.floor(slot / BUCKET).alias("bucket"), (slot % BUCKET).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = bytearray(KEY_BITS // 8)
    for r in got.toLocalIterator():  # KEY_BITS / BUCKET rows of 4 KB at most
        out[r.bucket * BUCKET // 8 : (r.bucket + 1) * BUCKET // 8] = r.bits
    return keys.sparkSession.sparkContext.broadcast(bytes(out))


def in_bitmap(bits: bytes, keys: np.ndarray) -> np.ndarray:
    """Which unsigned 64-bit keys may be in a bitmap."""
    slot = (keys & np.uint64(KEY_BITS - 1)).astype(np.int64)
    return (np.frombuffer(bits, np.uint8)[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
