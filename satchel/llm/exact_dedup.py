"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored

#: Bits of the filter that tells which rows may have an equal: 2 MB at most when broadcast, at any input size.
FILTER_BITS = 1 << 24
BUCKET = 32768


def normalised(text: Column) -> Column:
    """Null is empty; every run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _slot(key: Column) -> Column:
    return F.pmod(key, F.lit(FILTER_BITS))


def _may_have_equal(keyed: DataFrame) -> DataFrame:
    """(bucket, bits): a bitmap with a bit for every (length, prefix hash) that at least two rows share.

    At most FILTER_BITS / BUCKET = 512 rows of 4 KB. A foreign key that falls on a set bit only costs a full hash.
    """
    shared = keyed.groupBy("__len").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__len")
    by_prefix = keyed.groupBy("__len", "__prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    slot = _slot(F.xxhash64("__len", "__prefix"))
    return by_prefix.join(shared, "__len", "left_semi").groupBy(F.floor(slot / BUCKET).alias("__bucket")).agg(F.bitmap_construct_agg((slot % BUCKET)).alias("__bits"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prefix: int = 64, hash_all: bool = False) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, length (of the normalised text, in code points), full_hash.

    Texts are read once for lengths and prefix hashes, which are stored, and once more for the full hashes of those that are left (with hash_all, all at once).

    Refinement: rows are counted by length; of rows whose length is shared, by a hash of the first `prefix`
    characters; only rows that still may have an equal get a full SHA-256, and are grouped by it. Texts never
    move between executors: only lengths and hashes do, and counts are summed on the map side first. A group that
    holds most of the rows is one row in the grouped table; the join back is dealt anew when skewed.

    hash_all: give the full hash of single rows too (else it is null for rows that an earlier level has cleared).
    Defined cases: null text counts as empty; equal texts keep the smallest id, a null id only if no other is there;
    a repeated id stays once per row, each row is marked kept if its id is the kept one; an empty table gives no rows.
    Other columns of docs, whatever their names, are ignored; a very long text is hashed whole, in the task that reads it.
    """
    norm = normalised(F.col(text_col))
    base = docs.select(F.col(id_col).alias("__id"), norm.alias("__text")).select("__id", "__text", F.length("__text").alias("__len"), F.xxhash64(F.substring("__text", 1, prefix)).alias("__prefix"))
    whole = F.sha2("__text", 256)
    keyed = stored(base.select("__id", "__len", "__prefix", *([whole.alias("__hash")] if hash_all else [])), "keys")
    bits = F.broadcast(_may_have_equal(keyed.select("__len", "__prefix")))
    slot = _slot(F.xxhash64("__len", "__prefix"))
    at = slot % BUCKET
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.expr("shiftright(__byte, __at % 8) % 2 = 1"), F.lit(False))
    marked = (keyed if hash_all else base).withColumn("__bucket", F.floor(slot / BUCKET)).join(bits, "__bucket", "left").withColumn("__byte", byte).withColumn("__at", at.cast("int")).withColumn("__maybe", maybe)
    hashed = marked.select("__id", "__len", "__prefix", "__maybe", "__hash" if hash_all else F.when(F.col("__maybe"), whole).alias("__hash"))
    hashed = hashed if hash_all else stored(hashed, "hashes")
    groups = hashed.where("__maybe").groupBy("__len", "__prefix", "__hash").agg(F.min("__id").alias("__keep"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    joined = hashed.join(groups, ["__len", "__prefix", "__hash"], "left")
    n = F.coalesce("__n", F.lit(1)).cast("long")
    keep = F.when(n > 1, F.col("__keep")).otherwise(F.col("__id"))
    return joined.select(
        F.col("__id").alias(id_col),
        keep.alias("keep_id"),
        n.alias("group_size"),
        keep.eqNullSafe(F.col("__id")).alias("kept"),
        F.col("__len").alias("length"),
        F.col("__hash").alias("full_hash"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows whose text equals that of a row with a smaller id; rows with equal id and text stay as they are.

    Null and empty texts are equal; a null id goes if any other is there; columns of any name are kept; an empty table stays empty; very long texts are
    hashed whole, where they are read.
    """
    gone = exact_groups(docs, id_col, text_col).where("not kept").select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__gone"]), "left_anti")


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs, hash_all=True).select("doc_id", "keep_id", "group_size", "kept", F.col("full_hash").alias("text_sha256"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
