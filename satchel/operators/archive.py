"""An archive of links on storage, in folders by a hash of the URL: merges read and rewrite the folders that a change touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import url_hash
from ..storage import dropped, log_rows, stored

#: Folders of an archive where nothing else is asked for. Their number is fixed when the archive is first written.
BUCKETS = 64
_LAYOUT = "buckets int"


def bucket_of(url: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(url_hash(url)), F.lit(buckets)).cast("int")


def buckets_of(spark: SparkSession, path: str) -> int:
    """How many folders the archive at path was laid out in."""
    rows = log_rows(spark, f"{path.rstrip('/')}_layout", _LAYOUT)
    return rows[0].buckets if rows else BUCKETS


def write_archive(links: DataFrame, path: str, *, buckets: int | None = None, tasks: int = 1) -> None:
    """Links in folders by bucket; a folder that links has rows of is written anew as a whole, the others stay. buckets counts when the archive is new; a folder is written
    by `tasks` tasks, a file each, so that one of many gigabytes isn't one task's."""
    spark, layout = links.sparkSession, f"{path.rstrip('/')}_layout"
    had = log_rows(spark, layout, _LAYOUT)
    n = had[0].buckets if had else buckets or BUCKETS
    if buckets and buckets != n:
        raise ValueError(f"the archive has {n} folders, not {buckets}")
    if not had:
        spark.createDataFrame([(n,)], _LAYOUT).coalesce(1).write.mode("overwrite").parquet(layout)
    dealt = links.drop("bucket").withColumn("bucket", bucket_of(F.col("url"), n)).repartition("bucket", F.pmod(F.xxhash64("url", F.lit("file")), F.lit(tasks)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_archive(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """The links at path; given folders, these alone are listed and read."""
    df = spark.read.parquet(path)
    return (df if buckets is None else df.where(F.col("bucket").isin(buckets))).drop("bucket")


def touched_buckets(spark: SparkSession, path: str, change: DataFrame, on: str) -> list[int]:
    """The folders that change's keys fall in, as many as the archive has at most. By URL that is arithmetic; by id, the archive's column of ids is read, and nothing else of it."""
    if on == "url":
        found = change.select(bucket_of(F.col("url"), buckets_of(spark, path)).alias("bucket"))
    else:
        found = spark.read.parquet(path).select("id", "bucket").join(change.select(F.col(on).alias("id")), "id", "left_semi").select("bucket")
    return sorted(r.bucket for r in found.distinct().collect())


def merge_into(path: str, change: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], *, on: str = "id", tasks: int = 1) -> list[int]:
    """Applies merge(links, change), any of the keyed merges of links, to the archive at path; the folders that were rewritten.

    on names change's key: url, or the column that holds the link's id. The change is written first, so its size is known and a small one meets the links by broadcast, without
    a shuffle of the archive (a full outer join, as merge_saves is, shuffles the touched folders). The new rows are written to a table of their own before any folder is
    replaced. A merge that dies between two folders can be given again: the merges here change nothing where they have been applied (record_recognition and the like,
    which add rows, aren't merges of links). The merge keeps the archive's columns. A change without rows, or whose keys the archive lacks (on="id"), touches nothing. Rows with a null key are no one's.
    """
    spark = change.sparkSession
    given = stored(change.where(F.col(on).isNotNull()), "change")
    touched = touched_buckets(spark, path, given, on)
    if touched:
        old = read_archive(spark, path, touched)
        new = merge(old, given)
        if odd := set(new.columns) ^ set(old.columns):
            raise ValueError(f"folders would differ in {sorted(odd)}")
        new = stored(new.select(*old.columns), "merged")
        write_archive(new, path, tasks=tasks)
        dropped(new)
    dropped(given)
    return touched
