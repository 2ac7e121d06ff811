"""Places of rows in the order of their group, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import stored


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with pos (from 0, in `order` within the group, nulls first) and cnt (rows of the group).

    Rows are dealt by ranges of group and order, ranked inside each range, and moved on by what the ranges before it hold of the group; so a
    group of any size is many tasks. The table of (range, group) counts has no more rows than ranges and groups together.
    """
    ranges = stored(rows.repartitionByRange(group, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("__range", group).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__range", F.col(group).alias("__group"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy(group)).alias("cnt"))
    here = Window.partitionBy("__range", group).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    own = ranges.withColumn("__here", F.row_number().over(here))
    out = own.join(counts.withColumnRenamed("__range", "__r"), (F.col("__range") == F.col("__r")) & F.col(group).eqNullSafe(F.col("__group")))
    return out.withColumn("pos", (F.col("__here") - 1 + F.col("__before")).cast("long")).drop("__range", "__r", "__group", "__here", "__before")
