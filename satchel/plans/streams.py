"""Streams over the events table, run to their end; the SQL is the batch twin's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path
from ..streaming import flows
from .registry import QUERIES, SQL


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir).withColumn("at", F.col("ts").cast("timestamp"))


def _to_end(out: DataFrame, keys: list[str]) -> DataFrame:
    """Run a stream over what is there, in update mode; the last value of each key, read from the shared folder."""
    root = new_path(out.sparkSession, "stream")
    q = out.writeStream.outputMode("update").foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{root}/out/part={n}")).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rest = [c for c in out.columns if c not in keys]
    got = out.sparkSession.read.parquet(f"{root}/out")
    return got.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def st3(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where("event_type = 'purchase'")
    return _to_end(flows.stream_daily_counts(e), ["day"])


def st4(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where("event_type = 'purchase'").select(F.concat(F.lit("u"), F.col("user_id")).alias("domain"))
    return _to_end(flows.stream_domain_encounter(e), ["domain"])


def st5(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select(F.col("user_id").alias("job_id"), F.col("event_id").alias("at"), F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"), (F.col("event_id") % 5).alias("attempts"), (F.col("event_id") % 7 == 0).alias("permanent"))
    return _to_end(flows.job_status(e), ["job_id"])


def st5_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a job per user, run to the end of the watermark: the last row that each job has logged."""
    root = new_path(spark, "jobs")
    failed = F.col("event_type") == "error"
    e = _events(spark, sf_dir).select(F.col("user_id").alias("job_id"), F.col("user_id").alias("link_id"), F.lit("scrape").alias("kind"), "at", F.col("event_id").alias("seq"), F.when(failed, "failed").otherwise("done").alias("status"), (F.col("event_id") % 5).alias("attempts"), (F.col("event_id") % 7 == 0).alias("permanent"), F.when(failed, F.concat(F.lit("event "), F.col("event_id"))).alias("error"))
    flows.log_jobs(e, f"{root}/log", f"{root}/state").awaitTermination()
    order = F.struct("at", "seq", (F.col("state") == "due").cast("int"))
    last = spark.read.schema(flows.JOB_ROW).parquet(f"{root}/log").groupBy("job_id").agg(F.max_by(F.struct("state", "run_after", "error"), order).alias("j"))
    return last.select("job_id", "j.*")


QUERIES |= {"st5_job_timers": st5_timers, "st3_stream_daily_counts": st3, "st4_stream_domain_encounter": st4, "st5_stream_job_status": st5}
SQL |= {
    "st5_job_timers": "WITH l AS (SELECT *, event_type = 'error' AS failed, event_type = 'error' AND event_id % 5 < 3 AND event_id % 7 <> 0 AS again, CAST(floor(epoch(ts)) AS BIGINT) + 30 * (event_id % 5) AS ra FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1), m AS (SELECT epoch_ms(max(ts)) - 600000 AS w FROM events) SELECT user_id AS job_id, CASE WHEN NOT failed THEN 'done' WHEN NOT again THEN 'exhausted' WHEN ra * 1000 < w THEN 'due' ELSE 'waiting' END AS state, CASE WHEN again THEN ra END AS run_after, CASE WHEN failed THEN 'event ' || event_id END AS error FROM l, m",
    "st3_stream_daily_counts": "SELECT CAST(ts AS DATE) AS day, count(*) AS count FROM events WHERE event_type = 'purchase' GROUP BY 1",
    "st4_stream_domain_encounter": "SELECT 'u' || user_id AS domain, CASE WHEN count(*) >= 3 THEN count(*) ELSE 0 END AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id",
    "st5_stream_job_status": "WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) SELECT user_id AS job_id, CASE WHEN event_type <> 'error' THEN 'done' WHEN event_id % 5 < 3 AND event_id % 7 <> 0 THEN 'waiting' ELSE 'exhausted' END AS state, CASE WHEN event_type = 'error' AND event_id % 5 < 3 AND event_id % 7 <> 0 THEN event_id + 30 * (event_id % 5) END AS run_after FROM l",
}
