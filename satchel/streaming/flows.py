"""Streams of saves, events and jobs; each ends in the table that its batch twin gives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.urls import url_hash
from ..operators.archive import merge_into
from ..operators.merges import merge_saves, settle_failures
from ..operators.tagging import tag_corpus
from ..storage import log_rows

def stream_saves(saves: DataFrame, path: str, checkpoint: str, now: int, watermark: str = "1 day") -> StreamingQuery:
    """saves(at timestamp, url, ...) merged batch by batch into the archive at path (write_archive). A batch reads and rewrites the folders its URLs
    fall in, by way of a table of its own.

    A ledger beside the archive names the batches of each checkpoint that are in it, a row once all folders of a batch are written. A batch that comes again after that is
    passed over, so what has been deleted since stays deleted; one that died half way is merged again, which changes nothing where it had got to."""
    once = saves.withColumn("h", url_hash(F.col("url"))).withWatermark("at", watermark).dropDuplicatesWithinWatermark(["h"]).drop("h", "at")

    ledger, kinds = f"{path.rstrip('/')}_batches", "stream string, batch long"

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if any((r.stream, r.batch) == (checkpoint, number) for r in log_rows(spark, ledger, kinds)):
            batch.write.format("noop").mode("overwrite").save()  # its state has to be written all the same
            return
        merge_into(path, batch, lambda old, new: merge_saves(old, new, now).drop("outcome"), on="url")
        spark.createDataFrame([(checkpoint, number)], kinds).coalesce(1).write.mode("append").parquet(ledger)

    return once.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_tagging(links: DataFrame, surfaces: DataFrame, domain_map: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Two aggregations and a window a batch, so it runs in foreachBatch; a batch overwrites its own folder."""
    return links.writeStream.foreachBatch(lambda df, n: tag_corpus(df, surfaces, domain_map).write.mode("overwrite").parquet(f"{path}/batch={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_daily_counts(events: DataFrame, at: str = "at", watermark: str = "2 days") -> DataFrame:
    """day, count, in update mode; the spine of empty days is filled in at read time."""
    w = events.withWatermark(at, watermark).groupBy(F.window(at, "1 day")).agg(F.count(F.lit(1)).alias("count"))
    return w.select(F.to_date("window.start").alias("day"), "count")


def stream_domain_encounter(saves: DataFrame, least: int = 3) -> DataFrame:
    per = saves.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    return per.select("domain", F.when(F.col("n") >= least, F.col("n")).otherwise(0).alias("n"))


def running_encounters(saves: DataFrame, least: int = 3) -> DataFrame:
    """saves(id, domain, at) -> id, domain, at, n, shown: at each save, how many of its domain there have been, and whether that is worth saying (n >= least).

    On a stream (append mode) a count per domain is the state, and each save gives one row, in order of time within a batch. On a table it is the window that this must equal. A null
    domain is a domain.
    """
    if not saves.isStreaming:
        from pyspark.sql.window import Window

        n = F.count(F.lit(1)).over(Window.partitionBy("domain").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0))
        return saves.select("id", "domain", "at", n.alias("n")).withColumn("shown", F.col("n") >= least)

    def count(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values(["at", "id"])  # a domain's saves of one batch
        rows["n"] = range(before + 1, before + len(rows) + 1)
        rows["shown"] = rows["n"] >= least
        state.update((before + len(rows),))
        yield rows[["id", "domain", "at", "n", "shown"]]

    kinds = "id long, domain string, at timestamp, n long, shown boolean"
    return saves.select("id", "domain", "at").groupBy("domain").applyInPandasWithState(count, kinds, "n long", "append", GroupStateTimeout.NoTimeout)


def log_encounters(saves: DataFrame, path: str, checkpoint: str, least: int = 3) -> StreamingQuery:
    """The saves at which a domain's count is worth saying, logged as they come: exactly once, by the file sink's own log."""
    shown = running_encounters(saves, least).where("shown").drop("shown")
    return shown.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def job_state(last: DataFrame, most: int = 3) -> DataFrame:
    """job_id, state, run_after of last(job_id, e: struct<at, status, attempts, permanent>)."""
    e = lambda n: F.col(f"e.{n}")
    again = (e("status") == "failed") & (e("attempts") < most) & ~e("permanent")
    return last.select("job_id", F.when(again, "waiting").when(e("status") == "failed", "exhausted").otherwise(e("status")).alias("state"), F.when(again, e("at") + 30 * e("attempts")).alias("run_after"))


def job_status(events: DataFrame, most: int = 3) -> DataFrame:
    """Works on batch and stream alike (update mode): the last event of a job decides."""
    e = F.struct("at", "status", "attempts", "permanent")
    return job_state(events.groupBy("job_id").agg(F.max(e).alias("e")), most)


#: What job_timers says of a job: state is waiting (again at run_after), due (run_after has passed), exhausted, or the event's own status.
JOB_ROW = "job_id long, link_id long, kind string, at timestamp, seq long, state string, attempts long, run_after long, error string"


def _job_row(most: int) -> list:
    again = (F.col("status") == "failed") & (F.col("attempts") < most) & ~F.col("permanent")
    state = F.when(again, "waiting").when(F.col("status") == "failed", "exhausted").otherwise(F.col("status"))
    return ["job_id", "link_id", "kind", "at", "seq", state.alias("state"), "attempts", F.when(again, F.unix_seconds("at") + 30 * F.col("attempts")).alias("run_after"), "error"]


#: Groups of job_timers' state. Python is called once a group and batch, not once a job.
BUCKETS = 4096


def job_timers(events: DataFrame, most: int = 3, watermark: str = "10 minutes", now: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """events(job_id, link_id, kind, at timestamp, seq, status, attempts, permanent, error) -> JOB_ROW: where each job stands; the last event, by at and then seq, decides.

    On a stream (append mode) a job gives a row when a batch brings a newer event, and one more, due, once the watermark has passed its run_after. State ends: a waiting job's with its
    timer, any other's when the watermark has passed its last event, since what could come before that is late and dropped. On a table each job gives one row, as of now (in seconds;
    None: no timer has run out). Jobs are kept in buckets by a hash of job_id, a row of arrays each, worked on as columns; a bucket's events are taken part by part, so a job with very many needs
    no memory. A batch rewrites the buckets that it touches: more live jobs want more buckets, whose number a checkpoint fixes. Events without job_id or at are left out.
    """
    rows = events.where(F.col("job_id").isNotNull() & F.col("at").isNotNull())
    if not events.isStreaming:
        last = rows.groupBy("job_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "job_id"]), F.struct("at", "seq")).alias("e")).select("job_id", "e.*")
        row = last.select(*_job_row(most))
        return row if now is None else row.withColumn("state", F.when((F.col("state") == "waiting") & (F.col("run_after") < now), "due").otherwise(F.col("state")))
    numbers = ["job_id", "us", "seq", "until"]
    words = ["link_id", "kind", "state", "attempts", "run_after", "error"]  # those that may be null travel as text: pandas would make fractions of numbers

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        kept = state.get if state.exists else [[]] * len(numbers + words)
        best = pd.DataFrame({c: pd.Series(list(v), dtype="int64" if c in numbers else object) for c, v in zip(numbers + words, kept, strict=True)}).assign(new=False, met=False)
        for part in parts:
            part = part[numbers + words].sort_values(["us", "seq"], ascending=False).drop_duplicates("job_id").assign(new=True, met=True)
            best["met"] |= best["job_id"].isin(part["job_id"])
            best = pd.concat([best, part], ignore_index=True).sort_values(["us", "seq"], ascending=False).drop_duplicates("job_id")  # stable: of equals, what was there stays
        best.loc[best["met"], "until"] = best.loc[best["met"], "until"].clip(lower=now + 1)
        over = ~best["met"] & (best["until"] < now)
        left = best[~over]
        if len(left):
            columns = [left[c].tolist() if c in numbers else [None if pd.isna(v) else v for v in left[c]] for c in numbers + words]
            state.update(tuple(columns))
            state.setTimeoutTimestamp(max(int(left["until"].min()), 1))
        elif state.exists:
            state.remove()
        due = best[over & (best["state"] == "waiting")].assign(state="due")
        if len(out := pd.concat([best[best["new"]], due])):
            yield out[numbers[:3] + words]

    over = F.when(F.col("state") == "waiting", F.col("run_after") * 1000).otherwise(F.unix_millis("at"))
    flat = rows.withWatermark("at", watermark).select(*_job_row(most)).withColumns({"us": F.unix_micros("at"), "seq": F.coalesce("seq", F.lit(0)), "until": over})
    flat = flat.select(F.pmod(F.xxhash64("job_id"), F.lit(buckets)).alias("bucket"), "at", *numbers, *[F.col(c).cast("string").alias(c) for c in words])
    kinds = lambda of: ", ".join([f"{c} {of('long')}" for c in numbers] + [f"{c} {of('string')}" for c in words])
    out = flat.groupBy("bucket").applyInPandasWithState(step, kinds(str).replace("until long, ", ""), kinds("array<{}>".format), "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("at", F.timestamp_micros("us")).select(*[F.col(c).cast(t).alias(c) for c, t in (f.split(" ") for f in JOB_ROW.split(", "))])


def log_jobs(events: DataFrame, path: str, checkpoint: str, most: int = 3, watermark: str = "10 minutes") -> StreamingQuery:
    """job_timers' rows, logged as they come: exactly once, by the file sink's own log."""
    return job_timers(events, most, watermark).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def logged_jobs(log: DataFrame) -> DataFrame:
    """log_jobs' rows -> jobs(id, link_id, kind, status, attempts, run_after, error) as retry_state, settle_failures, retry_failed and job_summary read them: a waiting or due job is
    pending, an exhausted one failed."""
    order = F.struct("at", "seq", (F.col("state") == "due").cast("int"))
    last = log.groupBy("job_id").agg(F.max_by(F.struct("link_id", "kind", "state", "attempts", "run_after", "error"), order).alias("j")).select(F.col("job_id").alias("id"), "j.*")
    status = F.when(F.col("state").isin("waiting", "due"), "pending").when(F.col("state") == "exhausted", "failed").otherwise(F.col("state"))
    return last.select("id", "link_id", "kind", status.alias("status"), "attempts", "run_after", "error")


def stream_settlements(events: DataFrame, path: str, checkpoint: str, most: int = 3, watermark: str = "10 minutes") -> StreamingQuery:
    """Final failures reach the archive at path as they come: settle_failures on the folders of the failed jobs' links. The
    archive has a column error for the cause. A batch that comes again changes nothing."""

    def settle(batch: DataFrame, number: int) -> None:
        jobs = logged_jobs(batch).where("status = 'failed' AND kind NOT IN ('tag', 'thumb')")
        merge_into(path, jobs, settle_failures, on="link_id")

    return job_timers(events, most, watermark).writeStream.foreachBatch(settle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
