import datetime as dt

from pyspark.sql import functions as F

from satchel.operators import activity, archive, merges
from satchel.streaming import flows

EVENT = "job_id long, link_id long, kind string, at timestamp, seq long, status string, attempts long, permanent boolean, error string"
T0 = dt.datetime(2024, 1, 1)


def event(job, second, status, attempts=1, *, permanent=False, kind="scrape", seq=0, error=None):
    return (job, None if job is None else job + 100, kind, T0 + dt.timedelta(seconds=second), seq, status, attempts, permanent, error)


BATCHES = [
    [event(1, 0, "running"), event(1, 5, "failed", error="a"), event(2, 1, "done"), event(3, 2, "failed", 3, error="gone"), event(4, 3, "failed", permanent=True, error="blocked"), event(5, 4, "failed", 2, kind="tag"), event(None, 1, "done")],
    [event(2, 0, "running"), event(1, 5, "done", seq=1), event(6, 40, "failed", error="slow"), event(5, 70, "failed", 3, kind="tag")],  # job 2's event is older than its last
    [event(7, 5000, "running"), event(8, 5000, None, None, kind=None)],
    [event(2, 1, "failed"), event(9, 9000, "done")],  # the first is late and dropped
]


def write(spark, path):
    for i, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(path)
    return lambda: spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(path)


def state_rows(query):
    return [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]


def test_timers_equal_the_batch_twin_and_state_ends(spark, tmp_path):
    stream = write(spark, str(tmp_path / "in"))
    q = flows.log_jobs(stream(), str(tmp_path / "log"), str(tmp_path / "c"))
    q.awaitTermination()
    log = spark.read.parquet(str(tmp_path / "log"))
    now = int((T0.replace(tzinfo=dt.timezone.utc) + dt.timedelta(seconds=9000 - 600)).timestamp())  # where the watermark ends
    rows = [r for b in BATCHES[:3] for r in b] + BATCHES[3][1:]
    twin = flows.job_timers(spark.createDataFrame(rows, EVENT), now=now)
    order = F.struct("at", "seq", (F.col("state") == "due").cast("int"))
    last = log.groupBy("job_id").agg(F.max_by("state", order).alias("state"), F.max("run_after").alias("run_after"))
    assert {(r.job_id, r.state) for r in last.collect()} == {(r.job_id, r.state) for r in twin.collect()}
    assert {r.job_id: r.state for r in twin.collect()} == {1: "done", 2: "done", 3: "exhausted", 4: "exhausted", 5: "exhausted", 6: "due", 7: "running", 8: None, 9: "done"}
    assert [(r.state, r.run_after) for r in log.where("job_id = 6").orderBy("state").collect()] == [("due", now - 8400 + 40 + 30), ("waiting", now - 8400 + 40 + 30)]
    assert [r.at for r in log.where("job_id = 9").collect()] == [T0 + dt.timedelta(seconds=9000)]
    states = state_rows(q)
    assert max(states) >= 6 and states[-1] <= 1  # only the last event's job is kept


def test_a_resumed_stream_goes_on_from_its_state(spark, tmp_path):
    path = str(tmp_path / "in")
    for rows in BATCHES:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(path)
        flows.log_jobs(spark.readStream.schema(EVENT).parquet(path), str(tmp_path / "log"), str(tmp_path / "c")).awaitTermination()
    whole = write(spark, str(tmp_path / "in2"))
    flows.log_jobs(whole(), str(tmp_path / "log2"), str(tmp_path / "c2")).awaitTermination()
    rows = lambda p: sorted(map(str, spark.read.parquet(str(tmp_path / p)).collect()))
    assert rows("log") == rows("log2")


def test_the_log_feeds_retry_states_and_settlements(spark, tmp_path):
    stream = write(spark, str(tmp_path / "in"))
    flows.log_jobs(stream(), str(tmp_path / "log"), str(tmp_path / "c")).awaitTermination()
    jobs = flows.logged_jobs(spark.read.parquet(str(tmp_path / "log")))
    assert {(r.id, r.status) for r in jobs.where("id IN (1, 3, 5, 6)").collect()} == {(1, "done"), (3, "failed"), (5, "failed"), (6, "pending")}
    kinds = "id long, url string, status string, body_source string, deleted_at long, error string"
    links = spark.createDataFrame([(100 + i, f"https://a.com/{i}", "pending", "client" if i == 4 else "server", None, None) for i in range(1, 10)], kinds)
    now = int(T0.replace(tzinfo=dt.timezone.utc).timestamp()) + 60
    assert {r.id for r in activity.retry_state(links, jobs, now).where("retry = 'waiting'").collect()} == {106}
    path = str(tmp_path / "archive")
    archive.write_archive(links, path)
    flows.stream_settlements(stream(), path, str(tmp_path / "c2")).awaitTermination()
    got = {r.id: (r.status, r.error) for r in archive.read_archive(spark, path).collect()}
    want = {r.id: (r.status, r.error) for r in merges.settle_failures(links, jobs).collect()}
    assert got == want and got[103] == ("failed", "gone") and got[104] == ("done", "blocked") and got[105] == ("pending", None)


def test_jobs_share_rows_of_state(spark, tmp_path):
    """Python is called once a bucket, not once a job; large ids stay whole beside null ones."""
    link = 2**53 + 1
    first = [(i, None if i % 3 == 0 else link + i, "scrape", T0 + dt.timedelta(seconds=i), 0, "failed" if i % 2 else "done", None if i % 5 == 0 else 1, False, None) for i in range(200)]
    then = [(i, link + i, "scrape", T0 + dt.timedelta(seconds=i + 5000), 1, "done", 1, False, "x") for i in range(0, 200, 4)]
    for rows in (first, then):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = flows.job_timers(stream, buckets=8).writeStream.format("parquet").option("path", str(tmp_path / "log")).option("checkpointLocation", str(tmp_path / "c"))
    q = out.outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert 0 < max(state_rows(q)) <= 8
    order = F.struct("at", "seq", (F.col("state") == "due").cast("int"))
    log = spark.read.schema(flows.JOB_ROW).parquet(str(tmp_path / "log"))
    last = log.groupBy("job_id").agg(F.max_by(F.struct("link_id", "kind", "at", "seq", "state", "attempts", "run_after", "error"), order).alias("e")).select("job_id", "e.*")
    end = int(T0.replace(tzinfo=dt.timezone.utc).timestamp()) + 5196 - 600
    twin = flows.job_timers(spark.createDataFrame(first + then, EVENT), now=end)
    assert sorted(map(str, last.collect())) == sorted(map(str, twin.collect()))
    assert log.where("state = 'due'").count() == last.where("state = 'due'").count() > 50
