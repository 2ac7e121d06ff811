import datetime as dt

import pytest
from pyspark.sql import functions as F

from satchel.operators import archive, merges
from satchel.streaming import flows

NOW = 1706659200
SAVE = "at timestamp, url string, title string, description string, body_text string, keywords string, note string, created_at long"
LINK = "id long, url string, title string, description string, body_text string, keywords string, note string, body_source string, status string, created_at long, deleted_at long"


def key(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_a_batch_is_applied_once(spark, tmp_path, monkeypatch):
    rows = [(dt.datetime(2024, 1, 1), f"https://a.com/{i}", "t", "", "", "", "", 0) for i in range(4)]
    saves = spark.createDataFrame(rows, SAVE)
    saves.write.parquet(str(tmp_path / "in"))
    links = spark.createDataFrame([(1, "https://a.com/1", "old", "", "", "", "", "server", "done", 5, None)], LINK)
    path = str(tmp_path / "archive")
    archive.write_archive(links, path)
    stream = lambda c: flows.stream_saves(spark.readStream.schema(SAVE).parquet(str(tmp_path / "in")), path, str(tmp_path / c), NOW)
    real, calls = archive.write_archive, []

    def dies(new, where, **how):
        real(new.where(F.col("url") != "https://a.com/2"), where)  # a part of it, then the job is lost
        calls.append(1)
        raise RuntimeError("lost")

    monkeypatch.setattr(archive, "write_archive", dies)
    with pytest.raises(Exception):
        stream("c").awaitTermination()
    monkeypatch.setattr(archive, "write_archive", real)
    stream("c").awaitTermination()  # the same batch comes again
    twin = merges.merge_saves(links, saves.drop("at"), NOW).drop("outcome")
    content = lambda df: key(df.select("url", "title", "status", "deleted_at"))
    assert calls and content(spark.read.parquet(path)) == content(twin)
    assert 0 in {r.batch for r in spark.read.parquet(path + "_batches").collect()}
    gone = spark.read.parquet(path).drop("bucket").withColumn("deleted_at", F.when(F.col("url") == "https://a.com/3", F.lit(NOW + 5)).otherwise(F.col("deleted_at")))
    archive.write_archive(spark.createDataFrame(gone.collect(), gone.schema), path)
    before = key(spark.read.parquet(path))
    # the offsets know the batch, the commits don't: it is handed over once more
    for f in [*(tmp_path / "c" / "commits").iterdir(), *(tmp_path / "c" / "offsets").iterdir()]:
        if f.parent.name == "commits" or f.name not in ("0", ".0.crc"):
            f.unlink()
    stream("c").awaitTermination()
    assert key(spark.read.parquet(path)) == before


def test_running_encounters_equal_the_window(spark, tmp_path):
    at = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)
    rows = [(i, [None, "a.com", "b.com", "a.com"][i % 4], at(i)) for i in range(40)]
    schema = "id long, domain string, at timestamp"
    for k in range(4):  # four files, a batch each
        spark.createDataFrame(rows[10 * k : 10 * k + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = flows.running_encounters(stream(), 3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    want = flows.running_encounters(spark.createDataFrame(rows, schema), 3)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert key(got) == key(want) and got.count() == 40
    flows.log_encounters(stream(), str(tmp_path / "log"), str(tmp_path / "c2")).awaitTermination()
    assert key(spark.read.parquet(str(tmp_path / "log"))) == key(want.where("shown").drop("shown"))
