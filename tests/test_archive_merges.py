import os

import pytest
from pyspark.sql import functions as F

from satchel.operators import archive, merges

NOW = 1706659200
LINK = "id long, url string, title string, description string, body_text string, keywords string, note string, body_source string, status string, created_at long, deleted_at long, opened_at long, summary string, error string"


def links(spark, n=400):
    return spark.createDataFrame([(i, f"https://a.com/{i}", f"t{i}", "", "b", "", "", "client" if i % 5 == 0 else "server", "failed" if i % 7 == 0 else "done", 5, NOW if i % 11 == 0 else None, None, "s", None) for i in range(n)], LINK)


def key(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def files(path):
    return {f"{d}/{f}" for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


MERGES = {
    "extractions": (lambda a, x: merges.merge_extractions(a, x), lambda d: d.selectExpr("id", "'new' AS title", "'d' AS description", "'' AS body_text", "'k' AS keywords")),
    "deletions": (lambda a, x: merges.soft_delete(a, x, NOW), lambda d: d.select("id")),
    "opened": (lambda a, x: merges.mark_opened(a, x), lambda d: d.selectExpr("id", "7L AS at")),
    "summaries": (lambda a, x: merges.set_summaries(a, x), lambda d: d.selectExpr("id", "'' AS summary")),
    "failures": (lambda a, x: merges.settle_failures(a, x.withColumn("link_id", F.col("id"))), lambda d: d.selectExpr("id", "'scrape' AS kind", "'failed' AS status", "'cause' AS error")),
}


@pytest.mark.parametrize("name", MERGES)
def test_a_merge_rewrites_the_touched_folders_alone(spark, tmp_path, name):
    merge, of = MERGES[name]
    path = str(tmp_path / "archive")
    archive.write_archive(links(spark), path, buckets=32)
    before = files(path)
    change = of(spark.createDataFrame([(3,), (22,), (35,), (999_999,), (None,)], "id long"))
    touched = archive.merge_into(path, change, merge)
    assert key(archive.read_archive(spark, path)) == key(merge(links(spark), change.where("id IS NOT NULL")))
    gone = {f.split("bucket=")[1].split("/")[0] for f in before - files(path)}
    assert gone == set(map(str, touched)) and 1 <= len(touched) <= 3
    again = archive.merge_into(path, change, merge)  # as after a loss
    assert again == touched and key(archive.read_archive(spark, path)) == key(merge(links(spark), change.where("id IS NOT NULL")))


def test_a_small_change_meets_the_archive_without_a_shuffle_of_it(spark, tmp_path):
    path = str(tmp_path / "archive")
    archive.write_archive(links(spark), path, buckets=8)
    plans = []

    def merge(a, x):
        out = merges.merge_extractions(a, x)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    change = spark.createDataFrame([(3, "n", "d", "", "")], "id long, title string, description string, body_text string, keywords string")
    assert len(archive.merge_into(path, change, merge)) == 1
    assert "BroadcastHashJoin" in plans[0] and "Exchange hashpartitioning" not in plans[0]


def test_saves_by_url_and_the_layout(spark, tmp_path):
    path = str(tmp_path / "archive")
    archive.write_archive(links(spark), path, buckets=16, tasks=2)
    saves = spark.createDataFrame([(u, "n", "", "", "", "", 0) for u in ("https://a.com/5", "https://new.com/", "https://a.com/11")], "url string, title string, description string, body_text string, keywords string, note string, created_at long")
    merge = lambda a, x: merges.merge_saves(a, x, NOW).drop("outcome")
    touched = archive.merge_into(path, saves, merge, on="url")
    assert 1 <= len(touched) <= 3 and key(archive.read_archive(spark, path)) == key(merge(links(spark), saves))
    assert archive.buckets_of(spark, path) == 16
    with pytest.raises(ValueError):
        archive.write_archive(links(spark), path, buckets=8)
    with pytest.raises(ValueError):
        archive.merge_into(path, saves, lambda a, x: merges.merge_saves(a, x, NOW), on="url")  # a column more
    assert archive.merge_into(path, saves.limit(0), merge, on="url") == []
