import gzip
import json

import pytest
from pyspark.sql import functions as F

from satchel.sources import files

N = 600
WATCH = "https://www.youtube.com/watch?v="


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def html(n, url):
    odd = ['<DT><A HREF="{}" ADD_DATE="17{:08d}">a &gt; b</A>\n', "<a\nclass='x'\nhref='{}' add_date='17{:08d}'>한글</a>", '<p>{}</p><A NAME="{}">', '<A HREF="javascript:{}{}">x</A>']
    return "<!DOCTYPE x>\n" + "".join(odd[i % 4].format(url.format(i), i) for i in range(n))


def ordered(df, *columns):
    return [tuple(r) for r in df.orderBy("file", "pos").select(*columns).collect()]


def test_bookmarks_over_many_splits(spark, tmp_path, small_splits):
    (tmp_path / "a b.html").write_text(html(N, "https://a.com/?i={}&amp;x=1"))
    (tmp_path / "c.html").write_text(html(50, "https://c.com/{}"))
    with gzip.open(tmp_path / "d.html.gz", "wt") as f:
        f.write(html(300, "https://d.com/{}"))
    (tmp_path / "e.html").write_text("")
    split = files.read_bookmarks(spark, str(tmp_path / "*.html*"))
    whole = files.bookmarks(files.whole_files(spark, str(tmp_path / "*.html*")))
    assert split.rdd.getNumPartitions() > 8
    got = ordered(split, "url", "created_at")
    assert got == ordered(whole, "url", "created_at")
    assert len(got) == N // 2 + 26 + 150
    # each address once, and once more: the first of equal ones is the earliest in its file
    links = spark.createDataFrame([], "id long, url string, title string, description string, body_text string, keywords string, note string, body_source string, status string, created_at long, deleted_at long")
    split.coalesce(1).write.parquet(str(tmp_path / "found"))
    split = spark.read.parquet(str(tmp_path / "found"))
    counts = files.ingest_import(split.unionByName(split.withColumn("file", F.concat(F.lit("z"), "file"))), links, 2_000_000_000)[1]
    assert {r.outcome: r.n for r in counts.collect()} == {"saved": len(got), "duplicate": len(got)}


def history(n):
    rows = []
    for i in range(n):
        rows.append({"header": "YouTube", "title": ["Watched \"x\"", "titleUrl", 'a \\"titleUrl": "' + WATCH + "no", "한글"][i % 4], "titleUrl": WATCH + str(i) if i % 5 else "https://example.com/", "time": "t"})
        if i % 7 == 0:
            del rows[-1]["titleUrl"]
    return rows


def test_history_over_many_splits(spark, tmp_path, small_splits):
    rows = history(N)
    (tmp_path / "h[1].json").write_text(json.dumps(rows).replace("v=", "v\\u003d"))
    (tmp_path / "i.json").write_text(" \n" + json.dumps(rows[:20], indent=2, ensure_ascii=False))
    (tmp_path / "j.csv").write_text("id,url\n" + "".join(f'{i},"{WATCH}{i}",x,https://youtu.be/{i}\n' if i % 3 else "ragged\n" for i in range(N)))
    (tmp_path / "k.html").write_text(html(N, WATCH + "{}"))
    (tmp_path / "l.csv").write_text("")
    split = files.read_takeout(spark, str(tmp_path / "*"))
    whole = files.takeout(files.whole_files(spark, str(tmp_path / "*")))
    assert {k: len(v) for k, v in files.sniff_files(spark, str(tmp_path / "*")).items()} == {"json": 2, "csv": 1, "html": 1}
    got = {}
    for r in split.orderBy("file", "pos").collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append(r.url)
    want = {}
    for r in whole.orderBy("file", "pos").collect():
        want.setdefault(r.file.rsplit("/", 1)[1], []).append(r.url)
    assert {k.replace("%5B", "[").replace("%5D", "]"): v for k, v in got.items()} == {k.replace("%5B", "[").replace("%5D", "]"): v for k, v in want.items()}
    assert len(got) == 4 and split.rdd.getNumPartitions() > 20
    with pytest.raises(ValueError):
        files.read_takeout(spark, str(tmp_path / "*"), "xml")
