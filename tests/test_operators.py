import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from satchel.operators import activity, archive, evaluation, merges, pages, search, summaries, tagging
from satchel.sources import files
from satchel.streaming import flows

NOW = 1706659200
LINK = "id long, url string, domain string, title string, description string, keywords string, note string, body_text string, body_source string, status string, created_at long, opened_at long, deleted_at long"


def link(id_, title="", body="", domain="a.com", keywords="", source="server", status="done", created=NOW, deleted=None):
    return (id_, f"https://{domain}/{id_}", domain, title, "", keywords, "", body, source, status, created, None, deleted)


def surfaces(spark):
    return spark.createDataFrame([(1, "golang", "golang"), (1, "golang", "go"), (2, "kubernetes", "쿠버네티스"), (2, "kubernetes", "쿠버"), (3, "ml", "machine learning")], "tag_id int, tag string, surface string")


def domain_map(spark):
    return spark.createDataFrame([("go.dev", "golang")], "host string, tag string")


def test_tagging(spark):
    links = spark.createDataFrame([link(1, "Go 제네릭", "go"), link(2, "쿠버네티스를 쓰는 법"), link(3, "On machine learning", domain="www.go.dev"), link(4, "machine x learning")], LINK)
    got = {(r.link_id, r.tag): (r.score, r.uncapped) for r in tagging.tag_corpus(links, surfaces(spark), domain_map(spark)).collect()}
    assert got[1, "golang"] == (3.0, 3.0)
    assert got[2, "kubernetes"] == (4.0, 4.0)  # two aliases of one tag count twice
    assert got[3, "ml"] == (2.0, 2.0) and got[3, "golang"] == (3.0, 0.0)
    assert not any(k[0] == 4 for k in got)


def test_body_gate(spark):
    links = spark.createDataFrame([link(1, "x", "go " + "word " * 500), link(2, "x", "go go " + "word " * 500)], LINK)
    assert [r.link_id for r in tagging.tag_corpus(links, surfaces(spark), domain_map(spark)).collect()] == [2]


@pytest.mark.parametrize("counts,streak,capped", [([0] * 28 + [1, 0], 1, False), ([1] * 30, 30, True), ([1] * 29 + [0], 29, False), ([0, 0] + [1] * 28, 28, False), ([0] * 30, 0, False)])
def test_streak(spark, counts, streak, capped):
    rows = [(1, dt.date(2024, 1, 1) + dt.timedelta(days=i), c) for i, c in enumerate(counts)]
    r = activity.streaks(spark.createDataFrame(rows, "user int, day date, count long"), "user").first()
    assert (r.streak, r.capped) == (streak, capped)


def test_daily_series_keeps_zeros(spark):
    rows = spark.createDataFrame([(NOW,), (NOW,), (NOW - 6 * 86400,), (NOW - 40 * 86400,)], "saved_at long")
    got = [r["count"] for r in activity.daily_series(rows, F.col("saved_at"), NOW).orderBy("day").collect()]
    assert len(got) == 30 and got[-1] == 2 and got[-7] == 1 and sum(got) == 3


def test_merge_saves_twice_is_once(spark):
    links = spark.createDataFrame([link(1, "t"), link(2, "t", source="client"), link(3, "t", deleted=5, status="failed")], LINK).drop("domain", "opened_at")
    s = spark.createDataFrame([(f"https://a.com/{i}", "n", "", "b", "", "w", 0) for i in (1, 2, 3, 4)], "url string, title string, description string, body_text string, keywords string, note string, created_at long")
    first = merges.merge_saves(links, s, NOW)
    assert {r.url[-1]: r.outcome for r in first.collect()} == {"1": "filled", "2": "duplicate", "3": "revived", "4": "saved"}
    assert all(r.outcome == "duplicate" for r in merges.merge_saves(first.drop("outcome"), s, NOW).collect())


def test_imports(spark, tmp_path):
    (tmp_path / "b.html").write_text('<DT><A HREF="https://a.com/?x=1&amp;y=2" ADD_DATE="1700000000">A</A>\n<DT><A HREF="javascript:x">B</A><A HREF="https://a.com/?x=1&amp;y=2">C</A>')
    (tmp_path / "t.json").write_text('[{"titleUrl": "https://www.youtube.com/watch?v=1"}, {"titleUrl": "https://example.com"}]')
    (tmp_path / "t.csv").write_text("id,url\n1,https://youtu.be/zz\n2\n")
    found = files.bookmarks(files.whole_files(spark, str(tmp_path / "b.html")))
    assert [(r.url, r.created_at) for r in found.orderBy("pos").collect()] == [("https://a.com/?x=1&y=2", 1700000000), ("https://a.com/?x=1&y=2", 0)]
    links = spark.createDataFrame([], LINK).drop("domain", "opened_at")
    assert {r.outcome: r.n for r in files.ingest_import(found, links, NOW)[1].collect()} == {"saved": 1, "duplicate": 1}
    watch = files.takeout(files.whole_files(spark, str(tmp_path / "t.*")))
    assert sorted(r.url for r in watch.collect()) == ["https://www.youtube.com/watch?v=1", "https://youtu.be/zz"]


def test_snapshot_refuses(spark, tmp_path):
    t = {"links": spark.range(1).selectExpr("id", "'u' AS url"), "tags": spark.range(1).selectExpr("id", "'n' AS name"), "link_tags": spark.range(1).selectExpr("id AS link_id", "id AS tag_id")}
    files.write_snapshot(t, str(tmp_path / "s"))
    assert files.read_snapshot(spark, str(tmp_path / "s"))["links"].count() == 1
    files.write_snapshot(t | {"links": t["links"].limit(0)}, str(tmp_path / "e"))
    with pytest.raises(ValueError):
        files.read_snapshot(spark, str(tmp_path / "e"))


def test_page_keywords(spark):
    html = """<meta name="keywords" content="A, b"><meta property="article:tag" content="B"><script type="application/ld+json">{"keywords": ["c", "a"], "genre": "g"}</script>"""
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(pages.publisher_keywords(F.col("h"))).first()[0] == "A, b, c, g"


def test_search_falls_back(spark):
    docs = spark.createDataFrame([(1, "alpha beta", "", "", "", 10), (2, "alpha gamma", "", "", "", 20), (3, "ab", "", "", "", 30)], "doc_id long, title string, description string, note string, tags string, created_at long")
    q = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, "ab"), (4, "zzz")], "query_id int, query string")
    got = {}
    for r in search.search(q, docs).orderBy("query_id", "position").collect():
        got.setdefault((r.query_id, r.mode), []).append(r.doc_id)
    assert got == {(1, "fts"): [1], (2, "or"): [1, 2], (3, "like"): [3]}


def test_summary(spark):
    body = " ".join(f"The {a} engine reads {b} tables and writes the results quickly." for a, b in [("first", "large"), ("second", "small"), ("third", "wide"), ("fourth", "tall"), ("fifth", "round"), ("sixth", "flat")])
    docs = spark.createDataFrame([(1, "", body), (2, "", "short")], "id long, description string, body_text string")
    got = summaries.summarize_corpus(docs).collect()
    assert [r.id for r in got] == [1] and 1 <= got[0].summary.count("engine") <= 2
    assert got[0].summary == summaries.summarize_corpus(docs.repartition(3)).collect()[0].summary


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_synthetic_is_partition_independent(spark):
    a = files.synthetic_links(spark, 50, 3, NOW)
    assert sorted(a.collect()) == sorted(a.repartition(7).collect())


def test_long_edges_and_phrases(spark):
    tail = [f"w{i}" for i in range(119)]
    long = "쿠버네티스오퍼레이터즈"  # eleven characters
    s = spark.createDataFrame([(1, "a", long), (2, "b", " ".join(["start", *tail]))], "tag_id int, tag string, surface string")
    texts = [link(1, f"{long}를 쓴다"), link(2, " ".join(["x", "start", *tail, "y"])), link(3, " ".join(["start", *tail[:-1], "other"]))]
    got = {(r.link_id, r.tag) for r in tagging.matches(spark.createDataFrame(texts, LINK), tagging.compile_surfaces(s)).collect()}
    assert got == {(1, "a"), (2, "b")}


def test_jsonld_is_read_as_json(spark):
    deep = '{"keywords": "deep"}'
    for _ in range(8):
        deep = '{"x": ' + deep + "}"
    html = '<script type="application/ld+json">[{"a": {"genre": ["q\\u0041", "say \\"hi\\""]}, "text": "\\"keywords\\": \\"no\\""}, ' + deep + ', {"y": ' + deep + "}]</script>"
    assert spark.createDataFrame([(html,)], "h string").select(pages.jsonld_keywords(F.col("h"))).first()[0] == ["qA", 'say "hi"']  # what lies deeper than eight levels is left out
    flat = '<script type="application/ld+json">{"articleSection": "s", "o": [{"keywords": "k"}], "text": "\\"genre\\": \\"no\\""}</script>'
    assert spark.createDataFrame([(flat,)], "h string").select(pages.jsonld_keywords(F.col("h"))).first()[0] == ["k", "s"]
    assert spark.createDataFrame([("<p>",)], "h string").select(pages.jsonld_keywords(F.col("h"))).first()[0] == []


def test_postings_on_storage(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta", "", "", "x", 10), (2, "alpha gamma aaaa", "", "", "x y", 20), (3, "ab", "", "", "", 30)], "doc_id long, title string, description string, note string, tags string, created_at long")
    search.write_postings(docs, str(tmp_path / "p"))
    q = spark.createDataFrame([(1, "alpha beta"), (2, "aaa"), (3, "alpha")], "query_id int, query string")
    key = lambda df: sorted((r.query_id, r.doc_id, r.mode, round(r["rank"] or 0, 6), r.position) for r in df.collect())
    stored = search.read_postings(spark, str(tmp_path / "p"))
    assert key(search.search(q, docs, postings=stored)) == key(search.search(q, docs))
    assert [r.doc_id for r in search.search(q, docs, since=15).where("query_id = 3").collect()] == [2]
    assert [r.doc_id for r in search.search(q, docs, only=docs.where("doc_id = 1")).where("query_id = 3").collect()] == [1]
    first = search.search(q, docs, size=1).where("query_id = 3")
    assert [r.position for r in first.collect()] == [1]
    assert [r.position for r in search.search(q, docs, after=first.select("query_id", "position"), size=5).where("query_id = 3").collect()] == [2]
    assert search._phrase_hits(spark.createDataFrame([("aaa",), ("a\\E.",)], "phrase string"), docs, search.build_postings(docs)).collect()[0].f == 2


def test_small_readers(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"url": "https://a.com", "snapshot": {"title": "t"}, "expected_tags": ["x"]}\n')
    (tmp_path / "q.jsonl").write_text('{"query": "a", "url": "https://a.com", "why": "w"}\n')
    (tmp_path / "tags.json").write_text('[\n{"name": "n", "facet": "f", "aliases": ["m"]}, {"name": "o", "facet": "f"}]')
    (tmp_path / "domains.json").write_text('{"_comment": ["x"],\n "a.com": ["n", "o"]}')
    assert [(r.url, r.snapshot.title, r.expected_tags) for r in files.read_golden(spark, str(tmp_path / "g.jsonl")).collect()] == [("https://a.com", "t", ["x"])]
    assert [r["query"] for r in files.read_search_queries(spark, str(tmp_path / "q.jsonl")).collect()] == ["a"]
    assert sorted((r.tag, r.surface) for r in files.load_dictionary(spark, str(tmp_path / "tags.json")).collect()) == [("n", "m"), ("n", "n"), ("o", "o")]
    assert sorted((r.host, r.tag) for r in files.load_domain_map(spark, str(tmp_path / "domains.json")).collect()) == [("a.com", "n"), ("a.com", "o")]
    lines = [f'{{"outcome": "saved", "ms": {i}}}' for i in range(1, 11)] + ['{"outcome": "failed", "ms": 3000}', '{"outcome": "duplicate", "ms": 2500}', "broken"]
    (tmp_path / "log").write_text("\n".join(lines) + "\n")
    report, broken = files.read_timing_log(spark, str(tmp_path / "log"))
    got = {r["class"]: (r.n, r.p50, r.p95, r.max, r.over_budget) for r in report.collect()}
    assert got == {"saved": (11, 6.0, 10.0, 2500.0, 1), "failed": (1, 3000.0, 3000.0, 3000.0, 1)} and broken.first().broken == 1


def test_page_corpus(spark, tmp_path):
    import gzip
    import json

    for name, html in (("a.html.gz", "<p>1</p>\n<p>2</p>"), ("b.html.gz", "<p>é</p>")):
        (tmp_path / name).write_bytes(gzip.compress(html.encode()))
    pages_ = [{"file": f, "url": f"https://{h}/", "host": h, "bytes": 5} for f, h in (("a.html.gz", "a.com"), ("b.html.gz", "b.com"), ("gone.gz", "c.com"))]
    (tmp_path / "index.json").write_text(json.dumps({"fetched": 2, "skipped": 1, "pages": pages_}))
    assert sorted((r.host, r.html) for r in files.read_page_corpus(spark, str(tmp_path)).collect()) == [("a.com", "<p>1</p>\n<p>2</p>"), ("b.com", "<p>é</p>")]


def test_takeout_html(spark, tmp_path):
    (tmp_path / "h.html").write_text('<a href="https://www.youtube.com/watch?v=7">T</a> <a href="https://example.com">x</a>')
    assert [r.url for r in files.takeout(files.whole_files(spark, str(tmp_path / "h.html"))).collect()] == ["https://www.youtube.com/watch?v=7"]


def test_site_rules_and_korean(spark):
    from satchel.functions.tokens import is_korean

    rows = [("www.youtube.com", '"shortDescription":"one\\ntwo"', "one\ntwo"), ("arxiv.org", '<blockquote class="abstract x"><b>Abs</b> tract</blockquote>', "Abs tract"), ("x.com", "<blockquote><p>said <a>so</a></p></blockquote>", "said so"), ("a.com", "<article>own</article>", "own")]
    df = spark.createDataFrame(rows, "host string, html string, want string").select("want", pages.site_rules(F.col("html"), F.col("host")).alias("got"))
    assert all(r.got == r.want for r in df.collect())
    ko = spark.createDataFrame([("검색 엔진", "", "x"), ("engine", "", "검"), ("", "", "")], "a string, b string, c string").select(is_korean(F.col("a"), F.col("b"), F.col("c")).alias("k"))
    assert [r.k for r in ko.collect()] == [True, False, False]


def test_stream_twins(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1), "https://a.com/1", "t", "", "", "", "", 0), (dt.datetime(2024, 1, 1), "https://a.com/1", "t", "", "", "", "", 0), (dt.datetime(2024, 1, 2), "https://a.com/2", "u", "", "body", "", "n", 5)]
    saves = spark.createDataFrame(rows, "at timestamp, url string, title string, description string, body_text string, keywords string, note string, created_at long")
    saves.write.parquet(str(tmp_path / "in"))
    links = spark.createDataFrame([link(1, "old"), link(2, "t", deleted=5)], LINK).drop("domain", "opened_at").withColumn("url", F.concat(F.lit("https://a.com/"), F.col("id")))
    path = str(tmp_path / "archive")
    archive.write_archive(links, path)
    run = lambda c: flows.stream_saves(spark.readStream.schema(saves.schema).parquet(str(tmp_path / "in")), path, str(tmp_path / c), NOW).awaitTermination()
    run("c")
    twin = merges.merge_saves(links, saves.dropDuplicates(["url"]).drop("at"), NOW).drop("outcome")
    key = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert key(spark.read.parquet(path).drop("bucket")) == key(twin)
    run("again")  # a replay from the start changes nothing
    assert key(spark.read.parquet(path).drop("bucket")) == key(twin)
    texts = spark.createDataFrame([link(1, "Go 제네릭", "go"), link(2, "On machine learning")], LINK)
    texts.write.parquet(str(tmp_path / "links"))
    flows.stream_tagging(spark.readStream.schema(texts.schema).parquet(str(tmp_path / "links")), surfaces(spark), domain_map(spark), str(tmp_path / "tags"), str(tmp_path / "c2")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "tags")).drop("batch")
    assert key(got) == key(tagging.tag_corpus(texts, surfaces(spark), domain_map(spark)))


def test_lead_guards_quality(spark):
    s = [f"The {a} engine reads {b} tables and writes the results quickly." for a, b in [("first", "large"), ("second", "small"), ("third", "wide"), ("fourth", "tall")]]
    docs = spark.createDataFrame([(1, "about engines", " ".join(s)), (2, "", "short"), (3, "", "x " * 200), (4, "", " ".join(s))], "id long, description string, body_text string")
    assert {r.id: r.summary for r in summaries.lead_n(docs).collect()} == {1: " ".join(s[:3]), 4: " ".join(s[:3])}
    made = spark.createDataFrame([(1, s[0] + " " + s[1]), (4, "")], "id long, summary string")
    assert {r.reason: r.links for r in summaries.guard_breakdown(docs, made).collect()} == {"summary": 1, "thin body": 1, "few prose": 1, "overlap": 1}
    r = summaries.summary_quality(docs, made).first()
    assert (r.coverage, r.compression) == (0.25, round(len(s[0] + " " + s[1]) / len(" ".join(s)), 6))
    assert r.pair_overlap == pytest.approx(0.75, abs=0.2)
    assert summaries.determinism(made, made).first()[0] == 1.0 and summaries.determinism(made, made.withColumn("summary", F.lit("z"))).first()[0] == 0.0
    gate = summaries.summary_gate(summaries.summary_quality(docs, made), summaries.summary_quality(docs, summaries.lead_n(docs)), 0.9, 0.91, 1.0).first()
    assert gate.recall_ok and gate.determinism_ok and gate.ok == gate.overlap_ok


def test_label_gates(spark):
    golden = spark.createDataFrame([("u1", ["a"]), ("u2", []), ("u3", None)], "url string, expected_tags array<string>")
    assert sorted(r.url for r in evaluation.unlabelled(golden).collect()) == ["u2", "u3"]
    q = spark.createDataFrame([("q", "u1"), ("q", "u9")], "query string, url string")
    assert [r.url for r in evaluation.unknown_answers(q, golden).collect()] == ["u9"]
    gold = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "link_id int, tag string")
    x = spark.createDataFrame([(1, "a", 1), (2, "a", 1)], "link_id int, tag string, rank int")
    y = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 1)], "link_id int, tag string, rank int")
    assert [(r.variant, r.recall, r.links) for r in summaries.common_tag_recall(gold, x, y).orderBy("variant").collect()] == [(0, 0.5, 2), (1, 1.0, 2)]


def test_second_effects_of_merges(spark):
    tags = spark.createDataFrame([(1, "a", "f"), (4, "B", "f")], "id int, name string, facet string")
    change = spark.createDataFrame([("b", "g"), ("z", None), ("y", "h")], "name string, facet string")
    assert sorted(tuple(r) for r in merges.upsert_tags(tags, change).collect()) == [(1, "a", "f"), (4, "B", "g"), (5, "y", "h"), (6, "z", "neutral")]
    assert [tuple(r) for r in merges.duplicate_tags(change.unionByName(change.where("name = 'b'").withColumn("name", F.lit("B")))).collect()] == [("b", 2)]
    links = spark.createDataFrame([link(1), link(2), link(3)], LINK).drop("domain", "opened_at").withColumn("url", F.concat(F.lit("https://a.com/"), F.col("id")))
    rows = spark.createDataFrame([("0", "save", "https://a.com/9", "", "x"), ("1", "tags", "b, a", "", "yes"), ("2", "delete", "", "", "true")], "id string, action string, value string, note string, box string")
    ledger = spark.createDataFrame([], "key string")
    attached = spark.createDataFrame([(1, "old"), (3, "a")], "link_id long, name string")
    got = merges.apply_commands(rows, ledger, links, NOW, attached, tags)
    assert sorted(r.url[-1] for r in got["links"].where("deleted_at IS NULL").collect()) == ["1", "3", "9"]
    assert sorted((r.link_id, r.name) for r in got["attached"].collect()) == [(1, "a"), (3, "a")] and [r.name for r in got["unknown"].collect()] == ["b"]
    again = merges.apply_commands(rows, got["ledger"], got["links"], NOW, got["attached"], tags)
    assert sorted(map(str, again["links"].collect())) == sorted(map(str, got["links"].collect()))
