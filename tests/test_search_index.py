import pytest
from pyspark.sql import functions as F

from satchel.operators import index, search

SCHEMA = "id long, title string, description string, note string, created_at long, deleted_at long"


def archive(spark, rows):
    links = spark.createDataFrame([(i, *r) for i, r in rows.items()], SCHEMA)
    tags = spark.createDataFrame([(1, "reading", "craft"), (2, "later", "craft")], "id int, name string, facet string")
    return links, spark.createDataFrame([(1, 1, "rules", 0.5), (2, 2, "manual", None), (3, 1, "rules", 0.5)], "link_id long, tag_id int, source string, confidence double"), tags


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


QUERIES = [(1, "alpha beta"), (2, "gamma"), (3, "reading list"), (4, "ab"), (5, "that that")]


def test_index_follows_the_archive(spark, tmp_path):
    state = {1: ("alpha beta", "one thathat", "", 10, None), 2: ("gamma ray", "two", "note", 20, None), 3: ("delta", "three ab", "", 30, None)}
    links, link_tags, tags = archive(spark, state)
    ix = index.SearchIndex(spark, str(tmp_path / "ix"))
    assert ix.log() == []
    ix.create(search.search_documents(links, link_tags, tags))
    q = spark.createDataFrame(QUERIES, "query_id int, query string")
    changes = [
        ({2: ("alpha ray", "now beta", "note", 20, None), 4: ("gamma new", "list", "", 40, None)}, [2, 4], "a"),  # a save changed, a new one
        ({1: ("alpha beta", "one thathat", "", 10, 99)}, [1], "b"),  # deleted
        ({1: ("alpha again", "back", "", 50, None), 3: ("delta", "a summary of gamma", "", 30, None)}, [1, 3], "c"),  # saved again; a summary set
    ]
    for change, touched, batch in changes:
        state |= change
        links, link_tags, tags = archive(spark, state)
        ids = spark.createDataFrame([(i,) for i in touched], "id long")
        assert ix.update(links, link_tags, tags, ids, batch) and not ix.update(links, link_tags, tags, ids, batch)
        docs = search.search_documents(links, link_tags, tags)
        cols = ["doc_id", "title", "description", "note", "tags", "created_at"]
        assert rows(ix.docs(), *cols) == rows(docs, *cols)
        assert rows(ix.postings(), "gram", "doc_id", "col") == rows(search.build_postings(docs), "gram", "doc_id", "col")
        found = ["query_id", "doc_id", "mode", F.round("rank", 9), "position"]
        assert sorted(map(str, rows(ix.search(q), *found))) == sorted(map(str, rows(search.search(q, docs), *found)))
    before = rows(ix.postings(), "gram", "doc_id", "col")
    n = ix.compact()
    assert ix.log()[-1].since == n and rows(ix.postings(), "gram", "doc_id", "col") == before


def test_half_written_segment_does_not_count(spark, tmp_path, monkeypatch):
    links, link_tags, tags = archive(spark, {1: ("alpha beta", "one", "", 10, None)})
    ix = index.SearchIndex(spark, str(tmp_path / "ix"))
    ix.create(search.search_documents(links, link_tags, tags))
    links, link_tags, tags = archive(spark, {1: ("other words", "one", "", 10, None)})
    ids = spark.createDataFrame([(1,)], "id long")
    real = index.build_postings
    monkeypatch.setattr(index, "build_postings", lambda docs: real(docs).withColumn("gram", F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception):
        ix.update(links, link_tags, tags, ids, "a")
    assert rows(ix.docs(), "title") == [("alpha beta",)]
    monkeypatch.setattr(index, "build_postings", real)
    assert ix.update(links, link_tags, tags, ids, "a") and rows(ix.docs(), "title") == [("other words",)]


DOC = "doc_id long, title string, description string, note string, tags string, created_at long"


def test_first_results_are_those_of_all(spark):
    docs = spark.createDataFrame([(i, f"alpha {'beta ' * (i % 7)}", "x" * (i % 5), "", "", i) for i in range(200)], DOC)
    q = spark.createDataFrame([(1, "alpha beta"), (2, "beta"), (3, "xx")], "query_id int, query string")
    cols = ["query_id", "doc_id", "mode", "position"]
    assert rows(search.search(q, docs, size=10), *cols) == rows(search.search(q, docs).where("position <= 10"), *cols)


def test_expander_asks_for_more(spark):
    docs = spark.createDataFrame([(1, "a car on the road", "", "", "", 1), (2, "an automobile", "", "", "", 2), (3, "nothing here", "", "", "", 3), (4, "los angeles", "", "", "", 4)], DOC)
    q = spark.createDataFrame([(1, "Car"), (2, "in  the city of angels now"), (3, "cars")], "query_id int, query string")
    e = spark.createDataFrame([("car", "automobile"), ("City of Angels", "los angeles"), ("car", " ")], "term string, expansion string")
    got = {(r.query_id, r.doc_id) for r in search.search(q, docs, expander=e).where("mode = 'fts'").collect()}
    assert got == {(1, 1), (1, 2), (2, 4)}
    assert {(r.query_id, r.doc_id) for r in search.search(q, docs).where("mode = 'fts'").collect()} == {(1, 1)}


def test_overlapping_occurrences_and_odd_letters(spark):
    phrases = spark.createDataFrame([("aaa",), ("that",), ("a\\e.",), ("none",), ("(b",)], "phrase string")
    docs = spark.createDataFrame([(1, "aaaaa thathat", "That THAT", "a\\E.a\\e.", "(b(b", 1)], DOC)
    got = {r.phrase: (r.f, r.near) for r in search._phrase_hits(phrases, docs, None).collect()}
    assert got == {"aaa": (3, True), "that": (4, True), "a\\e.": (2, False)}  # "(b" has two letters, and so no gram
