import random

from pyspark.sql import functions as F

from satchel.operators import search

WORDS = ["aaa", "aaaa", "ab", "über", "übe", "the", "thethe", "x", "of", "\\E."]


def documents(spark):
    r = random.Random(5)
    line = lambda n: " ".join(r.choice(WORDS) for _ in range(r.randrange(n)))
    rows = [(i, line(4), line(9), line(3) if i % 3 else None, line(2), i) for i in range(60)]
    return rows, spark.createDataFrame(rows, "doc_id long, title string, description string, note string, tags string, created_at long")


def test_phrases_are_counted_as_by_hand(spark):
    rows, docs = documents(spark)
    asked = ["aaa", "übe", "the", "of the", "\\e."]
    laps = lambda text, p: sum(text.startswith(p, i) for i in range(len(text)))
    want = {}
    for i, title, description, note, tags, _ in rows:
        for p in asked:
            if f := sum(laps(t.lower(), p) for t in (title, description, note or "", tags)):
                want[i, p] = (f, p in f"{title} {description} {tags}".lower())
    got = search._phrase_hits(spark.createDataFrame([(p,) for p in asked], "phrase string"), docs, None).collect()
    assert {(r.doc_id, r.phrase): (r.f, r.near) for r in got} == want


def test_places_without_a_sort_of_all_results(spark):
    _, docs = documents(spark)
    q = spark.createDataFrame([(1, "the aaa of"), (2, "ab"), (3, "über nothing x"), (4, "nothing here")], "query_id int, query string")
    found = search.candidates(q, docs)
    rows = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "position").collect()))
    every = rows(search.search(q, docs))
    assert {r[0] for r in every} == {1, 2, 3} and len(every) > 50
    one = found.where(F.col("doc_id") % 20 == 7)
    assert rows(search.positions_of(found, one)) == [r for r in every if r[1] % 20 == 7]
    assert rows(search.with_positions(found, 5)) == [r for r in every if r[2] <= 5]
    stored = search.build_postings(docs)
    key = lambda df: sorted((r.query_id, r.doc_id, r.mode, round(r.rank or 0, 9), r.position) for r in df.collect())
    assert key(search.search(q, docs, postings=stored)) == key(search.search(q, docs))
