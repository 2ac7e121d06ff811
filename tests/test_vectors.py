import pytest
from pyspark.sql import functions as F

from satchel.operators import search, vectors
from satchel.views import base

KINDS = "vec_id long, embedding array<float>"


def pairs(df):
    return {(r.query_id, r.vec_id) for r in df.collect()}


def test_recall_against_the_exact_way(spark):
    e = base(spark, "/root/testdata/sf0.01", "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id % 20 = 0")
    exact, found = pairs(search.cosine_knn(q, e, 5)), vectors.bucketed_knn(q, e, 5)
    got = pairs(found)
    assert len(exact & got) >= 0.9 * len(exact)
    assert {(r.query_id, r.rank) for r in found.collect()} == {(a, i) for a in {x for x, _ in exact} for i in range(1, 6)}


def test_clustered_vectors_need_few_lists(spark):
    rows = [(i, [float(i % 10 == j) + ((i * 31 + j * 17) % 23) / 500 for j in range(10)]) for i in range(500)]
    e = spark.createDataFrame(rows, KINDS)
    unit = vectors.units(e)
    centroids = vectors.fit_lists(unit, 10)
    placed = vectors.in_lists(unit, "vec_id", centroids, 1)
    assert placed.count() == 500
    assert vectors.probes_for(e, e, placed, centroids, 5, 0.95) <= 2


def test_hot_list_is_many_blocks_and_all_probes_are_exact(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 50)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 7)
    hot = [(i, [1.0, 0.001 * (i % 97), 0.002 * (i % 13)]) for i in range(600)]  # one direction holds most rows
    rest = [(i, [0.1 * (i % 7), 1.0, -0.1 * (i % 11)]) for i in range(600, 800)]
    e = spark.createDataFrame([*hot, *rest, (900, None), (901, [0.0, 0.0, 0.0]), (902, [None, 1.0, 0.0])], KINDS)
    q = e.where("vec_id % 20 = 0")
    got = vectors.bucketed_knn(q, e, 4, lists=5, probes=5)
    sound = e.where("vec_id < 900")
    want = search.cosine_knn(sound.where("vec_id % 20 = 0"), sound, 4)
    key = lambda df: sorted((r.query_id, r["rank"], round(r.score, 5)) for r in df.collect())
    assert key(got) == key(want) and got.count() == 160
    assert got.where(F.col("query_id") == F.col("vec_id")).isEmpty()


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 0.0])], [(1, [1.0, 0.0]), (2, [1.0, 0.0])]])
def test_few_rows(spark, rows):
    e = spark.createDataFrame(rows, KINDS)
    got = {(r.query_id, r.vec_id, r.score, r["rank"]) for r in vectors.bucketed_knn(e, e, 3).collect()}
    assert got == {(a, b, 1.0, 1) for a, _ in rows for b, _ in rows if a != b}


def test_exact_way_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "VECTORS", 40)
    rows = [(i, [float((i % 60) * (j + 3) % 17) - 8 for j in range(6)]) for i in range(1, 150)]  # many equal ones
    e = spark.createDataFrame([*rows, (900, None), (901, [0.0] * 6)], KINDS)
    unit = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] for i, v in rows}
    dot = lambda a, b: round(sum(x * y for x, y in zip(unit[a], unit[b])), 6)
    want = {(a, b, -s, n) for a in unit if a % 20 == 0 for n, (s, b) in enumerate(sorted((-dot(a, b), b) for b in unit if b != a)[:5], 1)}
    got = search.cosine_knn(e.where("vec_id % 20 = 0"), e, 5)
    assert {(r.query_id, r.vec_id, r.score, r["rank"]) for r in got.collect()} == want
