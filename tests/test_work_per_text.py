"""Work that was done for each query, piece or word is done once a text: brute-force results, and where the plan does it."""

import itertools

from pyspark.sql import functions as F

import __spark_entry__ as entry
from satchel.operators import search as S
from satchel.operators import tagging as T


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_terms_travel_as_texts(spark, tmp_path):
    rows = [(1, "a b a c"), (1, "c d  a"), (2, ""), (3, None), (None, "x x"), (4, "b b b")]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    df = entry.queries()["m04_update_terms"](spark, str(tmp_path))
    changed = lambda i: None if i is None else i + 1000000000 if i % 3 == 1 else i
    new = {(changed(i), w) for i, t in rows if t is not None for w in ("new " + t).split(" ")}
    old = {(i, w) for i, t in rows if t is not None for w in t.split(" ")}
    touched = {changed(i) for i, _ in rows} - {None}
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, [*new, *[r for r in old if r[0] not in touched]]))
    assert "RepartitionByExpression" in plan(df)  # arrays of terms, before they become rows


def test_like_words_are_looked_for_once_a_text(spark, monkeypatch):
    texts = {i: " ".join(w) for i, w in enumerate(itertools.product(["an", "x", "of"], ["to", "q", "ox"], ["", "is"]))}
    queries = {1: ["an", "to"], 2: ["an", "is", "an"], 3: ["zz"], 4: ["zz", "q"], 5: ["of"], 6: ["x", "of", "ox"]}
    docs = spark.createDataFrame([(i, t.upper(), "", None, i) for i, t in texts.items()], "doc_id long, title string, description string, note string, created_at long")
    seen = []
    monkeypatch.setattr(S, "stored", lambda df, name: seen.append(plan(df)) or df)
    got = {(r.query_id, r.doc_id) for r in S._like_hits(spark.createDataFrame(list(queries.items()), "query_id long, w array<string>"), docs).collect()}
    want = set()
    for q, w in queries.items():
        every = {i for i, t in texts.items() if all(x in t + "\n" for x in w)}
        want |= {(q, i) for i in every or {i for i, t in texts.items() if any(x in t for x in w)}}
    assert got == want
    assert "array_position" in seen[0]  # queries name the block's words by their places


def test_only_pieces_of_the_dictionary_become_rows(spark):
    surfaces = spark.createDataFrame([(1, "t", "가나"), (2, "u", "나다라"), (2, "u", "가나"), (3, "v", "abc")], "tag_id int, tag string, surface string")
    words = ["가나", "가나다라", "나다라가나", "나", "가나가나", "abc", "다", "라나다라"]
    tokens = spark.createDataFrame([(1, "title", i, w, None) for i, w in enumerate(words)], "link_id long, field string, pos int, token string, next string")
    df = T.match_edge(tokens, T.compile_surfaces(surfaces))
    want = sorted((i, t, s) for i, w in enumerate(words) for t, s in [(1, "가나"), (2, "나다라"), (2, "가나")] if w.startswith(s) or w.endswith(s))
    assert sorted((r.pos, r.tag_id, r.surface) for r in df.collect()) == want
    assert " IN (" in plan(df) or "INSET" in plan(df)
    assert T.match_edge(tokens, T.compile_surfaces(surfaces.where("tag_id = 3"))).count() == 0
