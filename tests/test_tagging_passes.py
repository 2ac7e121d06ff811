"""Tagging and its evaluation go through texts and scores once."""

from satchel.operators import evaluation as E
from satchel.operators import tagging as T

LINK = "id long, domain string, title string, keywords string, description string, note string, body_text string"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def compiled(spark, surfaces):
    return T.compile_surfaces(spark.createDataFrame([(i, s, s) for i, s in enumerate(surfaces)], "tag_id int, tag string, surface string"))


def test_only_tokens_that_begin_a_surface_become_rows(spark):
    links = spark.createDataFrame([(1, "a.com", "Of the of the", "", "nothing at all, nothing at", None, "x nothing at all y the"), (2, "a.com", "", "", "", "the 서울 시청에서 of", "서울 시청 the")], LINK)
    found = T.match_whole(links, compiled(spark, ["the", "of the", "of the of the", "nothing at all", "서울 시청", "at"]))
    assert {(r.link_id, r.field, r.pos, r.surface) for r in found.collect()} == {
        (1, "title", 0, "of the"), (1, "title", 2, "of the"), (1, "title", 0, "of the of the"), (1, "title", 1, "the"), (1, "title", 3, "the"),
        (1, "description", 0, "nothing at all"), (1, "description", 1, "at"), (1, "description", 4, "at"), (1, "body", 1, "nothing at all"), (1, "body", 2, "at"), (1, "body", 5, "the"),
        (2, "note", 0, "the"), (2, "note", 1, "서울 시청"), (2, "body", 0, "서울 시청"), (2, "body", 2, "the"),
    }
    assert found.count() == 15
    assert "posexplode" not in plan(found) and "parquet" not in plan(found)  # neither every token as a row, nor a stored table
    assert T.match_whole(links, compiled(spark, ["가나"])).count() == 0  # edges alone


def test_ablation_cuts_texts_once_and_counts_before_variants(spark):
    links = spark.createDataFrame([(1, "a.com", "the the", "", "", "", "of"), (2, "b.com", "", "", "", "", "the " * 3), (3, "c.com", "of", "", "", "", "")], LINK)
    surfaces = spark.createDataFrame([(1, "the", "the"), (2, "of", "of")], "tag_id int, tag string, surface string")
    domains = spark.createDataFrame([("b.com", "of")], "host string, tag string")
    gold = spark.createDataFrame([(1, "the"), (2, "of"), (3, "the"), (3, "the")], "link_id long, tag string")
    got = E.ablation(links, surfaces, domains, gold, {"full": [], "no_title": ["title"], "no_domain": ["domain"], "none": ["title", "body", "domain"]})
    assert {(r.variant, r.recall, r.links) for r in got.collect()} == {("full", 0.666667, 3), ("no_title", 0.333333, 3), ("no_domain", 0.333333, 3)}
    assert plan(got).count("transform(tokens") == 1


def test_scores_are_gone_through_once(spark):
    scores = spark.createDataFrame([(1, "a", 4.0, 4.0), (1, "b", 3.0, 3.0), (1, "c", 2.0, 2.0), (1, "d", 2.0, 1.0), (2, "a", 0.5, 0.5)], "link_id long, tag string, score double, uncapped double")
    gold = spark.createDataFrame([(1, "d"), (1, "z"), (2, "a"), (3, "a")], "link_id long, tag string")
    got = E.per_link(scores, gold)
    assert {tuple(r) for r in got.select("link_id", "best", "a", "b").collect()} == {(1, 4, 2.0, 2.0), (2, None, None, None), (3, None, None, None)}
    assert plan(got).count("row_number") == 1
