import pytest
from pyspark.sql import functions as F

from satchel.operators import evaluation, search, summaries

SCORES = "link_id long, tag string, score double, uncapped double"


def test_tagging_report_equals_a_count_by_hand(spark):
    scores = spark.createDataFrame([(1, "a", 5.0, 5.0), (1, "b", 4.0, 4.0), (1, "c", 3.0, 3.0), (1, "d", 3.0, 2.0), (2, "a", 0.5, 0.5), (3, "b", 2.0, 2.0)], SCORES)
    gold = spark.createDataFrame([(1, "d"), (2, "a"), (3, "b"), (3, "c"), (9, "a")], "link_id long, tag string")
    facts = spark.createDataFrame([(1, "dev", True), (2, "dev", None), (3, "wild", False), (4, "wild", True)], "link_id long, set string, thin boolean")
    names = spark.createDataFrame([(t,) for t in "abcd"], "tag string")
    report = evaluation.eval_tagging(scores, gold, names, facts, "thin")
    got = {(r.set, r.slice, r.value): (r.links, r.recall, r.tied, r.zero, r.outranked, r.reachable) for r in report.collect()}
    assert got == {
        ("dev", "all", None): (2, 0.0, 1, 1, 1, 1),
        ("wild", "all", None): (1, 1.0, 0, 0, 0, 1),
        ("dev", "thin", "true"): (1, 0.0, 1, 0, 1, 1),
        ("dev", "thin", None): (1, 0.0, 0, 1, 0, 0),
        ("wild", "thin", "false"): (1, 1.0, 0, 0, 0, 1),
    }
    evaluation.tagging_gate(report, {"wild": 0.9})
    for least in ({"dev": 0.1}, {"test": 0.0}):
        with pytest.raises(RuntimeError):
            evaluation.tagging_gate(report, least)
    with pytest.raises(ValueError, match="dictionary lacks"):
        evaluation.eval_tagging(scores, gold, names.where("tag <> 'c'"), facts, "thin")
    with pytest.raises(ValueError, match="without a label"):
        evaluation.eval_tagging(scores, gold, names, facts.withColumn("set", F.when(F.col("link_id") == 4, "test").otherwise(F.col("set"))))


def test_search_report(spark):
    results = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1), (2, 12, 2)], "query_id long, doc_id long, position int")
    answers = spark.createDataFrame([(1, 10), (2, 12), (3, 11)], "query_id long, doc_id long")
    corpus = spark.createDataFrame([(10,), (11,), (12,)], "doc_id long")
    report, misses = evaluation.eval_search(results, answers, corpus)
    assert tuple(report.select(F.round("hit1", 6), F.round("mrr", 6), "reached", "queries").first()) == (0.333333, 0.5, 2, 3)
    assert {tuple(r) for r in misses.select("query_id", "doc_id", "position").collect()} == {(2, 12, 2), (3, 11, None)}
    with pytest.raises(ValueError, match="corpus lacks"):
        evaluation.eval_search(results, answers, corpus.where("doc_id <> 12"))
    assert report.columns == search.search_quality(results, answers).columns


def test_summary_report_and_gate(spark):
    body = "The first engine reads large tables. The second writer keeps small files in order. A third idea is told at the end."
    docs = spark.createDataFrame([(1, "dev", "The first engine reads large tables.", body), (2, "dev", "", body), (3, "wild", "x", body)], "id long, set string, description string, body_text string")
    kinds = "id long, summary string"
    made = spark.createDataFrame([(1, "The second writer keeps small files in order."), (2, "A third idea is told at the end."), (3, "")], kinds)
    lead = spark.createDataFrame([(1, "The first engine reads large tables."), (2, "The first engine reads large tables.")], kinds)
    gold = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "link_id long, tag string")
    tags = "link_id long, tag string, rank int"
    ours, first = spark.createDataFrame([(1, "a", 1), (2, "b", 4), (2, "c", 1), (3, "a", 1)], tags), spark.createDataFrame([(1, "c", 1), (1, "a", 2), (2, "c", 1)], tags)
    how = {"gold": gold, "tags_made": ours, "tags_lead": first}
    report = summaries.eval_summary(docs, made, made, lead, **how)
    r = {x.set: x for x in report.collect()}
    quality = lambda s: tuple(summaries.summary_quality(docs.where("set = 'dev'"), s).first())
    assert (r["dev"].coverage, r["dev"].overlap, r["dev"].pair_overlap, r["dev"].compression) == quality(made)
    assert (r["dev"].lead_coverage, r["dev"].lead_overlap, r["dev"].lead_pair_overlap, r["dev"].lead_compression) == quality(lead)
    assert (r["dev"].compared, r["dev"].tag_recall, r["dev"].lead_tag_recall, r["dev"].determinism) == (2, 0.5, 0.5, 1.0)
    assert (r["wild"].coverage, r["wild"].overlap, r["wild"].compared, r["wild"].tag_recall) == (0.0, None, 0, None)
    summaries.summary_check(report, "dev")
    changed = summaries.eval_summary(docs, made, made.withColumn("summary", F.lit("z")), lead, **how)
    copied = summaries.eval_summary(docs, lead, lead, lead, **how)
    for bad, name in ((changed, "dev"), (copied, "dev"), (report, "wild"), (report, "test")):
        with pytest.raises(RuntimeError):
            summaries.summary_check(bad, name)
