"""Summaries and what is measured on them cut each text once, and rank its sentences as the plain rounds do."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from satchel.operators import summaries as S
from satchel.views import view


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


@pytest.mark.parametrize("name", ["t5_summarize_corpus", "a20_new_gram_gain"])
def test_texts_are_read_once(spark, sf, name):
    assert scans(entry.queries()[name](spark, sf)) == 1


def test_texts_stay_where_they_are(spark, sf):
    links = view(spark, sf, "links")
    made = links.select("id", F.lit("A summary.").alias("summary"))
    for df in (S.summary_quality(links, made), S.guard_breakdown(links, made)):
        joins = df._jdf.queryExecution().optimizedPlan().toString().split("Join ", 1)[0]  # what stands above the texts' meeting with their summaries
        assert joins and "body_text" not in joins


def plain(tokens):
    n = len(tokens)
    w = [[len(set(a) & set(b)) / max(math.log(len(a)) + math.log(len(b)), 0.5) if i != j and min(len(a), len(b)) > 1 else 0.0 for j, b in enumerate(tokens)] for i, a in enumerate(tokens)]
    total, now, before = [sum(r) for r in w], [1.0] * n, [9.0] * n
    for _ in range(S.ROUNDS):
        if max(abs(x - y) for x, y in zip(now, before)) < S.EPSILON:
            break
        now, before = [1 - S.DAMPING + S.DAMPING * sum(w[i][j] / total[j] * now[j] for j in range(n) if w[i][j]) for i in range(n)], now
    return [x / max(now) for x in now]


def test_ranks_as_plain_rounds(spark, sf):
    odd = [[], [[]], [["a"]], [["a"], ["a"]], [["a", "b"], ["a", "b"], []], [["a", "b"], [], ["b", "c", "a"], ["c"], ["d", "c"]]]
    given = [[r.tokens for r in d.s] for d in S.prose_texts(view(spark, sf, "links").select("id", "body_text")).limit(40).collect()]
    texts = [*odd, *given]
    rows = [(k, [(i, "", t) for i, t in enumerate(s)]) for k, s in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, s array<struct<i: int, sentence: string, tokens: array<string>>>")
    got = {r.id: r.score for r in S.with_centrality(df).select("id", "score").collect()}
    for k, s in enumerate(texts):
        assert got[k] == pytest.approx(plain(s) if s else [], abs=1e-9)
