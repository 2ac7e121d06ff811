import math
import random

import duckdb
import pytest

from satchel.operators import summaries as S
from satchel.plans import QUERIES, SQL
from satchel.plans.pages import LONG


def test_edges_equal_counting_by_hand(spark):
    draw = random.Random(5)
    texts = [[sorted({f"w{draw.randrange(60)}" for _ in range(draw.randrange(9))}) for _ in range(draw.randrange(30))] for _ in range(40)] + [[], [[]], [["a"], ["a"]]]
    common = [f"x{i:05}" for i in range(S.WIDE + 50)]  # more shared tokens than one matrix holds
    texts.append([common, common[:-10], ["x00000", "y"]])
    rows = spark.createDataFrame([(n, [(i, "", t) for i, t in enumerate(s)]) for n, s in enumerate(texts)], "id long, s array<struct<i: int, sentence: string, tokens: array<string>>>")
    want = {(n, i, j): len(set(a) & set(b)) / max(math.log(len(a)) + math.log(len(b)), 0.5) for n, s in enumerate(texts) for i, a in enumerate(s) for j, b in enumerate(s) if i < j and min(len(a), len(b)) >= 2 and set(a) & set(b)}
    edges = S.sentence_edges(rows)
    got = {(r.id, r.i, r.j): r.w for r in edges.collect()}
    assert got.keys() == want.keys() and len(want) > 500 and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert "array_intersect" not in edges._jdf.queryExecution().optimizedPlan().toString()  # no pair is compared by itself


@pytest.mark.parametrize("long", [False, True])
def test_edges_of_texts_of_many_blocks(spark, monkeypatch, long):
    monkeypatch.setattr(S, "BLOCK", 7)
    draw = random.Random(6)
    texts = [[sorted({f"w{draw.randrange(60)}" for _ in range(draw.randrange(9))}) for _ in range(n)] for n in (0, 1, 6, 7, 8, 13, 14, 15, 40, 70)]
    rows = spark.createDataFrame([(n, [(i, "", t) for i, t in enumerate(s)]) for n, s in enumerate(texts)] + [(99, None)], "id long, s array<struct<i: int, sentence: string, tokens: array<string>>>")
    want = {(n, i, j): len(set(a) & set(b)) / max(math.log(len(a)) + math.log(len(b)), 0.5) for n, s in enumerate(texts) for i, a in enumerate(s) for j, b in enumerate(s) if i < j and min(len(a), len(b)) >= 2 and set(a) & set(b)}
    got = (S.sentence_edges(rows.where("id < 5"), rows.where("id >= 5")) if long else S.sentence_edges(rows)).collect()
    assert len(got) == len(want) > 500 and all(abs(r.w - want[r.id, r.i, r.j]) < 1e-9 for r in got)


def test_j13_every_line_of_a_text(spark, tmp_path):
    """Lines behind the 200th, behind a block and of texts that are dealt: each shares a word with the one half a text before."""
    sizes = {1: 260, 2: 2 * S.BLOCK + 9, 3: LONG, 4: LONG + 3}
    texts = [(i, "\n".join(f"u{k}x v{k}x shared{k % (n // 2)}y" for k in range(n))) for i, n in sizes.items()] + [(5, None), (6, ""), (7, "one two three\none two three\ntwo three four")]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in QUERIES["j13_sentence_edges"](spark, str(tmp_path)).collect()}
    w = round(1 / (2 * math.log(3)), 6)
    want = {(i, a, b, w) for i, n in sizes.items() for a in range(n) for b in range(a + n // 2, n, n // 2)} | {(7, 0, 1, round(2 / (2 * math.log(3)), 6))}
    assert got == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert {*con.sql(SQL["j13_sentence_edges"]).fetchall()} == want
