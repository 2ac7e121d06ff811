import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from satchel.llm import decontaminate as D


def zipf(r, n, vocabulary=3000):
    return " ".join(f"w{min(int(r.paretovariate(0.7)), vocabulary)}" for _ in range(n))


def test_op5_pruned_retrieval_is_exhaustive_bm25(monkeypatch):
    r = random.Random(4)
    items = [(i, zipf(r, r.randrange(8, 40))) for i in range(300)]
    index = D.build_index(items)
    texts = [zipf(r, 200) + " " + items[k % 300][1] + " " + zipf(r, 100) if k % 2 else zipf(r, 150) + " " + " ".join(items[k][1].split()[: 3 + k % 20]) for k in range(120)]
    pairs = {(w, int(index.rank[np.searchsorted(index.terms, x)])) for w, t in enumerate(texts) for x in D._words(t) if x in index.terms}
    window, term = map(np.array, zip(*sorted(pairs)))
    weight = np.zeros((len(index.terms), len(items)))
    for t in range(len(index.terms)):
        at = slice(index.post_at[t], index.post_at[t + 1])
        weight[t, index.post_item[at]] = index.post_weight[at]
    want = {(w, i): s for w in range(len(texts)) for i, s in enumerate(weight[term[window == w]].sum(0)) if s >= D.RETRIEVE}
    assert len(want) > 100
    for step in (1_000_000, 500):  # all windows at once, or a few
        monkeypatch.setattr(D, "STEP", step)
        got = {(w, i): s for w, i, s in D._retrieved(index, window, term)}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def test_op5_many_indexes_give_the_same(spark):
    r = random.Random(8)
    items = [(i, zipf(r, r.randrange(6, 30)) + ("? yes it is" if i % 3 else "")) for i in range(60)] + [(None, "a b c"), (70, None), (71, " ")]
    docs = [(d, zipf(r, 80) + " " + items[d % 60][1] + " " + zipf(r, 50), "mine", d) for d in range(40)] + [(40, None, "x", 1), (41, "", "x", 1), (42, "word " * 30_000, "x", 1)]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string, hits string, piece int")
    key = lambda x: sorted(((r.doc_id, r.hits, r.piece, [(h.item_id, round(h.bm25, 9), h.first_word) for h in r.leaks]) for r in x.collect()))
    one, many = D.with_leaks(df, bench), D.with_leaks(df, bench, index_items=15)
    assert one.columns == many.columns and key(one) == key(many)
    assert all(d % 60 in [h[0] for h in hits] for d, _, _, hits in key(one) if d < 40)
    assert D.with_leaks(df.limit(0), bench, index_items=15).count() == 0 and D.with_leaks(df, bench.limit(0)).where(F.size("leaks") > 0).count() == 0
