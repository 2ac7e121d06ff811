"""Language ID held against a version that goes word by word in plain Python, and against itself in slices."""

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from satchel.llm import language_id
from satchel.llm.tokens import blocks

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def folded(b):
    return 0 if b == 0x20 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b


def bucket(data, i):
    left, c, right = (folded(data[j]) if 0 <= j < len(data) else 0 for j in (i - 1, i, i + 1))
    mixed = (left * 0x9E3779B1 ^ c * 0x85EBCA77 ^ right * 0xC2B2AE3D) & 0xFFFFFFFF
    return (mixed * 0x27D4EB2F & 0xFFFFFFFF) >> 16


def script(word):
    return max(next((k for a, b, k in language_id.RANGES if a <= x <= b), 0) for x in word)


def learn(docs):
    grams, scripts = {}, {}
    for text, lang in docs:
        data = text.encode()
        g, s = grams.setdefault(lang, {}), scripts.setdefault(lang, {})
        for i in range(len(data)):
            k = bucket(data, i)
            g[k] = g.get(k, 0) + 1
        for w in WORD.findall(data):
            s[script(w)] = s.get(script(w), 0) + 1
    return grams, scripts


def label(text, langs, grams, total, scripts):
    """The language of most words with letters on the best path, and its share."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    data = text.encode()
    words, lettered = [], []
    for m in WORD.finditer(data):
        kind = script(m[0])
        may = [kind == 0 or scripts[x].get(kind, 0) >= 0.001 * max(sum(scripts[x].values()), 1) for x in langs]
        known = any(may) and kind > 0
        at = [bucket(data, i) for i in range(m.start(), m.end())]
        words.append([sum(math.log((grams[x].get(b, 0) + 0.5) / (total[x] + 0.5 * language_id.GRAMS)) for b in at) - (0 if ok else language_id.OUTSIDE) if known else 0.0 for x, ok in zip(langs, may)])
        lettered.append(known)
    best, back = words[0], []
    for s in words[1:]:
        top = max(range(len(langs)), key=lambda j: best[j])
        came = [j if best[j] >= best[top] - language_id.SWITCH else top for j in range(len(langs))]
        best = [max(best[j], best[top] - language_id.SWITCH) + s[j] for j in range(len(langs))]
        back.append(came)
    state = max(range(len(langs)), key=lambda j: best[j])
    path = [state]
    for came in reversed(back):
        state = came[state]
        path.append(state)
    votes = [0] * len(langs)
    for k, yes in zip(reversed(path), lettered):
        votes[k] += yes
    if not sum(votes):
        return max(langs, key=lambda x: total[x]), 0.0
    k = votes.index(max(votes))
    return langs[k], votes[k] / sum(votes)


def test_query_equals_the_plain_version(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    out = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}
    grams, scripts = learn([(r.text, r.lang) for r in rows if r.text is not None and r.lang is not None and not out[r.doc_id]])
    langs = sorted(grams)
    total = {x: sum(grams[x].values()) for x in langs}
    got = {r.doc_id: r for r in language_id.op2_language_id(spark, sf).collect()}
    assert set(got) == set(out) and len(got) == len(rows)
    for r in rows:
        lang, score = label(r.text, langs, grams, total, scripts)
        assert (got[r.doc_id].lang_pred, got[r.doc_id].held_out) == (lang, out[r.doc_id]) and abs(got[r.doc_id].score - score) < 1e-9


def test_cut_slices_give_the_same_answers(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit(docs)
    texts = [r.text for r in docs.select("text").limit(60).collect()]
    odd = [None, "", "1 2", "word " * 2_000, None, "Ж é 漢 x", " \t", "", "und die " * 300 + "the and " * 300]
    column = pa.array([*odd, *texts, *odd], pa.string())
    whole = language_id._identify(column, model)
    for size in (1, 700, 20_000):
        parts = [language_id._identify(p, model) for _, p in blocks(column, size)]
        assert len(parts) > 1 and pa.concat_arrays(parts).to_pylist() == whole.to_pylist()
    assert np.all([x["lang"] == "und" for x in whole.take([0, 1, 2]).to_pylist()])
    one = spark.createDataFrame([(x,) for x in column.to_pylist()], "t string").coalesce(1).select(language_id.language(F.col("t"), model).alias("x"))
    assert [tuple(r.x)[:2] for r in one.collect()] == [(x["lang"], x["score"]) for x in whole.to_pylist()]
