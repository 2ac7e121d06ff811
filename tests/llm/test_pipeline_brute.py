"""Each stage of the pipeline against a brute-force version, on one fixture with planted cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from satchel.llm import language_id

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


@pytest.fixture(scope="module")
def fixture(spark, sf):
    """Documents of sf0.001 with copies, near copies, chains, benchmark items, foreign scripts, nulls, ties and clashing columns."""
    r = random.Random(3)
    base = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    items = [x.text for x in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").limit(4).collect()]
    data, n = list(base), 10_000

    def add(text, lang="en", source="src1"):
        nonlocal n
        n += 1
        data.append((n, text, lang, source, len(text or "")))

    for _, text, lang, source, _ in base[:12]:
        add(text, lang, source)
        add(re.sub(r"\s", lambda m: m[0] * 2, text, count=3), lang, source)  # equal but for white space
        w = text.split(" ")
        for share in (0.01, 0.03, 0.06, 0.12):  # at last no near copy of the first, but of one between
            w = [x if r.random() > share else "changed" for x in w]
            add(" ".join(w), lang, source)
    for k, item in enumerate(items):
        add(base[20 + k][1] + "\n" + item + "\n" + base[30 + k][1])
        add(item)
    for text in ("กขค งจฉ ชซฌ", "αβγ δεζ ηθι", "1 2 3", "", " \n\t ", None):
        add(text, None, None)
    add("word " * 40_000)
    data += [data[5], data[5], (None, base[40][1] + " more", "en", None, 1)]
    df = spark.createDataFrame(data, SCHEMA)
    for c in ("id", "key", "doc", "found", "leaks", "repeats", "taken", "__gone", "__lang", "__own", "__bucket", "gone", "own"):
        df = df.withColumn(c, F.lit(7))
    return df


def texts(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.text or "", r.text is None) for r in df.collect()))


def test_language_stage(spark, fixture, sf):
    out = STAGES["language"](spark, fixture, sf)
    assert out.columns == fixture.columns
    latin = lambda t: bool(re.search(r"[A-Za-zÀ-ÿ]", t or ""))  # noqa: E731  the scripts that the labelled documents have
    assert texts(out) == texts(spark.createDataFrame([r for r in fixture.collect() if latin(r.text)], fixture.schema))


def test_language_in_slices_is_language_alone(spark, fixture, monkeypatch):
    model = language_id.fit(fixture)
    one = lambda: [tuple(r) for r in fixture.select("doc_id", language_id.language(F.col("text"), model).alias("x")).select("doc_id", "x.lang", "x.score").collect()]
    import pyarrow as pa

    got = one()
    for (_, lang, score), r in zip(got, fixture.collect()):
        alone = language_id._identify(pa.array([r.text], pa.string()), model)[0].as_py()
        assert (lang, score) == (alone["lang"], alone["score"])


def test_exact_stage(spark, fixture, sf):
    out = STAGES["exact_dedup"](spark, fixture, sf)
    best = {}
    rows = fixture.collect()
    norm = lambda r: re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
    for r in rows:
        if r.doc_id is not None:
            best[norm(r)] = min(best.get(norm(r), r.doc_id), r.doc_id)
    want = [r for r in rows if r.doc_id == best.get(norm(r))]
    assert out.columns == fixture.columns and texts(out) == texts(spark.createDataFrame(want, fixture.schema))


def test_near_stage(spark, fixture, sf):
    out = STAGES["near_dedup"](spark, fixture, sf)
    rows = [r for r in fixture.collect() if r.doc_id is not None]
    sets = {r.doc_id: shingles(r.text) for r in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = [r for r in fixture.collect() if r.doc_id is None or find(r.doc_id) == r.doc_id]
    assert len(want) < fixture.count() - 30
    assert out.columns == fixture.columns and texts(out) == texts(spark.createDataFrame(want, fixture.schema))


def test_benchmark_stage(spark, fixture, sf):
    out = {r.doc_id for r in STAGES["decontaminate"](spark, fixture, sf).collect()}
    items = [x.text for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    verbatim = [" " + " ".join(words(t)) + " " for t in items]
    sets = [shingles(t) for t in items]
    for r in fixture.collect():
        text, own = " " + " ".join(words(r.text)) + " ", shingles(r.text)
        if any(v in text for v in verbatim):
            assert r.doc_id not in out
        elif all(len(own & s) < 0.3 * len(s) for s in sets):
            assert r.doc_id in out
    assert STAGES["decontaminate"](spark, fixture, sf).columns == fixture.columns


def test_mix_stage(spark, fixture, sf):
    rows = [(r.source, len(words(r.text)) if r.text else 0) for r in fixture.collect()]
    names = sorted({s for s, _ in rows if s is not None}) + ([None] if any(s is None for s, _ in rows) else [])
    size = {s: sum(n for x, n in rows if x == s) for s in names}
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(size.values())
    while True:  # share, cap, share the excess again
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 3 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= target[s]
        open_ -= over
    target |= share
    from satchel.llm.mixing import mix_sources

    taken, longest = dict.fromkeys(names, 0), {s: max(n for x, n in rows if x == s) for s in names}
    for r in mix_sources(fixture).collect():
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source] and r.taken == r.repeats * r.size
        assert r.repeats - int(target[r.source] / max(size[r.source], 1) + 1e-9) in (0, 1) and r.repeats <= 3
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= max(longest[s], 1) for s in names)
    out = STAGES["mix"](spark, fixture, sf)
    assert sorted(out.columns) == sorted(fixture.columns)
    again = STAGES["mix"](spark, fixture.repartition(5), sf)
    assert texts(out) == texts(again) and out.where("repeats = 0").count() == 0
