import collections
import hashlib
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from satchel.llm import chat_format, components, decontaminate, exact_dedup, jaccard_join, language_id, line_dedup, membership, mixing, substring_dedup, token_counts, warc
from satchel.storage import new_path

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: nulls, empty and blank texts, repeated rows, ties, a long text
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n ", "en", None, 3), (None, "x y z", None, "b", 5), (None, "x y z", None, "b", 5), (4, "A b  c", "en", "a", 6), (5, "A b c", "en", "b", 5), (6, "word " * 60_000, "en", "b", 1), (7, "1 2 3", None, "c", 5)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC).withColumn("id", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("a", F.lit(2))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_components(spark):
    r = random.Random(5)
    e = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(7, 7), (None, 3)]
    root = {x: x for p in e for x in p if x is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in e:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {x.id: x.component for x in components.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {x: find(x) for p in e if None not in p and p[0] != p[1] for x in p}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_maybe_in_keeps_all_members(spark):
    df, keys = spark.range(5000), spark.range(0, 5000, 50)
    got = {r.id for r in membership.maybe_in(df, F.col("id"), keys.toDF("k")).collect()}
    assert got >= set(range(0, 5000, 50)) and len(got) < 200


def test_op1_brute_force(spark, docs, sf):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(docs).collect()}
    sets = {}
    for d in pq.read_table(f"{sf}/documents.parquet").to_pylist():
        w = words(d["text"])
        sets[d["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {k: k for k in sets}
    again = True
    while again:
        again = False
        for a, x in sets.items():
            for b, y in sets.items():
                if a < b and x and 100 * len(x & y) >= 75 * len(x | y) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    again = True
    assert got == {k: (len(s), comp[k]) for k, s in sets.items()}


def test_op1_edges(spark, odd):
    got = rows(jaccard_join.jaccard_groups(odd), "doc_id", "n_shingles", "component_id")
    assert (1, 0, 1) in got and got.count((2, 0, 2)) == 2 and (3, 0, 3) in got and got.count((None, 1, None)) == 2
    assert (4, 1, 4) in got and (5, 1, 4) in got and (6, 1, 6) in got
    assert jaccard_join.jaccard_groups(odd.limit(0)).count() == 0


def test_op1_sketch_is_a_lower_bound():
    r = np.random.default_rng(3)
    for n in (10, 300, 3000):
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n * 9 // 10], r.integers(0, 2**63, n // 10, dtype=np.uint64)]))
        x, y = jaccard_join.sketch(a), jaccard_join.sketch(b)
        m = min(len(x), len(y))
        fold = lambda s, m=m: np.bitwise_xor.reduce(s.reshape(-1, m), 0)
        assert int(np.bitwise_count(fold(x) ^ fold(y)).sum()) <= len(np.setxor1d(a, b))


def test_op2_held_out_accuracy(spark, docs):
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    r = docs.where(language_id.held_out(F.col("doc_id"))).select("lang", language_id.language(F.col("text"), model)["lang"].alias("got"))
    assert r.where("lang = got").count() >= 0.97 * r.count()


def test_op2_edges_and_spans(spark, docs, odd):
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in odd.select("doc_id", language_id.language(F.col("text"), model).alias("x")).select("doc_id", "x.*").collect()}
    assert got[1].lang == got[2].lang == got[3].lang == got[7].lang == "und" and got[1].score == 0
    assert got[4].lang in model.langs
    en = " ".join(["the", "and", "that", "with"] * 10)
    de = " ".join(["und", "die", "nicht", "einer"] * 10)
    mixed = spark.createDataFrame([(en + " " + de,)], "t string").select(language_id.language(F.col("t"), model).alias("x")).first().x
    assert [s.lang for s in mixed.spans] == ["en", "de"] and sum(s.words for s in mixed.spans) == 80
    assert language_id.fit(odd.limit(0)) is None
    assert odd.select(language_id.language(F.col("text"), None)["lang"].alias("l")).distinct().collect()[0].l == "und"


def test_op2_viterbi_brute_force():
    from itertools import product

    r = np.random.default_rng(1)
    at = np.array([0, 3, 3, 8])
    s = r.normal(size=(8, 3)).astype(np.float32) * 4
    path = language_id.viterbi(s, at, switch=3.0)
    for a, b in zip(at, at[1:]):
        value = lambda p, a=a: sum(s[a + i, k] for i, k in enumerate(p)) - 3.0 * sum(x != y for x, y in zip(p, p[1:]))
        assert value(path[a:b]) == pytest.approx(max(map(value, product(range(3), repeat=b - a)), default=0), abs=1e-4)


def test_op3_planted(spark):
    r = random.Random(2)
    text = lambda n: " ".join(r.choice("abcdefghij") + "".join(r.choice("klmnopqrstuv") for _ in range(5)) + ("." if i % 9 == 8 else "") for i in range(n))
    passage = text(63).capitalize()
    data = [(i, text(80) + " " + (passage + " " if i % 5 == 0 else "") + text(70)) for i in range(40)] + [(100, None), (None, passage), (101, "")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("id", F.lit(0))
    got = substring_dedup.repeated_paragraphs(df)
    assert {x.doc_id for x in got.collect()} == set(range(0, 40, 5))
    # pieces of a line may be near copies with a few words around the passage, so a class of them may begin later than document 0
    assert {x.keep_id for x in got.collect()} <= set(range(0, 40, 5)) and {x.doc_id for x in got.where("removed").collect()} == set(range(5, 40, 5))
    assert all(gone >= set(range(80, 143)) for gone in _covered(got).values())
    assert substring_dedup.repeated_paragraphs(df.limit(0)).count() == 0


def _covered(got):
    gone = collections.defaultdict(set)
    for x in got.where("removed").collect():
        gone[x.doc_id] |= set(range(x.first_word, x.first_word + x.words))
    return gone


def test_op3_exact_passages_brute_force(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    data, planted = [], []
    for k in range(120):  # lower case without punctuation, any offset
        n, passage = r.randrange(51, 61), None
        passage = [word() for _ in range(n)]
        for i in (2 * k, 2 * k + 1):
            at = r.randrange(60)
            data.append((i, " ".join([*(word() for _ in range(at)), *passage, *(word() for _ in range(r.randrange(60)))])))
        planted.append((2 * k + 1, set(range(at, at + n))))
    # the first holder has only a part of the passage; the rest is shared with a later one
    long = [word() for _ in range(70)]
    data += [(500, " ".join([*long[:30], *(word() for _ in range(40))])), (501, " ".join(long)), (502, " ".join([*(word() for _ in range(7)), *long]))]
    planted.append((502, set(range(7, 77))))
    df = spark.createDataFrame(data, "doc_id long, text string")
    exact = _covered(substring_dedup.exact_passages(df.withColumnRenamed("doc_id", "id"), min_run=25).select(F.col("id").alias("doc_id"), "first_word", "words", F.lit(True).alias("removed")))
    assert all(exact[i] == want for i, want in planted)
    assert exact[501] == set(range(30)) and set(exact) == {i for i, _ in planted} | {501}
    gone = _covered(substring_dedup.repeated_paragraphs(df))
    assert all(gone[i] >= want for i, want in planted)


def test_op3_near_passages(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    data, planted = [], []
    for k in range(120):  # one changed word in 51 to 60 words, two in 100, three parts of 24 words
        n, changed = [(r.randrange(51, 61), None), (100, [33, 66]), (74, [24, 49])][k % 3]
        passage = [word() for _ in range(n)]
        changed = changed or [r.randrange(12, n - 12)]
        copy = [word() if i in changed else w for i, w in enumerate(passage)]
        at = r.randrange(60)
        data.append((2 * k, " ".join([*(word() for _ in range(40)), *passage, *(word() for _ in range(40))])))
        data.append((2 * k + 1, " ".join([*(word() for _ in range(at)), *copy, *(word() for _ in range(40))])))
        planted.append((2 * k + 1, set(range(at, at + n))))
    gone = _covered(substring_dedup.repeated_paragraphs(spark.createDataFrame(data, "doc_id long, text string")))
    assert all(gone[i] >= want for i, want in planted)
    assert set(gone) <= {i for i, _ in planted}
    assert substring_dedup.bridged([(0, 0, 12), (13, 13, 12)], 0.75) == []  # 16 of 26 shingles
    assert substring_dedup.bridged([(0, 5, 25), (26, 31, 25)], 0.75) == [(0, 5, 51, 51)]


def test_op4_properties(spark, docs, odd):
    got = mixing.mix_sources(docs)
    g = got.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n"), F.first("source_size").alias("s")).collect()
    assert all(abs(x.n - x.t) <= max(30, 0.02 * x.t) for x in g)
    assert sum(x.t for x in g) == pytest.approx(sum(x.s for x in g))
    assert got.where("taken > 3 * size OR taken < 0").count() == 0
    assert rows(got, "doc_id", "taken") == rows(mixing.mix_sources(docs.repartition(9)), "doc_id", "taken")
    assert mixing.mix_sources(odd).count() == len(ODD) and mixing.mix_sources(odd.limit(0)).count() == 0


def test_op4_targets(spark):
    s = spark.createDataFrame([("a", 100), ("b", 1), ("c", 1), (None, 60)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(s).collect()}
    assert got["b"] == 3 and got["c"] == 3 and got["a"] == pytest.approx(78) and got[None] == pytest.approx(78)


def test_op5_brute_force(spark, docs, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    found = decontaminate.with_leaks(docs, bench).select("doc_id", F.explode("leaks.item_id").alias("item_id"))
    items = [(r.item_id, words(r.text)) for r in bench.collect()]
    want = set()
    for d in docs.select("doc_id", "text").collect():
        w = " ".join(words(d.text))
        want |= {(d.doc_id, i) for i, t in items if f" {' '.join(t)} " in f" {w} "}
    got = {tuple(r) for r in found.collect()}
    assert want <= got and len(got) <= len(want) + 3


def test_op5_edges(spark, odd):
    bench = spark.createDataFrame([(1, "What is it? The answer is forty two exactly."), (2, None), (None, "q"), (3, "")], "item_id long, text string")
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(50, "noise " * 300 + "What is it? The answer is forty two exactly. " + "more " * 300)], "doc_id long, text string"))
    got = decontaminate.with_leaks(df, bench).where("size(leaks) > 0").collect()
    assert [(r.doc_id, [x.item_id for x in r.leaks]) for r in got] == [(50, [1])]
    assert decontaminate.with_leaks(df, bench.limit(0)).where("size(leaks) > 0").count() == 0


def test_op6(spark, odd):
    got = rows(exact_dedup.exact_groups(odd), "doc_id", "keep_id", "group_size", "kept")
    assert got.count((2, 1, 3, False)) == 2 and (1, 1, 3, True) in got and (5, 4, 2, False) in got and (4, 4, 2, True) in got and got.count((None, None, 2, True)) == 2
    assert exact_dedup.exact_groups(odd.limit(0)).count() == 0
    assert 5 not in [r.doc_id for r in exact_dedup.drop_copies(odd).collect()]


def test_op7(spark):
    long = "é" * 200_000 + "\r\n\r\nWARC/1.1\r\n"
    data = [(1, "http://a/ b\nc", "x" * 120), (2, None, "x" * 120), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", long), (7, "u", long), (None, "u", "y" * 200), (8, "u", "tail\r")]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    path = new_path(spark, "warc")
    warc.write_warc(df, path)
    got = {r.record_id: r for r in warc.read_records(spark, path).collect()}
    for i, _, html in data:
        r = got[f"urn:page:{'null' if i is None else i}"]
        b = (html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(b), hashlib.sha256(b).hexdigest())
    assert {i for i in (1, 2, 6, 7) if got[f"urn:page:{i}"].record_type == "revisit"} == {2, 7} and got["urn:page:7"].refers_to == "urn:page:6"
    chunks = warc.read_chunks(spark, path).where("record_id = 'urn:page:6'").orderBy("chunk_no").collect()
    assert len(chunks) > 3 and "".join(c.chunk for c in chunks) == long and max(c.chunk_bytes for c in chunks) <= warc.CHUNK
    warc.write_warc(df.limit(0), empty := new_path(spark, "warc"))
    assert warc.read_records(spark, empty).count() == 0


def test_op8(spark):
    parts = "array<struct<type:string,text:string,ref:string,tokens:bigint>>"
    turns = [(1, 0, "user", [("text", "a <|im_end|> ~<~| b", None, None), ("image", None, "s3://i", None), ("text", "after", None, None)]), (1, 1, "assistant", [("text", "ok~", None, None), ("document", None, "d", 7)]), (2, 0, None, None), (None, 0, "assistant", [(None, "x", None, None)]), (None, 0, "assistant", [(None, "x", None, None)])]
    df = spark.createDataFrame(turns, f"conv_id long, turn long, role string, parts {parts}")
    got = {r.conv_id: r for r in chat_format.parse_chats(chat_format.format_chats(df)).collect()}
    assert got[1].turns[1].text == "ok~<|document|>" and "a <|im_end|> ~<~| b" in got[1].turns[0].text
    assert [(a.kind, a.ref, a.tokens) for a in got[1].attachments] == [("image", "s3://i", 576), ("document", "d", 7)] and got[1].expanded_tokens == 583
    assert got[2].n_turns == 1 and got[None].n_turns == 2 and got[None].loss_texts == ["x", "x"]
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_op9_equals_library(spark, docs, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df in (docs, odd.where("doc_id <> 6 OR doc_id IS NULL")):
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df).collect()}
        assert got == {k: len(t.encode(v, add_special_tokens=False).ids) for k, v in texts.items()}
    tricky = ["a<|endoftext|>b", "  two\n\n lines \u0085x\u001cy", "don't we'LL", "é中文 123abc"]
    counts = token_counts._Counts(public_tokenizers.path("byte_bpe_50k.json"))
    assert [token_counts.count_tokens(x, counts, ["<|endoftext|>"]) for x in tricky] == [len(t.encode(x, add_special_tokens=False).ids) for x in tricky]


def test_op10(spark, odd):
    block = ["this line has six words or more", "so has this one here with seven", "x"]
    data = [(1, "\n".join(["own one", *block, "end"])), (2, "\n".join([*block, "other"])), (3, "nothing in common"), (4, None), (None, "\n".join(block))]
    got = {r.doc_id: r for r in line_dedup.line_overlaps(spark.createDataFrame(data, "doc_id long, text string").withColumn("id", F.lit(1))).collect()}
    assert got[2].deleted_lines == [0, 1, 2] and got[2].earlier_ids == [1] and got[1].n_deleted == got[3].n_deleted == got[4].n_deleted == 0
    assert line_dedup.line_overlaps(odd).count() == len(ODD) and line_dedup.line_overlaps(odd.limit(0)).count() == 0


def test_op10_patience_is_an_alignment():
    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.randrange(8) for _ in range(r.randrange(12))] for _ in "ab")
        p = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in p) and all(x < u and y < v for (x, y), (u, v) in zip(p, p[1:]))


def test_pipeline_stages(spark, docs, sf):
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        before, out = at.count(), stage(spark, at, sf)
        if name != "mix":
            assert out.columns == docs.columns
            out = spark.createDataFrame(out.collect(), docs.schema)
        if name == "exact_dedup":
            keys = collections.Counter(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in at.collect())
            assert out.count() == len(keys)
        if name == "near_dedup":
            g = jaccard_join.jaccard_groups(at)
            assert out.count() == g.select("component_id").distinct().count()
        assert 0 < out.count() <= before
        at = out


def test_pipeline_odd_rows(spark, odd, sf):
    at = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, at.limit(0), sf)
        assert empty.count() == 0
        at = stage(spark, at, sf)
    assert {r.doc_id for r in at.collect()} <= {4, 6, None}
