import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from satchel.llm import manifest, packing, phrases, token_ids

PATH = public_tokenizers.path("byte_bpe_50k.json")
CLASHES = ("id", "grp", "node", "pos", "cnt", "hash", "leaf", "other", "root", "path", "tie", "key", "keys", "name", "f", "k0", "n", "l", "r", "a", "rid", "piece", "start", "length", "block", "island", "offset")


def clashing(df):
    return df.withColumns({c: F.lit(5) for c in CLASHES if c not in df.columns})


# op11


def brute_phrases(rows, least, top, absorb=100):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {p: n for p, n in f.items() if len(p[1]) > 1 and n >= least}
    inner = defaultdict(int)
    for (lang, p), n in cand.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inner[lang, p[i : i + k]] = max(inner[lang, p[i : i + k]], n)
    out = defaultdict(list)
    for (lang, p), a in cand.items():
        if 100 * inner[lang, p] >= absorb * a and inner[lang, p]:
            continue
        score, _, l, r = min((1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, i, p.decode(), -a, l, r, total[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)}


def test_op11_brute_force(spark, monkeypatch):
    r = random.Random(11)
    pool = ["The", "of", "end", "É", "a1", "x", "tail", "zz"]
    rows = [(r.choice(["en", "fr", None]), "".join(r.choice(pool) + r.choice([" ", "  ", "\t", " ", ". ", "\n", "!", " "]) for _ in range(r.randrange(40)))) for _ in range(150)]
    rows += [("en", None), ("en", ""), (None, ". , ;"), ("und", "The of end " * 30), ("fr", "The of " * 3000), *[("en", "one two three four five six")] * 12]
    docs = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, lang string, text string")
    for least, top, absorb in ((5, 2000, 100), (12, 7, 60)):
        got = {tuple(x) for x in phrases.phrases(clashing(docs), min_count=least, top=top, absorb=absorb).collect()}
        assert got == brute_phrases(rows, least, top, absorb)
    monkeypatch.setattr(phrases, "TRIE", 20)  # many tries, one after the other
    got = {tuple(x) for x in phrases.phrases(docs, min_count=8).collect()}
    assert got == brute_phrases(rows, 8, 2000)


def test_op11_empty(spark):
    assert phrases.phrases(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert phrases.phrases(spark.createDataFrame([("en", "too few words")], "lang string, text string")).collect() == []


def test_op11_trie_accepts_its_phrases_alone():
    rng = np.random.default_rng(3)
    words = rng.integers(1, 2**63, 40).astype(np.uint64)
    rows = {tuple(rng.choice(words[: 12 if rng.random() < 0.7 else 40], rng.integers(1, 6))) for _ in range(600)}
    table = np.array([[*p, *[0] * (5 - len(p))] for p in rows], np.uint64)
    trie, order = phrases.build_trie(table)
    text = rng.choice([*words, 0, 7], 5000).astype(np.uint64)
    got = Counter(tuple(x for x in table[order[i]].tolist() if x) for numbers in trie.walk(text) for i in numbers)
    want = Counter(p for k in range(1, 6) for i in range(len(text) - k + 1) if (p := tuple(text[i : i + k].tolist())) in {tuple(int(x) for x in q) for q in rows})
    assert got == want and want


# op12


def test_op12_ids_are_the_library_s(monkeypatch):
    r = random.Random(5)
    library, own = Tokenizer.from_file(PATH), token_ids.Encoder(PATH)
    alphabet = ["a", "B", "é", "ß", "1", "²", "'", "’", "s", "re", "'s", "'re", "'ll", "  ", " ", "\n", "\t", " ", "　", "\x85", "\x1c", "!", "_", "中", "한", "😀", "́", "٣", "Ⅷ", "\r\n", "don't", "we'll've", "<|endoftext|>"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(1500)] + ["", "x" * 500, " " * 300, "y " * 100, "'" * 100, "'s" * 60]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in own.all_ids(texts)] == want
    monkeypatch.setattr(token_ids, "AT_ONCE", 25)  # slices
    monkeypatch.setattr(token_ids, "REMEMBERED", 50)
    assert [x.tolist() for x in own.all_ids(texts)] == want


def test_op12_pieces():
    assert packing.pieces_of(1) == [(0, 1)] and packing.pieces_of(1024) == [(0, 1024)]
    assert packing.pieces_of(1025) == [(0, 1), (1, 1024)] and packing.pieces_of(2048) == [(0, 1024), (1024, 1024)]


@pytest.fixture(scope="module")
def packed(spark):
    r = random.Random(8)
    texts = [None, "", "x", *(" ".join(r.choice(["alpha", "beta", "gamma's", "12", "ü"]) for _ in range(int(r.expovariate(1 / 250)) + 1)) for _ in range(400)), "long text " * 4000]
    rows = [(None if i % 50 == 7 else i % 390, t) for i, t in enumerate(texts)] + [(3, texts[5])] * 40
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    return rows, packing.pack(docs).collect()


def test_op12_pack_is_whole(packed):
    rows, got = packed
    library = Tokenizer.from_file(PATH)
    want = Counter()
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        for k, start in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[start : first if not k else start + 1024]
            want[doc, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want


def test_op12_pack_is_tight(packed):
    _, got = packed
    bins = defaultdict(list)
    for x in got:
        bins[x.sequence_id].append((x.offset, x.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) == -(-sum(x.length for x in got) // 1024)  # as few as the total allows


def test_op12_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 60)
    r = np.random.default_rng(2)
    lengths = [int(x) for x in r.integers(1, 1024, 700)]
    monkeypatch.setattr(packing, "token_pieces", lambda docs, *a, **k: docs.select(F.col("doc_id").alias("id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.col("length"), F.lit(0).cast("long").alias("ids_crc32")))
    got = packing.pack(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long")).collect()
    fills = Counter()
    for x in got:
        fills[x.sequence_id] += x.length
    assert sorted(x.length for x in got) == sorted(lengths) and max(fills.values()) <= 1024
    assert len(fills) <= packing.bound(lengths, 1024) * 1.06  # blocks of 60 pieces only


def test_op12_genetics():
    r = np.random.default_rng(4)
    lengths = [int(x) for x in r.integers(250, 500, 400)]
    people, bins, _ = packing.evolve(lengths, [], [1], children=0)
    again, fewer, began = packing.evolve(lengths, people, [2], children=30)
    assert began == bins
    assert fewer < 0.98 * bins and all(sorted(i for b in packing.as_bins(p, lengths)[0] for i in b) == list(range(400)) for p in again)
    a, b = packing.as_bins(people[0], lengths), packing.as_bins(people[-1], lengths)
    child = packing.crossover(a, b, lengths, 1024, r)
    assert sorted(i for x in child[0] for i in x) == list(range(400)) and max(child[1]) <= 1024
    assert any(sorted(x) in [sorted(y) for y in b[0]] for x in child[0])  # whole bins of the other parent


def test_op12_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# op13


def sha(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def brute_manifest(rows):
    f = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for doc, source, text in rows:
        other = None if text is None else text.replace("\n", "")
        tampered = doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0
        leaf = sha(f(doc), f(source), f(text))
        groups[source].append((doc is not None, doc or 0, leaf, sha(f(doc), f(source), f(other)) if tampered else leaf, doc))

    def up(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
        return levels

    def beside(levels, i):
        out = []
        for level in levels[:-1]:
            run = i - i % 3
            out.append((level[run:i], level[i + 1 : run + 3]))
            i //= 3
        return out

    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: up([x[2] for x in sorted(groups[s])]) for s in order}
    top = up([trees[s][-1][0] for s in order])
    out = Counter()
    for at, s in enumerate(order):
        for i, (_, _, leaf, other, doc) in enumerate(sorted(groups[s])):
            steps = beside(trees[s], i) + beside(top, at)
            h = other
            for before, after in steps:
                h = sha(*before, h, *after)
            out[doc, leaf, trees[s][-1][0], top[-1][0], sha(*[x for b, a in steps for x in b + a]), h, h == top[-1][0]] += 1
    return out


@pytest.mark.parametrize("n_sources", [0, 1, 5])
def test_op13_brute_force(spark, n_sources):
    r = random.Random(n_sources)
    text = lambda: r.choice([None, "", "a\nb", "é\n", "plain", "x\n" * 50])
    rows = [(i, r.choice(["s", "s", "s", "t́", None, "", "é"][: n_sources + 2]), text()) for i in range(r.randrange(50, 90))] if n_sources else [(7, None, "a\nb")]
    if n_sources:
        rows += [(None, "s", "a"), (None, "s", "b\n"), (3, "s", "c"), (3, "s", "c"), (3, "s", "c\n"), (-4, "s", "\n"), (1, "lone", "q\nr")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    cols = ["doc_id", "source"]
    leaf = manifest.leaf_hash(*map(F.col, cols), F.col("text"))
    other = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, manifest.leaf_hash(*map(F.col, cols), F.replace("text", F.lit("\n"), F.lit(""))))
    got = manifest.manifest(docs, leaf, other=other).withColumn("h", manifest.folded(F.coalesce("other", "leaf"), F.col("path")))
    got = got.select("doc_id", "leaf", "subroot", "root", manifest.proof(F.col("path")), "h", F.col("h") == F.col("root")).collect()
    assert Counter(map(tuple, got)) == brute_manifest(rows)


def test_op13_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert manifest.manifest(docs, manifest.leaf_hash(F.col("text"))).collect() == []
