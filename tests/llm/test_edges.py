"""Defined cases of operators: clashing columns, repeated rows, ties, very long texts; recall and classes against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import public_tokenizers
from satchel.llm import chat_format, decontaminate, jaccard_join, line_dedup, mixing, substring_dedup, token_counts

CLASHES = ("id", "key", "name", "words", "at", "kind", "lines", "earlier", "later", "gone", "own", "doc", "block", "p", "src", "order", "__own", "__bucket", "__bits", "__gone", "component", "set_id", "lead", "n")


def clashing(df):
    return df.withColumns({c: F.lit(5) for c in CLASHES if c not in df.columns})


def shingles(text):
    w = re.findall(r"\S+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def word(r):
    return "".join(r.choice("abcdefghijklmnop") for _ in range(6))


def test_op3_recall_of_edited_paragraphs(spark):
    r, data = random.Random(21), []
    for k in range(300):  # lines of 30 to 90 words, edited down to a Jaccard index of 0.75 to 0.9
        while True:
            a = [word(r) for _ in range(r.randrange(30, 91))]
            b = [word(r) if r.random() < 0.02 else x for x in a]
            x, y = shingles(" ".join(a)), shingles(" ".join(b))
            if 0.75 <= len(x & y) / len(x | y) < 0.9:
                break
        data += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    docs = spark.createDataFrame(data, "id long, text string")
    rows = substring_dedup.places(docs)
    found = substring_dedup.near_classes(docs, rows, 0.75)
    of = rows.where(F.col("kind") == substring_dedup.PARA).join(found, "name").groupBy("class_id").agg(F.array_sort(F.collect_set("id")).alias("ids")).collect()
    assert all(len(c.ids) == 2 and c.ids[0] + 1 == c.ids[1] and c.ids[0] % 2 == 0 for c in of)
    assert len(of) >= 0.9 * 300


def test_op3_classes_brute_force(spark):
    r, data = random.Random(22), []
    pool = [[word(r) for _ in range(r.randrange(20, 60))] for _ in range(25)]
    near = lambda w: [word(r) if i == len(w) // 2 else x for i, x in enumerate(w)] if r.random() < 0.4 else w
    for d in range(60):
        data.append((d, [" ".join(near(r.choice(pool)) if r.random() < 0.4 else [word(r) for _ in range(r.randrange(10, 50))]) for _ in range(r.randrange(1, 7))]))
    data += [data[7], (60, [" ".join(word(r) for _ in range(40_000))]), (61, ["", "x"])]
    lines = sorted({x for _, t in data for x in t if len(x.split()) >= 8 and len(x.split()) <= 96})
    sets = [shingles(x) for x in lines]
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    place = {}
    for d, t in data:
        at = 0
        for x in t:
            if x in lines:
                place.setdefault(find(lines.index(x)), set()).add((d, at))
            at += len(x.split())
    want = set()
    for d, t in data:
        at, run = 0, []
        for x in [*t, None]:
            hit = x in lines and len({p[0] for p in place[find(lines.index(x))]}) > 1 if x else False
            if hit:
                run.append((d, at, len(x.split()), *min(place[find(lines.index(x))])))
            elif x != "" or x is None:
                want |= set(run) if sum(p[2] for p in run) >= 50 else set()
                run = []
            at += len(x.split()) if x else 0
    docs = clashing(spark.createDataFrame([(d, "\n".join(t)) for d, t in data] + [(None, "a b"), (70, None)], "doc_id long, text string"))
    got = substring_dedup.repeated_paragraphs(docs)
    paragraphs = {(x.doc_id, x.first_word, x.words, x.keep_id, x.keep_first_word) for x in got.collect()}
    found = want & paragraphs
    assert len(want) > 40 and len(found) >= 0.95 * len(want)
    assert all((x.doc_id, x.first_word) != (x.keep_id, x.keep_first_word) for x in got.where("removed").collect())
    # nothing is removed that no earlier place has, or has in much the same words
    text = {d: " ".join(t).split() for d, t in data}
    for x in got.where("removed").collect():
        a, b = " ".join(text[x.doc_id][x.first_word : x.first_word + x.words]), " ".join(text[x.keep_id][x.keep_first_word : x.keep_first_word + x.words + 8])
        assert len(shingles(a) & shingles(b)) >= 0.5 * len(shingles(a))


def test_op1_clashes_and_ties(spark):
    r = random.Random(23)
    t = " ".join(word(r) for _ in range(80))
    data = [(3, t), (3, t), (9, t + " tail"), (4, None), (5, ""), (None, t), (6, "one two"), (7, "ONE  two"), (8, " ".join(word(r) for _ in range(50_000)))]
    got = {(x.doc_id, x.component_id) for x in jaccard_join.jaccard_groups(clashing(spark.createDataFrame(data, "doc_id long, text string"))).collect()}
    assert got == {(3, 3), (9, 3), (4, 4), (5, 5), (None, None), (6, 6), (7, 6), (8, 8)}
    assert jaccard_join.jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_op5_clashing_columns(spark):
    df = clashing(spark.createDataFrame([(1, "noise " * 70_000 + "What is it? The answer is forty two exactly."), (2, "clean"), (2, "clean")], "doc_id long, text string"))
    got = decontaminate.with_leaks(df.withColumn("leaks", F.lit("old")), spark.createDataFrame([(1, "What is it? The answer is forty two exactly.")], "item_id long, text string"))
    assert set(got.columns) == {*df.columns, "leaks"} and sorted((r.doc_id, len(r.leaks)) for r in got.collect()) == [(1, 1), (2, 0), (2, 0)]


def test_op8_roles_long_texts_and_clashes(spark):
    long = "<|im_end|>~é\n" * 20_000
    turns = [(1, 0, "tool\nx", "body"), (1, 1, "<~n", "y"), (1, 2, "assistant", long), (2, 0, "a<\n|b~", ""), (2, 0, "a<\n|b~", "")]
    df = clashing(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).withColumn("parts", chat_format.text_parts(F.col("text")))
    got = {r.conv_id: r for r in chat_format.parse_chats(chat_format.format_chats(df)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r, x) for c, _, r, x in turns if c == 1] and got[1].loss_texts == [long]
    assert [(t.role, t.text) for t in got[2].turns] == [("a<\n|b~", "")] * 2


def test_op9_very_long_text(spark):
    from tokenizers import Tokenizer

    long = "word " * 60_000 + "übermäßig" * 500
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df = clashing(spark.createDataFrame([(6, long), (6, long), (7, None)], "doc_id long, text string"))
    n = len(t.encode(long, add_special_tokens=False).ids)
    assert sorted((r.doc_id, r.n_tokens, r.n_bytes) for r in token_counts.token_counts(df).collect()) == [(6, n, len(long.encode()))] * 2 + [(7, 0, 0)]


def test_op10_space_long_texts_and_clashes(spark):
    line = "this line has six words or more"
    many = "\n".join(f"line {i} of a very long text here" for i in range(20_000))
    data = [(1, line + "\r\n" + many), (2, "own\n\t" + line + " \x0b"), (3, many + "\nmy own last line that stays here"), (4, line), (4, line), (5, None)]
    df = clashing(spark.createDataFrame(data, "doc_id long, text string"))
    over = line_dedup.line_overlaps(df)
    got = {r.doc_id: r for r in over.collect()}
    assert got[2].deleted_lines == [1] and got[3].n_deleted == 20_000 and got[4].deleted_lines == [0] and got[1].n_deleted == got[5].n_deleted == 0
    out = line_dedup.delete_lines(df, over)
    assert out.columns == df.columns and sorted((r.doc_id, r.text) for r in out.where("doc_id IN (2, 3, 4, 5)").collect() if r.text is not None) == [(2, "own"), (3, "my own last line that stays here"), (4, ""), (4, "")]


def test_op4_clashes_and_hot_groups(spark):
    df = clashing(spark.createDataFrame([(None, "a b c", None)] * 3000 + [(i, "w " * (i % 7), "s") for i in range(200)], "doc_id long, text string, source string"))
    got = mixing.mix_sources(df).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).collect()
    assert all(abs(r.n - r.t) <= 10 for r in got)


@pytest.mark.parametrize("role,text", [("a", ""), ("~", "<|"), ("\n", "\n\n"), ("<~n", "~n"), ("<", "|")])
def test_op8_escapes_are_reversible(spark, role, text):
    df = spark.createDataFrame([(role, text)], "r string, t string").select(chat_format.unescape_role(chat_format.escape_role(F.col("r"))).alias("r"), chat_format.unescape(chat_format.escape(F.col("t"))).alias("t"), chat_format.escape_role(F.col("r")).alias("e"))
    x = df.first()
    assert (x.r, x.t) == (role, text) and "\n" not in x.e and "<|" not in x.e
    assert hashlib.sha256(x.r.encode()).digest() == hashlib.sha256(role.encode()).digest()
