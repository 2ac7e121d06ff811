import random
from collections import defaultdict

from satchel.llm import line_dedup

L = [f"line {i} has six words here" for i in range(8)]


def overlaps(spark, data):
    return {r.doc_id: r for r in line_dedup.line_overlaps(spark.createDataFrame(data, "doc_id long, text string")).collect()}


def brute(data, rare):
    """What each document loses, from all documents in memory: one holder of each open run after the other."""
    own = {i: [(tuple(t[a:b]), a, b) for a, b in line_dedup.runs([len(x.split()) for x in t])] for i, t in data}
    holders = defaultdict(list)
    for i in sorted(own):
        for key in dict.fromkeys(k for k, _, _ in own[i]):
            holders[key].append(i)
    first = lambda i, key: (min(a for k, a, _ in own[i] if k == key), max(a for k, a, _ in own[i] if k == key))
    out = {}
    for i in own:
        later = [x for x in own[i] if holders[x[0]][0] < i]
        near = [(len(holders[k]), holders[k][0]) for k, _, _ in later if len(holders[k]) <= rare]
        main, gone, turn = min(near)[1] if near else None, set(), -1
        tried = lambda k: main if main in holders[k] else holders[k][0]
        while later:
            of = defaultdict(list)
            for k, a, b in later:
                if turn < 0:
                    of[tried(k)].append((k, a, b))
                elif turn < holders[k].index(i) and holders[k][turn] != tried(k):
                    of[holders[k][turn]].append((k, a, b))
            if turn >= max(map(len, holders.values())):
                break
            for h in sorted(of):
                mine = sorted((x for x in of[h] if not set(range(x[1], x[2])) <= gone), key=lambda x: x[1:])
                theirs = sorted({(at, b - a, k) for k, a, b in mine for at in first(h, k)})
                for _, j in line_dedup.patience([x[2] for x in theirs], [x[0] for x in mine]):
                    gone |= set(range(*mine[j][1:]))
            later, turn = [x for x in later if not set(range(x[1], x[2])) <= gone], turn + 1
        out[i] = sorted(gone)
    return out


def test_op10_first_holder_repeats_or_reorders(spark):
    data = [(1, [L[0], "x", L[0], L[2], L[1]]), (2, ["own", L[0], L[1], L[2]]), (3, [L[0], "y", L[1], L[2]]), (4, ["a b c", "d e", "f g"]), (5, ["z", "d e", "q"]), (6, ["k", "a b c", "d e", "f g", "k"])]
    got = overlaps(spark, [(i, "\n".join(t)) for i, t in data])
    # document 1 has lines 1 and 2 the other way round: an alignment holds one of them, and a hash of runs would delete both
    assert got[2].n_deleted == 2 and 1 in got[2].deleted_lines and got[2].earlier_ids == [1]
    # document 3 finds the one that its first holder can't align in the next
    assert got[3].deleted_lines == [0, 2, 3] and got[3].earlier_ids == [1, 2]
    assert got[5].n_deleted == 0 and got[6].deleted_lines == [1, 2, 3]  # short lines in a row


def test_op10_brute_force(spark, monkeypatch):
    r = random.Random(6)
    pool = [*L, "a", "b c", "d e f", "", "g h i j"]
    data = [(i, [r.choice(pool) if r.random() < 0.7 else f"own{i} {k}" for k in range(r.randrange(9))]) for i in range(60)]
    data += [(60 + i, [f"own{i}", *L[i % 3 :], L[0]][:: r.choice([1, -1])]) for i in range(12)]
    for rare in (64, 5):
        monkeypatch.setattr(line_dedup, "RARE", rare)
        got = overlaps(spark, [(i, "\n".join(t)) for i, t in data])
        assert {i: x.deleted_lines for i, x in got.items()} == brute([(i, "\n".join(t).split("\n")) for i, t in data], rare)


def test_op10_all_pairs_of_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    data = [(x.doc_id, [s.strip(" \t\r\x0b\x0c") for s in (x.text or "").split("\n")]) for x in docs.collect()]
    got = {r.doc_id: r.deleted_lines for r in line_dedup.line_overlaps(docs).collect()}
    assert got == brute(data, line_dedup.RARE) and sum(map(len, got.values())) > 50


def test_op10_common_line_costs_a_row_each(spark):
    many = [f"line {k} of a long first document" for k in range(3000)]
    data = [(0, "\n".join([L[0], *many])), *((i, f"own {i}\n{L[0]}") for i in range(1, 2001))]
    got = overlaps(spark, data)
    assert all(got[i].deleted_lines == [1] and got[i].earlier_ids == [0] for i in range(1, 2001)) and got[0].n_deleted == 0
    assert line_dedup.settle([(-1, 0, 1, 5, 6, 0, 0, 0)]) == ([5], [0], [])  # what a pair is aligned by: its shared runs alone
