import re
import unicodedata

import pytest

import __spark_entry__ as entry

LONG = "Readers of considerable patience occasionally discover remarkable sentences in paragraphs. "
TEXTS = [
    (1, LONG * 8),
    (2, "SponsoredSponsored is a glued advertisement text. " + LONG),
    (3, "Too short. " + LONG + "There are 1234567890 1234567890 digits in this one. Marks; {here} <and> there = too many of them."),
    (4, "no end of sentence in this line at all"),
    (5, "Uneventful afternoons # % & * + ~ ^ # % & * + ~ ^ # % are rare here. " + LONG),
    (6, ""),
]


def is_prose(s):
    kind = [unicodedata.category(x) for x in s]
    share = lambda f: sum(map(f, s, kind)) / len(s)
    return (
        25 <= len(s) <= 400
        and s[-1] in ".!?"
        and not re.search(r"([A-Za-z]{4,})\1", s)
        and share(lambda x, k: k[0] == "L") >= 0.55
        and share(lambda x, k: k == "Nd") <= 0.12
        and share(lambda x, k: k[0] in "SP" and x not in ",.'\"?!()-") <= 0.12
        and sum(x in "{}<>=;|\\()" for x in s) <= 2
    )


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", "s", len(t)) for i, t in TEXTS]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def sentences(text):
    return [s for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", text.strip()) if s]


def test_r32_every_sentence(spark, data):
    got = {r.doc_id: (r.sentences, r.prose) for r in entry.queries()["r32_prose_sentences"](spark, data).collect()}
    assert got == {i: (len(s), sum(map(is_prose, s))) for i, t in TEXTS if (s := sentences(t))}
    assert got[1] == (8, 8) and got[2] == (2, 1)
