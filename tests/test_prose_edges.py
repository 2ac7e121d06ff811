import math
import re

import __spark_entry__ as entry
from satchel.functions.tokens import STOPWORDS

A, B, C, D = "Brown foxes discover remarkable gardens quietly.", "Remarkable gardens attract brown foxes yearly.", "Violet mountains overlook frozen harbours silently.", "Frozen gardens overlook violet rivers always."
TEXTS = [(1, " ".join([A, B, C, D] * 3)), (2, "\n".join([A + " " + B + " " + C, D + " " + A, "Short one. " + C + " " + D])), (3, A + " " + B)]


def test_j13_every_prose_sentence(spark, tmp_path):
    rows = [(i, t, "en", "s", len(t)) for i, t in TEXTS]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for doc, text in TEXTS:
        if len(text) < 200:
            continue  # thin body
        s = list(dict.fromkeys(x for x in re.split(r"(?<=[.])\s+", text) if 25 <= len(x) <= 400))
        t = [{w for w in re.findall(r"\w+", x.lower()) if len(w) > 1 and w not in STOPWORDS} for x in s]
        want |= {(doc, i, j, round(len(t[i] & t[j]) / max(math.log(len(t[i])) + math.log(len(t[j])), 0.5), 6)) for j in range(len(s)) for i in range(j) if t[i] & t[j]}
    got = {tuple(r) for r in entry.queries()["j13_prose_edges"](spark, str(tmp_path)).collect()}
    assert got == want and {r[0] for r in got} == {1, 2}
