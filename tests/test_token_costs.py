"""Sentences, prose and trigrams, held against plain definitions: the same results on odd texts; sentences and trigrams for at most half the time."""

import time

import pytest
from pyspark.sql import functions as F

from satchel.functions import tokens as T

ODD = [
    "", " ", "a", "ab", "abc", "  \n\t ", "😀", "😀a", "a😀b", "ab😀😀cd 😀", "İstanbul ΣΑΣ ß", "\r\n\r\nOne.\r\n\r\nTwo!\rThree", "x.\n\n\nY. \t\nZ",
    "He said. \"Go.\" Then (he left.) Then [no.] 'Yes!' she cried. “Ok?” 그는 갔다. \"가자.\"라고 말했다. \"가자.\" 라고 말했다.",
    "Dr. Smith e.g. Mr. J. Doe met etc. Nobody came... But then.. Or. No. 5 vs. Two 3.14 is pi. lower case. Upper! 다음？ 그리고。 끝",
    "\"End.\" Dr. Who came.\nMr. X left. \nNext one)). After it.) \"Quoted\" text.»  «Here» …  Dots… More", "a\u001eb. C", "  .  A. B", ". . . A.B. C .D", "!!! ??? A?! B!? C.",
    "SponsoredSponsored is glued text that has to be seen here.", "abcabcd abcdabcd is glued text that has to be seen here, too.", "abcdabc is no glued text as it has only three letters in a row.",
    "Digits 1234567890 1234567890 are too many in this one, aren't they.", "Marks; {here} <and> there = too many of them in this one sentence.", "Symbols # % & * + ~ ^ # % & * + ~ ^ are too many here, too.", "Кириллица тоже текст, и он достаточно длинный для прозы.", "Emoji 😀 are symbols, but this one sentence has few of them 😀.",
]
END, CLOSE = ".!?…。！？", r"""[\)\]\}"'»”’]"""


def plain_sentences(c):
    text = F.regexp_replace(c, "\r\n?", "\n")
    text = F.regexp_replace(text, r"\n(?=[ \t]*\n)", T.MARK)
    text = F.regexp_replace(text, rf"(?<=[{END}]{CLOSE}{{0,8}}[ \t]{{0,8}})\n", T.MARK)
    short = "|".join(a.replace(".", r"\.") for a in T.ABBREVIATIONS)
    end = rf"(?:(?<![.])\.(?![.])(?<!(?:^|\s)(?i:{short})\.)(?<!(?:^|\s)\p{{Lu}}\.)|[!?。！？])"
    begins = r"""(?=[\p{Lu}\p{Lt}\p{Lo}\p{Lm}\p{Nd}\(\[\{"'«“‘])"""
    text = F.regexp_replace(text, rf"({end}{CLOSE}+)(\s+)(?!(?:{'|'.join(T.QUOTE_PARTICLES)})){begins}", "$1" + T.MARK)
    text = F.regexp_replace(text, rf"({end})(\s+){begins}", "$1" + T.MARK)
    return F.filter(F.transform(F.split(text, T.MARK), lambda s: F.trim(F.translate(s, "\n", " "))), lambda s: s != "")


def plain_prose(c):
    n = F.length(c)
    share = lambda p: F.regexp_count(c, F.lit(p)) / n
    kinds = (share(r"\p{L}") >= 0.55) & (share(r"\p{Nd}") <= 0.12) & (share(r"""[\p{S}\p{P}&&[^,.'"?!()\-]]""") <= 0.12) & (F.regexp_count(c, F.lit(r"[{}<>=;|\\()]")) <= 2)
    return n.between(25, 400) & c.rlike(rf"[{END}]{CLOSE}*$") & ~c.rlike(r"([A-Za-z]{4,})\1") & kinds


def plain_trigrams(c):
    chars = F.split(F.lower(F.coalesce(c, F.lit(""))), "")
    most = F.greatest(F.size(chars) - 2, F.lit(0))
    threes = F.zip_with(F.zip_with(F.slice(chars, F.lit(1), most), F.slice(chars, F.lit(2), most), lambda a, b: F.concat(a, b)), F.slice(chars, F.lit(3), most), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.filter(threes, lambda g: F.length(F.trim(g, F.lit(" \n\t\r"))) > 0))


PLAIN = {
    "sentences": (plain_sentences, T.split_sentences),
    "prose": (lambda c: F.transform(F.split(c, "\n"), plain_prose), lambda c: F.transform(F.split(c, "\n"), T.is_prose)),
    "trigrams": (lambda c: F.array_sort(plain_trigrams(c)), lambda c: F.sort_array(T.trigrams(c))),
}


@pytest.mark.parametrize("what", PLAIN)
def test_same_results_in_less_time(spark, sf, what):
    plain, ours = PLAIN[what]
    given = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    texts = spark.createDataFrame([(t,) for t in [*ODD, *[a + " " + b for a in ODD for b in ODD], None]], "text string").unionByName(given)
    both = texts.select("text", plain(F.col("text")).alias("a"), ours(F.col("text")).alias("b"))
    assert both.where("NOT a <=> b").collect() == []

    if what == "prose":
        return

    def took(f):
        many = given.crossJoin(spark.range(4)).coalesce(1).select(f(F.col("text")).alias("x"))
        began = time.time()
        many.write.format("noop").mode("overwrite").save()
        return time.time() - began

    took(ours), took(plain)  # compiled
    assert min(took(ours) for _ in range(2)) * 2 < min(took(plain) for _ in range(2))
