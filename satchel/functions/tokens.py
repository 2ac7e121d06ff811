"""Columns that cut text into tokens, sentences and trigrams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Korean particles, longest first (fixed values).
PARTICLES = [
    "에서는", "에게서", "으로써", "으로서", "이라고",
    "에서", "에게", "한테", "으로", "부터", "까지", "처럼", "보다", "만큼",
    "밖에", "에는", "에도", "이나", "이란", "이라", "라고", "께서",
    "은", "는", "이", "가", "을", "를", "의", "에", "도", "만",
    "과", "와", "로", "나", "랑",
]
#: Words that carry no content (fixed values).
STOPWORDS = [
    "그리고", "그러나", "하지만", "그래서", "따라서", "또한", "그런데", "그러면", "그럼", "즉", "이것", "그것",
    "저것", "여기", "거기", "이런", "그런", "저런", "이렇게", "그렇게", "때문", "위해", "통해", "대해",
    "관해", "경우", "정도", "지금", "다음", "이번", "우리", "저희", "자신", "사람", "생각", "수도",
    "수가", "있다", "없다", "하다", "된다", "한다", "이다", "같다", "많다", "the", "a", "an",
    "and", "or", "but", "if", "then", "than", "that", "this", "these", "those", "there", "here",
    "what", "which", "who", "when", "where", "how", "is", "are", "was", "were", "be", "been",
    "being", "have", "has", "had", "do", "does", "did", "will", "would", "can", "could", "should",
    "may", "might", "must", "shall", "of", "in", "on", "at", "to", "for", "with", "by",
    "from", "as", "into", "about", "it", "its", "we", "you", "your", "our", "they", "them",
    "their", "he", "she", "his", "her", "not", "no", "so", "up", "out", "more", "most",
    "some", "any", "all", "also",
]
#: Abbreviations after which a full stop ends no sentence (fixed values).
ABBREVIATIONS = ["e.g", "i.e", "etc", "vs", "cf", "al", "fig", "no", "vol", "ch", "ref", "approx", "dr", "mr", "mrs", "ms", "jr", "sr", "st", "inc", "ltd"]
#: Korean particles that go on after a closing quote (fixed values).
QUOTE_PARTICLES = ["이라고", "이라", "라고", "라며", "라는", "이란", "하고"]
MARK = "\u001e"
_END = ".!?…。！？"
_CLOSE = r"""[\)\]\}"'»”’]"""
_LAST = sorted({p[-1] for p in PARTICLES})
_PARTICLE = "^(?!.?(?:{0})$)(.{{2,}}?)(?:{0})$".format("|".join(PARTICLES))


@F.arrow_udf(StringType())
def _nfc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for b in batches:
        yield pa.array([t and unicodedata.normalize("NFC", t) for t in b.to_pylist()], pa.string())


def nfc(c: Column) -> Column:
    """Composed form. Only for columns that may hold combining marks or Hangul letters; see `needs_nfc`."""
    return _nfc(c)


def needs_nfc(c: Column) -> Column:
    return c.rlike("[\\u0300-\\u036f\\u1100-\\u11ff]")


def composed(df: DataFrame, *cols: str) -> DataFrame:
    """df with the columns in composed form. Only rows that hold combining marks or Hangul letters meet Python."""
    loose = F.coalesce(F.greatest(F.lit(False), *[needs_nfc(F.col(c)) for c in cols]), F.lit(False))
    return df.where(~loose).unionByName(df.where(loose).withColumns({c: nfc(F.col(c)) for c in cols}))


def _without_particle(low: Column) -> Column:
    """One particle goes if two characters stay; only the longest particle is tried, so none goes if one would leave less."""
    return F.regexp_replace(low, _PARTICLE, "$1")


def normalize_token(c: Column) -> Column:
    """Edges that are neither letter nor number go, lower case, one particle goes if two characters stay; only the longest particle is tried."""
    return _without_particle(F.lower(F.regexp_replace(c, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))


def tokenize(c: Column) -> Column:
    """Normalised tokens in order. What the cut leaves has clean edges, and only texts with Hangul can have particles, so other texts meet one regexp in all."""
    raw = F.filter(F.split(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return F.when(has_hangul(c), F.transform(F.transform(raw, F.lower), lambda t: F.when(F.right(t, F.lit(1)).isin(_LAST), _without_particle(t)).otherwise(t))).otherwise(F.transform(raw, F.lower))


def has_hangul(c: Column) -> Column:
    return c.rlike("[가-힣]")


def is_korean(title: Column, description: Column, body: Column) -> Column:
    joined = F.concat_ws(" ", title, description, body)
    ko, en = F.regexp_count(joined, F.lit("[가-힣]")), F.regexp_count(joined, F.lit("[A-Za-z]"))
    return F.when(ko + en > 0, ko / (ko + en) > 0.2).otherwise(False)


def trigrams(c: Column) -> Column:
    """Distinct windows of three characters in lower case that aren't all blank."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.array_distinct(F.regexp_extract_all(low, F.lit(r"(?s)(?=(...))(?![ \n\t\r]{3})."), F.lit(1)))  # looks three characters ahead, goes on by one


def split_sentences(c: Column) -> Column:
    """Sentences by rules: terminators with closers, no cut inside decimals, dots in a row, after abbreviations, initials or before
    a lower-case word or a quote's particle; a blank line, or a line's end after a terminator, always cuts."""
    text = F.regexp_replace(c, "\r\n?", "\n")
    text = F.regexp_replace(text, r"\n(?=[ \t]*\n)", MARK)
    # each pattern begins with the character that it needs, so that all other places cost one comparison; what lies before it is looked at from behind it
    text = F.regexp_replace(text, rf"\n(?<=[{_END}]{_CLOSE}{{0,8}}[ \t]{{0,8}}\n)", MARK)
    abbreviations = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    not_short = rf"(?<!(?:^|\s)(?i:{abbreviations})\.)(?<!(?:^|\s)\p{{Lu}}\.)"
    begins = r"""(?=[\p{Lu}\p{Lt}\p{Lo}\p{Lm}\p{Nd}\(\[\{"'«“‘])"""
    said = "(?!(?:" + "|".join(QUOTE_PARTICLES) + "))"
    alone = rf"(?:(?<=[!?。！？])|(?<![.][.])(?![.]){not_short})"
    text = F.regexp_replace(text, rf"([.!?。！？](?={_CLOSE}+\s){alone}{_CLOSE}+)(\s+){said}{begins}", "$1" + MARK)
    text = F.regexp_replace(text, rf"([.!?。！？](?=\s){alone})(\s+){begins}", "$1" + MARK)
    parts = F.transform(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), MARK), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def has_glued_repeat(c: Column) -> Column:
    return c.rlike(r"(?=[A-Za-z]{8})([A-Za-z]{4,})\1")


def is_prose(c: Column) -> Column:
    n = F.length(c)
    without = lambda t, p: F.regexp_replace(t, p, "")
    others = lambda t, p: F.length(t) - F.length(without(t, p))  # noqa: E731  # how many characters are of a kind
    # letters are most of a text: they go first, and the rest is counted without them
    rest = F.exists(
        F.array(without(c, r"\p{L}+")),
        lambda r: ((n - F.length(r)) / n >= 0.55)
        & (others(r, r"\p{Nd}+") / n <= 0.12)
        & (others(r, r"""[\p{S}\p{P}&&[^,.'"?!()\-]]+""") / n <= 0.12)
        & (others(r, r"[{}<>=;|\\()]+") <= 2),
    )
    return n.between(25, 400) & c.rlike(rf"[{_END}]{_CLOSE}*$") & rest & ~has_glued_repeat(c)


def content_tokens(c: Column) -> Column:
    return F.sort_array(F.array_distinct(F.filter(tokenize(c), lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))))


def containment(a: Column, b: Column) -> Column:
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)
