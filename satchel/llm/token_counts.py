"""Token counts of whole texts under a public byte-level BPE vocabulary, with a whole-token shortcut."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: The public pattern that cuts text into pre-tokens before any merge (fixed value).
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Distinct merged pre-tokens that a worker remembers; beyond that it starts anew. Bounds memory, not results.
REMEMBERED = 400_000
#: Longer texts are cut into pre-tokens one at a time.
LONG = 2_000_000


@functools.cache
def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where printable, else the next from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


@functools.cache
def whole_tokens(path: str) -> tuple[Tokenizer, frozenset[str]]:
    """The library's tokenizer, and the vocabulary strings proven to encode alone as one token.

    A string is proven if it is valid UTF-8, is a single pre-token, and the merges turn it into one token.
    Bounded by the vocabulary; done once in each Python worker.
    """
    library = Tokenizer.from_file(path)
    byte_of = {c: b for b, c in byte_letters().items()}
    proven = set()
    for piece in library.get_vocab(with_added_tokens=False):
        try:
            text = bytes(byte_of[c] for c in piece).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if PRE_TOKEN.fullmatch(text) and len(PRE_TOKEN.findall(text)) == 1 and len(library.model.tokenize(piece)) == 1:
            proven.add(text)
    return library, frozenset(proven)


class _Counts(dict):
    """pre-token -> number of tokens: 1 for proven strings, otherwise by the library's merges, remembered."""

    def __init__(self, path: str):
        self.library, self.proven = whole_tokens(path)
        self.letters = byte_letters()
        super().__init__(dict.fromkeys(self.proven, 1))

    def __missing__(self, token: str) -> int:
        if len(self) > len(self.proven) + REMEMBERED:
            self.clear()
            self.update(dict.fromkeys(self.proven, 1))
        n = len(self.library.model.tokenize("".join(map(self.letters.__getitem__, token.encode()))))
        if len(token) < 64:
            self[token] = n
        return n


def count_tokens(text: str | None, counts: _Counts, special: list[str]) -> int:
    """Tokens of one text. Strings of special tokens count one each and cut the text, as the library's default has it."""
    if not text:
        return 0
    total, parts = 0, [text]
    for s in special:
        cut = [p.split(s) for p in parts]
        total += sum(len(p) - 1 for p in cut)
        parts = [x for p in cut for x in p]
    for p in parts:
        if len(p) <= LONG:
            total += sum(map(counts.__getitem__, PRE_TOKEN.findall(p)))
        else:
            total += sum(counts[m[0]] for m in PRE_TOKEN.finditer(p))
    return total


def n_tokens(text: Column, path: str) -> Column:
    """Number of tokens of a text column; null is empty. path: a byte-level BPE file of the tokenizers library, present on every executor."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = _Counts(path)
        special = [t.content for t in counts.library.get_added_tokens_decoder().values()]
        for texts in batches:
            yield pd.Series([count_tokens(t, counts, special) for t in texts], dtype="int64")

    return count(text)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None, limit: int = 512) -> DataFrame:
    """One row per input row: id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens; null ids and repeated rows are kept as they are; an empty
    table gives no rows; other columns are ignored. No shuffle; a text is counted whole, whatever its length.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(F.col(id_col).alias("__id"), F.octet_length(text).cast("long").alias("__bytes"), n_tokens(text, path).alias("__tokens"))
    return counted.select(F.col("__id").alias(id_col), F.col("__bytes").alias("n_bytes"), F.col("__tokens").alias("n_tokens"), (F.col("__tokens") > limit).alias("over_limit"))


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
