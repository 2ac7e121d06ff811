"""Language identification of mixed-language text: scripts narrow the candidates, Viterbi labels spans of words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import blocks, lean, text_bytes, word_spans

#: Bytes of text that are scored at once.
SLICE = 6_000_000
#: Labelled documents that the model is fitted on, about, at most (a bounded sample, chosen by a hash of the id).
FIT_DOCS = 20_000
#: Hash buckets of byte trigrams.
GRAMS = 1 << 16
#: Nats that a change of language costs, and that a language outside a word's script loses.
SWITCH, OUTSIDE = 12.0, 50.0
UNKNOWN = "und"
#: Script class of a UTF-8 lead byte (fixed ranges of Unicode): 1 Latin, 2 Greek, 3 Cyrillic, 4 Hebrew, 5 Arabic,
#: 6 Indic and south-east Asian, 7 other three-byte, 8 kana, 9 Han, 10 Hangul, 11 beyond; 0 is no letter.
RANGES = [(0x41, 0x5A, 1), (0x61, 0x7A, 1), (0xC3, 0xCA, 1), (0xCD, 0xCF, 2), (0xD0, 0xD4, 3), (0xD6, 0xD7, 4), (0xD8, 0xDD, 5), (0xE0, 0xE0, 6), (0xE1, 0xE1, 7), (0xE3, 0xE3, 8), (0xE4, 0xE9, 9), (0xEA, 0xED, 10), (0xF0, 0xF4, 11)]
SCRIPTS = 12
_SCRIPT = np.zeros(256, np.uint8)
for _a, _b, _c in RANGES:
    _SCRIPT[_a : _b + 1] = _c
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[0x20, *range(0x09, 0x0E)]] = 0
SPANS = "array<struct<lang:string,first_word:bigint,words:bigint>>"


@dataclass
class Model:
    langs: list[str]  # sorted
    logp: np.ndarray  # [GRAMS, langs]
    allowed: np.ndarray  # [SCRIPTS, langs]: the language is a candidate for words of the script
    usual: int  # the most frequent language


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A trigram bucket for each byte, of it and its neighbours; white space and the text's ends are a word's edge."""
    c = _FOLD[data]
    left, right = np.zeros_like(c), np.zeros_like(c)
    left[1:], right[:-1] = c[:-1], c[1:]
    some = offsets[:-1] < offsets[1:]
    left[offsets[:-1][some]], right[offsets[1:][some] - 1] = 0, 0
    return ((left * np.uint32(0x9E3779B1) ^ c * np.uint32(0x85EBCA77) ^ right * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)) >> np.uint32(16)


def _word_scripts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The highest script class among a word's bytes: its letters outrank digits and marks."""
    if not len(starts):
        return np.zeros(0, np.uint8)
    kinds = np.append(_SCRIPT[data], 0)
    edges = np.column_stack([starts, ends]).ravel()
    return np.maximum.reduceat(kinds, edges)[::2]


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, id_col: str = "doc_id", fit_docs: int = FIT_DOCS) -> Model | None:
    """Fit trigram scores and script candidates on at most about `fit_docs` labelled rows; None if there is none.

    The sample is spread over eight tasks, whatever the size of the table, and each sends a table of GRAMS
    counts per language, so what reaches the driver depends on the number of languages alone.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = labelled.count()
    if not n:
        return None
    share = min(1.0, fit_docs / n)
    part = labelled.where(F.pmod(F.xxhash64(id_col, F.lit(7)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    chosen = part.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).repartition(8, F.xxhash64("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(0).to_pylist()
            for first, texts in blocks(b.column(1)):
                data, offsets = text_bytes(texts)
                g = _grams(data, offsets)
                starts, ends, at = word_spans(data, offsets)
                kinds = _word_scripts(data, starts, ends)
                for i in range(len(texts)):
                    lang = langs[first + i]
                    grams.setdefault(lang, np.zeros(GRAMS, np.int64))
                    scripts.setdefault(lang, np.zeros(SCRIPTS, np.int64))
                    grams[lang] += np.bincount(g[offsets[i] : offsets[i + 1]], minlength=GRAMS)
                    scripts[lang] += np.bincount(kinds[at[i] : at[i + 1]], minlength=SCRIPTS)
        for lang, c in grams.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([c.tobytes()]), pa.array([scripts[lang].tobytes()])], ["lang", "grams", "scripts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = lambda col: sum(np.frombuffer(x, np.int64) for x in pdf[col]).tobytes()
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "grams": [total("grams")], "scripts": [total("scripts")]})

    schema = "lang string, grams binary, scripts binary"
    rows = sorted(chosen.mapInArrow(lean(count), schema).groupBy("lang").applyInPandas(add, schema).collect(), key=lambda r: r["lang"])
    if not rows:
        return None
    counts = np.array([np.frombuffer(r["grams"], np.int64) for r in rows], float).T
    words = np.array([np.frombuffer(r["scripts"], np.int64) for r in rows], float).T
    logp = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * GRAMS))
    return Model([r["lang"] for r in rows], logp.astype(np.float32), words >= 0.001 * np.maximum(words.sum(0), 1), int(np.argmax(counts.sum(0))))


def word_scores(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores [words, langs] of every word of a column, whether it has letters, and where each text's words begin."""
    scores, lettered, at_all, done = [np.zeros((0, len(model.langs)), np.float32)], [np.zeros(0, bool)], [np.zeros(1, np.int64)], 0
    for _, part in blocks(texts):
        data, offsets = text_bytes(part)
        starts, ends, at = word_spans(data, offsets)
        kinds = _word_scripts(data, starts, ends)
        g = _grams(data, offsets)
        s = np.zeros((len(starts), len(model.langs)), np.float32)
        if len(starts):
            edges = np.column_stack([starts, ends]).ravel()
            for j in range(len(model.langs)):
                s[:, j] = np.add.reduceat(np.append(model.logp[:, j][g], np.float32(0)), edges)[::2]
        s[kinds == 0] = 0
        allowed = model.allowed[kinds]
        allowed[~allowed.any(1) | (kinds == 0)] = True
        s[~allowed] -= np.float32(OUTSIDE)
        s[~model.allowed[kinds].any(1)] = 0
        scores.append(s - s.max(1, keepdims=True) if len(s) else s)
        lettered.append((kinds > 0) & model.allowed[kinds].any(1))
        at_all.append(at[1:] + done)
        done += len(starts)
    return np.concatenate(scores), np.concatenate(lettered), np.concatenate(at_all)


def viterbi(scores: np.ndarray, at: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of every word, for many texts at once: texts step together, the longest first.

    With one penalty for any change, the best way into a language either stays or comes from the best one before.
    """
    n, path = len(scores), np.zeros(len(scores), np.int16)
    length = np.diff(at)
    order = np.argsort(-length, kind="stable")
    first, length = at[:-1][order], length[order]
    if not n:
        return path
    came, stay = np.zeros(n, np.int16), np.ones(scores.shape, bool)
    v = np.zeros((len(order), scores.shape[1]), np.float32)
    live = np.searchsorted(-length, -np.arange(length[0]), side="left")
    for t, k in enumerate(live):
        now = first[:k] + t
        if t:
            best = v[:k].argmax(1)
            moved = v[np.arange(k), best] - np.float32(switch)
            came[now] = best
            keep = v[:k] >= moved[:, None]
            stay[now] = keep
            v[:k] = np.where(keep, v[:k], moved[:, None])
        v[:k] += scores[now]
        v[:k] -= v[:k].max(1, keepdims=True)
    state = np.zeros(len(order), np.int64)
    ended = v.argmax(1)
    for t in range(len(live) - 1, -1, -1):
        k = live[t]
        newly = live[t + 1] if t + 1 < len(live) else 0
        state[newly:k] = ended[newly:k]
        now = first[:k] + t
        path[now] = state[:k]
        state[:k] = np.where(stay[now, state[:k]], state[:k], came[now])
    return path


def _identify(texts: pa.Array, model: Model | None) -> pa.Array:
    n = len(texts)
    known = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False), bool)
    if model is None:
        return pa.StructArray.from_arrays([pa.array([UNKNOWN] * n, pa.string()), pa.array([0.0] * n), pa.array([[]] * n, pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("words", pa.int64())])))], ["lang", "score", "spans"])
    scores, lettered, at = word_scores(texts, model)
    path = viterbi(scores, at)
    k = len(model.langs)
    doc = np.repeat(np.arange(n), np.diff(at))
    votes = np.bincount((doc * k + path)[lettered], minlength=n * k).reshape(n, k)
    total = votes.sum(1)
    best = np.where(total > 0, votes.argmax(1), model.usual)
    share = np.where(total > 0, votes[np.arange(n), best] / np.maximum(total, 1), 0.0)
    names = np.array([*model.langs, UNKNOWN], object)
    lang = names[np.where(known, best, k)]
    edge = np.flatnonzero(np.append(True, (np.diff(path) != 0) | (np.diff(doc) != 0))) if len(path) else np.zeros(0, np.int64)
    run = np.diff(np.append(edge, len(path)))
    spans = pa.StructArray.from_arrays([pa.array(names[path[edge]], pa.string()), pa.array(edge - at[doc[edge]]), pa.array(run)], ["lang", "first_word", "words"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[edge], np.arange(n + 1)), pa.int32()), spans)
    return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.where(known, share, 0.0)), lists], ["lang", "score", "spans"])


def language(text: Column, model: Model | None) -> Column:
    """struct<lang, score, spans> of a text column, in one pass without a shuffle.

    lang: the language of most words with letters (first by name on a tie), `und` if the text is null, empty or has no
    letter, or nothing was learned; score: its share of those words; spans: runs of words of one language, in
    order. Texts whose scripts no language was seen with get the most frequent language and score 0. A very
    long text is scored in one piece, with some 20 bytes a word at hand. Null ids, repeated rows, empty tables and other columns
    make no difference: a text alone decides, and each row gets its answer.
    """

    @F.arrow_udf(f"struct<lang:string,score:double,spans:{SPANS}>")
    @lean
    def identify(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:  # the scores, switches and paths of about SLICE bytes of text are held at once
            yield pa.concat_arrays([_identify(part, model) for _, part in blocks(t, SLICE)] or [_identify(t, model)])

    return identify(text)


def held_out(id_col: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text, mod 4, is 2 (a null id is not held out)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), language(F.col("text"), model).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
