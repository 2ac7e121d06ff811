"""A cleaning pipeline of training text: each stage takes what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.llm.decontaminate import with_leaks
from satchel.llm.exact_dedup import drop_copies
from satchel.llm.jaccard_join import jaccard_groups
from satchel.llm.language_id import UNKNOWN, fit, held_out, language
from satchel.llm.mixing import mix_sources
from satchel.storage import stored


def _whole(docs: DataFrame) -> DataFrame:
    """doc (all columns, whatever their names), doc_id, text, source: so that nothing a stage adds can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "text", "source")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. The model learns from these documents.

    Texts that are null or empty, have no letter, or only letters of scripts that no document with a language has, go; without any labelled document,
    texts without a letter go. Repeated rows, ties, null ids and very long texts make no difference: each row's text decides. An empty table stays empty.
    """
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    if model is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = _whole(docs).select("doc", language(F.col("text"), model).alias("found"))
    return found.where((F.col("found.lang") != UNKNOWN) & (F.col("found.score") > 0)).select("doc.*")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id, as often as it comes; a null id stays only if no other is there. Null and empty texts
    are equal; very long texts are hashed whole; an empty table stays empty."""
    return drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id; documents without an id, and texts without words, stay. Repeated rows of the
    document that stays all stay; very long texts are sets as any other; an empty table stays empty."""
    gone = jaccard_groups(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark table. Null and empty texts hold none; every window of a very long text is looked at; an empty table stays empty."""
    found = with_leaks(_whole(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out="leaks")
    return found.where(F.size("leaks") == 0).select("doc.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often (repeats) and how many words that makes (taken); columns of these names are replaced.

    Texts without words are never worth a place, but may be drawn; rows that share an id get the most that one of them got; null ids are one id,
    null sources one source; an empty table stays empty.
    """
    mix = mix_sources(docs).groupBy(F.col("doc_id").alias("id")).agg(F.max("repeats").alias("repeats"), F.max("taken").alias("taken")).where("repeats > 0")
    rest = [F.col(f"doc.`{c}`") for c in docs.columns if c not in ("repeats", "taken")]
    return _whole(docs).select("doc", "doc_id").join(mix, F.col("doc_id").eqNullSafe(F.col("id"))).select(*rest, "repeats", "taken")


STAGES = [
    ("language", known_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontaminate", without_benchmark),
    ("mix", mixed),
]
#: Language and near-duplicate decisions aren't SQL; tests/llm/test_pipeline_brute.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
