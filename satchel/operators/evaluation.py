"""Quality of tagging and search against labels: single measures, and reports that refuse what they can't judge and gates that fail the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall_at_k(pred: DataFrame, gold: DataFrame, k: int, *by: str) -> DataFrame:
    """pred(link_id, tag, rank), gold(link_id, tag) -> share of links with a gold tag among the first k."""
    if by:  # a handful of variants, those that have any prediction; pred is gone through once
        labelled = gold.select("link_id", "tag", F.lit(1).alias("gold")).distinct()
        p = pred.join(labelled, ["link_id", "tag"], "left").groupBy(*by, "link_id").agg(F.max(((F.col("rank") <= k) & F.col("gold").isNotNull()).cast("int")).alias("hit"))
        hits = p.groupBy(*by).agg(F.sum("hit").alias("hits")).crossJoin(gold.agg(F.countDistinct("link_id").alias("links"))).where("links > 0")
        return hits.select(*by, F.round(F.col("hits") / F.col("links"), 6).alias("recall"), "links")
    p = pred.where(F.col("rank") <= k).select("link_id", "tag", F.lit(1).alias("hit"))
    per = gold.join(p, ["link_id", "tag"], "left").groupBy("link_id").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    return per.agg(F.round(F.avg("hit"), 6).alias("recall"), F.count(F.lit(1)).alias("links"))


def tag_precision_recall(pred: DataFrame, gold: DataFrame) -> DataFrame:
    p, g = pred.select("link_id", "tag", F.lit(1).alias("p")).distinct(), gold.select("link_id", "tag", F.lit(1).alias("g")).distinct()
    j = p.join(g, ["link_id", "tag"], "full_outer")
    n = lambda a, b: F.count_if(F.col("p").isNotNull() == a) if b is None else F.count_if((F.col("p").isNotNull() == a) & (F.col("g").isNotNull() == b))
    r = j.groupBy("tag").agg(n(True, True).alias("tp"), n(True, False).alias("fp"), n(False, True).alias("fn"), F.count("g").alias("gold"))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0)), 6)
    return r.withColumn("precision", rate("tp", "fp")).withColumn("recall", rate("tp", "fn"))


def per_link(scores: DataFrame, gold: DataFrame, k: int = 3, threshold: float = 1.0) -> DataFrame:
    """link_id, best (rank of its first gold tag, null if none has a score), a, b (the scores on both sides of the cut) of each labelled link, from scores before the cut."""
    w = Window.partitionBy("link_id").orderBy(F.desc("score"), F.desc("uncapped"), "tag")
    s = scores.where(F.col("score") >= threshold).withColumn("rank", F.row_number().over(w))
    labelled = gold.select("link_id", "tag", F.lit(1).alias("gold")).distinct()
    score = lambda i: F.max(F.when(F.col("rank") == i, F.col("score")))
    at = s.join(labelled, ["link_id", "tag"], "left").groupBy("link_id").agg(F.min(F.when(F.col("gold") == 1, F.col("rank"))).alias("best"), score(k).alias("a"), score(k + 1).alias("b"))  # scores are gone through once
    return gold.select("link_id").distinct().join(at, "link_id", "left")


def _anatomy(k: int) -> list[Column]:
    return [F.count_if(F.col("a") == F.col("b")).alias("tied"), F.count_if(F.col("best").isNull()).alias("zero"), F.count_if(F.col("best") > k).alias("outranked"), F.count_if(F.col("best").isNotNull()).alias("reachable"), F.count(F.lit(1)).alias("links")]


def miss_anatomy(scores: DataFrame, gold: DataFrame, k: int = 3, threshold: float = 1.0) -> DataFrame:
    """Scored before the cut: links tied at it; misses whose gold tags have no score, and misses that are outranked; the links a perfect rerank would reach."""
    return per_link(scores, gold, k, threshold).agg(*_anatomy(k))


def eval_tagging(scores: DataFrame, gold: DataFrame, names: DataFrame, facts: DataFrame, *slices: str, k: int = 3, threshold: float = 1.0) -> DataFrame:
    """scores(link_id, tag, score, uncapped) before the cut, gold(link_id, tag), names(tag) of the dictionary, facts(link_id, set, and the slices) -> set, slice, value, links, recall,
    and miss_anatomy's counts: one row for each set (slice all), and one for each value of each slice in it, all from one pass over the labelled links.

    Refuses labels that the dictionary lacks, since nothing could hit them, and a set of links none of which is labelled. A null value of a slice is a value. Links without facts are left out.
    """
    if not (odd := unknown_labels(gold, names).select("tag").distinct().limit(10)).isEmpty():
        raise ValueError(f"labels that the dictionary lacks: {sorted(str(r.tag) for r in odd.collect())}")
    own = facts.select("link_id", "set", *slices)
    labelled = own.join(gold.select("link_id").distinct(), "link_id", "left_semi")
    if bare := sorted(str(r.set) for r in own.select("set").distinct().exceptAll(labelled.select("set").distinct()).collect()):  # a handful of sets
        raise ValueError(f"sets without a label: {bare}")
    flags = per_link(scores, gold, k, threshold).join(own, "link_id")
    taken = lambda c: F.grouping(c) == 0
    name = F.coalesce(*[F.when(taken(c), c) for c in slices], F.lit("all"))
    value = F.coalesce(*[F.when(taken(c), F.col(c).cast("string")) for c in slices], F.lit(None).cast("string"))
    hit = F.coalesce((F.col("best") <= k).cast("int"), F.lit(0))
    return flags.groupingSets([["set"], *[["set", c] for c in slices]], "set", *slices).agg(name.alias("slice"), value.alias("value"), F.round(F.avg(hit), 6).alias("recall"), *_anatomy(k)).drop(*slices)


def tagging_gate(report: DataFrame, least: dict[str, float]) -> None:
    """Fails the job if a set's recall is below what is asked of it, or if the report lacks the set."""
    got = {r.set: r.recall for r in report.where("slice = 'all'").select("set", "recall").collect()}  # a row for each set
    if bad := {n: got.get(n) for n, x in least.items() if n not in got or got[n] < x}:
        raise RuntimeError(f"recall too low: {bad}")


def eval_search(results: DataFrame, answers: DataFrame, corpus: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """results of a search, answers(query_id, doc_id), corpus(doc_id) -> (hit1, mrr, reached, queries; query_id, doc_id, position of answers that aren't first). Refuses answers that the
    corpus lacks: they would look like failures of the search."""
    from .search import search_misses, search_quality

    if not (odd := answers.join(corpus.select("doc_id"), "doc_id", "left_anti").select("query_id").limit(10)).isEmpty():
        raise ValueError(f"answers that the corpus lacks, of queries {sorted(r.query_id for r in odd.collect())}")
    return search_quality(results, answers, n), search_misses(results.where(F.col("position") <= n), answers, 1)


def ablation(links: DataFrame, surfaces: DataFrame, domains: DataFrame, gold: DataFrame, variants: dict[str, list[str]], k: int = 3) -> DataFrame:
    """variant, recall, links: tagging without some of its fields (title, keywords, description, note, body, domain), by variant. Matches are found and counted once; a table of the
    variants, a handful written by hand, masks the counts of fields, then one scoring run serves all."""
    from . import tagging as T

    v = F.broadcast(links.sparkSession.createDataFrame(list(variants.items()), "variant string, off array<string>"))
    on = lambda field: ~F.array_contains("off", field)
    found = T.field_counts(T.matches(links, T.compile_surfaces(surfaces))).crossJoin(v).where(on(F.col("field")))
    hits = T.domain_tags(links, domains).join(T.small(surfaces.select("tag_id", "tag").distinct()), "tag").crossJoin(v).where(on(F.lit("domain")))
    # a variant without bodies has no match in them either, so that their lengths decide nothing there
    return recall_at_k(T.top_tags(T.count_scores(found, links, hits, "variant"), by=("variant",)), gold, k, "variant")


def unknown_labels(gold: DataFrame, names: DataFrame) -> DataFrame:
    return gold.join(names.select("tag"), "tag", "left_anti")


def unlabelled(golden: DataFrame) -> DataFrame:
    """golden(url, expected_tags) without any tag."""
    return golden.where(F.coalesce(F.size("expected_tags"), F.lit(0)) == 0)


def unknown_answers(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """queries(query, url) whose url the corpus lacks."""
    return queries.join(corpus.select("url"), "url", "left_anti")


def eval_slices(flags: DataFrame, *by: str) -> DataFrame:
    return flags.groupBy(*by).agg(F.count(F.lit(1)).alias("links"), F.round(F.avg("hit"), 6).alias("recall"))
