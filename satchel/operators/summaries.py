"""Extractive summaries by graph ranking of sentences, for a whole corpus at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from ..functions.tokens import containment, content_tokens, is_prose, split_sentences, trigrams
from ..storage import spread, stored
from .evaluation import recall_at_k

MIN_BODY, MAX_SENTENCES, DAMPING, EPSILON, ROUNDS, CANDIDATES = 200, 200, 0.85, 1e-4, 50, 10
REDUNDANT, MAX_RUNES = 0.8, 450
WIDE, TEXTS, PAIRS = 16_384, 256, 1 << 20  # tokens of a matrix; rows of texts whose edges are held at a time, and at how many edges they are handed on before
BLOCK = 512  # sentences of a text that meet as one matrix


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """df with more columns, computed once a row: a generator stands between them and what uses them, which the optimizer would else compute anew in each step of a lambda."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def sentence_array(parts: Column, most: int | None = MAX_SENTENCES) -> Column:
    """The first 200 different parts of a text (as many as most says, all if None), each with its number and its tokens."""
    different = F.array_distinct(parts)
    return F.transform(different if most is None else F.slice(different, 1, most), lambda x, i: F.struct(i.alias("i"), x.alias("sentence"), content_tokens(x).alias("tokens")))


def prose_texts(docs: DataFrame, body: str = "body_text") -> DataFrame:
    """docs with s: the prose sentences (see sentence_array) of bodies of at least 200 characters; other rows go."""
    return once(spread(docs, "id").where(F.length(body) >= MIN_BODY), s=sentence_array(F.filter(split_sentences(F.col(body)), is_prose)))


def prose_sentences(docs: DataFrame, body: str = "body_text") -> DataFrame:
    """id, i, sentence, tokens: the first 200 different prose sentences of bodies of at least 200 characters."""
    return prose_texts(docs.select("id", body), body).select("id", F.inline("s"))


def _each(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, slice]]:
    """Texts as arrays of their sentences' tokens: of each, in which sentence its tokens stand, the tokens as numbers, and where its sentences lie among all."""
    sentences = texts.flatten()
    ends, of = np.cumsum(sentences.value_lengths().to_numpy(zero_copy_only=False)), texts.value_lengths().to_numpy(zero_copy_only=False)
    tokens = sentences.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    first = begin = 0
    for n in of:
        upto = ends[first : first + n]
        end = upto[-1] if n else begin
        yield np.repeat(np.arange(n), np.diff(upto, prepend=begin)), tokens[begin:end], slice(first, first + n)
        first, begin = first + n, end


def _shared(at: np.ndarray, token: np.ndarray, n: int, k: int) -> np.ndarray:
    """How many tokens each of the first k of n sentences has in common with each of the others, or each with each if k is 0: from those that both sides have, WIDE at a time."""
    seen, many = np.unique(token, return_inverse=True, return_counts=True)[1:]
    before = np.bincount(seen[at < k], minlength=len(many))
    kept = ((before > 0) & (before < many) if k else many > 1)[seen]
    at, token = at[kept], np.unique(seen[kept], return_inverse=True)[1]
    common = np.zeros((k or n, n - k), np.float32)
    for begin in range(0, token.max(initial=-1) + 1, WIDE):
        part = (token >= begin) & (token < begin + WIDE)
        holds = np.zeros((n, min(WIDE, token.max() + 1 - begin)), np.float32)
        holds[at[part], token[part] - begin] = 1
        common += holds[: k or n] @ holds[k:].T
    return common


def _lists(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Array:
    i, j, w = (np.concatenate(x) for x in zip(*found, strict=True))
    pairs = pa.StructArray.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(w, pa.float64())], ["i", "j", "w"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x[0]) for x in found)]), pa.int32()), pairs)


@F.arrow_udf(ArrayType(StructType().add("i", IntegerType()).add("j", IntegerType()).add("w", DoubleType())))
def _edges(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Rows of _blocks: their sentences' tokens, the logarithms of the numbers of these, and how many sentences are the first block's; TEXTS of them, or those of some PAIRS edges, are held at a time."""
    for whole in batches:
        for begin in range(0, len(whole[0]), TEXTS):
            texts, logs, firsts = (x.slice(begin, TEXTS) for x in whole)
            values, found, held = logs.flatten().to_numpy(zero_copy_only=False), [], 0
            for (at, tokens, own), k in zip(_each(texts), firsts.to_pylist(), strict=True):
                log = values[own]
                long = np.bincount(at, minlength=len(log)) >= 2  # a shorter sentence is like nothing
                common = _shared(at, tokens, len(log), k) * (long[: k or None, None] & long[k:])
                i, j = np.nonzero(common if k else np.triu(common, 1))
                found.append((i, j, common[i, j].astype(float) / np.maximum(log[i] + log[j + k], 0.5)))
                held += len(i)
                if held >= PAIRS:
                    yield _lists(found)
                    found, held = [], 0
            if found:
                yield _lists(found)


def _logs() -> Column:
    return F.transform("s", lambda x: F.coalesce(F.log(F.size(x["tokens"])), F.lit(0.0)))


def _blocks(texts: DataFrame) -> DataFrame:
    """texts(id, s) -> id, a, b, tokens, logs, k: a row for each two blocks of BLOCK sentences of a text, a not after b, with the tokens of both blocks' sentences; k of them are of block a, or 0 if a is b."""
    t = texts.where("s IS NOT NULL").select("id", F.transform("s", lambda x: x["tokens"]).alias("t"), _logs().alias("l"))
    a, b, last = F.col("a"), F.col("b"), F.expr(f"cast((size(t) - 1) / {BLOCK} as int)")
    t = t.withColumn("a", F.explode(F.sequence(F.lit(0), last))).withColumn("b", F.explode(F.sequence("a", last)))
    block = lambda c, n: F.slice(c, n * BLOCK + 1, F.lit(BLOCK))
    both = lambda c: F.when(a == b, block(c, a)).otherwise(F.concat(block(c, a), block(c, b)))
    return once(t, tokens=both("t"), logs=both("l")).select("id", "a", "b", "tokens", "logs", F.when(a == b, 0).otherwise(BLOCK).alias("k"))


def sentence_edges(texts: DataFrame, long: DataFrame | None = None) -> DataFrame:
    """texts(id, s) -> id, i, j, w for i before j of one text: common tokens by the logarithms of their numbers in both, for sentences of two or more. All sentences of s meet, in
    blocks of BLOCK, so that a text of any length is rows of a bounded size; a product of matrices counts the tokens. A text is one task's work and nothing is shuffled, but for the
    texts of long, if given: their blocks are dealt over the cores."""
    rows = _blocks(texts)
    if long is not None:
        rows = rows.union(_blocks(long).repartition(rows.sparkSession.sparkContext.defaultParallelism, "id", "a", "b"))
    e = rows.select("id", "a", "b", _edges("tokens", "logs", "k").alias("e")).select("id", "a", "b", F.inline_outer("e"))
    return e.where("i IS NOT NULL").select("id", (F.col("a") * BLOCK + F.col("i")).alias("i"), (F.col("b") * BLOCK + F.col("j")).alias("j"), "w")


def _ranked(at: np.ndarray, token: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Weighted PageRank of a text's sentences, scaled to a largest score of 1: token[k] stands in sentence at[k], logs are the logarithms of their numbers of tokens."""
    n = len(logs)
    if not n:
        return logs
    seen = np.unique(token, return_inverse=True)[1]
    holds = np.zeros((n, seen.max(initial=0) + 1), np.float32)
    holds[at, seen] = 1
    long = np.bincount(at, minlength=n) >= 2
    w = np.where(long[:, None] & long[None, :], (holds @ holds.T) / np.maximum(logs[:, None] + logs[None, :], 0.5), 0.0)  # as in sentence_edges
    np.fill_diagonal(w, 0.0)
    i, j = np.nonzero(w)
    share = w[i, j] / np.bincount(i, w[i, j], n)[j]
    now, before = np.ones(n), np.full(n, 9.0)
    for _ in range(ROUNDS):
        if np.abs(now - before).max() < EPSILON:
            break
        now, before = (1 - DAMPING) + DAMPING * np.bincount(i, share * now[j], n), now
    return now / now.max()


@F.arrow_udf(ArrayType(DoubleType()))
def _scores(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Texts as arrays of their sentences' tokens, and the logarithms of the numbers of these."""
    for texts, logs in batches:
        values, out = logs.flatten().to_numpy(zero_copy_only=False), []
        of = texts.value_lengths().to_numpy(zero_copy_only=False)
        for at, tokens, own in _each(texts):
            out.append(_ranked(at, tokens, values[own]))
        offsets = np.concatenate([[0], np.cumsum(of)])
        yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(out) if out else np.empty(0), pa.float64()))


def with_centrality(texts: DataFrame) -> DataFrame:
    """texts(s, ...) with score: weighted PageRank of each sentence, scaled to a largest score of 1.

    A text's sentences are a sparse matrix in its own task: at most 200 rows, and at most ROUNDS rounds of products, which end once no rank moves by EPSILON. No round is a shuffle.
    """
    return texts.withColumn("score", _scores(F.transform("s", lambda x: x["tokens"]), _logs()))


def summarize_corpus(docs: DataFrame) -> DataFrame:
    """docs(id, description, body_text) -> id, summary: two or three central and different sentences in document order.

    The ten most central compete in rounds of maximal marginal relevance: .7 centrality less .3 of the largest
    overlap with the description or a sentence picked before; overlaps of .8 are refused, ties go to the earlier sentence. Of texts with three or four sentences
    the first two are taken. Each text is summarised in its own row, without a shuffle.
    """
    t = once(prose_texts(docs.select("id", "description", "body_text")), n=F.size("s"), about=content_tokens(F.col("description"))).where("n >= 3").select("id", "s", "n", "about")
    t = with_centrality(t)  # of all texts, few sentences or many, so that each text is cut once
    order = F.array_sort(F.transform("s", lambda x: F.struct((-F.get("score", x["i"])).alias("a"), x["i"].alias("i"), F.get("score", x["i"]).alias("score"))))
    central = F.transform(F.slice(order, 1, CANDIDATES), lambda x: F.struct(x["i"].alias("i"), x["score"].alias("score")))
    first = F.transform(F.array(F.lit(0), F.lit(1)), lambda i: F.struct(i.alias("i"), F.lit(1.0).alias("score")))
    g = once(t, best=F.when(F.col("n") >= 5, central).otherwise(first)).drop("score")
    of = lambda x: F.get("s", x["i"])
    candidate = lambda x: F.struct(x["i"].alias("i"), of(x)["sentence"].alias("sentence"), of(x)["tokens"].alias("tokens"), x["score"].alias("score"), containment(of(x)["tokens"], F.col("about")).alias("known"))
    g = once(g, c=F.array_sort(F.transform("best", candidate))).drop("s", "best")
    k = F.when(F.col("n") >= 8, 3).otherwise(2)
    none = F.filter("c", lambda x: F.lit(False))

    def pick(picked, _):
        overlap = lambda x: F.coalesce(F.array_max(F.transform(picked, lambda p: containment(x["tokens"], p["tokens"]))), F.lit(0.0))
        free = F.filter("c", lambda x: ~F.exists(picked, lambda p: p["i"] == x["i"]))
        free = F.filter(F.transform(free, lambda x: F.struct(overlap(x).alias("o"), x.alias("x"))), lambda y: (y["o"] < REDUNDANT) | (F.col("n") < 5))
        mmr = F.transform(free, lambda y: F.struct((-F.round(0.7 * y["x"]["score"] - 0.3 * F.greatest(y["x"]["known"], y["o"]), 9)).alias("a"), y["x"]["i"].alias("i"), y["x"].alias("x")))
        best = F.transform(F.filter(F.array(F.array_min(mmr)), lambda y: y.isNotNull()), lambda y: y["x"])
        return F.when(F.size(picked) < k, F.concat(picked, best)).otherwise(picked)

    g = once(g, picked=F.array_sort(F.aggregate(F.array(F.lit(1), F.lit(2), F.lit(3)), none, pick)))
    joined = F.aggregate("picked", F.lit(""), lambda t, x: F.when(t == "", x["sentence"]).when(F.length(t) + 1 + F.length(x["sentence"]) <= MAX_RUNES, F.concat(t, F.lit(" "), x["sentence"])).otherwise(t))
    g = once(g.select("id", "about", "picked"), summary=joined)
    return g.select("id", F.when(containment(content_tokens(F.col("summary")), F.col("about")) >= REDUNDANT, "").otherwise(F.col("summary")).alias("summary"))


def lead_n(docs: DataFrame, n: int = 3) -> DataFrame:
    return prose_texts(docs.select("id", "body_text")).where(F.size("s") > 0).select("id", F.array_join(F.transform(F.slice("s", 1, n), lambda x: x["sentence"]), " ").alias("summary"))


def guard_breakdown(docs: DataFrame, summaries: DataFrame) -> DataFrame:
    """Why links have no summary; the reasons add up to all that lack one."""
    n = prose_texts(docs.select("id", "body_text")).select("id", F.size("s").alias("n"))
    known = docs.select("id", (F.length("body_text") < MIN_BODY).alias("thin"))  # texts don't travel
    j = known.join(n, "id", "left").join(summaries.where("summary <> ''").select("id", F.lit(True).alias("has")), "id", "left")
    reason = F.when(F.col("has"), "summary").when(F.col("thin"), "thin body").when(F.coalesce("n", F.lit(0)) < 3, "few prose").otherwise("overlap")
    return j.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("links"))


def _sized(docs: DataFrame) -> DataFrame:
    """docs with what _measured needs of the texts, so that these needn't meet the summaries: runes, about."""
    return docs.select("*", F.length("body_text").alias("runes"), content_tokens(F.col("description")).alias("about")).drop("body_text", "description")


def _measured(docs: DataFrame, column: str) -> DataFrame:
    """_sized docs with a struct in the place of a column of summaries (null or empty: none): has, overlap with the description, the largest overlap of two of its sentences, compression."""
    text = F.nullif(F.col(column), F.lit(""))
    docs = once(docs, __whole=content_tokens(text), __parts=F.transform(split_sentences(text), lambda x: content_tokens(x)))
    pairs = F.flatten(F.transform("__parts", lambda a, i: F.transform(F.slice("__parts", F.lit(1), i), lambda b: F.greatest(containment(a, b), containment(b, a)))))  # two or three sentences
    m = F.struct(
        containment(F.col("__whole"), F.col("about")).alias("overlap"),
        F.coalesce(F.array_max(pairs), F.lit(0.0)).alias("pair_overlap"),
        (F.length(text) / F.col("runes")).alias("compression"),
    )
    return docs.withColumn(column, F.when(text.isNotNull(), m)).drop("__whole", "__parts")


def _means(column: str, prefix: str = "") -> list[Column]:
    mean = lambda c: F.round(F.avg(c), 6)
    return [mean(F.col(column).isNotNull().cast("int")).alias(f"{prefix}coverage"), *[mean(F.col(f"{column}.{n}")).alias(prefix + n) for n in ("overlap", "pair_overlap", "compression")]]


def summary_quality(docs: DataFrame, summaries: DataFrame) -> DataFrame:
    """Coverage, mean overlap with the description, mean of the largest overlap of two sentences of a summary, mean compression."""
    j = _sized(docs.select("id", "description", "body_text")).join(summaries.where("summary <> ''").select("id", "summary"), "id", "left")
    return _measured(j, "summary").agg(*_means("summary"))


def eval_summary(docs: DataFrame, made: DataFrame, again: DataFrame, lead: DataFrame, *, gold: DataFrame, tags_made: DataFrame, tags_lead: DataFrame, k: int = 3) -> DataFrame:
    """docs(id, set, description, body_text), summaries(id, summary) of two runs and of first sentences, gold(link_id, tag), tags(link_id, tag, rank) found in the summaries and in the
    first sentences -> a row for each set: links, summary_quality's measures of both (those of first sentences begin with lead_), determinism, and tag_recall and lead_tag_recall of
    the compared links, for which both have tags. One pass over the texts, and one aggregation of them. A set without a compared link has null recalls."""
    d = _sized(docs.select("id", "set", "description", "body_text"))
    text = lambda df, n: df.groupBy("id").agg(F.max("summary").alias(n))  # noqa: E731  # an id has one
    for df, n in ((made, "made"), (again, "again"), (lead, "lead")):
        d = d.join(text(df, n), "id", "left")
    d = d.withColumn("same", F.col("made").eqNullSafe(F.col("again")).cast("int")).drop("again")
    hit = lambda p, n: p.where(F.col("rank") <= k).join(gold.select("link_id", "tag").distinct().withColumn("g", F.lit(1)), ["link_id", "tag"], "left").groupBy(F.col("link_id").alias("id")).agg(F.max(F.coalesce("g", F.lit(0))).alias(n))
    compared = hit(tags_made, "hit").join(hit(tags_lead, "lead_hit"), "id").join(gold.select(F.col("link_id").alias("id")).distinct(), "id", "left_semi")
    d = d.join(compared, "id", "left")
    recall = lambda n: F.round(F.avg(n), 6)
    return _measured(_measured(d, "made"), "lead").groupBy("set").agg(F.count(F.lit(1)).alias("links"), *_means("made"), *_means("lead", "lead_"), F.round(F.avg("same"), 6).alias("determinism"), F.count("hit").alias("compared"), recall("hit").alias("tag_recall"), recall("lead_hit").alias("lead_tag_recall"))


def summary_check(report: DataFrame, name: str, slack: float = 0.02) -> None:
    """Fails the job unless, in eval_summary's set of that name, summaries overlap less with the descriptions than first sentences do, keep the tags but for slack, and are the same in each run."""
    r = report.where(F.col("set") == name).first()
    if r is None:
        raise RuntimeError(f"no set {name} to judge by")
    bad = []
    if r.overlap is None or r.lead_overlap is None or not r.overlap < r.lead_overlap:
        bad.append(f"overlap {r.overlap}, of first sentences {r.lead_overlap}")
    if r.tag_recall is None or r.tag_recall < r.lead_tag_recall - slack:
        bad.append(f"tag recall {r.tag_recall}, of first sentences {r.lead_tag_recall}")
    if r.determinism != 1.0:
        bad.append(f"determinism {r.determinism}")
    if bad:
        raise RuntimeError(f"summaries of {name}: " + "; ".join(bad))


def determinism(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of links whose summary is the same in two runs."""
    j = a.select("id", F.col("summary").alias("x")).join(b.select("id", F.col("summary").alias("y")), "id", "full_outer")
    return j.agg(F.round(F.avg(F.col("x").eqNullSafe(F.col("y")).cast("int")), 6).alias("determinism"))


def common_tag_recall(gold: DataFrame, *predicted: DataFrame) -> DataFrame:
    """variant, recall, links: of the links that every prediction (link_id, tag, rank; made from summaries, from first sentences) has tags for, how many get a gold tag."""
    common = gold.select("link_id").distinct()
    for p in predicted:
        common = common.join(p.select("link_id").distinct(), "link_id", "left_semi")
    g = gold.join(common, "link_id", "left_semi")
    out = [recall_at_k(p, g, 3).withColumn("variant", F.lit(i)) for i, p in enumerate(predicted)]
    return reduce(lambda x, y: x.unionByName(y), out).select("variant", "recall", "links")


def summary_gate(quality: DataFrame, lead: DataFrame, tag_recall: float, lead_recall: float, same: float) -> DataFrame:
    """Whether summaries may replace first sentences: less overlap with the description, tag recall within .02, the same summaries each run."""
    j = quality.select(F.col("overlap").alias("x")).crossJoin(lead.select(F.col("overlap").alias("y")))  # one row each
    checks = j.select(F.coalesce(F.col("x") < F.col("y"), F.lit(False)).alias("overlap_ok"), F.lit(tag_recall >= lead_recall - 0.02).alias("recall_ok"), F.lit(same == 1.0).alias("determinism_ok"))
    return checks.withColumn("ok", F.expr("overlap_ok AND recall_ok AND determinism_ok"))


def gained_grams(docs: DataFrame, summary: str, *indexed: str) -> DataFrame:
    """id, gained: trigrams that only the summary has."""
    known = F.concat(*[trigrams(F.col(c)) for c in indexed])
    return docs.select("id", F.size(F.array_except(trigrams(F.col(summary)), known)).alias("gained"))


def new_gram_gain(gained: DataFrame) -> DataFrame:
    """Share of links that gain at least one trigram; the upper median, least and most of the gains above 0."""
    some = F.when(F.col("gained") > 0, F.col("gained"))
    counts = gained.groupBy("gained").agg(F.count(F.lit(1)).alias("c"))  # the texts are gone through once
    above = F.when(F.col("gained") > 0, F.col("c")).otherwise(0)
    upto, total = F.sum(above).over(Window.orderBy("gained")), F.sum(above).over(Window.partitionBy())
    ranked = counts.select("gained", "c", above.alias("above"), upto.alias("upto"), total.alias("total"))
    some = F.when(F.col("gained") > 0, F.col("gained"))
    many = lambda n: F.coalesce(F.sum(n), F.lit(0))
    return ranked.agg(many("c").alias("links"), many("above").alias("gaining"), F.min(some).alias("least"), F.max(some).alias("most"), F.min(F.when(F.col("upto") >= F.floor(F.col("total") / 2) + 1, some)).alias("median"))
