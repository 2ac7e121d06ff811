"""Nearest vectors by an inverted file: rows in lists by their nearest centroid, queries meet the lists near them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .search import cosine_knn

#: Rows that the centroids are fitted on, those with the smallest hashes of their ids; all rows are put in lists.
FIT_ROWS = 20_000
#: Rows of a list, and queries of a list, that meet in one task; queries whose exact result tells how many lists to look into.
BLOCK_ROWS, BLOCK_QUERIES, FIT_QUERIES = 8_192, 1_024, 100


def _unit(embedding: Column) -> Column:
    v = embedding.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y))
    return F.when(norm > 0, F.transform(v, lambda e: e / norm))


def units(vectors: DataFrame, key: str = "vec_id") -> DataFrame:
    """key, v: vectors(vec_id, embedding) of length one. Rows without an embedding, with a zero one, or with a null in it have no direction and are left out."""
    return vectors.select(F.col("vec_id").alias(key), _unit(F.col("embedding")).alias("v")).where("v IS NOT NULL AND NOT exists(v, e -> e IS NULL OR isnan(e))")


def fit_lists(unit: DataFrame, lists: int, seed: int = 1) -> np.ndarray:
    """Centroids (lists x dimensions at most: what is broadcast has no more than that) by spherical k-means on FIT_ROWS rows. Reruns on the same rows agree."""
    part = stored(unit.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS), "fit").select(array_to_vector("v").alias("features"))
    if part.isEmpty():
        return np.zeros((0, 0))
    model = KMeans(k=max(lists, 2), seed=seed, maxIter=10, distanceMeasure="cosine").fit(part)
    return np.array(model.clusterCenters())


def in_lists(unit: DataFrame, key: str, centroids: np.ndarray, probes: int) -> DataFrame:
    """key, v, list: each row in its nearest `probes` lists."""
    shared = unit.sparkSession.sparkContext.broadcast(centroids)

    def near(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                close = np.stack(part["v"].to_numpy()) @ shared.value.T
                n = min(probes, close.shape[1])
                part["list"] = list(np.argsort(-close, axis=1, kind="stable")[:, :n].astype("int32"))
                yield part

    return unit.mapInPandas(near, f"{key} long, v array<double>, list array<int>").select(key, "v", F.posexplode("list").alias("place", "list"))


def probes_for(queries: DataFrame, vectors: DataFrame, placed: DataFrame, centroids: np.ndarray, k: int, recall: float) -> int:
    """How many lists a query has to look into for that share of its best k, by the exact result of FIT_QUERIES queries (those with the smallest hashes of their ids): the place, in the
    query's order of lists, of each list that holds one of them."""
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_QUERIES)
    exact = cosine_knn(some, vectors, k).select("query_id", "vec_id").join(placed.select("vec_id", "list"), "vec_id")
    order = in_lists(units(some, "query_id"), "query_id", centroids, len(centroids)).select("query_id", "list", "place")
    per = {r.place: r.n for r in exact.join(order, ["query_id", "list"]).groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each list
    total, upto = sum(per.values()), 0
    for place in range(len(centroids)):
        upto += per.get(place, 0)
        if upto >= recall * total:
            return place + 1
    return len(centroids)


def _dealt(rows: DataFrame, key: str, size: int, block: str) -> tuple[DataFrame, DataFrame]:
    """rows with their block in the list, and list, blocks: a list of any size is many blocks of about `size` rows."""
    n = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(f"{block}s"))
    return rows.join(n, "list").withColumn(block, F.pmod(F.xxhash64(key, F.lit(block)), F.col(f"{block}s")).cast("int")).drop(f"{block}s"), n


def bucketed_knn(queries: DataFrame, vectors: DataFrame, k: int, *, lists: int = 64, probes: int | None = None, recall: float = 0.95) -> DataFrame:
    """queries, vectors(vec_id, embedding) -> query_id, vec_id, score, rank: the best k of each query among the rows of its `probes` nearest lists, by exact cosine (to six places;
    ties to the smaller id). A query isn't its own neighbour. cosine_knn is the exact way. Without probes, as many lists are looked into as the exact result of a sample asks for
    (probes_for); how many that are is the data's doing: few of clustered vectors, more than half of random ones.

    Every row is in one list. Lists and their queries are cut into blocks, so a list that holds a third of all rows is many tasks; a block keeps its best k before anything is shuffled.
    A query with fewer than k rows in its lists gets those. Equal ids are told apart no further than by their scores. Queries without a direction have no row.
    """
    rows = stored(units(vectors), "rows")
    centroids = fit_lists(rows, lists)
    schema = "query_id long, vec_id long, score double"
    if not centroids.size:
        return rows.sparkSession.createDataFrame([], schema + ", rank int")
    lone = stored(in_lists(rows, "vec_id", centroids, 1).drop("place"), "placed")
    if probes is None:
        probes = probes_for(queries, vectors, lone, centroids, k, recall)
    placed, row_blocks = _dealt(lone, "vec_id", BLOCK_ROWS, "row_block")
    asked, _ = _dealt(stored(in_lists(units(queries, "query_id"), "query_id", centroids, probes).drop("place"), "asked"), "query_id", BLOCK_QUERIES, "query_block")
    asked = asked.join(row_blocks, "list").withColumn("row_block", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1))).drop("row_blocks")
    by = ["list", "row_block", "query_block"]
    met = asked.select(*[F.col(c).alias(c) for c in by]).distinct()  # names of its own: both sides of the cogroup come from it
    placed = placed.join(met, ["list", "row_block"])

    def best(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if q.empty or r.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        r = r.sort_values("vec_id")
        ids, asks = r["vec_id"].to_numpy(), q["query_id"].to_numpy()
        score = np.round(np.stack(q["v"].to_numpy()) @ np.stack(r["v"].to_numpy()).T, 6)
        score[asks[:, None] == ids[None, :]] = -np.inf
        at = np.argsort(-score, axis=1, kind="stable")[:, :k]
        out = pd.DataFrame({"query_id": np.repeat(asks, at.shape[1]), "vec_id": ids[at].ravel(), "score": np.take_along_axis(score, at, axis=1).ravel()})
        return out[np.isfinite(out["score"])]

    parts = asked.groupBy(*by).cogroup(placed.groupBy(*by)).applyInPandas(best, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
