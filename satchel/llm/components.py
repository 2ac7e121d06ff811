"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, stored

#: Edges or vertices that a task takes at least: small tables are few files.
ROWS = 500_000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a, b) -> (id, component), for every id that occurs in an edge; component is its smallest reachable id.

    Each round sends every vertex to the smallest vertex of its neighbourhood, follows those pointers
    once, and rewrites the edges; a vertex that is no local minimum disappears, so the edges left at
    least halve in vertices. Edges are de-duplicated before each shuffle that follows; nothing is
    gathered anywhere. A hub's edges are aggregated on the map side (min), and joins on a hub are
    dealt anew by adaptive skew handling. Null ends and self loops are ignored; no edges give no rows.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct()
    e = stored(e, "edges")
    label, done = None, []
    tasks = e.count() // ROWS + 1  # what is left only gets less
    for _ in range(max_rounds):
        if e.isEmpty():
            break
        near = e.select(F.col("a").alias("v"), F.col("b").alias("w")).unionAll(e.select(F.col("b"), F.col("a")))
        hop = near.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("p"))
        up = hop.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        hop = stored(hop.join(up, "p").select("v", F.col("pp").alias("p")).coalesce(tasks), "hop")
        if label is None:
            label = hop.select(F.col("v").alias("id"), F.col("p").alias("component"))
        else:
            up = hop.select(F.col("v").alias("component"), "p")
            label = label.join(up, "component", "left").select("id", F.coalesce("p", "component").alias("component"))
        ha, hb = hop.select(F.col("v").alias("a"), F.col("p").alias("pa")), hop.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        left = e.join(ha, "a").join(hb, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        done += [e, hop]
        e = stored(left.coalesce(tasks), "edges")
    else:
        raise RuntimeError("components did not settle")
    if label is None:
        return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    label = stored(label.coalesce(tasks), "label")
    dropped(*done)
    return label
