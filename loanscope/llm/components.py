"""Connected components: contraction inside tasks, large star and small star across them.

A round first contracts the edges that lie in one input split to a star per
component (no shuffle), then lets every node's neighbours meet at their
minimum (large star) and at their smallest smaller neighbour (small star).
Rounds are aggregations and joins on edges written to the shared folder;
nothing is collected.  A hub's minimum is a combinable aggregate, and the join
that spreads it is left to adaptive skew splitting.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanscope.llm.common import materialize, ship


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node each can reach) without the roots themselves."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[:len(u)], place[len(u):]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(new, low[a], least)
        np.minimum.at(new, low[b], least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    out = low != np.arange(len(nodes))
    return nodes[out], nodes[low[out]]


def _contract(edges: DataFrame) -> DataFrame:
    def local(batches):
        got = [(b["u"].to_numpy(), b["v"].to_numpy()) for b in batches]
        if got:
            u, v = stars(*(np.concatenate(c) for c in zip(*got)))
            yield pd.DataFrame({"u": u, "v": v})

    return edges.mapInPandas(local, "u long, v long")


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = _lowest(edges)  # u > v holds after a large star
    spread = edges.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return spread.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge to another; component
    is the smallest node it can reach."""
    now = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    now = materialize(now, "cc-edges")
    while True:
        now = materialize(_small_star(_large_star(_contract(now))), "cc-edges")
        # Done when every node points once, at a root.
        points = now.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("times"))
        if points.where("times > 1").isEmpty() and now.join(points, F.col("v") == F.col("node"), "left_semi").isEmpty():
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component")))


ship(__name__)
