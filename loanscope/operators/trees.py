"""Fitted forests as node tables.

A forest is written once to the shared folder and its nodes (one row a node, the published
persistence format) are read back as a DataFrame.  Importances are an aggregate over that
table, and a forest grown without limits yields the forests with fewer trees, a smaller depth or a
least number of rows for a split: every node that would not have been split becomes a leaf
and what hangs below it leaves.  One deep fit so stands for all these settings.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanscope.session import scratch_path

#: Bytes of forest arrays that may be broadcast.
MAX_FOREST_BYTES = 1 << 30
NODE_BYTES = 64     # of one node in all arrays


def save_forest(spark: SparkSession, rf: RandomForestClassificationModel) -> str:
    """Path of the forest, written to the shared folder."""
    path = scratch_path(spark, "forest")
    rf.write().save(path)
    return path


def node_table(spark: SparkSession, path: str) -> DataFrame:
    """treeID, id, left, right (-1 at leaves), feature, threshold, gain, rows (drawn training
    rows), cover (their weight), p (weight of class 1 by cover) of a saved forest."""
    n, s = "nodeData", "nodeData.split"
    stats = F.col(f"{n}.impurityStats")
    cover = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    return spark.read.parquet(f"{path}/data").select(
        "treeID", F.col(f"{n}.id").alias("id"), F.col(f"{n}.leftChild").alias("left"), F.col(f"{n}.rightChild").alias("right"),
        F.col(f"{s}.featureIndex").alias("feature"), F.try_element_at(f"{s}.leftCategoriesOrThreshold", F.lit(1)).alias("threshold"),
        F.col(f"{n}.gain").alias("gain"), F.col(f"{n}.rawCount").alias("rows"), cover.alias("cover"),
        F.when(cover > 0, F.try_element_at(stats, F.lit(2)) / cover).otherwise(0.0).alias("p"))


def importances_of(nodes: DataFrame, features: list[str]) -> DataFrame:
    """Feature, Importance: the weighted Gini decrease of each feature's splits, normalised in
    every tree, summed over trees and normalised; 0 for a feature that splits nowhere."""
    inner = nodes.where("left >= 0").groupBy("treeID", "feature").agg(F.sum(F.col("gain") * F.col("cover")).alias("decrease"))
    tree = Window.partitionBy("treeID")
    share = inner.withColumn("share", F.try_divide("decrease", F.sum("decrease").over(tree)))
    total = share.groupBy("feature").agg(F.sum("share").alias("share"))
    names = F.array(*[F.struct(F.lit(i).alias("feature"), F.lit(c).alias("Feature_")) for i, c in enumerate(features)])
    every = nodes.sparkSession.range(1).select(F.inline(names))
    both = every.join(total, "feature", "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    return both.select(F.col("Feature_").alias("Feature"), (
        F.coalesce(F.try_divide("share", F.sum("share").over(Window.partitionBy())), F.lit(0.0))).alias("Importance"))


# ---- cutting back ----------------------------------------------------------------------------------

def _depths(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    depth, now, d = np.zeros(len(left), dtype=np.int64), np.array([0]), 0
    while len(now):
        depth[now] = d
        inner = now[left[now] >= 0]
        now, d = np.concatenate([left[inner], right[inner]]), d + 1
    return depth


def renumbered(tree: pd.DataFrame, min_rows: int, max_depth: int | None) -> pd.DataFrame:
    """Nodes that stay of one tree (treeID, id, left, right, rows) with new numbers; a node of
    fewer than ``min_rows`` rows or at ``max_depth`` is a leaf."""
    t = tree.sort_values("id")
    left, right = (t[c].to_numpy().astype(np.int64) for c in ("left", "right"))
    depth = _depths(left, right)
    split = (left >= 0) & (t["rows"].to_numpy() >= min_rows) & (depth < (max_depth if max_depth is not None else depth.max() + 1))
    stays = np.zeros(len(t), dtype=bool)
    now = np.array([0])
    while len(now):
        stays[now] = True
        inner = now[split[now]]
        now = np.concatenate([left[inner], right[inner]])
    number = np.cumsum(stays) - 1
    to = lambda child: np.where(split, number[np.maximum(child, 0)], -1)
    return pd.DataFrame({"treeID": t["treeID"].to_numpy(), "id": t["id"].to_numpy(), "new_id": number,
                         "new_left": to(left), "new_right": to(right)})[stays].astype("int32")


def cut_back(spark: SparkSession, path: str, min_rows: int = 2, max_depth: int | None = None,
             num_trees: int | None = None) -> RandomForestClassificationModel:
    """The saved forest as if grown with at least ``min_rows`` rows a split, to ``max_depth``,
    with its first ``num_trees`` trees; read back from a new saved model."""
    data = spark.read.parquet(f"{path}/data")
    trees = spark.read.parquet(f"{path}/treesMetadata")
    id_column = trees.columns[0]
    meta = json.loads("".join(r.value for r in spark.read.text(f"{path}/metadata").collect()))
    if num_trees is not None and num_trees < meta["numTrees"]:
        meta["numTrees"] = meta["paramMap"]["numTrees"] = num_trees
        data, trees = data.where(F.col("treeID") < num_trees), trees.where(F.col(id_column) < num_trees)
    shape = data.select("treeID", F.col("nodeData.id").alias("id"), F.col("nodeData.leftChild").alias("left"),
                        F.col("nodeData.rightChild").alias("right"), F.col("nodeData.rawCount").alias("rows"))

    def cut(tree: pd.DataFrame) -> pd.DataFrame:
        return renumbered(tree, min_rows, max_depth)

    stays = shape.groupBy("treeID").applyInPandas(cut, "treeID int, id int, new_id int, new_left int, new_right int")
    node, leaf = F.col("nodeData"), F.col("new_left") < 0
    none = F.struct(F.lit(-1).alias("featureIndex"), F.array().cast("array<double>").alias("leftCategoriesOrThreshold"),
                    F.lit(-1).alias("numCategories"))
    cut_nodes = data.withColumn("id", F.col("nodeData.id")).join(stays, ["treeID", "id"]).select(
        "treeID", node.withField("id", F.col("new_id")).withField("leftChild", F.col("new_left")).withField(
            "rightChild", F.col("new_right")).withField("gain", F.when(leaf, -1.0).otherwise(node["gain"])).withField(
            "split", F.when(leaf, none).otherwise(node["split"])).alias("nodeData"))
    out = scratch_path(spark, "forest-cut")
    cut_nodes.write.parquet(f"{out}/data")
    trees.write.parquet(f"{out}/treesMetadata")
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{out}/metadata")
    return RandomForestClassificationModel.load(out)


def with_forest(model: PipelineModel, rf: RandomForestClassificationModel) -> PipelineModel:
    """``model`` with its last stage replaced."""
    return PipelineModel(model.stages[:-1] + [rf])


# ---- many settings of one forest at once -----------------------------------------------------------

def tree_arrays(spark: SparkSession, path: str) -> list[dict[str, np.ndarray]]:
    """The saved forest's trees as arrays (feature -1 at leaves), for a broadcast of checked size."""
    nodes = node_table(spark, path)
    count = nodes.count()
    if count * NODE_BYTES > MAX_FOREST_BYTES:
        raise ValueError(f"the forest has {count} nodes, more than MAX_FOREST_BYTES = {MAX_FOREST_BYTES} allow")
    out = []
    for _, t in nodes.toPandas().sort_values(["treeID", "id"]).groupby("treeID", sort=True):
        left = t["left"].to_numpy().astype(np.int64)
        out.append({"feature": np.where(left < 0, -1, t["feature"].to_numpy()).astype(np.int64),
                    "threshold": np.nan_to_num(t["threshold"].to_numpy(dtype=float)), "left": left,
                    "right": t["right"].to_numpy().astype(np.int64), "cover": t["cover"].to_numpy(dtype=float),
                    "value": t["p"].to_numpy(dtype=float), "rows": t["rows"].to_numpy().astype(np.int64)})
    return out


def scores_of_settings(trees: list[dict[str, np.ndarray]], x: np.ndarray, settings: list[dict]) -> np.ndarray:
    """(rows, settings): positive probability under each setting (numTrees, maxDepth,
    minSamplesSplit, 2 if absent) of the forest.  A row walks each tree once; a setting keeps the value
    of the first node at which it would have stopped."""
    total = np.zeros((len(x), len(settings)))
    used = [min(s["numTrees"], len(trees)) for s in settings]
    for number, t in enumerate(trees[:max(used, default=0)]):
        at = np.zeros(len(x), dtype=np.int64)
        going = [np.ones(len(x), dtype=bool) if number < u else None for u in used]
        depth = 0
        while any(g is not None and g.any() for g in going):
            leaf = t["left"][at] < 0
            for k, s in enumerate(settings):
                if going[k] is not None:
                    stops = going[k] & (leaf | (depth >= s["maxDepth"]) | (t["rows"][at] < s.get("minSamplesSplit", 2)))
                    total[stops, k] += t["value"][at[stops]]
                    going[k] &= ~stops
            down = ~leaf
            f = t["feature"][at[down]]
            at[down] = np.where(x[np.flatnonzero(down), f] <= t["threshold"][at[down]], t["left"][at[down]], t["right"][at[down]])
            depth += 1
    return total / np.maximum(used, 1)


def score_settings(path: str, rows: DataFrame, features: list[str], settings: list[dict], keep: list[str]) -> DataFrame:
    """``keep`` columns and Scores (one probability a setting) of ``rows``, whose ``features``
    are the model's inputs after imputation."""
    spark = rows.sparkSession
    shipped = spark.sparkContext.broadcast(tree_arrays(spark, path))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            scores = scores_of_settings(shipped.value, b[features].to_numpy(dtype=float), settings)
            yield b[keep].assign(Scores=list(scores))

    kept = rows.select(*keep, *features)
    schema = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep) + ", Scores array<double>"
    return kept.mapInPandas(score, schema)


# Task code travels by value: executors need numpy and pandas only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
