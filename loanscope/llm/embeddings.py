"""Embedding near-dedup by a forest of random-projection trees.

Equal vectors of a label are one vector with a number of copies.  A tree
splits a node by a random projection, at the place between its quartiles where
the fewest vectors lie close to the cut; the ``SPILL`` share on either side of
it goes to both children.  A node that is one dense cluster is not split, as
its vectors are links of each other.  The split points come from a bounded
sample, every vector is indexed in every tree, and the vectors of a leaf are
compared by exact cosine in double precision, block by block.  Leaves expected
to exceed ``TASK`` vectors are dealt out as pairs of chunks of their rows.

A vector carries its leaves in all trees, so a pair that meets in several
leaves is counted only in the first of them: leaves return counts and a
spanning set of links, never all pairs, and nothing is counted twice.
``union`` of the links gives the components.

Recall: a pair is missed only if every tree separates it; the test measures
it against brute force.  Defined results: null, empty or zero vectors, those
with null or non-finite parts and those without label link with nothing and
are their own component; vectors of different lengths never link; repeated
rows count as vectors of their own; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.llm.common import materialize, ship, table
from loanscope.llm.components import components, stars

COSINE = 0.93
TREES = 8
SPILL = 0.06
LEAF = 200            # vectors a leaf should hold
SAMPLE = 20_000       # bound of the sample that places the splits
FEWEST = 16           # sample vectors below which a node is not split
BLOCK = 1_024
TASK = 4_096          # vectors of a leaf, or of either chunk of it, in one task
CLOSE = 0.3           # projections this near a cut may be parted from a neighbour
SEED = 20


def unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    top = np.abs(x).max(1, keepdims=True)
    x = x / top                       # keeps huge and tiny vectors in range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def plane(tree: int, node: int, dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, tree, node]).standard_normal(dim)


def build_tree(x: np.ndarray, tree: int, scale: float, cosine: float) -> tuple[dict, dict]:
    """({node: (below, above)}, {leaf: chunks}): vectors under ``above`` go
    left, over ``below`` right; leaves too large for a task have chunks."""
    splits, chunks, todo = {}, {}, [(1, np.arange(len(x)))]
    while todo:
        node, at = todo.pop()
        middle = x[at].sum(0)
        dense = (x[at] @ middle >= cosine * np.sqrt(middle @ middle)).mean() > 0.9
        if len(at) * scale <= LEAF or len(at) < FEWEST or dense:
            if len(at) * scale > TASK:
                chunks[node] = int(np.ceil(len(at) * scale / TASK))
            continue
        p = x[at] @ plane(tree, node, x.shape[1])
        places, ordered = np.linspace(0.25, 0.75, 21), np.sort(p)
        cuts = np.quantile(p, places)
        risk = np.searchsorted(ordered, cuts + CLOSE) - np.searchsorted(ordered, cuts - CLOSE)
        best = min(range(21), key=lambda i: (risk[i], abs(i - 10)))
        low, high = np.quantile(p, [places[best] - SPILL, places[best] + SPILL])
        splits[node] = (float(low), float(high))
        todo += [(2 * node, at[p <= high]), (2 * node + 1, at[p >= low])]
    return splits, chunks


def leaves_of(x: np.ndarray, tree: int, splits: dict) -> list[tuple[int, np.ndarray]]:
    """(leaf, rows) of one tree for the rows of ``x``."""
    out, todo = [], [(1, np.arange(len(x)))]
    while todo:
        node, at = todo.pop()
        if not len(at):
            continue
        if node not in splits:
            out.append((node, at))
            continue
        low, high = splits[node]
        p = x[at] @ plane(tree, node, x.shape[1])
        todo += [(2 * node, at[p <= high]), (2 * node + 1, at[p >= low])]
    return out


def compare_leaf(ids: np.ndarray, copies: np.ndarray, x: np.ndarray, codes: list[np.ndarray], chunk: np.ndarray,
                 here: int, across: bool, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links counted first in this leaf by row, and the spanning links of the leaf).
    ``codes``: each row's leaves, in the order in which leaves count pairs;
    ``here``: this leaf; ``across``: only pairs of rows of different chunks count."""
    n = len(ids)
    # Membership in the leaves that come before this one: rows with a common one were compared there.
    row = np.repeat(np.arange(n), [len(c) for c in codes])
    leaf = np.concatenate(codes)
    earlier = leaf < here
    _, column, times = np.unique(leaf[earlier], return_inverse=True, return_counts=True)
    member = np.zeros((n, len(times)), dtype=np.float32)
    member[row[earlier], column] = 1
    member = member[:, times > 1]
    counted, ends = np.zeros(n), []
    for a in range(0, n, BLOCK):
        for b in range(a, n, BLOCK):
            near = x[a:a + BLOCK] @ x[b:b + BLOCK].T >= cosine
            if a == b:
                near = np.triu(near, 1)
            if across:
                near &= chunk[a:a + BLOCK, None] != chunk[None, b:b + BLOCK]
            if near.any() and member.shape[1]:
                near &= (member[a:a + BLOCK] @ member[b:b + BLOCK].T) == 0
            i, j = np.nonzero(near)
            if len(i):
                counted[a:a + BLOCK] += near @ copies[b:b + BLOCK]
                counted[b:b + BLOCK] += near.T @ copies[a:a + BLOCK]
                ends.append(np.column_stack(stars(ids[i + a], ids[j + b])))
    if not ends:
        return counted.astype(np.int64), ids[:0], ids[:0]
    u, v = np.concatenate(ends).T
    return counted.astype(np.int64), *stars(u, v)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id for every row of ``vectors`` (vec_id, embedding, label)."""
    v = F.col("embedding")
    usable = (F.col("label").isNotNull() & F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
              & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
              & F.exists(v, lambda x: x != 0))
    rows = vectors.select("vec_id", F.when(usable, F.xxhash64("label", v)).alias("k1"),
                          F.when(usable, F.xxhash64(v, F.lit("second"), "label")).alias("k2"),
                          F.concat_ws("/", F.col("label").cast("string"), F.size(v).cast("string")).alias("part"), v)
    single = materialize(rows.where("k1 is not null").groupBy("k1", "k2").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"),
        F.min_by(F.struct("part", "embedding"), "vec_id").alias("v")).select("k1", "k2", "rep", "copies", "v.*"),
        "vectors")
    sizes = single.groupBy("part").count()
    total = max(1, single.count())
    bucket = F.pmod(F.xxhash64("rep", F.lit(SEED)), F.lit(1 << 20))
    picked = single.where(bucket < int(min(1.0, sample / total) * (1 << 20))).limit(2 * sample).join(
        sizes, "part").select("part", "rep", "embedding", "count").toPandas()
    forest = {}
    for part, got in picked.groupby("part"):
        got = got.sort_values("rep")
        x = unit(got["embedding"])
        forest[part] = [build_tree(x, t, got["count"].iloc[0] / len(got), cosine) for t in range(trees)]

    def index(batches):
        for batch in batches:
            for part, b in batch.groupby("part"):
                x = unit(b["embedding"])
                trunk = forest.get(part, [({}, {})] * trees)
                found = [(t, k, at) for t, (splits, _) in enumerate(trunk) for k, at in leaves_of(x, t, splits)]
                row = np.concatenate([at for *_, at in found])
                code = np.repeat([(t << 40) | k for t, k, _ in found], [len(at) for *_, at in found])
                chunks = np.repeat([trunk[t][1].get(k, 1) for t, k, _ in found], [len(at) for *_, at in found])
                order = np.argsort(row, kind="stable")
                codes = np.empty(len(b), dtype=object)
                codes[:] = np.split(code[order], np.cumsum(np.bincount(row, minlength=len(b)))[:-1])
                ids = b["rep"].to_numpy()
                for other in range(int(chunks.max())):
                    on = chunks > other
                    r, chunk = row[on], ids[row[on]] % chunks[on]
                    yield pd.DataFrame({
                        "part": part, "leaf": code[on], "codes": codes[r], "low": np.minimum(chunk, other),
                        "high": np.maximum(chunk, other), "chunk": chunk, "rep": ids[r],
                        "copies": b["copies"].to_numpy()[r], "embedding": b["embedding"].to_numpy()[r]})

    kind = vectors.schema["embedding"].dataType.simpleString()
    # Classes go by the hash of label and vector: an id may stand on several vectors.
    leaves = single.select("part", F.col("k1").alias("rep"), "copies", "embedding").mapInPandas(
        index, "part string, leaf long, codes array<long>, low long, high long, chunk long, rep long, "
               f"copies long, embedding {kind}")

    def within(b):
        b = b.sort_values("rep")
        ids = b["rep"].to_numpy()
        counted, u, v = compare_leaf(ids, b["copies"].to_numpy(), unit(b["embedding"]), list(b["codes"]), b["chunk"].to_numpy(),
                                     int(b["leaf"].iloc[0]), b["low"].iloc[0] != b["high"].iloc[0], cosine)
        has = counted > 0
        return pd.concat([pd.DataFrame({"a": ids[has], "b": ids[has], "n": counted[has]}),
                          pd.DataFrame({"a": u, "b": v, "n": 0})]).astype("int64")

    found = materialize(leaves.groupBy("part", "leaf", "low", "high").applyInPandas(
        within, "a long, b long, n long"), "links")
    degree = found.where("a = b").groupBy(F.col("a").alias("k1")).agg(F.sum("n").alias("n"))
    comp = components(found.where("a <> b")).withColumnRenamed("node", "k1")
    least = comp.join(single.select("k1", "rep"), "k1").groupBy("component").agg(F.min("rep").alias("least"))
    classes = single.select("k1", "k2", "rep", "copies").join(degree, "k1", "left").join(
        comp.join(least, "component"), "k1", "left").select(
        "k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("least", "rep").alias("component_id"))
    return rows.select("vec_id", "k1", "k2").join(classes, ["k1", "k2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", F.col("vec_id").cast("long")).alias("component_id"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings")).withColumn(
        "kept", F.col("vec_id") == F.col("component_id"))


ship(__name__)
