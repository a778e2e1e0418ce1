"""Feature attributions (SHAP) as Spark jobs.

* ``linear_shap``: exact closed form for the logistic model in its margin
  space, phi_j = w_j * (z_j - mean z_j) with z the model's standardised input
  (training mean of z is 0), evaluated as column expressions.
* ``tree_shap``: path-dependent TreeSHAP (Lundberg, Erion and Lee, 2018) of a
  random forest's positive-class probability.
* ``background_shap``: interventional TreeSHAP, exact Shapley values of the game in
  which features outside a coalition come from a background row, averaged over a
  bounded background sample.

The fitted forest (already a driver-side object, bounded by numTrees x 2^(maxDepth+1)
nodes) is flattened to arrays once and broadcast; each Arrow batch of rows is explained
by itself, never gathered.  A leaf is a box over the features on its path, so a row
matters to it only by which sides of the box it satisfies, and its credit is a table
over these bit masks: the unit credits of two masks, weighted by the share of each
other mask among the background rows, or (path-dependent) by the product of the path's
cover ratios, as if the sides were independent.  The tables of the leaves below
one node are summed into one over the sides of its path and the decisions below it
(``Tables``), so a row costs a lookup per such node and feature, not a
recursion over every leaf.

All return long form: LoanID, Feature, Value, Phi (+ BaseValue for checks).
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import ImputerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.operators.models import Fitted, as_double_features
from loanscope.operators.trees import save_forest, tree_arrays

# The mapInPandas function and the TreeSHAP helpers it calls are pickled by
# value, so executors need numpy/pandas only, not this package installed.
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: ship the package with addPyFile instead
    pass


# ---- linear -----------------------------------------------------------------------------------------

def linear_shap(fitted: Fitted, df: DataFrame, key: str = "LoanID") -> DataFrame:
    """key, Feature, Value, Phi, BaseValue for the logistic pipeline
    (Imputer -> scaling of the numeric features -> VectorAssembler -> LogisticRegression).
    sum(Phi) + BaseValue equals the model margin w.z + b of each row."""
    stages = fitted.model.stages
    lr = stages[-1]
    imputer = stages[0] if isinstance(stages[0], ImputerModel) else None
    w = lr.coefficients.toArray()
    fill = {}
    if imputer is not None:
        sur = imputer.surrogateDF.first().asDict()
        fill = {c: float(sur[c]) for c in imputer.getInputCols()}
    data = as_double_features(df, fitted.features)
    cells = []
    for j, c in enumerate(fitted.features):
        x = F.col(c)
        if c in fill:
            x = F.coalesce(x, F.lit(fill[c]))
        mean, std = fitted.scale.get(c, (0.0, 1.0))
        z = (x - F.lit(float(mean))) / F.lit(float(std))
        cells.append(F.struct(F.lit(c).alias("Feature"), x.alias("Value"), (F.lit(float(w[j])) * z).alias("Phi")))
    return data.select(key, F.inline(F.array(*cells))).withColumn("BaseValue", F.lit(float(lr.intercept)))


# ---- trees ------------------------------------------------------------------------------------------

def _tree_expected(t: dict[str, np.ndarray]) -> float:
    leaves = t["feature"] < 0
    return float((t["cover"][leaves] * t["value"][leaves]).sum() / t["cover"][0])


def _tree_shap_batch(t: dict[str, np.ndarray], X: np.ndarray, phi: np.ndarray) -> None:
    """Add one tree's path-dependent SHAP values for all rows of X into phi.

    The path (features, zero fractions) depends only on the tree; the one
    fractions and path weights are per-row vectors, so every node is visited
    once per tree for the whole batch."""
    feat, thr, left, right, cover, value = (t[k] for k in ("feature", "threshold", "left", "right", "cover", "value"))
    n = X.shape[0]

    def extend(pd_, pz, po, pw, z, o, d):
        # pd_: list of features, pz: list of floats, po: (n, L) ones, pw: (n, L) weights
        L = len(pd_)
        pd_ = pd_ + [d]
        pz = pz + [z]
        po = np.concatenate([po, o[:, None]], axis=1)
        w = np.concatenate([pw, np.zeros((n, 1)) if L > 0 else np.ones((n, 1))], axis=1)
        if L == 0:
            return pd_, pz, po, w
        for i in range(L - 1, -1, -1):
            w[:, i + 1] += o * w[:, i] * (i + 1) / (L + 1)
            w[:, i] = z * w[:, i] * (L - i) / (L + 1)
        return pd_, pz, po, w

    def unwind(pd_, pz, po, pw, i):
        L = len(pd_) - 1
        o, z = po[:, i], pz[i]
        w = pw.copy()
        nxt = w[:, L].copy()
        for j in range(L - 1, -1, -1):
            nonzero = o != 0
            tmp = w[:, j].copy()
            with np.errstate(divide="ignore", invalid="ignore"):
                a = np.where(nonzero, nxt * (L + 1) / ((j + 1) * np.where(nonzero, o, 1.0)), 0.0)
            b = (w[:, j] * (L + 1) / (z * (L - j))) if z != 0 else np.zeros(n)
            w[:, j] = np.where(nonzero, a, b)
            nxt = np.where(nonzero, tmp - a * z * (L - j) / (L + 1), nxt)
        keep = [k for k in range(L + 1) if k != i]
        return [pd_[k] for k in keep], [pz[k] for k in keep], po[:, keep], w[:, :L]

    def leaf_credit(pd_, pz, po, pw, v):
        """For every path element i >= 1 at once: sum(UNWIND(path, i).w) * (o_i - z_i) * v,
        added to phi[:, d_i] (path features are unique, so the fancy-index add is exact).

        One fractions are exactly 0 or 1 here, so the unwound sum splits in two:
        o = 0 -> sum_j w_j (L+1) / (z (L-j)), a matrix product; o = 1 -> a short
        recurrence with precomputed coefficients."""
        L = len(pd_) - 1
        if L == 0:
            return
        O = po[:, 1:]                                   # (n, L), values 0 or 1
        Z = np.asarray(pz[1:], dtype=float)             # (L,)
        jj = np.arange(L)
        with np.errstate(divide="ignore", invalid="ignore"):
            c3 = np.where(Z[None, :] != 0, (L + 1) / (Z[None, :] * (L - jj)[:, None]), 0.0)  # (L, L): [j, i]
        zero_part = pw[:, :L] @ c3                       # o_i = 0
        nxt = np.repeat(pw[:, L:L + 1], L, axis=1)
        one_part = np.zeros_like(O)
        for j in range(L - 1, -1, -1):                  # o_i = 1
            tmp = nxt * ((L + 1) / (j + 1))
            one_part += tmp
            nxt = pw[:, j:j + 1] - tmp * (Z * ((L - j) / (L + 1)))
        total = np.where(O != 0, one_part, zero_part)
        phi[:, np.asarray(pd_[1:], dtype=np.int64)] += total * (O - Z) * v

    def recurse(j, pd_, pz, po, pw, z, o, d):
        pd_, pz, po, pw = extend(pd_, pz, po, pw, z, o, d)
        if feat[j] < 0:
            leaf_credit(pd_, pz, po, pw, value[j])
            return
        dj = int(feat[j])
        go_left = X[:, dj] <= thr[j]
        iz, io = 1.0, np.ones(n)
        for k in range(1, len(pd_)):
            if pd_[k] == dj:
                iz, io = pz[k], po[:, k].copy()
                pd_, pz, po, pw = unwind(pd_, pz, po, pw, k)
                break
        l, r = int(left[j]), int(right[j])
        recurse(l, pd_, pz, po, pw, iz * cover[l] / cover[j], io * go_left, dj)
        recurse(r, pd_, pz, po, pw, iz * cover[r] / cover[j], io * (~go_left), dj)

    recurse(0, [], [], np.zeros((n, 0)), np.zeros((n, 0)), 1.0, np.ones(n), -1)


# ---- tables of credits ------------------------------------------------------------------------------

#: Sides and decisions that index one table; a leaf of more sides is credited without a table.
TABLE_BITS = 8
#: Bytes of tables that a worker keeps; those of further trees are built for every batch.
TABLE_BYTES = 256 << 20

_FACT = np.cumprod(np.concatenate([[1.0], np.arange(1.0, 64.0)]))


def _pair_credits(rows: np.ndarray, others: np.ndarray, k: int) -> np.ndarray:
    """(pairs, k): credit of a leaf of value 1 to each of its k features, for pairs of a
    row's mask and a background row's that together satisfy all sides."""
    bits = np.int64(1) << np.arange(k, dtype=np.int64)
    mine, theirs = ((rows & ~others)[:, None] & bits) != 0, ((others & ~rows)[:, None] & bits) != 0
    u, v = mine.sum(1), theirs.sum(1)
    plus = np.where(u > 0, _FACT[np.maximum(u - 1, 0)] * _FACT[v] / _FACT[u + v], 0.0)
    minus = np.where(v > 0, _FACT[u] * _FACT[np.maximum(v - 1, 0)] / _FACT[u + v], 0.0)
    return mine * plus[:, None] - theirs * minus[:, None]


def unit_credits(k: int) -> np.ndarray:
    """(2^k row masks * k features, 2^k background masks): credits of a leaf of value 1."""
    every = np.arange(1 << k, dtype=np.int64)
    a, b = np.nonzero((every[:, None] | every) == (1 << k) - 1)
    out = np.zeros((1 << k, k, 1 << k))
    out[a, :, b] = _pair_credits(a.astype(np.int64), b.astype(np.int64), k)
    return out.reshape(-1, 1 << k)


def _cover_shares(ratios: np.ndarray) -> np.ndarray:
    """Share of every mask if side i holds with probability ``ratios[i]``, independently."""
    share = np.ones(1)
    for z in ratios:
        share = np.concatenate([share * (1.0 - z), share * z])
    return share


class Tables:
    """The leaves of one tree as lookup tables, against background rows ``z``, or path-dependent
    without them.  ``chunks``: (root node, features on its path, decision nodes below, features of the table,
    table); ``deep``: (features, lower ends, upper ends, value) of the leaves with too many sides."""

    def __init__(self, t: dict[str, np.ndarray], z: np.ndarray | None = None, units: dict[int, np.ndarray] | None = None):
        self.t, self.z, self.units, self.chunks, self.deep = t, z, {} if units is None else units, [], []
        inner = t["feature"] >= 0
        below = np.zeros(len(inner), dtype=np.int64)
        order, todo = [], [0]
        while todo:
            j = todo.pop()
            order.append(j)
            if inner[j]:
                todo += [int(t["left"][j]), int(t["right"][j])]
        for j in reversed(order):
            if inner[j]:
                below[j] = 1 + below[t["left"][j]] + below[t["right"][j]]
        todo = [(0, {})]        # node, {feature: (lower, upper end, cover ratio)}
        while todo:
            j, path = todo.pop()
            if len(path) + below[j] <= TABLE_BITS:
                if path or below[j]:
                    self._chunk(j, path, inner)
            elif not inner[j]:
                k = sorted(path)
                self.deep.append((np.array(k, dtype=np.int64), np.array([path[i][0] for i in k]),
                                  np.array([path[i][1] for i in k]), float(t["value"][j])))
            else:
                todo += [(c, p) for c, p, _ in self._children(j, path)]

    def _children(self, j: int, path: dict):
        """(child, its path, whether it is the left one)."""
        t = self.t
        f, cut = int(t["feature"][j]), float(t["threshold"][j])
        lo, hi, ratio = path.get(f, (-np.inf, np.inf, 1.0))
        for side in ("left", "right"):
            c = int(t[side][j])
            ends = (lo, min(hi, cut)) if side == "left" else (max(lo, cut), hi)
            share = float(t["cover"][c] / t["cover"][j]) if t["cover"][j] > 0 else 0.0
            yield c, path | {f: (*ends, ratio * share)}, side == "left"

    def _chunk(self, root: int, path: dict, inner: np.ndarray) -> None:
        at = {f: i for i, f in enumerate(path)}
        nodes, leaves, todo = [], [], [(root, path, {f: [(i, True)] for f, i in at.items()})]
        while todo:
            j, box, sides = todo.pop()
            if not inner[j]:
                leaves.append((box, sides, float(self.t["value"][j])))
                continue
            bit = len(at) + len(nodes)
            nodes.append(j)
            f = int(self.t["feature"][j])
            for c, p, left in self._children(j, box):
                todo.append((c, p, sides | {f: sides.get(f, []) + [(bit, left)]}))
        feats = sorted({f for box, _, _ in leaves for f in box})
        column = {f: i for i, f in enumerate(feats)}
        bits = len(at) + len(nodes)
        every = np.arange(1 << bits, dtype=np.int64)
        table = np.zeros((len(feats), 1 << bits))
        for box, sides, value in leaves:
            k = len(box)
            if k not in self.units:
                self.units[k] = unit_credits(k)
            mask = np.zeros(1 << bits, dtype=np.int64)
            for i, f in enumerate(box):
                held = np.ones(1 << bits, dtype=bool)
                for bit, want in sides[f]:
                    held &= ((every >> bit) & 1 == 1) == want
                mask |= held.astype(np.int64) << i
            if self.z is None:
                share = _cover_shares(np.array([r for _, _, r in box.values()]))
            else:
                names = np.array(list(box), dtype=np.int64)
                lo, hi = (np.array([b[e] for b in box.values()]) for e in (0, 1))
                share = np.bincount(_masks(self.z, names, lo, hi), minlength=1 << k) / len(self.z)
            credit = (self.units[k] @ share).reshape(1 << k, k) * value
            for i, f in enumerate(box):
                table[column[f]] += credit[mask, i]
        self.chunks.append((root, list(at), nodes, feats, table))

    @property
    def nbytes(self) -> int:
        return sum(c[-1].nbytes for c in self.chunks)

    def add(self, columns: np.ndarray, phi: np.ndarray) -> None:
        """Add the credits of the tabled leaves to ``phi``; both are (features, rows)."""
        t, wanted = self.t, {c[0]: c for c in self.chunks}
        spare = np.empty(columns.shape[1])
        todo = [(0, {})] if wanted else []
        while todo:
            j, held = todo.pop()
            if j in wanted:
                _, path, nodes, feats, table = wanted[j]
                index = np.zeros(columns.shape[1], dtype=np.uint8 if TABLE_BITS <= 8 else np.int64)
                for bit, f in enumerate(path):
                    index |= held[f].astype(index.dtype) << index.dtype.type(bit)
                for bit, n in enumerate(nodes, len(path)):
                    left = columns[t["feature"][n]] <= t["threshold"][n]
                    index |= left.astype(index.dtype) << index.dtype.type(bit)
                index = index.astype(np.intp)
                for f, credits in zip(feats, table):
                    np.take(credits, index, out=spare, mode="clip")
                    phi[f] += spare
            elif t["feature"][j] >= 0:
                f = int(t["feature"][j])
                left = columns[f] <= t["threshold"][j]
                for c, side in ((t["left"][j], left), (t["right"][j], ~left)):
                    todo.append((int(c), held | {f: side & held[f] if f in held else side}))


class Forest:
    """Path-dependent attributions of a forest; tables are built when first needed."""

    def __init__(self, trees: list[dict[str, np.ndarray]], z: np.ndarray | None = None):
        self.trees, self.z, self.units, self.tables, self.kept = trees, z, {}, {}, 0

    def table(self, i: int) -> Tables:
        got = self.tables.get(i) or Tables(self.trees[i], self.z, self.units)
        if i not in self.tables and self.kept + got.nbytes <= TABLE_BYTES:
            self.tables[i] = got
            self.kept += got.nbytes
        return got

    def values(self, x: np.ndarray) -> np.ndarray:
        """(rows, features) Shapley values of the forest's mean positive probability."""
        columns = np.ascontiguousarray(x.T)
        phi, rest = np.zeros(columns.shape), np.zeros((x.shape[0], x.shape[1] + 1))   # last column: the path root
        for i, t in enumerate(self.trees):
            tables = self.table(i)
            if tables.deep:     # the recursion credits all leaves
                _tree_shap_batch(t, x, rest)
            else:
                tables.add(columns, phi)
        return (phi.T + rest[:, :-1]) / len(self.trees)

    @property
    def base(self) -> float:
        return float(np.mean([_tree_expected(t) for t in self.trees]))


def explained(data: DataFrame, feats: list[str], key: str, sent) -> DataFrame:
    """key, Values, Phis, BaseValue of the rows of ``data`` by the broadcast trees and background
    (plain arrays: a broadcast's classes must be importable on the executors).

    Spread over the session's shuffle partitions even when the input arrives in few;
    round-robin, not by key: copies of one key must not pile into one task."""
    data = data.repartition(int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value       # kept by the worker, and the tables with it
        if "forest" not in held:
            held["forest"] = Forest(held["trees"]) if held["background"] is None else Background(held["trees"], held["background"])
        forest = held["forest"]
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in feats], axis=1)
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(feats))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v.ravel())) for v in (x, forest.values(x))]
            yield pa.RecordBatch.from_arrays([b.column(key).cast(pa.int64()), *lists, pa.array(np.full(b.num_rows, forest.base))],
                                             names=[key, "Values", "Phis", "BaseValue"])

    return data.mapInArrow(explain, f"{key} long, Values array<double>, Phis array<double>, BaseValue double")


def tree_shap(fitted: Fitted, df: DataFrame, key: str = "LoanID") -> DataFrame:
    """key, Feature, Value, Phi, BaseValue: ``tree_shap_rows`` in long form."""
    return long_form(tree_shap_rows(fitted, df, key), fitted.features, key)


def long_form(rows: DataFrame, features: list[str], key: str = "LoanID") -> DataFrame:
    """One row a feature from one row a loan."""
    cells = [F.struct(F.lit(c).alias("Feature"), F.get("Values", F.lit(i)).alias("Value"),
                      F.get("Phis", F.lit(i)).alias("Phi")) for i, c in enumerate(features)]
    return rows.select(key, "BaseValue", F.inline(F.array(*cells))).select(key, "Feature", "Value", "Phi", "BaseValue")


def model_inputs(fitted: Fitted, df: DataFrame, key: str) -> DataFrame:
    """key and the features as the model sees them: doubles, NULLs filled with training means."""
    first = fitted.model.stages[0]
    fill = {}
    if isinstance(first, ImputerModel):
        sur = first.surrogateDF.first().asDict()
        fill = {c: float(sur[c]) for c in first.getInputCols()}
    return as_double_features(df, fitted.features).select(
        key, *[F.coalesce(F.col(c), F.lit(fill[c])).alias(c) if c in fill else F.col(c) for c in fitted.features])


def tree_shap_rows(fitted: Fitted, df: DataFrame, key: str = "LoanID") -> DataFrame:
    """key, Values, Phis (arrays in feature order), BaseValue: one row per input row
    of the forest pipeline.

    Inputs are imputed exactly as the pipeline does (train means), the forest
    arrays are broadcast once (a forest too large for that is an error), and each
    Arrow batch is explained in numpy."""
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast({"trees": tree_arrays(spark, save_forest(spark, fitted.model.stages[-1])), "background": None})
    return explained(model_inputs(fitted, df, key), list(fitted.features), key, sent)


# ---- against a background ---------------------------------------------------------------------------

#: Rows of a background sample: it is broadcast, and grouped by masks in every task.
MAX_BACKGROUND = 10_000


def _masks(x: np.ndarray, feats: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Bit i: the row satisfies side i of the box (like the model, NaN goes right)."""
    v = x[:, feats]
    return (~(v <= lo) & ((v <= hi) | (hi == np.inf))) @ (np.int64(1) << np.arange(len(feats), dtype=np.int64))


def _credits(rows: np.ndarray, others: np.ndarray, share: np.ndarray, k: int) -> np.ndarray:
    """(row masks, k): credit of a leaf of value 1 to each of its k features, for the masks
    ``rows`` against background masks ``others`` with their ``share``."""
    a, b = np.nonzero((rows[:, None] | others) == (1 << k) - 1)
    each = _pair_credits(rows[a], others[b], k) * share[b][:, None]
    return np.stack([np.bincount(a, weights=each[:, i], minlength=len(rows)) for i in range(k)], axis=1)


class Background(Forest):
    """Attributions of a forest against the background rows ``z``."""

    @functools.cached_property
    def base(self) -> float:
        at = np.zeros(len(self.z))
        for t in self.trees:
            place = np.zeros(len(self.z), dtype=np.int64)
            while (down := np.flatnonzero(t["feature"][place] >= 0)).size:
                n = place[down]
                place[down] = np.where(self.z[down, t["feature"][n]] <= t["threshold"][n], t["left"][n], t["right"][n])
            at += t["value"][place]
        return float(at.mean()) / len(self.trees)

    def values(self, x: np.ndarray) -> np.ndarray:
        """(rows, features) Shapley values of the forest's mean positive probability."""
        columns = np.ascontiguousarray(x.T)
        phi = np.zeros(columns.shape)
        for i in range(len(self.trees)):
            tables = self.table(i)
            tables.add(columns, phi)
            for feats, lo, hi, value in tables.deep:
                masks, n = np.unique(_masks(self.z, feats, lo, hi), return_counts=True)
                rows, place = np.unique(_masks(x, feats, lo, hi), return_inverse=True)
                phi[feats] += value * _credits(rows, masks, n / len(self.z), len(feats)).T[:, place]
        return phi.T / len(self.trees)


def background_shap(fitted: Fitted, df: DataFrame, background: DataFrame, key: str = "LoanID") -> DataFrame:
    """key, Values, Phis (arrays in feature order), BaseValue for every row of ``df``: exact
    interventional Shapley values of the forest against the rows of ``background``, which
    must be a bounded sample.  BaseValue is the forest's mean over the background."""
    spark = df.sparkSession
    feats = list(fitted.features)
    background = model_inputs(fitted, background, key).select(feats)
    rows = background.count()
    if not 0 < rows <= MAX_BACKGROUND:
        raise ValueError(f"a background has 1 to {MAX_BACKGROUND} rows, not {rows}")
    sent = spark.sparkContext.broadcast({"trees": tree_arrays(spark, save_forest(spark, fitted.model.stages[-1])),
                                         "background": background.toPandas().to_numpy(dtype=float)})
    return explained(model_inputs(fitted, df, key), feats, key, sent)


def shap_summary(phi: DataFrame) -> DataFrame:
    """Feature, MeanAbsPhi (global importance), largest first."""
    return (phi.groupBy("Feature").agg(F.avg(F.abs("Phi")).alias("MeanAbsPhi"))
            .orderBy(F.desc("MeanAbsPhi"), "Feature"))


def summary_of_rows(rows: DataFrame, features: list[str]) -> DataFrame:
    """``shap_summary`` straight from one row a loan: one aggregate, no explode."""
    means = rows.agg(*[F.avg(F.abs(F.get("Phis", F.lit(i)))).alias(f"m{i}") for i in range(len(features))])
    cells = [F.struct(F.lit(c).alias("Feature"), F.col(f"m{i}").alias("MeanAbsPhi")) for i, c in enumerate(features)]
    return means.select(F.inline(F.array(*cells))).orderBy(F.desc("MeanAbsPhi"), "Feature")


def dependence_of_rows(rows: DataFrame, features: list[str], feature: str) -> DataFrame:
    """(Value, Phi) of one feature from one row a loan."""
    i = F.lit(features.index(feature))
    return rows.select(F.get("Values", i).alias("Value"), F.get("Phis", i).alias("Phi"))


def dependence(phi: DataFrame, feature: str, bins: int | None = None) -> DataFrame:
    """(Value, Phi) of one feature; with ``bins`` the mean Phi per value bin
    (equal-width over the observed range) for plotting large tables."""
    one = phi.filter(F.col("Feature") == feature).select("Value", "Phi")
    return binned(one, bins) if bins else one


def binned(one: DataFrame, bins: int) -> DataFrame:
    """Mean Value and Phi and number of the rows of (Value, Phi) per equal-width bin of the observed range."""
    lo_hi = one.agg(F.min("Value").alias("lo"), F.max("Value").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    placed = one.join(F.broadcast(lo_hi), how="inner").withColumn(
        "Bin", F.least(F.floor(F.try_divide(F.col("Value") - F.col("lo"), width)), F.lit(bins - 1)).cast("int"))
    return placed.groupBy("Bin").agg(F.avg("Value").alias("Value"), F.avg("Phi").alias("Phi"), F.count("*").alias("N"))
