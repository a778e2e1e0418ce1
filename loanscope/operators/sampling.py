"""Key-deterministic splits, folds and samples.

Rows are ordered by (hash(key, seed), key) within each class; a split or a
fold is a set of *cut ranks* in that order (e.g. ceil(0.2 n) for a test set).
Instead of numbering every row (a window over a whole class, or a full
shuffle and sort), the cuts are located and every row is labelled locally:

1. row counts per (class, key) - a partial aggregate, one small row per key;
2. each cut is found by walking bounded tables: counts per coarse hash range
   (4096 per class), then per fine range inside the one coarse range holding
   the cut (4096), then the keys of the one fine range holding it - every
   step reads an aggregate whose size is fixed by the range count, not by
   the data;
3. a row's segment is the number of cut tuples (hash, key) it sorts after -
   a row-local comparison with a handful of literals, so rows never shuffle.

Copies of one key (a hot key) sort together; a cut falling inside them is
resolved by the copies' row id on the checkpointed input: the copies are
counted per input partition and only the one partition holding the cut is
ordered.  With unique keys the result equals
``row_number() OVER (PARTITION BY class ORDER BY hash, key)``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanscope.functions.columns import portable_hash
from loanscope.session import ensure_checkpoint_dir

_FINE_SHIFT, _COARSE_SHIFT, _RANGES = 7, 19, 4096


def _with_order(df: DataFrame, key: str, seed: int, materialize: bool) -> DataFrame:
    x = df.withColumn("_h", portable_hash(key, seed)).withColumn("_mid", F.monotonically_increasing_id())
    if materialize:  # fixes row ids and lets the counting passes re-read instead of recompute
        ensure_checkpoint_dir(df.sparkSession)
        x = x.checkpoint(eager=True)
    return x


def _class_filter(label: str, cls) -> Column:
    return (F.col(label) == F.lit(cls)) if cls is not None else F.col(label).isNull()


def _copy_threshold(x: DataFrame, label: str, cls, key: str, kval, h: int, m: int) -> int:
    """Row id of the m-th copy (1-based, row-id order) of a key with several copies in one class."""
    copies = x.filter(_class_filter(label, cls) & (F.col("_h") == F.lit(h)) & (F.col(key) == F.lit(kval)))
    per_part = sorted((r[0], r[1]) for r in copies.groupBy(F.shiftright(F.col("_mid"), 33).alias("p"))
                      .agg(F.count(F.lit(1))).collect())
    rest = m
    for p, n in per_part:
        if rest <= n:
            w = Window.orderBy("_mid")  # the copies of one key inside one input partition
            row = (copies.filter(F.shiftright(F.col("_mid"), 33) == F.lit(p)).select("_mid")
                   .withColumn("_i", F.row_number().over(w)).filter(F.col("_i") == F.lit(rest)).first())
            return int(row["_mid"])
        rest -= n
    raise AssertionError("copy index beyond the key count")


def _after(h: int, kval, mid: int | None, key: str) -> Column:
    """Row sorts after the cut tuple (h, key[, copy row id])."""
    later = (F.col("_h") > F.lit(h)) | ((F.col("_h") == F.lit(h)) & (F.col(key) > F.lit(kval)))
    if mid is not None:
        later = later | ((F.col("_h") == F.lit(h)) & (F.col(key) == F.lit(kval)) & (F.col("_mid") > F.lit(mid)))
    return later


def _coarse() -> Column:
    return F.shiftright(F.col("_h"), _COARSE_SHIFT)


def _fine() -> Column:
    return F.shiftright(F.col("_h"), _FINE_SHIFT) % _RANGES


def _walk(totals: list[tuple[int, int]], rest: int) -> tuple[int, int]:
    """(range id holding the rest-th row, rank left inside it) over sorted (id, count)."""
    for rid, n in sorted(totals):
        if rest <= n:
            return rid, rest
        rest -= n
    raise AssertionError("cut beyond the class size")


def _locate(x: DataFrame, label: str, key: str, cuts: Callable[[int], list[int]]) -> list[list]:
    """One list per class and cut: [class, cut, None, None] for a cut at an end of
    the class, else [class, cut, coarse, rest, fine, rest, (hash, key, row id)]."""
    coarse_rows = x.groupBy(label, _coarse().alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
    coarse: dict = {}
    for r in coarse_rows:
        coarse.setdefault(r[label], []).append((r["c"], r["n"]))
    # cut -> (class, cut, coarse id, rest)
    wanted = []
    for cls, parts in coarse.items():
        n = sum(c for _, c in parts)
        for c in cuts(int(n)):
            if 0 < c < n:
                cid, rest = _walk(parts, int(c))
                wanted.append([cls, int(c), cid, rest])
            else:
                wanted.append([cls, int(c), None, None])
    located = [w for w in wanted if w[2] is not None]
    if located:
        sel = None
        for cls, _, cid, _ in located:
            cond = _class_filter(label, cls) & (_coarse() == F.lit(cid))
            sel = cond if sel is None else sel | cond
        fine_rows = (x.filter(sel).groupBy(label, _coarse().alias("c"), _fine().alias("f"))
                     .agg(F.count(F.lit(1)).alias("n")).collect())
        fine: dict = {}
        for r in fine_rows:
            fine.setdefault((r[label], r["c"]), []).append((r["f"], r["n"]))
        for w in located:
            fid, rest = _walk(fine[(w[0], w[2])], w[3])
            w += [fid, rest]
        sel = None
        for cls, _, cid, _, fid, _ in located:
            cond = _class_filter(label, cls) & (_coarse() == F.lit(cid)) & (_fine() == F.lit(fid))
            sel = cond if sel is None else sel | cond
        key_rows = x.filter(sel).groupBy(label, "_h", key).agg(F.count(F.lit(1)).alias("n")).collect()
        keys: dict = {}
        for r in key_rows:
            keys.setdefault((r[label], r["_h"] >> _COARSE_SHIFT, (r["_h"] >> _FINE_SHIFT) % _RANGES), []).append(
                (r["_h"], r[key], r["n"]))
        for w in located:
            rest = w[5]
            for h, kval, n in sorted(keys[(w[0], w[2], w[4])]):
                if rest <= n:
                    mid = None if rest >= n else _copy_threshold(x, label, w[0], key, kval, h, rest)
                    w.append((h, kval, mid))
                    break
                rest -= n
    return wanted


def segment(df: DataFrame, label: str, key: str, cuts: Callable[[int], list[int]], seed: int = 42,
            out: str = "_segment", materialize: bool = True, labels: DataFrame | None = None) -> DataFrame:
    """df + ``out``: the number of cut ranks strictly before the row's rank in
    its class (hash order); ``cuts(n_class)`` gives the sorted inclusive cut ranks.

    Three small aggregate jobs for all classes and cuts together (coarse range
    counts, fine range counts inside the selected coarse ranges, key counts
    inside the selected fine ranges) over the key and the label alone, then one
    row-local expression on the rows as they are.  ``labels`` may give the same keys
    and labels by a cheaper plan than ``df``, which is then read only once, by the caller."""
    columns = list(dict.fromkeys([label, key]))
    wanted = _locate(_with_order((df if labels is None else labels).select(*columns), key, seed, materialize), label, key, cuts)
    if any(w[2] is not None and w[-1][2] is not None for w in wanted):
        # A cut among the copies of one key: row ids tell them apart, so they must stay fixed.
        x = _with_order(df, key, seed, True)
        wanted = _locate(x, label, key, cuts)
    else:
        x = df.withColumn("_h", portable_hash(key, seed))
    per_class: dict = {}
    for w in wanted:
        cls, c = w[0], w[1]
        if w[2] is None:
            term = F.lit(1) if c <= 0 else None  # a cut at or past the end adds nothing
        else:
            h, kval, mid = w[-1]
            term = F.when(_after(h, kval, mid, key), 1).otherwise(0)
        if term is not None:
            per_class.setdefault(cls, []).append(term)
    seg = F.lit(0)
    for cls, terms in per_class.items():
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        seg = F.when(_class_filter(label, cls), total).otherwise(seg)
    return x.withColumn(out, seg.cast("int")).drop("_h", "_mid")


def stratified_split(df: DataFrame, label: str = "DefaultFlag", key: str = "LoanID", test: float = 0.2,
                     seed: int = 42, materialize: bool = True, labels: DataFrame | None = None) -> DataFrame:
    """df + IsTest (0/1): per class, the first ceil(test * n_class) rows in hash order."""
    s = segment(df, label, key, lambda n: [math.ceil(n * float(test))], seed, "_seg", materialize, labels)
    return s.withColumn("IsTest", (F.col("_seg") == 0).cast("int")).drop("_seg")


def fold_cuts(n: int, k: int) -> list[int]:
    """Inclusive end ranks of k contiguous folds; the first n % k folds hold one more row."""
    q, rem = divmod(n, k)
    return [(f + 1) * q + min(f + 1, rem) for f in range(k - 1)]


def add_folds(df: DataFrame, label: str = "DefaultFlag", key: str = "LoanID", k: int = 3,
              seed: int = 42, materialize: bool = True) -> DataFrame:
    """df + fold in [0, k): per class, k contiguous slices of the hash order (sizes differ by <= 1)."""
    return segment(df, label, key, lambda n: fold_cuts(n, k), seed + 1, "fold", materialize)


def first_in_order(df: DataFrame, key: str, n_first: int, seed: int = 42, out: str = "_first",
                   materialize: bool = True) -> DataFrame:
    """df + ``out`` (1 for the first ``n_first`` rows in hash order, else 0), no class split."""
    s = segment(df.withColumn("_all", F.lit(1)), "_all", key, lambda n: [n_first], seed, "_seg", materialize)
    return s.withColumn(out, (F.col("_seg") == 0).cast("int")).drop("_seg", "_all")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the smallest by (hash(key, seed), key, hash of the whole row):
    repeatable and partition-independent even when a key has copies.

    Planned as a top-n (each partition keeps n rows, then one merge)."""
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return (df.withColumn("_h", portable_hash(key, seed)).withColumn("_rh", row_hash)
            .orderBy("_h", key, "_rh").limit(n).drop("_h", "_rh"))
