"""Ranking and threshold metrics over a scored frame (label 0/1, score p).

All curve metrics first collapse the input to one row per *distinct* score
(``_pos``/``_neg`` counts; partial aggregation map-side, so a score value held
by a third of all rows is one row before the exchange).  Prefix sums over the
score order are computed without a single-partition window:

1. a range exchange on the score deals the distinct scores into partitions of about
   ``BUCKET_ROWS`` each (Spark samples the bounds; nothing else reaches the driver);
2. per-partition totals (one row per ``BUCKET_ROWS`` distinct scores) get their
   running offsets from a window over that small table and are joined back;
3. inside each partition a window adds the local prefix.

Integer counts stay exact (DECIMAL(38,0) for products), and each metric is one
final division, so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanscope.session import ensure_checkpoint_dir

LABEL, SCORE = "DefaultFlag", "PredProb"
_BIG = "decimal(38,0)"


def score_histogram(sc: DataFrame, label: str = LABEL, score: str = SCORE) -> DataFrame:
    """One row per distinct score: _p, _pos, _neg (rows with a NULL label/score are skipped)."""
    y = F.col(label).cast("int")
    return (sc.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
            .groupBy(F.col(score).cast("double").alias("_p"))
            .agg(F.sum(F.when(y == 1, 1).otherwise(0)).cast("long").alias("_pos"),
                 F.sum(F.when(y == 1, 0).otherwise(1)).cast("long").alias("_neg")))


#: Distinct scores that one within-bucket window should hold.
BUCKET_ROWS = 50_000


def cumulative(sc: DataFrame, label: str = LABEL, score: str = SCORE, buckets: int | None = None,
               materialize: bool = True) -> DataFrame:
    """Distinct-score table with prefix counts.

    Columns: _p, _pos, _neg, _pos_below, _neg_below (rows with a strictly
    smaller score), _tot_pos, _tot_neg (class totals).  With ``materialize``
    the histogram is checkpointed, so the scored input (often a model
    transform) is computed exactly once for its size, totals and ranks.  Dealt-out
    ranges are always checkpointed: totals and ranks must see the same bounds.
    """
    hist = score_histogram(sc, label, score)
    if materialize:
        ensure_checkpoint_dir(sc.sparkSession)
        hist = hist.checkpoint(eager=True)
    if buckets is None:  # follows the data: no window holds much more than BUCKET_ROWS rows
        buckets = hist.count() // BUCKET_ROWS + 1
    if buckets > 1:
        ensure_checkpoint_dir(sc.sparkSession)
        hb = hist.repartitionByRange(buckets, "_p").withColumn("_bk", F.spark_partition_id()).checkpoint(eager=True)
    else:
        hb = hist.withColumn("_bk", F.lit(0))
    tot = hb.groupBy("_bk").agg(F.sum("_pos").alias("_bpos"), F.sum("_neg").alias("_bneg"))
    before = Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = tot.select(
        "_bk",
        F.coalesce(F.sum("_bpos").over(before), F.lit(0)).alias("_pos_off"),
        F.coalesce(F.sum("_bneg").over(before), F.lit(0)).alias("_neg_off"),
        F.sum("_bpos").over(everything).alias("_tot_pos"),
        F.sum("_bneg").over(everything).alias("_tot_neg"),
    )
    within = Window.partitionBy("_bk").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return (hb.join(offsets, "_bk")
            .select("_p", "_pos", "_neg", "_tot_pos", "_tot_neg",
                    (F.col("_pos_off") + F.coalesce(F.sum("_pos").over(within), F.lit(0))).alias("_pos_below"),
                    (F.col("_neg_off") + F.coalesce(F.sum("_neg").over(within), F.lit(0))).alias("_neg_below")))


def _auc_expr() -> Column:
    num = F.sum(F.col("_pos").cast(_BIG) * (F.col("_neg_below").cast(_BIG) * 2 + F.col("_neg").cast(_BIG)))
    den = F.first("_tot_pos").cast(_BIG) * F.first("_tot_neg").cast(_BIG) * 2
    return F.try_divide(num.cast("double"), den.cast("double"))


def _tp_ge() -> Column:  # positives scored >= p
    return F.col("_tot_pos") - F.col("_pos_below")


def _fp_ge() -> Column:  # negatives scored >= p
    return F.col("_tot_neg") - F.col("_neg_below")


def _ap_expr() -> Column:
    term = F.when(F.col("_pos") > 0,
                  (F.col("_pos").cast("double") / F.col("_tot_pos").cast("double"))
                  * (_tp_ge().cast("double") / (_tp_ge() + _fp_ge()).cast("double")))
    return F.coalesce(F.sum(term), F.lit(0.0))


def roc_auc(sc: DataFrame, label: str = LABEL, score: str = SCORE, buckets: int | None = None) -> DataFrame:
    """ROC_AUC: P(score_pos > score_neg) + 0.5 P(tie) (Mann-Whitney), exact counts."""
    return cumulative(sc, label, score, buckets).agg(_auc_expr().alias("ROC_AUC"))


def average_precision(sc: DataFrame, label: str = LABEL, score: str = SCORE, buckets: int | None = None) -> DataFrame:
    """AvgPrecision: step-wise sum of (recall increment) x precision, thresholds descending."""
    return cumulative(sc, label, score, buckets).agg(_ap_expr().alias("AvgPrecision"))


def auc_and_ap(sc: DataFrame, label: str = LABEL, score: str = SCORE) -> DataFrame:
    """AUC, AP from one pass over the scored rows."""
    return cumulative(sc, label, score).agg(_auc_expr().alias("AUC"), _ap_expr().alias("AP"))


def pr_curve(sc: DataFrame, label: str = LABEL, score: str = SCORE, buckets: int | None = None) -> DataFrame:
    """Threshold, Precision, Recall: one row per distinct score plus the end point
    (Threshold NULL, Precision 1, Recall 0).  Recall is 1 when there are no positives."""
    c = cumulative(sc, label, score, buckets)
    tp, fp = _tp_ge(), _fp_ge()
    prec = F.coalesce(F.try_divide(tp.cast("double"), (tp + fp).cast("double")), F.lit(0.0))
    rec = F.when(F.col("_tot_pos") == 0, F.lit(1.0)).otherwise(F.try_divide(tp.cast("double"), F.col("_tot_pos").cast("double")))
    point = F.struct(F.col("_p").alias("Threshold"), prec.alias("Precision"), rec.alias("Recall"))
    end = F.struct(F.lit(None).cast("double").alias("Threshold"), F.lit(1.0).alias("Precision"),
                   F.lit(0.0).alias("Recall"))
    is_top = (F.col("_pos_below") + F.col("_pos") == F.col("_tot_pos")) & (F.col("_neg_below") + F.col("_neg") == F.col("_tot_neg"))
    rows = F.when(is_top, F.array(point, end)).otherwise(F.array(point))
    return c.select(F.inline(rows))


def f1_of(precision: Column, recall: Column) -> Column:
    return F.lit(2.0) * precision * recall / (precision + recall + F.lit(1e-9))


def _curve_points(c: DataFrame) -> DataFrame:
    tp, fp = _tp_ge(), _fp_ge()
    prec = F.coalesce(F.try_divide(tp.cast("double"), (tp + fp).cast("double")), F.lit(0.0))
    rec = F.when(F.col("_tot_pos") == 0, F.lit(1.0)).otherwise(
        F.try_divide(tp.cast("double"), F.col("_tot_pos").cast("double")))
    return c.select(F.col("_p").alias("Threshold"), prec.alias("Precision"), rec.alias("Recall"))


def best_f1_of(c: DataFrame) -> DataFrame:
    """Max-F1 row of a ``cumulative`` table (lowest threshold on ties); a top-1."""
    return argmax_row(_curve_points(c).withColumn("F1", f1_of(F.col("Precision"), F.col("Recall"))),
                      "F1", "Threshold")


def best_f1(sc: DataFrame, label: str = LABEL, score: str = SCORE, buckets: int | None = None) -> DataFrame:
    """Threshold, Precision, Recall, F1 of the maximum-F1 threshold (lowest threshold on ties).

    The end point (F1 = 0) only wins on an empty input, where the caller falls
    back to 0.5 (``best_threshold``).
    """
    return best_f1_of(cumulative(sc, label, score, buckets))


def best_threshold_column(sc: DataFrame, label: str = LABEL, score: str = SCORE, default: float = 0.5) -> Column:
    """The max-F1 threshold as an uncorrelated scalar subquery (0.5 on empty input)."""
    return F.coalesce(best_f1(sc, label, score).select("Threshold").scalar(), F.lit(default))


def best_threshold(sc: DataFrame, label: str = LABEL, score: str = SCORE, default: float = 0.5) -> float:
    row = best_f1(sc, label, score).first()
    return float(row["Threshold"]) if row is not None else default


def _thr(threshold: float | Column) -> Column:
    """A threshold given as a number or as a (scalar-subquery) Column."""
    return threshold if isinstance(threshold, Column) else F.lit(float(threshold))


def _counts_at(sc: DataFrame, threshold: float | Column, label: str, score: str) -> DataFrame:
    y = F.col(label).cast("int")
    pred = (F.col(score) >= _thr(threshold))
    return sc.agg(
        F.sum(F.when((y == 1) & pred, 1).otherwise(0)).cast("long").alias("tp"),
        F.sum(F.when((y == 0) & pred, 1).otherwise(0)).cast("long").alias("fp"),
        F.sum(F.when((y == 1) & ~pred, 1).otherwise(0)).cast("long").alias("fn"),
        F.sum(F.when((y == 0) & ~pred, 1).otherwise(0)).cast("long").alias("tn"),
    ).select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "tn")])


def confusion(sc: DataFrame, threshold: float | Column, label: str = LABEL, score: str = SCORE) -> DataFrame:
    """Actual, Predicted, N — all four cells, zero-filled."""
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    return _counts_at(sc, threshold, label, score).select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("Actual"), F.lit(p).alias("Predicted"), F.col(c).alias("N"))
        for a, p, c in cells])))


def _safe(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def point_metrics(sc: DataFrame, threshold: float | Column, label: str = LABEL, score: str = SCORE) -> DataFrame:
    """Precision, Recall, Accuracy at a threshold (0 on an empty denominator)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return _counts_at(sc, threshold, label, score).select(
        _safe(tp, tp + fp).alias("Precision"),
        _safe(tp, tp + fn).alias("Recall"),
        _safe(tp + tn, tp + fp + fn + tn).alias("Accuracy"),
    )


def class_report(sc: DataFrame, threshold: float | Column, label: str = LABEL, score: str = SCORE,
                 digits: int = 4) -> DataFrame:
    """Class, Precision, Recall, F1, Support (classes 0/1, accuracy, macro avg, weighted avg)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p1, r1 = _safe(tp, tp + fp), _safe(tp, tp + fn)
    p0, r0 = _safe(tn, tn + fn), _safe(tn, tn + fp)

    def f1(p: Column, r: Column) -> Column:
        return _safe(p * 2 * r, p + r)

    s1, s0 = tp + fn, tn + fp
    n = s0 + s1

    def w(a: Column, b: Column) -> Column:
        return _safe(a * s0 + b * s1, n)

    def row(name: str, p, r, f, s) -> Column:
        rnd = (lambda x: F.round(x, digits) if x is not None else F.lit(None).cast("double"))
        return F.struct(F.lit(name).alias("Class"), rnd(p).alias("Precision"), rnd(r).alias("Recall"),
                        rnd(f).alias("F1"), s.cast("long").alias("Support"))

    rows = [
        row("0", p0, r0, f1(p0, r0), s0),
        row("1", p1, r1, f1(p1, r1), s1),
        row("accuracy", None, None, _safe(tp + tn, n), n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f1(p0, r0) + f1(p1, r1)) / 2, n),
        row("weighted avg", w(p0, p1), w(r0, r1), w(f1(p0, r0), f1(p1, r1)), n),
    ]
    return _counts_at(sc, threshold, label, score).select(F.inline(F.array(*rows)))


def calibration_bin(p: Column, bins: int = 10) -> Column:
    """Uniform-bin index in [0, bins-1]: the count of inner edges strictly below p,
    with edges k * (1 / bins) as numpy's linspace(0, 1, bins + 1) computes them
    (right-closed bins; 0 lands in the first, 1.0 in the last)."""
    step = 1.0 / bins
    expr = F.lit(0)
    for k in range(1, bins):
        expr = F.when(p > F.lit(k * step), F.lit(k)).otherwise(expr)
    return expr


def calibration(sc: DataFrame, bins: int = 10, label: str = LABEL, score: str = SCORE) -> DataFrame:
    """Bin, MeanPred, FractionPos, N — empty bins are absent."""
    return (sc.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
            .groupBy(calibration_bin(F.col(score).cast("double"), bins).alias("Bin"))
            .agg(F.try_divide(F.sum(F.col(score).cast("double")), F.count(F.lit(1)).cast("double")).alias("MeanPred"),
                 F.try_divide(F.sum(F.col(label).cast("long")).cast("double"),
                              F.count(F.lit(1)).cast("double")).alias("FractionPos"),
                 F.count(F.lit(1)).alias("N"))
            .orderBy("Bin"))


def eval_summary(sc: DataFrame, threshold: float | Column | None, model: str, population: DataFrame | None = None,
                 label: str = LABEL, score: str = SCORE, buckets: int | None = None) -> DataFrame:
    """Model, ROC_AUC, AvgPrecision_PR_AUC, Precision, Recall, Accuracy, DefaultRate, TestSize, Threshold.

    One aggregate over the distinct-score table; the threshold defaults to the
    max-F1 threshold of that same table (a scalar subquery, 0.5 when empty);
    DefaultRate is the label mean of ``population`` (default: ``sc``).
    """
    c = cumulative(sc, label, score, buckets)
    if threshold is None:
        threshold = F.coalesce(best_f1_of(c).select("Threshold").scalar(), F.lit(0.5))
    t = _thr(threshold)
    tp = F.sum(F.when(F.col("_p") >= t, F.col("_pos")).otherwise(0))
    fp = F.sum(F.when(F.col("_p") >= t, F.col("_neg")).otherwise(0))
    n = F.sum(F.col("_pos") + F.col("_neg"))
    npos = F.sum("_pos")
    pop = population if population is not None else sc
    rate = pop.agg(F.try_divide(F.sum(F.col(label).cast("long")).cast("double"),
                                F.count(label).cast("double"))).scalar()
    return c.agg(
        F.lit(model).alias("Model"),
        _auc_expr().alias("ROC_AUC"),
        _ap_expr().alias("AvgPrecision_PR_AUC"),
        _safe(tp, tp + fp).alias("Precision"),
        _safe(tp, npos).alias("Recall"),
        _safe(tp + (F.sum("_neg") - fp), n).alias("Accuracy"),
        rate.alias("DefaultRate"),
        n.alias("TestSize"),
        t.alias("Threshold"),
    )


def argmax_row(curve: DataFrame, by: str, tie: str, tie_ascending: bool = True) -> DataFrame:
    """The first row maximising ``by``, ties by ``tie``: a top-1, no global sort."""
    return curve.orderBy(F.desc(by), F.asc(tie) if tie_ascending else F.desc(tie)).limit(1)
