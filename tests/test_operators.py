"""Edge cases and properties of the operators (brute force on small inputs)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanscope.functions import columns as C
from loanscope.operators import features as FT
from loanscope.operators import metrics as E
from loanscope.operators import quality as Q
from loanscope.operators import risk as R
from loanscope.operators import sampling as S
from loanscope.operators import smote as SM
from loanscope.operators import upsert as U
from loanscope.plans import catalog as CAT
from loanscope.sources.fixtures import AS_OF


def test_credit_score_band_edges(spark):
    df = spark.createDataFrame([(s,) for s in [299, 300, 600, 601, 660, 661, 720, 721, 900, 901, None]], "CreditScore int")
    got = [r[0] for r in df.select(C.credit_score_band("CreditScore")).collect()]
    assert got == [None, "Low", "Low", "Med", "Med", "High", "High", "VeryHigh", "VeryHigh", None, None]


def test_pct_round2_is_half_up(spark):
    cases = [(1, 8), (1, 3), (2, 3), (5, 15000), (1, 40000), (3, 40000), (0, 7), (7, 7)]
    df = spark.createDataFrame(cases, "a long, b long")
    got = [r[0] for r in df.select(C.pct_round2("a", "b")).collect()]
    from decimal import ROUND_HALF_UP, Decimal
    want = [float((Decimal(100 * a) / Decimal(b)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)) for a, b in cases]
    assert got == want


def test_months_of_30_days_truncates(spark):
    df = spark.createDataFrame([("2001-12-03",), ("2001-11-01",), ("2002-02-01",)], "d string").select(
        F.to_date("d").alias("d"))
    got = [r[0] for r in df.select(C.months_of_30_days("d", AS_OF)).collect()]
    assert got == [0, 2, -1]


def test_check_rules_null_passes(spark):
    df = spark.createDataFrame([(1, -1), (2, None), (3, 5)], "LoanID long, DaysLate int")
    out = {r.Rule: r.Violations for r in Q.check_rules(df, [Q.Rule("DaysLate >= 0", "DaysLate >= 0"),
                                                          Q.not_null("DaysLate")]).collect()}
    assert out == {"DaysLate >= 0": 1, "DaysLate IS NOT NULL": 1}
    good, bad = Q.quarantine(df, [Q.Rule("DaysLate >= 0", "DaysLate >= 0")])
    assert good.count() == 2 and bad.count() == 1


def test_base_table_one_row_per_loan(book):
    base = CAT.base(book)
    n_loans = book.loans.count()
    assert base.count() == n_loans
    assert base.select("LoanID").distinct().count() == n_loans
    # loans without repayments keep zeros and Outstanding = LoanAmount
    no_rep = base.join(book.repayments.select("LoanID").distinct(), "LoanID", "left_anti")
    row = no_rep.agg(F.max("NumPayments"), F.sum(F.col("OutstandingAmount") - F.col("LoanAmount"))).first()
    assert row[0] == 0 and row[1] == 0


def test_split_is_stratified_disjoint_complete(book):
    sp = CAT.split(book)
    counts = {(r.DefaultFlag, r.IsTest): r.n for r in sp.groupBy("DefaultFlag", "IsTest").agg(F.count("*").alias("n")).collect()}
    for label in (0, 1):
        total = counts[(label, 0)] + counts[(label, 1)]
        assert counts[(label, 1)] == math.ceil(total * 0.2)
    assert sp.count() == book.loans.count()


def test_split_independent_of_partitioning(book):
    a = S.stratified_split(CAT.base(book).repartition(3)).select("LoanID", "IsTest")
    b = S.stratified_split(CAT.base(book).repartition(11)).select("LoanID", "IsTest")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_folds_balanced(book):
    f = S.add_folds(CAT.split(book).filter("IsTest = 0"), k=3)
    sizes = {}
    for r in f.groupBy("DefaultFlag", "fold").agg(F.count("*").alias("n")).collect():
        sizes.setdefault(r.DefaultFlag, []).append(r.n)
    for label, ns in sizes.items():
        assert len(ns) == 3 and max(ns) - min(ns) <= 1


def test_split_with_hot_key_copies(spark):
    # a third of all rows are copies of one key: cuts still land exactly, rows never shuffle
    rows = [(7, i % 2) for i in range(300)] + [(1000 + i, i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "LoanID long, DefaultFlag int").repartition(5)
    out = S.stratified_split(df, test=0.2)
    for label in (0, 1):
        n = df.filter(F.col("DefaultFlag") == label).count()
        t = out.filter((F.col("DefaultFlag") == label) & (F.col("IsTest") == 1)).count()
        assert t == math.ceil(0.2 * n)
    # unique keys follow the (hash, key) order exactly
    import pandas as pd
    pdf = out.toPandas()
    import hashlib
    pdf["h"] = [int(hashlib.md5(f"{k}:42".encode()).hexdigest()[:8], 16) >> 1 for k in pdf.LoanID]
    for label, g in pdf.groupby("DefaultFlag"):
        g = g.sort_values(["h", "LoanID"])
        flags = list(g.IsTest)
        assert flags == sorted(flags, reverse=True)  # all test rows come first in hash order
    folds = S.add_folds(df, k=3).groupBy("DefaultFlag", "fold").count().collect()
    by = {}
    for r in folds:
        by.setdefault(r.DefaultFlag, []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in by.values())


def _np_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum()
    eq = (pos[:, None] == neg[None, :]).sum()
    return (gt + 0.5 * eq) / (len(pos) * len(neg))


def _np_ap(y, p):
    order = np.argsort(-p, kind="mergesort")
    ys, ps = y[order], p[order]
    distinct = np.r_[np.where(np.diff(ps))[0], len(ps) - 1]
    tps = np.cumsum(ys)[distinct]
    fps = (1 + distinct) - tps
    prec = tps / (tps + fps)
    rec = tps / tps[-1]
    return float(np.sum(np.diff(np.r_[0, rec]) * prec))


@pytest.mark.parametrize("buckets", [1, 7, 1024])
def test_auc_ap_against_brute_force(spark, buckets):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 400)
    p = np.round(rng.random(400) * 0.5 + y * 0.2, 2)  # many ties
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "DefaultFlag int, PredProb double")
    auc = E.roc_auc(df, buckets=buckets).first()[0]
    ap = E.average_precision(df, buckets=buckets).first()[0]
    assert auc == pytest.approx(_np_auc(y, p), abs=1e-12)
    assert ap == pytest.approx(_np_ap(y, p), abs=1e-12)


def test_fixture_auc(book):
    assert E.roc_auc(book.scored).first()[0] == pytest.approx(0.7771109247393247, abs=1e-15)


def test_calibration_bins_match_uniform_edges(spark):
    vals = [0.0, 0.1, 0.2, 0.3, 0.30000000000000004, 0.30000001, 0.55, 0.6, 0.7, 0.9, 0.95, 1.0]
    df = spark.createDataFrame([(v,) for v in vals], "p double")
    got = [r[0] for r in df.select(E.calibration_bin(F.col("p"))).collect()]
    edges = np.linspace(0.0, 1.0, 11)
    want = list(np.searchsorted(edges[1:-1], vals))
    assert got == want


def test_best_f1_lowest_threshold_on_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "DefaultFlag int, PredProb double")
    row = E.best_f1(df).first()
    # thresholds 0.7 and 0.9 have F1 0.8 and 0.667; 0.7 wins
    assert row.Threshold == 0.7


def test_confusion_zero_filled(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8)], "DefaultFlag int, PredProb double")
    cells = {(r.Actual, r.Predicted): r.N for r in E.confusion(df, 0.5).collect()}
    assert cells == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 2}


def test_upsert_idempotent_and_last_wins(spark):
    from loanscope.sources.schemas import SCORES
    from loanscope.sources.readers import as_table
    tgt = as_table(spark.createDataFrame([(1, 0.1), (2, 0.2)], "LoanID long, PredProb double"), SCORES)
    upd = spark.createDataFrame([(2, 0.5, 1), (3, 0.7, 1)], "LoanID long, PredProb double, PredFlag int")
    once = U.upsert_scores(tgt, upd, "2002-01-01 00:00:00")
    twice = U.upsert_scores(once, upd, "2002-01-01 00:00:00")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    got = {r.LoanID: r.PredProb for r in once.collect()}
    assert got == {1: 0.1, 2: 0.5, 3: 0.7}
    empty = U.upsert_scores(tgt, upd.limit(0), "2002-01-01 00:00:00")
    assert empty.count() == 2


def _files(root):
    return {str(p): p.stat().st_size for p in root.rglob("*.parquet")}


def test_commit_rewrites_touched_buckets_only(spark, tmp_path):
    """Bytes written follow the updates, not the table."""
    root = tmp_path / "scores"
    assert U.read_current(spark, str(root)).count() == 0
    book = spark.range(20_000).selectExpr("id AS LoanID", "id * 0.5 AS PredProb", "1 AS PredFlag")
    assert U.commit_upsert(spark, str(root), book, "2002-01-01 00:00:00") == list(range(U.BUCKETS))
    before = _files(root)
    upd = spark.createDataFrame([(2, 9.5, 0), (2, 9.0, 1), (77_777, 0.7, 1)], "LoanID long, PredProb double, PredFlag int")
    touched = U.commit_upsert(spark, str(root), upd, "2002-01-02 00:00:00")
    after = _files(root)
    assert 1 <= len(touched) <= 2
    written = {p: n for p, n in after.items() if p not in before}
    assert {p.split("KeyBucket=")[1].split("/")[0] for p in written} == {str(t) for t in touched}
    assert sum(written.values()) < 0.1 * sum(before.values())
    now = {r.LoanID: (r.PredProb, str(r.ScoreDate)[:10]) for r in U.read_current(spark, str(root)).collect()}
    assert len(now) == 20_001 and now[2] == (9.5, "2002-01-02") and now[3] == (1.5, "2002-01-01") and now[77_777][0] == 0.7
    # The same commit again changes nothing; no updates touch nothing.
    U.commit_upsert(spark, str(root), upd, "2002-01-02 00:00:00")
    assert {r.LoanID: (r.PredProb, str(r.ScoreDate)[:10]) for r in U.read_current(spark, str(root)).collect()} == now
    assert U.commit_upsert(spark, str(root), upd.limit(0), "2002-01-03 00:00:00") == []


def test_expected_loss_linear_in_lgd(book):
    a = R.kpis(book.scored, 0.6).first().ExpectedLoss
    b = R.kpis(book.scored, 0.3).first().ExpectedLoss
    assert a == pytest.approx(2 * b, rel=1e-12)


def test_scenarios_base_case_unchanged(book):
    st = CAT.stressed(book).filter(F.col("Scenario") == "Base Case")
    diff = st.join(book.scored.select("LoanID", F.col("PredProb").alias("p0")), "LoanID").filter(
        F.abs(F.col("PredProb").cast("double") - F.col("p0")) > 1e-12)
    assert diff.count() == 0


def test_results_unchanged_under_repartition(book):
    a = FT.repayment_agg(book.repayments.repartition(2))
    b = FT.repayment_agg(book.repayments.repartition(13))
    assert a.exceptAll(b).count() == 0


def test_seeded_sample_repeatable(book):
    base = CAT.base(book)
    a = [r.LoanID for r in S.seeded_sample(base.repartition(4), "LoanID", 50).collect()]
    b = [r.LoanID for r in S.seeded_sample(base.repartition(9), "LoanID", 50).collect()]
    assert a == b and len(a) == 50


def test_payment_ratio_zero_dues(spark):
    df = spark.createDataFrame([(1, 0, 5.0, 0.0), (1, 3, 1.0, 0.0), (2, 0, 4.0, 8.0)],
                               "LoanID long, DaysLate int, PaymentAmount double, DueAmount double")
    got = {r.LoanID: (r.NumPayments, r.AvgDaysLate, r.PaymentRatio) for r in FT.repayment_agg(df).collect()}
    assert got == {1: (2, 1.5, 0.0), 2: (1, 0.0, 0.5)}


def test_defaulted_without_snapshot_gets_zero_label(book):
    base = CAT.base(book)
    no_snap = base.join(book.snapshots.select("LoanID").distinct(), "LoanID", "left_anti")
    row = no_snap.agg(F.count("*").alias("n"), F.sum(F.when(F.col("Status") == "Defaulted", 1).otherwise(0)).alias("d"),
                      F.max("DefaultFlag").alias("m")).first()
    assert row.n > 0 and row.d > 0 and row.m == 0


def test_loans_without_macro_month_keep_null_macro(book):
    base = CAT.base(book)
    missing = base.join(book.macro.select(F.trunc("MonthDate", "MM").alias("m")),
                        F.trunc(base.OriginationDate, "MM") == F.col("m"), "left_anti")
    assert missing.count() > 0
    assert missing.filter(F.col("InflationRate").isNotNull()).count() == 0


def test_single_class_metrics(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9)], "DefaultFlag int, PredProb double")
    assert E.roc_auc(df).first()[0] is None            # undefined with no negatives
    assert E.average_precision(df).first()[0] == 1.0
    pm = E.point_metrics(df, 0.5).first()
    assert (pm.Precision, pm.Recall, pm.Accuracy) == (1.0, 0.5, 0.5)


def test_best_threshold_empty_defaults(spark):
    df = spark.createDataFrame([], "DefaultFlag int, PredProb double")
    assert E.best_threshold(df) == 0.5


def test_duplicate_keys_found(book):
    d = Q.duplicate_keys(book.repayments, ["LoanID", "PaymentDate"])
    assert d.count() > 0 and d.agg(F.min("N")).first()[0] == 2


def test_cluster_conf_sizes_partitions():
    from loanscope.session import cluster_conf
    c = cluster_conf(100 * 2**40, executors=1000, cores_per_executor=4)
    assert int(c["spark.sql.shuffle.partitions"]) >= 100 * 2**40 // (256 << 20)
    assert int(cluster_conf(1 << 20, executors=10)["spark.sql.shuffle.partitions"]) == 80
    assert c["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_seeded_sample_with_copies_is_repeatable(spark):
    rows = [(7, i) for i in range(50)] + [(100 + i, i) for i in range(50)]
    df = spark.createDataFrame(rows, "LoanID long, v int")
    a = [tuple(r) for r in S.seeded_sample(df.repartition(3), "LoanID", 30).collect()]
    b = [tuple(r) for r in S.seeded_sample(df.repartition(7), "LoanID", 30).collect()]
    assert a == b


def test_seeds_give_unrelated_orders():
    """Another seed is another shuffle, not a rotation of the same one."""
    import hashlib

    h = [[int(hashlib.md5(f"{k}:{s}".encode()).hexdigest()[:8], 16) >> 1 for k in range(2000)] for s in (42, 43)]
    a, b = np.argsort(np.argsort(h[0])), np.argsort(np.argsort(h[1]))
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.1 and len({(y - x) % (1 << 31) for x, y in zip(*h)}) > 1900


def test_smote_takes_large_keys(spark):
    big = 5 * 10 ** 15
    rows = [(big + i, int(i < 10), float(i % 7), float(i % 3)) for i in range(100)]
    df = spark.createDataFrame(rows, "LoanID long, DefaultFlag int, x double, y double")
    out = SM.smote(df, ["x", "y"], ratio=0.3, k=3)
    assert out.filter("Synthetic = 1").count() == 27 - 10
    assert out.filter("Synthetic = 1").select("LoanID").distinct().count() == 17


def test_upsert_keeps_columns_that_the_update_lacks(spark):
    target = spark.createDataFrame([(1, 10, 0.5), (2, 20, 0.6)], "LoanID long, CustomerID long, PredProb double")
    updates = spark.createDataFrame([(1, 0.9), (3, 0.1)], "LoanID long, PredProb double")
    got = sorted(tuple(r) for r in U.upsert(target, updates).collect())
    assert got == [(1, 10, 0.9), (2, 20, 0.6), (3, None, 0.1)]


def test_one_hot_keeps_the_band_order_when_low_is_absent(spark):
    df = spark.createDataFrame([(1, "Med"), (2, "High")], "LoanID long, CreditScoreBand string")
    enc, names = FT.one_hot(df, FT.fit_levels(df, ["CreditScoreBand"]))
    assert names == ["CreditScoreBand_Med", "CreditScoreBand_High", "CreditScoreBand_VeryHigh"]
    assert enc.filter("LoanID = 1").first()["CreditScoreBand_Med"] == 1


def test_foreign_keys_let_null_pass(spark):
    child = spark.createDataFrame([(1,), (None,), (9,)], "k long")
    parent = spark.createDataFrame([(1,)], "k long")
    assert Q.fk_violations(child, parent, "k", "r").first()["Violations"] == 1
    assert Q.orphan_count(child, parent, "k", "n").first()["n"] == 2


def test_knn_pairs_a_point_stay_flat(spark):
    """Eight times the points, about as many candidate pairs a point."""
    rng = np.random.default_rng(3)
    per = []
    for n in (1000, 8000):
        x = rng.normal(size=(n, 2)) * [900.0, 300.0]
        rows = [(i, float(a), float(b), float(a * 0.01 + c)) for i, ((a, b), c) in enumerate(zip(x, rng.normal(size=n) * 0.1))]
        stats: dict = {}
        df = spark.createDataFrame(rows, "LoanID long, x double, y double, z double")
        got = SM.knn(df, "LoanID", ["x", "y", "z"], 5, stats=stats).filter("Rank = 5").orderBy("LoanID").toPandas()
        if n == 1000:
            v = np.array([r[1:] for r in rows])
            d = np.sort(np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1)), axis=1)[:, 5]
            assert np.allclose(got.Distance.to_numpy(), d)
        per.append(stats["pairs"] / n)
    assert per[1] < 2 * per[0] and per[0] < 2 * per[1], per


def test_one_hot_refuses_columns_without_bound(spark, monkeypatch):
    df = spark.createDataFrame([(str(i % 7), "a") for i in range(50)] + [(None, "b")], "x string, y string")
    assert FT.fit_levels(df, ["x", "y"]) == {"x": [str(i) for i in range(7)], "y": ["a", "b"]}
    monkeypatch.setattr(FT, "MAX_LEVELS", 6)
    with pytest.raises(ValueError, match="x"):
        FT.fit_levels(df, ["x", "y"])


def test_distances_are_compiled_and_equal_the_lambda_form(spark, monkeypatch):
    rows = [([0.1 * i * j for j in range(7)], [i / (j + 3) for j in range(7)]) for i in range(50)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    out = df.select(SM._sqdist(F.col("a"), F.col("b"), 7).alias("d"))
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = [r.d for r in out.collect()]
    monkeypatch.setattr(SM, "_WRITTEN_OUT", 6)
    lambdas = df.select(SM._sqdist(F.col("a"), F.col("b"), 7).alias("d"))
    assert "lambda" in lambdas._jdf.queryExecution().optimizedPlan().toString()
    assert got == [r.d for r in lambdas.collect()]


def test_oversampled_rows_are_stored_by_column(spark, monkeypatch):
    rows = [(i, int(i < 10), float(i % 7), float(i % 3)) for i in range(100)]
    df = spark.createDataFrame(rows, "LoanID long, DefaultFlag int, `x y` double, z double")
    monkeypatch.setattr(CAT, "imputed_train", lambda spark, b: (df, ["x y", "z"]))
    monkeypatch.setattr(CAT, "_cached", lambda spark, b, name, build: build())
    out = CAT.resampled(spark, None)
    assert out.inputFiles() and all(f.endswith(".parquet") for f in out.inputFiles())
    assert out.columns == ["LoanID", "DefaultFlag", "x y", "z", "Synthetic"] and out.count() == 100 + 27 - 10
