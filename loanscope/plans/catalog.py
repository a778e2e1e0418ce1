"""The query catalogue: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the inventory.  Each reads the fixture loan book derived from the
given tables (whole tables, no row caps) and ends in ``portable`` so the
outputs compare one-to-one with the SQL oracle in ``plans/oracle.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.functions.columns import flag_at
from loanscope.operators import explain as X
from loanscope.operators import features as FT
from loanscope.operators import metrics as E
from loanscope.operators import models as M
from loanscope.operators import portfolio as P
from loanscope.operators import quality as Q
from loanscope.operators import risk as R
from loanscope.operators import sampling as S
from loanscope.operators import smote as SM
from loanscope.operators import upsert as U
from loanscope.operators.portfolio import class_counts
from loanscope.plans.portable import portable
from loanscope.session import ensure_checkpoint_dir, scratch_path, written
from loanscope.sources import readers, schemas
from loanscope.sources import sinks
from loanscope.sources.fixtures import AS_OF, LoanBook, load_book

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
REGISTRY_RAW: dict[str, Callable[[SparkSession, LoanBook], DataFrame]] = {}

# Parameters of the registered queries.
LGD = 0.6
UPSERT_TS = "2002-01-01 00:00:00"
PRIOR_SCORE_TS = "2001-06-30 00:00:00"
TARGET_BEFORE = "1998-01-01"
UPDATES_FROM = "1997-01-01"
PRIOR_THRESHOLD = 0.5
NEW_THRESHOLD = 0.3
SAMPLE_N = 1000
DEPENDENCE_BINS = 20


def register(name: str):
    def deco(fn: Callable[[SparkSession, LoanBook], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_checkpoint_dir(spark)
            return portable(fn(spark, load_book(spark, sf_dir)))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        REGISTRY_RAW[name] = fn
        return run
    return deco


# ---- shared derived frames ---------------------------------------------------------------------

def base(b: LoanBook) -> DataFrame:
    return FT.base_table(b.loans, b.customers, b.repayments, b.snapshots, b.macro)


def labels(b: LoanBook) -> DataFrame:
    """LoanID and DefaultFlag of the base table, without building it."""
    return FT.label_table(b.loans, b.snapshots)


def split(b: LoanBook) -> DataFrame:
    """Base table + IsTest; the cuts come from the labels alone, so the base table is read once."""
    return S.stratified_split(base(b), "DefaultFlag", "LoanID", 0.2, 42, labels=labels(b))


def label_split(b: LoanBook) -> DataFrame:
    """LoanID, DefaultFlag, IsTest of the same split."""
    return S.stratified_split(labels(b).checkpoint(eager=True), "DefaultFlag", "LoanID", 0.2, 42)  # read by cuts and rows


def scored_base(b: LoanBook) -> DataFrame:
    """Base table + the scorecard's PredProb (the scored portfolio)."""
    return base(b).join(b.scored.select("LoanID", "PredProb"), "LoanID", "left")


def best_t(b: LoanBook):
    return E.best_threshold_column(b.scored)


# ---- scans, sources, sinks -----------------------------------------------------------------------

@register("a1_table_counts")
def _a1(spark, b):
    """Row count per table."""
    return Q.table_counts(b.tables())


def _csv_roundtrip(spark: SparkSession, df: DataFrame, schema, name: str) -> DataFrame:
    path = scratch_path(spark, f"csv-{name}")
    readers.write_csv_table(readers.as_table(df, schema), path)
    back = readers.read_csv_table(spark, path, schema)
    return back.select(*[c for c in df.columns])


@register("s1_read_customers_csv")
def _s1(spark, b):
    """Customers written as bulk-load CSV and read back with the typed schema."""
    return _csv_roundtrip(spark, b.customers, schemas.CUSTOMERS, "customers")


@register("s2_read_loans_csv")
def _s2(spark, b):
    return _csv_roundtrip(spark, b.loans, schemas.LOANS, "loans")


@register("s3_read_repayments_csv")
def _s3(spark, b):
    return _csv_roundtrip(spark, b.repayments, schemas.REPAYMENTS, "repayments")


@register("s4_read_macro_csv")
def _s4(spark, b):
    return _csv_roundtrip(spark, b.macro, schemas.MACRO, "macro")


@register("s5_read_snapshots_csv")
def _s5(spark, b):
    return _csv_roundtrip(spark, b.snapshots, schemas.SNAPSHOTS, "snapshots")


@register("s7_customer_dims")
def _s7(spark, b):
    return readers.customer_dims(b.customers)


@register("s10_load_timestamp")
def _s10(spark, b):
    """Customers stamped with CreatedAt = load time (a parameter)."""
    return U.with_load_timestamp(b.customers.select("CustomerID", "CustomerName"), "CreatedAt", UPSERT_TS)


# ---- quality ---------------------------------------------------------------------------------------

@register("j1_orphan_loans")
def _j1(spark, b):
    return Q.orphan_count(b.loans, b.customers, "CustomerID", "OrphanLoans")


@register("j2_orphan_repayments")
def _j2(spark, b):
    return Q.orphan_count(b.repayments, b.loans, "LoanID", "OrphanRepayments")


@register("t1_future_loans")
def _t1(spark, b):
    return Q.future_loans(b.loans, AS_OF, 10)


@register("a2_score_range")
def _a2(spark, b):
    return Q.score_range(b.customers)


@register("a3_rate_range")
def _a3(spark, b):
    return Q.rate_range(b.loans)


@register("a4_amount_range")
def _a4(spark, b):
    return Q.amount_range(b.loans)


@register("d1_customer_rules")
def _d1c(spark, b):
    return Q.check_rules(b.customers, Q.CUSTOMER_RULES)


@register("d1_loan_rules")
def _d1l(spark, b):
    return Q.check_rules(b.loans, Q.LOAN_RULES)


@register("d1_repayment_rules")
def _d1r(spark, b):
    return Q.check_rules(b.repayments, Q.REPAYMENT_RULES)


@register("d2_snapshot_rules")
def _d2(spark, b):
    return Q.check_rules(b.snapshots, Q.SNAPSHOT_RULES)


@register("d3_duplicate_keys")
def _d3(spark, b):
    """Table, DuplicateKeys, ExcessRows for every primary key."""
    keys = [("Customers", b.customers, ["CustomerID"]), ("Loans", b.loans, ["LoanID"]),
            ("Macroeconomics", b.macro, ["MonthDate"]),
            ("LoanPerformanceSnapshots", b.snapshots, ["LoanID", "SnapshotDate"])]
    out = None
    for name, df, key in keys:
        d = Q.duplicate_keys(df, key).agg(
            F.count(F.lit(1)).alias("DuplicateKeys"),
            F.coalesce(F.sum(F.col("N") - 1), F.lit(0)).cast("long").alias("ExcessRows"))
        d = d.select(F.lit(name).alias("Table"), "DuplicateKeys", "ExcessRows")
        out = d if out is None else out.unionByName(d)
    return out


@register("d3_duplicate_payment_days")
def _d3b(spark, b):
    """(LoanID, PaymentDate) pairs seen more than once."""
    return Q.duplicate_keys(b.repayments, ["LoanID", "PaymentDate"])


@register("d4_fk_violations")
def _d4(spark, b):
    return (Q.fk_violations(b.loans, b.customers, "CustomerID", "Loans.CustomerID -> Customers")
            .unionByName(Q.fk_violations(b.repayments, b.loans, "LoanID", "Repayments.LoanID -> Loans"))
            .unionByName(Q.fk_violations(b.snapshots, b.loans, "LoanID", "LoanPerformanceSnapshots.LoanID -> Loans")))


@register("d6_future_dates")
def _d6(spark, b):
    return Q.future_dates(b.loans, AS_OF)


# ---- portfolio aggregates ------------------------------------------------------------------------

@register("a5_portfolio_total")
def _a5(spark, b):
    return P.portfolio_total(b.loans)


@register("a6_status_distribution")
def _a6(spark, b):
    return P.status_distribution(b.loans)


@register("a7_grade_mix")
def _a7(spark, b):
    return P.grade_mix(b.loans)


@register("a8_industry_loans")
def _a8(spark, b):
    return P.industry_loans(b.customers, b.loans)


@register("a9_region_default_rate")
def _a9(spark, b):
    return P.region_default_rate(b.loans, b.customers)


@register("a10_repayment_agg")
def _a10(spark, b):
    return FT.repayment_agg(b.repayments)


@register("a11_delay_by_grade")
def _a11(spark, b):
    return P.delay_by_grade(b.repayments, b.loans)


@register("a12_paid_ratio_by_status")
def _a12(spark, b):
    return P.paid_ratio_by_status(b.repayments, b.loans)


@register("a13_grade_default")
def _a13(spark, b):
    return P.grade_default(b.loans)


@register("a14_industry_portfolio")
def _a14(spark, b):
    return P.industry_portfolio(b.loans, b.customers)


@register("a15_region_performance")
def _a15(spark, b):
    return P.region_performance(b.loans, b.customers)


@register("a16_snapshot_trend")
def _a16(spark, b):
    return P.snapshot_trend(b.snapshots)


@register("a17_correlation")
def _a17(spark, b):
    c = P.correlation_long(P.loan_customer(b.loans, b.customers, "left"))
    return c.withColumn("Corr", F.round("Corr", 10))


@register("a18_label_rate")
def _a18(spark, b):
    return P.label_rate(base(b))


@register("a20_expected_loss")
def _a20(spark, b):
    """Expected loss of the test split: SUM(PD x OutstandingAmount) x LGD."""
    test = split(b).filter("IsTest = 1").join(b.scored.select("LoanID", "PredProb"), "LoanID")
    return R.expected_loss(test, LGD).withColumn("ExpectedLoss", F.round("ExpectedLoss", 2))


# ---- feature table -------------------------------------------------------------------------------

@register("f0_base_table")
def _f0(spark, b):
    return base(b)


@register("f1_f6_features")
def _f1(spark, b):
    f = FT.add_features(base(b), AS_OF)
    return f.select("LoanID", "LoanToRevenue", "PaymentCoverage", "RemainingRatio", "LoanAgeMonths",
                    "MonthsSinceLastPayment", "CreditScoreBand")


@register("f7_one_hot")
def _f7(spark, b):
    f = FT.add_features(base(b), AS_OF)
    enc, names = FT.one_hot(f, FT.fit_levels(f))
    return enc.select("LoanID", *names)


@register("m1_stratified_split")
def _m1(spark, b):
    return label_split(b)


@register("m1_folds")
def _m1f(spark, b):
    return S.add_folds(label_split(b).filter("IsTest = 0"), "DefaultFlag", "LoanID", 3, 42).select(
        "LoanID", "DefaultFlag", "fold")


@register("x5_seeded_sample")
def _x5(spark, b):
    return S.seeded_sample(base(b), "LoanID", SAMPLE_N, 42).select(
        "LoanID", "CustomerID", "LoanAmount", "CreditScore", "DefaultFlag")


# ---- evaluation ----------------------------------------------------------------------------------

@register("e1_roc_auc")
def _e1(spark, b):
    return E.roc_auc(b.scored)


@register("e2_average_precision")
def _e2(spark, b):
    return E.average_precision(b.scored).withColumn("AvgPrecision", F.round("AvgPrecision", 12))


@register("e3_pr_curve")
def _e3(spark, b):
    return E.pr_curve(b.scored)


@register("e4_best_f1")
def _e4(spark, b):
    return E.best_f1(b.scored)


@register("e5_confusion")
def _e5(spark, b):
    return E.confusion(b.scored, best_t(b))


@register("e6_class_report")
def _e6(spark, b):
    return E.class_report(b.scored, best_t(b))


@register("e7_point_metrics")
def _e7(spark, b):
    return E.point_metrics(b.scored, best_t(b))


@register("e8_calibration")
def _e8(spark, b):
    return E.calibration(b.scored, 10).withColumn("MeanPred", F.round("MeanPred", 12))


@register("e9_eval_summary")
def _e9(spark, b):
    s = E.eval_summary(b.scored, None, "Scorecard")
    return s.withColumn("AvgPrecision_PR_AUC", F.round("AvgPrecision_PR_AUC", 12))


# ---- scored portfolio, risk products ---------------------------------------------------------------

@register("j9_with_customer_dims")
def _j9(spark, b):
    """The predictions export frame: scored loans + Region, Industry + PredFlag."""
    sb = scored_base(b).select("LoanID", "CustomerID", "LoanAmount", "OutstandingAmount", "DefaultFlag", "PredProb")
    j = R.with_customer_dims(sb, b.customers)
    return j.withColumn("PredFlag", (F.col("PredProb") >= best_t(b)).cast("int")).select(
        "LoanID", "CustomerID", "LoanAmount", "OutstandingAmount", "DefaultFlag", "Region", "Industry",
        "PredProb", "PredFlag")


@register("j10_align_scores")
def _j10(spark, b):
    """Test-split rows aligned to their scores by LoanID."""
    t = split(b).filter("IsTest = 1").select("LoanID", "OutstandingAmount", "DefaultFlag")
    return R.align_scores(t, b.scored.select("LoanID", "PredProb"))


@register("r1_kpis")
def _r1(spark, b):
    return R.kpis(b.scored, LGD).withColumn("ExpectedLoss", F.round("ExpectedLoss", 2))


def _risk_by(b: LoanBook, dim: str) -> DataFrame:
    sc = b.scored.join(readers.customer_dims(b.customers), "CustomerID", "left")
    return R.risk_by(sc, dim, LGD).withColumn("ExpectedLoss", F.round("ExpectedLoss", 2))


@register("r2_risk_by_region")
def _r2r(spark, b):
    return _risk_by(b, "Region")


@register("r2_risk_by_industry")
def _r2i(spark, b):
    return _risk_by(b, "Industry")


@register("r3_score_bands")
def _r3b(spark, b):
    return R.score_distribution(b.customers, "band")


@register("r3_score_bins")
def _r3n(spark, b):
    return R.score_distribution(b.customers, "bin", 50)


@register("r4_sector_averages")
def _r4(spark, b):
    return R.sector_averages(b.loans, b.customers)


@register("r5_segment_lift")
def _r5(spark, b):
    return R.segment_lift(FT.add_features(base(b), AS_OF))


def stressed(b: LoanBook) -> DataFrame:
    sc = b.scored.select("LoanID", "LoanAmount", "PredProb")
    return R.apply_scenarios(sc, R.stress_scorecard).select("Scenario", "LoanID", "LoanAmount", "PredProb")


@register("r6_stressed_scores")
def _r6(spark, b):
    return stressed(b)


@register("r7_scenario_summary")
def _r7(spark, b):
    return R.scenario_summary(stressed(b), LGD)


@register("r8_rising_lateness")
def _r8(spark, b):
    return R.rising_lateness(b.repayments, 3)


@register("t5_top_risk")
def _t5(spark, b):
    return R.top_risk(b.scored, 20)


# ---- upsert --------------------------------------------------------------------------------------

def score_rows(sb: DataFrame, threshold: float) -> DataFrame:
    return sb.select("LoanID", "CustomerID", "LoanAmount", "OutstandingAmount", "PredProb",
                     flag_at("PredProb", threshold).alias("PredFlag"))


def score_runs(b: LoanBook) -> tuple[DataFrame, DataFrame]:
    """Scores of the pre-1998 book (earlier run), and a re-score of loans from 1997 on."""
    sb = scored_base(b).select("LoanID", "CustomerID", "LoanAmount", "OutstandingAmount", "PredProb",
                               "OriginationDate").checkpoint(eager=True)  # read by both sides of the merge
    early = F.col("OriginationDate").isNull() | (F.col("OriginationDate") < F.lit(TARGET_BEFORE).cast("date"))
    return (score_rows(sb.filter(early), PRIOR_THRESHOLD),
            score_rows(sb.filter(F.col("OriginationDate") >= F.lit(UPDATES_FROM).cast("date")), NEW_THRESHOLD))


@register("k2_upsert_scores")
def _k2(spark, b):
    """The earlier run's scores merged with the re-score."""
    prior, updates = score_runs(b)
    target = readers.as_table(U.with_load_timestamp(prior, "ScoreDate", PRIOR_SCORE_TS), schemas.SCORES)
    return U.upsert_scores(target, updates, UPSERT_TS)


@register("k2_table_upsert")
def _k2t(spark, b):
    """The same merge in the stored table: two commits, the second rewrites the buckets of its loans."""
    root = scratch_path(spark, "scores")
    prior, updates = score_runs(b)
    U.commit_upsert(spark, root, prior, PRIOR_SCORE_TS)
    U.commit_upsert(spark, root, updates, UPSERT_TS)
    return U.read_current(spark, root)


# ---- models (pyspark.ml) ---------------------------------------------------------------------------
# Fitted models are cached per session and state of the input files (name, size, time of
# change), so the model-based entries share one fit each and new data is fitted anew; fits are seeded and laid out by key, so the same rows give
# the same model whatever the partitions or cores.


# Registered model settings (a point of the search grid, and the reference's search).
FOREST = {"num_trees": 200, "max_depth": 6, "min_instances": 1, "subset": "sqrt"}
SMOTE_FOREST = FOREST | {"max_depth": 30}  # no depth limit: Spark's largest depth
SEARCH_N_ITER = 20
SEARCH_FOLDS = 3
_CACHE: dict[tuple, object] = {}


def _state(spark: SparkSession, b: LoanBook) -> tuple:
    """(file, size, time of change) of every file behind the loan book."""
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    out = []
    for f in sorted({f for df in b.tables().values() for f in df.inputFiles()}):
        at = jvm.org.apache.hadoop.fs.Path(f)
        status = at.getFileSystem(conf).getFileStatus(at)
        out.append((f, status.getLen(), status.getModificationTime()))
    return tuple(out)


def _cached(spark: SparkSession, b: LoanBook, name: str, build):
    key = (spark.sparkContext.applicationId, id(spark), name, _state(spark, b))
    if key not in _CACHE:
        _CACHE[key] = build()
    return _CACHE[key]


def training_frame(spark: SparkSession, b: LoanBook) -> tuple[DataFrame, list[str]]:
    """Feature table + IsTest + one-hot columns (non-leaky feature list); the table is written once,
    and the levels and the fits read the columns that they need.  The loans with their repayments and
    snapshots are written before the customers join, which may repeat rows: the split counts its labels there."""
    def build():
        by_loan = FT.stored_history(b.loans, b.repayments, b.snapshots)
        both = S.stratified_split(FT.completed(by_loan, b.customers, b.macro), "DefaultFlag", "LoanID", 0.2, 42,
                                  labels=FT.labels_of(by_loan))
        f = written(FT.add_features(both, AS_OF), "features")
        enc, names = FT.one_hot(f, FT.fit_levels(f))
        return enc, FT.feature_columns(enc, names, drop_leaky=True)
    return _cached(spark, b, "training_frame", build)


def _train_weighted(spark, b) -> DataFrame:
    enc, _ = training_frame(spark, b)
    return M.balanced_weights(enc.filter("IsTest = 0"))


def logistic(spark, b) -> M.Fitted:
    return _cached(spark, b, "logistic", lambda: M.train_logistic(_train_weighted(spark, b), training_frame(spark, b)[1]))


def forest(spark, b) -> M.Fitted:
    return _cached(spark, b, "forest", lambda: M.train_forest(
        _train_weighted(spark, b), training_frame(spark, b)[1], **FOREST))


def _test(spark, b) -> DataFrame:
    return training_frame(spark, b)[0].filter("IsTest = 1")


@register("m2_standardize")
def _m2(spark, b):
    """Numeric features standardised with training-split mean and population std."""
    cols = FT.NUMERIC_FEATURES
    f = FT.add_features(split(b), AS_OF).select("LoanID", "IsTest", *cols).checkpoint(eager=True)
    out = M.standardize_with(f.filter("IsTest = 0"), f.select("LoanID", *cols), cols)
    return out.select("LoanID", *[F.round(c, 9).alias(c) for c in cols])


@register("m3_balanced_weights")
def _m3(spark, b):
    """Training rows with weight n / (2 n_class)."""
    return M.balanced_weights(label_split(b).filter("IsTest = 0").select("LoanID", "DefaultFlag"))


@register("m4_logistic_scores")
def _m4(spark, b):
    return M.score(logistic(spark, b), _test(spark, b), 0.5)


@register("m5_forest_scores")
def _m5(spark, b):
    return M.score(forest(spark, b), _test(spark, b), 0.5)


@register("m6_random_search")
def _m6(spark, b):
    """Params, AvgAUC of the sampled grid points (stratified folds), best first."""
    def build():
        train = S.add_folds(_train_weighted(spark, b), k=SEARCH_FOLDS)
        best, results = M.random_search(train, training_frame(spark, b)[1], folds=SEARCH_FOLDS, n_iter=SEARCH_N_ITER)
        return best, results
    best, results = _cached(spark, b, "search", build)
    rows = [(str(sorted(p.items())), auc) for p, auc in results]
    return spark.createDataFrame(rows, "Params string, AvgAUC double").orderBy(F.desc("AvgAUC"), "Params")


@register("m9_importances")
def _m9(spark, b):
    return M.top_features(M.importances(forest(spark, b), spark), 20)


@register("m10_score_all")
def _m10(spark, b):
    """Every loan scored at the forest's max-F1 threshold: the PredictedLoanScores rows."""
    enc, _ = training_frame(spark, b)
    threshold = E.best_threshold(M.score(forest(spark, b), _test(spark, b), None))
    sc = M.score(forest(spark, b), enc, threshold, keep=["LoanID", "CustomerID", "LoanAmount", "OutstandingAmount"])
    return U.with_load_timestamp(sc, "ScoreDate", UPSERT_TS)


@register("m11_model_comparison")
def _m11(spark, b):
    test = _test(spark, b)
    return M.model_comparison({"LogisticRegression": M.score(logistic(spark, b), test),
                               "RandomForest": M.score(forest(spark, b), test),
                               "RandomForest_SMOTE": M.score(smote_forest(spark, b), test)})


@register("k6_model_roundtrip")
def _k6(spark, b):
    """Forest saved to the shared folder, loaded back, test rows rescored."""
    fitted = forest(spark, b)
    path = scratch_path(spark, "model")
    sinks.save_model(fitted.model, path)
    loaded = M.Fitted(sinks.load_model(path), fitted.features, fitted.name)
    return M.score(loaded, _test(spark, b), 0.5)


@register("k1_ensure_score_table")
def _k1(spark, b):
    """Score table created when absent (typed, empty), the scored book committed to it, then read back."""
    root = scratch_path(spark, "scores")
    U.ensure_score_table(spark, root)
    U.commit_upsert(spark, root, score_rows(scored_base(b), PRIOR_THRESHOLD), UPSERT_TS)
    return U.read_current(spark, root)


@register("k3_predictions_csv")
def _k3(spark, b):
    """The predictions export written as header CSV and read back typed."""
    path = scratch_path(spark, "predictions")
    frame = REGISTRY_RAW["j9_with_customer_dims"](spark, b)
    sinks.write_predictions(frame, path)
    return readers.read_csv_table(spark, path, schemas.PREDICTIONS)


@register("k4_metrics_csv")
def _k4(spark, b):
    path = scratch_path(spark, "metrics-csv")
    sinks.write_metrics_csv(E.eval_summary(b.scored, None, "Scorecard"), path)
    schema = "Model string, ROC_AUC double, Precision double, Recall double, Accuracy double, Threshold double, TestSize long"
    return spark.read.schema(schema).option("header", True).csv(path)


@register("k5_eval_json")
def _k5(spark, b):
    path = scratch_path(spark, "eval-json")
    sinks.write_eval_json(E.eval_summary(b.scored, None, "Scorecard"), path)
    schema = ("Model string, ROC_AUC double, AvgPrecision_PR_AUC double, DefaultRate double, TestSize long, "
              "ThresholdUsed double")
    return spark.read.schema(schema).json(path).withColumn("AvgPrecision_PR_AUC", F.round("AvgPrecision_PR_AUC", 12))


@register("k4_model_metrics_csv")
def _k4m(spark, b):
    """Metrics export of the fitted forest, written and read back."""
    path = scratch_path(spark, "model-metrics-csv")
    sinks.write_metrics_csv(REGISTRY_RAW["e9_model_eval_summary"](spark, b), path)
    schema = "Model string, ROC_AUC double, Precision double, Recall double, Accuracy double, Threshold double, TestSize long"
    return spark.read.schema(schema).option("header", True).csv(path)


@register("k5_model_eval_json")
def _k5m(spark, b):
    """Evaluation export of the fitted forest with the logistic baseline's accuracy at 0.5."""
    path = scratch_path(spark, "model-eval-json")
    sinks.write_eval_json(REGISTRY_RAW["e9_model_eval_summary"](spark, b), path)
    schema = ("Model string, ROC_AUC double, AvgPrecision_PR_AUC double, DefaultRate double, TestSize long, "
              "ThresholdUsed double")
    base = E.point_metrics(REGISTRY_RAW["m4_logistic_scores"](spark, b), 0.5).select(
        F.col("Accuracy").alias("accuracy_baseline"))
    return spark.read.schema(schema).json(path).withColumn("accuracy_baseline", base.scalar())


@register("m4_all_features_scores")
def _m4a(spark, b):
    """Logistic scores on the full list of 20 numeric features (leaky ones included)."""
    def build():
        enc, clean = training_frame(spark, b)
        feats = FT.feature_columns(enc, [c for c in clean if c not in FT.NUMERIC_FEATURES], drop_leaky=False)
        return M.train_logistic(M.balanced_weights(enc.filter("IsTest = 0")), feats), enc
    fitted, enc = _cached(spark, b, "logistic_all", build)
    return M.score(fitted, enc.filter("IsTest = 1"), 0.5)


def _chosen(spark, b) -> tuple[str, M.Fitted]:
    """Name and fit of the model that the comparison chooses by AUC."""
    name = _cached(spark, b, "chosen", lambda: M.choose(REGISTRY_RAW["m11_model_comparison"](spark, b), "AUC"))
    return name, {"LogisticRegression": logistic, "RandomForest": forest, "RandomForest_SMOTE": smote_forest}[name](spark, b)


@register("m11_chosen_model")
def _m11c(spark, b):
    """The model that the comparison chooses by AUC."""
    return spark.createDataFrame([(_chosen(spark, b)[0],)], "Model string")


@register("m10_score_chosen")
def _m10c(spark, b):
    """Every loan scored by the chosen model at its max-F1 threshold."""
    name, fitted = _chosen(spark, b)
    threshold = E.best_threshold(M.score(fitted, _test(spark, b), None))
    sc = M.score(fitted, training_frame(spark, b)[0], threshold, keep=["LoanID", "CustomerID", "LoanAmount", "OutstandingAmount"])
    return U.with_load_timestamp(sc, "ScoreDate", UPSERT_TS).withColumn("Model", F.lit(name))


@register("x2_linear_shap")
def _x2(spark, b):
    """Exact attributions of the logistic model (margin space) for every loan."""
    return X.linear_shap(logistic(spark, b), training_frame(spark, b)[0])


def _tree_phi(spark, b) -> DataFrame:
    """One row a loan, written once; X1, X3 and X4 read it."""
    def build():
        return written(X.tree_shap_rows(forest(spark, b), training_frame(spark, b)[0]), "tree-phi")
    return _cached(spark, b, "tree_phi", build)


@register("x1_tree_shap")
def _x1(spark, b):
    """TreeSHAP attributions of the forest for every loan (long form)."""
    return X.long_form(_tree_phi(spark, b), forest(spark, b).features)


def background(spark, b) -> DataFrame:
    """Seeded sample of the training rows, the reference point of the attributions."""
    return _cached(spark, b, "background", lambda: S.seeded_sample(
        training_frame(spark, b)[0].filter("IsTest = 0"), "LoanID", SAMPLE_N, 42).checkpoint(eager=True))


def _background_phi(spark, b) -> DataFrame:
    return _cached(spark, b, "background_phi", lambda: written(X.background_shap(
        forest(spark, b), training_frame(spark, b)[0], background(spark, b)), "background-phi"))


@register("x1_background")
def _x1b(spark, b):
    """Attributions of the forest for every loan against a 1,000-row sample (long form)."""
    return X.long_form(_background_phi(spark, b), forest(spark, b).features)


@register("x3_background_summary")
def _x3b(spark, b):
    return X.summary_of_rows(_background_phi(spark, b), forest(spark, b).features)


@register("x3_shap_summary")
def _x3(spark, b):
    return X.summary_of_rows(_tree_phi(spark, b), forest(spark, b).features)


@register("x4_dependence")
def _x4(spark, b):
    """(Value, Phi) of the top-importance feature."""
    top = M.top_features(M.importances(forest(spark, b), spark), 1).first()["Feature"]
    return X.dependence_of_rows(_tree_phi(spark, b), forest(spark, b).features, top)


@register("x4_dependence_bins")
def _x4b(spark, b):
    """Mean attribution per value bin of the top-importance feature."""
    top = M.top_features(M.importances(forest(spark, b), spark), 1).first()["Feature"]
    return X.binned(X.dependence_of_rows(_tree_phi(spark, b), forest(spark, b).features, top), DEPENDENCE_BINS)


# ---- oversampling ----------------------------------------------------------------------------------


SMOTE_RATIO = 0.3
SMOTE_K = 5


def imputed_train(spark, b) -> tuple[DataFrame, list[str]]:
    """Training rows, features as DOUBLE with NULLs replaced by training means."""
    enc, feats = training_frame(spark, b)
    train = M.as_double_features(enc.filter("IsTest = 0"), feats)
    means = {c: float(v) for c, v in zip(feats, train.agg(*[F.avg(c) for c in feats]).first()) if v is not None}
    return train.fillna(means, subset=list(means)), feats


def resampled(spark, b) -> DataFrame:
    """Training rows and synthetic rows, written once; a reader takes only the columns that it needs."""
    def build():
        train, feats = imputed_train(spark, b)
        return written(SM.smote(train, feats, "DefaultFlag", "LoanID", SMOTE_RATIO, SMOTE_K, 42), "smote")
    return _cached(spark, b, "smote", build)


@register("m7_smote_knn")
def _m7k(spark, b):
    """Exact 5 nearest minority neighbours of every minority training row."""
    train, feats = imputed_train(spark, b)
    nn = SM.knn(train.filter("DefaultFlag = 1").select("LoanID", *feats), "LoanID", feats, SMOTE_K)
    return nn.withColumn("Distance", F.round("Distance", 6))


@register("m7_smote")
def _m7(spark, b):
    """Training rows plus synthetic minority rows (minority = 0.3 x majority);
    the macro columns, whose missing months are filled with float means, are
    rounded to 1e-9; every other feature is exact."""
    r = resampled(spark, b)
    feats = training_frame(spark, b)[1]
    macro = set(FT.MACRO_FIELDS)
    return r.select("LoanID", "DefaultFlag",
                    *[(F.round(F.col(f"`{c}`"), 9) if c in macro else F.col(f"`{c}`")).alias(c) for c in feats],
                    "Synthetic")


@register("a19_class_counts")
def _a19(spark, b):
    """Class counts after oversampling."""
    return class_counts(resampled(spark, b), "DefaultFlag")


def smote_forest(spark, b) -> M.Fitted:
    feats = training_frame(spark, b)[1]
    return _cached(spark, b, "smote_forest", lambda: M.train_forest(
        resampled(spark, b), feats, weight=None, name="RandomForest_SMOTE", **SMOTE_FOREST))


@register("m8_smote_forest_scores")
def _m8(spark, b):
    return M.score(smote_forest(spark, b), _test(spark, b), 0.5)


@register("s6_load_tables")
def _s6(spark, b):
    """The loan book written as typed Parquet tables and loaded back (full scans): Table, N."""
    root = scratch_path(spark, "loanbook")
    for name, df in b.tables().items():
        readers.as_table(df, schemas.BY_TABLE[name]).write.mode("overwrite").parquet(f"{root}/{name}.parquet")
    return Q.table_counts(readers.load_tables(spark, root, "parquet"))


# ---- scenarios with the fitted model ---------------------------------------------------------------

def model_stressed(spark, b) -> DataFrame:
    """Test rows once per macro scenario, macro columns replaced, rescored by the
    logistic model (it extrapolates to the scenario ranges; a forest cannot)."""
    lr = logistic(spark, b)
    test = _test(spark, b)

    def rescore(df: DataFrame) -> DataFrame:
        return M.score(lr, df, None, keep=["Scenario", "LoanID", "OutstandingAmount"])

    return R.apply_scenarios(test, rescore)


@register("r6_model_scenarios")
def _r6m(spark, b):
    return model_stressed(spark, b)


@register("r7_model_scenario_summary")
def _r7m(spark, b):
    """Scenario, MeanPD, ExpectedLossM (exposure = outstanding), PctVsBase under the logistic model."""
    return R.scenario_summary(model_stressed(spark, b), LGD, exposure="OutstandingAmount")


@register("a20_model_expected_loss")
def _a20m(spark, b):
    """Expected loss of the test split under the forest: SUM(PD x OutstandingAmount) x LGD."""
    sc = M.score(forest(spark, b), _test(spark, b), None, keep=["LoanID", "OutstandingAmount"])
    return R.expected_loss(sc, LGD)


@register("e9_model_eval_summary")
def _e9m(spark, b):
    """Evaluation summary of the forest on the test split (max-F1 threshold;
    DefaultRate over the whole feature table)."""
    enc, _ = training_frame(spark, b)
    sc = M.score(forest(spark, b), _test(spark, b), None)
    return E.eval_summary(sc, None, "RandomForest", population=enc)
