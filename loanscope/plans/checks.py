"""Checked companions of the model queries.

The fitted outputs themselves have no SQL twin; each query here boils one of
them down to numbers that DuckDB can derive from the raw tables: rows, and
violations that must be 0.  A violation is a broken identity (additivity, optimality,
equality with an independent computation) or a score that ranks no better than a floor,
so a constant or unfitted score is one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanscope.operators import explain as X
from loanscope.operators import metrics as E
from loanscope.operators import models as M
from loanscope.plans import catalog as C
from loanscope.plans.catalog import REGISTRY_RAW, register
from loanscope.plans.oracle import q

TOLERANCE = 1e-6
AUC_FLOOR = 0.7         # of every fitted model on the test rows
FLAT_GRADIENT = 1e-4    # of the penalised loss at its optimum


def _sums(phi: DataFrame) -> DataFrame:
    return phi.groupBy("LoanID").agg((F.sum("Phi") + F.first("BaseValue")).alias("total"))


def _off(df: DataFrame, broken) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("Loans"),
                  F.coalesce(F.sum(F.when(broken, 1).otherwise(0)), F.lit(0)).cast("long").alias("Violations"))


@register("chk_x1_additivity")
def _x1(spark, b):
    """TreeSHAP values of a loan sum to the forest's probability."""
    score = M.score(C.forest(spark, b), C.training_frame(spark, b)[0], None, keep=["LoanID"])
    j = _sums(REGISTRY_RAW["x1_tree_shap"](spark, b)).join(score, "LoanID")
    return _off(j, F.abs(F.col("total") - F.col("PredProb")) > TOLERANCE)


@register("chk_x2_additivity")
def _x2(spark, b):
    """Linear SHAP values of a loan sum to the logistic model's margin."""
    score = M.score(C.logistic(spark, b), C.training_frame(spark, b)[0], None, keep=["LoanID"])
    j = _sums(REGISTRY_RAW["x2_linear_shap"](spark, b)).join(score, "LoanID")
    return _off(j, F.abs(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("total"))) - F.col("PredProb")) > TOLERANCE)


@register("chk_k6_roundtrip")
def _k6(spark, b):
    """Test rows that the reloaded forest scores otherwise than the fitted one."""
    first = REGISTRY_RAW["m5_forest_scores"](spark, b).select("LoanID", F.col("PredProb").alias("p"))
    return _off(REGISTRY_RAW["k6_model_roundtrip"](spark, b).join(first, "LoanID"), F.col("p") != F.col("PredProb"))


@register("chk_m10_scores")
def _m10(spark, b):
    """Scored loans, and scores that are no probability."""
    df = REGISTRY_RAW["m10_score_all"](spark, b)
    return _off(df, F.col("PredProb").isNull() | ~F.col("PredProb").between(0, 1) | ~F.col("PredFlag").isin(0, 1))


@register("chk_m9_importances")
def _m9(spark, b):
    """Features, those whose importance differs from the model's own attribute, and those of the
    registered top 20 that stand in another place than there."""
    f = C.forest(spark, b)
    own = f.model.stages[-1].featureImportances.toArray().tolist()
    rows = spark.createDataFrame(list(zip(f.features, own)), "Feature string, Own double")
    off = M.importances(f, spark).join(rows, "Feature", "full").agg(
        F.count(F.lit(1)).alias("Features"), F.sum((~(F.abs(F.col("Own") - F.col("Importance")) <= 1e-9)).cast("int")).cast("long").alias("Violations"))
    order = sorted(zip(f.features, own), key=lambda x: (-round(x[1], 12), x[0]))[:20]
    top = [r["Feature"] for r in REGISTRY_RAW["m9_importances"](spark, b).collect()]
    return off.withColumn("Misplaced", F.lit(sum(a != c for (a, _), c in zip(order, top)) + abs(len(order) - len(top))).cast("long"))


@register("chk_m4_optimality")
def _m4o(spark, b):
    """Coefficients of the logistic model (intercept included), and those at which the penalised
    loss still has a slope."""
    g = M.logistic_gradient(C.logistic(spark, b), C._train_weighted(spark, b))
    return g.agg(F.count(F.lit(1)).alias("Features"), F.sum((~(F.abs("Gradient") <= FLAT_GRADIENT)).cast("int")).cast("long").alias("Violations"))


def _test_scores(name: str):
    def run(spark, b):
        df = REGISTRY_RAW[name](spark, b)
        auc = E.roc_auc(df.select("LoanID", "DefaultFlag", "PredProb")).first()[0]
        return _off(df, F.col("PredProb").isNull() | ~F.col("PredProb").between(0, 1)).withColumn(
            "BelowFloor", F.lit(0 if auc is not None and auc > AUC_FLOOR else 1).cast("long"))
    return run


for _n in ("m4_logistic_scores", "m4_all_features_scores", "m5_forest_scores", "m8_smote_forest_scores"):
    register(f"chk_{_n}")(_test_scores(_n))


@register("chk_m6_search")
def _m6(spark, b):
    """Rows of the search, distinct parameters, and points that rank no better than the floor."""
    df = REGISTRY_RAW["m6_random_search"](spark, b)
    return df.agg(F.count(F.lit(1)).alias("Points"), F.countDistinct("Params").alias("Different"),
                  F.sum((~(F.col("AvgAUC") > AUC_FLOOR)).cast("int")).cast("long").alias("Violations"))


@register("chk_m10_chosen")
def _m10c(spark, b):
    """Loans scored by the chosen model; those whose score or flag differs from that model's."""
    name, fitted = C._chosen(spark, b)
    own = M.score(fitted, C.training_frame(spark, b)[0], None, keep=["LoanID"]).withColumnRenamed("PredProb", "own")
    df = REGISTRY_RAW["m10_score_chosen"](spark, b).join(own, "LoanID")
    return _off(df, (F.col("PredProb") != F.col("own")) | ~F.col("PredFlag").isin(0, 1) | (F.col("Model") != name))


@register("chk_m11_comparison")
def _m11(spark, b):
    """Compared models, and those whose AUC differs from the exact one of their scores."""
    rows = {r["Model"]: r["AUC"] for r in REGISTRY_RAW["m11_model_comparison"](spark, b).collect()}
    own = {"LogisticRegression": "m4_logistic_scores", "RandomForest": "m5_forest_scores", "RandomForest_SMOTE": "m8_smote_forest_scores"}
    off = sum(abs(rows[k] - E.roc_auc(REGISTRY_RAW[q_](spark, b)).first()[0]) > 1e-9 for k, q_ in own.items())
    return spark.createDataFrame([(len(rows), off)], "Models long, Violations long")


@register("chk_k4_k5_exports")
def _k45(spark, b):
    """Model exports read back, and values in them that differ from the evaluation summary."""
    e = REGISTRY_RAW["e9_model_eval_summary"](spark, b).first().asDict()
    csv, js = (REGISTRY_RAW[n](spark, b).first().asDict() for n in ("k4_model_metrics_csv", "k5_model_eval_json"))
    named = {"ThresholdUsed": "Threshold"}
    base = E.point_metrics(REGISTRY_RAW["m4_logistic_scores"](spark, b), 0.5).first()["Accuracy"]
    e["accuracy_baseline"] = base
    near = lambda a, c: a == c if isinstance(a, (str, int)) else abs(a - c) <= 1e-9
    off = sum(not near(v, e[named.get(k, k)]) for r in (csv, js) for k, v in r.items())
    return spark.createDataFrame([(2, off)], "Exports long, Violations long")


@register("chk_x1_background")
def _x1b(spark, b):
    """Attributions against the background sum to the score less the background's mean score."""
    f = C.forest(spark, b)
    base = M.score(f, C.background(spark, b), None).agg(F.avg("PredProb")).first()[0]
    score = M.score(f, C.training_frame(spark, b)[0], None, keep=["LoanID"])
    rows = C._background_phi(spark, b).select("LoanID", "BaseValue", F.aggregate("Phis", F.lit(0.0), lambda a, x: a + x).alias("phi"))
    return _off(rows.join(score, "LoanID"), (F.abs(F.col("phi") + F.lit(base) - F.col("PredProb")) > TOLERANCE)
                | (F.abs(F.col("BaseValue") - F.lit(base)) > TOLERANCE))


@register("chk_x4_dependence")
def _x4(spark, b):
    """Loans in the binned dependence, and bins whose mean attribution differs from that of their loans."""
    bins = REGISTRY_RAW["x4_dependence_bins"](spark, b)
    one = REGISTRY_RAW["x4_dependence"](spark, b)
    lo, hi = one.agg(F.min("Value"), F.max("Value")).first()
    place = F.least(F.floor((F.col("Value") - lo) / ((hi - lo) / C.DEPENDENCE_BINS)), F.lit(C.DEPENDENCE_BINS - 1)).cast("int")
    own = one.groupBy(place.alias("Bin")).agg(F.avg("Phi").alias("own"), F.count(F.lit(1)).alias("OwnN"))
    return bins.join(own, "Bin", "full").agg(F.sum("OwnN").cast("long").alias("Loans"), F.sum((~(
        (F.abs(F.col("Phi") - F.col("own")) <= 1e-9) & (F.col("N") == F.col("OwnN")))).cast("int")).cast("long").alias("Violations"))


@register("chk_r6_model_scenarios")
def _r6(spark, b):
    """Rows and rows without a score, per scenario."""
    df = REGISTRY_RAW["r6_model_scenarios"](spark, b)
    return df.groupBy("Scenario").agg(F.count(F.lit(1)).alias("Loans"), F.sum(
        F.when(F.col("PredProb").isNull(), 1).otherwise(0)).cast("long").alias("Violations"))


@register("chk_x3_features")
def _x3(spark, b):
    """Features of the summary, and those whose mean |phi| differs from the long form's."""
    own = X.shap_summary(REGISTRY_RAW["x1_tree_shap"](spark, b)).withColumnRenamed("MeanAbsPhi", "own")
    return REGISTRY_RAW["x3_shap_summary"](spark, b).join(own, "Feature", "full").agg(
        F.count(F.lit(1)).alias("Features"), F.sum((~(F.abs(F.col("MeanAbsPhi") - F.col("own")) <= 1e-9)).cast("int")).cast("long").alias("Violations"))


_ALL = "SELECT COUNT(*) AS Loans, CAST(0 AS BIGINT) AS Violations FROM v_base"
_TEST = "SELECT COUNT(*) AS Loans, CAST(0 AS BIGINT) AS Violations FROM v_split WHERE IsTest = 1"
_FLOOR = _TEST.replace(" FROM", ", CAST(0 AS BIGINT) AS BelowFloor FROM")
# 16 numeric features that do not leak, and the one-hot columns without each first level.
_FEATURES = """16 + (SELECT COUNT(DISTINCT Industry) - 1 FROM v_customers) + (SELECT COUNT(DISTINCT Region) - 1
FROM v_customers) + (SELECT COUNT(DISTINCT RiskGradeAtOrigination) - 1 FROM v_loans) + 3"""
_SQL = {
    "chk_x1_additivity": _ALL, "chk_x2_additivity": _ALL, "chk_m10_scores": _ALL, "chk_k6_roundtrip": _TEST,
    "chk_x1_background": _ALL, "chk_m10_chosen": _ALL, "chk_x4_dependence": _ALL,
    "chk_m4_logistic_scores": _FLOOR, "chk_m4_all_features_scores": _FLOOR, "chk_m5_forest_scores": _FLOOR,
    "chk_m8_smote_forest_scores": _FLOOR,
    "chk_m4_optimality": f"SELECT CAST({_FEATURES} + 1 AS BIGINT) AS Features, CAST(0 AS BIGINT) AS Violations",
    "chk_m6_search": f"SELECT CAST({C.SEARCH_N_ITER} AS BIGINT) AS Points, CAST({C.SEARCH_N_ITER} AS BIGINT) AS Different, CAST(0 AS BIGINT) AS Violations",
    "chk_m9_importances": f"SELECT CAST({_FEATURES} AS BIGINT) AS Features, CAST(0 AS BIGINT) AS Violations, CAST(0 AS BIGINT) AS Misplaced",
    "chk_m11_comparison": "SELECT CAST(3 AS BIGINT) AS Models, CAST(0 AS BIGINT) AS Violations",
    "chk_k4_k5_exports": "SELECT CAST(2 AS BIGINT) AS Exports, CAST(0 AS BIGINT) AS Violations",
    "chk_r6_model_scenarios": "SELECT Scenario, COUNT(*) AS Loans, CAST(0 AS BIGINT) AS Violations FROM v_split CROSS JOIN "
                              "(VALUES ('Base Case'), ('Mild Stress'), ('Severe Stress'), ('Recovery')) AS n(Scenario) "
                              "WHERE IsTest = 1 GROUP BY Scenario",
    "chk_x3_features": f"SELECT CAST({_FEATURES} AS BIGINT) AS Features, CAST(0 AS BIGINT) AS Violations",
}


def oracle() -> dict[str, str]:
    return {k: q(v) for k, v in _SQL.items()}
