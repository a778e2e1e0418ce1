"""Feature table: one row per loan (loan + customer + repayment aggregate +
latest snapshot + origination-month macro), ratios, ages, bands, one-hot.

Plan shape at scale
-------------------
Repayments and snapshots are each reduced to one row per LoanID (partial
aggregation map-side, so a hot loan is one row before the exchange); the two
LoanID joins share the loans' LoanID partitioning.  The customer join is left
to AQE (broadcast when the runtime size is small, sort-merge otherwise, skew
split on).  The macro table is one row per calendar month, a bound fixed by
the calendar, and is broadcast explicitly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanscope.functions.columns import (
    credit_score_band, guarded_ratio, mean_of, month_start, months_of_30_days,
    non_negative, plus_one_ratio,
)
from loanscope.session import written

SNAPSHOT_FIELDS = ["OutstandingAmount", "PastDueDays", "CumulativePayments", "DefaultFlag"]
MACRO_FIELDS = ["InflationRate", "GDPGrowthRate", "CentralBankInterestRate"]


def repayment_agg(repayments: DataFrame) -> DataFrame:
    """LoanID, NumPayments, AvgDaysLate, TotalPaid, PaymentRatio (in-database aggregate of the model job)."""
    return repayments.groupBy("LoanID").agg(
        F.count(F.lit(1)).alias("NumPayments"),
        mean_of("DaysLate").alias("AvgDaysLate"),
        F.sum("PaymentAmount").alias("TotalPaid"),
        guarded_ratio(F.sum("PaymentAmount"), F.sum("DueAmount")).alias("PaymentRatio"),
    )


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """LoanID + snapshot fields of the latest SnapshotDate per loan.

    ``max(struct(date, fields...))`` is a deterministic arg-max that
    aggregates partially on the map side (no per-loan sort, no window).
    Ties on the date resolve to the larger field tuple.
    """
    best = F.max(F.struct("SnapshotDate", *SNAPSHOT_FIELDS)).alias("_s")
    return snapshots.groupBy("LoanID").agg(best).select(
        "LoanID", *[F.col(f"_s.{c}").alias(c) for c in SNAPSHOT_FIELDS])


def label_table(loans: DataFrame, snapshots: DataFrame) -> DataFrame:
    """LoanID and DefaultFlag of every loan, as in ``base_table`` but from the loans and
    their latest snapshots alone."""
    return labels_of(join_latest_snapshot(loans.select("LoanID"), snapshots))


def join_repayments(loans: DataFrame, agg: DataFrame) -> DataFrame:
    return loans.join(agg, "LoanID", "left")


def join_latest_snapshot(loans: DataFrame, snapshots: DataFrame) -> DataFrame:
    return loans.join(latest_snapshot(snapshots), "LoanID", "left")


def join_macro(loans: DataFrame, macro: DataFrame) -> DataFrame:
    """Exact month equi-join on the origination month; macro is broadcast
    (one row per calendar month: ~12 rows a year, whatever the loan volume)."""
    m = macro.select(month_start("MonthDate").alias("_month"), *MACRO_FIELDS)
    return (loans.withColumn("_month", month_start("OriginationDate"))
            .join(F.broadcast(m), "_month", "left").drop("_month"))


BASE_COLUMNS = [
    "LoanID", "CustomerID", "LoanAmount", "InterestRate", "TermMonths", "OriginationDate", "Status",
    "RiskGradeAtOrigination", "Industry", "Region", "YearsInBusiness", "AnnualRevenue", "CreditScore",
    "NumPayments", "AvgDaysLate", "TotalPaid", "PaymentRatio",
    "OutstandingAmount", "PastDueDays", "CumulativePayments", "DefaultFlag",
    "InflationRate", "GDPGrowthRate", "CentralBankInterestRate",
]


def loan_history(loans: DataFrame, repayments: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Every loan with its repayment aggregate and latest snapshot: the part of the base table
    that reads the large tables, one row per row of ``loans``."""
    l = loans.select("LoanID", "CustomerID", "LoanAmount", "InterestRate", "TermMonths",
                     "OriginationDate", "Status", "RiskGradeAtOrigination")
    return join_latest_snapshot(join_repayments(l, repayment_agg(repayments)), snapshots)


def stored_history(loans: DataFrame, repayments: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``loan_history`` written once, for readers of some columns and for what is joined to it."""
    return written(loan_history(loans, repayments, snapshots), "loan-history")


def labels_of(by_loan: DataFrame) -> DataFrame:
    """LoanID and DefaultFlag, as in ``label_table``, of a ``loan_history``."""
    return by_loan.select("LoanID", F.coalesce("DefaultFlag", F.lit(0)).cast("int").alias("DefaultFlag"))


def base_table(loans: DataFrame, customers: DataFrame, repayments: DataFrame,
               snapshots: DataFrame, macro: DataFrame) -> DataFrame:
    """One row per loan, NULL-filled as the model job does (see ``completed``)."""
    return completed(loan_history(loans, repayments, snapshots), customers, macro)


def completed(by_loan: DataFrame, customers: DataFrame, macro: DataFrame) -> DataFrame:
    """The base table from a ``loan_history``: customer and origination-month macro joined, NULLs filled.

    Fills: NumPayments/AvgDaysLate/TotalPaid/PaymentRatio/PastDueDays/
    CumulativePayments/DefaultFlag -> 0; OutstandingAmount -> LoanAmount.
    Macro columns and AnnualRevenue stay NULL when absent.
    """
    cust = customers.select("CustomerID", "Industry", "Region", "YearsInBusiness", "AnnualRevenue", "CreditScore")
    wide = join_macro(by_loan.join(cust, "CustomerID", "left"), macro)
    zero_dec = F.lit(0).cast("decimal(18,2)")
    filled = (wide
              .withColumn("NumPayments", F.coalesce("NumPayments", F.lit(0)).cast("int"))
              .withColumn("AvgDaysLate", F.coalesce("AvgDaysLate", F.lit(0.0)))
              .withColumn("TotalPaid", F.coalesce(F.col("TotalPaid"), zero_dec))
              .withColumn("PaymentRatio", F.coalesce("PaymentRatio", F.lit(0.0)))
              .withColumn("OutstandingAmount", F.coalesce(F.col("OutstandingAmount"), F.col("LoanAmount")))
              .withColumn("PastDueDays", F.coalesce("PastDueDays", F.lit(0)).cast("int"))
              .withColumn("CumulativePayments", F.coalesce(F.col("CumulativePayments"), zero_dec))
              .withColumn("DefaultFlag", F.coalesce("DefaultFlag", F.lit(0)).cast("int")))
    return filled.select(*BASE_COLUMNS)


def add_features(base: DataFrame, as_of: str) -> DataFrame:
    """Ratios, loan age in 30-day months, months since last payment, score band."""
    return (base
            .withColumn("LoanToRevenue", plus_one_ratio("LoanAmount", "AnnualRevenue"))
            .withColumn("PaymentCoverage", plus_one_ratio("TotalPaid", "LoanAmount"))
            .withColumn("RemainingRatio", plus_one_ratio("OutstandingAmount", "LoanAmount"))
            .withColumn("LoanAgeMonths", months_of_30_days("OriginationDate", as_of))
            .withColumn("MonthsSinceLastPayment", non_negative(F.col("LoanAgeMonths") - F.col("NumPayments")))
            .withColumn("CreditScoreBand", credit_score_band("CreditScore")))


# Categorical columns and the order of the score-band levels.
CATEGORICAL = ["Industry", "Region", "RiskGradeAtOrigination", "CreditScoreBand"]
BAND_ORDER = ["Low", "Med", "High", "VeryHigh"]

# The model's numeric features, in order.
NUMERIC_FEATURES = [
    "LoanAmount", "InterestRate", "TermMonths", "YearsInBusiness", "AnnualRevenue", "CreditScore",
    "NumPayments", "AvgDaysLate", "PaymentRatio", "OutstandingAmount", "PastDueDays", "CumulativePayments",
    "LoanToRevenue", "PaymentCoverage", "RemainingRatio", "LoanAgeMonths", "MonthsSinceLastPayment",
    "InflationRate", "GDPGrowthRate", "CentralBankInterestRate",
]
# same-row-as-label snapshot fields (the label leaks through them)
LEAKY_FEATURES = ["OutstandingAmount", "PastDueDays", "CumulativePayments", "RemainingRatio"]


#: Levels that a categorical column may have; each becomes a feature.
MAX_LEVELS = 1_000


def fit_levels(df: DataFrame, cols: list[str] = CATEGORICAL) -> dict[str, list[str]]:
    """Sorted distinct levels per categorical column (the band in its own order).

    One distributed distinct over (column, level), of which no more than the allowed
    number of rows ever reaches the driver; a column with more levels is an error.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("level")) for c in cols])
    found = df.select(F.inline(cells)).where("level IS NOT NULL").distinct().limit(MAX_LEVELS * len(cols) + 1).collect()
    levels = {c: sorted((r.level for r in found if r.c == c), key=lambda x: x.encode()) for c in cols}
    wide = {c: len(v) for c, v in levels.items() if len(v) > MAX_LEVELS}
    if wide:
        raise ValueError(f"columns with more than {MAX_LEVELS} levels cannot be one-hot encoded: {wide}")
    if "CreditScoreBand" in levels:
        levels["CreditScoreBand"] = list(BAND_ORDER)  # ordered category: absent bands keep their column
    return levels


def one_hot(df: DataFrame, levels: dict[str, list[str]]) -> tuple[DataFrame, list[str]]:
    """``<col>_<level>`` 0/1 columns, first level dropped; NULL -> all zeros."""
    names: list[str] = []
    exprs = []
    for c, lv in levels.items():
        for level in lv[1:]:
            name = f"{c}_{level}"
            names.append(name)
            exprs.append(F.coalesce((F.col(c) == F.lit(level)).cast("int"), F.lit(0)).alias(name))
    return df.select("*", *exprs), names


def feature_columns(df: DataFrame, encoded: list[str], drop_leaky: bool = False) -> list[str]:
    cols = [c for c in NUMERIC_FEATURES + encoded if c in df.columns]
    if drop_leaky:
        cols = [c for c in cols if c not in LEAKY_FEATURES]
    return cols
