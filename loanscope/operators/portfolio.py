"""Portfolio aggregates: totals, status/grade mixes, industry/region views,
repayment behaviour, snapshot trend, correlations.

Scale notes
-----------
* Aggregates keyed by a *customer* attribute (industry, region) first reduce
  loans to one row per CustomerID (map-side partial aggregation), then join
  the customer table, then group by the attribute: the join sees at most one
  row per customer, and a customer holding a third of all loans collapses to
  one row before any exchange.
* Repayment aggregates reduce repayments to one row per LoanID before joining
  loans, for the same reason.
* Means are exact sums cast to double and divided once (``mean_of``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanscope.functions.columns import as_double, is_defaulted, mean_of, month_label, pct_round2, ratio


def loan_customer(loans: DataFrame, customers: DataFrame, kind: str = "left") -> DataFrame:
    """Loans joined to customers on CustomerID (inner or left)."""
    return loans.join(customers, "CustomerID", kind)


def portfolio_total(loans: DataFrame) -> DataFrame:
    """TotalLoanAmount, TotalLoans, AvgInterestRate."""
    return loans.agg(
        F.sum("LoanAmount").cast("double").alias("TotalLoanAmount"),
        F.count(F.lit(1)).alias("TotalLoans"),
        mean_of("InterestRate").alias("AvgInterestRate"),
    )


def status_distribution(loans: DataFrame) -> DataFrame:
    """Status, LoanCount, TotalAmount, AvgInterestRate, PctOfTotal (by LoanCount desc).

    The total comes from a window over the *grouped* rows (one per status), so
    it never touches the raw table twice and never moves raw rows.
    """
    g = loans.groupBy("Status").agg(
        F.count(F.lit(1)).alias("LoanCount"),
        F.sum("LoanAmount").cast("double").alias("TotalAmount"),
        mean_of("InterestRate").alias("AvgInterestRate"),
    )
    total = F.sum("LoanCount").over(Window.partitionBy())
    return (g.withColumn("PctOfTotal", pct_round2(F.col("LoanCount"), total))
            .orderBy(F.desc("LoanCount"), "Status"))


def grade_mix(loans: DataFrame) -> DataFrame:
    """RiskGradeAtOrigination, LoanCount, AvgIR, AvgLoan (by grade)."""
    return (loans.groupBy("RiskGradeAtOrigination").agg(
        F.count(F.lit(1)).alias("LoanCount"),
        mean_of("InterestRate").alias("AvgIR"),
        mean_of("LoanAmount").alias("AvgLoan"),
    ).orderBy("RiskGradeAtOrigination"))


def _loans_per_customer(loans: DataFrame) -> DataFrame:
    """One row per CustomerID with the partial sums every customer view needs."""
    return loans.groupBy("CustomerID").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count("LoanID").alias("_n_id"),
        F.sum("LoanAmount").alias("_amt"),
        F.count("LoanAmount").alias("_n_amt"),
        F.sum("InterestRate").alias("_ir"),
        F.count("InterestRate").alias("_n_ir"),
        F.sum(is_defaulted("Status")).alias("_def"),
    )


def _by_customer_attr(loans: DataFrame, customers: DataFrame, attr: str, how: str) -> DataFrame:
    per_cust = _loans_per_customer(loans)
    cust = customers.select("CustomerID", attr, "CreditScore")
    if how == "inner":
        joined = per_cust.join(cust, "CustomerID", "inner")
    else:  # left: loans without a customer keep a NULL attribute
        joined = per_cust.join(cust, "CustomerID", "left")
    return joined


def industry_loans(customers: DataFrame, loans: DataFrame) -> DataFrame:
    """Industry, NumLoans, AvgLoan, TotalDisbursed, AvgCreditScore (inner join; by TotalDisbursed desc).

    AvgCreditScore is loan-weighted, as AVG over the joined rows is.
    """
    j = _by_customer_attr(loans, customers, "Industry", "inner")
    scored_n = F.when(F.col("CreditScore").isNotNull(), F.col("_n"))
    return (j.groupBy("Industry").agg(
        F.sum("_n_id").alias("NumLoans"),
        F.try_divide(F.sum("_amt").cast("double"), F.sum("_n_amt").cast("double")).alias("AvgLoan"),
        F.sum("_amt").cast("double").alias("TotalDisbursed"),
        F.try_divide(F.sum(F.col("CreditScore") * F.col("_n")).cast("double"),
                     F.sum(scored_n).cast("double")).alias("AvgCreditScore"),
    ).orderBy(F.desc("TotalDisbursed"), "Industry"))


def region_default_rate(loans: DataFrame, customers: DataFrame) -> DataFrame:
    """Region, DefaultRate, NumLoans (inner join; by DefaultRate desc)."""
    j = _by_customer_attr(loans, customers, "Region", "inner")
    return (j.groupBy("Region").agg(
        F.try_divide(F.sum("_def").cast("double"), F.sum("_n").cast("double")).alias("DefaultRate"),
        F.sum("_n").alias("NumLoans"),
    ).orderBy(F.desc("DefaultRate"), "Region"))


def _repayments_per_loan(repayments: DataFrame) -> DataFrame:
    return repayments.groupBy("LoanID").agg(
        F.sum("DaysLate").alias("_late"),
        F.count("DaysLate").alias("_n_late"),
        F.sum("PaymentAmount").alias("_paid"),
        F.sum("DueAmount").alias("_due"),
    )


def delay_by_grade(repayments: DataFrame, loans: DataFrame) -> DataFrame:
    """RiskGradeAtOrigination, AvgDelay, NumLoans (distinct loans with repayments; by AvgDelay desc)."""
    j = _repayments_per_loan(repayments).join(
        loans.select("LoanID", "RiskGradeAtOrigination"), "LoanID", "inner")
    return (j.groupBy("RiskGradeAtOrigination").agg(
        F.try_divide(F.sum("_late").cast("double"), F.sum("_n_late").cast("double")).alias("AvgDelay"),
        F.count("LoanID").alias("NumLoans"),  # one row a loan: LoanID is the key of both sides
    ).orderBy(F.desc("AvgDelay"), "RiskGradeAtOrigination"))


def paid_ratio_by_status(repayments: DataFrame, loans: DataFrame) -> DataFrame:
    """Status, PaymentRatio = SUM(PaymentAmount) / SUM(DueAmount) (NULL when dues sum to 0)."""
    j = _repayments_per_loan(repayments).join(loans.select("LoanID", "Status"), "LoanID", "inner")
    return j.groupBy("Status").agg(ratio(F.sum("_paid"), F.sum("_due")).alias("PaymentRatio"))


def _loan_measures_by(loans: DataFrame, customers: DataFrame | None, key: str) -> DataFrame:
    """Group the left join loans->customers by ``key``, dropping NULL keys (pandas groupby)."""
    if customers is None:  # key is a loan column: the left join on a PK keeps loan rows 1:1
        per = loans.groupBy(key).agg(
            F.count(F.lit(1)).alias("_n"), F.count("LoanID").alias("_n_id"),
            F.sum("LoanAmount").alias("_amt"), F.count("LoanAmount").alias("_n_amt"),
            F.sum("InterestRate").alias("_ir"), F.count("InterestRate").alias("_n_ir"),
            F.sum(is_defaulted("Status")).alias("_def"), F.count("Status").alias("_n_status"))
    else:
        per_cust = loans.groupBy("CustomerID").agg(
            F.count(F.lit(1)).alias("_n"), F.count("LoanID").alias("_n_id"),
            F.sum("LoanAmount").alias("_amt"), F.count("LoanAmount").alias("_n_amt"),
            F.sum("InterestRate").alias("_ir"), F.count("InterestRate").alias("_n_ir"),
            F.sum(is_defaulted("Status")).alias("_def"), F.count("Status").alias("_n_status"))
        per = (per_cust.join(customers.select("CustomerID", key), "CustomerID", "left")
               .groupBy(key).agg(*[F.sum(c).alias(c) for c in
                                   ("_n", "_n_id", "_amt", "_n_amt", "_ir", "_n_ir", "_def", "_n_status")]))
    return per.filter(F.col(key).isNotNull())


def _default_rate() -> "F.Column":
    # pandas: (Status == 'Defaulted').mean() over all rows of the group
    return F.try_divide(F.col("_def").cast("double"), F.col("_n").cast("double"))


def grade_default(loans: DataFrame) -> DataFrame:
    """RiskGradeAtOrigination, DefaultRate, AvgInterest, AvgLoan (EDA risk-vs-default view)."""
    per = _loan_measures_by(loans, None, "RiskGradeAtOrigination")
    return per.select(
        "RiskGradeAtOrigination",
        _default_rate().alias("DefaultRate"),
        F.try_divide(F.col("_ir").cast("double"), F.col("_n_ir").cast("double")).alias("AvgInterest"),
        F.try_divide(F.col("_amt").cast("double"), F.col("_n_amt").cast("double")).alias("AvgLoan"),
    ).orderBy("RiskGradeAtOrigination")


def industry_portfolio(loans: DataFrame, customers: DataFrame) -> DataFrame:
    """Industry, TotalLoans, AvgLoan, DefaultRate (by TotalLoans desc)."""
    per = _loan_measures_by(loans, customers, "Industry")
    return per.select(
        "Industry",
        F.col("_n_id").alias("TotalLoans"),
        F.try_divide(F.col("_amt").cast("double"), F.col("_n_amt").cast("double")).alias("AvgLoan"),
        _default_rate().alias("DefaultRate"),
    ).orderBy(F.desc("TotalLoans"), "Industry")


def region_performance(loans: DataFrame, customers: DataFrame) -> DataFrame:
    """Region, NumLoans, DefaultRate, AvgInterestRate."""
    per = _loan_measures_by(loans, customers, "Region")
    return per.select(
        "Region",
        F.col("_n_id").alias("NumLoans"),
        _default_rate().alias("DefaultRate"),
        F.try_divide(F.col("_ir").cast("double"), F.col("_n_ir").cast("double")).alias("AvgInterestRate"),
    ).orderBy("Region")


def snapshot_trend(snapshots: DataFrame) -> DataFrame:
    """Month ('yyyy-MM'), AvgOutstanding, DefaultCount."""
    return (snapshots.groupBy(month_label("SnapshotDate").alias("Month")).agg(
        mean_of("OutstandingAmount").alias("AvgOutstanding"),
        F.sum("DefaultFlag").cast("long").alias("DefaultCount"),
    ).filter(F.col("Month").isNotNull()).orderBy("Month"))


# The columns of the correlation matrix.
CORR_COLUMNS = ["LoanAmount", "InterestRate", "CreditScore", "YearsInBusiness", "AnnualRevenue"]


def correlation_long(df: DataFrame, cols: list[str] = CORR_COLUMNS) -> DataFrame:
    """A, B, Corr — Pearson over pairwise-complete rows, all ordered pairs, one pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    aggs = [F.corr(as_double(a), as_double(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    wide = df.agg(*aggs)
    cells = []
    for a in cols:
        cells.append(F.struct(F.lit(a).alias("A"), F.lit(a).alias("B"), F.lit(1.0).alias("Corr")))
    for i, (a, b) in enumerate(pairs):
        cells.append(F.struct(F.lit(a).alias("A"), F.lit(b).alias("B"), F.col(f"c{i}").alias("Corr")))
        cells.append(F.struct(F.lit(b).alias("A"), F.lit(a).alias("B"), F.col(f"c{i}").alias("Corr")))
    return wide.select(F.inline(F.array(*cells)))


def label_rate(df: DataFrame, label: str = "DefaultFlag") -> DataFrame:
    """DefaultRate = mean of the 0/1 label."""
    return df.agg(mean_of(label).alias("DefaultRate"))


def class_counts(df: DataFrame, label: str = "DefaultFlag") -> DataFrame:
    """Label, N."""
    return df.groupBy(F.col(label).alias("Label")).agg(F.count(F.lit(1)).alias("N")).orderBy("Label")
