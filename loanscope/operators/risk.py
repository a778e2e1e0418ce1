"""Portfolio risk products: expected loss, KPIs, segment views, score
distribution, segment lift, macro scenarios, early-warning lateness, top-k."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanscope.functions.columns import as_double, credit_score_band, score_bin
from loanscope.sources.fixtures import BASE_SCENARIO, SCENARIOS

LGD = 0.6  # fixed value: loss given default


def _el_sum(pd: str, exposure: str) -> Column:
    """SUM(pd * exposure): exact when both are decimals, double otherwise."""
    return F.sum(F.col(pd) * F.col(exposure))


def _lgd_lit(lgd: float) -> Column:
    return F.lit(Decimal(str(lgd)))


def expected_loss(sc: DataFrame, lgd: float = LGD, pd: str = "PredProb",
                  exposure: str = "OutstandingAmount") -> DataFrame:
    """ExpectedLoss = SUM(PD x exposure) x LGD."""
    return sc.agg((as_double(_el_sum(pd, exposure) * _lgd_lit(lgd))).alias("ExpectedLoss"))


def kpis(sc: DataFrame, lgd: float = LGD, label: str = "DefaultFlag", pd: str = "PredProb",
         exposure: str = "LoanAmount") -> DataFrame:
    """DefaultRate, ExpectedLoss, N over the scored portfolio."""
    return sc.agg(
        F.try_divide(F.sum(F.col(label).cast("long")).cast("double"), F.count(label).cast("double")).alias("DefaultRate"),
        as_double(_el_sum(pd, exposure) * _lgd_lit(lgd)).alias("ExpectedLoss"),
        F.count(F.lit(1)).alias("N"),
    )


def risk_by(sc: DataFrame, dim: str, lgd: float = LGD, label: str = "DefaultFlag", pd: str = "PredProb",
            exposure: str = "LoanAmount") -> DataFrame:
    """dim, N, Defaults, DefaultRate, ExpectedLoss (by ExpectedLoss desc)."""
    return (sc.groupBy(dim).agg(
        F.count(F.lit(1)).alias("N"),
        F.sum(F.col(label).cast("long")).alias("Defaults"),
        F.try_divide(F.sum(F.col(label).cast("long")).cast("double"), F.count(label).cast("double")).alias("DefaultRate"),
        as_double(_el_sum(pd, exposure) * _lgd_lit(lgd)).alias("ExpectedLoss"),
    ).orderBy(F.desc("ExpectedLoss"), dim))


def score_distribution(customers: DataFrame, by: str = "band", width: int = 50) -> DataFrame:
    """Band (credit-score band) or Bin (fixed-width score bin), N."""
    name = "Band" if by == "band" else "Bin"
    key = credit_score_band("CreditScore") if by == "band" else score_bin("CreditScore", width)
    return customers.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("N")).orderBy(name)


def sector_averages(loans: DataFrame, customers: DataFrame) -> DataFrame:
    """Industry, AvgLoan, AvgRate (loan-level means per sector; loans pre-aggregated per customer)."""
    per = loans.groupBy("CustomerID").agg(
        F.sum("LoanAmount").alias("_amt"), F.count("LoanAmount").alias("_n_amt"),
        F.sum("InterestRate").alias("_ir"), F.count("InterestRate").alias("_n_ir"))
    j = per.join(customers.select("CustomerID", "Industry"), "CustomerID", "inner")
    return (j.groupBy("Industry").agg(
        F.try_divide(F.sum("_amt").cast("double"), F.sum("_n_amt").cast("double")).alias("AvgLoan"),
        F.try_divide(F.sum("_ir").cast("double"), F.sum("_n_ir").cast("double")).alias("AvgRate"),
    ).orderBy("Industry"))


def segment_lift(feats: DataFrame, ltr: float = 0.4, late: float = 10.0, label: str = "DefaultFlag") -> DataFrame:
    """InSegment (LoanToRevenue > ltr and AvgDaysLate > late), N, DefaultRate, Lift vs the other group."""
    seg = F.coalesce((F.col("LoanToRevenue") > F.lit(ltr)) & (F.col("AvgDaysLate") > F.lit(late)), F.lit(False))
    g = feats.groupBy(seg.cast("int").alias("InSegment")).agg(
        F.count(F.lit(1)).alias("N"),
        F.try_divide(F.sum(F.col(label).cast("long")).cast("double"), F.count(label).cast("double")).alias("DefaultRate"))
    both = Window.partitionBy()  # over the <= 2 grouped rows
    rate_in = F.max(F.when(F.col("InSegment") == 1, F.col("DefaultRate"))).over(both)
    rate_out = F.max(F.when(F.col("InSegment") == 0, F.col("DefaultRate"))).over(both)
    other = F.when(F.col("InSegment") == 1, rate_out).otherwise(rate_in)
    return g.withColumn("Lift", F.try_divide(F.col("DefaultRate"), other)).orderBy("InSegment")


def scenario_frame_column(scenarios: list[tuple[str, float, float, float]] = SCENARIOS) -> Column:
    """The scenario list as a literal array of structs (exact decimals), for ``explode``."""
    return F.array(*[
        F.struct(F.lit(name).alias("Scenario"),
                 F.lit(Decimal(str(inf))).alias("InflationRate"),
                 F.lit(Decimal(str(gdp))).alias("GDPGrowthRate"),
                 F.lit(Decimal(str(rate))).alias("CentralBankInterestRate"))
        for name, inf, gdp, rate in scenarios])


def apply_scenarios(df: DataFrame, score_fn: Callable[[DataFrame], DataFrame],
                    scenarios: list[tuple[str, float, float, float]] = SCENARIOS) -> DataFrame:
    """Each row once per scenario, macro columns replaced, then rescored.

    The scenario list is a literal (a handful of rows) exploded in place: every
    row is copied locally, no join and no shuffle.
    """
    macro = ["InflationRate", "GDPGrowthRate", "CentralBankInterestRate"]
    keep = [c for c in df.columns if c not in macro]
    x = df.select(*keep, F.explode(scenario_frame_column(scenarios)).alias("_scn"))
    x = x.select(*keep, *[F.col(f"_scn.{c}").alias(c) for c in ["Scenario"] + macro])
    return score_fn(x)


def stress_scorecard(df: DataFrame) -> DataFrame:
    """Scenario-sensitive scorecard of the fixtures: base PD shifted by 0.01 per
    macro point away from the base case, clipped to [0, 1], in DECIMAL(6,3)."""
    shift = ("CAST(((InflationRate - 5.0) + (6.2 - GDPGrowthRate) + (CentralBankInterestRate - 6.5)) * 0.010 "
             "AS DECIMAL(6,3))")
    pd = F.expr(f"CAST(LEAST(GREATEST(CAST(PredProb AS DECIMAL(6,3)) + {shift}, 0), 1) AS DECIMAL(6,3))")
    return df.withColumn("PredProb", pd)


def scenario_summary(stressed: DataFrame, lgd: float = LGD, pd: str = "PredProb", exposure: str = "LoanAmount",
                     base: str = BASE_SCENARIO) -> DataFrame:
    """Scenario, MeanPD, ExpectedLossM (EL in millions), PctVsBase."""
    g = stressed.groupBy("Scenario").agg(
        F.try_divide(F.sum(pd).cast("double"), F.count(pd).cast("double")).alias("MeanPD"),
        (as_double(_el_sum(pd, exposure) * _lgd_lit(lgd)) / F.lit(1e6)).alias("ExpectedLossM"))
    base_el = F.max(F.when(F.col("Scenario") == F.lit(base), F.col("ExpectedLossM"))).over(Window.partitionBy())
    return (g.withColumn("PctVsBase", F.try_divide((F.col("ExpectedLossM") - base_el) * F.lit(100.0), base_el))
            .orderBy("Scenario"))


def rising_lateness(repayments: DataFrame, window_months: int = 3) -> DataFrame:
    """LoanID, Month, AvgDaysLate, PriorAvgDaysLate, Delta for loan-months whose
    lateness exceeds the payment-weighted mean of the previous ``window_months``
    active months (early warning).  Per-loan windows hold one row per month."""
    m = repayments.groupBy("LoanID", F.trunc("PaymentDate", "MM").alias("Month")).agg(
        F.sum("DaysLate").alias("_late"), F.count("DaysLate").alias("_n"))
    prior = Window.partitionBy("LoanID").orderBy("Month").rowsBetween(-window_months, -1)
    out = m.select(
        "LoanID", "Month",
        F.try_divide(F.col("_late").cast("double"), F.col("_n").cast("double")).alias("AvgDaysLate"),
        F.try_divide(F.sum("_late").over(prior).cast("double"), F.sum("_n").over(prior).cast("double"))
        .alias("PriorAvgDaysLate"))
    return (out.withColumn("Delta", F.col("AvgDaysLate") - F.col("PriorAvgDaysLate"))
            .filter(F.col("Delta") > 0))


def top_risk(sc: DataFrame, n: int = 20, pd: str = "PredProb", key: str = "LoanID") -> DataFrame:
    """The n highest-PD loans (ties by key): a top-k, planned as TakeOrderedAndProject."""
    return sc.orderBy(F.desc(pd), F.asc(key)).limit(n)


def with_customer_dims(sc: DataFrame, customers: DataFrame) -> DataFrame:
    """Scored rows + Region, Industry of their customer (left join on CustomerID)."""
    return sc.join(customers.select("CustomerID", "Region", "Industry"), "CustomerID", "left")


def align_scores(base: DataFrame, sc: DataFrame, key: str = "LoanID") -> DataFrame:
    """Base rows aligned with their scores by key (Spark rows have no positional
    index); an unscored row stays, with a NULL score."""
    return base.join(sc, key, "left")
