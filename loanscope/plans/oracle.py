"""DuckDB-runnable SQL for each catalogue entry (the correctness oracle).

Each statement is prefixed with exactly the fixture CTEs it references
(``with_views``), since the oracle only has the raw tables.  Output columns
carry the same names and portable types as the Spark side: DOUBLE for money
and ratios, BIGINT/INT counts, ISO strings for dates and timestamps.
"""

from __future__ import annotations

from loanscope.functions.columns import portable_hash_sql
from loanscope.operators import quality as Q
from loanscope.plans import catalog as C
from loanscope.sources.fixtures import AS_OF, with_views

D = "DOUBLE"

# Oracle-only derived views (dependency order matters only through name references).
EXTRA: dict[str, str] = {
    "v_rep_agg": """
SELECT LoanID, COUNT(*) AS NumPayments, CAST(SUM(DaysLate) AS DOUBLE) / COUNT(DaysLate) AS AvgDaysLate,
  SUM(PaymentAmount) AS TotalPaid,
  CASE WHEN SUM(DueAmount) = 0 THEN 0 ELSE CAST(SUM(PaymentAmount) AS DOUBLE) / CAST(SUM(DueAmount) AS DOUBLE) END AS PaymentRatio
FROM v_repayments GROUP BY LoanID""",
    "v_last_snap": """
SELECT LoanID, OutstandingAmount, PastDueDays, CumulativePayments, DefaultFlag FROM v_snapshots
QUALIFY row_number() OVER (PARTITION BY LoanID ORDER BY SnapshotDate DESC, OutstandingAmount DESC,
  PastDueDays DESC, CumulativePayments DESC, DefaultFlag DESC) = 1""",
    "v_base": """
SELECT l.LoanID, l.CustomerID, l.LoanAmount, l.InterestRate, l.TermMonths, l.OriginationDate, l.Status,
  l.RiskGradeAtOrigination, c.Industry, c.Region, c.YearsInBusiness, c.AnnualRevenue, c.CreditScore,
  CAST(COALESCE(rp.NumPayments, 0) AS INT) AS NumPayments, COALESCE(rp.AvgDaysLate, 0) AS AvgDaysLate,
  COALESCE(rp.TotalPaid, 0) AS TotalPaid, COALESCE(rp.PaymentRatio, 0) AS PaymentRatio,
  COALESCE(s.OutstandingAmount, l.LoanAmount) AS OutstandingAmount, CAST(COALESCE(s.PastDueDays, 0) AS INT) AS PastDueDays,
  COALESCE(s.CumulativePayments, 0) AS CumulativePayments, CAST(COALESCE(s.DefaultFlag, 0) AS INT) AS DefaultFlag,
  m.InflationRate, m.GDPGrowthRate, m.CentralBankInterestRate
FROM v_loans l LEFT JOIN v_customers c ON l.CustomerID = c.CustomerID
LEFT JOIN v_rep_agg rp ON rp.LoanID = l.LoanID
LEFT JOIN v_last_snap s ON s.LoanID = l.LoanID
LEFT JOIN v_macro m ON date_trunc('month', l.OriginationDate) = date_trunc('month', m.MonthDate)""",
    "v_split": f"""
SELECT *, CASE WHEN row_number() OVER (PARTITION BY DefaultFlag ORDER BY {portable_hash_sql('LoanID', 42)}, LoanID)
  <= CEIL(CAST(0.2 AS DOUBLE) * COUNT(*) OVER (PARTITION BY DefaultFlag)) THEN 1 ELSE 0 END AS IsTest
FROM v_base""",
    "v_feat": f"""
SELECT *, CAST(LoanAmount AS DOUBLE) / (CAST(AnnualRevenue AS DOUBLE) + 1) AS LoanToRevenue,
  CAST(TotalPaid AS DOUBLE) / (CAST(LoanAmount AS DOUBLE) + 1) AS PaymentCoverage,
  CAST(OutstandingAmount AS DOUBLE) / (CAST(LoanAmount AS DOUBLE) + 1) AS RemainingRatio,
  CAST(trunc(CAST(date_diff('day', OriginationDate, DATE '{AS_OF}') AS DOUBLE) / 30) AS INT) AS LoanAgeMonths,
  CASE WHEN CAST(trunc(CAST(date_diff('day', OriginationDate, DATE '{AS_OF}') AS DOUBLE) / 30) AS INT) - NumPayments IS NULL THEN NULL
       ELSE GREATEST(0, CAST(trunc(CAST(date_diff('day', OriginationDate, DATE '{AS_OF}') AS DOUBLE) / 30) AS INT) - NumPayments) END
    AS MonthsSinceLastPayment,
  CASE WHEN CreditScore > 299 AND CreditScore <= 600 THEN 'Low' WHEN CreditScore > 600 AND CreditScore <= 660 THEN 'Med'
       WHEN CreditScore > 660 AND CreditScore <= 720 THEN 'High' WHEN CreditScore > 720 AND CreditScore <= 900 THEN 'VeryHigh'
  END AS CreditScoreBand
FROM v_base""",
    "v_hist": """
SELECT CAST(PredProb AS DOUBLE) AS sp, CAST(SUM(CASE WHEN DefaultFlag = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
  CAST(SUM(CASE WHEN DefaultFlag = 1 THEN 0 ELSE 1 END) AS BIGINT) AS neg
FROM v_scored WHERE PredProb IS NOT NULL AND DefaultFlag IS NOT NULL GROUP BY 1""",
    "v_cum": """
SELECT sp, pos, neg,
  COALESCE(SUM(pos) OVER (ORDER BY sp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb,
  COALESCE(SUM(neg) OVER (ORDER BY sp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb,
  SUM(pos) OVER () AS tpos, SUM(neg) OVER () AS tneg
FROM v_hist""",
    "v_curve": """
SELECT sp AS Threshold, CAST(tpos - pb AS DOUBLE) / CAST(tpos - pb + tneg - nb AS DOUBLE) AS Precision,
  CASE WHEN tpos = 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(tpos - pb AS DOUBLE) / CAST(tpos AS DOUBLE) END AS Recall
FROM v_cum""",
    "v_best": """
SELECT Threshold, Precision, Recall, 2 * Precision * Recall / (Precision + Recall + 1e-9) AS F1
FROM v_curve ORDER BY F1 DESC, Threshold ASC LIMIT 1""",
    "v_counts": """
SELECT CAST(SUM(CASE WHEN DefaultFlag = 1 AND PredProb >= t THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(SUM(CASE WHEN DefaultFlag = 0 AND PredProb >= t THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(SUM(CASE WHEN DefaultFlag = 1 AND NOT (PredProb >= t) THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(SUM(CASE WHEN DefaultFlag = 0 AND NOT (PredProb >= t) THEN 1 ELSE 0 END) AS BIGINT) AS tn
FROM v_scored, (SELECT COALESCE((SELECT Threshold FROM v_best), 0.5) AS t) th""",
    "v_scored_base": """
SELECT b.*, s.PredProb FROM v_base b JOIN v_scored s ON s.LoanID = b.LoanID""",
}


def q(body: str) -> str:
    return with_views(body, EXTRA)


def _rules_sql(table: str, rules: list[Q.Rule]) -> str:
    parts = [f"SELECT '{r.name}' AS Rule, CAST(COALESCE(SUM(CASE WHEN NOT COALESCE({r.sql}, TRUE) THEN 1 ELSE 0 END), 0) AS BIGINT) AS Violations FROM {table}"
             for r in rules]
    return "\nUNION ALL\n".join(parts)


def _corr_sql() -> str:
    cols = ["LoanAmount", "InterestRate", "CreditScore", "YearsInBusiness", "AnnualRevenue"]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    aggs = ", ".join(f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS c{i}" for i, (a, b) in enumerate(pairs))
    rows = [f"SELECT '{a}' AS A, '{a}' AS B, CAST(1.0 AS DOUBLE) AS Corr" for a in cols]
    for i, (a, b) in enumerate(pairs):
        rows.append(f"SELECT '{a}' AS A, '{b}' AS B, ROUND(c{i}, 10) AS Corr FROM k")
        rows.append(f"SELECT '{b}' AS A, '{a}' AS B, ROUND(c{i}, 10) AS Corr FROM k")
    return (f"WITH k AS (SELECT {aggs} FROM v_loans l LEFT JOIN v_customers c ON l.CustomerID = c.CustomerID)\n"
            + "\nUNION ALL\n".join(rows))


def _one_hot_sql() -> str:
    # The category levels of the fixture book (first level dropped).
    levels = {
        "Industry": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
        "Region": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"],
        "RiskGradeAtOrigination": ["A", "B", "C", "D", "E"],
        "CreditScoreBand": ["Low", "Med", "High", "VeryHigh"],
    }
    cols = [f"CASE WHEN {c} = '{lv}' THEN 1 ELSE 0 END AS \"{c}_{lv}\"" for c, lvs in levels.items() for lv in lvs[1:]]
    return "SELECT LoanID, " + ", ".join(cols) + " FROM v_feat"


def _calibration_sql(bins: int = 10) -> str:
    step = 1.0 / bins
    case = "CASE " + " ".join(f"WHEN CAST(PredProb AS DOUBLE) > {k * step!r} THEN {k}" for k in range(bins - 1, 0, -1)) + " ELSE 0 END"
    return f"""SELECT {case} AS Bin, ROUND(SUM(CAST(PredProb AS DOUBLE)) / COUNT(*), 12) AS MeanPred,
  CAST(SUM(DefaultFlag) AS DOUBLE) / COUNT(*) AS FractionPos, COUNT(*) AS N
FROM v_scored WHERE PredProb IS NOT NULL AND DefaultFlag IS NOT NULL GROUP BY 1"""


def _d3_sql() -> str:
    parts = []
    for name, view, key in [("Customers", "v_customers", "CustomerID"), ("Loans", "v_loans", "LoanID"),
                            ("Macroeconomics", "v_macro", "MonthDate"),
                            ("LoanPerformanceSnapshots", "v_snapshots", "LoanID, SnapshotDate")]:
        parts.append(f"""SELECT '{name}' AS "Table", COUNT(*) AS DuplicateKeys, CAST(COALESCE(SUM(N - 1), 0) AS BIGINT) AS ExcessRows
FROM (SELECT {key}, COUNT(*) AS N FROM {view} GROUP BY {key} HAVING COUNT(*) > 1) d""")
    return "\nUNION ALL\n".join(parts)


def _k2_sql() -> str:
    return f"""
SELECT LoanID, CustomerID, CAST(LoanAmount AS DOUBLE) AS LoanAmount, CAST(OutstandingAmount AS DOUBLE) AS OutstandingAmount,
  PredProb, PredFlag, ScoreDate FROM (
SELECT t.* FROM (SELECT LoanID, CustomerID, LoanAmount, OutstandingAmount, PredProb,
    CASE WHEN PredProb >= {C.PRIOR_THRESHOLD} THEN 1 ELSE 0 END AS PredFlag, '{C.PRIOR_SCORE_TS}' AS ScoreDate
  FROM v_scored_base WHERE OriginationDate < DATE '{C.TARGET_BEFORE}') t
WHERE t.LoanID NOT IN (SELECT LoanID FROM v_scored_base WHERE OriginationDate >= DATE '{C.UPDATES_FROM}')
UNION ALL
SELECT LoanID, CustomerID, LoanAmount, OutstandingAmount, PredProb,
  CASE WHEN PredProb >= {C.NEW_THRESHOLD} THEN 1 ELSE 0 END AS PredFlag, '{C.UPSERT_TS}' AS ScoreDate
FROM v_scored_base WHERE OriginationDate >= DATE '{C.UPDATES_FROM}') u"""


def _scenario_sql() -> str:
    return f"""
SELECT Scenario, MeanPD, ExpectedLossM,
  (ExpectedLossM - MAX(CASE WHEN Scenario = 'Base Case' THEN ExpectedLossM END) OVER ()) * 100.0
    / MAX(CASE WHEN Scenario = 'Base Case' THEN ExpectedLossM END) OVER () AS PctVsBase
FROM (SELECT Scenario, CAST(SUM(PredProb) AS DOUBLE) / COUNT(PredProb) AS MeanPD,
        CAST(SUM(PredProb * LoanAmount) * 0.6 AS DOUBLE) / 1e6 AS ExpectedLossM
      FROM v_stressed GROUP BY Scenario) g"""


def _m2_sql() -> str:
    from loanscope.operators.features import NUMERIC_FEATURES as cols
    stats = ", ".join(f"avg(CAST(f.{c} AS DOUBLE)) AS m{i}, stddev_pop(CAST(f.{c} AS DOUBLE)) AS s{i}"
                      for i, c in enumerate(cols))
    scaled = ", ".join(f"ROUND((CAST({c} AS DOUBLE) - COALESCE(m{i}, 0)) / CASE WHEN s{i} IS NULL OR s{i} = 0 THEN 1 ELSE s{i} END, 9) AS {c}"
                       for i, c in enumerate(cols))
    return (f"WITH st AS (SELECT {stats} FROM v_feat f JOIN v_split s ON s.LoanID = f.LoanID WHERE s.IsTest = 0)\n"
            f"SELECT LoanID, {scaled} FROM v_feat, st")


_E9_COLUMNS = """
SELECT 'Scorecard' AS Model,
  (SELECT CAST(SUM(pos * (2 * nb + neg)) AS DOUBLE) / CAST(2 * MAX(tpos) * MAX(tneg) AS DOUBLE) FROM v_cum) AS ROC_AUC,
  (SELECT ROUND(COALESCE(SUM(CASE WHEN pos > 0 THEN (CAST(pos AS DOUBLE) / CAST(tpos AS DOUBLE))
     * (CAST(tpos - pb AS DOUBLE) / CAST(tpos - pb + tneg - nb AS DOUBLE)) END), 0), 12) FROM v_cum) AS AvgPrecision_PR_AUC,
  COALESCE(CAST(tp AS DOUBLE) / NULLIF(CAST(tp + fp AS DOUBLE), 0), 0) AS Precision,
  COALESCE(CAST(tp AS DOUBLE) / NULLIF(CAST(tp + fn AS DOUBLE), 0), 0) AS Recall,
  COALESCE(CAST(tp + tn AS DOUBLE) / NULLIF(CAST(tp + fp + fn + tn AS DOUBLE), 0), 0) AS Accuracy,
  (SELECT CAST(SUM(DefaultFlag) AS DOUBLE) / COUNT(DefaultFlag) FROM v_scored) AS DefaultRate,
  tp + fp + fn + tn AS TestSize,
  COALESCE((SELECT Threshold FROM v_best), 0.5) AS Threshold
FROM v_counts"""


_ONE_HOT_LEVELS = {
    "Industry": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "Region": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"],
    "RiskGradeAtOrigination": ["A", "B", "C", "D", "E"],
    "CreditScoreBand": ["Low", "Med", "High", "VeryHigh"],
}


def _knn_sql(k: int = 5) -> str:
    """Brute-force kNN over the minority training rows (all pairs: fine for an oracle)."""
    from loanscope.operators.features import LEAKY_FEATURES, NUMERIC_FEATURES
    nums = [c for c in NUMERIC_FEATURES if c not in LEAKY_FEATURES]
    nullable = ["AnnualRevenue", "InflationRate", "GDPGrowthRate", "CentralBankInterestRate"]
    onehot = [(c, lv) for c, lvs in _ONE_HOT_LEVELS.items() for lv in lvs[1:]]
    names = nums + [f"{c}_{lv}" for c, lv in onehot]
    cols = [f"CAST(f.{c} AS DOUBLE) AS x{i}" for i, c in enumerate(nums)]
    cols += [f"CAST(CASE WHEN f.{c} = '{lv}' THEN 1 ELSE 0 END AS DOUBLE) AS x{len(nums) + i}"
             for i, (c, lv) in enumerate(onehot)]
    means = ", ".join(f"avg(x{i}) AS m{i}" for i, c in enumerate(names) if c in nullable)
    filled = ", ".join(f"COALESCE(x{i}, m{i}) AS x{i}" if c in nullable else f"x{i}" for i, c in enumerate(names))
    dist = "0.0 + " + " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(len(names)))
    return f"""
WITH tr AS (SELECT f.LoanID, f.DefaultFlag, {", ".join(cols)} FROM v_feat f JOIN v_split s ON s.LoanID = f.LoanID WHERE s.IsTest = 0),
mm AS (SELECT {means} FROM tr),
mi AS (SELECT LoanID, {filled} FROM tr, mm WHERE DefaultFlag = 1),
pr AS (SELECT a.LoanID, b.LoanID AS Neighbor, {dist} AS d2 FROM mi a JOIN mi b ON a.LoanID <> b.LoanID),
rk AS (SELECT LoanID, Neighbor, d2, row_number() OVER (PARTITION BY LoanID ORDER BY d2, Neighbor) AS Rank FROM pr)
SELECT LoanID, Neighbor, CAST(Rank AS INT) AS Rank, ROUND(sqrt(d2), 6) AS Distance FROM rk WHERE Rank <= {k}"""


def _smote_sql(k: int = 5, ratio: float = 0.3, seed: int = 42) -> str:
    """SMOTE output: training rows + synthetic rows (seeded-hash neighbour and gap)."""
    from loanscope.operators.features import LEAKY_FEATURES, NUMERIC_FEATURES
    nums = [c for c in NUMERIC_FEATURES if c not in LEAKY_FEATURES]
    nullable = ["AnnualRevenue", "InflationRate", "GDPGrowthRate", "CentralBankInterestRate"]
    onehot = [(c, lv) for c, lvs in _ONE_HOT_LEVELS.items() for lv in lvs[1:]]
    names = nums + [f"{c}_{lv}" for c, lv in onehot]
    n = len(names)
    cols = [f"CAST(f.{c} AS DOUBLE) AS x{i}" for i, c in enumerate(nums)]
    cols += [f"CAST(CASE WHEN f.{c} = '{lv}' THEN 1 ELSE 0 END AS DOUBLE) AS x{len(nums) + i}"
             for i, (c, lv) in enumerate(onehot)]
    means = ", ".join(f"avg(x{i}) AS m{i}" for i, c in enumerate(names) if c in nullable)
    filled = ", ".join(f"COALESCE(x{i}, m{i}) AS x{i}" if c in nullable else f"x{i}" for i, c in enumerate(names))
    dist = "0.0 + " + " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(n))
    macro = {"InflationRate", "GDPGrowthRate", "CentralBankInterestRate"}

    def rnd(e: str, c: str) -> str:
        return f"ROUND({e}, 9)" if c in macro else e

    base_out = ", ".join(f'{rnd(f"x{i}", c)} AS "{c}"' for i, c in enumerate(names))
    syn_out = ", ".join(f'{rnd(f"d.x{i} + d.u * (nb.x{i} - d.x{i})", c)} AS "{c}"' for i, c in enumerate(names))
    h_key = portable_hash_sql("LoanID", seed)
    h_nb = portable_hash_sql("LoanID", seed, "t")
    h_u = portable_hash_sql("LoanID", seed + 1, "t")
    return f"""
WITH tr AS (SELECT f.LoanID, f.DefaultFlag, {", ".join(cols)} FROM v_feat f JOIN v_split s ON s.LoanID = f.LoanID WHERE s.IsTest = 0),
mm AS (SELECT {means} FROM tr),
trf AS (SELECT LoanID, DefaultFlag, {filled} FROM tr, mm),
cnt AS (SELECT CAST(SUM(CASE WHEN DefaultFlag = 0 THEN 1 ELSE 0 END) AS BIGINT) AS maj,
               CAST(SUM(CASE WHEN DefaultFlag = 1 THEN 1 ELSE 0 END) AS BIGINT) AS mino FROM trf),
nd AS (SELECT CAST(FLOOR(CAST({ratio} AS DOUBLE) * maj) AS BIGINT) - mino AS need, mino FROM cnt),
mi AS (SELECT * FROM trf WHERE DefaultFlag = 1),
pr AS (SELECT a.LoanID, b.LoanID AS Neighbor, {dist} AS d2 FROM mi a JOIN mi b ON a.LoanID <> b.LoanID),
kn AS (SELECT LoanID, Neighbor, row_number() OVER (PARTITION BY LoanID ORDER BY d2, Neighbor) AS nr FROM pr),
rk AS (SELECT mi.*, row_number() OVER (ORDER BY {h_key}, LoanID) AS r FROM mi),
cp AS (SELECT rk.*, nd.need // nd.mino + CASE WHEN r <= nd.need % nd.mino THEN 1 ELSE 0 END AS copies FROM rk, nd),
dr AS (SELECT cp.*, unnest(range(CAST(0 AS BIGINT), CAST(copies AS BIGINT))) AS t FROM cp WHERE copies > 0),
dr2 AS (SELECT dr.*, CAST(({h_nb}) % {k} + 1 AS BIGINT) AS nrank,
           CAST({h_u} AS DOUBLE) / CAST(2147483648 AS DOUBLE) AS u FROM dr)
SELECT LoanID, DefaultFlag, {base_out}, 0 AS Synthetic FROM trf
UNION ALL
SELECT CAST(-(d.LoanID * (nd.need // nd.mino + 2) + d.t + 1) AS BIGINT) AS LoanID, 1 AS DefaultFlag, {syn_out}, 1 AS Synthetic
FROM dr2 d CROSS JOIN nd JOIN kn ON kn.LoanID = d.LoanID AND kn.nr = d.nrank JOIN mi nb ON nb.LoanID = kn.Neighbor"""


H42 = portable_hash_sql("LoanID", 42)
H43 = portable_hash_sql("LoanID", 43)

SQL: dict[str, str] = {
    "a1_table_counts": """
SELECT 'Customers' AS "Table", COUNT(*) AS N FROM v_customers UNION ALL
SELECT 'Loans', COUNT(*) FROM v_loans UNION ALL
SELECT 'Repayments', COUNT(*) FROM v_repayments UNION ALL
SELECT 'LoanPerformanceSnapshots', COUNT(*) FROM v_snapshots UNION ALL
SELECT 'Macroeconomics', COUNT(*) FROM v_macro""",
    "s1_read_customers_csv": "SELECT CustomerID, CustomerName, Industry, Region, YearsInBusiness, CAST(AnnualRevenue AS DOUBLE) AS AnnualRevenue, CreditScore FROM v_customers",
    "s2_read_loans_csv": "SELECT LoanID, CustomerID, CAST(LoanAmount AS DOUBLE) AS LoanAmount, CAST(InterestRate AS DOUBLE) AS InterestRate, TermMonths, strftime(OriginationDate, '%Y-%m-%d') AS OriginationDate, Status, RiskGradeAtOrigination FROM v_loans",
    "s3_read_repayments_csv": "SELECT LoanID, strftime(PaymentDate, '%Y-%m-%d') AS PaymentDate, CAST(PaymentAmount AS DOUBLE) AS PaymentAmount, CAST(DueAmount AS DOUBLE) AS DueAmount, DaysLate FROM v_repayments",
    "s4_read_macro_csv": "SELECT strftime(MonthDate, '%Y-%m-%d') AS MonthDate, CAST(InflationRate AS DOUBLE) AS InflationRate, CAST(GDPGrowthRate AS DOUBLE) AS GDPGrowthRate, CAST(CentralBankInterestRate AS DOUBLE) AS CentralBankInterestRate FROM v_macro",
    "s5_read_snapshots_csv": "SELECT LoanID, strftime(SnapshotDate, '%Y-%m-%d') AS SnapshotDate, CAST(OutstandingAmount AS DOUBLE) AS OutstandingAmount, PastDueDays, CAST(CumulativePayments AS DOUBLE) AS CumulativePayments, DefaultFlag FROM v_snapshots",
    "s7_customer_dims": "SELECT CustomerID, Region, Industry FROM v_customers",
    "s10_load_timestamp": f"SELECT CustomerID, CustomerName, '{C.UPSERT_TS}' AS CreatedAt FROM v_customers",
    "j1_orphan_loans": "SELECT COUNT(*) AS OrphanLoans FROM v_loans l LEFT JOIN v_customers c ON l.CustomerID = c.CustomerID WHERE c.CustomerID IS NULL",
    "j2_orphan_repayments": "SELECT COUNT(*) AS OrphanRepayments FROM v_repayments r LEFT JOIN v_loans l ON r.LoanID = l.LoanID WHERE l.LoanID IS NULL",
    "t1_future_loans": f"SELECT LoanID, strftime(OriginationDate, '%Y-%m-%d') AS OriginationDate FROM v_loans WHERE OriginationDate > DATE '{AS_OF}' ORDER BY LoanID LIMIT 10",
    "a2_score_range": "SELECT MIN(CreditScore) AS MinScore, MAX(CreditScore) AS MaxScore FROM v_customers",
    "a3_rate_range": "SELECT CAST(MIN(InterestRate) AS DOUBLE) AS MinIR, CAST(MAX(InterestRate) AS DOUBLE) AS MaxIR FROM v_loans",
    "a4_amount_range": "SELECT CAST(MIN(LoanAmount) AS DOUBLE) AS MinLoan, CAST(MAX(LoanAmount) AS DOUBLE) AS MaxLoan FROM v_loans",
    "d1_customer_rules": _rules_sql("v_customers", Q.CUSTOMER_RULES),
    "d1_loan_rules": _rules_sql("v_loans", Q.LOAN_RULES),
    "d1_repayment_rules": _rules_sql("v_repayments", Q.REPAYMENT_RULES),
    "d2_snapshot_rules": _rules_sql("v_snapshots", Q.SNAPSHOT_RULES),
    "d3_duplicate_keys": _d3_sql(),
    "d3_duplicate_payment_days": "SELECT LoanID, strftime(PaymentDate, '%Y-%m-%d') AS PaymentDate, COUNT(*) AS N FROM v_repayments GROUP BY LoanID, PaymentDate HAVING COUNT(*) > 1",
    "d4_fk_violations": """
SELECT 'Loans.CustomerID -> Customers' AS Rule, COUNT(*) AS Violations FROM v_loans l LEFT JOIN v_customers c ON l.CustomerID = c.CustomerID WHERE c.CustomerID IS NULL
UNION ALL SELECT 'Repayments.LoanID -> Loans', COUNT(*) FROM v_repayments r LEFT JOIN v_loans l ON r.LoanID = l.LoanID WHERE l.LoanID IS NULL
UNION ALL SELECT 'LoanPerformanceSnapshots.LoanID -> Loans', COUNT(*) FROM v_snapshots s LEFT JOIN v_loans l ON s.LoanID = l.LoanID WHERE l.LoanID IS NULL""",
    "d6_future_dates": f"SELECT COUNT(*) AS Violations FROM v_loans WHERE OriginationDate > DATE '{AS_OF}'",
    "a5_portfolio_total": "SELECT CAST(SUM(LoanAmount) AS DOUBLE) AS TotalLoanAmount, COUNT(*) AS TotalLoans, CAST(SUM(InterestRate) AS DOUBLE) / COUNT(InterestRate) AS AvgInterestRate FROM v_loans",
    "a6_status_distribution": """
SELECT Status, COUNT(*) AS LoanCount, CAST(SUM(LoanAmount) AS DOUBLE) AS TotalAmount,
  CAST(SUM(InterestRate) AS DOUBLE) / COUNT(InterestRate) AS AvgInterestRate,
  ROUND(100.0 * COUNT(*) / (SELECT COUNT(*) FROM v_loans), 2) AS PctOfTotal
FROM v_loans GROUP BY Status ORDER BY LoanCount DESC""",
    "a7_grade_mix": """
SELECT RiskGradeAtOrigination, COUNT(*) AS LoanCount, CAST(SUM(InterestRate) AS DOUBLE) / COUNT(InterestRate) AS AvgIR,
  CAST(SUM(LoanAmount) AS DOUBLE) / COUNT(LoanAmount) AS AvgLoan
FROM v_loans GROUP BY RiskGradeAtOrigination ORDER BY RiskGradeAtOrigination""",
    "a8_industry_loans": """
SELECT c.Industry, COUNT(l.LoanID) AS NumLoans, CAST(SUM(l.LoanAmount) AS DOUBLE) / COUNT(l.LoanAmount) AS AvgLoan,
  CAST(SUM(l.LoanAmount) AS DOUBLE) AS TotalDisbursed, CAST(SUM(c.CreditScore) AS DOUBLE) / COUNT(c.CreditScore) AS AvgCreditScore
FROM v_customers c JOIN v_loans l ON c.CustomerID = l.CustomerID GROUP BY c.Industry ORDER BY TotalDisbursed DESC""",
    "a9_region_default_rate": """
SELECT c.Region, CAST(SUM(CASE WHEN l.Status = 'Defaulted' THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS DefaultRate, COUNT(*) AS NumLoans
FROM v_loans l JOIN v_customers c ON c.CustomerID = l.CustomerID GROUP BY c.Region ORDER BY DefaultRate DESC""",
    "a10_repayment_agg": "SELECT LoanID, NumPayments, AvgDaysLate, CAST(TotalPaid AS DOUBLE) AS TotalPaid, PaymentRatio FROM v_rep_agg",
    "a11_delay_by_grade": """
SELECT l.RiskGradeAtOrigination, CAST(SUM(r.DaysLate) AS DOUBLE) / COUNT(r.DaysLate) AS AvgDelay, COUNT(DISTINCT l.LoanID) AS NumLoans
FROM v_repayments r JOIN v_loans l ON r.LoanID = l.LoanID GROUP BY l.RiskGradeAtOrigination ORDER BY AvgDelay DESC""",
    "a12_paid_ratio_by_status": """
SELECT l.Status, CAST(SUM(r.PaymentAmount) AS DOUBLE) / CAST(SUM(r.DueAmount) AS DOUBLE) AS PaymentRatio
FROM v_repayments r JOIN v_loans l ON r.LoanID = l.LoanID GROUP BY l.Status""",
    "a13_grade_default": """
SELECT l.RiskGradeAtOrigination, CAST(SUM(CASE WHEN l.Status = 'Defaulted' THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS DefaultRate,
  CAST(SUM(l.InterestRate) AS DOUBLE) / COUNT(l.InterestRate) AS AvgInterest, CAST(SUM(l.LoanAmount) AS DOUBLE) / COUNT(l.LoanAmount) AS AvgLoan
FROM v_loans l LEFT JOIN v_customers c ON l.CustomerID = c.CustomerID
WHERE l.RiskGradeAtOrigination IS NOT NULL GROUP BY l.RiskGradeAtOrigination""",
    "a14_industry_portfolio": """
SELECT c.Industry, COUNT(l.LoanID) AS TotalLoans, CAST(SUM(l.LoanAmount) AS DOUBLE) / COUNT(l.LoanAmount) AS AvgLoan,
  CAST(SUM(CASE WHEN l.Status = 'Defaulted' THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS DefaultRate
FROM v_loans l LEFT JOIN v_customers c ON l.CustomerID = c.CustomerID
WHERE c.Industry IS NOT NULL GROUP BY c.Industry ORDER BY TotalLoans DESC""",
    "a15_region_performance": """
SELECT c.Region, COUNT(l.LoanID) AS NumLoans, CAST(SUM(CASE WHEN l.Status = 'Defaulted' THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS DefaultRate,
  CAST(SUM(l.InterestRate) AS DOUBLE) / COUNT(l.InterestRate) AS AvgInterestRate
FROM v_loans l LEFT JOIN v_customers c ON l.CustomerID = c.CustomerID
WHERE c.Region IS NOT NULL GROUP BY c.Region""",
    "a16_snapshot_trend": """
SELECT strftime(SnapshotDate, '%Y-%m') AS Month, CAST(SUM(OutstandingAmount) AS DOUBLE) / COUNT(OutstandingAmount) AS AvgOutstanding,
  CAST(SUM(DefaultFlag) AS BIGINT) AS DefaultCount
FROM v_snapshots WHERE SnapshotDate IS NOT NULL GROUP BY 1""",
    "a17_correlation": _corr_sql(),
    "a18_label_rate": "SELECT CAST(SUM(DefaultFlag) AS DOUBLE) / COUNT(DefaultFlag) AS DefaultRate FROM v_base",
    "a20_expected_loss": """
SELECT ROUND(CAST(SUM(s.PredProb * t.OutstandingAmount) * 0.6 AS DOUBLE), 2) AS ExpectedLoss
FROM v_split t JOIN v_scored s ON s.LoanID = t.LoanID WHERE t.IsTest = 1""",
    "f0_base_table": """
SELECT LoanID, CustomerID, CAST(LoanAmount AS DOUBLE) AS LoanAmount, CAST(InterestRate AS DOUBLE) AS InterestRate, TermMonths,
  strftime(OriginationDate, '%Y-%m-%d') AS OriginationDate, Status, RiskGradeAtOrigination, Industry, Region, YearsInBusiness,
  CAST(AnnualRevenue AS DOUBLE) AS AnnualRevenue, CreditScore, NumPayments, AvgDaysLate, CAST(TotalPaid AS DOUBLE) AS TotalPaid,
  PaymentRatio, CAST(OutstandingAmount AS DOUBLE) AS OutstandingAmount, PastDueDays,
  CAST(CumulativePayments AS DOUBLE) AS CumulativePayments, DefaultFlag, CAST(InflationRate AS DOUBLE) AS InflationRate,
  CAST(GDPGrowthRate AS DOUBLE) AS GDPGrowthRate, CAST(CentralBankInterestRate AS DOUBLE) AS CentralBankInterestRate
FROM v_base""",
    "f1_f6_features": "SELECT LoanID, LoanToRevenue, PaymentCoverage, RemainingRatio, LoanAgeMonths, MonthsSinceLastPayment, CreditScoreBand FROM v_feat",
    "f7_one_hot": _one_hot_sql(),
    "m1_stratified_split": "SELECT LoanID, DefaultFlag, IsTest FROM v_split",
    "m1_folds": f"""
WITH r AS (SELECT LoanID, DefaultFlag, row_number() OVER (PARTITION BY DefaultFlag ORDER BY {H43}, LoanID) AS rk,
                  COUNT(*) OVER (PARTITION BY DefaultFlag) AS n FROM v_split WHERE IsTest = 0)
SELECT LoanID, DefaultFlag, CAST(CASE WHEN rk <= n // 3 + LEAST(1, n % 3) THEN 0
                                      WHEN rk <= 2 * (n // 3) + LEAST(2, n % 3) THEN 1 ELSE 2 END AS INT) AS fold
FROM r""",
    "x5_seeded_sample": f"""
SELECT LoanID, CustomerID, CAST(LoanAmount AS DOUBLE) AS LoanAmount, CreditScore, DefaultFlag
FROM v_base ORDER BY {H42}, LoanID LIMIT {C.SAMPLE_N}""",
    "e1_roc_auc": """
SELECT CAST(SUM(pos * (2 * nb + neg)) AS DOUBLE) / CAST(2 * MAX(tpos) * MAX(tneg) AS DOUBLE) AS ROC_AUC FROM v_cum""",
    "e2_average_precision": """
SELECT ROUND(COALESCE(SUM(CASE WHEN pos > 0 THEN (CAST(pos AS DOUBLE) / CAST(tpos AS DOUBLE))
  * (CAST(tpos - pb AS DOUBLE) / CAST(tpos - pb + tneg - nb AS DOUBLE)) END), 0), 12) AS AvgPrecision FROM v_cum""",
    "e3_pr_curve": "SELECT Threshold, Precision, Recall FROM v_curve UNION ALL SELECT CAST(NULL AS DOUBLE), CAST(1.0 AS DOUBLE), CAST(0.0 AS DOUBLE)",
    "e4_best_f1": "SELECT Threshold, Precision, Recall, F1 FROM v_best",
    "e5_confusion": """
SELECT 0 AS Actual, 0 AS Predicted, tn AS N FROM v_counts UNION ALL SELECT 0, 1, fp FROM v_counts
UNION ALL SELECT 1, 0, fn FROM v_counts UNION ALL SELECT 1, 1, tp FROM v_counts""",
    "e6_class_report": """
WITH m AS (SELECT tp, fp, fn, tn,
  COALESCE(CAST(tp AS DOUBLE) / NULLIF(CAST(tp + fp AS DOUBLE), 0), 0) AS p1, COALESCE(CAST(tp AS DOUBLE) / NULLIF(CAST(tp + fn AS DOUBLE), 0), 0) AS r1,
  COALESCE(CAST(tn AS DOUBLE) / NULLIF(CAST(tn + fn AS DOUBLE), 0), 0) AS p0, COALESCE(CAST(tn AS DOUBLE) / NULLIF(CAST(tn + fp AS DOUBLE), 0), 0) AS r0
  FROM v_counts),
f AS (SELECT *, COALESCE(p0 * 2 * r0 / NULLIF(p0 + r0, 0), 0) AS f0, COALESCE(p1 * 2 * r1 / NULLIF(p1 + r1, 0), 0) AS f1,
  tn + fp AS s0, tp + fn AS s1, tp + fp + fn + tn AS n FROM m)
SELECT '0' AS Class, ROUND(p0, 4) AS Precision, ROUND(r0, 4) AS Recall, ROUND(f0, 4) AS F1, s0 AS Support FROM f
UNION ALL SELECT '1', ROUND(p1, 4), ROUND(r1, 4), ROUND(f1, 4), s1 FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, ROUND(COALESCE(CAST(tp + tn AS DOUBLE) / NULLIF(CAST(n AS DOUBLE), 0), 0), 4), n FROM f
UNION ALL SELECT 'macro avg', ROUND((p0 + p1) / 2, 4), ROUND((r0 + r1) / 2, 4), ROUND((f0 + f1) / 2, 4), n FROM f
UNION ALL SELECT 'weighted avg', ROUND(COALESCE((p0 * s0 + p1 * s1) / NULLIF(CAST(n AS DOUBLE), 0), 0), 4),
  ROUND(COALESCE((r0 * s0 + r1 * s1) / NULLIF(CAST(n AS DOUBLE), 0), 0), 4),
  ROUND(COALESCE((f0 * s0 + f1 * s1) / NULLIF(CAST(n AS DOUBLE), 0), 0), 4), n FROM f""",
    "e7_point_metrics": """
SELECT COALESCE(CAST(tp AS DOUBLE) / NULLIF(CAST(tp + fp AS DOUBLE), 0), 0) AS Precision,
  COALESCE(CAST(tp AS DOUBLE) / NULLIF(CAST(tp + fn AS DOUBLE), 0), 0) AS Recall,
  COALESCE(CAST(tp + tn AS DOUBLE) / NULLIF(CAST(tp + fp + fn + tn AS DOUBLE), 0), 0) AS Accuracy FROM v_counts""",
    "e8_calibration": _calibration_sql(10),
    "e9_eval_summary": """
SELECT 'Scorecard' AS Model,
  (SELECT CAST(SUM(pos * (2 * nb + neg)) AS DOUBLE) / CAST(2 * MAX(tpos) * MAX(tneg) AS DOUBLE) FROM v_cum) AS ROC_AUC,
  (SELECT ROUND(COALESCE(SUM(CASE WHEN pos > 0 THEN (CAST(pos AS DOUBLE) / CAST(tpos AS DOUBLE))
     * (CAST(tpos - pb AS DOUBLE) / CAST(tpos - pb + tneg - nb AS DOUBLE)) END), 0), 12) FROM v_cum) AS AvgPrecision_PR_AUC,
  COALESCE(CAST(tp AS DOUBLE) / NULLIF(CAST(tp + fp AS DOUBLE), 0), 0) AS Precision,
  COALESCE(CAST(tp AS DOUBLE) / NULLIF(CAST(tp + fn AS DOUBLE), 0), 0) AS Recall,
  COALESCE(CAST(tp + tn AS DOUBLE) / NULLIF(CAST(tp + fp + fn + tn AS DOUBLE), 0), 0) AS Accuracy,
  (SELECT CAST(SUM(DefaultFlag) AS DOUBLE) / COUNT(DefaultFlag) FROM v_scored) AS DefaultRate,
  tp + fp + fn + tn AS TestSize,
  COALESCE((SELECT Threshold FROM v_best), 0.5) AS Threshold
FROM v_counts""",
    "j9_with_customer_dims": """
SELECT s.LoanID, s.CustomerID, CAST(s.LoanAmount AS DOUBLE) AS LoanAmount, CAST(s.OutstandingAmount AS DOUBLE) AS OutstandingAmount,
  s.DefaultFlag, c.Region, c.Industry, s.PredProb,
  CASE WHEN s.PredProb >= COALESCE((SELECT Threshold FROM v_best), 0.5) THEN 1 ELSE 0 END AS PredFlag
FROM v_scored_base s LEFT JOIN v_customers c ON s.CustomerID = c.CustomerID""",
    "j10_align_scores": """
SELECT t.LoanID, CAST(t.OutstandingAmount AS DOUBLE) AS OutstandingAmount, t.DefaultFlag, s.PredProb
FROM v_split t JOIN v_scored s ON s.LoanID = t.LoanID WHERE t.IsTest = 1""",
    "r1_kpis": """
SELECT CAST(SUM(DefaultFlag) AS DOUBLE) / COUNT(DefaultFlag) AS DefaultRate,
  ROUND(CAST(SUM(PredProb * LoanAmount) * 0.6 AS DOUBLE), 2) AS ExpectedLoss, COUNT(*) AS N FROM v_scored""",
    "r2_risk_by_region": """
SELECT c.Region, COUNT(*) AS N, CAST(SUM(s.DefaultFlag) AS BIGINT) AS Defaults, CAST(SUM(s.DefaultFlag) AS DOUBLE) / COUNT(s.DefaultFlag) AS DefaultRate,
  ROUND(CAST(SUM(s.PredProb * s.LoanAmount) * 0.6 AS DOUBLE), 2) AS ExpectedLoss
FROM v_scored s LEFT JOIN v_customers c ON s.CustomerID = c.CustomerID GROUP BY c.Region""",
    "r2_risk_by_industry": """
SELECT c.Industry, COUNT(*) AS N, CAST(SUM(s.DefaultFlag) AS BIGINT) AS Defaults, CAST(SUM(s.DefaultFlag) AS DOUBLE) / COUNT(s.DefaultFlag) AS DefaultRate,
  ROUND(CAST(SUM(s.PredProb * s.LoanAmount) * 0.6 AS DOUBLE), 2) AS ExpectedLoss
FROM v_scored s LEFT JOIN v_customers c ON s.CustomerID = c.CustomerID GROUP BY c.Industry""",
    "r3_score_bands": """
SELECT CASE WHEN CreditScore > 299 AND CreditScore <= 600 THEN 'Low' WHEN CreditScore > 600 AND CreditScore <= 660 THEN 'Med'
  WHEN CreditScore > 660 AND CreditScore <= 720 THEN 'High' WHEN CreditScore > 720 AND CreditScore <= 900 THEN 'VeryHigh' END AS Band,
  COUNT(*) AS N FROM v_customers GROUP BY 1""",
    "r3_score_bins": "SELECT CAST(FLOOR(CreditScore / 50) * 50 AS INT) AS Bin, COUNT(*) AS N FROM v_customers GROUP BY 1",
    "r4_sector_averages": """
SELECT c.Industry, CAST(SUM(l.LoanAmount) AS DOUBLE) / COUNT(l.LoanAmount) AS AvgLoan,
  CAST(SUM(l.InterestRate) AS DOUBLE) / COUNT(l.InterestRate) AS AvgRate
FROM v_loans l JOIN v_customers c ON l.CustomerID = c.CustomerID GROUP BY c.Industry""",
    "r5_segment_lift": """
WITH g AS (SELECT CAST(COALESCE(LoanToRevenue > 0.4 AND AvgDaysLate > 10.0, FALSE) AS INT) AS InSegment, COUNT(*) AS N,
  CAST(SUM(DefaultFlag) AS DOUBLE) / COUNT(DefaultFlag) AS DefaultRate FROM v_feat GROUP BY 1)
SELECT InSegment, N, DefaultRate,
  DefaultRate / CASE WHEN InSegment = 1 THEN MAX(CASE WHEN InSegment = 0 THEN DefaultRate END) OVER ()
                     ELSE MAX(CASE WHEN InSegment = 1 THEN DefaultRate END) OVER () END AS Lift
FROM g""",
    "r6_stressed_scores": "SELECT Scenario, LoanID, CAST(LoanAmount AS DOUBLE) AS LoanAmount, CAST(PredProb AS DOUBLE) AS PredProb FROM v_stressed",
    "r7_scenario_summary": _scenario_sql(),
    "r8_rising_lateness": """
WITH m AS (SELECT LoanID, date_trunc('month', PaymentDate) AS Mon, SUM(DaysLate) AS late, COUNT(DaysLate) AS n
           FROM v_repayments GROUP BY 1, 2),
w AS (SELECT LoanID, Mon, CAST(late AS DOUBLE) / CAST(n AS DOUBLE) AS AvgDaysLate,
        CAST(SUM(late) OVER (PARTITION BY LoanID ORDER BY Mon ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS DOUBLE)
        / CAST(SUM(n) OVER (PARTITION BY LoanID ORDER BY Mon ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS DOUBLE) AS PriorAvgDaysLate
      FROM m)
SELECT LoanID, strftime(Mon, '%Y-%m-%d') AS Month, AvgDaysLate, PriorAvgDaysLate, AvgDaysLate - PriorAvgDaysLate AS Delta
FROM w WHERE AvgDaysLate - PriorAvgDaysLate > 0""",
    "t5_top_risk": "SELECT LoanID, CustomerID, CAST(LoanAmount AS DOUBLE) AS LoanAmount, DefaultFlag, PredProb FROM v_scored ORDER BY PredProb DESC, LoanID LIMIT 20",
    "k2_upsert_scores": _k2_sql(),
    "m2_standardize": _m2_sql(),
    "m3_balanced_weights": """
SELECT LoanID, DefaultFlag, CAST(COUNT(*) OVER () AS DOUBLE) / CAST(2 * COUNT(*) OVER (PARTITION BY DefaultFlag) AS DOUBLE) AS weight
FROM v_split WHERE IsTest = 0""",
    "k1_ensure_score_table": f"""
SELECT LoanID, CustomerID, CAST(LoanAmount AS DOUBLE) AS LoanAmount, CAST(OutstandingAmount AS DOUBLE) AS OutstandingAmount,
  PredProb, CASE WHEN PredProb >= {C.PRIOR_THRESHOLD} THEN 1 ELSE 0 END AS PredFlag, '{C.UPSERT_TS}' AS ScoreDate
FROM v_scored_base""",
    "k4_metrics_csv": f"SELECT Model, ROC_AUC, Precision, Recall, Accuracy, Threshold, TestSize FROM ({_E9_COLUMNS}) e",
    "k5_eval_json": f"SELECT Model, ROC_AUC, AvgPrecision_PR_AUC, DefaultRate, TestSize, Threshold AS ThresholdUsed FROM ({_E9_COLUMNS}) e",
}
SQL["e9_eval_summary"] = _E9_COLUMNS
SQL["k2_table_upsert"] = SQL["k2_upsert_scores"]
SQL["s6_load_tables"] = SQL["a1_table_counts"]
SQL["m7_smote_knn"] = _knn_sql(5)
SQL["m7_smote"] = _smote_sql(5, 0.3, 42)
SQL["a19_class_counts"] = """
WITH n AS (SELECT COUNT(*) FILTER (WHERE DefaultFlag = 0) AS maj FROM v_split WHERE IsTest = 0)
SELECT 0 AS Label, maj AS N FROM n UNION ALL SELECT 1, CAST(FLOOR(CAST(0.3 AS DOUBLE) * maj) AS BIGINT) FROM n"""
SQL["k3_predictions_csv"] = SQL["j9_with_customer_dims"]


def oracle() -> dict[str, str]:
    return {name: q(body) for name, body in SQL.items()}
