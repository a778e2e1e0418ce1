"""A loan book with planted violations, derived from the clean fixture views.

Every rule of the quality layer has rows that break it, chosen by key
remainder, so the quality queries have something to find.  As with the clean
views, the same text runs in Spark and as CTEs in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from loanscope.sources.fixtures import RAW_TABLES, SPARK_PREFIX, VIEW_SQL

DIRTY_SQL: dict[str, str] = {
    "v_dirty_customers": """
SELECT CASE WHEN CustomerID % 97 = 0 THEN NULL ELSE CustomerID END AS CustomerID,
  CASE WHEN CustomerID % 89 = 1 THEN NULL WHEN CustomerID % 83 = 2 THEN repeat('x', 101) ELSE CustomerName END AS CustomerName,
  CASE WHEN CustomerID % 79 = 3 THEN repeat('y', 51) ELSE Industry END AS Industry,
  CASE WHEN CustomerID % 77 = 4 THEN repeat('z', 60) WHEN CustomerID % 13 = 5 THEN NULL ELSE Region END AS Region,
  CASE WHEN CustomerID % 73 = 4 THEN -1 ELSE YearsInBusiness END AS YearsInBusiness,
  CASE WHEN CustomerID % 71 = 5 THEN 299 WHEN CustomerID % 67 = 6 THEN 901 ELSE CreditScore END AS CreditScore
FROM (SELECT * FROM v_customers UNION ALL SELECT * FROM v_customers WHERE CustomerID % 61 = 7) c
""",
    "v_dirty_loans": """
SELECT CASE WHEN LoanID % 101 = 0 THEN NULL ELSE LoanID END AS LoanID,
  CASE WHEN LoanID % 53 = 1 THEN CustomerID + 100000000 WHEN LoanID % 59 = 2 THEN NULL ELSE CustomerID END AS CustomerID,
  CASE WHEN LoanID % 47 = 3 THEN -LoanAmount ELSE LoanAmount END AS LoanAmount,
  CASE WHEN LoanID % 43 = 4 THEN 0 ELSE InterestRate END AS InterestRate,
  CASE WHEN LoanID % 41 = 5 THEN 0 ELSE TermMonths END AS TermMonths,
  CASE WHEN LoanID % 19 = 10 THEN NULL WHEN LoanID % 23 = 9 THEN CAST(OriginationDate + INTERVAL '20' YEAR AS DATE)
       ELSE OriginationDate END AS OriginationDate,
  CASE WHEN LoanID % 37 = 6 THEN 'Unknown' WHEN LoanID % 31 = 7 THEN repeat('s', 31) ELSE Status END AS Status,
  CASE WHEN LoanID % 29 = 8 THEN repeat('g', 11) ELSE RiskGradeAtOrigination END AS RiskGradeAtOrigination
FROM (SELECT * FROM v_loans UNION ALL SELECT * FROM v_loans WHERE LoanID % 17 = 11) l
""",
    "v_dirty_repayments": """
SELECT LoanID * 10 + DaysLate % 10 AS RepaymentID,
  CASE WHEN LoanID % 103 = 1 THEN NULL WHEN LoanID % 107 = 2 THEN LoanID + 100000000 ELSE LoanID END AS LoanID,
  CASE WHEN LoanID % 109 = 3 THEN NULL ELSE PaymentDate END AS PaymentDate,
  CASE WHEN LoanID % 113 = 4 THEN -PaymentAmount ELSE PaymentAmount END AS PaymentAmount,
  CASE WHEN LoanID % 127 = 5 THEN -DueAmount ELSE DueAmount END AS DueAmount,
  CASE WHEN LoanID % 131 = 6 THEN -1 ELSE DaysLate END AS DaysLate
FROM v_repayments
""",
    "v_dirty_snapshots": """
SELECT CASE WHEN LoanID % 137 = 1 THEN NULL WHEN LoanID % 139 = 2 THEN LoanID + 100000000 ELSE LoanID END AS LoanID,
  CASE WHEN LoanID % 149 = 3 THEN NULL ELSE SnapshotDate END AS SnapshotDate
FROM (SELECT LoanID, SnapshotDate FROM v_snapshots UNION ALL
      SELECT LoanID, SnapshotDate FROM v_snapshots WHERE LoanID % 151 = 4) s
""",
    "v_dirty_macro": """
SELECT CASE WHEN InflationRate > 4 THEN NULL ELSE MonthDate END AS MonthDate, InflationRate
FROM (SELECT * FROM v_macro UNION ALL SELECT * FROM v_macro WHERE InflationRate < 2) m
""",
    "v_dirty_scores": """
SELECT LoanID, PredProb FROM v_scored UNION ALL SELECT LoanID, PredProb FROM v_scored WHERE LoanID % 7 = 1
""",
}


def dirty_book(spark: SparkSession) -> dict[str, DataFrame]:
    """The dirty tables by view name (after ``load_book`` registered the clean ones)."""
    out = {}
    for name, text in DIRTY_SQL.items():
        for t in (*RAW_TABLES, *VIEW_SQL):
            text = re.sub(rf"\b{t}\b", SPARK_PREFIX + t, text)
        out[name] = spark.sql(text)
    return out
