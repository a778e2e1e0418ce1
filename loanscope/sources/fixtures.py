"""Fixture views: the loan-book tables, derived from the TPC-H-like parquet.

The SQL text below is shared verbatim by Spark (temp views) and by the DuckDB
oracle (CTEs), so both engines see the same inputs.  Fixed values (the view
text, the scenario triples and the as-of date) are stated once, here.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

RAW_TABLES = ("region", "nation", "customer", "orders", "lineitem")

# As-of date for age features and future-date checks.
AS_OF = "2002-01-01"

# Macro scenarios (name, inflation, GDP growth, policy rate).
SCENARIOS = [
    ("Base Case", 5.0, 6.2, 6.5),
    ("Mild Stress", 7.0, 4.0, 7.5),
    ("Severe Stress", 9.0, 2.0, 8.5),
    ("Recovery", 4.0, 7.0, 6.0),
]
BASE_SCENARIO = "Base Case"

# Fixture view text (same in Spark SQL and DuckDB), in dependency order.
VIEW_SQL: dict[str, str] = {
    "v_customers": """
SELECT c_custkey+1000 AS CustomerID, c_name AS CustomerName, c_mktsegment AS Industry, r_name AS Region,
  CAST(c_custkey*31 % 40 AS INT) AS YearsInBusiness,
  CAST((CAST(c_acctbal AS DECIMAL(12,2)) + 1000) * 50 AS DECIMAL(18,2)) AS AnnualRevenue,
  CAST(300 + c_custkey*7919 % 601 AS INT) AS CreditScore
FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey
""",
    "v_loans": """
SELECT o_orderkey+5000 AS LoanID, o_custkey+1000 AS CustomerID,
  CAST(o_totalprice AS DECIMAL(18,2)) AS LoanAmount,
  CAST((600 + o_orderkey*37 % 900) * 0.01 AS DECIMAL(5,2)) AS InterestRate,
  CAST(12*(1+o_orderkey % 5) AS INT) AS TermMonths,
  CAST(o_orderdate AS DATE) AS OriginationDate,
  CASE WHEN o_orderkey*104729 % 1000 < CASE WHEN o_custkey*7919 % 601 < 150 THEN 180
                                            WHEN o_custkey*7919 % 601 < 300 THEN 60 ELSE 10 END THEN 'Defaulted'
       WHEN o_orderstatus='F' THEN 'PaidOff' WHEN o_orderstatus='O' THEN 'Current' ELSE 'Delinquent' END AS Status,
  substr('ABCDE', CAST(substr(o_orderpriority,1,1) AS INT), 1) AS RiskGradeAtOrigination
FROM orders
""",
    "v_repayments": """
SELECT l_orderkey+5000 AS LoanID, CAST(l_shipdate AS DATE) AS PaymentDate,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,2)) AS PaymentAmount,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS DueAmount,
  CAST(CASE WHEN l_returnflag='R' THEN (l_partkey*13 + l_linenumber*7) % 45 ELSE 0 END AS INT) AS DaysLate
FROM lineitem
""",
    "v_macro": """
SELECT MonthDate, CAST((100 + m*17 % 400) * 0.01 AS DECIMAL(5,2)) AS InflationRate,
  CAST((150 + m*23 % 300) * 0.01 AS DECIMAL(5,2)) AS GDPGrowthRate,
  CAST((50 + m*29 % 200) * 0.01 AS DECIMAL(5,2)) AS CentralBankInterestRate
FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS MonthDate,
             year(o_orderdate)*12+month(o_orderdate) AS m FROM orders) t
WHERE m % 24 <> 0
""",
    "v_snapshots": """
SELECT LoanID, SnapshotDate, CAST(GREATEST(LoanAmount - CumulativePayments, 0) AS DECIMAL(18,2)) AS OutstandingAmount,
  PastDueDays, CumulativePayments, CASE WHEN Status='Defaulted' THEN 1 ELSE 0 END AS DefaultFlag
FROM (SELECT p.LoanID, p.SnapshotDate, p.PastDueDays, l.LoanAmount, l.Status,
        CAST(SUM(p.Paid) OVER (PARTITION BY p.LoanID ORDER BY p.SnapshotDate
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(18,2)) AS CumulativePayments
      FROM (SELECT LoanID, CAST(date_trunc('month', PaymentDate) AS DATE) AS SnapshotDate,
                   MAX(DaysLate) AS PastDueDays, SUM(PaymentAmount) AS Paid
            FROM v_repayments GROUP BY 1, 2) p
      JOIN v_loans l ON l.LoanID=p.LoanID) q
""",
    "v_scored": """
SELECT l.LoanID, l.CustomerID, l.LoanAmount, CASE WHEN l.Status='Defaulted' THEN 1 ELSE 0 END AS DefaultFlag,
  CAST(LEAST(GREATEST(900-c.CreditScore,0) + (l.LoanID*31 % 200), 800) AS DOUBLE)/1000 AS PredProb
FROM v_loans l LEFT JOIN v_customers c ON l.CustomerID=c.CustomerID
""",
    "v_stressed": """
SELECT n.Scenario, t.LoanID, t.LoanAmount,
  CAST(LEAST(GREATEST(CAST(t.PredProb AS DECIMAL(6,3)) + CAST(((n.InflationRate - 5.0) + (6.2 - n.GDPGrowthRate)
       + (n.CentralBankInterestRate - 6.5)) * 0.010 AS DECIMAL(6,3)), 0), 1) AS DECIMAL(6,3)) AS PredProb
FROM v_scored t CROSS JOIN (VALUES ('Base Case', 5.0, 6.2, 6.5), ('Mild Stress', 7.0, 4.0, 7.5),
  ('Severe Stress', 9.0, 2.0, 8.5), ('Recovery', 4.0, 7.0, 6.0))
  AS n(Scenario, InflationRate, GDPGrowthRate, CentralBankInterestRate)
""",
}

VIEW_ORDER = list(VIEW_SQL)


def _deps(name: str, extra: dict[str, str] | None = None) -> list[str]:
    """Views that ``name`` needs, in dependency order (itself last)."""
    catalogue = {**VIEW_SQL, **(extra or {})}
    out: list[str] = []

    def visit(n: str) -> None:
        for other in catalogue:
            if other != n and re.search(rf"\b{other}\b", catalogue[n]) and other not in out:
                visit(other)
        if n not in out:
            out.append(n)

    visit(name)
    return out


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix an oracle query with exactly the fixture CTEs it references."""
    catalogue = {**VIEW_SQL, **(extra or {})}
    needed: list[str] = []
    for name in catalogue:
        if re.search(rf"\b{name}\b", body):
            for dep in _deps(name, extra):
                if dep not in needed:
                    needed.append(dep)
    if not needed:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({catalogue[n].strip()})" for n in needed)
    body = body.strip()
    if re.match(r"(?is)^with\s", body):  # merge the body's own CTEs into one WITH list
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"


@dataclass
class LoanBook:
    """The five loan-book tables plus the deterministic scorecard."""

    customers: DataFrame
    loans: DataFrame
    repayments: DataFrame
    macro: DataFrame
    snapshots: DataFrame
    scored: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {
            "Customers": self.customers,
            "Loans": self.loans,
            "Repayments": self.repayments,
            "LoanPerformanceSnapshots": self.snapshots,
            "Macroeconomics": self.macro,
        }


# Spark-side temp views are namespaced so the caller's own views are never replaced.
SPARK_PREFIX = "loanscope_"


def spark_view_sql(name: str) -> str:
    """The fixture text with table and view names namespaced for the Spark session."""
    text = VIEW_SQL[name]
    for t in (*RAW_TABLES, *VIEW_SQL):
        text = re.sub(rf"\b{t}\b", SPARK_PREFIX + t, text)
    return text


_SCHEMAS: dict[str, StructType] = {}


def register_raw(spark: SparkSession, sf_dir: str) -> None:
    """Views over the raw files; a path's schema is read once, not once a query."""
    for t in RAW_TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = spark.read.parquet(path).schema
        spark.read.schema(_SCHEMAS[path]).parquet(path).createOrReplaceTempView(SPARK_PREFIX + t)


def load_book(spark: SparkSession, sf_dir: str) -> LoanBook:
    """Register raw tables and the fixture views (namespaced); return them as DataFrames.

    The views are lazy: only the columns and rows a query touches are read.
    """
    register_raw(spark, sf_dir)
    frames: dict[str, DataFrame] = {}
    for name in ("v_customers", "v_loans", "v_repayments", "v_macro", "v_snapshots", "v_scored"):
        df = spark.sql(spark_view_sql(name))
        df.createOrReplaceTempView(SPARK_PREFIX + name)
        frames[name] = df
    return LoanBook(
        customers=frames["v_customers"],
        loans=frames["v_loans"],
        repayments=frames["v_repayments"],
        macro=frames["v_macro"],
        snapshots=frames["v_snapshots"],
        scored=frames["v_scored"],
    )
