"""Typed table definitions of the loan book (never inferred).

Keys are 64-bit: surrogate keys of a 100 TB book outgrow INT.  DECIMAL keeps
money exact; DefaultFlag/PredFlag are 0/1 integers because they are summed.
"""

from pyspark.sql.types import (
    DateType, DecimalType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
    TimestampNTZType,
)

MONEY = DecimalType(18, 2)
RATE = DecimalType(5, 2)

CUSTOMERS = StructType([
    StructField("CustomerID", LongType(), False),
    StructField("CustomerName", StringType(), False),
    StructField("Industry", StringType(), True),
    StructField("Region", StringType(), True),
    StructField("YearsInBusiness", IntegerType(), True),
    StructField("AnnualRevenue", MONEY, True),
    StructField("CreditScore", IntegerType(), True),
    StructField("CreatedAt", TimestampNTZType(), True),
])

LOANS = StructType([
    StructField("LoanID", LongType(), False),
    StructField("CustomerID", LongType(), False),
    StructField("LoanAmount", MONEY, True),
    StructField("InterestRate", RATE, True),
    StructField("TermMonths", IntegerType(), True),
    StructField("OriginationDate", DateType(), True),
    StructField("Status", StringType(), True),
    StructField("RiskGradeAtOrigination", StringType(), True),
])

REPAYMENTS = StructType([
    StructField("RepaymentID", LongType(), True),
    StructField("LoanID", LongType(), False),
    StructField("PaymentDate", DateType(), False),
    StructField("PaymentAmount", MONEY, True),
    StructField("DueAmount", MONEY, True),
    StructField("DaysLate", IntegerType(), True),
])

MACRO = StructType([
    StructField("MonthDate", DateType(), False),
    StructField("InflationRate", RATE, True),
    StructField("GDPGrowthRate", RATE, True),
    StructField("CentralBankInterestRate", RATE, True),
])

SNAPSHOTS = StructType([
    StructField("SnapshotID", LongType(), True),
    StructField("LoanID", LongType(), False),
    StructField("SnapshotDate", DateType(), False),
    StructField("OutstandingAmount", MONEY, True),
    StructField("PastDueDays", IntegerType(), True),
    StructField("CumulativePayments", MONEY, True),
    StructField("DefaultFlag", IntegerType(), True),
])

SCORES = StructType([
    StructField("LoanID", LongType(), False),
    StructField("CustomerID", LongType(), True),
    StructField("LoanAmount", MONEY, True),
    StructField("OutstandingAmount", MONEY, True),
    StructField("PredProb", DoubleType(), True),
    StructField("PredFlag", IntegerType(), True),
    StructField("ScoreDate", TimestampNTZType(), True),
])

PREDICTIONS = StructType([
    StructField("LoanID", LongType(), False),
    StructField("CustomerID", LongType(), True),
    StructField("LoanAmount", MONEY, True),
    StructField("OutstandingAmount", MONEY, True),
    StructField("DefaultFlag", IntegerType(), True),
    StructField("Region", StringType(), True),
    StructField("Industry", StringType(), True),
    StructField("PredProb", DoubleType(), True),
    StructField("PredFlag", IntegerType(), True),
])

BY_TABLE = {
    "Customers": CUSTOMERS,
    "Loans": LOANS,
    "Repayments": REPAYMENTS,
    "Macroeconomics": MACRO,
    "LoanPerformanceSnapshots": SNAPSHOTS,
}
