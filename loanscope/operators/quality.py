"""Data-quality rules and sanity checks (counts, orphans, ranges, CHECK/PK/FK).

Every rule runs as one distributed aggregate: row-level predicates become
``sum(case when not rule ...)`` columns of a single ``agg`` pass, keys are
checked with a grouped count, and foreign keys with a ``left_anti`` join of
pre-aggregated child keys (a hot key collapses to one row before the shuffle).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanscope.functions.columns import col


@dataclass(frozen=True)
class Rule:
    """A row rule written as a SQL predicate; a NULL result passes, as a SQL
    CHECK constraint does.  The same text serves Spark and any SQL engine."""

    name: str
    sql: str

    @property
    def predicate(self) -> Column:
        return F.expr(self.sql)

    def violated(self) -> Column:
        return ~F.coalesce(self.predicate, F.lit(True))


def not_null(c: str) -> Rule:
    return Rule(f"{c} IS NOT NULL", f"{c} IS NOT NULL")


def max_length(c: str, n: int) -> Rule:
    return Rule(f"len({c}) <= {n}", f"length({c}) <= {n}")


# CHECK constraints, NOT NULL columns and string lengths of the loan-book DDL.
LOAN_STATUSES = ["Current", "Delinquent", "Defaulted", "PaidOff"]

CUSTOMER_RULES = [
    Rule("YearsInBusiness >= 0", "YearsInBusiness >= 0"),
    Rule("CreditScore BETWEEN 300 AND 900", "CreditScore BETWEEN 300 AND 900"),
    not_null("CustomerID"),
    not_null("CustomerName"),
    max_length("CustomerName", 100),
    max_length("Industry", 50),
    max_length("Region", 50),
]
LOAN_RULES = [
    Rule("LoanAmount > 0", "LoanAmount > 0"),
    Rule("InterestRate > 0", "InterestRate > 0"),
    Rule("TermMonths > 0", "TermMonths > 0"),
    Rule("Status IN (Current, Delinquent, Defaulted, PaidOff)",
         "Status IN ('Current', 'Delinquent', 'Defaulted', 'PaidOff')"),
    not_null("LoanID"),
    not_null("CustomerID"),
    max_length("Status", 30),
    max_length("RiskGradeAtOrigination", 10),
]
REPAYMENT_RULES = [
    Rule("PaymentAmount >= 0", "PaymentAmount >= 0"),
    Rule("DueAmount >= 0", "DueAmount >= 0"),
    Rule("DaysLate >= 0", "DaysLate >= 0"),
    not_null("LoanID"),
    not_null("PaymentDate"),
]
SNAPSHOT_RULES = [not_null("LoanID"), not_null("SnapshotDate")]
MACRO_RULES = [not_null("MonthDate")]


def check_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rule, Violations — one scan, one aggregate, then unpivoted to long form."""
    aggs = [F.sum(F.when(r.violated(), 1).otherwise(0)).cast("long").alias(f"r{i}")
            for i, r in enumerate(rules)]
    wide = df.agg(*aggs)
    pairs = F.array(*[
        F.struct(F.lit(r.name).alias("Rule"), F.coalesce(F.col(f"r{i}"), F.lit(0)).alias("Violations"))
        for i, r in enumerate(rules)
    ])
    return wide.select(F.inline(pairs))


def quarantine(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(good, bad): bad rows carry ``FailedRules`` (array of rule names)."""
    failed = F.filter(
        F.array(*[F.when(r.violated(), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull()
    )
    tagged = df.withColumn("FailedRules", failed)
    good = tagged.filter(F.size("FailedRules") == 0).drop("FailedRules")
    bad = tagged.filter(F.size("FailedRules") > 0)
    return good, bad


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Table, N — one count per table (each a metadata-light scan)."""
    parts = [df.agg(F.count(F.lit(1)).alias("N")).select(F.lit(name).alias("Table"), "N")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def orphan_count(child: DataFrame, parent: DataFrame, key: str, alias: str) -> DataFrame:
    """Child rows whose key has no parent (LEFT JOIN ... WHERE parent IS NULL)."""
    per_key = child.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    orphans = per_key.join(parent.select(key), key, "left_anti")
    return orphans.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias(alias))


def fk_violations(child: DataFrame, parent: DataFrame, key: str, rule: str) -> DataFrame:
    """Rule, Violations for one foreign key (a NULL key passes, as in SQL)."""
    return orphan_count(child.filter(F.col(key).isNotNull()), parent, key, "Violations").select(F.lit(rule).alias("Rule"), "Violations")


def duplicate_keys(df: DataFrame, key: str | list[str]) -> DataFrame:
    """key, N for keys seen more than once (PK uniqueness)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("N")).filter(F.col("N") > 1)


def value_range(df: DataFrame, c: str, min_alias: str, max_alias: str) -> DataFrame:
    """MIN/MAX of one column (range sanity checks)."""
    return df.agg(F.min(col(c)).alias(min_alias), F.max(col(c)).alias(max_alias))


def future_loans(loans: DataFrame, as_of: str, n: int = 10) -> DataFrame:
    """TOP n LoanID, OriginationDate with OriginationDate > as_of (ordered by LoanID)."""
    return (loans.filter(F.col("OriginationDate") > F.lit(as_of).cast("date"))
            .select("LoanID", "OriginationDate").orderBy("LoanID").limit(n))


def future_dates(loans: DataFrame, as_of: str) -> DataFrame:
    """Violations: loans originated after the as-of date."""
    return (loans.filter(F.col("OriginationDate") > F.lit(as_of).cast("date"))
            .agg(F.count(F.lit(1)).alias("Violations")))


def score_range(customers: DataFrame) -> DataFrame:
    """MinScore, MaxScore of CreditScore."""
    return value_range(customers, "CreditScore", "MinScore", "MaxScore")


def rate_range(loans: DataFrame) -> DataFrame:
    """MinIR, MaxIR of InterestRate."""
    return value_range(loans, "InterestRate", "MinIR", "MaxIR")


def amount_range(loans: DataFrame) -> DataFrame:
    """MinLoan, MaxLoan of LoanAmount (the unnamed pair of the sanity query)."""
    return value_range(loans, "LoanAmount", "MinLoan", "MaxLoan")
