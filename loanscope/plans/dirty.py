"""Quality queries over the dirty loan book, with SQL written out by hand.

The expected counts are spelled here apart from the rule texts in
``operators/quality.py``, so a wrong rule does not match itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanscope.functions.columns import coerce_numeric, parse_date
from loanscope.operators import quality as Q
from loanscope.plans.catalog import register
from loanscope.session import scratch_path
from loanscope.sources import readers, schemas
from loanscope.sources.dirty import DIRTY_SQL, dirty_book
from loanscope.sources.fixtures import AS_OF, with_views


def _rules(view: str, rules: list[Q.Rule]):
    return lambda spark, b: Q.check_rules(dirty_book(spark)[view], rules)


for _name, _view, _rules_of in (("dq_customer_rules", "v_dirty_customers", Q.CUSTOMER_RULES),
                                ("dq_loan_rules", "v_dirty_loans", Q.LOAN_RULES),
                                ("dq_repayment_rules", "v_dirty_repayments", Q.REPAYMENT_RULES),
                                ("dq_snapshot_rules", "v_dirty_snapshots", Q.SNAPSHOT_RULES),
                                ("dq_macro_rules", "v_dirty_macro", Q.MACRO_RULES)):
    register(_name)(_rules(_view, _rules_of))

#: Primary keys of the six tables.
KEYS = {"v_dirty_customers": ["CustomerID"], "v_dirty_loans": ["LoanID"], "v_dirty_repayments": ["RepaymentID"],
        "v_dirty_snapshots": ["LoanID", "SnapshotDate"], "v_dirty_macro": ["MonthDate"], "v_dirty_scores": ["LoanID"]}


@register("dq_duplicate_keys")
def _keys(spark, b):
    """Table, DuplicateKeys, ExcessRows for the six primary keys (NULL counts as a value)."""
    frames = dirty_book(spark)
    out = None
    for view, key in KEYS.items():
        d = Q.duplicate_keys(frames[view], key).agg(
            F.count(F.lit(1)).alias("DuplicateKeys"),
            F.coalesce(F.sum(F.col("N") - 1), F.lit(0)).cast("long").alias("ExcessRows")).select(
            F.lit(view).alias("Table"), "DuplicateKeys", "ExcessRows")
        out = d if out is None else out.unionByName(d)
    return out


@register("dq_orphan_loans")
def _orphan_loans(spark, b):
    return Q.orphan_count(dirty_book(spark)["v_dirty_loans"], b.customers, "CustomerID", "OrphanLoans")


@register("dq_orphan_repayments")
def _orphan_repayments(spark, b):
    return Q.orphan_count(dirty_book(spark)["v_dirty_repayments"], b.loans, "LoanID", "OrphanRepayments")


@register("dq_fk_violations")
def _fk(spark, b):
    d = dirty_book(spark)
    return (Q.fk_violations(d["v_dirty_loans"], b.customers, "CustomerID", "loans")
            .unionByName(Q.fk_violations(d["v_dirty_repayments"], b.loans, "LoanID", "repayments"))
            .unionByName(Q.fk_violations(d["v_dirty_snapshots"], b.loans, "LoanID", "snapshots")))


@register("dq_future_loans")
def _future(spark, b):
    return Q.future_loans(dirty_book(spark)["v_dirty_loans"].filter("LoanID IS NOT NULL").distinct(), AS_OF, 10)


@register("dq_future_dates")
def _future_dates(spark, b):
    return Q.future_dates(dirty_book(spark)["v_dirty_loans"], AS_OF)


@register("dq_quarantine_loans")
def _quarantine(spark, b):
    """Sort, N: loans that pass and loans by number of broken rules."""
    good, bad = Q.quarantine(dirty_book(spark)["v_dirty_loans"], Q.LOAN_RULES)
    return good.groupBy(F.lit(0).alias("Broken")).agg(F.count(F.lit(1)).alias("N")).unionByName(
        bad.groupBy(F.size("FailedRules").alias("Broken")).agg(F.count(F.lit(1)).alias("N")))


@register("dq_lenient_parse")
def _lenient(spark, b):
    """Values of text columns that do and do not parse, coerced leniently."""
    text = b.loans.select(
        F.when(F.col("LoanID") % 11 == 3, F.lit("n/a")).otherwise(F.col("LoanAmount").cast("string")).alias("amount"),
        F.when(F.col("LoanID") % 13 == 4, F.lit("2024-13-45")).otherwise(F.col("OriginationDate").cast("string")).alias("day"))
    parsed = text.select(coerce_numeric("amount", "double", strict=False).alias("amount"),
                         parse_date("day", strict=False).alias("day"))
    return parsed.agg(F.count("amount").alias("Numbers"), F.count("day").alias("Dates"),
                      F.sum(F.col("amount").isNull().cast("int")).cast("long").alias("BadNumbers"),
                      F.sum(F.col("day").isNull().cast("int")).cast("long").alias("BadDates"))


#: Planted bad rows of each bulk-load file: table, schema, (column, condition, text instead).
BAD_ROWS = {
    "s1_rejects": ("Customers", schemas.CUSTOMERS, [("CreditScore", "CustomerID % 97 = 1", "high"), ("CustomerID", "CustomerID % 89 = 2", "")]),
    "s2_rejects": ("Loans", schemas.LOANS, [("LoanAmount", "LoanID % 101 = 2", "n/a"), ("OriginationDate", "LoanID % 103 = 3", "31/12/1997"),
                                            ("CustomerID", "LoanID % 107 = 4", "")]),
    "s3_rejects": ("Repayments", schemas.REPAYMENTS, [("DaysLate", "LoanID % 109 = 5", "12.5"), ("PaymentAmount", "LoanID % 113 = 6", "12.5.0"),
                                                      ("PaymentDate", "LoanID % 127 = 7", "")]),
    "s4_rejects": ("Macroeconomics", schemas.MACRO, [("InflationRate", "InflationRate > 4", "4%")]),
    "s5_rejects": ("LoanPerformanceSnapshots", schemas.SNAPSHOTS, [("SnapshotDate", "LoanID % 131 = 8", "today"),
                                                                   ("OutstandingAmount", "LoanID % 137 = 9", "-")]),
}


def _rejects(table: str, schema, bad):
    def run(spark, b):
        """Loaded rows and rejects of a bulk-load file with planted bad rows, by reason."""
        df = readers.as_table(b.tables()[table], schema)
        for column, condition, text in bad:
            df = df.withColumn(f"bad_{column}", F.coalesce(F.expr(condition), F.lit(False)))
        lines = df.select(*[F.when(F.col(f"bad_{c}"), dict((n, t) for n, _, t in bad)[c]).otherwise(F.col(c).cast("string")).alias(c)
                            if c in [n for n, *_ in bad] else F.col(c).cast("string").alias(c) for c in schema.names])
        path = scratch_path(spark, f"bulk-{table}")
        readers.write_csv_table(lines, path)
        rows, rejects = readers.load_csv(spark, path, schema, max_errors=None)
        return rows.agg(F.lit("loaded").alias("Outcome"), F.count(F.lit(1)).alias("N")).unionByName(
            rejects.groupBy(F.col("Reason").alias("Outcome")).agg(F.count(F.lit(1)).alias("N")))
    return run


for _name, (_table, _schema, _bad) in BAD_ROWS.items():
    register(_name)(_rejects(_table, _schema, _bad))


def _rejects_sql(view: str, malformed: str, empty: list[tuple[str, str]]) -> str:
    """Counts by outcome: a malformed row is that first; else the required columns that are empty."""
    reason = " ".join(f"WHEN {c} THEN 'empty: {n}'" for n, c in empty)
    return f"""SELECT Outcome, COUNT(*) AS N FROM (SELECT CASE WHEN {malformed} THEN 'malformed' {reason} ELSE 'loaded' END AS Outcome
FROM {view}) o GROUP BY Outcome"""


def _count(rule: str, view: str, broken: str) -> str:
    return f"SELECT '{rule}' AS Rule, CAST(COUNT(*) AS BIGINT) AS Violations FROM {view} WHERE {broken}"


def _counts(view: str, rows: list[tuple[str, str]]) -> str:
    return "\nUNION ALL\n".join(_count(rule, view, broken) for rule, broken in rows)


_LOAN_BROKEN = [
    ("LoanAmount > 0", "LoanAmount <= 0"), ("InterestRate > 0", "InterestRate <= 0"), ("TermMonths > 0", "TermMonths <= 0"),
    ("Status IN (Current, Delinquent, Defaulted, PaidOff)",
     "Status <> 'Current' AND Status <> 'Delinquent' AND Status <> 'Defaulted' AND Status <> 'PaidOff'"),
    ("LoanID IS NOT NULL", "LoanID IS NULL"), ("CustomerID IS NOT NULL", "CustomerID IS NULL"),
    ("len(Status) <= 30", "length(Status) > 30"), ("len(RiskGradeAtOrigination) <= 10", "length(RiskGradeAtOrigination) > 10")]

_SQL: dict[str, str] = {
    "s1_rejects": _rejects_sql("v_customers", "CustomerID % 97 = 1", [("CustomerID", "CustomerID % 89 = 2")]),
    "s2_rejects": _rejects_sql("v_loans", "LoanID % 101 = 2 OR LoanID % 103 = 3", [("CustomerID", "LoanID % 107 = 4")]),
    "s3_rejects": _rejects_sql("v_repayments", "LoanID % 109 = 5 OR LoanID % 113 = 6", [("PaymentDate", "LoanID % 127 = 7")]),
    "s4_rejects": _rejects_sql("v_macro", "InflationRate > 4", []),
    "s5_rejects": _rejects_sql("v_snapshots", "LoanID % 131 = 8 OR LoanID % 137 = 9", []),
    "dq_customer_rules": _counts("v_dirty_customers", [
        ("YearsInBusiness >= 0", "YearsInBusiness < 0"), ("CreditScore BETWEEN 300 AND 900", "CreditScore < 300 OR CreditScore > 900"),
        ("CustomerID IS NOT NULL", "CustomerID IS NULL"), ("CustomerName IS NOT NULL", "CustomerName IS NULL"),
        ("len(CustomerName) <= 100", "length(CustomerName) > 100"), ("len(Industry) <= 50", "length(Industry) > 50"),
        ("len(Region) <= 50", "length(Region) > 50")]),
    "dq_loan_rules": _counts("v_dirty_loans", _LOAN_BROKEN),
    "dq_repayment_rules": _counts("v_dirty_repayments", [
        ("PaymentAmount >= 0", "PaymentAmount < 0"), ("DueAmount >= 0", "DueAmount < 0"), ("DaysLate >= 0", "DaysLate < 0"),
        ("LoanID IS NOT NULL", "LoanID IS NULL"), ("PaymentDate IS NOT NULL", "PaymentDate IS NULL")]),
    "dq_snapshot_rules": _counts("v_dirty_snapshots", [
        ("LoanID IS NOT NULL", "LoanID IS NULL"), ("SnapshotDate IS NOT NULL", "SnapshotDate IS NULL")]),
    "dq_macro_rules": _counts("v_dirty_macro", [("MonthDate IS NOT NULL", "MonthDate IS NULL")]),
    "dq_duplicate_keys": "\nUNION ALL\n".join(
        f"SELECT '{view}' AS \"Table\", COUNT(*) AS DuplicateKeys, CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS ExcessRows "
        f"FROM (SELECT COUNT(*) AS n FROM {view} GROUP BY {', '.join(key)} HAVING COUNT(*) > 1) k{i}"
        for i, (view, key) in enumerate(KEYS.items())),
    "dq_orphan_loans": "SELECT COUNT(*) AS OrphanLoans FROM v_dirty_loans l LEFT JOIN v_customers c ON l.CustomerID = c.CustomerID WHERE c.CustomerID IS NULL",
    "dq_orphan_repayments": "SELECT COUNT(*) AS OrphanRepayments FROM v_dirty_repayments r LEFT JOIN v_loans l ON r.LoanID = l.LoanID WHERE l.LoanID IS NULL",
    "dq_fk_violations": "\nUNION ALL\n".join(
        f"SELECT '{name}' AS Rule, COUNT(*) AS Violations FROM v_dirty_{name} x WHERE x.{key} IS NOT NULL "
        f"AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = x.{key})"
        for name, key, parent in (("loans", "CustomerID", "v_customers"), ("repayments", "LoanID", "v_loans"),
                                  ("snapshots", "LoanID", "v_loans"))),
    "dq_future_loans": f"""SELECT LoanID, strftime(OriginationDate, '%Y-%m-%d') AS OriginationDate FROM (SELECT DISTINCT LoanID, OriginationDate
FROM v_dirty_loans WHERE LoanID IS NOT NULL AND OriginationDate > DATE '{AS_OF}') f ORDER BY LoanID LIMIT 10""",
    "dq_future_dates": f"SELECT COUNT(*) AS Violations FROM v_dirty_loans WHERE OriginationDate > DATE '{AS_OF}'",
    "dq_quarantine_loans": "SELECT Broken, COUNT(*) AS N FROM (SELECT CAST(" + " + ".join(
        f"CASE WHEN {broken} THEN 1 ELSE 0 END" for _, broken in _LOAN_BROKEN) + " AS INT) AS Broken FROM v_dirty_loans) s GROUP BY Broken",
    "dq_lenient_parse": """SELECT COUNT(*) FILTER (LoanID % 11 <> 3) AS Numbers, COUNT(*) FILTER (LoanID % 13 <> 4) AS Dates,
COUNT(*) FILTER (LoanID % 11 = 3) AS BadNumbers, COUNT(*) FILTER (LoanID % 13 = 4) AS BadDates FROM v_loans""",
}


def oracle() -> dict[str, str]:
    return {k: with_views(v, DIRTY_SQL) for k, v in _SQL.items()}
