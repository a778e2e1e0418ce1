"""Readers: header CSV (the bulk-load format) and Parquet, always schema-typed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loanscope.session import scratch_path
from loanscope.sources import schemas


def read_csv_table(spark: SparkSession, path: str, schema: StructType, mode: str = "FAILFAST") -> DataFrame:
    """Header row, ',' delimiter, '"' quote/escape, LF rows, ISO dates.

    Columns are taken by position against ``schema`` (as a bulk load does); a
    malformed value fails the job (FAILFAST) unless ``mode='PERMISSIVE'``."""
    return (spark.read.schema(schema)
            .option("header", True).option("sep", ",").option("quote", '"').option("escape", '"')
            .option("mode", mode).option("dateFormat", "yyyy-MM-dd")
            .option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path))


#: Rejected rows beyond which a load fails (the bulk loader's default).
MAX_ERRORS = 10
_RECORD = "_corrupt_record"


def read_with_rejects(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows of ``schema``, rejects: Record, Reason) of a header CSV.

    A row is rejected when a value does not parse, it has another number of fields, or a
    required column is empty.  The file is parsed once, whole rows at a time, into the
    shared scratch folder; both results read that."""
    wide = StructType([*schema.fields, StructField(_RECORD, StringType())])
    parsed = (spark.read.schema(wide).option("header", True).option("sep", ",").option("quote", '"').option("escape", '"')
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _RECORD).option("dateFormat", "yyyy-MM-dd")
              .option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path))
    missing = F.concat_ws(", ", *[F.when(F.col(f.name).isNull(), F.lit(f.name)) for f in schema.fields if not f.nullable])
    reason = F.when(F.col(_RECORD).isNotNull(), "malformed").when(missing != "", F.concat(F.lit("empty: "), missing))
    out = scratch_path(spark, "csv-load")
    parsed.withColumn("_reason", reason).write.parquet(out)
    rows = spark.read.parquet(out)
    line = F.coalesce(F.col(_RECORD), F.concat_ws(",", *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in schema.names]))
    return (rows.where("_reason IS NULL").select(*schema.names),
            rows.where("_reason IS NOT NULL").select(line.alias("Record"), F.col("_reason").alias("Reason")))


def load_csv(spark: SparkSession, path: str, schema: StructType, max_errors: int | None = MAX_ERRORS) -> tuple[DataFrame, DataFrame]:
    """``read_with_rejects`` that fails when more than ``max_errors`` rows are rejected (None: never)."""
    rows, rejects = read_with_rejects(spark, path, schema)
    if max_errors is not None:
        errors = rejects.count()
        if errors > max_errors:
            first = rejects.orderBy("Record").first()
            raise ValueError(f"{path}: {errors} rows rejected, more than {max_errors}; one of them ({first['Reason']}): {first['Record']}")
    return rows, rejects


def read_customers(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_table(spark, path, schemas.CUSTOMERS)


def read_loans(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_table(spark, path, schemas.LOANS)


def read_repayments(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_table(spark, path, schemas.REPAYMENTS)


def read_macro(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_table(spark, path, schemas.MACRO)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_table(spark, path, schemas.SNAPSHOTS)


READERS = {
    "Customers": read_customers,
    "Loans": read_loans,
    "Repayments": read_repayments,
    "Macroeconomics": read_macro,
    "LoanPerformanceSnapshots": read_snapshots,
}


def load_tables(spark: SparkSession, directory: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """All five tables from ``directory/<Table>.<fmt>`` (full scans, lazily)."""
    if fmt == "csv":
        return {name: READERS[name](spark, f"{directory}/{name}.csv") for name in READERS}
    return {name: spark.read.schema(schemas.BY_TABLE[name]).parquet(f"{directory}/{name}.parquet")
            for name in READERS}


def customer_dims(customers: DataFrame) -> DataFrame:
    """CustomerID, Region, Industry (projected scan: the reader prunes other columns)."""
    return customers.select("CustomerID", "Region", "Industry")


def write_csv_table(df: DataFrame, path: str) -> None:
    """Header CSV in the bulk-load format (one file per partition)."""
    (df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .option("dateFormat", "yyyy-MM-dd").option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path))


def as_table(df: DataFrame, schema: StructType) -> DataFrame:
    """Project/cast a frame onto a table schema, NULL for missing columns."""
    cols = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)
