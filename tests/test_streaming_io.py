"""Streaming micro-batch upsert, CSV strictness, numeric coercion."""

import pytest
from pyspark.sql import functions as F

from loanscope.functions.columns import coerce_numeric, parse_date
from loanscope.operators import upsert as U
from loanscope.plans import catalog as C
from loanscope.sources import readers, schemas
from loanscope.streaming.scoring import start_scoring_stream


def test_stream_scores_and_upserts(spark, book, tmp_path):
    enc, feats = C.training_frame(spark, book)
    fitted = C.logistic(spark, book)
    src = str(tmp_path / "incoming")
    cols = list(dict.fromkeys(["LoanID", "CustomerID", "LoanAmount", "OutstandingAmount", *feats, "DefaultFlag"]))
    early = enc.filter(F.col("OriginationDate") < F.lit("1997-01-01").cast("date")).select(*cols)
    late = enc.filter(F.col("OriginationDate") >= F.lit("1997-01-01").cast("date")).select(*cols)
    early.write.parquet(f"{src}/a")
    schema = early.schema
    root = str(tmp_path / "scores")
    q = start_scoring_stream(spark, f"{src}/*", schema, fitted, root, 0.5, "2002-01-01 00:00:00",
                             checkpoint=str(tmp_path / "ckpt"))
    q.awaitTermination()
    late.write.parquet(f"{src}/b")
    q = start_scoring_stream(spark, f"{src}/*", schema, fitted, root, 0.5, "2002-01-02 00:00:00",
                             checkpoint=str(tmp_path / "ckpt"))
    q.awaitTermination()
    current = U.read_current(spark, root)
    assert current.count() == enc.count()
    assert current.select("LoanID").distinct().count() == enc.count()
    stamps = {str(r.ScoreDate)[:10]: r["count"] for r in current.groupBy("ScoreDate").count().collect()}
    assert stamps == {"2002-01-01": early.count(), "2002-01-02": late.count()}


def test_csv_failfast_on_bad_value(spark, tmp_path):
    path = tmp_path / "loans.csv"
    path.write_text("LoanID,CustomerID,LoanAmount,InterestRate,TermMonths,OriginationDate,Status,RiskGradeAtOrigination\n"
                    "1,2,abc,5.5,12,2001-01-01,Current,A\n")
    with pytest.raises(Exception):
        readers.read_csv_table(spark, str(path), schemas.LOANS).collect()
    rows = readers.read_csv_table(spark, str(path), schemas.LOANS, mode="PERMISSIVE").collect()
    assert rows[0].LoanAmount is None


def test_coerce_numeric(spark):
    df = spark.createDataFrame([("1.5",), ("x",)], "v string")
    assert [r[0] for r in df.select(coerce_numeric("v", strict=False)).collect()] == [1.5, None]
    with pytest.raises(Exception):
        df.select(coerce_numeric("v")).collect()


def test_parse_date(spark):
    df = spark.createDataFrame([("2001-02-03",), ("bad",)], "v string")
    got = [r[0] for r in df.select(parse_date("v", strict=False)).collect()]
    assert str(got[0]) == "2001-02-03" and got[1] is None
    with pytest.raises(Exception):
        df.select(parse_date("v")).collect()


def test_stream_restart_does_not_recommit(spark, book, tmp_path):
    enc, feats = C.training_frame(spark, book)
    fitted = C.logistic(spark, book)
    cols = list(dict.fromkeys(["LoanID", "CustomerID", "LoanAmount", "OutstandingAmount", *feats, "DefaultFlag"]))
    src = str(tmp_path / "in")
    enc.select(*cols).write.parquet(f"{src}/a")
    schema = enc.select(*cols).schema
    root, ckpt = str(tmp_path / "scores"), str(tmp_path / "ckpt")
    for stamp in ("2002-01-01 00:00:00", "2002-01-02 00:00:00"):  # the second start finds every file already committed in its checkpoint
        start_scoring_stream(spark, f"{src}/*", schema, fitted, root, 0.5, stamp, checkpoint=ckpt).awaitTermination()
    assert [str(r.ScoreDate)[:10] for r in U.read_current(spark, root).select("ScoreDate").distinct().collect()] == ["2002-01-01"]


LOAN_HEADER = "LoanID,CustomerID,LoanAmount,InterestRate,TermMonths,OriginationDate,Status,RiskGradeAtOrigination\n"


def test_rejects_keep_the_line_and_the_reason(spark, tmp_path):
    path = tmp_path / "loans.csv"
    path.write_text(LOAN_HEADER + "1,2,10.50,5.5,12,2001-01-01,Current,A\n" "2,2,abc,5.5,12,2001-01-01,Current,A\n"
                    "3,,10,5.5,12,2001-01-01,Current,A\n" "4,2,10,5.5,12\n" "5,2,10,5.5,12,2001-01-01,Current,A,more\n"
                    '6,2,"1,000",5.5,12,2001-01-01,"a ""quoted"" one",A\n' "7,2,,,,,,\n")
    rows, rejects = readers.load_csv(spark, str(path), schemas.LOANS)
    assert sorted(r.LoanID for r in rows.collect()) == [1, 6, 7]     # "1,000" is a number
    got = {r.Record.split(",")[0]: (r.Reason, r.Record) for r in rejects.collect()}
    assert {k: v[0] for k, v in got.items()} == {"2": "malformed", "3": "empty: CustomerID", "4": "malformed", "5": "malformed"}
    assert got["2"][1] == "2,2,abc,5.5,12,2001-01-01,Current,A"
    assert readers.load_csv(spark, str(path), schemas.LOANS, 4)[1].count() == 4
    with pytest.raises(ValueError, match="4 rows rejected, more than 3"):
        readers.load_csv(spark, str(path), schemas.LOANS, 3)


def test_an_empty_file_has_no_rejects(spark, tmp_path):
    path = tmp_path / "loans.csv"
    path.write_text(LOAN_HEADER)
    rows, rejects = readers.load_csv(spark, str(path), schemas.LOANS, 0)
    assert rows.count() == rejects.count() == 0
