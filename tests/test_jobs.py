"""The end-to-end jobs run on the smallest fixture and leave their outputs."""

import os

from pyspark.sql import functions as F

from loanscope.operators import upsert as U
from loanscope.plans.jobs import ModelJobConfig, model_job, validation_and_eda_job
from loanscope.sources.fixtures import AS_OF, load_book


def test_eda_job(spark, tmp_path):
    book = load_book(spark, "/root/testdata/sf0.001")
    paths = validation_and_eda_job(spark, book, str(tmp_path), AS_OF)
    assert spark.read.parquet(paths["table_counts"]).count() == 5
    assert spark.read.parquet(paths["fk_violations"]).agg(F.sum("Violations")).first()[0] == 0


def test_model_job(spark, tmp_path):
    book = load_book(spark, "/root/testdata/sf0.001")
    cfg = ModelJobConfig(as_of=AS_OF, score_ts="2002-01-01 00:00:00", search_iter=0,
                         forest={"num_trees": 10, "max_depth": 4, "min_instances": 1, "subset": "sqrt"})
    out = model_job(spark, book, str(tmp_path), cfg)
    assert spark.read.parquet(out["model_comparison"]).count() == 3
    assert len(out["scores_buckets"]) == U.BUCKETS
    assert U.read_current(spark, str(tmp_path / "PredictedLoanScores")).count() == book.loans.count()
    row = spark.read.option("header", True).csv(os.path.join(str(tmp_path), "model_eval_summary_csv")).first()
    assert row["Model"] == out["chosen"] and float(row["Threshold"]) == out["threshold"]
    assert 0.0 <= out["accuracy_baseline"] <= 1.0
