"""Micro-batch scoring and upsert over a file stream.

The batch job scores a loan book and MERGEs the scores into the
PredictedLoanScores table.  The same step runs incrementally here: new
feature files arriving in a folder are read with ``readStream`` (schema
fixed, never inferred), each micro-batch is scored by the fitted pipeline
and merged into the table inside ``foreachBatch``.  The
stream's own checkpoint (in the shared checkpoint folder) records which
files were processed, and a batch re-run after a failure merges the same
rows again, which changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from loanscope.operators import models as M
from loanscope.operators import upsert as U
from loanscope.session import scratch_path


def score_batch(fitted: M.Fitted, batch: DataFrame, threshold: float) -> DataFrame:
    """Scores rows in the PredictedLoanScores layout (ScoreDate set at commit)."""
    keep = ["LoanID", "CustomerID", "LoanAmount", "OutstandingAmount"]
    return M.score(fitted, batch, threshold, keep=keep)


def start_scoring_stream(spark: SparkSession, source_dir: str, schema: StructType, fitted: M.Fitted,
                         table_root: str, threshold: float, ts: str, checkpoint: str | None = None,
                         available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the stream: parquet files in ``source_dir`` -> scores -> merged into ``table_root``.

    ``ts`` stamps ScoreDate (a parameter, so replays are reproducible)."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)

    def commit(batch: DataFrame, epoch_id: int) -> None:
        if batch.isEmpty():
            return
        U.commit_upsert(spark, table_root, score_batch(fitted, batch, threshold), ts)

    writer = (stream.writeStream.foreachBatch(commit)
              .option("checkpointLocation", checkpoint or scratch_path(spark, "scoring-stream")))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
