"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import sys
import time
from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.session import scratch_path

# The contract's word patterns (Java, DuckDB and Python read them alike).
SPACED_WORD = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ship(module: str) -> None:
    """Let a module's task functions travel by value, so that executors need no install."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back: cuts
    lineage, and a lost executor costs a re-read instead of a recompute."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of jobs whose frames are gone.

    Called between the steps of an operator, after their results are written:
    the shuffle of a finished step then does not occupy the executors' disks
    during the next.  A hint only; no result depends on it.  The first round
    frees the plans, the second what they held."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def batches_of(texts: Sequence[str | None], limit: int = 4 << 20):
    """Positions of ``texts`` in runs of about ``limit`` characters."""
    size = np.cumsum([len(t) if isinstance(t, str) else 0 for t in texts])
    return np.split(np.arange(len(texts)), np.searchsorted(size, np.arange(limit, size[-1], limit))) if len(texts) else []


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; pure ASCII texts take the cheap built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Number of blank-separated words as long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


ship(__name__)
