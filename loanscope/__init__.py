"""loanscope: distributed credit-risk analytics on Spark DataFrames.

Layout
------
sources/    typed schemas, CSV/Parquet readers, fixture views, sinks
functions/  reusable Column expressions (ratios, bands, month keys, flags)
operators/  DataFrame -> DataFrame jobs: quality rules, portfolio aggregates,
            feature table, splits, metrics, risk products, upsert, models,
            oversampling and explanations
plans/      the query catalogue (one callable per operator) and its SQL oracle
streaming/  micro-batch scoring/upsert over a file stream
"""

__version__ = "0.1.0"
