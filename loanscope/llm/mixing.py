"""Mixing sources to target weights: capped water-filling, native DataFrame code.

Sources by code point (null last) weigh 3, 1, 2, repeating.  Targets share
``budget`` times all words by weight, each clamped at ``epochs`` times its
source's words; the excess is reshared by weight until no target is above.
Clamping source after source in order of words per weight reaches that fixed
point in one sorted pass over the sources.

Each document is taken ``floor(target / source size)`` times.  The rest of the
target goes to documents in seeded hash order until it is used up; the last
one is taken in part, so a source misses its target by less than one word.
Hash buckets carry the running totals, so no source is ever sorted whole.

Defined results: null or empty text has size 0 and is never taken; null
sources are one source; an empty table gives no rows; repeated rows count
each; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanscope.llm.common import SPACED_WORD, materialize, table, word_count

# Weights by source rank, budget, cap and seed of the mix.
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
EPOCHS = 2
SEED = "mix-1:"
BUCKET_DIGITS = 3  # 4096 hash buckets a source


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target from rows of (source, size).  One row a source,
    so the windows without partitions see as many rows as there are sources."""
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int"))
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    s = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
         .withColumn("weight", weight)
         .withColumn("cap", (F.col("source_size") * epochs).cast("double"))
         .withColumn("all", F.lit(budget) * F.sum("source_size").over(Window.partitionBy()).cast("double"))
         .withColumn("clamped_before", F.coalesce(
             F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("weight_left", F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("left", F.col("all") - F.col("clamped_before"))
         .withColumn("free", F.col("left") * F.col("weight") < F.col("cap") * F.col("weight_left")))
    # The first free source fixes the water level of all free ones.
    first = F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "left", "weight_left")
    level = F.min(F.when(F.col("free"), first)).over(Window.partitionBy())
    return s.withColumn("level", level).select(
        "source", "source_size",
        F.when(F.col("free"), F.col("level.left") * F.col("weight") / F.col("level.weight_left"))
        .otherwise(F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS, seed: str = SEED,
        carry: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``docs``;
    ``carry`` adds the row itself as the struct ``row``."""
    order = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    wide = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order.alias("h"),
                       F.substring(order, 1, BUCKET_DIGITS).alias("bucket"), F.struct(*docs.columns).alias("row"))
    rows = materialize(wide.drop("row"), "mix-rows")
    targets = source_targets(rows, weights, budget, epochs)
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
               .withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))))
    plan = buckets.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select(
        F.col("b.source").alias("source_b"), F.col("bucket").alias("bucket_b"), "before", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
        .cast("long").alias("whole"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = (wide if carry else rows).withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        plan, F.col("source").eqNullSafe(F.col("source_b")) & (F.col("bucket") == F.col("bucket_b")))
    rest = F.floor(F.col("target")) - F.col("whole") * F.col("source_size") - F.col("before") - F.col("inside")
    return placed.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("whole") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))).cast("long")
        .alias("taken"), *(["row"] if carry else []))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS,
                    seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; the one document
    of a source that is taken in part counts when half of it or more is."""
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    taken = mix(docs, weights, budget, epochs, seed, carry=True).select("row", copies.alias("n")).where("n > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mix_sql(docs: str, seed: str = SEED) -> str:
    """DuckDB SQL of ``mix`` over the relation ``docs`` (same hash, same order)."""
    weights = ", ".join(f"{w}.0::DOUBLE" for w in WEIGHTS)
    return f"""
WITH r AS (SELECT *, substr(h, 1, {BUCKET_DIGITS}) AS bucket FROM (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{SPACED_WORD}')), 0)::BIGINT AS size,
           md5('{seed}' || coalesce(doc_id::VARCHAR, '')) AS h FROM {docs})),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
s1 AS (SELECT *, ([{weights}])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight,
              (source_size * {EPOCHS})::DOUBLE AS cap, {BUDGET} * (sum(source_size) OVER ())::DOUBLE AS total FROM s0),
s2 AS (SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
              sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM s1),
lv AS (SELECT rest AS lv_rest, weight_left AS lv_weight FROM s2 WHERE rest * weight < cap * weight_left
       ORDER BY cap / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size,
             CASE WHEN rest * weight < cap * weight_left THEN lv_rest * weight / lv_weight ELSE cap END AS target
      FROM s2 LEFT JOIN lv ON true),
c AS (SELECT r.doc_id, r.source, r.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS whole,
             coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.h, r.doc_id, r.size
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       (whole * size + greatest(0, least(size, floor(target)::BIGINT - whole * source_size - before)))::BIGINT AS taken
FROM c"""


OP6_SQL = f"SELECT doc_id, size, source_size, target, taken FROM ({mix_sql('documents')})"
