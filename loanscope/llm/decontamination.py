"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

A benchmark item's windows are its 13 consecutive words (all words of a shorter
item).  Each window is filed under its longest word, the anchor.  The words of a
document meet the broadcast windows by their anchors' hashes inside the scanning
task, and the words around a met anchor are compared with the window at once, in one
generated loop: a text's word array is not copied, and only occurrences go on.
Nothing is shuffled but these.

The windows are broadcast in parts of at most ``PART_BYTES``, one pass over the documents
each: a benchmark of any size takes the same plan.  Item ids, which have no bound,
stay out of it and are joined to the hits.

Defined results: null or empty text has no words and is clean; an empty
benchmark hits nothing; equal (id, text) rows get equal results each; an item
without id counts its hits but is no item; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.llm.common import LOWER, PLAIN_WORD, UPPER, ascii_lower, materialize, table

WINDOW = 13
MARK = "\x00"               # no word holds it
PART_BYTES = 64 << 20      # of windows that are broadcast at once
MIN_PERCENT = 5            # a document is contaminated when 5 % of its words or more are hit
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(PLAIN_WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """g, win, k, items, a, off: each distinct window, its hash and number of words, the hash of its
    anchor and that word's place."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w"))
    n = F.size("w")
    starts = F.transform(F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))),
                         lambda i: F.slice("w", i, WINDOW))
    wins = items.where(n > 0).select("item", F.explode(starts).alias("win")).groupBy("win").agg(
        F.collect_set("item").alias("items"))
    longest = F.array_max(F.transform("win", lambda w, i: F.struct(
        F.length(w).alias("l"), w.alias("w"), i.alias("i"))))
    return wins.withColumn("top", longest).select(
        F.xxhash64("win").alias("g"), "win", F.size("win").alias("k"), "items", F.xxhash64("top.w").alias("a"),
        F.col("top.i").alias("off"))


def find_hits(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, h (hash of the text), n_words, hit (word
    positions inside a window's occurrence), items."""
    windows = materialize(benchmark_windows(benchmark), "decontamination-windows")
    held = F.octet_length(F.array_join("win", " ")) + 16 * F.col("k") + 64
    parts = int((windows.agg(F.sum(held)).first()[0] or 0) // part_bytes) + 1
    # A mark behind the last word meets a window of no words: each row of docs sends one such
    # hit, whose place is its number of words, so the texts are split into words once.
    words = F.concat(words_of(F.col("text")), F.array(F.lit(MARK)))
    met = docs.select("doc_id", F.xxhash64("text").alias("h"), words.alias("w")).select(
        "doc_id", "h", "w", F.posexplode_outer("w").alias("p", "word"))
    mark = windows.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("g"), F.array().cast("array<string>").alias("win"), F.lit(0).alias("k"),
        F.xxhash64(F.lit(MARK)).alias("a"), F.lit(0).alias("off"))
    first = F.col("p") - F.col("off")
    same = F.when(first >= 0, F.slice("w", F.greatest(first, F.lit(0)) + 1, F.col("k")) == F.col("win"))
    found = None
    for part in range(parts):
        known = windows.where(F.pmod("g", F.lit(parts)) == part).select("g", "win", "k", "a", "off")
        known = known if part else known.union(mark)
        some = met.join(F.broadcast(known), F.xxhash64("word") == F.col("a")).where(same).select(
            "doc_id", "h", first.alias("s"), "k", "g")
        found = some if found is None else found.union(some)
    hit, end = F.col("k") > 0, F.col("k") == 0
    hits = materialize(found.groupBy("doc_id", "h").agg(
        F.max(F.when(end, F.col("s"))).cast("long").alias("n_words"), F.count(F.when(end, 1)).alias("rows"),
        F.collect_set(F.when(hit, F.struct("s", "k"))).alias("at"), F.collect_set(F.when(hit, F.col("g"))).alias("g")),
        "decontamination-hits")
    items = hits.select("doc_id", "h", F.explode("g").alias("g")).join(windows.select("g", "items"), "g").groupBy(
        F.col("doc_id").alias("i_id"), F.col("h").alias("i_h")).agg(F.collect_set("items").alias("items"))
    spots = F.array_sort(F.array_distinct(F.flatten(F.transform("at", lambda o: F.sequence(o.s, o.s + o.k - 1)))))
    return hits.join(items, F.col("doc_id").eqNullSafe(F.col("i_id")) & (F.col("h") == F.col("i_h")), "left").select(
        "doc_id", "h", "n_words", spots.alias("hit"),
        F.coalesce(F.array_sort(F.array_distinct(F.flatten("items"))), F.array().cast("array<string>")).alias("items"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("col")


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (n_hit * 100 >= n_words * MIN_PERCENT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents") -> DataFrame:
    """``docs`` without contaminated documents (``remove="documents"``), or with
    the hit words cut out of every text (``remove="spans"``)."""
    tail = "_" * max(len(c) for c in docs.columns)      # no column of docs
    found = find_hits(docs, benchmark).where(F.size("hit") > 0).select(
        *[F.col(c).alias(c + tail) for c in ("doc_id", "h", "n_words", "hit")])
    mine = docs["doc_id"].eqNullSafe(F.col(f"doc_id{tail}")) & (F.xxhash64(docs["text"]) == F.col(f"h{tail}"))
    if remove == "documents":
        bad = found.where(is_contaminated(F.size(f"hit{tail}"), F.col(f"n_words{tail}"))).hint("merge")  # no bound: not broadcast
        return docs.join(bad, mine, "left_anti")
    joined = docs.join(found.groupBy(f"doc_id{tail}", f"h{tail}").agg(F.first(f"hit{tail}").alias(f"hit{tail}")), mine, "left")
    text, hit = docs["text"], F.col(f"hit{tail}")
    own = F.regexp_extract_all(text, F.lit(ANY_CASE_WORD), F.lit(0))
    kept = F.transform(F.split(text, ANY_CASE_WORD, -1), lambda gap, i: F.concat(gap, F.when(
        (i < F.size(own)) & ~F.array_contains(hit, i), F.get(own, i)).otherwise("")))
    rest = F.when(hit.isNull(), text).otherwise(F.array_join(kept, ""))
    return joined.select(*[rest.alias("text") if c == "text" else docs[f"`{c}`"] for c in docs.columns])


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all benchmark windows in all documents."""
    found = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated(n_hit, F.col("n_words")).alias("contaminated"))


def hits_sql(docs: str) -> str:
    """DuckDB SQL: rid, doc_id, n_words, n_hit, n_items, items over the relation ``docs``."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PLAIN_WORD}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM {docs}),
b AS (SELECT item_id::VARCHAR AS item, {words} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS k, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win
       FROM b, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) AS t(i) WHERE len(w) > 0),
dw AS (SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM d, (SELECT DISTINCT k FROM bw), unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k),
hit AS (SELECT rid, i, dw.k, item FROM dw JOIN bw USING (win, k)),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit
        FROM (SELECT DISTINCT rid, i, k FROM hit), unnest(range(i, i + k)) AS u(p) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT rid, doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items, '') AS items
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)"""


OP2_SQL = f"""SELECT doc_id, n_words, n_hit, n_items, sha256(items) AS items_sha256,
n_hit > 0 AND n_hit * 100 >= n_words * {MIN_PERCENT} AS contaminated FROM ({hits_sql('documents')})"""
