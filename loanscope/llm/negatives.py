"""Hard negatives from Hilbert-ordered blocks with zone maps.

Scores are integer inner products of quantised vectors.  An anchor's positives are its
best rows of the same label; for each, the best rows of other labels whose score lies
in a window below the positive's are its hard negatives.  Both are one search:
the best ``k`` rows of a window [low, high] of scores.

1. Candidates are ordered along a Hilbert curve and written as blocks of ``BLOCK``
   rows; a block keeps the least and the largest value of each dimension and its labels.
2. Interval arithmetic on these zone maps bounds an anchor's scores over a block from
   both sides.  A block is read only if the bounds meet the window and a label fits.
3. A first search reads the few blocks whose middle lies closest to the window's upper
   end; its k-th best score raises the window's lower end, which is exact because
   nothing below it can be among the best.  The second search then reads every block that
   is left, so the result is that of all rows: no block is dropped without a proof.
4. Anchors come in groups of ``GROUP`` neighbours on the curve, blocks one by one, so a
   task holds one block and one group at a time; it keeps the best rows of each window
   and hands on at most k a window and task.

Anchors against all rows is a stated query set; how much the bounds save depends on the
data: much for clusters, little for vectors without structure.

Defined results: rows without vec_id or label, without a vector, with null or non-finite
components, or with one of 2**19 or more in size take no part; shorter vectors count
as ended by zeros; rows that repeat a vec_id are rows of their own (an anchor that
stands twice gets its results twice); an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanscope.llm.common import materialize, release, ship, table

BLOCK = 1_024           # candidates of a block
GROUP = 256             # anchors compared with a block at once
ZONES = 2_048           # zone maps of a chunk, about 1 MB at 64 dimensions
HOME = 2                # blocks that the first search reads, a window and chunk
PART = 16               # blocks of one range of the curve
CURVE_DIMS, CURVE_BITS = 64, 4
MOST = 1 << 27          # size of a quantised component
KEPT = 500_000          # best rows a task holds before it thins them out
LOWEST, HIGHEST = -(1 << 62), 1 << 62
POSITIVES, NEGATIVES = 5, 3


# ---- arithmetic ------------------------------------------------------------------------------------

def hilbert_keys(x: np.ndarray, bits: int) -> list[bytes]:
    """Places on the Hilbert curve of points with coordinates from 0 to 2**bits - 1
    (Skilling's transposed form), as byte strings in order of the curve."""
    x = x.T.astype(np.int64)
    top = 1 << (bits - 1)
    bit = top
    while bit > 1:
        low = bit - 1
        for i in range(len(x)):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[i] ^= swap
            x[0] ^= np.where(on, low, swap if i else 0)
        bit >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, bit = np.zeros(x.shape[1], dtype=np.int64), top
    while bit > 1:
        turn ^= np.where(x[-1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= turn
    planes = [(x >> b) & 1 for b in range(bits - 1, -1, -1)]
    return [r.tobytes() for r in np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score that each row of ``a`` can have in each box."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return products(up, lo) + products(down, hi), products(up, hi) + products(down, lo)


def best(scores: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest fitting scores of each row; earlier columns win ties."""
    n = scores.shape[1]
    k = min(k, n)
    if int(np.abs(scores).max(initial=0)) < (1 << 61) // (n + 1):
        key = np.where(fits, scores * n + np.arange(n)[::-1], -(1 << 62))
        column = np.argpartition(key, n - k, axis=1)[:, n - k:]
    else:
        column = np.argsort(np.where(fits, -scores, 1 << 62), axis=1, kind="stable")[:, :k]
    row, place = np.nonzero(np.take_along_axis(fits, column, 1))
    return row, column[row, place]


def thinned(found: list[np.ndarray], k: int) -> np.ndarray:
    """The first k rows of (anchor row, window, -score, vec_id) of each anchor and window."""
    rows = np.concatenate(found, axis=1)
    rows = rows[:, np.lexsort(rows[::-1])]
    new = np.append(True, (rows[:2, 1:] != rows[:2, :-1]).any(0))
    begin = np.flatnonzero(new)
    return rows[:, np.arange(rows.shape[1]) - begin[np.cumsum(new) - 1] < k]


# ---- tables ----------------------------------------------------------------------------------------

def points_of(vectors: DataFrame, label: Column) -> DataFrame:
    """row, vec_id, label, q (quantised, packed), key (place on the curve) of the rows that take
    part, written once."""
    good = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < MOST / 256, F.lit(False)) & ~F.isnan(x))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), "embedding").where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(good).select(
        "vec_id", "label", F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("int")).alias("q"))
    dims, top = rows.agg(F.max(F.size("q")), F.max(F.array_max(F.transform("q", F.abs)))).first()
    dims, top = max(dims or 0, 1), top or 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = b.column("q")
            flat, size = q.flatten().to_numpy(), np.diff(q.offsets.to_numpy())
            x = np.zeros((len(q), dims), dtype=np.int32)
            x[np.arange(dims) < size[:, None]] = flat
            on_curve = (x[:, :CURVE_DIMS].astype(np.int64) + top << CURVE_BITS) // (2 * top + 1)
            yield pa.RecordBatch.from_pydict({
                "vec_id": b.column("vec_id"), "label": b.column("label"), "q": [r.tobytes() for r in x],
                "key": hilbert_keys(on_curve, CURVE_BITS)})

    packed = rows.mapInArrow(pack, "vec_id long, label long, q binary, key binary")
    return materialize(packed.withColumn("row", F.monotonically_increasing_id()), "negatives-points")


def along_curve(points: DataFrame, rows: int) -> DataFrame:
    """``points`` in ranges of the curve of about ``rows`` rows; equal places are split by vec_id."""
    parts = points.count() // rows + 1
    return points.repartitionByRange(parts, "key", "vec_id").sortWithinPartitions("key", "vec_id")


def in_runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.Table]:
    """Consecutive rows, ``length`` at a time."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= length:
            whole = pa.Table.from_batches(held)
            for at in range(0, n - n % length, length):
                yield whole.slice(at, length)
            held, n = whole.slice(n - n % length).to_batches(), n % length
    if n:
        yield pa.Table.from_batches(held)


def blocks_of(points: DataFrame) -> DataFrame:
    """One row a block: its zone map (lo, hi, labels in it) and its candidates in order of vec_id."""
    def make(batches):
        first = TaskContext.get().partitionId() << 32
        for no, t in enumerate(in_runs(batches, BLOCK)):
            t = t.sort_by([("vec_id", "ascending"), ("row", "ascending")])
            q = np.frombuffer(b"".join(t.column("q").to_pylist()), dtype=np.int32).reshape(t.num_rows, -1)
            label = t.column("label").to_numpy()
            yield pa.RecordBatch.from_pydict({
                "block": [first + no], "lo": [q.min(0).tobytes()], "hi": [q.max(0).tobytes()],
                "labels": [np.unique(label).tobytes()], "ids": [t.column("vec_id").to_numpy().tobytes()], "rows": [t.column("row").to_numpy().tobytes()],
                "of": [label.tobytes()], "q": [q.tobytes()]})

    return materialize(along_curve(points, BLOCK * PART).select("vec_id", "row", "label", "q").mapInArrow(
        make, "block long, lo binary, hi binary, labels binary, ids binary, rows binary, of binary, q binary"),
        "negatives-blocks")


def anchors_of(points: DataFrame) -> DataFrame:
    """Anchors with their group of neighbours on the curve."""
    def number(batches):
        first = TaskContext.get().partitionId() << 32
        for no, t in enumerate(in_runs(batches, GROUP)):
            yield from t.append_column("grp", pa.array([first + no] * t.num_rows, pa.int64())).combine_chunks().to_batches()

    return materialize(along_curve(points, GROUP * PART).select("row", "vec_id", "label", "q").mapInArrow(
        number, "row long, vec_id long, label long, q binary, grp long"), "negatives-anchors")


def zones_of(blocks: DataFrame) -> tuple[DataFrame, int]:
    """Zone maps in chunks of about ``ZONES``, and the number of chunks."""
    chunks = blocks.count() // ZONES + 1
    zones = blocks.groupBy(F.pmod(F.xxhash64("block"), F.lit(chunks)).alias("chunk")).agg(
        F.collect_list(F.struct("block", "lo", "hi", "labels")).alias("zones"))
    return materialize(zones, "negatives-zones"), chunks


# ---- search ----------------------------------------------------------------------------------------

def chosen(asked: DataFrame, zones: DataFrame, chunks: int, same: bool, home: int | None) -> DataFrame:
    """For each block that a group of ``asked`` (row, grp, label, q, low, high: arrays of windows) must
    read: its anchors, packed.  ``home``: only the so many nearest blocks of each window."""
    def choose(batches):
        for b in batches:
            for r in range(b.num_rows):
                who, zone = b.column("who")[r].values, b.column("zones")[r].values
                a = np.frombuffer(b"".join(who.field("q").to_pylist()), dtype=np.int32).reshape(len(who), -1)
                label, row = who.field("label").to_numpy(), who.field("row").to_numpy()
                low, high = (np.array(who.field(x).to_pylist(), dtype=np.int64) for x in ("low", "high"))
                lo, hi = (np.frombuffer(b"".join(zone.field(x).to_pylist()), dtype=np.int32).reshape(len(zone), -1)
                          for x in ("lo", "hi"))
                kinds, kind = np.unique(label, return_inverse=True)
                inside = [np.frombuffer(x, dtype=np.int64) for x in zone.field("labels").to_pylist()]
                some = np.stack([np.isin(kinds, x) if same else (len(x) > 1) | (kinds != x[0]) for x in inside], axis=1)[kind]
                least, most = bounds(a, lo, hi)
                # anchors x windows x blocks
                meets = (most[:, None] >= low[:, :, None]) & (least[:, None] <= high[:, :, None]) & some[:, None] & (
                    low <= high)[:, :, None]
                if home and home < len(zone):
                    far = np.abs(np.minimum(high, 1 << 58)[:, :, None] - ((least >> 1) + (most >> 1))[:, None])
                    far = np.where(meets, far, 1 << 62)
                    near = np.argpartition(far, home - 1, axis=2)[:, :, :home]
                    kept = np.zeros_like(meets)
                    np.put_along_axis(kept, near, True, axis=2)
                    meets &= kept
                reads = meets.any(1)
                for z in np.flatnonzero(reads.any(0)).tolist():
                    i = reads[:, z]
                    yield pa.RecordBatch.from_pydict({
                        "block": [zone.field("block")[z].as_py()], "row": [row[i].tobytes()], "label": [label[i].tobytes()],
                        "low": [low[i].tobytes()], "high": [high[i].tobytes()], "a": [a[i].tobytes()]})

    every = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    groups = every.groupBy("grp", "chunk").agg(F.collect_list(F.struct("row", "label", "q", "low", "high")).alias("who"))
    return groups.join(zones, "chunk").select("who", "zones").mapInArrow(
        choose, "block long, row binary, label binary, low binary, high binary, a binary")


def searched(asked: DataFrame, blocks: DataFrame, zones: DataFrame, chunks: int, same: bool, k: int,
             home: int | None) -> DataFrame:
    """row, window, place (from 0), score, vec_id: the best k rows of each window of ``asked``, of
    the same or of other labels, in the blocks chosen for it."""
    def compare(batches):
        found, held = [], 0

        def sent():
            row, window, score, vec = thinned(found, k)
            return pa.RecordBatch.from_pydict({"row": row, "window": window, "score": -score, "vec_id": vec})

        for b in batches:
            for r in range(b.num_rows):
                get = lambda c, t=np.int64: np.frombuffer(b.column(c)[r].as_buffer(), dtype=t)  # noqa: E731, B023
                row, label, ids, rows, of = (get(c) for c in ("row", "label", "ids", "rows", "of"))
                low, high = (get(c).reshape(len(row), -1) for c in ("low", "high"))
                scores = products(get("a", np.int32).reshape(len(row), -1), get("q", np.int32).reshape(len(rows), -1))
                alike = label[:, None] == of
                may = alike & (row[:, None] != rows) if same else ~alike
                for w in range(low.shape[1]):
                    fits = may & (scores >= low[:, w, None]) & (scores <= high[:, w, None])
                    i, j = best(scores, fits, k)
                    found.append(np.stack([row[i], np.full(len(i), w), -scores[i, j], ids[j]]))
                    held += len(i)
                if held > KEPT:
                    found = [thinned(found, k)]
                    held = found[0].shape[1]
                    if held > KEPT // 2:
                        yield sent()
                        found, held = [], 0
        if held:
            yield sent()

    reads = chosen(asked, zones, chunks, same, home)
    some = reads.join(blocks.select("block", "ids", "rows", "of", "q"), "block").mapInArrow(
        compare, "row long, window long, score long, vec_id long")
    order = Window.partitionBy("row", "window").orderBy(F.desc("score"), "vec_id")
    top = some.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < k)
    return materialize(top, "negatives-best")


def best_in_windows(asked: DataFrame, blocks: DataFrame, zones: DataFrame, chunks: int, same: bool, k: int) -> DataFrame:
    """The exact best k rows of each window: a search near its upper end raises ``low``, the
    search of all blocks that are left follows."""
    first = searched(asked, blocks, zones, chunks, same, k, HOME)
    reached = first.where(F.col("place") == k - 1).groupBy("row").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("window").cast("int"), "score"))).alias("reached"))
    raised = asked.join(reached, "row", "left").withColumn("low", F.transform(
        "low", lambda x, i: F.greatest(x, F.coalesce(F.element_at("reached", i), x)))).drop("reached")
    return searched(raised, blocks, zones, chunks, same, k, None)


def hard_negatives(vectors: DataFrame, label: Column, anchors: Column, positives: int = POSITIVES,
                   negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of ``vectors``
    (vec_id, embedding) with label ``label`` that the condition ``anchors`` on vec_id picks."""
    points = points_of(vectors, label)
    blocks = blocks_of(points)
    zones, chunks = zones_of(blocks)
    group = anchors_of(points.where(anchors))
    release(vectors.sparkSession)
    one = group.withColumn("low", F.array(F.lit(LOWEST).cast("long"))).withColumn("high", F.array(F.lit(HIGHEST).cast("long")))
    same = best_in_windows(one, blocks, zones, chunks, True, positives)
    # Windows from half to 95 % of a positive's score, in integers; none below zero.
    ends = same.where("score >= 0").groupBy("row").agg(F.map_from_entries(F.collect_list(
        F.struct("place", "score"))).alias("p"))
    last = positives - 1
    windows = group.join(ends, "row").select(
        "row", "grp", "label", "q",
        F.expr(f"transform(sequence(0, {last}), i -> coalesce(shiftright(element_at(p, i) + 1, 1), 1L))").alias("low"),
        F.expr(f"transform(sequence(0, {last}), i -> coalesce(element_at(p, i) - (element_at(p, i) + 19) div 20, 0L))").alias("high"))
    other = best_in_windows(windows, blocks, zones, chunks, False, negatives)
    return other.select("row", F.col("window").alias("place"), (F.col("place") + 1).alias("rank"),
                        F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(
        same.select("row", F.col("place").cast("long").alias("place"), F.col("vec_id").alias("positive_id"),
                    F.col("score").alias("positive_score")), ["row", "place"]).join(
        group.select("row", F.col("vec_id").alias("anchor_id")), "row").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector among all embeddings."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), moved, F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.row, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_sum(list_transform(list_zip(a.q, c.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.row <> c.row WHERE a.vec_id % 50 = 0),
p AS (
  SELECT row, anchor_id, vec_id, score, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS place
  FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.row, p.place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.row = s.row AND NOT s.same
  WHERE p.place <= 5 AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

ship(__name__)
