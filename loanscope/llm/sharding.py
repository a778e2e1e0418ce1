"""Sharding: minimax contiguous partition of ordered atomic groups.

Rows with equal text form one atomic group; groups are ordered by the SHA-256
of their text.  The smallest shard capacity for which greedy filling needs at
most ``shards`` shards is found by binary search.  Under that capacity a second search
finds the largest least load, and the order is cut there: a group larger than the fair
share fixes the capacity alone, and the shards beside it share what is left evenly.

The driver never sees the groups.  It holds the byte totals of key-prefix
cells (4096 at first) and brackets the capacity between two greedy checks:
one may cut anywhere inside a cell (lower bound), one only between cells
(upper bound).  Only cells in which a cut may lie are split further, 256-fold
a round, until both bounds meet.  A cell whose rows all share one text is
atomic and never split, so a hot text costs one cell.

Defined results: null text has size 8, a null checksum, and all null texts
form one group; an empty table gives no rows; repeated rows get a slot each;
extra columns are ignored.  Shards are empty only where there are fewer groups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanscope.llm.common import materialize, table

SHARDS = 24
FIRST_DIGITS = 3          # 4096 cells to begin with
MORE_DIGITS = 2           # a cell that may hold a cut is split 256-fold
SLOT_CELL_ROWS = 5_000    # rows numbered by one window partition
NULL_KEY = "0" * 64       # the group of null texts


def greedy_cuts(cum: np.ndarray, shards: int, capacity: int) -> list[int] | None:
    """Cell boundaries where greedy filling cuts; None if ``shards`` are too few."""
    at, cuts, last = 0, [], len(cum) - 1
    for _ in range(shards):
        at = int(np.searchsorted(cum, cum[at] + capacity, side="right")) - 1
        cuts.append(at)
        if at == last:
            return cuts
    return None


def level_cuts(cum: np.ndarray, shards: int, capacity: int) -> list[int]:
    """Cell boundaries that end the shards of a cut under ``capacity`` with the largest least
    load; there must be one with at most ``shards`` shards."""
    last = len(cum) - 1
    shards = min(shards, last)

    def reached(least: int) -> list[np.ndarray] | None:
        """Boundaries at which 0, 1, ... shards of ``least`` to ``capacity`` can end."""
        low, high = np.searchsorted(cum, cum - capacity), np.searchsorted(cum, cum - least, side="right")
        steps = [np.arange(last + 1) == 0]
        for _ in range(shards):
            run = np.concatenate([[0], np.cumsum(steps[-1])])
            steps.append(run[np.maximum(high, low)] > run[low])
        return steps if steps[-1][last] else None

    most = int(cum[-1]) // shards
    least = most - smallest(lambda d: reached(most - d) is not None, 0, most - 1)
    steps, cuts = reached(least), [last]
    for k in range(shards - 1, 0, -1):
        at = cum[cuts[-1]]
        can = np.flatnonzero(steps[k] & (cum >= at - capacity) & (cum <= at - least))
        cuts.append(int(can[np.abs(cum[can] - at * k / (k + 1)).argmin()]))
    return cuts[::-1]


def loose_cuts(cum: np.ndarray, atomic: np.ndarray, shards: int, capacity: int) -> list[int] | None:
    """Byte positions of the cuts if cells that are not atomic could be cut anywhere."""
    pos, cuts, total = 0, [], int(cum[-1])
    for _ in range(shards):
        nxt = min(pos + capacity, total)
        cell = int(np.searchsorted(cum, nxt, side="right")) - 1
        if cell < len(atomic) and atomic[cell]:
            nxt = int(cum[cell])
        if nxt == pos and pos < total:
            return None
        pos = nxt
        cuts.append(pos)
        if pos == total:
            return cuts
    return None


def smallest(feasible, low: int, high: int) -> int:
    """Smallest value in [low, high] that is feasible; ``high`` must be."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(mid) else (mid + 1, high)
    return low


def minimax_bounds(rows: DataFrame, shards: int) -> tuple[list[str], int]:
    """Key prefixes at which shards 1, 2, ... begin, and the capacity found."""
    def cells(frame: DataFrame, digits: int) -> dict:
        got = frame.groupBy(F.substring("key", 1, digits).alias("p")).agg(
            F.sum("size").alias("s"), F.min("key").alias("a"), F.max("key").alias("b")).collect()
        return {r.p: (r.s, r.a == r.b) for r in got}

    known = cells(rows, FIRST_DIGITS)
    while known:
        names = sorted(known)
        size = np.array([known[p][0] for p in names], dtype=np.int64)
        atomic = np.array([known[p][1] for p in names])
        cum = np.concatenate([[0], np.cumsum(size)])
        total = int(cum[-1])
        low = smallest(lambda c: loose_cuts(cum, atomic, shards, c) is not None, 1, total)
        high = smallest(lambda c: greedy_cuts(cum, shards, c) is not None, low, total)
        cuts = greedy_cuts(cum, shards, high)
        if low == high:
            return [names[i] for i in level_cuts(cum, shards, high) if i < len(names)], high
        # Cells that a cut may fall into for some capacity in [low, high].
        wide = size > low // 64
        split = {names[i] for i in np.flatnonzero(wide & ~atomic)}
        begin, end = 0, 0
        for _ in range(shards):
            begin = max(begin, int(np.searchsorted(cum, cum[begin] + low, side="right")) - 1)
            end = min(end + high, total)
            stop = min(int(np.searchsorted(cum, end, side="right")), len(names))
            split |= {names[i] for i in range(begin, stop) if not atomic[i]}
        for digits in sorted({len(p) for p in split}):
            part = [p for p in split if len(p) == digits]
            for p in part:
                del known[p]
            known |= cells(rows.where(F.substring("key", 1, digits).isin(part)), digits + MORE_DIGITS)
    return [], 0


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, key, shard, slot: the minimax partition of ``docs``."""
    text = F.col(text_col)
    rows = materialize(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.coalesce(F.sha2(text, 256), F.lit(NULL_KEY)).alias("key")), "shard-rows")
    starts, _ = minimax_bounds(rows, shards)
    shard = F.lit(0)
    for s in starts:
        shard = shard + (F.col("key") >= s).cast("int")
    placed = rows.withColumn("shard", shard.cast("int"))
    # Slots: count per (shard, cell), running offsets, then a number inside each small cell.
    n_cells = rows.count() // (shards * SLOT_CELL_ROWS) + 1
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(n_cells)))
    upto = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
               .select("shard", "cell", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before")))
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "key")
    return (placed.withColumn("i", F.row_number().over(inside)).join(offsets, ["shard", "cell"])
            .select("doc_id", "size", "text_crc32", "key", "shard",
                    (F.col("before") + F.col("i") - 1).cast("long").alias("slot")))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the law ``bytes``."""
    return shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
