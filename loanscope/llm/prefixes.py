"""Conversation prefix trie: padded turn-id matrices, sorted and reduced by depth.

A conversation is the sequence of its turns in order of ``turn`` (null first; equal
turn numbers by the digest of role and text).  A node is a distinct sequence of first
turns; its members are the conversations that start with it.

1. A turn becomes a 128-bit id (MD5 of role and text) and the bytes of its text; a
   conversation one row of 20 bytes a turn.  Texts never shuffle.
2. The rows are dealt into shards by ranges of (sequence, conv_id), so a hot first
   turn or one sequence that a third of all conversations share is split too.
3. A shard numbers its turn ids by order and pads them to a matrix, ``COLUMNS`` depths
   at a time, longer conversations going on in the next.  A lexsort and the
   OR-accumulated change masks of its columns mark where nodes start; reduceat
   aggregates every depth.  Leaves and saved tokens are summed from the bottom.
4. Only nodes on the paths of a shard's first and last row can have members in
   other shards.  These boundary nodes recombine in rounds: ``FAN`` neighbouring
   shards merge, what no longer lies on the outer paths is whole and leaves, until one
   range is left.  A merge holds at most 2 * FAN * depth nodes.
5. The conversations that end at a boundary node leave the shards as pieces
   of its id list; one digest streams over the pieces in order.

Memory: a shard holds about ``SHARD`` turns, or one conversation if that is longer; the
range bounds on the driver are sampled sequences, 16 bytes a turn.

Defined results: null role or text counts as empty; repeated rows are turns of
their own; rows without conv_id belong to no conversation; an empty table has no
nodes; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.llm.common import materialize, ship, table

SHARD = 500_000     # turns and conversations that a shard should hold
COLUMNS = 16        # depths of one padded matrix
FAN = 32            # neighbouring shards that one task recombines
PIECE = 1_000       # ids in one piece of a list that several shards share
ROOT = hashlib.md5(b"").digest()
NO_ENDS = hashlib.sha256(b"").hexdigest()
WHOLE, BOUNDARY, ENDS = 0, 1, 2
PARTS = ("kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string, key binary, parent_key binary, size long, shard long, "
         "first boolean, last boolean")
PART_COLUMNS = [c.split()[0] for c in PARTS.split(", ")]
PART_TYPES = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(),
                             "boolean": pa.bool_()}[t]) for n, t in (c.split() for c in PARTS.split(", "))])


# ---- conversations ---------------------------------------------------------------------------------

def conversations_of(turns: DataFrame, base=None) -> DataFrame:
    """base, conv_id, turns (array of turn, id, size in order) of each conversation in
    ``turns`` (conv_id, turn, role, text).  Rows of one ``base`` (default: conv_id) lie together."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("id"),
        F.octet_length(text).alias("size"))
    rows = rows.withColumn("base", F.col("conv_id") if base is None else base(F.col("conv_id")))
    return rows.repartition("base").groupBy("base", "conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "id", "size"))).alias("turns"))


def rebuilt(conversations: DataFrame, most: int = 9) -> DataFrame:
    """Conversations whose first h turns are those of their base: h is the CRC-32
    of the decimal conv_id modulo ``most``; fewer or none if the base has no more."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = conversations.where("conv_id = base").select("base", F.slice("turns", 1, most - 1).alias("head"))
    both = conversations.join(heads, "base", "left").withColumn("h", h)
    none = F.slice("turns", 1, 0)
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return both.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), own).alias("turns"))


# ---- one shard -------------------------------------------------------------------------------------

def numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each 128-bit id by order, a place where each number stands)."""
    order = np.lexsort((ids[:, 1], ids[:, 0]))
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (ids[order][1:] != ids[order][:-1]).any(1)
    number = np.empty(len(ids), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def grow(conv: np.ndarray, length: np.ndarray, token: np.ndarray, size: np.ndarray):
    """Nodes of the conversations ``conv`` with ``length`` turns each, their turn numbers
    ``token`` one after the other, ``size`` bytes a number: (parent, n, low, bytes) of each node in
    order of depth, first node of each depth, and the node at which each conversation ends."""
    start = np.cumsum(length) - length
    at = np.zeros(len(conv), dtype=np.int64)
    levels, firsts = [(np.array([-1]), np.array([len(conv)]), np.array([conv.min()]), np.array([0]))], [0]
    made, done = 1, 0
    while True:
        rows = np.flatnonzero(length > done)
        if not len(rows):
            break
        place = done + np.arange(COLUMNS)
        there = place < length[rows, None]
        grid = np.where(there, token[np.minimum(start[rows, None] + place, len(token) - 1)], -1)
        order = np.lexsort((*grid.T[::-1], at[rows]))
        rows, grid, there = rows[order], grid[order], there[order]
        mask = np.ones(grid.shape, dtype=bool)
        mask[1:] = grid[1:] != grid[:-1]
        mask[1:, 0] |= at[rows][1:] != at[rows][:-1]
        mask = np.logical_or.accumulate(mask, axis=1)
        for j in range(COLUMNS):
            on = there[:, j]
            if not on.any():
                break
            members, opens = rows[on], mask[on, j]
            begin = np.flatnonzero(opens)
            levels.append((at[members[begin]], np.diff(np.append(begin, len(members))),
                           np.minimum.reduceat(conv[members], begin), size[grid[on, j][begin]]))
            firsts.append(made)
            at[members] = made + np.cumsum(opens) - 1
            made += len(begin)
        done += COLUMNS
    return *(np.concatenate(x) for x in zip(*levels)), np.array(firsts), at


def roll_up(parent, firsts, n, size, kids, leaves, saved, whole) -> None:
    """Adds up children, leaves and saved tokens from the bottom, in place; nodes that are
    not ``whole`` take in their whole children only.  Nodes are in order of depth."""
    ends = np.append(firsts[1:], len(parent))
    for a, b in zip(firsts[::-1], ends[::-1]):
        i = np.flatnonzero(whole[a:b]) + a
        leaves[i[kids[i] == 0]] = 1
        saved[i] += (n[i] - 1) * size[i]
        if a > 0:
            np.add.at(kids, parent[i], 1)
            np.add.at(leaves, parent[i], leaves[i])
            np.add.at(saved, parent[i], saved[i])


def outer_paths(parent, ends) -> tuple[list[int], list[int]]:
    """Nodes of the first and of the last conversation by order, from the root on."""
    first, last = np.full(len(parent), len(parent)), np.full(len(parent), -1)
    np.minimum.at(first, parent[1:], np.arange(1, len(parent)))
    np.maximum.at(last, parent[1:], np.arange(1, len(parent)))
    low, high = [0], [0]
    while not ends[low[-1]]:
        low.append(int(first[low[-1]]))
    while last[high[-1]] >= 0:
        high.append(int(last[high[-1]]))
    return low, high


def prefix_keys(seq: bytes, depth: int) -> list[bytes]:
    """Digests of the first 0 to ``depth`` turns."""
    h, keys = hashlib.md5(), [ROOT]
    for d in range(depth):
        h.update(seq[16 * d:16 * d + 16])
        keys.append(h.copy().digest())
    return keys


def part(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([
        pa.array(columns[c], type=t) if c in columns else pa.nulls(n, t)
        for c, t in zip(PART_TYPES.names, PART_TYPES.types)], schema=PART_TYPES)


def node_rows(kind: int, i: np.ndarray, depth, parent, n, low, kids, leaves, saved, open_: np.ndarray, keys: dict, **more):
    """Rows of the nodes ``i``; a parent that is still ``open_`` is named by its key."""
    up = parent[i]
    waits = np.where(up >= 0, open_[up], False)
    return part(kind=np.full(len(i), kind, dtype=np.int32), conv_id=low[i], depth=depth[i],
                parent_conv_id=pa.array(low[up], mask=waits | (up < 0)), n_convs=n[i], n_children=kids[i],
                n_leaves=leaves[i], saved_tokens=saved[i],
                parent_key=[keys[u] if w else None for u, w in zip(up.tolist(), waits)], **more)


def shard_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of one shard: whole nodes, boundary nodes and pieces of their ends."""
    conv, seqs, sizes = [], [], []
    for b in batches:
        conv.append(b.column("conv_id").to_numpy())
        seqs += b.column("seq").to_pylist()
        sizes.append(b.column("sizes").flatten().to_numpy())
    if not seqs:
        return
    conv, size = np.concatenate(conv), np.concatenate(sizes).astype(np.int64)
    length = np.array([len(s) // 16 for s in seqs], dtype=np.int64)
    ids = np.frombuffer(b"".join(seqs), dtype=">u8").astype(np.uint64).reshape(-1, 2)
    token, stands = numbered(ids)
    parent, n, low, size, firsts, at = grow(conv, length, token, size[stands])
    depth = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(parent))))
    ends = np.bincount(at, minlength=len(parent))
    paths = outer_paths(parent, ends)
    keys = {}
    for path in paths:      # any conversation below the last node of a path has its turns
        row = int(np.flatnonzero(at == path[-1])[0])
        keys |= dict(zip(path, prefix_keys(seqs[row], len(path) - 1)))
    open_ = np.zeros(len(parent), dtype=bool)
    open_[list(keys)] = True
    kids, leaves, saved = (np.zeros(len(parent), dtype=np.int64) for _ in range(3))
    roll_up(parent, firsts, n, size, kids, leaves, saved, ~open_)
    order = np.lexsort((conv, at))
    cut = np.split(conv[order], np.cumsum(ends)[:-1])
    shard = TaskContext.get().partitionId()
    for i in np.array_split(np.flatnonzero(~open_), max(1, len(parent) // 10_000)):
        digests = [hashlib.sha256(",".join(map(str, cut[x].tolist())).encode()).hexdigest() if ends[x] else NO_ENDS
                   for x in i.tolist()]
        yield node_rows(WHOLE, i, depth, parent, n, low, kids, leaves, saved, open_, keys, ends_sha256=digests)
    i = np.flatnonzero(open_)
    yield node_rows(BOUNDARY, i, depth, parent, n, low, kids, leaves, saved, open_, keys, key=[keys[x] for x in i.tolist()],
                    size=size[i], shard=np.full(len(i), shard), first=np.isin(i, paths[0]), last=np.isin(i, paths[1]))
    for x in i[ends[i] > 0].tolist():
        for no in range(0, ends[x], PIECE):
            yield part(kind=[ENDS], key=[keys[x]], shard=[shard], depth=[no],
                       ends_sha256=[",".join(map(str, cut[x][no:no + PIECE].tolist()))])


# ---- recombination ---------------------------------------------------------------------------------

def merge_shards(top: bool):
    """Merges the boundary nodes of neighbouring shards; at the ``top`` all become whole."""
    def merge(rows: pa.Table) -> pa.Table:
        c = {x: rows.column(x).to_numpy(zero_copy_only=False) for x in (
            "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "size", "shard", "first", "last")}
        key = rows.column("key").to_pylist()
        order = sorted(set(zip(c["depth"].tolist(), key)))
        index = {k: i for i, (_, k) in enumerate(order)}
        to = np.array([index[k] for k in key])
        total = len(order)
        depth = np.array([d for d, _ in order])
        parent = np.full(total, -1)
        parent[to] = [-1 if k is None else index[k] for k in rows.column("parent_key").to_pylist()]
        n, kids, leaves, saved = (np.zeros(total, dtype=np.int64) for _ in range(4))
        for whole, piece in ((n, "n_convs"), (kids, "n_children"), (leaves, "n_leaves"), (saved, "saved_tokens")):
            np.add.at(whole, to, c[piece])
        low = np.full(total, np.iinfo(np.int64).max)
        np.minimum.at(low, to, c["conv_id"])
        size = np.zeros(total, dtype=np.int64)
        size[to] = c["size"]
        first, last = np.zeros(total, dtype=bool), np.zeros(total, dtype=bool)
        first[to[c["first"].astype(bool) & (c["shard"] == c["shard"].min())]] = True
        last[to[c["last"].astype(bool) & (c["shard"] == c["shard"].max())]] = True
        open_ = (first | last) & (not top)
        keys = dict(enumerate(k for _, k in order))
        roll_up(parent, np.searchsorted(depth, np.arange(depth.max() + 1)), n, size, kids, leaves, saved, ~open_)
        out = []
        for kind, i in ((WHOLE, np.flatnonzero(~open_)), (BOUNDARY, np.flatnonzero(open_))):
            out.append(node_rows(kind, i, depth, parent, n, low, kids, leaves, saved, open_, keys, key=[keys[x] for x in i.tolist()],
                                 size=size[i], shard=np.full(len(i), c["shard"].min() // FAN), first=first[i], last=last[i]))
        return pa.Table.from_batches(out)
    return merge


def stream_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and ends_sha256 of id lists whose pieces come in order."""
    key, h = None, None
    for b in batches:
        keys, digests = [], []
        for k, text in zip(b.column("key").to_pylist(), b.column("ends_sha256").to_pylist()):
            if k != key:
                if h is not None:
                    keys.append(key)
                    digests.append(h.hexdigest())
                key, h = k, hashlib.sha256(text.encode())
            else:
                h.update(b"," + text.encode())
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "digest": pa.array(digests, pa.string())})
    if h is not None:
        yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "digest": pa.array([h.hexdigest()])})


def prefix_trie(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of
    every node of ``conversations`` (conv_id, turns as made by ``conversations_of``)."""
    rows = materialize(conversations.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("seq"),
        F.transform("turns", lambda t: t["size"]).alias("sizes")), "trie-conversations")
    held = rows.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    parts = materialize(rows.repartitionByRange(int(held // shard) + 1, "seq", "conv_id").mapInArrow(shard_nodes, PARTS),
                        "trie-shards")
    edge = parts.where(F.col("kind") == BOUNDARY)
    root, top = edge.agg(F.min("conv_id"), F.max("shard")).first()
    merged, now, left = None, edge, (top or 0) + 1
    while True:
        one = left <= FAN
        now = materialize(now.withColumn("range", F.floor(F.col("shard") / FAN)).groupBy("range").applyInArrow(
            merge_shards(one), PARTS), "trie-merged")
        done = now.where(F.col("kind") == WHOLE)
        merged = done if merged is None else merged.union(done)
        if one:
            break
        now, left = now.where(F.col("kind") == BOUNDARY), -(-left // FAN)
    digests = parts.where(F.col("kind") == ENDS).select("key", "shard", "depth", "ends_sha256").repartition(
        "key").sortWithinPartitions("key", "shard", "depth").mapInArrow(stream_ends, "key binary, digest string")
    merged = merged.join(digests, "key", "left").withColumn("ends_sha256", F.coalesce("digest", F.lit(NO_ENDS)))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole = parts.where(F.col("kind") == WHOLE).select(*out, "parent_key").union(merged.select(*out, "parent_key"))
    # Parents that were still open: the root by value, other boundary nodes by their key.
    waits = F.col("parent_key").isNotNull() & (F.col("parent_key") != F.lit(ROOT))
    of_root = F.coalesce("parent_conv_id", F.when(F.col("parent_key").isNotNull(), F.lit(root).cast("long")))
    lows = edge.groupBy(F.col("key").alias("parent_key")).agg(F.min("conv_id").alias("up"))
    return whole.where(~waits).withColumn("parent_conv_id", of_root).select(out).union(
        whole.where(waits).join(lows, "parent_key").withColumn("parent_conv_id", F.col("up")).select(out))


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations."""
    found = conversations_of(table(spark, sf_dir, "conversations"), base=lambda c: c - c % 5)
    return prefix_trie(rebuilt(found))


OP13_SQL = """
WITH t AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} ORDER BY turn NULLS FIRST,
    md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (  -- CRC-32 of the decimal id, bit by bit
  SELECT conv_id, turns, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(
    range(1, len(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), CAST(i AS INT), 1)) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [CAST(0 AS BIGINT) FOR b IN range(8)]),
      lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, CAST(3988292384 AS BIGINT)) ELSE v // 2 END)),
    CAST(4294967295 AS BIGINT)) % 9 AS BIGINT) AS h
  FROM t),
b AS (
  SELECT h.conv_id, list_concat(list_slice(coalesce(t.turns, []), 1, h.h), list_slice(h.turns, h.h + 1, len(h.turns))) AS turns
  FROM h LEFT JOIN t ON t.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS depth, turns FROM b),
m AS (SELECT conv_id, n, depth, turns[1:depth] AS path FROM p),
nodes AS (
  SELECT path, depth, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM m GROUP BY path, depth),
up AS (
  SELECT c.path, c.depth, c.conv_id, c.n_convs, c.ends_sha256, u.conv_id AS parent_conv_id,
    (SELECT COUNT(*) FROM nodes k WHERE k.depth = c.depth + 1 AND k.path[1:c.depth] = c.path) AS n_children,
    CASE WHEN c.depth = 0 THEN 0 ELSE (c.n_convs - 1) * strlen(c.path[c.depth].x) END AS own
  FROM nodes c LEFT JOIN nodes u ON u.depth = c.depth - 1 AND u.path = c.path[1:c.depth - 1])
SELECT a.conv_id, a.depth, a.parent_conv_id, a.n_convs, CAST(a.n_children AS BIGINT) AS n_children,
  CAST(SUM(CASE WHEN d.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(SUM(d.own) AS BIGINT) AS saved_tokens,
  a.ends_sha256
FROM up a JOIN up d ON d.depth >= a.depth AND d.path[1:a.depth] = a.path
GROUP BY a.path, a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, a.ends_sha256
"""

ship(__name__)
