"""Prefix trie: SQL, brute force over odd tables, shards of every size, shared paths."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from llm_util import SF, SMALL, against_sql, as_rows

from loanscope.llm import prefixes

TURNS = "conv_id long, turn long, role string, text string"


def tie(t):
    role, text = t[0].encode(), t[1].encode()
    return hashlib.md5(b"%d:%s%s" % (len(role), role, text)).hexdigest()


def brute(rows, rebuild=True):
    """Nodes of (conv_id, turn, role, text) rows by dictionaries of whole prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            t = (role or "", text or "")
            own[c].append((turn is not None, turn or 0, tie(t), t))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    seqs = own
    if rebuild:
        seqs = {}
        for c, v in own.items():
            h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
            seqs[c] = own.get(base, [])[:h] + v[h:]
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, s in sorted(seqs.items()):
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
            if d:
                kids[tuple(s[:d - 1])].add(tuple(s[:d]))
        ends[tuple(s)].append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + (
            (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    return sorted(((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items()), key=repr)


@pytest.mark.parametrize("sf", [SF, SMALL])
def test_query_against_sql_and_brute_force(spark, sf):
    got, want = against_sql(spark, "op13_prefixes", sf)
    assert got == want
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_rows(prefixes.op13_prefixes(spark, sf)) == brute(rows)


def trie(df, shard=prefixes.SHARD):
    return as_rows(prefixes.prefix_trie(prefixes.conversations_of(df), shard))


def shared_rows():
    """A hot first turn, a sequence that a third share, a long conversation and one that shares most of it, odd rows."""
    rows = []
    for c in range(120):
        rows.append((c, 0, "system", "be kind" if c % 4 else None))
        if c % 3 == 0:
            rows += [(c, i, "user", f"same {i}") for i in range(1, 6)]
        else:
            rows += [(c, i, None if i == 2 else "user", f"turn {i} of {c % (i + 7)} ü") for i in range(1, 1 + c % 23)]
    rows += [(500, i, "user", f"long {i}") for i in range(75)] + [(501, i, "user", f"long {i if i < 70 else -i}") for i in range(90)]
    rows += [(-3, 1, "user", "below zero"), (-5, 4, "a", "x"), (7777, None, None, None), (8000, 1, "a", "tie"), (8000, 1, "b", "tie"),
             (8000, 1, "b", "tie"), (None, 3, "user", "no conversation"), (8001, -4, "", "")]
    return rows


@pytest.mark.parametrize("shard", [10, 60, 700, 500_000])
def test_shards_recombine(spark, shard, monkeypatch):
    monkeypatch.setattr(prefixes, "FAN", 3)
    monkeypatch.setattr(prefixes, "PIECE", 4)
    monkeypatch.setattr(prefixes, "COLUMNS", 5)
    rows = shared_rows()
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS base", "2 AS turns", "'k' AS id", "3 AS size").repartition(5)
    assert trie(df, shard) == brute(rows, rebuild=False)


def test_rebuilt_over_odd_rows(spark):
    rows = shared_rows()
    found = prefixes.rebuilt(prefixes.conversations_of(spark.createDataFrame(rows, TURNS), base=lambda c: c - c % 5))
    assert as_rows(prefixes.prefix_trie(found, 200)) == brute(rows)


def test_no_conversations(spark):
    assert trie(spark.createDataFrame([], TURNS)) == []
    assert trie(spark.createDataFrame([(None, 1, "a", "b")], TURNS)) == []


def test_boundary_rows_follow_the_shards(spark):
    """What recombines grows with shards and depth, not with conversations."""
    rows = [(c, i, "user", f"{c % 50 if i < 2 else c} {i}") for c in range(3000) for i in range(6)]
    parts = []
    keep = prefixes.materialize
    try:
        prefixes.materialize = lambda df, name: parts.append((name, keep(df, name))) or parts[-1][1]
        prefixes.prefix_trie(prefixes.conversations_of(spark.createDataFrame(rows, TURNS)), 2000).count()
    finally:
        prefixes.materialize = keep
    shards = dict(parts)["trie-shards"]
    number = shards.agg({"shard": "max"}).first()[0] + 1
    assert number >= 5 and shards.where("kind = 1").count() <= number * 2 * 7
