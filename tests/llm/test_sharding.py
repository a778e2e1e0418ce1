import hashlib
import random
import zlib

import numpy as np
from llm_util import SF, as_rows, docs_of

from loanscope.llm import sharding


def fill(sizes, capacity):
    shards, room = 1, capacity
    for s in sizes:
        if s > capacity:
            return 10 ** 9
        if s > room:
            shards, room = shards + 1, capacity
        room -= s
    return shards


def brute_capacity(sizes, shards):
    low, high = 1, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fill(sizes, mid) <= shards else (mid + 1, high)
    return low


def groups_of(docs):
    out = {}
    for _, text, *_ in docs:
        key = hashlib.sha256(text.encode()).hexdigest() if text is not None else "0" * 64
        out[key] = out.get(key, 0) + len((text or "").encode()) + 8
    return [out[k] for k in sorted(out)]


def test_all_documents_in_minimax_shards(spark):
    got = sharding.op1_sharding(spark, SF).toPandas()
    docs = docs_of(SF)
    assert sorted(got.doc_id) == [d[0] for d in docs]
    by_id = got.set_index("doc_id")
    for doc_id, text, *_ in docs[::7]:
        assert by_id.loc[doc_id, "size"] == len(text.encode()) + 8
        assert by_id.loc[doc_id, "text_crc32"] == zlib.crc32(text.encode())
    assert got.groupby("text_crc32").shard.nunique().max() == 1
    loads = got.groupby("shard")["size"].sum()
    assert loads.max() == brute_capacity(groups_of(docs), 24) and set(got["shard"]) <= set(range(24))
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert set(got.law) == {"bytes"} and got.grown_shard.isna().all()


def test_refinement_finds_the_exact_capacity(spark, monkeypatch):
    """Few cells to begin with, so that cuts need several rounds."""
    monkeypatch.setattr(sharding, "FIRST_DIGITS", 1)
    monkeypatch.setattr(sharding, "MORE_DIGITS", 1)
    rng = random.Random(3)
    rows = [(hashlib.sha256(str(i).encode()).hexdigest(), rng.randint(1, 1000)) for i in range(700)]
    rows += [(rows[0][0], 400)] * 300          # a hot group
    df = spark.createDataFrame(rows, "key string, size long")
    size = {}
    for k, s in rows:
        size[k] = size.get(k, 0) + s
    for shards in (1, 3, 24):
        starts, capacity = sharding.minimax_bounds(df, shards)
        assert capacity == brute_capacity([size[k] for k in sorted(size)], shards)
        load = np.zeros(shards, dtype=int)
        for k, s in size.items():
            load[sum(k >= x for x in starts)] += s
        assert load.max() == capacity


def test_edge_cases(odd_docs, no_docs):
    assert sharding.shard_documents(no_docs).count() == 0
    got = sharding.shard_documents(odd_docs, 4).toPandas()
    assert len(got) == odd_docs.count()
    null = got[got.doc_id == 3].iloc[0]
    assert null["size"] == 8 and np.isnan(null.text_crc32)
    assert got[got.doc_id == 4].iloc[0]["key"] != null["key"]
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_reruns_agree(spark):
    assert as_rows(sharding.op1_sharding(spark, SF)) == as_rows(sharding.op1_sharding(spark, SF))


def brute_least(sizes, shards, capacity):
    """Largest least load of a contiguous cut into ``shards`` parts under ``capacity``."""
    best = {0: float("inf")}
    cum = np.concatenate([[0], np.cumsum(sizes)])
    for _ in range(shards):
        new = {}
        for q, least in best.items():
            for p in range(q + 1, len(cum)):
                load = cum[p] - cum[q]
                if load <= capacity:
                    new[p] = max(new.get(p, -1), min(least, load))
        best = new
    return best[len(sizes)]


def test_level_cuts_against_brute_force():
    rng = random.Random(9)
    for _ in range(60):
        sizes = [rng.choice((1, 3, 8, 60)) for _ in range(rng.randrange(1, 14))]
        shards = rng.randrange(1, 6)
        cum = np.concatenate([[0], np.cumsum(sizes)])
        capacity = brute_capacity(sizes, shards)
        cuts = sharding.level_cuts(cum, shards, capacity)
        loads = np.diff(np.concatenate([[0], cum[cuts]]))
        assert len(cuts) == min(shards, len(sizes)) and loads.max() <= capacity
        assert loads.min() == brute_least(sizes, min(shards, len(sizes)), capacity)


def test_a_giant_group_leaves_the_others_level(spark):
    """One text of a third of all bytes: its shard holds it, the others share the rest; only
    what stands behind it in the order, here in the last shard, may be short."""
    docs = [(i, f"document {i} " + "x" * (i % 50)) for i in range(6000)]
    docs.append((9999, "g" * (sum(len(t) + 8 for _, t in docs) // 2)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    loads = sharding.shard_documents(df).groupBy("shard").sum("size").toPandas().set_index("shard")["sum(size)"]
    rest = loads.drop(loads.idxmax())
    assert len(loads) == 24 and sorted(rest)[1] > 0.8 * rest.mean()
