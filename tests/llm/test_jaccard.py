import random
import re

import numpy as np
from hypothesis import given, settings, strategies as st
from llm_util import SF, docs_of

from loanscope.llm import jaccard as J
from loanscope.llm.common import LOWER, SPACED_WORD, UPPER
from loanscope.llm.shingles import mix

TO_LOWER = str.maketrans(UPPER, LOWER)


def shingles(text, k=4):
    w = re.findall(SPACED_WORD, (text or "").translate(TO_LOWER))
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_components(docs, k=4, percent=85):
    sets = [(i, shingles(t, k)) for i, t in docs]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders, size = {}, {}
    for i, s in sets:
        near = {}
        for t in s:
            for j in holders.setdefault(t, []):
                near[j] = near.get(j, 0) + 1
            holders[t].append(i)
        for j, both in near.items():
            if 100 * both >= percent * (len(s) + size[j] - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        size[i] = len(s)
    return {i: (len(s), root(i)) for i, s in sets}


def near_copies(n, rng):
    """Documents that differ from a base in a few words each; some only from each other."""
    base = [f"w{rng.randrange(400)}" for _ in range(300)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(300)] = f"x{rng.randrange(30)}"
        out.append(" ".join(w[:rng.choice((300, 300, 280, 200))]))
    return out


def test_all_documents_by_brute_force(spark):
    docs = [d[:2] for d in docs_of(SF)]
    want = brute_components(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.op4_jaccard(spark, SF).collect()}
    assert got == want and sum(c != i for i, (_, c) in got.items()) > 20


def test_near_copies_in_blocks(spark, monkeypatch):
    """A work unit of several blocks, buckets and flushes gives the same classes."""
    rng = random.Random(5)
    docs = [(1000 - i, t) for i, t in enumerate(near_copies(120, rng))] + [(2000 + i, f"lone text {i} of its own words") for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for block, keys in ((2_000, 1_000_000), (25, 3_000)):
        monkeypatch.setattr(J, "BLOCK", block)
        monkeypatch.setattr(J, "TASK_KEYS", keys)
        monkeypatch.setattr(J, "FLUSH_KEYS", keys)
        for percent in (85, 95):
            got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_classes(df, 4, percent).collect()}
            assert got == brute_components(sorted(docs), 4, percent)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10 ** 9), st.sampled_from((80, 85, 95)))
def test_linked_sets_share_a_part(n, seed, percent):
    """Two sets at the very edge of the threshold have a part key in common."""
    rng = np.random.default_rng(seed)
    x = np.unique(mix(rng.integers(0, 1 << 62, n).astype(np.uint64)))
    drop = int(rng.integers(0, len(x) + 1))
    add = int(rng.integers(0, len(x) + 1))
    y = np.unique(np.concatenate([x[drop:] if rng.random() < 0.5 else rng.permutation(x)[drop:],
                                  mix(rng.integers(1 << 62, 1 << 63, add).astype(np.uint64))]))
    both = len(np.intersect1d(x, y))
    if len(y) and 100 * both >= percent * (len(x) + len(y) - both):
        parts = J.Parts(percent)
        held = [{k: set(keys.tolist()) for k, keys in ((node, keys) for node, keys in parts.keys(1, z))} for z in (x, y)]
        least = [dict(parts.needs(1, z)) for z in (x, y)]   # one mark for both: nodes name the class alone
        common = {k: held[0][k] & held[1][k] for k in held[0] if k in held[1]}
        # In a class of both, they share at least as many parts as either must.
        assert any(v and len(v) >= max(least[0][k], least[1][k]) for k, v in common.items())


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10 ** 9))
def test_tree_join_connects_what_brute_force_connects(seed):
    rng = np.random.default_rng(seed)
    base = np.unique(mix(rng.integers(0, 200, 60).astype(np.uint64)))
    sets = []
    for _ in range(25):
        keep = base[rng.random(len(base)) > rng.choice([0.02, 0.1, 0.4])]
        sets.append(np.unique(np.concatenate([keep, mix(rng.integers(500, 520, rng.integers(1, 6)).astype(np.uint64))])))
    blocks = rng.integers(0, 2, 25).tolist()
    for across in (False, True):
        def classes(links):
            group = list(range(25))
            for a, b in links:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
            return [group.index(g) for g in group]

        want = [(i, j) for i in range(25) for j in range(i) if not (across and blocks[i] == blocks[j])
                and 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - k)]
        got = J.trie_links(list(range(25)), blocks, sets, across, 85)
        assert classes(got) == classes(want)


def test_edge_cases(odd_docs, no_docs):
    assert J.near_classes(no_docs).count() == 0 and J.one_each(no_docs).count() == 0
    got = J.near_classes(odd_docs).toPandas()
    assert len(got) == odd_docs.count()
    by = got.dropna().drop_duplicates("doc_id").set_index("doc_id")
    assert by.loc[2, "component_id"] == 1 and by.loc[8, "component_id"] == 7
    assert (by.loc[[3, 4, 5], "n_shingles"] == 0).all() and by.loc[4, "component_id"] == 4
    assert by.loc[6, "n_shingles"] == 1
    kept = J.one_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r.doc_id for r in kept.select("doc_id").collect()), key=str)
    assert ids == sorted([1, 3, 4, 5, 6, 7, 9, None, 10, 10, 11], key=str)


def test_small_pair_at_the_edge_stays_linked(spark):
    """8 words whose 4 shingles fall in one of 3 parts, and the same with a ninth word in another part."""
    third = np.uint64(((1 << 64) - 1) // 3)
    for seed in range(10 ** 5):
        w = [f"z{seed}x{i}" for i in range(9)]
        small, large = J.sets_of([" ".join(w[:8]), " ".join(w)], 5)
        if len(set((small // third).tolist())) == 1 and len(set((large // third).tolist())) == 2:
            break
    df = spark.createDataFrame([(1, " ".join(w[:8])), (2, " ".join(w))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in J.near_classes(df, 5, 80).collect()} == {1: 1, 2: 1}


def test_linked_sets_share_the_parts_that_they_need():
    """Each pair alone, so that no other text stands in for the shared parts."""
    rng = np.random.default_rng(4)
    for percent, sizes in ((80, ((4, 5), (8, 10), (12, 15))), (85, ((6, 7), (17, 20)))):
        parts = J.Parts(percent)
        for small, large in sizes:
            for _ in range(2_000):
                s = rng.integers(0, 1 << 64, large, dtype=np.uint64)
                sets = np.sort(s[:small]), np.sort(s)
                keys = [[set(k.tolist()) for _, k in parts.keys(m, x)] for m, x in enumerate(sets)]
                cuts = [{c[0]: (i, c[3]) for i, c in enumerate(parts.cut(x))} for x in sets]
                common = set(cuts[0]) & set(cuts[1])
                assert any(len(keys[0][cuts[0][k][0]] & keys[1][cuts[1][k][0]]) >= max(cuts[0][k][1], cuts[1][k][1])
                           for k in common)
