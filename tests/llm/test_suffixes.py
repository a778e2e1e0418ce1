import hashlib

import numpy as np
import pytest
from llm_util import SF, SMALL, docs_of

from loanscope.llm import suffixes as S


def brute(docs):
    """(n_bytes, n_removed, n_spans, kept) of (id, text) rows, by a set of 50-byte strings."""
    seen, out = {}, []
    for i, t in sorted(docs, key=lambda d: d[0]):
        raw = (t or "").encode()
        for k in range(len(raw) - 49):
            w = raw[k:k + 50]
            seen[w] = min(seen.get(w, i), i)
    for i, t in docs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for k in range(len(raw) - 49):
            if seen[raw[k:k + 50]] < i:
                gone[k:k + 50] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(raw), int(gone.sum()), runs, bytes(np.frombuffer(raw, np.uint8)[~gone])))
    return sorted(out)


def test_all_documents(spark):
    got = sorted(tuple(r) for r in S.op10_suffixes(spark, SF).collect())
    want = [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute([d[:2] for d in docs_of(SF)])]
    assert got == want and sum(r[2] for r in got) > 10_000


def test_several_shards_of_one_anchor(spark):
    """A common passage in other surroundings everywhere, few runs a shard."""
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    passage = " ".join(word() for _ in range(12))
    docs = [(int(i), " ".join([word() for _ in range(rng.integers(0, 6))] + [passage[rng.integers(0, 8):]]
                              + [word() for _ in range(rng.integers(0, 6))])) for i in rng.permutation(150)]
    docs += [(200, "x" * 400), (201, "y" + "x" * 300), (202, ("ab" * 40) + "c"), (203, "ab" * 60), (204, "é" * 60), (205, "aé" + "é" * 50)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    want = brute(docs)
    for runs in (20_000, 4):
        assert sorted(tuple(r) for r in S.remove_repeats(df, runs).collect()) == [(a, b, c, d, bytearray(e)) for a, b, c, d, e in want]


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 300)
    monkeypatch.setattr(S, "_powers", [])
    docs = [d[:2] for d in docs_of(SMALL)][:120]
    runs = {}
    for i, t in docs:
        for kh, ctx, num, first, last in S.scan_texts([t.encode()]):
            runs.setdefault(i, []).extend(zip(first.tolist(), last.tolist()))
    for i, t in docs:   # every window is in exactly one run
        covered = sorted(p for a, b in runs.get(i, []) for p in range(a, b + 1))
        assert covered == list(range(max(0, len(t.encode()) - 49)))


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_and_common_prefixes(seed):
    rng = np.random.default_rng(seed)
    parts = [bytes(rng.integers(97, 97 + rng.integers(1, 4), rng.integers(1, 90)).astype(np.uint8)) for _ in range(40)]
    parts += parts[:5]
    raw = b"".join(p + b"\xff" for p in parts)
    text = np.frombuffer(raw, dtype=np.uint8)
    ends = np.flatnonzero(text == 0xFF)
    suffix = [raw[i:ends[np.searchsorted(ends, i)] + 1] for i in range(len(raw))]
    want = sorted(range(len(raw)), key=lambda i: (suffix[i], i))
    sa = S.suffix_array(text)
    assert sa.tolist() == want
    lcp = S.common_prefixes(text, sa)
    for k in range(len(sa)):
        n = 0
        if k:
            a, b = suffix[sa[k - 1]], suffix[sa[k]]
            while n < 50 and n < min(len(a), len(b)) - 1 and a[n] == b[n]:
                n += 1
        assert lcp[k] == n


def test_edge_cases(odd_docs, no_docs):
    assert S.remove_repeats(no_docs).count() == 0
    got = S.remove_repeats(odd_docs).toPandas()
    assert len(got) == odd_docs.count()
    by = got.dropna().drop_duplicates("doc_id").set_index("doc_id")
    assert (got[got.doc_id == 2].n_removed == by.loc[1, "n_bytes"]).all() and len(got[got.doc_id == 2]) == 2
    assert by.loc[1, "n_removed"] == 0 and by.loc[3, "n_bytes"] == 0 and by.loc[10, "n_removed"] == 0
    assert 0 <= by.loc[8, "n_bytes"] - by.loc[8, "n_removed"] <= 50 and by.loc[7, "n_removed"] == 0


def test_heads_of_one_anchor_are_dealt_by_all_their_bytes(spark):
    """Heads that begin alike reach all slices; equal ones the same slice; ids of over 53 bits stay exact."""
    rng = np.random.default_rng(11)
    raws = [b"the" + bytes(rng.integers(97, 123, 60).astype(np.uint8)) for _ in range(400)]
    which, offset = np.repeat(np.arange(400), 2), np.tile([0, 13], 400)
    windows = S.window_bytes(raws, which, offset)
    assert [w.tobytes() for w in windows] == [raws[i][k:k + 50] for i, k in zip(which, offset)]
    h = S.window_hashes(windows[::2])
    assert np.bincount((h % np.uint64(8)).astype(int), minlength=8).min() > 20
    assert (S.window_hashes(windows[::2].copy()) == h).all() and len(np.unique(h)) == 400
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    passage = " ".join(word() for _ in range(12))
    docs = [((1 << 60) + int(i), f"{word()} {passage} {word()}") for i in rng.permutation(60)]
    got = S.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 4).collect()
    assert sorted(tuple(r) for r in got) == [(a, b, c, d, bytearray(e)) for a, b, c, d, e in brute(docs)]
