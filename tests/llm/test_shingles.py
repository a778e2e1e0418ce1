import tracemalloc

import numpy as np

from loanscope.llm import jaccard as J
from loanscope.llm import shingles as S


def test_a_long_word_has_one_hash_wherever_it_stands():
    """A word of over PIECE bytes, alone in its piece or at the end of a filled one."""
    word = "ab" * (S.PIECE * 3 // 4)
    alone = S.hash_words([word])[0]
    later = S.hash_words(["x " * (S.PIECE * 3 // 8) + word.upper()])[0]
    assert len(alone) == 1 and later[-1] == alone[0]


def test_hashing_holds_little_beside_its_result():
    texts = ["some words of a text that is not long " * 50] * 2_000      # 3.8 MB
    S.tables()
    tracemalloc.start()
    h, _ = S.hash_words(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * h.nbytes + sum(map(len, texts)) + (16 << 20)


def test_star_ties_and_shared_keys():
    rng = np.random.default_rng(5)
    keys, sets = rng.integers(0, 300, 900), rng.integers(-50, 50, 900)
    members = {}
    for k, s in zip(keys.tolist(), sets.tolist()):
        members.setdefault(k, []).append(s)
    ties = {(min(m), s) for m in members.values() for s in m if s != min(m)}
    shared = {}
    for m in members.values():
        if len(set(m)) > 1:
            for s in m:
                shared[s] = shared.get(s, 0) + 1
    (k, low), (a, b) = J.star(keys, sets, 1)
    assert dict(zip(k.tolist(), low.tolist())) == {k: min(m) for k, m in members.items()}
    assert len(a) == len(ties) and set(zip(a.tolist(), b.tolist())) == ties
    (k, low), (nodes, number) = J.star(keys, sets, 2)
    assert len(k) == len(members) and dict(zip(nodes.tolist(), number.tolist())) == shared
    empty = np.empty(0, dtype=np.int64)
    assert all(len(x) == 0 for what in (1, 2) for pair in J.star(empty, empty, what) for x in pair)
