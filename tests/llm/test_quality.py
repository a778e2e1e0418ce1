import itertools

import duckdb
import numpy as np
from llm_util import as_rows

from loanscope.llm import quality as Q

SF = "/root/testdata/sf0.1"   # the smaller tables hold few labels


def auc(score, y):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_quality(spark):
    label = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    got = Q.op9_quality(spark, SF).toPandas()
    assert len(got) == 10_000 and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    part = got[got.held_out & got.doc_id.isin(label)]
    y = part.doc_id.map(label).to_numpy()
    assert auc(part.score.to_numpy(), y) > 0.99
    assert (part.predicted == y).mean() > 0.98


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(0)
    counts = np.array([3, 1, 4, 2])
    z, trans = rng.normal(size=counts.sum()), rng.normal(size=(2, 2))
    p, expected = Q.forward_backward(z, counts, trans)
    want_p, want_e, at = np.zeros(len(z)), np.zeros((2, 2)), 0
    for k in counts:
        weights = {}
        for path in itertools.product((0, 1), repeat=int(k)):
            logit = sum(z[at + i] for i in range(k) if path[i]) + sum(trans[a, b] for a, b in zip(path, path[1:]))
            weights[path] = np.exp(logit)
        total = sum(weights.values())
        for path, w in weights.items():
            for i in range(k):
                want_p[at + i] += path[i] * w / total
            for a, b in zip(path, path[1:]):
                want_e[a, b] += w / total
        at += k
    assert np.allclose(p, want_p, atol=1e-9) and np.allclose(expected, want_e, atol=1e-9)


def test_gradient_is_that_of_the_likelihood():
    """The fitted chain beats its neighbours in penalised conditional likelihood."""
    rng = np.random.default_rng(2)
    counts = np.full(60, 4)
    labels = np.arange(60) % 2
    x = rng.normal(size=(240, 3)) + np.repeat(labels, 4)[:, None] * np.array([1.0, -1.0, 0.0])
    w, t = Q.fit_chain(x, counts, labels)

    def value(w, t):
        total = 0.0
        for i, y in enumerate(labels):
            z = x[4 * i:4 * i + 4] @ w
            alpha = np.array([0.0, z[0]])
            for k in range(1, 4):
                alpha = np.array([np.logaddexp(alpha[0] + t[0, s], alpha[1] + t[1, s]) for s in (0, 1)]) + np.array([0, z[k]])
            total += y * z.sum() + 3 * t[y, y] - np.logaddexp(*alpha)
        return total / 240 - Q.RIDGE / 2 * ((w ** 2).sum() + (t ** 2).sum())

    best = value(w, t)
    for _ in range(20):
        assert value(w + rng.normal(size=3) * 0.3, t + rng.normal(size=(2, 2)) * 0.3) < best


def test_neighbours_do_not_cross_documents():
    x, lengths, counts = Q.featurize(["a b c\nd e f", "", None, "x y\n\n  \nz"])
    assert counts.tolist() == [2, 0, 0, 2] and lengths.tolist() == [5, 5, 3, 1]
    n = Q.FEATURES
    assert (x[0, n:2 * n] == 0).all() and (x[1, 2 * n:] == 0).all() and (x[2, n:2 * n] == 0).all()
    assert (x[0, 2 * n:] == x[1, :n]).all()


def test_edge_cases(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (6, 1), (7, 0), (9, 1), (11, 0), (77, 1)],
                                   "doc_id long, quality int")
    model = Q.train(odd_docs, labels)
    got = Q.score(odd_docs, model).toPandas()
    assert len(got) == odd_docs.count() and got.score.between(0, 1).all()
    assert got[got.doc_id.isin([3, 4, 5])].score.nunique() == 1
    none = Q.train(no_docs, labels)
    assert none == (None, None, None, 0.5) and Q.score(no_docs, none).count() == 0
    assert set(Q.score(odd_docs, none).toPandas().score) == {0.5}
    kept = Q.keep_good(odd_docs, none)
    assert kept.schema == odd_docs.schema and as_rows(kept) == as_rows(odd_docs)
    assert Q.keep_good(no_docs, model).count() == 0


def test_training_agrees_over_partitions(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    a, b = Q.train(docs, labels, 300), Q.train(docs.repartition(9), labels, 300)
    assert np.array_equal(a[0], b[0]) and a[3] == b[3]
