import duckdb
import numpy as np
from llm_util import SF

from loanscope.llm import embeddings as E


def brute(ids, x, labels, cosine=E.COSINE):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= cosine) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    comp = ids.copy()
    while True:
        new = np.array([min([c, *comp[near[i]]]) for i, c in enumerate(comp)])
        if (new == comp).all():
            return near.sum(1), comp
        comp = new


def clustered(n, rng, dim=16):
    """A hot cluster of a third of all vectors, small clusters, and noise."""
    centre = rng.normal(size=(40, dim))
    which = np.where(rng.random(n) < 0.33, 0, rng.integers(1, 400, n))
    x = np.where((which < 40)[:, None], centre[np.minimum(which, 39)] + 0.08 * rng.normal(size=(n, dim)), rng.normal(size=(n, dim)))
    return x.astype(np.float32), rng.integers(0, 2, n)


def test_recall_and_no_false_links(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x, labels = clustered(2500, rng)
    x[100:160] = x[100]           # exact copies
    labels[100:160] = 1
    ids = rng.permutation(2500) * 3
    links, comp = brute(ids, x.astype(float), labels)
    df = spark.createDataFrame([(int(i), v.tolist(), int(k)) for i, v, k in zip(ids, x, labels)],
                               "vec_id long, embedding array<float>, label int").repartition(5)
    for task in (4096, 150):      # whole leaves, and leaves dealt out in chunks
        monkeypatch.setattr(E, "TASK", task)
        got = E.near_duplicates(df).toPandas().set_index("vec_id").loc[ids]
        assert (got.n_links.to_numpy() <= links).all()
        assert got.n_links.sum() >= 0.97 * links.sum() > 1000
        assert (got.component_id.to_numpy() == comp).mean() > 0.99


def test_tables(spark):
    d = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall()
    links, comp = brute(np.array([r[0] for r in d]), np.array([r[1] for r in d], dtype=float), np.array([r[2] for r in d]))
    got = E.op7_embeddings(spark, SF).toPandas().sort_values("vec_id")
    assert (got.n_links.to_numpy() == links).all() and (got.component_id.to_numpy() == comp).all()
    assert (got.kept == (got.vec_id == got.component_id)).all()


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 0), (6, [0.0, 0.0], 0),
            (7, [nan, 1.0], 0), (8, [inf, 0.0], 0), (9, [None, 1.0], 0), (10, [1.0, 0.01], 0), (11, [1.0, 0.0, 0.0], 0), (12, [], 0),
            (13, [1e-30, 0.0], 0), (14, [1e30, 0.0], 0), (2, [2.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS rep", "2 AS part", "3 AS n_links")
    got = E.near_duplicates(df).toPandas()
    assert len(got) == len(rows)
    by = got.drop_duplicates("vec_id").set_index("vec_id")
    linked = [1, 2, 10, 13, 14]
    assert (by.loc[linked, "component_id"] == 1).all() and (by.loc[linked, "n_links"] == 5).all()
    rest = [i for i in by.index if i not in linked]
    assert (by.loc[rest, "n_links"] == 0).all() and (by.loc[rest, "component_id"] == rest).all()
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert E.near_duplicates(none).count() == 0


def test_an_id_on_several_vectors(spark):
    """Links belong to vectors, not to ids."""
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (5, [0.01, 1.0], 2), (0, [0.0, -1.0], 1), (0, [0.01, 1.0], 1)]
    got = sorted(tuple(r) for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == sorted([(1, 1, 1), (1, 1, 0), (2, 1, 1), (5, 0, 5), (0, 0, 0), (0, 1, 0)])
