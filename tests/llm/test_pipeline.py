import collections

import duckdb
import pytest
from llm_util import SF, as_rows
from test_decontamination import brute as brute_hits
from test_jaccard import brute_components
from test_mixing import brute_targets
from test_sharding import brute_capacity, groups_of

import corpus_pipeline as C
from loanscope.llm import quality


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's result on what the one before kept."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for _, f in C.STAGES:
        docs = C.materialize(f(spark, docs, SF), "test-pipeline")
        out.append(docs)
    return [d.toPandas() for d in out]


def rows(df):
    return sorted(zip(df.doc_id, df.text), key=repr)


def test_stages_return_documents(stages):
    for df in stages[:-1]:
        assert list(df.columns) == list(stages[0].columns)
    assert [n for n, _ in C.STAGES][-1] == "sharding" and len(C.STAGES) == 5


def test_quality_stage(spark, stages):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    score = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert set(stages[1].doc_id) == {i for i, s in score.items() if s >= 0.3}
    label = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    kept = set(stages[1].doc_id)
    assert sum(i in kept for i, q in label.items() if q == 1) >= 0.97 * sum(label.values())


def test_near_duplicate_stage(stages):
    want = brute_components(rows(stages[1]), 5, 80)
    assert sorted(stages[2].doc_id) == sorted(i for i, (n, c) in want.items() if n == 0 or c == i)


def test_decontamination_stage(stages):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    bad = {r[0] for r in brute_hits(rows(stages[2]), items) if r[-1]}
    assert bad and rows(stages[3]) == [r for r in rows(stages[2]) if r[0] not in bad]


def test_mixing_stage(stages):
    before, after = stages[3], stages[4]
    size = {i: len(t.split()) for i, t in rows(before)}
    source = dict(zip(before.doc_id, before.source))
    by = collections.Counter()
    for i, n in size.items():
        by[source[i]] += n
    target = brute_targets(dict(by))
    copies, taken = collections.Counter(after.doc_id), collections.Counter()
    for i, k in copies.items():
        assert k <= 2
        taken[source[i]] += k * size[i]
    for s in target:
        assert abs(taken[s] - target[s]) <= max(size[i] for i in size if source[i] == s)


def test_sharding_stage(stages):
    docs, shards = stages[4], stages[5]
    assert sorted(shards.doc_id) == sorted(docs.doc_id)
    assert shards.groupby("shard")["size"].sum().max() == brute_capacity(groups_of(list(zip(docs.doc_id, docs.text))), 24)


def test_run_and_edge_cases(spark, odd_docs, no_docs, tmp_path, stages):
    assert sorted(r.doc_id for r in C.run(spark, SF).collect()) == sorted(stages[5].doc_id)
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        top = tmp_path / name
        docs.write.parquet(f"{top}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
        spark.createDataFrame([(1, "one two")], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
        got = C.run(spark, str(top))
        assert got.count() > 0 if name == "odd" else got.count() == 0
