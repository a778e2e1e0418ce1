import duckdb
from llm_util import SF, SMALL, against_sql, as_rows

from loanscope.llm import mixing


def brute_targets(sizes):
    """Clamp and reshare until no target is above twice its source's size."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return target


def test_sql(spark):
    for sf in (SMALL, SF):
        got, want = against_sql(spark, "op6_mixing", sf)
        assert got == want


def test_targets_by_repeated_clamping(spark):
    for sizes in ({"a": 100, "b": 5, "c": 40, "d": 7, None: 3}, {"x": 10}, {"a": 0, "b": 0}, {"a": 1, "b": 1000, "c": 0}):
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys()
        for s in want:
            assert abs(got[s] - want[s]) < 1e-6


def test_taken_words_meet_targets(spark):
    got = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    for _, part in got.groupby("source"):
        assert 0 <= part.target.iloc[0] - part.taken.sum() < 1
    assert (got.taken <= 2 * got["size"]).all()
    # All but one document a source are taken whole times.
    part = got[(got["size"] > 0) & (got.taken % got["size"].clip(lower=1) != 0)]
    assert part.groupby("source").size().max() <= 1


def test_edge_cases(odd_docs, no_docs):
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0
    got = mixing.mix(odd_docs).toPandas()
    assert len(got) == odd_docs.count()
    assert (got[got["size"] == 0].taken == 0).all() and (got.taken <= 2 * got["size"]).all()
    assert abs(got.taken.sum() - 1.5 * got["size"].sum()) < 8
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert set(r.text for r in mixed.select("text").collect()) <= set(r.text for r in odd_docs.select("text").collect())


def test_reruns_agree_over_partitions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert as_rows(mixing.mix(docs)) == as_rows(mixing.mix(docs.repartition(7)))


def test_sizes(spark):
    want = dict(duckdb.sql(f"SELECT doc_id, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) FROM '{SMALL}/documents.parquet'").fetchall())
    got = mixing.op6_mixing(spark, SMALL).collect()
    assert {r.doc_id: r["size"] for r in got} == want
