import hashlib
import re

import duckdb
from llm_util import SF, SMALL, against_sql, as_rows, docs_of

from loanscope.llm import decontamination as D
from loanscope.llm.common import LOWER, PLAIN_WORD, UPPER

TO_LOWER = str.maketrans(UPPER, LOWER)


def words(text):
    return re.findall(PLAIN_WORD, (text or "").translate(TO_LOWER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i:i + 13]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_sql_and_brute_force(spark):
    got, want = against_sql(spark, "op2_decontamination", SF)
    assert got == want
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    assert as_rows(D.op2_decontamination(spark, SF)) == brute([d[:2] for d in docs_of(SF)], items)
    assert any(r[-1] for r in brute([d[:2] for d in docs_of(SF)], items))


def small(spark):
    run = " ".join(f"w{i}" for i in range(15))
    items = spark.createDataFrame([(1, run), (2, "Short item, here"), (None, "..."), (4, None), (5, run)],
                                  "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, f"Hello {run.upper()}, end É"), (2, "a short, ITEM here! ok"), (3, None), (4, ""), (4, "clean text"),
         (4, "clean text"), (None, "x short item here"), (6, run[:30])], "doc_id long, text string")
    return docs, items


def test_shuffled_join_equals_broadcast(spark):
    docs, items = small(spark)
    assert as_rows(D.find_hits(docs, items)) == as_rows(D.find_hits(docs, items, part_bytes=300))


def test_removal(spark):
    docs, items = small(spark)
    assert sorted(r.doc_id for r in D.decontaminate(docs, items).collect()) == [3, 4, 4, 4, 6]
    spans = {r.doc_id: r.text for r in D.decontaminate(docs, items, "spans").collect()}
    assert spans[1].split() == ["Hello", ",", "end", "É"] and spans[2].split() == ["a", ",", "!", "ok"]
    assert spans[3] is None


def test_edge_cases(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "one two"), (2, "")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.find_hits(no_docs, items).count() == 0
    got = D.find_hits(odd_docs, items).toPandas()
    assert len(got) == odd_docs.count()
    assert sorted(got[got.hit.str.len() > 0].doc_id) == [10, 10]
    assert (D.find_hits(odd_docs, none).toPandas().hit.str.len() == 0).all()
    kept = D.decontaminate(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 2
    assert as_rows(D.decontaminate(odd_docs, none)) == as_rows(odd_docs)


def test_small_sf_sql(spark):
    got, want = against_sql(spark, "op2_decontamination", SMALL)
    assert got == want


def test_large_benchmark_with_one_word_items(spark):
    """200,000 windows and a one-word item take the same plan; little is written."""
    import os

    from loanscope.session import ensure_checkpoint_dir

    items = spark.range(2_000).selectExpr("id AS item_id", "array_join(transform(sequence(1, 112), i -> concat('w', id, 'x', i)), ' ') AS text")
    items = items.union(spark.createDataFrame([(9_999, "yes")], items.schema))
    docs = spark.range(400).selectExpr("id AS doc_id", "concat(repeat('plain words and yes ', 300), IF(id % 10 = 0, array_join(transform("
                                       "sequence(20, 40), i -> concat('W', id, 'x', i)), ' '), ''), repeat(' more of the same', 200)) AS text")
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs if "decontamination-hits" in d)
    before = size()
    got = {r.doc_id: r for r in D.find_hits(docs, items).collect()}
    assert size() - before < 400 * 9_000
    for i, r in got.items():
        start = 1200
        run = list(range(start, start + 21)) if i % 10 == 0 else []
        assert r.items == (["9999"] if not run else sorted([str(i), "9999"]))
        assert r.hit == sorted([4 * j + 3 for j in range(300)] + run)
