import numpy as np
from llm_util import SF, as_rows, docs_of

from loanscope.llm import language as L


def test_held_out_accuracy(spark):
    lang = {d[0]: d[2] for d in docs_of(SF)}
    got = L.op3_language(spark, SF).toPandas()
    assert sorted(got.doc_id) == sorted(lang)
    part = got[got.held_out]
    assert len(part) > 200 and np.mean([lang[i] == p for i, p in zip(part.doc_id, part.lang_pred)]) > 0.98
    assert set(got.lang_pred) <= set(lang.values()) and got.score.between(0, 1).all()


def test_reruns_agree_over_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = L.train(docs), L.train(docs.repartition(5))
    assert np.array_equal(a["weights"], b["weights"]) and a["temperature"] == b["temperature"]


def test_labels_are_not_inputs(spark):
    """The same texts under other ids, langs and sources get the same predictions."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.train(docs)
    other = docs.selectExpr("doc_id", "text", "'xx' AS lang", "'y' AS source")
    assert as_rows(L.predict(docs, model)) == as_rows(L.predict(other, model))


def test_ftrl_is_sparse_and_separates():
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        y = i % 2
        at = np.array([10 + y] + sorted(rng.choice(np.arange(100, 200), 5, replace=False).tolist()))
        x = np.ones(len(at)) / np.sqrt(len(at))
        rows.append((at, x, y))
    w = L.fit_ftrl(rows, 2)
    assert np.mean([int((x @ w[at]).argmax()) == y for at, x, y in rows]) == 1.0
    assert (w[300:] == 0).all()


def test_long_texts_are_counted_whole(monkeypatch):
    text = "Der schnelle braune Fuchs, springt! über den faulen Hund " * 40
    whole = L.counts_of([text])[0]
    monkeypatch.setattr(L, "LONG", 64)
    pieces = L.counts_of([text])[0]
    assert whole.sum() > 5000 and np.abs(whole - pieces).sum() / whole.sum() < 0.15
    assert set(np.flatnonzero(whole)) <= set(np.flatnonzero(pieces))


def test_temperature_prefers_honest_scores():
    logits = np.array([[4.0, 0.0]] * 80 + [[4.0, 0.0]] * 20)
    y = np.array([0] * 80 + [1] * 20)
    t = L.fit_temperature(logits, y)
    assert 0.7 < L.softmax(logits / t)[0, 0] < 0.9


def test_edge_cases(spark, odd_docs, no_docs):
    model = L.train(odd_docs)
    got = L.predict(odd_docs, model).toPandas()
    assert len(got) == odd_docs.count()
    by = got.drop_duplicates("doc_id").set_index("doc_id")
    for i in (3, 4, 5, 9):
        assert by.loc[i, "lang_pred"] == "und"
    assert (by.loc[[1, 7, 11], "lang_pred"] != "und").all()
    assert L.train(no_docs) is None and L.predict(no_docs, None).count() == 0
    untaught = L.predict(odd_docs, None).toPandas()
    assert set(untaught.lang_pred) == {"und"} and set(untaught.score) == {0.0}


def test_letters_of_supplementary_planes_are_scored_by_their_grams():
    """Deseret and Gothic: all letters lie beyond U+FFFF."""
    deseret, gothic = ("".join(chr(a + i % n) + " " * (i % 5 == 0) for i in range(40)) for a, n in ((0x10428, 40), (0x10330, 26)))
    blank = set(L.gram_buckets(" ").tolist())
    grams = [set(L.gram_buckets(t).tolist()) - blank for t in (deseret, gothic)]
    assert min(map(len, grams)) > 50 and len(grams[0] & grams[1]) < 5
    assert set(L.gram_buckets("\U0001F600\U0010FFFF").tolist()) <= blank      # no letters


def test_numerals_and_signs_are_no_letters(spark, odd_docs):
    texts = ["½", "² ① 12", "_ \u0301 5", "Ⅷ", "a½", "中", "\U0001d4b3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = L.train(odd_docs)
    got = {r.doc_id: r.lang_pred for r in L.predict(docs, model).collect()}
    assert [got[i] == "und" for i in range(len(texts))] == [not any(c.isalpha() for c in t) for t in texts]
