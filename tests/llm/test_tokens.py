"""Token counts against the library itself; what the cache encodes and keeps."""

import json
import os
import random

import public_tokenizers
import pytest
from llm_util import SF, docs_of

from loanscope.llm import tokens


def library_counts(texts, name):
    texts = ["" if t is None else t for t in texts]
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(public_tokenizers.path(name))
        return [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    from sentencepiece import SentencePieceProcessor

    return [len(x) for x in SentencePieceProcessor(model_file=public_tokenizers.path(name)).encode(texts)]


def test_query_against_the_library(spark):
    docs = docs_of(SF)
    want = sorted((d, len((t or "").encode()), n, n > 512) for (d, t, *_), n in zip(
        docs, library_counts([t for _, t, *_ in docs], "byte_bpe_50k.json")))
    got = tokens.op12_tokens(spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_odd_texts(spark, odd_docs, name):
    more = spark.createDataFrame([(50, "a <|endoftext|> b<|startoftext|>"), (51, "x" * 300_000), (52, "é é ① \U0001f600"),
                                  (53, "\x00   ﻿")], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").union(more)
    rows = docs.collect()
    want = sorted(((r.doc_id, n) for r, n in zip(rows, library_counts([r.text for r in rows], name))), key=repr)
    got = tokens.token_counts(odd_docs.unionByName(more, allowMissingColumns=True), public_tokenizers.path(name))
    assert sorted(((r.doc_id, r.n_tokens) for r in got.collect()), key=repr) == want


def test_no_rows(spark, no_docs):
    assert tokens.token_counts(no_docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("few", [0, 100_000])
def test_only_misses_are_encoded_and_appended(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(tokens, "FEW_MISSES", few)
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    docs = spark.createDataFrame([(i, f"text number {i % 40}") for i in range(400)], "doc_id long, text string").repartition(7)
    assert tokens.token_counts(docs, path, cache).count() == 400
    folder = os.path.join(cache, os.listdir(cache)[0])
    assert spark.read.parquet(folder).count() == 40        # each distinct text once
    # Counts come from the cache: a stored one that no tokenizer would give is kept.
    odd = tmp_path / "cache2"
    name = os.path.basename(folder)
    spark.read.parquet(folder).selectExpr("digest", "CAST(7000 AS LONG) AS n_tokens").write.parquet(str(odd / name))
    more = docs.union(spark.createDataFrame([(900, "a new text"), (901, "a new text")], docs.schema))
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(more, path, str(odd)).collect()}
    assert all(got[i] == 7000 for i in range(400)) and got[900] == got[901] == 3
    assert spark.read.parquet(str(odd / name)).count() == 41
    # Nothing new: nothing is appended.
    tokens.token_counts(more, path, str(odd)).count()
    assert spark.read.parquet(str(odd / name)).count() == 41
    # Another tokenizer has its own counts; repeated appends do no harm.
    spark.read.parquet(str(odd / name)).write.mode("append").parquet(str(odd / name) + "-copy")
    spark.read.parquet(str(odd / name) + "-copy").write.mode("append").parquet(str(odd / name))
    assert tokens.token_counts(more, path, str(odd)).count() == 402
    other = tokens.token_counts(more, public_tokenizers.path("piece_bpe_32k.model"), str(odd))
    assert max(r.n_tokens for r in other.collect()) < 100


LETTERS = [" ", "  ", "a", "Ab", "'", "'s", "'ll", "<|endoftext|>", "<|", "é", "×", "\n", "\t", "\r\n", "\u00a0", "\u2003", "\u3000", "12", "½", "中",
           "\u0301", "!", "\x1c", "\x00", "\U0001f600", "ɏ", "ɐ", "\u200b", "\ufeff"]


def test_pieces_add_up():
    """Sums over pieces equal the library's counts of whole texts, whatever blanks and special strings they hold."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    data = open(path, "rb").read()
    assert tokens.parts_at_spaces(json.loads(data))
    assert not tokens.parts_at_spaces(json.load(open(public_tokenizers.path("word_bpe_49k.json"))))
    rng = random.Random(7)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts += [a + " " + b for a in LETTERS for b in LETTERS] + [a + b + " " + a for a in LETTERS for b in LETTERS]
    count = tokens.encoder("t", ".json", data)
    assert count(texts[:2000]) + count(texts[2000:]) == library_counts(texts, "byte_bpe_50k.json")


def test_pieces_forgotten_and_met_again(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_PIECES", 3)
    asked = []
    count = tokens.by_pieces(lambda texts: [asked.append(t) or len(t) for t in texts])
    assert count(["one two two", "", "two"]) == [11, 0, 3] and asked.count(" two") == 1
    assert count(["a b c d e"]) == count(["a b c d e"]) == [9]


def test_version_digest_covers_every_byte():
    path = public_tokenizers.path("byte_bpe_50k.json")
    data = open(path, "rb").read()
    assert tokens.tokenizer_digest(path, data) != tokens.tokenizer_digest(path, data + b" ")
    assert tokens.tokenizer_digest("a.json", data) != tokens.tokenizer_digest("a.model", data)
