"""Token counts by a digest cache.

A cache is a Parquet folder with one subfolder a tokenizer version: (digest of a
content, number of its tokens).  The version digest covers the library, its
release, the settings and every byte of the vocabulary file, so a count is never
taken from another tokenizer.

1. Every row's normalised content (null: empty; ``normalise`` may do more as
   long as no count changes) is reduced to its SHA-256 digest, written once.
2. Distinct digests without a stored count are the misses.  Their contents
   leave the scan tasks once each (partial aggregation by digest, so a text that
   a third of all rows hold is one row a task) and are encoded once.
   Where the tokenizer provably starts a token at every single space between two visible
   characters (byte-level pattern, no normaliser), a text's count is the sum over its
   pieces between such spaces, and a task encodes each distinct piece once.
3. The new counts are appended to the cache, and all rows take theirs from it.

The vocabulary travels as a broadcast of its bytes, whose size is checked:
executors need no file.  A lost executor repeats its tasks; only the commit of
the append makes counts visible.  Two jobs that append the same digests do no
harm: readers take one row a digest.

Defined results: null and empty texts have 0 bytes and the count that the library
gives for the empty text; repeated rows and ids each get their row; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable
from importlib.metadata import version

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.llm.common import batches_of, materialize, scratch_path, ship, table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
LIBRARIES = {".json": "tokenizers", ".model": "sentencepiece"}
MOST_BYTES = 256 << 20      # a vocabulary file that may be broadcast
FEW_MISSES = 100_000        # digests (3.2 MB) that may be broadcast to thin out the texts
COUNTS = "digest binary, n_tokens long"
MOST_PIECES = 500_000       # counts of pieces that a process keeps
#: A space between two characters that are neither blank nor of unknown kind.
BETWEEN = re.compile(r" (?=[!-~\u00c0-\u024f])(?<=[!-~\u00c0-\u024f] )")
_ENCODERS: dict[str, Callable[[list[str]], list[int]]] = {}


def content(text: Column) -> Column:
    """What of a text is counted: all of it; null counts as empty."""
    return F.coalesce(text, F.lit(""))


def tokenizer_digest(path: str, data: bytes) -> str:
    """Digest of library, release, settings and vocabulary."""
    library = LIBRARIES[os.path.splitext(path)[1]]
    head = f"{library} {version(library)}; no added special tokens, no truncation, no padding\n"
    return hashlib.sha256(head.encode() + data).hexdigest()


def parts_at_spaces(vocabulary: dict) -> bool:
    """Whether a tokenizer's counts add up over pieces cut before single inner spaces: its pattern
    takes a blank only at the start of a token and looks ahead only, nothing rewrites the
    text, and no added token holds or swallows a blank."""
    pattern = vocabulary.get("pre_tokenizer") or {}
    return (vocabulary.get("normalizer") is None and vocabulary.get("post_processor") is None
            and pattern.get("type") == "ByteLevel" and bool(pattern.get("use_regex")) and not pattern.get("add_prefix_space")
            and all(" " not in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])
                    for t in vocabulary.get("added_tokens", [])))


def by_pieces(count: Callable[[list[str]], list[int]]) -> Callable[[list[str]], list[int]]:
    """Counts of texts as sums over their pieces; pieces met before are not encoded again."""
    known: dict[str, int] = {}

    def counts(texts: list[str]) -> list[int]:
        if len(known) > MOST_PIECES:
            known.clear()
        cut = [BETWEEN.split(t) for t in texts]
        starts = count([c[0] for c in cut])
        rest = [c[1:] for c in cut]
        new = list(set().union(*rest).difference(known))
        known.update(zip(new, count([" " + p for p in new])))
        return [s + sum(map(known.__getitem__, r)) for s, r in zip(starts, rest)]

    return counts


def encoder(name: str, kind: str, data: bytes) -> Callable[[list[str]], list[int]]:
    """Token counts of a list of texts, made once a process and tokenizer version."""
    if name not in _ENCODERS:
        if kind == ".json":
            os.environ["TOKENIZERS_PARALLELISM"] = "false"   # one core a task
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(data.decode("utf-8"))
            tokenizer.no_truncation()
            tokenizer.no_padding()

            def whole(texts: list[str]) -> list[int]:
                return [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

            _ENCODERS[name] = by_pieces(whole) if parts_at_spaces(json.loads(data)) else whole
        else:
            from sentencepiece import SentencePieceProcessor

            pieces = SentencePieceProcessor(model_proto=data)
            _ENCODERS[name] = lambda texts: [len(e) for e in pieces.encode(texts, num_threads=1)]
    return _ENCODERS[name]


def stored_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Stored (digest, n_tokens), one row a digest; none if nothing was ever stored."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], COUNTS)
    return spark.read.schema(COUNTS).parquet(folder).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, cache: str | None = None, limit: int = LIMIT,
                 normalise: Callable[[Column], Column] = content) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text).

    ``path`` is a vocabulary file (.json or .model); ``cache`` is a folder that all
    executors share, kept between calls (default: a new one in the scratch folder)."""
    spark = docs.sparkSession
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} has {len(data)} bytes; at most {MOST_BYTES} are broadcast")
    name, kind = tokenizer_digest(path, data), os.path.splitext(path)[1]
    folder = os.path.join(cache or scratch_path(spark, "token-cache"), name)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalise(F.col("text")).alias("text"),
                        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    texts = texts.withColumn("digest", F.unhex(F.sha2("text", 256)))
    keyed = materialize(texts.select("doc_id", "n_bytes", "digest"), "token-digests")
    stored = stored_counts(spark, folder)
    misses = materialize(keyed.select("digest").distinct().join(stored.select("digest"), "digest", "left_anti"), "token-misses")
    number = misses.count()
    if number:
        few = number <= FEW_MISSES
        found = texts.select("digest", "text")
        if few:     # checked size: most texts leave before the shuffle
            found = found.join(F.broadcast(misses), "digest", "left_semi")
        found = found.groupBy("digest").agg(F.first("text").alias("text"))
        if not few:
            found = found.join(misses.hint("merge"), "digest", "left_semi")
        shipped = spark.sparkContext.broadcast(data)

        def encode(batches):
            count = encoder(name, kind, shipped.value)
            for b in batches:
                for at in batches_of(b["text"], 1 << 20):
                    yield pd.DataFrame({"digest": b["digest"].iloc[at], "n_tokens": count(b["text"].iloc[at].tolist())})

        found.mapInPandas(encode, COUNTS).write.mode("append").parquet(folder)
    counts = stored_counts(spark, folder)
    return keyed.join(counts, "digest", "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op12_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents under the 50k byte-level vocabulary, from an empty cache."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


ship(__name__)
