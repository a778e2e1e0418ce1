"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes one blank sign, and
their 1-, 2- and 3-grams are hashed into ``BUCKETS``.  Document frequencies
cover all learnable rows (one partial vector a task, summed).  The model is
trained by FTRL-proximal with L1 and L2 penalties on the driver, on about
``TRAIN_DOCS`` learnable rows chosen by key hash whose sparse counts are made
on the executors; every tenth of them is set aside to fit the temperature.

Learnable rows have a text with a letter and a lang, and are not held out.
Defined results: null texts and texts without a letter are ``und`` with score
1; if nothing can be learned all rows are ``und`` with score 0; repeated rows
get a row each; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.llm.common import ship, table

TRAIN_DOCS = 4_000        # bound of the training sample, in documents
BUCKETS = 1 << 14
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.002, 0.001, 3
GROUP = 64                # texts whose counts are held at once
LONG = 1 << 20            # longer texts are counted by pieces of this many characters

_is_letter = np.empty(0, dtype=bool)


def has_letter(text: str | None) -> bool:
    """A letter, not a numeral or a sign that words may hold."""
    return isinstance(text, str) and any(map(str.isalpha, text))


def letter_table() -> np.ndarray:
    """Which code points are letters; made once a process."""
    global _is_letter
    if not len(_is_letter):
        _is_letter = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _is_letter


def gram_buckets(text: str) -> np.ndarray:
    """Hashed 1-, 2- and 3-grams of one text."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = np.where(letter_table()[code], code, 32)
    code = code[np.concatenate([[True], (code[1:] != 32) | (code[:-1] != 32)])].astype(np.uint32)
    mix = lambda h: ((h * np.uint32(0x9E3779B1)) ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(18)
    one = code * np.uint32(3) + np.uint32(1)
    two = code[:-1] * np.uint32(0x01000193) + code[1:] * np.uint32(5) + np.uint32(2)
    three = two[:-1] * np.uint32(0x01000193) + code[2:] * np.uint32(7)
    return np.concatenate([mix(one), mix(two), mix(three)]).astype(np.int64)


def counts_of(texts: list[str]) -> np.ndarray:
    """texts x BUCKETS counts; whole texts, long ones piece by piece (pieces overlap by two)."""
    out = np.zeros((len(texts), BUCKETS), dtype=np.float32)
    for i, text in enumerate(texts):
        for a in range(0, max(1, len(text)), LONG):
            grams = gram_buckets(text[max(0, a - 2):a + LONG])
            out[i] += np.bincount(grams, minlength=BUCKETS)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of sublinear TF times IDF, of length 1."""
    x = np.log1p(counts) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """BUCKETS x classes weights from sparse rows (buckets, values, class)."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def weights(zi, ni):
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, x, y in rows:
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at], n[at] = zi + g - step * w, ni + g * g
    return weights(z, n)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log likelihood.  One label in n + 1 counts
    as unsure, so a set without errors does not drive the temperature to 0."""
    if not len(y):
        return 1.0
    unsure = 1 / (len(y) + 1)
    aim = np.full(logits.shape, unsure / logits.shape[1])
    aim[np.arange(len(y)), y] += 1 - unsure

    def loss(t):
        return -(aim * np.log(np.maximum(softmax(logits / t), 1e-12))).sum()

    return float(min(np.geomspace(0.02, 5, 120), key=loss))


def held_out(key: Column) -> Column:
    return F.crc32(F.encode(key.cast("string"), "UTF-8")) % 3 == 1


def train(docs: DataFrame, bound: int = TRAIN_DOCS) -> dict | None:
    """{classes, idf, weights, temperature}, or None if nothing can be learned."""
    usable = docs.select("doc_id", "text", "lang").where(
        F.col("text").isNotNull() & F.col("lang").isNotNull()
        & F.coalesce(~held_out(F.col("doc_id")), F.lit(True)))

    def frequencies(batches):
        df, rows = np.zeros(BUCKETS, dtype=np.int64), 0
        for b in batches:
            texts = [t for t in b["text"] if has_letter(t)]
            for a in range(0, len(texts), GROUP):
                df += (counts_of(texts[a:a + GROUP]) > 0).sum(0)
            rows += len(texts)
        hit = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": np.append(hit, -1), "n": np.append(df[hit], rows)})

    df = usable.select("text").mapInPandas(frequencies, "bucket int, n long").groupBy("bucket").agg(
        F.sum("n").alias("n")).toPandas().set_index("bucket")["n"]
    total = int(df.get(-1, 0))
    if not total:
        return None
    idf = np.log((1 + total) / (1 + df.reindex(range(BUCKETS), fill_value=0).to_numpy())) + 1

    def sparse(batches):
        for b in batches:
            got = []
            for text, lang in zip(b["text"], b["lang"]):
                if has_letter(text):
                    c = counts_of([text])[0]
                    at = np.flatnonzero(c)
                    got.append((lang, at.astype(np.int32).tobytes(), c[at].tobytes()))
            yield pd.DataFrame(got, columns=["lang", "at", "c"])

    bucket = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20))
    picked = usable.where(bucket < int(min(1.0, bound / total) * (1 << 20))).limit(2 * bound)
    got = picked.select("text", "lang").mapInPandas(sparse, "lang string, at binary, c binary").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["at", "c", "lang"], ignore_index=True)  # a fixed order makes reruns agree
    got = got.sample(frac=1.0, random_state=1, ignore_index=True)
    classes = sorted(got["lang"].unique())
    rows = []
    for lang, at, c in got.itertuples(index=False):
        at, c = np.frombuffer(at, dtype=np.int32), np.frombuffer(c, dtype=np.float32)
        x = np.log1p(c) * idf[at]
        rows.append((at, x / np.sqrt((x * x).sum()), classes.index(lang)))
    apart = rows[::10] if len(rows) >= 50 else []
    w = fit_ftrl([r for i, r in enumerate(rows) if not apart or i % 10], len(classes))
    logits = np.array([x @ w[at] for at, x, _ in apart])
    return {"classes": classes, "idf": idf, "weights": w,
            "temperature": fit_temperature(logits, np.array([y for _, _, y in apart], dtype=int))}


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def predicted(batches):
        for b in batches:
            texts = list(b["text"])
            real = [i for i, t in enumerate(texts) if has_letter(t)]
            lang = np.full(len(texts), "und", dtype=object)
            score = np.full(len(texts), 1.0 if model else 0.0)
            for a in range(0, len(real) if model else 0, GROUP):
                part = real[a:a + GROUP]
                x = weighted(counts_of([texts[i] for i in part]), model["idf"])
                p = softmax(x @ model["weights"] / model["temperature"])
                best = p.argmax(1)
                lang[part] = np.array(model["classes"], dtype=object)[best]
                score[part] = p[np.arange(len(part)), best]
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": lang, "score": score})

    return docs.select("doc_id", "text").mapInPandas(predicted, f"doc_id {kind}, lang_pred string, score double")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


ship(__name__)
