"""Quality classifier: a linear-chain conditional random field over lines.

Every non-blank line of a document is good or bad.  A line's features are its
own statistics and those of the lines before and after it; the chain adds
transition weights.  Lines carry the label of their document in training,
which maximises the exact conditional likelihood by gradient ascent (Adam).
A document's quality is the mean of its lines' forward-backward marginals of
"good", weighted by line length; a logistic curve fitted on the training
documents turns it into the score, the probability of label 1.

The chain is fitted on the driver on about ``TRAIN_DOCS`` labelled documents
(chosen by key hash; their line features are made on the executors).  Scoring
covers every line of every document.

Defined results: null, empty or blank texts score the share of good documents
in the training rows, as does everything if nothing can be learned (0.5 where
no label exists at all); labels that are null are not learned; repeated rows
get a row each; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.llm.common import ship, table

TRAIN_DOCS = 6_000        # bound of the training sample, in documents
THRESHOLD = 0.3           # fixed by the contract: predicted is 1 from here on
STEPS, RATE, RIDGE = 150, 0.1, 1e-3
FEATURES = 14

ALPHA = bytes(range(65, 91)) + bytes(range(97, 123))
CAPS = bytes(range(65, 91))
DIGITS = b"0123456789"
MARKS = b"#$%&*!|@^~<>{}[]\\_=+"
HIGH = bytes(range(128, 256))


def line_stats(line: str, times: int) -> list[float]:
    """Features of one line that stands ``times`` times in its document; all near 0 to 1."""
    raw = line.encode("utf-8", "surrogatepass")
    n = len(raw)
    words = line.split()
    k = len(words)
    gone = lambda chars: (n - len(raw.translate(None, chars))) / n
    return [1.0, min(np.log1p(n) / 8, 2.0), gone(ALPHA), gone(CAPS), gone(DIGITS), gone(MARKS), gone(HIGH),
            1 - len(set(words)) / k, sum(a == b for a, b in zip(words, words[1:])) / k, min(n / k / 10, 3.0),
            float(line[-1:] in ".?!"), float(times > 1), float(raw.count(b"!!")) / k, float(k < 5)]


def featurize(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines x features with neighbours, line lengths, number of lines of each text)."""
    rows, lengths, counts = [], [], []
    for text in texts:
        lines = [x for x in text.split("\n") if x.strip()] if isinstance(text, str) else []
        seen: dict[str, int] = {}
        for x in lines:
            seen[x] = seen.get(x, 0) + 1
        rows += [line_stats(x, seen[x]) for x in lines]
        lengths += [len(x) for x in lines]
        counts.append(len(lines))
    own = np.array(rows, dtype=np.float64).reshape(-1, FEATURES)
    counts = np.array(counts, dtype=np.int64)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    ends = np.cumsum(counts)[counts > 0]
    before[(ends - counts[counts > 0])] = 0   # no line before the first,
    after[ends - 1] = 0                       # none after the last
    return np.hstack([own, before, after]), np.array(lengths, dtype=np.float64), counts


def forward_backward(z: np.ndarray, counts: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of "good" for lines with log-odds ``z`` in chains of ``counts``
    lines, and the expected transition counts.  Chains run in lock-step,
    longest first, so the work is the number of lines."""
    emit = np.empty((len(z), 2))
    emit[:, 1] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    emit[:, 0] = 1 - emit[:, 1]
    emit += 1e-12
    move = np.exp(trans)
    order = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[order]
    long = counts[order]
    steps = int(long[0]) if len(long) else 0
    active = np.searchsorted(-long, -np.arange(steps), side="left")  # chains with more than t lines
    alpha, beta = np.empty_like(emit), np.ones_like(emit)
    for t in range(steps):
        at = first[:active[t]] + t
        a = emit[at] if t == 0 else (alpha[at - 1] @ move) * emit[at]
        alpha[at] = a / a.sum(1, keepdims=True)
    expected = np.zeros((2, 2))
    for t in range(steps - 1, 0, -1):
        at = first[:active[t]] + t
        ahead = emit[at] * beta[at]
        pair = alpha[at - 1][:, :, None] * move * ahead[:, None, :]
        expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        b = ahead @ move.T
        beta[at - 1] = b / b.sum(1, keepdims=True)
    both = alpha * beta
    return both[:, 1] / both.sum(1), expected


def fit_chain(x: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and 2 x 2 transition weights of the most likely chain."""
    y = np.repeat(labels, counts).astype(np.float64)
    seen = np.zeros((2, 2))
    for k, label in zip(counts, labels):
        seen[int(label), int(label)] += max(0, k - 1)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        p, expected = forward_backward(x @ theta[:-4], counts, theta[-4:].reshape(2, 2))
        grad = np.concatenate([x.T @ (y - p), (seen - expected).ravel()]) / len(y) - RIDGE * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        theta = theta + RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def fit_curve(share: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from good share (log-odds) to label."""
    f = np.column_stack([log_odds(share), np.ones(len(share))])
    beta = np.array([1.0, 0.0])
    for _ in range(50):  # Newton steps, lightly ridged
        p = 1 / (1 + np.exp(-np.clip(f @ beta, -30, 30)))
        hess = (f * (p * (1 - p))[:, None]).T @ f + 1e-2 * np.eye(2)
        beta = beta + np.linalg.solve(hess, f.T @ (y - p) - 1e-2 * (beta - [1.0, 0.0]))
    return float(beta[0]), float(beta[1])


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def good_share(x: np.ndarray, lengths: np.ndarray, counts: np.ndarray, weights, trans) -> np.ndarray:
    """Length-weighted mean marginal of every text that has lines."""
    p, _ = forward_backward(x @ weights, counts, trans)
    starts = (np.cumsum(counts) - counts)[counts > 0]
    return np.add.reduceat(p * lengths, starts) / np.add.reduceat(lengths, starts)


def score_texts(texts, weights, trans, curve, prior: float) -> np.ndarray:
    x, lengths, counts = featurize(texts)
    out = np.full(len(counts), prior)
    if weights is not None and len(x):
        share = good_share(x, lengths, counts, weights, trans)
        out[counts > 0] = 1 / (1 + np.exp(-(curve[0] * log_odds(share) + curve[1])))
    return out


def held_out(key: Column) -> Column:
    return F.crc32(F.encode(key.cast("string"), "UTF-8")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS):
    """(weights, transitions, curve, prior) from the rows of ``labels`` that are not held out."""
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where(
        F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    share = bound / max(1, usable.count())
    bucket = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20))
    picked = usable.where(bucket < int(min(1.0, share) * (1 << 20))).limit(2 * bound)

    def lines(batches):
        for b in batches:
            x, lengths, counts = featurize(b["text"])
            x = np.column_stack([x, lengths])
            cuts = np.cumsum(counts)[:-1]
            yield pd.DataFrame({"y": b["y"], "n": counts.astype("int32"),
                                "x": [np.ascontiguousarray(p, dtype=np.float32).tobytes() for p in np.split(x, cuts)]})

    got = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "y").mapInPandas(
        lines, "y int, n int, x binary").toPandas()
    if not len(got):
        return None, None, None, 0.5
    prior = float(got["y"].mean())
    got = got[got["n"] > 0]
    if got["y"].nunique() < 2:
        return None, None, None, prior
    x = np.frombuffer(b"".join(got["x"]), dtype=np.float32).reshape(-1, 3 * FEATURES + 1).astype(np.float64)
    # Rows arrive in any order: a fixed order makes reruns agree.
    first = np.concatenate([[0], np.cumsum(got["n"])[:-1]])
    keys = sorted(range(len(got)), key=lambda i: (got["x"].iloc[i], got["y"].iloc[i]))
    at = np.concatenate([np.arange(first[i], first[i] + got["n"].iloc[i]) for i in keys])
    x, lengths = x[at, :-1], x[at, -1]
    counts, y = got["n"].to_numpy()[keys].astype(np.int64), got["y"].to_numpy()[keys]
    weights, trans = fit_chain(x, counts, y)
    return weights, trans, fit_curve(good_share(x, lengths, counts, weights, trans), y), prior


def score(docs: DataFrame, model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and score for every row of ``docs``."""
    weights, trans, curve, prior = model
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def scored(batches):
        for b in batches:
            yield b[list(keep)].assign(score=score_texts(b["text"], weights, trans, curve, prior))

    columns = list(dict.fromkeys([*keep, "text"]))
    return docs.select(*columns).mapInPandas(scored, f"{kinds}, score double")


def keep_good(docs: DataFrame, model) -> DataFrame:
    """The rows of ``docs`` with a score of THRESHOLD or more, unchanged."""
    weights, trans, curve, prior = model

    def good(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            yield b.filter(pa.array(score_texts(texts, weights, trans, curve, prior) >= THRESHOLD))

    return docs.mapInArrow(good, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


ship(__name__)
