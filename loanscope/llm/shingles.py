"""Word and shingle hashes of whole texts, computed in numpy a batch at a time.

A word's hash is a polynomial over its bytes, read off one running sum per
piece of text, so no Python object is made per word.  Words are what
``[^\\x20\\x09-\\x0D]+`` matches after lower-casing A-Z; as its separators are
ASCII, bytes and characters give the same words.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np

from loanscope.llm.common import ship

PIECE = 1 << 18                     # bytes hashed at a time: the arrays stay in a core's cache
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
STEP = np.uint64(0xD6E8FEB86659FD93)
# Fixed value: a word's hash does not depend on PIECE.
LIFT = np.uint64(pow(int(BASE), (1 << 21) - 2 * PIECE, 1 << 64))
SEPARATOR = re.compile(rb"[\x20\x09-\x0D]")

_tables: dict[str, np.ndarray] = {}


def tables() -> dict[str, np.ndarray]:
    """Lower-casing and separator tables and the powers of ``BASE``; made once a process."""
    if not _tables:
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        gap = np.zeros(256, dtype=bool)
        gap[[9, 10, 11, 12, 13, 32]] = True
        powers = np.full(2 * PIECE + 2, BASE, dtype=np.uint64)
        powers[0] = 1
        _tables.update(lower=lower, gap=gap, powers=np.cumprod(powers, dtype=np.uint64))
    return _tables


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result depends on every bit of ``h``."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``raw``."""
    gap = tables()["gap"][np.frombuffer(raw, dtype=np.uint8)]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).view(np.int8)))
    return edges[0::2], edges[1::2]


def piece_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words of a piece of at most 2 * PIECE bytes."""
    t = tables()
    starts, ends = word_spans(raw)
    codes = t["lower"][np.frombuffer(raw, dtype=np.uint8)].astype(np.uint64) + np.uint64(1)
    run = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(codes * t["powers"][:len(raw)], out=run[1:])
    h = mix((run[ends] - run[starts]) * t["powers"][2 * PIECE - starts] * LIFT)
    for i in np.flatnonzero(ends - starts > PIECE):     # as in ``long_piece``, wherever a text is cut
        h[i] = digest_of(raw[starts[i]:ends[i]])
    return h, starts


def digest_of(word: bytes) -> np.uint64:
    """Hash of a word of over PIECE bytes."""
    low = word.lower() if word.isascii() else bytes(tables()["lower"][np.frombuffer(word, dtype=np.uint8)])
    return np.frombuffer(hashlib.blake2b(low, digest_size=8).digest(), dtype=np.uint64)[0]


def pieces(raw: bytes):
    """``raw`` cut at separators into pieces that ``piece_hashes`` takes; a word
    too long for one comes alone."""
    at = 0
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        cut = SEPARATOR.search(raw, end) if end < len(raw) else None
        end = len(raw) if end < len(raw) and cut is None else (cut.start() if cut else end)
        yield raw[at:end]
        at = end


def long_piece(raw: bytes) -> np.ndarray:
    """Hashes of a piece that holds a word of over PIECE bytes."""
    out = []
    for start, end in zip(*word_spans(raw)):
        word = raw[start:end]
        if len(word) <= PIECE:
            out += list(piece_hashes(word)[0])
        else:
            out.append(digest_of(word))
    return np.array(out, dtype=np.uint64)


def hash_words(texts) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words of each text); null texts have none."""
    raws = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
    counts = np.zeros(len(raws), dtype=np.int64)
    out, i = [np.empty(0, dtype=np.uint64)], 0
    while i < len(raws):
        if len(raws[i]) > PIECE:
            for piece in pieces(raws[i]):
                h = piece_hashes(piece)[0] if len(piece) <= 2 * PIECE else long_piece(piece)
                out.append(h)
                counts[i] += len(h)
            i += 1
            continue
        j, size = i, 0
        while j < len(raws) and size + len(raws[j]) + 1 <= PIECE + 1:
            size += len(raws[j]) + 1
            j += 1
        h, starts = piece_hashes(b" ".join(raws[i:j]))
        begins = np.cumsum([0] + [len(r) + 1 for r in raws[i:j]])
        counts[i:j] = np.diff(np.searchsorted(starts, begins))
        out.append(h)
        i = j
    return np.concatenate(out), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all ``k``-word shingles in text order, number of each text).  A
    text of fewer words, but not none, is one shingle."""
    total = len(words)
    many = np.maximum(counts - k + 1, 0)
    first = np.cumsum(counts) - counts
    at = np.repeat(first, many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
    h = np.zeros(max(0, total - k + 1), dtype=np.uint64)
    for i in range(k):
        h = h * STEP + words[i:i + len(h)]
    full = mix(h)[at] if len(at) else np.empty(0, dtype=np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if not len(short):
        return full, many
    number = many.copy()
    number[short] = 1
    out = np.empty(int(number.sum()), dtype=np.uint64)
    begin = np.cumsum(number) - number
    is_short = np.zeros(len(out), dtype=bool)
    is_short[begin[short]] = True
    out[~is_short] = full
    for i in short:
        v = counts[i:i + 1].astype(np.uint64)  # the length comes first: no clash with full shingles
        for w in words[first[i]:first[i] + counts[i]]:
            v = v * STEP + w
        out[begin[i]] = mix(v)[0]
    return out, number


ship(__name__)
