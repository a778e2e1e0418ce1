"""Suffix-array dedup: remove bytes that repeat an earlier document.

A byte goes when it is covered by a ``LENGTH``-byte string that also starts
in a document with a smaller id.  Suffix arrays over the whole corpus would
cost several times its size, so only strings whose surroundings differ reach
them:

1. Every ``LENGTH``-byte window has an anchor, its least hashed ``GRAM``-byte
   substring (leftmost).  Windows in a row with one anchor are a run, and the
   bytes they cover its context; equal windows have equal anchors.  A scan
   sends (anchor hash, context hash, place) of every run, sorted.
2. Runs that share anchor and context repeat as a whole: all but those of the
   smallest id are removed at once, inside a scanning task first.
3. Where an anchor has several contexts, one copy of each goes to a shard
   chosen by the anchor.  A shard sorts its contexts' suffixes by
   Larsson-Sadakane refinement (groups not yet sorted are split by the rank
   ``h`` bytes on, ``h`` doubling) and takes common prefixes by Kasai's
   recurrence, run for many blocks of text in lock-step.  Neighbours
   with ``LENGTH`` bytes in common form groups; all but the smallest id go.
4. An anchor with more than ``SHARD_RUNS`` contexts fills several shards.
   Their sorted group heads are merged across shards by binary search, in as
   many slices as the anchor has shards, dealt by a hash of the whole head.

No string is dropped or capped anywhere.  Steps 1 and 2 compare two 64-bit
hashes, steps 3 and 4 bytes.  Defined results: null text is empty; texts of
fewer bytes keep all; repeated rows and rows that share an id do not remove
each other; a null id counts as larger than all; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.llm.common import batches_of, materialize, release, ship, table
from loanscope.llm.shingles import BASE, mix

LENGTH = 50
GRAM = 20
WINDOW = LENGTH - GRAM + 1      # anchors to choose from in a window
PIECE = 1 << 17                 # bytes hashed at a time
FLUSH_RUNS = 400_000            # runs a scanning task holds before it sends them
BUCKET_RUNS = 400_000           # runs that meet in one group
SHARD_BYTES = 1 << 20           # contexts of a suffix array
SHARD_RUNS = 20_000             # contexts of one anchor in a shard
SHARDS_A_TASK = 2               # suffix arrays that a task sorts
NO_ID = (1 << 63) - 1
END = 0xFF                      # ends a context; no byte of UTF-8

_powers: list[np.ndarray] = []


def powers() -> np.ndarray:
    if not _powers:
        p = np.full(PIECE + 1, BASE, dtype=np.uint64)
        p[0] = 1
        _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers[0]


def runs_of(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray):
    """(anchor hash, context hash, document's number, first and last window start)
    of the runs in a buffer whose documents lie at ``begins`` to ``ends``."""
    n, p = len(raw), powers()
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[:n], out=total[1:])
    gram = mix((total[GRAM:] - total[:-GRAM]) * p[PIECE - np.arange(n - GRAM + 1)])
    # Low bits hold the place, so the least value is the leftmost of equals.
    low = np.uint64(PIECE * 2 - 1)
    least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    number = np.maximum(ends - begins - LENGTH + 1, 0)
    doc = np.repeat(np.arange(len(begins)), number)
    start = np.repeat(begins - (np.cumsum(number) - number), number) + np.arange(len(doc))
    if not len(start):
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 3
    anchor = (least[start] & low).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]))
    tail = np.append(head[1:], len(start)) - 1
    first, last = start[head], start[tail]
    size = (last - first).astype(np.uint64)
    context = mix((total[last + LENGTH] - total[first]) * p[PIECE - first] + size * np.uint64(0xA24BAED4963EE407))
    # The place of the anchor in its context is part of the identity.
    context = mix(context + (anchor[head] - first).astype(np.uint64))
    return gram[anchor[head]], context, doc[head], first - begins[doc[head]], last - begins[doc[head]]


def scan_texts(raws: list[bytes]):
    """Yields (number of the text, runs as in ``runs_of``) for texts of any length."""
    i = 0
    while i < len(raws):
        if len(raws[i]) > PIECE:
            whole = np.frombuffer(raws[i], dtype=np.uint8)
            for at in range(0, len(whole) - LENGTH + 1, PIECE - LENGTH + 1):
                part = whole[at:at + PIECE]
                kh, ctx, doc, first, last = runs_of(part, np.array([0]), np.array([len(part)]))
                yield kh, ctx, doc + i, first + at, last + at
            i += 1
            continue
        j, size = i, 0
        while j < len(raws) and size + len(raws[j]) <= PIECE:
            size += len(raws[j])
            j += 1
        ends = np.cumsum([len(r) for r in raws[i:j]])
        begins = np.concatenate([[0], ends[:-1]])
        if size >= LENGTH:
            kh, ctx, doc, first, last = runs_of(np.frombuffer(b"".join(raws[i:j]), dtype=np.uint8), begins, ends)
            yield kh, ctx, doc + i, first, last
        i = j


def heads(*columns: np.ndarray) -> np.ndarray:
    """Where sorted columns begin a new value."""
    if not len(columns[0]):
        return np.empty(0, dtype=bool)
    new = np.zeros(len(columns[0]), dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffixes of ``text`` in order.  A suffix ends at the next ``END``; equal
    ones follow each other by place."""
    n = len(text)
    ends = np.flatnonzero(text == END)
    stop = np.repeat(ends, np.diff(np.concatenate([[-1], ends])))
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    key, inside = np.zeros(n, dtype=np.uint64), np.arange(n)
    for i in range(8):
        key = (key << np.uint64(8)) | np.where(inside + i <= stop, padded[i:n + i], 0).astype(np.uint64)
    sa = np.argsort(key, kind="stable")
    new = heads(key[sa])
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = 1 + np.maximum.accumulate(np.where(new, inside, 0))
    h = 8
    longest = int((stop - inside).max()) + 1
    while h < longest:
        todo = np.flatnonzero(~(new & np.append(new[1:], True)))   # groups that are not sorted yet
        if not len(todo):
            break
        at = sa[todo]
        ahead = np.where(at + h <= stop[at], rank[np.minimum(at + h, n - 1)], 0)
        pair = (rank[at].astype(np.uint64) << np.uint64(32)) | ahead.astype(np.uint64)
        order = np.argsort(pair, kind="stable")
        at = at[order]
        sa[todo] = at
        new[todo] |= heads(pair[order])
        rank[at] = 1 + np.maximum.accumulate(np.where(new[todo], todo, 0))
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, depth: int = LENGTH, lane: int = 128) -> np.ndarray:
    """Bytes that each suffix in ``sa`` shares with the one before, up to
    ``depth``: Kasai's recurrence, each block of ``lane`` bytes a lane of its own."""
    n = len(text)
    padded = np.concatenate([text, np.full(depth + 1, END, dtype=np.uint8)])
    place = np.empty(n, dtype=np.int64)
    place[sa] = np.arange(n)
    before = np.concatenate([[0], sa])[place]     # the suffix before each suffix; the first has none
    out = np.zeros(n, dtype=np.int64)
    start = np.arange(0, n, lane)
    h = np.zeros(len(start), dtype=np.int64)
    for t in range(lane):
        live = start + t < n
        start, h = start[live], np.maximum(h[live] - 1, 0)
        at = start + t
        other = before[at]
        h[place[at] == 0] = 0
        grow = np.flatnonzero((place[at] > 0) & (h < depth))
        while len(grow):
            byte = padded[at[grow] + h[grow]]
            grow = grow[(byte == padded[other[grow] + h[grow]]) & (byte != END)]
            h[grow] += 1
            grow = grow[h[grow] < depth]
        out[place[at]] = h
    return out


def repeats(raws: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of the contexts ``raws``: (context's number, offset, whether
    a context of a smaller document has it).  One suffix array over all of them."""
    size = np.array([len(r) for r in raws])
    text = np.frombuffer(b"".join(r + bytes([END]) for r in raws), dtype=np.uint8)
    begin = np.cumsum(size + 1) - size - 1
    number = np.maximum(size - LENGTH + 1, 0)
    which = np.repeat(np.arange(len(raws)), number)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number)
    at = begin[which] + offset
    owner = np.full(len(text), NO_ID, dtype=np.int64)
    owner[at] = docs[which]
    sa = suffix_array(text)
    head = common_prefixes(text, sa) < LENGTH
    least = np.empty(len(text), dtype=np.int64)
    least[sa] = np.minimum.reduceat(owner[sa], np.flatnonzero(head))[np.cumsum(head) - 1]
    return which, offset, owner[at] > least[at]


def window_bytes(raws: list[bytes], which: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """The windows at ``offset`` of the contexts ``which``, a row of LENGTH bytes each."""
    begin = np.cumsum([0] + [len(r) for r in raws])
    text = np.frombuffer(b"".join(raws) + bytes(LENGTH), dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(text, LENGTH)[begin[which] + offset]


def window_hashes(windows: np.ndarray) -> np.ndarray:
    """A hash of all bytes of each window."""
    words = np.zeros((len(windows), -(-LENGTH // 8) * 8), dtype=np.uint8)
    words[:, :LENGTH] = windows
    h = np.zeros(len(windows), dtype=np.uint64)
    for word in words.view(np.uint64).T:
        h = mix(h + word)
    return h


def merge_spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs of overlapping or touching spans."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order])
    new = np.concatenate([[True], first[1:] > reach[:-1]])
    return first[new], reach[np.append(np.flatnonzero(new)[1:], len(first)) - 1]


def repeated_spans(docs: DataFrame, shard_runs: int = SHARD_RUNS) -> DataFrame:
    """doc_id, mark (hash of the text), s, e: spans of bytes to remove; they may overlap."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
                       F.xxhash64("text").alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(total / (WINDOW + 1) * 2 // BUCKET_RUNS) + 1
    span_kind = "doc_id long, mark long, s int, e int"

    def send(batches):
        kept, docs_seen, marks_seen, held = [], [], [], 0

        def packed(done, at, kh, ctx, num, first, last, ids, marks):
            """One row a bucket for the runs ``at``: places, and keys unless they are done."""
            to = (mix(kh[at]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            at, to = at[order], to[order]
            for cut in np.split(np.arange(len(at)), np.flatnonzero(np.diff(to)) + 1):
                if len(cut):
                    rows = at[cut]
                    used, local = np.unique(num[rows], return_inverse=True)
                    yield pd.DataFrame({
                        "bucket": [to[cut[0]]], "done": [done], "num": [local.astype(np.uint32).tobytes()],
                        "kh": [b"" if done else kh[rows].tobytes()], "ctx": [b"" if done else ctx[rows].tobytes()],
                        "first": [first[rows].astype(np.uint32).tobytes()],
                        "size": [(last - first)[rows].astype(np.uint8).tobytes()],
                        "ids": [ids[used].tobytes()], "marks": [marks[used].tobytes()]})

        def sent():
            kh, ctx, num, first, last = (np.concatenate(c) for c in zip(*kept))
            ids, marks = np.array(docs_seen, dtype=np.int64), np.array(marks_seen, dtype=np.int64)
            order = np.lexsort((ids[num], ctx, kh))
            runs = kh[order], ctx[order], num[order], first[order], last[order]
            head = heads(*runs[:2])
            owner = ids[runs[2]]
            again = owner > owner[head][np.cumsum(head) - 1]
            for done in (True, False):
                yield from packed(done, np.flatnonzero(again == done), *runs, ids, marks)

        for b in batches:
            for at in batches_of(b["text"]):
                base = len(docs_seen)
                docs_seen += b["doc_id"].iloc[at].tolist()
                marks_seen += b["mark"].iloc[at].tolist()
                for kh, ctx, num, first, last in scan_texts([t.encode("utf-8", "surrogatepass") for t in b["text"].iloc[at]]):
                    kept.append((kh, ctx, (num + base).astype(np.int32), first.astype(np.int32), last.astype(np.int32)))
                    held += len(kh)
                if held >= FLUSH_RUNS:
                    yield from sent()
                    kept, docs_seen, marks_seen, held = [], [], [], 0
        if held:
            yield from sent()

    parts = docs.mapInPandas(send, "bucket long, done boolean, num binary, kh binary, ctx binary, first binary, "
                                   "size binary, ids binary, marks binary")

    def unpacked(b):
        """(kh, ctx, first and last window start, ids, marks) of the runs in rows of ``packed``."""
        read = lambda c, kind: np.frombuffer(b"".join(b[c]), dtype=kind)
        of = np.cumsum([0] + [len(x) // 8 for x in b["ids"]])[:-1]
        num = read("num", "u4").astype(np.int64) + np.repeat(of, [len(x) // 4 for x in b["num"]])
        first = read("first", "u4").astype(np.int64)
        return (read("kh", "u8"), read("ctx", "u8"), first, first + read("size", "u1"),
                read("ids", "i8")[num], read("marks", "i8")[num])

    def meet(b):
        _, _, first, last, ids, marks = unpacked(b[b["done"]])
        done = pd.DataFrame({"doc_id": ids, "mark": marks, "s": first, "e": last + LENGTH})
        kh, ctx, first, last, ids, marks = unpacked(b[~b["done"]])
        order = np.lexsort((ids, ctx, kh))
        kh, ctx, first, last, ids, marks = (x[order] for x in (kh, ctx, first, last, ids, marks))
        head = heads(kh, ctx)
        again = ids > ids[head][np.cumsum(head) - 1]
        spans = pd.DataFrame({"doc_id": ids[again], "mark": marks[again], "s": first[again], "e": last[again] + LENGTH})
        spans = pd.concat([done, spans]).assign(kh=0, shard=-1, slices=0)
        # Anchors whose contexts differ, with more than one document: to the suffix arrays.
        left = np.flatnonzero(~again)
        if len(left):
            one = heads(kh[left])
            begin = np.flatnonzero(one)
            group = np.cumsum(one) - 1
            mixed = (np.minimum.reduceat(ids[left], begin) != np.maximum.reduceat(ids[left], begin))[group]
            count = np.diff(np.append(begin, len(left)))[group]
            place = np.arange(len(left)) - begin[group]
            at = left[mixed]
            ask = pd.DataFrame({"doc_id": ids[at], "mark": marks[at], "s": first[at], "e": last[at] + LENGTH,
                                "kh": kh[at].astype(np.int64), "shard": place[mixed] // shard_runs,
                                "slices": np.where(count[mixed] > shard_runs, (count[mixed] - 1) // shard_runs + 1, 0)})
            spans = pd.concat([spans, ask])
        return spans

    found = materialize(parts.groupBy("bucket").applyInPandas(
        meet, f"{span_kind}, kh long, shard int, slices int"), "suffix-runs")
    release(spark)
    ask = found.where("shard >= 0")
    load = ask.agg(F.sum(F.col("e") - F.col("s"))).first()[0] or 0
    shards = int(load // SHARD_BYTES) + 1
    wanted = ask.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("s", "e", "kh", "shard", "slices")).alias("runs"))

    def cut_out(batches):
        for b in batches:
            out = []
            for doc, mark, text, runs in zip(b["doc_id"], b["mark"], b["text"], b["runs"]):
                raw = text.encode("utf-8", "surrogatepass")
                out += [(doc, mark, r["s"], r["kh"], r["shard"], r["slices"], raw[r["s"]:r["e"]]) for r in runs]
            yield pd.DataFrame(out, columns=["doc_id", "mark", "s", "kh", "shard", "slices", "raw"])

    contexts = docs.join(wanted, ["doc_id", "mark"]).mapInPandas(
        cut_out, "doc_id long, mark long, s int, kh long, shard int, slices int, raw binary")

    def sort_shard(b):
        b = b.drop_duplicates(["doc_id", "mark", "s"]).reset_index(drop=True)
        which, offset, again = repeats(b["raw"].tolist(), b["doc_id"].to_numpy())
        ids, marks, base = (b[c].to_numpy() for c in ("doc_id", "mark", "s"))
        w, o = which[again], offset[again]
        new = np.concatenate([[True], (w[1:] != w[:-1]) | (o[1:] != o[:-1] + 1)]) if len(w) else np.empty(0, bool)
        end = np.append(np.flatnonzero(new)[1:], len(w)) - 1 if len(w) else np.empty(0, int)
        spans = pd.DataFrame({"doc_id": ids[w[new]], "mark": marks[w[new]], "s": base[w[new]] + o[new],
                              "e": base[w[end]] + o[end] + LENGTH})
        # Heads of the groups of an anchor with several shards, one row for each slice of them.
        kh, slices = b["kh"].to_numpy(), b["slices"].to_numpy()
        lead = np.flatnonzero(~again & (slices[which] > 0))
        w, o = which[lead], offset[lead]
        windows = window_bytes(b["raw"].tolist(), w, o)
        to = (window_hashes(windows) % np.maximum(slices[w], 1).astype(np.uint64)).astype(np.int64)
        order = np.lexsort((to, kh[w]))
        rows = []
        for at in np.split(order, np.flatnonzero(heads(kh[w][order], to[order]))[1:]):
            if len(at):
                rows.append((kh[w[at[0]]], to[at[0]], windows[at].tobytes(), ids[w[at]].tobytes(), marks[w[at]].tobytes(),
                             (base[w[at]] + o[at]).astype(np.int64).tobytes()))
        top = pd.DataFrame(rows, columns=["kh", "slice", "head", "ids", "marks", "starts"])
        # No nulls in numbers, which would make them floats.
        return pd.concat([spans.assign(kh=0, slice=-1), top.assign(doc_id=0, mark=0, s=0, e=0)]).astype(
            {c: "int64" for c in ("doc_id", "mark", "kh")}).reindex(columns=["doc_id", "mark", "s", "e", *top.columns])

    contexts = contexts.withColumn("to", F.pmod(F.xxhash64("kh"), F.lit(shards))).repartition(
        shards // SHARDS_A_TASK + 1, "to", "shard")
    sorted_out = materialize(contexts.groupBy("to", "shard").applyInPandas(
        sort_shard, f"{span_kind}, kh long, slice int, head binary, ids binary, marks binary, starts binary"), "suffix-shards")
    release(spark)

    def merge(b):
        # S-typed bytes drop trailing zeros; the length is the same for all, so equality holds.
        run = np.frombuffer(b"".join(b["head"]), dtype=f"S{LENGTH}")
        ids, marks, start = (np.frombuffer(b"".join(b[c]), dtype=np.int64) for c in ("ids", "marks", "starts"))
        all_heads = np.unique(run)
        place = np.searchsorted(all_heads, run)
        least = np.full(len(all_heads), NO_ID)
        np.minimum.at(least, place, ids)
        more = ids > least[place]
        return pd.DataFrame({"doc_id": ids[more], "mark": marks[more], "s": start[more], "e": start[more] + LENGTH})

    crossed = sorted_out.where("slice >= 0").groupBy("kh", "slice").applyInPandas(merge, span_kind)
    return (found.where("shard < 0").select("doc_id", "mark", "s", "e")
            .union(sorted_out.where("slice < 0").select("doc_id", "mark", "s", "e")).union(crossed))


def remove_repeats(docs: DataFrame, shard_runs: int = SHARD_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) for every row of ``docs``."""
    spans = repeated_spans(docs, shard_runs).groupBy("doc_id", "mark").agg(
        F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
                       F.xxhash64("text").alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for b in batches:
            out = []
            for doc, text, s, e in zip(b["id"], b["text"], b["s"], b["e"]):
                raw = text.encode("utf-8", "surrogatepass")
                kept, at, runs = [], 0, 0
                if s is not None and len(s):
                    for x, y in zip(*merge_spans(np.asarray(s), np.asarray(e))):
                        kept.append(raw[at:x])
                        at, runs = y, runs + 1
                left = b"".join([*kept, raw[at:]])
                out.append((doc, len(raw), len(raw) - len(left), runs, left))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.join(spans, ["doc_id", "mark"], "left").select("id", "text", "s", "e").mapInPandas(
        cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document."""
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ship(__name__)
