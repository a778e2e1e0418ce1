"""N-gram Jaccard join: globally ordered shingle sets in a prefix tree.

Documents link when ``100 * |A & B| >= 85 * |A | B|`` over their distinct
4-word shingles.  Shingles are 64-bit hashes, ordered by value everywhere.

1. Documents with equal sets are one class, whose smallest id stands for it.
2. Candidates: linked sets differ in at most ``D`` shingles, a bound by size.
   The hash range is cut into about ``1.25 D`` parts, so the parts that a set
   fills, less ``D``, are equal in both.  Sets meet under the hashes of their
   parts, inside a task first, then across tasks (a group hands on one partial row a
   set, so a set has as many as it has parts, however large the table); a set that shares fewer parts
   with any others than it must is linked with nothing and leaves.
3. The sets that stay meet once more, and a part's sets are tied to its
   smallest.  Components of the ties, each size class by itself, are the join's
   work units: a set is in two at most.  Inside one, the
   sets are sorted by the global order; with the common prefixes of neighbours
   this list is the prefix tree in depth-first order.  A set is walked down
   the tree: overlap counted on a shared prefix is not counted again, subtrees
   whose remaining lengths cannot reach the needed overlap are skipped, and so
   are sets already connected.  Units of over ``BLOCK`` sets are joined as
   pairs of blocks, so a task never holds more than two blocks.
4. Components of the verified links give the result.

Nothing is approximate but the hashes.  Defined results: null, empty and blank
texts have 0 shingles and are their own component; repeated rows count each;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.llm.common import SPACED_WORD, ascii_lower, batches_of, materialize, release, ship, table
from loanscope.llm.components import components
from loanscope.llm.shingles import hash_words, mix, shingle_hashes

WORDS = 4
PERCENT = 85
BLOCK = 2_000           # sets of a work unit in one task, or in either block of it
TASK_KEYS = 1_000_000   # part hashes that meet in one group
BUCKETS = 64            # fewest groups: a set's keys spread alike at every size of the table
RANGE_BITS = 8          # 256 ranges of the global order
FLUSH_KEYS = 400_000    # part hashes a scanning task holds before it sends them


def most_apart(size: int, percent: int) -> int:
    """Most shingles in which two linked sets can differ if the smaller has ``size``."""
    union = size * 100 // percent
    return union - -(-union * percent // 100)


def node_of(mark: int, k: int) -> int:
    """The set ``mark`` in size class ``k``, as a signed 64-bit id."""
    both = (mark * 0x9E3779B97F4A7C15 + (k + 1) * 0xD6E8FEB86659FD93) & ((1 << 64) - 1)
    return int(mix(np.array([both], dtype=np.uint64)).astype(np.int64)[0])


class Parts:
    """Part hashes of sets.  Size classes grow by more than 100 / percent, so
    linked sets are in the same or in neighbouring ones."""

    def __init__(self, percent: int):
        self.percent, self.tops = percent, [1]

    def classes(self, size: int) -> list[int]:
        while self.tops[-1] < size:
            top = self.tops[-1]
            self.tops.append(max(top + 1, -(-top * 100 // self.percent)))
        k = int(np.searchsorted(self.tops, size))
        return [k, k - 1] if k else [k]

    def cut(self, shingles: np.ndarray):
        """For each class of a sorted set: (class, places of its parts in the set, which
        parts count, how many of them a linked set must share)."""
        for k in self.classes(len(shingles)):
            apart = most_apart(self.tops[k], self.percent)
            parts = apart + 1 + (-(-apart // 4))
            width = np.uint64(((1 << 64) - 1) // parts)
            edges = np.searchsorted(shingles, np.arange(1, parts, dtype=np.uint64) * width)
            edges = np.concatenate([[0], edges, [len(shingles)]])
            filled = edges[1:] > edges[:-1]
            some = filled.sum() > apart
            # A set that sends all parts may share empty ones with a set that sends only its filled ones.
            use = filled if some else np.ones(parts, dtype=bool)
            yield k, edges, use, int(filled.sum()) - apart if some else 1

    def needs(self, mark: int, shingles: np.ndarray) -> list[tuple[int, int]]:
        """(node, fewest parts that a set linked in this class shares) for each class: a
        set stands in its own class for its smaller role, in the one below for its larger."""
        return [(node_of(mark, k), need) for k, *_, need in self.cut(shingles)] if len(shingles) else []

    def keys(self, mark: int, shingles: np.ndarray):
        """(node, part keys) of a sorted set in each class."""
        mixed = mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
        run = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed, dtype=np.uint64)])
        for k, edges, use, _ in self.cut(shingles):
            total = (run[edges[1:]] - run[edges[:-1]])[use]
            place = np.flatnonzero(use).astype(np.uint64) + np.uint64(k << 40)
            yield node_of(mark, k), mix(mix(total) + mix(place))


def sets_of(texts, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, counts = hash_words(texts)
    s, number = shingle_hashes(h, counts, words)
    return [np.unique(x) for x in np.split(s, np.cumsum(number)[:-1])] if len(number) else []


def signature(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    if not len(s):
        return 0, 0
    a, b = mix(s), mix(s + np.uint64(0x632BE59BD9B4E019))
    return tuple(int(mix(np.array([x.sum(dtype=np.uint64) + np.uint64(len(s))]))[0].astype(np.int64)) for x in (a, b))


def star(keys: np.ndarray, sets: np.ndarray, what: int):
    """(keys once each, smallest set of each), and for ``what`` = 1 the distinct ties smallest -
    other, for 2 (sets, number of keys that they share with other sets)."""
    order = np.lexsort((sets, keys))
    keys, sets = keys[order], sets[order]
    if not len(keys):
        return (keys, sets), (sets, sets)
    head = np.concatenate([[True], keys[1:] != keys[:-1]])
    group, first = np.cumsum(head) - 1, np.flatnonzero(head)
    low = sets[first]
    if what == 2:
        high = sets[np.append(first[1:], len(keys)) - 1]
        return (keys[head], low), np.unique(sets[(low != high)[group]], return_counts=True)
    a, b = low[group], sets
    a, b = a[a != b], b[a != b]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return (keys[head], low), (a[new], b[new])


def meeting(sets: DataFrame, read, percent: int, buckets: int, what: int) -> DataFrame:
    """``sets`` meet under their part keys: (a, b) ties of nodes for ``what`` = 1, (node,
    number of shared keys) for 2, partial results of tasks and groups.  ``read``
    makes (mark, shingles, nodes that take part or None for all) of a batch."""
    def send(batches):
        parts, keys, owners, held, seen = Parts(percent), [], [], 0, set()

        def sent():
            for done, (first, second) in enumerate(star(np.concatenate(keys), np.concatenate(owners), what)):
                to = (mix(first.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                to, first, second = to[order], first[order], second[order]
                begin = np.flatnonzero(np.diff(to, prepend=-1))
                ends = list(zip(begin, np.append(begin[1:], len(to))))
                if ends:
                    yield pd.DataFrame({"bucket": to[begin], "done": done > 0, "a": [
                        first[i:j].tobytes() for i, j in ends], "b": [second[i:j].tobytes() for i, j in ends]})

        for batch in batches:
            for mark, s, only in read(batch):
                if mark in seen:
                    continue
                seen.add(mark)
                for node, k in parts.keys(mark, s):
                    if only is None or node in only:
                        keys.append(k.astype(np.int64))
                        owners.append(np.full(len(k), node, dtype=np.int64))
                        held += len(k)
                if held >= FLUSH_KEYS:
                    yield from sent()
                    keys, owners, held = [], [], 0
        if keys:
            yield from sent()

    def meet(b):
        k, o, a, c = (np.frombuffer(b"".join(b.loc[b["done"] == d, x]), dtype=np.int64)
                      for d in (False, True) for x in ("a", "b"))
        found = star(k, o, what)[1]
        return pd.DataFrame({"a": np.concatenate([found[0], a]), "b": np.concatenate([found[1], c])})

    return sets.mapInPandas(send, "bucket int, done boolean, a binary, b binary").groupBy("bucket").applyInPandas(
        meet, "a long, b long")


def trie_links(ids: list[int], blocks: list[int], sets: list[np.ndarray], across: bool, percent: int) -> list[tuple]:
    """Links that connect all linked sets; ``across``: only sets of different blocks are compared."""
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
    ids, blocks, sets = [ids[i] for i in order], np.array([blocks[i] for i in order]), [sets[i] for i in order]
    size = np.array([len(s) for s in sets], dtype=np.int64)
    common = np.zeros(len(sets), dtype=np.int64)   # shared prefix with the set before
    for i in range(1, len(sets)):
        m = min(size[i - 1], size[i])
        same = sets[i - 1][:m] == sets[i][:m]
        common[i] = m if same.all() else int(same.argmin())
    tokens, place = np.unique(np.concatenate(sets), return_inverse=True)
    dense = np.split(place, np.cumsum(size)[:-1])
    # Shingles by range of the global order: what two sets can share in a range bounds their overlap.
    ranges = np.stack([np.bincount((s >> np.uint64(64 - RANGE_BITS)).astype(np.int64), minlength=1 << RANGE_BITS)
                       for s in sets]).astype(np.int32)
    group, links = np.arange(len(sets)), []        # group[i]: of the connected sets, kept flat
    held = np.zeros(len(tokens), dtype=bool)
    for x in range(len(sets)):
        rest = slice(x + 1, None)
        fits = (group[rest] != group[x]) & (100 * size[rest] >= percent * size[x]) & (100 * size[x] >= percent * size[rest])
        if across:
            fits &= blocks[rest] != blocks[x]
        todo = np.flatnonzero(fits) + x + 1
        reach = np.minimum(ranges[x], ranges[todo]).sum(1)
        todo = todo[(100 + percent) * reach >= percent * (size[x] + size[todo])]
        if not len(todo):
            continue
        held[dense[x]] = True
        # No set that fits is smaller than percent of x, which bounds the overlap needed from below.
        least = -(-percent * (size[x] + -(-percent * size[x] // 100)) // (100 + percent))
        path, last, dead = np.zeros(1, dtype=np.int64), None, 1 << 60
        for y in todo.tolist():
            if group[y] == group[x]:
                continue
            depth = int(common[last + 1:y + 1].min()) if last is not None else 0
            if depth >= dead:  # in a subtree that was ruled out
                continue
            # path[d]: overlap of x with the first d shingles on the way to the last set.
            path = np.concatenate([path[:depth + 1], path[depth] + np.cumsum(held[dense[y][depth:]])])
            last, dead = y, 1 << 60
            if 100 * path[-1] >= percent * (size[x] + size[y] - path[-1]):
                links.append((ids[x], ids[y]))
                group[group == group[y]] = group[x]
            else:
                passed = np.concatenate([[0], np.searchsorted(dense[x], dense[y], side="right")])
                out = np.flatnonzero(path + size[x] - passed < least)
                dead = int(out[0]) if len(out) else dead
        held[dense[x]] = False
    return links


def near_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def profile(batches):
        parts = Parts(percent)
        for b in batches:
            for at in batches_of(b["text"]):
                sets = sets_of(b["text"].iloc[at], words)
                marks = [signature(s) for s in sets]
                needs = [parts.needs(m[0], s) for m, s in zip(marks, sets)]
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[at], "n": [len(s) for s in sets], "s1": [m[0] for m in marks],
                                    "s2": [m[1] for m in marks], "nodes": [[x for x, _ in c] for c in needs],
                                    "needs": [[x for _, x in c] for c in needs]})

    prof = materialize(docs.mapInPandas(
        profile, "doc_id long, n long, s1 long, s2 long, nodes array<long>, needs array<int>"), "jaccard-sets")
    classes = materialize(prof.where("n > 0").groupBy("s1", "s2").agg(
        F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.min("nodes").alias("nodes"), F.min("needs").alias("needs")),
        "jaccard-classes")

    def of_texts(batch):
        for at in batches_of(batch["text"]):
            yield from ((signature(s)[0], s, None) for s in sets_of(batch["text"].iloc[at], words) if len(s))

    def of_blobs(batch):
        for mark, s, nodes in zip(batch["mark"], batch["s"], batch["nodes"]):
            yield mark, np.frombuffer(s, dtype=np.uint64), set(nodes)

    def buckets(frame):
        return max(BUCKETS, int((frame.agg(F.sum("n")).first()[0] or 0) * 0.4 // TASK_KEYS) + 1)

    shared = meeting(docs.select("text"), of_texts, percent, buckets(prof), 2).groupBy("a").agg(F.sum("b").alias("shared"))
    standing = classes.select("rep", "s1", "n", F.inline(F.arrays_zip("nodes", "needs")))
    staying = materialize(standing.join(shared, F.col("nodes") == F.col("a")).where("shared >= needs").groupBy(
        F.col("rep").alias("doc_id"), F.col("s1").alias("mark"), "n").agg(F.collect_set("nodes").alias("nodes")),
        "jaccard-staying")
    release(spark)

    def chosen(batches):
        for b in batches:
            for at in batches_of(b["text"]):
                part = b.iloc[at].drop(columns="text")
                sets = sets_of(b["text"].iloc[at], words)
                same = [signature(s)[0] == m for s, m in zip(sets, part["mark"])]  # not another row of this id
                yield part[["doc_id", "mark", "nodes"]].assign(s=[s.tobytes() for s in sets])[same]

    # Merge joins: what stays has no proven bound, so it is not broadcast at any size.
    sets = materialize(docs.join(staying.select("doc_id", "mark", "nodes").hint("merge"), "doc_id").mapInPandas(
        chosen, "doc_id long, mark long, nodes array<long>, s binary"), "jaccard-candidates")
    ties = materialize(meeting(sets.select("mark", "s", "nodes"), of_blobs, percent, buckets(staying), 1), "jaccard-ties")
    release(spark)
    unit = components(ties).withColumnRenamed("component", "unit")
    unit = unit.join(unit.groupBy("unit").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "unit")
    sets = sets.select("doc_id", "mark", "s", F.explode("nodes").alias("node")).join(unit.hint("merge"), "node").withColumn("block", F.pmod(F.xxhash64("mark"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sets = sets.select("*", other.alias("other")).select(
        "doc_id", "unit", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "s")

    def join_unit(b):
        b = b.drop_duplicates("doc_id").sort_values("doc_id")
        found = trie_links(b["doc_id"].tolist(), b["block"].tolist(), [np.frombuffer(s, dtype=np.uint64) for s in b["s"]],
                           b["low"].iloc[0] != b["high"].iloc[0], percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    links = materialize(sets.groupBy("unit", "low", "high").applyInPandas(join_unit, "a long, b long"), "jaccard-links")
    release(spark)
    comp = components(links).select(F.col("node").alias("rep"), "component")
    found = classes.join(comp, "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    return prof.join(found, ["s1", "s2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id.
    Documents without shingles are linked with nothing and stay, each row."""
    stay = near_classes(docs, words, percent).where("n_shingles = 0 or doc_id <=> component_id")
    stay = materialize(stay.groupBy(F.col("doc_id").alias("kept_id")).agg(
        F.sum((F.col("n_shingles") > 0).cast("long")).alias("rows")), "jaccard-kept")
    same = docs["doc_id"].cast("long").eqNullSafe(stay["kept_id"])
    whole = docs.join(stay.where("rows <= 1").hint("merge"), same, "left_semi")
    if stay.where("rows > 1").isEmpty():
        return whole
    # Ids with several rows: those of equal words are one document.
    words_in = F.array_join(F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(SPACED_WORD),
                                                 F.lit(0)), " ")
    name = "words" + "_" * max(len(c) for c in docs.columns)    # no column of docs
    several = docs.join(stay.where("rows > 1"), same, "left_semi").withColumn(name, words_in)
    return whole.union(several.where(F.col(name) == "").drop(name)).union(
        several.where(F.col(name) != "").dropDuplicates(["doc_id", name]).drop(name))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked documents among all documents."""
    return near_classes(table(spark, sf_dir, "documents"))


ship(__name__)
