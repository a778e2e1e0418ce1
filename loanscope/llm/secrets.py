"""Secret scans: pattern candidates judged by corpus-wide ownership frequency.

Three base patterns and one broad pattern (``opaque``: long mixed tokens that
no base span covers) give candidates.  The hash of each candidate's value is
counted over the whole corpus by distinct owners and repositories: a value
that ``EXAMPLE_OWNERS`` owners or ``EXAMPLE_REPOSITORIES`` repositories or more hold
is a copied example, any other is owner-specific and taken for live.  Base spans
always stay; opaque candidates are added only when live.

Positions come from splitting the text at the matches: a match ends after
all the pieces and matches up to it, one running sum a pattern.  Base spans that
cover a broad one are found by a sweep in either direction.  Both are linear in the
number of matches, so a very long text full of them is no special case.  Values are counted per (value, owner,
repository) before they meet, so a copied example held by a third of all
documents is a row per repository.

Defined results: null text is empty; documents without candidates have
counts 0 and empty strings; a null owner is one owner; equal (id, text, owner)
rows get equal results each; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.llm.common import materialize, table

# The contract's base patterns with their least lengths, and the broad one.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_LENGTH = 20
HEX = r"[0-9a-f]{24,}"     # a maximal run of 24 or more is what "run, at least 24 long" keeps
OPAQUE = r"[A-Za-z0-9+/_=-]{20,}"
OPAQUE_NEEDS = ("[0-9]", "[A-Z]", "[a-z]")
KINDS = ("assign", "access", "hex", "opaque")
EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 5
CHUNK = 256     # elements that a running array holds before they are put aside

SPAN = "array<struct<s:int,rank:int,e:int,kind:string,value:string>>"
JUDGED = SPAN[:-2] + ",owners:bigint,repositories:bigint>>"


def running(items: Column, first: Column, step, emit, kind: str) -> Column:
    """One element for each of ``items``: ``emit(state, item)``, where ``state`` begins as ``first`` and
    becomes ``step(state, item)``.  Elements are put aside in chunks, so that none is copied often."""
    def merge(a, x):
        full, new = F.size(a["now"]) >= CHUNK, emit(a["state"], x)
        return F.struct(step(a["state"], x).alias("state"),
                        F.when(full, F.array_append(a["done"], a["now"])).otherwise(a["done"]).alias("done"),
                        F.when(full, F.array(new)).otherwise(F.array_append(a["now"], new)).alias("now"))

    zero = F.struct(first.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("done"),
                    F.array().cast(f"array<{kind}>").alias("now"))
    return F.aggregate(items, zero, merge, lambda a: F.flatten(F.array_append(a["done"], a["now"])))


def uncovered(base: Column, broad: Column) -> Column:
    """The spans of ``broad`` that no span of ``base`` meets, in order."""
    every = F.array_sort(F.concat(base, broad))
    is_base = lambda x: x["rank"] < 3
    # Where the base spans before a span end, and where those after it begin.
    reach = lambda last, x: F.when(is_base(x), F.greatest(last, x["e"])).otherwise(last)
    begin = lambda next_, x: F.when(is_base(x), x["s"]).otherwise(next_)
    before = running(every, F.lit(-1), reach, lambda last, x: last, "int")
    after = F.reverse(running(F.reverse(every), F.lit((1 << 31) - 1), begin, lambda next_, x: next_, "int"))
    sides = F.zip_with(every, F.arrays_zip(before.alias("a"), after.alias("b")), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    free = F.filter(sides, lambda z: ~is_base(z["x"]) & (z["x"]["s"] >= z["y"]["a"]) & (z["x"]["e"] <= z["y"]["b"]))
    return F.transform(free, lambda z: z["x"])


def spans(text: Column, rank: int, pattern: str, group: int, keep) -> Column:
    """Matches of ``pattern`` as structs (start, kind's rank, end, kind, value);
    ``keep`` decides by the match and its value."""
    every = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    # A piece before each match and one after the last, which meets no match.
    steps = F.filter(F.zip_with(F.split(text, pattern, -1), every(0), lambda p, m: F.char_length(p) + F.char_length(m)),
                     lambda n: n.isNotNull())
    ends = running(steps, F.lit(0), lambda last, n: last + n, lambda last, n: last + n, "int")
    both = F.zip_with(every(0), every(group), lambda m, v: F.struct(F.char_length(m).alias("n"), v.alias("value")))
    one = lambda x, e: F.struct(
        (e - x["n"]).alias("s"), F.lit(rank).alias("rank"), e.alias("e"), F.lit(KINDS[rank]).alias("kind"), x["value"].alias("value"))
    found = F.filter(F.zip_with(both, ends, one), lambda x: keep(x.e - x.s, x.value))
    return F.when(text.rlike(pattern), found).otherwise(F.array()).cast(SPAN)


def candidates(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """doc_id, h, owner, repo, base, opaque per row: spans with their values."""
    text = F.col("t")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), owner.alias("owner"),
                       repository.alias("repo")).select(
        "doc_id", F.xxhash64("t", "owner", "repo").alias("h"), "owner", "repo",
        F.concat(spans(text, 0, ASSIGN, 1, lambda n, v: F.char_length(v) >= ASSIGN_VALUE),
                 spans(text, 1, ACCESS, 0, lambda n, v: n >= ACCESS_LENGTH),
                 spans(text, 2, HEX, 0, lambda n, v: F.lit(True))).alias("base"),
        spans(text, 3, OPAQUE, 0, lambda n, v: v.rlike(OPAQUE_NEEDS[0]) & v.rlike(OPAQUE_NEEDS[1])
              & v.rlike(OPAQUE_NEEDS[2])).alias("broad"))
    free = F.when(F.size("broad") == 0, F.col("broad")).otherwise(uncovered(F.col("base"), F.col("broad")))
    return rows.select("doc_id", "h", "owner", "repo", F.array_sort("base").alias("base"), free.alias("opaque"))


def ownership(found: DataFrame) -> DataFrame:
    """v, owners, repositories: how widely each candidate value is held."""
    held = found.select(F.explode(F.concat("base", "opaque")).alias("c"), "owner", "repo").select(
        F.md5(F.col("c.value").cast("binary")).alias("v"), "owner", "repo")
    return (held.groupBy("v", "owner", "repo").agg(F.lit(1).alias("one"))
            .groupBy("v", "owner").agg(F.count("*").alias("repos"))
            .groupBy("v").agg(F.count("*").alias("owners"), F.sum("repos").alias("repositories")))


def joined(arr: Column) -> Column:
    return F.array_join(F.transform(arr, lambda x: F.concat_ws(
        ":", x.kind, x.s.cast("string"), x.e.cast("string"))), ",")


def scan(docs: DataFrame, owner: Column, repository: Column, example_owners: int = EXAMPLE_OWNERS,
         example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """Per row of ``docs``: doc_id, base (spans), spans (base and live opaque ones, with the numbers of
    owners and repositories that hold their value), live and example (numbers of candidates of either sort)."""
    found = materialize(candidates(docs, owner, repository), "secret-candidates")
    single = found.where(F.size("base") + F.size("opaque") > 0).select(
        "doc_id", "h", F.explode(F.concat("base", "opaque")).alias("c")).groupBy("doc_id", "h", "c").agg(
        F.lit(1).alias("one"))
    judged = single.withColumn("v", F.md5(F.col("c.value").cast("binary"))).join(ownership(found), "v").withColumn(
        "live", (F.col("owners") < example_owners) & (F.col("repositories") < example_repositories))
    per_doc = judged.groupBy("doc_id", "h").agg(
        F.sum(F.col("live").cast("long")).alias("n_live"), F.sum((~F.col("live")).cast("long")).alias("n_example"),
        F.collect_list(F.when((F.col("c.rank") < 3) | F.col("live"), F.struct("c.*", "owners", "repositories"))).alias("all")).select(
        F.col("doc_id").alias("c_id"), F.col("h").alias("c_h"), "n_live", "n_example", F.array_sort("all").alias("all"))
    return found.join(per_doc, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("h") == F.col("c_h")), "left").select(
        "doc_id", "base", F.coalesce("all", F.array().cast(JUDGED)).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; a source is an owner, its languages are its repositories."""
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, F.col("source"), F.concat_ws("/", "source", "lang"))
    count = lambda k: F.size(F.filter("base", lambda x: x.kind == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda x: F.concat_ws("/", x.owners.cast("string"), x.repositories.cast("string"))), ",").alias("held_by"),
        "n_live", "n_example")


def _spans_sql(rank: int, pattern: str, group: int, keep: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
SELECT rid, {rank} AS rank, s, s + length(m) AS e, value FROM (
  SELECT rid, m[i] AS m, v[i] AS value,
         coalesce(list_sum([length(x) FOR x IN p[1:i]]), 0) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) AS s
  FROM (SELECT rid, regexp_extract_all(text, '{quoted}') AS m, regexp_extract_all(text, '{quoted}', {group}) AS v,
               string_split_regex(text, '{quoted}') AS p FROM d WHERE regexp_matches(text, '{quoted}')),
       unnest(range(1, len(m) + 1)) AS t(i)) WHERE {keep}"""


OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, source,
                  concat_ws('/', source, lang) AS repo FROM documents),
base AS ({_spans_sql(0, ASSIGN, 1, f'length(value) >= {ASSIGN_VALUE}')}
UNION ALL {_spans_sql(1, ACCESS, 0, f'length(m) >= {ACCESS_LENGTH}')}
UNION ALL {_spans_sql(2, HEX, 0, 'true')}),
opaque AS (SELECT * FROM ({_spans_sql(3, OPAQUE, 0, ' AND '.join(f"regexp_matches(value, '{x}')" for x in OPAQUE_NEEDS))}) o
           WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = o.rid AND b.s < o.e AND o.s < b.e)),
c AS (SELECT *, ['assign', 'access', 'hex', 'opaque'][rank + 1] AS kind FROM (
      SELECT * FROM base UNION ALL SELECT * FROM opaque)),
own AS (SELECT value, count(DISTINCT coalesce(source, '~null')) AS owners, count(DISTINCT [coalesce(source, '~null'), repo]) AS repositories
        FROM c JOIN d USING (rid) GROUP BY value),
j AS (SELECT c.*, owners, repositories, owners < {EXAMPLE_OWNERS} AND repositories < {EXAMPLE_REPOSITORIES} AS live FROM c JOIN own USING (value)),
per AS (SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access,
               count(*) FILTER (rank = 2) AS n_hex,
               string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base,
               string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3 OR live) AS spans,
               string_agg(owners || '/' || repositories, ',' ORDER BY s, rank) FILTER (rank < 3 OR live) AS held_by,
               count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM j GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(held_by, '') AS held_by,
       coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example
FROM d LEFT JOIN per USING (rid)"""
