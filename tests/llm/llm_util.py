"""Shared data and comparisons of the tests of this folder."""

import duckdb

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that the operators use inside; clashing with them must not matter.
CLASHES = ("h", "n", "s", "e", "a", "b", "key", "mark", "row", "size", "shard", "score", "unit", "hit", "words",
           "component_id", "bucket", "target", "taken", "kept_id", "rows", "lang_pred", "s1", "s2", "w")
LONG = " ".join(f"long{i}" for i in range(60_000))
PROSE = ("the quick brown fox jumps over the lazy dog while seven wizards mix potions of jade and honey under a "
         "pale winter moon that shines on quiet hills where shepherds count their sheep and hum old songs about "
         "rivers ships lanterns and the long road home past broken mills and orchards full of sour green apples "
         "until morning comes again")


def docs_of(sf):
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def against_sql(spark, name, sf, tables=("documents", "benchmark", "labels", "conversations", "embeddings")):
    """Rows of the registered query and of its SQL, both sorted."""
    from loanscope.llm import registry

    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf)
    rel = con.sql(registry.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    return as_rows(df.select(sorted(df.columns))), sorted(
        (tuple(r) for r in rel.select(", ".join(sorted(rel.columns))).fetchall()), key=repr)
