"""The queries from a clean process: the entry module loaded by path from another
folder, a plain session, task code that travels by value."""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = textwrap.dedent(f"""
    import importlib.util
    spec = importlib.util.spec_from_file_location("spark_entry", {os.path.join(ROOT, "__spark_entry__.py")!r})
    E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)
    from pyspark.sql import SparkSession
    spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = E.queries()
    names = [n for n in queries if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in queries
    for n in names:
        rows = queries[n](spark, "/root/testdata/sf0.001").count()
        assert rows >= {{"op5_passages": 0, "op11_negatives": 100, "op13_prefixes": 30}}.get(n, 200), (n, rows)
    print("CONTRACT-OK")
""")


def test_queries_in_a_clean_process(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=str(tmp_path), env=env, capture_output=True, text=True, timeout=900)
    assert "CONTRACT-OK" in out.stdout, out.stderr[-3000:]


def test_nothing_else_imports_the_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "loanscope")):
        if os.path.join("loanscope", "llm") in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                assert "loanscope.llm" not in open(os.path.join(folder, f)).read(), f
