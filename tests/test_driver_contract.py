"""The driver contract from a clean process: module loaded by path from another
working directory, a plain session, Python task code (TreeSHAP) included."""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = textwrap.dedent(f"""
    import importlib.util
    spec = importlib.util.spec_from_file_location("spark_entry", {os.path.join(ROOT, "__spark_entry__.py")!r})
    E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)
    from pyspark.sql import SparkSession
    spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    df = E.entry(spark)
    assert df.columns == ["Region", "DefaultRate", "NumLoans"] and df.count() > 0
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert q["x1_tree_shap"](spark, "/root/testdata/sf0.001").count() > 0
    print("CONTRACT-OK")
""")


def test_driver_contract_in_clean_process(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=str(tmp_path), env=env,
                         capture_output=True, text=True, timeout=900)
    assert "CONTRACT-OK" in out.stdout, out.stderr[-3000:]
