"""Python-backed queries must run when the driver's working directory is not the repository.

Runs in a fresh process (its own Spark application) started from a temporary directory, loading
``__spark_entry__`` by path, as an external driver would.
"""

import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = textwrap.dedent(f"""
    import importlib.util
    spec = importlib.util.spec_from_file_location("entry", {os.path.join(REPO, "__spark_entry__.py")!r})
    E = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(E)
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "4").getOrCreate())
    for name in ["detector_plugin", "breaker_states", "stream_breaker"]:
        print(name, E.queries()[name](spark, "/root/testdata/sf0.001").count())
    spark.stop()
""")


def test_queries_run_from_another_directory(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True,
                         timeout=600)
    assert out.returncode == 0, out.stderr[-3000:]
    counts = dict(line.split() for line in out.stdout.strip().splitlines())
    assert int(counts["detector_plugin"]) == 200
    assert int(counts["breaker_states"]) > 0 and counts["breaker_states"] == counts["stream_breaker"]
