"""Python workers that cannot import this package: everything they need travels with the job."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.append(sys.argv[1])          # the driver's own path; workers don't inherit it
import __spark_entry__
from graphsift.session import get_session

spark = get_session(master="local[4]", shuffle_partitions=4)

def importable(batches):
    import importlib.util
    for b in batches:
        yield b.assign(found=importlib.util.find_spec("graphsift") is not None)

assert not spark.range(1).mapInPandas(importable, "id bigint, found boolean").first().found
for name in sys.argv[2:]:
    print(name, __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count(), flush=True)
"""
QUERIES = ["op2_language_id", "op3_warc", "op4_embedding_dedup", "op5_html_text", "op6_sentence_piece", "op11_token_files",
           "op13_spelling", "pipeline"]       # the pipeline's stages are operators 9, 10, 1, 8 and 7


def test_queries_run_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, ROOT, *QUERIES], cwd=tmp_path, env=env, capture_output=True, text=True,
                          timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    counts = dict(line.split() for line in done.stdout.splitlines() if line.split()[:1] and line.split()[0] in QUERIES)
    assert set(counts) == set(QUERIES) and all(int(n) > 0 for n in counts.values())
