"""A task that dies is run again, and no row is lost or written twice."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = '''
import os, sys
sys.path.insert(0, sys.argv[1])
folder = sys.argv[2]
import gradeframe as gf
from gradeframe.session import SETTINGS
from pyspark.sql import SparkSession

builder = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false")
for key, value in SETTINGS.items():
    builder = builder.config(key, value)
spark = builder.config("spark.sql.shuffle.partitions", "4").getOrCreate()
spark.sparkContext.setLogLevel("OFF")

def make_responder(spec):
    def respond(prompts):
        mark = os.path.join(folder, "died")
        if any("Q7 " in p for p in prompts) and not os.path.exists(mark):
            open(mark, "w").close()
            os._exit(1)
        return ["Answer: B"] * len(prompts)
    return respond

spark.range(0, 40, 1, 4).selectExpr("id", "'S1: a' as s", "concat('Q', id, ' ?') as o").write.parquet(folder + "/items")
items = gf.read_items(spark, folder + "/items")
spec = gf.EvalSpec(id_col="id", sentences_col="s", options_col="o")
first = gf.run_scoring(items.where("id < 20"), spec, make_responder, folder + "/results")
second = gf.run_scoring(items, spec, make_responder, folder + "/results", slices=2)
rows = spark.read.parquet(folder + "/results")
print("RESULT", os.path.exists(folder + "/died"), first.written, second.written, rows.count(),
      rows.select("id").distinct().count(), rows.where("LLM_answer = 'B'").count())
'''


def test_a_dead_worker_costs_nothing(tmp_path):
    script = tmp_path / "job.py"
    script.write_text(SCRIPT)
    done = subprocess.run(
        [sys.executable, str(script), ROOT, str(tmp_path)], capture_output=True, text=True, timeout=300, cwd=tmp_path
    )
    lines = [line for line in done.stdout.splitlines() if line.startswith("RESULT")]
    assert lines == ["RESULT True 20 20 40 40 40"], done.stderr[-3000:]
